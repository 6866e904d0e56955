"""Problems 2, 6, 7, 8 and 9 on small fixtures: exact round trips, brute force and the cases every operator must bear."""

import random

import numpy as np
import pytest

from auditloom.llm import contamination, mojibake, packing, splitting, unify_text

SECTION = "struct<id:string,kind:string,title:string,text:string,page_spans:array<struct<doc_sha256:string,page_start:int,page_end:int>>>"


# --- problem 2


@pytest.mark.parametrize("text", ["word " * 900, "x" * 5001, "a.\n\n" + "Sentence one is here. " * 300, "\U0001f600" * 2500, "é" * 3000, "字。" * 1500, "  \n" * 1200])
def test_pieces_restore_the_text(spark, text):
    df = spark.createDataFrame([(1, text, 9)], "id int, text string, piece int")
    rows = splitting.split_long_texts(df, "text", 2000, 150).orderBy("piece_pos").collect()
    assert len(rows) > 1 and all(len(r.piece) <= 2000 for r in rows)
    assert "".join(r.piece[r.overlap_chars :] for r in rows) == text
    for a, b in zip(rows, rows[1:]):
        assert 0 < b.overlap_chars <= 150 and a.piece.endswith(b.piece[: b.overlap_chars])


def test_pieces_end_at_sentences(spark):
    text = " ".join(f"This is sentence number {i} of a long section." for i in range(150))
    rows = splitting.split_long_texts(spark.createDataFrame([(1, text)], "id int, text string"), "text").orderBy("piece_pos").collect()
    assert all(r.piece.rstrip().endswith(".") for r in rows)


def test_short_null_and_empty_texts_give_no_pieces(spark):
    df = spark.createDataFrame([(1, "short"), (2, None), (3, ""), (4, "x" * 2000)], "id int, text string")
    assert splitting.split_long_texts(df, "text").count() == 0
    assert splitting.split_long_texts(df.limit(0), "text").count() == 0
    with pytest.raises(ValueError):
        splitting.split_long_texts(df, "text", 100, 50)


# --- problem 6


def test_unify_reads_the_same(spark):
    cases = [
        ("Ｆｕｌｌ　ｗｉｄｔｈ １２", "Full width 12"), ("café", "café"), ("zero​width­", "zerowidth"), ("a b c", "a b c"), ("Bауеsian ѕteр", "Bayesian step"), ("R² and χ²", "R² and χ²"),
        ("ﬁt", "fit"), ("PSIS‑LOO", "PSIS-LOO"), ("Данные собраны", "Данные собраны"), ("", ""), (None, None), ("KK", "KK"), ("3 µs", "3 μs"), ("plain", "plain"),
    ]
    df = spark.createDataFrame([(i, a, "kept") for i, (a, _) in enumerate(cases)], "i int, t string, batch string")
    got = {r.i: (r.o, r.batch) for r in unify_text.unify_text(df, "t", "o").collect()}
    assert got == {i: (b, "kept") for i, (_, b) in enumerate(cases)}
    assert unify_text.unify_text(df.limit(0), "t", "o").count() == 0
    long = spark.createDataFrame([(1, "Ａ" * 300_000)], "i int, t string")
    assert unify_text.unify_text(long, "t", "o").first().o == "A" * 300_000


def test_hidden_quotes(spark):
    text = "The Bayesian R² was 3.05. We ran 4 chains."
    docs = spark.createDataFrame([(1, [("s01", "body", "t", text, None), ("s02", "body", "t", None, None)]), (1, [("s01", "body", "t", text, None)]), (2, None)], f"doc_key long, sections array<{SECTION}>")
    quotes = ["The Bayesian R² was", "The Bayesian R² was", "the Bayesian R² was", "The Bayesian R2 was", "Wе ran 4 chains.", None, "​"]
    rows = [(i, 1, ("s01", None, q)) for i, q in enumerate(quotes)] + [(0, 1, ("s01", None, quotes[0])), (50, 1, ("s09", None, quotes[0])), (51, 1, None), (52, None, ("s01", 1, quotes[0]))]
    ev = spark.createDataFrame(rows, "evidence_id long, doc_key long, span struct<section_id:string,page:int,quote:string>")
    assert sorted(r.evidence_id for r in unify_text.hidden_quotes(ev, docs).collect()) == [0, 4]
    assert unify_text.hidden_quotes(ev.limit(0), docs).count() == 0 and unify_text.hidden_quotes(ev, docs.limit(0)).count() == 0


# --- problem 7


def test_packing_keeps_everything_and_its_rules():
    rng = np.random.default_rng(3)
    n = 3000
    size = rng.integers(1, 4000, n)
    source, cluster = rng.integers(0, 5, n), rng.integers(0, 2500, n)
    bins = packing.best_fit(size, source, cluster, 4096)
    used = np.bincount(bins, weights=size)
    assert used.max() <= 4096
    assert len({(b, c) for b, c in zip(bins, cluster)}) == n  # no two of a cluster in one container
    assert len(used) <= 1.03 * size.sum() / 4096 + 2


def test_documents_in_containers(spark):
    rows = [(i, "x" * (50 * (i % 40)), None if i % 3 else "hot", 5) for i in range(2000)] + [(5000, "y" * 10_000, "a", 1), (5001, None, None, 2), (5001, None, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    out = packing.pack_documents(docs).toPandas()
    assert sorted(out[out.part_pos == 0].doc_id) == sorted(r[0] for r in rows)
    assert sorted(out[out.doc_id == 5000].part_size) == [1809, 4096, 4096]
    assert (out.groupby("container_id").part_size.sum() <= 4096).all()
    assert (out.groupby("container_id").part_size.sum() == out.groupby("container_id").container_used.first()).all()
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_copies_never_share_a_container(spark):
    docs = spark.createDataFrame([(i, "same text", "s", i % 7) for i in range(900)] + [(1000 + i, f"other {i}", "t", i) for i in range(900)], "doc_id long, text string, source string, near int")
    out = packing.pack_documents(docs).toPandas()
    assert len(out) == 1800 and out.container_id.nunique() == 900
    assert out[out.doc_id < 900].container_id.nunique() == 900
    near = packing.pack_documents(docs.filter("doc_id < 900"), cluster="near").toPandas()
    near["near"] = near.doc_id % 7
    assert not near.duplicated(["container_id", "near"]).any() and near.container_id.nunique() == 129


def test_strict_sources():
    rng = np.random.default_rng(5)
    source, size, cluster = rng.integers(0, 9, 600), rng.integers(1, 900, 600), np.arange(600)
    bins = packing.best_fit(size, source, cluster, 4096, strict_source=True)
    assert len(set(zip(bins, source))) == 600 and np.bincount(bins, weights=size).max() <= 4096
    assert len(set(bins)) <= np.bincount(source).max() + 20


# --- problem 8


def _longest(a, b):
    return max((next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j)) for i in range(len(a)) for j in range(len(b))), default=0)


def test_suffix_array_matches_brute_force():
    rng = np.random.default_rng(0)
    for n in (0, 1, 60, 700):
        t = rng.integers(-1, 5, n).astype(np.int32)
        key = lambda i: [(int(x), 0) if x >= 0 else (9, i + k) for k, x in enumerate(t[i : i + 64])]  # noqa: E731, B023
        want = sorted((i for i in range(n) if t[i] >= 0), key=key)
        assert list(contamination.suffix_array(t, 1024)) == want


def test_search_finds_every_place():
    rng = np.random.default_rng(1)
    t, q = rng.integers(-1, 4, 400).astype(np.int32), np.append(rng.integers(0, 4, 60), [-3]).astype(np.int32)
    sa = contamination.suffix_array(t, 64)
    starts = np.flatnonzero(q >= 0)
    lo, hi = contamination.search(t, sa, q, starts, 4)
    for s, a, b in zip(starts, lo, hi):
        want = {i for i in range(400) if len(q[s : s + 4]) == 4 and (q[s : s + 4] >= 0).all() and list(t[i : i + 4]) == list(q[s : s + 4])}
        assert set(sa[a:b]) == want


def test_leaks(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    item = [rng.choice(words) for _ in range(60)]
    other = [rng.choice(words) for _ in range(60)]
    fill = lambda n: [rng.choice(words) for _ in range(n)]
    changed = item[:40]
    changed[7] = changed[19] = changed[30] = "zzz"
    docs = [
        (1, " ".join(fill(30) + item + fill(30))), (2, " ".join(fill(30) + item[20:45])), (3, " ".join(fill(10) + item[:12] + fill(30))), (4, " ".join(fill(5) + changed)), (5, " ".join(fill(200))), (6, None), (7, ""),
        (8, "> " + " ".join(item[:30]).upper().replace(" ", ",\n> ")), (9, " ".join(x for pair in zip(item, fill(60)) for x in pair)), (10, " ".join(item[:30]) + " " + " ".join(other[:30])), (1, " ".join(fill(30) + item + fill(30))),
    ]
    items = spark.createDataFrame([(1, "Say which.\n" + " ".join(item)), (2, "Say which.\n" + " ".join(other)), (3, None), (4, "")], "item_id long, text string")
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    got = {(r.doc_id, r.item_id) for r in contamination.find_leaks(df, items).collect()}
    assert got == {(1, 1), (2, 1), (4, 1), (8, 1), (10, 1), (10, 2)}
    assert [sorted(contamination.find_leaks(df, items, block=n).collect()) for n in (1, 2)] == [sorted(contamination.find_leaks(df, items).collect())] * 2
    assert contamination.find_leaks(df.limit(0), items).count() == 0 and contamination.find_leaks(df, items.limit(0)).count() == 0
    kept = contamination.remove_leaking(df, contamination.find_leaks(df, items))
    assert {r.doc_id for r in kept.collect()} == {3, 5, 6, 7, 9}


def test_task_lines_are_counted_over_all_items(spark):
    task = "Read the following passage with care and then say which of the statements after it is true for you."
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    items = spark.createDataFrame([(1, f"{task}\n{a}"), (2, f"{task}\n{b}"), (3, "A line of its own\n" + " ".join(f"c{i}" for i in range(20)))], "item_id long, text string")
    df = spark.createDataFrame([(8, task + " more text"), (9, "before " + " ".join(a.split()[:14]) + " after"), (10, "a line of its own c0 c1 c2 c3")], "doc_id long, text string")
    for block in (1, 2, 20000):
        assert {(r.doc_id, r.item_id, r.verbatim_words) for r in contamination.find_leaks(df, items, block=block).collect()} == {(9, 1, 14), (10, 3, 9)}


def test_chance_matches_do_not_hide_a_passage(spark):
    item = [f"w{i}" for i in range(61)]
    fill = lambda k, n: [f"x{k}y{i}" for i in range(n)]
    doc = item[:4] + fill(1, 8) + item[12:16] + fill(2, 8) + item[24:45]
    df = spark.createDataFrame([(1, " ".join(doc)), (2, " ".join(item[24:45])), (3, " ".join(item[24:44]))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {(r.doc_id, r.span_words, r.matched_words, r.item_word) for r in contamination.find_leaks(df, items).collect()}
    assert got == {(1, 33, 25, 12), (2, 21, 21, 24)}


def test_best_chain_matches_all_chains():
    rng = random.Random(3)
    for _ in range(150):
        m = [np.array(x) for x in zip(*sorted({(rng.randrange(60), rng.randrange(60), rng.randrange(4, 12)) for _ in range(7)}))]
        q, p, n = (x.tolist() for x in m)
        want = 0
        stack = [(i, i, n[i]) for i in range(len(q))]
        while stack:
            f, j, w = stack.pop()
            span, width = q[j] + n[j] - q[f], p[j] + n[j] - p[f]
            want = max(want, span if w >= 0.7 * max(span, width) else 0)
            for i in range(len(q)):
                dp, dq = p[i] - p[j] - n[j], q[i] - q[j] - n[j]
                over = max(0, -dp, -dq)
                if q[i] > q[j] and p[i] > p[j] and dp <= 8 and dq <= 8 and over < n[i] and over < n[j]:
                    stack.append((f, i, w + n[i] - over))
        assert contamination.best_chain(*m)[0] == want


# --- problem 9

TEXTS = ("Größe und Höhe – naïve café", "Łukowiec ąęśćż", "Данные собраны на площадке", "l’analyse de l’étude", "“good mixing” ± 2 ≤ 3", "χ² of σ and β", "Sonsal dağılım ığış")


@pytest.mark.parametrize("encoding", ["cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac-roman", "cp1254", "koi8-r"])
def test_wrong_reading_of_utf8_is_restored(encoding):
    table = mojibake._byte_table(encoding)
    r = mojibake.Repairer()
    for text in TEXTS:
        garbled = "".join(table[b] if b > 127 else chr(b) for b in text.encode())
        got, n, ok = r.repair(garbled)
        assert (got, ok) == (text, True) and n, garbled
        assert r.repair("Correct é before. " + garbled)[0] == "Correct é before. " + text


def test_twice_garbled_and_lost():
    r = mojibake.Repairer()
    twice = "Så länge".encode().decode("cp1252").encode().decode("cp1252")
    assert r.repair(twice)[0] == "Så länge"
    assert r.repair("na�ve")[1:] == (1, False)


@pytest.mark.parametrize("text", [*TEXTS, "CONCLUSÃO: A CONVERGÊNCIA NÃO FOI ALCANÇADA", "São Bertelo à l’été", "Рассказ о Рим и С–П", "√n and √2π", "Été “À propos”", "", "ascii only"])
def test_correct_text_stays(text):
    assert mojibake.Repairer().repair(text) == (text, 0, True)


def test_a_document_is_judged_by_itself(spark):
    good = ["Sonsal dağılım zincir ile kestirildi ve yakınsama yeterli sayıldı.", "Die Gütemaße müssen für die Prüfung vollständig sein."]
    bad = ["Sonsal daðýlým zincir ile kestirildi ve yakýnsama yeterli sayýldý.", "Die GьtemaЯe mьssen fьr die Prьfung vollstдndig sein.", "La loi a ÈtÈ ÈvaluÈe par quadrature, puis comparÈe ‡ la rÈfÈrence."]
    want = {2: good[0], 3: good[1], 4: "La loi a été évaluée par quadrature, puis comparée à la référence."}
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*good, *bad, None, ""])], "doc_id long, text string, k string")
    assert {r.doc_id: r.restored for r in mojibake.repair_encoding(df).collect()} == want
    # the same rows in a corpus a hundred times as large, most of it right or most of it garbled
    for more in (good, bad):
        large = df.unionByName(spark.createDataFrame([(100 + i, more[i % len(more)], "x") for i in range(700)], df.schema))
        assert {r.doc_id: r.restored for r in mojibake.repair_encoding(large).filter("doc_id < 100").collect()} == want
    assert mojibake.repair_encoding(df.limit(0)).count() == 0


def test_letters_out_of_place():
    r = mojibake.Repairer()
    for bad in ("Following Gr‰ntz and others", "at S„o Bertelo", "Following MÈdaux (2014), the protocol", "near N¯rvik in spring"):
        assert r.repair(bad)[1] == 1, bad
    for right in ("a gene×environment effect at 5 ‰", "RStudio™server and Stan®based", "see „Anhang“ und »mehr«", "m±n ≤ 3·k, R²adj", "Zürich–Genève", "O’Connor’s l’été", "word…word", "ÉTÉ", "iPhone d’Émile", "naïve café"):
        assert r.repair(right) == (right, 0, True), right


SENTENCES = {  # right sentences, to be garbled with the encodings of their script
    "cp1252": ["Die Prüfung der Vorannahmen änderte die Größe der Schätzung überhaupt nicht.", "Selon l’équipe, cette hypothèse n’a jamais été vérifiée à l’échelle étudiée.", "El análisis de sensibilidad mostró una variación máxima más allá de lo previsto en español.", "São necessárias informações adicionais sobre a dispersão do parâmetro."],
    "cp1250": ["Wyniki zostały uśrednione po sześciu łańcuchach i są zgodne z założeniami modelu.", "Příliš žluťoučký kůň úpěl ďábelské ódy a měřil přesné hodnoty.", "Az eredmények megbízhatóságát többször ellenőrizték különböző módszerekkel."],
    "cp1254": ["Sonsal dağılım dört zincir ile kestirildi ve yakınsama yeterli sayıldı."],
    "cp1251": ["Данные собраны на площадке в течение шести месяцев и проверены дважды.", "Аналізи показали, що оцінки є стійкими й узгоджуються з моделлю."],
    "cp1253": ["Τα δεδομένα συλλέχθηκαν σε έξι μήνες και ελέγχθηκαν δύο φορές από την ομάδα."],
}


def test_planted_truth():
    """Recall and precision over sentences of 11 languages, whole and inside right text, under all wrong encodings that keep their letters."""
    r = mojibake.Repairer()
    found = planted = restored = 0
    for true, texts in SENTENCES.items():
        for text in texts:
            for wrong in ("utf-8", *mojibake.ONE_BYTE):
                table = mojibake._byte_table(wrong if wrong != "utf-8" else true)
                if wrong == true:
                    continue
                garbled = "".join(table[b] for b in text.encode("utf-8" if wrong == "utf-8" else true, "replace"))
                if sum(a != b for a, b in zip(garbled, text)) < 3:
                    continue
                for before in ("", "Model comparison relied on cross-validation. "):
                    got, n, _ = r.repair(before + garbled)
                    planted, found, restored = planted + 1, found + (n > 0), restored + (got == before + text)
            assert r.repair(text) == (text, 0, True)
    assert planted > 250 and found / planted > 0.95 and restored / planted > 0.75, (planted, found, restored)


def test_garbled_language_is_found_however_much_of_it_is_garbled(spark):
    pl = "Wyniki zostały uśrednione po sześciu łańcuchach i są zgodne z założeniami modelu."
    ru = "Данные собраны на площадке в течение шести месяцев и проверены дважды."
    de = "Die Gütemaße müssen für die Prüfung vollständig sein. Die Größe wurde später geschätzt."
    right = {"pl": (pl, pl.encode("cp1250").decode("cp1252")), "ru": (ru, ru.encode("cp1251").decode("cp1252")), "koi8": (ru, ru.encode("koi8-r").decode("cp1251")), "de": (de, de.encode("cp1252").decode("cp1251"))}
    rows = [(f"{k}{i}", bad) for k, (_, bad) in right.items() for i in range(40)]
    good = [(f"ok{i}", t) for i, t in enumerate([pl] * 3 + ["L’échantillon a été prélevé à l’été; χ² et R² en µm.", "São necessárias mais iterações, não são válidas.", "We thank Łukasz Müller and José García."] * 5)]
    df = spark.createDataFrame(rows + good, "doc_id string, text string")
    got = {r.doc_id: r.restored for r in mojibake.repair_encoding(df).collect()}
    assert got == {f"{k}{i}": t for k, (t, _) in right.items() for i in range(40)}
    for text, bad in right.values():
        assert mojibake.Repairer().repair(bad)[0] == text
