import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from auditloom.operators import archive, context, ratings, scoring, screen, sections, skew
from auditloom.sources import files, providers
from auditloom.streaming import events


def _at(k):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=k)


REPORTS = "report_key string, paper_title string, identifier string, paper_authors array<string>, paper_type array<string>, discipline array<string>, methods array<string>, software array<string>, run_mode string, rubric_profile string, paper_year int, quality_score double, coverage_present int, coverage_applicable int, updated_at timestamp"


def _reports(spark):
    rows = [(f"k{i}", f"Title {i}", None, ["A. B", None], ["review"] if i % 2 else ["data_analysis"], None, [], ["Stan", "brms"] if i < 3 else ["stan"], "full", "synthesis", 2000 + i if i % 3 else None, i / 10 if i % 4 else None, i, 10 if i else 0, _at(i)) for i in range(12)]
    return spark.createDataFrame(rows, REPORTS)


def test_search_facets_pages(spark):
    r = _reports(spark)
    assert archive.search(r, " TITLE 1").count() == 3 and archive.search(r, "", {"paper_type": ["review", "x"], "software": ["brms"]}).count() == 1 and archive.search(r, mode="none").count() == 0
    f = {(x.field, x.tag): (x.n, x.place) for x in archive.facets(r).collect()}
    assert f["software", "brms"] == (3, 1) and f["software", "Stan"] == (3, 2) and f["software", "stan"] == (9, 3)
    assert [x.report_key for x in archive.page(r, "score", 1, 3).orderBy("place").collect()] == ["k11", "k10", "k9"]
    assert [x.place for x in archive.page(r, "year", 2, 10).orderBy("place").collect()] == [11, 12]


def test_merge_keeps_what_is_left_out(spark):
    schema = "k string, title string, tags string, created_at timestamp, updated_at timestamp"
    old = spark.createDataFrame([("a", "A", "t", _at(0), _at(0)), ("b", "B", None, _at(0), _at(0))], schema)
    new = spark.createDataFrame([("a", None, None, _at(9), _at(9)), ("c", "C", None, _at(9), _at(9))], schema)
    got = {r.k: tuple(r)[1:] for r in archive.merge_reports(old, new, "k", authoritative=["tags"]).collect()}
    assert got == {"a": ("A", None, _at(0), _at(9)), "b": ("B", None, _at(0), _at(0)), "c": ("C", None, _at(9), _at(9))}


def test_replay_ends_at_terminal(spark):
    e = spark.createDataFrame([(j, i, t) for j in (1, 2) for i, t in enumerate(["x", "y", "done" if j == 1 else "z", "late"])], "job int, n int, event_type string")
    got = sorted((r.job, r.seq, r.event_type) for r in archive.replay(e, "job", ["n"], after=1).collect())
    assert got == [(1, 2, "y"), (1, 3, "done"), (2, 2, "y"), (2, 3, "z"), (2, 4, "late")]


def test_skewed_join_equals_plain_join(spark):
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(6000)] + [(None, -1)], "k int, v int")
    right = spark.createDataFrame([(k, k * 10) for k in range(0, 6000, 2)] + [(1, 11), (1, 12), (None, 5)], "k int, w int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        a, b = skew.skew_join(left, right, ["k"], how), left.join(right, ["k"], how)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    with pytest.raises(ValueError):
        skew.skew_join(left, right, ["k"], "full")


TEXT = "Intro line\n# Methods\nWe ran it.\nFigure 1. A plot\nMore text\nReferences\n[1] x\n# Not body\n[2] y\nAppendix A\nextra"


def test_sections(spark):
    got = [(r.section_id, r.kind, r.title, r.text) for r in sections.split_sections(spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "id int, text string"), "id").orderBy("section_pos").collect()]
    assert got == [("s01", "body", "", "Intro line"), ("s02", "body", "Methods", "We ran it.\nMore text"), ("s03", "caption", "", "Figure 1. A plot"), ("s04", "references", "References", "[1] x"), ("s05", "references", "Not body", "[2] y"), ("s06", "supplement", "Appendix A", "extra")]
    a = spark.createDataFrame([(1, 0, "body", "x")], "id int, section_pos int, kind string, text string")
    b = spark.createDataFrame([(1, 0, "body", "y"), (1, 1, "caption", "z")], a.schema)
    assert [(r.section_pos, r.kind) for r in sections.merge_supplements(a, b, "id").orderBy("section_pos").collect()] == [(0, "body"), (1, "supplement"), (2, "caption")]


def test_context_budget(spark):
    schema = "doc_key int, sections array<struct<kind:string,title:string,text:string>>"
    df = spark.createDataFrame([(1, [("body", "B", "b" * 50), ("abstract", "", "a" * 30), ("references", "R", "r"), ("supplement", "S", "s")]), (2, None), (3, [])], schema)
    got = {r.doc_key: r for r in context.contexts(df, 60, 1000).collect()}
    assert got[1].excerpt == "## abstract\n" + "a" * 30 + "\n\n" + ("## B\n" + "b" * 50)[:18] and got[1].assessment.endswith("## S\ns") and "r" * 1 not in got[1].assessment.split("## S")[1]
    assert got[2].excerpt == got[3].assessment == context.NOTHING


def test_screen_floor_and_gates(spark):
    ev = spark.createDataFrame([(1, 0, "software.stan", "software_mention", "Stan"), (1, 1, "method.prior", "method_mention", "uninformative prior"), (2, 0, "open.code", "open_science", "x"), (3, 0, "diag.loo_waic", "diagnostic_mention", "LOO")], "doc_key int, evidence_ref int, detector_id string, kind string, quote string")
    labels = spark.createDataFrame([(1, "no", None), (2, "yes", []), (3, "yes", None), (4, "no", None)], "doc_key int, label string, refs array<int>")
    got = {r.doc_key: (r.final, r.final_refs, r.repair) for r in screen.screen_floor(labels, ev).collect()}
    assert got == {1: ("partial", [0, 1], "raised"), 2: ("no", [], "downgraded"), 3: ("yes", [0], "refs attached"), 4: ("no", [], None)}
    g = {r.doc_key: (r.inference_method, r.n_models, r.prior_informativeness) for r in screen.gate_facts(ev).collect()}
    assert g[1] == ("unstated", 1, "informative") and g[3] == ("unstated", 2, "unstated")


def test_rating_rules(spark):
    schema = "rating_id long, work_id string, rater_id string, relationship string, relevance_label string, relevance_rationale string, source_sha256 string, paper_class_labels array<string>, gate_facts struct<n_models:int>, steps array<struct<step_id:string,applicable:boolean,status:string,confidence:double,evidence:array<struct<section_id:string,page:int,quote:string>>,rationale:string,missing_subtag:string>>, rated_at timestamp"
    step = lambda sid, app, status, **k: (sid, app, status, 0.5, k.get("evidence", []), k.get("rationale", "r"), k.get("tag"))
    rows = [
        (1, "w", "a", "independent", "yes", "x", "sha", ["review"], (1,), [step("S1", True, "N/A"), step("S2", True, "adequate"), step("S2", True, "missing", tag="t")], _at(1)), (2, "w", "b", "engine_dev", "no", " ", "sha", ["review"], None, [], _at(1)),
        (0, "w", "b", "engine_dev", "yes", "old", "sha", None, None, None, _at(0)), (3, "v", "c", "engine_dev", "yes", "x", None, None, None, None, _at(0)),
    ]
    cur = ratings.current_ratings(spark.createDataFrame(rows, schema))
    assert cur.count() == 3
    assert {(r.step_id, r.violation) for r in ratings.step_violations(ratings.step_rows(cur)).collect()} == {("S1", "applicable but not_applicable"), ("S2", "no evidence")}
    assert {(r.rater_id, r.violation) for r in ratings.form_violations(cur).collect()} == {("a", "repeated step"), ("b", "no rationale"), ("b", "no with classes"), ("c", "no class"), ("c", "no gate answers")}
    adm = {r.work_id: r.violations for r in ratings.admissibility(cur, spark.createDataFrame([("w",)], "work_id string")).collect()}
    assert adm["w"] == [] and adm["v"] == ["number of raters", "no independent rater", "all raters are developers", "no consensus", "no content hash"]


def test_files(spark, tmp_path):
    for name, data in (("a.pdf", b"%PDF-1.7 x"), ("b.pdf", b"%PDF-1.7 x"), ("c.txt", b"hello")):
        (tmp_path / name).write_bytes(data)
    blobs = files.read_blobs(spark, str(tmp_path))
    taken, rejects = files.ingest_uploads(blobs)
    assert blobs.count() == 2 and [r.version_label for r in taken.collect()] == ["uploaded PDF (a.pdf)"] and rejects.count() == 1
    log = tmp_path / "log.ndjson"
    log.write_text('{"a": 1, "b": "x"}\n\n{"a": 2}\n{"a": 3, "b"')
    good, torn = files.read_json_lines(spark, str(log), "a int, b string")
    assert sorted((r.a, r.b) for r in good.collect()) == [(1, "x"), (2, None)] and torn.count() == 1
    gold = tmp_path / "gold"
    gold.mkdir()
    (gold / "one.json").write_text(json.dumps({"k": 1}))
    (gold / "two.json").write_text("{broken")
    assert [(r.stem, r.k) for r in files.read_json_files(spark, str(gold), "k int").collect()] == [("one", 1)]
    rubric = tmp_path / "mine.yaml"
    rubric.write_text("steps:\n  - {id: S1, name: n, essential_for: [a], thresholds: {t: {value: '< 1', source: s, verified: true}}}\nscoring: {weights: {a: {S1: 0.5}}}\ncitations: {s: Some}\n")
    spec = files.read_rubric(spark, str(rubric))
    assert spec["weights"].first().weight == 0.5 and spec["tiers"].first().tier == "expected"
    asked = lambda *ids: files.resolve_standards(spark.createDataFrame([("d", "S1", ids)], "doc string, step_id string, ids array<string>"), spec["citations"], spec["thresholds"])
    assert [(r.pos, r.source_id, r.verified) for r in asked("s").collect()] == [(0, "s", True)]
    with pytest.raises(Exception, match="unknown standard: zz"):
        asked("s", "zz").collect()
    files.save_event(spark.createDataFrame([("start", 1)], "event string, n int"), str(tmp_path / "events"))
    files.write_atomic(spark.range(3), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "events")).first().created_at is not None and files.read_current(spark, str(tmp_path / "t")).count() == 3
    with pytest.raises(Exception, match="no engine result"):
        files.pinned(spark.createDataFrame([("x",)], "source_sha256 string"), spark.createDataFrame([], "source_sha256 string")).collect()


def test_providers(spark):
    html = '<meta name="citation_title" content="A &amp; B"><meta name="citation_author" content="X"><meta property="citation_author" content="Y"><meta name="citation_title" content="no"><meta name="citation_doi" content="10.1/x"'
    row = spark.createDataFrame([(html,), (None,)], "h string").select(providers.citation_meta("h").alias("m")).collect()
    assert (row[0].m.title, row[0].m.authors) == ("A & B", ["X", "Y"]) and row[1].m.title is None
    p = '{"title": null, "display_name": "D", "doi": "https://doi.org/10.1/X", "publication_year": 2020, "authorships": [{"author": {"display_name": "N"}}], "best_oa_location": {"pdf_url": "u"}}'
    o = spark.createDataFrame([(p,)], "p string").select(providers.openalex_record(F.col("p")).alias("o")).first().o
    assert (o.title, o.authors, o.year, o.doi, o.pdf_url) == ("D", ["N"], 2020, "10.1/x", "u")
    req = spark.createDataFrame([("a",), ("b",), ("c",)], "identifier string")
    one, two = spark.createDataFrame([("a", "1")], "identifier string, pdf_url string"), spark.createDataFrame([("a", "2"), ("b", "2")], "identifier string, pdf_url string")
    assert {r.identifier: (r.origin, r.pdf_url) for r in providers.resolve_copies(req, x=one, y=two).collect()} == {"a": ("x", "1"), "b": ("y", "2"), "c": (None, None)}
    works = spark.createDataFrame([("10.1/z", ["s00", "other"])], "doi string, alternative_ids array<string>")
    assert providers.pii_to_doi(spark.createDataFrame([("S00",)], "pii string"), works).first().doi == "10.1/z"


@pytest.mark.parametrize("at", [None, "at"])
def test_stream_numbers_like_the_batch(spark, tmp_path, at):
    rows = [(f"j{i % 3}", i, "done" if i == 10 else "status", "s", "x", None, _at(0)) for i in range(18)]
    schema = "job_id string, event_no long, type string, stage string, state string, reason string, at timestamp"
    for k in range(3):
        spark.createDataFrame(rows[k * 6 : k * 6 + 6], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"numbered_{at}"
    q = events.number_events(stream, at).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    got = sorted((r.job_id, r.seq, r.type) for r in spark.table(name).collect())
    batch = archive.replay(spark.createDataFrame(rows, schema), "job_id", ["event_no"], kind="type")
    assert got == sorted((r.job_id, r.seq, r.type) for r in batch.collect()) and len(got) == 16
    assert events.replay_from(spark.table(name), 2).count() == sum(s > 2 for _, s, _ in got)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_null_keys_are_spread(spark, how):
    left = spark.range(9000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 400).alias("k"), "id")
    right = spark.range(300).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).unionByName(spark.createDataFrame([(None, 1)], "k long, v long"))
    a = skew.skew_join(left, right, ["k"], how)
    assert "_salt" in a._jdf.queryExecution().toString()
    assert sorted(map(str, a.collect())) == sorted(map(str, left.join(right, ["k"], how).collect()))


def test_praise_and_facts_without_support(spark):
    praise = spark.createDataFrame([("good, see p. 3",), ("good “as said”",), ("well done",), ("Table 2 shows",)], "text string")
    assert [r.text for r in scoring.uncited_praise(praise).collect()] == ["well done"]
    facts = spark.createDataFrame([("d", 1, "four  chains"), ("d", 2, "nowhere"), ("d", 3, " "), ("d", 4, None), ("e", 1, "four chains")], "doc_key string, fact_id int, quote string")
    evidence = spark.createDataFrame([("d", 5, "We ran four chains."), ("d", 2, "chains: four chains"), ("d", 9, None)], "doc_key string, evidence_ref int, quote string")
    assert [tuple(r) for r in screen.facts_with_evidence(facts, evidence).collect()] == [("d", 1, 2)]


def test_stream_replay_forgets_old_numbers(spark, tmp_path):
    schema = "job_id string, seq long, at timestamp"
    spark.createDataFrame([("j", k % 4, _at(0)) for k in range(8)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError, match="time column"):
        events.replay_from(stream, 0)
    q = events.replay_from(stream, 0, at="at").writeStream.format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(90) and sorted(r.seq for r in spark.table("replayed").collect()) == [1, 2, 3]
