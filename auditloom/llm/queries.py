"""Queries of the problems tagged llm, and their SQL where SQL can express them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm import canonical_values, consensus_labels, contamination, mojibake, name_variants, packing, splitting, unify_text


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_items(spark: SparkSession, d: str) -> DataFrame:
    return consensus_labels.fit_consensus(_read(spark, d, "ratings")).items


def p1_raters(spark: SparkSession, d: str) -> DataFrame:
    return consensus_labels.fit_consensus(_read(spark, d, "ratings")).raters


def p1_agreement(spark: SparkSession, d: str) -> DataFrame:
    """What SQL can say of the items too: votes, different labels and the share of agreeing pairs of votes."""
    return p1_items(spark, d).select("work_id", "step_id", "n_votes", "n_labels", F.round("agreement", 9).alias("agreement"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_items(spark, d).filter("n_labels > 1").select("work_id", "step_id", "label")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    sections = unify_text.explode_sections(_read(spark, d, "parsed_docs"))
    return splitting.split_long_texts(sections, "text").distinct()


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    """The text put together again from the pieces of each cut section, with whether size and overlap are as they should be."""
    pieces = p2_pieces(spark, d).withColumn("core", F.expr("substring(piece, overlap_chars + 1)"))
    listed = F.array_sort(F.collect_list(F.struct("piece_pos", "core", "piece", "overlap_chars")))
    whole = pieces.groupBy("doc_key", "section_pos", "section_id", F.lit(0).alias("_")).agg(listed.alias("p"))
    repeats = lambda i: (F.col("p")[i]["overlap_chars"].between(75, 150)) & F.endswith(F.col("p")[i - 1]["piece"], F.left(F.col("p")[i]["piece"], F.col("p")[i]["overlap_chars"]))
    places = F.sequence(F.lit(1), F.size("p") - 1)
    return whole.select(
        "doc_key", "section_pos", "section_id", F.md5(F.array_join(F.transform("p", lambda x: x["core"]), "")).alias("text_md5"),
        F.forall("p", lambda x: F.length(x["piece"]) <= 2000).alias("in_limit"), F.forall(places, repeats).alias("overlapping"),
    ).distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Sections that the splitter cut; a piece beyond the limit is an error, not a missing row."""
    sections = unify_text.explode_sections(_read(spark, d, "parsed_docs"))
    cut = splitting.split_long_texts(sections, "text").groupBy("doc_key", "section_pos", "section_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("piece")).alias("longest"))
    checked = F.when(F.col("longest") <= 2000, F.col("section_id")).otherwise(F.raise_error(F.lit("a piece is longer than the limit")))
    return cut.filter("n > 1").select("doc_key", checked.alias("section_id")).distinct()


def p3_mapped(spark: SparkSession, d: str) -> DataFrame:
    return canonical_values.map_software(_read(spark, d, "screen_cases"), _read(spark, d, "goldset"), _read(spark, d, "software_catalog"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_mapped(spark, d).select("src", "row_key", "pos", "software_id").distinct()


def p4_linked(spark: SparkSession, d: str) -> DataFrame:
    return name_variants.link_variants(_read(spark, d, "archived_papers"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return name_variants.variant_pairs(name_variants.name_entities(_read(spark, d, "archived_papers")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return unify_text.hidden_quotes(_read(spark, d, "evidence"), _read(spark, d, "parsed_docs")).select("evidence_id").distinct()


def p6_unified(spark: SparkSession, d: str) -> DataFrame:
    """Every quote and every section in its one form: src, row_key (evidence_id, doc_key), section_id, text."""
    quotes = _read(spark, d, "evidence").select(F.lit("evidence").alias("src"), F.col("evidence_id").alias("row_key"), "span.section_id", F.col("span.quote").alias("text"))
    sections = unify_text.explode_sections(_read(spark, d, "parsed_docs")).select(F.lit("section").alias("src"), F.col("doc_key").alias("row_key"), "section_id", "text")
    stored = quotes.unionByName(sections).filter(F.col("text").isNotNull())
    return unify_text.unify_text(stored, "text", "text").distinct()


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(_read(spark, d, "documents"))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return contamination.find_leaks(_read(spark, d, "documents"), _read(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id").distinct()


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    """The documents without leaks."""
    documents = _read(spark, d, "documents")
    return contamination.remove_leaking(documents, contamination.find_leaks(documents, _read(spark, d, "eval_items")))


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.repair_encoding(_read(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_restored(spark, d).select("doc_id").distinct()


def queries() -> dict:
    return {f.__name__: f for f in (p1_items, p1_raters, p1_agreement, p1_found, p2_pieces, p2_restored, p2_found, p3_mapped, p3_found, p4_linked, p4_found, p6_found, p6_unified, p7_containers, p8_leaks, p8_found, p8_kept, p9_restored, p9_found)}


def _unified_sql(skeleton: bool) -> str:
    """form(t, o): every text with its one form, character by character from a table of replacements; another way than the operator's statement."""
    plane = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)
    in_class = lambda pattern: re.findall(re.sub(r"\\x\{(\w+)\}", r"\\u\1", pattern), plane)
    first = {c: "" for c in in_class(unify_text.INVISIBLE)} | {c: " " for c in in_class(unify_text.SPACES)} | {c: "-" for c in in_class(unify_text.HYPHENS)} | unify_text.compatibility_map() | unify_text.LIGATURES
    rows = lambda table: ", ".join(f"({ord(c)}, {unify_text._quoted(x)})" for c, x in table.items())
    spell = lambda src, table, keep: f"SELECT t, string_agg(CASE WHEN {keep} THEN coalesce(r.x, c) ELSE c END, '' ORDER BY i) AS o FROM {src} LEFT JOIN {table} r ON r.k = unicode(c) GROUP BY t"
    # a word is a stretch of letters, marks and digits; its look-alikes change if it holds a Latin letter
    turn = "sum(CASE WHEN w <> before THEN 1 ELSE 0 END) OVER (PARTITION BY t ORDER BY i)"
    return f"""first(k, x) AS (VALUES {rows(first)}), alike(k, x) AS (VALUES {rows(unify_text.LOOKALIKES)}),
        odd AS (SELECT DISTINCT t FROM texts WHERE strlen(t) > length(t)),
        one AS (SELECT t, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM odd),
        plain AS (SELECT t, nfc_normalize(o) AS n FROM ({spell("one", "first", "true")})),
        two AS (SELECT t, unnest(string_split(n, '')) AS c, generate_subscripts(string_split(n, ''), 1) AS i FROM plain WHERE n <> ''),
        sides AS (SELECT *, regexp_matches(c, '[\\p{{L}}\\p{{M}}\\p{{N}}]') AS w FROM two),
        turns AS (SELECT *, {turn} AS word FROM (SELECT *, lag(w, 1, NOT w) OVER (PARTITION BY t ORDER BY i) AS before FROM sides)),
        latin AS (SELECT *, bool_or(regexp_matches(c, '[A-Za-zÀ-ɏ]')) OVER (PARTITION BY t, word) AS mixed FROM turns),
        form AS (SELECT DISTINCT t, t AS o FROM texts WHERE strlen(t) = length(t) UNION ALL {spell("latin", "alike", "true" if skeleton else "mixed")}
            UNION ALL SELECT t, '' FROM plain WHERE n = '')"""


def _p6_sql() -> str:
    return f"""WITH q AS (SELECT DISTINCT evidence_id, doc_key, span.section_id AS sid, span.quote AS t FROM evidence WHERE span.quote IS NOT NULL AND span.section_id IS NOT NULL),
        s AS (SELECT DISTINCT doc_key, s.id AS sid, s.text AS t FROM (SELECT doc_key, unnest(sections) AS s FROM parsed_docs) WHERE s.text IS NOT NULL),
        texts AS (SELECT t FROM q UNION ALL SELECT t FROM s), {_unified_sql(True)}
        SELECT evidence_id FROM q JOIN s USING (doc_key, sid) JOIN form f ON f.t = q.t JOIN form g ON g.t = s.t WHERE trim(f.o) <> '' AND contains(g.o, f.o)
        GROUP BY evidence_id, doc_key, sid, q.t HAVING NOT bool_or(contains(s.t, q.t))"""


def _p1_sql() -> str:
    plain = lambda x: f"(CASE regexp_replace(trim(lower({x})), '[\\s_-]+', '_', 'g') " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in consensus_labels.ALIASES.items()) + f" ELSE regexp_replace(trim(lower({x})), '[\\s_-]+', '_', 'g') END)"
    return f"""WITH last AS (SELECT * FROM ratings WHERE work_id IS NOT NULL AND rater_id IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY work_id, rater_id ORDER BY coalesce(rated_at, TIMESTAMP '0001-01-01') DESC, rating_id DESC) = 1),
        rows AS (SELECT work_id, rater_id, i, steps[i].step_id AS step_id, {plain("steps[i].status")} AS label FROM (SELECT *, unnest(range(1, len(steps) + 1)) AS i FROM last)
            WHERE {plain("steps[i].status")} IN {consensus_labels.STATUS} AND steps[i].step_id IS NOT NULL
            UNION ALL SELECT work_id, rater_id, 0, 'relevance', {plain("relevance_label")} FROM last WHERE {plain("relevance_label")} IN {consensus_labels.RELEVANCE}),
        votes AS (SELECT work_id, step_id, arg_max(label, i) AS label FROM rows GROUP BY work_id, step_id, rater_id),
        tally AS (SELECT work_id, step_id, label, count(*) AS n FROM votes GROUP BY ALL)
        SELECT work_id, step_id, sum(n)::BIGINT AS n_votes, count(*)::INT AS n_labels, round(sum(n * (n - 1)) / nullif(sum(n) * (sum(n) - 1), 0), 9) AS agreement FROM tally GROUP BY work_id, step_id"""


def oracle_sql() -> dict[str, str]:
    sections = "(SELECT doc_key, i - 1 AS section_pos, sections[i] AS s FROM (SELECT doc_key, sections, unnest(range(1, len(sections) + 1)) AS i FROM parsed_docs))"
    return {
        "p1_agreement": _p1_sql(),
        "p6_found": _p6_sql(),
        "p6_unified": f"""WITH stored AS (SELECT 'evidence' AS src, evidence_id AS row_key, span.section_id AS section_id, span.quote AS t FROM evidence
                UNION ALL SELECT 'section', doc_key, s.id, s.text FROM {sections}),
            texts AS (SELECT t FROM stored WHERE t IS NOT NULL), {_unified_sql(False)} SELECT DISTINCT src, row_key, section_id, o AS text FROM stored JOIN form USING (t)""",
        "p2_found": "SELECT DISTINCT doc_key, s.id AS section_id FROM (SELECT doc_key, unnest(sections) AS s FROM parsed_docs) WHERE length(s.text) > 2000",
        "p2_restored": f"SELECT DISTINCT doc_key, section_pos::INT AS section_pos, s.id AS section_id, md5(s.text) AS text_md5, true AS in_limit, true AS overlapping FROM {sections} WHERE length(s.text) > 2000",
    }
