"""Queries of detection and inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators import detect


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/parsed_docs.parquet")


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of all documents; of repeated documents one row is taken whole, before anything is detected."""
    return detect.run_detectors(_docs(spark, d).select("doc_key", "sections").dropDuplicates(["doc_key"]))


def detect_hits(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).select("doc_key", "section_id", "detector_id", F.lower("matched").alias("matched")).distinct()


def detect_value_extraction(spark: SparkSession, d: str) -> DataFrame:
    h = _hits(spark, d).filter("value IS NOT NULL")
    return h.groupBy("detector_id", F.col("value.op").alias("op")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value.value"), 6).alias("sum_value"), F.sum("value.count").alias("sum_count"))


def sentence_quotes(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).select("doc_key", "evidence_ref", "section_id", "page", "detector_id", "kind", "value", "quote")


def inventory_found(spark: SparkSession, d: str) -> DataFrame:
    return detect.inventory_found(_hits(spark, d))


def inventory_not_detected(spark: SparkSession, d: str) -> DataFrame:
    return detect.inventory_not_detected(_docs(spark, d), _hits(spark, d))


def inventory_where_looked(spark: SparkSession, d: str) -> DataFrame:
    return detect.inventory_where_looked(_docs(spark, d))


def evidence_catalog_join(spark: SparkSession, d: str) -> DataFrame:
    """Recorded evidence by family, with the default for detectors outside the catalog."""
    e = spark.read.parquet(f"{d}/evidence.parquet").dropDuplicates(["evidence_id"])
    table = F.broadcast(detect.catalog_table(spark).select("detector_id", "family"))
    return e.join(table, "detector_id", "left").groupBy(F.coalesce("family", F.lit("other")).alias("family"), "kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("detector_id").alias("n_detectors"))


QUERIES = (detect_hits, detect_value_extraction, sentence_quotes, inventory_found, inventory_not_detected, inventory_where_looked, evidence_catalog_join)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


SPACE = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _unicode(pattern: str) -> str:
    """The pattern with Python's meaning of digits and white space, which RE2 limits to ASCII."""
    parts = pattern.split(r"[-\s]")
    return f"[-{SPACE}]".join(x.replace(r"\s", f"[{SPACE}]") for x in parts).replace(r"\d", r"\p{Nd}")


def oracle_sql() -> dict[str, str]:
    text = lambda s: "'" + s.replace("'", "''") + "'"
    catalog = ", ".join(f"({i}, {text(d.id)}, {text(d.family)}, {text(d.measure)}, {d.op}, {d.num})" for i, d in enumerate(detect.CATALOG))
    scans = " UNION ALL ".join(f"SELECT doc_key, section_pos, section_id, {i} AS o, unnest(regexp_extract_all(text, {text(_unicode(d.pattern))})) AS m FROM secs WHERE text <> '' AND kind <> 'references'" for i, d in enumerate(detect.CATALOG))
    secs = "secs AS (SELECT DISTINCT doc_key, i - 1 AS section_pos, s.id AS section_id, s.kind AS kind, s.title AS title, s.text AS text, s.page_spans[1].page_start AS page FROM (SELECT doc_key, unnest(sections) AS s, generate_subscripts(sections, 1) AS i FROM parsed_docs))"
    base = f"WITH cat(o, detector_id, family, measure, g_op, g_num) AS (VALUES {catalog}), {secs}, raw AS ({scans})"
    op = " ".join(f"WHEN {i} THEN nullif(regexp_extract(m, {text(_unicode(d.pattern))}, {d.op}), '')" for i, d in enumerate(detect.CATALOG) if d.op)
    num = " ".join(f"WHEN {i} THEN nullif(translate(regexp_extract(m, {text(_unicode(d.pattern))}, {d.num}), '０１２３４５６７８９,', '0123456789'), '')" for i, d in enumerate(detect.CATALOG) if d.num)
    hits = f"{base}, vals AS (SELECT raw.*, CASE o {op} END AS op, CASE o {num} END AS num FROM raw), hits AS (SELECT DISTINCT doc_key, section_pos, section_id, o, lower(m) AS matched, num, CASE WHEN num IS NULL OR measure <> 'threshold' THEN NULL ELSE coalesce(op, '=') END AS op FROM vals JOIN cat USING (o))"
    # the same match with another spelling of its value can't occur, so distinct rows are the deduplicated hits
    return {
        "detect_hits": f"{hits} SELECT DISTINCT doc_key, section_id, detector_id, matched FROM hits JOIN cat USING (o)",
        "detect_value_extraction": f"{hits} SELECT detector_id, h.op, count(*) AS n, round(sum(CASE WHEN measure = 'threshold' THEN num::DOUBLE END), 6) AS sum_value, sum(CASE WHEN measure = 'count' THEN num::BIGINT WHEN measure = 'none_or_count' THEN CASE WHEN lower(num) IN ('no', 'zero') THEN 0 ELSE num::BIGINT END END)::BIGINT AS sum_count FROM hits h JOIN cat USING (o) WHERE num IS NOT NULL GROUP BY detector_id, h.op",
        "inventory_found": f"{hits} SELECT doc_key, family, count(*) AS n_hits, count(DISTINCT detector_id) AS n_detectors FROM hits JOIN cat USING (o) GROUP BY ALL",
        "inventory_not_detected": f"{hits} SELECT d.doc_key, family, detector_id FROM (SELECT DISTINCT doc_key FROM parsed_docs) d CROSS JOIN cat WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.doc_key = d.doc_key AND h.o = cat.o)",
        "inventory_where_looked": f"WITH {secs} SELECT DISTINCT doc_key, section_id, kind, title, page, coalesce(kind, '') <> 'references' AS scanned FROM secs",
        "evidence_catalog_join": f"WITH cat(o, detector_id, family, measure, g_op, g_num) AS (VALUES {catalog}) SELECT coalesce(family, 'other') AS family, kind, count(*) AS n, count(DISTINCT e.detector_id) AS n_detectors FROM (SELECT DISTINCT evidence_id, detector_id, kind FROM evidence) e LEFT JOIN cat USING (detector_id) GROUP BY ALL",
    }
