"""Queries of the nested report records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators.nested_json import FIELDS, flatten_reports, table_of


def _records(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/report_records.parquet")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    flat = flatten_reports(_records(spark, d)).filter(F.col("tbl").isin("evidence", "suggestion"))
    return flat.select("record_id", "rating_pos", "step_pos", F.col("tbl").alias("child"), "child_pos").distinct()


def _table(tbl: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return table_of(flatten_reports(_records(spark, d)), tbl).distinct()

    return query


def queries() -> dict:
    return {"p5_found": p5_found} | {f"p5_{tbl}s": _table(tbl) for tbl in FIELDS}


_LISTED = lambda x: f"CASE json_type({x}) WHEN 'ARRAY' THEN from_json({x}, '[\"JSON\"]') WHEN 'OBJECT' THEN [{x}] END"
_TEXT = lambda x: f"CASE WHEN json_type({x}) = 'VARCHAR' THEN CASE WHEN json_valid({x} ->> '$') THEN ({x} ->> '$')::JSON END ELSE {x} END"


def _nodes() -> str:
    """Every object with its links, as DuckDB's JSON functions see it."""
    return f"""
    ok AS (SELECT DISTINCT record_id, payload::JSON AS j FROM report_records WHERE json_valid(payload)),
    plain AS (SELECT record_id, CASE WHEN json_type(j, '$.result') IS NOT NULL THEN {_TEXT("(j -> '$.result')")} ELSE j END AS j FROM (SELECT record_id, {_TEXT("j")} AS j FROM ok)),
    record AS (SELECT record_id, j AS x FROM plain WHERE json_type(j) = 'OBJECT'),
    rating AS (SELECT record_id, r.i::INT - 1 AS rating_pos, r.x FROM (SELECT record_id, {_TEXT("(x -> '$.ratings')")} AS rs FROM record) p,
        LATERAL (SELECT unnest({_LISTED("rs")}) AS x, generate_subscripts({_LISTED("rs")}, 1) AS i) r WHERE json_type(r.x) = 'OBJECT'),
    lists AS (SELECT record_id, -1 AS rating_pos, {_TEXT("(x -> '$.step_assessments')")} AS steps FROM record
        UNION ALL SELECT record_id, rating_pos, {_TEXT("(x -> '$.steps')")} FROM rating),
    step AS (SELECT * FROM (SELECT record_id, rating_pos, unnest({_LISTED("steps")}) AS x, generate_subscripts({_LISTED("steps")}, 1)::INT - 1 AS step_pos FROM lists) WHERE json_type(x) = 'OBJECT'),
    kids AS (SELECT record_id, rating_pos, step_pos, 'evidence' AS child, {_TEXT("(x -> '$.evidence')")} AS c FROM step
        UNION ALL SELECT record_id, rating_pos, step_pos, 'suggestion', {_TEXT("(x -> '$.suggestions')")} FROM step),
    each AS (SELECT * FROM (SELECT record_id, rating_pos, step_pos, child, unnest({_LISTED("c")}) AS x, generate_subscripts({_LISTED("c")}, 1)::INT - 1 AS child_pos FROM kids) WHERE json_type(x) = 'OBJECT'),
    evidence AS (SELECT * FROM each WHERE child = 'evidence'), suggestion AS (SELECT * FROM each WHERE child = 'suggestion')"""


def _table_sql(tbl: str) -> str:
    links = {"record": (), "rating": ("rating_pos",), "step": ("rating_pos", "step_pos")}.get(tbl, ("rating_pos", "step_pos", "child_pos"))
    field = lambda path: f"CASE WHEN json_type(x, '$.{path}') NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN x ->> '$.{path}' END"
    fields = [f"coalesce({field(f)}, {field('span.' + f)})" if tbl == "evidence" and f in ("section_id", "page", "quote") else field(f) for f in FIELDS[tbl]]
    return f"WITH {_nodes()} SELECT DISTINCT {', '.join(['record_id', *links, *(f'{x} AS {n}' for x, n in zip(fields, FIELDS[tbl]))])} FROM {tbl}"


def oracle_sql() -> dict[str, str]:
    return {"p5_found": f"WITH {_nodes()} SELECT DISTINCT record_id, rating_pos, step_pos, child, child_pos FROM each"} | {f"p5_{tbl}s": _table_sql(tbl) for tbl in FIELDS}
