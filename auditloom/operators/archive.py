"""The archive of reports: search, facets, sorting, pages, merge and lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TAG_FIELDS = ("paper_type", "discipline", "methods", "software")


def current_reports(reports: DataFrame, key: str = "report_key", at: str = "updated_at") -> DataFrame:
    """The latest version of each report; equal times are decided by the whole row, so the result doesn't depend on order."""
    rest = [c for c in reports.columns if c != key]
    newest = reports.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, F.to_json(F.struct(*rest)))).alias("r"))
    return newest.select(key, *[F.col("r")[c].alias(c) for c in rest])


def latest_by(rows: DataFrame, keys: Sequence[str], at: Sequence[str]) -> DataFrame:
    """The last row of each key by ``at``."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*at)).alias("r")).select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def search(reports: DataFrame, text: str = "", tags: dict[str, Sequence[str]] | None = None, mode: str | None = None, rubric: str | None = None) -> DataFrame:
    """Free text in title, authors and tags, any of the values within a tag field, all fields together; mode and rubric exact."""
    out = reports
    if text.strip():
        hay = F.lower(F.concat_ws(" ", "paper_title", "identifier", F.array_join("paper_authors", " "), *[F.array_join(f, " ") for f in TAG_FIELDS]))
        out = out.filter(F.contains(hay, F.lit(text.strip().lower())))
    for field, values in (tags or {}).items():
        if values:
            out = out.filter(F.arrays_overlap(field, F.array(*map(F.lit, values))))
    if mode:
        out = out.filter(F.col("run_mode") == mode)
    return out.filter(F.col("rubric_profile") == rubric) if rubric else out


def facets(reports: DataFrame, fields: Sequence[str] = TAG_FIELDS) -> DataFrame:
    """field, tag, n over all reports, and the tag's place in the order without letter case."""
    def of(field: str) -> Column:
        return F.transform(F.coalesce(field, F.array().cast("array<string>")), lambda x: F.struct(F.lit(field).alias("field"), x.alias("tag")))

    pairs = F.flatten(F.array(*[of(f) for f in fields]))
    counts = reports.select(F.explode(pairs).alias("p")).select("p.*").filter("tag IS NOT NULL").groupBy("field", "tag").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("field").orderBy(F.lower("tag"), "tag")))


def sort_key(name: str) -> list[Column]:
    """recent, year, score or coverage: large first, nulls last, ties by key."""
    column = {"recent": F.col("updated_at"), "year": F.col("paper_year"), "score": F.col("quality_score"), "coverage": F.col("coverage_present") / F.nullif(F.col("coverage_applicable"), F.lit(0))}[name]
    return [column.desc_nulls_last(), F.col("report_key")]


def page(reports: DataFrame, sort: str = "recent", number: int = 1, size: int = 10) -> DataFrame:
    """One page of the sorted reports with each row's place; the limit is the feature."""
    ordered = reports.orderBy(*sort_key(sort)).offset((number - 1) * size).limit(size)
    return ordered.withColumn("place", F.row_number().over(Window.orderBy(*sort_key(sort))) + (number - 1) * size)


def top_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, newest: int | None = None) -> DataFrame:
    """The ``k`` first rows of each key, out of the ``newest`` rows of all if given; both limits are the feature."""
    pool = rows.orderBy(*order).limit(newest) if newest else rows
    return pool.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def merge_reports(old: DataFrame, new: DataFrame, key: str, authoritative: Sequence[str] = (), created: str = "created_at", updated: str = "updated_at") -> DataFrame:
    """Upsert that keeps what the new row leaves out: a new value replaces, a null one doesn't, except for ``authoritative`` columns.

    ``created`` stays as it was first; ``updated`` is the new row's. Rows only in one of the two tables stay as they are.
    """
    o, n = old.alias("o"), new.alias("n").withColumn("_new", F.lit(True))
    j = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    has = F.col("_new").isNotNull()
    out = [F.coalesce(F.col(f"n.{key}"), F.col(f"o.{key}")).alias(key)]
    for c in old.columns:
        if c == key:
            continue
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        out.append((F.coalesce(a, b) if c == created else F.when(has, b).otherwise(a) if c in authoritative or c == updated else F.coalesce(b, a)).alias(c))
    return j.select(*out)


def replayable(reports: DataFrame, mode: str, versions: dict[str, str]) -> DataFrame:
    """Stored reports that may be shown again: same mode and versions, graded, with a score."""
    same = F.col("run_mode") == mode
    for c, v in versions.items():
        same = same & (F.col(c) == v)
    return reports.filter(same & F.col("quality_score").isNotNull() & (F.col("coverage_applicable") > 0))


def first_of(*sources: tuple[str, Column]) -> Column:
    """The first source with a value as struct(origin, value), for chains of providers."""
    return F.coalesce(*[F.when(c.isNotNull() & (c != ""), F.struct(F.lit(name).alias("origin"), c.alias("value"))) for name, c in sources])


def replay(events: DataFrame, key: str, at: Sequence[str], after: int = 0, terminal: Sequence[str] = ("done", "failed"), kind: str = "event_type") -> DataFrame:
    """Each key's events in order with their number from 1; those up to ``after`` are left out, and so is all after the first terminal one."""
    w = Window.partitionBy(key).orderBy(*at)
    numbered = events.withColumn("seq", F.row_number().over(w))
    ended = F.max(F.when(F.col(kind).isin(*terminal), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return numbered.withColumn("_e", F.coalesce(ended, F.lit(0))).filter((F.col("_e") == 0) & (F.col("seq") > after)).drop("_e")
