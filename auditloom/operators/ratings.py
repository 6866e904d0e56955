"""Blind ratings: the current form of each rater, its steps as rows, and the rules a form must keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("missing", "partial", "adequate")
DEVELOPERS = ("prompt_author", "engine_dev")


def status_of(c: Column) -> Column:
    """A status or label as typed, in its plain form: lower case, with underscores; n/a is not_applicable; blank is null."""
    s = F.nullif(F.regexp_replace(F.trim(F.lower(c)), r"[\s-]+", "_"), F.lit(""))
    return F.when(s.isin("n/a", "na"), "not_applicable").otherwise(s)


def current_ratings(ratings: DataFrame) -> DataFrame:
    """Of several forms of one rater for one work the latest; equal times are decided by the larger rating_id. Repeated rows count once."""
    rest = [c for c in ratings.columns if c not in ("work_id", "rater_id")]
    newest = ratings.groupBy("work_id", "rater_id").agg(F.max_by(F.struct(*rest), F.struct("rated_at", "rating_id")).alias("r"))
    return newest.select("work_id", "rater_id", *[F.col("r")[c].alias(c) for c in rest])


def graded_forms(ratings: DataFrame, *columns: str) -> DataFrame:
    """The current forms with nothing but the steps' grades and the named ``columns``; evidence and rationales never reach the shuffle."""
    grades = F.transform("steps", lambda s: F.struct(s["step_id"].alias("step_id"), s["applicable"].alias("applicable"), s["status"].alias("status"), s["confidence"].alias("confidence")))
    return current_ratings(ratings.select("work_id", "rater_id", "rated_at", "rating_id", grades.alias("steps"), *columns))


def graded_steps(forms: DataFrame) -> DataFrame:
    """One row per step of the current forms: work_id, rater_id, step_id, applicable, status, confidence."""
    s = F.col("s")
    return forms.select("work_id", "rater_id", F.explode("steps").alias("s")).select("work_id", "rater_id", s["step_id"].alias("step_id"), s["applicable"].alias("applicable"), status_of(s["status"]).alias("status"), s["confidence"].alias("confidence"))


def step_rows(current: DataFrame) -> DataFrame:
    """One row per rated step: work_id, rater_id, relationship, step_id, applicable, status, confidence, n_evidence, rationale, missing_subtag, evidence."""
    s = F.col("s")
    rows = current.select("work_id", "rater_id", "relationship", F.explode("steps").alias("s"))
    return rows.select("work_id", "rater_id", "relationship", s["step_id"].alias("step_id"), s["applicable"].alias("applicable"), status_of(s["status"]).alias("status"), s["confidence"].alias("confidence"), F.size(F.coalesce(s["evidence"], F.array().cast(s_type(current)))).alias("n_evidence"), s["rationale"].alias("rationale"), s["missing_subtag"].alias("missing_subtag"), s["evidence"].alias("evidence"))


def s_type(current: DataFrame) -> str:
    return current.schema["steps"].dataType.elementType["evidence"].dataType.simpleString()


def step_violations(steps: DataFrame) -> DataFrame:
    """Steps that break a rule, one row per broken rule."""
    na = F.col("status") == "not_applicable"
    rule = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), F.lit(name))
    broken = F.array_compact(F.array(
        rule(na & F.col("applicable"), "applicable but not_applicable"),
        rule(~na & ~F.col("applicable"), "not applicable but graded"),
        rule(F.col("missing_subtag").isNotNull() & (F.col("status") != "missing"), "subtag without missing"),
        rule(~na & (F.trim(F.coalesce("rationale", F.lit(""))) == ""), "no rationale"),
        rule(F.col("status").isin("adequate", "partial") & (F.col("n_evidence") == 0), "no evidence"),
    ))
    return steps.select("work_id", "rater_id", "step_id", F.explode(broken).alias("violation"))


def form_violations(current: DataFrame) -> DataFrame:
    """Forms that break a rule: a "no" must be short, another label needs classes and gate answers, nothing may repeat."""
    label = status_of(F.col("relevance_label"))
    no = label == "no"
    n_classes, n_steps = F.coalesce(F.size("paper_class_labels"), F.lit(0)), F.coalesce(F.size("steps"), F.lit(0))
    ids = F.transform("steps", lambda s: s["step_id"])
    rule = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), F.lit(name))
    broken = F.array_compact(F.array(
        rule(F.trim(F.coalesce("relevance_rationale", F.lit(""))) == "", "no rationale"),
        rule(n_classes != F.size(F.array_distinct("paper_class_labels")), "repeated class"),
        rule(no & (n_steps > 0), "no with steps"),
        rule(no & (n_classes > 0), "no with classes"),
        rule(no & F.col("gate_facts").isNotNull(), "no with gate answers"),
        rule(~no & (n_classes < 1), "no class"),
        rule(~no & F.col("gate_facts").isNull(), "no gate answers"),
        rule(n_steps != F.size(F.array_distinct(ids)), "repeated step"),
    ))
    return current.select("work_id", "rater_id", F.explode(broken).alias("violation"))


def admissibility(current: DataFrame, consensus: DataFrame, least: int = 2, most: int = 3) -> DataFrame:
    """Why a work's ratings can't be a gold record: work_id, n_raters, violations (empty when admissible). ``consensus``: works with a consensus."""
    dev = F.col("relationship").isin(*DEVELOPERS)
    works = current.groupBy("work_id").agg(
        F.count(F.lit(1)).alias("n_raters"), F.max((F.col("relationship") == "independent").cast("int")).alias("independent"),
        F.min(F.coalesce(dev, F.lit(False)).cast("int")).alias("all_dev"), F.max(F.coalesce("source_sha256", F.lit(""))).alias("sha"),
    )
    has = consensus.select("work_id", F.lit(True).alias("has")).distinct()
    rule = lambda cond, name: F.when(cond, F.lit(name))
    rules = F.array_compact(F.array(
        rule(~F.col("n_raters").between(least, most), "number of raters"),
        rule(F.coalesce("independent", F.lit(0)) == 0, "no independent rater"),
        rule(F.col("all_dev") == 1, "all raters are developers"),
        rule(F.col("has").isNull(), "no consensus"),
        rule(F.col("sha") == "", "no content hash"),
    ))
    return works.join(has, "work_id", "left").select("work_id", "n_raters", rules.alias("violations"))


def incomplete_forms(current: DataFrame, step_ids: list[str]) -> DataFrame:
    """Missing and unknown steps of each form against the rubric's list."""
    want, have = F.array(*map(F.lit, step_ids)), F.transform("steps", lambda s: s["step_id"])
    out = current.select("work_id", "rater_id", F.array_except(want, have).alias("missing"), F.array_except(have, want).alias("extra"))
    return out.filter((F.size("missing") > 0) | (F.size("extra") > 0))
