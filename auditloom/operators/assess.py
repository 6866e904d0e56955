"""From recorded judgments to assessments: matching with what was asked, evidence, suggestions, gold records."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.functions.text import trim_to_sentence
from auditloom.operators.scoring import EASE, severity_of, upgrade_refuted


def clamp(c: Column) -> Column:
    """Into [0, 1]; null and not-a-number stay null."""
    return F.when(c.isNotNull() & ~F.isnan(c), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def reconcile(expected: DataFrame, judgments: DataFrame, keys: list[str]) -> DataFrame:
    """Judgments against what was asked: keys, state (ok, missing, extra, repeated). All but ok are errors of the judge."""
    e = expected.select(*keys).distinct().withColumn("_asked", F.lit(1))
    j = judgments.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    state = F.when(F.col("_n").isNull(), "missing").when(F.col("_asked").isNull(), "extra").when(F.col("_n") > 1, "repeated").otherwise("ok")
    return e.join(j, keys, "full_outer").select(*keys, state.alias("state"))


def with_verdicts(assessments: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Assessments with their verdict; without one nothing is refuted, verdicts on other steps are ignored."""
    return assessments.join(verdicts.select(*keys, "refuted", "proposed"), keys, "left").withColumn("refuted", F.coalesce("refuted", F.lit(False)))


def absence_records(assessments: DataFrame, searched: DataFrame) -> DataFrame:
    """For each missing step where was looked: doc, step_id, section_id (the first one), searched_sections. ``searched``: doc, section_pos, section_id."""
    where = searched.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("section_pos", "section_id"))).alias("s"))
    ids = F.transform("s", lambda x: x["section_id"])
    return assessments.filter("applicable AND status = 'missing'").join(where, "doc", "left").select("doc", "step_id", F.coalesce(F.try_element_at(ids, F.lit(1)), F.lit("s00")).alias("section_id"), F.coalesce(ids, F.array().cast("array<string>")).alias("searched_sections"))


def graded_suggestions(suggestions: DataFrame, tiers: DataFrame) -> DataFrame:
    """Suggestions with the severity that the step's expectation and status call for, and a known ease (medium by default)."""
    ease = F.lower(F.trim("ease"))
    j = suggestions.join(tiers.select("doc", "step_id", "tier"), ["doc", "step_id"], "left")
    return j.withColumn("severity", severity_of(F.coalesce("tier", F.lit("none")), F.col("status"))).withColumn("ease", F.when(ease.isin(*EASE), ease).otherwise("medium"))


SPAN = "struct<kind:string,section_id:string,page:int,quote:string>"


def distinct_spans(spans: Column) -> Column:
    """Each (section, quote) once, the first in order."""
    keys = F.transform(spans, lambda x: F.struct(x["section_id"].alias("s"), x["quote"].alias("q")))
    return F.filter(spans, lambda x, i: F.array_position(keys, F.struct(x["section_id"].alias("s"), x["quote"].alias("q"))) == i + 1)


def to_assessments(judgments: DataFrame, searched: DataFrame, tiers: DataFrame) -> DataFrame:
    """Judgments as assessments: doc, step_id, status, confidence, evidence, did_well, suggestions.

    ``judgments``: doc, step_id, status, confidence, evidence (array of SPAN), did_well (array<string>), suggestions
    (array<struct<text,how_to,ease>>). An unknown status is an error. Spans come out once each; a missing step gets a span
    of kind absence_search with the first of its document's ``searched`` sections (doc, section_pos, section_id). The
    confidence is clamped, blank praise dropped, severities go by tier (doc, step_id, tier) and status, an unknown ease is medium.
    """
    first = searched.groupBy("doc").agg(F.min(F.struct("section_pos", "section_id"))["section_id"].alias("_first"))
    j = judgments.join(first, "doc", "left").join(tiers.select("doc", "step_id", "tier"), ["doc", "step_id"], "left")
    status = F.when(F.col("status").isin("adequate", "partial", "missing"), F.col("status")).otherwise(F.raise_error(F.concat_ws(" ", F.col("step_id"), F.lit("has the invalid status"), F.coalesce("status", F.lit("null")))))
    spans = F.coalesce("evidence", F.array().cast(f"array<{SPAN}>"))
    absence = F.array(F.struct(F.lit("absence_search").alias("kind"), F.coalesce("_first", F.lit("s00")).alias("section_id"), F.lit(None).cast("int").alias("page"), F.lit("").alias("quote")))
    with_absence = F.when(F.col("status") == "missing", F.concat(distinct_spans(spans), absence)).otherwise(distinct_spans(spans))
    severity = severity_of(F.coalesce("tier", F.lit("none")), F.col("status"))
    ease = lambda x: F.when(F.lower(F.trim(x["ease"])).isin(*EASE), F.lower(F.trim(x["ease"]))).otherwise("medium")
    asked = F.transform(F.coalesce("suggestions", F.array().cast(judgments.schema["suggestions"].dataType)), lambda x: F.struct(severity.alias("severity"), x["text"].alias("text"), x["how_to"].alias("how_to"), ease(x).alias("ease")))
    return j.select("doc", "step_id", status.alias("status"), clamp(F.col("confidence").cast("double")).alias("confidence"), with_absence.alias("evidence"), F.filter("did_well", lambda x: F.trim(x) != "").alias("did_well"), asked.alias("suggestions"))


def apply_refutations(assessments: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Assessments after their verdicts: adds challenged, refuted and notes.

    ``verdicts``: doc, step_id, refuted, proposed, rescue (SPAN or null), notes; one each. A refuted status goes up at least
    one level, never down; the absence span goes, the rescuing quote comes in, and what became adequate loses its
    suggestions. Without a verdict an assessment stays as it is, unchallenged.
    """
    v = verdicts.select("doc", "step_id", "refuted", "proposed", "rescue", "notes", F.lit(True).alias("challenged"))
    j = assessments.join(v, ["doc", "step_id"], "left")
    refuted = F.coalesce("refuted", F.lit(False))
    status = upgrade_refuted(F.col("status"), refuted, F.col("proposed"))
    rescued = distinct_spans(F.concat(F.filter("evidence", lambda x: x["kind"] != "absence_search"), F.array_compact(F.array("rescue"))))
    keep = ~refuted | (status != "adequate")
    return j.select(
        "doc", "step_id", status.alias("status"), "confidence", F.when(refuted, rescued).otherwise(F.col("evidence")).alias("evidence"), "did_well",
        F.when(keep, F.col("suggestions")).otherwise(F.slice("suggestions", 1, 0)).alias("suggestions"), F.coalesce("challenged", F.lit(False)).alias("challenged"), refuted.alias("refuted"), trim_to_sentence(F.col("notes")).alias("notes"),
    )


def contract_violations(results: DataFrame) -> DataFrame:
    """What is wrong with results before they are scored, one row per rule: doc, violation.

    ``results``: doc, relevance, labels (array<string>), expected (array<struct<step_id,applicable>> of the applicability
    table), steps (array<struct<step_id,applicable,status>>).
    """
    ids = lambda c: F.transform(F.coalesce(c, F.array().cast(results.schema[c].dataType)), lambda x: x["step_id"])
    sides = lambda c: F.transform(c, lambda x: F.struct(x["step_id"].alias("s"), x["applicable"].alias("a")))
    rule = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), F.lit(name))
    have, want = ids("steps"), ids("expected")
    broken = F.array_compact(F.array(
        rule(F.col("relevance") == "no", "irrelevant"), rule(F.coalesce(F.size("labels"), F.lit(0)) < 1, "no class"), rule(F.size(have) == 0, "no steps"),
        rule(F.size(have) != F.size(F.array_distinct(have)), "repeated step"), rule(F.size(F.array_except(want, have)) > 0, "step left out"),
        rule(F.size(F.array_except(sides("steps"), sides("expected"))) > 0, "applicability differs"),
        rule(F.exists("steps", lambda x: x["applicable"] & (x["status"] == "not_applicable")), "applicable but not_applicable"),
    ))
    return results.select("doc", F.explode(broken).alias("violation"))


def rater_view(evidence: DataFrame) -> DataFrame:
    """Evidence as a blind rater may see it: without what a judge quoted and where it looked in vain."""
    return evidence.filter(~F.coalesce(F.col("kind").isin("absence_search", "judge_quote"), F.lit(False)))


def known_tokens(values: Column, known: tuple[str, ...]) -> Column:
    """The values that are in a vocabulary, once each, in order."""
    return F.array_intersect(values, F.array(*map(F.lit, known)))


def tags_or(own: Column, other: Column) -> Column:
    """The first list unless it is null or empty, else the second."""
    return F.when(F.coalesce(F.size(own), F.lit(0)) > 0, own).otherwise(other)


def step_rationale(praise: Column, suggestions: Column, most: int = 1200) -> Column:
    """Praise and suggestion texts of a step as one text of at most ``most`` characters."""
    none = F.array().cast("array<string>")
    return F.substring(F.array_join(F.concat(F.coalesce(praise, none), F.coalesce(suggestions, none)), " "), 1, most)


def call_costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls (model, tokens_in, tokens_out) with their cost from prices per million tokens (model, price_in, price_out); 0 for models without a price."""
    j = calls.join(prices.select("model", "price_in", "price_out"), "model", "left")
    cost = F.coalesce(F.col("tokens_in") * F.col("price_in") / 1e6 + F.col("tokens_out") * F.col("price_out") / 1e6, F.lit(0.0))
    return j.withColumn("cost", cost).drop("price_in", "price_out")


def assemble_gold(current: DataFrame, relevance: DataFrame, labels: DataFrame) -> DataFrame:
    """Which works get a gold record: work_id, n_raters, written, reason. A work needs a relevance and, unless that is "no", a class."""
    works = current.groupBy("work_id").agg(F.count(F.lit(1)).alias("n_raters"))
    j = works.join(relevance.select("work_id", "relevance"), "work_id", "left").join(labels.select("work_id").distinct().withColumn("_class", F.lit(True)), "work_id", "left")
    reason = F.when(F.col("relevance").isNull(), "no relevance consensus").when((F.col("relevance") != "no") & F.col("_class").isNull(), "no class consensus")
    return j.select("work_id", "n_raters", reason.isNull().alias("written"), reason.alias("reason"))


def standing_rejections(runs: DataFrame, key: str, at: list[str], forced: str = "forced", rejected: str = "rejected") -> DataFrame:
    """Keys whose newest completed run is a rejection that wasn't forced."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in at])
    newest = runs.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return newest.filter(F.col(rejected) & ~F.coalesce(F.col(forced), F.lit(False)))


def first_object(text: str | None) -> str | None:
    """The first balanced {...} of a text, strings respected."""
    depth, start, inside, escaped = 0, -1, False, False
    for i, c in enumerate(text or ""):
        if inside:
            inside, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
        elif c == '"' and depth:
            inside = True
        elif c == "{":
            start, depth = (i if depth == 0 else start), depth + 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                return text[start : i + 1]
    return None


def first_json_object(c: Column) -> Column:
    """first_object() as an expression; nesting isn't regular, hence Arrow batches."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(first_object)

    return run(c)
