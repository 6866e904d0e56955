"""Coverage, weighted quality, what-if gains and the ranked list of fixes. Weights come as a table (the rubric is data)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SUB_SCORE = {"adequate": 1.0, "partial": 0.5, "missing": 0.0}
LOW_CONFIDENCE = 0.6
SEVERITY = ("error", "warning", "info")
EASE = ("low", "medium", "high")
STEPS = tuple(f"S{i}" for i in range(1, 11))


def weight_table(spark: SparkSession, weights: dict[str, dict[str, float]]) -> DataFrame:
    """label, step_id, weight from the rubric's mapping; only weights that differ from the default need be given."""
    rows = [(label, step, float(w)) for label, by in weights.items() for step, w in by.items()]
    return spark.createDataFrame(rows, "label string, step_id string, weight double")


def sub_score(status: Column) -> Column:
    return F.coalesce(*[F.when(status == s, F.lit(v)) for s, v in SUB_SCORE.items()])


def step_weights(steps: DataFrame, labels: DataFrame, weights: DataFrame, default: float = 1.0) -> DataFrame:
    """Add weight: the largest over a document's labels, ``default`` where a label has none or there is no label. ``labels``: doc, label."""
    kinds = labels.groupBy("doc").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    sets = kinds.select("labels").distinct()  # few different label sets: weights are resolved once for each
    pairs = sets.select("labels", F.explode("labels").alias("label")).join(F.broadcast(weights), "label", "left")
    n = F.size("labels")
    best = pairs.filter("step_id IS NOT NULL").groupBy("labels", "step_id").agg(F.max("weight").alias("top"), F.count(F.lit(1)).alias("known"))
    best = best.select("labels", "step_id", F.when(F.col("known") < n, F.greatest(F.col("top"), F.lit(default))).otherwise(F.col("top")).alias("weight"))
    joined = steps.join(kinds, "doc", "left").join(F.broadcast(best), ["labels", "step_id"], "left")
    return joined.withColumn("weight", F.coalesce("weight", F.lit(default))).drop("labels")


def coverage_quality(steps: DataFrame, by: list[str] | None = None, low_confidence: float = LOW_CONFIDENCE) -> DataFrame:
    """Per document: n_applicable, n_na, n_uncertain, present, strict and lenient coverage, quality; null where nothing applies.

    ``steps``: doc, step_id, applicable, status, weight, confidence. Uncertain: missing with low confidence.
    """
    by = by or ["doc"]
    on = F.col("applicable")
    uncertain = on & (F.col("status") == "missing") & (F.col("confidence") < low_confidence)
    count = lambda c: F.count(F.when(c, 1))
    sums = steps.groupBy(*by).agg(
        count(on).alias("n_applicable"), count(~on).alias("n_na"), count(uncertain).alias("n_uncertain"), count(on & F.col("status").isin("adequate", "partial")).alias("present"),
        F.sum(F.when(on, F.col("weight"))).alias("w"), F.sum(F.when(on, F.col("weight") * sub_score(F.col("status")))).alias("ws"),
    )
    n = F.nullif(F.col("n_applicable"), F.lit(0))
    return sums.select(*by, "n_applicable", "n_na", "n_uncertain", "present", (F.col("present") / n).alias("strict"), ((F.col("present") + F.col("n_uncertain")) / n).alias("lenient"), (F.col("ws") / F.nullif(F.col("w"), F.lit(0.0))).alias("quality"))


def score_impacts(steps: DataFrame) -> DataFrame:
    """What each applicable step that isn't adequate would add if it were: doc, step_id, status, coverage_delta, quality_delta."""
    w = Window.partitionBy("doc")
    on = F.col("applicable")
    present = on & F.col("status").isin("adequate", "partial")
    s = steps.withColumn("n", F.count(F.when(on, 1)).over(w)).withColumn("p", F.count(F.when(present, 1)).over(w))
    s = s.withColumn("sw", F.sum(F.when(on, F.col("weight"))).over(w)).withColumn("sq", F.sum(F.when(on, F.col("weight") * sub_score(F.col("status")))).over(w))
    mine = F.col("weight") * (1 - sub_score(F.col("status")))
    gain = (F.col("p") + F.when(F.col("status") == "missing", 1).otherwise(0)) / F.col("n") - F.col("p") / F.col("n")
    better = (F.col("sq") + mine) / F.nullif(F.col("sw"), F.lit(0.0)) - F.col("sq") / F.nullif(F.col("sw"), F.lit(0.0))
    return s.filter(on & F.col("status").isin("partial", "missing") & (F.col("sw") != 0)).select("doc", "step_id", "status", gain.alias("coverage_delta"), better.alias("quality_delta"))


def rank_of(c: Column, order: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(c == x, F.lit(i)) for i, x in enumerate(order)], F.lit(len(order)))


def fix_list(suggestions: DataFrame, weights: DataFrame, impacts: DataFrame, default: float = 1.0) -> DataFrame:
    """Suggestions of each document in the order to fix them: severity, weight (large first), ease, step id as text, input order.

    ``suggestions``: doc, step_id, pos, severity, text, ease; ``weights``: doc, step_id, weight; ``impacts`` from score_impacts().
    """
    keys = ["doc", "step_id"]
    rows = suggestions.join(weights.select(*keys, "weight"), keys, "left").join(impacts.select(*keys, "coverage_delta", "quality_delta"), keys, "left")
    rows = rows.na.fill({"weight": default, "coverage_delta": 0.0, "quality_delta": 0.0})
    order = Window.partitionBy("doc").orderBy(rank_of(F.col("severity"), SEVERITY), F.desc("weight"), rank_of(F.col("ease"), EASE), "step_id", "pos")
    return rows.withColumn("fix_rank", F.row_number().over(order))


def one_level_toward(current: Column, target: Column) -> Column:
    """A status moved one level toward another; unchanged where either isn't graded."""
    order = F.array(F.lit("missing"), F.lit("partial"), F.lit("adequate"))
    i, j = F.array_position(order, current), F.array_position(order, target)
    step = F.when(j > i, 1).when(j < i, -1).otherwise(0)
    return F.when((i > 0) & (j > 0), F.element_at(order, (i + step).cast("int"))).otherwise(current)


def upgrade_refuted(status: Column, refuted: Column, proposed: Column) -> Column:
    """A refuted absence goes up at least one level, never down."""
    order = F.array(F.lit("missing"), F.lit("partial"), F.lit("adequate"))
    now, want = F.array_position(order, status), F.array_position(order, F.coalesce(proposed, F.lit("")))
    up = F.element_at(order, F.least(F.greatest(now + 1, want), F.lit(3)).cast("int"))
    return F.when(F.coalesce(refuted, F.lit(False)) & (now > 0), up).otherwise(status)


def apply_corrections(steps: DataFrame, corrections: DataFrame) -> DataFrame:
    """Steps with corrections applied, one level toward each target: adds corrected. ``corrections``: doc, step_id, target."""
    joined = steps.join(corrections.select("doc", "step_id", "target"), ["doc", "step_id"], "left")
    return joined.withColumn("corrected", F.when(F.col("applicable") & F.col("target").isNotNull(), one_level_toward(F.col("status"), F.col("target"))).otherwise(F.col("status")))


def correction_deltas(steps: DataFrame, corrections: DataFrame) -> DataFrame:
    """What each correction by itself changes: doc, step_id, status, corrected, coverage_delta, quality_delta.

    ``steps``: doc, step_id, applicable, status, weight; ``corrections`` as in apply_corrections(). The deltas are
    those of the score with just this one applied, from the document's sums, so nothing is scored again. Corrections of
    steps that don't apply or aren't there give no row.
    """
    w = Window.partitionBy("doc")
    on = F.col("applicable")
    s = apply_corrections(steps, corrections).withColumns({
        "_n": F.sum(F.when(on, 1).otherwise(0)).over(w), "_w": F.sum(F.when(on, F.col("weight"))).over(w),
    })
    there = lambda c: F.when(F.col(c).isin("partial", "adequate"), 1).otherwise(0)
    coverage = (there("corrected") - there("status")) / F.nullif(F.col("_n"), F.lit(0))
    quality = F.col("weight") * (sub_score(F.col("corrected")) - sub_score(F.col("status"))) / F.nullif(F.col("_w"), F.lit(0.0))
    return s.filter(on & F.col("target").isNotNull()).select("doc", "step_id", "status", "corrected", coverage.alias("coverage_delta"), quality.alias("quality_delta"))


def severity_of(tier: Column, status: Column) -> Column:
    missing = F.when(tier == "expected", "error").when(tier == "recommended", "warning").otherwise("info")
    return F.when(status == "missing", missing).when((status == "partial") & (tier == "expected"), "warning").otherwise("info")


def uncited_praise(praise: DataFrame, text: str = "text") -> DataFrame:
    """Praise that points to nothing in the document: no section, page, figure or table mark and no quotation."""
    return praise.filter(~F.col(text).rlike(r'(?i)§|\bp\.\s*\d|\bpage\b|\bfig\b|\btable\b|\bsec\b|["“”]'))
