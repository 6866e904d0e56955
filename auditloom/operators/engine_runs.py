"""Engine runs recorded as scored results, beside the consensus of the human raters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.operators import agreement
from auditloom.operators.nested_json import flatten_reports, table_of
from auditloom.session import cut

NO_ENGINE = "—"


def engine_steps(records: DataFrame) -> DataFrame:
    """The steps of each work's newest two runs: work_id, run (1 the newest), record_id, step_id, applicable, status, confidence.

    Newest by received_at, of equals by the larger record_id; repeated records count once, of a step id that a run lists
    twice the last one counts. Runs without a work and steps without an id or status give no row.
    """
    scored = records.filter("record_kind = 'scored_result'")
    flat = cut(flatten_reports(scored).filter((F.col("rating_pos") == -1) & F.col("tbl").isin("record", "step")))
    received = scored.groupBy("record_id").agg(F.max("received_at").alias("received_at"))
    runs = table_of(flat, "record").filter("work_id IS NOT NULL").select("record_id", "work_id").distinct().join(received, "record_id")
    newest = Window.partitionBy("work_id").orderBy(F.desc_nulls_last("received_at"), F.desc("record_id"))
    runs = runs.withColumn("run", F.row_number().over(newest)).filter("run <= 2").select("record_id", "work_id", "run")
    steps = table_of(flat, "step").filter("step_id IS NOT NULL AND status IS NOT NULL").groupBy("record_id", "step_id").agg(F.max_by(F.struct("applicable", "status", "confidence"), "step_pos").alias("s"))
    return steps.join(runs, "record_id").select("work_id", "run", "record_id", "step_id", (F.col("s.applicable") == "true").alias("applicable"), F.col("s.status").alias("status"), F.col("s.confidence").cast("double").alias("confidence"))


def latest_tiers(records: DataFrame) -> DataFrame:
    """The tier that the newest human report of a work gives it: work_id, tier."""
    human = records.filter("record_kind = 'human_report'")
    named = table_of(flatten_reports(human), "record").filter("work_id IS NOT NULL AND tier IS NOT NULL").select("record_id", "work_id", "tier").distinct()
    at = human.groupBy("record_id").agg(F.max("received_at").alias("received_at"))
    return named.join(at, "record_id").groupBy("work_id").agg(F.max_by("tier", F.struct("received_at", "record_id")).alias("tier"))


def against_consensus(consensus: DataFrame, engine: DataFrame) -> DataFrame:
    """Consensus steps (a) with the newest engine run's (b); steps the engine hasn't are left out: work_id, step_id, a, b, a_applies, b_applies."""
    e = engine.filter("run = 1").select("work_id", "step_id", F.col("status").alias("b"), F.col("applicable").alias("b_applies"))
    return consensus.select("work_id", "step_id", F.col("status").alias("a"), F.col("applicable").alias("a_applies")).join(e, ["work_id", "step_id"])


def single_cases(consensus: DataFrame, engine: DataFrame) -> DataFrame:
    """Each consensus step beside the engine's status, ``NO_ENGINE`` where it has none: work_id, step_id, consensus, engine, agree. Only works the engine has run on."""
    e = engine.filter("run = 1").select("work_id", "step_id", F.col("status").alias("engine"))
    seen = engine.select("work_id").distinct()
    out = consensus.select("work_id", "step_id", F.col("status").alias("consensus")).join(seen, "work_id", "left_semi").join(e, ["work_id", "step_id"], "left")
    return out.select("work_id", "step_id", "consensus", F.coalesce("engine", F.lit(NO_ENGINE)).alias("engine"), F.coalesce(F.col("consensus") == F.col("engine"), F.lit(False)).alias("agree"))


def retest_pairs(engine: DataFrame) -> DataFrame:
    """Statuses of the same step in a work's newest run (a) and the one before (b), where it applies in both."""
    run = lambda k, name: engine.filter((F.col("run") == k) & F.col("applicable")).select("work_id", "step_id", F.col("status").alias(name))
    return run(1, "a").join(run(2, "b"), ["work_id", "step_id"])


def validation_rows(consensus: DataFrame, engine: DataFrame, tiers: DataFrame, admissible: DataFrame, order: tuple[str, ...], floor: int = 15) -> DataFrame:
    """The report of engine against human as rows: metric, value, n, preliminary.

    Paired are works with a tier and an engine run; those that aren't in ``admissible`` are counted as excluded. Step metrics
    pool tier A, agreement of the two newest runs takes all works. Below ``floor`` admissible works all is preliminary.
    """
    works = tiers.join(engine.select("work_id").distinct(), "work_id").join(admissible.select("work_id", F.lit(True).alias("ok")).distinct(), "work_id", "left")
    works = cut(works.select("work_id", "tier", F.coalesce("ok", F.lit(False)).alias("ok")))
    cells = cut(against_consensus(consensus, engine).join(works.filter("ok AND tier = 'A'").select("work_id"), "work_id", "left_semi"))
    rows = lambda df, prefix, names: df.select(F.explode(F.array(*[F.struct(F.lit(prefix + m).alias("metric"), F.col(m).cast("double").alias("value"), F.col("n").cast("long").alias("n")) for m in names])).alias("x")).select("x.*")
    counted = works.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("ok"), 1)).alias("n_papers"), F.count(F.when(~F.col("ok"), 1)).alias("n_excluded"), *[F.count(F.when(F.col("ok") & (F.col("tier") == t), 1)).alias(f"n_tier_{t.lower()}") for t in "ABC"])
    both = cells.filter("a_applies AND b_applies")
    out = rows(counted, "", ("n_papers", "n_excluded", "n_tier_a", "n_tier_b", "n_tier_c"))
    out = out.unionByName(rows(agreement.kappa_summary(both, order), "step_", ("agreement", "kappa", "kappa_linear", "ac1")))
    applies = cells.select(F.col("a_applies").cast("string").alias("a"), F.col("b_applies").cast("string").alias("b"))
    out = out.unionByName(rows(agreement.kappa_summary(applies, ("false", "true")), "applicability_", ("agreement", "kappa")))
    out = out.unionByName(agreement.absence_rates(cells).select(F.col("rate").alias("metric"), "value", "n"))
    out = out.unionByName(rows(agreement.kappa_summary(retest_pairs(engine), order), "retest_", ("agreement", "kappa")))
    few = F.broadcast(counted.select((F.col("n_papers") < floor).alias("preliminary"), F.lit(1).alias("one")))
    return out.withColumn("one", F.lit(1)).join(few, "one").drop("one")
