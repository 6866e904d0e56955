"""Strict-majority consensus of several raters. All are counts per value and key, combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.operators.ratings import status_of


def majority(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, votes, n for the value that more than half of the non-null votes of a key chose; other keys give no row."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("votes"))
    total = counts.withColumn("n", F.sum("votes").over(Window.partitionBy(*keys)))
    return total.filter(F.col("votes") * 2 > F.col("n"))


def step_order(step_id: Column) -> Column:
    """Sort key: S2 before S10, ids of another form after them."""
    natural = step_id.rlike(r"^S\d+$")
    return F.struct((~natural).alias("other"), F.when(natural, F.substring(step_id, 2, 10).cast("int")).alias("n"), step_id.alias("id"))


def consensus_steps(steps: DataFrame) -> DataFrame:
    """work_id, step_id, applicable, status, confidence (mean of those who agree), n_agree; steps without a majority are left out.

    First whether the step applies, then the status among those for whom it does.
    """
    keys = ["work_id", "step_id"]
    cells = steps.filter(F.col("applicable").isNotNull()).groupBy(*keys, "applicable", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("c"), F.count("confidence").alias("nc"))
    w = Window.partitionBy(*keys)
    wa = Window.partitionBy(*keys, "applicable")
    cells = cells.withColumn("all", F.sum("n").over(w)).withColumn("side", F.sum("n").over(wa)).withColumn("rated", F.sum(F.when(F.col("status").isNotNull(), F.col("n")).otherwise(0)).over(wa))
    chosen = cells.filter(F.col("side") * 2 > F.col("all"))
    no = chosen.filter(~F.col("applicable")).groupBy(*keys).agg(F.lit(False).alias("applicable"), F.lit("not_applicable").alias("status"), (F.sum("c") / F.nullif(F.sum("nc"), F.lit(0))).alias("confidence"), F.sum("n").alias("n_agree"))
    yes = chosen.filter(F.col("applicable") & F.col("status").isNotNull() & (F.col("n") * 2 > F.col("rated"))).select(*keys, "applicable", "status", (F.col("c") / F.nullif(F.col("nc"), F.lit(0))).alias("confidence"), F.col("n").alias("n_agree"))
    return yes.unionByName(no)


def consensus_evidence(steps: DataFrame, consensus: DataFrame) -> DataFrame:
    """Distinct evidence spans of the raters who agree with a consensus step, in the order of raters and spans."""
    agree = steps.filter("applicable").join(consensus.filter("applicable").select("work_id", "step_id", "status"), ["work_id", "step_id", "status"])
    spans = agree.select("work_id", "step_id", "rater_id", F.posexplode("evidence").alias("pos", "e"))
    first = spans.groupBy("work_id", "step_id", F.col("e.section_id").alias("section_id"), F.col("e.page").alias("page"), F.col("e.quote").alias("quote")).agg(F.min(F.struct("rater_id", "pos")).alias("at"))
    return first.withColumn("span_pos", F.row_number().over(Window.partitionBy("work_id", "step_id").orderBy("at", "section_id", "page", "quote")) - 1).drop("at")


def consensus_labels(current: DataFrame, column: str = "paper_class_labels") -> DataFrame:
    """Labels that more than half of a work's raters gave: work_id, label, votes, n_raters."""
    raters = current.groupBy("work_id").agg(F.count(F.lit(1)).alias("n_raters"))
    votes = current.select("work_id", F.explode(F.array_distinct(column)).alias("label")).groupBy("work_id", "label").agg(F.count(F.lit(1)).alias("votes"))
    return votes.join(raters, "work_id").filter(F.col("votes") * 2 > F.col("n_raters"))


def consensus_gates(current: DataFrame, fields: tuple[str, ...] = ("inference_method", "n_models", "bf_claimed", "prior_informativeness")) -> DataFrame:
    """Each gate answer by strict majority, else that of the first rater by id: work_id and the fields as strings."""
    facts = current.filter(F.col("gate_facts").isNotNull())
    long = facts.select("work_id", "rater_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"gate_facts.{f}").cast("string").alias("val")) for f in fields])).alias("x")).select("work_id", "rater_id", "x.*")
    first = long.groupBy("work_id", "field").agg(F.min_by("val", "rater_id").alias("first"))
    best = majority(long.withColumn("val", F.coalesce("val", F.lit("\0"))), ["work_id", "field"], "val").select("work_id", "field", F.nullif("val", F.lit("\0")).alias("val"), F.lit(True).alias("has"))
    got = first.join(best, ["work_id", "field"], "left").withColumn("val", F.when(F.col("has"), F.col("val")).otherwise(F.col("first")))
    return got.groupBy("work_id").agg(*[F.max(F.when(F.col("field") == f, F.col("val"))).alias(f) for f in fields])


def consensus_relevance(current: DataFrame) -> DataFrame:
    """work_id, relevance by strict majority of the non-null labels."""
    return majority(current.withColumn("relevance", status_of(F.col("relevance_label"))), ["work_id"], "relevance").select("work_id", "relevance", "votes", "n")
