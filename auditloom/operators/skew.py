"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", hot_share: float = 0.005, salts: int = 64, counted: DataFrame | None = None) -> DataFrame:
    """Equi-join in which keys that hold more than ``hot_share`` of ``left`` are spread over ``salts`` partitions.

    ``right`` is replicated for the hot keys only. At most 1/hot_share keys can be hot, so the list that goes to the
    driver and into the plan is bounded whatever the input size. ``counted`` may name a cheaper frame with the same keys as
    ``left`` to count on. Null keys never match (SQL semantics); with ``how`` =
    "left" or "left_semi"/"left_anti" the rows of ``left`` behave as in an ordinary join. No row is dropped or repeated.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"skew_join can't salt a {how} join")
    source = (left if counted is None else counted).select(*on)
    # no more than 1/hot_share keys can be hot, so these are all that may be; the total is only counted if one might
    most = source.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1000").orderBy(F.desc("_rows")).limit(int(1 / hot_share)).collect()
    least = source.count() * hot_share if most else 0
    found = [tuple(r[k] for k in on) for r in most if r["_rows"] > least]
    if not found:
        return left.join(right, on, how)
    # rows with a null key match nothing, but many of them would still meet in one partition
    hot, nulls = [k for k in found if None not in k], any(None in k for k in found)
    spark = left.sparkSession
    flags = F.broadcast(spark.createDataFrame(hot, left.select(*on).schema).withColumn("_hot", F.lit(True)))
    # by the row's own values, so that a retried task deals its rows as before
    dealt = [f.name for f in left.schema.fields if "map<" not in f.dataType.simpleString()]
    spread = left.join(flags, on, "left").withColumn("_salt", F.when(F.col("_hot") | (F.lit(nulls) & reduce(or_, [F.col(k).isNull() for k in on])), F.pmod(F.xxhash64(*dealt), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    copies = right.join(flags, on, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return spread.join(copies, [*on, "_salt"], how).drop("_salt")
