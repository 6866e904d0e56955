"""Agreement statistics. Each is one aggregation into a fixed number of counts, then arithmetic on them; no join, no collect."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z95 = 1.9599639845400536


def ratio(x: Column, n: Column) -> Column:
    return x / F.nullif(n, F.lit(0))


def kappa_summary(pairs: DataFrame, order: Sequence[str], a: str = "a", b: str = "b", by: Sequence[str] = ()) -> DataFrame:
    """n, percent agreement, Cohen's kappa (nominal, linear, quadratic) and Gwet's AC1 of pairs of labels from ``order``.

    Pairs with a label outside ``order`` are left out. Empty input gives a single row with n = 0 and nulls (none with ``by``).
    Chance agreement of 1 gives 1 if all agree, else 0.
    """
    k = len(order)
    used = pairs.filter(F.col(a).isin(*order) & F.col(b).isin(*order))
    counts = used.groupBy(*by).agg(*[F.count(F.when((F.col(a) == x) & (F.col(b) == y), 1)).cast("double").alias(f"n_{i}_{j}") for i, x in enumerate(order) for j, y in enumerate(order)])
    cell = {(i, j): F.col(f"n_{i}_{j}") for i in range(k) for j in range(k)}
    total = sum(list(cell.values())[1:], cell[0, 0])
    row = [sum([cell[i, j] for j in range(1, k)], cell[i, 0]) for i in range(k)]
    col = [sum([cell[i, j] for i in range(1, k)], cell[0, j]) for j in range(k)]
    n = F.nullif(F.col("n"), F.lit(0.0))
    counts = counts.select(*by, *cell.values(), total.alias("n"), *[r.alias(f"r_{i}") for i, r in enumerate(row)], *[c.alias(f"c_{i}") for i, c in enumerate(col)])

    def kappa(weight) -> Column:
        po = sum([weight(i, j) * cell[i, j] for i in range(k) for j in range(k)], F.lit(0.0)) / n
        pe = sum([weight(i, j) * F.col(f"r_{i}") * F.col(f"c_{j}") for i in range(k) for j in range(k)], F.lit(0.0)) / (n * n)
        return F.when(pe == 1.0, F.when(po == 1.0, 1.0).otherwise(0.0)).otherwise((po - pe) / F.nullif(1.0 - pe, F.lit(0.0)))

    pa = sum([cell[i, i] for i in range(k)], F.lit(0.0)) / n
    shares = [(F.col(f"r_{i}") + F.col(f"c_{i}")) / (2 * n) for i in range(k)]
    pe = sum([p * (1 - p) for p in shares], F.lit(0.0)) / max(k - 1, 1)
    ac1 = F.when(F.col("n") > 0, 1.0) if k == 1 else (pa - pe) / F.nullif(1.0 - pe, F.lit(0.0))
    span = max(k - 1, 1)
    return counts.select(
        *by, F.col("n").cast("long").alias("n"), pa.alias("agreement"), kappa(lambda i, j: float(i == j)).alias("kappa"),
        kappa(lambda i, j: 1 - abs(i - j) / span).alias("kappa_linear"), kappa(lambda i, j: 1 - (abs(i - j) / span) ** 2).alias("kappa_quadratic"), ac1.alias("ac1"),
    )


def confusion(pairs: DataFrame, order: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """The full crosstab with zeros: a, b, n. One aggregation into len(order)² counts."""
    counts = pairs.agg(*[F.count(F.when((F.col(a) == x) & (F.col(b) == y), 1)).alias(f"n_{i}_{j}") for i, x in enumerate(order) for j, y in enumerate(order)])
    cells = F.array(*[F.struct(F.lit(x).alias(a), F.lit(y).alias(b), F.col(f"n_{i}_{j}").alias("n")) for i, x in enumerate(order) for j, y in enumerate(order)])
    return counts.select(F.explode(cells).alias("x")).select("x.*")


def absence_rates(pairs: DataFrame, human: str = "a", engine: str = "b") -> DataFrame:
    """Strict and broad false absence rate and miss rate: rate, x, n, value.

    Strict: engine missing where the human says adequate; broad: adequate or partial. N/A of the human is left out of both;
    misses: the human says missing and the engine, where it applies, doesn't.
    """
    h, e = F.col(human), F.col(engine)
    count = lambda c: F.count(F.when(c, 1))
    said = e == "missing"
    graded = said & (h != "not_applicable")
    counted = pairs.agg(count(graded).alias("n_said"), count(graded & (h == "adequate")).alias("strict"), count(graded & h.isin("adequate", "partial")).alias("broad"), count((h == "missing") & (e != "not_applicable")).alias("n_miss"), count((h == "missing") & e.isin("adequate", "partial")).alias("miss"))
    rows = F.array(*[F.struct(F.lit(name).alias("rate"), F.col(x).alias("x"), F.col(n).alias("n")) for name, x, n in (("false_absence_strict", "strict", "n_said"), ("false_absence_broad", "broad", "n_said"), ("absence_missed", "miss", "n_miss"))])
    return counted.select(F.explode(rows).alias("r")).select("r.*").withColumn("value", ratio(F.col("x"), F.col("n")))


def binary_rates(pairs: DataFrame, truth: str = "a", said: str = "b") -> DataFrame:
    """Sensitivity, specificity and accuracy of booleans: rate, x, n, value."""
    t, s = F.col(truth), F.col(said)
    count = lambda c: F.count(F.when(c, 1))
    counted = pairs.agg(count(t & s).alias("tp"), count(t).alias("p"), count(~t & ~s).alias("tn"), count(~t).alias("q"), count(t == s).alias("ok"), count(t.isNotNull() & s.isNotNull()).alias("n"))
    rows = F.array(*[F.struct(F.lit(name).alias("rate"), F.col(x).alias("x"), F.col(n).alias("n")) for name, x, n in (("sensitivity", "tp", "p"), ("specificity", "tn", "q"), ("accuracy", "ok", "n"))])
    return counted.select(F.explode(rows).alias("r")).select("r.*").withColumn("value", ratio(F.col("x"), F.col("n")))


def wilson(x: Column, n: Column, z: float = Z95) -> Column:
    """struct(lo, hi) of the Wilson interval within [0, 1]; null for n = 0."""
    m = F.nullif(n.cast("double"), F.lit(0.0))
    p = x / m
    centre = (p + z * z / (2 * m)) / (1 + z * z / m)
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    return F.when(m.isNotNull(), F.struct(F.greatest(F.lit(0.0), centre - half).alias("lo"), F.least(F.lit(1.0), centre + half).alias("hi")))


def icc_a1(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Two-way absolute-agreement intraclass correlation of pairs of numbers: n, icc; null under two pairs or without variance.

    One aggregation: the mean squares are sample variances of each pair's mean and difference, which keeps it stable.
    """
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    s = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.count(F.lit(1)).alias("n"), (2 * F.var_samp((x + y) / 2)).alias("msr"), (F.var_samp(x - y) / 2).alias("mse"), F.avg(x - y).alias("d"))
    n = F.col("n").cast("double")
    msc = n * F.col("d") * F.col("d") / 2
    den = F.col("msr") + F.col("mse") + 2 * (msc - F.col("mse")) / n
    varies = (F.col("msr") > 0) | (F.col("mse") > 0) | (F.col("d") != 0)
    return s.select("n", F.when((n >= 2) & varies, (F.col("msr") - F.col("mse")) / F.nullif(den, F.lit(0.0))).alias("icc"))


def _times(unit: Column, k: Column, seed: int) -> Column:
    """How often a unit is drawn in resample ``k``: a Poisson number of mean 1 from a hash, the same wherever it is computed."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), k.cast("string"), unit.cast("string"))), 1, 8), 16, 10).cast("double") / 2.0**32
    below, p = 0.0, math.exp(-1)
    steps = []
    for j in range(12):  # the thirteenth step lies beyond what 32 bits can tell from 1
        below += p
        p /= j + 1
        steps.append(F.when(u >= below, 1).otherwise(0))
    return sum(steps[1:], steps[0])


def bootstrap(units: DataFrame, unit: str, sums: Sequence[str], stat: Callable[[dict[str, Column]], Column], resamples: int = 200, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Percentile interval of any statistic of sums over units, by resampling units: n_resamples, lo, hi.

    ``units``: one row per unit with the columns ``sums``; ``stat`` gives the statistic from the resampled sums. Each
    unit enters a resample a Poisson number of times, drawn from a hash of the unit, so units are neither collected nor
    shuffled: only ``resamples`` rows of sums are. Null statistics are left out; without units the interval is null.
    """
    k = F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))
    drawn = units.select(F.col(unit).alias("_u"), *sums, k.alias("_k")).withColumn("_t", _times(F.col("_u"), F.col("_k"), seed)).filter("_t > 0")
    summed = drawn.groupBy("_k").agg(*[F.sum(F.col(c) * F.col("_t")).cast("double").alias(c) for c in sums])
    tail = (1 - level) / 2
    return summed.select(stat({c: F.col(c) for c in sums}).alias("v")).agg(F.count("v").alias("n_resamples"), F.percentile("v", F.lit(tail)).alias("lo"), F.percentile("v", F.lit(1 - tail)).alias("hi"))


def bootstrap_kappa(pairs: DataFrame, cluster: str, order: Sequence[str], a: str = "a", b: str = "b", resamples: int = 200, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Interval of kappa over resampled clusters, each counted into len(order)² cells first: n_resamples, lo, hi."""
    m = range(len(order))
    cells = [f"n_{i}_{j}" for i in m for j in m]
    units = pairs.filter(F.col(a).isin(*order) & F.col(b).isin(*order)).groupBy(F.col(cluster).alias("u")).agg(*[F.count(F.when((F.col(a) == order[i]) & (F.col(b) == order[j]), 1)).alias(f"n_{i}_{j}") for i in m for j in m])

    def kappa(n: dict[str, Column]) -> Column:
        add = lambda xs: sum(xs[1:], xs[0])
        total = add(list(n.values()))
        po = add([n[f"n_{i}_{i}"] for i in m]) / total
        pe = add([add([n[f"n_{i}_{j}"] for j in m]) * add([n[f"n_{j}_{i}"] for j in m]) for i in m]) / (total * total)
        return F.when(pe == 1.0, F.when(po == 1.0, 1.0).otherwise(0.0)).otherwise((po - pe) / F.nullif(1 - pe, F.lit(0.0)))

    return bootstrap(units, "u", cells, kappa, resamples, seed, level)


def rater_pairs(steps: DataFrame) -> DataFrame:
    """Pairs of raters' statuses on the same step of the same work, each pair once, both applicable: work_id, step_id, rater_a, rater_b, a, b."""
    s = steps.filter("applicable")
    left = s.select("work_id", "step_id", F.col("rater_id").alias("rater_a"), F.col("status").alias("a"))
    right = s.select("work_id", "step_id", F.col("rater_id").alias("rater_b"), F.col("status").alias("b"))
    return left.join(right, ["work_id", "step_id"]).filter(F.col("rater_a") < F.col("rater_b"))


def pair_cells(steps: DataFrame, keys: Sequence[str] = ("work_id", "step_id"), value: str = "status") -> DataFrame:
    """Counts of unordered value pairs between raters, from the counts per value; no pair of raters is formed: a, b, n."""
    counts = steps.filter(F.col("applicable") & F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    lists = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(value, "n"))).alias("v"))  # at most one entry a category
    both = F.flatten(F.transform("v", lambda x, i: F.transform(F.slice(F.col("v"), i + 1, F.size("v")), lambda y: F.struct(x[value].alias("a"), y[value].alias("b"), F.when(x[value] == y[value], x["n"] * (x["n"] - 1) / 2).otherwise(x["n"] * y["n"]).cast("long").alias("n")))))
    return lists.select(F.explode(both).alias("p")).select("p.*").groupBy("a", "b").agg(F.sum("n").alias("n")).filter("n > 0")
