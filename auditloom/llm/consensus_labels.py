"""Problem 1: consensus of disagreeing raters by a community confusion model.

Raters belong to a few types; each type has a confusion matrix for steps and one for relevance, shared by its raters.
Variational updates alternate between the items' labels, the raters' types and the types' matrices. A rater's own matrix
is the mixture of the types' matrices, weighted as so many labels, plus what the rater did; few labels change it little.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.operators.skew import skew_join
from auditloom.session import cut, cut_placed

# The labels of the two tasks, worst to best and back to none, and how they may be written.
STATUS = ("missing", "partial", "adequate", "not_applicable")
RELEVANCE = ("no", "partial", "yes")
ALIASES = {"n/a": "not_applicable", "na": "not_applicable", "notapplicable": "not_applicable", "none": "missing", "y": "yes", "n": "no"}
TASKS = {"relevance": RELEVANCE, "status": STATUS}
CELLS = [(task, t, l) for task, labels in TASKS.items() for t in range(len(labels)) for l in range(len(labels))]  # noqa: E741
ITEM = ["work_id", "step_id", "task"]
#: Up to so many raters (200 bytes each) their counts come to the driver and their matrices are broadcast; beyond, both stay
#: distributed and the join with the votes is salted. The same holds of kinds of item and their priors.
BROADCAST_RATERS, BROADCAST_KINDS = 20_000, 20_000
#: An item with more votes than this, and than 1/2000 of all, is spread over tasks; at most 2,000 items can be.
HOT_ITEM = 20_000


def plain_label(label: Column) -> Column:
    """Lower case, with underscores, aliases resolved; a label outside both vocabularies is null."""
    s = F.regexp_replace(F.trim(F.lower(label)), r"[\s_-]+", "_")
    table = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    s = F.coalesce(F.try_element_at(table, s), s)
    return F.when(s.isin(*sorted({*STATUS, *RELEVANCE})), s)


def current_votes(ratings: DataFrame) -> DataFrame:
    """One row per label that counts: work_id, step_id (relevance for the whole work), task, rater_id, code (place in the vocabulary).

    Of several forms of one rater for one work the latest rated_at (then the largest rating_id) replaces the others as a
    whole. Null, unknown and empty labels give no row, nor do forms without work or rater; of a step that a form lists twice
    the last label counts.
    """
    steps = F.transform(F.coalesce("steps", F.array().cast(ratings.schema["steps"].dataType)), lambda s: F.struct(s["step_id"].alias("step_id"), plain_label(s["status"]).alias("label")))
    form = F.struct(plain_label(F.col("relevance_label")).alias("relevance"), steps.alias("steps"))
    slim = ratings.filter(F.col("work_id").isNotNull() & F.col("rater_id").isNotNull()).select("work_id", "rater_id", F.struct(F.coalesce("rated_at", F.lit("0001-01-01").cast("timestamp")).alias("at"), "rating_id").alias("at"), form.alias("form"))
    latest = slim.groupBy("work_id", "rater_id").agg(F.max_by("form", "at").alias("form"))
    entries = F.array_append(F.col("form.steps"), F.struct(F.lit("relevance").alias("step_id"), F.col("form.relevance").alias("label")))
    rows = latest.select("work_id", "rater_id", F.posexplode(entries).alias("pos", "e")).select("work_id", "rater_id", "pos", F.col("e.step_id").alias("step_id"), F.col("e.label").alias("label"))
    rows = rows.withColumn("task", F.when(F.col("step_id") == "relevance", "relevance").otherwise("status"))
    code = F.when(F.col("task") == "relevance", F.array_position(F.array(*map(F.lit, RELEVANCE)), F.col("label"))).otherwise(F.array_position(F.array(*map(F.lit, STATUS)), F.col("label"))) - 1
    rows = rows.withColumn("code", code.cast("int")).filter((F.col("code") >= 0) & F.col("step_id").isNotNull())
    return rows.groupBy("work_id", "step_id", "task", "rater_id").agg(F.max_by("code", "pos").alias("code"))


def _digamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers, by recurrence and the asymptotic series."""
    out = np.zeros_like(x)
    for _ in range(6):
        out -= 1 / x
        x = x + 1
    return out + np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)


def _columns(task: str, t: int, l: int) -> str:  # noqa: E741
    return f"{task}_{t}_{l}"


class Communities:
    """The types' Dirichlet parameters, per task types x true x given, and their weights."""

    def __init__(self) -> None:
        # A start for each type: careful, fair, careless, lenient, severe. Not one of them is binding.
        self.weights = np.array([3.0, 3.0, 1.0, 1.0, 1.0])
        self.shape = {}
        for task, labels in TASKS.items():
            k = len(labels)
            grades = min(k, 3)
            eye, flat = np.eye(k), np.full((k, k), 1 / k)
            up, down = np.zeros((k, k)), np.zeros((k, k))
            for t in range(k):
                up[t, min(t + 1, grades - 1) if t < grades else t] = 1
                down[t, max(t - 1, 0) if t < grades else t] = 1
            means = [0.85 * eye + 0.15 * flat, 0.6 * eye + 0.4 * flat, 0.2 * eye + 0.8 * flat, 0.45 * eye + 0.4 * up + 0.15 * flat, 0.45 * eye + 0.4 * down + 0.15 * flat]
            self.shape[task] = np.stack(means) * 20

    def prior(self) -> dict[str, np.ndarray]:
        """A weak prior towards the truth, the same for each type."""
        return {task: np.broadcast_to(0.5 + np.eye(s.shape[1]), s.shape) for task, s in self.shape.items()}

    def logs(self) -> dict[str, np.ndarray]:
        return {task: _digamma(s) - _digamma(s.sum(2, keepdims=True)) for task, s in self.shape.items()}

    def means(self) -> dict[str, np.ndarray]:
        return {task: s / s.sum(2, keepdims=True) for task, s in self.shape.items()}

    def types(self, counts: dict[str, np.ndarray]) -> np.ndarray:
        """Probability of each type for each rater, from the expected counts raters x true x given."""
        logs = self.logs()
        score = _digamma(self.weights) - _digamma(np.array([self.weights.sum()]))
        score = score + sum(np.einsum("rtl,ctl->rc", counts[task], logs[task]) for task in TASKS)
        score = np.exp(score - score.max(1, keepdims=True))
        return score / score.sum(1, keepdims=True)


def _counts(part: pd.DataFrame) -> dict[str, np.ndarray]:
    return {task: np.stack([part[_columns(task, t, l)].to_numpy(float) for t in range(len(ls)) for l in range(len(ls))], 1).reshape(-1, len(ls), len(ls)) if len(part) else np.zeros((0, len(ls), len(ls))) for task, ls in TASKS.items()}


def _type_sums(n: dict[str, np.ndarray], model: Communities) -> np.ndarray:
    """Expected number of raters of each type and the sums of their counts, in one row of numbers."""
    r = model.types(n)
    return np.concatenate([r.sum(0), *(np.einsum("rc,rtl->ctl", r, n[task]).ravel() for task in TASKS)])


def _settle(sums: np.ndarray, model: Communities) -> None:
    """The types' parameters from the sums of their raters."""
    at = len(model.weights)
    model.weights, prior, shape = 1.0 + sums[:at], model.prior(), {}
    for task, s in model.shape.items():
        shape[task] = prior[task] + sums[at : at + s.size].reshape(s.shape)
        at += s.size
    model.shape = shape


def _logs(part: pd.DataFrame, model: Communities, strength: float) -> pd.DataFrame:
    """Per rater, task and given label the expected log probability under each true label: l0 .. l3."""
    n, means, out = _counts(part), model.means(), []
    r = model.types(n)
    for task, labels in TASKS.items():
        own = strength * np.einsum("rc,ctl->rtl", r, means[task]) + n[task]
        logs = _digamma(own) - _digamma(own.sum(2, keepdims=True))
        for given in range(len(labels)):
            cols = {f"l{t}": logs[:, t, given] if t < len(labels) else np.full(len(part), -1e6) for t in range(4)}
            out.append(pd.DataFrame({"rater_id": part["rater_id"], "task": task, "code": np.int32(given), **cols}))
    return pd.concat(out, ignore_index=True)


LOGS = "rater_id string, task string, code int, l0 double, l1 double, l2 double, l3 double"


class Raters:
    """The raters' expected confusion counts: on the driver up to BROADCAST_RATERS raters, distributed beyond."""

    def __init__(self, rows: DataFrame):
        self.spark, counts = rows.sparkSession, cut(self._added(rows))
        self.small = counts.count() <= BROADCAST_RATERS * (len(STATUS) + len(RELEVANCE))
        self.update(rows, counts)

    def update(self, rows: DataFrame, counts: DataFrame | None = None) -> None:
        """From votes with q0 .. q3; they are added up within tasks before the shuffle."""
        counts = self._added(rows) if counts is None else counts
        if self.small:
            long = counts.toPandas()
            long = long.melt(["rater_id", "task", "code"], [f"q{t}" for t in range(4)], "t", "q")
            wide = long.assign(cell=long["task"] + "_" + long["t"].str[1:] + "_" + long["code"].astype(str)).pivot_table(index="rater_id", columns="cell", values="q", aggfunc="sum", fill_value=0.0)
            self.local = wide.reindex(columns=[_columns(*c) for c in CELLS], fill_value=0.0).reset_index().rename_axis(columns=None).astype({"rater_id": object})
        else:
            cell = lambda task, t, l: F.sum(F.when((F.col("task") == task) & (F.col("code") == l), F.col(f"q{t}")).otherwise(0.0)).alias(_columns(task, t, l))  # noqa: E731, E741
            self.frame = cut(counts.groupBy("rater_id").agg(*[cell(*c) for c in CELLS]))

    def _added(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("rater_id", "task", "code").agg(*[F.sum(f"q{t}").alias(f"q{t}") for t in range(4)])

    def type_sums(self, model: Communities) -> np.ndarray:
        if self.small:
            return _type_sums(_counts(self.local), model)

        def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in rows:
                if len(part):
                    flat = _type_sums(_counts(part), model)
                    yield pd.DataFrame({"i": np.arange(len(flat)), "x": flat})

        return self.frame.mapInPandas(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").toPandas()["x"].to_numpy()

    def weigh(self, votes: DataFrame, model: Communities, strength: float) -> DataFrame:
        """The votes with l0 .. l3 of their rater."""
        if self.small:
            return votes.join(F.broadcast(self.spark.createDataFrame(_logs(self.local, model, strength), LOGS)), ["rater_id", "task", "code"])
        logs = self.frame.mapInPandas(lambda rows: (_logs(part, model, strength) for part in rows), LOGS)
        return skew_join(votes, logs, ["rater_id", "task", "code"])

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(self.local, "rater_id string, " + ", ".join(f"{_columns(*c)} double" for c in CELLS)) if self.small else self.frame


class Votes:
    """All votes, placed and sorted by item once, so that no later step shuffles them; votes of hot items apart, spread by rater."""

    def __init__(self, votes: DataFrame):
        parts = int(votes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.cold, self.hot = cut_placed(votes, *ITEM), None
        sizes = self.cold.groupBy(*ITEM).agg(F.count(F.lit(1)).alias("n"))
        most = sizes.agg(F.max("n"), F.sum("n")).first()
        if most[0] and most[0] > (least := max(HOT_ITEM, most[1] / 2000)):
            hot = F.broadcast(cut(sizes.filter(F.col("n") > least).select(*ITEM)))
            self.hot = cut(self.cold.join(hot, ITEM, "left_semi").repartition(parts, *ITEM, "rater_id"))
            self.cold = cut_placed(self.cold.join(hot, ITEM, "left_anti"), *ITEM)

    def each(self, weigh: Callable[[DataFrame], DataFrame], sums: dict[str, Column]) -> DataFrame:
        """The votes after ``weigh``, with ``sums`` over all votes of their item."""
        w = Window.partitionBy(*ITEM)
        out = weigh(self.cold).withColumns({k: F.sum(x).over(w) for k, x in sums.items()})
        if self.hot is not None:
            rows = weigh(self.hot)
            of_item = rows.groupBy(*ITEM).agg(*[F.sum(x).alias(k) for k, x in sums.items()])
            out = out.unionByName(rows.join(F.broadcast(of_item), ITEM).select(*out.columns))
        return out

    def items(self, rows: DataFrame, *columns: str) -> DataFrame:
        """One row per item of what each() gave; ``columns`` are the same in all votes of an item."""
        return rows.groupBy(*ITEM).agg(*[F.first(c).alias(c) for c in columns])


def _posterior(sums: DataFrame) -> DataFrame:
    """Adds q0 .. q3, the probability of each label, from the sums s0 .. s3 and the priors p0 .. p3."""
    scores = [F.col(f"s{t}") + F.col(f"p{t}") for t in range(4)]
    sums = sums.withColumn("_m", F.greatest(*scores))
    weights = [F.exp(s - F.col("_m")) for s in scores]
    return sums.withColumns({f"_w{t}": w for t, w in enumerate(weights)}).withColumns({f"q{t}": F.col(f"_w{t}") / (F.col("_w0") + F.col("_w1") + F.col("_w2") + F.col("_w3")) for t in range(4)})


def _step_priors(rows: DataFrame) -> DataFrame:
    """Logs of the smoothed label shares of each kind of item, however many there are: step_id, task, p0 .. p3."""
    shares = rows.groupBy("step_id", "task").agg(*[F.sum(F.col(f"q{t}") / F.col("n")).alias(f"q{t}") for t in range(4)])
    used = [F.col("task").isin([task for task, labels in TASKS.items() if t < len(labels)]) for t in range(4)]
    smooth = [F.when(u, F.col(f"q{t}") + 1.0).otherwise(0.0) for t, u in enumerate(used)]
    return shares.select("step_id", "task", *[F.when(u, F.log(x / sum(smooth[1:], smooth[0]))).otherwise(float(np.log(1e-300))).alias(f"p{t}") for t, (u, x) in enumerate(zip(used, smooth))])


class Consensus:
    """The result of a fit: ``items`` and ``raters`` as DataFrames."""

    def __init__(self, items: DataFrame, raters: DataFrame, rounds: int):
        self.items, self.raters, self.rounds = items, raters, rounds


def fit_consensus(ratings: DataFrame, rounds: int = 15, tolerance: float = 2e-3, strength: float = 12.0) -> Consensus:
    """Consensus, agreement and reliability.

    items: work_id, step_id, label, probability, n_votes, n_labels (different ones), agreement (share of agreeing pairs
    of votes; null for a single vote), support (share of the votes for the label). raters: rater_id, n_votes, reliability
    (probability of the right label, averaged over the tasks' labels as they occur) and type (the likeliest).
    ``strength``: of a rater's types, in labels. Ties of the probability go to the label first in the vocabulary. An empty
    table gives empty results. Votes are never collected; they are shuffled once, by item, and in each round only the raters'
    sums are.
    """
    votes, model = Votes(current_votes(ratings)), Communities()
    tally = {f"n{t}": F.when(F.col("code") == t, 1.0).otherwise(0.0) for t in range(4)} | {"n": F.lit(1.0)}
    share = votes.each(lambda v: v, tally).withColumns({f"q{t}": F.col(f"n{t}") / F.col("n") for t in range(4)})
    raters = Raters(share)
    priors = cut(_step_priors(share))
    few = priors.count() <= BROADCAST_KINDS

    def weigh(rows: DataFrame) -> DataFrame:
        rows = raters.weigh(rows, model, strength)
        return rows.join(F.broadcast(priors), ["step_id", "task"]) if few else skew_join(rows, priors, ["step_id", "task"])

    sums = {f"s{t}": F.col(f"l{t}") for t in range(4)}
    done, rows = 0, share
    if not priors.isEmpty():
        for done in range(1, rounds + 1):
            before = model.means()
            for _ in range(3 if done == 1 else 1):  # types and matrices settle on the same counts first
                _settle(raters.type_sums(model), model)
            last = done == rounds or (done > 1 and max(np.abs(model.means()[task] - before[task]).max() for task in TASKS) < tolerance)
            rows = _posterior(votes.each(weigh, sums | tally if last else sums))
            if last:
                break
            raters.update(rows)
    order = [F.when(F.col("task") == "relevance", F.lit(r)).otherwise(F.lit(s)) for r, s in zip((*RELEVANCE, None), STATUS)]
    best = F.greatest(*[F.col(f"q{t}") for t in range(4)])
    place = F.coalesce(*[F.when(F.col(f"q{t}") == F.col("probability"), F.lit(t)) for t in range(4)])
    total = F.col("n")
    items = votes.items(rows, "n", *[f"{c}{t}" for c in "nq" for t in range(4)]).withColumn("probability", best).withColumn("place", place)
    pairs = sum([F.col(f"n{t}") * (F.col(f"n{t}") - 1) for t in range(1, 4)], F.col("n0") * (F.col("n0") - 1))
    items = items.select(
        "work_id", "step_id", F.element_at(F.array(*order), F.col("place") + 1).alias("label"), "probability", total.cast("long").alias("n_votes"),
        sum([(F.col(f"n{t}") > 0).cast("int") for t in range(1, 4)], (F.col("n0") > 0).cast("int")).alias("n_labels"),
        (pairs / F.nullif(total * (total - 1), F.lit(0.0))).alias("agreement"), (F.element_at(F.array("n0", "n1", "n2", "n3"), F.col("place") + 1) / total).alias("support"),
    )
    return Consensus(items, _reliability(raters.table(), model, strength), done)


def _reliability(counts: DataFrame, model: Communities, strength: float) -> DataFrame:
    means = model.means()

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in rows:
            n = _counts(part)
            r = model.types(n)
            right, seen = np.zeros(len(part)), np.zeros(len(part))
            for task in TASKS:
                own = strength * np.einsum("rc,ctl->rtl", r, means[task]) + n[task]
                hit = np.einsum("rtt->rt", own) / own.sum(2)
                weight = n[task].sum(2)
                right += (hit * weight).sum(1)
                seen += weight.sum(1)
            yield pd.DataFrame({"rater_id": part["rater_id"], "n_votes": np.rint(seen).astype(np.int64), "reliability": right / np.maximum(seen, 1e-9), "type": r.argmax(1) if len(part) else np.zeros(0, int)})

    return counts.mapInPandas(run, "rater_id string, n_votes long, reliability double, type int")
