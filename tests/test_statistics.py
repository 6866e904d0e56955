import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditloom.operators import agreement, consensus, scoring

ORDER = ("missing", "partial", "adequate")


def _pairs(spark, cells):
    rows = [(a, b) for (a, b), n in cells.items() for _ in range(n)]
    return spark.createDataFrame(rows or [], "a string, b string")


def test_prevalence_paradox(spark):
    r = agreement.kappa_summary(_pairs(spark, {("t", "t"): 98, ("t", "f"): 1, ("f", "t"): 1}), ("t", "f")).first()
    assert r.agreement == pytest.approx(0.98) and r.kappa < 0.05 and r.ac1 > 0.95


def test_near_misses(spark):
    r = agreement.kappa_summary(_pairs(spark, {("adequate", "adequate"): 4, ("partial", "partial"): 3, ("adequate", "partial"): 2, ("missing", "partial"): 1}), ORDER).first()
    assert r.kappa == pytest.approx(0.4828, abs=1e-4) and r.kappa_linear == pytest.approx(0.5161, abs=1e-4)


def test_degenerate(spark):
    assert agreement.kappa_summary(_pairs(spark, {("missing", "missing"): 5}), ORDER).first().kappa == 1.0
    empty = agreement.kappa_summary(_pairs(spark, {}), ORDER).first()
    assert (empty.n, empty.kappa, empty.ac1) == (0, None, None)


def test_absence_rates_and_confusion(spark):
    p = _pairs(spark, {("adequate", "missing"): 1, ("partial", "missing"): 1, ("missing", "missing"): 1, ("not_applicable", "missing"): 1, ("missing", "partial"): 1, ("missing", "adequate"): 1, ("missing", "not_applicable"): 1})
    got = {r.rate: (r.x, r.n) for r in agreement.absence_rates(p).collect()}
    assert got == {"false_absence_strict": (1, 3), "false_absence_broad": (2, 3), "absence_missed": (2, 3)}
    c = agreement.confusion(p, (*ORDER, "not_applicable")).collect()
    assert len(c) == 16 and sum(r.n for r in c) == 7


def test_rates_intervals_and_icc(spark):
    b = spark.createDataFrame([(True, True), (True, False), (False, False), (False, True)], "a boolean, b boolean")
    assert {r.rate: r.value for r in agreement.binary_rates(b).collect()} == {"sensitivity": 0.5, "specificity": 0.5, "accuracy": 0.5}
    w = spark.createDataFrame([(5, 10), (0, 0), (0, 4)], "x int, n int").select("n", agreement.wilson(F.col("x"), F.col("n")).alias("w"))
    got = {r.n: r.w for r in w.collect()}
    assert (got[10].lo, got[10].hi) == (pytest.approx(0.2366, abs=1e-4), pytest.approx(0.7634, abs=1e-4)) and got[0] is None and got[4].lo == 0.0
    num = lambda rows: agreement.icc_a1(spark.createDataFrame(rows, "a double, b double")).first().icc
    assert num([(0.1, 0.1), (0.5, 0.5), (0.9, 0.9)]) == pytest.approx(1.0) and num([(0.1, 0.2)]) is None and num([(0.5, 0.5), (0.5, 0.5)]) is None and num([]) is None


def test_bootstrap_is_reproducible(spark):
    rows = [(u, a, b) for u in range(20) for a, b in ((("missing", "missing"), ("adequate", "adequate")) if u % 4 else (("missing", "adequate"), ("partial", "partial")))]
    df = spark.createDataFrame(rows, "u int, a string, b string")
    one = agreement.bootstrap_kappa(df, "u", ORDER, resamples=50, seed=3).first()
    two = agreement.bootstrap_kappa(df.repartition(7), "u", ORDER, resamples=50, seed=3).first()
    point = agreement.kappa_summary(df, ORDER).first().kappa
    assert one == two and one.lo <= point <= one.hi


def test_pair_cells_match_pairs(spark):
    rows = [(f"w{i % 7}", "S1", f"r{i}", bool(i % 5), ORDER[i % 3] if i % 11 else None) for i in range(60)]
    s = spark.createDataFrame(rows, "work_id string, step_id string, rater_id string, applicable boolean, status string")
    fast = {(r.a, r.b): r.n for r in agreement.pair_cells(s).collect()}
    slow = {}
    for r in agreement.rater_pairs(s).filter("a IS NOT NULL AND b IS NOT NULL").collect():
        k = tuple(sorted((r.a, r.b)))
        slow[k] = slow.get(k, 0) + 1
    assert fast == slow


STEPS = "doc int, step_id string, applicable boolean, status string, weight double, confidence double"
EXAMPLE = {"S1": "adequate", "S2": "adequate", "S3": "partial", "S4": "adequate", "S5": "missing", "S6": "not_applicable", "S7": "missing", "S8": "adequate", "S9": "partial", "S10": "adequate"}


def test_worked_example(spark):
    rows = [(1, s, v != "not_applicable", v, 0.5 if s == "S7" else 1.0, 0.9) for s, v in EXAMPLE.items()]
    df = spark.createDataFrame(rows, STEPS)
    r = scoring.coverage_quality(df).first()
    assert (r.n_applicable, r.n_na, r.n_uncertain) == (9, 1, 0) and r.strict == r.lenient == pytest.approx(7 / 9) and r.quality == pytest.approx(6 / 8.5)
    gains = {x.step_id: (x.coverage_delta, x.quality_delta) for x in scoring.score_impacts(df).collect()}
    assert gains.keys() == {"S3", "S5", "S7", "S9"} and gains["S3"] == (0, pytest.approx(0.5 / 8.5)) and gains["S5"] == (pytest.approx(1 / 9), pytest.approx(1 / 8.5)) and gains["S7"][1] == pytest.approx(0.5 / 8.5)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([*ORDER, "not_applicable"]), st.floats(0.1, 5), st.floats(0, 1)), max_size=12))
def test_scoring_invariants(spark, steps):
    rows = [(1, f"S{i}", s != "not_applicable", s, w, c) for i, (s, w, c) in enumerate(steps)]
    df = spark.createDataFrame(rows, STEPS)
    got = scoring.coverage_quality(df).collect()
    more = scoring.coverage_quality(spark.createDataFrame([*rows, (1, "X", False, "not_applicable", 1.0, 0.5)], STEPS)).first()
    if not rows:
        assert got == [] and more.strict is None
        return
    r = got[0]
    if r.n_applicable:
        assert r.strict <= r.lenient and (more.strict, more.lenient) == (r.strict, r.lenient) and more.quality == pytest.approx(r.quality)
        assert all(x.coverage_delta >= 0 and x.quality_delta >= -1e-12 for x in scoring.score_impacts(df).collect())
    else:
        assert (r.strict, r.quality) == (None, None)


def test_multi_label_weights(spark):
    steps = spark.createDataFrame([(1, "S3"), (1, "S7"), (2, "S7"), (3, "S3")], "doc int, step_id string")
    labels = spark.createDataFrame([(1, "model_development"), (1, "data_analysis"), (2, "data_analysis")], "doc int, label string")
    w = scoring.weight_table(spark, {"model_development": {"S3": 0.5}, "data_analysis": {"S7": 0.5}})
    assert {(r.doc, r.step_id): r.weight for r in scoring.step_weights(steps, labels, w).collect()} == {(1, "S3"): 1.0, (1, "S7"): 1.0, (2, "S7"): 0.5, (3, "S3"): 1.0}


def test_status_moves(spark):
    rows = [("missing", "adequate", "partial"), ("adequate", "missing", "partial"), ("partial", "partial", "partial"), ("not_applicable", "adequate", "not_applicable"), ("missing", None, "missing")]
    df = spark.createDataFrame(rows, "s string, t string, w string").select("w", scoring.one_level_toward(F.col("s"), F.col("t")).alias("o"))
    assert all(r.o == r.w for r in df.collect())
    up = [("missing", True, None, "partial"), ("missing", True, "adequate", "adequate"), ("partial", True, "missing", "adequate"), ("missing", False, "adequate", "missing")]
    df = spark.createDataFrame(up, "s string, r boolean, p string, w string").select("w", scoring.upgrade_refuted(F.col("s"), F.col("r"), F.col("p")).alias("o"))
    assert all(r.o == r.w for r in df.collect())


def test_fix_order(spark):
    s = spark.createDataFrame([(1, "S2", 0, "warning", "a", "low"), (1, "S10", 1, "warning", "b", "low"), (1, "S3", 2, "error", "c", "high"), (1, "S9", 3, "info", "d", "low")], "doc int, step_id string, pos int, severity string, text string, ease string")
    none = spark.createDataFrame([], "doc int, step_id string, weight double, coverage_delta double, quality_delta double")
    assert [r.text for r in scoring.fix_list(s, none, none).orderBy("fix_rank").collect()] == ["c", "b", "a", "d"]


def test_majority_needs_more_than_half(spark):
    df = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "a"), ("y", "a"), ("y", "b"), ("z", None)], "k string, v string")
    assert [(r.k, r.v) for r in consensus.majority(df, ["k"], "v").collect()] == [("y", "a")]
