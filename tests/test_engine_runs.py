"""Engine runs against the consensus, on a case small enough to work out by hand."""

import datetime as dt
import json

from pyspark.sql import functions as F

from auditloom.operators import agreement, engine_runs

SCHEMA = "record_id long, record_kind string, work_id string, received_at timestamp, payload string, run int"


def _scored(work, *steps):
    return json.dumps({"work_id": work, "step_assessments": [{"step_id": s, "applicable": a, "status": st, "confidence": 0.5} for s, a, st in steps]})


def _records(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    rows = [
        (1, "scored_result", "w1", day(1), _scored("w1", ("S1", True, "missing"), ("S2", True, "partial")), 0), (2, "scored_result", "w1", day(3), _scored("w1", ("S1", True, "adequate"), ("S1", True, "partial"), ("S2", False, "not_applicable")), 0),
        (2, "scored_result", "w1", day(3), _scored("w1", ("S1", True, "adequate"), ("S1", True, "partial"), ("S2", False, "not_applicable")), 0), (3, "scored_result", "w1", None, _scored("w1", ("S9", True, "partial")), 0), (4, "scored_result", None, day(1), "torn {", 0),
        (5, "human_report", "w1", day(1), json.dumps({"work_id": "w1", "tier": "B"}), 0), (6, "human_report", "w1", day(2), json.dumps({"work_id": "w1", "tier": "A"}), 0), (7, "scored_result", "w2", day(1), None, 0),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_runs_tiers_and_pairs(spark):
    r = _records(spark)
    engine = engine_runs.engine_steps(r)
    assert {(x.run, x.step_id, x.status, x.applicable) for x in engine.collect()} == {(1, "S1", "partial", True), (1, "S2", "not_applicable", False), (2, "S1", "missing", True), (2, "S2", "partial", True)}
    assert [tuple(x) for x in engine_runs.latest_tiers(r).collect()] == [("w1", "A")]
    assert [(x.step_id, x.a, x.b) for x in engine_runs.retest_pairs(engine).collect()] == [("S1", "partial", "missing")]
    agreed = spark.createDataFrame([("w1", "S1", True, "partial"), ("w1", "S5", True, "missing"), ("w9", "S1", True, "partial")], "work_id string, step_id string, applicable boolean, status string")
    assert [(x.step_id, x.a, x.b) for x in engine_runs.against_consensus(agreed, engine).collect()] == [("S1", "partial", "partial")]
    assert {(x.step_id, x.engine, x.agree) for x in engine_runs.single_cases(agreed, engine).collect()} == {("S1", "partial", True), ("S5", "—", False)}
    rows = {x.metric: (x.value, x.n, x.preliminary) for x in engine_runs.validation_rows(agreed, engine, engine_runs.latest_tiers(r), spark.createDataFrame([("w1",)], "work_id string"), ("missing", "partial", "adequate")).collect()}
    assert rows["n_papers"] == (1.0, 1, True) and rows["n_excluded"][0] == 0.0 and rows["step_agreement"] == (1.0, 1, True) and rows["retest_agreement"] == (0.0, 1, True)
    none = {x.metric: x.value for x in engine_runs.validation_rows(agreed.limit(0), engine.limit(0), engine_runs.latest_tiers(r).limit(0), agreed.limit(0), ("missing", "partial", "adequate")).collect()}
    assert none["n_papers"] == 0 and none["step_kappa"] is None


def test_bootstrap_takes_any_statistic(spark):
    units = spark.range(400).select(F.concat(F.lit("u"), F.col("id")).alias("u"), (F.col("id") % 4 == 0).cast("int").alias("x"), F.lit(1).alias("n"))
    row = agreement.bootstrap(units, "u", ["x", "n"], lambda s: s["x"] / s["n"], resamples=400).first()
    # a share of 0.25 in 400: the standard error is 0.0217
    assert row.n_resamples == 400 and abs(row.lo - (0.25 - 1.96 * 0.0217)) < 0.01 and abs(row.hi - (0.25 + 1.96 * 0.0217)) < 0.01
    assert agreement.bootstrap(units, "u", ["x", "n"], lambda s: s["x"] / s["n"], resamples=400).first() == row
    assert agreement.bootstrap(units.limit(0), "u", ["x", "n"], lambda s: s["x"] / s["n"]).first().n_resamples == 0
