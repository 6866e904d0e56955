import pytest
from pyspark.sql import functions as F

from auditloom.operators import assess, classify, scoring


def test_reconcile_and_verdicts(spark):
    asked = spark.createDataFrame([("d", "S1"), ("d", "S2"), ("d", "S3"), ("d", "S3")], "doc string, step_id string")
    said = spark.createDataFrame([("d", "S1"), ("d", "S3"), ("d", "S3"), ("d", "X")], "doc string, step_id string")
    got = {r.step_id: r.state for r in assess.reconcile(asked, said, ["doc", "step_id"]).collect()}
    assert got == {"S1": "ok", "S2": "missing", "S3": "repeated", "X": "extra"}
    v = spark.createDataFrame([("d", "S1", True, "partial"), ("d", "Z", True, None)], "doc string, step_id string, refuted boolean, proposed string")
    assert {r.step_id: r.refuted for r in assess.with_verdicts(asked.distinct(), v, ["doc", "step_id"]).collect()} == {"S1": True, "S2": False, "S3": False}


def test_suggestions_and_absences(spark):
    s = spark.createDataFrame([("d", "S1", "missing", " LOW "), ("d", "S2", "partial", "odd"), ("d", "S3", "missing", None)], "doc string, step_id string, status string, ease string")
    t = spark.createDataFrame([("d", "S1", "expected"), ("d", "S2", "expected"), ("d", "S3", "recommended")], "doc string, step_id string, tier string")
    got = {r.step_id: (r.severity, r.ease) for r in assess.graded_suggestions(s, t).collect()}
    assert got == {"S1": ("error", "low"), "S2": ("warning", "medium"), "S3": ("warning", "medium")}
    a = s.withColumn("applicable", F.lit(True))
    where = spark.createDataFrame([("d", 1, "s02"), ("d", 0, "s01")], "doc string, section_pos int, section_id string")
    assert {(r.step_id, r.section_id, tuple(r.searched_sections)) for r in assess.absence_records(a, where).collect()} == {("S1", "s01", ("s01", "s02")), ("S3", "s01", ("s01", "s02"))}
    assert {r.section_id for r in assess.absence_records(a, where.limit(0)).collect()} == {"s00"}


def test_rejections_objects_and_clamp(spark):
    runs = spark.createDataFrame([("a", 1, True, False), ("a", 2, False, False), ("b", 1, True, False), ("c", 1, True, False), ("c", 2, True, True)], "k string, n int, rejected boolean, forced boolean")
    assert [r.k for r in assess.standing_rejections(runs, "k", ["n"]).collect()] == ["b"]
    df = spark.createDataFrame([('x {"a": "}\\"", "b": {}} {"c"', 1.5), ("none", float("nan")), (None, None)], "t string, c double")
    got = df.select(assess.first_json_object(F.col("t")).alias("o"), assess.clamp(F.col("c")).alias("c")).collect()
    assert [(r.o, r.c) for r in got] == [('{"a": "}\\"", "b": {}}', 1.0), (None, None), (None, None)]


FACTS = (
    (1, "develops_new_bayesian_model", "yes", "high", "We propose a new hierarchical model of reaction times."),
    (1, "uses_bayesian_model_on_real_data", "yes", "high", "fitted to observed data from 40 participants"),
    (1, "uses_mcmc", "yes", "high", "We sampled the posterior with four chains in Stan."),
    (2, "is_review_tutorial_or_commentary", "yes", "high", "This tutorial reviews prior choice."),
    (2, "uses_mcmc", "yes", "high", "MCMC has a long history."),
    (3, "develops_new_bayesian_method", "yes", "high", "We introduce a new sampler algorithm."),
    (3, "investigates_theoretical_behavior", "yes", "high", "Theorem 1 gives posterior contraction."),
    (3, "is_review_tutorial_or_commentary", "yes", "high", "a short review of samplers"),
    (4, "uses_bayesian_model_on_real_data", "yes", "low", "some data"),
    (5, "develops_new_bayesian_model", "yes", "high", "We develop a weakly-informative prior for variance parameters."),
)
CONTEXTS = (
    (1, "We propose a new hierarchical model of reaction times. It was fitted to observed data from 40 participants. We sampled the posterior with four chains in Stan."),
    (2, "This tutorial reviews prior choice. MCMC has a long history."),
    (3, "We introduce a new sampler algorithm. Theorem 1 gives posterior contraction. First a short review of samplers."),
    (4, "Nothing that matches."),
    (5, "We develop a weakly-informative prior for variance parameters."),
)
SOFTWARE = ((1, 0, "Stan", "high", "We sampled the posterior with four chains in Stan."), (1, 1, "Python", "high", "in Python"), (3, 0, "custom code", "high", "We introduce a new sampler algorithm."), (3, 1, "julia", "high", "x"))


def test_classification_fixtures(spark):
    facts = spark.createDataFrame(FACTS, "doc int, fact_name string, answer string, confidence string, evidence string")
    contexts, software = spark.createDataFrame(CONTEXTS, "doc int, context string"), spark.createDataFrame(SOFTWARE, "doc int, pos int, name string, confidence string, evidence string")
    evidence = spark.createDataFrame([(1, "method.mcmc", "four chains")], "doc int, detector_id string, quote string")
    of = lambda df, c: {r.doc: ",".join(r[c]) for r in df.collect()}
    labels = classify.paper_labels(facts, contexts)
    soft = classify.paper_software(software, contexts, labels)
    assert of(labels, "labels") == {1: "model_development,data_analysis", 2: "review", 3: "method_development,theoretical_analysis", 4: "data_analysis", 5: "method_development"}
    assert of(soft, "software") == {1: "Stan", 2: "", 3: "Custom (Julia)", 4: "Custom", 5: "Custom"}
    assert of(classify.paper_methods(facts, contexts, evidence, soft), "methods") == {1: "mcmc", 2: "", 3: "", 4: "", 5: ""}


SPANS = f"array<{assess.SPAN}>"


def _assessed(spark):
    q = ("judge_quote", "s02", None, "held")
    rows = [
        ("d", "S1", "missing", 1.7, [q, q], [" ", "good"], [("add it", None, "LOW")]), ("d", "S2", "partial", None, None, None, [("more", "how", "odd")]), ("e", "S1", "missing", 0.2, [], [], None),
    ]
    judged = spark.createDataFrame(rows, f"doc string, step_id string, status string, confidence double, evidence {SPANS}, did_well array<string>, suggestions array<struct<text:string,how_to:string,ease:string>>")
    searched = spark.createDataFrame([("d", 1, "s02"), ("d", 0, "s01")], "doc string, section_pos int, section_id string")
    tiers = spark.createDataFrame([("d", "S1", "expected"), ("d", "S2", "expected")], "doc string, step_id string, tier string")
    return judged, assess.to_assessments(judged, searched, tiers)


def test_judgments_become_assessments(spark):
    judged, out = _assessed(spark)
    got = {(r.doc, r.step_id): r for r in out.collect()}
    a = got["d", "S1"]
    assert [(x.kind, x.section_id, x.quote) for x in a.evidence] == [("judge_quote", "s02", "held"), ("absence_search", "s01", "")] and a.confidence == 1.0 and a.did_well == ["good"]
    assert [(x.severity, x.text, x.ease) for x in a.suggestions] == [("error", "add it", "low")] and [(x.severity, x.ease) for x in got["d", "S2"].suggestions] == [("warning", "medium")]
    assert got["d", "S2"].evidence == [] and got["d", "S2"].confidence is None and [x.section_id for x in got["e", "S1"].evidence] == ["s00"]
    with pytest.raises(Exception, match="S9 has the invalid status odd"):
        odd = judged.limit(1).withColumn("status", F.lit("odd")).withColumn("step_id", F.lit("S9"))
        assess.to_assessments(odd, spark.createDataFrame([], "doc string, section_pos int, section_id string"), spark.createDataFrame([], "doc string, step_id string, tier string")).collect()


def test_refutations(spark):
    _, out = _assessed(spark)
    v = [("d", "S1", True, "missing", ("judge_quote", "s03", None, "found"), "It is there. " * 50), ("d", "S2", True, "adequate", None, None), ("e", "S1", False, None, None, "no")]
    verdicts = spark.createDataFrame(v, f"doc string, step_id string, refuted boolean, proposed string, rescue {assess.SPAN}, notes string")
    got = {(r.doc, r.step_id): r for r in assess.apply_refutations(out, verdicts).collect()}
    a, b, c = got["d", "S1"], got["d", "S2"], got["e", "S1"]
    assert a.status == "partial" and [x.quote for x in a.evidence] == ["held", "found"] and len(a.suggestions) == 1 and len(a.notes) <= 400 and a.notes.endswith(".")
    assert b.status == "adequate" and b.suggestions == [] and (c.status, c.challenged, c.refuted) == ("missing", True, False) and c.evidence[0].kind == "absence_search"
    plain = assess.apply_refutations(out, verdicts.limit(0)).collect()
    assert {r.challenged for r in plain} == {False} and {r.status for r in plain} == {"missing", "partial"}


def test_contract_views_and_costs(spark):
    step = "array<struct<step_id:string,applicable:boolean,status:string>>"
    rows = [("ok", "yes", ["a"], [("S1", True)], [("S1", True, "partial")]), ("bad", "no", [], [("S1", True), ("S2", False)], [("S1", False, "partial"), ("S1", True, "not_applicable")]), ("none", "yes", None, [("S1", True)], None)]
    got = {}
    for r in assess.contract_violations(spark.createDataFrame(rows, f"doc string, relevance string, labels array<string>, expected array<struct<step_id:string,applicable:boolean>>, steps {step}")).collect():
        got.setdefault(r.doc, set()).add(r.violation)
    assert got == {"bad": {"irrelevant", "no class", "repeated step", "step left out", "applicability differs", "applicable but not_applicable"}, "none": {"no class", "no steps", "step left out"}}
    e = spark.createDataFrame([("judge_quote",), ("absence_search",), ("method_mention",), (None,)], "kind string")
    assert {r.kind for r in assess.rater_view(e).collect()} == {"method_mention", None}
    row = spark.range(1).select(assess.known_tokens(F.array(F.lit("x"), F.lit("mcmc"), F.lit("mcmc")), ("mcmc", "abc")).alias("k"), assess.tags_or(F.array().cast("array<string>"), F.array(F.lit("i"))).alias("t"), assess.step_rationale(F.array(F.lit("abc")), F.array(F.lit("def")), 5).alias("r")).first()
    assert (row.k, row.t, row.r) == (["mcmc"], ["i"], "abc d")
    calls, prices = spark.createDataFrame([("m", 1_000_000, 500_000), ("free", 5, 5)], "model string, tokens_in long, tokens_out long"), spark.createDataFrame([("m", 1.0, 4.0)], "model string, price_in double, price_out double")
    assert {r.model: r.cost for r in assess.call_costs(calls, prices).collect()} == {"m": 3.0, "free": 0.0}


def test_marginal_deltas_are_those_of_scoring_again(spark):
    steps = spark.createDataFrame([("d", "S1", True, "missing", 1.0), ("d", "S2", True, "partial", 0.5), ("d", "S3", False, "not_applicable", 1.0), ("d", "S4", True, "adequate", 1.0)], "doc string, step_id string, applicable boolean, status string, weight double").withColumn("confidence", F.lit(0.9))
    fixes = spark.createDataFrame([("d", "S1", "adequate"), ("d", "S2", "adequate"), ("d", "S3", "adequate"), ("d", "S9", "partial")], "doc string, step_id string, target string")
    got = {r.step_id: (r.corrected, r.coverage_delta, r.quality_delta) for r in scoring.correction_deltas(steps, fixes).collect()}
    base = scoring.coverage_quality(steps).first()
    for s, to in (("S1", "partial"), ("S2", "adequate")):
        again = scoring.coverage_quality(steps.withColumn("status", F.when(F.col("step_id") == s, to).otherwise(F.col("status")))).first()
        assert got[s][0] == to and abs(got[s][1] - (again.strict - base.strict)) < 1e-12 and abs(got[s][2] - (again.quality - base.quality)) < 1e-12
    assert set(got) == {"S1", "S2"}
