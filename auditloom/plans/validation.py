"""Queries of ratings, consensus, agreement and scoring, on the ratings and report tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators import agreement, assess, consensus, nested_json, ratings, scoring
from auditloom.plans import records
from auditloom.session import cut

ORDER = ratings.STATUSES
# The weights of the default rubric: some steps count half for some kinds of paper, all others fully.
WEIGHTS = {"data_analysis": {"S7": 0.5}} | {k: {"S3": 0.5, "S5": 0.5, "S8": 0.5} for k in ("model_development", "method_development", "software_development", "numerical_analysis", "theoretical_analysis")}
FULL_WEIGHTS = {label: {s: by.get(s, 1.0) for s in scoring.STEPS} for label, by in WEIGHTS.items()}


def _current(spark: SparkSession, d: str) -> DataFrame:
    return ratings.current_ratings(spark.read.parquet(f"{d}/ratings.parquet"))


def _steps(spark: SparkSession, d: str) -> DataFrame:
    return ratings.step_rows(_current(spark, d))


def _forms(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The current forms with the steps' grades and the named columns only."""
    return ratings.graded_forms(spark.read.parquet(f"{d}/ratings.parquet"), *columns)


def _grades(spark: SparkSession, d: str) -> DataFrame:
    return ratings.graded_steps(_forms(spark, d))


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return _cells_of(_grades(spark, d))


def _cells_of(s: DataFrame, agreed: DataFrame | None = None) -> DataFrame:
    """Consensus (a) against each rater (b) on the same step."""
    c = (consensus.consensus_steps(s) if agreed is None else agreed).select("work_id", "step_id", F.col("status").alias("a"), F.col("applicable").alias("a_applies"))
    return s.filter(F.col("status").isNotNull()).join(c, ["work_id", "step_id"]).select("work_id", "step_id", "rater_id", "a", F.col("status").alias("b"), "a_applies", F.col("applicable").alias("b_applies"), "confidence")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


def rating_steps_current(spark: SparkSession, d: str) -> DataFrame:
    return _steps(spark, d).groupBy("step_id", "status", "applicable").agg(F.count(F.lit(1)).alias("n"), F.sum("n_evidence").cast("long").alias("n_evidence"))


def rating_counts(spark: SparkSession, d: str) -> DataFrame:
    return _forms(spark, d).groupBy("work_id").agg(F.count(F.lit(1)).alias("n_raters"))


def step_violations(spark: SparkSession, d: str) -> DataFrame:
    return ratings.step_violations(_steps(spark, d))


def form_violations(spark: SparkSession, d: str) -> DataFrame:
    return ratings.form_violations(_forms(spark, d, "relevance_label", "relevance_rationale", "paper_class_labels", "gate_facts"))


def gold_admissibility(spark: SparkSession, d: str) -> DataFrame:
    c = _forms(spark, d, "relationship", "source_sha256", "relevance_label")
    return ratings.admissibility(c, consensus.consensus_relevance(c)).select("work_id", "n_raters", F.array_join("violations", "; ").alias("violations"))


def incomplete_forms(spark: SparkSession, d: str) -> DataFrame:
    """Against the first nine steps, so that the tenth comes out as extra."""
    out = ratings.incomplete_forms(_forms(spark, d), list(scoring.STEPS[:9]))
    return out.select("work_id", "rater_id", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"))


def consensus_steps(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(consensus.consensus_steps(_grades(spark, d)), "confidence")


def consensus_evidence(spark: SparkSession, d: str) -> DataFrame:
    s = _steps(spark, d)
    return consensus.consensus_evidence(s, consensus.consensus_steps(s)).select("work_id", "step_id", "span_pos", "section_id", "page", "quote")


def consensus_labels(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus_labels(_forms(spark, d, "paper_class_labels"))


def consensus_gates(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus_gates(_forms(spark, d, "gate_facts"))


def consensus_relevance(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus_relevance(_forms(spark, d, "relevance_label"))


def no_consensus_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps of a work without a majority, in natural order."""
    s = _grades(spark, d)
    left = s.filter(F.col("applicable").isNotNull()).select("work_id", "step_id").distinct().join(consensus.consensus_steps(s), ["work_id", "step_id"], "left_anti")
    ordered = left.groupBy("work_id").agg(F.array_sort(F.collect_set(consensus.step_order(F.col("step_id")))).alias("o"))
    return ordered.select("work_id", F.array_join(F.transform("o", lambda x: x["id"]), ",").alias("steps"))


def agreement_summary(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d)
    per = agreement.kappa_summary(cells, ORDER, by=["step_id"])
    return _rounded(per, "agreement", "kappa", "kappa_linear", "kappa_quadratic", "ac1")


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return agreement.confusion(_cells(spark, d), (*ORDER, "not_applicable"))


def absence_rates(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(agreement.absence_rates(_cells(spark, d)), "value")


def sens_spec_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return _relevance_rates(_forms(spark, d, "relevance_label"))


def _relevance_rates(c: DataFrame) -> DataFrame:
    pairs = c.join(consensus.consensus_relevance(c).select("work_id", "relevance"), "work_id").select((F.col("relevance") != "no").alias("a"), (ratings.status_of(F.col("relevance_label")) != "no").alias("b"))
    return _rounded(agreement.binary_rates(pairs), "value")


def class_set_accuracy(spark: SparkSession, d: str) -> DataFrame:
    c = _forms(spark, d, "paper_class_labels")
    human = consensus.consensus_labels(c).groupBy("work_id").agg(F.array_join(F.array_sort(F.collect_set("label")), "|").alias("a"))
    pairs = c.select("work_id", F.array_join(F.array_sort(F.array_distinct("paper_class_labels")), "|").alias("b")).join(human, "work_id")
    return pairs.agg(F.count(F.when(F.col("a") == F.col("b"), 1)).alias("x"), F.count(F.lit(1)).alias("n")).withColumn("value", F.round(agreement.ratio(F.col("x"), F.col("n")), 9))


def wilson_intervals(spark: SparkSession, d: str) -> DataFrame:
    rates = _cells(spark, d).groupBy("step_id").agg(F.count(F.when(F.col("a") == F.col("b"), 1)).alias("x"), F.count(F.lit(1)).alias("n"))
    w = agreement.wilson(F.col("x"), F.col("n"))
    return rates.select("step_id", "x", "n", F.round(w["lo"], 9).alias("lo"), F.round(w["hi"], 9).alias("hi"))


def inter_rater_pairs(spark: SparkSession, d: str) -> DataFrame:
    return agreement.pair_cells(_grades(spark, d))


def bootstrap_kappa_ci(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(agreement.bootstrap_kappa(_cells(spark, d), "work_id", ORDER), "lo", "hi")


def _graded(spark: SparkSession, d: str) -> DataFrame:
    """Each form as a document with weighted steps."""
    return _graded_of(spark, _forms(spark, d, "paper_class_labels"))


def _graded_of(spark: SparkSession, c: DataFrame) -> DataFrame:
    doc = F.concat_ws("/", "work_id", "rater_id")
    steps = ratings.graded_steps(c).filter(F.col("status").isNotNull()).withColumn("doc", doc).select("doc", "work_id", "step_id", "applicable", "status", "confidence")
    labels = c.select(doc.alias("doc"), F.explode("paper_class_labels").alias("label"))
    return scoring.step_weights(steps, labels, scoring.weight_table(spark, FULL_WEIGHTS))


def step_weights_multilabel(spark: SparkSession, d: str) -> DataFrame:
    return _graded(spark, d).groupBy("step_id", "weight").agg(F.count(F.lit(1)).alias("n"))


def coverage_quality(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scoring.coverage_quality(_graded(spark, d)), "strict", "lenient", "quality")


def score_impacts(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scoring.score_impacts(_graded(spark, d)), "coverage_delta", "quality_delta")


def icc_scores(spark: SparkSession, d: str) -> DataFrame:
    """Coverage by the consensus against coverage by each rater."""
    return _icc_of(consensus.consensus_steps(_grades(spark, d)), _graded(spark, d))


def _icc_of(agreed: DataFrame, mine: DataFrame) -> DataFrame:
    human = agreed.select(F.col("work_id").alias("doc"), "step_id", "applicable", "status", "confidence", F.lit(1.0).alias("weight"))
    both = scoring.coverage_quality(human).select(F.col("doc").alias("work_id"), F.col("strict").alias("a")).join(scoring.coverage_quality(mine, ["work_id", "doc"]).select("work_id", F.col("strict").alias("b")), "work_id")
    return _rounded(agreement.icc_a1(both), "icc")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """The raters' graded steps as judgments: the rationale is the praise, the missing subtag the suggestion."""
    s = _steps(spark, d).filter(F.col("status").isin(*ORDER))
    spans = F.transform("evidence", lambda e: F.struct(F.lit("judge_quote").alias("kind"), e["section_id"].alias("section_id"), e["page"].alias("page"), e["quote"].alias("quote")))
    asked = F.when(F.col("missing_subtag").isNotNull(), F.array(F.struct(F.col("missing_subtag").alias("text"), F.lit(None).cast("string").alias("how_to"), F.lit(" Low").alias("ease"))))
    return s.select(F.concat_ws("/", "work_id", "rater_id").alias("doc"), "work_id", "step_id", "status", "confidence", spans.alias("evidence"), F.array(F.coalesce("rationale", F.lit(""))).alias("did_well"), asked.alias("suggestions"))


def _assessed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    j = _judged(spark, d)
    searched = j.groupBy("doc").agg(F.min(F.get("evidence", F.lit(0))["section_id"]).alias("section_id")).filter("section_id IS NOT NULL").withColumn("section_pos", F.lit(0))
    tiers = j.select("doc", "step_id").distinct().withColumn("tier", F.when(F.col("step_id").isin("S1", "S2", "S3"), "expected").when(F.col("step_id").isin("S4", "S5"), "recommended"))
    return assess.to_assessments(j, searched, tiers), j


def _flat(a: DataFrame) -> DataFrame:
    """An assessment in columns that compare: the spans as text, the suggestions' severities and eases."""
    spans = F.array_join(F.transform("evidence", lambda e: F.concat_ws("|", e["kind"], e["section_id"], e["quote"])), "\n")
    return a.withColumns({"spans_md5": F.md5(spans), "n_praise": F.size("did_well"), "asked": F.array_join(F.transform("suggestions", lambda x: F.concat_ws("/", x["severity"], x["ease"], x["text"])), ",")})


def judgment_assessments(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_assessed(spark, d)[0]).select("doc", "step_id", "status", "confidence", "spans_md5", "n_praise", "asked")


def refuted_assessments(spark: SparkSession, d: str) -> DataFrame:
    """Absences of a rater on steps for which the consensus found something are refuted, with a rescuing quote."""
    a, j = _assessed(spark, d)
    found = consensus.consensus_steps(_grades(spark, d)).filter("status IN ('partial', 'adequate')").select("work_id", "step_id", F.col("status").alias("proposed"))
    v = j.filter("status = 'missing'").select("doc", "work_id", "step_id").join(found, ["work_id", "step_id"], "left")
    rescue = F.when(F.col("proposed").isNotNull(), F.struct(F.lit("judge_quote").alias("kind"), F.lit("s01").alias("section_id"), F.lit(None).cast("int").alias("page"), F.lit("rescued").alias("quote")))
    v = v.select("doc", "step_id", F.col("proposed").isNotNull().alias("refuted"), "proposed", rescue.alias("rescue"), F.lit("checked").alias("notes"))
    return _flat(assess.apply_refutations(a, v)).select("doc", "step_id", "status", "spans_md5", "asked", "challenged", "refuted")


def correction_deltas(spark: SparkSession, d: str) -> DataFrame:
    """What moving each step of a form one level toward the consensus changes by itself."""
    target = consensus.consensus_steps(_grades(spark, d)).select("work_id", "step_id", F.col("status").alias("target"))
    g = _graded(spark, d)
    fixes = g.select("doc", "work_id", "step_id").join(target, ["work_id", "step_id"]).select("doc", "step_id", "target")
    return _rounded(scoring.correction_deltas(g, fixes), "coverage_delta", "quality_delta")


def refutation_upgrade(spark: SparkSession, d: str) -> DataFrame:
    """A rater's absence counts as refuted where the consensus found the step, which proposes its status."""
    c = _cells(spark, d)
    up = scoring.upgrade_refuted(F.col("b"), (F.col("b") == "missing") & (F.col("a") != "missing"), F.col("a"))
    return c.filter(F.col("b_applies")).groupBy(F.col("b").alias("status"), F.col("a").alias("proposed"), up.alias("upgraded")).agg(F.count(F.lit(1)).alias("n"))


def override_rescore(spark: SparkSession, d: str) -> DataFrame:
    """Coverage and quality after each form is moved one level toward the consensus."""
    g = _graded(spark, d)
    target = consensus.consensus_steps(_grades(spark, d)).select("work_id", "step_id", F.col("status").alias("target"))
    fixes = g.select("doc", "work_id", "step_id").join(target, ["work_id", "step_id"]).select("doc", "step_id", "target")
    done = scoring.apply_corrections(g, fixes).withColumn("status", F.col("corrected"))
    return _rounded(scoring.coverage_quality(done).select("doc", "present", "strict", "quality"), "strict", "quality")


def fix_list(spark: SparkSession, d: str) -> DataFrame:
    """Suggestions of scored results, ranked; weights and impacts from the results' own steps."""
    flat = nested_json.flatten_reports(spark.read.parquet(f"{d}/report_records.parquet")).filter("rating_pos = -1").dropDuplicates(["record_id", "tbl", "rating_pos", "step_pos", "child_pos"])
    steps = nested_json.table_of(flat, "step").filter("step_id IS NOT NULL AND status IS NOT NULL")
    graded = steps.groupBy(F.col("record_id").alias("doc"), "step_id").agg(F.max_by(F.struct("applicable", "status"), "step_pos").alias("x"), F.min("step_pos").alias("step_pos"))
    graded = graded.select("doc", "step_id", (F.col("x.applicable") == "true").alias("applicable"), F.col("x.status").alias("status"), F.when(F.col("step_id").isin("S3", "S5", "S8"), 0.5).otherwise(1.0).alias("weight"))
    asked = nested_json.table_of(flat, "suggestion").join(steps.select("record_id", "step_pos", "step_id"), ["record_id", "step_pos"])
    asked = asked.select(F.col("record_id").alias("doc"), "step_id", F.struct("step_pos", "child_pos").alias("pos"), "severity", "text", "ease")
    out = scoring.fix_list(asked, graded, scoring.score_impacts(graded))
    return _rounded(out.select("doc", "fix_rank", "step_id", "severity", "ease", "weight", "text", "coverage_delta", "quality_delta"), "coverage_delta", "quality_delta")


def validation_report(spark: SparkSession, d: str) -> DataFrame:
    """The headline figures of raters against their consensus as rows: metric, value, n. Forms, grades and consensus are computed once."""
    forms = cut(_forms(spark, d, "relevance_label", "paper_class_labels"))
    grades = ratings.graded_steps(forms)
    agreed = cut(consensus.consensus_steps(grades))
    cells = cut(_cells_of(grades, agreed).select("a", "b", "a_applies", "b_applies"))
    k = agreement.kappa_summary(cells.filter("a_applies AND b_applies"), ORDER)
    stats = k.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.col("n").alias("n")) for m in ("agreement", "kappa", "kappa_linear", "ac1")])).alias("x")).select("x.*")
    rates = agreement.absence_rates(cells).select(F.col("rate").alias("metric"), "value", "n").unionByName(_relevance_rates(forms).select(F.concat(F.lit("relevance_"), "rate").alias("metric"), "value", "n"))
    icc = _icc_of(agreed, _graded_of(spark, forms)).select(F.lit("coverage_icc").alias("metric"), F.col("icc").alias("value"), "n")
    return _rounded(stats.unionByName(rates).unionByName(icc), "value").withColumn("preliminary", F.col("n") < 15)


def rater_relationships(spark: SparkSession, d: str) -> DataFrame:
    return _forms(spark, d, "relationship").groupBy("relationship").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rater_id").alias("n_raters"))


def batch_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Steps of scored results against the ten of the rubric."""
    flat = nested_json.flatten_reports(spark.read.parquet(f"{d}/report_records.parquet")).filter("rating_pos = -1").dropDuplicates(["record_id", "tbl", "rating_pos", "step_pos", "child_pos"])
    judged = nested_json.table_of(flat, "step").filter("step_id IS NOT NULL").select("record_id", "step_id")
    asked = judged.select("record_id").distinct().withColumn("step_id", F.explode(F.array(*map(F.lit, scoring.STEPS))))
    return assess.reconcile(asked, judged, ["record_id", "step_id"]).groupBy("step_id", "state").agg(F.count(F.lit(1)).alias("n"))


def assemble_goldset(spark: SparkSession, d: str) -> DataFrame:
    c = _current(spark, d)
    return assess.assemble_gold(c, consensus.consensus_relevance(c), consensus.consensus_labels(c))


def absence_records(spark: SparkSession, d: str) -> DataFrame:
    """Missing steps of the consensus with the sections of their source document that were searched."""
    from auditloom.operators import detect

    c = _current(spark, d)
    docs = spark.read.parquet(f"{d}/parsed_docs.parquet").dropDuplicates(["doc_key"])
    keys = docs.select(F.col("source_doc.sha256").alias("source_sha256"), "doc_key").join(c.select("source_sha256", F.col("work_id").alias("doc")).distinct(), "source_sha256")
    searched = detect.sections_of(docs).filter("kind <> 'references' AND length(text) > 0").join(keys.groupBy("doc").agg(F.min("doc_key").alias("doc_key")), "doc_key").select("doc", "section_pos", "section_id")
    missing = consensus.consensus_steps(ratings.step_rows(c)).select(F.col("work_id").alias("doc"), "step_id", "applicable", "status")
    return assess.absence_records(missing, searched).select("doc", "step_id", "section_id", F.array_join("searched_sections", ",").alias("searched"))


QUERIES = (
    batch_reconcile, assemble_goldset, absence_records, rating_steps_current, rating_counts, step_violations, form_violations, gold_admissibility, incomplete_forms, consensus_steps, consensus_evidence, consensus_labels, consensus_gates,
    consensus_relevance, no_consensus_steps, agreement_summary, confusion_matrix, absence_rates, sens_spec_accuracy, class_set_accuracy, wilson_intervals, inter_rater_pairs, bootstrap_kappa_ci,
    step_weights_multilabel, coverage_quality, score_impacts, icc_scores, refutation_upgrade, override_rescore, fix_list, validation_report, rater_relationships, judgment_assessments, refuted_assessments, correction_deltas,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def sql_parts() -> dict[str, str]:
    """Common table expressions of this module's SQL that other modules use too."""
    return {k: v for k, v in _sql()[0].items() if isinstance(v, str)}


def oracle_sql() -> dict[str, str]:
    return _sql()[1]


def _sql() -> tuple[dict, dict[str, str]]:
    status = lambda c: f"CASE WHEN regexp_replace(trim(lower({c})), '[\\s-]+', '_', 'g') IN ('n/a', 'na') THEN 'not_applicable' ELSE nullif(regexp_replace(trim(lower({c})), '[\\s-]+', '_', 'g'), '') END"
    cur = "cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY work_id, rater_id ORDER BY rated_at DESC NULLS LAST, rating_id DESC) AS rn FROM (SELECT DISTINCT * FROM ratings)) WHERE rn = 1)"
    steps = f"steps AS (SELECT work_id, rater_id, relationship, paper_class_labels, s.step_id AS step_id, s.applicable AS applicable, {status('s.status')} AS status, s.confidence AS confidence, coalesce(len(s.evidence), 0) AS n_evidence, s.rationale AS rationale, s.missing_subtag AS missing_subtag, s.evidence AS evidence FROM (SELECT *, unnest(steps) AS s FROM cur))"
    cons = """side AS (SELECT work_id, step_id, applicable, count(*) AS n, sum(count(*)) OVER (PARTITION BY work_id, step_id) AS total FROM steps WHERE applicable IS NOT NULL GROUP BY work_id, step_id, applicable),
        win AS (SELECT work_id, step_id, applicable FROM side WHERE n * 2 > total),
        vote AS (SELECT work_id, step_id, status, count(*) AS n, avg(confidence) AS confidence, sum(count(*)) OVER (PARTITION BY work_id, step_id) AS total FROM steps JOIN win USING (work_id, step_id, applicable) WHERE applicable AND status IS NOT NULL GROUP BY work_id, step_id, status),
        cons AS (SELECT work_id, step_id, TRUE AS applicable, status, confidence, n AS n_agree FROM vote WHERE n * 2 > total
            UNION ALL SELECT work_id, step_id, FALSE, 'not_applicable', avg(confidence), count(*) FROM steps JOIN win USING (work_id, step_id, applicable) WHERE NOT applicable GROUP BY work_id, step_id)"""
    cells = "cells AS (SELECT s.work_id, s.step_id, s.rater_id, c.status AS a, s.status AS b, c.applicable AS a_applies, s.applicable AS b_applies FROM steps s JOIN cons c USING (work_id, step_id) WHERE s.status IS NOT NULL)"
    rel = f"relv AS (SELECT work_id, {status('relevance_label')} AS relevance FROM cur), relc AS (SELECT work_id, relevance, count(*) AS votes, sum(count(*)) OVER (PARTITION BY work_id) AS n FROM relv WHERE relevance IS NOT NULL GROUP BY work_id, relevance), rel AS (SELECT * FROM relc WHERE votes * 2 > n)"
    lab = "lab AS (SELECT l.work_id, label, count(*) AS votes, any_value(n_raters) AS n_raters FROM (SELECT DISTINCT work_id, rater_id, unnest(paper_class_labels) AS label FROM cur) l JOIN (SELECT work_id, count(*) AS n_raters FROM cur GROUP BY 1) r USING (work_id) GROUP BY l.work_id, label HAVING count(*) * 2 > any_value(n_raters))"
    weights = ", ".join(f"('{k}', '{s}', {w})" for k, by in FULL_WEIGHTS.items() for s, w in by.items())
    graded = f"""w(label, step_id, weight) AS (VALUES {weights}), labels AS (SELECT DISTINCT work_id || '/' || rater_id AS doc, unnest(paper_class_labels) AS label FROM cur),
        graded AS (SELECT work_id || '/' || rater_id AS doc, s.work_id, s.step_id, s.applicable, s.status, s.confidence, coalesce((SELECT max(coalesce(w.weight, 1.0)) FROM labels l LEFT JOIN w ON w.label = l.label AND w.step_id = s.step_id WHERE l.doc = s.work_id || '/' || s.rater_id), 1.0) AS weight FROM steps s WHERE status IS NOT NULL)"""
    sub = lambda c="status": f"CASE {c} WHEN 'adequate' THEN 1.0 WHEN 'partial' THEN 0.5 WHEN 'missing' THEN 0.0 END"
    score = lambda t, by="doc", st="status": f"SELECT {by}, count(*) FILTER (applicable) AS n_applicable, count(*) FILTER (NOT applicable) AS n_na, count(*) FILTER (applicable AND {st} = 'missing' AND confidence < 0.6) AS n_uncertain, count(*) FILTER (applicable AND {st} IN ('adequate', 'partial')) AS present, round(count(*) FILTER (applicable AND {st} IN ('adequate', 'partial')) / nullif(count(*) FILTER (applicable), 0)::DOUBLE, 9) AS strict, round((count(*) FILTER (applicable AND {st} IN ('adequate', 'partial')) + count(*) FILTER (applicable AND {st} = 'missing' AND confidence < 0.6)) / nullif(count(*) FILTER (applicable), 0)::DOUBLE, 9) AS lenient, round(sum(weight * {sub(st)}) FILTER (applicable)::DOUBLE / nullif(sum(weight) FILTER (applicable), 0)::DOUBLE, 9) AS quality FROM {t} GROUP BY {by}"
    kap = """codes AS (SELECT * FROM (VALUES ('missing', 0), ('partial', 1), ('adequate', 2)) v(s, i)),
        used AS (SELECT {by} g, x.i AS i, y.i AS j FROM {t} JOIN codes x ON x.s = a JOIN codes y ON y.s = b {where}),
        tot AS (SELECT g, count(*)::DOUBLE AS n, avg((i = j)::INT) AS po, avg(1 - abs(i - j) / 2.0) AS pl, avg(1 - (abs(i - j) / 2.0) ** 2) AS pq FROM used GROUP BY g),
        r AS (SELECT g, i, count(*)::DOUBLE AS n FROM used GROUP BY ALL), c AS (SELECT g, j, count(*)::DOUBLE AS n FROM used GROUP BY ALL),
        e AS (SELECT r.g, sum(r.n * c.n * (i = j)::INT) AS eo, sum(r.n * c.n * (1 - abs(i - j) / 2.0)) AS el, sum(r.n * c.n * (1 - (abs(i - j) / 2.0) ** 2)) AS eq FROM r JOIN c ON r.g = c.g GROUP BY r.g),
        p AS (SELECT g, k, sum(n) AS m FROM (SELECT g, i AS k, n FROM r UNION ALL SELECT g, j, n FROM c) GROUP BY ALL),
        ae AS (SELECT p.g, sum(m / (2 * n) * (1 - m / (2 * n))) / 2 AS pe FROM p JOIN tot USING (g) GROUP BY p.g),
        k AS (SELECT g, n::BIGINT AS n, round(po, 9) AS agreement, round((po - eo / (n * n)) / (1 - eo / (n * n)), 9) AS kappa, round((pl - el / (n * n)) / (1 - el / (n * n)), 9) AS kappa_linear, round((pq - eq / (n * n)) / (1 - eq / (n * n)), 9) AS kappa_quadratic, round((po - pe) / (1 - pe), 9) AS ac1 FROM tot JOIN e USING (g) JOIN ae USING (g))"""
    absent = """SELECT rate, x, n, round(x / nullif(n, 0)::DOUBLE, 9) AS value FROM (SELECT 'false_absence_strict' AS rate, count(*) FILTER (b = 'missing' AND a = 'adequate') AS x, count(*) FILTER (b = 'missing' AND a <> 'not_applicable') AS n FROM cells
        UNION ALL SELECT 'false_absence_broad', count(*) FILTER (b = 'missing' AND a IN ('adequate', 'partial')), count(*) FILTER (b = 'missing' AND a <> 'not_applicable') FROM cells
        UNION ALL SELECT 'absence_missed', count(*) FILTER (a = 'missing' AND b IN ('adequate', 'partial')), count(*) FILTER (a = 'missing' AND b <> 'not_applicable') FROM cells)"""
    sens = """SELECT rate, x, n, round(x / nullif(n, 0)::DOUBLE, 9) AS value FROM (SELECT 'sensitivity' AS rate, count(*) FILTER (a AND b) AS x, count(*) FILTER (a) AS n FROM bin UNION ALL SELECT 'specificity', count(*) FILTER (NOT a AND NOT b), count(*) FILTER (NOT a) FROM bin UNION ALL SELECT 'accuracy', count(*) FILTER (a = b), count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) FROM bin)"""
    binary = "bin AS (SELECT rel.relevance <> 'no' AS a, relv.relevance <> 'no' AS b FROM relv JOIN rel USING (work_id))"
    icc = f"""hc AS (SELECT work_id, strict AS a FROM (SELECT work_id, count(*) FILTER (applicable AND status IN ('adequate', 'partial')) / nullif(count(*) FILTER (applicable), 0)::DOUBLE AS strict FROM cons GROUP BY 1)),
        mc AS (SELECT work_id, count(*) FILTER (applicable AND status IN ('adequate', 'partial')) / nullif(count(*) FILTER (applicable), 0)::DOUBLE AS b FROM graded GROUP BY work_id, doc),
        ab AS (SELECT a, b FROM hc JOIN mc USING (work_id) WHERE a IS NOT NULL AND b IS NOT NULL), m AS (SELECT count(*)::DOUBLE AS n, avg((a + b) / 2) AS g, avg(a) AS ma, avg(b) AS mb FROM ab),
        ss AS (SELECT any_value(n) AS n, sum((a - g) ** 2 + (b - g) ** 2) AS tot, sum(2 * ((a + b) / 2 - g) ** 2) AS rws, any_value(n * ((ma - g) ** 2 + (mb - g) ** 2)) AS cls FROM ab, m),
        icc AS (SELECT n::BIGINT AS n, round((rws / (n - 1) - (tot - rws - cls) / (n - 1)) / (rws / (n - 1) + (tot - rws - cls) / (n - 1) + 2 * (cls - (tot - rws - cls) / (n - 1)) / n), 9) AS icc FROM ss)"""
    z = agreement.Z95
    gate = lambda f: f"(SELECT {f} FROM (SELECT {f}, count(*) AS c, sum(count(*)) OVER () AS t FROM (SELECT gate_facts.{f}::VARCHAR AS {f} FROM cur x WHERE x.work_id = w.work_id AND gate_facts IS NOT NULL) GROUP BY 1) WHERE c * 2 > t)"
    gates = ", ".join(f"CASE WHEN EXISTS (SELECT 1 FROM (SELECT count(*) AS c, sum(count(*)) OVER () AS t FROM cur x WHERE x.work_id = w.work_id AND gate_facts IS NOT NULL GROUP BY gate_facts.{f}) WHERE c * 2 > t) THEN {gate(f)} ELSE (SELECT gate_facts.{f}::VARCHAR FROM cur x WHERE x.work_id = w.work_id AND gate_facts IS NOT NULL ORDER BY rater_id LIMIT 1) END AS {f}" for f in ("inference_method", "n_models", "bf_claimed", "prior_informativeness"))
    head, full = f"WITH {cur}, {steps}", f"WITH {cur}, {steps}, {cons}, {cells}"
    toward = "CASE WHEN g.applicable AND c.status IS NOT NULL AND c.status <> 'not_applicable' AND g.status <> 'not_applicable' THEN CASE WHEN array_position(o, c.status) > array_position(o, g.status) THEN o[array_position(o, g.status) + 1] WHEN array_position(o, c.status) < array_position(o, g.status) THEN o[array_position(o, g.status) - 1] ELSE g.status END ELSE g.status END"
    order = lambda c, xs: "CASE " + c + " " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(xs)) + f" ELSE {len(xs)} END"
    field = lambda path: f"CASE WHEN json_type(x, '$.{path}') NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN x ->> '$.{path}' END"
    scored = f"""{records._nodes()}, js AS (SELECT record_id AS doc, step_pos, {field('step_id')} AS step_id, ({field('applicable')}) = 'true' AS applicable, {field('status')} AS status FROM step WHERE rating_pos = -1),
        own AS (SELECT doc, step_id, arg_max(applicable, step_pos) AS applicable, arg_max(status, step_pos) AS status, CASE WHEN step_id IN ('S3', 'S5', 'S8') THEN 0.5 ELSE 1.0 END AS weight FROM js WHERE step_id IS NOT NULL AND status IS NOT NULL GROUP BY doc, step_id)"""
    asd = f"""WITH {cur}, {steps}, {cons}, judged AS (SELECT work_id || '/' || rater_id AS doc, * FROM steps WHERE status IN ('adequate', 'partial', 'missing')), place AS (SELECT doc, min(evidence[1].section_id) AS section FROM judged GROUP BY 1),
        keyed AS (SELECT *, list_transform(coalesce(evidence, []), lambda x: {{'s': x.section_id, 'q': x.quote}}) AS ks FROM judged),
        owned AS (SELECT k.*, p.section, list_transform(list_filter(ks, lambda x, i: list_position(ks, x) = i), lambda x: concat_ws('|', 'judge_quote', x.s, x.q)) AS own FROM keyed k JOIN place p USING (doc)),
        assessed AS (SELECT doc, work_id, step_id, status, CASE WHEN NOT isnan(confidence) THEN least(greatest(confidence, 0), 1) END AS confidence, own, CASE WHEN status = 'missing' THEN list_append(own, 'absence_search|' || coalesce(section, 's00') || '|') ELSE own END AS spans, (trim(coalesce(rationale, '')) <> '')::INT AS n_praise,
            CASE WHEN missing_subtag IS NULL THEN '' ELSE CASE WHEN status = 'missing' THEN CASE WHEN step_id IN ('S1', 'S2', 'S3') THEN 'error' WHEN step_id IN ('S4', 'S5') THEN 'warning' ELSE 'info' END WHEN status = 'partial' AND step_id IN ('S1', 'S2', 'S3') THEN 'warning' ELSE 'info' END || '/low/' || missing_subtag END AS asked FROM owned)"""
    poisson, below, p_j = [], 0.0, math.exp(-1)
    for j in range(12):
        below += p_j
        p_j /= j + 1
        poisson.append(f"(u >= {below!r})::INT")
    return locals(), {
        "bootstrap_kappa_ci": f"""{full}, codes AS (SELECT * FROM (VALUES ('missing', 0), ('partial', 1), ('adequate', 2)) v(s, i)), used AS (SELECT work_id, x.i AS i, y.i AS j, count(*) AS n FROM cells JOIN codes x ON x.s = a JOIN codes y ON y.s = b GROUP BY ALL),
            draws AS (SELECT work_id, k, {' + '.join(poisson)} AS t FROM (SELECT work_id, k, ('0x' || substr(md5('0|' || k || '|' || work_id), 1, 8))::BIGINT / 4294967296.0 AS u FROM (SELECT DISTINCT work_id FROM used) CROSS JOIN range(200) r(k))),
            sums AS (SELECT k, i, j, sum(n * t)::DOUBLE AS n FROM used JOIN draws USING (work_id) GROUP BY ALL), tot AS (SELECT k, sum(n) AS n, sum(n) FILTER (i = j) AS o FROM sums GROUP BY 1),
            ex AS (SELECT r.k, sum(r.n * c.n) AS e FROM (SELECT k, i, sum(n) AS n FROM sums GROUP BY ALL) r JOIN (SELECT k, j, sum(n) AS n FROM sums GROUP BY ALL) c ON r.k = c.k AND r.i = c.j GROUP BY 1),
            v AS (SELECT (o / n - e / (n * n)) / (1 - e / (n * n)) AS v FROM tot JOIN ex USING (k)) SELECT count(v) AS n_resamples, round(quantile_cont(v, 0.025), 9) AS lo, round(quantile_cont(v, 0.975), 9) AS hi FROM v""",
        "batch_reconcile": f"""WITH {scored}, seen AS (SELECT doc, step_id, count(*) AS n FROM js WHERE step_id IS NOT NULL GROUP BY ALL), docs AS (SELECT DISTINCT doc FROM seen), ask AS (SELECT doc, unnest([{', '.join(repr(x) for x in scoring.STEPS)}]) AS step_id FROM docs)
            SELECT step_id, CASE WHEN n IS NULL THEN 'missing' WHEN NOT wanted THEN 'extra' WHEN n > 1 THEN 'repeated' ELSE 'ok' END AS state, count(*) AS n FROM (SELECT coalesce(a.step_id, s.step_id) AS step_id, s.n, a.doc IS NOT NULL AS wanted FROM ask a FULL JOIN seen s ON a.doc = s.doc AND a.step_id = s.step_id) GROUP BY ALL""",
        "fix_list": f"""WITH {scored}, t AS (SELECT doc, count(*) FILTER (applicable) AS n, count(*) FILTER (applicable AND status IN ('adequate', 'partial')) AS p, sum(weight) FILTER (applicable)::DOUBLE AS sw, sum(weight * {sub()}) FILTER (applicable)::DOUBLE AS sq FROM own GROUP BY 1),
            imp AS (SELECT doc, step_id, (p + (status = 'missing')::INT) / n::DOUBLE - p / n::DOUBLE AS cd, (sq + weight::DOUBLE * (1 - {sub()})) / sw - sq / sw AS qd FROM own JOIN t USING (doc) WHERE applicable AND status IN ('partial', 'missing') AND sw <> 0),
            asked AS (SELECT record_id AS doc, step_pos, child_pos, {field('severity')} AS severity, {field('text')} AS text, {field('ease')} AS ease FROM suggestion WHERE rating_pos = -1)
            SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY {order('severity', scoring.SEVERITY)}, weight DESC, {order('ease', scoring.EASE)}, step_id, step_pos, child_pos)::INT AS fix_rank, step_id, severity, ease, weight, text, round(coverage_delta, 9) AS coverage_delta, round(quality_delta, 9) AS quality_delta
            FROM (SELECT a.doc, j.step_id, a.step_pos, child_pos, severity, ease, text, coalesce(o.weight, 1.0)::DOUBLE AS weight, coalesce(cd, 0) AS coverage_delta, coalesce(qd, 0) AS quality_delta FROM asked a JOIN js j ON a.doc = j.doc AND a.step_pos = j.step_pos AND j.step_id IS NOT NULL AND j.status IS NOT NULL
            LEFT JOIN own o ON o.doc = a.doc AND o.step_id = j.step_id LEFT JOIN imp i ON i.doc = a.doc AND i.step_id = j.step_id)""",
        "rating_steps_current": f"{head} SELECT step_id, status, applicable, count(*) AS n, sum(n_evidence)::BIGINT AS n_evidence FROM steps GROUP BY ALL",
        "rating_counts": f"WITH {cur} SELECT work_id, count(*) AS n_raters FROM cur GROUP BY 1",
        "step_violations": f"""{head} SELECT work_id, rater_id, step_id, violation FROM (SELECT *, 'applicable but not_applicable' AS violation FROM steps WHERE status = 'not_applicable' AND applicable UNION ALL SELECT *, 'not applicable but graded' FROM steps WHERE status <> 'not_applicable' AND NOT applicable
            UNION ALL SELECT *, 'subtag without missing' FROM steps WHERE missing_subtag IS NOT NULL AND status <> 'missing' UNION ALL SELECT *, 'no rationale' FROM steps WHERE status <> 'not_applicable' AND trim(coalesce(rationale, '')) = ''
            UNION ALL SELECT *, 'no evidence' FROM steps WHERE status IN ('adequate', 'partial') AND n_evidence = 0)""",
        "judgment_assessments": f"{asd} SELECT doc, step_id, status, confidence, md5(array_to_string(spans, chr(10))) AS spans_md5, n_praise, asked FROM assessed",
        "refuted_assessments": f"""{asd}, v AS (SELECT a.*, c.status AS proposed, a.status = 'missing' AND c.status IS NOT NULL AS refuted FROM assessed a LEFT JOIN (SELECT * FROM cons WHERE status IN ('partial', 'adequate')) c ON c.work_id = a.work_id AND c.step_id = a.step_id)
            SELECT doc, step_id, CASE WHEN refuted THEN proposed ELSE status END AS status, md5(array_to_string(CASE WHEN refuted THEN list_append(own, 'judge_quote|s01|rescued') ELSE spans END, chr(10))) AS spans_md5, CASE WHEN refuted AND proposed = 'adequate' THEN '' ELSE asked END AS asked, status = 'missing' AS challenged, refuted FROM v""",
        "correction_deltas": f"""WITH {cur}, {steps}, {cons}, {graded}, fx AS (SELECT g.*, c.status AS target, {toward} AS corrected, count(*) FILTER (g.applicable) OVER (PARTITION BY doc) AS n, sum(weight) FILTER (g.applicable) OVER (PARTITION BY doc)::DOUBLE AS w FROM (SELECT *, ['missing', 'partial', 'adequate'] AS o FROM graded) g LEFT JOIN cons c ON c.work_id = g.work_id AND c.step_id = g.step_id)
            SELECT doc, step_id, status, corrected, round(((corrected IN ('partial', 'adequate'))::INT - (status IN ('partial', 'adequate'))::INT) / n::DOUBLE, 9) AS coverage_delta, round(weight::DOUBLE * ({sub('corrected')} - {sub()}) / w, 9) AS quality_delta FROM fx WHERE applicable AND target IS NOT NULL""",
        "form_violations": f"""WITH {cur}, f AS (SELECT *, {status('relevance_label')} AS rl, coalesce(len(paper_class_labels), 0) AS nc, coalesce(len(steps), 0) AS ns FROM cur) SELECT work_id, rater_id, violation FROM (
            SELECT *, 'no rationale' AS violation FROM f WHERE trim(coalesce(relevance_rationale, '')) = '' UNION ALL SELECT *, 'repeated class' FROM f WHERE nc <> len(list_distinct(paper_class_labels))
            UNION ALL SELECT *, 'no with steps' FROM f WHERE rl = 'no' AND ns > 0 UNION ALL SELECT *, 'no with classes' FROM f WHERE rl = 'no' AND nc > 0 UNION ALL SELECT *, 'no with gate answers' FROM f WHERE rl = 'no' AND gate_facts IS NOT NULL
            UNION ALL SELECT *, 'no class' FROM f WHERE rl <> 'no' AND nc < 1 UNION ALL SELECT *, 'no gate answers' FROM f WHERE rl <> 'no' AND gate_facts IS NULL UNION ALL SELECT *, 'repeated step' FROM f WHERE ns <> len(list_distinct(list_transform(steps, lambda x: x.step_id))))""",
        "gold_admissibility": f"""WITH {cur}, {rel}, w AS (SELECT work_id, count(*) AS n_raters, bool_or(coalesce(relationship = 'independent', FALSE)) AS ind, bool_and(coalesce(relationship IN ('prompt_author', 'engine_dev'), FALSE)) AS dev, max(coalesce(source_sha256, '')) AS sha FROM cur GROUP BY 1)
            SELECT w.work_id, n_raters, concat_ws('; ', CASE WHEN n_raters NOT BETWEEN 2 AND 3 THEN 'number of raters' END, CASE WHEN NOT ind THEN 'no independent rater' END, CASE WHEN dev THEN 'all raters are developers' END, CASE WHEN rel.work_id IS NULL THEN 'no consensus' END, CASE WHEN sha = '' THEN 'no content hash' END) AS violations FROM w LEFT JOIN rel USING (work_id)""",
        "incomplete_forms": f"WITH {cur} SELECT work_id, rater_id, missing, extra FROM (SELECT work_id, rater_id, array_to_string(list_filter([{', '.join(repr(s) for s in scoring.STEPS[:9])}], lambda x: NOT list_contains(list_transform(steps, lambda s: s.step_id), x)), ',') AS missing, array_to_string(list_filter(list_transform(steps, lambda s: s.step_id), lambda x: NOT list_contains([{', '.join(repr(s) for s in scoring.STEPS[:9])}], x)), ',') AS extra FROM cur) WHERE missing <> '' OR extra <> ''",
        "consensus_steps": f"WITH {cur}, {steps}, {cons} SELECT work_id, step_id, applicable, status, round(confidence, 9) AS confidence, n_agree FROM cons",
        "consensus_evidence": f"""WITH {cur}, {steps}, {cons}, x AS (SELECT s.work_id, s.step_id, s.rater_id, unnest(s.evidence) AS e, generate_subscripts(s.evidence, 1) AS p FROM steps s JOIN cons c USING (work_id, step_id, status) WHERE s.applicable AND c.applicable),
            y AS (SELECT work_id, step_id, e.section_id AS section_id, e.page AS page, e.quote AS quote, min({{'r': rater_id, 'p': p}}) AS first_at FROM x GROUP BY work_id, step_id, e) SELECT work_id, step_id, (row_number() OVER (PARTITION BY work_id, step_id ORDER BY first_at, section_id, page NULLS FIRST, quote) - 1)::INT AS span_pos, section_id, page, quote FROM y""",
        "consensus_labels": f"WITH {cur}, {lab} SELECT * FROM lab",
        "consensus_gates": f"WITH {cur} SELECT work_id, {gates} FROM (SELECT DISTINCT work_id FROM cur WHERE gate_facts IS NOT NULL) w",
        "consensus_relevance": f"WITH {cur}, {rel} SELECT work_id, relevance, votes, n::BIGINT AS n FROM rel",
        "no_consensus_steps": f"WITH {cur}, {steps}, {cons} SELECT work_id, string_agg(step_id, ',' ORDER BY substr(step_id, 2)::INT) AS steps FROM (SELECT DISTINCT work_id, step_id FROM steps WHERE applicable IS NOT NULL) s WHERE NOT EXISTS (SELECT 1 FROM cons c WHERE c.work_id = s.work_id AND c.step_id = s.step_id) GROUP BY 1",
        "agreement_summary": f"{full}, {kap.format(by='step_id', t='cells', where='')} SELECT g AS step_id, n, agreement, kappa, kappa_linear, kappa_quadratic, ac1 FROM k",
        "confusion_matrix": f"{full}, o AS (SELECT unnest(['missing', 'partial', 'adequate', 'not_applicable']) AS s) SELECT x.s AS a, y.s AS b, count(c.work_id) AS n FROM o x CROSS JOIN o y LEFT JOIN cells c ON c.a = x.s AND c.b = y.s GROUP BY ALL",
        "absence_rates": f"{full} {absent}",
        "sens_spec_accuracy": f"WITH {cur}, {rel}, {binary} {sens}",
        "class_set_accuracy": f"WITH {cur}, {lab}, h AS (SELECT work_id, string_agg(label, '|' ORDER BY label) AS a FROM lab GROUP BY 1), p AS (SELECT a, array_to_string(list_sort(list_distinct(paper_class_labels)), '|') AS b FROM cur JOIN h USING (work_id)) SELECT count(*) FILTER (a = b) AS x, count(*) AS n, round(count(*) FILTER (a = b) / nullif(count(*), 0)::DOUBLE, 9) AS value FROM p",
        "wilson_intervals": f"{full}, r AS (SELECT step_id, count(*) FILTER (a = b) AS x, count(*) AS n FROM cells GROUP BY 1), q AS (SELECT *, x / n::DOUBLE AS p, {z} AS z FROM r) SELECT step_id, x, n, round(greatest(0, (p + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)), 9) AS lo, round(least(1, (p + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)), 9) AS hi FROM q",
        "inter_rater_pairs": f"{head} SELECT least(x.status, y.status) AS a, greatest(x.status, y.status) AS b, count(*) AS n FROM steps x JOIN steps y ON x.work_id = y.work_id AND x.step_id = y.step_id AND x.rater_id < y.rater_id WHERE x.applicable AND y.applicable AND x.status IS NOT NULL AND y.status IS NOT NULL GROUP BY ALL",
        "step_weights_multilabel": f"{head}, {graded} SELECT step_id, weight::DOUBLE AS weight, count(*) AS n FROM graded GROUP BY ALL",
        "coverage_quality": f"{head}, {graded} {score('graded')}",
        "score_impacts": f"""{head}, {graded}, t AS (SELECT doc, count(*) FILTER (applicable) AS n, count(*) FILTER (applicable AND status IN ('adequate', 'partial')) AS p, sum(weight) FILTER (applicable)::DOUBLE AS sw, sum(weight * {sub()}) FILTER (applicable)::DOUBLE AS sq FROM graded GROUP BY 1)
            SELECT doc, step_id, status, round((p + (status = 'missing')::INT) / n::DOUBLE - p / n::DOUBLE, 9) AS coverage_delta, round((sq + weight::DOUBLE * (1 - {sub()})) / sw - sq / sw, 9) AS quality_delta FROM graded JOIN t USING (doc) WHERE applicable AND status IN ('partial', 'missing')""",
        "icc_scores": f"WITH {cur}, {steps}, {cons}, {graded}, {icc} SELECT n, icc FROM icc",
        "refutation_upgrade": f"{full} SELECT b AS status, a AS proposed, CASE WHEN b = 'missing' AND a <> 'missing' THEN CASE WHEN a = 'adequate' THEN 'adequate' ELSE 'partial' END ELSE b END AS upgraded, count(*) AS n FROM cells WHERE b_applies GROUP BY ALL",
        "override_rescore": f"WITH {cur}, {steps}, {cons}, {graded}, fixed AS (SELECT g.doc, g.applicable, g.confidence, g.weight, {toward} AS status FROM (SELECT *, ['missing', 'partial', 'adequate'] AS o FROM graded) g LEFT JOIN cons c ON c.work_id = g.work_id AND c.step_id = g.step_id) SELECT doc, present, strict, quality FROM ({score('fixed')})",
        "validation_report": f"""WITH {cur}, {steps}, {cons}, {cells}, {rel}, {binary}, {graded}, {icc}, {kap.format(by='1', t='cells', where='WHERE a_applies AND b_applies')}, s AS (SELECT 'agreement' AS metric, agreement AS value, n FROM k UNION ALL SELECT 'kappa', kappa, n FROM k UNION ALL SELECT 'kappa_linear', kappa_linear, n FROM k UNION ALL SELECT 'ac1', ac1, n FROM k
            UNION ALL SELECT rate, value, n FROM ({absent}) UNION ALL SELECT 'relevance_' || rate, value, n FROM ({sens}) UNION ALL SELECT 'coverage_icc', icc, n FROM icc) SELECT metric, value, n, n < 15 AS preliminary FROM s""",
        "assemble_goldset": f"WITH {cur}, {rel}, {lab} SELECT c.work_id, n_raters, reason IS NULL AS written, reason FROM (SELECT w.work_id, n_raters, CASE WHEN relevance IS NULL THEN 'no relevance consensus' WHEN relevance <> 'no' AND NOT EXISTS (SELECT 1 FROM lab l WHERE l.work_id = w.work_id) THEN 'no class consensus' END AS reason FROM (SELECT work_id, count(*) AS n_raters FROM cur GROUP BY 1) w LEFT JOIN rel USING (work_id)) c",
        "absence_records": f"""WITH {cur}, {steps}, {cons}, p AS (SELECT DISTINCT doc_key, source_doc.sha256 AS sha, sections FROM parsed_docs), k AS (SELECT work_id, min(doc_key) AS doc_key FROM cur JOIN p ON p.sha = cur.source_sha256 GROUP BY 1),
            s AS (SELECT doc_key, string_agg(x.id, ',' ORDER BY i) AS searched, arg_min(x.id, i) AS first FROM (SELECT doc_key, unnest(sections) AS x, generate_subscripts(sections, 1) AS i FROM p) WHERE x.kind <> 'references' AND length(x.text) > 0 GROUP BY 1)
            SELECT c.work_id AS doc, step_id, coalesce(first, 's00') AS section_id, coalesce(searched, '') AS searched FROM cons c LEFT JOIN k USING (work_id) LEFT JOIN s USING (doc_key) WHERE c.applicable AND c.status = 'missing'""",
        "rater_relationships": f"WITH {cur} SELECT relationship, count(*) AS n, count(DISTINCT rater_id) AS n_raters FROM cur GROUP BY 1",
    }
