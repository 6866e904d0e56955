"""Queries of engine runs against the human consensus, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators import agreement, consensus, engine_runs, ratings
from auditloom.plans import records, validation
from auditloom.session import cut

ORDER = ratings.STATUSES


def _records(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/report_records.parquet")


def _agreed(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus_steps(ratings.graded_steps(ratings.graded_forms(spark.read.parquet(f"{d}/ratings.parquet"))))


def _tiers(spark: SparkSession, d: str, forms: DataFrame) -> DataFrame:
    """The tier of a work's newest human report; the works of these tables that have runs have no such report, so theirs goes by the number of raters."""
    raters = forms.groupBy("work_id").agg(F.count(F.lit(1)).alias("n"))
    by_raters = F.when(F.col("n") >= 6, "A").when(F.col("n") >= 5, "B").otherwise("C")
    named = engine_runs.latest_tiers(_records(spark, d)).withColumnRenamed("tier", "named")
    return raters.join(named, "work_id", "left").select("work_id", F.coalesce("named", by_raters).alias("tier"))


def engine_steps_current(spark: SparkSession, d: str) -> DataFrame:
    return engine_runs.engine_steps(_records(spark, d))


def engine_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Consensus status (a) against the newest run's (b), the full crosstab."""
    cells = engine_runs.against_consensus(_agreed(spark, d), engine_runs.engine_steps(_records(spark, d)))
    return agreement.confusion(cells, (*ORDER, "not_applicable"))


def engine_single_cases(spark: SparkSession, d: str) -> DataFrame:
    """Works of tier C, step by step; they are too few for a rate."""
    forms = cut(ratings.graded_forms(spark.read.parquet(f"{d}/ratings.parquet")))
    third = _tiers(spark, d, forms).filter("tier = 'C'").select("work_id")
    agreed = consensus.consensus_steps(ratings.graded_steps(forms)).join(third, "work_id", "left_semi")
    return engine_runs.single_cases(agreed, engine_runs.engine_steps(_records(spark, d)))


def engine_retest(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of each work's newest two runs."""
    k = agreement.kappa_summary(engine_runs.retest_pairs(engine_runs.engine_steps(_records(spark, d))), ORDER)
    return k.select("n", *[F.round(c, 9).alias(c) for c in ("agreement", "kappa", "kappa_linear")])


def gold_with_engine(spark: SparkSession, d: str) -> DataFrame:
    """Works with a gold record by whether the engine has run on them: n_works, n_steps of the newest run."""
    forms = ratings.graded_forms(spark.read.parquet(f"{d}/ratings.parquet"), "relevance_label")
    gold = consensus.consensus_relevance(forms).select("work_id", "relevance")
    runs = engine_runs.engine_steps(_records(spark, d)).filter("run = 1").groupBy("work_id").agg(F.count(F.lit(1)).alias("n_steps"))
    paired = gold.join(runs, "work_id", "left")
    return paired.groupBy("relevance", F.col("n_steps").isNotNull().alias("paired")).agg(F.count(F.lit(1)).alias("n_works"), F.coalesce(F.sum("n_steps"), F.lit(0)).alias("n_steps"))


def engine_validation(spark: SparkSession, d: str) -> DataFrame:
    """The report of engine against human: tier routing, excluded works, pooled step metrics, retest noise floor."""
    forms = cut(ratings.graded_forms(spark.read.parquet(f"{d}/ratings.parquet"), "relationship", "source_sha256", "relevance_label"))
    admissible = ratings.admissibility(forms, consensus.consensus_relevance(forms), 2, 8).filter(F.size("violations") == 0)
    engine = cut(engine_runs.engine_steps(_records(spark, d)))
    out = engine_runs.validation_rows(consensus.consensus_steps(ratings.graded_steps(forms)), engine, _tiers(spark, d, forms), admissible, ORDER)
    return out.withColumn("value", F.round("value", 9))


QUERIES = (engine_steps_current, engine_confusion, engine_single_cases, engine_retest, gold_with_engine, engine_validation)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    field = lambda path: f"CASE WHEN json_type(x, '$.{path}') NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN x ->> '$.{path}' END"
    v = validation.sql_parts()
    runs = f"""{records._nodes()},
        kinds AS (SELECT record_id, any_value(record_kind) AS record_kind, max(received_at) AS received_at FROM report_records GROUP BY 1),
        named AS (SELECT r.record_id, {field('work_id')} AS work_id, {field('tier')} AS tier, record_kind, received_at FROM record r JOIN kinds USING (record_id)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY received_at DESC NULLS LAST, record_id DESC) AS run FROM named WHERE record_kind = 'scored_result' AND work_id IS NOT NULL),
        es AS (SELECT record_id, {field('step_id')} AS step_id, arg_max({field('applicable')} = 'true', step_pos) AS applicable, arg_max({field('status')}, step_pos) AS status, arg_max(({field('confidence')})::DOUBLE, step_pos) AS confidence
            FROM step WHERE rating_pos = -1 AND {field('step_id')} IS NOT NULL AND {field('status')} IS NOT NULL GROUP BY 1, 2),
        eng AS (SELECT work_id, run::INT AS run, record_id, step_id, applicable, status, confidence FROM es JOIN ranked USING (record_id) WHERE run <= 2),
        told AS (SELECT work_id, arg_max(tier, {{'at': received_at, 'id': record_id}}) AS tier FROM named WHERE record_kind = 'human_report' AND work_id IS NOT NULL AND tier IS NOT NULL GROUP BY 1),
        tiers AS (SELECT work_id, coalesce(told.tier, CASE WHEN n >= 6 THEN 'A' WHEN n >= 5 THEN 'B' ELSE 'C' END) AS tier FROM (SELECT work_id, count(DISTINCT rater_id) AS n FROM ratings GROUP BY 1) LEFT JOIN told USING (work_id))"""
    human = f"{v['cur']}, {v['steps']}, {v['cons']}"
    pairs = "pairs AS (SELECT c.work_id, c.step_id, c.status AS a, e.status AS b, c.applicable AS a_applies, e.applicable AS b_applies FROM cons c JOIN eng e ON e.work_id = c.work_id AND e.step_id = c.step_id AND e.run = 1)"
    retest = "retest AS (SELECT x.status AS a, y.status AS b FROM eng x JOIN eng y ON x.work_id = y.work_id AND x.step_id = y.step_id AND x.run = 1 AND y.run = 2 WHERE x.applicable AND y.applicable)"
    few = v["kap"].format(by="1", t="{t}", where="{where}")
    kap = lambda t, where="": few.format(t=t, where=where)
    sub = lambda t, names, prefix, where="", codes="": " UNION ALL ".join(f"SELECT '{prefix}{m}' AS metric, {m} AS value, n FROM (WITH {kap(t, where)} SELECT * FROM k)" for m in names)
    two = "(SELECT avg((a = b)::INT) AS po, count(*)::DOUBLE AS n, sum(a::INT) AS ra, sum(b::INT) AS rb FROM ap)"
    return {
        "engine_steps_current": f"WITH {runs} SELECT * FROM eng",
        "engine_confusion": f"WITH {human}, {runs}, {pairs}, o AS (SELECT unnest(['missing', 'partial', 'adequate', 'not_applicable']) AS s) SELECT x.s AS a, y.s AS b, count(p.work_id) AS n FROM o x CROSS JOIN o y LEFT JOIN pairs p ON p.a = x.s AND p.b = y.s GROUP BY ALL",
        "engine_single_cases": f"WITH {human}, {runs} SELECT c.work_id, c.step_id, c.status AS consensus, coalesce(e.status, '{engine_runs.NO_ENGINE}') AS engine, coalesce(c.status = e.status, false) AS agree FROM cons c JOIN tiers t USING (work_id) LEFT JOIN eng e ON e.work_id = c.work_id AND e.step_id = c.step_id AND e.run = 1 WHERE tier = 'C' AND c.work_id IN (SELECT work_id FROM eng)",
        "engine_retest": f"WITH {runs}, {retest}, {kap('retest')} SELECT n, agreement, kappa, kappa_linear FROM k",
        "gold_with_engine": f"WITH {v['cur']}, {v['rel']}, {runs}, g AS (SELECT work_id, relevance, (SELECT count(*) FROM eng e WHERE e.work_id = rel.work_id AND run = 1) AS n FROM rel) SELECT relevance, n > 0 AS paired, count(*) AS n_works, sum(n)::BIGINT AS n_steps FROM g GROUP BY ALL",
        "engine_validation": f"""WITH {human}, {v['rel']}, {runs}, {pairs}, {retest},
            adm AS (SELECT w.work_id FROM (SELECT work_id, count(*) AS n_raters, bool_or(coalesce(relationship = 'independent', FALSE)) AS ind, bool_and(coalesce(relationship IN ('prompt_author', 'engine_dev'), FALSE)) AS dev, max(coalesce(source_sha256, '')) AS sha FROM cur GROUP BY 1) w JOIN rel USING (work_id) WHERE n_raters BETWEEN 2 AND 8 AND ind AND NOT dev AND sha <> ''),
            works AS (SELECT DISTINCT work_id, tier, work_id IN (SELECT work_id FROM adm) AS ok FROM tiers WHERE work_id IN (SELECT work_id FROM eng)),
            cells AS (SELECT p.* FROM pairs p JOIN works w USING (work_id) WHERE ok AND tier = 'A'), ap AS (SELECT a_applies AS a, b_applies AS b FROM cells),
            c AS (SELECT count(*) AS n, count(*) FILTER (ok) AS n_papers, count(*) FILTER (NOT ok) AS n_excluded, count(*) FILTER (ok AND tier = 'A') AS n_tier_a, count(*) FILTER (ok AND tier = 'B') AS n_tier_b, count(*) FILTER (ok AND tier = 'C') AS n_tier_c FROM works),
            s AS ({' UNION ALL '.join(f"SELECT '{m}' AS metric, {m}::DOUBLE AS value, n FROM c" for m in ('n_papers', 'n_excluded', 'n_tier_a', 'n_tier_b', 'n_tier_c'))}
            UNION ALL {sub('cells', ('agreement', 'kappa', 'kappa_linear', 'ac1'), 'step_', 'WHERE a_applies AND b_applies')}
            UNION ALL SELECT 'applicability_agreement', po, n::BIGINT FROM {two}
            UNION ALL SELECT 'applicability_kappa', CASE WHEN pe = 1 THEN (po = 1)::INT ELSE (po - pe) / (1 - pe) END, n::BIGINT FROM (SELECT *, (ra * rb + (n - ra) * (n - rb)) / (n * n) AS pe FROM {two})
            UNION ALL SELECT rate, value, n FROM ({v['absent']}) UNION ALL {sub('retest', ('agreement', 'kappa'), 'retest_')})
            SELECT metric, round(value, 9) AS value, n, (SELECT n_papers < 15 FROM c) AS preliminary FROM s""",
    }
