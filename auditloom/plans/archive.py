"""Queries of the archive, its events, and of classification from recorded facts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom.operators import archive, classify
from auditloom.sources import providers


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _reports(spark: SparkSession, d: str) -> DataFrame:
    return archive.current_reports(_t(spark, d, "archived_papers"))


def archive_current(spark: SparkSession, d: str) -> DataFrame:
    return _reports(spark, d).select("report_key", "paper_title", "quality_score", "updated_at")


def archive_search(spark: SparkSession, d: str) -> DataFrame:
    found = archive.search(_reports(spark, d), "model", {"paper_type": ["data_analysis", "model_development"], "methods": ["mcmc", "hmc_nuts", "variational"]})
    return found.select("report_key", "paper_title", "run_mode")


def archive_facets(spark: SparkSession, d: str) -> DataFrame:
    return archive.facets(_reports(spark, d))


def archive_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page by coverage; the page is the feature."""
    p = archive.page(_reports(spark, d), "coverage", 2, 10)
    return p.select("place", "report_key", "coverage_present", "coverage_applicable")


def archive_sorted(spark: SparkSession, d: str) -> DataFrame:
    """The best report of each rubric profile and paper type, nulls last."""
    r = _reports(spark, d).select("report_key", "rubric_profile", "quality_score", "updated_at", F.explode("paper_type").alias("tag"))
    return archive.top_per_key(r, ["rubric_profile", "tag"], [F.col("quality_score").desc_nulls_last(), F.col("report_key")], 3).select("rubric_profile", "tag", "rank", "report_key", "quality_score")


def override_bank_top8(spark: SparkSession, d: str) -> DataFrame:
    """Of the newest 200 events, the newest 8 of each type; both limits are the feature."""
    e = _t(spark, d, "events")
    return archive.top_per_key(e, ["event_type"], [F.col("ts").desc(), F.col("event_id").desc()], 8, newest=200).select("event_type", "rank", "event_id", "user_id")


def report_merge_upsert(spark: SparkSession, d: str) -> DataFrame:
    """First versions of the reports, merged with their later ones; tags of the later version are authoritative."""
    a = _t(spark, d, "archived_papers").select("report_key", "paper_title", "quality_score", F.array_join("software", "|").alias("software"), "created_at", "updated_at").distinct()
    ends = a.groupBy("report_key").agg(F.min(F.struct("updated_at", F.to_json(F.struct("paper_title", "quality_score", "software", "created_at")))).alias("lo"), F.max(F.struct("updated_at", F.to_json(F.struct("paper_title", "quality_score", "software", "created_at")))).alias("hi"))
    keyed = a.withColumn("_k", F.struct("updated_at", F.to_json(F.struct("paper_title", "quality_score", "software", "created_at")))).join(ends, "report_key")
    old = keyed.filter("_k = lo").drop("_k", "lo", "hi")
    new = keyed.filter("_k = hi AND hi != lo").drop("_k", "lo", "hi")
    return archive.merge_reports(old, new, "report_key", authoritative=["software"])


def latest_report_by_paper(spark: SparkSession, d: str) -> DataFrame:
    return archive.latest_by(_t(spark, d, "archived_papers").select("identifier", "rubric_profile", "updated_at", "report_key"), ["identifier", "rubric_profile"], ["updated_at", "report_key"]).filter("identifier IS NOT NULL")


def latest_event_per_key(spark: SparkSession, d: str) -> DataFrame:
    return archive.latest_by(_t(spark, d, "events").select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


def job_event_replay(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as a job that ends with its first error, from the third event on."""
    e = _t(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return archive.replay(e, "user_id", ["ts", "event_id"], after=2, terminal=("error",)).select("user_id", "seq", "event_id", "event_type")


def job_fallback_state(spark: SparkSession, d: str) -> DataFrame:
    """The state of a job: its last purchase, else signup, else any event."""
    last = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("event_id"))).cast("string").alias(kind)
    j = _t(spark, d, "events").groupBy("user_id").agg(F.max("event_id").cast("string").alias("any"), last("purchase"), last("signup"))
    s = archive.first_of(("purchase", F.col("purchase")), ("signup", F.col("signup")), ("any", F.col("any")))
    return j.select("user_id", s["origin"].alias("origin"), s["value"].alias("value"))


REPLAY = {"engine_version": "0.5.1", "rubric_version": "0.1-draft", "grading_strategy": "batch"}


def replayable_reports(spark: SparkSession, d: str) -> DataFrame:
    """Full reports that may be shown again under a given set of versions."""
    return archive.replayable(_reports(spark, d), "full", REPLAY).select("report_key", "run_mode", "engine_version", "quality_score")


def provider_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Which source has a copy of a paper: a parsed document by hash, else a gold page, else none."""
    a = _t(spark, d, "archived_papers").select("identifier", "source_sha256", "paper_id").filter("identifier IS NOT NULL").distinct()
    parsed = _t(spark, d, "parsed_docs").select(F.col("source_doc.sha256").alias("source_sha256")).distinct()
    first = a.join(parsed, "source_sha256").select("identifier", F.concat(F.lit("blob:"), "source_sha256").alias("pdf_url"))
    second = a.select("identifier", F.concat(F.lit("page:"), "paper_id").alias("pdf_url")).filter("pdf_url IS NOT NULL")
    return providers.resolve_copies(a, parsed=first, page=second)


def version_parts(spark: SparkSession, d: str) -> DataFrame:
    from auditloom.functions.text import version_parts as parts

    v = _t(spark, d, "archived_papers").select("engine_version").distinct().filter("engine_version IS NOT NULL")
    return v.select("engine_version", F.size(parts(F.concat(F.lit("pkg="), "engine_version", F.lit(";models=a=b")))).alias("n"), parts(F.concat(F.lit("pkg="), "engine_version", F.lit(";models=a=b")))["models"].alias("models"))


# The facts that a reader's answers would give: of each kind the document's first evidence with one of the detectors.
FACT_OF_DETECTOR = {
    "method.prior": "develops_new_bayesian_model", "workflow.prior_predictive": "develops_new_bayesian_method", "open.code": "develops_new_bayesian_software", "open.data": "uses_bayesian_model_on_real_data", "workflow.recovery": "runs_numerical_or_simulation_study",
    "method.posterior": "investigates_theoretical_behavior", "workflow.sensitivity": "is_review_tutorial_or_commentary",
} | {classify.METHOD_DETECTOR[m]: f for f, m in classify.METHOD_OF_FACT.items() if m in classify.METHOD_DETECTOR}


# The recorded detector says only that some software was named, so the answers name these in turn.
TOOLS = ("Stan", "pymc3", "Python", "brms", "in-house tool", "sbi", "Turing.jl")


def _facts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """facts, contexts, software facts and evidence of the parsed documents, from their recorded evidence and section texts.

    The answers quote the evidence in sentences of their own ("We fitted it with ..."); those with an even number also stand
    in the document, so that some are grounded and some aren't.
    """
    e = _t(spark, d, "evidence").dropDuplicates(["evidence_id"]).select(F.col("doc_key").alias("doc"), "evidence_ref", "evidence_id", "detector_id", F.col("span.quote").alias("quote"), F.when(F.col("span.page").isNull(), "low").otherwise("high").alias("confidence"))
    first = lambda df, *keys: df.groupBy(*keys).agg(F.min(F.struct("evidence_ref", "evidence_id", "quote", "confidence")).alias("x"))
    facts = first(e.withColumn("fact_name", classify.lookup(F.col("detector_id"), FACT_OF_DETECTOR)).filter("fact_name IS NOT NULL"), "doc", "fact_name")
    said = F.when(F.col("fact_name").startswith("uses_") & (F.col("fact_name") != "uses_bayesian_model_on_real_data"), F.concat(F.lit("We estimated it so: "), "x.quote")).otherwise(F.col("x.quote"))
    facts = facts.select("doc", "fact_name", F.lit("yes").alias("answer"), F.col("x.confidence").alias("confidence"), said.alias("evidence"), (F.col("x.evidence_ref") % 2 == 0).alias("stands"))
    named = first(e.filter(F.col("detector_id").startswith("software.")).withColumn("name", F.element_at(F.array(*map(F.lit, TOOLS)), F.col("evidence_ref") % len(TOOLS) + 1)), "doc", "name")
    software = named.select("doc", F.col("x.evidence_ref").alias("pos"), "name", F.col("x.confidence").alias("confidence"), F.concat(F.lit("We fitted it with "), "name", F.lit(".")).alias("evidence"), (F.col("x.evidence_ref") % 2 == 0).alias("stands"))
    texts = F.transform(F.filter("sections", lambda s: s["kind"] != "references"), lambda s: F.coalesce(s["text"], F.lit("")))
    contexts = _t(spark, d, "parsed_docs").dropDuplicates(["doc_key"]).select(F.col("doc_key").alias("doc"), F.array_join(texts, "\n").alias("text"))
    # at most a sentence for each kind of fact and each detector of software
    added = facts.select("doc", "evidence", "stands").unionByName(software.select("doc", "evidence", "stands")).filter("stands").groupBy("doc").agg(F.array_join(F.array_sort(F.collect_set("evidence")), "\n").alias("added"))
    contexts = contexts.join(added, "doc", "left").select("doc", F.concat_ws("\n", "text", "added").alias("context"))
    facts, software = facts.drop("stands"), software.drop("stands")
    return facts, contexts, software, e.select("doc", "detector_id", "quote")


def classify_labels(spark: SparkSession, d: str) -> DataFrame:
    facts, contexts, _, _ = _facts(spark, d)
    return classify.paper_labels(facts, contexts).select("doc", F.array_join("labels", ",").alias("labels"))


def classify_software(spark: SparkSession, d: str) -> DataFrame:
    facts, contexts, software, _ = _facts(spark, d)
    return classify.paper_software(software, contexts, classify.paper_labels(facts, contexts)).select("doc", F.array_join("software", ",").alias("software"))


def classify_methods(spark: SparkSession, d: str) -> DataFrame:
    facts, contexts, software, evidence = _facts(spark, d)
    soft = classify.paper_software(software, contexts, classify.paper_labels(facts, contexts))
    return classify.paper_methods(facts, contexts, evidence, soft).select("doc", F.array_join("methods", ",").alias("methods"))


def classify_confidence(spark: SparkSession, d: str) -> DataFrame:
    return classify.fact_confidence(_facts(spark, d)[0])


def expectation_tiers(spark: SparkSession, d: str) -> DataFrame:
    """The strongest expectation per step over the classes of each gold paper, with three steps of the default rubric."""
    labels = _t(spark, d, "goldset").select(F.col("gold_key").alias("doc"), F.explode("paper_types").alias("label"))
    tiers = spark.createDataFrame(TIERS, "step_id string, label string, tier string")
    return classify.expectation_tiers(labels, tiers.select("step_id").distinct(), tiers)


TIERS = tuple(("S3", x, "expected") for x in ("model_development", "theoretical_analysis")) + tuple(("S3", x, "recommended") for x in ("data_analysis", "numerical_analysis", "method_development")) + (("S5", "data_analysis", "expected"),) + tuple(("S5", x, "recommended") for x in ("numerical_analysis", "model_development"))


def ext_misclassification_prevalence(spark: SparkSession, d: str) -> DataFrame:
    """Extension: prevalence corrected for a classifier of known sensitivity and specificity."""
    p = _t(spark, d, "documents").groupBy("source").agg(F.avg((F.col("lang") == "en").cast("double")).alias("p"))
    return p.select("source", F.round(F.least(F.greatest((F.col("p") + 0.8 - 1) / (0.95 + 0.8 - 1), F.lit(0.0)), F.lit(1.0)), 9).alias("prevalence"))


def provider_records(spark: SparkSession, d: str) -> DataFrame:
    """Answers of three providers made of the archived papers, read back into the common form."""
    a = _t(spark, d, "archived_papers").select("paper_id", "paper_title", "paper_year").filter("paper_id IS NOT NULL").distinct()
    doi = F.concat(F.lit("10.5555/"), F.upper("paper_id"))
    one = lambda name, payload, read: a.select("paper_id", "paper_title", "paper_year", F.lit(name).alias("provider"), read(F.to_json(payload)).alias("r"))
    openalex = F.struct(F.col("paper_title").alias("display_name"), F.col("paper_year").alias("publication_year"), F.concat(F.lit("https://doi.org/"), doi).alias("doi"), F.struct(F.concat(F.lit("u/"), "paper_id").alias("pdf_url")).alias("best_oa_location"))
    unpaywall = F.struct(F.col("paper_title").alias("title"), F.col("paper_year").alias("year"), F.struct(F.concat(F.lit("v/"), "paper_id").alias("url_for_pdf")).alias("best_oa_location"))
    crossref = F.struct(F.struct(F.array("paper_title").alias("title"), doi.alias("DOI")).alias("message"))
    rows = [one("openalex", openalex, providers.openalex_record), one("unpaywall", unpaywall, providers.unpaywall_record), one("crossref", crossref, providers.crossref_record)]
    out = [r.select("paper_id", "paper_title", "paper_year", "provider", "r.title", "r.year", "r.doi", "r.pdf_url") for r in rows]
    return out[0].unionByName(out[1]).unionByName(out[2]).select("paper_id", "provider", "title", "year", "doi", "pdf_url").distinct()


def ext_stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """Extension: five documents of each language and style, drawn by a seeded hash; a sample is what is asked for."""
    w = Window.partitionBy("lang", "doc_style").orderBy(F.md5(F.concat(F.lit("7|"), F.col("doc_id").cast("string"))), "doc_id")
    return _t(spark, d, "documents").select("doc_id", "lang", "doc_style").withColumn("place", F.row_number().over(w)).filter("place <= 5")


def ext_flow_counts(spark: SparkSession, d: str) -> DataFrame:
    """Extension: how many archived reports are left after each stage of a review: stage, n."""
    a = _t(spark, d, "archived_papers")
    keys = a.groupBy("report_key").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("source_sha256").isNotNull()).alias("source"), F.max(F.col("quality_score").isNotNull()).alias("score"))
    stages = (("identified", F.sum("rows")), ("deduplicated", F.count(F.lit(1))), ("retrieved", F.count(F.when(F.col("source"), 1))), ("graded", F.count(F.when(F.col("source") & F.col("score"), 1))))
    counted = keys.agg(*[c.alias(n) for n, c in stages])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("stage"), F.coalesce(n, F.lit(0)).alias("n")) for n, _ in stages])).alias("x")).select("x.*")


def ext_quality_over_time(spark: SparkSession, d: str) -> DataFrame:
    """Extension: mean quality by year and rubric."""
    return _reports(spark, d).filter("paper_year IS NOT NULL").groupBy("paper_year", "rubric_profile").agg(F.round(F.avg("quality_score"), 9).alias("quality"), F.count(F.lit(1)).alias("n"))


QUERIES = (
    archive_current, archive_search, archive_facets, archive_page, archive_sorted, override_bank_top8, report_merge_upsert, latest_report_by_paper, latest_event_per_key, job_event_replay, job_fallback_state, replayable_reports,
    provider_resolution, version_parts, classify_labels, classify_software, classify_methods, classify_confidence, expectation_tiers, ext_misclassification_prevalence, ext_quality_over_time, ext_stratified_sample, ext_flow_counts, provider_records,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def _classify_sql() -> dict[str, str]:
    """The rules of classification with RE2, which lacks lookaheads: OWN_MODEL stands without its own, USAGE checks the words between by themselves."""
    from auditloom.functions.text import STOP_WORDS

    q = lambda s: "'" + str(s).replace("'", "''") + "'"
    has = lambda text, p: f"regexp_matches({text}, {q(p)})"
    case = lambda c, table: f"CASE {c} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + " END"
    cue = lambda name, cues, text: f"CASE {name} " + " ".join(f"WHEN {q(k)} THEN {has(text, p)}" for k, p in cues.items()) + " ELSE FALSE END"
    norm = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"
    words = f"list_filter(string_split(qn, ' '), lambda x: length(x) >= 4 AND NOT list_contains([{', '.join(map(q, STOP_WORDS))}], x))"
    grounded = f"coalesce(qn <> '' AND (contains(tn, qn) OR (len({words}) >= 6 AND len(list_filter(list_distinct({words}), lambda x: contains(tn, x))) / len(list_distinct({words})) >= 0.8)), FALSE)"
    own = re.sub(r"\(\?!\.\{0,60\}\\bprior\\b\)", "", classify.OWN_MODEL)
    before, after = classify.USAGE.removeprefix("(?i)").split("|\\b(?:was|were)", 1)
    verb = before.split("{0,60}", 1)[1]
    usage = f"(len(list_filter(regexp_extract_all(qs, {q('(?i)' + chr(92) + 'b(?:we|our)' + chr(92) + 'b([^.;]{0,60}?)' + verb)}, 1), lambda x: NOT {has('x', '(?i)' + chr(92) + 'b(?:it|that|which|why|how|they)' + chr(92) + 'b')})) > 0 OR {has('qs', '(?i)' + chr(92) + 'b(?:was|were)' + after)})"
    squeeze = lambda c: f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
    base = f"""WITH e AS (SELECT DISTINCT evidence_id, doc_key AS doc, evidence_ref, detector_id, span.quote AS quote, CASE WHEN span.page IS NULL THEN 'low' ELSE 'high' END AS confidence FROM evidence),
        ctx0 AS (SELECT doc_key AS doc, string_agg(coalesce(s.text, ''), chr(10) ORDER BY i) FILTER (s.kind <> 'references') AS context FROM (SELECT doc_key, unnest(sections) AS s, generate_subscripts(sections, 1) AS i FROM (SELECT DISTINCT doc_key, sections FROM parsed_docs)) GROUP BY 1),
        named AS (SELECT *, {case('detector_id', FACT_OF_DETECTOR)} AS fact_name FROM e), first0 AS (SELECT * FROM named WHERE fact_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc, fact_name ORDER BY evidence_ref, evidence_id) = 1),
        first AS (SELECT * REPLACE (CASE WHEN starts_with(fact_name, 'uses_') AND fact_name <> 'uses_bayesian_model_on_real_data' THEN 'We estimated it so: ' || quote ELSE quote END AS quote) FROM first0),
        sw0 AS (SELECT * REPLACE ('We fitted it with ' || name || '.' AS quote) FROM (SELECT doc, evidence_ref AS pos, list_extract([{', '.join(map(q, TOOLS))}], (evidence_ref % {len(TOOLS)} + 1)::INT) AS name, confidence, quote, evidence_id FROM e WHERE starts_with(detector_id, 'software.')) QUALIFY row_number() OVER (PARTITION BY doc, name ORDER BY pos, evidence_id) = 1),
        more AS (SELECT doc, string_agg(quote, chr(10) ORDER BY quote) AS added FROM (SELECT DISTINCT doc, quote FROM (SELECT doc, quote, evidence_ref FROM first UNION ALL SELECT doc, quote, pos FROM sw0) WHERE evidence_ref % 2 = 0) GROUP BY 1),
        ctx AS (SELECT doc, concat_ws(chr(10), context, added) AS context FROM ctx0 LEFT JOIN more USING (doc)),
        facts AS (SELECT f.*, coalesce(quote, '') AS qq, context, {norm("coalesce(quote, '')")} AS qn, {norm('context')} AS tn FROM first f JOIN ctx USING (doc)),
        sur AS (SELECT doc, fact_name, {case('fact_name', classify.LABEL_OF_FACT)} AS label, qq FROM facts WHERE {case('fact_name', classify.LABEL_OF_FACT)} IS NOT NULL AND confidence = 'high'
            AND ({grounded} OR {cue(f"({case('fact_name', classify.LABEL_OF_FACT)})", classify.LABEL_CUES, 'qq')}) AND (fact_name <> 'investigates_theoretical_behavior' OR {has("qq || chr(10) || context", classify.FORMAL)} OR ({has("qq || chr(10) || context", classify.DERIVES)} AND {has("qq || chr(10) || context", classify.PROPERTY)}))),
        f1 AS (SELECT ctx.doc, context, coalesce((SELECT list(DISTINCT label) FROM sur WHERE sur.doc = ctx.doc), []) AS found, coalesce((SELECT max(qq) FROM facts x WHERE x.doc = ctx.doc AND fact_name = 'develops_new_bayesian_model'), '') AS mq, coalesce((SELECT max(qq) FROM facts x WHERE x.doc = ctx.doc AND fact_name = 'develops_new_bayesian_method'), '') AS eq FROM ctx),
        f2 AS (SELECT *, list_contains(found, 'model_development') AS m, list_contains(found, 'method_development') AS e FROM f1), f3 AS (SELECT *, CASE WHEN e THEN eq || chr(10) || mq || chr(10) || context ELSE mq END AS place FROM f2),
        f4 AS (SELECT doc, CASE WHEN m AND {has('place', classify.GENERAL_PRIOR)} AND NOT {has('mq', own)} AND NOT {has('mq', classify.SPECIFIC_PRIOR)} THEN list_distinct(list_append(list_filter(found, lambda x: x <> 'model_development'), 'method_development'))
            WHEN NOT m AND e AND {has('eq', classify.SPECIFIC_PRIOR)} AND NOT {has('eq', classify.GENERAL_PRIOR)} AND NOT {has('eq', classify.PROCEDURE)} THEN list_distinct(list_append(list_filter(found, lambda x: x <> 'method_development'), 'model_development')) ELSE found END AS f FROM f3),
        f5 AS (SELECT doc, CASE WHEN len(list_filter(f, lambda x: x <> 'review')) > 0 THEN list_filter(f, lambda x: x <> 'review') ELSE f END AS f FROM f4), f6 AS (SELECT *, list_filter([{', '.join(map(q, classify.LEADING))}], lambda x: list_contains(f, x))[1] AS lead FROM f5),
        labels AS (SELECT doc, CASE WHEN lead IS NULL THEN ['data_analysis'] ELSE list_concat([lead], list_filter(CASE lead {' '.join(f"WHEN {q(k)} THEN [{', '.join(map(q, v))}]::VARCHAR[]" for k, v in classify.FOLLOWING.items())} END, lambda x: list_contains(f, x)))[1:{classify.MOST_LABELS}] END AS labels FROM f6),
        sw AS (SELECT *, {case("regexp_replace(lower(name), '[^a-z0-9]', '', 'g')", classify.CANONICAL)} AS canon FROM sw0),
        sg AS (SELECT *, {norm('quote')} AS qn, {norm('context')} AS tn, coalesce(canon, name) AS can FROM sw JOIN ctx USING (doc)),
        names AS (SELECT doc, list(can ORDER BY pos, can) AS s FROM sg WHERE confidence = 'high' AND regexp_replace(lower(name), '[^a-z0-9]', '', 'g') NOT IN ({', '.join(map(q, (*classify.LANGUAGES, *classify.OTHER_TOOLS)))}) AND {grounded} AND (regexp_matches(lower(quote), '(^|[^a-z0-9])' || lower(name) || '([^a-z0-9]|$)') OR regexp_matches(lower(quote), '(^|[^a-z0-9])' || lower(can) || '([^a-z0-9]|$)')) GROUP BY 1),
        software AS (SELECT doc, CASE WHEN s IS NULL AND len(list_filter(labels, lambda x: x NOT IN ('review', 'theoretical_analysis'))) > 0 THEN ['Custom'] ELSE list_filter(coalesce(s, []), lambda x, i: list_position(list_transform(s, lambda y: lower(y)), lower(x)) = i) END AS software FROM labels LEFT JOIN names USING (doc)),
        keys AS (SELECT doc, list_transform(software, lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')) AS keys FROM software),
        imp AS (SELECT doc, list_filter([{', '.join(f"CASE WHEN list_has_any(keys, [{', '.join(map(q, v))}]) THEN {q(m)} END" for m, v in classify.IMPLIED.items())}], lambda x: x IS NOT NULL) AS implied FROM keys),
        mf AS (SELECT facts.*, {case('fact_name', classify.METHOD_OF_FACT)} AS method, {squeeze('qq')} AS qs, implied FROM facts JOIN imp USING (doc) WHERE {case('fact_name', classify.METHOD_OF_FACT)} IS NOT NULL),
        mh AS (SELECT *, qs <> '' AND EXISTS (SELECT 1 FROM e WHERE e.doc = mf.doc AND e.detector_id = {case('mf.method', classify.METHOD_DETECTOR)} AND (contains({squeeze('e.quote')}, qs) OR contains(qs, {squeeze('e.quote')}))) AS hit FROM mf),
        said AS (SELECT doc, list(DISTINCT method) AS ms FROM mh WHERE {grounded} AND (list_contains(implied, method) OR ({usage} AND (hit OR {cue('method', classify.METHOD_CUES, 'qs')} OR (method = 'sbi' AND (({has('context', classify.INVERTIBLE)} AND {has('context', classify.POSTERIOR_OF)} AND {has('context', classify.INVERSE)}) OR ({has('context', classify.NEURAL)} AND {has('context', classify.SIMULATOR)})))))) GROUP BY 1),
        methods AS (SELECT doc, list_concat(list_filter([{', '.join(map(q, classify.METHOD_OF_FACT.values()))}], lambda x: list_contains(coalesce(ms, []), x)), implied) AS l FROM imp LEFT JOIN said USING (doc))"""
    return {
        "classify_labels": f"{base} SELECT doc, array_to_string(labels, ',') AS labels FROM labels",
        "classify_software": f"{base} SELECT doc, array_to_string(software, ',') AS software FROM software",
        "classify_methods": f"{base} SELECT doc, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS methods FROM methods",
        "classify_confidence": f"{base} SELECT doc, round_even(avg(CASE WHEN confidence = 'high' THEN 0.9 ELSE 0.65 END)::DOUBLE, 2) AS confidence FROM first GROUP BY 1",
    }


def oracle_sql() -> dict[str, str]:
    q = lambda s: "'" + str(s).replace("'", "''") + "'"
    # versions with the same time differ in no column that is asked for here except by the whole row's order, which the first column decides
    cur = "cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY report_key ORDER BY updated_at DESC) AS rn FROM (SELECT DISTINCT * FROM archived_papers)) WHERE rn = 1)"
    facet = " UNION ALL ".join(f"SELECT '{f}' AS field, unnest({f}) AS tag FROM cur" for f in archive.TAG_FIELDS)
    hay = "lower(concat_ws(' ', paper_title, identifier, array_to_string(list_filter(paper_authors, lambda x: x IS NOT NULL), ' '), array_to_string(paper_type, ' '), array_to_string(discipline, ' '), array_to_string(methods, ' '), array_to_string(software, ' ')))"
    tiers = ", ".join(f"({q(s)}, {q(x)}, {2 if t == 'expected' else 1})" for s, x, t in TIERS)
    return _classify_sql() | {
        "archive_current": f"WITH {cur} SELECT report_key, paper_title, quality_score, updated_at FROM cur",
        "archive_search": f"WITH {cur} SELECT report_key, paper_title, run_mode FROM cur WHERE contains({hay}, 'model') AND list_has_any(paper_type, ['data_analysis', 'model_development']) AND list_has_any(methods, ['mcmc', 'hmc_nuts', 'variational'])",
        "archive_facets": f"WITH {cur}, f AS ({facet}) SELECT field, tag, count(*) AS n, row_number() OVER (PARTITION BY field ORDER BY lower(tag), tag) AS place FROM f WHERE tag IS NOT NULL GROUP BY field, tag",
        "archive_page": f"WITH {cur} SELECT row_number() OVER (ORDER BY coverage_present / nullif(coverage_applicable, 0) DESC NULLS LAST, report_key) AS place, report_key, coverage_present, coverage_applicable FROM cur QUALIFY place BETWEEN 11 AND 20",
        "archive_sorted": f"WITH {cur}, t AS (SELECT report_key, rubric_profile, quality_score, unnest(paper_type) AS tag FROM cur) SELECT rubric_profile, tag, row_number() OVER (PARTITION BY rubric_profile, tag ORDER BY quality_score DESC NULLS LAST, report_key) AS rank, report_key, quality_score FROM t QUALIFY rank <= 3",
        "override_bank_top8": "WITH n AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 200) SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rank, event_id, user_id FROM n QUALIFY rank <= 8",
        "latest_report_by_paper": "SELECT identifier, rubric_profile, updated_at, report_key FROM (SELECT *, row_number() OVER (PARTITION BY identifier, rubric_profile ORDER BY updated_at DESC, report_key DESC) AS rn FROM archived_papers WHERE identifier IS NOT NULL) WHERE rn = 1",
        "latest_event_per_key": "SELECT user_id, event_type, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
        "job_event_replay": "WITH n AS (SELECT *, row_number() OVER w AS seq, coalesce(bool_or(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS ended FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, seq, event_id, event_type FROM n WHERE NOT ended AND seq > 2",
        "job_fallback_state": "WITH l AS (SELECT user_id, max(event_id)::VARCHAR AS a, (max(event_id) FILTER (event_type = 'purchase'))::VARCHAR AS p, (max(event_id) FILTER (event_type = 'signup'))::VARCHAR AS s FROM events GROUP BY 1) SELECT user_id, CASE WHEN p IS NOT NULL THEN 'purchase' WHEN s IS NOT NULL THEN 'signup' ELSE 'any' END AS origin, coalesce(p, s, a) AS value FROM l",
        "replayable_reports": f"WITH {cur} SELECT report_key, run_mode, engine_version, quality_score FROM cur WHERE run_mode = 'full' AND {' AND '.join(f'{k} = {q(v)}' for k, v in REPLAY.items())} AND quality_score IS NOT NULL AND coverage_applicable > 0",
        "report_merge_upsert": "WITH a AS (SELECT DISTINCT report_key, paper_title, quality_score, array_to_string(software, '|') AS software, created_at, updated_at FROM archived_papers), n AS (SELECT *, row_number() OVER (PARTITION BY report_key ORDER BY updated_at) AS lo, row_number() OVER (PARTITION BY report_key ORDER BY updated_at DESC) AS hi FROM a), o AS (SELECT * FROM n WHERE lo = 1), m AS (SELECT * FROM n WHERE hi = 1) SELECT o.report_key, coalesce(m.paper_title, o.paper_title) AS paper_title, coalesce(m.quality_score, o.quality_score) AS quality_score, m.software, coalesce(o.created_at, m.created_at) AS created_at, m.updated_at FROM o JOIN m USING (report_key)",
        "provider_resolution": "WITH a AS (SELECT DISTINCT identifier, source_sha256, paper_id FROM archived_papers WHERE identifier IS NOT NULL), p AS (SELECT identifier, min('blob:' || source_sha256) AS x FROM a WHERE source_sha256 IN (SELECT source_doc.sha256 FROM parsed_docs) GROUP BY 1), g AS (SELECT identifier, min('page:' || paper_id) AS y FROM a WHERE paper_id IS NOT NULL GROUP BY 1) SELECT i.identifier, CASE WHEN x IS NOT NULL THEN 'parsed' WHEN y IS NOT NULL THEN 'page' END AS origin, coalesce(x, y) AS pdf_url FROM (SELECT DISTINCT identifier FROM a) i LEFT JOIN p USING (identifier) LEFT JOIN g USING (identifier)",
        "version_parts": "SELECT DISTINCT engine_version, len(list_filter(string_split('pkg=' || engine_version || ';models=a=b', ';'), lambda x: contains(x, '=')))::INT AS n, 'a=b' AS models FROM archived_papers WHERE engine_version IS NOT NULL",
        "expectation_tiers": f"WITH t(step_id, label, r) AS (VALUES {tiers}), l AS (SELECT DISTINCT gold_key AS doc, unnest(paper_types) AS label FROM goldset), j AS (SELECT l.doc, s.step_id, l.label, coalesce(t.r, 0) AS r, max(coalesce(t.r, 0)) OVER (PARTITION BY l.doc, s.step_id) AS top FROM l CROSS JOIN (SELECT DISTINCT step_id FROM t) s LEFT JOIN t ON t.step_id = s.step_id AND t.label = l.label) SELECT doc, step_id, CASE top WHEN 2 THEN 'expected' WHEN 1 THEN 'recommended' ELSE 'none' END AS tier, string_agg(label, ', ' ORDER BY label) AS asked_by FROM j WHERE r = top GROUP BY doc, step_id, top",
        "ext_misclassification_prevalence": "SELECT source, round(least(greatest((avg((lang = 'en')::INT) + 0.8 - 1) / (0.95 + 0.8 - 1), 0), 1)::DOUBLE, 9) AS prevalence FROM documents GROUP BY 1",
        "ext_stratified_sample": "SELECT * FROM (SELECT doc_id, lang, doc_style, row_number() OVER (PARTITION BY lang, doc_style ORDER BY md5('7|' || doc_id), doc_id)::INT AS place FROM documents) WHERE place <= 5",
        "ext_flow_counts": "WITH k AS (SELECT report_key, count(*) AS n, bool_or(source_sha256 IS NOT NULL) AS s, bool_or(quality_score IS NOT NULL) AS q FROM archived_papers GROUP BY 1) SELECT 'identified' AS stage, sum(n)::BIGINT AS n FROM k UNION ALL SELECT 'deduplicated', count(*) FROM k UNION ALL SELECT 'retrieved', count(*) FILTER (s) FROM k UNION ALL SELECT 'graded', count(*) FILTER (s AND q) FROM k",
        "provider_records": "WITH a AS (SELECT DISTINCT paper_id, paper_title AS title, paper_year AS year FROM archived_papers WHERE paper_id IS NOT NULL), d AS (SELECT *, CASE WHEN regexp_matches('10.5555/' || lower(paper_id), '^10\\.\\d{4,9}/\\S+$') THEN '10.5555/' || lower(paper_id) END AS doi FROM a) SELECT DISTINCT paper_id, 'openalex' AS provider, title, year, '10.5555/' || lower(paper_id) AS doi, 'u/' || paper_id AS pdf_url FROM d UNION SELECT paper_id, 'unpaywall', title, year, NULL, 'v/' || paper_id FROM d UNION SELECT paper_id, 'crossref', title, NULL, doi, NULL FROM d",
        "ext_quality_over_time": f"WITH {cur} SELECT paper_year, rubric_profile, round(avg(quality_score), 9) AS quality, count(*) AS n FROM cur WHERE paper_year IS NOT NULL GROUP BY ALL",
    }
