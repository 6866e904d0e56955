"""Decisions that follow from evidence: the relevance floor, gate facts, grounding of quotes in sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.text import match_text, quote_in_plain, squeeze
from auditloom.operators.skew import skew_join

# Which family each kind of evidence speaks for; open science speaks for none.
FAMILY_OF_KIND = {"software_mention": "software", "method_mention": "method", "diagnostic_value": "diagnostic", "diagnostic_mention": "diagnostic", "workflow_signal": "workflow", "sampler_config": "sampler"}
SAMPLING = ("method.mcmc", "method.variational", "diag.rhat", "diag.ess", "diag.divergences", "diag.trace_plot", "diag.rank_plot", "diag.treedepth", "diag.bfmi", "diag.mcse", "sampler.chains", "sampler.iterations", "sampler.warmup")
METHOD_ORDER = ("exact_analytic", "variational", "mcmc", "sbi", "abc", "smc", "laplace_inla", "map", "em")


def family_of(kind):
    return F.coalesce(*[F.when(kind == k, F.lit(f)) for k, f in FAMILY_OF_KIND.items()])


def substantive(evidence: DataFrame, key: str = "doc_key") -> DataFrame:
    """Per document: the families found, sorted, and its first three substantive evidence numbers."""
    e = evidence.withColumn("family", family_of(F.col("kind"))).filter("family IS NOT NULL")
    refs = F.slice(F.array_sort(F.collect_set("evidence_ref")), 1, 3)
    return e.groupBy(key).agg(F.array_sort(F.collect_set("family")).alias("families"), refs.alias("first_refs"))


def screen_floor(labels: DataFrame, evidence: DataFrame, key: str = "doc_key", least: int = 2) -> DataFrame:
    """Correct recorded relevance labels by the evidence: adds final, final_refs, repair.

    A relevant label without references gets the first substantive ones, or becomes "no" if there are none. A "no"
    against ``least`` or more families becomes "partial". ``labels``: key, label, refs.
    """
    j = labels.join(substantive(evidence, key), key, "left")
    none = F.array().cast("array<int>")
    families, first, refs = F.coalesce(F.size("families"), F.lit(0)), F.coalesce("first_refs", none), F.coalesce(F.col("refs").cast("array<int>"), none)
    bare = F.col("label").isin("yes", "partial") & (F.size(refs) == 0)
    label = F.when(bare & (F.size(first) == 0), "no").otherwise(F.col("label"))
    raised = (label == "no") & (families >= least)
    final_refs = F.when(bare | (raised & (F.size(refs) == 0)), first).otherwise(refs)
    repair = F.when(raised, "raised").when(bare & (F.size(first) > 0), "refs attached").when(bare, "downgraded")
    return j.select(*labels.columns, F.when(raised, "partial").otherwise(label).alias("final"), final_refs.alias("final_refs"), repair.alias("repair"))


def prior_informativeness(quotes):
    """From the joined quotes of the prior detector, tested in order."""
    q = F.lower(quotes)
    return (
        F.when(F.coalesce(q, F.lit("")) == "", "unstated").when(q.contains("weakly"), "weakly_informative").when(q.contains("non-informative") | q.contains("noninformative") | q.contains("flat"), "none")
        .when(q.contains("informative"), "informative").when(q.contains("default"), "default").otherwise("unstated")
    )


def gate_facts(evidence: DataFrame, methods: DataFrame | None = None, key: str = "doc_key") -> DataFrame:
    """Facts about the analysis from the set of detectors that fired: inference_method, n_models, bf_claimed, prior_informativeness.

    ``methods`` (key, methods_used) takes precedence over detectors, in METHOD_ORDER.
    """
    hit = lambda *ids: F.max(F.col("detector_id").isin(*ids).cast("int")) == 1
    quotes = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("detector_id") == "method.prior", F.struct("evidence_ref", "quote")))), lambda x: x["quote"]), " ")
    g = evidence.groupBy(key).agg(hit("method.analytic").alias("analytic"), hit(*SAMPLING).alias("sampled"), hit("method.variational").alias("vi"), hit("method.mcmc").alias("mcmc"), hit("diag.loo_waic", "diag.pareto_k").alias("compared"), hit("method.bayes_factor").alias("bf"), quotes.alias("quotes"))
    detected = F.when(F.col("analytic") & ~F.col("sampled"), "exact_analytic").when(F.col("vi"), "variational").when(F.col("mcmc"), "mcmc").otherwise("unstated")
    if methods is not None:
        g = g.join(methods.select(key, "methods_used"), key, "left")
        said = F.coalesce(*[F.when(F.array_contains("methods_used", m), F.lit(m)) for m in METHOD_ORDER], F.when(F.array_contains("methods_used", "hmc_nuts"), F.lit("mcmc")))
        detected = F.coalesce(said, detected)
    return g.select(key, detected.alias("inference_method"), F.when(F.col("compared"), 2).otherwise(1).alias("n_models"), F.col("bf").alias("bf_claimed"), prior_informativeness(F.col("quotes")).alias("prior_informativeness"))


def ground_quotes(quotes: DataFrame, sections: DataFrame, keys: list[str]) -> DataFrame:
    """Quotes with whether their section holds them verbatim and whether they count as grounded: adds verbatim, grounded.

    ``quotes``: keys, quote; ``sections``: keys, text. A quote without section is neither.
    """
    # each section is normalised once, before it meets its quotes; a section with a large share of them is salted
    texts = sections.select(*keys, "text", match_text(F.col("text")).alias("_plain"))
    j = skew_join(quotes, texts, keys, "left")
    return j.withColumn("verbatim", F.coalesce(F.contains("text", "quote"), F.lit(False))).withColumn("grounded", quote_in_plain(F.col("quote"), F.col("_plain"))).drop("text", "_plain")


def first_section_with(quotes: DataFrame, documents: DataFrame, key: str = "doc_key") -> DataFrame:
    """For each quote (key, quote_id, quote) the first section of its document that contains it: key, quote_id, section_pos; quotes found nowhere give no row.

    ``documents``: key and the array ``sections``; a quote looks through its document's row, so no section is joined by
    itself. Of several rows of a document the first place counts.
    """
    asked = quotes.filter(F.trim("quote") != "").select(key, "quote_id", F.trim("quote").alias("_quote"))
    j = skew_join(asked, documents.select(key, F.transform("sections", lambda s: s["text"]).alias("_texts")), [key])
    at = F.array_position(F.transform("_texts", lambda t: F.contains(t, F.col("_quote"))), F.lit(True))
    return j.select(key, "quote_id", at.alias("at")).filter("at > 0").groupBy(key, "quote_id").agg((F.min("at") - 1).cast("int").alias("section_pos"))


def facts_with_evidence(facts: DataFrame, evidence: DataFrame, key: str = "doc_key") -> DataFrame:
    """For each fact (key, fact_id, quote) the first evidence whose quote holds the fact's, or the other way round: key, fact_id, evidence_ref."""
    f = facts.withColumn("q", squeeze(F.col("quote"))).filter(F.col("q") != "")
    e = evidence.select(key, "evidence_ref", squeeze(F.col("quote")).alias("h"))
    j = f.join(e, key).filter(F.contains("h", "q") | F.contains("q", "h"))
    return j.groupBy(key, "fact_id").agg(F.min("evidence_ref").alias("evidence_ref"))


def unique_spans(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence with each (section, quote) of a key once, the first by number."""
    w = Window.partitionBy(*keys, "section_id", "quote").orderBy("evidence_ref")
    return evidence.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
