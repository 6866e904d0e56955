import pytest
from pyspark.sql import functions as F

from auditloom.functions import text as tx
from auditloom.operators.detect import CATALOG, run_detectors, sentence_ends, sentence_span

IDENTIFIERS = [
    ("2011.01808", "arxiv", "2011.01808", None), ("arXiv:2011.01808v2", "arxiv", "2011.01808", "v2"), ("https://arxiv.org/abs/2011.01808v3", "arxiv", "2011.01808", "v3"), ("https://arxiv.org/pdf/2011.01808.pdf", "arxiv", "2011.01808", None),
    ("stat.ME/0701001", "arxiv", "stat.me/0701001", None), ("10.1214/20-BA1221", "doi", "10.1214/20-ba1221", None), ("doi:10.1/x", None, None, None), ("https://doi.org/10.1038/S41562", "doi", "10.1038/s41562", None),
    ("w2741809807", "openalex", "W2741809807", None), ("PMC123", "pubmed", "PMC123", None), ("https://www.ncbi.nlm.nih.gov/pmc/articles/pmc77/", "pubmed", "PMC77", None), ("PMID: 99", "pubmed", "99", None),
    ("https://osf.io/preprints/psyarxiv/AB1cd_v2", "osf", "ab1cd_v2", None), ("https://www.sciencedirect.com/science/article/pii/s0022", "pii", "S0022", None), ("https://example.org/x", "url", "https://example.org/x", None),
    ("", None, None, None), ("  ", None, None, None), ("not an id", None, None, None), ("42", None, None, None), ("14699080", None, None, None), (None, None, None, None),
]


def test_identifiers(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(IDENTIFIERS)], "i int, raw string").select("i", tx.parse_identifier(F.col("raw")).alias("p"))
    got = {r.i: (r.p.kind, r.p.value, r.p.version) if r.p else (None, None, None) for r in df.collect()}
    assert got == {i: r[1:] for i, r in enumerate(IDENTIFIERS)}


@pytest.mark.parametrize("raw, want", [("  A   title ", "A title"), ("A BAYESIAN WORKFLOW", "A bayesian workflow"), ("“ALL CAPS” 2", "“All caps” 2"), ("pH OF", "pH OF"), ("", None), ("   ", None), (None, None), ("123", "123"), ("日本 ABC", "日本 ABC")])
def test_titles(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(tx.normalize_title(F.col("t")).alias("o")).first().o == want


def test_small_expressions(spark):
    row = spark.range(1).select(
        tx.split_authors(F.lit("A. One; B. Two and C  Three & d@x.org / Q\nR")).alias("authors"), tx.split_authors(F.lit(None).cast("string")).alias("none"), tx.year_in(F.lit("D:20210315")).alias("year"), tx.year_in(F.lit("9999 x")).alias("bad"),
        tx.bucket_key(F.lit(""), F.lit("a b/c"), F.lit("")).alias("bucket"), tx.trim_to_sentence(F.lit("One. Two words here."), 12).alias("cut"), tx.trim_to_sentence(F.lit("aaaa bbbb cccc"), 12).alias("cut2"),
        tx.tags(F.array(F.lit(" Machine Learning "), F.lit("machine learning"), F.lit(None), F.lit("")), 3).alias("tags"), tx.distinct_ignoring_case(F.array(F.lit("Stan"), F.lit("STAN"), F.lit("x"))).alias("ci"),
        tx.metadata_title(F.lit("paper_final.pdf")).alias("file"), tx.metadata_title(F.lit("Untitled thing here")).alias("junk"), tx.metadata_title(F.lit("On good priors")).alias("good"),
        tx.version_parts(F.lit("pkg=1;models=a=b;x")).alias("parts"), tx.byline(F.array(*map(F.lit, "ABCD")), F.lit(2020)).alias("by"),
    ).first()
    assert row.authors == ["A. One", "B. Two", "C Three", "Q", "R"] and row.none == [] and (row.year, row.bad) == (2021, None)
    assert row.bucket == "a_b_c___" and row.cut == "One. Two…" and row.cut2 == "aaaa bbbb…"
    assert row.tags == ["machine-learning"] and row.ci == ["Stan", "x"] and (row.file, row.junk, row.good) == (None, None, "On good priors")
    assert row.parts == {"pkg": "1", "models": "a=b"} and row.by == "A, B, C · 2020"


def test_quote_grounding(spark):
    text = "We fitted the hierarchical drift diffusion model with four chains and checked convergence carefully."
    cases = [("We FITTED — the hierarchical", True), ("fitted hierarchical drift diffusion four chains checked convergence wrongly", True), ("nothing alike here", False), ("", False), (None, False)]
    df = spark.createDataFrame([(q, text) for q, _ in cases], "q string, t string").select("q", tx.quote_in_text(F.col("q"), F.col("t")).alias("g"))
    assert {r.q: r.g for r in df.collect()} == dict(cases)


HITS = [
    ("Fitted in Stan.", "software.stan"), ("with brms 2.1", "software.brms"), ("We used PyMC3", "software.pymc"), ("OpenBUGS was run", "software.bugs"), ("weakly informative priors", "method.prior"), ("the posterior was", "method.posterior"), ("95% HDI", "method.credible_interval"),
    ("using NUTS", "method.mcmc"), ("R-hat < 1.01", "diag.rhat"), ("R̂ was 1.00", "diag.rhat"), ("effective sample size", "diag.ess"), ("12 divergent transitions", "diag.divergences"), ("Pareto k values", "diag.pareto_k"), ("PSIS-LOO", "diag.loo_waic"), ("4 chains", "sampler.chains"),
    ("random seed", "sampler.seed"), ("code is available", "open.code"), ("see github.com/x", "open.github"), ("prior predictive checks", "workflow.prior_predictive"), ("rank histograms", "diag.rank_plot"),
]
NO_HITS = [("Stanford", "software.stan"), ("debugs", "software.bugs"), ("Manhattan", "diag.rhat"), ("assess", "diag.ess"), ("nuts and bolts", "method.mcmc"), ("looser", "diag.loo_waic"), ("a map of", "method.map"), ("ABCD", "method.abc"), ("smc", "method.smc")]
SECTION = "array<struct<id:string,kind:string,title:string,text:string,page_spans:array<struct<doc_sha256:string,page_start:int,page_end:int>>>>"


def _docs(spark, texts, kind="body"):
    return spark.createDataFrame([(i, [("s01", kind, "T", t, [("x", 3, 4)])]) for i, t in enumerate(texts)], f"doc_key long, sections {SECTION}")


def test_detectors(spark):
    assert len(CATALOG) == 50
    got = {(r.doc_key, r.detector_id) for r in run_detectors(_docs(spark, [t for t, _ in HITS])).collect()}
    assert all((i, d) in got for i, (_, d) in enumerate(HITS))
    bad = {(r.doc_key, r.detector_id) for r in run_detectors(_docs(spark, [t for t, _ in NO_HITS])).collect()}
    assert not any((i, d) in bad for i, (_, d) in enumerate(NO_HITS))


def test_values_order_and_skips(spark):
    texts = ["R-hat < 1.01", "Rhat = 1.002", "bulk-ESS was 1,500", "12 divergent transitions", "no divergent transitions", "we watched divergences", "ESS for 4 parameters", "Stan, stan, Stan and the posterior predictive"]
    rows = run_detectors(_docs(spark, texts)).collect()
    value = {(r.doc_key, r.detector_id): (r.kind, r.value and (r.value.op, r.value.value, r.value["count"])) for r in rows}
    assert value[0, "diag.rhat"] == ("diagnostic_value", ("<", 1.01, None)) and value[1, "diag.rhat"][1][:2] == ("=", 1.002) and value[2, "diag.ess"][1][1] == 1500.0
    assert value[3, "diag.divergences"][1][2] == 12 and value[4, "diag.divergences"][1][2] == 0 and value[5, "diag.divergences"] == ("diagnostic_mention", None) and value[6, "diag.ess"] == ("diagnostic_mention", None)
    last = sorted((r for r in rows if r.doc_key == 7), key=lambda r: r.evidence_ref)
    assert [(r.detector_id, r.page) for r in last] == [("software.stan", 3), ("method.posterior", 3), ("workflow.posterior_predictive", 3)]
    assert run_detectors(_docs(spark, texts, "references")).count() == 0 and run_detectors(_docs(spark, ["", None])).count() == 0
    assert run_detectors(spark.createDataFrame([(1, None)], f"doc_key long, sections {SECTION}")).count() == 0


@pytest.mark.parametrize("text, word, want", [("One. The R-hat was 1.01 here. Two.", "R-hat", "The R-hat was 1.01 here."), ("See Fig. 3 of J. Smith et al. for it. Next", "Smith", "See Fig. 3 of J. Smith et al. for it."), ("no end", "end", "no end"), ("Ends here! Yes", "here", "Ends here!")])
def test_sentences(text, word, want):
    at = text.index(word)
    assert sentence_span(text, at, at + len(word)) == want


def test_long_sentence_keeps_match_and_words():
    text = "aaa " * 200 + "MATCH " + "bbb " * 200
    q = sentence_span(text, 800, 805, most=100)
    assert "MATCH" in q and q in text and len(q) <= 100 and set(q.split()) <= {"aaa", "bbb", "MATCH"}
    assert sentence_ends("A. b? c") == [5]
