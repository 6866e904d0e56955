"""Queries of text, sections, context, grounding and screening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions import text as tx
from auditloom.operators import context, detect, screen, sections
from auditloom.sources import providers


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "evidence")
    return e.select("evidence_id", "doc_key", "evidence_ref", "detector_id", "kind", F.col("span.section_id").alias("section_id"), F.col("span.quote").alias("quote")).dropDuplicates(["evidence_id"])


def identifier_parse(spark: SparkSession, d: str) -> DataFrame:
    raw = _t(spark, d, "archived_papers").select(F.col("identifier").alias("raw")).unionByName(_t(spark, d, "goldset").select(F.col("url").alias("raw"))).filter("raw IS NOT NULL").distinct()
    p = raw.withColumn("p", tx.parse_identifier(F.col("raw")))
    ids = tx.paper_ids(F.col("p"))
    return p.select("raw", "p.kind", "p.value", "p.version", ids["doi"].alias("doi"), ids["arxiv_id"].alias("arxiv_id"))


def title_normalize(spark: SparkSession, d: str) -> DataFrame:
    both = _t(spark, d, "archived_papers").select(F.col("paper_title").alias("raw")).unionByName(_t(spark, d, "documents").select(F.col("title").alias("raw")))
    shouted = F.when(F.length("raw") % 3 == 0, F.upper("raw")).otherwise(F.concat(F.lit("  "), F.replace(F.col("raw"), F.lit(" "), F.lit("  "))))
    return both.filter("raw IS NOT NULL").select(shouted.alias("raw")).distinct().select("raw", tx.normalize_title(F.col("raw")).alias("title"))


def author_split(spark: SparkSession, d: str) -> DataFrame:
    """Author lists joined as a file's metadata has them, and split again."""
    joined = _t(spark, d, "parsed_docs").select("doc_key", "paper_year", F.concat_ws(" and ", F.array_join("authors", "; "), F.lit("A. Last & info@example.org")).alias("raw")).distinct()
    names = tx.split_authors(F.col("raw"))
    return joined.select("doc_key", F.array_join(names, "|").alias("names"), F.size(names).alias("n"), tx.byline(names, F.col("paper_year")).alias("byline"))


def bucket_keys(spark: SparkSession, d: str) -> DataFrame:
    a = _t(spark, d, "archived_papers").select("source_sha256", "paper_id", "rubric_profile").distinct()
    return a.select("paper_id", "rubric_profile", "source_sha256", tx.bucket_key(F.col("source_sha256"), F.col("paper_id"), F.col("rubric_profile")).alias("bucket"), tx.short_hash(F.coalesce("paper_id", F.lit(""))).alias("short"))


def content_hash_dedupe(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), "doc_id")
    return docs.filter("sha256 IS NOT NULL").groupBy("sha256").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def tag_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Software names of screen cases, the first of those that differ in case only; classes as tags."""
    s = _t(spark, d, "screen_cases").select("case_key", "expect_software", "expect_labels").dropDuplicates(["case_key"])
    return s.select("case_key", F.array_join(tx.distinct_ignoring_case(F.array_compact("expect_software")), "|").alias("software"), F.array_join(tx.tags(F.col("expect_labels"), underscores=True), "|").alias("labels"))


def _full_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts to split: the documents, and the parsed papers put together again with the headings and captions of their sections (doc_id -1 - doc_key)."""

    def part(s: Column) -> Column:
        title, text = F.coalesce(s["title"], F.lit("")), F.coalesce(s["text"], F.lit(""))
        head = F.when(s["kind"] == "caption", F.concat(title, F.lit(". "))).when(s["kind"] == "body", F.concat(F.lit("# "), title, F.lit("\n"))).when(s["kind"] == "supplement", F.lit("Supplementary information\n"))
        return F.concat(F.coalesce(head, F.concat(title, F.lit("\n"))), text)

    papers = _t(spark, d, "parsed_docs").dropDuplicates(["doc_key"]).select((-1 - F.col("doc_key")).alias("doc_id"), F.array_join(F.transform("sections", part), "\n").alias("text"))
    return _t(spark, d, "documents").select("doc_id", "text").unionByName(papers)


def section_split(spark: SparkSession, d: str) -> DataFrame:
    s = sections.split_sections(_full_texts(spark, d), "doc_id")
    return s.select("doc_id", "section_id", "kind", "title", F.length("text").alias("n_chars"))


def section_kinds(spark: SparkSession, d: str) -> DataFrame:
    return sections.section_lines(_full_texts(spark, d), "doc_id").groupBy("kind", "is_caption").agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct("doc_id").alias("n_docs"))


def context_budget(spark: SparkSession, d: str) -> DataFrame:
    c = context.contexts(_t(spark, d, "parsed_docs"), 1200, 2500).distinct()
    return c.select("doc_key", F.length("excerpt").alias("n_excerpt"), F.md5(F.col("excerpt").cast("binary")).alias("excerpt_md5"), F.length("assessment").alias("n_assessment"), F.md5(F.col("assessment").cast("binary")).alias("assessment_md5"))


def evidence_digest(spark: SparkSession, d: str) -> DataFrame:
    return context.evidence_digest(_evidence(spark, d)).select("doc_key", F.length("digest").alias("n_chars"), F.md5(F.col("digest").cast("binary")).alias("digest_md5"))


def dangling_refs(spark: SparkSession, d: str) -> DataFrame:
    """Citations of the first ten evidence numbers where a document has fewer."""
    claims = _t(spark, d, "parsed_docs").select("doc_key").distinct().withColumn("refs", F.sequence(F.lit(0), F.lit(29)))
    return context.dangling_refs(claims, _evidence(spark, d)).select("doc_key", "n", F.size("bad").alias("n_bad"))


def quote_grounding(spark: SparkSession, d: str) -> DataFrame:
    secs = detect.sections_of(_t(spark, d, "parsed_docs")).select("doc_key", "section_id", "text")
    g = screen.ground_quotes(_evidence(spark, d).select("evidence_id", "doc_key", "section_id", "quote"), secs, ["doc_key", "section_id"])
    return g.groupBy("evidence_id").agg(F.max("verbatim").alias("verbatim"), F.max("grounded").alias("grounded"))


def quote_first_section(spark: SparkSession, d: str) -> DataFrame:
    return screen.first_section_with(_evidence(spark, d).select("doc_key", F.col("evidence_id").alias("quote_id"), "quote"), _t(spark, d, "parsed_docs"))


def unique_spans(spark: SparkSession, d: str) -> DataFrame:
    return screen.unique_spans(_evidence(spark, d), ["doc_key"]).select("doc_key", "section_id", "quote", "evidence_ref")


def screen_floor(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "parsed_docs").select("doc_key").distinct()
    label = F.element_at(F.array(F.lit("yes"), F.lit("partial"), F.lit("no")), (F.col("doc_key") % 3 + 1).cast("int"))
    labels = docs.select("doc_key", label.alias("label"), F.when(F.col("doc_key") % 2 == 0, F.array(F.lit(0))).alias("refs"))
    out = screen.screen_floor(labels, _evidence(spark, d))
    return out.select("doc_key", "label", "final", F.array_join(F.transform("final_refs", lambda x: x.cast("string")), ",").alias("refs"), "repair")


def gate_facts(spark: SparkSession, d: str) -> DataFrame:
    return screen.gate_facts(_evidence(spark, d))


def step_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence by rubric step, by the beginnings of detector ids."""
    pairs = [(s, p) for s, ps in STEP_PREFIXES.items() for p in ps]
    of = F.array_distinct(F.array_compact(F.array(*[F.when(F.col("detector_id").startswith(p), F.lit(s)) for s, p in pairs])))
    return _evidence(spark, d).select("doc_key", "evidence_id", F.explode(of).alias("step_id")).groupBy("doc_key", "step_id").agg(F.count(F.lit(1)).alias("n"))


# Which detectors speak for a step.
STEP_PREFIXES = {
    "S1": ("software.", "method."), "S2": ("method.prior",), "S3": ("workflow.prior_predictive",), "S4": ("diag.", "sampler.chains", "sampler.iterations", "sampler.warmup", "method.mcmc", "method.variational"),
    "S5": ("workflow.posterior_predictive",), "S6": ("diag.loo_waic", "diag.pareto_k", "method.bayes_factor"), "S7": ("workflow.sbc", "workflow.recovery"), "S8": ("workflow.sensitivity",), "S9": ("open.", "sampler.seed", "software."), "S10": ("method.credible_interval", "method.posterior"),
}


def trimmed_rationales(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.md5(tx.trim_to_sentence(F.col("text"), 200).cast("binary")).alias("trimmed_md5"), F.length(tx.trim_to_sentence(F.col("text"), 200)).alias("n"))


def token_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Tokens by source and style, with totals; unknown counts are 0."""
    docs = _t(spark, d, "documents")
    return docs.groupBy("source").agg(F.sum(F.coalesce("n_tokens", F.lit(0))).alias("tokens"), F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("doc_style")), ",").alias("styles"))


def citation_meta(spark: SparkSession, d: str) -> DataFrame:
    """Landing pages made of the parsed papers, read back."""
    p = _t(spark, d, "parsed_docs").select("doc_key", "title", "authors", "paper_year").dropDuplicates(["doc_key"]).filter("title IS NOT NULL")
    names = F.array_join(F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda a: F.concat(F.lit('<meta name="citation_author" content="'), a, F.lit('">'))), "")
    html = F.concat(F.lit('<html><head><meta name="citation_title" content="'), F.replace(F.col("title"), F.lit('"'), F.lit("&quot;")), F.lit('">'), names, F.lit('<meta name="citation_title" content="second"></head>'))
    out = p.select("doc_key", providers.citation_meta(html).alias("m"))
    return out.select("doc_key", "m.title", F.array_join("m.authors", "|").alias("authors"))


QUERIES = (
    identifier_parse, title_normalize, author_split, bucket_keys, content_hash_dedupe, tag_normalize, section_split, section_kinds, context_budget, evidence_digest, dangling_refs, quote_grounding, quote_first_section,
    unique_spans, screen_floor, gate_facts, step_evidence, trimmed_rationales, token_ledger, citation_meta,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    ev = "ev AS (SELECT DISTINCT evidence_id, doc_key, evidence_ref, detector_id, kind, span.section_id AS section_id, span.quote AS quote FROM evidence)"
    sec = "sec AS (SELECT DISTINCT doc_key, i - 1 AS section_pos, s.id AS section_id, s.kind AS kind, s.title AS title, s.text AS text FROM (SELECT doc_key, unnest(sections) AS s, generate_subscripts(sections, 1) AS i FROM parsed_docs))"
    fam = "CASE WHEN kind = 'software_mention' THEN 'software' WHEN kind = 'method_mention' THEN 'method' WHEN kind IN ('diagnostic_value', 'diagnostic_mention') THEN 'diagnostic' WHEN kind = 'workflow_signal' THEN 'workflow' WHEN kind = 'sampler_config' THEN 'sampler' END"
    norm = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"
    stop = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
    squeeze = lambda c: f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
    ids = lambda c: f"nullif(regexp_extract({c[0]}, {c[1]}, {c[2] if len(c) > 2 else 1}), '')"
    q = lambda s: "'" + s.replace("'", "''") + "'"
    budget = lambda kinds, n, order: f"""SELECT doc_key, string_agg(CASE WHEN before + len > {n} THEN substr(block, 1, ({n} - before)::INT) ELSE block END, chr(10) || chr(10) ORDER BY {order}) AS txt FROM (SELECT *, coalesce(sum(len) OVER (PARTITION BY doc_key ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM
        (SELECT doc_key, section_pos, kind, '## ' || coalesce(nullif(title, ''), kind) || chr(10) || text AS block, length('## ' || coalesce(nullif(title, ''), kind) || chr(10) || text) AS len FROM sec WHERE length(text) > 0 AND kind IN ({kinds}))) WHERE before < {n} GROUP BY doc_key"""  # noqa: E731
    captions, refs, abst, app = (q(p) for p in (sections.CAPTION, sections.REFERENCES, sections.ABSTRACT, sections.APPENDIX))
    lines = f"""full_texts AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - doc_key, string_agg(CASE kind WHEN 'caption' THEN coalesce(title, '') || '. ' WHEN 'body' THEN '# ' || coalesce(title, '') || chr(10) WHEN 'supplement' THEN 'Supplementary information' || chr(10) ELSE coalesce(title, '') || chr(10) END || coalesce(text, ''), chr(10) ORDER BY section_pos) FROM sec GROUP BY doc_key),
        l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM full_texts),
        l1 AS (SELECT *, regexp_matches(line, {captions}) AS is_caption FROM l0),
        l2 AS (SELECT *, NOT is_caption AND (regexp_matches(line, '^#{{1,6}}\\s') OR regexp_matches(line, {refs}) OR regexp_matches(line, {abst}) OR (regexp_matches(line, {app}) AND length(line) <= 60)) AS heading, regexp_replace(line, '^#{{1,6}}\\s+', '') AS bare FROM l1),
        l3 AS (SELECT *, CASE WHEN NOT heading THEN NULL WHEN regexp_matches(bare, {refs}) THEN 'references' WHEN regexp_matches(bare, {app}) THEN 'supplement' WHEN regexp_matches(bare, {abst}) THEN 'abstract' ELSE 'plain' END AS own FROM l2),
        l4 AS (SELECT *, last_value(CASE WHEN own <> 'plain' THEN own END IGNORE NULLS) OVER w AS state, last_value(own IGNORE NULLS) OVER w AS lst, sum(heading::INT) OVER w AS section_no FROM l3 WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
        lines AS (SELECT *, CASE WHEN is_caption THEN 'caption' WHEN lst IS NULL THEN 'body' WHEN lst <> 'plain' THEN lst WHEN state = 'references' THEN 'references' ELSE 'body' END AS kind FROM l4)"""
    ident = f"""WITH raws AS (SELECT DISTINCT raw, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS v FROM (SELECT identifier AS raw FROM archived_papers UNION ALL SELECT url FROM goldset) WHERE raw IS NOT NULL),
        x AS (SELECT raw, v, coalesce({ids(('v', q(tx.ARXIV_URL)))}, v) AS a, {ids(('v', q(tx.DOI)))} AS doi FROM raws),
        y AS (SELECT *, {ids(('a', q(tx.ARXIV_NEW)))} AS an, {ids(('a', q(tx.ARXIV_NEW), 2))} AS av, lower({ids(('a', q(tx.ARXIV_OLD)))}) AS ao, {ids(('a', q(tx.ARXIV_OLD), 2))} AS aw, upper({ids(('v', q(tx.OPENALEX)))}) AS oa, upper(coalesce({ids(('v', q(tx.PMC[0])))}, {ids(('v', q(tx.PMC[1])))})) AS pmc, coalesce({ids(('v', q(tx.PMID[0])))}, {ids(('v', q(tx.PMID[1])))}) AS pmid, lower(coalesce({ids(('v', q(tx.OSF[0])))}, {ids(('v', q(tx.OSF[1])))})) AS osf, upper({ids(('v', q(tx.PII)))}) AS pii, CASE WHEN regexp_matches(v, {q(tx.URL)}) THEN v END AS url FROM x)
        SELECT raw, CASE WHEN coalesce(an, ao) IS NOT NULL THEN 'arxiv' WHEN doi IS NOT NULL THEN 'doi' WHEN oa IS NOT NULL THEN 'openalex' WHEN coalesce(pmc, pmid) IS NOT NULL THEN 'pubmed' WHEN osf IS NOT NULL THEN 'osf' WHEN pii IS NOT NULL THEN 'pii' WHEN url IS NOT NULL THEN 'url' END AS kind,
        coalesce(an, ao, lower(doi), oa, pmc, pmid, osf, pii, url) AS value, CASE WHEN an IS NOT NULL THEN av WHEN ao IS NOT NULL THEN aw END AS version, CASE WHEN coalesce(an, ao) IS NULL THEN lower(doi) END AS doi, coalesce(an, ao) AS arxiv_id FROM y"""
    hit = lambda *xs: f"coalesce(bool_or(detector_id IN ({', '.join(map(q, xs))})), FALSE)"
    prior = "string_agg(quote, ' ' ORDER BY evidence_ref, quote) FILTER (detector_id = 'method.prior' AND quote IS NOT NULL)"
    trim = "CASE WHEN length(t) <= 200 THEN t WHEN length(regexp_extract(substr(t, 1, 200), '^((?s).*[.!?])', 1)) > 100 THEN regexp_extract(substr(t, 1, 200), '^((?s).*[.!?])', 1) ELSE coalesce(nullif(regexp_extract(substr(t, 1, 200), '^((?s).+) ', 1), ''), substr(t, 1, 200)) || '…' END"
    raised = "(lab = 'no' AND nf >= 2)"
    return {
        "identifier_parse": ident,
        "title_normalize": "WITH raws AS (SELECT DISTINCT CASE WHEN length(raw) % 3 = 0 THEN upper(raw) ELSE '  ' || replace(raw, ' ', '  ') END AS raw FROM (SELECT paper_title AS raw FROM archived_papers UNION ALL SELECT title FROM documents) WHERE raw IS NOT NULL), t AS (SELECT raw, nullif(trim(regexp_replace(raw, '\\s+', ' ', 'g')), '') AS t FROM raws) SELECT raw, CASE WHEN regexp_matches(t, '\\p{Lu}') AND NOT regexp_matches(t, '[\\p{Ll}\\p{Lt}\\p{Lm}\\p{Lo}]') THEN regexp_extract(lower(t), '^([^\\p{L}]*)(\\p{L})', 1) || upper(regexp_extract(lower(t), '^([^\\p{L}]*)(\\p{L})', 2)) || regexp_replace(lower(t), '^[^\\p{L}]*\\p{L}', '') ELSE t END AS title FROM t",
        "author_split": "WITH r AS (SELECT DISTINCT doc_key, paper_year, concat_ws(' and ', coalesce(array_to_string(list_filter(authors, lambda x: x IS NOT NULL), '; '), NULL), 'A. Last & info@example.org') AS raw FROM parsed_docs), n AS (SELECT doc_key, paper_year, list_filter(list_transform(regexp_split_to_array(raw, '(?i)\\s*(?:;|\\band\\b|&|\\n|/)\\s*'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '' AND NOT contains(x, '@') AND length(x) <= 80)[1:25] AS names FROM r) SELECT doc_key, array_to_string(names, '|') AS names, len(names)::INT AS n, concat_ws(' · ', array_to_string(names[1:3], ', '), paper_year::VARCHAR) AS byline FROM n",
        "bucket_keys": "WITH a AS (SELECT DISTINCT source_sha256, paper_id, rubric_profile FROM archived_papers), b AS (SELECT *, regexp_replace(coalesce(nullif(source_sha256, ''), paper_id, ''), '[^\\p{L}\\p{N}_-]', '_', 'g') AS x, regexp_replace(coalesce(rubric_profile, ''), '[^\\p{L}\\p{N}_-]', '_', 'g') AS y FROM a) SELECT paper_id, rubric_profile, source_sha256, CASE WHEN x = '' THEN '_' ELSE x END || '__' || CASE WHEN y = '' THEN '_' ELSE y END AS bucket, substr(sha256(coalesce(paper_id, '')), 1, 12) AS short FROM b",
        "content_hash_dedupe": "SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
        "tag_normalize": "WITH s AS (SELECT DISTINCT case_key, expect_software, expect_labels FROM screen_cases) SELECT case_key, array_to_string(list_transform(list_filter(list_transform(v, lambda x, i: {'x': x, 'keep': list_position(list_transform(v, lambda y: lower(y)), lower(x)) = i}), lambda z: z.keep), lambda z: z.x), '|') AS software, coalesce(array_to_string(list_transform(list_filter(w, lambda x: x <> ''), lambda x: x), '|'), NULL) AS labels FROM (SELECT case_key, coalesce(list_filter(expect_software, lambda x: x IS NOT NULL), []) AS v, list_transform(list_filter(expect_labels, lambda x: x IS NOT NULL), lambda x: replace(replace(lower(trim(x)), '_', '-'), ' ', '-')) AS w FROM s)",
        "section_split": f"WITH {sec}, {lines}, secs AS (SELECT doc_id, section_no, CASE WHEN is_caption THEN line_no ELSE -1 END AS part, min(line_no) AS first, any_value(kind) AS kind, max(CASE WHEN heading THEN bare END) AS title, trim(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT heading), ' ') AS text FROM lines GROUP BY 1, 2, 3), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first, part) AS n FROM secs WHERE length(text) > 0) SELECT doc_id, 's' || CASE WHEN n < 10 THEN '0' || n ELSE n::VARCHAR END AS section_id, kind, coalesce(title, '') AS title, length(text) AS n_chars FROM f",
        "section_kinds": f"WITH {sec}, {lines} SELECT kind, is_caption, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM lines GROUP BY ALL",
        "context_budget": f"""WITH {sec}, d AS (SELECT DISTINCT doc_key FROM parsed_docs), e AS ({budget("'abstract', 'body', 'caption'", 1200, "CASE kind WHEN 'abstract' THEN 0 WHEN 'body' THEN 1 ELSE 2 END, section_pos")}), a AS ({budget("'abstract', 'body', 'caption', 'supplement'", 2500, "section_pos")})
            SELECT doc_key, length(coalesce(e.txt, '(no extractable text)')) AS n_excerpt, md5(coalesce(e.txt, '(no extractable text)')) AS excerpt_md5, length(coalesce(a.txt, '(no extractable text)')) AS n_assessment, md5(coalesce(a.txt, '(no extractable text)')) AS assessment_md5 FROM d LEFT JOIN e USING (doc_key) LEFT JOIN a USING (doc_key)""",
        "evidence_digest": f"WITH {ev}, l AS (SELECT doc_key, evidence_ref, '[' || evidence_ref || '] ' || detector_id || ' · ' || kind || ': \"' || coalesce(quote, '') || '\"' AS line FROM ev), g AS (SELECT doc_key, string_agg(line, chr(10) ORDER BY evidence_ref, line) AS digest FROM l GROUP BY 1) SELECT doc_key, length(digest) AS n_chars, md5(digest) AS digest_md5 FROM g",
        "dangling_refs": f"WITH {ev}, n AS (SELECT p.doc_key, count(ev.evidence_id) AS n FROM (SELECT DISTINCT doc_key FROM parsed_docs) p LEFT JOIN ev USING (doc_key) GROUP BY 1) SELECT doc_key, n, greatest(0, 30 - n)::INT AS n_bad FROM n WHERE n < 30",
        "quote_grounding": f"WITH {ev}, {sec}, j AS (SELECT evidence_id, quote, text, {norm('quote')} AS qn, {norm('text')} AS tn FROM ev LEFT JOIN sec USING (doc_key, section_id)), w AS (SELECT *, list_filter(string_split(qn, ' '), lambda x: length(x) >= 4 AND NOT list_contains([{stop}], x)) AS ws FROM j) SELECT evidence_id, coalesce(bool_or(contains(text, quote)), FALSE) AS verbatim, coalesce(bool_or(qn <> '' AND (contains(tn, qn) OR (len(ws) >= 6 AND len(list_filter(list_distinct(ws), lambda x: contains(tn, x))) / len(list_distinct(ws)) >= 0.8))), FALSE) AS grounded FROM w GROUP BY 1",
        "quote_first_section": f"WITH {ev}, {sec} SELECT ev.doc_key, evidence_id AS quote_id, min(section_pos) AS section_pos FROM ev JOIN sec ON ev.doc_key = sec.doc_key AND contains(text, trim(quote)) WHERE trim(quote) <> '' GROUP BY ALL",
        "unique_spans": f"WITH {ev} SELECT doc_key, section_id, quote, min(evidence_ref) AS evidence_ref FROM ev GROUP BY ALL",
        "screen_floor": f"""WITH {ev}, f AS (SELECT doc_key, count(DISTINCT {fam}) AS nf, list_sort(list_distinct(list(evidence_ref)))[1:3] AS fr FROM ev WHERE {fam} IS NOT NULL GROUP BY 1),
            l AS (SELECT doc_key, ['yes', 'partial', 'no'][(doc_key % 3 + 1)::INT] AS label, CASE WHEN doc_key % 2 = 0 THEN [0] ELSE [] END AS refs, coalesce(nf, 0) AS nf, coalesce(fr, []) AS fr FROM (SELECT DISTINCT doc_key FROM parsed_docs) LEFT JOIN f USING (doc_key)),
            m AS (SELECT *, label <> 'no' AND len(refs) = 0 AS bare, CASE WHEN label <> 'no' AND len(refs) = 0 AND len(fr) = 0 THEN 'no' ELSE label END AS lab FROM l)
            SELECT doc_key, label, CASE WHEN {raised} THEN 'partial' ELSE lab END AS final, array_to_string(CASE WHEN bare OR ({raised} AND len(refs) = 0) THEN fr ELSE refs END, ',') AS refs, CASE WHEN {raised} THEN 'raised' WHEN bare AND len(fr) > 0 THEN 'refs attached' WHEN bare THEN 'downgraded' END AS repair FROM m""",
        "gate_facts": f"""WITH {ev}, g AS (SELECT doc_key, {hit('method.analytic')} AS an, {hit(*screen.SAMPLING)} AS sa, {hit('method.variational')} AS vi, {hit('method.mcmc')} AS mc, {hit('diag.loo_waic', 'diag.pareto_k')} AS cm, {hit('method.bayes_factor')} AS bf, lower({prior}) AS pq FROM ev GROUP BY 1)
            SELECT doc_key, CASE WHEN an AND NOT sa THEN 'exact_analytic' WHEN vi THEN 'variational' WHEN mc THEN 'mcmc' ELSE 'unstated' END AS inference_method, CASE WHEN cm THEN 2 ELSE 1 END AS n_models, bf AS bf_claimed, CASE WHEN coalesce(pq, '') = '' THEN 'unstated' WHEN contains(pq, 'weakly') THEN 'weakly_informative' WHEN contains(pq, 'non-informative') OR contains(pq, 'noninformative') OR contains(pq, 'flat') THEN 'none' WHEN contains(pq, 'informative') THEN 'informative' WHEN contains(pq, 'default') THEN 'default' ELSE 'unstated' END AS prior_informativeness FROM g""",
        "step_evidence": f"WITH {ev}, p(step_id, prefix) AS (VALUES {', '.join(f'({q(s)}, {q(p)})' for s, ps in STEP_PREFIXES.items() for p in ps)}) SELECT doc_key, step_id, count(DISTINCT evidence_id) AS n FROM ev JOIN p ON starts_with(detector_id, prefix) GROUP BY ALL",
        "trimmed_rationales": f"WITH s AS (SELECT doc_id, {squeeze('text')} AS t FROM documents) SELECT doc_id, md5({trim}) AS trimmed_md5, length({trim}) AS n FROM s",
        "token_ledger": "SELECT source, sum(coalesce(n_tokens, 0))::BIGINT AS tokens, count(*) AS n, array_to_string(list_sort(list_distinct(list(doc_style))), ',') AS styles FROM documents GROUP BY 1",
        "citation_meta": "SELECT doc_key, title, coalesce(array_to_string(list_filter(list_transform(authors, lambda x: trim(x)), lambda x: x <> ''), '|'), '') AS authors FROM (SELECT DISTINCT doc_key, trim(title) AS title, authors FROM parsed_docs WHERE title IS NOT NULL)",
    }
