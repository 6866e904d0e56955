"""Text expressions: identifiers, titles, authors, keys, matching. All are Column -> Column and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that don't count as content words.
STOP_WORDS = ("that", "this", "with", "from", "into", "have", "been", "were", "using", "used", "paper", "study", "method", "model", "data")
# Patterns of the accepted identifiers, in the order in which they are tried.
ARXIV_URL = r"(?i)arxiv\.org/(?:abs|pdf)/([^\s?]+?)(?:\.pdf)?$"
ARXIV_NEW = r"(?i)^(?:arxiv:)?(\d{4}\.\d{4,5})(v\d+)?$"
ARXIV_OLD = r"(?i)^(?:arxiv:)?([a-z\-]+(?:\.[A-Z]{2})?/\d{7})(v\d+)?$"
DOI = r"(?i)(?:doi\.org/|^(?:doi:)?)(10\.\d{4,9}/\S+)$"
OPENALEX = r"(?i)^(?:https?://openalex\.org/)?(W\d+)$"
PMC = (r"(?i)ncbi\.nlm\.nih\.gov/(?:pmc/articles|articles)/(PMC\d+)", r"(?i)^(?:pmcid:\s*)?(PMC\d+)$")
PMID = (r"(?i)pubmed\.ncbi\.nlm\.nih\.gov/(\d+)", r"(?i)^pmid:\s*(\d+)$")
OSF = (r"(?i)osf\.io/preprints/[^/?#]+/([a-z0-9]{5}(?:_v\d+)?)", r"(?i)osf\.io/([a-z0-9]{5}(?:_v\d+)?)/?(?:[?#]|$)")
PII = r"(?i)(?:sciencedirect\.com/science/article/(?:abs/)?pii|linkinghub\.elsevier\.com/retrieve/pii)/([A-Z0-9]+)"
URL = r"(?i)^https?://"
# Openings that are no title.
NO_TITLE = r"(?i)^(abstract|introduction|arxiv:|doi:|https?://|figure|table|\d+$)"
JUNK_TITLE = r"(?i)^(microsoft word\b|untitled\b|no title\b|main\b|paper\b|manuscript\b|article\b|template\b|preprint\b|document\b|title\b|slide\b)"
AUTHOR_SPLIT = r"(?i)\s*(?:;|\band\b|&|\n|/)\s*"


def group(c: Column, pattern: str, n: int = 1) -> Column:
    """A group of the first match, or null."""
    return F.nullif(F.regexp_extract(c, pattern, n), F.lit(""))


def squeeze(c: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def parse_identifier(raw: Column) -> Column:
    """struct(kind, value, version) of a pasted identifier or address; null if none matches or it is blank."""
    v = F.regexp_replace(raw, r"^\s+|\s+$", "")
    inner = group(v, ARXIV_URL)

    def arxiv(c: Column, pattern: str, old: bool) -> Column:
        base = group(c, pattern)
        return F.when(base.isNotNull(), F.struct(F.lit("arxiv").alias("kind"), (F.lower(base) if old else base).alias("value"), group(c, pattern, 2).alias("version")))

    def plain(kind: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.lit(None).cast("string").alias("version")))

    return F.coalesce(
        arxiv(inner, ARXIV_NEW, False), arxiv(inner, ARXIV_OLD, True), arxiv(v, ARXIV_NEW, False), arxiv(v, ARXIV_OLD, True),
        plain("doi", F.lower(group(v, DOI))),
        plain("openalex", F.upper(group(v, OPENALEX))),
        plain("pubmed", F.upper(F.coalesce(*[group(v, p) for p in PMC]))),
        plain("pubmed", F.coalesce(*[group(v, p) for p in PMID])),
        plain("osf", F.lower(F.coalesce(*[group(v, p) for p in OSF]))),
        plain("pii", F.upper(group(v, PII))),
        plain("url", F.when(v.rlike(URL), v)),
    )


def paper_ids(parsed: Column) -> Column:
    """The parsed identifier as struct(doi, arxiv_id, openalex_id, pmid, pmcid)."""
    kind, value = parsed["kind"], parsed["value"]
    is_pmc = F.upper(value).startswith("PMC")
    return F.struct(
        F.when(kind == "doi", value).alias("doi"), F.when(kind == "arxiv", value).alias("arxiv_id"), F.when(kind == "openalex", value).alias("openalex_id"),
        F.when((kind == "pubmed") & ~is_pmc, value).alias("pmid"), F.when((kind == "pubmed") & is_pmc, value).alias("pmcid"),
    )


def normalize_title(title: Column) -> Column:
    """White space collapsed; a title in capitals only becomes lower case with its first letter large; blank is null."""
    t = F.nullif(squeeze(title), F.lit(""))
    low = F.lower(t)
    first = F.regexp_extract(low, r"^([^\p{L}]*)(\p{L})", 1)
    sentence = F.concat(first, F.upper(F.regexp_extract(low, r"^([^\p{L}]*)(\p{L})", 2)), F.regexp_replace(low, r"^[^\p{L}]*\p{L}", ""))
    shouted = t.rlike(r"\p{Lu}") & ~t.rlike(r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]")
    return F.when(shouted, sentence).otherwise(t)


def metadata_title(raw: Column) -> Column:
    """A title from embedded metadata, null if it looks like a file name, a placeholder or no title."""
    t = squeeze(raw)
    bad = ~F.length(t).between(8, 250) | t.rlike(NO_TITLE) | t.rlike(JUNK_TITLE) | (~t.contains(" ") & t.rlike(r"_|\.\w{2,4}$"))
    return normalize_title(F.when(~bad, t))


def split_authors(raw: Column) -> Column:
    """At most 25 names, split at ; and & line breaks and /; addresses and overlong parts are left out; null gives an empty array."""
    names = F.transform(F.split(F.coalesce(raw, F.lit("")), AUTHOR_SPLIT), squeeze)
    return F.slice(F.filter(names, lambda n: (n != "") & ~n.contains("@") & (F.length(n) <= 80)), 1, 25)


def year_in(raw: Column) -> Column:
    """The first four digits in a row as a year from 1900 to 2100, else null."""
    y = group(raw, r"(\d{4})").cast("int")
    return F.when(y.between(1900, 2100), y)


def shorten(c: Column, n: int = 60) -> Column:
    """Line breaks to spaces, trimmed, the first ``n`` characters."""
    return F.substring(F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit(" ")), 1, n)


def match_text(c: Column) -> Column:
    """Lower case, everything but a-z and 0-9 to single spaces."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def content_words(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda w: (F.length(w) >= 4) & ~w.isin(*STOP_WORDS))


def quote_in_text(quote: Column, text: Column) -> Column:
    """Whether a quote is grounded in a text: contained after normalization, or at least six content words of which 80 % of the different ones stand in the text."""
    return quote_in_plain(quote, match_text(text))


def quote_in_plain(quote: Column, t: Column) -> Column:
    """quote_in_text() for a text that went through match_text() already."""
    q = match_text(quote)
    words = content_words(q)
    distinct = F.array_distinct(words)
    share = F.size(F.filter(distinct, lambda w: F.contains(t, w))) / F.nullif(F.size(distinct), F.lit(0))
    return F.coalesce((q != "") & (F.contains(t, q) | ((F.size(words) >= 6) & (share >= 0.8))), F.lit(False))


def software_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def safe_part(c: Column) -> Column:
    """Letters, digits, - and _ stay, others become _; an empty part is _."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}_-]", "_")
    return F.when(s == "", "_").otherwise(s)


def bucket_key(sha: Column, paper_id: Column, profile: Column) -> Column:
    """Key of a report: content hash, else paper id, with the profile."""
    return F.concat_ws("__", safe_part(F.coalesce(F.nullif(sha, F.lit("")), paper_id)), safe_part(profile))


def short_hash(c: Column, n: int = 12) -> Column:
    return F.substring(F.sha2(c.cast("binary"), 256), 1, n)


def trim_to_sentence(text: Column, limit: int = 400) -> Column:
    """At most ``limit`` characters: to the last sentence end in the second half, else to the last space with an ellipsis."""
    t = squeeze(text)
    window = F.substring(t, 1, limit)
    sentence = F.regexp_extract(window, r"^([\s\S]*[.!?])", 1)
    word = F.regexp_extract(window, r"^([\s\S]+) ", 1)
    cut = F.when(F.length(sentence) > limit // 2, sentence).otherwise(F.concat(F.when(word != "", word).otherwise(window), F.lit("…")))
    return F.when(F.length(t) <= limit, t).otherwise(cut)


def tags(values: Column, most: int | None = None, underscores: bool = False) -> Column:
    """Distinct tags in order: trimmed, lower case, spaces (and underscores) to hyphens; blanks left out."""
    clean = F.transform(F.array_compact(values), lambda x: F.replace(F.replace(F.lower(F.trim(x)), F.lit("_"), F.lit("-")) if underscores else F.lower(F.trim(x)), F.lit(" "), F.lit("-")))
    out = F.array_distinct(F.filter(clean, lambda x: x != ""))
    return F.slice(out, 1, most) if most else out


def distinct_ignoring_case(values: Column) -> Column:
    """The first of values that differ in letter case only, in order."""
    empty = F.array().cast("array<string>")
    return F.aggregate(F.coalesce(values, empty), empty, lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.array_append(acc, x)))


def byline(authors: Column, year: Column) -> Column:
    """The first three authors and the year."""
    return F.concat_ws(" · ", F.array_join(F.slice(F.array_compact(F.coalesce(authors, F.array().cast("array<string>"))), 1, 3), ", "), year.cast("string"))


def version_parts(version: Column) -> Column:
    """a=1;b=2 as a map; the part after the first = is the value."""
    pairs = F.transform(F.filter(F.split(version, ";"), lambda p: p.contains("=")), lambda p: F.struct(F.regexp_extract(p, "^([^=]*)=", 1).alias("k"), F.regexp_extract(p, "^[^=]*=([\\s\\S]*)$", 1).alias("v")))
    return F.map_from_entries(pairs)


def compact_json(event: Column, kind: T.StructType) -> Column:
    """A struct of type ``kind`` as JSON without its null fields, empty texts, empty arrays and empty maps."""
    def kept(f: T.StructField) -> Column:
        c = event[f.name]
        if isinstance(f.dataType, T.StringType):
            return F.nullif(c, F.lit(""))
        return F.when(F.size(c) > 0, c) if isinstance(f.dataType, (T.ArrayType, T.MapType)) else c

    return F.to_json(F.struct(*[kept(f).alias(f.name) for f in kind.fields]), {"ignoreNullFields": "true"})
