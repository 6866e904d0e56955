"""Records of literature providers: landing pages, answers as JSON, and which copy of a paper to take."""

from __future__ import annotations

from contextlib import suppress
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.operators.archive import first_of

class _Tags(HTMLParser):
    """Every meta tag of a page, in its order."""

    def __init__(self, html: str):
        super().__init__()
        self.seen: list[dict] = []
        with suppress(AssertionError):  # the parser's answer to some broken declarations; the tags before it count
            self.feed(html)
            self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.seen += [dict(attrs)] * (tag == "meta")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("content", T.StringType())])))
def meta_tags(html: pd.Series) -> pd.Series:
    """The meta tags of pages with a name (or property) and content. HTML needs a real parser, hence Arrow batches."""
    return html.map(lambda page: [{"key": t.get("name") or t.get("property"), "content": t.get("content")} for t in _Tags(page or "").seen])


def citation_meta(html: Column) -> Column:
    """title, authors, date, doi and pdf_url from a page's citation tags: authors add up in order, of other tags the first value counts."""
    tags = F.transform(meta_tags(html), lambda t: F.struct(F.lower(F.trim(t["key"])).alias("key"), F.trim(t["content"]).alias("content")))
    tags = F.filter(tags, lambda t: t["key"].startswith("citation_") & (t["content"] != ""))
    each = lambda key: F.transform(F.filter(tags, lambda t: t["key"] == f"citation_{key}"), lambda t: t["content"])
    first = lambda *keys: F.coalesce(*[F.try_element_at(each(k), F.lit(1)) for k in keys])
    return F.struct(first("title").alias("title"), each("author").alias("authors"), first("publication_date", "date", "online_date").alias("date"), first("doi").alias("doi"), first("pdf_url").alias("pdf_url"))


def fetch_error(status: Column, head: Column) -> Column:
    """The error of an HTTP answer, null if it is a PDF."""
    return F.when(status == 404, "not_found").when(status.isin(401, 403, 406, 451), "blocked").when(status >= 400, "fetch_failed").when(head != "%PDF-", "not_a_pdf")


OPENALEX = "id string, doi string, title string, display_name string, publication_year int, authorships array<struct<author:struct<display_name:string>>>, best_oa_location struct<pdf_url:string,version:string,license:string>"


def openalex_record(payload: Column) -> Column:
    """title, authors, year, doi and pdf_url of an answer as JSON."""
    r = F.from_json(payload, OPENALEX)
    names = F.array_compact(F.transform(r["authorships"], lambda a: a["author"]["display_name"]))
    return F.struct(F.coalesce(r["title"], r["display_name"]).alias("title"), names.alias("authors"), r["publication_year"].alias("year"), F.regexp_replace(F.lower(r["doi"]), r"^https?://(?:dx\.)?doi\.org/", "").alias("doi"), r["best_oa_location"]["pdf_url"].alias("pdf_url"))


ARXIV = "entry array<struct<id:string,title:string,published:string,license:string,author:array<struct<name:string>>>>"
UNPAYWALL = "title string, year int, best_oa_location struct<url_for_pdf:string,version:string,license:string>"
CROSSREF = "message struct<title:array<string>,DOI:string,items:array<struct<DOI:string,`alternative-id`:array<string>>>>"
NCBI = "records array<struct<status:string,doi:string,pmid:string,pmcid:string>>"
RECORD = "title, authors, year, doi, pdf_url, version, license"


def _record(**fields: Column) -> Column:
    """A provider's answer in the common form; what it doesn't say is null."""
    kinds = {"authors": "array<string>", "year": "int"}
    return F.struct(*[fields.get(n, F.lit(None)).cast(kinds.get(n, "string")).alias(n) for n in RECORD.split(", ")])


def year_prefix(date: Column) -> Column:
    """The four digits with which a date begins, as a number; null otherwise."""
    return F.nullif(F.regexp_extract(date, r"^(\d{4})", 1), F.lit("")).cast("int")


def bare_doi(c: Column) -> Column:
    """A DOI in lower case without an address before it; null if it is none."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(c)), r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)?(10\.\d{4,9}/\S+)$", 1), F.lit(""))


def arxiv_record(feed: Column) -> Column:
    """Of an Atom feed the first entry; version v1 where its id names none. An empty feed, one with an error entry and broken XML give null."""
    e = F.try_element_at(F.from_xml(feed, ARXIV, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})["entry"], F.lit(1))
    title = F.nullif(F.trim(F.regexp_replace(e["title"], r"\s+", " ")), F.lit(""))
    number = F.regexp_extract(e["id"], r"/abs/([^\s]+?)(?:v\d+)?$", 1)
    version = F.coalesce(F.nullif(F.regexp_extract(e["id"], r"(v\d+)$", 1), F.lit("")), F.lit("v1"))
    authors = F.filter(F.transform(e["author"], lambda a: F.trim(a["name"])), lambda n: n != "")
    full = _record(title=title, authors=authors, year=year_prefix(e["published"]), pdf_url=F.concat(F.lit("https://arxiv.org/pdf/"), number, version), version=version, license=e["license"])
    return F.when(e["id"].isNotNull() & F.coalesce(title != "Error", F.lit(True)), full)


def unpaywall_record(payload: Column) -> Column:
    r = F.from_json(payload, UNPAYWALL)
    best = r["best_oa_location"]
    return _record(title=r["title"], year=r["year"], pdf_url=best["url_for_pdf"], version=F.coalesce(best["version"], F.lit("OA")), license=best["license"])


def crossref_record(payload: Column) -> Column:
    """Title and DOI of a single work."""
    m = F.from_json(payload, CROSSREF)["message"]
    return _record(title=F.try_element_at(m["title"], F.lit(1)), doi=bare_doi(m["DOI"]))


def crossref_doi_of_pii(payload: Column, pii: Column) -> Column:
    """Of a list of works the DOI of the one that names the publisher's item id, not just the first one."""
    items = F.from_json(payload, CROSSREF)["message"]["items"]
    named = F.filter(items, lambda x: F.exists(x["alternative-id"], lambda a: F.upper(a) == F.upper(pii)))
    return bare_doi(F.try_element_at(named, F.lit(1))["DOI"])


def ncbi_record(payload: Column) -> Column:
    """struct(doi, pmid, pmcid) of the first record; null where there is none or it is an error."""
    r = F.try_element_at(F.from_json(payload, NCBI)["records"], F.lit(1))
    return F.when(r.isNotNull() & F.coalesce(r["status"] != "error", F.lit(True)), F.struct(bare_doi(r["doi"]).alias("doi"), r["pmid"].alias("pmid"), r["pmcid"].alias("pmcid")))


def direct_copy(kind: Column, value: Column) -> Column:
    """Where the full text of an identifier lies that needs no lookup: a PMC id at Europe PMC, an OSF preprint at OSF."""
    pmc = F.concat(F.lit("https://www.ebi.ac.uk/europepmc/webservices/rest/"), value, F.lit("/fullTextPDF"))
    return F.when((kind == "pubmed") & value.startswith("PMC"), pmc).when(kind == "osf", F.concat(F.lit("https://osf.io/download/"), value, F.lit("/")))


def resolve_copies(requests: DataFrame, **providers: DataFrame) -> DataFrame:
    """The first provider, in the given order, that has a copy: identifier, origin, pdf_url. Each provider: identifier, pdf_url."""
    out = requests.select("identifier").distinct()
    for name, table in providers.items():
        best = table.groupBy("identifier").agg(F.min("pdf_url").alias(f"_{name}"))
        out = out.join(best, "identifier", "left")
    chosen = first_of(*[(name, F.col(f"_{name}")) for name in providers])
    return out.select("identifier", chosen["origin"].alias("origin"), chosen["value"].alias("pdf_url"))


def pii_to_doi(requests: DataFrame, works: DataFrame) -> DataFrame:
    """DOI of each publisher item id by the works' alternative ids, letter case ignored. ``works``: doi, alternative_ids."""
    ids = works.select("doi", F.explode("alternative_ids").alias("a")).select("doi", F.upper("a").alias("pii"))
    return requests.select(F.upper("pii").alias("pii")).distinct().join(ids, "pii").groupBy("pii").agg(F.min("doi").alias("doi"))
