"""Stores, guarded artifacts and provider answers."""

import json

import pytest
from pyspark.sql import functions as F

from auditloom.functions import text as tx
from auditloom.operators import detect, sections
from auditloom.sources import files, providers


def test_blob_store(spark, tmp_path):
    store = files.BlobStore(spark, str(tmp_path / "blobs"))
    two = spark.createDataFrame([(b"a",), (b"b",), (b"a",), (None,)], "content binary")
    assert store.exists(two.select(F.sha2("content", 256).alias("sha256"))).filter("there").count() == 0
    assert store.put(two).count() == 2 and store.put(two).count() == 2
    a = spark.createDataFrame([(b"a",)], "c binary").select(F.sha2("c", 256).alias("sha256"))
    assert spark.read.parquet(str(tmp_path / "blobs")).count() == 2 and [bytes(r.content) for r in store.get(a).collect()] == [b"a"]
    store.delete(a)
    assert store.get(a).count() == 0 and not store.exists(a).first().there
    store.put(spark.createDataFrame([(b"a",)], "content binary"))
    assert store.exists(a).first().there and [bytes(r.content) for r in store.get(a).collect()] == [b"a"]


def test_versions_switch_whole(spark, tmp_path):
    path = str(tmp_path / "table")
    files.write_atomic(spark.range(3), path)
    old = files.read_current(spark, path)
    files.write_atomic(spark.range(5), path)
    assert files.read_current(spark, path).count() == 5 and old.count() == 3
    with pytest.raises(Exception):  # noqa: B017
        files.write_atomic(spark.range(2).select(F.raise_error(F.lit("torn")).cast("string").alias("x")), path)
    assert files.read_current(spark, path).count() == 5


def test_validation_artifacts_are_guarded(spark, tmp_path):
    report = spark.createDataFrame([("kappa", 0.5, 20, False), ("icc", None, 3, True)], "metric string, value double, n long, preliminary boolean")
    blind, made = (spark.createDataFrame([(o,) for o in os_], "origin string") for os_ in (["blind_human"] * 2, ["blind_human", "fabricated", None]))
    assert files.write_validation(report, blind, str(tmp_path / "real"), True) == "development_set"
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "real/VALIDATION.md")).collect())
    assert "| kappa | 0.5 | 20 |" in text and "| icc | — | 3 (preliminary) |" in text
    assert {r.status for r in spark.read.json(str(tmp_path / "real/validation.json")).collect()} == {"development_set"}
    for origins in (made, blind.limit(0)):
        with pytest.raises(ValueError, match="blind_human"):
            files.write_validation(report, origins, str(tmp_path / "no"), True)
        assert files.write_validation(report, origins, str(tmp_path / "demo"), False) == "demo_fake_data" and (tmp_path / "demo/VALIDATION.demo.md").exists()
    assert not (tmp_path / "no").exists() and not (tmp_path / "demo/VALIDATION.md").exists()


FEED = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><entry><id>http://arxiv.org/abs/{id}</id><title> A  B
 C </title><published>2020-11-03T17:00:00Z</published><author><name>Ann One</name></author><author><name> </name></author><author><name>Bo Two</name></author><arxiv:license>http://l/</arxiv:license></entry></feed>"""


def test_provider_answers(spark):
    one = lambda text, f: spark.createDataFrame([(text,)], "p string").select(f(F.col("p")).alias("r")).first().r
    r = one(FEED.replace("{id}", "2011.01808v3"), providers.arxiv_record)
    assert (r.title, r.authors, r.year, r.pdf_url, r.version, r.license) == ("A B C", ["Ann One", "Bo Two"], 2020, "https://arxiv.org/pdf/2011.01808v3", "v3", "http://l/")
    assert one(FEED.replace("{id}", "stat/0701001"), providers.arxiv_record).version == "v1"
    for bad in ("<feed/>", "not xml <", None, FEED.replace("{id}", "x").replace(" A  B\n C ", "Error")):
        assert one(bad, providers.arxiv_record) is None
    r = one(json.dumps({"title": "T", "year": 2019, "best_oa_location": {"url_for_pdf": "u", "license": "cc"}}), providers.unpaywall_record)
    assert (r.title, r.year, r.pdf_url, r.version, r.license) == ("T", 2019, "u", "OA", "cc") and one("{", providers.unpaywall_record).pdf_url is None
    r = one(json.dumps({"message": {"title": ["T", "sub"], "DOI": "10.1234/ABC"}}), providers.crossref_record)
    assert (r.title, r.doi) == ("T", "10.1234/abc")
    items = json.dumps({"message": {"items": [{"DOI": "10.1234/first"}, {"DOI": "10.1234/Right", "alternative-id": ["s0022", "z"]}]}})
    assert one(items, lambda p: providers.crossref_doi_of_pii(p, F.lit("S0022"))) == "10.1234/right" and one(items, lambda p: providers.crossref_doi_of_pii(p, F.lit("S9"))) is None
    r = one(json.dumps({"records": [{"pmid": 12, "pmcid": "PMC7", "doi": "10.1234/x"}, {"pmid": 13}]}), providers.ncbi_record)
    assert (r.doi, r.pmid, r.pmcid) == ("10.1234/x", "12", "PMC7")
    assert one(json.dumps({"records": [{"pmid": 1, "status": "error"}]}), providers.ncbi_record) is None and one(json.dumps({"records": []}), providers.ncbi_record) is None
    urls = spark.createDataFrame([("pubmed", "PMC7"), ("pubmed", "12"), ("osf", "ab1"), ("doi", "10.1234/x")], "k string, v string").select(providers.direct_copy(F.col("k"), F.col("v")).alias("u"))
    assert [x.u for x in urls.collect()] == ["https://www.ebi.ac.uk/europepmc/webservices/rest/PMC7/fullTextPDF", None, "https://osf.io/download/ab1/", None]
    years = spark.createDataFrame([("2020-11-03",), ("20-1",), (None,), ("x2020",)], "d string").select(providers.year_prefix(F.col("d")).alias("y"))
    assert [x.y for x in years.collect()] == [2020, None, None, None]
    codes = spark.createDataFrame([(404, "x"), (403, "x"), (500, "x"), (200, "<html"), (200, "%PDF-")], "s int, h string").select(providers.fetch_error(F.col("s"), F.col("h")).alias("e"))
    assert [x.e for x in codes.collect()] == ["not_found", "blocked", "fetch_failed", "not_a_pdf", None]


def test_small_readers(spark, tmp_path):
    for name in ("zeta", "alpha", "synthesis"):
        (tmp_path / f"{name}.yaml").write_text("steps: []")
    assert files.available_rubrics(str(tmp_path)) == ["synthesis", "alpha", "zeta"]
    files.append_json_lines(spark.createDataFrame([("a", 1)], "k string, n int"), str(tmp_path / "log"))
    files.append_json_lines(spark.createDataFrame([("b", 2)], "k string, n int"), str(tmp_path / "log"))
    assert {(r.k, r.n) for r in files.read_json_lines(spark, str(tmp_path / "log"), "k string, n int")[0].collect()} == {("a", 1), ("b", 2)}
    md = files.report_markdown(spark.createDataFrame([("d", 2, "b"), ("d", 1, "# a"), ("e", 1, "x")], "doc string, pos int, line string"), "doc")
    assert {r.doc: r.markdown for r in md.collect()} == {"d": "# a\nb", "e": "x"}
    pages = spark.createDataFrame([("thin", "x" * 50), ("thin", None), ("full", "x" * 900)], "d string, text string")
    assert [r.d for r in sections.no_text_layer(pages, "d").collect()] == ["thin"]
    lines = spark.createDataFrame([("d", 18.0, 10.0, 100.0, "On Good"), ("d", 18.04, 12.0, 100.0, "Priors"), ("d", 9.0, 20.0, 100.0, "small"), ("d", 30.0, 90.0, 100.0, "FOOTER")], "d string, size double, y double, height double, text string")
    assert [r.title for r in sections.page_title(lines, "d").collect()] == ["On Good Priors"]
    assert spark.range(1).select(tx.shorten(F.lit(" a\nb "), 3).alias("s")).first().s == "a b"
    assert detect.catalog_fingerprint() == detect.catalog_fingerprint() != detect.catalog_fingerprint(detect.CATALOG[:-1]) and len(detect.catalog_fingerprint()) == 12
    df = spark.createDataFrame([(("x", "", [], None, ["a"], 0),)], "e struct<a:string,b:string,c:array<string>,d:int,f:array<string>,g:int>")
    assert json.loads(df.select(tx.compact_json(F.col("e"), df.schema["e"].dataType).alias("j")).first().j) == {"a": "x", "f": ["a"], "g": 0}
