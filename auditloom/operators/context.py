"""Excerpts of a document within a budget of characters, and the digest of its evidence. All per document row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXCERPT_KINDS = ("abstract", "body", "caption")
ASSESSMENT_KINDS = ("abstract", "body", "caption", "supplement")
NOTHING = "(no extractable text)"


def _blocks(sections: Column) -> Column:
    used = F.filter(sections, lambda s: F.length(s["text"]) > 0)
    return F.transform(used, lambda s: F.concat(F.lit("## "), F.coalesce(F.nullif(s["title"], F.lit("")), s["kind"]), F.lit("\n"), s["text"]))


def _budget(blocks: Column, most: int) -> Column:
    """Blocks from the front until the budget is used up; the one that doesn't fit is cut, separators aren't counted."""
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("out"))
    step = lambda a, b: F.when(a["used"] >= most, a).otherwise(F.struct((a["used"] + F.length(b)).alias("used"), F.array_append(a["out"], F.substring(b, F.lit(1), most - a["used"])).alias("out")))
    kept = F.aggregate(blocks, start, step, lambda a: a["out"])
    text = F.array_join(kept, "\n\n")
    return F.when(F.length(text) > 0, text).otherwise(NOTHING)


def excerpt(sections: Column, most: int = 12000) -> Column:
    """Abstracts, then bodies, then captions, within ``most`` characters."""
    of = lambda k: F.filter(sections, lambda s: s["kind"] == k)
    return _budget(_blocks(F.concat(*[of(k) for k in EXCERPT_KINDS])), most)


def assessment_text(sections: Column, most: int = 60000) -> Column:
    """All sections but the references in their order, within ``most`` characters."""
    return _budget(_blocks(F.filter(sections, lambda s: s["kind"].isin(*ASSESSMENT_KINDS))), most)


def contexts(parsed_docs: DataFrame, excerpt_chars: int = 12000, assessment_chars: int = 60000) -> DataFrame:
    """doc_key, excerpt, assessment. No shuffle: a document's sections stand in its row. Null or empty sections give the stand-in text."""
    none = F.coalesce("sections", F.array().cast(parsed_docs.schema["sections"].dataType))
    return parsed_docs.select("doc_key", excerpt(none, excerpt_chars).alias("excerpt"), assessment_text(none, assessment_chars).alias("assessment"))


def evidence_digest(evidence: DataFrame, key: str = "doc_key") -> DataFrame:
    """Evidence as numbered lines by document: [i] id · kind: "quote"."""
    line = F.concat(F.lit("["), F.col("evidence_ref").cast("string"), F.lit("] "), "detector_id", F.lit(" · "), "kind", F.lit(': "'), F.coalesce("quote", F.lit("")), F.lit('"'))
    rows = evidence.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("evidence_ref", line.alias("line")))).alias("l"))
    return rows.select(key, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("digest"))


def dangling_refs(claims: DataFrame, evidence: DataFrame, key: str = "doc_key", refs: str = "refs") -> DataFrame:
    """Claims that cite evidence numbers which their document doesn't have."""
    n = evidence.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    joined = claims.join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.withColumn("bad", F.filter(refs, lambda i: (i < 0) | (i >= F.col("n")))).filter(F.size("bad") > 0)
