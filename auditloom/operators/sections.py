"""Split plain text into typed sections by its headings and captions, and join parsed parts into one document."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# How headings and captions begin.
CAPTION = r"(?i)^\s*(figure|fig\.?|table|supplementary figure)\s*\.?\s*\w+"
REFERENCES = r"(?i)^\s*(references|bibliography|literature cited)\s*$"
ABSTRACT = r"(?i)^\s*abstract\s*$"
APPENDIX = r"(?i)^\s*(appendix|supplementary|supporting information)\b"


_CAPTION, _REFERENCES, _ABSTRACT, _APPENDIX = (re.compile(p, re.ASCII) for p in (CAPTION, REFERENCES, ABSTRACT, APPENDIX))
_MARKED, _MARK = re.compile(r"#{1,6}\s", re.ASCII), re.compile(r"^#{1,6}\s+", re.ASCII)


def typed_lines(text: str) -> Iterator[tuple[str, bool, bool, int, str]]:
    """(line, is_caption, heading, section_no, kind) of every line of a text; one pass, whatever its length."""
    number, last, open_state = 0, None, None
    for line in text.split("\n"):
        caption = bool(_CAPTION.search(line))
        known = _REFERENCES.search(line) or _ABSTRACT.search(line) or (len(line) <= 60 and _APPENDIX.search(line))
        heading = not caption and bool(known or _MARKED.match(line))
        if heading:
            title = _MARK.sub("", line)
            last = next((kind for kind, p in (("references", _REFERENCES), ("supplement", _APPENDIX), ("abstract", _ABSTRACT)) if p.search(title)), "plain")
            open_state = open_state if last == "plain" else last
            number += 1
        # a plain heading is body, unless the references are still open
        within = "references" if last == "plain" and open_state == "references" else "body" if last in (None, "plain") else last
        yield line, caption, heading, number, "caption" if caption else within


def _per_text(docs: DataFrame, key: str, text: str, columns: str, rows_of: Callable[[str], Iterator[tuple]]) -> DataFrame:
    """The rows that ``rows_of`` makes of each text, with its key; in Arrow batches, without a shuffle."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame([(k, *row) for k, t in zip(part["k"], part["t"]) for row in rows_of(t)], columns=["k", *names])

    slim = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.col("t").isNotNull())
    return slim.mapInPandas(run, f"k {docs.schema[key].dataType.simpleString()}, {columns}").withColumnRenamed("k", key)


def section_lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, line_no, line, is_caption, heading, section_no, kind of every line.

    A caption is a section of its own; the section around it goes on after it. Once in the references, plain headings stay
    references until an appendix or abstract. Lines before the first heading form section 0 (body). Null texts give no row.
    """
    return _per_text(docs, key, text, "line_no int, line string, is_caption boolean, heading boolean, section_no long, kind string", lambda t: ((i, *x) for i, x in enumerate(typed_lines(t))))


def _sections(text: str) -> Iterator[tuple[int, str, str, str, str]]:
    parts: dict[tuple[int, int], dict] = {}  # in the order of their first lines
    for i, (line, caption, heading, number, kind) in enumerate(typed_lines(text)):
        part = parts.setdefault((number, i if caption else -1), {"kind": kind, "title": "", "lines": []})
        if heading:
            part["title"] = _MARK.sub("", line)
        else:
            part["lines"].append(line)
    filled = [(p, body) for p in parts.values() if (body := "\n".join(p["lines"]).strip(" "))]
    for n, (p, body) in enumerate(filled):
        yield n, f"s{n + 1:02d}", p["kind"], p["title"], body


def split_sections(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, section_pos, section_id, kind, title, text: the non-empty sections in order, numbered s01, s02 ...; repeated rows give theirs again."""
    return _per_text(docs, key, text, "section_pos int, section_id string, kind string, title string, text string", _sections)


def merge_supplements(primary: DataFrame, supplements: DataFrame, key: str) -> DataFrame:
    """Sections of a document and its supplements as one list; within a supplement every section but captions becomes "supplement"."""
    forced = supplements.withColumn("kind", F.when(F.col("kind") == "caption", "caption").otherwise("supplement"))
    both = primary.withColumn("_part", F.lit(0)).unionByName(forced.withColumn("_part", F.lit(1)))
    return both.withColumn("section_pos", F.row_number().over(Window.partitionBy(key).orderBy("_part", "section_pos")) - 1).drop("_part")


def no_text_layer(pages: DataFrame, key: str, text: str = "text", least: int = 200) -> DataFrame:
    """Documents with fewer than ``least`` characters a page on average."""
    return pages.groupBy(key).agg((F.sum(F.length(text)) / F.count(F.lit(1))).alias("mean_chars")).filter(F.coalesce("mean_chars", F.lit(0.0)) < least)


def page_title(lines: DataFrame, key: str) -> DataFrame:
    """The largest text in the upper half of a first page; ``lines``: key, size, y, height, text. Null if it can't be a title."""
    from auditloom.functions.text import NO_TITLE, normalize_title, squeeze

    top = lines.filter((F.col("y") <= F.col("height") * 0.5) & (F.trim("text") != "")).withColumn("size", F.round("size", 1))
    largest = top.withColumn("m", F.max("size").over(Window.partitionBy(key))).filter(F.col("size") >= F.col("m") - 0.5)
    t = squeeze(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "text"))), lambda x: x["text"]), " "))
    out = largest.groupBy(key).agg(t.alias("t"))
    return out.select(key, normalize_title(F.when(F.length("t").between(8, 250) & ~F.col("t").rlike(NO_TITLE), F.col("t"))).alias("title"))
