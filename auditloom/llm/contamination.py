"""Problem 8: held-out passages inside the corpus, by suffix arrays over the shards of the training text.

Every Arrow batch of documents is a shard. Its words are numbered by the test items' vocabulary (other words break a
match), a suffix array of the shard is built with numpy, and every suffix of every test item is binary-searched in it.
All verbatim matches found that way are extended to their full length and chained, which allows for changed words.
Documents with a leak can then be removed.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.unify_text import INVISIBLE, LIGATURES, LOOKALIKES
from auditloom.operators.skew import skew_join

_ALIKE = str.maketrans(LOOKALIKES | LIGATURES)
_ANY_ALIKE = re.compile("[" + "".join(LOOKALIKES | LIGATURES) + "]")
_MARKS = regex.compile(r"\p{M}+")
_HIDDEN = re.compile(re.sub(r"\\x\{(\w+)\}", r"\\u\1", INVISIBLE))
_BROKEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\n[ \t>]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Words without case, accents, look-alikes, layout and punctuation; words hyphenated at a line's end are joined."""
    if not text:
        return []
    if not text.isascii():
        text = _HIDDEN.sub("", text)
        text = text.translate(_ALIKE) if _ANY_ALIKE.search(text) else text
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return _WORD.findall((_BROKEN.sub("", text) if "-" in text and "\n" in text else text).casefold())


def item_bodies(items: DataFrame) -> DataFrame:
    """item_id and body: the text without its first line where several items begin with that same line and go on after it.

    Counted over all items, so that it doesn't matter how they are dealt to blocks later.
    """
    asked = items.select("item_id", "text").filter(F.length("text") > 0).distinct()
    cut = asked.withColumn("_at", F.locate("\n", F.col("text"))).withColumn("_line", F.when(F.col("_at") > 0, F.substring(F.col("text"), F.lit(1), F.col("_at") - 1)))
    shared = cut.filter(F.col("_line").isNotNull()).groupBy("_line").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_line", F.lit(True).alias("_shared"))
    return skew_join(cut, shared, ["_line"], "left").select("item_id", F.when(F.col("_shared"), F.substring(F.col("text"), F.col("_at") + 1, F.length("text"))).otherwise(F.col("text")).alias("body"))


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the tokens >= 0 in the order of their suffixes, compared over ``depth`` tokens; negative tokens differ from all.

    Prefix doubling; only positions that still tie are sorted again.
    """
    n = len(tokens)
    breaks = tokens < 0
    rank = np.zeros(n + 1, np.int64)
    rank[:n] = tokens.astype(np.int64) + 1
    rank[:n][breaks] = tokens.max(initial=0) + 2 + np.arange(int(breaks.sum()))
    order = np.argsort(rank[:n], kind="stable")
    k = 1
    # rank = place of the first of equals in the order, so refining a group leaves the others as they are
    head = np.empty(n, bool)
    head[:1] = True
    head[1:] = rank[order[1:]] != rank[order[:-1]]
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0)) + 1
    rank[n] = 0
    while k < depth:
        tie = np.flatnonzero(~(head & np.append(head[1:], True)))
        if not len(tie):
            break
        at = order[tie]
        after = rank[np.minimum(at + k, n)]
        group = rank[at]
        by = np.lexsort((after, group))
        order[tie] = at[by]
        group, after = group[by], after[by]
        new = np.ones(len(tie), bool)
        new[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        head[tie] = new
        rank[order[tie]] = np.maximum.accumulate(np.where(new, tie, 0)) + 1
        k *= 2
    return order[~breaks[order]]


def search(tokens: np.ndarray, sa: np.ndarray, queries: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query suffix, the range of ``sa`` whose suffixes share its first ``least`` tokens, by binary search on each token."""
    padded = np.append(tokens, np.full(least + 1, -2, tokens.dtype))
    asked = np.append(queries, np.full(least + 1, -3, queries.dtype))
    lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(sa), np.int64)
    live = np.arange(len(starts))
    for d in range(least):
        want = asked[starts[live] + d]
        bounds = []
        for right in (False, True):
            a, b = lo[live].copy(), hi[live].copy()
            while True:
                open_ = np.flatnonzero(a < b)
                if not len(open_):
                    break
                mid = (a[open_] + b[open_]) >> 1
                seen, goal = padded[sa[mid] + d], want[open_]
                # breaks sort after all words
                low = ((seen <= goal) & (seen >= 0)) if right else ((seen < goal) & (seen >= 0))
                a[open_[low]] = mid[low] + 1
                b[open_[~low]] = mid[~low]
            bounds.append(a)
        lo[live], hi[live] = bounds
        hi[live[want < 0]] = lo[live[want < 0]]
        live = live[lo[live] < hi[live]]
    keep = np.zeros(len(starts), bool)
    keep[live] = True
    return np.where(keep, lo, 0), np.where(keep, hi, 0)


def best_chain(q: np.ndarray, p: np.ndarray, n: np.ndarray, gap: int = 8) -> tuple[int, int, int, int, int]:
    """The chain of matches (item word q, text word p, n words) that spans most of the item: span, matched, q, p, words of the text.

    Matches follow each other in both texts with at most ``gap`` words between them; a chain may hold three in ten other words.
    Of each match all chains are kept that may still become the best one, not only the one with most words: chance matches
    before a passage mustn't hide it.
    """
    order = np.lexsort((q, p))
    q, p, n = q[order].tolist(), p[order].tolist(), n[order].tolist()
    best: list[list[tuple[int, int]]] = []  # of each match the chains that end there: matched words, first match
    top = (0, 0, 0, 0, 0)
    for i in range(len(q)):
        mine = {i: n[i]}
        for j in range(i - 1, -1, -1):
            dp = p[i] - p[j] - n[j]
            if dp > gap + 200:
                break
            dq = q[i] - q[j] - n[j]
            overlap = max(0, -dp, -dq)
            if overlap < n[i] and overlap < n[j] and dp <= gap and dq <= gap and q[i] > q[j] and p[i] > p[j]:
                for matched, f in best[j]:
                    mine[f] = max(mine.get(f, 0), matched + n[i] - overlap)
        # a chain is out if another one spans as much and has as good a share of matched words in both texts
        kept: list[tuple[int, int]] = []
        for f in sorted(mine, key=lambda f: (q[f], -mine[f], p[f])):
            in_item, in_text = 10 * mine[f] + 7 * q[f], 10 * mine[f] + 7 * p[f]
            if not any(10 * m + 7 * q[g] >= in_item and 10 * m + 7 * p[g] >= in_text for m, g in kept):
                kept.append((mine[f], f))
        best.append(kept)
        for matched, f in kept:
            span, width = q[i] + n[i] - q[f], p[i] + n[i] - p[f]
            if matched >= 0.7 * max(span, width) and span > top[0]:
                top = (span, matched, q[f], p[f], width)
    return top


class Items:
    """One block of items in numbers: ids, words of each, their word numbers one after the other with breaks between."""

    def __init__(self, items: list[tuple[int, list[str]]], vocabulary: dict[str, int]):
        """Words that ``vocabulary`` lacks are added to it."""
        self.ids = [i for i, _ in items]
        self.sizes = np.array([len(ws) for _, ws in items], np.int64)
        offsets = np.concatenate([[0], np.cumsum(self.sizes + 1)])
        self.tokens = np.full(int(offsets[-1]), -3, np.int32)
        for at, (_, ws) in zip(offsets, items):
            self.tokens[at : at + len(ws)] = [vocabulary.setdefault(w, len(vocabulary)) for w in ws]
        self.offsets = offsets[:-1]
        self.starts = np.flatnonzero(self.tokens >= 0)


class Shard:
    """The suffix array of some texts, built once and then searched for any number of blocks of items."""

    def __init__(self, texts: list[str | None], vocabulary: dict[str, int], depth: int):
        get = vocabulary.get
        numbered = [[get(w, -1) for w in words(t)] for t in texts]
        self.sizes = np.array([len(x) for x in numbered], np.int64)
        self.ends = np.cumsum(self.sizes + 1)
        self.tokens = np.full(int(self.ends[-1]) if len(self.ends) else 0, -1, np.int32)
        for end, x in zip(self.ends, numbered):
            self.tokens[end - 1 - len(x) : end - 1] = x
        self.array = suffix_array(self.tokens, depth) if (self.tokens >= 0).any() else np.zeros(0, np.int64)

    def leaks(self, items: Items, share: float, least: int) -> Iterator[tuple[int, ...]]:
        """(row, item, item's words, span, matched, longest verbatim match, item word, text word) of each leak."""
        tokens, sa = self.tokens, self.array
        if not len(sa) or not len(items.starts):
            return
        lo, hi = search(tokens, sa, items.tokens, items.starts, least)
        some = np.flatnonzero(hi > lo)
        many = (hi - lo)[some]
        q = np.repeat(items.starts[some], many)
        p = sa[np.repeat(lo[some], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        # only matches that can't be extended to the left; then their full length
        left = (q > 0) & (p > 0)
        left[left] = items.tokens[q[left] - 1] == tokens[p[left] - 1]
        q, p = q[~left], p[~left]
        n = np.full(len(q), least)
        asked, text = np.append(items.tokens, -3), np.append(tokens, -1)
        live = np.arange(len(q))
        while len(live):
            same = asked[np.minimum(q[live] + n[live], len(asked) - 1)] == text[np.minimum(p[live] + n[live], len(text) - 1)]
            live = live[same]
            n[live] += 1
        row = np.searchsorted(self.ends, p, side="right")
        item = np.searchsorted(items.offsets, q, side="right") - 1
        pair = row * len(items.ids) + item
        by = np.argsort(pair, kind="stable")
        pair, q, p, n = pair[by], q[by], p[by], n[by]
        cuts = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
        sums = np.add.reduceat(n, cuts) if len(cuts) else np.zeros(0, np.int64)
        stops = np.append(cuts[1:], len(pair))
        needed = share * items.sizes[pair[cuts] % len(items.ids)] if len(cuts) else sums
        for k in np.flatnonzero(sums >= 0.7 * needed):
            a, b = cuts[k], stops[k]
            r, i = divmod(int(pair[a]), len(items.ids))
            start = int(self.ends[r] - 1 - self.sizes[r])
            span, matched, qa, pa_, _ = best_chain(q[a:b] - items.offsets[i], p[a:b] - start, n[a:b])
            if span >= needed[k]:
                yield r, items.ids[i], int(items.sizes[i]), span, matched, int(n[a:b].max()), qa, pa_


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        yield pa.RecordBatch.from_arrays([rows.column("item_id"), pa.array([words(t) for t in rows.column("body").to_pylist()], pa.list_(pa.string()))], names=["item_id", "words"])


FOUND = ("item_words", "span_words", "matched_words", "verbatim_words", "item_word", "doc_word")


def find_leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", share: float = 1 / 3, least: int = 4, block: int = 20000) -> DataFrame:
    """Documents that hold at least ``share`` of an item's words in order and together, with the items.

    Columns: ``key``, item_id, item_words, span_words, matched_words, verbatim_words (the longest verbatim match), item_word
    and doc_word (places of the first match). A line with which several items begin doesn't count. A match starts from
    ``least`` equal words; up to three in ten words of the passage may be changed. Null and empty texts match nothing;
    equal documents and repeated items each give their rows; an item without words is left out.

    ``items`` (item_id, text) is the stated query set. Executors turn it into words; it passes the driver in blocks of
    ``block`` items, of which one is there at a time, beside one number for each different word of the items, and waits as
    broadcasts on the executors' disks. The documents are read once, without a shuffle: each shard's suffix array is built
    once and all blocks go past it. The result doesn't depend on ``block``.
    """
    spark = documents.sparkSession
    vocabulary: dict[str, int] = {}
    blocks, part, depth = [], [], 2 * least
    for r in item_bodies(items).mapInArrow(_item_words, "item_id long, words array<string>").filter(F.size("words") > 0).toLocalIterator():
        part.append((r.item_id, r.words))
        depth = max(depth, len(r.words))
        if len(part) == block:
            blocks.append(spark.sparkContext.broadcast(Items(part, vocabulary)))
            part = []
    if part:
        blocks.append(spark.sparkContext.broadcast(Items(part, vocabulary)))
    known = spark.sparkContext.broadcast(vocabulary)
    kind = documents.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, item_id long, " + ", ".join(f"{c} int" for c in FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            step = max(1, int(rows.num_rows * 8_000_000 / max(rows.nbytes, 1)))
            for a in range(0, rows.num_rows, step):
                rows_now = rows.slice(a, step)
                shard = Shard(rows_now.column("_text").to_pylist(), known.value, depth)
                for b in blocks:
                    hits = list(shard.leaks(b.value, share, least))
                    if len(blocks) > 1:
                        vars(b).pop("_value", None)  # read again from the executor's disk for the next shard
                    if hits:
                        r, item, *rest = zip(*hits)
                        yield pa.RecordBatch.from_arrays([rows_now.column(key).take(pa.array(r)), pa.array(item, pa.int64()), *(pa.array(x, pa.int32()) for x in rest)], names=[key, "item_id", *FOUND])

    return documents.select(F.col(key), F.col(text).alias("_text")).filter(F.length("_text") > 0).mapInArrow(run, schema)


def remove_leaking(documents: DataFrame, leaks: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents without those in ``leaks``."""
    return documents.join(leaks.select(key).distinct(), key, "left_anti")
