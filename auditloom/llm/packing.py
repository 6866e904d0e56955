"""Problem 7: fill containers of fixed capacity with whole documents, best fit first."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_fit(size: np.ndarray, source: np.ndarray, cluster: np.ndarray, capacity: int, strict_source: bool = False) -> np.ndarray:
    """Container of each item, all items at most ``capacity``; conflict-constrained best fit, largest item first.

    Open containers are kept in order of their residual room; each carries a bitmap of its sources and one of its duplicate
    clusters (of those with several members). For an item the search starts at the tightest container with room and goes on
    to its successors until one is compatible: the bit of the item's cluster must be free there, with ``strict_source`` that
    of its source too. If none is, a new container is opened. Otherwise a source is only a preference: of compatible
    containers that fit as well up to 1 % of the capacity, the first one without the item's source is taken.
    """
    order = np.lexsort((cluster, source, -size))
    number, members = np.unique(cluster, return_inverse=True, return_counts=True)[1:] if len(cluster) else (cluster, cluster)
    several = np.cumsum(members > 1) - 1
    bits = [1 << int(several[c]) if members[c] > 1 else 0 for c in number]
    bins = np.empty(len(size), np.int64)
    rooms: list[tuple[int, int]] = []  # (residual, container), sorted
    sources: list[int] = []
    clusters: list[int] = []
    slack = max(1, capacity // 100)
    least = int(size.min()) if len(size) else 0
    full = None  # the kind of item that no open container takes
    for k in order:
        need, s, c = int(size[k]), 1 << int(source[k]), bits[k]
        kind = need, c, s if strict_source else 0
        chosen = -1
        # the container opened for the last one of a kind doesn't take another one, unless nothing forbids it
        if kind != full:
            at = bisect_left(rooms, (need, -1))
            while at < len(rooms):
                room, b = rooms[at]
                if chosen >= 0 and room > rooms[chosen][0] + slack:
                    break
                if not clusters[b] & c and not (strict_source and sources[b] & s):
                    if not sources[b] & s:
                        chosen = at
                        break
                    if chosen < 0:
                        chosen = at
                at += 1
        if chosen >= 0:
            room, b = rooms.pop(chosen)
            full = None
        else:
            room, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
            full = kind if c or strict_source else None
        bins[k] = b
        sources[b] |= s
        clusters[b] |= c
        if room - need >= least:  # a container without room for the smallest item is closed
            insort(rooms, (room - need, b))
    return bins


def pack(df: DataFrame, item: str, size: str, source: str, cluster: str, capacity: int = 4096, group_rows: int = 20000, strict_source: bool = False) -> DataFrame:
    """Assign every row to a container: item, part_pos, part_size, container_id (string), container_used, source.

    Items larger than ``capacity`` are cut into full parts and a rest; no other item is split. Null or negative sizes
    count as 0, a null source is a source of its own, a null cluster conflicts with nothing. Two rows of one cluster never
    share a container, so a cluster with more members than there would be containers opens as many as it has members. Rows
    are dealt to groups of about ``group_rows`` by a hash of the item, so hot sources and large clusters are spread evenly
    and a group is one bounded task; at most a few containers a group stay partly empty besides those that conflicts keep
    open. Repeated item ids are items of their own. The parts of one item don't conflict with each other.
    """
    total = df.count()
    groups = max(1, -(-total // group_rows))
    sized = df.select(F.col(item).alias("item"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("size"), F.col(source).cast("string").alias("source"), F.col(cluster).cast("string").alias("cluster"))
    parts = sized.withColumn("part_pos", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("size") / capacity) - 1, F.lit(0)).cast("int"))))
    parts = parts.withColumn("part_size", F.least(F.lit(capacity), F.col("size") - F.col("part_pos") * capacity))
    dealt = parts.withColumn("g", F.pmod(F.xxhash64("item", "part_pos"), F.lit(groups)))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["item", "part_pos"], kind="stable").reset_index(drop=True)
        n = rows.part_size.to_numpy(np.int64)
        sources = pd.factorize(rows.source.fillna("\0null"), sort=True)[0]
        own = rows.cluster.isna() | (n == capacity)  # full parts share a container with nothing anyway
        clusters = pd.factorize(rows.cluster.where(~own, "\0" + rows.index.astype(str)), sort=True)[0]
        bins = best_fit(n, sources, clusters, capacity, strict_source)
        used = np.bincount(bins, weights=n).astype(np.int64) if len(n) else n
        return pd.DataFrame({"item": rows["item"], "part_pos": rows.part_pos, "part_size": n, "container_id": [f"{key[0]}-{b}" for b in bins], "container_used": used[bins] if len(n) else n, "source": rows.source})

    kind = df.schema[item].dataType.simpleString()
    return dealt.groupBy("g").applyInPandas(run, f"item {kind}, part_pos int, part_size long, container_id string, container_used long, source string")


def pack_documents(documents: DataFrame, capacity: int = 4096, cluster: str | None = None) -> DataFrame:
    """All documents in containers of ``capacity`` tokens of the byte-level tokenizer (one per UTF-8 byte, one at the end).

    The size is counted on the whole text, so null n_tokens do no harm; a null text has size 0. The duplicate cluster
    is the column ``cluster`` (of a near-duplicate operator, say), or the text's hash where none is named.
    """
    sized = documents.select("doc_id", "source", (F.octet_length("text") + 1).alias("size"), (F.col(cluster) if cluster else F.xxhash64("text")).alias("cluster"))
    return pack(sized, "doc_id", "size", "source", "cluster", capacity).withColumnRenamed("item", "doc_id")
