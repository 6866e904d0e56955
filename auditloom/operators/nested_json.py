"""Deeply nested JSON records into related flat tables, by vectorised structural indexing.

The payloads of an Arrow batch are laid end to end in one byte array. Bitmaps mark the unescaped quotes, the inside of
strings and the structural characters; prefix sums give the nesting depth; sorting the structural characters by depth
puts the parts of each container next to each other. All spans of a batch come out of a few numpy passes, and the rows
are linked to their parents by the place of the container that holds them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("result", "report", "payload", "data", "ratings", "steps", "step_assessments", "evidence", "suggestions", "span", "work_id", "tier", "engine_version", "rater_id", "relevance_label", "relevance", "label", "step_id", "applicable", "status", "confidence", "rationale", "section_id", "page", "quote", "detector_id", "kind", "severity", "text", "how_to", "ease")
CODE = {k: i for i, k in enumerate(KEYS)}
WRAPPERS = ("result", "report", "payload", "data")
FIELDS = {
    "record": ("work_id", "tier", "engine_version"),
    "rating": ("rater_id", "relevance_label"),
    "step": ("step_id", "applicable", "status", "confidence", "rationale"),
    "evidence": ("section_id", "page", "quote", "detector_id", "kind"),
    "suggestion": ("severity", "text", "how_to", "ease"),
}
QUOTE, BACKSLASH, OPEN_O, CLOSE_O, OPEN_A, CLOSE_A, COLON, COMMA = b'"\\{}[]:,'


class Index:
    """The values of a batch of JSON texts.

    Per value: box (offset of the container's opening byte, or -1 - text for the outermost), place (in its array or
    object), key (code of its key, -1 for others), start and end of its bytes, kind (first byte). Texts that end early or
    don't nest have no values; ``complete`` tells.
    """

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        stops = np.cumsum(sizes)
        starts = stops - sizes
        buf = np.frombuffer(b"\n".join(texts) + b"\n" if texts else b"", np.uint8)
        self.buf, n = buf, len(buf)
        at = np.arange(n)
        text_of = np.repeat(np.arange(len(texts)), sizes)
        # quotes that aren't escaped: an even run of backslashes before them
        plain = np.where(buf != BACKSLASH, at, -1)
        last_plain = np.maximum.accumulate(plain) if n else plain
        quotes = np.flatnonzero(buf == QUOTE)
        before = np.where(quotes > 0, last_plain[quotes - 1], -1)
        quotes = quotes[((quotes - 1 - before) & 1) == 0]
        bit = np.zeros(n, np.int32)
        bit[quotes] = 1
        run = np.cumsum(bit)
        base = np.append(0, run[stops[:-1] - 1]) if len(texts) else np.zeros(0, np.int32)
        inside = ((run - base[text_of]) & 1).astype(bool) if n else bit.astype(bool)
        structural = np.zeros(256, bool)
        structural[[OPEN_O, CLOSE_O, OPEN_A, CLOSE_A, COLON, COMMA]] = True
        pos = np.flatnonzero(structural[buf] & ~inside)
        what = buf[pos]
        opens, closes = (what == OPEN_O) | (what == OPEN_A), (what == CLOSE_O) | (what == CLOSE_A)
        step = opens.astype(np.int64) - closes
        total = np.cumsum(step)
        first = np.searchsorted(pos, starts)
        last = np.searchsorted(pos, stops)
        depth = total - np.append(0, total)[first][text_of[pos]]
        level = depth + closes  # depth inside the container that the character belongs to
        blank = np.isin(buf, np.frombuffer(b" \t\r\n", np.uint8))
        solid = np.minimum.accumulate(np.where(~blank, at, n)[::-1])[::-1] if n else at  # next byte that isn't blank
        solid = np.append(solid, n)
        firm = np.maximum.accumulate(np.where(~blank, at, -1)) if n else at  # last byte that isn't blank
        # complete texts: even quotes, depth back at zero and never below, nothing after the outermost value
        even = ((run[stops - 1] - base) & 1) == 0 if len(texts) else np.zeros(0, bool)
        final = np.where(last > first, depth[np.maximum(last - 1, 0)], 0) if len(pos) else np.zeros(len(texts), np.int64)
        lowest = np.zeros(len(texts), np.int64)
        if len(pos):
            np.minimum.at(lowest, text_of[pos], depth)
        head = solid[starts] if len(texts) else starts
        some = head < stops - 1 if len(texts) else even
        # a container sorted by level: its opening, commas and colons, closing
        order = np.lexsort((pos, level))
        opened = opens[order]
        box = np.cumsum(opened) - 1
        boxes = pos[order][opened]
        shut = closes[order]
        fits = np.ones(len(texts), bool)
        if len(boxes):
            owner = boxes[np.maximum(box, 0)]
            bad = (box < 0) | (shut & (buf[owner] + 2 != what[order])) | (text_of[owner] != text_of[pos[order]]) | ((what[order] == COLON) & (buf[owner] != OPEN_O))
            fits[text_of[pos[order][bad]]] = False
        self.complete = even & (final == 0) & (lowest >= 0) & some & fits
        if len(pos):
            top = level == 0  # a comma or colon outside of any container
            self.complete[text_of[pos[top]]] = False
            # after an outermost container nothing may follow
            end_of = np.where(closes & (depth == 0), pos, -1)
            tail = np.full(len(texts), -1, np.int64)
            np.maximum.at(tail, text_of[pos], end_of)
            count = np.zeros(len(texts), np.int64)
            np.add.at(count, text_of[pos], closes & (depth == 0))
            held = (buf[np.minimum(head, n - 1)] == OPEN_O) | (buf[np.minimum(head, n - 1)] == OPEN_A)
            self.complete &= ~held | ((count == 1) & (firm[np.maximum(stops - 2, 0)] == tail))
        # the values: after an opening or comma in arrays, after a colon in objects
        p, w = pos[order], what[order]
        if len(p):
            owner = boxes[np.maximum(box, 0)]
            good = (box >= 0) & self.complete[text_of[p]]
            in_object = buf[owner] == OPEN_O
            begins = good & np.where(in_object, w == COLON, (w == OPEN_A) | (w == COMMA))
            i = np.flatnonzero(begins)
            nxt = p[np.minimum(i + 1, len(p) - 1)]
            start, end = solid[p[i] + 1], firm[nxt - 1] + 1
            real = start < nxt
            i, start, end, nxt = i[real], start[real], end[real], nxt[real]
            owner_i = owner[i]
            commas = np.cumsum(w == COMMA)
            # the place is the number of commas since the container's opening
            open_at = np.flatnonzero(opened)
            place = commas[i] - commas[open_at[box[i]]]
            key_start, key_end = solid[p[np.maximum(i - 1, 0)] + 1] + 1, firm[np.maximum(p[i] - 1, 0)]
            key = self._keys(np.where(in_object[i], key_start, 0), np.where(in_object[i], key_end, 0))
            inner = pd.DataFrame({"text": text_of[start], "box": owner_i, "place": place, "key": key, "start": start, "end": end})
        else:
            inner = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("text", "box", "place", "key", "start", "end")})
        k = np.flatnonzero(self.complete)
        outer = pd.DataFrame({"text": k, "box": -1 - k, "place": 0, "key": -1, "start": head[k] if len(k) else k, "end": firm[stops[k] - 2] + 1 if len(k) else k})
        self.values = pd.concat([outer, inner], ignore_index=True)
        self.values["kind"] = buf[self.values["start"].to_numpy(np.int64)] if len(self.values) else np.zeros(0, np.uint8)

    def _keys(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.full(len(start), -1, np.int64)
        size = end - start
        for name, code in CODE.items():
            some = np.flatnonzero(size == len(name))
            if len(some):
                same = (self.buf[start[some][:, None] + np.arange(len(name))] == np.frombuffer(name.encode(), np.uint8)).all(1)
                out[some[same]] = code
        return out

    def raw(self, start: int, end: int) -> bytes:
        return self.buf[start:end].tobytes()


def _scalar(raw: bytes) -> str | None:
    """A JSON scalar as a string; null and containers are None. Broken strings come out as they are."""
    if raw[:1] == b'"':
        if b"\\" not in raw:
            return raw[1:-1].decode("utf-8", "replace")
        try:
            return json.loads(raw)
        except ValueError:
            return raw[1:-1].decode("utf-8", "replace")
    return None if raw == b"null" or raw[:1] in b"{[" else raw.decode("utf-8", "replace")


class Walker:
    """Follows keys through an index; string-encoded parts are indexed in turn and stand in for their string."""

    def __init__(self, payloads: list[bytes]):
        self.indexes = [Index(payloads)]

    def tops(self) -> pd.DataFrame:
        return self._decoded(self._of(0, self.indexes[0].values.query("box < 0").rename(columns={"text": "row"})))

    def _of(self, which: int, values: pd.DataFrame) -> pd.DataFrame:
        return values.assign(index=which)[["row", "index", "start", "end", "kind"]].reset_index(drop=True)

    def _decoded(self, nodes: pd.DataFrame) -> pd.DataFrame:
        """Nodes that are strings holding an object or array, replaced by what they hold."""
        while True:  # each turn takes off a layer of quotes, so it ends
            at = np.flatnonzero((nodes["kind"] == QUOTE).to_numpy())
            texts, rows = [], []
            for i in at:
                held = _scalar(self.indexes[nodes["index"].iat[i]].raw(nodes["start"].iat[i], nodes["end"].iat[i]))
                if held and held.lstrip()[:1] in ("{", "[", '"'):
                    texts.append(held.encode("utf-8", "replace"))
                    rows.append(i)
            if not rows:
                break
            self.indexes.append(Index(texts))
            outer = self.indexes[-1].values.query("box < 0")
            target = np.array(rows)[outer["text"].to_numpy(np.int64)]
            nodes = nodes.copy()
            for name in ("start", "end", "kind"):
                nodes.iloc[target, nodes.columns.get_loc(name)] = outer[name].to_numpy()
            nodes.iloc[target, nodes.columns.get_loc("index")] = len(self.indexes) - 1
            broken = np.setdiff1d(np.array(rows), target)
            if len(broken):
                nodes.iloc[broken, nodes.columns.get_loc("kind")] = 0
            if not len(target):
                break
        return nodes

    def _inside(self, nodes: pd.DataFrame, want: int | None) -> pd.DataFrame:
        """The values in the containers ``nodes``: parent (row of ``nodes``), place and the node; only those of key ``want`` if given."""
        out = []
        for which, part in nodes.groupby("index", sort=False):
            values = self.indexes[which].values
            if want is not None:
                values = values[values["key"] == want]
            part = pd.DataFrame({"parent": part.index.to_numpy(), "row": part["row"].to_numpy(), "box": part["start"].to_numpy()})
            got = part.merge(values[["box", "place", "start", "end", "kind"]], on="box").assign(index=which)
            out.append(got[["parent", "row", "index", "place", "start", "end", "kind"]])
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("parent", "row", "index", "place", "start", "end", "kind")})

    def get(self, nodes: pd.DataFrame, key: str) -> pd.DataFrame:
        """The value of ``key`` (the last if repeated) in each object; ``parent`` is the row of ``nodes``."""
        objects = nodes[nodes["kind"] == OPEN_O]
        got = self._inside(objects, CODE[key]).sort_values(["parent", "place"], kind="stable").drop_duplicates("parent", keep="last")
        return got.reset_index(drop=True)

    def items(self, nodes: pd.DataFrame) -> pd.DataFrame:
        """The elements of arrays with their places; a lone object counts as an array of one. Elements that are no object are left out."""
        plain = nodes.reset_index(drop=True)
        lone = plain[plain["kind"] == OPEN_O].assign(place=0)
        lone = lone.assign(parent=lone.index)[["parent", "row", "index", "place", "start", "end", "kind"]]
        listed = self._inside(plain[plain["kind"] == OPEN_A], None)
        both = pd.concat([lone, self._decoded(listed)], ignore_index=True)
        return both[both["kind"] == OPEN_O].reset_index(drop=True)

    def texts(self, nodes: pd.DataFrame, keys: tuple[str, ...]) -> dict[str, np.ndarray]:
        """The scalars of several keys (of a repeated one the last) in each object, found in one look through the values."""
        out = {key: np.full(len(nodes), None, object) for key in keys}
        places = pd.Series(np.arange(len(nodes)), index=nodes.index)
        codes = {CODE[key]: key for key in keys}
        objects = nodes[nodes["kind"] == OPEN_O]
        for which, part in objects.groupby("index", sort=False):
            values = self.indexes[which].values
            values = values[values["key"].isin(list(codes))]
            owners = pd.DataFrame({"place_out": places.loc[part.index].to_numpy(), "box": part["start"].to_numpy()})
            got = owners.merge(values[["box", "place", "key", "start", "end"]], on="box").sort_values("place", kind="stable")
            data = memoryview(self.indexes[which].buf)
            for place, code, start, end in zip(got["place_out"].tolist(), got["key"].tolist(), got["start"].tolist(), got["end"].tolist()):
                out[codes[code]][place] = _scalar(data[start:end].tobytes())
        return out


COLUMNS = ("tbl", "rating_pos", "step_pos", "child_pos", *dict.fromkeys(x for xs in FIELDS.values() for x in xs))


def flatten_batch(ids: list, kinds: list[str | None], payloads: list[str | None], fields: bool = True) -> pd.DataFrame:
    """All linked rows of a batch: record_id, tbl and the positions of the parents, with the table's fields as strings."""
    walker = Walker([(p or "").encode("utf-8", "replace") for p in payloads])
    out: list[pd.DataFrame] = []

    def emit(tbl: str, nodes: pd.DataFrame, rating: np.ndarray, step: np.ndarray, child: np.ndarray) -> None:
        rows = nodes["row"].to_numpy(np.int64)
        frame = pd.DataFrame({"record_id": [ids[r] for r in rows], "tbl": tbl, "rating_pos": rating, "step_pos": step, "child_pos": child})
        if fields:
            own = walker.texts(nodes, FIELDS[tbl])
            spans = walker.get(nodes, "span").set_index("parent") if tbl == "evidence" else ()
            if len(spans):  # what the evidence itself doesn't say stands in its span
                places = pd.Series(np.arange(len(nodes)), index=nodes.index).loc[spans.index].to_numpy()
                for name, inner in walker.texts(spans, ("section_id", "page", "quote")).items():
                    empty = np.array([x is None for x in own[name][places]], bool)
                    own[name][places[empty]] = inner[empty]
            for name in FIELDS[tbl]:
                frame[name] = pd.Series(own[name], dtype=object)
        out.append(frame)

    tops = walker.tops()
    tops = tops[tops["kind"] == OPEN_O].reset_index(drop=True)
    while True:  # unwrap: an object without steps or ratings of its own; each turn goes one level down, so it ends
        has = set(walker.get(tops, "ratings")["parent"]) | set(walker.get(tops, "step_assessments")["parent"])
        swap = {}
        for w in WRAPPERS:
            got = walker.get(tops[~tops.index.isin(has)], w)
            if not len(got):
                continue
            node = walker._decoded(got.drop(columns="place"))
            node = node[node["kind"] == OPEN_O]
            for parent, *place in zip(node["parent"], node["index"], node["start"], node["end"], node["kind"]):
                swap.setdefault(parent, place)
        if not swap:
            break
        tops = tops.copy()
        for k, place in swap.items():
            tops.loc[k, ["index", "start", "end", "kind"]] = place
    none = np.full(len(tops), -1)
    emit("record", tops, none, none, none)
    # a scored result has its steps at the top; a human report has them in its ratings
    scored = walker._decoded(walker.get(tops, "step_assessments").drop(columns="place"))
    rated = walker._decoded(walker.get(tops, "ratings").drop(columns="place"))
    ratings = walker.items(rated)
    emit("rating", ratings, ratings["place"].to_numpy(), np.full(len(ratings), -1), np.full(len(ratings), -1))
    lists = walker._decoded(walker.get(ratings, "steps").drop(columns="place"))
    lists["rating"] = ratings["place"].to_numpy()[lists["parent"].to_numpy(np.int64)] if len(lists) else []
    scored["rating"] = -1
    holders = pd.concat([scored, lists], ignore_index=True)
    steps = walker.items(holders)
    rating = holders["rating"].to_numpy()[steps["parent"].to_numpy(np.int64)].astype(np.int64) if len(steps) else np.zeros(0, np.int64)
    emit("step", steps, rating, steps["place"].to_numpy(), np.full(len(steps), -1))
    for tbl, key in (("evidence", "evidence"), ("suggestion", "suggestions")):
        lists = walker._decoded(walker.get(steps, key).drop(columns="place"))
        children = walker.items(lists)
        parent = lists["parent"].to_numpy(np.int64)[children["parent"].to_numpy(np.int64)] if len(children) else np.zeros(0, np.int64)
        emit(tbl, children, rating[parent], steps["place"].to_numpy()[parent], children["place"].to_numpy())
    frame = pd.concat(out, ignore_index=True)
    for name in COLUMNS:
        if name not in frame:
            frame[name] = None
    return frame[["record_id", *COLUMNS]]


def flatten_reports(records: DataFrame, fields: bool = True, key: str = "record_id", kind: str = "record_kind", payload: str = "payload") -> DataFrame:
    """Every object of the payloads as a row that carries its parents' keys: record_id, tbl, rating_pos, step_pos, child_pos and the fields.

    tbl is record, rating, step, evidence or suggestion; a position that doesn't apply is -1, positions count null elements
    too. Parts may be wrapped or string-encoded, however deep, or a lone object for an array of one; the consensus block is left out. Torn,
    null and empty payloads give no row. Fields that are missing or null are null. Per row, without a shuffle; a repeated
    record gives its rows again. With ``fields`` off only the links are filled.
    """
    id_type = records.schema[key].dataType.simpleString()
    strings = ", ".join(f"{c} string" for c in COLUMNS[4:])

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in rows:
            step = max(1, int(len(part) * 4_000_000 / max(1, int(part["p"].str.len().sum() or 0))))
            for at in range(0, len(part), step):
                chunk = part.iloc[at : at + step]
                yield flatten_batch(chunk["k"].tolist(), chunk["kind"].tolist(), chunk["p"].tolist(), fields)

    slim = records.select(F.col(key).alias("k"), F.col(kind).alias("kind"), F.col(payload).alias("p")).filter(F.col("p").isNotNull())
    return slim.mapInPandas(run, f"record_id {id_type}, tbl string, rating_pos int, step_pos int, child_pos int, {strings}")


def table_of(flat: DataFrame, tbl: str) -> DataFrame:
    """One of the related tables: its links and its own fields."""
    links = {"record": (), "rating": ("rating_pos",), "step": ("rating_pos", "step_pos")}.get(tbl, ("rating_pos", "step_pos", "child_pos"))
    return flat.filter(F.col("tbl") == tbl).select("record_id", *links, *FIELDS[tbl])
