"""Problem 6: one consistent form for text that looks the same.

DuckDB runs inside the Arrow partitions: every batch is registered as a table and rewritten by one embedded SQL
statement (regexp_replace, translate, nfc_normalize).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.operators.skew import skew_join

# Letters of other scripts that look like a Latin letter.
CYRILLIC_LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ү": "y", "ѵ": "v",
}
GREEK_LOOKALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ν": "v", "ο": "o", "ϲ": "c", "ϳ": "j",
}
LOOKALIKES = CYRILLIC_LOOKALIKES | GREEK_LOOKALIKES
# Characters without a visible shape, as a class of the regular expressions.
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFF9}-\x{FFFB}]"
SPACES = r"[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
HYPHENS = r"[\x{2010}\x{2011}\x{FE63}\x{FF0D}]"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
COMPAT_CLASS = r"[\x{00B5}\x{2100}-\x{214F}\x{FE50}-\x{FE6B}\x{FF01}-\x{FFEE}\x{1D400}-\x{1D7FF}]"


def compatibility_map() -> dict[str, str]:
    """Wide, narrow, small and font variants to their plain character; superscripts, subscripts and fractions stay."""
    out = {}
    for lo, hi in ((0xB5, 0xB5), (0x2100, 0x214F), (0xFE50, 0xFE6B), (0xFF01, 0xFFEE), (0x1D400, 0x1D7FF)):
        for c in map(chr, range(lo, hi + 1)):
            kind, plain = unicodedata.decomposition(c).partition(">")[0], unicodedata.normalize("NFKC", c)
            if (kind in ("<wide", "<narrow", "<small", "<font") or c == "\xb5") and len(plain) == 1:
                out[c] = plain
    return out


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _translate(expr: str, table: dict[str, str]) -> str:
    return f"translate({expr}, {_quoted(''.join(table))}, {_quoted(''.join(table.values()))})"


def _statement(skeleton: bool) -> str:
    """The embedded SQL. Each costly step is behind a test, so plain ASCII text passes through untouched."""
    ligatures = "c"
    for a, b in LIGATURES.items():
        ligatures = f"replace({ligatures}, {_quoted(a)}, {_quoted(b)})"
    latin, alike = r"[A-Za-zÀ-ɏ]", "[" + "".join(LOOKALIKES) + "]"
    words = rf"regexp_extract_all(d, '[\p{{L}}\p{{M}}\p{{N}}]+|[^\p{{L}}\p{{M}}\p{{N}}]+')"
    mixed = f"CASE WHEN regexp_matches(w, '{latin}') AND regexp_matches(w, '{alike}') THEN {_translate('w', LOOKALIKES)} ELSE w END"
    last = f"CASE WHEN regexp_matches(d, '{alike}') THEN {_translate('d', LOOKALIKES)} ELSE d END" if skeleton else f"CASE WHEN regexp_matches(d, '{latin}') AND regexp_matches(d, '{alike}') THEN array_to_string(list_transform({words}, lambda w: {mixed}), '') ELSE d END"
    return f"""
        WITH a AS (SELECT i, t, length(t) = strlen(t) AS plain FROM batch),
        b AS (SELECT i, t, plain, CASE WHEN plain THEN t ELSE regexp_replace(regexp_replace(regexp_replace(t, '{INVISIBLE}', '', 'g'), '{SPACES}', ' ', 'g'), '{HYPHENS}', '-', 'g') END AS b FROM a),
        c AS (SELECT i, plain, CASE WHEN NOT plain AND regexp_matches(b, '{COMPAT_CLASS}') THEN {_translate('b', compatibility_map())} ELSE b END AS c FROM b),
        d AS (SELECT i, plain, CASE WHEN plain THEN c ELSE nfc_normalize(CASE WHEN regexp_matches(c, '[ﬀ-ﬆ]') THEN {ligatures} ELSE c END) END AS d FROM c)
        SELECT i, CASE WHEN plain THEN d ELSE {last} END AS o FROM d ORDER BY i"""


def unify_text(df: DataFrame, text: str, out: str, skeleton: bool = False) -> DataFrame:
    """Add ``out``: ``text`` in one form, NFC, without invisible characters, with plain spaces, hyphens and letters.

    Look-alike letters become Latin in words that also hold a Latin letter, so words of another script stay as they are.
    With ``skeleton`` every look-alike becomes Latin; that form serves comparison, not reading. Letter case, digits,
    superscripts and visible punctuation stay. Null stays null, an empty text empty, rows are never merged. A column
    named ``out`` is replaced. Whole texts, no limit on length.
    """
    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, T.StringType())])
    sql, kept = _statement(skeleton), [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
        for rows in batches:
            # at most so many bytes at once, to keep DuckDB's and Arrow's memory small when texts are very long
            step = max(1, int(rows.num_rows * 8_000_000 / max(rows.nbytes, 1)))
            for at in range(0, rows.num_rows, step):
                part = rows.slice(at, step)
                con.register("batch", pa.table({"i": pa.array(range(part.num_rows), pa.int64()), "t": part.column(text).cast(pa.string())}))
                done = con.sql(sql).to_arrow_table().column("o").combine_chunks()
                con.unregister("batch")
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), done.cast(pa.string())], names=[*kept, out])

    return df.mapInArrow(run, schema)


def explode_sections(parsed_docs: DataFrame) -> DataFrame:
    """One row per section: doc_key, section_pos, section_id, text. Null or empty section arrays give no row."""
    return parsed_docs.select("doc_key", F.posexplode("sections").alias("section_pos", "s")).select("doc_key", "section_pos", F.col("s.id").alias("section_id"), F.col("s.text").alias("text"))


def hidden_quotes(evidence: DataFrame, parsed_docs: DataFrame) -> DataFrame:
    """Evidence whose quote stands in its section in other characters only: evidence_id, doc_key, section_id, quote, plain_quote.

    Both sides are unified once, before the join on (doc_key, section_id). Evidence without quote, section or document
    gives no row, nor does a quote without any visible character. Repeated evidence rows give one row.
    """
    quotes = evidence.select("evidence_id", "doc_key", F.col("span.section_id").alias("section_id"), F.col("span.quote").alias("quote"))
    quotes = unify_text(quotes.filter(F.col("quote").isNotNull() & F.col("section_id").isNotNull()), "quote", "plain_quote", skeleton=True)
    texts = unify_text(explode_sections(parsed_docs).select("doc_key", "section_id", "text").filter(F.col("text").isNotNull()), "text", "plain_text", skeleton=True)
    joined = skew_join(quotes.filter(F.trim("plain_quote") != ""), texts, ["doc_key", "section_id"], counted=evidence.select("doc_key", F.col("span.section_id").alias("section_id")))
    same = joined.filter(F.col("plain_text").contains(F.col("plain_quote")))
    # a section id may stand for several stored sections; the quote is hidden only if none of them holds it as stored
    found = same.groupBy("evidence_id", "doc_key", "section_id", "quote", "plain_quote").agg(F.max(F.col("text").contains(F.col("quote")).cast("int")).alias("stored"))
    return found.filter("stored = 0").drop("stored")
