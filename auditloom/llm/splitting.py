"""Problem 2: cut long texts at natural boundaries, with overlap, by one regular expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Boundaries from strong to weak: a paragraph's end, a line's end, a sentence's end, a clause's end. Each is a lookbehind
# of bounded width with the share of the room that a piece must fill before it may end there.
BOUNDARIES = (
    (r"(?<=\n[ \t]{0,8}\n)", 0.5),
    (r"(?<=\n)", 0.5),
    (r"""(?<=[.!?…][”"'’)\]]{0,2}\s|[。！？])""", 0.3),
    (r"(?<=[;:,–—]\s|[、，；：])", 0.3),
    (r"(?<=\s)", 0.1),
)


def piece_pattern(room: int) -> str:
    """The rest if it fits, else up to ``room`` characters ending at the strongest boundary, else at any character.

    The last resort still avoids cutting before a combining mark.
    """
    parts = [rf"[\s\S]{{1,{room}}}\z"]
    parts += [rf"[\s\S]{{{max(1, int(room * share))},{room}}}{boundary}" for boundary, share in BOUNDARIES]
    parts += [rf"[\s\S]{{{max(1, room // 2)},{room}}}(?!\p{{M}})", rf"[\s\S]{{1,{room}}}"]
    return "(?:" + "|".join(parts) + ")"


def lookback(core: Column, overlap: int) -> Column:
    """The last ``overlap`` characters of ``core``, shortened to the start of a word where there is one in their first half."""
    if overlap <= 0:
        return F.lit("")
    tail = F.right(core, F.lit(overlap + 1))
    snapped = F.regexp_extract(tail, rf"(?<=\s)[\s\S]{{{(overlap + 1) // 2},{overlap}}}\z", 0)
    return F.when(snapped != "", snapped).otherwise(F.right(core, F.lit(overlap)))


def split_long_texts(df: DataFrame, text: str, limit: int = 2000, overlap: int = 150) -> DataFrame:
    """Explode each text longer than ``limit`` code points into pieces of at most ``limit``.

    Adds piece_pos (from 0), overlap_chars (how much of the piece repeats the one before; 0 for the first) and piece;
    ``text`` itself is left out, all other columns stay. substring(piece, overlap_chars + 1) of all pieces in order is
    the text. Shorter texts and nulls give no row. The work is per row, without a shuffle; equal rows give equal pieces.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half the limit")
    cores = F.regexp_extract_all(F.col(text), F.lit(piece_pattern(limit - overlap)), F.lit(0))
    long = df.filter(F.length(text) > limit).withColumn("_cores", cores).drop(text)
    pieces = F.transform("_cores", lambda c, i: F.struct(i.alias("pos"), F.when(i > 0, lookback(F.element_at(F.col("_cores"), F.greatest(i, F.lit(1))), overlap)).otherwise("").alias("back"), c.alias("core")))
    kept = [c for c in long.columns if c not in ("_cores", "piece_pos", "overlap_chars", "piece")]
    out = long.select(*kept, F.explode(pieces).alias("_p"))
    return out.select(*kept, F.col("_p.pos").alias("piece_pos"), F.length("_p.back").alias("overlap_chars"), F.concat("_p.back", "_p.core").alias("piece"))
