"""Problem 3: map freely typed values to the entries of a reference list by weighted character n-grams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.unify_text import unify_text
from auditloom.operators.skew import skew_join
from auditloom.session import cut

#: A number with dots, as versions are written, with or without a word for it.
VERSION = r"(?:\b(?:v|ver|version)[.\s]*)?(?<![\p{L}\p{N}.])\d+(?:\.\d+)+\w*|\b(?:v|ver|version)[.\s]*\d+(?:\.\d+)*\w*"
#: A reference list whose n-grams take more bytes than this isn't broadcast; the joins with it are salted shuffles then.
BROADCAST_BYTES = 32_000_000
ACCENTS = ("áàâäãåçéèêëíìîïñóòôöõøúùûüýÿšžčćłńśźżęąğışß", "aaaaaaceeeeiiiinooooouuuuyyszcclnszzeagiss")


def plain_words(unified: Column) -> Column:
    """The words of a unified value: runs of letters and digits in lower case, without accents and version numbers."""
    s = F.regexp_replace(F.lower(unified), VERSION, " ")
    return F.filter(F.split(F.translate(s, *ACCENTS), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def is_cut_short(unified: Column) -> Column:
    """Whether the value ends in the dot of an abbreviation, as in "Gablin."; a dotted acronym doesn't count."""
    return F.trim(unified).rlike(r"^[^.]*\p{L}{3,}\.$")


def grams(key: Column, open_end: Column | None = None) -> Column:
    """Letters, bigrams and trigrams of the key between marks for its start and, unless it was cut short, its end."""
    marked = F.concat(F.lit("^"), key, F.lit("$") if open_end is None else F.when(open_end, "").otherwise("$"))
    of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(marked) - n + 1, F.lit(1))), lambda i: F.substring(marked, i, F.lit(n)))
    return F.array_distinct(F.concat(of(1), of(2), of(3)))


def reference_forms(catalog: DataFrame) -> DataFrame:
    """Every form an entry may be typed in: id, form, n_words. The name, its aliases, the name without an ending after a dot (.jl), and the initials of names of three words or more."""
    names = catalog.select(F.col("software_id").alias("id"), F.explode(F.array_compact(F.concat(F.array("canonical_name"), F.coalesce("also_known_as", F.array().cast("array<string>"))))).alias("name"))
    words = F.filter(F.split(F.col("name"), r"[\s_-]+"), lambda w: w != "")
    initials = F.when(F.size(words) >= 3, F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))
    without = F.when(F.col("name").rlike(r"\w{3,}\.\w{1,3}$"), F.regexp_replace("name", r"\.\w{1,3}$", ""))
    forms = unify_text(names.select("id", F.explode(F.array_compact(F.array("name", initials, without))).alias("form")), "form", "form", skeleton=True)
    return forms.select("id", plain_words(F.col("form")).alias("w")).filter(F.size("w") > 0).groupBy("id", F.array_join("w", "").alias("form")).agg(F.max(F.size("w")).alias("n_words"))


def map_values(values: DataFrame, catalog: DataFrame, value: str = "value", threshold: float = 0.42, margin: float = 0.01) -> DataFrame:
    """Each distinct value with its entry: value, software_id (0 for none), score, second_score (of another entry, null below ``threshold`` - ``margin``).

    Values are unified and cut into words; every run of words, written together, is looked up. The score is the cosine of
    n-grams weighted by inverse document frequency in the reference list, between an entry's form and the whole value, of
    which only the n-grams of the run can match: words beside it lower the score. Of an entry its best form and run count.
    The best entry is accepted from ``threshold`` up if it leads all others by ``margin``; otherwise the value is
    unmatched, as in a tie. Candidates come from an inverted index: of a run only the rarest n-grams are looked up, as many
    as are needed so that no entry near the threshold can be missed; frequent n-grams are never joined on. Runs go up to twice
    the words of the longest entry. Null values give no row; blank ones and an empty catalog give software_id 0.
    """
    # few bytes but much work for each: without a number of its own, AQE would put them into one task
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    raw = values.select(F.col(value).alias("value")).filter(F.col("value").isNotNull()).repartition(parts, "value").distinct()
    u = unify_text(raw, "value", "_u", skeleton=True)
    keyed = cut(u.select("value", plain_words(F.col("_u")).alias("words"), F.coalesce(is_cut_short(F.col("_u")), F.lit(False)).alias("open_end")))
    # the reference list: forms with their weighted n-grams
    forms = reference_forms(catalog)
    grammed = cut(forms.select("id", "form", "n_words", F.explode(grams(F.col("form"))).alias("gram")))
    entries, longest, size_ = grammed.agg(F.count_distinct("id"), F.coalesce(F.max("n_words"), F.lit(1)), F.coalesce(F.sum(F.length("form") + 40), F.lit(0))).first()
    held = F.broadcast if size_ <= BROADCAST_BYTES else (lambda df: df)
    weights = grammed.groupBy("gram").agg(F.pow(F.log(1 + F.lit(float(entries)) / F.count_distinct("id")), 2).alias("w2"))
    unseen = float(np.log(1 + max(entries, 1)) ** 2)
    weighed = grammed.join(held(weights), "gram").groupBy("id", "form").agg(F.map_from_entries(F.collect_list(F.struct("gram", "w2"))).alias("own"), F.sqrt(F.sum("w2")).alias("norm_f"))
    # every run of words, and every word by itself, with its weighted n-grams, rarest first
    most = 2 * longest
    runs = F.flatten(F.transform("words", lambda _, i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size("words") - i)), lambda n: F.struct(i.alias("at"), n.alias("n"), F.array_join(F.slice("words", i + 1, n), "").alias("key"), (F.col("open_end") & (i + n == F.size("words"))).alias("open_end")))))
    filled = keyed.filter(F.size("words") > 0)
    alone = F.transform("words", lambda w: F.struct(F.lit(0).alias("at"), F.lit(1).alias("n"), w.alias("key"), F.lit(False).alias("open_end")))
    keys = filled.select(F.explode(F.concat(runs, alone)).alias("r")).select("r.key", "r.open_end").repartition(parts, "key").distinct()
    gram = keys.select("key", "open_end", F.explode(grams(F.col("key"), F.col("open_end"))).alias("gram")).join(held(weights), "gram", "left").select("key", "open_end", "gram", F.coalesce("w2", F.lit(unseen)).alias("w2"))
    whole = cut(gram.groupBy("key", "open_end").agg(F.array_sort(F.collect_list(F.struct("w2", "gram"))).alias("grams"), F.sum("w2").alias("size")))
    # by Cauchy-Schwarz, a form that shares no more than the left out n-grams scores less than they weigh
    spare = (threshold - margin) ** 2
    left_out = F.aggregate("grams", F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")), lambda a, g: F.when(a["sum"] + g["w2"] < spare * F.col("size"), F.struct((a["sum"] + g["w2"]).alias("sum"), (a["n"] + 1).alias("n"))).otherwise(F.struct(F.lit(1e300).alias("sum"), a["n"].alias("n"))))["n"]
    rare = whole.select("key", "open_end", "size", "grams", F.coalesce(left_out, F.lit(0)).alias("n")).withColumn("rest", F.aggregate(F.slice("grams", 1, F.col("n")), F.lit(0.0), lambda a, g: a + g["w2"]))
    met = rare.select("key", "open_end", "size", "rest", F.explode(F.slice("grams", F.col("n") + 1, F.size("grams"))).alias("g")).select("key", "open_end", "size", "rest", "g.gram", "g.w2")
    met = met.join(held(grammed.select("id", "form", "gram")), "gram").groupBy("key", "open_end", "id", "form").agg(F.sum("w2").alias("shared"), F.first("size").alias("size"), F.first("rest").alias("rest"))
    # what a candidate can reach at most, if it shares all that was left out too
    near = met.join(held(weighed), ["id", "form"]).filter(F.col("shared") + F.col("rest") >= (threshold - margin) * F.sqrt("size") * F.col("norm_f"))
    dot = F.aggregate("grams", F.lit(0.0), lambda a, g: a + F.coalesce(F.try_element_at(F.col("own"), g["gram"]), F.lit(0.0)))
    scored = near.drop("size").join(whole, ["key", "open_end"]).select("key", "open_end", "id", "size", (dot / F.col("norm_f")).alias("dot"))
    scored = scored.filter(F.col("dot") >= (threshold - margin) * F.sqrt("size")).groupBy("key", "open_end", "id").agg(F.max("dot").alias("dot"), F.first("size").alias("size"))
    # the words beside a run lower its score
    sizes = whole.filter(~F.col("open_end")).select(F.col("key").alias("word"), F.col("size").alias("weight"))
    each = filled.select("value", F.posexplode("words").alias("pos", "word")).join(sizes, "word")  # a word of many values is split by AQE
    total = each.groupBy("value").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "weight"))), lambda x: x["weight"]).alias("weights"))
    asked = filled.join(total, "value").select("value", "weights", F.explode(runs).alias("r"))
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    asked = asked.select("value", "r.key", "r.open_end", (add(F.col("weights")) - add(F.slice("weights", F.col("r.at") + 1, F.col("r.n")))).alias("beside"))
    best = asked.join(scored, ["key", "open_end"]).groupBy("value", "id").agg(F.max(F.col("dot") / F.sqrt(F.col("size") + F.col("beside"))).alias("score"))
    rank = F.row_number().over(Window.partitionBy("value").orderBy(F.desc("score"), "id"))
    top = best.filter(F.col("score") >= threshold - margin).withColumn("rank", rank).filter("rank <= 2").groupBy("value").agg(
        F.max(F.when(F.col("rank") == 1, F.struct("id", "score"))).alias("top"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second_score")
    )
    accepted = (F.col("top.score") >= threshold) & (F.col("second_score").isNull() | (F.col("top.score") - F.col("second_score") >= margin))
    return keyed.select("value").join(top, "value", "left").select("value", F.when(accepted, F.col("top.id")).otherwise(0).cast("int").alias("software_id"), F.col("top.score").alias("score"), "second_score")


def entered_values(screen_cases: DataFrame, goldset: DataFrame) -> DataFrame:
    """All entered software names: src, row_key, pos (place in the flattened array, nulls count), value. Repeated rows give one."""
    a = screen_cases.select(F.lit("screen_cases").alias("src"), F.col("case_key").alias("row_key"), F.posexplode("expect_software").alias("pos", "value"))
    inner = F.flatten(F.transform(F.col("software"), lambda x: F.coalesce(x, F.array().cast("array<string>"))))
    b = goldset.select(F.lit("goldset").alias("src"), F.col("gold_key").alias("row_key"), F.posexplode(inner).alias("pos", "value"))
    return a.unionByName(b).filter(F.col("value").isNotNull()).distinct()


def map_software(screen_cases: DataFrame, goldset: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every entered value with its catalog entry: src, row_key, pos, value, software_id, score. A value typed very often doesn't slow it down."""
    entered = entered_values(screen_cases, goldset)
    return skew_join(entered, map_values(entered, catalog), ["value"], "left").select("src", "row_key", "pos", "value", "software_id", "score")
