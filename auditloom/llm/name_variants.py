"""Problem 4: link the spellings of one person or group.

Suffix blocking on name tokens: every suffix from a minimum length up is a block, beside beginnings and single deletions.
Overly common blocks are refined by the initials of the given names; what is common even then is spread over tasks and
compared as a whole. Pairs in a block are compared by the ratio of their longest common subsequence. That joins misspelt
family names to the usual spelling; within a family the given names decide.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.unify_text import LOOKALIKES
from auditloom.operators.skew import skew_join
from auditloom.session import cut

# Short forms of given names.
NICKNAMES = {
    "abby": "abigail", "gail": "abigail", "al": "alexander albert", "alex": "alexander alexandra", "sandy": "alexander alexandra", "andy": "andrew", "drew": "andrew", "tony": "anthony", "art": "arthur", "barney": "barnaby", "bea": "beatrice", "trixie": "beatrice", "ben": "benjamin", "benny": "benjamin",
    "charlie": "charles charlotte", "chuck": "charles", "lottie": "charlotte", "charley": "charlotte", "chris": "christopher christina christine", "kit": "christopher katherine", "topher": "christopher", "clem": "clement", "connie": "constance", "dan": "daniel", "danny": "daniel", "dave": "david", "deb": "deborah", "debbie": "deborah", "debby": "deborah",
    "don": "donald", "dot": "dorothy", "ed": "edward edwin", "eddie": "edward edwin", "ned": "edward", "ted": "edward theodore", "teddy": "edward theodore", "ellie": "eleanor eleonore", "nell": "eleanor eleonore", "nora": "eleanor eleonore", "beth": "elizabeth", "betty": "elizabeth", "bess": "elizabeth", "betsy": "elizabeth", "eliza": "elizabeth", "libby": "elizabeth", "lisa": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth",
    "flo": "florence florian", "fran": "francesca frances francis", "frankie": "francesca frances francis", "frank": "francis franklin", "fred": "frederick", "freddie": "frederick", "freddy": "frederick", "gabe": "gabriel", "greg": "gregory gregoire", "gwen": "gwendolyn", "hal": "harold henry", "harry": "harold henry", "hank": "henry", "etta": "henrietta", "hetty": "henrietta", "hettie": "henrietta",
    "iggy": "ignatius", "bella": "isabella", "belle": "isabella", "izzy": "isabella", "issy": "isabella", "jim": "james", "jimmy": "james", "jamie": "james", "jack": "john", "johnny": "john", "jon": "jonathan", "jonny": "jonathan", "joe": "joseph", "jo": "josephine joanna", "josie": "josephine", "josy": "josephine", "kate": "katherine", "kathy": "katherine", "kathie": "katherine", "katie": "katherine", "kitty": "katherine", "kay": "katherine",
    "ken": "kenneth", "kenny": "kenneth", "larry": "lawrence", "laurie": "lawrence", "lou": "louisa louise louis", "lulu": "louisa louise", "madge": "margaret", "maggie": "margaret", "meg": "margaret", "peg": "margaret", "peggy": "margaret", "greta": "margaret", "rita": "margaret", "matt": "matthew", "mick": "michael", "mike": "michael", "mickey": "michael", "nat": "natalia nathaniel nathan", "natasha": "natalia", "tasha": "natalia", "talia": "natalia",
    "nick": "nicholas", "nicky": "nicholas", "ollie": "oliver", "noll": "oliver", "pat": "patricia patrick", "patsy": "patricia", "patty": "patricia", "tricia": "patricia", "trish": "patricia", "pete": "peter", "pip": "philippa philip", "phil": "philip philippa", "pippa": "philippa", "becca": "rebecca", "becky": "rebecca", "dick": "richard", "rick": "richard", "ricky": "richard", "rich": "richard", "richie": "richard", "bob": "robert", "bobby": "robert", "rob": "robert", "robbie": "robert", "bert": "robert albert",
    "sasha": "alexander alexandra", "sam": "samuel samantha", "sammy": "samuel", "steve": "stephen steven", "stevie": "stephen", "sue": "susannah susan", "susie": "susannah susan", "suzy": "susannah susan", "theo": "theodore", "tess": "theresa", "terry": "theresa terence", "tessa": "theresa", "tom": "thomas", "tommy": "thomas", "vicky": "victoria", "vickie": "victoria", "tori": "victoria", "vic": "victor victoria", "vince": "vincent", "vinny": "vincent", "bill": "william", "billy": "william", "will": "william", "willy": "william", "liam": "william", "winnie": "winifred", "freda": "winifred", "zach": "zachary", "zack": "zachary", "zak": "zachary",
}
# Words that are no part of a name, words of group names with their full form, and stand-ins for a missing name.
TITLES = frozenset("dr prof professor phd msc bsc md dphil mr mrs ms sir dame jr sr ii iii".split())
PARTICLES = frozenset("van von de der den des del della di da dos du la le ten ter zu zur af av al el bin ibn".split())
GROUP_WORDS = {"institute": "institute", "inst": "institute", "laboratory": "laboratory", "lab": "laboratory", "labs": "laboratory", "laboratories": "laboratory", "centre": "centre", "center": "centre", "ctr": "centre", "group": "group", "grp": "group", "gp": "group", "consortium": "consortium", "consort": "consortium", "collaboration": "collaboration", "department": "department", "dept": "department", "university": "university", "univ": "university", "society": "society", "soc": "society", "unit": "unit", "network": "network", "team": "team", "school": "school", "college": "college", "coll": "college", "council": "council", "committee": "committee", "association": "association", "assoc": "association", "foundation": "foundation", "project": "project", "initiative": "initiative"}
GROUP_SHORT = {"collab": "collaborative", "stats": "statistics", "stat": "statistics", "appl": "applied", "infer": "inference", "cogn": "cognitive", "model": "modelling", "modeling": "modelling", "samp": "sampling"}
NO_NAME = frozenset(("", "anonymous", "anon", "unknown", "author unknown", "et al", "and others", "others", "na", "n a", "none", "nn", "tbd", "tba", "no author", "not stated", "not given", "authors", "author", "name withheld", "withheld", "see paper", "various", "staff", "null"))

_FOLD = str.maketrans(LOOKALIKES | {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "ı": "i", "ß": "ss", "æ": "ae", "œ": "oe", "’": "'"})


def fold(text: str) -> str:
    """Compatibility forms, accents and look-alikes folded; letter case stays."""
    text = unicodedata.normalize("NFKD", text.translate(_FOLD))
    return "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")


def parse_name(name: str) -> dict | None:
    """The parts of one spelling, or None for a stand-in: tokens, how many of them stand before a comma, whether it is a group."""
    plain = re.sub(r"[“\"«„(\[][^”\"»“)\]]*[”\"»“)\]]", " ", fold(name))
    if " ".join(re.findall(r"[^\W\d_]+", plain.lower())) in NO_NAME:
        return None
    shout = plain.upper() == plain
    sides: list[list[str]] = []
    titles: list[str] = []
    for side in plain.split(","):
        tokens = []
        for t in re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*\.?", side.replace("-", " ")):
            cut, low = t.endswith("."), t.rstrip(".").lower().replace("'", "")
            if low in TITLES or (t[0].islower() and len(low) <= 5 and not plain.islower()):  # particles are written small
                titles.append(t)
                continue
            if len(low) == 2 and t.rstrip(".").isupper() and not shout:
                tokens += [c + "." for c in low]
            else:
                tokens.append(low + ("." if cut and len(low) > 1 else "." if len(low) == 1 else ""))
        if tokens:
            sides.append(tokens)
    if not sides:
        return None
    tokens = [t for side in sides for t in side]
    if len(tokens) == 1 and (initials := [t for t in titles if len(t) == 2 and t.isupper() and not shout]):
        return {"tokens": [*(c + "." for c in initials[0].lower()), *tokens], "before": 0, "is_group": False}
    bare = [t.rstrip(".") for t in tokens]
    if any(b in GROUP_WORDS for b in bare) and len(bare) > 2:
        full = [GROUP_WORDS.get(b, GROUP_SHORT.get(b, b)) for b in bare if b not in ("the", "of", "for", "and", "on", "in", "at") and b not in PARTICLES]
        return {"tokens": full, "before": 0, "is_group": True}
    return {"tokens": tokens, "before": len(sides[0]) if len(sides) > 1 else 0, "is_group": False}


def lcs_ratio(a: str, b: str) -> float:
    """Twice the length of the longest common subsequence over the sum of the lengths, by bit-parallel dynamic programming."""
    if not a or not b:
        return 0.0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        both = row & at.get(c, 0)
        row = ((row + both) | (row - both)) & full
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def lcs_ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_ratio(x, y) for x, y in zip(a, b)])


def _parsed(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in rows:
        out = [(n, p["tokens"], p["before"], p["is_group"]) for n in part["name"] if (p := parse_name(n))]
        yield pd.DataFrame(out, columns=["name", "tokens", "before", "is_group"])


def _nearest(ratio: float, names: list[str]):
    """For a large block: each own token with the most frequent tokens similar to it, all tokens of the block being compared."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["n", "token"], ascending=[False, True], kind="stable", ignore_index=True)
        tokens, n = block["token"].tolist(), block["n"].to_numpy()
        sizes = np.array([len(t) for t in tokens], np.int32)
        codes = np.frombuffer("".join(tokens).encode("utf-32-le"), np.uint32) % 32
        letters = np.bincount(np.repeat(np.arange(len(tokens)), sizes) * 32 + codes, minlength=32 * len(tokens)).reshape(-1, 32).astype(np.int16)
        # two bits a letter for its first two times; more times than two are in ``beyond``
        once = np.uint64(1) << np.arange(0, 64, 2, dtype=np.uint64)
        bits, beyond = ((letters > 0) * once).sum(1, dtype=np.uint64) | ((letters > 1) * (once * np.uint64(2))).sum(1, dtype=np.uint64), np.maximum(letters - 2, 0).sum(1, dtype=np.int32)
        out, least_n = [], np.full(len(tokens), -1, np.int64)
        left, at, step = np.flatnonzero(block["own"].to_numpy()), 0, 64
        left = left[left > 0]
        while left.size:
            stop = min(at + step, len(tokens))
            for rows in np.array_split(left, -(-left.size * (stop - at) // 2**18)):
                # common letters bound the common subsequence from above, so no similar token is passed over
                most = np.bitwise_count(bits[rows, None] & bits[at:stop]) + beyond[rows, None]
                close = (np.abs(sizes[rows, None] - sizes[at:stop]) <= 2) & (2 * most >= ratio * (sizes[rows, None] + sizes[at:stop]) - 1e-9) & (np.arange(at, stop) < rows[:, None])
                x, y = np.nonzero(close)
                i, j = rows[x], at + y
                close = 2 * np.minimum(letters[i], letters[j]).sum(1) >= ratio * (sizes[i] + sizes[j]) - 1e-9
                for i, j in zip(i[close].tolist(), j[close].tolist()):
                    if n[j] >= least_n[i] and (r := lcs_ratio(tokens[i], tokens[j])) >= ratio:
                        least_n[i] = n[j]
                        out.append((i, j, r))
            at, step = stop, step * 2
            left = left[left > at]
            left = left[(least_n[left] < 0) | (n[at : at + 1] == least_n[left])]
        i, j, r = (list(x) for x in zip(*out)) if out else ([], [], [])
        found = block.loc[i, names].reset_index(drop=True)
        text = lambda at: pd.Series([tokens[x] for x in at], dtype=object)  # noqa: E731  # also without rows: Arrow can't take other empty columns as text
        return found.assign(token=text(i), main=text(j), n=n[i].astype(np.int64), m=n[j].astype(np.int64), ratio=np.array(r, float))

    return run


def similar_tokens(tokens: DataFrame, scope: list[str], least: int, ratio: float, common: int = 50, part: int = 1000, refine: str | None = None) -> DataFrame:
    """Pairs (token, main) of similar tokens within ``scope``, the more frequent one as main; ``tokens``: scope, token, n.

    Blocks are all suffixes of at least ``least`` letters, the first half of the token (also one letter less) for misspelt
    last letters and, for tokens too short to keep either, the token without any one of its letters: tokens that differ by
    one letter (changed, lost, added, swapped with its neighbour) always share a block. Blocks with more than ``common``
    tokens are first refined by another field: ``refine`` names an array of bytes, such as hashed initials of the given
    names, of which two tokens must share one; an empty array goes with all. What is still common then, as a hot name
    makes it, isn't discarded: all its tokens are compared, from the most frequent on and only until one is similar, so of
    such a block come each token's most frequent mains, not the rarer ones. It is spread over tasks by ``part`` tokens each.
    """
    length = F.length("token")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(length - least + 1, F.lit(1))), lambda i: F.substring(F.col("token"), i, length))
    half = lambda less: F.substring(F.col("token"), F.lit(1), F.greatest(F.lit(3), F.floor(length / 2).cast("int") - less))
    halves = F.array(F.concat(F.lit("^"), half(0)), F.concat(F.lit("^"), half(1)))
    without = F.transform(F.sequence(F.lit(1), length), lambda i: F.concat(F.lit("-"), F.substring(F.col("token"), F.lit(1), i - 1), F.substring(F.col("token"), i + 1, length)))
    without = F.when(length <= 2 * least + 2, F.concat(without, F.array(F.concat(F.lit("-"), "token")))).otherwise(F.array().cast("array<string>"))
    other = F.col(refine) if refine else F.array().cast("array<tinyint>")
    blocks = tokens.withColumn("block", F.explode(F.array_distinct(F.concat(suffixes, halves, without)))).select(*scope, "block", "token", "n", other.alias("other"))

    def sized(df: DataFrame) -> DataFrame:
        return df.join(df.groupBy(*scope, "block").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), [*scope, "block"])

    blocks = cut(sized(blocks))
    few, many = blocks.filter(F.col("size") <= common).drop("other", "size"), blocks.filter(F.col("size") > common).drop("size")
    if refine:
        kinds = F.when(F.size("other") > 0, F.col("other")).otherwise(F.sequence(F.lit(0), F.lit(31)).cast("array<tinyint>"))
        refined = many.withColumn("kind", F.explode(F.array_distinct(kinds))).withColumn("block", F.concat("block", F.lit("\t"), "kind")).drop("kind", "other")
        refined = cut(sized(refined))
        few, many = few.unionByName(refined.filter(F.col("size") <= common).drop("size")), refined.filter(F.col("size") > common)
    else:
        many = blocks.filter(F.col("size") > common)
    left = few.select(*scope, "block", "token", "n")
    right = few.select(*scope, "block", F.col("token").alias("main"), F.col("n").alias("m"))
    nearer = (F.col("m") > F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("main") < F.col("token")))
    alike = (F.abs(F.length("token") - F.length("main")) <= 2) & nearer
    pairs = left.join(right, [*scope, "block"]).filter(alike).select(*scope, "token", "main", "n", "m").distinct()
    pairs = pairs.withColumn("ratio", lcs_ratios("token", "main")).filter(F.col("ratio") >= ratio)
    parts = F.ceil(F.col("size") / part).cast("int")
    spread = many.select(*scope, "block", "token", "n", "size").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("own", F.pmod(F.xxhash64("token"), parts) == F.col("part"))
    nearest = spread.groupBy(*scope, "block", "part").applyInPandas(_nearest(ratio, scope), pairs.schema)
    return pairs.unionByName(nearest).distinct()


def _usual(pairs: DataFrame, scope: list[str]) -> DataFrame:
    """Each token with the usual spelling at the end of its chain, however long: a token hangs on its most frequent similar one, that perhaps on another."""
    best = cut(pairs.groupBy(*scope, "token").agg(F.max_by("main", F.struct("m", "ratio", "main")).alias("usual")))
    while True:  # each turn doubles the length of chain that is followed; they have no circles, as a main is always the nearer one
        ends = best.select(*scope, F.col("token").alias("usual"), F.col("usual").alias("end"))
        if best.join(ends, [*scope, "usual"], "left_semi").isEmpty():
            return best
        best = cut(best.join(ends, [*scope, "usual"], "left").select(*scope, "token", F.coalesce("end", "usual").alias("usual")))


def name_entities(archived_papers: DataFrame, column: str = "paper_authors") -> DataFrame:
    """Each distinct spelling with the entity it means: name, entity.

    Null, blank and stand-in entries give no row. Misspelt family names of six letters and more join the usual spelling;
    shorter ones only where the given name is the same and the misspelling is rare. Initials, short forms and nicknames join
    the one given name of their family that they fit, among those that stand there in full or as a nickname's full form;
    where they fit several or none they form an entity of their own.
    """
    names = archived_papers.select(F.explode(column).alias("name")).filter(F.trim("name") != "").distinct()
    parsed = cut(names.mapInPandas(_parsed, "name string, tokens array<string>, before int, is_group boolean"))
    # which token is the family name: the one that more often stands last or before a comma
    spread = parsed.select("name", "before", "is_group", F.size("tokens").alias("size"), F.posexplode("tokens").alias("pos", "token"))
    full = F.length(F.rtrim(F.col("token"), F.lit("."))) > 2
    sure = F.when(F.col("before") > 0, F.col("pos") < F.col("before")).otherwise(F.col("pos") == F.col("size") - 1)
    weight = F.when(F.col("before") > 0, 2).otherwise(1)
    stats = spread.filter(~F.col("is_group") & full).groupBy("token").agg((F.sum(F.when(sure, weight).otherwise(0)) / F.sum(weight)).alias("share"))
    group_word = F.col("token").isin(*sorted(set(GROUP_WORDS.values()) | set(GROUP_SHORT.values())))
    frequent = spread.filter("is_group").groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    scored = spread.join(stats, "token", "left").join(frequent, "token", "left")
    score = F.when(F.col("is_group"), F.when(group_word, F.lit(-1e9)).otherwise(-F.col("uses").cast("double"))).otherwise(F.when((F.col("before") > 0) & (F.col("pos") >= F.col("before")), -1.0).when(F.col("token").isin(*sorted(PARTICLES)), -0.5).otherwise(F.coalesce("share", F.lit(0.0))))
    parts = scored.groupBy("name", "is_group").agg(F.max(F.struct(score.alias("score"), F.when(F.col("is_group"), F.length("token")).otherwise(0).alias("len"), "pos", "token")).alias("f"), F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("all"))
    rest = F.transform(F.filter("all", lambda x: (x["pos"] != F.col("f.pos")) & ~x["token"].isin(*sorted(PARTICLES))), lambda x: x["token"])
    parts = cut(parts.select("name", "is_group", F.rtrim(F.col("f.token"), F.lit(".")).alias("family"), rest.alias("rest")))
    # given names: whole words written together, else the first initial or the beginning
    words = F.filter("rest", lambda t: ~t.endswith(".") & (F.length(t) > 2))
    dotted = F.filter("rest", lambda t: t.endswith("."))
    given = F.when(F.col("is_group"), F.array_join(F.array_sort("rest"), " ")).otherwise(F.array_join(words, ""))
    parts = parts.withColumn("given", given).withColumn("start", F.rtrim(F.coalesce(F.try_element_at(dotted, F.lit(1)), F.lit("")), F.lit(".")))
    # misspelt family names
    initial = F.when(F.length("given") > 0, F.substring("given", 1, 1)).when(F.length("start") > 0, F.substring("start", 1, 1))
    kind = F.when(~F.col("is_group") & initial.isNotNull(), F.pmod(F.xxhash64(initial), F.lit(32)).cast("tinyint"))
    families = parts.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.collect_set(kind).alias("kinds")).select(F.lit(1).alias("one"), F.col("family").alias("token"), "n", "kinds")
    usual = _usual(similar_tokens(families.filter(F.length("token") >= 6), ["one"], 5, 0.85, refine="kinds"), ["one"]).select(F.col("token").alias("family"), "usual")
    parts = cut(parts.join(usual, "family", "left").withColumn("family", F.coalesce("usual", "family")).drop("usual"))
    # short ones only beside the same given name
    brief = parts.filter(~F.col("is_group") & (F.length("given") > 2) & F.length("family").between(3, 7)).groupBy("given", F.col("family").alias("token")).agg(F.count(F.lit(1)).alias("n"))
    pairs = similar_tokens(brief, ["given"], 3, 0.8).filter((F.least(F.length("token"), F.length("main")) < 6) & ((F.col("n") == 1) | (F.col("n") * 3 <= F.col("m"))))
    usual = _usual(pairs, ["given"]).select("given", F.col("token").alias("family"), "usual", F.lit(False).alias("is_group"))
    parts = parts.join(usual, ["given", "family", "is_group"], "left").withColumn("family", F.coalesce("usual", "family")).drop("usual")
    short = F.create_map(*[F.lit(x) for k, v in NICKNAMES.items() for x in (k, v)])
    parts = cut(parts.withColumn("long", F.when(~F.col("is_group"), F.split(F.try_element_at(short, F.col("given")), " "))))
    # misspelt given names, within one family
    givens = parts.filter((F.length("given") > 2) & F.col("long").isNull()).groupBy("family", "is_group", F.col("given").alias("token")).agg(F.count(F.lit(1)).alias("n"))
    right = _usual(similar_tokens(givens, ["family", "is_group"], 3, 0.8), ["family", "is_group"]).select("family", "is_group", F.col("token").alias("given"), "usual")
    parts = cut(parts.join(right, ["family", "is_group", "given"], "left").withColumn("given", F.coalesce("usual", "given")).drop("usual"))
    whole = parts.filter((F.length("given") > 2) & F.col("long").isNull()).select("name", "is_group", "family", F.col("given").alias("full"))
    people = whole.filter(~F.col("is_group")).select("family", "full").distinct()
    # nicknames by their long forms: the one that stands in the family, else the first of them
    nicks = parts.filter(F.col("long").isNotNull()).select("family", "given", "long").distinct()
    known = nicks.select("family", "given", F.explode("long").alias("full")).join(people.withColumn("there", F.lit(True)), ["family", "full"], "left")
    known = known.groupBy("family", "given").agg(F.collect_set(F.when(F.col("there"), F.col("full"))).alias("fits"), F.min("full").alias("else"))
    known = cut(known.select("family", "given", F.when(F.size("fits") == 1, F.col("fits")[0]).otherwise(F.col("else")).alias("full")))
    nick = parts.filter(F.col("long").isNotNull()).join(known, ["family", "given"]).select("name", "is_group", "family", "full")
    # initials and beginnings by the given names that begin alike; each kind of them once per family
    people = people.unionByName(known.select("family", "full")).distinct()
    loose = parts.filter((F.length("given") <= 2) & ~F.col("is_group")).withColumn("start", F.when(F.length("start") > 0, F.col("start")).otherwise(F.col("given")))
    first = lambda c: F.substring(c, 1, 1)
    starts = loose.select("family", "start").filter(F.length("start") > 0).distinct().withColumn("initial", first("start"))
    begun = starts.join(people.withColumn("initial", first("full")), ["family", "initial"]).filter(F.col("full").startswith(F.col("start")))
    only = begun.groupBy("family", "start").agg(F.count(F.lit(1)).alias("n"), F.min("full").alias("full")).filter("n = 1").drop("n")
    rest = loose.join(only, ["family", "start"], "left").select("name", "is_group", "family", F.coalesce("full", "start").alias("full"))
    entity = F.concat_ws("|", F.when(F.col("is_group"), "group").otherwise("person"), "family", "full")
    return whole.unionByName(nick).unionByName(rest).select("name", entity.alias("entity"))


def link_variants(archived_papers: DataFrame, column: str = "paper_authors") -> DataFrame:
    """Each distinct spelling once: name, entity, representative (the entity's most used spelling, of equals the first), n_spellings."""
    uses = archived_papers.select(F.explode(column).alias("name")).filter(F.trim("name") != "").groupBy("name").agg(F.count(F.lit(1)).alias("uses"))
    entities = cut(name_entities(archived_papers, column))
    heads = entities.join(uses, "name").groupBy("entity").agg(F.min(F.struct((-F.col("uses")).alias("uses"), "name"))["name"].alias("representative"), F.count(F.lit(1)).alias("n_spellings"))
    return skew_join(entities, heads, ["entity"]).select("name", "entity", "representative", "n_spellings")


def variant_pairs(entities: DataFrame) -> DataFrame:
    """All pairs of distinct spellings of one entity, from name_entities(): name_a, name_b; name_a < name_b in byte order.

    Spellings meet within their entity only, so the pairs formed are those of the result, twice; an entity with a large
    share of the spellings is salted.
    """
    entities = cut(entities)
    a = entities.select(F.col("name").alias("name_a"), "entity")
    b = entities.select(F.col("name").alias("name_b"), "entity")
    return skew_join(a, b, ["entity"]).filter(F.col("name_a") < F.col("name_b")).select("name_a", "name_b")
