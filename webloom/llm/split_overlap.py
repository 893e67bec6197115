"""Same or nearly same records across splits, by a weighted cosine join of term vectors."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from webloom.plans.lineage import keep
from webloom.sources.tables import table

#: Least cosine of a candidate pair: two of its two names may hold a slip each.
COSINE = 0.12
#: Part of its weight that a word has by itself, part that neighbours written together have, and part of all rows up to which a word is rare.
OWN, JOINED, RARE = 0.63, 0.5, 0.005
#: Rows of one block of a term's list.
BLOCK = 2048

# Small words that may be missing on one side.
SMALL = set("""a an the of for in on at to by and or is are was my me i you it its do does please today info now online quickly quick fast just also here there official about near best free really thanks hi hello again still only new again soon
der die das und bitte heute jetzt hier online le la les de des et ici svp el los las y por favor hoy aqui il lo gli e oggi per favore het een en vandaag""".split())


@F.pandas_udf(StringType())
def _tokens(texts: pd.Series) -> pd.Series:
    """Words and numbers, without letter case, accents, character width and punctuation, one blank between."""

    def one(t):
        if not isinstance(t, str):
            return None
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()
        return " ".join(re.findall(r"[^\W\d_]+|\d+", t))

    return texts.map(one)


def slips(a: str, b: str, most: int) -> int:
    """Number of insertions, deletions, changes and swaps of neighbours from a to b; most + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        row = [i]
        for j in range(1, len(b) + 1):
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (a[i - 1] != b[j - 1]))
            if before and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def same_question(a: str, b: str) -> bool:
    """Whether two token strings hold the same words but for order, up to two slips in words of five letters and more,
    words written together or apart, and one small word. Numbers must be equal."""
    x, y = a.split(), b.split()
    rest = list(y)
    left = []
    for w in x:
        if w in rest:
            rest.remove(w)
        else:
            left.append(w)
    if sorted(w for w in left if w.isdigit()) != sorted(w for w in rest if w.isdigit()):
        return False
    for one, many in ((left, rest), (rest, left)):  # words written together on one side
        for w in list(one):
            for u in list(many):
                if w in one and u in many and w.startswith(u) and w != u and w[len(u) :] in many:
                    v = w[len(u) :]
                    one.remove(w)
                    many.remove(u)
                    many.remove(v)
    edits = 0
    for w in list(left):
        for u in list(rest):
            if not w.isdigit() and not u.isdigit() and min(len(w), len(u)) >= 4 and (n := slips(w, u, 2 if min(len(w), len(u)) >= 5 else 1)) <= 2:
                left.remove(w)
                rest.remove(u)
                edits += n
                break
    extra = left + rest
    return edits <= 2 and len(extra) <= 1 and all(w in SMALL or len(w) <= 3 and not w.isdigit() for w in extra)


@F.pandas_udf(BooleanType())
def _same(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same_question(x, y) for x, y in zip(a, b)], dtype=bool)


def _terms(words: Column) -> Column:
    """Terms (term, w) of a row's words, structs of word, u (weight) and rare, in order.

    A word is a term of OWN of its weight. A rare word of four letters and more shares the rest out among what it is without one
    of its letters, so that a slip leaves common terms; neighbours written together are a term of JOINED of their mean weight.
    """
    entry = lambda term, w: F.struct(term.alias("term"), w.alias("w"))
    less = lambda x: F.transform(F.sequence(F.lit(1), F.length(x["word"])), lambda i: F.concat(F.substring(x["word"], F.lit(1), i - 1), F.substring(x["word"], i + 1, F.length(x["word"]))))
    forms = lambda x: F.concat(F.array(entry(x["word"], OWN * x["u"])), F.transform(F.filter(less(x), lambda _: x["rare"] & (F.length(x["word"]) >= 4)), lambda t: entry(t, x["u"] * F.sqrt((1 - OWN * OWN) / F.length(x["word"])))))
    pair = lambda i: entry(F.concat(F.get(words, i)["word"], F.get(words, i + 1)["word"]), JOINED * F.sqrt(F.get(words, i)["u"] * F.get(words, i + 1)["u"]))
    pairs = F.transform(F.filter(F.sequence(F.lit(-1), F.size(words) - 2), lambda i: i >= 0), pair)
    return F.concat(F.flatten(F.transform(words, forms)), pairs)


def term_vectors(forms: DataFrame) -> DataFrame:
    """id, side, v: the unit vector of each row of (id, side, block, words) as structs (df, term, w), rarest term first.

    Weights are squared inverse document frequencies over all rows, so that common words hardly count, whatever the number of
    rows; rows of other blocks have no term in common. Rows without words are left out.
    """
    places = forms.select("id", "side", "block", F.posexplode("words").alias("at", "word"))
    n = forms.count()
    df = places.groupBy("word").agg(F.count_distinct("id").alias("df"))
    u = F.pow(F.log1p(F.lit(float(n)) / F.col("df")), F.lit(2.0))
    weighed = places.join(df, "word").select("id", "side", "block", "at", "word", u.alias("u"), (F.col("df") <= F.greatest(F.lit(RARE * n), F.lit(1.0))).alias("rare"))
    rows = weighed.groupBy("id", "side", "block").agg(F.array_sort(F.collect_list(F.struct("at", "word", "u", "rare"))).alias("words"))  # as long as one text
    counts = rows.select("id", "side", "block", F.explode(_terms(F.col("words"))).alias("e"))
    counts = keep(counts.groupBy("id", "side", F.concat_ws("|", "block", "e.term").alias("term")).agg(F.sum("e.w").alias("w")))
    counts = counts.join(counts.groupBy("term").agg(F.count("*").alias("df")), "term")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e["w"] * e["w"]))
    vectors = counts.groupBy("id", "side").agg(F.collect_list(F.struct("df", "term", "w")).alias("v")).withColumn("n", norm)
    return vectors.select("id", "side", F.array_sort(F.transform("v", lambda e: F.struct(e["df"].alias("df"), e["term"].alias("term"), (e["w"] / F.col("n")).alias("w")))).alias("v"))


def cosine_join(vectors: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b, cosine) of cosine `least` and more between the rows of side 0 (a) and of side 1 (b).

    vectors: id (any distinct long per row), side, v (structs df, term, w, sorted; weights above 0, length 1). Each vector is
    indexed by its rarest terms only, up to where the rest can no longer reach `least`: its rest is bounded by its norm, and by
    the sum of its weights times the largest weight of each term on the other side. Two vectors of a pair share an
    indexed term. What they share there, plus the bound of the rest, prunes; the remaining pairs get the exact dot
    product. Nothing else is left out. A term's list of more than BLOCK rows is met in blocks. An empty side or a row without
    terms has no pairs.
    """
    vectors = keep(vectors)
    entries = vectors.select("id", "side", F.explode("v").alias("e")).select("id", "side", "e.*")
    most = entries.groupBy("term", (1 - F.col("side")).alias("side")).agg(F.max("w").alias("m"))  # of the other side
    bounded = entries.join(most, ["term", "side"]).groupBy("id", "side").agg(F.array_sort(F.collect_list(F.struct("df", "term", "w", "m"))).alias("v"))
    bound = lambda a, e: F.least(F.sqrt(a["r"] + e["w"] * e["w"]), a["s"] + e["w"] * e["m"])
    step = lambda a, e: F.struct(  # noqa: E731  from the last term to the first; those before the first index that can't reach `least` are the index
        (a["r"] + e["w"] * e["w"]).alias("r"), (a["s"] + e["w"] * e["m"]).alias("s"),
        F.when(bound(a, e) < least - 1e-9, a["k"] + 1).otherwise(a["k"]).alias("k"), F.when(bound(a, e) < least - 1e-9, bound(a, e)).otherwise(a["b"]).alias("b"),
    )
    zero = F.struct(F.lit(0.0).alias("r"), F.lit(0.0).alias("s"), F.lit(0).alias("k"), F.lit(0.0).alias("b"))
    pruned = bounded.withColumn("x", F.aggregate(F.reverse("v"), zero, step))
    index = keep(pruned.select("id", "side", F.col("x.b").alias("rest"), F.explode(F.slice("v", F.lit(1), F.size("v") - F.col("x.k"))).alias("e")).select("id", "side", "rest", "e.term", "e.w"))
    long = index.filter("side = 1").groupBy("term").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("blocks > 1")
    split = index.join(long, "term", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    a = split.filter("side = 0").select("term", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.col("id").alias("a"), F.col("w").alias("wa"), F.col("rest").alias("ra"))
    b = split.filter("side = 1").select("term", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("part"), F.col("id").alias("b"), F.col("w").alias("wb"), F.col("rest").alias("rb"))
    shared = a.join(b, ["term", "part"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"), F.max(F.greatest("ra", "rb")).alias("rest"))
    pairs = shared.filter(F.col("dot") + F.col("rest") >= least - 1e-9).select("a", "b")
    side = lambda s, i, v: vectors.filter(F.col("side") == s).select(F.col("id").alias(i), F.map_from_arrays("v.term", "v.w").alias(v))
    both = pairs.join(side(0, "a", "va"), "a").join(side(1, "b", "vb"), "b")
    dot = F.aggregate(F.array_intersect(F.map_keys("va"), F.map_keys("vb")), F.lit(0.0), lambda s, t: s + F.element_at("va", t) * F.element_at("vb", t))
    return both.select("a", "b", F.round(dot, 6).alias("cosine")).filter(F.col("cosine") >= least)


def classes(cases: DataFrame) -> DataFrame:
    """case_id, split, suite, side (0 tune, 1 evaluation), class: cases of one side whose queries have the same words share a class.

    Rows of a null id, of another or null split, or without a word are left out; a repeated case_id counts once.
    """
    side = F.when(F.col("split") == "tune", 0).when(F.col("split").isin("held-out", "sealed"), 1)
    rows = cases.filter("case_id is not null").select("case_id", "split", "suite", side.alias("side"), _tokens("query").alias("text")).filter("side is not null and text <> ''").dropDuplicates(["case_id"])
    rows = rows.withColumn("key", F.array_join(F.array_sort(F.split("text", " ")), " "))
    named = rows.groupBy("side", "key").agg(F.min_by("text", "case_id").alias("form"), F.min("case_id").alias("class"))
    return rows.drop("text").join(named, ["side", "key"]).drop("key")


def linked(rows: DataFrame) -> DataFrame:
    """Pairs (a, b, cosine) of classes of both sides that ask the same; numbers must be equal, so they are the block."""
    forms = rows.groupBy(F.col("class").alias("id"), "side").agg(F.first("form").alias("text"))
    words, number = F.split("text", " "), lambda w: F.regexp_like(w, F.lit(r"^\d+$"))
    cut = forms.select("id", "side", F.array_join(F.array_sort(F.filter(words, number)), " ").alias("block"), F.filter(words, lambda w: ~number(w)).alias("words"))
    near = cosine_join(term_vectors(cut), COSINE)
    text = lambda s, i, t: forms.filter(F.col("side") == s).select(F.col("id").alias(i), F.col("text").alias(t))
    return near.join(text(0, "a", "ta"), "a").join(text(1, "b", "tb"), "b").filter(_same("ta", "tb")).select("a", "b", "cosine")


def p7_found(spark, d):
    """Pairs of a tune case and a held-out or sealed case that ask the same."""
    rows = keep(classes(table(spark, d, "audit_cases")))
    links = linked(rows)
    of = lambda s, c, i: rows.filter(F.col("side") == s).select(F.col("class").alias(c), F.col("case_id").alias(i))
    pairs = links.join(of(0, "a", "x"), "a").join(of(1, "b", "y"), "b")
    return pairs.select(F.least("x", "y").alias("case_a"), F.greatest("x", "y").alias("case_b"))


def p7_report(spark, d):
    """Of each evaluation split and suite: its cases, those found in the tune split, and the pairs."""
    rows = keep(classes(table(spark, d, "audit_cases")))
    sizes = rows.filter("side = 0").groupBy(F.col("class").alias("a")).agg(F.count("*").alias("n"))
    hits = linked(rows).join(sizes, "a").groupBy("b").agg(F.sum("n").alias("pairs"))
    cases = rows.filter("side = 1").join(hits, rows["class"] == hits.b, "left")
    return cases.groupBy("split", "suite").agg(F.count("*").alias("cases"), F.count("b").alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))


QUERIES = {"p7_found": p7_found, "p7_report": p7_report}
SQL: dict[str, str] = {}
