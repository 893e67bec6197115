"""Keyword-stuffed texts and link lists, by bagged decision trees and host-level smoothing."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.plans.lineage import keep
from webloom.sources.tables import table

#: Texts of whose pieces the trees are trained, at most, and pieces, at most; those with the smallest hashes, so any is as likely.
TRAIN_TEXTS, TRAIN_PIECES = 20_000, 60_000
#: Trees, their depth and least leaf.
TREES, DEPTH, LEAF = 15, 8, 2
#: Part of a row's score that its host's rate of spam makes up, and rows that the overall rate counts as in that rate.
HOST_PART, HOST_PRIOR = 0.15, 5.0

# Function words of the languages of the web sites.
_FUNCTION = set("""a an the of for in on at to by and or is are was we our us you your they their them it its he she with from as that this who when where what how which while not no be been has have had do does but if than then so about into over without more also each every other until some
der die das den dem des ein eine einen und oder ist sind wir unser unsere sie ihr mit von vom für fur im am an auf aus bei seit zu zum zur nicht auch als wie wo mehr jede jeden jedem ohne zwischen zwar
le la les un une des du et ou est sont nous notre nos vous pour dans sur avec par qui que en au aux ce cette plus depuis sans entre tous
el los las una y o es son con por para del al que se su sus nuestro nuestra este esta más mas desde sin entre todos todas
il lo gli i e di da del della dei nel nella che ci per con su tra nostro nostra questo questa più
o os as um uma e do da dos das em no na nos que com por para nosso nossa este esta mais desde sem
de het een en van voor met op in uit bij te aan dat die onze ons zonder tussen meer sinds alle
w we z ze na od do dla i oraz o po bez przy nasz nasza to ta ten który którzy jest są ponad
в на и с со для от до из по за о без мы наш наша наше это кто чем более всех""".split())  # fmt: skip

FEATURES = ["words", "function_share", "top", "top_share", "distinct_share", "links", "segments", "segment_words", "shared_segments", "upper_share", "ends", "digit_share", "pairs_again", "tags", "bare_run", "log_sources", "rows_each", "linkers"]

_LINK = re.compile(r"https?://\S+|\bwww\.\S+|\S+\.(?:html?|php)\b")
_TAG = re.compile(r"(?<!\w)#\w{3,}")
_CUT = re.compile(r"\s*(?:,|;|\s[|/>»•*+.–·-]+(?=\s)|\||•|»)\s*|\n")


def pieces(text: str) -> list[str]:
    """The sentences of a text; what follows the last sentence is a piece of its own."""
    return [p for p in re.split(r"(?<=[^\s.!?][.!?])\s+(?=\S)", text.strip()) if p]


def content_features(piece: str) -> list[float]:
    """The features of one piece, without those of its links."""
    links = len(_LINK.findall(piece))
    tags = len(_TAG.findall(piece))
    bare = _LINK.sub(" ", piece)
    words = re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)?|\d+\w*", bare)
    low = [w.lower() for w in words]
    n = max(len(low), 1)
    function = [w in _FUNCTION or re.split("['’]", w)[0] + "'" in ("l'", "d'", "qu'", "s'", "n'", "dell'", "all'", "un'") for w in low]
    kinds = Counter(w for w, f in zip(low, function) if not f)
    top, count = kinds.most_common(1)[0] if kinds else ("", 0)
    parts = [p.lower() for p in _CUT.split(bare) if p and p.strip()]
    sets = [set(re.findall(r"\w+", p)) - _FUNCTION for p in parts]
    shared = Counter(w for s in sets for w in s)
    run = most = 0
    for f in function:
        run = 0 if f else run + 1
        most = max(most, run)
    pairs = Counter(zip(low, low[1:]))
    return [
        len(low), sum(function) / n, count, count / n, len(set(low)) / n, links, len(parts), len(low) / max(len(parts), 1), sum(any(shared[w] > 1 for w in s) for s in sets) / max(len(sets), 1),
        sum(w.isupper() and len(w) > 1 for w in words) / n, float(bool(re.search(r"[.!?。]\W*$", piece))), sum(w[0].isdigit() for w in low) / n, sum(c - 1 for c in pairs.values()) / n, tags, most,
    ]


def weak_label(x: list[float]) -> float:
    """1 for what is surely a string of keywords, tags or links, 0 for what surely isn't, 0.5 where it's unclear."""
    f = dict(zip(FEATURES, x))
    if f["links"] >= 4 or f["tags"] >= 4:
        return 1.0
    if f["top"] >= 4 and f["top_share"] >= 0.2 and f["words"] >= 6:
        return 1.0
    if f["function_share"] <= 0.08 and f["words"] >= 6 and (f["segments"] >= 4 and f["segment_words"] <= 5 or f["bare_run"] >= 8 and not f["ends"] or f["upper_share"] >= 0.6 and f["segments"] >= 3):
        return 1.0
    if f["ends"] and f["words"] >= 4 and f["segments"] <= 2 and f["top_share"] <= 0.2 and f["links"] <= 1 and f["tags"] <= 1 and f["upper_share"] < 0.6:
        return 0.0  # one sentence, be it of few function words
    if f["links"] <= 2 and f["tags"] <= 2 and f["top"] <= 3 and (f["words"] <= 4 or f["function_share"] >= 0.18):
        return 0.0
    if f["words"] <= 5 and f["links"] <= 2 and f["segments"] <= 3:
        return 0.0
    return 0.5


class Trees:
    """Bagged decision trees on binned features; every tree is four arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.trees: list[tuple[np.ndarray, ...]] = []
        if not len(y):
            return
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
        b = self._binned(x)
        for _ in range(TREES):
            rows = rng.integers(0, len(y), len(y))
            self.trees.append(self._grow(b[rows], y[rows], rng))

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1)

    def _grow(self, b: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, cut, left, value = [], [], [], []

        def node() -> int:
            for a in (feature, cut, left, value):
                a.append(-1)
            return len(feature) - 1

        todo = [(node(), np.arange(len(y)), 0)]
        while todo:
            at, rows, depth = todo.pop()
            t = y[rows]
            value[at] = float(t.mean())
            if depth == DEPTH or len(rows) < 2 * LEAF or t.min() == t.max():
                continue
            best = (t.var() * len(t) - 1e-9, -1, -1)
            for j in rng.choice(b.shape[1], max(1, int(b.shape[1] * 0.6)), replace=False):
                n = np.bincount(b[rows, j], minlength=34).cumsum()[:-1]
                s = np.bincount(b[rows, j], weights=t, minlength=34).cumsum()[:-1]
                ok = (n >= LEAF) & (len(t) - n >= LEAF)
                if ok.any():
                    loss = np.where(ok, s * (1 - s / np.maximum(n, 1)) + (t.sum() - s) * (1 - (t.sum() - s) / np.maximum(len(t) - n, 1)), np.inf)
                    i = int(loss.argmin())
                    if loss[i] < best[0]:
                        best = (loss[i], int(j), i)
            if best[1] < 0:
                continue
            low = b[rows, best[1]] <= best[2]
            feature[at], cut[at], left[at] = best[1], best[2], node()
            right = node()
            todo += [(left[at], rows[low], depth + 1), (right, rows[~low], depth + 1)]
        return tuple(np.array(a) for a in (feature, cut, left, value))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean of the trees' leaves."""
        if not self.trees or not len(x):
            return np.zeros(len(x))
        b, total = self._binned(x), np.zeros(len(x))
        for feature, cut, left, value in self.trees:
            at = np.zeros(len(x), dtype=int)
            for _ in range(DEPTH):
                f = feature[at]
                go = f >= 0
                step = left[at] + (b[np.arange(len(x)), np.maximum(f, 0)] > cut[at])
                at = np.where(go, step, at)
            total += value[at]
        return total / len(self.trees)


def _featured(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features of the pieces of each text, and the row of each piece."""
    rows, out = [], []
    for i, (text, sources, n, linkers) in enumerate(zip(pdf["text"], pdf["sources"], pdf["n"], pdf["linkers"])):
        for p in pieces(text):
            rows.append(i)
            out.append([*content_features(p), np.log1p(sources), n / max(sources, 1), linkers])
    return np.array(out, dtype=float).reshape(-1, len(FEATURES)), np.array(rows, dtype=int)


def _described(batches):
    """The features of each piece, and its weak label."""
    for pdf in batches:
        x, _ = _featured(pdf)
        yield pd.DataFrame({"x": x.tolist(), "y": [weak_label(list(r)) for r in x]})


def _scored(trees: Trees):
    def run(batches):
        for pdf in batches:
            x, rows = _featured(pdf)
            score = np.zeros(len(pdf))
            np.maximum.at(score, rows, trees.predict(x))
            yield pd.DataFrame({"hash": pdf["hash"], "score": score})

    return run


def stuffed(rows: DataFrame) -> DataFrame:
    """key, score (0 to 1) of the rows of (key, host, text, linkers) whose text is keyword-stuffed, a link or a tag list.

    Trees are trained on weak labels of a bounded sample of distinct texts (TRAIN_TEXTS) and score each piece of each distinct
    text once; a text scores as its worst piece. A row's score is mixed with its host's rate. Blank and null texts
    score 0; a null host counts as one host; linkers is a 64-bit sketch or null. Rows of score 0.5 and more come out.
    """
    spoken = rows.filter(F.regexp_like("text", F.lit(r"\S"))).select("key", F.coalesce("host", F.lit("")).alias("host"), "text", F.unhex(F.md5("text")).alias("hash"), F.bit_count("linkers").alias("bits"))
    texts = spoken.groupBy("hash", "host").agg(F.first("text").alias("text"), F.count("*").alias("n"), F.sum(F.coalesce("bits", F.lit(0))).alias("bits"))
    texts = keep(texts.groupBy("hash").agg(F.first("text").alias("text"), F.count("*").alias("sources"), F.sum("n").alias("n"), (F.sum("bits") / F.sum("n")).alias("linkers")))
    described = texts.orderBy("hash").limit(TRAIN_TEXTS).repartition(16).mapInPandas(_described, "x array<double>, y double")
    sample = described.orderBy(F.xxhash64("x"), "x").limit(TRAIN_PIECES).toPandas()  # numbers alone, whatever the length of the texts
    x, y = np.array(sample["x"].tolist(), dtype=float).reshape(-1, len(FEATURES)), sample["y"].to_numpy(float)
    sure = y != 0.5
    trees = Trees(x[sure], y[sure]) if sure.any() else Trees(x, y)
    scores = keep(texts.mapInPandas(_scored(trees), "hash binary, score double").filter("score >= 0.05"))
    scored = spoken.select("key", "host", "hash").join(scores, "hash", "left").select("key", "host", F.coalesce("score", F.lit(0.0)).alias("score"))
    hosts = scored.groupBy("host").agg(F.sum("score").alias("s"), F.count("*").alias("n"))
    overall = float(hosts.agg((F.sum("s") / F.sum("n")).alias("p")).first()["p"] or 0.0)
    rate = (F.col("s") + HOST_PRIOR * overall) / (F.col("n") + HOST_PRIOR)
    possible = scored.filter(F.col("score") >= (0.5 - HOST_PART) / (1 - HOST_PART))  # the rest can't reach 0.5
    mixed = possible.join(hosts, "host").withColumn("score", (1 - HOST_PART) * F.col("score") + HOST_PART * rate)
    return mixed.filter("score >= 0.5").select("key", "score")


def p5_found(spark, d):
    """Rows of homepage_meta and anchors that are keyword-stuffed or link lists."""
    meta, anchors = table(spark, d, "homepage_meta"), table(spark, d, "anchors")
    key = lambda src, c: F.struct(F.lit(src).alias("src"), F.col(c).alias("rec_id")).alias("key")
    home = meta.filter("meta_id is not null").select(key("homepage_meta", "meta_id"), F.col("domain").alias("host"), F.explode(F.array("title", "description")).alias("text"), F.lit(None).cast("long").alias("linkers"))
    links = anchors.filter("anchor_id is not null").select(key("anchors", "anchor_id"), F.col("linking_domain").alias("host"), F.col("anchor_text").alias("text"), "linkers")
    return stuffed(home.union(links)).select("key.src", "key.rec_id").distinct()


QUERIES = {"p5_found": p5_found}
SQL: dict[str, str] = {}
