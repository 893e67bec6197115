"""Language of each document and segment, by Kneser-Ney character models."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.residue import homepage_residue
from webloom.llm.stuffing import p5_found
from webloom.sources.tables import table

LANGS = ("en", "de", "fr", "es", "it", "pt", "nl", "pl", "ru", "ja")
#: Letters of the longest group, and texts of each language of which the models are trained at most (those with the smallest hashes).
ORDER, TRAIN_TEXTS, TRAIN_DOCS = 5, 1500, 250
#: Characters of a text from which, and up to which, it may be among them; longer ones get their languages all the same.
TRAIN_FROM, TRAIN_TO = 200, 5000
#: Least confidence of a segment whose language counts.
SURE = 0.8
_PAD = "\x02" * (ORDER - 1)
_MUL = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str) -> str:
    """What the models read: lower case, without digits, links and signs, single blanks."""
    t = re.sub(r"https?://\S+|www\.\S+|\S+@\S+", " ", unicodedata.normalize("NFC", text)).lower()
    return " ".join(re.sub(r"[^\w'’]|[\d_]", " ", t).replace("’", "'").split())


def bare(text: str) -> str:
    """Without accents."""
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)))


def _grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the letter groups of each length that end at each letter, and the text each letter is of."""
    marked = [_PAD + " " + t + " " for t in texts]
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    of = np.repeat(np.arange(len(texts)), [len(m) for m in marked])
    place = np.concatenate([np.arange(len(m)) for m in marked]) if marked else np.zeros(0, dtype=int)
    ends = np.flatnonzero(place >= ORDER - 1)
    out = [np.zeros(len(ends), dtype=np.uint64)]
    with np.errstate(over="ignore"):
        for n in range(1, ORDER + 1):
            out.append((out[-1] + codes[ends - (n - 1)]) * _MUL)  # a longer group adds the letter before it
    return out, of[ends]


def _contexts(texts: list[str]) -> list[np.ndarray]:
    """Hashes of the groups of each length that end just before each letter."""
    marked = [_PAD + " " + t + " " for t in texts]
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    place = np.concatenate([np.arange(len(m)) for m in marked]) if marked else np.zeros(0, dtype=int)
    ends = np.flatnonzero(place >= ORDER - 1)
    out = [np.zeros(len(ends), dtype=np.uint64)]
    with np.errstate(over="ignore"):
        for n in range(1, ORDER):
            out.append((out[-1] + codes[ends - n]) * _MUL)
    return out


class Models:
    """Interpolated Kneser-Ney models of all languages in sorted hash arrays, a column for each language.

    For each length: share[k] holds the discounted share of group keys[k] among those of its context, and back[k] the weight that the
    context contexts[k] leaves to the shorter group. What isn't found has share 0, and leaves all.
    """

    def __init__(self, texts: dict[str, list[str]]):
        self.langs = list(texts)
        per = [self._counted(t) for t in texts.values()]
        self.levels = []
        for n in range(1, ORDER + 1):
            keys, share = self._merged([p[n - 1][0:2] for p in per], 0.0)
            contexts, back = self._merged([p[n - 1][2:4] for p in per], 1.0)
            self.levels.append((keys, share, contexts, back))
        self.limit = np.full(len(self.langs), np.inf)
        self.heat = 1.0

    @staticmethod
    def _merged(tables: list[tuple[np.ndarray, np.ndarray]], empty: float) -> tuple[np.ndarray, np.ndarray]:
        keys = np.unique(np.concatenate([k for k, _ in tables]))
        values = np.full((len(keys) + 1, len(tables)), empty, dtype=np.float32)  # the last row: not found
        for j, (k, v) in enumerate(tables):
            values[np.searchsorted(keys, k), j] = v
        return keys, values

    @staticmethod
    def _counted(texts: list[str]) -> list[tuple[np.ndarray, ...]]:
        grams, _ = _grams(texts)
        contexts = _contexts(texts)
        out = []
        for n in range(1, ORDER + 1):
            if n == ORDER:
                keys, first, counts = np.unique(grams[n], return_index=True, return_counts=True)
            else:  # of shorter groups, the number of different letters before them counts
                _, longer = np.unique(grams[n + 1], return_index=True)
                keys, at, counts = np.unique(grams[n][longer], return_index=True, return_counts=True)
                first = longer[at]
            once, twice = (counts == 1).sum(), (counts == 2).sum()
            d = once / (once + 2 * twice) if once and twice else 0.5
            own, where = np.unique(contexts[n - 1][first], return_inverse=True)
            total = np.bincount(where, weights=counts, minlength=len(own))
            kinds = np.bincount(where, minlength=len(own))
            out.append((keys, (counts - d) / total[where], own, d * kinds / total) if len(keys) else (keys, np.zeros(0), own, np.zeros(0)))
        return out

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Cross-entropy per letter of each text in each language."""
        if not texts:
            return np.zeros((0, len(self.langs)))
        grams, of = _grams(texts)
        before = _contexts(texts)
        p = np.full((len(of), len(self.langs)), 1 / 4096, dtype=np.float32)
        find = lambda keys, x: np.where(keys[np.minimum(i := np.searchsorted(keys, x), max(len(keys) - 1, 0))] == x, i, len(keys)) if len(keys) else np.zeros(len(x), dtype=int)
        for n, (keys, share, contexts, back) in enumerate(self.levels, 1):
            p = share[find(keys, grams[n])] + back[find(contexts, before[n - 1])] * p
        loss = -np.log2(np.maximum(p, 1e-9))
        sums = np.stack([np.bincount(of, weights=loss[:, j], minlength=len(texts)) for j in range(len(self.langs))], axis=1)
        return sums / np.maximum(np.bincount(of, minlength=len(texts)), 1)[:, None]

    def calibrate(self, texts: list[str], labels: list[str]) -> None:
        """Fit, on held-out texts, the heat of the confidence and each language's highest believable cross-entropy."""
        if not texts:
            return
        h, right = self.entropies(texts), np.array([self.langs.index(x) for x in labels])
        n = np.sqrt([max(len(t), 1) for t in texts])
        best = np.inf
        for heat in (0.5, 1.0, 2.0, 4.0):
            q = self._shares(h, n, heat)
            loss = -np.log(np.maximum(q[np.arange(len(q)), right], 1e-12)).mean()
            if loss < best:
                best, self.heat = loss, heat
        for j in range(len(self.langs)):
            own, others = h[right == j, j], h[right != j, j]
            if len(own) >= 20 and len(others) >= 20:
                usual, foreign = np.quantile(own, 0.99), np.quantile(others, 0.1)
                self.limit[j] = max(usual, usual + 0.95 * (foreign - usual))

    @staticmethod
    def _shares(h: np.ndarray, n: np.ndarray, heat: float) -> np.ndarray:
        z = -(h - h.min(axis=1, keepdims=True)) * heat * np.asarray(n)[:, None]
        e = np.exp(z)
        return e / e.sum(axis=1, keepdims=True)

    def best(self, texts: list[str]) -> tuple[list[str | None], np.ndarray]:
        """Language of lowest cross-entropy and confidence; None where even that is too high for it, or a text has no letters."""
        h = self.entropies(texts)
        if not len(h):
            return [], np.zeros(0)
        i = h.argmin(axis=1)
        q = self._shares(h, np.sqrt([max(len(t), 1) for t in texts]), self.heat)
        own = h[np.arange(len(h)), i]
        return [self.langs[j] if t and e <= self.limit[j] else None for t, j, e in zip(texts, i, own)], np.round(q[np.arange(len(h)), i], 4)


def segments(title: str | None, description: str | None) -> list[tuple[str, str]]:
    """(field, segment): the sentences and lines of both fields; a title is also cut where it names its parts."""
    out = []
    for field, text in (("title", title), ("description", description)):
        if isinstance(text, str):
            cut = r"(?<=[.!?。！？])(?:\s+|(?<=[。！？]))|\n+|\s+[|/]\s+" + (r"|\s+[-–—]\s+|:\s+" if field == "title" else "")
            out += [(field, s.strip()) for s in re.split(cut, text) if s and re.search(r"\w", s)]
    return out


def is_sentence(segment: str) -> bool:
    """Long enough to be a full sentence rather than a name or a short phrase."""
    return len(re.findall(r"[^\W\d_]+", segment)) >= 5 or len(re.findall(r"[぀-ヿ一-鿿]", segment)) >= 9


def _judged(shared):
    """shared: the broadcast state of the models, plain arrays that any worker can read."""

    def run(batches):
        models = Models.__new__(Models)
        models.__dict__.update(shared.value)
        for pdf in batches:
            rows = [(i, no, field, s) for i, t, d in zip(pdf["id"], pdf["title"], pdf["description"]) for no, (field, s) in enumerate(segments(t, d), 1)]
            langs, sure = models.best([plain(s) for *_, s in rows])
            out = pd.DataFrame(rows, columns=["id", "segment_no", "field", "segment"])
            yield out.assign(lang=pd.Series(langs, dtype=object), confidence=sure, sentence=[is_sentence(s) for *_, s in rows])

    return run


def agreed(spoken: dict[str, list[str]]) -> dict[str, list[str]]:
    """The sentences by the language that models see in them which weren't trained on their wording.

    A wording (a sentence without rare words, mostly names) that is used under many labels would else be learnt by heart in
    each of them: it is left out unless one label holds four fifths of it. The wordings make two halves; the models of one half
    judge the other. A sentence stays if the models agree with its label.
    """
    seen = Counter(w for texts in spoken.values() for t in texts for w in set(t.split()))
    rare = max(3, sum(map(len, spoken.values())) // 2000)
    wording = lambda t: " ".join(w if seen[w] > rare else "~" for w in t.split())
    labels: dict[str, Counter] = {}
    halves: list[dict[str, list[str]]] = [{lang: [] for lang in spoken} for _ in range(2)]
    for lang, texts in spoken.items():
        for t in texts:
            labels.setdefault(w := wording(t), Counter())[lang] += 1
            halves[zlib.crc32(w.encode()) % 2][lang].append(t)
    out: dict[str, list[str]] = {lang: [] for lang in spoken}
    for mine, other in (halves, halves[::-1]):
        models = Models(other)
        for lang, texts in mine.items():
            for t, told in zip(texts, models.best(texts)[0]):
                votes = labels[wording(t)]
                if told == lang and votes[lang] >= 0.8 * votes.total():
                    out[lang].append(t)
    return out


def trained(labelled: DataFrame, longer: DataFrame) -> Models:
    """Models of rows whose labels are mostly right: (id, title, description, lang), at most TRAIN_TEXTS a language, and
    (id, description, lang) of longer texts, at most TRAIN_DOCS a language, of up to TRAIN_TO characters each."""
    w = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    first = lambda df, most: df.filter(F.col("lang").isin(*LANGS) & (F.length("description") <= TRAIN_TO)).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)
    few = first(labelled, TRAIN_TEXTS).unionByName(first(longer, TRAIN_DOCS), allowMissingColumns=True)
    few = few.select("lang", "title", "description").orderBy("lang", "n", "description").toPandas()
    spoken: dict[str, list[str]] = {lang: [] for lang in LANGS}
    for lang, t, d in few.itertuples(index=False):
        spoken[lang] += [plain(s) for _, s in segments(t, d) if is_sentence(s)]
    kept = agreed(spoken)
    both = lambda texts: [*texts, *(b for t in texts if (b := bare(t)) != t)]
    held = [(t, x) for x, texts in kept.items() for t in texts[::10]]
    models = Models({x: both([t for i, t in enumerate(texts) if i % 10]) for x, texts in kept.items()})
    models.calibrate([t for t, _ in held], [x for _, x in held])
    return models


def languages(docs: DataFrame, models: Models) -> DataFrame:
    """id, segment_no, field, segment, lang, confidence, sentence: each segment of each document.

    docs: id, title, description. The language is that of the lowest cross-entropy per letter, null where it is too
    high for the language or the segment has no letters. Null and empty fields have no segments; rows of null id are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models.__dict__)  # bounded by the training sample
    return docs.filter("id is not null").select("id", "title", "description").mapInPandas(_judged(shared), "id long, segment_no int, field string, segment string, lang string, confidence double, sentence boolean")


def _whole(shared):
    def run(batches):
        models = Models.__new__(Models)
        models.__dict__.update(shared.value)
        for pdf in batches:
            texts = [plain(" ".join(x for x in (t, d) if isinstance(x, str))) for t, d in zip(pdf["title"], pdf["description"])]
            langs, sure = models.best(texts)
            yield pd.DataFrame({"id": pdf["id"], "letters": [len(t) for t in texts], "lang": pd.Series(langs, dtype=object), "confidence": sure})

    return run


def whole_languages(docs: DataFrame, models: Models) -> DataFrame:
    """id, letters, lang, confidence: one row for each document (id, title, description), by the cross-entropy per letter of all its text.

    lang is null where even the lowest is too high, or there are no letters. Rows of null id are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models.__dict__)  # bounded by the training sample
    return docs.filter("id is not null").select("id", "title", "description").mapInPandas(_whole(shared), "id long, letters long, lang string, confidence double")


def newest_lang(items: DataFrame) -> DataFrame:
    """id, tag: the main part of the lang of each item's newest rev, null where it names none of LANGS."""
    last = items.filter("id is not null").groupBy("id").agg(F.max(F.struct("rev", "lang")).alias("x"))
    tag = F.lower(F.regexp_extract("x.lang", r"^\s*([A-Za-z]{2})(?:[-_].*)?\s*$", 1))
    return last.select("id", F.when(tag != "", tag).alias("tag"))


def _homepages(spark, d) -> DataFrame:
    meta = table(spark, d, "homepage_meta").filter("meta_id is not null")
    tags = newest_lang(table(spark, d, "site_items")).withColumnRenamed("id", "domain")
    return meta.join(tags, "domain", "left").select(F.col("meta_id").alias("id"), "domain", "title", "description", F.col("tag").alias("lang"))


def _models(spark, d, pages: DataFrame) -> Models:
    docs = table(spark, d, "documents").filter(f"doc_id is not null and n_chars between {TRAIN_FROM} and {TRAIN_TO}")
    return trained(pages, docs.select(F.col("doc_id").alias("id"), F.col("text").alias("description"), "lang"))


def p6_languages(spark, d):
    """The language of every segment of every homepage's title and description, with its confidence."""
    pages = _homepages(spark, d)
    return languages(pages, _models(spark, d, pages)).withColumnRenamed("id", "meta_id")


def p6_homepages(spark, d):
    """The language of each homepage as a whole, with its confidence, beside the label of its site's item."""
    pages = _homepages(spark, d)
    told = whole_languages(pages, _models(spark, d, pages))
    return told.join(pages.select("id", F.col("lang").alias("label")), "id").withColumnRenamed("id", "meta_id")


def p6_found(spark, d):
    """Languages of the homepages whose label is missing or wrong, or which mix languages."""
    pages = _homepages(spark, d)
    models = _models(spark, d, pages)
    meta = table(spark, d, "homepage_meta").filter("meta_id is not null")
    spam = p5_found(spark, d).filter("src = 'homepage_meta'")
    out = homepage_residue(meta).select(F.col("rec_id").alias("id")).union(spam.select(F.col("rec_id").alias("id"))).distinct()
    asked = pages.filter(F.length("description") >= 30).join(out, "id", "left_anti")
    told = languages(asked, models).filter(F.col("sentence") & F.col("lang").isNotNull() & (F.col("confidence") >= SURE)).select("id", "lang").distinct()
    sets = told.groupBy("id").agg(F.collect_set("lang").alias("langs"))  # at most one of each language
    tagged = sets.join(asked.select("id", F.col("lang").alias("tag")), "id")
    wrong = tagged.filter((F.size("langs") > 1) | F.col("tag").isNull() | ~F.array_contains("langs", F.coalesce("tag", F.lit(""))))
    return wrong.select(F.col("id").alias("meta_id"), F.explode("langs").alias("lang"))


QUERIES = {"p6_found": p6_found, "p6_languages": p6_languages, "p6_homepages": p6_homepages}
SQL: dict[str, str] = {}
