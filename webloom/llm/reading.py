"""Reading level of documents by a familiar-word formula."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.plans.lineage import keep
from webloom.sources.tables import table

#: A familiar word is found, in small letters, in this part of all documents. If texts have 250 different words on average, there are at most 250 / FAMILIAR of them.
FAMILIAR = 0.003
#: Labelled documents to which the bands are fitted, at most (those with the smallest hashes).
FIT_ROWS = 20_000
#: Least length of a text that has a level in p10_found.
LEAST = 200

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_CODE = re.compile(r"^\s*[\w.]+\s*(?:\+|:)?=\s*\S.*$|[{};]\s*$|^\s*(?:def|import|from|return|for|if|while|class)\b.*[:(]\s*$|^\s*[\w.]+\(.*\)\s*$")
_ADDRESS = re.compile(r"(?:https?://|www\.)\S+|\S+@\S+\.\S+")
_END = re.compile(r"[.!?]+(?:[\"”')]*\s|[\"”')]*$)|\n+")

# Function words by which English is told from the other languages of the texts.
_SPEECH = {
    "en": "the of and to in is that it was for on with as he she we they you are at this by an be his her my our had have from but what all were can which through your not or when then",
    "de": "der die das und ist für mit von den dem ein eine im auf zu nicht aus seit sich werden zum zur unser",
    "fr": "le la les des et est pour dans une un du nous avec sur au qui en notre ce depuis plus à",
    "es": "el la los las de y en un una para con por del que se nuestra nuestro desde este más al",
    "it": "il la le di e per un una con del nel che dei della i lo nostro questo più dal",
    "pt": "o a os as de e um uma para com em do da no que nossa nosso este mais desde",
    "nl": "de het een van en voor met op in uit bij te dat die onze sinds niet aan meer",
    "pl": "w z i na do od dla o się nie to jest nasz nasza po u przy ponad bez za",
}
_SPEECH = {lang: frozenset(words.split()) for lang, words in _SPEECH.items()}


_SIGNS = re.compile(r"[={};(:]")


def prose(text: str) -> str:
    """The text without addresses and lines of code."""
    if "://" in text or "@" in text or "www." in text:
        text = _ADDRESS.sub(" ", text)
    if not _SIGNS.search(text):  # no line of code is without one of them
        return text
    return "\n".join(x for x in text.split("\n") if not (_SIGNS.search(x) and _CODE.search(x)))


def is_english(counts: Counter, n: int) -> bool:
    """Whether English function words lead; a text with next to none in any language is taken as English if its letters are Latin. counts: of n words in small letters."""
    if not n:
        return False
    share = {lang: sum(counts[w] for w in known) / n for lang, known in _SPEECH.items()}
    other = max(v for lang, v in share.items() if lang != "en")
    if share["en"] < other or share["en"] < 0.03 <= other:
        return False
    return sum(c for w, c in counts.items() for x in w if x.isascii()) > 0.9 * sum(len(w) * c for w, c in counts.items())


def measures(text: str, familiar: frozenset) -> tuple[float, float, bool]:
    """Share of words outside the familiar list (names left out), words per sentence, and whether it's English.

    Sentences end at their marks and at lines; where marks are missing, a familiar word with a capital starts a new one.
    """
    kinds: Counter = Counter()
    marked = extra = total = 0
    for piece in _END.split(prose(text)):
        words = _WORD.findall(piece)
        if not words:
            continue
        marked += 1
        total += len(words)
        kinds.update(words)
        for i, w in enumerate(words):
            if w[0].isupper() and i and len(w) > 1 and not words[i - 1][0].isupper() and w.lower() in familiar and "'" not in w and "’" not in w:
                extra += 1
    low: Counter = Counter()
    for w, c in kinds.items():
        low[w.lower()] += c
    shouted = sum(c for w, c in kinds.items() if w[0].isupper()) > 0.5 * total
    n = unknown = 0
    for w, c in kinds.items():
        if w.lower().replace("’", "'") in familiar:
            n += c
        elif w[0].islower() or shouted:
            n += c
            unknown += c
    return unknown / max(n, 1), total / max(marked if shouted else marked + extra, 1), is_english(low, total)


def _document_counts(batches):
    counts: Counter = Counter()  # as large as the words of one partition
    for pdf in batches:
        for text in pdf["text"]:
            counts.update({w for w in _WORD.findall(prose(text)) if w[0].islower()})
    words = list(counts)
    for lo in range(0, len(words), 50_000):
        yield pd.DataFrame({"word": [w.replace("’", "'").lower() for w in words[lo : lo + 50_000]], "n": [counts[w] for w in words[lo : lo + 50_000]]})


def familiar_words(docs: DataFrame) -> frozenset:
    """The words found in FAMILIAR of all documents (at least 3), in small letters; all of them, since their number is bounded by FAMILIAR."""
    texts = docs.filter("text is not null").select("text")
    counts = texts.mapInPandas(_document_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    least = max(3.0, FAMILIAR * texts.count())
    return frozenset(r.word for r in counts.filter(F.col("n") >= least).select("word").collect())


def _measured(familiar):
    def run(batches):
        known = familiar.value
        for pdf in batches:
            rows = [measures(t, known) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "chars": pdf["text"].str.len(), "unfamiliar": [r[0] for r in rows], "sentence": [r[1] for r in rows], "english": [r[2] for r in rows]})

    return run


def _inputs(unfamiliar: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(sentence)), unfamiliar, np.sqrt(unfamiliar), np.log(np.maximum(sentence, 1))], axis=1)


def fitted(labels: pd.DataFrame) -> list[list[float]]:
    """For each border between bands, the weights of the chance that a text lies beyond it (logistic, by Newton's method)."""
    x, out = _inputs(labels["unfamiliar"].to_numpy(float), labels["sentence"].to_numpy(float)), []
    for border in (1, 2, 3, 4):
        y, w = (labels["band"].to_numpy() > border).astype(float), np.zeros(x.shape[1])
        loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + 5e-4 * w @ w  # noqa: E731, B023
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w)), x.T @ (p - y) + 1e-3 * w)
            size = 1.0
            while size > 1e-4 and loss(w - size * step) > loss(w):
                size /= 2
            w = w - size * step
            if np.abs(size * step).max() < 1e-6:
                break
        out.append([float(v) for v in w])
    return out


def reading_levels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, chars, unfamiliar, sentence, english, band (1 easiest to 5): the reading level of each document.

    docs: doc_id, text; labels: doc_id, band, for some English documents. unfamiliar is the share of words outside the high-frequency
    list of these documents, sentence the mean words of a sentence; the formula that makes bands of them is fitted to the labels.
    Where no label is there, band is null. Documents of null id or text are left out; an empty text has unfamiliar and
    sentence 0 and is not English. Text that isn't English gets a band too, which means little.
    """
    spark = docs.sparkSession
    familiar = spark.sparkContext.broadcast(familiar_words(docs))  # bounded by FAMILIAR, whatever the documents
    values = keep(docs.filter("doc_id is not null and text is not null").select("doc_id", "text").mapInPandas(_measured(familiar), "doc_id long, chars long, unfamiliar double, sentence double, english boolean"))
    sample = values.join(labels.filter("band between 1 and 5").select("doc_id", "band"), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "band").limit(FIT_ROWS).toPandas()
    if sample.empty:
        return values.withColumn("band", F.lit(None).cast("long"))
    band = F.lit(1).cast("long")
    for a, b, c, e in fitted(sample):
        z = F.lit(a) + F.lit(b) * F.col("unfamiliar") + F.lit(c) * F.sqrt("unfamiliar") + F.lit(e) * F.log(F.greatest("sentence", F.lit(1.0)))
        band = band + F.when(z > 0, 1).otherwise(0)
    return values.withColumn("band", band)


def p10_levels(spark, d):
    """The level of every document."""
    return reading_levels(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "reading_labels"))


def p10_found(spark, d):
    """English documents of at least LEAST characters in the easiest and the hardest band."""
    levels = p10_levels(spark, d).filter(F.col("english") & (F.col("chars") >= LEAST) & F.col("band").isin(1, 5))
    return levels.select("doc_id", "band").distinct()


QUERIES = {"p10_found": p10_found, "p10_levels": p10_levels}
SQL: dict[str, str] = {}
