"""Text identity as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Letters and their marks as one sign where there is one; asked only of texts with marks (see composed)."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t) if isinstance(t, str) else None)


def composed(df: DataFrame, *columns: str) -> DataFrame:
    """df with the texts of columns in NFC: one Arrow pass, in which texts without marks go as they are."""
    marked = lambda c: F.when(F.regexp_like(c, F.lit(r"\p{M}")), F.col(c))
    return df.withColumns({c: F.coalesce(nfc(marked(c)), F.col(c)) for c in columns})


def words(text: Column) -> Column:
    """Lower-case words: apostrophes vanish, any other sign separates, and runs of single letters become one word. Null gives null."""
    plain = F.regexp_replace(F.lower(text), r"['’ʼ\p{M}]", "")
    raw = F.filter(F.split(F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " ")), " "), lambda w: w != "")
    # a word of one letter carries a mark that lets the next one join it
    step = lambda a, w: F.when(F.length(w) > 1, F.concat(a, F.lit(" "), w)).when(F.endswith(a, F.lit("\x01")), F.concat(F.rtrim(a, F.lit("\x01")), w, F.lit("\x01"))).otherwise(F.concat(a, F.lit(" "), w, F.lit("\x01")))
    joined = F.aggregate(raw, F.lit("").cast("string"), step)
    return F.filter(F.split(F.trim(F.replace(joined, F.lit("\x01"), F.lit(""))), " "), lambda w: w != "")


def normalize(text: Column) -> Column:
    """The words with one blank between."""
    return F.array_join(words(text), " ")


def joined(text: Column) -> Column:
    """The words without blanks: the key by which names are compared."""
    return F.array_join(words(text), "")


#: The same in SQL, for the tests of queries: text is a column expression.
def words_sql(text: str) -> str:
    plain = f"trim(regexp_replace(regexp_replace(lower({text}), '[''’ʼ\\p{{M}}]', '', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    step = "lambda a, w: CASE WHEN length(w) > 1 THEN a || ' ' || w WHEN suffix(a, chr(1)) THEN a[:-2] || w || chr(1) ELSE a || ' ' || w || chr(1) END"
    return f"CASE WHEN {text} IS NOT NULL THEN list_filter(string_split(trim(replace(list_reduce(list_prepend('', list_filter(string_split({plain}, ' '), lambda w: w <> '')), {step}), chr(1), '')), ' '), lambda w: w <> '') END"
