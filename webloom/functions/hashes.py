"""Hashes that are the same on every machine, as columns and in SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Start and factor of FNV-1a, and the factors of the two final mixes.
FNV_START, FNV_FACTOR = 0xCBF29CE484222325, 0x100000001B3
SPLITMIX = (30, 0xBF58476D1CE4E5B9, 27, 0x94D049BB133111EB, 31)
MURMUR = (33, 0xFF51AFD7ED558CCD, 33, 0xC4CEB9FE1A85EC53, 33)
#: Buckets of keys, and what their hashes start with.
BUCKETS, BUCKET_SALT = 16_384, "webloom-bucket-v1"


def fnv(texts: pd.Series) -> np.ndarray:
    """FNV-1a of each text's bytes, one byte of all texts at a time; nulls hash as empty."""
    raw = [t.encode() if isinstance(t, str) else b"" for t in texts]
    h = np.full(len(raw), FNV_START, dtype=np.uint64)
    length = np.array([len(r) for r in raw])
    order = np.argsort(-length, kind="stable")
    live = len(raw) - np.searchsorted(np.sort(length), np.arange(length.max(initial=0)), side="right")
    with np.errstate(over="ignore"):
        for i, n in enumerate(live):
            rows = order[:n]
            h[rows] = (h[rows] ^ np.fromiter((raw[r][i] for r in rows), dtype=np.uint64, count=n)) * np.uint64(FNV_FACTOR)
    return h


def mixed(h: np.ndarray, by: tuple[int, int, int, int, int]) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(by[0]))) * np.uint64(by[1])
        h = (h ^ (h >> np.uint64(by[2]))) * np.uint64(by[3])
        return h ^ (h >> np.uint64(by[4]))


@F.pandas_udf(LongType())
def hash64(texts: pd.Series) -> pd.Series:
    """FNV-1a with the splitmix64 finish, as a signed number."""
    return pd.Series(mixed(fnv(texts), SPLITMIX).view(np.int64)).where(texts.notna().to_numpy())


@F.pandas_udf(LongType())
def half_hash(texts: pd.Series) -> pd.Series:
    """FNV-1a with the Murmur finish."""
    return pd.Series(mixed(fnv(texts), MURMUR).view(np.int64)).where(texts.notna().to_numpy())


def prefix_mod(text: Column, n: int) -> Column:
    """The first 8 bytes of a text's SHA-256, as a number, modulo n."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(n)


def bucket_of(key: Column) -> Column:
    return prefix_mod(F.concat(F.lit(BUCKET_SALT + "\0"), key), BUCKETS).cast("int")


def experiment_bucket(layer: Column, unit: Column, n: int = 1000) -> Column:
    """The first 8 bytes of a SHA-256 read from the last to the first, modulo n."""
    h = F.sha2(F.concat(layer, F.lit("\0"), unit), 256)
    turned = F.concat(*[F.substring(h, i, 2) for i in range(15, 0, -2)])
    return (F.conv(turned, 16, 10).cast("decimal(20,0)") % F.lit(n)).cast("int")


def fnv_sql(text: str) -> str:
    return f"list_reduce(list_prepend({FNV_START}::UHUGEINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::UHUGEINT)), lambda h, c: (xor(h::UBIGINT, c::UBIGINT)::UHUGEINT * {FNV_FACTOR}::UHUGEINT) % 18446744073709551616::UHUGEINT)"


def mixed_sql(h: str, by: tuple[int, int, int, int, int]) -> str:
    for shift, factor in ((by[0], by[1]), (by[2], by[3])):
        h = f"((xor(({h})::UBIGINT, (({h})::UBIGINT >> {shift}))::UHUGEINT * {factor}::UHUGEINT) % 18446744073709551616::UHUGEINT)"
    return f"xor(({h})::UBIGINT, (({h})::UBIGINT >> {by[4]}))"


def prefix_mod_sql(text: str, n: int) -> str:
    return f"(('0x' || sha256({text})[1:16])::UBIGINT % {n})::INT"
