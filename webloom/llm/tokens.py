"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
import sys

import pandas as pd
from pyspark.sql import DataFrame

#: Vocabulary file of a byte-level tokenizer, as ranks; each executor needs it at this path.
VOCABULARY = os.environ.get("WEBLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the pattern by which that tokenizer cuts text before merging bytes.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoding(path: str):
    """The tokenizer, read once by each Python process."""
    import tiktoken

    held = sys.__dict__.setdefault("_webloom_encodings", {})
    if path not in held:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        held[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return held[path]


def _counted(path: str, columns: list[str]):
    def run(batches):
        encode = encoding(path).encode_ordinary
        for pdf in batches:
            out = pdf[columns].copy()
            out["tokens"] = pd.Series([len(encode(t)) if isinstance(t, str) else 0 for t in pdf["text"]], dtype="int64", index=pdf.index)
            yield out

    return run


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """docs with column tokens in place of text: the number of tokens of the whole text, 0 for a null."""
    kept = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["tokens long"])
    return docs.mapInPandas(_counted(path, [f.name for f in kept]), schema)
