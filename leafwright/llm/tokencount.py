"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder and name of the vocabulary; ranks as tiktoken reads them.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Fixed value: the splitting pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(folder: str, vocabulary: str):
    import tiktoken

    with open(f"{folder}/{vocabulary}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: Column, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of each text; 0 for null and empty ones. Special tokens' strings count as ordinary text."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoding(folder, vocabulary)
        for batch in batches:
            yield pd.Series([len(own.encode_ordinary(t)) if t else 0 for t in batch], dtype="int64")

    return F.pandas_udf(count, T.LongType())(text)
