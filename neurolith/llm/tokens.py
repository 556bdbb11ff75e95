"""Sizes of texts in tokens of a public tokenizer, from its vocabulary file."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = os.environ.get("NEUROLITH_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: the published pre-tokenization pattern of byte-level BPE with 50k merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a rank file, loaded once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str = DEFAULT_VOCABULARY) -> Column:
    """Number of tokens; null for a null text, 0 for an empty one. Strings of special tokens are ordinary text."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path)
        for s in batches:
            yield s.map(lambda t: len(enc.encode_ordinary(t)), na_action="ignore").astype("Int32")

    return count(text)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id, keep..., tokens) of the rows whose text has at least one token."""
    return docs.select(id_col, *keep, token_count(F.col(text_col), path).alias("tokens")).filter("tokens > 0")
