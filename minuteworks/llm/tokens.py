"""Token counts with the files of public tokenizers (never trained, never copied here)."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import LongType

#: Folder and file of the tokenizer; both are parameters of every operator that counts tokens.
TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER_FILE = "byte_bpe_multi_50k.tiktoken"
#: Split pattern of that byte-level BPE (fixed value of the public tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a file, once per Python worker."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: Column, tokenizer_dir: str = TOKENIZER_DIR, tokenizer_file: str = TOKENIZER_FILE) -> Column:
    """Tokens of a text column; null counts as 0, whole texts are counted."""
    path = f"{tokenizer_dir}/{tokenizer_file}"

    @F.pandas_udf(LongType())
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = encoding(path)
        for part in parts:
            yield pd.Series([len(tokenizer.encode_ordinary(t)) if t else 0 for t in part], dtype="int64")

    return count(text)
