"""Providers of what needs a remote service, with offline defaults of fixed results."""

from __future__ import annotations

import hashlib
import math
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F


class Embedder(Protocol):
    """Vectors of texts."""

    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Chat(Protocol):
    """An answer to a prompt."""

    def complete(self, system: str, prompt: str, max_tokens: int) -> str: ...


class TooLong(Exception):
    """A service refuses a text for its length; services may raise their own error that says so."""


#: How services word that a text is beyond their limit (fixed values).
LIMIT = re.compile(r"too (?:long|large|many tokens)|token limit|max(?:imum)? (?:tokens|length|context)|context length", re.I)


def is_limit(error: Exception) -> bool:
    """Whether an error is about a text's length, and not about the network or the service."""
    return isinstance(error, TooLong) or bool(LIMIT.search(str(error)))


class HashedTrigrams:
    """Offline embedder: hashed letter trigrams, of unit length."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dim
            padded = f"  {text.lower()} "
            for i in range(len(padded) - 2):
                h = int.from_bytes(hashlib.blake2b(padded[i : i + 3].encode(), digest_size=8).digest(), "little")
                v[h % self.dim] += 1.0 if h >> 40 & 1 else -1.0
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out


class Extractive:
    """Offline chat: gives back the beginning of the prompt's context."""

    def complete(self, system: str, prompt: str, max_tokens: int) -> str:
        return " ".join(prompt.split()[:max_tokens])


def embed_texts(df: DataFrame, id_col: str, text_col: str, make: Callable[[], Embedder], batch: int = 16, attempts: int = 10, wait: float = 10.0, least_chars: int = 20) -> DataFrame:
    """CP22: ``id, embedding, error``: texts of at least ``least_chars`` in batches of ``batch``.

    A failing batch is tried again with growing pauses, unless a text of it is too long;
    then its texts one by one. Only a text that the service calls too long is cut in
    half, until it fits; after any other error it is tried again, ``attempts`` times in
    all. A text that fails for good has a null vector and its error.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service = make()

        def one(text: str) -> tuple[list[float] | None, str | None]:
            error, left = None, attempts
            while text and left:
                try:
                    return service.embed([text])[0], None
                except Exception as e:  # noqa: BLE001
                    error = str(e)
                    if is_limit(e):
                        text = text[: len(text) // 2]
                        continue
                    left -= 1
                    if left:
                        time.sleep(wait * (attempts - left))
            return None, error

        for p in parts:
            for at in range(0, len(p), batch):
                b = p.iloc[at : at + batch]
                vectors = None
                for n in range(attempts):
                    try:
                        vectors = [(v, None) for v in service.embed(b["text"].tolist())]
                        break
                    except Exception as e:  # noqa: BLE001
                        if is_limit(e):
                            break
                        if n + 1 < attempts:
                            time.sleep(wait * (n + 1))
                vectors = vectors or [one(t) for t in b["text"]]
                yield pd.DataFrame({"id": b["id"].to_numpy(), "embedding": [v for v, _ in vectors], "error": [e for _, e in vectors]})

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length(F.trim(F.coalesce("text", F.lit("")))) >= least_chars)
    return rows.mapInPandas(run, f"id {df.schema[id_col].dataType.simpleString()}, embedding array<float>, error string")
