"""Similarities: cosine, trigrams, weighted lexemes, best matching window."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType


def cosine(a: Column, b: Column) -> Column:
    """FN43: cosine of two arrays; null where a vector is null, of another length or zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(F.size(a) == F.size(b), dot / F.nullif(norm(a) * norm(b), F.lit(0.0)))


#: A trigram inside a word that has two blanks before it and one behind.
_GRAM = r"(?=(  [^ ]| [^ ][^ ]| [^ ] |[^ ]{3}|[^ ]{2} ))"


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the words of a text, each padded by two blanks before and one after.

    One pass of a regular expression: cutting substrings at every place would take
    time in the square of the text.
    """
    padded = F.concat(F.lit("  "), F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "   ")), F.lit(" "))
    return F.array_distinct(F.regexp_extract_all(padded, F.lit(_GRAM), F.lit(1)))


def term_trigrams(term: str) -> list[str]:
    """Distinct trigrams of a term that the driver knows."""
    words = re.findall(r"[^\W_]+", term.lower())
    return list(dict.fromkeys(f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)))


def shared_share(grams: Column, term: str) -> Column:
    """Shared trigrams by all trigrams, of a text's trigrams and a term's."""
    own = term_trigrams(term)
    common = F.size(F.array_intersect(grams, F.array(*[F.lit(g) for g in own]) if own else F.array().cast("array<string>")))
    return F.coalesce(common / F.nullif((F.size(grams) + len(own) - common).cast("double"), F.lit(0.0)), F.lit(0.0))


def trigram_similarity(a: Column, b: Column) -> Column:
    """FN45: shared trigrams by all trigrams."""
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)).cast("double"), F.lit(0.0)), F.lit(0.0))


#: Words without weight in German full-text search (fixed values).
STOPWORDS = (
    "aber als am an auch auf aus bei bin bis bist da dann das dass dem den der des die dies diese dir doch du durch ein eine einem einen einer eines er es für hat hatte ich ihr im in ist ja kann "
    "man mit nach nicht noch nun nur ob oder ohne sehr sein sich sie sind so über um und uns unter vom von vor war was weil wenn wer wie wir wird wurde zu zum zur"
).split()
SUFFIX = r"(ern|em|er|en|es|e|s|n)$"


def lexemes(c: Column) -> Column:
    """Stems of the words that carry weight, in order: words of six letters lose a usual ending."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(*STOPWORDS))
    return F.transform(words, lambda w: F.when(F.length(w) >= 6, F.regexp_replace(w, SUFFIX, "")).otherwise(w))


def lexeme_rank(title: Column, body: Column, query: Column, title_weight: float = 1.0, body_weight: float = 0.4) -> Column:
    """FN44: weighted rank of a document for query lexemes; 0 where none occurs.

    The j-th occurrence of a lexeme counts by 1 / j squared, occurrences in the title
    first; the mean over the query's lexemes is taken.
    """
    series = lambda n, k: F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda s, j: s + F.when(j <= n, F.lit(1.0) / ((j + k) * (j + k))).otherwise(0.0))

    def one(q: Column) -> Column:
        a, b = (F.size(F.filter(F.coalesce(x, F.array().cast("array<string>")), lambda t: t == q)) for x in (title, body))
        return (title_weight * series(a, F.lit(0)) + body_weight * series(b, a)) / 1.64493406685

    return F.aggregate(query, F.lit(0.0), lambda s, q: s + one(q)) / F.greatest(F.size(query), F.lit(1))


def best_window(short: str, long: str) -> float:
    """Best share of common letters (in order) of a text and a window of its length in another, in percent.

    The common subsequences of all windows are counted side by side, a row of bits a
    window, one step a letter of the shorter text.
    """
    if len(short) > len(long):
        short, long = long, short
    if not short:
        return 0.0
    if short in long:
        return 100.0
    n, size = len(short), (len(short) + 63) // 64
    place = {c: i for i, c in enumerate(dict.fromkeys(short), 1)}
    masks = np.zeros((len(place) + 1, size), np.uint64)
    for i, c in enumerate(short):
        masks[place[c], i // 64] |= np.uint64(1) << np.uint64(i % 64)
    # Windows reach over both ends; what lies beyond matches nothing.
    codes = np.zeros(len(long) + 2 * (n - 1), np.int64)
    codes[n - 1 : n - 1 + len(long)] = [place.get(c, 0) for c in long]
    windows = len(long) + n - 1
    rows = np.full((size, windows), ~np.uint64(0))
    for k in range(n):
        hits = masks[codes[k : k + windows]].T
        carry = np.zeros(windows, np.uint64)
        for w in range(size):
            u = rows[w] & hits[w]
            total = rows[w] + u
            over = total < u
            total += carry
            carry = (over | (total < carry)).astype(np.uint64)
            rows[w] = total | (rows[w] & ~hits[w])
    rows[-1] |= ~(~np.uint64(0) >> np.uint64(64 * size - n))
    common = np.bitwise_count(~rows).sum(0, dtype=np.int64)
    start = np.arange(windows) - (n - 1)
    lengths = np.minimum(start + n, len(long)) - np.maximum(start, 0)
    return float((200.0 * common / (n + lengths)).max())


@F.pandas_udf(DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """FN20: ``best_window`` of two text columns; null where one is null."""
    return pd.Series([None if x is None or y is None else best_window(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
