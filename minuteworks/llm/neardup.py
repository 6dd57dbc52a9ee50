"""Problem 1: near-duplicate texts by banded set sketches, joint likelihood and verification.

A text is the set of its runs of ``k`` words. Its sketch holds, per register, the
exponentially spaced truncated minimum of the set: the smallest of exponentially
distributed hash values, as the truncated logarithm to a base close to 1. Sketches
merge by the larger register, and equal registers are as likely as the Jaccard
similarity. Bands of registers propose pairs, the likelihood of how the registers of
a pair compare rules out those below the threshold, the rest is counted exactly.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from minuteworks.session import bucketed, cut

WORD = re.compile(r"[^\W_]+")
BASE, RATE, LAST = 1.001, 20.0, (1 << 16) - 2


def shingles(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes of the runs of ``k`` words of every text, with the text's place."""
    vocabulary: dict[str, int] = {}
    flat: list[int] = []
    lengths = np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        words = WORD.findall(t.lower())
        lengths[i] = len(words)
        flat += [vocabulary.setdefault(w, len(vocabulary)) for w in words]
    coded = np.frombuffer(b"".join(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest() for w in vocabulary), np.uint64)
    h, owner = coded[np.array(flat, np.int64)] if flat else np.empty(0, np.uint64), np.repeat(np.arange(len(texts)), lengths)
    n = max(0, len(h) - k + 1)
    mixed = np.zeros(n, np.uint64)
    for i in range(k):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[i : n + i]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    inside = owner[:n] == owner[k - 1 :] if n else np.empty(0, bool)
    mixed, owner = mixed[inside], owner[:n][inside]
    order = np.lexsort((mixed, owner))
    mixed, owner = mixed[order], owner[order]
    new = np.r_[True, (mixed[1:] != mixed[:-1]) | (owner[1:] != owner[:-1])] if len(mixed) else np.empty(0, bool)
    return mixed[new], owner[new]


def sketch(elements: np.ndarray, starts: np.ndarray, registers: int) -> np.ndarray:
    """Registers (int16) of the sets that begin at ``starts`` in ``elements``."""
    out = np.empty((len(starts), registers), np.int16)
    x = (elements ^ (elements >> np.uint64(32))).astype(np.uint32)
    seeds = np.random.default_rng(5).integers(1, 1 << 32, size=(registers, 2), dtype=np.uint32) | np.uint32(1)
    for j in range(registers):
        v = (x ^ seeds[j, 0]) * seeds[j, 1]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x85EBCA6B)
        v ^= v >> np.uint32(13)
        least = np.minimum.reduceat(v, starts)
        value = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
        out[:, j] = (np.clip(np.floor(1 - np.log(value) / math.log(BASE)), 0, LAST + 1) - (1 << 15)).astype(np.int16)
    return out


def log_likelihood(j: np.ndarray, more: np.ndarray, less: np.ndarray, same: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Joint log likelihood of similarity ``j`` for registers larger, smaller and equal; u, v: relative sizes."""
    def p(x: np.ndarray) -> np.ndarray:
        return np.maximum(-np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / math.log(BASE), 1e-12)

    a, b = p(u - v * j), p(v - u * j)
    return more * np.log(a) + less * np.log(b) + same * np.log(np.maximum(1 - a - b, 1e-12))


def estimate(more: np.ndarray, less: np.ndarray, same: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity of greatest likelihood, by ternary search (the likelihood is unimodal)."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(24):
        x, y = low + (high - low) / 3, high - (high - low) / 3
        up = log_likelihood(x, more, less, same, u, v) < log_likelihood(y, more, less, same, u, v)
        low, high = np.where(up, x, low), np.where(up, high, y)
    return (low + high) / 2


class NearDuplicates:
    """``members``: id, doc, cls (texts of the same words share a class); ``pairs``: cls_a < cls_b, common, total."""

    def __init__(self, members: DataFrame, pairs: DataFrame):
        self.members, self.pairs = members, pairs

    def row_pairs(self) -> DataFrame:
        """All pairs of rows with different ``doc``: ``id_a < id_b``. Rows without ``doc`` have none."""
        m = self.members
        several = m.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select(F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b"))
        linked = self.pairs.select("cls_a", "cls_b").unionByName(several)
        a, b = (m.select(F.col("cls").alias(f"cls_{x}"), F.col("id").alias(f"{x}_id"), F.col("doc").alias(f"{x}_doc")) for x in "ab")
        found = linked.join(a, "cls_a").join(b, "cls_b").where((F.col("a_doc") != F.col("b_doc")) & ((F.col("cls_a") != F.col("cls_b")) | (F.col("a_id") < F.col("b_id"))))
        return found.select(F.least("a_id", "b_id").alias("id_a"), F.greatest("a_id", "b_id").alias("id_b"))

    def groups(self) -> DataFrame:
        """``id, cls, group_id, n_links``: the connected group of every row, and its class's links to other classes."""
        pairs = cut(self.pairs.select("cls_a", "cls_b"))  # few, read several times
        links = pairs.unionByName(pairs.select(F.col("cls_b").alias("cls_a"), F.col("cls_a").alias("cls_b")))
        degree = links.groupBy("cls_a").agg(F.count("*").cast("int").alias("n_links")).withColumnRenamed("cls_a", "cls")
        parts = components(pairs.select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")))
        return (
            self.members.select("id", "cls").join(parts.withColumnRenamed("node", "cls"), "cls", "left").join(degree, "cls", "left")
            .select("id", "cls", F.coalesce("root", "cls").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
        )


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``node, root`` of the graph of edges ``a, b``: large-star and small-star rounds, all distributed.

    Each round is written to the shared checkpoint folder; the number of rounds grows
    with the logarithm of the longest path. Edges from a node to a smaller neighbour
    are aggregated before they are shuffled.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(down.select("a", F.col("m").alias("b")))
        e = cut(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node").unionByName(roots.join(e.select(F.col("a").alias("node")), "node", "left_anti"))


def near_duplicates(
    df: DataFrame,
    id_col: str,
    text_col: str,
    doc_col: str,
    k: int = 5,
    threshold: tuple[int, int] = (4, 5),
    min_chars: int = 1,
    rows: int = 6,
    bands: int = 36,
    stride: int = 4,
    sigma: float = 5.0,
    low_sigma: float = 3.5,
    hot: int = 200,
    hot_miss: float = 0.1,
) -> NearDuplicates:
    """Texts of at least ``min_chars`` characters whose word runs have Jaccard similarity ``threshold`` or more.

    Words are lower-cased runs of letters and digits, a set holds the distinct runs of
    ``k`` of them; ``threshold`` is a fraction (numerator, denominator). Null texts and
    texts of fewer than ``k`` words take no part; an empty table gives empty results;
    other columns are ignored. Texts of the same words in the same order are one class:
    only classes are compared, whatever the number of copies. Runs are compared by
    32-bit hashes within a pair, texts by 64-bit hashes of their words.

    Band i is made of ``rows`` registers from ``i * stride`` on. A pair of similarity s
    is missed with a chance of about (1 - s^rows)^bands. Bands that more than ``hot``
    classes share are common phrases, whose pairs would grow with the square of the
    collection: there, four further registers must agree as well, in one of as many
    tries as keep the chance to miss a pair at the threshold in one such band at
    ``hot_miss``; were all bands hot, (1 - s^rows * (1 - hot_miss))^bands. A band travels with the
    lowest bits of up to 128 registers, which already rule out most chance matches
    (those more than ``low_sigma`` deviations below the threshold);
    pairs go on whose likelihood at the threshold is within ``sigma`` standard
    deviations of the greatest. Sketches and sets are written once, bucketed by
    class, and are not shuffled again.
    """
    if bands > 256:
        raise ValueError("at most 256 bands")
    registers = stride * (bands - 1) + rows
    checked = min(128, registers)
    up, down = threshold
    t = up / down

    def sign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            # Copies within a batch are signed once.
            p = p.drop_duplicates("cls")
            for at in range(0, len(p), 2000):
                b = p.iloc[at : at + 2000]
                elements, owner = shingles(b["text"].tolist(), k)
                if not len(owner):
                    continue
                starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                ends = np.r_[starts[1:], len(owner)]
                regs = sketch(elements, starts, registers)
                low = np.zeros((len(regs), 16), np.uint8)
                packed = np.packbits((regs[:, :checked] & 1).astype(bool), axis=1)
                low[:, : packed.shape[1]] = packed
                low = low.view(np.int64)
                # 32 bits are enough to compare two sets.
                short = (elements >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield pd.DataFrame({"cls": b["cls"].to_numpy()[owner[starts]], "n": (ends - starts).astype(np.int32), "low_0": low[:, 0], "low_1": low[:, 1], "regs": list(regs), "els": [np.unique(short[i:j]) for i, j in zip(starts, ends, strict=True)]})

    words = F.array_join(F.regexp_extract_all(F.lower(text_col), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")
    source = df.where(F.length(text_col) >= min_chars).select(F.col(id_col).cast("long").alias("id"), F.col(doc_col).cast("long").alias("doc"), F.xxhash64(words).alias("cls"), F.col(text_col).alias("text"))
    members = source.select("id", "doc", "cls")
    signed = source.select("cls", "text").mapInPandas(sign, "cls long, n int, low_0 long, low_1 long, regs array<short>, els array<int>")
    buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), source.count() // 50_000)
    classes = bucketed(signed, "cls", buckets, distinct=True)
    # The lowest eight bits of a key are the band's number: no column beside it, so that all uses share one shuffle.
    hashes = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.shiftleft(F.xxhash64(F.slice("regs", i * stride + 1, rows)), 8).bitwiseOR(i.cast("long")))
    apart = (F.col("n_a") * down >= F.col("n_b") * up) & (F.col("n_b") * down >= F.col("n_a") * up)
    # Equal registers have equal low bits, others half of the time.
    equal = (1 + t) / 2
    most = checked - math.floor(equal * checked - low_sigma * math.sqrt(checked * equal * (1 - equal)))
    differ = F.bit_count(F.col("low_0_a").bitwiseXOR(F.col("low_0_b"))) + F.bit_count(F.col("low_1_a").bitwiseXOR(F.col("low_1_b")))

    def matches(keyed: DataFrame) -> DataFrame:
        """Pairs of classes with an equal key that sizes and low bits don't rule out."""
        a, b = (keyed.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("cls", "n", "low_0", "low_1")]) for x in "ab")
        return a.join(b, "key").where((F.col("cls_a") < F.col("cls_b")) & apart & (differ <= most)).select("cls_a", "cls_b", "n_a", "n_b")

    # The count and the join need one shuffle of the bands.
    banded = classes.select("cls", "n", "low_0", "low_1", F.explode(hashes).alias("key")).withColumn("held", F.count("*").over(Window.partitionBy("key")))
    proposed = matches(banded.where(F.col("held") <= hot))
    longer, tries = 4, max(1, math.ceil(math.log(hot_miss) / math.log1p(-(t**4))))
    if registers > rows + longer * (tries + 1):
        # Bands of many classes are common phrases: they must agree in more registers as well.
        wide = banded.where(F.col("held") > hot).select("cls", "key").join(classes.select("cls", "n", "low_0", "low_1", "regs"), "cls")
        begin = (F.col("key").bitwiseAND(255) * stride + rows + F.col("try") * longer) % (registers - longer) + 1
        wide = wide.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1)))).withColumn("key", F.xxhash64("key", "try", F.slice("regs", begin.cast("int"), longer)))
        proposed = proposed.unionByName(matches(wide))
    else:
        proposed = proposed.unionByName(matches(banded.where(F.col("held") > hot)))
    proposed = proposed.distinct()

    @F.pandas_udf("boolean")
    def likely(regs_a: pd.Series, regs_b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
        if not len(n_a):
            return pd.Series([], dtype=bool)
        x, y = np.stack(regs_a.to_numpy()), np.stack(regs_b.to_numpy())
        more, less = (x > y).sum(1), (x < y).sum(1)
        same = registers - more - less
        na, nb = n_a.to_numpy(float), n_b.to_numpy(float)
        best = estimate(more, less, same, na, nb)
        u, v = na / (na + nb), nb / (na + nb)
        at = np.minimum(t, np.minimum(u / v, v / u))
        loss = log_likelihood(best, more, less, same, u, v) - log_likelihood(at, more, less, same, u, v)
        return pd.Series((best >= t) | (loss <= sigma**2 / 2))

    def side(x: str, column: str) -> DataFrame:
        return classes.select(F.col("cls").alias(f"cls_{x}"), F.col(column).alias(f"{column}_{x}"))

    # Sketches first; the sets travel only with the pairs that are left.
    left = proposed.join(side("a", "regs"), "cls_a").join(side("b", "regs"), "cls_b").where(likely("regs_a", "regs_b", "n_a", "n_b")).select("cls_a", "cls_b")
    common: Column = F.size(F.array_intersect("els_a", "els_b"))
    counted = left.join(side("a", "els"), "cls_a").join(side("b", "els"), "cls_b").select("cls_a", "cls_b", common.alias("common"), (F.size("els_a") + F.size("els_b") - common).alias("total"))
    return NearDuplicates(members, counted.where(F.col("common") * down >= F.col("total") * up))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
