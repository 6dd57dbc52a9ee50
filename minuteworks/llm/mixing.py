"""Problem 9: mix sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from minuteworks.llm.tokens import TOKENIZER_DIR, TOKENIZER_FILE, n_tokens
from minuteworks.session import cut

#: Fraction of the golden ratio: slot i of the schedule lies at frac(i * GOLDEN).
GOLDEN = 0.6180339887498949


def fill_shares(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: int) -> dict[str, float]:
    """Share of ``total`` that each source gets: its target, or all its repeats give.

    What the short sources lack goes to the others in proportion to their targets,
    again and again until none overflows. With every source used up the shares stay
    below 1 and the mixture below ``total``.
    """
    most = {s: sizes.get(s, 0) * max(0, r) / total if total else 0.0 for s, (_, r) in targets.items()}
    got, free, left = {s: 0.0 for s in targets}, {s: w for s, (w, _) in targets.items() if w > 0}, 1.0
    while free and left > 1e-12:
        weight = sum(free.values())
        full = [s for s, w in free.items() if most[s] <= left * w / weight + 1e-15]
        if not full:
            got |= {s: left * w / weight for s, w in free.items()}
            break
        for s in full:
            got[s] = most[s]
            del free[s]
        left = 1.0 - sum(got.values())
    return got


class Mixture:
    """``schedule``: what is used where; ``report``: target and actual shares by source."""

    def __init__(self, schedule: DataFrame, report: DataFrame):
        self.schedule, self.report = schedule, report


def mix(
    df: DataFrame,
    targets: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block_tokens: int = 512,
    max_sources: int = 10_000,
    tokenizer_dir: str = TOKENIZER_DIR,
    tokenizer_file: str = TOKENIZER_FILE,
) -> Mixture:
    """A mixture as large in tokens as ``df``, each source with its share of ``targets``.

    ``targets`` has ``source, target_share, max_repeats``; shares are taken relative
    to their sum; null or repeated sources, and null or negative shares, count as
    absent (of repeated ones the largest share stands). Documents of sources without
    a target, or of null source, count in the total but are not used. No document is
    used more often than its source's ``max_repeats``. Null and empty texts have 0
    tokens and are used like others.

    The documents of a source are shuffled by a hash of id and text and cut into blocks of about
    ``block_tokens`` (a document belongs to the block in which it begins). Slot i of
    the mixture lies at frac(i * golden ratio), which falls into one source's part
    of the cumulated weights; the r-th slot of a source takes its r-th block, from
    the first again after the last. ``schedule`` has ``id, source, slot, position,
    repeat, n_tokens`` (position: the order within the slot), ``report`` has ``source,
    target_share, max_repeats, available_tokens, used_tokens, actual_share, reachable``.

    Running sums are taken in two steps, by buckets of bounded size, and slots are
    ranked the same way: no window holds a whole source. Totals by source go to the
    driver, at most ``max_sources`` of them.
    """
    spark = df.sparkSession
    wanted = (
        targets.select(F.col("source").cast("string").alias("source"), F.col("target_share").cast("double").alias("target_share"), F.coalesce(F.col("max_repeats").cast("int"), F.lit(1)).alias("max_repeats"))
        .where(F.col("source").isNotNull() & (F.col("target_share") >= 0) & ~F.isnan("target_share"))
        .groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("x")).select("source", "x.*")
    )
    limited = wanted.limit(max_sources + 1).collect()
    if len(limited) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    weight = sum(r["target_share"] for r in limited) or 1.0
    goal = {r["source"]: (r["target_share"] / weight, r["max_repeats"]) for r in limited}
    docs = cut(df.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        n_tokens(F.col(text_col), tokenizer_dir, tokenizer_file).alias("n"),
        F.xxhash64(F.col(id_col), F.col(text_col), F.lit(11)).alias("order"),
    ))
    known = docs.join(F.broadcast(wanted.select("source")), "source") if goal else docs.limit(0)
    sums = {r["source"]: (r["n"], r["rows"]) for r in known.groupBy("source").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()}
    sizes = {s: n for s, (n, _) in sums.items()}
    total = docs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    shares = fill_shares(sizes, goal, total)
    block = block_tokens

    # Blocks: the running sum within a source, over buckets of the hash order.
    rows = sum(r for _, r in sums.values())
    buckets = max(1, rows // 20_000)
    bucket = F.floor((F.col("order") / F.lit(2.0**64) + 0.5) * buckets).cast("int")
    placed = known.withColumn("bucket", F.least(bucket, F.lit(buckets - 1)))
    per = placed.groupBy("source", "bucket").agg(F.sum("n").alias("t"))
    # One row per source and bucket of 20,000 documents.
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("source", "bucket", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("source", "bucket").orderBy("order", "id")
    placed = placed.join(base, ["source", "bucket"]).withColumn("begin", F.col("base") + F.coalesce(F.sum("n").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.withColumn("block", F.floor(F.col("begin") / block)).withColumn("position", F.row_number().over(Window.partitionBy("source", "block").orderBy("begin", "order", "id")))

    # Schedule: slots at golden-ratio points, ranked per source over chunks of slots.
    used = {s: share for s, share in shares.items() if share > 0 and sizes.get(s)}
    mass = sum(used.values())
    slots = round(total * mass / block) if total else 0
    if total and used and not slots:
        slots = 1
    edges, at = [], 0.0
    for s in sorted(used):
        edges.append((s, at, at + used[s] / mass))
        at += used[s] / mass
    edges = [(s, a, 2.0 if i + 1 == len(edges) else b) for i, (s, a, b) in enumerate(edges)]
    parts = spark.createDataFrame([(i, s, -(-sizes[s] // block), int(goal[s][1])) for i, (s, _, _) in enumerate(edges)], "part int, source string, blocks long, max_repeats int")
    chunk = 10_000
    points = spark.range(slots).select(F.col("id").alias("slot"), F.floor(F.col("id") / chunk).alias("chunk"), ((F.col("id") * GOLDEN) % 1.0).alias("x"))
    bounds = np.array([a for _, a, _ in edges[1:]])

    @F.pandas_udf("int")
    def part_of(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, x.to_numpy(), side="right").astype(np.int32))

    owned = points.withColumn("part", part_of("x")).join(F.broadcast(parts), "part").drop("part")
    counts = owned.groupBy("source", "chunk").agg(F.count("*").alias("c"))
    offsets = counts.select("source", "chunk", F.coalesce(F.sum("c").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("skip"))
    ranked = owned.withColumn("r", F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1).join(offsets, ["source", "chunk"]).withColumn("r", F.col("r") + F.col("skip"))
    ranked = ranked.select("source", "slot", (F.col("r") % F.col("blocks")).alias("block"), (F.floor(F.col("r") / F.col("blocks")) + 1).cast("int").alias("repeat"), "max_repeats").where(F.col("repeat") <= F.col("max_repeats"))
    schedule = cut(ranked.join(placed, ["source", "block"]).select("id", "source", "slot", "position", "repeat", F.col("n").alias("n_tokens")))

    done = schedule.groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"))
    everything = schedule.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0
    available = spark.createDataFrame([(s, goal[s][0], int(goal[s][1]), int(sizes.get(s, 0)), bool(sizes.get(s, 0) * goal[s][1] >= goal[s][0] * total)) for s in sorted(goal)], "source string, target_share double, max_repeats int, available_tokens long, reachable boolean")
    report = available.join(F.broadcast(done), "source", "left").select(
        "source", "target_share", "max_repeats", "available_tokens", F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"),
        F.coalesce(F.col("used_tokens") / F.lit(float(everything or 1)), F.lit(0.0)).alias("actual_share"), "reachable",
    )
    return Mixture(schedule, report)
