"""Problem 8: documents into containers of fixed capacity, variable-capacity best fit."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from minuteworks.llm.tokens import TOKENIZER_DIR, TOKENIZER_FILE, n_tokens
from minuteworks.session import cut

#: Container sizes a bin may be opened with or cut down to; the largest is the capacity.
SIZES = (256, 512, 1024, 2048)


def best_fit(lengths: np.ndarray, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Container, offset and final container size of every item, items in the order given.

    Best fit: an item goes to the open container with the least room that holds it.
    Otherwise the cheapest size is opened: one that it fills exactly, else the size
    that leaves the least room unfilled by items still to come, the largest on ties.
    At the end every container shrinks to the smallest size that holds its contents.
    """
    sizes = tuple(sorted(sizes))
    left = np.bincount(lengths, minlength=sizes[-1] + 1).tolist() if len(lengths) else []
    rest = sum(1 << n for n, count in enumerate(left) if count)  # bit n: an item of length n is still to come
    open_at: dict[int, list[int]] = {}
    rooms, used = 0, []  # bit n of rooms: a container with n left is open
    at, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        left[n] -= 1
        if not left[n]:
            rest &= ~(1 << n)
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            bins = open_at[room]
            chosen = bins.pop()
            if not bins:
                rooms &= ~(1 << room)
        else:
            def waste(size: int, n: int = n) -> int:
                room = size - n
                for _ in range(8):  # the longest item to come that fits, and again
                    most = (rest & ((2 << room) - 1)).bit_length() - 1
                    if most < 1:
                        break
                    room -= most
                return room

            room = min((s for s in sizes if s >= n), key=lambda s: (waste(s), -s))
            chosen = len(used)
            used.append(0)
        at[i], offset[i] = chosen, used[chosen]
        used[chosen] += n
        room -= n
        open_at.setdefault(room, []).append(chosen)
        rooms |= 1 << room
    steps = np.array(sizes)
    final = steps[np.searchsorted(steps, np.array(used, dtype=np.int64))] if used else np.empty(0, np.int64)
    return at, offset, final[at] if len(at) else at


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sizes: tuple[int, ...] = SIZES,
    group_rows: int = 25_000,
    tokenizer_dir: str = TOKENIZER_DIR,
    tokenizer_file: str = TOKENIZER_FILE,
) -> DataFrame:
    """Put every document into a container of at most ``max(sizes)`` tokens.

    Returns ``id, piece, n_pieces, start_token, n_tokens, container, container_size,
    position``: a document that fits is one piece; a longer one gets full containers
    and a last piece that is packed like the others. ``container`` is unique over the
    whole result, ``position`` is the token offset in it. Null or empty texts are
    items of 0 tokens and take no room. Rows are packed in an order that follows from
    id and text, whatever the partitioning; repeated ids and rows are packed each; other columns are ignored; an empty table gives an empty result.

    The rows fall evenly into groups of about ``group_rows`` that are packed side by
    side, longest first; a group leaves a few containers part empty, whatever the
    size of the input.
    """
    capacity = max(sizes)
    groups = max(1, math.ceil(df.count() / group_rows))
    items = df.select(
        F.col(id_col).alias("id"),
        n_tokens(F.col(text_col), tokenizer_dir, tokenizer_file).alias("n"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"),
    ).withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(groups)))
    items = cut(items)
    # All pieces but the last fill a container of their own.
    whole = F.when(F.col("n") > capacity, F.floor((F.col("n") - 1) / capacity)).otherwise(0).cast("int")
    items = items.withColumn("full", whole)

    def fill(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        last = (p["n"] - p["full"] * capacity).to_numpy()
        order = np.lexsort((p["row"].to_numpy(), -last))
        p, last = p.iloc[order].reset_index(drop=True), last[order]
        at, offset, size = best_fit(last, sizes)
        alone = np.repeat(np.arange(len(p)), p["full"])
        piece = np.arange(len(alone)) - np.searchsorted(alone, alone, side="left")
        out = pd.concat([
            pd.DataFrame({"id": p["id"], "piece": p["full"], "n_pieces": p["full"] + 1, "start_token": p["full"] * capacity, "n_tokens": last, "container": at, "container_size": size, "position": offset}),
            pd.DataFrame({"id": p["id"].to_numpy()[alone], "piece": piece, "n_pieces": p["full"].to_numpy()[alone] + 1, "start_token": piece * capacity, "n_tokens": capacity, "container": (at.max() + 1 if len(at) else 0) + np.arange(len(alone)), "container_size": capacity, "position": 0}),
        ])
        return out.assign(container=out["container"] + (int(key[0]) << 32))

    return items.select("id", "n", "row", "bucket", "full").groupBy("bucket").applyInPandas(fill, f"id {df.schema[id_col].dataType.simpleString()}, piece int, n_pieces int, start_token long, n_tokens long, container long, container_size int, position long")
