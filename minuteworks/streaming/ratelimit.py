"""Fixed-window request counters, the same plan on batches and streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def windowed_counts(requests: DataFrame, seconds: int = 3600, limit: int = 15) -> DataFrame:
    """SS1, AG28: requests of each address in each fixed window, and whether they stay within the limit.

    ``requests``: ts, ip_hash. Rejected requests count as well. Null addresses are one
    address, rows without time are left out.
    """
    counted = requests.where("ts is not null").groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "ip_hash").agg(F.count("*").alias("n"))
    return counted.select("ip_hash", F.col("w.start").alias("window_start"), "n", (F.col("n") <= limit).alias("allowed"))


def stream_counts(requests: DataFrame, seconds: int = 3600, limit: int = 15) -> DataFrame:
    """SS1, SS2: the counters of a stream; a window is kept for two windows' time."""
    return windowed_counts(requests.withWatermark("ts", f"{2 * seconds} seconds"), seconds, limit)


def decisions(requests: DataFrame, seconds: int = 3600, limit: int = 15) -> DataFrame:
    """Whether each request of a stream is let through: the running number in its window.

    State: window and count of each address, and of the window before; it expires two
    windows after the last request. A late request counts in its own window; one older
    than the window before is let through by itself.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def decide(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        window, n, earlier = state.get if state.exists else (-1, 0, 0)
        rows = pd.concat(parts).sort_values("ts", kind="stable")
        out = []
        for ts in rows["ts"]:
            at = int(ts.timestamp()) // seconds * seconds
            if at > window:
                earlier = n if at == window + seconds else 0
                window, n = at, 1
                count = n
            elif at == window:
                n += 1
                count = n
            elif at == window - seconds:
                earlier += 1
                count = earlier
            else:
                count = 1
            out.append((key[0], ts, count, count <= limit))
        state.update((window, n, earlier))
        state.setTimeoutDuration(2 * seconds * 1000)
        yield pd.DataFrame(out, columns=["ip_hash", "ts", "n", "allowed"])

    return requests.groupBy("ip_hash").applyInPandasWithState(decide, "ip_hash string, ts timestamp, n long, allowed boolean", "window long, n long, earlier long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def new_files(spark, folder: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """SS3: a folder of JSON packages as a stream, some files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(folder)
