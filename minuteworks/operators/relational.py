"""Relational building blocks of the engine: latest rows, semi and anti joins, pivots, paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The last row of each key by ``order`` (upserts, re-imports, second ratings)."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """SRC18: new rows in place of old ones of the same key; of several new ones the last by ``order`` stands.

    Without ``order`` the keys of ``new`` must be unique; a repeated one raises an error
    when the result is read.
    """
    if order:
        fresh = latest(new, keys, *order)
    else:
        n = F.count("*").over(Window.partitionBy(*keys))
        fresh = new.withColumn("_n", F.when(n > 1, F.raise_error(F.lit("several new rows of one key: give an order"))).otherwise(n)).where("_n is not null").drop("_n")
    return old.join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh)


def replace_documents(documents: DataFrame, children: dict[str, DataFrame], incoming: DataFrame, incoming_children: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """SRC13: documents of the same body and file hash are replaced, with all their children."""
    gone = documents.join(incoming.select("gremium_key", "file_hash_sha256").distinct(), ["gremium_key", "file_hash_sha256"], "left_semi").select(F.col("id").alias("document_id"))
    kept = documents.join(gone.withColumnRenamed("document_id", "id"), "id", "left_anti").unionByName(incoming)
    return kept, {name: df.join(gone, "document_id", "left_anti").unionByName(incoming_children[name]) for name, df in children.items()}


def first_in_range(points: DataFrame, ranges: DataFrame, key: str, point: str, low: str, high: str, value: str, order: Sequence[str]) -> DataFrame:
    """JN13: for each point the value of the first range of its key that holds it; null where none does."""
    held = points.join(ranges.select(key, low, high, value, *[c for c in order if c not in (low, high, value)]), key).where(F.col(point).between(F.col(low), F.col(high)))
    best = held.groupBy(*points.columns).agg(F.min_by(value, F.struct(*order)).alias(value))
    return points.join(best, points.columns, "left")


def pivot_max(df: DataFrame, key: str, name: str, value: str, names: Sequence[str]) -> DataFrame:
    """AG2: the largest value of each name as a column of its own."""
    return df.groupBy(key).agg(*[F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names])


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """SO6: one page of an ordered table, pages from 1."""
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def monotone(df: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """WN11: a column raised to the largest value so far."""
    return df.withColumn(column, F.max(column).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def last_n(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """WN12: the last ``n`` rows of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def next_found(df: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """JN15: the next value that isn't null, as ``next_<column>``."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn(f"next_{column}", F.first(column, ignorenulls=True).over(w))


def export_packages(documents: DataFrame, agenda: DataFrame, attendance: DataFrame) -> DataFrame:
    """SRC23: one JSON document a row; agenda rows of a section that isn't public are left out."""
    public = agenda.where(F.col("section_curated").isNull() | (F.col("section_curated") != "non_public"))
    tops = public.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "id", "top_key_curated", "title_curated"))), lambda x: F.struct(x["row_index"].alias("row_index"), x["top_key_curated"].alias("top_key_curated"), x["title_curated"].alias("title_curated"))).alias("agenda"))
    people = attendance.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "id", "last_name_curated", "faction_curated"))), lambda x: F.struct(x["row_index"].alias("row_index"), x["last_name_curated"].alias("last_name_curated"), x["faction_curated"].alias("faction_curated"))).alias("attendance"))
    docs = documents.select(F.col("id").alias("document_id"), "gremium_key", "file_hash_sha256", "meeting_date")
    return docs.join(tops, "document_id", "left").join(people, "document_id", "left").select("document_id", F.to_json(F.struct("document_id", "gremium_key", "file_hash_sha256", "meeting_date")).alias("document_json"), F.coalesce(F.size("agenda"), F.lit(0)).alias("n_agenda"), F.coalesce(F.to_json("agenda"), F.lit("[]")).alias("agenda_json"), F.coalesce(F.size("attendance"), F.lit(0)).alias("n_attendance"), F.coalesce(F.to_json("attendance"), F.lit("[]")).alias("attendance_json"))
