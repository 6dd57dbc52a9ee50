"""Chunks: overlapping windows of words over pages, with the agenda key of their page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from minuteworks.functions import text as T
from minuteworks.operators.relational import first_in_range


def chunk_pages(pages: DataFrame, size: int = 600, overlap: float = 0.2, least_chars: int = 20, drop_contained_tail: bool = False) -> DataFrame:
    """SRC4, WN7, CP21: windows of ``size`` words, a step of ``size * (1 - overlap)``, over each page.

    ``pages``: document_id, page_no, page_text. Returns ``document_id, start_page,
    chunk_index, n_tokens, chunk_text``; the index counts a document's chunks from 0.
    Windows begin at every step below the page's length, so a short last window may lie
    inside the one before; ``drop_contained_tail`` leaves such windows out. Empty and
    null pages, and windows under ``least_chars`` characters, give no chunk.
    """
    step = max(1, round(size * (1 - overlap)))
    words = pages.select("document_id", "page_no", T.tokens(T.chunk_clean(F.col("page_text"))).alias("words")).where(F.size("words") > 0)
    cut = words.select("document_id", "page_no", "words", F.explode(F.sequence(F.lit(0), F.size("words") - 1, F.lit(step))).alias("at"))
    if drop_contained_tail:
        cut = cut.where((F.col("at") == 0) | (F.size("words") - F.col("at") > size - step))
    part = F.slice("words", F.col("at") + 1, size)
    chunks = cut.select("document_id", F.col("page_no").alias("start_page"), "at", F.size(part).alias("n_tokens"), F.array_join(part, " ").alias("chunk_text")).where(F.length("chunk_text") >= least_chars)
    order = Window.partitionBy("document_id").orderBy("start_page", "at")
    return chunks.withColumn("chunk_index", F.row_number().over(order) - 1).select("document_id", "start_page", "chunk_index", "n_tokens", "chunk_text")


def annotate_chunks(chunks: DataFrame, segments: DataFrame) -> DataFrame:
    """JN13: the agenda key of the first agenda segment whose pages hold a chunk's page."""
    tops = segments.where("seg_type = 'top' and top_key is not null").select("document_id", F.col("start_page").alias("from_page"), F.col("end_page").alias("to_page"), "top_key", F.col("id").alias("segment_id"))
    points = chunks.select("document_id", "start_page").distinct()
    keyed = first_in_range(points, tops, "document_id", "start_page", "from_page", "to_page", "top_key", ["from_page", "segment_id"])
    return chunks.join(keyed, ["document_id", "start_page"], "left")
