"""Queries that SQL cannot express: segmentation, fuzzy titles, embedding, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from minuteworks.functions import similarity as S, text as T
from minuteworks.operators import segmentation
from minuteworks.plans import answer
from minuteworks.providers import HashedTrigrams, embed_texts
from minuteworks.session import table


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages put together from segments: each begins with its heading."""
    s = table(spark, sf, "segments").where("seg_type = 'top' and top_key is not null")
    head = F.concat(F.lit("TOP "), "top_key", F.lit(" "), F.coalesce("title", F.lit("")), F.lit("\n"))
    return s.select("document_id", F.col("id").alias("page_no"), T.offset_normalise(F.concat(head, F.coalesce("text_full", F.lit("")))).alias("page_text"))


def cp12_segments(spark: SparkSession, sf: str) -> DataFrame:
    agenda = table(spark, sf, "segments").where("seg_type = 'top' and top_key is not null").select("document_id", F.col("id").alias("row_index"), "top_key", "title")
    return segmentation.segment_documents(_pages(spark, sf), agenda)


def fn20_title_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """The title against the 520 characters behind the first place of its first long word; rows without one have no ratio."""
    word = F.get(T.title_words(F.col("title"), 1), F.lit(0))
    at = F.expr("instr(lower(text_full), word)")
    rows = table(spark, sf, "segments").where("title is not null and text_full is not null").withColumn("word", word).withColumn("at", at).where("at > 0")
    return rows.select("id", F.round(S.partial_ratio(F.lower("title"), F.lower(F.expr("substring(text_full, at, 520)"))), 3).alias("ratio"))


def fn51_gate(spark: SparkSession, sf: str) -> DataFrame:
    return answer.gate(table(spark, sf, "chat_logs").select("id", "query")).groupBy("verdict").agg(F.count("*").alias("n"))


def fn52_follow_ups(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chat_logs").groupBy(T.follow_up(F.col("query")).alias("follow_up")).agg(F.count("*").alias("n"))


def cp22_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return embed_texts(table(spark, sf, "segments"), "id", "text_full", HashedTrigrams).select("id", F.size("embedding").alias("dim"), "error")


SQL: dict[str, str] = {
    "fn52_follow_ups": """SELECT len(list_filter(string_split_regex(trim(lower(query)), '\\s+'), lambda w: w <> '')) <= 8
        OR regexp_matches(trim(lower(query)), '^(und|aber|oder|was ist mit|wie sieht es)($|[^\\p{L}\\p{N}_])')
        OR regexp_matches(trim(lower(query)), '(^|[^\\p{L}\\p{N}_])(das|dies|dazu|davon|darüber|er|sie|dort)($|[^\\p{L}\\p{N}_])') AS follow_up, count(*) AS n FROM chat_logs GROUP BY 1""",
}
QUERIES = {f.__name__: f for f in (cp12_segments, fn20_title_ratios, fn51_gate, fn52_follow_ups, cp22_embeddings)}
