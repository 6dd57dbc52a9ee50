"""Checks of segmented documents: one rule a SELECT, rolled up to a score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

#: Penalties by rule (fixed values); a severe issue makes a document ``broken``.
PENALTIES = {
    "OUT_OF_BOUNDS_START": 2, "OUT_OF_BOUNDS_END": 2, "OVERLAP_BETWEEN_TOPS": 12, "GAP_BETWEEN_TOPS": 4, "TOP_TOO_SHORT": 0,
    "LEAK_NEXT_TOP_EARLY": 10, "TRAILING_GAP_AFTER_LAST_TOP": 6, "VORWORT_OVERLAPS_TOP1": 12, "NACHWORT_OVERLAPS_LAST_TOP": 12,
    "OVERLAP_BETWEEN_SEGMENTS": 12, "NO_TOPS_WITH_SPAN": 35,
}
SEVERE = ("OVERLAP_BETWEEN_TOPS", "LEAK_NEXT_TOP_EARLY", "VORWORT_OVERLAPS_TOP1", "NACHWORT_OVERLAPS_LAST_TOP", "OVERLAP_BETWEEN_SEGMENTS", "NO_USABLE_TOP_CONTENT", "NO_PAGES")


def issues(segments: DataFrame, documents: DataFrame) -> DataFrame:
    """CP16: ``document_id, issue, segment_id`` of all segments with a span.

    Segments: document_id, seg_type, top_key, start_page, end_page, start_char, end_char,
    text_full. Neighbours are compared by windows within a document (WN8 to WN10).
    """
    spans = segments.where("start_page is not null and end_page is not null").select(
        "id", "document_id", "seg_type", "top_key", "start_page", "end_page", "start_char", "end_char", F.coalesce("text_full", F.lit("")).alias("text"),
        F.struct("start_page", "start_char").alias("begin"), F.struct("end_page", "end_char").alias("finish"),
    ).join(documents.select(F.col("id").alias("document_id"), "pages_total"), "document_id")
    order = Window.partitionBy("document_id").orderBy("start_page", "start_char", "id")
    tops = spans.where("seg_type = 'top'")
    paired = tops.withColumn("before", F.lag("finish").over(order)).withColumn("next_key", F.lead("top_key").over(order)).withColumn("later", F.lead("id").over(order))
    every = spans.withColumn("before", F.lag("finish").over(order))
    edge = tops.groupBy("document_id").agg(F.min("begin").alias("first_begin"), F.max("finish").alias("last_finish"))
    rules = [
        ("OUT_OF_BOUNDS_START", tops.where((F.col("start_page") < 1) | (F.col("start_page") > F.col("pages_total")))),
        ("OUT_OF_BOUNDS_END", tops.where((F.col("end_page") < 1) | (F.col("end_page") > F.col("pages_total")))),
        ("OVERLAP_BETWEEN_TOPS", paired.where(F.col("before") > F.col("begin"))),
        ("GAP_BETWEEN_TOPS", paired.where(F.col("before.end_page") + 1 < F.col("start_page"))),
        ("TOP_TOO_SHORT", tops.where(F.length(F.trim("text")) < 20)),
        ("LEAK_NEXT_TOP_EARLY", paired.where(F.col("next_key").isNotNull() & F.regexp_like(F.substring("text", 1, 1400), F.concat(F.lit(r"(?m)^TOP\s*"), F.regexp_replace("next_key", r"\.", r"\\."), F.lit(r"\b"))))),
        ("TRAILING_GAP_AFTER_LAST_TOP", paired.where(F.col("later").isNull() & (F.col("end_page") + 1 < F.col("pages_total")))),
        ("VORWORT_OVERLAPS_TOP1", spans.where("seg_type = 'vorwort'").join(edge, "document_id").where(F.col("finish") > F.col("first_begin"))),
        ("NACHWORT_OVERLAPS_LAST_TOP", spans.where("seg_type = 'nachwort'").join(edge, "document_id").where(F.col("begin") < F.col("last_finish"))),
        ("OVERLAP_BETWEEN_SEGMENTS", every.where(F.col("before") > F.col("begin"))),
    ]
    return reduce(DataFrame.unionByName, [df.select("document_id", F.lit(name).alias("issue"), F.col("id").alias("segment_id")) for name, df in rules])


def scores(segments: DataFrame, documents: DataFrame, threshold: float = 90.0) -> DataFrame:
    """AG19, AG20: score, coverage and recommendation of each document with segments."""
    found = issues(segments, documents)
    cost = F.create_map(*[F.lit(x) for k, v in PENALTIES.items() for x in (k, v)])
    total = found.groupBy("document_id").agg(F.sum(F.coalesce(cost[F.col("issue")], F.lit(0))).alias("penalty"), F.count_if(F.col("issue").isin(*SEVERE)).alias("n_severe"), F.count("*").alias("n_issues"))
    tops = segments.where("seg_type = 'top'").groupBy("document_id").agg(F.count("*").alias("n_tops"), F.avg(F.col("start_page").isNotNull().cast("int")).alias("covered"))
    joined = tops.join(total, "document_id", "left").na.fill(0, ["penalty", "n_severe", "n_issues"])
    missing = F.when(F.col("covered") < 1, 15 + F.greatest(F.lit(0.0), (0.90 - F.col("covered")) * 60)).otherwise(0.0)
    raw = 100.0 - F.col("penalty") - missing
    verdict = F.when(F.col("n_severe") > 0, "broken").when((raw >= threshold) & (F.col("covered") >= 0.85), "accept").otherwise("need_spans")
    return joined.select("document_id", "n_tops", "n_issues", "n_severe", F.round("covered", 4).alias("covered"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 4).alias("score"), verdict.alias("recommendation"))


def best_of(reports: DataFrame) -> DataFrame:
    """CP17: of several reports of a document (document_id, attempt, recommendation, covered, score) the best.

    Not broken first, then the recommendation, coverage, score; of equals the later attempt.
    """
    rank = F.when(F.col("recommendation") == "accept", 2).when(F.col("recommendation") == "need_spans", 1).otherwise(0)
    order = F.struct((F.col("recommendation") != "broken").cast("int"), rank, F.round("covered", 9), "score", "attempt")
    return reports.groupBy("document_id").agg(F.max_by(F.struct("attempt", "recommendation", "covered", "score"), order).alias("b")).select("document_id", "b.*")


def triage(packages: DataFrame) -> DataFrame:
    """CP20: the first reason that holds a package back, or ``ok``.

    Packages: ready, has_files, valid_json, tops_total, tops_found, top_segments.
    """
    reason = (
        F.when(~F.col("ready"), "not_ready").when(~F.col("has_files"), "missing_required_file").when(~F.col("valid_json"), "invalid_segments_json")
        .when(F.coalesce("tops_total", F.lit(0)) <= 0, "tops_total_invalid").when(F.col("tops_found").isNull(), "tops_found_missing")
        .when(F.col("tops_found") < F.col("tops_total"), "tops_incomplete").when(F.coalesce("top_segments", F.lit(0)) < F.col("tops_total"), "top_segments_missing").otherwise("ok")
    )
    return packages.withColumn("reason_code", reason)
