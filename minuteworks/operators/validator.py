"""The validator of segmented documents against their pages: 16 rules, each a SELECT, and a report."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from minuteworks.functions import similarity as S, text as T
from minuteworks.session import cut

#: Severity and penalty by rule (fixed values). Missing spans cost more the more are missing; severe issues break a document.
RULES = {
    "NO_PAGES": ("severe", 100.0), "NO_TOPS_WITH_SPAN": ("warn", 35.0), "TOPS_MISSING_SPAN": ("warn", 15.0), "NO_USABLE_TOP_CONTENT": ("severe", 0.0),
    "OUT_OF_BOUNDS_START": ("warn", 2.0), "OUT_OF_BOUNDS_END": ("warn", 2.0), "OVERLAP_BETWEEN_TOPS": ("severe", 12.0), "GAP_BETWEEN_TOPS": ("warn", 4.0),
    "TOP_TOO_SHORT": ("info", 0.0), "MARKER_NOT_NEAR_START": ("warn", 3.0), "LEAK_NEXT_TOP_EARLY": ("severe", 10.0), "LEAK_NEXT_TOP_EARLY_SUPPRESSED": ("info", 0.0),
    "TRAILING_GAP_AFTER_LAST_TOP": ("warn", 6.0), "VORWORT_OVERLAPS_TOP1": ("severe", 12.0), "NACHWORT_OVERLAPS_LAST_TOP": ("severe", 12.0), "OVERLAP_BETWEEN_SEGMENTS": ("severe", 12.0),
}
#: Characters of an item's text in which its own key is sought, and the next one's.
NEAR, EARLY, SHORT = 600, 1400, 20


def _within(c: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(c, high))


def _pieces(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """The text of each span (sid, document_id, p, c, q, d) on each of its pages: ``sid, page_no, piece``."""
    on = pages.select("document_id", "page_no", "page_text")
    held = spans.join(on, "document_id").where(F.col("page_no").between(F.col("p"), F.col("q")))
    start = F.when(F.col("page_no") == F.col("p"), F.col("c")).otherwise(0)
    end = F.when(F.col("page_no") == F.col("q"), F.col("d")).otherwise(F.length("page_text"))
    return held.select("sid", "page_no", F.substring("page_text", start + 1, F.greatest(end - start, F.lit(0))).alias("piece"))


def _marked(c: Column, words: bool) -> Column:
    """Whether text stands there; with ``words`` lines like ``- 4 -`` are none."""
    return F.trim(F.regexp_replace(c, r"(?m)^\s*-\s*\d+\s*-\s*$" if words else r"\s+", "")).rlike(r"\S")


def _key_pattern(key: Column, digits: str, other: str) -> Column:
    """A pattern for the key at a line start, behind a page mark or ``TOP``; what follows differs by kind of key."""
    quoted = F.regexp_replace(F.regexp_replace(F.trim(key), r"([\\^$|?*+()\[\]{}-])", r"\\$1"), r"\.", r"\\s*\\.\\s*")
    return F.concat(F.lit(r"(?mi)^\s*(?:[-–—]\s*\d+\s*[-–—]\s*)?(?:TOP\s*)?"), quoted, F.when(key.rlike(r"^\s*\d+\s*$"), F.lit(digits)).otherwise(F.lit(other)))


def validate(segments: DataFrame, documents: DataFrame, pages: DataFrame, threshold: float = 90.0) -> tuple[DataFrame, DataFrame]:
    """CP16, AG19, AG20, WN8 to WN10: (issues, reports) of all documents.

    ``segments``: id, document_id, seg_type, top_key, title, spans (page from 1, char from
    0) and text_full; ``documents``: id, tops_total (expected items, null for unknown) and,
    where known, content_start_page, content_start_char, content_end_page, content_end_char;
    ``pages``: document_id, page_no (from 1), page_text. Spans are clamped to the pages;
    a span with a null part is none. Missing texts are taken from the pages.
    ``issues``: document_id, issue, severity, segment_id (null for those of a document).
    ``reports``: document_id, score, n_issues, n_severe, n_tops, n_spans, span_coverage,
    text_coverage, recommendation, ok. Documents without segments are reported too.
    """
    pages = pages.select("document_id", "page_no", F.coalesce("page_text", F.lit("")).alias("page_text"))
    sizes = pages.select("document_id", F.col("page_no").alias("page"), F.length("page_text").alias("size"))
    totals = pages.groupBy("document_id").agg(F.max("page_no").cast("int").alias("pages_total"), F.max_by(F.length("page_text"), "page_no").alias("last_size"))
    optional = lambda c: F.col(c) if c in documents.columns else F.lit(None).cast("int")
    docs = documents.select(F.col("id").alias("document_id"), F.coalesce("tops_total", F.lit(0)).alias("tops_total"), *[optional(c).alias(c) for c in ("content_start_page", "content_start_char", "content_end_page", "content_end_char")])
    docs = docs.join(totals, "document_id", "left").withColumn("pages_total", F.coalesce("pages_total", F.lit(0)))
    first, last = _within(F.coalesce("content_start_page", F.lit(1)), F.lit(1), F.col("pages_total")), _within(F.coalesce("content_end_page", "pages_total"), F.lit(1), F.col("pages_total"))
    docs = docs.withColumn("from_page", first).withColumn("to_page", F.greatest(last, "from_page"))
    docs = docs.join(sizes.select("document_id", F.col("page").alias("to_page"), F.col("size").alias("to_size")), ["document_id", "to_page"], "left")
    docs = cut(docs.select(
        "document_id", "tops_total", "pages_total", F.struct(F.col("from_page").alias("p"), F.coalesce("content_start_char", F.lit(0)).alias("c")).alias("content_from"),
        F.struct(F.col("to_page").alias("p"), F.least(F.coalesce("content_end_char", "to_size", F.lit(0)), F.coalesce("to_size", F.lit(0))).alias("c")).alias("content_to"),
    ))
    whole = segments.join(docs.select("document_id", "pages_total"), "document_id")
    full = F.col("start_page").isNotNull() & F.col("start_char").isNotNull() & F.col("end_page").isNotNull() & F.col("end_char").isNotNull()
    spans = whole.where(full & (F.col("pages_total") > 0)).withColumn("p", _within(F.col("start_page"), F.lit(1), F.col("pages_total")))
    spans = spans.withColumn("q", F.greatest(_within(F.col("end_page"), F.lit(1), F.col("pages_total")), "p"))
    for page, raw, char in (("p", "start_char", "c"), ("q", "end_char", "d")):
        spans = spans.join(sizes.withColumnRenamed("page", page), ["document_id", page], "left").withColumn(char, _within(F.col(raw), F.lit(0), F.coalesce("size", F.lit(0)))).drop("size")
    spans = spans.withColumn("d", F.when(F.col("p") == F.col("q"), F.greatest("c", "d")).otherwise(F.col("d")))
    spans = spans.select(F.col("id").alias("sid"), "document_id", "seg_type", F.trim(F.coalesce("top_key", F.lit(""))).alias("key"), F.coalesce("title", F.lit("")).alias("title"), "start_page", "start_char", "p", "c", "q", "d", F.struct("p", "c").alias("begin"), F.struct(F.col("q").alias("p"), F.col("d").alias("c")).alias("finish"), F.nullif(F.trim(F.coalesce("text_full", F.lit(""))), F.lit("")).alias("said"))
    spans = cut(spans)
    filled = _pieces(spans.where("said is null").select("sid", "document_id", "p", "c", "q", "d"), pages).groupBy("sid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "piece"))), lambda x: x["piece"]), "\n\n").alias("filled"))
    order = Window.partitionBy("document_id").orderBy("start_page", "start_char", "sid")
    tops = spans.where("seg_type = 'top'").join(filled, "sid", "left").withColumn("text", F.coalesce("said", "filled", F.lit("")))
    tops = cut(tops.withColumns({"before": F.lag("finish").over(order), "next_key": F.lead("key").over(order), "next_title": F.lead("title").over(order), "n": F.row_number().over(order), "later": F.lead("sid").over(order)}).join(docs.drop("tops_total", "pages_total"), "document_id"))

    # Gaps: what stands between an item's end and the next one's beginning, or the content's end.
    gaps = tops.where(F.col("before") < F.col("begin")).select("sid", "document_id", F.col("before.p").alias("p"), F.col("before.c").alias("c"), F.col("begin.p").alias("q"), F.col("begin.c").alias("d"))
    trail = tops.where(F.col("later").isNull() & (F.col("finish") < F.col("content_to"))).select("sid", "document_id", F.col("finish.p").alias("p"), F.col("finish.c").alias("c"), F.col("content_to.p").alias("q"), F.col("content_to.c").alias("d"))
    wide_gaps = _pieces(gaps, pages).where(_marked(F.col("piece"), True)).select("sid").distinct()
    trailing = _pieces(trail, pages).where(_marked(F.col("piece"), False)).select("sid").distinct()

    # The next item's key early in a text: a heading, or only a numbered point.
    early = F.substring("text", 1, EARLY)
    leaks = tops.where(F.coalesce("next_key", F.lit("")) != "").withColumn("at", F.regexp_instr(early, _key_pattern(F.col("next_key"), r"\s*(?!\.\d)\s*[)\.:]\s+", r"\s*(?:[)\.:]|\s)\s+"))).where("at > 0")
    around = T.match_normalise(F.substring("text", F.greatest(F.col("at") - 80, F.lit(1)), F.least(F.col("at") - 1, F.lit(80)) + 500))
    title = T.match_normalise(F.col("next_title"))
    long_words = F.slice(F.filter(F.split(F.lower(title), r"\s+"), lambda w: F.length(w) >= 6), 1, 6)
    leaks = leaks.withColumn("around", F.lower(around)).withColumn("ratio", S.partial_ratio(F.lower(title), F.col("around")))
    real = F.col("around").rlike(r"berichterstatter|bericht\s+erstattet") | ((F.col("next_title") != "") & ((F.col("ratio") >= 72) | (F.size(F.filter(long_words, lambda w: F.contains(F.col("around"), w))) >= 2)))
    leaks = leaks.withColumn("real", real)

    edge = tops.groupBy("document_id").agg(F.min("begin").alias("first_begin"), F.max_by("finish", "n").alias("last_finish"))
    preface = spans.where("seg_type = 'vorwort'").groupBy("document_id").agg(F.max("finish").alias("x"), F.max_by("sid", "finish").alias("sid"))
    closing = spans.where("seg_type = 'nachwort'").groupBy("document_id").agg(F.min("begin").alias("x"), F.min_by("sid", "begin").alias("sid"))
    every = spans.withColumn("before", F.lag("finish").over(order))
    counts = segments.where("seg_type = 'top'").groupBy("document_id").agg(F.count("*").alias("n_tops"), F.count_if(full).alias("n_spans"), F.count_if(F.length(F.trim(F.coalesce("text_full", F.lit("")))) > 0).alias("n_texts"))
    state = docs.join(counts, "document_id", "left").na.fill(0, ["n_tops", "n_spans", "n_texts"])
    state = cut(state.withColumn("n_spans", F.when(F.col("pages_total") > 0, F.col("n_spans")).otherwise(0)))
    head = F.substring("text", 1, NEAR)
    own = _key_pattern(F.col("key"), r"\s*(?!\.\d)(?:[)\.:]|\s|$)", r"\s*(?:[)\.:]|\s|$)")
    none = F.lit(None).cast(segments.schema["id"].dataType).alias("sid")
    some_pages = F.col("pages_total") > 0
    found: list[tuple[str, DataFrame]] = [
        ("NO_PAGES", state.where("pages_total <= 0").select("document_id", none)),
        ("NO_TOPS_WITH_SPAN", state.where(some_pages & (F.col("tops_total") > 0) & (F.col("n_spans") == 0)).select("document_id", none)),
        ("TOPS_MISSING_SPAN", state.where(some_pages & (F.col("n_spans") > 0) & (F.col("n_spans") < F.col("tops_total"))).select("document_id", none)),
        ("NO_USABLE_TOP_CONTENT", state.where(some_pages & (F.col("n_spans") == 0) & (F.col("n_tops") > 0) & (F.col("n_texts") < F.col("n_tops") * 0.2)).select("document_id", none)),
        ("OUT_OF_BOUNDS_START", tops.where(F.col("begin") < F.col("content_from"))), ("OUT_OF_BOUNDS_END", tops.where(F.col("finish") > F.col("content_to"))),
        ("OVERLAP_BETWEEN_TOPS", tops.where(F.col("begin") < F.col("before"))), ("GAP_BETWEEN_TOPS", tops.join(wide_gaps, "sid", "left_semi")),
        ("TOP_TOO_SHORT", tops.where(F.length("text") < SHORT)), ("MARKER_NOT_NEAR_START", tops.where((F.col("key") != "") & ~F.regexp_like(head, own))),
        ("LEAK_NEXT_TOP_EARLY", leaks.where("real")), ("LEAK_NEXT_TOP_EARLY_SUPPRESSED", leaks.where("not real")), ("TRAILING_GAP_AFTER_LAST_TOP", tops.join(trailing, "sid", "left_semi")),
        ("VORWORT_OVERLAPS_TOP1", preface.join(edge, "document_id").where(F.col("x") > F.col("first_begin"))), ("NACHWORT_OVERLAPS_LAST_TOP", closing.join(edge, "document_id").where(F.col("x") < F.col("last_finish"))),
        ("OVERLAP_BETWEEN_SEGMENTS", every.where(F.col("begin") < F.col("before"))),
    ]
    issues = cut(reduce(DataFrame.unionByName, [df.select("document_id", F.lit(name).alias("issue"), F.lit(RULES[name][0]).alias("severity"), F.col("sid").alias("segment_id")) for name, df in found]))
    cost = F.create_map(*[F.lit(x) for name, (_, v) in RULES.items() for x in (name, v)])
    rolled = issues.groupBy("document_id").agg(F.sum(cost[F.col("issue")]).alias("cost"), F.count("*").alias("n_issues"), F.count_if(F.col("severity") == "severe").alias("n_severe"), F.max((F.col("issue") == "NO_USABLE_TOP_CONTENT")).alias("useless"))
    report = state.join(rolled, "document_id", "left").na.fill(0, ["cost", "n_issues", "n_severe"])
    missing = F.when((F.col("n_spans") > 0) & (F.col("n_spans") < F.col("tops_total")), F.greatest(F.lit(0.0), (0.90 - F.col("n_spans") / F.col("tops_total")) * 60)).otherwise(0.0)
    raw = 100.0 - F.col("cost") - missing
    raw = F.when(F.coalesce("useless", F.lit(False)), F.least(raw, F.lit(5.0))).otherwise(raw)
    expected = F.when(F.col("tops_total") > 0, F.col("tops_total")).otherwise(F.col("n_tops"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    report = report.withColumn("raw", raw).withColumn("span_coverage", share(F.col("n_spans"), expected)).withColumn("text_coverage", share(F.col("n_texts"), F.col("n_tops")))
    good = (F.col("raw") >= threshold) & (((F.col("tops_total") > 0) & (F.col("n_spans") == F.col("tops_total"))) | (F.col("span_coverage") >= 0.85))
    verdict = F.when(F.col("n_severe") > 0, "broken").when(good, "accept").otherwise("need_spans")
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), "raw")), 2)
    reports = report.select("document_id", score.alias("score"), "n_issues", "n_severe", "n_tops", "n_spans", F.round("span_coverage", 3).alias("span_coverage"), F.round("text_coverage", 3).alias("text_coverage"), verdict.alias("recommendation"), ((F.col("n_severe") == 0) & (F.col("raw") >= threshold)).alias("ok"))
    return issues, reports


def pipeline(agenda: DataFrame, documents: DataFrame, pages: DataFrame, deterministic: Callable[[DataFrame, DataFrame], DataFrame], hints: DataFrame | None = None, threshold: float = 90.0) -> tuple[DataFrame, DataFrame]:
    """CP18: (segments, reports): deterministic spans, validated; from hints where they fall short; the better of both, texts filled.

    ``agenda``: document_id, row_index, top_key, title; ``deterministic`` takes pages and
    agenda; ``hints``: document_id, ord, top_key, page_no, anchor. Documents that are
    accepted keep their spans; for the others hints are aligned to the agenda (CP15), placed
    in the pages (CP14) and validated as well, and ``best_of`` (CP17) picks the attempt.
    ``reports`` has ``attempt`` (1 deterministic, 2 hints). A document without hints, or
    without pages, keeps attempt 1.
    """
    from minuteworks.operators.segmentation import hinted_spans
    from minuteworks.operators.validation import best_of

    expected = agenda.groupBy("document_id").agg(F.count("*").cast("int").alias("tops_total"))
    docs = documents.select("id").join(expected.withColumnRenamed("document_id", "id"), "id", "left")
    numbered = lambda df: df.withColumn("id", F.xxhash64("document_id", "seg_type", F.coalesce("top_key", F.lit("")), F.coalesce("start_page", F.lit(0)), F.coalesce("start_char", F.lit(0))))
    one = cut(numbered(deterministic(pages, agenda)))
    reports = validate(one, docs, pages, threshold)[1].withColumn("attempt", F.lit(1))
    attempts = one.withColumn("attempt", F.lit(1))
    if hints is not None:
        open_docs = reports.where("recommendation <> 'accept'").select("document_id")
        asked = hints.join(open_docs, "document_id", "left_semi")
        two = cut(numbered(hinted_spans(agenda.join(asked.select("document_id").distinct(), "document_id", "left_semi"), asked, pages)))
        again = validate(two, docs.join(two.select(F.col("document_id").alias("id")).distinct(), "id", "left_semi"), pages, threshold)[1]
        reports = reports.unionByName(again.withColumn("attempt", F.lit(2)))
        attempts = attempts.unionByName(two.withColumn("attempt", F.lit(2)))
    reports = cut(reports)
    best = best_of(reports.withColumn("covered", F.col("span_coverage"))).select("document_id", "attempt")
    chosen = reports.join(best, ["document_id", "attempt"])
    return attempts.join(best, ["document_id", "attempt"]).drop("id"), chosen
