"""Page layout: lines with print, rules, page heads and feet, slices of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Parts of the names of bold fonts (fixed values).
BOLD = r"bold|black|heavy|semibold|demi"
#: Words that begin an appendix (fixed values).
APPENDIX = r"(?i)^\s*(?:anlage|anhang|appendix)\b"


def layout_lines(spans: DataFrame) -> DataFrame:
    """SRC5: one row a line: ``document_id, page_no, line_no, text, bold_ratio, max_size``.

    ``spans``: document_id, page_no, line_no, span_no, text, font, size. Spans without
    text are left out, lines without text too.
    """
    said = spans.where(F.length("text") > 0)
    bold = F.when(F.lower(F.coalesce("font", F.lit(""))).rlike(BOLD), F.length("text")).otherwise(0)
    words = F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda x: x["text"])
    lines = said.groupBy("document_id", "page_no", "line_no").agg(F.array_join(words, " ").alias("text"), (F.sum(bold) / F.sum(F.length("text"))).alias("bold_ratio"), F.coalesce(F.max("size"), F.lit(0.0)).alias("max_size"))
    return lines.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " "))).where("text <> ''")


def median_sizes(spans: DataFrame) -> DataFrame:
    """AG22: the median size of print of each page, of an even number the mean of the middle two."""
    return spans.where((F.col("size") > 0) & (F.length("text") > 0)).groupBy("document_id", "page_no").agg(F.median("size").alias("median_size"))


def rules(shapes: DataFrame, spans: DataFrame, share: float = 0.7) -> DataFrame:
    """SRC6: horizontal rules with the text above them: ``document_id, page_no, y, header_text``.

    ``shapes``: document_id, page_no, kind (line, rect), x0, y0, x1, y1, page_width. A
    line counts if it is level within 3 points, a rectangle if it is at most 6 high;
    both must be at least ``share`` of the page wide. ``spans``: document_id, page_no,
    text, x0, y0, y1; the text of a rule lies in the band from 60 above it to 2 below,
    in reading order.
    """
    flat = F.when(F.col("kind") == "line", F.abs(F.col("y1") - F.col("y0")) <= 3).otherwise(F.abs(F.col("y1") - F.col("y0")) <= 6)
    level = shapes.where(flat & (F.abs(F.col("x1") - F.col("x0")) >= F.col("page_width") * share)).select("document_id", "page_no", F.round((F.col("y0") + F.col("y1")) / 2, 2).alias("y")).distinct()
    band = spans.select("document_id", "page_no", "text", F.col("x0").alias("x"), F.col("y0").alias("top"), F.col("y1").alias("bottom"))
    inside = level.join(band, ["document_id", "page_no"]).where((F.col("top") >= F.col("y") - 60) & (F.col("bottom") <= F.col("y") + 2))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "x", "text"))), lambda s: s["text"]), " ")
    headed = inside.groupBy("document_id", "page_no", "y").agg(F.trim(F.regexp_replace(text, r"\s+", " ")).alias("header_text"))
    return level.join(headed, ["document_id", "page_no", "y"], "left").withColumn("header_text", F.coalesce("header_text", F.lit("")))


def mentions_key(header: Column, key: Column) -> Column:
    """FN13: whether a head names an agenda key: at a line start, or after a sentence's end, behind a page mark or not."""
    quoted = F.regexp_replace(F.regexp_replace(F.trim(key), r"([\\^$|?*+()\[\]{}-])", r"\\$1"), r"\.", r"\\s*\\.\\s*")
    end = F.when(key.rlike(r"^\s*\d+\s*$"), F.lit(r"\s*(?!\.\d)\s*[)\.:]")).otherwise(F.lit(r"\s*(?:[)\.:]|\s)"))
    pattern = F.concat(F.lit(r"(?mi)(?:^|(?<=\.)\s+)(?:[-–—]\s*\d+\s*[-–—]\s*)?"), quoted, end)
    return F.when(F.length(F.trim(header)) > 0, F.regexp_like(F.trim(header), pattern) & (F.trim(key) != "")).otherwise(False)


def footer_transition(pages: DataFrame, footer: Column, window: int = 8, before: float = 0.7, after: float = 0.2, least: int = 400) -> DataFrame:
    """FN30, AG21: ``document_id, appendix_page``: the first page that an appendix word heads, else where footers end.

    ``pages``: document_id, page_no, page_text; ``footer`` tells whether a page has one.
    Footers end at a page if of the ``window`` pages before it at least ``before`` have
    one, of as many from it on at most ``after``, and the next three pages hold at
    least ``least`` characters. The first page never counts; documents of fewer than
    ``window`` + 2 pages are judged by words alone.
    """
    order = Window.partitionBy("document_id").orderBy("page_no")
    has = F.coalesce(footer, F.lit(False)).cast("double")
    head = F.slice(F.filter(F.split(F.coalesce("page_text", F.lit("")), "\n"), lambda x: F.trim(x) != ""), 1, 3)
    seen = pages.withColumns({
        "at": F.row_number().over(order), "pages": F.count("*").over(Window.partitionBy("document_id")), "headed": F.exists(head, lambda x: x.rlike(APPENDIX)),
        "pre": F.avg(has).over(order.rowsBetween(-window, -1)), "post": F.avg(has).over(order.rowsBetween(0, window - 1)), "ahead": F.sum(F.length(F.coalesce("page_text", F.lit("")))).over(order.rowsBetween(0, 2)),
    })
    ends = (F.col("at") > window) & (F.col("at") < F.col("pages") - window) & (F.col("pages") >= window + 2) & (F.col("pre") >= before) & (F.col("post") <= after) & (F.col("ahead") >= least)
    firsts = seen.where("at > 1").groupBy("document_id").agg(F.min(F.when(F.col("headed"), F.col("page_no"))).alias("word"), F.min(F.when(ends, F.col("page_no"))).alias("foot"))
    return firsts.select("document_id", F.coalesce("word", "foot").alias("appendix_page")).where("appendix_page is not null")


def inline_appendix(text: Column, share: float = 0.45) -> Column:
    """FN29: offset of the first line beyond ``share`` of a text that begins an appendix; null without one."""
    skip = F.floor(F.length(text) * share).cast("int")
    at = F.regexp_instr(F.substring(text, skip + 1, F.length(text)), F.lit(r"(?mi)^\s*(?:anlage|anhang|appendix)\b"))
    return F.when(at > 0, skip + at - 1)


def content_start(pages: DataFrame) -> DataFrame:
    """FN31: ``document_id, start_page, appendix_page``: the first page with a line like ``- 4 -``, else with ``Seite n``, else 1.

    The appendix is the first page behind it with a line that begins with an appendix word.
    """
    text = F.coalesce("page_text", F.lit(""))
    mark, named = text.rlike(r"(?m)^\s*[-–—]\s*\d{1,3}\s*[-–—]\s*$"), text.rlike(r"(?i)\bseite\s+\d{1,3}\b")
    first = pages.groupBy("document_id").agg(F.min(F.when(mark, F.col("page_no"))).alias("m"), F.min(F.when(named, F.col("page_no"))).alias("s"))
    first = first.select("document_id", F.coalesce("m", "s", F.lit(1)).cast("int").alias("start_page"))
    later = pages.join(first, "document_id").where((F.col("page_no") > F.col("start_page")) & text.rlike(r"(?mi)^\s*(?:anlage|anlagen|anhang|appendix)\b"))
    return first.join(later.groupBy("document_id").agg(F.min("page_no").cast("int").alias("appendix_page")), "document_id", "left")


def slice_ends(pages: DataFrame, keywords: tuple[str, ...] = ("öffentlich", "beschluss", "vorlage", "berichterstatter")) -> DataFrame:
    """FN32: ``document_id, pages_total, agenda_page, top1_page, top1_line, kw_hits, slice_end, contaminated``.

    The agenda page is the first with ``Tagesordnung``; the first item is the first line
    behind it like ``1. ...`` or ``TOP 1``. ``kw_hits`` are the keywords in the 35 lines
    from there. The slice with head and agenda ends before the first item's page, or
    with it where the item begins further down (``contaminated``: the page holds both);
    without an item it ends with the agenda, without agenda with the document.
    """
    text = F.coalesce("page_text", F.lit(""))
    agenda = pages.groupBy("document_id").agg(F.max("page_no").cast("int").alias("pages_total"), F.min(F.when(F.lower(text).rlike(r"\btagesordnung\b"), F.col("page_no"))).cast("int").alias("agenda_page"))
    filled = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    lines = pages.join(agenda.where("agenda_page is not null"), "document_id").where(F.col("page_no") > F.col("agenda_page")).withColumn("lines", filled)
    like_first = lambda x: x.rlike(r"^\s*1\s*[\.\)]\s+\S+") | F.lower(x).rlike(r"^\s*top\s*1\b")
    hits = lines.select("document_id", "page_no", "lines", F.array_position(F.transform(F.col("lines"), like_first), F.lit(True)).cast("int").alias("line")).where("line > 0")
    top = hits.groupBy("document_id").agg(F.min_by(F.struct(F.col("page_no").cast("int").alias("page"), "line", F.lower(F.array_join(F.slice("lines", F.col("line"), 35), "\n")).alias("near")), "page_no").alias("t"))
    words = F.array(*[F.lit(k) for k in sorted(keywords)])
    joined = agenda.join(top, "document_id", "left").select(
        "document_id", "pages_total", "agenda_page", F.col("t.page").alias("top1_page"), F.col("t.line").alias("top1_line"), F.coalesce(F.filter(words, lambda k: F.contains(F.col("t.near"), F.lower(k))), F.array().cast("array<string>")).alias("kw_hits"),
    )
    down = F.col("top1_line") > 1
    end = F.when(F.col("agenda_page").isNull(), F.col("pages_total")).when(F.col("top1_page").isNull(), F.col("agenda_page")).otherwise(F.col("top1_page") - F.when(down, 0).otherwise(1))
    return joined.withColumns({"slice_end": end, "contaminated": F.coalesce(down, F.lit(False))})
