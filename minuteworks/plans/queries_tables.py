"""Queries over sources, joins, aggregates, windows, sets and validation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from minuteworks.operators import analytics as A, chunking, relational as R, validation as V, layout as L, validator as VR
from minuteworks.plans import queries_text as QT
from minuteworks.session import table
from minuteworks.sources.packages import merge_pages


def flt1_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "raw_documents").where((F.col("gremium_key") == "rat") & (F.year("meeting_date") >= 2015) & (F.year("meeting_date") <= 2022)).select("id", "meeting_date")


def flt2_3_searchable(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "segments").where(F.col("embedding").isNotNull() & (F.length(F.trim(F.coalesce("text_full", F.lit("")))) >= 20)).groupBy("seg_type").agg(F.count("*").alias("n"))


def flt4_contains(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "segments").where(F.col("text_full").ilike("%radweg%")).select("id")


def flt10_search_logs(spark: SparkSession, sf: str) -> DataFrame:
    return A.search_logs(table(spark, sf, "chat_logs"), "Spielplatz").select("id")


def flt13_attendance_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "document_attendance_rows").join(table(spark, sf, "raw_documents").select(F.col("id").alias("document_id"), "meeting_date"), "document_id")
    name = F.concat_ws(" ", F.nullif("salutation", F.lit("")), "last_name_extracted")
    return rows.select("id", F.concat(name, F.lit(" ("), F.coalesce("faction_extracted", F.lit("keine Fraktion")), F.lit(") – Sitzung vom "), F.coalesce(F.date_format("meeting_date", "yyyy-MM-dd"), F.lit("?"))).alias("line"))


def src3_page_merge(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "segments").where("start_page is not null")
    one = s.where("id % 2 = 0").groupBy("document_id", F.col("start_page").alias("page_no")).agg(F.max("text_full").alias("a"))
    two = s.where("id % 3 = 0").groupBy("document_id", F.col("start_page").alias("page_no")).agg(F.max("text_full").alias("b"))
    return one.join(two, ["document_id", "page_no"], "full").select("document_id", "page_no", F.coalesce(F.nullif("a", F.lit("")), "b").alias("page_text"))


def src3_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every page of the segments: their texts, or their titles where no text is."""
    s = table(spark, sf, "segments").where("start_page is not null")

    def pages(column: str) -> DataFrame:
        said = F.collect_list(F.when(F.trim(column) != "", F.struct("id", F.col(column).alias("text"))))
        return s.groupBy(F.col("document_id").cast("string").alias("path"), F.col("start_page").alias("page_no")).agg(F.array_join(F.transform(F.array_sort(said), lambda x: x["text"]), "\n").alias("page_text"))

    return merge_pages(pages("text_full"), pages("title"))


def src13_replace_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "raw_documents").select("id", "gremium_key", "file_hash_sha256")
    first = docs.groupBy("gremium_key", "file_hash_sha256").agg(F.min("id").alias("id")).select("id", "gremium_key", "file_hash_sha256")
    again = docs.groupBy("gremium_key", "file_hash_sha256").agg(F.max("id").alias("id"), F.count("*").alias("n")).where("n > 1").select("id", "gremium_key", "file_hash_sha256")
    agenda = table(spark, sf, "document_agenda_items").select("id", "document_id")
    kept, children = R.replace_documents(first, {"agenda": agenda}, again, {"agenda": agenda.join(again.select(F.col("id").alias("document_id")), "document_id", "left_semi").select("id", "document_id")})
    return kept.join(children["agenda"].groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("n_agenda")), "id", "left").select("id", F.coalesce("n_agenda", F.lit(0)).alias("n_agenda"))


def src17_segment_rows(spark: SparkSession, sf: str) -> DataFrame:
    text = F.translate("text_full", "\u0000", "")
    return table(spark, sf, "segments").select("id", F.sha2(F.nullif(text, F.lit("")), 256).alias("hash"), F.length(text).alias("n_chars"))


def src18_latest_rows(spark: SparkSession, sf: str) -> DataFrame:
    return R.latest(table(spark, sf, "document_agenda_items"), ["document_id", "row_index"], "updated_at", "id").select("id", "document_id", "row_index")


def src23_export(spark: SparkSession, sf: str) -> DataFrame:
    return R.export_packages(table(spark, sf, "raw_documents"), table(spark, sf, "document_agenda_items"), table(spark, sf, "document_attendance_rows")).select("document_id", "n_agenda", "n_attendance")


def src24_registration(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "raw_documents")
    w = Window.partitionBy("gremium_key", "file_hash_sha256").orderBy("id")
    return docs.withColumn("n", F.row_number().over(w)).select("id", (F.col("n") > 1).alias("is_duplicate"))


def jn2_agenda_fanout(spark: SparkSession, sf: str) -> DataFrame:
    agenda = table(spark, sf, "document_agenda_items").select("document_id", F.col("top_key_curated").alias("top_key"), "title_curated")
    return table(spark, sf, "segments").select("id", "document_id", "top_key").join(agenda, ["document_id", "top_key"], "left").select("id", "title_curated")


def jn4_attendance_star(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "raw_documents").select(F.col("id").alias("document_id"), "gremium_key", "meeting_date")
    return table(spark, sf, "document_attendance_rows").join(docs, "document_id").groupBy("gremium_key", F.year("meeting_date").alias("year")).agg(F.count("*").alias("n"), F.countDistinct("last_name_extracted").alias("n_names"))


def jn6_documents_without_annex(spark: SparkSession, sf: str) -> DataFrame:
    annex = table(spark, sf, "segments").where("seg_type = 'anhang'").select(F.col("document_id").alias("id"))
    return table(spark, sf, "raw_documents").join(annex, "id", "left_anti").select("id")


def jn7_documents_with_agenda(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "raw_documents").join(table(spark, sf, "document_agenda_items").select(F.col("document_id").alias("id")), "id", "left_semi").select("id")


def jn9_unrated(spark: SparkSession, sf: str) -> DataFrame:
    return A.unrated(table(spark, sf, "chat_logs"), table(spark, sf, "chat_feedback")).select("id")


def jn10_ratings_of_logs(spark: SparkSession, sf: str) -> DataFrame:
    return A.rated_logs(table(spark, sf, "chat_logs"), table(spark, sf, "chat_feedback")).select("id", "rating")


def jn10_ratings_fanout(spark: SparkSession, sf: str) -> DataFrame:
    return A.rated_logs(table(spark, sf, "chat_logs"), table(spark, sf, "chat_feedback"), faithful=True).groupBy("rating").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_logs"))


def jn13_page_ranges(spark: SparkSession, sf: str) -> DataFrame:
    segments = table(spark, sf, "segments")
    pages = segments.where("start_page is not null").select("document_id", "start_page").distinct()
    return chunking.annotate_chunks(pages, segments)


def jn16_filename_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "raw_documents").groupBy("source_filename").agg(F.max("id").alias("download_id"))


def ag1_bodies(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "raw_documents").groupBy("gremium_key", "gremium_name").agg(F.count("*").alias("n"), F.max("meeting_date").alias("last_meeting"))


def ag2_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return R.pivot_max(table(spark, sf, "segments"), "document_id", "seg_type", "confidence", ["vorwort", "top", "nachwort", "anhang"])


def ag3_5_8_totals(spark: SparkSession, sf: str) -> DataFrame:
    return A.chat_totals(table(spark, sf, "chat_logs"))


def ag4_per_day(spark: SparkSession, sf: str) -> DataFrame:
    return A.per_day(table(spark, sf, "chat_logs"))


def ag6_ratings(spark: SparkSession, sf: str) -> DataFrame:
    return A.ratings(table(spark, sf, "chat_feedback"))


def ag7_top_bodies(spark: SparkSession, sf: str) -> DataFrame:
    return A.top_groups(table(spark, sf, "chat_logs"), "gremium_key")


def ag14_best_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "segments").groupBy("document_id", "top_key").agg(F.max_by("id", F.struct("match_score", F.col("id"))).alias("best"), F.max("match_score").alias("score"))


def ag18_agenda_lists(spark: SparkSession, sf: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("row_index", "id", F.coalesce("title_curated", F.lit("")).alias("t"))))
    return table(spark, sf, "document_agenda_items").groupBy("document_id").agg(F.array_join(F.transform(rows, lambda x: x["t"]), "|").alias("titles"))


def ag19_coverage(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "segments").where("seg_type = 'top'")
    return s.groupBy("document_id").agg(F.round(F.avg(F.col("start_page").isNotNull().cast("int")), 6).alias("span_coverage"), F.round(F.avg((F.length("text_full") > 0).cast("int")), 6).alias("text_coverage"))


def ag25_missing_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "segments").where(F.length(F.trim(F.coalesce("text_full", F.lit("")))) >= 20).groupBy("document_id").agg(F.count_if(F.col("embedding").isNull()).alias("n_missing"))


def ag27_nested_maps(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "chat_logs").groupBy("session_id", "quality").agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct(F.coalesce("quality", F.lit("-")).alias("q"), "n")))
    return counts.groupBy("session_id").agg(F.array_join(F.transform(pairs, lambda x: F.concat_ws("=", x["q"], x["n"].cast("string"))), ",").alias("usage"))


def wn8_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("document_id").orderBy("start_page", "start_char", "id")
    s = table(spark, sf, "segments").where("start_page is not null and end_page is not null")
    return s.withColumn("before", F.lag("end_page").over(w)).where(F.col("before") > F.col("start_page")).select("id", "document_id", "before")


def wn11_monotone_pages(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "segments").where("start_page is not null").select("id", "document_id", "start_page")
    return R.monotone(s, "document_id", "id", "start_page")


def wn12_last_turns(spark: SparkSession, sf: str) -> DataFrame:
    logs = table(spark, sf, "chat_logs").select("id", "session_id", F.substring("query", 1, 300).alias("query"))
    return R.last_n(logs, "session_id", "id", 12).select("id", "session_id", "query")


def wn13_first_last(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "segments").where("start_page is not null and end_page is not null")
    return s.groupBy("document_id").agg(F.min_by("id", F.struct("start_page", "start_char", "id")).alias("first_id"), F.max_by("id", F.struct("end_page", "end_char", "id")).alias("last_id"))


def jn15_next_found(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "segments").select("id", "document_id", "top_key")
    return R.next_found(s, "document_id", "id", "top_key").select("id", "next_top_key")


def so4_newest_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "raw_documents").orderBy(F.desc_nulls_first("meeting_date"), "id").limit(8).select("id", "meeting_date")


def so6_page(spark: SparkSession, sf: str) -> DataFrame:
    return R.page(table(spark, sf, "chat_logs").select("id", "created_at"), 3, 15, F.desc("created_at"), F.desc("id"))


def st1_union(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "chat_logs").select(F.lit("log").alias("kind"), "id", "created_at")
    b = table(spark, sf, "chat_feedback").select(F.lit("feedback").alias("kind"), "id", "created_at")
    return a.unionByName(b).groupBy("kind", F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))


def st3_ordered_distinct(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array_distinct(F.filter(F.split(F.lower("title_curated"), " "), lambda w: w != ""))
    return table(spark, sf, "document_agenda_items").where("title_curated is not null").select("id", F.array_join(words, " ").alias("words"))


def cp16_issues(spark: SparkSession, sf: str) -> DataFrame:
    return V.issues(table(spark, sf, "segments"), table(spark, sf, "raw_documents")).groupBy("issue").agg(F.count("*").alias("n"))


def cp16_scores(spark: SparkSession, sf: str) -> DataFrame:
    return V.scores(table(spark, sf, "segments"), table(spark, sf, "raw_documents"))


def _segment_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Segment texts as the pages of their documents."""
    return table(spark, sf, "segments").select("document_id", F.col("id").alias("page_no"), F.col("text_full").alias("page_text"))


def fn31_content_start(spark: SparkSession, sf: str) -> DataFrame:
    return L.content_start(_segment_pages(spark, sf))


def fn32_slices(spark: SparkSession, sf: str) -> DataFrame:
    found = L.slice_ends(_segment_pages(spark, sf))
    return found.withColumn("kw_hits", F.array_join("kw_hits", ","))


def ag21_footers(spark: SparkSession, sf: str) -> DataFrame:
    """Appendix pages by words or by where pages cease to name the administration."""
    return L.footer_transition(_segment_pages(spark, sf), F.col("page_text").contains("Verwaltung"), window=2, before=0.5, after=0.5)


def cp16_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Reports of all documents, their segments laid end to end as pages."""
    order = Window.partitionBy("document_id").orderBy("start_page", "id")
    kept = table(spark, sf, "segments").where("start_page is not null").withColumn("page", F.row_number().over(order))
    pages = kept.select("document_id", F.col("page").alias("page_no"), F.col("text_full").alias("page_text"))
    placed = kept.withColumns({"start_page": F.col("page"), "end_page": F.col("page"), "start_char": F.lit(0), "end_char": F.length(F.coalesce("text_full", F.lit("")))})
    return VR.validate(placed, table(spark, sf, "raw_documents"), pages)[1]


def ss1_request_windows(spark: SparkSession, sf: str) -> DataFrame:
    from minuteworks.streaming.ratelimit import windowed_counts

    return windowed_counts(table(spark, sf, "events").select(F.col("ts"), F.col("user_id").cast("string").alias("ip_hash"))).select("ip_hash", F.col("window_start"), "n", "allowed")


_SPAN = """WITH s AS (SELECT g.*, d.pages_total, coalesce(text_full, '') AS txt, row(start_page, start_char) AS b, row(end_page, end_char) AS f
    FROM segments g JOIN raw_documents d ON d.id = g.document_id WHERE start_page IS NOT NULL AND end_page IS NOT NULL),
    t AS (SELECT *, lag(end_page) OVER w AS lp, lag(end_char) OVER w AS lc, lead(top_key) OVER w AS nk, lead(id) OVER w AS later FROM s WHERE seg_type = 'top' WINDOW w AS (PARTITION BY document_id ORDER BY start_page, start_char, id)),
    e AS (SELECT *, lag(end_page) OVER w AS lp, lag(end_char) OVER w AS lc FROM s WINDOW w AS (PARTITION BY document_id ORDER BY start_page, start_char, id)),
    x AS (SELECT document_id, min(start_page * 10000000 + start_char) AS fb, max(end_page * 10000000 + end_char) AS lf FROM s WHERE seg_type = 'top' GROUP BY 1),
    i AS (SELECT document_id, 'OUT_OF_BOUNDS_START' AS issue FROM t WHERE start_page < 1 OR start_page > pages_total
      UNION ALL SELECT document_id, 'OUT_OF_BOUNDS_END' FROM t WHERE end_page < 1 OR end_page > pages_total
      UNION ALL SELECT document_id, 'OVERLAP_BETWEEN_TOPS' FROM t WHERE lp > start_page OR (lp = start_page AND lc > start_char)
      UNION ALL SELECT document_id, 'GAP_BETWEEN_TOPS' FROM t WHERE lp + 1 < start_page
      UNION ALL SELECT document_id, 'TOP_TOO_SHORT' FROM t WHERE length(trim(txt)) < 20
      UNION ALL SELECT document_id, 'LEAK_NEXT_TOP_EARLY' FROM t WHERE nk IS NOT NULL AND regexp_matches(substring(txt, 1, 1400), '(?m)^TOP\\s*' || replace(nk, '.', '\\.') || '\\b')
      UNION ALL SELECT document_id, 'TRAILING_GAP_AFTER_LAST_TOP' FROM t WHERE later IS NULL AND end_page + 1 < pages_total
      UNION ALL SELECT s.document_id, 'VORWORT_OVERLAPS_TOP1' FROM s JOIN x USING (document_id) WHERE seg_type = 'vorwort' AND end_page * 10000000 + end_char > fb
      UNION ALL SELECT s.document_id, 'NACHWORT_OVERLAPS_LAST_TOP' FROM s JOIN x USING (document_id) WHERE seg_type = 'nachwort' AND start_page * 10000000 + start_char < lf
      UNION ALL SELECT document_id, 'OVERLAP_BETWEEN_SEGMENTS' FROM e WHERE lp > start_page OR (lp = start_page AND lc > start_char))"""
_COST = " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.PENALTIES.items())
_SEV = ", ".join(f"'{x}'" for x in V.SEVERE)

SQL = {
    "flt1_documents": "SELECT id, meeting_date FROM raw_documents WHERE gremium_key = 'rat' AND year(meeting_date) BETWEEN 2015 AND 2022",
    "flt2_3_searchable": "SELECT seg_type, count(*) AS n FROM segments WHERE embedding IS NOT NULL AND length(trim(coalesce(text_full, ''), ' ')) >= 20 GROUP BY 1",
    "flt4_contains": "SELECT id FROM segments WHERE text_full ILIKE '%radweg%'",
    "flt10_search_logs": "SELECT id FROM chat_logs WHERE coalesce(contains(lower(query), 'spielplatz'), false) OR coalesce(contains(lower(answer), 'spielplatz'), false) OR coalesce(contains(lower(condensed_query), 'spielplatz'), false)",
    "flt13_attendance_lines": "SELECT a.id, concat_ws(' ', nullif(salutation, ''), last_name_extracted) || ' (' || coalesce(faction_extracted, 'keine Fraktion') || ') – Sitzung vom ' || coalesce(strftime(meeting_date, '%Y-%m-%d'), '?') AS line FROM document_attendance_rows a JOIN raw_documents d ON d.id = a.document_id",
    "src3_page_merge": """WITH a AS (SELECT document_id, start_page AS page_no, max(text_full) AS a FROM segments WHERE start_page IS NOT NULL AND id % 2 = 0 GROUP BY 1, 2),
        b AS (SELECT document_id, start_page AS page_no, max(text_full) AS b FROM segments WHERE start_page IS NOT NULL AND id % 3 = 0 GROUP BY 1, 2)
        SELECT document_id, page_no, coalesce(nullif(a, ''), b) AS page_text FROM a FULL JOIN b USING (document_id, page_no)""",
    "src3_pages": f"""WITH p AS (SELECT document_id::VARCHAR AS path, start_page AS page_no,
            coalesce(string_agg(text_full, chr(10) ORDER BY id) FILTER (WHERE trim(text_full) <> ''), string_agg(title, chr(10) ORDER BY id) FILTER (WHERE trim(title) <> ''), '') AS text_full
        FROM segments WHERE start_page IS NOT NULL GROUP BY 1, 2) SELECT path, page_no, {QT._FN1} AS page_text FROM p""",
    "src13_replace_documents": """WITH g AS (SELECT gremium_key, file_hash_sha256, min(id) AS lo, max(id) AS hi, count(*) AS n FROM raw_documents GROUP BY 1, 2),
        k AS (SELECT CASE WHEN n > 1 THEN hi ELSE lo END AS id, n, lo FROM g),
        a AS (SELECT document_id, count(*) AS c FROM document_agenda_items WHERE document_id NOT IN (SELECT lo FROM g WHERE n > 1) AND document_id NOT IN (SELECT hi FROM g WHERE n > 1) GROUP BY 1
              UNION ALL SELECT document_id, count(*) * (1 + (document_id NOT IN (SELECT lo FROM g WHERE n > 1))::INT) FROM document_agenda_items WHERE document_id IN (SELECT hi FROM g WHERE n > 1) GROUP BY 1)
        SELECT k.id, coalesce(c, 0) AS n_agenda FROM k LEFT JOIN a ON a.document_id = k.id""",
    "src17_segment_rows": "SELECT id, CASE WHEN text_full <> '' THEN sha256(text_full) END AS hash, length(text_full)::INT AS n_chars FROM segments",
    "src18_latest_rows": "SELECT id, document_id, row_index FROM (SELECT *, row_number() OVER (PARTITION BY document_id, row_index ORDER BY updated_at DESC NULLS LAST, id DESC) AS n FROM document_agenda_items) WHERE n = 1",
    "src23_export": """SELECT d.id AS document_id, coalesce(a.n, 0)::INT AS n_agenda, coalesce(b.n, 0)::INT AS n_attendance FROM raw_documents d
        LEFT JOIN (SELECT document_id, count(*) n FROM document_agenda_items WHERE section_curated IS NULL OR section_curated <> 'non_public' GROUP BY 1) a ON a.document_id = d.id
        LEFT JOIN (SELECT document_id, count(*) n FROM document_attendance_rows GROUP BY 1) b ON b.document_id = d.id""",
    "src24_registration": "SELECT id, row_number() OVER (PARTITION BY gremium_key, file_hash_sha256 ORDER BY id) > 1 AS is_duplicate FROM raw_documents",
    "jn2_agenda_fanout": "SELECT s.id, a.title_curated FROM segments s LEFT JOIN document_agenda_items a ON a.document_id = s.document_id AND a.top_key_curated = s.top_key",
    "jn4_attendance_star": "SELECT gremium_key, year(meeting_date)::INT AS year, count(*) AS n, count(DISTINCT last_name_extracted) AS n_names FROM document_attendance_rows a JOIN raw_documents d ON d.id = a.document_id GROUP BY 1, 2",
    "jn6_documents_without_annex": "SELECT id FROM raw_documents d WHERE NOT EXISTS (SELECT 1 FROM segments s WHERE s.document_id = d.id AND s.seg_type = 'anhang')",
    "jn7_documents_with_agenda": "SELECT id FROM raw_documents d WHERE EXISTS (SELECT 1 FROM document_agenda_items a WHERE a.document_id = d.id)",
    "jn9_unrated": "SELECT l.id FROM chat_logs l LEFT JOIN chat_feedback f ON f.chat_log_id = l.id WHERE f.id IS NULL",
    "jn10_ratings_of_logs": "WITH f AS (SELECT chat_log_id, rating FROM (SELECT *, row_number() OVER (PARTITION BY chat_log_id ORDER BY created_at DESC NULLS LAST, id DESC) n FROM chat_feedback) WHERE n = 1) SELECT l.id, f.rating FROM chat_logs l LEFT JOIN f ON f.chat_log_id = l.id",
    "jn10_ratings_fanout": "SELECT rating, count(*) AS n, count(DISTINCT l.id) AS n_logs FROM chat_logs l LEFT JOIN chat_feedback f ON f.chat_log_id = l.id GROUP BY 1",
    "jn13_page_ranges": """WITH p AS (SELECT DISTINCT document_id, start_page FROM segments WHERE start_page IS NOT NULL),
        m AS (SELECT p.document_id, p.start_page, arg_min(t.top_key, row(t.start_page, t.id)) AS top_key FROM p JOIN segments t ON t.document_id = p.document_id AND t.seg_type = 'top' AND t.top_key IS NOT NULL AND p.start_page BETWEEN t.start_page AND t.end_page GROUP BY 1, 2)
        SELECT p.document_id, p.start_page, m.top_key FROM p LEFT JOIN m ON m.document_id = p.document_id AND m.start_page = p.start_page""",
    "jn16_filename_ids": "SELECT source_filename, max(id) AS download_id FROM raw_documents GROUP BY 1",
    "ag1_bodies": "SELECT gremium_key, gremium_name, count(*) AS n, max(meeting_date) AS last_meeting FROM raw_documents GROUP BY 1, 2",
    "ag2_pivot": "SELECT document_id, " + ", ".join(f"max(CASE WHEN seg_type = '{x}' THEN confidence END) AS {x}" for x in ("vorwort", "top", "nachwort", "anhang")) + " FROM segments GROUP BY 1",
    "ag3_5_8_totals": "SELECT count(*) AS n_logs, count(DISTINCT session_id) AS n_sessions, round(coalesce(avg(elapsed_ms), 0), 3) AS mean_ms FROM chat_logs",
    "ag4_per_day": "SELECT created_at::DATE AS day, count(*) AS n FROM chat_logs GROUP BY 1",
    "ag6_ratings": "SELECT sum(CASE WHEN rating = 1 THEN 1 ELSE 0 END)::BIGINT AS up, sum(CASE WHEN rating = -1 THEN 1 ELSE 0 END)::BIGINT AS down FROM chat_feedback",
    "ag7_top_bodies": "SELECT coalesce(gremium_key, '(alle)') AS gremium_key, count(*) AS n FROM chat_logs GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10",
    "ag14_best_per_key": "SELECT document_id, top_key, arg_max(id, coalesce(match_score, -1) * 100000000 + id) AS best, max(match_score) AS score FROM segments GROUP BY 1, 2",
    "ag18_agenda_lists": "SELECT document_id, string_agg(coalesce(title_curated, ''), '|' ORDER BY row_index, id) AS titles FROM document_agenda_items GROUP BY 1",
    "ag19_coverage": "SELECT document_id, round(avg((start_page IS NOT NULL)::INT), 6) AS span_coverage, round(avg((length(text_full) > 0)::INT), 6) AS text_coverage FROM segments WHERE seg_type = 'top' GROUP BY 1",
    "ag25_missing_embeddings": "SELECT document_id, count(*) FILTER (WHERE embedding IS NULL) AS n_missing FROM segments WHERE length(trim(coalesce(text_full, ''), ' ')) >= 20 GROUP BY 1",
    "ag27_nested_maps": "WITH c AS (SELECT session_id, coalesce(quality, '-') AS q, count(*) AS n FROM chat_logs GROUP BY 1, quality) SELECT session_id, string_agg(q || '=' || n, ',' ORDER BY q, n) AS usage FROM c GROUP BY 1",
    "wn8_overlaps": "SELECT id, document_id, before FROM (SELECT *, lag(end_page) OVER (PARTITION BY document_id ORDER BY start_page, start_char, id) AS before FROM segments WHERE start_page IS NOT NULL AND end_page IS NOT NULL) WHERE before > start_page",
    "wn11_monotone_pages": "SELECT id, document_id, max(start_page) OVER (PARTITION BY document_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS start_page FROM segments WHERE start_page IS NOT NULL",
    "wn12_last_turns": "SELECT id, session_id, substring(query, 1, 300) AS query FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS n FROM chat_logs) WHERE n <= 12",
    "wn13_first_last": "SELECT document_id, arg_min(id, start_page * 1e15 + start_char * 1e7 + id) AS first_id, arg_max(id, end_page * 1e15 + end_char * 1e7 + id) AS last_id FROM segments WHERE start_page IS NOT NULL AND end_page IS NOT NULL GROUP BY 1",
    "jn15_next_found": "SELECT id, first_value(top_key IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_top_key FROM segments",
    "so4_newest_documents": "SELECT id, meeting_date FROM raw_documents ORDER BY meeting_date DESC NULLS FIRST, id LIMIT 8",
    "so6_page": "SELECT id, created_at FROM chat_logs ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 15 OFFSET 30",
    "st1_union": "SELECT kind, day, count(*) AS n FROM (SELECT 'log' AS kind, created_at::DATE AS day FROM chat_logs UNION ALL SELECT 'feedback', created_at::DATE FROM chat_feedback) GROUP BY 1, 2",
    "st3_ordered_distinct": "WITH w AS (SELECT id, list_filter(string_split(lower(title_curated), ' '), lambda w: w <> '') AS a FROM document_agenda_items WHERE title_curated IS NOT NULL) SELECT id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ' ') AS words FROM w",
    "cp16_issues": _SPAN + " SELECT issue, count(*) AS n FROM i GROUP BY 1",
    "cp16_scores": _SPAN + f""", p AS (SELECT document_id, sum(CASE issue {_COST} ELSE 0 END) AS penalty, count(*) FILTER (WHERE issue IN ({_SEV})) AS sev, count(*) AS n FROM i GROUP BY 1),
        c AS (SELECT document_id, count(*) AS n_tops, avg((start_page IS NOT NULL)::INT) AS covered FROM segments WHERE seg_type = 'top' GROUP BY 1),
        r AS (SELECT c.*, coalesce(n, 0) AS n_issues, coalesce(sev, 0) AS n_severe, 100.0::DOUBLE - coalesce(penalty, 0) - CASE WHEN covered < 1 THEN 15 + greatest(0.0, (0.90 - covered) * 60) ELSE 0 END AS raw FROM c LEFT JOIN p USING (document_id))
        SELECT document_id, n_tops, n_issues, n_severe, round(covered, 4) AS covered, round(greatest(0.0, least(100.0, raw)), 4) AS score,
               CASE WHEN n_severe > 0 THEN 'broken' WHEN raw >= 90 AND covered >= 0.85 THEN 'accept' ELSE 'need_spans' END AS recommendation FROM r""",
    "fn31_content_start": """WITH p AS (SELECT document_id, id AS page_no, coalesce(text_full, '') AS t FROM segments),
        f AS (SELECT document_id, coalesce(min(page_no) FILTER (WHERE regexp_matches(t, '(?m)^\\s*[-–—]\\s*\\d{1,3}\\s*[-–—]\\s*$')), min(page_no) FILTER (WHERE regexp_matches(t, '(?i)\\bseite\\s+\\d{1,3}\\b')), 1)::INT AS start_page FROM p GROUP BY 1)
        SELECT document_id, start_page, (SELECT min(page_no)::INT FROM p WHERE p.document_id = f.document_id AND page_no > start_page AND regexp_matches(t, '(?mi)^\\s*(?:anlage|anlagen|anhang|appendix)\\b')) AS appendix_page FROM f""",
    "fn32_slices": """WITH p AS (SELECT document_id, id AS page_no, coalesce(text_full, '') AS t FROM segments),
        a AS (SELECT document_id, max(page_no)::INT AS pages_total, (min(page_no) FILTER (WHERE regexp_matches(lower(t), '\\btagesordnung\\b')))::INT AS agenda_page FROM p GROUP BY 1),
        l AS (SELECT document_id, page_no, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM p JOIN a USING (document_id) WHERE page_no > agenda_page),
        h AS (SELECT *, list_position(list_transform(ls, lambda x: regexp_matches(x, '^\\s*1\\s*[\\.\\)]\\s+\\S+') OR regexp_matches(lower(x), '^\\s*top\\s*1\\b')), true)::INT AS line FROM l),
        t AS (SELECT document_id, min(page_no)::INT AS top1_page, arg_min(line, page_no) AS top1_line, arg_min(lower(array_to_string(list_slice(ls, line, line + 34), chr(10))), page_no) AS near FROM h WHERE line > 0 GROUP BY 1)
        SELECT a.document_id, pages_total, agenda_page, top1_page, top1_line,
               concat_ws(',', CASE WHEN contains(near, 'berichterstatter') THEN 'berichterstatter' END, CASE WHEN contains(near, 'beschluss') THEN 'beschluss' END, CASE WHEN contains(near, 'vorlage') THEN 'vorlage' END, CASE WHEN contains(near, 'öffentlich') THEN 'öffentlich' END) AS kw_hits,
               CASE WHEN agenda_page IS NULL THEN pages_total WHEN top1_page IS NULL THEN agenda_page WHEN top1_line > 1 THEN top1_page ELSE top1_page - 1 END AS slice_end, coalesce(top1_line > 1, false) AS contaminated
        FROM a LEFT JOIN t USING (document_id)""",
    "ag21_footers": """WITH p AS (SELECT document_id, id AS page_no, coalesce(text_full, '') AS t, coalesce(contains(text_full, 'Verwaltung'), false)::INT AS has, list_slice(list_filter(string_split(coalesce(text_full, ''), chr(10)), lambda x: trim(x, ' ') <> ''), 1, 3) AS head FROM segments),
        w AS (SELECT *, row_number() OVER o AS pos, count(*) OVER (PARTITION BY document_id) AS pages, avg(has) OVER (PARTITION BY document_id ORDER BY page_no ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS pre,
               avg(has) OVER (PARTITION BY document_id ORDER BY page_no ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS post, sum(length(t)) OVER (PARTITION BY document_id ORDER BY page_no ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS ahead,
               len(list_filter(head, lambda x: regexp_matches(x, '(?i)^\\s*(?:anlage|anhang|appendix)\\b'))) > 0 AS headed FROM p WINDOW o AS (PARTITION BY document_id ORDER BY page_no)),
        m AS (SELECT document_id, min(page_no) FILTER (WHERE headed) AS word, min(page_no) FILTER (WHERE pos > 2 AND pos < pages - 2 AND pages >= 4 AND pre >= 0.5 AND post <= 0.5 AND ahead >= 400) AS foot FROM w WHERE pos > 1 GROUP BY 1)
        SELECT document_id, coalesce(word, foot) AS appendix_page FROM m WHERE coalesce(word, foot) IS NOT NULL""",
    "ss1_request_windows": "SELECT user_id::VARCHAR AS ip_hash, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n, count(*) <= 15 AS allowed FROM events GROUP BY 1, 2",
}
QUERIES = {name: globals()[name] for name in (*SQL, "cp16_validation")}
