"""Queries over surveys, caps, preferences, selection, triage and variants of searches, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from minuteworks.functions import similarity as S
from minuteworks.operators import analytics as A, validation as V
from minuteworks.plans import queries_retrieval as QR, retrieve as P
from minuteworks.session import table


def _responses(spark: SparkSession, sf: str) -> DataFrame:
    """Survey answers made from events: ten usability items, two of seven points, one of ten."""
    item, turn = F.col("event_id") % 13, F.floor(F.col("event_id") / 13)
    key = F.when(item < 10, F.concat(F.lit("sus_"), (item + 1).cast("string"))).when(item == 10, "umux_1").when(item == 11, "umux_2").otherwise("nps")
    value = F.when(item < 10, turn % 5 + 1).when(item < 12, turn % 7 + 1).otherwise(turn % 11)
    return table(spark, sf, "events").select((F.col("user_id") % 97).cast("string").alias("session_token"), key.alias("question_key"), value.cast("double").alias("answer_numeric"), F.lit(None).cast("string").alias("answer_text"))


def ag10_likert(spark: SparkSession, sf: str) -> DataFrame:
    return A.likert(_responses(spark, sf))


def ag11_sus(spark: SparkSession, sf: str) -> DataFrame:
    return A.sus(_responses(spark, sf))


def ag12_umux_lite(spark: SparkSession, sf: str) -> DataFrame:
    one = _responses(spark, sf).groupBy("session_token", "question_key").agg(F.max("answer_numeric").alias("answer_numeric"))
    return A.umux_lite(one)


def ag13_nps(spark: SparkSession, sf: str) -> DataFrame:
    return A.nps(_responses(spark, sf))


def src25_survey_table(spark: SparkSession, sf: str) -> DataFrame:
    one = _responses(spark, sf).groupBy("session_token", "question_key").agg(F.max("answer_numeric").alias("answer_numeric"), F.max("answer_text").alias("answer_text"))
    return A.survey_table(one, ["nps", "umux_1", "umux_2"])


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Hits made from segments: every second one a chunk, scores from the match."""
    s = table(spark, sf, "segments")
    score = F.round(F.coalesce(F.col("match_score"), F.lit(0)).cast("double") / 100 + F.col("id") * 1e-7, 9)
    return s.select(F.when(F.col("id") % 2 == 0, "chunk").otherwise("segment").alias("source"), "id", "document_id", F.when(F.col("id") % 11 != 0, F.col("top_key")).alias("top_key"), score.alias("final_score"))


def wn4_segment_preference(spark: SparkSession, sf: str) -> DataFrame:
    return P.prefer_segments(_scored(spark, sf)).select("source", "id")


def wn5_document_cap(spark: SparkSession, sf: str) -> DataFrame:
    return P.cap_documents(_scored(spark, sf), 3).select("source", "id")


def wn6_source_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "segments").join(table(spark, sf, "raw_documents").select(F.col("id").alias("document_id"), "meeting_date"), "document_id")
    return P.dedupe_sources(rows.select("id", "document_id", "meeting_date", "top_key", F.col("id").alias("rank"))).select("id")


def cp2_multi_dense(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    targets = [list(r["embedding"]) for r in vectors.orderBy("vec_id").select("embedding").limit(3).collect()]
    lists = []
    for i, t in enumerate(targets):
        score = S.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in t]))
        best = vectors.select(F.lit(i).alias("query"), "vec_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(20)
        lists.append(best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))))
    out = lists[0]
    for more in lists[1:]:
        out = out.unionByName(more)
    return out


def ag16_fusion_with_backfill(spark: SparkSession, sf: str) -> DataFrame:
    segments, documents, agenda, _ = QR._tables(spark, sf)
    q = QR._query(segments)
    docs = P.filtered_documents(documents, q)
    items = P.segment_items(segments)
    fused = P.fuse([(P.sparse(items, agenda, docs, QR.LEXEMES, QR.N), P.RRF["sparse"]), (P.trigram(items, docs, QR.TERMS, QR.N), P.RRF["trigram"])])
    return P.add_list(fused, P.backfill(items, docs, QR.TERMS), P.RRF["backfill"]).select("source", "id", F.round("rrf_score", 9).alias("rrf_score"), "is_backfill")


def cp17_best_of(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "segments").where("confidence is not null and match_score is not null")
    verdict = F.when(F.col("id") % 5 == 0, "broken").when(F.col("id") % 5 < 3, "need_spans").otherwise("accept")
    reports = s.select("document_id", F.col("id").alias("attempt"), verdict.alias("recommendation"), F.col("confidence").cast("double").alias("covered"), F.col("match_score").cast("double").alias("score"))
    return V.best_of(reports).select("document_id", "attempt", "recommendation")


def cp20_triage(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "raw_documents")
    tops = table(spark, sf, "segments").where("seg_type = 'top'").groupBy(F.col("document_id").alias("id")).agg(F.count("*").cast("int").alias("top_segments"))
    packages = d.join(tops, "id", "left").select("id", F.coalesce("pipeline_ok", F.lit(False)).alias("ready"), F.col("file_hash_sha256").isNotNull().alias("has_files"), F.col("document_key").isNotNull().alias("valid_json"), "tops_total", "tops_found", "top_segments")
    return V.triage(packages).groupBy("reason_code").agg(F.count("*").alias("n"))


def fn61_period(spark: SparkSession, sf: str) -> DataFrame:
    logs = table(spark, sf, "chat_logs")
    parts = [A.since(logs, p, "2025-06-01 00:00:00").agg(F.count("*").alias("n")).withColumn("period", F.lit(p)) for p in ("24h", "7d", "30d", "all", "x")]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


_RESP = """WITH r AS (SELECT (user_id % 97)::VARCHAR AS session_token, CASE WHEN event_id % 13 < 10 THEN 'sus_' || (event_id % 13 + 1) WHEN event_id % 13 = 10 THEN 'umux_1' WHEN event_id % 13 = 11 THEN 'umux_2' ELSE 'nps' END AS question_key,
    (CASE WHEN event_id % 13 < 10 THEN (event_id // 13) % 5 + 1 WHEN event_id % 13 < 12 THEN (event_id // 13) % 7 + 1 ELSE (event_id // 13) % 11 END)::DOUBLE AS answer_numeric FROM events),
    o AS (SELECT session_token, question_key, max(answer_numeric) AS v FROM r GROUP BY 1, 2)"""
_SPREAD = "round(avg(score), 1) AS mean, round(coalesce(stddev_samp(score), 0), 1) AS sd, min(score) AS least, max(score) AS greatest, count(*) AS n"
_SC = """WITH h AS (SELECT CASE WHEN id % 2 = 0 THEN 'chunk' ELSE 'segment' END AS source, id, document_id, CASE WHEN id % 11 <> 0 THEN top_key END AS top_key, round(coalesce(match_score, 0)::DOUBLE / 100 + id * 1e-7::DOUBLE, 9) AS fs FROM segments)"""
SQL = {
    "ag10_likert": _RESP + " SELECT question_key, answer_numeric, count(*) AS n, round(sum(sum(answer_numeric)) OVER (PARTITION BY question_key) / sum(count(*)) OVER (PARTITION BY question_key), 2) AS mean, sum(count(*)) OVER (PARTITION BY question_key)::BIGINT AS answers FROM r GROUP BY 1, 2",
    "ag11_sus": _RESP + ", s AS (SELECT session_token, sum(CASE WHEN substring(question_key, 5)::INT % 2 = 1 THEN v - 1 ELSE 5 - v END) * 2.5::DOUBLE AS score, count(*) AS c FROM o WHERE question_key LIKE 'sus%' GROUP BY 1) SELECT " + _SPREAD + " FROM s WHERE c = 10",
    "ag12_umux_lite": _RESP + ", s AS (SELECT session_token, (avg(v) - 1) / 6 * 100 AS score, count(*) AS c FROM o WHERE question_key LIKE 'umux%' GROUP BY 1) SELECT " + _SPREAD + " FROM s WHERE c = 2",
    "ag13_nps": _RESP + ", p AS (SELECT count(*) FILTER (WHERE answer_numeric >= 9) AS promoters, count(*) FILTER (WHERE answer_numeric BETWEEN 7 AND 8) AS passives, count(*) FILTER (WHERE answer_numeric < 7) AS detractors, count(*) AS n FROM r WHERE question_key = 'nps') SELECT *, round((promoters - detractors) / nullif(n, 0)::DOUBLE * 100, 1) AS nps FROM p",
    "src25_survey_table": _RESP + " SELECT substring(session_token, 1, 8) AS token, " + ", ".join(f"max(CASE WHEN question_key = '{k}' THEN v END)::DOUBLE::VARCHAR AS {k}" for k in ("nps", "umux_1", "umux_2")) + " FROM o GROUP BY 1",
    "wn4_segment_preference": _SC + """, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, top_key, source ORDER BY fs DESC, id) AS n FROM h WHERE top_key IS NOT NULL) WHERE n = 1),
        p AS (SELECT *, max(CASE WHEN source = 'chunk' THEN fs END) OVER w AS c, max(CASE WHEN source = 'segment' THEN fs END) OVER w AS s FROM b WINDOW w AS (PARTITION BY document_id, top_key)),
        q AS (SELECT *, s IS NOT NULL AND (c IS NULL OR c <= 0 OR (c - s) / c < 0.10) AS wins FROM p)
        SELECT source, id FROM q WHERE CASE WHEN source = 'segment' THEN wins ELSE NOT wins END UNION ALL SELECT source, id FROM h WHERE top_key IS NULL""",
    "wn5_document_cap": _SC + " SELECT source, id FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY fs DESC, source, id) AS n FROM h WHERE top_key IS NOT NULL) WHERE n <= 3 UNION ALL SELECT source, id FROM h WHERE top_key IS NULL",
    "wn6_source_dedupe": "SELECT id FROM (SELECT s.id, row_number() OVER (PARTITION BY s.document_id, meeting_date, top_key ORDER BY s.id) AS n FROM segments s JOIN raw_documents d ON d.id = s.document_id) WHERE n = 1",
    "cp2_multi_dense": """WITH q AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS query, embedding::DOUBLE[] AS t FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 3)),
        s AS (SELECT query, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], t), 6) AS score FROM embeddings, q), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query::INT AS query, vec_id, score, rank::INT AS rank FROM r WHERE rank <= 20""",
    "ag16_fusion_with_backfill": QR._ALL + ", parts AS (SELECT id, 1.0::DOUBLE / (40 + rank) AS p, 0 AS b FROM sparse_r UNION ALL SELECT id, 1.0::DOUBLE / (45 + rank), 0 FROM tri_r UNION ALL SELECT id, 1.0::DOUBLE / (45 + rank), 1 FROM back_r) SELECT 'segment' AS source, id, round(sum(p), 9) AS rrf_score, max(b) = 1 AS is_backfill FROM parts GROUP BY 2",
    "cp17_best_of": """WITH r AS (SELECT document_id, id AS attempt, CASE WHEN id % 5 = 0 THEN 'broken' WHEN id % 5 < 3 THEN 'need_spans' ELSE 'accept' END AS recommendation, confidence::DOUBLE AS covered, match_score::DOUBLE AS score FROM segments WHERE confidence IS NOT NULL AND match_score IS NOT NULL)
        SELECT document_id, attempt, recommendation FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY (recommendation <> 'broken')::INT DESC, CASE recommendation WHEN 'accept' THEN 2 WHEN 'need_spans' THEN 1 ELSE 0 END DESC, covered DESC, score DESC, attempt DESC) AS n FROM r) WHERE n = 1""",
    "cp20_triage": """WITH t AS (SELECT document_id, count(*) AS c FROM segments WHERE seg_type = 'top' GROUP BY 1)
        SELECT CASE WHEN NOT coalesce(pipeline_ok, false) THEN 'not_ready' WHEN file_hash_sha256 IS NULL THEN 'missing_required_file' WHEN document_key IS NULL THEN 'invalid_segments_json' WHEN coalesce(tops_total, 0) <= 0 THEN 'tops_total_invalid'
            WHEN tops_found IS NULL THEN 'tops_found_missing' WHEN tops_found < tops_total THEN 'tops_incomplete' WHEN coalesce(c, 0) < tops_total THEN 'top_segments_missing' ELSE 'ok' END AS reason_code, count(*) AS n
        FROM raw_documents d LEFT JOIN t ON t.document_id = d.id GROUP BY 1""",
    "fn61_period": " UNION ALL ".join(f"SELECT count(*) AS n, '{p}' AS period FROM chat_logs" + (f" WHERE created_at >= TIMESTAMP '2025-06-01' - INTERVAL {d} DAY" if d else "") for p, d in (("24h", 1), ("7d", 7), ("30d", 30), ("all", 0), ("x", 7))),
}
QUERIES = {name: globals()[name] for name in SQL}
