"""Queries over the retrieval channels, fusion, boosts and caps, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from minuteworks.plans import queries_text as QT, retrieve as P
from minuteworks.session import table

#: The question of these queries: its text, terms and lexemes; its vector is the first usable one.
TEXT, TERMS, LEXEMES = "Was ist der aktuelle Stand der Sanierung der Turnhalle?", ("sanierung", "turnhalle"), ("verwaltung", "turnhall")
VECTOR = "SELECT embedding FROM segments WHERE embedding IS NOT NULL AND len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0 AND NOT isnan(list_sum(embedding)) ORDER BY id LIMIT 1"
N = 140


def _tables(spark: SparkSession, sf: str) -> tuple[DataFrame, ...]:
    return tuple(table(spark, sf, t) for t in ("segments", "raw_documents", "document_agenda_items", "document_attendance_rows"))


def _vector(segments: DataFrame) -> list[float]:
    usable = segments.where((F.size("embedding") == 64) & ~F.exists("embedding", lambda x: F.isnan(x) | x.isNull()) & F.exists("embedding", lambda x: x != 0))
    first = usable.orderBy("id").select("embedding").first()
    return list(first["embedding"]) if first else [1.0] + [0.0] * 63


def _query(segments: DataFrame, **options) -> P.Query:
    return P.Query(text=TEXT, vectors=(_vector(segments),), terms=TERMS, **options)


def _show(hits: DataFrame) -> DataFrame:
    return hits.select("source", "id", "document_id", F.round("score", 6).alias("score"), "rank")


def cp1_dense(spark: SparkSession, sf: str) -> DataFrame:
    segments, documents, *_ = _tables(spark, sf)
    q = _query(segments)
    sound = segments.where(~F.exists("embedding", lambda x: F.isnan(x)))
    return _show(P.dense(P.segment_items(sound), P.filtered_documents(documents, q), q.vectors[0], N))


def cp3_sparse(spark: SparkSession, sf: str) -> DataFrame:
    segments, documents, agenda, _ = _tables(spark, sf)
    return _show(P.sparse(P.segment_items(segments), agenda, P.filtered_documents(documents, _query(segments)), LEXEMES, N))


def cp4_trigram(spark: SparkSession, sf: str) -> DataFrame:
    segments, documents, *_ = _tables(spark, sf)
    return _show(P.trigram(P.segment_items(segments), P.filtered_documents(documents, _query(segments)), TERMS, N))


def cp5_backfill(spark: SparkSession, sf: str) -> DataFrame:
    segments, documents, *_ = _tables(spark, sf)
    return _show(P.backfill(P.segment_items(segments), P.filtered_documents(documents, _query(segments)), TERMS))


def cp6_structured(spark: SparkSession, sf: str) -> DataFrame:
    _, documents, _, attendance = _tables(spark, sf)
    found = P.structured(attendance, P.filtered_documents(documents, P.Query(TEXT)), factions=("Grüne Stadtliste", "GSL"), person="brook")
    return found.select("id", "document_id", "person", "faction")


def cp8_ambiguity(spark: SparkSession, sf: str) -> DataFrame:
    _, documents, _, attendance = _tables(spark, sf)
    docs = P.filtered_documents(documents, P.Query(TEXT))
    return P.ambiguity(P.structured(attendance, docs, person="brook"), table(spark, sf, "gremien"))


def ag15_fusion(spark: SparkSession, sf: str) -> DataFrame:
    segments, documents, agenda, _ = _tables(spark, sf)
    q = _query(segments)
    docs, sound = P.filtered_documents(documents, q), segments.where(F.col("embedding").isNull() | ~F.exists("embedding", lambda x: F.isnan(x)))
    items = P.segment_items(sound)
    fused = P.fuse([(P.dense(items, docs, q.vectors[0], N), P.RRF["dense"]), (P.sparse(items, agenda, docs, LEXEMES, N), P.RRF["sparse"]), (P.trigram(items, docs, TERMS, N), P.RRF["trigram"])])
    return fused.select("source", "id", F.round("rrf_score", 9).alias("rrf_score"))


def cp10_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    segments, documents, agenda, _ = _tables(spark, sf)
    sound = segments.where(F.col("embedding").isNull() | ~F.exists("embedding", lambda x: F.isnan(x)))
    return P.retrieve(_query(segments, mode="recent"), sound, documents, agenda, lexemes=LEXEMES, current=True)


def cp10_retrieve_filtered(spark: SparkSession, sf: str) -> DataFrame:
    segments, documents, agenda, attendance = _tables(spark, sf)
    sound = segments.where(F.col("embedding").isNull() | ~F.exists("embedding", lambda x: F.isnan(x)))
    return P.retrieve(_query(segments, gremium_key="rat", year_from=2010, year_to=2024), sound, documents, agenda, attendance, lexemes=LEXEMES, top_key="3")


def cp10_search(spark: SparkSession, sf: str) -> DataFrame:
    """The filtered search with attendance rows among its hits."""
    segments, documents, agenda, attendance = _tables(spark, sf)
    sound = segments.where(F.col("embedding").isNull() | ~F.exists("embedding", lambda x: F.isnan(x)))
    return P.search(_query(segments, gremium_key="rat", year_from=2010, year_to=2024), sound, documents, agenda, attendance, lexemes=LEXEMES, top_key="3", person="brook", attendance_question=True)


def cp7_attendance_mode(spark: SparkSession, sf: str) -> DataFrame:
    """Attendance rows among the hits: in front for questions about attendance, else behind, with a boost of their documents."""
    _, documents, _, attendance = _tables(spark, sf)
    fused = ag15_fusion(spark, sf).join(table(spark, sf, "segments").select("id", "document_id"), "id")
    found = P.structured(attendance, P.filtered_documents(documents, P.Query(TEXT)), person="brook")
    parts = [P.merge_structured(fused, found, leads).select(F.lit(leads).alias("leads"), "source", "id", F.round("rrf_score", 9).alias("rrf_score")) for leads in (True, False)]
    return parts[0].unionByName(parts[1])


def cp8_clarify(spark: SparkSession, sf: str) -> DataFrame:
    """A question about a person of several bodies is answered by a question."""
    segments, documents, agenda, attendance = _tables(spark, sf)
    return P.ask(P.Query("Wer war Frau Reuterbrook und welcher Fraktion gehört sie an?"), segments, documents, agenda, attendance).select("source", "clarify")


def cp9_focus(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of the body of the first attendance row."""
    _, documents, _, attendance = _tables(spark, sf)
    docs = P.filtered_documents(documents, P.Query(TEXT))
    fused = ag15_fusion(spark, sf).join(table(spark, sf, "segments").select("id", "document_id"), "id").join(docs.select("document_id", "gremium_key", "meeting_date"), "document_id")
    merged = P.merge_structured(fused, P.structured(attendance, docs, person="brook"), True)
    first = merged.orderBy(F.desc("rrf_score"), F.desc_nulls_first("meeting_date"), "id").select("source", "gremium_key").first()
    return P.focus(merged, first["source"] == "attendance", first["gremium_key"], False).select("source", "id", "gremium_key")


def cp10_ask(spark: SparkSession, sf: str) -> DataFrame:
    """Retrieval from the bare question."""
    segments, documents, agenda, attendance = _tables(spark, sf)
    return P.ask(P.Query("Was ist der aktuelle Stand der Turnhalle?", vectors=(_vector(segments),)), segments, documents, agenda, attendance, synonyms={"Turnhalle": ["Sporthalle"]})


def jn5_enriched(spark: SparkSession, sf: str) -> DataFrame:
    segments, documents, agenda, attendance = _tables(spark, sf)
    hits = cp10_retrieve(spark, sf)
    full = P.enrich(hits, agenda, attendance)
    listed = lambda c, *names: F.coalesce(F.array_join(F.transform(c, lambda x: F.concat_ws("/", *[F.coalesce(x[n], F.lit("-")) for n in names])), "; "), F.lit(""))
    return full.select("id", listed("agenda_full", "key", "title", "paper").alias("agenda"), listed("attendance_full", "name", "faction", "role").alias("attendance"))


_ITEMS = "items AS (SELECT id, document_id, top_key, start_page, text_full AS text, embedding FROM segments WHERE length(trim(coalesce(text_full, ''), ' ')) >= 20)"
_DENSE = f"""dense AS (SELECT i.id, i.document_id, i.top_key, list_cosine_similarity(i.embedding::DOUBLE[], ({VECTOR})::DOUBLE[]) AS score
    FROM items i JOIN docs d ON d.did = i.document_id WHERE i.embedding IS NOT NULL AND len(i.embedding) = 64 AND NOT isnan(list_sum(i.embedding)) AND list_sum(list_transform(i.embedding, lambda x: abs(x))) > 0
    ORDER BY score DESC, i.id LIMIT {N}), dense_r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM dense)"""
_RANK1 = "((SELECT coalesce(list_sum(list_transform(range(1, a{n} + 1), lambda j: 1.0::DOUBLE / (j * j))), 0)) + 0.4 * coalesce(list_sum(list_transform(range(a{n} + 1, a{n} + b{n} + 1), lambda j: 1.0::DOUBLE / (j * j))), 0))"
_SPARSE = (
    "titles AS (SELECT document_id, top_key_curated AS top_key, arg_min(title_curated, row_index * 10000000 + id) AS title FROM document_agenda_items WHERE top_key_curated IS NOT NULL GROUP BY 1, 2), "
    "lex AS (SELECT i.id, i.document_id, i.top_key, " + QT.SQL_LEX.format(c="coalesce(t.title, '')") + " AS tl, " + QT.SQL_LEX.format(c="coalesce(i.text, '')") + " AS bl FROM items i JOIN docs d ON d.did = i.document_id LEFT JOIN titles t ON t.document_id = i.document_id AND t.top_key = i.top_key), "
    "cnt AS (SELECT id, document_id, top_key, " + ", ".join(f"len(list_filter(tl, lambda w: w = '{x}')) AS a{n}, len(list_filter(bl, lambda w: w = '{x}')) AS b{n}" for n, x in enumerate(LEXEMES)) + " FROM lex), "
    "sparse AS (SELECT id, document_id, top_key, (" + " + ".join(_RANK1.format(n=n) for n in range(len(LEXEMES))) + f") / 1.64493406685 / {len(LEXEMES)} AS score FROM cnt WHERE " + " AND ".join(f"a{n} + b{n} > 0" for n in range(len(LEXEMES))) + f" ORDER BY score DESC, id LIMIT {N}), "
    "sparse_r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM sparse)"
)
_TRI = (
    "grams AS (SELECT i.id, i.document_id, i.top_key, lower(i.text) AS low, " + QT.SQL_GRAMS.format(c="i.text") + " AS g FROM items i JOIN docs d ON d.did = i.document_id), "
    "sims AS (SELECT id, document_id, top_key, " + ", ".join(f"len(list_intersect(g, {QT.SQL_GRAMS.format(c=repr(t))})) / nullif(len(list_distinct(list_concat(g, {QT.SQL_GRAMS.format(c=repr(t))}))), 0)::DOUBLE AS s{n}, contains(low, '{t}') AS c{n}" for n, t in enumerate(TERMS)) + " FROM grams), "
    "tri AS (SELECT id, document_id, top_key, greatest(" + ", ".join(f"CASE WHEN s{n} >= 0.3 OR c{n} THEN s{n} END" for n in range(len(TERMS))) + ") AS score FROM sims WHERE " + " OR ".join(f"s{n} >= 0.3 OR c{n}" for n in range(len(TERMS))) + f" ORDER BY score DESC, id LIMIT {N}), "
    "tri_r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM tri)"
)
_BACK = (
    "newest AS (SELECT did FROM docs ORDER BY meeting_date DESC NULLS FIRST, did LIMIT 8), "
    "back AS (SELECT i.id, i.document_id, i.top_key, i.start_page, d.meeting_date, 0.2 AS score FROM items i JOIN docs d ON d.did = i.document_id WHERE d.did IN (SELECT did FROM newest) AND ("
    + " OR ".join(f"contains(lower(i.text), '{t}')" for t in TERMS) + ") ORDER BY d.meeting_date DESC NULLS FIRST, i.start_page ASC NULLS LAST, i.id LIMIT 30), "
    "back_r AS (SELECT *, row_number() OVER (ORDER BY meeting_date DESC NULLS FIRST, start_page ASC NULLS LAST, id) AS rank FROM back)"
)
_DOCS = "docs AS (SELECT id AS did, gremium_key, meeting_date FROM raw_documents{where})"
_RRF = "parts AS (SELECT id, 1.0::DOUBLE / (60 + rank) AS p FROM dense_r UNION ALL SELECT id, 1.0::DOUBLE / (40 + rank) FROM sparse_r UNION ALL SELECT id, 1.0::DOUBLE / (45 + rank) FROM tri_r{more}), fused AS (SELECT id, sum(p) AS rrf FROM parts GROUP BY 1)"
_FINAL = """hits AS (SELECT f.id, s.document_id, s.top_key, d.gremium_key, d.meeting_date, f.rrf, {back} AS bf, f.rrf + 0.08 + {key} + {named}
        + CASE WHEN d.meeting_date IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, 1 - date_diff('day', d.meeting_date, DATE '2026-01-01') / 365.0::DOUBLE)) END * {recency} AS fin
      FROM fused f JOIN segments s USING (id) JOIN docs d ON d.did = s.document_id),
    one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, top_key ORDER BY fin DESC, id) AS n FROM hits WHERE top_key IS NOT NULL) WHERE n = 1),
    capped AS (SELECT id, document_id, top_key, gremium_key, meeting_date, rrf, bf, fin FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY fin DESC, id) AS m FROM one) WHERE m <= 3
               UNION ALL SELECT id, document_id, top_key, gremium_key, meeting_date, rrf, bf, fin FROM hits WHERE top_key IS NULL),
    best AS (SELECT 'segment' AS source, id, document_id, top_key, gremium_key, meeting_date, round(rrf, 9) AS rrf_score, round(fin, 9) AS final_score, bf AS is_backfill FROM capped ORDER BY fin DESC, id LIMIT 10)"""
_ALL = f"WITH {_DOCS.format(where='')}, {_ITEMS}, {_DENSE}, {_SPARSE}, {_TRI}, {_BACK}"
_SHOW = "SELECT 'segment' AS source, id, document_id, round(score, 6) AS score, rank::INT AS rank FROM "
_ATT = """att AS (SELECT a.id, document_id, coalesce(last_name_curated, last_name_extracted) AS person, coalesce(faction_curated, faction_extracted) AS faction, meeting_date, gremium_key FROM document_attendance_rows a JOIN docs d ON d.did = a.document_id)"""
_RETRIEVE = _ALL + ", " + _RRF.format(more=" UNION ALL SELECT id, 1.0::DOUBLE / (45 + rank) FROM back_r") + ", " + _FINAL.format(back="f.id IN (SELECT id FROM back_r)", key="0", named="0", recency="0.5")
_FILTER = f"WITH {_DOCS.format(where=chr(32) + 'WHERE gremium_key = ' + repr('rat') + ' AND year(meeting_date) BETWEEN 2010 AND 2024')}, {_ITEMS}, {_DENSE}, {_SPARSE}, {_TRI}, {_ATT}, named AS (SELECT DISTINCT document_id FROM (SELECT * FROM att WHERE contains(lower(person), '{TERMS[0]}') ORDER BY meeting_date DESC NULLS FIRST, id LIMIT 20))"

SQL = {
    "cp1_dense": _ALL + " " + _SHOW + "dense_r",
    "cp3_sparse": _ALL + " " + _SHOW + "sparse_r",
    "cp4_trigram": _ALL + " " + _SHOW + "tri_r",
    "cp5_backfill": _ALL + " " + _SHOW + "back_r",
    "cp6_structured": f"WITH {_DOCS.format(where='')}, {_ATT} SELECT id, document_id, person, faction FROM att WHERE (contains(lower(faction), 'grüne stadtliste') OR contains(lower(faction), 'gsl')) AND contains(lower(person), 'brook') ORDER BY meeting_date DESC NULLS FIRST, id LIMIT 20",
    "cp8_ambiguity": f"WITH {_DOCS.format(where='')}, {_ATT}, f AS (SELECT * FROM att WHERE contains(lower(person), 'brook') ORDER BY meeting_date DESC NULLS FIRST, id LIMIT 20), b AS (SELECT DISTINCT g.gremium_key, g.gremium_name FROM f JOIN gremien g USING (gremium_key)) SELECT * FROM b WHERE (SELECT count(*) FROM b) > 1",
    "ag15_fusion": _ALL + ", " + _RRF.format(more="") + " SELECT 'segment' AS source, id, round(rrf, 9) AS rrf_score FROM fused",
    "cp10_retrieve": _RETRIEVE + " SELECT * FROM best",
    "cp10_retrieve_filtered": _FILTER + ", " + _RRF.format(more="") + ", " + _FINAL.format(back="false", key="CASE WHEN s.top_key = '3' THEN 0.05 ELSE 0 END", named="CASE WHEN s.document_id IN (SELECT document_id FROM named) THEN 0.08 ELSE 0 END", recency="0.05") + " SELECT * FROM best",
    "jn5_enriched": _RETRIEVE + """ SELECT b.id,
        coalesce((SELECT string_agg(coalesce(top_key_curated, '-') || '/' || coalesce(title_curated, '-') || '/' || coalesce(drucksache_curated, '-'), '; ' ORDER BY row_index, a.id) FROM document_agenda_items a WHERE a.document_id = b.document_id), '') AS agenda,
        coalesce((SELECT string_agg(coalesce(last_name_extracted, '-') || '/' || coalesce(faction_extracted, '-') || '/' || coalesce(role_extracted, '-'), '; ' ORDER BY row_index, a.id) FROM document_attendance_rows a WHERE a.document_id = b.document_id), '') AS attendance FROM best b""",
    "cp7_attendance_mode": _ALL + ", " + _RRF.format(more="") + f""", {_ATT}, f AS (SELECT * FROM att WHERE contains(lower(person), 'brook') ORDER BY meeting_date DESC NULLS FIRST, id LIMIT 20)
        SELECT true AS leads, 'segment' AS source, id, round(rrf, 9) AS rrf_score FROM fused UNION ALL SELECT true, 'attendance', id, 1.0 FROM f
        UNION ALL SELECT false, 'segment', u.id, round(rrf + CASE WHEN s.document_id IN (SELECT document_id FROM f) THEN 0.08 ELSE 0 END, 9) FROM fused u JOIN segments s USING (id) UNION ALL SELECT false, 'attendance', id, 0.1 FROM f""",
    "cp8_clarify": f"""WITH {_DOCS.format(where='')}, {_ATT}, f AS (SELECT * FROM att WHERE contains(lower(person), 'reuterbrook') ORDER BY meeting_date DESC NULLS FIRST, id LIMIT 20),
        b AS (SELECT gremium_key, coalesce(max(gremium_name), 'unbekannt') AS name FROM raw_documents WHERE gremium_key IN (SELECT gremium_key FROM f) GROUP BY 1)
        SELECT 'clarify' AS source, string_agg(name, '; ' ORDER BY name) AS clarify FROM b HAVING count(*) > 1""",
    "cp9_focus": _ALL + ", " + _RRF.format(more="") + f""", {_ATT}, f AS (SELECT * FROM att WHERE contains(lower(person), 'brook') ORDER BY meeting_date DESC NULLS FIRST, id LIMIT 20),
        m AS (SELECT 'segment' AS source, u.id, d.gremium_key FROM fused u JOIN segments s USING (id) JOIN docs d ON d.did = s.document_id UNION ALL SELECT 'attendance', id, gremium_key FROM f)
        SELECT source, id, gremium_key FROM m WHERE gremium_key = (SELECT gremium_key FROM f ORDER BY meeting_date DESC NULLS FIRST, id LIMIT 1)""",
}
QUERIES = {name: globals()[name] for name in (*SQL, "cp10_search", "cp10_ask")}
