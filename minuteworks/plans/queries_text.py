"""Queries over text functions, with the same computation as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from minuteworks.functions import similarity as S, text as T
from minuteworks.operators import chunking
from minuteworks.plans import retrieve as P
from minuteworks.session import table

TERM = "Sanierung der Turnhalle"
#: A tokenised text, as SQL; DuckDB's pattern language has no look-around.
SQL_WORDS = "list_filter(string_split_regex({c}, '\\s+'), lambda t: t <> '')"
SQL_LEX = (
    "list_transform(list_filter(string_split_regex(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '' AND w NOT IN ("
    + ", ".join(f"'{w}'" for w in S.STOPWORDS) + f")), lambda w: CASE WHEN length(w) >= 6 THEN regexp_replace(w, '{S.SUFFIX}', '') ELSE w END)"
)
SQL_GRAMS = (
    "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), "
    "lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"
)


def fn1_offset_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "segments").select("id", T.offset_normalise(F.col("text_full")).alias("text"))


def fn2_match_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "segments").select("id", T.match_normalise(F.col("text_full")).alias("text"))


def fn3_chunk_clean(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "segments").select("id", T.chunk_clean(F.col("text_full")).alias("text"))


def fn4_clean_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = T.clean_lines(F.col("text_full"))
    return table(spark, sf, "segments").select("id", F.size(lines).alias("n_lines"), F.array_join(lines, "|").alias("lines"))


def fn5_tokens(spark: SparkSession, sf: str) -> DataFrame:
    words = T.tokens(F.col("text"))
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.size(words).alias("n_tokens"), F.array_join(words, " ").alias("joined"))


def fn14_agenda_keys(spark: SparkSession, sf: str) -> DataFrame:
    key = T.agenda_key(F.col("top_key_extracted"))
    return table(spark, sf, "document_agenda_items").select("id", key["num"].alias("num"), key["sub"].alias("sub"), key["suffix"].alias("suffix"), key["norm"].alias("norm"))


def fn15_review_keys(spark: SparkSession, sf: str) -> DataFrame:
    key = T.review_key(F.col("top_key_extracted"))
    return table(spark, sf, "document_agenda_items").select("id", key["num"].alias("num"), key["suffix"].alias("suffix"), key["sub"].alias("sub"), key["norm"].alias("norm"))


def fn16_roles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "document_attendance_rows").groupBy(T.role(F.col("role_extracted")).alias("role")).agg(F.count("*").alias("n"))


def fn17_name_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "document_attendance_rows").select("id", T.name_normalise(F.col("last_name_extracted")).alias("name"))


def fn18_json_fields(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "document_attendance_rows").select("id", T.first_json(F.col("extracted_json"), "funktion", "rolle", "role").alias("role"), T.first_json(F.col("extracted_json"), "anrede").alias("salutation"))


def fn21_title_words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "document_agenda_items").where("title_curated is not null").select("id", F.array_join(T.title_words(F.col("title_curated")), " ").alias("words"))


def fn36_proper_nouns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chat_logs").select("id", F.array_join(T.proper_nouns(F.col("query")), "|").alias("nouns"))


def fn37_query_flags(spark: SparkSession, sf: str) -> DataFrame:
    flags = table(spark, sf, "chat_logs").select(T.query_flags(F.col("query")).alias("f")).select("f.*")
    return flags.groupBy(*flags.columns).agg(F.count("*").alias("n"))


def fn38_query_signals(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chat_logs").select("id", T.query_signals(F.col("query")).alias("s")).select("id", "s.iso_date", "s.paper", "s.multi_doc")


def fn39_detectors(spark: SparkSession, sf: str) -> DataFrame:
    aliases = {"gsl": ("grüne stadtliste", "gsl"), "rsa": ("rote stadtallianz", "rsa"), "lifo": ("liberales forum", "lifo")}
    return table(spark, sf, "chat_logs").select("id", T.detect_faction(F.col("query"), aliases).alias("faction"), T.detect_person(F.col("query"), aliases).alias("person"))


def fn41_recency(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "raw_documents").select("id", F.round(T.linear_recency(F.col("meeting_date"), "2026-01-01"), 6).alias("recency"))


def fn43_cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    target = F.array(*[F.lit(float(x)) for x in vectors.orderBy("vec_id").first()["embedding"]])
    scored = vectors.select("vec_id", F.round(S.cosine(F.col("embedding"), target), 6).alias("score"))
    return scored.where("score is not null").orderBy(F.desc("score"), "vec_id").limit(10)


def fn44_lexeme_rank(spark: SparkSession, sf: str) -> DataFrame:
    query = F.array(*[F.lit(w) for w in ("sanier", "turnhall")])
    docs = table(spark, sf, "documents").where(F.lower("text").contains("sanier") | F.lower("text").contains("turnhall"))
    rank = F.transform(F.array(S.lexemes(F.col("text"))), lambda lex: F.round(S.lexeme_rank(F.array().cast("array<string>"), lex, query), 6))
    return docs.select("doc_id", F.explode(F.filter(rank, lambda x: x > 0)).alias("rank"))


def fn45_trigram_similarity(spark: SparkSession, sf: str) -> DataFrame:
    titles = table(spark, sf, "document_agenda_items").where("title_curated is not null")
    score = F.transform(F.array(S.trigrams(F.col("title_curated"))), lambda g: F.round(S.shared_share(g, TERM), 6))
    return titles.select("id", F.explode(F.filter(score, lambda x: x >= 0.15)).alias("score"))


def fn46_content_terms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chat_logs").select("id", F.array_join(T.content_terms(F.col("query")), "|").alias("terms"))


def fn50_51_gate(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("query")
    return table(spark, sf, "chat_logs").where("query is not null").select("id", T.injection(c).alias("injection"), (F.length(F.trim(c)) < 3).alias("short"))


def so9_candidates(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("query")
    return table(spark, sf, "chat_logs").where("query is not null").select("id", *[P.candidate_count(c, mode).alias(mode) for mode in ("relevant", "recent", "breadth")])


def fn56_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "segments").select("id", T.sha256_text(F.col("text_full")).alias("hash"))


def fn57_58_names_and_previews(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "raw_documents").select("id", T.safe_filename(F.col("source_filename")).alias("name"), T.preview(F.col("source_path"), 12).alias("preview"))


def fn59_query_years(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chat_logs").groupBy(T.query_year(F.col("query")).alias("year")).agg(F.count("*").alias("n"))


def fn60_window_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(T.window_bucket(F.col("ts")).alias("bucket"), "event_type").agg(F.count("*").alias("n"))


def wn7_chunks(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_no"), F.col("text").alias("page_text"))
    return chunking.chunk_pages(pages, size=120, overlap=0.2)


_W = "[\\p{L}\\p{N}_]"
_STRIP = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_FN1 = _STRIP.replace(
    "{c}",
    f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text_full, chr(173), ''), '\\r\\n|\\r|\\f', chr(10), 'g'), '({_W})-\\n({_W})', '\\1\\2', 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')".replace("{{", "{").replace("}}", "}"),
)
_KEY = "regexp_replace(regexp_replace(lower(top_key_extracted), '\\s+', '', 'g'), '^top\\.?|,', '', 'g')"
_PART = "regexp_extract(" + _KEY + ", '^(\\d{1,3})(?:\\.(\\d{1,3}))?\\.?([a-z])?\\.?$', %d)"
_ROLE = """WHEN lower(trim(role_extracted)) IN ('vorsitz', 'verwaltung', 'gast', 'sonstige', 'mitglied', 'rat', 'schriftfuehrung', 'fehlt_entschuldigt', 'fehlt_unentschuldigt') THEN lower(trim(role_extracted))
    WHEN lower(trim(role_extracted)) = 'mitglieder' THEN 'mitglied' WHEN lower(trim(role_extracted)) IN ('mitglied des rates', 'mitglieder des rates') THEN 'rat'
    WHEN lower(trim(role_extracted)) IN ('schriftführer', 'schriftfuehrer', 'schriftfuehrerin', 'schriftführerin') THEN 'schriftfuehrung' WHEN lower(trim(role_extracted)) = 'gäste' THEN 'gast'
    WHEN lower(trim(role_extracted)) IN ('fehlt: entschuldigt', 'fehlt entschuldigt', 'entschuldigt') THEN 'fehlt_entschuldigt'
    WHEN lower(trim(role_extracted)) IN ('fehlt: unentschuldigt', 'fehlt unentschuldigt', 'unentschuldigt') THEN 'fehlt_unentschuldigt'"""
_PLACES = "straße|strasse|weg|platz|allee|gasse|ring|hütte|haus|hof|park|bad|berg|feld|tal|schule|kirche|zentrum|halle|brücke"
_NOW = "aktuell|derzeit|stand|noch|geplant|laufend|in auftrag|zuletzt|letzte|neueste|heute|jetzt|aktueller"
_PLACE_WORD = f"(regexp_matches(lower(w), '({_PLACES})$') OR (length(w) >= 8 AND regexp_matches(w, '^.\\p{{L}}*\\p{{Lu}}')))"
_EDGE = "(^|[^\\p{{L}}\\p{{N}}_])({})($|[^\\p{{L}}\\p{{N}}_])"
_FLAGS = {
    "attendance": "anwesend|teilgenommen|teilnahme|mitglied|mitglieder|fraktion|rolle|vorsitz|wer ist|wer war|gehört .* zu|welcher fraktion|welche fraktion",
    "statement": "gesagt|gefragt|geäußert|äußerte|erklärt|meinte|sagte|fragte|wies darauf hin|merkte an|bat|wortmeldung|redete|hat .* gesagt|hat .* gefragt",
    "metadata": "wer ist|welcher fraktion|welche fraktion|mitglied|anwesend|teilgenommen|rolle|vorsitz|gehört .* zu",
}
_FORBIDDEN = (
    "vergiss|verhalte dich|du bist jetzt|tu so als|rollenspiel|überschreibe|ersetze deine rolle|ignoriere|forget|you are now|roleplay|pretend|act as|ignore previous|disregard|override|jailbreak|bypass|"
    "break character|simulate|zeig deinen prompt|zeige deinen system|reveal your prompt|show your instructions|print your system|base64|<?php|<script|javascript:|eval("
)
_REVIEW = "trim(regexp_replace(top_key_extracted, '\\s*\\.\\s*', '.', 'g'), ' ')"
_NO_NAME = ", ".join(f"'{w}'" for w in (*T.NO_NAMES, "grüne stadtliste", "gsl", "rote stadtallianz", "rsa", "liberales forum", "lifo"))
_CALLED = "string_split_regex(regexp_extract(query, '(?:Herr|Frau)\\s+((?:[A-ZÄÖÜ][a-zäöüß-]+\\.?\\s+)*[A-ZÄÖÜ][a-zäöüß-]+)', 1), '\\s+')"
_OTHERS = "list_transform(list_slice(list_filter(string_split_regex(trim(query), '\\s+'), lambda w: w <> ''), 2, 100000), lambda w: regexp_replace(w, '[^a-zA-ZäöüÄÖÜß-]', '', 'g'))"
_ENDS = "|".join(T.NOUN_ENDINGS)
_STOP46 = ", ".join(f"'{w}'" for w in T.NO_TOPICS)


def _uniq(expr: str) -> str:
    """Distinct in order: DuckDB's list_distinct keeps no order."""
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


SQL = {
    "fn1_offset_normalise": f"SELECT id, {_FN1} AS text FROM segments",
    "fn2_match_normalise": "SELECT id, " + _STRIP.replace("{c}", "regexp_replace(translate(regexp_replace(lower(" + _FN1 + "), '\\s+', ' ', 'g'), '„“”‚‘’´`«»–—−‐‑', '\"\"\"''''''''''\"\"-----'), '[•·▪●◦]', ' ', 'g')") + " AS text FROM segments",
    "fn3_chunk_clean": "SELECT id, " + _STRIP.replace("{c}", "regexp_replace(regexp_replace(text_full, '\\b[A-Za-z]:[\\\\/][^\\n]*', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')") + " AS text FROM segments",
    "fn4_clean_lines": """WITH l AS (SELECT id, text_full, list_filter(list_transform(string_split(regexp_replace(text_full, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), lambda x: x <> '') AS a FROM segments)
        SELECT id, CASE WHEN text_full IS NULL THEN NULL ELSE len(a) END::INT AS n_lines, array_to_string(a, '|') AS lines FROM l""",
    "fn5_tokens": "SELECT doc_id, len(" + SQL_WORDS.format(c="text") + ")::INT AS n_tokens, array_to_string(" + SQL_WORDS.format(c="text") + ", ' ') AS joined FROM documents WHERE text IS NOT NULL",
    "fn14_agenda_keys": "WITH p AS (SELECT id, nullif(" + _PART % 1 + ", '') AS num, nullif(" + _PART % 2 + ", '') AS sub, nullif(" + _PART % 3 + """, '') AS s FROM document_agenda_items)
        SELECT id, num::INT AS num, sub, CASE WHEN sub IS NULL THEN upper(s) ELSE s END AS suffix,
               nullif(concat_ws('.', num, sub, CASE WHEN sub IS NULL THEN upper(s) ELSE s END), '') AS norm FROM p""",
    "fn15_review_keys": f"""WITH t AS (SELECT id, {_REVIEW} AS t FROM document_agenda_items),
        p AS (SELECT id, t, CASE WHEN t IS NOT NULL THEN coalesce(try_cast(nullif(regexp_extract(t, '^(\\d+)', 1), '') AS INT), 0) END AS num, nullif(upper(regexp_extract(t, '^\\d+\\s*\\.?([A-Za-z])$', 1)), '') AS suffix,
                     nullif(concat_ws('.', try_cast(nullif(regexp_extract(t, '^\\d+\\.(\\d+)(?:\\.(\\d+))?$', 1), '') AS INT)::VARCHAR, try_cast(nullif(regexp_extract(t, '^\\d+\\.(\\d+)(?:\\.(\\d+))?$', 2), '') AS INT)::VARCHAR), '') AS sub FROM t)
        SELECT id, num, suffix, sub, num::VARCHAR || coalesce(suffix, '') || coalesce('.' || sub, '') AS norm FROM p""",
    "fn39_detectors": f"""SELECT id, CASE WHEN contains(lower(query), 'grüne stadtliste') OR contains(lower(query), 'gsl') THEN 'gsl' WHEN contains(lower(query), 'rote stadtallianz') OR contains(lower(query), 'rsa') THEN 'rsa'
            WHEN contains(lower(query), 'liberales forum') OR contains(lower(query), 'lifo') THEN 'lifo' END AS faction,
        coalesce(list_filter({_CALLED}, lambda w: w <> '' AND NOT regexp_matches(w, '^(Dr|Prof|Dipl|Med)\\.?$'))[-1],
                 list_filter({_OTHERS}, lambda w: length(w) >= 4 AND regexp_matches(w, '^\\p{{Lu}}') AND lower(w) NOT IN ({_NO_NAME}))[-1]) AS person FROM chat_logs""",
    "so9_candidates": f"""WITH q AS (SELECT id, regexp_matches(lower(query), '{_NOW}') OR len(list_filter(regexp_extract_all(query, '[A-ZÄÖÜa-zäöüß]{{5,}}'), lambda w: {_PLACE_WORD})) > 0 AS high FROM chat_logs WHERE query IS NOT NULL)
        SELECT id, CASE WHEN high THEN 140 ELSE 40 END AS relevant, CASE WHEN high THEN 140 ELSE 40 END AS recent, 300 AS breadth FROM q""",
    "fn16_roles": f"SELECT CASE WHEN role_extracted IS NULL THEN NULL {_ROLE} ELSE 'sonstige' END AS role, count(*) AS n FROM document_attendance_rows GROUP BY 1",
    "fn17_name_normalise": "SELECT id, trim(regexp_replace(regexp_replace(lower(last_name_extracted), '[^\\p{L}\\p{N} ]', '', 'g'), ' +', ' ', 'g')) AS name FROM document_attendance_rows",
    "fn18_json_fields": "SELECT id, coalesce(nullif(trim(extracted_json->>'$.funktion'), ''), nullif(trim(extracted_json->>'$.rolle'), ''), nullif(trim(extracted_json->>'$.role'), '')) AS role, nullif(trim(extracted_json->>'$.anrede'), '') AS salutation FROM document_attendance_rows",
    "fn21_title_words": "SELECT id, array_to_string(list_slice(list_filter(string_split(regexp_replace(lower(title_curated), '[^a-z0-9äöüß]+', ' ', 'g'), ' '), lambda w: length(w) >= 5), 1, 3), ' ') AS words FROM document_agenda_items WHERE title_curated IS NOT NULL",
    "fn36_proper_nouns": "SELECT id, array_to_string(" + _uniq(f"list_filter(regexp_extract_all(query, '[A-ZÄÖÜa-zäöüß]{{5,}}'), lambda w: {_PLACE_WORD})") + ", '|') AS nouns FROM chat_logs",
    "fn37_query_flags": "SELECT " + ", ".join(f"regexp_matches(lower(query), '{_EDGE.format(p)}') AS {k}" for k, p in _FLAGS.items()) + f", regexp_matches(lower(query), '{_NOW}') AS recency, count(*) AS n FROM chat_logs GROUP BY 1, 2, 3, 4",
    "fn38_query_signals": """WITH d AS (SELECT id, query, regexp_extract(query, '\\b(\\d{1,2})\\.(\\d{1,2})\\.(\\d{4})\\b', 1) dd, regexp_extract(query, '\\b(\\d{1,2})\\.(\\d{1,2})\\.(\\d{4})\\b', 2) mm, regexp_extract(query, '\\b(\\d{1,2})\\.(\\d{1,2})\\.(\\d{4})\\b', 3) yy FROM chat_logs)
        SELECT id, CASE WHEN yy <> '' THEN yy || '-' || lpad(mm, 2, '0') || '-' || lpad(dd, 2, '0') END AS iso_date, nullif(regexp_extract(query, '\\b(\\d{4}/\\d{4}(?:/\\d{1,2})?)\\b', 1), '') AS paper, coalesce(regexp_matches(lower(query), 'entwickelt|verändert|über die jahre|im laufe|seit \\d{4}'), false) AS multi_doc FROM d""",
    "fn41_recency": "SELECT id, round(CASE WHEN meeting_date IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, 1 - date_diff('day', meeting_date, DATE '2026-01-01') / 365.0::DOUBLE)) END, 6) AS recency FROM raw_documents",
    "fn43_cosine_topk": "WITH t AS (SELECT embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS score FROM embeddings, t ORDER BY score DESC, vec_id LIMIT 10",
    "fn44_lexeme_rank": "WITH l AS (SELECT doc_id, " + SQL_LEX.format(c="text") + """ AS a FROM documents WHERE text IS NOT NULL),
        n AS (SELECT doc_id, len(list_filter(a, lambda w: w = 'sanier')) x, len(list_filter(a, lambda w: w = 'turnhall')) y FROM l)
        SELECT doc_id, round((0.4 * coalesce(list_sum(list_transform(range(1, x + 1), lambda j: 1.0::DOUBLE / (j * j))), 0) + 0.4 * coalesce(list_sum(list_transform(range(1, y + 1), lambda j: 1.0::DOUBLE / (j * j))), 0)) / 1.64493406685 / 2, 6) AS rank FROM n WHERE x + y > 0""",
    "fn45_trigram_similarity": "WITH g AS (SELECT id, " + SQL_GRAMS.format(c="title_curated") + " AS a, " + SQL_GRAMS.format(c=f"'{TERM}'") + """ AS b FROM document_agenda_items WHERE title_curated IS NOT NULL)
        SELECT id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) AS score FROM g WHERE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) >= 0.15""",
    "fn46_content_terms": "SELECT id, array_to_string(list_slice(" + _uniq(f"list_transform(list_filter(regexp_extract_all(query, '[A-Za-zÄÖÜäöüß-]{{5,}}'), lambda w: lower(w) NOT IN ({_STOP46}) AND (regexp_matches(w, '^\\p{{Lu}}') OR regexp_matches(lower(w), '({_ENDS})$') OR length(w) >= 8)), lambda w: lower(w))") + ", 1, 3), '|') AS terms FROM chat_logs",
    "fn50_51_gate": "SELECT id, (" + " OR ".join(f"contains(lower(query), '{w}')" for w in _FORBIDDEN.split("|")) + " OR regexp_matches(query, '\\bDAN\\b')) AS injection, length(trim(query)) < 3 AS short FROM chat_logs WHERE query IS NOT NULL",
    "fn56_hashes": "SELECT id, CASE WHEN text_full <> '' THEN sha256(text_full) END AS hash FROM segments",
    "fn57_58_names_and_previews": "SELECT id, regexp_replace(regexp_replace(trim(source_filename), '\\s+', '_', 'g'), '[^\\p{L}\\p{N}._-]+', '_', 'g') AS name, CASE WHEN length(source_path) > 12 THEN substring(source_path, 1, 12) || '…' ELSE source_path END AS preview FROM raw_documents",
    "fn59_query_years": "SELECT nullif(regexp_extract(query, '\\b(20\\d{2}|199\\d)\\b', 1), '')::INT AS year, count(*) AS n FROM chat_logs GROUP BY 1",
    "fn60_window_buckets": "SELECT (floor(epoch(ts) / 3600) * 3600)::BIGINT AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "wn7_chunks": "WITH t AS (SELECT doc_id, " + SQL_WORDS.format(c=_STRIP.format(c="regexp_replace(text, '\\b[A-Za-z]:[\\\\/][^\\n]*', '', 'g')")) + """ AS w FROM documents),
        c AS (SELECT doc_id, unnest(range(0, len(w), 96)) AS pos, w FROM t),
        x AS (SELECT doc_id, pos, len(list_slice(w, pos + 1, pos + 120))::INT AS n_tokens, array_to_string(list_slice(w, pos + 1, pos + 120), ' ') AS chunk_text FROM c)
        SELECT doc_id AS document_id, 1 AS start_page, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS chunk_index, n_tokens, chunk_text FROM x WHERE length(chunk_text) >= 20""",
}
QUERIES = {name: f for name, f in globals().items() if callable(f) and name[0] != "_" and name[:2] in ("fn", "wn", "so")}
