"""The pN_ queries: every one over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from minuteworks.llm import defects, language, mixing, names, neardup, packing, privacy, scans, splitting, vectors
from minuteworks.session import table


#: Problem 1 by field: table, words a run, threshold, least length, and bands to match.
NEAR = {
    "title_curated": ("document_agenda_items", {"k": 1, "threshold": (78, 100), "min_chars": 60, "rows": 5, "bands": 28, "stride": 4}),
    "text_full": ("segments", {"k": 3, "threshold": (6, 10), "min_chars": 600, "rows": 4, "bands": 56, "stride": 3}),
}


def _near(spark: SparkSession, sf_dir: str, field: str) -> neardup.NearDuplicates:
    name, options = NEAR[field]
    return neardup.near_duplicates(table(spark, sf_dir, name), "id", field, "document_id", **options)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.union_all([_near(spark, sf_dir, f).row_pairs().select(F.lit(f).alias("field"), "id_a", "id_b") for f in NEAR])


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, class and number of links of every agenda item and segment that takes part."""
    return neardup.union_all([_near(spark, sf_dir, f).groups().select(F.lit(f).alias("field"), "id", "cls", "group_id", "n_links") for f in NEAR])


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest segments of every usable segment vector."""
    return vectors.knn_join(table(spark, sf_dir, "segments")).select("id", "neighbour", "rank")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = vectors.knn_join(table(spark, sf_dir, "segments"))
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def _clean(spark: SparkSession, sf_dir: str) -> scans.Noise:
    return scans.clean(table(spark, sf_dir, "segments"), table(spark, sf_dir, "raw_documents"))


def p3_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment text as running paragraphs."""
    return _clean(spark, sf_dir).texts


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clean(spark, sf_dir).found


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Member or faction of every attendance row that means one, exact spellings as well."""
    return names.link_attendance(*(table(spark, sf_dir, t) for t in ("document_attendance_rows", "raw_documents", "members", "factions")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_links(spark, sf_dir).where("not exact").select("row_id", "field", "entity_key")


def p5_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All defects of every log, with posteriors."""
    tagger = language.train_on(table(spark, sf_dir, "documents"))
    return defects.flag(table(spark, sf_dir, "chat_logs"), tagger).withColumnRenamed("id", "chat_log_id")


def p5_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validated cutoff of every defect, with precision and recall on planted cases."""
    tagger = language.train_on(table(spark, sf_dir, "documents"))
    return spark.createDataFrame(defects.flags(table(spark, sf_dir, "chat_logs"), tagger).cutoffs, "defect string, cutoff double, precision double, recall double, cases int")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_defects(spark, sf_dir).where("first_defect is not null").select("chat_log_id", F.col("first_defect").alias("defect"))


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all segment texts."""
    return splitting.split_oversized(table(spark, sf_dir, "segments"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_kinds(splitting.split_oversized(table(spark, sf_dir, "segments"))).select(F.col("id").alias("segment_id"), "kind")


def p7_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All queries and comments with placeholders."""
    members = table(spark, sf_dir, "members")
    fields = (("chat_logs", "query"), ("chat_feedback", "comment"))
    return privacy.sanitise_tables([(table(spark, sf_dir, name), "id", field, name) for name, field in fields], members)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_texts(spark, sf_dir).select(F.col("source").alias("source_table"), F.col("id").alias("row_id"), F.explode("types").alias("pii_type")).distinct()


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container and position of every document."""
    return packing.pack(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).where((F.col("n_pieces") > 1) & (F.col("piece") == 0)).select(F.col("id").alias("doc_id")).distinct()


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of every source."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).report


def p9_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document is used in which slot of the mixture."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).schedule


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_shares(spark, sf_dir).where(~F.col("reachable")).select("source")


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return language.detect(documents, language.train_on(documents))


def p10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every document."""
    return _languages(spark, sf_dir).select(F.col("id").alias("doc_id"), "label_lang", "lang", "confidence", "kind")


def p10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every passage of mixed documents."""
    mixed = _languages(spark, sf_dir).where(F.col("kind") == "mixed")
    return mixed.select(F.col("id").alias("doc_id"), F.posexplode("passages").alias("passage", "x")).select("doc_id", "passage", "x.*")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _languages(spark, sf_dir).where(F.col("kind").isin("mixed", "missing", "wrong"))
    langs = F.when(F.col("kind") == "mixed", F.col("langs")).otherwise(F.array("lang"))
    return found.select(F.col("id").alias("doc_id"), "kind", F.explode(langs).alias("true_lang"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of this package by name."""
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can answer on whole tables."""
    near = """
            {name} AS (SELECT id, document_id, list_distinct({items}) e FROM {table} WHERE length({field}) >= {least}),
            {name}_c AS (SELECT DISTINCT list_sort(e) e FROM {name} WHERE len(e) > 0),
            {name}_k AS (SELECT row_number() OVER () k, e, len(e) n FROM {name}_c),
            {name}_m AS (SELECT id, document_id, k FROM {name} JOIN {name}_k ON list_sort({name}.e) = {name}_k.e),
            {name}_i AS (SELECT k, n, unnest(e) x FROM {name}_k),
            {name}_p AS (SELECT a.k ka, b.k kb FROM {name}_i a JOIN {name}_i b ON a.x = b.x AND a.k <= b.k
                         GROUP BY a.k, b.k, a.n, b.n HAVING count(*) * {down} >= (a.n + b.n - count(*)) * {up})"""
    words = "regexp_extract_all(lower({field}), '[\\p{{L}}\\p{{N}}]+')"
    titles = words.format(field="title_curated")
    texts = words.format(field="text_full")
    runs = f"list_transform(range(1, len({texts}) - 1), lambda i: ({texts})[i] || ' ' || ({texts})[i + 1] || ' ' || ({texts})[i + 2])"
    pairs = """SELECT '{field}' AS field, least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b
               FROM {name}_p JOIN {name}_m a ON a.k = ka JOIN {name}_m b ON b.k = kb
               WHERE a.document_id <> b.document_id AND (ka <> kb OR a.id < b.id)"""
    return {
        "p1_found": "WITH "
        + near.format(name="t", items=titles, table="document_agenda_items", field="title_curated", least=60, up=78, down=100) + ","
        + near.format(name="s", items=runs, table="segments", field="text_full", least=600, up=6, down=10)
        + pairs.format(field="title_curated", name="t") + " UNION ALL " + pairs.format(field="text_full", name="s"),
        "p2_found": """
            WITH v AS (SELECT id, list_transform(embedding, lambda x: x::DOUBLE) e FROM segments
                       WHERE embedding IS NOT NULL AND len(embedding) = 64
                         AND len(list_filter(embedding, lambda x: isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
                 s AS (SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.id) AS rn
                       FROM v a JOIN v b ON a.id <> b.id)
            SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM s WHERE rn <= 5""",
        "p6_found": """
            SELECT id AS segment_id,
                   CASE WHEN list_max(list_transform(regexp_split_to_array(text_full, '\\n|\\r|[.!?]\\s'), lambda x: length(x))) > 2400
                        THEN 'forced' ELSE 'natural' END AS kind
            FROM segments WHERE length(text_full) > 2400""",
    }
