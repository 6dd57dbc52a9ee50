"""Rows of the tables from the JSON of packages: core, agenda, attendance, segments; import queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from minuteworks.functions import text as T


def core_rows(core: DataFrame) -> DataFrame:
    """SRC14: core data of documents, the period included; dates, times and numbers parsed strictly."""
    return core.select(
        F.col("document_id").cast("long").alias("document_id"), T.strict_date(F.col("curated_sitzungsdatum")).alias("meeting_date"), T.strict_time(F.col("curated_uhrzeit_start")).alias("start_time"),
        F.nullif(F.trim("curated_ort"), F.lit("")).alias("place"), F.nullif(F.trim("curated_sitzungstyp"), F.lit("")).alias("kind"), F.nullif(F.trim("curated_periodenbezug"), F.lit("")).alias("period"),
        F.col("curated_niederschrift_nr").cast("string").alias("number"), F.lit(False).alias("needs_review"),
    )


def with_meeting_dates(documents: DataFrame, core: DataFrame) -> DataFrame:
    """SRC14: documents with the core data's meeting date where they have one."""
    dates = core.where("meeting_date is not null").groupBy(F.col("document_id").alias("id")).agg(F.max("meeting_date").alias("_date"))
    return documents.join(dates, "id", "left").withColumn("meeting_date", F.coalesce("_date", "meeting_date")).drop("_date").select(*documents.columns)


def agenda_rows(items: DataFrame) -> DataFrame:
    """SRC15: agenda rows of (document_id, agenda: array of key, title); extracted and curated values are the same."""
    rows = items.select("document_id", F.posexplode("agenda").alias("row_index", "x"))
    key = T.agenda_key(F.col("x.key"))
    return rows.select(
        "document_id", "row_index", F.col("x.key").alias("top_key_extracted"), F.col("x.title").alias("title_extracted"), F.col("x.key").alias("top_key_curated"), F.col("x.title").alias("title_curated"),
        key["num"].alias("top_num"), key["suffix"].alias("top_suffix"), key["sub"].alias("top_sub"), key["norm"].alias("top_norm"), F.lit(False).alias("needs_review"),
    )


def attendance_rows(people: DataFrame) -> DataFrame:
    """SRC16: attendance rows of (document_id, attendance: array of role, salutation, title, last_name, faction)."""
    rows = people.select("document_id", F.posexplode("attendance").alias("row_index", "x"))
    name = T.name_normalise(F.col("x.last_name"))
    return rows.select(
        "document_id", "row_index", T.role(F.col("x.role")).alias("role_curated"), F.col("x.salutation").alias("salutation"), F.col("x.title").alias("title_akad"), F.col("x.last_name").alias("last_name_curated"), F.col("x.faction").alias("faction_curated"),
        name.alias("name_norm"), F.sha2(F.to_json(F.col("x")), 256).alias("row_hash"),
    )


def segment_rows(segments: DataFrame) -> DataFrame:
    """SRC17: segments without NUL characters, with the hash of their text and their other fields as JSON."""
    text = F.regexp_replace("text_full", "\u0000", "")
    known = [c for c in segments.columns if c not in ("document_id", "text_full")]
    return segments.select("document_id", text.alias("text_full"), T.sha256_text(text).alias("content_hash"), F.to_json(F.struct(*known)).alias("meta") if known else F.lit("{}").alias("meta"))


def enqueue(queue: DataFrame, jobs: DataFrame) -> DataFrame:
    """SRC19: the import queue (package_id, status) with the finished jobs that it doesn't have yet, as pending."""
    done = jobs.where("status = 'done'").select("package_id").distinct().join(queue.select("package_id"), "package_id", "left_anti")
    return queue.select("package_id", "status").unionByName(done.withColumn("status", F.lit("pending")))


def pending(queue: DataFrame, n: int = 100) -> DataFrame:
    """SRC19: the next packages to import, in order of their ids."""
    return queue.where("status = 'pending'").orderBy("package_id").limit(n)


def clean_anchor(anchor, confidence):
    """FN34: an anchor without marked-up lines, and its confidence, less the more of it was dropped."""
    lines = F.split(F.coalesce(anchor, F.lit("")), "\n")
    kept = F.filter(lines, lambda x: ~F.trim(x).rlike(r"^[#*•-]") & (F.trim(x) != ""))
    dropped = F.size(F.filter(lines, lambda x: F.trim(x) != "")) - F.size(kept)
    factor = F.when(F.size(kept) == 0, 0.7).when(dropped == 0, 1.0).when(dropped == 1, 0.85).otherwise(0.75)
    return F.struct(F.array_join(kept, "\n").alias("anchor"), (T.confidence(confidence) * factor).alias("confidence"))


def align_hints(agenda: DataFrame, hints: DataFrame) -> DataFrame:
    """CP15, WN11, WN14: one hint for every agenda item in agenda order, pages never falling.

    ``agenda``: document_id, row_index, top_key; ``hints``: document_id, ord, top_key,
    page_no. Of several hints of a key the first counts; items without one have null pages.
    """
    from pyspark.sql import Window

    first = hints.groupBy("document_id", "top_key").agg(F.min_by("page_no", "ord").alias("page_no"))
    joined = agenda.join(first, ["document_id", "top_key"], "left")
    so_far = F.max("page_no").over(Window.partitionBy("document_id").orderBy("row_index").rowsBetween(Window.unboundedPreceding, 0))
    return joined.select("document_id", "row_index", "top_key", F.when(F.col("page_no").isNotNull(), so_far).alias("page_no"))
