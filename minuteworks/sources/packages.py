"""Sources and sinks: document packages, page text, permissive JSON, tables, logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from minuteworks.functions import text as T

#: Files that a package must have (fixed values), besides a PDF.
REQUIRED = ("agenda.json", "attendance.json", "core.json", "documents.json", "segments.json")
AGENDA_ITEM = "struct<top_key_curated:string,top_key:string,key:string,title_curated:string,title:string,name:string>"
AGENDA_KEYS = ("agenda", "items", "tops", "tagesordnung", "points", "tagesordnungspunkte")


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """SRC7, CP20: one row a package folder: its files, its PDF, whether it is ready and complete.

    The PDF is the first by name whose name speaks of minutes, else the first. Only
    paths are read, not contents.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    parts = files.select(F.regexp_extract("path", r"^(.*)/([^/]+)$", 1).alias("package"), F.regexp_extract("path", r"^(.*)/([^/]+)$", 2).alias("name"))
    pdf = F.min(F.when(F.lower("name").endswith(".pdf"), F.struct((~F.lower("name").rlike("protokollunterlagen|niederschrift|protokoll")).cast("int"), F.col("name").alias("name"))))
    found = parts.groupBy("package").agg(F.collect_set("name").alias("files"), pdf["name"].alias("pdf"), F.max((F.col("name") == "ready.done").cast("int")).alias("ready"))
    has = F.size(F.array_except(F.array(*[F.lit(x) for x in REQUIRED]), "files")) == 0
    return found.where(F.array_contains("files", "agenda.json")).select("package", "pdf", (F.col("ready") == 1).alias("ready"), (has & F.col("pdf").isNotNull()).alias("has_files"))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC8: whole-file JSON, permissive; broken files give null columns and their text in ``_corrupt``."""
    return spark.read.schema(f"{schema}, _corrupt string").option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def parse_agenda(json: Column, need_title: bool = False) -> Column:
    """SRC9, SRC10: agenda items (key, title) of JSON that is a list or an object with one of several keys.

    A string that holds JSON is read again. Items without key (and, with
    ``need_title``, without title) are left out; anything else gives an empty list.
    """
    wrapped = F.when(F.trim(json).startswith('"'), F.get_json_object(F.concat(F.lit('{"x":'), json, F.lit("}")), "$.x")).otherwise(json)
    plain = F.from_json(wrapped, f"array<{AGENDA_ITEM}>")
    keyed = [F.from_json(F.get_json_object(wrapped, f"$.{k}"), f"array<{AGENDA_ITEM}>") for k in AGENDA_KEYS]
    items = F.coalesce(*keyed, F.when(F.trim(wrapped).startswith("["), plain), F.from_json(F.lit("[]"), f"array<{AGENDA_ITEM}>"))
    blank = lambda *cs: F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cs])
    pairs = F.transform(items, lambda x: F.struct(blank(x["top_key_curated"], x["top_key"], x["key"]).alias("key"), blank(x["title_curated"], x["title"], x["name"]).alias("title")))
    return F.filter(pairs, lambda x: x["key"].isNotNull() & (x["title"].isNotNull() if need_title else F.lit(True)))


def salvage_json(text: Column, schema: str) -> Column:
    """SRC11: a document parsed directly, else from its outermost braces; ``notes`` says why it is empty."""
    direct = F.from_json(text, schema)
    inner = F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), schema)
    value = F.when(F.trim(text).startswith("{") & F.trim(text).endswith("}"), direct).otherwise(inner)
    notes = F.when(text.isNull() | (F.trim(text) == ""), "missing").when(~text.contains("{"), "wrong_shape").when(value.isNull(), "unparseable")
    return F.struct(value.alias("value"), notes.alias("notes"))


def extract_pages(files: DataFrame, extractor: Callable[[bytes], list[str]]) -> DataFrame:
    """SRC1, SRC2: page texts of binary files (path, content) by a pluggable extractor; a failing file gives no page."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for path, content in zip(p["path"], p["content"], strict=True):
                try:
                    pages = extractor(bytes(content))
                except Exception:  # noqa: BLE001 - the second extractor has its turn
                    pages = []
                rows += [(path, n, t) for n, t in enumerate(pages, 1)]
            yield pd.DataFrame(rows, columns=["path", "page_no", "page_text"])

    return files.select("path", "content").mapInPandas(run, "path string, page_no int, page_text string")


def merge_pages(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """SRC3: each page from the first extractor, or from the second where that is empty."""
    a, b = (df.select("path", "page_no", F.col("page_text").alias(x)) for df, x in ((primary, "a"), (secondary, "b")))
    return a.join(b, ["path", "page_no"], "full").select("path", "page_no", T.offset_normalise(F.coalesce(F.nullif("a", F.lit("")), "b", F.lit(""))).alias("page_text"))


def slice_pages(pages: DataFrame, n: int) -> DataFrame:
    """SRC26: the first ``n`` pages of every document."""
    return pages.where(F.col("page_no") <= n)


def read_table(spark: SparkSession, path: str | None = None, jdbc: dict[str, str] | None = None) -> DataFrame:
    """SRC12: a table from Parquet, or over JDBC (url, dbtable, and what else Spark's reader takes)."""
    return spark.read.format("jdbc").options(**jdbc).load() if jdbc else spark.read.parquet(path)


def write_log(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """SRC20, SRC21: an appended log, CSV with semicolons and escaped line ends, or a JSON object a line."""
    if fmt == "json":
        df.write.mode("append").json(path)
        return
    flat = df.select(*[F.regexp_replace(F.col(c).cast("string"), r"\r?\n", r"\\n").alias(c) for c in df.columns])
    flat.write.mode("append").option("sep", ";").option("header", "true").csv(path)


def log_tail(spark: SparkSession, folder: str, n: int = 80) -> DataFrame:
    """SRC29: the last ``n`` lines of each log file, newest file first."""
    lines = spark.read.text(folder).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"), F.monotonically_increasing_id().alias("at"), "value")
    from pyspark.sql import Window

    last = lines.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("at")))).where(F.col("n") <= n)
    return last.select("file", "modified", "n", "value")
