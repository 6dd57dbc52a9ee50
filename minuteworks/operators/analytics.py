"""Aggregates over chat logs, feedback and surveys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from minuteworks.operators.relational import latest

#: Days of the periods that reports know; unknown ones are a week (FN61).
PERIODS = {"24h": 1, "7d": 7, "30d": 30}


def since(df: DataFrame, period: str, as_of: str, column: str = "created_at") -> DataFrame:
    """FN61: rows of a period before ``as_of``; ``all`` keeps everything."""
    if period == "all":
        return df
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(PERIODS.get(period, 7)))
    return df.where(F.col(column) >= cutoff)


def chat_totals(logs: DataFrame) -> DataFrame:
    """AG3, AG5, AG8: logs, sessions, mean time (0 without rows)."""
    return logs.agg(F.count("*").alias("n_logs"), F.countDistinct("session_id").alias("n_sessions"), F.round(F.coalesce(F.avg("elapsed_ms"), F.lit(0.0)), 3).alias("mean_ms"))


def per_day(logs: DataFrame) -> DataFrame:
    """AG4: logs a day."""
    return logs.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))


def ratings(feedback: DataFrame) -> DataFrame:
    """AG6: up and down ratings; null sums where there are no rows."""
    return feedback.agg(F.sum(F.when(F.col("rating") == 1, 1).otherwise(0)).alias("up"), F.sum(F.when(F.col("rating") == -1, 1).otherwise(0)).alias("down"))


def top_groups(df: DataFrame, key: str, n: int = 10, missing: str = "(alle)") -> DataFrame:
    """AG7: the most frequent values, ties by value."""
    return df.groupBy(F.coalesce(key, F.lit(missing)).alias(key)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def unrated(logs: DataFrame, feedback: DataFrame) -> DataFrame:
    """JN9: logs without feedback."""
    return logs.join(feedback.select(F.col("chat_log_id").alias("id")), "id", "left_anti")


def rated_logs(logs: DataFrame, feedback: DataFrame, faithful: bool = False) -> DataFrame:
    """JN10: logs with their rating; the last one counts, or every one with ``faithful``."""
    given = feedback if faithful else latest(feedback, ["chat_log_id"], "created_at", "id")
    return logs.join(given.select(F.col("chat_log_id").alias("id"), "rating", "comment"), "id", "left")


def search_logs(logs: DataFrame, term: str) -> DataFrame:
    """FLT10: logs whose question or answer contains a term, case aside."""
    low = term.lower()
    hits: Column = F.lit(False)
    for c in ("query", "answer", "condensed_query"):
        hits = hits | F.coalesce(F.lower(c).contains(low), F.lit(False))
    return logs.where(hits)


# Surveys: ``responses`` has session_token, question_key, answer_numeric, answer_text. ------


def likert(responses: DataFrame) -> DataFrame:
    """AG10: how often each value was given, with the question's mean and number of answers."""
    counts = responses.where("answer_numeric is not null").groupBy("question_key", "answer_numeric").agg(F.count("*").alias("n"))
    means = counts.groupBy("question_key").agg(F.round(F.sum(F.col("answer_numeric") * F.col("n")) / F.sum("n"), 2).alias("mean"), F.sum("n").alias("answers"))
    return counts.join(means, "question_key")


def _spread(scores: DataFrame) -> DataFrame:
    """Mean, sample deviation (0 for one score), least and greatest score."""
    return scores.agg(F.round(F.avg("score"), 1).alias("mean"), F.round(F.coalesce(F.stddev_samp("score"), F.lit(0.0)), 1).alias("sd"), F.min("score").alias("least"), F.max("score").alias("greatest"), F.count("*").alias("n"))


def sus_scores(responses: DataFrame, prefix: str = "sus_") -> DataFrame:
    """Usability score of each participant with exactly ten answers."""
    rows = responses.where(F.col("question_key").startswith(prefix) & F.col("answer_numeric").isNotNull()).withColumn("item", F.substring("question_key", len(prefix) + 1, 3).cast("int"))
    # Of several answers to one item the highest counts.
    rows = rows.groupBy("session_token", "item").agg(F.max("answer_numeric").alias("answer_numeric"))
    part = F.when(F.col("item") % 2 == 1, F.col("answer_numeric") - 1).otherwise(5 - F.col("answer_numeric"))
    return rows.groupBy("session_token").agg((F.sum(part) * 2.5).alias("score"), F.count("*").alias("answers")).where("answers = 10").select("session_token", "score")


def sus(responses: DataFrame, prefix: str = "sus_") -> DataFrame:
    """AG11: usability over all participants."""
    return _spread(sus_scores(responses, prefix))


def umux_lite(responses: DataFrame, items: tuple[str, str] = ("umux_1", "umux_2")) -> DataFrame:
    """AG12: two items of seven points as a score of 0 to 100."""
    rows = responses.where(F.col("question_key").isin(*items) & F.col("answer_numeric").isNotNull())
    scores = rows.groupBy("session_token").agg(F.avg("answer_numeric").alias("m"), F.count("*").alias("c")).where("c = 2")
    return _spread(scores.select(((F.col("m") - 1) / 6 * 100).alias("score")))


def nps(responses: DataFrame, item: str = "nps") -> DataFrame:
    """AG13: promoters (9 and 10), passives (7 and 8), detractors, and the net score."""
    rows = responses.where((F.col("question_key") == item) & F.col("answer_numeric").isNotNull())
    n = rows.agg(F.count_if(F.col("answer_numeric") >= 9).alias("promoters"), F.count_if(F.col("answer_numeric").between(7, 8)).alias("passives"), F.count_if(F.col("answer_numeric") < 7).alias("detractors"), F.count("*").alias("n"))
    return n.withColumn("nps", F.round((F.col("promoters") - F.col("detractors")) / F.nullif(F.col("n"), F.lit(0)) * 100, 1))


def survey_table(responses: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """SRC25: one row a participant (token cut to eight), one column a question."""
    rows = responses.select(F.substring("session_token", 1, 8).alias("token"), "question_key", F.coalesce(F.col("answer_numeric").cast("string"), "answer_text").alias("value"))
    return rows.groupBy("token").pivot("question_key", keys).agg(F.first("value"))
