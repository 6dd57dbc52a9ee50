from datetime import datetime, timedelta

from minuteworks.streaming import ratelimit as R

START = datetime(2024, 1, 1, 10, 0)


def test_batch_and_stream_count_alike(spark, tmp_path):
    rows = [(START + timedelta(minutes=i), "a") for i in range(20)] + [(START + timedelta(hours=2), "b"), (None, "c")]
    df = spark.createDataFrame(rows, "ts timestamp, ip_hash string")
    batch = {(r["ip_hash"], r["window_start"]): (r["n"], r["allowed"]) for r in R.windowed_counts(df).collect()}
    assert batch == {("a", START): (20, False), ("b", START + timedelta(hours=2)): (1, True)}
    df.write.parquet(str(tmp_path / "in"))
    stream = R.stream_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r["ip_hash"], r["window_start"]): (r["n"], r["allowed"]) for r in spark.table("counts").collect()} == batch


def test_running_decisions(spark, tmp_path):
    rows = [(START + timedelta(seconds=i), "a") for i in range(4)] + [(START + timedelta(hours=1), "a")]
    df = spark.createDataFrame(rows, "ts timestamp, ip_hash string")
    df.write.parquet(str(tmp_path / "in"))
    stream = R.decisions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), limit=2)
    query = stream.writeStream.outputMode("append").format("memory").queryName("decisions").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r["n"], r["allowed"]) for r in spark.table("decisions").orderBy("ts").collect()] == [(1, True), (2, True), (3, False), (4, False), (1, True)]
