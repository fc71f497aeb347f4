from pyspark.sql import functions as F

from weftgraph.streaming import limiter


def events(spark, path):
    rows = [(i, i * 600.0, "ab"[i % 2]) for i in range(30)]
    spark.createDataFrame(rows, "id bigint, s double, kind string").select("id", "kind", F.timestamp_seconds("s").alias("ts")).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_log_holds_every_event_once(spark, tmp_path):
    batch = events(spark, str(tmp_path / "in"))
    for _ in range(2):  # started again, it goes on where it was
        stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
        limiter.append_log(stream, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "log")).collect()) == list(range(30))


def test_windows_of_a_stream_equal_the_batch(spark, tmp_path):
    batch = events(spark, str(tmp_path / "in"))
    want = {tuple(r) for r in limiter.windowed_counts(batch, "ts", "kind").collect()}
    stream = limiter.windowed_counts(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), "ts", "kind")
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("windows").collect()} == want and len(want) == 10
