"""Streams give what the same rows give as a table."""

from pyspark.sql import functions as F

from regionlytics.streaming import online


def test_sessions_and_counts_of_a_stream(spark, tmp_path):
    rows = [("a", 0), ("a", 60), ("a", 4000), ("b", 10), ("z", 90_000)]
    d = spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds("s").alias("t"), F.lit(1.0).alias("weight"))
    d.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = online.sessions(stream, ["k"], "t").writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    closed = {(r["k"], r["n"]) for r in spark.table("sessions").collect()}
    assert closed == {("a", 2), ("a", 1), ("b", 1)}
    assert closed < {(r["k"], r["n"]) for r in online.sessions(d, ["k"], "t").collect()}
    q = online.running_counts(stream, ["k"]).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["k"]: r["n"] for r in spark.table("counts").collect()} == {"a": 3, "b": 1, "z": 1}
