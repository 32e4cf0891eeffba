from pyspark.sql import functions as F

from ledgerlens.streaming.announcements import read_events, windowed_counts


def test_windows_over_a_stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source = str(tmp_path / "in")
    events.orderBy("ts").repartitionByRange(4, "ts").write.parquet(source)
    events.limit(50).write.mode("append").parquet(source)  # repeats
    stream = windowed_counts(read_events(spark, source, events.schema), late="4000 days")
    run = stream.writeStream.outputMode("complete").format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "at")).start()
    run.processAllAvailable()
    run.stop()
    got = {(r.start, r.event_type): r.n for r in spark.table("seen").collect()}
    want = {(r.window.start, r.event_type): r.n for r in events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got == want
