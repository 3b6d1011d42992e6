from wayline.streaming.events import windowed_counts, without_repeats


def test_stream_gives_what_the_table_gives(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, "ts", "event_type", "value", "1 day", "2 hours").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    want = windowed_counts(events, "ts", "event_type", "value", "1 day", "2 hours")
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, want.collect()))


def test_repeats_within_the_watermark(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").limit(50)
    events.union(events).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = without_repeats(stream, "ts", ["event_id"], "1000 days").writeStream.format("memory").queryName("once").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == 50 == without_repeats(events.union(events), "ts", ["event_id"], "1 day").count()
