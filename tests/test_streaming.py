from neurolith.streaming import windows as sw

SCHEMA = "event_id bigint, ts timestamp, kind string, value double"


def test_a_stream_gives_the_windows_of_the_batch(spark, tmp_path):
    rows = spark.sql("select id as event_id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id * 7,0) as ts, if(id % 3 = 0, 'a', 'b') as kind, cast(id as double) as value from range(50)")
    for i in range(3):
        rows.filter(f"event_id % 3 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sw.hopping_counts(stream, "ts", ["kind"]).writeStream.format("memory").queryName("hops").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.table("hops").collect()))
    assert got == sorted(map(tuple, sw.hopping_counts(rows, "ts", ["kind"]).collect()))


def test_repeated_deliveries_and_sessions(spark, tmp_path):
    rows = spark.sql("select id % 5 as event_id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,id % 5,0,0) as ts, 'a' as kind, 1d as value from range(10)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    q = sw.first_deliveries(stream, "ts", ["event_id"]).writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("firsts").count() == 5 == sw.first_deliveries(rows, "ts", ["event_id"]).count()
    assert [r.n for r in sw.sessions(rows, "ts", ["kind"], "90 minutes").collect()] == [10]
    assert sw.sessions(rows, "ts", ["kind"], "30 minutes").count() == 5
