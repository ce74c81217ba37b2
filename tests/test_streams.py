import time

from pyspark.sql import functions as F

from quarrystone.streaming.index import daily_counts, keep_index, points, read_stream


def test_index_keeps_first_deliveries(spark, tmp_path):
    source, index, mark = (str(tmp_path / n) for n in ("in", "index", "mark"))
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, " "), (4, "b")], "row_id bigint, text string")
    rows.write.parquet(source)
    run = lambda: keep_index(read_stream(spark, source, rows.schema), index, mark).awaitTermination()
    run()
    spark.createDataFrame([(5, "b"), (6, "c")], "row_id bigint, text string").write.mode("append").parquet(source)
    run()
    run()
    assert sorted(r.text for r in spark.read.parquet(index).collect()) == ["a", "b", "c"]


def test_daily_counts_equal_the_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = spark.createDataFrame([(k, f"2024-01-0{1 + k % 3} 08:00:00", " Wrong" if k % 2 else "correct") for k in range(20)], "id int, created_at string, verdict string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    rows.write.parquet(source)
    query = daily_counts(read_stream(spark, source, rows.schema)).writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(str(r.day), r.verdict, r.n) for r in spark.table("daily").collect()}
    want = {(str(r.day), r.verdict, r.n) for r in rows.groupBy(F.to_date("created_at").alias("day"), F.lower(F.trim("verdict")).alias("verdict")).agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_points_come_when_the_next_begins(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "stream_id string, seq int, delta string, last boolean"
    spark.createDataFrame([("s", 1, "Right to Win: A\ntext ", False)], schema).write.parquet(source)
    stream = points(read_stream(spark, source, schema))
    query = stream.writeStream.outputMode("append").format("memory").queryName("points").start()
    try:
        seen = []
        for k, (delta, last) in enumerate([("more\nRight to Win: B\nx", False), (" end", True)], 2):
            query.processAllAvailable()
            seen.append([r.title for r in spark.table("points").orderBy("pos").collect()])
            spark.createDataFrame([("s", k, delta, last)], schema).write.mode("append").parquet(source)
            time.sleep(0.2)
        query.processAllAvailable()
        seen.append([r.title for r in spark.table("points").orderBy("pos").collect()])
    finally:
        query.stop()
    assert seen == [[], ["A"], ["A", "B"]]
