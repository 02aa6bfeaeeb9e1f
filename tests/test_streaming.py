from pyspark.sql import functions as F

from alphaline.streaming import jobs


def test_process_new_resumes(spark, tmp_path):
    source, sink, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for part in (range(3), range(3, 5)):
        spark.createDataFrame([(i,) for i in part], "k long").write.mode("append").parquet(source)
        jobs.process_new(spark, source, "k long", lambda d: d.withColumn("v", F.col("k") * 2), sink, mark)
    assert sorted(spark.read.parquet(sink).collect()) == [(i, 2 * i) for i in range(5)]


def test_upsert_keeps_the_newest(spark, tmp_path):
    source, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    held = {}
    for rows in ([("a", 1), ("b", 1)], [("a", 2)]):
        spark.createDataFrame(rows, "k string, v int").write.mode("append").parquet(source)
        jobs.upsert_new(spark, source, "k string, v int", "k", "v", lambda: spark.createDataFrame(held["rows"], "k string, v int") if held else None, lambda d: held.update(rows=d.collect()), mark)
    assert sorted(tuple(r) for r in held["rows"]) == [("a", 2), ("b", 1)]


def test_growth_windows_match_batch(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert jobs.growth(events, "ts", "event_type").agg(F.sum("n")).first()[0] == events.count()


def test_stalls():
    assert jobs.stalled([1] * 7) and not jobs.stalled([1, 2, 3, 4, 5, 6, 7]) and not jobs.stalled([1])
