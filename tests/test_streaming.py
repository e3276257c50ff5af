"""Frame operators as streams: the same results as over tables, and what comes late."""

from pyspark.sql import functions as F

from splatframe.plans import views
from splatframe.streaming import frames

SF = "/root/testdata/sf0.001"


def stream(spark, rows, where, parts=3):
    """rows as a stream of several files, in order of time."""
    rows = rows.withColumn("token", F.col("frame"))
    spans = rows.agg(F.min("event_time").cast("long").alias("a"), F.max("event_time").cast("long").alias("b")).first()
    step = (spans["b"] - spans["a"]) // parts + 1
    for k in range(parts):
        low = spans["a"] + k * step
        rows.filter(F.col("event_time").cast("long").between(low, low + step - 1)).coalesce(1).write.mode("append").parquet(where)
    return rows, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(where)


def test_streams_agree_with_tables(spark, tmp_path):
    rows, live = stream(spark, views.frames(spark, SF), str(tmp_path / "in"))
    assert live.isStreaming
    cases = {
        "tumbling": lambda df: frames.windowed(df, "1 day").drop("end"),
        "sliding": lambda df: frames.windowed(df, "2 hours", "1 hour").drop("end"),
        "latest": frames.latest,
    }
    for name, make in cases.items():
        kept = [c for c in make(rows).columns if c != "total"]  # sums of doubles depend on their order
        got = frames.run_available(make(live), name, str(tmp_path / name), "complete").select(*kept)
        expected = make(rows).select(*kept)
        assert got.count() == expected.count() > 0 and got.exceptAll(expected).isEmpty()


def test_late_rows_drop_out_and_tokens_pass_once(spark, tmp_path):
    where = str(tmp_path / "in")
    put = lambda rows: spark.createDataFrame(rows, "event_id long, frame long, token long, event_time string, value double").withColumn("event_time", F.col("event_time").cast("timestamp")).coalesce(1).write.mode("append").parquet(where)  # noqa: E731, E501
    put([(1, 1, 7, "2024-01-01 10:00:00", 1.0), (2, 1, 7, "2024-01-01 10:01:00", 1.0)])
    schema = spark.read.parquet(where).schema
    live = lambda: spark.readStream.schema(schema).parquet(where)
    run = lambda name, df: sorted(r[0] for r in frames.run_available(df, name, str(tmp_path / name)).collect())
    assert run("once", frames.once(live()).select("token")) == [7]
    put([(3, 2, 8, "2024-01-01 18:00:00", 1.0)])
    out = str(tmp_path / "out")

    def hours():
        query = frames.windowed(live(), "1 hour", late="1 hour").select("n").writeStream.format("parquet").outputMode("append")
        query = query.option("checkpointLocation", str(tmp_path / "hours")).trigger(availableNow=True).start(out)
        query.awaitTermination()
        late = sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in query.recentProgress if p["stateOperators"])
        return sorted(r[0] for r in spark.read.parquet(out).collect()), late

    assert hours() == ([2], 0)  # the first hour is closed, the last one still open
    put([(4, 1, 9, "2024-01-01 10:30:00", 1.0), (5, 3, 9, "2024-01-02 10:00:00", 1.0)])
    assert hours() == ([1, 2], 1)  # what comes behind the watermark drops out


def test_missing_sequence_and_window(spark):
    df = spark.createDataFrame([("a", 1), ("a", 4), ("a", 20), ("b", 3)], "sequence string, frame long")
    got = {(r["sequence"], r["frame"]): (r["first_resident"], r["last_resident"], r["n_resident"]) for r in frames.frame_window(df).collect()}
    assert got == {("a", 1): (1, 4, 2), ("a", 4): (4, 4, 1), ("a", 20): (20, 20, 1), ("b", 3): (3, 3, 1)}


def test_sequences_are_written_with_a_manifest_in_frame_order(spark, tmp_path):
    import json

    df = spark.createDataFrame([(k, f) for f in (10, 2, 1) for k in range(3)], "splat_id long, frame long")
    frames.write_sequence(df, str(tmp_path / "seq"), 24.0)
    held = json.loads((tmp_path / "seq" / "manifest.json").read_text())
    assert held == {"fps": 24.0, "frames": ["frames/frame=1", "frames/frame=2", "frames/frame=10"]}
    assert spark.read.parquet(str(tmp_path / "seq" / "frames")).count() == 9
