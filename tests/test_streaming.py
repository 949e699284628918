"""Stream results equal batch results on events."""

from pyspark.sql import functions as F

from plumbline.plans.tables import Tables
from plumbline.streaming import windows
from plumbline.streaming.windows import merge_stream, tumbling


def test_tumbling_stream_equals_batch(spark, sf_dir, tmp_path):
    t = Tables(spark, sf_dir)
    t.event.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.event.schema).parquet(str(tmp_path / "in"))
    q = tumbling(stream, late="60 days").writeStream.format("memory").queryName("tumbling").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert sorted(map(tuple, spark.table("tumbling").collect())) == sorted(map(tuple, tumbling(t.event).collect()))


def test_merge_stream(spark, sf_dir, tmp_path):
    t = Tables(spark, sf_dir)
    rows = t.event.select((F.col("event_id") % 50).alias("id"), F.col("event_id").alias("version"), "kind")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    merge_stream(stream, str(tmp_path / "out"), "id", "version", str(tmp_path / "c")).awaitTermination(90)
    last = sorted((tmp_path / "out").iterdir(), key=lambda p: int(p.name[1:]))[-1]
    got = {(r.id, r.version) for r in spark.read.parquet(str(last)).collect()}
    assert got == {(r.id, r.v) for r in rows.groupBy("id").agg(F.max("version").alias("v")).collect()}


def test_feed_sends_changes_only(spark, sf_dir, tmp_path):
    t = Tables(spark, sf_dir)
    rows = t.event.select("event_id", "ts", "kind")
    sent = []
    for part, df in (("a", rows.orderBy(F.col("ts").desc()).limit(200)), ("b", rows.orderBy("ts").limit(20))):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        windows.follow_feed(stream, lambda x, k, part=part: sent.append((part, {r.event_id for r in x.collect()})), str(tmp_path / "s"), str(tmp_path / "c"), trigger={"availableNow": True}).awaitTermination(90)
    # the old rows of the second batch change nothing
    assert [p for p, _ in sent] == ["a"] and len(sent[0][1]) >= 8


def test_limiter_stream(spark, tmp_path):
    times = [(e, 10_000 + s) for e, s in ((1, 0), (2, 10), (3, 59), (4, 61), (5, 1000), (6, 1001))]
    rows = spark.createDataFrame([(e, 7, "error", s) for e, s in times], "event_id long, pol long, kind string, s long").selectExpr("event_id", "pol", "kind", "timestamp_seconds(s) ts")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "10 seconds")
    q = windows.limit_stream(stream).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = {r.event_id: (r.n, r.allowed) for r in spark.table("limited").collect()}
    assert got == {e: (n := sum(1 for _, x in times if s - 60 < x <= s), n <= 1) for e, s in times}


def test_audit_log(spark, tmp_path):
    from plumbline.sources import extract

    path = str(tmp_path / "log")
    for k in range(3):
        extract.append_audit(spark.createDataFrame([(f"t{k}{i}", f"entry {i}") for i in range(4)], "ts string, entry string"), path)
    assert [r.valid for r in extract.verify_audit(spark, path).orderBy("batch").collect()] == [True] * 3
    target = next(p for p in sorted((tmp_path / "log" / "entries").glob("*.json")) if "entry 2" in p.read_text() and "t1" in p.read_text())
    target.write_text(target.read_text().replace("entry 2", "entry X"))
    for crc in target.parent.glob(".*.crc"):
        crc.unlink()
    assert [r.valid for r in extract.verify_audit(spark, path).orderBy("batch").collect()] == [True, False, True]


def timed(spark, rows):
    return spark.createDataFrame(rows, "pol long, s long").selectExpr("pol", "timestamp_seconds(s) ts", "cast(1 as double) value", "'x' kind")


def streamed(spark, tmp_path, name, batches, build):
    """The rows that a stream over one file after the other gives in append mode."""
    for k, rows in enumerate(batches):
        timed(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(timed(spark, []).schema).parquet(str(tmp_path / "in"))
        build(stream).writeStream.format("parquet").option("path", str(tmp_path / name)).outputMode("append").option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start().awaitTermination(120)
    return sorted(map(tuple, spark.read.parquet(str(tmp_path / name)).collect()))


HOUR = 3600
#: Batches of (person, second): the third holds a row that comes after the watermark has passed its windows, and one that is just in time; the last closes all.
BATCHES = [[(1, 10 * HOUR), (1, 11 * HOUR), (2, 12 * HOUR)], [(1, 40 * HOUR), (2, 13 * HOUR)], [(2, 2 * HOUR), (2, 39 * HOUR)], [(9, 500 * HOUR)]]
LATE = [(2, 2 * HOUR)]


def test_sessions_and_sliding_windows_of_a_stream(spark, tmp_path):
    """Given once each, equal to the batch without the late row; the window of the closing row stays open."""
    kept = timed(spark, [r for b in BATCHES for r in b if r not in LATE])
    got = streamed(spark, tmp_path, "sessions", BATCHES, lambda s: windows.sessions(s, "6 hours", "20 hours"))
    assert got == sorted(tuple(r) for r in windows.sessions(kept).collect() if r.pol != 9)
    (tmp_path / "b").mkdir()
    got = streamed(spark, tmp_path / "b", "sliding", BATCHES, lambda s: windows.sliding(s, late="20 hours"))
    last = 400 * HOUR
    assert got == sorted(tuple(r) for r in windows.sliding(kept).collect() if r.start.timestamp() < last)


def test_chains_carry_their_last_hash(spark, tmp_path):
    """Chains go on over batches and restarts; a changed, a lost and an exchanged entry show."""
    schema = "chain string, ts timestamp, id long, entry string"
    for k in range(3):
        rows = [(f"c{i % 2}", i) for i in range(k * 10, k * 10 + 6)]
        df = spark.createDataFrame(rows, "chain string, id long").selectExpr("chain", "timestamp_seconds(1000 + id div 2) ts", "id", "concat('entry ', id) entry")
        df.repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        windows.chain_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert [(r.chain, r.n) for r in out.groupBy("chain").agg(F.max("seq").alias("n")).orderBy("chain").collect()] == [("c0", 8), ("c1", 8)]
    assert windows.broken_links(out).count() == 0
    one = (F.col("chain") == "c0") & (F.col("seq") == 4)
    assert [tuple(r) for r in windows.broken_links(out.withColumn("entry", F.when(one, "changed").otherwise(F.col("entry")))).collect()] == [("c0", 4)]
    assert [tuple(r) for r in windows.broken_links(out.filter(~one)).collect()] == [("c0", 5)]
