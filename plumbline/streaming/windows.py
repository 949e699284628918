"""Streams: windows with watermarks, the feed and the limiter; each with a batch form the oracle can check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.registry import query
from plumbline.plans.tables import Tables


def tumbling(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """Counts per tumbling window and kind, on a batch or (with `late`, the watermark) on a stream."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if late and events.isStreaming else e
    return e.groupBy(F.window("ts", width).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "kind", "n", F.round("total", 3).alias("total"))


@query("st_tumbling", """SELECT date_trunc('day', ts) AS start, kind, count(*) AS n, round(sum(value), 3) AS total FROM event GROUP BY 1, 2""")
def q_tumbling(t: Tables) -> DataFrame:
    return tumbling(t.event).withColumn("start", F.col("start").cast("timestamp_ntz"))


def sliding(events: DataFrame, width: str = "6 hours", slide: str = "1 hour", late: str | None = None) -> DataFrame:
    """Counts per sliding window, on a batch or (with `late`, the watermark) on a stream, where a window is given once, when the watermark has passed its end."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if late and events.isStreaming else e
    return e.groupBy(F.window("ts", width, slide).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


@query("st02_sliding", """SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR * k AS start, count(*) AS n FROM event, (SELECT unnest(range(0, 6)) AS k) GROUP BY 1""")
def q_sliding(t: Tables) -> DataFrame:
    return sliding(t.event).withColumn("start", F.col("start").cast("timestamp_ntz"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str | None = None) -> DataFrame:
    """Each person's sessions, parted by gaps, on a batch or (with `late`) on a stream, where a session is given once, when the watermark has passed its end."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if late and events.isStreaming else e
    return e.groupBy("pol", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("pol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


@query("st_session", """, g AS (SELECT pol, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY pol ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM event), s AS (SELECT pol, ts, sum(new) OVER (PARTITION BY pol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT pol, min(ts) AS start, count(*) AS n FROM s GROUP BY pol, k""")
def q_session(t: Tables) -> DataFrame:
    return sessions(t.event).select("pol", F.col("start").cast("timestamp_ntz").alias("start"), "n")


CHAINED = "chain string, seq long, ts timestamp, entry string, previous string, hash string"


def chain_stream(entries: DataFrame) -> DataFrame:
    """Entries (chain, ts, id, entry) of a stream with their place in their chain, the hash before and their own: a chain's state is its last
    hash and length alone. Entries of a micro-batch follow by ts and id, batches as they come."""
    import hashlib

    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames, state):
        length, last = state.get if state.exists else (0, "")
        # a micro-batch's entries of one chain are sorted together, as they may come in any order
        rows = pd.concat(list(frames)).sort_values(["ts", "id"])
        out = []
        for ts, entry in zip(rows.ts, rows.entry, strict=True):
            digest = hashlib.sha256(f"{last}|{int(ts.value // 1000)}|{entry}".encode()).hexdigest()
            out.append((key[0], length, ts, entry, last, digest))
            length, last = length + 1, digest
        state.update((length, last))
        yield pd.DataFrame(out, columns=["chain", "seq", "ts", "entry", "previous", "hash"])

    return entries.groupBy("chain").applyInPandasWithState(step, CHAINED, "length long, last string", "append", GroupStateTimeout.NoTimeout)


def broken_links(chained: DataFrame) -> DataFrame:
    """chain and seq of the entries whose hash is not that of their content or whose previous hash is not that of the entry before; also gaps."""
    from pyspark.sql import Window

    w = Window.partitionBy("chain").orderBy("seq")
    again = F.sha2(F.concat_ws("|", "previous", F.unix_micros("ts").cast("string"), "entry"), 256)
    fine = (again == F.col("hash")) & (F.col("previous") == F.coalesce(F.lag("hash").over(w), F.lit(""))) & (F.col("seq") == F.coalesce(F.lag("seq").over(w) + 1, F.lit(0)))
    return chained.withColumn("_fine", fine).filter(~F.coalesce("_fine", F.lit(False))).select("chain", "seq")


@query("st01_feed", """SELECT kind, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ts DESC, event_id DESC) AS k FROM event) WHERE k <= 8""")
def feed(t: Tables, newest: int = 8) -> DataFrame:
    """The newest rows of each kind."""
    from pyspark.sql import Window

    w = Window.partitionBy("kind").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return t.event.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= newest).select("kind", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


def follow_feed(stream: DataFrame, sink, state: str, checkpoint: str, newest: int = 8, trigger: dict | None = None):
    """The feed on a stream: sink(rows, number) gets the newest rows of each kind only when their ids have changed. The rows last sent are kept in the folder `state`, one version a batch."""
    from pyspark.errors import AnalysisException
    from pyspark.sql import Window

    w = Window.partitionBy("kind").orderBy(F.col("ts").desc(), F.col("event_id").desc())

    def send(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            sent = spark.read.parquet(f"{state}/last={number - 1}")
        except AnalysisException:
            sent = batch.limit(0)
        now = sent.unionByName(batch).dropDuplicates(["event_id"]).withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= newest).drop("_k")
        now.write.mode("overwrite").parquet(f"{state}/last={number}")
        now = spark.read.parquet(f"{state}/last={number}")
        if not now.select("event_id").exceptAll(sent.select("event_id")).isEmpty():
            sink(now, number)

    return stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "15 seconds"})).start()


#: Requests that a key may make in a window, by kind; other kinds have OTHERS.
LIMITS = {"purchase": 2, "signup": 3, "error": 1}
OTHERS = 5


@query("st02_limiter", """SELECT event_id, n, n <= CASE kind WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'error' THEN 1 ELSE 5 END AS allowed FROM (SELECT event_id, kind, count(*) OVER (PARTITION BY pol, kind ORDER BY epoch(ts) RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS n FROM (SELECT event_id, pol, kind, CAST(date_trunc('second', ts) AS TIMESTAMP) AS ts FROM event))""")
def limiter(t: Tables, seconds: int = 86_400) -> DataFrame:
    """Requests of each key in the window that ends with each of them, against the limit of its kind."""
    from pyspark.sql import Window

    w = Window.partitionBy("pol", "kind").orderBy("s").rangeBetween(-(seconds - 1), 0)
    known = F.create_map(*[F.lit(x) for pair in LIMITS.items() for x in pair])
    x = t.event.select("event_id", "pol", "kind", F.unix_timestamp("ts").alias("s")).withColumn("n", F.count(F.lit(1)).over(w))
    return x.select("event_id", "n", (F.col("n") <= F.coalesce(known[F.col("kind")], F.lit(OTHERS))).alias("allowed"))


def limit_stream(events: DataFrame, seconds: int = 60, idle: str = "300 seconds") -> DataFrame:
    """The limiter on a stream with a watermark on ts: a key keeps the times of its last window, and is forgotten when it has been idle for longer (event time)."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["s", "event_id"])
        out = []
        for s, group in rows.groupby("s", sort=True):
            times = [x for x in times if x > s - seconds] + [int(s)] * len(group)
            out += [(int(e), len(times), len(times) <= LIMITS.get(key[1], OTHERS)) for e in group.event_id]
        state.update((times,))
        state.setTimeoutTimestamp(max(int(rows.s.max()) * 1000, state.getCurrentWatermarkMs()) + wait)
        yield pd.DataFrame(out, columns=["event_id", "n", "allowed"])

    keyed = events.withColumn("s", F.unix_timestamp("ts")).groupBy("pol", "kind")
    return keyed.applyInPandasWithState(step, "event_id long, n long, allowed boolean", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def merge_stream(stream: DataFrame, path: str, key: str, version: str, checkpoint: str):
    """Upserts each micro-batch into a Parquet table by key: reads, merges, writes beside it and swaps the versioned folder."""
    from plumbline.operators.resolution import upsert

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/v{number}") if number else batch.limit(0)
        upsert(old, batch, key, version).write.mode("overwrite").parquet(f"{path}/v{number + 1}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
