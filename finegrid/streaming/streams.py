"""Streaming forms of the batch operators.  Each takes a streaming DataFrame and returns one."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from finegrid.operators.relational import keep_one
from finegrid.session import scratch_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, folder: str, pattern: str, schema, time: str | None = None, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files at any depth below ``folder`` as a stream; the event time becomes a timestamp that can carry a watermark."""
    src = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return src if time is None else src.withColumn(time, F.col(time).cast("timestamp"))


def run_available(stream: DataFrame, mode: str = "append", name: str = "stream", path: str | None = None, rocks: bool = False) -> DataFrame:
    """Process everything that is available, then return what was written below the shared folder.

    ``update`` keeps what each micro-batch changed in a folder of its number, so a repeated batch replaces its own
    rows; ``complete`` keeps the last result.  With the ``path`` of an earlier run the stream goes on where that ended.
    ``rocks`` holds the state in RocksDB, which custom state needs, whatever the session says.
    """
    spark = stream.sparkSession
    base = path or scratch_path(spark, name)
    out, check = f"{base}/rows", f"{base}/checkpoint"

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={epoch}" if mode == "update" else out)

    writer = stream.writeStream.option("checkpointLocation", check).outputMode(mode).trigger(availableNow=True)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    if rocks:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # a query keeps the setting that it started with
    try:
        q = writer.format("parquet").option("path", out).start() if mode == "append" else writer.foreachBatch(save).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    q.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", str(mode == "update")).parquet(out)


def daily(stream: DataFrame, keys: list[str], time: str, value: str, delay: str, min_rows: int) -> DataFrame:
    """Daily total, extremes and count per key; incomplete days have no values.  A day is emitted once it can no longer change."""
    day = stream.withWatermark(time, delay).groupBy(*keys, F.window(time, "1 day").alias("w")).agg(
        F.sum(value).alias("_s"), F.max(value).alias("_hi"), F.min(value).alias("_lo"), F.count(value).alias("n"))
    ok = F.col("n") >= min_rows
    return day.select(*keys, F.to_date("w.start").alias("d"), F.when(ok, F.col("_s")).alias("total"), F.when(ok, F.col("_hi")).alias("highest"), F.when(ok, F.col("_lo")).alias("lowest"), "n")


def sliding_total(stream: DataFrame, keys: list[str], time: str, value: str, delay: str, length: str = "6 hours", slide: str = "15 minutes") -> DataFrame:
    """Total, largest step and step count of every sliding window."""
    w = stream.withWatermark(time, delay).groupBy(*keys, F.window(time, length, slide).alias("w"))
    return w.agg(F.sum(value).alias("total"), F.max(value).alias("max_step"), F.count(value).alias("steps")).select(*keys, F.col("w.start").alias("start"), "total", "max_step", "steps")


def sessions(stream: DataFrame, keys: list[str], time: str, value: str, wet: float, gap: str, delay: str) -> DataFrame:
    """Wet spells: rows at or above ``wet`` closer together than ``gap``."""
    s = stream.where(F.col(value) >= wet).withWatermark(time, delay).groupBy(*keys, F.session_window(time, gap).alias("w"))
    return s.agg(F.sum(value).alias("total"), F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "total", "n")


def first_of_each(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Repeated events within the delay are dropped; state older than the delay is forgotten."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def with_units(stream: DataFrame, units: DataFrame, key: str) -> DataFrame:
    """Unit attributes on every event (stream against a table)."""
    return stream.join(units, key, "left")


def verify_live(forecasts: DataFrame, observations: DataFrame, key: str, issued: str, seen: str, delay: str, horizon: str) -> DataFrame:
    """Every forecast with the observations of its key at most ``horizon`` after the issue.

    A forecast that nobody observed comes out once, with nulls, when the watermark has passed its interval.
    """
    f = forecasts.withWatermark(issued, delay).alias("f")
    o = observations.withWatermark(seen, delay).alias("o")
    on = (F.col(f"f.{key}") == F.col(f"o.{key}")) & (F.col(f"o.{seen}") >= F.col(f"f.{issued}")) & (F.col(f"o.{seen}") <= F.col(f"f.{issued}") + F.expr(f"interval {horizon}"))
    return f.join(o, on, "left_outer")


def files_in_order(df: DataFrame, ordinal: Column, name: str = "slices") -> str:
    """``df`` as a file per value of ``ordinal`` (whole numbers from 0), dated in its order, for a stream that takes them one by one."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.withColumn("file_", ordinal).repartition("file_").write.partitionBy("file_").parquet(path)
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for p in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/file_=*/part-*")):
        number = int(p.getPath().getParent().getName().split("=")[1])
        fs.setTimes(p.getPath(), 1_700_000_000_000 + 1000 * number, -1)
    return path


def slices(df: DataFrame, time: str, files: int) -> Column:
    """Ordinal of a row: the whole time from first to last in ``files`` equal parts, whatever the rows' partitions."""
    low, high = df.agg(F.min(F.col(time).cast("timestamp").cast("double")), F.max(F.col(time).cast("timestamp").cast("double"))).first()
    if low is None:
        return F.lit(0)
    at = (F.col(time).cast("timestamp").cast("double") - low) * files / ((high - low) or 1.0)
    return F.coalesce(F.least(F.floor(at), F.lit(files - 1)), F.lit(0)).cast("int")


def latest(stream: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` of each key so far, one row of state per key; for update mode, which puts out changed keys."""
    rest = [c for c in stream.columns if c not in keys]
    newest = stream.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row_"))
    return newest.select(*[F.col(c) if c in keys else F.col("row_")[c].alias(c) for c in stream.columns])


def run_latest(stream: DataFrame, keys: list[str], order: list[str], name: str = "latest", path: str | None = None) -> DataFrame:
    """`latest` of all that is available: of the changes that the batches wrote, the last of each key."""
    return keep_one(run_available(latest(stream, keys, order), "update", name, path), keys, order)


DAY_MS = 86_400_000


class Streaks(StatefulProcessor):
    """Counts a key's days in their order.  State: the run so far, its last day, and the days that wait; a timer at the end of the first of those.

    All of it is one value, as each call of the state store costs more than the few days that wait.
    """

    # Spark passes the arguments by these names
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "length int, last long, days array<long>, oks array<boolean>")

    def _held(self) -> tuple[int, int, dict[int, bool]]:
        if not self.state.exists():
            return 0, -(1 << 62), {}
        length, last, days, oks = self.state.get()
        return length, last, dict(zip(days, oks))

    def _keep(self, length: int, last: int, waiting: dict[int, bool], timer: bool) -> None:
        self.state.update((length, last, list(waiting), list(waiting.values())))
        if timer and waiting:
            self.handle.registerTimer(min(waiting) + DAY_MS - 1)  # fires when the watermark is beyond it

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        length, last, waiting = self._held()
        first = min(waiting, default=1 << 62)
        for row in rows:
            if row.ms + DAY_MS > mark:  # its end has not passed, so it was not put out yet
                waiting[int(row.ms)] = bool(row.ok)
        self._keep(length, last, waiting, min(waiting, default=1 << 62) < first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        length, last, waiting = self._held()
        out = []
        for day in sorted(d for d in waiting if d + DAY_MS <= mark):
            length = (length if day - last == DAY_MS else 0) + 1 if waiting.pop(day) else 0
            last = day
            out.append(Row(key=key[0], ms=day, run=length))
        self._keep(length, last, waiting, True)
        return iter(out)

    def close(self) -> None:
        pass


def streaks(days: DataFrame, key: str, day: str, favourable: Column, delay: str) -> DataFrame:
    """Running length of the current favourable streak per key, in the order of the days, whatever order they arrive in.

    A day comes out when the watermark (``delay`` behind the newest day seen) has passed its end, at any cut of the
    input into batches; days that come later than that are dropped, of a repeated day the last row counts; a missing
    day ends a streak.  A row of any key that lies ``delay`` and two days after the last day of a bounded input
    brings out all the others.
    """
    at = F.col(day).cast("timestamp")
    src = days.select(F.col(key).cast("string").alias("key"), at.alias("day"), (at.cast("double") * 1000).cast("long").alias("ms"), F.coalesce(favourable, F.lit(False)).alias("ok")).withWatermark("day", delay)
    out = src.groupBy("key").transformWithState(Streaks(), "key string, ms long, run int", "append", "eventTime")
    return out.select("key", F.to_date(F.timestamp_millis("ms")).alias("day"), "run")


def newest_day(stream: DataFrame, day: str) -> DataFrame:
    """The newest day of the stream so far: one number of state."""
    return stream.agg(F.max(day).alias("newest"))


def freshness(newest: DataFrame, today: Column, max_age: int) -> DataFrame:
    """``newest`` day, its age, and whether a refresh is due."""
    age = F.datediff(today, F.col("newest"))
    return newest.select("newest", age.alias("age_days"), (age > max_age).alias("refresh"))
