"""Streaming forms of the session operators.

A directory of files is the stream; ``available`` runs what is there and stops (the watcher's "once"), the same code with a
processing-time trigger runs forever. The checkpoint remembers which files were taken, so nothing is read twice.
Batch operators are the reference for all results.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..sources.shared import shared_path

LATE = "30 minutes"


def watch(spark: SparkSession, path: str, schema: StructType, max_files: int | None = None) -> DataFrame:
    """The files of a directory, or of a glob of files, as a stream, oldest first."""
    reader = spark.readStream.schema(schema).option("latestFirst", "false")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and returns its rows; in complete mode the last result."""
    spark = stream.sparkSession
    out, check = shared_path(spark, "stream"), shared_path(spark, "stream-state")
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
    else:
        q = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", check).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def replay(spark: SparkSession, feeds: Mapping[str, Sequence[DataFrame]], build: Callable[[dict[str, DataFrame]], DataFrame]) -> DataFrame:
    """Rows of a stream in append mode over feeds that arrive slice by slice: each slice is a micro-batch, after each the query stops and goes on from its checkpoint."""
    out, check = shared_path(spark, "stream"), shared_path(spark, "stream-state")
    paths = {name: shared_path(spark, f"feed-{name}") for name in feeds}
    schema = None
    before = spark.conf.get(ROCKS[0], None)
    spark.conf.set(*ROCKS)
    try:
        for i in range(max(map(len, feeds.values()))):
            for name, slices in feeds.items():
                # Empty slices still leave a file, so that every source has its folder.
                (slices[i] if i < len(slices) else slices[0].limit(0)).write.mode("append").parquet(paths[name])
            stream = build({name: watch(spark, paths[name], slices[0].schema) for name, slices in feeds.items()})
            schema = stream.schema
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(ROCKS[0], before) if before else spark.conf.unset(ROCKS[0])
    return spark.read.schema(schema).parquet(out)


def clip_parts(clips: DataFrame, pad: str = LATE, longest: str = "6 hours") -> DataFrame:
    """clips (start_ts, end_ts, ...) as parts from_ts (inclusive) to to_ts (exclusive) that tile the padded window, none longer than ``longest``: what a recorder hands over part by part."""
    begin, end = F.col("start_ts") - F.expr(f"INTERVAL {pad}"), F.col("end_ts") + F.expr(f"INTERVAL {pad}") + F.expr("INTERVAL 1 microsecond")
    cut = clips.where("start_ts <= end_ts").withColumn("from_ts", F.explode(F.sequence(begin, end, F.expr(f"INTERVAL {longest}"))))
    return cut.withColumn("to_ts", F.least(F.col("from_ts") + F.expr(f"INTERVAL {longest}"), end)).where("from_ts < to_ts").drop("start_ts", "end_ts")


def fills_of_parts(fills: DataFrame, parts: DataFrame, key: str, late: str = LATE, longest: str = "6 hours") -> DataFrame:
    """Fills with the clips in whose parts they lie, where both are streams. fills: key, ts, ...; parts: key, from_ts, to_ts, ... of other names.

    A part comes when it is over, so its event time is its end. State is bounded on both sides: a part is kept until the watermark
    passes its end, a fill until it passes the fill by the longest part. Rows that are older than the watermark when they come are dropped.
    """
    p = parts.withColumnRenamed(key, "p_key").withWatermark("to_ts", late)
    inside = (F.col("ts") >= F.col("from_ts")) & (F.col("ts") < F.col("to_ts")) & (F.col("ts") >= F.col("to_ts") - F.expr(f"INTERVAL {longest}"))
    return fills.withWatermark("ts", late).join(p, (F.col(key) == F.col("p_key")) & inside).drop("p_key", "from_ts", "to_ts")


def dedupe(stream: DataFrame, keys: Sequence[str], ts: str = "ts", late: str = LATE) -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def hourly_counts(stream: DataFrame, keys: Sequence[str], ts: str = "ts", late: str = LATE) -> DataFrame:
    """keys, hour, n: rows by tumbling hour."""
    w = F.window(ts, "1 hour")
    return stream.withWatermark(ts, late).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("hour"), "n")


def activity(stream: DataFrame, keys: Sequence[str], ts: str = "ts", gap: str = LATE, late: str = LATE) -> DataFrame:
    """keys, start, end, n: rows by sessions that a gap ends."""
    w = F.session_window(ts, gap)
    return stream.withWatermark(ts, late).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class InOrder(StatefulProcessor):
    """Hands each key's rows to a step in time order: rows wait until the watermark has passed them, whatever batch they came in.

    The state is that of a bucket of keys, so that calls to the state store grow with the buckets and batches, not with the keys; each row of it begins with its key.
    step(key, rows, held, value) returns output rows, the new held rows and the new value. Rows are tuples of ts_us, row_id and the further columns.
    """

    def __init__(self, step: Callable, columns: str, held: str, value: str, names: list[str]):
        self.step, self.columns, self.held_schema, self.value_schema, self.names = step, columns, held, value, names
        self.fields = ["of_key", *(c.split()[0] for c in columns.split(", "))]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"of_key string, {self.columns}")
        self.held = handle.getListState("held", f"of_key string, {self.held_schema}")
        self.values = handle.getListState("values", f"of_key string, {self.value_schema}")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        new = [tuple(plain(x) for x in r) for b in rows for r in b[self.fields].itertuples(index=False, name=None)]
        self.waiting.appendList(new)
        # A timer comes one millisecond after the earliest row that waits already.
        self._wake(min([*(r[1] for r in new), *((t - 1) * 1000 for t in self.handle.listTimers())], default=None))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        ready, left, held, values = {}, [], {}, {r[0]: tuple(r[1:]) for r in self.values.get()}
        for r in sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[1], r[2])):
            if r[1] < now:
                ready.setdefault(r[0], []).append(r[1:])
            else:
                left.append(r)
        for r in self.held.get():
            held.setdefault(r[0], []).append(tuple(r[1:]))
        out = []
        for k, rows in ready.items():
            found, held[k], values[k] = self.step((k,), rows, held.get(k, []), values.get(k))
            out += found
        for state, rows in ((self.waiting, left), (self.held, [(k, *r) for k, h in held.items() for r in h]), (self.values, [(k, *v) for k, v in values.items()])):
            if rows:
                state.put(rows)
            else:
                state.clear()
        self._wake(left[0][1] if left else None)
        if out:
            yield pd.DataFrame({n: pd.Series([r[i] for r in out], dtype=object) for i, n in enumerate(self.names)})

    def _wake(self, first: int | None) -> None:
        """One timer, for the earliest row that waits."""
        known = list(self.handle.listTimers())
        for t in known:
            self.handle.deleteTimer(t)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)


def plain(value: object) -> object:
    """None for every kind of missing value, and Python's own numbers."""
    return None if value is None or value is pd.NA or value != value else value.item() if hasattr(value, "item") else value


#: Fixed value: buckets of keys of a stateful operator.
BUCKETS = 256


def in_order(stream: DataFrame, keys: Sequence[str], columns: str, step: Callable, output: str, held: str, value: str, late: str = LATE, buckets: int = BUCKETS) -> DataFrame:
    """A stateful operator over rows in time order. stream: keys, ts (event time), ts_us, row_id and the further columns; output: columns after the keys. Needs the RocksDB state store.

    A step sees the key as one text. A bucket's open rows and values are in one task's memory at a time.
    """
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    kinds = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys)
    key = F.to_json(F.struct(*keys), exact)
    names = ["of_key", *(c.split()[0] for c in output.split(", "))]
    kept = stream.withWatermark("ts", late).withColumn("of_key", key).withColumn("bucket", F.pmod(F.xxhash64("of_key"), F.lit(buckets)).cast("int")).select("bucket", "of_key", "ts", *(c.split()[0] for c in f"ts_us long, row_id long, {columns}".split(", ")))
    out = kept.groupBy("bucket").transformWithStateInPandas(InOrder(step, f"ts_us long, row_id long, {columns}", held, value, names), f"of_key string, {output}", "append", "EventTime")
    return out.withColumn("of_key", F.from_json("of_key", kinds, exact)).select("of_key.*", *names[1:])


def fifo_step(key: tuple, rows: list[tuple], held: list[tuple], value: tuple | None) -> tuple[list[tuple], list[tuple], tuple]:
    """Closes lots first in, first out; held are the open lots, all on one side, the value is the number of closed ones."""
    lots, seq, out = deque(list(r) for r in held), value[0] if value else 0, []
    for _, fill, side, left in rows:
        while left and lots and lots[0][1] != side:
            take = min(left, lots[0][2])
            out.append((*key, seq, take, lots[0][0], fill))
            seq += 1
            left -= take
            lots[0][2] -= take
            if not lots[0][2]:
                lots.popleft()
        if left:
            lots.append([fill, side, left])
    return out, [tuple(r) for r in lots], (seq,)


def fifo(stream: DataFrame, keys: Sequence[str], late: str = LATE) -> DataFrame:
    """keys, lot_seq, qty, entry_fill_id, exit_fill_id of closed lots. stream: keys, ts, ts_us, row_id, side, qty."""
    return in_order(stream, keys, "side string, qty long", fifo_step, "lot_seq long, qty long, entry_fill_id long, exit_fill_id long", "fill long, side string, qty long", "seq long", late)


def streak_step(key: tuple, rows: list[tuple], held: list[tuple], value: tuple | None, n: int = 3) -> tuple[list[tuple], list[tuple], tuple]:
    """Length of the losing streak after each result of n losses or more; a gain or an unknown result ends it."""
    run, out = value[0] if value else 0, []
    for _, row, pnl in rows:
        run = run + 1 if pnl is not None and pnl < 0 else 0
        if run >= n:
            out.append((*key, row, run))
    return out, [], (run,)


def streaks(stream: DataFrame, key: str, late: str = LATE) -> DataFrame:
    """key, row_id, streak. stream: key, ts, ts_us, row_id, pnl."""
    return in_order(stream, [key], "pnl double", streak_step, "row_id long, streak long", "none long", "run long", late)


def section_step(key: tuple, rows: list[tuple], held: list[tuple], value: tuple | None) -> tuple[list[tuple], list[tuple], tuple]:
    """Recorder sections: a start or resume opens, a pause or stop closes; the value is the open one's start and its number."""
    opened, n = value if value else (None, 0)
    out = []
    for wall, _, event in rows:
        if event in ("record_start", "resume"):
            opened, n = wall, n + 1
        elif opened is not None:
            out.append((*key, n, opened, wall))
            opened = None
    return out, [], (opened, n)


def sections(stream: DataFrame, key: str, late: str = LATE) -> DataFrame:
    """key, idx, wall_start_us, wall_end_us. stream: key, ts, ts_us, row_id, event."""
    return in_order(stream, [key], "event string", section_step, "idx long, wall_start_us long, wall_end_us long", "none long", "opened long, n long", late)
