"""Queries that run as streams, most over several micro-batches; SQL on the whole table checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals
from ..sources.shared import shared_path
from ..streaming import live
from .fixtures import base, view
from .interval_queries import EC
from .pairing_queries import fifo_sql
from .registry import query

SLICES, CLOCK_US = 4, 4_102_444_800_000_000

US = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.watch(spark, f"{sf_dir}/events.parque[t]", base(spark, sf_dir, "events").schema).withColumn("ts_us", F.expr(US))


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events as a table, ts as an instant."""
    return base(spark, sf_dir, "events").withColumn("ts_us", F.expr(US)).withColumn("ts", F.timestamp_micros("ts_us"))


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("event_type in ('purchase', 'click')")
    return e.select("event_id", "user_id", (F.col("user_id") % 7).alias("account"), F.when(F.col("event_type") == "purchase", "buy").otherwise("sell").alias("side"), (1 + F.col("event_id") % 3).alias("qty"), F.col("event_id").alias("row_id"), "ts_us")


def slices(df: DataFrame, ts_us: str, n: int = SLICES) -> list[DataFrame]:
    """A stored df in n parts of equal time."""
    lo, hi = df.agg(F.min(ts_us), F.max(ts_us)).first()
    if lo is None:
        return [df]
    part = F.least(F.floor((F.col(ts_us) - lo) * n / (hi - lo + 1)), F.lit(n - 1))
    return [df.where(part == i) for i in range(n)]


def sliced(df: DataFrame, key: str, build) -> DataFrame:  # noqa: ANN001
    """Rows of a stream over df in append mode: it arrives in slices of time, then a row of a far later time and of key -1 moves the watermark past all."""
    path = shared_path(df.sparkSession, "events")
    df.write.parquet(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    first = held.limit(1).withColumns({"ts_us": F.lit(CLOCK_US), "ts": F.timestamp_micros(F.lit(CLOCK_US)), key: F.lit(-1).cast(df.schema[key].dataType)})
    return live.replay(df.sparkSession, {"e": [*slices(held, "ts_us"), first.select(df.columns)]}, lambda s: build(s["e"])).where(F.col(key) >= 0)


@query("stream_dedupe", "SELECT DISTINCT event_id, user_id FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event arrives twice."""
    e = events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "user_id", "ts")
    return live.available(live.dedupe(e.unionByName(e), ["event_id"])).select("event_id", "user_id")


@query("stream_hourly", "SELECT user_id % 7 AS account, epoch_us(ts) // 3600000000 AS hour_no, count(*) AS n FROM events GROUP BY ALL")
def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = batch(spark, sf_dir).select((F.col("user_id") % 7).alias("account"), "ts_us", "ts")
    out = sliced(e, "account", lambda x: live.hourly_counts(x, ["account"]))
    return out.select("account", F.floor(F.unix_micros("hour") / 3_600_000_000).alias("hour_no"), "n")


@query(
    "stream_activity",
    """e AS (SELECT user_id, epoch_us(ts) AS t FROM events), m AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < 1800000000 THEN 0 ELSE 1 END AS f FROM e),
g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM m) SELECT user_id, min(t) AS start_us, max(t) + 1800000000 AS end_us, count(*) AS n FROM g GROUP BY user_id, s""",
)
def stream_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sliced(batch(spark, sf_dir).select("user_id", "ts_us", "ts"), "user_id", lambda x: live.activity(x, ["user_id"]))
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("stream_late", "SELECT fill_id, session_id FROM executions e JOIN clips c ON e.user_id = c.user_id AND ts_us BETWEEN start_us - 1800000000 AND end_us + 1800000000", EC)
def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills of the stream in the padded windows of known clips."""
    f = fills(spark, sf_dir).select(F.col("event_id").alias("fill_id"), "user_id", "ts_us")
    return live.available(intervals.window_fills(f, view(spark, sf_dir, "clips"), ["user_id"]))


@query("stream_fifo", fifo_sql("executions", "account", "lots") + " SELECT account, lot_seq, qty, entry_fill_id, exit_fill_id FROM lots WHERE status = 'closed'", ("executions",))
def stream_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "executions").select("account", F.col("fill_id").alias("row_id"), "ts_us", F.timestamp_micros("ts_us").alias("ts"), "side", "qty")
    return sliced(f, "account", lambda x: live.fifo(x, ["account"]))


@query(
    "stream_breaches",
    """e AS (SELECT user_id, event_id, epoch_us(ts) AS t, CASE WHEN event_id % 17 = 0 THEN NULL WHEN value < 40 THEN -1 ELSE 1 END AS pnl FROM events),
i AS (SELECT *, count(*) FILTER (WHERE pnl IS NULL OR pnl > 0) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS g FROM e),
s AS (SELECT *, count(*) FILTER (WHERE pnl < 0) OVER (PARTITION BY user_id, g ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM i) SELECT user_id, event_id AS row_id, streak FROM s WHERE pnl < 0 AND streak >= 3""",
)
def stream_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = batch(spark, sf_dir)
    pnl = F.when(F.col("event_id") % 17 == 0, F.lit(None).cast("double")).when(F.col("value") < 40, F.lit(-1.0)).otherwise(F.lit(1.0))
    return sliced(e.select("user_id", F.col("event_id").alias("row_id"), "ts_us", "ts", pnl.alias("pnl")), "user_id", lambda x: live.streaks(x, "user_id"))


@query(
    "stream_sections",
    """e AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_type IN ('view', 'click') AS o FROM events WHERE event_type <> 'error'),
n AS (SELECT *, lead(o) OVER w AS no, lead(t) OVER w AS nt, count(*) FILTER (WHERE o) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS idx FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT user_id, idx, t AS wall_start_us, nt AS wall_end_us FROM n WHERE o AND NOT no""",
)
def stream_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = batch(spark, sf_dir).where("event_type <> 'error'")
    kind = F.when(F.col("event_type").isin("view", "click"), "resume").otherwise("pause")
    return sliced(e.select("user_id", F.col("event_id").alias("row_id"), "ts_us", "ts", kind.alias("event")), "user_id", lambda x: live.sections(x, "user_id"))
