"""Recorder logs of one JSON object a line, and the tag table that goes back to the journal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.recorder import base_name

LINE = "struct<event: string, wall: string, ts: string, video_s: string, file: string, broken: string>"
#: Columns of the tag table.
TAG_COLUMNS = ("date", "symbol", "side", "price", "quantity", "tags", "notes")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file_path, line of all logs below a path; a log is read in as many parts as its size needs."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("line"))


def _parsed(lines: DataFrame) -> DataFrame:
    """lines that aren't blank, with j (the object) and bad: no JSON object."""
    full = lines.where(F.trim("line") != "")
    j = F.from_json("line", LINE, {"columnNameOfCorruptRecord": "broken"})
    return full.withColumn("j", j).withColumn("bad", ~F.ltrim("line").startswith("{") | F.col("j.broken").isNotNull())


def log_events(lines: DataFrame, key: str = "session_id") -> DataFrame:
    """key, row_no, event, wall, video_s, file of the readable lines (key, row_no, line): wall from 'wall', else 'ts'; video_s null unless finite; the file's bare name."""
    v = F.expr("try_cast(j.video_s as double)")
    named = F.when(F.col("j.file") != "", base_name(F.col("j.file")))
    return _parsed(lines).where(~F.col("bad")).select(
        key, "row_no", F.trim(F.coalesce("j.event", F.lit(""))).alias("event"), F.coalesce("j.wall", "j.ts").alias("wall"), F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v).alias("video_s"), named.alias("file")
    )


def log_states(sessions: DataFrame, lines: DataFrame, key: str = "session_id") -> DataFrame:
    """key, state of each session: 'missing' without a line in its log, 'invalid_json' with a broken one, else 'ok'."""
    seen = _parsed(lines).groupBy(F.col(key).alias("l_key")).agg(F.bool_or("bad").alias("any_bad"))
    state = F.when(F.col("l_key").isNull(), "missing").when(F.col("any_bad"), "invalid_json").otherwise("ok")
    return sessions.select(key).distinct().join(seen, F.col(key) == F.col("l_key"), "left").select(key, state.alias("state"))


def plain_number(x: Column, default: str = "") -> Column:
    """A number as text without a trailing '.0'."""
    return F.coalesce(F.regexp_replace(x.cast("string"), r"\.0+$", ""), F.lit(default))


def tag_rows(proposals: DataFrame, trades: DataFrame) -> DataFrame:
    """Rows of the tag table: trades with a proposal that isn't rejected. A trade without a date takes its session's, a quantity is 1 if unknown.

    proposals: trade_id, status, tags (array); trades: trade_id, session_id (starts with its date), session_date, instrument, side, price, qty.
    """
    p = proposals.where(~F.col("status").eqNullSafe("rejected")).select(F.col("trade_id").alias("p_id"), F.array_join("tags", ",").alias("tags"))
    date = F.coalesce(F.col("session_date").cast("string"), F.left("session_id", F.lit(10)))
    return trades.join(p, F.col("trade_id") == F.col("p_id")).select(
        date.alias("date"), F.coalesce("instrument", F.lit("")).alias("symbol"), F.coalesce("side", F.lit("")).alias("side"), plain_number(F.col("price")).alias("price"),
        plain_number(F.col("qty"), "1").alias("quantity"), F.coalesce("tags", F.lit("")).alias("tags"), F.concat(F.lit("trade "), F.col("trade_id").cast("string")).alias("notes"),
    )


def write_tags(rows: DataFrame, path: str) -> None:
    rows.select(*TAG_COLUMNS).write.csv(path, header=True, mode="overwrite", emptyValue="")
