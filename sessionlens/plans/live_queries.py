"""Streams that run over several micro-batches, stopped and resumed in between; batch SQL on the whole tables checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules
from ..sources.shared import stored
from ..streaming import live, rule_blocks
from .fixtures import view
from .interval_queries import EC
from .registry import query
from .stream_queries import CLOCK_US, slices
from .rule_queries import CONFIG, KEYS, NEXT, POST, STREAK, TRADES, trades


@query(
    "stream_rule_blocks",
    TRADES + STREAK.replace("br AS", "sb AS") + POST[len(NEXT) :].replace("br AS", "pb AS")
    + """, ends AS (SELECT account, session_date, exit_us, max(exit_us) OVER (PARTITION BY account, session_date ORDER BY exit_us, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 300000000 AS so_far, trade_id FROM p WHERE closed AND pnl < 0),
isles AS (SELECT *, count(*) FILTER (WHERE so_far IS NULL OR exit_us >= so_far) OVER (PARTITION BY account, session_date ORDER BY exit_us, trade_id ROWS UNBOUNDED PRECEDING) AS g FROM ends)
SELECT account, session_date, 'streak' AS kind, trade_id, next_trade_id, gap_us, streak FROM sb UNION ALL SELECT account, session_date, 'post_loss', trade_id, next_trade_id, gap_us, NULL FROM pb
UNION ALL SELECT account, session_date, 'block_end ' || (max(exit_us) + 300000000), NULL, NULL, NULL, NULL FROM isles GROUP BY account, session_date, g""",
    ("executions",),
)
def stream_rule_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaks, post-loss entries and ends of blocks; a last slice of a later day moves the watermark past all events."""
    t = trades(spark, sf_dir).withColumn("pnl", rules.realized())
    events = rule_blocks.trade_events(t, KEYS, rules.stopped_on_entry(CONFIG))
    feed = slices(stored(events), "ts_us")
    later = feed[0].limit(1).withColumn("ts_us", F.lit(CLOCK_US)).withColumn("ts", F.timestamp_micros("ts_us")).withColumn("account", F.lit(-1).cast(events.schema["account"].dataType)).withColumn("kind", F.lit("clock"))
    out = live.replay(spark, {"events": [*feed, later.select(events.columns)]}, lambda s: rule_blocks.rule_blocks(s["events"], KEYS, CONFIG))
    kind = F.when(F.col("kind") == "block_end", F.concat_ws(" ", "kind", "at_us")).otherwise(F.col("kind"))
    return out.where("account >= 0").select(*KEYS, kind.alias("kind"), "trade_id", "next_trade_id", "gap_us", "streak")


@query("stream_join", "SELECT fill_id, session_id FROM executions e JOIN clips c ON e.user_id = c.user_id AND ts_us BETWEEN start_us - 1800000000 AND end_us + 1800000000", EC)
def stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills and recorder parts, both arriving over time."""
    fills = view(spark, sf_dir, "executions").select("fill_id", "user_id", "ts_us", F.timestamp_micros("ts_us").alias("ts"))
    clips = view(spark, sf_dir, "clips").select("session_id", "user_id", F.timestamp_micros("start_us").alias("start_ts"), F.timestamp_micros("end_us").alias("end_ts"))
    parts = live.clip_parts(clips).withColumn("to_us", F.unix_micros("to_ts"))
    out = live.replay(spark, {"fills": slices(stored(fills), "ts_us"), "parts": slices(stored(parts), "to_us")}, lambda s: live.fills_of_parts(s["fills"], s["parts"], "user_id"))
    return out.select("fill_id", "session_id")
