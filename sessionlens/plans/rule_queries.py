"""Queries over the trading rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pairing, rules
from .pairing_queries import LOTS, PNL, lots
from .registry import query

KEYS = ["account", "session_date"]
CONFIG = rules.RuleConfig(loss_limit=400, flat_by="16:00")

#: Every 11th lot has no net result, every 22nd no result at all.
TRADES = (
    LOTS
    + f""", tr AS (SELECT account, session_date, instrument || ':' || lot_seq AS trade_id, instrument, direction, status, entry_ts_us AS entry_us, exit_ts_us AS exit_us, entry_price_ticks AS entry_ticks, exit_price_ticks AS exit_ticks,
  CASE WHEN lot_seq % 11 <> 10 THEN {PNL} END AS net_pnl, CASE WHEN lot_seq % 22 <> 10 THEN {PNL} END AS gross_pnl, exit_ts_us - entry_ts_us AS hold_us FROM lots),
p AS (SELECT *, coalesce(net_pnl, gross_pnl) AS pnl, exit_us IS NOT NULL AS closed FROM tr)"""
)


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = pairing.with_metrics(lots(spark, sf_dir))
    return m.select(
        *KEYS, F.concat_ws(":", "instrument", "lot_seq").alias("trade_id"), "instrument", "direction", "status", F.col("entry_ts_us").alias("entry_us"), F.col("exit_ts_us").alias("exit_us"),
        F.col("entry_price_ticks").alias("entry_ticks"), F.col("exit_price_ticks").alias("exit_ticks"), F.when(F.col("lot_seq") % 11 != 10, F.col("pnl_ticks")).alias("net_pnl"),
        F.when(F.col("lot_seq") % 22 != 10, F.col("pnl_ticks")).alias("gross_pnl"), "hold_us", F.lit(None).cast("long").alias("stop_ticks"),
    )


DLL = """, s AS (SELECT account, session_date, count(*) FILTER (WHERE closed) AS n_closed, coalesce(sum(pnl) FILTER (WHERE closed), 0)::BIGINT AS total, count(*) FILTER (WHERE closed AND pnl IS NULL) AS unknown,
  count(*) FILTER (WHERE closed AND net_pnl IS NULL AND gross_pnl IS NOT NULL) AS gross_only FROM p GROUP BY ALL)
SELECT account, session_date, 'R-DLL' AS rule, CASE WHEN unknown > 0 THEN 'unverifiable' WHEN total < -400 THEN 'violated' ELSE 'pass' END AS status,
  CASE WHEN unknown > 0 THEN 'closed trade missing net_pnl_currency and gross_pnl_currency' WHEN total < -400 THEN 'daily pnl ' || total || ' below -400' WHEN gross_only > 0 THEN 'fees_unknown' END AS reason, n_closed, total FROM s"""


@query("rule_dll", TRADES + DLL, ("executions",))
def rule_dll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.daily_loss(trades(spark, sf_dir), KEYS, CONFIG)


@query("rule_max", TRADES + " SELECT account, session_date, 'R-MAX10' AS rule, CASE WHEN count(*) > 10 THEN 'violated' ELSE 'pass' END AS status, CASE WHEN count(*) > 10 THEN count(*) || ' trades exceeds 10' END AS reason, count(*) AS n FROM tr GROUP BY ALL", ("executions",))
def rule_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.max_trades(trades(spark, sf_dir), KEYS, CONFIG)


@query(
    "rule_close",
    TRADES + """, s AS (SELECT account, session_date, count(*) FILTER (WHERE NOT closed) AS n_open,
  count(*) FILTER (WHERE coalesce(exit_us, entry_us) > epoch_us((session_date + TIME '16:00:00') AT TIME ZONE 'America/New_York')) AS n_late FROM p GROUP BY ALL)
SELECT account, session_date, 'R-CLOSE' AS rule, CASE WHEN n_open > 0 OR n_late > 0 THEN 'violated' ELSE 'pass' END AS status,
  CASE WHEN n_open > 0 THEN 'open trade past session; not flat' WHEN n_late > 0 THEN 'exit after flat_by cutoff' END AS reason, n_open, n_late FROM s""",
    ("executions",),
)
def rule_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.flat_by_close(trades(spark, sf_dir), KEYS, CONFIG)


NEXT = """, nx AS (SELECT a.account, a.session_date, a.trade_id, first(b.trade_id ORDER BY b.entry_us, b.trade_id) AS n_id, min(b.entry_us) AS n_us,
    first(b.instrument ORDER BY b.entry_us, b.trade_id) AS n_ins, first(b.direction ORDER BY b.entry_us, b.trade_id) AS n_dir, first(b.entry_ticks ORDER BY b.entry_us, b.trade_id) AS n_px
  FROM p a JOIN p b ON a.account = b.account AND a.session_date = b.session_date AND b.entry_us >= a.exit_us AND b.trade_id <> a.trade_id GROUP BY ALL)"""
STREAK = (
    NEXT
    + """, c AS (SELECT *, coalesce(pnl < 0, false) AS loss FROM p WHERE closed),
isle AS (SELECT *, count(*) FILTER (WHERE NOT loss) OVER (PARTITION BY account, session_date ORDER BY entry_us, trade_id ROWS UNBOUNDED PRECEDING) AS g FROM c),
st AS (SELECT *, count(*) FILTER (WHERE loss) OVER (PARTITION BY account, session_date, g ORDER BY entry_us, trade_id ROWS UNBOUNDED PRECEDING) AS streak FROM isle),
br AS (SELECT st.account, st.session_date, st.trade_id, n_id AS next_trade_id, n_us - exit_us AS gap_us, streak FROM st JOIN nx USING (account, session_date, trade_id) WHERE loss AND streak >= 3 AND n_us - exit_us < 1800000000)"""
)
POST = (
    NEXT
    + """, br AS (SELECT p.account, p.session_date, trade_id, n_id AS next_trade_id, n_us - exit_us AS gap_us FROM p JOIN nx USING (account, session_date, trade_id)
  WHERE closed AND pnl < 0 AND n_us - exit_us < 300000000 AND NOT (hold_us <= 60000000 AND instrument = n_ins AND direction = n_dir AND abs(entry_ticks - n_px) <= 2 AND n_us - exit_us <= 120000000))"""
)


def _summed(rule: str, reason: str) -> str:
    return f""" SELECT d.account, d.session_date, '{rule}' AS rule, CASE WHEN n > 0 THEN 'violated' ELSE 'pass' END AS status, CASE WHEN n > 0 THEN '{reason}' END AS reason, coalesce(n, 0) AS n_breaches
FROM (SELECT DISTINCT account, session_date FROM p) d LEFT JOIN (SELECT account, session_date, count(*) AS n FROM br GROUP BY ALL) USING (account, session_date)"""


@query("rule_streak", TRADES + STREAK + _summed("R-3L30", "entry before 30 min timeout after 3 consecutive losses"), ("executions",))
def rule_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.loss_streak(trades(spark, sf_dir), KEYS, CONFIG)


@query("rule_streak_breaches", TRADES + STREAK + " SELECT * FROM br", ("executions",))
def rule_streak_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.streak_breaches(trades(spark, sf_dir), KEYS, CONFIG)


@query("rule_postloss", TRADES + POST + _summed("R-5M", "entry before 5 min block after a loss"), ("executions",))
def rule_postloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.post_loss(trades(spark, sf_dir), KEYS, CONFIG)


@query("rule_postloss_breaches", TRADES + POST + " SELECT * FROM br", ("executions",))
def rule_postloss_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.post_loss_breaches(trades(spark, sf_dir), KEYS, CONFIG)


#: A wide window and level, so that the derived trades have clusters.
WIDE = rules.RuleConfig(reentry_window_s=7200, same_level_ticks=40, reentry_block_minutes=240, stop_on_entry_s=14400)
REENTRY = """, lv AS (SELECT a.account, a.session_date, a.trade_id, first(b.trade_id ORDER BY b.entry_us, b.trade_id) AS n_id, min(b.entry_us) - any_value(a.exit_us) AS gap
  FROM p a JOIN p b ON a.account = b.account AND a.session_date = b.session_date AND a.instrument = b.instrument AND a.direction = b.direction AND abs(a.entry_ticks - b.entry_ticks) <= 40
   AND b.entry_us >= a.exit_us AND (b.entry_us > a.entry_us OR (b.entry_us = a.entry_us AND b.trade_id > a.trade_id)) GROUP BY ALL),
step AS (SELECT lv.* FROM lv JOIN p USING (account, session_date, trade_id) WHERE pnl < 0 AND gap <= 7200000000),
seeds AS (SELECT account, session_date, trade_id AS seed FROM p WHERE closed AND pnl < 0 AND hold_us <= 14400000000),
reach(account, session_date, seed, cur, steps) AS (SELECT account, session_date, seed, seed, 0::BIGINT FROM seeds
  UNION ALL SELECT r.account, r.session_date, seed, n_id, steps + 1 FROM reach r JOIN step s ON s.account = r.account AND s.session_date = r.session_date AND s.trade_id = r.cur),
ends AS (SELECT account, session_date, seed, max(steps) AS extras, last(cur ORDER BY steps) AS last FROM reach GROUP BY ALL),
act AS (SELECT e.* FROM ends e WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE steps > 0 AND r.account = e.account AND r.session_date = e.session_date AND r.cur = e.seed)),
cl AS (SELECT a.account, a.session_date, seed, last, extras, CASE WHEN extras >= 1 THEN n_id END AS blocked_by
  FROM act a LEFT JOIN (SELECT lv.* FROM lv JOIN p USING (account, session_date, trade_id) WHERE pnl < 0 AND gap < 14400000000) b ON b.account = a.account AND b.session_date = a.session_date AND b.trade_id = a.last)"""


@query("reentry_clusters", TRADES + REENTRY + " SELECT * FROM cl", ("executions",), recursive=True)
def reentry_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.reentry_clusters(trades(spark, sf_dir), KEYS, WIDE)


@query(
    "rule_reentry",
    TRADES + REENTRY + ", br AS (SELECT * FROM cl WHERE extras > 1 OR blocked_by IS NOT NULL)" + _summed("R-REENTRY", "re-entry cluster exceeded max or 240 min block"),
    ("executions",),
    recursive=True,
)
def rule_reentry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.reentry(trades(spark, sf_dir), KEYS, WIDE)
