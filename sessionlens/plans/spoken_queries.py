"""Rules over what was said between a trade's window and its entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import spoken
from .fixtures import view
from .registry import query
from .session_queries import SESSION_TRADES, V, session_trades

#: Texts of events and of stated values by a number; the SQL and the views use the same.
_TEXT = "CASE {n} % 6 WHEN 0 THEN 'short counter-trend idea' WHEN 1 THEN 'this is a 3c' WHEN 2 THEN 'ohne 3c, gegen den Trend' WHEN 3 THEN 'wait for the candle close' WHEN 4 THEN 'Ankunft am Level' END"
SAID = SESSION_TRADES + f""", ev AS (SELECT session_id, t_us, kind, CASE WHEN number % 7 <> 0 THEN seg END AS seg, {_TEXT.format(n="number")} AS text FROM (SELECT *, CAST(substr(seg, 5) AS BIGINT) AS number FROM speech_events)),
sd AS (SELECT session_id, trade_id, 'setup' AS name, {_TEXT.format(n="lot_seq")} AS value, 'seg_s' AS seg, 0 AS rank FROM st WHERE lot_seq % 2 = 0 UNION ALL SELECT session_id, trade_id, 'bias', 'up', CASE WHEN lot_seq % 5 = 0 THEN 'seg_b' END, 1 FROM st WHERE lot_seq % 3 = 0),
al AS (SELECT session_id, trade_id, rank, 0 AS t, seg, value AS text, true AS stated FROM sd UNION ALL SELECT st.session_id, trade_id, 5, ev.t_us, ev.seg, ev.text, false FROM st JOIN ev ON ev.session_id = st.session_id AND ev.t_us BETWEEN greatest(entry_us - 7200000000, 0) AND entry_us),
k AS (SELECT session_id, trade_id, bool_or(stated AND seg IS NOT NULL) AS has_speech, string_agg(text, ' ' ORDER BY rank, t, seg NULLS FIRST) AS text,
  coalesce(bool_or(seg IS NOT NULL AND text = 'this is a 3c'), false) AS c3, coalesce(bool_or(seg IS NOT NULL AND (text LIKE '%candle close%' OR text LIKE 'Ankunft%')), false) AS ca FROM al GROUP BY ALL),
sp AS (SELECT st.session_id, st.trade_id, coalesce(has_speech, false) AS has_speech, coalesce(text, '') AS text, coalesce(c3, false) AS cites_3c, coalesce(ca, false) AS cites_arrival FROM st LEFT JOIN k USING (session_id, trade_id))"""


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    trades = session_trades(spark, sf_dir).withColumn("t0_us", F.greatest(F.col("entry_us") - 7_200_000_000, F.lit(0)))
    number = F.substring("seg", 5, 30).cast("long")
    events = view(spark, sf_dir, "speech_events").withColumn("number", number).select("session_id", "t_us", "kind", F.when(F.col("number") % 7 != 0, F.col("seg")).alias("seg"), F.expr(_TEXT.format(n="number")).alias("text"))
    setup = trades.where("lot_seq % 2 = 0").select("session_id", "trade_id", F.lit("setup").alias("name"), F.expr(_TEXT.format(n="lot_seq")).alias("value"), F.lit("seg_s").alias("seg"))
    bias = trades.where("lot_seq % 3 = 0").select("session_id", "trade_id", F.lit("bias").alias("name"), F.lit("up").alias("value"), F.when(F.col("lot_seq") % 5 == 0, "seg_b").alias("seg"))
    return trades, setup.unionByName(bias), events


@query("spoken_trades", SAID + " SELECT * FROM sp", V)
def spoken_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spoken.spoken_trades(*_inputs(spark, sf_dir))


def _rule_sql(rule: str, bad: str, good: str, bad_reason: str, none_reason: str) -> str:
    return f""", n AS (SELECT session_id, count(*) FILTER (WHERE {bad}) AS nb, count(*) FILTER (WHERE {good}) AS ng FROM sp WHERE has_speech GROUP BY 1)
SELECT c.session_id, '{rule}' AS rule, CASE WHEN n.session_id IS NULL THEN 'unverifiable' WHEN nb > 0 THEN 'violated' WHEN ng > 0 THEN 'pass' ELSE 'unverifiable' END AS status,
  CASE WHEN n.session_id IS NULL THEN 'absent speech' WHEN nb > 0 THEN '{bad_reason}' WHEN ng = 0 THEN '{none_reason}' END AS reason, coalesce(nb, 0) AS n_bad FROM clips c LEFT JOIN n USING (session_id)"""


@query("spoken_3c", SAID + _rule_sql("R-3C-CT", "text NOT LIKE '%this is a 3c%' AND (text LIKE '%counter-trend%' OR text LIKE '%gegen den Trend%')", "text LIKE '%this is a 3c%' AND cites_3c", "counter-trend speech without 3c", "no 3c or counter-trend speech; journal triggers later"), V)
def spoken_3c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spoken.three_c(view(spark, sf_dir, "clips"), spoken.spoken_trades(*_inputs(spark, sf_dir)))


@query("spoken_arrival", SAID + _rule_sql("R-ARRIVAL", "text NOT LIKE '%candle close%' AND text NOT LIKE '%Ankunft%'", "(text LIKE '%candle close%' OR text LIKE '%Ankunft%') AND cites_arrival", "no arrival-candle close cue", "no cited segment"), V)
def spoken_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spoken.arrival(view(spark, sf_dir, "clips"), spoken.spoken_trades(*_inputs(spark, sf_dir)))


@query(
    "spoken_bias",
    SAID + """, b AS (SELECT session_id, name = 'bias' AS biased FROM sd WHERE seg IS NOT NULL UNION ALL SELECT session_id, kind = 'bias_statement' AND seg IS NOT NULL FROM ev), g AS (SELECT session_id, bool_or(biased) AS biased FROM b GROUP BY 1)
SELECT c.session_id, 'R-BIAS' AS rule, CASE WHEN biased IS NULL THEN 'unverifiable' WHEN biased THEN 'pass' ELSE 'violated' END AS status, CASE WHEN biased IS NULL THEN 'absent speech' WHEN NOT biased THEN 'bias not re-evaluated' END AS reason FROM clips c LEFT JOIN g USING (session_id)""",
    V,
)
def spoken_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, stated, events = _inputs(spark, sf_dir)
    return spoken.bias(view(spark, sf_dir, "clips"), events, stated)
