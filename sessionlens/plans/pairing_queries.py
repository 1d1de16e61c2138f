"""Queries over the pairing operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pairing
from .fixtures import view
from .registry import query

BUCKET = ["account", "instrument", "session_date"]


def fifo_sql(source: str, keys: str, out: str) -> str:
    """Lots of a table by overlaps of running quantity ranges (the definition, not the sweep)."""
    on = " AND ".join(f"b.{k.strip()} IS NOT DISTINCT FROM s.{k.strip()}" for k in keys.split(","))
    bk = ", ".join(f"b.{k.strip()}" for k in keys.split(","))
    same = " AND ".join(f"x.{k.strip()} IS NOT DISTINCT FROM t.{k.strip()}" for k in keys.split(","))
    xk = ", ".join(f"x.{k.strip()}" for k in keys.split(","))
    return f"""
{out}_r AS (SELECT *, sum(qty) OVER (PARTITION BY {keys}, side ORDER BY ts_us, fill_id ROWS UNBOUNDED PRECEDING) AS hi FROM {source}),
{out}_t AS (SELECT {keys}, least(coalesce(sum(qty) FILTER (WHERE side = 'buy'), 0), coalesce(sum(qty) FILTER (WHERE side = 'sell'), 0)) AS matched FROM {source} GROUP BY {keys}),
{out}_m AS (
  SELECT {bk}, greatest(b.hi - b.qty, s.hi - s.qty) AS lo, (least(b.hi, s.hi) - greatest(b.hi - b.qty, s.hi - s.qty)) AS qty, 'closed' AS status,
    (b.ts_us < s.ts_us OR (b.ts_us = s.ts_us AND b.fill_id < s.fill_id)) AS bf,
    b.fill_id AS b_id, s.fill_id AS s_id, b.ts_us AS b_us, s.ts_us AS s_us, b.price_ticks AS b_px, s.price_ticks AS s_px
  FROM {out}_r b JOIN {out}_r s ON b.side = 'buy' AND s.side = 'sell' AND {on} AND b.hi - b.qty < s.hi AND s.hi - s.qty < b.hi
  UNION ALL
  SELECT {xk}, greatest(x.hi - x.qty, matched), x.hi - greatest(x.hi - x.qty, matched), 'open', x.side = 'buy', x.fill_id, CASE WHEN x.side = 'buy' THEN NULL ELSE x.fill_id END,
    x.ts_us, CASE WHEN x.side = 'buy' THEN NULL ELSE x.ts_us END, x.price_ticks, CASE WHEN x.side = 'buy' THEN NULL ELSE x.price_ticks END
  FROM {out}_r x JOIN {out}_t t ON {same} WHERE x.hi > matched),
{out} AS (
  SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY lo) - 1 AS lot_seq, status, CASE WHEN bf THEN 'long' ELSE 'short' END AS direction, qty::BIGINT AS qty,
    CASE WHEN bf THEN b_id ELSE s_id END AS entry_fill_id, CASE WHEN status = 'closed' THEN CASE WHEN bf THEN s_id ELSE b_id END END AS exit_fill_id,
    CASE WHEN bf THEN b_us ELSE s_us END AS entry_ts_us, CASE WHEN status = 'closed' THEN CASE WHEN bf THEN s_us ELSE b_us END END AS exit_ts_us,
    CASE WHEN bf THEN b_px ELSE s_px END AS entry_price_ticks, CASE WHEN status = 'closed' THEN CASE WHEN bf THEN s_px ELSE b_px END END AS exit_price_ticks
  FROM {out}_m)"""


LOTS = fifo_sql("executions", "account, instrument, session_date", "lots")
PNL = "(exit_price_ticks - entry_price_ticks) * CASE WHEN direction = 'long' THEN 1 ELSE -1 END * qty"


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.fifo_lots(view(spark, sf_dir, "executions"), BUCKET)


@query("fifo_lots", LOTS + " SELECT * FROM lots", ("executions",))
def fifo_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lots(spark, sf_dir)


FLAT = """
run AS (SELECT source_group_id, CASE WHEN side = 'buy' THEN qty ELSE -qty END AS signed,
  sum(CASE WHEN side = 'buy' THEN qty ELSE -qty END) OVER (PARTITION BY source_group_id ORDER BY ts_us, fill_id ROWS UNBOUNDED PRECEDING) AS net
  FROM executions WHERE source_group_id IS NOT NULL),
flat AS (SELECT source_group_id, sum(signed) = 0 AND NOT (min(net) < 0 AND max(net) > 0) AS is_flat FROM run GROUP BY 1)"""


@query("spread_groups", FLAT + " SELECT * FROM flat", ("executions",))
def spread_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.nets_flat(view(spark, sf_dir, "executions"))


PAIRED = (
    FLAT
    + ", grouped AS (SELECT e.*, is_flat FROM executions e JOIN flat USING (source_group_id)),"
    + fifo_sql("grouped", "source_group_id, is_flat", "g")
    + """,
rest AS (SELECT instrument, session_date, fill_id, ts_us, price_ticks, side, qty FROM executions WHERE source_group_id IS NULL
  UNION ALL SELECT instrument, session_date, fill_id, ts_us, price_ticks, side, g.qty FROM g JOIN executions e ON e.fill_id = g.entry_fill_id WHERE NOT is_flat AND status = 'open'),"""
    + fifo_sql("rest", "instrument, session_date", "r")
)


@query(
    "paired_trades",
    PAIRED
    + """ SELECT g.source_group_id AS group_key, CASE WHEN is_flat THEN 'spread_id' ELSE 'fifo_fallback' END AS pair_method, instrument, session_date, lot_seq, status, direction, g.qty,
  entry_fill_id, exit_fill_id, entry_ts_us, exit_ts_us, entry_price_ticks, exit_price_ticks FROM g JOIN executions e ON e.fill_id = g.entry_fill_id WHERE is_flat OR status = 'closed'
  UNION ALL SELECT 'fifo:' || instrument || ':' || session_date::VARCHAR, 'fifo_fallback', instrument, session_date, lot_seq, status, direction, qty,
  entry_fill_id, exit_fill_id, entry_ts_us, exit_ts_us, entry_price_ticks, exit_price_ticks FROM r""",
    ("executions",),
)
def paired_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.pair_trades(view(spark, sf_dir, "executions"))


@query(
    "trade_metrics",
    LOTS + f""" SELECT account, instrument, session_date, lot_seq, {PNL} AS pnl_ticks, {PNL} / qty / 4.0 AS points, {PNL} * CASE WHEN instrument = 'MNQ' THEN 0.5 ELSE 1.25 END::DOUBLE AS currency,
  {PNL} / (10.0::DOUBLE * qty) AS r_multiple, exit_ts_us - entry_ts_us AS hold_us, printf('T%02d', row_number() OVER (PARTITION BY account, session_date ORDER BY entry_ts_us, instrument, lot_seq)) AS day_trade_id FROM lots""",
    ("executions",),
)
def trade_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pairing.numbered(pairing.with_metrics(lots(spark, sf_dir)).withColumn("k", F.struct("instrument", "lot_seq")), ["account", "session_date"], "k")
    return out.select("account", "instrument", "session_date", "lot_seq", "pnl_ticks", "points", "currency", "r_multiple", "hold_us", "day_trade_id")


#: Costs exist for fills with an id not divisible by 4; those divisible by 3 have lost their id.
COSTS = """
costs AS (SELECT CASE WHEN fill_id % 3 = 0 THEN -fill_id ELSE fill_id END AS fill_id, ts_us, side, price_ticks, qty, source_group_id,
  10 + fill_id % 7 AS commission, fill_id % 5 AS fees FROM executions WHERE fill_id % 4 <> 0)"""


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "executions").where("fill_id % 4 <> 0").select(
        F.expr("case when fill_id % 3 = 0 then -fill_id else fill_id end").alias("fill_id"), "ts_us", "side", "price_ticks", "qty", "source_group_id",
        F.expr("10 + fill_id % 7").alias("commission"), F.expr("fill_id % 5").alias("fees"),
    )


@query(
    "cost_overlay",
    "SELECT fill_id, CASE WHEN fill_id % 4 <> 0 THEN 10 + fill_id % 7 END AS commission, CASE WHEN fill_id % 4 <> 0 THEN fill_id % 5 END AS fees FROM executions",
    ("executions",),
)
def cost_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.overlay_costs(view(spark, sf_dir, "executions"), costs(spark, sf_dir)).select("fill_id", "commission", "fees")


NET = (
    LOTS
    + f""", tr AS (SELECT account, instrument, session_date, lot_seq, status, {PNL} * CASE WHEN instrument = 'MNQ' THEN 50 ELSE 125 END AS gross_cents, entry_fill_id, exit_fill_id FROM lots),
legs AS (SELECT account, instrument, session_date, lot_seq, entry_fill_id AS f FROM tr UNION ALL SELECT account, instrument, session_date, lot_seq, exit_fill_id FROM tr WHERE exit_fill_id IS NOT NULL),
summed AS (SELECT account, instrument, session_date, lot_seq, sum(10 + f % 7 + f % 5)::BIGINT AS cost_cents FROM legs WHERE f % 4 <> 0 GROUP BY ALL),
net AS (SELECT tr.*, cost_cents, gross_cents - cost_cents AS net_cents FROM tr LEFT JOIN summed USING (account, instrument, session_date, lot_seq))"""
)


def net_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    fills = view(spark, sf_dir, "executions")
    known = pairing.overlay_costs(fills, costs(spark, sf_dir)).where("commission is not null").select("fill_id", "commission", "fees")
    tr = pairing.with_metrics(pairing.fifo_lots(fills, BUCKET)).select(
        *BUCKET, "lot_seq", "status", (F.col("pnl_ticks") * F.when(F.col("instrument") == "MNQ", 50).otherwise(125)).alias("gross_cents"), "entry_fill_id", "exit_fill_id",
        F.struct(*BUCKET, "lot_seq").alias("trade_id"),
    )
    return pairing.roll_costs(tr, known)


@query("trade_net_costs", NET + " SELECT account, instrument, session_date, lot_seq, gross_cents, cost_cents, net_cents FROM net", ("executions",))
def trade_net_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return net_trades(spark, sf_dir).select(*BUCKET, "lot_seq", "gross_cents", "cost_cents", "net_cents")


@query(
    "daily_net",
    NET + """ SELECT account, date_trunc('week', session_date)::DATE AS week, session_date, count(*) AS n_trades, sum(gross_cents)::BIGINT AS gross, sum(cost_cents)::BIGINT AS cost, sum(net_cents)::BIGINT AS net
  FROM net WHERE status = 'closed' GROUP BY GROUPING SETS ((account, week, session_date), (account, week))""",
    ("executions",),
)
def daily_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.daily_net(net_trades(spark, sf_dir))


@query("uncosted_trades", NET + " SELECT account, instrument, session_date, lot_seq FROM net WHERE status = 'closed' AND cost_cents IS NULL", ("executions",))
def uncosted_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.without_costs(net_trades(spark, sf_dir)).select("trade_id.*")


@query(
    "big_lots",
    """fills AS (SELECT l_orderkey, l_suppkey AS account, CASE WHEN l_linenumber % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, l_quantity::BIGINT AS qty, (l_extendedprice * 100)::BIGINT AS price_ticks,
  epoch_us(l_shipdate) AS ts_us, extract(year FROM l_shipdate)::BIGINT AS year,
  concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate::DATE, (l_extendedprice * 100)::BIGINT) AS fill_id FROM lineitem),"""
    + fifo_sql("fills", "account, year", "lots")
    + """ SELECT account, year, count(*) AS n_lots, count(*) FILTER (WHERE status = 'open') AS n_open, sum(qty)::BIGINT AS qty,
  sum(CASE WHEN status = 'closed' THEN (exit_price_ticks - entry_price_ticks) * qty ELSE 0 END)::BIGINT AS moved FROM lots GROUP BY account, year""",
)
def big_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-in-first-out over all order lines, by supplier and year."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    fills = li.select(
        F.col("l_suppkey").alias("account"), F.when(F.col("l_linenumber") % 2 == 0, "buy").otherwise("sell").alias("side"), F.col("l_quantity").cast("long").alias("qty"), cents.alias("price_ticks"),
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', l_shipdate)").alias("ts_us"), F.year("l_shipdate").cast("long").alias("year"),
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate").cast("string"), cents).alias("fill_id"),
    )
    moved = F.when(F.col("status") == "closed", (F.col("exit_price_ticks") - F.col("entry_price_ticks")) * F.col("qty")).otherwise(0)
    return pairing.fifo_lots(fills, ["account", "year"]).groupBy("account", "year").agg(
        F.count("*").alias("n_lots"), F.count_if(F.col("status") == "open").alias("n_open"), F.sum("qty").alias("qty"), F.sum(moved).alias("moved")
    )
