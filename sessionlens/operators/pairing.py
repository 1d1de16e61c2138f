"""Pairing fills into trades.

Fills have fill_id, side ('buy' or 'sell'), qty (long), price_ticks (long) and ts_us (long).
First-in-first-out needs no queue: in an ordered group the k-th unit bought always meets
the k-th unit sold. Both sides get running quantity ranges; the ranges' ends cut the group's
units into pieces, and each piece belongs to the next buy and the next sell. One shuffle and
one sort for each group, no range join, so a group with very many fills stays linear.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Currency of one point, ticks of a point, ticks at risk.
POINT_VALUE = {"MNQ": 2.0, "MES": 5.0}
TICKS_PER_POINT = 4
RISK_TICKS = 10

_FILL = ["fill_id", "ts_us", "price_ticks"]


def fifo_lots(fills: DataFrame, keys: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Closed and open lots of each group.

    Columns: keys, lot_seq (from 0, in matching order, open lots last), status, direction, qty, and entry_/exit_ of
    fill_id, ts_us, price_ticks and the carried columns. Fills with a null or non-positive qty, an unknown side, or null
    time or id are left out.
    """
    keys, carry = list(keys), list(carry)
    parts = [*_FILL, *carry]
    usable = fills.where(F.col("side").isin("buy", "sell") & (F.col("qty") > 0) & F.col("ts_us").isNotNull() & F.col("fill_id").isNotNull())
    side = Window.partitionBy(*keys, "side").orderBy("ts_us", "fill_id").rowsBetween(Window.unboundedPreceding, 0)
    ends = usable.select(*keys, F.sum("qty").over(side).alias("hi"), *(F.when(F.col("side") == s, F.struct(*parts)).alias(s) for s in ("buy", "sell")))
    points = ends.groupBy(*keys, "hi").agg(F.max("buy").alias("buy"), F.max("sell").alias("sell"))
    by_end = Window.partitionBy(*keys).orderBy("hi")
    # Looks ahead in the reversed order: a frame that ends at its row grows, one that begins there is read anew for each row.
    onward = Window.partitionBy(*keys).orderBy(F.desc("hi")).rowsBetween(Window.unboundedPreceding, 0)
    pieces = points.select(
        *keys, "hi", (F.col("hi") - F.coalesce(F.lag("hi").over(by_end), F.lit(0))).alias("qty"),
        F.last("buy", True).over(onward).alias("buy"), F.last("sell", True).over(onward).alias("sell"),
        (F.row_number().over(by_end) - 1).cast("long").alias("lot_seq"),
    )
    both = F.col("buy").isNotNull() & F.col("sell").isNotNull()
    buy_first = F.col("sell").isNull() | (both & (F.struct("buy.ts_us", "buy.fill_id") < F.struct("sell.ts_us", "sell.fill_id")))
    entry, leave = F.when(buy_first, F.col("buy")).otherwise(F.col("sell")), F.when(both, F.when(buy_first, F.col("sell")).otherwise(F.col("buy")))
    lots = pieces.select(
        *keys, "lot_seq", F.when(both, "closed").otherwise("open").alias("status"), F.when(buy_first, "long").otherwise("short").alias("direction"), "qty",
        entry.alias("entry"), leave.alias("leave"),
    )
    return lots.select(
        *keys, "lot_seq", "status", "direction", "qty",
        *(F.col(f"entry.{c}").alias(f"entry_{c}") for c in parts), *(F.col(f"leave.{c}").alias(f"exit_{c}") for c in parts),
    )


def nets_flat(fills: DataFrame, group: str = "source_group_id") -> DataFrame:
    """group, is_flat: buys equal sells, both positive, and the running net is never on both sides."""
    signed = F.when(F.col("side") == "buy", F.col("qty")).otherwise(-F.col("qty"))
    order = Window.partitionBy(group).orderBy("ts_us", "fill_id").rowsBetween(Window.unboundedPreceding, 0)
    running = fills.where(F.col(group).isNotNull()).select(group, signed.alias("signed"), F.sum(signed).over(order).alias("net"))
    return running.groupBy(group).agg(
        ((F.sum("signed") == 0) & ~((F.min("net") < 0) & (F.max("net") > 0)) & (F.count("*") > 0)).alias("is_flat")
    )


def mixed_groups(fills: DataFrame, group: str = "source_group_id", same: Sequence[str] = ("instrument",)) -> DataFrame:
    """Groups that mix instruments or contracts; pairing refuses them."""
    return fills.where(F.col(group).isNotNull()).groupBy(group).agg(F.count_distinct(F.struct(*same)).alias("n")).where("n > 1").select(group)


def pair_trades(fills: DataFrame, bucket: Sequence[str] = ("instrument", "session_date"), group: str = "source_group_id") -> DataFrame:
    """Two-phase pairing: groups first, then what is left of them with the ungrouped fills, by bucket.

    Flat groups keep their lots (pair_method 'spread_id'); other groups are matched inside ('fifo_fallback') and
    their leftovers go on to the bucket. Bucket lots are 'fifo_fallback' too. group_key names the group or bucket.
    """
    bucket = list(bucket)
    flat = nets_flat(fills, group)
    grouped = fills.where(F.col(group).isNotNull()).join(flat, group)
    lots = fifo_lots(grouped, [group, "is_flat"], [*bucket, "side"])
    method = F.when(F.col("is_flat"), "spread_id").otherwise("fifo_fallback")
    own = lots.where("is_flat or status = 'closed'")
    first = own.select(F.col(group).alias("group_key"), method.alias("pair_method"), *_lot_columns(bucket))
    left = lots.where("not is_flat and status = 'open'").select(
        *(F.col(f"entry_{c}").alias(c) for c in [*bucket, "fill_id", "ts_us", "price_ticks", "side"]), "qty"
    )
    pool = fills.where(F.col(group).isNull()).select(*bucket, "fill_id", "ts_us", "price_ticks", "side", "qty").unionByName(left)
    again = fifo_lots(pool, bucket, ())
    key = F.concat_ws(":", F.lit("fifo"), *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in bucket))
    second = again.select(key.alias("group_key"), F.lit("fifo_fallback").alias("pair_method"), *_lot_columns(bucket, plain=True))
    return first.unionByName(second)


def _lot_columns(bucket: list[str], plain: bool = False) -> list[Column]:
    keys = [F.col(c if plain else f"entry_{c}").alias(c) for c in bucket]
    return [*keys, *(F.col(c) for c in ("lot_seq", "status", "direction", "qty", "entry_fill_id", "exit_fill_id", "entry_ts_us", "exit_ts_us", "entry_price_ticks", "exit_price_ticks"))]


def with_metrics(lots: DataFrame, stop_ticks: str | None = None) -> DataFrame:
    """Adds pnl_ticks, points, currency, r_multiple, r_declared and hold_us to lots; null for open lots."""
    side = F.when(F.col("direction") == "long", 1).otherwise(-1)
    pnl = (F.col("exit_price_ticks") - F.col("entry_price_ticks")) * side * F.col("qty")
    tick = F.lit(None).cast("double")
    for name, value in POINT_VALUE.items():
        tick = F.when(F.col("instrument") == name, F.lit(value / TICKS_PER_POINT)).otherwise(tick)
    out = lots.withColumns({
        "pnl_ticks": pnl,
        "points": pnl / F.col("qty") / TICKS_PER_POINT,
        "currency": pnl * tick,
        "r_multiple": pnl / (F.lit(RISK_TICKS) * F.col("qty")),
        "hold_us": F.col("exit_ts_us") - F.col("entry_ts_us"),
    })
    if stop_ticks:
        distance = F.abs(F.col("entry_price_ticks") - F.col(stop_ticks))
        out = out.withColumn("r_declared", F.when(distance > 0, F.col("pnl_ticks") / (distance * F.col("qty"))))
    return out


def numbered(trades: DataFrame, keys: Sequence[str], trade_id: str = "trade_id") -> DataFrame:
    """Adds day_trade_id: T01, T02, ... by entry time and id within keys."""
    w = Window.partitionBy(*keys).orderBy("entry_ts_us", trade_id)
    return trades.withColumn("day_trade_id", F.format_string("T%02d", F.row_number().over(w)))


def merge_intent(fills: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group, in fill order: ordered distinct tags, first non-empty note, first stop and target that are set."""
    w = Window.partitionBy(*keys).orderBy("ts_us", "fill_id")
    placed = fills.withColumn("ord", F.row_number().over(w))
    tags = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "tags"))), lambda x: x.tags)))
    return placed.groupBy(*keys).agg(
        tags.alias("tags"),
        F.min_by("notes", F.when(F.col("notes") != "", F.col("ord"))).alias("notes"),
        F.min_by("stop", F.when(F.col("stop").isNotNull(), F.col("ord"))).alias("stop"),
        F.min_by("target", F.when(F.col("target").isNotNull(), F.col("ord"))).alias("target"),
    )


def overlay_costs(fills: DataFrame, costs: DataFrame) -> DataFrame:
    """Copies commission and fees (long, cents) by fill_id, else from one unused row of the same identity.

    Identity: ts_us, side, price_ticks, qty, source_group_id, null-safe. Rows of one identity are used in id order.
    """
    ident = ["ts_us", "side", "price_ticks", "qty", "source_group_id"]
    by_id = costs.select(F.col("fill_id").alias("c_id"), "commission", "fees")
    direct = fills.join(by_id, fills["fill_id"] == by_id["c_id"], "left")
    open_fills = direct.where("c_id is null").drop("c_id", "commission", "fees")
    unused = costs.join(fills.select("fill_id"), "fill_id", "left_anti")

    def turn(df: DataFrame) -> DataFrame:
        return df.withColumn("k", F.xxhash64(*ident)).withColumn("turn", F.row_number().over(Window.partitionBy(*ident).orderBy("fill_id")))

    a, b = turn(open_fills), turn(unused).select(*(F.col(c).alias(f"u_{c}") for c in [*ident, "k", "turn", "commission", "fees"]))
    same = (a["k"] == b["u_k"]) & (a["turn"] == b["u_turn"])
    for c in ident:
        same = same & F.col(c).eqNullSafe(F.col(f"u_{c}"))
    late = a.join(b, same, "left").select(*fills.columns, F.col("u_commission").alias("commission"), F.col("u_fees").alias("fees"))
    return direct.where("c_id is not null").select(*fills.columns, "commission", "fees").unionByName(late)


def roll_costs(trades: DataFrame, costs: DataFrame) -> DataFrame:
    """Adds cost_cents and net_cents: both fills' commission and fees; a closed trade without any cost row has nulls."""
    legs = trades.select("trade_id", F.explode(F.array("entry_fill_id", "exit_fill_id")).alias("fill_id")).where("fill_id is not null")
    summed = legs.join(costs, "fill_id").groupBy("trade_id").agg(F.sum(F.coalesce("commission", F.lit(0)) + F.coalesce("fees", F.lit(0))).alias("cost_cents"))
    return trades.join(summed, "trade_id", "left").withColumn("net_cents", F.col("gross_cents") - F.col("cost_cents"))


def gross_only(trades: DataFrame) -> DataFrame:
    """Costs become null and net is gross, for closed trades."""
    return trades.withColumns({"cost_cents": F.lit(None).cast("long"), "net_cents": F.when(F.col("status") == "closed", F.col("gross_cents"))})


def without_costs(trades: DataFrame) -> DataFrame:
    """Closed trades that no cost row covers; the net-cost policy refuses them."""
    return trades.where("status = 'closed' and cost_cents is null").select("trade_id")


def daily_net(trades: DataFrame) -> DataFrame:
    """account, week, day, n_trades, gross, cost, net in cents; day is null for a week's total."""
    week = F.date_trunc("week", "session_date").cast("date")
    closed = trades.where("status = 'closed'").withColumn("week", week)
    sums = [F.count("*").alias("n_trades"), F.sum("gross_cents").alias("gross"), F.sum("cost_cents").alias("cost"), F.sum("net_cents").alias("net")]
    keys = [F.col("account"), F.col("week"), F.col("session_date")]
    return closed.groupingSets([keys, keys[:2]], *keys).agg(*sums)
