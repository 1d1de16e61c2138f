"""Trading rules over trades, with three-valued results.

Trades have the rule's keys (an account and a day), trade_id, instrument, direction, status, entry_us, exit_us, entry_ticks,
net_pnl and gross_pnl (whole units), hold_us, stop_ticks and exit_ticks. A check has the keys, rule, status ('pass', 'violated',
'unverifiable') and reason.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import intervals

SECOND = 1_000_000


@dataclass(frozen=True)
class RuleConfig:
    """The rules' defaults; the loss limit and the closing time are unset."""

    max_trades: int = 10
    streak: int = 3
    streak_minutes: int = 30
    post_loss_minutes: int = 5
    reentry_window_s: int = 120
    reentry_max: int = 1
    reentry_block_minutes: int = 5
    stop_on_entry_s: int = 60
    same_level_ticks: int = 2
    loss_limit: int | None = None
    flat_by: str | None = None
    zone: str = "America/New_York"
    by_position: bool = False


def realized(net: str = "net_pnl", gross: str = "gross_pnl") -> Column:
    return F.coalesce(F.col(net), F.col(gross))


def pnl_note(net: str = "net_pnl", gross: str = "gross_pnl") -> Column:
    return F.when(F.col(net).isNull(), F.when(F.col(gross).isNull(), "pnl_unknown").otherwise("fees_unknown"))


def is_closed() -> Column:
    return F.col("exit_us").isNotNull() | (F.col("status") == "closed")


def is_loss() -> Column:
    return F.coalesce(realized() < 0, F.lit(False))


def stopped_on_entry(config: RuleConfig) -> Column:
    near = F.abs(F.col("exit_ticks") - F.col("stop_ticks")) <= 1
    quick = F.when(F.col("hold_us").isNotNull(), F.col("hold_us") <= config.stop_on_entry_s * SECOND).otherwise(F.coalesce(near, F.lit(False)))
    return is_closed() & is_loss() & quick


def same_level(config: RuleConfig, other: str = "next_") -> Column:
    same = F.coalesce("instrument", F.lit("")) == F.coalesce(f"{other}instrument", F.lit(""))
    same = same & (F.coalesce("direction", F.lit("")) == F.coalesce(f"{other}direction", F.lit("")))
    return same & F.coalesce(F.abs(F.col("entry_ticks") - F.col(f"{other}entry_ticks")) <= config.same_level_ticks, F.lit(False))


def _check(rule: str, keys: Sequence[str], rows: DataFrame, status: Column, reason: Column, *more: Column) -> DataFrame:
    return rows.select(*keys, F.lit(rule).alias("rule"), status.alias("status"), reason.alias("reason"), *more)


def daily_loss(trades: DataFrame, keys: Sequence[str], config: RuleConfig) -> DataFrame:
    """R-DLL: realized result of the closed trades below the negative limit. An unset limit comes before unknown results."""
    closed = trades.withColumn("__c", is_closed())
    sums = closed.groupBy(*keys).agg(
        F.count_if("__c").alias("n_closed"), F.coalesce(F.sum(F.when(F.col("__c"), realized())), F.lit(0)).alias("total"),
        F.count_if(F.col("__c") & realized().isNull()).alias("unknown"), F.count_if(F.col("__c") & (pnl_note() == "fees_unknown")).alias("gross_only"),
    )
    if config.loss_limit is None:
        status, reason = F.lit("unverifiable"), F.lit("daily_loss_limit_usd is unset (D4)")
    else:
        below = F.col("total") < -config.loss_limit
        status = F.when(F.col("unknown") > 0, "unverifiable").when(below, "violated").otherwise("pass")
        reason = (
            F.when(F.col("unknown") > 0, "closed trade missing net_pnl_currency and gross_pnl_currency")
            .when(below, F.format_string(f"daily pnl %d below -{config.loss_limit}", F.col("total").cast("long")))
            .when(F.col("gross_only") > 0, "fees_unknown")
        )
    return _check("R-DLL", keys, sums, status, reason, F.col("n_closed"), F.col("total"))


def max_trades(trades: DataFrame, keys: Sequence[str], config: RuleConfig) -> DataFrame:
    """R-MAX10: number of trades, or of positions where they are known and wanted."""
    lots = F.count("*")
    if config.by_position:
        positions = F.count_distinct("position_id")
        n = F.when(positions > 0, positions).otherwise(lots)
    else:
        n = lots
    counted = trades.groupBy(*keys).agg(n.alias("n"))
    over = F.col("n") > config.max_trades
    return _check("R-MAX10", keys, counted, F.when(over, "violated").otherwise("pass"), F.when(over, F.concat(F.col("n").cast("string"), F.lit(f" trades exceeds {config.max_trades}"))), F.col("n"))


def flat_by_close(trades: DataFrame, keys: Sequence[str], config: RuleConfig, day: str = "session_date") -> DataFrame:
    """R-CLOSE: no open trade, and no stamp after the closing time of the day in the exchange's zone."""
    if config.flat_by is None:
        return _check("R-CLOSE", keys, trades.select(*keys).distinct(), F.lit("unverifiable"), F.lit("flat_by is unset"))
    cut = F.unix_micros(F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", F.col(day).cast("string"), F.lit(config.flat_by))), config.zone))
    late = F.coalesce("exit_us", "entry_us") > cut
    seen = trades.groupBy(*keys).agg(F.count_if(~is_closed()).alias("n_open"), F.count_if(late).alias("n_late"))
    status = F.when((F.col("n_open") > 0) | (F.col("n_late") > 0), "violated").otherwise("pass")
    reason = F.when(F.col("n_open") > 0, "open trade past session; not flat").when(F.col("n_late") > 0, "exit after flat_by cutoff")
    return _check("R-CLOSE", keys, seen, status, reason, F.col("n_open"), F.col("n_late"))


def _with_next(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    return intervals.next_by_time(trades, keys, "exit_us", "entry_us", "trade_id", ["instrument", "direction", "entry_ticks"])


def streak_breaches(trades: DataFrame, keys: Sequence[str], config: RuleConfig) -> DataFrame:
    """keys, trade_id, next_trade_id, gap_us: entries too soon after a losing streak. Gains and unknown results end a streak."""
    need = config.streak_minutes * 60 * SECOND
    order = Window.partitionBy(*keys).orderBy("entry_us", "trade_id").rowsBetween(Window.unboundedPreceding, 0)
    nxt = _with_next(trades, keys).where(is_closed())
    island = nxt.withColumn("__loss", is_loss()).withColumn("__island", F.count_if(~F.col("__loss")).over(order))
    length = F.count_if("__loss").over(Window.partitionBy(*keys, "__island").orderBy("entry_us", "trade_id").rowsBetween(Window.unboundedPreceding, 0))
    gap = F.col("next_entry_us") - F.col("exit_us")
    long = island.withColumn("streak", length).where(F.col("__loss") & (F.col("streak") >= config.streak) & (gap < need))
    return long.select(*keys, "trade_id", "next_trade_id", gap.alias("gap_us"), "streak")


def post_loss_breaches(trades: DataFrame, keys: Sequence[str], config: RuleConfig) -> DataFrame:
    """keys, trade_id, next_trade_id, gap_us: entries too soon after a loss, re-entries at a level after a stop aside."""
    gap = F.col("next_entry_us") - F.col("exit_us")
    losses = _with_next(trades, keys).where(is_closed() & is_loss() & F.col("next_trade_id").isNotNull())
    exempt = stopped_on_entry(config) & same_level(config) & (gap <= config.reentry_window_s * SECOND)
    return losses.where(~exempt & (gap < config.post_loss_minutes * 60 * SECOND)).select(*keys, "trade_id", "next_trade_id", gap.alias("gap_us"))


def next_same_level(trades: DataFrame, keys: Sequence[str], config: RuleConfig, within_us: int, of: DataFrame | None = None) -> DataFrame:
    """trade_id, next_trade_id, gap_us: for a trade (of ``of``, else of trades) the first later trade at its level, if it enters within within_us of the exit.

    Later means later in (entry, id), at or after the exit. Levels are whole ticks. An entry is listed under the block of 1, 2, 4, ...
    levels around it, an exit under the few blocks that make up its range of levels; in each block one sweep backwards in time
    finds the next entry. The rows grow with the trades and the logarithm of the range, however many trades share a level.
    """
    if not isinstance(trades.schema["entry_ticks"].dataType, IntegralType):
        raise TypeError("entry_ticks must be whole numbers")
    on, n = [*keys, "instrument", "direction"], config.same_level_ticks
    top = (2 * n + 1).bit_length() - 1
    id_type = trades.schema["trade_id"].dataType
    known = lambda df, c: df.where(" and ".join(f"`{x}` is not null" for x in [*on, "entry_ticks", c]))
    level = F.col("entry_ticks").cast("long")

    def block(size: int, place: Column) -> Column:
        return F.struct(F.lit(size).alias("size"), place.alias("place"))

    places = F.array(*(block(k, F.shiftright(level, k)) for k in range(top + 1)))
    entries = known(trades, "entry_us").select(*on, F.explode(places).alias("__at"), F.col("entry_us").alias("__t"), F.col("trade_id").alias("__i"), F.lit(0).alias("__k"), F.lit(None).cast(id_type).alias("trade_id"), F.lit(None).cast("long").alias("exit_us"))
    cover = []
    for k in range(top + 1):
        first, end = -F.shiftright(n - level, k), F.shiftright(level + (n + 1), k)
        if k < top:
            cover += [F.when((first < end) & (first.bitwiseAND(1) == 1), block(k, first)), F.when((first < end) & (end.bitwiseAND(1) == 1), block(k, end - 1))]
        else:
            cover += [F.when(first + i < end, block(k, first + i)) for i in range(2)]
    after_itself = F.col("entry_us") >= F.col("exit_us")
    start, tie = F.when(after_itself, F.col("entry_us")).otherwise(F.col("exit_us")), F.when(after_itself, F.col("trade_id"))
    exits = known(trades if of is None else of, "exit_us").select(*on, F.explode(F.array_compact(F.array(*cover))).alias("__at"), start.alias("__t"), tie.alias("__i"), F.lit(1).alias("__k"), "trade_id", "exit_us")
    back = Window.partitionBy(*on, "__at").orderBy(F.desc("__t"), F.desc("__i"), F.desc("__k")).rowsBetween(Window.unboundedPreceding, 0)
    line = entries.unionByName(exits).withColumn("n", F.last(F.when(F.col("__k") == 0, F.struct(F.col("__t").alias("n_us"), F.col("__i").alias("n_id"))), True).over(back))
    gap = F.col("n.n_us") - F.col("exit_us")
    met = line.where((F.col("__k") == 1) & (gap <= within_us))
    first = met.groupBy(*keys, "trade_id").agg(F.min(F.struct("n.n_us", "n.n_id", gap.alias("gap"))).alias("n"))
    return first.select(*keys, "trade_id", F.col("n.n_id").alias("next_trade_id"), F.col("n.gap").alias("gap_us"))


def reentry_clusters(trades: DataFrame, keys: Sequence[str], config: RuleConfig) -> DataFrame:
    """keys, seed, last, extras, blocked_by: clusters of entries at one level after a stop on entry.

    Each trade points to the next at its level within the window while it is a loss; pointers only go forward. A seed
    that another seed's chain passes is part of that cluster. The pointers come from one sweep; the walk along them is one
    grouped map over the pointers of a key (an account's day), which are no more than its losing trades, each passed once or twice.
    The same pointers tell which trade the block after a cluster's last one meets.
    """
    window, block, enough = config.reentry_window_s * SECOND, config.reentry_block_minutes * 60 * SECOND, config.reentry_max
    after_loss = next_same_level(trades, keys, config, max(window, block), trades.where(is_loss()))
    step = after_loss.select(*keys, "trade_id", F.when(F.col("gap_us") <= window, F.col("next_trade_id")).alias("to"), F.when(F.col("gap_us") < block, F.col("next_trade_id")).alias("blocked"))
    seeds = trades.where(stopped_on_entry(config)).select(*keys, "trade_id", F.lit(True).alias("is_seed"))
    both = seeds.join(step, [*keys, "trade_id"], "full")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        to = {a: b for a, b in zip(rows["trade_id"], rows["to"]) if isinstance(b, str)}
        blocked = {a: b for a, b in zip(rows["trade_id"], rows["blocked"]) if isinstance(b, str)}
        seeds = rows.loc[rows["is_seed"].eq(True), "trade_id"].tolist()
        # Longest remaining chain of each start, walked once; what a seed passes is no seed of its own.
        passed, out = set(), []
        for seed in seeds:
            at = to.get(seed)
            while at is not None and at not in passed:
                passed.add(at)
                at = to.get(at)
        ends = {}
        for seed in seeds:
            if seed not in passed:
                at, path = seed, []
                while at in to and at not in ends:
                    path.append(at)
                    at = to[at]
                last, n = ends.get(at, (at, 0))
                for p in reversed(path):
                    n += 1
                    ends[p] = last, n
                out.append((seed, last, n, blocked.get(last) if n >= enough else None))
        found = pd.DataFrame(out, columns=["seed", "last", "extras", "blocked_by"])
        for k in reversed(list(keys)):
            found.insert(0, k, rows[k].iloc[0])
        return found

    kinds = ", ".join(f"{k} {trades.schema[k].dataType.simpleString()}" for k in keys)
    return both.groupBy(*keys).applyInPandas(walk, f"{kinds}, seed string, last string, extras long, blocked_by string")


def breach_check(rule: str, trades: DataFrame, breaches: DataFrame, keys: Sequence[str], reason: str) -> DataFrame:
    """One check for each key of trades: violated if it has a breach."""
    n = breaches.groupBy(*keys).agg(F.count("*").alias("n_breaches"))
    j = trades.select(*keys).distinct().join(n, list(keys), "left")
    some = F.col("n_breaches") > 0
    return _check(rule, keys, j, F.when(some, "violated").otherwise("pass"), F.when(some, reason), F.coalesce("n_breaches", F.lit(0)).alias("n_breaches"))


def loss_streak(trades: DataFrame, keys: Sequence[str], config: RuleConfig) -> DataFrame:
    """R-3L30."""
    return breach_check("R-3L30", trades, streak_breaches(trades, keys, config), keys, f"entry before {config.streak_minutes} min timeout after {config.streak} consecutive losses")


def post_loss(trades: DataFrame, keys: Sequence[str], config: RuleConfig) -> DataFrame:
    """R-5M."""
    return breach_check("R-5M", trades, post_loss_breaches(trades, keys, config), keys, f"entry before {config.post_loss_minutes} min block after a loss")


def reentry(trades: DataFrame, keys: Sequence[str], config: RuleConfig) -> DataFrame:
    """R-REENTRY: more re-entries than allowed, or an entry in the block after the last failure."""
    c = reentry_clusters(trades, keys, config)
    bad = c.where((F.col("extras") > config.reentry_max) | F.col("blocked_by").isNotNull())
    return breach_check("R-REENTRY", trades, bad, keys, f"re-entry cluster exceeded max or {config.reentry_block_minutes} min block")
