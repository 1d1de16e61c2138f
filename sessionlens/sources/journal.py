"""The trades contract as Parquet, and journals: trades with costs whose fills are made from them.

A journal has trades, and lots that say from which account a trade came. Its fills aren't
stored: an entry, and an exit of the opposite side, are made from each trade, so that pairing
them again gives the trades back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.lookup import account_of
from .executions import FILLS, guard_columns
from .ledger_tables import fitted

#: The 40 columns of the trades contract, with the two that journals with costs add.
TRADES = (
    "trade_id string, source_group_id string, pair_method string, lot_seq long, direction string, instrument string, contract_month string, contract_year long, session_date date, qty long, "
    "entry_timestamp timestamp, exit_timestamp timestamp, entry_price double, exit_price double, entry_fill_id string, exit_fill_id string, gross_pnl_points double, gross_pnl_currency double, "
    "commission_cost double, slippage_cost double, day_fee_allocation double, net_pnl_currency double, r_multiple double, r_multiple_declared double, journal_risk_ticks long, fee_ticks double, "
    "net_ticks double, hold_seconds double, bars_held long, mae_points double, mfe_points double, stop_price double, target_price double, tags array<string>, notes_text string, status string, "
    "signal_id string, trigger string, venue string, tva_trade_id string"
)
NET = "account string, position_id string"


def trades_schema(net: bool = False) -> StructType:
    return StructType.fromDDL(f"{TRADES}, {NET}" if net else TRADES)


def to_trades(trades: DataFrame, net: bool = False) -> DataFrame:
    """The contract's columns and types, missing ones null, empty tag lists for null ones; other columns are dropped, forbidden ones refused."""
    out = fitted(guard_columns(trades), trades_schema(net))
    return out.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def write_trades(trades: DataFrame, path: str, net: bool = False, mode: str = "overwrite") -> None:
    """One folder for each session date, so that readers prune."""
    to_trades(trades, net).write.mode(mode).partitionBy("session_date").parquet(path)


def read_trades(spark: SparkSession, path: str, net: bool = False) -> DataFrame:
    schema = trades_schema(net)
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def fills_of_trades(trades: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys and a fill for each trade's entry and, where it has a whole exit, for its exit; one narrow pass, rows in no order."""
    opposite = F.when(F.col("direction") == "long", "sell").otherwise("buy")
    own = F.when(F.col("direction") == "long", "buy").otherwise("sell")
    both = F.array(
        F.struct(F.col("entry_fill_id").alias("fill_id"), own.alias("side"), F.col("entry_price").alias("price"), F.col("entry_timestamp").alias("timestamp")),
        F.struct(F.col("exit_fill_id").alias("fill_id"), opposite.alias("side"), F.col("exit_price").alias("price"), F.col("exit_timestamp").alias("timestamp")),
    )
    each = trades.withColumn("f", F.explode(both)).where("f.fill_id is not null and f.timestamp is not null and f.price is not null")
    made = {
        "source": F.lit("tradesviz"), "entry_kind": F.lit("imported"), "declared_stop": F.col("stop_price"), "declared_target": F.col("target_price"), "flags": F.array().cast("array<string>"),
        **{c: F.col(f"f.{c}") for c in ("fill_id", "side", "price", "timestamp")},
    }
    columns = [c for c in StructType.fromDDL(FILLS).fieldNames() if c != "venue"]
    return each.select(*keys, *(made.get(c, F.col(c)).alias(c) for c in columns))


def whole_fills(fills: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fills with the parts of one fill, which pairing had split over several trades, put together again; other columns as in the first part by trade order of prices."""
    rest = [c for c in fills.columns if c not in (*keys, "fill_id", "side", "qty")]
    return fills.groupBy(*keys, "fill_id", "side").agg(F.sum("qty").alias("qty"), F.min(F.struct(*rest)).alias("r")).select(*keys, "fill_id", "side", "qty", "r.*").select(fills.columns)


def stamped(trades: DataFrame, lots: DataFrame, journal: str = "journal") -> DataFrame:
    """trades with the account of their journal: the lots' one account, else the one in trade ids; problem says why there is none. trades: journal, trade_id, account of a request (or null); lots: journal, account."""
    def one(rows: DataFrame, name: str) -> DataFrame:
        return rows.where("account <> ''").groupBy(F.col(journal).alias(f"{name}_journal")).agg(F.count_distinct("account").alias(f"{name}_n"), F.min("account").alias(name))

    by_lot, by_id = one(lots, "lot"), one(trades.withColumn("account", account_of(F.col("trade_id"))), "id")
    met = trades.join(by_lot, F.col(journal) == F.col("lot_journal"), "left").join(by_id, F.col(journal) == F.col("id_journal"), "left")
    n, found = F.coalesce("lot_n", "id_n"), F.coalesce("lot", "id")
    asked = F.nullif(F.trim("account"), F.lit(""))
    problem = F.when(n.isNull(), "no account").when(n > 1, "several accounts").when(asked != found, "another account than requested")
    columns = [c for c in trades.columns if c != "account"]
    return met.select(*columns, F.when(problem.isNull(), found).alias("account"), problem.alias("problem"))


def uncosted(trades: DataFrame) -> DataFrame:
    """Closed trades without any cost: a journal with one has no source of costs."""
    return trades.where("status = 'closed' and commission_cost is null and day_fee_allocation is null")


def read_journal(spark: SparkSession, pattern: str, account: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Trades and problems (journal, problem, n) of the journal folders that a glob names: journal_trades.parquet and journal_lot_sources.parquet of each.

    journal is the folder's name. Trades of a journal with a problem stay out; journals are independent of each other.
    """
    def folder() -> Column:
        return F.url_decode(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -3))

    raw = spark.read.parquet(f"{pattern.rstrip('/')}/journal_trades.parquet").select(folder().alias("journal"), "*")
    lots = spark.read.parquet(f"{pattern.rstrip('/')}/journal_lot_sources.parquet").select(folder().alias("journal"), "account")
    trades = raw.select("journal", *[c for c in raw.columns if c not in ("journal", "account")], F.lit(account).cast("string").alias("account"))
    known = stamped(fitted(trades, StructType.fromDDL(f"journal string, {TRADES}, {NET}")), lots)
    costless = uncosted(known).select("journal", F.lit("no source of costs").alias("problem"))
    problems = known.where("problem is not null").select("journal", "problem").unionByName(costless).groupBy("journal", "problem").agg(F.count("*").alias("n"))
    good = known.join(problems.select(F.col("journal").alias("bad")).distinct(), F.col("journal") == F.col("bad"), "left_anti").drop("problem")
    return good, problems
