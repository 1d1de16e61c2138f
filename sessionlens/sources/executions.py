"""Executions from CSV: header rules, typed rows, rejects with a reason, and the Parquet contracts."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .ledger_tables import fitted

#: The export's columns, not-available marks, contract roots and month letters, exchange day.
COLUMNS = ("date", "symbol", "side", "currency", "underlying", "asset_type", "price", "quantity", "commission", "fees", "stop_loss", "profit_target", "tags", "notes", "spread_id")
NOT_AVAILABLE = ("", "nan", "na", "n/a", "none", "null", "<na>", "nat")
SYMBOL = r"^(MNQ|MES)([FGHJKMNQUVXZ])(\d{2})$"
ZONE, ROLL_HOUR = "America/New_York", 18
OFFSET_TIME = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?)(Z|[+-]\d{2}:?\d{2})$"
VENUES = ("topstepx", "topstep", "amp")
FORBIDDEN = ("commission", "fees")
#: The columns of the fills contract.
FILLS = (
    "fill_id string, source string, source_group_id string, instrument string, contract_month string, contract_year long, side string, qty long, price double, timestamp timestamp, session_date date, "
    "entry_kind string, tags array<string>, notes_text string, declared_stop double, declared_target double, flags array<string>, venue string"
)
CONTRACT = tuple(f.split()[0] for f in FILLS.split(", "))


def check_header(names: list[str]) -> None:
    """Refuses blank, repeated and missing column names."""
    plain = [n.strip().lstrip("﻿") for n in names]
    if any(not n for n in plain):
        raise ValueError("blank column name")
    if twice := sorted(n for n, k in Counter(plain).items() if k > 1):
        raise ValueError(f"repeated columns: {', '.join(twice)}")
    if missing := [c for c in COLUMNS if c not in plain]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """All columns as text, after the header check; a byte-order mark is skipped.

    Notes may hold line ends inside quotes; where they don't, multi_line=False lets Spark split large files.
    """
    reader = spark.read.option("encoding", "UTF-8").option("multiLine", str(multi_line).lower()).option("escape", '"')
    raw = reader.option("header", "true").csv(path)
    # Repeated names would have got a number from the reader, so the header is read once as a row.
    header = reader.option("header", "false").csv(path).first()
    check_header([n or "" for n in header] if header else [])
    return raw.toDF(*[c.strip().lstrip("\ufeff") for c in raw.columns])


def available(text: Column) -> Column:
    """Null for the marks of a missing value."""
    return F.when(~F.lower(F.trim(text)).isin(*NOT_AVAILABLE), F.trim(text))


def number(text: Column) -> Column:
    """A finite number or null."""
    v = available(text).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < 1e300), v)


def instant_us(text: Column) -> Column:
    """Microseconds of an ISO time with a mandatory offset; null without one."""
    t = F.trim(text)
    sign = F.when(F.regexp_extract(t, OFFSET_TIME, 3).startswith("-"), -1).otherwise(1)
    zone = F.regexp_replace(F.regexp_extract(t, OFFSET_TIME, 3), "[^0-9]", "")
    offset = F.when(zone == "", 0).otherwise(sign * (F.substring(zone, 1, 2).try_cast("long") * 60 + F.substring(zone, 3, 2).try_cast("long")))
    local = F.concat_ws(" ", F.regexp_extract(t, OFFSET_TIME, 1), F.regexp_extract(t, OFFSET_TIME, 2)).try_cast("timestamp_ntz")
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), local)
    return F.when(t.rlike(OFFSET_TIME), us - offset * 60_000_000)


def session_date(us: Column) -> Column:
    """The exchange day: from 18:00 in New York on it is the next one."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(ZONE), F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")))
    return F.date_add(F.to_date(local), F.when(F.hour(local) >= ROLL_HOUR, 1).otherwise(0))


def tag_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")


def plain_note(text: Column) -> Column:
    """Images as [image], other tags as blanks, the common entities, single blanks."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)<img[^>]*>", "[image]")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def venue_of(name: Column) -> Column:
    """The venue that a file name has as a word."""
    parts = F.split(F.lower(name), r"[^a-z0-9]+")
    return F.coalesce(*(F.when(F.array_contains(parts, v), F.lit(v)) for v in VENUES))


def validate(rows: DataFrame) -> DataFrame:
    """Typed columns and reject_reason (null for good rows). rows: row_no and the export's columns as text."""
    symbol = F.upper(F.trim(F.coalesce("symbol", F.lit(""))))
    root = F.regexp_extract(symbol, SYMBOL, 1)
    manual = F.lower(F.trim(F.coalesce("asset_type", F.lit("")))) != "future"
    qty, price, us = available(F.col("quantity")).try_cast("long"), number(F.col("price")), instant_us(F.col("date"))
    side = F.lower(F.trim(F.coalesce("side", F.lit(""))))
    reason = (
        F.when(us.isNull(), "date").when((root == "") & ~symbol.isin("MNQ", "MES"), "symbol").when(~side.isin("buy", "sell"), "side")
        .when(qty.isNull() | (qty < 0) | ((qty == 0) & ~manual), "quantity").when(price.isNull() | (price <= 0), "price")
    )
    return rows.select(
        "row_no", reason.alias("reject_reason"), us.alias("ts_us"), session_date(us).alias("session_date"), F.when(root != "", root).otherwise(symbol).alias("instrument"),
        F.nullif(F.regexp_extract(symbol, SYMBOL, 2), F.lit("")).alias("contract_month"), (F.regexp_extract(symbol, SYMBOL, 3).try_cast("long") + 2000).alias("contract_year"),
        side.alias("side"), qty.alias("qty"), price.alias("price"), F.when(manual, "manual").otherwise("imported").alias("entry_kind"), tag_list(F.col("tags")).alias("tags"),
        plain_note(F.col("notes")).alias("notes_text"), number(F.col("stop_loss")).alias("declared_stop"), number(F.col("profit_target")).alias("declared_target"),
        available(F.col("spread_id")).alias("source_group_id"), number(F.col("commission")).alias("commission"), number(F.col("fees")).alias("fees"),
    )


def split_rejects(validated: DataFrame, fail: bool = False) -> tuple[DataFrame, DataFrame]:
    """Good rows and rejects; with fail, any reject stops the job."""
    if fail:
        checked = validated.withColumn("__ok", F.assert_true(F.col("reject_reason").isNull(), F.concat(F.lit("row "), "row_no", F.lit(": "), "reject_reason")))
        return checked.where("__ok is null").drop("reject_reason", "__ok"), validated.where("false")
    return validated.where("reject_reason is null").drop("reject_reason"), validated.where("reject_reason is not null").select("row_no", "reject_reason")


def with_ids(fills: DataFrame, source: str = "tv") -> DataFrame:
    """Adds fill_id from row, group, time, side, price and quantity."""
    key = F.concat_ws(":", F.lit(source), "row_no", F.coalesce("source_group_id", F.lit("-")), "ts_us", "side", F.format_string("%s", F.col("price")), "qty")
    return fills.withColumn("fill_id", key)


def imported_only(fills: DataFrame, include_manual: bool = False) -> DataFrame:
    """Fills with a quantity; manual ones only if wanted."""
    kept = fills.where("qty is not null")
    return kept if include_manual else kept.where("entry_kind = 'imported'")


def guard_columns(df: DataFrame) -> DataFrame:
    """Refuses to hand on columns that the outputs must not have."""
    if bad := [c for c in df.columns if c in FORBIDDEN]:
        raise ValueError(f"columns must not leave: {', '.join(bad)}")
    return df


def to_contract(df: DataFrame) -> DataFrame:
    """The contract's columns and types, missing ones as null, the timestamp from ts_us if need be; others are dropped."""
    if "timestamp" not in df.columns and "ts_us" in df.columns:
        df = df.withColumn("timestamp", F.timestamp_micros("ts_us"))
    return fitted(df, StructType.fromDDL(FILLS))


def write_fills(fills: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder for each session date, so that readers prune."""
    guard_columns(fills).write.mode(mode).partitionBy("session_date").parquet(path)


def read_fills(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_contract(spark: SparkSession, path: str) -> DataFrame:
    """Fills by the contract: columns that the files lack are null, others aren't read."""
    return spark.read.schema(StructType.fromDDL(FILLS)).parquet(path).select(*CONTRACT)
