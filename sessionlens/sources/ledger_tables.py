"""The ledger's tables in Spark's catalogue: keyed upserts, partitions overwritten in place, columns added later.

A table has a key, an owner (the columns that a writer replaces at once: a session's or a
day's rows) and a partition column that follows from the row (its ISO week, or a bucket of the
owner where a row has no day). An upsert rewrites only the partitions that hold rows of the
written owners, before or after: those are found from the owner and partition columns
alone, then read, joined without the replaced owners and overwritten by Spark's dynamic
partition overwrite. What is written is staged as a table first, so an attempt that fails before
its commit changes nothing, and one that is repeated gives the same rows. One writer at a time for a table.

Rows without a whole key are left out. Several rows of a key: the first one by the given
order, nulls last, then by all columns, so that repeats give one row. Columns that a table
doesn't have are dropped, ones that the rows don't have are null.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..operators.ledger import iso_week
from .shared import shared_path

#: Buckets of owners in tables whose rows have no day.
OWNER_BUCKETS = 64


@dataclass(frozen=True)
class Table:
    columns: str
    key: tuple[str, ...]
    owner: tuple[str, ...]
    #: Column whose ISO week is the partition; None: a bucket of the owner.
    day: str | None = None

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.columns)

    def partition(self) -> Column:
        if self.day:
            return F.when(F.col(self.day).isNotNull(), iso_week(F.col(self.day))).otherwise("none")
        return F.format_string("b%02d", F.pmod(F.xxhash64(*self.owner), F.lit(OWNER_BUCKETS)))


PARTITION = "part"
TABLES: dict[str, Table] = {
    "sessions": Table("session_id string, session_date date, iso_week string, year_month string, start_wallclock_vienna string, duration_s double, language string, trade_count int, hours double", ("session_id",), ("session_id",), "session_date"),
    "trades": Table(
        "session_id string, tva_trade_id string, trade_id string, entry_fill_id string, direction string, instrument string, entry_price double, exit_price double, net_pnl_currency double, status string, venue string, "
        "stated_setup string, stated_playbook string, lab_token string, tag_alignment string, stated_lab_agree boolean", ("session_id", "tva_trade_id"), ("session_id",),
    ),
    "rule_checks": Table("session_id string, rule string, status string, reason string", ("session_id", "rule"), ("session_id",)),
    # Events have no key: several may say the same; a session's are replaced at once.
    "events": Table("session_id string, t double, kind string, seg string, text string", (), ("session_id",)),
    "experiments": Table("id string, rule_change string, start string, stop_criterion string, status string, created_at string", ("id",), ("id",)),
    "day_rollups": Table("day date, trade_count int, hours double, trades_outside_clips int, trades_per_hour_reason string, trades_span_zero int", ("day",), ("day",), "day"),
    "day_rule_checks": Table("day date, rule string, status string, reason string", ("day", "rule"), ("day",), "day"),
}

#: Columns of a trades file that the ledger takes over, with their types.
TRADE_COLUMNS = {
    "trade_id": "string", "entry_fill_id": "string", "direction": "string", "instrument": "string", "entry_price": "double", "exit_price": "double", "net_pnl_currency": "double", "status": "string", "venue": "string",
}


def fitted(rows: DataFrame, schema: StructType) -> DataFrame:
    """rows with exactly the schema's columns: cast, missing ones as null. Values that can't be cast are null."""
    have = {c.lower() for c in rows.columns}
    return rows.select(*(_as(F.col(f.name), rows, f) if f.name.lower() in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


def _as(c: Column, rows: DataFrame, f: StructField) -> Column:
    same = rows.select(f.name).schema[0].dataType == f.dataType
    return (c if same else c.try_cast(f.dataType)).alias(f.name)


def first_of_key(rows: DataFrame, key: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """One row for each whole key: the first by order, then by all columns."""
    whole = rows.where(" and ".join(f"{k} is not null" for k in key))
    w = Window.partitionBy(*key).orderBy(*order, *(F.col(c).asc_nulls_last() for c in rows.columns if c not in key))
    return whole.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def trade_rows(trades: DataFrame) -> DataFrame:
    """Ledger rows of trades files (session_id and any of TRADE_COLUMNS and tva_trade_id): the tool's own id or else the trade's, never empty.

    Several rows of an id: a closed one first, then the earliest entry fill, then by all columns.
    """
    known = fitted(trades, StructType.fromDDL("session_id string, tva_trade_id string, " + ", ".join(f"{k} {t}" for k, t in TRADE_COLUMNS.items())))
    named = known.withColumn("tva_trade_id", F.coalesce("tva_trade_id", "trade_id")).where("tva_trade_id <> ''")
    return first_of_key(named, TABLES["trades"].key, [(F.coalesce(F.col("status") == "closed", F.lit(False))).desc(), F.col("entry_fill_id").asc_nulls_last()])


class Ledger:
    """The ledger's tables in one database; location: the folder of a new database, else one in the shared folder."""

    def __init__(self, spark: SparkSession, database: str, location: str | None = None):
        self.spark, self.database = spark, database
        if not spark.catalog.databaseExists(database):
            spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{location or shared_path(spark, 'ledger')}'")

    def name(self, table: str) -> str:
        return f"{self.database}.{table}"

    def ensure(self, table: str) -> None:
        """Creates a table, or adds the columns that it lacks; columns keep their types."""
        t = TABLES[table]
        if not self.spark.catalog.tableExists(self.name(table)):
            self.spark.sql(f"CREATE TABLE {self.name(table)} ({t.columns}, {PARTITION} string) USING parquet PARTITIONED BY ({PARTITION})")
            return
        have = {f.name: f.dataType for f in self.spark.table(self.name(table)).schema}
        if wrong := [f.name for f in t.schema if f.name in have and have[f.name] != f.dataType]:
            raise ValueError(f"columns of {table} have other types: {', '.join(wrong)}")
        if new := [f"{f.name} {f.dataType.simpleString()}" for f in t.schema if f.name not in have]:
            self.spark.sql(f"ALTER TABLE {self.name(table)} ADD COLUMNS ({', '.join(new)})")

    def read(self, table: str) -> DataFrame:
        """Rows of a table as they are now, with every column of its present form."""
        self.ensure(table)
        self.spark.catalog.refreshTable(self.name(table))
        return self.spark.table(self.name(table)).select(*(f.name for f in TABLES[table].schema), PARTITION)

    def write(self, table: str, rows: DataFrame, owners: DataFrame | None = None, order: Sequence[Column] = ()) -> list[str]:
        """Replaces all rows of the owners (those in rows, and further ones that have no row any more) by rows; returns the partitions written."""
        t, before = TABLES[table], self.read(table)
        new = fitted(rows, t.schema).where(" and ".join(f"{c} is not null" for c in t.owner))
        if t.key:
            new = first_of_key(new, t.key, order)
        # Both are read several times, and the rows may come from the table itself.
        new = self._stage(new.withColumn(PARTITION, t.partition()), "new")
        gone = new.select(*t.owner)
        if owners is not None:
            gone = gone.unionByName(fitted(owners, StructType([f for f in t.schema if f.name in t.owner])))
        gone = self._stage(gone.distinct(), "owners")
        held = before.join(gone, list(t.owner), "left_semi").select(PARTITION)
        touched = sorted(r[0] for r in held.unionByName(new.select(PARTITION)).distinct().collect())  # partitions, not rows
        if not touched:
            return []
        kept = before.where(F.col(PARTITION).isin(touched)).join(gone, list(t.owner), "left_anti").select(new.columns)
        after = self._stage(kept.unionByName(new), "after")
        mode = self.spark.conf.get("spark.sql.sources.partitionOverwriteMode", "static")
        self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            columns = self.spark.table(self.name(table)).columns
            after.select(*(c if c in after.columns else F.lit(None).alias(c) for c in columns)).hint("rebalance", PARTITION).write.insertInto(self.name(table), overwrite=True)
        finally:
            self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
        # Partitions of which no row is left are not in what was written.
        left = {r[0] for r in after.select(PARTITION).distinct().collect()}
        for p in touched:
            if p not in left:
                self.spark.sql(f"ALTER TABLE {self.name(table)} DROP IF EXISTS PARTITION ({PARTITION} = '{p}')")
        self.spark.catalog.refreshTable(self.name(table))
        return touched

    def drop(self, table: str, owners: DataFrame) -> list[str]:
        """Removes all rows of the owners."""
        return self.write(table, self.spark.createDataFrame([], TABLES[table].schema), owners)

    def _stage(self, df: DataFrame, what: str) -> DataFrame:
        path = shared_path(self.spark, f"ledger-{what}")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
