"""Predicates and gates over clips, days and accounts, and small list and name functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lookup import same_key_checks
from .speech import ALIGNMENT_LOW

#: The time stamp in a recording's name, and the clock it is read from.
STAMP = r"(\d{4}-\d{2}-\d{2})[ T_](\d{2})[-:](\d{2})[-:](\d{2})"
RECORDER_ZONE = "Europe/Vienna"


def has_core(clips: DataFrame, checks: DataFrame) -> DataFrame:
    """session_id, has_core. clips: session_id, sha, parts, duration_s, alignment_invalid; checks: session_id, sha, parts, duration_s, verdict ('force' overrides).

    A forced check says yes; a suspected pause, an invalid alignment, or no check of this very recording says no.
    """
    known = same_key_checks(checks, clips).groupBy("session_id").agg(F.collect_set("verdict").alias("v")).withColumnRenamed("session_id", "v_id")
    said = clips.join(known, F.col("session_id") == F.col("v_id"), "left")
    held = F.when(F.array_contains("v", "force"), True).when(F.array_contains("v", "suspected"), False).when(F.coalesce("alignment_invalid", F.lit(False)), False)
    return said.select("session_id", held.otherwise(F.col("v").isNotNull()).alias("has_core"))


def alignment_low(sessions: DataFrame, trades: DataFrame, least: float = ALIGNMENT_LOW) -> DataFrame:
    """session_id, low: the session's confidence (if known) lies below the limit, else that of all its trades; false without either.

    sessions: session_id, confidence; trades: session_id, confidence, is_low.
    """
    each = F.coalesce("is_low", F.lit(False)) | F.coalesce(F.col("confidence") < least, F.lit(False))
    by_trades = trades.groupBy(F.col("session_id").alias("t_id")).agg(F.bool_and(each).alias("all_low"))
    return sessions.join(by_trades, F.col("session_id") == F.col("t_id"), "left").select("session_id", F.coalesce(F.col("confidence") < least, "all_low", F.lit(False)).alias("low"))


def stale_days(days: DataFrame) -> DataFrame:
    """Days that stop a report: stale or missing. days: day, state."""
    return days.where(F.col("state").isin("stale", "missing")).select("day", "state").distinct()


def audit_classes(fills: DataFrame, stored: DataFrame, legs: DataFrame, instrument: str) -> DataFrame:
    """fill_id, class of a day's fills: of another instrument, filtered manual (stored, in no trade), stored, or without a stored fill.

    fills: fill_id, instrument; stored: fill_id, entry_kind; legs: fill_id of all trade legs.
    """
    s = stored.select(F.col("fill_id").alias("s_id"), "entry_kind").dropDuplicates(["s_id"])
    used = legs.select(F.col("fill_id").alias("l_id")).distinct()
    j = fills.select("fill_id", "instrument").join(s, F.col("fill_id") == F.col("s_id"), "left").join(used, F.col("fill_id") == F.col("l_id"), "left")
    kind = F.when(~F.col("instrument").eqNullSafe(F.lit(instrument)), "other_instrument").when(F.col("s_id").isNull(), "not_stored")
    return j.select("fill_id", kind.when((F.col("entry_kind") == "manual") & F.col("l_id").isNull(), "filtered_manual").otherwise("stored").alias("class"))


def desk_rules(trades: DataFrame, accounts: DataFrame, desks: DataFrame) -> DataFrame:
    """session_id, account, desk, max_trades, problem: the thresholds of the one account that a session's trades name.

    trades: session_id, account; accounts: account, desk; desks: desk, max_trades. With a problem the other columns past account are null.
    """
    name = F.trim(F.col("account").cast("string"))
    named = F.when(name != "", name)
    who = trades.groupBy("session_id").agg(F.min(named).alias("account"), F.max(named).alias("other"), F.bool_or(named.isNull()).alias("unnamed"))
    a = accounts.select(F.trim(F.col("account").cast("string")).alias("a_id"), "desk")
    d = desks.select(F.col("desk").alias("d_id"), "max_trades")
    j = who.join(a, F.col("account") == F.col("a_id"), "left").join(d, F.col("desk") == F.col("d_id"), "left")
    problem = (
        F.when(F.col("account") != F.col("other"), "several accounts").when(F.col("account").isNull() | F.col("unnamed"), "account missing")
        .when(F.col("a_id").isNull(), "unknown account").when(F.col("d_id").isNull(), "unknown desk")
    )
    return j.withColumn("problem", problem).select("session_id", "account", *(F.when(F.col("problem").isNull(), F.col(c)).alias(c) for c in ("desk", "max_trades")), "problem")


def drop_outliers(samples: DataFrame, keys: Sequence[str], x: str, y: str, agree: float, tie: str) -> DataFrame:
    """samples without a first one above all later ones, a last one below all earlier ones, and inner ones outside both ends, each by more than ``agree``; judged twice."""

    def judged(s: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(x, tie)
        every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        after = Window.partitionBy(*keys).orderBy(F.desc(x), F.desc(tie)).rowsBetween(Window.unboundedPreceding, -1)  # reversed, as it grows row by row
        v = s.withColumns({
            "__i": F.row_number().over(w), "__n": F.count("*").over(Window.partitionBy(*keys)), "__a": F.first(y).over(every), "__b": F.last(y).over(every),
            "__later": F.max(y).over(after), "__earlier": F.min(y).over(before),
        })
        ends = F.when(F.col("__i") == 1, F.col(y) > F.col("__later") + agree).when(F.col("__i") == F.col("__n"), F.col(y) < F.col("__earlier") - agree)
        inner = (F.col(y) < F.least("__a", "__b") - agree) | (F.col(y) > F.greatest("__a", "__b") + agree)
        return v.where((F.col("__n") < 2) | ~ends.otherwise(inner)).select(*s.columns)

    return judged(judged(samples.where(F.col(y).isNotNull())))


def first_row(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def union_gaps(a: Column, b: Column) -> Column:
    """Sorted distinct gaps of both lists; null lists are empty."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(a, none), F.coalesce(b, none)))


def replace_gaps(gaps: Column, prefix: str, new: Column) -> Column:
    """The new gaps and those of the old that don't start with the prefix."""
    return union_gaps(F.filter(F.coalesce(gaps, F.array().cast("array<string>")), lambda g: ~g.startswith(prefix)), new)


def recording_name(path: Column) -> dict[str, Column]:
    """session_id, start_us and prefix of a recording's file name; null without a time stamp."""
    stem = F.regexp_replace(F.element_at(F.split(path, r"[/\\]"), -1), r"(?<=.)\.[^.]*$", "")

    def part(i: int) -> Column:
        return F.regexp_extract(stem, STAMP, i)

    known = stem.rlike(STAMP)
    start = F.to_utc_timestamp(F.to_timestamp_ntz(F.concat(part(1), F.lit(" "), part(2), F.lit(":"), part(3), F.lit(":"), part(4)), F.lit("yyyy-MM-dd HH:mm:ss")), RECORDER_ZONE)
    return {
        "session_id": F.when(known, F.concat(part(1), F.lit("_"), part(2), part(3), part(4))),
        "start_us": F.when(known, F.unix_micros(start.cast("timestamp"))),
        "prefix": F.when(known, F.regexp_extract(stem, "^(.*?)" + STAMP, 1)),
    }


def shift_week(week: Column, weeks: int) -> Column:
    """An ISO week id (2026-W07) some weeks on; null if the id isn't one."""
    year, number = F.regexp_extract(week, r"^(\d{4})-W(\d{2})$", 1).try_cast("int"), F.regexp_extract(week, r"^(\d{4})-W(\d{2})$", 2).try_cast("int")
    fourth = F.make_date(year, F.lit(1), F.lit(4))  # always in week 1
    monday = F.date_add(F.date_add(fourth, -F.weekday(fourth)), (number - 1) * 7)
    to = F.date_add(monday, F.lit(7 * weeks + 3))
    valid = (number >= 1) & (F.weekofyear(F.date_add(monday, 3)) == number)
    return F.when(valid, F.format_string("%04d-W%02d", F.year(to), F.weekofyear(to)))


def shift_month(month: Column, months: int) -> Column:
    """A month id (2026-02) some months on; null if the id isn't one."""
    first = F.when(month.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), F.concat(month, F.lit("-01"))).try_cast("date")
    return F.date_format(F.add_months(first, months), "yyyy-MM")


def section_residual_us(wall_us: Column, video_us: Column, is_first: Column, offset_us: int) -> Column:
    """Distance of a section's wall and video spans; the first section's wall span holds the first frame's offset too."""
    return F.abs(wall_us - video_us - F.when(is_first, F.lit(offset_us)).otherwise(F.lit(0)))


def anchored_verdicts(verdicts: DataFrame, anchors: DataFrame) -> DataFrame:
    """session_id, verdict: a verified anchor clears a session, a partial one makes it unverifiable, whatever the readings said."""
    a = anchors.select(F.col("session_id").alias("a_id"), F.when(F.col("status") == "verified", "clear").when(F.col("status") == "partial", "unverifiable").alias("__v"))
    return verdicts.join(a, F.col("session_id") == F.col("a_id"), "left").select("session_id", F.coalesce("__v", "verdict").alias("verdict"))
