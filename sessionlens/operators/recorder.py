"""Recorder logs and clock samples, days made of several clips, and dates and times attached to fills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import clocks, screens

#: States of a session's recorder log; samples of a file; seconds before an entry that its window starts.
LOG_STATES = ("ok", "missing", "invalid_json")
SAMPLES = 8
LEAD_US = 180_000_000


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def event_files(events: DataFrame, key: str = "session_id") -> DataFrame:
    """events (key, row_no, event, file) without changes of file, with the name of the file each belongs to in ``file``.

    A file holds until the next that is named. Events before the first name belong to the first file that a start or change names;
    without any they have none.
    """
    named = F.when(F.trim("file") != "", F.col("file"))
    w = Window.partitionBy(key).orderBy("row_no")
    opening = F.when(F.col("event").isin("record_start", "file_changed"), named)
    first = F.first(opening, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    held = F.coalesce(F.last(named, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), first)
    changes = F.coalesce((F.col("event") == "file_changed") & named.isNotNull(), F.lit(False))
    return events.withColumns({"_held": base_name(held), "_changes": changes}).where(~F.col("_changes")).withColumn("file", F.col("_held")).drop("_held", "_changes")


def events_of_files(events: DataFrame, videos: DataFrame, key: str = "session_id") -> DataFrame:
    """key, name, row_no, event: the events of each video (key, name); events of no known file belong to every video of their session."""
    v = videos.select(F.col(key).alias("v_key"), base_name(F.col("name")).alias("v_name")).distinct()
    mine = F.col("file").isNull() | (F.col("file") == F.col("v_name"))
    return event_files(events, key).join(v, F.col(key) == F.col("v_key")).where(mine).select(key, F.col("v_name").alias("name"), "row_no", "event")


def log_counts(sessions: DataFrame) -> DataFrame:
    """state, n for each state of a log, zeros included; other states aren't counted. sessions: state."""
    states = F.explode(F.array(*(F.lit(s) for s in LOG_STATES))).alias("name")
    counts = sessions.where(F.col("state").isin(*LOG_STATES)).groupBy("state").agg(F.count("*").alias("n"))
    fixed = sessions.sparkSession.range(1).select(states)
    return fixed.join(counts, F.col("name") == F.col("state"), "left").select(F.col("name").alias("state"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def sample_times(duration_s: Column) -> Column:
    """Evenly spaced times, inset by a second or a quarter; none for a duration that is negative, not finite or null."""
    inset = F.least(F.lit(1.0), duration_s / 4)
    span = F.greatest(duration_s - inset * 2, F.lit(0.0))
    usable = duration_s.isNotNull() & ~F.isnan(duration_s) & (duration_s >= 0) & (duration_s < float("inf"))
    times = F.transform(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), lambda i: inset + i * span / (SAMPLES - 1))
    return F.when(usable, times).otherwise(F.array().cast("array<double>"))


def resolve_clock(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """samples (keys, wall_us, resolution_s 1 or 60) with file_resolution_s, reason, and wall_us cut to the minute where the file's clock shows minutes.

    Two samples with seconds make a clock of seconds, else two with minutes one of minutes, else it is null. A minute sample of a
    clock of seconds is rejected as 'resolution_mismatch'.
    """
    w = Window.partitionBy(*keys)
    shown = [F.count_if(F.col("resolution_s") == r).over(w) for r in (1, 60)]
    clock = F.when(shown[0] >= 2, 1).when(shown[1] >= 2, 60)
    r, f = F.col("resolution_s"), F.col("file_resolution_s")
    cut = F.when((f == 60) & (r == 1), F.col("wall_us") - F.pmod(F.col("wall_us"), F.lit(60_000_000))).otherwise(F.col("wall_us"))
    return samples.withColumn("file_resolution_s", clock).withColumns({"wall_us": cut, "reason": F.when((f == 1) & (r == 60), "resolution_mismatch")})


def near_dates(fills: DataFrame, days: DataFrame) -> DataFrame:
    """day and the columns of fills whose written date is that day, the one before or the one after; a fill without a date is in no day."""
    about = days.select("day", F.explode(F.array(*(F.date_add("day", i) for i in (-1, 0, 1)))).alias("near_date")).distinct()
    return fills.join(about, F.col("civil_date") == F.col("near_date")).drop("near_date")


def trades_of_fills(trades: DataFrame, fills: DataFrame) -> DataFrame:
    """trades whose entry_fill_id is a fill_id of fills."""
    return trades.join(fills.select(F.col("fill_id").alias("f_id")), F.col("entry_fill_id") == F.col("f_id"), "left_semi")


def day_paths(clips: DataFrame) -> DataFrame:
    """day, day_path: at least two clips, or one with a suspected pause. clips: day, verdict."""
    suspected = F.bool_or(F.coalesce(F.col("verdict") == "suspected", F.lit(False)))
    return clips.groupBy("day").agg(((F.count("*") >= 2) | suspected).alias("day_path"))


def outside_flags(trades: DataFrame, clips: DataFrame, paths: DataFrame) -> DataFrame:
    """trade_id, gap, low: an exit at or after the clip's end on a day path is the gap 'exit_outside_clip'; a clock of minutes makes the alignment low.

    trades: trade_id, session_id, exit_us; clips: session_id, day, end_us, resolution_s; paths as ``day_paths`` gives them.
    """
    c = clips.join(paths, "day", "left").select(F.col("session_id").alias("c_id"), F.col("end_us").alias("c_end"), "resolution_s", F.coalesce("day_path", F.lit(False)).alias("day_path"))
    gap = F.when(F.col("day_path") & (F.col("exit_us") >= F.col("c_end")), "exit_outside_clip")
    return trades.join(c, F.col("session_id") == F.col("c_id")).select("trade_id", gap.alias("gap"), F.coalesce(F.col("resolution_s") == 60, F.lit(False)).alias("low"))


def attach_dates(fills: DataFrame, rows: DataFrame) -> DataFrame:
    """fills (fill_id 'tv:ROW:...', civil_date) with null dates taken from rows (row_no, civil_date) by the id's row number."""
    row = F.expr(r"try_cast(nullif(regexp_extract(fill_id, '^tv:(\\d+):', 1), '') as bigint)")
    known = rows.select(F.col("row_no").alias("r_no"), F.col("civil_date").alias("r_date"))
    missing = F.when(F.col("civil_date").isNull(), row)
    return fills.withColumn("_row", missing).join(known, F.col("_row") == F.col("r_no"), "left").withColumn("civil_date", F.coalesce("civil_date", "r_date")).drop("_row", "r_no", "r_date")


def entry_times(trades: DataFrame, sessions: DataFrame) -> DataFrame:
    """trade_id, entry_video_us: the entry in the recording's clock, by the session's start, offset and drift if both it and the fill are known, else the window's start and its lead.

    trades: trade_id, session_id, entry_us (null: no fill), window_us; sessions: session_id, start_us, offset_us and drift (seconds for each hour; nulls: zero).
    """
    s = sessions.select(F.col("session_id").alias("s_id"), "start_us", F.coalesce("offset_us", F.lit(0)).alias("offset_us"), F.coalesce("drift", F.lit(0.0)).alias("drift"))
    by_fill = clocks.to_video(F.col("start_us"), F.col("entry_us"), F.col("offset_us"), F.col("drift"))
    return trades.join(s, F.col("session_id") == F.col("s_id"), "left").select("trade_id", F.coalesce(by_fill, F.col("window_us") + LEAD_US).alias("entry_video_us"))


def mapped_samples(samples: DataFrame) -> DataFrame:
    """sample_id, y_us, resolution, reason: how far a screen's clock is off the session's start and the sample's time.

    samples: sample_id, text, confidence, start_us, video_us. A text that holds no clock is 'unparseable'; an empty one has no reason.
    """
    at = screens.clock_us(F.col("text"), F.col("start_us") + F.col("video_us"), F.col("confidence"))
    y = at - F.col("start_us") - F.col("video_us")
    reason = F.when((F.trim("text") != "") & y.isNull(), "unparseable")
    return samples.select("sample_id", y.cast("long").alias("y_us"), F.when(y.isNotNull(), screens.clock_resolution(F.col("text"))).alias("resolution"), reason.alias("reason"))


def allowed_ids(kinds: Sequence[DataFrame], key: str = "session_id") -> DataFrame:
    """key, id, place: the ids that a session's text may cite, each once, those of earlier tables (key, id) first and in order of id within one."""
    ranked = [d.select(key, F.col("id").cast("string").alias("id"), F.lit(k).alias("kind")).where("id <> ''") for k, d in enumerate(kinds)]
    every = ranked[0]
    for d in ranked[1:]:
        every = every.unionByName(d)
    once = every.groupBy(key, "id").agg(F.min("kind").alias("kind"))
    return once.select(key, "id", F.row_number().over(Window.partitionBy(key).orderBy("kind", "id")).cast("long").alias("place"))
