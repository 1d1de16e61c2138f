"""Evidence of a trade: its window in the recording and what lies in it or nearest to it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import range_join

#: Padding before the entry and after the exit, bounds of a clip around an entry, offsets of frames around a chapter.
PRE_US, POST_US = 180_000_000, 120_000_000
CLIP_US = (-30_000_000, 60_000_000)
FRAME_OFFSETS_US = (-5_000_000, -2_000_000, 0, 2_000_000, 5_000_000)


def windows(trades: DataFrame, pre_us: int = PRE_US, post_us: int = POST_US) -> DataFrame:
    """trades (entry_us, exit_us, duration_us, from the clip's start) with t0_us, t1_us and clipped: padded and cut to the recording."""
    raw0, raw1 = F.col("entry_us") - pre_us, F.coalesce("exit_us", "entry_us") + post_us
    t0 = F.least(F.greatest(raw0, F.lit(0)), F.col("duration_us"))
    t1 = F.least(F.greatest(raw1, F.lit(0)), F.col("duration_us"))
    return trades.withColumns({"t0_us": t0, "t1_us": t1, "clipped": (t0 != raw0) | (t1 != raw1)})


def segments_in(wins: DataFrame, segments: DataFrame, keys: Sequence[str], width: int = 60_000_000) -> DataFrame:
    """trade_id, seg: segments that overlap a window, ends included. Both sides are listed by minute, each pair is kept once."""
    a = wins.select(*keys, "trade_id", "t0_us", "t1_us").withColumn("b", F.explode(F.sequence(F.floor(F.col("t0_us") / width), F.floor(F.col("t1_us") / width))))
    s = segments.select(*keys, "seg", F.col("t0_us").alias("s0"), F.col("t1_us").alias("s1")).withColumn("b", F.explode(F.sequence(F.floor(F.col("s0") / width), F.floor(F.col("s1") / width))))
    first = F.greatest(F.floor(F.col("t0_us") / width), F.floor(F.col("s0") / width))
    return a.join(s, [*keys, "b"]).where((F.col("s0") <= F.col("t1_us")) & (F.col("s1") >= F.col("t0_us")) & (F.col("b") == first)).select(*keys, "trade_id", "seg")


def _neighbours(spans: DataFrame, points: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """spans with prev and next: the points (p_us, point_id) next to the time ``at``, by one sorted sweep over both."""
    none = F.lit(None).cast("struct<p_us:bigint,point_id:" + points.schema["point_id"].dataType.simpleString() + ">")
    carried = [F.col(c) for c in spans.columns if c not in keys]
    a = spans.select(*keys, F.col(at).alias("__t"), F.lit(1).alias("__turn"), F.lit(None).cast(points.schema["point_id"].dataType).alias("__id"), none.alias("__p"), F.struct(*carried).alias("__s"))
    p = points.where(F.col("p_us").isNotNull())
    b = p.select(*keys, F.col("p_us").alias("__t"), F.lit(0).alias("__turn"), F.col("point_id").alias("__id"), F.struct(F.col("p_us").cast("long").alias("p_us"), "point_id").alias("__p"), F.lit(None).cast(a.schema["__s"].dataType).alias("__s"))
    w = Window.partitionBy(*keys)
    # Of points at one time the one with the smallest id comes last before the time, first after it.
    before = w.orderBy("__t", "__turn", F.desc("__id")).rowsBetween(Window.unboundedPreceding, 0)
    after = w.orderBy(F.desc("__t"), F.desc("__turn"), F.desc("__id")).rowsBetween(Window.unboundedPreceding, 0)
    swept = a.unionByName(b).withColumns({"prev": F.last("__p", True).over(before), "next": F.last("__p", True).over(after)})
    return swept.where("__turn = 1").select(*keys, "__s.*", "prev", "next")


def nearest_or_inside(wins: DataFrame, points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """trade_id, point_id, inside: all points in a window, or the one nearest to the entry (then the earlier, then the smaller id) if there is none.

    points: keys, point_id, p_us.
    """
    spans = wins.select(*keys, "trade_id", "entry_us", "t0_us", "t1_us")
    hit = range_join(points, spans, keys, "p_us", F.col("t0_us"), F.col("t1_us"), width=600_000_000).select("trade_id", "point_id", F.lit(True).alias("inside"))
    without = spans.join(hit.select("trade_id").distinct(), "trade_id", "left_anti")
    near = _neighbours(without, points, keys, "entry_us").select("trade_id", F.explode(F.array("prev", "next")).alias("p"), "entry_us").where("p is not null")
    best = F.min(F.struct(F.abs(F.col("p.p_us") - F.col("entry_us")).alias("d"), "p.p_us", "p.point_id"))
    near = near.groupBy("trade_id").agg(best.alias("b")).select("trade_id", "b.point_id", F.lit(False).alias("inside"))
    return hit.unionByName(near)


def nearest_one(wins: DataFrame, points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """trade_id, point_id: one point for each trade, inside the window before outside, then nearest to the entry."""
    spans = wins.select(*keys, "trade_id", "entry_us", "t0_us", "t1_us")
    # A point in the window is next to the entry's nearest time in the window, if there is one.
    spans = spans.withColumn("held_us", F.greatest("t0_us", F.least("entry_us", "t1_us")))
    by_entry, by_held = (_neighbours(spans, points, keys, at) for at in ("entry_us", "held_us"))
    both = by_entry.unionByName(by_held.where("held_us <> entry_us"))
    j = both.select("trade_id", "entry_us", "t0_us", "t1_us", F.explode(F.array("prev", "next")).alias("p")).where("p is not null").select("trade_id", "entry_us", "t0_us", "t1_us", "p.*")
    outside = ~F.col("p_us").between(F.col("t0_us"), F.col("t1_us"))
    best = F.min(F.struct(outside.alias("o"), F.abs(F.col("p_us") - F.col("entry_us")).alias("d"), "p_us", "point_id"))
    return j.groupBy("trade_id").agg(best.alias("b")).select("trade_id", "b.point_id")


def plan_clips(entries: DataFrame) -> DataFrame:
    """entries (entry_us, duration_us) with c0_us and c1_us."""
    lo, hi = CLIP_US
    return entries.withColumns({"c0_us": F.greatest(F.col("entry_us") + lo, F.lit(0)), "c1_us": F.least(F.col("entry_us") + hi, F.col("duration_us"))})


def plan_frames(chapters: DataFrame) -> DataFrame:
    """session_id, t_us: frame times around chapters (session_id, t_us, duration_us), inside the recording, each once."""
    times = F.explode(F.array(*(F.col("t_us") + o for o in FRAME_OFFSETS_US))).alias("t")
    return chapters.select("session_id", "duration_us", times).where("t >= 0 and t <= duration_us").select("session_id", F.col("t").alias("t_us")).distinct()


def slice_parts(wins: DataFrame, parts: DataFrame, keys: Sequence[str], width: int = 600_000_000) -> DataFrame:
    """keys, trade_id, part, l0_us, l1_us: the part of [c0_us, c1_us] in each recording part (offset_us, dur_us), in its own time. Both sides are listed by time buckets, each pair is kept once."""
    def bucket(c: str) -> Column:
        return F.floor(F.col(c) / width)

    a = wins.select(*keys, "trade_id", "c0_us", "c1_us").where("c0_us < c1_us").withColumn("b", F.explode(F.sequence(bucket("c0_us"), bucket("c1_us"))))
    p = parts.where("dur_us > 0").select(*keys, "part", "offset_us", (F.col("offset_us") + F.col("dur_us")).alias("end_us")).withColumn("b", F.explode(F.sequence(bucket("offset_us"), bucket("end_us"))))
    lo, hi = F.greatest("c0_us", "offset_us"), F.least("c1_us", "end_us")
    met = a.join(p, [*keys, "b"]).where((lo < hi) & (F.col("b") == F.greatest(bucket("c0_us"), bucket("offset_us"))))
    return met.select(*keys, "trade_id", "part", (lo - F.col("offset_us")).alias("l0_us"), (hi - F.col("offset_us")).alias("l1_us"))


def part_at(times: DataFrame, parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, t_us, part, seek_us: the recording part of a time; before the first part its start, in a gap the end of the part before, after the last its end.

    parts: keys, part, offset_us, dur_us. The last part that starts at or before the time is found by one sorted sweep over both.
    """
    p = F.struct("offset_us", "part", "dur_us")
    listed = parts.select(*keys, F.col("offset_us").alias("t_us"), F.lit(0).alias("__turn"), p.alias("__p"))
    asked = times.select(*keys, "t_us").distinct().select(*keys, "t_us", F.lit(1).alias("__turn"), F.lit(None).cast(listed.schema["__p"].dataType).alias("__p"))
    w = Window.partitionBy(*keys)
    before = w.orderBy("t_us", "__turn", "__p").rowsBetween(Window.unboundedPreceding, 0)
    swept = listed.unionByName(asked).withColumns({"b": F.last("__p", True).over(before), "f": F.min("__p").over(w)})
    best = swept.where("__turn = 1 and f is not null").select(*keys, "t_us", "b", "f")
    b = F.coalesce("b", "f")
    seek = F.when(F.col("b").isNull(), 0).otherwise(F.least(F.col("t_us") - F.col("b.offset_us"), F.col("b.dur_us")))
    return best.select(*keys, "t_us", b["part"].alias("part"), seek.alias("seek_us"))


def markers_in(wins: DataFrame, chapters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """trade_id, name: chapters (keys, name, c_us) within a window, ends included."""
    hit = range_join(chapters, wins.select(*keys, "trade_id", "t0_us", "t1_us"), keys, "c_us", F.col("t0_us"), F.col("t1_us"), width=600_000_000)
    return hit.select("trade_id", "name")
