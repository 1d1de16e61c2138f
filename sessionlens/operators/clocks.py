"""Clock alignment: robust fits, confidence, pause checks and recorder sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import robust

#: Agreement, confirmation and detection limits (seconds) of clocks with seconds and with minutes alone.
PAUSE_LIMITS = {1: (5, 30, 30), 60: (60, 120, 180)}
RESUME_US = (400_000, 800_000)
NEIGHBOUR_US = 2_000_000


def theil_sen(points: DataFrame, keys: Sequence[str], x: str = "x_us", y: str = "y") -> DataFrame:
    """keys, n, slope, intercept: median of the pairwise slopes, median intercept; slope 0 with one sample or equal x.

    Pairs of large groups are counted, not listed; small groups are fitted many at once (robust).
    """
    return robust.fit_by_key(points, keys, x, y)


def residual_score(residuals: DataFrame, keys: Sequence[str], r: str = "r") -> DataFrame:
    """keys, n, confidence: from the number of residuals (seconds), their median and the median distance from it."""
    centre = residuals.groupBy(*keys).agg(F.percentile(r, 0.5).alias("centre"))
    away = residuals.join(centre, list(keys)).groupBy(*keys).agg(F.count("*").alias("n"), F.max("centre").alias("centre"), F.percentile(F.abs(F.col(r) - F.col("centre")), 0.5).alias("mad"))
    score = F.least(F.lit(1.0), F.col("n") / 10) * F.greatest(F.lit(0.0), 1 - F.greatest("mad", F.abs("centre")) / 2)
    capped = F.least(score, F.when(F.col("n") == 1, 0.35).when(F.col("n") < 3, 0.5).otherwise(1.0))
    return away.select(*keys, "n", F.bround(capped, 4).alias("confidence"))


def to_wall(start_us: Column, video_us: Column, offset_us: Column, drift: Column) -> Column:
    """Wall time of a video time; drift is in seconds for each hour of video."""
    return start_us + offset_us + F.round(video_us * (1 + drift / 3600)).cast("long")


def to_video(start_us: Column, wall_us: Column, offset_us: Column, drift: Column) -> Column:
    """Video time of a wall time: the inverse of to_wall, to the microsecond. A drift that stands still (-3600) counts as none."""
    rate = 1 + drift / 3600
    return F.round((wall_us - start_us - offset_us) / F.when(F.abs(rate) < 1e-12, 1.0).otherwise(rate)).cast("long")


def choose_alignment(candidates: DataFrame) -> DataFrame:
    """session_id, method, offset_us, confidence: manual before recorder before readings before the file's name."""
    rank = F.when(F.col("method") == "manual", 0).when(F.col("method") == "sidecar", 1).when(F.col("method") == "ocr", 2).when(F.col("method") == "filename", 3).otherwise(9)
    best = F.min_by(F.struct("method", "offset_us", "confidence"), F.struct(rank, F.col("offset_us")))
    return candidates.groupBy("session_id").agg(best.alias("b")).select("session_id", "b.*")


def confirm_samples(samples: DataFrame, keys: Sequence[str], agree: int, near: int) -> DataFrame:
    """samples with confirmed: another sample within ``near`` of x agrees within ``agree`` of y. Buckets of x keep the join an equality."""
    a = samples.withColumn("__b", F.explode(F.array(*(F.floor(F.col("x_us") / near) + i for i in (-1, 0, 1)))))
    b = samples.select(*keys, F.col("event_id").alias("o_id"), F.col("x_us").alias("o_x"), F.col("y").alias("o_y"), F.floor(F.col("x_us") / near).alias("__b"))
    ok = (F.col("event_id") != F.col("o_id")) & (F.abs(F.col("x_us") - F.col("o_x")) <= near) & (F.abs(F.col("y") - F.col("o_y")) <= agree)
    good = a.join(b, [*keys, "__b"]).where(ok).select("event_id").distinct().withColumn("confirmed", F.lit(True))
    return samples.join(good, "event_id", "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(False)))


def pause_verdict(samples: DataFrame, keys: Sequence[str], resolution: int = 1) -> DataFrame:
    """keys, n, total, verdict: steps down by more than the agreement, or fewer than two samples, can't be verified; a total rise beyond the confirmation limit is suspected. y in seconds."""
    agree, confirm, _ = PAUSE_LIMITS[resolution]
    step = F.col("y") - F.lag("y").over(Window.partitionBy(*keys).orderBy("x_us", "event_id"))
    order = F.struct("x_us", "event_id")
    seen = samples.withColumn("__step", step).groupBy(*keys).agg(F.count("*").alias("n"), (F.max_by("y", order) - F.min_by("y", order)).alias("total"), F.coalesce(F.bool_or(F.col("__step") < -agree), F.lit(False)).alias("down"))
    verdict = F.when((F.col("n") < 2) | F.col("down"), "unverifiable").when(F.col("total") > confirm, "suspected").otherwise("clear")
    return seen.select(*keys, "n", F.when(F.col("n") >= 2, F.col("total")).alias("total"), verdict.alias("verdict"))


def sections(events: DataFrame, key: str = "session_id") -> DataFrame:
    """key, idx, status, wall_start_us, wall_end_us, video_start_us, video_end_us, resume_offset_us.

    A section runs from a start or resume to the next pause or stop. A resume whose offset to its pause's video time is out of the band
    makes its section and all later ones invalid; a resumed section starts at the pause's video time.
    """
    w = Window.partitionBy(key).orderBy("wall_us", "row_no")
    nxt = events.withColumns({
        "prev_video": F.lag("video_us").over(w), "prev_event": F.lag("event").over(w),
        "end_event": F.lead("event").over(w), "end_wall": F.lead("wall_us").over(w), "end_video": F.lead("video_us").over(w),
    })
    begun = nxt.where("event in ('record_start', 'resume')")
    offset = F.when(F.col("event") == "resume", F.col("video_us") - F.col("prev_video"))
    bad = F.coalesce(~offset.between(*RESUME_US), F.lit(False))
    idx = F.row_number().over(w).cast("long")
    out = begun.withColumns({"resume_offset_us": offset, "idx": idx, "__bad": F.max(bad.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return out.where("end_event in ('pause', 'record_stop')").select(
        key, "idx", F.when(F.col("__bad") == 1, "segment_invalid").otherwise("verified").alias("status"), F.col("wall_us").alias("wall_start_us"), F.col("end_wall").alias("wall_end_us"),
        F.when(F.col("event") == "resume", F.col("prev_video")).otherwise(F.col("video_us")).alias("video_start_us"), F.col("end_video").alias("video_end_us"), "resume_offset_us",
    )


def pause_total(events: DataFrame, key: str = "session_id") -> DataFrame:
    """key, pauses, paused_us: sum of resume minus pause; null if a pause has no resume."""
    w = Window.partitionBy(key).orderBy("wall_us", "row_no")
    p = events.withColumns({"__n": F.lead("event").over(w), "__w": F.lead("wall_us").over(w)}).where("event = 'pause'")
    gap = F.when(F.col("__n") == "resume", F.col("__w") - F.col("wall_us"))
    return p.groupBy(key).agg(F.count("*").alias("pauses"), F.when(F.count(gap) == F.count("*"), F.sum(gap)).alias("paused_us"))


def position_fills(fills: DataFrame, sections_: DataFrame, keys: Sequence[str], offsets: DataFrame | None = None) -> DataFrame:
    """fill_id, idx, video_us, reason: the section that holds a fill; in an invalid one, or in none, there is no position.

    Sections are half-open, but the last one of a session holds its end. Time in a section that begins the recording runs from the
    record's start less the first frame's offset (offsets: keys, offset_us; none: zero), in a resumed one from the pause's video time.
    A sweep: each fill takes the last section begun by then, one shuffle and sort by keys.
    """
    w = Window.partitionBy(*keys)
    carried = F.struct("idx", "status", "wall_start_us", "wall_end_us", "video_start_us", F.col("resume_offset_us").isNull().alias("starts"), (F.col("idx") == F.max("idx").over(w)).alias("last"))
    begun = sections_.select(*keys, F.col("wall_start_us").alias("__t"), F.lit(0).alias("__k"), "idx", carried.alias("s"))
    none = F.lit(None).cast(begun.schema["s"].dataType)
    asked = fills.select(*keys, F.col("ts_us").alias("__t"), F.lit(1).alias("__k"), F.lit(None).cast("long").alias("idx"), none.alias("s"), "fill_id")
    line = begun.withColumn("fill_id", F.lit(None).cast(fills.schema["fill_id"].dataType)).unionByName(asked)
    order = w.orderBy("__t", "__k", "idx").rowsBetween(Window.unboundedPreceding, 0)
    met = line.withColumn("s", F.last("s", True).over(order)).where("__k = 1")
    if offsets is None:
        met = met.withColumn("offset_us", F.lit(0))
    else:
        met = met.join(offsets.select(*keys, "offset_us"), list(keys), "left").withColumn("offset_us", F.coalesce("offset_us", F.lit(0)))
    inside = F.coalesce((F.col("__t") < F.col("s.wall_end_us")) | (F.col("s.last") & (F.col("__t") == F.col("s.wall_end_us"))), F.lit(False))
    past = F.col("__t") - F.col("s.wall_start_us")
    at = F.when(F.col("s.starts"), past - F.col("offset_us")).otherwise(F.col("s.video_start_us") + past)
    reason = F.when(~inside, "outside_sections").when(F.col("s.status") != "verified", "segment_invalid")
    return met.select("fill_id", F.when(inside, F.col("s.idx")).alias("idx"), F.when(reason.isNull(), at).alias("video_us"), reason.alias("reason"))


#: Bands of the first-frame offset, tolerance of durations, largest residual (all microseconds).
LOW_BAND, HIGH_BAND, DURATION_TOLERANCE, MAX_RESIDUAL = (200_000, 450_000), (800_000, 1_300_000), 100_000, 100_000


def first_frame(files: DataFrame, key: str = "session_id") -> DataFrame:
    """key, offset_us, band, status. files: start_us, stop_us, paused_us (null: a pause without resume), duration_us.

    The offset is what wall time exceeds pauses and recording by; 'low' and 'high' are the bands that recorders show.
    """
    offset = F.col("stop_us") - F.col("start_us") - F.col("paused_us") - F.col("duration_us")
    band = F.when(offset.between(*LOW_BAND), "low").when(offset.between(*HIGH_BAND), "high")
    status = (
        F.when(F.col("start_us").isNull() | F.col("stop_us").isNull(), "incomplete").when(F.col("paused_us").isNull(), "pause_open").when(F.col("duration_us").isNull(), "no_duration")
        .when(band.isNull(), "out_of_band").otherwise("verified")
    )
    return files.select(key, offset.alias("offset_us"), band.alias("band"), status.alias("status"))
