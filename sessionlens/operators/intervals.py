"""Joins and windows over time intervals.

Times are whole microseconds. Fills have fill_id and ts_us, clips have session_id, start_us
and end_us; ``keys`` are columns that both share (a user, an account). Every range join
gets a time bucket as a further equality, so that it stays a hash or sort-merge join and a
key with very many rows is spread over its buckets.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE = 60_000_000
HOUR = 60 * MINUTE
#: Padding around a session, nearness to a clip's ends, gap within a split recording, tested clock shifts.
PAD_US = 30 * MINUTE
NEAR_US = 10_000_000
SPLIT_GAP_US = 5_000_000
SHIFT_HOURS = (-6, -5, -4, -2, -1, 1, 2)
BUCKET_US = 6 * HOUR
#: Fixed value: characters of overlap lists in a batch.
OUT_CHARS = 4_000_000


def _bucket(t: Column, width: int | Column) -> Column:
    return F.floor(t / (width if isinstance(width, Column) else F.lit(width)))


def range_join(points: DataFrame, spans: DataFrame, keys: Sequence[str], point: str, low: Column, high: Column, how: str = "inner", half_open: bool = False, width: int = BUCKET_US) -> DataFrame:
    """points joined with the spans [low, high] (or [low, high)) that hold the point; keys come from points.

    A span is listed under each bucket of ``width`` that it touches, a point lies in one bucket: no pair is found twice.
    """
    names = [c for c in spans.columns if c not in keys]
    listed = spans.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), *names, low.alias("__lo"), high.alias("__hi")).where("__lo <= __hi")
    listed = listed.withColumn("__b", F.explode(F.sequence(_bucket(F.col("__lo"), width), _bucket(F.col("__hi"), width))))
    at = F.col(point)
    on = (_bucket(at, width) == F.col("__b")) & (at >= F.col("__lo")) & ((at < F.col("__hi")) if half_open else (at <= F.col("__hi")))
    for i, k in enumerate(keys):
        on = on & (points[k] == F.col(f"__k{i}"))
    drop = ["__lo", "__hi", "__b", *(f"__k{i}" for i in range(len(keys)))]
    return points.join(listed, on, how).drop(*drop)


def window_fills(fills: DataFrame, clips: DataFrame, keys: Sequence[str], pad_us: int = PAD_US) -> DataFrame:
    """fill_id, session_id: fills within a session's padded window, ends included; a fill may be in several."""
    hit = range_join(fills, clips.select(*keys, "session_id", "start_us", "end_us"), keys, "ts_us", F.col("start_us") - pad_us, F.col("end_us") + pad_us)
    return hit.select("fill_id", "session_id")


def assign_once(fills: DataFrame, clips: DataFrame, keys: Sequence[str], pad_us: int = PAD_US) -> DataFrame:
    """fill_id, session_id, in_core: at most one session for each fill.

    A clip that holds the fill (ends included) wins, earliest start first; else the padded window with the nearest clip, then the earliest start, then the id.
    """
    hit = range_join(fills, clips.select(*keys, "session_id", "start_us", "end_us"), keys, "ts_us", F.col("start_us") - pad_us, F.col("end_us") + pad_us)
    away = F.greatest(F.col("start_us") - F.col("ts_us"), F.col("ts_us") - F.col("end_us"), F.lit(0))
    best = F.min(F.struct(away.alias("away"), "start_us", "session_id"))
    return hit.groupBy("fill_id").agg(best.alias("b")).select("fill_id", "b.session_id", (F.col("b.away") == 0).alias("in_core"))


def day_ownership(fills: DataFrame, cores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """fill_id, day, owner, state: for each day, the fills of that day and those inside its cores.

    fills: fill_id, ts_us, day and keys; cores: session_id, start_us, end_us, day and keys. Cores are half-open; of
    several that hold a fill the earliest (start, id) owns it. state: 'assigned' on the owner's day, 'elsewhere' on other days, 'outside' without an owner.
    """
    spans = cores.where("start_us < end_us").select(*keys, "session_id", "start_us", "end_us", F.col("day").alias("core_day"))
    hit = range_join(fills.select(*keys, "fill_id", "ts_us", "day"), spans, keys, "ts_us", F.col("start_us"), F.col("end_us"), "left", half_open=True)
    best = F.min(F.when(F.col("session_id").isNotNull(), F.struct("start_us", "session_id", "core_day")))
    each = hit.groupBy("fill_id").agg(best.alias("b"), F.array_distinct(F.concat(F.collect_set("day"), F.collect_set("core_day"))).alias("days"))
    state = F.when(F.col("owner").isNull(), "outside").when(F.col("owner_day") == F.col("day"), "assigned").otherwise("elsewhere")
    rows = each.select("fill_id", F.col("b.session_id").alias("owner"), F.col("b.core_day").alias("owner_day"), F.explode("days").alias("day"))
    return rows.select("fill_id", "day", F.when(state == "assigned", F.col("owner")).alias("owner"), state.alias("state"))


def outside_reason(fills: DataFrame, cores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """fill_id, reason for fills (with day) that no core owns: against the cores of their day; 'after_last' looks at the end of the core that started last."""
    spans = cores.where("start_us < end_us")
    ends = spans.groupBy(*keys, "day").agg(F.min("start_us").alias("first_start"), F.max_by("end_us", F.struct("start_us", "session_id")).alias("last_end"))
    j = fills.join(ends, [*keys, "day"], "left")
    reason = F.when(F.col("first_start").isNull(), "no_core").when(F.col("ts_us") < F.col("first_start"), "before_first").when(F.col("ts_us") >= F.col("last_end"), "after_last").otherwise("gap")
    return j.select("fill_id", reason.alias("reason"))


def near_boundary(fills: DataFrame, cores: DataFrame, keys: Sequence[str], near_us: int = NEAR_US) -> DataFrame:
    """fill_id, session_id: fills within near_us of a start or end of a core."""
    spans = cores.select(*keys, "session_id", F.explode(F.array("start_us", "end_us")).alias("edge"))
    return range_join(fills, spans, keys, "ts_us", F.col("edge") - near_us, F.col("edge") + near_us).select("fill_id", "session_id").distinct()


def overlapping(cores: DataFrame, keys: Sequence[str], width: int = 2 * BUCKET_US) -> DataFrame:
    """session_id, others: ids of the cores that overlap a core, sorted. One core for each session_id.

    Cores are classed by length, see meeting_places: pairs are neither shuffled nor sorted. A bucket's cores (not its pairs) are in one
    task's memory; they are a few times as many as the longest result lists. A bucket's rows are given out by start, so that
    neighbours have nearly the same list (which a codec with a window of several lists uses).
    """
    known = cores.where(" and ".join(["start_us < end_us", *(f"`{k}` is not null" for k in ("session_id", *keys))]))
    most = OUT_CHARS

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cores of a bucket (``mine``) among those that reach it, given out in small batches."""
        rows = pa.Table.from_batches(list(batches)).select(["session_id", "start_us", "end_us", "mine"])
        rows = rows.group_by(rows.column_names).aggregate([]).sort_by("session_id")
        ids, chars = rows["session_id"].to_numpy(), pc.utf8_length(rows["session_id"]).to_numpy()
        start, end = rows["start_us"].to_numpy(), rows["end_us"].to_numpy()
        own = np.flatnonzero(rows["mine"].to_numpy())
        own = own[np.lexsort((end[own], start[own]))]
        found, size, span = ([], []), 0, None
        for i in own:
            if (start[i], end[i]) != span:
                # Cores of the same span have the same list but for their own ids, which are cut out.
                span = start[i], end[i]
                hit = np.flatnonzero((start < end[i]) & (end > start[i]))
                text, after = ",".join(ids[hit]), np.cumsum(chars[hit] + 1)
            if len(hit) > 1:
                past = int(after[np.searchsorted(hit, i)])
                before = past - int(chars[i]) - 1
                found[0].append(ids[i])
                found[1].append(text[:before] + text[past:] if past < len(text) else text[: before - 1])
                size += len(text)
            if size > most:
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()) for f in found], ["session_id", "others"])
                found, size = ([], []), 0
        yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()) for f in found], ["session_id", "others"])

    listed = meeting_places(known.select(*keys, "session_id", "start_us", "end_us"), width)
    # By number, so adaptive execution doesn't merge the partitions: their few rows give long lists.
    dealt = listed.repartition(int(cores.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "c", "b")
    return dealt.groupBy(*keys, "c", "b").applyInArrow(meet, "session_id string, others string")


def meeting_places(spans: DataFrame, width: int) -> DataFrame:
    """spans with c (a class of lengths), b (its bucket) and mine: a row for each bucket of any span that may overlap this one, and its own (``mine``).

    Class c holds spans of up to c: width, 4 * width, 16 * width, ...; only classes that occur are listed. A span lies in one bucket of
    its class, that of its start. Buckets are 2 * c wide, so a span that is short for a class has one or two rows there.
    """
    length = F.col("end_us") - F.col("start_us")
    # The last is over 2^60, beyond the difference of any two timestamps.
    limits = [width << n for n in range(0, 63 - width.bit_length(), 2)]
    sized = spans.withColumn("__c", F.coalesce(*(F.when(length <= w, F.lit(w).cast("long")) for w in limits)))
    listed = sized.withColumn("c", F.explode(sized.agg(F.collect_set("__c")).scalar()))
    listed = listed.withColumn("b", F.explode(F.sequence(_bucket(F.col("start_us") - F.col("c"), 2 * F.col("c")), _bucket(F.col("end_us"), 2 * F.col("c")))))
    mine = (F.col("__c") == F.col("c")) & (_bucket(F.col("start_us"), 2 * F.col("c")) == F.col("b"))
    return listed.select(*spans.columns, "c", "b", mine.alias("mine"))


def neighbour_sessions(clips: DataFrame, day_us: int = 24 * HOUR) -> DataFrame:
    """day_no, session_id: sessions that reach into a day before or after the one they start on (days counted from the epoch)."""
    first, last = F.floor(F.col("start_us") / day_us), F.floor((F.col("end_us") - 1) / day_us)
    days = clips.select("session_id", first.alias("own"), F.explode(F.sequence(first, F.greatest(first, last))).alias("day_no"))
    return days.where("day_no <> own").select("day_no", "session_id")


def window_hits(fills: DataFrame, clips: DataFrame, keys: Sequence[str], pad_us: int = PAD_US) -> DataFrame:
    """in_one, in_many, outside_all: fills by the number of padded windows that hold them."""
    n = _hits(fills, clips, keys, pad_us, ["fill_id"])
    return n.agg(*_hit_counts())


def shifted_hits(fills: DataFrame, clips: DataFrame, keys: Sequence[str], hours: Sequence[int] = SHIFT_HOURS, pad_us: int = PAD_US) -> DataFrame:
    """window_hits for each shift of the fills' clock."""
    shifted = fills.withColumn("delta_hours", F.explode(F.array(*(F.lit(h) for h in hours)))).withColumn("ts_us", F.col("ts_us") + F.col("delta_hours") * HOUR)
    return _hits(shifted, clips, keys, pad_us, ["delta_hours", "fill_id"]).groupBy("delta_hours").agg(*_hit_counts())


def _hits(fills: DataFrame, clips: DataFrame, keys: Sequence[str], pad_us: int, by: list[str]) -> DataFrame:
    hit = range_join(fills, clips.select(*keys, "session_id", "start_us", "end_us"), keys, "ts_us", F.col("start_us") - pad_us, F.col("end_us") + pad_us, "left")
    return hit.groupBy(*by).agg(F.count("session_id").alias("n"))


def _hit_counts() -> list[Column]:
    return [F.count_if(F.col("n") == 1).alias("in_one"), F.count_if(F.col("n") > 1).alias("in_many"), F.count_if(F.col("n") == 0).alias("outside_all")]


def session_audit(fills: DataFrame, clips: DataFrame, keys: Sequence[str], pad_us: int = PAD_US) -> DataFrame:
    """session_id, n_in, n_outside, instruments: fills of a session's keys within and without its padded window."""
    totals = fills.groupBy(*keys).agg(F.count("*").alias("n_all"))
    hit = range_join(fills, clips.select(*keys, "session_id", "start_us", "end_us"), keys, "ts_us", F.col("start_us") - pad_us, F.col("end_us") + pad_us)
    inside = hit.groupBy("session_id").agg(F.count("*").alias("n_in"), F.array_join(F.array_sort(F.collect_set("instrument")), ",").alias("instruments"))
    j = clips.select(*keys, "session_id").join(totals, list(keys), "left").join(inside, "session_id", "left")
    n_in = F.coalesce("n_in", F.lit(0))
    return j.select("session_id", n_in.alias("n_in"), (F.coalesce("n_all", F.lit(0)) - n_in).alias("n_outside"), F.coalesce("instruments", F.lit("")).alias("instruments"))


def union_length(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n_spans, union_us: total length of the union of [start_us, end_us]; touching spans merge."""
    order = Window.partitionBy(*keys).orderBy("start_us", "end_us")
    before = F.max("end_us").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # What a span adds beyond everything that started before it.
    fresh = F.greatest(F.lit(0), F.col("end_us") - F.greatest(F.col("start_us"), F.coalesce(before, F.col("start_us"))))
    return spans.withColumn("fresh", fresh).groupBy(*keys).agg(F.count("*").alias("n_spans"), F.sum("fresh").alias("union_us"))


def trading_hours(owned: DataFrame, cores: DataFrame, trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, day, hours_us, trade_count, span_zero, outside, reason.

    owned: keys, day, fill_id, owner (null outside), ts_us; cores: keys, day, session_id; trades: keys, day, entry_fill_id.
    A core's span is from its first to its last fill, with two fills at least; hours are the union of a day's spans.
    """
    by = [*keys, "day"]
    spans = owned.where("owner is not null").groupBy(*by, "owner").agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"), F.count("*").alias("n"))
    hours = union_length(spans.where("n >= 2"), by).select(*by, F.col("union_us").alias("hours_us"))
    span = spans.select("owner", *by, (F.col("end_us") - F.col("start_us")).alias("span_us"))
    placed = trades.join(owned.select(F.col("fill_id").alias("entry_fill_id"), "owner"), "entry_fill_id").join(span, [*by, "owner"], "left")
    kinds = placed.groupBy(*by).agg(
        F.count_if(F.col("owner").isNull()).alias("outside"), F.count_if(F.col("owner").isNotNull() & (F.coalesce("span_us", F.lit(0)) <= 0)).alias("span_zero"),
        F.count_if(F.col("span_us") > 0).alias("trade_count"),
    )
    entitled = cores.where("start_us < end_us").groupBy(*by).agg(F.count("*").alias("n_cores"))
    j = kinds.join(hours, by, "left").join(entitled, by, "left")
    hours_us, n_cores = F.coalesce("hours_us", F.lit(0)), F.coalesce("n_cores", F.lit(0))
    reason = (
        F.when(n_cores <= 0, "paused").when(hours_us <= 0, "span_undefined").when(F.col("span_zero") > 0, "span_zero_excluded").when(F.col("outside") > 0, "outside_clips")
    )
    return j.select(*by, hours_us.alias("hours_us"), "trade_count", "span_zero", "outside", reason.alias("reason"))


def next_by_time(rows: DataFrame, keys: Sequence[str], after: str, entry: str, tie: str, carry: Sequence[str]) -> DataFrame:
    """For each row the first row of its keys, by (entry, tie), with entry >= its own ``after``, itself excluded; columns next_*.

    A sweep instead of a join: entries and exits are put into one order and each exit looks ahead to the next two
    entries (one of which may be its own).
    """
    cols = [entry, tie, *carry]
    starts = rows.select(*keys, F.col(entry).alias("__t"), F.lit(1).alias("__k"), F.col(tie).alias("__i"), F.struct(*cols).alias("__n"), F.lit(None).cast(rows.schema[tie].dataType).alias("__own"))
    none = F.lit(None).cast(starts.schema["__n"].dataType)
    ends = rows.where(F.col(after).isNotNull()).select(*keys, F.col(after).alias("__t"), F.lit(0).alias("__k"), F.lit(None).cast(rows.schema[tie].dataType).alias("__i"), none.alias("__n"), F.col(tie).alias("__own"))
    line = starts.unionByName(ends)
    # In the reversed order what is ahead comes before: such a frame grows row by row, one to the end is read anew for each row.
    ahead = Window.partitionBy(*keys).orderBy(F.desc("__t"), F.desc("__k"), F.desc("__i")).rowsBetween(Window.unboundedPreceding, -1)
    # The second next entry, kept with each entry.
    line = line.withColumn("__n1", F.last("__n", True).over(ahead))
    line = line.withColumn("__e", F.when(F.col("__k") == 1, F.struct(F.col("__n").alias("a"), F.col("__n1").alias("b"))))
    line = line.withColumn("__next", F.last("__e", True).over(ahead))
    picked = F.when(F.col(f"__next.a.{tie}") == F.col("__own"), F.col("__next.b")).otherwise(F.col("__next.a"))
    found = line.where("__k = 0").select(*(F.col(k).alias(f"__j{i}") for i, k in enumerate(keys)), F.col("__own").alias("__id"), picked.alias("__p"))
    on = F.col(tie) == F.col("__id")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__j{i}"))
    out = rows.join(found, on, "left")
    return out.select(*rows.columns, *(F.col(f"__p.{c}").alias(f"next_{c}") for c in cols))


def split_chains(recordings: DataFrame, prefix: str = "prefix", gap_us: int = SPLIT_GAP_US) -> DataFrame:
    """Adds chain (first recording's id), part (from 1), offset_us (durations before it) and gap_us (to the one before, in the chain or not).

    A recording continues the previous one of its prefix if it starts within gap_us of that one's end.
    """
    order = Window.partitionBy(prefix).orderBy("start_us", "rec_id")
    gap = F.col("start_us") - F.lag("start_us").over(order) - F.lag("dur_us").over(order)
    marked = recordings.withColumn("gap_us", gap).withColumn("__new", F.when(F.abs(F.col("gap_us")) <= gap_us, 0).otherwise(1))
    marked = marked.withColumn("__chain", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(prefix, "__chain").orderBy("start_us", "rec_id")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    return marked.withColumns({
        "chain": F.first("rec_id").over(inside), "part": F.row_number().over(inside), "offset_us": F.coalesce(F.sum("dur_us").over(before), F.lit(0)),
    }).drop("__new", "__chain")


def chain_gaps(chained: DataFrame) -> DataFrame:
    """chain, n_parts, worst_gap_us: the gap of largest size inside each chain (null for single recordings)."""
    return chained.groupBy("chain").agg(
        F.count("*").alias("n_parts"), F.max_by("gap_us", F.when(F.col("part") > 1, F.struct(F.abs("gap_us"), F.col("gap_us")))).alias("worst_gap_us")
    )
