"""Guards over what a reader of screens or speech states: notes and fields without support are named with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import check_citations, digit_runs


def _first_unknown(notes: DataFrame, items: Column, known: DataFrame, name: str) -> DataFrame:
    """n_id and, as ``name``, the first item of each note that its session's known items (session_id, item) lack."""
    each = notes.select(F.col("note_id").alias("n_id"), "session_id", F.posexplode(items).alias("at", "item")).where("item is not null")
    bad = each.join(known.select("session_id", "item").distinct(), ["session_id", "item"], "left_anti")
    return bad.groupBy("n_id").agg(F.min_by("item", "at").alias(name))


def note_problems(notes: DataFrame, runs: DataFrame, frames: DataFrame, clips: DataFrame) -> DataFrame:
    """note_id, reason, item of the notes to drop; of several reasons the first: an empty text, a number on no screen, a frame or a clip that isn't saved.

    notes: note_id (unique), session_id, text, frames (array), clip; runs, frames, clips: session_id, item.
    """
    n = notes.select("note_id", "session_id", "text", "frames", "clip")
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    clip = F.when(F.col("clip") != "", F.array("clip"))
    found = n.select("note_id", blank.alias("blank"))
    for items, known, name in ((digit_runs(F.col("text")), runs, "number"), (F.col("frames"), frames, "frame"), (clip, clips, "clip")):
        found = found.join(_first_unknown(n, items, known, name), F.col("note_id") == F.col("n_id"), "left").drop("n_id")
    reason = F.when(F.col("blank"), "empty").when(F.col("number").isNotNull(), "number").when(F.col("frame").isNotNull(), "frame").when(F.col("clip").isNotNull(), "clip")
    return found.select("note_id", reason.alias("reason"), F.when(~F.col("blank"), F.coalesce("number", "frame", "clip")).alias("item")).where("reason is not null")


def guard_stated(stated: DataFrame, segments: DataFrame, commentary: DataFrame, normalise: bool = True) -> DataFrame:
    """session_id, trade_id, field, value, reason: a stated value is null where its segment doesn't exist or lacks it; one cited from outside the trade's window keeps its value.

    stated: session_id, trade_id, field, seg, value (an empty one is never found); segments: session_id, seg, text; commentary: session_id, trade_id, seg.
    """
    spans = stated.select("session_id", "trade_id", "field", "seg", "value", F.col("value").alias("quote"), F.lit(None).cast("string").alias("token"))
    checked = check_citations(spans, segments, normalise)
    there = segments.select("session_id", "seg", F.lit(True).alias("there")).distinct()
    near = commentary.select("session_id", "trade_id", "seg", F.lit(True).alias("near")).distinct()
    j = checked.join(there, ["session_id", "seg"], "left").join(near, ["session_id", "trade_id", "seg"], "left")
    held = F.col("ok") & (F.coalesce("value", F.lit("")) != "")
    reason = F.when(F.col("there").isNull(), "no_segment").when(~held, "not_found").when(F.col("near").isNull(), "outside_window")
    return j.select("session_id", "trade_id", "field", F.when(held, F.col("value")).alias("value"), reason.alias("reason"))
