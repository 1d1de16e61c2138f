"""Manifest rows of clips, fact tables of debriefs, and review packs of several weeks: facts put together for a reader."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ledger import trailing_weeks
from .text import digit_runs


def manifest_rows(clips: DataFrame, checks: DataFrame, gaps: DataFrame, guard_on: bool = True, tolerance: float = 1e-6) -> DataFrame:
    """One row for each clip: its alignment, its pause check, the worst gap between its parts; problem where the check isn't of this recording.

    clips: session_id, filename, path, start_us, duration_s, sha, parts, alignment (struct method, offset_s, drift_s_per_h, confidence; or null); checks:
    session_id, sha, parts, duration_s, pause_check, pause_total_s, clock_resolution_s, pause_detectable_from_s, fit_before (struct as alignment); gaps:
    session_id, gap_s. A check counts if it was made on the very recording; the fit that it found before goes first. Several such checks: the one of the
    smallest (pause_check, total). Without the guard no check is read.
    """
    seen = checks.select(F.col("session_id").alias("k_id"), F.col("sha").alias("k_sha"), F.col("parts").alias("k_parts"), F.col("duration_s").alias("k_dur"), F.struct("pause_check", "pause_total_s", "clock_resolution_s", "pause_detectable_from_s", "fit_before").alias("k"))
    same = (F.col("session_id") == F.col("k_id")) & (F.col("sha") == F.col("k_sha")) & F.col("parts").eqNullSafe(F.col("k_parts")) & (F.abs(F.col("duration_s") - F.col("k_dur")) <= tolerance) & F.lit(guard_on)
    one = clips.select("session_id", "sha", "parts", "duration_s").join(seen, same).groupBy(F.col("session_id").alias("o_id")).agg(F.min("k").alias("k"))
    worst = gaps.groupBy(F.col("session_id").alias("g_id")).agg(F.max_by("gap_s", F.struct(F.abs("gap_s"), F.col("gap_s"))).alias("stitched_gap_s"))
    met = clips.join(one, F.col("session_id") == F.col("o_id"), "left").join(worst, F.col("session_id") == F.col("g_id"), "left")
    fit = F.coalesce("k.fit_before", "alignment")
    name = F.coalesce(F.nullif("filename", F.lit("")), F.regexp_extract("path", r"([^/\\]*)$", 1))
    return met.select(
        "session_id", name.alias("filename"), "start_us", (F.col("start_us") + F.round(F.col("duration_s") * 1_000_000).cast("long")).alias("end_us"), "duration_s", "stitched_gap_s",
        fit["method"].alias("alignment_method"), fit["confidence"].alias("alignment_confidence"), fit["offset_s"].alias("alignment_offset_s"), fit["drift_s_per_h"].alias("alignment_drift_s_per_h"),
        (F.col("k.pause_check") if guard_on else F.lit("guard_off")).alias("pause_check"), "k.pause_total_s", "k.clock_resolution_s", "k.pause_detectable_from_s", F.lit("unchanged").alias("cascade"),
        F.when(F.lit(guard_on) & F.col("k").isNull(), "no pause check of this recording").alias("problem"),
    )


def _kept(lines: DataFrame, allowed: DataFrame) -> DataFrame:
    """Lines all of whose runs of digits are allowed in their session. The runs of a session are one array: what its facts hold."""
    known = allowed.groupBy(F.col("session_id").alias("a_id")).agg(F.collect_set("run").alias("runs"))
    met = lines.join(known, F.col("session_id") == F.col("a_id"), "left")
    unknown = F.array_except(digit_runs(F.col("line")), F.coalesce("runs", F.array().cast("array<string>")))
    return met.where(F.size(unknown) == 0).drop("a_id", "runs")


def cell(value: Column) -> Column:
    """A value as a table's cell: nothing for null and NaN, whole numbers without a fraction."""
    return F.coalesce(F.regexp_replace(F.nullif(value.cast("string"), F.lit("NaN")), r"\.0$", ""), F.lit(""))


def debrief_lines(sessions: DataFrame, trades: DataFrame, clips: DataFrame, rules: DataFrame, gaps: DataFrame, allowed: DataFrame) -> DataFrame:
    """session_id, part (source, trades, rules, gaps), no, line: the fact tables of each session's debrief.

    sessions: session_id, language; trades: session_id, tva_trade_id, trade_id, direction, instrument, entry_price, exit_price, net_pnl_currency,
    gross_pnl_currency; clips: session_id, tva_trade_id (those that have one); rules: session_id, rule, status, label; gaps: session_id, no, gap; allowed: session_id, run.
    A line with a run of digits that the session's facts don't hold is left out. A part without lines says so.
    """
    own = F.coalesce(F.nullif("tva_trade_id", F.lit("")), "trade_id", F.lit(""))
    c = clips.select(F.col("session_id").alias("c_id"), F.col("tva_trade_id").alias("c_trade")).distinct()
    t = trades.withColumn("own", own).join(c, (F.col("session_id") == F.col("c_id")) & (F.col("own") == F.col("c_trade")), "left")
    pnl = F.coalesce(F.nanvl("net_pnl_currency", F.lit(None)), F.nanvl("gross_pnl_currency", F.lit(None)))
    cells = [F.col("own"), cell(F.col("direction")), cell(F.col("instrument")), cell(F.col("entry_price")), cell(F.col("exit_price")), cell(pnl), F.when(F.col("c_id").isNotNull(), "clip").otherwise("")]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    trade_lines = t.select("session_id", F.lit("trades").alias("part"), F.col("own").alias("order"), line.alias("line"))
    rule_lines = rules.where("rule <> ''").select("session_id", F.lit("rules").alias("part"), F.col("rule").alias("order"), F.concat(F.lit("- "), F.coalesce("label", "rule"), F.lit(": "), F.coalesce("status", F.lit(""))).alias("line"))
    gap_lines = gaps.where("trim(gap) <> ''").select("session_id", F.lit("gaps").alias("part"), F.format_string("%010d", "no").alias("order"), F.concat(F.lit("- "), F.trim("gap")).alias("line"))
    source = sessions.select("session_id", F.lit("source").alias("part"), F.explode(F.array(
        F.struct(F.lit("1").alias("order"), F.concat(F.lit("Session "), "session_id", F.lit(".")).alias("line")), F.struct(F.lit("2").alias("order"), F.concat(F.lit("Language "), "language", F.lit(".")).alias("line")),
    )).alias("s")).select("session_id", "part", "s.*")
    kept = _kept(source.unionByName(trade_lines).unionByName(rule_lines).unionByName(gap_lines), allowed)
    # What a part says where it has no lines; trades and rules that were all left out are still there.
    had = lambda df, name: df.select(F.col("session_id").alias(f"{name}_id")).distinct()
    some = sessions.select("session_id").join(had(trades, "t"), F.col("session_id") == F.col("t_id"), "left").join(had(rules, "r"), F.col("session_id") == F.col("r_id"), "left")
    blank = some.select("session_id", F.explode(F.array(
        F.struct(F.lit("source").alias("part"), F.lit("9").alias("order"), F.when(F.col("t_id").isNull(), "No trades file.").otherwise("Trades file present.").alias("line"), F.lit(True).alias("always")),
        F.struct(F.lit("trades").alias("part"), F.lit("").alias("order"), F.when(F.col("t_id").isNull(), "No trades.").otherwise("| Trade | Side | Instrument | Entry | Exit | PnL | Clip |").alias("line"), F.lit(True).alias("always")),
        F.struct(F.lit("rules").alias("part"), F.lit("").alias("order"), F.when(F.col("r_id").isNull(), "No rules file.").otherwise("Rules recorded.").alias("line"), F.lit(False).alias("always")),
        F.struct(F.lit("gaps").alias("part"), F.lit("").alias("order"), F.lit("None.").alias("line"), F.lit(False).alias("always")),
    )).alias("b")).select("session_id", "b.*")
    filled = kept.select(F.col("session_id").alias("f_id"), F.col("part").alias("f_part")).distinct()
    said = blank.join(filled, (F.col("session_id") == F.col("f_id")) & (F.col("part") == F.col("f_part")), "left").where("always or f_id is null").select("session_id", "part", "order", "line")
    from pyspark.sql import Window

    every = kept.select("session_id", "part", "order", "line").unionByName(said)
    return every.select("session_id", "part", F.row_number().over(Window.partitionBy("session_id", "part").orderBy("order", "line")).alias("no"), "line")


def review_pack(sessions: DataFrame, trades: DataFrame, rules: DataFrame, debriefs: DataFrame, experiments: DataFrame, weeks: int, least: int, today: str) -> tuple[DataFrame, DataFrame]:
    """Facts (kind, id, session_id, text) of the last weeks, and the runs of digits (run) that a review of them may use.

    sessions: session_id, session_date; trades and rules as the ledger has them; debriefs: session_id, text; experiments: id, rule_change, start, stop_criterion,
    status, created_at. Debriefs are those of the last ``weeks`` sessions that have one; of experiments the newest running one, else the newest.
    """
    within = trailing_weeks(sessions, weeks).select("session_id", "session_date")
    ids = within.select(F.col("session_id").alias("w_id"))

    def inside(df: DataFrame) -> DataFrame:
        return df.join(ids, F.col("session_id") == F.col("w_id"), "left_semi")

    def text(*columns: str) -> Column:
        return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).alias("text")

    own = within.select(F.lit("session").alias("kind"), F.col("session_id").alias("id"), "session_id", F.lit("").alias("text"))
    traded = inside(trades).select(F.lit("trade").alias("kind"), F.concat_ws(":", "session_id", "tva_trade_id").alias("id"), "session_id", text("stated_setup", "stated_playbook", "lab_token", "tag_alignment", "stated_lab_agree"))
    ruled = inside(rules).select(F.lit("rule").alias("kind"), F.concat_ws(":", "session_id", "rule").alias("id"), "session_id", text("status", "reason"))
    last = inside(debriefs).join(within.select(F.col("session_id").alias("d_id"), "session_date"), F.col("session_id") == F.col("d_id")).orderBy(F.col("session_date").desc(), F.col("session_id").desc()).limit(weeks)
    told = last.select(F.lit("debrief").alias("kind"), F.col("session_id").alias("id"), "session_id", "text")
    running = experiments.orderBy((F.col("status") == "running").desc_nulls_last(), F.col("created_at").desc_nulls_last(), "id").limit(1)
    held = running.select(F.lit("experiment").alias("kind"), "id", F.lit(None).cast("string").alias("session_id"), text("rule_change", "start", "stop_criterion", "status"))
    facts = own.unionByName(traded).unionByName(ruled).unionByName(told).unionByName(held)
    given = F.array(F.lit(str(weeks)), F.lit(str(least)), F.lit(today))
    bits = facts.select(F.concat_ws(" ", "id", "text").alias("bit")).unionByName(facts.sparkSession.range(1).select(F.array_join(given, " ").alias("bit")))
    return facts, bits.select(F.explode(digit_runs(F.col("bit"))).alias("run")).distinct()


def named_ids(facts: DataFrame, kinds: Sequence[str] = ("session", "trade", "rule")) -> DataFrame:
    """id: what a review may cite."""
    return facts.where(F.col("kind").isin(*kinds)).select("id").distinct()
