"""Rules that rest on what was said. Events: session_id, kind, seg, t_us (from the clip's start), text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lookback before an entry, cool-down after a sign of tilt, minutes of the hourly check-in.
LOOKBACK_US, COOLDOWN_US, MINUTES = 180_000_000, 300_000_000, (45, 55)
#: Phrases of the 3c and arrival rules.
THREE_C, THREE_C_NEGATED = r"(?i)\b3c\b", r"(?i)\b(?:ohne|kein(?:e|en)?|without|no)\s+3c\b"
COUNTER_TREND = r"(?i)gegen\s+den\s+trend|counter[- ]?trend|gegen\s+die\s+bewegung"
ARRIVAL = r"(?i)arrival|ankunft|kerzenschluss|candle\s*close|close\s+(?:the\s+)?candle"
#: Fixed value: the reason of the rule that can't be checked.
SLTP_REASON = "order modifications not in TradesViz; needs a venue adapter"
ALIGNMENT_LOW = 0.8


def has_3c(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), THREE_C_NEGATED, " ").rlike(THREE_C)


def _result(rule: str, rows: DataFrame, status: Column, reason: Column, *more: Column) -> DataFrame:
    return rows.select("session_id", F.lit(rule).alias("rule"), status.alias("status"), reason.alias("reason"), *more)


def _met(kind: str, entries: DataFrame, events: DataFrame, low: int, high: int, open_low: bool) -> DataFrame:
    """session_id, n_met: meetings of entries with events of a kind in (event + low, event + high] or [.., ..]. Equality on the session and on a time bucket as wide as the band."""
    width = high - low
    of_kind = events.where(F.col("kind") == kind)
    listed = of_kind.select("session_id", "t_us", F.explode(F.sequence(F.floor((F.col("t_us") + low) / width), F.floor((F.col("t_us") + high) / width))).alias("b"))
    gap = F.col("entry_us") - F.col("t_us")
    met = entries.withColumn("b", F.floor(F.col("entry_us") / width)).join(listed, ["session_id", "b"]).where((gap > low if open_low else gap >= low) & (gap <= high))
    return met.groupBy("session_id").agg(F.count("*").alias("n_met"))


def _band_verdict(kind: str, none: str, bad: str, n: Column, n_kind: Column, n_met: Column) -> tuple[Column, Column]:
    silent, without, met_some = n.isNull(), F.coalesce(n_kind, F.lit(0)) == 0, n_met > 0
    first = silent | without if kind == "tilt" else silent
    status = F.when(first | without, "unverifiable").when(met_some, "violated").otherwise("pass")
    return status, F.when(silent & F.lit(kind != "tilt"), "absent speech").when(without, none).when(met_some, bad)


#: Event kind, band, whether its start is open, and reasons.
_ZONE = ("no_trade_zone", 0, LOOKBACK_US, False, "no no-trade zone declared", "entry during a no-trade zone")
_TILT = ("tilt", 0, COOLDOWN_US, True, "no tilt language", "entry during tilt cool-down")


def _band(rule: str, sessions: DataFrame, entries: DataFrame, events: DataFrame, kind: str, low: int, high: int, open_low: bool, none: str, bad: str) -> DataFrame:
    """Entries that meet an event of a kind violate the rule. entries: session_id, trade_id, entry_us (from the clip's start)."""
    seen = events.groupBy("session_id").agg(F.count("*").alias("n_events"), F.count_if(F.col("kind") == kind).alias("n_kind"))
    j = sessions.select("session_id").join(seen, "session_id", "left").join(_met(kind, entries, events, low, high, open_low), "session_id", "left")
    verdict = _band_verdict(kind, none, bad, F.col("n_events"), F.col("n_kind"), F.col("n_met"))
    return _result(rule, j, *verdict, F.coalesce("n_met", F.lit(0)).alias("n_met"))


def no_trade_zone(sessions: DataFrame, entries: DataFrame, events: DataFrame) -> DataFrame:
    """R-ZONE: no entry up to the lookback after a no-trade zone was declared."""
    return _band("R-ZONE", sessions, entries, events, *_ZONE)


def tilt(sessions: DataFrame, entries: DataFrame, events: DataFrame) -> DataFrame:
    """R-TILT: no entry within the cool-down after a sign of tilt."""
    return _band("R-TILT", sessions, entries, events, *_TILT)


def _bias_verdict(n: Column, n_bias: Column) -> tuple[Column, Column]:
    return F.when(n.isNull(), "unverifiable").when(n_bias > 0, "pass").otherwise("violated"), F.when(n.isNull(), "absent speech").when(n_bias == 0, "bias not re-evaluated")


def bias(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """R-BIAS: a session with speech states its bias."""
    seen = events.groupBy("session_id").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "bias_statement").alias("n_bias"))
    j = sessions.select("session_id").join(seen, "session_id", "left")
    return _result("R-BIAS", j, *_bias_verdict(F.col("n"), F.col("n_bias")))


def _far() -> Column:
    """A check-in away from ten to the hour; s_us is its session's start."""
    return ~(F.floor((F.col("s_us") + F.col("t_us")) / 60_000_000) % 60).between(*MINUTES)


def _hourly_verdict(n: Column, n_checkins: Column, n_far: Column) -> tuple[Column, Column]:
    none = F.coalesce(n_checkins, F.lit(0)) == 0
    status = F.when(n.isNull(), "unverifiable").when(none | (n_far > 0), "violated").otherwise("pass")
    return status, F.when(n.isNull(), "absent speech").when(none, "no hourly check-in language").when(n_far > 0, "check-in not near xx:50")


def hourly(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """R-HOURLY: check-ins come in the minutes around ten to the hour. sessions: session_id, start_us."""
    checkins = events.where("kind = 'hourly_checkin'").join(sessions.select("session_id", F.col("start_us").alias("s_us")), "session_id")
    near = checkins.groupBy("session_id").agg(F.count("*").alias("n_checkins"), F.count_if(_far()).alias("n_far"))
    seen = events.groupBy("session_id").agg(F.count("*").alias("n"))
    j = sessions.select("session_id").join(seen, "session_id", "left").join(near, "session_id", "left")
    return _result("R-HOURLY", j, *_hourly_verdict(F.col("n"), F.col("n_checkins"), F.col("n_far")))


def _spoken_verdict(bad: str, n: Column, n_bad: Column, n_cited: Column) -> tuple[Column, Column]:
    status = F.when(n.isNull(), "unverifiable").when(n_bad > 0, "violated").when(n_cited > 0, "pass").otherwise("unverifiable")
    return status, F.when(n.isNull(), "absent speech").when(n_bad > 0, bad)


def _spoken(rule: str, sessions: DataFrame, trades: DataFrame, ok: Column, bad: str) -> DataFrame:
    n = trades.where("has_speech").groupBy("session_id").agg(F.count("*").alias("n"), F.count_if(~ok).alias("n_bad"), F.count_if(ok).alias("n_cited"))
    j = sessions.select("session_id").join(n, "session_id", "left")
    return _result(rule, j, *_spoken_verdict(bad, F.col("n"), F.col("n_bad"), F.col("n_cited")), F.coalesce("n_bad", F.lit(0)).alias("n_bad"))


def _cites_playbook() -> Column:
    return F.coalesce("playbook", "setup").isNotNull()


def _cites_both() -> Column:
    return F.col("stop").isNotNull() & F.col("target").isNotNull()


def _cites_arrival() -> Column:
    return F.coalesce("text", F.lit("")).rlike(ARRIVAL)


def _against_trend() -> Column:
    return ~has_3c(F.col("text")) & F.coalesce("text", F.lit("")).rlike(COUNTER_TREND)


_NO_PLAYBOOK, _NOT_DEFINED, _NO_ARRIVAL = "playbook not spoken before entry", "stop or target missing from pre-entry window", "no arrival-candle close cue"


def playbook(sessions: DataFrame, trades: DataFrame) -> DataFrame:
    """R-PLAYBOOK: every trade with speech cites a playbook or setup. trades: session_id, has_speech, playbook, setup (segments)."""
    return _spoken("R-PLAYBOOK", sessions, trades, _cites_playbook(), _NO_PLAYBOOK)


def defined(sessions: DataFrame, trades: DataFrame) -> DataFrame:
    """R-DEFINED: every trade with speech cites both a stop and a target."""
    return _spoken("R-DEFINED", sessions, trades, _cites_both(), _NOT_DEFINED)


def _three_c_verdict(n: Column, n_bad: Column, n_pass: Column) -> tuple[Column, Column]:
    status, reason = _spoken_verdict("counter-trend speech without 3c", n, n_bad, n_pass)
    return status, F.when(n.isNull() | (n_bad > 0), reason).when(n_pass == 0, "no 3c or counter-trend speech; journal triggers later")


def three_c(sessions: DataFrame, trades: DataFrame) -> DataFrame:
    """R-3C-CT over trades with speech: session_id, has_speech, text (before the entry)."""
    n = trades.where("has_speech").groupBy("session_id").agg(F.count("*").alias("n"), F.count_if(_against_trend()).alias("n_bad"), F.count_if(has_3c(F.col("text"))).alias("n_pass"))
    j = sessions.select("session_id").join(n, "session_id", "left")
    return _result("R-3C-CT", j, *_three_c_verdict(F.col("n"), F.col("n_bad"), F.col("n_pass")))


def arrival(sessions: DataFrame, trades: DataFrame) -> DataFrame:
    """R-ARRIVAL over trades with speech."""
    return _spoken("R-ARRIVAL", sessions, trades, _cites_arrival(), _NO_ARRIVAL)


def order_changes(sessions: DataFrame) -> DataFrame:
    """R-SLTP can't be checked from executions."""
    return _result("R-SLTP", sessions, F.lit("unverifiable"), F.lit(SLTP_REASON))


def all_checks(sessions: DataFrame, trades: DataFrame, entries: DataFrame, events: DataFrame) -> DataFrame:
    """session_id, checks (rule, status, reason): all rules of this module in one row for each session.

    The same results as those of the rules one by one, but trades and events are counted once for all rules, and the sessions joined once.
    """
    start = sessions.select("session_id", F.col("start_us").alias("s_us"))
    kind, checkin = F.col("kind"), F.col("kind") == "hourly_checkin"
    told = events.join(start, "session_id").groupBy("session_id").agg(
        F.count("*").alias("e"), F.count_if(kind == _ZONE[0]).alias("e_zone"), F.count_if(kind == _TILT[0]).alias("e_tilt"), F.count_if(kind == "bias_statement").alias("e_bias"),
        F.count_if(checkin).alias("e_checkin"), F.count_if(checkin & _far()).alias("e_far"),
    )
    counted = {"playbook": _cites_playbook(), "defined": _cites_both(), "arrival": _cites_arrival(), "against": _against_trend(), "said": has_3c(F.col("text"))}
    said = trades.where("has_speech").groupBy("session_id").agg(F.count("*").alias("n"), *(F.count_if(c).alias(name) for name, c in counted.items()))
    zone, tilted = (_met(*(b[0], entries, events, *b[1:4])).withColumnRenamed("n_met", name) for b, name in ((_ZONE, "m_zone"), (_TILT, "m_tilt")))
    j = start
    for facts in (told, said, zone, tilted):
        j = j.join(facts, "session_id", "left")
    c = F.col
    n, e = c("n"), c("e")
    verdicts = {
        "R-PLAYBOOK": _spoken_verdict(_NO_PLAYBOOK, n, n - c("playbook"), c("playbook")), "R-DEFINED": _spoken_verdict(_NOT_DEFINED, n, n - c("defined"), c("defined")),
        "R-3C-CT": _three_c_verdict(n, c("against"), c("said")), "R-ARRIVAL": _spoken_verdict(_NO_ARRIVAL, n, n - c("arrival"), c("arrival")), "R-SLTP": (F.lit("unverifiable"), F.lit(SLTP_REASON)),
        "R-HOURLY": _hourly_verdict(e, c("e_checkin"), c("e_far")), "R-ZONE": _band_verdict(_ZONE[0], *_ZONE[4:], e, c("e_zone"), c("m_zone")),
        "R-BIAS": _bias_verdict(e, c("e_bias")), "R-TILT": _band_verdict(_TILT[0], *_TILT[4:], e, c("e_tilt"), c("m_tilt")),
    }
    return j.select("session_id", F.array(*(F.struct(F.lit(rule).alias("rule"), status.alias("status"), reason.alias("reason")) for rule, (status, reason) in verdicts.items())).alias("checks"))


def scorecard(sessions: DataFrame, checks: list[DataFrame], alignment: DataFrame | None = None) -> DataFrame:
    """session_id, rule, status, reason: all checks; rules that need the clock are unverifiable where the alignment is invalid."""
    out = checks[0].select("session_id", "rule", "status", "reason")
    for c in checks[1:]:
        out = out.unionByName(c.select("session_id", "rule", "status", "reason"))
    if alignment is None:
        return out
    clock = F.col("rule").isin("R-HOURLY", "R-ZONE", "R-TILT", "R-3C-CT", "R-ARRIVAL")
    bad = clock & F.coalesce("invalid", F.lit(False))
    j = out.join(alignment.select("session_id", "invalid"), "session_id", "left")
    return j.select("session_id", "rule", F.when(bad, "unverifiable").otherwise(F.col("status")).alias("status"), F.when(bad, "alignment invalid").otherwise(F.col("reason")).alias("reason"))
