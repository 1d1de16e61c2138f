"""What was said before each entry, and the rules that rest on it.

Trades: session_id, trade_id, t0_us and entry_us (the window's start and the entry, in the
recording's clock). Stated: session_id, trade_id, name, value, seg (the fields that a trade's
evidence cites; without a segment they don't count as speech). Events: session_id, t_us, kind, seg, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import range_join
from .speech import ARRIVAL, COUNTER_TREND, has_3c

#: The stated fields in the order in which their values are read.
STATED = ("setup", "bias", "stop_raw", "target_raw", "playbook")


def _is_arrival(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(ARRIVAL)


def spoken_trades(trades: DataFrame, stated: DataFrame, events: DataFrame) -> DataFrame:
    """session_id, trade_id, has_speech, text, cites_3c, cites_arrival: speech of a trade is its stated values and then the events from its window's start to its entry, ends included.

    A cue is cited if a stated field or an event that has a segment holds it by itself. Ranges are met by time buckets of a session.
    """
    spans = trades.where("t0_us <= entry_us").select("session_id", "trade_id", "t0_us", "entry_us")
    met = range_join(events.select("session_id", "t_us", "seg", "text"), spans, ["session_id"], "t_us", F.col("t0_us"), F.col("entry_us"), width=600_000_000)
    said = met.select("session_id", "trade_id", F.lit(len(STATED)).alias("rank"), "t_us", "seg", F.coalesce("text", F.lit("")).alias("text"), F.lit(False).alias("stated"))
    rank = F.array_position(F.array(*map(F.lit, STATED)), F.col("name")) - 1
    named = stated.where(F.col("name").isin(*STATED)).select("session_id", "trade_id", rank.cast("int").alias("rank"), F.lit(0).cast("long").alias("t_us"), F.nullif("seg", F.lit("")).alias("seg"), F.coalesce("value", F.lit("")).alias("text"), F.lit(True).alias("stated"))
    every = named.unionByName(said)
    cited = F.coalesce(F.col("seg") != "", F.lit(False))
    by_trade = every.groupBy(F.col("session_id").alias("s_id"), F.col("trade_id").alias("s_trade")).agg(
        F.bool_or(F.col("stated") & cited).alias("has_speech"), F.bool_or(cited & has_3c(F.col("text"))).alias("cites_3c"), F.bool_or(cited & _is_arrival(F.col("text"))).alias("cites_arrival"),
        F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("rank", "t_us", "seg", "text"))), lambda x: x["text"] != ""), lambda x: x["text"]), " ").alias("text"),
    )
    met_all = trades.join(by_trade, (F.col("session_id") == F.col("s_id")) & (F.col("trade_id") == F.col("s_trade")), "left")
    no = F.lit(False)
    return met_all.select("session_id", "trade_id", F.coalesce("has_speech", no).alias("has_speech"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("cites_3c", no).alias("cites_3c"), F.coalesce("cites_arrival", no).alias("cites_arrival"))


def _judged(rule: str, sessions: DataFrame, spoken: DataFrame, bad: Column, passed: Column, bad_reason: str, none_reason: str) -> DataFrame:
    n = spoken.where("has_speech").groupBy(F.col("session_id").alias("n_id")).agg(F.count_if(bad).alias("n_bad"), F.count_if(passed).alias("n_pass"))
    j = sessions.select("session_id").join(n, F.col("session_id") == F.col("n_id"), "left")
    status = F.when(F.col("n_id").isNull(), "unverifiable").when(F.col("n_bad") > 0, "violated").when(F.col("n_pass") > 0, "pass").otherwise("unverifiable")
    reason = F.when(F.col("n_id").isNull(), "absent speech").when(F.col("n_bad") > 0, bad_reason).when(F.col("n_pass") == 0, none_reason)
    return j.select("session_id", F.lit(rule).alias("rule"), status.alias("status"), reason.alias("reason"), F.coalesce("n_bad", F.lit(0)).alias("n_bad"))


def three_c(sessions: DataFrame, spoken: DataFrame) -> DataFrame:
    """R-3C-CT: counter-trend speech names a 3c; passes where one is cited."""
    said = has_3c(F.col("text"))
    return _judged("R-3C-CT", sessions, spoken, ~said & F.col("text").rlike(COUNTER_TREND), said & F.col("cites_3c"), "counter-trend speech without 3c", "no 3c or counter-trend speech; journal triggers later")


def arrival(sessions: DataFrame, spoken: DataFrame) -> DataFrame:
    """R-ARRIVAL: every trade with speech has a cue of the arrival candle; passes where one is cited."""
    said = _is_arrival(F.col("text"))
    return _judged("R-ARRIVAL", sessions, spoken, ~said, said & F.col("cites_arrival"), "no arrival-candle close cue", "no cited segment")


def bias(sessions: DataFrame, events: DataFrame, stated: DataFrame) -> DataFrame:
    """R-BIAS: a session with speech has a bias statement, or a trade whose evidence cites one."""
    cited = stated.where("seg <> ''").where(F.col("name").isin(*STATED)).select("session_id", (F.col("name") == "bias").alias("biased"))
    told = events.select("session_id", ((F.col("kind") == "bias_statement") & F.coalesce(F.col("seg") != "", F.lit(False))).alias("biased"))
    seen = cited.unionByName(told).groupBy(F.col("session_id").alias("n_id")).agg(F.bool_or("biased").alias("biased"))
    j = sessions.select("session_id").join(seen, F.col("session_id") == F.col("n_id"), "left")
    silent = F.col("n_id").isNull()
    status = F.when(silent, "unverifiable").when(F.col("biased"), "pass").otherwise("violated")
    reason = F.when(silent, "absent speech").when(~F.col("biased"), "bias not re-evaluated")
    return j.select("session_id", F.lit("R-BIAS").alias("rule"), status.alias("status"), reason.alias("reason"))
