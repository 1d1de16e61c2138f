"""Whole scorecards: every rule once for every session, in one order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules in the order of a scorecard, those that a day decides, those that need speech, those that need the clock.
RULES = (
    "R-DLL", "R-MAX10", "R-3L30", "R-5M", "R-REENTRY", "R-CLOSE", "R-PLAYBOOK", "R-DEFINED", "R-3C-CT", "R-ARRIVAL", "R-SLTP", "R-HOURLY", "R-ZONE", "R-BIAS", "R-TILT",
)
DAY_RULES = RULES[:5]
SPOKEN_RULES = tuple(r for r in RULES[6:] if r != "R-SLTP")
CLOCK_RULES = ("R-HOURLY", "R-ZONE", "R-TILT", "R-3C-CT", "R-ARRIVAL")
PENDING, INVALID = "evidence_pending", "alignment_invalid"


def whole_scorecards(sessions: DataFrame, checks: Sequence[DataFrame], events: DataFrame) -> DataFrame:
    """session_id, place, rule, status, reason: 15 rows for each session.

    sessions: session_id, day, of_day (its day rules are decided on the day, not here), has_evidence, invalid (its alignment); checks: session_id,
    rule, status, reason, of any rules, or one row for each session_id with an array ``checks`` of these; events: session_id, kind. Of several checks of a
    rule the worst counts (violated, unverifiable, pass), then the first reason.
    What has no check: day rules of a session of a day are placeholders; rules that need the clock are unverifiable where the alignment is invalid; rules
    that rest on speech wait for evidence, but a stated bias passes; all others pass, as they do without trades. Checks of a session are joined as arrays.
    """
    check = F.struct("rule", "status", "reason")
    listed = [c for c in checks if "checks" in c.columns]
    single = [c.select("session_id", check.alias("c")) for c in checks if "checks" not in c.columns]
    if single:
        listed.append(reduce(DataFrame.unionByName, single).groupBy("session_id").agg(F.collect_list("c").alias("checks")))
    met, none = sessions, F.array().cast("array<struct<rule: string, status: string, reason: string>>")
    for i, c in enumerate(listed):
        met = met.join(c.select(F.col("session_id").alias(f"c{i}_id"), F.col("checks").alias(f"checks{i}")), F.col("session_id") == F.col(f"c{i}_id"), "left")
    stated = events.where("kind = 'bias_statement'").select(F.col("session_id").alias("b_id")).distinct().withColumn("stated_bias", F.lit(True))
    met = met.join(stated, F.col("session_id") == F.col("b_id"), "left").withColumn("checks", F.concat(none, *(F.coalesce(f"checks{i}", none) for i in range(len(listed)))))
    met = met.withColumn("rules", F.transform("checks", lambda c: c["rule"])).withColumn("single", F.size(F.array_distinct("rules")) == F.size("rules"))

    def worst(c: Column) -> Column:
        return F.struct(F.when(c["status"] == "violated", 0).when(c["status"] == "unverifiable", 1).otherwise(2).alias("w"), c["reason"].alias("reason"), c["status"].alias("status"))

    def given(rule: str) -> Column:
        """The check of a rule; a session's checks are only searched one by one where a rule has several."""
        several = F.array_min(F.transform(F.filter("checks", lambda c: c["rule"] == rule), worst))
        at = F.array_position("rules", F.lit(rule)).cast("int")
        one = F.when(at > 0, F.try_element_at("checks", at))
        return F.when(F.col("single"), F.struct(one["reason"].alias("reason"), one["status"].alias("status"))).otherwise(F.struct(several["reason"].alias("reason"), several["status"].alias("status")))

    met = met.select("session_id", "day", "of_day", "has_evidence", "invalid", F.coalesce("stated_bias", F.lit(False)).alias("stated_bias"), *(given(r).alias(f"g{i}") for i, r in enumerate(RULES)))
    lines = []
    for i, rule in enumerate(RULES):
        st, re = F.col(f"g{i}.status"), F.col(f"g{i}.reason")
        no = F.lit(False)
        placeholder = F.col("of_day") if rule in DAY_RULES else no
        invalid = F.col("invalid") if rule in CLOCK_RULES else no
        pending = ~F.col("has_evidence") if rule in SPOKEN_RULES else no
        biased = pending & F.col("stated_bias") if rule == "R-BIAS" else no
        waits = pending | (st.isNull() if rule in SPOKEN_RULES else no)
        status = F.when(placeholder | invalid, "unverifiable").when(biased, "pass").when(waits, "unverifiable").otherwise(F.coalesce(st, F.lit("pass")))
        reason = (
            F.when(placeholder, F.concat(F.lit("evaluated on day "), F.date_format("day", "yyyy-MM-dd"))).when(invalid, INVALID).when(biased, F.lit(None)).when(waits, PENDING).otherwise(re)
        )
        lines.append(F.struct(F.lit(i + 1).alias("place"), F.lit(rule).alias("rule"), status.alias("status"), reason.alias("reason")))
    return met.select("session_id", F.inline(F.array(*lines)))
