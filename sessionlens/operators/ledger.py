"""The ledger: tallies, periods and keyed maintenance of its tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def iso_week(day: Column) -> Column:
    """YYYY-Www with the ISO year, which differs from the calendar's around New Year."""
    return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), day), F.weekofyear(day))


def year_month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def adherence(checks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, rule (null: all rules), passed, violated, unverifiable, rate: passed of the checks with a verdict."""
    sets = [[*map(F.col, keys), F.col("rule")], [F.col(k) for k in keys]]
    counted = checks.groupingSets(sets, *map(F.col, keys), F.col("rule")).agg(
        F.count_if(F.col("status") == "pass").alias("passed"), F.count_if(F.col("status") == "violated").alias("violated"), F.count_if(~F.col("status").isin("pass", "violated")).alias("unverifiable"),
    )
    return counted.withColumn("rate", F.expr("try_divide(passed, passed + violated)"))


def violations(tally: DataFrame) -> DataFrame:
    return tally.where("violated > 0").select(*[c for c in tally.columns if c not in ("passed", "unverifiable", "rate")])


def agreement(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, agree, disagree, unknown, rate of a nullable boolean ``agrees``."""
    out = trades.groupBy(*keys).agg(F.count_if("agrees").alias("agree"), F.count_if(~F.col("agrees")).alias("disagree"), F.count_if(F.col("agrees").isNull()).alias("unknown"))
    return out.withColumn("rate", F.expr("try_divide(agree, agree + disagree)"))


def period_summary(sessions: DataFrame) -> DataFrame:
    """iso_week, year_month (both null: all), sessions, trades, hours_us, per_hour. sessions: session_id, session_date, trade_count, hours_us."""
    s = sessions.select("trade_count", "hours_us", iso_week(F.col("session_date")).alias("iso_week"), year_month(F.col("session_date")).alias("year_month"))
    out = s.groupingSets([[F.col("iso_week")], [F.col("year_month")], []], F.col("iso_week"), F.col("year_month")).agg(
        F.count("*").alias("sessions"), F.sum("trade_count").alias("trades"), F.sum("hours_us").alias("hours_us")
    )
    return out.withColumn("per_hour", F.when(F.col("hours_us") > 0, F.col("trades") / (F.col("hours_us") / 3_600_000_000)))


def combined_periods(summary: DataFrame, weeks: DataFrame) -> DataFrame:
    """iso_week, sessions, trades: every requested week, with zeros where there was none."""
    own = summary.where("iso_week is not null").select("iso_week", "sessions", "trades")
    return weeks.join(own, "iso_week", "left").select("iso_week", F.coalesce("sessions", F.lit(0)).alias("sessions"), F.coalesce("trades", F.lit(0)).alias("trades"))


def trailing_weeks(sessions: DataFrame, n: int) -> DataFrame:
    """Sessions of the n ISO weeks that end with the newest session's."""
    newest = sessions.agg(F.date_trunc("week", F.max("session_date")).cast("date").alias("w"))
    start = F.date_sub(F.col("w"), 7 * (n - 1))
    return sessions.join(F.broadcast(newest), F.col("session_date") >= start).drop("w")


def latest(sessions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, session_id: the newest by (session_date, session_id)."""
    return sessions.groupBy(*keys).agg(F.max_by("session_id", F.struct("session_date", "session_id")).alias("session_id"))


def substitute_days(session_rows: DataFrame, day_rows: DataFrame, day_rules: Sequence[str]) -> DataFrame:
    """day, rule, status: on days with a rollup the session rows of the day's rules give way to the day's own."""
    built = day_rows.select("day").distinct()
    of_day = F.col("rule").isin(*day_rules)
    legacy = session_rows.where(of_day).join(built, "day", "left_anti")
    columns = ["day", "rule", "status"]
    return session_rows.where(~of_day).select(columns).unionByName(legacy.select(columns)).unionByName(day_rows.select(columns))


def hours_basis(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, hours_us, basis: 'fill_span' if all days are built, 'duration' if none, else 'mixed'. days: is_built, span_us, duration_us."""
    out = days.groupBy(*keys).agg(F.sum(F.when(F.col("is_built"), F.col("span_us")).otherwise(F.col("duration_us"))).alias("hours_us"), F.bool_and("is_built").alias("a"), F.bool_or("is_built").alias("o"))
    return out.select(*keys, "hours_us", F.when(F.col("a"), "fill_span").when(F.col("o"), "mixed").otherwise("duration").alias("basis"))


def replace_keys(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old without the keys that new has, and new: an idempotent upsert of whole sessions (or days) at once."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def last_row(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row of each key that is last by order; of equal ones the first by all columns, nulls first."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc(), *(F.col(c) for c in rows.columns if c not in (*keys, order)))
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def drop_dependents(changed: DataFrame, tables: dict[str, DataFrame], keys: Sequence[str]) -> dict[str, DataFrame]:
    """Each table without the rows of changed keys."""
    gone = changed.select(*keys).distinct()
    return {name: t.join(gone, list(keys), "left_anti") for name, t in tables.items()}


def stage_status(artifacts: DataFrame, stages: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """session_id, stages: map of stage to ok, failed or missing; optional stages are left out when missing. artifacts: session_id, stage, state; a failure stays until an ok."""
    best = artifacts.groupBy("session_id", "stage").agg(F.when(F.bool_or(F.col("state") == "ok"), "ok").otherwise("failed").alias("s"))
    have = best.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("stage", "s"))).alias("m"))
    entries = [F.struct(F.lit(s).alias("stage"), F.coalesce(F.element_at("m", F.lit(s)), F.lit(None if s in optional else "missing").cast("string")).alias("state")) for s in stages]
    return have.select("session_id", F.map_from_entries(F.filter(F.array(*entries), lambda e: e.state.isNotNull())).alias("stages"))


def incomplete_days(status: DataFrame, needed: Sequence[str]) -> DataFrame:
    """day, reasons: sessions of a day that lack a needed stage. status: day, session_id, stages."""
    missing = F.filter(F.array(*(F.when(~F.coalesce(F.element_at("stages", F.lit(s)) == "ok", F.lit(False)), F.concat_ws(":", "session_id", F.lit(s))) for s in needed)), lambda x: x.isNotNull())
    each = status.select("day", F.explode(missing).alias("r"))
    return each.groupBy("day").agg(F.array_join(F.array_sort(F.collect_set("r")), ",").alias("reasons"))


def fingerprint(fills: DataFrame, keys: Sequence[str], identity: Sequence[str]) -> DataFrame:
    """keys, n, digest: SHA-256 of the sorted identities of a key's rows."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity))
    return fills.groupBy(*keys).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(text)), ";"), 256).alias("digest"))


def day_state(days: DataFrame) -> DataFrame:
    """day, state from clip_count, built, digest, built_digest and complete."""
    state = (
        F.when(F.col("clip_count") < 2, F.when(F.col("built"), "legacy").otherwise("legacy_unbuilt"))
        .when(~F.col("built"), "missing").when(~F.col("digest").eqNullSafe(F.col("built_digest")), "stale").when(~F.col("complete"), "current_incomplete").otherwise("current")
    )
    return days.select("day", state.alias("state"))


def publish_gate(clips: DataFrame) -> DataFrame:
    """day, problem: days of which a clip lacks a debrief, or has facts of a fake provider."""
    g = clips.groupBy("day").agg(F.bool_and("debrief").alias("all_done"), F.bool_or(F.col("provider") == "fake").alias("fake"))
    return g.where("not all_done or fake").select("day", F.when(~F.col("all_done"), "debrief missing").otherwise("fake provider").alias("problem"))


def largest_violation(checks: DataFrame, floor: int) -> DataFrame:
    """rule, n: the most frequent violated rule (then the smallest name) if it has ``floor`` rows."""
    return checks.where("status = 'violated'").groupBy("rule").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule").limit(1).where(F.col("n") >= floor)


def citeable_ids(sessions: DataFrame, trades: DataFrame, checks: DataFrame) -> DataFrame:
    """id: session, session:trade and session:rule, each once."""
    return (
        sessions.select(F.col("session_id").alias("id")).unionByName(trades.select(F.concat_ws(":", "session_id", "trade_id").alias("id")))
        .unionByName(checks.select(F.concat_ws(":", "session_id", "rule").alias("id"))).distinct()
    )


def citation_floor(claims: DataFrame, ids: DataFrame, floor: int) -> DataFrame:
    """claim_id, n_cites, fabricated, ok: cites that exist, cites that don't, and whether there are ``floor`` and none made up. claims: claim_id, cites."""
    c = claims.select("claim_id", F.explode_outer(F.array_distinct("cites")).alias("id"))
    j = c.join(ids.select("id", F.lit(True).alias("known")), "id", "left")
    g = j.groupBy("claim_id").agg(F.count_if("known").alias("n_cites"), F.count_if(F.col("id").isNotNull() & F.col("known").isNull()).alias("fabricated"))
    return g.withColumn("ok", (F.col("n_cites") >= floor) & (F.col("fabricated") == 0))


def first_lines(texts: DataFrame, key: str, n: int = 3) -> DataFrame:
    """key, pos, line: the first n non-empty lines over a key's texts in order. texts: key, ord, text."""
    lines = texts.select(key, "ord", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    w = Window.partitionBy(key).orderBy("ord", "i")
    return lines.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n).select(key, "pos", "line")


def last_debriefs(debriefs: DataFrame, key: str, n: int, chars: int = 2000) -> DataFrame:
    """The newest n of a key, cut to chars, with pos from the oldest. debriefs: key, ord, text."""
    newest = debriefs.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ord")))).where(F.col("__rn") <= n)
    return newest.select(key, F.row_number().over(Window.partitionBy(key).orderBy("ord")).alias("pos"), "ord", F.left("text", F.lit(chars)).alias("text"))


def day_sentence(clips: DataFrame) -> DataFrame:
    """day, sentence: counts of clips, suspected ones and clips without a fill."""
    g = clips.groupBy("day").agg(F.count("*").alias("n"), F.count_if("suspected").alias("s"), F.count_if(F.col("n_fills") == 0).alias("e"))
    return g.select("day", F.format_string("%d clips, %d suspected, %d without fills", "n", "s", "e").alias("sentence"))


def by_period(rows: DataFrame, day: str = "day") -> DataFrame:
    """rows three times: under their ISO week, their month and all; a row without a day only under all. Columns period_kind and period (null: all)."""
    d = F.col(day)
    periods = F.array(F.struct(F.lit("week").alias("k"), F.when(d.isNotNull(), iso_week(d)).alias("p")), F.struct(F.lit("month").alias("k"), F.when(d.isNotNull(), year_month(d)).alias("p")), F.struct(F.lit("all").alias("k"), F.lit(None).cast("string").alias("p")))
    each = rows.withColumn("__p", F.explode(periods)).where("__p.k = 'all' or __p.p is not null")
    return each.withColumns({"period_kind": F.col("__p.k"), "period": F.col("__p.p")}).drop("__p")


def period_report(sessions: DataFrame, checks: DataFrame, trades: DataFrame) -> DataFrame:
    """period_kind, period, what, name, n, passed, violated, unverifiable, rate for each week, month and all.

    what 'sessions', 'trades' and 'hours' (n, no name); 'rule' (name null: all rules) with its verdicts and the rate of passes; 'violations', the number of
    violated checks of all rules; 'agreement' of stated and lab tags (passed: agree, violated: disagree). sessions: session_id, day, trade_count, hours; checks: day, rule,
    status; trades: day, agrees (null: unknown). Every period that any table has is there with its totals; one pass and one shuffle for each table.
    """
    keys = ["period_kind", "period"]
    s = by_period(sessions).groupBy(*keys).agg(F.count("*").cast("double").alias("sessions"), F.sum(F.coalesce("trade_count", F.lit(0))).cast("double").alias("trades"), F.sum(F.coalesce("hours", F.lit(0.0))).alias("hours"))
    empty = F.lit(None).cast("long")
    wide = s.select(*keys, F.explode(F.create_map(*(x for c in ("sessions", "trades", "hours") for x in (F.lit(c), F.col(c))))).alias("what", "n"))
    totals = wide.select(*keys, "what", F.lit(None).cast("string").alias("name"), "n", empty.alias("passed"), empty.alias("violated"), empty.alias("unverifiable"), F.lit(None).cast("double").alias("rate"))
    tally = adherence(by_period(checks), keys)
    ruled = tally.select(*keys, F.lit("rule").alias("what"), F.col("rule").alias("name"), (F.col("passed") + F.col("violated") + F.col("unverifiable")).cast("double").alias("n"), "passed", "violated", "unverifiable", "rate")
    bad = tally.where("rule is null").select(*keys, F.lit("violations").alias("what"), F.lit(None).cast("string").alias("name"), F.col("violated").cast("double").alias("n"), empty.alias("passed"), empty.alias("violated"), empty.alias("unverifiable"), F.lit(None).cast("double").alias("rate"))
    agreed = agreement(by_period(trades), keys).select(*keys, F.lit("agreement").alias("what"), F.lit(None).cast("string").alias("name"), (F.col("agree") + F.col("disagree") + F.col("unknown")).cast("double").alias("n"), F.col("agree").alias("passed"), F.col("disagree").alias("violated"), F.col("unknown").alias("unverifiable"), "rate")
    return totals.unionByName(ruled).unionByName(bad).unionByName(agreed)


def filled_periods(report: DataFrame, weeks: DataFrame) -> DataFrame:
    """The report's totals (sessions, trades, hours, violations) of the asked weeks (week_start: a Monday) and of the months they touch, zeros where there is nothing: week and month side by side."""
    asked = weeks.select(F.explode(F.array(F.struct(F.lit("week").alias("k"), iso_week(F.col("week_start")).alias("p")), F.struct(F.lit("month").alias("k"), year_month(F.col("week_start")).alias("p")), F.struct(F.lit("month").alias("k"), year_month(F.date_add("week_start", 6)).alias("p")))).alias("x")).select(F.col("x.k").alias("period_kind"), F.col("x.p").alias("period")).distinct()
    every = asked.select("*", F.explode(F.array(*map(F.lit, ("sessions", "trades", "hours", "violations")))).alias("what"))
    have = report.where("name is null and what in ('sessions', 'trades', 'hours', 'violations')").select("period_kind", "period", "what", "n")
    return every.join(have, ["period_kind", "period", "what"], "left").select("period_kind", "period", "what", F.coalesce("n", F.lit(0.0)).alias("n"))
