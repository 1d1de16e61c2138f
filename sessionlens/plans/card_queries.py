"""Scorecards, pairs across clips, and screen texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clocks, evidence, intervals, lookup, pairing, rules, scorecards, screens, speech
from ..sources.shared import stored
from . import rule_queries, session_queries
from .fixtures import base, view
from .interval_queries import EC, OWN
from .pairing_queries import fifo_sql
from .registry import ORACLES, query

SPOKEN = ("rule_playbook", "rule_defined", "rule_3c", "rule_arrival", "rule_hourly", "rule_zone", "rule_bias", "rule_tilt")
DAILY = ("rule_dll", "rule_max", "rule_close", "rule_streak", "rule_postloss", "rule_reentry")
CLOCK = "('R-HOURLY', 'R-ZONE', 'R-TILT', 'R-3C-CT', 'R-ARRIVAL')"


def _all(names: tuple[str, ...], columns: str) -> str:
    return " UNION ALL ".join(f"SELECT {columns} FROM ({ORACLES[n]})" for n in names)


@query(
    "scorecard",
    f"""checks AS ({_all(SPOKEN, "session_id, rule, status, reason")} UNION ALL SELECT session_id, 'R-SLTP', 'unverifiable', '{speech.SLTP_REASON}' FROM clips)
SELECT session_id, rule, CASE WHEN n_events = 2 AND rule IN {CLOCK} THEN 'unverifiable' ELSE status END AS status, CASE WHEN n_events = 2 AND rule IN {CLOCK} THEN 'alignment invalid' ELSE reason END AS reason FROM checks JOIN clips USING (session_id)""",
    ("clips",),
)
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_queries.scorecard(spark, sf_dir)


@query("day_scorecard", "SELECT * FROM (" + _all(DAILY, "account, session_date, rule, status, reason") + ")", ("executions",))
def day_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules of an account's day; the trades are paired once and written, as six rules read them."""
    keys, config, wide = rule_queries.KEYS, rule_queries.CONFIG, rule_queries.WIDE
    t = stored(rule_queries.trades(spark, sf_dir), "trades")
    checks = [rules.daily_loss(t, keys, config), rules.max_trades(t, keys, config), rules.flat_by_close(t, keys, config), rules.loss_streak(t, keys, config), rules.post_loss(t, keys, config), rules.reentry(t, keys, wide)]
    return reduce(DataFrame.unionByName, [c.select(*keys, "rule", "status", "reason") for c in checks])


ORDER = "[" + ", ".join(f"'{r}'" for r in scorecards.RULES) + "]"


@query(
    "whole_scorecards",
    f"""spoken AS ({_all(SPOKEN, "session_id, rule, status, reason")} UNION ALL SELECT session_id, 'R-SLTP', 'unverifiable', '{speech.SLTP_REASON}' FROM clips),
days AS ({_all(DAILY, "account, session_date, rule, status, reason")}),
s AS (SELECT session_id, user_id % 7 AS account, day, n_events % 3 = 0 AS of_day, n_events % 4 <> 1 AS has_evidence, n_events = 2 AS invalid FROM clips),
g AS (SELECT s.*, i AS place, {ORDER}[i] AS rule FROM s, range(1, 16) AS r(i)),
j AS (SELECT g.*, coalesce(a.status, b.status) AS st, coalesce(a.reason, b.reason) AS re, EXISTS (SELECT 1 FROM speech_events e WHERE e.session_id = g.session_id AND kind = 'bias_statement') AS bias
  FROM g LEFT JOIN spoken a ON a.session_id = g.session_id AND a.rule = g.rule LEFT JOIN days b ON b.account = g.account AND b.session_date = g.day AND b.rule = g.rule)
SELECT session_id, place::INTEGER AS place, rule,
  CASE WHEN place <= 5 AND of_day THEN 'unverifiable' WHEN invalid AND rule IN {CLOCK} THEN 'unverifiable' WHEN place > 6 AND rule <> 'R-SLTP' AND NOT has_evidence THEN CASE WHEN rule = 'R-BIAS' AND bias THEN 'pass' ELSE 'unverifiable' END ELSE coalesce(st, 'pass') END AS status,
  CASE WHEN place <= 5 AND of_day THEN 'evaluated on day ' || day WHEN invalid AND rule IN {CLOCK} THEN 'alignment_invalid' WHEN place > 6 AND rule <> 'R-SLTP' AND NOT has_evidence THEN CASE WHEN rule = 'R-BIAS' AND bias THEN NULL ELSE 'evidence_pending' END ELSE re END AS reason FROM j""",
    ("clips", "speech_events", "executions"),
)
def whole_scorecards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 15 rules for each clip; those of trades are its account's of the day."""
    clips, events = stored(view(spark, sf_dir, "clips"), "clips"), stored(view(spark, sf_dir, "speech_events"), "speech")
    sessions = clips.select("session_id", (F.col("user_id") % 7).alias("account"), "day", (F.col("n_events") % 3 == 0).alias("of_day"), (F.col("n_events") % 4 != 1).alias("has_evidence"), (F.col("n_events") == 2).alias("invalid"))
    days = day_scorecard(spark, sf_dir).groupBy(F.col("account").alias("d_account"), "session_date").agg(F.collect_list(F.struct("rule", "status", "reason")).alias("checks"))
    of_account = sessions.join(days, (F.col("account") == F.col("d_account")) & (F.col("day") == F.col("session_date"))).select("session_id", "checks")
    return scorecards.whole_scorecards(sessions, [session_queries.spoken_checks(spark, sf_dir, clips, events), of_account], events)


@query(
    "cross_session_pairs",
    OWN + ", day_fills AS (SELECT e.user_id, o.day, e.fill_id, e.side, e.qty, e.price_ticks, e.ts_us FROM owned o JOIN executions e USING (fill_id) WHERE state <> 'elsewhere')," + fifo_sql("day_fills", "user_id, day", "dl")
    + " SELECT dl.user_id, dl.day, lot_seq, status, a.owner AS entry_owner, b.owner AS exit_owner FROM dl LEFT JOIN owned a ON a.fill_id = entry_fill_id AND a.day = dl.day LEFT JOIN owned b ON b.fill_id = exit_fill_id AND b.day = dl.day",
    EC,
)
def cross_session_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fills of a day paired together; a lot belongs to the owner of its entry, its exit may be in another clip."""
    fills, clips = view(spark, sf_dir, "executions").withColumnRenamed("session_date", "day"), view(spark, sf_dir, "clips")
    owned = intervals.day_ownership(fills, clips, ["user_id"]).where("state <> 'elsewhere'").select("fill_id", F.col("day").alias("o_day"), "owner")
    mine = fills.drop("day").join(owned, "fill_id").withColumnRenamed("o_day", "day")
    return pairing.fifo_lots(mine, ["user_id", "day"], ["owner"]).select("user_id", "day", "lot_seq", "status", "entry_owner", "exit_owner")


@query("clock_texts", """t AS (SELECT event_id, epoch_us(ts) AS e, epoch_us(ts) + 3600000000 * (event_id % 7 - 3) AS w FROM events WHERE event_id % 11 <> 0)
SELECT event_id, w - w % 1000000 + CASE WHEN event_id % 3 = 1 THEN 500000 ELSE 0 END - CASE WHEN event_id % 3 = 2 THEN w // 1000000 % 60 * 1000000 ELSE 0 END AS clock_us, CASE WHEN event_id % 3 = 2 THEN 60 ELSE 1 END AS resolution FROM t""")
def clock_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times up to three hours off, written in three ways after a date."""
    n, us = F.col("event_id"), F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    e = base(spark, sf_dir, "events").where("event_id % 11 <> 0").withColumn("e", us)
    wall = F.timestamp_add("HOUR", (n % 7 - 3).cast("int"), F.col("ts"))
    text = F.when(n % 3 == 0, F.date_format(wall, "'11.09.2026 'HH:mm:ss")).when(n % 3 == 1, F.date_format(wall, "'2026-01-02 'HH:mm:ss',5'")).otherwise(F.date_format(wall, "'at 'HH:mm"))
    return e.select("event_id", screens.clock_us(text, F.col("e"), F.lit(0.9)).alias("clock_us"), screens.clock_resolution(text).alias("resolution"))


@query("screen_numbers", """SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL WHEN event_id % 4 IN (1, 3) THEN -(1000 + event_id % 900) - 0.5 ELSE 1000 + event_id % 900 + 0.5 END::DOUBLE AS pnl,
  CASE WHEN event_id % 5 = 4 THEN NULL WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 3 = 1 THEN -(event_id % 9) ELSE event_id % 9 END AS position FROM events""")
def screen_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    whole = (n % 900).cast("string")
    v = F.concat(F.lit("1"), F.lpad(whole, 3, "0"))
    us, eu = F.concat(F.lit("1,"), F.lpad(whole, 3, "0"), F.lit(".50")), F.concat(F.lit("1."), F.lpad(whole, 3, "0"), F.lit(",50"))
    pnl = F.when(n % 4 == 0, F.concat(F.lit("$ "), us)).when(n % 4 == 1, F.concat(F.lit("("), eu, F.lit(") EUR"))).when(n % 4 == 2, F.concat(v, F.lit(",5"))).otherwise(F.concat(F.lit("−"), v, F.lit(".5 USD")))
    pos = F.when(n % 3 == 0, "Flat 3").when(n % 3 == 1, F.concat(F.lit("- "), n % 9)).otherwise(F.concat(F.lit("+"), n % 9, F.lit(" MNQ")))
    sure = F.when(n % 5 == 4, 0.4).otherwise(0.5)
    return base(spark, sf_dir, "events").select("event_id", screens.result(pnl, sure).alias("pnl"), screens.position(pos, sure).alias("position"))


@query("session_list", "SELECT session_id FROM clips WHERE day > (SELECT max(day) FROM clips) - 7 AND n_events % 2 = 0", ("clips",))
def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the last seven days with a stage in a wanted state."""
    c = view(spark, sf_dir, "clips").withColumn("states", F.array(F.when(F.col("n_events") % 2 == 0, "failed").otherwise("ok"), F.lit("ok")))
    newest = c.agg(F.max("day").alias("newest"))
    return c.join(F.broadcast(newest), F.col("day") > F.date_sub("newest", 7)).where(F.arrays_overlap("states", F.array(F.lit("failed")))).select("session_id")


@query(
    "part_lookup",
    """p AS (SELECT session_id, k AS part, 1000000 + k * ((end_us - start_us) // 3) AS o, (end_us - start_us) // 4 AS d FROM clips, (VALUES (0), (1), (2)) v(k)),
t AS (SELECT DISTINCT session_id, (end_us - start_us) * f // 4 AS t_us FROM clips, (VALUES (0), (1), (2), (3), (5)) v(f)),
b AS (SELECT t.session_id, t_us, max(part) FILTER (WHERE o <= t_us AND o = mo) AS part FROM t JOIN (SELECT *, o AS mo FROM p) p USING (session_id) GROUP BY ALL),
l AS (SELECT t.session_id, t_us, last(part ORDER BY o, part) FILTER (WHERE o <= t_us) AS part FROM t JOIN p USING (session_id) GROUP BY ALL)
SELECT l.session_id, t_us, coalesce(l.part, 0) AS part, CASE WHEN l.part IS NULL THEN 0 ELSE least(t_us - o, d) END AS seek_us FROM l LEFT JOIN p ON p.session_id = l.session_id AND p.part = l.part""",
    ("clips",),
)
def part_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three parts with gaps; times before, inside, between and after them."""
    c = view(spark, sf_dir, "clips").withColumn("len", F.col("end_us") - F.col("start_us"))
    parts = c.select("session_id", "len", F.explode(F.array(*(F.lit(k) for k in range(3)))).alias("part")).select("session_id", "part", (1_000_000 + F.col("part") * F.floor(F.col("len") / 3)).alias("offset_us"), F.floor(F.col("len") / 4).alias("dur_us"))
    times = c.select("session_id", F.explode(F.array(*(F.floor(F.col("len") * f / 4) for f in (0, 1, 2, 3, 5)))).alias("t_us"))
    return evidence.part_at(times, parts, ["session_id"])


@query("markers", session_queries.WINS + """, ch AS (SELECT session_id, 'm' || k AS name, (end_us - start_us) * k // 10 AS c_us FROM clips, (VALUES (1), (4), (7)) v(k)) SELECT trade_id, name FROM wn JOIN ch ON ch.session_id = wn.session_id AND c_us BETWEEN t0_us AND t1_us""", EC)
def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "clips").select("session_id", (F.col("end_us") - F.col("start_us")).alias("len"), F.explode(F.array(F.lit(1), F.lit(4), F.lit(7))).alias("k"))
    chapters = c.select("session_id", F.concat(F.lit("m"), "k").alias("name"), F.floor(F.col("len") * F.col("k") / 10).alias("c_us"))
    return evidence.markers_in(evidence.windows(session_queries.session_trades(spark, sf_dir)), chapters, ["session_id"])


@query(
    "first_frame",
    """f AS (SELECT session_id, start_us, CASE WHEN n_events > 1 THEN end_us END AS stop_us, CASE WHEN n_events % 5 <> 4 THEN n_events * 1000 END AS paused_us, end_us - start_us - n_events * 1000 - user_id % 20 * 100000 AS duration_us FROM clips),
o AS (SELECT *, stop_us - start_us - paused_us - duration_us AS offset_us FROM f)
SELECT session_id, offset_us, CASE WHEN offset_us BETWEEN 200000 AND 450000 THEN 'low' WHEN offset_us BETWEEN 800000 AND 1300000 THEN 'high' END AS band,
  CASE WHEN stop_us IS NULL THEN 'incomplete' WHEN paused_us IS NULL THEN 'pause_open' WHEN offset_us BETWEEN 200000 AND 450000 OR offset_us BETWEEN 800000 AND 1300000 THEN 'verified' ELSE 'out_of_band' END AS status FROM o""",
    ("clips",),
)
def first_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_events")
    c = view(spark, sf_dir, "clips").select(
        "session_id", "start_us", F.when(n > 1, F.col("end_us")).alias("stop_us"), F.when(n % 5 != 4, n * 1000).alias("paused_us"), (F.col("end_us") - F.col("start_us") - n * 1000 - F.col("user_id") % 20 * 100_000).alias("duration_us")
    )
    return clocks.first_frame(c)


@query("legacy_claimed", "SELECT fill_id FROM executions e WHERE NOT EXISTS (SELECT 1 FROM executions s WHERE s.fill_id % 3 = 0 AND s.user_id = e.user_id AND s.ts_us = e.ts_us AND s.qty = e.qty AND s.source_group_id IS NOT DISTINCT FROM e.source_group_id)", ("executions",))
def legacy_claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = view(spark, sf_dir, "executions")
    return lookup.unclaimed(e, e.where("fill_id % 3 = 0"), ["user_id", "ts_us", "qty", "source_group_id"]).select("fill_id")


@query(
    "prose_guard",
    """l AS (SELECT doc_id, source, text, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN lang ELSE 'xx' END AS cite FROM documents), ids AS (SELECT DISTINCT source, lang FROM documents),
runs AS (SELECT DISTINCT source, unnest(regexp_extract_all(text, '[0-9]+')) AS run FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id AS line_id, CASE WHEN cite IS NULL THEN 'no cites' WHEN NOT EXISTS (SELECT 1 FROM ids WHERE ids.source = l.source AND ids.lang = cite) THEN 'unknown cite'
  WHEN EXISTS (SELECT 1 FROM (SELECT unnest(regexp_extract_all(l.text, '[0-9]+')) AS r) x WHERE NOT EXISTS (SELECT 1 FROM runs WHERE runs.source = l.source AND runs.run = x.r)) THEN 'invented digits' END AS problem FROM l""",
)
def prose_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = base(spark, sf_dir, "documents")
    none = F.array().cast("array<string>")
    lines = d.select(F.col("doc_id").alias("line_id"), F.col("source").alias("session_id"), "text", F.when(F.col("doc_id") % 3 == 0, none).when(F.col("doc_id") % 3 == 1, F.array("lang")).otherwise(F.array(F.lit("xx"))).alias("cites"))
    runs = d.where("doc_id % 2 = 0").select(F.col("source").alias("session_id"), F.explode(F.regexp_extract_all("text", F.lit(r"\d+"), F.lit(0))).alias("run"))
    return lookup.prose_lines(lines, d.select(F.col("source").alias("session_id"), F.col("lang").alias("id")).distinct(), runs).select("line_id", "problem")


@query(
    "learnings_top_up",
    """k AS (SELECT conv_id, turn, text AS line FROM conversations WHERE turn < 2), f AS (SELECT conv_id, turn, text AS line FROM conversations),
b AS (SELECT conv_id, 0 AS p, turn, line FROM k UNION ALL SELECT conv_id, 1, turn, line FROM f), o AS (SELECT conv_id, line, min(p * 1000 + turn) AS o FROM b GROUP BY ALL),
r AS (SELECT conv_id, line, row_number() OVER (PARTITION BY conv_id ORDER BY o, line) AS pos FROM o) SELECT conv_id, pos, line FROM r WHERE pos <= 3""",
)
def learnings_top_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = base(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ord"), F.col("text").alias("line"))
    return lookup.top_up(c.where("ord < 2"), c, "conv_id")


@query(
    "session_bundle",
    """SELECT session_id, '{"session":{"n_events":' || n_events || '},"status":{"state":"' || CASE WHEN n_events % 2 = 0 THEN 'ok' ELSE 'missing' END || '"}' || CASE WHEN n_events % 3 = 0 THEN ',"transcript":{"lang":"de"}' ELSE '' END || '}' AS bundle FROM clips""",
    ("clips",),
)
def session_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "clips")
    status = c.select("session_id", F.when(F.col("n_events") % 2 == 0, "ok").otherwise("missing").alias("state"))
    return lookup.session_bundle(c.select("session_id", "n_events"), status, c.where("n_events % 3 = 0").select("session_id", F.lit("de").alias("lang")), c.where("false").select("session_id", "user_id"))
