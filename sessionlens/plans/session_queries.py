"""Queries over speech rules, clocks and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clocks, evidence, intervals, pairing, speech
from ..sources.shared import stored
from .fixtures import view
from .interval_queries import ONCE
from .pairing_queries import fifo_sql
from .registry import query

SES = ["session_id"]
V = ("executions", "clips", "speech_events")

SESSION_TRADES = (
    ONCE
    + ","
    + fifo_sql("executions", "user_id", "sl")
    + """, st AS (SELECT c.session_id, concat(c.user_id, '-', lot_seq) AS trade_id, lot_seq, status, direction, entry_fill_id, entry_ts_us - start_us AS entry_us, exit_ts_us - start_us AS exit_us, end_us - start_us AS duration_us
  FROM sl JOIN once ON once.fill_id = entry_fill_id JOIN clips c ON c.session_id = once.session_id)"""
)


def session_trades(spark: SparkSession, sf_dir: str, clips: DataFrame | None = None) -> DataFrame:
    fills, clips = view(spark, sf_dir, "executions"), view(spark, sf_dir, "clips") if clips is None else clips
    once = intervals.assign_once(fills, clips, ["user_id"]).select(F.col("fill_id").alias("entry_fill_id"), "session_id")
    lots = pairing.fifo_lots(fills, ["user_id"])
    j = lots.join(once, "entry_fill_id").join(clips.select("session_id", "start_us", "end_us"), "session_id")
    return j.select(
        "session_id", F.concat_ws("-", "user_id", "lot_seq").alias("trade_id"), "lot_seq", "status", "direction", "entry_fill_id",
        (F.col("entry_ts_us") - F.col("start_us")).alias("entry_us"), (F.col("exit_ts_us") - F.col("start_us")).alias("exit_us"), (F.col("end_us") - F.col("start_us")).alias("duration_us"),
    )


def _band_sql(rule: str, kind: str, cond: str, none: str, bad: str, tilt: bool) -> str:
    first = "ne IS NULL OR coalesce(n_kind, 0) = 0"
    silent = "" if tilt else "WHEN ne IS NULL THEN 'absent speech' "
    return f""", met AS (SELECT st.session_id, count(*) AS n_met FROM st JOIN speech_events e ON e.session_id = st.session_id AND kind = '{kind}' AND {cond} GROUP BY 1),
seen AS (SELECT session_id, count(*) AS ne, count(*) FILTER (WHERE kind = '{kind}') AS n_kind FROM speech_events GROUP BY 1)
SELECT c.session_id, '{rule}' AS rule, CASE WHEN {first} THEN 'unverifiable' WHEN n_met > 0 THEN 'violated' ELSE 'pass' END AS status,
  CASE {silent}WHEN coalesce(n_kind, 0) = 0 THEN '{none}' WHEN n_met > 0 THEN '{bad}' END AS reason, coalesce(n_met, 0) AS n_met FROM clips c LEFT JOIN seen USING (session_id) LEFT JOIN met USING (session_id)"""


@query("rule_zone", SESSION_TRADES + _band_sql("R-ZONE", "no_trade_zone", "entry_us - t_us BETWEEN 0 AND 180000000", "no no-trade zone declared", "entry during a no-trade zone", False), V)
def rule_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech.no_trade_zone(view(spark, sf_dir, "clips"), session_trades(spark, sf_dir), view(spark, sf_dir, "speech_events"))


@query("rule_tilt", SESSION_TRADES + _band_sql("R-TILT", "tilt", "entry_us > t_us AND entry_us <= t_us + 300000000", "no tilt language", "entry during tilt cool-down", True), V)
def rule_tilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech.tilt(view(spark, sf_dir, "clips"), session_trades(spark, sf_dir), view(spark, sf_dir, "speech_events"))


BIAS = """seen AS (SELECT session_id, count(*) AS n, count(*) FILTER (WHERE kind = 'bias_statement') AS nb FROM speech_events GROUP BY 1)
SELECT c.session_id, 'R-BIAS' AS rule, CASE WHEN n IS NULL THEN 'unverifiable' WHEN nb > 0 THEN 'pass' ELSE 'violated' END AS status, CASE WHEN n IS NULL THEN 'absent speech' WHEN nb = 0 THEN 'bias not re-evaluated' END AS reason
FROM clips c LEFT JOIN seen USING (session_id)"""


@query("rule_bias", BIAS, V[1:])
def rule_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech.bias(view(spark, sf_dir, "clips"), view(spark, sf_dir, "speech_events"))


HOURLY = """seen AS (SELECT session_id, count(*) AS n, count(*) FILTER (WHERE kind = 'hourly_checkin') AS nc,
  count(*) FILTER (WHERE kind = 'hourly_checkin' AND (start_us + t_us) // 60000000 % 60 NOT BETWEEN 45 AND 55) AS far FROM speech_events GROUP BY 1)
SELECT c.session_id, 'R-HOURLY' AS rule, CASE WHEN n IS NULL THEN 'unverifiable' WHEN nc = 0 OR far > 0 THEN 'violated' ELSE 'pass' END AS status,
  CASE WHEN n IS NULL THEN 'absent speech' WHEN nc = 0 THEN 'no hourly check-in language' WHEN far > 0 THEN 'check-in not near xx:50' END AS reason FROM clips c LEFT JOIN seen USING (session_id)"""


@query("rule_hourly", HOURLY, V[1:])
def rule_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech.hourly(view(spark, sf_dir, "clips"), view(spark, sf_dir, "speech_events"))


#: Stated fields of the derived trades, by their number in the user's lots; every fourth trade has no speech.
def stated_trades(spark: SparkSession, sf_dir: str, trades: DataFrame | None = None) -> DataFrame:
    def cite(name: str, cond: str):
        return F.when(F.expr(cond), F.concat(F.lit(f"{name}_"), "trade_id")).alias(name)

    n = "lot_seq"
    said = F.when(F.col(n) % 5 == 0, "short counter-trend idea").when(F.col(n) % 5 == 1, "this is a 3c with candle close").when(F.col(n) % 5 == 2, "kein 3c, counter trend, arrival").otherwise("quiet arrival")
    return (session_trades(spark, sf_dir) if trades is None else trades).select("session_id", "trade_id", (F.col(n) % 4 != 3).alias("has_speech"), cite("playbook", "lot_seq % 3 = 0"), cite("setup", "lot_seq % 5 = 0"), cite("stop", "lot_seq % 2 = 0"), cite("target", "lot_seq % 7 <> 0"), said.alias("text"))


def _spoken_sql(rule: str, ok: str, bad: str) -> str:
    return f""", n AS (SELECT session_id, count(*) AS n, count(*) FILTER (WHERE NOT ({ok})) AS nb, count(*) FILTER (WHERE {ok}) AS nk FROM st WHERE lot_seq % 4 <> 3 GROUP BY 1)
SELECT c.session_id, '{rule}' AS rule, CASE WHEN n IS NULL THEN 'unverifiable' WHEN nb > 0 THEN 'violated' WHEN nk > 0 THEN 'pass' ELSE 'unverifiable' END AS status,
  CASE WHEN n IS NULL THEN 'absent speech' WHEN nb > 0 THEN '{bad}' END AS reason, coalesce(nb, 0) AS n_bad FROM clips c LEFT JOIN n USING (session_id)"""


@query("rule_playbook", SESSION_TRADES + _spoken_sql("R-PLAYBOOK", "lot_seq % 3 = 0 OR lot_seq % 5 = 0", "playbook not spoken before entry"), V)
def rule_playbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech.playbook(view(spark, sf_dir, "clips"), stated_trades(spark, sf_dir))


@query("rule_defined", SESSION_TRADES + _spoken_sql("R-DEFINED", "lot_seq % 2 = 0 AND lot_seq % 7 <> 0", "stop or target missing from pre-entry window"), V)
def rule_defined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech.defined(view(spark, sf_dir, "clips"), stated_trades(spark, sf_dir))


@query("rule_arrival", SESSION_TRADES + _spoken_sql("R-ARRIVAL", "lot_seq % 5 <> 0", "no arrival-candle close cue"), V)
def rule_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech.arrival(view(spark, sf_dir, "clips"), stated_trades(spark, sf_dir))


@query(
    "rule_3c",
    SESSION_TRADES
    + """, n AS (SELECT session_id, count(*) AS n, count(*) FILTER (WHERE lot_seq % 5 IN (0, 2)) AS nb, count(*) FILTER (WHERE lot_seq % 5 = 1) AS np FROM st WHERE lot_seq % 4 <> 3 GROUP BY 1)
SELECT c.session_id, 'R-3C-CT' AS rule, CASE WHEN n IS NULL THEN 'unverifiable' WHEN nb > 0 THEN 'violated' WHEN np > 0 THEN 'pass' ELSE 'unverifiable' END AS status,
  CASE WHEN n IS NULL THEN 'absent speech' WHEN nb > 0 THEN 'counter-trend speech without 3c' WHEN np = 0 THEN 'no 3c or counter-trend speech; journal triggers later' END AS reason FROM clips c LEFT JOIN n USING (session_id)""",
    V,
)
def rule_3c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech.three_c(view(spark, sf_dir, "clips"), stated_trades(spark, sf_dir))



def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = stored(view(spark, sf_dir, "clips"), "clips")
    checks = spoken_checks(spark, sf_dir, clips).select("session_id", F.explode("checks").alias("c")).select("session_id", "c.*")
    return speech.scorecard(clips, [checks], clips.select("session_id", (F.col("n_events") == 2).alias("invalid")))


def spoken_checks(spark: SparkSession, sf_dir: str, clips: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """session_id, checks of the rules that rest on speech, and of the one that can't be checked; the trades are made once and written, as all rules read them."""
    ev = stored(view(spark, sf_dir, "speech_events"), "speech") if events is None else events
    st = stored(session_trades(spark, sf_dir, clips), "trades")
    return speech.all_checks(clips, stated_trades(spark, sf_dir, st), st, ev)


@query("theil_sen", """sl AS (SELECT a.user_id, quantile_cont((b.y - a.y) / (b.x_us - a.x_us), 0.5) AS slope FROM readings a JOIN readings b ON a.user_id = b.user_id AND a.x_us < b.x_us GROUP BY 1),
w AS (SELECT r.user_id, x_us, y, coalesce(slope, 0) AS slope FROM readings r LEFT JOIN sl USING (user_id))
SELECT user_id, count(*) AS n, round(max(slope) * 1e9, 3) AS slope, round(quantile_cont(y - slope * x_us, 0.5), 3) AS intercept FROM w GROUP BY 1""", ("readings",))
def theil_sen(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = clocks.theil_sen(view(spark, sf_dir, "readings"), ["user_id"])
    return fit.select("user_id", "n", F.round(F.col("slope") * 1e9, 3).alias("slope"), F.round("intercept", 3).alias("intercept"))


@query("residual_score", """r AS (SELECT user_id, (y % 400 - 200) / 100.0::DOUBLE AS r FROM readings), c AS (SELECT user_id, quantile_cont(r, 0.5) AS centre FROM r GROUP BY 1),
m AS (SELECT user_id, count(*) AS n, max(centre) AS centre, quantile_cont(abs(r - centre), 0.5) AS mad FROM r JOIN c USING (user_id) GROUP BY 1)
SELECT user_id, n, round(least(least(1.0::DOUBLE, n / 10) * greatest(0.0::DOUBLE, 1 - greatest(mad, abs(centre)) / 2), CASE WHEN n = 1 THEN 0.35 WHEN n < 3 THEN 0.5 ELSE 1.0 END::DOUBLE), 4) AS confidence FROM m""", ("readings",))
def residual_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clocks.residual_score(view(spark, sf_dir, "readings").select("user_id", ((F.col("y") % 400 - 200) / 100.0).alias("r")), ["user_id"])


@query("alignment_choice", """cand AS (SELECT session_id, 'filename' AS method, 0 AS offset_us, 0.6::DOUBLE AS confidence, 3 AS p FROM clips UNION ALL SELECT session_id, 'ocr', 1000, 0.9, 2 FROM clips WHERE n_events >= 2
  UNION ALL SELECT session_id, 'sidecar', 300000, 1.0, 1 FROM clips WHERE n_events >= 3 UNION ALL SELECT session_id, 'manual', 500, 1.0, 0 FROM clips WHERE user_id % 13 = 0)
SELECT session_id, first(method ORDER BY p) AS method, first(offset_us ORDER BY p) AS offset_us, first(confidence ORDER BY p) AS confidence FROM cand GROUP BY 1""", ("clips",))
def alignment_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "clips")

    def cand(method: str, offset: int, conf: float, cond: str) -> DataFrame:
        return c.where(cond).select("session_id", F.lit(method).alias("method"), F.lit(offset).alias("offset_us"), F.lit(conf).alias("confidence"))

    every = cand("filename", 0, 0.6, "true").unionByName(cand("ocr", 1000, 0.9, "n_events >= 2")).unionByName(cand("sidecar", 300000, 1.0, "n_events >= 3")).unionByName(cand("manual", 500, 1.0, "user_id % 13 = 0"))
    return clocks.choose_alignment(every)


@query("clock_confirm", """SELECT r.*, EXISTS (SELECT 1 FROM readings o WHERE o.user_id = r.user_id AND o.event_id <> r.event_id AND abs(o.x_us - r.x_us) <= 43200000000 AND abs(o.y - r.y) <= 2000) AS confirmed FROM readings r""", ("readings",))
def clock_confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clocks.confirm_samples(view(spark, sf_dir, "readings"), ["user_id"], 2000, 43_200_000_000)


@query("pause_verdict", """o AS (SELECT *, y // 1000 AS s FROM readings), d AS (SELECT *, s - lag(s) OVER (PARTITION BY user_id, x_us // 86400000000 ORDER BY x_us, event_id) AS step FROM o),
g AS (SELECT user_id, x_us // 86400000000 AS day, count(*) AS n, last(s ORDER BY x_us, event_id) - first(s ORDER BY x_us, event_id) AS total, coalesce(bool_or(step < -5), false) AS down FROM d GROUP BY ALL)
SELECT user_id, day, n, CASE WHEN n >= 2 THEN total END AS total, CASE WHEN n < 2 OR down THEN 'unverifiable' WHEN total > 30 THEN 'suspected' ELSE 'clear' END AS verdict FROM g""", ("readings",))
def pause_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = view(spark, sf_dir, "readings").withColumn("y", F.floor(F.col("y") / 1000)).withColumn("day", F.floor(F.col("x_us") / 86_400_000_000))
    return clocks.pause_verdict(r, ["user_id", "day"])


#: Every 7th resume leaves the band.
REC = """rec AS (SELECT session_id, row_no, event, wall_us, video_us + CASE WHEN event = 'resume' THEN -600000000 + CASE WHEN row_no % 7 = 0 THEN 900000 ELSE 600000 END ELSE 0 END AS video_us FROM recorder_events)"""
SECTIONS = REC + """, nx AS (SELECT *, lag(video_us) OVER w AS pv, lead(event) OVER w AS ee, lead(wall_us) OVER w AS ew, lead(video_us) OVER w AS ev FROM rec WINDOW w AS (PARTITION BY session_id ORDER BY wall_us, row_no)),
bg AS (SELECT *, CASE WHEN event = 'resume' THEN video_us - pv END AS ro, row_number() OVER (PARTITION BY session_id ORDER BY wall_us, row_no) AS idx FROM nx WHERE event IN ('record_start', 'resume')),
sec AS (SELECT session_id, idx, CASE WHEN max(CASE WHEN ro NOT BETWEEN 400000 AND 800000 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY wall_us, row_no ROWS UNBOUNDED PRECEDING) = 1 THEN 'segment_invalid' ELSE 'verified' END AS status,
  wall_us AS wall_start_us, ew AS wall_end_us, CASE WHEN event = 'resume' THEN pv ELSE video_us END AS video_start_us, ev AS video_end_us, ro AS resume_offset_us, ee FROM bg)"""


def recorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = view(spark, sf_dir, "recorder_events")
    shift = F.when(F.col("event") == "resume", -600_000_000 + F.when(F.col("row_no") % 7 == 0, 900_000).otherwise(600_000)).otherwise(0)
    return r.select("session_id", "row_no", "event", "wall_us", (F.col("video_us") + shift).alias("video_us"))


@query("sections", SECTIONS + " SELECT * EXCLUDE (ee) FROM sec WHERE ee IN ('pause', 'record_stop')", ("recorder_events",))
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clocks.sections(recorder(spark, sf_dir))


@query("pause_total", REC + """, p AS (SELECT *, lead(event) OVER w AS ne, lead(wall_us) OVER w AS nw FROM rec WINDOW w AS (PARTITION BY session_id ORDER BY wall_us, row_no))
SELECT session_id, count(*) AS pauses, CASE WHEN count(*) = count(*) FILTER (WHERE ne = 'resume') THEN sum(nw - wall_us)::BIGINT END AS paused_us FROM p WHERE event = 'pause' GROUP BY 1""", ("recorder_events",))
def pause_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clocks.pause_total(recorder(spark, sf_dir))


@query("fill_positions", SECTIONS + "," + ONCE + """, f AS (SELECT once.fill_id, session_id, ts_us FROM once JOIN executions USING (fill_id)),
sl AS (SELECT *, idx = max(idx) OVER (PARTITION BY session_id) AS is_last FROM sec WHERE ee IN ('pause', 'record_stop')),
h AS (SELECT f.fill_id, s.* , ts_us FROM f LEFT JOIN sl s ON s.session_id = f.session_id AND ts_us >= wall_start_us AND (ts_us < wall_end_us OR (ts_us = wall_end_us AND is_last))),
b AS (SELECT fill_id, min(idx) AS idx, first(status ORDER BY idx) AS status, first(CASE WHEN resume_offset_us IS NULL THEN ts_us - wall_start_us - length(session_id) % 3 * 250000 ELSE video_start_us + ts_us - wall_start_us END ORDER BY idx) AS v FROM h GROUP BY 1)
SELECT fill_id, idx, CASE WHEN status = 'verified' THEN v END AS video_us, CASE WHEN idx IS NULL THEN 'outside_sections' WHEN status <> 'verified' THEN 'segment_invalid' END AS reason FROM b""", ("recorder_events", "executions", "clips"))
def fill_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    fills, clips = view(spark, sf_dir, "executions"), view(spark, sf_dir, "clips")
    once = intervals.assign_once(fills, clips, ["user_id"]).select("fill_id", "session_id").join(fills.select("fill_id", "ts_us"), "fill_id")
    found = clocks.sections(recorder(spark, sf_dir))
    return clocks.position_fills(once, found, SES, found.select("session_id").distinct().withColumn("offset_us", F.length("session_id") % 3 * 250_000))


WINS = SESSION_TRADES + """, wn AS (SELECT *, least(greatest(entry_us - 180000000, 0), duration_us) AS t0_us, least(greatest(coalesce(exit_us, entry_us) + 120000000, 0), duration_us) AS t1_us FROM st)"""


@query("evidence_windows", WINS + " SELECT session_id, trade_id, t0_us, t1_us, t0_us <> entry_us - 180000000 OR t1_us <> coalesce(exit_us, entry_us) + 120000000 AS clipped FROM wn", V[:2])
def evidence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.windows(session_trades(spark, sf_dir)).select("session_id", "trade_id", "t0_us", "t1_us", "clipped")


TALKS = """tot AS (SELECT session_id, max(t1_us) AS total FROM segments GROUP BY 1), tk AS (SELECT session_id, session_id || '-' || k AS trade_id, total * k // 4 AS t0_us, total * k // 4 + total // 3 AS t1_us FROM tot, (VALUES (1), (2)) v(k))"""


@query("window_segments", TALKS + " SELECT tk.session_id, trade_id, seg FROM tk JOIN segments s ON s.session_id = tk.session_id AND s.t0_us <= tk.t1_us AND s.t1_us >= tk.t0_us", ("segments",))
def window_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "segments")
    tot = s.groupBy("session_id").agg(F.max("t1_us").alias("total")).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    t0 = F.floor(F.col("total") * F.col("k") / 4)
    wins = tot.select("session_id", F.concat_ws("-", "session_id", "k").alias("trade_id"), t0.alias("t0_us"), (t0 + F.floor(F.col("total") / 3)).alias("t1_us"))
    return evidence.segments_in(wins, s, SES)


POINTS = """, pt AS (SELECT c.session_id, event_id AS point_id, t_us - start_us AS p_us FROM clip_events e JOIN clips c ON c.session_id = concat(e.user_id, '-', e.n) WHERE event_type IN ('view', 'error'))"""
PV = ("executions", "clips", "clip_events")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, c = view(spark, sf_dir, "clip_events").where("event_type in ('view', 'error')"), view(spark, sf_dir, "clips")
    j = e.withColumn("session_id", F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("n").cast("string"))).join(c.select("session_id", "start_us"), "session_id")
    return j.select("session_id", F.col("event_id").alias("point_id"), (F.col("t_us") - F.col("start_us")).alias("p_us"))


@query("nearest_reading", WINS + POINTS + """, hit AS (SELECT trade_id, point_id, true AS inside FROM wn JOIN pt ON pt.session_id = wn.session_id AND p_us BETWEEN t0_us AND t1_us),
nr AS (SELECT trade_id, point_id, row_number() OVER (PARTITION BY trade_id ORDER BY abs(p_us - entry_us), p_us, point_id) AS rn FROM wn JOIN pt USING (session_id) WHERE trade_id NOT IN (SELECT trade_id FROM hit))
SELECT * FROM hit UNION ALL SELECT trade_id, point_id, false FROM nr WHERE rn = 1""", PV)
def nearest_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.nearest_or_inside(evidence.windows(session_trades(spark, sf_dir)), points(spark, sf_dir), SES)


@query("nearest_clip", WINS + POINTS + """, nr AS (SELECT trade_id, point_id, row_number() OVER (PARTITION BY trade_id ORDER BY p_us NOT BETWEEN t0_us AND t1_us, abs(p_us - entry_us), p_us, point_id) AS rn FROM wn JOIN pt USING (session_id))
SELECT trade_id, point_id FROM nr WHERE rn = 1""", PV)
def nearest_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.nearest_one(evidence.windows(session_trades(spark, sf_dir)), points(spark, sf_dir), SES)


@query("clip_plan", SESSION_TRADES + " SELECT session_id, trade_id, greatest(entry_us - 30000000, 0) AS c0_us, least(entry_us + 60000000, duration_us) AS c1_us FROM st", V[:2])
def clip_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.plan_clips(session_trades(spark, sf_dir)).select("session_id", "trade_id", "c0_us", "c1_us")


@query("frame_plan", SESSION_TRADES + " SELECT DISTINCT session_id, entry_us + o AS t_us FROM st, (VALUES (-5000000), (-2000000), (0), (2000000), (5000000)) v(o) WHERE entry_us + o BETWEEN 0 AND duration_us", V[:2])
def frame_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.plan_frames(session_trades(spark, sf_dir).select("session_id", F.col("entry_us").alias("t_us"), "duration_us"))


@query("part_slices", SESSION_TRADES + """, c AS (SELECT session_id, trade_id, greatest(entry_us - 30000000, 0) AS c0, least(entry_us + 60000000, duration_us) AS c1, duration_us FROM st),
p AS (SELECT session_id, k AS part, k * ((end_us - start_us) // 4) AS o, (end_us - start_us) // 4 AS d FROM clips, (VALUES (0), (1), (2), (3)) v(k))
SELECT c.session_id, trade_id, part, greatest(c0, o) - o AS l0_us, least(c1, o + d) - o AS l1_us FROM c JOIN p USING (session_id) WHERE greatest(c0, o) < least(c1, o + d)""", V[:2])
def part_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    quarter = F.floor((F.col("end_us") - F.col("start_us")) / 4)
    parts = view(spark, sf_dir, "clips").select("session_id", F.explode(F.array(*(F.lit(k) for k in range(4)))).alias("part"), "start_us", "end_us")
    return evidence.slice_parts(evidence.plan_clips(session_trades(spark, sf_dir)), parts.select("session_id", "part", (F.col("part") * quarter).alias("offset_us"), quarter.alias("dur_us")), SES)
