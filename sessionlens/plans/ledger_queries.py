"""Queries over the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger
from .fixtures import base, view
from .registry import query

C = ("clips",)
#: Checks of the clips: three rules with a result by the clip's number of events.
CHECKS = """checks AS (SELECT session_id, user_id, day, rule, CASE (n_events + k) % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'violated' ELSE 'unverifiable' END AS status FROM clips, (VALUES ('R-BIAS', 0), ('R-ZONE', 1), ('R-TILT', 2), ('R-DLL', 3)) v(rule, k))"""


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(k).alias("k")) for k, n in enumerate(("R-BIAS", "R-ZONE", "R-TILT", "R-DLL"))))).alias("x")
    m = (F.col("n_events") + F.col("x.k")) % 3
    return view(spark, sf_dir, "clips").select("session_id", "user_id", "day", "n_events", r).select("session_id", "user_id", "day", F.col("x.rule").alias("rule"), F.when(m == 0, "pass").when(m == 1, "violated").otherwise("unverifiable").alias("status"))


ADH = CHECKS + """, adh AS (SELECT user_id, rule, count(*) FILTER (WHERE status = 'pass') AS passed, count(*) FILTER (WHERE status = 'violated') AS violated, count(*) FILTER (WHERE status = 'unverifiable') AS unverifiable FROM checks GROUP BY GROUPING SETS ((user_id, rule), (user_id)))"""


@query("adherence", ADH + " SELECT *, CASE WHEN passed + violated > 0 THEN passed / (passed + violated) END AS rate FROM adh", C)
def adherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.adherence(checks(spark, sf_dir), ["user_id"])


@query("violations", ADH + " SELECT user_id, rule, violated FROM adh WHERE violated > 0", C)
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.violations(adherence(spark, sf_dir))


@query("agreement_tally", "c AS (SELECT user_id, CASE n_events % 3 WHEN 0 THEN true WHEN 1 THEN false END AS agrees FROM clips) SELECT user_id, count(*) FILTER (WHERE agrees) AS agree, count(*) FILTER (WHERE NOT agrees) AS disagree, count(*) FILTER (WHERE agrees IS NULL) AS unknown, CASE WHEN count(agrees) > 0 THEN count(*) FILTER (WHERE agrees) / count(agrees) END AS rate FROM c GROUP BY 1", C)
def agreement_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("n_events") % 3
    return ledger.agreement(view(spark, sf_dir, "clips").withColumn("agrees", F.when(m == 0, True).when(m == 1, False)), ["user_id"])


#: Dates around New Year show the ISO year.
SES = """ses AS (SELECT o_orderkey AS session_id, o_orderdate::DATE AS session_date, o_custkey % 7 AS trade_count, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_custkey * 1000000 END AS hours_us FROM orders),
per AS (SELECT *, printf('%04d-W%02d', isoyear(session_date), weekofyear(session_date)) AS iso_week, strftime(session_date, '%Y-%m') AS year_month FROM ses),
summ AS (SELECT iso_week, year_month, count(*) AS sessions, sum(trade_count)::BIGINT AS trades, sum(hours_us)::BIGINT AS hours_us FROM per GROUP BY GROUPING SETS ((iso_week), (year_month), ()))"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = base(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("session_id"), F.to_date("o_orderdate").alias("session_date"), (F.col("o_custkey") % 7).alias("trade_count"), F.when(F.col("o_orderkey") % 4 == 0, 0).otherwise(F.col("o_custkey") * 1_000_000).alias("hours_us"))


@query("period_summary", SES + " SELECT *, CASE WHEN hours_us > 0 THEN trades / (hours_us / 3600000000) END AS per_hour FROM summ")
def period_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.period_summary(sessions(spark, sf_dir))


@query("combined_rollup", SES + ", wk AS (SELECT DISTINCT printf('%04d-W%02d', isoyear(d), weekofyear(d)) AS iso_week FROM (SELECT session_date + 400 AS d FROM ses)) SELECT iso_week, coalesce(sessions, 0) AS sessions, coalesce(trades, 0) AS trades FROM wk LEFT JOIN (SELECT * FROM summ WHERE iso_week IS NOT NULL) USING (iso_week)")
def combined_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessions(spark, sf_dir)
    weeks = s.select(ledger.iso_week(F.date_add("session_date", 400)).alias("iso_week")).distinct()
    return ledger.combined_periods(ledger.period_summary(s), weeks)


@query("trailing_weeks", SES + " SELECT session_id FROM ses WHERE session_date >= (SELECT date_trunc('week', max(session_date)) - INTERVAL 21 DAY FROM ses)")
def trailing_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.trailing_weeks(sessions(spark, sf_dir), 4).select("session_id")


@query("latest_session", "SELECT user_id, last(session_id ORDER BY day, session_id) AS session_id FROM clips GROUP BY 1", C)
def latest_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.latest(view(spark, sf_dir, "clips").withColumnRenamed("day", "session_date"), ["user_id"])


DAYS = """dayrows AS (SELECT DISTINCT day, 'R-DLL' AS rule, 'pass' AS status FROM clips WHERE extract(day FROM day) % 2 = 0)"""


@query("day_substitution", CHECKS + "," + DAYS + """ SELECT day, rule, status FROM checks c WHERE rule <> 'R-DLL' OR NOT EXISTS (SELECT 1 FROM dayrows d WHERE d.day = c.day) UNION ALL SELECT day, rule, status FROM dayrows""", C)
def day_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = view(spark, sf_dir, "clips").where("day(day) % 2 = 0").select("day", F.lit("R-DLL").alias("rule"), F.lit("pass").alias("status")).distinct()
    return ledger.substitute_days(checks(spark, sf_dir), days, ["R-DLL"])


@query("hours_basis", """d AS (SELECT user_id % 20 AS desk, CASE WHEN user_id % 20 < 5 THEN true WHEN user_id % 20 < 10 THEN false ELSE extract(day FROM day) % 2 = 0 END AS b, end_us - start_us AS dur, (end_us - start_us) // 2 AS span FROM clips)
SELECT desk, sum(CASE WHEN b THEN span ELSE dur END)::BIGINT AS hours_us, CASE WHEN bool_and(b) THEN 'fill_span' WHEN bool_or(b) THEN 'mixed' ELSE 'duration' END AS basis FROM d GROUP BY 1""", C)
def hours_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "clips").withColumn("desk", F.col("user_id") % 20).withColumn("duration_us", F.col("end_us") - F.col("start_us"))
    built = F.when(F.col("desk") < 5, True).when(F.col("desk") < 10, False).otherwise(F.dayofmonth("day") % 2 == 0)
    return ledger.hours_basis(c.withColumns({"is_built": built, "span_us": F.floor(F.col("duration_us") / 2)}), ["desk"])


@query("session_upsert", CHECKS + ", nw AS (SELECT session_id, user_id, day, rule, 'pass' AS status FROM checks WHERE user_id % 3 = 0 AND rule = 'R-BIAS') SELECT * FROM checks WHERE session_id NOT IN (SELECT session_id FROM nw) UNION ALL SELECT * FROM nw", C)
def session_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = checks(spark, sf_dir)
    return ledger.replace_keys(c, c.where("user_id % 3 = 0 and rule = 'R-BIAS'").withColumn("status", F.lit("pass")), ["session_id"])


@query("drop_cascade", CHECKS + " SELECT session_id, rule, status FROM checks WHERE user_id % 4 <> 1", C)
def drop_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = checks(spark, sf_dir)
    return ledger.drop_dependents(view(spark, sf_dir, "clips").where("user_id % 4 = 1"), {"checks": c}, ["session_id"])["checks"].select("session_id", "rule", "status")


ART = """art AS (SELECT session_id, stage, CASE WHEN (n_events + k) % 4 = 0 THEN 'failed' ELSE 'ok' END AS state FROM clips, (VALUES ('fills', 0), ('evidence', 1), ('debrief', 2), ('insights', 3)) v(stage, k) WHERE (user_id + k) % 5 <> 0),
sb AS (SELECT session_id, stage, CASE WHEN bool_or(state = 'ok') THEN 'ok' ELSE 'failed' END AS s FROM art GROUP BY ALL)"""


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = F.explode(F.array(*(F.struct(F.lit(n).alias("stage"), F.lit(k).alias("k")) for k, n in enumerate(("fills", "evidence", "debrief", "insights"))))).alias("x")
    c = view(spark, sf_dir, "clips").select("session_id", "user_id", "n_events", st).where("(user_id + x.k) % 5 <> 0")
    return c.select("session_id", F.col("x.stage").alias("stage"), F.when((F.col("n_events") + F.col("x.k")) % 4 == 0, "failed").otherwise("ok").alias("state"))


@query("stage_status", ART + """ SELECT session_id, coalesce(max(s) FILTER (WHERE stage = 'fills'), 'missing') AS fills, coalesce(max(s) FILTER (WHERE stage = 'evidence'), 'missing') AS evidence, coalesce(max(s) FILTER (WHERE stage = 'debrief'), 'missing') AS debrief, max(s) FILTER (WHERE stage = 'insights') AS insights FROM sb GROUP BY 1""", C)
def stage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("fills", "evidence", "debrief", "insights")
    s = ledger.stage_status(artifacts(spark, sf_dir), names, ["insights"])
    return s.select("session_id", *(F.element_at("stages", F.lit(n)).alias(n) for n in names))


@query("incomplete_days", ART + """, mi AS (SELECT DISTINCT day, c.session_id || ':' || st AS r FROM (SELECT DISTINCT session_id FROM sb) x JOIN clips c USING (session_id), (VALUES ('evidence'), ('debrief')) v(st) WHERE NOT EXISTS (SELECT 1 FROM sb WHERE sb.session_id = c.session_id AND sb.stage = st AND s = 'ok'))
SELECT day, string_agg(r, ',' ORDER BY r) AS reasons FROM mi GROUP BY 1""", C)
def incomplete_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ledger.stage_status(artifacts(spark, sf_dir), ("fills", "evidence", "debrief"))
    return ledger.incomplete_days(s.join(view(spark, sf_dir, "clips").select("session_id", "day"), "session_id"), ["evidence", "debrief"])


FP = """t AS (SELECT user_id, session_date AS day, concat_ws('|', ts_us, side, price_ticks, qty) AS x FROM executions)"""


@query("fingerprint", FP + " SELECT user_id, day, count(*) AS n, sha256(string_agg(x, ';' ORDER BY x)) AS digest FROM t GROUP BY ALL", ("executions",))
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.fingerprint(view(spark, sf_dir, "executions").withColumnRenamed("session_date", "day"), ["user_id", "day"], ["ts_us", "side", "price_ticks", "qty"])


@query("day_state", """d AS (SELECT user_id || ':' || day AS day, count(*) AS n, bool_or(n_events > 2) AS built, sum(n_events) AS dg, sum(n_events) + (user_id % 2) AS bd, user_id % 3 = 0 AS complete FROM clips GROUP BY user_id, day)
SELECT day, CASE WHEN n < 2 THEN CASE WHEN built THEN 'legacy' ELSE 'legacy_unbuilt' END WHEN NOT built THEN 'missing' WHEN dg <> bd THEN 'stale' WHEN NOT complete THEN 'current_incomplete' ELSE 'current' END AS state FROM d""", C)
def day_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "clips").groupBy("user_id", "day").agg(F.count("*").alias("clip_count"), F.bool_or(F.col("n_events") > 2).alias("built"), F.sum("n_events").alias("digest"))
    return ledger.day_state(d.select(F.concat("user_id", F.lit(":"), F.col("day").cast("string")).alias("day"), "clip_count", "built", "digest", (F.col("digest") + F.col("user_id") % 2).alias("built_digest"), (F.col("user_id") % 3 == 0).alias("complete")))


@query("publish_gate", "g AS (SELECT user_id AS day, bool_and(n_events < 9) AS a, bool_or(n_events = 5) AS f FROM clips GROUP BY 1) SELECT day, CASE WHEN NOT a THEN 'debrief missing' ELSE 'fake provider' END AS problem FROM g WHERE NOT a OR f", C)
def publish_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "clips")
    return ledger.publish_gate(c.select(F.col("user_id").alias("day"), (F.col("n_events") < 9).alias("debrief"), F.when(F.col("n_events") == 5, "fake").otherwise("x").alias("provider")))


@query("largest_violation", CHECKS + " SELECT rule, count(*) AS n FROM checks WHERE status = 'violated' GROUP BY 1 HAVING n >= 10 ORDER BY n DESC, rule LIMIT 1", C)
def largest_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.largest_violation(checks(spark, sf_dir), 10)


@query("citeable_ids", CHECKS + " SELECT session_id AS id FROM clips UNION SELECT session_id || ':' || n_events FROM clips UNION SELECT session_id || ':' || rule FROM checks", C)
def citeable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "clips")
    return ledger.citeable_ids(c, c.select("session_id", F.col("n_events").alias("trade_id")), checks(spark, sf_dir))


@query("citation_floor", """cl AS (SELECT user_id AS claim_id, unnest([session_id, CASE WHEN n_events = 3 THEN 'made-up' ELSE session_id END]) AS id FROM clips WHERE n_events > 1)
SELECT claim_id, count(DISTINCT id) FILTER (WHERE id <> 'made-up') AS n_cites, count(DISTINCT id) FILTER (WHERE id = 'made-up') AS fabricated, count(DISTINCT id) FILTER (WHERE id <> 'made-up') >= 10 AND count(DISTINCT id) FILTER (WHERE id = 'made-up') = 0 AS ok FROM cl GROUP BY 1""", C)
def citation_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "clips")
    cites = F.array("session_id", F.when(F.col("n_events") == 3, "made-up").otherwise(F.col("session_id")))
    claims = c.where("n_events > 1").groupBy(F.col("user_id").alias("claim_id")).agg(F.flatten(F.collect_list(cites)).alias("cites"))
    return ledger.citation_floor(claims, c.select(F.col("session_id").alias("id")), 10)


@query("learnings", """l AS (SELECT conv_id, turn, trim(unnest(string_split(text, chr(10)))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations),
r AS (SELECT conv_id, line, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, i))::INT AS pos FROM l WHERE line <> '') SELECT conv_id, pos, line FROM r WHERE pos <= 3""")
def learnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.first_lines(base(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ord"), "text"), "conv_id")


@query("last_debriefs", """r AS (SELECT conv_id, turn AS ord, left(text, 200) AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY ord))::INT AS pos, ord, text FROM r WHERE rn <= 2""")
def last_debriefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.last_debriefs(base(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ord"), "text"), "conv_id", 2, 200)


@query("day_sentence", "SELECT day, count(*) || ' clips, ' || count(*) FILTER (WHERE n_events > 4) || ' suspected, ' || count(*) FILTER (WHERE n_events = 1) || ' without fills' AS sentence FROM clips GROUP BY 1", C)
def day_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.day_sentence(view(spark, sf_dir, "clips").select("day", (F.col("n_events") > 4).alias("suspected"), (F.col("n_events") - 1).alias("n_fills")))


@query("exchange_session_day", """SELECT event_id, CASE WHEN hour(l) >= 18 THEN l::DATE + 1 ELSE l::DATE END AS session_date, printf('%04d-W%02d', isoyear(l::DATE), weekofyear(l::DATE)) AS iso_week FROM (SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS l FROM events)""")
def exchange_session_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.col("ts"))
    day = F.to_date(local)
    return base(spark, sf_dir, "events").select("event_id", F.date_add(day, F.when(F.hour(local) >= 18, 1).otherwise(0)).alias("session_date"), ledger.iso_week(day).alias("iso_week"))
