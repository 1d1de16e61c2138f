"""Queries over gates, accounts and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gates, ledger, lookup
from ..sources import executions
from .fixtures import base, view
from .registry import query

KINDS = "k AS (SELECT fill_id, account, instrument, session_date, CASE WHEN fill_id % 4 = 0 THEN 'manual' ELSE 'imported' END AS entry_kind, CASE WHEN fill_id % 5 <> 0 THEN qty END AS qty FROM executions)"


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("fill_id") % 4 == 0, "manual").otherwise("imported")
    return view(spark, sf_dir, "executions").select("fill_id", "account", "instrument", "session_date", kind.alias("entry_kind"), F.when(F.col("fill_id") % 5 != 0, F.col("qty")).alias("qty"))


@query("entry_kinds", KINDS + " SELECT fill_id, qty FROM k WHERE qty IS NOT NULL AND entry_kind = 'imported'", ("executions",))
def entry_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return executions.imported_only(_kinds(spark, sf_dir)).select("fill_id", "qty")


CHECKS = """c AS (SELECT session_id, n_events, n_events % 3 = 0 AS bad, (end_us - start_us) / 1e6::DOUBLE AS duration_s FROM clips),
v AS (SELECT session_id, duration_s, CASE n_events % 4 WHEN 0 THEN 'force' WHEN 1 THEN 'suspected' ELSE 'clear' END AS verdict, n_events % 5 <> 4 AS same FROM c WHERE n_events % 7 <> 6)"""


def _checks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = view(spark, sf_dir, "clips")
    n, parts = F.col("n_events"), F.array(F.col("session_id"), F.lit("p2"))
    clips = c.select("session_id", n, F.col("session_id").alias("sha"), parts.alias("parts"), ((F.col("end_us") - F.col("start_us")) / 1e6).alias("duration_s"), (n % 3 == 0).alias("alignment_invalid"))
    verdict = F.when(n % 4 == 0, "force").when(n % 4 == 1, "suspected").otherwise("clear")
    checks = clips.where(n % 7 != 6).select("session_id", "sha", F.when(n % 5 != 4, F.col("parts")).otherwise(F.reverse("parts")).alias("parts"), "duration_s", verdict.alias("verdict"))
    return clips.drop("n_events"), checks


@query("same_key_checks", CHECKS + " SELECT session_id, verdict FROM v WHERE same", ("clips",))
def same_key_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips, checks = _checks(spark, sf_dir)
    return lookup.same_key_checks(checks, clips)


@query("has_core", CHECKS + """ SELECT c.session_id, CASE WHEN verdict = 'force' THEN true WHEN verdict = 'suspected' OR bad OR verdict IS NULL THEN false ELSE true END AS has_core
FROM c LEFT JOIN (SELECT * FROM v WHERE same) v ON v.session_id = c.session_id""", ("clips",))
def has_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.has_core(*_checks(spark, sf_dir))


@query("alignment_low", """s AS (SELECT session_id, CASE WHEN n_events % 2 = 0 THEN n_events % 10 / 10.0::DOUBLE END AS confidence FROM clips),
t AS (SELECT concat(cast(user_id as varchar), '-', cast(n as varchar)) AS session_id, bool_and(event_id % 3 = 0 OR event_id % 10 / 10.0::DOUBLE < 0.8) AS all_low FROM clip_events GROUP BY 1)
SELECT session_id, coalesce(confidence < 0.8, all_low, false) AS low FROM s LEFT JOIN t USING (session_id)""", ("clips", "clip_events"))
def alignment_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "clips").select("session_id", F.when(F.col("n_events") % 2 == 0, F.col("n_events") % 10 / 10.0).alias("confidence"))
    t = view(spark, sf_dir, "clip_events").select(F.concat_ws("-", "user_id", F.col("n").cast("string")).alias("session_id"), (F.col("event_id") % 10 / 10.0).alias("confidence"), (F.col("event_id") % 3 == 0).alias("is_low"))
    return gates.alignment_low(s, t)


@query("stale_days", "d AS (SELECT session_date AS day, CASE count(*) % 3 WHEN 0 THEN 'stale' WHEN 1 THEN 'missing' ELSE 'fresh' END AS state FROM executions GROUP BY 1) SELECT day, state FROM d WHERE state <> 'fresh'", ("executions",))
def stale_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*") % 3
    days = view(spark, sf_dir, "executions").groupBy(F.col("session_date").alias("day")).agg(F.when(n == 0, "stale").when(n == 1, "missing").otherwise("fresh").alias("state"))
    return gates.stale_days(days)


@query("audit_classes", KINDS + """ SELECT fill_id, CASE WHEN instrument <> 'MNQ' THEN 'other_instrument' WHEN fill_id % 6 = 5 THEN 'not_stored' WHEN entry_kind = 'manual' AND fill_id % 8 <> 0 THEN 'filtered_manual' ELSE 'stored' END AS class FROM k""", ("executions",))
def audit_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _kinds(spark, sf_dir)
    return gates.audit_classes(k, k.where("fill_id % 6 <> 5"), k.where("entry_kind = 'imported' or fill_id % 8 = 0"), "MNQ")


@query("desk_rules", """t AS (SELECT user_id AS session_id, CASE WHEN fill_id % 97 = 0 THEN NULL WHEN user_id % 4 = 0 THEN cast(fill_id % 2 AS varchar) ELSE cast(account AS varchar) END AS account FROM executions),
w AS (SELECT session_id, min(account) AS account, max(account) AS other, bool_or(account IS NULL) AS unnamed FROM t GROUP BY 1),
p AS (SELECT *, CASE WHEN account <> other THEN 'several accounts' WHEN account IS NULL OR unnamed THEN 'account missing' WHEN account = '6' THEN 'unknown account' WHEN account = '5' THEN 'unknown desk' END AS problem FROM w)
SELECT session_id, account, CASE WHEN problem IS NULL THEN 'desk' || account::INT % 2 END AS desk, CASE WHEN problem IS NULL THEN 10 + account::INT % 2 END AS max_trades, problem FROM p""", ("executions",))
def desk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = view(spark, sf_dir, "executions")
    name = F.when(F.col("fill_id") % 97 == 0, F.lit(None).cast("string")).when(F.col("user_id") % 4 == 0, (F.col("fill_id") % 2).cast("string")).otherwise(F.col("account").cast("string"))
    ids = e.select("account").distinct().where("account < 6")
    accounts = ids.select(F.col("account").cast("string").alias("account"), F.when(F.col("account") == 5, "closed").otherwise(F.concat(F.lit("desk"), (F.col("account") % 2).cast("string"))).alias("desk"))
    desks = ids.where("account < 2").select(F.concat(F.lit("desk"), F.col("account").cast("string")).alias("desk"), (10 + F.col("account")).cast("int").alias("max_trades"))
    return gates.desk_rules(e.select(F.col("user_id").alias("session_id"), name.alias("account")), accounts, desks)


@query("keep_status", "r AS (SELECT fill_id AS trade_id, CASE fill_id % 5 WHEN 0 THEN 'rejected' WHEN 1 THEN 'confirmed' WHEN 2 THEN NULL END AS before FROM executions) SELECT trade_id, coalesce(before, 'proposed') AS status FROM r", ("executions",))
def keep_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = view(spark, sf_dir, "executions").select(F.col("fill_id").alias("trade_id"))
    before = t.where("trade_id % 5 < 3").withColumn("status", F.when(F.col("trade_id") % 5 == 0, "rejected").when(F.col("trade_id") % 5 == 1, "confirmed"))
    return lookup.keep_status(t, before)


@query("replace_rule_checks", """o AS (SELECT user_id AS session_id, 'R' || event_id % 3 AS rule, event_id AS row_no, 'old' AS status FROM events WHERE event_id % 2 = 0), n AS (SELECT user_id AS session_id, 'R' || event_id % 3 AS rule, event_id AS row_no, 'new' AS status FROM events WHERE event_id % 2 = 1 AND user_id % 3 = 0),
a AS (SELECT * FROM o WHERE session_id NOT IN (SELECT session_id FROM n) UNION ALL SELECT * FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY session_id, rule ORDER BY row_no DESC) AS rn FROM a) SELECT session_id, rule, row_no, status FROM r WHERE rn = 1""")
def replace_rule_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base(spark, sf_dir, "events")

    def rows(df: DataFrame, status: str) -> DataFrame:
        return df.select(F.col("user_id").alias("session_id"), F.concat(F.lit("R"), (F.col("event_id") % 3).cast("string")).alias("rule"), F.col("event_id").alias("row_no"), F.lit(status).alias("status"))

    every = ledger.replace_keys(rows(e.where("event_id % 2 = 0"), "old"), rows(e.where("event_id % 2 = 1 and user_id % 3 = 0"), "new"), ["session_id"])
    return ledger.last_row(every, ["session_id", "rule"], "row_no")


def _bad(v: str) -> str:
    return f"""{v}w AS (SELECT *, row_number() OVER o AS i, count(*) OVER (PARTITION BY user_id) AS n, first_value(y) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS a,
  last_value(y) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS b, max(y) OVER (o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later, min(y) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier
  FROM {v} WINDOW o AS (PARTITION BY user_id ORDER BY x_us, event_id)),
{v}k AS (SELECT user_id, event_id, x_us, y FROM {v}w WHERE n < 2 OR NOT CASE WHEN i = 1 THEN y > later + 3000 WHEN i = n THEN y < earlier - 3000 ELSE y < least(a, b) - 3000 OR y > greatest(a, b) + 3000 END)"""


@query("drop_outliers", f"{_bad('readings')}, {_bad('readingsk')} SELECT user_id, event_id FROM readingskk", ("readings",))
def drop_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.drop_outliers(view(spark, sf_dir, "readings"), ["user_id"], "x_us", "y", 3000, "event_id").select("user_id", "event_id")


@query("first_per_trade", "r AS (SELECT user_id AS trade_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) SELECT trade_id, event_id FROM r WHERE rn = 1")
def first_per_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.first_row(base(spark, sf_dir, "events").select(F.col("user_id").alias("trade_id"), "event_id", "ts"), ["trade_id"], ["ts", "event_id"]).select("trade_id", "event_id")


@query("gap_lists", """g AS (SELECT user_id, list(DISTINCT event_type ORDER BY event_type) AS a, list(DISTINCT 'ocr: ' || event_type ORDER BY 'ocr: ' || event_type) FILTER (WHERE event_id % 2 = 0) AS b FROM events GROUP BY 1)
SELECT user_id, array_to_string(list_sort(list_distinct(list_concat(a, coalesce(b, [])))), ',') AS joined, array_to_string(list_sort(list_distinct(list_concat(list_filter(list_concat(a, coalesce(b, [])), lambda x: NOT starts_with(x, 'ocr: ')), ['ocr: none']))), ',') AS replaced FROM g""")
def gap_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = base(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("a"), F.collect_set(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("ocr: "), "event_type"))).alias("b"))
    joined = gates.union_gaps(F.col("a"), F.col("b"))
    return g.select("user_id", F.array_join(joined, ",").alias("joined"), F.array_join(gates.replace_gaps(joined, "ocr: ", F.array(F.lit("ocr: none"))), ",").alias("replaced"))


@query("recording_names", """n AS (SELECT event_id, CASE WHEN event_id % 6 = 5 THEN 'clip.mkv' ELSE 'user' || user_id || ' ' || strftime(ts, '%Y-%m-%d %H-%M-%S') || '.mkv' END AS name, date_trunc('second', ts) AS ts, user_id FROM events)
SELECT event_id, CASE WHEN event_id % 6 <> 5 THEN strftime(ts, '%Y-%m-%d_%H%M%S') END AS session_id, CASE WHEN event_id % 6 <> 5 THEN 'user' || user_id || ' ' END AS prefix FROM n""")
def recording_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("event_id") % 6 == 5, "clip.mkv").otherwise(F.concat(F.lit("dir/user"), F.col("user_id").cast("string"), F.lit(" "), F.date_format("ts", "yyyy-MM-dd HH-mm-ss"), F.lit(".mkv")))
    got = gates.recording_name(F.col("name"))
    return base(spark, sf_dir, "events").select("event_id", name.alias("name")).select("event_id", got["session_id"].alias("session_id"), got["prefix"].alias("prefix"))


@query("shifted_periods", """d AS (SELECT event_id, cast(ts AS date) AS day FROM events)
SELECT event_id, strftime(day - INTERVAL 21 DAY, '%G-W%V') AS week, strftime(date_trunc('month', day) + INTERVAL 2 MONTH, '%Y-%m') AS month FROM d""")
def shifted_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("ts")
    year = F.year(F.date_add(F.date_add(day, -F.weekday(day)), F.lit(3)))
    week = F.format_string("%04d-W%02d", year, F.weekofyear(day))
    e = base(spark, sf_dir, "events").select("event_id", week.alias("w"), F.date_format(day, "yyyy-MM").alias("m"))
    return e.select("event_id", gates.shift_week(F.col("w"), -3).alias("week"), gates.shift_month(F.col("m"), 2).alias("month"))


@query("section_residuals", """s AS (SELECT session_id, row_no, wall_us - lag(wall_us) OVER o AS wall, video_us - lag(video_us) OVER o AS video FROM recorder_events WINDOW o AS (PARTITION BY session_id ORDER BY row_no))
SELECT session_id, row_no, abs(wall - video - CASE WHEN row_no = 2 THEN 300000 ELSE 0 END)::BIGINT AS residual_us FROM s WHERE row_no % 2 = 0""", ("recorder_events",))
def section_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second event ends a section that the event before began."""
    r = view(spark, sf_dir, "recorder_events")
    before = r.select("session_id", (F.col("row_no") + 1).alias("row_no"), F.col("wall_us").alias("wall0"), F.col("video_us").alias("video0"))
    s = r.where("row_no % 2 = 0").join(before, ["session_id", "row_no"])
    return s.select("session_id", "row_no", gates.section_residual_us(F.col("wall_us") - F.col("wall0"), F.col("video_us") - F.col("video0"), F.col("row_no") == 2, 300_000).cast("long").alias("residual_us"))


@query("anchored_verdicts", "SELECT session_id, CASE n_events % 4 WHEN 0 THEN 'clear' WHEN 1 THEN 'unverifiable' ELSE 'suspected' END AS verdict FROM clips", ("clips",))
def anchored_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "clips")
    anchors = c.where("n_events % 4 < 3").select("session_id", F.when(F.col("n_events") % 4 == 0, "verified").when(F.col("n_events") % 4 == 1, "partial").otherwise("none").alias("status"))
    return gates.anchored_verdicts(c.select("session_id", F.lit("suspected").alias("verdict")), anchors)
