"""Queries over manifests, debriefs and review packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import packs
from .fixtures import base, view
from .registry import query


def _fit(method: str, n: Column) -> Column:
    return F.struct(F.lit(method).alias("method"), (n * 0.5).alias("offset_s"), (n % 3 * 0.25).alias("drift_s_per_h"), (n % 10 / 10).alias("confidence"))


@query(
    "manifest_rows",
    """k AS (SELECT * FROM clips WHERE n_events % 5 <> 0 AND n_events % 7 <> 3), g AS (SELECT concat(user_id, '-', n) AS session_id, (value - 50) AS gap_s, event_id FROM clip_events WHERE event_id % 3 = 0),
w AS (SELECT session_id, gap_s FROM g QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY abs(gap_s) DESC, gap_s DESC) = 1)
SELECT c.session_id, CASE WHEN c.n_events % 2 = 0 THEN c.session_id || '.mkv' ELSE 'named.mkv' END AS filename, c.start_us, c.end_us, round((c.end_us - c.start_us) / 1000000, 6) AS duration_s, gap_s AS stitched_gap_s,
  CASE WHEN k.session_id IS NOT NULL AND c.n_events % 2 = 0 THEN 'manual' WHEN c.n_events % 4 <> 1 THEN 'ocr_clock' END AS alignment_method,
  CASE WHEN (k.session_id IS NOT NULL AND c.n_events % 2 = 0) OR c.n_events % 4 <> 1 THEN c.n_events % 10 / 10.0 END::DOUBLE AS alignment_confidence,
  CASE WHEN k.session_id IS NOT NULL THEN CASE WHEN c.n_events % 3 = 0 THEN 'suspected' ELSE 'clear' END END AS pause_check, CASE WHEN k.session_id IS NOT NULL THEN c.n_events END::DOUBLE AS pause_total_s,
  CASE WHEN k.session_id IS NULL THEN 'no pause check of this recording' END AS problem
FROM clips c LEFT JOIN k USING (session_id) LEFT JOIN w ON w.session_id = c.session_id""",
    ("clips", "clip_events"),
)
def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of every fifth clip are missing, of some others they are of an older recording; even clips have a fit from before."""
    n = F.col("n_events")
    c = view(spark, sf_dir, "clips").withColumns({
        "filename": F.when(n % 2 == 1, "named.mkv").otherwise(""), "path": F.concat(F.lit("a/b/"), "session_id", F.lit(".mkv")), "duration_s": F.round((F.col("end_us") - F.col("start_us")) / 1_000_000, 6),
        "sha": F.sha1("session_id"), "parts": n, "alignment": F.when(n % 4 != 1, _fit("ocr_clock", n)),
    })
    checks = c.where("n_events % 5 <> 0").select(
        "session_id", F.when(n % 7 == 3, "old").otherwise(F.col("sha")).alias("sha"), "parts", (F.col("duration_s") + 1e-7).alias("duration_s"), F.when(n % 3 == 0, "suspected").otherwise("clear").alias("pause_check"),
        n.cast("double").alias("pause_total_s"), F.lit(1.0).alias("clock_resolution_s"), F.lit(30.0).alias("pause_detectable_from_s"), F.when(n % 2 == 0, _fit("manual", n)).alias("fit_before"),
    )
    gaps = view(spark, sf_dir, "clip_events").where("event_id % 3 = 0").select(F.concat_ws("-", "user_id", "n").alias("session_id"), (F.col("value") - 50).alias("gap_s"))
    out = packs.manifest_rows(c, checks, gaps)
    return out.select("session_id", "filename", "start_us", "end_us", "duration_s", "stitched_gap_s", "alignment_method", "alignment_confidence", "pause_check", "pause_total_s", "problem")


@query(
    "debrief_lines",
    """s AS (SELECT session_id, n_events FROM clips), e AS (SELECT concat(user_id, '-', n) AS session_id, * EXCLUDE (user_id, n) FROM clip_events),
al AS (SELECT session_id, unnest(regexp_extract_all(session_id, '[0-9]+')) AS run FROM s UNION SELECT session_id, event_id::VARCHAR FROM e WHERE event_id % 4 <> 0 UNION SELECT session_id, '5' FROM s),
t AS (SELECT session_id, 'trades' AS part, 'T' || event_id AS o, '| T' || event_id || ' | ' || CASE WHEN event_id % 2 = 0 THEN 'long' ELSE '' END || ' | MNQ | 5 |  | ' || CASE WHEN event_id % 3 = 0 THEN '' ELSE '5' END || ' | ' || CASE WHEN event_id % 5 = 0 THEN 'clip' ELSE '' END || ' |' AS line, [event_id::VARCHAR, '5'] AS runs FROM e WHERE event_type = 'purchase'),
r AS (SELECT DISTINCT session_id, 'rules' AS part, event_type AS o, '- ' || event_type || ': pass' AS line, []::VARCHAR[] AS runs FROM e WHERE event_type <> 'purchase'),
g AS (SELECT session_id, 'gaps' AS part, printf('%010d', event_id) AS o, '- gap ' || event_id AS line, [event_id::VARCHAR] AS runs FROM e WHERE event_type = 'error'),
x AS (SELECT session_id, 'source' AS part, '1' AS o, 'Session ' || session_id || '.' AS line, regexp_extract_all(session_id, '[0-9]+') AS runs FROM s UNION ALL SELECT session_id, 'source', '2', 'Language de.', [] FROM s UNION ALL FROM t UNION ALL FROM r UNION ALL FROM g),
kept AS (SELECT session_id, part, o, line FROM x WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(x.runs) AS run) q WHERE NOT EXISTS (SELECT 1 FROM al WHERE al.session_id = x.session_id AND al.run = q.run))),
said AS (SELECT session_id, 'source' AS part, '9' AS o, CASE WHEN session_id IN (SELECT session_id FROM t) THEN 'Trades file present.' ELSE 'No trades file.' END AS line FROM s
  UNION ALL SELECT session_id, 'trades', '', CASE WHEN session_id IN (SELECT session_id FROM t) THEN '| Trade | Side | Instrument | Entry | Exit | PnL | Clip |' ELSE 'No trades.' END FROM s
  UNION ALL SELECT session_id, 'rules', '', CASE WHEN session_id IN (SELECT session_id FROM r) THEN 'Rules recorded.' ELSE 'No rules file.' END FROM s WHERE session_id NOT IN (SELECT session_id FROM kept WHERE part = 'rules')
  UNION ALL SELECT session_id, 'gaps', '', 'None.' FROM s WHERE session_id NOT IN (SELECT session_id FROM kept WHERE part = 'gaps'))
SELECT session_id, part, row_number() OVER (PARTITION BY session_id, part ORDER BY o, line)::INTEGER AS no, line FROM (FROM kept UNION ALL FROM said)""",
    ("clips", "clip_events"),
)
def debrief_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = view(spark, sf_dir, "clips")
    n = F.col("event_id")
    e = view(spark, sf_dir, "clip_events").withColumn("session_id", F.concat_ws("-", "user_id", "n"))
    sessions = clips.select("session_id", F.lit("de").alias("language"))
    none = F.lit(None).cast("double")
    trades = e.where("event_type = 'purchase'").select(
        "session_id", F.when(n % 7 == 0, "").otherwise(F.concat(F.lit("T"), n)).alias("tva_trade_id"), F.concat(F.lit("T"), n).alias("trade_id"), F.when(n % 2 == 0, "long").alias("direction"), F.lit("MNQ").alias("instrument"),
        F.lit(5.0).alias("entry_price"), none.alias("exit_price"), F.when(n % 3 == 1, F.lit(5.0)).when(n % 3 == 2, F.lit(float("nan"))).alias("net_pnl_currency"), F.when(n % 3 == 2, F.lit(5.0)).alias("gross_pnl_currency"),
    )
    cuts = e.where("event_type = 'purchase' and event_id % 5 = 0").select("session_id", F.concat(F.lit("T"), n).alias("tva_trade_id"))
    rules = e.where("event_type <> 'purchase'").select("session_id", F.col("event_type").alias("rule"), F.lit("pass").alias("status"), F.lit(None).cast("string").alias("label")).distinct()
    gaps = e.where("event_type = 'error'").select("session_id", n.alias("no"), F.concat(F.lit(" gap "), n).alias("gap"))
    allowed = clips.select("session_id", F.explode(F.regexp_extract_all("session_id", F.lit(r"\d+"), F.lit(0))).alias("run")).unionByName(e.where("event_id % 4 <> 0").select("session_id", n.cast("string").alias("run")))
    return packs.debrief_lines(sessions, trades, cuts, rules, gaps, allowed.unionByName(clips.select("session_id", F.lit("5").alias("run"))))


PACK = """s AS (SELECT session_id, day AS session_date FROM clips), w AS (SELECT * FROM s WHERE session_date >= (SELECT date_trunc('week', max(session_date))::DATE - 7 FROM s)),
t AS (SELECT concat(user_id, '-', n) AS session_id, event_id, event_type, event_id % 3 AS m FROM clip_events),
d AS (SELECT 'c' || conv_id AS k, conv_id, coalesce(string_agg(text, ' ' ORDER BY turn), '') AS text FROM conversations GROUP BY conv_id),
ds AS (SELECT session_id, text, session_date FROM (SELECT *, row_number() OVER (ORDER BY session_id) AS i FROM w) JOIN (SELECT text, row_number() OVER (ORDER BY conv_id) AS i FROM d) USING (i) QUALIFY row_number() OVER (ORDER BY session_date DESC, session_id DESC) <= 2),
facts AS (SELECT 'session' AS kind, session_id AS id, session_id, '' AS text FROM w
  UNION ALL SELECT 'trade', session_id || ':T' || event_id, session_id, 'setup ' || m || '|||' || event_type || '|' || CASE WHEN m = 0 THEN 'true' ELSE '' END FROM t WHERE session_id IN (SELECT session_id FROM w)
  UNION ALL SELECT DISTINCT 'rule', session_id || ':' || event_type, session_id, 'pass|' FROM t WHERE session_id IN (SELECT session_id FROM w)
  UNION ALL SELECT 'debrief', session_id, session_id, text FROM ds
  UNION ALL SELECT 'experiment', 'e' || min(o_orderkey), NULL, 'change|||running' FROM orders WHERE o_orderstatus = 'P' AND o_orderdate = (SELECT max(o_orderdate) FROM orders WHERE o_orderstatus = 'P'))"""


def _pack(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    sessions = view(spark, sf_dir, "clips").select("session_id", F.col("day").alias("session_date"))
    n = F.col("event_id")
    e = view(spark, sf_dir, "clip_events").withColumn("session_id", F.concat_ws("-", "user_id", "n"))
    trades = e.select("session_id", F.concat(F.lit("T"), n).alias("tva_trade_id"), F.concat(F.lit("setup "), n % 3).alias("stated_setup"), F.lit(None).cast("string").alias("stated_playbook"), F.lit("").alias("lab_token"), F.col("event_type").alias("tag_alignment"), F.when(n % 3 == 0, F.lit(True)).alias("stated_lab_agree"))
    rules = e.select("session_id", F.col("event_type").alias("rule"), F.lit("pass").alias("status"), F.lit(None).cast("string").alias("reason")).distinct()
    # The sessions of the last two weeks, by id, get the conversations as debriefs.
    from ..operators.ledger import trailing_weeks

    late = trailing_weeks(sessions, 2).select("session_id").withColumn("i", F.row_number().over(Window.orderBy("session_id")))
    told = base(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("text")).withColumn("i", F.row_number().over(Window.orderBy("conv_id")))
    debriefs = late.join(told, "i").select("session_id", "text")
    o = base(spark, sf_dir, "orders")
    experiments = o.select(F.concat(F.lit("e"), "o_orderkey").alias("id"), F.lit("change").alias("rule_change"), F.lit("").alias("start"), F.lit("").alias("stop_criterion"), F.when(F.col("o_orderstatus") == "P", "running").otherwise("done").alias("status"), F.concat(F.col("o_orderdate").cast("string"), F.format_string("%012d", F.lit(10**11) - F.col("o_orderkey"))).alias("created_at"))
    return packs.review_pack(sessions, trades, rules, debriefs, experiments, 2, 3, "2026-01-05")


@query("review_facts", PACK + " SELECT * FROM facts", ("clips", "clip_events"))
def review_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pack(spark, sf_dir)[0]


@query("review_runs", PACK + """, b AS (SELECT id || ' ' || text AS bit FROM facts UNION ALL SELECT '2 3 2026-01-05') SELECT DISTINCT unnest(regexp_extract_all(bit, '[0-9]+')) AS run FROM b""", ("clips", "clip_events"))
def review_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pack(spark, sf_dir)[1]


REPORT = """s AS (SELECT session_id, CASE WHEN n_events % 11 <> 0 THEN day END AS day, n_events AS trade_count, CASE WHEN n_events % 3 <> 0 THEN round((end_us - start_us) / 3600000000, 3) END AS hours FROM clips),
c AS (SELECT day, event_type AS rule, CASE event_id % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'violated' ELSE 'unverifiable' END AS status FROM clip_events),
t AS (SELECT day, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS agrees FROM clip_events),
p AS (SELECT k, CASE k WHEN 'week' THEN strftime(d, '%G-W%V') WHEN 'month' THEN strftime(d, '%Y-%m') END AS p, d FROM (SELECT DISTINCT day AS d FROM s UNION SELECT DISTINCT day FROM c UNION SELECT DISTINCT day FROM t) x, (VALUES ('week'), ('month'), ('all')) v(k) WHERE k = 'all' OR d IS NOT NULL),
sp AS (SELECT k, p, s.* FROM s JOIN p ON s.day IS NOT DISTINCT FROM p.d), cp AS (SELECT k, p, c.* FROM c JOIN p ON c.day IS NOT DISTINCT FROM p.d), tp AS (SELECT k, p, t.* FROM t JOIN p ON t.day IS NOT DISTINCT FROM p.d),
r AS (SELECT k AS period_kind, p AS period, what, NULL::VARCHAR AS name, n, NULL::BIGINT AS passed, NULL::BIGINT AS violated, NULL::BIGINT AS unverifiable, NULL::DOUBLE AS rate FROM (
    SELECT k, p, 'sessions' AS what, count(*)::DOUBLE AS n FROM sp GROUP BY ALL UNION ALL SELECT k, p, 'trades', sum(trade_count)::DOUBLE FROM sp GROUP BY ALL UNION ALL SELECT k, p, 'hours', sum(coalesce(hours, 0))::DOUBLE FROM sp GROUP BY ALL
    UNION ALL SELECT k, p, 'violations', count(*) FILTER (WHERE status = 'violated')::DOUBLE FROM cp GROUP BY ALL)
  UNION ALL SELECT k, p, 'rule', rule, count(*)::DOUBLE, count(*) FILTER (WHERE status = 'pass'), count(*) FILTER (WHERE status = 'violated'), count(*) FILTER (WHERE status = 'unverifiable'), count(*) FILTER (WHERE status = 'pass') / nullif(count(*) FILTER (WHERE status <> 'unverifiable'), 0) FROM cp GROUP BY GROUPING SETS ((k, p, rule), (k, p))
  UNION ALL SELECT k, p, 'agreement', NULL, count(*)::DOUBLE, count(*) FILTER (WHERE agrees), count(*) FILTER (WHERE NOT agrees), count(*) FILTER (WHERE agrees IS NULL), count(*) FILTER (WHERE agrees) / nullif(count(agrees), 0) FROM tp GROUP BY ALL)"""


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import ledger

    c = view(spark, sf_dir, "clips")
    sessions = c.select("session_id", F.when(F.col("n_events") % 11 != 0, F.col("day")).alias("day"), F.col("n_events").alias("trade_count"), F.when(F.col("n_events") % 3 != 0, F.round((F.col("end_us") - F.col("start_us")) / 3_600_000_000, 3)).alias("hours"))
    n = F.col("event_id")
    e = view(spark, sf_dir, "clip_events")
    checks = e.select("day", F.col("event_type").alias("rule"), F.when(n % 3 == 0, "pass").when(n % 3 == 1, "violated").otherwise("unverifiable").alias("status"))
    return ledger.period_report(sessions, checks, e.select("day", F.when(n % 4 == 0, True).when(n % 4 == 1, False).alias("agrees")))


@query("period_report", REPORT + " SELECT * FROM r", ("clips", "clip_events"))
def period_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir)


@query(
    "filled_periods",
    REPORT + """, w AS (SELECT DISTINCT date_trunc('week', day)::DATE + (7 * i)::INTEGER AS m FROM clips, range(0, 3) v(i)),
a AS (SELECT 'week' AS period_kind, strftime(m, '%G-W%V') AS period FROM w UNION SELECT 'month', strftime(m, '%Y-%m') FROM w UNION SELECT 'month', strftime(m + 6, '%Y-%m') FROM w)
SELECT a.period_kind, a.period, v.what, coalesce(r.n, 0) AS n FROM a CROSS JOIN (VALUES ('sessions'), ('trades'), ('hours'), ('violations')) v(what) LEFT JOIN r ON r.period_kind = a.period_kind AND r.period = a.period AND r.what = v.what AND r.name IS NULL""",
    ("clips", "clip_events"),
)
def filled_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each week with a session and the two after it."""
    from ..operators import ledger

    weeks = view(spark, sf_dir, "clips").select(F.explode(F.sequence(F.date_trunc("week", "day").cast("date"), F.date_add(F.date_trunc("week", "day").cast("date"), 14), F.expr("interval 7 days"))).alias("week_start")).distinct()
    return ledger.filled_periods(_report(spark, sf_dir), weeks)
