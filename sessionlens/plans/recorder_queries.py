"""Queries over recorder logs, clock samples, days of several clips and times of fills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import guards, ledger, recorder
from ..sources import recorder_log
from .fixtures import base, view
from .registry import query

LOG = """l AS (SELECT session_id, row_no, CASE WHEN row_no % 5 = 3 THEN 'file_changed' ELSE event END AS event,
CASE WHEN row_no % 5 = 3 OR (row_no = 1 AND n_rows % 2 = 0) THEN concat('/rec/', session_id, '_', cast(row_no // 5 AS varchar), '.mkv') END AS file FROM recorder_events)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, no = view(spark, sf_dir, "recorder_events"), F.col("row_no")
    path = F.concat(F.lit("/rec/"), "session_id", F.lit("_"), F.floor(no / 5).cast("string"), F.lit(".mkv"))
    return e.select("session_id", "row_no", F.when(no % 5 == 3, "file_changed").otherwise(F.col("event")).alias("event"), F.when((no % 5 == 3) | ((no == 1) & (F.col("n_rows") % 2 == 0)), path).alias("file"))


@query("events_of_files", LOG + """, o AS (SELECT session_id, min_by(file, row_no) AS first_file FROM l WHERE file IS NOT NULL GROUP BY 1),
h AS (SELECT l.session_id, l.row_no, l.event, l.file, coalesce((SELECT max_by(x.file, x.row_no) FROM l x WHERE x.session_id = l.session_id AND x.row_no <= l.row_no AND x.file IS NOT NULL), first_file) AS held
  FROM l LEFT JOIN o ON o.session_id = l.session_id),
v AS (SELECT DISTINCT session_id, concat(session_id, '_', cast(k AS varchar), '.mkv') AS name FROM (SELECT DISTINCT session_id FROM l), (VALUES (0), (1)) t(k))
SELECT h.session_id, name, row_no, event FROM h JOIN v ON v.session_id = h.session_id WHERE event <> 'file_changed' AND (held IS NULL OR held = concat('/rec/', name))""", ("recorder_events",))
def events_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    numbered = log.select("session_id").distinct().select("session_id", F.explode(F.array(F.lit("0"), F.lit("1"))).alias("no"))
    videos = numbered.select("session_id", F.concat(F.lit("/video/"), "session_id", F.lit("_"), "no", F.lit(".mkv")).alias("name"))
    return recorder.events_of_files(log, videos)


@query("log_counts", """c AS (SELECT CASE n_events % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'missing' WHEN 2 THEN 'other' END AS state FROM clips)
SELECT s AS state, count(c.state) AS n FROM (VALUES ('ok'), ('missing'), ('invalid_json')) t(s) LEFT JOIN c ON c.state = s GROUP BY s""", ("clips",))
def log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_events") % 4
    return recorder.log_counts(view(spark, sf_dir, "clips").select(F.when(n == 0, "ok").when(n == 1, "missing").when(n == 2, "other").alias("state")))


@query("sample_times", """c AS (SELECT session_id, CASE WHEN n_events % 5 <> 4 THEN (end_us - start_us - 1000000) / 1e6::DOUBLE END AS d FROM clips)
SELECT session_id, i, least(1.0::DOUBLE, d / 4) + i * greatest(d - least(1.0::DOUBLE, d / 4) * 2, 0.0) / 7 AS t FROM c, range(8) r(i) WHERE d >= 0""", ("clips",))
def sample_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.when(F.col("n_events") % 5 != 4, (F.col("end_us") - F.col("start_us") - 1_000_000) / 1e6)
    return view(spark, sf_dir, "clips").select("session_id", F.posexplode(recorder.sample_times(d)).alias("i", "t")).withColumn("i", F.col("i").cast("long"))


@query("resolve_clock", """s AS (SELECT user_id, n, event_id, t_us AS wall_us, CASE WHEN event_id % 3 = 0 THEN 60 ELSE 1 END AS r FROM clip_events),
f AS (SELECT user_id, n, count(*) FILTER (r = 1) AS a, count(*) FILTER (r = 60) AS b FROM s GROUP BY 1, 2), g AS (SELECT user_id, n, CASE WHEN a >= 2 THEN 1 WHEN b >= 2 THEN 60 END AS file_resolution_s FROM f)
SELECT event_id, CASE WHEN file_resolution_s = 60 AND r = 1 THEN wall_us - wall_us % 60000000 ELSE wall_us END AS wall_us, file_resolution_s, CASE WHEN file_resolution_s = 1 AND r = 60 THEN 'resolution_mismatch' END AS reason
FROM s JOIN g ON g.user_id = s.user_id AND g.n = s.n""", ("clip_events",))
def resolve_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "clip_events").select("user_id", "n", "event_id", F.col("t_us").alias("wall_us"), F.when(F.col("event_id") % 3 == 0, 60).otherwise(1).alias("resolution_s"))
    return recorder.resolve_clock(s, ["user_id", "n"]).select("event_id", "wall_us", "file_resolution_s", "reason")


@query("near_dates", """d AS (SELECT DISTINCT day FROM clips WHERE extract(day FROM day) % 4 = 0), f AS (SELECT fill_id, CASE WHEN fill_id % 11 <> 0 THEN session_date END AS c FROM executions)
SELECT day, fill_id FROM f JOIN d ON abs(date_diff('day', c, day)) <= 1""", ("clips", "executions"))
def near_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    fills = view(spark, sf_dir, "executions").select("fill_id", F.when(F.col("fill_id") % 11 != 0, F.col("session_date")).alias("civil_date"))
    return recorder.near_dates(fills, view(spark, sf_dir, "clips").where("extract(day from day) % 4 = 0").select("day").distinct()).select("day", "fill_id")


@query("trades_of_fills", "t AS (SELECT fill_id AS trade_id, CASE WHEN fill_id % 9 <> 0 THEN fill_id + 1 END AS e FROM executions) SELECT trade_id FROM t WHERE e IN (SELECT fill_id FROM executions WHERE side = 'buy')", ("executions",))
def trades_of_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = view(spark, sf_dir, "executions")
    trades = e.select(F.col("fill_id").alias("trade_id"), F.when(F.col("fill_id") % 9 != 0, F.col("fill_id") + 1).alias("entry_fill_id"))
    return recorder.trades_of_fills(trades, e.where("side = 'buy'")).select("trade_id")


PATHS = """c AS (SELECT session_id, user_id, day, end_us, n_events % 3 = 0 AS odd, CASE WHEN n_events % 6 = 1 THEN 'suspected' WHEN n_events % 6 = 2 THEN 'clear' END AS verdict FROM clips),
p AS (SELECT user_id, day, count(*) >= 2 OR count(*) FILTER (verdict = 'suspected') > 0 AS day_path FROM c GROUP BY 1, 2)"""


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, day = F.col("n_events"), F.concat_ws(":", "user_id", F.col("day").cast("string"))
    return view(spark, sf_dir, "clips").select("session_id", day.alias("day"), "start_us", "end_us", F.when(n % 3 == 0, 60).otherwise(1).alias("resolution_s"), F.when(n % 6 == 1, "suspected").when(n % 6 == 2, "clear").alias("verdict"))


@query("day_paths", PATHS + " SELECT concat(cast(user_id AS varchar), ':', cast(day AS varchar)) AS day, day_path FROM p", ("clips",))
def day_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recorder.day_paths(_clips(spark, sf_dir))


@query("outside_flags", PATHS + """, t AS (SELECT event_id AS trade_id, concat(cast(user_id AS varchar), '-', cast(n AS varchar)) AS session_id, t_us + event_id % 5 * 1800000000 AS exit_us FROM clip_events)
SELECT trade_id, CASE WHEN day_path AND exit_us >= end_us THEN 'exit_outside_clip' END AS gap, odd AS low FROM t JOIN c ON c.session_id = t.session_id JOIN p ON p.user_id = c.user_id AND p.day = c.day""", ("clips", "clip_events"))
def outside_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = _clips(spark, sf_dir)
    exits = F.col("t_us") + F.col("event_id") % 5 * 1_800_000_000
    trades = view(spark, sf_dir, "clip_events").select(F.col("event_id").alias("trade_id"), F.concat_ws("-", "user_id", F.col("n").cast("string")).alias("session_id"), exits.alias("exit_us"))
    return recorder.outside_flags(trades, clips, recorder.day_paths(clips))


@query("attach_dates", """f AS (SELECT fill_id, CASE WHEN fill_id % 4 = 3 THEN concat('x', cast(fill_id AS varchar)) ELSE concat('tv:', cast(fill_id + 1 AS varchar), ':', side) END AS id, CASE WHEN fill_id % 3 = 0 THEN session_date END AS c FROM executions)
SELECT f.id AS fill_id, coalesce(c, e.session_date) AS civil_date FROM f LEFT JOIN executions e ON e.fill_id = CASE WHEN f.fill_id % 4 <> 3 THEN f.fill_id + 1 END""", ("executions",))
def attach_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = view(spark, sf_dir, "executions"), F.col("fill_id")
    name = F.when(n % 4 == 3, F.concat(F.lit("x"), n.cast("string"))).otherwise(F.concat(F.lit("tv:"), (n + 1).cast("string"), F.lit(":"), "side"))
    fills = e.select(name.alias("fill_id"), F.when(n % 3 == 0, F.col("session_date")).alias("civil_date"))
    return recorder.attach_dates(fills, e.select(n.alias("row_no"), F.col("session_date").alias("civil_date")))


@query("entry_times", """t AS (SELECT event_id AS trade_id, concat(cast(user_id AS varchar), '-', cast(n AS varchar)) AS session_id, CASE WHEN event_id % 4 <> 0 THEN t_us END AS entry_us, event_id * 1000 AS window_us FROM clip_events)
SELECT trade_id, coalesce(round((entry_us - start_us - CASE WHEN n_events % 2 = 0 THEN n_events * 1000 ELSE 0 END) / (1 + coalesce(CASE WHEN n_events % 3 <> 0 THEN (n_events % 7 - 3) * 0.5 END, 0)::DOUBLE / 3600))::BIGINT, window_us + 180000000) AS entry_video_us FROM t LEFT JOIN (SELECT * FROM clips WHERE n_events % 5 <> 0) c ON c.session_id = t.session_id""", ("clips", "clip_events"))
def entry_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    trades = view(spark, sf_dir, "clip_events").select(n.alias("trade_id"), F.concat_ws("-", "user_id", F.col("n").cast("string")).alias("session_id"), F.when(n % 4 != 0, F.col("t_us")).alias("entry_us"), (n * 1000).alias("window_us"))
    sessions = view(spark, sf_dir, "clips").where("n_events % 5 <> 0").select("session_id", "start_us", F.when(F.col("n_events") % 2 == 0, F.col("n_events") * 1000).alias("offset_us"), F.when(F.col("n_events") % 3 != 0, (F.col("n_events") % 7 - 3) * F.lit(0.5)).alias("drift"))
    return recorder.entry_times(trades, sessions)


@query("replace_checks", """a AS (SELECT user_id, event_type AS rule, event_id, value FROM clip_events), n AS (SELECT * FROM a WHERE user_id % 3 = 0 AND event_id % 2 = 0),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id, rule ORDER BY event_id DESC) AS k FROM n)
SELECT user_id, rule, event_id FROM a WHERE user_id NOT IN (SELECT user_id FROM n) UNION ALL SELECT user_id, rule, event_id FROM l WHERE k = 1""", ("clip_events",))
def replace_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "clip_events").select("user_id", F.col("event_type").alias("rule"), "event_id")
    new = ledger.last_row(rows.where("user_id % 3 = 0 and event_id % 2 = 0"), ["user_id", "rule"], "event_id")
    return ledger.replace_keys(rows, new, ["user_id"])


LINES = """k AS (SELECT session_id, row_no, event, wall_us, video_us, row_no % 17 = 16 AS broken, row_no % 3 = 0 AS old FROM recorder_events)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    no = F.col("row_no")
    file, wall = F.concat(F.lit("/r/"), "session_id", F.lit(".mkv")), F.col("wall_us").cast("string")
    held = F.to_json(F.struct("event", F.when(no % 3 != 0, wall).alias("wall"), F.when(no % 3 == 0, wall).alias("ts"), (F.col("video_us") / 1e6).alias("video_s"), file.alias("file")))
    return view(spark, sf_dir, "recorder_events").select("session_id", "row_no", F.when(no % 17 == 16, "{broken").otherwise(held).alias("line"))


@query("log_events", LINES + " SELECT session_id, row_no, event, cast(wall_us AS varchar) AS wall, video_us / 1e6::DOUBLE AS video_s, concat(session_id, '.mkv') AS file FROM k WHERE NOT broken", ("recorder_events",))
def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recorder_log.log_events(_lines(spark, sf_dir))


@query("log_states", LINES + """, s AS (SELECT session_id, bool_or(broken) AS b FROM k WHERE length(session_id) % 2 = 0 GROUP BY 1)
SELECT c.session_id, CASE WHEN b THEN 'invalid_json' WHEN NOT b THEN 'ok' ELSE 'missing' END AS state FROM clips c LEFT JOIN s ON s.session_id = c.session_id""", ("clips", "recorder_events"))
def log_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recorder_log.log_states(view(spark, sf_dir, "clips"), _lines(spark, sf_dir).where("length(session_id) % 2 = 0"))


@query("tag_rows", """SELECT CASE WHEN fill_id % 7 = 0 THEN '2024-01-01' ELSE cast(session_date AS varchar) END AS date, instrument AS symbol, side, cast(price_ticks AS varchar) AS price,
CASE WHEN fill_id % 5 = 0 THEN '1' ELSE cast(qty AS varchar) END AS quantity, CASE WHEN fill_id % 2 = 0 THEN 'a,b' ELSE 'a' END AS tags, concat('trade ', cast(fill_id AS varchar)) AS notes FROM executions WHERE fill_id % 3 <> 0""", ("executions",))
def tag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = view(spark, sf_dir, "executions"), F.col("fill_id")
    proposals = e.select(n.alias("trade_id"), F.when(n % 3 == 0, "rejected").when(n % 3 == 1, "open").alias("status"), F.when(n % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("tags"))
    trades = e.select(
        n.alias("trade_id"), F.lit("2024-01-01_a").alias("session_id"), F.when(n % 7 != 0, F.col("session_date")).alias("session_date"), "instrument", "side",
        F.col("price_ticks").cast("decimal(18,1)").alias("price"), F.when(n % 5 != 0, F.col("qty")).alias("qty"),
    )
    return recorder_log.tag_rows(proposals, trades)


@query("mapped_samples", """t AS (SELECT event_id, event_id % 11 AS k, epoch_us(ts) AS w, event_id % 5 * 1000000 AS v FROM events)
SELECT event_id AS sample_id, CASE WHEN k > 1 THEN w - w % 1000000 - (w - 7000000 + v) END AS y_us, CASE WHEN k > 1 THEN 1 END AS resolution, CASE WHEN k = 0 THEN 'unparseable' END AS reason FROM t""")
def mapped_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, ts = F.col("event_id"), F.col("ts")
    text = F.when(n % 11 == 0, "no clock").when(n % 11 == 1, "").otherwise(F.date_format(ts, "HH:mm:ss"))
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return recorder.mapped_samples(base(spark, sf_dir, "events").select(n.alias("sample_id"), text.alias("text"), F.lit(1.0).alias("confidence"), (us - 7_000_000).alias("start_us"), (n % 5 * 1_000_000).alias("video_us")))


@query("allowed_ids", """c AS (SELECT concat(cast(user_id AS varchar), '-', cast(n AS varchar)) AS session_id, event_id, event_type FROM clip_events),
u AS (SELECT session_id, cast(event_id AS varchar) AS id, 0 AS kind FROM c WHERE event_type = 'click' UNION ALL SELECT session_id, event_type, 1 FROM c UNION ALL SELECT session_id, session_id, 2 FROM c UNION ALL SELECT session_id, cast(event_id AS varchar), 3 FROM c),
o AS (SELECT session_id, id, min(kind) AS kind FROM u GROUP BY 1, 2) SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY kind, id) AS place FROM o""", ("clip_events",))
def allowed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "clip_events").withColumn("session_id", F.concat_ws("-", "user_id", F.col("n").cast("string")))
    return recorder.allowed_ids([c.where("event_type = 'click'").select("session_id", F.col("event_id").alias("id")), c.select("session_id", F.col("event_type").alias("id")), c.select("session_id", F.col("session_id").alias("id")), c.select("session_id", F.col("event_id").alias("id"))])


@query("note_problems", """c AS (SELECT event_id AS note_id, user_id AS session_id, CASE WHEN event_id % 13 = 0 THEN ' ' ELSE concat('at ', cast(event_id % 10 AS varchar)) END AS text, event_id % 7 AS f, event_id % 4 AS k FROM clip_events),
r AS (SELECT *, CASE WHEN trim(text) = '' THEN 'empty' WHEN note_id % 10 = session_id % 10 THEN 'number' WHEN f > 4 THEN 'frame' WHEN k = 3 THEN 'clip' END AS reason FROM c)
SELECT note_id, reason, CASE reason WHEN 'number' THEN cast(note_id % 10 AS varchar) WHEN 'frame' THEN concat('f', cast(f AS varchar)) WHEN 'clip' THEN 'c3' END AS item FROM r WHERE reason IS NOT NULL""", ("clip_events",))
def note_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = view(spark, sf_dir, "clip_events"), F.col("event_id")
    text = F.when(n % 13 == 0, " ").otherwise(F.concat(F.lit("at "), (n % 10).cast("string")))
    notes = c.select(n.alias("note_id"), F.col("user_id").alias("session_id"), text.alias("text"), F.array(F.lit("f1"), F.concat(F.lit("f"), (n % 7).cast("string"))).alias("frames"), F.concat(F.lit("c"), (n % 4).cast("string")).alias("clip"))
    users = c.select(F.col("user_id").alias("session_id")).distinct()

    def known(prefix: str, count: int) -> DataFrame:
        return users.select("session_id", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("i")).select("session_id", F.concat(F.lit(prefix), F.col("i").cast("string")).alias("item"))

    return guards.note_problems(notes, known("", 10).where("cast(item as int) <> session_id % 10"), known("f", 5), known("c", 3))


@query("guard_stated", """s AS (SELECT session_id, seg, turn, text, CASE turn % 3 WHEN 0 THEN 'entry' ELSE 'stop' END AS field, left(text, 12) AS head FROM segments),
v AS (SELECT session_id, turn AS trade_id, field, turn % 5 = 4 AS gone, CASE WHEN turn % 4 = 3 THEN concat(head, '~#~') ELSE head END AS value, text, turn FROM s)
SELECT session_id, trade_id, field, CASE WHEN NOT gone AND value <> '' AND contains(text, value) THEN value END AS value,
CASE WHEN gone THEN 'no_segment' WHEN NOT coalesce(value <> '' AND contains(text, value), false) THEN 'not_found' WHEN turn % 2 = 1 THEN 'outside_window' END AS reason FROM v""", ("segments",))
def guard_stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, turn = view(spark, sf_dir, "segments"), F.col("turn")
    head = F.left("text", F.lit(12))
    stated = s.select("session_id", turn.alias("trade_id"), F.when(turn % 3 == 0, "entry").otherwise("stop").alias("field"), F.when(turn % 5 == 4, "none").otherwise(F.col("seg")).alias("seg"), F.when(turn % 4 == 3, F.concat(head, F.lit("~#~"))).otherwise(head).alias("value"))
    return guards.guard_stated(stated, s.select("session_id", "seg", "text"), s.where(turn % 2 == 0).select("session_id", turn.alias("trade_id"), "seg"), normalise=False)
