"""Queries over the interval operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals, pairing
from .fixtures import view
from .pairing_queries import fifo_sql
from .registry import query

USER = ["user_id"]
EC = ("executions", "clips")


def _ec(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return view(spark, sf_dir, "executions").withColumnRenamed("session_date", "day"), view(spark, sf_dir, "clips")


@query("session_window_fills", "SELECT fill_id, session_id FROM executions e JOIN clips c ON e.user_id = c.user_id AND ts_us BETWEEN start_us - 1800000000 AND end_us + 1800000000", EC)
def session_window_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.window_fills(*_ec(spark, sf_dir), USER)


ONCE = """once AS (SELECT fill_id, session_id, away = 0 AS in_core FROM (SELECT fill_id, session_id, greatest(start_us - ts_us, ts_us - end_us, 0) AS away,
  row_number() OVER (PARTITION BY fill_id ORDER BY greatest(start_us - ts_us, ts_us - end_us, 0), start_us, session_id) AS rn
  FROM executions e JOIN clips c ON e.user_id = c.user_id AND ts_us BETWEEN start_us - 1800000000 AND end_us + 1800000000) WHERE rn = 1)"""


@query("assign_once", ONCE + " SELECT * FROM once", EC)
def assign_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.assign_once(*_ec(spark, sf_dir), USER)


OWN = """hit AS (SELECT fill_id, e.session_date AS day, session_id, start_us, c.day AS core_day FROM executions e LEFT JOIN clips c ON e.user_id = c.user_id AND ts_us >= start_us AND ts_us < end_us),
own AS (SELECT fill_id, first(session_id ORDER BY start_us, session_id) FILTER (WHERE session_id IS NOT NULL) AS owner, first(core_day ORDER BY start_us, session_id) FILTER (WHERE session_id IS NOT NULL) AS owner_day FROM hit GROUP BY fill_id),
days AS (SELECT DISTINCT fill_id, day FROM (SELECT fill_id, day FROM hit UNION ALL SELECT fill_id, core_day FROM hit WHERE core_day IS NOT NULL)),
owned AS (SELECT fill_id, day, CASE WHEN owner_day = day THEN owner END AS owner, CASE WHEN owner IS NULL THEN 'outside' WHEN owner_day = day THEN 'assigned' ELSE 'elsewhere' END AS state FROM days JOIN own USING (fill_id))"""


@query("day_ownership", OWN + " SELECT * FROM owned", EC)
def day_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.day_ownership(*_ec(spark, sf_dir), USER)


@query(
    "outside_reason",
    OWN + """, ends AS (SELECT user_id, day, min(start_us) AS f, last(end_us ORDER BY start_us, session_id) AS l FROM clips WHERE start_us < end_us GROUP BY ALL)
SELECT fill_id, CASE WHEN f IS NULL THEN 'no_core' WHEN ts_us < f THEN 'before_first' WHEN ts_us >= l THEN 'after_last' ELSE 'gap' END AS reason
FROM owned JOIN executions e USING (fill_id) LEFT JOIN ends ON ends.user_id = e.user_id AND ends.day = e.session_date WHERE state = 'outside'""",
    EC,
)
def outside_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    fills, clips = _ec(spark, sf_dir)
    outside = intervals.day_ownership(fills, clips, USER).where("state = 'outside'").select("fill_id")
    return intervals.outside_reason(fills.join(outside, "fill_id", "left_semi"), clips, USER)


@query("near_boundary", "SELECT DISTINCT fill_id, session_id FROM executions e JOIN clips c ON e.user_id = c.user_id AND (abs(ts_us - start_us) <= 10000000 OR abs(ts_us - end_us) <= 10000000)", EC)
def near_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.near_boundary(*_ec(spark, sf_dir), USER)


@query(
    "clip_overlap",
    """SELECT a.session_id, string_agg(DISTINCT b.session_id, ',' ORDER BY b.session_id) AS others FROM clips a JOIN clips b
  ON a.user_id % 10 = b.user_id % 10 AND a.session_id <> b.session_id AND a.start_us < b.end_us AND b.start_us < a.end_us AND a.start_us < a.end_us AND b.start_us < b.end_us GROUP BY 1""",
    ("clips",),
)
def clip_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps among the clips of a desk (users of the same last digit)."""
    return intervals.overlapping(view(spark, sf_dir, "clips").withColumn("desk", F.col("user_id") % 10), ["desk"])


@query(
    "neighbour_sessions",
    """SELECT session_id, unnest(generate_series(start_us // 86400000000 + 1, (end_us - 1) // 86400000000)) AS day_no FROM clips WHERE (end_us - 1) // 86400000000 > start_us // 86400000000""",
    ("clips",),
)
def neighbour_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.neighbour_sessions(view(spark, sf_dir, "clips"))


_HITS = "count(*) FILTER (WHERE n = 1) AS in_one, count(*) FILTER (WHERE n > 1) AS in_many, count(*) FILTER (WHERE n = 0) AS outside_all"


@query(
    "window_hits",
    f"hits AS (SELECT fill_id, count(session_id) AS n FROM executions e LEFT JOIN clips c ON e.user_id = c.user_id AND ts_us BETWEEN start_us - 1800000000 AND end_us + 1800000000 GROUP BY 1) SELECT {_HITS} FROM hits",
    EC,
)
def window_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.window_hits(*_ec(spark, sf_dir), USER)


@query(
    "shift_sensitivity",
    f"""sh AS (SELECT *, unnest([-6, -5, -4, -2, -1, 1, 2]) AS delta_hours FROM executions),
hits AS (SELECT delta_hours, fill_id, count(session_id) AS n FROM sh LEFT JOIN clips c ON sh.user_id = c.user_id AND ts_us + delta_hours * 3600000000 BETWEEN start_us - 1800000000 AND end_us + 1800000000 GROUP BY ALL)
SELECT delta_hours, {_HITS} FROM hits GROUP BY 1""",
    EC,
)
def shift_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.shifted_hits(*_ec(spark, sf_dir), USER)


@query(
    "audit_row",
    """ins AS (SELECT session_id, count(*) AS n_in, string_agg(DISTINCT instrument, ',' ORDER BY instrument) AS instruments FROM executions e JOIN clips c ON e.user_id = c.user_id AND ts_us BETWEEN start_us - 1800000000 AND end_us + 1800000000 GROUP BY 1),
alls AS (SELECT user_id, count(*) AS n_all FROM executions GROUP BY 1)
SELECT session_id, coalesce(n_in, 0) AS n_in, coalesce(n_all, 0) - coalesce(n_in, 0) AS n_outside, coalesce(instruments, '') AS instruments FROM clips LEFT JOIN alls USING (user_id) LEFT JOIN ins USING (session_id)""",
    EC,
)
def audit_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.session_audit(*_ec(spark, sf_dir), USER)


@query(
    "interval_union",
    """o AS (SELECT user_id, start_us, end_us, max(end_us) OVER (PARTITION BY user_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (SELECT user_id, start_us - 1800000000 AS start_us, end_us + 1800000000 AS end_us FROM clips)),
g AS (SELECT *, sum(CASE WHEN m IS NULL OR start_us > m THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS isle FROM o),
i AS (SELECT user_id, isle, count(*) AS n, max(end_us) - min(start_us) AS l FROM g GROUP BY ALL)
SELECT user_id, sum(n)::BIGINT AS n_spans, sum(l)::BIGINT AS union_us FROM i GROUP BY 1""",
    ("clips",),
)
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = view(spark, sf_dir, "clips").select("user_id", (F.col("start_us") - intervals.PAD_US).alias("start_us"), (F.col("end_us") + intervals.PAD_US).alias("end_us"))
    return intervals.union_length(padded, USER)


HOURS = (
    OWN
    + ","
    + fifo_sql("(SELECT * FROM executions)", "user_id, session_date", "ul")
    + """, ow AS (SELECT e.user_id, day, o.fill_id, owner, ts_us FROM owned o JOIN executions e USING (fill_id) WHERE state <> 'elsewhere'),
sp AS (SELECT user_id, day, owner, min(ts_us) AS a, max(ts_us) AS b, count(*) AS n FROM ow WHERE owner IS NOT NULL GROUP BY ALL),
so AS (SELECT *, max(b) OVER (PARTITION BY user_id, day ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM sp WHERE n >= 2),
h AS (SELECT user_id, day, sum(greatest(0, b - greatest(a, coalesce(m, a))))::BIGINT AS hours_us FROM so GROUP BY ALL),
pl AS (SELECT ow.user_id, ow.day, ow.owner, sp.b - sp.a AS span FROM ul JOIN ow ON ow.fill_id = ul.entry_fill_id AND ow.day = ul.session_date LEFT JOIN sp ON sp.owner = ow.owner AND sp.day = ow.day),
k AS (SELECT user_id, day, count(*) FILTER (WHERE owner IS NULL) AS outside, count(*) FILTER (WHERE owner IS NOT NULL AND coalesce(span, 0) <= 0) AS span_zero, count(*) FILTER (WHERE span > 0) AS trade_count FROM pl GROUP BY ALL),
n AS (SELECT user_id, day, count(*) AS n_cores FROM clips WHERE start_us < end_us GROUP BY ALL)"""
)


@query(
    "trading_hours",
    HOURS + """ SELECT user_id, day, coalesce(hours_us, 0) AS hours_us, trade_count, span_zero, outside, CASE WHEN coalesce(n_cores, 0) <= 0 THEN 'paused' WHEN coalesce(hours_us, 0) <= 0 THEN 'span_undefined'
  WHEN span_zero > 0 THEN 'span_zero_excluded' WHEN outside > 0 THEN 'outside_clips' END AS reason FROM k LEFT JOIN h USING (user_id, day) LEFT JOIN n USING (user_id, day)""",
    EC,
)
def trading_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    fills, clips = _ec(spark, sf_dir)
    owned = intervals.day_ownership(fills, clips, USER).where("state <> 'elsewhere'").join(fills.select("fill_id", "user_id", "ts_us"), "fill_id")
    lots = pairing.fifo_lots(fills, ["user_id", "day"]).select("user_id", "day", "entry_fill_id")
    return intervals.trading_hours(owned, clips, lots.join(owned.select("fill_id", F.col("day").alias("d")), (F.col("entry_fill_id") == F.col("fill_id")) & (F.col("day") == F.col("d"))).select("user_id", "day", "entry_fill_id"), USER)


CHAIN = """g AS (SELECT *, start_us - lag(start_us) OVER w - lag(dur_us) OVER w AS gap_us FROM recordings WINDOW w AS (PARTITION BY prefix ORDER BY start_us, rec_id)),
c AS (SELECT *, sum(CASE WHEN abs(gap_us) <= 5000000 THEN 0 ELSE 1 END) OVER (PARTITION BY prefix ORDER BY start_us, rec_id ROWS UNBOUNDED PRECEDING) AS n FROM g),
chains AS (SELECT prefix, rec_id, start_us, dur_us, gap_us, first(rec_id) OVER w AS chain, (row_number() OVER w)::INT AS part, coalesce(sum(dur_us) OVER (PARTITION BY prefix, n ORDER BY start_us, rec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_us
  FROM c WINDOW w AS (PARTITION BY prefix, n ORDER BY start_us, rec_id))"""


@query("split_chain", CHAIN + " SELECT * FROM chains", ("recordings",))
def split_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.split_chains(view(spark, sf_dir, "recordings"))


@query(
    "split_gaps",
    CHAIN + " SELECT chain, count(*) AS n_parts, last(gap_us ORDER BY abs(gap_us), gap_us) FILTER (WHERE part > 1) AS worst_gap_us FROM chains GROUP BY chain",
    ("recordings",),
)
def split_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.chain_gaps(intervals.split_chains(view(spark, sf_dir, "recordings")))
