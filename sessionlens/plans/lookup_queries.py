"""Queries over lookups and keyed comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals, lookup
from .fixtures import base, view
from .interval_queries import CHAIN
from .pairing_queries import LOTS, lots
from .registry import query

E = ("executions",)
IDENT = ["user_id", "ts_us", "side", "price_ticks", "qty"]


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed and open lots with a text id."""
    return lots(spark, sf_dir).withColumn("trade_id", F.concat_ws(":", "account", "instrument", F.col("session_date").cast("string"), "lot_seq"))


TX = LOTS + ", tx AS (SELECT *, account || ':' || instrument || ':' || session_date || ':' || lot_seq AS trade_id FROM lots)"


@query("recon_fallback", TX + """ SELECT trade_id, coalesce(a.status, b.status) AS recon_status FROM tx LEFT JOIN recon a ON a.session_date = tx.session_date AND a.instrument = tx.instrument
  LEFT JOIN recon b ON b.session_date = tx.session_date AND b.instrument = ''""", ("executions", "recon"))
def recon_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.recon_status(tx(spark, sf_dir), view(spark, sf_dir, "recon")).select("trade_id", "recon_status")


@query("recon_conflicts", "r AS (SELECT session_date, CASE WHEN fill_id % 2 = 0 THEN instrument ELSE '' END AS instrument, fill_id % 3 AS status FROM executions) SELECT session_date, instrument, count(DISTINCT status) AS n FROM r GROUP BY ALL HAVING n > 1", E)
def recon_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = view(spark, sf_dir, "executions")
    return lookup.recon_conflicts(e.select("session_date", F.when(F.col("fill_id") % 2 == 0, F.col("instrument")).otherwise("").alias("instrument"), (F.col("fill_id") % 3).alias("status")))


@query("position_map", TX + """, l AS (SELECT 'p' || lot_seq % 5 || ':' || account AS position_id, trade_id FROM tx WHERE lot_seq % 3 <> 0 UNION ALL SELECT 'q' || account, trade_id FROM tx WHERE lot_seq % 4 = 0),
m AS (SELECT trade_id, max(position_id) AS p FROM l GROUP BY 1) SELECT trade_id, coalesce(p, CASE WHEN lot_seq = 3 THEN 'old' END) AS position_id FROM tx LEFT JOIN m USING (trade_id)""", E)
def position_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tx(spark, sf_dir)
    a = t.where("lot_seq % 3 <> 0").groupBy(F.concat(F.lit("p"), F.col("lot_seq") % 5, F.lit(":"), "account").alias("position_id")).agg(F.collect_list("trade_id").alias("trade_ids"))
    b = t.where("lot_seq % 4 = 0").groupBy(F.concat(F.lit("q"), "account").alias("position_id")).agg(F.collect_list("trade_id").alias("trade_ids"))
    old = t.select("trade_id", F.when(F.col("lot_seq") == 3, "old").alias("position_id"))
    return lookup.lot_positions(a.unionByName(b), old)


@query("account_check", """a AS (SELECT user_id AS journal, CASE WHEN user_id % 11 = 0 THEN NULL WHEN user_id % 5 = 0 THEN (fill_id % 2)::VARCHAR ELSE account::VARCHAR END AS account FROM executions)
SELECT journal, CASE WHEN count(DISTINCT account) = 1 THEN min(account) END AS account, CASE WHEN count(DISTINCT account) = 0 THEN 'no account' WHEN count(DISTINCT account) > 1 THEN 'several accounts' END AS problem FROM a GROUP BY 1""", E)
def account_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = view(spark, sf_dir, "executions")
    acc = F.when(F.col("user_id") % 11 == 0, F.lit(None)).when(F.col("user_id") % 5 == 0, (F.col("fill_id") % 2).cast("string")).otherwise(F.col("account").cast("string"))
    ids = e.select(F.col("user_id").alias("journal"), F.concat(F.lit("tx:"), acc, F.lit(":"), "fill_id").alias("t"))
    return lookup.account_check(ids.select("journal", lookup.account_of(F.col("t")).alias("account")))


LAB = """lab AS (SELECT p_partkey AS row_no, CASE WHEN p_partkey % 3 <> 1 THEN (p_partkey * 7 % 10000)::VARCHAR END AS l_fill, CASE WHEN p_partkey % 3 <> 0 THEN (p_partkey * 11 % 10000)::VARCHAR END AS l_trade FROM part),
t AS (SELECT fill_id::VARCHAR AS trade_id, (fill_id * 3 % 10000)::VARCHAR AS entry_fill_id FROM executions),
m AS (SELECT trade_id, 1 AS tier, row_no FROM t JOIN lab ON entry_fill_id = l_fill UNION ALL SELECT trade_id, 2, row_no FROM t JOIN lab ON entry_fill_id = l_trade UNION ALL SELECT trade_id, 3, row_no FROM t JOIN lab ON trade_id = l_fill
  UNION ALL SELECT trade_id, 4, row_no FROM t JOIN lab ON trade_id = l_trade AND (l_fill IS NULL OR l_fill = entry_fill_id)),
b AS (SELECT trade_id, min(tier) AS tier, first(row_no ORDER BY tier, row_no) AS lab_row FROM m GROUP BY 1)"""


@query("lab_join", LAB + " SELECT t.trade_id, entry_fill_id, tier, lab_row FROM t LEFT JOIN b USING (trade_id)", E)
def lab_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    lab = base(spark, sf_dir, "part").select(k.alias("row_no"), F.when(k % 3 != 1, (k * 7 % 10000).cast("string")).alias("entry_fill_id"), F.when(k % 3 != 0, (k * 11 % 10000).cast("string")).alias("trade_id"))
    t = view(spark, sf_dir, "executions").select(F.col("fill_id").cast("string").alias("trade_id"), (F.col("fill_id") * 3 % 10000).cast("string").alias("entry_fill_id"))
    return lookup.lab_join(t, lab)


@query("title_lookup", """d AS (SELECT DISTINCT session_date AS day FROM executions),
p AS (SELECT event_id AS page_no, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%-d %b %Y') WHEN 1 THEN '  DRC   ' || strftime(ts, '%d%m%y') WHEN 2 THEN 'DRC ' || strftime(ts, '%d%m%Y') || ' ' ELSE 'x' END AS title FROM events WHERE event_id % 7 = 0),
n AS (SELECT page_no, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title FROM p),
j AS (SELECT day, page_no, title FROM d JOIN n ON title IN (strftime(day, '%-d %b %Y'), 'DRC ' || strftime(day, '%d%m%y'), 'DRC ' || strftime(day, '%d%m%Y')))
SELECT day, first(title ORDER BY page_no) AS title, min(page_no) AS page_no FROM j GROUP BY 1""", E)
def title_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base(spark, sf_dir, "events").where("event_id % 7 = 0")
    m = F.col("event_id") % 4
    title = F.when(m == 0, F.date_format("ts", "d MMM yyyy")).when(m == 1, F.concat(F.lit("  DRC   "), F.date_format("ts", "ddMMyy"))).when(m == 2, F.concat(F.lit("DRC "), F.date_format("ts", "ddMMyyyy"), F.lit(" "))).otherwise("x")
    days = view(spark, sf_dir, "executions").select(F.col("session_date").alias("day")).distinct()
    return lookup.page_of_day(days, e.select(F.col("event_id").alias("page_no"), title.alias("title")))


OLD_NEW = """o AS (SELECT user_id, ts_us, side, price_ticks, qty, 'T' || fill_id AS old_id, CASE WHEN fill_id % 2 = 0 THEN 'confirmed' ELSE 'rejected' END AS status FROM executions WHERE fill_id % 3 <> 0),
n AS (SELECT user_id, ts_us, side, price_ticks, qty, 'T' || CASE WHEN fill_id % 5 = 0 THEN fill_id + 1 ELSE fill_id END AS new_id FROM executions WHERE fill_id % 4 <> 0)"""


@query("proposals", OLD_NEW + """ SELECT coalesce(new_id, old_id) AS trade_id, coalesce(status, 'proposed') AS status, CASE WHEN new_id IS NULL THEN 'discarded' WHEN old_id IS NULL THEN 'new' WHEN old_id = new_id THEN 'kept' ELSE 'remapped' END AS state
FROM o FULL JOIN n USING (user_id, ts_us, side, price_ticks, qty)""", E)
def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = view(spark, sf_dir, "executions")
    old = e.where("fill_id % 3 <> 0").select(*IDENT, F.concat(F.lit("T"), "fill_id").alias("trade_id"), F.when(F.col("fill_id") % 2 == 0, "confirmed").otherwise("rejected").alias("status"))
    new = e.where("fill_id % 4 <> 0").select(*IDENT, F.concat(F.lit("T"), F.expr("case when fill_id % 5 = 0 then fill_id + 1 else fill_id end")).alias("trade_id"))
    return lookup.remap_proposals(old, new, IDENT)


@query("attach_tags", """s AS (SELECT user_id AS session_id, fill_id AS trade_id, ['t' || fill_id % 3] AS spoken, count(*) OVER (PARTITION BY user_id) AS n FROM executions), g AS (SELECT DISTINCT user_id AS session_id, 't' || user_id % 4 AS tag FROM executions)
SELECT trade_id, tag FROM s JOIN g USING (session_id) WHERE n = 1 OR list_contains(spoken, tag)""", E)
def attach_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = view(spark, sf_dir, "executions")
    trades = e.select(F.col("user_id").alias("session_id"), F.col("fill_id").alias("trade_id"), F.array(F.concat(F.lit("t"), F.col("fill_id") % 3)).alias("spoken"))
    return lookup.attach_tags(e.select(F.col("user_id").alias("session_id"), F.concat(F.lit("t"), F.col("user_id") % 4).alias("tag")).distinct(), trades)


@query("multiset_change", """a AS (SELECT user_id, qty, side, count(*) AS n FROM executions GROUP BY ALL), b AS (SELECT user_id, qty, side, count(*) AS n FROM executions WHERE fill_id % 97 <> 0 GROUP BY ALL)
SELECT user_id, bool_and(a.n IS NOT DISTINCT FROM b.n) AS unchanged FROM a FULL JOIN b USING (user_id, qty, side) GROUP BY 1""", E)
def multiset_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = view(spark, sf_dir, "executions")
    return lookup.multiset_change(e, e.where("fill_id % 97 <> 0"), "user_id", ["qty", "side"])


@query("identity_membership", """SELECT user_id, ts_us, side, price_ticks, qty, CASE WHEN bool_or(fill_id % 3 <> 0) AND bool_or(fill_id % 4 <> 0) THEN 'both' WHEN bool_or(fill_id % 3 <> 0) THEN 'csv' ELSE 'stored' END AS place FROM executions WHERE fill_id % 3 <> 0 OR fill_id % 4 <> 0 GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY user_id, ts_us, side, price_ticks, qty"), E)
def identity_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = view(spark, sf_dir, "executions")
    return lookup.membership(e.where("fill_id % 3 <> 0"), e.where("fill_id % 4 <> 0"), IDENT)


REC = """inc AS (SELECT o_orderkey AS rec_id, o_custkey AS digest, o_orderpriority AS name FROM orders), kn AS (SELECT o_orderkey AS k_id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE o_custkey + 1 END AS k_digest, CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE o_orderpriority END AS k_name FROM orders WHERE o_orderkey % 2 = 0)"""


@query("id_collisions", REC + " SELECT rec_id, CASE WHEN k_id IS NULL THEN 'new' WHEN digest = k_digest THEN 'same' WHEN name = k_name THEN 'overwrite' ELSE 'error' END AS action FROM inc LEFT JOIN kn ON rec_id = k_id")
def id_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = base(spark, sf_dir, "orders")
    inc = o.select(F.col("o_orderkey").alias("rec_id"), F.col("o_custkey").alias("digest"), F.col("o_orderpriority").alias("name"))
    known = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("rec_id"), F.expr("case when o_orderkey % 3 = 0 then o_custkey else o_custkey + 1 end").alias("digest"), F.expr("case when o_orderkey % 5 = 0 then 'x' else o_orderpriority end").alias("name"))
    return lookup.id_collisions(inc, known)


@query("orphan_parts", CHAIN + """, z AS (SELECT *, count(*) OVER (PARTITION BY chain) AS nn, rec_id % 400 AS digest FROM chains) SELECT rec_id FROM z WHERE nn = 1 AND digest IN (SELECT digest FROM z WHERE nn > 1 AND part > 1)""", ("recordings",))
def orphan_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.orphan_parts(intervals.split_chains(view(spark, sf_dir, "recordings")).withColumn("digest", F.col("rec_id") % 400))


@query("page_upsert_plan", """d AS (SELECT c_custkey AS day, c_mktsegment || c_custkey % 50 AS title FROM customer), s AS (SELECT c_custkey AS day, c_custkey % 40 AS s_id FROM customer WHERE c_custkey % 3 = 0),
p AS (SELECT c_custkey AS page_id, c_mktsegment || c_custkey % 50 AS title FROM customer WHERE c_custkey < 60), t AS (SELECT title, min(page_id) AS t_id FROM p GROUP BY 1)
SELECT day, coalesce(p.page_id, t_id) AS page_id, CASE WHEN coalesce(p.page_id, t_id) IS NULL THEN 'create' ELSE 'update' END AS action FROM d LEFT JOIN s USING (day) LEFT JOIN p ON p.page_id = s_id AND p.title = d.title LEFT JOIN t ON t.title = d.title""")
def page_upsert_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = base(spark, sf_dir, "customer")
    title = F.concat("c_mktsegment", (F.col("c_custkey") % 50).cast("string")).alias("title")
    return lookup.page_plan(c.select(F.col("c_custkey").alias("day"), title), c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("day"), (F.col("c_custkey") % 40).alias("page_id")), c.where("c_custkey < 60").select(F.col("c_custkey").alias("page_id"), title))
