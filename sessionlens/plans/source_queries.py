"""Queries over the sources: typed executions and nested documents, from text made of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import documents, executions
from .fixtures import base, view
from ..sources.shared import shared_path
from .registry import ORACLES, query

#: Executions as the export writes them; some rows are spoilt.
def export(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("fill_id")
    when = F.date_format(F.expr("timestampadd(MICROSECOND, ts_us, timestamp_ntz'1970-01-01 00:00:00')"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return view(spark, sf_dir, "executions").select(
        n.alias("row_no"), F.concat(when, F.when(n % 29 == 0, "").when(n % 2 == 0, "Z").otherwise("+02:00")).alias("date"),
        F.when(n % 31 == 0, "XX").when(n % 3 == 0, F.col("instrument")).otherwise(F.concat("instrument", F.lit("H24"))).alias("symbol"), F.when(n % 37 == 0, "hold").otherwise(F.upper("side")).alias("side"),
        F.lit("USD").alias("currency"), F.lit("").alias("underlying"), F.when(n % 5 == 0, "stock").otherwise("future").alias("asset_type"),
        F.when(n % 41 == 0, "abc").otherwise((F.col("price_ticks") / 4).cast("string")).alias("price"), F.when(n % 43 == 0, "0").otherwise(F.col("qty").cast("string")).alias("quantity"),
        F.lit("nan").alias("commission"), F.lit("1.5").alias("fees"), F.lit("").alias("stop_loss"), F.lit("N/A").alias("profit_target"), F.concat(F.lit(" a,, b "), F.col("qty").cast("string")).alias("tags"),
        F.lit("<b>x</b> &amp; <img src=y> z").alias("notes"), F.coalesce("source_group_id", F.lit("")).alias("spread_id"),
    )


@query(
    "ingest_reject_report",
    """r AS (SELECT fill_id AS row_no, CASE WHEN fill_id % 29 = 0 THEN 'date' WHEN fill_id % 31 = 0 THEN 'symbol' WHEN fill_id % 37 = 0 THEN 'side' WHEN fill_id % 43 = 0 AND fill_id % 5 <> 0 THEN 'quantity'
  WHEN fill_id % 41 = 0 OR price_ticks <= 0 THEN 'price' END AS reject_reason FROM executions) SELECT * FROM r WHERE reject_reason IS NOT NULL""",
    ("executions",),
)
def ingest_reject_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return executions.split_rejects(executions.validate(export(spark, sf_dir)))[1]


@query(
    "ingest_fills",
    """g AS (SELECT *, ts_us - CASE WHEN fill_id % 2 = 0 THEN 0 ELSE 7200000000 END AS t FROM executions WHERE fill_id % 29 <> 0 AND fill_id % 31 <> 0 AND fill_id % 37 <> 0 AND NOT (fill_id % 43 = 0 AND fill_id % 5 <> 0) AND fill_id % 41 <> 0 AND price_ticks > 0),
l AS (SELECT *, (make_timestamp(t) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS ny FROM g)
SELECT fill_id AS row_no, t AS ts_us, ny::DATE + CASE WHEN hour(ny) >= 18 THEN 1 ELSE 0 END AS session_date, instrument, CASE WHEN fill_id % 3 <> 0 THEN 'H' END AS contract_month, CASE WHEN fill_id % 3 <> 0 THEN 2024 END::BIGINT AS contract_year,
  side, CASE WHEN fill_id % 43 = 0 THEN 0 ELSE qty END AS qty, price_ticks / 4 AS price, CASE WHEN fill_id % 5 = 0 THEN 'manual' ELSE 'imported' END AS entry_kind, 'a,b ' || qty AS tags, 'x & [image] z' AS notes_text, source_group_id FROM l""",
    ("executions",),
)
def ingest_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = executions.split_rejects(executions.validate(export(spark, sf_dir)))[0]
    return good.withColumn("tags", F.array_join("tags", ",")).select("row_no", "ts_us", "session_date", "instrument", "contract_month", "contract_year", "side", "qty", "price", "entry_kind", "tags", "notes_text", "source_group_id")


@query("csv_to_fills")
def csv_to_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export as CSV files whose notes hold commas, quotes and line ends; fills by the contract, in a folder for each session date."""
    csv, out = shared_path(spark, "export"), shared_path(spark, "fills")
    rows = export(spark, sf_dir).withColumn("notes", F.lit('<b>x,</b>\n &amp; <img alt="a, b" src=y> z'))
    rows.write.option("header", "true").option("escape", '"').csv(csv)
    good, _ = executions.split_rejects(executions.validate(executions.read_csv(spark, csv)))
    fills = executions.with_ids(good).withColumn("venue", executions.venue_of(F.lit("export TopstepX 2026.csv")))
    executions.write_fills(executions.to_contract(executions.imported_only(fills, include_manual=True)), out)
    f = executions.read_contract(spark, out)
    return f.select("fill_id", F.unix_micros("timestamp").alias("ts_us"), "session_date", "instrument", "contract_month", "contract_year", "side", "qty", "price", "entry_kind", F.array_join("tags", ",").alias("tags"), "notes_text", "source_group_id", "venue")


ORACLES["csv_to_fills"] = ORACLES["ingest_fills"].replace("SELECT fill_id AS row_no,", "SELECT 'tv:' || fill_id || ':' || coalesce(source_group_id, '-') || ':' || t || ':' || side || ':' || (price_ticks / 4)::DOUBLE || ':' || CASE WHEN fill_id % 43 = 0 THEN 0 ELSE qty END AS fill_id,").replace("'x & [image] z' AS notes_text", "'x, & [image] z' AS notes_text, 'topstepx' AS venue")


@query(
    "asr_segments",
    """k AS (SELECT conv_id, turn, text FROM conversations WHERE turn % 3 <> 1) SELECT conv_id AS session_id, printf('seg_%03d', row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS seg, trim(text) AS text, turn * 1.5::DOUBLE AS t0, turn * 1.5::DOUBLE + 1 AS t1, 0 AS n_words FROM k""",
)
def asr_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third turn has an empty text and falls out before the numbering."""
    c = base(spark, sf_dir, "conversations")
    seg = F.struct(F.col("turn"), F.when(F.col("turn") % 3 == 1, " ").otherwise(F.col("text")).alias("text"), (F.col("turn") * 1.5).alias("start"), (F.col("turn") * 1.5 + 1).alias("end"))
    docs = c.groupBy(F.col("conv_id").alias("session_id")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(seg)).alias("segments"))).alias("json"))
    return documents.aligned_segments(docs)


@query("ocr_lines", "SELECT event_id AS reading_id, event_type || ' ' || user_id AS text, (0.5 + (event_id % 5) / 10) / 2 + 0.25 AS confidence FROM events")
def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both layouts, by the event's number."""
    score = 0.5 + F.col("event_id") % 5 / 10
    texts, scores = F.array("event_type", F.col("user_id").cast("string"), F.lit(" ")), F.array(score, F.lit(0.5), F.lit(0.1))
    flat = F.to_json(F.struct(texts.alias("rec_texts"), scores.alias("rec_scores")))
    nested = F.to_json(F.struct(F.array(F.struct(F.col("event_type").alias("text"), score.alias("score")), F.struct(F.col("user_id").cast("string").alias("text"), F.lit(0.5).alias("score"))).alias("lines")))
    e = base(spark, sf_dir, "events")
    return documents.reading_lines(e.select(F.col("event_id").alias("reading_id"), F.when(F.col("event_id") % 2 == 0, flat).otherwise(nested).alias("json")))


@query("page_properties", """SELECT c_custkey AS page_id, 'Name' AS name, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'Nation', c_nationkey::VARCHAR FROM customer UNION ALL SELECT c_custkey, 'Segment', c_mktsegment FROM customer UNION ALL SELECT c_custkey, 'Both', c_mktsegment || ',x' FROM customer""")
def page_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = base(spark, sf_dir, "customer")
    props = F.struct(
        F.struct(F.lit("title").alias("type"), F.array(F.struct(F.col("c_name").alias("plain_text"))).alias("title")).alias("Name"), F.struct(F.lit("number").alias("type"), F.col("c_nationkey").alias("number")).alias("Nation"),
        F.struct(F.lit("select").alias("type"), F.struct(F.col("c_mktsegment").alias("name")).alias("select")).alias("Segment"),
        F.struct(F.lit("multi_select").alias("type"), F.array(F.struct(F.col("c_mktsegment").alias("name")), F.struct(F.lit("x").alias("name"))).alias("multi_select")).alias("Both"),
    )
    return documents.page_properties(c.select(F.col("c_custkey").alias("page_id"), F.to_json(props).alias("json")))


@query("response_rows", """SELECT event_id AS response_id, CASE WHEN event_id % 4 < 2 THEN '{"a":' || user_id || '}' END AS content, CASE event_id % 4 WHEN 2 THEN 'empty' WHEN 3 THEN 'not json' END AS problem FROM events""")
def response_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base(spark, sf_dir, "events")
    body = F.concat(F.lit('{"a":'), F.col("user_id").cast("string"), F.lit("}"))
    content = F.when(F.col("event_id") % 4 == 0, body).when(F.col("event_id") % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("event_id") % 4 == 2, " ").otherwise("no {json")
    chat = F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")))
    return documents.response_content(e.select(F.col("event_id").alias("response_id"), chat.alias("json")))
