"""Queries over stored things: ledger tables, session documents, journals, lab tables, recording files.

What is read is first written to the shared folder from the given tables, so that the readers meet real files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clocks, pairing, tag_map
from ..sources import journal, ledger_tables, session_files
from ..sources.shared import shared_path, stored
from .fixtures import base, view
from .pairing_queries import LOTS, lots
from .registry import query


def trade_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of sessions as files have them: some without the tool's id, some with an empty one, several of one id."""
    e = view(spark, sf_dir, "clip_events")
    n = F.col("event_id")
    return e.select(
        F.concat_ws("-", "user_id", "n").alias("session_id"), F.when(n % 4 == 1, F.lit(None)).when(n % 9 == 0, "").otherwise(F.concat(F.lit("T"), n - n % 3)).alias("tva_trade_id"),
        F.concat(F.lit("x"), n - n % 5).alias("trade_id"), n.cast("string").alias("entry_fill_id"), F.when(n % 2 == 0, "long").otherwise("short").alias("direction"), F.lit("MNQ").alias("instrument"),
        F.when(n % 11 == 0, "n/a").otherwise(F.floor(F.col("value") * 4).cast("string")).alias("entry_price"), F.when(n % 3 == 0, "open").otherwise("closed").alias("status"), "user_id",
    )


LEDGER = """s AS (SELECT user_id::VARCHAR || '-' || n AS session_id, CASE WHEN event_id % 4 = 1 THEN 'x' || (event_id - event_id % 5) WHEN event_id % 9 = 0 THEN '' ELSE 'T' || (event_id - event_id % 3) END AS tva_trade_id, 'x' || (event_id - event_id % 5) AS trade_id,
  event_id::VARCHAR AS entry_fill_id, CASE WHEN event_id % 2 = 0 THEN 'long' ELSE 'short' END AS direction, CASE WHEN event_id % 11 <> 0 THEN floor(value * 4) END::DOUBLE AS entry_price, CASE WHEN event_id % 3 = 0 THEN 'open' ELSE 'closed' END AS status, user_id FROM clip_events),
k AS (SELECT * FROM s WHERE tva_trade_id <> '' AND user_id % 5 <> 3 QUALIFY row_number() OVER (PARTITION BY session_id, tva_trade_id ORDER BY status = 'closed' DESC, entry_fill_id, trade_id, direction, entry_price NULLS LAST) = 1)
SELECT session_id, tva_trade_id, trade_id, entry_fill_id, direction, entry_price + CASE WHEN user_id % 2 = 0 THEN 0 ELSE 1 END AS entry_price, status, CASE WHEN user_id % 2 = 0 THEN 'sim' END AS venue FROM k"""


@query("ledger_trades", LEDGER, ("clip_events",))
def ledger_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sessions are written with other prices and no venue; those of even users again as they are; every fifth user's are dropped. A column comes later."""
    path = shared_path(spark, "ledger")
    ledger = ledger_tables.Ledger(spark, "ledger_" + path.rsplit("-", 1)[1], path)
    files = trade_files(spark, sf_dir)
    ledger.write("trades", ledger_tables.trade_rows(files.withColumn("entry_price", F.col("entry_price").try_cast("double") + 1)))
    ledger.write("trades", ledger_tables.trade_rows(files.where("user_id % 2 = 0").withColumn("venue", F.lit("sim"))))
    ledger.write("trades", ledger_tables.trade_rows(files.where("user_id % 2 = 0").withColumn("venue", F.lit("sim"))))
    ledger.drop("trades", files.where("user_id % 5 = 3").select("session_id"))
    return ledger.read("trades").select("session_id", "tva_trade_id", "trade_id", "entry_fill_id", "direction", "entry_price", "status", "venue")


#: Tasks move their own files; else the driver moves a folder for each session, one after the other.
COMMIT = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def session_folders(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """A folder for each conversation with its transcript or insights; every eleventh is cut short, every seventh has a wrong part."""
    c = base(spark, sf_dir, "conversations")
    bad = F.col("conv_id") % 7 == 3
    if kind == "transcript":
        seg = F.struct("turn", F.when(bad & (F.col("turn") == 1), F.lit(None)).otherwise(F.concat(F.lit("seg_"), "turn")).alias("id"), (F.col("turn") * 2.5).alias("t0"), (F.col("turn") * 2.5 + 2).alias("t1"), F.coalesce("text", F.lit("")).alias("text"), F.array(F.struct(F.lit("x").alias("w"), F.lit(0.5).alias("t0"))).alias("words"))
        body = F.struct(F.lit("p").alias("provider"), F.lit("m").alias("model"), F.array_sort(F.collect_list(seg)).alias("segments"), F.lit(1).alias("unknown"))
    else:
        span = F.struct("turn", F.concat(F.lit("seg_"), "turn").alias("seg"), F.coalesce("text", F.lit("")).alias("text"), F.lit("n").alias("name"))
        kinds = F.when(bad & (F.col("turn") == 1), "nonsense").when(F.col("turn") % 2 == 0, "tilt").otherwise("break")
        event = F.struct("turn", F.col("turn").cast("double").alias("t"), kinds.alias("kind"), F.concat(F.lit("seg_"), "turn").alias("seg"))
        body = F.struct(F.lit("p").alias("provider"), F.lit("m").alias("model"), F.array_sort(F.collect_list(span)).alias("checkins"), F.array_sort(F.collect_list(event)).alias("session_events"))
    docs = c.groupBy("conv_id").agg(F.to_json(body).alias("json"))
    # A JSON file of several lines.
    text = F.when(F.col("conv_id") % 11 == 5, F.substring("json", F.lit(1), F.length("json") - 2)).otherwise(F.regexp_replace("json", r'^\{', "{\n"))
    path = shared_path(spark, f"sessions-{kind}")
    docs.select(F.concat(F.lit("c"), "conv_id").alias("session_id"), text.alias("value")).repartition("session_id").write.partitionBy("session_id").options(**COMMIT).option("lineSep", "\n").text(path)
    return f"{path}/session_id=*"


@query(
    "session_segments",
    "SELECT 'c' || conv_id AS session_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS i, 'seg_' || turn AS seg, turn * 2.5::DOUBLE AS t0, turn * 2.5::DOUBLE + 2 AS t1, 'de' AS lang, coalesce(text, '') AS text, 1 AS n_words "
    "FROM conversations WHERE conv_id % 11 <> 5 AND conv_id NOT IN (SELECT conv_id FROM conversations WHERE conv_id % 7 = 3 AND turn = 1)",
)
def session_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_files.segments(session_files.read_documents(spark, session_folders(spark, sf_dir, "transcript"), "transcript"))


@query(
    "session_insights",
    """e AS (SELECT conv_id, turn, text FROM conversations WHERE conv_id % 11 <> 5 AND conv_id NOT IN (SELECT conv_id FROM conversations WHERE conv_id % 7 = 3 AND turn = 1)),
r AS (SELECT DISTINCT conv_id, CASE WHEN conv_id % 11 = 5 THEN 'not a document' ELSE 'unknown event' END AS problem FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM e))
SELECT 'c' || conv_id AS session_id, 'span' AS what, 'seg_' || turn AS seg, coalesce(text, '') AS text, 'n' AS name FROM e
UNION ALL SELECT 'c' || conv_id, 'event', 'seg_' || turn, '', CASE WHEN turn % 2 = 0 THEN 'tilt' ELSE 'break' END FROM e UNION ALL SELECT 'c' || conv_id, 'reject', NULL, NULL, problem FROM r""",
)
def session_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Three tables are made of the documents: each file is opened once.
    docs = stored(session_files.read_documents(spark, session_folders(spark, sf_dir, "insights"), "insights"), "insights")
    spans = session_files.spans(docs).select("session_id", F.lit("span").alias("what"), "seg", "text", "name")
    events = session_files.events(docs).select("session_id", F.lit("event").alias("what"), "seg", "text", F.col("kind").alias("name"))
    none = F.lit(None).cast("string")
    bad = session_files.rejects(docs).select("session_id", F.lit("reject").alias("what"), none.alias("seg"), none.alias("text"), F.col("problem").alias("name"))
    return spans.unionByName(events).unionByName(bad)


@query(
    "readings_file",
    "SELECT session_id, t0_us / 1000000 AS t, role AS roi, coalesce(text, '') AS text, CASE WHEN turn % 3 <> 0 THEN 0.5 ELSE 0 END::DOUBLE AS confidence, CASE WHEN turn % 2 = 0 THEN 'p' END AS parsed FROM segments WHERE role IS NOT NULL",
    ("segments",),
)
def readings_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "readings")
    s = view(spark, sf_dir, "segments")
    rows = s.select("session_id", (F.col("t0_us") / 1_000_000).alias("t"), F.col("role").alias("roi"), "text", F.when(F.col("turn") % 3 != 0, 0.5).alias("confidence"), F.when(F.col("turn") % 2 == 0, "p").alias("parsed"), "turn")
    session_files.write_readings(rows, path)
    return session_files.read_readings(spark, path)


@query(
    "lab_tables",
    """SELECT 'attribution' AS kind, fill_id::VARCHAR AS entry_fill_id, CASE WHEN fill_id % 3 <> 0 THEN side END AS value, NULL AS gap FROM executions
UNION ALL SELECT 'triggers', NULL, NULL, 'missing' UNION ALL SELECT 'zones', NULL, NULL, 'no distance_ticks' UNION ALL SELECT 'attribution', NULL, NULL, 'no note'
UNION ALL SELECT 'zones', fill_id::VARCHAR, instrument, NULL FROM executions WHERE fill_id % 2 = 0""",
    ("executions",),
)
def lab_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribution under its second name with another column for the fill, zones without a column, no triggers."""
    folder, e = shared_path(spark, "lab"), view(spark, sf_dir, "executions")
    fill = F.col("fill_id").cast("string")
    e.select(F.lit(None).cast("string").alias("trade_id"), fill.alias("fill_id"), F.when(F.col("fill_id") % 3 != 0, F.col("side")).otherwise(" ").alias("token"), F.lit("x").alias("alignment"), F.lit(1).alias("more")).write.parquet(f"{folder}/journal_attribution.parquet")
    e.where("fill_id % 2 = 0").select(F.lit("t").alias("trade_id"), fill.alias("entry_fill_id"), F.col("instrument").alias("zone")).write.parquet(f"{folder}/zones.parquet")
    tables, gaps = session_files.read_lab(spark, folder)
    none = F.lit(None).cast("string")
    out = gaps.select("kind", none.alias("entry_fill_id"), none.alias("value"), "gap")
    for kind, value in (("attribution", "token"), ("zones", "zone"), ("triggers", "trigger")):
        out = out.unionByName(tables[kind].select(F.lit(kind).alias("kind"), "entry_fill_id", F.col(value).alias("value"), none.alias("gap")))
    return out


@query(
    "recording_inventory",
    """c AS (SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) || chr(10) AS body FROM conversations GROUP BY conv_id)
SELECT 'c' || conv_id AS session_id, strlen(body) AS size, CASE WHEN strlen(body) < 1500 THEN sha256(body) END AS sha256, 90000000 AS hint_rest_us, false AS verified FROM c""",
)
def recording_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each conversation; large ones stay closed. The hint less the modification time is what start and duration leave."""
    path = shared_path(spark, "recordings")
    c = base(spark, sf_dir, "conversations").groupBy(F.concat(F.lit("c"), "conv_id").alias("session_id")).agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("x"))
    c.select("session_id", F.array_join(F.transform("x", lambda s: s["text"]), "\n").alias("value")).repartition("session_id").write.partitionBy("session_id").options(**COMMIT).text(path)
    # Listed and digested once, read four times.
    files = stored(session_files.recordings(spark, path, [".txt"], 1500).withColumn("session_id", F.regexp_extract("path", "session_id=([^/]+)", 1)), "files")
    durations = files.select("name", "session_id", F.lit(1).alias("chain_no"), (F.col("modified_us") - 100_000_000).alias("start_us"), F.lit(10_000_000).alias("duration_us"))
    hints = session_files.start_hints(files.drop("session_id").withColumn("name", F.col("path")), durations.join(files.select("session_id", "path"), "session_id").withColumn("name", F.col("path")).drop("path"))
    met = files.join(hints.select("session_id", F.col("pause_hint_us").alias("hint_rest_us"), "verified"), "session_id")
    return met.select("session_id", "size", "sha256", "hint_rest_us", "verified")


def journal_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots of the executions as a journal has them."""
    made = lots(spark, sf_dir)
    stamp = lambda c: F.timestamp_micros(c)
    return made.select(
        "account", F.concat_ws(":", F.lit("tx"), "account", "instrument", "session_date", "lot_seq").alias("trade_id"), "instrument", "session_date", "direction", "qty", "lot_seq", "status", stamp("entry_ts_us").alias("entry_timestamp"), stamp("exit_ts_us").alias("exit_timestamp"),
        (F.col("entry_price_ticks") / 4).alias("entry_price"), (F.col("exit_price_ticks") / 4).alias("exit_price"), F.col("entry_fill_id").cast("string").alias("entry_fill_id"), F.col("exit_fill_id").cast("string").alias("exit_fill_id"), F.lit(1.5).alias("commission_cost"),
    )


@query("journal_round_trip", LOTS + " SELECT account, instrument, session_date, lot_seq, status, direction, qty, entry_fill_id, exit_fill_id, entry_price_ticks, exit_price_ticks FROM lots", ("executions",))
def journal_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades, stored by the contract and read again; fills made from them; paired again."""
    path, keys = shared_path(spark, "journal"), ["account"]
    journal.write_trades(journal_trades(spark, sf_dir).withColumn("account", F.col("account").cast("string")), path, net=True)
    fills = journal.whole_fills(journal.fills_of_trades(journal.read_trades(spark, path, net=True), keys), keys)
    ready = fills.select(
        F.col("account").cast("long").alias("account"), "instrument", "session_date", F.col("fill_id").cast("long").alias("fill_id"), "side", "qty", (F.col("price") * 4).cast("long").alias("price_ticks"), F.unix_micros("timestamp").alias("ts_us"),
    )
    out = pairing.fifo_lots(ready, ["account", "instrument", "session_date"])
    return out.select("account", "instrument", "session_date", "lot_seq", "status", "direction", "qty", "entry_fill_id", "exit_fill_id", "entry_price_ticks", "exit_price_ticks")


@query(
    "journal_problems",
    """j AS (SELECT account, 'j' || account AS journal, count(*) FILTER (WHERE status = 'closed' AND account = 2) AS bare, count(*) AS n FROM lots GROUP BY account)
SELECT journal, CASE WHEN account = 1 THEN 'several accounts' WHEN account = 2 THEN 'no source of costs' END AS problem, CASE WHEN account = 2 THEN bare ELSE n END AS n FROM j WHERE account = 1 OR (account = 2 AND bare > 0)
UNION ALL SELECT journal, NULL, n FROM j WHERE NOT (account = 1 OR (account = 2 AND bare > 0))""".replace("j AS", LOTS + ", j AS", 1),
    ("executions",),
)
def journal_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A journal for each account: one has lots of two accounts, one has no costs."""
    path = shared_path(spark, "journals")
    t = journal_trades(spark, sf_dir).withColumn("journal", F.concat(F.lit("j"), "account"))
    rows = t.withColumn("commission_cost", F.when(F.col("account") != 2, F.col("commission_cost"))).drop("account")
    sources = t.select("journal", "account").distinct().withColumn("account", F.explode(F.array(F.col("account").cast("string"), F.when(F.col("account") == 1, "other").otherwise(F.col("account").cast("string")))))
    names = sorted(r[0] for r in sources.select("journal").distinct().collect())  # the folders of this fixture: one for each account
    for name in names:
        rows.where(F.col("journal") == name).drop("journal").write.parquet(f"{path}/{name}/journal_trades.parquet")
        sources.where(F.col("journal") == name).select("account").write.parquet(f"{path}/{name}/journal_lot_sources.parquet")
    good, problems = journal.read_journal(spark, f"{path}/*")
    fine = good.groupBy("journal").agg(F.count("*").alias("n")).select("journal", F.lit(None).cast("string").alias("problem"), "n")
    return problems.select("journal", "problem", "n").unionByName(fine)


TAGS = tag_map.TagMap(
    exact={"the": None, "the of": "of the", "and": None, "an": None, "de la": "de_la", "la": None, "und": None, "st-and": None, "on": None, "Brand 13": None, "brand#2": None, "hand": None, "handed": None, "1995 Item": None},
    context=["in", "es", "que"], qualifiers=["tion", "ing", "_retest"],
)
_SPELL = TAGS.spellings(False)
_ALTS = "|".join(w.replace("#", "\\#") for w in sorted(_SPELL, key=lambda w: (-len(w), w)))
_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in _SPELL.items()) + "}"
#: Letters and digits of the spellings, and their tags.
_SHORT = "MAP {'the': 'the', 'theof': 'the of', 'ofthe': 'the of', 'and': 'and', 'an': 'an', 'dela': 'de la', 'la': 'la', 'und': 'und', 'stand': 'st-and', 'on': 'on', 'brand13': 'Brand 13', 'brand2': 'brand#2', 'hand': 'hand', 'handed': 'handed', '1995item': '1995 Item', 'in': 'in', 'es': 'es', 'que': 'que'}"


@query(
    "mapped_tags",
    f"""t AS (SELECT 'd' || doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'b' || p_partkey, p_brand FROM part UNION ALL SELECT 'c' || conv_id || ':' || turn, coalesce(text, '') FROM conversations),
b AS (SELECT id, regexp_replace(text, '^[\\s\\x0B\\x{{85}}\\x{{A0}}\\p{{Z}}]+|[\\s\\x0B\\x{{85}}\\x{{A0}}\\p{{Z}}]+$', '', 'g') AS x FROM t),
s AS (SELECT id, x, {_MAP}[lower(x)] AS whole, regexp_replace(lower(x), '[^a-z0-9]', '', 'g') AS short FROM b),
m AS (SELECT id, x, whole, {_SHORT}[short] AS bare FROM s),
h AS (SELECT id, x, whole, bare, list_transform(regexp_extract_all(x, '(?i)\\b(?:{_ALTS})\\b'), lambda w: {_MAP}[lower(w)]) AS hits,
  list_transform(regexp_extract_all(x, '[A-Za-z0-9]+(?:[._-][A-Za-z0-9]+)*'), lambda w: coalesce({_MAP}[lower(w)], CASE WHEN len(w) > 7 AND lower(w) LIKE '%#_retest' ESCAPE '#' THEN {_MAP}[lower(w)[:-8]] END,
    CASE WHEN len(w) > 4 AND lower(w) LIKE '%tion' THEN {_MAP}[lower(w)[:-5]] END, CASE WHEN len(w) > 3 AND lower(w) LIKE '%ing' THEN {_MAP}[lower(w)[:-4]] END)) AS words FROM m),
o AS (SELECT id, CASE WHEN x = '' THEN [] WHEN whole IS NOT NULL THEN [whole] WHEN bare IS NOT NULL THEN [bare] ELSE list_filter(list_concat(hits, words), lambda w: w IS NOT NULL) END AS l FROM h),
u AS (SELECT id, unnest(l) AS tag, generate_subscripts(l, 1) AS i FROM o), f AS (SELECT id, tag, min(i) AS i FROM u GROUP BY ALL)
SELECT o.id, coalesce(string_agg(tag, ',' ORDER BY i), '') AS tags FROM o LEFT JOIN f ON o.id = f.id GROUP BY o.id""",
)
def mapped_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    brands = base(spark, sf_dir, "part").select(F.concat(F.lit("b"), "p_partkey").alias("id"), F.col("p_brand").alias("text"))
    turns = base(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit(":"), "turn").alias("id"), "text")
    return docs.unionByName(brands).unionByName(turns).select("id", F.array_join(tag_map.mapped_tags(F.col("text"), TAGS), ",").alias("tags"))


@query(
    "theil_sen_large",
    """p AS (SELECT event_type, epoch_us(ts) // 60000000 AS x, round(value * 100) AS y FROM events), sl AS (SELECT a.event_type, quantile_cont((b.y - a.y) / (b.x - a.x), 0.5) AS slope FROM p a JOIN p b ON a.event_type = b.event_type AND a.x < b.x GROUP BY 1)
SELECT event_type, count(*) AS n, any_value(slope) AS slope, quantile_cont(y - slope * x, 0.5) AS intercept FROM p JOIN sl USING (event_type) GROUP BY 1""",
)
def theil_sen_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fit over all events of a kind: too many pairs to list."""
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    e = base(spark, sf_dir, "events").select("event_type", F.floor(us / 60_000_000).alias("x"), F.round(F.col("value") * 100).alias("y"))
    return clocks.theil_sen(e, ["event_type"], "x", "y")
