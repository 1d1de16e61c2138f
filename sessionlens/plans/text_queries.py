"""Queries over the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tags, text
from .fixtures import base, view
from .registry import query

#: Frequent words of the tables stand for tags and jargon.
TAGS = ("the", "of", "and", "to", "der", "de", "en", "the of", "of the")
WORDS = "list_filter(string_split(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' '), lambda w: w <> '')"


#: Word boundaries of all letters, written out.
_IN = "(?i)(^|[^\\p{{L}}\\p{{N}}_])({})($|[^\\p{{L}}\\p{{N}}_])"


@query("keyword_spans", f"SELECT session_id, seg, t0_us, kind FROM segments, (VALUES ('article', '{_IN.format('the|der|le|el')}'), ('joint', '{_IN.format('and|und|et|y')}'), ('of', '{_IN.format('of')}')) v(kind, p) WHERE regexp_matches(text, p)", ("segments",))
def keyword_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.keyword_spans(view(spark, sf_dir, "segments"), {"article": r"\b(the|der|le|el)\b", "joint": r"\b(and|und|et|y)\b", "of": r"\bof\b"})


@query("text_windows", """p AS (SELECT session_id, seg, row_number() OVER (PARTITION BY session_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n FROM segments),
w AS (SELECT DISTINCT session_id, n, unnest(range(0, n)) AS win FROM (SELECT DISTINCT session_id, n FROM p))
SELECT p.session_id, seg, win AS "window" FROM p JOIN w ON w.session_id = p.session_id WHERE (win = 0 OR (win - 1) * 2 + 3 < p.n) AND i >= win * 2 AND i < win * 2 + 3""", ("segments",))
def text_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.segment_windows(view(spark, sf_dir, "segments"), 3, 1)


SPANS = """spans AS (SELECT session_id, concat('f', turn % 2) AS field, concat('seg_', turn % 3) AS seg, text, t0_us AS t_us FROM segments)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "segments")
    return s.select("session_id", F.concat(F.lit("f"), F.col("turn") % 2).alias("field"), F.concat(F.lit("seg_"), F.col("turn") % 3).alias("seg"), "text", F.col("t0_us").alias("t_us"))


@query("partial_merge", SPANS + ", r AS (SELECT *, row_number() OVER (PARTITION BY session_id, field, seg ORDER BY -length(text), text, t_us) AS rn FROM spans) SELECT session_id, field, seg, text, t_us FROM r WHERE rn = 1", ("segments",))
def partial_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.merge_spans(spans(spark, sf_dir))


@query("events_dedupe", SPANS + " SELECT session_id, field AS kind, seg, min(t_us) AS t_us FROM spans GROUP BY ALL", ("segments",))
def events_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.first_events(spans(spark, sf_dir).withColumnRenamed("field", "kind").drop("text"))


@query("first_by_field", "k AS (SELECT session_id, seg, t0_us, role AS kind FROM segments) SELECT session_id, kind, first(seg ORDER BY t0_us, seg) AS seg FROM k GROUP BY ALL", ("segments",))
def first_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.first_by_field(view(spark, sf_dir, "segments").withColumnRenamed("role", "kind"))


CITES = """cites AS (SELECT s.session_id, concat('seg_', s.turn + s.turn % 2 * (s.turn % 3)) AS seg, substr(s.text, 5, 20) AS quote, CASE WHEN s.turn % 2 = 0 THEN 'de' WHEN s.turn % 3 = 0 THEN 'THE' END AS token FROM segments s)"""


@query("citation_guard", CITES + r""" SELECT c.*, coalesce(contains(t.text, quote), false) AND (token IS NULL OR coalesce(contains(t.text, token) OR contains(' ' || trim(regexp_replace(lower(t.text), '[^\p{L}\p{N}_]+', ' ', 'g')) || ' ', ' ' || lower(token) || ' '), false)) AS ok FROM cites c LEFT JOIN segments t ON t.session_id = c.session_id AND t.seg = c.seg""", ("segments",))
def citation_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "segments")
    seg = F.concat(F.lit("seg_"), F.col("turn") + F.col("turn") % 2 * (F.col("turn") % 3))
    cites = s.select("session_id", seg.alias("seg"), F.substring("text", 5, 20).alias("quote"), F.when(F.col("turn") % 2 == 0, "de").when(F.col("turn") % 3 == 0, "THE").alias("token"))
    return text.check_citations(cites, s)


DRAFTS = """drafts AS (SELECT doc_id AS draft_id, source AS session_id, text FROM documents), allowed AS (SELECT DISTINCT source AS session_id, unnest(regexp_extract_all(text, '[0-9]+')) AS run FROM documents WHERE doc_id % 2 = 0)"""


@query("digit_audit", DRAFTS + """, r AS (SELECT DISTINCT draft_id, session_id, unnest(regexp_extract_all(text, '[0-9]+')) AS run FROM drafts)
SELECT draft_id, string_agg(DISTINCT run, ',' ORDER BY run) AS unknown FROM r WHERE NOT EXISTS (SELECT 1 FROM allowed a WHERE a.session_id = r.session_id AND a.run = r.run) GROUP BY 1""")
def digit_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = base(spark, sf_dir, "documents")
    allowed = d.where("doc_id % 2 = 0").select(F.col("source").alias("session_id"), F.explode(text.digit_runs(F.col("text"))).alias("run"))
    return text.digit_audit(d.select(F.col("doc_id").alias("draft_id"), F.col("source").alias("session_id"), "text"), allowed)


PAIRS = f"""pairs AS (SELECT a.session_id, a.turn, {WORDS.format('a.text')} AS ref, {WORDS.format('b.text')} AS hyp FROM segments a JOIN segments b ON a.session_id = b.session_id AND b.turn = a.turn + 1)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "segments")
    nxt = s.select("session_id", (F.col("turn") - 1).alias("turn"), text.plain_words(F.col("text")).alias("hyp"))
    return s.select("session_id", "turn", text.plain_words(F.col("text")).alias("ref")).join(nxt, ["session_id", "turn"])


@query("word_error_rate")
def word_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: the other engine's levenshtein counts bytes, too few for the words of whole texts. Tests hold it against a slow version."""
    return text.word_errors(pairs(spark, sf_dir)).select("session_id", "turn", "n_words", "edits", "wer")


@query("jargon_recall", PAIRS + """, s AS (SELECT session_id, turn, ' ' || array_to_string(ref, ' ') || ' ' AS r, ' ' || array_to_string(hyp, ' ') || ' ' AS h FROM pairs),
t AS (SELECT *, list_filter(['the', 'of', 'and', 'to', 'der', 'de', 'en', 'the of', 'of the'], lambda x: contains(r, ' ' || x || ' ')) AS there FROM s)
SELECT session_id, turn, len(there) AS n_jargon, CASE WHEN len(there) = 0 THEN 1.0 ELSE len(list_filter(there, lambda x: contains(h, ' ' || x || ' '))) / len(there) END AS recall FROM t""", ("segments",))
def jargon_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.jargon_recall(pairs(spark, sf_dir), TAGS).select("session_id", "turn", "n_jargon", "recall")


@query("run_compare", """b AS (SELECT session_id, seg, CASE WHEN turn % 5 = 4 THEN text || '.' ELSE text END AS text, t0_us + turn * 9000 AS t0_us FROM segments WHERE turn < 7)
SELECT session_id, bool_and(coalesce(a.text = b.text AND abs(a.t0_us - b.t0_us) <= 20000, false)) AS same FROM segments a FULL JOIN b USING (session_id, seg) GROUP BY 1""", ("segments",))
def run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "segments")
    other = s.where("turn < 7").select("session_id", "seg", F.when(F.col("turn") % 5 == 4, F.concat("text", F.lit("."))).otherwise(F.col("text")).alias("text"), (F.col("t0_us") + F.col("turn") * 9000).alias("t0_us"))
    return text.run_compare(s, other)


@query("tag_hits", """d AS (SELECT doc_id AS id, regexp_replace(text, '([^\\p{L}\\p{N}_])', '\\1\\1', 'g') AS doubled FROM documents),
t AS (SELECT id, replace(unnest(regexp_extract_all(doubled, '(?:^|[^\\p{L}\\p{N}_])(of  the|the  of|and|der|the|de|en|of|to)(?:$|[^\\p{L}\\p{N}_])', 1)), '  ', ' ') AS tag FROM d)
SELECT id, tag, count(*) AS n FROM t GROUP BY ALL""")
def tag_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL doubles the marks between words, since its boundaries are part of the match."""
    d = base(spark, sf_dir, "documents")
    return text.tag_hits(d.select(F.col("doc_id").alias("id"), "text"), TAGS)


@query("first_sentence", "SELECT doc_id, regexp_extract(trim(text), '(?s)^(.*?)([.!?]\\s.*)?$', 1) || CASE WHEN regexp_matches(trim(text), '(?s)^.*?[.!?]\\s') THEN regexp_extract(trim(text), '(?s)^.*?([.!?])\\s', 1) ELSE '' END AS sentence FROM documents")
def first_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir, "documents").select("doc_id", text.first_sentence(F.col("text")).alias("sentence"))


@query("stated_lab", """p AS (SELECT p_partkey, p_name, p_brand, p_type, regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}_]+') AS s, regexp_extract_all(lower(p_type), '[\\p{L}\\p{N}_]+') AS l FROM part)
SELECT p_partkey, CASE WHEN len(s) > 0 AND len(l) > 0 THEN array_to_string(s, '') = array_to_string(l, '') OR len(list_intersect(s, l)) > 0 END AS agrees FROM p""")
def stated_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir, "part").select("p_partkey", text.stated_agrees(F.col("p_name"), F.col("p_type"), F.lit(None).cast("string")).alias("agrees"))


GRAMMAR = tags.TagGrammar(playbooks={"A": True, "B": True, "OLD": False}, aliases={}, variants={}, entries=["E_LIMIT", "E_STOP"], triggers={"1": True, "2": True}, vocabulary=["lvl"], qualifiers=["-R"])


@query(
    "tag_validation",
    """e AS (SELECT event_id AS i FROM events) SELECT i AS trade_id, code, tag FROM (
  SELECT i, CASE i % 5 WHEN 0 THEN 'playbook_missing' WHEN 2 THEN 'playbook_multiple' WHEN 3 THEN 'playbook_unknown' WHEN 4 THEN 'playbook_inactive' END AS code, CASE i % 5 WHEN 2 THEN 'PB_A,PB_B' WHEN 3 THEN 'PB_X' WHEN 4 THEN 'PB_OLD' END AS tag FROM e
  UNION ALL SELECT i, CASE i % 3 WHEN 0 THEN 'entry_missing' WHEN 2 THEN 'entry_multiple' END, CASE i % 3 WHEN 2 THEN 'E_LIMIT,E_STOP' END FROM e
  UNION ALL SELECT i, CASE i % 4 WHEN 2 THEN 'trigger_unknown' WHEN 3 THEN 'trigger_multiple' END, CASE i % 4 WHEN 2 THEN 'T_9' WHEN 3 THEN 'T_1,T_2' END FROM e
  UNION ALL SELECT i, CASE i % 7 WHEN 0 THEN 'confluence_missing' WHEN 4 THEN 'c_none_with_confluence' WHEN 5 THEN 'charset_violation' WHEN 6 THEN 'unknown_tag' END, CASE i % 7 WHEN 5 THEN 'bad tag!' WHEN 6 THEN 'unknownx' END FROM e) WHERE code IS NOT NULL""",
)
def tag_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")

    def pick(m: int, *sets: str):
        out = F.array().cast("array<string>")
        for k, s in enumerate(sets):
            if s:
                out = F.when(i % m == k, F.array(*(F.lit(t) for t in s.split(",")))).otherwise(out)
        return out

    t = F.concat(pick(5, "", "PB_A", "PB_A,PB_B", "PB_X", "PB_OLD"), pick(3, "", "E_LIMIT", "E_LIMIT,E_STOP"), pick(4, "", "T_1", "T_9", "T_1,T_2"), pick(7, "", "lvl", "lvl-R", "C_NONE", "C_NONE,lvl", "bad tag!", "unknownx"))
    return tags.grammar_errors(base(spark, sf_dir, "events").select(i.alias("trade_id"), t.alias("tags")), GRAMMAR)
