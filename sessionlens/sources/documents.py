"""Nested result documents as tables: transcripts, screen readings, page properties, stored responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALIGNED = "struct<segments: array<struct<text: string, start: double, end: double, words: array<struct<word: string, start: double, end: double, score: double>>>>>"
UTTERANCES = (
    "struct<metadata: struct<duration: double>, results: struct<utterances: array<struct<transcript: string, start: double, `end`: double>>, "
    "channels: array<struct<alternatives: array<struct<transcript: string>>>>>>"
)
READINGS = "struct<rec_texts: array<string>, rec_scores: array<double>, lines: array<struct<text: string, score: double>>>"
PROPERTY = "struct<type: string, title: array<struct<plain_text: string>>, rich_text: array<struct<plain_text: string>>, number: double, `select`: struct<name: string>, multi_select: array<struct<name: string>>, checkbox: boolean, url: string, date: struct<start: string>>"
#: Fixed value: cost of an audio hour if none is given.
HOUR_COST = 0.29


def _seg_ids(rows: DataFrame, key: str) -> DataFrame:
    """seg_000, seg_001, ... in order, after empty segments are gone."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(key).orderBy("i")) - 1
    return rows.withColumn("seg", F.format_string("seg_%03d", n)).drop("i")


def aligned_segments(docs: DataFrame, key: str = "session_id", column: str = "json") -> DataFrame:
    """key, seg, text, t0, t1, n_words: segments of the aligned shape; text from the words if it is empty, times from the first and last word."""
    each = docs.select(key, F.posexplode(F.from_json(column, ALIGNED)["segments"]).alias("i", "s"))
    words = F.filter(F.coalesce("s.words", F.array().cast("array<struct<word: string, start: double, end: double, score: double>>")), lambda w: F.trim(w.word) != "")
    text = F.trim(F.coalesce(F.nullif(F.trim("s.text"), F.lit("")), F.array_join(F.transform("w", lambda w: F.trim(w.word)), " ")))
    rows = each.withColumn("w", words).select(
        key, "i", text.alias("text"), F.coalesce(F.try_element_at("w", F.lit(1))["start"], "s.start").alias("t0"), F.coalesce(F.try_element_at("w", F.lit(-1))["end"], "s.end").alias("t1"), F.size("w").alias("n_words")
    )
    return _seg_ids(rows.where("text <> ''"), key)


def utterance_segments(docs: DataFrame, key: str = "session_id", column: str = "json") -> DataFrame:
    """key, seg, text, t0, t1: utterances, else the first alternative of the first channel as one segment."""
    d = docs.select(key, F.from_json(column, UTTERANCES).alias("d"))
    whole = F.array(F.struct(F.try_element_at(F.try_element_at("d.results.channels", F.lit(1))["alternatives"], F.lit(1))["transcript"].alias("transcript"), F.lit(0.0).alias("start"), F.col("d.metadata.duration").alias("end")))
    some = F.when(F.coalesce(F.size("d.results.utterances"), F.lit(0)) > 0, F.col("d.results.utterances")).otherwise(whole)
    rows = d.select(key, F.posexplode(some).alias("i", "s")).select(key, "i", F.trim("s.transcript").alias("text"), F.col("s.start").alias("t0"), F.col("s.end").alias("t1"))
    return _seg_ids(rows.where("text <> ''"), key)


def audio_cost(duration_s: Column, rate: Column) -> Column:
    """Cost of the audio hours; a missing or negative rate is the default one."""
    return F.round(duration_s / 3600 * F.when(rate >= 0, rate).otherwise(HOUR_COST), 6)


def reading_lines(docs: DataFrame, key: str = "reading_id", column: str = "json") -> DataFrame:
    """key, text, confidence: both reading layouts as joined lines and their mean score."""
    d = docs.select(key, F.from_json(column, READINGS).alias("d"))
    pairs = F.coalesce("d.lines", F.arrays_zip(F.col("d.rec_texts").alias("text"), F.col("d.rec_scores").alias("score")))
    lines = F.filter(pairs, lambda x: F.trim(x.text) != "")
    out = d.select(key, lines.alias("l"))
    return out.select(key, F.array_join(F.transform("l", lambda x: F.trim(x.text)), " ").alias("text"), (F.aggregate("l", F.lit(0.0), lambda a, x: a + x.score) / F.nullif(F.size("l"), F.lit(0))).alias("confidence"))


def page_properties(docs: DataFrame, key: str = "page_id", column: str = "json") -> DataFrame:
    """key, name, value: typed page properties as text."""
    each = docs.select(key, F.explode(F.from_json(column, f"map<string, {PROPERTY}>")).alias("name", "p"))

    def texts(c: str, field: str) -> Column:
        return F.array_join(F.transform(f"p.{c}", lambda x: x[field]), "" if field == "plain_text" else ",")

    n = F.col("p.number")
    value = (
        F.when(F.col("p.type") == "title", texts("title", "plain_text")).when(F.col("p.type") == "rich_text", texts("rich_text", "plain_text"))
        .when(F.col("p.type") == "number", F.when(n == F.floor(n), n.cast("long").cast("string")).otherwise(n.cast("string"))).when(F.col("p.type") == "select", F.col("p.select.name"))
        .when(F.col("p.type") == "multi_select", texts("multi_select", "name")).when(F.col("p.type") == "checkbox", F.col("p.checkbox").cast("string"))
        .when(F.col("p.type") == "url", F.col("p.url")).when(F.col("p.type") == "date", F.col("p.date.start"))
    )
    return each.select(key, "name", value.alias("value"))


def response_content(docs: DataFrame, key: str = "response_id", column: str = "json") -> DataFrame:
    """key, content, problem: the JSON text inside stored responses; fences are cut off, refusals and shapes without content are problems."""
    shape = "struct<choices: array<struct<message: struct<content: string, refusal: string>>>, candidates: array<struct<content: struct<parts: array<struct<text: string>>>>>>"
    d = docs.select(key, F.from_json(column, shape).alias("d"))
    first = F.try_element_at("d.choices", F.lit(1))["message"]
    other = F.array_join(F.transform(F.try_element_at("d.candidates", F.lit(1))["content"]["parts"], lambda x: x.text), "")
    raw = F.trim(F.coalesce(first["content"], other))
    content = F.trim(F.regexp_replace(raw, r"^```(?:json)?\s*|\s*```$", ""))
    problem = (
        F.when(first["refusal"].isNotNull(), "refusal").when(F.coalesce(content, F.lit("")) == "", "empty").when(F.try_parse_json(content).isNull(), "not json")
    )
    return d.select(key, F.when(problem.isNull(), content).alias("content"), problem.alias("problem"))
