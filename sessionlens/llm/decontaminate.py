"""Benchmark decontamination with a generalised suffix automaton of the test items.

Words are runs of 0-9, a-z (A-Z lower-cased) and non-ASCII characters. The items' words
form a suffix automaton; every document's words are streamed through it, and the longest
matching length at each word tells where windows of items (``window`` consecutive words,
or a whole shorter item) end. Words inside occurring windows are hit.

The automaton is sent to the tasks, so an item block holds about ``block_words`` words at most;
a larger benchmark is taken in several blocks, of which the driver holds one at a time, with one narrow pass over the documents each,
and the passes' spans are merged by document.

Null and empty texts have no words and no hits; items without words or without an id are
left out; repeated item ids are one item with all their windows. Repeated document ids are
matched row by row. Texts of any length are taken whole. Extra columns are not read by
``match_items`` and are carried by ``remove_matches``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import WORD_BYTES, ItemAutomaton, words_of
from .common import Scratch, lean, materialize, read_table, small_batches

WINDOW = 10
BLOCK_WORDS = 200_000
#: A document of which a larger share of words is hit is dropped as a whole.
MAX_COVERAGE = 0.5


def item_blocks(benchmark: DataFrame, scratch: Scratch, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items (id as text, words), a block of about block_words words or fewer at a time; at least one block.

    Longer items are cut into pieces that overlap by window - 1 words, so that each of their windows is in a piece.
    """
    step = max(1, block_words // 4)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t in zip(b["i"], b["text"]):
                ws = words_of(t)
                out += [(i, at, b" ".join(ws[at : at + step + window - 1]), min(len(ws) - at, step + window - 1)) for at in range(0, max(1, len(ws) - window + 1), step) if ws]
            yield pd.DataFrame(out, columns=["i", "at", "words", "n"])

    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("i"), "text")
    pieces = scratch.table(rows.mapInPandas(cut, "i string, at long, words binary, n long"), "items")
    blocks = max(1, math.ceil((pieces.agg(F.sum("n")).first()[0] or 0) / block_words * 2 - 1))
    numbered = pieces.withColumn("block", F.pmod(F.xxhash64("i", "at", "words"), F.lit(blocks)))
    if blocks > 1:
        numbered = scratch.table(numbered.repartition("block").sortWithinPartitions("block"), "blocks")
    for block in range(blocks):
        found = numbered.where(F.col("block") == block).orderBy("i", "at", "words").toPandas()
        yield [(i, ws.split(b" ")) for i, ws in zip(found["i"], found["words"])]


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def match_items(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_words, n_hit, items (sorted ids), spans (word ranges [start, end) that are hit)."""
    if window < 1:
        raise ValueError("window must be at least 1")
    kind = docs.schema["doc_id"].dataType.simpleString()
    sc = docs.sparkSession.sparkContext
    schema = f"doc_id {kind}, row long, n_words long, items array<string>, spans array<array<long>>"

    def one(source: DataFrame, block: list) -> DataFrame:
        sent = sc.broadcast(block)

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            automaton = ItemAutomaton(sent.value, window)
            for b in batches:
                n, items, spans = [], [], []
                for t in b["text"]:
                    ws = words_of(t)
                    at, found = automaton.match(ws)
                    n.append(len(ws))
                    items.append(sorted({automaton.names[i] for i in found}))
                    spans.append([list(x) for x in at])
                yield pd.DataFrame({"doc_id": b["doc_id"], "row": b["row"], "n_words": n, "items": items, "spans": spans})

        return source.mapInPandas(each, schema)

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(spans=[_merged([[int(x) for x in s] for s in spans]) for spans in b["spans"]])

    source = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    with Scratch(docs.sparkSession) as scratch:
        blocks = item_blocks(benchmark, scratch, window, block_words)
        block, after = next(blocks), next(blocks, None)
        if after is None:
            out = one(source, block)
        else:
            # Row numbers must be the same in every pass; each pass ends before the next block is fetched.
            source, every = scratch.table(source, "numbered"), None
            while block is not None:
                found = scratch.table(one(source, block), "found")
                every = found if every is None else every.unionByName(found)
                block, after = after, next(blocks, None)
            grouped = every.groupBy("row").agg(
                F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans")
            )
            out = materialize(grouped.select("doc_id", "row", "n_words", "items", "spans").mapInPandas(merged, schema), "matches")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", "spans")


_RUN = re.compile(rb"[^ ]+")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the characters from the first to the last word of each span."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _RUN.finditer(raw.translate(WORD_BYTES))]
    out, done = [], 0
    for a, b in spans:
        out.append(raw[done : at[a][0]])
        done = at[b - 1][1]
    return (b"".join(out) + raw[done:]).decode("utf-8", "surrogatepass")


def remove_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the hit spans of their texts; rows of which more than max_coverage of the words are hit are dropped.

    One pass for each block of items, written before the next block is fetched: a later block is matched against
    the text that the earlier ones saw, by carrying the spans along.
    """
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    columns = docs.columns
    held = "__spans"
    while held in columns:
        held += "_"

    def one(out: DataFrame, block: list, last: bool) -> DataFrame:
        sent = sc.broadcast(block)

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            automaton = ItemAutomaton(sent.value, window)
            for b in batches:
                texts, spans, keep = [], [], []
                for t, before in zip(b["text"], b[held]):
                    ws = words_of(t)
                    at, _ = automaton.match(ws)
                    every = _merged([[int(x) for x in s] for s in before] + [list(x) for x in at])
                    covered = sum(y - x for x, y in every)
                    keep.append(not last or covered <= max_coverage * len(ws))
                    texts.append(cut_words(t, every) if last and every else t)
                    spans.append(every)
                b = b.assign(**{"text": texts, held: spans})
                yield b[keep] if last else b

        return out.mapInPandas(lean(each), out.schema)

    out = docs.withColumn(held, F.array().cast("array<array<long>>"))
    with Scratch(docs.sparkSession) as scratch:
        blocks = item_blocks(benchmark, scratch, window, block_words)
        block, after = next(blocks), next(blocks, None)
        if after is None:
            return one(out, block, True).select(*columns)
        while after is not None:
            out = scratch.table(one(out, block, False), "spans")
            block, after = after, next(blocks, None)
        return materialize(one(out, block, True).select(*columns), "clean")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = match_items(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL = f"""
WITH items AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
wins AS (
  SELECT DISTINCT item, least(len(ws), {WINDOW}) AS w, array_to_string(ws[i : i + least(len(ws), {WINDOW}) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(ws) - least(len(ws), {WINDOW}) + 2)) AS i FROM items WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT w FROM wins),
docs AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
grams AS (SELECT doc_id, w, i, array_to_string(ws[i : i + w - 1], ' ') AS win FROM (SELECT doc_id, ws, w, unnest(range(1, len(ws) - w + 2)) AS i FROM docs, lens WHERE len(ws) >= w)),
occ AS (SELECT doc_id, i, wins.w, item FROM grams JOIN wins ON grams.w = wins.w AND grams.win = wins.win),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + w)) AS p FROM (SELECT DISTINCT doc_id, i, w FROM occ)) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM occ GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN found USING (doc_id)
"""
