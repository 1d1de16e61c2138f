"""Licence scan: Dice coefficient of word bigrams between windows of a text and licence templates.

Text is normalised (A-Z lower-cased, words are runs of ASCII letters, digits and
non-ASCII characters, line ends are blanks like others). A template of n bigrams is
compared with every window of the whole text: Dice = 2 * shared / (n + size), repeats
of a bigram counted. Since shared <= min(n, size), only sizes from n * t / (2 - t) to
n * (2 - t) / t can reach t. Long templates are compared in two passes: first in steps of n // 16,
then at every size in between that could still reach t and beat the best so far. That
is bounded by the larger neighbour, whose windows contain those of the sizes below it: shared <= min(its
shared, size). So the result is that of all sizes. A window may stick out of the text; what is outside
shares nothing.

The shared bigrams of all windows of a size come from one sweep: an occurrence counts
for the starts between its own position less the size and itself, but only after the
occurrence which would be one too many of its bigram.

Null, empty and one-word texts have no bigrams and match nothing. Rows of documents with
the same id are scanned each and summed up together. Documents without a match get zero
licences, an empty list and a null best_dice. Every licence with a template that
reaches the threshold counts. Extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, materialize, read_table
from .license_texts import TEMPLATES

#: Templates are broadcast: their bigrams in all, at most.
MAX_TEMPLATE_BIGRAMS = 100_000
THRESHOLD = 0.8


def words(text: Column) -> Column:
    parts = F.split(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.filter(parts, lambda w: w != "")


def bigrams(ws: Column) -> Column:
    """All bigrams in order; null behind the last."""
    return F.zip_with(ws, F.slice(ws, 2, F.greatest(F.size(ws), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))


def template_pairs(text: str) -> list[tuple[str, str]]:
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(UPPER, LOWER)))
    return list(zip(ws, ws[1:]))


def sizes(n: int, threshold: float) -> list[int]:
    """Sizes of windows that are compared first with a template of n bigrams: those that can match, in steps."""
    low, high = math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)
    step = max(1, n // 16)
    return sorted({max(low, 1), max(high, 1), *range(n, low - 1, -step), *range(n, high + 1, step)})


def least_shared(n: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * (n + sizes(n, threshold)[0]) / 2 - 1e-9))


def telling_words(texts: Iterable[str], threshold: float) -> list[tuple[str, ...]] | None:
    """Sets of words of which every matching text has at least one whole; null if the ASCII words don't suffice.

    A match shares at least m of a template's n bigrams, so it holds one of any n - m + 1 of them. Long words that are in many
    bigrams are chosen until that many bigrams hold one; where the long words run out, bigrams are taken with both words.
    """
    chosen: set[tuple[str, ...]] = set()
    for text in texts:
        pairs = template_pairs(text)
        short = len(pairs) - least_shared(len(pairs), threshold) + 1 if pairs else 0

        def open_pairs() -> list[tuple[str, str]]:
            return [p for p in pairs if p not in chosen and (p[0],) not in chosen and (p[1],) not in chosen]

        while len(pairs) - len(left := open_pairs()) < short:
            long = Counter(w for p in left for w in set(p) if w.isascii() and len(w) > 4)
            plain = [p for p in left if (p[0] + p[1]).isascii()]
            if long:
                chosen.add((max(long, key=lambda w: (min(len(w), 9) ** 2 * long[w], w)),))
            elif plain:
                chosen.add(max(plain, key=lambda p: (len(p[0] + p[1]), p)))
            else:
                return None
    return sorted(chosen)


def scan_windows(docs: DataFrame, templates: Iterable[tuple[str, str]] = tuple(TEMPLATES), threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, row, license, dice: the best window of every row of docs (doc_id, text) for each licence that it reaches."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    spark = docs.sparkSession
    listed = [(k, name, Counter(f"{a} {b}" for a, b in ps), len(ps), text) for k, (name, text) in enumerate(templates) if (ps := template_pairs(text))]
    if sum(len(c) for _, _, c, _, _ in listed) > MAX_TEMPLATE_BIGRAMS:
        raise ValueError(f"at most {MAX_TEMPLATE_BIGRAMS} template bigrams are broadcast")
    wanted = spark.createDataFrame(
        [(k, name, n, least_shared(n, threshold), b, m) for k, name, c, n, _ in listed for b, m in c.items()], "template int, license string, n int, need int, bigram string, times int"
    )
    tried = spark.createDataFrame([(k, s) for k, _, _, n, _ in listed for s in sizes(n, threshold)], "template int, size int")
    telling = telling_words((text for *_, text in listed), threshold)
    likely = F.lit(True) if telling is None else reduce(Column.__or__, (reduce(Column.__and__, (F.lower("text").contains(w) for w in ws)) for ws in telling), F.lit(False))

    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text").where(likely)
    met = numbered.select("doc_id", "row", F.posexplode(bigrams(words(F.col("text")))).alias("pos", "bigram")).join(F.broadcast(wanted), "bigram")
    # A row's occurrences of a template stay together from here on: one shuffle.
    keys = ["doc_id", "row", "template", "license", "n"]
    lists = met.repartition("row", "template").groupBy(*keys, "need", "bigram", "times").agg(F.array_sort(F.collect_list("pos")).alias("at"))
    most = F.sum(F.least(F.size("at"), F.col("times"))).over(Window.partitionBy("row", "template"))
    enough = lists.withColumn("most", most).where(F.col("most") >= F.col("need"))
    each = enough.select(*keys, F.expr("inline(transform(at, (p, i) -> struct(p AS pos, get(at, i - times) AS one_too_many)))"))
    each = materialize(each, "occurrences")
    coarse = materialize(_sweep(each, each.join(F.broadcast(tried), "template")), "coarse")

    # Sizes between a size and the next smaller tried one, where the bound lets them matter.
    by_size = Window.partitionBy("row", "template").orderBy("size")
    below = F.lag("size").over(by_size)
    gaps = coarse.withColumns({"below": below, "best": F.max(_dice()).over(Window.partitionBy("row", "template"))}).where(F.col("size") - F.col("below") > 1)
    peak = F.least(F.greatest("shared", F.col("below") + 1), F.col("size") - 1)
    bound = 2 * F.least("shared", peak) / (F.col("n") + peak)
    open_gaps = gaps.where((bound >= threshold) & (bound > F.col("best")))
    finer = open_gaps.select(F.col("row").alias("g_row"), F.col("template").alias("g_template"), F.explode(F.sequence(F.col("below") + 1, F.col("size") - 1)).alias("size"))
    fine = _sweep(each, each.join(finer, (F.col("row") == F.col("g_row")) & (F.col("template") == F.col("g_template"))).drop("g_row", "g_template"))
    found = coarse.unionByName(fine).select("doc_id", "row", "license", _dice().alias("dice"))
    return found.where(F.col("dice") >= threshold).groupBy("doc_id", "row", "license").agg(F.max("dice").alias("dice"))


def _dice() -> Column:
    return 2 * F.col("shared") / (F.col("n") + F.col("size"))


def _sweep(each: DataFrame, sized: DataFrame) -> DataFrame:
    """doc_id, row, template, license, n, size, shared: the most that a window of a size shares. sized: occurrences (each) with the sizes to try."""
    keys = [c for c in each.columns if c not in ("pos", "one_too_many")]
    starts = sized.withColumn("first", F.greatest(F.col("pos") - F.col("size") + 1, F.col("one_too_many") + 1))
    steps = starts.select(*keys, "size", F.explode(F.array(F.struct(F.col("first").alias("start"), F.lit(1).alias("change")), F.struct((F.col("pos") + 1).alias("start"), F.lit(-1).alias("change")))).alias("e")).select(*keys, "size", "e.*")
    shared = F.sum("change").over(Window.partitionBy("row", "template", "size").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return steps.withColumn("shared", shared).groupBy(*keys, "size").agg(F.max("shared").alias("shared"))


def scan_licenses(docs: DataFrame, templates: Iterable[tuple[str, str]] = tuple(TEMPLATES), threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_licenses, licenses, best_dice for each distinct id of docs; best_dice is null without a match."""
    found = scan_windows(docs, templates, threshold).groupBy("doc_id").agg(
        F.count_distinct("license").alias("n_licenses"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"), F.max("dice").alias("best_dice")
    )
    ids = docs.select(F.col("doc_id").alias("id")).distinct()
    joined = ids.join(found, F.col("id").eqNullSafe(F.col("doc_id")), "left")
    return joined.select(
        F.col("id").alias("doc_id"), F.coalesce("n_licenses", F.lit(0)).cast("long").alias("n_licenses"), F.coalesce("licenses", F.lit("")).alias("licenses"), "best_dice"
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_PAIRS = "unnest([{{'pos': i, 'bigram': ws[i] || ' ' || ws[i + 1]}} for i in range(1, len(ws))])"
_VALUES = ", ".join("({}, '{}', '{}')".format(k, name, text.replace("'", "''")) for k, (name, text) in enumerate(TEMPLATES))

ORACLE_SQL = f"""
WITH t0(template, license, text) AS (VALUES {_VALUES}),
t1 AS (SELECT template, license, {_WORDS.format("text")} ws FROM t0),
t2 AS (SELECT template, license, len(ws) - 1 AS n, {_PAIRS.format()} p FROM t1),
t AS (SELECT template, license, n, p.bigram AS bigram, count(*) AS times FROM t2 GROUP BY ALL),
sizes AS (SELECT template, unnest(range(greatest(ceil(any_value(n) * {THRESHOLD} / (2 - {THRESHOLD}) - 1e-9), 1)::BIGINT, floor(any_value(n) * (2 - {THRESHOLD}) / {THRESHOLD} + 1e-9)::BIGINT + 1)) AS size FROM t GROUP BY template),
d0 AS (SELECT doc_id, row_number() OVER () AS nr, text FROM documents),
d1 AS (SELECT doc_id, nr, {_WORDS.format("text")} ws FROM d0),
d2 AS (SELECT doc_id, nr, {_PAIRS.format()} p FROM d1),
o AS MATERIALIZED (SELECT doc_id, nr, template, license, n, p.pos AS pos, bigram, times FROM d2 JOIN t ON p.bigram = t.bigram),
w AS (SELECT a.doc_id, a.nr, a.template, a.license, a.n, size, a.pos AS start, b.bigram, least(count(*), any_value(b.times)) AS k
      FROM o a JOIN sizes s ON s.template = a.template JOIN o b ON b.nr = a.nr AND b.template = a.template AND b.pos >= a.pos AND b.pos < a.pos + size GROUP BY ALL),
m AS (SELECT doc_id, license, 2 * sum(k)::BIGINT / (n + size)::DOUBLE AS dice FROM w GROUP BY doc_id, nr, template, license, n, size, start),
f AS (SELECT doc_id, count(DISTINCT license) n_licenses, string_agg(DISTINCT license, ',' ORDER BY license) licenses, max(dice) best_dice
      FROM m WHERE dice >= {THRESHOLD} GROUP BY doc_id)
SELECT ids.doc_id, coalesce(n_licenses, 0)::BIGINT n_licenses, coalesce(licenses, '') licenses, best_dice
FROM (SELECT DISTINCT doc_id FROM documents) ids LEFT JOIN f USING (doc_id)
"""
