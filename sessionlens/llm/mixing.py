"""Mixing sources to target weights by Poisson replication.

A source of n documents with target share w of a mixture of T documents is repeated at
the rate w * T / n. Each document's number of copies is a Poisson variable of that mean,
found by inverting the distribution (of equal parts of it, if the mean is large) at a uniform
number made from a hash of seed and document id: no random state, the same result on any partitioning. Each document is
exploded by its count, and the copies are dealt to partitions and ordered by a further
hash: a global shuffle.

Null sources are a source of their own. Null texts are mixed like others. Null ids share
one hash; repeated ids get equal counts, each row its own copies. Sources without a given
weight get their share by ``temperature``: proportional to n ** temperature. An empty table
gives no rows. Extra columns of docs are carried; copy_no, n_copies and mix_key are added
and replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table

TEMPERATURE = 0.5
SEED = 42
#: Hash digits (base 16) of the uniform number: 52 bits.
DIGITS = 13
#: A larger mean is the sum of independent parts of this mean at most, each with a uniform number of its own.
MAX_RATE = 200.0
#: Copies that one explode lists.
COPIES = 1 << 16


def hash52(name: str, seed: int, *cols: Column) -> Column:
    """A uniform integer of 52 bits from the MD5 of a name, the seed and the columns."""
    text = F.concat_ws(":", F.lit(f"{name}:{seed}"), *(F.coalesce(c.cast("string"), F.lit("")) for c in cols))
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")


def poisson_cdf(rate: Column) -> Column:
    """P(N <= 0), P(N <= 1), ... up to where the rest has no weight at 52 bits."""
    steps = F.sequence(F.lit(1), (rate + 12 * F.sqrt(rate) + 24).cast("int"))
    zero = F.exp(-rate)
    both = F.aggregate(
        steps,
        F.struct(zero.alias("p"), F.array(zero).alias("cdf")),
        lambda a, k: F.struct((a.p * rate / k).alias("p"), F.concat(a.cdf, F.array(F.element_at(a.cdf, -1) + a.p * rate / k)).alias("cdf")),
    )
    return both.cdf


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = TEMPERATURE, total: float | None = None) -> DataFrame:
    """r_source, rate, parts, cdf: the mean repetitions of each source's documents; the distribution is that of one of the equal parts.

    weights: target shares by source (unnamed sources then have none and vanish);
    total: documents of the mixture, as many as docs has by default.
    """
    sizes = materialize(docs.groupBy("source").agg(F.count("*").alias("n")), "sources")
    if weights is None:
        share = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    else:
        share = F.lit(0.0)
        for name, w in weights.items():
            share = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(share)
    shared = materialize(sizes.select("source", "n", share.alias("share")).orderBy("source"), "shares")
    sums = shared.agg(F.sum("n"), F.sum("share")).first()
    n, s = float(sums[0] or 0), float(sums[1] or 0)
    rate = F.col("share") / F.lit(s or 1.0) * F.lit(n if total is None else float(total)) / F.col("n")
    out = shared.select(F.col("source").alias("r_source"), rate.alias("rate"))
    parts = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("rate") / MAX_RATE))
    return materialize(out.withColumn("parts", parts).select("r_source", "rate", "parts", poisson_cdf(F.col("rate") / F.col("parts")).alias("cdf")), "rates")


def poisson_count(seed: int, doc_id: Column, cdf: Column, parts: Column) -> Column:
    """Sum of the parts' counts; the first part's number is made from seed and id alone."""

    def part(*key: Column) -> Column:
        u = hash52("count", seed, doc_id, *key) / F.lit(float(1 << (4 * DIGITS)))
        return F.size(F.filter(cdf, lambda c: c <= u)).cast("long")

    more = F.aggregate(F.sequence(F.lit(1).cast("long"), parts - 1), F.lit(0).cast("long"), lambda n, i: n + part(i))
    return part() + F.when(parts > 1, more).otherwise(F.lit(0).cast("long"))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = TEMPERATURE, total: float | None = None, seed: int = SEED) -> DataFrame:
    """docs' columns with copy_no (from 1), n_copies and mix_key, in shuffled order."""
    docs = docs.drop("copy_no", "n_copies", "mix_key", "__cdf", "__parts", "__block")
    by_source = rates(docs, weights, temperature, total).select("r_source", F.col("cdf").alias("__cdf"), F.col("parts").alias("__parts"))
    joined = docs.join(by_source, docs["source"].eqNullSafe(by_source["r_source"])).drop("r_source")
    counted = joined.withColumn("n_copies", poisson_count(seed, F.col("doc_id"), F.col("__cdf"), F.col("__parts"))).drop("__cdf", "__parts")
    blocks = counted.where("n_copies > 0").withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_copies") - 1) / COPIES))))
    first = F.col("__block") * COPIES
    copies = blocks.withColumn("copy_no", F.explode(F.sequence(first + 1, F.least(first + COPIES, F.col("n_copies"))))).drop("__block")
    keyed = copies.withColumn("mix_key", hash52("order", seed, F.col("doc_id"), F.col("copy_no")))
    return keyed.repartition(F.col("mix_key")).sortWithinPartitions("mix_key", "doc_id", "copy_no")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return mix(docs)


ORACLE_SQL = f"""
WITH RECURSIVE sizes AS (SELECT source, count(*) n, pow(count(*)::DOUBLE, {TEMPERATURE}) share FROM documents GROUP BY source),
sums AS (SELECT sum(n)::DOUBLE n, sum(share ORDER BY source) s FROM sizes),
rates AS (SELECT source, share / sums.s * sums.n / sizes.n AS rate FROM sizes, sums),
cdf AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < floor(rate + 12 * sqrt(rate) + 24)),
u AS (SELECT doc_id, source, lang, text, ('0x' || substr(md5('count:{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, {DIGITS}))::BIGINT / pow(2, {4 * DIGITS}) AS u FROM documents),
n AS (SELECT doc_id, any_value(u.source) source, any_value(lang) lang, any_value(text) text, count(*) FILTER (WHERE c <= u) AS n_copies
      FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source GROUP BY doc_id),
e AS (SELECT doc_id, source, lang, text, n_copies, unnest(range(1, n_copies + 1)) AS copy_no FROM n)
SELECT *, ('0x' || substr(md5('order:{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || copy_no), 1, {DIGITS}))::BIGINT AS mix_key FROM e
"""
