"""URL filter: ordered host/path rules, then empirical-Bayes host reputation.

Rules decide first. Where none fits, the reputation of the host decides: labelled
page outcomes are shrunk through beta-binomial priors from the whole table to the
suffix, to the registered domain, to the host; a page passes if a lower bound of
the posterior share of good pages reaches a threshold.

Null urls, urls without ``://`` and empty urls have an empty host and path, fit no
rule and share one (empty) host. Repeated rows are judged each; repeated labels are
further trials. Null labels and labels of pages that don't exist count as nothing.
With no labels at all the share of good pages is taken as 0.5 with no certainty.
Extra columns of the inputs are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, join_on_copy, materialize, read_table

#: Rules are compiled into one expression; larger lists don't belong in a query plan.
MAX_RULES = 1000


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


PRODUCTION_RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)
#: Suffixes of more than one label that registered domains are counted below.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")
THRESHOLD = 0.5
#: One-sided 95 %.
Z = 1.6448536269514722
MIN_RHO, MAX_RHO = 1e-6, 0.999999


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[UrlRule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; of equally long ones the first listed."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are compiled")
    text = verdict = None
    for r in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text = (F if text is None else text).when(fits, F.lit(r.text))
        verdict = (F if verdict is None else verdict).when(fits, F.lit(r.verdict))
    none = F.lit(None).cast("string")
    return (none if text is None else text), (none if verdict is None else verdict)


def domain_parts(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host (without user and port)."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":\d*$", "")
    last2, last3 = F.substring_index(bare, ".", -2), F.substring_index(bare, ".", -3)
    long = last2.isin(*LONG_SUFFIXES)
    suffix = F.when(long, last2).otherwise(F.substring_index(bare, ".", -1))
    return F.when(long, last3).otherwise(last2), suffix


def prior_strength(groups: float, n: float, k: float, k2n: float, n2: float) -> float:
    """Strength (a + b) of the beta prior over a level's groups, by the method of moments.

    n, k: sums of trials and successes; k2n: sum of k*k/n; n2: sum of n*n.
    """
    if n <= 0 or groups < 2 or k <= 0 or k >= n or n - n2 / n - (groups - 1) <= 0:
        return 1 / MIN_RHO - 1
    p = k / n
    spread = (k2n - p * p * n) / (p * (1 - p))
    rho = (spread - (groups - 1)) / (n - n2 / n - (groups - 1))
    return 1 / min(max(rho, MIN_RHO), MAX_RHO) - 1


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float = Z) -> DataFrame:
    """host, n, k, bound: labelled pages, good ones, and the lower bound of the host's posterior.

    pages: page_id, host (every host gets a row); outcomes: page_id, good (0 or 1).
    """
    marked = outcomes.where("page_id is not null and good is not null").groupBy("page_id").agg(
        F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("k")
    )
    hosts = (
        pages.join(marked, "page_id", "left")
        .groupBy("host")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
    )
    domain, suffix = domain_parts(F.col("host"))
    hosts = materialize(hosts.select("host", "n", "k", domain.alias("domain"), suffix.alias("suffix")), "hosts")
    level = F.explode(
        F.array(
            F.struct(F.lit("host").alias("level"), F.col("host").alias("name")),
            F.struct(F.lit("domain").alias("level"), F.col("domain").alias("name")),
            F.struct(F.lit("suffix").alias("level"), F.col("suffix").alias("name")),
        )
    )
    levels = hosts.select(level.alias("x"), "n", "k").groupBy("x.level", "x.name").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    levels = materialize(levels, "levels")
    # Three rows, one for each level.
    stats = {
        r["level"]: r
        for r in levels.where("n > 0")
        .groupBy("level")
        .agg(
            F.count("*").cast("double").alias("g"),
            F.sum("n").cast("double").alias("n"),
            F.sum("k").cast("double").alias("k"),
            F.sum(F.col("k") * F.col("k") / F.col("n")).alias("k2n"),
            F.sum((F.col("n") * F.col("n")).cast("double")).alias("n2"),
        )
        .collect()
    }
    strength = {at: prior_strength(*(stats[at][c] for c in ("g", "n", "k", "k2n", "n2"))) if at in stats else 1 / MIN_RHO - 1 for at in ("suffix", "domain", "host")}
    mean = stats["host"]["k"] / stats["host"]["n"] if "host" in stats else 0.5

    def shrunk(k: Column, n: Column, prior: Column, s: float) -> Column:
        return (k + prior * F.lit(s)) / (n + F.lit(s))

    def of(level: str, to: str) -> DataFrame:
        return levels.where(F.col("level") == level).select(F.col("name").alias(to), F.col("n").alias(f"n_{level}"), F.col("k").alias(f"k_{level}"))

    out = hosts.join(of("domain", "domain"), "domain").join(of("suffix", "suffix"), "suffix")
    by_suffix = shrunk(F.col("k_suffix"), F.col("n_suffix"), F.lit(mean), strength["suffix"])
    by_domain = shrunk(F.col("k_domain"), F.col("n_domain"), by_suffix, strength["domain"])
    post = shrunk(F.col("k"), F.col("n"), by_domain, strength["host"])
    bound = post - F.lit(z) * F.sqrt(post * (1 - post) / (F.col("n") + F.lit(strength["host"] + 1)))
    return out.select("host", "n", "k", bound.alias("bound"))


def filter_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[UrlRule] = PRODUCTION_RULES,
    threshold: float = THRESHOLD,
    z: float = Z,
) -> DataFrame:
    """page_id, host, path, rule, verdict, host_labelled, host_good for each row of pages (page_id, url)."""
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    reputation = host_reputation(seen.select("page_id", "host"), outcomes, z).withColumnRenamed("host", "r_host")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = join_on_copy(seen, reputation, "host", "r_host", "left")
    learned = F.when(F.col("bound") >= threshold, "allow").otherwise("block")
    return judged.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"),
        F.col("n").alias("host_labelled"), F.col("k").alias("host_good"),
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled outcomes: labels.quality of the document with the page's number."""
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return filter_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"), labels)


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LONG = ", ".join(f"'{s}'" for s in LONG_SUFFIXES)
_RULES = sorted(PRODUCTION_RULES, key=lambda r: -len(r.text))
_FITS = [(f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))", r) for r in _RULES]


def _strength(a: str) -> str:
    return f"""CASE WHEN {a}.n IS NULL OR {a}.g < 2 OR {a}.k <= 0 OR {a}.k >= {a}.n OR {a}.n - {a}.n2 / {a}.n - ({a}.g - 1) <= 0 THEN 1 / {MIN_RHO}::DOUBLE - 1
      ELSE 1 / least(greatest((({a}.k2n - {a}.k / {a}.n * ({a}.k / {a}.n) * {a}.n) / ({a}.k / {a}.n * (1 - {a}.k / {a}.n)) - ({a}.g - 1)) / ({a}.n - {a}.n2 / {a}.n - ({a}.g - 1)), {MIN_RHO}::DOUBLE), {MAX_RHO}::DOUBLE) - 1 END"""


_STATS = "SELECT count(*)::DOUBLE g, sum(n)::DOUBLE n, sum(k)::DOUBLE k, sum(k * k / n::DOUBLE) k2n, sum(n * n)::DOUBLE n2 FROM {} WHERE n > 0"

ORACLE_SQL = f"""
WITH seen AS (
  SELECT page_id, {_LOW.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
marked AS (SELECT doc_id AS page_id, count(*) n, sum(quality)::BIGINT k FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
hosts0 AS (SELECT host, coalesce(sum(n), 0)::BIGINT n, coalesce(sum(k), 0)::BIGINT k FROM seen LEFT JOIN marked USING (page_id) GROUP BY host),
bare AS (SELECT *, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') p FROM hosts0),
two AS (SELECT *, array_to_string(p[-2:], '.') l2, array_to_string(p[-3:], '.') l3 FROM bare),
hosts AS (SELECT host, n, k, CASE WHEN l2 IN ({_LONG}) THEN l3 ELSE l2 END AS domain, CASE WHEN l2 IN ({_LONG}) THEN l2 ELSE p[-1] END AS suffix FROM two),
domains AS (SELECT domain, sum(n)::BIGINT n, sum(k)::BIGINT k FROM hosts GROUP BY 1),
suffixes AS (SELECT suffix, sum(n)::BIGINT n, sum(k)::BIGINT k FROM hosts GROUP BY 1),
sh AS ({_STATS.format("hosts")}), sd AS ({_STATS.format("domains")}), ss AS ({_STATS.format("suffixes")}),
c AS (SELECT CASE WHEN sh.n IS NULL THEN 0.5 ELSE sh.k / sh.n END AS mean, {_strength("sh")} AS kh, {_strength("sd")} AS kd, {_strength("ss")} AS ks FROM sh, sd, ss),
post AS (
  SELECT host, hosts.n, hosts.k, kh,
    (hosts.k + ((domains.k + ((suffixes.k + mean * ks) / (suffixes.n + ks)) * kd) / (domains.n + kd)) * kh) / (hosts.n + kh) AS m
  FROM hosts JOIN domains USING (domain) JOIN suffixes USING (suffix), c)
SELECT page_id, host, path,
  CASE {" ".join(f"WHEN {f} THEN '{r.text}'" for f, r in _FITS)} END AS rule,
  CASE {" ".join(f"WHEN {f} THEN '{r.verdict}'" for f, r in _FITS)}
       WHEN m - {Z}::DOUBLE * sqrt(m * (1 - m) / (n + (kh + 1))) >= {THRESHOLD} THEN 'allow' ELSE 'block' END AS verdict,
  n AS host_labelled, k AS host_good
FROM seen JOIN post USING (host)
"""
