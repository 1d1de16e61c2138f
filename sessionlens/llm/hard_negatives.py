"""Hard negatives of anchors from an inverted multi-index, exact.

Vectors are cut into two halves with a codebook each (k-means on a bounded sample); a
vector's cell is its pair of nearest centroids. A centroid's radius, over all vectors, bounds
the inner product of an anchor's half with every half of that centroid, so the two bounds
of a cell add up to bounds of its scores. An anchor's traversal takes cells from a heap in
the order of their upper bounds. After the first cells its k-th best score so far is a
floor: the traversal goes on through every cell whose upper bound reaches the floor and
stops there, as no other cell can change the result. This is done once for the positives
(same label) and once for the windows of scores below them (other labels), where cells
that lie wholly above a window are passed over too.

Cells are stored in blocks of bounded size, anchors in blocks of their own; Spark joins
blocks that must meet, a meeting returns at most k rows for each anchor and window.

Rows with a null id, label or vector, an empty vector, or components that are null or not
finite take no part. A vector that is shorter than others counts as followed by zeros.
Rows that share an id are rows of their own, also as anchors. Fewer rows than asked for:
all. Scores are exact integers; one beyond 64 bits is an error. Extra columns are not read,
an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table
from .embedding_dedup import kmeans, nearest_cells

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
#: The codebooks are fitted on so many vectors, and so many bytes of them, at most.
FIT_SAMPLE, FIT_BYTES = 16_384, 64 << 20
#: Centroids of a half: sqrt(vectors / CELL), at most MAX_CENTROIDS; the driver and the tasks know the number of rows of each cell.
CELL, MAX_CENTROIDS = 256, 512
#: Rows and anchors of a block, at most (about, for rows).
ROWS, ANCHORS = 512, 256
#: Rows that an anchor's first cells hold at least.
FIRST = 2_048


def usable(vectors: DataFrame, anchor: Column, scale: int = SCALE) -> DataFrame:
    """row (a number of its own), vec_id, label, anchor, v (packed floor(scale * x)) of the rows (vec_id, embedding, label) that take part."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            with np.errstate(over="ignore"):
                v = [np.floor(scale * np.asarray(x, np.float64)) for x in b["embedding"]]  # null components become NaN
            ok = np.array([bool(len(x)) and bool(np.isfinite(x).all()) for x in v], bool)
            yield pd.DataFrame({"vec_id": b["vec_id"], "label": b["label"], "anchor": b["anchor"], "v": [x.tobytes() for x in v]})[ok]

    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    found = given.where("vec_id is not null and label is not null and embedding is not null").mapInPandas(each, "vec_id long, label long, anchor boolean, v binary")
    return found.withColumn("row", F.monotonically_increasing_id())


def _matrix(packed: pd.Series | list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(packed), width))
    for i, x in enumerate(packed):
        out[i, : len(x) // 8] = np.frombuffer(x, np.float64)
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors, exactly."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    out = whole(a).dot(whole(b).T)
    if max(abs(int(x)) for x in out.ravel()) >= 1 << 63:
        raise OverflowError("an inner product passes 64 bits")
    return out.astype(np.int64)


class BoundedIndex:
    """Codebooks of both halves, the radius and the largest length of each centroid's halves, and the rows of each cell."""

    def __init__(self, sample: np.ndarray, k: int):
        self.width, self.cut = sample.shape[1], sample.shape[1] // 2
        self.codes = [kmeans(sample[:, : self.cut], k) if self.cut else np.zeros((1, 0)), kmeans(sample[:, self.cut :], k)]
        self.reach: list[np.ndarray] = []
        self.longest: list[np.ndarray] = []
        self.counts = np.zeros(len(self.codes[0]) * len(self.codes[1]), np.int64)

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.cut], x[:, self.cut :]

    def near(self, half: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row, and its distance."""
        d = (half * half).sum(axis=1)[:, None] - 2 * half @ codes.T + (codes * codes).sum(axis=1)[None, :]
        at = d.argmin(axis=1)
        return at, np.linalg.norm(half - codes[at], axis=1)

    def measure(self, rows: DataFrame) -> DataFrame:
        """Gives rows (row, vec_id, label, anchor, v) their cell, and learns radii, lengths and counts from all of them."""
        placed = materialize(rows.mapInPandas(self._place, "row long, vec_id long, label long, anchor boolean, v binary, cell int, r0 double, r1 double, n0 double, n1 double"), "placed")
        for h, code in enumerate((F.floor(F.col("cell") / len(self.codes[1])), F.col("cell") % len(self.codes[1]))):
            known = placed.groupBy(code.cast("int").alias("code")).agg(F.max(f"r{h}").alias("r"), F.max(f"n{h}").alias("n")).collect()  # a row for each centroid
            reach, longest = np.zeros(len(self.codes[h])), np.zeros(len(self.codes[h]))
            for x in known:
                reach[x["code"]], longest[x["code"]] = x["r"], x["n"]
            self.reach.append(reach)
            self.longest.append(longest)
        for x in placed.groupBy("cell").count().toLocalIterator():  # MAX_CENTROIDS squared at most
            self.counts[x["cell"]] = x["count"]
        return placed.drop("r0", "r1", "n0", "n1")

    def _place(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                one, two = self.halves(_matrix(b["v"], self.width))
                (i, r0), (j, r1) = self.near(one, self.codes[0]), self.near(two, self.codes[1])
                b = b[["row", "vec_id", "label", "anchor", "v"]]
                yield b.assign(cell=(i * len(self.codes[1]) + j).astype(np.int32), r0=r0, r1=r1, n0=np.linalg.norm(one, axis=1), n1=np.linalg.norm(two, axis=1))

    def bounds(self, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half: lower and upper bounds of the scores of the anchors q with each centroid's rows."""
        out = []
        for h, half in enumerate(self.halves(q)):
            size = np.linalg.norm(half, axis=1)[:, None]
            middle, slack = half @ self.codes[h].T, size * self.reach[h][None, :]
            limit = size * self.longest[h][None, :]
            rounding = 1e-9 * (size * (self.longest[h] + self.reach[h])[None, :]) + 1e-6
            out.append((np.maximum(middle - slack, -limit) - rounding, np.minimum(middle + slack, limit) + rounding))
        return out

    def first_cells(self, upper: tuple[np.ndarray, np.ndarray], rows: int) -> np.ndarray:
        """Cells of one anchor from the heap, best upper bound first, until they hold so many rows; empty ones left out."""
        visits = 16
        while True:
            cells = np.array(nearest_cells(-upper[0], -upper[1], visits))
            held = self.counts[cells].cumsum()
            if held[-1] >= rows or visits >= len(self.counts):
                return cells[: int(np.searchsorted(held, rows)) + 1][self.counts[cells[: int(np.searchsorted(held, rows)) + 1]] > 0]
            visits *= 4


def fit(rows: DataFrame, n: int, width: int, k: int | None = None) -> BoundedIndex:
    """Codebooks from a bounded sample of the n rows."""
    k = k or min(MAX_CENTROIDS, max(2, round(math.sqrt(n / CELL))))
    most = max(k, min(FIT_SAMPLE, FIT_BYTES // (8 * width)))
    return BoundedIndex(_matrix(rows.orderBy(F.xxhash64("row"), "row").limit(most).select("v").toPandas()["v"], width), k)


def _blocks(placed: DataFrame, counts: np.ndarray) -> DataFrame:
    """cell, block, ids, labels, own (row numbers), vs (packed together with sizes): all rows of a cell in blocks."""
    parts = np.maximum(1, -(-counts // ROWS))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            mine = (b["row"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            yield b.assign(block=(mine % parts[b["cell"].to_numpy()].astype(np.uint64)).astype(np.int32))

    def pack(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("row")
        return pd.DataFrame({"cell": b["cell"].iloc[:1], "block": b["block"].iloc[:1], "ids": [b["vec_id"].tolist()], "labels": [b["label"].tolist()], "own": [b["row"].tolist()], "vs": [b["v"].tolist()]})

    dealt = placed.select("row", "vec_id", "label", "v", "cell").mapInPandas(deal, "row long, vec_id long, label long, v binary, cell int, block int")
    return dealt.groupBy("cell", "block").applyInPandas(pack, "cell int, block int, ids array<long>, labels array<long>, own array<long>, vs array<binary>")


def _anchor_blocks(placed: DataFrame) -> DataFrame:
    """ab (a block of anchors of neighbouring cells), at (place in it), and the anchor's columns."""
    anchors = placed.where("anchor").drop("anchor")
    n = max(1, -(-anchors.count() // ANCHORS))

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = 0
        for b in batches:
            i = at + np.arange(len(b))
            at += len(b)
            yield b.drop(columns="part").assign(ab=b["part"] * (1 << 32) + i // ANCHORS, at=(i % ANCHORS).astype(np.int32))

    dealt = anchors.repartitionByRange(n, "cell", "row").withColumn("part", F.spark_partition_id().cast("long"))
    return dealt.mapInPandas(number, "row long, vec_id long, label long, v binary, cell int, ab long, at int")


def best_of(s: np.ndarray, ok: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the first k allowed columns of each row: higher scores first, then smaller ids."""
    low = np.iinfo(np.int64).min
    held = np.where(ok, s, low)
    if s.shape[1] > k:
        ok = ok & (held >= np.partition(held, s.shape[1] - k, axis=1)[:, s.shape[1] - k][:, None])
    r, c = np.nonzero(ok)
    order = np.lexsort((ids[c], -s[r, c], r))
    r, c = r[order], c[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    return r[rank < k], c[rank < k]


#: What a search knows of each anchor: windows of scores (low, high) and, after the first cells, the floor of each.
STATE = "ab long, at int, row long, vec_id long, label long, v binary, lows array<long>, highs array<long>, floors array<long>"


def _search(index: BoundedIndex, blocks: DataFrame, state: DataFrame, same: bool, k: int) -> DataFrame:
    """row (of the anchor), w (number of its window), id, score: the first k rows of each window, of the same or of other labels."""

    def wanted(first: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def each(b: pd.DataFrame) -> pd.DataFrame:
            (low0, up0), (low1, up1) = index.bounds(_matrix(b["v"], index.width))
            meet = np.zeros((len(b), len(index.counts)), bool)
            for i, (lows, highs, floors) in enumerate(zip(b["lows"], b["highs"], b["floors"])):
                if not len(lows):
                    continue
                begun = index.first_cells((up0[i], up1[i]), FIRST)
                if first:
                    meet[i, begun] = True
                    continue
                upper, lower = (up0[i][:, None] + up1[i][None, :]).ravel(), (low0[i][:, None] + low1[i][None, :]).ravel()
                for lo, hi, floor in zip(lows, highs, floors):
                    meet[i] |= (upper >= max(lo, floor)) & (lower <= hi)
                meet[i, begun] = False
            cells = np.flatnonzero(meet.any(axis=0) & (index.counts > 0))
            parts = np.maximum(1, -(-index.counts[cells] // ROWS))
            who = [np.packbits(meet[:, c], bitorder="little").tobytes() for c in cells]
            return pd.DataFrame({
                "ab": np.full(parts.sum(), b["ab"].iloc[0]), "cell": np.repeat(cells, parts).astype(np.int32),
                "block": np.concatenate([np.arange(p) for p in parts] or [np.zeros(0)]).astype(np.int32), "who": [w for w, p in zip(who, parts) for _ in range(p)],
            })

        return lambda b: each(b.sort_values("at"))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x in b.itertuples():
                on = np.flatnonzero(np.unpackbits(np.frombuffer(x.who, np.uint8), bitorder="little")[: len(x.a_row)])
                a_row, a_label = np.asarray(x.a_row)[on], np.asarray(x.a_label)[on]
                s = scores(_matrix([x.a_v[i] for i in on], index.width), _matrix(x.vs, index.width))
                ids, label, own = np.asarray(x.ids), np.asarray(x.labels), np.asarray(x.own)
                ok = (a_label[:, None] == label[None, :]) == same
                ok &= a_row[:, None] != own[None, :]
                lows, highs = [x.a_lows[i] for i in on], [x.a_highs[i] for i in on]
                for w in range(max(map(len, lows), default=0)):
                    lo = np.array([v[w] if w < len(v) else 1 for v in lows])
                    hi = np.array([v[w] if w < len(v) else 0 for v in highs])
                    r, c = best_of(s, ok & (s >= lo[:, None]) & (s <= hi[:, None]), ids, k)
                    yield pd.DataFrame({"row": a_row[r], "w": np.full(len(r), w, np.int32), "id": ids[c], "score": s[r, c]})

    def pack(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("at")
        return pd.DataFrame({"a_ab": b["ab"].iloc[:1], "a_row": [b["row"].tolist()], "a_label": [b["label"].tolist()], "a_v": [b["v"].tolist()], "a_lows": [b["lows"].tolist()], "a_highs": [b["highs"].tolist()]})

    packed = materialize(state.groupBy("ab").applyInPandas(pack, "a_ab long, a_row array<long>, a_label array<long>, a_v array<binary>, a_lows array<array<long>>, a_highs array<array<long>>"), "anchors")
    order = Window.partitionBy("row", "w").orderBy(F.col("score").desc(), "id")

    def visit(state: DataFrame, first: bool) -> DataFrame:
        pairs = state.groupBy("ab").applyInPandas(wanted(first), "ab long, cell int, block int, who binary")
        met = pairs.join(packed, F.col("ab") == F.col("a_ab")).join(blocks.withColumnRenamed("cell", "b_cell").withColumnRenamed("block", "b_block"), (F.col("cell") == F.col("b_cell")) & (F.col("block") == F.col("b_block")))
        found = met.mapInPandas(meet, "row long, w int, id long, score long")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    begun = materialize(visit(state, True), "first")
    # The k-th score of a window, where k were found, is its floor; the others have none.
    floor = begun.where(F.col("rank") == k).groupBy(F.col("row").alias("f_row")).agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("known"))
    none = F.lit(np.iinfo(np.int64).min)
    met = state.join(floor, F.col("row") == F.col("f_row"), "left")
    floors = F.transform("lows", lambda x, w: F.coalesce(F.try_element_at(F.coalesce("known", F.create_map().cast("map<int,long>")), w), none))
    later = met.withColumn("floors", floors).select(state.columns)
    rest = visit(materialize(later, "floors"), False)
    both = begun.drop("rank").unionByName(rest.drop("rank"))
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, k: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of vectors (vec_id, embedding, label) for which anchor holds.

    A negative's score, times 100, is at least low and at most high times the positive's.
    """
    rows = materialize(usable(vectors, anchor), "usable")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.length("v")), F.lit(8)).alias("bytes")).first()
    if not size["n"]:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    index = fit(rows, size["n"], size["bytes"] // 8, k)
    placed = index.measure(rows)
    blocks = materialize(_blocks(placed, index.counts), "blocks")
    anchors = materialize(_anchor_blocks(placed).drop("cell"), "anchors")

    most = np.iinfo(np.int64)
    everything = lambda x: F.array(F.lit(int(x)))
    state = anchors.select("*", everything(most.min).alias("lows"), everything(most.max).alias("highs"), everything(most.min).alias("floors"))
    near = materialize(_search(index, blocks, state, True, positives), "positives")

    # 100 * score between low * p and high * p, as bounds of the score.
    near = near.withColumn("lo", F.expr(f"cast(ceil(cast({low} as decimal(4,0)) * cast(score as decimal(19,0)) / 100) as long)")).withColumn("hi", F.expr(f"cast(floor(cast({high} as decimal(4,0)) * cast(score as decimal(19,0)) / 100) as long)"))
    listed = near.groupBy(F.col("row").alias("p_row")).agg(F.sort_array(F.collect_list(F.struct("rank", "lo", "hi"))).alias("x"))
    windows = anchors.join(listed, F.col("row") == F.col("p_row")).select(anchors.columns + [F.col("x.lo").alias("lows"), F.col("x.hi").alias("highs"), F.transform("x", lambda x: F.lit(int(most.min))).alias("floors")])
    far = _search(index, blocks, materialize(windows, "windows"), False, negatives)

    names = anchors.select(F.col("row").alias("a_row"), F.col("vec_id").alias("anchor_id"))
    pairs = near.select("row", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(names, F.col("row") == F.col("a_row"))
    out = pairs.join(far.select("row", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["row", "w"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


#: Brute force: all anchors against all rows. Vectors of these tables are usable, their ids distinct.
ORACLE_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
),
s AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
    SELECT p.*, id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
