"""Embedding near-duplicates with an inverted multi-index.

Vectors are cut into two halves with a codebook each (k-means on a bounded sample); a
vector's cell is the pair of its nearest centroids, so k + k centroids give k * k cells. Every
vector is listed in its own cell. Every vector also visits cells in the order of its
distance to them (multi-sequence traversal); the number of cells visited is the least that
reached the target recall for queries compared with all vectors, as many queries as it
takes to see enough links (all vectors, where links are rare). Pairs that
meet in a cell are verified by their cosine in double precision.

Equal vectors are one node with a weight, so exact copies make no pairs. Crowded cells are
split into blocks of listed and of visiting vectors; a block returns for each vector its
number of links and one link to a component's root, never the pairs.

Null ids, null or empty vectors, zero vectors, and vectors with null or non-finite
components link with nothing. Vectors of different lengths don't link. Rows that share an
id are vectors of their own. Extra columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, join_on_copy, materialize, read_table

THRESHOLD = 0.9
TARGET_RECALL = 0.999
#: Vectors that the codebooks are fitted on, at most.
FIT_SAMPLE = 16_384
#: The number of visits is measured with blocks of about this many queries, up to MAX_STEP blocks at once, until MIN_LINKS links are seen.
QUERIES, MAX_STEP, MIN_LINKS = 512, 16, 3000
MIN_VISITS = 4
#: Centroids of a half: sqrt(vectors / CELL), at most MAX_CENTROIDS; counts by cell go to the driver, so this bounds them.
CELL = 64
MAX_CENTROIDS = 1024
#: Listed and visiting vectors of a block.
LISTED, VISITING = 256, 512


def packed_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, v (packed doubles; null if the row links with nothing) for each row of rows (vec_id, embedding)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = [None if x is None else np.asarray(x, dtype=np.float64) for x in b["embedding"]]  # null components become NaN
            ok = [x is not None and bool(len(x)) and bool(np.isfinite(x).all()) and bool(x.any()) for x in v]
            yield pd.DataFrame({"vec_id": b["vec_id"].astype("Int64"), "v": [x.tobytes() if k and not pd.isna(i) else None for i, x, k in zip(b["vec_id"], v, ok)]})

    return rows.select("vec_id", "embedding").mapInPandas(each, "vec_id long, v binary")


def _unit(packed: pd.Series) -> np.ndarray:
    m = np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), -1)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    k = min(k, len(x))
    centers = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = _distances(x, centers).argmin(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(axis=1)[None, :]


def nearest_cells(a: np.ndarray, b: np.ndarray, visits: int) -> list[int]:
    """Multi-sequence traversal: the cells (i * len(b) + j) with the least a[i] + b[j], nearest first."""
    ia, ib = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    sa, sb = a[ia], b[ib]
    heap, seen, out = [(sa[0] + sb[0], 0, 0)], {(0, 0)}, []
    while heap and len(out) < visits:
        _, i, j = heapq.heappop(heap)
        out.append(int(ia[i]) * len(b) + int(ib[j]))
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (sa[p] + sb[q], p, q))
    return out


class MultiIndex:
    def __init__(self, sample: np.ndarray, k: int):
        self.cut = sample.shape[1] // 2
        self.first = kmeans(sample[:, : self.cut], k) if self.cut else np.zeros((1, 0))
        self.second = kmeans(sample[:, self.cut :], k)
        self.cells = len(self.first) * len(self.second)

    def halves(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _distances(u[:, : self.cut], self.first), _distances(u[:, self.cut :], self.second)

    def cell(self, u: np.ndarray) -> np.ndarray:
        a, b = self.halves(u)
        return a.argmin(axis=1) * len(self.second) + b.argmin(axis=1)

    def rank(self, a: np.ndarray, b: np.ndarray, cell: int) -> int:
        """How many cells a traversal visits before this one."""
        d = a[cell // len(self.second)] + b[cell % len(self.second)]
        return int(np.searchsorted(np.sort(b), d - a - 1e-12).sum())


def fit(nodes: DataFrame, n: int, k: int | None = None) -> MultiIndex:
    """Codebooks from a sample of at most FIT_SAMPLE nodes."""
    k = k or min(MAX_CENTROIDS, max(2, round(math.sqrt(n / CELL))))
    rows = nodes.orderBy(F.xxhash64("node"), "node").limit(FIT_SAMPLE).select("v").toPandas()
    return MultiIndex(_unit(rows["v"]), k)


def visits_for(nodes: DataFrame, index: MultiIndex, threshold: float, target: float, links: int = MIN_LINKS) -> int:
    """Cells to visit so that queries, compared with all nodes, meet the target share of their links.

    Blocks of about QUERIES queries are taken until ``links`` links are seen, or all nodes have been queries.
    """
    blocks = max(1, -(-nodes.count() // QUERIES))
    block = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(blocks))
    seen: Counter[int] = Counter()
    at, step = 0, 1
    while at < blocks and seen.total() < links:
        packed = nodes.where((block >= at) & (block < at + step)).select("v").toPandas()["v"]
        if len(packed):
            seen.update(_link_ranks(nodes, index, _unit(packed), threshold))
        at, step = at + step, min(2 * step, MAX_STEP)
    total, have, need = seen.total(), 0, 0
    for r in sorted(seen):
        if have >= target * total:
            break
        have += seen[r]
        need = r + 1
    return min(index.cells, max(MIN_VISITS, need))


def _link_ranks(nodes: DataFrame, index: MultiIndex, q: np.ndarray, threshold: float) -> dict[int, int]:
    """Links of the queries by the number of cells visited before the linked vector's."""
    qa, qb = index.halves(q)

    def ranks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), LISTED):
                u = _unit(b["v"].iloc[lo : lo + LISTED])
                cells, cos = index.cell(u), q @ u.T
                who, which = np.nonzero((cos >= threshold) & (cos < 1 - 1e-12))
                pairs, n = np.unique(np.stack([who, cells[which]]), axis=1, return_counts=True)
                yield pd.DataFrame({"rank": np.array([index.rank(qa[i], qb[i], c) for i, c in pairs.T], np.int64), "n": n.astype(np.int64)})

    found = nodes.select("v").mapInPandas(ranks, "rank long, n long").groupBy("rank").agg(F.sum("n").alias("n")).collect()
    return {r["rank"]: r["n"] for r in found}


def _local_roots(linked: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest node of each one's component in a bipartite block (numbers of rows and columns may be the same nodes)."""
    big = np.iinfo(np.int64).max
    r, c = rows.copy(), cols.copy()
    while True:
        nr = np.minimum(r, np.where(linked, c[None, :], big).min(axis=1))
        nc = np.minimum(c, np.where(linked, nr[:, None], big).min(axis=0))
        if (nr == r).all() and (nc == c).all():
            return r, c
        r, c = nr, nc


def _linked(nodes: DataFrame, index: MultiIndex, visits: int, threshold: float) -> DataFrame:
    """node, n (weight of linked nodes met once), root: for each node and block in which it has a link."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                a, c = index.halves(_unit(b["v"]))
                yield b.assign(cell=a.argmin(axis=1) * len(index.second) + c.argmin(axis=1), visits=[nearest_cells(x, y, visits) for x, y in zip(a, c)])

    placed = materialize(nodes.mapInPandas(listed, "node long, weight long, v binary, cell long, visits array<long>"), "cells")

    def counts(df: DataFrame) -> np.ndarray:
        out = np.zeros(index.cells, np.int64)
        for r in df.groupBy("cell").count().collect():  # at most MAX_CENTROIDS squared rows
            out[r["cell"]] = r["count"]
        return out

    blocks_l = np.maximum(1, -(-counts(placed) // LISTED))
    blocks_v = np.maximum(1, -(-counts(placed.select(F.explode("visits").alias("cell"))) // VISITING))

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for node, w, v, cell, seen in zip(b["node"], b["weight"], b["v"], b["cell"], b["visits"]):
                mine = (node * 0x9E3779B97F4A7C15 >> 20) & 0xFFFFFFFF
                at = int(mine % blocks_l[cell])
                out += [(cell, at, j, True, node, w, v, cell, seen) for j in range(blocks_v[cell])]
                for c in seen:
                    j = int(mine % blocks_v[c])
                    out += [(c, i, j, False, node, w, v, cell, None) for i in range(blocks_l[c])]
            yield pd.DataFrame(out, columns=["cell", "i", "j", "is_listed", "node", "weight", "v", "home", "visits"])

    rows = placed.mapInPandas(dealt, "cell long, i int, j int, is_listed boolean, node long, weight long, v binary, home long, visits array<long>")

    def block(x: pd.DataFrame) -> pd.DataFrame:
        y, x = x[x["is_listed"]], x[~x["is_listed"]]
        if not len(x) or not len(y):
            return pd.DataFrame({"node": pd.array([], "int64"), "n": pd.array([], "int64"), "root": pd.array([], "int64")})
        xn, yn = x["node"].to_numpy(), y["node"].to_numpy()
        linked = (_unit(x["v"]) @ _unit(y["v"]).T >= threshold) & (xn[:, None] != yn[None, :])
        # A listed vector counts a visitor only if it doesn't visit that one's cell itself.
        meets = np.array([np.isin(x["home"].to_numpy(), s) for s in y["visits"]]).T
        n_x = linked @ y["weight"].to_numpy()
        n_y = x["weight"].to_numpy() @ (linked & ~meets)
        root_x, root_y = _local_roots(linked, xn, yn)
        out = pd.DataFrame({"node": np.r_[xn, yn], "n": np.r_[n_x, n_y], "root": np.r_[root_x, root_y]})
        return out[np.r_[linked.any(axis=1), linked.any(axis=0)]]

    return materialize(rows.groupBy("cell", "i", "j").applyInPandas(block, "node long, n long, root long"), "links")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL, k: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding)."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    packed = materialize(packed_vectors(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")), "vectors")
    classes = packed.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"))
    # Different vectors may share an id: nodes have numbers of their own.
    nodes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    parts = []
    for r in nodes.groupBy(F.length("v").alias("size")).count().where("count > 1").orderBy("size").collect():  # lengths that several vectors have
        same = nodes.where(F.length("v") == r["size"]).select("node", "weight", "v")
        index = fit(same, r["count"], k)
        parts.append(_linked(same, index, visits_for(same, index, threshold, target_recall), threshold))
    links = nodes.sparkSession.createDataFrame([], "node long, n long, root long")
    for p in parts:
        links = links.unionByName(p)
    degree = links.groupBy("node").agg(F.sum("n").alias("n"))
    firsts = nodes.select(F.col("node").alias("f_node"), "first")
    # Components over the smallest ids of the nodes; nodes that share one are one there.
    ends = links.where("node <> root").select("node", "root").distinct()
    a = ends.join(firsts.toDF("n1", "a"), F.col("node") == F.col("n1")).select("a", "root")
    comp = connected_components(a.join(firsts.toDF("n2", "b"), F.col("root") == F.col("n2")).select("a", "b"))
    known = nodes.join(degree.withColumnRenamed("node", "d_node"), F.col("node") == F.col("d_node"), "left")
    known = known.join(comp.toDF("c_node", "component"), F.col("first") == F.col("c_node"), "left")
    known = materialize(known.select(F.col("v").alias("k_v"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "first").alias("component_id")), "known")
    usable = join_on_copy(packed.where("v is not null"), known, "v", "k_v", "inner").select("vec_id", "n_links", "component_id")
    alone = packed.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return usable.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


#: Brute force; the index must find the same links. Vectors of these tables are usable, their ids distinct.
BRUTE_LINKS = """
SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a, embeddings b
WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.9
"""
ORACLE_SQL = f"""
WITH RECURSIVE links AS MATERIALIZED ({BRUTE_LINKS}),
reach(vec_id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.vec_id WHERE reach.r < links.b),
comp AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id),
deg AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM comp LEFT JOIN deg USING (vec_id)
"""
