"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint has the bits that are set in over half of the XXH64 hashes of
its word shingles. Fingerprints within a radius r of each other are found with
2^(r+1) - 1 bit masks: give every bit position a non-zero vector of r + 1 bits; mask v
keeps the positions whose vector has an odd product with v. The vectors of r or fewer
differing positions span less than the whole space, so some v is orthogonal to them all:
under that mask the two fingerprints agree. Every pair within the radius therefore meets
in at least one table, without exception.

Equal fingerprints are one node, so copies never make pairs. A table's bucket of up to
``bucket_pairs`` fingerprints is compared in pairs. In a larger bucket (a dense cluster)
each fingerprint is listed under itself and its neighbours at distance 1 below the mask:
two fingerprints differ in at most 2 bits if and only if they share such a midpoint, at
most 65 fingerprints share one, and each is joined to the smallest of them. That keeps
every link between connected texts, in linear space. It needs a radius of 2 or less;
a larger one is refused.

Null and empty texts have fingerprint zero and link like any other. Null ids get the component
of their fingerprint, if that has an id. Repeated rows are returned as often as given. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import Scratch, connected_components, join_on_copy, lean, materialize, read_table, shingle_hashes

BITS = 64
BLOCK = 1 << 14


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of one text, as a signed 64-bit number."""
    grams = _grams((text or "").encode("utf-8", "surrogatepass").lower().split(), shingle)
    return _bits(grams, 42) if grams else 0


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (long) for each row of docs (doc_id, text)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": [fingerprint(t, shingle) for t in b["text"]]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(each, f"doc_id {kind}, fp long")


def covering_masks(radius: int) -> list[int]:
    """The 2^(radius+1) - 1 masks, as signed 64-bit numbers."""
    width = radius + 1
    vectors = [i % ((1 << width) - 1) + 1 for i in range(BITS)]
    masks = []
    for v in range(1, 1 << width):
        m = sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2)
        masks.append(m - (1 << BITS) if m >= 1 << (BITS - 1) else m)
    return masks


def _signed(bit: int) -> int:
    return (1 << bit) - (1 << BITS if bit == BITS - 1 else 0)


def links(nodes: DataFrame, radius: int = 2, bucket_pairs: int = 64) -> DataFrame:
    """a, b: links between nodes that connect all within the radius of each other.

    nodes: seed, fp, node; each fingerprint of a seed once. Only fingerprints of one seed are compared.
    """
    if not 0 <= radius <= 2:
        raise ValueError("the radius must be 0, 1 or 2: crowded buckets need midpoints")
    masks = covering_masks(radius)
    table = F.array(*(F.struct(F.lit(i).alias("v"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)))
    keys = materialize(nodes.select("seed", "fp", "node", F.explode(table).alias("x")).select("seed", "x.v", "x.key", "fp", "node"), "tables")
    bucket = ["seed", "v", "key"]
    crowded = materialize(keys.groupBy(*bucket).agg(F.count("*").alias("n")).where(F.col("n") > bucket_pairs).select(*bucket), "crowded")
    sparse = keys.join(crowded, bucket, "left_anti")
    left, right = (sparse.select(*bucket, F.col("fp").alias(f"fp_{s}"), F.col("node").alias(f"node_{s}")) for s in "ab")
    differ = F.col("fp_a").bitwiseXOR(F.col("fp_b"))
    first = F.lit(True)
    for i, m in enumerate(masks[:-1]):  # a pair counts in the first table where it meets
        first = first & ~((F.lit(i) < F.col("v")) & (differ.bitwiseAND(F.lit(m)) == 0))
    pairs = left.join(right, bucket).where((F.col("fp_a") < F.col("fp_b")) & (F.bit_count(differ) <= radius) & first)

    flips = [F.lit(0).cast("long"), *(F.lit(_signed(i)) for i in range(BITS))]
    kept = F.element_at(F.array(*(F.lit(m) for m in masks)), F.col("v") + 1)
    middle = F.filter(F.array(*flips), lambda f: f.bitwiseAND(kept) == 0)
    dense = keys.join(crowded, bucket, "left_semi").select("seed", "node", "fp", F.explode(middle).alias("flip"))
    # The same midpoint may come from several tables; one listing is enough.
    listed = dense.select("node", F.xxhash64("seed").bitwiseXOR(F.col("fp")).bitwiseXOR(F.col("flip")).alias("mid"), "seed").distinct()
    listed = materialize(listed, "midpoints")
    least = listed.groupBy("seed", "mid").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").select(F.col("seed").alias("l_seed"), F.col("mid").alias("m"), "least")
    stars = join_on_copy(listed, least, "mid", "m", "inner").where("seed = l_seed and node <> least").select("node", "least").distinct()
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).unionByName(stars.toDF("a", "b"))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, bucket_pairs: int = 64) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id reachable) for each row of docs."""
    fps = materialize(fingerprints(docs, shingle), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    known = nodes.where("node is not null")
    comp = connected_components(links(known.withColumn("seed", F.lit(0)), radius, bucket_pairs))
    joined = nodes.join(comp.withColumnRenamed("node", "c_node"), F.col("node") == F.col("c_node"), "left")
    of_fp = materialize(joined.select(F.col("fp").alias("c_fp"), F.coalesce("component", "node").alias("component_id")), "components")
    return fps.join(of_fp, F.col("fp") == F.col("c_fp"), "left").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def _grams(ws: list[bytes], shingle: int) -> list[bytes]:
    if len(ws) < shingle:
        return [b" ".join(ws)] if ws else []
    return list(map(b" ".join, zip(*(ws[i:] for i in range(shingle)))))


def _bits(grams: list[bytes], seed: int) -> int:
    h = np.fromiter((xxh64_intdigest(g, seed) for g in grams), "<u8", len(grams))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), BLOCK):
        ones += np.unpackbits(h[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


#: Shingles that the order of the prefixes puts last, at most, and hashes that a task counts at once. They only save work: any order is exact.
FREQUENT, COUNT_BLOCK = 262_144, 1 << 19
#: Different texts of one count block that make a shingle frequent there.
OFTEN = 2
#: Open pairs of a prefix shingle beyond which its members are first compared with hubs, and rounds of that. All open pairs left are compared then.
OPEN_PAIRS, HUB_ROUNDS = 2016, 4
#: Members of a prefix shingle that are compared with as many others in one place, about.
MEET_BLOCK = 512


def _shingles(text: str | None, shingle: int) -> tuple[list[bytes], np.ndarray]:
    """Words, and the sorted distinct hashes of the shingles."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return ws, np.unique(shingle_hashes(ws, shingle))


def _set_key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def prefix_size(n: int, similarity: float) -> int:
    """Shingles of a set of n, the first in any common order, among which a similar set has at least one."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def frequent_shingles(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the shingles that most often several texts of a block have, over the blocks of all documents.

    Equal texts of a block count once.
    """

    def counted(hashes: list[np.ndarray]) -> pd.DataFrame:
        h, n = np.unique(np.concatenate(hashes), return_counts=True)
        return pd.DataFrame({"h": h[n >= OFTEN].view(np.int64), "n": n[n >= OFTEN]})

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes: dict[bytes, np.ndarray] = {}
        held = 0
        for b in batches:
            for t in b["text"]:
                h = _shingles(t, shingle)[1]
                key = _set_key(h)
                if key not in hashes:
                    hashes[key] = h
                    held += len(h)
                if held >= COUNT_BLOCK:
                    yield counted(list(hashes.values()))
                    hashes, held = {}, 0
        if hashes:
            yield counted(list(hashes.values()))

    sums = rows.select("text").mapInPandas(lean(each), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = sums.orderBy(F.desc("n"), "h").limit(FREQUENT).toPandas()
    h, n = top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    turn = np.argsort(h)
    return h[turn], n[turn]


def _rare_first(hashes: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if not len(known) or not len(hashes):
        return hashes
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    n = np.where(known[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, n))]


def parity(hashes: np.ndarray) -> bytes:
    """Bits that an odd number of the hashes fall on, at least as many as there are hashes.

    Two sets' parities differ in at most as many bits as the sets differ in members.
    """
    width = 1 << max(6, (max(len(hashes), 1) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def parity_distance(x: bytes, y: bytes) -> int:
    """Bits in which two parities differ; the wider one is folded to the other's width."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    folded = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return int(np.bitwise_count(a ^ folded).sum())


def _open_share(similarity: float) -> float:
    """Members in one of two similar sets alone, at most, as a share of both sizes' sum."""
    return (1 - similarity) / (1 + similarity)


def near_in_group(rows: pd.DataFrame, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the pairs of one shingle's members that sizes, places and parities let be similar.

    rows: node, size, pos, component, parity, i, j, block; members of one component aren't compared, nor those of one block if i and j differ.
    """
    node, size, component, block = (rows[c].to_numpy() for c in ("node", "size", "component", "block"))
    rest = size - rows["pos"].to_numpy()
    bits = [np.frombuffer(x, np.uint8) for x in rows["parity"]]
    widths = np.array([len(x) for x in bits])
    across = rows["i"].iloc[0] != rows["j"].iloc[0]
    a, b = [], []
    for w in np.unique(widths):
        others = np.flatnonzero(widths >= w)
        folded = np.stack([np.bitwise_xor.reduce(bits[k].reshape(-1, w), axis=0) for k in others])
        for k in np.flatnonzero(widths == w):
            both = size[others] + size[k]
            ok = ((widths[others] > w) | (others > k)) & (component[others] != component[k])
            ok &= np.minimum(rest[others], rest[k]) >= both * (similarity / (1 + similarity)) - 1e-6
            if across:
                ok &= block[others] != block[k]
            ok = np.flatnonzero(ok)
            if len(ok):
                far = np.bitwise_count(folded[ok] ^ bits[k]).sum(axis=1, dtype=np.int64)
                met = others[ok[far <= _open_share(similarity) * both[ok] + 1e-6]]
                a.append(np.minimum(node[met], node[k]))
                b.append(np.maximum(node[met], node[k]))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


class _Verifier:
    """Pairs of classes whose shingle sets are similar.

    The sets' parities leave out nearly all others first; only texts of pairs that are left have their
    shingles listed, once each.
    """

    def __init__(self, rows: DataFrame, classes: DataFrame, scratch: Scratch, similarity: float, shingle: int):
        self.rows, self.scratch, self.similarity, self.shingle = rows, scratch, similarity, shingle
        self.signs = classes.select("node", "size", "parity")
        self.listed: DataFrame | None = None

    def similar(self, candidates: DataFrame) -> DataFrame:
        """The pairs a, b (each once, a < b) of candidates that are similar."""
        return self.verified(self.near(candidates))

    def near(self, candidates: DataFrame) -> DataFrame:
        """The pairs a, b (each once, a < b) of candidates that their parities let be similar."""
        share = _open_share(self.similarity)

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                ok = [parity_distance(x, y) <= share * n + 1e-6 for x, y, n in zip(b["a_parity"], b["b_parity"], b["n"])]
                yield b[["a", "b"]][np.array(ok, bool)]

        pairs = candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        met = pairs.join(self.signs.toDF("a_id", "a_size", "a_parity"), F.col("a") == F.col("a_id")).join(self.signs.toDF("b_id", "b_size", "b_parity"), F.col("b") == F.col("b_id"))
        return met.select("a", "b", (F.col("a_size") + F.col("b_size")).alias("n"), "a_parity", "b_parity").mapInPandas(lean(near), "a long, b long")

    def near_members(self, members: DataFrame) -> DataFrame:
        """The pairs a, b (each once, a < b) of members that meet in a shingle and may be similar, compared where the shingle's members lie.

        members: h, node, size, pos, component, members (of the shingle). Pairs are no rows until their parities are near. The members of a large
        shingle are dealt into blocks, and each two blocks meet in a place of their own.
        """
        similarity = self.similarity

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def met(groups: list[pd.DataFrame]) -> pd.DataFrame:
                found = [near_in_group(g, similarity) for g in groups]
                return pd.DataFrame({"a": np.concatenate([x for x, _ in found]), "b": np.concatenate([x for _, x in found])}).drop_duplicates()

            left = None
            for rows in batches:
                if not len(rows):
                    continue
                rows = rows if left is None else pd.concat([left, rows], ignore_index=True)
                keys = rows[["h", "i", "j"]].to_numpy()
                starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
                left = rows.iloc[starts[-1] :]  # may go on in the next batch
                if len(starts) > 1:
                    yield met([rows.iloc[x:y] for x, y in zip(starts[:-1], starts[1:])])
            if left is not None:
                yield met([left])

        n = F.ceil(F.col("members") / MEET_BLOCK).cast("int")
        meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least("block", x).alias("i"), F.greatest("block", x).alias("j")))
        dealt = members.withColumn("blocks", n).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        signs = self.signs.toDF("s_node", "s_size", "parity")
        dealt = dealt.join(signs, (F.col("node") == F.col("s_node")) & (F.col("size") == F.col("s_size"))).select("h", "node", "size", "pos", "component", "parity", "block", F.explode(meets).alias("x"))
        placed = dealt.select("h", "x.i", "x.j", "node", "size", "pos", "component", "parity", "block").repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")
        return placed.mapInPandas(lean(near), "a long, b long").distinct()

    def verified(self, near: DataFrame) -> DataFrame:
        """The pairs of near (a, b) whose shingle sets are similar."""
        similarity = self.similarity

        def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                ok = []
                for x, y in zip(b["a_grams"], b["b_grams"]):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(shared >= similarity * (len(x) + len(y) - shared) - 1e-9)
                yield b[["a", "b"]][np.array(ok, bool)]

        pairs = self.scratch.table(near, "candidates")
        grams = self._shingles_of(pairs)
        both = pairs.join(grams.toDF("a_id", "a_grams"), F.col("a") == F.col("a_id")).join(grams.toDF("b_id", "b_grams"), F.col("b") == F.col("b_id"))
        return self.scratch.table(both.select("a", "b", "a_grams", "b_grams").mapInPandas(lean(verified), "a long, b long").distinct(), "similar")

    def _shingles_of(self, pairs: DataFrame) -> DataFrame:
        """doc_id, grams of at least all documents of the pairs."""
        shingle = self.shingle

        def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"doc_id": b["doc_id"], "grams": [_shingles(t, shingle)[1].tobytes() for t in b["text"]]})

        ids = pairs.select(F.explode(F.array("a", "b")).alias("m_id")).distinct()
        if self.listed is not None:
            ids = ids.join(self.listed.select(F.col("doc_id").alias("have")), F.col("m_id") == F.col("have"), "left_anti")
        ids = self.scratch.table(ids, "ids")
        texts = self.rows.join(ids, F.col("doc_id") == F.col("m_id"), "left_semi").mapInPandas(lean(listed), "doc_id long, grams binary")
        new = self.scratch.table(texts, "shingles")
        self.listed = new if self.listed is None else self.listed.unionByName(new)
        return self.listed


def _sketches(rows: DataFrame, similarity: float, shingle: int, seeds: int) -> DataFrame:
    """doc_id, key (of the shingle set), fps (SimHashes of the distinct words), size, prefix (rarest shingles) and parity of each row."""
    order = rows.sparkSession.sparkContext.broadcast(frequent_shingles(rows, shingle))

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, counts = order.value
        for b in batches:
            out = []
            for t in b["text"]:
                ws, hashes = _shingles(t, shingle)
                distinct = list(set(ws))
                first = _rare_first(hashes, known, counts)[: prefix_size(len(hashes), similarity)].view(np.int64)
                out.append((_set_key(hashes), [_bits(distinct, 42 + i) for i in range(seeds)], len(hashes), first, parity(hashes)))
            keys, fps, sizes, firsts, parities = zip(*out) if out else ([],) * 5
            yield pd.DataFrame({"doc_id": b["doc_id"], "key": keys, "fps": fps, "size": np.array(sizes, np.int32), "prefix": firsts, "parity": parities})

    return rows.mapInPandas(lean(sketch), "doc_id long, key binary, fps array<long>, size int, prefix array<long>, parity binary")


def similar_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, seeds: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, component_id: rows of docs (doc_id, text) whose group has a smaller id than their own.

    Groups are connected by equal sets of ``shingle``-word shingles (A-Z lower-cased) and by pairs whose sets have a Jaccard similarity of at least ``similarity``. The links of
    ``seeds`` independent SimHash fingerprints of the texts' distinct words join most of them. All
    others meet in a prefix: of two similar sets in a common order, the first n - ceil(similarity * n) + 1
    shingles of each share one. Of shingles that the same sets share, the first stands for all. Where many meet, hubs (a new one each round) connect what they can in
    linear space; then every pair that meets and isn't connected yet is verified: as rows where no more pairs than members are open, else where the members lie.
    Rows that share an id are one document with several texts.
    """
    with Scratch(docs.sparkSession) as scratch:
        rows = docs.where("doc_id is not null").select("doc_id", "text")
        sketches = scratch.table(_sketches(rows, similarity, shingle, seeds), "sketches")
        classes = scratch.table(sketches.groupBy("key").agg(F.min("doc_id").alias("node"), *(F.first(c).alias(c) for c in ("fps", "size", "prefix", "parity"))), "classes")
        verifier = _Verifier(rows, classes, scratch, similarity, shingle)

        nodes = classes.select("node", F.posexplode("fps").alias("seed", "fp"))
        firsts = scratch.table(nodes.groupBy("seed", "fp").agg(F.min("node").alias("node")), "firsts")
        renamed = firsts.select(F.col("seed").alias("f_seed"), F.col("fp").alias("f_fp"), F.col("node").alias("first"))
        same = nodes.join(renamed, (F.col("seed") == F.col("f_seed")) & (F.col("fp") == F.col("f_fp"))).where("node <> first")
        edges = verifier.similar(same.select(F.col("node").alias("a"), F.col("first").alias("b")).unionByName(links(firsts, radius)))

        listed = classes.select("node", "size", F.posexplode("prefix").alias("pos", "h"))
        # The order is common, so two sets' first common shingle is the first of all that the same sets share.
        who, again = F.xxhash64("node", "size"), F.xxhash64("size", "node")
        met = listed.groupBy("h").agg(F.count("*").alias("n"), F.bit_xor(who).alias("x"), F.bit_xor(again).alias("y"), F.min(F.struct("node", "size", "pos"))["pos"].alias("at"))
        met_twice = met.where("n > 1").groupBy("n", "x", "y").agg(F.min_by("h", F.struct("at", "h")).alias("h")).select("h")
        shared = scratch.table(listed.join(met_twice, "h", "left_semi"), "prefixes")

        def grouped(comp: DataFrame) -> DataFrame:
            joined = shared.join(comp.toDF("c_node", "component"), F.col("node") == F.col("c_node"), "left")
            return scratch.table(joined.select("h", "node", "size", "pos", F.coalesce("component", "node").alias("component")), "grouped")

        def meetings(left: DataFrame, right: DataFrame) -> DataFrame:
            """a, b of different components that may be similar, judged by sizes and places of their first common shingle."""
            a, b = (x.select("h", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "size", "pos", "component"))) for x, s in ((left, "a"), (right, "b")))
            most = F.least(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b"))
            enough = most >= (F.col("size_a") + F.col("size_b")) * F.lit(similarity / (1 + similarity)) - 1e-6
            return a.join(b, "h").where((F.col("component_a") != F.col("component_b")) & enough).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))

        rest, before = grouped(connected_components(edges)), 0
        for at in range(HUB_ROUNDS):
            parts = rest.groupBy("h", "component").agg(F.count("*").cast("double").alias("n")).groupBy("h")
            open_pairs = parts.agg(((F.pow(F.sum("n"), 2) - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs")).where(F.col("pairs") > OPEN_PAIRS)
            crowded = scratch.table(rest.join(open_pairs.select("h"), "h", "left_semi"), "crowded")
            n = crowded.count()
            if not n or (before and n > 0.9 * before):  # hubs connect no more
                break
            before = n
            row = F.struct("node", "size", "pos", "component")
            hubs = crowded.groupBy("h").agg(F.min_by(row, F.xxhash64("node", F.lit(at))).alias("x")).select("h", "x.*")
            found = verifier.similar(meetings(hubs, crowded))
            if found.isEmpty():
                break
            edges = edges.unionByName(found)
            rest = grouped(connected_components(edges))
        parts = rest.groupBy("h", "component").agg(F.count("*").alias("n")).groupBy(F.col("h").alias("m_h"))
        parts = scratch.table(parts.agg(F.sum("n").alias("members"), ((F.pow(F.sum("n"), 2) - F.sum(F.pow("n", F.lit(2)))) / 2).alias("pairs")).where("pairs > 0"), "parts")
        few = rest.join(parts.where("pairs <= members"), F.col("h") == F.col("m_h"), "left_semi")
        many = join_on_copy(rest, parts.where("pairs > members").select("m_h", "members"), "h", "m_h", "inner").drop("m_h")
        near = verifier.near(meetings(few, few).where("a < b")).unionByName(verifier.near_members(many)).distinct()
        edges = edges.unionByName(verifier.verified(near))
        comp = connected_components(edges)
        of_class = classes.join(comp.withColumnRenamed("node", "c_node"), F.col("node") == F.col("c_node"), "left")
        of_class = scratch.table(of_class.select(F.col("key").alias("c_key"), F.coalesce("component", "node").alias("component_id")), "components")
        return materialize(sketches.select("doc_id", "key").join(of_class, F.col("key") == F.col("c_key")).where("component_id < doc_id").select("doc_id", "component_id"), "later")


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """docs without the rows that a group of similar rows has a smaller id for; rows without an id stay."""
    later = similar_groups(docs, **params).select(F.col("doc_id").alias("__later")).distinct()
    return docs.join(later, docs["doc_id"] == later["__later"], "left_anti")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
