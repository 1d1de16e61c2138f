"""Substring deduplication with a log-structured index of window hashes.

A window is ``window`` consecutive words of one document. Each word covered by a window
whose word sequence also starts in a document with a smaller id is removed; windows are
judged on the input, not on what is left.

Documents of equal word sequences are one class: all but the smallest id lose every window.
The classes' first documents are taken in batches of ascending ids. Tasks hash a batch's windows, keep
for each hash the smallest document of their block (so a passage that very many documents
share arrives once for each block, not once for each document) and deal the hashes out to
buckets by range. In every bucket the batch is sorted and
merge-joined with the sorted immutable runs of earlier batches: a window is old if a run
holds its hash or a smaller document of the batch has it. The batch's new hashes, each with its document, are the
next run; once there are more than ``max_runs`` of them they are compacted into one. An index that is given a path is kept there
and can be loaded for further batches.

Matches are verified: every document that shares a hash, old or first, gives a digest of the window's words.
Where one hash has several digests, its windows are judged anew by hash and digest. Removed windows are found again in
the documents by their hash, so no positions are stored. What a bucket finds goes back packed, one row for each group of
documents; a group's task sorts it out to its documents.

Null ids neither remove nor are removed from. Null and empty texts have no words. Rows
that share an id are one document. Texts of any length are taken whole. Extra columns
are not read by ``dedup_words`` and are carried by ``drop_repeats``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest
from zstandard import ZstdCompressor, ZstdDecompressor

from .common import Scratch, join_on_copy, lean, materialize, read_table, window_mix

WINDOW = 13
#: Windows of one block in a task, and about the windows of one bucket.
BLOCK = 1 << 19
BUCKET = 800_000
MIN_BUCKETS = 48
MAX_RUNS = 4
#: Shares of the documents, by id, where batches end.
CUTS = (1 / 128, 1 / 64, 1 / 32, 1 / 16, 1 / 8)
#: Characters of a word with its space, to foresee the number of windows.
WORD_CHARS = 6
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def window_hashes(words: list[bytes], window: int, bits: int = 64) -> np.ndarray:
    """A hash of each window; fewer bits than 64 are for tests."""
    w = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    return window_mix(w, window, 1) >> np.uint64(64 - bits) << np.uint64(64 - bits)


def word_digests(words: list[bytes], starts: np.ndarray, window: int) -> np.ndarray:
    """64 bits of the BLAKE2b digest of the windows' words."""
    got = b"".join(hashlib.blake2b(b" ".join(words[i : i + window]), digest_size=8).digest() for i in starts)
    return np.frombuffer(got, np.int64)


def pack_planes(x: np.ndarray) -> bytes:
    """64-bit values byte by byte of each: high bytes are almost all zero."""
    return ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_planes(packed: bytes, kind: type = np.int64) -> np.ndarray:
    planes = np.frombuffer(ZstdDecompressor().decompress(packed), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_sorted(h: np.ndarray) -> bytes:
    """Sorted hashes as their differences."""
    return pack_planes(np.diff(h, prepend=np.uint64(0)))


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack_planes(packed, np.uint64), dtype=np.uint64)


def _group(docs: np.ndarray, groups: int) -> np.ndarray:
    """The group of documents that each id belongs to."""
    mixed = docs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int32)


class _Packed:
    """Rows of _DEALT: windows of a bucket (grp is null), or shared windows of a group of documents, old or first."""

    def __init__(self, groups: int):
        self.groups, self.rows = groups, []

    def windows(self, bucket: int, h: np.ndarray, d: np.ndarray) -> None:
        self.rows.append((bucket, None, None, pack_sorted(h), pack_planes(d)))

    def shared(self, h: np.ndarray, d: np.ndarray, old: bool, bucket: int | None = None) -> None:
        """h is sorted; without a bucket, each group's row goes to the bucket of its number."""
        if not len(h):
            return
        g = _group(d, self.groups)
        order = np.argsort(g, kind="stable")
        g, h, d = g[order], h[order], d[order]
        cuts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        for x, y, z in zip(g[cuts].tolist(), np.split(h, cuts[1:]), np.split(d, cuts[1:])):
            self.rows.append((x if bucket is None else bucket, x, old, pack_sorted(y), pack_planes(z)))

    def frame(self) -> pd.DataFrame:
        bucket, grp, old, hashes, docs = zip(*self.rows) if self.rows else ((),) * 5
        return pd.DataFrame({"bucket": np.array(bucket, np.int32), "grp": pd.array(grp, "Int32"), "old": pd.array(old, "boolean"), "hashes": hashes, "docs": docs})


def _first_seen(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, document) by hash and document, which of them start a hash, and which hashes several documents have."""
    order = np.lexsort((docs, hashes))
    h, d = hashes[order], docs[order]
    once = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])] if len(h) else np.zeros(0, bool)
    h, d = h[once], d[once]
    first = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
    last = np.r_[first[1:], True] if len(h) else first
    return h, d, first, ~(first & last)


_DEALT = "bucket int, grp int, old boolean, hashes binary, docs binary"


def _hashed(docs: DataFrame, window: int, buckets: int, bits: int) -> DataFrame:
    """Rows bucket, hashes, docs (packed; the smallest document of each hash in a block), and rows grp, old, hashes, docs of hashes that a block's documents share."""

    def flush(hs: list, ids: list) -> pd.DataFrame:
        h, d, first, shared = _first_seen(np.concatenate(hs), np.repeat(np.array(ids, np.int64), [len(x) for x in hs]))
        out = _Packed(buckets)
        out.shared(h[shared & ~first], d[shared & ~first], True)
        out.shared(h[shared & first], d[shared & first], False)
        h, d = h[first], d[first]
        b = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        for bucket, x, y in zip(b[cuts].tolist(), np.split(h, cuts[1:]), np.split(d, cuts[1:])):
            out.windows(bucket, x, y)
        return out.frame()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hs, ids, held = [], [], 0
        for b in batches:
            for i, t in zip(b["doc_id"], b["text"]):
                h = window_hashes(_encoded(t).split(), window, bits)
                if len(h):
                    hs.append(h)
                    ids.append(i)
                    held += len(h)
                if held >= BLOCK:
                    yield flush(hs, ids)
                    hs, ids, held = [], [], 0
        if held:
            yield flush(hs, ids)

    return docs.select("doc_id", "text").mapInPandas(lean(each), _DEALT)


class SubstringIndex:
    """Runs of the window hashes of all batches so far: tables bucket, hashes (sorted, as pack_sorted), docs (first document of each).

    With a path the runs are kept below it; each version of the list of runs is appended to the table ``state``.
    """

    def __init__(self, spark: SparkSession, buckets: int, window: int = WINDOW, max_runs: int = MAX_RUNS, path: str | None = None, bits: int = 64, scratch: Scratch | None = None):
        self.spark, self.buckets, self.window, self.max_runs, self.bits = spark, buckets, window, max_runs, bits
        self.path, self.version, self.names = path, 0, []
        self.table = scratch.table if scratch else materialize
        self.runs: list[DataFrame] = []

    @classmethod
    def load(cls, spark: SparkSession, path: str, max_runs: int = MAX_RUNS) -> SubstringIndex:
        """The index as it was after its last batch."""
        state = spark.read.parquet(f"{path}/state")
        rows = state.where(F.col("version") == state.agg(F.max("version")).first()[0]).orderBy("at").collect()  # at most max_runs + 1 rows
        index = cls(spark, rows[0]["buckets"], rows[0]["window"], max_runs, path, rows[0]["bits"])
        index.version, index.names = rows[0]["version"], [r["run"] for r in rows]
        index.runs = [spark.read.parquet(f"{path}/{name}") for name in index.names]
        return index

    def _keep(self, run: DataFrame, what: str) -> DataFrame:
        self.version += 1
        if self.path is None:
            return self.table(run, what)
        name = f"{what}-{self.version:08d}"
        run.write.parquet(f"{self.path}/{name}")
        self.names.append(name)
        return self.spark.read.schema(run.schema).parquet(f"{self.path}/{name}")

    def _save_state(self) -> None:
        if self.path is not None:
            rows = [(self.version, i, name, self.buckets, self.window, self.bits) for i, name in enumerate(self.names)]
            self.spark.createDataFrame(rows, "version long, at int, run string, buckets int, window int, bits int").coalesce(1).write.mode("append").parquet(f"{self.path}/state")

    def judge(self, docs: DataFrame, last: bool = False) -> DataFrame:
        """doc_id, old, hashes: hashes of a batch that several documents have, old or first; first ones of earlier batches too."""

        def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for old, hashes, docs in zip(b["old"], b["hashes"], b["docs"]):
                    d, h = unpack_planes(docs), unpack_sorted(hashes)
                    ids, at = np.unique(d, return_inverse=True)
                    yield pd.DataFrame({"doc_id": ids, "old": old, "hashes": [pack_sorted(h[at == i]) for i in range(len(ids))]})

        return self.judge_groups(docs, last).mapInPandas(split, "doc_id long, old boolean, hashes binary")

    def judge_groups(self, docs: DataFrame, last: bool = False) -> DataFrame:
        """What judge returns, as rows grp, old, hashes, docs: packed pairs of a hash and a document of the group.

        The batch's ids must all be larger than those of earlier batches. Its new hashes become a run, unless it is the last batch.
        """
        dealt = _hashed(docs, self.window, self.buckets, self.bits)
        groups = self.buckets

        def merged(rows: pd.DataFrame, runs: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
            known = rows["grp"].notna()
            out = _Packed(groups)
            out.rows += rows[known].itertuples(index=False, name=None)
            rows = rows[~known]
            if len(rows):
                bucket = int(rows["bucket"].iloc[0])
                h, d, first, shared = _first_seen(np.concatenate([unpack_sorted(x) for x in rows["hashes"]]), np.concatenate([unpack_planes(x) for x in rows["docs"]]))
                old, new = ~first, first.copy()
                for run, docs_of_run in runs:
                    if len(run):
                        at = np.minimum(np.searchsorted(run, h), len(run) - 1)
                        met = run[at] == h
                        old |= met
                        new &= ~met
                        at = np.unique(at[met])
                        out.shared(run[at], docs_of_run[at], False, bucket)
                out.shared(h[old], d[old], True, bucket)
                at = shared & first & ~old
                out.shared(h[at], d[at], False, bucket)
                if not last and new.any():
                    out.windows(bucket, h[new], d[new])
            return out.frame()

        # A bucket a task: fetched blocks lie beside the heap.
        dealt = dealt.repartition(self.buckets, "bucket")
        if self.runs:
            runs = self.runs[0]
            for r in self.runs[1:]:
                runs = runs.unionByName(r)
            runs = runs.repartition(self.buckets, "bucket")

            def join(rows: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
                return merged(rows, [(unpack_sorted(h), unpack_planes(d)) for h, d in zip(runs["hashes"], runs["docs"])])

            out = dealt.groupBy("bucket").cogroup(runs.groupBy("bucket")).applyInPandas(join, _DEALT)
        else:
            out = dealt.groupBy("bucket").applyInPandas(lambda rows: merged(rows, []), _DEALT)
        if last:
            return out.select("grp", "old", "hashes", "docs")
        # One table for both: reading its parts later costs less than a second pass over the texts.
        out = self.table(out, "judged")
        run = out.where("grp is null").select("bucket", "hashes", "docs")
        self.runs.append(run if self.path is None else self._keep(run, "run"))
        if len(self.runs) > self.max_runs:
            self.compact()
        self._save_state()
        return out.where("grp is not null").select("grp", "old", "hashes", "docs")

    def compact(self) -> None:
        """Merges all runs into one. No hash is in two runs."""
        runs = self.runs[0]
        for r in self.runs[1:]:
            runs = runs.unionByName(r)

        def one(rows: pd.DataFrame) -> pd.DataFrame:
            h = np.concatenate([unpack_sorted(x) for x in rows["hashes"]])
            order = np.argsort(h)
            d = np.concatenate([unpack_planes(x) for x in rows["docs"]])[order]
            return pd.DataFrame({"bucket": [rows["bucket"].iloc[0]], "hashes": [pack_sorted(h[order])], "docs": [pack_planes(d)]})

        self.names = []
        self.runs = [self._keep(runs.groupBy("bucket").applyInPandas(one, "bucket int, hashes binary, docs binary"), "compact")]


def by_document(found: DataFrame) -> DataFrame:
    """doc_id, old, shared (arrays of one packed list, or none) from rows grp, old, hashes, docs; a hash that is old anywhere isn't in shared."""

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        h = [unpack_sorted(x) for x in rows["hashes"]]
        d = np.concatenate([unpack_planes(x) for x in rows["docs"]])
        new = np.repeat(~rows["old"].to_numpy(bool), [len(x) for x in h])
        h = np.concatenate(h)
        order = np.lexsort((new, h, d))
        h, d, new = h[order], d[order], new[order]
        once = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]
        h, d, new = h[once], d[once], new[once]
        cuts = np.r_[np.flatnonzero(np.r_[True, d[1:] != d[:-1]]), len(d)]
        old, shared = [], []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            for lists, which in ((old, ~new[lo:hi]), (shared, new[lo:hi])):
                lists.append([pack_sorted(h[lo:hi][which])] if which.any() else [])
        return pd.DataFrame({"doc_id": d[cuts[:-1]], "old": old, "shared": shared})

    return found.groupBy("grp").applyInPandas(each, "doc_id long, old array<binary>, shared array<binary>")


def buckets_for(docs: DataFrame) -> int:
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(MIN_BUCKETS, -(-chars // (WORD_CHARS * BUCKET)))


def sequence_classes(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, first: the smallest id of the documents with the same word sequence, for those that aren't it."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "key": [hashlib.blake2b(b" ".join(_encoded(t).split()), digest_size=16).digest() for t in b["text"]]})

    keys = scratch.table(docs.select("doc_id", "text").mapInPandas(lean(each), "doc_id long, key binary"), "keys")
    firsts = keys.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select(F.col("key").alias("f_key"), "first")
    return join_on_copy(keys, firsts, "key", "f_key", "inner").where("doc_id > first").select("doc_id", "first").distinct()


def old_windows(docs: DataFrame, scratch: Scratch, window: int = WINDOW, cuts: Sequence[float] = CUTS, buckets: int | None = None, bits: int = 64) -> DataFrame:
    """doc_id, old (array of packed hashes), exact (array of hash and digest): the old windows of each document that has any.

    A window is old if its hash is in old, or its hash and digest are in exact.
    """
    spark = docs.sparkSession
    index = SubstringIndex(spark, buckets or buckets_for(docs), window, bits=bits, scratch=scratch)
    ends = sorted({int(x) for x in docs.approxQuantile("doc_id", list(cuts), 0.001)}) if cuts else []
    parts, low = [], None
    for cut in [*ends, None]:
        batch = docs
        if low is not None:
            batch = batch.where(F.col("doc_id") > low)
        if cut is not None:
            batch = batch.where(F.col("doc_id") <= cut)
        parts.append(index.judge_groups(batch, last=cut is None))
        low = cut
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    lists = scratch.table(by_document(found), "lists")

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def distinct() -> pd.DataFrame:
            h, g = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((g, h))
            h, g = h[order], g[order]
            once = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])] if len(h) else np.zeros(0, bool)
            return pd.DataFrame({"h": h[once], "g": g[once]})

        held, n = [], 0
        for b in batches:
            for z, old, shared in zip(b["z"], b["old"], b["shared"]):
                words = ZstdDecompressor().decompress(z).split()
                h = window_hashes(words, window, bits)
                at = np.flatnonzero(np.isin(h, np.concatenate([unpack_sorted(x) for x in (*old, *shared)])))
                held.append((h[at].view(np.int64), word_digests(words, at, window)))
                n += len(at)
                if n >= BLOCK // 2:
                    yield distinct()
                    held, n = [], 0
        if held:
            yield distinct()

    met = _packed(docs).join(lists.withColumnRenamed("doc_id", "__o_id"), F.col("doc_id") == F.col("__o_id")).select("doc_id", "z", "old", "shared")
    pairs = met.select("z", "old", "shared").mapInPandas(lean(digests), "h long, g long")
    several = scratch.table(pairs.groupBy("h").agg(F.min("g").alias("a"), F.max("g").alias("b")).where("a <> b").select("h"), "several")
    old = lists.where(F.size("old") > 0).select("doc_id", "old", F.array().cast("array<struct<h:long,g:long>>").alias("exact"))
    return old if several.isEmpty() else _judged_by_words(met, several, scratch, window, bits)


def _judged_by_words(met: DataFrame, several: DataFrame, scratch: Scratch, window: int, bits: int) -> DataFrame:
    """The rows of old_windows, if hashes (several) stand for more than one word sequence: these are compared with their digests."""

    def exploded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, z, old, shared in zip(b["doc_id"], b["z"], b["old"], b["shared"]):
                words = ZstdDecompressor().decompress(z).split()
                h = window_hashes(words, window, bits)
                olds = np.concatenate([unpack_sorted(x) for x in old]) if len(old) else h[:0]
                at = np.flatnonzero(np.isin(h, np.concatenate([unpack_sorted(x) for x in (*old, *shared)])))
                yield pd.DataFrame({"doc_id": i, "h": h[at].view(np.int64), "g": word_digests(words, at, window), "old": np.isin(h[at], olds)})

    rows = scratch.table(met.mapInPandas(exploded, "doc_id long, h long, g long, old boolean").distinct(), "windows")
    doubtful = rows.join(several, "h", "left_semi")
    firsts = doubtful.groupBy("h", "g").agg(F.min("doc_id").alias("first"))
    exact = doubtful.join(firsts, ["h", "g"]).where("doc_id > first").select("doc_id", F.struct("h", "g").alias("pair"), F.lit(None).cast("long").alias("sure"))
    sure = rows.where("old").join(several, "h", "left_anti").select("doc_id", F.lit(None).cast("struct<h:long,g:long>").alias("pair"), F.col("h").alias("sure"))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(old=[[pack_sorted(np.sort(np.asarray(x, np.int64).view(np.uint64)))] if len(x) else [] for x in b["sure"]])[["doc_id", "old", "exact"]]

    lists = exact.unionByName(sure).groupBy("doc_id").agg(F.collect_set("sure").alias("sure"), F.collect_set("pair").alias("exact"))
    return scratch.table(lists.mapInPandas(packed, "doc_id long, old array<binary>, exact array<struct<h:long,g:long>>"), "old")


def kept_mask(words: list[bytes], old: list[bytes] | None, exact: list | None, copy: bool, window: int, bits: int = 64) -> np.ndarray:
    """Which words stay; copy: the document has the words of one with a smaller id."""
    n = len(words)
    if n < window or not (copy or (old is not None and len(old)) or (exact is not None and len(exact))):
        return np.ones(n, bool)
    if copy:
        return np.zeros(n, bool)
    h = window_hashes(words, window, bits)
    flagged = np.isin(h, np.concatenate([unpack_sorted(x) for x in old])) if len(old) else np.zeros(len(h), bool)
    if len(exact):
        pairs = {(x["h"], x["g"]) for x in exact}
        at = np.flatnonzero(np.isin(h.view(np.int64), [x for x, _ in pairs]))
        flagged[at] |= np.array([p in pairs for p in zip(h[at].view(np.int64).tolist(), word_digests(words, at, window).tolist())], bool)
    edge = np.zeros(n + 1, np.int64)
    edge[: len(flagged)] += flagged
    edge[window : window + len(flagged)] -= flagged
    return np.cumsum(edge[:-1]) == 0


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, z: texts travel to joins compressed."""

    def packed(bs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = ZstdCompressor(level=3)
        for b in bs:
            yield pd.DataFrame({"doc_id": b["doc_id"], "z": [z.compress(_encoded(t)) for t in b["text"]]})

    return docs.select("doc_id", "text").mapInPandas(lean(packed), "doc_id long, z binary")


def _judged(docs: DataFrame, scratch: Scratch, window: int, cuts: Sequence[float], buckets: int | None, bits: int) -> DataFrame:
    """__o_id, __old, __exact, __copy for each document that loses words."""
    known = docs.where("doc_id is not null").select("doc_id", "text")
    copies = scratch.table(sequence_classes(known, scratch), "copies")
    # Of repeated ids, each row has a class of its own: such documents take part with all their windows.
    repeated = known.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("r_id"))
    copies = scratch.table(copies.join(repeated, F.col("doc_id") == F.col("r_id"), "left_anti"), "whole_copies")
    firsts = known.join(copies.select(F.col("doc_id").alias("c_id")), F.col("doc_id") == F.col("c_id"), "left_anti")
    old = old_windows(firsts, scratch, window, cuts, buckets, bits)
    parts = old.select("doc_id", "old", "exact", F.lit(False).alias("copy"))
    whole = copies.select("doc_id", F.array().cast("array<binary>").alias("old"), F.array().cast("array<struct<h:long,g:long>>").alias("exact"), F.lit(True).alias("copy"))
    return parts.unionByName(whole).toDF("__o_id", "__old", "__exact", "__copy")


def dedup_words(docs: DataFrame, window: int = WINDOW, cuts: Sequence[float] = CUTS, buckets: int | None = None, bits: int = 64) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def judged(bs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in bs:
            n, gone, sha = [], [], []
            for t, old, exact, copy in zip(b["z"], b["__old"], b["__exact"], b["__copy"]):
                words = ZstdDecompressor().decompress(t).split()
                keep = kept_mask(words, old, exact, bool(copy), window, bits)
                n.append(len(words))
                gone.append(len(words) - int(keep.sum()))
                sha.append(hashlib.sha256(b" ".join(w for w, k in zip(words, keep) if k) if gone[-1] else b" ".join(words)).hexdigest())
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_words": n, "n_removed": gone, "kept_sha256": sha})

    with Scratch(docs.sparkSession) as scratch:
        lost = _judged(docs, scratch, window, cuts, buckets, bits)
        joined = _packed(docs).join(lost, F.col("doc_id") == F.col("__o_id"), "left").drop("__o_id").withColumn("__copy", F.coalesce("__copy", F.lit(False)))
        return materialize(joined.mapInPandas(lean(judged), "doc_id long, n_words long, n_removed long, kept_sha256 string"), "kept")


def cut_words(text: str, keep: np.ndarray) -> str:
    """text without the characters from the first to the last word of each run of removed words."""
    raw = _encoded(text)
    at = [m.span() for m in _WORD.finditer(raw)]
    edge = np.flatnonzero(np.diff(np.r_[True, keep, True].astype(np.int8)))
    out, done = [], 0
    for a, b in zip(edge[::2], edge[1::2]):
        out.append(raw[done : at[a][0]])
        done = at[b - 1][1]
    return (b"".join(out) + raw[done:]).decode("utf-8", "surrogatepass")


def drop_repeats(docs: DataFrame, window: int = WINDOW, cuts: Sequence[float] = CUTS, buckets: int | None = None, bits: int = 64) -> DataFrame:
    """docs with the removed words cut out of their texts; texts without an old window, and all white space that is left, stay as they are.

    Rows of which no word is left are dropped, those that had none before aside.
    """
    columns = docs.columns

    def judged(bs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in bs:
            texts, stay = [], []
            for t, old, exact, copy in zip(b["text"], b["__old"], b["__exact"], b["__copy"]):
                words = _encoded(t).split() if old is not None else []
                keep = kept_mask(words, old, exact, bool(copy), window, bits)
                stay.append(bool(not len(keep) or keep.any()))
                texts.append(t if keep.all() else cut_words(t, keep))
            yield b.assign(text=texts)[columns][np.array(stay, bool)]

    with Scratch(docs.sparkSession) as scratch:
        lost = _judged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scratch, window, cuts, buckets, bits)
        joined = docs.join(lost, docs["doc_id"] == lost["__o_id"], "left").drop("__o_id").withColumn("__copy", F.coalesce("__copy", F.lit(False)))
        return materialize(joined.mapInPandas(lean(judged), docs.schema), "kept")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_words(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


_SPLIT = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

ORACLE_SQL = f"""
WITH docs AS (SELECT doc_id, {_SPLIT} AS ws FROM documents),
wins AS (SELECT doc_id, i, array_to_string(ws[i : i + {WINDOW - 1}], ' ') AS win FROM (SELECT *, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM docs WHERE len(ws) >= {WINDOW})),
firsts AS (SELECT win, min(doc_id) AS f FROM wins GROUP BY win HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM wins JOIN firsts USING (win) WHERE doc_id > f),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(array_to_string([ws[i] for i in range(1, len(ws) + 1) if ps IS NULL OR NOT list_contains(ps, i)], ' ')) AS kept_sha256
FROM docs LEFT JOIN lists USING (doc_id)
"""
