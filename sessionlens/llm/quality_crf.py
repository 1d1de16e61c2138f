"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its features are shares of character classes and of repeated
words in the line and in its neighbouring lines; the chain adds weights for two lines'
labels in sequence. The field is fitted by maximum likelihood on a bounded sample of
labelled documents, whose lines take the document's label. A document's score is the
mean of its lines' forward-backward marginals of "good", weighted by the lines' lengths.

Null texts, empty texts and texts of white space alone score 0. Texts of any length are read whole.
Null labels are not learned from; documents with several labels take their mean, good from 0.5 up. With one
label alone, or none, every text with words scores that label (1 without any). Repeated rows are scored each.
Extra columns are not read, or are carried by ``drop_low_quality``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, lean, read_table, small_batches

#: Labelled documents that the field is fitted on, at most.
FIT_DOCS = 1_500
#: Characters of a document that the field is fitted on, at most; longer ones are left to others of the sample.
FIT_CHARS = 200_000
ROUNDS = 120
L2 = 1e-3
THRESHOLD = 0.7

_CLASS = np.full(256, 5, np.uint8)  # 0 blank, 1 capital, 2 other letter, 3 digit, 4 sentence mark, 5 other mark
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[128:] = 2
_CLASS[48:58] = 3
_CLASS[list(b".,;:'\"-()?")] = 4
OWN = 9
SHARED = 6
FEATURES = 1 + OWN + 2 * SHARED + 2


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their lengths in bytes, and the number of lines of each text."""
    lines = [t.split(b"\n") for t in texts]
    counts = np.array([len(x) for x in lines], np.int64)
    sizes, words, distinct, repeats = [], [], [], []
    for doc in lines:
        for line in doc:
            ws = line.split()
            sizes.append(len(line))
            words.append(len(ws))
            distinct.append(len(set(ws)))
            repeats.append(sum(map(bytes.__eq__, ws, ws[1:])))
    size, n = np.array(sizes, float), np.array(words, float)
    some, any_word = np.maximum(size, 1), np.maximum(n, 1)
    joined = np.frombuffer(b"".join(x for doc in lines for x in doc) + b" ", np.uint8)
    kind = _CLASS[joined]
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1].astype(np.int64)

    def share(c: int) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(kind == c)))
        return (total[starts + size.astype(np.int64)] - total[starts]) / some

    own = np.stack([share(1), share(5), 1 - np.array(distinct) / any_word, np.array(repeats) / any_word, share(4), share(3), share(0), np.log1p(size) / 10, np.log1p(n) / 10], axis=1)
    ends = np.cumsum(counts)
    first, last = np.zeros(len(size), bool), np.zeros(len(size), bool)
    first[ends - counts], last[ends - 1] = True, True
    before, after = np.roll(own[:, :SHARED], 1, axis=0), np.roll(own[:, :SHARED], -1, axis=0)
    before[first], after[last] = 0, 0
    return np.concatenate([np.ones((len(size), 1)), own, before, after, first[:, None], last[:, None]], axis=1), size, counts


def marginals(score: np.ndarray, counts: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of each line, expected transitions summed over all, and log partition of each document.

    score: log-odds of good for each line (bad has 0); trans[y, z]: weight of label z after y.
    All documents advance together, one line at a time.
    """
    emit = np.stack([np.zeros(len(score)), score], axis=1)
    start = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    start, n = start[order], counts[order]
    longest = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(longest), side="left")  # documents with a line t
    alpha, beta = np.empty_like(emit), np.zeros_like(emit)
    for t in range(longest):
        at = start[: active[t]] + t
        if t:
            prev = alpha[at - 1]
            alpha[at] = emit[at] + np.logaddexp(prev[:, :1] + trans[0], prev[:, 1:] + trans[1])
        else:
            alpha[at] = emit[at]
    for t in range(longest - 2, -1, -1):
        at = start[: active[t + 1]] + t
        nxt = emit[at + 1] + beta[at + 1]
        beta[at] = np.logaddexp(nxt[:, :1] + trans[:, 0], nxt[:, 1:] + trans[:, 1])
    ends = np.cumsum(counts) - 1
    log_z = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
    each = np.repeat(log_z, counts)
    good = np.exp(alpha[:, 1] + beta[:, 1] - each)
    inner = np.ones(len(score), bool)
    inner[ends] = False
    i = np.flatnonzero(inner)
    joint = alpha[i][:, :, None] + trans[None] + (emit + beta)[i + 1][:, None, :] - each[i][:, None, None]
    return good, np.exp(joint).sum(axis=0), log_z


class LineField:
    def __init__(self) -> None:
        self.weights = np.zeros(FEATURES)
        self.trans = np.zeros((2, 2))
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        self.always: float | None = 1.0

    def fit(self, x: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS) -> "LineField":
        """x: features of all lines; labels: 0 or 1 of each document."""
        if len(set(labels.tolist())) < 2:
            self.always = float(labels[0]) if len(labels) else 1.0
            return self
        self.always = None
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.mean[0], self.scale[0] = 0, 1
        z = (x - self.mean) / self.scale
        y = np.repeat(labels, counts).astype(float)
        # Both labels weigh the same, whatever their numbers.
        doc_weight = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())
        # Lines of a document share its weight.
        line_weight = np.repeat(doc_weight / counts, counts)
        pairs = np.maximum(counts - 1, 0)
        target = np.zeros((2, 2))
        np.add.at(target, (labels, labels), doc_weight * pairs / counts)
        m, v = np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)
        for r in range(1, rounds + 1):
            good, _, _ = marginals(z @ self.weights, counts, self.trans)
            got = self._expected_pairs(z, counts, doc_weight)
            g = np.concatenate([z.T @ (line_weight * (good - y)) + L2 * self.weights, (got - target + L2 * self.trans).ravel()])
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = 0.15 * m / (1 - 0.9**r) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
            self.weights -= step[:FEATURES]
            self.trans -= step[FEATURES:].reshape(2, 2)
        return self

    def _expected_pairs(self, z: np.ndarray, counts: np.ndarray, doc_weight: np.ndarray) -> np.ndarray:
        out = np.zeros((2, 2))
        for label_weight in np.unique(doc_weight):
            for n in np.unique(counts[doc_weight == label_weight]):
                if n > 1:
                    docs = np.flatnonzero((doc_weight == label_weight) & (counts == n))
                    lines = (np.cumsum(counts) - counts)[docs][:, None] + np.arange(n)
                    _, pairs, _ = marginals(z[lines.ravel()] @ self.weights, np.full(len(docs), n), self.trans)
                    out += label_weight / n * pairs
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        x, size, counts = line_features(raw)
        blank = np.array([not t.strip() for t in raw], bool)
        if self.always is not None:
            return np.where(blank, 0.0, self.always)
        good, _, _ = marginals(((x - self.mean) / self.scale) @ self.weights, counts, self.trans)
        starts = np.cumsum(counts) - counts
        weight = np.maximum(size, 1e-9)
        mean = np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)
        return np.where(blank, 0.0, np.clip(mean, 0, 1))


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> LineField:
    """Learns from docs (doc_id, text) that labels (doc_id, quality) marks; at most fit_docs of them."""
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    # The sample takes equal numbers of both labels, as far as there are.
    parts = [marked.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs // 2) for y in (0, 1)]
    sample = docs.select("doc_id", "text").where(F.length("text") <= FIT_CHARS).join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id").limit(fit_docs)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x, _, counts = line_features([t.encode("utf-8", "surrogatepass") for t in b["text"]])
                cuts = np.cumsum(counts)[:-1]
                yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "x": [p.astype(np.float32).tobytes() for p in np.split(x, cuts)]})

    rows = sample.mapInPandas(each, "doc_id long, y int, x binary").toPandas().sort_values("doc_id", kind="stable")
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(-1, FEATURES).astype(float)
    counts = np.array([len(b) // (4 * FEATURES) for b in rows["x"]], np.int64)
    return LineField().fit(x, counts, rows["y"].to_numpy(int))


def _chunks(b: pd.DataFrame, chars: int = 1 << 20) -> Iterator[pd.DataFrame]:
    size = b["text"].map(lambda t: len(t or ""), na_action="ignore").fillna(0).cumsum() // chars
    for _, part in b.groupby(size.to_numpy(), sort=True):
        yield part


def score_documents(docs: DataFrame, field: LineField) -> DataFrame:
    """doc_id, score for each row of docs (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in _chunks(b):
                yield pd.DataFrame({"doc_id": part["doc_id"], "score": sent.value.score(part["text"].tolist())})

    return docs.select("doc_id", "text").mapInPandas(lean(each), f"doc_id {kind}, score double")


def drop_low_quality(docs: DataFrame, field: LineField, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score threshold or more."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in _chunks(b):
                yield part[sent.value.score(part["text"].tolist()) >= threshold]

    return docs.mapInPandas(lean(each), docs.schema)


def learning_rows(labels: DataFrame) -> DataFrame:
    return labels.where(fold(F.col("doc_id"), 4) != 2).select("doc_id", "quality")


def op5_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    field = fit(docs, learning_rows(read_table(spark, sf_dir, "labels")))
    scored = score_documents(docs, field)
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
