"""Language-model scores by subword lattice likelihood.

Tokens are words (A-Z lower-cased) and one end for each text. A word's spelling
probability is the sum over all its segmentations into pieces of an existing tokenizer
vocabulary: every piece (and every byte, so that no word is impossible) is an arc of the
word's lattice, and a forward recursion in log space adds up all paths. The vocabulary's scores give
the first piece probabilities; expected piece counts over all word types of the learning
texts (forward-backward, a few rounds) refine them. The vocabulary itself stays as it is.

A word's probability is c - d of its N learning tokens (absolute discounting) plus the
mass so set free times its spelling probability; an end has its own share of N. A text's score is the log10 of
the product: the marginal probability over all segmentations of the whole text.

Word counts cover all learning texts. Frequent words are looked up in the tasks (a table of
bounded size); all other words are joined with the counts. Null and empty texts have an
end alone. Without learning texts the spelling alone counts and an end costs nothing.
Rows are scored each, whatever their ids. Texts and words of any length are read whole. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, materialize, read_table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
ROUNDS = 2
#: Weight of the vocabulary's own scores against the expected counts, in pieces.
PRIOR = 1000.0
#: Words that are looked up without a join, at most twice this many.
HEAD = 100_000
BLOCK_TOKENS = 1 << 20
#: Arrow batches and rows of a block that go out at once.
OUT_ROWS = 50_000
GATHER_ROWS = 60_000
#: Bytes of one group's recursion tables, about; bits of the piece filter; factor of the substring hash.
GROUP_BYTES = 1 << 21
FILTER_BITS = 22
#: Bytes beyond which a word has a recursion of its own, and starts of arcs that it looks up at once.
LONG_WORD, LONG_BLOCK = 256, 1 << 15
HASH_FACTOR = 0x9E3779B97F4A7C15
SPACE = "▁"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def read_vocabulary(path: str = VOCABULARY, ranked: bool = True) -> dict[bytes, float]:
    """Piece (as bytes) to probability, from a sentencepiece model.

    ranked: its scores are merge ranks (0, -1, -2, ...), taken as Zipf's; else they are log probabilities.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.vocab_size()
    weights: dict[bytes, float] = dict.fromkeys((bytes([b]) for b in range(256)), 0.0)
    least = 1 / (size + 2.7) if ranked else 1e-12
    for b in weights:
        weights[b] = least
    for i in range(size):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        piece, score = model.id_to_piece(i), model.get_score(i)
        if piece.startswith(SPACE * 2):  # words hold no blanks
            continue
        w = 1 / (2.7 - score) if ranked else math.exp(score)
        weights[piece.encode()] = weights.get(piece.encode(), 0.0) + w
    total = sum(weights.values())
    return {k: v / total for k, v in weights.items()}


class PieceLattice:
    """Lattices of many words at once: words of one length go through the recursion together.

    Substrings are looked up by a 64-bit polynomial hash, after a filter that most non-pieces don't pass.
    """

    def __init__(self, probabilities: dict[bytes, float]):
        by_hash = {self._hash(p): (p, w) for p, w in probabilities.items()}
        if len(by_hash) != len(probabilities):
            raise ValueError("two pieces of the vocabulary have one hash")
        self.keys = np.array(sorted(by_hash), np.uint64)
        self.pieces = [by_hash[int(k)][0] for k in self.keys]
        self.prior = np.array([by_hash[int(k)][1] for k in self.keys])
        self.longest = max(map(len, self.pieces))
        self.space = SPACE.encode()
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[self.keys >> np.uint64(64 - FILTER_BITS)] = True
        self.set(self.prior)

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 0
        for c in piece:
            h = (h * HASH_FACTOR + c + 1) & (2**64 - 1)
        return h

    def set(self, p: np.ndarray) -> None:
        self.log = np.log(p)

    def _arcs(self, texts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces) of all arcs of equally long byte strings, by start, then end."""
        factor = np.uint64(HASH_FACTOR)
        n = texts.shape[1]
        columns = [np.ascontiguousarray(texts[:, j]).astype(np.uint64) + np.uint64(1) for j in range(n)]
        for i in range(n):
            h = np.zeros(len(texts), np.uint64)
            for j in range(i, min(n, i + self.longest)):
                h *= factor
                h += columns[j]
                rows = np.flatnonzero(self.maybe[h >> np.uint64(64 - FILTER_BITS)])
                if len(rows):
                    found = h[rows]
                    at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
                    ok = self.keys[at] == found
                    if ok.any():
                        yield i, j + 1, rows[ok], at[ok]

    def _by_length(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of the words of one length, and their bytes with the word start, at most GROUP_BYTES of them."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(lengths[lengths <= LONG_WORD]):
            every = np.flatnonzero(lengths == n)
            size = max(1, GROUP_BYTES // (int(n) + len(self.space)) ** 2)
            for k in range(0, len(every), size):
                some = every[k : k + size]
                raw = b"".join(self.space + words[w] for w in some)
                yield some, np.frombuffer(raw, np.uint8).reshape(len(some), -1)

    def _forward(self, texts: np.ndarray, keep: list | None = None) -> np.ndarray:
        alpha = np.full((texts.shape[1] + 1, len(texts)), -np.inf)
        alpha[0] = 0.0
        for i, j, rows, at in self._arcs(texts):
            alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + self.log[at])
            if keep is not None:
                keep.append((i, j, rows, at))
        return alpha

    def forward(self, words: list[bytes]) -> np.ndarray:
        """Natural logs of the probabilities of all segmentations of each word."""
        out = np.empty(len(words))
        for some, texts in self._by_length(words):
            out[some] = self._forward(texts)[-1]
        for w, word in enumerate(words):
            if len(word) > LONG_WORD:
                out[w] = self._forward_long(word)[-1]
        return out

    def _arcs_long(self, text: np.ndarray, backward: bool = False) -> Iterator[tuple[list, list, list]]:
        """(starts, ends, pieces) of the arcs of one long byte string by start, all of one block of starts at once."""
        factor = np.uint64(HASH_FACTOR)
        codes = text.astype(np.uint64) + np.uint64(1)
        blocks = range(0, len(text), LONG_BLOCK)
        for low in reversed(blocks) if backward else blocks:
            n = min(LONG_BLOCK, len(text) - low)
            h, found = np.zeros(n, np.uint64), []
            for size in range(1, min(self.longest, len(text) - low) + 1):
                n = min(n, len(text) - low - size + 1)
                h = h[:n] * factor + codes[low + size - 1 : low + size - 1 + n]
                rows = np.flatnonzero(self.maybe[h >> np.uint64(64 - FILTER_BITS)])
                at = np.minimum(np.searchsorted(self.keys, h[rows]), len(self.keys) - 1)
                ok = self.keys[at] == h[rows]
                found.append(np.stack([low + rows[ok], low + rows[ok] + size, at[ok]]))
            arcs = np.concatenate(found, axis=1)
            arcs = arcs[:, np.argsort(arcs[0], kind="stable")]
            yield tuple(x.tolist() for x in (arcs[:, ::-1] if backward else arcs))

    def _forward_long(self, word: bytes) -> list[float]:
        text = np.frombuffer(self.space + word, np.uint8)
        log, alpha = self.log.tolist(), [-math.inf] * (len(text) + 1)
        alpha[0] = 0.0
        for arcs in self._arcs_long(text):
            for i, j, at in zip(*arcs):
                a, b = alpha[i] + log[at], alpha[j]
                alpha[j] = a + math.log1p(math.exp(b - a)) if a >= b else b + math.log1p(math.exp(a - b))
        return alpha

    def _expect_long(self, word: bytes, uses: np.ndarray) -> None:
        alpha = self._forward_long(word)
        log, beta = self.log.tolist(), [-math.inf] * len(alpha)
        beta[-1] = 0.0
        for arcs in self._arcs_long(np.frombuffer(self.space + word, np.uint8), backward=True):
            pieces, shares = [], []
            for i, j, at in zip(*arcs):
                a, b = log[at] + beta[j], beta[i]
                if a > -math.inf:
                    pieces.append(at)
                    shares.append(math.exp(alpha[i] + a - alpha[-1]))
                    beta[i] = a + math.log1p(math.exp(b - a)) if a >= b else b + math.log1p(math.exp(a - b))
            uses += np.bincount(pieces, shares, len(uses))

    def expect(self, words: list[bytes]) -> np.ndarray:
        """Expected number of uses of each piece in the words."""
        uses = np.zeros(len(self.pieces))
        for _, texts in self._by_length(words):
            arcs: list = []
            alpha = self._forward(texts, arcs)
            beta = np.full_like(alpha, -np.inf)
            beta[-1] = 0.0
            for i, j, rows, at in reversed(arcs):
                onward = self.log[at] + beta[j, rows]
                uses += np.bincount(at, np.exp(alpha[i, rows] + onward - alpha[-1, rows]), len(uses))
                beta[i, rows] = np.logaddexp(beta[i, rows], onward)
        for word in words:
            if len(word) > LONG_WORD:
                self._expect_long(word, uses)
        return uses


@dataclass(frozen=True)
class Totals:
    """N, V, ends and the discount of the learning tokens."""

    tokens: int
    distinct: int
    ends: int
    words: int
    discount: float

    def log_base(self) -> float:
        return math.log10(self.tokens + self.distinct + 1)

    def log_end(self) -> float:
        return math.log10(self.ends / self.tokens) if self.tokens else 0.0

    def log_words(self, c: np.ndarray, log_spelling: np.ndarray) -> np.ndarray:
        """log10 of words' probabilities; log_spelling is natural."""
        if not self.tokens or not self.words:
            return log_spelling / math.log(10)
        free = math.log(self.discount * self.words / self.tokens) + log_spelling
        own = np.log(np.maximum(c - self.discount, 0) / self.tokens, where=c > self.discount, out=np.full(len(c), -np.inf))
        return np.logaddexp(own, free) / math.log(10)


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Several batches as one, for longer vectors."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= GATHER_ROWS:
            yield pd.concat(held)
            held, n = [], 0
    if held:
        yield pd.concat(held)


def count_words(docs: DataFrame) -> DataFrame:
    """word, c (in learning rows), every (in all rows), over docs (text, learn)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush() -> pd.DataFrame:
            names = list({**every})
            out = pd.DataFrame({"word": [w.decode("utf-8", "surrogatepass") for w in names], "c": [learnt[w] for w in names], "every": [every[w] for w in names]})
            learnt.clear()
            every.clear()
            return out

        learnt, every, held = Counter(), Counter(), 0
        for b in batches:
            for t, learn in zip(b["text"], b["learn"]):
                ws = words_of(t)
                every.update(ws)
                if learn:
                    learnt.update(ws)
                held += len(ws)
                if held >= BLOCK_TOKENS:
                    yield flush()
                    held = 0
        if every:
            yield flush()

    return docs.select("text", "learn").mapInPandas(each, "word string, c long, every long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("every").alias("every"))


def totals_of(words: DataFrame, docs: DataFrame) -> Totals:
    def times(n: int) -> Column:
        return F.count(F.when(F.col("c") == n, 1))

    w = words.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v"), times(1).alias("once"), times(2).alias("twice")).first()
    ends = docs.where("learn").count()
    discount = w["once"] / (w["once"] + 2 * w["twice"]) if w["once"] and w["twice"] else 0.5
    return Totals((w["n"] or 0) + ends, w["v"] + (ends > 0), ends, w["v"], discount)


def refine(words: DataFrame, lattice: PieceLattice, rounds: int = ROUNDS) -> PieceLattice:
    """Expectation maximisation of the piece probabilities over word types with c > 0."""
    sc = words.sparkSession.sparkContext
    for _ in range(rounds):
        sent = sc.broadcast(lattice)

        def each(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            have = np.zeros(len(sent.value.pieces))
            for b in _gathered(batches):
                have += sent.value.expect([w.encode("utf-8", "surrogatepass") for w in b["word"]])
            at = np.flatnonzero(have)
            yield pd.DataFrame({"piece": at.astype(np.int32), "n": have[at]})

        got = words.where("c > 0").select("word").mapInPandas(each, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        p = lattice.prior * PRIOR
        for r in got:  # one row for each piece of the vocabulary
            p[r["piece"]] += r["n"]
        lattice.set(p / p.sum())
    return lattice


def score_words(words: DataFrame, lattice: PieceLattice, totals: Totals) -> DataFrame:
    """word, c, every, lp (log10 of its probability)."""
    sent = words.sparkSession.sparkContext.broadcast((lattice, totals))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice, totals = sent.value
        for b in _gathered(batches):
            spelling = lattice.forward([w.encode("utf-8", "surrogatepass") for w in b["word"]])
            yield b.assign(lp=totals.log_words(b["c"].to_numpy(np.int64), spelling))

    return words.mapInPandas(each, "word string, c long, every long, lp double")


def score_texts(docs: DataFrame, learn: Column, vocabulary: dict[bytes, float] | None = None, rounds: int = ROUNDS, head: int = HEAD) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text); learn: which rows are learned from."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learn"))
    words = materialize(count_words(docs), "words")
    totals = totals_of(words, docs.select("learn"))
    lattice = refine(words, PieceLattice(vocabulary or read_vocabulary()), rounds)
    scored = materialize(score_words(words, lattice, totals), "scored")
    # Whichever words are looked up, the others are joined: the choice changes no result.
    share = max(0.0, 1 - head / max(1, scored.count()))
    often = scored.agg(F.percentile_approx("every", share, 10_000)).first()[0] or 0
    top = scored.where(F.col("every") > often).limit(2 * head).select("word", "c", "lp").toPandas()
    n_base = totals.log_base()
    table = {w.encode("utf-8", "surrogatepass"): (int(c > 0), math.log10(c + 1) - n_base, lp) for w, c, lp in zip(top["word"], top["c"], top["lp"])}
    sent = docs.sparkSession.sparkContext.broadcast(table)
    end = (int(totals.ends > 0), math.log10(totals.ends + 1) - n_base, totals.log_end())

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["row", "doc_id", "n_tokens", "word", "n", "known", "base", "lp"]
        known_words, out = sent.value, []
        for b in batches:
            for doc_id, row, text in zip(b["doc_id"], b["row"], b["text"]):
                ws = words_of(text)
                known, base, lp = end
                for w, n in Counter(ws).items():
                    got = known_words.get(w)
                    if got:
                        known += n * got[0]
                        base += n * got[1]
                        lp += n * got[2]
                    else:
                        out.append((row, None, None, w.decode("utf-8", "surrogatepass"), n, 0, 0.0, 0.0))
                # No word holds a blank: the document's own row meets none in the join, and is dealt out like a word.
                out.append((row, doc_id, len(ws) + 1, f" {row}", 0, known, base, lp))
                if len(out) >= OUT_ROWS:
                    yield pd.DataFrame(out, columns=names).astype({"doc_id": b["doc_id"].dtype if b["doc_id"].dtype == object else "Int64", "n_tokens": "Int64"})
                    out = []
        if out:
            yield pd.DataFrame(out, columns=names).astype({"n_tokens": "Int64"})

    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    parts = numbered.mapInPandas(each, f"row long, doc_id {kind}, n_tokens long, word string, n long, known long, base double, lp double")
    rest = scored.select(F.col("word").alias("s_word"), F.col("c").alias("s_c"), F.col("lp").alias("s_lp"))
    met = parts.join(rest, parts["word"] == rest["s_word"], "left")
    n = F.col("n")
    each_row = met.select(
        "row", "doc_id", "n_tokens",
        (F.col("known") + n * F.coalesce((F.col("s_c") > 0).cast("long"), F.lit(0))).alias("known"),
        (F.col("base") + n * F.coalesce(F.log10(F.col("s_c") + 1) - F.lit(n_base), F.lit(0.0))).alias("base"),
        (F.col("lp") + n * F.coalesce("s_lp", F.lit(0.0))).alias("lp"),
    )
    return each_row.groupBy("row").agg(
        F.first("doc_id", True).alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("lp").alias("score")
    ).select("doc_id", "n_tokens", "n_known", F.lit(totals.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_texts(docs, fold(F.col("doc_id"), 7) != 2)
    return scored.select("doc_id", (fold(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
