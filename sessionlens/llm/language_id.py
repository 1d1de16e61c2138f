"""Language identification by error-correcting output codes.

Each language gets a codeword; for each bit of the codewords a binary classifier over
hashed byte n-grams says on which side a text lies. The classifiers are naive Bayes
log-odds: the n-grams of all learning rows are counted by language in one distributed
aggregation, the languages of a side are averaged. A text's margins are compared with all codewords by
logistic loss, each bit weighted by how well its classifier does on that language
(measured on a bounded sample); the codeword of least loss wins. Texts whose second
codeword is nearly as near are flagged as ambiguous.

Null texts and texts without a letter are ``und`` with score 0. Texts of any length are
read whole. Null languages are not learned from; with a single language every text with
letters is of that language, with none ``und``. Repeated rows are predicted each. Only text is an
input of a prediction; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, read_table

BUCKET_BITS = 15
ORDERS = (2, 3)
#: Rows that the bits' weights are measured on, at most.
WEIGHT_ROWS = 8_192
MAX_LANGUAGES = 512
#: n-grams whose evidence counts as independent, at most.
EVIDENCE = 40
AMBIGUOUS = 0.8
PIECE = 1 << 20
UNDETERMINED = "und"
_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def ngram_buckets(text: str) -> Iterator[np.ndarray]:
    """Hash buckets of the byte n-grams of the letters and word ends, a piece of the text at a time."""
    raw = b" " + text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS) + b" "
    for at in range(0, len(raw), PIECE):
        b = np.frombuffer(raw[at : at + PIECE + max(ORDERS) - 1], np.uint8).astype(np.uint32)
        blank = b == 0x20
        for n in ORDERS:
            m = min(PIECE, len(b) - n + 1)
            if m > 0:
                code = np.full(m, n, np.uint32)
                empty = np.ones(m, bool)
                for j in range(n):
                    code = code * np.uint32(257) + b[j : j + m]
                    empty &= blank[j : j + m]
                yield ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS))[~empty]


def count_ngrams(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and their counts of each bucket over all rows (lang, text)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                have = sums.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
                for x in ngram_buckets(text):
                    np.add.at(have, x, 1)
        for lang, have in sums.items():
            at = np.flatnonzero(have)
            yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": have[at]})

    counted = rows.mapInPandas(each, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    langs = [r["lang"] for r in rows.select("lang").distinct().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    out = np.zeros((len(langs), 1 << BUCKET_BITS))
    where = {x: i for i, x in enumerate(langs)}
    got = counted.toPandas()  # at most MAX_LANGUAGES * 2^BUCKET_BITS rows, whatever the input
    out[got["lang"].map(where).to_numpy(int), got["bucket"].to_numpy()] = got["n"]
    return langs, out


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of +1 and -1: all dichotomies up to 6 languages, else random columns of the largest least distance."""
    if n <= 6:
        bits = range(1, 1 << max(n - 1, 0))
        return np.array([[1 if i == 0 or not b >> (i - 1) & 1 else -1 for b in bits] for i in range(n)], float).reshape(n, len(bits))
    rng, width, best = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None
    for _ in range(100):
        c = rng.choice([-1.0, 1.0], (n, width))
        least = ((width - c @ c.T) / 2 + width * np.eye(n)).min()
        if best is None or least > best[0]:
            best = least, c
    return best[1]


class Decoder:
    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        p = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True) if len(langs) else counts
        self.odds = np.zeros((1 << BUCKET_BITS, self.code.shape[1]), np.float32)
        for b, side in enumerate(self.code.T):
            self.odds[:, b] = np.log(p[side > 0].mean(axis=0)) - np.log(p[side < 0].mean(axis=0))
        self.weights = np.ones_like(self.code)

    def margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.odds.shape[1]), 0
        for x in ngram_buckets(text):
            total += self.odds[x].sum(axis=0, dtype=np.float64)
            n += len(x)
        return total / max(n, 1) * min(n, EVIDENCE)

    def decode(self, text: str) -> tuple[str, float, bool]:
        if not self.langs:
            return UNDETERMINED, 0.0, False
        loss = (self.weights * np.logaddexp(0, -self.code * self.margins(text))).sum(axis=1)
        like = np.exp(loss.min() - loss)
        best = int(loss.argmin())
        share = float(like[best] / like.sum())
        return self.langs[best], share, share < AMBIGUOUS

    def weigh(self, rows: pd.DataFrame) -> None:
        """Weights each bit of a language by the share of its rows (lang, m: margins) that lie on the right side."""
        for i, lang in enumerate(self.langs):
            m = np.array(rows.loc[rows["lang"] == lang, "m"].tolist())
            if len(m) and self.code.shape[1]:
                right = ((m * self.code[i]) > 0).mean(axis=0) + 1e-3
                self.weights[i] = right / right.sum() * len(right)


def fit(rows: DataFrame) -> Decoder:
    """Learns from rows (doc_id, lang, text); null languages and texts are left out."""
    rows = rows.where("lang is not null and text is not null")
    decoder = Decoder(*count_ngrams(rows.select("lang", "text")))
    sent = rows.sparkSession.sparkContext.broadcast(decoder)
    # Ids of the sample first, so that no text is sorted.
    ids = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(WEIGHT_ROWS)
    sample = rows.join(F.broadcast(ids), "doc_id", "left_semi").select("lang", "text").limit(WEIGHT_ROWS)  # repeated ids may bring more

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"lang": b["lang"], "m": [sent.value.margins(t) for t in b["text"]]})

    decoder.weigh(sample.mapInPandas(each, "lang string, m array<double>").toPandas())
    return decoder


def predict(docs: DataFrame, decoder: Decoder) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for each row of docs (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(decoder)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [sent.value.decode(t) if ok else (UNDETERMINED, 0.0, False) for t, ok in zip(b["text"], b["letters"])]
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang_pred": [x[0] for x in got], "score": [x[1] for x in got], "ambiguous": [x[2] for x in got]})

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    return docs.select("doc_id", "text", letters).mapInPandas(each, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    decoder = fit(docs.where(fold(F.col("doc_id"), 4) != 2))
    found = predict(docs.select("doc_id", "text"), decoder)
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")
