"""Phrases (collocations) of each language by exact counts, with HAT-tries.

Three passes over the texts. The first counts words. The second counts pairs of words
that are both frequent enough, the third phrases of three to five words whose pairs all
are: no other phrase can reach the least count. What is frequent reaches the tasks as a
bitmap of hashes of a fixed largest size; a false bit only makes more entries to count.

In the passes two and three a task counts in a HAT-trie: a shallow trie of word numbers
whose leaves are hash containers of the remaining words; a container that grows too large
bursts into a node with a container for each next word. From every place only the longest
phrase is inserted, shorter ones are sums of subtrees. When a task's tries hold too many
entries, their largest subtrees are spilled whole as sorted runs, cut by prefix partition
(a hash of language and first words); Spark merges the runs of each partition.

Texts are lower-cased (A-Z), split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and these into
words at blanks and tabs. Null and empty texts have no words, a null language is ``und``.
Rows that repeat count each time; texts of any length are read whole, a slice at a time.
Equal scores and counts are ordered by phrase. Only text and lang are read, so extra
columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import join_on_copy, lean, materialize, read_table

MIN_COUNT, LONGEST, TOP = 100, 5, 2_000
UNDETERMINED = "und"
#: Bits of a bitmap: 64 for each frequent entry, between these powers of two; the largest has 8 MB.
LEAST_BITS, MOST_BITS = 16, 26
#: Rows of a container, and of all tries of a task, before they burst or spill; rows of a batch of runs.
BURST, MOST_ENTRIES, RUN_ROWS = 8_192, 3_000_000, 100_000
#: Words that are looked up before they are counted, distinct words that a task remembers, and bytes of a slice of a text.
BUFFER, MOST_WORDS, SLICE = 1_000_000, 500_000, 4 << 20
#: Words of the corpus for each prefix partition.
PARTITION_WORDS = 4_000_000
_BREAK = b"\n"
_FOLD = bytes(0x20 if b == 9 else b + 32 if 0x41 <= b <= 0x5A else 10 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes], bool]]:
    """Languages with tokens of their texts (words, empty ones, and breaks between pieces); the flag says that the text goes on."""
    texts: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
        texts.setdefault(lang, []).append(text)
    for lang, some in texts.items():
        raw = _BREAK.join(some).translate(_FOLD)
        at = 0
        while at < len(raw):
            end = len(raw) if len(raw) - at <= SLICE else raw.find(b" ", at + SLICE)
            end = len(raw) if end < 0 else end
            yield lang, raw[at:end].replace(_BREAK, b" \n ").split(b" "), end < len(raw)
            at = end


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit(UNDETERMINED)).alias("lang"), "text").where("text is not null")


def count_words(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """lang, phrase, a: words with their counts, frequent ones; and the number of all words of a language, under a null phrase."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def batch(langs: list[str], words: list[bytes | None], counts: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], ["lang", "phrase", "a"])

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, words in seen.items():
                yield batch([lang] * len(words), list(words), list(words.values()))
            seen.clear()

        for b in batches:
            for lang, tokens, _ in _slices(b):
                words = Counter(tokens)
                del words[b""], words[_BREAK]
                yield batch([lang], [None], [words.total()])
                seen.setdefault(lang, Counter()).update(words)
                if sum(map(len, seen.values())) > MOST_WORDS:
                    yield from rows()
        yield from rows()

    counts = _texts(docs).mapInArrow(lean(each), "lang string, phrase string, a long")
    return counts.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where((F.col("a") >= min_count) | F.col("phrase").isNull())


def bitmap(frequent: DataFrame, n: int) -> np.ndarray:
    """Bits of the hashes of words, or of pairs of words (lang, phrase), as bytes; at most 2 ** MOST_BITS bits."""
    bits = min(MOST_BITS, max(LEAST_BITS, int(64 * n - 1).bit_length()))
    words = F.split("phrase", " ")
    first, last = F.xxhash64("lang", F.element_at(words, 1)), F.xxhash64("lang", F.element_at(words, -1))
    pair = F.shiftleft(first, 1).bitwiseOR(F.shiftrightunsigned(first, 63)).bitwiseXOR(last)
    at = F.when(F.size(words) > 1, pair).otherwise(first).bitwiseAND(F.lit((1 << bits) - 1))
    chunk = min(bits, 16)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for ones in b["ones"]:
                x = np.zeros(1 << chunk, np.uint8)
                x[np.asarray(ones, np.int64)] = 1
                out.append(np.packbits(x, bitorder="little").tobytes())
            yield pd.DataFrame({"chunk": b["chunk"], "packed": out})

    chunks = frequent.select(F.shiftright(at, chunk).alias("chunk"), at.bitwiseAND(F.lit((1 << chunk) - 1)).alias("one")).groupBy("chunk").agg(F.collect_set("one").alias("ones"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in chunks.mapInPandas(packed, "chunk long, packed binary").toLocalIterator():  # 2 ** (bits - 16) rows at most
        out[r["chunk"] << (chunk - 3) : (r["chunk"] + 1) << (chunk - 3)] = np.frombuffer(r["packed"], np.uint8)
    return out


def _set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _packed(rows: np.ndarray) -> np.ndarray:
    """Rows of word numbers as one sortable value each, in the rows' order."""
    wide = np.ascontiguousarray(rows, ">u4")
    if rows.shape[1] == 1:
        return rows[:, 0].astype(np.int64)
    return wide.view(">u8").ravel().astype(np.uint64) if rows.shape[1] == 2 else wide.view(f"V{4 * rows.shape[1]}").ravel()


def _merged(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows in order, with the sums of their counts."""
    if not len(rows):
        return rows, counts
    order = np.argsort(_packed(rows), kind="stable")
    rows, counts = rows[order], counts[order]
    first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1)))
    return rows[first], np.add.reduceat(counts, first)


class HatTrie:
    """Counts of phrases, rows of word numbers that zeros fill up.

    The upper levels are dictionaries by word number; the leaves are containers of the phrases' remaining words. A
    container takes rows as they come, sums equal ones when it is full, and bursts by the next word if most of them differ.
    """

    def __init__(self, burst: int = BURST):
        self.burst, self.root, self.size = burst, {}, 0

    def add(self, rows: np.ndarray, counts: np.ndarray) -> None:
        """rows are in order."""
        if len(rows):
            self.size += len(rows)
            self._under(self.root, rows, counts)

    def _under(self, node: dict, rows: np.ndarray, counts: np.ndarray) -> None:
        first = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0]))
        ends = np.append(first[1:], len(rows)).tolist()
        for word, a, b in zip(rows[first, 0].tolist(), first.tolist(), ends):
            child = node.get(word)
            if child is None:
                child = node[word] = _Container()
            if isinstance(child, dict):
                self._under(child, rows[a:b, 1:], counts[a:b])
                continue
            child.rows.append(rows[a:b, 1:])
            child.counts.append(counts[a:b])
            child.size += b - a
            if child.size > self.burst:
                before = child.size
                child.sum_up()
                self.size -= before - child.size
                if child.size > self.burst // 2 and child.rows[0].shape[1] > 1:
                    node[word] = {}
                    self._under(node[word], child.rows[0], child.counts[0])

    def spill(self, keep: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Takes whole subtrees of first words out, largest first, until at most keep rows are left; their phrases in order."""
        sizes = {w: _size(c) for w, c in self.root.items()}
        rows, counts = [], []
        for word in sorted(sizes, key=sizes.get, reverse=True):
            if self.size <= keep:
                break
            for r, c in _walk(self.root.pop(word)):
                rows.append(np.column_stack([np.full(len(r), word, np.uint32), r]))
                counts.append(c)
            self.size -= sizes[word]
        return _merged(np.concatenate(rows), np.concatenate(counts)) if rows else None


class _Container:
    __slots__ = ("counts", "rows", "size")

    def __init__(self) -> None:
        self.rows: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def sum_up(self) -> None:
        rows, counts = _merged(np.concatenate(self.rows), np.concatenate(self.counts))
        self.rows, self.counts, self.size = [rows], [counts], len(rows)


def _size(node: dict | _Container) -> int:
    return node.size if isinstance(node, _Container) else sum(map(_size, node.values()))


def _walk(node: dict | _Container) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if isinstance(node, dict):
        for word, child in node.items():
            for rows, counts in _walk(child):
                yield np.column_stack([np.full(len(rows), word, np.uint32), rows]), counts
    else:
        yield from zip(node.rows, node.counts)


class _Words:
    """Numbers and hashes of a language's words as a task meets them; number 0 breaks phrases (rare words), -1 is no word."""

    def __init__(self, lang: str, allowed: np.ndarray | None):
        self.seed, self.allowed = xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), seed=42), allowed
        self.texts, self.hashes, self.number = [b""], [0], _Numbers(self)
        self.number.update({b"": -1, _BREAK: 0})
        self.carry = np.zeros(0, np.int64)
        self.trie = HatTrie()

    def of(self, word: bytes) -> int:
        h = xxh64_intdigest(word, seed=self.seed)
        if self.allowed is not None:
            at = h & (8 * len(self.allowed) - 1)
            if not self.allowed[at >> 3] >> (at & 7) & 1:
                return 0
        self.texts.append(word)
        self.hashes.append(h)
        return len(self.texts) - 1


class _Numbers(dict):
    def __init__(self, words: _Words):
        self.words = words

    def __missing__(self, word: bytes) -> int:
        self[word] = n = self.words.of(word)
        return n


def _longest(ids: np.ndarray, linked: np.ndarray, shortest: int, longest: int, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the longest phrases from the first ``starts`` places, in order, and how often each occurs; linked: words i and i + 1 may be of one phrase."""
    going = ids > 0
    length = going.astype(np.int64)
    for k in range(1, longest):
        going = going[:-1] & linked[k - 1 : len(going) + k - 2]
        length[: len(going)] += going
    at = np.flatnonzero(length[:starts] >= shortest)
    rows = np.zeros((len(at), longest), np.uint32)
    for k in range(longest):
        more = length[at] > k
        rows[more, k] = ids[at[more] + k]
    return _merged(rows, np.ones(len(at), np.int64))


RUNS = pa.schema([("prefix", pa.int32()), ("lang", pa.string()), ("phrases", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def _runs(lang: str, words: _Words, rows: np.ndarray, counts: np.ndarray, shortest: int, prefixes: int) -> Iterator[pa.RecordBatch]:
    """Sorted runs by prefix partition of all prefixes, of shortest words at least, of the phrases; a prefix occurs as often as the phrases of its subtree."""
    texts = pa.array(words.texts, pa.binary()).cast(pa.string())
    place = np.empty(len(words.texts), np.int64)
    place[np.array(sorted(range(len(words.texts)), key=words.texts.__getitem__), np.int64)] = np.arange(len(words.texts))
    hashes = np.array(words.hashes, np.uint64)
    for k in range(shortest, rows.shape[1] + 1):
        have = rows[:, k - 1] > 0
        part, n = _merged(rows[have, :k], counts[have])
        mixed = np.zeros(len(part), np.uint64)
        for j in range(shortest):
            mixed = (mixed * np.uint64(0x9E3779B97F4A7C15)) ^ hashes[part[:, j]]
        prefix = ((mixed ^ (mixed >> np.uint64(31))) % np.uint64(prefixes)).astype(np.int32)
        order = np.lexsort((*(place[part[:, j]] for j in reversed(range(k))), prefix))
        part, n, prefix = part[order], n[order], prefix[order]
        for at in range(0, len(part), RUN_ROWS):
            some, of = part[at : at + RUN_ROWS], prefix[at : at + RUN_ROWS]
            joined = pc.binary_join_element_wise(*(texts.take(pa.array(some[:, j])) for j in range(k)), " ")
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            cut = pa.array(np.append(first, len(of)), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(of[first]), pa.array([lang] * len(first)), pa.ListArray.from_arrays(cut, joined), pa.ListArray.from_arrays(cut, pa.array(n[at : at + RUN_ROWS]))], schema=RUNS)


def count_phrases(docs: DataFrame, shortest: int, longest: int, words: np.ndarray | None, pairs: np.ndarray | None, partitions: int, min_count: int = MIN_COUNT, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """lang, phrase, a: phrases of shortest to longest words with at least min_count occurrences, made of words and pairs in the bitmaps (null: any)."""
    prefixes = 16 * partitions

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, _Words] = {}
        waiting: dict[str, list[np.ndarray]] = {}

        def settle(lang: str, last: bool) -> None:
            w = known[lang]
            ids = np.concatenate([w.carry, *waiting.pop(lang, [])])
            # The last places wait for words of the next texts' slice.
            keep = len(ids) if last else max(0, len(ids) - longest + 1)
            linked = (ids[:-1] > 0) & (ids[1:] > 0)
            if pairs is not None:
                h = np.array(w.hashes, np.uint64)[ids]
                linked &= _set(pairs, ((h[:-1] << np.uint64(1)) | (h[:-1] >> np.uint64(63))) ^ h[1:])
            w.carry = ids[keep:]
            w.trie.add(*_longest(ids, np.append(linked, False), shortest, longest, keep))

        def runs(lang: str, keep: int) -> Iterator[pa.RecordBatch]:
            if found := known[lang].trie.spill(keep):
                yield from _runs(lang, known[lang], *found, shortest, prefixes)

        for b in batches:
            for lang, tokens, goes_on in _slices(b):
                if lang not in known:
                    known[lang] = _Words(lang, words)
                w = known[lang]
                ids = np.fromiter(map(w.number.__getitem__, tokens), np.int64, len(tokens))
                ids = ids[ids >= 0]
                waiting.setdefault(lang, []).append(ids if goes_on else np.append(ids, 0))
                if sum(map(len, waiting[lang])) > BUFFER or len(w.number) > MOST_WORDS:
                    settle(lang, False)
                    if sum(x.trie.size for x in known.values()) > most_entries:
                        for each_lang in known:
                            yield from runs(each_lang, known[each_lang].trie.size // 2)
                    if len(w.number) > MOST_WORDS:  # numbers start anew: nothing may refer to the old ones
                        yield from runs(lang, 0)
                        fresh = _Words(lang, words)
                        fresh.carry = np.fromiter((fresh.number[w.texts[i]] if i else 0 for i in w.carry), np.int64, len(w.carry))
                        known[lang] = fresh
        for lang in known:
            settle(lang, True)
            yield from runs(lang, 0)

    spilled = _texts(docs).mapInArrow(lean(each), "prefix int, lang string, phrases array<string>, counts array<long>")
    entries = spilled.repartition(partitions, "prefix").select("prefix", "lang", F.explode(F.arrays_zip("phrases", "counts")).alias("e"))
    merged = entries.groupBy("prefix", "lang", F.col("e.phrases").alias("phrase")).agg(F.sum("e.counts").alias("a"))
    return merged.where(F.col("a") >= min_count).select("lang", "phrase", "a")


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of phrases by their lowest-scoring cut, from counts of words and phrases (lang, phrase, a) and words of a language (lang, n)."""
    words = F.split("phrase", " ")
    cuts = counts.where(F.size(words) > 1).withColumn("words", words).withColumn("k", F.explode(F.sequence(F.lit(1), F.size(words) - 1)))
    part = lambda a, n: F.concat_ws(" ", F.slice("words", a, n))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
    known = counts.select(F.struct("lang", "phrase").alias("part"), F.col("a").alias("f"))
    both = join_on_copy(cuts.withColumn("key", F.struct("lang", F.col("first").alias("phrase"))), known.withColumnRenamed("f", "l"), "key", "part", "inner").drop("key", "part")
    both = join_on_copy(both.withColumn("key", F.struct("lang", F.col("rest").alias("phrase"))), known.withColumnRenamed("f", "r"), "key", "part", "inner").drop("key", "part")
    both = both.join(totals.select(F.col("lang").alias("t_lang"), "n"), F.col("lang") == F.col("t_lang"))
    wide = {c: f"CAST({c} AS DECIMAL(16,0))" for c in ("a", "n", "l", "r")}
    exact = F.expr(f"(CAST(1000 AS DECIMAL(4,0)) * ({wide['a']} * {wide['n']})) div ({wide['l']} * {wide['r']})")
    best = both.withColumn("score", exact).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x"))
    return best.select("lang", "phrase", "x.a", "x.l", "x.r", "x.n", "x.score")


def maximal(phrases: DataFrame) -> DataFrame:
    """Phrases (lang, phrase, a, ...) without those that lie in a longer one of as many occurrences.

    A phrase in one that is longer by several words lies in one that is longer by one word and occurs at least as often."""
    words = F.split("phrase", " ")
    inner = F.array(F.concat_ws(" ", F.slice("words", F.lit(1), F.size("words") - 1)), F.concat_ws(" ", F.slice("words", F.lit(2), F.size("words") - 1)))
    longer = phrases.select("lang", "a", words.alias("words")).where("size(words) > 2").select("lang", "a", F.explode(inner).alias("phrase"))
    longest = longer.groupBy(F.struct("lang", "phrase").alias("inner")).agg(F.max("a").alias("outer_a"))
    met = join_on_copy(phrases.withColumn("key", F.struct("lang", "phrase")), longest, "key", "inner", "left")
    return met.where("outer_a is null or 100 * outer_a < 100 * a").drop("key", "inner", "outer_a")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of each language of docs (text, lang)."""
    if longest < 2:
        raise ValueError("a phrase has two words at least")
    words = materialize(count_words(docs, min_count), "words")
    totals = words.where("phrase is null").select("lang", F.col("a").alias("n"))
    frequent = words.where("phrase is not null")
    sizes = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], frequent.count()
    partitions = max(8, -(-sizes[0] // PARTITION_WORDS))
    counts = [frequent]
    pairs = materialize(count_phrases(docs, 2, 2, bitmap(frequent, sizes[1]), None, partitions, min_count, most_entries), "pairs")
    counts.append(pairs)
    if longest > 2:
        both = bitmap(frequent, sizes[1]), bitmap(pairs, pairs.count())
        counts.append(materialize(count_phrases(docs, 3, longest, *both, partitions, min_count, most_entries), "longer"))
    known = counts[0]
    for c in counts[1:]:
        known = known.unionByName(c)
    best = maximal(materialize(scored(known, totals), "scored"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH folded AS (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM folded),
worded AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces),
starts AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM worded),
grams AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM starts, range(1, 6) AS s(k) WHERE i + k - 1 <= len(ws)),
f AS MATERIALIZED (SELECT lang, phrase, k, count(*)::HUGEINT AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM worded GROUP BY lang),
cuts AS (SELECT lang, phrase, a, c.c AS cut, array_to_string((string_split(phrase, ' '))[1:c.c], ' ') AS first, array_to_string((string_split(phrase, ' '))[c.c + 1:], ' ') AS rest FROM f, range(1, 5) AS c(c) WHERE c.c < k),
both_parts AS (SELECT cuts.*, x.a AS l, y.a AS r, n, 1000 * cuts.a * n // (x.a * y.a) AS score FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = first JOIN f y ON y.lang = cuts.lang AND y.phrase = rest JOIN totals ON totals.lang = cuts.lang),
best AS (SELECT * FROM both_parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM best o WHERE o.lang = b.lang AND len(o.phrase) > len(b.phrase) AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * o.a >= 100 * b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""
