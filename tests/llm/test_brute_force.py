"""Training-data operators against brute-force versions on small tables with awkward rows."""

import hashlib
import itertools
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sessionlens.llm import (
    automaton, common, decontaminate, embedding_dedup, language_id, lattice_lm, license_scan, mixing, quality_crf, simhash, substring_dedup, url_filter,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def documents(n=60, seed=3):
    """Random texts with copies, edits, shared passages, nulls and empties."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["École", "ÑU", "the", "of"]
    passage = " ".join(r.choice(vocab) for _ in range(30))
    rows = []
    for i in range(n):
        ws = [r.choice(vocab) for _ in range(r.choice([0, 1, 2, 5, 40, 90]))]
        if i % 4 == 0:
            ws[len(ws) // 2 : 0] = passage.split()
        if i % 7 == 0 and rows and rows[-1][1]:
            ws = rows[-1][1].split()
            if i % 2 and ws:
                ws[r.randrange(len(ws))] = "changed"
        rows.append((i, r.choice([" ", "\n", "\t "]).join(ws), "en", f"s{i % 3}", 0))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s1", 0), (n + 2, " \n ", "fr", None, 1), (n + 3, rows[0][1], "en", "s0", 0), (None, rows[0][1], "en", "s0", 0)]
    return rows


def groups(nodes, linked):
    """Smallest node reachable, by plain search."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def slow_fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = WORDS.findall(t)
    grams = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def test_simhash_fingerprints_and_groups(spark):
    rows = documents()
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    fp = {r[0]: slow_fingerprint(r[1]) for r in rows if r[0] is not None}
    want = groups(fp, [(a, b) for a, b in itertools.combinations(sorted(fp), 2) if (fp[a] ^ fp[b]).bit_count() <= 2])
    for g in got:
        if g["doc_id"] is not None:
            assert g["fingerprint"] == f"{fp[g['doc_id']]:016x}"
            assert g["component_id"] == want[g["doc_id"]]
        else:
            assert g["component_id"] == want[0]


def test_simhash_agrees_with_spark_xxhash64(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("the quick École")).alias("h")).first()["h"] & (2**64 - 1)
    assert got == xxhash.xxh64_intdigest("the quick École".encode(), seed=42)


@pytest.mark.parametrize("limit", [2, 1000])
def test_covering_tables_miss_no_pair(spark, limit):
    """Both in sparse buckets (pairs) and in crowded ones (midpoints)."""
    r = random.Random(5)
    fps = set()
    for _ in range(6):
        c = r.getrandbits(64)
        for _ in range(25):
            x = c
            for _ in range(r.randrange(5)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(0, x, i) for i, x in enumerate(signed)], "seed int, fp long, node long")
    got = {r["node"]: r["component"] for r in common.connected_components(simhash.links(nodes, 2, limit)).collect()}
    want = groups(range(len(fps)), [(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 2])
    assert {n: got.get(n, n) for n in want} == want


def test_covering_masks_guarantee():
    for radius in (1, 2, 3):
        masks = simhash.covering_masks(radius)
        r = random.Random(radius)
        for _ in range(300):
            differ = sum(1 << i for i in r.sample(range(64), radius))
            assert any(differ & m == 0 for m in masks)


def test_components_on_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(70)] + [(200, i) for i in range(201, 260)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(71)}, **{i: 200 for i in range(200, 260)}}


def test_similar_groups_keep_one_of_copies_and_leave_others(spark):
    r = random.Random(1)
    base = [" ".join(f"v{r.randrange(5000)}" for _ in range(300)) for _ in range(12)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(base)]
    rows += [(100 + i, t, "en", "s", 0) for i, t in enumerate(base[:4])]
    rows += [(200 + i, t.replace(t.split()[50], "other"), "en", "s", 0) for i, t in enumerate(base[4:8])]
    kept = sorted(x["doc_id"] for x in simhash.keep_one(frame(spark, rows + [(None, base[0], "en", "s", 0), (300, None, None, None, None)])).where("doc_id is not null").collect())
    assert kept == [*range(12), 300]


def slow_similar(rows, similarity=0.8, shingle=5):
    """Component of each id by comparing all shingle sets."""
    def grams(t):
        ws = t.lower().split()
        return {tuple(ws[i : i + shingle]) for i in range(len(ws) - shingle + 1)} or {tuple(ws)}

    sets = {i: grams(t) for i, t in rows}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return groups(sets, linked)


def test_similar_groups_are_those_of_all_pairs(spark):
    r = random.Random(8)

    def text(n):
        return [f"v{r.randrange(3000)}" for _ in range(n)]

    notice = text(30)
    rows = []
    for i in range(60):
        ws = text(r.randrange(60, 300)) + (notice if i % 3 == 0 else [])
        more = r.randrange(5, len(ws) // 4)
        edited = list(ws)
        for at in r.sample(range(len(ws)), max(1, len(ws) // 50)):
            edited[at] = "other"
        copy = [text(more) + ws, ws + text(more), ws[more:], ws[:-more], edited][i % 5]
        rows += [(i, " ".join(ws)), (100 + i, " ".join(copy))]
    rows += [(300, " ".join(notice)), (301, " ".join(notice[:-2])), (302, "one two"), (303, "one two three")]
    want = slow_similar(rows)
    assert sum(i != c for i, c in want.items()) > 20
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, c in want.items() if c != i}


def test_similar_groups_of_a_crowd_are_those_of_all_pairs(spark):
    r = random.Random(2)
    base = [f"v{r.randrange(3000)}" for _ in range(150)]
    rows = []
    for i in range(220):
        ws = list(base)
        for at in r.sample(range(len(ws)), r.randrange(1, 5)):
            ws[at] = f"x{r.randrange(9)}"
        rows.append((i, " ".join(ws)))
    turn = [f"y{i}" for i in range(9)] * 2
    rows += [(300 + i, " ".join(turn[i:] + turn[:i])) for i in range(3)]
    want = slow_similar(rows)
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, c in want.items() if c != i}


def slow_match(text, items, window):
    def words(t):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)

    ws, hit, found = words(text), set(), set()
    for name, t in items:
        iw = words(t)
        if name is None or not iw:
            continue
        n = min(window, len(iw))
        wins = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)}
        for i in range(len(ws) - n + 1):
            if tuple(ws[i : i + n]) in wins:
                found.add(str(name))
                hit.update(range(i, i + n))
    return len(ws), hit, sorted(found)


@pytest.mark.parametrize("block_words", [10, 100_000])
def test_decontamination(spark, block_words):
    rows = documents(40, 8)
    items = [(1, rows[0][1]), (2, "w1 W2"), (3, "the"), (4, None), (None, "of"), (1, rows[4][1]), (5, " ".join((rows[8][1] or "").split()[3:20]) + "!"), (6, "!!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.match_items(frame(spark, rows), bench, 10, block_words).collect()
    assert len(got) == len(rows)
    seen = {g["doc_id"]: g for g in got}
    for doc_id, text, *_ in rows:
        n, hit, found = slow_match(text, items, 10)
        g = seen[doc_id]
        spans = {p for a, b in g["spans"] for p in range(a, b)}
        assert (g["n_words"], g["n_hit"], g["items"], spans) == (n, len(hit), found, hit)


def test_automaton_on_random_strings():
    r = random.Random(2)
    for _ in range(60):
        items = [(str(i), [r.choice([b"a", b"b", b"c"]) for _ in range(r.randrange(9))]) for i in range(4)]
        text = [r.choice([b"a", b"b", b"c", b"x"]) for _ in range(40)]
        window = r.choice([1, 2, 3, 5])
        spans, found = automaton.ItemAutomaton(items, window).match(text)
        hit, names = set(), set()
        for i, (_, ws) in enumerate([x for x in items if x[1]]):
            n = min(window, len(ws))
            for s in range(len(text) - n + 1):
                if any(ws[j : j + n] == text[s : s + n] for j in range(len(ws) - n + 1)):
                    hit.update(range(s, s + n))
                    names.add(i)
        assert ({p for a, b in spans for p in range(a, b)}, found) == (hit, names)


def test_removal_cuts_spans_and_drops_covered(spark):
    item = " ".join(f"q{i}" for i in range(12))
    rows = [(1, f"Keep this, {item.upper()}! and that " + "more " * 20, "en", "s", 0), (2, item, "en", "s", 0), (3, "clean", "en", "s", 0), (4, None, None, None, None)]
    out = {r["doc_id"]: r["text"] for r in decontaminate.remove_matches(frame(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert out == {1: "Keep this, ! and that " + "more " * 20, 3: "clean", 4: None}


def slow_substrings(rows, window):
    docs = {}
    for i, t, *_ in rows:
        docs.setdefault(i, []).append(WORDS.findall(t or ""))
    first = {}
    for i, texts in docs.items():
        if i is not None:
            for ws in texts:
                for p in range(len(ws) - window + 1):
                    k = tuple(ws[p : p + window])
                    first[k] = min(first.get(k, i), i)
    out = {}
    for i, t, *_ in rows:
        ws = WORDS.findall(t or "")
        gone = set()
        for p in range(len(ws) - window + 1):
            if i is not None and first[tuple(ws[p : p + window])] < i:
                gone.update(range(p, p + window))
        kept = " ".join(w for p, w in enumerate(ws) if p not in gone)
        out[i] = (len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("cuts, bits", [((), 64), ((0.2, 0.4, 0.5, 0.6, 0.7, 0.8), 64), ((0.3, 0.6), 9)])
def test_substring_dedup(spark, cuts, bits):
    """With 9 bits most hashes stand for several windows."""
    rows = documents(80, 4)
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.dedup_words(frame(spark, rows), 5, cuts, 4, bits).collect()}
    assert got == slow_substrings(rows, 5)


def test_substring_index_is_kept_between_sessions(spark, tmp_path):
    rows = [r for r in documents(80, 4) if r[0] is not None]
    docs = frame(spark, rows).select("doc_id", "text")
    index = substring_dedup.SubstringIndex(spark, 4, 5, 1, str(tmp_path / "index"))
    old = {}
    for low, high in ((0, 20), (20, 40), (40, 60), (60, 100)):
        for r in index.judge(docs.where(f"doc_id >= {low} and doc_id < {high}")).where("old").collect():
            old.setdefault(r["doc_id"], set()).update(substring_dedup.unpack_sorted(r["hashes"]).tolist())
        index = substring_dedup.SubstringIndex.load(spark, str(tmp_path / "index"), 1)
        assert len(index.runs) == 1
    want = {i: n for i, (_, n, _) in slow_substrings(rows, 5).items() if n}
    assert set(old) == set(want)
    for i, t, *_ in rows:
        if i in old:
            words = t.encode().split()
            keep = substring_dedup.kept_mask(words, [substring_dedup.pack_sorted(np.array(sorted(old[i]), np.uint64))], [], False, 5)
            assert (~keep).sum() == want[i]


def test_removed_passages_leave_line_breaks_and_repeated_ids_are_one_document(spark):
    shared = " ".join(f"p{i}" for i in range(20))
    rows = [(1, "a b\n" + shared, "x"), (2, f"c\td\n{shared}\n\ne f", "y"), (2, "c only", "z"), (3, shared, "w"), (3, shared, "v"), (4, " \n ", "u")]
    out = sorted((r["doc_id"], r["text"], r["extra"]) for r in substring_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string, extra string"), cuts=()).collect())
    assert out == [(1, "a b\n" + shared, "x"), (2, "c\td\n\n\ne f", "y"), (2, "c only", "z"), (4, " \n ", "u")]


def test_sorted_hashes_round_trip():
    h = np.unique(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (substring_dedup.unpack_sorted(substring_dedup.pack_sorted(h)) == h).all()
    assert len(substring_dedup.unpack_sorted(substring_dedup.pack_sorted(h[:0]))) == 0


def test_embedding_links_are_those_of_brute_force(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(40, 16))
    v = np.concatenate([base, base[:10] + 0.05 * r.normal(size=(10, 16)), base[0] + 0.02 * r.normal(size=(700, 16)), base[:3]])
    rows = [(i, [float(y) for y in x]) for i, x in enumerate(v)]
    odd = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [None] * 16), (5004, []), (5005, [1.0, 2.0])]
    got = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in embedding_dedup.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>"), k=3).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    comp = groups(range(len(v)), list(zip(*np.nonzero(link))))
    want = {i: (int(link[i].sum()), comp[i], comp[i] == i) for i in range(len(v))} | {i: (0, i, True) for i, _ in odd}
    assert sum(got[i] == want[i] for i in want) >= 0.999 * len(want)
    found = sum(got[i][0] for i in range(len(v)))
    assert 0.99 * link.sum() <= found <= link.sum()


def test_embedding_links_are_found_where_they_are_rare(spark):
    r = np.random.default_rng(6)
    v = r.normal(size=(6000, 32))
    for i in range(40):
        v[5000 + i] = v[i] + 0.42 * r.normal(size=32)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    assert 20 < link.sum() < 200
    rows = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {x["vec_id"]: x["n_links"] for x in embedding_dedup.near_duplicates(rows, k=40).collect()}
    assert got == {i: int(n) for i, n in enumerate(link.sum(axis=1))}


def test_embedding_rows_with_one_id_and_extreme_magnitudes(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, None), (2, [1e200, 1e200, 0.0]), (3, [1.0, 1.0, 0.0]), (4, [1e-200, 1e-200, 0.0]), (5, [1e-170, 0.0, 0.0]), (None, [1.0, 0.0, 0.0]), (6, [0.0, 0.0, 5e-324]), (6, [0.0, 0.0, 2.0])]
    got = sorted((tuple(x) for x in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=str)
    want = [(1, 1, 1, True), (1, 0, 1, True), (2, 2, 2, True), (3, 2, 2, False), (4, 2, 2, False), (5, 1, 1, False), (None, 0, None, False), (6, 1, 6, True), (6, 1, 6, True)]
    assert got == sorted(want, key=str)


def test_multi_sequence_order():
    r = np.random.default_rng(3)
    a, b = r.random(7), r.random(5)
    want = sorted(range(35), key=lambda c: a[c // 5] + b[c % 5])
    assert embedding_dedup.nearest_cells(a, b, 35) == want


def segmentations(word, arcs):
    if not word:
        return 1.0
    return sum(p * segmentations(word[len(s) :], arcs) for s, p in arcs.items() if word.startswith(s))


def r_word(n):
    r = random.Random(n)
    return bytes(r.choice(b"abcab") for _ in range(n))


def test_a_word_of_any_length_is_scored_in_time(spark):
    began = time.time()
    lattice = lattice_lm.PieceLattice({bytes([b]): 1 / 300 for b in range(256)} | {b"ab": 0.1, b"abc": 0.05})
    assert math.isfinite(lattice.forward([r_word(300_000)])[0]) and time.time() - began < 20


def test_lattice_sums_all_segmentations(spark):
    vocabulary = {bytes([b]): 1e-4 for b in range(256)} | {"▁".encode(): 0.1, "▁a".encode(): 0.2, b"ab": 0.15, b"b": 0.1, b"abc": 0.05, "▁ab".encode(): 0.07}
    total = sum(vocabulary.values())
    vocabulary = {k: v / total for k, v in vocabulary.items()}
    lattice = lattice_lm.PieceLattice(vocabulary)
    words = [b"abc", b"", b"abab", "é".encode(), b"cab", b"ab" * 5]
    assert lattice.forward(words) == pytest.approx([math.log(segmentations("▁".encode() + w, vocabulary)) for w in words])
    uses = lattice.expect([b"ab"])
    assert sum(n * len(s) for n, s in zip(uses, lattice.pieces)) == pytest.approx(len("▁ab".encode()))

    rare = r_word(700)
    assert lattice.forward([rare]) == pytest.approx([lattice._forward(np.frombuffer(lattice.space + rare, np.uint8)[None, :])[-1][0]])
    short, long = lattice.expect([rare[:200]]), lattice.expect([rare])
    assert sum(n * len(s) for n, s in zip(long, lattice.pieces)) == pytest.approx(700 + len(lattice.space)) and short.sum() < long.sum()

    rows = [(i, t) for i, t in enumerate(["ab ab abc", "AB c", None, "", "zz ab\nb", "ab"])] + [(None, "ab zz")]
    learn = F.coalesce(F.col("doc_id") != 4, F.lit(False))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in lattice_lm.score_texts(docs, learn, vocabulary, rounds=0, head=1).collect()}
    toks = {i: WORDS.findall((t or "").lower()) for i, t in rows}
    counts = {}
    for i, ws in toks.items():
        if i not in (4, None):
            for w in ws:
                counts[w] = counts.get(w, 0) + 1
    ends = 5
    n, v = sum(counts.values()) + ends, len(counts) + 1
    once, twice = sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
    d = once / (once + 2 * twice) if once and twice else 0.5
    for i, ws in toks.items():
        base = sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in ws) + math.log10((ends + 1) / (n + v + 1))
        score = math.log10(ends / n) + sum(math.log10(max(counts.get(w, 0) - d, 0) / n + d * len(counts) / n * segmentations("▁".encode() + w.encode(), vocabulary)) for w in ws)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(ws) + 1, sum(w in counts for w in ws) + 1, n)
        assert got[i]["base_score"] == pytest.approx(base)
        assert got[i]["score"] == pytest.approx(score)


def test_line_field_marginals_are_those_of_enumeration():
    r = np.random.default_rng(6)
    counts = np.array([1, 3, 2, 4])
    score, trans = r.normal(size=10), r.normal(size=(2, 2))
    good, pairs, log_z = quality_crf.marginals(score, counts, trans)
    at, want_pairs = 0, np.zeros((2, 2))
    for k, n in enumerate(counts):
        s = score[at : at + n]
        z, g, p = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = math.exp(sum(s[i] * y[i] for i in range(n)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            z += w
            g += w * np.array(y)
            for a, b in zip(y, y[1:]):
                p[a, b] += w
        assert log_z[k] == pytest.approx(math.log(z))
        assert good[at : at + n] == pytest.approx(g / z)
        want_pairs += p / z
        at += n
    assert pairs == pytest.approx(want_pairs)


def slow_margins(learn, text, langs, code):
    """Counts, log-odds and margins with plain dictionaries."""
    def buckets(t):
        raw = b" " + bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in t.lower().encode()) + b" "
        out = []
        for n in (2, 3):
            for i in range(len(raw) - n + 1):
                gram = raw[i : i + n]
                if gram.strip(b" "):
                    code = n
                    for c in gram:
                        code = (code * 257 + c) % 2**32
                    out.append(((code * 0x9E3779B1) % 2**32) >> (32 - language_id.BUCKET_BITS))
        return out

    size = 1 << language_id.BUCKET_BITS
    share = {}
    for lang in langs:
        seen = [b for x, t in learn if x == lang for b in buckets(t)]
        counts = {b: seen.count(b) for b in set(seen)}
        share[lang] = lambda b, c=counts, n=len(seen): (c.get(b, 0) + 0.5) / (n + 0.5 * size)
    got = buckets(text)
    out = []
    for bit in range(code.shape[1]):
        sides = [[x for i, x in enumerate(langs) if code[i, bit] == s] for s in (1, -1)]
        odds = sum(math.log(sum(share[x](b) for x in sides[0]) / len(sides[0])) - math.log(sum(share[x](b) for x in sides[1]) / len(sides[1])) for b in got)
        out.append(odds / len(got) * min(len(got), language_id.EVIDENCE))
    return out


def test_language_query_is_the_slow_one(spark):
    learn = [("en", "the cat and the dog"), ("en", "a house by the sea"), ("de", "der hund und die katze"), ("fr", "le chien et le chat"), ("fr", "la maison")]
    docs = frame(spark, [(i, t, x, "s", 0) for i, (x, t) in enumerate(learn)])
    decoder = language_id.fit(docs)
    assert decoder.langs == ["de", "en", "fr"]
    for _, t in [*learn, ("", "the katze"), ("", "Ça et là")]:
        m = slow_margins(learn, t, decoder.langs, decoder.code)
        assert decoder.margins(t) == pytest.approx(m, abs=1e-4)
        loss = [sum(decoder.weights[i, b] * math.log1p(math.exp(-decoder.code[i, b] * x)) for b, x in enumerate(m)) for i in range(3)]
        best = loss.index(min(loss))
        assert decoder.decode(t)[:2] == (decoder.langs[best], pytest.approx(1 / sum(math.exp(loss[best] - x) for x in loss), abs=1e-4))
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs, decoder).collect()}
    assert found == {i: decoder.decode(t)[:2] for i, (_, t) in enumerate(learn)}


def test_language_codewords_decode():
    code = language_id.codewords(4)
    assert code.shape == (4, 7)
    assert min(((code[a] != code[b]).sum()) for a, b in itertools.combinations(range(4), 2)) == 4
    big = language_id.codewords(12)
    assert min((big[a] != big[b]).sum() for a, b in itertools.combinations(range(12), 2)) >= 8


def test_language_and_quality_edges(spark):
    rows = [(i, "the cat and the dog " * 5, "en", "s", 0) for i in range(6)] + [(10 + i, "der hund und die katze " * 5, "de", "s", 0) for i in range(6)]
    rows += [(20, None, "en", "s", 0), (21, "123 !?", None, "s", 0), (22, "", "de", "s", 0), (None, "the dog", "en", "s", 0)]
    docs = frame(spark, rows)
    got = {r["doc_id"]: r for r in language_id.predict(docs, language_id.fit(docs)).collect()}
    assert [got[i]["lang_pred"] for i in (0, 11, 20, 21, 22, None)] == ["en", "de", "und", "und", "und", "en"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    nothing = language_id.fit(docs.where("false"))
    assert {r["lang_pred"] for r in language_id.predict(docs, nothing).collect()} == {"und"}
    labels = spark.createDataFrame([(i, int(i < 6)) for i in (*range(6), *range(10, 16))] + [(None, 1), (3, None)], "doc_id long, quality int")
    field = quality_crf.fit(docs, labels)
    s = {r["doc_id"]: r["score"] for r in quality_crf.score_documents(docs, field).collect()}
    assert s[20] == s[22] == 0 and all(0 <= x <= 1 for x in s.values())
    one = quality_crf.fit(docs, labels.where("quality = 1"))
    assert {r["score"] for r in quality_crf.score_documents(docs.where("doc_id < 6"), one).collect()} == {1.0}


def best_window(text, template, threshold):
    """Highest Dice coefficient of the windows of all sizes that can reach the threshold, each size by a window that slides."""
    have, want = license_scan.template_pairs(text), Counter(license_scan.template_pairs(template))
    n = sum(want.values())
    best = 0
    for size in range(max(1, math.ceil(n * threshold / (2 - threshold) - 1e-9)), math.floor(n * (2 - threshold) / threshold + 1e-9) + 1):
        inside, shared = Counter(), 0
        for at, pair in enumerate(have):
            inside[pair] += 1
            shared += inside[pair] <= want[pair]
            if at >= size:
                out = have[at - size]
                shared -= inside[out] <= want[out]
                inside[out] -= 1
            best = max(best, 2 * shared / (n + size))
    return best if best >= threshold else None


def test_long_licenses_with_foreign_words_inside_are_found(spark):
    """Window sizes between the first tried ones matter here."""
    texts = dict(license_scan.TEMPLATES)
    rows, want = [], {}
    rng = random.Random(8)
    for i in range(90):
        name = rng.choice([k for k, t in license_scan.TEMPLATES if len(license_scan.template_pairs(t)) > 60])
        ws = texts[name].split()
        k = len(ws) // 2 if i < 20 else rng.randrange(len(ws))
        ws[k:k] = [f"x{j}" for j in range(80 + i if i < 20 else rng.randrange(60, 130) * len(ws) // 220)]
        rows.append((i, " ".join(ws), None, None, 0))
        want[i] = max((d for _, t in license_scan.TEMPLATES if (d := best_window(rows[-1][1], t, 0.8))), default=None)
    got = {r["doc_id"]: r["best_dice"] for r in license_scan.scan_licenses(frame(spark, rows)).collect()}
    assert got == want
    assert 20 < sum(x is not None for x in want.values()) < 90


def test_license_windows_agree_with_a_slow_version(spark):
    rng = random.Random(5)
    texts = [text for _, text in license_scan.TEMPLATES]
    rows = []
    for i in range(60):
        ws = rng.choice(texts).split()
        for _ in range(rng.choice([0, 1, 2, 8, 25])):
            k = rng.randrange(len(ws))
            ws[k : k + rng.randrange(2)] = rng.choice([["new"], [], ["the", "software"], [ws[k]] * 3])
            ws = ws or ["x"]
        start = ["lead"] * rng.randrange(4)
        rows.append((i, rng.choice([" ", "\n"]).join(start + ws * rng.choice([1, 1, 2]) + ["tail"] * rng.randrange(4)), None, None, 0))
    got = {r["doc_id"]: (r["n_licenses"], r["licenses"], r["best_dice"]) for r in license_scan.scan_licenses(frame(spark, rows)).collect()}
    hits = 0
    for i, text, *_ in rows:
        each = {}
        for name, template in license_scan.TEMPLATES:
            if (dice := best_window(text, template, 0.8)) is not None:
                each[name] = max(dice, each.get(name, 0))
        hits += bool(each)
        assert got[i] == (len(each), ",".join(sorted(each)), max(each.values(), default=None)), i
    assert 20 < hits < 60


def test_license_edges(spark):
    mit = dict(license_scan.TEMPLATES[:-1])["MIT"]
    wrapped = "\n".join(mit.split())
    rows = [(1, f"x\n{mit.upper()}\n{mit}", None, None, 0), (1, mit, None, None, 0), (2, None, None, None, 0), (3, "", None, None, 0), (None, wrapped, None, None, 0), (4, "MIT License", None, None, 0), (5, "word " * 50_000 + mit + " word" * 50_000, None, None, 0)]
    docs = frame(spark, rows).withColumn("row", F.lit("clash")).withColumn("bigram", F.lit(1)).withColumn("license", F.lit(None))
    got = {r["doc_id"]: (r["n_licenses"], r["licenses"], r["best_dice"]) for r in license_scan.scan_licenses(docs).collect()}
    assert got[1] == got[None] == got[5] == (1, "MIT", 1.0)
    assert got[2] == got[3] == got[4] == (0, "", None)
    assert license_scan.scan_licenses(docs, [("one", "word"), ("gruss", "é ü ö")]).where("n_licenses > 0").count() == 0


def test_url_edges(spark):
    pages = spark.createDataFrame([(1, "http://A.example.com/en/x?y"), (2, None), (3, "no scheme"), (4, "https://www.Example.com/en/#z"), (5, "http://u@h.co.uk:80"), (6, "ftp://x.net/es"), (7, "http://x.net/es/"), (7, "http://x.net/es/")], "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, good int")
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, none).orderBy("page_id").collect()]
    assert got[0][:4] == (1, "a.example.com", "/en/x", "example.com/en/") and got[0][4] == "block"
    assert got[1][1:4] == ("", "", None) and got[2][1:4] == ("", "", None)
    assert got[3][3:] == ("www.example.com/en/", "allow")
    assert got[4][1:4] == ("u@h.co.uk:80", "", None)
    assert got[5][3] is None and got[6][3:] == ("net/es/", "block") and len(got) == 8


def test_mixing_follows_target_weights(spark):
    rows = [(i, f"t{i}", "en", "a" if i % 4 else "b", 0) for i in range(4000)] + [(None, None, None, None, None)]
    out = mixing.mix(frame(spark, rows).withColumn("copy_no", F.lit(9)), {"a": 0.5, "b": 0.5})
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert set(n) == {"a", "b"} and abs(n["a"] - 2000) < 200 and abs(n["b"] - 2000) < 200
    again = mixing.mix(frame(spark, rows[::-1]).repartition(7), {"a": 0.5, "b": 0.5})
    assert out.drop("copy_no").exceptAll(again.drop("copy_no")).count() == 0
    counts = np.array([r["n"] for r in out.where("source = 'b'").groupBy("doc_id").agg(F.max("n_copies").alias("n")).collect()])
    share = np.bincount(np.r_[counts, np.zeros(1000 - len(counts), int)], minlength=4)[:4] / 1000
    assert np.abs(share - [math.exp(-2) * 2**k / math.factorial(k) for k in range(4)]).max() < 0.05


def test_mixing_repeats_a_small_source_any_number_of_times(spark):
    rows = [(i, "t", "en", "a", 0) for i in range(20)] + [(100 + i, "t", "en", "b", 0) for i in range(40)] + [(200, "t", "en", None, 0)]
    out = mixing.mix(frame(spark, rows), {"a": 0.5, "b": 0.1}, total=36_000)
    n = {r["doc_id"]: (r["n"], r["d"], r["m"], r["c"]) for r in out.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("copy_no").alias("d"), F.max("copy_no").alias("m"), F.max("n_copies").alias("c")).collect()}
    assert all(len(set(x)) == 1 for x in n.values())
    a, b = (np.array([n[i][0] for i in ids]) for ids in (range(20), range(100, 140)))
    assert abs(a.mean() - 1500) < 40 and abs(b.mean() - 150) < 9 and 15 < a.std() < 75
    assert mixing.mix(frame(spark, [(1, "t", "en", "a", 0)]), total=150_000).where("copy_no = n_copies").count() == 1


def test_empty_tables(spark):
    docs = frame(spark, [])
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_one(docs).count() == 0
    assert decontaminate.match_items(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert mixing.mix(docs).count() == 0
    assert lattice_lm.score_texts(docs, F.lit(True), {b"a": 1.0}).count() == 0
    assert license_scan.scan_licenses(docs).count() == 0
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert substring_dedup.dedup_words(docs).count() == 0
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "page_id long, good int")).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_crf.drop_low_quality(docs, quality_crf.fit(docs, labels)).count() == 0
    assert language_id.predict(docs, language_id.fit(docs)).count() == 0


def test_members_of_a_shingle_are_compared_in_place(spark, monkeypatch):
    """Texts of one rare line meet in it; pairs become rows only where their parities are near, in one block or several."""
    from sessionlens.llm.common import Scratch

    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)) for n in rng.integers(3, 90, 60)]
    sets += [np.unique(np.r_[s[2:], s[:1] + np.uint64(1)]) for s in sets[:30]]
    rows = [(i, len(s), simhash.parity(s)) for i, s in enumerate(sets)]
    classes = spark.createDataFrame(rows, "node long, size int, parity binary")
    members = spark.createDataFrame([(h, i, n, 0, i % 7 if h else i, len(rows)) for h in (0, 5) for i, n, _ in rows], "h long, node long, size int, pos int, component long, members long")
    share = 0.2 / 1.8
    want = {(a, b) for a, m, x in rows for b, n, y in rows if a < b and min(m, n) >= (m + n) * 0.8 / 1.8 - 1e-6 and simhash.parity_distance(x, y) <= share * (m + n) + 1e-6}
    assert 0 < len(want) < len(rows) * 3
    for block in (512, 16):
        monkeypatch.setattr(simhash, "MEET_BLOCK", block)
        with Scratch(spark) as scratch:
            got = simhash._Verifier(None, classes, scratch, 0.8, 5).near_members(members).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_a_bucket_finds_a_row_for_each_group_of_documents(spark):
    """Not one for each document and bucket, whose number grows with the square of the texts; no warning of pandas either."""
    import warnings

    words = [f"w{i}" for i in range(400)]
    docs = spark.createDataFrame([(i, f"n{i} " + " ".join(words)) for i in range(300)], "doc_id long, text string")
    index = substring_dedup.SubstringIndex(spark, 6, 5)
    first = index.judge_groups(docs.where("doc_id < 150"))
    second = index.judge_groups(docs.where("doc_id >= 150"), last=True)
    parts = docs.rdd.getNumPartitions()
    rows = first.count() + second.count()
    assert 0 < rows <= 2 * 2 * (6 * 6 + parts * 6)
    lists = substring_dedup.by_document(first.unionByName(second)).collect()
    assert sorted(r["doc_id"] for r in lists) == list(range(300))
    assert {r["doc_id"] for r in lists if r["old"]} == set(range(1, 300))
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        packed = substring_dedup._Packed(4)
        h, d = np.arange(9, dtype=np.uint64), np.arange(9)
        packed.shared(h, d, True)
        packed.windows(1, h, d)
        assert substring_dedup._Packed(4).frame().empty and packed.frame()["grp"].isna().sum() == 1
