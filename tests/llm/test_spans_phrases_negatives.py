"""Personal data, phrases and hard negatives against brute-force versions on small tables with awkward rows."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sessionlens.llm import hard_negatives, phrases, private_spans
from sessionlens.llm.private_spans import KINDS, Field, Segment, base_spans

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(d):
    x = [int(c) for c in d][::-1]
    return (sum(x[::2]) + sum(sum(divmod(2 * c, 10)) for c in x[1::2])) % 10 == 0


def plain_base(text):
    out = []
    for kind in KINDS:
        for m in re.finditer(BASE[kind], text):
            d = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda: True, "ip": lambda m=m: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda d=d: 16 <= len(d) <= 19 and plain_luhn(d), "phone": lambda d=d: 8 <= len(d) <= 15,
            }[kind]()
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns():
    r = random.Random(5)
    pieces = ["a@b.c", "x_y@d.e-f.g", "@", ".", "+1", " ", "(487)", "555-7209", "4845168114407329", "129.38.82.176", "1.2.3.4.5", "999.1.1.1", "é", "-", "+", "007.001.255.0", "12", "9", "a%b+c@h.i", "+49 30 1234567", "\n", "4845-1681-1440-7329"]
    for _ in range(3000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 14)))
        assert base_spans(text) == plain_base(text), text
    chars = "ab1@.+- 9(_"
    for _ in range(5000):
        text = "".join(r.choice(chars) for _ in range(r.randint(0, 30)))
        assert base_spans(text) == plain_base(text), text


def test_base_spans_of_long_runs_take_linear_time():
    for text in ("a" * 500_000, "a" * 300_000 + "@", "1" * 500_000, "1." * 200_000, "1 " * 200_000, "+1" + " " * 300_000, "+1" * 100_000, "a@" * 100_000):
        assert all(k in KINDS for k, _, _ in base_spans(text))


def random_field(seed, kinds=4):
    r = random.Random(seed)
    field = Field()
    field.turns = [[r.uniform(-1, 1) for _ in range(4)] for _ in range(5)]
    return field, r


def segmentations(group):
    for n in range(len(group) + 1):
        for pick in itertools.combinations(sorted(group, key=lambda s: (s.start, s.end)), n):
            if all(a.end <= b.start for a, b in zip(pick, pick[1:])):
                yield pick


def path_score(field, pick):
    last, total = private_spans.NONE, 0.0
    for s in pick:
        total += s.score + field.turns[last][s.kind]
        last = s.kind
    return total


@pytest.mark.parametrize("seed", range(30))
def test_best_segmentation_and_marginals_equal_enumeration(seed):
    field, r = random_field(seed)
    group = []
    for _ in range(r.randint(1, 8)):
        a = r.randint(0, 12)
        group.append(Segment(a, a + r.randint(1, 6), r.randrange(4), [], r.uniform(-2, 2)))
    every = list(segmentations(group))
    scores = [path_score(field, p) for p in every]
    assert path_score(field, field.best(group)) == pytest.approx(max(scores))
    total = sum(map(math.exp, scores))
    expected = np.zeros((5, 4))
    got = private_spans._marginals(group, np.array([s.score for s in group]), np.array(field.turns), expected)
    want = [sum(math.exp(x) for x, p in zip(scores, every) if any(s is q for q in p)) / total for s in group]
    assert got == pytest.approx(want)
    assert expected.sum() == pytest.approx(sum(want))
    # Leaving out what the bound excludes changes nothing.
    left = [s for s in group if s.score + field.gain(s.kind) > 0]
    assert path_score(field, field.best(left)) == pytest.approx(max(scores))


WORDS = "the river house went over many green hills and lost its name while people sang along".split()
CARDS = ["4845168114407329", "7536784127813050"]


@pytest.fixture(scope="module")
def field(spark):
    r = random.Random(2)
    rows = []
    for i in range(120):
        ws = [r.choice(WORDS) for _ in range(40)]
        if i % 3 == 0:
            ws[r.randrange(40)] = r.choice(["ann.lee@mail.example.com", "+1 (487) 555-7209", "129.38.82.176", CARDS[0], "2024-05-17", "1234567", "12.5"])
        rows.append((i, " ".join(ws)))
    return private_spans.fit(spark.createDataFrame(rows, "doc_id long, text string"))


@pytest.mark.parametrize("kind, value", [
    ("phone", "(487) 555-7209"), ("phone", "487-555-7209"), ("phone", "+1 (131) 555-0142"), ("card", "4845 1681 1440 7329"), ("card", "4845.1681.1440.7329"), ("ip", "129[.]38[.]82[.]176"),
    ("email", "ann.lee (at) mail (dot) example (dot) com"), ("email", "ann.lee at example dot com"), ("email", "ann[at]example[dot]org"),
])
def test_field_finds_what_patterns_miss(field, kind, value):
    text = f"the river house {value} went over many hills"
    base = base_spans(text)
    found = {(k, text[s:e]) for k, s, e in base + field.find(text, base)}
    assert (kind, value) in found


def test_field_parts_numbers_that_run_into_each_other(field):
    text = f"many green +1 (487) 555-7209 {CARDS[0]} hills and {CARDS[1]} {CARDS[0]} lost"
    assert base_spans(text) == []
    assert [(k, text[s:e]) for k, s, e in field.find(text, [])] == [("phone", "+1 (487) 555-7209"), ("card", CARDS[0]), ("card", CARDS[1]), ("card", CARDS[0])]


def test_field_leaves_other_numbers_alone(field):
    for value in ("2024-05-17", "17.05.2024", "12:30:15", "3.14159", "1,234,567", "4845168114407328", "1.2.3", "999.888.777.666", "12345", "arrived at home. Then", "1990-1995", "abc123def4567890123"):
        text = f"the river house {value} went over many hills"
        assert field.find(text, base_spans(text)) == [], value


def test_personal_data_rows(spark, field):
    long = " ".join(WORDS * 20_000) + " call (487) 555-7209 " + " ".join(WORDS)
    texts = [None, "", "no data here", "a@b.com " + CARDS[0] + " a@b.com", long, "a@b.com " + CARDS[0] + " a@b.com", "\U0001F600 a@b.com", "12 " * 50_000]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "a@b.com", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = [(r["doc_id"], [(s["kind"], s["start"], s["end"], s["text"], s["base"]) for s in r["spans"]]) for r in private_spans.personal_data(docs, field).collect()]
    by = dict(got)
    assert len(got) == len(rows) and by[0] == by[1] == by[2] == by[7] == []
    assert by[3] == by[5] == [("email", 0, 7, "a@b.com", True), ("email", 25, 32, "a@b.com", True), ("card", 8, 24, CARDS[0], True)]
    assert [s[3:] for s in by[4]] == [("(487) 555-7209", False)]
    assert by[6][0][1:3] == (2, 9)
    for d, text, _ in rows:
        base = [s[:3] for s in by[d] if s[4]]
        assert base == plain_base(text or "")
        assert all(not (a[1] < b[2] and b[1] < a[2]) for a in by[d] if not a[4] for b in by[d] if b is not a)
    clean = {r["doc_id"]: r["text"] for r in private_spans.redact(docs, field).collect()}
    assert clean[3] == "[EMAIL] [CARD] [EMAIL]" and clean[0] is None and "[PHONE]" in clean[4]
    assert private_spans.personal_data(docs.limit(0), field).count() == 0


def test_op11_query(spark, tmp_path):
    texts = [None, "", "write a@b.com or 1.2.3.4", f"{CARDS[0]} and +49 30 1234567", "nothing at all"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in private_spans.op11_personal_data(spark, str(tmp_path)).collect():
        base = plain_base(texts[r["doc_id"]] or "")
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(b[0] == k for b in base) for k in KINDS]
        assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert private_spans.op11_personal_data(spark, str(tmp_path / "none")).count() == 0


def plain_phrases(rows, least, longest, top):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                f.update((lang, *ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = defaultdict(list)
    for key, a in f.items():
        lang, ws = key[0], key[1:]
        if len(ws) < 2 or a < least:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, *ws[:k]] * f[lang, *ws[k:]]), k) for k in range(1, len(ws)))
        inside = any(b >= least and len(o) > len(key) and o[0] == lang and 100 * b >= 100 * a and any(o[1:][i : i + len(ws)] == ws for i in range(len(o) - len(ws))) for o, b in f.items())
        if not inside:
            out[lang].append((-score, -a, " ".join(ws).encode(), f[lang, *ws[:k]], f[lang, *ws[k:]]))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in out.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top])}


def phrase_rows(seed):
    r = random.Random(seed)
    vocab = ["a", "B", "ä", "É", "of", "the", " x", "日本", "w1", "w2", "W3"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    rows = [(None, "en"), ("", None), (" \t ", "en"), ("The The the", None), ("the of " * 400, "und")]
    for _ in range(60):
        text = "".join(r.choices(vocab, weights)[0] + r.choice([" ", " ", " ", "\t", ". ", ",", "  ", "\n"]) for _ in range(r.choice([0, 3, 60])))
        rows.append((text, r.choice(["en", "de", None])))
    return rows + rows[5:12]


@pytest.mark.parametrize("seed, burst, most", [(1, 4096, 400_000), (2, 2, 400_000), (3, 1, 5), (4, 3, 40)])
def test_phrases_equal_brute_force(spark, monkeypatch, seed, burst, most):
    monkeypatch.setattr(phrases.HatTrie.__init__, "__defaults__", (burst,))
    rows = phrase_rows(seed)
    docs = spark.createDataFrame([(*x, 1) for x in rows], "text string, lang string, rank int")
    got = {tuple(r) for r in phrases.collocations(docs, min_count=4, top=15, most_entries=most).collect()}
    assert got == plain_phrases(rows, 4, 5, 15)
    assert phrases.collocations(docs.limit(0), min_count=4).count() == 0


def test_phrases_of_sliced_texts_and_renumbered_words(spark, monkeypatch):
    rows = phrase_rows(9)
    monkeypatch.setattr(phrases, "SLICE", 40)
    monkeypatch.setattr(phrases, "BUFFER", 30)
    monkeypatch.setattr(phrases, "MOST_WORDS", 6)
    each = []
    # The task's code runs here, in this process, with the small limits.
    monkeypatch.setattr(phrases, "lean", lambda f: each.append(f) or f)
    docs = spark.createDataFrame(rows, "text string, lang string")
    phrases.count_phrases(docs, 2, 5, None, None, 3, 1, 10)
    batches = [pa.RecordBatch.from_pylist([{"lang": lang or "und", "text": t} for t, lang in rows[a : a + 7] if t is not None], pa.schema([("lang", "string"), ("text", "string")])) for a in range(0, len(rows), 7)]
    got = Counter()
    for out in each[0](iter(batches)):
        for run in out.to_pylist():
            assert run["phrases"] == sorted(run["phrases"], key=lambda p: [w.encode() for w in p.split(" ")])
            for p, n in zip(run["phrases"], run["counts"]):
                got[run["lang"], p] += n
    want = Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            for k in range(2, 6):
                want.update((lang or "und", " ".join(ws[i : i + k])) for i in range(len(ws) - k + 1))
    assert got == want


def test_phrase_scores_pass_64_bits(spark):
    counts = spark.createDataFrame([("x", "a", 3 * 10**12), ("x", "b", 2 * 10**12), ("x", "a b", 10**12)], "lang string, phrase string, a long")
    totals = spark.createDataFrame([("x", 10**13)], "lang string, n long")
    assert phrases.scored(counts, totals).first()["score"] == 1000 * 10**12 * 10**13 // (6 * 10**24)


def plain_negatives(rows):
    use = []
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        use.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = Counter()
    for me, (i, label, v) in enumerate(use):
        if i % 100:
            continue
        near = sorted((-sum(a * b for a, b in zip(v, o)), j, other) for at, (j, other, o) in enumerate(use) if at != me)
        for p, j in [(s, j) for s, j, o in near if o == label][:5]:
            window = [(s, k) for s, k, o in near if o != label and 30 * p >= 100 * s >= 90 * p][:10]
            out.update((i, j, n + 1, k, -p, -s) for n, (s, k) in enumerate(window))
    return out


@pytest.mark.parametrize("seed, k, rows_of_block", [(1, None, 512), (2, 5, 3), (3, 1, 512)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, seed, k, rows_of_block):
    monkeypatch.setattr(hard_negatives, "ROWS", rows_of_block)
    monkeypatch.setattr(hard_negatives, "FIRST", 8)
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, 8))
    rows = []
    for i in range(400):
        v = r.normal(size=8) * 0.4 + centres[r.integers(6)]
        rows.append((i * (5 if i % 3 else 4), [float(x) for x in v], int(r.integers(4))))
    rows += [(100, rows[3][1], 2), (100, rows[3][1], 2), (900, rows[25][1], 1), (700, None, 1), (800, [], 1), (None, rows[0][1], 1), (1100, rows[0][1], None), (1200, [float("nan")] * 8, 1), (1300, [1.0, None] + [0.0] * 6, 2), (2200, [0.0] * 8, 1)]
    rows += [(5000 + i, [0.5, -0.25], i % 3) for i in range(40)] + [(2300, [0.5, -0.25], 1)]
    data = spark.createDataFrame([(*x, 7) for x in rows], "vec_id long, embedding array<double>, label int, rank int")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = Counter(tuple(x) for x in hard_negatives.hard_negatives(data.withColumn("label", label), F.col("vec_id") % 100 == 0, k=k).collect())
    assert got == plain_negatives(rows)
    assert len(got) > 200


def test_hard_negatives_edges(spark):
    schema = "vec_id long, embedding array<double>, label int"
    anchor = F.col("vec_id") == 0
    assert hard_negatives.hard_negatives(spark.createDataFrame([], schema), anchor).count() == 0
    big = [(0, [2.0**20, 1.0], 0), (1, [2.0**20, 3.0], 0), (2, [2.0**19, 0.0], 1)]
    got = hard_negatives.hard_negatives(spark.createDataFrame(big, schema), anchor).collect()
    assert [tuple(x) for x in got] == [(0, 1, 1, 2, 2**56 + 3 * 2**16, 2**55)]
    assert hard_negatives.hard_negatives(spark.createDataFrame(big, schema), F.col("vec_id") == 9).count() == 0
    with pytest.raises(OverflowError):
        hard_negatives.scores(np.full((1, 2), 2.0**40), np.full((1, 2), 2.0**40))
