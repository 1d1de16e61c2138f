"""Tag mapping against a plain version that searches every spelling by itself."""

import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from sessionlens.operators.tag_map import TagMap, mapped_tags, trie_pattern
from sessionlens.operators.tags import TagGrammar

GRAMMAR = TagGrammar(
    playbooks={"LEF": True}, aliases={}, variants={}, entries=["E_agg"], triggers={"MFR": True}, vocabulary=[], confirm=["5m21EMA", "5m50SMA"],
    ma_pair=r"^V_(1m|5m|30m)([0-9]+)(EMA|SMA)x([0-9]+)(EMA|SMA)$", effective_from=date(2026, 11, 2),
)
TAGS = TagMap(
    exact={"ONH": None, "dVWAP": None, "pdH": "pdHigh", "pdLow_RTH": "pRTH_Low", "p30POC": None, "5m21SMA": "SMA_21_5min", "a.b": None, "x y": None, "x y z": None}, context=["ITR", "ITR-C", "3c", "touch"],
    qualifiers=["_retest", "_naked"], grammar=GRAMMAR, grammar_tags=["PB_LEF", "E_agg", "T_MFR", "PB_p30V"],
)
WORD = re.compile(r"[A-Za-z0-9]+(?:[._-][A-Za-z0-9]+)*")


def plain(text, with_grammar):
    blob = (text or "").strip()
    if not blob:
        return []
    lookup = TAGS.spellings(with_grammar)
    low = blob.lower()
    if low in lookup:
        return [lookup[low]]
    bare = [tag for s, tag in lookup.items() if re.sub("[^a-z0-9]", "", s) == re.sub("[^a-z0-9]", "", low) != ""]
    if bare:
        return [max(bare, key=len)]
    spans = []
    for s, tag in lookup.items():
        spans += [(m.start(), -len(s), tag) for m in re.finditer(rf"(?<![A-Za-z0-9_]){re.escape(s)}(?![A-Za-z0-9_])", blob, re.I)]
    out, end = [], 0
    for start, minus, tag in sorted(spans):
        if start >= end:
            out.append(tag)
            end = start - minus
    closed = TAGS.spellings(False)
    for w in WORD.findall(blob):
        found = closed.get(w.lower())
        for q in TAGS.qualifiers:
            if not found and w.lower().endswith(q) and len(w) > len(q):
                found = closed.get(w.lower()[: -len(q)])
        if not found and with_grammar:
            found = {t.lower(): t for t in TAGS.grammar_tags}.get(w.lower()) or (w if w == "V_5m21EMAx50SMA" else None)
        out.append(found)
    return list(dict.fromkeys(t for t in out if t))


def run(spark, rows):
    df = spark.createDataFrame([(i, t, d) for i, (t, d) in enumerate(rows)], "i long, text string, day date")
    return [r["tags"] for r in df.select("i", mapped_tags(F.col("text"), TAGS, F.col("day")).alias("tags")).orderBy("i").collect()]


@pytest.mark.parametrize("text, want", [
    ("ONH Touch", ["ONH", "touch"]), ("3c", ["3c"]), ("dVWAP", ["dVWAP"]), ("d VWAP", ["dVWAP"]), ("Scalp", []), ("ONH_retest", ["ONH"]), ("pRTH_Low", ["pdLow_RTH"]), ("p30POC", ["p30POC"]), ("played ITR-C today", ["ITR-C"]),
    ("pdHigh", ["pdH"]), ("pdHigh_retest", ["pdH"]), ("SMA_21_5min", ["5m21SMA"]), ("ONH Touch Scalp invented_tag", ["ONH", "touch"]), ("PB_LEF", []), ("x y z x y", ["x y z", "x y"]), (None, []), ("  ", []),
])
def test_stated_texts(spark, text, want):
    assert run(spark, [(text, None)]) == [want] == [plain(text, False)]


def test_grammar_from_its_first_day(spark):
    before, on = date(2026, 11, 1), date(2026, 11, 2)
    rows = [("PB_LEF", before), ("PB_LEF", on), ("PB_LEF E_agg ONH", on), ("PB p30V", on), ("V_5m21EMAx50SMA", on), ("V_5m50SMAx21EMA", on), ("MFR", on), ("T_MFR", None)]
    assert run(spark, rows) == [[], ["PB_LEF"], ["PB_LEF", "E_agg", "ONH"], ["PB_p30V"], ["V_5m21EMAx50SMA"], [], [], []]


def test_random_texts(spark):
    r = random.Random(4)
    parts = ["ONH", "onh", "touch", "ITR-C", "ITR", "pdHigh", "pdH", "x", "y", "z", "a.b", "aXb", "é", "3c", "PB_LEF", "_retest", "-", ".", "SMA_21_5min", "d", "VWAP", "E_agg", "ITR-Cx"]
    rows = [("".join(r.choice(parts) + r.choice([" ", " ", "", "_", ", ", "\n"]) for _ in range(r.randint(1, 12))), r.choice([None, date(2027, 1, 1)])) for _ in range(400)]
    rows.append((" ".join(r.choice(parts) for _ in range(20_000)), None))
    assert run(spark, rows) == [plain(t, d is not None) for t, d in rows]


def test_trie_takes_the_longest(spark):
    words = ["a", "ab", "abc", "b", "bc.d", "c"]
    pattern = re.compile(trie_pattern(words))
    assert [m.group() for m in pattern.finditer("abcabbc.da")] == ["abc", "ab", "bc.d", "a"]
    assert run(spark, [("nothing", None)]) == [[]]
    assert spark.range(1).select(mapped_tags(F.lit("x"), TagMap(exact={})).alias("t")).first()["t"] == []
