"""Text operators against slow versions."""

import random

from sessionlens.operators import evidence, screens, text
from pyspark.sql import functions as F


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_word_errors_of_whole_texts(spark):
    r = random.Random(3)
    pairs = [([f"w{r.randrange(400)}" for _ in range(r.randrange(300))], [f"w{r.randrange(400)}" for _ in range(r.randrange(300))]) for _ in range(20)]
    pairs += [([], []), ([], ["a"]), (["a"], [])]
    rows = [(i, a, b) for i, (a, b) in enumerate(pairs)]
    got = {x["i"]: x for x in text.word_errors(spark.createDataFrame(rows, "i int, ref array<string>, hyp array<string>")).collect()}
    for i, a, b in rows:
        n = edits(a, b)
        assert (got[i]["n_words"], got[i]["edits"]) == (len(a), n)
        assert got[i]["wer"] == (n / len(a) if a else float(n > 0))


def test_tokens_of_several_words(spark):
    rows = [(["buy", "the", "dip", "now"], ["the", "dip"]), (["thedip"], ["the", "dip"])]
    got = [tuple(x) for x in text.jargon_recall(spark.createDataFrame(rows, "ref array<string>, hyp array<string>"), ["the dip", "now", "dip the"]).select("n_jargon", "recall").collect()]
    assert got == [(2, 0.5), (0, 1.0)]


def test_citations_without_quote_and_raw_text(spark):
    segments = spark.createDataFrame([("s", "a", "hello world", "helo wrld"), ("s", "b", None, None)], "session_id string, seg string, text string, raw_text string")
    spans = spark.createDataFrame([("s", "a", None, None), ("s", "a", "", "hello"), ("s", "a", "wrld", None), ("s", "a", "moon", None), ("s", "x", None, None), ("s", "b", "x", None)], "session_id string, seg string, quote string, token string")
    got = {(r["seg"], r["quote"]): r["ok"] for r in text.check_citations(spans, segments).collect()}
    assert got == {("a", None): True, ("a", ""): True, ("a", "wrld"): True, ("a", "moon"): False, ("x", None): False, ("b", "x"): False}


def test_full_width_digits_on_screens(spark):
    row = spark.createDataFrame([("－１２３．５０", "１０：３０：００")], "v string, c string").select(screens.result(F.col("v"), F.lit(1.0)).alias("v"), screens.clock_resolution(F.col("c")).alias("c")).first()
    assert (row["v"], row["c"]) == (-123.5, 1)


def test_nearest_points_are_those_of_all_pairs(spark):
    r = random.Random(5)
    wins = [(s, f"{s}-{i}", e, e - r.randrange(9), e + r.randrange(9)) for s in "ab" for i, e in enumerate(r.randrange(200) for _ in range(60))]
    wins += [("a", "cut", 300, 100, 100), ("c", "none", 5, 0, 9)]
    points = [(s, i, r.randrange(220)) for s in "ab" for i in range(50)]
    w = spark.createDataFrame(wins, "k string, trade_id string, entry_us long, t0_us long, t1_us long")
    p = spark.createDataFrame(points, "k string, point_id long, p_us long")
    one, many = {}, set()
    for k, t, e, t0, t1 in wins:
        mine = [(not t0 <= x <= t1, abs(x - e), x, i) for s, i, x in points if s == k]
        if mine:
            one[t] = min(mine)[3]
            inside = [(t, i, True) for o, _, _, i in mine if not o]
            many |= set(inside or [(t, min(m[1:] for m in mine)[2], False)])
    assert {x["trade_id"]: x["point_id"] for x in evidence.nearest_one(w, p, ["k"]).collect()} == one
    assert {tuple(x) for x in evidence.nearest_or_inside(w, p, ["k"]).select("trade_id", "point_id", "inside").collect()} == many


def test_recording_names_are_read_in_the_recorder_s_clock(spark):
    from sessionlens.operators import gates

    rows = [("a/b/Desk 2026-07-01 09-30-15.mkv",), ("2026-01-05_23:59:00",), ("none.mkv",), (None,)]
    got = gates.recording_name(F.col("n"))
    out = [tuple(r) for r in spark.createDataFrame(rows, "n string").select(*(c.alias(k) for k, c in got.items())).collect()]
    assert out == [("2026-07-01_093015", 1782891015000000, "Desk "), ("2026-01-05_235900", 1767653940000000, ""), (None, None, None), (None, None, None)]
    weeks = spark.createDataFrame([("2026-W01",), ("2026-W53",), ("2025-W53",), ("2026-W1",), (None,)], "w string").select(gates.shift_week(F.col("w"), -1).alias("w")).collect()
    assert [r["w"] for r in weeks] == ["2025-W52", "2026-W52", None, None, None]
    assert [r["m"] for r in spark.createDataFrame([("2026-12",), ("2026-13",)], "m string").select(gates.shift_month(F.col("m"), 2).alias("m")).collect()] == ["2027-02", None]


def test_a_token_may_stand_in_another_case_as_whole_words(spark):
    segments = spark.createDataFrame([("s", "a", "Buy The Dip, now")], "session_id string, seg string, text string")
    spans = spark.createDataFrame([("s", "a", None, t) for t in ("the dip", "THE", "ip", "dips", "dip now", "ip, n", "e dip")], "session_id string, seg string, quote string, token string")
    got = {r["token"]: r["ok"] for r in text.check_citations(spans, segments).collect()}
    assert got == {"the dip": True, "THE": True, "ip": True, "dips": False, "dip now": True, "ip, n": True, "e dip": False}


def test_the_last_row_of_a_key_is_settled(spark):
    from sessionlens.operators import ledger

    rows = spark.createDataFrame([("k", 2, "b"), ("k", 2, "a"), ("k", 1, "z"), (None, 1, "n")], "k string, n int, v string")
    assert {tuple(r) for r in ledger.last_row(rows, ["k"], "n").collect()} == {("k", 2, "a"), (None, 1, "n")}
