"""Guards on small cases with nulls, ties and repeated rows."""

from sessionlens.operators import guards


def test_note_problems(spark):
    notes = spark.createDataFrame(
        [(1, "s", "at 12 and 7", ["f1"], None), (2, "s", None, None, None), (3, "s", "fine 12", ["f1", "f9", "f8"], "c9"), (4, "s", "ok", None, "c9"), (5, "s", "12", ["f1", None], "c1"), (6, "t", "12", [], "")],
        "note_id int, session_id string, text string, frames array<string>, clip string",
    )
    one = lambda *xs: spark.createDataFrame([("s", x) for x in xs], "session_id string, item string")
    got = {r["note_id"]: (r["reason"], r["item"]) for r in guards.note_problems(notes, one("12", "12"), one("f1"), one("c1")).collect()}
    assert got == {1: ("number", "7"), 2: ("empty", None), 3: ("frame", "f9"), 4: ("clip", "c9"), 6: ("number", "12")}
    assert guards.note_problems(notes.where("false"), one("1"), one("f"), one("c")).count() == 0


def test_guard_stated(spark):
    stated = spark.createDataFrame([("s", 1, "a", "g1", "buy at"), ("s", 1, "b", "g2", "buy"), ("s", 1, "c", "g9", "buy"), ("s", 1, "d", "g1", ""), ("s", 2, "e", "g1", "now"), ("s", 1, "f", None, None)], "session_id string, trade_id int, field string, seg string, value string")
    segments = spark.createDataFrame([("s", "g1", "I buy at now"), ("s", "g2", None)], "session_id string, seg string, text string")
    near = spark.createDataFrame([("s", 1, "g1"), ("s", 1, "g1")], "session_id string, trade_id int, seg string")
    got = {r["field"]: (r["value"], r["reason"]) for r in guards.guard_stated(stated, segments, near).collect()}
    assert got == {"a": ("buy at", None), "b": (None, "not_found"), "c": (None, "no_segment"), "d": (None, "not_found"), "e": ("now", "outside_window"), "f": (None, "no_segment")}
