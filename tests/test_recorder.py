"""Recorder logs, clocks and day paths on small cases."""

from pyspark.sql import functions as F

from sessionlens.operators import recorder
from sessionlens.sources import recorder_log


def test_events_before_a_named_file_belong_to_the_first_and_unnamed_logs_to_every_video(spark):
    rows = [("s", 1, "pause", None), ("s", 2, "record_start", "C:\\v\\a.mkv"), ("s", 3, "pause", " "), ("s", 4, "file_changed", "/v/b.mkv"), ("s", 5, "resume", None), ("s", 6, "file_changed", None), ("t", 1, "pause", None)]
    events = spark.createDataFrame(rows, "session_id string, row_no long, event string, file string")
    got = {(r["session_id"], r["row_no"], r["file"]) for r in recorder.event_files(events).collect()}
    assert got == {("s", 1, "a.mkv"), ("s", 2, "a.mkv"), ("s", 3, "a.mkv"), ("s", 5, "b.mkv"), ("s", 6, "b.mkv"), ("t", 1, None)}
    videos = spark.createDataFrame([("t", "x.mkv"), ("t", "/r/y.mkv"), ("s", "/q/b.mkv")], "session_id string, name string")
    mine = {(r["session_id"], r["name"], r["row_no"]) for r in recorder.events_of_files(events, videos).collect()}
    assert mine == {("t", "x.mkv", 1), ("t", "y.mkv", 1), ("s", "b.mkv", 5), ("s", "b.mkv", 6)}
    assert recorder.events_of_files(events.where("false"), videos).count() == 0


def test_sample_times_are_inset(spark):
    rows = spark.createDataFrame([(1, 16.0), (2, 2.0), (3, 0.0), (4, -1.0), (5, float("nan")), (6, float("inf")), (7, None)], "id int, d double")
    got = {r["id"]: r["t"] for r in rows.select("id", recorder.sample_times(F.col("d")).alias("t")).collect()}
    assert got[1] == [1.0 + 2.0 * i for i in range(8)] and got[2][0] == 0.5 and got[2][7] == 1.5 and got[3] == [0.0] * 8
    assert got[4] == got[5] == got[6] == got[7] == []


def test_clock_of_a_file(spark):
    rows = [("a", 1, 61_000_000, 1), ("a", 2, 5, 1), ("a", 3, 7, 60), ("b", 4, 61_000_000, 1), ("b", 5, 120_000_000, 60), ("b", 6, 0, 60), ("c", 7, 61_000_000, 1), ("c", 8, 9, 60)]
    samples = spark.createDataFrame(rows, "file string, id int, wall_us long, resolution_s int")
    got = {r["id"]: (r["wall_us"], r["file_resolution_s"], r["reason"]) for r in recorder.resolve_clock(samples, ["file"]).collect()}
    assert got[1] == (61_000_000, 1, None) and got[3] == (7, 1, "resolution_mismatch")
    assert got[4] == (60_000_000, 60, None) and got[7] == (61_000_000, None, None)


def test_dates_paths_and_counts(spark):
    fills = spark.createDataFrame([("tv:2:x", None), ("tv:3:x", None), ("tv:2:x", "d0"), ("other", None), (None, None), ("tv:99999999999999999999:x", None)], "fill_id string, civil_date string")
    rows = spark.createDataFrame([(2, "d2"), (9, "d9")], "row_no long, civil_date string")
    got = sorted((r["fill_id"] or "", r["civil_date"] or "") for r in recorder.attach_dates(fills, rows).collect())
    assert got == [("", ""), ("other", ""), ("tv:2:x", "d0"), ("tv:2:x", "d2"), ("tv:3:x", ""), ("tv:99999999999999999999:x", "")]
    clips = spark.createDataFrame([("a", None), ("a", None), ("b", "suspected"), ("c", "clear"), ("d", None)], "day string, verdict string")
    assert {r["day"]: r["day_path"] for r in recorder.day_paths(clips).collect()} == {"a": True, "b": True, "c": False, "d": False}
    states = spark.createDataFrame([("ok",), ("ok",), (None,), ("odd",)], "state string")
    assert {r["state"]: r["n"] for r in recorder.log_counts(states).collect()} == {"ok": 2, "missing": 0, "invalid_json": 0}


def test_log_lines(spark, tmp_path):
    lines = ['{"event":" pause ","ts":"t1","video_s":"2.5","file":"/a/b.mkv","x":{"y":[1]}}', "", '{"event":"x","wall":"w","ts":"t","video_s":"NaN","file":""}', "{}"]
    rows = [("ok", i, x) for i, x in enumerate(lines)] + [("bad", 0, "{}"), ("bad", 1, '{"event":'), ("odd", 0, "[1]"), ("blank", 0, "  ")]
    held = spark.createDataFrame(rows, "session_id string, row_no long, line string")
    got = {(r["session_id"], r["row_no"]): (r["event"], r["wall"], r["video_s"], r["file"]) for r in recorder_log.log_events(held).collect()}
    assert got == {("ok", 0): ("pause", "t1", 2.5, "b.mkv"), ("ok", 2): ("x", "w", None, None), ("ok", 3): ("", None, None, None), ("bad", 0): ("", None, None, None)}
    sessions = spark.createDataFrame([("ok",), ("bad",), ("odd",), ("none",)], "session_id string")
    assert {r["session_id"]: r["state"] for r in recorder_log.log_states(sessions, held).collect()} == {"ok": "ok", "bad": "invalid_json", "odd": "invalid_json", "none": "missing"}
    (tmp_path / "s.jsonl").write_text("\n".join(lines))
    assert recorder_log.read_lines(spark, str(tmp_path)).count() == 4


def test_tag_table_round_trip(spark, tmp_path):
    proposals = spark.createDataFrame([(1, "open", ["a", "b"]), (2, "rejected", ["a"]), (3, None, None)], "trade_id long, status string, tags array<string>")
    trades = spark.createDataFrame([(1, "2024-02-03_x", None, "MNQ", "long", 17000.5, 2.0), (2, "2024-02-03_x", None, "MNQ", "long", 1.0, 1.0), (3, "2024-02-03_x", "2024-02-04", None, None, 10.0, None)], "trade_id long, session_id string, session_date string, instrument string, side string, price double, qty double")
    recorder_log.write_tags(recorder_log.tag_rows(proposals, trades), str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True).orderBy("notes").collect()
    assert [tuple(r) for r in back] == [("2024-02-03", "MNQ", "long", "17000.5", "2", "a,b", "trade 1"), ("2024-02-04", None, None, "10", "1", None, "trade 3")]


def test_allowed_ids_and_samples(spark):
    a = spark.createDataFrame([("s", "t2"), ("s", "t1"), ("s", ""), ("s", None)], "session_id string, id string")
    b = spark.createDataFrame([("s", "t1"), ("s", "brief")], "session_id string, id string")
    assert [r["id"] for r in recorder.allowed_ids([a, b]).orderBy("place").collect()] == ["t1", "t2", "brief"]
    samples = spark.createDataFrame([(1, "10:00:05", 1.0, 36_000_000_000, 2_000_000), (2, "junk", 1.0, 0, 0), (3, None, None, 0, 0)], "sample_id int, text string, confidence double, start_us long, video_us long")
    got = {r["sample_id"]: (r["y_us"], r["resolution"], r["reason"]) for r in recorder.mapped_samples(samples).collect()}
    assert got == {1: (3_000_000, 1, None), 2: (None, None, "unparseable"), 3: (None, None, None)}
