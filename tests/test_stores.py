"""Ledger tables, session folders, lab tables, journals and recordings in real files."""

import json
import uuid
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from sessionlens.operators import pairing, sequential
from sessionlens.operators.scorecards import RULES, whole_scorecards
from sessionlens.sources import journal, ledger_tables, session_files


@pytest.fixture()
def ledger(spark, tmp_path):
    return ledger_tables.Ledger(spark, "l_" + uuid.uuid4().hex, f"file://{tmp_path}/ledger")


def sessions(spark, rows):
    return spark.createDataFrame(rows, "session_id string, session_date date, trade_count int")


def test_two_writes_of_a_session_leave_one_set_of_rows(spark, ledger):
    a, b, c = date(2026, 1, 1), date(2026, 1, 20), date(2026, 2, 3)
    ledger.write("sessions", sessions(spark, [("s1", a, 1), ("s2", a, 2), ("s3", c, 3)]))
    assert ledger.write("sessions", sessions(spark, [("s2", b, 9)])) == ["2026-W01", "2026-W04"]
    assert ledger.write("sessions", sessions(spark, [("s2", b, 9)])) == ["2026-W04"]
    got = {(r["session_id"], r["session_date"], r["trade_count"], r["hours"]) for r in ledger.read("sessions").collect()}
    assert got == {("s1", a, 1, None), ("s2", b, 9, None), ("s3", c, 3, None)}
    assert ledger.drop("sessions", sessions(spark, [("s1", None, None), ("s9", None, None)])) == ["2026-W01"]
    assert {r["session_id"] for r in ledger.read("sessions").collect()} == {"s2", "s3"}
    assert ledger.write("sessions", sessions(spark, [])) == []
    # Rows without an owner stay out; those without a day have a partition of their own.
    ledger.write("sessions", sessions(spark, [(None, a, 1), ("s4", None, 4)]))
    assert ledger.read("sessions").where("part = 'none'").count() == 1


def test_rows_may_come_from_the_table_itself(spark, ledger):
    ledger.write("experiments", spark.createDataFrame([("e1", "open"), ("e2", "open")], "id string, status string"))
    now = ledger.read("experiments")
    ledger.write("experiments", now.where("id = 'e1'").withColumn("status", F.lit("done")))
    assert {(r["id"], r["status"]) for r in ledger.read("experiments").collect()} == {("e1", "done"), ("e2", "open")}


def test_repeats_of_a_key_and_events_without_one(spark, ledger):
    rows = [("s", "R-A", "pass", "z"), ("s", "R-A", "pass", "b"), ("s", "R-A", "violated", "a"), ("s", None, "pass", None)]
    ledger.write("rule_checks", spark.createDataFrame(rows, "session_id string, rule string, status string, reason string"), order=[F.col("status").desc()])
    assert [tuple(r)[:4] for r in ledger.read("rule_checks").collect()] == [("s", "R-A", "violated", "a")]
    events = spark.createDataFrame([("s", 1.0, "tilt"), ("s", 1.0, "tilt"), ("t", 2.0, "break")], "session_id string, t double, kind string")
    for _ in range(2):
        ledger.write("events", events)
    assert ledger.read("events").count() == 3
    ledger.write("events", events.where("session_id = 'x'"), owners=events.where("session_id = 's'"))
    assert [r["session_id"] for r in ledger.read("events").collect()] == ["t"]


def test_a_column_comes_later(spark, ledger):
    spark.sql(f"CREATE TABLE {ledger.name('day_rollups')} (day date, trade_count int, part string) USING parquet PARTITIONED BY (part)")
    spark.createDataFrame([(date(2026, 1, 5), 4, "2026-W02")], "day date, trade_count int, part string").write.insertInto(ledger.name("day_rollups"))
    assert ledger.read("day_rollups").first()["trades_span_zero"] is None
    ledger.write("day_rollups", spark.createDataFrame([(date(2026, 1, 6), 5, 2)], "day date, trade_count int, trades_span_zero int"))
    assert {(r["day"].day, r["trade_count"], r["trades_span_zero"]) for r in ledger.read("day_rollups").collect()} == {(5, 4, None), (6, 5, 2)}
    spark.sql(f"CREATE TABLE {ledger.name('sessions')} (session_id int, part string) USING parquet PARTITIONED BY (part)")
    with pytest.raises(ValueError, match="session_id"):
        ledger.read("sessions")


def test_trades_of_any_form(spark):
    rows = [("s", None, "a", "9", "open"), ("s", "a", "q", "3", "closed"), ("s", "a", "q", "2", "closed"), ("s", "", "b", "1", "closed"), ("s", None, None, "1", "closed"), ("t", "a", None, None, None)]
    got = ledger_tables.trade_rows(spark.createDataFrame(rows, "session_id string, tva_trade_id string, trade_id string, entry_fill_id string, status string")).collect()
    assert {(r["session_id"], r["tva_trade_id"], r["entry_fill_id"], r["venue"], r["entry_price"]) for r in got} == {("s", "a", "2", None, None), ("t", "a", None, None, None)}
    price = spark.createDataFrame([("s", "x", "n/a"), ("s", "y", "1.5")], "session_id string, trade_id string, entry_price string")
    assert {r["entry_price"] for r in ledger_tables.trade_rows(price).collect()} == {None, 1.5}


def put(folder, name, what):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(what if isinstance(what, str) else json.dumps(what, indent=2), encoding="utf-8")


def test_session_documents(spark, tmp_path):
    recording = {"path": "r.mkv", "sha256": "x", "start_wallclock_vienna": "2026-01-01T10:00:00", "duration_s": 60.5, "parts": [{"path": "p", "sha256": "y", "duration_s": 30}]}
    put(tmp_path / "s 1", "session.json", {"id": "s 1", "recording": recording, "alignment": {"offset_s": 1, "drift_s_per_h": 0.5, "confidence": 0.9, "method": "ocr_clock"}, "more": 1})
    put(tmp_path / "s2", "session.json", {"id": "other", "recording": recording})
    put(tmp_path / "s3", "session.json", '{"id": "s3", ')
    put(tmp_path / "s4", "session.json", {"id": "s4", "recording": recording, "alignment": {"offset_s": 1, "drift_s_per_h": 0, "confidence": 1.5, "method": "manual"}})
    put(tmp_path / "s5", "session.json", {"id": "s5", "recording": recording})
    put(tmp_path / "s6", "session.json", {"id": "s6", "recording": {"path": "x"}})
    docs = session_files.read_documents(spark, f"{tmp_path}/*/session.json", "session")
    assert {r["session_id"]: r["problem"] for r in docs.collect()} == {"s 1": None, "s2": "another session's id", "s3": "not a document", "s4": "unknown alignment", "s5": None, "s6": "no recording"}
    one = session_files.usable(docs).where("session_id = 's 1'").first()
    assert (one["recording"]["parts"][0]["duration_s"], one["alignment"]["method"]) == (30.0, "ocr_clock")
    put(tmp_path / "s 1", "transcript.json", {"provider": "p", "model": "m", "segments": [{"id": "a", "t0": 0, "t1": 1, "text": "hallo", "words": [{"w": "hallo", "t0": 0, "t1": 1}]}, {"id": "b", "t0": 1, "t1": 2, "text": ""}]})
    put(tmp_path / "s2", "transcript.json", {"provider": "p", "segments": []})
    t = session_files.read_documents(spark, f"{tmp_path}/*/transcript.json", "transcript")
    assert [tuple(r) for r in session_files.segments(t).orderBy("i").collect()] == [("s 1", 0, "a", 0.0, 1.0, "de", "hallo", 1), ("s 1", 1, "b", 1.0, 2.0, "de", "", 0)]
    assert [tuple(r) for r in session_files.rejects(t).collect()] == [("s2", "no provider")]
    put(tmp_path / "s 1", "insights.json", {"provider": "p", "model": "m", "checkins": [{"seg": "a", "text": "x"}], "tilt_markers": [{"seg": "b", "text": "y", "token": "k"}], "session_events": [{"t": 1, "kind": "tilt", "seg": "a"}]})
    put(tmp_path / "s5", "insights.json", {"provider": "p", "model": "m", "session_events": [{"t": 1, "kind": "dance", "seg": "a"}]})
    i = session_files.read_documents(spark, f"{tmp_path}/*/insights.json", "insights")
    assert {(r["field"], r["seg"], r["token"]) for r in session_files.spans(i).collect()} == {("checkins", "a", None), ("tilt_markers", "b", "k")}
    assert [tuple(r) for r in session_files.events(i).collect()] == [("s 1", 1.0, "tilt", "a", "")]
    assert [tuple(r) for r in session_files.rejects(i).collect()] == [("s5", "unknown event")]


def test_lab_tables_and_gaps(spark, tmp_path):
    tables, gaps = session_files.read_lab(spark, str(tmp_path))
    assert {tuple(r) for r in gaps.collect()} == {("attribution", "missing"), ("zones", "missing"), ("triggers", "missing")}
    assert all(t.count() == 0 for t in tables.values()) and tables["zones"].schema["distance_ticks"].dataType.simpleString() == "double"
    spark.createDataFrame([("f", "t", "3", 1), ("f", " ", "x", 2)], "fill_id string, trade_id string, distance_ticks string, more int").write.parquet(f"{tmp_path}/journal_zones.parquet")
    tables, gaps = session_files.read_lab(spark, str(tmp_path))
    assert {tuple(r) for r in gaps.collect()} == {("attribution", "missing"), ("triggers", "missing"), ("zones", "no zone")}
    assert {(r["entry_fill_id"], r["trade_id"], r["distance_ticks"]) for r in tables["zones"].collect()} == {("f", "t", 3.0), ("f", None, None)}
    spark.createDataFrame([("first",)], "zone string").write.parquet(f"{tmp_path}/zones.parquet")
    assert session_files.read_lab(spark, str(tmp_path))[0]["zones"].first()["zone"] == "first"


def test_recordings_without_contents(spark, tmp_path, capsys):
    for name, size in (("a b.MKV", 10), ("big.mkv", 5000), ("note.txt", 3), (".hidden.mkv", 1), ("sub/c.mp4", 2), ("empty.mkv", 0)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    found = session_files.recordings(spark, str(tmp_path), [".mkv", ".mp4"], 100)
    got = {r["name"]: (r["size"], r["sha256"] is not None) for r in found.collect()}
    assert got == {"a b.MKV": (10, True), "big.mkv": (5000, False), "c.mp4": (2, True)}
    plain = session_files.recordings(spark, str(tmp_path), [".mkv"])
    plain.explain("formatted")
    assert "content" not in capsys.readouterr().out
    found.explain("formatted")
    assert "LessThan(length,100)" in capsys.readouterr().out.replace(" ", "")
    durations = spark.createDataFrame([("a b.MKV", "s", 1, 0, 10), ("big.mkv", "s", 2, 5_000_000, 10), ("gone.mkv", "s", 3, 0, 1)], "name string, session_id string, chain_no int, start_us long, duration_us long")
    hint = session_files.start_hints(found, durations).first()
    assert hint["path"].endswith("big.mkv") and not hint["verified"] and hint["pause_hint_us"] == found.where("name = 'big.mkv'").first()["modified_us"] - 5_000_010


def test_trades_contract(spark, tmp_path):
    rows = spark.createDataFrame([("t", date(2026, 1, 2), "3", 1)], "trade_id string, session_date date, qty string, more int")
    journal.write_trades(rows, str(tmp_path / "t"))
    back = journal.read_trades(spark, str(tmp_path / "t"))
    assert len(back.columns) == 40 and back.schema == journal.trades_schema()
    assert (back.first()["qty"], back.first()["tags"], back.first()["entry_price"]) == (3, [], None)
    assert len(journal.to_trades(rows, net=True).columns) == 42


def made_trades(spark):
    at = [datetime(2026, 1, 2, 10, m) for m in range(6)]
    rows = [("1", "long", 2, at[0], at[2], 10.0, 12.0, "f0", "f2", "closed"), ("1", "long", 1, at[0], at[3], 10.0, 11.0, "f0", "f3", "closed"), ("1", "short", 1, at[4], None, 9.0, None, "f4", None, "open")]
    return journal.to_trades(spark.createDataFrame(rows, "account string, direction string, qty long, entry_timestamp timestamp, exit_timestamp timestamp, entry_price double, exit_price double, entry_fill_id string, exit_fill_id string, status string"), net=True)


def test_fills_of_trades_pair_back(spark):
    t = made_trades(spark)
    fills = journal.whole_fills(journal.fills_of_trades(t, ["account"]), ["account"])
    assert {(r["fill_id"], r["side"], r["qty"]) for r in fills.collect()} == {("f0", "buy", 3), ("f2", "sell", 2), ("f3", "sell", 1), ("f4", "sell", 1)}
    ready = fills.select("account", "fill_id", "side", "qty", F.unix_micros("timestamp").alias("ts_us"), F.col("price").cast("long").alias("price_ticks"))
    key = lambda df: sorted((r["direction"], r["qty"], r["entry_fill_id"], r["exit_fill_id"] or "") for r in df.collect())
    assert key(pairing.fifo_lots(ready, ["account"])) == key(t)


def test_journals_with_problems(spark, tmp_path):
    good = made_trades(spark).drop("account").withColumn("commission_cost", F.lit(1.0))
    cases = {"ok": (good, ["A"]), "two": (good, ["A", "B"]), "none": (good, []), "free": (good.withColumn("commission_cost", F.lit(None).cast("double")), ["A"]), "ids": (good.withColumn("trade_id", F.lit("tx:Z:1")), [])}
    for name, (trades, accounts) in cases.items():
        trades.write.parquet(f"{tmp_path}/{name}/journal_trades.parquet")
        spark.createDataFrame([(a,) for a in accounts], "account string").write.parquet(f"{tmp_path}/{name}/journal_lot_sources.parquet")
    rows, problems = journal.read_journal(spark, f"{tmp_path}/*")
    assert {tuple(r) for r in problems.collect()} == {("two", "several accounts", 3), ("none", "no account", 3), ("free", "no source of costs", 2)}
    assert {(r["journal"], r["account"]) for r in rows.collect()} == {("ok", "A"), ("ids", "Z")}
    assert {tuple(r) for r in journal.read_journal(spark, f"{tmp_path}/ok*", "B")[1].collect()} == {("ok", "another account than requested", 3)}


def test_sequential_lots_equal_the_sweep(spark):
    rows = [(a, i, n, "buy" if (n * 7 + a) % 3 else "sell", 1 + (n * 5 + a) % 4, 1000 + n // 2, 5) for a in (1, 2) for i in ("MES", "MNQ") for n in range(60)]
    fills = spark.createDataFrame(rows, "account long, instrument string, fill_id long, side string, qty long, ts_us long, price_ticks long")
    fills.createOrReplaceTempView("fills_to_pair")
    sequential.register(spark)
    got = spark.sql("SELECT account, instrument, status, direction, qty, entry_fill_id, exit_fill_id FROM sequential_lots(TABLE(fills_to_pair) PARTITION BY (account, instrument) ORDER BY (ts_us, fill_id))")
    want = pairing.fifo_lots(fills, ["account", "instrument"]).select(got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and want.count() > 150


def test_whole_scorecards(spark):
    s = spark.createDataFrame([("a", date(2026, 1, 2), True, True, False), ("b", date(2026, 1, 2), False, False, True), ("c", None, False, True, False)], "session_id string, day date, of_day boolean, has_evidence boolean, invalid boolean")
    checks = spark.createDataFrame([("a", "R-DLL", "violated", "x"), ("a", "R-ZONE", "pass", None), ("b", "R-DLL", "violated", "x"), ("b", "R-DLL", "pass", None), ("c", "R-OTHER", "pass", None), ("c", "R-BIAS", "violated", "no bias")], "session_id string, rule string, status string, reason string")
    events = spark.createDataFrame([("b", "bias_statement")], "session_id string, kind string")
    got = {(r["session_id"], r["rule"]): (r["place"], r["status"], r["reason"]) for r in whole_scorecards(s, [checks], events).collect()}
    assert len(got) == 45 and all(got[x, r][0] == i + 1 for x in "abc" for i, r in enumerate(RULES))
    assert got["a", "R-DLL"][1:] == ("unverifiable", "evaluated on day 2026-01-02") and got["a", "R-ZONE"][1:] == ("pass", None) and got["a", "R-CLOSE"][1:] == ("pass", None)
    assert got["b", "R-DLL"][1:] == ("violated", "x") and got["b", "R-ZONE"][1:] == ("unverifiable", "alignment_invalid") and got["b", "R-BIAS"][1:] == ("pass", None) and got["b", "R-PLAYBOOK"][1:] == ("unverifiable", "evidence_pending")
    assert got["c", "R-BIAS"][1:] == ("violated", "no bias") and got["c", "R-DEFINED"][1:] == ("unverifiable", "evidence_pending")


def test_whole_scorecards_of_arrays(spark):
    """Checks as one array for each session count as they do as rows, several of one rule too."""
    from pyspark.sql import functions as F

    s = spark.sql("select * from values ('a', date'2026-01-02', false, true, false), ('b', date'2026-01-02', true, false, true), ('c', null, false, true, false) v(session_id, day, of_day, has_evidence, invalid)")
    rows = [("a", "R-ZONE", "pass", None), ("a", "R-ZONE", "violated", "z"), ("a", "R-ZONE", "violated", "y"), ("a", "R-DLL", "violated", "d"), ("b", "R-CLOSE", "unverifiable", "u"), ("b", "R-TILT", "pass", None), ("a", "R-OTHER", "pass", None)]
    checks = spark.createDataFrame(rows, "session_id string, rule string, status string, reason string")
    events = spark.sql("select 'b' as session_id, 'bias_statement' as kind")
    arrays = checks.groupBy("session_id").agg(F.collect_list(F.struct("rule", "status", "reason")).alias("checks"))
    both = [sorted(map(str, whole_scorecards(s, c, events).collect())) for c in ([checks], [arrays], [arrays.where("session_id = 'a'"), checks.where("session_id = 'b'")])]
    assert both[0] == both[1] == both[2] and len(both[0]) == 45
    zone = whole_scorecards(s, [arrays], events).where("session_id = 'a' and rule = 'R-ZONE'").first()
    assert (zone["place"], zone["status"], zone["reason"]) == (13, "violated", "y")


def test_all_checks_equal_single_rules(spark):
    """All rules counted in one pass give what each gives alone: sessions without events, without trades, with either and both."""
    from pyspark.sql import functions as F

    from sessionlens.operators import speech

    sessions = spark.sql("select concat('s', id) as session_id, 7200000000L as start_us from range(12)")
    kinds = "element_at(array('hourly_checkin', 'tilt', 'no_trade_zone', 'bias_statement', null), cast(id % 5 + 1 as int))"
    events = spark.sql(f"select concat('s', id % 9) as session_id, id % 7 * 450000000L as t_us, {kinds} as kind from range(40) where id % 9 <> 4")
    text = "element_at(array('a 3c', 'no 3c, counter-trend', 'arrival', null), cast(id % 4 + 1 as int))"
    trades = spark.sql(f"select concat('s', id % 11) as session_id, id as trade_id, id % 5 * 460000000L as entry_us, id % 6 <> 0 as has_speech, if(id % 3 = 0, 'p', null) as playbook, if(id % 4 = 0, 's', null) as setup, if(id % 2 = 0, 'x', null) as stop, if(id % 7 > 0, 'y', null) as target, {text} as text from range(50) where id % 11 <> 3")
    alone = [speech.playbook(sessions, trades), speech.defined(sessions, trades), speech.three_c(sessions, trades), speech.arrival(sessions, trades), speech.order_changes(sessions), speech.hourly(sessions, events), speech.no_trade_zone(sessions, trades, events), speech.bias(sessions, events), speech.tilt(sessions, trades, events)]
    want = sorted(map(str, speech.scorecard(sessions, alone).collect()))
    got = speech.all_checks(sessions, trades, trades, events).select("session_id", F.explode("checks").alias("c")).select("session_id", "c.*")
    assert sorted(map(str, got.collect())) == want and len(want) == 12 * 9
