"""Source rules, contracts and round trips."""

import json

import pytest
from pyspark.sql import functions as F

from sessionlens.operators import text
from sessionlens.sources import documents, executions

ROW = {"date": "2026-05-17T22:05:00Z", "symbol": "MNQM26", "side": "buy", "currency": "USD", "underlying": "", "asset_type": "future", "price": "1.25", "quantity": "2", "commission": "nan", "fees": "", "stop_loss": "", "profit_target": "", "tags": "", "notes": "", "spread_id": ""}


def rows(spark, *changes):
    data = [(i, *({**ROW, **c}[k] for k in executions.COLUMNS)) for i, c in enumerate(changes)]
    return spark.createDataFrame(data, "row_no long, " + ", ".join(f"`{c}` string" for c in executions.COLUMNS))


def test_header_rules():
    executions.check_header(list(executions.COLUMNS))
    for bad in ([*executions.COLUMNS, "date"], [*executions.COLUMNS, " "], list(executions.COLUMNS[1:])):
        with pytest.raises(ValueError):
            executions.check_header(bad)


def test_csv_round_trip_with_byte_order_mark(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("﻿" + ",".join(executions.COLUMNS) + "\n" + ",".join(ROW[c] for c in executions.COLUMNS) + "\n", encoding="utf-8")
    df = executions.read_csv(spark, str(p))
    assert df.columns == list(executions.COLUMNS) and df.first()["symbol"] == "MNQM26"


def test_validation_and_session_roll(spark):
    v = executions.validate(rows(spark, {}, {"date": "2026-05-17 22:05:00"}, {"symbol": "ABC"}, {"quantity": "0"}, {"quantity": "0", "asset_type": "stock"}, {"price": "-1"}, {"side": None}, {"date": "2026-05-17T23:59:59.5+02:00"}))
    got = {r["row_no"]: r for r in v.collect()}
    assert [got[i]["reject_reason"] for i in range(8)] == [None, "date", "symbol", "quantity", None, "price", "side", None]
    assert str(got[0]["session_date"]) == "2026-05-18" and got[0]["contract_month"] == "M" and got[0]["contract_year"] == 2026
    assert got[7]["ts_us"] == 1779055199500000
    with pytest.raises(Exception, match="row 1: date"):
        executions.split_rejects(executions.validate(rows(spark, {}, {"date": ""})), fail=True)[0].collect()


def test_notes_venue_tags(spark):
    df = spark.createDataFrame([("<p>A&nbsp;&amp; B</p> <img src='x'>", "My-TopstepX_2026.csv", " a, ,b")], "n string, f string, t string")
    got = df.select(executions.plain_note(F.col("n")), executions.venue_of(F.col("f")), executions.tag_list(F.col("t"))).first()
    assert tuple(got) == ("A & B [image]", "topstepx", ["a", "b"])


def test_forbidden_columns_and_contract(spark, tmp_path):
    df = executions.with_ids(executions.validate(rows(spark, {}))).drop("reject_reason")
    with pytest.raises(ValueError):
        executions.write_fills(df, str(tmp_path / "a"))
    out = df.drop("commission", "fees")
    executions.write_fills(out, str(tmp_path / "b"))
    back = executions.read_fills(spark, str(tmp_path / "b"))
    assert back.select(sorted(out.columns)).collect() == out.select(sorted(out.columns)).collect()
    assert executions.to_contract(df).columns == list(executions.CONTRACT)


def test_utterances_fall_back_to_the_first_channel(spark):
    a = {"metadata": {"duration": 9.0}, "results": {"utterances": [{"transcript": "hi", "start": 1.0, "end": 2.0}, {"transcript": " ", "start": 2.0, "end": 3.0}]}}
    b = {"metadata": {"duration": 9.0}, "results": {"channels": [{"alternatives": [{"transcript": "whole"}]}]}}
    df = spark.createDataFrame([("a", json.dumps(a)), ("b", json.dumps(b)), ("c", "no json"), ("d", None)], "session_id string, json string")
    got = {r["session_id"]: (r["seg"], r["text"], r["t0"], r["t1"]) for r in documents.utterance_segments(df).collect()}
    assert got == {"a": ("seg_000", "hi", 1.0, 2.0), "b": ("seg_000", "whole", 0.0, 9.0)}
    cost = spark.range(1).select(documents.audio_cost(F.lit(3600.0), F.lit(-1.0)), documents.audio_cost(F.lit(1800.0), F.lit(1.0))).first()
    assert tuple(cost) == (0.29, 0.5)


def test_german_normalisation_and_citations(spark):
    df = spark.createDataFrame([("Prüfen, Straße!",)], "t string")
    assert df.select(text.normalize_german(F.col("t"))).first()[0] == "prüfen strasse"
    assert df.select(text.normalize_german(F.col("t"), True)).first()[0] == "pruefen strasse"
    segs = spark.createDataFrame([("s", "seg_1", "Prüfen wir")], "session_id string, seg string, text string")
    spans = spark.createDataFrame([("s", "seg_1", "Prüfen", None), ("s", "seg_1", "nein", None), ("s", "seg_9", "Prüfen", None)], "session_id string, seg string, quote string, token string")
    checked = text.check_citations(spans, segs)
    assert [r["ok"] for r in checked.orderBy("seg", "quote").collect()] == [True, False, False]
    kept, gaps = text.guard(checked)
    assert kept.count() == 1 and gaps.count() == 2


def test_word_errors_edges(spark):
    df = spark.createDataFrame([([], []), ([], ["a"]), (["a", "b", "c", "d"], ["a", "x", "c"])], "ref array<string>, hyp array<string>")
    assert [(r["edits"], r["wer"]) for r in text.word_errors(df).collect()] == [(0, 0.0), (1, 1.0), (2, 0.5)]


def test_longest_tag_wins(spark):
    df = spark.createDataFrame([(1, "pONH ITR-C ITR x_ITR")], "id long, text string")
    assert {r["tag"]: r["n"] for r in text.tag_hits(df, ["ONH", "pONH", "ITR", "ITR-C"]).collect()} == {"pONH": 1, "ITR-C": 1, "ITR": 1}


def test_labelled_values(spark):
    df = spark.createDataFrame([(1, 2, "Bias: short"), (1, 1, " bias :  long "), (1, 3, "Other: x"), (1, 4, "Plan:")], "page_id long, line_no long, line string")
    assert [tuple(r) for r in text.labelled_values(df, {"bias": "bias", "plan": "plan"}).collect()] == [(1, "bias", "long")]
