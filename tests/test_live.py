"""Streams over several micro-batches against batch results."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from sessionlens.operators import pairing, rules
from sessionlens.streaming import live, rule_blocks

MINUTE = 60_000_000
KEYS = ["account", "day"]
CONFIG = rules.RuleConfig(streak=2)


def trades(seed, n=70):
    """Trades of two accounts that overlap, tie, stay open and have unknown results."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        entry = r.randrange(0, 200) * MINUTE
        hold = r.choice([0, 1, 1, 2, 3, 10, 40]) * MINUTE // r.choice([1, 2])
        closed = r.random() < 0.9
        pnl = r.choice([-5.0, -1.0, -1.0, 2.0, None])
        rows.append((r.choice([1, 2]), date(2026, 1, r.choice([5, 6])), f"t{i:02}", r.choice(["MES", "MNQ"]), r.choice(["long", "short"]), "closed" if closed else "open", entry, entry + hold if closed else None, r.choice([10, 11, 30, None]), pnl, hold if closed else None))
    return rows


SCHEMA = "account long, day date, trade_id string, instrument string, direction string, status string, entry_us long, exit_us long, entry_ticks long, net_pnl double, hold_us long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({"gross_pnl": F.col("net_pnl"), "stop_ticks": F.lit(None).cast("long"), "exit_ticks": F.lit(None).cast("long"), "pnl": F.col("net_pnl")})


def batch(t):
    """What the batch rules say, and the ends of the union of blocks."""
    want = {(r["account"], r["day"], "streak", r["trade_id"], r["next_trade_id"], r["gap_us"], r["streak"]) for r in rules.streak_breaches(t, KEYS, CONFIG).collect()}
    want |= {(r["account"], r["day"], "post_loss", r["trade_id"], r["next_trade_id"], r["gap_us"], None) for r in rules.post_loss_breaches(t, KEYS, CONFIG).collect()}
    ends = {}
    for r in t.where("exit_us is not null and net_pnl < 0").collect():
        ends.setdefault((r["account"], r["day"]), []).append(r["exit_us"])
    for key, at in ends.items():
        at.sort()
        for a, b in zip(at, at[1:] + [None]):
            if b is None or b >= a + 5 * MINUTE:
                want.add((*key, "block_end", a + 5 * MINUTE, None, None, None))
    return want


@pytest.mark.parametrize("seed", range(6))
def test_day_takes_events_in_any_batches(spark, seed):
    """The state machine alone, cut at random places."""
    t = frame(spark, trades(seed))
    events = rule_blocks.trade_events(t, KEYS, rules.stopped_on_entry(CONFIG)).collect()
    got = set()
    r = random.Random(seed)
    for key in {(e["account"], e["day"]) for e in events}:
        mine = sorted((rule_blocks.Trade(*(e[f] for f in rule_blocks.FIELDS)) for e in events if (e["account"], e["day"]) == key), key=lambda x: x.order)
        day = rule_blocks.Day(CONFIG)
        for e in mine:
            if r.random() < 0.3:
                day.until(e.ts_us)
            day.take(e)
        day.turn(settle=True)
        day.until(10**15)
        got |= {(*key, o[0], o[5], None, None, None) if o[0] == "block_end" else (*key, *o[:5]) for o in day.out}
    assert got == batch(t)


def test_rule_blocks_over_micro_batches(spark):
    t = frame(spark, trades(3))
    events = rule_blocks.trade_events(t, KEYS, rules.stopped_on_entry(CONFIG))
    # Out of order within 20 minutes: an event comes up to two slices late.
    late = F.col("ts_us") + F.pmod(F.xxhash64("trade_id", "kind"), F.lit(20)) * MINUTE
    feed = [events.where((late >= lo * MINUTE) & (late < (lo + 60) * MINUTE)) for lo in range(0, 300, 60)]
    clock = events.limit(1).withColumns({"account": F.lit(9).cast("long"), "kind": F.lit("clock"), "ts_us": F.lit(10**15).cast("long"), "ts": F.timestamp_micros(F.lit(10**15))}).select(events.columns)
    out = live.replay(spark, {"e": [*feed, clock]}, lambda s: rule_blocks.rule_blocks(s["e"], KEYS, CONFIG, "90 minutes"))
    rows = out.where("account < 9").collect()
    got = [(r["account"], r["day"], r["kind"], *((r["at_us"], None, None, None) if r["kind"] == "block_end" else (r["trade_id"], r["next_trade_id"], r["gap_us"], r["streak"]))) for r in rows]
    assert len(got) == len(set(got)) and set(got) == batch(t)


def test_settled_days_leave_no_state(spark, tmp_path):
    t = frame(spark, trades(1, 20))
    events = rule_blocks.trade_events(t, KEYS, rules.stopped_on_entry(CONFIG))
    src, check = f"{tmp_path}/src", f"{tmp_path}/check"
    spark.conf.set(*live.ROCKS)
    try:
        for at in (0, 1):
            more = events if at == 0 else events.limit(1).withColumns({"account": F.lit(9).cast("long"), "ts_us": F.lit(10**15).cast("long"), "ts": F.timestamp_micros(F.lit(10**15))}).select(events.columns)
            more.write.mode("append").parquet(src)
            s = rule_blocks.rule_blocks(live.watch(spark, src, events.schema), KEYS, CONFIG)
            s.writeStream.format("noop").option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        held = spark.read.format("statestore").option("stateVarName", "status").load(check)
        assert {r["key"][0] for r in held.collect()} == {9}
    finally:
        spark.conf.unset(live.ROCKS[0])


def test_join_of_two_streams_drops_what_is_too_late(spark):
    fill = "fill_id long, user_id long, ts timestamp"
    part = "session_id string, user_id long, from_ts timestamp, to_ts timestamp"

    def fills(rows):
        return spark.createDataFrame([(i, u, m) for i, u, m in rows], "fill_id long, user_id long, m long").select("fill_id", "user_id", F.timestamp_micros(F.col("m") * MINUTE).alias("ts")) if rows else spark.createDataFrame([], fill)

    def parts(rows):
        return spark.createDataFrame(rows, "session_id string, user_id long, a long, b long").select("session_id", "user_id", F.timestamp_micros(F.col("a") * MINUTE).alias("from_ts"), F.timestamp_micros(F.col("b") * MINUTE).alias("to_ts")) if rows else spark.createDataFrame([], part)

    feeds = {
        "f": [fills([(1, 1, 100), (2, 1, 159), (3, 2, 130)]), fills([(4, 1, 160), (5, 1, 600), (9, None, 150)]), fills([(6, 1, 2000), (7, 2, 140)]), fills([(8, 1, 101)])],
        "p": [parts([("s", 1, 100, 160)]), parts([("t", 1, 600, 700), ("u", 2, 90, 131)]), parts([("v", 1, 1990, 2010), ("w", 3, 1, 2)]), parts([("x", 1, 100, 160)])],
    }
    out = live.replay(spark, feeds, lambda s: live.fills_of_parts(s["f"], s["p"], "user_id", late="30 minutes", longest="6 hours"))
    got = sorted((r["fill_id"], r["session_id"]) for r in out.collect())
    # Fill 8 and part x come when the watermark is far past them; all others are joined as in batch.
    assert got == [(1, "s"), (2, "s"), (3, "u"), (5, "t"), (6, "v")]


def test_parts_tile_the_padded_window(spark):
    c = spark.createDataFrame([("a", 0, 0), ("b", 0, 1000), ("c", 10, 5)], "session_id string, s long, e long").select("session_id", F.timestamp_micros(F.col("s") * MINUTE).alias("start_ts"), F.timestamp_micros(F.col("e") * MINUTE).alias("end_ts"))
    got = {}
    for r in live.clip_parts(c).select("session_id", F.unix_micros("from_ts").alias("a"), F.unix_micros("to_ts").alias("b")).orderBy("session_id", "a").collect():
        got.setdefault(r["session_id"], []).append((r["a"], r["b"]))
    assert got["a"] == [(-30 * MINUTE, 30 * MINUTE + 1)]
    assert got["b"][0][0] == -30 * MINUTE and got["b"][-1][1] == 1030 * MINUTE + 1 and all(x[1] == y[0] and x[1] - x[0] <= 360 * MINUTE for x, y in zip(got["b"], got["b"][1:]))
    assert "c" not in got


def test_fifo_of_rows_that_come_out_of_order(spark):
    """Rows up to 40 minutes late, in five batches; those of a key wait until the watermark has passed them."""
    r = random.Random(6)
    rows = [(k, i, r.randrange(1, 300) * MINUTE, r.choice(["buy", "sell"]), r.randint(1, 4)) for i in range(150) for k in [r.choice([1, 2, None])]]
    fills = spark.createDataFrame(rows, "account long, row_id long, ts_us long, side string, qty long").withColumn("ts", F.timestamp_micros("ts_us"))
    comes = F.col("ts_us") + F.pmod(F.xxhash64("row_id"), F.lit(40)) * MINUTE
    feed = [fills.where((comes >= lo * MINUTE) & (comes < (lo + 80) * MINUTE)) for lo in range(0, 400, 80)]
    clock = fills.limit(1).withColumns({"account": F.lit(9).cast("long"), "ts_us": F.lit(10**15).cast("long"), "ts": F.timestamp_micros(F.lit(10**15))}).select(fills.columns)
    out = live.replay(spark, {"f": [*feed, clock]}, lambda s: live.fifo(s["f"], ["account"], "2 hours")).where("account is null or account < 9")
    got = sorted((x["account"] or 0, x["lot_seq"], x["qty"], x["entry_fill_id"], x["exit_fill_id"]) for x in out.collect())
    lots = pairing.fifo_lots(fills.withColumns({"fill_id": F.col("row_id"), "price_ticks": F.lit(1)}), ["account"]).where("status = 'closed'")
    want = sorted((x["account"] or 0, x["lot_seq"], x["qty"], x["entry_fill_id"], x["exit_fill_id"]) for x in lots.collect())
    assert got == want and len(want) > 60


def test_steps_keep_their_state_between_calls():
    rows = [(t, t, "pause" if t % 3 == 2 else "resume") for t in range(1, 12)]
    whole = live.section_step((1,), rows, [], None)[0]
    first = live.section_step((1,), rows[:4], [], None)
    assert first[0] + live.section_step((1,), rows[4:], [], first[2])[0] == whole
    losses = [(t, t, p) for t, p in enumerate([-1.0, -1.0, -1.0, None, -1.0, -2.0, -1.0, -1.0, 3.0])]
    whole = live.streak_step((1,), losses, [], None)
    assert whole[0] == [(1, 2, 3), (1, 6, 3), (1, 7, 4)]
    first = live.streak_step((1,), losses[:2], [], None)
    assert first[0] + live.streak_step((1,), losses[2:], [], first[2])[0] == whole[0]


def test_a_day_of_many_open_trades_ends():
    """Trades that all stay open until the end, and one that is never closed: each event once had to pass all of them."""
    import time

    n, day = 20_000, rule_blocks.Day(CONFIG)
    began = time.time()
    for i in range(n):
        day.take(rule_blocks.Trade(i, "entry", f"t{i:06}", i, "MES", "long", 1, -1.0, False))
    for i in range(1, n):
        day.take(rule_blocks.Trade(n + i, "exit", f"t{i:06}", i, "MES", "long", 1, -1.0, False))
    day.turn(settle=True)
    assert time.time() - began < 20 and day.run == n - 1 and not day.trades


def test_rows_of_many_keys_in_order(spark):
    """Far more keys than buckets, a null one too: each key's rows are taken alone and in time order, over several batches."""
    r = random.Random(2)
    rows = [(k if k else None, i, r.randrange(1, 300) * MINUTE + i, r.choice([-1.0, -1.0, -1.0, 1.0, None])) for i in range(900) for k in [r.randrange(40)]]
    e = spark.createDataFrame(rows, "user_id long, row_id long, ts_us long, pnl double").withColumn("ts", F.timestamp_micros("ts_us"))
    feed = [e.where((F.col("ts_us") >= lo * MINUTE) & (F.col("ts_us") < (lo + 100) * MINUTE)) for lo in range(0, 400, 100)]
    clock = e.limit(1).withColumns({"user_id": F.lit(99).cast("long"), "ts_us": F.lit(10**15).cast("long"), "ts": F.timestamp_micros(F.lit(10**15))}).select(e.columns)
    out = live.replay(spark, {"e": [*feed, clock]}, lambda s: live.in_order(s["e"], ["user_id"], "pnl double", live.streak_step, "row_id long, streak long", "none long", "run long", buckets=3))
    want = []
    for k in {x[0] for x in rows}:
        mine = sorted((t, i, p) for u, i, t, p in rows if u == k)
        want += live.streak_step((k,), mine, [], None)[0]
    assert sorted(map(str, want)) == sorted(str(tuple(x)) for x in out.collect()) and len(want) > 100
