"""First in, first out against a sequential queue on random fills, and boundary tables of the rules."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from sessionlens.operators import gates, intervals, pairing, rules

FILL = "fill_id long, g string, side string, qty long, price_ticks long, ts_us long"


def queue(fills):
    """(entry, exit, qty) of closed lots, then open ones with None."""
    opens, out = deque(), []
    for f in fills:
        left = f[3]
        while left:
            if not opens or opens[0][0][2] == f[2]:
                opens.append([f, left])
                break
            take = min(opens[0][1], left)
            out.append((opens[0][0][0], f[0], take))
            opens[0][1] -= take
            left -= take
            if not opens[0][1]:
                opens.popleft()
    return out + [(f[0], None, n) for f, n in opens]


def test_lots_equal_a_queue(spark):
    r = random.Random(11)
    rows = [(i, f"g{r.randrange(12)}" if r.random() < 0.95 else None, r.choice(["buy", "sell"]), r.randrange(1, 5), r.randrange(100), r.randrange(40)) for i in range(400)]
    got = {}
    for x in pairing.fifo_lots(spark.createDataFrame(rows, FILL), ["g"]).orderBy("g", "lot_seq").collect():
        got.setdefault(x["g"], []).append((x["entry_fill_id"], x["exit_fill_id"], x["qty"]))
    for g in {x[1] for x in rows}:
        assert got[g] == queue(sorted((x for x in rows if x[1] == g), key=lambda x: (x[5], x[0])))


def test_lots_leave_out_unusable_fills(spark):
    rows = [(1, "a", "buy", None, 1, 1), (2, "a", "hold", 1, 1, 1), (3, "a", "buy", 0, 1, 1), (4, "a", "buy", 2, 1, None), (None, "a", "buy", 1, 1, 1), (5, "a", "buy", 1, 1, 9)]
    assert [(x["entry_fill_id"], x["status"]) for x in pairing.fifo_lots(spark.createDataFrame(rows, FILL), ["g"]).collect()] == [(5, "open")]
    assert pairing.fifo_lots(spark.createDataFrame([], FILL), ["g"]).count() == 0


TRADE = "account long, day long, trade_id string, instrument string, direction string, status string, entry_us long, exit_us long, entry_ticks long, exit_ticks long, net_pnl long, gross_pnl long, hold_us long, stop_ticks long"
S = 1_000_000


def trade(i, entry, exit_, pnl, px=100, gross=None):
    return (1, 1, f"T{i:02d}", "MNQ", "long", "closed" if exit_ is not None else "open", entry * S, None if exit_ is None else exit_ * S, px, px, pnl, pnl if gross is None else gross, None if exit_ is None else (exit_ - entry) * S, None)


def status(df):
    return df.first()["status"]


@pytest.mark.parametrize("total,want", [(-401, "violated"), (-400, "pass"), (0, "pass")])
def test_daily_loss_boundary(spark, total, want):
    t = spark.createDataFrame([trade(1, 0, 10, total)], TRADE)
    assert status(rules.daily_loss(t, ["account", "day"], rules.RuleConfig(loss_limit=400))) == want
    assert status(rules.daily_loss(t, ["account", "day"], rules.RuleConfig())) == "unverifiable"


@pytest.mark.parametrize("gap,want", [(29 * 60 + 59, "violated"), (30 * 60, "pass")])
def test_streak_boundary(spark, gap, want):
    t = [trade(i, i * 100, i * 100 + 50, -1) for i in range(3)] + [trade(9, 250 + gap, None, None)]
    assert status(rules.loss_streak(spark.createDataFrame(t, TRADE), ["account", "day"], rules.RuleConfig())) == want


def test_unknown_result_ends_a_streak(spark):
    t = [trade(0, 0, 10, -1), trade(1, 20, 30, -1), trade(2, 40, 50, None), trade(3, 60, 70, -1), trade(4, 80, 90, 5)]
    assert status(rules.loss_streak(spark.createDataFrame(t, TRADE), ["account", "day"], rules.RuleConfig())) == "pass"


@pytest.mark.parametrize("gap,px,want", [(119, 102, "pass"), (119, 103, "violated"), (121, 100, "violated"), (300, 100, "pass")])
def test_post_loss_block_and_exemption(spark, gap, px, want):
    t = [trade(0, 0, 60, -1), trade(1, 60 + gap, 1000 + gap, 5, px)]
    assert status(rules.post_loss(spark.createDataFrame(t, TRADE), ["account", "day"], rules.RuleConfig())) == want


@pytest.mark.parametrize("n,last_gap,want", [(2, 300, "pass"), (3, 300, "violated"), (2, 299, "violated")])
def test_reentry_cluster(spark, n, last_gap, want):
    t = [trade(i, i * 100, i * 100 + 30, -1) for i in range(n)]
    t.append(trade(8, (n - 1) * 100 + 30 + last_gap, None, None))
    assert status(rules.reentry(spark.createDataFrame(t, TRADE), ["account", "day"], rules.RuleConfig())) == want


def test_next_by_time_skips_itself(spark):
    rows = [(1, 1, "a", 0, 0), (1, 1, "b", 0, 5), (1, 1, "c", 5, None), (2, 1, "d", 3, 3)]
    df = spark.createDataFrame(rows, "account long, day long, id string, e long, x long")
    got = {r["id"]: r["next_id"] for r in intervals.next_by_time(df, ["account", "day"], "x", "e", "id", []).collect()}
    assert got == {"a": "b", "b": "c", "c": None, "d": None}


def test_assign_once_prefers_core_then_nearest(spark):
    clips = spark.createDataFrame([(1, "a", 0, 100 * S), (1, "b", 100 * S, 200 * S), (1, "c", 3000 * S, 3100 * S)], "u long, session_id string, start_us long, end_us long")
    fills = spark.createDataFrame([(1, 1, 100 * S), (2, 1, 150 * S), (3, 1, 1500 * S), (4, 1, 9000 * S), (5, 2, 0), (6, 1, 1700 * S)], "fill_id long, u long, ts_us long")
    got = {r["fill_id"]: (r["session_id"], r["in_core"]) for r in intervals.assign_once(fills, clips, ["u"]).collect()}
    assert got == {1: ("a", True), 2: ("b", True), 3: ("b", False), 6: ("c", False)}


def test_union_length_merges_touching_spans(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 10, 20), (1, 5, 8), (1, 30, 31), (2, 0, 0)], "k long, start_us long, end_us long")
    assert {r["k"]: r["union_us"] for r in intervals.union_length(df, ["k"]).collect()} == {1: 21, 2: 0}


def test_intents_merge_in_fill_order(spark):
    rows = [("g", 2, 2, ["b", "a"], "", None, 5.0), ("g", 1, 1, ["a"], "", None, None), ("g", 3, 3, [], "note", 1.0, 6.0)]
    got = pairing.merge_intent(spark.createDataFrame(rows, "g string, fill_id long, ts_us long, tags array<string>, notes string, stop double, target double"), ["g"]).first()
    assert (got["tags"], got["notes"], got["stop"], got["target"]) == (["a", "b"], "note", 1.0, 5.0)


def test_mixed_groups_are_found(spark):
    df = spark.createDataFrame([("a", "MNQ"), ("a", "MES"), ("b", "MNQ"), (None, "MES")], "source_group_id string, instrument string")
    assert [r[0] for r in pairing.mixed_groups(df).collect()] == ["a"]


def test_same_key_for_policies(spark):
    t = spark.createDataFrame([("x", "closed", 100, 7), ("y", "open", None, None)], "trade_id string, status string, gross_cents long, cost_cents long")
    got = {r["trade_id"]: (r["cost_cents"], r["net_cents"]) for r in pairing.gross_only(t).collect()}
    assert got == {"x": (None, 100), "y": (None, None)}
    assert pairing.without_costs(t.withColumn("cost_cents", F.lit(None).cast("long"))).count() == 1


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_frames_grow_row_by_row(spark):
    """A frame from a row to the end of its group is read anew for each row, so its time is quadratic."""
    fills = spark.createDataFrame([], FILL)
    trades = spark.createDataFrame([], "k long, id string, e long, x long, y long")
    for df in (pairing.fifo_lots(fills, ["g"]), intervals.next_by_time(trades, ["k"], "x", "e", "id", ["y"]), gates.drop_outliers(trades, ["k"], "e", "y", 1, "id")):
        assert "currentrow$(), unboundedfollowing$()" not in plan(df) and "1, unboundedfollowing$()" not in plan(df)


def test_outliers_at_both_ends(spark):
    rows = [(1, "a", 0, 0, 90), (1, "b", 1, 0, 10), (1, "c", 2, 0, 11), (1, "d", 3, 0, 12), (1, "e", 4, 0, 2), (2, "f", 0, 0, 5)]
    df = spark.createDataFrame(rows, "k long, id string, e long, x long, y long")
    assert sorted(r["id"] for r in gates.drop_outliers(df, ["k"], "e", "y", 1, "id").collect()) == ["b", "c", "d", "f"]


@pytest.mark.parametrize("near,within", [(0, 20), (2, 15), (3, 1000), (40, 30)])
def test_next_at_a_level_equals_all_pairs(spark, near, within):
    r = random.Random(near)
    rows = []
    for i in range(160):
        entry = r.randrange(60)
        leave = None if i % 9 == 0 else entry + r.choice([0, 0, 1, 5, 12, -2])
        rows.append(trade(i, 0, 1, -1)[:2] + (f"T{i}", None if i % 31 == 0 else r.choice("ab"), r.choice("ls"), "closed", entry * S, None if leave is None else leave * S, None if i % 23 == 0 else r.randrange(-130, 60), 0, -1, -1, None, None))
    want = {}
    for a in rows:
        met = [(b[6], b[2], b[6] - a[7]) for b in rows if a[7] is not None and None not in (a[8], b[8], a[3], b[3]) and a[3:5] == b[3:5] and abs(a[8] - b[8]) <= near and b[6] >= a[7] and b[6] - a[7] <= within * S and (b[6], b[2]) > (a[6], a[2])]
        if met:
            want[a[2]] = min(met)[1:]
    config = rules.RuleConfig(same_level_ticks=near)
    found = rules.next_same_level(spark.createDataFrame(rows, TRADE), ["account", "day"], config, within * S)
    assert {x["trade_id"]: (x["next_trade_id"], x["gap_us"]) for x in found.collect()} == want
    assert "Join" not in plan(found)  # a join meets all pairs of a level


def test_merging_chains_are_one_walk(spark):
    """Several seeds whose chains meet: each is counted to the common end."""
    t = [trade(0, 0, 30, -1, 100), trade(1, 5, 31, -1, 102), trade(2, 50, 80, -1, 101), trade(3, 100, 130, -1, 101), trade(4, 150, None, None, 101)]
    got = rules.reentry_clusters(spark.createDataFrame(t, TRADE), ["account", "day"], rules.RuleConfig()).collect()
    assert sorted((x["seed"], x["last"], x["extras"]) for x in got) == [("T00", "T04", 3), ("T01", "T04", 3)]


def test_clusters_take_one_sweep(spark):
    """Chains and blocks follow the same pointers; the block's trade may enter after the window, and counts only after enough re-entries."""
    t = [trade(0, 0, 30, -1), trade(1, 100, 130, -1), trade(2, 400, None, None), trade(3, 0, 30, -1, 200), trade(4, 300, None, None, 200)]
    got = rules.reentry_clusters(spark.createDataFrame(t, TRADE), ["account", "day"], rules.RuleConfig())
    assert sorted(tuple(x)[2:] for x in got.collect()) == [("T00", "T01", 1, "T02"), ("T03", "T03", 0, None)]
    assert plan(got).count("Window [") == 1


def test_overlaps_equal_all_pairs_without_a_join(spark):
    r = random.Random(5)
    rows = [(i % 2, f"s{i}", a, a + r.choice([0, 1, 7, 40, 900])) for i, a in enumerate(r.randrange(-300, 1500) for _ in range(150))]
    want = {}
    for k, i, a, b in rows:
        met = sorted(j for l, j, c, d in rows if l == k and j != i and a < b and c < d and a < d and c < b)
        if met:
            want[i] = ",".join(met)
    df = spark.createDataFrame(rows + [(None, "n1", 0, 9), (None, "n2", 0, 9)], "k long, session_id string, start_us long, end_us long")
    found = intervals.overlapping(df, ["k"], 20)
    assert {x["session_id"]: x["others"] for x in found.collect()} == want
    assert found.count() == len(want) and "Join" not in plan(found)


CORE = "k long, session_id string, start_us long, end_us long"


def test_overlaps_list_a_core_few_times(spark):
    """Disk: a core once or twice for each class of lengths that occurs (here up to 20 and 320), and no exchange to drop copies."""
    rows = [(i % 3, f"s{i}", 7 * i, 7 * i + 1 + i % 15) for i in range(900)] + [(1, "long", 0, 300)]
    df = spark.createDataFrame(rows, CORE)
    listed = intervals.meeting_places(df, 20)
    assert listed.where("mine").groupBy("session_id").count().where("count <> 1").isEmpty() and listed.where("mine").count() == 901
    assert {x["c"] for x in listed.select("c").distinct().collect()} == {20, 320}
    assert listed.count() < 3.5 * 901
    assert "Aggregate [k" not in plan(intervals.overlapping(df, ["k"], 20))


def test_overlaps_of_equal_spans_copies_and_missing_ids(spark):
    """Equal spans share a list but for their own ids, wherever these stand; copies of a row count once; rows come by start, so neighbours are alike."""
    rows = [(1, "b", 5, 9), (1, "ä", 5, 9), (1, "a,x", 5, 9), (1, "c", 0, 6), (1, "c", 0, 6), (1, "zz", 8, 12), (1, "y", 30, 31), (1, None, 0, 40), (2, "q", 0, 9), (1, "e", 6, 6)]
    found = intervals.overlapping(spark.createDataFrame(rows, CORE), ["k"], 100)
    assert [tuple(x) for x in found.collect()] == [("c", "a,x,b,ä"), ("a,x", "b,c,zz,ä"), ("b", "a,x,c,zz,ä"), ("ä", "a,x,b,c,zz"), ("zz", "a,x,b,ä")]


def test_overlaps_are_dealt_to_all_tasks(spark):
    """Long lists come from few rows, by which adaptive execution would put all buckets into one task."""
    df = spark.createDataFrame([(k, f"{k}-{i}", 0, 9) for k in range(64) for i in range(2)], CORE)
    assert intervals.overlapping(df, ["k"], 100).select(F.spark_partition_id()).distinct().count() == 4


def test_overlaps_of_nothing(spark):
    assert intervals.overlapping(spark.createDataFrame([(1, "a", 5, 5)], CORE), ["k"]).isEmpty()
