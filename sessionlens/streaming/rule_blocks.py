"""Trading rules while trades arrive: loss streaks, post-loss blocks and their ends.

The stream has an entry and an exit event for each trade, of any order within the watermark's
delay. A key (an account's day) keeps events until the watermark has passed them and then
takes them in time order, so the results are those of the batch rules however the events
were cut into micro-batches. Timers wake a key for its next waiting event, for the end of
an open block and, ``IDLE_HOURS`` after its last event, to settle and drop its state.

A losing streak is counted in the order of entries, as in batch: a trade waits for earlier
ones that are still open; those that are open when the day settles are left out.
Events later than the watermark are dropped by Spark, and so have no effect.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ListState, StatefulProcessor, StatefulProcessorHandle

from ..operators.rules import SECOND, RuleConfig
from .live import plain

IDLE_HOURS = 24
EVENT = "ts_us long, kind string, trade_id string, entry_us long, instrument string, direction string, entry_ticks long, pnl double, stopped boolean"
FIELDS = [f.split()[0] for f in EVENT.split(", ")]
OUTPUT = "kind string, trade_id string, next_trade_id string, gap_us long, streak long, at_us long"


@dataclass
class Trade:
    ts_us: int
    kind: str
    trade_id: str
    entry_us: int
    instrument: str | None
    direction: str | None
    entry_ticks: int | None
    pnl: float | None
    stopped: bool | None

    @property
    def order(self) -> tuple:
        """Time order; at one moment exits come first, as an entry at a trade's exit follows it."""
        return self.ts_us, self.kind == "entry", self.trade_id

    @property
    def loss(self) -> bool:
        return self.pnl is not None and self.pnl < 0


@dataclass
class Day:
    """What a key knows: trades whose turn in the streak hasn't come, entries they may need, losses that wait for the next entry."""

    config: RuleConfig
    trades: dict[tuple[int, str], Trade | None] = field(default_factory=dict)
    entries: list[Trade] = field(default_factory=list)
    losses: list[tuple[str, int, Trade]] = field(default_factory=list)
    run: int = 0
    block_end: int | None = None
    out: list[tuple] = field(default_factory=list)
    #: Keys of trades as a heap; trades closed at the moment of their entry, whose entry comes after the exit; rows that are kept before the next clearing.
    queue: list[tuple[int, str]] = field(default_factory=list)
    at_once: set[tuple[int, str]] = field(default_factory=set)
    most: int = 64

    def __post_init__(self) -> None:
        self.queue = sorted(self.trades)

    def need(self, kind: str) -> int:
        return 60 * SECOND * (self.config.streak_minutes if kind == "streak" else self.config.post_loss_minutes)

    def until(self, now: int) -> None:
        """Ends a block that ends by now, and forgets what no later event needs."""
        self.end_block(now)
        self.forget(now)

    def end_block(self, now: int) -> None:
        if self.block_end is not None and self.block_end <= now:
            self.out.append(("block_end", None, None, None, None, self.block_end))
            self.block_end = None

    def forget(self, now: int) -> None:
        """Losses for which any entry comes too late, and entries before all trades that wait for their turn."""
        self.losses = [x for x in self.losses if now < x[2].ts_us + self.need(x[0])]
        first = min(self.queue[0][0], now) if self.queue else now
        self.entries = self.entries[bisect_left(self.entries, first, key=lambda e: e.ts_us) :]
        self.at_once = {k for k in self.at_once if k[0] >= now}

    def take(self, event: Trade) -> None:
        """Events come in time order. The lists are cleared when they have doubled, so an event costs the same however many trades are open."""
        self.end_block(event.ts_us)
        kept = len(self.losses) + len(self.entries)
        if kept > self.most:
            self.forget(event.ts_us)
            self.most = 64 + 2 * (len(self.losses) + len(self.entries))
        key = event.entry_us, event.trade_id
        if event.kind == "entry":
            if key in self.at_once:
                self.at_once.discard(key)
            elif key not in self.trades:
                self.trades[key] = None
                heappush(self.queue, key)
            self.entries.append(event)
            left = []
            for kind, streak, loss in self.losses:
                if loss.trade_id == event.trade_id:
                    left.append((kind, streak, loss))
                else:
                    self.follow(kind, streak, loss, event)
            self.losses = left
        else:
            if key not in self.trades:
                heappush(self.queue, key)
            self.trades[key] = event
            if event.entry_us >= event.ts_us:
                self.at_once.add(key)
            if event.loss:
                self.wait("post_loss", 0, event)
                self.block_end = event.ts_us + self.need("post_loss")
        self.turn()

    def turn(self, settle: bool = False) -> None:
        """Counts trades of the streak whose turn has come: all entered before them are closed."""
        while self.queue:
            trade = self.trades[self.queue[0]]
            if trade is None and not settle:
                return
            del self.trades[heappop(self.queue)]
            if trade is None:
                continue
            self.run = self.run + 1 if trade.loss else 0
            if trade.loss and self.run >= self.config.streak:
                self.wait("streak", self.run, trade)

    def wait(self, kind: str, streak: int, loss: Trade) -> None:
        """The first known entry after a loss, else the next that comes. Entries are in the order of (time, id)."""
        at = bisect_left(self.entries, loss.ts_us, key=lambda e: e.ts_us)
        while at < len(self.entries) and self.entries[at].trade_id == loss.trade_id:
            at += 1
        if at < len(self.entries):
            self.follow(kind, streak, loss, self.entries[at])
        else:
            self.losses.append((kind, streak, loss))

    def follow(self, kind: str, streak: int, loss: Trade, entry: Trade) -> None:
        """Judges the first entry after a loss."""
        gap = entry.ts_us - loss.ts_us
        if gap >= self.need(kind):
            return
        if kind == "post_loss" and loss.stopped and gap <= self.config.reentry_window_s * SECOND and self.same_level(loss, entry):
            return
        self.out.append((kind, loss.trade_id, entry.trade_id, gap, streak if kind == "streak" else None, entry.ts_us))

    def same_level(self, a: Trade, b: Trade) -> bool:
        near = a.entry_ticks is not None and b.entry_ticks is not None and abs(a.entry_ticks - b.entry_ticks) <= self.config.same_level_ticks
        return near and (a.instrument or "") == (b.instrument or "") and (a.direction or "") == (b.direction or "")


class RuleBlocks(StatefulProcessor):
    def __init__(self, config: RuleConfig, keys: list[str]):
        self.config, self.keys = config, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", EVENT)
        self.trades = handle.getListState("trades", f"{EVENT}, closed boolean")
        self.entries = handle.getListState("entries", EVENT)
        self.losses = handle.getListState("losses", f"{EVENT}, rule string, streak long")
        self.status = handle.getValueState("status", "run long, block_end long, last_us long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        new = [tuple(plain(x) for x in r) for b in rows for r in b[FIELDS].itertuples(index=False, name=None)]
        self.waiting.appendList(new)
        run, end, last = self.status.get() or (0, None, 0)
        self.status.update((run, end, max([last] + [r[0] for r in new])))
        self._timers()
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        run, end, last = self.status.get() or (0, None, 0)
        size = len(FIELDS)
        trades = {}
        for r in self.trades.get():
            t = Trade(*r[:size])
            trades[t.entry_us, t.trade_id] = t if r[size] else None
        entries = [Trade(*r) for r in self.entries.get()]
        losses = [(r[size], r[size + 1], Trade(*r[:size])) for r in self.losses.get()]
        day = Day(self.config, trades, entries, losses, run, end)
        events = sorted((Trade(*r) for r in self.waiting.get()), key=lambda t: t.order)
        for t in events:
            if t.ts_us < now:
                day.take(t)
        day.until(now)
        left = [t for t in events if t.ts_us >= now]
        if now > last + IDLE_HOURS * 3600 * SECOND and not left:
            day.turn(settle=True)
            day.until(now)
            for state in (self.waiting, self.trades, self.entries, self.losses, self.status):
                state.clear()
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
        else:
            open_trade = lambda k: (k[0], "entry", k[1], k[0], None, None, None, None, None, False)
            self._keep(self.waiting, [self._row(t) for t in left])
            self._keep(self.trades, [(*self._row(t), True) if t else open_trade(k) for k, t in day.trades.items()])
            self._keep(self.entries, [self._row(t) for t in day.entries])
            self._keep(self.losses, [(*self._row(t), kind, streak) for kind, streak, t in day.losses])
            self.status.update((day.run, day.block_end, last))
            self._timers()
        if day.out:
            yield self._frame(key, day.out)

    def _keep(self, state: ListState, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def _row(self, t: Trade) -> tuple:
        return tuple(getattr(t, f) for f in FIELDS)

    def _timers(self) -> None:
        """One timer for each thing to come: the earliest waiting event, the block's end, the day's end."""
        run, end, last = self.status.get()
        first = min((r[0] for r in self.waiting.get()), default=None)
        want = {t // 1000 + 1 for t in (first, end, last + IDLE_HOURS * 3600 * SECOND) if t is not None}
        have = set(self.handle.listTimers())
        for at in have - want:
            self.handle.deleteTimer(at)
        for at in want - have:
            self.handle.registerTimer(at)

    def _frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        names = [f.split()[0] for f in OUTPUT.split(", ")]
        out = pd.DataFrame(rows, columns=names).astype({"gap_us": "Int64", "streak": "Int64", "at_us": "Int64"})
        for i, k in enumerate(self.keys):
            out.insert(i, k, pd.Series([key[i]] * len(rows), dtype=object))
        return out


def trade_events(trades: DataFrame, keys: list[str], stopped: Column) -> DataFrame:
    """keys, ts and an event for each entry and exit of trades (as the batch rules have them, with pnl)."""
    head = [F.col("trade_id"), F.col("entry_us"), "instrument", "direction", F.col("entry_ticks").cast("long").alias("entry_ticks"), F.col("pnl").cast("double").alias("pnl"), stopped.alias("stopped")]
    entry = trades.select(*keys, F.col("entry_us").alias("ts_us"), F.lit("entry").alias("kind"), *head)
    out = trades.where("exit_us is not null").select(*keys, F.col("exit_us").alias("ts_us"), F.lit("exit").alias("kind"), *head)
    return entry.unionByName(out).withColumn("ts", F.timestamp_micros("ts_us"))


def rule_blocks(events: DataFrame, keys: list[str], config: RuleConfig, late: str = "30 minutes") -> DataFrame:
    """keys, kind (streak, post_loss, block_end), trade_id, next_trade_id, gap_us, streak, at_us of a stream of events.

    Needs the RocksDB state store.
    """
    head = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in keys)
    return events.withWatermark("ts", late).groupBy(*keys).transformWithStateInPandas(RuleBlocks(config, keys), f"{head}, {OUTPUT}", "append", "EventTime")
