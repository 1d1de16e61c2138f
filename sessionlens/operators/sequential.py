"""FIFO lots by a table function that reads a bucket's fills in order: a second way beside the sweep, for checks.

    SELECT * FROM sequential_lots(TABLE(fills) PARTITION BY (account, instrument) ORDER BY (ts_us, fill_id))
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

LOTS = "account long, instrument string, lot_seq long, status string, direction string, qty long, entry_fill_id long, exit_fill_id long"


class SequentialLots:
    """A queue of open fills; a fill of the other side closes the oldest first. Open lots come last."""

    def __init__(self) -> None:
        self.open: deque[list] = deque()
        self.key: tuple = (None, None)
        self.n = 0

    def eval(self, fill: Row) -> Iterator[tuple]:
        self.key = fill["account"], fill["instrument"]
        left = fill["qty"]
        while left and self.open and self.open[0][0] != fill["side"]:
            side, held, entry = self.open[0]
            take = min(left, held)
            yield *self.key, self.n, "closed", "long" if side == "buy" else "short", take, entry, fill["fill_id"]
            self.n += 1
            left -= take
            self.open[0][1] -= take
            if not self.open[0][1]:
                self.open.popleft()
        if left:
            self.open.append([fill["side"], left, fill["fill_id"]])

    def terminate(self) -> Iterator[tuple]:
        for side, held, entry in self.open:
            yield *self.key, self.n, "open", "long" if side == "buy" else "short", held, entry, None
            self.n += 1


def register(spark: SparkSession) -> None:
    spark.udtf.register("sequential_lots", udtf(SequentialLots, returnType=LOTS))
