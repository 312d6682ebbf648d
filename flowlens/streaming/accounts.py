"""FIFO accounts as keyed state of a stream of account days."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "symbol string, broker string, date date, realized_pnl double, unrealized_pnl double, net long"


def trade(lots: list[list], side: str, shares: int, price: float, day) -> tuple[float, int]:
    """Match shares of one side with the oldest lots of the other, which are taken down in place; returns the profit and what is left over."""
    made, other = 0.0, "short" if side == "long" else "long"
    while shares and lots and lots[0][0] == other:
        take = min(shares, lots[0][1])
        made += take * (price - lots[0][2] if other == "long" else lots[0][2] - price)
        lots[0][1] -= take
        shares -= take
        if not lots[0][1]:
            lots.pop(0)
    if shares:
        lots.append([side, shares, price, day])
    return made, shares


class Accounts(StatefulProcessor):
    """State of an account: its open lots, oldest first (all of one side), and its last day. Days up to the last one are late and left out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lots = handle.getListState("lots", "side string, shares long, cost double, opened date")
        self.last = handle.getValueState("last", "day date")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        lots = [list(x) for x in self.lots.get()] if self.lots.exists() else []
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for r in pd.concat(list(rows)).sort_values("date").itertuples():
            if last is not None and r.date <= last:
                continue
            made = 0.0
            for side, shares, amount in (("short", r.sell_shares, r.sell_amount), ("long", r.buy_shares, r.buy_amount)):
                if shares > 0:
                    made += trade(lots, side, int(shares), amount / shares, r.date)[0]
            held = sum(n if side == "long" else -n for side, n, _, _ in lots)
            open_pnl = sum(n * (r.close - c if side == "long" else c - r.close) for side, n, c, _ in lots)
            out.append((*key, r.date, made, float(open_pnl), held))
            last = r.date
        if out:
            self.lots.put([tuple(x) for x in lots]) if lots else self.lots.clear()
            self.last.update((last,))
            yield pd.DataFrame(out, columns=["symbol", "broker", "date", "realized_pnl", "unrealized_pnl", "net"])

    def close(self) -> None:
        pass


def fifo_stream(days: DataFrame) -> DataFrame:
    """Profit of each account day of a stream (symbol, broker, date, buy_shares, sell_shares, buy_amount, sell_amount, close), resumed from the lots that earlier batches left open.

    Needs the RocksDB state store (`spark.sql.streaming.stateStore.providerClass`). State grows with open lots, not with history.
    """
    return days.groupBy("symbol", "broker").transformWithStateInPandas(statefulProcessor=Accounts(), outputStructType=OUT, outputMode="Append", timeMode="None")
