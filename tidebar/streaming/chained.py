"""Typed states with timers: bars of several lengths from one stream of closed bars, and paper accounts.

A series (or an account) keeps its state in columns of their own types in the state store, so it can be read, evolved and
resumed from a checkpoint. Timers are in event time. The state store must be the RocksDB one, as in ``session.SETTINGS``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.paper import RECORD, Config, new_account, records

_BAR = "time long, open double, high double, low double, close double, volume double, trades long"
CHAINED = f"series string, seconds long, {_BAR}"
_FIELDS = [f.split()[0] for f in _BAR.split(", ")]
_COIN = "position double, notional double, time long, price double, hold double"


def once(ticks: DataFrame, keys: tuple[str, ...] = ("series", "seq"), late: str = "10 minutes") -> DataFrame:
    """Ticks of a stream, each of ``keys`` once however often it is sent within the watermark."""
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


class _Ladder(StatefulProcessor):
    """The open bar of each length of one series, and the time of the last closed bar that was taken."""

    def __init__(self, base: int, lengths: tuple[int, ...]):
        self.base, self.lengths = base, lengths

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "time long")
        self.open = handle.getMapState("open", "seconds long", _BAR)

    def _close(self, seconds: int) -> tuple:
        bar = tuple(self.open.getValue((seconds,)))
        self.open.removeKey((seconds,))
        return (seconds, *bar)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        # what has gathered since the last trigger is applied in order; a bar that is not later than the last one changes nothing
        for r in pd.concat(list(rows)).sort_values("time").itertuples():
            if last is not None and r.time <= last:
                continue
            last = int(r.time)
            out.append((self.base, last, r.open, r.high, r.low, r.close, r.volume, int(r.trades)))
            for seconds in self.lengths:
                start = last - last % seconds
                held = tuple(self.open.getValue((seconds,))) if self.open.containsKey((seconds,)) else None
                if held is not None and held[0] < start:
                    out.append(self._close(seconds))
                    held = None
                if held is None:
                    own = (start, r.open, r.high, r.low, r.close, r.volume, int(r.trades))
                    self.handle.registerTimer((start + seconds) * 1000)
                else:
                    own = (start, held[1], max(held[2], r.high), min(held[3], r.low), r.close, held[5] + r.volume, held[6] + int(r.trades))
                self.open.updateValue((seconds,), own)
                if last + self.base >= start + seconds:
                    out.append(self._close(seconds))
        if last is not None:
            self.last.update((last,))
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        """A bar whose end the watermark has passed is closed, though its last base bars never came."""
        at = expiredTimerInfo.getExpiryTimeInMs() // 1000
        ended = [s for s in self.lengths if self.open.containsKey((s,)) and self.open.getValue((s,))[0] + s <= at]
        yield self._frame(key, [self._close(s) for s in ended])

    def _frame(self, key, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in out], columns=["series", "seconds", *_FIELDS])

    def close(self) -> None:
        pass


def chained_bars(ticks: DataFrame, base: int, lengths: tuple[int, ...], late: str = "10 minutes") -> DataFrame:
    """Closed bars of ``base`` seconds of a stream of ticks, and of each of ``lengths`` (multiples of it) made from those, in one query.

    A longer bar is out with the base bar that ends it, or, where that never comes, with the first one after it or once the
    watermark has passed its end. Ticks sent twice within the watermark count once.
    """
    if any(s % base for s in lengths):
        raise ValueError("longer bars must be multiples of the base")
    at = F.struct("ts", "seq")
    closed = (
        once(ticks, late=late)
        .groupBy(F.window("ts", f"{base} seconds"), "series")
        .agg(
            F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
            F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("trades"),
        )
    )
    rows = closed.select("series", F.unix_seconds("window.start").alias("time"), F.window_time("window").alias("ended"), *_FIELDS[1:])
    return rows.groupBy("series").transformWithStateInPandas(_Ladder(base, lengths), CHAINED, "Append", "EventTime")


class _Account(StatefulProcessor):
    """Cash, and the position of each coin, of one paper account."""

    def __init__(self, config: Config):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cash = handle.getValueState("cash", "cash double, dead boolean")
        self.coins = handle.getMapState("coins", "coin string", _COIN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        own = new_account(self.config)
        if self.cash.exists():
            own["cash"], own["dead"] = self.cash.get()
        names = [f.split()[0] for f in _COIN.split(", ")]
        own["coins"] = {k[0]: dict(zip(names, tuple(v))) for k, v in self.coins.iterator()}
        given = pd.concat(list(rows))
        out = records(own, self.config, key[0], given)
        self.cash.update((own["cash"], own["dead"]))
        for coin in given["coin"].unique():
            self.coins.updateValue((coin,), tuple(own["coins"][coin][c] for c in names))
        yield out

    def close(self) -> None:
        pass


def kept_accounts(targets: DataFrame, config: Config = Config()) -> DataFrame:
    """Records of paper accounts from a stream with account, coin, time, high, low, close and target; each state in its own columns."""
    return targets.groupBy("account").transformWithStateInPandas(_Account(config), RECORD, "Append", "None")


def follow(rows: DataFrame, path: str, checkpoint: str, every: str | None = "15 seconds") -> StreamingQuery:
    """Start writing a stream to Parquet at ``path``, each row once, from where ``checkpoint`` was left.

    It looks for new rows at every interval; without one it takes all that is there, in order, and ends.
    """
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
