"""Keyed state: quotes that messages update in part, bursts of reconnects, staleness."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.latch import QUOTES

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class QuoteLatch(StatefulProcessor):
    """The top of a book behind every update of a token; invalid states are remembered and not shown."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("quotes", ", ".join(f"{q} double" for q in QUOTES))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        now = list(self.state.get()) if self.state.exists() else [0.0] * 4
        out = []
        for part in rows:
            for r in part.sort_values("local_recv_ts_ns", kind="stable").to_dict("records"):
                for i, q in enumerate(QUOTES):
                    known = r[q] is not None and r[q] == r[q]
                    now[i] = float(r[q]) if known else 0.0 if r["is_snapshot"] else now[i]
                bid, ask = now[0], now[1]
                if all(0 < x < float("inf") for x in now) and bid < ask <= 1:
                    out.append((key[0], int(r["local_recv_ts_ns"]), *now))
        self.state.update(tuple(now))
        yield pd.DataFrame(out, columns=["token_id", "local_recv_ts_ns", *QUOTES])

    def close(self) -> None:
        pass


def latch_stream(updates: DataFrame) -> DataFrame:
    """latch_quotes over a stream of (token_id, local_recv_ts_ns, is_snapshot, quotes)."""
    updates.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    schema = "token_id string, local_recv_ts_ns bigint, " + ", ".join(f"{q} double" for q in QUOTES)
    return updates.groupBy("token_id").transformWithStateInPandas(QuoteLatch(), schema, "Append", "None")


class BurstWatch(StatefulProcessor):
    """One alert when a shard reaches threshold events within window_s, and none again before it has fallen below."""

    def __init__(self, threshold: int, window_s: float) -> None:
        self.threshold, self.window_s = threshold, window_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "ts double")
        self.on = handle.getValueState("on", "on boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        held = np.array([x[0] for x in self.recent.get()] if self.recent.exists() else [], float)
        on = self.on.get()[0] if self.on.exists() else False
        new = np.sort(np.concatenate([part["ts"].to_numpy(float) for part in rows]))
        new = new[~np.isnan(new)]
        starts, at, n = np.empty(0), np.empty(0), np.empty(0, int)
        if len(new):
            reached = self._reached(held, new)
            alerts = np.flatnonzero(reached & ~np.concatenate([[bool(on)], reached[:-1]]))
            near = np.count_nonzero(new - held.max() <= self.window_s) if len(held) else 0
            joint, own = alerts[alerts < near], alerts[alerts >= near]
            kept = [np.concatenate([held[new[i] - held <= self.window_s], new[self._first(new, i) : i + 1]]) for i in joint]
            starts = np.concatenate([[x[0] for x in kept], new[own - self.threshold + 1]])  # of new ones alone it has just been reached
            at, n = new[alerts], np.array([len(x) for x in kept] + [self.threshold] * len(own), int)
            held = np.concatenate([held[new[-1] - held <= self.window_s], new[self._first(new, len(new) - 1) :]])
            on = bool(reached[-1])
        self.recent.put([(x,) for x in held.tolist()])
        self.on.update((on,))
        yield pd.DataFrame({"shard_key": key[0], "burst_start": starts, "alert_ts": at, "n": n}, columns=["shard_key", "burst_start", "alert_ts", "n"])

    def _reached(self, held: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Whether each of the new times (in order) has threshold times within its window: the latest new ones, or the latest a of those held before and the rest new."""
        k, w = self.threshold, self.window_s
        reached = np.zeros(len(new), bool)
        reached[k - 1 :] = new[k - 1 :] - new[: max(0, len(new) - k + 1)] <= w
        for a, h in enumerate(np.sort(held)[::-1][:k], 1):
            near, b = new[: np.count_nonzero(new - h <= w)], max(1, k - a)
            reached[b - 1 : len(near)] |= near[b - 1 :] - near[: max(0, len(near) - b + 1)] <= w
        return reached

    def _first(self, new: np.ndarray, i: int) -> int:
        """The first of the new times in the window of the i-th."""
        return bisect_left(range(i + 1), True, key=lambda j: new[i] - new[j] <= self.window_s)

    def close(self) -> None:
        pass


def burst_alerts(reconnects: DataFrame, threshold: int = 5, window_s: float = 60.0) -> DataFrame:
    reconnects.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return reconnects.groupBy("shard_key").transformWithStateInPandas(BurstWatch(threshold, window_s), "shard_key string, burst_start double, alert_ts double, n int", "Append", "None")


class Staleness(StatefulProcessor):
    """Heartbeat ages by feed at every processing-time tick: milliseconds since the last event."""

    def __init__(self, every_ms: int) -> None:
        self.every_ms = every_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        latest = max(int(part["ts_ms"].max()) for part in rows)
        before = self.seen.get()[0] if self.seen.exists() else None
        self.seen.update((max(latest, before or 0),))
        if before is None:
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.every_ms)
        yield pd.DataFrame(columns=["source", "ts_ms", "last_event_age_ms"])

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        now = timers.getCurrentProcessingTimeInMs()
        self.handle.registerTimer(now + self.every_ms)
        yield pd.DataFrame([(key[0], now, now - self.seen.get()[0])], columns=["source", "ts_ms", "last_event_age_ms"])

    def close(self) -> None:
        pass


def heartbeats_stream(events: DataFrame, every_ms: int = 10_000) -> DataFrame:
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return events.groupBy("source").transformWithStateInPandas(Staleness(every_ms), "source string, ts_ms bigint, last_event_age_ms bigint", "Append", "ProcessingTime")


class StaleWatch(StatefulProcessor):
    """One alert when a feed has been silent for longer than its threshold, and none again before it has spoken.

    Ages count from the last event's arrival. Nothing is told within grace_ms after the feed was first heard of.
    """

    def __init__(self, thresholds_ms: dict[str, int], default_ms: int, grace_ms: int, every_ms: int) -> None:
        self.thresholds_ms, self.default_ms, self.grace_ms, self.every_ms = thresholds_ms, default_ms, grace_ms, every_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("feed", "first bigint, last bigint, told boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        for _ in rows:
            pass
        now = timers.getCurrentProcessingTimeInMs()
        first = self.state.get()[0] if self.state.exists() else None
        self.state.update((now if first is None else first, now, False))
        if first is None:
            self.handle.registerTimer(now + self.every_ms)
        yield pd.DataFrame(columns=["source", "ts_ms", "age_ms"])

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        now = timers.getCurrentProcessingTimeInMs()
        self.handle.registerTimer(now + self.every_ms)
        first, last, told = self.state.get()
        stale = now - last > self.thresholds_ms.get(key[0], self.default_ms) and now - first > self.grace_ms
        self.state.update((first, last, stale))
        yield pd.DataFrame([(key[0], now, now - last)] if stale and not told else [], columns=["source", "ts_ms", "age_ms"])

    def close(self) -> None:
        pass


def stale_alerts(events: DataFrame, thresholds_ms: dict[str, int], default_ms: int = 60_000, grace_ms: int = 60_000, every_ms: int = 5_000) -> DataFrame:
    """(source, ts_ms, age_ms) of feeds that fall silent, from a stream of (source, ...)."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return events.groupBy("source").transformWithStateInPandas(StaleWatch(thresholds_ms, default_ms, grace_ms, every_ms), "source string, ts_ms bigint, age_ms bigint", "Append", "ProcessingTime")
