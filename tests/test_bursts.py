"""BurstWatch driven by hand: against a model that looks at every held event, and on many events in one window."""

from __future__ import annotations

import random
import time
from types import SimpleNamespace as N

import numpy as np
import pandas as pd
import pytest

from tidewell.streaming.stateful import BurstWatch


class _Held:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    put = update


def _watch(threshold, window_s):
    p = BurstWatch(threshold, window_s)
    p.init(N(getListState=lambda *_: _Held(), getValueState=lambda *_: _Held()))
    return lambda batch: [tuple(r) for d in p.handleInputRows(("a",), iter([pd.DataFrame({"ts": batch}, dtype=float)]), None) for r in d.itertuples(index=False)]


@pytest.mark.parametrize("seed", range(100))
def test_bursts_of_ties_and_late_batches(seed):
    rng = random.Random(seed)
    threshold, window_s, base = rng.randint(1, 6), rng.choice([0.0, 1.0, 3.3, 10.0]), 0.0
    watch, held, on = _watch(threshold, window_s), [], False
    for _ in range(4):
        batch, want = [round(base + rng.random() * 20, rng.choice([0, 1])) for _ in range(rng.randint(1, 20))], []
        for ts in sorted(batch):
            held = [x for x in held if ts - x <= window_s] + [ts]
            if len(held) >= threshold and not on:
                want.append(("a", held[0], ts, len(held)))
            on = len(held) >= threshold
        assert watch(batch) == want
        base += rng.choice([-15, 0, 5, 40])


def test_events_without_a_time_and_many_in_a_window():
    watch, since = _watch(3, 3600.0), time.monotonic()
    assert watch([None, 1.0, None]) == []
    assert watch(list(np.arange(200_000) / 200)) == [("a", 1.0, 0.005, 3)]
    assert time.monotonic() - since < 20
