"""Paged feeds over a fake transport, and streams over replayed files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidewell.cli import main
from tidewell.schemas import TICKS
from tidewell.sources import feeds
from tidewell.streaming import pipelines, stateful


def test_offset_pages_and_union_of_listings(spark):
    def listing(request):
        data = [{"id": f"{i:03d}", "closedTime": f"2026-01-{31 - i % 28:02d}", "body": "{}"} for i in range(25)]
        return data[request["offset"] : request["offset"] + request["limit"]]

    out = feeds.read_feed(spark, "listing_test", "id string, closedTime string, body string", listing, [{}, {}], "offset", size=10)
    assert out.count() == 50
    assert feeds.read_markets(spark, listing, [{}, {}]).count() == 25
    assert feeds.read_feed(spark, "nothing_test", "id string", listing, []).count() == 0


def test_first_listing_wins(spark):
    def listing(request):
        return [{"id": f"{i:03d}", "closedTime": None, "body": request["tag"]} for i in range(200)][request["offset"] : request["offset"] + request["limit"]]

    out = feeds.read_markets(spark, listing, [{"tag": "first"}, {"tag": "second"}, {"tag": "third"}]).collect()
    assert len(out) == 200 and {r.body for r in out} == {"first"}


def test_lookups_of_single_tokens(spark):
    fees = {"a": {"base_fee": 200}, "b": {"base_fee": "x"}, "c": None, "d": {"base_fee": 0}}
    assert sorted(map(tuple, feeds.read_fee_rates(spark, lambda q: fees[q["token_id"]], list("abcd")).collect())) == [("a", 200), ("d", 0)]
    trades = {"a": {"price": "0.25", "side": "buy"}, "b": {"price": "1.5", "side": "SELL"}, "c": {}}
    assert [tuple(r) for r in feeds.read_last_trades(spark, lambda q: trades[q["token_id"]], list("abc")).collect()] == [("a", 0.25, "BUY")]


def test_cursor_guard_and_retry():
    seen = []

    def fetch(request):
        seen.append(request["id_gt"])
        return [{"id": f"{i:03d}"} for i in range(7) if f"{i:03d}" > request["id_gt"]][: request["first"]]

    assert [r["id"] for r in feeds.cursor_pages(fetch, {}, size=3)] == [f"{i:03d}" for i in range(7)]
    with pytest.raises(RuntimeError, match="advance"):
        list(feeds.cursor_pages(lambda q: [{"id": "5"}, {"id": "5"}], {}, size=2))
    waits, tries = [], []

    def busy(request):
        tries.append(1)
        if len(tries) < 3:
            raise feeds.Busy(2.0)
        return "ok"

    assert feeds.patient(busy, sleep=waits.append)({}) == "ok" and waits == [2.0, 2.0]
    assert [(r["start"], r["end"]) for r in feeds.chunked(lambda q: [q], {"start": 0, "end": 10}, 4)] == [(0, 4), (5, 9)]


def test_messages_become_ticks(spark, tmp_path):
    level = lambda p: [{"size": "1", "price": p}]
    book = lambda token, bids, asks, **kind: {**kind, "asks": asks, "asset_id": token, "bids": bids}
    messages = [
        json.dumps(dict(event_type="last_trade_price", size="2", timestamp="5", asset_id="T", price="0.5")),
        json.dumps(book("T", level("0.4"), [], event_type="book")),
        json.dumps([book("T", [], level("0.6")), book("U", [], [])]),
        json.dumps(dict(price_changes=[dict(best_bid="0.45", asset_id="T"), dict(asset_id="")], event_type="price_change")),
        json.dumps(dict(topic="c", type="update", payload=dict(value=5, timestamp=7, symbol="BTCUSDT"))),
        "PONG",
    ]
    spark.createDataFrame([(m, i) for i, m in enumerate(messages)], "value string, recv_ns bigint").write.parquet(f"{tmp_path}/in")
    stream = pipelines.message_files(spark, f"{tmp_path}/in")
    batch = pipelines.route(spark.read.parquet(f"{tmp_path}/in"))
    assert {k: v.count() for k, v in batch.items()} == {"books": 3, "changes": 1, "trades": 1, "spot": 1}
    assert pipelines.allowed(batch["spot"], {"c": ["btcusdt"]}).count() == 1 and pipelines.allowed(batch["spot"], {"d": ["btcusdt"]}).count() == 0
    trades = pipelines.route(stream)["trades"].select(F.lit("m").alias("market_id"), F.lit("BTC").alias("crypto"), F.lit("1-hour").alias("timeframe"), "timestamp_ms", F.col("asset_id").alias("token_id"), "price", F.lit("websocket").alias("source"))
    pipelines.stage_stream(trades, str(tmp_path / "lake"), TICKS, f"{tmp_path}/cp", once=True).awaitTermination()
    assert main(["consolidate", "--root", str(tmp_path / "lake")], spark) == 0
    assert spark.read.parquet(f"{tmp_path}/lake/ticks").count() == 1
    assert main(["query", "--root", str(tmp_path / "lake"), "SELECT count(*) AS n FROM ticks"], spark) == 0


def test_burst_alerts(spark, tmp_path):
    data = [("a", float(t)) for t in (1, 2, 3, 100, 200, 201, 202, 203)]
    spark.createDataFrame(data, "shard_key string, ts double").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("shard_key string, ts double").parquet(f"{tmp_path}/in")
    out = pipelines.run_to_table(stateful.burst_alerts(stream, 3, 10.0), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert sorted((r.burst_start, r.alert_ts, r.n) for r in out.collect()) == [(1.0, 3.0, 3), (200.0, 202.0, 3)]


def test_windows_of_a_stream(spark, tmp_path):
    spark.sql("SELECT timestamp'2026-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, i * 7) AS ts, 'k' AS key, 1.5D AS value FROM (SELECT explode(sequence(0, 9)) AS i)").write.parquet(f"{tmp_path}/in")
    source = lambda: pipelines.replay(spark, f"{tmp_path}/in", "ts timestamp, key string, value double")
    tumbled = pipelines.run_to_table(pipelines.tumbling(source(), "ts", "30 minutes", ["key"]), f"{tmp_path}/a", f"{tmp_path}/ca", "complete")
    assert sorted(r.n for r in tumbled.collect()) == [1, 4, 5]
    slid = pipelines.run_to_table(pipelines.sliding(source(), "ts", "30 minutes", "15 minutes", ["key"]), f"{tmp_path}/b", f"{tmp_path}/cb", "complete")
    assert sum(r.n for r in slid.collect()) == 20
    sessions = pipelines.run_to_table(pipelines.session_counts(source(), "ts", "5 minutes", ["key"]), f"{tmp_path}/c", f"{tmp_path}/cc", "complete")
    assert [r.n for r in sessions.collect()] == [1] * 10


def test_audit_command(spark, tmp_path):
    spark.createDataFrame([(1, "a", "s", "x", 1), (60_001, "a", "s", "x", 1)], "ts_ms bigint, source string, shard_key string, event_type string, last_event_age_ms bigint").write.parquet(f"{tmp_path}/beats")
    (tmp_path / "logs").mkdir()
    args = ["audit", "--heartbeats", f"{tmp_path}/beats", "--logs", f"{tmp_path}/logs"]
    assert main([*args, "--max-gap-ms", "90000"], spark) == 0
    assert main([*args, "--out", f"{tmp_path}/manifest"], spark) == 1
    assert main([*args, "--previous", f"{tmp_path}/manifest"], spark) == 0


def test_monitor_tells_once():
    from types import SimpleNamespace as N

    from tidewell.streaming.monitor import Monitor

    told = []
    m = Monitor(lambda kind, name, facts: told.append((kind, name)), batches=2)
    m.onQueryStarted(N(runId="r"))
    for _ in range(4):
        m.onQueryProgress(N(progress=N(runId="r", id="q", name="ticks", batchId=1, inputRowsPerSecond=9.0, processedRowsPerSecond=3.0)))
    m.onQueryTerminated(N(runId="r", id="q", exception="boom"))
    assert told == [("behind", "ticks"), ("failed", "q")]


def test_subscriptions_and_refresh(spark):
    tokens = spark.createDataFrame([(f"{i:04d}",) for i in range(1203)] * 2 + [("",), (None,)], "token_id string")
    got = {r.shard: r.tokens for r in pipelines.subscriptions(tokens).collect()}
    assert [len(got[i]) for i in sorted(got)] == [500, 500, 203] and sum((got[i] for i in sorted(got)), []) == [f"{i:04d}" for i in range(1203)]
    now, loads = [0.0], []

    def load():
        loads.append(now[0])
        if now[0] == 100.0:
            raise OSError("gone")
        return len(loads)

    table = pipelines.Refreshed(load, 60.0, lambda: now[0])
    seen = []
    for now[0] in (0.0, 59.0, 60.0, 100.0, 121.0):
        if now[0] == 100.0:
            table.every_s = 10.0
        seen.append(table.get())
    assert seen == [1, 1, 2, 2, 4] and loads == [0.0, 60.0, 100.0, 121.0]


class _State:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_silence_is_told_once_after_grace():
    from types import SimpleNamespace as N

    import pandas as pd

    asked = []
    p = stateful.StaleWatch({"spot": 1_000}, 60_000, 5_000, 500)
    p.init(N(getValueState=lambda *_: _State(), registerTimer=asked.append))
    now = lambda ms: N(getCurrentProcessingTimeInMs=lambda: ms)
    hear = lambda ms: list(p.handleInputRows(("spot",), iter([pd.DataFrame({"ts_ms": [1]})]), now(ms)))
    tick = lambda ms: pd.concat(p.handleExpiredTimer(("spot",), now(ms), None)).to_dict("records")
    hear(0)
    assert tick(2_000) == []  # beyond its threshold, but within the grace
    assert tick(5_500) == [{"source": "spot", "ts_ms": 5_500, "age_ms": 5_500}]
    assert tick(6_000) == []  # told
    hear(6_100)
    assert tick(7_000) == [] and tick(7_200) == [{"source": "spot", "ts_ms": 7_200, "age_ms": 1_100}]
    assert asked == [500, 2_500, 6_000, 6_500, 7_500, 7_700]


def test_heartbeat_ages_by_timer():
    """The processor, driven by hand: the age of the latest event at every tick, and the next tick asked for."""
    from types import SimpleNamespace as N

    import pandas as pd

    class State:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    asked = []
    p = stateful.Staleness(10_000)
    p.init(N(getValueState=lambda *_: State(), registerTimer=asked.append))
    now = lambda ms: N(getCurrentProcessingTimeInMs=lambda: ms)
    assert list(p.handleInputRows(("spot",), iter([pd.DataFrame({"ts_ms": [5, 900]})]), now(1_000)))[0].empty
    list(p.handleInputRows(("spot",), iter([pd.DataFrame({"ts_ms": [700]})]), now(2_000)))
    out = pd.concat(p.handleExpiredTimer(("spot",), now(11_000), None))
    assert out.to_dict("records") == [{"source": "spot", "ts_ms": 11_000, "last_event_age_ms": 10_100}]
    assert asked == [11_000, 21_000]
