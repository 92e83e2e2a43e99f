"""What single operators do, on literal rows."""

from __future__ import annotations

import json
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tidewell.catalog import load_ticks_for_market, markdown, query, register_views, spot_lookup
from tidewell.functions import markets as M
from tidewell.functions import questions as Q
from tidewell.functions import scalars as S
from tidewell.functions import wire as W
from tidewell.operators import asof, dedup, latch, quality, sequence
from tidewell.schemas import CULTURE_PRICES, HEARTBEATS, MARKETS, ORDERBOOK, PRICES, SPOT_PRICES, TICKS
from tidewell.sources.hive import canonical, read_drifting
from tidewell.sources.logs import failed_windows, reconnects
from tidewell.storage import consolidate as C
from tidewell.storage import lake
from tidewell.storage import writers as Wr

TICK = "market_id string, timestamp_ms bigint, token_id string, tx_hash string, log_index int, order_hash string, local_recv_ts_ns bigint, source string, price double, w int"


def rows(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=repr)


def tick(spark, *data):
    return spark.createDataFrame(list(data), TICK)


def test_newer_fills_override_legacy_ones(spark):
    old = ("m", 1, "t", "0xtx", 5, None, None, "onchain", 0.1, 0)
    df = tick(spark, old, ("m", 1, "t", "0xtx", 0, "A", None, "onchain", 0.2, 1), ("m", 1, "t", "0xtx", 0, "B", None, "onchain", 0.3, 2), ("m", 1, "t", "", 0, None, None, "websocket", 0.4, 3))
    assert [r[0] for r in rows(dedup.dedup_ticks(df, F.col("w")), "price")] == [0.2, 0.3, 0.4]
    lonely = tick(spark, old)
    assert rows(dedup.drop_overridden(lonely), "price") == [(0.1,)]
    live = tick(spark, ("m", 1, "t", "0xtx", 5, None, 7, "websocket", 0.1, 0), ("m", 1, "t", "0xtx", 0, "A", None, "onchain", 0.2, 1))
    assert dedup.drop_overridden(live).count() == 2


def test_ticks_of_one_millisecond_survive(spark):
    df = tick(spark, ("m", 1, "t", "", 0, None, 100, "websocket", 0.1, 0), ("m", 1, "t", "", 0, None, 101, "websocket", 0.2, 1), ("m", 1, "t", "", 0, None, 101, "websocket", 0.3, 2))
    assert rows(dedup.dedup_ticks(df, F.col("w")), "local_recv_ts_ns", "price") == [(100, 0.1), (101, 0.3)]


def test_merge_takes_the_latest_known_value_of_each_column(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 1), (1, None, 2.0, 2), (1, "b", None, 3)], "k int, x string, y double, _w int")
    assert rows(dedup.merge_columns(df, ["k"], F.col("_w"))) == [(1, "b", 2.0)]
    assert rows(dedup.keep_last(df, ["k"], ["_w"]), "x", "y") == [("b", None)]


def test_merge_against_a_model(spark):
    r = random.Random(1)
    data = [(r.randint(0, 5), r.choice([None, "a", "b"]), r.choice([None, 1.0, 2.0]), i) for i in range(80)]
    model: dict = {}
    for k, x, y, _ in data:
        old = model.get(k, (None, None))
        model[k] = (x if x is not None else old[0], y if y is not None else old[1])
    out = dedup.merge_columns(spark.createDataFrame(data, "k int, x string, y double, _w int"), ["k"], F.col("_w"))
    assert rows(out) == sorted(((k, *v) for k, v in model.items()), key=repr)


def test_asof_is_inclusive_and_whole(spark):
    left = spark.createDataFrame([("a", 1000), ("a", 2500), ("a", 500), (None, 2000), ("b", 9)], "k string, t bigint")
    right = spark.createDataFrame([("a", 1000, 1.0), ("a", 1000, 3.0), ("a", 2000, None), (None, 1, 9.0)], "k string, at bigint, v double")
    out = asof.asof_join(left, right, ["k"], "t", "at", ["v"])
    assert rows(out, "t", "at_match", "v") == sorted([(1000, 1000, 3.0), (2500, 2000, None), (500, None, None), (2000, None, None), (9, None, None)], key=repr)
    near = asof.asof_join(left, right, ["k"], "t", "at", ["v"], tolerance=100)
    assert [r for r in rows(near, "t", "at_match") if r[1] is not None] == [(1000, 1000)]


@pytest.mark.parametrize("bucket", [None, 7, 50, 10_000])
def test_asof_against_a_model(spark, bucket):
    r = random.Random(8)
    left = [(r.choice("ab"), r.randint(0, 300), i) for i in range(120)]
    right = [(r.choice("abc"), r.randint(0, 300), round(r.random(), 3)) for _ in range(60)]
    expected = []
    for k, t, i in left:
        before = [(at, v) for key, at, v in right if key == k and at <= t]
        expected.append((i, *(max(before) if before else (None, None))))
    out = asof.asof_join(spark.createDataFrame(left, "k string, t int, i int"), spark.createDataFrame(right, "k string, at int, v double"), ["k"], "t", "at", ["v"], bucket=bucket)
    assert rows(out, "i", "at_match", "v") == sorted(expected, key=repr)


def test_two_sided_alignment(spark):
    points = spark.createDataFrame([("m", 0, "up", 0.6), ("m", 100, "up", 0.65), ("m", 0, "down", 0.4), ("m", 50, "down", 0.35), ("n", 5, "up", 0.9)], "market_id string, t int, side string, p double")
    assert rows(asof.align_sides(points, ["market_id"], "t", "side", "p")) == sorted([("m", 0, 0.6, 0.4), ("m", 50, 0.6, 0.35), ("m", 100, 0.65, 0.35), ("n", 5, 0.9, 0.5)], key=repr)


def test_bursts_against_a_queue(spark):
    r = random.Random(4)
    data = [(f"s{r.randint(0, 2)}", round(r.uniform(0, 300), 1)) for _ in range(180)]
    expected = []
    for shard in {s for s, _ in data}:
        times, window, on, start, count = sorted(t for s, t in data if s == shard), deque(), False, 0.0, 0
        for t in times:
            while window and round(t * 1e6) - round(window[0] * 1e6) > 20_000_000:
                window.popleft()
            window.append(t)
            if len(window) >= 5:
                start, count = (start, max(count, len(window))) if on else (window[0], len(window))
                on = True
            elif on:
                expected.append((shard, count, start, t))
                on = False
        if on:
            expected.append((shard, count, start, times[-1]))
    out = sequence.bursts(spark.createDataFrame(data, "shard_key string, ts double"), ["shard_key"], "ts", 5, 20.0)
    assert rows(out, "shard_key", "n", "burst_start", "burst_end") == sorted(expected, key=repr)


@pytest.mark.parametrize("data,expected", [([(0, 30), (20, 40), (35, 50)], [(0, 50)]), ([(0, 1), (100_001, 100_002)], [(0, 1), (100_001, 100_002)]), ([(0, 10), (60_010, 60_020)], [(0, 60_020)])])
def test_interval_merge(spark, data, expected):
    df = spark.createDataFrame([("k", a, b) for a, b in data], "k string, a bigint, b bigint")
    assert rows(sequence.merge_intervals(df, ["k"], "a", "b"), "a", "b") == expected


def test_quote_latch(spark):
    data = [("t", 1, True, 0.49, 0.51, 5.0, 5.0), ("t", 2, False, 0.495, None, None, None), ("t", 3, False, 0.6, None, None, None), ("t", 4, True, None, 0.5, 1.0, 1.0), ("t", 5, False, 0.4, None, None, None), ("u", 1, False, 0.4, None, None, None)]
    df = spark.createDataFrame(data, "token_id string, local_recv_ts_ns bigint, is_snapshot boolean, best_bid double, best_ask double, best_bid_size double, best_ask_size double")
    assert rows(latch.latch_quotes(df), "local_recv_ts_ns", "best_bid", "best_ask") == [(1, 0.49, 0.51), (2, 0.495, 0.51), (5, 0.4, 0.5)]


@pytest.mark.parametrize(
    "text,asset,timeframe",
    [
        ("Bitcoin Up or Down - March 3, 9:15AM-9:30AM ET", "BTC", "15-minute"),
        ("Ethereum Up or Down - March 3, 11:55PM-12:00AM ET", "ETH", "5-minute"),
        ("Solana Up or Down - March 3, 8:00AM - 12:00PM ET", "SOL", "4-hour"),
        ("XRP Up or Down - March 3, 5PM ET", "XRP", "1-hour"),
        ("Will Elon Musk post 100 tweets March 27 to April 3, 2026?", "ELON-TWEETS", "7-day"),
        ("Elon Musk # tweets in April 2026?", "ELON-TWEETS", "1-month"),
        ("Elon Musk tweets December 30 to January 3, 2025", "ELON-TWEETS", "4-day"),
        ("Elon Musk tweets Foo 1 to Bar 3, 2025", "ELON-TWEETS", None),
        ("Will it rain?", None, None),
    ],
)
def test_questions(spark, text, asset, timeframe):
    df = spark.createDataFrame([(text,)], "q string")
    assert rows(df.select(Q.extract_asset("q"), Q.extract_timeframe("q"))) == [(asset, timeframe)]


def test_short_forms_and_definitions():
    assert [Q.normalize_timeframe(x) for x in ("15m", "1H", "1m", "odd")] == ["15-minute", "1-hour", "1-month", "odd"]
    assert Q.normalize_list(" btc,eth,,btc ", upper=True) == ["BTC", "ETH"]
    made = Q.kinds_from_json('[{"key": "k", "keywords": ["x"], "assets": {"A": ["a"]}, "timeframes": [{"name": "n", "phrases": ["p"]}]}]')
    assert made[0].category == "culture"
    with pytest.raises(ValueError, match="keywords"):
        Q.kinds_from_json('[{"key": "k"}]')


@pytest.mark.parametrize(
    "text,seconds",
    [("2026-04-20T20:35:00Z", 1776717300), ("2026-04-20 20:35:27+00", 1776717327), ("2026-04-19T20:36:55.65102Z", 1776631015), ("2026-04-20T20:35:00", 1776717300), ("2026-04-20T22:35:00+02:00", 1776717300), ("2026-04-20", 1776643200), ("2026-04-20T20:35:00.123456789-05", 1776735300), ("nonsense", None), ("", None), (None, None)],
)
def test_times(spark, text, seconds):
    assert rows(spark.createDataFrame([(text,)], "t string").select(S.iso_seconds("t"))) == [(seconds,)]


def test_market_normalization(spark):
    def market(name, prices=None, names=("Up", "Down"), ids=("1", "2"), **more):
        lists = {"outcomes": names, "clobTokenIds": ids} | ({"outcomePrices": prices, "closed": True} if prices else {})
        made = {k: json.dumps(v) if isinstance(v, tuple) else v for k, v in lists.items()}
        return {"id": name, "question": "Bitcoin Up or Down - 1 hour", "startDate": "2026-01-01T00:00:00Z", "endDate": "2026-01-01T01:00:00Z", "volume": "12.5"} | made | more

    flags = [{"winner": won, "tokenId": token, "outcome": side} for side, token, won in (("Up", "7", False), ("Down", "8", True))]
    raw = [
        market("won", ("0.99", "0.01")),
        market("lost", ("0.01", "0.99")),
        market("close", ("0.989", "0.011")),
        market("flag", tokens=flags, volume="x"),
        market("odd", names=("Left", "Right")),
        market("blank", ids=("1", "")),
        market("late", endDate="2025-01-01T00:00:00Z"),
        market("none", question="Will it rain?"),
        market("tweets", ("1", "0"), ("Yes", "No"), question="Elon Musk tweets March 27 to April 3, 2026", slug="elon-240-plus", groupItemTitle="240+", groupItemThreshold="12"),
    ]
    df = M.normalize_markets(spark.createDataFrame([{k: v for k, v in r.items()} for r in raw], M.RAW))
    out = {r.market_id: r for r in df.collect()}
    assert set(out) == {"won", "lost", "close", "flag", "tweets"}
    assert [out[k].resolution for k in ("won", "lost", "close", "flag", "tweets")] == [1, 0, None, 0, 1]
    assert (out["flag"].up_token_id, out["flag"].down_token_id, out["flag"].volume) == ("7", "8", 0.0)
    assert (out["tweets"].event_slug, out["tweets"].bucket_index, out["tweets"].category, out["tweets"].timeframe) == ("elon", 12, "culture", "7-day")
    assert M.token_dimension(df).where("market_id = 'won'").count() + M.token_dimension(df).where("market_id = 'flag'").count() >= 2


def test_fills(spark):
    tokens = spark.createDataFrame([("T", "m", "Up", "BTC", "1-hour"), ("U", "m", "Down", "BTC", "1-hour")], "token_id string, market_id string, outcome string, crypto string, timeframe string")
    names = "transactionHash string, timestamp string, orderHash string, makerAssetId string, takerAssetId string, makerAmountFilled string, takerAmountFilled string"
    data = [("a", "10", "h", "T", "0", "2000000", "1000000"), ("b", "10", "", "0", "U", "500000", "1000000"), ("c", "10", "h", "T", "U", "1", "1"), ("d", "10", "h", "0", "X", "1", "1"), ("e", "10", "h", "0", "T", "3", "2"), ("f", "10", "h", "0", "T", "0", "2"), ("g", "x", "h", "0", "T", "1", "2"), ("h", "10", "h", "0", "T", "7", "7")]
    out = W.decode_fills(spark.createDataFrame(data, names), tokens)
    assert rows(out, "tx_hash", "side", "price", "size_usdc", "order_hash", "timestamp_ms") == [("a", "SELL", 0.5, 1.0, "h", 10000), ("b", "BUY", 0.5, 0.5, None, 10000), ("h", "BUY", 1.0, 7e-06, "h", 10000)]


def test_validation(spark):
    data = [("1-hour", "m", 1, 0.5, 0.5, 0), ("1-hour", "m", 3, float("nan"), 0.5, 1), ("1-hour", "m", 2, 1.2, 0.5, 2), ("1-hour", "m", 2, 0.5, 0.2, 3), ("5-minute", "n", 1, 0.5, 0.5, 4), ("5-minute", "n", 2, 0.4, 0.6, 5)]
    out = quality.validate_prices(spark.createDataFrame(data, "timeframe string, market_id string, timestamp bigint, up_price double, down_price double, o int"), ["o"])
    got = {r.timeframe: r for r in out.collect()}
    assert got["5-minute"].ok and not got["1-hour"].ok
    bad = got["1-hour"]
    assert (bad.missing_up, bad.out_of_range, bad.off_sum, bad.unordered_markets, bad.repeated_keys) == (1, 1, 2, 1, 1)


def test_views_of_what_exists(spark, tmp_path):
    root = str(tmp_path)
    Wr.copy_to(canonical(spark.createDataFrame([("m", "q")], "market_id string, question string"), MARKETS), f"{root}/markets.parquet")
    assert register_views(spark, root) == ["markets"]
    assert rows(query(spark, "SELECT market_id, resolution, fee_rate_bps, slug FROM markets")) == [("m", -1, -1, "")]
    with pytest.raises(Exception, match="ticks"):
        query(spark, "SELECT * FROM ticks").collect()
    assert markdown(query(spark, "SELECT 1 AS a")) == "| a |\n|---|\n| 1 |"
    assert markdown(query(spark, "SELECT 1 AS a WHERE false")) == "(no results)"


def test_tick_consolidation(spark, tmp_path):
    root = str(tmp_path)
    schema = "market_id string, crypto string, timeframe string, timestamp_ms bigint, token_id string, tx_hash string, log_index int, price double, source string"
    a = [("m1", "BTC", "1-hour", 1000, "t", "0xabc", 1, 0.55, "onchain"), ("m1", "BTC", "1-hour", 2000, "t", "0xdef", 2, 0.6, "onchain")]
    b = [("m1", "BTC", "1-hour", 1000, "t", "0xabc", 1, 0.57, "websocket"), ("m2", "ETH", "1-hour", 3000, "t", "0x999", 1, 0.42, "websocket")]
    for part in (a, b):
        Wr.append_ticks_only(spark.createDataFrame(part, schema), root)
    assert C.consolidate_ticks(spark, root) > 1
    out = read_drifting(spark, f"{root}/ticks", TICKS)
    assert rows(out.select("market_id", "timestamp_ms", F.round(F.col("price").cast("double"), 2), "source")) == [("m1", 1000, 0.57, "websocket"), ("m1", 2000, 0.6, "onchain"), ("m2", 3000, 0.42, "websocket")]
    assert C.consolidate_ticks(spark, root) == 0
    assert load_ticks_for_market(spark, f"{root}/ticks", "m1", timeframe="1-hour", crypto="BTC").count() == 2
    # the same shard again is a second part, until compaction folds the partition
    Wr.append_ticks_only(spark.createDataFrame(b[:1], schema), root)
    C.consolidate_ticks(spark, root)
    assert read_drifting(spark, f"{root}/ticks", TICKS).count() == 4
    C.consolidate_ticks(spark, root, compact_at=2)
    assert read_drifting(spark, f"{root}/ticks", TICKS).count() == 3
    assert Wr.schema_version(spark.read.parquet(f"{root}/ticks")) == 5


def test_other_consolidations(spark, tmp_path):
    root = str(tmp_path)
    prices = "market_id string, timestamp bigint, up_price double, down_price double, crypto string, timeframe string"
    for i in range(5):
        Wr.append_staged(spark.createDataFrame([("m1", 100, 0.5 + 0.01 * i, 0.4, "BTC", "1-hour"), ("m1", 200, 0.5, 0.5, "BTC", "1-hour"), ("m2", 100, 0.5, 0.5, "BTC", "1-hour")], prices), root, PRICES)
    C.consolidate_prices(spark, root)
    assert rows(spark.read.parquet(f"{root}/prices").where("market_id = 'm1' AND timestamp = 100").select(F.round(F.col("up_price").cast("double"), 2))) == [(0.54,)]
    for part in ([(1000, "btcusdt", 1.0, "binance"), (2000, "btcusdt", 2.0, "binance")], [(2000, "btcusdt", 5.0, "binance"), (3000, "btcusdt", 3.0, "binance")]):
        Wr.append_staged(spark.createDataFrame(part, "ts_ms bigint, symbol string, price double, source string"), root, SPOT_PRICES)
        C.consolidate_spot_prices(spark, root)
    assert rows(spark.read.parquet(f"{root}/spot_prices"), "ts_ms", "price") == [(1000, 1.0), (2000, 5.0), (3000, 3.0)]
    assert rows(spot_lookup(spark, f"{root}/spot_prices"), "crypto", "ts_ms") == [("BTC", 1000), ("BTC", 2000), ("BTC", 3000)]
    book = "ts_ms bigint, market_id string, token_id string, outcome string, best_bid double, best_ask double, best_bid_size double, best_ask_size double, local_recv_ts_ns bigint, crypto string, timeframe string"
    Wr.append_staged(spark.createDataFrame([(1, "m", "t", "Up", 0.40, 0.6, 1.0, 1.0, 5, "BTC", "1-hour"), (1, "m", "t", "Up", 0.45, 0.6, 1.0, 1.0, 9, "BTC", "1-hour"), (2, "m", "t", "Up", 0.3, 0.6, 1.0, 1.0, None, "BTC", "1-hour")], book), root, ORDERBOOK)
    C.consolidate_orderbook(spark, root)
    assert rows(spark.read.parquet(f"{root}/orderbook").select("ts_ms", F.round(F.col("best_bid").cast("double"), 2))) == [(1, 0.45), (2, 0.3)]
    beats = "ts_ms bigint, source string, shard_key string, event_type string, last_event_age_ms bigint"
    Wr.append_staged(spark.createDataFrame([(1, "a", "s", "x", 1), (1, "a", "s", "y", None), (2, "a", "s", "x", 1)], beats), root, HEARTBEATS)
    C.consolidate_heartbeats(spark, root)
    assert spark.read.parquet(f"{root}/heartbeats").count() == 2
    assert set(C.publish(spark, root, f"{root}-out")) == {"prices", "spot_prices", "orderbook", "heartbeats"}
    assert spark.read.parquet(f"{root}-out/prices").count() == 3


def test_unreadable_and_drifting_files(spark, tmp_path):
    root = str(tmp_path / "ticks")
    spark.createDataFrame([("m", 1, "h")], "market_id string, timestamp_ms bigint, order_hash string").write.parquet(f"{root}/crypto=SOL/timeframe=4-hour/a")
    spark.createDataFrame([("n", 2)], "market_id string, timestamp_ms int").withColumn("order_hash", F.lit(None).cast("int")).withColumn("crypto", F.lit("wrong")).write.parquet(f"{root}/crypto=ETH/timeframe=1-hour/b")
    (tmp_path / "ticks/crypto=SOL/timeframe=4-hour/broken.parquet").write_bytes(b"no parquet")
    assert rows(read_drifting(spark, root, TICKS), "market_id", "timestamp_ms", "order_hash") == [("m", 1, "h"), ("n", 2, None)]


def test_logs(spark, tmp_path):
    (tmp_path / "ws_reconnects.jsonl").write_text('{"ts": 1.5, "shard_key": "a"}\n\nbroken\n{"ts": 0, "shard_key": "a"}\n')
    (tmp_path / "ws_reconnects.jsonl.1").write_text('{"ts": 0.5, "shard_key": "a"}\n{"ts": 3, "shard_key": ""}\n')
    assert rows(reconnects(spark, str(tmp_path)), "ts") == [(0.5,), (1.5,)]
    (tmp_path / "log.txt").write_text("x Window [5, 9] failed\nWindow [1, 4] failed: no\nWindow [5, 9] failed\n")
    assert rows(failed_windows(spark, str(tmp_path / "log.txt"))) == [(1, 4), (5, 9)]


def test_locks_and_checkpoints(spark, tmp_path):
    import socket

    root, lock = str(tmp_path), tmp_path / "_lock"
    with lake.single_writer(spark, root), lake.single_writer(spark, root):
        assert lock.exists()
    assert not lock.exists()
    lock.write_text(f"{socket.gethostname()}:999999999")
    with lake.single_writer(spark, root):
        pass
    lock.write_text("another-machine:1")
    with pytest.raises(TimeoutError, match="another-machine"), lake.single_writer(spark, root, 0.2):
        pass
    # consolidation waits for the lock, so a shard is not folded twice
    Wr.append_staged(spark.createDataFrame([(1, "a", "b", 1.0)], "ts_ms bigint, symbol string, source string, price double"), root, SPOT_PRICES)
    from unittest.mock import patch

    with pytest.raises(TimeoutError), patch.object(C, "single_writer", lambda s, r: lake.single_writer(s, r, 0.2)):
        C.consolidate_spot_prices(spark, root)
    lock.unlink()
    assert C.consolidate_spot_prices(spark, root) > 0 and not lock.exists()
    path = str(tmp_path / "mark")
    assert C.load_checkpoint(spark, path) is None
    for value in (5, 7):
        C.save_checkpoint(spark, path, value)
        assert C.load_checkpoint(spark, path) == value


def test_no_room(spark, tmp_path):
    lake.require_room(spark, str(tmp_path / "not" / "there"), 1)
    with pytest.raises(lake.NoRoom):
        lake.require_room(spark, str(tmp_path), 1 << 60)


def test_culture_prices_are_folded(spark, tmp_path):
    root = str(tmp_path)
    schema = "market_id string, timestamp bigint, token_id string, outcome string, price double, crypto string, timeframe string"
    for price in (0.25, 0.5):
        Wr.append_staged(spark.createDataFrame([("m", 1, "t", "240+", price, "ELON-TWEETS", "7-day"), ("m", 1, "u", "0-99", 0.125, "ELON-TWEETS", "7-day")], schema), root, CULTURE_PRICES)
    assert C.consolidate_all(spark, root)["culture_prices"] > 1
    out = spark.read.parquet(f"{root}/prices")
    assert rows(out.select("outcome", F.col("price").cast("double"))) == [("0-99", 0.125), ("240+", 0.5)]
    assert C.consolidate_all(spark, root)["culture_prices"] == 0


def test_replaced_partitions_leave_others_alone(spark, tmp_path):
    root, schema = f"{tmp_path}/prices", "market_id string, timestamp bigint, up_price float, down_price float, crypto string, timeframe string"
    first = spark.createDataFrame([("a", i, 0.5, 0.5, c, "1-hour") for i in range(50) for c in ("BTC", "ETH")], schema)
    Wr.replace_partitions(first, root, PRICES, ["market_id"])
    before = {f.name for f in (tmp_path / "prices/crypto=ETH/timeframe=1-hour").iterdir()}
    # read from the partition that is replaced
    Wr.replace_partitions(spark.read.parquet(root).where("crypto = 'BTC' AND timestamp < 10"), root, PRICES)
    assert {r.crypto: r["count"] for r in spark.read.parquet(root).groupBy("crypto").count().collect()} == {"BTC": 10, "ETH": 50}
    assert {f.name for f in (tmp_path / "prices/crypto=ETH/timeframe=1-hour").iterdir()} == before
    assert sorted(p.name for p in tmp_path.iterdir()) == ["prices"]


def test_repeated_batches_are_staged_once(spark, tmp_path):
    schema = "market_id string, timestamp_ms bigint, token_id string, price double, crypto string, timeframe string"
    batch = lambda *ids: spark.createDataFrame([(f"m{i}", i, "t", 0.5, "BTC" if i % 2 else "ETH", "1-hour") for i in ids], schema)
    root = str(tmp_path)
    for number, ids in ((0, (1, 2, 3)), (1, (4, 5)), (1, (4, 5)), (0, (1, 2, 3))):
        Wr.append_batch(batch(*ids), root, TICKS, "trades", number)
    staged = read_drifting(spark, f"{root}/_staging/ticks", TICKS)
    assert sorted(r.market_id for r in staged.collect()) == ["m1", "m2", "m3", "m4", "m5"]
    assert C.consolidate_ticks(spark, root) >= 3 and read_drifting(spark, f"{root}/ticks", TICKS).count() == 5
