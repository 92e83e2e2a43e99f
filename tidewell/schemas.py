"""Table schemas of the lakehouse and what stands in for missing values."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import StructType

SCHEMA_VERSION = 5
PARTITIONS = ("crypto", "timeframe")
TIMEFRAME_SECONDS = {"5-minute": 300, "15-minute": 900, "1-hour": 3600, "4-hour": 14400, "4-day": 345600, "7-day": 604800, "1-month": 2592000}


@dataclass(frozen=True)
class Table:
    """A stored table: column types, defaults of nulls, partition columns, and the key of its rows."""

    name: str
    columns: dict[str, str]
    defaults: dict[str, object] = field(default_factory=dict)
    partitions: tuple[str, ...] = ()
    key: tuple[str, ...] = ()

    @property
    def schema(self) -> StructType:
        """All columns with the partition columns behind."""
        return StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in {**self.columns, **{p: "string" for p in self.partitions}}.items()))

    @property
    def body(self) -> list[str]:
        return [c for c in self.columns if c not in self.partitions]


_MARKET = {"market_id": "string", "question": "string", "crypto": "string", "timeframe": "string", "volume": "float", "resolution": "tinyint", "start_ts": "bigint", "end_ts": "bigint", "closed_ts": "bigint", "condition_id": "string"}
_MARKET_DEFAULTS = {"volume": 0.0, "resolution": -1, "start_ts": 0, "end_ts": 0, "closed_ts": 0, "slug": ""}

MARKETS = Table("markets", {**_MARKET, "up_token_id": "string", "down_token_id": "string", "slug": "string", "fee_rate_bps": "smallint"}, {**_MARKET_DEFAULTS, "fee_rate_bps": -1}, key=("market_id",))
CULTURE_MARKETS = Table(
    "culture_markets",
    {**_MARKET, "tokens": "string", "slug": "string", "event_slug": "string", "bucket_index": "int", "bucket_label": "string"},
    {**_MARKET_DEFAULTS, "tokens": "{}", "event_slug": "", "bucket_index": -1, "bucket_label": ""},
    key=("market_id",),
)
PRICES = Table("prices", {"market_id": "string", "timestamp": "bigint", "up_price": "float", "down_price": "float"}, {"timestamp": 0}, PARTITIONS, ("market_id", "timestamp"))
CULTURE_PRICES = Table("culture_prices", {"market_id": "string", "timestamp": "bigint", "token_id": "string", "outcome": "string", "price": "float"}, {"timestamp": 0}, PARTITIONS, ("market_id", "timestamp", "outcome"))
TICKS = Table(
    "ticks",
    {
        "market_id": "string",
        "timestamp_ms": "bigint",
        "token_id": "string",
        "outcome": "string",
        "side": "string",
        "price": "float",
        "size_usdc": "float",
        "tx_hash": "string",
        "block_number": "int",
        "log_index": "int",
        "source": "string",
        "spot_price_usdt": "float",
        "spot_price_ts_ms": "bigint",
        "local_recv_ts_ns": "bigint",
        "order_hash": "string",
    },
    {"timestamp_ms": 0, "price": 0.0, "size_usdc": 0.0, "tx_hash": "", "block_number": 0, "log_index": 0, "source": ""},
    PARTITIONS,
    tuple("market_id timestamp_ms token_id tx_hash log_index order_hash local_recv_ts_ns".split()),
)
SPOT_PRICES = Table("spot_prices", {"ts_ms": "bigint", "symbol": "string", "price": "double", "source": "string"}, {}, (), ("ts_ms", "symbol", "source"))
ORDERBOOK = Table(
    "orderbook",
    {"ts_ms": "bigint", "market_id": "string", "token_id": "string", "outcome": "string", "best_bid": "float", "best_ask": "float", "best_bid_size": "float", "best_ask_size": "float", "local_recv_ts_ns": "bigint"},
    {},
    PARTITIONS,
    ("ts_ms", "market_id", "token_id", "outcome"),
)
HEARTBEATS = Table("heartbeats", {"ts_ms": "bigint", "source": "string", "shard_key": "string", "event_type": "string", "last_event_age_ms": "bigint"}, {"last_event_age_ms": -1}, (), ("ts_ms", "source", "shard_key"))
RECONNECTS = "ts double, shard_key string, kind string, detail string, fd bigint, session_s double"

TABLES = {t.name: t for t in (MARKETS, CULTURE_MARKETS, PRICES, CULTURE_PRICES, TICKS, SPOT_PRICES, ORDERBOOK, HEARTBEATS)}
