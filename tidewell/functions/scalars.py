"""Scalar expressions shared by the parsers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def safe_double(x: Column | str) -> Column:
    """A finite double, or null."""
    v = _c(x).cast("string").try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def safe_long(x: Column | str) -> Column:
    """A whole number, or null."""
    return F.trim(_c(x).cast("string")).try_cast("bigint")


def iso_seconds(x: Column | str) -> Column:
    """Epoch seconds of an ISO-like time, rounded down; null if it is none.

    A space for the T, Z, a bare hour offset after a time, and any number of fraction digits are
    taken; a time without an offset is UTC. A bare date is midnight.
    """
    given = v = F.trim(_c(x))
    v = F.regexp_replace(v, r"^(\d{4}-\d{2}-\d{2}) +", "$1T")
    v = F.regexp_replace(v, r"[Zz]$", "+00:00")
    v = F.regexp_replace(v, r"(:\d{2}(?:\.\d+)?[+-]\d{2})$", "$1:00")
    v = F.regexp_replace(v, r"(\.\d{1,6})\d*", "$1")
    def seconds(v: Column) -> Column:
        shaped = v.rlike(r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d+)?)?([+-]\d{2}:\d{2})?)?$")
        zoned = v.contains("T") & v.rlike(r"[+-]\d{2}:\d{2}$")
        whole = F.when(zoned, v).when(v.contains("T"), F.concat(v, F.lit("+00:00"))).otherwise(F.concat(v, F.lit("T00:00:00+00:00")))
        return F.when(shaped, F.unix_seconds(F.try_to_timestamp(whole)))

    # nearly all times are of this shape, which needs no rewriting
    usual = given.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$")
    return F.when(usual, F.unix_seconds(F.try_to_timestamp(given))).otherwise(let(v, seconds))


def ms_to_s(x: Column | str) -> Column:
    return F.floor(_c(x) / 1000).cast("bigint")


def s_to_ms(x: Column | str) -> Column:
    return _c(x) * F.lit(1000).cast("bigint")


def ms_to_ns(x: Column | str) -> Column:
    return _c(x) * F.lit(1_000_000).cast("bigint")


def notional(size: Column | str, price: Column | str) -> Column:
    """size * price at six decimals; 0 for no size."""
    return F.when(_c(size) > 0, F.bround(_c(size) * _c(price), 6)).otherwise(F.lit(0.0))


def json_list(x: Column | str) -> Column:
    """A JSON array of scalars as strings; anything else is an empty array."""
    v = _c(x).cast("string")
    empty = F.array().cast("array<string>")
    return F.coalesce(F.when(F.ltrim(v).startswith("["), F.from_json(v, "array<string>")), empty)


def resolution_code(x: Column | str) -> Column:
    """1, 0, or -1 for unknown."""
    return F.coalesce(_c(x).cast("string").try_cast("double").cast("tinyint"), F.lit(-1).cast("tinyint"))


def text_or_null(x: Column | str) -> Column:
    """The text, with '' as null."""
    return F.nullif(_c(x).cast("string"), F.lit(""))


def token_json(x: Column | str) -> Column:
    """A map as JSON text."""
    return F.to_json(_c(x))


_SYMBOLS = ("BTC", "ETH", "SOL", "BNB", "XRP", "DOGE", "HYPE")


def exchange_symbol(x: Column | str) -> Column:
    """BTC -> btcusdt, for known assets; else null."""
    v = F.upper(_c(x))
    return F.when(v.isin(*_SYMBOLS), F.concat(F.lower(v), F.lit("usdt")))


def oracle_symbol(x: Column | str) -> Column:
    """btcusdt -> btc/usd; else null."""
    v = F.lower(_c(x))
    return F.when(v.endswith("usdt"), F.concat(F.regexp_replace(v, "usdt$", ""), F.lit("/usd")))
