"""What a market's question says: its kind, its asset and its timeframe.

Definitions are data; they are compiled into column expressions, so that classifying a billion questions stays inside
the JVM. Kinds, assets and timeframes are tried in the order of their definition and the first that fits counts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import let

MONTHS = "January February March April May June July August September October November December".split()
_CLOCK = r"(\d\d?):(\d\d)\s*([AP]M)"
_RANGE = rf"(?i){_CLOCK}\s*-\s*{_CLOCK}"
_HOUR = r"(?i)\b\d\d?[AP]M\s+ET\b"
_DAY = r"(\d\d?)"
_DATES = rf"(?i)([a-z]+)\s+{_DAY}(?:\s+to\s+|\s*-\s*)(?:([a-z]+)\s+)?{_DAY},\s+(\d{{4}})"
_MONTH = rf"(?i)\bin\s+(?:{'|'.join(MONTHS)})\s+\d{{4}}\b"


Phrases = tuple[str, ...]


@dataclass(frozen=True)
class Timeframe:
    """A horizon: its phrases in questions, its short forms on a command line, and what else implies it."""

    name: str
    phrases: Phrases
    short: Phrases
    minutes: int | None = None
    by_hour: bool = False
    by_month: bool = False


@dataclass(frozen=True)
class Kind:
    """A kind of market: binary ones have an up and a down side, others any outcomes."""

    key: str
    keywords: Phrases
    assets: dict[str, Phrases]
    timeframes: tuple[Timeframe, ...]
    up: Phrases = ()
    down: Phrases = ()

    @property
    def category(self) -> str:
        return "crypto" if self.up else "culture"


def _spelled(n: int, unit: str) -> tuple[str, ...]:
    return f"{n}-{unit}", f"{n} {unit}"


_SPANS = [(a, b) for a, b in ((23, 25), (26, 28))]
KINDS: tuple[Kind, ...] = (
    Kind(
        "crypto-up-down",
        ("up or down",),
        {k: tuple(v.split(",")) for k, v in {"BTC": "bitcoin,btc", "ETH": "ethereum,eth", "SOL": "solana,sol", "BNB": "bnb,binance coin", "XRP": "xrp,ripple", "DOGE": "dogecoin,doge", "HYPE": "hype,hyperliquid"}.items()},
        (
            *(Timeframe(f"{n}-minute", (*_spelled(n, "minute"), f"{n} min"), (f"{n}m", f"{n}min", f"{n}-minute", f"{n}-min"), n) for n in (15, 5)),
            Timeframe("4-hour", _spelled(4, "hour"), ("4h", "4hr", "4-hour"), 240),
            Timeframe("1-hour", (*_spelled(1, "hour"), "hourly", "hour"), tuple("1h 1hr 1-hour hourly".split()), 60, by_hour=True),
        ),
        ("up", "yes"),
        ("down", "no"),
    ),
    Kind(
        "elon-musk-tweets",
        ("# tweets", "elon musk"),
        {"ELON-TWEETS": ("elon musk", "tweets")},
        (
            Timeframe("7-day", tuple(f"march 17 {x} march 24" for x in ("-", "to")), ("7d", "7-day"), 7 * 1440),
            Timeframe("4-day", tuple(f"march {a} {x} march {b}" for x in ("-", "to") for a, b in _SPANS), ("4d", "4-day", "2d"), 4 * 1440),
            Timeframe("1-month", ("monthly",), ("1m", "1-month", "month"), by_month=True),
        ),
    ),
)


def kinds_from_json(text: str) -> tuple[Kind, ...]:
    """Kinds from a JSON list of objects with the fields of Kind and Timeframe; a fault names the field."""
    out = []
    for i, d in enumerate(json.loads(text)):
        missing = [f for f in ("key", "keywords", "assets", "timeframes") if not d.get(f)]
        if missing:
            raise ValueError(f"definition {i} lacks {', '.join(missing)}")
        if bool(d.get("up")) != bool(d.get("down")):
            raise ValueError(f"definition {i} has one side only")
        frames = tuple(Timeframe(t["name"], tuple(t["phrases"]), tuple(t.get("short", ())), t.get("minutes"), t.get("by_hour", False), t.get("by_month", False)) for t in d["timeframes"])
        out.append(Kind(d["key"], tuple(d["keywords"]), {k: tuple(v) for k, v in d["assets"].items()}, frames, tuple(d.get("up", ())), tuple(d.get("down", ()))))
    if len({k.key for k in out}) != len(out):
        raise ValueError("two definitions have one key")
    return tuple(out)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def has_phrase(text: Column | str, phrases: tuple[str, ...] | list[str]) -> Column:
    """Whether any phrase stands in the text between word boundaries, in any case.

    The pattern is tried only where a phrase's letters are in the text at all, which a plain search finds out.
    """
    if not phrases:
        return F.lit(False)
    any_of = "|".join(re.sub(r"([^\w\s])", r"\\\1", p) for p in phrases)
    low, maybe = F.lower(_c(text)), F.lit(False)
    for p in phrases:
        maybe = maybe | low.contains(p.lower())
    return maybe & _c(text).rlike(rf"(?i)\b(?:{any_of})\b")


def first_match(text: Column | str, choices: dict[str, tuple[str, ...]]) -> Column:
    """The first choice (in order) one of whose phrases is in the text; null if none."""
    return F.coalesce(*[F.when(has_phrase(text, phrases), F.lit(name)) for name, phrases in choices.items()], F.lit(None).cast("string"))


def kind_of(text: Column | str, kinds: tuple[Kind, ...] = KINDS) -> Column:
    return first_match(text, {k.key: k.keywords for k in kinds})


def range_minutes(text: Column | str) -> Column:
    """Minutes from the first to the second clock time of "h:mmAM - h:mmPM"; past midnight if it would not be positive."""

    def clock(found: Column, at: int) -> Column:
        hour, minute, half = (F.regexp_extract(found, _RANGE, at + i) for i in range(3))
        h, m = hour.try_cast("int"), minute.try_cast("int")
        minutes = (h % 12) * 60 + m + F.when(F.upper(half) == "PM", 720).otherwise(0)
        return F.when(h.between(1, 12) & (m < 60), minutes)

    gap = lambda found: F.pmod(clock(found, 4) - clock(found, 1) - 1, F.lit(1440)) + 1
    return F.when(_c(text).contains(":"), let(F.regexp_extract(_c(text), _RANGE, 0), lambda found: F.when(found != "", gap(found)))).cast("int")


def dates_minutes(text: Column | str) -> Column:
    """Minutes from the first to the second date of "Month d to [Month] d, yyyy"; into the next year if it would be negative. Null where a month's name is none."""

    def date(month: Column, d: Column, y: Column) -> Column:
        at = F.array_position(F.array(*[F.lit(m.lower()) for m in MONTHS]), F.lower(month))
        return F.when(at > 0, F.unix_date(F.try_to_date(F.format_string("%s-%02d-%s", y, at.cast("int"), F.lpad(d, 2, "0")), "yyyy-MM-dd")))

    def days(found: Column) -> Column:
        one, day, two, last, year = (F.regexp_extract(found, _DATES, i) for i in range(1, 6))
        two = F.when(two == "", one).otherwise(two)
        start, same = date(one, day, year), date(two, last, year)
        return F.when(same < start, date(two, last, (year.try_cast("int") + 1).cast("string")) - start).otherwise(same - start)

    return (F.when(_c(text).contains(","), let(F.regexp_extract(_c(text), _DATES, 0), lambda found: F.when(found != "", days(found)))) * 1440).cast("int")


def timeframe_of(text: Column | str, kind: Kind) -> Column:
    """By phrase, else by the length of a clock or date range, else by a single hour, else by a month."""
    named = first_match(text, {t.name: t.phrases for t in kind.timeframes})
    lengths = {t.minutes: t.name for t in reversed(kind.timeframes) if t.minutes is not None}
    known = F.create_map(*[F.lit(x) for pair in lengths.items() for x in pair]) if lengths else F.lit(None).cast("map<int,string>")
    by_length = F.try_element_at(known, F.coalesce(range_minutes(text), dates_minutes(text)))

    def flagged(pattern: str, flag: str) -> list[Column]:
        names = [t.name for t in kind.timeframes if getattr(t, flag)]
        return [F.when(_c(text).rlike(pattern), F.lit(names[0]))] if names else []

    return F.coalesce(named, by_length, *flagged(_HOUR, "by_hour"), *flagged(_MONTH, "by_month"))


def _by_kind(text: Column | str, kinds: tuple[Kind, ...], of: Callable[[Kind], Column], default: Kind | None, key: Column | None = None) -> Column:
    def choose(key: Column) -> Column:
        out = None
        for k in kinds:
            out = F.when(key == k.key, of(k)) if out is None else out.when(key == k.key, of(k))
        return out.otherwise(of(default)) if default else out

    return choose(key if key is not None else kind_of(text, kinds))


def extract_timeframe(text: Column | str, kinds: tuple[Kind, ...] = KINDS, strict: bool = False, key: Column | None = None) -> Column:
    """The timeframe by the question's kind (key, if it is known); a question of no kind is taken for the first kind unless strict."""
    return _by_kind(text, kinds, lambda k: timeframe_of(text, k), None if strict else kinds[0], key)


def extract_asset(text: Column | str, kinds: tuple[Kind, ...] = KINDS, strict: bool = False, key: Column | None = None) -> Column:
    return _by_kind(text, kinds, lambda k: first_match(text, k.assets), None if strict else kinds[0], key)


def normalize_timeframe(value: str, kinds: tuple[Kind, ...] = KINDS) -> str:
    """A command line's short form as the timeframe's name; others as they are."""
    return next((t.name for k in kinds for t in k.timeframes if value.strip().lower() in t.short), value)


def normalize_list(text: str | None, upper: bool = False, timeframes: bool = False) -> list[str]:
    """A comma-separated list of a command line, trimmed, without blanks and repeats."""
    items = [x.strip() for x in (text or "").split(",") if x.strip()]
    items = [x.upper() for x in items] if upper else [normalize_timeframe(x) for x in items] if timeframes else items
    return list(dict.fromkeys(items))
