"""Command line: query, profile, validate, audit, consolidate, publish.

    python -m tidewell.cli query --root DATA "SELECT ..." [--limit N]
    python -m tidewell.cli audit --heartbeats DIR --logs DIR [--previous MANIFEST] [--out DIR]
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .catalog import load_prices, load_ticks, markdown, query
from .operators.profile import profile
from .operators.quality import audit, manifest, new_gaps, validate_prices, worst
from .schemas import SPOT_PRICES
from .session import prepare
from .sources.hive import read_table
from .sources.logs import heartbeats, reconnects
from .storage.consolidate import consolidate_all, publish


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidewell", description=__doc__.splitlines()[0])
    sub = p.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query", help="ad-hoc SQL over the tables that exist")
    q.add_argument("sql")
    q.add_argument("--limit", type=int)
    for name, text in (("profile", "profile of the ticks"), ("validate", "price quality by timeframe"), ("consolidate", "fold staged shards"), ("publish", "copy consolidated tables")):
        s = sub.add_parser(name, help=text)
        if name == "publish":
            s.add_argument("target")
    for s in sub.choices.values():
        s.add_argument("--root", default="data")
    a = sub.add_parser("audit", help="gaps and bursts of the feeds; exit code 1 if there are new ones")
    a.add_argument("--heartbeats", required=True)
    a.add_argument("--logs", required=True)
    a.add_argument("--max-gap-ms", type=int, default=30_000)
    a.add_argument("--burst", type=int, default=5)
    a.add_argument("--window-s", type=float, default=60.0)
    a.add_argument("--previous")
    a.add_argument("--out")
    return p


def run_audit(spark: SparkSession, o: argparse.Namespace) -> int:
    """0: nothing (new) found, 1: findings."""
    found = audit(heartbeats(spark, o.heartbeats), reconnects(spark, o.logs), o.max_gap_ms, o.burst, o.window_s)
    if o.previous:
        before = spark.read.json(o.previous).select(F.explode("gaps").alias("g")).select("g.*")
        found["gaps"] = new_gaps(found["gaps"], before) if before.columns else found["gaps"]
    print(markdown(worst(found["gaps"], "gap_ms")), markdown(worst(found["bursts"], "n")), sep="\n\n")
    if o.out:
        manifest(found, o.out, max_gap_ms=o.max_gap_ms, burst_threshold=o.burst, window_s=o.window_s)
    return int(not found["gaps"].isEmpty() or not found["bursts"].isEmpty())


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    o = _parser().parse_args(argv)
    spark = prepare(spark or SparkSession.builder.appName("tidewell").getOrCreate())
    if o.command == "query":
        print(markdown(query(spark, o.sql, o.root, o.limit)))
    elif o.command == "profile":
        for name, part in profile(load_ticks(spark, f"{o.root}/ticks"), read_table(spark, f"{o.root}/spot_prices", SPOT_PRICES)).items():
            print(f"{name}\n{markdown(part)}\n")
    elif o.command == "validate":
        report = validate_prices(load_prices(spark, f"{o.root}/prices"))
        print(markdown(report))
        return int(report.isEmpty() or not report.where("NOT ok").isEmpty())
    elif o.command == "consolidate":
        print(consolidate_all(spark, o.root))
    elif o.command == "publish":
        print(publish(spark, o.root, o.target))
    else:
        return run_audit(spark, o)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
