"""Command line: ``python -m barloom.cli <command>`` over parquet tables."""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="barloom")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("validate", help="findings on an expression, without data")
    c.add_argument("expression")
    c = sub.add_parser("catalog", help="the published catalogs")
    c.add_argument("name", choices=["alpha101", "features158"])
    sub.add_parser("operators", help="the registered operators")
    for name, text in (("evaluate", "values of a factor"), ("backtest", "one report row a factor"), ("portfolio", "metrics of a portfolio that trades a factor")):
        c = sub.add_parser(name, help=text)
        c.add_argument("expression", nargs="+" if name == "backtest" else None)
        c.add_argument("--panel", required=True, help="parquet with date, symbol and fields")
        c.add_argument("--groups", help="parquet with symbol and labels")
        c.add_argument("--out", help="parquet to write; else JSON lines are printed")
        if name == "portfolio":
            c.add_argument("--method", default="signal_prop")
            c.add_argument("--frequency", default="monthly")
    c = sub.add_parser("status", help="what a price store holds")
    c.add_argument("store")
    c = sub.add_parser("consolidate", help="few well-sized files from many small ones")
    c.add_argument("source")
    c.add_argument("out")
    c.add_argument("--format", default="parquet")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    say = lambda rows: [print(json.dumps(r, default=str, ensure_ascii=False)) for r in rows]
    if a.command == "validate":
        from barloom.sdk import diagnose

        found = diagnose(a.expression)
        say({"code": f.code, "name": f.name, "message": f.message, "span": f.span} for f in found)
        return int(any(f.name != "BARE_FIELD" for f in found))
    if a.command == "catalog":
        from barloom.library.catalogs import alpha101, features158

        say({"name": str(k), "expression": e} for k, e in (alpha101() if a.name == "alpha101" else features158()).items())
        return 0
    if a.command == "operators":
        from barloom.operators import builtin, registry  # noqa: F401

        say({"name": n} for n in registry.names())
        return 0
    from pyspark.sql import SparkSession

    spark = spark or SparkSession.builder.appName("barloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "consolidate":
        from barloom.curation.compaction import consolidate_files

        say([consolidate_files(spark, a.source, a.out, a.format)])
        return 0
    if a.command == "status":
        from barloom.sources.store import store_status

        say([store_status(spark.read.parquet(a.store)).first().asDict()])
        return 0
    from barloom.sdk import Session

    session = Session(spark.read.parquet(a.panel), spark.read.parquet(a.groups) if a.groups else None)
    if a.command == "evaluate":
        out = session.evaluate(a.expression)
    elif a.command == "backtest":
        out = session.backtest(list(a.expression))
    else:
        out = session.backtest_portfolio(a.expression, method=a.method, frequency=a.frequency)["metrics"]
    if a.out:
        out.write.parquet(a.out)
    else:
        say(json.loads(x) for x in out.toJSON().toLocalIterator())
    return 0


if __name__ == "__main__":
    sys.exit(main())
