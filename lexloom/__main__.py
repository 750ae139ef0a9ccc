"""``python -m lexloom list``, ``sql NAME`` or ``run NAME DATA [--rows N] [--out FOLDER]``."""

from __future__ import annotations

import argparse

from .plans import registry
from .session import get_session, ship_package


def main(words: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lexloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    commands.add_parser("sql", help="a query's SQL").add_argument("name")
    run = commands.add_parser("run", help="run a query over a folder of Parquet tables")
    run.add_argument("name")
    run.add_argument("data")
    run.add_argument("--rows", type=int, default=20, help="rows that are shown; the query itself runs over whole tables")
    run.add_argument("--out", help="write the whole result here as Parquet instead")
    args = parser.parse_args(words)
    if args.command == "list":
        print("\n".join(sorted(registry.QUERIES)))
        return 0
    if args.name not in registry.QUERIES:
        parser.error(f"no query {args.name!r}")
    if args.command == "sql":
        print(registry.ORACLE_SQL.get(args.name, "-- no SQL can express it"))
        return 0
    spark = get_session()
    ship_package(spark)
    result = registry.QUERIES[args.name](spark, args.data.rstrip("/"))
    if args.out:
        result.write.parquet(args.out)
    else:
        result.show(args.rows, truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
