"""Command line: ``python -m palimpsest list`` and ``python -m palimpsest run QUERY FOLDER [--limit N]``.

Exit codes: 0 done, 1 a query failed, 2 the command or query is not known, 130 interrupted.
"""

from __future__ import annotations

import argparse
import difflib
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="palimpsest", description="Queries over a folder of tables.")
    sub = parser.add_subparsers(dest="command")
    sub.add_parser("list", help="names of all queries")
    run = sub.add_parser("run", help="run a query and show its rows")
    run.add_argument("query")
    run.add_argument("folder")
    run.add_argument("--limit", type=int, default=20, help="rows shown; 0 counts them only")
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    from palimpsest.plans import registry

    names = registry.queries()
    if args.command == "list":
        print("\n".join(sorted(names)))
        return 0
    if args.command != "run" or args.limit < 0:
        parser.print_usage(sys.stderr)
        return 2
    if args.query not in names:
        near = difflib.get_close_matches(args.query, names, 3)
        print(f"no query {args.query!r}" + (f"; did you mean {', '.join(near)}?" if near else ""), file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    try:
        df = names[args.query](SparkSession.builder.appName("palimpsest").getOrCreate(), args.folder)
        print(df.count()) if args.limit == 0 else df.show(args.limit, truncate=False)
    except KeyboardInterrupt:
        return 130
    except Exception as e:
        print(f"{args.query}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
