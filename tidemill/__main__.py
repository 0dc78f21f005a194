"""A small command line: ``python -m tidemill --root DIR [--branch NAME] [--attach NAME=PATH] COMMAND ...``."""

from __future__ import annotations

import argparse
import sys

from tidemill.errors import EngineError
from tidemill.session import get_session
from tidemill.store.connection import Connection, Database, Result


def show(result: Result) -> None:
    if result.columns:
        print("\t".join(result.columns))
        for row in result.rendered():
            print("\t".join("" if v is None else v for v in row))
    else:
        print(f"{result.changes} rows changed")


def run(c: Connection, args: argparse.Namespace) -> None:
    if args.command == "sql":
        for text in args.text:
            show(c.query(text))
    elif args.command == "tables":
        for t in sorted(c.manifest.tables.values(), key=lambda t: t.name):
            print(t.name)
    elif args.command == "describe":
        show(Result(c.catalog().where(f"lower(tbl) = '{c.manifest.table(args.table).name.lower()}'")))
    elif args.command == "stats":
        show(Result(c.stats()))
    elif args.command == "policies":
        for p in c.policies():
            print(p["table"], p["name"], p["command"], ",".join(p["roles"]) or "all", p["using"] or "", p["check"] or "", sep="\t")
    elif args.command == "seed":
        # A script may lie wherever Spark reads.
        print(c.exec("\n".join(r.value for r in c.spark.read.text(args.script, wholetext=True).collect())), "rows changed by the last statement")
    elif args.command == "export":
        from tidemill.sources.export import materialize

        print(materialize(c, args.table, args.folder, args.columns.split(",") if args.columns else (), args.format))
    elif args.command == "branch":
        if args.drop:
            c.db.drop_branch(args.drop)
        elif args.name:
            c.create_branch(args.name)
        for b in c.db.branches():
            print(b)
    elif args.command == "vacuum":
        print(c.db.log.vacuum(args.keep), "files deleted")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemill", description=__doc__)
    p.add_argument("--root")
    p.add_argument("--branch", default="main")
    p.add_argument("--attach", action="append", default=[], help="NAME=PATH of a Parquet table")
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("sql").add_argument("text", nargs="+")
    for name in ("tables", "stats", "policies"):
        commands.add_parser(name)
    commands.add_parser("describe").add_argument("table")
    commands.add_parser("seed").add_argument("script")
    export = commands.add_parser("export")
    export.add_argument("table")
    export.add_argument("folder")
    export.add_argument("--columns")
    export.add_argument("--format", default="parquet")
    branch = commands.add_parser("branch")
    branch.add_argument("name", nargs="?")
    branch.add_argument("--drop")
    commands.add_parser("vacuum").add_argument("--keep", type=int, default=10)
    args = p.parse_args(argv)
    spark = get_session()
    spark.sparkContext.setLogLevel("ERROR")
    db = Database(spark, args.root)
    try:
        for item in args.attach:
            name, _, path = item.partition("=")
            db.attach(name, spark.read.parquet(path))
        run(db.connect(args.branch), args)
    except EngineError as e:
        print(f"{type(e).__name__} ({e.sqlstate}): {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
