"""Command line: init, commit, log, checkout, diff, snapshot."""

from __future__ import annotations

import argparse
import sys

from palimpsest import Repository, StoreError, __version__
from palimpsest.sources.tables import read_table, write_table


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="palimpsest", description="Version control for a table.")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("init", help="make a repository")
    c.add_argument("root")
    c.add_argument("-k", "--primary-key", nargs="+", required=True)
    c.add_argument("--snapshot-interval", type=int)
    c.add_argument("--overwrite", action="store_true")
    c = sub.add_parser("commit", help="store a file as the next version")
    c.add_argument("root")
    c.add_argument("data")
    c.add_argument("-m", "--message", default="")
    c.add_argument("--audit", action="store_true", help="store changed cells with both values")
    c = sub.add_parser("log", help="list the versions")
    c.add_argument("root")
    c = sub.add_parser("checkout", help="write a version to a file, or show its first rows")
    c.add_argument("root")
    c.add_argument("-v", "--version", dest="at", type=int)
    c.add_argument("-o", "--out")
    c.add_argument("--single", action="store_true", help="write one part file")
    c = sub.add_parser("diff", help="compare two versions")
    c.add_argument("root")
    c.add_argument("old", type=int)
    c.add_argument("new", type=int)
    c = sub.add_parser("snapshot", help="store a version in full")
    c.add_argument("root")
    c.add_argument("--version", dest="at", type=int)
    return p


def run(args: argparse.Namespace, spark) -> None:
    if args.command == "init":
        repo = Repository.init(spark, args.root, args.primary_key, snapshot_interval=args.snapshot_interval, overwrite=args.overwrite)
        print(f"new repository at {repo.store.root}, key {', '.join(repo.keys)}")
        return
    repo = Repository.open(spark, args.root)
    if args.command == "commit":
        print(repo.commit(read_table(spark, args.data), args.message, audit=args.audit))
    elif args.command == "log":
        for e in repo.log():
            said = ", ".join(f"{k} {n}" for k, n in e["stats"].items() if n)
            print(f"{e['version']}\t{e['timestamp']}\t{e['message']}\t{said}")
    elif args.command == "checkout":
        out = repo.checkout(args.at)
        if args.out:
            write_table(out, args.out, args.single)
            print(args.out)
        else:
            out.show(10, truncate=False)
    elif args.command == "diff":
        print(repo.diff(args.old, args.new))
    elif args.command == "snapshot":
        print(repo.snapshot(args.at))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    try:
        run(args, SparkSession.builder.appName("palimpsest").getOrCreate())
    except (StoreError, ValueError, KeyError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
