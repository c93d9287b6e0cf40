"""python -m deepwell: sync, query, inspect, compact."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .plans.config import PRESETS, Config
from .plans.knowledge_base import KnowledgeBase


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="deepwell", description=__doc__)
    p.add_argument("--store", required=True)
    p.add_argument("--preset", default="balanced", choices=sorted(PRESETS))
    sub = p.add_subparsers(dest="command", required=True)
    sync = sub.add_parser("sync")
    sync.add_argument("folder")
    query = sub.add_parser("query")
    query.add_argument("text")
    query.add_argument("-k", type=int, default=8)
    query.add_argument("--filter", default=None)
    for name in ("inspect", "compact"):
        sub.add_parser(name)
    args = p.parse_args(argv)
    kb = KnowledgeBase(SparkSession.builder.getOrCreate(), args.store, Config.resolve(args.preset))
    if args.command == "sync":
        print(json.dumps(kb.sync(args.folder)))
    elif args.command == "query":
        print(kb.retrieve(args.text, k=args.k, spec=json.loads(args.filter) if args.filter else None)["context"])
    elif args.command == "inspect":
        print(json.dumps(kb.store.stats()))
    else:
        kb.store.compact()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
