"""Command line: python -m lodestone {index,search,ask,graph,flow,clues,watch,prompt,serve} --dir DIR ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from lodestone import __version__, service
from lodestone.operators import paths, providers, search
from lodestone.streaming import watch

COMMANDS = {"index": (), "search": ("query",), "ask": ("query",), "graph": ("symbol",), "flow": ("source", "target"), "clues": ("term",), "watch": (), "prompt": (), "serve": ()}


def session() -> SparkSession:
    return SparkSession.builder.appName("lodestone").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    p.add_argument("--version", action="version", version=f"lodestone {__version__}")
    sub = p.add_subparsers(dest="command", required=True)
    for name, words in COMMANDS.items():
        c = sub.add_parser(name)
        for w in words:
            c.add_argument(w)
        c.add_argument("--dir", default=".")
        c.add_argument("--limit", type=int, default={"clues": search.CLUES_LIMIT, "ask": 20}.get(name, search.DEFAULT_LIMIT))
        c.add_argument("--depth", type=int, default=paths.MOST_NODES)
        c.add_argument("--no-cache", action="store_true", help="build the snapshot anew")
        c.add_argument("--fast", action="store_true", help="ask: use the vectors there are")
        c.add_argument("--json", action="store_true")
        for option in providers.option_names():
            flag = "--rerank-model" if option == "rerank_model" else f"--embed-{option}"
            c.add_argument(flag, dest=f"embed_{option}", type=int if option in ("dim", "batch") else str)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    options = providers.Options(**{o: getattr(args, f"embed_{o}") for o in providers.option_names()})
    provider, notice = providers.resolve(options)
    if notice and args.command in ("ask", "prompt", "serve"):
        print(notice, file=sys.stderr)
    opened = service.Service(session(), args.dir, provider=provider, warm=args.command == "serve", fresh=args.no_cache)
    if args.command == "index":
        print(json.dumps(opened.status()))
    elif args.command == "watch":
        watch.follow(opened.spark, args.dir, opened.folder, f"{opened.folder}/stream").awaitTermination()
    elif args.command == "prompt":
        service.prompt(opened)
    elif args.command == "serve":
        service.serve(opened)
    else:
        if args.command == "ask" and not args.fast:
            opened.embed()
        given = {w: getattr(args, w) for w in COMMANDS[args.command]} | {"limit": args.limit, "depth": args.depth}
        made = service.call(opened, args.command, given)
        if made["isError"]:
            print(made["error"], file=sys.stderr)
            return 1
        print(json.dumps({"data": made["data"], "meta": made["meta"]}, default=str, ensure_ascii=False, indent=1) if args.json or args.command != "search" else service.render(made["data"]))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
