"""Command line (X1, X12): check, status, index, search, clear, serve, watch, eval."""

from __future__ import annotations

import argparse
import json
import sys

from .config import load


def format_hit(n: int, h: dict, cap: int = 240) -> str:
    """One hit as text; components that are missing are left out."""
    parts = [f"#{n}  {h['file']}:{h['start_line']}-{h['end_line']}", f"[{h['lang']}]"]
    parts += [x for x in (h.get("kind"), h.get("name")) if x]
    parts.append(f" score={h['score']:.4f}")
    parts += [f"{label}={h[key]:.3f}" for key, label in (("dense_score", "dense"), ("sparse_score", "bm25"), ("rerank_score", "rerank")) if h.get(key) is not None]
    return " ".join(parts) + "\n    " + " ".join((h.get("preview") or "").split())[:cap]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corpusloom")
    parser.add_argument("-c", "--config", default="corpusloom.toml")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("check", "status", "index", "serve"):
        sub.add_parser(name)
    search = sub.add_parser("search")
    search.add_argument("query")
    search.add_argument("-n", "--limit", type=int, default=10)
    search.add_argument("--no-rerank", action="store_true")
    search.add_argument("--lang")
    search.add_argument("--path")
    search.add_argument("--json", action="store_true")
    sub.add_parser("clear").add_argument("--yes", action="store_true")
    watcher = sub.add_parser("watch")
    watcher.add_argument("events")
    watcher.add_argument("checkpoint")
    judge = sub.add_parser("eval")
    judge.add_argument("queries")
    judge.add_argument("--sweep", metavar="KNOB=V,V", help="one report for each value of a search knob")
    judge.add_argument("--repeat", type=int, default=1)
    judge.add_argument("--limit", type=int, default=10)
    judge.add_argument("--no-rerank", action="store_true")
    judge.add_argument("--baseline")
    judge.add_argument("--out")
    args = parser.parse_args(argv)

    from .engine import Engine
    from .operators.retrieval import token_overlap
    from .session import local_session

    config = load(args.config)
    engine = Engine(local_session(), config, reranker=token_overlap)
    if args.command == "check":
        rows = engine.check()
        print("\n".join(f"{'ok  ' if ok else 'FAIL'} {name}: {detail}" for name, ok, detail in rows))
        return int(not all(ok for _, ok, _ in rows))
    if args.command == "status":
        print(json.dumps(engine.status(), indent=2))
    elif args.command == "index":
        print(json.dumps(engine.index()))
    elif args.command == "search":
        found = engine.search(args.query, args.limit, args.lang, args.path, not args.no_rerank)
        if args.json:
            print(json.dumps(found.hits, indent=2))
        else:
            print("\n".join(format_hit(i, h) for i, h in enumerate(found.hits, 1)))
            print(f"{len(found.hits)} results in {found.elapsed_ms} ms", file=sys.stderr)
    elif args.command == "clear":
        if not args.yes and input(f"Delete {engine.store.path}? Type yes: ") != "yes":
            return 1
        engine.store.clear(confirm=True)
    elif args.command == "serve":
        from .server import Server

        Server(engine).run(sys.stdin, sys.stdout)
    elif args.command == "eval":
        from .evaluation import evaluate_set

        knob, _, values = (args.sweep or "").partition("=")
        sweep = {knob: [json.loads(v) for v in values.split(",")]} if knob else None
        remade = lambda c: Engine(engine.spark, c, reranker=token_overlap)
        print(json.dumps(evaluate_set(remade, config, args.queries, sweep, args.repeat, args.limit, not args.no_rerank, args.out, args.baseline), indent=2))
    elif args.command == "watch":
        from .streaming.watch import watch

        query = watch(engine, args.events, args.checkpoint)
        if query:
            query.awaitTermination()
    return 0
