"""`python -m codeloom.cli`: index, status, skeleton, capsule, impact, check, bench, serve and watch."""

from __future__ import annotations

import argparse
import json
import sys
import time

from .operators.capsule import PRESETS, mode_of
from .plans import reports
from .server import Server, serve
from .session import local_session, ship_package
from .sources.repository import discover_repos, repo_root
from .sources.settings import load_config, unwatch, watch
from .sources.store import build_index, open_index, refresh_index, remove_index
from .streaming.watch import DEFAULT_SECONDS, watch_loop, watch_pass


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="codeloom")
    top.add_argument("--repo")
    top.add_argument("--config")
    top.add_argument("--auto-index", action="store_true")
    sub = top.add_subparsers(dest="command", required=True)
    one = sub.add_parser("index")
    one.add_argument("--remove", action="store_true")
    one.add_argument("--all", nargs="*", metavar="ROOT", help="index every repository below these folders")
    sub.add_parser("status")
    one = sub.add_parser("skeleton")
    one.add_argument("file")
    one.add_argument("--detail", default="standard")
    for name in ("capsule", "impact"):
        one = sub.add_parser(name)
        one.add_argument("query", nargs="?" if name == "impact" else None)
        one.add_argument("--max-tokens", type=int)
        one.add_argument("--max-files", type=int)
        one.add_argument("--include-tests", action="store_true")
        one.add_argument("--format", choices=("markdown", "json"), default="markdown")
        one.add_argument("--related", action="append")
        one.add_argument("--depth", type=int, default=2)
        if name == "capsule":
            one.add_argument("--mode")
            one.add_argument("--preset")
        else:
            one.add_argument("--diff")
    one = sub.add_parser("check")
    one.add_argument("--path", action="append")
    one.add_argument("--format", choices=("markdown", "json"), default="markdown")
    one = sub.add_parser("bench")
    one.add_argument("query")
    one.add_argument("--runs", type=int, default=7)
    sub.add_parser("serve")
    one = sub.add_parser("watch")
    one.add_argument("--once", action="store_true")
    one.add_argument("--seconds", type=int, default=DEFAULT_SECONDS)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    config = load_config(args.config)
    root = str(repo_root(args.repo or config.default_repo))
    spark = local_session()
    ship_package(spark)
    opened = lambda: refresh_index(spark, root) if args.auto_index or config.auto_index else open_index(spark, root)
    say = lambda value, text: print(json.dumps(value, indent=2, default=str) if args.format == "json" else text)
    if args.command == "index":
        if args.remove:
            unwatch(root)
            return 0 if remove_index(root) else 1
        for repo in discover_repos(args.all) if args.all is not None else [root]:
            print(json.dumps(reports.status_of(build_index(spark, repo)), default=str))
            watch(repo)
    elif args.command == "status":
        print(json.dumps(reports.status_of(opened()), indent=2, default=str))
    elif args.command == "skeleton":
        print(reports.skeleton_of(opened(), args.file, args.detail))
    elif args.command == "capsule":
        preset = args.preset or config.default_capsule or "default"
        if preset not in PRESETS:
            raise SystemExit(f"unknown preset {preset}")
        mode, tokens, files = PRESETS[preset]
        mode = mode_of(args.mode) if args.mode else mode
        tokens, files = args.max_tokens or config.max_tokens or tokens, args.max_files or config.max_files or files
        tests = args.include_tests or config.include_tests
        if args.related:
            result = reports.impact_of_query(index := opened(), args.query, reports.roles_of(args.related, tests), args.depth, files, tests)
            print(reports.graph_capsule(index, args.query, result, tokens, mode))
        else:
            out = reports.capsule_of(opened(), args.query, mode, tokens, files, tests)
            say(out, out["content"])
    elif args.command == "impact":
        if (args.query is None) == (args.diff is None):
            raise SystemExit("exactly one of a query and --diff is needed")
        tokens, files = args.max_tokens or 8000, args.max_files or 40
        roles, index = reports.roles_of(args.related, args.include_tests), opened()
        if args.diff:
            rows, total, result = reports.impact_of_diff(index, args.diff, roles, args.depth, files, args.include_tests)
            say({"changed": rows, "changed_total": total} | result, reports.diff_markdown(rows, total, result, args.diff, index.indexed_at, tokens))
        else:
            result = reports.impact_of_query(index, args.query, roles, args.depth, files, args.include_tests)
            say(result, reports.impact_markdown(result, f"{reports.TITLE} Impact", tokens))
    elif args.command == "check":
        result = reports.boundaries_of(opened(), config.architecture, args.path)
        if result is None:
            print("no architecture policy configured")
            return 0
        say(result, reports.boundaries_markdown(result))
        return 1 if result["violations"] else 0
    elif args.command == "bench":
        index, runs = opened(), []
        cases = {"status": lambda: reports.status_of(index), "capsule balanced": lambda: reports.capsule_of(index, args.query, *PRESETS["balanced"]), "impact depth 2": lambda: reports.impact_of_query(index, args.query, reports.roles_of(None, True), 2, 40, True)}
        for name, run in cases.items():
            for _ in range(args.runs):
                began = time.perf_counter()
                run()
                runs.append((name, (time.perf_counter() - began) * 1000))
        from .operators.status import timing_stats

        timing_stats(spark.createDataFrame(runs, "name string, ms double")).show(truncate=False)
    elif args.command == "serve":
        serve(Server(spark, root, config, args.auto_index or config.auto_index))
    elif args.once:
        watch_pass(spark)
    else:
        watch_loop(spark, f"{root}/.codeloom/watch", args.seconds).awaitTermination()
    return 0


if __name__ == "__main__":
    sys.exit(main())
