"""Requests as JSON lines on standard input, answers on standard output."""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from .operators.impact import clamp
from .plans import reports
from .sources.settings import Config
from .sources.store import open_index, refresh_index

# The tools and what each is for.
TOOLS = {
    "index_status": "Counts and fingerprints of the index",
    "get_skeleton": "The skeleton of one file",
    "get_context_capsule": "Files ranked for a query within a budget",
    "get_change_impact": "Bounded exact dependency impact of a query or a diff",
    "check_architecture_boundaries": "Layer rules over exact edges",
}


def truncated(text: str, most: int) -> str:
    return text if len(text) <= most else f"{text[:most]}\n\n[... {len(text) - most} more characters truncated by the server cap]"


class Server:
    def __init__(self, spark: SparkSession, root: str, config: Config, auto_index: bool = False):
        self.spark, self.root, self.config, self.auto_index = spark, root, config, auto_index
        self.token_cap = clamp(config.mcp_max_tokens or 32_000, 64, 32_000)
        self.file_cap = clamp(config.mcp_max_files or 40, 1, 100)

    def index(self):
        return refresh_index(self.spark, self.root) if self.auto_index else open_index(self.spark, self.root)

    def handle(self, line: str) -> dict:
        try:
            request = json.loads(line)
            method = request["method"]
        except (ValueError, KeyError, TypeError) as e:
            return {"id": None, "error": {"message": f"bad request: {e}"}}
        try:
            if method == "tools/list":
                result = {"tools": [{"name": n, "description": d} for n, d in TOOLS.items()]}
            elif method == "tools/call":
                params = request.get("params") or {}
                result = self.call(params["name"], params.get("arguments") or {})
            else:
                raise ValueError(f"unknown method {method}")
            return {"id": request.get("id"), "result": result}
        except Exception as e:  # every failure is an answer
            return {"id": request.get("id"), "error": {"message": str(e)}}

    def call(self, name: str, args: dict) -> dict:
        if name not in TOOLS:
            raise ValueError(f"unknown tool {name}")
        return getattr(self, name)(args)

    def index_status(self, args: dict) -> dict:
        return reports.status_of(self.index())

    def get_skeleton(self, args: dict) -> dict:
        return {"content": truncated(reports.skeleton_of(self.index(), args["file"], args.get("detail", "minimal")), self.token_cap * 4)}

    def get_context_capsule(self, args: dict) -> dict:
        mode = {None: "compact", "compact": "compact", "full": "full"}.get(args.get("mode"), "files-only")
        tokens = clamp(args["max_tokens"], 1, self.token_cap) if "max_tokens" in args else min(self.config.max_tokens or 8000, self.token_cap)
        files = clamp(args["max_files"], 1, self.file_cap) if "max_files" in args else min(self.config.max_files or 24, self.file_cap)
        index = self.index()
        out = reports.capsule_of(index, args["query"], mode, tokens, files, args.get("include_tests", self.config.include_tests))
        state = reports.status_of(index)
        return out | {"content": truncated(out["content"], tokens * 4)} | {k: state[k] for k in ("repo_fingerprint", "index_fingerprint", "indexed_at")}

    def get_change_impact(self, args: dict) -> dict:
        query, reference = args.get("query"), args.get("diff")
        if (query is None) == (reference is None):
            raise ValueError("exactly one of query and diff is needed")
        depth, files = clamp(args.get("depth", 1), 1, 3), clamp(args.get("max_files", 40), 1, self.file_cap)
        tokens, tests = clamp(args.get("max_tokens", min(self.token_cap, 12_000)), 64, self.token_cap), args.get("include_tests", False)
        roles, index = reports.roles_of(None, tests), self.index()
        if query is not None:
            result = reports.impact_of_query(index, query, roles, depth, files, tests)
            return result | {"content": truncated(reports.impact_markdown(result, f"{reports.TITLE} Impact", tokens), tokens * 4)}
        rows, total, result = reports.impact_of_diff(index, reference, roles, depth, files, tests)
        content = reports.diff_markdown(rows, total, result, reference, index.indexed_at, tokens)
        return result | {"content": truncated(content, tokens * 4), "reference": reference, "indexed_at": index.indexed_at, "changed": rows, "changed_total": total, "changed_truncated": total > files}

    def check_architecture_boundaries(self, args: dict) -> dict:
        most = clamp(args.get("max_violations", 50), 1, 100)
        result = reports.boundaries_of(self.index(), self.config.architecture, [args["path"]] if args.get("path") else None)
        if result is None:
            return {"content": "no architecture policy configured", "violations": [], "truncated": False}
        total = len(result["violations"])
        result["violations"] = result["violations"][:most]
        return {"content": truncated(reports.boundaries_markdown(result), 4000), "result": result, "total_violations": total, "truncated": total > most}


def serve(server: Server, lines=sys.stdin, out=sys.stdout) -> None:
    for line in lines:
        if line.strip():
            print(json.dumps(server.handle(line), default=str), file=out, flush=True)
