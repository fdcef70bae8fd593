"""Architecture rules: files in layers by globs, denied edges between layers."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialize

_LAYER = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*\Z")


class PolicyError(ValueError):
    """A policy or path that cannot be judged."""


@dataclass
class Policy:
    layers: dict[str, list[str]] = field(default_factory=dict)
    deny: list[tuple[str, str]] = field(default_factory=list)


def glob_to_regex(glob: str) -> str:
    """`*` and `?` stay within a path component, `**` crosses them; no escapes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end]
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]", end + 1
        elif c == "{" and (end := glob.find("}", i)) > 0:
            out, i = out + "(?:" + "|".join(glob_to_regex(x)[1:-2] for x in glob[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), i + 1
    return f"^{out}\\z"


def compile_policy(config: dict | None) -> Policy | None:
    """A checked policy from `[architecture]`: layers (name, include) and rules
    (from, deny); None where there is none or it is off."""
    if not config or not config.get("enabled", True):
        return None
    layers: dict[str, list[str]] = {}
    for layer in config.get("layers", []):
        name = layer.get("name", "")
        if not _LAYER.match(name):
            raise PolicyError(f"layer name {name!r} is not valid")
        if name in layers:
            raise PolicyError(f"layer {name} is there twice")
        if not layer.get("include"):
            raise PolicyError(f"layer {name} includes nothing")
        layers[name] = [glob_to_regex(g) for g in layer["include"]]
    deny = []
    for rule in config.get("rules", []):
        if rule.get("from") not in layers:
            raise PolicyError(f"rule from unknown layer {rule.get('from')!r}")
        if not rule.get("deny"):
            raise PolicyError(f"rule from {rule['from']} denies nothing")
        for to in rule["deny"]:
            if to not in layers:
                raise PolicyError(f"rule denies unknown layer {to!r}")
            deny.append((rule["from"], to))
    return Policy(dict(sorted(layers.items())), sorted(set(deny)))


def checked_path(path: str) -> str:
    """A repository path in its normal form; empty, absolute or escaping ones fail."""
    parts: list[str] = []
    plain = path.replace("\\", "/")
    if not plain or plain.startswith("/"):
        raise PolicyError(f"path {path!r} is not inside the repository")
    for part in plain.split("/"):
        if part == "..":
            if not parts:
                raise PolicyError(f"path {path!r} leaves the repository")
            parts.pop()
        elif part not in ("", "."):
            parts.append(part)
    if not parts:
        raise PolicyError(f"path {path!r} is empty")
    return "/".join(parts)


def layer_rows(paths: DataFrame, policy: Policy) -> DataFrame:
    """(path, layers) with the sorted names of all layers that a path is in.

    Layers are a handful of patterns from a file, so they are tested as
    expressions of one projection.
    """
    tests = [F.when(F.col("path").rlike("|".join(globs)), F.lit(name)) for name, globs in policy.layers.items()]
    return paths.select("path", F.array_compact(F.array(*tests)).alias("layers") if tests else F.array().cast("array<string>").alias("layers"))


def classify(paths: DataFrame, policy: Policy) -> DataFrame:
    """(path, layer or null), a table; a path in several layers fails the whole check."""
    rows = materialize(layer_rows(paths, policy), "layers")
    both = rows.where(F.size("layers") > 1).orderBy("path").first()
    if both:
        raise PolicyError(f"{both.path} is in layers {', '.join(both.layers)}")
    return rows.select("path", F.get("layers", F.lit(0)).alias("layer"))


def violations(edges: DataFrame, layers: DataFrame, policy: Policy) -> DataFrame:
    """Exact edges from a layer to one it must not use, in order."""
    exact = edges.where("resolution = 'exact'")
    source, target = layers.select(F.col("path").alias("source_path"), F.col("layer").alias("from_layer")), layers.select(F.col("path").alias("target_path"), F.col("layer").alias("to_layer"))
    denied = F.lit(False)
    for a, b in policy.deny:
        denied = denied | ((F.col("from_layer") == a) & (F.col("to_layer") == b))
    rows = exact.join(source, "source_path").join(target, "target_path").where(denied)
    return rows.select("from_layer", "to_layer", "source_path", "target_path", "line", "raw_target", "kind", "resolver").orderBy("source_path", "target_path", "line", "raw_target")


def evaluate(files: DataFrame, edges: DataFrame, policy: Policy, only: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(one row of counts, violations); `only` narrows to indexed paths."""
    checked = files.select("path")
    if only:
        wanted = sorted({checked_path(p) for p in only})
        checked = checked.where(F.col("path").isin(*wanted))
        known = {r.path for r in checked.collect()}
        if missing := [p for p in wanted if p not in known]:
            raise PolicyError(f"not indexed: {', '.join(missing)}")
        edges = edges.where(F.col("source_path").isin(*wanted))
    edges = materialize(edges.select("source_path", "target_path", "line", "raw_target", "kind", "resolver", "resolution"), "checked-edges")
    ends = edges.where("resolution = 'exact'").select(F.explode(F.array("source_path", "target_path")).alias("path"))
    layers = classify(checked.unionByName(ends).distinct(), policy)
    found = violations(edges, layers, policy)
    a = checked.join(layers, "path", "left").agg(F.count("*").alias("checked_files"), F.count_if(F.col("layer").isNull()).alias("unclassified_files"))
    b = edges.agg(F.count_if(F.col("resolution") == "exact").alias("exact_edges"), F.count_if(F.col("resolution") != "exact").alias("unresolved_observations"))
    c = found.agg(F.count("*").alias("violations"))
    return a.join(b, F.lit(True)).join(c, F.lit(True)), found
