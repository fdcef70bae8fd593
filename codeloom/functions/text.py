"""Column functions over paths, lines and source text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import LANGUAGES, SKIPPED_DIR_PREFIXES, SKIPPED_DIRS, SKIPPED_ENDINGS


def language_of(path: Column) -> Column:
    """The language of a path by its extension; dotfiles have none."""
    extension = F.regexp_extract(path, r"[^/]\.([^./]+)\z", 1)
    out = F.lit("unknown")
    for lang, endings in LANGUAGES.items():
        out = F.when(extension.isin(*endings), F.lit(lang)).otherwise(out)
    return out


def is_excluded(path: Column) -> Column:
    """Whether a repository path lies in a place that is never indexed."""
    low = F.lower(path)
    parts = F.split(low, "/")
    inside = F.exists(parts, lambda p: p.isin(*SKIPPED_DIRS) | F.substring(p, 1, 5).isin(*[x for x in SKIPPED_DIR_PREFIXES if len(x) == 5]) | F.substring(p, 1, 6).isin(*[x for x in SKIPPED_DIR_PREFIXES if len(x) == 6]))
    worktrees = F.concat(F.lit("/"), low, F.lit("/")).contains("/.claude/worktrees/")
    ending = low.rlike("(" + "|".join(re.escape(x) for x in SKIPPED_ENDINGS) + r")\z")
    return inside | worktrees | (F.substring_index(path, "/", 1) == "personal") | ending


def is_test_path(path: Column) -> Column:
    return path.contains("/test") | path.endswith("_test.rs") | path.endswith(".test.ts") | path.endswith(".spec.ts")


def relative_path(path: Column, root: str) -> Column:
    """`path` below `root`, with forward slashes."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(slashed.startswith(root.rstrip("/") + "/"), F.substring(slashed, len(root.rstrip("/")) + 2, 1 << 30)).otherwise(slashed)


def lines_of(text: Column) -> Column:
    """Lines without their ends; a last empty piece is none."""
    body = F.when(text.endswith("\r"), F.left(text, F.length(text) - 1)).otherwise(text)
    pieces = F.split(body, "\r?\n")
    return F.when((text == "") | text.endswith("\n"), F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)


def trimmed(text: Column) -> Column:
    """Without white space at both ends, by Unicode's meaning of it."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.floor(F.octet_length(text) / 4), F.lit(1)).cast("long")


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def normalized_path(path: Column) -> Column:
    """`.` dropped and `..` resolved; null where that leaves the root or begins there."""
    step = lambda a, p: F.when(a.isNull(), a).when((p == "") | (p == "."), a).when(p == "..", F.when(F.size(a) > 0, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))))).otherwise(F.concat(a, F.array(p)))
    folded = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when(~path.startswith("/"), F.array_join(folded, "/"))


def parent_of(path: Column) -> Column:
    return F.regexp_replace(path, r"(^|/)[^/]*\z", "")


def joined_path(base: Column, name: Column) -> Column:
    return F.when(base == "", name).otherwise(F.concat(base, F.lit("/"), name))


def stem_of(path: Column) -> Column:
    """The file name without its extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(.)\.[^.]*\z", "$1")


def query_terms(query: str) -> list[str]:
    """Lower-case terms of letters, digits and `_`, of two bytes or more; repeats stay."""
    return [t for t in re.split(r"[^\w]+", query.lower()) if len(t.encode()) > 1]
