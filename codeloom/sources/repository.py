"""Source trees as DataFrames: discovery, the ignore rules, and a Spark data source.

Spark's own file sources drop names that begin with `.` or `_`, so the tree is
listed here. The driver lists paths; files are read on the executors.
"""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import LANGUAGES, SKIPPED_DIR_PREFIXES, SKIPPED_DIRS, SKIPPED_ENDINGS, SKIPPED_IN_DISCOVERY

INDEX_DIR = ".codeloom"
_BY_ENDING = {e: lang for lang, endings in LANGUAGES.items() for e in endings}


def repo_root(start: str | os.PathLike | None = None) -> Path:
    """The nearest folder above that holds `.git` or an index, else the start."""
    at = Path(start or ".").resolve()
    for folder in (at, *at.parents):
        if (folder / ".git").exists() or (folder / INDEX_DIR).exists():
            return folder
    return at


def language_for(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    stem, dot, ending = name.rpartition(".")
    return _BY_ENDING.get(ending, "unknown") if dot and stem else "unknown"


def should_skip(rel: str) -> bool:
    low = rel.lower()
    parts = low.split("/")
    return (
        any(p in SKIPPED_DIRS or p.startswith(SKIPPED_DIR_PREFIXES) for p in parts)
        or "/.claude/worktrees/" in f"/{low}/"
        or rel.split("/")[0] == "personal"
        or low.endswith(SKIPPED_ENDINGS)
    )


class IgnoreFile:
    """The rules of one ignore file, for paths below its folder."""

    def __init__(self, folder: str, text: str):
        self.folder = folder
        self.rules: list[tuple[re.Pattern, bool, bool]] = []
        for line in text.splitlines():
            line = re.sub(r"(?<!\\)\s+$", "", line)
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[1:] if keep else line[1:] if line.startswith("\\") else line
            folders = line.endswith("/")
            body = line.rstrip("/")
            anchored = "/" in body
            self.rules.append((re.compile(("" if anchored else "(?:.*/)?") + self._pattern(body.lstrip("/")) + r"\Z"), keep, folders))

    @staticmethod
    def _pattern(glob: str) -> str:
        out, i = "", 0
        while i < len(glob):
            c = glob[i]
            if glob.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif glob.startswith("/**", i) and i + 3 == len(glob):
                out, i = out + "/.*", i + 3
            elif c == "*":
                out, i = out + "[^/]*", i + 1
            elif c == "?":
                out, i = out + "[^/]", i + 1
            elif c == "[" and (end := glob.find("]", i + 2)) > 0:
                inner = glob[i + 1 : end]
                out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
            elif c == "\\" and i + 1 < len(glob):
                out, i = out + re.escape(glob[i + 1]), i + 2
            else:
                out, i = out + re.escape(c), i + 1
        return out

    def verdict(self, path: str, is_dir: bool) -> bool | None:
        """True: ignored, False: kept by name, None: no rule."""
        rel = os.path.relpath(path, self.folder).replace(os.sep, "/")
        for pattern, keep, folders in reversed(self.rules):
            if (is_dir or not folders) and pattern.match(rel):
                return not keep
        return None


def _ignore_files(folder: str) -> list[IgnoreFile]:
    """Rules of a folder, the strongest last."""
    out = []
    for name in (".gitignore", ".ignore"):
        try:
            out.append(IgnoreFile(folder, Path(folder, name).read_text(errors="replace")))
        except OSError:
            pass
    return out


def source_paths(root: str | os.PathLike) -> list[tuple[str, str, float]]:
    """(path, lang, mtime) of the sources below a root, sorted; hidden files count, links do not."""
    top = str(Path(root).resolve())
    rules: list[IgnoreFile] = []
    glob = os.path.expanduser(os.environ.get("XDG_CONFIG_HOME", "~/.config")) + "/git/ignore"
    for folder, file in ((top, glob), (top, f"{top}/.git/info/exclude")):
        if os.path.isfile(file):
            rules.append(IgnoreFile(folder, Path(file).read_text(errors="replace")))
    for above in reversed(Path(top).parents):
        rules += _ignore_files(str(above))
    found: list[tuple[str, str, float]] = []

    def enter(folder: str, rules: list[IgnoreFile]) -> None:
        rules = rules + _ignore_files(folder)
        with os.scandir(folder) as entries:
            for e in entries:
                rel = os.path.relpath(e.path, top).replace(os.sep, "/")
                if e.is_symlink() or should_skip(rel):
                    continue
                is_dir = e.is_dir(follow_symlinks=False)
                if next((v for r in reversed(rules) if (v := r.verdict(e.path, is_dir)) is not None), False):
                    continue
                if is_dir:
                    enter(e.path, rules)
                elif (lang := language_for(rel)) != "unknown":
                    found.append((rel, lang, e.stat().st_mtime))

    enter(top, rules)
    return sorted(found)


def discover_repos(roots: list[str]) -> list[str]:
    """Folders below the roots that hold `.git`, each once, sorted."""
    found: set[str] = set()

    def enter(folder: str) -> None:
        if os.path.exists(os.path.join(folder, ".git")):
            found.add(os.path.realpath(folder))
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            name = e.name.lower()
            if e.is_dir(follow_symlinks=False) and name not in SKIPPED_DIRS and name not in SKIPPED_IN_DISCOVERY and not name.startswith(SKIPPED_DIR_PREFIXES):
                enter(e.path)

    for root in roots:
        if os.path.isdir(root):
            enter(root)
    return sorted(found)


class _Slice(InputPartition):
    def __init__(self, rows):
        super().__init__(0)
        self.rows = rows


class _Reader(DataSourceReader):
    def __init__(self, root: str, per_task: int):
        self.root, self.per_task = root, per_task

    def partitions(self):
        rows = source_paths(self.root)
        return [_Slice(rows[i : i + self.per_task]) for i in range(0, len(rows), self.per_task)] or [_Slice([])]

    def read(self, partition):
        for path, lang, mtime in partition.rows:
            try:
                text = Path(self.root, path).read_bytes().decode("utf-8")
            except (OSError, UnicodeDecodeError):
                continue  # not text, or gone since it was listed
            yield path, lang, text, mtime


class RepositorySource(DataSource):
    """`spark.read.format("repository").load(root)`: path, lang, content, mtime."""

    @classmethod
    def name(cls):
        return "repository"

    def schema(self):
        return "path string, lang string, content string, mtime double"

    def reader(self, schema):
        return _Reader(str(Path(self.options["path"]).resolve()), int(self.options.get("filesPerTask", "200")))


def read_repository(spark: SparkSession, root: str) -> DataFrame:
    """The files table of a tree, with mtime."""
    spark.dataSource.register(RepositorySource)
    rows = spark.read.format("repository").load(str(root))
    return rows.select("path", "lang", F.sha2(F.col("content").cast("binary"), 256).alias("hash"), "content", "mtime")
