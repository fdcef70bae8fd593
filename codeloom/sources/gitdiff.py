"""Unified diffs without context as rows of changed files and hunks."""

from __future__ import annotations

import re
import subprocess
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

MAX_BYTES = 64 << 20
CHANGES = "ord int, path string, old_path string, new_path string, kind string, binary boolean"
HUNKS = "path string, hunk int, old_start int, old_end int, new_start int, new_end int"
_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
_QUOTED = re.compile(r"\\(?P<octal>[0-7]{1,3})|\\(?P<escape>.)|[^\\]+|\\", re.S)
_ESCAPES = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13, '"': 34, "\\": 92}


class DiffError(ValueError):
    """A reference that is refused, a git that fails, or a diff that can't be read."""


@dataclass
class ChangedFile:
    old_path: str | None = None
    new_path: str | None = None
    kind: str = "modified"
    binary: bool = False
    hunks: list[tuple] = field(default_factory=list)

    @property
    def path(self) -> str:
        return self.new_path or self.old_path or ""


def decode_path(said: str) -> str:
    """A path as git writes it, plain or quoted with octal bytes.

    One odd path must not cost the whole diff: an unknown escape stands for its
    own character, an octal one may be short, bytes that are not UTF-8 become
    replacement characters, and what is not closed is taken as it stands.
    """
    said = said.strip()
    if len(said) < 2 or not (said.startswith('"') and said.endswith('"')):
        return said
    out = bytearray()
    for m in _QUOTED.finditer(said[1:-1]):
        if m["octal"]:
            out.append(int(m["octal"], 8) & 255)
        elif m["escape"]:
            out += bytes([_ESCAPES[m["escape"]]]) if m["escape"] in _ESCAPES else m["escape"].encode("utf-8", "surrogatepass")
        elif m[0] != "\\":
            out += m[0].encode("utf-8", "surrogatepass")
    return out.decode("utf-8", "replace")


def _side(said: str, prefix: str) -> str | None:
    path = decode_path(said.split("\t")[0] if not said.startswith('"') else said)
    return None if path == "/dev/null" else path.removeprefix(prefix)


def _range(start: str, count: str | None) -> tuple[int | None, int | None]:
    first, n = int(start), 1 if count is None else int(count)
    if n == 0:
        return None, None
    if first == 0:
        raise DiffError("a hunk that begins at line 0")
    return first, first + n - 1


def _heads(rest: str) -> tuple[str, str]:
    """Both paths of a `diff --git` line."""
    if rest.startswith('"'):
        m = re.match(r'("(?:[^"\\]|\\.)*") (.*)\Z', rest)
        if not m:
            raise DiffError(f"bad header {rest!r}")
        return m[1], m[2]
    if rest.endswith('"') and ' "' in rest:
        a, b = rest.split(' "', 1)
        return a, '"' + b
    half = len(rest) // 2
    if rest[:half][2:] == rest[half + 1 :][2:]:
        return rest[:half], rest[half + 1 :]
    a, _, b = rest.partition(" b/")
    return a, "b/" + b


def parse_diff(text: str) -> list[ChangedFile]:
    """Changed files in order."""
    files: list[ChangedFile] = []
    now: ChangedFile | None = None
    for line in text.split("\n"):
        line = line.removesuffix("\r")
        if line.startswith("diff --git "):
            a, b = _heads(line[11:])
            now = ChangedFile(_side(a, "a/"), _side(b, "b/"))
            files.append(now)
        elif now is None:
            continue
        elif line.startswith("new file mode"):
            now.kind, now.old_path = "added", None
        elif line.startswith("deleted file mode"):
            now.kind, now.new_path = "deleted", None
        elif line.startswith("rename from "):
            now.kind, now.old_path = "renamed", decode_path(line[12:])
        elif line.startswith("rename to "):
            now.kind, now.new_path = "renamed", decode_path(line[10:])
        elif line.startswith("Binary files ") or line == "GIT binary patch":
            now.binary = True
        elif line.startswith("--- ") and not now.hunks:
            now.old_path = _side(line[4:], "a/")
        elif line.startswith("+++ ") and not now.hunks:
            now.new_path = _side(line[4:], "b/")
        elif line.startswith("@@ "):
            if not (m := _HUNK.match(line)):
                raise DiffError(f"bad hunk {line!r}")
            now.hunks.append((*_range(m[1], m[2]), *_range(m[3], m[4])))
    return files


def read_git_diff(root: str, reference: str) -> list[ChangedFile]:
    """What differs from a reference in a working tree; git only reads."""
    if not reference.strip() or reference.startswith("-") or "\0" in reference:
        raise DiffError(f"reference {reference!r} is refused")
    try:
        done = subprocess.run(["git", "-C", root, "diff", "--unified=0", "--no-ext-diff", reference, "--"], capture_output=True, check=False)
    except OSError as e:
        raise DiffError(f"git can't be run: {e}") from e
    if done.returncode:
        raise DiffError(f"git diff failed: {done.stderr.decode(errors='replace').strip()}")
    if len(done.stdout) > MAX_BYTES:
        raise DiffError(f"the diff is larger than {MAX_BYTES} bytes")
    try:
        return parse_diff(done.stdout.decode("utf-8"))
    except UnicodeDecodeError as e:
        raise DiffError("the diff is not UTF-8") from e


def diff_tables(spark: SparkSession, files: list[ChangedFile]) -> tuple[DataFrame, DataFrame]:
    """(changes, hunks) of a parsed diff."""
    changes = [(i, f.path, f.old_path, f.new_path, f.kind, f.binary) for i, f in enumerate(files)]
    hunks = [(f.path, i, *h) for f in files for i, h in enumerate(f.hunks)]
    return spark.createDataFrame(changes, CHANGES), spark.createDataFrame(hunks, HUNKS)
