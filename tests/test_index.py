"""A small repository from walk to answers."""

import subprocess

import pytest

from codeloom.operators import policy, status
from codeloom.operators.resolve import edge_digest
from codeloom.plans import reports
from codeloom.server import Server
from codeloom.sources import gitdiff, repository
from codeloom.sources.settings import Config
from codeloom.sources.store import NoIndex, build_index, open_index, refresh_index, remove_index

FILES = {
    "src/domain/order.ts": "import { save } from '../infra/db'\nexport class Order {\n  total() { return 1 }\n}\n",
    "src/infra/db.ts": "export function save(x) {\n  return x\n}\n",
    "src/tests/order.ts": "import { Order } from '../domain/order'\nexport const check = () => new Order()\n",
    ".github/flow.yml": "name: order\n",
    "pkg/__init__.py": "",
    "pkg/use.py": "from .local import thing\nimport missing.module\n\ndef run():\n    return thing\n",
    "pkg/local.py": "class Local:\n    def thing(self):\n        return 1\n",
    "node_modules/x.js": "require('./y')\n",
    ".gitignore": "generated/\n*.gen.ts\n!keep.gen.ts\n",
    "generated/a.ts": "export function a() {}\n",
    "b.gen.ts": "",
    "keep.gen.ts": "",
}


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for path, text in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "bad.py").write_bytes(b"\xff\xfe")
    git = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "x")
    return root


def test_walk(repo):
    assert [p for p, _, _ in repository.source_paths(repo)] == [".github/flow.yml", "bad.py", "keep.gen.ts", "pkg/__init__.py", "pkg/local.py", "pkg/use.py", "src/domain/order.ts", "src/infra/db.ts", "src/tests/order.ts"]
    assert repository.repo_root(repo / "src/infra") == repo.resolve()
    assert repository.discover_repos([str(repo.parent)]) == [str(repo.resolve())]


def test_index_to_answers(spark, repo):
    with pytest.raises(NoIndex):
        open_index(spark, str(repo))
    index = build_index(spark, str(repo))
    rows = {(e.source_path, e.raw_target): (e.resolution, e.target_path) for e in index.edges.collect()}
    assert rows[("src/domain/order.ts", "../infra/db")] == ("exact", "src/infra/db.ts")
    assert rows[("pkg/use.py", ".local")] == ("exact", "pkg/local.py")
    assert rows[("pkg/use.py", "missing.module")] == ("unresolved", None)
    names = {(s.file_path, s.name, s.kind, s.line, s.end_line) for s in index.symbols.collect()}
    assert {("src/domain/order.ts", "Order", "class", 2, 4), ("src/domain/order.ts", "total", "function", 3, 3), ("pkg/local.py", "Local", "class", 1, 3), ("src/tests/order.ts", "check", "function", 2, 2)} <= names
    state = reports.status_of(index)
    assert (state["files"], state["exact_edges"], state["unresolved_edges"]) == (8, 3, 1)

    server = Server(spark, str(repo), Config(architecture={"layers": [{"name": "domain", "include": ["src/domain/**"]}, {"name": "infra", "include": ["src/infra/*"]}], "rules": [{"from": "domain", "deny": ["infra"]}]}))
    call = lambda name, **a: server.handle(f'{{"id": 1, "method": "tools/call", "params": {{"name": "{name}", "arguments": {__import__("json").dumps(a)}}}}}')["result"]
    out = call("get_context_capsule", query="order", max_files=1)
    assert out["pointers"][0]["path"] == "src/domain/order.ts" and out["omissions"][0]["reason"] == "file_limit"
    out = call("check_architecture_boundaries")
    assert [v["source_path"] for v in out["result"]["violations"]] == ["src/domain/order.ts"]
    out = reports.impact_of(index, spark.createDataFrame([("src/domain/order.ts", 0, 1.0)], "path string, ord int, score double"), {"dependency", "dependent", "test"}, 2, 10, True)
    assert {f["path"]: f["roles"] for f in out["files"]} == {"src/domain/order.ts": ["pivot"], "src/infra/db.ts": ["dependency"], "src/tests/order.ts": ["test"]}
    assert "Blast radius" not in reports.impact_markdown(out, "T", 500) and "via src/domain/order.ts:1" in reports.impact_markdown(out, "T", 500)
    assert server.handle("{")["id"] is None and "error" in server.handle('{"id": 2, "method": "nope"}')

    (repo / "src/infra/db.ts").write_text(FILES["src/infra/db.ts"].replace("return x", "return x + 1"))
    rows, total, found = reports.impact_of_diff(index, "HEAD", {"dependent"}, 1, 10, False)
    assert total == 1 and rows[0]["symbols"][0]["name"] == "save" and [f["path"] for f in found["files"]] == ["src/infra/db.ts", "src/domain/order.ts"]

    (repo / "src/infra/db").mkdir()
    (repo / "src/infra/db/index.ts").write_text("export function save(x) {}\n")
    fresh = refresh_index(spark, str(repo))
    assert {e.resolution for e in fresh.edges.where("raw_target = '../infra/db'").collect()} == {"ambiguous"}
    digest, mark = edge_digest(fresh.edges).first(), status.index_fingerprint(fresh.files).first()
    again = build_index(spark, str(repo))
    assert (digest, mark) == (edge_digest(again.edges.repartition(3)).first(), status.index_fingerprint(again.files).first())
    assert remove_index(str(repo)) and not remove_index(str(repo))


def test_diff_forms():
    text = 'diff --git a/x.rs b/x.rs\n--- a/x.rs\n+++ b/x.rs\n@@ -1,2 +3 @@\n-a\n@@ -9,0 +9,2 @@\ndiff --git a/n.py b/n.py\nnew file mode 100644\n--- /dev/null\n+++ b/n.py\n@@ -0,0 +1 @@\ndiff --git "a/\\303\\251.py" "b/\\303\\251.py"\ndeleted file mode 100644\n--- "a/\\303\\251.py"\n+++ /dev/null\n@@ -1 +0,0 @@\ndiff --git a/o.ts b/p.ts\nrename from o.ts\nrename to p.ts\ndiff --git a/i.bin b/i.bin\nBinary files a/i.bin and b/i.bin differ\n'
    found = [(f.path, f.kind, f.binary, f.hunks) for f in gitdiff.parse_diff(text)]
    assert found == [("x.rs", "modified", False, [(1, 2, 3, 3), (None, None, 9, 10)]), ("n.py", "added", False, [(None, None, 1, 1)]), ("é.py", "deleted", False, [(1, 1, None, None)]), ("p.ts", "renamed", False, []), ("i.bin", "modified", True, [])]
    for bad in ("", "-x", "a\0b"):
        with pytest.raises(gitdiff.DiffError):
            gitdiff.read_git_diff(".", bad)


def test_policy_faults(spark):
    layers = [{"name": "a", "include": ["src/**"]}, {"name": "b", "include": ["src/b/*.rs"]}]
    for config in ({"layers": [{"name": "1x", "include": ["*"]}]}, {"layers": layers + layers}, {"layers": layers, "rules": [{"from": "c", "deny": ["a"]}]}, {"layers": layers, "rules": [{"from": "a", "deny": []}]}):
        with pytest.raises(policy.PolicyError):
            policy.compile_policy(config)
    assert policy.compile_policy(None) is None and policy.compile_policy({"enabled": False}) is None
    with pytest.raises(policy.PolicyError, match="a, b"):
        policy.classify(spark.createDataFrame([("src/b/x.rs",)], "path string"), policy.compile_policy({"layers": layers}))
    for bad in ("", "/x", "../x", "a/../.."):
        with pytest.raises(policy.PolicyError):
            policy.checked_path(bad)
    assert policy.checked_path("./a\\b/../c") == "a/c"
