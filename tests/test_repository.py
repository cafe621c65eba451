"""A small tree of our own, from capture to context."""

import json
import random

import pytest

from tessera import cli
from tessera.operators import packing, structural
from tessera.repo import InvalidArgument, open_repository
from tessera.sources import worktree
from tessera.store import StoreBusy

TREE = {
    "pkg/__init__.py": "from .auth import Auth as Login\n",
    "pkg/auth.py": "import os\nfrom . import util\nfrom .util import check\n\nLIMIT = 3\n\nclass Base:\n    def ping(self):\n        return 1\n\nclass Auth(Base):\n    '''Tokens.'''\n    def refresh(self, token):\n        return check(token)\n    def run(self):\n        self.refresh(1)\n        util.check(2)\n        os.getcwd()\n\ndef helper():\n    def inner():\n        return Auth()\n    return inner()\n",
    "pkg/util.py": "def check(x):\n    return x\n\ndef check(x, y):\n    return y\n" .replace("\n\ndef check(x, y):\n    return y", ""),
    "app.py": "import pkg\nfrom pkg import Login\nfrom pkg.auth import Auth\nimport pkg.util as u\n\ndef main():\n    Login()\n    pkg.Login()\n    u.check(1)\n    Auth.refresh(None, 1)\n    x = 1\n    x()\n    gone.check()\n",
    "tests/test_auth.py": "from pkg.auth import Auth\nfrom pkg.util import check\n\nclass TestAuth:\n    def test_one(self):\n        check(1)\n\ndef test_two():\n    Auth()\n",
    "twice.py": "def f():\n    return 1\n\ndef f():\n    return 2\n\nf()\n",
    "bad.py": "def ok():\n    pass\n\ndef broken(:\n    pass\n\ndef after():\n    ok()\n",
    "web/a.ts": "import { b } from './b';\nexport class A {\n  go() {\n    return b(1);\n  }\n}\nfunction local() { return new A(); }\n", "web/b.ts": "export function b(x: number) { return x; }\n",
    "c/m.c": '#include "m.h"\nint add(int a, int b) { return a + b; }\nint main(void) { return add(1, 2); }\n', "c/m.h": "int add(int a, int b);\n",
    "g/a.go": "package g\n\nfunc Run() int { return Help() }\n", "g/b.go": "package g\n\ntype T struct { x int }\n\nfunc (t *T) Do() {}\n\nfunc Help() int { return 1 }\n",
    "s/run.sh": "#!/bin/bash\nsource ./lib.sh\ngreet x\n", "s/lib.sh": "greet() {\n  echo hi\n}\n",
    "j/A.java": "package j;\nimport j.B;\npublic class A extends B {\n    public int run() { return help(1); }\n    private int help(int x) { return x; }\n}\n", "j/B.java": "package j;\npublic class B {\n    public void go() { }\n}\n",
    "r/lib.rs": "pub struct P { x: i32 }\nimpl P {\n    pub fn new() -> P { make() }\n}\nfn make() -> P { P { x: 1 } }\n",
    "p/a.php": "<?php\nclass K {\n    public function f() { return helper(); }\n}\nfunction helper() { return 1; }\n",
    "n/A.cs": "namespace N {\n    public class A {\n        public int Run() { return Help(); }\n        private int Help() { return 1; }\n    }\n}\n",
    "k/a.cpp": "class Box {\n  int get() { return 1; }\n};\nint use() { Box b; return 2; }\n",
    ".gitignore": "*.log\n!keep.log\nbuild/\n/only.py\n", "sub/.gitignore": "!x.log\n", "x.log": "x", "keep.log": "y", "sub/x.log": "z", "build/o.py": "z = 1\n", "only.py": "", "sub/only.py": "", "Readme": "a", "README": "b",
}


@pytest.fixture(scope="module")
def repo(spark, tmp_path_factory, small):
    root = tmp_path_factory.mktemp("tree")
    for path, text in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "link").symlink_to("app.py")
    (root / "large").write_bytes(b"x" * (worktree.MAX_FILE + 1))
    r = open_repository(spark, str(root), str(root / ".tessera"))
    r.tree = root
    r.first = r.index()
    return r


def test_capture(repo):
    assert set(repo.view().files) == set(TREE) - {"x.log", "build/o.py", "only.py"} and repo.first["deleted"] == []
    assert {(r.path, r.reason) for r in repo.table("skips").collect()} == {("link", "symlink"), ("large", "too_large")}
    assert repo.status()["collisions"] == [["README", "Readme"]] and repo.index()["unchanged"]
    rules = [(p.rpartition("/")[0], t) for p, t in TREE.items() if p.endswith(".gitignore")]
    got = {r.path: r.ignored for r in worktree.ignored(repo.spark.createDataFrame([(p,) for p in TREE], "path string"), rules).collect()}
    assert {p for p, x in got.items() if x} == {"x.log", "build/o.py", "only.py"}
    with repo.store.owner(), pytest.raises(StoreBusy):
        with repo.store.owner():
            pass


def test_derivation(repo):
    rel = {(r.kind, r.source, r.target, r.text, r.resolution, r.basis) for r in repo.table("relations").collect()}
    sure = lambda kind, a, b, basis="resolved": (kind, a, b, None, "resolved", basis) in rel
    assert sure("calls", "symbol:app.py#main", "symbol:pkg/auth.py#Auth") and sure("calls", "symbol:app.py#main", "symbol:pkg/util.py#check") and sure("calls", "symbol:app.py#main", "symbol:pkg/auth.py#Auth.refresh")
    assert ("calls", "symbol:app.py#main", None, "x", "unresolved", "syntactic") in rel and ("calls", "symbol:app.py#main", None, "gone.check", "unresolved", "syntactic") in rel
    assert sure("references", "symbol:pkg/auth.py#Auth", "symbol:pkg/auth.py#Base") and sure("calls", "symbol:pkg/auth.py#Auth.run", "symbol:pkg/auth.py#Auth.refresh", "heuristic")
    assert sure("tested_by", "symbol:pkg/util.py#check", "symbol:tests/test_auth.py#TestAuth.test_one", "heuristic") and sure("imports", "file:app.py", "module:python:pkg.util") and sure("imports", "file:pkg/auth.py", "module:python:pkg.util")
    assert {("calls", "file:twice.py", f"symbol:twice.py#f{n}", "f", "ambiguous", "syntactic") for n in ("", "~1")} <= rel
    assert sure("calls", "symbol:g/a.go#Run", "symbol:g/b.go#Help") and sure("imports", "file:web/a.ts", "file:web/b.ts") and sure("calls", "symbol:web/a.ts#A.go", "symbol:web/b.ts#b") and sure("calls", "file:s/run.sh", "symbol:s/lib.sh#greet")
    assert sure("calls", "symbol:c/m.c#main", "symbol:c/m.c#add") and sure("references", "symbol:j/A.java#A", "symbol:j/B.java#B") and sure("calls", "symbol:n/A.cs#N.A.Run", "symbol:n/A.cs#N.A.Help") and sure("calls", "symbol:p/a.php#K.f", "symbol:p/a.php#helper")
    files = {r.path: (r.dialect, r.coverage) for r in repo.table("files").collect()}
    assert files["bad.py"] == ("python", "partial") and files["app.py"] == ("python", "complete") and files["r/lib.rs"] == ("rust", "partial") and files["keep.log"] == (None, "unsupported")
    source = (repo.tree / "pkg/auth.py").read_bytes()
    e = repo.entity("symbol:pkg/auth.py#Auth.refresh")
    assert source[e["start"] : e["end"]].decode() == "def refresh(self, token):\n        return check(token)" and e["signature"] == "def refresh(self, token)" and e["kind"] == "method"
    assert {r.key for r in repo.table("entities").where("test").collect()} == {"symbol:tests/test_auth.py#TestAuth", "symbol:tests/test_auth.py#TestAuth.test_one", "symbol:tests/test_auth.py#test_two"}


def test_search(repo):
    got = repo.search("refresh token", symbols=["Auth.refresh", "nothing"], paths=["APP.py", "readme"])
    assert [e["key"] for e in got["entries"]][:2] == ["file:app.py", "symbol:pkg/auth.py#Auth.refresh"] and got["entries"][0]["seeds"] == [("path", "APP.py", True)]
    assert {(i["hint"], i["problem"]) for i in got["issues"]} == {("nothing", "not_found"), ("readme", "ambiguous")} and got["lexical"]["state"] == "ran"
    assert got["entries"][1]["rank"] == 1 and got["entries"][1]["blast"]["dependents"] == 2, got["entries"][1]
    assert repo.search("", use_lexical=False)["lexical"]["state"] == "disabled"
    start = TREE["pkg/auth.py"].index("return check")
    assert repo.search("", selection=("pkg/auth.py", start, start + 3), use_lexical=False)["entries"][0]["key"] == "symbol:pkg/auth.py#Auth.refresh"
    for bad in ({"limit": -1}, {"limit": True}, {"paths": "x"}, {"selection": ("a", 3, 1)}):
        with pytest.raises(InvalidArgument):
            repo.search("x", **bad)


def test_context(repo):
    whole = repo.build_context("refresh token", 4000, symbols=["Auth.refresh"])
    assert "return check(token)" in whole["text"] and whole["text"].startswith("### pkg/auth.py:") and whole["used"] == packing.units(whole["text"])
    for budget in (0, 5, 20, 60, 200):
        got = repo.build_context("refresh token", budget, symbols=["Auth.refresh"])
        assert got["used"] <= budget and got["used"] == sum(packing.units(i["text"]) for i in got["items"])
        assert budget > 30 or any("raise the budget" in d for d in got["degradations"])
    repo.judge = packing.Replay("fixed", {"symbol:pkg/util.py#check": 1.0, "symbol:pkg/auth.py#Auth.refresh": 2.0})
    try:
        judged = repo.build_context("refresh token", 4000, symbols=["Auth.refresh"])
    finally:
        repo.judge = None
    reasons = {e[0]: e[3] for i in judged["items"] for e in i["entities"]}
    assert "judged by fixed" in reasons["symbol:pkg/util.py#check"] and "invalid" in reasons["symbol:pkg/auth.py#Auth.refresh"]


def test_navigation(repo):
    got = repo.impact("check")
    assert got["root"] == "symbol:pkg/util.py#check" and {h["key"] for h in got["hops"] if h["depth"] == 1} == {"symbol:app.py#main", "symbol:pkg/auth.py#Auth.refresh", "symbol:pkg/auth.py#Auth.run", "symbol:tests/test_auth.py#TestAuth.test_one", "file:tests/test_auth.py", "file:pkg/auth.py"}
    assert got["mentions"] == 1 and repo.entity("symbol:x") is None
    stored = {r.key: r.dependents for r in repo.table("blast").collect()}
    assert stored["symbol:pkg/util.py#check"] == len(repo.impact("symbol:pkg/util.py#check", depth=2, limit=20)["hops"])
    out = repo.outline("pkg")
    auth = next(f for f in out["files"] if f["path"] == "pkg/auth.py")
    assert [(d["name"], d["depth"], d["lines"]) for d in auth["declarations"]][:3] == [("Base", 0, (7, 9)), ("ping", 1, (8, 9)), ("Auth", 0, (11, 18))]
    assert repo.outline("pkg", 2)["truncated"] and repo.outline("")["unsupported"] > 0
    for name, want in {"Auth.refresh": "resolved", "pkg/auth.py:14": "resolved", "auth.py#Auth": "resolved", "f": "ambiguous", "nope": "not_found", "Auth::run": "resolved", "pkg.util": "resolved"}.items():
        assert repo.inspect(name)["status"] == want, name
    seen = repo.inspect("symbol:pkg/auth.py#Auth")
    assert seen["parent"]["key"] == "file:pkg/auth.py" and [m["name"] for m in seen["members"]] == ["refresh", "run"]
    assert {"kind": "references", "direction": "out", "proven": 1, "heuristic": 0, "ambiguous": 0, "unresolved": 0} in seen["links"]
    refs = repo.refs("symbol:pkg/util.py#check")
    assert refs["mentions"] == 1 and ("calls", "in", "proven", "u.check(1)") in {(r["kind"], r["direction"], r["label"], r["text"]) for r in refs["references"]}
    found = repo.structural_search({"kind": "Call", "name": "check$", "inside": {"kind": "ClassDef", "name": "^Auth$"}})
    assert [m["entity"] for m in found["matches"]] == ["symbol:pkg/auth.py#Auth.refresh", "symbol:pkg/auth.py#Auth.run"] and found["skipped"] == ["bad.py"]
    with pytest.raises(ValueError):
        structural.check({"kind": "Nothing"})


def test_update_equals_rebuild(repo, spark, tmp_path):
    old = repo.view()
    (repo.tree / "pkg/util.py").write_text("def check(x):\n    return x\n\ndef more():\n    return check(1)\n")
    (repo.tree / "twice.py").unlink()
    with repo.store.pin() as held:
        got = repo.index()
        assert got["modified"] == ["pkg/util.py"] and got["deleted"] == ["twice.py"] and got["reused"] > 10
        assert old.table("entities").where("path = 'twice.py'").count() == 3 and repo.store.current() != held
    assert held in repo.store.sweep() and repo.entity("symbol:twice.py#f") is None
    other = open_repository(spark, str(repo.tree), str(tmp_path / "data"), exclude=(str(repo.tree / ".tessera"),))
    other.index()
    for table in ("entities", "relations", "blast", "postings"):
        rows = lambda r: sorted(map(repr, r.table(table).select(*sorted(r.table(table).columns)).collect()))  # noqa: B023, E731
        assert rows(repo) == rows(other), table
    repo.store.verify(repo.store.current())


def test_command_line(repo, capsys):
    assert cli.main(["inspect", str(repo.tree), "nope"]) == 1 and json.loads(capsys.readouterr().out)["status"] == "not_found"
    assert cli.main(["impact", str(repo.tree), "nope"]) == 2 and cli.main(["status", str(repo.tree)]) == 0


def test_pack_budget():
    """No budget is ever exceeded, and a larger one never holds fewer items of a flat pool."""
    rng = random.Random(4)
    body = b"".join(f"def f{i}():\n    return {'x' * rng.randint(1, 60)}\n\n\n".encode() for i in range(12))
    spans = [(m, body.find(b"\n\n\n", m)) for m in [i for i in range(len(body)) if body.startswith(b"def ", i)]]
    pool = [packing.Candidate(f"symbol:a.py#f{i}", "symbol", f"f{i}", "a.py", a, e, rank=i + 1) for i, (a, e) in enumerate(spans)]
    for budget in range(0, 400, 7):
        items, omitted = packing.pack(pool, {}, budget, lambda _: body, {})
        assert sum(i.units for i in items) <= budget and len(omitted) + len({e[0] for i in items for e in i.entities}) == len(pool)
