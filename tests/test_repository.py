"""A miniature repository through all plans."""

import subprocess

import pytest
from pyspark.sql import functions as F

from quarrylens.plans import audit, claims, detectors, facts, scorecard
from quarrylens.sources import documents, python_facts, repository

from .conftest import rows

FILES = {
    "src/app/__init__.py": "from .core import run\n",
    "src/app/core.py": '''"""Core."""
from app import util
from .util import helper as h

MODES = ("fast", "slow_mode")


def run(mode, depth=1, trace=False):
    if mode == "slow_mode":
        return h(1)
    return inner(depth)


def inner(n):
    return n


def unused_function(x):
    return deeper(x)


def deeper(x):
    return x


class Base:
    def act(self):
        return 1


class Child(Base):
    def act(self):
        return 2
''',
    "src/app/util.py": 'def helper(v, scale=2):\n    return v * scale\n\n\ndef report():\n    return {"status_ok": 1, "path": "/home/alice/x"}\n',
    "src/app/lonely.py": "def alone():\n    return 1\n",
    "src/app/main.py": 'from app.core import run\n\n\ndef start(kind):\n    if kind == "status_ok":\n        return run("fast")\n    return run("slow_mode", 3)\n',
    "src/app/broken.py": "def broken(:\n",
    "src/app/net.py": "import requests\n",
    "tests/test_core.py": "from app.core import Base\n\ndef test_a():\n    Base().act()\n",
    "pyproject.toml": '[project]\nname = "x"\ndependencies = ["requests>=2", "left-pad", "pytest"]\n',
    "Makefile": "all: build\n\tpython src/app/main.py\n\nbuild:\n\tpython scripts/gone.py\n",
    ".github/workflows/ci.yml": "jobs:\n  test:\n    run: pytest tests/missing/x.py\n",
    "node_modules/x.js": "",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("mini")
    for name, text in FILES.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_text(text)
    (base / "blob.bin").write_bytes(b"\0\1\2")
    subprocess.run(["git", "init", "-q", str(base)], check=True)
    return str(base)


@pytest.fixture(scope="module")
def result(spark, root):
    return audit.audit(spark, root, ["node_modules"])


def test_files(result):
    found = {r.path: r for r in result.files.collect()}
    assert set(found) == {*FILES, "blob.bin"} - {"node_modules/x.js"}
    assert found["blob.bin"].is_binary and not found["Makefile"].is_binary
    assert (found["src/app/core.py"].ext, found["src/app/core.py"].depth, found["Makefile"].parent) == (".py", 3, "")


def test_directories(result):
    assert rows(repository.directories(result.files), "path", "parent", "depth") == sorted([("", None, 0), (".github", "", 1), (".github/workflows", ".github", 2), ("src", "", 1), ("src/app", "src", 2), ("tests", "", 1)], key=repr)


def test_broken_sources_vanish(result):
    assert "src/app/broken.py" not in [r.path for r in result.facts.select("path").collect()]


def test_imports_resolve(result):
    assert rows(result.imports, "path", "source", "target") == sorted(
        [
            ("src/app/__init__.py", ".core", "src/app/core.py"),
            ("src/app/core.py", "app", "src/app/__init__.py"),
            ("src/app/core.py", ".util", "src/app/util.py"),
            ("src/app/main.py", "app.core", "src/app/core.py"),
            ("src/app/net.py", "requests", None),
            ("tests/test_core.py", "app.core", "src/app/core.py"),
        ],
        key=repr,
    )


def test_findings(result):
    found = {(r.category, r.path.rpartition("/")[2], r.symbol) for r in result.findings.collect()}
    assert {("dead_symbol", "core.py", x) for x in ("unused_function", "deeper", "MODES", "Child")} <= found
    assert ("dead_symbol", "core.py", "inner") not in found  # used by a live function of its file
    assert ("dead_symbol", "core.py", "Child.act") not in found  # implements a method of its base
    assert ("dead_parameter", "core.py", "trace") in found and ("dead_parameter", "core.py", "depth") not in found
    assert {("dead_dependency", "pyproject.toml", "left-pad"), ("dead_ci_element", "Makefile", "build"), ("dead_ci_element", "ci.yml", "test"), ("personal_path", "util.py", "/home/alice/")} <= found
    assert ("implicit_contract", "main.py", "status_ok") in found
    assert ("orphan_file", "lonely.py", None) in found and ("orphan_file", "util.py", None) not in found
    assert not any(c == "dead_dependency" and s in ("requests", "pytest") for c, _, s in found)


def test_call_sites_and_fan_in(result):
    assert ("src/app/main.py", "run", "src/app/core.py", "run", 2) in rows(facts.call_sites(result.facts, result.imports))
    assert ("src/app/core.py", 9, 3) in rows(facts.fan_in(result.facts, result.imports))


def test_cross_references_need_an_import_for_dispatch(spark, result):
    wanted = spark.createDataFrame([("src/app/core.py", "Base.act"), ("src/app/util.py", "helper")], "path string, name string")
    kinds = {(r.name, r.ref_path, r.kind) for r in facts.cross_references(result.facts, result.imports, wanted).collect()}
    assert ("Base.act", "tests/test_core.py", "dispatch") in kinds and ("helper", "src/app/core.py", "import") in kinds


def test_junk_merges_lines(spark):
    found = spark.createDataFrame([("a", "x", 1, 3), ("a", "y", 2, 5), ("a", "x", 4, 4), ("b", "x", 1, None)], "path string, category string, line_start int, line_end int")
    files = spark.createDataFrame([("a", "1\n2\n3\n4\n5\n"), ("b", "1")], "path string, text string")
    assert rows(scorecard.junk(found, files), "category", "junk_lines", "total_lines") == sorted([(None, 6, 6), ("x", 5, 6), ("y", 4, 6)], key=repr)


def test_folder_hash_changes_upwards_only(spark, result):
    before = dict(rows(result.folders))
    changed = result.files.withColumn("source_hash", F.when(F.col("path") == "tests/test_core.py", "0").otherwise(F.col("source_hash")))
    after = dict(rows(scorecard.folder_hashes(changed)))
    assert {k for k in before if before[k] != after[k]} == {"", "tests"}


def test_claims_and_verdicts(spark):
    found = claims.findings({"dead_symbol": spark.createDataFrame([("a.py", "f", 1, 2), ("a.py", "g", 5, 6)], "path string, name string, line_start int, line_end int")})
    ids = {r.symbol: r.id for r in found.collect()}
    evidence = {"code": spark.createDataFrame([(ids["f"], "body")], "id string, payload string")}
    made = claims.claims(found, evidence, {"dead_symbol": ["code"]}, {"dead_symbol": ["code"]})
    got = {r.symbol: r for r in made.collect()}
    assert (got["f"].insufficient, got["g"].insufficient, got["g"].fingerprint) == (False, True, None)
    verdicts = spark.createDataFrame([(ids["f"], got["f"].fingerprint, "dismissed", 0.9, "error", "It is used."), (ids["g"], "other", "confirmed", 1.0, "error", "")], "finding_id string, fingerprint string, verdict string, confidence double, severity string, reasoning string")
    decided = claims.decided(made, verdicts)
    assert rows(decided, "symbol", "verdict") == [("f", "dismissed"), ("g", None)]
    assert rows(claims.overlay(decided), "symbol", "severity") == [("g", "warning")]
    assert rows(claims.cached(made, claims.harvest(decided)), "symbol", "hit") == [("f", True), ("g", False)]


def test_fingerprint_does_not_depend_on_order(spark):
    df = spark.createDataFrame([(["a", "b"],), (["b", "a"],), ([],)], "e array<string>")
    a, b, c = (r[0] for r in df.select(claims.fingerprint(F.col("e"))).collect())
    assert a == b and a and c is None


def test_stale_reasons(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")], "path string, source_hash string")
    shadows = spark.createDataFrame([("b", "0", "i"), ("c", "1", "old"), ("d", "1", "i")], "path string, source_hash string, impl_hash string")
    assert rows(detectors.stale(files, shadows, "i")) == [("a", "missing"), ("b", "stale"), ("c", "stale-impl")]


def test_manifests():
    assert repository.dependencies_in("package.json", '{"dependencies": {"a": "1"}, "devDependencies": {"b": "1"}}') == [("node", "a"), ("node", "b")]
    assert repository.dependencies_in("go.mod", "module m\nrequire (\n\tx.y/z v1\n)\nrequire q v2\n") == [("go", "x.y/z"), ("go", "q")]
    assert repository.dependencies_in("requirements.txt", "# c\nflask==1\n-r other\n") == [("python", "flask")]
    assert repository.dependencies_in("Cargo.toml", "not toml [") == []


def test_string_usage():
    found = python_facts.facts_of("a.py", 'X = "defined_one"\ndef f(v):\n    "doc"\n    if v == "checked_one": return {"made": 1}.get("looked")\n')
    assert {s["value"]: s["usage"] for s in found["string_literals"]} == {"defined_one": "defined", "checked_one": "checked", "made": "produced", "looked": "checked"}


def test_verdict_file_round_trip(spark, tmp_path):
    data = [("r", "v", 1, "c1", "f", "d", "confirmed", None, False, None, None), ("r", "v", 0, "c0", "g", "d", "confirmed", "confirmed", False, 0.5, True)]
    df = spark.createDataFrame(data, documents.VERDICTS)
    path = str(tmp_path / "run.ndjson")
    documents.write_verdicts(df, {"run_id": "r"}, path)
    again, meta = documents.read_verdicts(spark, path)
    assert rows(again) == rows(df) and meta == {"run_id": "r"}
    (tmp_path / "bad.ndjson").write_text('{"record": "run_meta"}\n{"record": "verdict"}\n')
    with pytest.raises(ValueError):
        documents.read_verdicts(spark, str(tmp_path / "bad.ndjson"))


def test_sidecars_skip_bad_ones_and_state_checks_its_version(spark, tmp_path):
    folder = tmp_path / "side"
    folder.mkdir()
    (folder / "a.json").write_text('{"source": "x\\\\y", "n": 1}')
    (folder / "b.json").write_text('{"source": "", "n": 2}')
    (folder / "c.json").write_text("{broken")
    assert rows(documents.sidecars(spark, str(folder), "source string, n int", "source")) == [("x/y", 1)]
    state = str(tmp_path / "state")
    documents.write_state(spark.createDataFrame([("f",)], "finding_id string"), state, "1")
    assert documents.read_state(spark, state, "finding_id string", "1").count() == 1
    assert documents.read_state(spark, state, "finding_id string", "2").count() == 0
    assert documents.read_state(spark, str(tmp_path / "none"), "finding_id string", "1").count() == 0
