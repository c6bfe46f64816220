"""Jobs, targets and their commands, line by line."""

from pyspark.sql import functions as F

from quarrylens.plans import detectors
from quarrylens.sources import ci

from .conftest import rows

WORKFLOW = """name: CI
jobs:
  test:
    runs-on: ubuntu
    steps:
      - uses: actions/checkout@v4
      - run: pytest tests/
      - name: long
        run: |
          python src/a.py \\

            --flag $HOME/x.txt
          uses: odd
        env:
          A: b/c
  lint:
    steps:
    - run: "ruff ./src"
    - run: >
        make x
# a note at the margin
  last:
    uses: ./local
on:
  push:
"""
PIPELINE = """stages:
  - build
variables:
  script: x
build_job:
  script:
    - make build
    # a note
    - pytest tests/t.py
  only: [main]
retry: 2
test.job/a:
  before_script:
    - ignored
  script:
  - ./run.sh
rules: x
"""
MAKE = ".PHONY: test\nA := b\nall: build test\nbuild install:\n\tgcc -o out/x src/x.c\n\t# nothing\n\n\tcp \"src/my file.py\" dest/\ntest:\n  not a command\n\tpytest `pwd`/y.py ${D}/z.py\n"


def elements(spark, *files):
    df = ci.ci_elements(spark.createDataFrame(list(files), "path string, text string"))
    return {(r.path, r.name): (r.line_start, r.line_end, r.commands, r.paths) for r in df.collect()}


def test_workflow_jobs(spark):
    found = elements(spark, (".github/workflows/ci.yml", WORKFLOW))
    assert found == {
        (".github/workflows/ci.yml", "test"): (3, 15, ["actions/checkout@v4", "pytest tests/", "python src/a.py \\", "--flag $HOME/x.txt", "uses: odd", "odd"], ["tests/", "src/a.py", "/x.txt"]),
        (".github/workflows/ci.yml", "lint"): (16, 21, ['"ruff ./src"', ">"], ["./src"]),
        (".github/workflows/ci.yml", "last"): (22, 23, ["./local"], []),
    }


def test_pipeline_jobs(spark):
    found = elements(spark, ("x/.gitlab-ci.yml", PIPELINE))
    assert found == {("x/.gitlab-ci.yml", "build_job"): (5, 11, ["make build", "pytest tests/t.py"], ["tests/t.py"]), ("x/.gitlab-ci.yml", "test.job/a"): (12, 17, ["./run.sh"], ["./run.sh"])}


def test_make_targets(spark):
    found = elements(spark, ("Makefile", MAKE))
    assert found == {
        ("Makefile", "all"): (3, 3, [], []),
        ("Makefile", "build"): (4, 8, ["gcc -o out/x src/x.c", 'cp "src/my file.py" dest/'], ["out/x", "src/x.c", "src/my", "file.py", "dest/"]),
        ("Makefile", "test"): (9, 11, ["pytest `pwd`/y.py ${D}/z.py"], ["/y.py", "/z.py"]),
    }


def test_files_without_elements(spark):
    assert elements(spark, (".github/workflows/a.yml", "name: CI\non: push\n"), (".github/workflows/b.yaml", None), ("Makefile", "# only a note\n"), ("Makefile.in", MAKE), (".gitlab-ci.yml", "")) == {}


def test_words_that_are_no_paths(spark):
    df = spark.createDataFrame([("ls -la --color=auto",), ("curl https://example.com/f.tar.gz",), ("echo hello",), ("A=b.c X=/d.e go.mod ./1 . a",), ("",)], "c string")
    assert [r[0] for r in df.select(ci.command_paths(F.col("c"))).collect()] == [[], [], [], ["X=/d.e", "go.mod"], []]


def test_missing_paths(spark):
    files = spark.createDataFrame([("src/app.py", "src"), ("docs/a/b.md", "docs/a")], "path string, parent string")
    given = [("ci.yml", "job", "a", ["src/app.py", "./src/app.py", "tests/old.py", "docs/**/*.md", "nowhere/*.md", "docs/a"]), ("ci.yml", "job", "b", ["src/*.py"])]
    assert rows(detectors.dead_ci_elements(files, spark.createDataFrame(given, "path string, kind string, name string, paths array<string>"))) == [("ci.yml", "job", "a", "nowhere/*.md,tests/old.py")]
