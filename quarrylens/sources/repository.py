"""Repositories as relations: files, folders, git listings, dependency manifests, build and CI elements."""

from __future__ import annotations

import json
import re
import subprocess
import tomllib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import folders

#: Bytes that are looked at for a NUL, and the share of non-text bytes that makes a file binary.
HEAD, STRANGE = 8192, 0.10
TEXT_BYTES = bytes({7, 8, 9, 10, 12, 13, 27, *range(0x20, 0x100)} - {0x7F})


def git_files(root: str) -> list[str] | None:
    """Tracked and unignored files, or None where git cannot tell."""
    done = subprocess.run(["git", "-C", root, "ls-files", "-z", "--cached", "--others", "--exclude-standard"], capture_output=True)
    return sorted({x for x in done.stdout.decode(errors="replace").split("\0") if x}) if done.returncode == 0 else None


def git_changes(spark: SparkSession, root: str, base: str) -> DataFrame:
    """(status, path) against a base; a rename has its new path."""
    done = subprocess.run(["git", "-C", root, "diff", "--name-status", base], capture_output=True, text=True, check=True)
    rows = [(parts[0][0], parts[-1]) for line in done.stdout.splitlines() if len(parts := line.split("\t")) > 1]
    return spark.createDataFrame(rows, "status string, path string")


def git_commits(spark: SparkSession, root: str, since: str | None = None) -> DataFrame:
    """(sha, author, at, subject) since a commit, newest first."""
    span = [f"{since}..HEAD"] if since else []
    done = subprocess.run(["git", "-C", root, "log", "--format=%H%x00%an%x00%aI%x00%s", *span], capture_output=True, text=True, check=True)
    return spark.createDataFrame([tuple(line.split("\0", 3)) for line in done.stdout.splitlines()], "sha string, author string, at string, subject string")


def decoded(content: bytes) -> tuple[str | None, bool]:
    """The text of a file, or that it is binary: a NUL early on, or bytes that are neither UTF-8 nor mostly text."""
    if b"\0" in content[:HEAD]:
        return None, True
    for cut in range(4):  # a last character may be cut off
        try:
            return content[: len(content) - cut].decode(), False
        except UnicodeDecodeError:
            continue
    if len(content.translate(None, TEXT_BYTES)) > STRANGE * len(content):
        return None, True
    return content.decode(errors="replace"), False


def with_text(files: DataFrame) -> DataFrame:
    """Adds text and is_binary to rows with path and content, and drops content."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [decoded(x or b"") for x in batch["content"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array([t for t, _ in found], pa.string()), pa.array([b for _, b in found], pa.bool_())], names=["path", "text", "is_binary"])

    return files.select("path", "content").mapInArrow(read, "path string, text string, is_binary boolean")


def path_columns(df: DataFrame) -> DataFrame:
    """Adds ext, name, depth and parent (of a file at the top: the empty string)."""
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    return df.withColumns({"name": name, "ext": F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)), "depth": F.size(parts), "parent": F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")})


def files(spark: SparkSession, root: str, ignore: list[str] = (), exclude: list[str] = (), listed: list[str] | None = None) -> DataFrame:
    """(path, text, is_binary, source_hash, name, ext, depth, parent), deepest first.

    ``listed`` (default: git's listing, else all files, which tasks list by folder) says which files belong to the repository; ignore
    patterns fit whole paths, parts or folders, a leading ``!`` takes one back; exclude globs fit whole paths.
    """
    _, base = fs.FileSystem.from_uri(root if "://" in root else str(Path(root).resolve()))
    if listed is None:
        listed = git_files(base)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the file sources of Spark pass over names that start with a dot or an underscore
        own, top = fs.FileSystem.from_uri(root if "://" in root else base)
        for batch in batches:
            for path in batch["path"].to_pylist():
                if own.get_file_info(f"{top}/{path}").is_file:
                    with own.open_input_stream(f"{top}/{path}") as file:
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([file.read()], pa.binary())], names=["path", "content"])

    if listed is None:  # every task lists and reads folders of its own
        found = folders.read_folders(spark, root)
    else:
        found = spark.createDataFrame([(x,) for x in sorted(listed)], "path string").mapInArrow(read, "path string, content binary")
    found = found.where(~F.startswith("path", F.lit(".git/")))
    plain = [x for x in ignore if not x.startswith("!") and f"!{x}" not in ignore]
    if plain:
        found = found.where(~T.matches_any(F.col("path"), plain))
    for glob in exclude:
        found = found.where(~F.col("path").rlike(T.glob_regex(glob)))
    read = with_text(found).withColumn("source_hash", T.hash16(F.coalesce("text", F.lit(""))))
    return path_columns(read).orderBy(F.desc("depth"), "path")


def directories(files_: DataFrame) -> DataFrame:
    """(path, parent, depth) of all folders above files, the root being the empty path; deepest first."""
    parts = F.split("parent", "/")
    above = F.when(F.col("parent") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))))
    found = files_.select(F.explode(above).alias("path")).distinct()
    own = F.split("path", "/")
    return found.select("path", F.when(F.col("path") != "", F.array_join(F.slice(own, 1, F.size(own) - 1), "/")).alias("parent"), F.when(F.col("path") == "", 0).otherwise(F.size(own)).alias("depth")).orderBy(F.desc("depth"), "path")


def children(parents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(parent, path): direct children; the root is not its own child."""
    return nodes.where(F.col("parent").isNotNull()).join(parents.select(F.col("path").alias("parent")), "parent", "left_semi").select("parent", "path")


def is_doc(path: Column, extensions: list[str], stems: list[str], folders: list[str]) -> Column:
    """Documentation by extension, by upper-cased stem, or by a folder above."""
    name = F.element_at(F.split(path, "/"), -1)
    parents = F.transform(F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1), lambda x: F.lower(x))
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).isin(extensions) | F.upper(F.regexp_replace(name, r"\.[^.]*$", "")).isin(stems) | F.arrays_overlap(parents, F.array(*map(F.lit, folders)))


def is_test(path: Column) -> Column:
    """A tests folder above, or a name that starts with test_."""
    return F.arrays_overlap(F.split(path, "/"), F.array(F.lit("tests"), F.lit("test"))) | F.startswith(F.element_at(F.split(path, "/"), -1), F.lit("test_"))


def is_test_loosely(path: Column) -> Column:
    """Any part that starts with test: the looser rule that reports use."""
    return F.exists(F.split(path, "/"), lambda x: F.startswith(x, F.lit("test")))


# ---- manifests

#: Entries of manifests that a worker holds before it hands them on, but for those of one manifest.
ENTRIES = 1 << 14


def dependencies_in(name: str, text: str) -> list[tuple[str, str]]:
    """(ecosystem, package) of a manifest; unreadable ones have none."""
    try:
        if name == "pyproject.toml":
            data = tomllib.loads(text)
            project = data.get("project", {})
            specs = [*project.get("dependencies", []), *(x for v in project.get("optional-dependencies", {}).values() for x in v)]
            poetry = data.get("tool", {}).get("poetry", {}).get("dependencies", {})
            return [("python", m[0]) for s in specs if (m := re.match(r"[A-Za-z0-9][\w.\-]*", s))] + [("python", x) for x in poetry if x != "python"]
        if name == "package.json":
            data = json.loads(text)
            return [("node", x) for part in ("dependencies", "devDependencies", "peerDependencies") for x in data.get(part, {})]
        if name == "Cargo.toml":
            data = tomllib.loads(text)
            return [("rust", x) for part in ("dependencies", "dev-dependencies", "build-dependencies") for x in data.get(part, {})]
        if name == "go.mod":
            inside = re.findall(r"^require\s*\(([^)]*)\)", text, re.M)
            lines = [*(line for block in inside for line in block.splitlines()), *re.findall(r"^require\s+([^(\s].*)$", text, re.M)]
            return [("go", x.split()[0]) for x in lines if x.strip() and not x.strip().startswith("//")]
        if re.fullmatch(r"requirements[\w.\-]*\.(?:txt|in)", name):
            return [("python", m[1]) for line in text.splitlines() if (m := re.match(r"\s*([A-Za-z0-9][\w.\-]*)", line))]
    except (ValueError, AttributeError, TypeError):
        pass
    return []


def dependencies(files_: DataFrame) -> DataFrame:
    """(manifest, ecosystem, package) of the manifests at the top of a repository."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, str, str]] = []

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["manifest", "ecosystem", "package"])

        for batch in batches:
            for path, text in zip(batch["path"], batch["text"], strict=True):
                name = path.as_py()
                rows += [(name, *d) for d in dependencies_in(name, text.as_py() or "")]
                if len(rows) >= ENTRIES:
                    yield batch_of()
                    rows = []
        if rows:
            yield batch_of()

    top = files_.where((F.col("depth") == 1) & F.col("name").rlike(r"^(?:pyproject\.toml|package\.json|Cargo\.toml|go\.mod|requirements[\w.\-]*\.(?:txt|in))$"))
    return top.select("path", "text").mapInArrow(parse, "manifest string, ecosystem string, package string").distinct()


def import_name(package: Column, ecosystem: Column, known: dict[str, str] = {}) -> Column:  # noqa: B006
    """The name a package is imported by: a known one, else by the ecosystem's habit."""
    usual = F.when(ecosystem == "python", F.translate(F.lower(package), "-", "_")).when(ecosystem == "rust", F.translate(package, "-", "_")).otherwise(package)
    out = usual
    for name, value in known.items():
        out = F.when(F.lower(package) == name, value).otherwise(out)
    return out

