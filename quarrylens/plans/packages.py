"""Packages of a repository: the configuration nearest to each file, workspace packages, and imports by alias or package name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import nearest
from ..operators.relations import first_candidate
from .facts import EXTENSIONS, INDEXES


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def nearest_configs(files: DataFrame, name: str = "tsconfig.json") -> DataFrame:
    """(path, config): the configuration in the deepest folder above each file; files without one are left out."""
    homes = files.where(F.element_at(F.split("path", "/"), -1) == name).select(_folder(F.col("path")).alias("home"))
    found = nearest.nearest_ancestor(files, "path", homes, "home")
    return found.select("path", F.when(F.col("home") == "", F.lit(name)).otherwise(F.concat_ws("/", "home", F.lit(name))).alias("config"))


def config_aliases(configs: DataFrame) -> DataFrame:
    """(config, pattern, target) of configurations (path, text): their path aliases, targets from the top of the repository; the first target of each counts."""
    value = F.try_parse_json("text")
    paths = F.try_variant_get(value, "$.compilerOptions.paths", "map<string,array<string>>")
    base = F.coalesce(F.try_variant_get(value, "$.compilerOptions.baseUrl", "string"), F.lit("."))
    each = configs.select(F.col("path").alias("config"), _folder(F.col("path")).alias("folder"), F.regexp_replace(base, r"^\./?|/+$", "").alias("base"), F.explode(paths).alias("pattern", "targets"))
    target = F.concat_ws("/", *(F.when(c != "", c) for c in (F.col("folder"), F.regexp_replace("base", r"^\.$", ""), F.regexp_replace(F.get("targets", F.lit(0)), r"^\./", ""))))
    return each.where(F.size("targets") > 0).select("config", "pattern", target.alias("target"))


def workspace_packages(files: DataFrame) -> DataFrame:
    """(package, folder) of the folders that the workspace lists, from files (path, text): a package's ``src`` folder if it has one.

    The list is the one of pnpm-workspace.yaml if that has entries, else ``workspaces`` of the top package.json. A star
    stands for one folder name. Of a name that two folders have, the greatest folder counts; files that are no JSON name nothing.
    """
    lines = files.where("path = 'pnpm-workspace.yaml'").select(F.explode(F.split("text", "\n")).alias("line"))
    bare = F.regexp_replace(F.regexp_replace("line", r"^[\s-]+|\s+$", ""), "^['\"]+|['\"]+$", "")
    listed = lines.select(bare.alias("pattern")).where("pattern <> '' AND NOT startswith(pattern, '#') AND NOT endswith(pattern, ':')")
    top = files.where("path = 'package.json'").select(F.try_parse_json("text").alias("v"))
    entries = F.coalesce(F.try_variant_get("v", "$.workspaces.packages", "array<string>"), F.try_variant_get("v", "$.workspaces", "array<string>"))
    other = top.select(F.explode(entries).alias("pattern")).join(listed.select(F.lit(1).alias("some")).limit(1), F.lit(True), "left_anti")
    escaped = F.regexp_replace("pattern", r"([.+^$(){}|\[\]\\])", r"\\$1")
    patterns = listed.union(other).select(F.regexp_replace("pattern", r"^\./|/+$", "").alias("pattern")).distinct().select(F.size(F.split("pattern", "/")).alias("levels"), F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(escaped, r"\*+", "[^/]*"), r"\?", "[^/]"), F.lit("$")).alias("shape"))
    manifests = files.where("endswith(path, '/package.json')").select(_folder(F.col("path")).alias("folder"), F.try_variant_get(F.try_parse_json("text"), "$.name", "string").alias("package")).where("package <> ''")
    # patterns meet folders of their depth
    named = manifests.withColumn("levels", F.size(F.split("folder", "/"))).join(patterns, "levels").where(F.expr("folder RLIKE shape")).select("package", "folder")
    sources = files.where(F.contains("path", F.lit("/src/"))).select(F.explode(nearest.folders_above(F.col("path"))).alias("src")).where("endswith(src, '/src')").distinct()
    placed = named.join(sources, F.col("src") == F.concat("folder", F.lit("/src")), "left").select("package", F.coalesce("src", "folder").alias("folder"))
    return placed.groupBy("package").agg(F.max("folder").alias("folder"))


def resolved_by_name(imports: DataFrame, files: DataFrame, configs: DataFrame, aliases: DataFrame, packages: DataFrame) -> DataFrame:
    """(path, source, target): the file that an import by alias of the nearest configuration, or by a workspace package's name, means.

    Aliases go first; what a name stands for is tried with the endings and index files of a bare import. Relative
    imports, and names that lead to no file, are left out.
    """
    asked = imports.select("path", "source").distinct().where(~F.startswith("source", F.lit(".")))
    scoped = asked.join(configs, "path")
    by_alias = scoped.join(nearest.expanded(scoped, aliases, "config", "source"), ["config", "source"]).select("path", "source", F.col("target").alias("base"), F.lit(0).alias("rank"))
    # a package's name is all of a source, or ends before a slash; the longest one counts
    parts = F.split("source", "/")
    heads = asked.select("path", "source", F.posexplode(F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("k", "package"))
    longest = heads.join(packages, "package").groupBy("path", "source").agg(F.min_by(F.struct("package", "folder"), "k").alias("p"))
    rest = F.expr("substring(source, length(p.package) + 1)")
    by_package = longest.select("path", "source", F.concat("p.folder", rest).alias("base"), F.lit(1).alias("rank"))
    bases = by_alias.union(by_package).groupBy("path", "source").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "base"))), lambda x: x["base"]).alias("bases"))
    ends = F.array(*map(F.lit, (*EXTENSIONS, *INDEXES)))
    tried = F.flatten(F.transform("bases", lambda b: F.transform(ends, lambda e: F.concat(b, e))))
    return first_candidate(bases, ["path", "source"], tried, files.select(F.col("path").alias("target")), "target").select("path", "source", "target")
