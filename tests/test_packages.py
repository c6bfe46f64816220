"""Configurations, workspace packages and imports by name, on a small repository."""

import json

from quarrylens.plans import facts, packages

from .conftest import rows

FILES = {
    "package.json": json.dumps({"workspaces": {"packages": ["packages/*", "./tools/cli/"]}}),
    "tsconfig.json": json.dumps({"compilerOptions": {"paths": {"@top/*": ["./lib/*"]}}}),
    "lib/util.ts": "",
    "packages/core/package.json": json.dumps({"name": "@acme/core"}),
    "packages/core/src/index.ts": "",
    "packages/core/src/deep/x.ts": "",
    "packages/core/tsconfig.json": json.dumps({"compilerOptions": {"baseUrl": "./src", "paths": {"~/*": ["*"], "exact": ["deep/x.ts", "other"]}}}),
    "packages/ui/package.json": json.dumps({"name": "@acme/core-ui"}),
    "packages/ui/button.tsx": "",
    "packages/broken/package.json": "{",
    "packages/a/b/package.json": json.dumps({"name": "too-deep"}),
    "tools/cli/package.json": json.dumps({"name": "cli"}),
    "tools/cli/index.js": "",
    "other/package.json": json.dumps({"name": "unlisted"}),
}


def files(spark, **changed):
    return spark.createDataFrame(list({**FILES, **changed}.items()), "path string, text string")


def test_the_nearest_configuration(spark):
    found = dict(rows(packages.nearest_configs(files(spark))))
    assert found["packages/core/src/deep/x.ts"] == "packages/core/tsconfig.json" and found["packages/ui/button.tsx"] == found["package.json"] == "tsconfig.json"
    assert rows(packages.nearest_configs(files(spark).where("path LIKE 'lib/%'"))) == []


def test_workspace_packages(spark):
    assert rows(packages.workspace_packages(files(spark))) == [("@acme/core", "packages/core/src"), ("@acme/core-ui", "packages/ui"), ("cli", "tools/cli")]
    listed = files(spark, **{"pnpm-workspace.yaml": "packages:\n  # note\n  - 'other'\n"})
    assert rows(packages.workspace_packages(listed)) == [("unlisted", "other")]
    plain = files(spark, **{"package.json": json.dumps({"workspaces": ["other", "pack?ges/u*"]})})
    assert rows(packages.workspace_packages(plain)) == [("@acme/core-ui", "packages/ui"), ("unlisted", "other")]
    assert rows(packages.workspace_packages(files(spark, **{"package.json": "{}"}))) == []


def test_imports_by_alias_and_package(spark):
    known = files(spark)
    configs = packages.nearest_configs(known)
    aliases = packages.config_aliases(known.where("path LIKE '%tsconfig.json'"))
    assert rows(aliases) == [("packages/core/tsconfig.json", "exact", "packages/core/src/deep/x.ts"), ("packages/core/tsconfig.json", "~/*", "packages/core/src/*"), ("tsconfig.json", "@top/*", "lib/*")]
    inside, outside = "packages/core/src/index.ts", "packages/ui/button.tsx"
    asked = [(inside, "~/deep/x"), (inside, "exact"), (inside, "@top/util"), (inside, "./deep/x"), (outside, "@top/util"), (outside, "~/deep/x"), (outside, "@acme/core"), (outside, "@acme/core/deep/x"), (outside, "@acme/core-ui/button"), (outside, "cli"), (outside, "cli/none"), (outside, "@acme")]
    got = packages.resolved_by_name(spark.createDataFrame(asked, "path string, source string"), known, configs, aliases, packages.workspace_packages(known))
    assert rows(got) == sorted(
        [
            (inside, "~/deep/x", "packages/core/src/deep/x.ts"),
            (inside, "exact", "packages/core/src/deep/x.ts"),
            (outside, "@top/util", "lib/util.ts"),
            (outside, "@acme/core", "packages/core/src/index.ts"),
            (outside, "@acme/core/deep/x", "packages/core/src/deep/x.ts"),
            (outside, "@acme/core-ui/button", "packages/ui/button.tsx"),
            (outside, "cli", "tools/cli/index.js"),
        ],
        key=repr,
    )
    # the calls of what they bring are then counted as others are
    imports = got.selectExpr("path", "source", "target", "array('f') AS names", "map('f', 'g') AS name_map")
    calls = spark.createDataFrame([(outside, [("f.x", 1), ("f.x", 2), ("h", 3)])], "path string, calls array<struct<to:string,line:int>>")
    assert ("packages/core/src/index.ts", "g.x") in {(r.definer, r.name) for r in facts.call_sites(calls, imports).collect()}
