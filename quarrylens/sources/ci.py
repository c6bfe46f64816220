"""Build and CI elements: make targets, workflow jobs and pipeline jobs with the commands they run.

A file's lines are folded in the JVM by a small state machine: which section and job a line is in, and
how deep the block of commands that is open starts. Lines deeper than that belong to the block, the first line that is
not ends it. Files are small, and each is one row; no file's lines are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Keys at the top of a pipeline file that are no jobs.
PIPELINE_KEYS = (
    "stages", "variables", "default", "include", "image", "services", "before_script", "after_script", "cache", "workflow", "pages", "trigger",
    "resource_group", "retry", "timeout", "interruptible", "artifacts", "dependencies", "needs", "environment", "release", "coverage", "parallel",
    "tags", "only", "except", "rules", "when", "allow_failure",
)
#: Words of commands that are never paths.
COMMANDS = (
    "echo", "cd", "mkdir", "rm", "cp", "mv", "ls", "cat", "grep", "sed", "awk", "find", "chmod", "chown", "export", "source", "eval", "exec",
    "if", "then", "else", "fi", "for", "do", "done", "while", "case", "esac", "true", "false", "exit", "return", "set", "unset", "test",
    "pip", "pip3", "python", "python3", "node", "npm", "npx", "yarn", "pnpm", "cargo", "go", "make", "git", "docker", "kubectl",
    "curl", "wget", "tar", "unzip", "gzip", "sudo", "env", "bash", "sh", "zsh",
)
STATE = "struct<section:int,last:int,block:int,jobs:array<struct<name:string,start:int,told:int>>,found:array<struct<job:int,command:string,shell:boolean>>>"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def command_paths(command: Column) -> Column:
    """The path-like words of a command, in order: a slash or dot and a letter; no options, addresses, settings, known commands."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(command, r"\$\{[^}]*\}|\$\([^)]*\)", ""), "`[^`]*`", ""), r"\$\w+", "")
    words = F.transform(F.split(bare, r"\s+"), lambda w: F.regexp_replace(w, "^['\"]+|['\"]+$", ""))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.rlike("^(?:-|https?://)") & ~F.lower(w).isin(*COMMANDS) & ~(F.contains(w, F.lit("=")) & ~F.contains(w, F.lit("/"))) & w.rlike(r"[/.]") & w.rlike("[a-zA-Z]"))


def seen(line: Column, named: str) -> Column:
    """A line with all that its text alone says, so that the fold, which asks for it again and again, matches it once."""
    text, bare = line["text"], line["bare"]
    return F.struct(
        line["at"].alias("at"),
        text.alias("text"),
        bare.alias("bare"),
        F.length(F.regexp_extract(text, r"^\s*", 0)).alias("indent"),
        F.regexp_extract(text, named, 1).alias("name"),
        bare.rlike(r"^-?\s*run:").alias("run"),
        bare.rlike(r"^-?\s*uses:").alias("uses"),
        F.regexp_replace(stripped(F.regexp_extract(bare, r"^-?\s*run:\s*(.*)", 1)), r"^\|+|\|+$", "").alias("rest"),
    )


def _next(state: Column, line: Column, header: Column, name: Column, *, section: Column, block: Column, told: list[Column]) -> Column:
    """The state after a line: a header opens a job; ``told`` has the line's commands (struct or null)."""
    at = line["at"]
    job = F.struct(name.alias("name"), at.alias("start"), F.size(state["found"]).alias("told"))
    return F.struct(
        section.alias("section"),
        F.when(section == 2, state["last"]).otherwise(at).alias("last"),
        block.alias("block"),
        F.when(header, F.array_append(state["jobs"], job)).otherwise(state["jobs"]).alias("jobs"),
        F.concat(state["found"], F.array_compact(F.array(*told))).alias("found"),
    ).cast(STATE)


def _told(state: Column, header: Column, when: Column, command: Column, shell: bool) -> Column:
    """A command of the job that the line is in."""
    job = F.size(state["jobs"]) - F.when(header, 0).otherwise(1)
    return F.when(when, F.struct(job.alias("job"), command.alias("command"), F.lit(shell).alias("shell")))


def workflow_step(state: Column, line: Column) -> Column:
    """Jobs stand two deep in the jobs section; run and uses lines have commands, a run without one opens a block."""
    text = line["text"]
    bare, indent, name = line["bare"], line["indent"], line["name"]
    inside = state["section"] == 1
    header = inside & (name != "")
    closes = inside & ~header & (bare != "") & ~text.rlike("^[ #]")
    active = inside & ~closes & (header | (F.size(state["jobs"]) > 0))
    open_ = F.when(header, -1).otherwise(state["block"])
    run = active & line["run"]
    rest = line["rest"]
    held = active & ~run & (open_ >= 0)
    deeper, blank = held & (bare != "") & (indent > open_), held & (bare == "")
    uses = active & ~run & ~blank & line["uses"]
    told = [_told(state, header, run & (rest != ""), rest, True), _told(state, header, deeper, bare, True), _told(state, header, uses, stripped(F.regexp_extract(bare, r"^-?\s*uses:\s*(.*)", 1)), False)]
    block = F.when(run, F.when(rest == "", indent).otherwise(-1)).when(held & ~deeper & ~blank, -1).otherwise(open_)
    section = F.when((state["section"] == 0) & text.rlike(r"^jobs:\s*$"), 1).when(closes, 2).otherwise(state["section"])
    return _next(state, line, header, name, section=section, block=block, told=told)


def pipeline_step(state: Column, line: Column) -> Column:
    """Jobs are keys at the top but for the format's own; items of their script are commands."""
    text = line["text"]
    bare, name = line["bare"], line["name"]
    header = (name != "") & ~name.isin(*PIPELINE_KEYS)
    active = header | (F.size(state["jobs"]) > 0)
    script = active & F.startswith(bare, F.lit("script:"))
    held = active & ~script & ~header & (state["block"] >= 0)
    item = held & F.startswith(bare, F.lit("- "))
    ends = held & ~item & (bare != "") & ~F.startswith(bare, F.lit("#")) & ~F.startswith(text, F.lit("  "))
    block = F.when(script, 0).when(header | ends, -1).otherwise(state["block"])
    return _next(state, line, header, name, section=state["section"], block=block, told=[_told(state, header, item, stripped(F.substring(bare, F.lit(3), F.length(bare))), True)])


def make_step(state: Column, line: Column) -> Column:
    """Targets, and the lines below them that start with a tab."""
    text = line["text"]
    name, command = line["name"], line["bare"]
    header = name != ""
    told = ~header & F.startswith(text, F.lit("\t")) & (F.size(state["jobs"]) > 0) & (command != "") & ~F.startswith(command, F.lit("#"))
    return _next(state, line, header, name, section=state["section"], block=state["block"], told=[_told(state, header, told, command, True)])


#: Kinds of elements: which paths have them, how a line names one, the fold's step, the section a file starts in.
KINDS = {
    "workflow_job": (r"(?:^|/)\.github/workflows/[^/]+\.ya?ml$", r"^  ([a-zA-Z_][\w-]*):\s*$", workflow_step, 0),
    "pipeline_job": (r"(?:^|/)\.gitlab-ci\.ya?ml$", r"^([a-zA-Z_][\w.\-/]*):", pipeline_step, 1),
    "make_target": (r"(?:^|/)(?:GNUmakefile|Makefile|makefile)$", r"^([a-zA-Z_][\w.\-]*)(?:\s+[a-zA-Z_][\w.\-]*)?\s*:(?!=)", make_step, 1),
}


def ci_elements(files: DataFrame) -> DataFrame:
    """(path, kind, name, line_start, line_end, commands, paths) of the elements in files (path, text); a null text has none.

    ``paths`` are the path-like words of commands, not of what a job uses. A name that comes twice is two elements.
    """
    found = None
    bare = F.transform(T.universal_lines(F.coalesce("text", F.lit(""))), lambda x, i: F.struct(i.alias("at"), x.alias("text"), stripped(x).alias("bare")))
    for kind, (pattern, named, step, section) in KINDS.items():
        lines = F.transform(bare, lambda x: seen(x, named))  # noqa: B023 - called at once
        start = F.struct(F.lit(section).alias("section"), F.lit(-1).alias("last"), F.lit(-1).alias("block"), F.array().alias("jobs"), F.array().alias("found")).cast(STATE)
        folded = files.where(F.col("path").rlike(pattern)).select("path", F.aggregate(lines, start, step).alias("s"))
        each = folded.select("path", "s", F.posexplode("s.jobs").alias("k", "job"))
        # a job's commands stand together, from those that were there when it was opened to those of the next one
        until = F.coalesce(F.get("s.jobs", F.col("k") + 1)["told"], F.size("s.found"))
        own = F.slice("s.found", F.col("job.told") + 1, until - F.col("job.told"))
        commands = F.transform(own, lambda f: f["command"])
        paths = F.flatten(F.transform(F.filter(own, lambda f: f["shell"]), lambda f: command_paths(f["command"])))
        last = F.coalesce(F.get("s.jobs", F.col("k") + 1)["start"], F.col("s.last") + 1)
        part = each.select("path", F.lit(kind).alias("kind"), "job.name", (F.col("job.start") + 1).alias("line_start"), last.alias("line_end"), commands.alias("commands"), paths.alias("paths"))
        found = part if found is None else found.unionByName(part)
    return found
