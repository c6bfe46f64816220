"""Column functions over text: hashes, normal forms, counts, matching."""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shapes of paths that give a person away, by kind.
PERSONAL_PATHS = {
    "windows_user": r"[Cc]:[\\/]Users[\\/](?!test[\\/]|user[\\/]|example[\\/]|runner[\\/])[a-zA-Z0-9._-]+[\\/]",
    "unix_home": r"/(?:Users|home)/(?!test/|user/|example/|runner/|ubuntu/)[a-zA-Z0-9._-]+/",
    "cloud_storage": r"(?i)[\\/](?:Dropbox|OneDrive|Google\s*Drive|iCloud|Box|pCloud)[\\/][^\\/]+[\\/]",
    "dated_folder": r"[\\/]\d{6}\s+[A-Z]+[\\/]",
    "personal_folder": r"(?i)[\\/](?:Documents|Desktop|Downloads|Pictures|Videos)[\\/][^\\/]+[\\/]",
    "my_folder": r"(?i)[\\/]My\s+[A-Za-z0-9]+[\\/]",
}
EMAIL_LIKE = r"[A-Za-z0-9._]+@[A-Za-z0-9]+\.[A-Za-z0-9.]*[A-Za-z0-9]"


def hash16(text: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def digest16(text: str) -> str:
    """The same of a text of the driver's."""
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def token_estimate(text: Column) -> Column:
    """A token for every four code points, rounded down."""
    return F.floor(F.length(text) / 4).cast("long")


def line_array(text: Column) -> Column:
    """Lines by newline only, so there is always one."""
    return F.split(text, "\n", -1)


def line_count(text: Column) -> Column:
    return F.size(line_array(text)).cast("long")


def universal_lines(text: Column) -> Column:
    """Lines as a universal-newline reader has them: more terminators, and none after the last."""
    ends = F.regexp_replace(text, "\r\n|[\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]", "\n")
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(ends, "\n\\z", ""), "\n", -1))


def universal_line_count(text: Column) -> Column:
    return F.size(universal_lines(text)).cast("long")


def message_core(message: Column) -> Column:
    """A finding's message without its extractor's mark and line numbers."""
    return F.trim(F.regexp_replace(message, r"^(?:\[AST\]\s*)?L\d+(?:-\d+)?:\s*", ""))


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(?:\./)+", "")


def glob_regex(pattern: str) -> str:
    """A glob whose star crosses folders, for the whole of a string."""
    out = []
    for part in re.split(r"(\*+|\?|\[!?[^\]]+\])", pattern):
        if part.startswith("*"):
            out.append(".*")
        elif part == "?":
            out.append(".")
        elif part.startswith("["):
            out.append("[^" + part[2:] if part.startswith("[!") else part)
        else:
            out.append(re.escape(part))
    return "^(?:" + "".join(out) + ")$"


def matches_any(path: Column, patterns: list[str]) -> Column:
    """Whether a pattern fits the whole path, one of its parts, or (patterns with a slash) a leading folder."""
    parts = F.split(path, "/")
    tests = []
    for pattern in patterns:
        fit = glob_regex(pattern.rstrip("/"))
        tests.append(path.rlike(fit) | _part_fits(parts, fit))
        if "/" in pattern:
            tests.append(F.startswith(path, F.lit(pattern.rstrip("/") + "/")))
    return reduce(Column.__or__, tests, F.lit(False))


def _part_fits(parts: Column, fit: str) -> Column:
    return F.exists(parts, lambda p: p.rlike(fit))


def unit_hash(key: Column, seed: str) -> Column:
    """A number in [0, 1) from a seeded SHA-256."""
    digits = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 16), 16, 10)
    return digits.cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def split_name(key: Column, seed: str, ratios: dict[str, float]) -> Column:
    """The split a key falls in, by cumulative ratios; the last takes the rest."""
    unit, total, out = unit_hash(key, seed), 0.0, None
    names = list(ratios)
    for name in names[:-1]:
        total += ratios[name]
        out = F.when(unit < total, name) if out is None else out.when(unit < total, name)
    return out.otherwise(names[-1]) if out is not None else F.lit(names[-1])


def last_sentence_contradicts(verdict: Column, reasoning: Column) -> Column:
    """Whether the last sentence names the opposite verdict without a negation before it."""
    last = F.lower(F.element_at(F.split(F.rtrim(reasoning), r"(?<=[.!?])\s+"), -1))
    opposite = F.when(verdict == "confirmed", r"\bdismiss").when(verdict == "dismissed", r"\bconfirm")
    return F.coalesce(F.regexp_like(last, opposite) & ~F.regexp_like(last, F.concat(F.lit(r"\b(?:not|never|cannot|no|n't)\b[^.]*"), opposite)), F.lit(False))
