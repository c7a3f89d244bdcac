"""Paths, listings and globs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The languages by extension, and folders left out by default.
EXTENSIONS = {".cs": "csharp", ".ts": "typescript", ".tsx": "typescript"}
EXCLUDED = ("Test", "Tests", "Specs")
ROOT = "."


def normalize(path: Column) -> Column:
    """Forward slashes; none at the end."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"/+$", "")


def folder_of(path: Column) -> Column:
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(folder == "", F.lit(ROOT)).otherwise(folder)


def file_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def language_of(path: Column) -> Column:
    """``csharp``, ``typescript`` or null, by extension in any case."""
    name = F.lower(path)
    return F.when(name.endswith(".cs"), F.lit("csharp")).when(name.rlike(r"\.tsx?$"), F.lit("typescript"))


def is_supported(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(cs|tsx?)$")


def has_segment(path: Column, names: tuple[str, ...] = EXCLUDED) -> Column:
    """Is any whole segment of ``path`` one of ``names``, in any case?"""
    if not names:
        return F.lit(False)
    return F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*[F.lit(n.lower()) for n in names]))


def is_glob(pattern: str) -> bool:
    return any(c in pattern for c in "*?[]")


def glob_prefix(pattern: str) -> str:
    """Text before the first wildcard."""
    return re.match(r"[^*?\[{]*", pattern)[0]


def glob_root(pattern: str) -> str:
    """The deepest folder that the pattern names without a wildcard."""
    head = glob_prefix(pattern.replace("\\", "/"))
    return head.rpartition("/")[0] or (ROOT if not head.startswith("/") else "/")


def glob_regex(pattern: str) -> str:
    """``**`` crosses folders, ``*`` and ``?`` stay inside one; all else is literal."""
    out, at = [], 0
    for found in re.finditer(r"\*\*|\*|\?", pattern):
        out += [re.escape(pattern[at : found.start()]), {"**": ".*", "*": "[^/]*", "?": "[^/]"}[found[0]]]
        at = found.end()
    return "^" + "".join(out) + re.escape(pattern[at:]) + "$"


def glob_match(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern))


def is_narrow(path: Column) -> Column:
    """Two or more segments that name a folder."""
    return F.size(F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))) >= 2


def by_name(names: Column) -> Column:
    """Sorted without regard to case; ties by code point."""

    def compare(a: Column, b: Column) -> Column:
        x, y = F.upper(a), F.upper(b)
        return F.when(x < y, -1).when(x > y, 1).when(a < b, -1).when(a > b, 1).otherwise(0)

    return F.array_sort(names, compare)


def file_set(names: Column) -> Column:
    return F.array_join(by_name(names), "|")
