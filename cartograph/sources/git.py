"""Git repositories as tables.

``git_files`` is a Python data source: tracked files with the hashes of the index, files
deleted from the working tree, and untracked ones, told apart by ``origin``.  The working
tree is tracked less deleted plus untracked.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.paths import EXCLUDED, file_of, folder_of, has_segment, is_supported

PATTERNS = ("*.cs", "*.ts", "*.tsx")
UNKNOWN = "unknown"
SCHEMA = "path string, hash string, origin string"
TRACKED, DELETED, UNTRACKED = ORIGINS = ("tracked", "deleted", "untracked")


def run_git(arguments: list[str], folder: str) -> str:
    """Output of a git command; a failing one raises."""
    done = subprocess.run(["git", "-c", "core.quotepath=off", *arguments], cwd=folder, capture_output=True, text=True)
    if done.returncode:
        raise RuntimeError(f"git {' '.join(arguments)}: {done.stderr.strip()}")
    return done.stdout


def worktree_root(folder: str) -> str:
    return run_git(["rev-parse", "--show-toplevel"], folder).strip()


def head(folder: str) -> str:
    try:
        return run_git(["rev-parse", "HEAD"], folder).strip()
    except RuntimeError:
        return UNKNOWN


def branch(folder: str) -> str:
    try:
        return run_git(["rev-parse", "--abbrev-ref", "HEAD"], folder).strip()
    except RuntimeError:
        return UNKNOWN


def list_tracked(folder: str) -> Iterator[tuple[str, str, str]]:
    for line in run_git(["ls-files", "-s", "-z", "--abbrev=8", "--", *PATTERNS], folder).split("\0"):
        if line:
            about, _, path = line.partition("\t")
            yield path, about.split(" ")[1], TRACKED


def list_deleted(folder: str) -> Iterator[tuple[str, str, str]]:
    for path in run_git(["ls-files", "-z", "--deleted", "--", *PATTERNS], folder).split("\0"):
        if path:
            yield path, "", DELETED


def list_untracked(folder: str) -> Iterator[tuple[str, str, str]]:
    for path in run_git(["ls-files", "-z", "--others", "--exclude-standard", "--", *PATTERNS], folder).split("\0"):
        if path:
            try:
                about = os.stat(os.path.join(folder, path))
            except OSError:  # gone since
                continue
            yield path, f"wt:{about.st_mtime_ns}:{about.st_size}", UNTRACKED


LISTERS = {TRACKED: list_tracked, DELETED: list_deleted, UNTRACKED: list_untracked}


class _Listing(InputPartition):
    pass


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self):
        return [_Listing(origin) for origin in ORIGINS]

    def read(self, partition):
        yield from LISTERS[partition.value](self.folder)


class GitFiles(DataSource):
    """``spark.read.format("git_files").load(repository)``; a repository is on one machine,
    so the folder must be where the tasks run."""

    @classmethod
    def name(cls):
        return "git_files"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"])


def git_files(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(GitFiles)
    return spark.read.format("git_files").load(folder)


def working_tree(listing: DataFrame, exclude: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """``path, folder, file_name, hash``: what the working tree holds, less excluded folders."""
    gone = listing.where(F.col("origin") == DELETED).select("path")
    tracked = listing.where(F.col("origin") == TRACKED).join(gone, "path", "left_anti")
    rows = tracked.unionByName(listing.where(F.col("origin") == UNTRACKED))
    rows = rows.where(is_supported(F.col("path")) & ~has_segment(F.col("path"), exclude))
    return rows.select("path", folder_of(F.col("path")).alias("folder"), file_of(F.col("path")).alias("file_name"), "hash")
