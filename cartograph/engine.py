"""The five commands as an API: index, find_scope, expand_folder, signatures, get_method_source."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import tokens as T
from .functions.embedding import default_embedder
from .functions.paths import EXCLUDED
from .operators import extract, hints, search
from .plans.index import FRESH, IndexStore, build_index, status
from .sources import files as file_source
from .sources import git

INDEX_FOLDER = ".cartograph-index"


@dataclass
class Engine:
    """One repository, or any folder, and its index."""

    spark: SparkSession
    root: str
    index_root: str | None = None
    embedder: object | None = None
    exclude: tuple[str, ...] = EXCLUDED
    notes: list[str] = field(default_factory=list)

    def __post_init__(self):
        self.root = os.path.abspath(self.root)
        self.embedder = self.embedder or default_embedder()
        self.store = IndexStore(self.spark, self.index_root or f"file://{self.root}/{INDEX_FOLDER}")

    @property
    def branch(self) -> str:
        return git.branch(self.root)

    def files(self, content: bool = True) -> DataFrame:
        """The working tree: listed by git, hashed and read from disk, so that an edit that is
        not staged counts.  Outside a repository, all supported files."""
        found = file_source.listing(file_source.scan_folder(self.spark, self.root, content), self.root)
        try:
            listed = git.working_tree(git.git_files(self.spark, self.root), self.exclude).select("path")
            git.worktree_root(self.root)
            return found.join(listed, "path", "left_semi")
        except RuntimeError:
            from .functions.paths import has_segment

            return found.where(~has_segment(F.col("path"), self.exclude))

    def status(self) -> str:
        return status(self.store, self.files(), self.branch)

    def index(self, force: bool = False) -> dict[str, int]:
        return build_index(self.store, self.files(), self.branch, git.head(self.root), self.embedder, force)

    def bind(self, query: str, must: list[str]) -> dict:
        """What a query is made of: vectors and tokens, computed once on the driver."""
        texts = self.spark.createDataFrame([(k, t) for k, t in enumerate([query, *must])], "k int, t string")
        words = [r["w"] for r in texts.select("k", T.query_tokens(F.col("t")).alias("w")).orderBy("k").collect()]
        vectors = self.embedder.embed([query, *must])
        out = {"query_vector": vectors[0].tolist(), "query_terms": words[0]}
        if must:
            out["must_vector"], out["must_tokens"] = search.must_state([v.tolist() for v in vectors[1:]], words[1:])
        return out

    def find_scope(self, query: str, must: list[str] | None = None, top: int | None = None, min_score: float = 0.0) -> DataFrame:
        """``path, score``: the folders that fit best.  An index that is not fresh is brought up first."""
        if not query or not query.strip():
            raise ValueError("a query is needed")
        if self.status() != FRESH:
            self.index()
        common = self.store.meta("common_terms")
        rows = search.search(self.store.vectors(), top=top, min_score=min_score, common=common, **self.bind(query, must or []))
        return rows.select("path", "score")

    def members(self, paths: list[str]) -> DataFrame:
        found, missing = file_source.scan_files(self.spark, paths)
        self.notes += [f"not found: {p}" for p in missing]
        return extract.extract_members(found)

    def signatures(self, paths: list[str]) -> DataFrame:
        return extract.signatures(self.members(paths)).orderBy("path", "start_char")

    def expand_folder(self, folder: str, pattern: str | None = None) -> DataFrame:
        rows = extract.signatures(self.members([folder.rstrip("/\\")]))
        return extract.filter_signatures(rows, pattern)

    def folder_hints(self, paths: list[str]) -> DataFrame:
        found, _ = file_source.scan_files(self.spark, paths)
        lines = F.size(F.split(F.regexp_replace("content", "\n$", ""), "\n", -1))
        return hints.folder_hints(found.select(F.lit("all").alias("folder"), lines.alias("lines")), "folder", "lines")

    def get_method_source(self, path: str, member: str, type_filter: str | None = None, mode: str = extract.SIGNATURE_PLUS_BODY) -> DataFrame:
        return extract.member_source(self.members([path]), member, type_filter, mode)

    def suggest(self, path: str, member: str) -> list[str]:
        return [r[0] for r in extract.suggest_names(self.members([path]), member).collect()]
