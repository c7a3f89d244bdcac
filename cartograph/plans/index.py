"""The folder index: an incrementally maintained Parquet table.

A version of the index is a directory; a manifest beside them names the current one, the
key of the state that it was built from, and some metadata.  Manifests are numbered, and the
newest that can be read is in force.  A build writes a new version, then a manifest under a
temporary name that is renamed to the next number; only then older manifests go.  So a crash
at any step leaves the old version in force and the next build repairs.  Only folders whose file hashes changed are extracted and embedded again.
"""

from __future__ import annotations

import json
import re
import uuid
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digests, embedding, tokens
from ..functions.common_terms import common_terms
from ..functions.paths import file_set
from ..operators.extract import extract_members, public_names

SCHEMA = (
    "path string, tokens array<string>, embedding_text string, embedding array<float>, "
    "file_hashes map<string,string>, filename_set string"
)
#: Folders that must have a term before it can be common: shares of a few folders say little.
COMMON_FOLDERS = 20
#: Entries of a bucket of the state key, about, at most.
BUCKET = 4096
MISSING, FRESH, STALE = "Missing", "Fresh", "Stale"


class IndexStore:
    """Versions and manifest below one folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[tuple[int, str]]:
        """Numbers and names of the manifests, newest first."""
        fs, root = self._fs(), self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        if not fs.exists(root):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(root)]
        return sorted(((int(m[1]), m[0]) for n in names if (m := re.fullmatch(r"manifest-(\d+)\.json", n))), reverse=True)

    def manifest(self) -> dict | None:
        """All metadata of the newest manifest that can be read; None without an index, an empty one
        if none can be read."""
        found = self._manifests()
        for _, name in found:
            stream = self._fs().open(self._path(name))
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            try:
                values = json.loads(text)
            except ValueError:
                continue
            if isinstance(values, dict):
                return values
        return {} if found else None

    def meta(self, key: str):
        return (self.manifest() or {}).get(key)

    def _swap(self, values: dict) -> None:
        fs, older = self._fs(), self._manifests()
        new, place = self._path(f"manifest-{uuid.uuid4().hex}.tmp"), self._path(f"manifest-{older[0][0] + 1 if older else 1:09d}.json")
        stream = fs.create(new, True)
        try:
            stream.write(bytearray(json.dumps(values, indent=1).encode()))
        finally:
            stream.close()
        self._rename(new, place)
        for _, name in older:
            fs.delete(self._path(name), False)

    def _rename(self, new, place) -> None:
        fs = self._fs()
        if fs.exists(place) or not fs.rename(new, place):
            raise OSError("the manifest could not be put in place: another build may have been faster")

    def put_meta(self, key: str, value) -> None:
        self._swap({**(self.manifest() or {}), key: value})

    def ensure(self) -> None:
        if self.manifest() is None:
            self.write(self.spark.createDataFrame([], SCHEMA), {})

    def read(self) -> DataFrame:
        """The current version; columns that an older writer did not know are filled."""
        version = self.meta("version")
        if not version:
            return self.spark.createDataFrame([], SCHEMA)
        return migrate(self.spark.read.parquet(f"{self.root}/{version}"))

    def states(self) -> DataFrame:
        return self.read().select("path", "file_hashes", "filename_set")

    def vectors(self) -> DataFrame:
        return self.read().where("embedding is not null").select("path", "embedding", "tokens", "embedding_text")

    def write(self, rows: DataFrame, values: dict) -> None:
        version = f"version-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{version}")
        kept = self.manifest() or {}
        previous = kept.get("version")
        self._swap({**kept, **values, "version": version})
        fs = self._fs()
        for status in fs.listStatus(self._path("")):  # the version before the last stays for readers
            name = status.getPath().getName()
            if name.startswith("version-") and name not in (version, previous):
                fs.delete(status.getPath(), True)

    @contextmanager
    def staging(self):
        """A function that writes a table for the time of a build and reads it back."""
        name = f"staging-{uuid.uuid4().hex}"

        def stage(rows: DataFrame, table: str) -> DataFrame:
            rows.write.parquet(f"{self.root}/{name}/{table}")
            return self.spark.read.schema(rows.schema).parquet(f"{self.root}/{name}/{table}")

        try:
            yield stage
        finally:
            self._fs().delete(self._path(name), True)

    def upsert(self, rows: DataFrame, values: dict | None = None) -> None:
        self.write(upserted(self.read(), rows), values or {})

    def keep(self, live: DataFrame) -> None:
        self.write(pruned(self.read(), live), {})

    def clear(self) -> None:
        self.write(self.spark.createDataFrame([], SCHEMA), {})


def migrate(rows: DataFrame) -> DataFrame:
    """Rows in the current schema: missing columns null, hashes from JSON, file sets made
    from them, texts and tokens with their fallbacks."""
    have = dict(rows.dtypes)
    if have.get("file_hashes") == "string":
        rows = rows.withColumn("filename_set", F.coalesce(F.col("filename_set") if "filename_set" in have else F.lit(None).cast("string"), digests.json_file_set(F.col("file_hashes"))))
        rows = rows.withColumn("file_hashes", F.from_json("file_hashes", "map<string,string>"))
    if "tokens" not in have:
        old = F.coalesce(F.col("combined_tokens"), F.lit("")) if "combined_tokens" in have else F.lit("")
        rows = rows.withColumn("tokens", F.filter(F.split(old, " "), lambda t: t != ""))
    if "embedding_text" not in have:
        rows = rows.withColumn("embedding_text", F.array_join("tokens", " "))
    for field in SCHEMA.split(", "):
        name, kind = field.split(" ", 1)
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows.select(
        "path", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"),
        F.coalesce("embedding_text", F.array_join("tokens", " ")).alias("embedding_text"), "embedding", "file_hashes", "filename_set",
    )


def upserted(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    return old.join(new.select(key), key, "left_anti").select(*new.columns).unionByName(new)


def pruned(index: DataFrame, live: DataFrame, key: str = "path") -> DataFrame:
    return index.join(live.select(key).distinct(), key, "left_semi")


def group_folders(files: DataFrame) -> DataFrame:
    """``path, file_hashes, filename_set``: a row a folder.  Names that differ in case only
    count once, the last by code point."""
    named = files.groupBy("folder", F.upper("file_name").alias("__k")).agg(F.max(F.struct("file_name", "hash")).alias("f"))
    lists = named.groupBy("folder").agg(F.collect_list("f").alias("fs"))
    return lists.select(
        F.col("folder").alias("path"), F.map_from_entries(F.array_sort("fs")).alias("file_hashes"),
        file_set(F.transform("fs", lambda f: f["file_name"])).alias("filename_set"),
    )


def changed(live: DataFrame, stored: DataFrame, key: str = "path", hashes: str = "file_hashes") -> DataFrame:
    """Rows of ``live`` that ``stored`` lacks or has with other hashes."""
    known = stored.select(F.col(key), digests.hashes_json(F.col(hashes)).alias("__old"))
    return live.join(known, key, "left").where(~digests.hashes_json(F.col(hashes)).eqNullSafe(F.col("__old"))).drop("__old")


def folder_status(live: DataFrame, stored: DataFrame, key: str = "path", hashes: str = "file_hashes") -> DataFrame:
    """``key, status`` of each live folder: not stored, stored as it is, or with other hashes."""
    known = stored.select(F.col(key), digests.hashes_json(F.col(hashes)).alias("__old"))
    same = digests.hashes_json(F.col(hashes)) == F.col("__old")
    state = F.when(F.col("__old").isNull(), F.lit(MISSING)).when(same, F.lit(FRESH)).otherwise(F.lit(STALE))
    return live.join(known, key, "left").select(key, state.alias("status"))


def state_key_of(files: DataFrame, branch: str) -> str:
    """Key of a listing: two levels of digests, so that no task holds all entries.

    Entries meet in buckets by the first hexadecimal digits of their MD5, one more for each
    sixteenfold listing, so that a bucket has ``BUCKET`` entries at most, about; the key is
    that of the buckets' digests.
    """
    entries = files.select(F.concat_ws(":", "path", "hash").alias("e")).distinct()
    digits = bucket_digits(entries.count())
    buckets = entries.groupBy(F.substring(F.md5("e"), 1, digits).alias("b")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("e")), "\n"), 256).alias("d")
    )
    row = buckets.agg(digests.state_key(F.lit(branch), F.collect_list(F.concat_ws(":", "b", "d"))).alias("k")).first()
    return row["k"]


def bucket_digits(count: int) -> int:
    digits = 1
    while count > BUCKET * 16**digits:
        digits += 1
    return digits


def status(store: IndexStore, files: DataFrame, branch: str) -> str:
    found = store.manifest()
    if found is None:
        return MISSING
    key = found.get("index_state_key")
    if not key:
        return STALE
    return FRESH if key == state_key_of(files, branch) else STALE


def describe_folders(folders: DataFrame, files: DataFrame, embedder) -> DataFrame:
    """Index rows of ``folders``: tokens, text and vector.  ``files`` has path, folder and content."""
    wanted = files.join(folders.select(F.col("path").alias("folder")), "folder", "left_semi")
    names = public_names(extract_members(wanted))
    at = wanted.select("path", "folder").join(names, "path")
    methods = at.groupBy("folder").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("path", "names"))), lambda s: s["names"]))).alias("methods"))
    rows = folders.join(methods.withColumnRenamed("folder", "path"), "path", "left")
    listed, public = F.split("filename_set", r"\|"), F.coalesce("methods", F.array().cast("array<string>"))
    rows = rows.select(
        "path", tokens.combined_tokens(F.col("path"), listed, public).alias("tokens"),
        tokens.embedding_text(F.col("path"), listed, public).alias("embedding_text"), "file_hashes", "filename_set",
    )
    return rows.select("path", "tokens", "embedding_text", embedding.embed_column(F.col("embedding_text"), embedder).alias("embedding"), "file_hashes", "filename_set")


def build_index(store: IndexStore, files: DataFrame, branch: str, head: str = "unknown", embedder=None, force: bool = False) -> dict[str, int]:
    """Bring the index up to ``files(path, folder, file_name, hash, content)``.

    Contents are hashed in one pass, and read again for changed folders only; the listing,
    the folders and what changed are staged as tables beside the versions meanwhile.
    Returns how many folders there are, and how many were updated, kept and removed.
    """
    embedder = embedder or embedding.default_embedder()
    with store.staging() as stage:
        listed = stage(files.select("path", "folder", "file_name", "hash"), "files")
        live = stage(group_folders(listed), "folders")
        old = store.spark.createDataFrame([], SCHEMA) if force else store.read()
        updated = stage(changed(live, old), "changed")
        kept = pruned(old, live).join(updated.select("path"), "path", "left_anti")
        fresh = describe_folders(updated, files, embedder)
        total, n_updated, before = live.count(), updated.count(), old.select("path").count()
        values = {"index_state_key": state_key_of(listed, branch), "git_head": head, "indexed_at": datetime.now(timezone.utc).isoformat()}
        gone = before - old.select("path").join(live.select("path"), "path", "left_semi").count()
        store.write(kept.unionByName(fresh), values)
    terms = common_terms(store.read(), "path", "tokens").where(F.col("n_folders") >= COMMON_FOLDERS).select("term")
    store.put_meta("common_terms", sorted(r["term"] for r in terms.collect()))  # a seventh of a folder's terms or so
    return {"folders": total, "updated": n_updated, "unchanged": total - n_updated, "removed": gone}
