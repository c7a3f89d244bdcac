"""Source files from any file system that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import file_of, folder_of, glob_regex, glob_root, is_glob, is_supported, normalize

#: Prunes at listing time; any case.
SUFFIXES = "*.{[cC][sS],[tT][sS],[tT][sS][xX]}"


def scan_folder(spark: SparkSession, folder: str, content: bool = True) -> DataFrame:
    """``path, modified, size[, content]`` of all supported files below ``folder``.

    Without ``content`` the bytes are never read.
    """
    rows = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", SUFFIXES).load(folder)
    )
    out = rows.select(
        F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"),
        *([F.decode("content", "UTF-8").alias("content")] if content else []),
    )
    return out.where(is_supported(F.col("path")))


def scan_glob(spark: SparkSession, pattern: str, content: bool = True) -> DataFrame:
    """Files below the pattern's fixed folder whose path fits; ``**`` crosses folders."""
    rows = scan_folder(spark, glob_root(pattern), content)
    regex = glob_regex(pattern.replace("\\", "/"))
    return rows.where(F.col("path").rlike(regex if pattern.startswith("/") else "(^|/)" + regex[1:]))


def scan_files(spark: SparkSession, paths: list[str], content: bool = True) -> tuple[DataFrame, list[str]]:
    """``(files, missing)`` of named files, folders and globs, each path once in any case."""
    import os

    parts, missing, plain = [], [], []
    for path in paths:
        if is_glob(path):
            parts.append(scan_glob(spark, os.path.abspath(path), content))
        elif os.path.isdir(path):
            parts.append(scan_folder(spark, os.path.abspath(path), content))
        elif os.path.isfile(path):
            plain.append(os.path.abspath(path))
        else:
            missing.append(path)
    if plain:
        rows = spark.read.format("binaryFile").load(list(dict.fromkeys(plain)))
        parts.append(rows.select(
            F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"),
            *([F.decode("content", "UTF-8").alias("content")] if content else []),
        ).where(is_supported(F.col("path"))))
    if not parts:
        empty = "path string, modified timestamp, size bigint" + ", content string" * content
        return spark.createDataFrame([], empty), missing
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.withColumn("__key", F.upper("path")).dropDuplicates(["__key"]).drop("__key"), missing


def listing(files: DataFrame, root: str) -> DataFrame:
    """``path, folder, file_name, hash[, content]`` relative to ``root``; content is hashed if
    it was read, else time and size stand for it."""
    top = root.rstrip("/") + "/"
    rel = F.when(F.col("path").startswith(top), F.substring(F.col("path"), F.lit(len(top) + 1), F.length("path"))).otherwise(F.col("path"))
    rows = files.withColumn("path", normalize(rel))
    has = "content" in files.columns
    value = F.sha2("content", 256) if has else F.concat_ws(":", F.lit("wt"), F.unix_micros("modified").cast("string"), F.col("size").cast("string"))
    return rows.select("path", folder_of(F.col("path")).alias("folder"), file_of(F.col("path")).alias("file_name"), value.alias("hash"), *(["content"] if has else []))
