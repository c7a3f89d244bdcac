"""Hints about results: tight score clusters, broad folders, small folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Limits of the hints.
CLUSTER_LEAST, CLUSTER_GAP, CLUSTER_FLOOR = 5, 0.01, 0.70
BROAD_FILES = 30
SMALL_FILES, SMALL_LINES = 20, 50


def score_summary(scored: DataFrame, group_cols: list[str] | None = None, score_col: str = "score") -> DataFrame:
    return scored.groupBy(*(group_cols or [])).agg(F.count("*").alias("n"), F.min(score_col).alias("low"), F.max(score_col).alias("high"))


def cluster_hint(scored: DataFrame, group_cols: list[str] | None = None, score_col: str = "score") -> DataFrame:
    """``n, low, high, gap, tight, suggested``: of five results or more, close together and
    high, more lie just below; ``suggested`` is a lower threshold."""
    rows = score_summary(scored, group_cols, score_col)
    gap = F.when(F.col("n") > 1, (F.col("high") - F.col("low")) / (F.col("n") - 1))
    rows = rows.withColumn("gap", gap)
    tight = F.coalesce((F.col("n") >= CLUSTER_LEAST) & (F.col("gap") <= CLUSTER_GAP) & (F.col("low") > CLUSTER_FLOOR), F.lit(False))
    return rows.withColumn("tight", tight).withColumn("suggested", F.when(F.col("tight"), F.col("low") - F.col("gap")))


def folder_hints(files: DataFrame, folder_col: str, lines_col: str) -> DataFrame:
    """``n_files, mean_lines, broad, small`` of each folder; the mean is rounded down."""
    rows = files.groupBy(folder_col).agg(F.count("*").alias("n_files"), F.floor(F.sum(lines_col) / F.count("*")).alias("mean_lines"))
    return rows.withColumn("broad", F.col("n_files") > BROAD_FILES).withColumn(
        "small", (F.col("n_files") <= SMALL_FILES) & (F.col("mean_lines") <= SMALL_LINES)
    )


def no_match_note(folder: str, pattern: str | None, n_files: int) -> str:
    if pattern:
        return f"No signatures matched pattern '{pattern}' in '{folder}' ({n_files} files scanned)"
    return f"No signatures found in '{folder}'"
