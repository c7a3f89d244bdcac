"""Terms too common to tell folders apart.

The list is derived from the data alone: a term is common if more than a given share of
folders has it.  A caller may add terms of a resource of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARE = 0.15


def load_terms(text: str) -> list[str]:
    """Terms of a resource: a line each, trimmed; blank and ``#`` lines do not count."""
    return [line.strip() for line in text.splitlines() if line.strip() and not line.strip().startswith("#")]


def common_terms(folders: DataFrame, key_col: str, tokens_col: str, share: float = SHARE) -> DataFrame:
    """``(term, n_folders)`` of the terms that more than ``share`` of the rows have."""
    total = folders.agg(F.count("*").alias("total"))
    terms = folders.select(key_col, F.explode(F.array_distinct(tokens_col)).alias("term"))
    counted = terms.groupBy("term").agg(F.count("*").alias("n_folders"))
    limit = total.select(F.col("total") * F.lit(share)).scalar()  # one number
    return counted.where(F.col("n_folders") > limit)


def telling_terms(terms: Column, common: list[str] | set[str] | None = None) -> Column:
    """The terms of a query that are not common, in order."""
    drop = sorted(common or ())
    return F.array_except(terms, F.array(*[F.lit(t) for t in drop]).cast("array<string>"))
