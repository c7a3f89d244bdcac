"""Vectors and scores as column expressions; doubles throughout."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the hybrid score.
EXACT_WEIGHT = 0.30
MUST_BONUS = 0.15
MUST_PENALTY = -0.20
MUST_ALIKE = 0.82
SMALL = 1e-9


def dot(a: Column, b: Column) -> Column:
    """Cosine of unit vectors; 0 where the lengths differ.  Added from left to right."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) != F.size(b), F.lit(0.0)).otherwise(F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def rounded(value: Column, digits: int) -> Column:
    """Half away from zero, of the scaled double, as DuckDB rounds; a negative value that rounds
    to zero stays a negative zero, which Spark's ``round`` makes positive."""
    scaled = F.round(value * F.lit(10.0**digits)) / F.lit(10.0**digits)
    return F.when(value < 0, -F.abs(scaled)).otherwise(scaled)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(a: Column) -> Column:
    length = norm(a)
    return F.when(length > SMALL, F.transform(a, lambda x: x.cast("double") / length)).otherwise(F.transform(a, lambda x: x.cast("double")))


def match_count(terms: Column, tokens: Column) -> Column:
    return F.size(F.array_intersect(terms, tokens))


def match_fraction(terms: Column, tokens: Column) -> Column:
    """Share of the terms that are among the tokens; 0 if either is empty."""
    some = (F.size(terms) > 0) & (F.size(tokens) > 0)
    return F.when(some, match_count(terms, tokens) / F.size(terms)).otherwise(F.lit(0.0))


def hybrid_score(cosine: Column, fraction: Column) -> Column:
    return cosine + F.lit(EXACT_WEIGHT) * fraction


def must_adjustment(must_tokens: Column, tokens: Column, must_dot: Column) -> Column:
    """A bonus where a must term occurs; a penalty where none does and the folder is close
    to the must text nevertheless."""
    return (
        F.when(F.arrays_overlap(must_tokens, tokens), F.lit(MUST_BONUS)).when(must_dot > MUST_ALIKE, F.lit(MUST_PENALTY)).otherwise(F.lit(0.0))
    )


def mean_vectors(df: DataFrame, group_cols: list[str], vector_col: str, out_col: str = "centroid") -> DataFrame:
    """Unit mean of the vectors of each group: element sums by position, combined map-side."""
    parts = df.select(*group_cols, F.posexplode(vector_col).alias("__p", "__x")).groupBy(*group_cols, "__p").agg(F.avg(F.col("__x").cast("double")).alias("__x"))
    rows = parts.groupBy(*group_cols).agg(F.transform(F.array_sort(F.collect_list(F.struct("__p", "__x"))), lambda s: s["__x"]).alias(out_col))
    return rows.withColumn(out_col, normalized(F.col(out_col)))


def _each(convert, kind: str):
    @F.pandas_udf(kind)
    def over(rows: pd.Series) -> pd.Series:
        return rows.map(lambda v: None if v is None else convert(v))

    return over


def pack(vectors: Column) -> Column:
    """Little-endian float32 bytes, for stores that keep vectors as blobs."""
    import numpy as np

    return _each(lambda v: np.asarray(v, "<f4").tobytes(), "binary")(vectors)


def unpack(blobs: Column) -> Column:
    import numpy as np

    return _each(lambda b: np.frombuffer(b, "<f4"), "array<float>")(blobs)
