"""Ranked top-k queries over an index of folders: vector likeness and exact terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.common_terms import telling_terms

TOP = 10


def array_literal(values, kind: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def score(
    index: DataFrame, query_vector, query_terms: list[str], must_vector=None, must_tokens: list[str] | None = None,
    common: list[str] | set[str] | None = None, vector_col: str = "embedding", tokens_col: str = "tokens",
) -> DataFrame:
    """``index`` with ``score``: no shuffle and no join, as the query is part of the plan.

    Common terms do not count as terms of the query, but do as must terms.
    """
    rows = index.where(F.col(vector_col).isNotNull())
    tokens = F.coalesce(F.col(tokens_col), F.array().cast("array<string>"))
    terms = telling_terms(array_literal(list(dict.fromkeys(query_terms)), "string"), common)
    total = V.hybrid_score(V.dot(F.col(vector_col), array_literal([float(x) for x in query_vector], "double")), V.match_fraction(terms, tokens))
    if must_vector is not None:
        alike = V.dot(F.col(vector_col), array_literal([float(x) for x in must_vector], "double"))
        total = total + V.must_adjustment(array_literal(must_tokens or [], "string"), tokens, alike)
    return rows.withColumn("score", total)


def rank(scored: DataFrame, top: int | None = TOP, min_score: float = 0.0, tie_col: str = "path") -> DataFrame:
    """Best first, ties by name.  A positive ``min_score`` filters; ``top=None`` with it means
    all, otherwise ten, and so does a ``top`` that is not positive."""
    rows = scored.where(F.col("score") >= min_score) if min_score > 0 else scored
    rows = rows.orderBy(F.desc("score"), tie_col)
    if top is None and min_score > 0:
        return rows
    return rows.limit(top if top and top > 0 else TOP)


def search(index: DataFrame, query_vector, query_terms: list[str], top: int | None = TOP, min_score: float = 0.0, tie_col: str = "path", **more) -> DataFrame:
    return rank(score(index, query_vector, query_terms, **more), top, min_score, tie_col)


def must_state(vectors: list, token_lists: list[list[str]]) -> tuple[list[float], list[str]]:
    """Unit sum of the must texts' vectors, and all their tokens."""
    total = [float(sum(column)) for column in zip(*vectors)]
    length = sum(x * x for x in total) ** 0.5
    unit = [x / length for x in total] if length > V.SMALL else total
    return unit, list(dict.fromkeys(t for tokens in token_lists for t in tokens))


def search_many(index: DataFrame, queries: DataFrame, key_col: str, query_vector_col: str, top: int = TOP, id_col: str = "path", vector_col: str = "embedding", digits: int | None = None) -> DataFrame:
    """Top ``top`` of ``index`` for each row of ``queries``.

    The stated queries meet all index rows in blocks; the window keeps ``top`` rows a query in
    every task before the shuffle (a group limit), so what moves is queries * tasks * top.
    """
    block = queries.select(F.col(key_col), F.col(query_vector_col).alias("__q"))
    rows = index.select(F.col(id_col), F.col(vector_col).alias("__v")).where("__v is not null")
    value = V.dot(F.col("__v"), F.col("__q"))
    value = value if digits is None else F.round(value, digits)
    scored = rows.join(block, F.lit(True), "cross").select(key_col, id_col, value.alias("score"))
    order = Window.partitionBy(key_col).orderBy(F.desc("score"), id_col)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def ranked_line(value: Column, name: Column) -> Column:
    """Score with four decimals, a tab, the name; null if either is."""
    return F.when(value.isNotNull() & name.isNotNull(), F.format_string("%.4f\t%s", value.cast("double"), name))


def ranked_lines(results: DataFrame, name_col: str = "path") -> DataFrame:
    return results.select(ranked_line(F.col("score"), F.col(name_col)).alias("value"))
