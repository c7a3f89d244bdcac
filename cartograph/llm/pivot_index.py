"""Embedding near-duplicates by a pivot-permutation index.

Reference points (pivots) are chosen farthest-first from a bounded sample, so that a dense
group of vectors holds one of them at most.  Every vector is described by its nearest pivots,
in each of two or more sets of pivots that come from samples apart.  The inverted lists of
the index are kept by triples of pivots of a set: a list holds the vectors of a label that
have all three among their nearest, so two vectors meet exactly if they share at least three
pivots of a set; what one set misses, another one mostly finds.  The number of pivots grows
with the cube root of the largest label's rows, so that lists of unrelated vectors stay as
short as the table grows.  Candidates are verified by cosine in double precision.  A pair
that meets in several lists counts in one only, that of its three smallest shared pivots in
the first set where it meets.

Equal vectors of a label meet in one class first, which has a key of its own: ids are carried
along and name nothing.  A long list is cut into blocks, and every two blocks are compared in
a task of their own.  No pair is written: a list gives each of its classes the number of its
links and the smallest key of its group in the list.

Defined results: a vector that is null, zero or holds null or non-finite components, or whose
label is null, links with nothing; so do vectors of different lengths.  Rows that repeat an
id are vectors of their own that share it.  A row without id has no component.  A component
is named by the smallest id of its rows.  An empty table gives no rows; other columns are
ignored whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, connected_components

LEAST = 0.93
#: Vectors that the pivots of a set are chosen from at most, of those whose id hashes lowest.
FIT_VECTORS = 4096
#: Pivots of a set, at least and at most (12 bits of a key each).
FEWEST, MOST = 256, 4096
NEAREST = 7
SHARED = 3
#: Unrelated vectors of a label that a vector meets in a set, about.
STRAY = 4
#: Independent sets of pivots: few pivots lose fewer pairs.  At most 4 fit in a key.
SETS, MORE_SETS, MORE_FROM = 2, 3, 1500
#: Pivots are less alike than this.
APART = 0.7
BLOCK = 128
#: Lists from this length on are compared as matrices.
MATRIX = 24
#: Pairs that are compared at once.
AT_ONCE = 1 << 16


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first from ``sample`` (unit rows): each is least like those before it.  It ends
    early where the next one would be close to another, so a dense group has one pivot at most
    and its members, however many the sample has, keep the same nearest pivots."""
    order, near = [0], sample @ sample[0]
    while len(order) < min(count, len(sample)):
        k = int(near.argmin())
        if near[k] > APART:
            break
        order.append(k)
        near = np.maximum(near, sample @ sample[k])
    return sample[order]


def pivot_count(rows: int, nearest: int = NEAREST) -> int:
    """Pivots of a set for ``rows`` vectors of a label: two unrelated vectors share a triple with
    probability C(nearest, 3) ** 2 / C(pivots, 3), so ``STRAY`` of them meet a vector."""
    return int(min(MOST, max(FEWEST, (6 * math.comb(nearest, 3) ** 2 * rows / STRAY) ** (1 / 3))))


def fit_pivots(classes: DataFrame, count: int, sets: int, fit_vectors: int = FIT_VECTORS) -> list[dict[int, np.ndarray]]:
    """Sets of pivots by length of vector, from a bounded sample that is dealt to the sets."""
    mark = F.xxhash64("rep", "label", "vector")
    rows = classes.select("vector", mark.alias("mark")).orderBy("mark").limit(fit_vectors * sets).select("vector").collect()
    by_size: dict[int, list] = {}
    for r in rows:
        by_size.setdefault(len(r[0]), []).append(r[0])
    units = {size: _unit(np.array(some, dtype=float)) for size, some in by_size.items()}
    return [{size: choose_pivots(some[k::sets], count) for size, some in units.items() if len(some) > k} for k in range(sets)]


def _pivots_of(pivots: dict[int, np.ndarray], size: int) -> np.ndarray:
    if size not in pivots:  # a length that the sample missed: directions from a fixed seed
        pivots[size] = _unit(np.random.default_rng(size).standard_normal((64, size)))
    return pivots[size]


def _rows_of(column: pa.Array, at: np.ndarray, size: int) -> np.ndarray:
    """Rows ``at`` of a list column, all of ``size`` numbers, as doubles."""
    return column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), size).astype(float)


def describe(classes: DataFrame, pivots: list[dict[int, np.ndarray]], nearest: int = NEAREST, shared: int = SHARED) -> DataFrame:
    """``classes(vec, label, vector, n)`` with ``near`` (of each set the nearest pivots, ascending,
    and -1 where it has fewer) and ``keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            labels = batch.column(1).to_numpy().astype(np.int64)
            sizes = np.diff(np.asarray(column.offsets))
            near: list = [None] * len(labels)
            keys: list = [None] * len(labels)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                unit = _unit(_rows_of(column, at, int(size)))
                base = (labels[at] * 1_000_003 + size) % (1 << 24)
                tops, codes = [], []
                for number, some in enumerate(pivots):
                    points = _pivots_of(some, int(size))
                    width = min(nearest, len(points))
                    cosine = unit @ points.T
                    top = np.argpartition(-cosine, width - 1, axis=1)[:, :width].astype(np.int64)
                    top.sort(axis=1)
                    ways = np.array(list(combinations(range(width), min(shared, width))))
                    code = np.zeros((len(at), len(ways)), np.int64)
                    for c in range(ways.shape[1]):
                        code = code * 4096 + top[:, ways[:, c]]
                    codes.append(code | (base * 4 + number)[:, None] << 36)
                    tops.append(np.pad(top, ((0, 0), (0, nearest - width)), constant_values=-1))
                top, code = np.concatenate(tops, axis=1), np.concatenate(codes, axis=1)
                for k, r in enumerate(at):
                    near[r], keys[r] = top[k], code[k]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(near, pa.list_(pa.int16())), pa.array(keys, pa.list_(pa.int64()))],
                ["vec", "label", "vector", "n", "near", "keys"],
            )

    kind = classes.schema["vector"].dataType.simpleString()
    return classes.select("vec", "label", "vector", "n").mapInArrow(
        run, f"vec long, label long, vector {kind}, n long, near array<smallint>, keys array<long>"
    )


def _pairs(cut: np.ndarray, sizes: np.ndarray, side: np.ndarray, unit: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs ``i < j`` of rows of one list, those of long lists only if they are alike."""
    for size in np.unique(sizes[sizes > 1]):
        starts = cut[sizes == size]
        if size < MATRIX:
            i, j = np.triu_indices(size, 1)
            each = max(1, AT_ONCE // len(i))
            for at in range(0, len(starts), each):
                some = starts[at : at + each, None]
                yield (some + i).ravel(), (some + j).ravel()
        else:
            for start in starts:
                for at in range(start, start + size, 512):
                    i, j = np.nonzero(unit[at : min(at + 512, start + size)] @ unit[start : start + size].T >= least - 1e-9)
                    i, j = i + at, j + start
                    yield i[i < j], j[i < j]


def _compare(rows: DataFrame, least: float, shared: int, nearest: int) -> DataFrame:
    """Rows sorted by ``key, side`` to ``(vec, links, low)`` of each list."""

    def links(code, side, own, vec, label, n, near, vector):
        """All pairs of one run of whole groups, in steps."""
        if len(vec) < 2:
            return None
        cut = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (side[1:] != side[:-1])])
        sizes = np.diff(np.r_[cut, len(vec)])
        degree, low = np.zeros(len(vec), np.int64), vec.copy()
        unit = _unit(vector)
        found_i, found_j = [], []
        for i, j in _pairs(cut, sizes, side, unit, least):
            # In two blocks, only pairs across; labels alike; near; this list is the pair's own.
            ok = (label[i] == label[j]) & ((own[i] != own[j]) | (side[i] % 2 == 0))
            i, j = i[ok], j[ok]
            ok = np.einsum("ij,ij->i", unit[i], unit[j]) >= least
            i, j = i[ok], j[ok]
            for k in range(near.shape[1]):
                number, top = code[i] >> 36 & 3, code[i] & 4095
                a, b = near[i, k], near[j, k]
                top = np.where(number == k, top, 4095)
                both = ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] <= top[:, None, None]) & (a[:, :, None] >= 0)).sum((1, 2))
                enough = np.minimum(shared, (a >= 0).sum(axis=1))
                ok = (number < k) | np.where(number == k, both == enough, both < enough)
                i, j = i[ok], j[ok]
            found_i.append(i), found_j.append(j)
        i, j = (np.concatenate(x) if x else np.zeros(0, int) for x in (found_i, found_j))
        if not len(i):
            return None
        np.add.at(degree, i, n[j])
        np.add.at(degree, j, n[i])
        while True:
            before = low.copy()
            np.minimum.at(low, i, low[j])
            np.minimum.at(low, j, low[i])
            if (low == before).all():
                break
        keep = degree > 0
        return pa.RecordBatch.from_arrays([pa.array(vec[keep]), pa.array(degree[keep]), pa.array(low[keep])], ["vec", "links", "low"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def arrays(table):
            flat = table.column("vector").combine_chunks()
            near = table.column("near").combine_chunks()
            sizes = np.diff(np.asarray(flat.offsets))
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                get = lambda c: table.column(c).to_numpy().astype(np.int64)[at]  # noqa: E731, B023
                width = len(near[0])
                yield (get("key"), get("side"), get("own"), get("vec"), get("label"), get("n"),
                       _rows_of(near, at, width).reshape(len(at), -1, nearest).astype(np.int64), _rows_of(flat, at, int(size)))

        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                table = pa.Table.from_batches([batch.slice(at, 4096)])
                held = table if held is None else pa.concat_tables([held, table])
                code, side = held.column("key").to_numpy(), held.column("side").to_numpy()
                whole = np.flatnonzero((code != code[-1]) | (side != side[-1]))  # the last group may go on
                if len(whole):
                    done, held = held.slice(0, whole[-1] + 1), held.slice(whole[-1] + 1)
                    for args in arrays(done):
                        if (out := links(*args)) is not None:
                            yield out
        if held is not None:
            for args in arrays(held):
                if (out := links(*args)) is not None:
                    yield out

    return rows.select("key", "side", "own", "vec", "label", "n", "near", "vector").mapInArrow(run, "vec long, links long, low long")


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    least: float = LEAST, pivots: int | None = None, nearest: int = NEAREST, shared: int = SHARED, sets: int | None = None,
) -> DataFrame:
    """``(id_col, n_links, component_id, kept)``: a row a vector.

    ``pivots`` and ``sets`` follow the number of rows unless they are given.
    """
    ws = Workspace(vectors.sparkSession, "pivots")
    vector = F.col(f"`{vector_col}`")
    if vectors.schema[vector_col].dataType.simpleString() != "array<float>":  # floats move as floats
        vector = vector.cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), vector.alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.coalesce(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.forall("vector", finite) & F.exists("vector", lambda x: x != 0), F.lit(False)
    )
    good = rows.where(usable)
    # A class is named by its row in this table; written, the names stay.
    classes = ws.table(
        good.groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
        .select(F.monotonically_increasing_id().alias("vec"), "label", "vector", "rep", "n"), "classes",
    )
    if pivots is None:
        most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
        pivots = pivot_count(most, nearest)
    points = fit_pivots(classes, min(pivots, MOST), sets or (MORE_SETS if pivots >= MORE_FROM else SETS))
    index = ws.table(describe(classes, points, nearest, shared), "index")
    posted = index.select("vec", F.explode("keys").alias("key"))
    lists = posted.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    entries = posted.join(lists, "key").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    entries = entries.withColumn("own", F.pmod(F.xxhash64("vec"), F.col("blocks")).cast("int"))
    # One group for each two blocks; even sides are a block with itself.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    entries = entries.withColumn("other", other).withColumn(
        "side", (F.least("own", "other").cast("long") * F.col("blocks") + F.greatest("own", "other")) * 2 + (F.col("own") != F.col("other")).cast("int")
    ).select("key", "side", "own", "vec")
    full = entries.join(index.select("vec", "label", "vector", "n", "near"), "vec")
    dealt = full.repartition("key", "side").sortWithinPartitions("key", "side")
    found = ws.table(_compare(dealt, least, shared, nearest), "links")
    degrees = found.groupBy("vec").agg(F.sum("links").alias("links"))
    components = connected_components(ws, found.select(F.col("vec").alias("a"), F.col("low").alias("b")))
    group = F.coalesce("component", "vec")
    grouped = ws.table(
        classes.select("vec", "label", "rep", "n").join(degrees, "vec", "left").join(components.withColumnRenamed("id", "vec"), "vec", "left")
        .select("vec", "rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), group.alias("component")), "groups",
    )
    # A table of its own: a component of very many classes can then be split in the join with it.
    named = ws.table(grouped.groupBy("component").agg(F.min("rep").alias("component_id")), "components")
    known = grouped.join(named, "component").select("vec", "n_links", "component_id").join(classes.select("vec", "label", "vector"), "vec").drop("vec")
    linked = good.join(known, ["label", "vector"]).select("id", "n_links", "component_id")
    alone = rows.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.union(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    )
    return ws.keep_only(out)
