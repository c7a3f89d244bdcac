"""Near-duplicate documents by Order MinHash.

Every text becomes its sequence of word 5-grams, each labelled with its occurrence number,
so that all labels of a text differ.  A band keeps the few labels of smallest hash and
hashes them in text order: two texts share a band only if they share those 5-grams in the
same order.  Bands of short texts say too little (all labels of a text of 4 never equal
those of a text of 5), so a text of at most 14 labels is also posted under every ordered part
of its labels that a partner can share at the asked similarity: two such texts meet for
certain.  Candidates that share a band or such a part are verified by a banded alignment of
the two label sequences: the longest common subsequence inside the band of shifts that the asked
similarity allows, found as an increasing subsequence since labels are unique.  With c
aligned 5-grams of m and n, the similarity is c / (m + n - c), the Jaccard index of the
aligned 5-grams.

Groups of copies: equal texts meet in one representative first.  In each bucket all members
are compared with its smallest one.  In buckets that then still hold several components,
every member outside the main one is compared with every member of another component, in
blocks, each pair in the first bucket that it shares and only until a link joins the two
components.  So no pair of a bucket is left open, and nothing is capped; pairs inside a
component, as in a group of many near copies, are not made.  Members of a part meet the one
that lacks fewest labels beside it: whoever links with another by that part links with it.

Buckets with many members outside the main component arise from passages that many texts
share.  Their members are not crossed but dealt anew by rare labels: of texts of n labels with
similarity t, each has one of the other's among its n - ceil(t n) + 1 rarest.  So every pair
that can link meets in the bucket of such a label, where the same steps follow.

Words are runs without white space, single characters in scripts without spaces (see
``scripts``).  Rows have numbers of their own while the operator works, so a repeated id is
no more than a repeated id.

Defined results: a null text links with nothing; empty texts equal each other, and so do
texts of equal words and white space only if they are equal strings or align fully; a text
of under five words is one 5-gram of its words.  The class is named by its smallest id (null
if it has none), and of each class one row is kept, that of smallest id, null ids last.
Repeated rows are copies of each other.  An empty table gives no rows.  Very long texts are
read whole.  Columns that the caller names do not clash with those made here.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import steps
from .common import Workspace, connected_components
from .scripts import words_of

WORDS = 5
SIMILARITY = 0.8
#: A pair with c labels of u in common shares a band of 5 with probability C(c, 5) / C(u, 5): at 0.8 long texts
#: miss all 28 with 1.5e-5, 40 of 50 with 3e-5, 16 of 20 with 9e-5, and 12 of 15 (12 against 15) with 2e-4.
BANDS = 28
BAND_LABELS = 5
#: Parts of a short text at most; a text that would have more is not short.  At 0.8, 14 labels have 106.
PARTS = 128
#: Members of a bucket in one block, about, and members outside the main component of a bucket
#: that is dealt anew by rare labels: so many blocks would meet all the others.
BLOCK = 192
LARGE = 4 * BLOCK


_MIX1, _MIX2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def labels_of(text: str, known: _WordHashes, words: int = WORDS) -> np.ndarray:
    """Hashes of the occurrence-numbered word n-grams of ``text``, in text order."""
    found = words_of(text)
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    if len(h) == 0:
        return h
    n = max(1, len(h) - words + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(h))):
        out = _mix(out * _GOLD + h[k : k + n] + np.uint64(k + 1))
    order = np.argsort(out, kind="stable")
    ranked = out[order]
    first = np.r_[True, ranked[1:] != ranked[:-1]]
    if not first.all():
        place = np.arange(n)
        number = np.empty(n, np.uint64)
        number[order] = (place - np.maximum.accumulate(np.where(first, place, 0))).astype(np.uint64)
        out = np.where(number > 0, _mix(out + number * _GOLD), out)
    return out


#: Odd multipliers; labels are mixed already, so a product orders them anew in each band.
_ODD = _mix(np.arange(1, 513, dtype=np.uint64) * _GOLD) | np.uint64(1)
#: Labels of a text that are hashed for all bands at once.
_AT_ONCE = 1 << 15


def bands_of(labels: np.ndarray, bands: int = BANDS, size: int = BAND_LABELS) -> np.ndarray:
    """One signed 64-bit key a band; none for a text without words."""
    n = len(labels)
    if n == 0:
        return np.zeros(0, np.int64)
    odd = _ODD[:bands, None]
    if n <= size:
        low = np.broadcast_to(labels * odd, (bands, n))
    elif n <= _AT_ONCE:
        h = labels * odd
        place = np.argpartition(h, size, axis=1)[:, :size]
        place.sort(axis=1)  # text order
        low = np.take_along_axis(h, place, axis=1)
    else:
        low = np.empty((bands, size), np.uint64)
        for b in range(bands):
            h = labels * _ODD[b]
            low[b] = h[np.sort(np.argpartition(h, size)[:size])]
    key = np.arange(1, bands + 1, dtype=np.uint64) * _GOLD
    for k in range(low.shape[1]):
        key = _mix((key ^ low[:, k]) * _MIX2)
    return key.view(np.int64)


@lru_cache(maxsize=None)
def _choices(n: int, least: float) -> tuple[tuple[np.ndarray, int], ...] | None:
    """``(places, code)`` for each number of labels that a text of ``n`` can lack beside a part:
    the code is 8 times that number, plus how many a partner can lack at most."""
    room = lambda lost: math.floor((n - lost) * (1 / least - 1) + 1e-9) - lost
    if n > PARTS or room(0) < 1:  # without room only equal labels link, and they share all bands
        return None
    out, total = [], 0
    for lost in range(n):
        total += math.comb(n, lost)
        if room(lost) < 0:
            break
        if total > PARTS:
            return None
        out.append((np.array(list(combinations(range(n), n - lost))), lost * 8 + min(room(lost), 7)))
    return tuple(out)


def parts_of(labels: np.ndarray, least: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Signed 64-bit keys and codes (see ``_choices``) of the parts of a short text, else none."""
    keys, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for places, code in _choices(len(labels), least) or ():
        key = np.full(len(places), places.shape[1], np.uint64) * _GOLD
        for k in range(places.shape[1]):
            key = _mix((key ^ labels[places[:, k]]) * _MIX2)
        keys.append(key.view(np.int64))
        codes.append(np.full(len(key), code, np.int32))
    return np.concatenate(keys), np.concatenate(codes)


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Similarity by banded alignment of two label sequences; below ``least`` it may be 0."""
    m, n = len(a), len(b)
    if not m or not n or min(m, n) < least * max(m, n):
        return float(m == n)
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    need = least / (1 + least) * (m + n)
    if len(common) < need - 1e-9:
        return 0.0
    band = max(m, n) - need + 1  # a further shift leaves too few labels to align
    order = np.argsort(i)
    i, j = i[order], j[order]
    j = j[np.abs(i - j) <= band]
    if len(j) > 1 and not (np.diff(j) > 0).all():
        from bisect import bisect_left

        tails: list[int] = []
        for x in j.tolist():
            k = bisect_left(tails, x)
            if k == len(tails):
                tails.append(x)
            else:
                tails[k] = x
        c = len(tails)
    else:
        c = len(j)
    return c / (m + n - c)


def sketches(whole: DataFrame, bands: int = BANDS, size: int = BAND_LABELS, least: float = SIMILARITY) -> DataFrame:
    """``whole(id, text)`` to ``(id, copy, bands, parts, codes)``: copy hashes the whole text
    (null for null), bands are the keys, parts and their codes are those of a short text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            for part in steps(batch):
                ids, texts = part.column(0), part.column(1).to_pylist()
                copies = [None if t is None else xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts]
                keys, parts, codes = [], [], []
                for t in texts:
                    labels = labels_of(t or "", known)
                    keys.append(None if t is None else bands_of(labels, bands, size).tolist())
                    part_keys, part_codes = parts_of(labels, least)
                    parts.append(part_keys)
                    codes.append(part_codes)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(copies, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                     pa.array(parts, pa.list_(pa.int64())), pa.array(codes, pa.list_(pa.int32()))],
                    ["id", "copy", "bands", "parts", "codes"],
                )

    return whole.mapInArrow(run, "id long, copy binary, bands array<long>, parts array<long>, codes array<int>")


def _labelled(texts: DataFrame) -> DataFrame:
    """``(id, text, bands)`` to ``(id, labels, bands)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            for part in steps(batch):
                labels = [pa.array(labels_of(t, known).view(np.int64)) for t in part.column(1).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in labels])]).astype(np.int32)
                flat = pa.concat_arrays(labels) if labels else pa.array([], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(offsets, flat), part.column(2)], ["id", "labels", "bands"]
                )

    return texts.select("id", "text", "bands").mapInArrow(run, "id long, labels array<long>, bands array<long>")


def _lists(column: pa.Array) -> list[np.ndarray]:
    """Rows of a list column as views of one array."""
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets)
    offsets = offsets - offsets[0]
    return [flat[i:j].view(np.uint64) for i, j in zip(offsets[:-1], offsets[1:])]


def _verified(pairs: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """The ``(a, b)`` of ``pairs`` that align.  One side's labels are shuffled with each pair."""
    left = pairs.join(labels.select(F.col("id").alias("a"), F.col("labels").alias("la")), "a")
    both = left.join(labels.select(F.col("id").alias("b"), F.col("labels").alias("lb")), "b").select("a", "b", "la", "lb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                good = [aligned_similarity(x, y, least) >= least for x, y in zip(_lists(part.column(2)), _lists(part.column(3)))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _across(rows: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """Links ``(a, b)`` between components of the same bucket.

    ``rows(id, key, component, main, minor, total)``.  Members outside the main component are
    queries, all members are answers; either are cut into blocks, and a task compares one
    block of queries with one of answers.  A pair that shares several buckets, by the keys in
    ``bands``, is compared in that of the smallest key only, and not at all once links of the
    task have joined its components.
    """
    query = F.col("component") != F.col("main")
    answers, queries = F.ceil(F.col("total") / BLOCK).cast("int"), F.ceil(F.col("minor") / BLOCK).cast("int")
    i, j = F.pmod(F.xxhash64("id"), answers).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), queries).cast("int")
    place = lambda x, y, role: F.struct((x.cast("long") * queries + y).alias("side"), F.lit(role).alias("role"))
    as_answer = F.transform(F.sequence(F.lit(0), queries - 1), lambda y: place(i, y, 1))
    as_query = F.when(query, F.transform(F.sequence(F.lit(0), answers - 1), lambda x: place(x, j, 0))).otherwise(
        F.array().cast("array<struct<side:bigint,role:int>>")
    )
    dealt = (
        rows.withColumn("minor_id", query).withColumn("at", F.concat(as_answer, as_query))
        .join(labels, "id").withColumn("at", F.explode("at"))
        .select("key", F.col("at.side").alias("side"), F.col("at.role").alias("role"), "id", "component", "minor_id", "bands", "labels")
    )
    dealt = dealt.repartition("key", "side").sortWithinPartitions("key", "side", "role", "id")

    def compare(group: list[tuple]) -> list[tuple[int, int]]:
        asked, given = [r for r in group if r[2] == 0], [r for r in group if r[2] == 1]
        if not asked or not given:
            return []
        key = np.int64(group[0][0])
        lower = [frozenset((keys := r[6].view(np.int64))[keys < key].tolist()) for r in given]
        sizes_q, sizes_a = np.array([len(r[7]) for r in asked]), np.array([len(r[7]) for r in given])
        joined: dict[int, int] = {}

        def root(c: int) -> int:
            while c in joined:
                c = joined[c]
            return c

        out = []
        ids_a, minor_a = np.array([r[3] for r in given]), np.array([r[5] for r in given])
        comps_a = np.array([r[4] for r in given])
        for k, r in enumerate(asked):
            mine = (comps_a != r[4]) & (~minor_a | (ids_a < r[3]))
            mine &= np.minimum(sizes_a, sizes_q[k]) >= least * np.maximum(sizes_a, sizes_q[k])
            own = r[6].view(np.int64)
            own = frozenset(own[own < key].tolist())
            for x in np.flatnonzero(mine):
                g = given[x]
                one, two = root(r[4]), root(g[4])
                if one != two and own.isdisjoint(lower[x]) and aligned_similarity(r[7], g[7], least) >= least:
                    joined[max(one, two)] = min(one, two)
                    out.append((max(r[3], g[3]), min(r[3], g[3])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            found = []
            for part in steps(batch):
                plain = [part.column(c).to_pylist() for c in range(6)]
                for r in zip(*plain, _lists(part.column(6)), _lists(part.column(7))):
                    if group and group[0][:2] != r[:2]:
                        found += compare(group)
                        group = []
                    group.append(r)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])
        found = compare(group) if group else []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _rare(labels: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """``(id, key)``: the labels of ``members(id, component)`` by which any two of different
    components that can link must meet: of their rarest, those that another component has too."""
    own = labels.join(members, "id").select("id", "component", F.size("labels").alias("n"), F.explode("labels").alias("key"))
    often = own.groupBy("key").agg(F.count("*").alias("often"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key", "often")
    own = own.drop("component")
    shared = own.join(often, "key")
    place = Window.partitionBy("id").orderBy("often", "key")
    reach = F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1
    # Labels of one component come first; they take places, but nobody meets there.
    counted = shared.groupBy("id").agg(F.count("*").alias("found"))
    ranked = shared.withColumn("place", F.row_number().over(place)).join(counted, "id")
    return ranked.where(F.col("place") <= reach - (F.col("n") - F.col("found"))).select("id", "key")


def _classes(ws: Workspace, rows: DataFrame, least: float, bands: int, size: int) -> DataFrame:
    """``rows(row, text)`` to ``(row, class)``: the smallest row of the component of each row."""
    whole = rows.select(F.col("row").alias("id"), "text")
    all_rows = ws.table(sketches(whole, bands, size, least), "sketches")
    # Equal texts: one representative each.  Rows with null text stand alone.
    # A table of its own: a text of very many copies can then be split in the joins with it.
    copies = ws.table(all_rows.where("copy is not null").groupBy("copy").agg(F.min("id").alias("rep")), "copies")
    reps = all_rows.select("id", "bands", "parts", "codes").join(copies.select(F.col("rep").alias("id")), "id", "left_semi")
    buckets = _buckets(ws, reps.select("id", F.explode("bands").alias("key")))
    # Parts of short texts: each member meets the one that lacks least.
    posted = reps.select("id", F.explode(F.arrays_zip("parts", "codes")).alias("part")).select("id", F.col("part.parts").alias("key"), F.col("part.codes").alias("code"))
    fewest = posted.groupBy("key").agg(F.min(F.struct("code", "id")).alias("top"), F.count("*").alias("n")).where("n > 1")
    short = ws.table(
        posted.join(fewest.select("key", "top"), "key").where("id <> top.id and floor(top.code / 8) <= code % 8")
        .select(F.greatest("id", "top.id").alias("a"), F.least("id", "top.id").alias("b")).distinct(), "short",
    )
    # Only texts that share a bucket are needed again; this shuffles texts, once.
    shares = buckets.select("id").union(short.select("a")).union(short.select("b")).distinct()
    needed = all_rows.select("id", "bands").join(shares, "id", "left_semi")
    labels = ws.table(_labelled(whole.join(needed, "id")), "labels")
    components, mixed = _joined(ws, buckets, labels, least, short)
    is_large = F.col("minor") > LARGE
    large = mixed.where(is_large)
    members = ws.table(_named(buckets, components).join(large.select("key"), "key").select("id", "component").distinct(), "members")
    if not members.isEmpty():
        more = _buckets(ws, _rare(labels, members, least))
        # The keys stand where the bands did: a pair counts in the smallest that it shares.
        keys = more.groupBy("id").agg(F.sort_array(F.collect_list("key")).alias("bands"))
        known = components.select(F.col("id").alias("a"), F.col("component").alias("b"))
        found, rest = _joined(ws, more, labels, least, known=known)
        named = _named(more, found).join(rest, "key")
        links = ws.table(_across(named, labels.select("id", "labels").join(keys, "id"), least), "links")
        components = connected_components(ws, found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links))
    named = _named(buckets, components).join(mixed.where(~is_large).select("key"), "key")
    named = named.join(_mixed(named), "key")
    links = ws.table(_across(named, labels, least), "links")
    components = connected_components(ws, components.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links))
    member = all_rows.select("id", "copy").join(copies, "copy", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    return member.join(components.withColumnRenamed("id", "rep"), "rep", "left").select(F.col("id").alias("row"), F.coalesce("component", "rep").alias("class"))


def _buckets(ws: Workspace, keys: DataFrame) -> DataFrame:
    """``(id, key, low)`` of keys that several ids share; low is the smallest of them."""
    shared = keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key", "low")
    return ws.table(keys.join(shared, "key").select("id", "key", "low"), "buckets")


def _named(buckets: DataFrame, components: DataFrame) -> DataFrame:
    return buckets.select("id", "key").join(components, "id", "left").select("id", "key", F.coalesce("component", "id").alias("component"))


def _mixed(named: DataFrame) -> DataFrame:
    """``(key, total, main, minor)`` of the buckets that hold several components."""
    parts = named.groupBy("key", "component").agg(F.count("*").alias("n"))
    return (
        parts.groupBy("key").agg(F.count("*").alias("k"), F.sum("n").alias("total"), F.max(F.struct("n", "component")).alias("top"))
        .where("k > 1").select("key", "total", F.col("top.component").alias("main"), (F.col("total") - F.col("top.n")).alias("minor"))
    )


def _joined(ws: Workspace, buckets: DataFrame, labels: DataFrame, least: float, short: DataFrame | None = None, known: DataFrame | None = None):
    """Components once the members of each bucket have met its smallest, and the buckets that then
    still hold several."""
    pairs = buckets.where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b"))
    pairs = (pairs if short is None else pairs.union(short)).distinct()
    if known is not None:  # members of one component need not meet again
        name = lambda c: known.select(F.col("a").alias(c), F.col("b").alias(f"of_{c}"))
        pairs = pairs.join(name("a"), "a", "left").join(name("b"), "b", "left").where("coalesce(of_a, a) <> coalesce(of_b, b)").select("a", "b")
    links = ws.table(_verified(pairs, labels, least), "links")
    components = connected_components(ws, links if known is None else known.union(links))
    return components, ws.table(_mixed(_named(buckets, components)), "mixed")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY,
    bands: int = BANDS, size: int = BAND_LABELS,
) -> DataFrame:
    """``(id_col, class_id, n_class, kept)``: one row per document.

    ``class_id`` is the smallest id of the component of linked texts, ``n_class`` its number
    of documents, ``kept`` marks the one document that stays.
    """
    ws = Workspace(docs.sparkSession, "near-dup")
    columns = [F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")]
    rows = ws.table(docs.select(F.monotonically_increasing_id().alias("row"), *columns), "rows")
    classes, sizes = _kept(ws, rows, _classes(ws, rows.select("row", "text"), least, bands, size))
    out = classes.join(sizes, "class").select(
        F.col("id").alias(id_col), F.col("first.id").alias("class_id"), "n_class", (F.col("row") == F.col("first.row")).alias("kept")
    )
    return ws.keep_only(out)


def _kept(ws: Workspace, rows: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(row, id, class)``, and ``(class, first, n_class)`` where first is the row that is kept."""
    known = ws.table(classes.join(rows.select("row", "id"), "row"), "classes")
    # A table of its own: a hot class can be split in the join with it.
    first = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "row"))
    return known, ws.table(known.groupBy("class").agg(first.alias("first"), F.count("*").alias("n_class")), "sizes")


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, bands: int = BANDS, size: int = BAND_LABELS,
) -> DataFrame:
    """``docs`` with one row of each class of near-duplicates, as :func:`near_duplicates` keeps it."""
    ws = Workspace(docs.sparkSession, "near-dup")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    columns = [F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")]
    rows = ws.table(docs.select(F.monotonically_increasing_id().alias("row"), columns[0], own), "rows")
    texts = rows.select("row", F.col("own")[text_col].cast("string").alias("text"))
    _, sizes = _kept(ws, rows, _classes(ws, texts, least, bands, size))
    kept = rows.join(sizes.select(F.col("first.row").alias("row")), "row", "left_semi")
    return ws.keep_only(kept.select(*[F.col("own")[c].alias(c) for c in docs.columns]))
