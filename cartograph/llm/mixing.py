"""Mixing sources to target weights.

Every source's texts are laid end to end, and the stream of its words is packed into blocks
of fixed length (the last one shorter).  The mix is a row of slots, cut into output shards.
The slots of a shard draw their sources by the sources' shares, so that the counts of
sources in a shard are multinomial.  Draws beyond a source's quota, which stand in the last
shards, are handed to the sources that fell short, so that all quotas are met.  The draws of
a source are numbered by shard and slot; each pass over a source maps the numbers through a
pseudorandom permutation of its block indices of its own, and draws and blocks are joined by
index.  The shorter block ends a pass, and the last draw of a source takes only the words
that its target still lacks: a source's words equal its rounded target.

The permutations are swap-or-not shuffles: exact on any range, and a row computes its image
alone, so nothing is sorted and reruns agree.

Word offsets and draw numbers come from levels of sums, so no task holds a whole source:
documents are dealt to chunks by a hash, the sums of chunks give every chunk's first word,
and a window inside the chunk gives the rest.  Repeated rows are one row with a count until
their words are laid out.  All of it is DataFrame operations.

Defined results: a null text has no words; a null source is a source of its own, the last in
order; a document without words takes none and is kept with 0.  Repeated rows are rows of
their own: the mix may take different words of each.  Without any word nothing is taken; an
empty table gives no rows.  Very long texts are cut in time linear in their length.  Columns
that the caller names do not clash with those made here.  The list of sources, one row each,
comes to the driver; more than ``MOST_SOURCES`` raise an error.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
BLOCK_WORDS = 128
SHARD_SLOTS = 8192
SLOTS_A_TASK = 200_000
#: Documents of one chunk of a source, about.
CHUNK_DOCS = 2048
#: Sums that one window adds up, and copies of a row that one row stands for.
AT_ONCE = 1024
#: A target is at most this many times the size of its source.
MOST = 3
MOST_SOURCES = 100_000
ROUNDS = 20


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def share_out(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Targets by weight, at most ``most`` times the size, the excess shared again by weight."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    free, rest = list(range(len(sizes))), total
    while free:
        scale = sum(weights[k] for k in free)
        if not scale:  # sources without weight take nothing, even if others are full
            break
        over = {k for k in free if rest * weights[k] / scale > most * sizes[k]}
        for k in free:
            out[k] = float(most * sizes[k]) if k in over else rest * weights[k] / scale
        if not over:
            break
        rest -= sum(out[k] for k in over)
        free = [k for k in free if k not in over]
    return out


def shuffled(index: Column, size: Column, seed: Column) -> Column:
    """Image of ``index`` in a pseudorandom permutation of 0 .. size - 1 (swap-or-not)."""

    def turn(x: Column, k: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(seed, k), size) - x, size)
        return F.when(F.xxhash64(F.greatest(x, partner), seed, k).bitwiseAND(F.lit(1)) == 1, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, turn)


def _interval(value: Column, starts: list[int]) -> Column:
    """Number of the last of the ascending ``starts`` that is not above ``value``."""
    fixed = F.from_json(F.lit(json.dumps(starts)), "array<bigint>")
    steps = max(1, math.ceil(math.log2(len(starts) + 1)))
    powers = F.from_json(F.lit(json.dumps([1 << k for k in reversed(range(steps))])), "array<int>")
    return F.aggregate(
        powers, F.lit(0), lambda low, step: F.when(F.get(fixed, low + step) <= value, low + step).otherwise(low)
    )


def _local(spark, rows: list[dict], schema: str) -> DataFrame:
    """A small table that is part of the plan."""
    text = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1).select(F.inline(text))


def _before(sums: DataFrame, order: str, value: str) -> DataFrame:
    """``(s, order, first)``: the sum of ``value`` over all lower ``order`` of the source."""
    wide = sums.withColumn("part", F.floor(F.col(order) / AT_ONCE))
    rows = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside, across = Window.partitionBy("s", "part").orderBy(order), Window.partitionBy("s").orderBy("part")
    parts = wide.groupBy("s", "part").agg(F.sum(value).alias("v"))
    parts = parts.select("s", "part", F.coalesce(F.sum("v").over(rows(across)), F.lit(0)).alias("before"))
    own = wide.withColumn("own", F.coalesce(F.sum(value).over(rows(inside)), F.lit(0)))
    return own.join(parts, ["s", "part"]).select("s", order, (F.col("own") + F.col("before")).alias("first"))


def _sources(base: DataFrame, weights: dict | None, block: int) -> list[dict]:
    """A row a source: its size, target and draws, by code point and null last."""
    found = base.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    if weights is None:
        shares = [1.0 + k % 3 for k in range(len(found))]
    else:
        shares = [float(weights.get(r["source"], 0.0)) for r in found]
        if not sum(shares):
            shares = [1.0] * len(found)
    rows = []
    for k, (r, target) in enumerate(zip(found, share_out([r["size"] for r in found], shares))):
        size, words = r["size"], round(target)
        blocks, passes = -(-size // block), words // size if size else 0
        rest = words - passes * size if size else 0
        last = -(-rest // block)
        rows.append({
            "name": r["source"], "s": k, "source_size": size, "target": target, "chunks": -(-r["n"] // CHUNK_DOCS), "full": size // block,
            "blocks": blocks, "passes": passes, "last": last, "tail": rest - (last - 1) * block if last else 0, "quota": passes * blocks + last,
        })
    return rows


_SOURCE = (
    "name:string,s:int,source_size:bigint,target:double,chunks:bigint,full:bigint,blocks:bigint,passes:bigint,last:bigint,tail:bigint,quota:bigint"
)


def _positions(base: DataFrame, sources: DataFrame, ws: Workspace, others: list[str]) -> DataFrame:
    """``base`` with equal rows as one, their number ``n`` and first word ``begin`` in the source."""
    least = [F.min("row").alias("row")] if "row" in base.columns else []
    equal = base.groupBy("source", "id", "size", "mark", *others).agg(F.count("*").alias("n"), *least)
    # MOST_SOURCES rows at most.
    dealt = equal.join(F.broadcast(sources), equal["source"].eqNullSafe(sources["name"])).select(
        equal["*"], "s", "source_size", "target", F.pmod("mark", "chunks").alias("chunk"), (F.col("size") * F.col("n")).alias("words")
    )
    dealt = ws.table(dealt, "dealt")
    sums = dealt.groupBy("s", "chunk").agg(F.sum("words").alias("words"))
    inside = Window.partitionBy("s", "chunk").orderBy("mark", "id", "size", *others).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("own", F.coalesce(F.sum("words").over(inside), F.lit(0)))
    return own.join(_before(sums, "chunk", "words"), ["s", "chunk"]).withColumn("begin", F.col("first") + F.col("own")).drop("chunk", "words", "first", "own")


def _starts(sizes: list[int]) -> list[int]:
    out, at = [], 0
    for size in sizes:
        out.append(at)
        at += size
    return out


def _draws(spark, rows: list[dict], ws: Workspace, block: int, seed: int) -> DataFrame:
    """``(shard, slot, s, turn, block, words)``: a row a slot, with the ``words`` to take of the block."""
    slots = sum(r["quota"] for r in rows)
    starts = _starts([r["quota"] for r in rows])
    shards = -(-slots // SHARD_SLOTS)
    tasks = max(spark.sparkContext.defaultParallelism, slots // SLOTS_A_TASK)

    def drawn(shard: Column) -> Column:
        """What the slots of a shard draw, by source: ``source * SHARD_SLOTS + slot``."""
        last = F.least(F.lit(SHARD_SLOTS), F.lit(slots) - shard * SHARD_SLOTS).cast("int") - 1
        image = lambda i: F.pmod(F.xxhash64(F.lit(seed).cast("long"), shard, i), F.lit(max(slots, 1)).cast("long"))
        return F.sort_array(F.transform(F.sequence(F.lit(0), last), lambda i: _interval(image(i), starts or [0]).cast("long") * SHARD_SLOTS + i))

    source = lambda d: F.floor(d / SHARD_SLOTS).cast("int")

    first = spark.range(0, shards, 1, max(1, min(tasks, shards))).select(F.col("id").alias("shard"))
    counts = ws.table(
        first.select("shard", F.explode(drawn(F.col("shard"))).alias("d")).groupBy("shard", source(F.col("d")).alias("s")).agg(F.count("*").alias("n")), "counts"
    )
    total = {r["s"]: r["n"] for r in counts.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    total = [total.get(k, 0) for k in range(len(rows))]
    over, under = [max(0, t - r["quota"]) for t, r in zip(total, rows)], [max(0, r["quota"] - t) for t, r in zip(total, rows)]
    over_at, under_at = _starts(over), _starts(under)
    lacking = [k for k in range(len(rows)) if under[k]]  # each takes over a run of draws beyond a quota
    fixed = F.broadcast(_local(
        spark, [{k: r[k] for k in ("s", "full", "blocks", "passes", "last", "tail")} for r in rows],
        "s:int,full:bigint,blocks:bigint,passes:bigint,last:bigint,tail:bigint",
    ))
    takers = F.broadcast(_local(
        spark, [{"taker": k, "s2": s, "base": total[s] - under_at[s]} for k, s in enumerate(lacking)], "taker:int,s2:int,base:bigint"
    ))
    quotas = F.broadcast(_local(
        spark, [{"s": k, "quota": r["quota"], "over_at": at} for k, (r, at) in enumerate(zip(rows, over_at))], "s:int,quota:bigint,over_at:bigint"
    ))
    # The place of a draw among all of its source: those of lower shards, then its place in the shard.
    in_shard = Window.partitionBy("shard").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        counts.join(_before(counts.withColumnRenamed("shard", "o"), "o", "n").withColumnRenamed("o", "shard"), ["s", "shard"])
        .withColumn("offset", F.col("first") - F.coalesce(F.sum("n").over(in_shard), F.lit(0)))
        .groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("s", "offset"))).alias("offsets"))  # SHARD_SLOTS entries at most
    )
    numbered = (
        offsets.repartition(max(1, min(tasks, shards)), "shard").select("shard", "offsets", F.posexplode(drawn(F.col("shard"))).alias("at", "d"))
        .select("shard", F.pmod("d", F.lit(SHARD_SLOTS)).cast("int").alias("slot"), source(F.col("d")).alias("s"), (F.col("at") + F.col("offsets")[source(F.col("d"))]).alias("draw"))
        .join(quotas, "s")
    )
    rank = F.when(F.col("draw") >= F.col("quota"), F.col("over_at") + F.col("draw") - F.col("quota"))
    handed = numbered.withColumn("rank", rank).withColumn("taker", F.when(F.col("rank").isNotNull(), _interval(F.col("rank"), [under_at[s] for s in lacking] or [0])))
    settled = handed.join(takers, "taker", "left").select(
        "shard", "slot", F.coalesce("s2", "s").alias("s"), F.when(F.col("rank").isNull(), F.col("draw")).otherwise(F.col("base") + F.col("rank")).alias("draw")
    ).join(fixed, "s")
    turn, place = F.floor(F.col("draw") / F.col("blocks")).cast("long"), F.pmod("draw", "blocks")
    chosen = F.when(place < F.col("full"), shuffled(place, F.col("full"), F.xxhash64(F.lit(seed).cast("long"), "s", turn))).otherwise(F.col("full"))
    last = F.col("draw") == F.col("passes") * F.col("blocks") + F.col("last") - 1
    return settled.select(
        "shard", "slot", "s", turn.alias("turn"), chosen.cast("long").alias("block"),
        F.when(last & (F.col("last") > 0), F.col("tail")).otherwise(F.lit(block)).cast("long").alias("words"),
    )


def _copies(positions: DataFrame, ws: Workspace) -> DataFrame:
    """``positions`` with a row for each of its equal rows, numbered ``copy``."""
    positions = ws.table(positions, "positions")
    one = positions.where("n = 1").withColumn("copy", F.lit(0).cast("long"))
    runs = positions.where("n > 1").withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / AT_ONCE))))
    copies = F.sequence(F.col("run") * AT_ONCE, F.least(F.col("run") * AT_ONCE + AT_ONCE, F.col("n")) - 1)
    more = runs.repartition("s", "mark", "run").withColumn("copy", F.explode(copies)).drop("run")
    return one.unionByName(more.withColumn("begin", F.col("begin") + F.col("copy") * F.col("size")))


def _segments(positions: DataFrame, block: int) -> DataFrame:
    """The parts of documents in blocks: words low to high (exclusive) of the block."""
    size, begin = F.col("size"), F.col("begin")
    first, last = F.floor(begin / block), F.floor((begin + size - 1) / block)
    return positions.withColumn(
        "block", F.explode_outer(F.when(size > 0, F.sequence(first.cast("long"), last.cast("long"))))
    ).withColumn("low", F.greatest(begin - F.col("block") * block, F.lit(0))).withColumn(
        "high", F.least(begin + size - F.col("block") * block, F.lit(block))
    )


def _words(text: Column) -> Column:
    return F.filter(F.split(text, GAP, -1), lambda w: w != "")


def _own_rows(docs: DataFrame, ws: Workspace, id_col: str, text_col: str, source_col: str, whole: bool) -> tuple[DataFrame, list[str]]:
    """``(source, id, size, mark[, row, other, own])`` of ``docs``; with ``whole`` a row has a
    number and all its columns in ``own``."""
    text = F.col(f"`{text_col}`").cast("string")
    columns = [
        F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{id_col}`").alias("id"), count_words(text).alias("size"),
        F.xxhash64(F.col(f"`{id_col}`"), text).alias("mark"),
    ]
    if not whole:
        return ws.table(docs.select(*columns), "words"), []
    other = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])
    columns += [other.alias("other"), F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")]
    return ws.table(docs.select(*columns), "rows"), ["other"]


def mix_counts(
    docs: DataFrame, weights: dict | None = None, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", block_words: int = BLOCK_WORDS, seed: int = 17,
) -> DataFrame:
    """``(id_col, source, size, source_size, target, taken)``: a row a document.

    ``weights`` maps sources to weights (others weigh 0); without them the sources, by code
    point and null last, weigh 1, 2, 3, repeating.  ``taken`` counts the words that the mix
    takes of a document, repeats included.
    """
    spark, ws = docs.sparkSession, Workspace(docs.sparkSession, "mix")
    base, others = _own_rows(docs, ws, id_col, text_col, source_col, False)
    rows = _sources(base, weights, block_words)
    positions = _copies(_positions(base, _local(spark, rows, _SOURCE), ws, others), ws)
    takes = _draws(spark, rows, ws, block_words, seed).groupBy("s", "block").agg(
        F.count_if(F.col("words") == block_words).alias("whole"),
        F.max(F.when(F.col("words") < block_words, F.col("words"))).alias("part"),
    )
    taken = F.coalesce(F.col("whole") * (F.col("high") - F.col("low")), F.lit(0)) + F.when(
        F.col("part").isNotNull(), F.greatest(F.least("high", "part") - F.col("low"), F.lit(0))
    ).otherwise(F.lit(0))
    out = (
        _segments(positions, block_words).join(takes, ["s", "block"], "left").withColumn("taken", taken)
        .groupBy("begin", "copy", "mark", "id", "source", "size", "source_size", "target")
        .agg(F.sum("taken").alias("taken"))
        .select(F.col("id").alias(id_col), "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))
    )
    return ws.keep_only(out)


def mix_documents(
    docs: DataFrame, weights: dict | None = None, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", block_words: int = BLOCK_WORDS, seed: int = 17,
) -> DataFrame:
    """The mix by documents: ``docs`` with the texts that it takes.

    A document has a row for each pass that takes words of it, at most three.  Where a pass
    takes all its words the text stays as it is, else it is the taken words, joined by
    single spaces.  Other columns are as in ``docs``.
    """
    spark, ws = docs.sparkSession, Workspace(docs.sparkSession, "mix")
    base, others = _own_rows(docs, ws, id_col, text_col, source_col, True)
    rows = _sources(base, weights, block_words)
    positions = _copies(_positions(base.drop("own"), _local(spark, rows, _SOURCE), ws, others), ws).where("size > 0")
    takes = (
        _segments(positions, block_words).join(_draws(spark, rows, ws, block_words, seed), ["s", "block"])
        .withColumn("upto", F.least("high", "words")).where("upto > low")
        .withColumn("at", F.col("block") * block_words + F.col("low") - F.col("begin"))
        .groupBy("row", "copy", "turn")
        .agg(
            F.sum(F.col("upto") - F.col("low")).alias("taken"),
            F.array_sort(F.collect_list(F.struct(F.col("at").cast("int").alias("at"), (F.col("upto") - F.col("low")).cast("int").alias("n")))).alias("ranges"),
        )
    )
    joined = base.select("row", "own", "size").join(takes, "row").withColumn(
        "cut", F.when(F.col("taken") < F.col("size"), _words(F.col("own")[text_col].cast("string")))
    )
    # Asked for twice, the words are a column of their own and not split again for each range.
    some = F.array_join(F.flatten(F.transform("ranges", lambda r: F.slice("cut", r["at"] + 1, r["n"]))), " ")
    text = F.when(F.col("cut").isNull(), F.col("own")[text_col]).otherwise(some)
    return joined.select(*[text.alias(c) if c == text_col else F.col("own")[c].alias(c) for c in docs.columns])


def mix_blocks(
    docs: DataFrame, weights: dict | None = None, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", block_words: int = BLOCK_WORDS, seed: int = 17,
) -> DataFrame:
    """The mix by blocks: ``(shard, slot, source, turn, block, n_words, text)``.

    A row is a slot of an output shard with the packed block that it draws, its words joined
    by single spaces; ``turn`` counts the passes over the source.
    """
    spark, ws = docs.sparkSession, Workspace(docs.sparkSession, "mix")
    base, others = _own_rows(docs, ws, id_col, text_col, source_col, True)
    rows = _sources(base, weights, block_words)
    positions = _copies(_positions(base.drop("own"), _local(spark, rows, _SOURCE), ws, others), ws).where("size > 0")
    laid = positions.select("row", "s", "source", "begin", "size").join(
        base.select("row", _words(F.col("own")[text_col].cast("string")).alias("all_words")), "row"
    )
    parts = _segments(laid, block_words).select(
        "s", "source", "block", "low",
        F.slice("all_words", (F.col("block") * block_words + F.col("low") - F.col("begin") + 1).cast("int"), (F.col("high") - F.col("low")).cast("int")).alias("w"),
    )
    packed = parts.groupBy("s", "block").agg(  # block_words parts at most
        F.first("source").alias("source"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("low", "w"))), lambda p: p["w"])).alias("w")
    )
    taken = _draws(spark, rows, ws, block_words, seed).join(packed, ["s", "block"]).withColumn("w", F.slice("w", 1, F.col("words").cast("int")))
    return taken.select("shard", "slot", "source", "turn", "block", F.size("w").alias("n_words"), F.array_join("w", " ").alias("text"))
