"""Document fingerprints by Order MinHash, in column expressions.

The words of a text form 5-grams; in scripts without spaces between words every character is
a word (see ``scripts``).  A 5-gram is labelled with its occurrence number, so that all labels
of a text differ.  Labels fall into 64 slots by hash.  In each slot the two labels
of smallest hash are kept, put in text order and hashed as a tuple.  A signature has a value
for each slot that a label fell into; two texts agree in a slot only if they share its
minimal labels in the same order, which makes the signature sensitive to edit distance, not
only to the set of 5-grams.  Likeness is the share of slots that agree among those in use.

A fingerprint is the signature in hexadecimal, 8 digits a slot: equal texts have equal ones.

Defined results: a null text is empty; an empty text has one label, of the empty word, so
empty texts are alike; a text of under five words is one label.  Positions count modulo
2 ** 24, beyond which only the order inside a tuple is affected.  Repeated rows each keep
their row; rows of one id stand in an order of hashes of their texts, and rows without id
come last.  An empty table gives no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import json
import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scripts import UNSPACED_JAVA

GAP = r"[\x20\x09-\x0D]+"
WORDS = 5
SLOT_BITS = 6
POSITION = (1 << 24) - 1
#: Rows of one range of ids, about, ranges at most (larger ones beyond that) and rows of a
#: range that are sampled for its cut, about; see :func:`with_next`.
RANGE_ROWS = 64
RANGES = 1 << 17
RANGE_SAMPLE = 16


def _same(a: Column, i: Column, x: Column) -> Column:
    """Does element ``i`` of the sorted ``a`` hold the same hash as ``x``?  Not before the start."""
    return F.coalesce(F.shiftright(F.get(a, i), 24) == F.shiftright(x, 24), F.lit(False))


def _slot(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - SLOT_BITS)


def with_signature(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """``df`` with ``out_col``, an array of longs.  Steps are columns of their own, so that
    each array is made once and lambdas refer to it."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    unspaced = (F.octet_length(text) > F.length(text)) & text.rlike(UNSPACED_JAVA)
    apart = F.when(unspaced, F.regexp_replace(text, f"({UNSPACED_JAVA})", " $1 ")).otherwise(text)
    df = df.withColumn("__w", F.transform(F.split(apart, GAP, -1), lambda w: F.xxhash64(w)))
    gram = lambda x, i: F.xxhash64(x, *[F.get(F.col("__w"), i + k) for k in range(1, WORDS)])
    keep = F.lit(~POSITION).cast("long")
    packed = lambda h, i: h.bitwiseAND(keep).bitwiseOR(i.cast("long").bitwiseAND(F.lit(POSITION)))
    df = df.withColumn(
        "__g", F.sort_array(F.transform(
            F.slice("__w", 1, F.greatest(F.size("__w") - (WORDS - 1), F.lit(1))), lambda x, i: packed(gram(x, i), i)
        ))
    )
    g = F.col("__g")
    powers = F.from_json(F.lit(json.dumps([1 << k for k in range(23, -1, -1)])), "array<int>")

    def occurrence(x: Column, i: Column) -> Column:
        """Equal hashes before element ``i``: they stand in one run, so doubling finds its start."""
        run = F.aggregate(powers, F.lit(0), lambda t, p: F.when(_same(g, i - t - p, x), t + p).otherwise(t))
        return F.when(~_same(g, i - 2, x), F.lit(1)).when(~_same(g, i - 3, x), F.lit(2)).otherwise(run)

    def label(x: Column, i: Column) -> Column:
        again = F.xxhash64(F.shiftright(x, 24), occurrence(x, i))
        return F.when(_same(g, i - 1, x), packed(again, x.bitwiseAND(F.lit(POSITION)))).otherwise(x)

    df = df.withColumn("__l", F.sort_array(F.transform(g, label)))
    all_labels = F.col("__l")
    df = df.withColumn(
        "__k", F.filter(all_labels, lambda x, i: F.coalesce(_slot(F.get(all_labels, i - 2)) != _slot(x), F.lit(True)))
    )
    least = F.col("__k")

    def value(x: Column, i: Column) -> Column:
        after = F.get(least, i + 1)
        place = lambda y: y.bitwiseAND(F.lit(POSITION))
        top = lambda y: F.shiftright(y, 24)
        pair = F.when(place(x) <= place(after), F.xxhash64(top(x), top(after))).otherwise(F.xxhash64(top(after), top(x)))
        tuple_hash = F.when(F.coalesce(_slot(after) == _slot(x), F.lit(False)), pair).otherwise(F.xxhash64(top(x)))
        new = F.coalesce(_slot(F.get(least, i - 1)) != _slot(x), F.lit(True))
        return F.when(new, F.shiftleft(_slot(x), 24).bitwiseOR(tuple_hash.bitwiseAND(F.lit(POSITION))))

    df = df.withColumn(out_col, F.filter(F.transform(least, value), lambda v: v.isNotNull()))
    return df.drop("__w", "__g", "__l", "__k")


def spell(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda v: F.lower(F.lpad(F.hex(v), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the slots in use by either signature in which both agree."""
    slots = lambda s: F.transform(s, lambda v: F.shiftright(v, 24))
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(slots(a), slots(b)))


def with_next(df: DataFrame, id_col: str, columns: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with ``next_*``: ``columns`` of the row of the next lower id (the highest, after
    the lowest).  Null ids come last; rows of one id are ordered by a hash of ``columns[0]``.

    Ids are cut into ranges by quantiles of a sample; the first row of a range is sent to the
    range above as well, so one shuffle by range and one window inside ranges do it.  An id
    (or null) that fills several ranges is cut further by the hash.
    """
    key = F.col(id_col)
    rows = df.select(key.alias("i"))
    count, nulls = rows.agg(F.count("*"), F.count_if(F.col("i").isNull())).first()
    ranges = max(1, min(RANGES, count // range_rows))
    cuts: list[int] = []
    if ranges > 1 and count > nulls:
        share = min(1.0, ranges * RANGE_SAMPLE / count)
        sample = rows if share == 1 else rows.sample(share, 7)
        cuts = sample.agg(F.percentile_approx("i", [k / ranges for k in range(1, ranges)], 10 * ranges)).first()[0] or []
    times = Counter(cuts)
    heavy = {i: n for i, n in times.items() if n > 1}
    cuts = sorted({*times, *(i + 1 for i in heavy)})
    # Of range 0 (null ids), 1 (below the first cut) and so on: the parts that it is cut into.
    parts = [max(1, nulls * ranges // max(count, 1)), 1, *(heavy.get(i, 1) for i in cuts)]
    constant = lambda values, kind: F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")
    powers = constant([1 << k for k in reversed(range(max(1, math.ceil(math.log2(len(cuts) + 1)))))], "int")
    # Without a heavy id the texts are not read here.
    mark = F.xxhash64(columns[0]) if max(parts) > 1 else F.lit(0).cast("long")
    by_cut = F.aggregate(powers, F.lit(1), lambda low, step: F.when(F.get(constant(cuts, "bigint"), low + step - 2) <= key, low + step).otherwise(low))
    placed = df.withColumn("__cut", F.when(key.isNull(), F.lit(0)).otherwise(by_cut)).withColumn("__parts", F.get(constant(parts, "int"), F.col("__cut")))
    placed = placed.withColumn("__heavy", F.when(F.col("__parts") > 1, mark).otherwise(F.lit(0).cast("long")))
    part = F.least(F.floor((F.col("__heavy") / F.lit(2.0**64) + 0.5) * F.col("__parts")), F.col("__parts") - 1)
    placed = placed.withColumn("__range", F.col("__cut") * F.lit(1 << 20).cast("long") + F.when(F.col("__parts") > 1, part).otherwise(F.lit(0)))
    # One row a range: about twice RANGES at most.
    heads = placed.groupBy("__range").agg(F.max(F.struct(F.coalesce(key, F.lit(0)).alias("i"), F.col("__heavy").alias("m"))).alias("__head"))
    lowest = heads.agg(F.min("__range")).first()[0] or 0
    above = F.coalesce(F.lag("__range").over(Window.orderBy(F.desc("__range"))), F.lit(lowest))
    heads = heads.withColumn("__above", above).select(F.col("__range").alias("__r"), F.col("__head.i").alias("__i"), F.col("__head.m").alias("__m"), "__above")
    first = (F.col("__range") == F.col("__r")) & (F.coalesce(key, F.lit(0)) == F.col("__i")) & (F.col("__heavy") == F.col("__m"))
    joined = placed.join(F.broadcast(heads), first, "left")
    own, ghost = F.struct(F.col("__range").alias("r"), F.lit(0).alias("g")), F.struct(F.col("__above").alias("r"), F.lit(1).alias("g"))
    sent = joined.withColumn("__at", F.explode(F.when(F.col("__r").isNotNull(), F.array(own, ghost)).otherwise(F.array(own))))
    sent = sent.withColumn("__range", F.col("__at.r")).withColumn("__ghost", F.col("__at.g")).withColumn("__mark", F.xxhash64(columns[0]))
    inside = Window.partitionBy("__range").orderBy("__ghost", F.desc_nulls_last(id_col), F.desc("__mark"))
    for c in columns:
        sent = sent.withColumn(f"next_{c}", F.lead(c).over(inside))
    made = [c for c in sent.columns if c.startswith("__")]
    return sent.where("__ghost = 0").drop(*made)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, text, n_chars, signature)`` of whole texts.  No shuffle."""
    df = docs.select(F.col(id_col), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return with_signature(df.withColumn("n_chars", F.length("text").cast("long")), "text", "signature")


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of the texts, of their edited texts (the last half replaced by the start
    of the next document), and likenesses to the edited and to the next text."""
    both = with_next(fingerprints(docs, id_col, text_col), id_col, ["text", "signature"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))
    done = with_signature(both.withColumn("edited", edited), "edited", "edited_signature")
    return done.select(
        id_col, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), spell(F.col("signature")).alias("fingerprint"),
        spell(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )
