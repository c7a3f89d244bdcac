import random
import re
from itertools import accumulate

import pytest
import xxhash
from pyspark.sql import functions as F

from cartograph.llm.mixing import SHARD_SLOTS, mix_blocks, mix_counts, mix_documents, share_out, shuffled

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_share_out():
    assert share_out([], []) == []
    assert share_out([10, 10, 10], [1, 2, 3]) == pytest.approx([5, 10, 15])
    assert share_out([2, 100, 10], [3, 1, 2]) == pytest.approx([6, 76, 30])
    random.seed(1)
    for _ in range(200):
        sizes = [random.choice([0, 1, 5, 100, 1000]) for _ in range(6)]
        targets = share_out(sizes, [random.randint(1, 3) for _ in sizes])
        assert sum(targets) == pytest.approx(sum(sizes)) and all(t <= 3 * s + 1e-6 for t, s in zip(targets, sizes))


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_shuffle_is_a_permutation(spark, n):
    rows = spark.range(n).select(shuffled(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long")).alias("x"), "id").collect()
    assert sorted(r["x"] for r in rows) == list(range(n))
    assert n < 64 or sum(r["x"] == r["id"] for r in rows) < n / 8


def test_counts(spark, docs, texts):
    rows = mix_counts(docs).collect()
    sizes = {k: len(WORD.findall(t or "")) for k, t in texts.items()}
    assert {r["doc_id"]: r["size"] for r in rows} == sizes
    by: dict = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
        assert r["taken"] <= 3 * r["size"]
    names = sorted(by)
    totals = [sum(r["size"] for r in by[s]) for s in names]
    targets = share_out(totals, [1 + k % 3 for k in range(len(names))])
    for name, total, target in zip(names, totals, targets):
        assert {r["source_size"] for r in by[name]} == {total} and by[name][0]["target"] == pytest.approx(target)
        assert sum(r["taken"] for r in by[name]) == round(target)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mix_counts(docs.repartition(7)).collect()))


def _hash(*values, seed=42):
    """Spark's xxhash64 of longs, ints and strings; a null leaves the hash as it is."""
    for kind, x in values:
        if x is not None:
            raw = x.encode() if kind == "s" else (x & (1 << 8 * kind) - 1).to_bytes(kind, "little")
            seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def _image(x, n, seed):
    for k in range(1, 21):
        partner = (_hash((8, seed), (4, k)) % n - x) % n
        if _hash((8, max(x, partner)), (8, seed), (4, k)) & 1:
            x = partner
    return x


def brute(rows, block, seed=17):
    """Words taken of each of ``rows(id, text, source)``, by one loop over all slots."""
    docs = [(i, t, s, WORD.findall(t or "")) for i, t, s in rows]
    names = sorted({s for _, _, s, _ in docs}, key=lambda s: (s is None, s or ""))
    of = {s: [d for d in docs if d[2] == s] for s in names}
    size = [sum(len(d[3]) for d in of[s]) for s in names]
    target = [round(t) for t in share_out(size, [1 + k % 3 for k in range(len(names))])]
    streams = []
    for s in names:
        mark = lambda d: _hash((8, d[0]), ("s", d[1]))
        chunks = -(-len(of[s]) // 2048)
        order = sorted(of[s], key=lambda d: (mark(d) % chunks, mark(d), d[0] is not None, d[0] or 0, len(d[3])))
        streams.append([d[:3] for d in order for _ in d[3]])
    quota = [(t // n) * -(-n // block) + -(-(t % n) // block) if n else 0 for t, n in zip(target, size)]
    ends, slots = list(accumulate(quota)), sum(quota)
    starts = [0, *ends[:-1]]
    drawn = []
    for slot in range(slots):
        shard, i = divmod(slot, SHARD_SLOTS)
        image = _hash((8, seed), (8, shard), (4, i)) % slots
        drawn.append(max(k for k in range(len(names)) if starts[k] <= image))
    have = [drawn.count(k) for k in range(len(names))]
    spare = [k for k in range(len(names)) for _ in range(max(0, have[k] - quota[k]))]
    lacking = iter([k for k in range(len(names)) for _ in range(max(0, quota[k] - have[k]))])
    assert len(spare) == sum(max(0, q - h) for q, h in zip(quota, have))
    draws = [k for k in range(len(names)) for _ in range(quota[k])]
    assert sorted(draws) == sorted([k for k in range(len(names)) for _ in range(min(have[k], quota[k]))] + list(lacking))
    taken: dict = {}
    for k in range(len(names)):
        n, full = size[k], size[k] // block
        left = target[k]
        for draw in range(quota[k]):
            turn, place = divmod(draw, -(-n // block))
            at = _image(place, full, _hash((8, seed), (4, k), (8, turn))) if place < full else full
            words = streams[k][at * block : (at + 1) * block][:left]
            left -= len(words)
            for d in words:
                taken[d] = taken.get(d, 0) + 1
        assert left == 0
    return taken


@pytest.mark.parametrize("block", [128, 5])
def test_brute_force(spark, docs, texts, block):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    want = brute(rows, block)
    got = {r["doc_id"]: r["taken"] for r in mix_counts(docs, block_words=block).collect()}
    assert got == {k: want.get((k, t, s), 0) for k, t, s in rows}


def _repeated(spark, times):
    words = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    rows = [(1, words(1, 45), "a", "x")] * times + [(2, words(2, 300), "a", "x"), (3, words(3, 90), "b", "y"), (None, None, "b", "y")]
    rows += [(None, words(5, 7), None, "z")] * times + [(6, words(6, 33), "c", "x"), (6, words(6, 33), "c", "other")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")


@pytest.mark.parametrize("times", [2, 1000])
def test_repeated_rows(spark, times):
    """Counts, documents and blocks agree, copies included."""
    rows, df = _repeated(spark, times)
    counts = mix_counts(df).collect()
    assert len(counts) == len(rows)
    want = brute([r[:3] for r in rows], 128)
    got: dict = {}
    for r in counts:
        text = {1: rows[0][1], 6: rows[-1][1]}.get(r["doc_id"], next((t for i, t, s, _ in rows if i == r["doc_id"] and s == r["source"]), None))
        got[r["doc_id"], text, r["source"]] = got.get((r["doc_id"], text, r["source"]), 0) + r["taken"]
        assert r["taken"] <= 3 * r["size"]
    assert {k: v for k, v in got.items() if v} == want
    mixed, blocks = mix_documents(df).collect(), mix_blocks(df).collect()
    by = lambda found, words: {s: sum(words(r) for r in found if r["source"] == s) for s in ("a", "b", "c", None)}
    total = by(counts, lambda r: r["taken"])
    assert by(mixed, lambda r: len(r["text"].split())) == total == by(blocks, lambda r: r["n_words"])
    assert sorted(w for r in mixed for w in r["text"].split()) == sorted(w for r in blocks for w in r["text"].split())
    assert sorted((r["shard"], r["slot"]) for r in blocks) == [divmod(k, SHARD_SLOTS) for k in range(len(blocks))]
    assert sorted(map(str, mixed)) == sorted(map(str, mix_documents(df.repartition(5)).collect()))


def test_blocks_and_shards(spark, docs, texts):
    """A full pass of a source gives its stream of words back; shards mix the sources."""
    blocks = mix_blocks(docs, block_words=8).collect()
    counts = mix_counts(docs, block_words=8)
    assert sum(r["n_words"] for r in blocks) == counts.agg(F.sum("taken")).first()[0]
    assert all(r["n_words"] == len(r["text"].split(" ")) <= 8 for r in blocks)
    first = {}
    for r in blocks:
        first.setdefault(r["shard"], []).append(r["source"])
    share = {s: sum(r["source"] == s for r in blocks) / len(blocks) for s in {r["source"] for r in blocks}}
    for shard, drawn in list(first.items())[:-2]:  # draws beyond a quota change hands in the last ones
        assert len(drawn) == SHARD_SLOTS
        for s, p in share.items():
            assert abs(drawn.count(s) - len(drawn) * p) < 6 * (len(drawn) * p) ** 0.5 + 6


def test_very_long_text(spark):
    """Ten million characters beside short texts, cut in linear time."""
    df = spark.range(3).selectExpr("id AS doc_id", "if(id = 0, repeat('word and ', 1100000), 'a few words') AS text", "concat('s', id) AS source")
    got = {r["doc_id"]: r["n"] for r in mix_documents(df, {"s0": 1.0, "s1": 2.0}).groupBy("doc_id").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    assert got[1] == 9 and abs(got[0] - 2_200_006 + 9) <= 1


def test_documents_agree_with_counts(spark, docs):
    taken = {r["doc_id"]: r["taken"] for r in mix_counts(docs).collect()}
    mixed = mix_documents(docs).collect()
    words: dict = {}
    for r in mixed:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(WORD.findall(r["text"]))
    assert words == {k: v for k, v in taken.items() if v}


def test_odd_rows(odd, none):
    rows = mix_counts(odd.union(odd)).collect()
    assert len(rows) == 20 and {r["size"] for r in rows if r["doc_id"] in (0, 1, 2)} == {0}
    assert [r["target"] for r in rows if r["source"] is None][0] > 0
    assert mix_counts(none).count() == mix_documents(none).count() == 0
    assert mix_counts(odd.where("doc_id < 3")).agg(F.sum("taken")).first()[0] == 0
    out = mix_documents(odd, block_words=2)
    assert out.columns == odd.columns and {r["taken"] for r in out.collect()} <= set(range(10))
    only = mix_counts(odd, {"s1": 1.0})
    assert {r["source"]: r["target"] for r in only.collect() if r["source"] != "s1"} == {"s0": 0, "s2": 0, None: 0}
    assert only.agg(F.sum("taken")).first()[0] == only.where("source = 's1'").agg(F.sum("size") * 3).first()[0]
