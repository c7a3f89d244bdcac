import random

import numpy as np
from pyspark.sql import functions as F

from cartograph.llm.common import Workspace, connected_components
from cartograph.llm.near_dup import _WordHashes, aligned_similarity, bands_of, deduplicate, labels_of, near_duplicates


def brute(texts, least=0.8):
    known = _WordHashes()
    labels = {k: labels_of(t, known) for k, t in texts.items() if t is not None}
    parent = {k: k for k in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(labels)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if texts[a] == texts[b] or len(labels[a]) and len(labels[b]) and aligned_similarity(labels[a], labels[b], least) >= least:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in texts}


def test_brute_force(spark, docs, texts):
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(docs).collect()}
    assert got == brute(texts)


def test_short_texts_that_differ_at_an_end(spark):
    random.seed(11)
    texts, k = {}, 0
    for n_words in range(5, 18):
        for _ in range(12):
            words = [f"v{random.randrange(10**6)}" for _ in range(n_words)]
            for near in (words, [*words, "end"], ["start", *words], [*words[1:], "other"], ["start", *words, "end"], words[2:]):
                texts[k] = " ".join(near)
                k += 1
    texts |= {k + j: "a line of eight words that many share " + f"z{j}" for j in range(300)}  # 9 words, no link between two
    texts |= {k + 300: "a line of eight words that many share", k + 301: "another line of nine words that few share now"}
    want = brute(texts)
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == want and len({want[k + j] for j in range(301)}) == 1


def test_nine_against_ten_words(spark):
    random.seed(12)
    texts = {}
    for k in range(3000):
        words = [f"v{random.randrange(10**6)}" for _ in range(10)]
        texts[2 * k], texts[2 * k + 1] = " ".join(words[:9]), " ".join(words)
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {k: k // 2 * 2 for k in texts}


def test_group_of_near_copies(spark):
    random.seed(5)
    base = [f"w{random.randrange(9999)}" for _ in range(300)]
    texts = {}
    for k in range(60):
        words = list(base)
        for _ in range(random.randrange(0, 9)):
            words[random.randrange(300)] = f"x{random.randrange(9999)}"
        texts[k] = " ".join(words)
    texts |= {100 + k: texts[7] for k in range(50)}
    texts |= {200 + k: " ".join(base[:60] + [f"y{random.randrange(9999)}" for _ in range(240)]) for k in range(40)}
    rows = near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    got = {r["doc_id"]: r["class_id"] for r in rows}
    assert got == brute(texts) and all(got[200 + k] == 200 + k for k in range(40))
    assert sum(r["kept"] for r in rows) == len(set(got.values())) and {r["n_class"] for r in rows if r["class_id"] == got[7]} == {list(got.values()).count(got[7])}


def test_odd_rows(odd, none):
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(odd).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8, 9: 9}
    assert near_duplicates(none).count() == 0
    twice = near_duplicates(odd.union(odd.withColumn("doc_id", F.col("doc_id") + 100)))
    assert {r["doc_id"] for r in twice.where("kept").collect()} == {0, 100, 1, 2, 3, 4, 6, 7, 8, 9}


def test_repeated_rows_and_null_ids(odd, none):
    """Of every class one row stays: not one an id, and no row bypasses it for want of an id."""
    nameless = odd.withColumn("doc_id", F.lit(None).cast("long"))
    rows = odd.union(odd).union(nameless).union(odd.withColumn("text", F.lit("another text under an id that is taken")))
    out = near_duplicates(rows)
    assert out.count() == 40 and out.where("kept").count() == 12 and out.where("class_id is null").count() == 1  # three null texts of rows with and without id
    left = deduplicate(rows.withColumn("own", F.lit(1)))
    assert left.columns == [*odd.columns, "own"] and left.count() == 12 and left.select("text").distinct().count() == 10
    assert deduplicate(none).count() == 0


def test_text_without_spaces(spark):
    random.seed(8)
    texts = {}
    for k, (low, high) in enumerate([(0x4E00, 0x9FA0), (0x3041, 0x3097), (0x0E01, 0x0E2F)]):
        base = [chr(random.randrange(low, high)) for _ in range(2000)]
        texts |= {10 * k: "".join(base), 10 * k + 1: "".join(base[:900] + ["x"] + base[901:]), 10 * k + 2: "".join(base[:500] + base[:500]), 10 * k + 3: "".join(base[::-1])}
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute(texts) and [got[10 * k + 1] for k in range(3)] == [0, 10, 20] and got[2] == 2 and got[3] == 3


def test_large_buckets_are_dealt_anew(spark, monkeypatch):
    """Texts that share most of their words with very many others, and near copies among them."""
    from cartograph.llm import near_dup

    asked = []
    rare = near_dup._rare
    monkeypatch.setattr(near_dup, "LARGE", 60)
    monkeypatch.setattr(near_dup, "_rare", lambda *a: asked.append(1) or rare(*a))
    random.seed(3)
    passage = [f"p{k}" for k in range(60)]
    texts = {}
    for k in range(0, 900, 3):
        own = [f"v{random.randrange(10**6)}" for _ in range(40)]
        texts[k] = " ".join(passage + own)
        texts[k + 1] = " ".join(passage + own[:-1] + ["other"])
        texts[k + 2] = " ".join(passage + own[:20] + [f"v{random.randrange(10**6)}" for _ in range(20)])
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert asked and got == brute(texts)


def test_labels_and_order():
    known = _WordHashes()
    a = labels_of("a b c d e " * 20, known)
    assert len(set(a.tolist())) == len(a) == 96
    assert len(labels_of("a b", known)) == 1 and len(labels_of(" ", known)) == 0 and len(bands_of(labels_of("", known))) == 0
    words = [f"w{k}" for k in range(400)]
    one, swapped = " ".join(words), " ".join(words[200:] + words[:200])
    assert aligned_similarity(labels_of(one, known), labels_of(one, known)) == 1
    assert aligned_similarity(labels_of(one, known), labels_of(swapped, known)) < 0.8  # the same 5-grams nearly, in another order
    long = np.arange(1, 40000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert len(bands_of(long)) == 28


def test_components(spark):
    ws = Workspace(spark, "test")
    edges = [(k + 1, k) for k in range(40)] + [(100, 101), (102, 101), (7, 7), (None, 3), (200, 40)]
    got = dict(connected_components(ws, spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {k: 0 for k in range(1, 41)} | {101: 100, 102: 100, 200: 0}
    assert connected_components(ws, spark.createDataFrame([], "a long, b long")).count() == 0
