import hashlib

from pyspark.sql import functions as F

from cartograph.llm.fingerprint import edit_fingerprints, fingerprints, likeness, spell, with_next
from cartograph.llm.queries import op5_fingerprints


def edited(texts):
    ids = sorted(texts, reverse=True)
    out = {}
    for k, i in enumerate(ids):
        own, after = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        half = len(own) // 2
        out[i] = hashlib.sha256((own[: len(own) - half] + after[:half]).encode()).hexdigest()
    return out


def test_brute_force(spark, sf, texts):
    rows = op5_fingerprints(spark, sf).collect()
    want = edited(texts)
    assert {r["doc_id"]: r["edited_sha256"] for r in rows} == want and all(r["n_chars"] == len(texts[r["doc_id"]] or "") for r in rows)
    prints: dict = {}
    for r in rows:
        prints.setdefault(texts[r["doc_id"]], set()).add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(p) == 1 for p in prints.values()) and len({tuple(p) for p in prints.values()}) == len(prints)
    mean = lambda c: sum(r[c] for r in rows) / len(rows)
    assert mean("near_edited") > 0.05 > 0.01 > mean("near_next")


def test_more_edits_are_less_alike(spark):
    words = [f"w{k}" for k in range(600)]
    texts = [" ".join(words[:-cut] + ["x"] * cut) if cut else " ".join(words) for cut in (0, 20, 100, 300)]
    texts.append(" ".join(words[300:] + words[:300]))
    rows = fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    base = rows.where("doc_id = 0").select(F.col("signature").alias("b"))
    near = [r["x"] for r in rows.crossJoin(base).select("doc_id", likeness(F.col("signature"), F.col("b")).alias("x")).orderBy("doc_id").collect()]
    assert near[0] == 1 and near[0] > near[1] > near[2] > near[3] > 0
    assert near[4] < 0.9  # the same 5-grams in another order


def test_repeated_grams(spark):
    texts = ["a b c d e " * 3, "a b c d e " * 30, "a b c d e " * 30 + "f"]
    rows = fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select(F.size("signature").alias("n"), spell(F.col("signature")).alias("s")).collect()
    assert len({r["s"] for r in rows}) == 3 and rows[1]["n"] > rows[0]["n"] > 5  # each occurrence is a label


def test_next_row_over_ranges(spark):
    for n in (1, 2, 3, 100):
        df = spark.range(n).select((F.col("id") * 3).alias("i"), F.col("id").cast("string").alias("v"))
        got = {r["i"]: r["next_v"] for r in with_next(df, "i", ["v"], range_rows=7).collect()}
        assert got == {3 * k: str((k - 1) % n) for k in range(n)}


def test_heavy_ids_fill_several_ranges(spark):
    """A third of the rows without id, a third of one id: still in the order of id and hash."""
    rows = [(None if k % 3 == 0 else 50 if k % 3 == 1 else k, f"text {k}") for k in range(600)]
    df = spark.createDataFrame(rows, "i long, v string")
    marked = sorted(((r["i"] is not None, r["i"] or 0, r["m"], r["v"]) for r in df.withColumn("m", F.xxhash64("v")).collect()), reverse=True)
    want = {r[3]: marked[(k + 1) % 600][3] for k, r in enumerate(marked)}
    out = with_next(df, "i", ["v"], range_rows=9)
    assert {r["v"]: r["next_v"] for r in out.collect()} == want


def test_text_without_spaces(spark):
    """Two thousand characters without a space, one of them changed."""
    texts = []
    for low, high in ((0x4E00, 0x9FA0), (0x3041, 0x3097), (0x0E01, 0x0E2F)):
        base = [chr(low + hashlib.md5(f"{low} {k}".encode()).digest()[0] * 131 % (high - low)) for k in range(2000)]
        texts += ["".join(base), "".join(base[:700] + ["x"] + base[701:]), "".join(reversed(base))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r["signature"] for r in fingerprints(df).collect()}
    same = lambda a, b: len(set(rows[a]) & set(rows[b])) / len({v >> 24 for v in (*rows[a], *rows[b])})
    for k in (0, 3, 6):
        assert len(rows[k]) > 50 and same(k, k + 1) > 0.9 and same(k, k + 2) < 0.1


def test_odd_rows(odd, none):
    rows = edit_fingerprints(odd).collect()
    assert len(rows) == 10 and {r["doc_id"]: r["edited_sha256"] for r in rows} == edited({r["doc_id"]: r["text"] for r in odd.collect()})
    prints = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert prints[0] == prints[1] and prints[4] == prints[5]
    assert edit_fingerprints(none).count() == 0
