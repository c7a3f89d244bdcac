import zlib

from pyspark.sql import functions as F

from cartograph.llm.quality import TRAIN_WINDOWS, Feature, fit_quality, score_quality, windows_of
from cartograph.llm.queries import op3_quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r["doc_id"]: r for r in op3_quality(spark, sf).collect()}
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows.values())
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in rows.items())
    held = [(rows[r["doc_id"]], r["quality"]) for r in labels.collect() if rows[r["doc_id"]]["held_out"]]
    assert sum(r["predicted"] == q for r, q in held) / len(held) > 0.9


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(k, k % 2) for k in range(10)] + [(None, 1), (1, 7)], "doc_id long, quality int")
    model = fit_quality(odd, labels)
    got = score_quality(odd, model)
    assert got.columns == [c for c in odd.columns if c != "score"] + ["score"]
    rows = got.collect()
    assert len(rows) == 10 and rows[0]["score"] == rows[1]["score"] and rows[4]["score"] == rows[5]["score"]
    assert score_quality(none, model).count() == 0
    empty = fit_quality(odd, labels.where("doc_id < 0"))
    assert {r["score"] for r in score_quality(odd, empty).collect()} == {0.5}
    only = fit_quality(odd, labels.where("quality = 1"))
    assert all(r["score"] > 0.5 for r in score_quality(odd, only).collect())


def test_whole_text_counts():
    feature = Feature((b"good text here " * 40,), (b"BAD!! TEXT!! " * 40,), 256, 1)
    good = "good text here " * 200
    assert feature(good) > feature(good + "BAD!! TEXT!! " * 200) > feature("BAD!! TEXT!! " * 200)
    assert feature(None) == feature("") == 0


def test_windows_reach_the_end_of_a_text():
    """No prefix: the last part of a very long text trains as its first part does."""
    text = "".join(f"{k:08d}" for k in range(1_250_000))
    found = windows_of(text, 512)
    assert len(found) <= TRAIN_WINDOWS and int(found[-1][:8]) > 1_150_000 and found[0].startswith(b"00000000")
    assert windows_of("é" * 300, 512) == ["é".encode() * 256, "é".encode() * 44] and windows_of(None, 512) == windows_of("", 512) == []


def test_fit_with_repeated_ids_and_long_texts(spark, odd):
    """Rows that repeat a labelled id count once; an id with both labels does not count."""
    rows = [(k, ("good words of prose here " if k % 2 else "$$ JUNK ## 000 ") * (2 + k % 7), k % 2) for k in range(200)]
    rows[1] = (1, "good words of prose here " * 400_000, 1)  # ten million characters
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q) for k, _, q in rows], "doc_id long, quality int")
    model = fit_quality(docs, labels)
    again = docs.union(spark.createDataFrame([rows[4][:2]] * 500, docs.schema))
    assert fit_quality(again, labels.union(labels)) == model
    both = labels.union(spark.createDataFrame([(4, 1)], labels.schema))
    assert fit_quality(docs, both) == fit_quality(docs, labels.where("doc_id <> 4"))
    scores = {r["doc_id"]: r["score"] for r in score_quality(docs, model).collect()}
    assert all((scores[k] > 0.5) == (q == 1) for k, _, q in rows)
