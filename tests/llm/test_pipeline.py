import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from cartograph.llm.common import ARROW_ROWS, BATCH_ROWS
from cartograph.llm.pieces import Encoder
from cartograph.llm.vocabulary import MODEL_PATH, parse_vocabulary


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    seen, texts = {}, {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "sentencepiece":
            assert docs.columns == pipeline.COLUMNS
            seen[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
            texts[name] = docs.select("doc_id", "text").collect()
    good = [k for k, q in labels.items() if q == 1]
    assert sum(k in set(seen["quality"]) for k in good) > 0.97 * len(good)
    assert sum(k in set(seen["quality"]) for k, q in labels.items() if q == 0) < 0.35 * (len(labels) - len(good))
    plain = {r["doc_id"]: r["text"] for r in texts["quality"]}
    kept = [plain[k] for k in seen["near_dedup"]]
    assert len(set(kept)) == len(kept) < len(seen["quality"])
    assert len(seen["secrets"]) == len(seen["near_dedup"])
    assert not any('token = "' in r["text"] and "[SECRET]" not in r["text"] for r in texts["secrets"])
    assert set(seen["mixing"]) <= set(seen["secrets"]) and max(seen["mixing"].count(k) for k in set(seen["mixing"])) <= 3
    with open(MODEL_PATH, "rb") as file:
        encoder = Encoder(parse_vocabulary(file.read()), 4)
    mixed = sorted((r["doc_id"], encoder(r["text"])[0].tolist()) for r in texts["mixing"])
    assert mixed == sorted((r["doc_id"], r["ids"]) for r in docs.collect())


def test_run_and_odd_rows(spark, odd, none, tmp_path):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(10)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    odd.union(odd.withColumn("doc_id", F.lit(None).cast("long"))).write.parquet(f"{tmp_path}/documents.parquet")
    rows = pipeline.run(spark, str(tmp_path)).collect()
    assert all(len(r["ids"]) == r["n_pieces"] for r in rows)
    odd_rows = odd.union(odd).union(odd.withColumn("doc_id", F.lit(None).cast("long")))
    once = pipeline.near_dedup(spark, odd_rows, str(tmp_path)).collect()
    assert len(once) == len({r["text"] for r in once}) + 2 and all(r["doc_id"] is not None for r in once if r["text"] is not None)  # null texts are alone
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_stages_run_python_in_small_batches(spark, monkeypatch):
    """What a stage returns is written in small batches of whole texts, whatever the caller's session has."""
    import pyarrow as pa

    sf = "/root/testdata/sf0.01"

    def sized(docs, *_, out_col="ids", **__):
        names = [*docs.columns, out_col]

        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([float(batch.num_rows)] * batch.num_rows)], names)

        return docs.mapInArrow(run, docs.withColumn(out_col, F.lit(1.0)).schema)

    before = spark.conf.get(ARROW_ROWS)
    docs = spark.range(0, 5000, numPartitions=1).selectExpr("id doc_id", "'x' text", "'en' lang", "'s' source", "1L n_chars")
    monkeypatch.setattr(pipeline, "encode", sized)
    found = pipeline.sentencepiece(spark, docs, sf)
    assert found.agg(F.max("ids")).first()[0] == BATCH_ROWS and found.count() == 5000
    monkeypatch.setattr(pipeline, "fit_quality", lambda *_: None)
    monkeypatch.setattr(pipeline, "score_quality", sized)
    monkeypatch.setattr(pipeline, "KEEP_SCORE", BATCH_ROWS + 1)
    assert pipeline.quality(spark, docs, sf).count() == 0  # no batch was larger
    monkeypatch.setattr(pipeline, "KEEP_SCORE", BATCH_ROWS)
    kept = pipeline.quality(spark, docs, sf)
    assert kept.count() == 5000 // BATCH_ROWS * BATCH_ROWS and kept.columns == pipeline.COLUMNS
    assert kept.join(docs.select("doc_id"), "doc_id").count() == kept.count()  # it joins with frames of the caller
    assert spark.conf.get(ARROW_ROWS) == before
