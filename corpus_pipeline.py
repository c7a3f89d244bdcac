"""A training corpus from raw documents: the stages in order, each on all that its predecessor
kept.

Stages take and return the columns of ``documents`` (doc_id, text, lang, source, n_chars);
the last returns what a trainer reads.  Between stages the rows are written as Parquet and
read again, so a lost executor costs the tasks of one stage only.  Stages that only run
Python return frames of a copy of the caller's session with smaller Arrow batches: whole
texts are in them, and a worker and its executor keep the memory that large ones took.

Defined results: other columns than those are dropped at the first stage, whatever their
names.  A null or empty text has the classifier's score for no text; of empty texts one stays
and null texts are no copies of each other, unless that score rejects them.  Rows without id are documents like others, and of
repeated rows one stays.  A null source is a source.  The mix leaves documents without words
out, and a document has a row for each pass that takes words of it.  Texts of any length go
through whole.  An empty table gives no rows, at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartograph.llm.common import Workspace, owned_by, small_batches
from cartograph.llm.mixing import mix_documents
from cartograph.llm.near_dup import deduplicate
from cartograph.llm.pieces import encode
from cartograph.llm.quality import fit_quality, score_quality
from cartograph.llm.secret_scan import fit_secrets, redact

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
KEEP_SCORE = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.3 or more stay."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(docs.select(*COLUMNS), model, out_col="__score")
    return owned_by(small_batches(spark), scored.where(F.col("__score") >= KEEP_SCORE).select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays, that of smallest id, null ids last."""
    return deduplicate(docs.select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; all documents stay."""
    masked = redact(docs.select(*COLUMNS), fit_secrets(docs))
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a row for each pass that takes words of a document."""
    return mix_documents(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, with the scores of its best segmentations."""
    return owned_by(small_batches(spark), encode(docs))


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("secrets", secrets),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = ws.table(stage(spark, docs, sf_dir), name)
        if last is not None:
            ws.drop(last)
        last = docs
    return docs
