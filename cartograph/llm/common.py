"""What the training-data operators share: intermediate tables and connected components."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch while a table is written: they can be wide, whole texts or lists of hashes.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 512


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent a folder of this machine serves, and only in local mode.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = os.path.join(tempfile.gettempdir(), f"cartograph-{os.getpid()}")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    return f"file://{folder}"


def small_batches(spark: SparkSession) -> SparkSession:
    """A copy of the caller's session with smaller Arrow batches; the caller's settings stay."""
    out = type(spark)(spark.sparkContext, spark._jsparkSession.cloneSession())
    rows = int(spark.conf.get(ARROW_ROWS))
    out.conf.set(ARROW_ROWS, min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS)
    return out


def owned_by(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` as a frame of the session ``spark``, by whose settings it runs."""
    rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, df._jdf.queryExecution().analyzed())
    return DataFrame(rows, spark)


class Workspace:
    """Intermediate Parquet tables below the shared folder.

    A table that was written survives the loss of any executor, and cuts the lineage
    of what is built on it.  The folder goes when the driver's JVM ends.

    Tables are written by a copy of the caller's session, with smaller Arrow batches; the
    caller's settings stay as they are, and what is returned belongs to the caller's session.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        fs, jvm = self._fs()
        root = fs.makeQualified(jvm.org.apache.hadoop.fs.Path(self.root))
        fs.mkdirs(root)
        fs.deleteOnExit(root)
        self.root = re.sub(r"^file:/+", "file:///", root.toString())
        self.writer = small_batches(spark)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read back."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        owned_by(self.writer, df).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._workspace_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            self._delete(df._workspace_path)

    def delete(self, name: str) -> None:
        self._delete(f"{self.root}/{name}")

    def keep_only(self, df: DataFrame) -> DataFrame:
        """Write the result and delete every earlier table."""
        older = [f"{self.root}/{k:03d}-" for k in range(1, self.count + 1)]
        out = self.table(df, "result")
        fs, jvm = self._fs()
        for status in fs.listStatus(jvm.org.apache.hadoop.fs.Path(self.root)):
            full = status.getPath().toString()
            if any(f"/{old.rsplit('/', 1)[1]}" in full for old in older):
                fs.delete(status.getPath(), True)
        return out

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm

    def _delete(self, path: str) -> None:
        fs, jvm = self._fs()
        fs.delete(jvm.org.apache.hadoop.fs.Path(path), True)


def connected_components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """``edges(a long, b long)`` to ``(id long, component long)``, for every id with a link.

    The component is its smallest id, and that id has no row of its own.  Large-star and
    small-star rounds alternate until the edges stay the same: each is two aggregations
    with map-side combine and two equi-joins, so a hub with very many links is split by
    adaptive skew joins, and only the answer to one yes-or-no question comes to the driver.
    """
    current = ws.table(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    while True:
        both = current.select("u", "v").union(current.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low2, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        following = ws.table(small, "edges")
        ws.drop(current)
        current = following
        # Done when every id points at one component that points nowhere itself.
        several = current.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        chained = current.select(F.col("v").alias("u")).distinct().join(current.select("u").distinct(), "u", "left_semi")
        if several.union(chained).isEmpty():
            return current.select(F.col("u").alias("id"), F.col("v").alias("component"))
