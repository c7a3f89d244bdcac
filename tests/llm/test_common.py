import pyarrow as pa

from cartograph.llm.common import ARROW_ROWS, BATCH_ROWS, Workspace


def test_tables_are_written_in_small_batches(spark):
    """A table is written in small batches, and the caller's session keeps its settings."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    before = spark.conf.get(ARROW_ROWS)
    rows = spark.range(0, 5000, numPartitions=1)
    ws = Workspace(spark, "batches")
    table = ws.table(rows.mapInArrow(sizes, "n long"), "sizes")
    found = [r["n"] for r in table.collect()]
    assert sum(found) == 5000 and max(found) == BATCH_ROWS
    assert spark.conf.get(ARROW_ROWS) == before and table.sparkSession is spark
    assert [r["n"] for r in rows.mapInArrow(sizes, "n long").collect()] == [5000]
    joined = ws.table(table.join(spark.createDataFrame([(BATCH_ROWS, "x")], "n long, x string"), "n"), "joined")
    assert joined.columns == ["n", "x"] and joined.count() == found.count(BATCH_ROWS)
