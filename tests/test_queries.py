import pytest

import oracle
from cartograph.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    if name in SQL:
        assert oracle.difference(spark, QUERIES[name], SQL[name], sf) == ""
    else:
        assert QUERIES[name](spark, sf).count() > 0


def test_ranked_lines_of_odd_scores(spark, tmp_path):
    """Scores that round to zero from below, halves of either sign, a null vector and a null id."""
    scores = [1.0, -3.482412349325309e-05, 3.482412349325309e-05, -0.0, 0.0, -0.00005, 0.00005, 0.03125, -0.03125, 1.00005, -1.00015, -1.0]
    rows = [(k, [x, 0.0]) for k, x in enumerate(scores)] + [(len(scores), None), (None, [-1e-9, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert oracle.difference(spark, QUERIES["ranked_lines"], SQL["ranked_lines"], str(tmp_path)) == ""
    lines = {r["vec_id"]: r["value"] for r in QUERIES["ranked_lines"](spark, str(tmp_path)).collect()}
    assert lines[1] == "-0.0000\t1" and lines[2] == "0.0000\t2" and lines[12] is None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["vec_id", "score"]
    assert set(e.oracle_sql()) <= set(e.queries())
