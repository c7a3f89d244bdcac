"""Plans that must stay as they are: pruned scans, few shuffles, no Python where none is needed."""

import re

import pytest

from cartograph.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_top_k_moves_k_rows(spark, sf):
    text = plan(QUERIES["vector_topk"](spark, sf))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text
    assert re.search(r"ReadSchema: struct<vec_id:bigint,embedding:array<float>>", text)


def test_batched_top_k_is_limited_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan(QUERIES["batched_topk"](spark, sf))


@pytest.mark.parametrize("name", ["tokenize_path", "path_phrase", "glob_match", "segment_exclusion", "match_fraction", "identifier_tokens", "path_predicates"])
def test_expressions_need_no_shuffle_and_no_python(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert not re.search("Exchange|Python|Arrow|Pandas", text)


@pytest.mark.parametrize("name", ["state_key", "group_by_folder", "incremental_diff", "folder_texts", "low_rank_terms", "upsert", "regex_signatures"])
def test_no_python(spark, sf, name):
    assert not re.search("Python|Arrow|Pandas", plan(QUERIES[name](spark, sf)))


def test_filters_reach_the_scan(spark, sf):
    assert "PushedFilters: [IsNotNull(toxic), EqualTo(toxic,1)" in plan(QUERIES["working_tree_difference"](spark, sf))


def test_listing_without_content_reads_no_bytes(spark, tmp_path):
    from cartograph.sources.files import scan_folder

    (tmp_path / "a.cs").write_text("class A {}")
    text = plan(scan_folder(spark, str(tmp_path), content=False))
    assert "content" not in re.search(r"ReadSchema: (.*)", text)[1]
