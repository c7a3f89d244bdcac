"""The operators marked native plan no Python."""

import re

import pytest

from cartograph.llm.queries import QUERIES
from cartograph.llm.mixing import mix_blocks, mix_documents
from cartograph.llm.secret_scan import fit_secrets, redact


@pytest.mark.parametrize("name", ["op4_secrets", "op5_fingerprints", "op7_urls"])
def test_queries(spark, sf, name):
    assert not re.search("Python|Arrow|Pandas", QUERIES[name](spark, sf)._jdf.queryExecution().toString())


def test_mix_counts(spark, docs, monkeypatch):
    """All tables that the operator writes, its result included."""
    from cartograph.llm import mixing

    plans = []

    class Watched(mixing.Workspace):
        def table(self, df, name):
            plans.append(df._jdf.queryExecution().toString())
            return super().table(df, name)

    monkeypatch.setattr(mixing, "Workspace", Watched)
    mixing.mix_counts(docs)
    assert len(plans) > 3 and not any(re.search("Python|Arrow|Pandas", p) for p in plans)


def test_stages(spark, docs):
    for df in (mix_documents(docs), mix_blocks(docs), redact(docs, fit_secrets(docs))):
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())
