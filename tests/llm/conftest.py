import pytest

#: Null, empty, blank, tiny, repeated, long and odd texts; repeated rows and a null source.
TEXTS = [
    None, "", " ", "one", "one two three four five six seven eight", "one two three four five six seven eight",
    "é日本🙂 \ud7ff x\n\n y\tz", "a" * 3000, "word " * 4000, "The quick brown fox jumps over the lazy dog. " * 40,
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(k, t, "en", None if k == 3 else f"s{k % 3}", None if t is None else len(t), k, 0.5) for k, t in enumerate(TEXTS)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, taken long, score double"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("doc_id < 0")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
