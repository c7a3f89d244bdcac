import numpy as np
import pytest
from pyspark.sql import functions as F

from cartograph.functions import digests, paths, tokens
from cartograph.functions import vectors as V
from cartograph.functions.common_terms import common_terms, load_terms, telling_terms
from cartograph.functions.embedding import HashEmbedder, embed_column
from cartograph.functions.wordpiece import encode_text, load_vocabulary, word_ids


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, expected", [
    ("lib/Orchard/CiderPress", "lib orchard cider press"), ("XMLReader", "xml reader"), ("tidal-gauge_v3", "tidal gauge v3"),
    ("lib/Harbour/Harbour", "lib harbour"), ("IMooringPlan", "mooring plan"), ("ABs", "a bs"), ("Port80Probe", "port80probe"),
    (".", ""), ("", ""), ("x\\y//z", "x y z"),
])
def test_tokenize_path(spark, text, expected):
    assert value(spark, tokens.tokenize_path(F.lit(text))) == expected


def test_other_tokens(spark):
    assert value(spark, tokens.query_tokens(F.lit("Cider press\tIOrchard tide_now"))) == ["cider", "press", "orchard", "tide", "now"]
    assert value(spark, tokens.tokenize_file_name(F.lit("IAnchorAnchorLine.spec.cs"))) == "anchor anchor line spec"
    assert value(spark, tokens.path_phrase(F.lit("lib/ITideTable/low-Water"))) == "lib Tide Table low-Water"
    assert value(spark, tokens.path_phrase(F.lit("."))) == "."
    assert value(spark, tokens.file_name_phrase(F.lit("ICiderPress.cs"))) == "Cider Press"
    assert value(spark, tokens.method_phrase(F.lit("HasWater_left"))) == "Has Water_left"
    text = tokens.embedding_text(F.lit("lib/Quay"), F.array(F.lit("B.cs"), F.lit("IKiteLine.cs")), F.array(F.lit("ReelIn")))
    assert value(spark, text) == "lib Quay. Files: B, Kite Line. Methods: Reel In"


def test_paths(spark):
    assert value(spark, paths.folder_of(F.lit("a/b/c.cs"))) == "a/b"
    assert value(spark, paths.folder_of(F.lit("c.cs"))) == "."
    assert value(spark, paths.normalize(F.lit("a\\b//"))) == "a/b"
    assert value(spark, paths.language_of(F.lit("x.TSX"))) == "typescript"
    assert value(spark, paths.language_of(F.lit("x.py"))) is None
    assert value(spark, paths.has_segment(F.lit("src/tests/a.cs")))
    assert not value(spark, paths.has_segment(F.lit("src/MyTests/a.cs")))
    assert value(spark, paths.glob_match(F.lit("src/a/b/x.cs"), "src/**/*.cs"))
    assert not value(spark, paths.glob_match(F.lit("src/a/x.cs"), "src/*.cs"))
    assert value(spark, paths.glob_match(F.lit("a[1].cs"), "a[1].cs"))
    assert paths.is_glob("a?") and not paths.is_glob("a.cs")
    assert paths.glob_root("src/a/*/b.cs") == "src/a" and paths.glob_root("*.cs") == "."
    assert value(spark, paths.file_set(F.array(F.lit("b"), F.lit("A"), F.lit("a")))) == "A|a|b"


def test_digests(spark):
    import hashlib

    key = value(spark, digests.state_key(F.lit("main"), F.array(F.lit("b:2"), F.lit("a:1"), F.lit("b:2"))))
    assert key == hashlib.sha256(b"main\na:1\nb:2").hexdigest()[:16].upper()
    m = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))
    assert value(spark, digests.hashes_json(m)) == '{"a":"1","b":"2"}'
    assert value(spark, digests.json_file_set(F.lit('{"b":1,"A":2}'))) == "A|b"
    assert value(spark, digests.json_file_set(F.lit("{oops"))) is None


def test_vectors(spark):
    a, b = F.array(F.lit(0.6), F.lit(0.8)), F.array(F.lit(0.8), F.lit(0.6))
    assert value(spark, V.dot(a, b)) == pytest.approx(0.96)
    assert value(spark, V.dot(a, F.array(F.lit(1.0)))) == 0
    none = F.array().cast("array<string>")
    assert value(spark, V.match_fraction(none, F.array(F.lit("a")))) == 0
    assert value(spark, V.match_fraction(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a")))) == 0.5
    must = F.array(F.lit("cider"))
    assert value(spark, V.must_adjustment(must, F.array(F.lit("cider")), F.lit(0.9))) == 0.15
    assert value(spark, V.must_adjustment(must, none, F.lit(0.83))) == -0.20
    assert value(spark, V.must_adjustment(must, none, F.lit(0.82))) == 0
    blob = spark.range(1).select(V.pack(F.array(F.lit(1.5), F.lit(-2.0))).alias("b"))
    assert blob.select(V.unpack(F.col("b")).alias("v")).first()["v"] == [1.5, -2.0]


def test_common_terms(spark):
    rows = spark.createDataFrame([(k, ["src", f"t{k}"] + ["pay"] * (k < 1)) for k in range(10)], "k int, t array<string>")
    assert [r["term"] for r in common_terms(rows, "k", "t").collect()] == ["src"]
    assert load_terms("# x\n a \n\nb") == ["a", "b"]
    assert value(spark, telling_terms(F.array(F.lit("src"), F.lit("cider")), ["src"])) == ["cider"]
    assert value(spark, telling_terms(F.array(F.lit("SRC")), ["src"])) == ["SRC"] and value(spark, telling_terms(F.array(F.lit("get")))) == ["get"]


def test_wordpiece():
    v = load_vocabulary(["[PAD]", "", "moor", "##ing", "cider"])
    assert word_ids("mooring", v) == [2, 3] and word_ids("moorx", v) == [100]
    ids, mask, kinds = encode_text("Mooring  CIDER zzz", v, 8)
    assert ids == [101, 2, 3, 4, 100, 102, 0, 0] and mask == [1] * 6 + [0] * 2 and kinds == [0] * 8
    assert encode_text("cider mooring cider", v, 4)[0] == [101, 4, 102, 0]
    assert encode_text(None, v, 4)[0] == [101, 102, 0, 0]


def test_embedding(spark):
    e = HashEmbedder(32)
    a = e.embed(["Cider presses", "Cider presses", ""])
    assert np.allclose(np.linalg.norm(a[:2], axis=1), 1) and (a[0] == a[1]).all() and not a[2].any()
    rows = spark.createDataFrame([("x y",), (None,)], "t string").select(embed_column(F.col("t"), e).alias("v")).collect()
    assert [len(r["v"]) for r in rows] == [32, 32]
