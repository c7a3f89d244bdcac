import subprocess

import pytest

from cartograph.engine import Engine
from cartograph.functions.embedding import HashEmbedder
from cartograph.operators import hints, search
from cartograph.plans import index
from cartograph.sources import files, git


def write(root, path, text):
    target = root / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text)


@pytest.fixture()
def repo(tmp_path):
    run = lambda *a: subprocess.run(["git", *a], cwd=tmp_path, check=True, capture_output=True)
    run("init", "-q", "-b", "main"), run("config", "user.email", "a@b.c"), run("config", "user.name", "n")
    write(tmp_path, "lib/Orchard/AppleHarvest.cs", "public class AppleHarvest { public void Pick() { } void Sort() { } }")
    write(tmp_path, "lib/Orchard/CiderPress.cs", "public class CiderPress { public void Squeeze() { } }")
    write(tmp_path, "lib/Hive/honeyFrame.ts", "export function fillComb() { }")
    write(tmp_path, "lib/Tests/OrchardTests.cs", "class T { }")
    write(tmp_path, "top.cs", "class Top { }")
    run("add", "-A"), run("commit", "-qm", "x")
    return tmp_path


def test_git_listing(spark, repo):
    write(repo, "lib/New.cs", "class N { }")
    (repo / "top.cs").unlink()
    rows = git.working_tree(git.git_files(spark, str(repo))).collect()
    assert {r["path"] for r in rows} == {"lib/Orchard/AppleHarvest.cs", "lib/Orchard/CiderPress.cs", "lib/Hive/honeyFrame.ts", "lib/New.cs"}
    assert all(r["hash"].startswith("wt:") == (r["path"] == "lib/New.cs") for r in rows)
    assert git.branch(str(repo)) == "main" and len(git.head(str(repo))) == 40
    assert git.head("/") == git.UNKNOWN
    with pytest.raises(RuntimeError):
        git.worktree_root("/")


def test_incremental_index(spark, repo):
    engine = Engine(spark, str(repo), embedder=HashEmbedder(32))
    assert engine.status() == index.MISSING
    assert engine.index() == {"folders": 3, "updated": 3, "unchanged": 0, "removed": 0}
    assert engine.status() == index.FRESH
    before = {r["path"]: r for r in engine.store.read().collect()}
    assert before["lib/Orchard"]["tokens"] == ["lib", "orchard", "apple", "harvest", "cider", "press", "pick", "squeeze"]
    assert before["lib/Orchard"]["embedding_text"] == "lib Orchard. Files: Apple Harvest, Cider Press. Methods: Pick, Squeeze"
    assert "." in before
    write(repo, "lib/Hive/honeyFrame.ts", "export function fillComb() { }\nexport function smoke() { }")
    assert engine.status() == index.STALE
    assert engine.index() == {"folders": 3, "updated": 1, "unchanged": 2, "removed": 0}
    after = {r["path"]: r for r in engine.store.read().collect()}
    assert after["lib/Orchard"] == before["lib/Orchard"] and "smoke" in after["lib/Hive"]["tokens"]
    assert engine.index(force=True)["updated"] == 3
    (repo / "top.cs").unlink()
    assert engine.index()["removed"] == 1 and engine.store.read().count() == 2
    subprocess.run(["git", "checkout", "-qb", "other"], cwd=repo, check=True)
    assert engine.status() == index.STALE
    assert engine.store.meta("git_head") and engine.store.meta("nothing") is None
    best = engine.find_scope("cider apple press").collect()
    assert best[0]["path"] == "lib/Orchard" and len(best) == 2 and engine.status() == index.FRESH
    assert [r["path"] for r in engine.find_scope("comb", top=1, must=["honey"]).collect()] == ["lib/Hive"]
    with pytest.raises(ValueError):
        engine.find_scope(" ")


def test_commands(spark, repo):
    engine = Engine(spark, str(repo), embedder=HashEmbedder(32))
    rows = engine.expand_folder(str(repo / "lib"), "pick").collect()
    assert [r["member_name"] for r in rows] == ["Pick"]
    rows = engine.signatures([str(repo / "lib/*/*.ts"), str(repo / "nope.cs")]).collect()
    assert [r["member_name"] for r in rows] == ["fillComb"] and engine.notes
    rows = engine.get_method_source(str(repo / "lib/Orchard/AppleHarvest.cs"), "Pick").collect()
    assert rows[0]["content"] == "public void Pick() { }"
    assert engine.suggest(str(repo / "lib/Orchard/AppleHarvest.cs"), "pic") == ["Pick"]
    assert files.scan_folder(spark, str(repo), content=False).columns == ["path", "modified", "size"]


def test_store_maintenance(spark, tmp_path):
    store = index.IndexStore(spark, f"file://{tmp_path}/i")
    assert store.manifest() is None
    store.ensure()
    row = lambda p, t: (p, [t], t, [1.0], {"a": t}, "a")
    store.upsert(spark.createDataFrame([row("x", "1"), row("y", "1")], index.SCHEMA))
    store.upsert(spark.createDataFrame([row("y", "2"), row("z", "2")], index.SCHEMA), {"k": "v"})
    assert sorted((r["path"], r["embedding_text"]) for r in store.read().collect()) == [("x", "1"), ("y", "2"), ("z", "2")]
    store.keep(spark.createDataFrame([("z",)], "path string"))
    assert [r["path"] for r in store.states().collect()] == ["z"] and store.meta("k") == "v"
    store.put_meta("k", "w")
    assert store.meta("k") == "w" and store.vectors().count() == 1
    store.clear()
    assert store.read().count() == 0
    old = spark.createDataFrame([("p", "src pay", '{"b":"1","A":"2"}')], "path string, combined_tokens string, file_hashes string")
    new = index.migrate(old).first()
    assert new["tokens"] == ["src", "pay"] and new["filename_set"] == "A|b" and new["embedding"] is None and new["embedding_text"] == "src pay"


def test_a_crash_in_the_swap_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store = index.IndexStore(spark, f"file://{tmp_path}/i")
    row = lambda p, t: (p, [t], t, [1.0], {"a": t}, "a")
    store.ensure()
    store.upsert(spark.createDataFrame([row("x", "1")], index.SCHEMA), {"index_state_key": "one"})
    with monkeypatch.context() as m:
        m.setattr(index.IndexStore, "_rename", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.upsert(spark.createDataFrame([row("x", "2")], index.SCHEMA), {"index_state_key": "two"})
    again = index.IndexStore(spark, f"file://{tmp_path}/i")
    assert again.meta("index_state_key") == "one" and [r["embedding_text"] for r in again.read().collect()] == ["1"]
    newest = max(n for n in (p.name for p in (tmp_path / "i").iterdir()) if n.startswith("manifest-") and n.endswith(".json"))
    (tmp_path / "i" / f"manifest-{int(newest[9:18]) + 1:09d}.json").write_text('{"cut sho')  # a manifest that is not whole
    assert again.meta("index_state_key") == "one"
    again.upsert(spark.createDataFrame([row("y", "3")], index.SCHEMA), {"index_state_key": "three"})
    assert again.meta("index_state_key") == "three" and again.read().count() == 2


def test_state_key_of_listings(spark):
    import hashlib

    def want(rows):
        entries = sorted({f"{p}:{h}" for p, h in rows})
        digits, buckets = index.bucket_digits(len(entries)), {}
        for e in entries:
            buckets.setdefault(hashlib.md5(e.encode()).hexdigest()[:digits], []).append(e)
        parts = sorted(f"{b}:{hashlib.sha256(chr(10).join(v).encode()).hexdigest()}" for b, v in buckets.items())
        return hashlib.sha256(chr(10).join(["main", *parts]).encode()).hexdigest()[:16].upper()

    assert index.bucket_digits(10) == 1 and index.bucket_digits(10**9) == 5
    rows = [(f"p{k % 500}", f"h{k % 700}") for k in range(900)]
    assert index.state_key_of(spark.createDataFrame(rows, "path string, hash string"), "main") == want(rows)


def test_ranking(spark):
    rows = spark.createDataFrame([("b", [1.0, 0.0], []), ("a", [1.0, 0.0], []), ("c", [0.0, 1.0], ["pay"]), ("d", None, ["pay"])], "path string, embedding array<double>, tokens array<string>")
    got = search.search(rows, [1.0, 0.0], ["pay", "get"], common=["get"]).collect()
    assert [(r["path"], round(r["score"], 4)) for r in got] == [("a", 1.0), ("b", 1.0), ("c", 0.3)]
    assert [r["path"] for r in search.search(rows, [1.0, 0.0], ["pay"], top=None, min_score=0.9).collect()] == ["a", "b"]
    assert search.search(rows, [1.0, 0.0], [], top=0).count() == 3
    assert [r[0] for r in search.ranked_lines(search.search(rows, [1.0, 0.0], [], top=1)).collect()] == ["1.0000\ta"]
    asked = spark.createDataFrame([(1, [0.0, 1.0])], "k int, v array<double>")
    assert [r["path"] for r in search.search_many(rows, asked, "k", "v", 1).collect()] == ["c"]
    unit, words = search.must_state([[1.0, 0.0], [0.0, 1.0]], [["a"], ["b", "a"]])
    assert unit == pytest.approx([0.5**0.5] * 2) and words == ["a", "b"]


def test_hints(spark):
    scores = spark.createDataFrame([(0.80 + k / 1000,) for k in range(6)], "score double")
    row = hints.cluster_hint(scores).first()
    assert row["tight"] and row["suggested"] == pytest.approx(0.799)
    assert not hints.cluster_hint(scores.limit(4)).first()["tight"]
    few = spark.createDataFrame([("f", 10), ("f", 51)], "folder string, lines int")
    assert hints.folder_hints(few, "folder", "lines").first()["small"]
    assert "No signatures matched" in hints.no_match_note("src", "x", 3)


def test_stream(spark, tmp_path):
    from cartograph.streaming.refresh import FILES, refresh_stream

    store = index.IndexStore(spark, f"file://{tmp_path}/i")
    source = f"{tmp_path}/in"
    rows = [("src/A.cs", "src", "A.cs", "h1", "class A { public void Go() { } }")]
    spark.createDataFrame(rows, FILES).write.parquet(source)
    run = lambda: refresh_stream(spark, source, store, f"{tmp_path}/c", HashEmbedder(16)).awaitTermination()
    run()
    assert store.read().first()["tokens"] == ["src", "a", "go"]
    spark.createDataFrame([("src/A.cs", "src", "A.cs", "h2", "class A { public void Stop() { } }")], FILES).write.mode("append").parquet(source)
    run()
    assert [r["tokens"] for r in store.read().collect()] == [["src", "a", "stop"]]
