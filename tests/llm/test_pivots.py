import numpy as np
import pytest

from cartograph.llm.pivot_index import choose_pivots, near_vectors, pivot_count


def brute(rows, least=0.93):
    links, parent = {k: 0 for k, _, _ in rows}, {k: k for k, _, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    good = {}
    for k, v, label in rows:
        if v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            u = np.array(v, float) / np.abs(np.array(v, float)).max()
            good[k] = (u / np.linalg.norm(u), label)
    for a in good:
        for b in good:
            if a < b and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] >= least:
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: (links[k], root(k)) for k in links}


def test_recall_and_precision(spark):
    rng = np.random.default_rng(4)
    rows, k = [], 0
    for c in range(40):
        centre = rng.standard_normal(32)
        for _ in range(rng.integers(1, 12)):
            v = centre + rng.standard_normal(32) * 0.28
            rows.append((k, [float(np.float32(x)) for x in v], int(c % 3)))
            k += 1
    dense = rng.standard_normal(32)
    for _ in range(300):  # more than a block
        rows.append((k, [float(np.float32(x)) for x in dense + rng.standard_normal(32) * 0.2], 1))
        k += 1
    rows += [(k + j, rows[3][1], rows[3][2]) for j in range(5)]
    want = brute(rows)
    got = {r["vec_id"]: r for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["n_links"] <= want[i][0] for i in want)
    assert sum(r["n_links"] for r in got.values()) >= 0.98 * sum(n for n, _ in want.values())
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert sum(got[i]["component_id"] == want[i][1] for i in want) >= 0.98 * len(want)


@pytest.mark.parametrize("seed, size", [(0, 32), (1, 64), (2, 384), (3, 64)])
def test_recall_by_cosine(spark, seed, size):
    """Single pairs by bins of cosine, and a dense group at the threshold that holds a third of all rows."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    free, centre = unit(rng.standard_normal((2400, size))), unit(rng.standard_normal((1, size)))
    dense = unit(centre + rng.standard_normal((1200, size)) * np.sqrt((1 / 0.941 - 1) / size))  # median cosine 0.941
    aside = rng.standard_normal((1200, size))
    aside = unit(aside - (aside * free[:1200]).sum(1, keepdims=True) * free[:1200])
    cosine = np.concatenate([rng.uniform(low, low + 0.01, (400, 1)) for low in (0.9301, 0.94, 0.97)])
    partner = cosine * free[:1200] + np.sqrt(1 - cosine**2) * aside
    rows = np.concatenate([free, partner, dense])
    want = (rows @ rows.T >= 0.93).sum(axis=1) - 1
    df = spark.createDataFrame([(k, r.tolist(), 1) for k, r in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    got = np.array([r["n_links"] for r in near_vectors(df).orderBy("vec_id").collect()])
    assert (got <= want).all()
    bins = [(got[k:n].sum() / want[k:n].sum()) for k, n in ((2400, 2800), (2800, 3200), (3200, 3600), (3600, 4800))]
    print("recall at 0.93-0.94, 0.94-0.95, 0.97-0.98 and in the dense group:", *bins)
    assert min(bins) >= 0.99


def test_repeated_ids(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.01, 1.0], 1), (3, [1.0, 0.01], 1), (4, [0.0, 1.0], 1), (4, [0.0, 1.0], 1)]
    got = sorted(tuple(r) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert got == [(1, 1, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 1, 1, False), (4, 3, 1, False), (4, 3, 1, False)]
    many = [(k % 50, [1.0, k // 50 / 100], k % 2) for k in range(400)]
    both = [(k, *r[1:]) for k, r in enumerate(many)]
    schema = "vec_id long, embedding array<float>, label int"
    want = sorted(n for n, _ in brute(both).values())
    assert sorted(r["n_links"] for r in near_vectors(spark.createDataFrame(many, schema)).collect()) == want


def test_pivots_grow_with_the_rows():
    counts = [pivot_count(n) for n in (0, 10**3, 10**5, 10**6, 10**8, 10**11)]
    assert counts == sorted(counts) and counts[0] == 256 and counts[-1] == 4096 and 1000 < counts[3] < 2000


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (1, [1.0, 0.01], 1), (2, [1.0, 0.0], 2), (3, None, 1), (4, [0.0, 0.0], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1),
        (7, [None, 1.0], 1), (8, [1.0, 0.0], None), (9, [1.0, 0.0, 0.0], 1), (10, [1e38, 1e36], 1), (11, [], 1), (12, [-1.0, 0.0], 1), (13, [1.0, 0.0], 1),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n_links string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(df).collect()}
    assert got == brute(rows)
    assert near_vectors(df.where("vec_id < 0")).count() == 0


def test_pivots_are_apart():
    rng = np.random.default_rng(1)
    rows = rng.standard_normal((50, 8))
    rows = np.concatenate([rows, np.repeat(rows[:1], 50, 0)])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    found = choose_pivots(rows, 90)
    assert (found @ found.T - 2 * np.eye(len(found)) < 0.7001).all() and len(found) > 10
