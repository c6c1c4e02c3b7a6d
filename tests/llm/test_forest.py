import numpy as np
import pandas as pd

from heddle.llm import forest

SCHEMA = "node_id string, embedding array<array<double>>, vid string"


def brute(rows, k, least):
    flat = [(i, tuple(v)) for i, vs in rows for v in (vs or []) if v and any(v)]
    flat = sorted(set(flat))
    out = set()
    for i, v in flat:
        best = {}
        for j, w in flat:
            if j != i and len(v) == len(w):
                s = float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w))
                best[j, w] = max(s, best.get((j, w), -2))
        near = sorted(((-round(s, 12), j) for (j, _), s in best.items() if s >= least))[:k]
        out |= {tuple(sorted((i, j))) for _, j in near}
    return out


def make(n, seed=0, dim=16):
    rnd = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        centre = rnd.standard_normal(dim)
        for k in range(4):
            rows.append((f"n{c:03d}_{k}", [(centre + 0.12 * rnd.standard_normal(dim)).tolist()]))
    return rows


def test_recall_against_brute_force(spark):
    rows = make(150)
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    got = {(r.node_id_a, r.node_id_b) for r in forest.similar_pairs(df, 10, 0.95, leaf=64).collect()}
    want = brute(rows, 10, 0.95)
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 300


def test_odd_rows(spark):
    v, w = [1.0, 0.0, 0.5, 0.0], [0.99, 0.01, 0.5, 0.0]
    rows = [("a", [v, [0.0] * 4]), ("a", [v]), ("b", [v]), ("c", [w]), ("d", None), ("e", []), ("f", [[]]), ("g", [[1.0, 0.0]]), ("h", [[float("nan"), 1.0, 0.0, 0.0]]), (None, [v])]
    df = spark.createDataFrame([(i, x, None) for i, x in rows], SCHEMA)
    got = {(r.node_id_a, r.node_id_b) for r in forest.similar_pairs(df).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c")}
    assert forest.similar_pairs(df.limit(0)).count() == 0


def test_many_copies_of_one_vector(spark):
    v = [0.1, 0.9, 0.3, 0.2]
    df = spark.createDataFrame([(f"n{k:03d}", [v], None) for k in range(60)], SCHEMA)
    got = forest.nearest(df, 10, 0.95)
    per = {r.node_id: r["count"] for r in got.groupBy("node_id").count().collect()}
    assert len(per) == 60 and set(per.values()) == {10}


def test_prefix_blocks():
    rnd = np.random.default_rng(1)
    hashes = np.sort(rnd.integers(0, 2**63, 200).astype("uint64"))
    seen = np.concatenate([q for _, _, q in forest.candidate_blocks(hashes, 20)])
    assert sorted(seen.tolist()) == list(range(200))
    assert all(hi - lo >= 20 for lo, hi, _ in forest.candidate_blocks(hashes, 20))


def test_leaves_cover():
    hashes = np.sort(np.random.default_rng(2).integers(0, 2**63, 1000).astype("uint64"))
    starts = forest.leaf_starts(hashes, 50)
    assert starts[0] == 0 and np.bincount(np.searchsorted(starts, hashes, "right") - 1).max() <= 50


def test_neighbours_without_a_floor(spark):
    rnd = np.random.default_rng(5)
    centres = rnd.standard_normal((40, 24))
    v = centres[rnd.integers(0, 40, 12_000)] + 1.2 * rnd.standard_normal((12_000, 24))  # more cells than are asked
    df = spark.createDataFrame([(f"n{i:05d}", [x.tolist()], None) for i, x in enumerate(v)], SCHEMA)
    ask = spark.createDataFrame([(f"n{i:05d}",) for i in range(0, 12_000, 40)], "node_id string")
    got = {}
    for r in forest.nearest(df, 10, queries=ask).collect():
        got.setdefault(int(r.node_id[1:]), set()).add(int(r.neighbor_id[1:]))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for i in range(0, 12_000, 40):
        s = u @ u[i]
        s[i] = -2
        hits += len(got[i] & set(np.argsort(-s)[:10].tolist()))
        assert len(got[i]) == 10
    assert hits >= 0.9 * 3000


def test_all_pairs_of_few_vectors(spark):
    rnd = np.random.default_rng(6)
    v = rnd.standard_normal((200, 8))
    df = spark.createDataFrame([(f"n{i:03d}", [x.tolist()], None) for i, x in enumerate(v)], SCHEMA)
    got = {(r.node_id, r["rank"]): r for r in forest.nearest(df, 10).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i in range(200):
        s = u @ u[i]
        s[i] = -2
        for r, j in enumerate(np.argsort(-s)[:10], 1):
            row = got[f"n{i:03d}", r]
            assert row.neighbor_id == f"n{j:03d}" and abs(row.similarity - s[j]) < 1e-12


def test_pieces_cover_whatever_the_batches():
    rnd = np.random.default_rng(3)
    h = np.sort(rnd.integers(0, 2**62, 3000))
    h[1000:1700] = h[1000]  # equal strings
    table = pd.DataFrame({"leaf": np.repeat([1, 2, 2], 1000), "hash": h, "vid": np.arange(3000)})
    whole = [p["vid"].tolist() for p in forest.sorted_pieces(iter([table]), 200, 30)]
    for size in (1, 7, 450):
        parts = (table.iloc[i : i + size] for i in range(0, 3000, size))
        assert [p["vid"].tolist() for p in forest.sorted_pieces(parts, 200, 30)] == whole
    assert max(map(len, whole)) <= 200 + 2 * 30 + 200 and sorted({v for p in whole for v in p}) == list(range(3000))
    near = {(a, a + d) for p in whole for a in p for d in (1, 15) if a + d in p}
    assert all((a, a + d) in near for d in (1, 15) for a in range(3000 - d) if (a < 1000) == (a + d < 1000))


def test_recall_in_deep_trees(spark):
    """Leaves far smaller than the sample asks for: every array is worked off in many pieces."""
    rnd = np.random.default_rng(8)
    centres = rnd.standard_normal((3000, 32))
    v = np.repeat(centres, 4, axis=0) + 0.35 * rnd.standard_normal((12_000, 32))
    df = spark.createDataFrame([(f"n{i:05d}", [x.tolist()], None) for i, x in enumerate(v)], SCHEMA)
    old, forest.SAMPLE = forest.SAMPLE, 40
    try:
        got = {(r.node_id, r.neighbor_id) for r in forest.nearest(df, 10, 0.8, leaf=64).collect()}
    finally:
        forest.SAMPLE = old
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = set()
    for i in range(0, 12_000, 20):
        s = u @ u[i]
        s[i] = -2
        want |= {(f"n{i:05d}", f"n{j:05d}") for j in np.argsort(-s)[:10] if s[j] >= 0.8}
    assert len(want) > 800 and len(want & got) >= 0.9 * len(want)
