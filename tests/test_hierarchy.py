import random

import pytest

from heddle.operators import hierarchy as h


def frame(spark, rows, extra=False):
    if extra:
        return spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "node_id string, parent_node_id string, id string, depth int")
    return spark.createDataFrame(rows, "node_id string, parent_node_id string")


def brute(rows):
    parent = {}
    for i, p in rows:
        if i is not None:
            parent[i] = min((x for x in (p, parent.get(i)) if x is not None), default=None) if i in parent else p
    parent = {i: p if p in parent else None for i, p in parent.items()}
    depth, cycles = {}, {}
    for i in parent:
        path, at = [i], parent[i]
        while at is not None and at not in path:
            path.append(at)
            at = parent[at]
        if at is None:
            depth[i] = (len(path) - 1, path[-1], list(reversed(path)))
        elif at == i:
            cycles[i] = min(path)
    return parent, depth, cycles


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    ids = [f"n{k:02d}" for k in range(40)]
    rows = [(i, rnd.choice([*ids, None, "unknown"])) for i in ids]
    rows += [(i, p) for i, p in rows[:5]]  # repeated rows
    parent, depth, cycles = brute(rows)
    got = {r.node_id: r for r in h.hierarchy(frame(spark, rows, extra=True)).collect()}
    assert set(got) == set(parent)
    for i, r in got.items():
        assert r.parent_node_id == parent[i]
        if i in depth:
            assert (r.depth, r.root_id, r.path) == depth[i] and not r.on_cycle
        else:
            assert r.depth is None and r.path is None and r.on_cycle == (i in cycles)
    found = {r.node_id: r.cycle_head for r in h.find_cycles(frame(spark, rows)).collect()}
    assert found == cycles
    pairs = {(r.ancestor_id, r.node_id, r.distance) for r in h.descendants(h.hierarchy(frame(spark, rows))).collect()}
    assert pairs == {(a, i, d - k) for i, (d, _, path) in depth.items() for k, a in enumerate(path[:-1])}


def test_long_cycle_and_tail(spark):
    ring = [(f"r{k:03d}", f"r{(k + 1) % 37:03d}") for k in range(37)]
    tail = [("t0", "r005"), ("t1", "t0"), ("self", "self")]
    found = {r.node_id: r.cycle_head for r in h.find_cycles(frame(spark, ring + tail)).collect()}
    assert found == {f"r{k:03d}": "r000" for k in range(37)} | {"self": "self"}


def test_deep_chain(spark):
    rows = [("n00", None)] + [(f"n{k:02d}", f"n{k - 1:02d}") for k in range(1, 15)]
    got = {r.node_id: r.depth for r in h.hierarchy(frame(spark, rows)).collect()}
    assert got == {f"n{k:02d}": k for k in range(15)}


def test_empty_and_nulls(spark):
    assert h.hierarchy(frame(spark, [])).count() == 0
    assert h.find_cycles(frame(spark, [])).count() == 0
    rows = h.hierarchy(frame(spark, [(None, None), (None, "a"), ("a", ""), ("b", None)])).collect()
    assert sorted((r.node_id, r.depth, r.root_id) for r in rows) == [("a", 0, "a"), ("b", 0, "b")]
