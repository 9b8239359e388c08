"""The cover tree against brute force, at the level of trees and of tables, with small blocks and all edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import common, op5

SCHEMA = "vec_id long, embedding array<double>, n_links int, component_id string, Kept string"


def unit(v):
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def sets(d, seed):
    r = np.random.default_rng(seed)
    loose, centres = r.normal(size=(400, d)), r.normal(size=(60, d))
    return {"loose": loose, "clusters": np.repeat(centres, 6, 0) + r.normal(size=(360, d)) * 0.1 / np.sqrt(d / 8), "one": r.normal(size=(1, d)) + r.normal(size=(500, d)) * 0.2, "chain": np.array([[np.cos(x / 9), np.sin(x / 9), *[0.0] * (d - 2)] for x in range(40)])}


@pytest.mark.parametrize("d", [2, 5, 64])
@pytest.mark.parametrize("pairs", [64, 1 << 16])
def test_dual_traversal(d, pairs, monkeypatch):
    monkeypatch.setattr(op5, "PAIRS", pairs)
    for v in sets(d, d).values():
        v, n = unit(v), len(v)
        want = {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(np.triu(v @ v.T >= 0.9, 1))))}
        for split in (n, n // 3):
            parts = [x for x in (np.arange(split), np.arange(split, n)) if len(x)]
            trees = [op5.Tree(v[p], np.full(len(p), d), op5.paths(v[p]), p) for p in parts]
            got = []
            for a, b in {(0, 0), (0, len(trees) - 1), (len(trees) - 1, len(trees) - 1)}:
                for x, y in op5.dual(trees[a], trees[b], 0.9):
                    got += [(min(p), max(p)) for p in zip(trees[a].rows[x].tolist(), trees[b].rows[y].tolist())]
            assert len(got) == len(set(got)) and set(got) == want


def test_paths_are_nested_and_cover():
    for v in map(unit, sets(8, 1).values()):
        path = op5.paths(v)
        for k, radius in enumerate(op5.RADII):
            assert np.linalg.norm(v - v[path[:, k]], axis=1).max() <= radius + 1e-6
            assert (path[path[:, k], k] == path[:, k]).all()
            if k:
                assert len(set(zip(path[:, k].tolist(), path[:, k - 1].tolist()))) == len(set(path[:, k].tolist()))


def test_tree_prunes_given_vectors(spark):
    """Below the top level at most a twentieth of all pairs is looked at."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("embedding").collect()
    v = unit(np.array([r[0] for r in rows], float))
    tree, tried = op5.Tree(v, np.full(len(v), v.shape[1]), op5.paths(v), np.arange(len(v))), []
    found = sum(len(x) for x, _ in op5.dual(tree, tree, 0.9, tried))
    assert found == int(np.triu(v @ v.T >= 0.9, 1).sum())
    assert sum(n for level, n in tried if level) < 0.05 * len(v) * (len(v) - 1) / 2


@pytest.mark.parametrize("block, leaves", [(8192, 256), (40, 8)])
def test_table_against_brute_force(spark, monkeypatch, block, leaves):
    monkeypatch.setattr(op5, "BLOCK", block)
    monkeypatch.setattr(op5, "LEAVES", leaves)
    v = np.concatenate(list(sets(6, 3).values()))[::3]
    v = np.concatenate([v, v[:20], v[20:30] * 2.0])
    u = unit(v)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    root = common.union(np.arange(len(v)), *np.nonzero(near))
    ids = np.random.default_rng(4).permutation(len(v)) * 3
    names = np.array([ids[root == r].min() for r in root])
    rows = [(int(i), x.tolist(), 1, "a", "b") for i, x in zip(ids, v)]
    got = {r.vec_id: r for r in op5.near_pairs(spark.createDataFrame(rows, SCHEMA), 0.9).collect()}
    assert len(got) == len(v)
    for i, k, c in zip(ids.tolist(), near.sum(1).tolist(), names.tolist()):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (k, c, c == i)


def test_ties_and_odd_rows(spark):
    inf = float("inf")
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.001]), (3, [0.001, 1.0]), (None, [1.0, 0.0]), (None, [-1.0, 0.0]), (7, [1.0, 0.0, 0.0]), (8, None), (9, [0.0, 0.0]), (10, [inf, 1.0]), (None, None), (11, []), (12, [None, 1.0]), (13, [float("nan"), 1.0])]
    df = spark.createDataFrame([(*r, 1, "a", "b") for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in op5.near_pairs(df, 0.9).collect()), key=repr)
    want = [(1, 2, 1, True), (1, 1, 1, True), (2, 2, 1, False), (3, 1, 1, False), (None, 2, 1, False), (None, 0, None, True), (7, 0, 7, True), (None, 0, None, True), *((i, 0, i, True) for i in (8, 9, 10, 11, 12, 13))]
    assert got == sorted(want, key=repr)
    assert op5.near_pairs(df.limit(0), 0.9).count() == 0 and op5.near_pairs(df.where("vec_id = 8"), 0.9).collect()[0].kept
    # at the threshold: 0.6, 0.8 has a cosine of exactly 0.6 with the axis, and just below it none
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [3.0, 4.0]), (3, [0.6 - 1e-9, 0.8])], "vec_id long, embedding array<double>")
    links = {r.vec_id: r.n_links for r in op5.near_pairs(df, 0.6).collect()}
    assert links == {1: 1, 2: 2, 3: 1}


def test_query(spark):
    got = op5.op5_embedding_near_dedup(spark, "/root/testdata/sf0.001")
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"] and got.count() == spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert got.where((F.col("vec_id") == F.col("component_id")) != F.col("kept")).isEmpty()
