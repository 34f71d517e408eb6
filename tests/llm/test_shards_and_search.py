from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from plotline.llm import hypergeometric_shards as hs
from plotline.llm import kdtree_search as kd

from .conftest import CLASHES


def test_matrix_has_given_sums_and_right_means():
    blocks, shards = [40, 0, 7, 53, 100], [50, 50, 60, 40]
    total = np.zeros((5, 4))
    for seed in range(400):
        m = np.array(hs.communication_matrix(blocks, shards, seed))
        assert m.sum(1).tolist() == blocks and m.sum(0).tolist() == shards
        total += m
    mean = np.outer(blocks, shards) / 200
    assert np.abs(total / 400 - mean).max() < 0.8
    with pytest.raises(ValueError):
        hs.communication_matrix([1], [2], 0)


def test_large_draws_follow_the_distribution():
    rng = np.random.default_rng(3)
    good, bad, n = 3_000_000_000, 21_000_000_000, 160_000
    got = np.array([hs.hypergeometric(rng, good, bad, n) for _ in range(400)])
    p = good / (good + bad)
    sd = math.sqrt(n * p * (1 - p))
    assert abs(got.mean() - n * p) < 5 * sd / 20
    assert 0.85 < got.std() / sd < 1.15
    assert hs.hypergeometric(rng, 0, 5, 3) == 0 and hs.hypergeometric(rng, 5, 0, 3) == 3


def placed(df, **options):
    return {(r.doc_id, r.text): (r.shard, r.slot) for r in hs.uniform_shards(df.select("doc_id", "text"), **options).collect()}


def test_shards_are_exact_gapless_and_fixed_by_the_rows(docs_of):
    df = docs_of([(i, f"text {i % 7}") for i in range(203)] + [(None, None), (None, "x")])
    got = placed(df, n_shards=8, blocks=13)
    assert len(got) == 205
    size = Counter(s for s, _ in got.values())
    assert set(size) == set(range(8)) and max(size.values()) - min(size.values()) <= 1
    for s in range(8):
        assert sorted(x for t, x in got.values() if t == s) == list(range(size[s]))
    assert placed(df.repartition(5), n_shards=8, blocks=13) == got
    assert placed(df, n_shards=8, blocks=13, seed=2) != got


def test_shards_do_not_depend_on_session_settings(docs_of, spark):
    rows, got, key = [(i, f"text {i % 300}") for i in range(1000)], [], "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    try:
        for n in ("3", "16"):
            spark.conf.set(key, n)
            got.append(sorted((r.doc_id, r.shard, r.slot) for r in hs.uniform_shards(docs_of(rows)).collect()))
    finally:
        spark.conf.set(key, before)
    assert got[0] == got[1] and len(got[0]) == 1000


def test_shards_are_uniform(docs_of):
    df = docs_of([(i, "same") for i in range(48)]).cache()
    seen = Counter()
    for seed in range(12):
        for (i, _), (s, _) in placed(df, n_shards=3, blocks=4, seed=seed).items():
            seen[i % 2, s] += 1
    assert all(abs(n - 96) < 40 for n in seen.values()) and len(seen) == 6


def test_shards_edge_cases(docs_of, spark):
    assert hs.uniform_shards(docs_of([])).collect() == []
    df = docs_of([(1, "a"), (1, "a"), (2, None)], CLASHES)
    out = hs.uniform_shards(df, 2, blocks=2)
    assert sorted(out.columns) == sorted(df.columns)
    rows = out.collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(0, 0), (0, 1), (1, 0)]
    maps = spark.createDataFrame([({"a": 1},), ({"b": 2},)], "m map<string,int>")
    assert hs.uniform_shards(maps, 2, blocks=2).count() == 2


def brute(rows: dict[int, list[int]], queries: list[int], k: int):
    out = set()
    for q in queries:
        s = sorted((-sum(a * b for a, b in zip(rows[q], v, strict=True)), i) for i, v in rows.items()
                   if i != q and len(v) == len(rows[q]))[:k]
        out |= {(q, r, i, -x) for r, (x, i) in enumerate(s, 1)}
    return out


@pytest.mark.parametrize("scale", [3, 40, 2 ** 29])
def test_tree_search_is_exact_with_many_ties(spark, scale):
    rng = np.random.default_rng(scale)
    rows = {int(i): [int(x) for x in rng.integers(-scale, scale, 5)] for i in rng.permutation(700) * 3}
    for i in range(0, 300, 3):
        rows[i] = [1, 1, 1, 1, 1]  # one very common vector
    df = spark.createDataFrame([(i, v) for i, v in rows.items()], "vec_id long, v array<long>")
    queries = df.where("vec_id % 20 = 0")
    got = {tuple(r) for r in kd.top_k(df, queries, 20, shard_rows=150, query_rows=20).collect()}
    assert got == brute(rows, [i for i in rows if i % 20 == 0], 20)


def test_tree_prunes():
    rng = np.random.default_rng(1)
    v = rng.integers(-50, 50, (4000, 3))
    tree = kd.build_tree(np.arange(4000), v)
    leaves = tree["left"] < 0
    assert (tree["leaf"][leaves][:, 1] - tree["leaf"][leaves][:, 0]).max() <= kd.LEAF_ROWS
    for (a, b), low, high in zip(tree["leaf"], tree["low"], tree["high"], strict=True):
        assert (tree["vectors"][a:b].min(0) == low).all() and (tree["vectors"][a:b].max(0) == high).all()


def test_boxes_rule_out_products_of_clustered_vectors():
    rng = np.random.default_rng(2)
    centres = rng.integers(-600, 600, (40, 64))
    v = centres[rng.integers(0, 40, 6000)] + rng.integers(-6, 7, (6000, 64))
    v[100:160] = v[100]                                  # equal vectors: ties beyond k
    ids = rng.permutation(50_000)[:6000].astype(np.int64)
    tree = kd.build_tree(ids, v)
    q, q_ids, computed = v[:300], ids[:300], [0]
    got, score = kd.search_tree(tree, q_ids, q, np.full(300, -np.inf), np.full(300, np.iinfo(np.int64).max), 20, computed)
    want = q @ v.T
    want[np.arange(300), np.arange(300)] = np.iinfo(np.int64).min
    order = np.array([sorted(range(6000), key=lambda j, r=r: (-int(r[j]), ids[j]))[:20] for r in want])
    assert (got == ids[order]).all() and (score == np.take_along_axis(want, order, 1)).all()
    assert computed[0] < 0.15 * 300 * 6000
    # with the k-th known from elsewhere, nothing is scored where nothing can beat it
    again = [0]
    none, _ = kd.search_tree(tree, q_ids, q, np.full(300, 1e12), np.zeros(300, np.int64), 20, again)
    assert (none == -1).all() and again[0] == 0


def test_scores_beyond_a_long_raise(spark):
    big = spark.createDataFrame([(i, [3e8, 1.0]) for i in (0, 1, 2)], "vec_id long, embedding array<double>")
    rows = kd.quantised(big)
    with pytest.raises(Exception, match="range of a long"):
        kd.top_k(rows, rows).collect()


def test_search_edge_cases(spark):
    e = spark.createDataFrame(
        [(0, [1.0, 0.5], 1), (20, [float("nan"), 0.0], 1), (40, None, 1), (60, [None, 1.0], 2), (None, [1.0, 1.0], 1),
         (5, [1.0, -1.0], 0), (5, [1.0, -1.0], 0), (6, [1.0], 0), (7, [float("inf"), 1.0], 0), (80, [0.0, 0.0], 0)],
        "vec_id long, embedding array<float>, label int")
    q = kd.quantised(e)
    assert sorted(r.vec_id for r in q.collect()) == [0, 5, 6, 80]
    got = sorted(tuple(r) for r in kd.top_k(q, q.where("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 5, 64 * 64 - 32 * 64), (0, 2, 80, 0), (80, 1, 0, 0), (80, 2, 5, 0)]
    assert kd.top_k(q.limit(0), q.limit(0)).collect() == []
    assert kd.top_k(q, q.limit(0)).collect() == []
