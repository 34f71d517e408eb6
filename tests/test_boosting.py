"""Boosted trees against a written-out brute force, tree by tree."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotline.operators import boosting as B


def brute_tree(x, cats, levels, g, rows, columns, p):
    """Exhaustive exact-greedy tree on raw values: nested dicts."""
    def t(v):
        return np.sign(v) * max(abs(v) - p.alpha, 0.0)

    def score(r):
        return t(g[r].sum()) ** 2 / (len(r) + p.lam)

    def grow(r, depth):
        leaf = {"weight": -p.rate * t(g[r].sum()) / (len(r) + p.lam)}
        if depth == p.depth:
            return leaf
        best = None
        for j in range(x.shape[1]):
            if not columns[j]:
                continue
            miss = np.isnan(x[r, j])
            for missing_left in (False, True) if miss.any() else (False,):
                for cut in np.unique(x[rows][~np.isnan(x[rows, j]), j])[1:]:
                    left = (x[r, j] < cut) | (miss & missing_left)
                    best = consider(best, r, left, ("n", j, cut, missing_left))
        at = x.shape[1]
        for j, vs in enumerate(levels):
            for v in vs:
                if columns[at]:
                    best = consider(best, r, cats[r, j] != v, ("c", j, v, True))
                at += 1
        if best is None:
            return leaf
        gain, left, rule = best
        a, b = grow(r[left], depth + 1), grow(r[~left], depth + 1)
        if "rule" not in a and "rule" not in b and gain < p.gamma:
            return leaf
        return {"rule": rule, "gain": gain, "left": a, "right": b}

    def consider(best, r, left, rule):
        a, b = r[left], r[~left]
        if len(a) < max(p.min_child, 1) or len(b) < max(p.min_child, 1):
            return best
        gain = score(a) + score(b) - score(r)
        if gain > B.LEAST_GAIN and (best is None or gain > best[0] * (1 + 1e-9)):
            return gain, left, rule
        return best

    return grow(rows, 0)


def brute_score(tree, xr, cr):
    while "rule" in tree:
        kind, j, v, missing_left = tree["rule"]
        if kind == "n":
            left = missing_left if np.isnan(xr[j]) else xr[j] < v
        else:
            left = cr[j] != v
        tree = tree["left" if left else "right"]
    return tree["weight"]


def table(n, seed):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 9, n).astype(float), np.round(rng.normal(size=n), 2), rng.integers(0, 3, n).astype(float)])
    x[rng.random(n) < 0.15, 0] = np.nan
    cats = np.array([["a", "b", "c", "d"][i] for i in rng.integers(0, 4, n)], dtype=object).reshape(n, 1)
    y = 3 * (x[:, 1] > 0) + np.nan_to_num(x[:, 0]) * 0.7 + 5 * (cats[:, 0] == "b") + np.round(rng.normal(size=n), 3)
    return x, cats, y


def frame(spark, x, cats, y, valid=None):
    rows = [(i, *(None if np.isnan(v) else float(v) for v in x[i]), *cats[i], None if y is None else float(y[i]),
             bool(valid[i]) if valid is not None else False) for i in range(len(x))]
    return spark.createDataFrame(rows, "id long, p double, q double, r double, k string, y double, v boolean")


PARAMS = [B.BoostParams(rounds=4, depth=3, rate=0.3, lam=1.0, alpha=0.5, gamma=1.0, min_child=3),
          B.BoostParams(rounds=3, depth=4, rate=0.05, lam=0.0, alpha=0.0, gamma=12.0),
          B.BoostParams(rounds=3, depth=2, rate=0.5, lam=2.0, alpha=20.0, subsample=0.8, colsample=0.6, seed=7)]


@pytest.mark.parametrize("p", PARAMS)
def test_trees_equal_brute_force(spark, p):
    x, cats, y = table(180, 5)
    df = frame(spark, x, cats, y)
    model = B.fit(df, "y", ["p", "q", "r"], ["k"], p, key=["id"])
    assert len(model.trees) == p.rounds and model.base == pytest.approx(y.mean())
    keys = np.array([r[0] for r in df.orderBy("id").select(F.xxhash64("id")).collect()], dtype=np.int64)
    levels, pred = [["a", "b", "c", "d"]], np.full(len(y), model.base)
    codes = model._codes(*map(lambda c: c, _xc(model, df)))
    for t, tree in enumerate(model.trees):
        rows = np.flatnonzero(B._drawn(keys, p.subsample, p.seed, t))
        if p.subsample < 1:
            assert 0.6 * len(y) < len(rows) < len(y)
        brute = brute_tree(x, cats, levels, pred - y, rows, B.drawn_columns(p, 7, t), p)
        want = np.array([brute_score(brute, x[i], cats[i]) for i in range(len(y))])
        got = tree.weight[tree.leaves(codes, 3)]
        assert got == pytest.approx(want, abs=1e-9), t
        pred = pred + want
    scored = {r.id: r.prediction for r in model.predict(df).collect()}
    assert [scored[i] for i in range(len(y))] == pytest.approx(list(pred), abs=1e-8)


def _xc(model, df):
    pdf = model._coded(df).orderBy("id").select("_x", "_c").toPandas()
    return pdf["_x"], pdf["_c"]


def test_same_trees_however_partitioned_and_folded(spark, monkeypatch):
    x, cats, y = table(400, 6)
    p = B.BoostParams(rounds=6, depth=3, rate=0.2, subsample=0.7)
    df = frame(spark, x, cats, y * 1e7 + 0.1)
    a = B.fit(df.coalesce(1), "y", ["p", "q", "r"], ["k"], p, key=["id"])
    monkeypatch.setattr(B, "FOLD_TREES", 2)
    monkeypatch.setattr(B, "BLOCK_ROWS", 16)
    b = B.fit(df.repartition(9), "y", ["p", "q", "r"], ["k"], p, key=["id"])
    for s, t in zip(a.trees, b.trees):
        assert s.feature.tolist() == t.feature.tolist() and s.code.tolist() == t.code.tolist()
        assert s.weight == pytest.approx(t.weight, rel=1e-9)


def test_early_stop_validation_and_wide_columns(spark):
    rng = np.random.default_rng(0)
    n = 2_000
    x = np.column_stack([rng.normal(size=n), rng.random(n), rng.integers(0, 2, n)])
    cats = np.array([[f"c{i}"] for i in rng.integers(0, 40, n)], dtype=object)
    valid = np.arange(n) % 4 == 0
    y = np.sin(2 * x[:, 0]) + rng.normal(size=n)
    model = B.fit(frame(spark, x, cats, y, valid), "y", ["p", "q", "r"], ["k"],
                  B.BoostParams(rounds=60, depth=4, rate=0.4), key=["id"], valid=F.col("v"), patience=5, width=10)
    best = int(np.argmin(model.errors))
    assert len(model.errors) == best + 6 and len(model.trees) == best      # stopped 5 rounds after the best
    assert len(model.levels[0]) == 10 and [len(c) for c in model.cuts][0] in range(200, 256)
    pred = model.predict(frame(spark, x, cats, y, valid)).where("v").select(F.avg(F.pow(F.col("y") - F.col("prediction"), 2))).first()[0]
    assert pred == pytest.approx(model.errors[best])
    assert pred < np.var(y[valid])


def test_save_load_unseen_levels_and_importance(spark, tmp_dir):
    x, cats, y = table(200, 8)
    model = B.fit(frame(spark, x, cats, y), "y", ["p", "q", "r"], ["k"], B.BoostParams(rounds=5, depth=3), key=["id"])
    model.save(spark, f"{tmp_dir}/model")
    again = B.BoostedTrees.load(spark, f"{tmp_dir}/model")
    odd = spark.createDataFrame([(1, None, None, None, None, 0.0, False), (2, 99.0, -5.0, float("nan"), "new", 0.0, False)],
                                frame(spark, x, cats, y).schema)
    for rows in (odd, frame(spark, x, cats, y)):
        want = sorted((r.id, r.prediction) for r in model.predict(rows).collect())
        assert sorted((r.id, r.prediction) for r in again.predict(rows).collect()) == want
        assert all(np.isfinite(v) for _, v in want)
    gain, weight = dict(model.importance()), dict(model.importance("weight"))
    assert sum(gain.values()) == pytest.approx(1) and set(gain) == set(weight) and "k=b" in gain
    assert sum(weight.values()) == sum(int((t.feature >= 0).sum()) for t in model.trees)


def test_empty_and_constant_labels(spark):
    x, cats, y = table(30, 9)
    df = frame(spark, x, cats, y)
    with pytest.raises(ValueError):
        B.fit(df.where("false"), "y", ["p"], [], B.BoostParams(rounds=1))
    flat = B.fit(df.withColumn("y", F.lit(4.0)), "y", ["p"], [], B.BoostParams(rounds=2))
    assert {r.prediction for r in flat.predict(df).collect()} == {4.0}


def test_one_job_grows_the_trees_of_one_block(spark, monkeypatch):
    x, cats, y = table(300, 11)
    df = frame(spark, x, cats, y, np.arange(300) % 5 == 0)
    p = B.BoostParams(rounds=40, depth=4, rate=0.2, subsample=0.8, colsample=0.8)

    def fit(group):
        spark.sparkContext.setJobGroup(group, group)
        model = B.fit(df, "y", ["p", "q", "r"], ["k"], p, key=["id"], valid=F.col("v"))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return model, jobs

    one, jobs = fit("boost-one")
    assert len(one.trees) == 40 and jobs < 30
    monkeypatch.setattr(B, "BLOCK_ROWS", 50)
    many, _ = fit("boost-many")
    assert many.errors == pytest.approx(one.errors, rel=1e-12)
    for s, t in zip(one.trees, many.trees, strict=True):
        assert s.feature.tolist() == t.feature.tolist() and s.code.tolist() == t.code.tolist()
        assert s.weight.tolist() == t.weight.tolist()


def test_cuts_of_few_and_many_values_in_one_pass(spark):
    rows = [(float(i % 300), float(i % 7) if i % 3 else None, float("nan") if i % 2 else -0.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(5)
    a, b, c = B.cuts_of(df, ["a", "b", "c"], bins=256)
    assert 200 < len(a) < 256 and a == sorted(set(a)) and min(a) > 0
    assert b == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0] and c == []
    assert B.cuts_of(df, ["a"], bins=400) == [[float(i) for i in range(1, 300)]]
    assert B.cuts_of(df.where("false"), ["a"]) == [[]]


def wide_table(n, levels, seed):
    """Rows of a number and a category of many levels, some of which alone move the label."""
    rng = np.random.default_rng(seed)
    at = (levels * rng.random(n) ** 2).astype(int)
    x = np.column_stack([np.round(rng.normal(size=n), 2), rng.integers(0, 5, n).astype(float), rng.integers(0, 3, n).astype(float)])
    y = x[:, 0] + 9.0 * (at % 7 == 3) + np.round(rng.normal(size=n), 3)
    return x, np.array([[f"é{v:03d}" if v % 2 else f"L{v:03d}"] for v in at], dtype=object), y


@pytest.mark.parametrize("block", [1 << 16, 100])
def test_every_level_has_its_column(spark, monkeypatch, tmp_dir, block):
    """The trees are those of all levels' columns, however few sums go through the driver."""
    x, cats, y = wide_table(700, 90, 3)
    df = frame(spark, x, cats, y, np.arange(700) % 6 == 0 if block == 100 else np.arange(700) < 100)
    p = B.BoostParams(rounds=6, depth=3, rate=0.5, min_child=2, subsample=0.9, colsample=0.9)
    args = df, "y", ["p", "q", "r"], ["k"], p
    whole = B.fit(*args, key=["id"], valid=F.col("v"))
    monkeypatch.setattr(B, "BLOCK_ROWS", block)
    monkeypatch.setattr(B, "CACHED_ROWS", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    few = B.fit(*args, key=["id"], valid=F.col("v"), width=4)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert whole.sizes == few.sizes and len(whole.levels[0]) == whole.sizes[0] > 80 and len(few.levels[0]) == 4
    assert few.split[0] and not whole.split[0]          # rarer levels were split on
    for s, t in zip(whole.trees, few.trees, strict=True):
        assert s.feature.tolist() == t.feature.tolist() and s.weight.tolist() == t.weight.tolist()
        assert [c for f, c in zip(s.feature, s.code) if f >= 0] == [c for f, c in zip(t.feature, t.code) if f >= 0]
    assert few.errors == pytest.approx(whole.errors, rel=1e-12)
    few.save(spark, f"{tmp_dir}/few")
    again = B.BoostedTrees.load(spark, f"{tmp_dir}/few")
    want = sorted((r.id, r.prediction) for r in whole.predict(df).collect())
    for model in (few, again):
        assert sorted((r.id, r.prediction) for r in model.predict(df, known=True).collect()) == want
        assert model.importance() == whole.importance() and model.importance("weight") == whole.importance("weight")
        with pytest.raises(Exception, match="not fitted on"):
            model.predict(df.withColumn("k", F.lit("new")), known=True).collect()


def test_two_wide_categories_and_deep_trees(spark, monkeypatch):
    x, cats, y = wide_table(500, 60, 4)
    other = np.array([[f"m{int(v) % 41}"] for v in np.random.default_rng(1).integers(0, 999, 500)], dtype=object)
    rows = [(i, float(x[i, 0]), cats[i, 0], None if i % 50 == 0 else other[i, 0], float(y[i] + 4 * (other[i, 0] == "m7"))) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, p double, k string, m string, y double")
    p = B.BoostParams(rounds=3, depth=8, rate=0.5)
    whole = B.fit(df, "y", ["p"], ["k", "m"], p, key=["id"])
    assert max(np.flatnonzero(t.feature >= 0).max() for t in whole.trees) >= 2 ** 7 - 1       # splits in the last level
    monkeypatch.setattr(B, "BLOCK_ROWS", 120)
    few = B.fit(df, "y", ["p"], ["k", "m"], p, key=["id"], width=3)
    for s, t in zip(whole.trees, few.trees, strict=True):
        assert s.feature.tolist() == t.feature.tolist() and s.weight.tolist() == t.weight.tolist()
    assert sorted((r.id, r.prediction) for r in whole.predict(df).collect()) == sorted((r.id, r.prediction) for r in few.predict(df).collect())


def test_a_level_adds_up_one_of_two_children(spark):
    """Below the root the rows of the smaller child of each split are summed, at most half of
    the rows; the other child's sums are the parent's less these."""
    x, _, y = table(600, 12)
    p = B.BoostParams(rounds=4, depth=5, rate=0.3)
    layout = B._Layout([sorted(set(v[~np.isnan(v)]))[1:] for v in x.T], [], [])
    block = {"res": y.mean() - y} | {f"c{j}": c for j, c in enumerate(layout.encode(x, np.zeros((600, 0))))}
    grower, seen = B._Grower(p, layout, 2.0 ** 20, 1e6), []

    class Blocks(B._TaskBlocks):
        def sums(self, tree, depth, round_, todo, nodes, totals):
            out = super().sums(tree, depth, round_, todo, nodes, totals)
            seen.append((depth, len(todo), len(nodes), out[1][:, :layout.widths[0]].sum()))
            return out

    trees, _ = grower.grow(Blocks(grower, [block]), None)
    assert len(trees) == 4 and max(d for d, *_ in seen) == 4
    assert all((k, rows) == (1, 600) if d == 0 else 2 * k == n and 2 * rows <= 600 for d, k, n, rows in seen)
