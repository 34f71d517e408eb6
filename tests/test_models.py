"""Model pipelines: exact statistics, shapes and rules of the fits (the trees themselves
are held against brute force in test_boosting.py)."""

import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from plotline import constants as K
from plotline.operators import boosting as B
from plotline.operators import features as FE
from plotline.operators import models as M
from plotline.operators import ordering as O
from plotline.plans import catalog as C
from plotline.plans import views as V
from plotline.sources.tables import Tables

SMALL = replace(M.FORECAST_PARAMS, rounds=5)


def test_forecast_48_months_per_city(spark):
    tr = V.transactions(Tables(spark, SF_SMALL))
    feats = FE.forecast_features(tr, post_year=1998)
    model, metrics = M.fit_forecast(feats, "1999-01-01", 1998, SMALL)
    assert len(model.trees) == SMALL.rounds and not model.errors      # the refit keeps the full count
    pred = M.forecast_cities(tr, model, post_year=1998)
    per_city = {r.city: r.n for r in pred.groupBy("city").agg(F.count("*").alias("n")).collect()}
    assert set(per_city.values()) == {48}
    assert len(per_city) == tr.select("city").distinct().count()
    # months are contiguous and start right after each city's history
    gaps = (pred.groupBy("city").agg(F.min("date").alias("a"), F.max("date").alias("b"))
            .where(F.months_between("b", "a") != 47).count())
    assert gaps == 0
    m = metrics.first()
    assert m.mae is not None and m.rmse >= m.mae >= 0
    assert pred.where(F.col("predicted_value").isNull() | F.isnan("predicted_value")).count() == 0
    with pytest.raises(Exception, match="not fitted on"):
        M.forecast_cities(tr.withColumn("city", F.lit("elsewhere")).limit(3), model, post_year=1998).collect()


def test_reference_parameters():
    assert (M.FORECAST_PARAMS.rounds, M.FORECAST_PARAMS.depth, M.FORECAST_PARAMS.alpha, M.FORECAST_PARAMS.gamma) == (500, 4, 0.5, 1.0)
    assert len(M.grid_settings()) == 32 and M.grid_settings()[0].rounds == 1000
    assert {(p.rate, p.depth) for p in M.grid_settings()} == {(0.01, 6), (0.01, 8), (0.02, 6), (0.02, 8)}


def test_price_model_save_load_and_unseen_levels(spark, tmp_dir):
    props = C._props(spark, SF_SMALL)
    feats = FE.price_features(props, "STANDARD", 10)
    model, metrics = M.fit_price(feats, params=replace(M.PRICE_PARAMS, rounds=5))
    path = os.path.join(tmp_dir, "price_model")
    model.save(spark, path)
    loaded = M.PriceModel.load(spark, path)
    req = spark.createDataFrame(
        [("AFRICA", "NATION_0", "Supplier#000000001", 20.0, 2, 1, 30.0, 35.0),
         ("NOWHERE", "UNSEEN", "UNSEEN", 20.0, 0, 0, 30.0, 35.0)],
        "province string, district string, city string, size_m2 double, bedrooms int, bathrooms int, "
        "latitude double, longitude double")
    a = M.estimate_price(model, req).orderBy("province").collect()
    b = M.estimate_price(loaded, req).orderBy("province").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]
    for r in a:                      # unseen levels encode as zeros and still score
        assert r.estimated_price % 100 == 0
        assert r.price_range_low <= r.estimated_price <= r.price_range_high
    assert metrics.first().r2 is not None and metrics.first().mae_dollars > 0
    top = M.feature_importance(spark, model.trees).collect()
    assert 0 < len(top) <= 20 and [r.importance for r in top] == sorted((r.importance for r in top), reverse=True)


def test_preparation_uses_the_fitted_rows_only(spark):
    rows = [(1.0, "a"), (3.0, "b"), (None, "b"), (8.0, None), (100.0, "a"), (3.0, "b")]
    df = spark.createDataFrame(rows, "x double, k string")
    p = M.Preparation.fit(df, ["x"], ["k"])
    filled = [1.0, 3.0, 3.0, 8.0, 100.0, 3.0]
    mean = sum(filled) / 6
    sd = (sum((v - mean) ** 2 for v in filled) / 6) ** 0.5
    assert p.numeric["x"] == pytest.approx((3.0, mean, sd)) and p.categorical == {"k": "b"}
    other = spark.createDataFrame([(None, None), (50.0, "z")], "x double, k string")
    got = [(r.n_x, r.c_k) for r in p.apply(other).collect()]
    assert got == [(pytest.approx((3.0 - mean) / sd), "b"), (pytest.approx((50.0 - mean) / sd), "z")]
    same = M.Preparation.fit(spark.createDataFrame([(2.0, "q"), (2.0, "p")], df.schema), ["x"], ["k"])
    assert same.numeric["x"] == (2.0, 2.0, 1.0) and same.categorical == {"k": "p"}


def test_grid_search_scores_folds_without_leaks(spark, monkeypatch):
    feats = FE.price_features(C._props(spark, SF_SMALL), "STANDARD", 10)
    seen = []
    fit = M.Preparation.fit
    monkeypatch.setattr(M.Preparation, "fit", staticmethod(lambda train, *a: seen.append(train.count()) or fit(train, *a)))
    settings = [replace(M.PRICE_PARAMS, rounds=2, rate=r) for r in (0.0, 0.3)]
    model, scores = M.grid_search(feats, settings, folds=2)
    n = feats.count()
    assert len(scores) == 2 and sum(seen[:2]) == n and seen[-1] == n
    # a rate of 0 predicts the training mean of the other fold
    rows = feats.select("log_price", M.fold_number(["listing_id"], 2).alias("f")).collect()
    want = []
    for k in (0, 1):
        test, train = [r.log_price for r in rows if r.f == k], [r.log_price for r in rows if r.f != k]
        mean, own = sum(train) / len(train), sum(test) / len(test)
        want.append(1 - sum((v - mean) ** 2 for v in test) / sum((v - own) ** 2 for v in test))
    assert scores[0][1] == pytest.approx(sum(want) / 2)
    assert scores[0][1] != scores[1][1] and model.trees.params == max(scores, key=lambda s: s[1])[0]


def test_random_split_is_stable(spark):
    df = spark.range(1000).withColumnRenamed("id", "listing_id")
    a = df.repartition(7).where(M.random_split_flag(["listing_id"])).count()
    b = df.repartition(3).where(M.random_split_flag(["listing_id"])).count()
    assert a == b and 600 < a < 800


def test_estimate_requires_fields(spark):
    req = spark.createDataFrame([("A", 1.0)], "province string, size_m2 double")
    with pytest.raises(ValueError):
        M.estimate_price(None, req)


def test_label_codes_unseen_and_null(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("é", 3), ("b", 4), ("", 5), ("B", 6)], "k string, y int").repartition(5)
    codes = O.dense_codes(df, "k")
    assert {r.k: r.code for r in codes.collect()} == {"": 0, "B": 1, "a": 2, "b": 3, "é": 4}
    assert {(r.y, r.k_code) for r in O.label_encode(df, {"k": codes}).collect()} == {(1, 3), (2, 2), (3, 4), (4, 3), (5, 0), (6, 1)}
    for odd in ("x", None):
        with pytest.raises(Exception, match="no code"):
            O.label_encode(spark.createDataFrame([(odd, 1)], df.schema), {"k": codes}).collect()
    model = M.fit_label_encoded(df, df, ["k"], [], "y", B.BoostParams(rounds=30, depth=3, lam=0.0, rate=0.5))
    assert {r.y: round(r.prediction) for r in model.predict(df.where("k <> 'b'")).collect()} == {2: 2, 3: 3, 5: 5, 6: 6}
    assert O.dense_codes(df.where("false"), "k").collect() == []


def test_offsets_over_ranges(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v"), F.lit(1).alias("w")).repartition(6)
    got = O.offsets(df, ["w", "v"], "pos").collect()
    assert [r.pos for r in sorted(got, key=lambda r: r.v)] == list(range(5000))
    hits = O.one_hot_indices(df, ["v"], {"v": O.frequent_levels(df, "v", 3), "w": O.frequent_levels(df, "w", 3)}, 3)
    assert hits.where("index >= 3").count() == 5000 and hits.where("index < 3").count() == 3
    assert K.PRICE_FOLDS == 5


def test_label_codes_read_the_table_once_a_column(spark):
    df = spark.createDataFrame([(str(i % 3), str(i % 4), str(i % 5), i) for i in range(60)], "a string, b string, c string, y int")
    codes = {k: O.dense_codes(df, k) for k in "abc"}
    coded = O.label_encode(df, codes)
    assert all((r.a_code, r.b_code, r.c_code) == (r.y % 3, r.y % 4, r.y % 5) for r in coded.collect())
    # the rows once and a column's count at four places (one exchange when run); counts of
    # the joined rows would stand for the whole table at five times as many with each column
    plan = coded._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD [a#") <= 2 + 4 * 3


def test_registered_price_model_has_the_source_rounds(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(M, "fit_price", lambda features, **given: seen.append(given.get("params", M.PRICE_PARAMS)) or ("model", "metrics"))
    monkeypatch.setattr(C, "_FITS", {})
    assert C._price_model(spark, SF_SMALL) == ("model", "metrics")
    assert seen == [M.PRICE_PARAMS] and seen[0] in M.grid_settings() and seen[0].rounds in K.PRICE_GRID["rounds"]


def test_label_fit_counts_labels_once(spark):
    df = spark.createDataFrame([(str(i % 3), str(i % 4), i) for i in range(60)], "a string, b string, y int")
    model = M.fit_label_encoded(df, df, ["a", "b"], [], "y", B.BoostParams(rounds=1))
    assert {c: {r[c]: r._rows for r in t.collect()} for c, t in model.counts.items()} == {
        "a": {str(i): 20 for i in range(3)}, "b": {str(i): 15 for i in range(4)}}
    # the rows to predict are read once; their labels are not counted again for each column
    plan = O.label_encode(df, model.codes, counts=model.counts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD [a#") <= 2 + 4 and O.label_encode(df, model.codes, counts=model.counts).count() == 60
