"""exact_quantiles equals Spark's exact percentile on both of its paths."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from plotline.operators.quantiles import exact_quantiles, value_bucket


@pytest.mark.parametrize("accuracy", [50, 1000, 50_000])
def test_grouped_matches_percentile(spark, accuracy):
    li = spark.read.parquet(f"{SF_MID}/lineitem.parquet").withColumn(
        "px", F.when(F.col("l_linenumber") == 7, None).otherwise(F.col("l_extendedprice")))
    specs = {"med": ("px", 0.5), "p10": ("px", 0.1), "p90": ("px", 0.9), "q": ("l_quantity", 0.5),
             "mn": ("px", 0.0), "mx": ("px", 1.0)}
    got = exact_quantiles(li, ["l_returnflag"], specs=specs, accuracy=accuracy)
    want = li.groupBy("l_returnflag").agg(
        F.percentile("px", 0.5).alias("med2"), F.percentile("px", 0.1).alias("p102"),
        F.percentile("px", 0.9).alias("p902"), F.percentile("l_quantity", 0.5).alias("q2"),
        F.min("px").alias("mn2"), F.max("px").alias("mx2"))
    rows = got.join(want, "l_returnflag").collect()
    assert len(rows) == 3
    for r in rows:
        for k in specs:
            assert r[k] == pytest.approx(r[k + "2"], rel=1e-12, abs=1e-9), (k, r)


def test_nulls_and_empty_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), ("b", None), ("c", 5.0)],
                               "k string, v double")
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", {"m": 0.5},
                                           extra_aggs=[F.count("v").alias("n")]).collect()}
    assert got["a"].m == 2.0 and got["a"].n == 2
    assert got["b"].m is None and got["b"].n == 0
    assert got["c"].m == 5.0


def test_global_with_ties(spark):
    df = spark.range(1000).select((F.col("id") % 7).cast("double").alias("v"))
    q = exact_quantiles(df, [], "v", {"a": 0.01, "b": 0.5, "c": 0.99}, accuracy=100).first()
    w = df.agg(F.percentile("v", [0.01, 0.5, 0.99]).alias("p")).first().p
    assert [q.a, q.b, q.c] == pytest.approx(w)


@pytest.mark.parametrize("broadcast", [False, True])
def test_hot_key_third_of_rows(spark, broadcast):
    """One key holds a third of all rows (plus ties); results stay exact on both the
    salted and the broadcast join path."""
    n = 90_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 300).cast("string")).alias("k"),
        ((F.col("id") * 7919) % 10007 / 10.0).alias("v"))
    got = exact_quantiles(df, ["k"], "v", {"med": 0.5, "p99": 0.99}, accuracy=2000,
                          broadcast_groups=broadcast)
    want = df.groupBy("k").agg(F.percentile("v", 0.5).alias("med2"), F.percentile("v", 0.99).alias("p992"))
    bad = got.join(want, "k").where(
        (F.abs(F.col("med") - F.col("med2")) > 1e-9) | (F.abs(F.col("p99") - F.col("p992")) > 1e-9))
    assert bad.count() == 0
    assert got.count() == want.count() == 201


@pytest.mark.parametrize("broadcast", [False, True])
def test_one_key_and_a_value_with_half_of_the_rows(spark, broadcast):
    df = spark.range(60_000).select(
        F.lit("all").alias("k"),
        F.when(F.col("id") % 2 == 0, 100.0).otherwise((F.col("id") * 7919) % 30011 / 7.0).alias("v"))
    probs = {"a": 0.1, "b": 0.5, "c": 0.987}
    got = exact_quantiles(df, ["k"], "v", probs, broadcast_groups=broadcast).first()
    want = df.agg(F.percentile("v", list(probs.values())).alias("p")).first().p
    assert [got.a, got.b, got.c] == pytest.approx(want, rel=1e-12)


def test_negative_tiny_and_huge_values_and_null_keys(spark):
    vals = [-1e300, -7.5, -7.25, -1e-300, -0.0, 0.0, 5e-324, 1e-9, 0.5, 1.0, 2.0, 2.0, 3.0, 1.7e308]
    df = spark.createDataFrame([(k, v) for k in (None, "x") for v in vals], "k string, v double")
    b = [r.b for r in df.where("k = 'x'").orderBy("v").select(value_bucket(F.col("v"), 512).alias("b")).collect()]
    assert b == sorted(b)
    probs = {f"q{i}": i / 13 for i in range(14)}
    rows = exact_quantiles(df, ["k"], "v", probs).collect()
    assert {r.k for r in rows} == {None, "x"}
    for r in rows:
        assert [r[f"q{i}"] for i in range(14)] == pytest.approx(sorted(vals), rel=1e-9)
    special = spark.createDataFrame([(v,) for v in (float("-inf"), -1.0, 4.0, float("inf"), float("nan"))], "v double")
    r = exact_quantiles(special, [], "v", {"lo": 0.0, "mid": 0.5, "inf": 0.75, "nan": 1.0}).first()
    assert (r.lo, r.mid, r.inf) == (float("-inf"), 4.0, float("inf")) or r.lo != r.lo
    assert r.mid == 4.0 and r.nan != r.nan
    empty = exact_quantiles(df.where("false"), [], "v", {"m": 0.5}).collect()
    assert len(empty) == 1 and empty[0].m is None


def test_join_groups_paths_agree(spark):
    from plotline.operators.joins import attach_row, join_groups
    fact = spark.range(5000).select((F.col("id") % 7).cast("string").alias("k"), F.col("id").alias("v"))
    fact = fact.unionByName(spark.createDataFrame([(None, 1)], "k string, v long"))
    groups = fact.groupBy("k").agg(F.sum("v").alias("s"))
    plain = sorted(map(tuple, fact.join(groups, "k", "left").collect()), key=repr)
    for kw in ({"broadcast": True}, {}, {"salt_cols": ["v"]}):
        got = sorted(map(tuple, join_groups(fact, groups, ["k"], "left", **kw).collect()), key=repr)
        assert got == plain, kw
    one = spark.createDataFrame([(1.5,)], "x double")
    assert attach_row(fact, one).where("x = 1.5").count() == fact.count()


@pytest.mark.parametrize("how", ["inner", "left"])
def test_heavy_keys_are_spread_in_proportion(spark, how):
    """A key with half of the rows (and the null key with an eighth) is dealt to salts in
    proportion; no (key, salt) keeps more than a part; keys below that are copied nowhere."""
    from plotline.operators.joins import heavy_keys, spread_join
    n, parts = 40_000, 50
    fact = spark.range(n).select(
        F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 8 == 1, F.lit(None))
        .otherwise((F.col("id") % 1999).cast("string")).alias("k"), F.col("id").alias("v"))
    counts = fact.groupBy("k").agg(F.count(F.lit(1)).alias("_rows"))
    heavy = {r.k: r._copies for r in heavy_keys(counts, ["k"], parts).collect()}
    assert heavy == {"hot": 25, None: 7}
    groups = counts.where("k <> '77'").withColumnRenamed("_rows", "n")
    got = spread_join(fact, groups, ["k"], how, parts=parts)
    want = fact.join(groups, "k", how)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    salted = fact.where("k = 'hot'").select(F.pmod(F.xxhash64("k", "v"), F.lit(25)).alias("s")).groupBy("s").count()
    assert salted.count() == 25 and salted.agg(F.max("count")).first()[0] < 1.3 * n / parts
    empty = spread_join(fact.where("false"), groups, ["k"], how)
    assert empty.isEmpty() and empty.columns == got.columns


def test_rows_filtered_by_the_wanted_buckets(spark):
    rows = [(None if i % 11 == 0 else f"k{i % 7}", None if i % 5 == 0 else float((i * 7919) % 997) - 300.0) for i in range(2000)]
    df = spark.createDataFrame([*rows, ("none", None), ("one", 4.0)], "k string, v double")
    extra = [F.count("v").alias("n"), F.min("v").alias("lo")]
    want = sorted(exact_quantiles(df, ["k"], "v", {"m": 0.5, "q": 0.9}, extra).collect(), key=str)
    made = exact_quantiles(df, ["k"], "v", {"m": 0.5, "q": 0.9}, extra, accuracy=64, filter_rows=True)
    assert sorted(made.collect(), key=str) == want and len(want) == 10
    assert "LeftSemi" in made._jdf.queryExecution().optimizedPlan().toString()
