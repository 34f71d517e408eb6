"""CSV source/sink and Parquet upsert."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from plotline.sources import files as SRC
from plotline.sources import sinks as SK


def test_scan_csv_declared_schema_and_na(spark, tmp_dir):
    a = os.path.join(tmp_dir, "a.csv")
    b = os.path.join(tmp_dir, "b.csv")
    with open(a, "w") as f:
        f.write("Address,Price,Type,Size,Bedrooms,Bathrooms\n"
                "\"Hamra, Beirut, Beirut\",\"$1,000\",Apartment,120 m²,3,N/A\n")
    with open(b, "w") as f:
        f.write("Address,Price,Type,Size,Bedrooms,Bathrooms\n"
                "\"Zahle, Zahle, Bekaa\",N/A,N/A,N/A,2,1\n")
    df = SRC.scan_csv(spark, [a, b], SRC.RAW_LISTING_SCHEMA)
    rows = sorted(df.collect(), key=lambda r: r.Address)
    assert len(rows) == 2
    assert rows[0].Price == "$1,000" and rows[0].Bathrooms is None
    assert rows[1].Price is None and rows[1].Type is None


def test_write_csv_roundtrip(spark, tmp_dir):
    df = spark.createDataFrame([("A", 1), ("B", 2)], "province string, listings_count int")
    out = os.path.join(tmp_dir, "out")
    SK.write_csv(df, out)
    back = spark.read.option("header", True).schema("province string, listings_count int").csv(out)
    assert sorted(map(tuple, back.collect())) == [("A", 1), ("B", 2)]


def test_upsert_parquet_writes_new_path(spark, tmp_dir):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    base = os.path.join(tmp_dir, "t0")
    old.write.parquet(base)
    new = spark.createDataFrame([("b", 20), ("c", 30)], "id string, v int")
    merged = SK.upsert_parquet(spark, new, base, os.path.join(tmp_dir, "t1"))
    assert sorted(map(tuple, merged.collect())) == [("a", 1), ("b", 20), ("c", 30)]
    assert spark.read.parquet(base).count() == 2          # the table being read is untouched


def _files(path):
    return {os.path.join(a, n): hashlib.sha256(open(os.path.join(a, n), "rb").read()).hexdigest()
            for a, _, names in os.walk(path) for n in names}


def test_keyed_table_writes_touched_parts_only(spark, tmp_dir):
    path = os.path.join(tmp_dir, "keyed")
    SK.create_keyed_table(spark.range(1000).select("id", (F.col("id") * 2).alias("v")), path, "id", 16)
    before = _files(path)
    new = spark.createDataFrame([(3, -1), (5000, -2)], "id long, v long")
    touched = SK.upsert_keyed_table(new, path)
    assert 1 <= len(touched) <= 2
    after = _files(path)
    assert all(after[f] == h for f, h in before.items())          # nothing written is changed
    parts = {int(f.split("_part=")[1].split("/")[0]) for f in after.keys() - before.keys() if "_part=" in f}
    assert parts == set(touched)
    want = {i: i * 2 for i in range(1000)} | {3: -1, 5000: -2}
    got = SK.read_keyed_table(spark, path).collect()
    assert len(got) == len(want) and {r.id: r.v for r in got} == want
    assert SK.upsert_keyed_table(new.limit(0), path) == []
    with pytest.raises(ValueError):
        SK.create_keyed_table(new, path)


def test_keyed_table_outlives_a_killed_upsert(spark, tmp_dir):
    path = os.path.join(tmp_dir, "killed")
    SK.create_keyed_table(spark.range(100).select("id", F.col("id").alias("v")), path, "id", 4)
    new = spark.range(50).select("id", F.when(F.col("id") < 49, 0).otherwise(F.raise_error(F.lit("lost"))).cast("long").alias("v"))
    with pytest.raises(Exception, match="lost"):
        SK.upsert_keyed_table(new, path)
    assert sorted((r.id, r.v) for r in SK.read_keyed_table(spark, path).collect()) == [(i, i) for i in range(100)]
    SK.upsert_keyed_table(spark.range(50).select("id", F.lit(0).cast("long").alias("v")), path)
    assert sorted((r.id, r.v) for r in SK.read_keyed_table(spark, path).collect()) == [(i, 0 if i < 50 else i) for i in range(100)]


def test_keyed_table_two_writers(spark, tmp_dir):
    path = os.path.join(tmp_dir, "two")
    SK.create_keyed_table(spark.range(10), path, "id", 2)
    number, content = SK._manifest(spark, path)
    SK.upsert_keyed_table(spark.range(20), path)
    with pytest.raises(Exception, match="(?i)exist"):             # the later of two writers from one state
        SK._publish(spark, path, number + 1, content)
    assert SK.read_keyed_table(spark, path).count() == 20


def test_keyed_table_empty_null_and_repeated_keys(spark, tmp_dir):
    path = os.path.join(tmp_dir, "odd")
    SK.create_keyed_table(spark.createDataFrame([], "id string, v int"), path, "id", 4)
    assert SK.read_keyed_table(spark, path).count() == 0
    SK.upsert_keyed_table(spark.createDataFrame([(None, 1), ("a", 1)], "id string, v int"), path)
    SK.upsert_keyed_table(spark.createDataFrame([(None, 2), ("a", 2), ("a", 3)], "id string, v int"), path)
    assert sorted(map(str, map(tuple, SK.read_keyed_table(spark, path).collect()))) == [
        "('a', 2)", "('a', 3)", "(None, 1)", "(None, 2)"]
