"""Sinks: headered CSV, Parquet upsert, fitted pipelines.

A keyed table is a folder of Parquet parts, a row's part being a hash of its key, and
numbered manifests that name the folder of every part.  An upsert reads and writes only
the parts its keys fall into; the next manifest, renamed into place, makes it seen.  Until
then, and if the job dies, readers see the old table whole.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plotline.operators.sessions import upsert


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """Headered CSV; with ``partition_by``, a folder for each value of these columns."""
    df.write.mode(mode).option("header", True).partitionBy(*partition_by).csv(path)


def upsert_parquet(spark, new: DataFrame, table_path: str, out_path: str, key: str = "id") -> DataFrame:
    """Insert-or-replace ``new`` into the Parquet table at ``table_path``, written to a
    fresh ``out_path`` (never overwriting the path being read).  The caller swaps the
    table pointer to ``out_path`` after the write succeeds.  A failed or lost executor
    re-runs its task; the old table stays intact until the swap."""
    old = spark.read.parquet(table_path)
    merged = upsert(old, new, key)
    merged.write.mode("errorifexists").parquet(out_path)
    return spark.read.parquet(out_path)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration())


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of the newest manifest (0 and nothing: no table)."""
    fs, folder = _file_system(spark, path), spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    done = sorted(n for n in names if n.endswith(".json") and not n.startswith("."))
    if not done:
        return 0, {}
    text = spark.read.text(f"{path}/manifest/{done[-1]}", wholetext=True).first()[0]
    return int(done[-1].split(".")[0]), json.loads(text)


def _publish(spark: SparkSession, path: str, number: int, content: dict) -> None:
    """Write the manifest beside its place and rename it; a manifest of that number written
    by another job meanwhile makes this fail."""
    jvm = spark._jvm
    fs = _file_system(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps(content), "utf-8"))
    finally:
        out.close()
    final = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/{number:012d}.json")
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    files.rename(draft, final, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))


def _part(key: str, parts: int):
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def _write_parts(df: DataFrame, path: str, key: str, parts: int) -> str:
    """Rows by part below a new folder, which is returned; a part of many rows goes to
    several tasks."""
    folder = f"data/{uuid.uuid4().hex}"
    df.withColumn("_part", _part(key, parts)).hint("rebalance", "_part") \
        .write.mode("errorifexists").partitionBy("_part").parquet(f"{path}/{folder}")
    return folder


def create_keyed_table(df: DataFrame, path: str, key: str = "id", parts: int = 64) -> None:
    """A keyed table of ``df`` in a new folder; an existing table there is an error."""
    spark = df.sparkSession
    if _manifest(spark, path)[0]:
        raise ValueError(f"there is a table at {path}")
    folder = _write_parts(df, path, key, parts)
    held = {str(p): f"{folder}/_part={p}" for (p,) in
            spark.read.parquet(f"{path}/{folder}").select("_part").distinct().collect()} if not df.isEmpty() else {}
    _publish(spark, path, 1, {"key": key, "parts": parts, "schema": df.schema.json(), "folders": held})


def read_keyed_table(spark: SparkSession, path: str, only: set[int] | None = None) -> DataFrame:
    """The table as the newest manifest has it; ``only``: some of its parts."""
    number, m = _manifest(spark, path)
    if not number:
        raise ValueError(f"no table at {path}")
    schema = StructType.fromJson(json.loads(m["schema"]))
    folders = [f"{path}/{f}" for p, f in sorted(m["folders"].items()) if only is None or int(p) in only]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upsert_keyed_table(new: DataFrame, path: str) -> list[int]:
    """Insert or replace the rows of ``new`` by key and return the parts written.  ``new``
    has the table's columns; all rows of a repeated key go in, and a null key replaces
    nothing, as in ``upsert``.  What reaches the driver is the list of parts."""
    spark = new.sparkSession
    number, m = _manifest(spark, path)
    if not number:
        raise ValueError(f"no table at {path}")
    key, parts = m["key"], m["parts"]
    new = new.select(*StructType.fromJson(json.loads(m["schema"])).fieldNames())
    touched = sorted(p for (p,) in new.select(_part(key, parts)).distinct().collect())
    if not touched:
        return []
    folder = _write_parts(upsert(read_keyed_table(spark, path, set(touched)), new, key), path, key, parts)
    _publish(spark, path, number + 1, m | {"folders": m["folders"] | {str(p): f"{folder}/_part={p}" for p in touched}})
    return touched


def scenario_records(df: DataFrame) -> DataFrame:
    """Projection rows with ISO date text, as served."""
    return df.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)
