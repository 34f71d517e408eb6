"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows are dealt into blocks by a hash of their content.  How many rows each block sends
to each shard is drawn exactly (multivariate hypergeometric, given the block and shard
sizes), so the matrix is distributed as that of a uniform permutation.  Each block then
permutes its rows and cuts them by its row of the matrix; after the exchange the rows of
each shard are permuted again, which gives them gapless slots.

Only DataFrame functions touch rows.  The driver holds the matrix alone:
``blocks x shards`` integers, whatever the number of rows.

Defined results: an empty table gives no rows; nulls in any column are values like any
other; rows equal in every column are interchangeable (and share a block); equal texts are
rows like any other and are not kept together, as a uniform shuffle of exact shard sizes
leaves no room for it (a group of a third of the rows is larger than a shard); an input column named like an
output (``shard``, ``slot``) is replaced; map columns take part through their JSON form.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Rows a block holds at most on average; more rows make more blocks.
BLOCK_ROWS = 200_000
#: Blocks there are at least; with the row count they alone fix the number of blocks.
LEAST_BLOCKS = 64


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Exact draw: good items among ``n`` taken from ``good + bad``.  Beyond the range of
    numpy's sampler the distribution is built outwards from its mode by the ratios of
    neighbours, to 12 standard deviations (what lies beyond is below a double's rounding),
    and normalised by its own sum."""
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    total = good + bad
    if total < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(n, good)
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    reach = 12 + int(12 * math.sqrt(n * (good / total) * (bad / total) * ((total - n) / (total - 1))))
    up = np.arange(mode, min(high, mode + reach), dtype=float)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=float)
    right = np.cumprod((good - up) * (n - up) / ((up + 1) * (bad - n + up + 1)))
    left = np.cumprod(down * (bad - n + down) / ((good - down + 1) * (n - down + 1)))
    weights = np.cumsum(np.concatenate([left[::-1], [1.0], right]))
    return mode - len(left) + int(np.searchsorted(weights[:-1], rng.random() * weights[-1], side="right"))


def communication_matrix(block_rows: list[int], shard_rows: list[int], seed: int) -> list[list[int]]:
    """Rows of block i for shard j; row sums and column sums are the given sizes."""
    if sum(block_rows) != sum(shard_rows):
        raise ValueError("blocks and shards must hold equally many rows")
    rng = np.random.default_rng(seed)
    left = list(shard_rows)
    rest = sum(left)
    out = []
    for n in block_rows:
        row, take, pool = [], n, rest
        for size in left:
            got = hypergeometric(rng, size, pool - size, take)
            row.append(got)
            take -= got
            pool -= size
        left = [a - b for a, b in zip(left, row, strict=True)]
        rest -= n
        out.append(row)
    return out


def _table(spark, rows: list[dict], schema: str) -> DataFrame:
    """A driver-made table as a literal (no Python rows in the plan)."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def uniform_shards(df: DataFrame, n_shards: int = 8, seed: int = 20_240, blocks: int | None = None) -> DataFrame:
    """``df`` with ``shard`` (0 to n_shards - 1, sizes at most one apart) and ``slot``
    (gapless from 0 in each shard): one draw of a uniform shuffle, fixed by ``seed`` and
    the rows, however they are partitioned and whatever the session's settings.

    Two shuffles of the rows given; so hand in the columns wanted, not whole texts, and
    join the placement back where the payload is large.  The matrix and the offsets
    (``blocks`` rows each) are broadcast: blocks grow by one for ``BLOCK_ROWS`` rows.
    """
    spark = df.sparkSession
    names = [c for c in df.columns if c not in ("shard", "slot")]
    values = [F.to_json(common.col(f.name)) if isinstance(f.dataType, T.MapType) else common.col(f.name)
              for f in df.schema.fields if f.name in names]

    def rnd(step: int):
        # the position of each null takes part too: xxhash64 skips nulls
        nulls = F.concat(F.lit("n"), *[v.isNull().cast("string") for v in values])
        return F.xxhash64(F.lit(seed * 10 + step), nulls, *values)

    if blocks is None:
        blocks = max(LEAST_BLOCKS, math.ceil(df.count() / BLOCK_ROWS))
    parts = math.ceil(blocks / n_shards)
    rows = df.select(F.struct(*[common.col(c) for c in names]).alias("row"),
                     F.pmod(rnd(1), F.lit(blocks)).alias("block"), rnd(2).alias("first"),
                     F.pmod(rnd(3), F.lit(parts)).alias("part"), rnd(4).alias("second"))
    sizes = sorted((r.block, r.n) for r in rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect())
    total = sum(n for _, n in sizes)
    shard_rows = [total // n_shards + (j < total % n_shards) for j in range(n_shards)]
    matrix = communication_matrix([n for _, n in sizes], shard_rows, seed)
    bounds = _table(spark, [{"block": b, "upto": np.cumsum(row).tolist()}
                            for (b, _), row in zip(sizes, matrix, strict=True)],
                    "block:bigint,upto:array<bigint>")
    local = F.row_number().over(Window.partitionBy("block").orderBy("first", "second")).cast("bigint")
    dealt = rows.withColumn("at", local).join(F.broadcast(bounds), "block").select(
        "row", "part", "second", "first",
        F.size(F.filter("upto", lambda x: x < F.col("at"))).alias("shard"))
    dealt = common.checkpointed(dealt)
    offsets, seen = [], [0] * n_shards
    for s, p, n in sorted(tuple(r) for r in dealt.groupBy("shard", "part").agg(F.count(F.lit(1))).collect()):
        offsets.append({"shard": s, "part": p, "base": seen[s]})
        seen[s] += n
    base = _table(spark, offsets, "shard:int,part:bigint,base:bigint")
    again = F.row_number().over(Window.partitionBy("shard", "part").orderBy("second", "first"))
    out = dealt.withColumn("at", again).join(F.broadcast(base), ["shard", "part"])
    return out.select("row.*", "shard", (F.col("base") + F.col("at") - 1).alias("slot"))


def op3(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"),
                       F.crc32(text).alias("text_crc32"))
    return uniform_shards(rows, 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
