"""Helpers shared by the operators of this subpackage: hashed words of Arrow text
batches, 64-bit mixing, reliable checkpoints, connected components, fixed-size filters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline.session import ensure_checkpoint_dir

#: Bytes of text that one vectorised step works on (a longer single text is one step).
CHUNK_BYTES = 2_000_000
MASK = 0xFFFFFFFFFFFFFFFF


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def col(name: str):
    """Column by its exact name, whatever characters the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name in taken:
        name = "_" + name
    return name


def rows_with(docs: DataFrame, keys: DataFrame, mark, how: str) -> DataFrame:
    """Semi or anti join of ``docs`` with ``keys`` (an id and a mark of the text; null is
    equal to null), ``mark`` being the same of ``docs``."""
    a, b = fresh(docs, "id"), fresh(docs, "mark")
    keys = keys.toDF(a, b).distinct()
    return docs.join(keys, docs["doc_id"].eqNullSafe(keys[a]) & mark.eqNullSafe(keys[b]), how)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder that ``spark.checkpoint.dir`` names."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- hashing in numpy

def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64 constants), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(seed: int) -> np.uint64:
    return mix64(np.array([(seed * 0x9E3779B97F4A7C15 + 1) & MASK], dtype=np.uint64))[0]


def segment_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each byte segment ``data[start:end]`` (equal bytes,
    equal hash, wherever the segment stands)."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    length = end - start
    out = np.zeros(len(start), dtype=np.uint64)
    full = np.flatnonzero(length > 0)
    if len(full):
        s, e = start[full], end[full]
        # a byte counts with the multiplier to the power of its place; dividing by the
        # power of the segment's start makes equal segments equal
        mult = np.uint64(0x9FB21C651E98DF25)
        lo, hi = int(s.min()), int(e.max())
        power = np.ones(hi - lo, dtype=np.uint64)
        power[1:] = mult
        np.multiply.accumulate(power, out=power)
        value = (data[lo:hi].astype(np.uint64) + np.uint64(1)) * power
        total = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(value)])
        part = total[e - lo] - total[s - lo]
        inverse = np.uint64(pow(int(mult), -1, 1 << 64))
        back = np.ones(hi - lo, dtype=np.uint64)
        back[1:] = inverse
        np.multiply.accumulate(back, out=back)
        out[full] = part * back[s - lo]
    return mix64(out ^ (length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SOLID_BYTE = np.ones(256, dtype=bool)
_SOLID_BYTE[[9, 10, 11, 12, 13, 32]] = False


@dataclass
class Words:
    """Words of a batch of texts: ``hash``, byte ``start``/``end`` in ``data``, and
    ``ptr``: the words of row i are ``ptr[i]:ptr[i + 1]``; its bytes ``at[i]:at[i + 1]``."""

    data: np.ndarray
    at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray
    hash: np.ndarray

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and their offsets (null: no bytes)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]: at[-1]], at - at[0]


def runs(flag: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row pointer of the maximal runs of set flags within each row."""
    before = np.zeros(len(flag) + 1, dtype=bool)
    before[1:] = flag
    cut = at[:-1][at[:-1] < len(flag)]
    before[cut] = False
    start = np.flatnonzero(flag & ~before[:-1])
    after = np.zeros(len(flag) + 1, dtype=bool)
    after[:-1] = flag
    after[at[1:]] = False
    end = np.flatnonzero(flag & ~after[1:]) + 1
    return start, end, np.searchsorted(start, at)


def words_of(texts: pa.Array, marks: bool = False) -> Words:
    """Words are maximal runs of ASCII letters and digits and of non-ASCII characters,
    compared in lower case; with ``marks``, runs of other visible characters too."""
    data, at = text_bytes(pc.utf8_lower(texts))
    start, end, ptr = runs(_WORD_BYTE[data], at)
    if marks:
        start2, end2, _ = runs(_SOLID_BYTE[data] & ~_WORD_BYTE[data], at)
        start, end = np.sort(np.concatenate([start, start2])), np.sort(np.concatenate([end, end2]))
        ptr = np.searchsorted(start, at)
    return Words(data, at, start, end, ptr, segment_hashes(data, start, end))


def solid_runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes that are not ASCII white space, by row."""
    return runs(_SOLID_BYTE[data], at)


def window_hashes(h: np.ndarray, ptr: np.ndarray, n: int, short: bool = False
                  ) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``n`` entries within a row, and the index of its first
    entry.  ``short``: a row with fewer (but some) entries gives one window of all."""
    size = np.diff(ptr)
    rows = np.flatnonzero(size >= n)
    count = size[rows] - n + 1
    first = np.repeat(ptr[rows] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) \
        + np.arange(count.sum()) if len(rows) else np.zeros(0, dtype=np.int64)
    out = np.zeros(len(first), dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[first + k]
    out = mix64(out)
    if short:
        few = np.flatnonzero((size > 0) & (size < n))
        extra = np.zeros(len(few), dtype=np.uint64)
        for k in range(n - 1):
            on = size[few] > k
            extra[on] = extra[on] * np.uint64(0xD6E8FEB86659FD93) + h[ptr[few[on]] + k]
        out = np.concatenate([out, mix64(extra + np.uint64(0x51ED2701))])
        first = np.concatenate([first, ptr[few]])
        order = np.argsort(first, kind="stable")
        out, first = out[order], first[order]
    return out, first


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text; at least one row each."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    total, begin = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > begin and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(size):
        yield begin, len(size)


def binary_rows(values: np.ndarray, ptr: np.ndarray) -> pa.Array:
    """One binary value for each row: the bytes of ``values[ptr[i]:ptr[i + 1]]``."""
    raw = np.ascontiguousarray(values)
    offsets = (np.asarray(ptr, dtype=np.int64) * raw.itemsize)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(ptr) - 1, [None, pa.py_buffer(offsets.tobytes()),
                                          pa.py_buffer(raw.tobytes())]).cast(pa.binary())


# ---------------------------------------------------------------- fixed-size filter

FILTER_BITS = 1 << 24


def filter_bitmap(hashes: DataFrame, column: str) -> bytes:
    """A bitmap of 2**24 bits (2 MB, whatever the input) with the bit of each hash set:
    two bits a value, so a test passes every member and few others.  Whoever uses it
    follows with an exact join."""
    bits = hashes.select(F.explode(F.array(
        F.col(column).bitwiseAND(F.lit(FILTER_BITS - 1)),
        F.shiftrightunsigned(F.col(column), 32).bitwiseAND(F.lit(FILTER_BITS - 1)))).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 5).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 as int))")).alias("m")).collect()
    out = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    for w, m in words:
        out[w] = m
    return out.tobytes()


def in_filter(bitmap: bytes, h: np.ndarray) -> np.ndarray:
    words = np.frombuffer(bitmap, dtype=np.uint32)
    h = h.astype(np.uint64, copy=False)
    low, high = np.uint64(FILTER_BITS - 1), np.uint64(32)
    ok = np.ones(len(h), dtype=bool)
    for bit in ((h & low).astype(np.int64), ((h >> high) & low).astype(np.int64)):
        ok &= (words[bit >> 5] >> (bit & 31).astype(np.uint32)) & np.uint32(1) == 1
    return ok


# ---------------------------------------------------------------- connected components

def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (long columns a, b): component is
    the smallest node that a path reaches.  Alternating large-star / small-star steps;
    every step is a grouped minimum (map-side combined) and an equi-join that adaptive
    execution may split at a hub, so neither hubs nor long chains meet in one task."""
    ensure_checkpoint_dir(edges.sparkSession)
    cur = checkpointed(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.min("b").alias("m")) \
                .select("a", F.least("a", "m").alias("m"))
            out = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            low = e.groupBy("a").agg(F.min("b").alias("m"))
            out = e.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")) \
                .union(low.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def print_of(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = print_of(cur)
    while seen[0]:
        cur = checkpointed(star(star(cur, True), False))
        now = print_of(cur)
        if now == seen:
            break
        seen = now
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        cur.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
