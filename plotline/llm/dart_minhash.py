"""Near-duplicate classes by DartMinHash signatures, banded joining and an exact check.

* Each distinct text is a weighted set of its five-word shingles (weight 1, or the number
  of times it stands there with ``weights="count"``).
* Hashed darts fall on every element's region at unit rate: along each unit of weight the
  ranks of its darts are a Poisson process drawn from the element's hash, so two texts that
  share the element share its darts.  A dart's hash names one of ``K`` coordinates; the
  earliest dart on a coordinate is its signature.  Where a text's darts up to the chosen
  rank leave a coordinate empty, the rank bound doubles.  Two texts agree on a coordinate
  with a probability of their weighted Jaccard similarity.
* ``BANDS`` bands of ``ROWS`` coordinates: texts that share a band may be linked.  A pair
  of similarity 0.8 shares none with a probability of 3e-6.
* Texts joined by shared bands, directly or through others, form a candidate group.  Within
  it every pair is checked exactly on whole shingle sets, as products of incidence matrices:
  small groups in one task each, large ones in blocks against blocks, no pairs emitted but
  the links found (a spanning forest of each block).  Classes are the components of links.

Defined results: equal texts are one class; a null text is a class of its own; a text
without five words has one shingle of all its words, one without words is equal to nothing
but the same text; the class id is the smallest doc_id of its members (null if none has
one).  Repeated rows come out once each.  An empty table gives no rows.  Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
K = BANDS * ROWS
#: A candidate group of more texts is checked in blocks of about this many.
BLOCK = 256


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row with their counts: (hash, count, ptr)."""
    w = common.words_of(texts)
    h, first = common.window_hashes(w.hash, w.ptr, SHINGLE, short=True)
    row = np.searchsorted(w.ptr, first, side="right") - 1
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h))), np.searchsorted(row[at], np.arange(len(w.ptr)))


def _exponential(h: np.ndarray) -> np.ndarray:
    return -np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53))


def dart_signatures(element: np.ndarray, weight: np.ndarray, ptr: np.ndarray, k: int = K, seed: int = 5
                    ) -> tuple[np.ndarray, np.ndarray]:
    """(rows x k) signatures of weighted sets, and which rows have any element.  Weights
    are positive; a fractional last unit of weight keeps the darts that fall within it."""
    n = len(ptr) - 1
    sig = np.zeros((n, k), dtype=np.uint64)
    if not len(element):
        return sig, np.zeros(n, dtype=bool)
    row = np.repeat(np.arange(n), np.diff(ptr))
    units = np.ceil(weight).astype(np.int64)
    row_u, el_u = np.repeat(row, units), np.repeat(element, units)
    unit = np.arange(len(row_u)) - np.repeat(np.cumsum(units) - units, units)
    room = np.minimum(1.0, np.repeat(weight.astype(float), units) - unit)
    base = common.mix64(el_u + common.mix64(unit.astype(np.uint64) + common.seeded(seed)))
    total = np.bincount(row, weight, minlength=n)
    todo = total > 0
    theta = float(k * math.log(k) + 2 * k)
    while todo.any():
        limit = np.where(todo, theta / np.where(total > 0, total, 1), 0.0)
        dart, rank, owner = [], [], []
        h, r, at = base, np.zeros(len(base)), np.arange(len(base))
        on = limit[row_u] > 0
        h, r, at = h[on], r[on], at[on]
        while len(at):  # the next dart of every unit that has not passed its row's bound
            h = common.mix64(h + np.uint64(0x9E3779B97F4A7C15))
            r = r + _exponential(h)
            inside = r <= limit[row_u[at]]
            h, r, at = h[inside], r[inside], at[inside]
            place = common.mix64(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            hit = (place >> np.uint64(11)).astype(np.float64) / float(1 << 53) < room[at]
            dart.append(place[hit])
            rank.append(r[hit])
            owner.append(row_u[at[hit]])
        dart, rank, owner = np.concatenate(dart), np.concatenate(rank), np.concatenate(owner)
        slot = owner * k + (common.mix64(dart) % np.uint64(k)).astype(np.int64)
        order = np.lexsort((dart, rank, slot))
        first = np.ones(len(order), dtype=bool)
        first[1:] = slot[order][1:] != slot[order][:-1]
        pick = order[first]
        full = np.bincount(owner[pick], minlength=n) == k
        done = full & todo
        pick = pick[done[owner[pick]]]
        sig.reshape(-1)[slot[pick]] = dart[pick]
        todo &= ~done
        theta *= 2
    return sig, total > 0


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """(rows x BANDS) hashes of each band's coordinates and number."""
    out = np.tile(np.arange(BANDS, dtype=np.uint64), (len(sig), 1))
    for j in range(ROWS):
        out = out * np.uint64(0xD6E8FEB86659FD93) + sig[:, j::ROWS][:, :BANDS]
    return common.mix64(out.reshape(-1)).reshape(out.shape)


def _sketch(weights: str):
    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for a, b in common.chunks(texts):
                h, c, ptr = shingles(texts.slice(a, b - a))
                sig, has = dart_signatures(h, c if weights == "count" else np.ones(len(h)), ptr)
                bands = band_hashes(sig).view(np.int64)[has].reshape(-1)
                offsets = np.concatenate([[0], np.cumsum(has * BANDS)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("key").slice(a, b - a),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands))], names=["doc_id", "key", "bands"])
    return run


def _sets(bitmap: bytes, weights: str):
    """Whole shingle sets (32-bit hashes and counts) of the texts whose key may be wanted."""
    def run(batches):
        for batch in batches:
            keep = common.in_filter(bitmap, batch.column("h").to_numpy().view(np.uint64))
            batch = batch.filter(pa.array(keep))
            texts = batch.column("text")
            for a, b in common.chunks(texts):
                h, c, ptr = shingles(texts.slice(a, b - a))
                c = c if weights == "count" else np.ones(len(h))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(a, b - a), common.binary_rows((h >> np.uint64(32)).astype(np.uint32), ptr),
                     common.binary_rows(np.minimum(c, 65535).astype(np.uint16), ptr)], names=["key", "els", "cnt"])
    return run


def similar_pairs(els: list[np.ndarray], cnt: list[np.ndarray], threshold: float, rows: np.ndarray | None = None
                  ) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of weighted Jaccard similarity >= threshold, exactly.  Only
    elements that two texts share can add to an intersection, so the incidence matrix
    has just their columns; counts are levels (element, 1), (element, 2), ...
    ``rows``: only pairs with one of these texts."""
    n = len(els)
    size = np.array([c.sum() for c in cnt], dtype=float)
    owner = np.repeat(np.arange(n), [len(e) for e in els])
    e, c = np.concatenate(els).astype(np.uint64), np.concatenate(cnt).astype(np.int64)
    if c.max(initial=1) > 1:  # unary levels: the sum of minima is a plain intersection
        level = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        e, owner = (np.repeat(e, c) << np.uint64(16)) + level.astype(np.uint64), np.repeat(owner, c)
    _, col, times = np.unique(e, return_inverse=True, return_counts=True)
    shared = times[col] > 1
    col, owner = col[shared], owner[shared]
    _, col = np.unique(col, return_inverse=True)
    inter = np.zeros((n, n), dtype=np.float32)
    width = 1 << 14
    for a in range(0, int(col.max(initial=-1)) + 1, width):  # bounded memory for any group
        part = (col >= a) & (col < a + width)
        m = np.zeros((n, min(width, int(col.max()) + 1 - a)), dtype=np.float32)
        m[owner[part], col[part] - a] = 1
        inter += m @ m.T
    hit = inter >= threshold * (size[:, None] + size[None, :] - inter) - 1e-6
    hit &= inter > 0
    i, j = np.nonzero(np.triu(hit, 1))
    return i, j


def forest(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A spanning forest of the links, as (a, b) rows of node ids."""
    parent = np.arange(len(nodes))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((nodes[a], nodes[b]))
    return np.array(out, dtype=np.int64).reshape(-1, 2)


def _link(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node")
        els = [np.frombuffer(x, np.uint32) for x in pdf["els"]]
        cnt = [np.frombuffer(x, np.uint16) for x in pdf["cnt"]]
        nodes = pdf["node"].to_numpy(np.int64)
        i, j = similar_pairs(els, cnt, threshold)
        return pd.DataFrame(forest(nodes, i, j), columns=["a", "b"])
    return run


def near_duplicate_classes(docs: DataFrame, threshold: float = SIMILARITY, weights: str = "set") -> DataFrame:
    """``doc_id``, ``key`` (md5 of the text, null for a null text) and ``class_id`` of
    every row.  Bands, links and components stay distributed; the driver gets counts and
    a 2 MB filter."""
    text_key = F.unhex(F.md5("text"))
    rows = docs.select(common.col("doc_id"), common.col("text"))
    sketched = common.checkpointed(
        rows.where("text is not null").select("doc_id", "text", text_key.alias("key"))
        .mapInArrow(_sketch(weights), "doc_id long, key binary, bands array<long>"))
    # a node for each distinct text; checkpointed, so that the ids stay as they are
    nodes = common.checkpointed(
        sketched.groupBy("key").agg(F.min("doc_id").alias("first"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()))
    banded = nodes.select("node", F.explode("bands").alias("band"))
    lead = banded.groupBy("band").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = banded.join(lead.select("band", "b"), "band").select(F.col("node").alias("a"), "b").where("a <> b")
    groups = common.checkpointed(common.components(shared).withColumnRenamed("component", "grp"))
    wanted = common.checkpointed(groups.join(nodes.select("node", "key"), "node"))
    # the first 8 bytes of the key, in the byte order that numpy reads
    h = F.conv(F.substring(F.md5("text"), 1, 16), 16, -10).cast("long")
    bitmap = common.filter_bitmap(wanted.select(F.conv(F.substring(F.lower(F.hex("key")), 1, 16), 16, -10).cast("long").alias("h")), "h")
    sets = rows.where("text is not null").select("text", text_key.alias("key"), h.alias("h")) \
        .mapInArrow(_sets(bitmap, weights), "key binary, els binary, cnt binary")
    sets = sets.groupBy("key").agg(F.first("els").alias("els"), F.first("cnt").alias("cnt"))
    size = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    placed = wanted.join(size, "grp").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    member = common.checkpointed(placed.join(sets, "key").select("node", "grp", "blocks", "els", "cnt"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # blocks i <= j of a group meet in one task: a text goes to every pair with its block
    pairs = member.withColumn("blk", block).select(
        "node", "grp", "els", "cnt", F.explode(F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda x: F.struct(F.least(x, "blk").alias("i"), F.greatest(x, "blk").alias("j")))).alias("at"))
    links = pairs.groupBy("grp", "at").applyInPandas(_link(threshold), "a long, b long")
    classes = common.components(links)
    named = nodes.select("node", "key", "first").join(classes, "node", "left") \
        .withColumn("component", F.coalesce("component", "node"))
    name = named.groupBy("component").agg(F.min("first").alias("class_id"))
    of_key = named.join(name, "component").select("key", "class_id")
    out = sketched.select("doc_id", "key").join(of_key, "key").select("doc_id", "key", "class_id")
    return out.union(rows.where("text is null").select(
        "doc_id", F.lit(None).cast("binary"), F.col("doc_id")))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the row with its class id (the
    smallest doc_id); null texts and classes without any id stay whole."""
    classes = near_duplicate_classes(docs, **options)
    first = classes.where("doc_id = class_id or class_id is null").select("doc_id", "key")
    return common.rows_with(docs, first, F.unhex(F.md5(docs["text"])), "left_semi")


def op9(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(common.documents(spark, sf_dir)).select("doc_id", "class_id")
