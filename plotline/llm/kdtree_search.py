"""Exact top-k inner-product search with one KD-tree per shard of the vectors.

Each shard (a bounded number of vectors, dealt by a hash of their id) builds a tree by
median splits along its widest side, with tight bounding boxes.  A block of queries goes
down the tree; a node is dropped where the box cannot hold a score above the query's kth
best so far.  The leaves left are visited in order of their bounds, best first, and each
visit may raise the kth score.  Every query first searches one home shard; the kth score
it finds there is carried to all others, which prune with it from the start.

Ties go to the smaller id: a box whose bound equals the kth score is visited only if it
holds a smaller id than the kth's.

Defined results: vectors that are null or hold null or non-finite components take no
part, nor do rows without an id; components so large that a score could leave the range of
a long raise an error; vectors of different lengths do not meet; rows of one id
count once (the smallest vector in array order); an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARD_ROWS = 8192
QUERY_ROWS = 1024
LEAF_ROWS = 256
TOP = 20

INDEX = "dim int, shard int, ids binary, vectors binary, left binary, right binary, leaf binary, low binary, high binary, least binary"


def build_tree(ids: np.ndarray, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS) -> dict[str, np.ndarray]:
    """Nodes as arrays: children (-1: leaf), row range of leaves, box, smallest id.  Rows
    are returned in leaf order."""
    order = np.arange(len(ids))
    left, right, span = [], [], []
    todo = [(0, len(ids), -1, 0)]
    while todo:
        a, b, parent, side = todo.pop()
        me = len(left)
        left.append(-1)
        right.append(-1)
        span.append((a, b))
        if parent >= 0:
            (left if side == 0 else right)[parent] = me
        if b - a <= leaf_rows:
            continue
        part = vectors[order[a:b]]
        axis = int(np.argmax(part.max(0) - part.min(0))) if part.shape[1] else 0
        mid = (b - a) // 2
        key = part[:, axis] if part.shape[1] else np.zeros(b - a)
        order[a:b] = order[a:b][np.argpartition(key, mid)]
        todo += [(a, a + mid, me, 0), (a + mid, b, me, 1)]
    ids, vectors = ids[order], vectors[order]
    low = np.array([vectors[a:b].min(0) for a, b in span])
    high = np.array([vectors[a:b].max(0) for a, b in span])
    least = np.array([ids[a:b].min() for a, b in span], dtype=np.int64)
    return {"ids": ids, "vectors": vectors, "left": np.array(left, np.int64), "right": np.array(right, np.int64),
            "leaf": np.array(span, np.int64), "low": low, "high": high, "least": least}


def search_tree(tree: dict[str, np.ndarray], q_ids: np.ndarray, q: np.ndarray, kth: np.ndarray,
                kth_id: np.ndarray, k: int, products: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores (-1 id: none) of the k best rows of each query that beat its given
    (kth, kth_id); float64 holds the integer scores exactly up to 2**53, else int64.
    ``products[0]`` is raised by the number of inner products computed."""
    products = [0] if products is None else products
    limit = max([1.0, *(float(np.abs(x.astype(np.float64)).max()) for x in (q, tree["vectors"]) if x.size)])
    if limit * limit * max(1, q.shape[1]) >= 2.0 ** 63:
        raise ValueError("components are so large that scores may leave the range of a long")
    exact = limit * limit * max(1, q.shape[1]) < 2 ** 53
    kind = np.float64 if exact else np.int64
    vec, q = tree["vectors"].astype(kind), q.astype(kind)
    none = kind(-np.inf) if exact else np.iinfo(np.int64).min
    last = np.iinfo(np.int64).max
    top_s = np.full((len(q), k), none, dtype=kind)
    top_i = np.full((len(q), k), last, dtype=np.int64)
    kth, kth_id = kth.astype(np.float64), kth_id.copy()
    up, down = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
    low, high = tree["low"].astype(np.float64), tree["high"].astype(np.float64)
    slack = 0.0 if exact else 1e-6

    def bound(qi: np.ndarray, node: int) -> np.ndarray:
        b = up[qi] @ high[node] + down[qi] @ low[node]
        return b + slack * np.abs(b) if slack else b

    def alive(qi: np.ndarray, b: np.ndarray, node: int) -> np.ndarray:
        return (b > kth[qi]) | ((b == kth[qi]) & (tree["least"][node] < kth_id[qi]))

    def merge(qi: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Put candidates (``row`` ascending, into ``qi``) to their queries' best ones."""
        touched, first, count = np.unique(row, return_index=True, return_counts=True)
        who = qi[touched]
        all_s = np.full((len(who), k + int(count.max())), none, dtype=kind)
        all_i = np.full(all_s.shape, last, dtype=np.int64)
        all_s[:, :k], all_i[:, :k] = top_s[who], top_i[who]
        at = (np.repeat(np.arange(len(who)), count), k + np.arange(len(row)) - np.repeat(first, count))
        all_s[at], all_i[at] = score, ids
        pick = np.lexsort((all_i, -all_s if exact else ~all_s), axis=-1)[:, :k]
        top_s[who] = np.take_along_axis(all_s, pick, 1)
        top_i[who] = np.take_along_axis(all_i, pick, 1)
        worst, worst_id = top_s[who, -1].astype(np.float64), top_i[who, -1]
        up_now = (worst_id != last) & ((worst > kth[who]) | ((worst == kth[who]) & (worst_id < kth_id[who])))
        kth[who[up_now]], kth_id[who[up_now]] = worst[up_now], worst_id[up_now]

    def visit(node: int, qi: np.ndarray) -> None:
        """Score a leaf for its queries; only rows that beat a query's kth are sorted."""
        s, e = tree["leaf"][node]
        score, ids = q[qi] @ vec[s:e].T, tree["ids"][s:e]
        floor = kth[qi]
        if e - s > k:   # k rows of the leaf itself are a bound, too (one more, as one may be the query's own)
            floor = np.maximum(floor, np.partition(score, e - s - k - 1, axis=1)[:, e - s - k - 1].astype(np.float64))
        row, col = np.nonzero(score >= floor[:, None])
        value, found = score[row, col], ids[col]
        better = (found != q_ids[qi[row]]) & ((value > kth[qi[row]]) | ((value == kth[qi[row]]) & (found < kth_id[qi[row]])))
        if better.any():
            merge(qi, row[better], value[better], found[better])
        products[0] += score.size

    leaves: list[tuple[np.ndarray, np.ndarray, int]] = []
    stack = [(0, np.arange(len(q)))]
    while stack:  # downwards, one node for all queries that it may still serve
        node, qi = stack.pop()
        b = bound(qi, node)
        on = alive(qi, b, node)
        qi, b = qi[on], b[on]
        if not len(qi):
            continue
        if tree["left"][node] < 0:
            leaves.append((qi, b, node))
        else:
            stack += [(int(tree["left"][node]), qi), (int(tree["right"][node]), qi)]
    if leaves:
        who = np.concatenate([x[0] for x in leaves])
        bnd = np.concatenate([x[1] for x in leaves])
        where = np.concatenate([np.full(len(x[0]), x[2]) for x in leaves])
        order = np.lexsort((-bnd, who))
        who, bnd, where = who[order], bnd[order], where[order]
        start = np.searchsorted(who, np.arange(len(q) + 1))
        at = start[:-1].copy()
        active = np.flatnonzero(at < start[1:])
        while len(active):  # best first: each active query visits its next leaf
            b, node = bnd[at[active]], where[at[active]]
            better = (b > kth[active]) | (b == kth[active])
            active, node, b = active[better], node[better], b[better]
            now = np.flatnonzero((b > kth[active]) | (tree["least"][node] < kth_id[active]))
            now = now[np.argsort(node[now], kind="stable")]
            for part in np.split(now, np.flatnonzero(np.diff(node[now])) + 1):
                if len(part):
                    visit(int(node[part[0]]), active[part])
            at[active] += 1
            active = active[at[active] < start[active + 1]]
    top_i[top_i == last] = -1
    return top_i, np.where(top_i < 0, 0, top_s).astype(np.int64)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    vectors = np.array(pdf["v"].tolist(), dtype=np.int64).reshape(len(pdf), int(pdf["dim"].iloc[0]))
    tree = build_tree(pdf["vec_id"].to_numpy(np.int64), vectors)
    return pd.DataFrame([{"dim": int(pdf["dim"].iloc[0]), "shard": int(pdf["shard"].iloc[0])}
                         | {k: np.ascontiguousarray(x).tobytes() for k, x in tree.items()}])


def _search(k: int):
    def run(shard: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        row, dim = shard.iloc[0], int(shard["dim"].iloc[0])
        tree = {c: np.frombuffer(row[c], dtype=np.int64) for c in ("ids", "left", "right", "least")}
        tree["leaf"] = np.frombuffer(row["leaf"], dtype=np.int64).reshape(-1, 2)
        for c in ("vectors", "low", "high"):
            n = len(tree["ids"]) if c == "vectors" else len(tree["left"])
            tree[c] = np.frombuffer(row[c], dtype=np.int64).reshape(n, dim)
        ids = queries["vec_id"].to_numpy(np.int64)
        q = np.array(queries["v"].tolist(), dtype=np.int64).reshape(len(ids), dim)
        kth = queries["kth"].to_numpy(np.float64)
        kth_id = queries["kth_id"].to_numpy(np.int64)
        got, score = search_tree(tree, ids, q, kth, kth_id, k)
        at, pos = np.nonzero(got >= 0) if len(got) else (np.zeros(0, int), np.zeros(0, int))
        return pd.DataFrame({"query_id": ids[at], "vec_id": got[at, pos], "score": score[at, pos]})
    return run


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP, shard_rows: int = SHARD_ROWS,
          query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each
    query with all vectors but its own.  Both tables: ``vec_id`` long (unique, not null)
    and ``v`` array<long>.  A task holds one shard's tree and one block of queries."""
    vectors = vectors.select("vec_id", "v", F.size("v").alias("dim"))
    shards = max(1, math.ceil(vectors.count() / shard_rows))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    index = common.checkpointed(dealt.groupBy("dim", "shard").applyInPandas(_build, INDEX))
    queries = queries.select("vec_id", "v", F.size("v").alias("dim"))
    blocks = max(1, math.ceil(queries.count() / query_rows))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)).cast("int"))
    home = F.pmod("block", F.lit(shards))

    def meet(q: DataFrame, at: DataFrame) -> DataFrame:
        keys = ["dim", "shard", "block"]
        return at.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInPandas(
            _search(k), "query_id long, vec_id long, score long")

    every = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    low, last = F.lit(float("-inf")), F.lit(int(np.iinfo(np.int64).max))
    no_kth = queries.withColumns({"kth": low, "kth_id": last})
    first = common.checkpointed(meet(no_kth.withColumn("shard", home), every.where(F.col("shard") == home)))
    if shards == 1:
        hits = first
    else:
        kth = _best(first, k).where(F.col("rank") == k).select(
            F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("kth"),
            F.col("vec_id").alias("kth_id"))
        rest = queries.join(kth, "vec_id", "left").withColumns(
            {"kth": F.coalesce("kth", low), "kth_id": F.coalesce("kth_id", last)}).withColumn(
            "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where(F.col("shard") != home)
        hits = first.union(meet(rest, every.where(F.col("shard") != home)))
    return _best(hits, k).select("query_id", "rank", "vec_id", "score")


def quantised(embeddings: DataFrame) -> DataFrame:
    """``vec_id`` and ``v`` = floor(64 x) of each component; one row per id."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return embeddings.where(F.col("vec_id").isNotNull() & e.isNotNull() & ~bad).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(e, lambda x: F.floor(64 * x.cast("double"))).alias("v")) \
        .groupBy("vec_id").agg(F.min("v").alias("v"))


def op8(spark, sf_dir: str) -> DataFrame:
    rows = common.checkpointed(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    return top_k(rows, rows.where("vec_id % 20 = 0"))


OP8_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
