"""Exact ranked lexical search: range-maximum sparse tables per posting list, best-first
document intervals.

Documents become index shards where they lie (at most SHARD_DOCS documents of one
partition, sorted by id; no text is shuffled).  A shard holds, for each term that some
item asks for, its posting list.  Over a list's impacts a sparse table gives the largest
impact of any document range with two look-ups, so the sum of these maxima over an item's
terms bounds every document of an interval.  The interval of the highest bound is split at
its document of the largest single impact; that document is scored exactly, both halves
are bounded anew, and the search ends when no bound reaches the k-th score.  A sixteenth
of the shards is searched first; the k-th score found there holds for all others.

Score: terms are maximal runs of ASCII letters and digits and of non-ASCII characters,
only A-Z lower-cased.  N documents hold a term, L terms stand in all of them, n in one;
df documents hold a given term, tf times in one.  ``w = floor(1000 ln((2N+2)/(2df+1)))``,
``m = 75 + (25 n N) div L``; a document scores ``w * ((10**9 tf) div (1000 tf + 12 m))``
summed over the item's terms, repeats included.

Terms are compared by 64-bit hash.  Items go in blocks of about BLOCK_TERMS terms (an
item is never split), so what is sent to the tasks is bounded whatever the items' number.

Defined results: null texts and texts without a term hold none and count for nothing;
documents without an id count in the statistics and are not ranked; repeated rows are
documents of their own; equal scores go by ascending id; items without an id are left out,
of several rows of one item the least text counts, items without a term and scores of 0
give no rows; either table empty gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARD_BITS = 12
SHARD_DOCS = 1 << SHARD_BITS
#: Kept term occurrences after which a shard is closed (a document is never split).
SHARD_TERMS = 4_000_000
BLOCK_TERMS = 200_000
FIRST_OF = 16
TOP = 20
#: Intervals split at once.
BATCH = 48

SHARDS = "part long, docs long, terms long, ids binary, known binary, sizes binary, hashes binary, ptr binary, doc binary, tf binary"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every term of the texts, and the pointer of each text's first one."""
    data, at = common.text_bytes(texts)
    data = _LOWER[data]
    start, end, ptr = common.runs(common._WORD_BYTE[data], at)
    return common.segment_hashes(data, start, end), ptr


def _shard(parts: list[tuple]) -> dict[str, list]:
    ids = np.concatenate([p[0] for p in parts])
    known = np.concatenate([p[1] for p in parts])
    size = np.concatenate([p[2] for p in parts])
    base = np.cumsum([0] + [len(p[0]) for p in parts[:-1]])
    row = np.concatenate([p[3] + b for p, b in zip(parts, base)])
    h = np.concatenate([p[4] for p in parts])
    order = np.lexsort((ids, ~known))
    place = np.empty(len(ids), dtype=np.int64)
    place[order] = np.arange(len(ids))
    row = place[row]
    hashes, term = np.unique(h, return_inverse=True)
    key, tf = np.unique(term.astype(np.int64) * SHARD_DOCS + row, return_counts=True)
    ptr = np.searchsorted(key, np.arange(len(hashes) + 1, dtype=np.int64) * SHARD_DOCS)
    ids, known, size = ids[order], known[order], size[order]
    tag = common.mix64(np.concatenate([ids, size]).astype(np.uint64) + np.arange(2 * len(ids), dtype=np.uint64))
    part = int(np.bitwise_xor.reduce(tag).astype(np.int64))
    return {"part": [part], "docs": [len(ids)], "terms": [int(size.sum())]} | {
        c: [np.ascontiguousarray(v).tobytes()] for c, v in (
            ("ids", ids), ("known", known), ("sizes", size), ("hashes", hashes), ("ptr", ptr.astype(np.int64)),
            ("doc", (key % SHARD_DOCS).astype(np.uint16)), ("tf", tf.astype(np.uint32)))}


_FIELDS = [("part", pa.int64()), ("docs", pa.int64()), ("terms", pa.int64())] + [
    (c, pa.binary()) for c in ("ids", "known", "sizes", "hashes", "ptr", "doc", "tf")]


def index_shards(docs: DataFrame, bitmap: bytes) -> DataFrame:
    """Index shards of documents (doc_id, text), with the postings of the terms whose
    hash is in ``bitmap``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, words = [], 0, 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in common.chunks(texts):
                for a in range(a, b, SHARD_DOCS):
                    n = min(SHARD_DOCS, b - a)
                    h, ptr = terms_of(texts.slice(a, n))
                    size = np.diff(ptr)
                    some = np.flatnonzero(size)
                    if not len(some):
                        continue
                    number = np.full(n, -1)
                    number[some] = np.arange(len(some))
                    keep = common.in_filter(bitmap, h)
                    row = number[np.repeat(np.arange(n), size)[keep]]
                    one = ids.slice(a, n)
                    known = one.is_valid().to_numpy(zero_copy_only=False)[some]
                    value = one.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[some]
                    if parts and (held + len(some) > SHARD_DOCS or words + len(row) > SHARD_TERMS):
                        yield pa.RecordBatch.from_pydict(_shard(parts), schema=pa.schema(_FIELDS))
                        parts, held, words = [], 0, 0
                    parts.append((value, known, size[some].astype(np.int64), row, h[keep]))
                    held, words = held + len(some), words + len(row)
        if parts:
            yield pa.RecordBatch.from_pydict(_shard(parts), schema=pa.schema(_FIELDS))

    return docs.select("doc_id", "text").mapInArrow(run, SHARDS)


class Shard:
    """One index shard with the sparse tables of its posting lists."""

    def __init__(self, row: dict, total_docs: int, total_terms: int):
        def arr(name, kind):
            return np.frombuffer(row[name], dtype=kind)
        self.ids, self.known = arr("ids", np.int64), arr("known", bool)
        self.hashes, self.ptr = arr("hashes", np.uint64), arr("ptr", np.int64)
        self.doc = arr("doc", np.uint16).astype(np.int64)
        tf = arr("tf", np.uint32).astype(np.int64)
        m = 75 + (25 * arr("sizes", np.int64) * total_docs) // total_terms
        impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[self.doc])
        # documents without an id stand last; they are never named
        self.n = int(self.known.sum())
        impact[self.doc >= self.n] = 0
        # an impact is at most 10**6 < 2**20; of equal impacts the first document wins
        self.size = len(impact)
        longest = int(np.diff(self.ptr).max()) if len(self.hashes) else 0
        self.log = np.zeros(longest + 1, dtype=np.int64)
        for j in range(1, longest.bit_length()):
            self.log[1 << j:] = j
        levels = [((impact << SHARD_BITS) + (SHARD_DOCS - 1 - self.doc)).astype(np.uint32)]
        for j in range(1, max(1, longest.bit_length())):
            half, low = 1 << (j - 1), levels[-1]
            up = low.copy()
            np.maximum(low[:-half], low[half:], out=up[:-half])
            levels.append(up)
        self.table = np.concatenate(levels)

    def lists(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each term's posting list (-1: none)."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def search(self, lists: np.ndarray, weight: np.ndarray, k: int, kth: int = 0,
               kth_id: int = -(1 << 63)) -> tuple[list[tuple[int, int]], int]:
        """Up to k (score, document number), best first, that beat the given k-th score
        (or equal it with a smaller id), and the number of intervals bounded."""
        base, end = self.ptr[lists], self.ptr[lists + 1]
        count = end - base
        # before[t, d]: entries of list t among the documents 0 to d - 1
        before = np.zeros((len(lists), len(self.ids) + 1), dtype=np.int32)
        flat = np.repeat(base - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        before[np.repeat(np.arange(len(lists)), count), self.doc[flat] + 1] = 1
        np.cumsum(before, axis=1, out=before)
        base, weight, limit = base[:, None], weight[:, None], self.size - 1

        def bounds(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            first, last = before[:, lo], before[:, hi]
            some = last > first
            j = self.log[last - first]
            at = j * self.size
            top = np.maximum(self.table[at + np.minimum(base + first, limit)],
                             self.table[at + np.maximum(base + last - (1 << j), 0)])
            gain = np.where(some, (top >> np.uint32(SHARD_BITS)).astype(np.int64) * weight, 0)
            most = gain.argmax(0)
            doc = SHARD_DOCS - 1 - (top[most, np.arange(len(lo))] & np.uint32(SHARD_DOCS - 1)).astype(np.int64)
            return gain.sum(0), doc

        best: list[tuple[int, int]] = []
        lo, hi = np.array([0]), np.array([self.n])
        bound, doc = bounds(lo, hi)
        rated = 1
        while True:
            live = (bound > kth) | ((bound == kth) & (self.ids[np.minimum(lo, len(self.ids) - 1)] < kth_id))
            live &= bound > 0
            if not live.any():
                return [(s, d) for s, d in best], rated
            lo, hi, bound, doc = lo[live], hi[live], bound[live], doc[live]
            if len(lo) > BATCH:
                order = np.argpartition(-bound, BATCH)
                now, later = order[:BATCH], order[BATCH:]
            else:
                now, later = np.arange(len(lo)), np.zeros(0, dtype=np.int64)
            at = doc[now]
            left, right = np.concatenate([lo[now], at + 1]), np.concatenate([at, hi[now]])
            open_ = left < right
            left, right = left[open_], right[open_]
            value, peak = bounds(np.concatenate([at, left]), np.concatenate([at + 1, right]))
            rated += len(value)
            for s, d in zip(value[:len(at)].tolist(), at.tolist()):
                if s > kth or (s == kth and self.ids[d] < kth_id):
                    best.append((s, d))
            best.sort(key=lambda x: (-x[0], x[1]))
            if len(best) >= k:
                best = best[:k]
                kth, kth_id = best[-1][0], int(self.ids[best[-1][1]])
            lo, hi = np.concatenate([lo[later], left]), np.concatenate([hi[later], right])
            bound = np.concatenate([bound[later], value[len(at):]])
            doc = np.concatenate([doc[later], peak[len(at):]])


def _search(items: list[tuple[int, np.ndarray, np.ndarray, int, int]], vocabulary: np.ndarray,
            total_docs: int, total_terms: int, k: int):
    """items: (id, places in the vocabulary, weights times repeats, kth, kth id)."""
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row, total_docs, total_terms)
                if not shard.n:
                    continue
                found = shard.lists(vocabulary)
                out: tuple[list, list, list] = ([], [], [])
                for item, places, weight, kth, kth_id in items:
                    lists = found[places]
                    on = lists >= 0
                    if not on.any():
                        continue
                    for s, d in shard.search(lists[on], weight[on], k, kth, kth_id)[0]:
                        out[0].append(item)
                        out[1].append(int(shard.ids[d]))
                        out[2].append(s)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], schema=schema)

    return run


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, h, times) of each item's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, ptr = terms_of(batch.column(1))
            who = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), np.diff(ptr))
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(h.view(np.int64))],
                                             names=["item_id", "h"])

    one = items.where(F.col("item_id").isNotNull()).groupBy(F.col("item_id").cast("long").alias("item_id")).agg(
        F.min("text").alias("text"))
    return one.mapInArrow(run, "item_id long, h long").groupBy("item_id", "h").agg(F.count(F.lit(1)).alias("times"))


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents (doc_id, text) of
    each item (item_id, text)."""
    wanted = common.checkpointed(item_terms(items))
    bitmap = common.filter_bitmap(wanted.select("h").distinct(), "h")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    index = common.checkpointed(index_shards(docs, bitmap))
    total_docs, total_terms = index.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, ptr in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(hashes, np.int64)), pa.array(np.diff(np.frombuffer(ptr, np.int64)))],
                    names=["h", "df"])

    df = index.select("hashes", "ptr").mapInArrow(lengths, "h long, df long").groupBy("h").agg(F.sum("df").alias("df"))
    wanted = common.checkpointed(wanted.join(df, "h"))
    blocks = max(1, math.ceil(wanted.count() / BLOCK_TERMS))
    wanted = wanted.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    first = F.pmod(F.xxhash64("part"), F.lit(FIRST_OF)) == 0
    found = []
    for block in range(blocks):
        rows = wanted.where(F.col("block") == block).orderBy("item_id", "h").select(
            "item_id", "h", "times", "df").toPandas()
        vocabulary, places = np.unique(rows["h"].to_numpy(np.int64).view(np.uint64), return_inverse=True)
        weight = np.array([math.floor(1000 * math.log((2 * total_docs + 2) / (2 * d + 1))) for d in rows["df"].tolist()],
                          dtype=np.int64) * rows["times"].to_numpy(np.int64)
        some = weight > 0
        places, weight = places[some], weight[some]
        who, start = np.unique(rows["item_id"].to_numpy(np.int64)[some], return_index=True)
        start = [*start.tolist(), len(places)]

        def search(kth: dict[int, tuple[int, int]]):
            todo = [(int(i), places[a:b], weight[a:b], *kth.get(int(i), (0, -(1 << 63))))
                    for i, a, b in zip(who, start, start[1:])]
            return _search(todo, vocabulary, total_docs, total_terms, k)

        out = "item_id long, doc_id long, score long"
        near = common.checkpointed(_best(index.where(first).mapInArrow(search({}), out), k))
        kth = {r.item_id: (r.score, r.doc_id) for r in near.where(F.col("rank") == k).collect()}
        found += [near.drop("rank"), index.where(~first).mapInArrow(search(kth), out)]
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    return _best(hits, k).select("item_id", "rank", "doc_id", "score")


def op11(spark, sf_dir: str) -> DataFrame:
    return rank_documents(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"""unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"""

OP11_SQL = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
word AS (SELECT r, doc_id, {_TERMS} AS term FROM doc),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM word GROUP BY ALL),
size AS (SELECT r, count(*) AS n FROM word GROUP BY r),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM size),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, total),
m AS (SELECT r, 75 + (25 * n * n_docs) // n_terms AS m FROM size, total),
item AS (SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, {_TERMS} AS term
    FROM (SELECT item_id, min(text) AS text FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id)) GROUP BY ALL),
score AS (SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
    FROM item JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r)
    WHERE doc_id IS NOT NULL GROUP BY item_id, r, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
    doc_id, score FROM score WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
