"""Byte-level BPE encoding and decoding with recursive DuckDB queries in each partition.

A text is cut by the vocabulary's pattern into pieces.  Pieces that a task has not met yet
become token-position rows, one for each byte, in an in-process DuckDB; each step of a recursive
query joins the (position, pair of neighbours) rows with the merge table and contracts each piece's leftmost pair of
minimum rank, until no pair of a piece can merge.  (A piece that is a token by itself is
that token, as in the reference algorithm.)  The merge table holds every split of a token
into two tokens, derived from the rank file.  Decoding joins a document's (position, id)
rows with the vocabulary and aggregates their bytes in order.

Nothing is shuffled; a task's memory is bounded by HELD_PIECES remembered pieces, a step
of about CHUNK_BYTES of text (a longer single text is one step) and the rank file.

Defined results: a null text is as an empty one (no ids); ``decode_documents`` takes a
null id list as empty and raises on an id that the vocabulary does not have; ids may be
null or repeated, rows are treated one by one; empty tables give no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rank file by default; it must lie at this place on the executors too.
RANKS = "byte_bpe_multi_50k.tiktoken"
HELD_PIECES = 500_000
#: Pieces that one recursive query contracts.
STEP_PIECES = 60_000
DECODE_ROWS = 1_000_000

CONTRACT = """
WITH RECURSIVE step(piece, ids, done) AS (
  SELECT piece, list(token ORDER BY pos), false FROM start GROUP BY piece
  UNION ALL
  SELECT s.piece, CASE WHEN b.pos IS NULL THEN s.ids ELSE s.ids[:b.pos - 1] || [b.merged] || s.ids[b.pos + 2:] END,
         b.pos IS NULL
  FROM step s LEFT JOIN (
    SELECT piece, min(merged * 4294967296 + pos) AS least, least >> 32 AS merged, least & 4294967295 AS pos
    FROM (SELECT piece, unnest(ids[:-2]) * 65536 + unnest(ids[2:]) AS pair, unnest(range(1, len(ids))) AS pos
          FROM step WHERE NOT done)
    JOIN merges USING (pair) GROUP BY piece) b USING (piece)
  WHERE NOT s.done
)
SELECT piece, ids FROM step WHERE done
"""

DECODE = """
SELECT doc, array_to_string(list(chars ORDER BY pos), '') AS chars, count(chars) AS known
FROM ids LEFT JOIN vocabulary USING (id) GROUP BY doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Bpe:
    """One task's vocabulary, merge table and remembered pieces."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex
        self.pattern = regex.compile(pattern)
        self.ranks = read_ranks(path)
        if max(self.ranks.values()) >= 1 << 16:
            raise ValueError("ranks of 65536 and more are not supported")
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        pair, merged = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pair.append(a * 65536 + b)
                    merged.append(rank)
        self._table("merges", {"pair": pa.array(pair, pa.int64()), "merged": pa.array(merged, pa.int64())})
        # bytes as characters of the same number, since tokens may be parts of a UTF-8 character
        self._table("vocabulary", {"id": pa.array(list(self.ranks.values()), pa.int32()),
                                   "chars": pa.array([t.decode("latin-1") for t in self.ranks], pa.string())})
        self.byte = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        self.forget()

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.zeros(0, dtype=np.uint32)
        self.ptr = np.zeros(1, dtype=np.int64)

    def learn(self, pieces: list[str]) -> None:
        """Remember the ids of new pieces."""
        for at in range(0, len(pieces), STEP_PIECES):
            some = pieces[at:at + STEP_PIECES]
            raw = [p.encode() for p in some]
            whole = [self.ranks.get(r) for r in raw]
            rest = [i for i, w in enumerate(whole) if w is None]
            size = np.ones(len(some), dtype=np.int64)
            found = np.array([-1 if w is None else w for w in whole], dtype=np.int64)
            got_rows, got_ids = np.flatnonzero(found >= 0), found[found >= 0]
            if rest:
                data = np.frombuffer(b"".join(raw[i] for i in rest), dtype=np.uint8)
                count = np.array([len(raw[i]) for i in rest])
                token = self.byte[data]
                if (token < 0).any():
                    raise ValueError("the vocabulary lacks a single byte")
                pos = np.arange(len(data)) - np.repeat(np.cumsum(count) - count, count)
                self.db.register("start", pa.table({"piece": np.repeat(np.array(rest), count), "pos": pos, "token": token}))
                out = self.db.sql(CONTRACT).to_arrow_table()
                self.db.unregister("start")
                lists = out.column("ids").combine_chunks()
                lists = lists if isinstance(lists, pa.Array) else lists.chunk(0)
                length = np.diff(lists.offsets.to_numpy())
                piece = out.column("piece").to_numpy()
                size[piece] = length
                got_rows = np.concatenate([got_rows, np.repeat(piece, length)])
                got_ids = np.concatenate([got_ids, lists.flatten().to_numpy()])
            order = np.argsort(got_rows, kind="stable")
            base = len(self.number)
            self.number.update((p, base + i) for i, p in enumerate(some))
            self.ids = np.concatenate([self.ids, got_ids[order].astype(np.uint32)])
            self.ptr = np.concatenate([self.ptr, self.ptr[-1] + np.cumsum(size)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and each text's pointer to them."""
        if len(self.number) > HELD_PIECES:
            self.forget()
        pieces = [self.pattern.findall(t) if t else [] for t in texts]
        count = np.array([len(p) for p in pieces], dtype=np.int64)
        flat = list(chain.from_iterable(pieces))
        code = np.fromiter(map(self.number.get, flat, repeat(-1)), dtype=np.int64, count=len(flat))
        new = np.flatnonzero(code < 0)
        if len(new):
            self.learn(list(dict.fromkeys(flat[i] for i in new.tolist())))
            code[new] = [self.number[flat[i]] for i in new.tolist()]
        begin, size = self.ptr[code], self.ptr[code + 1] - self.ptr[code]
        end = np.cumsum(size)
        at = np.repeat(begin - (end - size), size) + np.arange(end[-1] if len(end) else 0)
        total = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(count)])]
        return self.ids[at], total

    def decode(self, ids: np.ndarray, ptr: np.ndarray) -> list[bytes]:
        """The bytes of each row of ids."""
        out: list[list[bytes]] = [[] for _ in range(len(ptr) - 1)]
        for a in range(0, len(ids), DECODE_ROWS):
            b = min(len(ids), a + DECODE_ROWS)
            row = np.searchsorted(ptr, np.arange(a, b), side="right") - 1
            self.db.register("ids", pa.table({"doc": row.astype(np.int32), "pos": np.arange(b - a, dtype=np.int32),
                                             "id": ids[a:b].astype(np.int32)}))
            doc, chars, known = self.db.sql(DECODE).to_arrow_table().columns
            self.db.unregister("ids")
            if sum(known.to_pylist()) < b - a:
                raise ValueError("an id is not in the vocabulary")
            for d, c in zip(doc.to_pylist(), chars.to_pylist()):
                out[d].append(c.encode("latin-1"))
        return [b"".join(parts) for parts in out]


def _numbered(df: DataFrame) -> DataFrame:
    """Columns by their place, so that any name is possible."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def encode_documents(docs: DataFrame, ranks: str | None = None, pattern: str | None = None,
                     text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column ``ids`` (array<int>): the token ids of ``text``; a column
    that has that name is replaced."""
    path, pattern = ranks or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    keep = [c for c in docs.columns if c.lower() != ids.lower()]
    given = _numbered(docs.select(*[common.col(c) for c in keep], common.col(text)))
    names = given.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(path, pattern)
        for batch in batches:
            for a, b in common.chunks(batch.column(len(keep))):
                part = batch.slice(a, b - a)
                flat, ptr = bpe.encode(part.column(len(keep)).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], names=names)

    schema = given.withColumn(given.columns[-1], F.lit(None).cast("array<int>")).schema
    return given.mapInArrow(run, schema).toDF(*keep, ids)


def decode_documents(encoded: DataFrame, ranks: str | None = None, pattern: str | None = None,
                     ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encoded`` with a column ``decoded`` (binary): the bytes of its ids."""
    path, pattern = ranks or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    keep = [c for c in encoded.columns if c.lower() != decoded.lower()]
    at = [c.lower() for c in keep].index(ids.lower())
    given = _numbered(encoded.select(*[common.col(c) for c in keep]))
    names = [*given.columns, "out"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(path, pattern)
        for batch in batches:
            lists = batch.column(at)
            ptr = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            flat = lists.flatten()
            if flat.null_count:
                raise ValueError("an id is null")
            out = bpe.decode(flat.to_numpy(zero_copy_only=False), ptr.astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=names)

    schema = given.withColumn("out", F.lit(None).cast("binary")).schema
    return given.mapInArrow(run, schema).toDF(*keep, decoded)


def token_digests(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes in one pass."""
    path, pattern = ranks or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(path, pattern)
        for batch in batches:
            for a, b in common.chunks(batch.column(1)):
                flat, ptr = bpe.encode(batch.column(1).slice(a, b - a).to_pylist())
                raw = flat.astype("<u4")
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array(np.diff(ptr), pa.int64()),
                    pa.array([hashlib.sha256(raw[x:y].tobytes()).hexdigest() for x, y in zip(ptr, ptr[1:])]),
                    pa.array([hashlib.sha256(d).hexdigest() for d in bpe.decode(flat, ptr)])],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12(spark, sf_dir: str) -> DataFrame:
    return token_digests(common.documents(spark, sf_dir))
