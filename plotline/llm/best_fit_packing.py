"""Sequence packing: Martello-Toth dominance reduction, then best-fit of the remainder.

Documents become token ids (a fixed public vocabulary) with one end id; only documents
longer than a sequence are cut.  Which pieces of one length go where does not matter for
the number of sequences, so the instance is its histogram of lengths, at most ``LENGTH``
counts whatever the number of documents.  On it, small sets that provably dominate all
other ways to fill a sequence with a given piece are fixed for good and taken out; what
is left is packed by best-fit decreasing, many like sequences at a time.  The resulting
patterns (how many sequences hold which lengths) are bounded as well; tasks turn a piece's
rank among those of its length into its place.

Defined results: a null text counts as empty (one end id); an empty table gives no rows;
repeated rows are packed each; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

LENGTH = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Distinct pieces of text whose ids a task keeps at hand; beyond, it starts anew.
CACHE = 300_000

_PLAIN = re.compile("[\n!-~À-ÖØ-öø-ÿ]*")
_PARTS = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ\n]+")
_GAP = b"\xff" * 4  # no id has such bytes, wherever it is cut


class WordTokenizer:
    """Ids (as little-endian 32-bit bytes) as the vocabulary's tokenizer gives them.  White
    space separates its tokens and leaves none, so a text's ids are those of its words,
    which are looked up once each.  Words of ASCII and Latin-1 letters are split into the
    tokenizer's own parts here (their normal form is their lower case) and only new parts
    are handed to it, many at once; other words take the whole way."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers
        self.full = Tokenizer.from_file(path)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.merges = Tokenizer.from_file(path)
        self.merges.normalizer = None
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.full.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that end a part
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {"\n": _GAP}

    def _learn_parts(self, parts: list[str]) -> None:
        ids = np.array(self.merges.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, dtype="<u4")
        stop = np.flatnonzero(self.ends[ids]) + 1
        if len(stop) != len(parts):
            raise ValueError("the vocabulary does not mark the end of every part")
        raw, start = ids.tobytes(), 0
        for part, end in zip(parts, (stop * 4).tolist(), strict=True):
            self.parts[part] = raw[start:end]
            start = end

    def _learn(self, words: list[str]) -> None:
        plain = "\n".join(words)
        if not _PLAIN.fullmatch(plain) or any(t in plain for t in self.special):
            odd = [w for w in words if not _PLAIN.fullmatch(w) or any(t in w for t in self.special)]
            for w in odd:
                self.words[w] = np.array(self.full.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes()
            words = list(set(words).difference(odd))
            plain = "\n".join(words)
        if words:
            found = _PARTS.findall(plain.lower())
            new = list(set(found).difference(self.parts))
            if new:
                self._learn_parts(new)
            self.words.update(zip(words, b"".join(map(self.parts.__getitem__, found)).split(_GAP), strict=True))

    def ids(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > CACHE:
            self.words = {"": b""}
        if len(self.parts) > CACHE:
            self.parts = {"\n": _GAP}
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        new = set(chain.from_iterable(split)).difference(self.words)
        if new:
            self._learn(list(new))
        get = self.words.__getitem__
        return [b"".join(map(get, words)) for words in split]


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY)


def _pieces(path: str | None, with_ids: bool):
    def run(batches):
        tokenizer = WordTokenizer(path or vocabulary_path())
        for batch in batches:
            texts = batch.column("text")
            for a, b in common.chunks(texts):
                rows: list[list] = [[], [], [], [], [], []]
                found = tokenizer.ids([t or "" for t in texts.slice(a, b - a).to_pylist()])
                for i, ids in enumerate(found, a):
                    ids += END_ID.to_bytes(4, "little")
                    for piece, start in enumerate(range(0, len(ids), 4 * LENGTH)):
                        part = ids[start: start + 4 * LENGTH]
                        for out, x in zip(rows, (i, piece, start // 4, len(part) // 4, zlib.crc32(part),
                                                 part if with_ids else None), strict=True):
                            out.append(x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()),
                     *(pa.array(x, pa.int64()) for x in rows[2:5]), *([pa.array(rows[5], pa.binary())] if with_ids else [])],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])
    return run


def tokenised(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` (and ``ids``: little-endian
    unsigned 32-bit).  ``path``: the vocabulary file, the public one by default."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(path, with_ids), schema)


Pattern = tuple[int, tuple[tuple[int, int], ...]]  # how many sequences hold (length, how many) ...


def dominance(count: np.ndarray, capacity: int) -> list[Pattern]:
    """Sequences fixed by dominance; ``count`` (by length) is reduced in place.

    A set with piece s dominates another one if the other's pieces can be put together so
    that each lot is no larger than a piece of the first.  So {s, t} is fixed if t fills
    the rest exactly, or is the largest that fits and at most one more piece fits, or at
    most two more fit and no pair that fits adds up to more than t; {s} if nothing fits.
    As pieces go, the sets to dominate only get fewer, so whole counts are fixed at once.
    """
    fixed: list[Pattern] = []
    for s in range(capacity, 0, -1):
        while count[s]:
            room = capacity - s
            count[s] -= 1  # partners of one such piece
            here = np.flatnonzero(count[:room + 1])
            least = np.repeat(here[:3], np.minimum(count[here[:3]], 3))[:3]
            count[s] += 1
            if not len(here):
                fixed.append((int(count[s]), ((s, 1),)))
                count[s] = 0
                break
            t = int(here[-1])
            ok = t == room or least[:2].sum() > room or len(least) < 2
            if not ok and (len(least) < 3 or least.sum() > room):
                # the largest sum of two pieces that fits: for each the largest partner
                few = here[:-1] if count[t] - (t == s) < 2 else here
                at = np.searchsorted(here, room - few, side="right") - 1
                best = 0
                for x, j in zip(few.tolist(), at.tolist(), strict=True):
                    while j >= 0 and here[j] == x and count[x] - (x == s) < 2:
                        j -= 1
                    if j >= 0:
                        best = max(best, x + int(here[j]))
                ok = best <= t
            if not ok:
                break
            if t == s:
                n = int(count[s]) // 2
                fixed.append((n, ((s, 2),)))
                count[s] -= 2 * n
            else:
                n = int(min(count[s], count[t]))
                fixed.append((n, ((s, 1), (t, 1))))
                count[s] -= n
                count[t] -= n
    return fixed


def best_fit(count: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing, like sequences at a time: a piece goes where least room is
    left; the next of its length follows into the same sequence while it fits."""
    free: dict[int, list[tuple[int, tuple]]] = {}
    rooms: list[int] = []
    done: list[Pattern] = []

    def put(room: int, n: int, pattern: tuple) -> None:
        if not n:
            return
        if not room:
            done.append((n, pattern))
            return
        if room not in free:
            insort(rooms, room)
        free.setdefault(room, []).append((n, pattern))

    for s in range(capacity, 0, -1):
        left = int(count[s])
        while left:
            i = bisect_left(rooms, s)
            if i < len(rooms):
                room = rooms[i]
                n, pattern = free[room].pop()
                if not free[room]:
                    del free[room]
                    rooms.pop(i)
            else:
                room, n, pattern = capacity, left, ()
            each = min(room // s, left)
            used = min(n, left // each)
            put(room - each * s, used, (*pattern, (s, each)))
            if pattern or room != capacity:
                put(room, n - used, pattern)
            left -= used * each
    return done + [(n, p) for entries in free.values() for n, p in entries]


def plan(histogram: dict[int, int], capacity: int = LENGTH) -> list[Pattern]:
    count = np.zeros(capacity + 1, dtype=np.int64)
    for s, n in histogram.items():
        count[s] = n
    return dominance(count, capacity) + best_fit(count, capacity)


def _places(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """By length, rows of (first rank, first sequence, pieces of it a sequence, offset)."""
    rows: dict[int, list] = {}
    rank: dict[int, int] = {}
    base = 0
    for n, pattern in patterns:
        offset = 0
        for s, each in pattern:
            rows.setdefault(s, []).append((rank.get(s, 0), base, each, offset))
            rank[s] = rank.get(s, 0) + n * each
            offset += s * each
        base += n
    return {s: np.array(x, dtype=np.int64) for s, x in rows.items()}


def pack(pieces: DataFrame, capacity: int = LENGTH) -> DataFrame:
    """``pieces`` (any columns, among them ``length`` from 1 to ``capacity``, and ``doc_id``
    and ``piece`` to tell them apart) with ``sequence_id`` and ``offset``."""
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    pieces = pieces.select(*map(common.col, names))
    found = {int(s): n for s, n in pieces.groupBy("length").agg(F.count(F.lit(1))).collect()}
    places = _places(plan(found, capacity))
    # the rank among pieces of a length: rows before it in its part of them, after all earlier parts
    parts = common.shuffle_partitions(pieces.sparkSession)
    rows = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    before = rows.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_base", F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    within = F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "piece", *[
        common.col(c) for c in names if c not in ("doc_id", "piece", "length")]))
    ranked = rows.withColumn("_at", within).join(before.select("length", "_part", "_base"), ["length", "_part"]) \
        .select(F.struct(*map(common.col, names)).alias("row"), "length",
                (F.coalesce("_base", F.lit(0)) + F.col("_at") - 1).alias("rank"))

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for s in np.unique(length):
                on = np.flatnonzero(length == s)
                first, base, each, offset = places[int(s)].T
                i = np.searchsorted(first, rank[on], side="right") - 1
                k = rank[on] - first[i]
                seq[on], off[on] = base[i] + k // each[i], offset[i] + k % each[i] * s
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(seq), pa.array(off)],
                                             names=["row", "sequence_id", "offset"])
    placed = ranked.mapInArrow(place, ranked.select("row").schema.add("sequence_id", "long").add("offset", "long"))
    return placed.select("row.*", "sequence_id", "offset")


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences of pieces with ``ids``: ``sequence_id``, ``ids`` (bytes of at most
    ``LENGTH`` ids, pieces in order of offset)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return placed.groupBy("sequence_id").agg(joined.alias("ids"))


def pack_documents(docs: DataFrame) -> DataFrame:
    return pack(common.checkpointed(tokenised(docs)))


def op7(spark, sf_dir: str) -> DataFrame:
    return pack_documents(common.documents(spark, sf_dir))
