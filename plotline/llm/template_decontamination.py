"""Benchmark decontamination by template canonicalisation.

Benchmark items and documents are read as tokens (words as elsewhere in this subpackage).
Numbers, names (words that begin with a capital) and units (after a number) become typed
placeholders; the rest, in lower case, is literal.  Tokens are read twice: every word as one,
and whole numbers (with sign, separators and decimals) and whole runs of names (with blanks,
hyphens or apostrophes between) as one each, so that a slot may change its number of words.
Every window of ``WINDOW`` tokens with
at least ``LITERALS`` literal ones is a template; items with fewer tokens (but ``LEAST``)
are one window of all.  Windows also count as written (in lower case, no placeholder), as
a text in capitals hides its names.  Documents' windows are joined with the items' by hash.
A match counts if its slots are consistent: each slot value of the item goes with one value of the
document and the other way round.  So an item copied with other numbers, names or units is
caught (``reparameterised``), as is one copied as it is (``exact``).  Slots are compared
over all windows of one copy.

Map tasks pass on only windows that a fixed 2 MB bitmap of the items' templates lets
through; the join that follows is exact, so neither table's size is bounded.

Defined results: null and empty texts match nothing; items with fewer than ``LEAST``
tokens cannot be told from ordinary prose and match nothing;
repeated rows each match; equal items are all reported; columns other than ``doc_id``,
``item_id`` and ``text`` are ignored.  Lower case covers ASCII and Latin-1 letters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, LITERALS, LEAST = 13, 7, 8

UNITS = """mm cm m km in ft yd mi miles mile inches feet mg g kg t oz lb lbs ml l s sec min h hr hrs hours hour
minutes days day weeks week months month years year percent dollars euros cents usd eur kmh mph w kw v a hz gb mb""".split()

NUMBER, NAME, UNIT = 1, 2, 3
WORDS, RUNS, WRITTEN = 0, 1, 2


def _bytes(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


#: What joins the words of one number (1,250 or 3.5 or 1/2) and of one run of names (Mary Ann, O'Neill-Smith).
_IN_NUMBER, _IN_NAME = _bytes(b".,'/"), _bytes(b" \t\n\r'-")
#: A minus after one of these is no sign.
_ENDS_TERM = common._WORD_BYTE | _bytes(b")]}-")


def _unit_hashes() -> np.ndarray:
    return np.sort(common.words_of(pa.array(UNITS)).hash)


def canonical(texts: pa.Array, units: np.ndarray, runs: bool) -> tuple[np.ndarray, ...]:
    """Of every token (a word or, with ``runs``, a whole number or run of names): the canonical
    hash, the hash as written (lower case), the slot type (0: literal) and the first word (and
    the number of words at the end); the row pointers of tokens and of words; and whether the
    row is read in another way than without ``runs``."""
    data, at = common.text_bytes(texts)
    start, end, ptr = common.runs(common._WORD_BYTE[data], at)
    low = data.copy()
    upper = (data >= 65) & (data <= 90)
    low[upper] += 32
    wide = np.zeros(len(data), dtype=bool)  # second byte of a Latin-1 capital
    wide[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    low[wide] += 32
    value = common.segment_hashes(low, start, end)
    kind = np.zeros(len(start), dtype=np.int8)
    if not len(start):
        return value, value, kind, np.zeros(1, dtype=np.int64), ptr, ptr, np.zeros(len(ptr) - 1, dtype=bool)
    lead = data[start]
    kind[upper[start] | wide[np.minimum(start + 1, len(data) - 1)] & (lead == 0xC3)] = NAME
    kind[(lead >= 48) & (lead <= 57)] = NUMBER
    # a word goes on with the one before: digits after one separator, a name after a gap of blanks
    joined = np.zeros(len(start), dtype=bool)
    gap = start[1:] - end[:-1]
    number = (kind[1:] == NUMBER) & (kind[:-1] == NUMBER) & (gap == 1) & _IN_NUMBER[data[end[:-1]]]
    other = np.concatenate([[0], np.cumsum(~_IN_NAME[data])])
    name = (kind[1:] == NAME) & (kind[:-1] == NAME) & (other[start[1:]] == other[end[:-1]])
    joined[1:] = (number | name) & runs
    joined[ptr[:-1][ptr[:-1] < len(start)]] = False
    head = np.flatnonzero(~joined)
    word = np.append(head, len(start))
    token_ptr = np.searchsorted(head, ptr)
    kind, size = kind[head], np.diff(word)
    # a number's value is its bytes, a name's its words in order, whatever lies between
    place = (np.arange(len(start)) - np.repeat(head, size)).astype(np.uint64)
    full = np.add.reduceat(common.mix64(value + place * np.uint64(0xD6E8FEB86659FD93)), head)
    full = np.where(size == 1, value[head], full)
    long = (size > 1) & (kind == NUMBER)
    full[long] = common.segment_hashes(low, start[head[long]], end[word[1:][long] - 1])
    # a sign belongs to the number if it stands alone before it
    before = start[head] - 1
    row_start = np.repeat(at[:-1], np.diff(token_ptr))
    signed = (kind == NUMBER) & (before >= row_start) & runs
    signed &= data[before] == 45
    signed &= (before == row_start) | ~_ENDS_TERM[data[np.maximum(before - 1, 0)]]
    full[signed] = common.mix64(full[signed] + np.uint64(45))
    after = np.zeros(len(head), dtype=bool)
    after[1:] = kind[:-1] == NUMBER
    after[token_ptr[:-1][token_ptr[:-1] < len(head)]] = False
    known = units[np.minimum(np.searchsorted(units, full), len(units) - 1)] == full
    kind[(kind == 0) & after & known] = UNIT
    slot = common.mix64(np.arange(4, dtype=np.uint64) + np.uint64(0x7E3A))
    other_way = np.zeros(len(ptr) - 1, dtype=bool)
    other_way[np.searchsorted(token_ptr, np.flatnonzero(signed | (size > 1)), side="right") - 1] = True
    return np.where(kind == 0, full, slot[kind]), full, kind, word, token_ptr, ptr, other_way


def templates(readings: dict[int, tuple[np.ndarray, ...]], window: int, bitmap: bytes | None = None, whole: bool = False):
    """Windows as templates, those with enough literal tokens, and as written, from the
    ``readings`` (canonical) of each form; templates of ``RUNS`` only of rows that they read
    in another way.  Of each form: hash, row, first token in the row, first and last word in
    the row, and the values of all tokens, literal ones and those of a window as written
    being 0: (windows x window).  Only windows that pass ``bitmap``; with ``whole`` only
    those that are all of their row."""
    for form, (h, value, kind, word, token_ptr, ptr, other_way) in readings.items():
        t, first = common.window_hashes(value if form == WRITTEN else h, token_ptr, window)
        row = np.searchsorted(token_ptr, first, side="right") - 1
        if form == WRITTEN:
            t, ok = ~t, np.ones(len(t), dtype=bool)
        else:
            literal = np.concatenate([[0], np.cumsum(kind == 0)])
            ok = literal[first + window] - literal[first] >= LITERALS
        if form == RUNS:
            ok &= other_way[row]
        if bitmap is not None:
            ok &= common.in_filter(bitmap, t)
        if whole:
            ok &= np.diff(token_ptr)[row] == window
        t, first, row = t[ok], first[ok], row[ok]
        grid = first[:, None] + np.arange(window)[None, :]
        slots = np.where((kind[grid] == 0) | (form == WRITTEN), 0, (value[grid] | np.uint64(1)).view(np.int64))
        yield form, t, row, first - token_ptr[row], word[first] - ptr[row], word[first + window] - 1 - ptr[row], slots


def _windows(units: np.ndarray, sizes: list[int], bitmap: bytes | None, whole: bool):
    """Batches of (id, h, text) -> windows.  ``whole``: a size below WINDOW is used only
    by rows of exactly that many tokens (benchmark items)."""
    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for a, b in common.chunks(texts):
                part = texts.slice(a, b - a)
                words = canonical(part, units, False)
                readings = {WORDS: words, RUNS: canonical(part, units, True), WRITTEN: words}
                for size in sizes:
                    for form, t, row, at, first, last, slots in templates(readings, size, bitmap, whole and size < WINDOW):
                        rows = pa.array(row + a)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("id").take(rows), batch.column("h").take(rows), pa.array(t.view(np.int64)),
                             pa.array(at.astype(np.int64)), pa.array(first.astype(np.int64)), pa.array(last.astype(np.int64)),
                             pa.array(np.full(len(t), form, np.int32)),
                             pa.ListArray.from_arrays(pa.array((np.arange(len(t) + 1) * size).astype(np.int32)),
                                                      pa.array(slots.reshape(-1)))],
                            names=["id", "h", "t", "at", "first", "last", "form", "slots"])
    return run


_SCHEMA = "id long, h long, t long, at long, first long, last long, form int, slots array<long>"


def _bijection(pairs):
    """Whether (slots, item_slots) pairs match each value with one value both ways."""
    n = F.size(F.array_distinct(pairs))
    return (n == F.size(F.array_distinct(pairs["slots"]))) & (n == F.size(F.array_distinct(pairs["item_slots"])))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id``, ``h`` (xxhash64 of the text), ``item_id``, ``kind``, ``windows`` (consistent
    ones), ``first_token`` and ``last_token`` of the document that they span."""
    units = _unit_hashes()
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.xxhash64("text").alias("h"), "text")
    sizes = list(range(LEAST, WINDOW + 1))
    item_windows = common.checkpointed(items.mapInArrow(_windows(units, sizes, None, True), _SCHEMA)) \
        .select(F.col("id").alias("item_id"), "t", F.col("at").alias("item_at"), F.col("form").alias("item_form"), F.col("slots").alias("item_slots"))
    used = sorted(r.n for r in item_windows.select(F.size("item_slots").alias("n")).distinct().collect())
    bitmap = common.filter_bitmap(item_windows.select("t").distinct(), "t")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"), "text")
    found = rows.mapInArrow(_windows(units, used, bitmap, False), _SCHEMA)
    hits = found.join(item_windows, "t").where(F.size("slots") == F.size("item_slots"))
    # windows of a form that lie alike in both texts are one copy, whose slots must agree throughout;
    # where they don't, only windows without a change count (an item bounds a copy's windows)
    pair = F.filter(F.arrays_zip("slots", "item_slots"), lambda x: x["slots"] != 0)
    copies = hits.groupBy("id", "h", "item_id", "form", "item_form", (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.array_distinct(F.flatten(F.collect_set(pair))).alias("pairs"),
        F.collect_set(F.struct("first", "last", (F.col("slots") != F.col("item_slots")).alias("changed"))).alias("windows"))
    counted = F.filter("windows", lambda w: F.col("agrees") | ~w["changed"])
    found = copies.withColumn("agrees", _bijection(F.col("pairs"))).select("id", "h", "item_id", "form", F.explode(counted).alias("w"))
    # a run may take in a capital word that stands before the copy: where words as written
    # match up to the same end, nothing has changed
    written = F.max((F.col("form") == WRITTEN).cast("int")) == 1
    found = found.groupBy("id", "h", "item_id", "w.last").agg(F.collect_set("w").alias("ws"), written.alias("written")) \
        .select("id", "h", "item_id", F.explode(F.filter("ws", lambda w: ~(F.col("written") & w["changed"]))).alias("w"))
    return found.groupBy("id", "h", "item_id").agg(
        F.when(F.max(F.col("w.changed").cast("int")) == 1, "reparameterised").otherwise("exact").alias("kind"),
        F.count_distinct("w.first").alias("windows"), F.min("w.first").alias("first_token"),
        F.max("w.last").alias("last_token")).withColumnRenamed("id", "doc_id")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no benchmark item leaked into."""
    return common.rows_with(docs, leaks(docs, benchmark).select("doc_id", "h"), F.xxhash64(docs["text"]), "left_anti")


def op6(spark, sf_dir: str) -> DataFrame:
    return leaks(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("h")
