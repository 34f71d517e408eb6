"""Line deduplication by winnowing over line hashes.

A text is a sequence of lines (split at line feeds).  A window is a shortest run of
consecutive lines of at least ``MIN_WORDS`` words that starts with a line that has words.
Of each window the line with the smallest hash (the last one on ties) is selected as a
fingerprint: two texts that share a run of that many words share a whole window, hence a
fingerprint, wherever the run stands.

Fingerprints whose line hash was selected at two places or more are joined by hash; their
windows, both ways of the fingerprint, are compared by a hash of all their lines; overlapping
equal windows make up the repeated runs.  The first occurrence of a window in order of
(doc_id, text hash, line) stays; every line of a later one is deleted.

These windows alone leave the last lines of a repeated run when no shortest window ends on
them.  With ``whole_runs`` (the registered query and the pipeline's stage) the match is
extended both ways to the ends of the run: the shortest windows that END
at a line with words count too, and so do two lines of ``MIN_WORDS`` words with blank lines
between.  Every line of a repeated run of that many words, from its first line with words
to its last, lies in one of these windows, and every window is such a run, so what is
deleted are exactly the maximal runs (``OP5_SQL`` finds them from pairs of equal lines).

Defined results: a null text stays null, an empty one empty; a text whose lines are all
deleted becomes empty; rows without doc_id come last in the order; rows equal in doc_id
and text count as one document and are treated alike; lines are compared byte by byte; a
repeat within one text counts; other columns are passed through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 50
LAST_ID = (1 << 63) - 1


def lines_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and word count of every line, and the row pointer.  Words are runs of bytes
    other than ASCII white space."""
    data, at = common.text_bytes(texts)
    feeds = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([at[:-1], feeds + 1]))  # a feed at a row's end gives an empty line
    ptr = np.concatenate([[0], np.cumsum(np.bincount(
        np.searchsorted(at, feeds, side="right") - 1, minlength=len(at) - 1) + 1)]) if len(at) > 1 else np.zeros(1, int)
    end = np.empty_like(start)
    end[:-1] = start[1:] - 1
    if len(ptr) > 1:
        end[ptr[1:] - 1] = at[1:]
    words, _, _ = common.solid_runs(data, at)
    h = common.segment_hashes(data, start, end)
    return h, np.searchsorted(words, end) - np.searchsorted(words, start), ptr


def _other_windows(words: np.ndarray, ptr: np.ndarray, total: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of the shortest windows that end at a line with words, and of
    neighbours that are windows by themselves with blank lines between."""
    last = np.flatnonzero(words > 0)
    row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))[last]
    first = np.searchsorted(total, total[last + 1] - min_words, side="right") - 1
    ok = first >= ptr[row]
    alone = words[last] >= min_words
    gap = np.flatnonzero((np.diff(last) > 1) & (row[1:] == row[:-1]) & alone[1:] & alone[:-1])
    return np.concatenate([first[ok], last[gap]]), np.concatenate([last[ok], last[gap + 1]])


def winnow(h: np.ndarray, words: np.ndarray, ptr: np.ndarray, min_words: int = MIN_WORDS, whole_runs: bool = False
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows: first and last line, hash of their lines, line selected as fingerprint
    (all as indices into the batch's lines)."""
    total = np.concatenate([[0], np.cumsum(words)])
    first = np.flatnonzero(words > 0)
    row_end = np.repeat(ptr[1:], np.diff(ptr))[first]
    stop = np.searchsorted(total, total[first] + min_words, side="left")
    ok = stop <= row_end
    first, last = first[ok], stop[ok] - 1
    if whole_runs:
        more_first, more_last = _other_windows(words, ptr, total, min_words)
        key = np.unique(np.concatenate([first, more_first]) * len(words) + np.concatenate([last, more_last]))
        first, last = key // max(1, len(words)), key % max(1, len(words))
    content, best, best_at = np.zeros(len(first), np.uint64), np.full(len(first), np.iinfo(np.uint64).max), last.copy()
    span = last - first
    on = np.arange(len(first))
    for k in range(int(span.max(initial=-1)) + 1):
        on = on[span[on] >= k]
        line = h[first[on] + k]
        content[on] = content[on] * np.uint64(0xD6E8FEB86659FD93) + line
        low = line <= best[on]
        best[on[low]], best_at[on[low]] = line[low], first[on[low]] + k
    return first, last, common.mix64(content ^ (span.astype(np.uint64) << np.uint64(32))), best_at


def _fingerprints(min_words: int, whole_runs: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in common.chunks(texts):
                h, words, ptr = lines_of(texts.slice(a, b - a))
                first, last, content, at = winnow(h, words, ptr, min_words, whole_runs)
                order = np.lexsort((first, at))
                first, last, content, at = first[order], last[order], content[order], at[order]
                start = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, int)
                row = np.searchsorted(ptr, at[start], side="right") - 1
                shift = np.repeat(ptr[:-1], np.diff(ptr))[first] if len(first) else first
                windows = pa.StructArray.from_arrays(
                    [pa.array((first - shift).astype(np.int32)), pa.array((last - shift).astype(np.int32)),
                     pa.array(content.view(np.int64))], names=["i", "e", "w"])
                offsets = pa.array(np.append(start, len(at)).astype(np.int32))
                rows = pa.array(row + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(rows), batch.column("th").take(rows), pa.array(h[at[start]].view(np.int64)),
                     pa.ListArray.from_arrays(offsets, windows)], names=["id", "th", "fp", "windows"])
    return run


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, whole_runs: bool = False) -> DataFrame:
    """``id`` (doc_id, the largest long if null), ``th`` (xxhash64 of the text), ``spans``:
    the (i, e) line ranges of windows that occurred before."""
    ids = docs.where("text is not null").select(
        F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), F.xxhash64("text").alias("th"), "text")
    prints = common.checkpointed(ids.mapInArrow(
        _fingerprints(min_words, whole_runs), "id long, th long, fp long, windows array<struct<i:int,e:int,w:long>>"))
    twice = prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp")
    hits = prints.join(twice, "fp").select("id", "th", F.inline("windows"))
    place = F.struct("id", "th", "i")
    first = hits.groupBy("w").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("w", "first")
    later = hits.join(first, "w").where(place > F.col("first")).select("id", "th", "i", "e").distinct()
    return later.groupBy("id", "th").agg(F.collect_list(F.struct("i", "e")).alias("spans"))


def _without(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for text, ranges in zip(texts, spans, strict=True):
        if text is None or ranges is None:
            out.append(None)
            continue
        lines = text.split("\n")
        gone = np.zeros(len(lines) + 1, dtype=np.int64)
        for r in ranges:
            gone[r["i"]] += 1
            gone[r["e"] + 1] -= 1
        out.append("\n".join(x for x, g in zip(lines, np.cumsum(gone)[:-1], strict=True) if g == 0))
    return pd.Series(out, dtype=object)


def deduplicate_lines(docs: DataFrame, min_words: int = MIN_WORDS, whole_runs: bool = False) -> DataFrame:
    """``docs`` with later repeated runs of lines deleted from ``text`` (and ``n_chars``,
    if there, counted anew), to the runs' ends with ``whole_runs``.  All rows stay."""
    i, t, runs, cut = (common.fresh(docs, x) for x in ("id", "th", "runs", "cut"))
    found = repeated_runs(docs, min_words, whole_runs).toDF(i, t, runs)
    same = (F.coalesce(docs["doc_id"], F.lit(LAST_ID)) == found[i]) & (F.xxhash64(docs["text"]) == found[t])
    without = F.pandas_udf(_without, "string")
    # the function sees only texts with something to delete
    text = F.when(F.col(runs).isNull(), docs["text"]).otherwise(
        without(F.when(F.col(runs).isNotNull(), docs["text"]), F.col(runs)))
    out = docs.join(found, same, "left").withColumn(cut, text)
    new = {"text": F.col(cut)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length(cut).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, common.col(c)).alias(c) for c in docs.columns])


def op5(spark, sf_dir: str) -> DataFrame:
    return deduplicate_lines(common.documents(spark, sf_dir).select("doc_id", "text"), whole_runs=True)


OP5_SQL = f"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
l AS (
  SELECT doc_id, i, lines[i] AS line, len(regexp_extract_all(lines[i], '[^\\t\\n\\x0b\\f\\r ]+')) AS words
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
p AS (  -- equal lines, the later place against every earlier one
  SELECT b.doc_id, b.i, b.words, a.doc_id AS other, b.i - a.i AS shift
  FROM l a JOIN l b ON a.line = b.line AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.i < b.i))),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, other, shift ORDER BY i) AS run FROM p),
r AS (  -- maximal runs, from the first line with words to the last
  SELECT doc_id, min(i) FILTER (words > 0) AS i, max(i) FILTER (words > 0) AS e
  FROM g GROUP BY doc_id, other, shift, run HAVING sum(words) >= {MIN_WORDS}),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, e + 1)) AS i FROM r)
SELECT x.doc_id, CASE WHEN x.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents x LEFT JOIN (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i WHERE g.i IS NULL GROUP BY l.doc_id) k USING (doc_id)
"""
