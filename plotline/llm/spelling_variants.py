"""Spelling variants: words one edit apart, found on a trie whose edges are a table.

Every word stands in the table twice, as it is and reversed, with an end mark.  A trie
node is the hash of a prefix; the edge table has for each node and next character the
child (and, to step over one replaced character, the node two characters on).  A state is
(word, position, node, edits).  States without an edit lie on the word's own path, so
their nodes are known; there one character is deleted or replaced, in the second half of
the word for either direction, so each edit of a word is made on one side only, below a
prefix of three characters or more.  The states with one edit join the table of jumps
(edges of 1, 2, 4 and more characters) on (node, next characters) until their word ends; those that end on an end
mark have reached a neighbour, which an exact edit distance confirms.  Insertions are the
deletions of the other word, and are read backwards.

A node with many states is spread over several copies of its edges (``spread_join``).  A
word's neighbours are bounded by its length and the alphabet, so no group of words is
paired off.  Words of LONG code points and more would need as many levels; they are
matched by the hashes of their one-deletion forms instead, which finds the same pairs.

Defined results: null texts and texts without a letter hold no words; a null id counts as
an empty id text; repeated rows count each; no words, no rows; ties between forms go to
the smallest in code-point order; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.operators.joins import spread_join

from . import common

LEAST_LENGTH = 6
LEAST_COUNT = 5
TYPO_OF = 199
#: The form of a word must stand at least this many times as often.
FORM_RATIO = 5
LONG = 40
#: Characters that one step below an edit may take; the largest that fits is taken, so the
#: steps of a word grow with the logarithm of its length.
SPANS = (1, 2, 4, 8, 16, 32)
#: Distinct words that a task holds before it hands on their counts.
HELD_WORDS = 100_000
END = "\0"


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, typo_of: int = TYPO_OF) -> DataFrame:
    """(word, n) of documents (doc_id, text): runs of Latin letters, only A-Z
    lower-cased; in one run of ``typo_of`` the code point at crc32 % length goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = re.compile("[A-Za-zÀ-ÿ]{%d,}" % least_length)
        total: Counter = Counter()

        def counted() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.string()),
                                              pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                # bytes.lower() touches A-Z alone
                words = Counter(letters.findall(text.encode().lower().decode()))
                i = i.as_py()
                base = zlib.crc32(f"{'' if i is None else i}:".encode())
                for w, n in words.items():
                    h = zlib.crc32(w.encode(), base)
                    if h % typo_of == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1:]
                        if len(w) < least_length:
                            continue
                    total[w] += n
                if len(total) >= HELD_WORDS:
                    yield counted()
        yield counted()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _node(side, prefix):
    return F.xxhash64(side, prefix)


def _walk(words: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Jumps of SPANS characters (node, ch, child), edges (node, ch, over, child), edited states (word, n, s, pos, node, over) one step
    before their next character, and ends (node, near, near_n) of words in both directions."""
    both = words.select("word", "n", F.length("word").alias("len"), F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("word").alias("s")),
        F.struct(F.lit(1).alias("side"), F.reverse("word").alias("s")))).alias("d")) \
        .select("word", "n", "len", "d.side", F.concat("d.s", F.lit(END)).alias("s"))
    least = LEAST_LENGTH // 2
    at = both.select("side", "s", "len", F.explode(F.sequence(F.lit(least), F.col("len"))).alias("p"))
    prefix = F.substring("s", F.lit(1), F.col("p"))
    one = F.substring("s", F.col("p") + 1, F.lit(1))
    two = F.substring("s", F.col("p") + 2, F.lit(1))
    spans = F.filter(F.array(*[F.lit(k) for k in SPANS]), lambda k: F.col("p") + k <= F.col("len") + 1)
    jumps = common.checkpointed(at.select("*", F.explode(spans).alias("k")).select(
        _node("side", prefix).alias("node"), F.substring("s", F.col("p") + 1, F.col("k")).alias("ch"),
        _node("side", F.substring("s", F.lit(1), F.col("p") + F.col("k"))).alias("child")).distinct())
    direct = jumps.where(F.length("ch") == 1).select("node", "ch", F.lit("").alias("over"), "child")
    skip = at.where("p < len").select(
        _node("side", prefix).alias("node"), two.alias("ch"), one.alias("over"),
        _node("side", F.substring("s", F.lit(1), F.col("p") + 2)).alias("child"))
    edges = direct.union(skip.distinct())
    half = (F.col("len") / 2).cast("int")
    own = both.select("word", "n", "len", "side", "s", F.explode(F.sequence(
        F.when(F.col("side") == 0, half).otherwise(F.col("len") - half), F.col("len") - 1)).alias("p"))
    edited = own.select("word", "n", "s", (F.col("p") + 2).alias("pos"), _node("side", prefix).alias("node"),
                        one.alias("own"), two.alias("ch"),
                        # of equal neighbouring characters only the last one is deleted
                        (F.when(F.col("side") == 0, two).otherwise(F.substring("s", F.col("p"), F.lit(1))) != one)
                        .alias("deletes"))
    ends = both.select(_node("side", "s").alias("node"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return jumps, edges, edited, ends


def _short_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): one edit apart; replaced pairs both ways, deletions one way."""
    jumps, edges, edited, ends = _walk(words)
    # first level: the edit and the character after it
    states = spread_join(edited, edges, ["node", "ch"]).where(
        ((F.col("over") == "") & F.col("deletes")) | ((F.col("over") != "") & (F.col("over") != F.col("own")))) \
        .select("word", "n", "s", "pos", F.col("child").alias("node"))
    states = common.checkpointed(states)
    done = []
    while True:
        done.append(states.where(F.col("pos") == F.length("s")).select("word", "n", "node"))
        open_ = states.where(F.col("pos") < F.length("s"))
        if open_.isEmpty():
            break
        left = F.length("s") - F.col("pos")
        span = F.greatest(*[F.when(left >= k, k).otherwise(1) for k in SPANS])
        open_ = open_.withColumn("ch", F.substring("s", F.col("pos") + 1, span))
        states = common.checkpointed(spread_join(open_, jumps, ["node", "ch"]).select(
            "word", "n", "s", (F.col("pos") + F.length("ch")).alias("pos"), F.col("child").alias("node")))
    reached = done[0]
    for more in done[1:]:
        reached = reached.union(more)
    return reached.join(ends, "node").where(F.levenshtein("word", "near") == 1).select("word", "n", "near", "near_n")


def _long_pairs(words: DataFrame) -> DataFrame:
    """The same for long words: a common one-deletion form at one place (replaced), or
    one word a deletion form of the other."""
    rows = words.select(F.xxhash64("word").alias("id"), "word")
    n = F.length("word")
    forms = rows.select("id", F.posexplode(F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.concat(
        F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, n))))).alias("at", "form"))
    other = forms.toDF("other", "at", "form")
    replaced = forms.join(other, ["at", "form"]).where("id <> other").select("id", "other")
    deleted = forms.select("id", "form").distinct().join(rows.select(F.col("id").alias("other")), F.col("form") == F.col("other"))
    pairs = replaced.union(deleted.select("id", "other")).distinct()
    full = words.select(F.xxhash64("word").alias("id"), "word", "n")
    return pairs.join(full, "id").join(full.toDF("other", "near", "near_n"), "other") \
        .where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of words (word, n; distinct words of
    LEAST_LENGTH code points or more) one edit apart."""
    words = common.checkpointed(words)
    short = _short_pairs(words.where(F.length("word") <= LONG))
    long_ = words.where(F.length("word") >= LONG)
    if not long_.isEmpty():
        short = short.union(_long_pairs(long_))
    back = short.where(F.length("word") > F.length("near")).select(
        F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return short.union(back).distinct()


def group_variants(words: DataFrame, pairs: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.max("near_n").alias("form_n"))
    form = pairs.join(best, "word").where((F.col("near_n") == F.col("form_n")) & (F.col("near_n") >= ratio * F.col("n"))) \
        .groupBy("word").agg(F.min("near").alias("form"))
    table = common.checkpointed(
        words.join(best.select("word", "n_near", "form_n"), "word", "left").join(form, "word", "left").select(
            "word", "form", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(F.col("form").isNotNull(), F.col("form_n")).alias("form_n")))
    # a form's count grows at least ``ratio``-fold with each step, so doubling the steps ends soon
    links = common.checkpointed(table.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        step = links.toDF("root", "_next")
        longer = common.checkpointed(links.join(step, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_on")))
        links = longer.drop("_on")
        if longer.where("_on").isEmpty():
            break
    return table.join(links, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    words = common.checkpointed(word_counts(docs).where(F.col("n") >= least_count))
    return group_variants(words, near_words(words))


def op13(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(common.documents(spark, sf_dir))
