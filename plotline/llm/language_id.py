"""Language identification: sparse multinomial logistic regression on TF-IDF character
n-grams, trained by follow-the-regularised-leader with elastic-net penalties, then
temperature-calibrated.

* Features: 1- to 3-grams of lower-cased letters (everything else is one space), hashed
  into ``DIM`` buckets; raw counts times idf, scaled to unit length.
* Document frequencies cover every training document.
* The classifier is fitted on a bounded sample: about ``sample_per_lang`` distinct texts of
  each language, picked by a hash of their content, whole texts; copies count once.
  ``SHARDS`` learners run FTRL-proximal on parts of it; their weights are averaged.
* Every language is learned.  Languages are dealt to blocks of at most ``BLOCK``; each block
  is a softmax of its own languages and, with several blocks, one class for all others, to
  which every sampled text of another block belongs with one chance in the number of other
  blocks (as many texts as the block has itself).  A language's logit is taken against that
  class, so that logits of all blocks compare.  A task holds one block and one shard; the
  model grows by 64 KB a language, not with the rows.
* The temperature minimises the log loss on sampled training documents kept out of the fit,
  summed on the executors at the points of a grid, three times finer each.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is
every text if nothing could be learned (no labelled training document).  Null languages
are not learned from.  Repeated rows are predicted alike.  Columns other than those named
are ignored.  Languages of equal score: the first by name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

DIM = 1 << 13
ORDERS = 3
BLOCK = 256
SAMPLE_PER_LANG = 1500
CALIBRATION_PER_LANG = 300
SHARDS = 4
EPOCHS = 3

_LETTER = re.compile(r"[^\W\d_]")


def _letter_table() -> np.ndarray:
    """Code point -> itself if a letter, else a space, for the code points below 2**16;
    combining marks stay, as they are part of a letter."""
    import unicodedata
    return np.array([c if unicodedata.category(chr(c))[0] in "LM" else 32 for c in range(1 << 16)],
                    dtype=np.uint32)


def ngram_counts(texts: list[str], table: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Dense (texts x dim) counts of hashed 1- to 3-grams of letters."""
    low = [(t or "").lower() for t in texts]
    sizes = np.array([len(t) + 2 for t in low])
    code = np.frombuffer(("".join(f" {t} " for t in low)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    code = np.where(code < (1 << 16), table[np.minimum(code, (1 << 16) - 1)], code)
    row = np.repeat(np.arange(len(low), dtype=np.int64) * dim, sizes)
    space = code == 32
    out = np.zeros(len(low) * dim, dtype=np.int64)
    h = np.zeros(len(code), dtype=np.uint32)
    for n in range(1, ORDERS + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) + code[n - 1:] * np.uint32(0x9E3779B1)
        g = h ^ (h >> np.uint32(15))
        g = (g * np.uint32(0x85EBCA6B)) >> np.uint32(32 - int(math.log2(dim)))
        # inside one text (texts end with spaces) and not only spaces
        keep = row[:m] == row[n - 1:]
        keep &= ~(space[:m] if n == 1 else space[:m] & space[1:m + 1])
        out += np.bincount((row[:m] + g)[keep], minlength=len(out))
    return out.reshape(len(low), dim)


def _batches(texts: pa.Array, limit: int = 400_000, rows: int = 256) -> Iterator[tuple[int, int]]:
    for a, b in common.chunks(texts, limit):
        for i in range(a, b, rows):
            yield i, min(b, i + rows)


def _frequencies(table: np.ndarray):
    def run(batches):
        df, n = np.zeros(DIM, dtype=np.int64), 0
        for batch in batches:
            texts = batch.column("text")
            for a, b in _batches(texts):
                df += (ngram_counts(texts.slice(a, b - a).to_pylist(), table) > 0).sum(0)
                n += b - a
        yield pa.RecordBatch.from_pydict({
            "bucket": pa.array(np.append(np.arange(DIM, dtype=np.int32), np.int32(-1))),
            "n": pa.array(np.append(df, n))})
    return run


def tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = counts * idf
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm == 0, 1, norm)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], dim: int, classes: int, epochs: int = EPOCHS,
         alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, seed: int = 1) -> np.ndarray:
    """FTRL-proximal for softmax regression: sparse rows (indices, values, class) ->
    weights (dim x classes); exact zeros wherever |z| <= l1.  Index dim - 1 may serve as
    a bias that every row holds."""
    z, n = np.zeros((dim, classes)), np.zeros((dim, classes))
    order = np.arange(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        for i in order:
            idx, val, y = rows[i]
            zi, ni = z[idx], n[idx]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + root) / alpha + l2))
            s = val @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            g = val[:, None] * p
            z[idx] = zi + g - (np.sqrt(ni + g * g) - root) / alpha * w
            n[idx] = ni + g * g
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


def log_losses(logits: np.ndarray, y: np.ndarray, log_t: np.ndarray) -> np.ndarray:
    """Summed log loss of softmax(logits / T) at each T."""
    out = np.zeros(len(log_t))
    for i, t in enumerate(log_t):
        s = logits / math.exp(t)
        s = s - s.max(1, keepdims=True)
        out[i] = (np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).sum()
    return out


def temperature(losses: Callable[[np.ndarray], np.ndarray], points: int = 33, rounds: int = 3) -> float:
    """The T of 0.01 to 100 with the smallest loss, from ``losses`` of log T at the points of a
    grid, then of finer ones between the best point's neighbours."""
    a, b = math.log(0.01), math.log(100.0)
    best = 0.0
    for _ in range(rounds):
        grid = np.linspace(a, b, points)
        best = float(grid[int(np.argmin(losses(grid)))])
        step = float(grid[1] - grid[0])
        a, b = best - step, best + step
    return math.exp(best)


def _logits(x: np.ndarray, blocks: list[np.ndarray]) -> np.ndarray:
    """Logits of all languages in their order; language i is column i // n of block i % n."""
    out = np.empty((len(x), sum(w.shape[1] for w in blocks)))
    for b, w in enumerate(blocks):
        out[:, b::len(blocks)] = x @ w[:-1] + w[-1]
    return out


def train(docs: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG,
          calibration_per_lang: int = CALIBRATION_PER_LANG) -> dict:
    """A model from ``text`` and ``lang``; nothing else is read.  What reaches the driver
    is bounded by the languages, not the rows: DIM frequencies, the languages, SHARDS weight
    tables a block, summed losses."""
    table = _letter_table()
    rows = docs.select(common.col("text"), common.col("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull())
    texts = rows.select("lang", F.xxhash64("text").alias("th")).distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    langs = sorted((r.lang, r.n) for r in texts.collect())
    model = {"langs": [x for x, _ in langs], "table": table}
    if not langs:
        return model
    freq = rows.select("text").mapInArrow(_frequencies(table), "bucket int, n long") \
        .groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(DIM), 0
    for bucket, n in freq:
        if bucket < 0:
            total = n
        else:
            df[bucket] = n
    idf = np.log((1 + total) / (1 + df)) + 1
    # a language's texts are sampled by a hash, at the rate that gives the bound; copies come in once
    rates = docs.sparkSession.createDataFrame(
        [(lang, i, (sample_per_lang + calibration_per_lang) / n) for i, (lang, n) in enumerate(langs)],
        "lang string, y int, rate double")
    pick = F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 30)) / float(1 << 30)
    part = calibration_per_lang / (sample_per_lang + calibration_per_lang)
    sample = rows.join(F.broadcast(rates), "lang").where(pick < F.col("rate")).distinct().select(
        "text", "y", (pick >= F.col("rate") * (1 - part)).alias("hold") if part else F.lit(False).alias("hold"),
        F.pmod(F.xxhash64("lang", "text", F.lit(1)), F.lit(SHARDS)).cast("int").alias("shard"),
        F.xxhash64("lang", "text", F.lit(2)).alias("deal"))

    def features(batches):
        for batch in batches:
            texts = batch.column("text")
            for a, b in _batches(texts):
                x = tfidf(ngram_counts(texts.slice(a, b - a).to_pylist(), table), idf)
                idx = [np.flatnonzero(r).astype(np.int32) for r in x]
                yield pa.RecordBatch.from_arrays([
                    pa.array([i.tobytes() for i in idx], pa.binary()),
                    pa.array([r[i].astype(np.float32).tobytes() for r, i in zip(x, idx, strict=True)], pa.binary()),
                    *(batch.column(c).slice(a, b - a) for c in ("y", "hold", "shard", "deal"))],
                    names=["idx", "val", "y", "hold", "shard", "deal"])

    sparse = common.checkpointed(sample.mapInArrow(
        features, "idx binary, val binary, y int, hold boolean, shard int, deal long"))
    n_langs = len(langs)
    n_blocks = -(-n_langs // BLOCK)

    def rows_of(pdf):
        out = []
        for i, v, y in zip(pdf["idx"], pdf["val"], pdf["y"], strict=True):
            i, v = np.frombuffer(i, np.int32), np.frombuffer(v, np.float32).astype(float)
            out.append((np.append(i, DIM), np.append(v, 1.0), int(y)))  # the last column is the bias
        return sorted(out, key=lambda r: (r[2], r[0].tobytes(), r[1].tobytes()))

    def fit(pdf):
        import pandas as pd
        block = int(pdf["block"].iloc[0])
        own = len(range(block, n_langs, n_blocks))
        pdf = pdf.assign(y=np.where(pdf["y"] % n_blocks == block, pdf["y"] // n_blocks, own))
        w = ftrl(rows_of(pdf), DIM + 1, own + (n_blocks > 1))
        if n_blocks > 1:  # against the class of all other languages
            w = w[:, :-1] - w[:, -1:]
        return pd.DataFrame({"block": [block], "n": [len(pdf)], "w": [w.tobytes()]})

    home = F.col("y") % n_blocks
    places = F.array(home) if n_blocks == 1 else F.array(
        home, (home + 1 + F.pmod("deal", F.lit(n_blocks - 1))) % n_blocks)
    parts = sparse.where("not hold").withColumn("block", F.explode(places.cast("array<int>"))) \
        .groupBy("block", "shard").applyInPandas(fit, "block int, n int, w binary").collect()
    if not parts:
        return {"langs": [], "table": table}
    blocks = [np.zeros((DIM + 1, len(range(b, n_langs, n_blocks)))) for b in range(n_blocks)]
    seen = np.bincount([r.block for r in parts], weights=[r.n for r in parts], minlength=n_blocks)
    for r in sorted(parts, key=lambda r: (r.block, r.n, r.w)):
        blocks[r.block] += np.frombuffer(r.w).reshape(blocks[r.block].shape) * (r.n / seen[r.block])

    def losses(log_t):
        def run(pdfs):
            import pandas as pd
            for pdf in pdfs:
                for a in range(0, len(pdf), 256):
                    held = rows_of(pdf.iloc[a:a + 256])
                    x = np.zeros((len(held), DIM + 1))
                    for k, (i, v, _) in enumerate(held):
                        x[k, i] = v
                    s = _logits(x[:, :-1], blocks)
                    yield pd.DataFrame({"k": np.arange(len(log_t)), "loss": log_losses(s, np.array([y for _, _, y in held]), log_t)})
        out = np.zeros(len(log_t))
        for k, loss in sparse.where("hold").mapInPandas(run, "k int, loss double").groupBy("k").agg(F.sum("loss")).collect():
            out[k] = loss
        return out

    some = sparse.where("hold").limit(1).count()
    return model | {"idf": idf, "weights": blocks, "temperature": temperature(losses) if some else 1.0}


def predict(docs: DataFrame, model: dict, keep: list[Column]) -> DataFrame:
    """``keep`` columns of ``docs`` with ``lang_pred`` and ``score``, from ``text`` alone."""
    langs, table = model["langs"], model["table"]
    held = docs.select(F.struct(*keep).alias("row"), common.col("text").alias("text"))
    schema = held.select("row").schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            lang, score = [], []
            for a, b in _batches(texts):
                part = texts.slice(a, b - a).to_pylist()
                known = np.array([bool(langs) and bool(t) and _LETTER.search(t) is not None for t in part], dtype=bool)
                if langs:
                    x = tfidf(ngram_counts(part, table), model["idf"])
                    s = _logits(x, model["weights"]) / model["temperature"]
                    p = np.exp(s - s.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    best = p.argmax(1)
                    lang += [langs[i] if k else "und" for i, k in zip(best, known, strict=True)]
                    score += np.where(known, p[np.arange(len(p)), best], 0.0).tolist()
                else:
                    lang += ["und"] * len(part)
                    score += [0.0] * len(part)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                names=["row", "lang_pred", "score"])
    return held.mapInArrow(run, schema).select("row.*", "lang_pred", "score")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2 (a null id: false, learned from)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def op1(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    out = held_out(F.col("doc_id"))
    model = train(docs.where(~out))
    return predict(docs, model, [F.col("doc_id"), out.alias("held_out")]) \
        .select("doc_id", "held_out", "lang_pred", "score")
