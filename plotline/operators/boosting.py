"""Regularised gradient-boosted trees on DataFrames (squared error, second-order gain).

The table is binned once: numbers by all their distinct values where there are few, else
by quantiles of a sketch, categories by a code of their level.  The binned rows are kept
as blocks.  Growing one level of a tree is one aggregation over the blocks: each task sums
gradients and row counts by (node, feature, bin) and the sums are added up; the driver
sees nodes x bins numbers a task, whatever the rows.  Up to ``BLOCK_ROWS`` rows need no
other task, so their trees are all grown in one job.

With G and H the sums of gradients and hessians of a node's rows (H counts rows here),
T the soft threshold by ``alpha``:  leaf weight ``-T(G) / (H + lam)``, score
``T(G)**2 / (H + lam)``, gain of a split = the children's scores less the node's.  A split
keeps ``min_child`` hessian on either side; missing numbers go to the side with the higher
gain.  Grown trees are pruned from the leaves up where the gain is below ``gamma``.  Rows
(``subsample``) and columns (``colsample``, a category's levels count as one column each)
are drawn for each tree from hashes, so a retried task draws the same rows.  Gradients are
rounded to a fixed grid on which all sums are exact: for given bins the trees depend
neither on the partitions nor on the order of addition.

A category's split sends one level right and all others left, as a 0/1 column would; the
columns themselves are never formed.  Every level has its column, whatever their number: the
sums of the ``width`` most frequent ones go through the driver like those of a number; the
rows of rarer ones lie once more by level, so the task that holds a level has its whole sums
and sends only its best split of each node.  Unseen and missing levels have no column set, as
an unseen level of a one-hot encoder that ignores unknown values.

Of two children the sums of the one with fewer rows are added up, those of the other are the
parent's less these: on the grid both ways give the same numbers.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline.operators.joins import spread_join
from plotline.operators.ordering import dense_codes
from plotline.session import ensure_checkpoint_dir

MAX_BINS = 256
#: Rank error of the sketch that cuts columns of many values.
SKETCH_ERROR = 0.0005
#: Levels of a category whose sums go through the driver; the rows of each rarer level lie in
#: one block, which finds the best split of its levels.
MAX_LEVELS = 4096
#: Values of a column of mixed codes.
PACKED = 1024
#: Sums of rarer levels that a task holds at once.
RARE_SUMS = 1 << 20
#: Least gain of a split, as in the published implementation.
LEAST_GAIN = 1e-6
#: Rows that one task boosts by itself.
BLOCK_ROWS = 1 << 20
#: Rows of a block, whose interim arrays fit a cache.
CACHED_ROWS = 1 << 16
#: Trees after which the blocks are checkpointed.
FOLD_TREES = 32


@dataclass(frozen=True)
class BoostParams:
    rounds: int = 500
    depth: int = 6
    rate: float = 0.3
    lam: float = 1.0
    alpha: float = 0.0
    gamma: float = 0.0
    min_child: float = 1.0
    subsample: float = 1.0
    colsample: float = 1.0
    seed: int = 42


@dataclass
class Tree:
    """Nodes in heap order (children of i: 2i + 1, 2i + 2); ``feature`` -1 is a leaf."""

    feature: np.ndarray
    code: np.ndarray
    missing_left: np.ndarray
    gain: np.ndarray
    weight: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n), np.zeros(n))

    def stepper(self, codes: np.ndarray, n_numeric: int):
        """A function from each row's node to the child it goes to (a leaf stays)."""
        inner, number = self.feature >= 0, self.feature < n_numeric
        column = np.maximum(self.feature, 0)
        # codes from ``low`` on for ``span`` more: left for a number, right for a category
        low = np.where(number, np.where(self.missing_left, 0, 1), self.code)
        span = self.code - low
        at = np.arange(len(self.feature))
        within = np.where(number, 2 * at + 1, 2 * at + 2)
        child = np.stack([np.where(inner, 4 * at + 3 - within, at), np.where(inner, within, at)], 1).ravel()
        flat, row = codes.ravel(), np.arange(len(codes)) * codes.shape[1]

        def step(node: np.ndarray) -> np.ndarray:
            c = flat.take(row + column.take(node)) - low.take(node)
            return child.take(2 * node + ((c >= 0) & (c <= span.take(node))))
        return step

    def leaves(self, codes: np.ndarray, n_numeric: int) -> np.ndarray:
        node, step = np.zeros(len(codes), dtype=np.int64), self.stepper(codes, n_numeric)
        if self.feature[0] >= 0:
            for _ in range(int(np.log2(len(self.feature) + 1)) - 1):
                node = step(node)
        return node


def _mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _drawn(key: np.ndarray, share: float, seed: int, round_: int) -> np.ndarray:
    if share >= 1:
        return np.ones(len(key), dtype=bool)
    salt = np.uint64((seed * 1_000_003 + round_ + 1) * 0x9E3779B97F4A7C15 % 2 ** 64)
    return _mix(key.view(np.uint64) ^ _mix(np.array([salt]))[0]) < np.uint64(min(int(share * 2 ** 64), 2 ** 64 - 1))


def drawn_columns(params: BoostParams, columns: int, round_: int) -> np.ndarray:
    """Which columns (numbers, then each category's levels) a tree may split on."""
    keep = np.zeros(columns, dtype=bool)
    if columns:
        rng = np.random.default_rng([params.seed, round_])
        keep[rng.permutation(columns)[:max(1, int(params.colsample * columns))]] = True
    return keep


def soft(g, alpha: float):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def _gains(lg, lh, total_g, total_h, params: BoostParams):
    """Gains of splits by the sums of their left sides, -inf where a side is too small."""
    def score(a, b):
        return (soft(a, params.alpha) if params.alpha else a) ** 2 / (b + params.lam)

    rg, rh = total_g - lg, total_h - lh
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = score(lg, lh) + score(rg, rh) - score(total_g, total_h)
    return np.where((lh >= params.min_child) & (rh >= params.min_child) & (lh > 0) & (rh > 0), gain, -np.inf)


def best_splits(g: list[np.ndarray], h: list[np.ndarray], layout: _Layout, columns: np.ndarray,
                params: BoostParams, rare: dict[int, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Arrays (gain, feature, code, missing left, left G, left H) over nodes from their sums
    by (feature, code); feature -1 where there is no split.  ``rare``: for a category the best
    of its rarer levels by node (gain, code, G, H).  Ties: first feature, then missing right,
    then least code."""
    total_g, total_h = g[0].sum(1, keepdims=True), h[0].sum(1, keepdims=True)
    n, rows = len(total_g), np.arange(len(total_g))
    best = [np.full(n, LEAST_GAIN), np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n), np.zeros(n)]

    def take(*found) -> None:
        better = found[0] > best[0]
        for k, x in enumerate(found):
            best[k] = np.where(better, x, best[k])

    for f, (gf, hf) in enumerate(zip(g, h)):
        if f < layout.n_numeric:
            if not columns[f] or gf.shape[1] < 3:
                continue
            lg, lh = np.cumsum(gf[:, 1:-1], 1), np.cumsum(hf[:, 1:-1], 1)
            sides = [(lg, lh, False)]
            if hf[:, 0].any():      # a node without missing numbers has the same gains here, which do not win
                sides.append((lg + gf[:, :1], lh + hf[:, :1], True))
            for a, b, missing_left in sides:
                gain = _gains(a, b, total_g, total_h, params)
                i = gain.argmax(1)
                take(gain[rows, i], f, i + 1, missing_left, a[rows, i], b[rows, i])
            continue
        place, at = layout.places[f - layout.n_numeric], layout.first[f - layout.n_numeric]
        on = np.flatnonzero(columns[at + place - 1])
        top = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        if len(on):
            a, b = total_g - gf[:, on + 1], total_h - hf[:, on + 1]
            gain = _gains(a, b, total_g, total_h, params)
            i = gain.argmax(1)
            top = gain[rows, i], place[on[i]], a[rows, i], b[rows, i]
        if f - layout.n_numeric in rare:
            gain, code, rg, rh = rare[f - layout.n_numeric]
            better = (gain > top[0]) | ((gain == top[0]) & (code < top[1]))
            other = gain, code.astype(np.int64), total_g[:, 0] - rg, total_h[:, 0] - rh
            top = tuple(np.where(better, x, y) for x, y in zip(other, top))
        take(top[0], f, top[1], True, top[2], top[3])
    return tuple(best)


def prune(tree: Tree, gamma: float) -> None:
    """Take back splits of two leaves whose gain is below ``gamma``, from the leaves up."""
    for i in range(len(tree.feature) // 2 - 1, -1, -1):
        if tree.feature[i] >= 0 and tree.feature[2 * i + 1] < 0 and tree.feature[2 * i + 2] < 0 and tree.gain[i] < gamma:
            tree.feature[i] = -1


# ------------------------------ binning -------------------------------------------

def cuts_of(df: DataFrame, numeric: Sequence[str], bins: int = MAX_BINS) -> list[list[float]]:
    """For each number, the least values of its bins but the first: all distinct values
    where there are at most ``bins - 1``, else quantiles of a sketch (one pass for all)."""
    def run(batches):
        """The distinct values of a task's rows, at most ``bins`` of each number."""
        seen = [np.empty(0) for _ in numeric]
        for batch in batches:
            for j in range(len(seen)):
                if len(seen[j]) < bins:
                    x = batch.column(j).to_numpy(zero_copy_only=False)
                    seen[j] = np.union1d(seen[j], x[~np.isnan(x)])[:bins]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(seen)), [len(v) for v in seen]), pa.int32()),
                                          pa.array(np.concatenate(seen), pa.float64())], names=["j", "v"])

    numeric = list(numeric)
    out: list[list[float]] = [[] for _ in numeric]
    if not numeric:
        return out
    found = (df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"_{j}") for j, c in enumerate(numeric)])
             .mapInArrow(run, "j int, v double").groupBy("j")
             .agg(F.slice(F.sort_array(F.collect_set("v")), 1, bins).alias("vs")).collect())
    wide = [numeric[r.j] for r in found if len(r.vs) >= bins]
    for r in found:
        out[r.j] = list(r.vs)[1:] if len(r.vs) < bins else []
    if wide:
        clean = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in wide])
        found = clean.approxQuantile(wide, [0.0] + [i / (bins - 1) for i in range(1, bins - 1)], SKETCH_ERROR)
        for c, values in zip(wide, found):
            out[numeric.index(c)] = [v for v in sorted(set(values[1:])) if v > values[0]]
    return out


def level_codes(df: DataFrame, column: str, width: int = MAX_LEVELS) -> tuple[list[str], list[int], int, DataFrame | None]:
    """The code of a level is its place among all levels in order of name, from 1.  Returns the
    ``width`` most frequent levels (ties by name) in this order, their codes, the number of all
    levels, and the codes of the rarer ones (``_v``, ``_k``), if any, as a table."""
    counts = (df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("_v"))
              .agg(F.count(F.lit(1)).alias("_n")))
    top = [r._v for r in counts.orderBy(F.desc("_n"), "_v").limit(width + 1).collect()]
    if len(top) <= width:
        return sorted(top), list(range(1, len(top) + 1)), len(top), None
    codes = dense_codes(counts, "_v").select("_v", (F.col("code") + 1).cast("int").alias("_k"))
    frequent = F.broadcast(df.sparkSession.createDataFrame([(v,) for v in top[:width]], "_v string"))   # width rows
    rare = codes.join(frequent, "_v", "left_anti").checkpoint(eager=True)
    found = sorted((r._k, r._v) for r in codes.join(frequent, "_v").collect())
    return [v for _, v in found], [k for k, _ in found], rare.count() + width, rare


class _Layout:
    """How a block holds codes.  Numbers' codes and the places of frequent levels (0: none)
    are mixed by radix into few columns, as long as a column has at most ``PACKED`` values; the
    codes of a category's rarer levels (0: none) are a column of their own."""

    def __init__(self, cuts: Sequence[Sequence[float]], places: Sequence[Sequence[int]], sizes: Sequence[int]):
        self.cuts, self.places = [np.array(c, np.float64) for c in cuts], [np.array(p, np.int64) for p in places]
        self.sizes, self.n_numeric = list(sizes), len(self.cuts)
        #: columns before each category's levels, which are one column each
        self.first = self.n_numeric + np.cumsum([0, *self.sizes])
        self.widths = [len(c) + 2 for c in self.cuts] + [len(p) + 1 for p in self.places]
        self.start = np.cumsum([0, *self.widths])
        self.rare = [i for i, (p, n) in enumerate(zip(self.places, self.sizes)) if len(p) < n]
        self.packs: list[list[int]] = []
        self.values: list[int] = []
        for f in sorted(range(len(self.widths)), key=lambda f: (-self.widths[f], f)):
            for j, n in enumerate(self.values):
                if n * self.widths[f] <= PACKED:
                    self.packs[j].append(f)
                    self.values[j] *= self.widths[f]
                    break
            else:
                self.packs.append([f])
                self.values.append(self.widths[f])
        self.at: dict[int, tuple[int, int]] = {}                # column and step of a feature's code
        for j, fs in enumerate(self.packs):
            step = self.values[j]
            for f in fs:
                step //= self.widths[f]
                self.at[f] = j, step
        self.columns = len(self.packs) + len(self.rare)

    def encode(self, numbers: np.ndarray, categories: np.ndarray) -> list[np.ndarray]:
        """The columns of rows with these numbers (nan: missing) and codes of categories."""
        out = [np.zeros(len(numbers), np.int64) for _ in self.packs]
        rarer = []
        for f in range(len(self.widths)):
            if f < self.n_numeric:
                known = ~np.isnan(numbers[:, f])
                code = np.where(known, 1 + np.searchsorted(self.cuts[f], numbers[:, f], side="right"), 0)
            else:
                i = f - self.n_numeric
                code, place = categories[:, i].astype(np.int64), self.places[i]
                where = np.searchsorted(place, code)
                found = np.append(place, -1)[where] == code
                if i in self.rare:
                    rarer.append(np.where(found, 0, code).astype(np.int32))
                code = np.where(found, where + 1, 0)
            j, step = self.at[f]
            out[j] += code * step
        return [x.astype(np.min_scalar_type(max(n - 1, 0))) for x, n in zip(out, self.values)] + rarer

    def router(self, tree: Tree, depth: int):
        """A function from a block's columns and a table over the nodes of a tree of ``depth``
        levels to the table's entry for the node that each row ends in.  Every value of a
        column has a set of the leaves that its rows can reach as bits; a row ends in the
        first leaf that is in the sets of all its columns."""
        leaves = 1 << depth
        words, place = max(1, leaves >> 6), np.arange(leaves)
        ends, tables = np.zeros(leaves, np.int64), {}
        for d in range(depth):
            ends = np.where(tree.feature[ends] >= 0, 2 * ends + 1 + (place >> (depth - 1 - d) & 1), ends)
        for node in np.flatnonzero(tree.feature[:leaves - 1] >= 0):
            d = int(node + 1).bit_length() - 1
            half = leaves >> (d + 1)
            left = int(node + 1 - (1 << d)) * 2 * half          # its left leaves: as many as ``half`` from here
            f, c = int(tree.feature[node]), int(tree.code[node])
            j, step = self.at[f]
            if f < self.n_numeric:
                right = np.arange(self.widths[f]) > c
                right[0] = not tree.missing_left[node]
            else:
                i = f - self.n_numeric
                k = int(np.searchsorted(self.places[i], c))
                right = np.zeros(self.widths[f], bool)
                if k < len(self.places[i]) and self.places[i][k] == c:
                    right[k + 1] = True
                else:
                    j, step, right = len(self.packs) + self.rare.index(i), 1, np.arange(1)
                    right = np.array([c])                       # one value of the column of rarer codes
            if j not in tables:
                size = self.values[j] if j < len(self.packs) else self.sizes[self.rare[j - len(self.packs)]] + 1
                tables[j] = np.full((words, size), ~np.uint64(0))
            width = self.widths[f] if j < len(self.packs) else tables[j].shape[1]
            for w in range(left >> 6, max(left >> 6, (left + half - 1) >> 6) + 1):
                bits = ~np.uint64(0) if half >= 64 else np.uint64(((1 << half) - 1) << (left & 63))
                tables[j][w].reshape(-1, width, step)[:, right] &= ~bits

        def route(columns: Sequence[np.ndarray], of: np.ndarray) -> np.ndarray:
            if not tables:
                return np.full(len(columns[0]), of[0])
            end = None
            for w in range(words - 1, -1, -1):
                reach = None
                for j, t in tables.items():
                    x = t[w].take(columns[j])
                    reach = x if reach is None else np.bitwise_and(reach, x, out=reach)
                low = np.bitwise_count(~reach & (reach - np.uint64(1)))      # 64 where no leaf of this word is left
                end = low if words == 1 else low + 64 * w if end is None else np.where(reach != 0, low + np.int64(64 * w), end)
            return of[ends].take(end)
        return route


@dataclass
class BoostedTrees:
    """A fitted ensemble: ``predict`` adds its prediction to a table."""

    numeric: list[str]
    categorical: list[str]
    cuts: list[list[float]]
    #: a category's frequent levels, their codes and the number of all its levels
    levels: list[list[str]]
    places: list[list[int]]
    sizes: list[int]
    base: float
    params: BoostParams
    trees: list[Tree] = field(default_factory=list)
    errors: list[float] = field(default_factory=list)
    #: the codes of the rarer levels that a split takes, and of all rarer levels as a table
    split: list[dict[str, int]] = field(default_factory=list)
    rare: list[DataFrame | None] = field(default_factory=list)

    def _coded(self, df: DataFrame, every: bool = False) -> DataFrame:
        """``df`` with ``_x`` (numbers) and ``_c`` (codes of the categories, 0: none).  Rarer
        levels have a code where a split takes them (a table of one row a split at most), with
        ``every`` all have one, also as ``_r<category>``."""
        out, codes, rarer = df, [], {}
        for i, (c, vs, ks) in enumerate(zip(self.categorical, self.levels, self.places)):
            pairs = [*zip(vs, ks), *(self.split[i].items() if self.split else ())]
            table = df.sparkSession.createDataFrame(pairs, f"_v{i} string, _k{i} int")
            out = out.join(F.broadcast(table), F.col(c).cast("string") == F.col(f"_v{i}"), "left").drop(f"_v{i}")
            codes.append(F.col(f"_k{i}"))
            if every and self.rare and self.rare[i] is not None:
                out = out.withColumn(f"_v{i}", F.when(F.col(f"_k{i}").isNull(), F.col(c).cast("string")))
                out = spread_join(out, self.rare[i].toDF(f"_v{i}", f"_r{i}"), [f"_v{i}"], "left").drop(f"_v{i}")
                codes[-1], rarer[i] = F.coalesce(f"_k{i}", f"_r{i}"), f"_r{i}"
        return out.select(
            *df.columns, F.array(*[F.col(c).cast("double") for c in self.numeric]).cast("array<double>").alias("_x"),
            F.array(*[F.coalesce(k, F.lit(0)) for k in codes]).cast("array<int>").alias("_c"), *rarer.values())

    def _codes(self, x: pd.Series, c: pd.Series) -> np.ndarray:
        n = len(x)
        numbers = np.array(x.tolist(), dtype=np.float64).reshape(n, len(self.numeric))
        out = [np.where(np.isnan(v), 0, 1 + np.searchsorted(np.array(cuts), v, side="right")) for cuts, v in zip(self.cuts, numbers.T)]
        return np.column_stack([*out, np.array(c.tolist(), dtype=np.int64).reshape(n, len(self.categorical))])

    def predict(self, df: DataFrame, output: str = "prediction", known: bool = False) -> DataFrame:
        """``df`` with its prediction.  ``known``: a category without a code raises."""
        numbers, base, depth, trees = len(self.numeric), self.base, self.params.depth, self.trees
        taken = [sorted({int(c) for t in trees for c in t.code[t.feature == numbers + i]}) for i in range(len(self.categorical))]
        layout = _Layout(self.cuts, taken, [len(v) for v in taken])

        @F.pandas_udf("double")
        def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            routes = [(layout.router(tree, depth), tree.weight) for tree in trees]
            for values in batches:
                held = [v.to_numpy() for v in (values if isinstance(values, tuple) else (values,))]     # one column comes bare
                n, total = len(held[0]), np.zeros(len(held[0]))
                columns = layout.encode(np.column_stack([*held[:numbers], np.zeros((n, 0))]).astype(np.float64),
                                        np.column_stack([*held[numbers:], np.zeros((n, 0))]).astype(np.int64))
                for route, weight in routes:
                    total += route(columns, weight)
                yield pd.Series(base + total)

        coded = self._coded(df, every=known)
        if known:
            coded = coded.withColumn("_c", F.when(F.array_contains("_c", 0), F.raise_error(F.lit(
                "a category has a level that the model was not fitted on")).cast("array<int>")).otherwise(F.col("_c")))
        values = [F.col("_x")[i] for i in range(numbers)] + [F.col("_c")[i] for i in range(len(self.categorical))]
        return coded.withColumn(output, score(*values)).select(*[c for c in df.columns if c != output], output)

    def importance(self, kind: str = "gain") -> list[tuple[str, float]]:
        """(column, value), largest first (ties by name), columns never used left out.
        ``gain``: mean gain of a column's splits as a share of all columns' means;
        ``weight``: number of its splits."""
        n, total, count = len(self.numeric), {}, {}
        names = [{k: v for v, k in [*zip(vs, ks), *(self.split[i].items() if self.split else ())]}
                 for i, (vs, ks) in enumerate(zip(self.levels, self.places))]
        for t in self.trees:
            for i in np.flatnonzero(t.feature >= 0):
                f = int(t.feature[i])
                at = self.numeric[f] if f < n else f"{self.categorical[f - n]}={names[f - n][int(t.code[i])]}"
                total[at], count[at] = total.get(at, 0.0) + float(t.gain[i]), count.get(at, 0) + 1
        value = {k: float(count[k]) if kind == "weight" else total[k] / count[k] for k in count}
        if kind != "weight" and (whole := sum(value.values())) > 0:
            value = {k: v / whole for k, v in value.items()}
        return sorted(value.items(), key=lambda r: (-r[1], r[0]))

    def save(self, spark: SparkSession, path: str) -> None:
        """One text row of JSON, and one Parquet row for each node in use, below ``path``."""
        head = {"numeric": self.numeric, "categorical": self.categorical, "cuts": self.cuts, "levels": self.levels,
                "places": self.places, "sizes": self.sizes, "split": self.split, "base": self.base, "params": asdict(self.params), "errors": self.errors, "trees": len(self.trees)}
        spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.text(f"{path}/head")
        rows = []
        for k, t in enumerate(self.trees):
            live = [0]
            for i in live:
                rows.append((k, i, int(t.feature[i]), int(t.code[i]), bool(t.missing_left[i]), float(t.gain[i]),
                             float(t.weight[i])))
                if t.feature[i] >= 0:
                    live += [2 * i + 1, 2 * i + 2]
        spark.createDataFrame(rows, "tree int, node int, feature int, code int, missing_left boolean, "
                                    "gain double, weight double").write.parquet(f"{path}/nodes")
        for i, table in enumerate(self.rare):
            if table is not None:
                table.write.parquet(f"{path}/rare_{i}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedTrees:
        head = json.loads(spark.read.text(f"{path}/head", wholetext=True).first().value)
        params = BoostParams(**head.pop("params"))
        trees = [Tree.empty(params.depth) for _ in range(head.pop("trees"))]
        for r in spark.read.parquet(f"{path}/nodes").collect():
            t = trees[r.tree]
            t.feature[r.node], t.code[r.node], t.missing_left[r.node] = r.feature, r.code, r.missing_left
            t.gain[r.node], t.weight[r.node] = r.gain, r.weight
        rare = [spark.read.parquet(f"{path}/rare_{i}") if len(v) < n else None
                for i, (v, n) in enumerate(zip(head["levels"], head["sizes"]))]
        return BoostedTrees(**head, params=params, trees=trees, rare=rare)


# ------------------------------ fitting -------------------------------------------

def _on(block: dict, params: BoostParams, round_: int) -> dict:
    """A block with the rows drawn for a round (none named: all of them)."""
    on = None
    if "key" in block:
        on = _drawn(block["key"], params.subsample, params.seed, round_)
    if "valid" in block:
        on = ~block["valid"] if on is None else on & ~block["valid"]
    return block if on is None else block | {"on": on}


def _by_level(block: dict, layout: _Layout, i: int) -> dict | None:
    """The rows of a block whose level of a category is a rarer one, with its place among the
    levels of the block."""
    code = block[f"c{len(layout.packs) + layout.rare.index(i)}"]
    at = np.flatnonzero(code)
    if not len(at):
        return None
    levels, place = np.unique(code[at], return_inverse=True)
    return {k: v[at] for k, v in block.items()} | {"category": i, "levels": levels, "place": place.astype(np.int32)}


def _blocks(model: BoostedTrees, table: DataFrame, size: int, layout: _Layout):
    """The binned rows of a checkpointed table as an RDD of blocks (arrays by name: key where
    rows are drawn, validation flag, prediction less label, columns of codes), the number of
    its parts, and a further RDD of rows by rarer level, if any."""
    params, base = model.params, model.base
    sc = table.sparkSession.sparkContext
    rows_of = min(BLOCK_ROWS, CACHED_ROWS)
    parts = 1 if size <= BLOCK_ROWS else max(1, min(sc.defaultParallelism, -(-size // rows_of)))

    def pack(batches):
        for b in batches:
            key, y, valid = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            numbers, categories = (b.column(i).flatten().to_numpy(zero_copy_only=False).reshape(len(y), k)
                                   for i, k in ((3, layout.n_numeric), (4, len(layout.places))))
            block = {"res": base - y, "valid": valid}
            if params.subsample < 1:
                block["key"] = key
            block |= {f"c{j}": x for j, x in enumerate(layout.encode(numbers.astype(np.float64), categories))}
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], names=["block"])

    def whole(held: list[dict]) -> dict:
        block = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        if not block["valid"].any():
            del block["valid"]
        return _on(block, params, 0)

    def join(rows):
        held = []
        for r in rows:
            held.append(pickle.loads(r[0]))
            if sum(len(h["res"]) for h in held) >= rows_of:
                yield whole(held)
                held.clear()
        if held:
            yield whole(held)

    def join_levels(rows, i):
        held = [pickle.loads(r[0]) for r in rows]
        if held:
            yield _by_level(whole(held), layout, i)

    def packed(df):
        return df.select("_key", "_y", "_valid", "_x", "_c").mapInArrow(pack, "block binary").rdd

    spread = table.coalesce(parts) if table.rdd.getNumPartitions() >= parts else table.repartition(parts)
    coded = model._coded(spread, every=True)
    if not layout.rare:
        return packed(coded).mapPartitions(join), parts, None
    coded = coded.checkpoint(eager=True)
    blocks = packed(coded.coalesce(parts) if coded.rdd.getNumPartitions() >= parts else coded.repartition(parts)).mapPartitions(join)
    if size <= BLOCK_ROWS:
        return blocks, parts, None
    # all rows of a level are in one part
    n = max(parts, -(-size // BLOCK_ROWS))
    levels = [packed(coded.where(f"_r{i} IS NOT NULL").repartition(n, f"_r{i}")).mapPartitions(lambda rows, i=i: join_levels(rows, i))
              for i in layout.rare]
    return blocks, parts, sc.union(levels)


def _columns(block: dict, layout: _Layout) -> list[np.ndarray]:
    return [block[f"c{j}"] for j in range(layout.columns)]


def _taken(blocks, tree: Tree, grower: _Grower, round_: int):
    """Blocks with a further tree in their predictions, and the rows drawn for the next."""
    route = grower.layout.router(tree, grower.params.depth)
    for block in blocks:
        yield _on(block | {"res": block["res"] + route(_columns(block, grower.layout), tree.weight)}, grower.params, round_)


def _merged(a: tuple, b: tuple) -> tuple:
    """Sums of two tasks added up, and the better splits of their rarer levels."""
    rare = dict(a[4])
    for i, y in b[4].items():
        x = rare.get(i)
        rare[i] = y if x is None else np.where((y[0] > x[0]) | ((y[0] == x[0]) & (y[1] < x[1])), y, x)
    return (*(x + y for x, y in zip(a[:4], b[:4])), rare)


@dataclass
class _Grower:
    """How trees are grown from sums over blocks, wherever these lie."""

    params: BoostParams
    layout: _Layout
    grid: float
    most: float

    def __post_init__(self):
        self.n_columns = int(self.layout.first[-1])

    def sums(self, blocks, tree: Tree, depth: int, round_: int, todo: list[int], nodes: list[int], totals) -> tuple:
        """Over some blocks: the sums of gradients (on the grid) and of rows by (node of
        ``todo``, feature, bin), the number and squared error of validation rows (of the root
        alone), and the best splits of ``nodes``, whose sums are ``totals``, by rarer level."""
        me = self.layout
        g, h = ([np.zeros(len(todo) * n) for n in me.values] for _ in range(2))
        seen, error, rare = 0, 0.0, {}
        route = me.router(tree, depth) if depth else None
        slots = np.full(2 ** (depth + 1) - 1, -1)
        slots[todo] = np.arange(len(todo))
        for block in blocks:
            if "levels" in block:
                rare = _merged((0, 0, 0, 0, rare), (0, 0, 0, 0, self.rare(block, route, round_, nodes, totals)))[4]
                continue
            res, columns, on = block["res"], _columns(block, me), block.get("on")
            if depth == 0:
                if np.abs(res).max(initial=0.0) > self.most:
                    raise ValueError("the predictions leave the range of the labels")
                if "valid" in block:
                    seen, error = seen + int(block["valid"].sum()), error + float((res[block["valid"]] ** 2).sum())
                at = None if on is None else np.flatnonzero(on)
            else:
                node = route(columns, slots)
                at = np.flatnonzero(node >= 0 if on is None else (node >= 0) & on)
                node = node.take(at)
            grad = np.rint((res if at is None else res.take(at)) * self.grid)
            for j, n in enumerate(me.values):
                x = columns[j] if at is None else columns[j].take(at)
                if depth:
                    x = node * n + x
                g[j] += np.bincount(x, grad, len(g[j]))
                h[j] += np.bincount(x, minlength=len(h[j]))
        out = np.zeros((2, len(todo), me.start[-1]))
        for j, fs in enumerate(me.packs):
            shape = (len(todo), *(me.widths[f] for f in fs))
            for k, f in enumerate(fs):
                others = tuple(m + 1 for m in range(len(fs)) if m != k)
                out[0, :, me.start[f]:me.start[f + 1]] = g[j].reshape(shape).sum(others)
                out[1, :, me.start[f]:me.start[f + 1]] = h[j].reshape(shape).sum(others)
        return out[0], out[1], seen, error, rare

    def rare(self, block: dict, route, round_: int, nodes: list[int], totals) -> dict[int, np.ndarray]:
        """Category -> (gain, code, G, H) of the best split by one of the block's levels, for
        each node.  The sums of some nodes at a time are held."""
        i, levels = block["category"], block["levels"]
        drawn = drawn_columns(self.params, self.n_columns, round_)[self.layout.first[i] + levels.astype(np.int64) - 1]
        columns, on = _columns(block, self.layout), block.get("on")
        slots = np.full(2 * max(nodes) + 1, -1)
        slots[nodes] = np.arange(len(nodes))
        node = np.zeros(len(block["res"]), np.int64) if route is None else route(columns, slots)
        grad = np.rint(block["res"] * self.grid)
        best = np.vstack([np.full((1, len(nodes)), -np.inf), np.zeros((3, len(nodes)))])
        if not drawn.any():
            return {i: best}
        some = max(1, RARE_SUMS // len(levels))
        for a in range(0, len(nodes), some):
            b = min(a + some, len(nodes))
            here = (node >= a) & (node < b)
            at = np.flatnonzero(here if on is None else here & on)
            x = (node.take(at) - a) * len(levels) + block["place"].take(at)
            g = np.bincount(x, grad.take(at), (b - a) * len(levels)).reshape(b - a, -1) / self.grid
            h = np.bincount(x, minlength=(b - a) * len(levels)).reshape(b - a, -1).astype(np.float64)
            total_g, total_h = totals[0][a:b, None], totals[1][a:b, None]
            gain = np.where(drawn, _gains(total_g - g, total_h - h, total_g, total_h, self.params), -np.inf)
            k, rows = gain.argmax(1), np.arange(b - a)
            best[:, a:b] = gain[rows, k], levels[k], g[rows, k], h[rows, k]
        return {i: best}

    def split(self, tree: Tree, nodes: list[int], columns: np.ndarray, g: np.ndarray, h: np.ndarray, rare: dict) -> list[int]:
        """Split the nodes by their sums; the children, left and right in turn."""
        p, start, after = self.params, self.layout.start, []
        gs = [g[:, a:b] / self.grid for a, b in zip(start, start[1:])]
        hs = [h[:, a:b] for a, b in zip(start, start[1:])]
        total_g, total_h = gs[0].sum(1), hs[0].sum(1)
        if nodes == [0]:
            tree.weight[0] = -p.rate * soft(total_g[0], p.alpha) / (total_h[0] + p.lam)
        gain, feature, code, missing_left, left_g, left_h = best_splits(gs, hs, self.layout, columns, p, rare)
        for i, node in enumerate(nodes):
            if feature[i] < 0:
                continue
            tree.gain[node], tree.feature[node], tree.code[node], tree.missing_left[node] = gain[i], feature[i], code[i], missing_left[i]
            for child, cg, ch in ((2 * node + 1, left_g[i], left_h[i]),
                                  (2 * node + 2, total_g[i] - left_g[i], total_h[i] - left_h[i])):
                tree.weight[child] = -p.rate * soft(cg, p.alpha) / (ch + p.lam)
                after.append((child, cg, ch))
        return after

    def grow(self, blocks, patience: int | None) -> tuple[list[Tree], list[float]]:
        """All rounds on ``blocks`` (``sums`` of a level, ``take`` of a tree): the trees and
        the errors on the validation rows."""
        params, trees, errors = self.params, [], []
        for round_ in range(params.rounds + 1):
            tree = Tree.empty(params.depth)
            columns = drawn_columns(params, self.n_columns, round_)
            g, h, seen, error, rare = blocks.sums(tree, 0, round_, [0], [0], None)
            if seen:
                errors.append(error / seen)
            if round_ == params.rounds or (patience and errors and round_ - int(np.argmin(errors)) >= patience):
                return trees, errors
            nodes, first = [0], slice(0, self.layout.widths[0])
            if self.layout.rare:
                totals = g[:, first].sum(1) / self.grid, h[:, first].sum(1)
                rare = blocks.sums(tree, 0, round_, [], [0], totals)[4]
            for depth in range(1, params.depth + 1):
                after = self.split(tree, nodes, columns, g, h, rare)
                if not after or depth == params.depth:
                    break
                # the sums of the smaller children; the others are their parents' less these
                todo = [int(a[2] > b[2]) for a, b in zip(after[::2], after[1::2])]
                parent = [nodes.index((a[0] - 1) // 2) for a in after[::2]]
                nodes = [a[0] for a in after]
                totals = np.array([a[1] for a in after]), np.array([a[2] for a in after])
                less = blocks.sums(tree, depth, round_, [after[2 * k + t][0] for k, t in enumerate(todo)], nodes, totals)
                rare, both = less[4], []
                for x, y in zip((g, h), less):
                    z, at = np.empty((len(nodes), x.shape[1])), 2 * np.arange(len(todo)) + todo
                    z[at], z[at ^ 1] = y, x[parent] - y
                    both.append(z)
                g, h = both
            prune(tree, params.gamma)
            trees.append(tree)
            blocks.take(tree, round_ + 1, len(trees) % FOLD_TREES == 0)
        return trees, errors


class _TaskBlocks:
    """Blocks of one task."""

    def __init__(self, grower: _Grower, blocks):
        self.grower, self.blocks, me = grower, list(blocks), grower.layout
        if me.rare:
            names = set().union(*self.blocks) - {"on"}         # a block without validation rows has no flag
            whole = {k: np.concatenate([b[k] if k in b else np.zeros(len(b["res"]), bool) for b in self.blocks]) for k in names}
            self.blocks += list(filter(None, (_by_level(_on(whole, grower.params, 0), me, i) for i in me.rare)))

    def sums(self, tree: Tree, depth: int, round_: int, todo: list[int], nodes: list[int], totals):
        # of the root, the splits by rarer level come after its sums
        held = self.blocks if depth else [b for b in self.blocks if ("levels" in b) == (totals is not None)]
        return self.grower.sums(held, tree, depth, round_, todo, nodes, totals)

    def take(self, tree: Tree, round_: int, fold: bool) -> None:
        self.blocks = list(_taken(self.blocks, tree, self.grower, round_))


class _SparkBlocks:
    """Blocks of many tasks: a level is one aggregation over them (of the root, one more for
    rarer levels).  The blocks with a new tree's predictions are kept in place of the ones
    before; those of every fold are written to the checkpoint folder."""

    def __init__(self, grower: _Grower, blocks, parts: int, levels=None):
        self.grower, self.held = grower, [b.persist(StorageLevel.MEMORY_AND_DISK) for b in (blocks, levels) if b is not None]
        self.old: list = []
        # few sums go straight to the driver, many through a level of tasks
        self.levels = 1 if parts <= 16 else 2

    def sums(self, tree: Tree, depth: int, round_: int, todo: list[int], nodes: list[int], totals):
        me = self.grower
        held = self.held[:1] if totals is None else self.held if depth else self.held[1:]
        blocks = held[0] if len(held) == 1 else held[0].context.union(held)
        total = blocks.mapPartitions(lambda b: [me.sums(b, tree, depth, round_, todo, nodes, totals)]).treeReduce(_merged, self.levels)
        if totals is not None or len(self.held) == 1:
            for b in self.old:
                b.unpersist()
            self.old = []
        return total

    def take(self, tree: Tree, round_: int, fold: bool) -> None:
        me = self.grower
        self.old, self.held = self.held, [b.mapPartitions(lambda x: _taken(x, tree, me, round_)).persist(StorageLevel.MEMORY_AND_DISK)
                                          for b in self.held]
        if fold:
            for b in self.held:
                b.checkpoint()


def fit(df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str] = (),
        params: BoostParams = BoostParams(), key: Sequence[str] | None = None, valid=None,
        patience: int | None = None, width: int = MAX_LEVELS) -> BoostedTrees:
    """Boost on the rows of ``df`` with a label.  ``valid``: a boolean column; its rows
    take no part in the fit, and with ``patience`` the rounds end that many after the
    round of the least squared error on them, whose trees are kept.  ``key``: columns that
    tell rows apart for ``subsample`` (default: all that are used).  ``width``: a category's
    levels whose sums go through the driver; the trees are the same for any.

    The columns in use are checkpointed once.  Up to ``BLOCK_ROWS`` rows are boosted by the
    task that holds them, in one job; more rows level by level over all tasks."""
    numeric, categorical = list(numeric), list(categorical)
    ensure_checkpoint_dir(df.sparkSession)
    used = [c for c in dict.fromkeys(numeric + categorical)]
    table = df.where(F.col(label).isNotNull()).select(
        F.xxhash64(*[F.col(c) for c in key or [label, *numeric, *categorical]]).alias("_key"),
        F.col(label).cast("double").alias("_y"),
        (F.coalesce(valid, F.lit(False)) if valid is not None else F.lit(False)).alias("_valid"), *used).checkpoint(eager=True)
    mine = F.when(~F.col("_valid"), F.col("_y"))
    stats = table.agg(F.count(mine).alias("n"), F.avg(mine).alias("mean"), F.max(F.abs("_y")).alias("most"),
                      F.count(F.lit(1)).alias("size")).first()
    if not stats.n:
        raise ValueError("no rows to fit on")
    train = table.where("NOT _valid")
    levels, places, sizes, rare = ([list(x) for x in zip(*found)] if (found := [level_codes(train, c, width) for c in categorical])
                                   else ([], [], [], []))
    # coarse enough to hide the order in which the mean was added up
    model = BoostedTrees(numeric, categorical, cuts_of(train, numeric), levels, places, sizes, float(f"{stats.mean:.12g}"), params,
                         rare=rare)
    most = 4.0 * max(stats.most, 1e-300)
    # sums of at most ``size`` gradients stay below 2**52 grid steps, so they are exact
    grid = 2.0 ** np.floor(np.log2(2.0 ** 52 / (most * stats.size)))
    grower = _Grower(params, _Layout(model.cuts, places, sizes), grid, most)
    blocks, parts, by_level = _blocks(model, table, stats.size, grower.layout)
    if stats.size <= BLOCK_ROWS:
        model.trees, model.errors = blocks.mapPartitions(
            lambda held: [grower.grow(_TaskBlocks(grower, held), patience)]).first()
    else:
        spread = _SparkBlocks(grower, blocks, parts, by_level)
        model.trees, model.errors = grower.grow(spread, patience)
        for b in spread.held:
            b.unpersist()
    if patience and model.errors:
        # errors[i] is the error of the first i trees; no tree at all is not a model
        model.trees = model.trees[:max(1, 1 + int(np.argmin(model.errors[1:])) if len(model.errors) > 1 else 1)]
    model.split = _split_levels(model)
    return model


def _split_levels(model: BoostedTrees) -> list[dict[str, int]]:
    """The rarer levels that a split takes, by category."""
    out = []
    for i, (places, table) in enumerate(zip(model.places, model.rare)):
        taken = {int(c) for t in model.trees for c in t.code[t.feature == len(model.numeric) + i]}.difference(places)
        codes = {}
        if taken:
            wanted = F.broadcast(table.sparkSession.createDataFrame([(c,) for c in sorted(taken)], "_k int"))   # a row a split at most
            codes = {r._v: r._k for r in table.join(wanted, "_k").collect()}
        out.append(codes)
    return out
