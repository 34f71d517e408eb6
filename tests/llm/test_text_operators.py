from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from plotline.llm import best_fit_packing as bf
from plotline.llm import common
from plotline.llm import dart_minhash as dm
from plotline.llm import line_winnowing as lw
from plotline.llm import template_decontamination as td

from .conftest import CLASHES


def words(text: str) -> list[str]:
    return re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", text.lower())


def shingle_set(text: str) -> set:
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


# ------------------------------------------------------------------ shared helpers

def test_words_of_any_slice():
    texts = ["Héllo wörld, 12x", None, "", "  ", "a", "Ünder_score—dash", "héllo"]
    for a in range(len(texts)):
        w = common.words_of(pa.array(texts).slice(a))
        for i, t in enumerate(texts[a:]):
            raw = [w.data[s:e].tobytes().decode() for s, e in zip(w.start, w.end, strict=True)][w.ptr[i]:w.ptr[i + 1]]
            assert raw == words(t or "")
    w = common.words_of(pa.array(["b héllo", "héllo c"]))
    assert w.hash[1] == w.hash[2] and len(set(w.hash.tolist())) == 3


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] \
        + [(2000, i) for i in range(2001, 2100)] + [(7, 7)]
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert got == want
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_filter_passes_all_members(spark):
    h = np.random.default_rng(0).integers(-2 ** 63, 2 ** 63 - 1, 3000)
    bits = common.filter_bitmap(spark.createDataFrame([(int(x),) for x in h[:1500]], "x long"), "x")
    hit = common.in_filter(bits, h.view(np.uint64))
    assert hit[:1500].all() and hit[1500:].mean() < 0.01


# ------------------------------------------------------------------ near duplicates

def classes_by_force(rows: list[tuple[int, str]]) -> dict[int, int]:
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {i: shingle_set(t) if t is not None else set() for i, t in rows}
    for i, t in rows:
        for j, u in rows:
            if i < j and t is not None and u is not None:
                both = len(sets[i] & sets[j])
                if t == u or both and both >= 0.8 * len(sets[i] | sets[j]):
                    a, b = root(i), root(j)
                    parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in parent}


def near_corpus(seed: int, groups: int, size: int) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randrange(30, 200))
        for _ in range(size):
            w = list(base)
            for _ in range(int(len(w) * rng.choice([0, 0.01, 0.02, 0.04, 0.08]))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append(" ".join(w))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_near_duplicate_classes_match_force(docs_of, monkeypatch):
    monkeypatch.setattr(dm, "BLOCK", 8)  # large groups are checked block against block
    rows = near_corpus(1, 12, 14) + near_corpus(2, 1, 60)
    rows = list(enumerate(t for _, t in rows)) + [(9000, "one two"), (9001, "One, two!"), (9002, ""), (9003, ""), (9004, None), (9005, None)]
    got = {r.doc_id: r.class_id for r in dm.near_duplicate_classes(docs_of(rows, CLASHES)).collect()}
    assert got == classes_by_force(rows)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(5)
    el = common.mix64(np.arange(400, dtype=np.uint64))
    for w1, w2 in [(np.ones(300), np.ones(300)), (rng.integers(1, 6, 300), rng.integers(1, 6, 300)),
                   (rng.random(300) * 3 + 0.1, rng.random(300) * 3 + 0.1)]:
        a, b = np.zeros(400), np.zeros(400)
        a[:300], b[100:] = w1, w2
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        sig, has = dm.dart_signatures(np.concatenate([el[:300], el[100:]]), np.concatenate([w1, w2]), np.array([0, 300, 600]), k=4000)
        assert has.all() and abs((sig[0] == sig[1]).mean() - true) < 0.04
    sig, has = dm.dart_signatures(el[:1], np.ones(1), np.array([0, 0, 1]))
    assert has.tolist() == [False, True] and (sig[1] != 0).all()


def test_weighted_pairs_are_exact():
    rng = np.random.default_rng(2)
    els = [np.unique(rng.integers(0, 40, 30)).astype(np.uint32) for _ in range(30)]
    cnt = [rng.integers(1, 4, len(e)).astype(np.uint16) for e in els]
    i, j = dm.similar_pairs(els, cnt, 0.45)
    want = set()
    for x in range(30):
        for y in range(x + 1, 30):
            a, b = dict(zip(els[x].tolist(), cnt[x].tolist(), strict=True)), dict(zip(els[y].tolist(), cnt[y].tolist(), strict=True))
            low = sum(min(a.get(k, 0), b.get(k, 0)) for k in a | b)
            if low >= 0.45 * (sum(a.values()) + sum(b.values()) - low) - 1e-9:
                want.add((x, y))
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and want


def test_one_of_each_keeps_a_row_of_every_class(docs_of):
    text = " ".join(f"t{i}" for i in range(60))
    df = docs_of([(3, text), (1, text + " more"), (2, "other words stand here alone"), (None, "no id"), (5, None), (6, None)], CLASHES)
    out = dm.one_of_each(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 2, 5, 6]
    assert dm.one_of_each(docs_of([])).collect() == []


# ------------------------------------------------------------------ line winnowing

def dedup_by_force(rows: list[tuple[int, str]], n: int) -> dict[int, str]:
    seen, out = set(), {}
    for i, text in sorted(rows):
        lines = text.split("\n")
        count = [len(re.findall(r"[^\t\n\x0b\f\r ]+", x)) for x in lines]
        gone = set()
        for a in range(len(lines)):
            if count[a]:
                total = 0
                for b in range(a, len(lines)):
                    total += count[b]
                    if total >= n:
                        window = tuple(lines[a:b + 1])
                        gone |= set(range(a, b + 1)) if window in seen else set()
                        seen.add(window)
                        break
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_line_deduplication_matches_force(docs_of, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choices("abcdefgh", k=rng.randrange(0, 6))) for _ in range(9)]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randrange(1, 14)))) for i in range(60)]
    got = {r.doc_id: r.text for r in lw.deduplicate_lines(docs_of(rows), 8).collect()}
    assert got == dedup_by_force(rows, 8)


def whole_runs_by_force(rows: list[tuple[int, str]], n: int) -> dict[int, str]:
    """Every run of lines, of any length, from a line with words to one, of at least n words."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        lines = text.split("\n")
        count = [len(re.findall(r"[^\t\n\x0b\f\r ]+", x)) for x in lines]
        gone = set()
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if count[a] and count[b] and sum(count[a:b + 1]) >= n:
                    run = tuple(lines[a:b + 1])
                    gone |= set(range(a, b + 1)) if run in seen else set()
                    seen.add(run)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_whole_repeated_runs_match_force(docs_of, seed):
    rng = random.Random(seed)
    pool = ["", " "] + [" ".join(rng.choices("abcdefgh", k=k)) for k in (1, 2, 3, 4, 5, 9, 12, 15)]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randrange(1, 14)))) for i in range(60)]
    got = {r.doc_id: r.text for r in lw.deduplicate_lines(docs_of(rows), 8, whole_runs=True).collect()}
    assert got == whole_runs_by_force(rows, 8)


def test_a_short_line_after_a_long_one_goes_with_its_run(docs_of, spark):
    long, other, short = (" ".join(f"{c}{i}" for i in range(k)) for c, k in (("l", 200), ("o", 60), ("s", 30)))
    run = f"{long}\n\n{other}\n{short}"
    df = docs_of([(1, run + "\none end"), (2, "start\n" + run + "\nanother end"), (3, run)])
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, df, "").collect()}
    assert got == {1: run + "\none end", 2: "start\nanother end", 3: ""}


def test_winnowing_selects_a_shared_line_of_every_shared_run():
    h, w, ptr = lw.lines_of(pa.array(["p\nq r\ns t u\nv", "x y z\nq r\ns t u\nw"]))
    first, last, content, at = lw.winnow(h, w, ptr, 5)
    shared = {(content[k], h[at[k]]) for k in range(len(first)) if first[k] < 4} & {
        (content[k], h[at[k]]) for k in range(len(first)) if first[k] >= 4}
    assert len(shared) == 1


def test_line_deduplication_edge_cases(docs_of):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(2, long), (1, long + "\nend"), (None, "head\n" + long), (4, None), (5, ""), (6, f"{long}\n{long}"),
            (7, "w " * 200_000), (7, "w " * 200_000), (8, "a\r\nb")]
    df = docs_of(rows, CLASHES)
    out = lw.deduplicate_lines(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=str)
    assert (1, long + "\nend", len(long) + 4) in got and (2, "", 0) in got and (None, "head", 4) in got
    assert (4, None, None) in got and (5, "", 0) in got and (6, "", 0) in got and (8, "a\r\nb", 4) in got
    assert got.count((7, "w " * 200_000, 400_000)) == 2  # rows equal in id and text are one document
    assert lw.deduplicate_lines(docs_of([])).collect() == []


# ------------------------------------------------------------------ decontamination

ITEM = ("Alice buys 12 apples and 7 pears for 30 dollars while the train leaves the old station at noon "
        "and she wonders how many apples remain after the ride")


def leaks_of(docs_of, spark, rows, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r.kind for r in td.leaks(docs_of(rows, CLASHES), bench).collect()}


def test_reparameterised_questions_are_caught(docs_of, spark):
    other = ITEM.replace("Alice", "Bob").replace("12", "95").replace("7 ", "88 ").replace("30 dollars", "41 euros")
    clean = " ".join(f"word{i} plain" for i in range(40))
    got = leaks_of(docs_of, spark, [(1, "x y " + ITEM + " z"), (2, "lead in " + other), (3, clean), (4, ITEM.upper()),
                                    (5, None), (6, ""), (7, clean + " " + ITEM[:30])], [(10, ITEM), (11, None), (12, "too short")])
    assert got == {(1, 10): "exact", (2, 10): "reparameterised", (4, 10): "exact"}


def test_slots_must_be_consistent(docs_of, spark):
    item = "if 5 people share 5 loaves then how much bread does each one of the people get"
    good = item.replace("5", "9")
    bad = item.replace("5", "9", 1).replace("5", "4")  # one value of the item, two of the document
    got = leaks_of(docs_of, spark, [(1, good), (2, bad)], [(1, item)])
    assert (1, 1) in got and got[1, 1] == "reparameterised" and (2, 1) not in got


def test_slots_of_several_words_are_one(docs_of, spark):
    item = "when the shop sells 950 red hats to Alice for some coins then how many of the hats are left"
    others = [("950", "1,250"), ("950", "3.5"), ("950", "-4"), ("950", "1,250.75"), ("Alice", "Mary Ann"), ("Alice", "Mary-Ann O'Neill")]
    rows = [(i, "so it goes: " + item.replace(a, b)) for i, (a, b) in enumerate(others)]
    rows += [(10, "so it goes: " + item), (11, "lead " + item.upper()), (12, item.replace("coins", "fish").replace("shop", "man").replace("hats", "cows"))]
    got = leaks_of(docs_of, spark, rows, [(1, item), (2, item.replace("950", "7,5").replace("Alice", "Bo Li"))])
    want = {(i, 1): "reparameterised" for i in range(len(others))} | {(10, 1): "exact", (11, 1): "exact"}
    assert {k: v for k, v in got.items() if k[1] == 1} == want
    assert {k[0] for k in got if k[1] == 2} >= {*range(len(others)), 10}
    capitals = [(1, "A " * 100_000), (2, "1,000 " * 100_000 + item)]  # long runs, in linear time
    assert leaks_of(docs_of, spark, capitals, [(1, item)]) == {(2, 1): "exact"}
    span = td.leaks(docs_of(rows[:1]), spark.createDataFrame([(1, item)], "item_id long, text string")).first()
    assert (span.first_token, span.last_token) == (3, 3 + len(words(rows[0][1])) - 4)  # words of the document


def test_short_items_and_removal(docs_of, spark):
    item = "what colour is the sky over there today"
    bench = spark.createDataFrame([(1, item), (1, item)], "item_id long, text string")
    df = docs_of([(1, "so " + item + " then"), (2, "what colour is the sea"), (None, "a " + item), (4, None)], CLASHES)
    out = td.without_leaks(df, bench)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [2, 4]
    assert td.without_leaks(df, bench.limit(0)).count() == 4
    assert td.leaks(docs_of([]), bench).collect() == []


# ------------------------------------------------------------------ packing

def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer
    full, mine = Tokenizer.from_file(bf.vocabulary_path()), bf.WordTokenizer(bf.vocabulary_path())
    rng = random.Random(0)
    letters = "abcxyzABZéÉßñÑÿ×÷ªº²½0123 '.,!?%$#@&-_\n\t\r\x1c\xa0́​日本ΣσςİıǅﬁẞÅ😀"
    texts = ["", "don't WE'LL it's'S 'tis", "<|endoftext|> a<|startoftext|>b", "a" * 3000, "ΟΔΥΣΣΕΥΣ İstanbul"]
    texts += ["".join(rng.choices(letters, k=rng.randrange(1, 60))) for _ in range(1500)]
    for text, got in zip(texts, mine.ids(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == full.encode(text, add_special_tokens=False).ids, repr(text)


def check_packed(sizes: list[int], patterns, capacity: int):
    left = defaultdict(int)
    for s in sizes:
        left[s] += 1
    for n, pattern in patterns:
        assert n > 0 and sum(s * k for s, k in pattern) <= capacity
        for s, k in pattern:
            left[s] -= n * k
    assert not any(left.values())
    return sum(n for n, _ in patterns)


def optimum(sizes: list[int], capacity: int) -> int:
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k, room in enumerate(bins):
            if room >= sizes[i] and room not in bins[:k]:
                go(i + 1, [*bins[:k], room - sizes[i], *bins[k + 1:]])
        go(i + 1, [*bins, capacity - sizes[i]])
    go(0, [])
    return best


def test_dominance_never_costs_a_sequence():
    rng = random.Random(1)
    for _ in range(250):
        capacity = rng.randrange(6, 20)
        sizes = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(0, 10))]
        count = np.bincount(sizes, minlength=capacity + 1) if sizes else np.zeros(capacity + 1, np.int64)
        rest = count.copy()
        fixed = bf.dominance(rest, capacity)
        left = [s for s in range(capacity + 1) for _ in range(rest[s])]
        assert sum(n for n, _ in fixed) + optimum(left, capacity) == optimum(sizes, capacity)


def best_fit_by_force(sizes: list[int], capacity: int) -> int:
    bins: list[int] = []
    for s in sorted(sizes, reverse=True):
        fit = [k for k, room in enumerate(bins) if room >= s]
        if fit:
            k = min(fit, key=lambda k: bins[k])
            bins[k] -= s
        else:
            bins.append(capacity - s)
    return len(bins)


def test_best_fit_by_patterns_is_best_fit():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.randrange(5, 60)
        sizes = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(0, 300))]
        count = np.bincount(sizes, minlength=capacity + 1) if sizes else np.zeros(capacity + 1, np.int64)
        used = check_packed(sizes, bf.best_fit(count.copy(), capacity), capacity)
        assert used == best_fit_by_force(sizes, capacity)
        both = check_packed(sizes, bf.plan({s: n for s, n in enumerate(count.tolist()) if n}, capacity), capacity)
        assert both >= -(-sum(sizes) // capacity)


def test_packed_documents(docs_of):
    rows = [(i, "some words here " * (i % 40)) for i in range(120)] + [(500, None), (501, ""), (502, "word " * 9000),
                                                                       (None, "no id"), (3, "some words here " * 3)]
    df = docs_of(rows, CLASHES)
    pieces = bf.tokenised(df, with_ids=True)
    out = bf.pack(pieces).collect()
    by_seq = defaultdict(list)
    for r in out:
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length and 1 <= r.length <= 4096
        by_seq[r.sequence_id].append(r)
    for got in by_seq.values():
        at = 0
        for r in sorted(got, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    total = sum(r.length for r in out)
    assert len(by_seq) <= -(-total // 4096) + 1
    long = sorted((r.piece, r.start, r.length) for r in out if r.doc_id == 502)
    assert [x[:2] for x in long] == [(0, 0), (1, 4096), (2, 8192)] and sum(x[2] for x in long) == 9001
    assert [r.length for r in out if r.doc_id in (500, 501)] == [1, 1]
    whole = {r.sequence_id: r.ids for r in bf.sequences(bf.pack(pieces)).collect()}
    assert sum(map(len, whole.values())) == 4 * total and all(x.endswith(b"\x01\0\0\0") or len(x) == 16384 for x in whole.values())
    assert bf.pack_documents(docs_of([])).collect() == []
