"""Ranked lexical search, byte-level BPE and spelling variants against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from plotline.llm import duckdb_bpe as bpe
from plotline.llm import rmq_search as rs
from plotline.llm import spelling_variants as sv

from .conftest import CLASHES

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ascii_lower(text: str) -> str:
    return text.encode().lower().decode()


def brute_ranks(docs, items, k=20):
    words = [(i, Counter(TERM.findall(ascii_lower(t or "")))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in words), sum(sum(c.values()) for _, c in words)
    df = Counter(t for _, c in words for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in words:
            if i is None or not c:
                continue
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                    for t in TERM.findall(ascii_lower(text or "")) if c[t])
            if s > 0:
                found.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return out


def ranks(df):
    return sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def test_rank_documents_is_exact(spark, docs_of):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["Él", "ÀB", "x_y", "日本語", "a-b"]
    weight = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = [(i, " ".join(rng.choices(vocabulary, weight, k=rng.randint(1, 40)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, " .!"), (None, "w59 w58"), (7, "w1 w2"), (7, "w1 w2"), (303, "w3 " * 30_000)]
    rows += [(400 + i, "same copy w40 w41") for i in range(90)]      # one group of copies, tied
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 25)))) for i in range(12)]
    items += [(50, "same copy w40"), (51, ""), (52, None), (53, "absent"), (54, "w0 W0 w0")]
    table = spark.createDataFrame([*items, (None, "w1")], "item_id long, text string")
    want = sorted(brute_ranks(rows, items))
    for parts in (1, 40):
        assert ranks(rs.rank_documents(docs_of(rows, CLASHES).repartition(parts), table)) == want
    assert [r for r in want if r[0] == 50][0][2] == 400


def test_rank_documents_empty_tables(spark, docs_of):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranks(rs.rank_documents(docs_of([]), items)) == []
    assert ranks(rs.rank_documents(docs_of([(1, "a")]), items.limit(0))) == []
    two = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a")], "item_id long, text string")
    assert [r[2] for r in ranks(rs.rank_documents(docs_of([(1, "a"), (2, "b"), (3, "c d")]), two))] == [1]


def one_shard(texts):
    h, ptr = rs.terms_of(pa.array(texts))
    n = len(texts)
    row = np.repeat(np.arange(n), np.diff(ptr))
    parts = [(np.arange(n, dtype=np.int64), np.ones(n, bool), np.diff(ptr).astype(np.int64), row, h)]
    return rs.Shard({c: v[0] for c, v in rs._shard(parts).items()}, n, len(h))


def test_bounds_hold_and_prune():
    rng = random.Random(1)
    groups = [[f"g{g}t{i}" for i in range(30)] for g in range(20)]
    texts = [" ".join(rng.choices(groups[d // 100], k=rng.randint(5, 30))) for d in range(2000)]
    shard = one_shard(texts)
    query = np.unique(rs.terms_of(pa.array([" ".join(groups[7][:12])]))[0])
    lists = shard.lists(query)
    weight = np.full(len(lists), 3, dtype=np.int64)
    best, rated = shard.search(lists, weight, 20)
    every = []
    for d in range(2000):
        hits = [int(shard.table[p] >> rs.SHARD_BITS) for lo, hi in zip(shard.ptr[lists], shard.ptr[lists + 1])
                for p in range(lo, hi) if shard.doc[p] == d]
        every.append((-3 * sum(hits), d))
    assert best == [(-s, d) for s, d in sorted(every)[:20]]
    assert rated < 450                      # of 2,000 documents; only 100 hold a term
    kth = best[9][0]
    assert shard.search(lists, weight, 20, kth, -1)[0] == [x for x in best if x[0] > kth]
    assert shard.search(lists, weight, 20, kth, -1)[1] < rated


# ---------------------------------------------------------------- byte-level BPE

@pytest.fixture(scope="module")
def encoding():
    path = public_tokenizers.path(bpe.RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bpe.Bpe(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)


ODD = ["", None, " ", "\n\n  \t x", "it's we'LL", "a" * 5_000, "ab" * 3_000, "1234567 89", "<|endoftext|>", "\x00\x1f\x85\xa0",
       "日本語の文章です。", "🙂👩‍👩‍👧", "é", "Ελληνικά ÀÉß", "......!!!???", " x　y  ", "x" + " " * 300 + "y"]


def test_encode_equals_the_library(coder, encoding):
    rng = random.Random(2)
    alphabet = "abcdeé ñ\n\t .,'19日𝒳​" + "the ing "
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(500)]
    texts += [chr(rng.choice([rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) * 2 + " a" for _ in range(500)]
    ids, ptr = coder.encode(texts)
    for t, a, b in zip(texts, ptr, ptr[1:]):
        assert ids[a:b].tolist() == encoding.encode_ordinary(t or ""), t
    assert coder.decode(ids, ptr) == [(t or "").encode() for t in texts]


def test_encode_forgets_and_decodes_in_steps(coder, encoding, monkeypatch):
    monkeypatch.setattr(bpe, "HELD_PIECES", 3)
    monkeypatch.setattr(bpe, "STEP_PIECES", 2)
    monkeypatch.setattr(bpe, "DECODE_ROWS", 5)
    for text in ("some words and words again", "other wordings altogether"):
        ids, ptr = coder.encode([text, text])
        assert ids[:ptr[1]].tolist() == encoding.encode_ordinary(text)
        assert coder.decode(ids, ptr) == [text.encode()] * 2


def test_token_tables(spark, docs_of, encoding):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "x y"), (3, "again"), (3, "again")]
    docs = docs_of(rows, CLASHES | {"ids": "theirs", "given": "u"})
    got = Counter(tuple(r) for r in bpe.token_digests(docs).collect())
    want = Counter()
    for i, t in rows:
        ids = encoding.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
             hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
    encoded = bpe.encode_documents(docs)
    assert set(CLASHES) <= set(encoded.columns) and encoded.columns.count("ids") == 1
    back = bpe.decode_documents(encoded).select("doc_id", "text", "ids", "decoded").collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter(rows)
    assert all(bytes(r.decoded) == (r.text or "").encode() and r.ids == encoding.encode_ordinary(r.text or "") for r in back)
    assert bpe.token_digests(docs_of([])).count() == 0
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode_documents(spark.createDataFrame([([60_000],)], "ids array<int>")).collect()


# ---------------------------------------------------------------- spelling variants

def brute_words(docs, typo_of=199, least=5):
    total = Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = ascii_lower(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % typo_of == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            total[w] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= least}


def distance_one(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[p + (len(a) >= len(b)):] == b[p + (len(b) >= len(a)):]


def brute_variants(words):
    by_length = defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    near = {w: [v for n in (len(w) - 1, len(w), len(w) + 1) for v in by_length[n] if distance_one(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= 5 * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w
    return {w: (form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def variants(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_word_counts(spark, docs_of):
    rows = [(i, "Letter letters LETTERS, Élément éléments straße_straße " * 3) for i in range(400)]
    rows += [(None, "letter " * 7), (5, "letter"), (5, "letter"), (500, None), (501, ""), (502, "× 12 ÷÷÷÷÷÷ " * 6),
             (503, "longword" * 500), (504, "short tiny")]
    got = {r.word: r.n for r in sv.word_counts(docs_of(rows, CLASHES)).where("n >= 5").collect()}
    assert got == brute_words(rows)
    assert sv.spelling_variants(docs_of([])).collect() == []
    assert sv.spelling_variants(docs_of([(1, None), (2, "a b")])).collect() == []


@pytest.mark.parametrize("seed", [0, 1])
def test_near_words_and_forms(spark, seed):
    rng = random.Random(seed)
    letters = "abé"
    words = {}
    for _ in range(500):
        words["".join(rng.choices(letters, k=rng.randint(6, 8)))] = rng.choice([5, 9, 30, 200, 1100])
    # deep chains, ties, equal neighbouring letters, one key with a third of all words
    words |= {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "bbbbbbb": 9, "bbbbbb": 9}
    words |= {"prefix" + "".join(rng.choices("xyz", k=3)): rng.randint(5, 300) for _ in range(300)}
    stem = "".join(rng.choices(letters, k=38))
    for end in ("", "a", "ab", "abé", "aab", "bab", "abéé"):     # around the limit of the levels
        words[stem + end] = rng.choice([5, 40, 400])
    long_ = "".join(rng.choices("abcde", k=2_000))
    words |= {long_: 90, long_[:700] + long_[701:]: 6, long_[:1500] + "é" + long_[1501:]: 7, long_[5:]: 50}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    pairs = sv.near_words(table)
    got = Counter((r.word, r.near) for r in pairs.collect())
    want = {(a, b) for a in words for b in words if distance_one(a, b)}
    assert set(got) == want and max(got.values()) == 1
    assert variants(sv.group_variants(table, pairs)) == brute_variants(words)


def test_spelling_variants_of_documents(spark, docs_of):
    rng = random.Random(3)
    base = ["".join(rng.choices("aeinrst", k=rng.randint(6, 9))) for _ in range(40)]
    rows = [(i, " ".join(rng.choices(base, k=60))) for i in range(400)]
    rows += [(1000 + i, "common " * 40 + "comon commons Common") for i in range(60)]
    words = brute_words(rows)
    got = variants(sv.spelling_variants(docs_of(rows, CLASHES)))
    assert got == brute_variants(words)
    assert any(v[0] for v in got.values())


def test_steps_of_the_longest_words_are_few(spark, monkeypatch):
    from plotline.llm import spelling_variants as S

    long_ = "abcdefghijklmnopqrstuvwxyzabcdefghijklm"
    words = [(long_, 9), ("x" + long_[1:], 50), (long_[:20] + long_[21:], 5), (long_[:-1] + "z", 7), ("letter", 5), ("better", 30)]
    joins = []
    join = S.spread_join
    monkeypatch.setattr(S, "spread_join", lambda *a, **k: joins.append(1) or join(*a, **k))
    got = {(r.word, r.near) for r in S.near_words(spark.createDataFrame(words, "word string, n long")).collect()}
    want = {(a, b) for a, b in ((long_, w) for w, _ in words[1:4])} | {("letter", "better")}
    assert got == want | {(b, a) for a, b in want}
    assert len(joins) <= 7          # one with the edit, then at most one for each span
