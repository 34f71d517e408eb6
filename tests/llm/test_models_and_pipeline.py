from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plotline.llm import importance_resampling as ir
from plotline.llm import language_id as li
from plotline.llm import license_scan as ls
from plotline.llm import queries
from plotline.llm import skip_chain_crf as crf

from .conftest import CLASHES

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ language id

def test_held_out_accuracy(spark):
    got = li.op1(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 20 and right >= 0.95
    assert got.where("score < 0 or score > 1 or score is null").count() == 0


def test_language_edge_cases(docs_of):
    en, fr = "the cat and the dog went to the house ", "le chat et le chien sont dans la maison été "
    rows = [(i, en * (1 + i % 3), "en") for i in range(30)] + [(100 + i, fr * (1 + i % 3), "fr") for i in range(30)]
    rows += [(200, None, "fr"), (201, "", "en"), (202, "12 34 !?", "fr"), (203, en, None), (203, en, None), (None, fr, "fr"), (205, en * 3000, "en")]
    df = docs_of(rows, CLASHES)
    model = li.train(df)
    assert model["langs"] == ["en", "fr"]
    got = [(r.doc_id, r.lang_pred, r.score) for r in li.predict(df, model, [F.col("doc_id")]).collect()]
    assert len(got) == len(rows)
    assert {x[1:] for x in got if x[0] in (200, 201, 202)} == {("und", 0.0)}
    assert {x[1] for x in got if x[0] in (203, 205)} == {"en"} and [x[1] for x in got if x[0] is None] == ["fr"]
    empty = li.train(docs_of([]))
    assert {r.lang_pred for r in li.predict(df, empty, [F.col("doc_id")]).collect()} == {"und"}
    assert li.predict(docs_of([]), model, [F.col("doc_id")]).collect() == []


def test_ftrl_matches_its_definition():
    rows = [(np.array([0, 2]), np.array([1.0, 0.5]), 0), (np.array([1, 2]), np.array([0.3, 1.0]), 1), (np.array([0]), np.array([2.0]), 0)]
    alpha, beta, l1, l2 = 0.5, 1.0, 0.05, 0.01
    z, n = np.zeros((3, 2)), np.zeros((3, 2))

    def weight(i, c):
        if abs(z[i, c]) <= l1:
            return 0.0
        return -(z[i, c] - np.sign(z[i, c]) * l1) / ((beta + np.sqrt(n[i, c])) / alpha + l2)

    order, rng = np.arange(3), np.random.default_rng(1)
    for _ in range(2):
        rng.shuffle(order)
        for k in order:
            idx, val, y = rows[k]
            w = {(i, c): weight(i, c) for i in idx for c in range(2)}
            s = [sum(v * w[i, c] for i, v in zip(idx, val, strict=True)) for c in range(2)]
            p = np.exp(s) / np.exp(s).sum()
            for i, v in zip(idx, val, strict=True):
                for c in range(2):
                    g = v * (p[c] - (c == y))
                    sigma = (np.sqrt(n[i, c] + g * g) - np.sqrt(n[i, c])) / alpha
                    z[i, c] += g - sigma * w[i, c]
                    n[i, c] += g * g
    want = np.array([[weight(i, c) for c in range(2)] for i in range(3)])
    assert np.allclose(li.ftrl(rows, 3, 2, 2, alpha, beta, l1, l2), want)


def test_temperature_finds_the_scale():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(4000, 3)) * 2
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    y = np.array([rng.choice(3, p=x) for x in p])
    assert abs(li.temperature(lambda t: li.log_losses(logits * 5, y, t)) - 5) < 0.5
    fine = np.linspace(np.log(0.01), np.log(100.0), 2001)
    best = np.exp(fine[np.argmin(li.log_losses(logits * 5, y, fine))])
    assert abs(np.log(li.temperature(lambda t: li.log_losses(logits * 5, y, t)) / best)) < 0.006


def test_more_languages_than_a_block_are_all_learned(docs_of, monkeypatch):
    rng = random.Random(4)
    words = {f"l{i:03d}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for i in range(270)}
    rows = []
    for k, (lang, w) in enumerate(words.items()):
        for j in range(6 if k >= 10 else 3):  # ten rare ones
            rows.append((k * 100 + j, " ".join(rng.choices(w, k=30)), lang))
    df = docs_of(rows)
    fresh = docs_of([(k, " ".join(rng.choices(w, k=30)), lang) for k, (lang, w) in enumerate(words.items())])

    def right(model):
        got = li.predict(fresh, model, [F.col("doc_id"), F.col("lang")]).where("lang = lang_pred").select("lang").collect()
        return len(got), sum(r.lang < "l010" for r in got)

    model = li.train(df)
    assert len(model["langs"]) == 270 and [w.shape[1] for w in model["weights"]] == [135, 135]
    monkeypatch.setattr(li, "BLOCK", 1024)  # one softmax of all
    joint = li.train(df)
    assert [w.shape[1] for w in joint["weights"]] == [270]
    (all_blocks, rare_blocks), (all_joint, rare_joint) = right(model), right(joint)
    assert all_blocks >= max(260, all_joint - 3) and rare_blocks >= rare_joint - 1 and rare_joint > 5


def test_copies_of_a_text_come_into_the_sample_once(docs_of, monkeypatch):
    seen = []
    monkeypatch.setattr(li.common, "checkpointed", lambda df: seen.append(df.count()) or df)
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["one", "two", "three", "four"], k=20)), "en") for i in range(60)]
    li.train(docs_of(rows + [(1000 + i, "the same text again and again", "en") for i in range(400)]), 1500, 300)
    assert seen[0] == len({t for _, t, _ in rows}) + 1


# ------------------------------------------------------------------ importance resampling

def weights_by_force(rows, good, smoothing):
    """Log weights from the definition, one n-gram at a time."""
    grams = {}
    for i, text in rows:
        bucket, _ = ir.ngram_buckets(pa.array([text]))
        grams[i] = bucket.tolist()
    raw, tgt = np.zeros(ir.BUCKETS), np.zeros(ir.BUCKETS)
    for i, g in grams.items():
        for b in g:
            raw[b] += 1
            tgt[b] += i in good
    p, q = ((x + smoothing) / (x + smoothing).sum() for x in (tgt, raw))
    usual = (p * np.log(p / q)).sum()
    out = {}
    for i, g in grams.items():
        own = np.bincount(g, minlength=ir.BUCKETS)
        r, t = raw - own, tgt - own * (i in good)
        share = max(t.sum(), 1) / max(r.sum(), 1)
        out[i] = sum(np.log(t[b] + smoothing * share) - np.log(r[b] + smoothing) - np.log(share) - usual for b in g)
    return out


def test_weights_and_selection_match_force(docs_of, spark):
    rng = random.Random(3)
    good_words, bad_words = [f"g{i}" for i in range(50)], [f"b{i}%%" for i in range(50)]
    rows = [(i, " ".join(rng.choices(good_words if i % 4 else bad_words, k=rng.randrange(5, 60)))) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 60)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in ir.resample(docs_of(rows, CLASHES), labels).collect()}
    want = weights_by_force(rows, {i for i in range(60) if i % 4}, ir.SMOOTHING)
    assert len(got) == 90 and all(i % 4 for i in got)
    assert all(abs(r.log_weight - want[i]) < 1e-6 for i, r in got.items())


def test_clean_documents_are_kept_alike_in_every_length_class(docs_of, spark):
    rng = random.Random(5)
    common_words, junk = [f"w{i}" for i in range(400)], [f"j{i}" for i in range(400)]
    rows, size, clean = [], {}, {}
    for i in range(400):
        size[i], clean[i] = (10, 40, 160, 640, 8000)[i % 20 // 4], i % 4 != 0
        # clean text differs a little from document to document, junk is mostly of other words
        odd = rng.uniform(0, 0.06) if clean[i] else 0.8
        rows.append((i, " ".join(rng.choice(junk if rng.random() < odd else common_words) for _ in range(size[i]))))
    labels = spark.createDataFrame([(i, int(clean[i]), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = {r.doc_id for r in ir.resample(docs_of(rows), labels).collect()}
    for n in sorted(set(size.values())):
        ids = [i for i in size if size[i] == n and clean[i]]
        assert sum(i in got for i in ids) >= 0.93 * len(ids), n
        assert not any(i in got for i in size if size[i] == n and not clean[i] and n > 100), n


@pytest.mark.parametrize("seed", range(3))
def test_kth_largest(spark, seed):
    rng = random.Random(seed)
    xs = [rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e9), 5.0]) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for k in (1, 2, 700, 1500, 3000):
        assert ir.kth_largest(df, "x", k, bins=16, few=10) == sorted(xs, reverse=True)[k - 1]
    assert ir.kth_largest(df, "x", 3001) is None and ir.kth_largest(df, "x", 0) is None


def test_gumbel_keys_sample_by_weight(spark):
    # the taken one of two documents follows the ratio of their weights over many ids
    u = spark.range(40_000).select((-F.log(-F.log((F.pmod(F.xxhash64(F.lit(1), "id", F.lit("x")), F.lit(1 << 52)) + 0.5)
                                                  / float(1 << 52)))).alias("g"), (F.col("id") % 2).alias("b"), F.floor(F.col("id") / 2).alias("pair"))
    won = u.groupBy("pair").agg(F.max(F.when(F.col("b") == 1, F.col("g") + float(np.log(3)))).alias("x"), F.max(F.when(F.col("b") == 0, F.col("g"))).alias("y"))
    assert abs(won.agg(F.avg((F.col("x") > F.col("y")).cast("int"))).first()[0] - 0.75) < 0.02


def test_resampling_edge_cases(docs_of, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = docs_of([(1, "a b"), (2, None), (3, ""), (4, " \n"), (None, "c d"), (1, "a b")], CLASHES)
    out = ir.keep_good(df, none)
    assert out.columns == df.columns and sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 1]
    nulls = spark.createDataFrame([(None, 1, 0), (1, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert ir.keep_good(df, nulls).count() == 3  # contradicted labels are not good: no target
    assert ir.keep_good(docs_of([]), nulls).collect() == []


# ------------------------------------------------------------------ license scan

def test_license_scan(spark):
    rows = [("src/LICENSE", "Released under the MIT License.", 1), ("src/a.py", "print(1)", 2), ("src/sub/deep/b.py", "x = 2", 3),
            ("src/sub/COPYING", "This work is licensed under the GNU General Public License, version 3.\nmore of it", 4),
            ("src/c.py", "# Licensed under the Apache License, Version 2.0.\ncode " + "word " * 400, 5), ("other/d.py", None, 6),
            ("other/e.py", "", 7), (None, "text", 8), ("top.py", "no license needed to read this", 9), ("src/sub/f.py", None, 10),
            ("src/g.py", "we met at the old station under the long bridge by the river and then. Licensed under CC BY-NC 4.0. and went home", 11)]
    df = spark.createDataFrame(rows, "path string, text string, `a.b` int")
    got = {r["a.b"]: (r.license, r.how, r.directory) for r in ls.scan(df).collect()}
    assert got == {
        1: ("MIT", "licence file", None), 2: ("MIT", "inherited", "src"), 3: ("GPL-3.0", "inherited", "src/sub"),
        4: ("GPL-3.0", "licence file", None), 5: ("Apache-2.0", "statement", None), 6: (None, None, None),
        7: (None, None, None), 8: (None, None, None), 9: (None, None, None), 10: ("GPL-3.0", "inherited", "src/sub"),
        11: ("CC-BY-NC-4.0", "statement", None)}
    assert ls.scan(df.limit(0)).collect() == []


def test_key_words_lose_nothing():
    df = np.random.default_rng(0).integers(0, 900, ls.DF_BUCKETS)
    m = ls.Matcher(df, 1000, ls.TEMPLATES, 0.7)
    keys = set(m.keys.tolist())
    rng = random.Random(0)
    pool = [w for t in itertools.chain(*ls.TEMPLATES.values()) for w in re.findall(r"\w+", t)]
    for _ in range(2000):
        unit = " ".join(rng.choices(pool, k=rng.randrange(1, 12)))
        if -m.best(unit)[0] >= 0.7:
            assert keys & set(ls.word_ids(unit))


def test_license_lines_of_documents_are_all_found(spark):
    got = ls.op2(spark, SF)
    said = spark.read.parquet(f"{SF}/documents.parquet").where("text rlike '(Licensed|licensed|Released) under (the|CC)'").select("doc_id")
    assert said.count() and said.join(got.where("how in ('statement', 'licence file')"), "doc_id", "left_anti").count() == 0


# ------------------------------------------------------------------ personal data

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def base_by_force(text: str):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            odd = sum(int(d) for d in digits[::-2])
            even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
            if (k == 1 and any(int(x) > 255 for x in m[0].split("."))) or (k == 2 and not (12 <= len(digits) <= 19 and (odd + even) % 10 == 0)) \
                    or (k == 3 and not 9 <= len(digits) <= 15):
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_match_the_plain_patterns():
    rng = random.Random(7)
    parts = ["a", "1", "12", "4111111111111111", ".", "@", "-", "+", " ", "(", ")", "99", "256", "x.y", "é", "\n", "%", "555 0171", "1.2.3.4"]
    for _ in range(20_000):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 16)))
        assert crf.base_spans(text) == base_by_force(text), text


def test_long_runs_are_read_in_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 3000 + ".", "1." * 100_000, "+1" + " " * 300_000, "a@" * 100_000):
        crf.base_spans(text)


def test_marginals_are_exact_on_a_tree():
    rng = np.random.default_rng(1)
    unary, pot = rng.normal(size=(4, 3)), [rng.normal(size=(3, 3)) for _ in range(3)]
    links = [(0, 1), (1, 2), (1, 3)]
    total = np.zeros((4, 3))
    for y in itertools.product(range(3), repeat=4):
        s = np.exp(sum(unary[i, y[i]] for i in range(4)) + sum(p[y[a], y[b]] for (a, b), p in zip(links, pot, strict=True)))
        for i in range(4):
            total[i, y[i]] += s
    assert np.allclose(crf.marginals(unary, links, pot, 60), total / total.sum(1, keepdims=True), atol=1e-6)


def test_distant_forms_of_one_number_are_found(docs_of, spark):
    weights = crf.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    text = "Card 4111 1111 1111 1111 paid. " + "word " * 50 + "again 4111.1111.1111.1111 and order 4111.2222.3333.4444 é"
    rows = [(1, text), (2, None), (3, ""), (4, "clean words only, version 2.0 of 2024"), (None, "a@b.co"), (1, text)]
    df = docs_of(rows, CLASHES)
    got = sorted(((r.doc_id or 0, r.n_card, r.n_email, r.base_sha256, r.spans) for r in crf.find_personal_data(df, weights).collect()))
    none = hashlib.sha256(b"").hexdigest()
    at = text.index("4111.1111")
    want = f"card:5:24,card:{at}:{at + 19}"
    assert got == [(0, 0, 1, hashlib.sha256(b"email:0:6").hexdigest(), "email:0:6"),
                   *[(1, 1, 0, hashlib.sha256(b"card:5:24").hexdigest(), want)] * 2,
                   (2, 0, 0, none, ""), (3, 0, 0, none, ""), (4, 0, 0, none, "")]
    masked = {r.doc_id: r.text for r in crf.masked(df, weights).collect()}
    assert "<card> paid" in masked[1] and "again <card> and order 4111.2222" in masked[1] and masked[None] == "<email>" and masked[2] is None
    assert crf.find_personal_data(docs_of([])).collect() == []


# ------------------------------------------------------------------ pipeline

def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if k < 4:
            assert docs.columns == columns, name
            sizes.append(docs.count())
    assert sizes[0] > sizes[1] and sizes[1] == sizes[2] and sizes[2] >= sizes[3] >= sizes[4] > 0
    assert docs.select("doc_id").distinct().count() == sizes[4]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = spark.read.parquet(f"{tmp_path}/quality").join(labels, "doc_id")
    assert kept.where("quality = 1").count() >= 0.9 * labels.where("quality = 1").count()
    assert kept.where("quality = 0").count() <= 0.5 * labels.where("quality = 0").count()


def test_pipeline_over_empty_tables(spark, docs_of):
    docs = docs_of([])
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, SF).collect() == []


def test_registered_names():
    assert [int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES] == list(range(1, 11))
    assert set(queries.ORACLE) <= set(queries.QUERIES)


def test_the_field_is_fitted_on_distinct_texts(docs_of):
    rows = [(i, f"write to user{i % 7}@mail{i % 5}.org or call +1 555 010 {1000 + i} today") for i in range(40)]
    once, copies = crf.train(docs_of(rows)), crf.train(docs_of(rows + rows[:1] * 300))
    assert all(np.array_equal(once[k], copies[k]) for k in once)
