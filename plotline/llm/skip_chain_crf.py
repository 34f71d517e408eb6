"""Personal data by patterns and a skip-chain conditional random field.

Base spans come from fixed patterns (email, ip, card, phone; see ``base_spans``).  A CRF
over each document's tokens then makes labels consistent: neighbours share chain
potentials; distant tokens that repeat or resemble each other (the same characters, or the
same digits however they are grouped) share skip potentials; loopy sum-product passing
gives the marginals.  A run of tokens that the CRF labels with a kind and that no base span
touches is added, so the same number written in another way is found as well.

Only tokens with a digit or an at sign may take a label other than "none" (a fixed
constraint).  All others send constant messages, so the graph is exactly that of these
candidate tokens.  Weights are fitted by pseudo-likelihood against the base spans, on a
bounded sample of documents with candidates (``SAMPLE``, by a hash); every text is labelled.

Defined results: a null text counts as empty; a text without personal data has counts 0,
empty ``spans`` and the hash of the empty string; repeated rows are treated alike; an
empty table gives no rows; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # 0: none
SAMPLE = 3000
ROUNDS = 12
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S*[0-9@]\S*")
_EDGE = re.compile(r"^[^0-9A-Za-z+(]+|[^0-9A-Za-z)]+$")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address pattern, from each at sign outwards, so that a long
    run of address characters is read once."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, ordered by start, then kind."""
    out = [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


# ---------------------------------------------------------------- the field

def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Token spans in order: every base span, and every other run without white space that
    holds a digit or an at sign, without marks at its ends."""
    out = {(a, b) for a, _, b in base}
    reach, spans = 0, sorted(out)
    at = 0
    for m in _TOKEN.finditer(text):
        core = _EDGE.sub("", m[0])
        if not core:
            continue
        a = m.start() + m[0].index(core)
        b = a + len(core)
        while at < len(spans) and spans[at][0] < b:
            reach = max(reach, spans[at][1])
            at += 1
        if reach <= a:
            out.add((a, b))
    return sorted(out)


FEATURES = 34


def features(token: str) -> list[int]:
    digits = _NOT_DIGIT.sub("", token)
    n, parts = len(digits), token.split(".")
    local, _, domain = token.partition("@")
    return [0, 1 + min(n, 20),
            *([22] if "@" in token else []), *([23] if local and "." in domain.strip(".") else []),
            *([24] if len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts) else []),
            *([25] if len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts) else []),
            *([26] if 12 <= n <= 19 and luhn(digits) else []), *([27] if n == len(token) else []),
            *([28] if token.startswith("+") else []), *([29] if "(" in token else []),
            *([30] if "-" in token else []), *([31] if any(c.isalpha() for c in token) else []),
            *([32] if 12 <= n <= 19 else []), *([33] if 9 <= n <= 15 else [])]


def graph(text: str, tokens: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain links (candidates that only white space or marks part) and skip links (each
    occurrence of a form with the next one, so links grow with the text, not its square;
    forms: the token in lower case, its digits)."""
    chain = [(i, i + 1) for i in range(len(tokens) - 1)
             if tokens[i + 1][0] - tokens[i][1] <= 8 and not any(c.isalnum() for c in text[tokens[i][1]:tokens[i + 1][0]])]
    last: dict[str, int] = {}
    skip: set[tuple[int, int]] = set()
    for i, (a, b) in enumerate(tokens):
        token = text[a:b].lower()
        digits = _NOT_DIGIT.sub("", token)
        for form in {token, *(["#" + digits] if len(digits) >= 9 else [])}:
            if form in last:
                skip.add((last[form], i))
            last[form] = i
    return chain, sorted(skip.difference(chain))


def labels_of(tokens: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> np.ndarray:
    """The kind of the base span that the token is (the first listed), or 0."""
    kind = {(a, b): k + 1 for a, k, b in reversed(base)}
    return np.array([kind.get(t, 0) for t in tokens], dtype=np.int64)


def marginals(unary: np.ndarray, links: list[tuple[int, int]], potentials: list[np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Loopy sum-product in log space with damping; exact on trees given enough rounds."""
    n = len(unary)
    if not links:
        p = np.exp(unary - unary.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)
    a, b = np.array(links).T
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    pot = np.concatenate([np.array(potentials), np.array(potentials).transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
    msg = np.zeros((len(src), unary.shape[1]))
    for r in range(rounds):
        belief = unary.copy()
        np.add.at(belief, dst, msg)
        out = belief[src] - msg[back]
        new = out[:, :, None] + pot
        top = new.max(1, keepdims=True)
        new = top[:, 0] + np.log(np.exp(new - top).sum(1))
        new -= new.max(1, keepdims=True)
        msg = new if r == 0 else 0.5 * msg + 0.5 * new
    belief = unary.copy()
    np.add.at(belief, dst, msg)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


#: Prior mean of the skip agreement, and its pull: base spans alone say little about forms
#: that no pattern covers, which is what skip links are for.
SKIP_PRIOR, SKIP_PULL = 4.0, 0.05


def fit(texts: list[str], steps: int = 300, rate: float = 0.5, decay: float = 1e-4) -> dict[str, np.ndarray]:
    """Pseudo-likelihood weights: emission (FEATURES x LABELS), chain (LABELS x LABELS) and
    skip agreement of each label, all with Gaussian priors.  Skip weights are kept from
    going below zero: tokens that resemble each other never push each other apart."""
    fx, ys, chains, skips, base = [], [], [], [], 0
    for text in texts:
        spans = base_spans(text)
        tokens = candidates(text, spans)
        chain, skip = graph(text, tokens)
        fx += [features(text[a:b]) for a, b in tokens]
        ys.append(labels_of(tokens, spans))
        chains += [(i + base, j + base) for i, j in chain]
        skips += [(i + base, j + base) for i, j in skip]
        base += len(tokens)
    w = {"emit": np.zeros((FEATURES, LABELS)), "chain": np.zeros((LABELS, LABELS)), "skip": np.full(LABELS, SKIP_PRIOR)}
    if not base:
        return w
    y = np.concatenate(ys)
    x = np.zeros((base, FEATURES))
    for i, f in enumerate(fx):
        x[i, f] = 1
    one = np.eye(LABELS)[y]
    left, right, skip = np.zeros((base, LABELS)), np.zeros((base, LABELS)), np.zeros((base, LABELS))
    for i, j in chains:
        left[j] += one[i]
        right[i] += one[j]
    for i, j in skips:
        skip[i] += one[j]
        skip[j] += one[i]
    total = {k: np.full(v.shape, 1e-8) for k, v in w.items()}
    for _ in range(steps):
        s = x @ w["emit"] + left @ w["chain"] + right @ w["chain"].T + skip * w["skip"]
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = (one - p) / base
        grad = {"emit": x.T @ d, "chain": left.T @ d + (right.T @ d).T, "skip": (skip * d).sum(0)}
        for k, g in grad.items():
            g = g - (SKIP_PULL * (w[k] - SKIP_PRIOR) if k == "skip" else decay * w[k])
            total[k] += g * g
            w[k] = w[k] + rate * g / np.sqrt(total[k])
        w["skip"] = np.maximum(w["skip"], 0)
    return w


def added_spans(text: str, base: list[tuple[int, int, int]], w: dict[str, np.ndarray]) -> list[tuple[int, int, int]]:
    tokens = candidates(text, base)
    if len(tokens) < 2:
        return []
    chain, skip = graph(text, tokens)
    if not skip:
        return []  # without a token that resembles another there is nothing to make consistent
    unary = np.array([w["emit"][features(text[a:b])].sum(0) for a, b in tokens])
    y = labels_of(tokens, base)
    known = y > 0
    unary[known] += np.where(np.arange(LABELS)[None, :] == y[known][:, None], 20.0, 0.0)  # base spans are observed
    p = marginals(unary, chain + skip, [w["chain"]] * len(chain) + [np.diag(w["skip"])] * len(skip))
    best = p.argmax(1)
    tied = {i for i, j in skip for i in (i, j)}
    near = defaultdict(list)
    for i, j in chain:
        near[j].append(i)
    out: list[list[int]] = []
    place: dict[int, int] = {}
    for i, (a, b) in enumerate(tokens):
        k = int(best[i])
        if not k or known[i] or i not in tied or p[i, k] <= 0.5 or any(s < b and a < e for s, _, e in base):
            continue
        before = next((place[j] for j in near[i] if j in place and out[place[j]][1] == k - 1), None)
        if before is None:
            place[i] = len(out)
            out.append([a, k - 1, b])
        else:
            out[before][2] = b
            place[i] = before
    return [tuple(x) for x in out]


def _text_of(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _label(w: dict[str, np.ndarray]):
    none = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            n = len(texts)
            counts = np.zeros((len(KINDS), n), dtype=np.int64)
            sha, spans = [none] * n, [""] * n
            some = pc.fill_null(pc.match_substring_regex(texts, "[0-9@]"), False).to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(some).tolist():
                text = texts[i].as_py()
                base = base_spans(text)
                for _, k, _ in base:
                    counts[k, i] += 1
                if base:
                    sha[i] = hashlib.sha256(_text_of(base).encode()).hexdigest()
                spans[i] = _text_of(sorted(base + added_spans(text, base, w)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c) for c in counts), pa.array(sha, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])
    return run


def train(docs: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Weights from about ``sample`` distinct texts with candidates (copies count once),
    fitted in one task."""
    some = docs.select("text").where(F.col("text").rlike("[0-9@]"))
    n = some.select(F.xxhash64("text").alias("th")).distinct().count()
    pick = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)

    def run(pdfs):
        import pandas as pd
        texts = sorted(t for pdf in pdfs for t in pdf["text"])
        w = fit(texts)
        yield pd.DataFrame({k: [v.astype(float).tobytes()] for k, v in w.items()})

    got = some.where(pick < sample / max(1, n)).distinct().repartition(1).mapInPandas(run, "emit binary, chain binary, skip binary").first()
    shapes = {"emit": (FEATURES, LABELS), "chain": (LABELS, LABELS), "skip": (LABELS,)}
    if got is None:
        return {k: np.zeros(s) for k, s in shapes.items()}
    return {k: np.frombuffer(got[k]).reshape(s) for k, s in shapes.items()}


def find_personal_data(docs: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """``doc_id``, counts of base spans by kind, ``base_sha256``, ``spans``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    weights = train(rows) if weights is None else weights
    return rows.mapInArrow(_label(weights), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
                           "base_sha256 string, spans string")


def masked(docs: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets."""
    weights = train(docs) if weights is None else weights

    def mask(text):
        out, at = [], 0
        base = base_spans(text)
        for a, k, b in sorted(base + added_spans(text, base, weights)):
            if a >= at:
                out += [text[at:a], f"<{KINDS[k]}>"]
                at = b
        return "".join([*out, text[at:]])

    udf = F.pandas_udf(lambda s: s.map(mask, na_action="ignore"), "string")
    return docs.withColumn("text", F.when(F.col("text").rlike("[0-9@]"), udf("text")).otherwise(F.col("text")))


def op10(spark, sf_dir: str) -> DataFrame:
    return find_personal_data(common.documents(spark, sf_dir))
