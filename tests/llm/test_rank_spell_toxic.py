"""Ranked search, spelling variants and toxicity against plain versions and awkward tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from test_operators import awkward, docs, lowered, prose  # noqa: F401

from tallyboard.llm import search, spelling, toxicity
from tallyboard.llm.words import chunks

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def plain_ranking(rows, items, k):
    held = [(i, Counter(TERM.findall(lowered(t)))) for i, t in rows]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall(lowered(t)))
    out = []
    for item, terms in asked.items():
        found = []
        for i, c, n in held:
            m = 10 + 90 * n * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in terms if c[t]
            )
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def ranked(frame):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in frame.collect()), key=repr)


def items(spark, rows):
    return spark.createDataFrame([(*r, 1, "r", 0) for r in rows], "item_id long, text string, query long, rank string, term int")


def test_ranking(spark, awkward, monkeypatch):  # noqa: F811
    asked = [
        (1, prose(2, 40)), (2, None), (3, ""), (4, "of"), (5, "a@b.cd 555 é"), (6, prose(1, 3000)), (7, "nowhere_else"), (5, "ns END"),
        (None, prose(9, 30)), (None, "漢"), (8, prose(2, 40)),
    ]
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    for k in (1, 3, 10):
        assert ranked(search.rank_documents(awkward, items(spark, asked), k)) == plain_ranking(rows, asked, k)
    # Queries in blocks, and postings in many small runs.
    monkeypatch.setattr(search, "BLOCK", 20)
    want = plain_ranking(rows, asked, 3)
    assert ranked(search.rank_documents(awkward, items(spark, asked), 3)) == want
    assert search.rank_documents(awkward.limit(0), items(spark, asked)).count() == 0
    assert search.rank_documents(awkward, items(spark, asked).limit(0)).count() == 0


def test_accumulators_are_limited_and_exact():
    rng = np.random.default_rng(3)
    stopped = 0
    for trial in range(300):
        n, k = 60, int(rng.integers(1, 8))
        lists = []
        for _ in range(int(rng.integers(0, 7))):
            rows = np.flatnonzero(rng.random(n) < rng.choice([0.05, 0.3, 0.9]))
            share = rng.integers(1, 6, len(rows)).astype(np.int64)
            lists.append((rows, share, int(share.max()) if len(rows) else 0))
        terms = [(i, int(rng.integers(0, 50))) for i in range(len(lists))]
        full = np.zeros(n, dtype=np.int64)
        for i, w in terms:
            full[lists[i][0]] += w * lists[i][1]
        least = int(rng.choice([1, 40]))
        rows, scores = search.best_of(terms, lambda i: lists[i], n, k, least)
        assert (full[rows] == scores).all()
        want = sorted(((-s, i) for i, s in enumerate(full.tolist()) if s >= least))[:k]
        assert sorted(zip((-scores).tolist(), rows.tolist()))[:k] == want
        stopped += len(rows) < np.count_nonzero(full >= least)
    assert stopped > 50


def plain_forms(rows):
    n = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            word = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    words = sorted(n)
    near = {w: [v for v in words if spelling.near_words(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def spelled(frame):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def variants(seed, size):
    """Words of few letters and their misspellings, in texts."""
    rng = random.Random(seed)
    stems = ["".join(rng.choices("abcdé×ÿ", k=rng.randint(5, 9))) for _ in range(12)] + ["x" * 70, "x" * 71, "y" * 300]
    rows = []
    for i in range(size):
        words = []
        for _ in range(60):
            w = rng.choice(stems)
            for _ in range(rng.choice([0, 0, 1, 2])):
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abé") + w[at:], w[:at] + rng.choice("abé") + w[at + 1 :]])
            words.append(w if rng.random() < 0.8 else w.upper() if w.isascii() else w)
        rows.append((i, " ".join(words)))
    return rows


def test_near_words():
    assert spelling.near_words("house", "hose") and spelling.near_words("hose", "house") and spelling.near_words("house", "horse")
    assert not spelling.near_words("house", "house") and not spelling.near_words("house", "hoes") and not spelling.near_words("ab", "ba")
    assert spelling.near_words("", "a") and spelling.near_words("aab", "ab") and not spelling.near_words("", "ab")


@pytest.mark.parametrize("cell", [10**9, 40, 1])
def test_spelling(spark, awkward, monkeypatch, cell):  # noqa: F811
    monkeypatch.setattr(spelling, "CELL", cell)
    rows = variants(5, 80)
    got = spelled(spelling.spelling_forms(docs(spark, rows).repartition(5)))
    assert got == plain_forms(rows) and len(got) > 100 and any(r[2] != (r[1] or r[0]) for r in got)
    if cell == 40:
        assert spelled(spelling.spelling_forms(awkward)) == plain_forms([(r.doc_id, r.text) for r in awkward.collect()])
        assert spelling.spelling_forms(awkward.limit(0)).count() == 0
        with pytest.raises(ValueError):
            spelling.spelling_forms(awkward, times=1)


def test_crc():
    texts = [b"", b"abc", b"x" * 1000, "é漢".encode(), b"z"]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    got = spelling.crc32_after(np.full(5, zlib.crc32(b"17:"), np.uint32), data, starts, ends)
    assert got.tolist() == [zlib.crc32(b"17:" + t) for t in texts]


def plain_odds(p, words, known):
    """Log odds of one window, word by word."""
    def inputs(word):
        raw = word.encode()
        padded = b"\0" + raw + b"\0"
        grams = [padded[i : i + 3] for i in range(len(raw))]
        from tallyboard.llm.words import mix

        codes = mix(np.array([(g[0] << 16 | g[1] << 8 | g[2]) + 1 for g in grams], dtype=np.uint64)) % np.uint64(1 << 13)
        return np.concatenate([p["word"][known.get(word, -1)], np.mean([p["gram"][int(c)] for c in codes], axis=0)])

    def sigmoid(x):
        return 1 / (1 + np.exp(-x))

    x = [inputs(w) for w in words]
    states = {}
    for side, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
        h = np.zeros(8)
        for t in order:
            a, u = x[t] @ p["in_" + side] + p["bias_" + side], h @ p["own_" + side]
            keep, reset = sigmoid(a[:8] + u[:8]), sigmoid(a[8:16] + u[8:16])
            h = (1 - keep) * np.tanh(a[16:] + reset * u[16:]) + keep * h
            states[side, t] = h
    both = np.array([np.concatenate([states["f", t], states["b", t]]) for t in range(len(x))])
    asked = np.tanh(both @ p["key"]) @ p["ask"]
    share = np.exp(asked - asked.max())
    return p["out"] @ (share / share.sum() @ both) + p["out_bias"][0]


def network(texts, seed=0):
    rng = np.random.default_rng(seed)
    known = toxicity.vocabulary(texts * 3)
    p = {k: v.astype(float) + rng.normal(0, 0.3, v.shape) for k, v in toxicity.parameters(len(known)).items()}
    p["word"][-1] = 0
    p["known"] = known
    return p


def test_network_by_hand():
    texts = ["one two three", "a fine day " * 30, "x", "", " . ", " ".join(f"w{i}" for i in range(49))]
    p = network(texts)
    hashes = {}
    for w in sorted({w for t in texts for w in t.split() if w != "."}):
        _, _, data, offsets = next(chunks(pa.array([w])))
        h = toxicity.Words(data, offsets, toxicity.ALNUM).hashes()[0]
        hashes[w] = int(np.searchsorted(p["known"], h))
    want = []
    for t in texts:
        words = [w for w in t.split() if w != "."]
        starts = range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STEP), toxicity.STEP) if words else []
        odds = [plain_odds(p, words[s : s + toxicity.WINDOW], hashes) for s in starts]
        want.append(1 / (1 + math.exp(-max(odds))) if odds else 0.0)
    assert np.allclose(toxicity.score_column(p, pa.array(texts)), want, atol=1e-4)


def test_gradients():
    texts = ["one two three one", "a fine day " * 20, "x"]
    p = network(texts)
    _, _, data, offsets = next(chunks(pa.array(texts)))
    inputs = toxicity.Inputs(data, offsets, p["known"])
    word, real = inputs.words_of(np.arange(len(inputs.owner)))
    x = inputs.vectors(p).astype(float)
    rng = np.random.default_rng(1)
    error = rng.normal(size=len(inputs.owner))
    traces = {}
    _, saved = toxicity.forward(p, x, word, real, traces)
    g = toxicity.backward(p, x, word, saved, traces, error)
    for name in ("out", "ask", "key", "in_f", "in_b", "own_f", "own_b", "bias_f", "bias_b", "out_bias", "x"):
        values = x if name == "x" else p[name]
        at = tuple(rng.integers(0, s) for s in values.shape)
        kept, step = values[at], 1e-2
        ends = []
        for move in (step, -step):
            values[at] = kept + move
            ends.append(error @ toxicity.forward(p, x, word, real)[0])
        values[at] = kept
        assert abs(g[name][at] - (ends[0] - ends[1]) / 2 / step) < 2e-2, name


def test_toxicity(spark, awkward):  # noqa: F811
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(500):
        words = prose(100 + i, rng.randint(5, 150)).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(1 + len(words) // 30):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["Zorkly", "fubbed", "gruckish"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    frame = docs(spark, rows)
    marks = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(frame, marks, 300)
    out = {r.doc_id: r for r in toxicity.score(frame, model).collect()}
    held = [i for i in out if out[i].held_out]
    assert set(held) == {i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(out[i].predicted == labels[i][1] for i in held) >= 0.95 * len(held)
    got = toxicity.score(awkward, model).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.doc_id in (1, 2, 3)} == {0.0}
    # One bad word at the end of a very long text is found: all windows are scored.
    long = docs(spark, [(1, prose(1, 60_000) + " fubbed zorkly gruckish")])
    assert toxicity.score(long, model).first().predicted == 1
    assert toxicity.score(awkward.limit(0), model).count() == 0
    nobody = toxicity.train(frame, marks.limit(0))
    assert {r.score for r in toxicity.score(frame, nobody).collect()} == {0.5}
