r"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input is its own learned vector, if enough of the texts learned from have the word, and the mean
of the learned vectors of its character 3-grams, with marks at both ends. Two gated recurrent units read a window of words from both sides; an attention layer weighs
their states, and the weighted mean gives the window's log odds. A text is cut into overlapping windows,
all of them are scored, and the text's score is that of its worst window. All layers are learned together in
numpy: of each labelled text the worst window is learned from.

What a unit's gates get from a word depends on the word alone, so it is worked out once for each distinct
word of a chunk; the steps of all windows of a chunk run side by side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard.llm import ship
from tallyboard.llm.sample import bounded_sample
from tallyboard.llm.words import ALNUM, Words, chunks, mix, ranges

#: Words of a window, and from one window's start to the next's.
WINDOW = 32
STEP = 16
#: Words with a vector of their own: the most frequent ones that so many texts learned from have.
VOCABULARY = 1 << 15
IN_TEXTS = 3
_GRAM_BUCKETS = 1 << 13
_WORD, _CHAR, _STATE, _KEY = 8, 12, 8, 8
_SIDE = 4096
#: Texts of more characters are not learned from (all are scored).
LONGEST = 8_000
#: While learning, so many words of a step have no vector of their own, and weights shrink by this at a full step.
DROP = 0.5
DECAY = 0.005


class Inputs:
    """Distinct words of a chunk of texts as buckets, and the windows of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, known: np.ndarray):
        words = Words(data, offsets, ALNUM)
        hashes = words.hashes() if len(words) else np.zeros(0, np.uint64)
        distinct, first, self.word = np.unique(hashes, return_index=True, return_inverse=True)
        self.word = self.word.astype(np.int32)
        # Row of the word's vector; words that aren't known share the last row, which stays zero.
        at = np.searchsorted(known, distinct)
        at[at == len(known)] = 0
        self.row = np.where(known[at] == distinct, at, len(known)) if len(known) else np.zeros(len(distinct), np.int64)
        # Character 3-grams with one mark before and one behind.
        sizes = (words.ends - words.starts)[first] if len(first) else np.zeros(0, np.int64)
        ends = np.cumsum(sizes + 2)
        text = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
        if len(text):
            inside = np.repeat(ends - sizes - 1, sizes) + ranges(sizes)
            text[inside] = words.data[np.repeat(words.starts[first], sizes) + ranges(sizes)]
        grams = np.maximum(sizes, 0)
        self.gram_owner = np.repeat(np.arange(len(sizes)), grams)
        at = np.repeat(ends - sizes - 2, grams) + ranges(grams)
        code = (text[at] << np.uint64(16)) | (text[at + 1] << np.uint64(8)) | text[at + 2] if len(at) else np.zeros(0, np.uint64)
        self.gram = (mix(code + np.uint64(1)) % np.uint64(_GRAM_BUCKETS)).astype(np.int64)
        self.n_grams = np.maximum(1, grams)
        # Windows start every STEP words until one reaches the text's end.
        counts = words.counts()
        self.n_windows = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STEP)), 0)
        self.owner = np.repeat(np.arange(len(counts)), self.n_windows)
        begun = ranges(self.n_windows) * STEP
        self.start = words.first[:-1][self.owner] + begun
        self.length = np.minimum(WINDOW, counts[self.owner] - begun)

    def only(self, words: np.ndarray) -> Inputs:
        """The inputs of some of the distinct words, without the windows."""
        few = object.__new__(Inputs)
        few.row, few.n_grams = self.row[words], self.n_grams[words]
        begun = np.cumsum(self.n_grams) - self.n_grams
        few.gram = self.gram[np.repeat(begun[words], few.n_grams) + ranges(few.n_grams)]
        few.gram_owner = np.repeat(np.arange(len(words)), few.n_grams)
        return few

    def vectors(self, p: dict) -> np.ndarray:
        """Input of each distinct word."""
        chars = np.zeros((len(self.row), _CHAR), np.float32)
        if len(self.gram):
            found = p["gram"][self.gram]
            # Every word has at least one 3-gram, so no run of them is empty.
            np.add.reduceat(found, np.concatenate([[0], np.cumsum(self.n_grams)[:-1]]), axis=0, out=chars)
        return np.concatenate([p["word"][self.row], chars / self.n_grams[:, None].astype(np.float32)], axis=1)

    def words_of(self, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct word at each place of the picked windows (places by windows), and which places are real."""
        most = int(self.length[picked].max())
        place = np.arange(most)[:, None]
        real = place < self.length[picked]
        return self.word[np.where(real, self.start[picked] + place, self.start[picked])], real


def parameters(known: int, seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)

    def layer(rows: int, columns: int) -> np.ndarray:
        return rng.normal(0, 1 / np.sqrt(rows), (rows, columns)).astype(np.float32)

    p = {"word": np.zeros((known + 1, _WORD), np.float32), "gram": np.zeros((_GRAM_BUCKETS, _CHAR), np.float32)}
    for side in "fb":
        p["in_" + side] = layer(_WORD + _CHAR, 3 * _STATE)
        p["own_" + side] = layer(_STATE, 3 * _STATE)
        p["bias_" + side] = np.zeros(3 * _STATE, np.float32)
    p["key"] = layer(2 * _STATE, _KEY)
    p["ask"] = rng.normal(0, 1, _KEY).astype(np.float32)
    p["out"] = layer(2 * _STATE, 1)[:, 0]
    p["out_bias"] = np.zeros(1, np.float32)
    return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def sum_by(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of the rows of each index below n."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    if len(index):
        order = np.argsort(index, kind="stable")
        begins = np.concatenate([[0], np.flatnonzero(np.diff(index[order])) + 1])
        out[index[order[begins]]] = np.add.reduceat(rows[order], begins, axis=0)
    return out


def unit(p: dict, side: str, given: np.ndarray, word: np.ndarray, real: np.ndarray, trace: list | None = None) -> np.ndarray:
    """States (places, states, windows) of one unit; `given` is what the gates get from each distinct word.

    Places that aren't real leave the state as zeros before a window's first word from that side.
    """
    places, n = word.shape
    own = np.ascontiguousarray(p["own_" + side].T)
    states = np.zeros((places, _STATE, n), np.float32)
    h = np.zeros((_STATE, n), np.float32)
    for t in range(places) if side == "f" else range(places - 1, -1, -1):
        x = np.ascontiguousarray(given[word[t]].T)
        u = own @ h
        gates = _sigmoid(x[: 2 * _STATE] + u[: 2 * _STATE])
        keep, reset = gates[:_STATE], gates[_STATE:]
        new = 2 * _sigmoid(2 * (x[2 * _STATE :] + reset * u[2 * _STATE :])) - 1
        after = (new + keep * (h - new)) * real[t]
        if trace is not None:
            trace.append((t, h, keep, reset, new, u[2 * _STATE :]))
        h = after
        states[t] = h
    return states


def forward(p: dict, x: np.ndarray, word: np.ndarray, real: np.ndarray, traces: dict | None = None):
    """Log odds of each window, and what `backward` needs."""
    real = real.astype(np.float32)
    both = []
    for side in "fb":
        given = x @ p["in_" + side] + p["bias_" + side]
        trace = None if traces is None else traces.setdefault(side, [])
        both.append(unit(p, side, given, word, real, trace))
    states = np.concatenate(both, axis=1)
    key = 2 * _sigmoid(2 * np.matmul(p["key"].T, states)) - 1
    asked = np.einsum("k,tkn->tn", p["ask"], key) - 1e9 * (1 - real)
    share = np.exp(asked - asked.max(axis=0))
    share /= share.sum(axis=0)
    pooled = np.einsum("tn,tsn->sn", share, states)
    return p["out"] @ pooled + p["out_bias"][0], (states, key, share, pooled, real)


def backward(p: dict, x: np.ndarray, word: np.ndarray, saved, traces: dict, error: np.ndarray) -> dict:
    """Gradients of sum(error * log odds)."""
    states, key, share, pooled, real = saved
    g = {"out": pooled @ error, "out_bias": np.array([error.sum()], np.float32)}
    d_pooled = p["out"][:, None] * error
    d_states = share[:, None, :] * d_pooled
    d_share = np.einsum("sn,tsn->tn", d_pooled, states)
    d_asked = share * (d_share - (share * d_share).sum(axis=0))
    g["ask"] = np.einsum("tn,tkn->k", d_asked, key)
    d_key = d_asked[:, None, :] * p["ask"][:, None] * (1 - key**2)
    g["key"] = np.einsum("tsn,tkn->sk", states, d_key)
    d_states = d_states + np.matmul(p["key"], d_key)
    d_x = np.zeros_like(x)
    for i, side in enumerate("fb"):
        own = p["own_" + side]
        gates, at = [], []
        g["own_" + side] = np.zeros_like(own)
        d_h = np.zeros((_STATE, word.shape[1]), np.float32)
        for t, h, keep, reset, new, u_new in reversed(traces[side]):
            d_after = (d_h + d_states[t, i * _STATE : (i + 1) * _STATE]) * real[t]
            d_new = d_after * (1 - keep) * (1 - new**2)
            d_keep = d_after * (h - new) * keep * (1 - keep)
            d_reset = d_new * u_new * reset * (1 - reset)
            gates.append(np.concatenate([d_keep, d_reset, d_new]).T)
            at.append(word[t])
            d_u = np.concatenate([d_keep, d_reset, d_new * reset])
            g["own_" + side] += h @ d_u.T
            d_h = own @ d_u + d_after * keep
        d_given = sum_by(np.concatenate(at), np.concatenate(gates), len(x))
        g["in_" + side] = x.T @ d_given
        g["bias_" + side] = d_given.sum(axis=0)
        d_x += d_given @ p["in_" + side].T
    g["x"] = d_x
    return g


def window_odds(p: dict, inputs: Inputs) -> np.ndarray:
    """Log odds of every window, windows of like length side by side."""
    odds = np.zeros(len(inputs.owner), np.float32)
    if len(odds):
        x = inputs.vectors(p)
        order = np.argsort(inputs.length, kind="stable")
        for lo in range(0, len(order), _SIDE):
            picked = order[lo : lo + _SIDE]
            odds[picked], _ = forward(p, x, *inputs.words_of(picked))
    return odds


def _worst(inputs: Inputs, odds: np.ndarray) -> np.ndarray:
    """The window of largest odds of each text that has one."""
    order = np.lexsort([-odds, inputs.owner])
    return order[np.concatenate([[True], np.diff(inputs.owner[order]) > 0])] if len(order) else order


def vocabulary(texts: list[str]) -> np.ndarray:
    """Sorted hashes of the words that have a vector."""
    found = []
    for _, _, data, offsets in chunks(pa.array(texts, pa.large_string())):
        words = Words(data, offsets, ALNUM)
        if len(words):
            owner = np.repeat(np.arange(len(offsets) - 1), words.counts())
            order = np.lexsort([words.hashes(), owner])
            h, o = words.hashes()[order], owner[order]
            found.append(h[np.concatenate([[True], (np.diff(h) != 0) | (np.diff(o) != 0)])])
    if not found:
        return np.zeros(0, np.uint64)
    words, n = np.unique(np.concatenate(found), return_counts=True)
    words, n = words[n >= IN_TEXTS], n[n >= IN_TEXTS]
    return np.sort(words[np.lexsort([words, -n])[:VOCABULARY]])


def fit(texts: list[str], labels: np.ndarray, steps: int = 500, rate: float = 0.02, seed: int = 1) -> dict[str, np.ndarray]:
    """Weights after `steps` Adam steps on 64 texts each, half of either class.

    Without texts of both classes every text with words scores 0.5, as nothing is known of them.
    """
    known = vocabulary(texts)
    p = parameters(len(known), seed)
    p["known"] = known
    labels = np.asarray(labels, dtype=np.int64)
    classes = [np.flatnonzero(labels == c) for c in (0, 1)]
    if not all(map(len, classes)):
        p["out"][:] = 0
        return p
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in p.items() if k != "known"}
    second = {k: np.zeros_like(v) for k, v in first.items()}
    turns = [np.concatenate([rng.permutation(own) for _ in range(-(-32 * steps // len(own)))]) for own in classes]
    for step in range(1, steps + 1):
        picked = np.concatenate([own[32 * step - 32 : 32 * step] for own in turns])
        batch = pa.array([texts[j] for j in picked], pa.large_string())
        _, _, data, offsets = next(chunks(batch, 1 << 40))
        inputs = Inputs(data, offsets, known)
        if not len(inputs.owner):
            continue
        worst = _worst(inputs, window_odds(p, inputs))
        word, real = inputs.words_of(worst)
        mine, word = np.unique(word, return_inverse=True)
        word = word.reshape(real.shape)
        few = inputs.only(mine)
        x = few.vectors(p)
        if DROP:
            x[:, :_WORD] *= rng.random((len(x), 1)) >= DROP
        traces: dict = {}
        odds, saved = forward(p, x, word, real, traces)
        error = ((_sigmoid(odds) - labels[picked][inputs.owner[worst]]) / len(worst)).astype(np.float32)
        g = backward(p, x, word, saved, traces, error)
        d_x = g.pop("x")
        g["word"] = sum_by(few.row, d_x[:, :_WORD], len(p["word"]))
        g["word"][-1] = 0
        g["gram"] = sum_by(few.gram, (d_x[:, _WORD:] / few.n_grams[:, None])[few.gram_owner], _GRAM_BUCKETS)
        slow = rate * (1 - (step - 1) / steps)
        for name, d in g.items():
            first[name] += 0.1 * (d - first[name])
            second[name] += 0.01 * (d**2 - second[name])
            size = np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7
            p[name] -= (slow * (first[name] / (1 - 0.9**step) / size + DECAY * p[name])).astype(np.float32)
    return p


def held_out(doc_id):
    """Rows that are never learned from: crc32 of the id as text divisible by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> dict[str, np.ndarray]:
    """Model from at most `sample` labelled texts, half of either class as far as there are as many.

    Of each class the ids of the smallest hashes are taken, then distinct texts of at most LONGEST
    characters. Rows without a label, id or text don't count, nor held-out rows; of a doc_id's labels the largest counts.
    """
    ship(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_label"))
    known = known.where(~held_out(F.col("doc_id"))).withColumnRenamed("doc_id", "_doc")
    by = F.xxhash64("_doc")
    halves = [bounded_sample(known.where(F.col("_label") == c), by, sample) for c in (0, 1)]
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.length("text") <= LONGEST)
    found = texts.join(F.broadcast(halves[0].union(halves[1])), texts["doc_id"] == F.col("_doc"))
    found = found.groupBy("text").agg(F.max("_label").alias("_label"))
    rows = []
    for c in (0, 1):
        rows += found.where(F.col("_label") == c).orderBy(F.xxhash64("text")).limit(sample // 2).select("text", "_label").collect()
    return fit([r["text"] for r in rows], np.array([r["_label"] for r in rows], dtype=np.int64))


def score_column(p: dict, column: pa.Array) -> np.ndarray:
    """Score of each text: that of its worst window; a text without words has none and scores 0."""
    out = []
    for lo, hi, data, offsets in chunks(column):
        inputs = Inputs(data, offsets, p["known"])
        score = np.zeros(hi - lo)
        worst_of = np.full(hi - lo, -np.inf)
        np.maximum.at(worst_of, inputs.owner, window_odds(p, inputs))
        full = inputs.n_windows > 0
        score[full] = _sigmoid(worst_of[full])
        out.append(score)
    return np.concatenate(out) if out else np.zeros(0)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; one row out for each row in, other columns are left alone.

    Null text is empty; a text without words scores 0. Only the text enters a score, whole at any length.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        p = sent.value
        for batch in batches:
            scores = pa.array(score_column(p, batch.column(2)), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], ["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    scored = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
