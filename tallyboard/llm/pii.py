r"""Personal data: fixed patterns, and a skip-chain conditional random field that adds to them.

The nodes of a document's graph are its tokens with a digit or an at sign; other tokens are never
personal data here. Neighbouring nodes are joined by chain edges, and a node by skip edges to the next
one that is alike: the same without case and punctuation, or the same by its last seven digits. Both
kinds of edge have learned potentials, so a number seen once in full lends its label to its other
mentions however far apart they are. Loopy message passing gives each node's label.

Weights are learned from a bounded sample of documents, with the patterns' spans as labels. A document's graph is made and solved within its row.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard.llm import ship
from tallyboard.llm.sample import bounded_sample

KINDS = ("email", "ip", "card", "phone")
_LABELS = len(KINDS) + 1
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
# A run of digits is tried from its start only, so that a long one takes no square of its length.
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+").finditer
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+").finditer
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer
_DIGIT = re.compile("[0-9]").search
_MARKS = re.compile("[0-9@]").finditer
_DIGITS = re.compile("[^0-9]").sub
_PLAIN = re.compile(r"[^\w]+").sub


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN(text, at + 1)):
            done = m.end()
            yield begin, done
        at = text.find("@", at + 1)


def _ips(text: str):
    for m in _DOTTED(text):
        at = m.start()
        parts = m.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, in order."""
    found = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT(text):
        found += [(a, 1, b) for a, b in _ips(text)]
        for m in _CARD(text):
            digits = _DIGITS("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in _PHONE(text):
            if 10 <= len(_DIGITS("", m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


_SPACE = frozenset(" \t\n\x0b\x0c\r")
_BUCKETS = 1 << 14
_FEATURES = 10
#: A node is taken for personal data from this probability on.
SURE = 0.9


def _checks(token: str) -> str:
    """What a number's digits say: a card's check digit, an address's parts."""
    digits = _DIGITS("", token[:64])
    if 14 <= len(digits) <= 19 and len(digits) + 4 >= len(token):
        return f"luhn {luhn(digits)}"
    parts = token.split(".")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 9 for p in parts):
        return f"address {all(int(p) <= 255 for p in parts)}"
    return "none"


def _shape(token: str) -> str:
    return re.sub("[^\\W\\d_]", "a", re.sub("[0-9]", "9", token))


def _squeezed(shape: str) -> str:
    return re.sub(r"(.)\1+", r"\1+", shape)


def _word_before(text: str, at: int) -> str:
    end = at
    while end and text[end - 1] in _SPACE:
        end -= 1
    begin = end
    while begin and end - begin < 40 and text[begin - 1] not in _SPACE:
        begin -= 1
    return text[begin:end]


def _word_after(text: str, at: int) -> str:
    begin = at
    while begin < len(text) and text[begin] in _SPACE:
        begin += 1
    end = begin
    while end < len(text) and end - begin < 40 and text[end] not in _SPACE:
        end += 1
    return text[begin:end]


class Graph:
    """Nodes (token spans), their features, and edges (a, b, is_skip) of one text."""

    def __init__(self, text: str):
        self.spans: list[tuple[int, int]] = []
        self.features: list[int] = []
        self.edges: list[tuple[int, int, int]] = []
        done = 0
        last_end = -1
        latest: dict[str, int] = {}
        for m in _MARKS(text):
            if m.start() < done:
                continue
            begin = m.start()
            while begin > done and text[begin - 1] not in _SPACE:
                begin -= 1
            end = m.end()
            while end < len(text) and text[end] not in _SPACE:
                end += 1
            done = end
            whole = (begin, end)
            while text[begin] in "\"'[{<":
                begin += 1
            while text[end - 1] in ".,;:!?\"'}]>":
                end -= 1
            token = text[begin:end]
            node = len(self.spans)
            self.spans.append((begin, end))
            self.features += self._features(text, token, *whole)
            if last_end >= 0 and not text[last_end : whole[0]].strip():
                self.edges.append((node - 1, node, 0))
            last_end = whole[1]
            plain = _PLAIN("", token).lower()
            digits = _DIGITS("", token)
            for key in {"p" + plain, "d" + digits[-7:] if len(digits) >= 7 else "p" + plain}:
                if len(key) > 4:
                    if key in latest:
                        self.edges.append((latest[key], node, 1))
                    latest[key] = node

    @staticmethod
    def _features(text: str, token: str, begin: int, end: int) -> list[int]:
        shape = _shape(token[:64])
        before, after = _word_before(text, begin), _word_after(text, end)
        named = (
            "bias",
            "shape " + shape[:24],
            "squeezed " + _squeezed(shape),
            f"digits {min(20, shape.count('9'))}",
            "ends " + shape[:1] + shape[-1:],
            f"marks {'@' in token} {min(4, token.count('.'))} {min(3, token.count('-'))}",
            "before " + _squeezed(_shape(before)),
            "after " + _squeezed(_shape(after)),
            "word " + before.lower(),
            "checks " + _checks(token),
        )
        return [zlib.crc32(x.encode()) % _BUCKETS for x in named]

    def labels(self, spans) -> list[int]:
        """The kind that covers each node by more than half, plus 1, else 0."""
        out = []
        for a, b in self.spans:
            label = 0
            for begin, kind, end in spans:
                if begin >= b:
                    break
                if 2 * (min(b, end) - max(a, begin)) > b - a:
                    label = kind + 1
            out.append(label)
        return out


def _normal(x: np.ndarray, axis) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return x - top - np.log(np.exp(x - top).sum(axis=axis, keepdims=True))


def propagate(unary: np.ndarray, edges: np.ndarray, pair: np.ndarray, rounds: int = 12):
    """Log marginals of nodes and edges by loopy message passing.

    `edges` has rows (a, b, type), `pair` the log potentials of each type by the labels of a and b.
    Messages are damped by half; on a graph without loops they settle to the exact marginals.
    """
    a, b, kind = edges.T if len(edges) else np.zeros((3, 0), np.int64)
    n = len(a)
    source, target = np.concatenate([a, b]), np.concatenate([b, a])
    turned = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
    potential = np.concatenate([pair[kind], pair[kind].transpose(0, 2, 1)])
    sent = np.full((2 * n, _LABELS), -np.log(_LABELS))
    belief = unary.copy()
    for _ in range(rounds if n else 0):
        told = belief[source] - sent[turned]
        fresh = told[:, :, None] + potential
        top = fresh.max(axis=1)
        fresh = _normal(top + np.log(np.exp(fresh - top[:, None, :]).sum(axis=1)), 1)
        sent = _normal(0.5 * sent + 0.5 * fresh, 1)
        belief = unary.copy()
        np.add.at(belief, target, sent)
    told = belief[source] - sent[turned]
    both = told[:n, :, None] + told[n:, None, :] + potential[:n]
    return _normal(belief, 1), _normal(both.reshape(n, -1), 1).reshape(n, _LABELS, _LABELS) if n else both


def _joined(graphs: list[tuple[list[int], np.ndarray]]):
    """Features (nodes x features) and edges of several graphs side by side."""
    features = np.array([f for fs, _ in graphs for f in fs], dtype=np.int64).reshape(-1, _FEATURES)
    base = np.cumsum([0] + [len(fs) // _FEATURES for fs, _ in graphs])
    edges = [e + np.array([at, at, 0]) for (_, e), at in zip(graphs, base) if len(e)]
    return features, np.concatenate(edges) if edges else np.zeros((0, 3), np.int64), base


def _rows(edges) -> np.ndarray:
    return np.array(edges, dtype=np.int64).reshape(-1, 3)


def fit(graphs, labels: np.ndarray, steps: int = 60, rate: float = 0.3, decay: float = 1e-3):
    """(node weights, pair potentials) by gradient ascent on the likelihood, marginals by `propagate`."""
    weights = np.zeros((_BUCKETS, _LABELS))
    # Mentions that are alike are of one kind unless the sample says otherwise; it may have none.
    prior = np.zeros((2, _LABELS, _LABELS))
    prior[1] = np.diag([0.5] + [2.0] * len(KINDS))
    pair = prior.copy()
    # And a token of a kind not seen before is none.
    start = np.zeros_like(weights)
    start[zlib.crc32(b"bias") % _BUCKETS, 0] = 3.0
    weights += start
    features, edges, _ = _joined(graphs)
    if not len(features):
        return weights, pair
    seen, seen_pair = np.full_like(weights, 1e-6), np.full_like(pair, 1e-6)
    truth = np.eye(_LABELS)[labels]
    for _ in range(steps):
        node, edge = propagate(weights[features].sum(axis=1), edges, pair)
        miss = truth - np.exp(node)
        step = np.zeros_like(weights)
        for j in range(_FEATURES):
            np.add.at(step, features[:, j], miss)
        step -= decay * len(labels) * (weights - start)
        step_pair = -decay * len(labels) * (pair - prior)
        if len(edges):
            actual = np.zeros_like(edge)
            actual[np.arange(len(edges)), labels[edges[:, 0]], labels[edges[:, 1]]] = 1
            np.add.at(step_pair, edges[:, 2], actual - np.exp(edge))
        seen += step**2
        seen_pair += step_pair**2
        weights += rate * step / np.sqrt(seen)
        pair += rate * step_pair / np.sqrt(seen_pair)
    return weights, pair


def sample_texts(docs: DataFrame, sample: int) -> DataFrame:
    """text: at most `sample` distinct texts with a digit or at sign, those of the smallest hash."""
    texts = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    # Hashes are made distinct first, so that no group of copies fills the sample; texts follow by their hash.
    hashes = texts.select(F.xxhash64("text").alias("_hash")).distinct()
    some = F.broadcast(bounded_sample(hashes, F.col("_hash"), sample))
    return texts.join(some, F.xxhash64("text") == F.col("_hash")).groupBy("_hash").agg(F.min("text").alias("text")).select("text")


def train(docs: DataFrame, sample: int = 1000):
    """Model from at most `sample` distinct texts (`sample_texts`), with the patterns' spans as labels."""
    ship(docs.sparkSession)

    def describe(batches):
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                graph = Graph(text)
                rows.append((graph.features, np.array(graph.edges, dtype=np.int64).ravel(), graph.labels(base_spans(text))))
            kinds = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kinds) for i in range(3)], ["features", "edges", "labels"]
            )

    found = sample_texts(docs, sample).mapInArrow(describe, "features array<long>, edges array<long>, labels array<long>").toArrow().to_pylist()
    graphs = [(r["features"], _rows(r["edges"])) for r in found]
    labels = np.array([x for r in found for x in r["labels"]], dtype=np.int64)
    weights, pair = fit(graphs, labels)
    return weights.astype(np.float32), pair


def all_spans(texts: list[str], model) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text. Spans are (start, kind, end), in order."""
    weights, pair = model
    found = [(base_spans(t), Graph(t)) if "@" in t or _DIGIT(t) else ([], None) for t in texts]
    graphs = [(g.features, _rows(g.edges)) for _, g in found if g is not None]
    features, edges, base = _joined(graphs)
    node, _ = propagate(weights[features].sum(axis=1).astype(np.float64), edges, pair) if len(features) else (np.zeros((0, _LABELS)), None)
    chance = np.exp(node)
    best = np.where(chance.max(axis=1) >= SURE, chance.argmax(axis=1), 0) if len(chance) else np.zeros(0, int)
    out, k = [], 0
    for spans, graph in found:
        if graph is None:
            out.append((spans, spans))
            continue
        mine = best[base[k] : base[k + 1]].tolist()
        k += 1
        out.append((spans, sorted({*spans, *_added(graph, mine, spans)})))
    return out


def _added(graph: Graph, labels: list[int], spans) -> list[tuple[int, int, int]]:
    """Runs of neighbouring nodes of one kind that no base span of any kind touches."""
    joined = {b for a, b, skip in graph.edges if not skip}
    runs: list[tuple[int, int, int]] = []
    open_label = 0
    for i, ((begin, end), label) in enumerate(zip(graph.spans, labels)):
        if label and label == open_label and i in joined:
            runs[-1] = (runs[-1][0], label - 1, end)
        elif label:
            runs.append((begin, label - 1, end))
        open_label = label
    free, at = [], 0
    for run in runs:
        while at < len(spans) and spans[at][2] <= run[0] and at + 1 < len(spans):
            at += 1
        near = spans[max(0, at - 4) : at + 8]
        if run[0] < run[2] and not any(s[0] < run[2] and run[0] < s[2] for s in near):
            free.append(run)
    return free


def _written(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{begin}:{end}" for begin, kind, end in spans)


def find_personal(docs: DataFrame, model=None, sample: int = 1000) -> DataFrame:
    """One row per row of `docs`: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and the hash are of the patterns' spans; `spans` also has those that the random field adds,
    which overlap none of them. Null text is empty. Repeated rows are judged each; only doc_id and
    text are read.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(train(docs, sample) if model is None else model)

    def run(batches):
        for batch in batches:
            for begun in range(0, batch.num_rows, 500):
                part = batch.slice(begun, 500)
                found = all_spans(pc.fill_null(part.column(1), "").to_pylist(), sent.value)
                counts = np.array([[sum(s[1] == k for s in b) for k in range(len(KINDS))] for b, _ in found], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        *(pa.array(c) for c in counts.T),
                        pa.array([hashlib.sha256(_written(b).encode()).hexdigest() for b, _ in found]),
                        pa.array([_written(s) for _, s in found]),
                    ],
                    ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        run, f"doc_id {kind}, {counts}, base_sha256 string, spans string"
    )


def masked(text: str, spans) -> str:
    """The text with every span replaced by its kind in brackets; overlapping ones go as one, of the first's kind."""
    out, at = [], 0
    for begin, kind, end in spans:
        if begin >= at:
            out += [text[at:begin], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def without_personal(docs: DataFrame, model=None, sample: int = 1000) -> DataFrame:
    """`docs` with personal data in `text` masked; null stays null."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(train(docs, sample) if model is None else model)
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for begun in range(0, batch.num_rows, 500):
                part = batch.slice(begun, 500)
                texts = part.column(place).to_pylist()
                found = all_spans([t or "" for t in texts], sent.value)
                fresh = [t and masked(t, spans) for t, (_, spans) in zip(texts, found)]
                yield part.set_column(place, part.schema.field(place), pa.array(fresh, part.column(place).type))

    return docs.mapInArrow(run, docs.schema)
