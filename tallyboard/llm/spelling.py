r"""Spelling variants of the corpus's words, found in a trie of letter-group counts.

Letters fall into a few groups, and a word's vector holds how many of its letters each group has. One
edit changes a vector by at most one more in one group (surplus) and one less in one group (deficit).
Words are therefore arranged in a trie by their successive counts, and a word's search goes down it
depth-first with a budget of one surplus and one deficit. The words of the leaves it reaches are verified.

A surplus is always spent first, so that each pair of unlike vectors is met from one side only. The top
of the trie deals the work: a node with too many words is split by its next count, so every cell that is
left is searched by one task, and a word is sent to the few cells its budget reaches.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tallyboard.llm import ship
from tallyboard.llm.words import SPACED, Words, chunks, mix, ranges
from tallyboard.session import stage

GROUPS = 8
#: A trie node with more words than this, and than this share of all, is split among more tasks.
CELL = 8_000
CELL_SHARE = 4_096
_CHUNK = 4 << 20
#: Longer words are verified one pair at a time.
_WIDE = 48


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_CRC = _crc_table()


def crc32_after(states: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of (what gave states[i]) followed by data[starts[i]:ends[i]]."""
    order = np.argsort(starts - ends, kind="stable")
    lengths = (ends - starts)[order]
    at = starts[order]
    state = states[order] ^ np.uint32(0xFFFFFFFF)
    most = min(256, int(lengths[0])) if len(lengths) else 0
    for j in range(most):
        n = int(np.searchsorted(-lengths, -j, side="left"))
        part = state[:n]
        state[:n] = _CRC[(part ^ data[at[:n] + j]) & np.uint32(255)] ^ (part >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(lengths > most):
        state[i] = zlib.crc32(data[at[i] + most : at[i] + lengths[i]].tobytes(), int(state[i]))
    out = np.empty_like(state)
    out[order] = state
    return out


def _runs(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Runs of `[A-Za-z\\u00C0-\\u00FF]`; in UTF-8 the latter are the byte 0xC3 and the one behind it."""
    letter = (data | 0x20) - np.uint8(0x61) < 26
    lead = data == 0xC3
    letter |= lead
    letter[1:] |= lead[:-1]
    return Words(np.where(letter, data, np.uint8(0x20)), offsets, SPACED)


def _spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Strings data[start:start + length]."""
    bounds = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(lengths, out=bounds[1:])
    body = data[np.repeat(starts, lengths) + ranges(lengths)]
    text = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(body)))
    return text.cast(pa.string())


def count_chunk(ids: list[str], data: np.ndarray, offsets: np.ndarray, shortest: int, one_in: int) -> pa.RecordBatch:
    """word, n of a chunk of texts, after the deletions that the texts' ids ask for."""
    words = _runs(data, offsets)
    if not len(words):
        return pa.RecordBatch.from_arrays([pa.array([], pa.string()), pa.array([], pa.int64())], ["word", "n"])
    points = np.zeros(len(words.data) + 1, dtype=np.int64)
    np.cumsum((words.data & 0xC0) != 0x80, out=points[1:])
    length = points[words.ends] - points[words.starts]
    kept = np.flatnonzero(length >= shortest)
    owner = np.searchsorted(offsets, words.starts[kept], side="right") - 1
    before = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], dtype=np.uint32)
    h = crc32_after(before[owner], words.data, words.starts[kept], words.ends[kept])
    cut = h % np.uint32(one_in) == 0
    changed: Counter[str] = Counter()
    for i, code in zip(kept[cut].tolist(), h[cut].tolist()):
        word = words.data[words.starts[i] : words.ends[i]].tobytes().decode()
        at = code % len(word)
        if len(word) > shortest:
            changed[word[:at] + word[at + 1 :]] += 1
    plain = kept[~cut]
    hashes = words.hashes()[plain]
    _, first, n = np.unique(hashes, return_index=True, return_counts=True)
    pick = plain[first]
    texts = _spans(words.data, words.starts[pick], words.ends[pick] - words.starts[pick])
    texts = pa.concat_arrays([texts, pa.array(list(changed), pa.string())])
    return pa.RecordBatch.from_arrays([texts, pa.array(np.concatenate([n, list(changed.values())]).astype(np.int64))], ["word", "n"])


def word_counts(docs: DataFrame, shortest: int = 5, least: int = 3, one_in: int = 97) -> DataFrame:
    """word, n: the distinct runs of at least `shortest` code points that occur `least` times or more.

    A run whose crc32 with its document's id is a multiple of `one_in` loses one code point first.
    """
    ship(docs.sparkSession)

    def count(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi, data, offsets in chunks(batch.column(1), _CHUNK):
                yield count_chunk(ids[lo:hi], data, offsets, shortest, one_in)

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text"))
    found = texts.where("text IS NOT NULL").mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def letter_groups(words: DataFrame) -> np.ndarray:
    """Group of each code point below 256: letters by falling frequency, each to the lightest group so far."""
    letters = words.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").count().collect()
    load = [0] * GROUPS
    groups = np.zeros(256, dtype=np.int64)
    for row in sorted(letters, key=lambda r: (-r["count"], r["c"])):
        if row["c"]:
            lightest = load.index(min(load))
            groups[ord(row["c"])] = lightest
            load[lightest] += row["count"]
    return groups


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words (each below 256), number of each one's word, length of each word."""
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    owner = np.repeat(np.arange(n), np.diff(offsets))
    tail = (data & 0xC0) == 0x80
    keep = data != 0xC3
    code = np.where(tail, data | np.uint8(0xC0), data)[keep]
    owner = owner[keep]
    return code, owner, np.bincount(owner, minlength=n)


def vectors(column: pa.Array, groups: np.ndarray) -> np.ndarray:
    """Letters of each word in each group."""
    if not len(column):
        return np.zeros((0, GROUPS), dtype=np.int64)
    code, owner, lengths = _letters(column)
    return np.bincount(owner * GROUPS + groups[code], minlength=len(lengths) * GROUPS).reshape(-1, GROUPS)


def _children(have: np.ndarray, surplus: np.ndarray, deficit: np.ndarray, counts):
    """For each child count: (count, which of the searches go on there, their surplus, their deficit left).

    `have` is each search's own count; a surplus has to be spent before a deficit.
    """
    for c in counts:
        more = c - have
        go = (more == 0) | ((more == 1) & surplus) | ((more == -1) & deficit & ~surplus)
        at = np.flatnonzero(go)
        if len(at):
            yield c, at, surplus[at] & (more[at] != 1), deficit[at] & (more[at] != -1)


def reach(vecs: np.ndarray, nodes: dict[str, list[int]]):
    """(cell, words whose own cell it is or whose budget reaches it, which ones it is their own).

    `nodes` gives the counts that follow a split node's path; every path that isn't split is a cell.
    """
    every = np.arange(len(vecs))
    yes = np.ones(len(vecs), dtype=bool)
    todo = [("", 0, every, yes, yes.copy())]
    while todo:
        path, depth, at, surplus, deficit = todo.pop()
        if path not in nodes:
            yield path, at, surplus & deficit
            continue
        for c, go, s, d in _children(vecs[at, depth], surplus, deficit, nodes[path]):
            todo.append((f"{path}{c}.", depth + 1, at[go], s, d))


def _near(a: np.ndarray, b: np.ndarray, short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether rows of codes are one edit apart; b's rows are as long as a's or longer by one."""
    width = a.shape[1]
    place = np.arange(width)
    unlike = (a != b) & (place < long[:, None])
    first = np.where(unlike.any(axis=1), unlike.argmax(axis=1), width)
    moved = np.zeros_like(b)
    moved[:, :-1] = b[:, 1:]
    off = (a != moved) & (place < short[:, None]) & (place >= first[:, None])
    return np.where(short == long, unlike.sum(axis=1) == 1, (long == short + 1) & ~off.any(axis=1))


def near_words(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes a to b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def cell_pairs(words: pa.Array, own: np.ndarray, depth: int, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all near pairs of a word of the cell with a word of the cell or a visitor, each once.

    The cell is a trie node of `depth` counts; only a leaf's words with an equal half are verified, as one
    edit leaves the first or the last half of the shorter word as it is.
    """
    none = np.zeros(0, dtype=np.int64)
    vecs = vectors(words, groups)
    code, owner, length = _letters(words)
    home = np.flatnonzero(own)
    if not len(home):
        return none, none
    sort = np.lexsort(vecs[home].T[::-1])
    rows = vecs[home][sort]
    begins = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])
    leaves = rows[begins]
    leaf_of = np.empty(len(home), dtype=np.int64)
    leaf_of[sort] = np.cumsum(begins) - 1
    path = leaves[0, :depth]
    more = vecs[:, :depth] - path
    surplus, deficit = ~(more == -1).any(axis=1), ~(more == 1).any(axis=1)
    todo = [(0, len(leaves), depth, np.arange(len(words)), surplus, deficit)]
    search, leaf = [], []
    while todo:
        lo, hi, level, at, s, d = todo.pop()
        if level == GROUPS:
            search.append(at)
            leaf.append(np.full(len(at), lo))
            continue
        column = leaves[lo:hi, level]
        edges = np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1, [hi - lo]])
        bounds_of = {int(column[i]): (lo + int(i), lo + int(j)) for i, j in zip(edges[:-1], edges[1:])}
        for c, go, s2, d2 in _children(vecs[at, level], s, d, bounds_of):
            todo.append((*bounds_of[c], level + 1, at[go], s2, d2))
    search, leaf = np.concatenate(search), np.concatenate(leaf)
    # Hashes of first and last halves, by cumulative sums over the letters.
    bounds = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(length, out=bounds[1:])

    def span(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        total = np.zeros(len(begin), dtype=np.uint64)
        for j in range(int(size.max()) if len(size) else 0):
            live = size > j
            total[live] = mix(total[live] + code[begin[live] + j].astype(np.uint64) + np.uint64(1))
        return total

    leaf_length = leaves.sum(axis=1)
    found = []
    # Lengths differ by at most one, so the half is taken of the home word's length, or of one less.
    for less in (0, 1):
        fits = (length[search] < leaf_length[leaf]) == bool(less)
        who, where = search[fits], leaf[fits]
        half = (leaf_length[where] - less) // 2
        half_home = (length[home] - less) // 2
        for last in (False, True):
            key_home = span(bounds[home] + (length[home] - half_home) * last, half_home)
            key = span(bounds[who] + (length[who] - half) * last, half)
            order = np.lexsort([key_home, leaf_of])
            packed = mix(key_home[order] + mix(leaf_of[order].astype(np.uint64) + np.uint64(7)))
            resort = np.argsort(packed, kind="stable")
            packed, order = packed[resort], order[resort]
            wanted = mix(key + mix(where.astype(np.uint64) + np.uint64(7)))
            left, right = np.searchsorted(packed, wanted, "left"), np.searchsorted(packed, wanted, "right")
            sizes = right - left
            a = np.repeat(who, sizes)
            b = home[order[np.repeat(left, sizes) + ranges(sizes)]]
            # Of words with one vector each pair is taken once; others are met from one side only.
            same = own[a] & (a >= b) & (length[a] == length[b]) & (vecs[a] == vecs[b]).all(axis=1)
            found.append(a[~same] * len(words) + b[~same])
    a, b = np.divmod(np.unique(np.concatenate(found)), len(words))
    swap = length[a] > length[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    wide = length[b] > _WIDE
    good = np.zeros(len(a), dtype=bool)
    table = np.zeros((len(words), _WIDE + 1), dtype=np.uint8)
    fits = length[owner] <= _WIDE
    table[owner[fits], (np.arange(len(code)) - bounds[owner])[fits]] = code[fits]
    for lo in range(0, len(a), 100_000):
        x, y = a[lo : lo + 100_000], b[lo : lo + 100_000]
        good[lo : lo + 100_000] = _near(table[x], table[y], length[x], length[y])
    for i in np.flatnonzero(wide):
        good[i] = near_words(words[int(a[i])].as_py(), words[int(b[i])].as_py())
    return a[good], b[good]


def split_nodes(words: DataFrame, groups: np.ndarray) -> dict[str, list[int]]:
    """The counts that follow each trie node of more than CELL words, or a CELL_SHARE-th of all if that is more.

    Of each level at most CELL_SHARE nodes are split, so this is a small table whatever the corpus.
    """

    def describe(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(vectors(batch.column(0), groups).tolist(), pa.list_(pa.int64()))], ["v"])

    table = stage(words.select("word").mapInArrow(describe, "v array<long>").groupBy("v").agg(F.count("*").alias("n")), "vectors")
    total = table.agg(F.sum("n")).first()[0] or 0
    most = max(CELL, total // CELL_SHARE)
    nodes: dict[str, list[int]] = {}
    heavy = [""] if total > most else []
    for depth in range(GROUPS):
        if not heavy:
            break
        path = F.concat_ws(".", F.slice("v", 1, depth), F.array(F.lit(""))) if depth else F.lit("")
        here = table.select(path.alias("path"), F.col("v")[depth].alias("c"), "n").where(F.col("path").isin(heavy))
        found = here.groupBy("path", "c").agg(F.sum("n").alias("n")).collect()
        heavy = []
        for row in found:
            nodes.setdefault(row["path"], []).append(row["c"])
            if row["n"] > most:
                heavy.append(f"{row['path']}{row['c']}.")
    return nodes


def near_table(words: DataFrame) -> DataFrame:
    """word, near, near_n: each word with each word that is one edit away, for a table of distinct words."""
    groups = letter_groups(words)
    nodes = split_nodes(words, groups)
    sent = words.sparkSession.sparkContext.broadcast((groups, nodes))

    def route(batches):
        groups, nodes = sent.value
        for batch in batches:
            for cell, at, own in reach(vectors(batch.column(0), groups), nodes):
                picked = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([cell] * len(at), pa.string()), *picked.columns, pa.array(own)], ["cell", "word", "n", "own"]
                )

    def search(table: pa.Table) -> pa.Table:
        groups, _ = sent.value
        depth = table.column("cell")[0].as_py().count(".")
        word, n = table.column("word").combine_chunks(), table.column("n").combine_chunks()
        a, b = cell_pairs(word, table.column("own").to_numpy(), depth, groups)
        one, two = pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a]))
        return pa.table({"word": word.take(one), "near": word.take(two), "near_n": n.take(two)})

    dealt = words.select("word", "n").mapInArrow(route, "cell string, word string, n long, own boolean")
    return dealt.groupBy("cell").applyInArrow(search, "word string, near string, near_n long")


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """word, root of every word of (word, form), where no chain of forms is longer than `steps`.

    Each round doubles how far a word has followed its forms.
    """
    found = stage(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(max(0, math.ceil(math.log2(max(1, steps))))):
        beyond = found.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        moved = Observation()
        on = found.join(beyond, found["root"] == beyond["_at"], "left")
        on = on.observe(moved, F.count("_next").alias("n")).select("word", F.coalesce("_next", "root").alias("root"))
        found = stage(on, "roots")
        if not moved.get["n"]:
            break
    return found


def spelling_forms(docs: DataFrame, shortest: int = 5, least: int = 3, one_in: int = 97, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of the distinct words of `docs` (columns doc_id, text; others are left alone).

    A word's form is its near word of largest n, of equal ones the smallest, if that n is at least
    `times` the word's. Null and empty texts have no words; a null id counts as an empty one; a row
    that is given twice counts twice. Texts and words of any length are taken whole. Without words the result is empty.
    """
    if times < 2:
        raise ValueError("times must be 2 or more, so that forms can't go in a circle")
    words = stage(word_counts(docs, shortest, least, one_in), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("best")
    near = near_table(words).groupBy(F.col("word").alias("_word")).agg(F.count("*").alias("n_near"), best)
    table = words.join(near, words["word"] == near["_word"], "left")
    enough = -F.col("best.n") >= times * F.col("n")
    table = table.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n"),
    )
    table = stage(table, "forms")
    top = words.agg(F.max("n")).first()[0] or 1
    # n at least doubles with each step.
    found = roots(table.where("form IS NOT NULL").select("word", "form"), int(math.log2(max(1, top / least))) + 1)
    found = found.withColumnRenamed("word", "_word")
    joined = table.join(found, table["word"] == found["_word"], "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
