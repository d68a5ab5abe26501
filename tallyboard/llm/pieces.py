"""SentencePiece encoding and decoding with forward states shared between common prefixes.

Texts are cut into marked words: a run of word marks and what follows it up to the next mark or line
end. No piece goes across those cuts. The distinct words of a chunk that are not known yet are sorted,
which lays them out as the depth-first walk of their trie, and each word goes on from the forward
states of the prefix that it shares with the word before.

The public model at hand is of the BPE kind, where the best sum of scores is not what the library
gives. The forward state of a prefix is therefore the last piece of its encoding: a piece may follow
another exactly if the two, merged together, come out as those two. One piece fits at the end of each
prefix, so the state is one number, and the walk is a Viterbi search whose ties are settled.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard.llm import ship

MARK = "▁"
#: Words and pairs that a worker remembers; beyond that it keeps the words of the texts at hand, which changes no result.
KEPT_WORDS = 500_000
KEPT_CHARS = 8_000_000
KEPT_PAIRS = 300_000
_SLICE = 2 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _one_by_one(error):
    return "�", error.start + 1


codecs.register_error("tallyboard-pieces", _one_by_one)


class Pieces:
    """A BPE model with byte fallback and identity normalization; ids as the library gives them."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize("\uff42  a ") != "▁\uff42▁▁a▁":
            raise ValueError(f"{path}: a dummy prefix and identity normalization are expected")
        ids = range(model.vocab_size())
        self.byte_ids = {int(model.id_to_piece(i)[1:-1], 16): i for i in ids if model.is_byte(i)}
        own = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.ids = {model.id_to_piece(i): i for i in own}
        if any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in self.ids):
            raise ValueError(f"{path}: a piece goes on after a word's end")
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in own}
        # How an id reads. Bytes beyond ASCII are joined as escapes and decoded at the end.
        self.spelled = [""] * len(ids)
        for piece, i in self.ids.items():
            self.spelled[i] = piece
        for b, i in self.byte_ids.items():
            self.spelled[i] = chr(b) if b < 0x80 else chr(0xDC00 + b)
        self.spelled[model.unk_id()] = " ⁇ "
        self.controls = frozenset(i for i in ids if model.is_control(i))
        # The same as bytes, where the bytes of one character may be several pieces.
        raw = [x.replace(MARK, " ").encode("utf-8", "surrogateescape") for x in self.spelled]
        for b, i in self.byte_ids.items():
            raw[i] = bytes([b])
        self.raw = pa.array(raw, pa.binary())
        self.marked = np.array([x[:1] == MARK for x in self.spelled])
        # Pieces that come out of their own text; the others end no prefix.
        alone = [p for p in self.ids if self._merge(p) == [p]]
        self.pieces = {p: p for p in alone}
        endings: dict[str, set[int]] = {}
        for p in alone:
            if len(p) > 1:
                endings.setdefault(p[-2:], set()).add(len(p))
        self.endings = {k: sorted(v, reverse=True) for k, v in endings.items()}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}  # ids as 32-bit numbers
        self.known_chars = 0

    def _merge(self, text: str) -> list[str]:
        """The pieces of a short text: the best-scored neighbours merge first, the leftmost of equals."""
        parts = list(text)
        after = list(range(1, len(parts))) + [-1]
        before = list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (both := parts[i] + parts[after[i]]) in self.scores:
                heapq.heappush(queue, (-self.scores[both], i, both))

        for i in range(len(parts) - 1):
            offer(i)
        while queue:
            _, i, both = heapq.heappop(queue)
            j = after[i] if parts[i] else -1
            if j < 0 or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, ""
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p]

    def _fits(self, pair: tuple[str, str]) -> bool:
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        ok = self.pairs[pair] = self._merge(pair[0] + pair[1]) == list(pair)
        return ok

    def walk(self, words: list[str]) -> None:
        """Encode sorted words; each goes on where it parts from the one before."""
        pieces, endings, pairs, fits, known = self.pieces, self.endings, self.pairs, self._fits, self.known
        last: list[str] = [""]  # last[i]: the last piece of the first i characters
        previous = ""
        for word in words:
            shared = 0
            for a, b in zip(previous, word):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                found = word[end - 1]
                if end > 1:
                    for n in endings.get(word[end - 2 : end], ()):
                        if n > end:
                            continue
                        piece = word[end - n : end]
                        own = pieces.get(piece)
                        if own is not None:
                            if n == end:
                                found = own
                                break
                            pair = (last[end - n], own)
                            ok = pairs.get(pair)
                            if ok is None:
                                ok = fits(pair)
                            if ok:
                                found = own
                                break
                last.append(found)
            previous = word
            backwards, at = [], len(word)
            while at:
                backwards.append(last[at])
                at -= len(last[at])
            known[word] = self._ids(backwards)

    def _ids(self, backwards: list[str]) -> bytes:
        ids, out = self.ids, array("i")
        for p in reversed(backwards):
            i = ids.get(p)
            if i is None:
                out.extend(self.byte_ids[b] for b in p.encode())
            else:
                out.append(i)
        return out.tobytes()

    _find = staticmethod(re.compile(f"{MARK}+[^{MARK}]*").findall)

    def marked_words(self, text: str) -> list[str]:
        if not text:
            return []
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            words = self._find(MARK + text.replace(" ", MARK))
        else:
            words = (MARK + text.replace(" ", " " + MARK)).split(" ")
        if "\n" not in text:
            return words
        out = []
        for word in words:
            if "\n" in word:
                # A line end is no piece's, so the word falls apart there.
                head, *rest = word.split("\n")
                out.append(head)
                for x in rest:
                    out.append("\n")
                    if x:
                        out.append(x)
            else:
                out.append(word)
        return out

    def encode(self, texts: list[str]) -> list[array]:
        """Ids of each text."""
        cut = [self.marked_words(t) for t in texts]
        known = self.known
        new = {w for words in cut for w in words if w not in known}
        chars = sum(map(len, new))
        # A word of a text without spaces may be all of it, so characters are counted as well.
        if len(known) + len(new) > KEPT_WORDS or self.known_chars + chars > KEPT_CHARS:
            known = self.known = {w: known[w] for words in cut for w in words if w in known}
            self.known_chars = sum(map(len, known))
        self.known_chars += chars
        self.walk(sorted(new))
        out = []
        for words in cut:
            ids = array("i")
            ids.frombytes(b"".join(map(known.__getitem__, words)))
            out.append(ids)
        return out

    def forget(self) -> None:
        """Give the words' memory back; a worker may wait for long before its next task."""
        self.known = {}
        self.known_chars = 0

    def reads_as(self, encoded: list[array], texts: list[str]) -> list[bool]:
        """Whether the ids of each row decode to its text.

        The bytes of all rows' ids are taken at once; a row whose bytes aren't the text's is decoded by itself.
        """
        flat = np.concatenate([np.frombuffer(x, np.int32) for x in encoded if x] or [np.zeros(0, np.int32)])
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in encoded])]).astype(np.int64)
        taken = self.raw.take(pa.array(flat))
        places = np.frombuffer(taken.buffers()[1], np.int32)[: len(flat) + 1]
        body = taken.buffers()[2].to_pybytes() if len(flat) else b""
        begins, ends = places[bounds[:-1]].tolist(), places[bounds[1:]].tolist()
        out = []
        for ids, text, begin, end in zip(encoded, texts, begins, ends):
            skipped = 1 if ids and self.marked[ids[0]] else 0
            out.append(body[begin + skipped : end] == text.encode() or self.decode(ids) == text)
        return out

    def decode(self, ids) -> str:
        spelled = self.spelled
        if self.controls.isdisjoint(ids):
            text = _joined("".join(map(spelled.__getitem__, ids)))
        else:
            # Bytes on either side of a control piece are no characters together.
            text, run = "", []
            for i in ids:
                if i in self.controls:
                    text, run = text + _joined("".join(run)), []
                else:
                    run.append(spelled[i])
            text += _joined("".join(run))
        # The first piece that reads as anything loses its mark.
        first = next((x for x in map(spelled.__getitem__, ids) if x), "")
        return text[1:] if first[:1] == MARK else text


def _joined(text: str) -> str:
    text = text.replace(MARK, " ")
    if not text.isascii() and re.search("[\udc80-\udcff]", text):
        text = text.encode("utf-8", "surrogateescape").decode("utf-8", "tallyboard-pieces")
    return text


_models: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def _slices(texts: pa.Array):
    """Lists of texts of about 2 MB; null is empty."""
    texts = pc.fill_null(texts, "")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    begun = 0
    while begun < len(texts):
        base = sizes[begun - 1] if begun else 0
        end = max(begun + 1, int(np.searchsorted(sizes, base + _SLICE, side="right")))
        yield begun, texts.slice(begun, end - begun).to_pylist()
        begun = end


def _ids_array(encoded: list[array]) -> pa.ListArray:
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in encoded])]).astype(np.int32)
    flat = np.concatenate([np.frombuffer(x, np.int32) for x in encoded if x] or [np.zeros(0, np.int32)])
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))


def encode(docs: DataFrame, path: str | None = None, text: str = "text", into: str = "ids") -> DataFrame:
    """`docs` with `into`, the ids of `text`, as its last column; a column of that name is replaced.

    `path` is a model file that each worker can open. Null and empty texts have no ids.
    """
    ship(docs.sparkSession)
    path = path or default_path()
    docs = docs.drop(into)
    place = docs.columns.index(text)

    def run(batches):
        model = pieces(path)
        for batch in batches:
            for begun, texts in _slices(batch.column(place).cast(pa.large_string())):
                part = batch.slice(begun, len(texts))
                names = [*part.schema.names, into]
                yield pa.RecordBatch.from_arrays([*part.columns, _ids_array(model.encode(texts))], names)
        model.forget()

    kind = f"{docs._jdf.schema().toDDL()}, `{into}` array<int>"
    return docs.mapInArrow(run, kind)


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids", into: str = "text") -> DataFrame:
    """`encoded` with `into`, the text of `ids`, as its last column; null ids are an empty text."""
    ship(encoded.sparkSession)
    path = path or default_path()
    encoded = encoded.drop(into)
    place = encoded.columns.index(ids)

    def run(batches):
        for batch in batches:
            texts = [pieces(path).decode(x.values.to_pylist()) if x.is_valid else "" for x in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, into])

    kind = f"{encoded._jdf.schema().toDDL()}, `{into}` string"
    return encoded.mapInArrow(run, kind)


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids_sha256 (of the ids as little-endian 32-bit numbers) and
    round_trip (whether the ids decode to the text) of every row.

    Null and empty texts have no ids and read as empty; texts of any length are encoded whole; repeated
    rows are rows by themselves; other columns are left alone.
    """
    ship(docs.sparkSession)
    path = path or default_path()

    def run(batches):
        model = pieces(path)
        bytes_of = np.zeros(len(model.spelled), dtype=bool)
        bytes_of[list(model.byte_ids.values())] = True
        for batch in batches:
            for begun, texts in _slices(batch.column(1)):
                encoded = model.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begun, len(texts)),
                        pa.array([len(x) for x in encoded], pa.int64()),
                        pa.array([int(bytes_of[np.frombuffer(x, np.int32)].sum()) if x else 0 for x in encoded], pa.int64()),
                        pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in encoded]),
                        pa.array(model.reads_as(encoded, texts)),
                    ],
                    ["doc_id", "n_pieces", "n_byte_pieces", "ids_sha256", "round_trip"],
                )
        # The words stay for the worker's next task; their number and length are bounded.

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        run, f"doc_id {kind}, n_pieces long, n_byte_pieces long, ids_sha256 string, round_trip boolean"
    )
