r"""Token counts with a shortcut for whole tokens.

Many pre-tokens of a text are themselves vocabulary strings that encode alone to just their own id.
Which strings do is proved once per worker, offline, by merging the whole vocabulary; a pre-token
found in that set counts as one token without any merging. Only the rest goes through the library's
merges.

Splitting follows the tokenizer file: its special strings first (each is one token, as is the
library's default), then the byte-level pattern, whose `\s` is Unicode white space. No pre-token of
that pattern goes on over white space, so what lies between two single spaces is counted by itself,
and its count is kept for the next time it occurs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard.llm import ship

#: Fixed: the split pattern of byte-level BPE files, white space spelled out.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Counts kept by a worker; beyond that it starts anew. It bounds memory and changes no result.
KEPT = 300_000
_UNSURE = 1 << 48


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """How byte-level files spell a byte: printable ones as they are, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class TokenCounter:
    """Counts tokens of texts as the library does for a byte-level BPE file."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.model = tokenizer.model
        self.find = regex.compile(PATTERN).findall
        self.letters = _byte_letters()
        specials = sorted((x.content for x in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.specials = specials
        self.cut = regex.compile("|".join(map(regex.escape, specials))).split if specials else None
        self.whole = self._whole_tokens(tokenizer)
        self.after_space: dict[str, int] = {}

    def _whole_tokens(self, tokenizer) -> frozenset[str]:
        """The vocabulary strings that are one pre-token and that the merges make their own id."""
        ids = [i for i in tokenizer.get_vocab(with_added_tokens=False).values()]
        strings = tokenizer.decode_batch([[i] for i in ids], skip_special_tokens=False)
        return frozenset(
            s for i, s in zip(ids, strings) if s and self.find(s) == [s] and [t.id for t in self._merge(s)] == [i]
        )

    def _merge(self, piece: str) -> list:
        return self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))

    def _count(self, text: str) -> int:
        """Tokens of a text without special strings."""
        whole, merge = self.whole, self._merge
        return sum(1 if x in whole else len(merge(x)) for x in self.find(text))

    def count(self, text: str) -> int:
        if self.cut is not None and any(s in text for s in self.specials):
            parts = self.cut(text)
            return len(parts) - 1 + sum(map(self._count, parts))
        head, *rest = text.split(" ")
        known = self.after_space
        total = 0
        for part in rest:
            n = known.get(part)
            if n is None:
                if len(known) >= KEPT:
                    known.clear()
                # Next to more white space a space is not simply the start of the next pre-token.
                alone = part and not part[0].isspace() and not part[-1].isspace()
                n = known[part] = self._count(" " + part) if alone else _UNSURE
            total += n
        if total >= _UNSURE or (rest and (not head or head[-1].isspace())):
            return self._count(text)
        return total + self._count(head)


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; one row out for each row in.

    `path` is a byte-level BPE file that each worker can open. Null text is empty, and an empty text
    has no tokens. Repeated rows are counted each; other columns are not read.
    """
    ship(docs.sparkSession)
    path = path or default_path()

    def count(batches):
        count_of = counter(path).count
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            n = np.fromiter((count_of(x.as_py()) for x in texts), dtype=np.int64, count=len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )
        # A worker may wait for long before its next task.
        counter(path).after_space.clear()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )
