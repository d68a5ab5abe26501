r"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of `size` words, and a window is the set of its shingles of up to five
words. A document that contains a window contains every one of its shingles, so the necessary prefix
is a single one: the rarest in the corpus, by counts over all documents. Documents are joined to the
windows on those prefix shingles alone; a candidate must leave room for the window before and after
(positional and length bounds) and is then compared with it word by word.

The corpus is read twice, once to count the benchmark's shingles and once to find the rare ones. Both
passes look shingles up in a bit table of a fixed 4 MB, so what is sent to executors does not grow
with the benchmark or the corpus; what passes it by chance is dropped by the joins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyboard.llm import ship
from tallyboard.llm.words import ALNUM, Words, chunks, shingle_hashes, shingle_heads
from tallyboard.session import stage

#: Words of a shingle, or all of a window that has fewer.
SHINGLE = 5
_LOG_BITS = 25
_MASK = (1 << _LOG_BITS) - 1


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def bit_table(tokens: DataFrame) -> np.ndarray:
    """4 MB of bits, two set for each value of the long column `token`; OR-ed together by executors."""
    spots = tokens.select(
        F.explode(F.array(F.col("token").bitwiseAND(_MASK), F.shiftrightunsigned("token", 30).bitwiseAND(_MASK))).alias("at")
    )
    found = (
        spots.groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits"))
        .toArrow()
    )
    table = np.zeros(1 << (_LOG_BITS - 6), dtype=np.uint64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return table


def _present(table: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Indices of the tokens whose two bits are set."""

    def lit(at: np.ndarray) -> np.ndarray:
        return (table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1

    first = np.flatnonzero(lit(tokens & np.uint64(_MASK)))
    return first[lit((tokens[first] >> np.uint64(30)) & np.uint64(_MASK))]


def item_windows(bench: DataFrame, size: int) -> DataFrame:
    """item_id, window (its words, a space between them), n (words), shingles (offset and token)."""

    def cut(batches):
        for batch in batches:
            ids, rows = [], []
            for lo, _, data, offsets in chunks(batch.column(1)):
                words = Words(data, offsets, ALNUM)
                hashes = words.hashes()
                tokens = {k: _signed(shingle_hashes(hashes, k)) for k in range(1, SHINGLE + 1)}
                for i, n in enumerate(words.counts()):
                    width = min(size, int(n))
                    k = min(SHINGLE, width)
                    for at in range(int(words.first[i]), int(words.first[i]) + int(n) - width + 1) if n else ():
                        ids.append(lo + i)
                        offs = range(width - k + 1)
                        rows.append(
                            {
                                "window": words.text(at, at + width),
                                "n": width,
                                "k": k,
                                "shingles": [{"off": o, "token": int(tokens[k][at + o])} for o in offs],
                            }
                        )
            items = batch.column(0).take(pa.array(ids, pa.int64()))
            made = pa.array(rows, kind)
            yield pa.RecordBatch.from_arrays([items, *made.flatten()], ["item_id", "window", "n", "k", "shingles"])

    kind = pa.struct(
        [
            ("window", pa.string()),
            ("n", pa.int32()),
            ("k", pa.int32()),
            ("shingles", pa.list_(pa.struct([("off", pa.int32()), ("token", pa.int64())]))),
        ]
    )
    id_kind = bench.schema["item_id"].dataType.simpleString()
    return bench.select("item_id", F.col("text").cast("string")).mapInArrow(
        cut, f"item_id {id_kind}, window string, n int, k int, shingles array<struct<off int, token long>>"
    )


def _looked_up(batches, table, sizes):
    """Chunks of the last column of each batch with the shingles that are in the bit table."""
    bits = table.value
    for batch in batches:
        for lo, hi, data, offsets in chunks(batch.column(batch.num_columns - 1)):
            words = Words(data, offsets, ALNUM)
            hashes = words.hashes()
            none = np.zeros(0, np.int64)
            heads, owners, tokens, lengths = [none], [none], [none.view(np.uint64)], [none]
            for k in sizes:
                head, owner = shingle_heads(words.first, k)
                token = shingle_hashes(hashes, k)[head] if len(head) else np.zeros(0, np.uint64)
                hit = _present(bits, token)
                heads.append(head[hit])
                owners.append(owner[hit])
                tokens.append(token[hit])
                lengths.append(np.full(len(hit), k))
            yield batch, lo, hi, words, *map(np.concatenate, (heads, owners, tokens, lengths))


def shingle_counts(texts: DataFrame, table, sizes: list[int]) -> DataFrame:
    """token, seen: occurrences over all texts of the shingles in the bit table (a few others too)."""

    def count(batches):
        for *_, tokens, _ in _looked_up(batches, table, sizes):
            values, n = np.unique(tokens, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(values)), pa.array(n.astype(np.int64))], ["token", "n"])

    return texts.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("seen"))


def candidates(docs: DataFrame, table, sizes: list[int], size: int) -> DataFrame:
    """doc_id, text_key, n_words and `found`, the shingles in the bit table with the words around them."""

    def find(batches):
        for batch, lo, hi, words, heads, owners, tokens, lengths in _looked_up(batches, table, sizes):
            order = np.argsort(owners, kind="stable")
            heads, owners, tokens, lengths = heads[order], owners[order], tokens[order], lengths[order]
            begins, stops = words.first[owners], words.first[owners + 1]
            left = np.maximum(begins, heads - (size - lengths))
            right = np.minimum(stops, heads + size)
            around = [words.text(a, b) for a, b in zip(left, right)]
            found = pa.StructArray.from_arrays(
                [
                    pa.array(_signed(tokens)),
                    pa.array((heads - begins).astype(np.int64)),
                    pa.array((left - begins).astype(np.int64)),
                    pa.array(around, pa.string()),
                ],
                ["token", "at", "left", "around"],
            )
            bounds = np.searchsorted(owners, np.arange(hi - lo + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, hi - lo),
                    batch.column(1).slice(lo, hi - lo),
                    pa.array(words.counts().astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(bounds), found),
                ],
                ["doc_id", "text_key", "n_words", "found"],
            )

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        find,
        f"doc_id {id_kind}, text_key long, n_words long, "
        "found array<struct<token long, at long, left long, around string>>",
    )


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text) and text: the key tells apart rows that share a doc_id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text"))


def rare_prefixes(windows: DataFrame, seen: DataFrame) -> DataFrame:
    """Each distinct window once, with its rarest shingle: token, off, window, n."""
    each = windows.dropDuplicates(["window"]).select("window", "n", F.explode("shingles").alias("s"))
    each = each.select("window", "n", "s.off", "s.token").join(seen, "token", "left")
    rarest = Window.partitionBy("window").orderBy(F.coalesce("seen", F.lit(0)), "token", "off")
    return (
        each.withColumn("place", F.row_number().over(rarest)).where("place = 1").select("token", "off", "window", "n")
    )


def occurrences(docs: DataFrame, bench: DataFrame, size: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, hits, items): one row per document with n_words; where windows occur in documents; and
    the items of each window. The first and the last are tables in the shared folder."""
    spark = docs.sparkSession
    ship(spark)
    texts = keyed(docs)
    windows = stage(item_windows(bench, size), "windows")
    sizes = sorted(r.k for r in windows.select("k").distinct().collect())  # five at most
    shingles = windows.select(F.explode("shingles.token").alias("token"))
    all_bits = spark.sparkContext.broadcast(bit_table(shingles))
    seen = shingle_counts(texts.select("text"), all_bits, sizes)
    prefixes = stage(rare_prefixes(windows, seen), "prefixes")
    rare_bits = spark.sparkContext.broadcast(bit_table(prefixes))
    texts = stage(candidates(texts, rare_bits, sizes, size), "candidates")

    def words_of(around: str, begin: Column, n: Column) -> Column:
        return F.array_join(F.slice(F.split(around, " "), begin + 1, n), " ")

    near = texts.select("doc_id", "text_key", "n_words", F.explode("found").alias("f")).select(
        "doc_id", "text_key", "n_words", "f.*"
    )
    hits = (
        near.join(prefixes, "token")
        .withColumn("begin", F.col("at") - F.col("off"))
        .where((F.col("begin") >= F.col("left")) & (F.col("begin") + F.col("n") <= F.col("n_words")))
        .where(words_of("around", (F.col("begin") - F.col("left")).cast("int"), F.col("n")) == F.col("window"))
        .select("doc_id", "text_key", "begin", "n", "window")
    )
    return texts.select("doc_id", "text_key", "n_words"), hits, windows.select("window", "item_id").distinct()


def _onto(texts: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Join by document; ids may be null."""
    found = found.withColumnsRenamed({"doc_id": "_doc", "text_key": "_key"})
    on = texts["doc_id"].eqNullSafe(found["_doc"]) & (texts["text_key"] == found["_key"])
    return texts.join(found, on, how).drop("_doc", "_key")


def find_leaks(docs: DataFrame, bench: DataFrame, size: int = 10) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    `docs` needs doc_id and text, `bench` item_id and text; other columns are not read. Null text has
    no words, nor has an item without any a window. Rows that share doc_id and text get equal results;
    rows that share only the doc_id are kept apart. Items without an id count as hits, not as items.
    """
    texts, hits, items = occurrences(docs, bench, size)
    hits = stage(hits, "hits")
    key = ["doc_id", "text_key"]
    words = (
        hits.select(*key, F.explode(F.sequence("begin", F.col("begin") + F.col("n") - 1)).alias("at"))
        .distinct()
        .groupBy(*key)
        .agg(F.count(F.lit(1)).alias("n_hit"))
    )
    named = (
        hits.select(*key, "window").distinct().join(items, "window").select(*key, F.col("item_id").cast("string")).distinct()
        .groupBy(*key)
        .agg(F.count("item_id").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("ids"))
    )
    out = _onto(_onto(texts, words, "left"), named, "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def without_leaks(docs: DataFrame, bench: DataFrame, size: int = 10) -> DataFrame:
    """The rows of `docs` in which no window occurs, with all their columns."""
    _, hits, _ = occurrences(docs, bench, size)
    hits = hits.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).distinct()
    text_key = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(hits, docs["doc_id"].eqNullSafe(hits["_doc"]) & (text_key == hits["_key"]), "left_anti")
