r"""Ranked lexical search, term at a time with a limited set of accumulators.

Documents stay where Spark reads them, and every task holds postings of a bounded run of documents at a
time. A query's terms are worked off rarest first. As long as a document that has none of them yet could
still come among the best, a term's documents get accumulators; once the bounds of the terms that are left
can't reach the k-th best partial score, no accumulator is made any more and the survivors are scored to
the end. What a task has found so far raises that k-th score for its next run of documents. The tasks'
best k of each query are ranked by one window. All scores are whole numbers and exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyboard.llm import ship
from tallyboard.llm.words import ALNUM, Words, chunks
from tallyboard.session import stage

_CHUNK = 2 << 20
#: Postings and documents that a task holds at once; a chunk of texts is never cut.
_POSTINGS = 2_000_000
_RUN = 65_536
#: (query, term) pairs that go to the tasks at once; more queries are searched in several passes.
BLOCK = 1_000_000


def _term_counts(column: pa.Array, first_row: int, terms: np.ndarray):
    """(rows, terms in each row, postings as (row, index of the term, occurrences)) of each chunk of texts."""
    for lo, hi, data, offsets in chunks(column, _CHUNK):
        words = Words(data, offsets, ALNUM)
        hashes = words.hashes() if len(words) else np.zeros(0, np.uint64)
        at = np.searchsorted(terms, hashes)
        at[at == len(terms)] = 0
        known = np.flatnonzero(terms[at] == hashes) if len(terms) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(hi - lo), words.counts())
        packed, times = np.unique(owner[known] * max(1, len(terms)) + at[known], return_counts=True)
        row, term = np.divmod(packed, max(1, len(terms)))
        yield np.arange(first_row + lo, first_row + hi), words.counts(), row + first_row + lo, term, times


def query_terms(queries: DataFrame) -> DataFrame:
    """item_id, term (its hash as a long): each query's distinct terms; rows that share an id are one query."""

    def split(batches):
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1), _CHUNK):
                words = Words(data, offsets, ALNUM)
                if not len(words):
                    continue
                owner = np.repeat(np.arange(lo, hi), words.counts())
                term = pa.array(words.hashes().view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), term], ["item_id", "term"])

    kind = queries.schema["item_id"].dataType.simpleString()
    rows = queries.select("item_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    return rows.mapInArrow(split, f"item_id {kind}, term long").distinct()


def statistics(docs: DataFrame, terms: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents that hold each of `terms` (sorted hashes)."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches):
        terms = sent.value
        total = np.zeros(len(terms) + 2, dtype=np.int64)
        for batch in batches:
            for _, counts, _, term, _ in _term_counts(batch.column(0), 0, terms):
                total[0] += np.count_nonzero(counts)
                total[1] += counts.sum()
                total[2:] += np.bincount(term, minlength=len(terms))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    texts = docs.select(F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(len(terms) + 2, dtype=np.int64)
    total[found["at"].to_numpy()] = found["n"].to_numpy()
    return int(total[0]), int(total[1]), total[2:]


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def best_of(terms: list[tuple[int, int]], postings, n_rows: int, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and exact scores among which all rows are that can be one of the best k with a score of `least` or more.

    `terms` are (index, weight); postings(index) gives (rows, share of the weight, largest share).
    """
    terms = sorted(((w, i) for i, w in terms if w > 0), reverse=True)
    found = [postings(i) for _, i in terms]
    bounds = [w * top for (w, _), (_, _, top) in zip(terms, found)]
    left = sum(bounds)
    score = np.zeros(n_rows, dtype=np.int64)
    made: list[np.ndarray] = []
    kept = None
    for (w, _), (rows, share, _), bound in zip(terms, found, bounds):
        if kept is None:
            made.append(rows[score[rows] == 0])
            score[rows] += w * share
        elif len(kept):
            at = np.searchsorted(rows, kept)
            at[at == len(rows)] = 0
            hit = np.flatnonzero(rows[at] == kept) if len(rows) else np.zeros(0, np.int64)
            score[kept[hit]] += w * share[at[hit]]
        left -= bound
        if kept is None:
            have = np.concatenate(made)
            bar = least
            if len(have) >= k:
                bar = max(bar, int(np.partition(score[have], len(have) - k)[len(have) - k]))
            # A document without an accumulator can still get `left`; equal scores may still rank.
            if left < bar:
                kept = np.sort(have[score[have] + left >= bar])
    if kept is None:
        kept = np.concatenate(made) if made else np.zeros(0, np.int64)
    kept = kept[score[kept] >= max(1, least)]
    return kept, score[kept]


class _Run:
    """Postings of a run of documents, by term, and the best of it for each query."""

    def __init__(self, n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.ids, self.parts, self.rows, self.size = [], [], 0, 0

    def add(self, counts, row, term, times):
        m = 10 + (90 * counts.astype(np.int64) * self.n_docs) // max(1, self.n_terms)
        share = (1_000_000_000 * times) // (1000 * times + 8 * m[row - self.rows])
        self.parts.append((term, row, share))
        self.rows += len(counts)
        self.size += len(row)

    def close(self, queries, k: int, best: dict):
        """Put the run's best into `best`: query -> its k best (-score, id is null, id)."""
        ids = pa.chunked_array(self.ids).combine_chunks()
        ids = ids if isinstance(ids, pa.Array) else pa.concat_arrays(ids.chunks)
        place = np.empty(len(ids), dtype=np.int64)
        place[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
        term, row, share = (np.concatenate([p[j] for p in self.parts]) for j in range(3))
        order = np.argsort(term, kind="stable")
        term, row, share = term[order], row[order], share[order]
        known: dict[int, tuple] = {}

        def postings(i):
            if i not in known:
                lo, hi = np.searchsorted(term, [i, i + 1])
                known[i] = (row[lo:hi], share[lo:hi], int(share[lo:hi].max()) if hi > lo else 0)
            return known[i]

        for q, terms in queries.items():
            have = best.get(q, [])
            least = -have[-1][0] if len(have) == k else 1
            rows, scores = best_of(terms, postings, self.rows, k, least)
            if len(rows):
                top = np.lexsort([place[rows], -scores])[:k]
                more = [(-int(s), x is None, x) for s, x in zip(scores[top], ids.take(pa.array(rows[top])).to_pylist())]
                best[q] = sorted([*have, *more], key=lambda r: r[:2] if r[1] else r)[:k]


def _search(docs: DataFrame, queries: dict, terms: np.ndarray, totals: tuple[int, int], k: int) -> DataFrame:
    """query (its number), doc_id, score: at least the best k of each query."""
    sent = docs.sparkSession.sparkContext.broadcast((queries, terms, totals))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        queries, terms, totals = sent.value
        best: dict = {}
        held, doc_type = _Run(*totals), None
        for batch in batches:
            ids, doc_type, at = batch.column(0), batch.schema.field(0).type, 0
            for rows, counts, row, term, times in _term_counts(batch.column(1), 0, terms):
                held.ids.append(ids.slice(at, len(rows)))
                held.add(counts, row - at + held.rows, term, times)
                at += len(rows)
                if held.size >= _POSTINGS or held.rows >= _RUN:
                    held.close(queries, k, best)
                    held = _Run(*totals)
        if held.rows:
            held.close(queries, k, best)
        flat = [(q, x, -s) for q, top in best.items() for s, _, x in top]
        if flat:
            q, x, s = zip(*flat)
            columns = [pa.array(q, pa.int64()), pa.array(x, doc_type), pa.array(s, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["query", "doc_id", "score"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    return texts.mapInArrow(run, f"query long, doc_id {kind}, score long")


def _blocks(table: DataFrame):
    """Runs of whole queries, as {number: hashes}, of about BLOCK pairs each, read from the table bit by bit."""
    block, size, last = {}, 0, None
    for row in table.orderBy("query").toLocalIterator():
        if size >= BLOCK and row["query"] != last:
            yield block
            block, size = {}, 0
        last = row["query"]
        block.setdefault(last, []).append(row["term"])
        size += 1
    if block:
        yield block


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: each query's k best rows of `docs` with a score above 0.

    `docs` has doc_id and text, `queries` item_id and text; other columns are left alone. Null and empty texts have no terms; a
    query without terms has no result; query rows that share an id (null is one too) are one query with
    the terms of all. Each row of `docs` ranks by itself, repeated rows too; equal scores rank by doc_id,
    null last. Queries may be many: they go to the tasks in blocks of whole queries.
    """
    spark = docs.sparkSession
    ship(spark)
    pairs = stage(query_terms(queries), "query-terms")
    # One row a query; numbers follow from the ids' order, without a window over all rows in one task.
    numbered = pairs.select("item_id").distinct().orderBy("item_id").select(F.monotonically_increasing_id().alias("query"), "item_id")
    numbered = stage(numbered, "queries")
    table = stage(pairs.join(numbered, pairs["item_id"].eqNullSafe(numbered["item_id"])).select("query", "term"), "query-numbers")
    found = None
    for block in _blocks(table):
        terms = np.unique(np.array([t for own in block.values() for t in own], dtype=np.int64).view(np.uint64))
        n_docs, n_terms, df = statistics(docs, terms)
        weights = [weight(n_docs, int(d)) for d in df]
        at = {q: np.searchsorted(terms, np.array(own, dtype=np.int64).view(np.uint64)).tolist() for q, own in block.items()}
        asked = {q: [(i, weights[i]) for i in own if df[i]] for q, own in at.items()}
        part = _search(docs, asked, terms, (n_docs, n_terms), k)
        found = part if found is None else found.union(part)
    if found is None:
        found = docs.select(F.lit(None).cast("long").alias("query"), "doc_id", F.lit(None).cast("long").alias("score")).limit(0)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(numbered, "query").select("item_id", "rank", "doc_id", "score")
