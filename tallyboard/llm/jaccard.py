r"""Near copies by a parity-sketch join over word shingles, exact at the threshold.

A document is the set of its distinct 5-word shingles. Two sets of sizes m and n with a Jaccard
similarity of 0.8 differ in at most (m + n) / 9 shingles. Sizes are divided into bands; for a band,
shingles are dealt to cells by hash, and a cell holds the XOR of its shingles' hashes. A shingle in
one set only changes one cell, so the number of unlike cells bounds the difference from below, and
sets with more cells than they may differ in agree in one: the pigeonhole join is on (band, cell,
value). A set is entered under its own band and under those that a larger partner may be in.

Cells with too few shingles say little and are left out. So are keys that many unlike sets share, as
happens with a common passage. A set from which so many cells are left out that agreement in one is
no longer sure is called weak; a link is only in doubt between two weak sets, and these are joined
once more on the rarest of their shingles, the prefix that a link can't miss: a fifth of the larger set's
and a ninth of the smaller one's, by size bands and by how much may come after the shingle in either.

In a group of sets with the same key each is compared with the smallest, and others of the group only
if that leaves them apart, so that a group of many copies makes one pair for each of them. Before the
sets themselves are compared, sizes and 512-bit folded parity sketches rule out what they can.

Sets, texts and shingles are told apart by 64-bit hashes; a set's words are read from one text that has it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyboard.llm import ship
from tallyboard.llm.decontam import _present, bit_table
from tallyboard.llm.graph import components
from tallyboard.llm.words import SPACED, Words, chunks, mix, shingle_hashes, shingle_heads
from tallyboard.session import stage

SHINGLE = 5
#: Groups of up to so many unlike sets are compared pair by pair; larger ones make their sets weak.
SMALL_GROUP = 16
_SKETCH = 512
_RATIO = 1.4
#: Size bands of the weak sets: each begins so many times higher than the last.
_BAND = 1.12
_GROUP = ["key", "band"]

#: Sizes from which a band begins; sets under four shingles link with equal sets only.
_LOW = [4]
while _LOW[-1] < 1 << 40:
    _LOW.append(int(_LOW[-1] * _RATIO) + 1)
_LOW = np.array(_LOW, dtype=np.int64)
_HIGH = np.append(_LOW[1:] - 1, np.iinfo(np.int64).max)
#: A cell counts from so many shingles on, and has about so many at the band's upper end.
_LEAST = np.where(_HIGH < 200, 1, 2)
_CELLS = np.maximum(2, np.where(_HIGH < 200, _HIGH // 2.5, _HIGH // 2.6)).astype(np.int64)


def linked(common: int, a: int, b: int) -> bool:
    """Whether sets of sizes a and b with so much in common have a similarity of 0.8."""
    return common > 0 and 100 * common >= 80 * (a + b - common)


class Sets:
    """Distinct shingles of each text of a chunk, in order of text and hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = Words(data, offsets, SPACED)
        hashes = words.hashes() if len(words) else np.zeros(0, np.uint64)
        counts = words.counts()
        heads, owner = shingle_heads(words.first, SHINGLE)
        tokens = shingle_hashes(hashes, SHINGLE)[heads] if len(heads) else np.zeros(0, np.uint64)
        for size in range(1, SHINGLE):  # with fewer words, all of them are the one shingle
            short = np.flatnonzero(counts == size)
            if len(short):
                tokens = np.concatenate([tokens, shingle_hashes(hashes, size)[words.first[short]] + np.uint64(size)])
                owner = np.concatenate([owner, short])
        order = np.lexsort((tokens, owner))
        tokens, owner = tokens[order], owner[order]
        new = np.ones(len(tokens), dtype=bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
        self.tokens, self.owner = tokens[new], owner[new]
        self.first = np.searchsorted(self.owner, np.arange(len(offsets)))
        self.sizes = np.diff(self.first)
        #: Of each text's set, a hash of it. Empty sets have none that counts.
        self.nodes = np.zeros(len(offsets) - 1, dtype=np.uint64)
        full = np.flatnonzero(self.sizes)
        if len(full):
            self.nodes[full] = mix(np.add.reduceat(mix(self.tokens), self.first[full]) + self.sizes[full].astype(np.uint64))

    def sketches(self) -> list[bytes]:
        """Parity of each text's shingles in 512 cells."""
        spots = np.zeros((len(self.sizes), _SKETCH), dtype=np.uint8)
        flat = self.owner * _SKETCH + (self.tokens >> np.uint64(55)).astype(np.int64)
        spots = (np.bincount(flat, minlength=spots.size) & 1).astype(np.uint8).reshape(spots.shape)
        return [x.tobytes() for x in np.packbits(spots, axis=1)]

    def cells(self):
        """For each band that texts are entered under: (texts, slack, owner of each key, key).

        slack: how many of a text's keys may go without putting a link in doubt.
        """
        own = np.searchsorted(_LOW, self.sizes, side="right") - 1
        for up in range(3):
            band = own + up
            reach = self.sizes + self.sizes // 4
            mine = np.flatnonzero((own >= 0) & (_LOW[np.minimum(band, len(_LOW) - 1)] <= reach))
            if not len(mine):
                continue
            bands = band[mine]
            cells = _CELLS[bands]
            base = np.cumsum(cells) - cells
            place = np.full(len(self.sizes), -1)
            place[mine] = np.arange(len(mine))
            entered = place[self.owner] >= 0
            tokens, at = self.tokens[entered], place[self.owner[entered]]
            salt = mix(bands.astype(np.uint64) + np.uint64(77))
            cell = (mix(tokens ^ salt[at]) % cells[at].astype(np.uint64)).astype(np.int64)
            spot = base[at] + cell
            order = np.argsort(spot, kind="stable")
            spot = spot[order]
            edges = np.flatnonzero(np.append(True, spot[1:] != spot[:-1]))
            values = np.bitwise_xor.reduceat(mix(tokens[order] + np.uint64(1)), edges)
            held = np.diff(np.append(edges, len(spot)))
            spot = spot[edges]
            owner = at[order][edges]
            good = held >= _LEAST[bands[owner]]
            owner, values = owner[good], values[good]
            number = (spot[good] - base[owner]).astype(np.uint64)
            keys = mix(values + mix(salt[owner] + number))
            m = self.sizes[mine]
            differ = (m + np.minimum(_HIGH[bands], m + m // 4)) // 9
            slack = np.bincount(owner, minlength=len(mine)) - differ - 1
            yield mine, slack, mine[owner], keys


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _text_key(docs: DataFrame):
    """Tells apart rows that share an id."""
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def described(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, node (a hash of the set), slack and sketch of every row."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(2)):
                sets = Sets(data, offsets)
                slack = np.full(hi - lo, 1 << 30)
                for mine, left, _, _ in sets.cells():
                    slack[mine] = np.minimum(slack[mine], left)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(1).slice(lo, hi - lo),
                        pa.array(sets.sizes.astype(np.int64)),
                        pa.array(sets.nodes.view(np.int64)),
                        pa.array(slack.astype(np.int32)),
                        pa.array(sets.sketches(), pa.binary()),
                    ],
                    ["doc_id", "text_key", "n_shingles", "node", "slack", "sketch"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", _text_key(docs), F.coalesce(docs["text"].cast("string"), F.lit("")))
    return texts.mapInArrow(run, f"doc_id {kind}, text_key long, n_shingles long, node long, slack int, sketch binary")


def shared_keys(docs: DataFrame) -> DataFrame:
    """key, leader, node: of each key that several sets have, the smallest node and each other one."""

    def deal(batches):
        seen: set[int] = set()  # a set is entered once by each task, however many copies it meets
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                sets = Sets(data, offsets)
                fresh = np.zeros(len(sets.nodes), dtype=bool)
                for i, node in enumerate(sets.nodes.tolist()):
                    if node not in seen:
                        seen.add(node)
                        fresh[i] = True
                for _, _, owner, keys in sets.cells():
                    use = fresh[owner]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[use].view(np.int64)), pa.array(sets.nodes[owner[use]].view(np.int64))], ["key", "node"]
                    )

    keyed = _texts(docs).select("text").mapInArrow(deal, "key long, node long")
    return _led(keyed)


def _led(keyed: DataFrame) -> DataFrame:
    """key, leader, node for every node of a key but its smallest; equal rows count once."""

    def lead(batches):
        key = leader = last = None  # of the last row so far: a key may go on in the next batch
        for batch in batches:
            k = batch.column(0).to_numpy()
            v = batch.column(1).to_numpy()
            if not len(k):
                continue
            begins = np.append(True, k[1:] != k[:-1])
            begins[0] = key is None or k[0] != key
            starts = np.flatnonzero(begins)
            group = np.cumsum(begins) - 1
            first = v[starts]
            leaders = np.where(group >= 0, first[np.maximum(group, 0)] if len(first) else 0, leader or 0)
            again = np.append(False, v[1:] == v[:-1]) & ~begins
            again[0] = not begins[0] and v[0] == last
            use = ~begins & ~again & (v != leaders)
            yield pa.RecordBatch.from_arrays([pa.array(k[use]), pa.array(leaders[use]), pa.array(v[use])], ["key", "leader", "node"])
            key, leader, last = k[-1], leaders[-1], v[-1]

    return keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(lead, "key long, leader long, node long")


def likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b with the keys of their texts: the pairs that sizes and sketches don't rule out."""

    def tested(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            unlike = np.zeros(n, dtype=np.int64)
            sides = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(n, -1) for i in (4, 5)]
            unlike = np.bitwise_count(sides[0] ^ sides[1]).sum(axis=1)
            ok = 9 * unlike.astype(np.int64) <= batch.column(6).to_numpy()
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in batch.columns[:4]], ["a", "b", "key_a", "key_b"])

    side = lambda x: sets.select(F.col("node").alias(x), F.col("text_key").alias(f"key_{x}"), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    return (
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .where("5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)")
        .select("a", "b", "key_a", "key_b", "sketch_a", "sketch_b", (F.col("n_a") + F.col("n_b")).alias("n"))
        .mapInArrow(tested, "a long, b long, key_a long, key_b long")
    )


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text of `wanted` (node, text_key): one row for each node, whatever the ids and however often
    a text is given.

    Only texts whose key is in a bit table of fixed size are shuffled, which are the wanted ones and a few
    by chance, and of equal texts one by each task.
    """
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(bit_table(wanted.select(F.col("text_key").alias("token"))))

    def pick(batches):
        seen: set[int] = set()
        for batch in batches:
            keys = batch.column(0).to_numpy()
            at = []
            for i in _present(bits.value, keys.view(np.uint64)).tolist():
                key = int(keys[i])
                if key not in seen:
                    seen.add(key)
                    at.append(i)
            yield batch.take(pa.array(at, pa.int64()))

    texts = docs.select(_text_key(docs).alias("text_key"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    some = texts.mapInArrow(pick, "text_key long, text string").dropDuplicates(["text_key"])
    return some.join(wanted, "text_key").select("node", "text")


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b of the pairs whose sets have a similarity of 0.8, by their texts."""

    def compare(batches):
        for batch in batches:
            begun = 0
            while begun < batch.num_rows:  # few texts at a time
                part = batch.slice(begun, 256)
                begun += 256
                ok = []
                kept = None
                for a, left, right in zip(part.column(0).to_pylist(), part.column(2), part.column(3)):
                    if kept is None or kept[0] != a:
                        kept = (a, _set_of(left))
                    other = _set_of(right)
                    common = len(np.intersect1d(kept[1], other, assume_unique=True))
                    ok.append(linked(common, len(kept[1]), len(other)))
                yield part.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    wanted = pairs.select(F.col("a").alias("node"), F.col("key_a").alias("text_key")).union(pairs.select("b", "key_b")).distinct()
    texts = stage(texts_of(docs, wanted), "texts")
    left = texts.withColumnsRenamed({"node": "a", "text": "text_a"})
    right = texts.withColumnsRenamed({"node": "b", "text": "text_b"})
    return (
        pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long")
    )


def _set_of(text) -> np.ndarray:
    (_, _, data, offsets), *_ = chunks(pa.array([text.as_py()], pa.string()))
    return Sets(data, offsets).tokens


class _Links:
    """Links found so far and the components that they make."""

    def __init__(self, docs: DataFrame, sets: DataFrame):
        self.docs, self.sets = docs, sets
        self.links = self.comps = None

    def apart(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that no path joins yet."""
        if self.comps is None:
            return pairs
        of = lambda x: self.comps.select(F.col("node").alias(x), F.col("comp").alias(f"comp_{x}"))
        both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
        return both.where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select(*pairs.columns)

    def compare(self, pairs: DataFrame) -> None:
        """Verify pairs and add the links found."""
        found = stage(verified(self.docs, pairs), "found")
        if self.comps is not None and found.isEmpty():
            return
        self.links = found if self.links is None else self.links.union(found)
        self.comps = components(self.links)

    def try_out(self, pairs: DataFrame, least_first: bool = False) -> None:
        """Compare the distinct pairs that may link; with `least_first` each set with its smallest
        partner before the others, of which most are in one component then."""
        pairs = stage(likely(pairs, self.sets), "likely")
        if least_first:
            least = pairs.groupBy("b").agg(F.min("a").alias("_a")).withColumnRenamed("b", "_b")
            self.compare(pairs.join(least, (F.col("b") == F.col("_b")) & (F.col("a") == F.col("_a"))).drop("_a", "_b"))
            pairs = stage(self.apart(pairs), "rest")
        if not pairs.isEmpty():
            self.compare(pairs)


def _in_groups(rows: DataFrame, links: _Links, group: Sequence[str] = ("key",)) -> DataFrame:
    """`rows` (node and the columns of `group`) with their component `comp`, of the groups that have sets of
    several components, and `n_in`, the rows of the group."""
    labelled = rows.join(links.comps, "node", "left").select(*rows.columns, F.coalesce("comp", "node").alias("comp"))
    sizes = labelled.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_in"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi")
    )
    return labelled.join(sizes.where("_lo != _hi").select(*group, "n_in"), list(group))


def _across(groups: DataFrame) -> DataFrame:
    """Distinct pairs of sets of a key in different components."""
    left = groups.select("key", F.col("node").alias("a"), F.col("comp").alias("comp_a"))
    right = groups.select("key", F.col("node").alias("b"), F.col("comp").alias("comp_b"))
    return left.join(right, "key").where("a < b AND comp_a != comp_b").select("a", "b").distinct()


def _open_rows(led: DataFrame, failed: DataFrame) -> DataFrame:
    """key, node of all sets of the keys in which some set stands apart from the leader."""
    keys = led.join(failed.select(F.col("a").alias("leader"), F.col("b").alias("node")), ["leader", "node"], "left_semi")
    rows = led.join(keys.select("key").distinct(), "key", "left_semi")
    return rows.select("key", "node").union(rows.select("key", F.col("leader").alias("node"))).distinct()


def _shared_shingles(docs: DataFrame, weak: DataFrame) -> DataFrame:
    """key, node, n, place of every shingle that several weak sets have: place counts from 1 in the order of
    rarity that all sets have in common, n is the size of the set."""

    def spread(batches):
        for batch in batches:
            for lo, _, data, offsets in chunks(batch.column(1)):
                sets = Sets(data, offsets)
                node = np.asarray(batch.column(0))[lo + sets.owner]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sets.tokens.view(np.int64)), pa.array(node), pa.array(sets.sizes[sets.owner])], ["key", "node", "n"]
                )

    tokens = stage(texts_of(docs, weak).mapInArrow(spread, "key long, node long, n long"), "weak")
    seen = tokens.groupBy("key").agg(F.count(F.lit(1)).alias("seen")).where("seen > 1")
    # What one set alone has comes before the rest, so that it counts without being sorted.
    shared = tokens.join(seen, "key")
    rarest = Window.partitionBy("node").orderBy("seen", "key")
    all_of = Window.partitionBy("node")
    place = F.col("n") - F.count(F.lit(1)).over(all_of) + F.row_number().over(rarest)
    return shared.select("key", "node", "n", place.alias("place"))


def _entered(shingles: DataFrame) -> DataFrame:
    """key, band, larger, node, n, place: sets under those of their shingles at which a partner can be met.

    A pair is met in the size band of its smaller set. There the smaller one has `larger` false; the larger
    one is entered in each band in which a smaller partner may be. At the first shingle that both have, in
    order, they have no more in common than comes from there on in either, which bounds its place.
    """
    band = lambda n: F.floor(F.log(n.cast("double")) / F.log(F.lit(_BAND)))
    left = F.col("n") - F.col("place") + 1
    small = shingles.where(9 * left >= 8 * F.col("n")).select("key", band(F.col("n")).alias("band"), F.lit(False).alias("larger"), "node", "n", "place")
    bands = F.sequence(band(F.col("n") - F.floor(F.col("n") / 5)), band(F.col("n")))
    large = shingles.where(5 * left >= 4 * F.col("n")).select("key", F.explode(bands).alias("band"), F.lit(True).alias("larger"), "node", "n", "place")
    # One less than the band begins with, as its bounds are rounded.
    least = F.floor(F.pow(F.lit(_BAND), F.col("band"))) - 1
    large = large.where(9 * left >= 4 * (F.col("n") + least))
    return small.unionByName(large)


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of a smaller and a larger set of a group, in different components, that sizes
    and places don't rule out."""
    side = lambda rows, i: rows.select(*_GROUP, *[F.col(c).alias(f"{c}_{i}") for c in ("larger", "node", "n", "place", "comp")])
    return (
        side(left, 1)
        .join(side(right, 2), _GROUP)
        .where("larger_1 != larger_2 AND comp_1 != comp_2 AND IF(larger_1, n_1 >= n_2, n_2 >= n_1)")
        .where("9 * (1 + least(n_1 - place_1, n_2 - place_2)) >= 4 * (n_1 + n_2)")
        .select(F.least("node_1", "node_2").alias("a"), F.greatest("node_1", "node_2").alias("b"))
        .distinct()
    )


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of `docs`; see `grouped`."""
    return grouped(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with one of each group of near copies, that of the smallest id (null ids come
    first, and of rows with one id the text with the smallest hash); rows without words all stay."""
    groups = stage(grouped(docs), "groups")
    best = groups.where("n_shingles > 0").groupBy("comp").agg(F.min(F.struct("doc_id", "text_key")).alias("best"))
    kept = best.select("best.*").union(groups.where("n_shingles = 0").select("doc_id", "text_key").distinct())
    kept = kept.withColumnsRenamed({"doc_id": "_doc", "text_key": "_key"})
    on = docs["doc_id"].eqNullSafe(kept["_doc"]) & (_text_key(docs) == kept["_key"])
    stays = docs.join(kept, on, "left_semi")
    # Rows given more than once are copies too.
    twice = groups.where("n_shingles > 0").groupBy("doc_id", "text_key").count().where("count > 1")
    if twice.isEmpty():
        return stays
    twice = twice.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"))
    on = stays["doc_id"].eqNullSafe(twice["_doc"]) & (_text_key(stays) == twice["_key"])
    return stays.join(twice, on, "left_anti").union(stays.join(twice, on, "left_semi").dropDuplicates(["doc_id", "text"]))


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, comp (of its group) and component_id of every row of `docs`.

    `docs` needs doc_id and text; other columns are not read. component_id is the smallest doc_id that
    links of similarity 0.8 or more reach. Null text has an empty set, and empty sets link with
    nothing; equal rows are copies of each other.
    """
    spark = docs.sparkSession
    ship(spark)
    every = stage(described(docs), "sets")
    sets = every.where("n_shingles > 0").groupBy("node").agg(
        F.min("text_key").alias("text_key"), *[F.first(c).alias(c) for c in ("n_shingles", "slack", "sketch")]
    )
    sets = stage(sets, "distinct_sets")
    led = stage(shared_keys(docs), "shared")
    links = _Links(docs, sets)
    pairs = stage(led.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    links.try_out(pairs, least_first=True)

    # Keys in which some sets stand apart: small groups are gone through, large ones don't count.
    failed = stage(links.apart(pairs), "failed")
    weak = sets.where("slack < 0")
    if not failed.isEmpty():
        groups = stage(_in_groups(_open_rows(led, failed), links), "groups")
        small = _across(groups.where(F.col("n_in") <= SMALL_GROUP))
        small = stage(small.join(pairs, ["a", "b"], "left_anti"), "small")
        if not small.isEmpty():
            links.try_out(small)
        hot = groups.where(F.col("n_in") > SMALL_GROUP).groupBy("node").agg(F.count(F.lit(1)).alias("hot"))
        weak = sets.join(hot, "node", "left").where(F.col("slack") < F.coalesce("hot", F.lit(0)))

    # Between weak sets nothing is sure yet.
    weak = stage(weak.where("n_shingles >= 4").select("node", "text_key"), "weak_sets")
    shingles = stage(_shared_shingles(docs, weak), "weak_shingles")
    entered = stage(_entered(shingles), "weak_keys")
    # In each group the smallest hash is compared first, then what still stands apart with ever more sets.
    before, leaders = 0, 1
    while True:
        groups = stage(_in_groups(entered, links, _GROUP), "weak_groups")
        order = Window.partitionBy(*_GROUP).orderBy("node")
        groups = groups.withColumn("rank", F.dense_rank().over(order)).where(f"rank > {before}")
        if groups.isEmpty():
            break
        links.try_out(_met(groups.where(f"rank <= {leaders}"), groups))
        before, leaders = leaders, leaders * 16

    comp = every.join(links.comps, "node", "left").select(
        "doc_id", "text_key", "n_shingles", F.coalesce("comp", "node").alias("comp")
    )
    least = comp.where("n_shingles > 0").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    out = comp.where("n_shingles > 0").join(least, "comp").select(*comp.columns, "component_id")
    return out.union(comp.where("n_shingles = 0").withColumn("component_id", F.col("doc_id")))
