"""N-gram Jaccard join by parity sketches: components of documents with similar shingle sets.

Every document is the set of hashes of its distinct word shingles. Sets are
put into size bands; for the largest symmetric difference D that two linked
sets of a band can have, each set is dealt into p > D pieces by token hash and
the tokens of a piece are XORed. A differing token touches one piece, so
linked sets agree in at least p - D pieces (pigeonhole). Equal pieces bring
documents into a bucket; there a bit sketch that every token flips one bit of
gives a Hamming distance that never exceeds the symmetric difference and
discards most pairs; the exact sets decide about the rest.

Buckets do not list pairs. First every document names its nearest and its
lowest mate in two of its buckets, and verified links form components; then the
rows outside a bucket's main component do so in all buckets that hold several
components; what is left after that has its sets sent to the buckets, which
compare them in place and return no more links than join their components.
Buckets of the same rows count once. Large ones are worked on block by block.
Equal sets are one representative throughout.

Cases: a text is NULL or has no words: empty set, a component of its own;
fewer than ``k`` words: one shingle of all words; repeated rows of an id count
as one document with the first set by size and fingerprint; rows with a NULL
id are left out; empty tables give an empty result; further columns are not
looked at. Tokens are 64-bit hashes of the words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelage.llm.components import components
from pelage.llm.hashing import U64, mix, pack, prefix, slices, spans, split_words, text_bytes, unpack, word_runs
from pelage.llm.shared_keys import shared_keys
from pelage.llm.storage import released, stored

c = F.col

BLOCK = 2048
# Sets of a block where sets are compared inside the bucket.
BLOCK_BYTES = 32 << 20
# Bucket rows that a task compares at once, unless one cell has more.
HELD_ROWS, HELD_BYTES = 8192, 16 << 20
# Ids sent to all executors at once at most (8 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 1_000_000


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, letters A-Z in lower case."""
    words = split_words(text_bytes(texts), lower=True)
    at, hashed = word_runs(words, k)
    cuts = np.searchsorted(words.doc[at], np.arange(len(texts) + 1))
    counts = np.diff(words.first)
    sums = prefix(words.hash)
    result = []
    for i, n in enumerate(counts):
        if 0 < n < k:
            first = words.first[i:i + 1]
            result.append(spans(sums, first, first + n))
        else:
            result.append(np.unique(hashed[cuts[i]:cuts[i + 1]]))
    return result


class Bands:
    """Size bands and the pieces that a link of ``percent`` needs."""

    def __init__(self, percent: int):
        self.percent = percent

    @staticmethod
    @lru_cache(maxsize=None)
    def starts(upto: int) -> np.ndarray:
        found = [1]
        while found[-1] <= upto:
            found.append(max(found[-1] + 1, int(found[-1] * 1.2)))
        return np.array(found)

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.starts(1 << int(n).bit_length()), n, "right")) - 1

    def difference(self, total: int) -> int:
        """Largest symmetric difference of two linked sets with ``total`` members together."""
        return (100 - self.percent) * total // (100 + self.percent)

    def largest(self, band: int) -> int:
        upto = 2
        while len(self.starts(upto)) <= band + 1:
            upto *= 2
        return int(self.starts(upto)[band + 1]) - 1

    def pieces(self, band: int) -> tuple[int, int]:
        """(number of pieces, empty pieces that a set may leave out)."""
        needed = self.difference(2 * self.largest(band)) + 1
        spare = 1 + needed // 20
        return needed + spare, spare

    def of(self, n: int) -> range:
        """Bands in which a set of this size meets its partners: the larger one's."""
        return range(self.band(n), self.band(n * 100 // self.percent) + 1)

    def bits(self, band: int) -> int:
        """Width of the bit sketch: at least eight times the difference, and 512."""
        width = 512
        while width < 8 * self.difference(2 * self.largest(band)):
            width *= 2
        return width


def piece_keys(tokens: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of the pieces of a set, for each band it takes part in.

    Two linked sets agree in at least p - D pieces. A set with at most
    p - D - 1 empty pieces leaves those out: they cannot be the only agreement.
    """
    keys = []
    for band in bands.of(len(tokens)):
        p, spare = bands.pieces(band)
        seed = mix(np.array([band], U64))[0]
        piece = (mix(tokens ^ seed) % U64(p)).astype(np.int64)
        order = np.argsort(piece, kind="stable")
        filled, first = np.unique(piece[order], return_index=True)
        content = np.zeros(p, U64)
        content[filled] = np.bitwise_xor.reduceat(mix(tokens[order]), first)
        used = filled if p - len(filled) <= spare else np.arange(p)
        keys.append(mix(content[used] + mix(used.astype(U64) + seed)))
    return np.concatenate(keys) if keys else np.zeros(0, U64)


def bit_sketch(tokens: np.ndarray, width: int) -> bytes:
    """Parity of the tokens that fall on each bit."""
    bits = np.bincount((tokens >> U64(20)) % U64(width), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _measures(sets: list[np.ndarray]) -> dict[str, pa.Array]:
    """Size and two fingerprints of each set."""
    return {
        "n": pa.array([len(s) for s in sets], pa.int64()),
        "f1": pa.array([int(np.bitwise_xor.reduce(s, initial=U64(0)).view(np.int64)) for s in sets], pa.int64()),
        "f2": pa.array([int(mix(s + U64(1)).sum(dtype=U64).view(np.int64)) for s in sets], pa.int64())}


@released
def _summaries(batches: Iterator[pa.RecordBatch], k: int, bands: Bands) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        sets = shingle_sets(batch.column("text"), k)
        yield pa.RecordBatch.from_pydict({
            "id": batch.column("id"), **_measures(sets),
            # Width by the upper band of the set; partners from the band below bring the same width or one less.
            "sketch": pa.array([bit_sketch(s, bands.bits(bands.band(len(s)))) if len(s) else b"" for s in sets], pa.binary()),
        })


@released
def _keyed(batches: Iterator[pa.RecordBatch], k: int, bands: Bands) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        sets = shingle_sets(batch.column("text"), k)
        yield pa.RecordBatch.from_pydict({
            "owner": batch.column("id"),
            "keys": pa.array([pack(piece_keys(s, bands), "<u8") if len(s) else b"" for s in sets], pa.binary())})


@released
def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            keys = [unpack(v.as_buffer(), "<u8") for v in part.column("keys")]
            rows = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(np.concatenate(keys).view(np.int64)), "id": part.column("id").take(pa.array(rows))})


def _folded(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches of at least ``width`` bits as words of that width; shorter ones stay zero.

    Bit i collects the parities of the bits that agree with it modulo ``width``,
    so a Hamming distance can only fall.
    """
    out = np.zeros((len(sketches), width // 8), np.uint8)
    sizes = np.array([len(x) for x in sketches]) * 8
    for size in np.unique(sizes[sizes >= width]):
        at = np.flatnonzero(sizes == size)
        bits = np.frombuffer(b"".join([sketches[i] for i in at]), np.uint8).reshape(len(at), -1, width // 8)
        out[at] = np.bitwise_xor.reduce(bits, axis=1)
    return out.view("<u8")


class _Units:
    """Whole units (bucket cells) as arrays, in order."""

    def __init__(self, table: pa.Table, bands: Bands):
        read = lambda name: table.column(name).to_numpy()
        self.id, self.n, self.component, self.side = read("id"), read("n"), read("component"), read("side")
        self.starts = self.component != read("main")
        self.tokens = table.column("tokens") if "tokens" in table.column_names else None
        key, cell = read("key"), read("cell")
        self.head = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])])
        self.tail = np.r_[self.head[1:], len(key)]
        sides = np.minimum.reduceat(self.side, self.head) != np.maximum.reduceat(self.side, self.head)
        self.crossed = np.repeat(sides, self.tail - self.head)
        sketches = table.column("sketch").to_pylist()
        self.width = np.array([len(x) for x in sketches]) * 8
        self.bits = {w: _folded(sketches, w) for w in np.unique(self.width)}
        self.percent = bands.percent

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row pairs of the units: within one block, or between the two of a cell; in portions."""
        size = self.tail - self.head
        small = size <= 64
        rows = np.concatenate([np.arange(a, b) for a, b in zip(self.head[small], self.tail[small])] or [np.zeros(0, int)])
        start = np.repeat(self.head[small], size[small])
        before = rows - start
        for low in range(0, len(rows), 16384):
            part = slice(low, low + 16384)
            i = np.repeat(rows[part], before[part])
            nth = np.arange(len(i)) - np.repeat(np.cumsum(before[part]) - before[part], before[part])
            yield self._meeting(i, np.repeat(start[part], before[part]) + nth)
        for a, b in zip(self.head[~small], self.tail[~small]):
            for low in range(a, b, 32):
                i = np.arange(low, min(low + 32, b))
                i, j = np.repeat(i, i - a), np.concatenate([np.arange(a, x) for x in i])
                yield self._meeting(i, j)

    def _meeting(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a cell of two blocks only pairs across; a block's own pairs have a cell of their own."""
        keep = (~self.crossed[i] | (self.side[i] != self.side[j])) & (self.component[i] != self.component[j])
        return i[keep], j[keep]

    def unit_of(self, rows: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.head, rows, "right") - 1

    def linked(self, i: int, j: int) -> bool:
        """Whether the exact sets of two rows are similar enough."""
        x, y = (unpack(self.tokens[int(k)].as_buffer(), "<u8") for k in (i, j))
        return _similar(x, y, self.percent)

    def plausible(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs that the Hamming bound leaves, with their distances."""
        width = np.minimum(self.width[i], self.width[j])
        distance = np.zeros(len(i), np.int64)
        for w, bits in self.bits.items():
            at = np.flatnonzero(width == w)
            distance[at] = np.bitwise_count(bits[i[at]] ^ bits[j[at]]).sum(1)
        keep = (100 + self.percent) * distance <= (100 - self.percent) * (self.n[i] + self.n[j])
        return i[keep], j[keep], distance[keep]


def _first_per(row: np.ndarray, order: np.ndarray) -> np.ndarray:
    row = row[order]
    return order[np.r_[True, row[1:] != row[:-1]]] if len(row) else order


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


Work = Callable[[_Units], Iterator[pa.RecordBatch]]


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    both = both[both[:, 0] < both[:, 1]]
    return pa.RecordBatch.from_pydict({"a": pa.array(both[:, 0], pa.int64()), "b": pa.array(both[:, 1], pa.int64())})


def _nearest(units: _Units) -> Iterator[pa.RecordBatch]:
    """Of the plausible mates of each row outside the bucket's main component the nearest and the lowest."""
    def closest(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pairs met so far, either way round."""
        row, mate, far = np.r_[i, j], np.r_[j, i], np.r_[d, d]
        begin = units.starts[row]
        row, mate, far = row[begin], mate[begin], far[begin]
        take = np.unique(np.r_[_first_per(row, np.lexsort((units.id[mate], far, row))),
                               _first_per(row, np.lexsort((units.id[mate], row)))])
        return row[take], mate[take], far[take]

    met = (np.zeros(0, np.int64),) * 3
    for i, j in units.candidates():
        found = units.plausible(i, j)
        if len(found[0]):
            met = tuple(np.concatenate(x) for x in zip(met, closest(*found)))
            if len(met[0]) > 1 << 16:
                met = closest(*met)
    row, mate, _ = closest(*met)
    yield _edges(units.id[row], units.id[mate])


def _concerned(units: _Units) -> Iterator[pa.RecordBatch]:
    """Ids of all rows that have a plausible mate of another component."""
    found = [np.zeros(0, np.int64)]
    for i, j in units.candidates():
        x, y, _ = units.plausible(i, j)
        found.append(np.unique(np.r_[units.id[x], units.id[y]]))
    yield pa.RecordBatch.from_pydict({"id": pa.array(np.unique(np.concatenate(found)), pa.int64())})


def _spanning(units: _Units) -> Iterator[pa.RecordBatch]:
    """Links between components, as many as join them: sets are compared where they lie, nearest first."""
    joined: dict[tuple[int, int], tuple[int, int]] = {}

    def root(x: tuple[int, int]) -> tuple[int, int]:
        while x in joined:
            x = joined[x]
        return x

    links = []
    for i, j in units.candidates():
        i, j, far = units.plausible(i, j)
        order = np.argsort(far, kind="stable")
        unit = units.unit_of(i)
        for x, y, u in zip(i[order].tolist(), j[order].tolist(), unit[order].tolist()):
            one, two = root((u, int(units.component[x]))), root((u, int(units.component[y])))
            if one != two and units.linked(x, y):
                joined[one] = two
                links.append((units.id[x], units.id[y]))
    if links:
        yield _edges(*(np.array(x, np.int64) for x in zip(*links)))


def _by_unit(work: Work, bands: Bands):
    """Runs ``work`` over whole cells, some thousands of rows at a time."""
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < HELD_ROWS and sum(b.nbytes for b in held) < HELD_BYTES:
                continue
            table = pa.Table.from_batches(held)
            key, cell = table.column("key").to_numpy(), table.column("cell").to_numpy()
            # The last unit may go on in the next batch.
            last = int(np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])])[-1])
            if last:
                yield from work(_Units(table.slice(0, last), bands))
            held = table.slice(last).to_batches()
        if held:
            yield from work(_Units(pa.Table.from_batches(held), bands))

    return run


def in_buckets(rows: DataFrame, buckets: DataFrame, about: DataFrame, work: Work, schema: str, bands: Bands) -> DataFrame:
    """Distinct results of ``work`` over the cells of the buckets.

    ``rows``: ``key, id, component``; ``about``: ``id, n, sketch`` and maybe
    ``tokens``, which meet only the rows that are left in such buckets.

    A bucket of more than ``BLOCK`` rows or ``BLOCK_BYTES`` of sets is cut into
    blocks by id; each pair of blocks is a cell of its own.
    """
    columns = ["key", "id", "n", "sketch", "component", "main", *[k for k in about.columns if k == "tokens"]]
    weight = F.greatest(F.ceil(c("size") / BLOCK), F.ceil(c("members") * 8 / BLOCK_BYTES) if "tokens" in columns else F.lit(1))
    dealt = rows.select("key", "id", "component").join(buckets, "key").withColumn("blocks", weight.cast("int")).withColumn(
        "own", F.pmod(F.xxhash64("id"), c("blocks")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), c("blocks") - 1), lambda other: F.struct(
        (F.least(c("own"), other) * c("blocks") + F.greatest(c("own"), other)).alias("cell"),
        F.when(c("own") <= other, 0).otherwise(1).alias("side")))
    dealt = dealt.join(about, "id").select(*columns, F.explode(cells).alias("e")).select(*columns, "e.cell", "e.side")
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Rows of a unit are neighbours after the sort; a unit has at most about two blocks.
    sorted_rows = dealt.repartition(width, "key", "cell").sortWithinPartitions("key", "cell")
    return sorted_rows.mapInArrow(_by_unit(work, bands), schema).distinct()


def distinct_buckets(rows: DataFrame, grouped: bool = True) -> DataFrame:
    """``key, size, members, main`` of the buckets with rows of several components, one key for all buckets of the same rows.

    Similar sets agree in most of their pieces and meet under that many keys;
    one meeting is enough. Rows are compared by 128 bits. ``members`` is the
    sum of the set sizes where rows have them, ``main`` the component of most
    rows, or the lowest where components are not ``grouped`` yet. All of it is
    sums and extremes that combine before the shuffle, whatever the bucket's size.
    """
    n, x, y = F.sum("n" if "n" in rows.columns else F.lit(0)), F.xxhash64("id"), F.xxhash64("id", F.lit(1))
    parts = rows.select("key", "component", F.lit(1).cast("long").alias("size"), x.alias("x"), y.alias("y"), *[k for k in rows.columns if k == "n"])
    sums = [F.sum("size").alias("size"), n.alias("members"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")]
    main = F.min("component")
    if grouped:
        parts = parts.groupBy("key", "component").agg(*sums)
        sums[1] = F.sum("members").alias("members")
        main = F.max_by("component", "size")
    buckets = parts.groupBy("key").agg(
        *sums, F.min("component").alias("low"), F.max("component").alias("high"), main.alias("main")).where("low < high")
    once = buckets.groupBy("size", "x", "y").agg(F.min("key").alias("key"))
    return buckets.join(once.select("key"), "key", "left_semi").select("key", "size", "members", "main")


def _buckets(rows: DataFrame, grouped: bool = True) -> DataFrame:
    """Those buckets, written: in one plan with the comparison the driver would plan all of it again after each of a dozen stages."""
    return stored(distinct_buckets(rows, grouped), "jaccard-buckets")


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_similar(unpack(x.as_buffer(), "<u8"), unpack(y.as_buffer(), "<u8"), percent)
                    for x, y in zip(batch.column("x"), batch.column("y"))]
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose exact sets are similar enough."""
    x = sets.select(c("id").alias("a"), c("tokens").alias("x"))
    y = sets.select(c("id").alias("b"), c("tokens").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verify(percent), "a long, b long")


_PAIRS = "a long, b long"


def _ids(pairs: DataFrame) -> DataFrame:
    return stored(pairs.select(c("a").alias("id")).union(pairs.select("b")).distinct(), "jaccard-ids")


def _labelled(rows: DataFrame, groups: DataFrame) -> DataFrame:
    return rows.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _sets_of(texts: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """``id, tokens`` of the written ids, written; of an id with several texts the set that its summary is about."""
    few = ids.count() <= BROADCAST_IDS
    return stored(
        texts.join(F.broadcast(ids) if few else ids, "id", "left_semi").mapInArrow(
            lambda b: _sets(b, k), "id long, n long, f1 long, f2 long, tokens binary").groupBy("id").agg(
                F.min(F.struct("n", "f1", "f2", "tokens")).alias("s")).select("id", "s.tokens"),
        "jaccard-sets")


def _with_sets_of(sets: DataFrame, texts: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """``sets`` and those of the ids that it lacks."""
    lacking = stored(ids.join(sets, "id", "left_anti").select("id"), "jaccard-wanted")
    return sets if lacking.isEmpty() else sets.unionByName(_sets_of(texts, lacking, k))


def _grown(groups: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """``id, component`` after further links, which are written."""
    if links.isEmpty():
        return groups
    return components(groups.select(c("id").alias("a"), c("component").alias("b")).union(links), name)


def _joined_everywhere(shared: DataFrame, firsts: DataFrame, groups: DataFrame, sets: DataFrame, texts: DataFrame,
                       k: int, bands: Bands) -> DataFrame:
    """``id, component`` of the first links' ``groups`` and of all links that the buckets still hold.

    A step is left out when the one before it found nothing for it.
    """
    # All buckets: rows outside a bucket's main component look for mates of other components.
    labelled = stored(_labelled(shared, groups), "jaccard-labelled")
    pairs = stored(in_buckets(labelled, _buckets(labelled), firsts, _nearest, _PAIRS, bands), "jaccard-pairs")
    if pairs.isEmpty():
        return groups
    ids = _ids(pairs)
    sets = _with_sets_of(sets, texts, ids, k)
    groups = _grown(groups, stored(verified(pairs, sets, bands.percent), "jaccard-links"), "jaccard-second")

    # What is left: buckets that such rows are in, sets compared inside the bucket.
    held = labelled.join(ids, "id", "left_semi").select("key").distinct()
    left = stored(_labelled(labelled.drop("component").join(held, "key", "left_semi"), groups), "jaccard-left")
    concerned = stored(in_buckets(left, _buckets(left), firsts, _concerned, "id long", bands), "jaccard-concerned")
    if concerned.isEmpty():
        return groups
    whole = firsts.join(concerned, "id", "left_semi").join(_with_sets_of(sets, texts, concerned, k), "id")
    last = stored(left.join(whole.select("id", "n"), "id"), "jaccard-last-rows")
    more = in_buckets(last, _buckets(last), whole, _spanning, _PAIRS, bands)
    return _grown(groups, stored(more, "jaccard-more"), "jaccard-last")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4,
                   percent: int = 85) -> DataFrame:
    """``id, n_shingles, component``: component is the smallest id reachable by links.

    Two documents link when 100 * |intersection| >= percent * |union|.
    """
    spark = docs.sparkSession
    bands = Bands(percent)
    texts = docs.select(c(id_col).cast("long").alias("id"), c(text_col).cast("string").alias("text")).where("id IS NOT NULL")
    scanned = texts.mapInArrow(lambda b: _summaries(b, k, bands), "id long, n long, f1 long, f2 long, sketch binary")
    one = scanned.groupBy("id").agg(F.min(F.struct("n", "f1", "f2", "sketch")).alias("s")).select("id", "s.*")
    summary = stored(one, "jaccard-summaries")
    classes = stored(summary.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("id").alias("first")), "jaccard-classes")
    firsts = stored(summary.join(classes.select(c("first").alias("id")), "id", "left_semi").select("id", "n", "sketch"), "jaccard-firsts")

    hits = shared_keys(texts, lambda b: _keyed(b, k, bands))
    mine = hits.withColumnRenamed("owner", "id").join(firsts.select("id"), "id", "left_semi")
    rows = stored(mine.mapInArrow(_rows, "key long, id long").distinct(), "jaccard-rows")
    # Most keys repeat among equal sets only and now stand alone.
    alone = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("id")).alias("x"),
                                    F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")).where("size > 1")
    once = alone.groupBy("size", "x", "y").agg(F.min("key").alias("key"))
    shared = stored(rows.join(once.select("key"), "key", "left_semi"), "jaccard-shared")

    # First links: every set looks for mates in two of its buckets, the same two for most copies of a text.
    turn = F.struct(F.xxhash64("key").alias("turn"), "key")
    two = shared.groupBy("id").agg(F.min(turn).alias("a"), F.max(turn).alias("b")).select(
        "id", F.explode(F.array_distinct(F.array("a.key", "b.key"))).alias("key"))
    few = stored(shared.join(two, ["id", "key"]).withColumn("component", c("id")), "jaccard-few")
    pairs = stored(in_buckets(few, _buckets(few, grouped=False), firsts, _nearest, _PAIRS, bands), "jaccard-pairs")
    sets = _sets_of(texts, _ids(pairs), k)
    links = stored(verified(pairs, sets, percent), "jaccard-links")

    groups = _joined_everywhere(shared, firsts, components(links, "jaccard-first"), sets, texts, k, bands)
    first = classes.join(groups.withColumnRenamed("id", "first"), "first", "left").select(
        "n", "f1", "f2", F.coalesce("component", "first").alias("component"))
    return summary.join(first, ["n", "f1", "f2"], "left").select(
        "id", c("n").alias("n_shingles"), F.coalesce("component", "id").alias("component"))


@released
def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        sets = shingle_sets(batch.column("text"), k)
        yield pa.RecordBatch.from_pydict({
            "id": batch.column("id"), **_measures(sets), "tokens": pa.array([pack(s, "<u8") for s in sets], pa.binary())})
