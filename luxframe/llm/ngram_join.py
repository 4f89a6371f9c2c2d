"""Similarity join of documents by the Jaccard similarity of their word shingles.

A document's set holds the 64-bit hashes of its distinct five-word shingles.  Hashes fall into ``GROUPS`` groups
by their leading bits; the numbers per group are a point, and for two points the sum of the coordinate
minima bounds the overlap of the sets.  Points lie in bulk-loaded R-trees whose nodes keep the largest
coordinates and the range of sizes, so that a whole node is passed over when its bound misses the overlap
that the similarity asks for.  What survives is verified on the sets.

One tree over all documents prunes little, because counts of unrelated texts are alike; so there is a forest with one
tree per bucket.  Buckets come from ``BANDS`` keys of ``ROWS`` minimum hashes each: a pair of similarity s shares no
bucket with probability (1 - s^3)^30, which is 7e-8 at 0.75 and less above.  A bucket of any size is cut into blocks of
``BLOCK`` members and joined block by block, nothing is left out.

Equal sets are one numbered class before anything else, and classes that hold the same id are tied by a link: an id
with several texts is one document with all their links.  The join then runs twice.  First each
block is only asked for the partners of its hub, the member nearest to the medians of all coordinates (in a group of
near copies, their common origin), and verified links are closed to components; a group of thousands of near
copies becomes one component by as many pairs.  Then the trees give the pairs
across components that are still possible, and those are verified.  Of such a pair one member at least lies outside its
bucket's largest component, so only those members ask, in slices of about ``BLOCK``, every block.  Links inside one
component change nothing.

The first pass over the texts gives keys and digests only.  Documents that share a bucket with another are told to the second pass
by a ``Sieve`` of bounded size, so that neither their texts nor the sets of the rest are shuffled; what it lets through by
mistake is dropped by an exact join.

Null texts and texts without words have an empty set and link with nothing; with fewer than five words the whole
sequence is the one shingle.  Rows without an id are reported alone, with a null component.  Repeated rows are copies;
a row without words names its own id even where the same id links elsewhere with another text.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from luxframe.llm.textual import exact_place, make_room, map_texts, pick, plain_names, scratch, slices

WORDS = 5
PART, WHOLE = 75, 100  # links: PART * union <= WHOLE * intersection
GROUPS = 256
MANY = np.iinfo(np.uint16).max  # a group with so many members or more: no bound
BANDS, ROWS = 30, 3
BLOCK = 4096
LEAF = 16
SIEVE_BITS = 1 << 25  # at most; beyond two million ids more of the others pass
SIEVE_HASHES = 4
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FLIPS = np.random.default_rng(5).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_SHIFTS = np.random.default_rng(6).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64)


class _WordHashes(dict):
    """64-bit hashes of words, kept by a worker and forgotten beyond ``limit``."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def _mixed(values: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit over the word."""
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only \x20 and \x09-\x0D part words
    if not words:
        return np.zeros(0, np.uint64)
    make_room("ngram_join", _HASHES.clear)
    hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    width = min(WORDS, len(words))
    rolled = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        rolled = _mixed(rolled * _MIX + hashes[k : len(words) - width + 1 + k])
    return np.unique(rolled)


def counts_of(hashes: np.ndarray) -> np.ndarray:
    counts = np.bincount((hashes >> np.uint64(56)).astype(np.int64), minlength=GROUPS)
    return np.minimum(counts, MANY).astype(np.uint16)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key per band from the minima of differently mixed hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for first in range(0, len(hashes), 2048):
        part = hashes[first : first + 2048, None] * _FLIPS + _SHIFTS
        part ^= part >> np.uint64(29)
        np.minimum(least, (part * _MIX).min(0), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = _mixed(keys * _MIX + column)
    return keys.view(np.int64)


def digest_of(hashes: bytes) -> bytes:
    return hashlib.blake2b(hashes, digest_size=16).digest()


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, digest, bands`` of every document."""

    def work(texts: list[str]) -> list[pa.Array]:
        sets = [shingle_set(text) for text in texts]
        digests = [digest_of(s.tobytes()) for s in sets]
        return [
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array(digests, pa.binary()),
            pa.array([band_keys(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
        ]

    return map_texts(docs, work, "n_shingles long, digest binary, bands array<long>")


@dataclass
class Sieve:
    """Bloom filter: lets every id through that it was made of, and few others."""

    words: np.ndarray

    @classmethod
    def of(cls, ids: DataFrame) -> Sieve:
        """``ids``: a stored table with ``doc_id``."""
        size = 64
        while size < min(16 * ids.count(), SIEVE_BITS):
            size *= 2
        spots = ids.select(F.explode(cls._spots("doc_id", size)).alias("spot"))
        bit = F.expr("shiftleft(1L, cast(spot % 64 as int))")
        marks = spots.groupBy(F.expr("spot div 64").alias("word")).agg(F.bit_or(bit).alias("mask")).toArrow()
        words = np.zeros(size // 64, np.int64)
        words[marks.column("word").to_numpy()] = marks.column("mask").to_numpy()
        return cls(words.view(np.uint64))

    @staticmethod
    def _spots(name: str, size: int) -> Column:
        return F.array(*[F.pmod(F.xxhash64(name, F.lit(k)), F.lit(size)) for k in range(SIEVE_HASHES)])

    def spots(self, name: str) -> Column:
        return self._spots(name, 64 * len(self.words))

    def passes(self, spots: pa.Array) -> np.ndarray:
        at = spots.flatten().to_numpy().reshape(-1, SIEVE_HASHES)
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(1)


def sets_of(docs: DataFrame, sieve: Sieve) -> DataFrame:
    """``doc_id, digest, counts, hashes`` of the documents that pass: the sorted set of each, eight bytes a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(sieve.passes(batch.column("spots"))))
            ids, texts = batch.column("doc_id"), [text or "" for text in batch.column("text").to_pylist()]
            for part in slices(texts):
                sets = [shingle_set(text) for text in texts[part]]
                made = [[digest_of(s.tobytes()) for s in sets], [counts_of(s).tobytes() for s in sets], [s.tobytes() for s in sets]]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(part.start, len(sets)), *(pa.array(column, pa.binary()) for column in made)],
                    names=["doc_id", "digest", "counts", "hashes"],
                )

    rows = pick(docs, doc_id="long", text="string").where("doc_id is not null")
    rows = rows.withColumn("spots", sieve.spots("doc_id"))
    return rows.mapInArrow(run, "doc_id long, digest binary, counts binary, hashes binary")


# --- the tree ------------------------------------------------------------------------------------


def _needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least overlap of two linked sets of these sizes."""
    return -(-PART * (a + b) // (PART + WHOLE))


class CountTree:
    """Bulk-loaded R-tree over count vectors; a node keeps largest coordinates and least and largest size."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, members: np.ndarray | None = None):
        """``members``: the rows that the tree holds (all); others can only ask."""
        self.counts, self.sizes = np.where(counts == MANY, 2**30, counts).astype(np.int32), sizes.astype(np.int64)
        self.order = self._pack(np.arange(len(sizes)) if members is None else members)
        tops, least, most = self.counts[self.order], self.sizes[self.order], self.sizes[self.order]
        self.levels = []
        while len(tops) > 1 or not self.levels:
            cuts = np.arange(0, len(tops), LEAF)
            tops = np.maximum.reduceat(tops, cuts)
            least, most = np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts)
            self.levels.append((tops, least, most))

    def _pack(self, members: np.ndarray) -> np.ndarray:
        """Members in tree order: halves at the median of the widest coordinate, again and again."""
        done, waiting = [], [members]
        while waiting:
            part = waiting.pop()
            if len(part) <= LEAF:
                done.append(part)
                continue
            points = self.counts[part]
            axis = int((points.max(0) - points.min(0)).argmax())
            part = part[np.argsort(points[:, axis], kind="stable")]
            half = (len(part) // 2 + LEAF - 1) // LEAF * LEAF
            waiting += [part[half:], part[:half]]
        return np.concatenate(done) if done else members

    def hubs(self) -> np.ndarray:
        """Rows to ask first: the one nearest to the medians of all coordinates."""
        middle = np.median(self.counts, axis=0)
        return np.array([np.abs(self.counts - middle).sum(1).argmin()])

    def search(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(query, member)`` pairs of row numbers whose bound reaches the needed overlap."""
        for first in range(0, len(queries), 256):
            asked = queries[first : first + 256]
            nodes = len(self.levels[-1][0])
            q, node = np.repeat(asked, nodes), np.tile(np.arange(nodes), len(asked))
            for depth in range(len(self.levels) - 1, -1, -1):
                tops, least, most = self.levels[depth]
                fits = (least[node] * PART <= self.sizes[q] * WHOLE) & (self.sizes[q] * PART <= most[node] * WHOLE)
                q, node = self._bounded(q[fits], node[fits], tops, least)
                children = len(self.levels[depth - 1][0]) if depth else len(self.order)
                q, node = np.repeat(q, LEAF), (node[:, None] * LEAF + np.arange(LEAF)).ravel()
                q, node = q[node < children], node[node < children]
            members = self.order[node]
            q, members = self._bounded(q, members, self.counts, self.sizes)
            yield q, members

    def _bounded(self, q: np.ndarray, node: np.ndarray, tops: np.ndarray, least: np.ndarray):
        keep = [
            np.minimum(self.counts[q[i : i + 8192]], tops[node[i : i + 8192]]).sum(1)
            >= _needed(self.sizes[q[i : i + 8192]], least[node[i : i + 8192]])
            for i in range(0, len(q), 8192)
        ]
        chosen = np.concatenate(keep) if keep else np.zeros(0, bool)
        return q[chosen], node[chosen]


# --- candidates, verification, components --------------------------------------------------------


def _blocks(members: DataFrame) -> DataFrame:
    """Add ``blocks`` and ``block``: buckets are cut so that a block holds about ``BLOCK`` members."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    cut = members.join(sizes.where("m > 1"), "key")
    return cut.withColumn("blocks", F.ceil(F.col("m") / BLOCK)).withColumn(
        "block", F.pmod(F.xxhash64("rep"), F.col("blocks"))
    )


def _block_pairs(members: DataFrame, across: bool, points: DataFrame | None = None) -> DataFrame:
    """Candidate pairs ``a < b`` from the trees of all blocks.

    ``across`` false: partners of each block's hub.  True: every pair of different components.  ``points``: sizes and counts by ``rep``,
    where the members do not bring them; they join the rows of the cells last.
    """
    named = ["rep", "component"] if points else ["rep", "component", "n_shingles", "counts"]
    if across:
        groups = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"))
        largest = groups.groupBy("key").agg(
            F.max_by("component", F.struct("m", "component")).alias("largest"),
            F.ceil((F.sum("m") - F.max("m")) / BLOCK).alias("slices"),
        )
        mixed = members.join(largest.where("slices > 0"), "key")
        held = mixed.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
        asking = mixed.where("component <> largest").withColumn("slice", F.pmod(F.xxhash64("rep"), F.col("slices")))
        asking = asking.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        cell = F.xxhash64("key", "block", "slice").alias("cell")
        rows = held.select(cell, F.lit(False).alias("asks"), *named).union(
            asking.select(cell, F.lit(True).alias("asks"), *named)
        )
    else:
        rows = members.select(F.xxhash64("key", "block").alias("cell"), F.lit(False).alias("asks"), *named)
    rows = scratch(rows)
    full = rows.join(points, "rep") if points else rows
    # Cells are small as a rule, so a task call takes some thousand rows of many cells.
    calls = full.withColumn("call", F.pmod("cell", F.lit(max(1, -(-rows.count() // BLOCK)))))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("cell")
        cell, rep, asks, component, sizes = (
            table.column(k).to_numpy() for k in ("cell", "rep", "asks", "component", "n_shingles")
        )
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint16).reshape(-1, GROUPS)
        cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
        found = [np.zeros((0, 2), np.int64)]
        for first, end in zip(cuts, cuts[1:], strict=False):
            asked = asks[first:end]
            if end - first < 2 or (across and (asked.all() or not asked.any())):
                continue
            tree = CountTree(counts[first:end], sizes[first:end], np.flatnonzero(~asked))
            for q, m in tree.search(np.flatnonzero(asked) if across else tree.hubs()):
                q, m = q + first, m + first
                chosen = component[q] != component[m]
                found.append(np.column_stack([rep[q[chosen]], rep[m[chosen]]]))
        pairs = np.sort(np.concatenate(found), axis=1)
        pairs = np.unique(pairs, axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return calls.groupBy("call").applyInArrow(run, "a long, b long").distinct()


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets are similar enough."""
    left = sets.select(F.col("rep").alias("a"), F.col("hashes").alias("left"))
    right = sets.select(F.col("rep").alias("b"), F.col("hashes").alias("right"))

    def run(batches):
        for batch in batches:
            kept = []
            columns = [batch.column(k) for k in ("left", "right")]
            for x, y in zip(*columns, strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(p) + len(q) - len(np.union1d(p, q)) if len(p) and len(q) else 0
                kept.append(both > 0 and WHOLE * both >= PART * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b")], names=["a", "b"]
            ).filter(pa.array(kept, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``rep, component``: smallest number that the links reach, for every number in ``links`` (``a, b``).

    Every round takes the smallest label around each id and then the label of that label, so paths
    shrink by more than half.
    """
    both = scratch(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = scratch(both.groupBy(F.col("a").alias("rep")).agg(F.min(F.least("a", "b")).alias("component")))
    while True:
        around = both.join(labels, both.b == labels.rep).groupBy("a").agg(F.min("component").alias("near"))
        closer = labels.join(around, labels.rep == around.a).select(
            "rep", F.col("component").alias("old"), F.least("component", "near").alias("component")
        )
        jump = labels.select(F.col("rep").alias("component"), F.col("component").alias("further"))
        moved = scratch(
            closer.join(jump, "component", "left").select(
                "rep", "old", F.least("component", F.coalesce("further", "component")).alias("component")
            )
        )
        labels = moved.select("rep", "component")
        if not moved.where("old <> component").limit(1).count():
            return labels


def ties(named: DataFrame, classes: DataFrame) -> DataFrame:
    """Links ``a, b`` between the classes of ids that occur with several sets."""
    spread = named.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y")
    apart = named.select("doc_id", "digest").join(spread.select("doc_id", "x"), "doc_id").where("digest <> x")
    a = classes.select("digest", F.col("rep").alias("a"))
    b = classes.select(F.col("digest").alias("x"), F.col("rep").alias("b"))
    return apart.select("digest", "x").distinct().join(a, "digest").join(b, "x").select("a", "b")


def link(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    drawn = scratch(sketches(docs))
    named = drawn.where("doc_id is not null and n_shingles > 0")
    same = [F.first(k).alias(k) for k in ("n_shingles", "bands")]  # both follow from the digest's set
    leaders = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), *same)
    leaders = scratch(leaders.withColumn("rep", F.monotonically_increasing_id()))
    classes = leaders.select("digest", "doc_id", "rep")
    keyed = leaders.select(F.explode("bands").alias("key"), "rep")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key")
    buckets = scratch(keyed.join(shared, "key"))
    wanted = scratch(leaders.drop("bands").join(buckets.select("rep").distinct(), "rep", "left_semi"))
    chosen = sets_of(docs, Sieve.of(wanted)).dropDuplicates(["doc_id", "digest"])
    sets = scratch(chosen.join(wanted, ["doc_id", "digest"]).select("rep", "n_shingles", "counts", "hashes"))
    points = sets.select("rep", "n_shingles", "counts")

    members = _blocks(buckets)
    hubs = verify(_block_pairs(members.withColumn("component", F.col("rep")), False, points), sets)
    links = scratch(hubs.union(ties(named, classes)))
    near = components(links)
    joined = members.join(near, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    late = scratch(verify(_block_pairs(joined, True, points), sets))
    if late.limit(1).count():
        near = components(links.union(late))
    linked = near.join(classes.select("rep", "doc_id"), "rep")
    smallest = linked.groupBy("component").agg(F.min("doc_id").alias("smallest"))
    reached = linked.join(smallest, "component").select("rep", "smallest")
    labelled = classes.join(reached, "rep", "left").select(
        "digest", F.coalesce("smallest", "doc_id").alias("component_id")
    )
    alone = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return drawn.join(labelled, "digest", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), alone).alias("component_id")
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows whose id is the smallest of its component; of rows with that id one stays."""
    named = link(docs).groupBy(F.col("doc_id").alias("kept_id")).agg(F.min("component_id").alias("component_id"))
    found = named.where("kept_id = component_id").select("kept_id")
    plain, own = plain_names(docs), exact_place(docs, "doc_id")
    named = plain.join(found, F.col(own) == F.col("kept_id"), "left_semi").dropDuplicates([own])
    return named.unionByName(plain.where(F.col(own).isNull())).toDF(*docs.columns)
