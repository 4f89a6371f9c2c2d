"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of ``WINDOW`` words, half overlapping, of every whole text.  Words weigh by inverse document
frequencies of all documents, counted in ``BUCKETS`` hashed buckets so that the table has a fixed size.  A distributed
randomised singular value decomposition gives the latent axes, cut off at ``RANK``: its rows are the vectors of the
benchmark items and of all passages of all documents, each kind with half of the weight.  One pass over the texts adds up
the product of the passages' matrix with its transpose, kept in blocks of rows that every step multiplies.  Items are taken
in groups of ``GROUP``, and a few groups at a time travel to the tasks; a larger benchmark takes more passes, none of which
grows.  Every passage is fitted and every passage is searched.

A document leaks an item when, for one of its passages, the longest common subsequence of the item with the text around
the passage (as many words as the item has on either side) holds most of the item, or less of the item but also its
answer (the last quarter of the words).  Candidates come from the latent space: the text around a passage is asked for
an item where its latent product with the item (the cosine times the length of the text's vector), and what the axes cut
off of the item can add to it, reach the least product that the check allows.  That limit is exact: a subsequence that
is long enough holds so many of the item's words, and these weigh at least what as many of its lightest words weigh.
Products are added as whole numbers, rounded up, limits rounded down.
Texts with such a passage are asked again for the item's rarest words: a subsequence lacks at most ``spare`` words of the
item, so of any ``spare + k`` of the item's words at least ``k`` stand in the text around the passage.  Neither step
skips a leak.  The latent cosine of the passages that leak is reported, as the largest, to rank the leaks.

Null and empty texts leak nothing.  Items with fewer than ``LEAST_WORDS`` words, or none, are no evidence and match
nothing.  Equal items are all reported, repeated documents once per id.  An empty table or benchmark gives no leak.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from luxframe.llm.textual import exact_place, make_room, pick, plain_names, ragged, scratch, slices

WINDOW, STRIDE = 32, 16
BUCKETS = 1 << 18
GROUP, RANK = 200, 256
GROUPS_AT_ONCE = 16
POWER_STEPS = 2
CHARS = 250_000  # of a slice of texts: its arrays fit a processor's cache
BLOCKS = 256  # blocks of words whose products are added up at once
PASSAGES = 1024  # whose pairs of words are formed at once
CELLS = 1 << 23  # pairs of columns up to which a task holds a sum for every pair
FOLDED = 1 << 21  # products that are folded at once where there are more pairs
BLOCK, BANDS = 1 << 18, 64  # cells of a block of rows of the passages' product, and blocks at most
ENTRIES = 1 << 12  # of a block that travel together
FINE = 512  # words around a passage up to which two bytes hold a product finely enough
LCS, LCS_WITH_ANSWER, ANSWER = 0.75, 0.6, 0.6
LEAST_WORDS = 5
LEAK = "doc_id long, item_id long, cosine double, lcs double"


def plain(chunk: str) -> str:
    """A word as it is compared: letters and digits, lower case."""
    return chunk.lower() if chunk.isalnum() else "".join(filter(str.isalnum, chunk)).lower()


def words_of(text: str) -> list[str]:
    return [word for word in map(plain, text.split()) if word]


FACTOR = 0x9E3779B97F4A7C15
FACTOR_BACK = pow(FACTOR, -1, 1 << 64)
GAP, ODD = 0xFFFFFFFF, 0xFFFFFFFE  # spellings of white space, and of what Python has to spell


def _mixed(sums: np.ndarray) -> np.ndarray:
    """Hashes of words from the sums of their spelled characters; never 0, which means no word."""
    sums = (sums ^ (sums >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return np.maximum(sums ^ (sums >> np.uint64(32)), np.uint64(1))


def hashes(words: list[str]) -> np.ndarray:
    """Hash of each word that ``plain`` gave: a polynomial of its characters."""
    sums = [sum(ord(c) * pow(FACTOR, i, 1 << 64) for i, c in enumerate(word)) % (1 << 64) for word in words]
    return _mixed(np.array(sums, np.uint64))


def buckets_of(words: np.ndarray) -> np.ndarray:
    return (words % np.uint64(BUCKETS)).astype(np.int64)


class _Speller:
    """Hashes of all words of many texts in a few array steps; remembers nothing but two fixed tables."""

    def __init__(self):
        self.spelling = np.zeros(0, np.uint32)
        self.powers = self.back = np.zeros(0, np.uint64)

    def _forget(self) -> None:
        self.__init__()

    def _tables(self, n: int) -> None:
        if not len(self.spelling):
            low = [chr(c) for c in range(1 << 16)]
            spelled = [GAP if c.isspace() else 0 if not c.isalnum() else ord(c.lower()) if len(c.lower()) == 1 and c != "Σ" else ODD for c in low]
            self.spelling = np.array([*spelled, ODD], np.uint32)  # the last: characters beyond the first plane
        if len(self.powers) < n:
            self.powers, self.back = (np.full(n, f, np.uint64) for f in (FACTOR, FACTOR_BACK))
            for table in (self.powers, self.back):
                table[0] = 1
                np.multiply.accumulate(table, out=table)

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every chunk between white space (0: no word in it), and the number of chunks of each text."""
        make_room("decontaminate", self._forget)
        joined = " ".join(texts) + " "
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self._tables(len(points) + 1)
        spelled = self.spelling[np.minimum(points, 1 << 16)]
        inside = spelled != GAP
        first = np.flatnonzero(inside[1:] > inside[:-1]) + 1
        first = np.append(0, first) if inside[0] else first
        ends = np.cumsum(np.fromiter((len(text) + 1 for text in texts), np.int64, len(texts)))
        sizes = np.diff(np.searchsorted(first, ends), prepend=0)
        if not len(first):
            return np.zeros(0, np.uint64), sizes
        kept = inside & (spelled != 0)
        before = np.cumsum(kept, dtype=np.int32)
        at = (before[first] - kept[first]).astype(np.int64)
        value = spelled[kept].astype(np.uint64) * self.powers[: before[-1]]
        full = np.diff(at, append=before[-1]) > 0
        found = np.zeros(len(first), np.uint64)
        if full.any():
            found[full] = _mixed(np.add.reduceat(value, at[full]) * self.back[at[full]])
        odd = np.flatnonzero(spelled == ODD)
        if len(odd):
            own = np.unique(np.searchsorted(first, odd, "right") - 1)
            again = [plain(joined[first[c] :].split(None, 1)[0] if c + 1 == len(first) else joined[first[c] : first[c + 1]].rstrip()) for c in own]
            found[own] = np.where([bool(word) for word in again], hashes(again), np.uint64(0))
        return found, sizes


_SPELLER = _Speller()


# --- document frequencies ------------------------------------------------------------------------


def document_frequencies(docs: DataFrame) -> DataFrame:
    """``bucket, df`` over all documents, one row per bucket that occurs; bucket -1 counts the documents."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS + 1, np.int64), 0
        for batch in batches:
            texts = [text or "" for text in batch.column("text").to_pylist()]
            for part in slices(texts, CHARS):
                words, sizes = _SPELLER.words(texts[part])
                held = np.sort((np.repeat(np.arange(len(sizes)) * BUCKETS, sizes) + buckets_of(words))[words > 0])
                df += np.bincount(held[np.diff(held, prepend=-1) > 0] % BUCKETS, minlength=BUCKETS + 1)
            n += len(texts)
        met = np.flatnonzero(df[:-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(met, -1)), pa.array(np.append(df[met], n))], names=["bucket", "df"]
        )

    counted = pick(docs, text="string").mapInArrow(run, "bucket long, df long")
    return counted.groupBy("bucket").agg(F.sum("df").alias("df"))


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """``ln((1 + N) / (1 + df))`` per bucket; the table has ``BUCKETS`` entries whatever the input."""
    found = document_frequencies(docs).toArrow()
    at, times = found.column("bucket").to_numpy(), found.column("df").to_numpy()
    total, df = int(times[at == -1].sum()), np.zeros(BUCKETS)
    df[at[at >= 0]] = times[at >= 0]
    return (np.log((1 + total) / (1 + df)) + 1e-3).astype(np.float32)


# --- latent axes of the benchmark ----------------------------------------------------------------


@dataclass
class Lens:
    """One group of items: their words, the columns of their vocabulary, axes, and latent vectors of unit items.

    ``products`` holds, per column and item, what one such word in a text adds to the product with the unit item: the part
    along the axes, and the size of what the axes cut off.  They are whole numbers on a scale of the item's own, on which
    the words around a passage never overflow, and so are the limits ``least``.
    """

    ids: list[int]
    items: list[list[str]]
    columns: dict[str, int]
    axes: np.ndarray
    latent: np.ndarray
    products: np.ndarray
    least: np.ndarray


def _unit(words: list[str], columns: dict[str, int], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of a vector, scaled to length one; words without a column count nothing."""
    held = np.array([columns[w] for w in words if w in columns], np.int64)
    at, times = np.unique(held, return_counts=True)
    row = np.sqrt(times) * weights[at]
    return at, row / max(np.linalg.norm(row), 1e-12)


def _weights(columns: dict[str, int], idf: np.ndarray) -> np.ndarray:
    return idf[buckets_of(hashes(list(columns)))].astype(np.float64)


class Vocabulary:
    """Looks up the columns of hashed words."""

    def __init__(self, columns: dict[str, int]):
        own = hashes(list(columns))
        self.used = np.zeros(BUCKETS, bool)
        self.used[buckets_of(own)] = True
        self.order = np.argsort(own)
        self.own = own[self.order]

    def columns_of(self, words: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """Column of each word, -1 if the items do not use it."""
        columns = np.full(len(words), -1, np.int64)
        place = np.flatnonzero(self.used[buckets] & (words > 0))
        near = np.minimum(np.searchsorted(self.own, words[place]), len(self.own) - 1)
        same = self.own[near] == words[place]
        columns[place[same]] = self.order[near[same]]
        return columns


def _passages(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document of each passage, and its number there, for documents of so many chunks."""
    passages = np.maximum(-(-(sizes - WINDOW) // STRIDE), 0) + 1
    passages[sizes == 0] = 0
    return np.repeat(np.arange(len(sizes)), passages), ragged(np.zeros(len(sizes), np.int64), passages)


def _before(n: int) -> np.ndarray:
    """What to add to a column to number its pairs with the columns from each row's own on, row after row."""
    rows = np.arange(n)
    return rows * n - rows * (rows + 1) // 2


def _pairs(columns: np.ndarray, sizes: np.ndarray, weights: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of some passages, and the pairs of columns and the products that their vectors of length one hold."""
    n, before = len(weights), _before(len(weights))
    starts = np.cumsum(sizes) - sizes
    whose, k = _passages(sizes)
    first = starts[whose] + k * STRIDE
    lengths = np.minimum(first + WINDOW, (starts + sizes)[whose]) - first
    for at in range(0, len(first), PASSAGES):
        some = lengths[at : at + PASSAGES]
        held = columns[ragged(first[at : at + PASSAGES], some)]
        key = np.sort((np.repeat(np.arange(len(some)) * n, some) + held)[held >= 0])
        new = np.flatnonzero(np.diff(key, prepend=-1))
        owner, column = np.divmod(key[new], n)
        row = np.sqrt(np.diff(np.append(new, len(key)))) * weights[column]
        row /= np.sqrt(np.bincount(owner, row * row, len(some)))[owner]
        partners = np.cumsum(np.bincount(owner, minlength=len(some)))[owner] - np.arange(len(owner))  # itself and those after it
        left, right = np.repeat(np.arange(len(owner)), partners), ragged(np.arange(len(owner)), partners)
        yield len(some), before[column[left]] + column[right], row[left] * row[right]


def _bands(n: int) -> list[tuple[int, int]]:
    """First and last (excluded) pair of the rows of each block."""
    rows = np.append(np.arange(0, n, _height(n)), n)
    first = rows * n - rows * (rows - 1) // 2
    return list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))


def _parts(pairs: np.ndarray, values: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """Sums of sorted pairs of the rows of one block as entries of the blocks that hold them, on both sides of the diagonal."""
    before, height = _before(n), _height(n)
    row = np.searchsorted(before + np.arange(n), pairs, "right") - 1
    column, value = pairs - before[row], values.astype(np.float32)
    aside = column > row
    row, column = np.append(row, column[aside]), np.append(column, row[aside])
    order = np.argsort(row * n + column)
    row, column, value = row[order], column[order], np.append(value, value[aside])[order]
    cuts = np.searchsorted(row, np.arange(0, n + height, height))
    for c, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        for part in (slice(k, min(k + ENTRIES, b)) for k in range(a, b, ENTRIES)):
            place = np.diff((row[part] - c * height) * n + column[part], prepend=0).astype(np.int32)
            yield _part(c, place.tobytes(), value[part].tobytes())


def _height(n: int) -> int:
    """Rows of a block."""
    return max(BLOCK // n, -(-n // BANDS))


def _part(c: int, place: bytes, value: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"c": [c], "place": pa.array([place], pa.binary()), "v": pa.array([value], pa.binary())})


PART = "c long, place binary, v binary"
NUMBER = -1  # in place of a block: a number of passages


def passage_products(texts: DataFrame, columns: dict[str, int], idf: np.ndarray) -> DataFrame:
    """``c, v``: blocks of rows of ``A'A`` for the vectors A of all passages of the texts, and the number of passages.

    A task adds up pairs of columns in a table of all of them, or folds them part by part where these are too many.
    """
    n = len(columns)
    cells, height = n * (n + 1) // 2, _height(n)

    def sent(pairs: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a, b in _bands(n):
            held = slice(*np.searchsorted(pairs, [a, b]))
            yield from _parts(pairs[held], values[held], n)

    def run(batches) -> Iterator[pa.RecordBatch]:
        weights, vocabulary = _weights(columns, idf), Vocabulary(columns)
        whole = np.zeros(cells) if cells <= CELLS else None
        number, waiting, held = 0, [], 0
        for batch in batches:
            texts = [text or "" for text in batch.column("text").to_pylist()]
            for part in slices(texts, CHARS):
                words, sizes = _SPELLER.words(texts[part])
                for more, pairs, values in _pairs(vocabulary.columns_of(words, buckets_of(words)), sizes, weights):
                    number += more
                    if whole is not None:
                        np.add.at(whole, pairs, values)
                        continue
                    waiting.append((pairs, values))
                    held += len(pairs)
                    if held >= FOLDED:
                        yield from sent(*_folded(waiting))
                        waiting, held = [], 0
        if whole is not None:
            for a, b in _bands(n):
                pairs = a + np.flatnonzero(whole[a:b])
                yield from _parts(pairs, whole[pairs], n)
        elif waiting:
            yield from sent(*_folded(waiting))
        yield _part(NUMBER, b"", np.int64(number).tobytes())

    def add(batches) -> Iterator[pa.RecordBatch]:
        current, total = None, None
        done = lambda: pa.RecordBatch.from_pydict({"c": [current], "v": [total.astype(np.int64 if current < 0 else np.float32).tobytes()]})
        for batch in batches:
            for c, place, v in zip(batch.column("c").to_pylist(), batch.column("place"), batch.column("v"), strict=True):
                if c != current:
                    if current is not None:
                        yield done()
                    current = c
                    total = np.zeros(1, np.int64) if c < 0 else np.zeros((min((c + 1) * height, n) - c * height) * n)
                if c < 0:
                    total += np.frombuffer(v.as_buffer(), np.int64)
                else:
                    total[np.cumsum(np.frombuffer(place.as_buffer(), np.int32), dtype=np.int64)] += np.frombuffer(v.as_buffer(), np.float32)
        if current is not None:
            yield done()

    parts = pick(texts, text="string").mapInArrow(run, PART)
    return scratch(parts.repartition("c").sortWithinPartitions("c").mapInArrow(add, "c long, v binary"))


def _folded(waiting: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct pairs and the sums of their products."""
    pairs, values = (np.concatenate(some) for some in zip(*waiting, strict=True))
    order = np.argsort(pairs, kind="stable")
    pairs, values = pairs[order], values[order]
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    return pairs[first], np.add.reduceat(values, first) if len(first) else values


def _multiplied(products: DataFrame, basis: np.ndarray) -> np.ndarray:
    """The blocks of rows times ``basis``."""
    n, height = len(basis), _height(len(basis))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, v in zip(batch.column("c"), batch.column("v"), strict=True):
                part = np.frombuffer(v.as_buffer(), np.float32).reshape(-1, n) @ basis
                yield pa.RecordBatch.from_pydict({"c": [c.as_py()], "v": [part.tobytes()]})

    total = np.zeros_like(basis)
    for row in products.where(F.col("c") >= 0).mapInArrow(run, "c long, v binary").toLocalIterator():
        part = np.frombuffer(row["v"], np.float64).reshape(-1, basis.shape[1])
        total[row["c"] * height : row["c"] * height + len(part)] = part
    return total


def latent_axes(units: np.ndarray, products: DataFrame | None) -> np.ndarray:
    """The leading right singular vectors, at most ``RANK``, by randomised subspace iteration.

    The rows are the items' vectors and those of the passages behind ``products``, each kind with half of the weight.
    """
    n, width = units.shape
    numbers = [] if products is None else [r["v"] for r in products.where(F.col("c") == NUMBER).collect()]
    passages = sum(int(np.frombuffer(v, np.int64)[0]) for v in numbers)
    scale = max(passages, n) / n

    def times(basis: np.ndarray) -> np.ndarray:
        own = scale * (units.T @ (units @ basis))
        return own + _multiplied(products, basis) if passages else own

    basis = np.linalg.qr(np.random.default_rng(3).standard_normal((width, min(RANK, n + passages, width))))[0]
    for _ in range(POWER_STEPS):
        basis = np.linalg.qr(times(basis))[0]
    small = basis.T @ times(basis)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return (basis @ turn[:, np.argsort(-values)]).astype(np.float32)


def fitted_passages(docs: DataFrame) -> DataFrame:
    """``text``: every passage of every document, in plain words; the axes are fitted on all of them.

    ``lenses`` cuts whole texts in the same way, so that no passage has to be spelled out for it.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").to_pylist():
                chunks = text.split()
                last = max(-(-(len(chunks) - WINDOW) // STRIDE), 0)
                found = [" ".join(words_of(" ".join(chunks[k * STRIDE : k * STRIDE + WINDOW]))) for k in range(last + 1 if chunks else 0)]
                yield pa.RecordBatch.from_pydict({"text": pa.array(found, pa.string())})

    return pick(docs, text="string").where("text is not null").mapInArrow(run, "text string")


def _lens(held: list[tuple[int, list[str]]], texts: DataFrame | None, idf: np.ndarray) -> Lens:
    held = sorted(held, key=lambda one: len(one[1]))
    columns = {w: i for i, w in enumerate(sorted({w for _, words in held for w in words}))}
    weights, n = _weights(columns, idf), len(held)
    units, least = np.zeros((n, len(columns)), np.float64), np.zeros(n)
    for i, (_, words) in enumerate(held):
        at, row = _unit(words, columns, weights)
        units[i, at] = row
        light = np.sort([weights[c] * units[i, c] for c in (columns[w] for w in words)])
        least[i] = light[: least_shared(len(words))].sum()
    axes = latent_axes(units, passage_products(texts, columns, idf) if texts is not None else None)
    latent = units @ axes
    near = latent @ axes.T.astype(np.float64)
    products = ((near + np.abs(units - near)) * weights).T
    around = np.array([WINDOW + 2 * STRIDE * _reach(len(words)) for _, words in held])
    kind = np.uint16 if around.max() <= FINE else np.uint32
    scale = (np.iinfo(kind).max / around - 1) / np.maximum(products.max(0), 1e-12)
    products, least = np.ceil(products * scale).astype(kind), np.floor(np.maximum(least * (1 - 1e-4) - 1e-6, 0) * scale).astype(kind)
    return Lens([i for i, _ in held], [w for _, w in held], columns, axes, latent.astype(np.float32), products, least)


def _reach(n: int) -> int:
    """Blocks of ``STRIDE`` words that an item of ``n`` words reaches beyond a passage."""
    return -(-n // STRIDE)


def lenses(benchmark: DataFrame, idf: np.ndarray, texts: DataFrame | None = None) -> Iterator[Lens]:
    """Groups of about ``GROUP`` items, with axes of the items and of all passages of the ``texts``; one group at a time passes through the driver."""
    rows = pick(benchmark, item_id="long", text="string").where("item_id is not null and text is not null").distinct()
    groups = -(-rows.count() // GROUP)
    grouped = scratch(rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(groups, 1)))))
    for part in range(groups):
        held = [
            (row["item_id"], words)
            for row in grouped.where(F.col("part") == part).orderBy("item_id", "text").collect()
            if len(words := words_of(row["text"])) >= LEAST_WORDS
        ]
        if held:
            yield _lens(held, texts, idf)


# --- search and checks ---------------------------------------------------------------------------


def _places(words: list) -> dict:
    """The bits of the places at which each word stands."""
    places: dict = {}
    for j, word in enumerate(words):
        places[word] = places.get(word, 0) | 1 << j
    return places


def _in_order(hits: list[int], n: int) -> int:
    """Length of the longest common subsequence of ``n`` words with words that stand at the places ``hits`` among them."""
    full = (1 << n) - 1
    open_ = full
    for places in hits:
        hit = open_ & places
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return n - open_.bit_count()


def common_subsequence(left: list[str], right: list[str]) -> int:
    """Length of the longest common subsequence, one machine operation per word of ``left`` on the bits of ``right``."""
    places = _places(right)
    return _in_order([places[word] for word in left if word in places], len(right))


def least_shared(n: int) -> int:
    """Fewest words in order with which an item of ``n`` words can be confirmed."""
    return next(k for k in range(n + 1) if k / n >= min(LCS, LCS_WITH_ANSWER))


def makes_leak(share: float, n: int, in_answer: Callable[[], int]) -> bool:
    """Whether a share found in order, with the words in order of the answer of an item of ``n`` words, makes a leak."""
    return share >= LCS or (share >= LCS_WITH_ANSWER and in_answer() >= ANSWER * max(n // 4, 1))


def confirmed(item: list[str], around: list[str]) -> float | None:
    """Share of the item found in order in the text around the passage, if that and the answer make a leak."""
    share = common_subsequence(around, item) / len(item)
    answer = item[-max(len(item) // 4, 1) :]
    return share if makes_leak(share, len(item), lambda: common_subsequence(around, answer)) else None


class Searcher:
    """Passages of a batch against one lens."""

    def __init__(self, lens: Lens, idf: np.ndarray):
        self.lens, self.weights = lens, _weights(lens.columns, idf).astype(np.float32)
        self.columns_of = Vocabulary(lens.columns).columns_of
        # Per item: how many of its rarest words must stand around a passage.  Per column: items that count it.
        self.sizes = np.array([len(words) for words in lens.items], np.int64)
        self.least, pairs = np.zeros(len(lens.items), np.int64), []
        for i, words in enumerate(lens.items):
            spare, counted, times = len(words) - least_shared(len(words)), 0, Counter(words)
            for word in sorted(times, key=lambda w: (-self.weights[lens.columns[w]], w)):
                if counted >= spare + max(len(words) // 5, 1):
                    break
                counted += times[word]
                pairs.append((lens.columns[word], i))
            self.least[i] = counted - spare
        column, item = np.array(sorted(pairs), np.int64).T
        self.items_of = item.astype(np.int16 if len(lens.items) < 1 << 15 else np.int64)
        self.degree = np.append(np.bincount(column, minlength=len(lens.columns)), 0)  # the last: no word of the items
        self.start = np.cumsum(self.degree) - self.degree
        self.reach = np.array([_reach(n) for n in self.sizes.tolist()])  # rising: a lens holds its items by length
        # Per item: the bits of the places at which it holds a column, and its answer's.
        self.places, self.answers = [], []
        for words in lens.items:
            answer = len(words) - max(len(words) // 4, 1)
            self.places.append(_places([lens.columns[w] for w in words]))
            self.answers.append(_places([lens.columns[w] for w in words[answer:]]))

    def near(self, columns: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """``document, passage in it, item``, one row each, wherever the latent product reaches the item's limit."""
        blocks = -(-sizes // STRIDE)
        ends = np.cumsum(blocks)
        begins, before = ends - blocks, np.cumsum(sizes) - sizes
        place = np.flatnonzero(columns >= 0)
        owner = np.searchsorted(before + sizes, place, "right")
        block = begins[owner] + (place - before[owner]) // STRIDE
        new = np.flatnonzero(np.diff(block, prepend=-1))
        products, held, sizes_of = self.lens.products, columns[place], np.diff(np.append(new, len(place)))
        total = np.zeros((int(ends[-1]) + 1, len(self.sizes)), products.dtype)
        for at in range(0, len(new), BLOCKS):
            order = at + np.argsort(-sizes_of[at : at + BLOCKS])
            first, most = new[order], -sizes_of[order]
            sums = products[held[first]]
            for k in range(1, -int(most[0])):
                longer = first[: np.searchsorted(most, -k)]
                sums[: len(longer)] += products[held[longer + k]]
            total[block[first] + 1] = sums
        np.cumsum(total, axis=0, out=total, dtype=total.dtype)  # may wrap around: differences do not
        whose, k = _passages(sizes)
        found = []
        for reach in np.unique(self.reach):
            low, high = np.searchsorted(self.reach, [reach, reach + 1])
            first = begins[whose] + np.maximum(k - reach, 0)
            last = np.minimum(begins[whose] + k + reach + WINDOW // STRIDE, ends[whose])
            some = np.ascontiguousarray(total[:, low:high])
            around = some[last]
            around -= some[first]
            at, item = np.divmod(np.flatnonzero(around >= self.lens.least[low:high]), high - low)
            found.append(np.stack([whose[at], k[at], low + item]))
        return np.concatenate(found, axis=1)

    def candidates(self, columns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(document, passage in it, item)`` wherever enough of the item's rarest words stand around the passage."""
        place = np.flatnonzero(self.degree[columns])
        degree = self.degree[columns[place]]
        item = self.items_of[ragged(self.start[columns[place]], degree)]
        order = np.argsort(item, kind="stable")
        item, place = item[order].astype(np.int64), np.repeat(place, degree)[order]
        # Runs of the least number of words that fit the text around one passage, from the run's first word on.
        last = np.arange(len(item)) + self.least[item] - 1
        held = np.flatnonzero(last < len(item))
        last, run = last[held], item[held]
        close = (item[last] == run) & (place[last] - place[held] < WINDOW + 2 * self.sizes[run])
        run, a, b = run[close], place[held[close]], place[last[close]]
        ends = np.cumsum(sizes)
        owner = np.searchsorted(ends, a, "right")
        inside = b < ends[owner]
        run, a, b, owner = run[inside], a[inside], b[inside], owner[inside]
        before, n = ends[owner] - sizes[owner], self.sizes[run]
        final = np.maximum(-(-(sizes[owner] - WINDOW) // STRIDE), 0)
        least = np.clip(-(-(b - before - n + 1 - WINDOW) // STRIDE), 0, final)
        most = np.minimum((a - before + n) // STRIDE, final)
        counts = np.maximum(most - least + 1, 0)
        found = [np.repeat(owner, counts), ragged(least, counts), np.repeat(run, counts)]
        return tuple(np.unique(np.stack(found), axis=1)) if len(found[0]) else tuple(found)

    def asked(self, columns: np.ndarray, sizes: np.ndarray) -> list[tuple]:
        """``(document, passage in it, item)`` that both limits leave."""
        near = self.near(columns, sizes)
        own = np.unique(near[0])
        if not len(own):
            return []
        before = np.cumsum(sizes) - sizes
        d, k, i = self.candidates(columns[ragged(before[own], sizes[own])], sizes[own])
        key = lambda d, k, i: (d * (int(sizes.max()) + 1) + k) * len(self.sizes) + i
        left = np.isin(key(own[d], k, i), key(*near))
        return list(zip(own[d][left].tolist(), k[left].tolist(), i[left].tolist(), strict=True))

    def plausible(self, around: list[int], item: int) -> bool:
        """The check on columns instead of words, which can only find more in common."""
        places, answers, n = self.places[item], self.answers[item], int(self.sizes[item])
        share = _in_order([places[c] for c in around if c in places], n) / n
        return makes_leak(share, n, lambda: _in_order([answers[c] for c in around if c in answers], max(n // 4, 1)))

    def cosine(self, columns: np.ndarray, squares: np.ndarray, item: int) -> float:
        """Latent cosine of one passage with one item."""
        at, times = np.unique(columns[columns >= 0], return_counts=True)
        vector = (np.sqrt(times).astype(np.float32) * self.weights[at]) @ self.lens.axes[at]
        return float(vector @ self.lens.latent[item] / np.sqrt(max(squares.sum(), 1e-12)))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, cosine, lcs``: documents that hold a benchmark item, wholly or reworded."""
    spark = docs.sparkSession
    idf = inverse_frequencies(docs)
    texts = pick(docs, doc_id="long", text="string").where("text is not null and text <> ''")
    found, waiting = [], []

    def scan(group: list[Lens]) -> DataFrame:
        sent = spark.sparkContext.broadcast((group, idf))

        def run(batches) -> Iterator[pa.RecordBatch]:
            held, weights = sent.value
            searchers = [Searcher(lens, weights) for lens in held]
            squares = weights.astype(np.float64) ** 2
            for batch in batches:
                ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                for part in slices(texts, CHARS):
                    yield from _batches(_search(squares, searchers, ids[part], texts[part]))

        return texts.mapInArrow(run, LEAK)

    for lens in lenses(benchmark, idf, texts):
        waiting.append(lens)
        if len(waiting) == GROUPS_AT_ONCE:
            found.append(scratch(scan(waiting)))
            waiting = []
    if waiting or not found:
        found.append(scratch(scan(waiting)) if waiting else spark.createDataFrame([], LEAK))
    leaks = found[0]
    for more in found[1:]:
        leaks = leaks.unionByName(more)
    return leaks.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs").alias("lcs"))


def _search(weights: np.ndarray, searchers: list[Searcher], ids: list, texts: list[str]) -> list[tuple]:
    """Leaks of a slice of texts; ``weights``: squared inverse frequency per bucket."""
    words, sizes = _SPELLER.words(texts)
    if not len(words):
        return []
    before, buckets = np.cumsum(sizes) - sizes, buckets_of(words)
    rows: list[tuple] = []
    spelled: dict[int, list[str]] = {}
    for searcher in searchers:
        columns, best = searcher.columns_of(words, buckets), {}
        for d, k, i in searcher.asked(columns, sizes):
            item, first = searcher.lens.items[i], k * STRIDE
            end = min(first + WINDOW, int(sizes[d]))
            wide = before[d] + max(first - len(item), 0), before[d] + min(end + len(item), int(sizes[d]))
            if not searcher.plausible(columns[wide[0] : wide[1]].tolist(), i):
                continue
            if d not in spelled:
                spelled[d] = [plain(chunk) for chunk in texts[d].split()]
            share = confirmed(item, [w for w in spelled[d][max(first - len(item), 0) : end + len(item)] if w])
            if share is not None:
                a, b = before[d] + first, before[d] + end
                near, most = best.get((d, i), (0.0, 0.0))
                held = weights[buckets[a:b]] * (words[a:b] > 0)
                best[d, i] = max(near, searcher.cosine(columns[a:b], held, i)), max(most, share)
        rows += [(ids[d], searcher.lens.ids[i], near, most) for (d, i), (near, most) in best.items()]
    return rows


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, names=[part.split()[0] for part in LEAK.split(", ")])


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents that leak nothing; rows without an id are judged by nothing and stay."""
    leaking = find_leaks(docs, benchmark).select(F.col("doc_id").alias("leaking_id")).where("leaking_id IS NOT NULL").distinct()
    own = F.col(exact_place(docs, "doc_id"))
    return plain_names(docs).join(leaking, own == F.col("leaking_id"), "left_anti").toDF(*docs.columns)
