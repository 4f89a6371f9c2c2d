"""Stupid-backoff scores of all documents from n-gram counts over all documents.

Documents are dealt into blocks of about ``BLOCK_CHARS`` characters by a hash and travel there compressed.  Every block explodes its texts into
n-grams, adds up equal ones and sends the distinct 64-bit hashes with their counts to the count tables, which are
partitioned by hash range.  A count table adds up the blocks' counts and answers each block in the order it was
asked with what the other blocks hold.  Sorted hashes travel as differences and numbers as bytes, compressed, so an
n-gram that only one block holds is an answer of next to nothing.  The block adds the answers to its own counts and
sums the scores per document.  An n-gram that stands in every document is one row per block: no key is hot.

A document is no evidence for itself: its own counts are taken off before its words are scored.  A word scores
``c(n-gram) / c(context)`` for the longest n-gram that others hold, times ``BACKOFF`` for each word of context given up;
a word that nobody else uses counts as half an occurrence.

Words are parted by \\x20 and \\x09-\\x0D, and A-Z are lower-cased.  Null texts and texts without words have no tokens, sum 0
and a null mean.  Repeated documents are evidence for each other.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from luxframe.llm.textual import pick
from luxframe.session import shuffle_width

ORDER = 3
BACKOFF = 0.4
BLOCK_CHARS = 8_000_000
TABLE_CHARS = 32_000_000
LEVEL = 3  # of the compression of texts
TOKENS = np.uint64(0)  # stands for the number of all tokens in the count tables
SCORES = "doc_id long, n_tokens long, log_score double, mean_log_score double, n_backoffs long"
_K = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """64-bit hashes of words, forgotten beyond ``limit``."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _Hashes()


def _spread(values: np.ndarray) -> np.ndarray:
    """Mixes every bit into the leading ones, which choose the count table."""
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.maximum(values ^ (values >> np.uint64(32)), np.uint64(1))


class Ngrams:
    """N-grams of a list of texts: ``rows[k]`` has the hash of the n-gram of ``k + 1`` words that ends at each word."""

    def __init__(self, texts: list[str], order: int):
        split = [text.encode().lower().split() for text in texts]
        self.sizes = np.fromiter(map(len, split), np.int64, len(split))
        words = np.fromiter((_HASHES[w] for ws in split for w in ws), np.uint64, int(self.sizes.sum()))
        self.owner = np.repeat(np.arange(len(split)), self.sizes)
        starts = np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.position = np.arange(len(words)) - starts
        self.rows, held = [], np.zeros(len(words), np.uint64)
        for k in range(order):
            # The n-gram of k + 1 words is the n-gram of k words one place before, and the word.
            before = np.roll(held, 1)
            held = _spread((before if k else held) * _K + words * np.uint64(2 * k + 3))
            self.rows.append(np.where(self.position >= k, held, np.uint64(0)))

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct hashes (the token mark first), their counts, and each place's index; -1: no such n-gram."""
        flat = np.concatenate([r for r in self.rows]) if self.rows else np.zeros(0, np.uint64)
        hashes, place, counts = np.unique(flat[flat > 0], return_inverse=True, return_counts=True)
        index = np.full(len(flat), -1, np.int64)
        index[flat > 0] = place + 1
        hashes = np.concatenate([[TOKENS], hashes]).astype(np.uint64)
        counts = np.concatenate([[len(self.owner)], counts]).astype(np.int64)
        return hashes, counts, index.reshape(len(self.rows), -1)


def squeezed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as their length and their compressed bytes, one by one, so that they travel in any company."""
    codec = pa.Codec("zstd", compression_level=LEVEL)
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        small = [None if t is None else len(t).to_bytes(4, "little") + codec.compress(t, asbytes=True) for t in texts]
        columns = [batch.column("doc_id"), pa.array(small, pa.binary()), batch.column("block")]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "block"])


def _texts(table: pa.Table) -> list[str]:
    codec = pa.Codec("zstd")
    held = (data or b"" for data in table.column("text").to_pylist())
    return [codec.decompress(data[4:], int.from_bytes(data[:4], "little"), asbytes=True).decode() if data else "" for data in held]


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on as one byte each, compressed; 255 stands for the next of the larger ones that follow."""
    larger = values[values >= 255].astype(np.uint64)
    plain = np.minimum(values, 255).astype(np.uint8).tobytes() + larger.tobytes()
    return np.array([len(values), len(larger)], np.uint32).tobytes() + pa.compress(plain, "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n, larger = np.frombuffer(data, np.uint32, 2).tolist()
    plain = pa.decompress(data[8:], n + 8 * larger, "zstd", asbytes=True)
    values = np.frombuffer(plain, np.uint8, n).astype(np.uint64)
    values[values == 255] = np.frombuffer(plain, np.uint64, larger, n)
    return values


def differences(hashes: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted distinct hashes as their differences: the leading part packed, and the low bytes as they are."""
    steps = np.diff(hashes, prepend=np.uint64(0))
    mean = int(hashes[-1] - hashes[0]) // max(len(hashes) - 1, 1)
    low = max(mean.bit_length() - 2, 0) // 8
    return packed(steps >> np.uint64(8 * low)), steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low].tobytes()


def summed(leading: bytes, rest: bytes) -> np.ndarray:
    """The hashes of their ``differences``."""
    steps = unpacked(leading)
    low = len(rest) // len(steps)
    held = np.zeros((len(steps), 8), np.uint8)
    held[:, :low] = np.frombuffer(rest, np.uint8).reshape(-1, low) if low else 0
    return np.cumsum((steps << np.uint64(8 * low)) | held.view("<u8")[:, 0], dtype=np.uint64)


def _requests(order: int, tables: int):
    """Distinct n-grams of a block, cut by hash range."""

    def run(block: pa.Table) -> pa.Table:
        hashes, counts, _ = Ngrams(_texts(block), order).distinct()
        borders = np.array([(t << 64) // tables for t in range(1, tables)], np.uint64)
        cuts = [0, *np.searchsorted(hashes, borders).tolist(), len(hashes)]
        parts = [(t, a, b) for t, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
        coded = [differences(hashes[a:b]) for _, a, b in parts]
        return pa.table(
            {
                "part": pa.array([t for t, _, _ in parts], pa.int64()),
                "block": pa.array([block.column("block")[0].as_py()] * len(parts), pa.int64()),
                "leading": pa.array([leading for leading, _ in coded], pa.binary()),
                "rest": pa.array([rest for _, rest in coded], pa.binary()),
                "counts": pa.array([packed(counts[a:b]) for _, a, b in parts], pa.binary()),
            }
        )

    return run


def _answer(asked: pa.Table) -> pa.Table:
    """One count table: what all other blocks hold, back in the order of each block's request."""
    coded = zip(asked.column("leading").to_pylist(), asked.column("rest").to_pylist(), strict=True)
    lists = [summed(leading, rest) for leading, rest in coded]
    counts = np.concatenate([unpacked(x) for x in asked.column("counts").to_pylist()])
    cuts = np.cumsum([len(x) for x in lists])[:-1]
    distinct, place = np.unique(np.concatenate(lists), return_inverse=True)
    totals = np.bincount(place, counts, len(distinct)).astype(np.uint64)
    answers = [packed(part) for part in np.split(totals[place] - counts, cuts)]
    return pa.table({"block": asked.column("block"), "part": asked.column("part"), "others": pa.array(answers, pa.binary())})


def _scores(order: int, backoff: float):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        grams = Ngrams(_texts(block), order)
        _, counts, index = grams.distinct()
        ordered = answers.sort_by("part").column("others").to_pylist()
        totals = np.concatenate([unpacked(x) for x in ordered]).astype(np.float64) + counts
        docs, n = len(grams.sizes), len(grams.owner)
        others = []
        for row in index:
            key = grams.owner * len(totals) + np.maximum(row, 0)
            _, place, own = np.unique(key, return_inverse=True, return_counts=True)
            others.append(np.where(row >= 0, totals[row] - own[place], 0.0))
        rest = totals[0] - grams.sizes[grams.owner]
        value = np.log(np.maximum(others[0], 0.5)) - np.log(np.maximum(rest, 1.0)) if n else np.zeros(0)
        reached = np.minimum(grams.position + 1, order)
        used = np.ones(n, np.int64)
        for k in range(1, order):
            context = np.roll(others[k - 1], 1)
            known = (grams.position >= k) & (others[k] > 0) & (context > 0)
            value = np.where(known, np.log(np.where(known, others[k], 1.0)) - np.log(np.where(known, context, 1.0)), value)
            used = np.where(known, k + 1, used)
        value = value + (reached - used) * np.log(backoff)
        total = np.bincount(grams.owner, value, docs)
        given_up = np.bincount(grams.owner, reached - used, docs).astype(np.int64)
        mean = pa.array(total / np.maximum(grams.sizes, 1), mask=grams.sizes == 0)
        return pa.table(
            {
                "doc_id": block.column("doc_id"),
                "n_tokens": pa.array(grams.sizes),
                "log_score": pa.array(total),
                "mean_log_score": mean,
                "n_backoffs": pa.array(given_up),
            }
        )

    return run


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, n_tokens, log_score, mean_log_score, n_backoffs`` of every row."""
    texts = pick(docs, doc_id="long", text="string")
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    tables = max(shuffle_width(docs.sparkSession), -(-chars // TABLE_CHARS))
    numbered = texts.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    dealt = numbered.mapInArrow(squeezed, "doc_id long, text binary, block long").repartition(
        max(shuffle_width(docs.sparkSession), min(blocks, 100_000)), "block"
    )
    requests = dealt.groupBy("block").applyInArrow(
        _requests(order, tables), "part long, block long, leading binary, rest binary, counts binary"
    )
    answers = requests.groupBy("part").applyInArrow(_answer, "block long, part long, others binary")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scores(order, backoff), SCORES)
