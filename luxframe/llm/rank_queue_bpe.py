"""Byte-level BPE from a file of ranks: a queue of merge ranks under a hierarchical bitmap.

The library's rule is: of all neighbouring tokens whose joined bytes have a rank, join the pair of lowest rank, the
leftmost first.  ``RankQueue`` keeps one bucket of positions per rank.  A bitmap of three levels says which buckets
hold anything: finding the lowest rank is three find-first-set steps however many pairs wait, so a pre-token of
n bytes takes n steps instead of the n² of a scan.  Tokens form a linked list over byte positions.  A pair that
disappears stays in its bucket and is skipped when met, because the rank noted at its position is another one by then.

Texts are cut before a space that a visible character follows (no pre-token runs over such a place), every distinct
cut is encoded once a task, and ids are joined back by position.  The task's table is bounded; cuts beyond it are
encoded each time.  Nothing is shuffled.

Null and empty texts have no ids.  Rows are independent: repeated rows give repeated results, other columns are
ignored, an empty table gives an empty result.  A text without any space is one cut and is handled like any other.
"""

from __future__ import annotations

import base64
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from luxframe.llm.textual import ChunkTable, map_texts, pick, ragged

PLACES = re.compile(r" (?=\S)")
ODD = re.compile(r" \s| $")
TAIL = ".,;:!?%*#$&|"  # neither letters, digits nor white space: behind a word they are one pre-token
TOGETHER = 4_000_000  # characters whose new pre-tokens share one buffer
STAND_IN = "￿"  # a character that no Unicode version will assign
_CODECS: dict[tuple[bytes, str], RankCodec] = {}


def read_ranks(path: str) -> bytes:
    """The rank file as it is (less than a megabyte), read once by the driver and sent with the function."""
    with open(path, "rb") as file:
        return file.read()


class RankQueue:
    """Merges many pre-tokens side by side; all buckets are empty in between.

    The pre-tokens lie in one buffer with a border between them, so a bucket holds the positions of its rank in all of
    them and is emptied in a few array steps.  Pre-tokens do not touch, so it makes no difference that other
    pre-tokens advance in the same step.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.bits = max(ranks.values()).bit_length()
        joins = [
            (left << self.bits | right, rank)
            for token, rank in ranks.items()
            for at in range(1, len(token))
            if (left := ranks.get(token[:at])) is not None and (right := ranks.get(token[at:])) is not None
        ]
        keys, found = (np.array(c, np.int64) for c in zip(*joins, strict=True)) if joins else (np.zeros(0, np.int64),) * 2
        self._build(keys, found)
        # Tokens with a neighbour that joins them to a token of lower rank than their own: after each such merge the
        # rest of its pre-token has to wait.
        below = np.maximum(keys >> self.bits, keys & (1 << self.bits) - 1)
        self.stepwise = set(below[found < below].tolist())
        size = max(ranks.values()) + 1
        self.low = [0] * (size // 64 + 1)
        self.middle = [0] * (size // 4096 + 1)
        self.top = 0
        self.buckets: dict[int, list[np.ndarray]] = {}

    def _build(self, keys: np.ndarray, found: np.ndarray) -> None:
        """Open addressing with a load of at most a quarter."""
        self.shift = np.uint64(64 - max(4, int(4 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.found = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        place = self._place(keys)
        while len(keys):
            free = self.keys[place] < 0
            self.keys[place[free]] = keys[free]
            settled = self.keys[place] == keys
            self.found[place[settled]] = found[settled]
            keys, found, place = keys[~settled], found[~settled], place[~settled] + 1 & size - 1

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the joined tokens, -1 where the file holds none (or one of them is a border)."""
        keys = left.astype(np.int64) << self.bits | right
        keys[(left < 0) | (right < 0)] = -2
        place = self._place(keys)
        met = self.keys[place]
        out = np.where(met == keys, self.found[place], np.int32(-1))
        open_ = np.flatnonzero((met != keys) & (met >= 0))
        while len(open_):
            place[open_] = place[open_] + 1 & len(self.keys) - 1
            met = self.keys[place[open_]]
            hit = met == keys[open_]
            out[open_[hit]] = self.found[place[open_[hit]]]
            open_ = open_[~hit & (met >= 0)]
        return out

    def _push(self, positions: np.ndarray, ranks: np.ndarray) -> None:
        known = ranks >= 0
        positions, ranks = positions[known], ranks[known]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        first = np.flatnonzero(np.diff(ranks, prepend=-1)).tolist()
        for at, end, rank in zip(first, [*first[1:], len(ranks)], ranks[first].tolist(), strict=True):
            bucket = self.buckets.get(rank)
            if bucket is not None:
                bucket.append(positions[at:end])
                continue
            self.buckets[rank] = [positions[at:end]]
            self.low[rank >> 6] |= 1 << (rank & 63)
            self.middle[rank >> 12] |= 1 << (rank >> 6 & 63)
            self.top |= 1 << (rank >> 12)

    def _pop(self) -> tuple[int, np.ndarray]:
        """The lowest waiting rank with its positions from left to right."""
        top = self.top
        a = (top & -top).bit_length() - 1
        word = self.middle[a]
        b = a << 6 | (word & -word).bit_length() - 1
        word = self.low[b]
        rank = b << 6 | (word & -word).bit_length() - 1
        self.low[b] = word = word & (word - 1)
        if not word:
            self.middle[a] &= ~(1 << (b & 63))
            if not self.middle[a]:
                self.top = top & (top - 1)
        bucket = self.buckets.pop(rank)
        return rank, bucket[0] if len(bucket) == 1 else np.unique(np.concatenate(bucket))

    @staticmethod
    def _apart(positions: np.ndarray, following: np.ndarray) -> np.ndarray:
        """Of pairs that share a token, every other one from the left."""
        touching = following[positions[:-1]] == positions[1:]
        if not touching.any():
            return positions
        number = np.arange(len(positions))
        head = np.maximum.accumulate(np.where(np.concatenate([[True], ~touching]), number, 0))
        return positions[(number - head) % 2 == 0]

    def _later(self, positions, rank, ids, following, preceding, owner) -> np.ndarray:
        """Pairs that must wait, because a merge before them in their pre-token opens a pair of lower rank."""
        merged = np.full(len(positions), rank, np.int32)
        opened = np.zeros(len(positions), bool)
        sides = [(ids[preceding[positions]], merged), (merged, ids[following[following[positions]]]), (merged, merged)]
        for left, right in sides:
            found = self._join(left, right)
            opened |= (found >= 0) & (found < rank)
        first = np.concatenate([[True], np.diff(owner[positions]) != 0])
        group = np.cumsum(first) - 1
        return ~first & (np.bincount(group, opened)[group] > 0)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens end to end, and the number of ids of each."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes + 1)
        total = int(sizes.sum()) + len(pieces) + 1
        inside = np.ones(total, bool)
        inside[0] = inside[ends] = False
        ids = np.full(total, -1, np.int32)
        ids[inside] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.cumsum(~inside) - 1
        following, preceding = np.arange(1, total + 1), np.arange(-1, total)
        waiting = np.full(total, -1, np.int32)
        waiting[:-1] = self._join(ids[:-1], ids[1:])
        self._push(np.arange(total), waiting)
        while self.top:
            rank, positions = self._pop()
            positions = positions[waiting[positions] == rank]  # the others are stale
            if rank in self.stepwise and len(positions) > 1:
                later = self._later(positions, rank, ids, following, preceding, owner)
                if later.any():
                    self._push(positions[later], np.full(int(later.sum()), rank, np.int32))
                    positions = positions[~later]
            if len(positions) > 1:
                positions = self._apart(positions, following)
            if not len(positions):
                continue
            gone = following[positions]
            end = following[gone]
            following[positions], preceding[end], ids[positions] = end, positions, rank
            waiting[gone] = ids[gone] = -1
            changed = np.concatenate([preceding[positions], positions])
            if len(changed) > 2:
                changed = np.unique(changed)
            waiting[changed] = self._join(ids[changed], ids[following[changed]])
            self._push(changed, waiting[changed])
        left = ids >= 0
        return ids[left], np.bincount(owner[left], minlength=len(pieces))[: len(pieces)]


class RankCodec:
    """One rank file and pattern in one worker."""

    def __init__(self, file: bytes, pattern: str, limit: int = 600_000):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file.splitlines())}
        self.queue = RankQueue(self.ranks)
        self.source = pattern
        self.pattern = regex.compile(pattern)
        self.chunk_table = ChunkTable(self._segment, limit)
        self.piece_table = ChunkTable(self._merge, limit)
        self.unlike: dict[str, bool] = {}
        self.lengths = np.zeros(max(self.ranks.values()) + 2, np.int64)  # the last entry stands for unknown ids
        for token, rank in self.ranks.items():
            self.lengths[rank] = len(token)
        self.places = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(sorted(self.ranks, key=self.ranks.get)), np.uint8)

    @classmethod
    def of(cls, file: bytes, pattern: str) -> RankCodec:
        if (file, pattern) not in _CODECS:
            _CODECS.clear()
            _CODECS[file, pattern] = cls(file, pattern)
        return _CODECS[file, pattern]

    def _unlike(self, char: str) -> bool:
        """True if the two libraries' Unicode versions class a character apart.

        Only characters younger than Python's own tables can be.  The library is asked: with ranks that join the
        letter or digit and the character only inside one pre-token, it says whether it sees one.
        """
        if char not in self.unlike:
            head = "a" if regex.match(r"\p{L}", char) else "1" if regex.match(r"\p{N}", char) else ""
            found = True
            if head:
                ranks = {bytes([b]): b for b in range(256)}
                for end in range(1, len(char.encode()) + 1):
                    ranks[head.encode() + char.encode()[:end]] = len(ranks)
                asked = tiktoken.Encoding("probe", pat_str=self.source, mergeable_ranks=ranks, special_tokens={})
                found = len(asked.encode_ordinary(head + char)) == 1
            self.unlike[char] = not found
        return self.unlike[char]

    def pretokens(self, chunk: str) -> list[str]:
        """Matches of the pattern as the library finds them."""
        young = [] if chunk.isascii() else [c for c in set(chunk) if unicodedata.category(c) == "Cn" and self._unlike(c)]
        if not young:
            return self.pattern.findall(chunk)
        masked = chunk.translate({ord(c): STAND_IN for c in young})
        return [chunk[m.start() : m.end()] for m in self.pattern.finditer(masked)]

    def _merge(self, pretokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pre-tokens: one id where the file holds the whole pre-token, else through the queue."""
        pieces = [p.encode() for p in pretokens]
        whole = np.array([self.ranks.get(p, -1) for p in pieces], np.int32)
        rest = np.flatnonzero(whole < 0)
        merged, numbers = self.queue.merge([pieces[i] for i in rest.tolist()])
        sizes = np.ones(len(pieces), np.int64)
        sizes[rest] = numbers
        ids = np.zeros(int(sizes.sum()), np.int32)
        starts = np.cumsum(sizes) - sizes
        ids[starts[whole >= 0]] = whole[whole >= 0]
        ids[ragged(starts[rest], numbers)] = merged
        return ids, sizes

    def _segment(self, chunks: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new chunks: a word stands for itself behind a space, a tuple holds a chunk as it stands."""
        parts, numbers = [], []
        for chunk in chunks:
            if isinstance(chunk, str):
                stem = chunk.rstrip(TAIL)
                if stem.isalpha():
                    parts.append(f" {stem}")
                    if len(stem) < len(chunk):
                        parts.append(chunk[len(stem) :])
                        numbers.append(2)
                    else:
                        numbers.append(1)
                    continue
                chunk = f" {chunk}"
            else:
                chunk = chunk[0]
            found = self.pretokens(chunk)
            parts += found
            numbers.append(len(found))
        table = self.piece_table
        codes = table.codes([parts])[0]
        sizes = table.sizes[codes]
        firsts = np.cumsum(numbers) - numbers
        return table.flat[ragged(table.starts[codes], sizes)], np.add.reduceat(sizes, firsts)

    @staticmethod
    def chunks(text: str) -> list:
        """Cuts of a text; where every space is followed by a visible character, splitting does it."""
        if not text:
            return []
        if text[0] == " " or ODD.search(text):
            places = [0, *(m.start() for m in PLACES.finditer(text)), len(text)]
            return [(text[a:b],) for a, b in zip(places, places[1:], strict=False) if a < b]
        words = text.split(" ")
        words[0] = (words[0],)
        return words

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of ids of each text."""
        return self.chunk_table.flat_ids([self.chunks(text) for text in texts])

    def decode(self, ids: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts end to end, and the number of bytes of each; an id that the file does not hold has none."""
        known = np.where((ids >= 0) & (ids < len(self.lengths)), ids, len(self.lengths) - 1)
        sizes = self.lengths[known]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.cumsum(numbers)
        return self.bytes[ragged(self.places[known], sizes)], upto[ends] - upto[ends - numbers]


def _offsets(numbers: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(numbers)]).astype(np.int32)


def id_lists(ids: np.ndarray, numbers: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(_offsets(numbers)), pa.array(ids.astype(np.int32)))


def byte_strings(data: np.ndarray, numbers: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(
        pa.binary(), len(numbers), [None, pa.py_buffer(_offsets(numbers)), pa.py_buffer(np.ascontiguousarray(data))]
    )


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, ids array<int>`` of every text."""
    file = read_ranks(ranks_path)
    return map_texts(
        docs, lambda texts: [id_lists(*RankCodec.of(file, pattern).encode(texts))], "ids array<int>", chars=TOGETHER
    )


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, decoded binary`` of every row of ``doc_id, ids``; null ids give no bytes."""
    file = read_ranks(ranks_path)

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            numbers = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = pc.fill_null(pc.list_flatten(lists), -1).to_numpy(zero_copy_only=False)
            decoded = byte_strings(*RankCodec.of(file, pattern).decode(ids, numbers))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), decoded], names=["doc_id", "decoded"])

    return pick(encoded, doc_id="long", ids="array<int>").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, ids array<int>, decoded binary``: the ids of every text and the bytes of exactly these ids."""
    file = read_ranks(ranks_path)

    def work(texts: list[str]) -> list[pa.Array]:
        codec = RankCodec.of(file, pattern)
        ids, numbers = codec.encode(texts)
        return [id_lists(ids, numbers), byte_strings(*codec.decode(ids, numbers))]

    return map_texts(docs, work, "ids array<int>, decoded binary", chars=TOGETHER)


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Number of ids and checksums of ids and decoded bytes of every document."""
    spelled = F.array_join(F.col("ids").cast("array<string>"), " ")
    return round_trip(docs, ranks_path, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(spelled.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
