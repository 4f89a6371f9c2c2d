"""Alignment of two tokenizers' tokens, and how often each pair of ids ends together in the corpus.

Both tokenizers spell the same bytes (space and text).  Where a token of A and a token of B end at the same byte, the two
are linked, and these places cut the text into groups.

Neither tokenizer joins bytes over a single space between visible characters, nor (if no piece of B does) over the border
between letters and the punctuation or newline behind them.  Texts are cut at the spaces, cuts are split into such parts,
and every distinct part and cut is aligned once a task; a document is a sequence of cuts.  A model or a tokenizer that may join over spaces is applied
to whole texts.

The first pass counts links: each task adds up its own and writes one row per distinct pair.  Of a linked pair the
shorter token is the end of the longer one, so there are no more distinct pairs than the two vocabularies have bytes
(``most_pairs``; below a million here), whatever the corpus.  On that bound rest the driver's list of distinct pairs and
what is broadcast.  A minimal perfect hash numbers the pairs.  Each task turns its share of the counts into a dense
vector indexed by that hash, and the vectors are added up in a tree, ``FAN`` at a time and in slices.  The second pass
aligns again and looks every link up; the key stored under a hash index must be the link's own.

Null and empty texts, and texts whose tokens do not spell exactly their bytes (for example a ``▁`` of their own, which B
reads as a space), have no tokens: zeros and no groups.  Rows are independent but for the counts, to which repeated rows
add.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from luxframe.llm.sentencepiece_codec import MARK, Codec, read_model
from luxframe.llm.textual import ChunkTable, map_texts, pick, ragged, scratch, slices

FAN = 32
SLICE = 16_384  # counts that travel as one row
TOGETHER = 2_000_000
PLACES = re.compile(r"(?<! ) (?=\S)")
ODD = re.compile(r" \s| $")
TAIL = ".,;:!?%*#$&|"  # neither letters, digits nor white space: behind a word they are one pre-token of A
PAIR_COUNTS = "part int, pair long, n long"
_TABLES: dict[str, Alignments] = {}


def _byte_spelling() -> dict[str, int]:
    """Character to byte in byte-level vocabularies: visible bytes spell themselves, the others follow from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _joins_parts(piece: str) -> bool:
    """True if a piece reaches over a border between letters, punctuation and newlines."""
    kinds = ["a" if c.isalpha() else "." if c in TAIL else c if c == "\n" else "" for c in piece]
    return any(x and y and x != y for x, y in zip(kinds, kinds[1:], strict=False))


class PerfectHash:
    """Minimal perfect hash of distinct whole numbers: levels of bits, and the rank of a bit as index.

    On each level the keys that have their slot to themselves set its bit; the others go on to the next level.
    """

    def __init__(self, keys: np.ndarray, room: float = 2.0):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        rest, placed = np.unique(keys), 0
        while len(rest):
            size = max(64, int(room * len(rest)))
            slots = self._slots(rest, len(self.levels), size)
            bits = np.bincount(slots, minlength=size) == 1
            ranks = placed + np.cumsum(bits) - bits
            self.levels.append((bits, ranks.astype(np.int32)))
            placed += int(bits.sum())
            rest = rest[~bits[slots]]
        self.keys = np.zeros(placed, np.int64)
        if placed:
            distinct = np.unique(keys)
            self.keys[self._walk(distinct)] = distinct

    @staticmethod
    def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        mixed = keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
        mixed = (mixed ^ mixed >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ mixed >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return ((mixed ^ mixed >> np.uint64(31)) % np.uint64(size)).astype(np.int64)

    def _walk(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(self.levels):
            if not len(left):
                break
            slots = self._slots(keys[left], level, len(bits))
            hit = bits[slots]
            out[left[hit]] = ranks[slots[hit]]
            left = left[~hit]
        return out

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of every key, verified; -1 for keys that were not hashed."""
        found = self._walk(keys)
        known = found >= 0
        known[known] = self.keys[found[known]] == keys[known]
        return np.where(known, found, -1)


class Pair:
    """The two tokenizers with the bytes of their tokens."""

    def __init__(self, description: str, model: bytes):
        self.a = Tokenizer.from_str(description)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        spelling = _byte_spelling()
        shape = json.loads(description)
        split = shape.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        self.separable = bool(plain) and shape.get("normalizer") is None and Codec(model, limit=1).separable
        self.a_tokens = [
            bytes(spelling[c] for c in token) if token and all(c in spelling for c in token) else (token or "").encode()
            for token in map(self.a.id_to_token, range(self.a.get_vocab_size()))
        ]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.splits_words = self.separable and not any(map(_joins_parts, pieces))
        self.b_tokens = []
        for i, piece in enumerate(pieces):
            self.b_tokens.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode())

    def most_pairs(self) -> int:
        """Linked pairs there can be: a token and an end of it, itself included."""
        a, b = set(self.a_tokens), set(self.b_tokens)
        return sum(t[k:] in b for t in a for k in range(len(t))) + sum(t[k:] in a for t in b for k in range(1, len(t)))

    def chunks(self, text: str) -> list:
        """Cuts of space and text: a word stands for itself behind a space, a tuple holds a cut as it stands."""
        if not text:
            return []
        if not self.separable:
            return [(f" {text}",)]
        if text[0].isspace() or ODD.search(text):
            whole = f" {text}"
            places = [0, *(m.start() for m in PLACES.finditer(whole) if m.start()), len(whole)]
            return [(whole[a:b],) for a, b in zip(places, places[1:], strict=False)]
        return text.split(" ")


class Linked(ChunkTable):
    """Distinct strings with their links, token numbers and groups, and with their counts once these are known."""

    def _forget(self) -> None:
        super()._forget()
        self.flat = np.zeros(0, np.int64)
        self.groups: list[str] = []
        # tokens of A, of B, 1 if not spelled exactly, best links, counts of the links, links that were not counted
        self.facts = np.zeros((0, 6), np.int64)

    def _trim(self) -> None:
        super()._trim()
        del self.groups[len(self.starts) :]
        self.facts = self.facts[: len(self.starts)]


class Parts(Linked):
    """Pieces of text at whose ends both tokenizers end a token, each aligned once.

    A string is letters, a run of punctuation or a newline, perhaps behind one space, and goes to A's model as one
    pre-token; a tuple holds any other cut.
    """

    def __init__(self, pair: Pair, counts: Counts | None, limit: int):
        self.pair, self.counts = pair, counts
        spelled = {byte: char for char, byte in _byte_spelling().items()}
        self.spelled = "".join(spelled[b] for b in range(256))
        self.line_ids = len(pair.b.encode("\n"))
        tokens = (pair.a_tokens, pair.b_tokens)
        self.a_bytes, self.b_bytes = (np.frombuffer(b"".join(t), np.uint8) for t in tokens)
        self.a_sizes, self.b_sizes = (np.array(list(map(len, t)), np.int64) for t in tokens)
        self.a_names, self.b_names = (list(map(str, range(len(t)))) for t in tokens)
        super().__init__(self._align, limit)

    def _encoded(self, parts: list) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and of B.  B puts a space in front itself; behind a newline it has to be taken off with the newline."""
        tokenize, spelled = self.pair.a.model.tokenize, self.spelled
        a: list = [None if isinstance(p, tuple) else [t.id for t in tokenize(p.encode().decode("latin-1").translate(spelled))] for p in parts]
        odd = [p[0] for p in parts if isinstance(p, tuple)]
        found = iter(self.pair.a.encode_batch_fast(odd, add_special_tokens=False))
        a = [next(found).ids if ids is None else ids for ids in a]
        texts = [p[0] if isinstance(p, tuple) else p for p in parts]
        b = self.pair.b.encode([t[1:] if t[0] == " " else f"\n{t}" for t in texts], num_threads=1)
        return a, [ids if t[0] == " " else ids[self.line_ids :] for ids, t in zip(b, texts, strict=True)]

    @staticmethod
    def _bytes(ids, numbers, sizes, data) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the tokens end to end, and how many bytes each part has."""
        starts = np.cumsum(sizes) - sizes
        ends = np.concatenate([[0], np.cumsum(sizes[ids])])
        upto = np.cumsum(numbers)
        return data[ragged(starts[ids], sizes[ids])], ends[upto] - ends[upto - numbers]

    def _align(self, parts: list) -> tuple[np.ndarray, np.ndarray]:
        found = self._encoded(parts)
        numbers = [np.fromiter(map(len, rows), np.int64, len(rows)) for rows in found]
        a, b = (np.fromiter(chain.from_iterable(rows), np.int64, int(n.sum())) for rows, n in zip(found, numbers, strict=True))
        raw = [(p[0] if isinstance(p, tuple) else p).encode() for p in parts]
        want, spans = np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw))
        wrong = np.zeros(len(parts), bool)
        for ids, n, sizes, data in ((a, numbers[0], self.a_sizes, self.a_bytes), (b, numbers[1], self.b_sizes, self.b_bytes)):
            got, lengths = self._bytes(ids, n, sizes, data)
            wrong |= lengths != spans
            if wrong.any() or not np.array_equal(got, want):
                ends = np.cumsum(lengths)
                wrong |= [got[e - k : e].tobytes() != t for e, k, t in zip(ends.tolist(), lengths.tolist(), raw, strict=True)]
        owners = [np.repeat(np.arange(len(parts)), n) for n in numbers]
        a, owner = a[~wrong[owners[0]]], owners[0][~wrong[owners[0]]]
        b = b[~wrong[owners[1]]]
        _, at_a, at_b = np.intersect1d(
            np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b]), assume_unique=True, return_indices=True
        )
        links = a[at_a] * len(self.b_sizes) + b[at_b]
        sizes = np.bincount(owner[at_a], minlength=len(parts))
        facts = np.zeros((len(sizes), 6), np.int64)
        facts[:, 0], facts[:, 1], facts[:, 2] = numbers[0], numbers[1], wrong
        if self.counts is not None:
            facts[:, 3:] = _sums(self.counts.of(links), sizes)
            self.groups += self._spell(a, b, at_a, at_b, sizes)
        self.facts = np.concatenate([self.facts, facts])
        return links, sizes

    def _spell(self, a, b, at_a, at_b, sizes) -> list[str]:
        left, right = [self.a_names[i] for i in a.tolist()], [self.b_names[i] for i in b.tolist()]
        groups, p, q = [], 0, 0
        for i, j in zip(at_a.tolist(), at_b.tolist(), strict=True):
            first = left[i] if p == i else ",".join(left[p : i + 1])
            second = right[j] if q == j else ",".join(right[q : j + 1])
            groups.append(f"{first}|{second}")
            p, q = i + 1, j + 1
        ends = np.cumsum(sizes)
        return [";".join(groups[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


class Alignments(Linked):
    """Distinct cuts of texts, each put together from its parts."""

    def __init__(self, description: str, model: bytes, counts: Counts | None, limit: int = 300_000):
        self.pair = Pair(description, model)
        self.counts = counts
        self.parts = Parts(self.pair, counts, limit)
        super().__init__(self._segment, limit)

    @classmethod
    def of(cls, key: str, description: str, model: bytes, counts: Counts | None = None) -> Alignments:
        if key not in _TABLES:
            _TABLES.clear()
            _TABLES[key] = cls(description, model, counts)
        return _TABLES[key]

    def _split(self, chunk: str | tuple) -> list:
        """Letters, the punctuation behind them and newlines; a cut that holds anything else stays whole."""
        if not isinstance(chunk, str):
            return [chunk]
        if self.pair.splits_words:
            stem = chunk.rstrip(TAIL)
            if stem.isalpha():
                return [f" {stem}", chunk[len(stem) :]] if len(stem) < len(chunk) else [f" {stem}"]
            lines = chunk.split("\n")
            stems = [line.rstrip(TAIL) for line in lines]
            if len(lines) == 2 and stems[0].isalpha() and stems[1].isalpha():
                tails = [line[len(stem) :] for line, stem in zip(lines, stems, strict=True)]
                return [part for part in (f" {stems[0]}", tails[0], "\n", stems[1], tails[1]) if part]
        return [(f" {chunk}",)]

    def _segment(self, chunks: list) -> tuple[np.ndarray, np.ndarray]:
        split = list(map(self._split, chunks))
        numbers = np.fromiter(map(len, split), np.int64, len(split))
        table = self.parts
        codes = table.codes([list(chain.from_iterable(split))])[0]
        if self.counts is not None:
            spelled = [table.groups[code] for code in codes.tolist()]
            ends = np.cumsum(numbers).tolist()
            self.groups += [
                spelled[e - 1] if n == 1 else ";".join(spelled[e - n : e]) for e, n in zip(ends, numbers.tolist(), strict=True)
            ]
        self.facts = np.concatenate([self.facts, _sums(table.facts[codes], numbers)])
        links = table.flat[ragged(table.starts[codes], table.sizes[codes])]
        return links, _sums(table.sizes[codes][:, None], numbers)[:, 0]


class Counts:
    """Corpus-wide counts of linked pairs behind the perfect hash."""

    def __init__(self, hashed: PerfectHash, numbers: np.ndarray, b_size: int):
        self.hashed, self.numbers = hashed, numbers
        b = hashed.keys % b_size
        most = np.zeros(b_size, np.int64)
        np.maximum.at(most, b, numbers)
        self.best = (numbers == most[b]).astype(np.int64)

    def of(self, links: np.ndarray) -> np.ndarray:
        """For each link: 1 if its count is the best of its id of B, its count, 1 if it was not counted.

        A cut's links go uncounted if all documents that hold it have no tokens.
        """
        found = self.hashed.index(links)
        out = np.zeros((len(links), 3), np.int64)
        known = found >= 0
        out[known, 0], out[known, 1], out[:, 2] = self.best[found[known]], self.numbers[found[known]], ~known
        return out


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows (runs may be empty)."""
    upto = np.concatenate([np.zeros((1, values.shape[1]), np.int64), np.cumsum(values, axis=0)])
    ends = np.cumsum(sizes)
    return upto[ends] - upto[ends - sizes]


def _documents(table: Alignments, texts: list[str]):
    """Codes of each text's cuts, the number of cuts, and which texts have tokens."""
    codes = table.codes([table.pair.chunks(text) for text in texts])
    sizes = np.fromiter(map(len, codes), np.int64, len(codes))
    joined = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    good = (sizes > 0) & (_sums(table.facts[joined, 2:3], sizes)[:, 0] == 0)
    return codes, joined, sizes, good


def _merged(keys: list[np.ndarray], numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    out = np.zeros(len(distinct), np.int64)
    np.add.at(out, place, np.concatenate(numbers))
    return distinct, out


def count_links(docs: DataFrame, description: str, model: bytes) -> DataFrame:
    """``part, pair, n``: links by pair (id of A times the size of B, plus id of B) and task."""
    key = f"count-{uuid.uuid4().hex}"

    def run(batches):
        table = Alignments.of(key, description, model)
        keys, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            texts = [text or "" for text in batch.column("text").to_pylist()]
            for part in slices(texts, TOGETHER):
                _, joined, sizes, good = _documents(table, texts[part])
                weight = np.bincount(joined[np.repeat(good, sizes)], minlength=len(table.starts))
                used = np.flatnonzero(weight)
                keys.append(table.flat[ragged(table.starts[used], table.sizes[used])])
                numbers.append(np.repeat(weight[used], table.sizes[used]))
                if sum(map(len, keys)) > 2_000_000:
                    keys, numbers = map(lambda c: [c], _merged(keys, numbers))
        pairs, totals = _merged(keys, numbers)
        place = np.full(len(pairs), TaskContext.get().partitionId(), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (place, pairs, totals)], names=["part", "pair", "n"])

    return pick(docs, text="string").mapInArrow(run, PAIR_COUNTS)


def tree_sum(counted: DataFrame, hashed: PerfectHash) -> np.ndarray:
    """Count of every hashed pair: dense vectors of the tasks, added up ``FAN`` at a time."""
    size = len(hashed.keys)
    cuts = range(0, size, SLICE)
    spark = counted.sparkSession
    shared = spark.sparkContext.broadcast(hashed)
    schema = "slice int, node int, counts binary"

    def leaf(batches):
        vector = np.zeros(size, np.int64)
        for batch in batches:
            places = shared.value.index(batch.column("pair").to_numpy())
            np.add.at(vector, places, batch.column("n").to_numpy())
        node = TaskContext.get().partitionId() // FAN
        rows = [[k, node, vector[at : at + SLICE].tobytes()] for k, at in enumerate(cuts)]
        columns = zip(*rows, strict=True) if rows else [[], [], []]
        arrays = [pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()), strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["slice", "node", "counts"])

    def branch(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(held, np.int64) for held in group.column("counts").to_pylist())
        head = group.slice(0, 1)
        node = pa.array([head.column("node")[0].as_py() // FAN], pa.int32())
        return pa.table([head.column("slice"), node, pa.array([total.tobytes()], pa.binary())], ["slice", "node", "counts"])

    leaves = counted.select("pair", "n")
    nodes = leaves.rdd.getNumPartitions() // FAN + 1
    tree = leaves.mapInArrow(leaf, schema).groupBy("slice", "node").applyInArrow(branch, schema)
    while nodes > 1:
        nodes = (nodes - 1) // FAN + 1
        tree = tree.groupBy("slice", "node").applyInArrow(branch, schema)
    vector = np.zeros(size, np.int64)
    for row in tree.collect():
        found = np.frombuffer(row["counts"], np.int64)
        vector[row["slice"] * SLICE : row["slice"] * SLICE + len(found)] = found
    shared.destroy()
    return vector


def pair_counts(docs: DataFrame, description: str, model: bytes) -> Counts:
    """First pass: counts of all pairs that are linked anywhere."""
    counted = scratch(count_links(docs, description, model))
    pairs = counted.select("pair").distinct().toArrow().column("pair").to_numpy()
    hashed = PerfectHash(pairs)
    pieces = sentencepiece.SentencePieceProcessor(model_proto=model).get_piece_size()
    return Counts(hashed, tree_sum(counted, hashed), pieces)


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Tokens, groups and links of every document, with corpus-wide counts.

    ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``; ``groups`` reads ``a1,a2|b1;a3|b2``.
    """
    with open(a_path, encoding="utf-8") as file:
        description = file.read()
    model = read_model(b_path)
    counts = docs.sparkSession.sparkContext.broadcast(pair_counts(docs, description, model))
    key = f"look-up-{uuid.uuid4().hex}"
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def work(texts: list[str]) -> list[pa.Array]:
        table = Alignments.of(key, description, model, None if key in _TABLES else counts.value)
        codes, joined, sizes, good = _documents(table, texts)
        sums = _sums(np.column_stack([table.facts[joined], table.sizes[joined]]), sizes) * good[:, None]
        n_a, n_b, _, n_best, count_sum, uncounted, n_links = sums.T
        if uncounted.any():
            raise RuntimeError("a linked pair was not counted: the documents changed between the passes")
        spelled = table.groups.__getitem__
        groups = [";".join(map(spelled, c.tolist())) if ok else "" for c, ok in zip(codes, good.tolist(), strict=True)]
        columns = (n_a, n_b, n_links, n_links, n_best, count_sum)  # tokens are never empty: one link per common end
        return [*(pa.array(np.ascontiguousarray(c)) for c in columns), pa.array(groups, pa.string())]

    schema = ", ".join([*(f"{name} long" for name in names), "groups string"])
    return map_texts(docs, work, schema, chars=TOGETHER)


def digests(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Numbers of every document and a checksum of its groups."""
    checksum = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return align(docs, a_path, b_path).withColumn("groups_sha256", checksum).drop("groups")
