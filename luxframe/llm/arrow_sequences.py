"""Token ids as Arrow stream files of equal-length sequences with masks.

Documents are range-partitioned and sorted by ``doc_id``; every partition becomes one shard: a stream
of record batches whose columns are fixed-size lists, so that sequence ``r`` of a shard lies at a fixed
place of batch ``r // BATCH_SEQUENCES`` and is read without copying from a memory map.  Ids run on from
one sequence to the next; only the last sequence of a shard is padded, and its mask says where.  A second
small stream lists the documents (``doc_id``, first id inside the shard, number of ids).

A task writes under a name of its own and reports it in the manifest, which Spark commits as Parquet:
files of failed or repeated attempts are never listed.  The order of shards is the order of ids, so the
running total over the manifest (one row per shard) gives every document's place in the whole stream.

Null and empty texts hold the end id alone.  Null ids come first, equal ids lie side by side in the order
of their texts; repeated rows are kept.  An empty table gives no shard and an empty result.
"""

from __future__ import annotations

import re
import re
import uuid
from codecs import charmap_decode
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from luxframe.llm.textual import ChunkTable, pick, ragged, slices
from luxframe.session import checkpoint_folder, shuffle_width

LENGTH = 2048
BATCH_SEQUENCES = 128
# White space as the pre-tokenizer's expressions understand it, with a range as in an expression.
GAPS = "\t\n\x0b\x0c\r \x85\xa0  -     　"
IS_GAP = np.array([bool(re.match(f"[{GAPS}]", chr(c))) for c in range(0x3002)])  # the last stands for all behind it
NEWLINE = 10
FACTOR = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
# Where a letter ends a pre-token: no apostrophe, which may begin one with letters, and no bar, which is part of special tokens.
MARKS = ".,;:!?%*#$&"
IS_MARK = np.isin(np.arange(len(IS_GAP)), [ord(mark) for mark in MARKS])
IS_LETTER = np.array([*(chr(c).isalpha() for c in range(len(IS_GAP) - 1)), False])


def _spelling() -> str:
    """How the model spells each byte: visible ones as they are, the others as characters from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return "".join(chr(b if b in visible else next(rest)) for b in range(256))


SPELLED = _spelling()
MANIFEST = "shard long, ids_path string, index_path string, n_docs long, n_ids long"
INDEX = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())])
_ENCODERS: dict[str, ByteEncoder] = {}


class ByteEncoder:
    """One tokenizer in one worker.

    A pre-token never runs from a visible character into white space, from a letter into one of ``MARKS``, or over a
    single newline between visible characters, so a text may be cut there: the chunks are encoded once each and joined
    back by position.
    """

    def __init__(self, description: str, limit: int = 700_000):
        self.tokenizer = Tokenizer.from_str(description)
        self.table = ChunkTable(self._segment, limit)
        self.small = self.tokenizer.get_vocab_size() <= 1 << 16

    @classmethod
    def of(cls, description: str) -> ByteEncoder:
        if description not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[description] = cls(description)
        return _ENCODERS[description]

    def _segment(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new chunks; letters, also behind a space, are one pre-token, which goes to the tokenizer's model directly."""
        plain = [(chunk[1:] if chunk[0] == " " else chunk).isalpha() for chunk in chunks]
        odd = [chunk for chunk, letters in zip(chunks, plain, strict=True) if not letters]
        rest = iter(self.tokenizer.encode_batch_fast(odd, add_special_tokens=False))
        tokenize, flat, sizes = self.tokenizer.model.tokenize, [], []
        for chunk, letters in zip(chunks, plain, strict=True):
            ids = [token.id for token in tokenize(charmap_decode(chunk.encode(), "strict", SPELLED)[0])] if letters else next(rest).ids
            flat += ids
            sizes.append(len(ids))
        return np.array(flat, np.int32), np.array(sizes, np.int64)

    @staticmethod
    def runs(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Different chunks of the texts, which of them each chunk in turn is, and the number of chunks of each text.

        Chunks with equal hashes are compared character by character before they count as one.
        """
        joined = "".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        if not joined:
            return [], np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        low = np.minimum(points, len(IS_GAP) - 1)
        gap, ends = IS_GAP[low], np.cumsum(lengths)
        begins, some = ends - lengths, lengths > 0
        cut = gap.copy()
        cut[1:] &= ~gap[:-1]
        cut[1:] |= IS_MARK[low[1:]] & IS_LETTER[low[:-1]]
        cut[begins[some]] = True
        lines = np.flatnonzero(points[1:-1] == NEWLINE) + 1
        lone = lines[~(gap[lines - 1] | gap[lines + 1])]
        cut[lone + 1] = True
        first = np.flatnonzero(cut)
        sizes = np.diff(np.append(first, len(points)))
        powers, back = _powers(len(points))
        sums = np.add.reduceat((points + np.uint64(1)) * powers[: len(points)], first) * back[first]
        _, held, which = np.unique(sums, return_index=True, return_inverse=True)
        again = first[held][which]
        if (sizes[held][which] != sizes).any() or (points[ragged(again, sizes)] != points).any():  # equal hashes, other chunks
            spelled = [joined[a : a + n] for a, n in zip(first.tolist(), sizes.tolist(), strict=True)]
            places: dict[str, int] = {}
            which = np.fromiter((places.setdefault(chunk, len(places)) for chunk in spelled), np.int64, len(spelled))
            chunks = list(places)
        else:
            chunks = [joined[a : a + n] for a, n in zip(first[held].tolist(), sizes[held].tolist(), strict=True)]
        return chunks, which, np.diff(np.searchsorted(first, ends), prepend=0)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        chunks, which, numbers = self.runs(texts)
        codes = self.table.codes([chunks])[0][which]
        sizes = self.table.sizes[codes]
        flat = self.table.flat[ragged(self.table.starts[codes], sizes)]
        total = np.append(0, np.cumsum(sizes))
        return np.split(flat, total[np.cumsum(numbers)[:-1]])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor and of its inverse, at least ``n``."""
    if len(_POWERS[0]) < n:
        for i, factor in enumerate((FACTOR, pow(FACTOR, -1, 1 << 64))):
            table = np.full(n, factor, np.uint64)
            table[0] = 1
            _POWERS[i] = np.multiply.accumulate(table)
    return _POWERS[0], _POWERS[1]


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def _open(path: str) -> pa.NativeFile:
    system, inner = pafs.FileSystem.from_uri(path)
    return pa.memory_map(inner) if isinstance(system, pafs.LocalFileSystem) else system.open_input_file(inner)


def _create(path: str) -> pa.NativeFile:
    system, inner = pafs.FileSystem.from_uri(path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(inner)


class SequenceWriter:
    """Cuts a run of ids into sequences and writes them in batches of equal size."""

    def __init__(self, sink: pa.NativeFile, length: int, id_type: pa.DataType):
        self.length, self.id_type = length, id_type
        schema = pa.schema([("ids", pa.list_(id_type, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.stream = pa.ipc.new_stream(sink, schema)
        self.waiting: list[np.ndarray] = []
        self.held = self.written = 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= BATCH_SEQUENCES * self.length:
            self._flush(BATCH_SEQUENCES * self.length)

    def _flush(self, step: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.int32)
        whole = len(ids) - len(ids) % step
        for first in range(0, whole, step):
            self._batch(ids[first : first + step], step)
        self.waiting, self.held = [ids[whole:]], len(ids) - whole

    def _batch(self, ids: np.ndarray, room: int) -> None:
        padded = np.zeros(room, ids.dtype)
        padded[: len(ids)] = ids
        values = pa.array(padded.astype(self.id_type.to_pandas_dtype()))
        mask = pa.array(np.arange(room) < len(ids))
        lists = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in (values, mask)]
        self.stream.write_batch(pa.RecordBatch.from_arrays(lists, names=["ids", "mask"]))
        self.written += len(ids)

    def close(self) -> None:
        self._flush(BATCH_SEQUENCES * self.length)
        if self.held:
            self._batch(self.waiting[0], -(-self.held // self.length) * self.length)
        self.stream.close()


def write_sequences(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, length: int = LENGTH, shards: int | None = None
) -> DataFrame:
    """Encode, append ``end_id`` to each document, write shards; gives the committed manifest."""
    spark, description = docs.sparkSession, read_tokenizer(tokenizer_path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, n_docs, n_ids = ByteEncoder.of(description), None, 0, 0
        shard, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        paths = [f"{folder}/{kind}/{shard:06d}-{attempt}.arrow" for kind in ("ids", "index")]
        for batch in batches:
            texts = [text or "" for text in batch.column("text").to_pylist()]
            if writer is None and texts:
                sinks = [_create(path) for path in paths]
                writer = SequenceWriter(sinks[0], length, pa.uint16() if encoder.small else pa.uint32())
                index = pa.ipc.new_stream(sinks[1], INDEX)
            for part in slices(texts):
                rows = encoder.encode(texts[part])
                sizes = np.fromiter((len(row) + 1 for row in rows), np.int64, len(rows))
                for row in rows:
                    writer.add(np.append(row, np.int32(end_id)))
                first = n_ids + np.cumsum(sizes) - sizes
                held = batch.column("doc_id").slice(part.start, part.stop - part.start)
                listed = [held, pa.array(first), pa.array(sizes)]
                index.write_batch(pa.RecordBatch.from_arrays(listed, schema=INDEX))
                n_docs, n_ids = n_docs + len(rows), n_ids + int(sizes.sum())
        if writer is not None:
            writer.close()
            index.close()
            for sink in sinks:
                sink.close()
            columns = [[shard], [paths[0]], [paths[1]], [n_docs], [n_ids]]
            names = [part.split()[0] for part in MANIFEST.split(",")]
            yield pa.RecordBatch.from_arrays([pa.array(column) for column in columns], names=names)

    ordered = (
        pick(docs, doc_id="long", text="string")
        .repartitionByRange(shards or shuffle_width(spark), "doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    ordered.mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _documents(ids_path: str, index_path: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Index batches with the ids of their documents, reading both streams once, front to back."""
    with _open(ids_path) as source, _open(index_path) as listing:
        batches = iter(pa.ipc.open_stream(source))
        buffer, at = np.zeros(0, np.uint32), 0  # at: how many ids the buffer lies behind the shard's start
        for index in pa.ipc.open_stream(listing):
            firsts, sizes = (index.column(k).to_numpy() for k in ("first", "n_tokens"))
            rows = []
            for first, size in zip(firsts.tolist(), sizes.tolist(), strict=True):
                parts = [buffer[first - at :]] if first - at < len(buffer) else []
                while at + len(buffer) < first + size:
                    at, buffer = at + len(buffer), next(batches).column("ids").flatten().to_numpy()
                    parts.append(buffer)
                run = np.concatenate(parts) if len(parts) != 1 else parts[0]
                rows.append(run[:size])
            yield index, rows


def read_documents(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (packed as unsigned 32-bit integers) read back from the files."""
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                for index, rows in _documents(shard["ids_path"], shard["index_path"]):
                    start = pa.array(index.column("first").to_numpy() + shard["before"])
                    ids = pa.array([row.astype("<u4").tobytes() for row in rows], pa.binary())
                    columns = [index.column("doc_id"), start, index.column("n_tokens"), ids]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])

    tasks = shuffle_width(manifest.sparkSession)
    return placed.repartition(tasks, "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def read_sequence(path: str, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of one sequence of a shard, straight from the mapped file."""
    with _open(path) as source:
        for batch in pa.ipc.open_stream(source):
            if row < len(batch):
                ids, mask = (batch.column(k)[row].values for k in ("ids", "mask"))
                return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)
            row -= len(batch)
    raise IndexError(row)


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write all documents, read them back, and give place, length and checksum of each."""
    spark: SparkSession = docs.sparkSession
    folder = f"{checkpoint_folder(spark)}/llm-sequences-{uuid.uuid4().hex}"
    found = read_documents(write_sequences(docs, folder, tokenizer_path))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
