"""SentencePiece encoding and decoding through tables of distinct marked words.

A text is marked (``▁`` for every space, one in front) and cut before each run of marks and before
each newline.  No piece of a suitable model holds a mark after another character or holds a newline,
so no merge crosses a cut and a chunk is segmented the same wherever it stands.  Each task segments
every distinct chunk once and joins the ids back by position.  The table lives in the task: joining
135 million positions back by a shuffle would move several times the input, a table in the task moves
nothing and its size is bounded.  A model whose pieces may cross a cut is applied to whole texts.

Null and empty texts have no pieces (only begin and end ids).  Rows are independent, so repeated rows
give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from luxframe.llm.textual import ChunkTable, make_room, map_texts, pick

MARK = "▁"
CUTS = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*")
_CODECS: dict[bytes, Codec] = {}


def read_model(path: str) -> bytes:
    """Model bytes, read once by the driver and sent with the function (half a megabyte)."""
    with open(path, "rb") as file:
        return file.read()


class Codec:
    """One model in one worker."""

    def __init__(self, model: bytes, limit: int = 400_000):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size())]
        mark = self.processor.piece_to_id(MARK)
        self.separable = (
            mark != self.processor.unk_id()
            and not any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces)
            and self.processor.encode(" \n", out_type=int)[1:] == self.processor.encode("\n", out_type=int)[1:]
            and self.processor.encode("") == []
            and self.processor.decode(self.processor.encode(" a  b ")) == " a  b "
        )
        self.mark = [mark]
        self.begin, self.end = self.processor.bos_id(), self.processor.eos_id()
        self.table = ChunkTable(self._segment, limit)

    @classmethod
    def of(cls, model: bytes) -> Codec:
        make_room("sentencepiece", _CODECS.clear)
        if model not in _CODECS:
            _CODECS.clear()
            _CODECS[model] = cls(model)
        return _CODECS[model]

    def _segment(self, chunks: list[str]) -> list[list[int]]:
        """The library puts one mark in front by itself: it replaces a leading mark, or is taken off again."""
        spelled = [c[1:] if c[0] == MARK else c for c in chunks]
        found = self.processor.encode(spelled, num_threads=1)
        return [
            self.mark if c == MARK else ids if c[0] == MARK else ids[1:]
            for c, ids in zip(chunks, found, strict=True)
        ]

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Cuts of a text; with single spaces only, they come without a regular expression."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        if "\0" in text or MARK in text or f"{MARK}{MARK}" in marked:
            return CUTS.findall(marked)
        return marked.replace(MARK, f"\0{MARK}").replace("\n", "\0\n")[1:].split("\0")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.separable:
            bodies = self.table.ids([self.chunks(text) for text in texts])
        else:
            bodies = [np.array(ids, np.int32) for ids in self.processor.encode(texts, num_threads=1)]
        around = [np.array([i] if i >= 0 else [], np.int32) for i in (self.begin, self.end)]
        return [np.concatenate([around[0], body, around[1]]) for body in bodies]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.processor.decode([row.tolist() for row in ids], num_threads=1)

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Encoded lengths with begin and end ids, without putting the ids together."""
        extra = (self.begin >= 0) + (self.end >= 0)
        if not self.separable:
            return np.array([len(ids) + extra for ids in self.processor.encode(texts, num_threads=1)], np.int64)
        return self.table.lengths([self.chunks(text) for text in texts]) + extra


def packed(rows: list[np.ndarray]) -> pa.Array:
    """Ids as little-endian unsigned 32-bit integers."""
    return pa.array([row.astype("<u4").tobytes() for row in rows], pa.binary())


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, ids array<int>`` of every text, with begin and end ids."""
    model = read_model(model_path)
    return map_texts(
        docs, lambda texts: [pa.array(Codec.of(model).encode(texts), pa.list_(pa.int32()))], "ids array<int>"
    )


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text`` of every row of ``doc_id, ids``; null ids give an empty text."""
    model = read_model(model_path)

    def run(batches):
        for batch in batches:
            rows = [np.array(ids or [], np.int32) for ids in batch.column("ids").to_pylist()]
            texts = pa.array(Codec.of(model).decode(rows), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], names=["doc_id", "text"])

    return pick(encoded, doc_id="long", ids="array<int>").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, ids`` (packed, four bytes each) and ``decoded``, the library's text for exactly these ids."""
    model = read_model(model_path)

    def work(texts: list[str]) -> list[pa.Array]:
        codec = Codec.of(model)
        rows = codec.encode(texts)
        return [packed(rows), pa.array(codec.decode(rows), pa.string())]

    return map_texts(docs, work, "ids binary, decoded string")


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Number of ids and checksums of ids and decoded text of every document."""
    return round_trip(docs, model_path).select(
        "doc_id",
        F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
