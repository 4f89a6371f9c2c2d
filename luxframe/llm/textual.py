"""Shared pieces: exact column choice, Arrow passes over texts, tables of distinct chunks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from luxframe.session import checkpoint_folder, ship_package

WORD_GAPS = "\t\n\x0b\x0c\r "  # what separates words: \x20 and \x09-\x0D
BATCH_ROWS = 1000
SLICE_CHARS = 1_000_000


def prepare(spark: SparkSession) -> None:
    """Make the package importable in workers and keep Arrow batches small: texts may be long."""
    ship_package(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def pick(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns as the given types, chosen by exact name however other columns are spelled."""
    places = {name: df.columns.index(name) for name in kinds}
    plain = df.toDF(*[f"__{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"__{places[name]}").cast(kind).alias(name) for name, kind in kinds.items()])


def exact_place(df: DataFrame, name: str) -> str:
    """Name of a column after ``plain_names``."""
    return f"c{df.columns.index(name)}"


def plain_names(df: DataFrame) -> DataFrame:
    """The same rows with columns ``c0, c1, …``, which no spelling of the given names can clash with."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def carried(docs: DataFrame) -> tuple[DataFrame, str]:
    """``doc_id, text, lang, source`` and the whole row as ``row``, with the type of ``row``.

    A verdict travels beside its row: nothing is joined by id, so rows without an id and repeated ids are judged alike.
    """
    wanted = {name: F.col(exact_place(docs, name)).alias(name) for name in ("doc_id", "text", "lang", "source")}
    plain = plain_names(docs)
    rows = plain.select(F.struct(*plain.columns).alias("row"), *wanted.values())
    return rows, rows.schema["row"].dataType.simpleString()


def released(judged: DataFrame, docs: DataFrame) -> DataFrame:
    """The carried rows under their own names."""
    return judged.select([F.col(f"row.c{i}").alias(f"c{i}") for i in range(len(docs.columns))]).toDF(*docs.columns)


def make_room(owner: str, forget: Callable[[], None]) -> None:
    """Before ``owner`` fills tables of this worker: those of the owner before are forgotten."""
    if owner not in _OWNER:
        for last in _OWNER.values():
            last()
        _OWNER.clear()
        _OWNER[owner] = forget


_OWNER: dict[str, Callable[[], None]] = {}


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """True for rows that are never learned from: crc32 of the id as text divides by ``folds``."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))


def scratch(df: DataFrame) -> DataFrame:
    """Write rows as Parquet to the shared folder and continue from the files."""
    folder = f"{checkpoint_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def slices(texts: list[str], chars: int = SLICE_CHARS) -> Iterator[slice]:
    """Cut a batch so that one slice holds about ``chars`` characters (a longer text stands alone)."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > chars:
            yield slice(first, i)
            first, held = i, 0
        held += len(text)
    if first < len(texts):
        yield slice(first, len(texts))


def map_texts(
    docs: DataFrame,
    work: Callable[[list[str]], list[pa.Array]],
    schema: str,
    keep: dict[str, str] | None = None,
    chars: int = SLICE_CHARS,
) -> DataFrame:
    """One Arrow pass: ``work`` turns a list of texts (null: empty) into the arrays of the columns after ``keep``.

    A list holds about ``chars`` characters, or one longer text.
    """
    keep = {"doc_id": "long"} if keep is None else keep
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text or "" for text in batch.column("text").to_pylist()]
            for part in slices(texts, chars):
                held = [batch.column(k).slice(part.start, part.stop - part.start) for k in keep]
                yield pa.RecordBatch.from_arrays([*held, *work(texts[part])], names=[*keep, *names])

    declared = ", ".join([*(f"{k} {v}" for k, v in keep.items()), schema])
    return pick(docs, **keep, text="string").mapInArrow(run, declared)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the runs ``starts[i] .. starts[i] + sizes[i] - 1``, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class ChunkTable(dict):
    """Distinct chunks of text, each segmented once, with the ids of all of them end to end.

    ``segment`` turns a list of new chunks into a list of id lists, or into all ids end to end and their numbers.  The first ``limit`` chunks are
    remembered, which are nearly all of the frequent ones; later ones are forgotten after their batch, and
    after ``RENEWAL`` times ``limit`` of those the table starts again, in case the texts have changed.
    """

    RENEWAL = 16

    def __init__(self, segment: Callable[[list], list], limit: int = 400_000):
        super().__init__()
        self.segment, self.limit = segment, limit
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.fresh: list = []
        self.late: list = []
        self.passed = 0
        self.starts = self.sizes = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def __missing__(self, chunk) -> int:
        code = self[chunk] = len(self.starts) + len(self.fresh)
        self.fresh.append(chunk)
        if code >= self.limit:
            self.late.append(chunk)
        return code

    def _trim(self) -> None:
        """Forget the chunks beyond the limit."""
        self.passed += len(self.late)
        if self.passed > self.RENEWAL * self.limit:
            self._forget()
        for chunk in self.late:
            del self[chunk]
        if self.late:
            self.flat = self.flat[: self.starts[self.limit]].copy()
            self.starts, self.sizes = self.starts[: self.limit].copy(), self.sizes[: self.limit].copy()
            self.late = []

    def codes(self, documents: list[list]) -> list[np.ndarray]:
        """Table rows of the chunks of each document, valid until the next batch."""
        self._trim()
        found = [np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks)) for chunks in documents]
        if self.fresh:
            new = self.segment(self.fresh)
            if isinstance(new, tuple):
                ids, sizes = new
            else:
                sizes = np.fromiter(map(len, new), np.int64, len(new))
                ids = np.fromiter(chain.from_iterable(new), np.int32, int(sizes.sum()))
            starts = len(self.flat) + np.cumsum(sizes) - sizes
            self.flat = np.concatenate([self.flat, ids])
            self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes])
            self.fresh = []
        return found

    def ids(self, documents: list[list]) -> list[np.ndarray]:
        """Ids of each document, joined back by position."""
        return [self.flat[ragged(self.starts[c], self.sizes[c])] for c in self.codes(documents)]

    def flat_ids(self, documents: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents end to end, and the number of each."""
        codes = self.codes(documents)
        numbers = np.array([int(self.sizes[c].sum()) for c in codes], np.int64)
        joined = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        return self.flat[ragged(self.starts[joined], self.sizes[joined])], numbers

    def lengths(self, documents: list[list]) -> np.ndarray:
        return np.array([int(self.sizes[c].sum()) for c in self.codes(documents)], np.int64)
