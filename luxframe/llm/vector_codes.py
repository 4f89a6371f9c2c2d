"""Vector codes by product quantisation, with active-entry Lloyd rounds in whole numbers.

A component x becomes ``floor(256 x)``; a vector is cut into ``PARTS`` equal parts, and each place has a codebook of
``ENTRIES`` entries, at first that part of the kept vectors of smallest id.  A round assigns every part to its nearest
entry (squared distance, ties to the lower index) and moves each entry to the floored mean of its parts; entries
without parts stay.

After the first round the table of vectors holds each part's entry and exact distance.  If that entry has not moved, all
entries that have not moved either are as far away as before and cannot win, so the part is compared with the moved
entries alone; any other part is compared with all entries.  Distances are whole numbers and exact, so both ways give
the entry that a complete scan gives, ties included.

Work is one Arrow pass a round over a stored table, with partial sums of one row per place, entry and batch; the driver
holds the codebooks (``PARTS`` x ``ENTRIES`` rows, whatever the number of vectors).

Vectors that are null or hold null or non-finite components are dropped.  Vectors whose width differs from that of the
smallest id, or does not divide into ``PARTS``, or with components beyond 2^20 in size cannot be coded exactly: they stay
with null code and error and teach nothing.  Equal ids are ordered by their vectors, null ids come last.  Fewer vectors
than ``ENTRIES`` give as many entries; repeated rows are coded alike and count as often as they occur.  An empty
table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from luxframe.llm.textual import pick, scratch

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LARGEST = 1 << 28  # of a scaled component: distances stay below 2^63
SALTS = 64  # a label's rows meet its sum in so many parts
STATE = "vec_id long, label int, q array<int>, entry binary, distance binary"


@dataclass
class Codebooks:
    """``entries[place, index, component]`` and which of them the last update moved."""

    entries: np.ndarray
    moved: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def update(self, sums: dict[tuple[int, int], tuple[list[int], int]]) -> Codebooks:
        """Floored means of the parts of each entry; whole numbers of any size."""
        entries = self.entries.copy()
        for (place, index), (total, count) in sums.items():
            entries[place, index] = [int(t) // count for t in total]
        return Codebooks(entries, (entries != self.entries).any(axis=2))


def _distances(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows x entries) in floating point where every step is exact, else in integers."""
    size = max(np.abs(parts).max(initial=0), np.abs(entries).max(initial=0))
    if parts.shape[1] * 4 * int(size) ** 2 < 1 << 53:
        a, b = parts.astype(np.float64), entries.astype(np.float64)
        return (a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)
    return sum((parts[:, k, None] - entries[None, :, k]) ** 2 for k in range(parts.shape[1]))


def assign(q: np.ndarray, books: Codebooks, entry: np.ndarray | None, distance: np.ndarray | None):
    """Nearest entry and distance of every part of the vectors ``q`` (rows x components), given those of the last round."""
    places, _, wide = books.entries.shape
    new_entry = np.zeros((len(q), places), np.uint8)
    new_distance = np.zeros((len(q), places), np.int64)
    for place in range(places):
        parts, entries = q[:, place * wide : (place + 1) * wide], books.entries[place]
        if entry is None:
            rescan = np.arange(len(q))
        else:
            held, near = entry[:, place].copy(), distance[:, place].copy()
            moved = books.moved[place]
            fixed = np.flatnonzero(~moved[held])
            rescan = np.flatnonzero(moved[held])
            active = np.flatnonzero(moved)
            if len(fixed) and len(active):
                found = _distances(parts[fixed], entries[active])
                best = found.argmin(1)
                far, index = found[np.arange(len(fixed)), best].astype(np.int64), active[best]
                wins = (far < near[fixed]) | ((far == near[fixed]) & (index < held[fixed]))
                held[fixed[wins]], near[fixed[wins]] = index[wins], far[wins]
            new_entry[:, place], new_distance[:, place] = held, near
        if len(rescan):
            found = _distances(parts[rescan], entries)
            best = found.argmin(1)
            new_entry[rescan, place] = best
            new_distance[rescan, place] = found[np.arange(len(rescan)), best].astype(np.int64)
    return new_entry, new_distance


def kept_vectors(embeddings: DataFrame) -> DataFrame:
    """``vec_id, label, q``: whole components of the rows that are not dropped; ``q`` is null where a size is too large."""
    rows = pick(embeddings, vec_id="long", embedding="array<double>", label="int")
    sound = F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    small = F.forall("embedding", lambda x: F.abs(x) < LARGEST / SCALE)
    whole = F.transform("embedding", lambda x: F.floor(x * SCALE).cast("int"))
    return rows.where(sound).select("vec_id", "label", F.when(small, whole).alias("q"))


def first_codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks | None:
    """Parts of the vectors of smallest id that share the width of the first; none if nothing can be coded."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("q")]
    fit = kept.where(F.col("q").isNotNull() & (F.size("q") > 0) & (F.size("q") % parts == 0))
    head = fit.orderBy(*order).select("q").limit(1).collect()
    if not head:
        return None
    wide = len(head[0]["q"])
    rows = fit.where(F.size("q") == wide).orderBy(*order).select("q").limit(entries).collect()
    table = np.array([row["q"] for row in rows], np.int64).reshape(len(rows), parts, wide // parts).transpose(1, 0, 2)
    return Codebooks(table.copy(), np.ones(table.shape[:2], bool))


def _matrix(batch: pa.RecordBatch, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the batch that can be coded, and their components."""
    numbers = pc.fill_null(pc.list_value_length(batch.column("q")), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(numbers == wide)
    flat = pc.list_flatten(batch.column("q").take(pa.array(rows))).to_numpy(zero_copy_only=False)
    return rows, flat.astype(np.int64).reshape(len(rows), wide)


def _blobs(column: pa.Array, rows: np.ndarray, kind: str, places: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.take(pa.array(rows)).to_pylist()), kind).reshape(len(rows), places)


def _spread(values: np.ndarray, rows: np.ndarray, total: int, kind: pa.DataType) -> pa.Array:
    """Values of some rows in a column of all rows, null elsewhere."""
    out: list = [None] * total
    for row, value in zip(rows.tolist(), values, strict=True):
        out[row] = value.tobytes() if isinstance(value, np.ndarray) else value
    return pa.array(out, kind)


def with_assignments(vectors: DataFrame, books: Codebooks, first: bool) -> DataFrame:
    """``STATE`` rows: every vector with the entry (one byte a part) and the distance (eight bytes) of each part."""
    places, _, part = books.entries.shape

    def run(batches):
        for batch in batches:
            rows, q = _matrix(batch, places * part)
            before = (None, None)
            if not first:
                before = (_blobs(batch.column("entry"), rows, "u1", places), _blobs(batch.column("distance"), rows, "<i8", places))
            entry, distance = assign(q, books, *before)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(name) for name in ("vec_id", "label", "q")),
                    _spread(entry, rows, batch.num_rows, pa.binary()),
                    _spread(distance.astype("<i8"), rows, batch.num_rows, pa.binary()),
                ],
                names=["vec_id", "label", "q", "entry", "distance"],
            )

    return vectors.mapInArrow(run, STATE)


def part_sums(state: DataFrame, books: Codebooks) -> dict[tuple[int, int], tuple[list[int], int]]:
    """Sum of the parts and their number for every place and entry in use."""
    places, entries, part = books.entries.shape
    names = [f"s{k}" for k in range(part)]

    def run(batches):
        slots = places * entries
        total, count = np.zeros((slots, part), np.int64), np.zeros(slots, np.int64)
        seen = 0

        def out():
            used = np.flatnonzero(count)
            columns = [used // entries, used % entries, count[used], *(total[used, k] for k in range(part))]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["place", "entry", "n", *names])

        for batch in batches:
            rows, q = _matrix(batch, places * part)
            held = _blobs(batch.column("entry"), rows, "u1", places).astype(np.int64) + np.arange(places) * entries
            count += np.bincount(held.ravel(), minlength=slots)
            np.add.at(total, held.ravel(), q.reshape(-1, part))
            seen += len(rows)
            if seen > 1 << 30:  # far below the 2^34 rows at which sums of 2^28 could overflow
                yield out()
                total[:], count[:], seen = 0, 0, 0
        yield out()

    schema = ", ".join(f"{name} long" for name in ["place", "entry", "n", *names])
    sums = [F.sum(F.col(name).cast("decimal(38,0)")).alias(name) for name in ["n", *names]]
    rows = state.select("q", "entry").where("entry IS NOT NULL").mapInArrow(run, schema).groupBy("place", "entry").agg(*sums)
    return {(r["place"], r["entry"]): ([r[name] for name in names], int(r["n"])) for r in rows.collect()}


def learn_codes(
    embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, Codebooks | None]:
    """``STATE`` rows under the final codebooks, and these codebooks (none if no vector can be coded)."""
    if not 0 < entries <= 256:
        raise ValueError("an index has to fit one byte")
    kept = scratch(kept_vectors(embeddings))
    books = first_codebooks(kept, parts, entries)
    if books is None:
        nothing = F.lit(None).cast("binary")
        return kept.withColumns({"entry": nothing, "distance": nothing}), None
    state = scratch(with_assignments(kept, books, first=True))
    for place in range(rounds):
        books = books.update(part_sums(state, books))
        state = with_assignments(state, books, first=False)
        if place + 1 < rounds:
            state = scratch(state)
    return state, books


def encoded(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, label, code, error, codebooks_sha256`` of every kept vector."""
    state, books = learn_codes(embeddings, parts, entries, rounds)

    def run(batches):
        for batch in batches:
            errors = [
                None if held is None else int(np.frombuffer(held, "<i8").sum()) for held in batch.column("distance").to_pylist()
            ]
            codes = [None if held is None else held.hex() for held in batch.column("entry").to_pylist()]
            arrays = [batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(errors, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "label", "code", "error"])

    coded = state.select("vec_id", "label", "entry", "distance").mapInArrow(run, "vec_id long, label int, code string, error long")
    digest = books.digest() if books else hashlib.sha256(b"").hexdigest()
    return coded.withColumn("codebooks_sha256", F.lit(digest))


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds ``label_error``, the errors of equal labels added up (nulls together).

    Rows meet the sum of their label in ``SALTS`` parts, so a label that holds many rows does not land in one task.
    """
    stored = scratch(coded)
    sums = stored.groupBy("label").agg(F.sum("error").alias("label_error"))
    shared = sums.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("label", "__label")
    salted = stored.withColumn("__salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    same = F.col("label").eqNullSafe(F.col("__label")) & (salted["__salt"] == shared["__salt"])
    return salted.join(shared, same).drop("__salt", "__label")


def digests(embeddings: DataFrame) -> DataFrame:
    """Code, error and the error of the label of every kept vector."""
    columns = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return with_label_errors(encoded(embeddings)).select(*columns)
