"""Counts over one whole text, used by the quality rules and the quality classifier."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from luxframe.llm.textual import map_texts

SYMBOLS = b"#*$%&|<>"
GAPS = b"\t\n\x0b\x0c\r "
CLASSES = {
    "n_digits": bytes(range(48, 58)),
    "n_bangs": b"!?",
    "n_stops": b".,;:",
    "n_quotes": b"\"'()[]{}",
    "n_marks": b"@/\\=_+~^`-",
}
WINDOW = 3
UPPER = bytes(range(65, 91))


def _among(data: bytes, characters: bytes) -> int:
    return len(data) - len(data.translate(None, characters))


def repeated_words(codes: np.ndarray, distinct: int) -> int:
    """Words inside windows of three words that occur twice or more in the text."""
    if len(codes) < WINDOW + 1:
        return 0
    pairs = codes[:-2] * distinct + codes[1:-1]
    if distinct > 2_000_000:  # the product of three codes would not fit
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, place, times = np.unique(pairs * distinct + codes[2:], return_inverse=True, return_counts=True)
    marked = np.zeros(len(codes), bool)
    again = times[place] > 1
    for shift in range(WINDOW):
        marked[shift : len(codes) - WINDOW + 1 + shift] |= again
    return int(marked.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [line for line in text.split("\n") if line.strip("\t\n\x0b\x0c\r ")]
    return len(lines) - len(set(lines))


def base_counts(text: str) -> list[int]:
    """The counts named in ``BASE``."""
    data = text.encode()
    words = data.split()  # bytes split at exactly \x20 and \x09-\x0D
    seen: dict[bytes, int] = {}
    codes = np.array([seen.setdefault(word, len(seen)) for word in words], np.int64)
    return [
        len(words),
        len(text) - _among(data, GAPS),
        _among(data, SYMBOLS),
        duplicate_lines(text),
        repeated_words(codes, len(seen)),
        len(seen),
        _among(data, UPPER),
    ]


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper")


def more_counts(text: str) -> list[float]:
    """Character classes, adjacent equal words, lines, and spread of the word lengths."""
    data = text.encode()
    words = data.split()
    same = sum(map(bytes.__eq__, words, words[1:]))
    sizes = np.fromiter(map(len, words), np.float64, len(words))
    return [
        *(_among(data, characters) for characters in CLASSES.values()),
        same,
        data.count(b"\n") + 1 if data else 0,
        sum(word == b"|" for word in words),
        float(sizes.std()) if len(words) else 0.0,
    ]


MORE = (*CLASSES, "n_same_pairs", "n_lines", "n_bars", "size_spread")


def statistics(docs: DataFrame, more: bool = False, keep: dict[str, str] | None = None) -> DataFrame:
    """One row per document: ``keep`` and the counts (null and empty texts count nothing)."""
    schema = ", ".join([*(f"{n} long" for n in BASE), *((f"{n} double" for n in MORE) if more else ())])

    def work(texts: list[str]) -> list[pa.Array]:
        base = np.array([base_counts(text) for text in texts], np.int64).reshape(-1, len(BASE))
        arrays = [pa.array(column) for column in base.T]
        if more:
            rest = np.array([more_counts(text) for text in texts], np.float64).reshape(-1, len(MORE))
            arrays += [pa.array(column) for column in rest.T]
        return arrays

    return map_texts(docs, work, schema, keep)


