"""Language identification of code-switched text by a linear-chain conditional random field.

Every word has affix, character n-gram and lexicon features; the label of a word is a language, and learned
transitions tie neighbouring words together.  The field is fitted on a bounded sample of labelled documents
(``PER_LANGUAGE`` documents a language, fewer where that makes more than ``MOST_ROWS``, chosen by a hash of the id).  The
lexicon counts the words of their whole texts in Spark; the stochastic gradient takes ``WINDOWS`` windows of ``WINDOW``
words spread over each whole text.  It runs first with the document's language on every word, then again with the words that the first
fit is sure about, because labelled documents switch languages too.  Prediction runs forward-backward over the
words of the whole text, all documents of a batch side by side, and adds up the marginals weighted by letters.

Null texts and texts without letters are ``und`` with score 0.  Rows without a language are not learned from
but predicted.  Repeated rows get equal results; the result has one row per input row.  Without any labelled
row every text is ``und``.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from luxframe.llm.textual import held_out, make_room, map_texts, pick, ragged, scratch

PER_LANGUAGE = 500
MOST_ROWS = 20_000  # sampled documents of all languages together
BUCKETS = 1 << 15
WINDOW = 32  # words in a training sequence
WINDOWS = 6  # training sequences of one document
UNDETERMINED = "und"
_TABLES: dict[str, Emissions] = {}


def letters_of(word: str) -> str:
    """The letters of a word, lower case."""
    return word.lower() if word.isalpha() else "".join(filter(str.isalpha, word)).lower()


def _bucket(feature: str) -> int:
    return 1 + zlib.crc32(feature.encode()) % (BUCKETS - 1)


def features(word: str, lexicon: dict[str, str]) -> list[int]:
    """Buckets of a lower-case word: the lexicon's opinion, ends, all inner n-grams; 0 where there are none."""
    known = lexicon.get(word)
    found = [_bucket(f"={known}")] if known else []
    n = len(word)
    found += [_bucket(f"<{word[:k]}") for k in range(1, min(n, 4) + 1)]
    found += [_bucket(f">{word[-k:]}") for k in range(1, min(n, 4) + 1)]
    edge = f"^{word}$"
    found += [_bucket(edge[i : i + k]) for i in range(len(edge)) for k in (2, 3) if i + k <= len(edge)]
    return found or [0]


class Slots:
    """Features of words end to end, each word with as many as it has."""

    def __init__(self, words: list[str], lexicon: dict[str, str]):
        sizes, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for first in range(0, len(words), 4096):  # lists of numbers take many times the room of arrays
            held = [features(word, lexicon) if word else [0] for word in words[first : first + 4096]]
            sizes.append(np.fromiter(map(len, held), np.int64, len(held)))
            flat.append(np.fromiter(chain.from_iterable(held), np.int64, int(sizes[-1].sum())))
        self.sizes, self.flat = np.concatenate(sizes), np.concatenate(flat)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def of(self, words: np.ndarray) -> np.ndarray:
        return self.flat[ragged(self.starts[words], self.sizes[words])]

    def sums(self, weights: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
        """Summed weights of each word."""
        words = np.arange(len(self.sizes)) if words is None else words
        sums = [np.zeros((0, weights.shape[1]), weights.dtype)]
        for part in np.array_split(words, len(words) // 4096 + 1):
            if len(part):
                sizes = self.sizes[part]
                sums.append(np.add.reduceat(weights[self.of(part)], np.cumsum(sizes) - sizes))
        return np.concatenate(sums)


@dataclass
class Field:
    """Emission weights per feature bucket and label, log transitions, log start."""

    languages: list[str]
    lexicon: dict[str, str]
    weights: np.ndarray
    moves: np.ndarray
    start: np.ndarray
    name: str


class Emissions(dict):
    """Rows of emission scores of distinct words.

    A worker keeps the first ``limit`` words, nearly all of the frequent ones; later ones are forgotten after
    their batch, and after ``RENEWAL`` times as many the table starts again, in case the texts have changed.
    """

    RENEWAL = 16

    def __init__(self, field: Field, limit: int = 400_000):
        super().__init__()
        self.field, self.limit = field, limit
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.late: list[str] = []
        self.passed = 0
        self.scores = np.zeros((0, len(self.field.languages)), np.float32)
        self.letters = np.zeros(0, np.float32)

    @classmethod
    def of(cls, field: Field) -> Emissions:
        make_room("language_id", _TABLES.clear)
        if field.name not in _TABLES:
            _TABLES.clear()
            _TABLES[field.name] = cls(field)
        return _TABLES[field.name]

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self.scores) + len(self.fresh)
        self.fresh.append(word)
        if code >= self.limit:
            self.late.append(word)
        return code

    def _trim(self) -> None:
        self.passed += len(self.late)
        if self.passed > self.RENEWAL * self.limit:
            self._forget()
        for word in self.late:
            del self[word]
        if self.late:
            self.scores, self.letters, self.late = self.scores[: self.limit], self.letters[: self.limit], []

    def codes(self, texts: list[str]) -> list[np.ndarray]:
        self._trim()
        split = [text.split() for text in texts]
        found = [np.fromiter(map(self.__getitem__, words), np.int64, len(words)) for words in split]
        if self.fresh:
            plain = [letters_of(word) for word in self.fresh]
            scores = Slots(plain, self.field.lexicon).sums(self.field.weights)
            self.scores = np.concatenate([self.scores, scores]).astype(np.float32)
            self.letters = np.concatenate([self.letters, np.array([len(w) for w in plain], np.float32)])
            self.fresh = []
        return found


def forward_backward(codes: list[np.ndarray], scores: np.ndarray, field: Field) -> tuple[np.ndarray, ...]:
    """Marginals of every word of every sequence.

    Sequences lie side by side, longest first; row ``first[t] + rank`` belongs to word ``t`` of the sequence
    with that rank, so each step handles all sequences that reach it.  Gives the marginals, the sequence
    and the table row of each of their rows, and the forward probabilities.
    """
    sizes = np.array([len(c) for c in codes])
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # sequences longer than t
    first = np.cumsum(active) - active
    step = ragged(np.zeros(len(sizes), np.int64), sizes)
    rank = np.repeat(np.arange(len(sizes)), sizes)
    place = first[step] + rank if longest else step
    words, owner = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    if longest:
        words[place], owner[place] = np.concatenate([codes[i] for i in order]), order[rank]
    raw = scores[words].astype(np.float64)
    likely = np.exp(raw - raw.max(1, keepdims=True)) if len(raw) else raw
    moves, back = np.exp(field.moves), np.exp(field.moves).T
    alpha, beta = np.empty_like(likely), np.ones_like(likely)
    state = np.exp(field.start)
    for t in range(longest):
        rows = slice(first[t], first[t] + active[t])
        state = (state[: active[t]] @ moves if t else state) * likely[rows]
        state /= state.sum(1, keepdims=True)
        alpha[rows] = state
    for t in range(longest - 1, 0, -1):
        rows = slice(first[t], first[t] + active[t])
        behind = (likely[rows] * beta[rows]) @ back
        beta[first[t - 1] : first[t - 1] + active[t]] = behind / behind.sum(1, keepdims=True)
    beta *= alpha
    if len(beta):
        beta /= beta.sum(1, keepdims=True)
    return beta, owner, words, alpha


# --- fitting on the bounded sample ---------------------------------------------------------------


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """``lang, text, share`` of about ``per_language`` labelled documents of each language, about ``MOST_ROWS`` in all."""
    rows = pick(docs, doc_id="long", lang="string", text="string").where("lang is not null and text is not null")
    rows = rows.where(~held_out())
    sizes = scratch(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    wanted = min(per_language, MOST_ROWS / max(sizes.count(), 1))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0
    drawn = rows.join(sizes, "lang").where(share * F.col("n") < wanted)
    return drawn.select("lang", "text", share.alias("share")).orderBy("share", "lang", "text").limit(2 * MOST_ROWS)


def _windows(words: list[str]) -> list[list[str]]:
    """``WINDOWS`` stretches of ``WINDOW`` words, spread over all words."""
    starts = range(0, max(len(words) - WINDOW, 0) + 1, WINDOW)
    chosen = starts if len(starts) <= WINDOWS else [starts[i * len(starts) // WINDOWS] for i in range(WINDOWS)]
    return [words[s : s + WINDOW] for s in chosen if words]


def sampled_pieces(rows: DataFrame) -> DataFrame:
    """``lang, share, windows, words, counts`` of whole texts: training windows, and distinct words with their counts."""
    kinds = [pa.list_(pa.list_(pa.string())), pa.list_(pa.string()), pa.list_(pa.int64())]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                words = [w for w in map(letters_of, batch.column("text")[i].as_py().split()) if w]
                counts = Counter(words)
                made = [_windows(words), list(counts), list(counts.values())]
                own = [batch.column(k).slice(i, 1) for k in ("lang", "share")]
                made = [pa.array([value], kind) for value, kind in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*own, *made], names=["lang", "share", "windows", "words", "counts"])

    schema = "lang string, share double, windows array<array<string>>, words array<string>, counts array<long>"
    return rows.mapInArrow(run, schema)


def lexicon_of(pieces: DataFrame) -> DataFrame:
    """``word, lang`` of words seen three times or more, nine times in ten in one language."""
    seen = pieces.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("seen"))
    counts = seen.groupBy(F.col("seen.words").alias("word"), "lang").agg(F.sum("seen.counts").alias("n"))
    best = counts.groupBy("word").agg(
        F.sum("n").alias("total"), F.max("n").alias("most"), F.max_by("lang", F.struct("n", "lang")).alias("lang")
    )
    return best.where("total >= 3 and 10 * most >= 9 * total").select("word", "lang")


def _epochs(field: Field, slots: Slots, sequences: list, gold: list, random: np.random.Generator, epochs: int) -> None:
    """AdaGrad on the conditional log-likelihood; gold labels below zero are left open."""
    labels = len(field.languages)
    seen = [np.full_like(p, 1e-2) for p in (field.weights, field.moves, field.start)]
    for _ in range(epochs):
        for part in np.array_split(random.permutation(len(sequences)), len(sequences) // 64 + 1):
            if not len(part):
                continue
            batch = [sequences[i] for i in part]
            used, inverse = np.unique(np.concatenate(batch), return_inverse=True)
            cuts = np.cumsum([len(b) for b in batch])[:-1]
            local = np.split(inverse, cuts)
            scores = slots.sums(field.weights, used)
            marginals, owner, words, alpha = forward_backward(local, scores, field)
            order = np.argsort(owner, kind="stable")  # rows of a sequence in time order
            wanted = np.concatenate([gold[i] for i in part])
            known = wanted >= 0
            target = np.zeros((len(wanted), labels))
            target[np.flatnonzero(known), wanted[known]] = 1
            gap = np.where(known[:, None], target - marginals[order], 0)
            word_gap = np.zeros((len(used), labels))
            np.add.at(word_gap, words[order], gap)
            slope = np.zeros_like(field.weights)
            at, sizes = slots.of(used), slots.sizes[used]
            for k in range(labels):
                slope[:, k] = np.bincount(at, np.repeat(word_gap[:, k], sizes), BUCKETS)
            slope[0] = 0
            firsts = np.concatenate([[0], cuts])
            inner = np.ones(len(wanted), bool)
            inner[firsts] = False
            pair = known & np.roll(known, 1) & inner
            seen_moves = np.zeros_like(field.moves)
            np.add.at(seen_moves, (np.roll(wanted, 1)[pair], wanted[pair]), 1)
            expected = _expected_moves(marginals[order], alpha[order], field, pair)
            slopes = [slope - 1e-3 * field.weights, seen_moves - expected, gap[firsts].sum(0)]
            for values, total, change in zip((field.weights, field.moves, field.start), seen, slopes, strict=True):
                total += change**2
                values += 0.3 * change / np.sqrt(total)


def _expected_moves(marginals: np.ndarray, alpha: np.ndarray, field: Field, pair: np.ndarray) -> np.ndarray:
    """Expected transitions into the rows ``pair`` from the row before each.

    Given a row's label, the label before has the chance of its forward probability times the transition.
    """
    here = np.flatnonzero(pair)
    joint = alpha[here - 1][:, :, None] * np.exp(field.moves)[None]
    joint *= (marginals[here] / joint.sum(1))[:, None, :]
    return joint.sum(0)


def fit(rows: list[tuple[str, list[list[str]]]], lexicon: dict[str, str], seed: int = 11) -> Field:
    """Field from pairs of a language and training windows of lower-case words."""
    random = np.random.default_rng(seed)
    languages = sorted({lang for lang, _ in rows})
    labels = {lang: k for k, lang in enumerate(languages)}
    vocabulary: dict[str, int] = {}
    sequences, gold = [], []
    for lang, windows in rows:
        for window in windows:
            sequences.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in window], np.int64))
            gold.append(np.full(len(window), labels[lang]))
    slots, k = Slots(list(vocabulary), lexicon), len(languages)
    field = Field(languages, lexicon, np.zeros((BUCKETS, k)), np.zeros((k, k)), np.zeros(k), "")
    if sequences:
        field.moves += 2 * np.eye(k)
        _epochs(field, slots, sequences, gold, random, 2)
        scores = slots.sums(field.weights)
        marginals, owner, _, _ = forward_backward(sequences, scores, field)
        order = np.argsort(owner, kind="stable")
        cuts = np.cumsum([len(s) for s in sequences])[:-1]
        sure = np.where(marginals.max(1) >= 0.9, marginals.argmax(1), -1)[order]
        _epochs(field, slots, sequences, np.split(sure, cuts), random, 2)
    field.weights = field.weights.astype(np.float32)
    field.name = f"{zlib.crc32(field.weights.tobytes())}-{'/'.join(languages)}"
    return field


def learn(docs: DataFrame) -> Field:
    pieces = scratch(sampled_pieces(training_rows(docs)))
    drawn = pieces.select("lang", "windows", "share").orderBy("share", "lang", "windows")
    shared: dict[str, str] = {}  # one string a word: the driver holds all windows
    rows = [
        (row["lang"], [[shared.setdefault(word, word) for word in window] for window in row["windows"]])
        for row in drawn.toLocalIterator()
    ]
    known = lexicon_of(pieces).orderBy("word", "lang").toLocalIterator()
    return fit(rows, {row["word"]: row["lang"] for row in known})


# --- prediction ----------------------------------------------------------------------------------


def identify(docs: DataFrame, field: Field, keep: dict[str, str] | None = None) -> DataFrame:
    """``keep`` (``doc_id``), ``lang_pred`` and ``score`` of every row, from its text alone."""

    def work(texts: list[str]) -> list[pa.Array]:
        totals = np.zeros((len(texts), max(len(field.languages), 1)))
        if field.languages:
            table = Emissions.of(field)
            codes = table.codes(texts)
            marginals, owner, words, _ = forward_backward(codes, table.scores, field)
            weight = table.letters[words]
            for k in range(len(field.languages)):
                totals[:, k] = np.bincount(owner, marginals[:, k] * weight, len(texts))
        whole, best = totals.sum(1), totals.argmax(1)
        named = [field.languages[b] if w > 0 else UNDETERMINED for b, w in zip(best, whole, strict=True)]
        share = np.divide(totals.max(1), whole, out=np.zeros(len(texts)), where=whole > 0)
        return [pa.array(named, pa.string()), pa.array(np.clip(share, 0, 1))]

    return map_texts(docs, work, "lang_pred string, score double", keep)


def label_words(docs: DataFrame, field: Field) -> DataFrame:
    """``doc_id, words, languages``: each word of the text with its most likely language (``und``: no letters)."""

    def work(texts: list[str]) -> list[pa.Array]:
        table = Emissions.of(field)
        codes = table.codes(texts)
        marginals, owner, words, _ = forward_backward(codes, table.scores, field)
        labels: list[list[str]] = [[] for _ in texts]
        for row in np.argsort(owner, kind="stable"):
            named = field.languages[marginals[row].argmax()] if table.letters[words[row]] else UNDETERMINED
            labels[owner[row]].append(named)
        return [pa.array([t.split() for t in texts], pa.list_(pa.string())), pa.array(labels, pa.list_(pa.string()))]

    return map_texts(docs, work, "words array<string>, languages array<string>")


def predict(docs: DataFrame) -> DataFrame:
    """Learn from the documents outside the held-out fold, then predict all of them."""
    found = identify(docs, learn(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
