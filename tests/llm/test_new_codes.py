"""Rank-queue encoding, alignment of two tokenizers and vector codes, against plain versions."""

import base64
import collections
import hashlib
import math
import random

import numpy as np
import pytest
import sentencepiece
import tiktoken
from public_tokenizers import PATTERN
from tokenizers import Tokenizer

from luxframe.llm import queries, rank_queue_bpe, token_alignment, vector_codes

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def codec():
    return rank_queue_bpe.RankCodec(rank_queue_bpe.read_ranks(queries.RANKS), PATTERN, limit=300)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def encoded(codec, texts):
    ids, numbers = codec.encode(texts)
    return [part.tolist() for part in np.split(ids, np.cumsum(numbers)[:-1])] if texts else []


def test_rank_queue_gives_the_ids_of_the_library(codec, library):
    random.seed(5)
    letters = "ab'sStT  \n\t \x1c\x85\xa0　é1٣.,!?<|endoftext|>▁՘꟎\U000323b0\x00字漢😀'rell"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 30))) for _ in range(6000)]
    for start in range(0, len(texts), 500):
        part = texts[start : start + 500]
        assert encoded(codec, part) == [library.encode_ordinary(text) for text in part]


def test_very_long_pretokens(codec, library):
    random.seed(6)
    texts = ["".join(random.choice("abcdeéo") for _ in range(60_000)), "a" * 50_001, "the" * 9000, "!?" * 7000, "x"]
    assert encoded(codec, texts) == [library.encode_ordinary(text) for text in texts]


def test_ranks_below_their_parts():
    """A file that ranks a longer token below its parts: the rest of the pre-token waits."""
    ranks = {bytes([b]): b + 10 for b in range(256)} | {b"ab": 300, b"aba": 5, b"bb": 400, b"abb": 401}
    file = b"\n".join(base64.b64encode(t) + b" " + str(r).encode() for t, r in ranks.items())
    own = rank_queue_bpe.RankCodec(file, PATTERN)
    other = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    random.seed(7)
    texts = ["".join(random.choice("ab ") for _ in range(random.randint(1, 40))) for _ in range(2000)]
    assert encoded(own, texts) == [other.encode_ordinary(text) for text in texts]


def test_rank_queue_query(prepared, library):
    rows = {r["doc_id"]: r["text"] or "" for r in prepared.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = queries.QUERIES["op11_rank_queue_bpe"](prepared, FOLDER).collect()
    assert len(got) == len(rows)
    for row in got:
        ids = library.encode_ordinary(rows[row["doc_id"]])
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(rows[row["doc_id"]].encode()).hexdigest()


def test_rank_queue_on_odd_rows(odd, empty, library):
    ids = rank_queue_bpe.encode(odd, queries.RANKS, PATTERN)
    want = [(r["doc_id"], library.encode_ordinary(r["text"] or "")) for r in odd.collect()]
    assert [(r["doc_id"], r["ids"]) for r in ids.collect()] == want
    decoded = [bytes(r["decoded"]).decode() for r in rank_queue_bpe.decode(ids, queries.RANKS, PATTERN).collect()]
    assert decoded == [r["text"] or "" for r in odd.collect()]
    assert rank_queue_bpe.digests(empty, queries.RANKS, PATTERN).count() == 0
    nothing = ids.selectExpr("doc_id", "if(doc_id = 1, null, array(-1, 99999999, null)) AS ids")
    assert {bytes(r["decoded"]) for r in rank_queue_bpe.decode(nothing, queries.RANKS, PATTERN).collect()} == {b""}


def plain_alignment(rows):
    """Token by token with dictionaries."""
    a = Tokenizer.from_file(queries.BYTES)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    spelling = token_alignment._byte_spelling()
    held, counts = [], collections.Counter()
    for doc_id, text in rows:
        first = second = ()
        if text:
            first = [(i, bytes(spelling[c] for c in a.id_to_token(i))) for i in a.encode(f" {text}", add_special_tokens=False).ids]
            second = []
            for i in b.encode(text):
                piece = b.id_to_piece(i)
                second.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
            want = f" {text}".encode()
            if b"".join(t for _, t in first) != want or b"".join(t for _, t in second) != want:
                first = second = ()
        groups, links, p, q, x, y = [], [], [], [], 0, 0
        rest = list(second)
        for i, token in first:
            p.append(str(i))
            x += len(token)
            while rest and y + len(rest[0][1]) <= x:
                y += len(rest[0][1])
                q.append(str(rest[0][0]))
                rest.pop(0)
            if x == y:
                groups.append(f"{','.join(p)}|{','.join(q)}")
                links.append((int(p[-1]), int(q[-1])))
                p, q = [], []
        counts.update(links)
        held.append((doc_id, len(first), len(second), links, ";".join(groups)))
    most = collections.Counter()
    for (_, right), n in counts.items():
        most[right] = max(most[right], n)
    out = []
    for doc_id, n_a, n_b, links, groups in held:
        best = sum(counts[link] == most[link[1]] for link in links)
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        out.append((doc_id, n_a, n_b, len(links), len(links), best, sum(counts[link] for link in links), digest))
    return sorted(out, key=repr)


FIELDS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def found_alignment(df):
    return sorted((tuple(r[f] for f in FIELDS) for r in df.collect()), key=repr)


def test_alignment_query(prepared):
    rows = [(r["doc_id"], r["text"]) for r in prepared.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert found_alignment(queries.QUERIES["op12_token_alignment"](prepared, FOLDER)) == plain_alignment(rows)


def test_alignment_on_odd_rows(odd, empty, documents):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert found_alignment(token_alignment.digests(odd, queries.BYTES, queries.PIECES)) == plain_alignment(rows)
    assert token_alignment.digests(empty, queries.BYTES, queries.PIECES).count() == 0
    random.seed(8)
    parts = ["a", "Ha", " ", "  ", "\n", "▁", "é", "\t", "ñ漢", "<s>", "<|endoftext|>", "...", "the", "\xa0", "'s", "12", "😀"]
    texts = [(k, "".join(random.choice(parts) for _ in range(random.randint(0, 9)))) for k in range(3000)]
    got = found_alignment(token_alignment.digests(documents(texts), queries.BYTES, queries.PIECES))
    assert got == plain_alignment(texts)


def test_tree_sum_has_several_levels(prepared, monkeypatch):
    monkeypatch.setattr(token_alignment, "FAN", 2)
    keys = np.arange(0, 90_000, 3)
    rows = prepared.range(0, 300_000, 1, 7).selectExpr("0 AS part", "(id * 7 % 30000) * 3 AS pair", "id AS n")
    hashed = token_alignment.PerfectHash(keys)
    got = token_alignment.tree_sum(rows, hashed)
    want = np.zeros(30_000, np.int64)
    np.add.at(want, np.arange(300_000) * 7 % 30_000, np.arange(300_000))
    assert np.array_equal(got[hashed.index(keys)], want)


def test_perfect_hash_is_minimal_and_verified():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 50, 50_000))
    hashed = token_alignment.PerfectHash(keys)
    assert sorted(hashed.index(keys).tolist()) == list(range(len(keys)))
    assert set(hashed.index(keys + (1 << 51)).tolist()) == {-1}
    assert token_alignment.PerfectHash(np.zeros(0, np.int64)).index(np.arange(3)).tolist() == [-1] * 3


def test_pairs_are_bounded_by_the_vocabularies(prepared):
    with open(queries.BYTES, encoding="utf-8") as file:
        description = file.read()
    model = token_alignment.read_model(queries.PIECES)
    pair = token_alignment.Pair(description, model)
    counts = token_alignment.pair_counts(prepared.read.parquet(f"{FOLDER}/documents.parquet"), description, model)
    assert pair.separable
    assert len(counts.numbers) <= pair.most_pairs() <= sum(map(len, pair.a_tokens + pair.b_tokens))


def plain_codes(rows, parts, entries, rounds):
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [[math.floor(256 * x) for x in v] for _, v, _ in kept]
    wide = len(whole[0]) // parts
    cut = [[tuple(v[p * wide : (p + 1) * wide]) for p in range(parts)] for v in whole]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0], whole[k]))[:entries]
    books = [[cut[k][p] for k in order] for p in range(parts)]

    def nearest(part, book):
        return min((sum((x - y) ** 2 for x, y in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for step in range(rounds + 1):
        codes = [[nearest(v[p], books[p]) for p in range(parts)] for v in cut]
        if step < rounds:
            for p in range(parts):
                for k in range(len(books[p])):
                    mine = [v[p] for v, c in zip(cut, codes, strict=True) if c[p][1] == k]
                    if mine:
                        books[p][k] = tuple(sum(x) // len(mine) for x in zip(*mine, strict=True))
    errors = [sum(d for d, _ in c) for c in codes]
    labels = collections.Counter()
    for (_, _, label), error in zip(kept, errors, strict=True):
        labels[label] += error
    spelled = ",".join(str(x) for book in books for entry in book for x in entry)
    digest = hashlib.sha256(spelled.encode()).hexdigest()
    return sorted(
        (i, "".join(f"{k:02x}" for _, k in c), e, labels[label], digest)
        for (i, _, label), c, e in zip(kept, codes, errors, strict=True)
    )


def test_vector_codes_against_complete_scans(prepared):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        vector = (rng.integers(-40, 40, 32) / 16).tolist()  # coarse values: many ties
        label = None if i % 3 == 0 else int(i % 5 > 0)
        rows.append((i * 3 % 401, vector, label))
    rows += [rows[5], (900, None, 1), (901, [float("nan")] * 32, 1), (902, [None] * 32, 1), (903, [float("inf")] * 32, 0)]
    df = prepared.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, LABEL_ int")
    want = plain_codes(rows, 16, 64, 2)
    got = vector_codes.digests(df.repartition(7))
    assert sorted(tuple(r) for r in got.collect()) == want


def test_vector_codes_on_odd_rows(prepared):
    schema = "vec_id long, embedding array<float>, label int"
    build = prepared.createDataFrame
    assert vector_codes.digests(build([], schema)).count() == 0
    assert vector_codes.digests(build([(1, None, 1)], schema)).count() == 0
    rows = [(1, [0.5] * 16, 1), (2, [0.5] * 16, 1), (None, [1.0] * 16, None), (3, [1.0] * 8, 1), (4, [1e30] * 16, 2), (0, [], 1)]
    got = {r["vec_id"]: r for r in vector_codes.digests(build(rows, schema)).collect()}
    assert got[1]["code"] == got[2]["code"] == "00" * 16 and got[None]["code"] == "02" * 16
    assert got[3]["code"] is got[4]["code"] is got[0]["code"] is None and got[4]["label_error"] is None
    assert got[1]["label_error"] == 0 and got[1]["error"] == 0


def test_large_components_stay_exact():
    rng = np.random.default_rng(4)
    q = rng.integers(-(1 << 27), 1 << 27, (50, 16))
    books = vector_codes.Codebooks(q[:8].reshape(8, 4, 4).transpose(1, 0, 2).copy(), np.ones((4, 8), bool))
    entry, distance = vector_codes.assign(q, books, None, None)
    for row in range(50):
        for place in range(4):
            part = q[row, place * 4 : place * 4 + 4].tolist()
            far = [sum((x - y) ** 2 for x, y in zip(part, e, strict=True)) for e in books.entries[place].tolist()]
            assert (distance[row, place], entry[row, place]) == min((d, k) for k, d in enumerate(far))
