"""SentencePiece round trips, length histograms and Arrow sequences against the libraries themselves."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from luxframe.llm import arrow_sequences, queries, sentencepiece_codec, token_lengths
from luxframe.session import checkpoint_folder

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_chunks_give_the_ids_of_the_library(pieces):
    random.seed(3)
    parts = ["a", "Ha", " ", "  ", "\n", "▁", "é", "\0", "\t", "ñ漢", "<s>", "</s>", ".", "the", "thing"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 12))) for _ in range(5000)]
    codec = sentencepiece_codec.Codec(sentencepiece_codec.read_model(queries.PIECES), limit=50)
    assert codec.separable
    for start in range(0, len(texts), 500):
        part = texts[start : start + 500]
        want = pieces.encode(part, add_bos=True, add_eos=True)
        assert [row.tolist() for row in codec.encode(part)] == want
        assert codec.lengths(part).tolist() == [len(row) for row in want]


def test_round_trip_query(prepared, pieces):
    got = {r["doc_id"]: r for r in queries.QUERIES["op1_sentencepiece"](prepared, FOLDER).collect()}
    rows = prepared.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(got) == len(rows)
    for row in rows:
        ids = pieces.encode(row["text"] or "", add_bos=True, add_eos=True)
        found = got[row["doc_id"]]
        assert found["n_tokens"] == len(ids)
        assert found["ids_sha256"] == hashlib.sha256(packed(ids)).hexdigest()
        assert found["decoded_sha256"] == hashlib.sha256(pieces.decode(ids).encode()).hexdigest()


def test_odd_texts_encode_and_decode(odd, empty, pieces):
    encoded = sentencepiece_codec.encode(odd, queries.PIECES)
    for row, ids in zip(odd.collect(), encoded.collect(), strict=True):
        assert ids["ids"] == pieces.encode(row["text"] or "", add_bos=True, add_eos=True)
    decoded = sentencepiece_codec.decode(encoded, queries.PIECES).collect()
    assert [r["text"] for r in decoded] == [pieces.decode(r["ids"]) for r in encoded.collect()]
    assert sentencepiece_codec.digests(empty, queries.PIECES).count() == 0


def test_length_histogram_answers_every_limit(prepared, pieces):
    docs = prepared.read.parquet(f"{FOLDER}/documents.parquet")
    lengths = sorted(len(pieces.encode(r["text"] or "")) + 2 for r in docs.collect())
    sums = queries.QUERIES["op7_token_lengths"](prepared, FOLDER).cache()
    for row in sums.collect():
        limit = row["n_tokens"]
        assert row["n_docs"] == lengths.count(limit)
        assert row["docs_from"] == sum(n >= limit for n in lengths)
        assert row["docs_upto"] == sum(n <= limit for n in lengths)
        assert row["tokens_from"] == sum(n for n in lengths if n >= limit)
        assert row["total_tokens"] == sum(lengths)
        assert row["truncated_tokens"] == sum(min(n, limit) for n in lengths)
    for limit in (0, 1, 100, 333, 10**6):
        got = token_lengths.at_limit(sums, limit).first()
        assert got["truncated_tokens"] == sum(min(n, limit) for n in lengths)
    for share in (0.1, 0.5, 0.9, 1.0):
        want = lengths[max(int(np.ceil(share * len(lengths))), 1) - 1]
        assert token_lengths.quantile(sums, share).first()["n_tokens"] == want


def test_length_histogram_of_nothing(empty):
    lengths = token_lengths.encoded_lengths(empty, queries.PIECES)
    sums = token_lengths.with_suffix_sums(token_lengths.histogram(lengths))
    assert sums.count() == 0
    assert token_lengths.at_limit(sums, 10).first()["truncated_tokens"] == 0


def test_byte_chunks_give_the_ids_of_the_library():
    random.seed(4)
    parts = ["a", "Ha", " ", "  ", "\n", "\t", "é", "\x1c", "　", "12", "don't", "<|endoftext|>", "!?", "漢"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 12))) for _ in range(4000)]
    encoder = arrow_sequences.ByteEncoder(arrow_sequences.read_tokenizer(queries.BYTES), limit=50)
    library = Tokenizer.from_file(queries.BYTES)
    for start in range(0, len(texts), 400):
        part = texts[start : start + 400]
        want = [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
        assert [row.tolist() for row in encoder.encode(part)] == want


def test_chunks_of_equal_hash_are_told_apart(monkeypatch):
    ones = lambda n: (np.ones(n, np.uint64), np.ones(n, np.uint64))
    monkeypatch.setattr(arrow_sequences, "_powers", ones)
    texts = ["dog god, (god) dog.\ngod <|endoftext|>odg", "", " ", "ogd.", "dog god"]
    chunks, which, numbers = arrow_sequences.ByteEncoder.runs(texts)
    assert len(set(chunks)) == len(chunks) and "".join(chunks[c] for c in which) == "".join(texts)
    assert numbers.tolist() == [9, 0, 1, 2, 2] and {" god", ",", " dog", ".", "\n", "god"} <= set(chunks)
    encoder = arrow_sequences.ByteEncoder(arrow_sequences.read_tokenizer(queries.BYTES))
    want = Tokenizer.from_file(queries.BYTES).encode_batch(texts, add_special_tokens=False)
    assert [row.tolist() for row in encoder.encode(texts)] == [e.ids for e in want]


def test_sequence_query(prepared):
    library = Tokenizer.from_file(queries.BYTES)
    rows = sorted(prepared.read.parquet(f"{FOLDER}/documents.parquet").collect(), key=lambda r: r["doc_id"])
    got = {r["doc_id"]: r for r in queries.QUERIES["op9_arrow_sequences"](prepared, FOLDER).collect()}
    start = 0
    for row in rows:
        ids = [*library.encode(row["text"] or "", add_special_tokens=False).ids, 0]
        found = got[row["doc_id"]]
        assert (found["start"], found["n_tokens"], found["ids_crc32"]) == (start, len(ids), zlib.crc32(packed(ids)))
        start += len(ids)
    assert len(got) == len(rows)


def test_sequences_have_one_length_and_open_at_random(odd, prepared):
    folder = f"{checkpoint_folder(prepared)}/sequences-test"
    manifest = arrow_sequences.write_sequences(odd, folder, queries.BYTES, length=8, shards=2)
    total = 0
    for shard in manifest.collect():
        with pa.memory_map(shard["ids_path"]) as source:
            batches = list(pa.ipc.open_stream(source))
        assert all(b.schema.field("ids").type.list_size == 8 for b in batches)
        flat = np.concatenate([b.column("ids").flatten().to_numpy() for b in batches])
        mask = np.concatenate([b.column("mask").flatten().to_numpy(zero_copy_only=False) for b in batches])
        assert mask.sum() == shard["n_ids"] and mask[: shard["n_ids"]].all()
        for row in (0, len(flat) // 16, len(flat) // 8 - 1):
            ids, held = arrow_sequences.read_sequence(shard["ids_path"], row)
            assert ids.tolist() == flat[row * 8 : row * 8 + 8].tolist()
            assert held.tolist() == mask[row * 8 : row * 8 + 8].tolist()
        total += shard["n_docs"]
    assert total == odd.count()
    read = arrow_sequences.read_documents(manifest).orderBy("start").collect()
    library = Tokenizer.from_file(queries.BYTES)
    want = sorted(odd.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    for row, found in zip(want, read, strict=True):
        ids = [*library.encode(row["text"] or "", add_special_tokens=False).ids, 0]
        assert found["doc_id"] == row["doc_id"] and bytes(found["ids"]) == packed(ids)


def test_sequences_of_nothing(empty):
    assert arrow_sequences.digests(empty, queries.BYTES).count() == 0
