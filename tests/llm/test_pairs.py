"""Similarity join, decontamination and the pipeline against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from luxframe.llm import decontaminate, language_id, ngram_join, quality_rules, queries

FOLDER = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1)))


def brute_components(texts):
    """Smallest id reachable by links, from all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(i for i in texts if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in texts}


@pytest.mark.parametrize("folder", [FOLDER, LARGER])
def test_components_of_the_tables(prepared, folder):
    rows = prepared.read.parquet(f"{folder}/documents.parquet").collect()
    want = brute_components({r["doc_id"]: r["text"] for r in rows})
    got = queries.QUERIES["op6_ngram_join"](prepared, folder).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert len(got) == len(rows)


def edited(words, share, chance):
    return [chance.choice(["x", "y", "z"]) + str(chance.random()) if chance.random() < share else w for w in words]


def test_chains_and_groups_around_the_threshold(documents, monkeypatch):
    """Chains of small edits, a large group of near copies, blocks far smaller than the group."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    chance = random.Random(8)
    base = [f"w{chance.randint(0, 500)}" for _ in range(120)]
    texts, words = {}, base
    for i in range(60):
        texts[i] = " ".join(words)
        words = edited(words, 0.02, chance)
    for i in range(60, 200):
        texts[i] = " ".join(edited(base, 0.02, chance))
    for i in range(200, 240):
        texts[i] = " ".join(edited(base[:50], 0.03, chance))
    for i in range(240, 260):
        texts[i] = " ".join(base[: chance.randint(1, 9)])
    got = ngram_join.link(documents(list(texts.items()))).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(texts)


def test_one_id_with_two_texts_has_the_links_of_both(documents):
    chance = random.Random(9)
    first, second = ([f"{side}{chance.randint(0, 500)}" for _ in range(80)] for side in "ab")
    near = [" ".join([*words[:-1], "other"]) for words in (first, second)]
    rows = [(4, " ".join(first)), (4, " ".join(second)), (3, near[0]), (5, near[1]), (6, "not like the others at all"), (6, "")]
    got = ngram_join.link(documents(rows)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(3, 3), (4, 3), (4, 3), (5, 3), (6, 6), (6, 6)]
    assert sorted(r["doc_id"] for r in ngram_join.one_of_each(documents(rows)).collect()) == [3, 6]
    assert sorted(r["doc_id"] for r in ngram_join.one_of_each(documents([*rows, (5, "")])).collect()) == [3, 6]


def test_a_bucket_with_one_large_component_asks_only_its_strangers(prepared, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    counts = bytearray(np.ones(ngram_join.GROUPS, np.uint16).tobytes())
    rows = [(1, 100, n // 8, n, 0 if n < 796 else n, 256, counts) for n in range(800)]
    names = "key long, blocks long, block long, rep long, component long, n_shingles long, counts binary"
    pairs = ngram_join._block_pairs(prepared.createDataFrame(rows, names), True)
    want = {(min(a, b), max(a, b)) for a in range(796, 800) for b in range(800) if a != b}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    pairs = ngram_join._block_pairs(prepared.createDataFrame(rows, names), True)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want


def test_tree_loses_no_pair_and_passes_over_most(prepared):
    chance = np.random.default_rng(4)
    sets = []
    for _ in range(30):
        base = chance.integers(0, 2**63, 300, dtype=np.uint64)
        sets += [np.unique(np.where(chance.random(300) < 0.03, chance.integers(0, 2**63, 300, dtype=np.uint64), base)) for _ in range(10)]
    tree = ngram_join.CountTree(np.array([ngram_join.counts_of(s) for s in sets]), np.array([len(s) for s in sets]))
    found = {(int(a), int(b)) for q, m in tree.search(np.arange(len(sets))) for a, b in zip(q, m, strict=True)}
    for a in range(len(sets)):
        for b in range(len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                assert (a, b) in found
    assert len(found) < 0.3 * len(sets) ** 2


def test_only_texts_that_share_a_bucket_leave_their_place(prepared, documents):
    """The second pass gives the sets of all asked ids and of next to no others, repeated rows and rows without an id included."""
    rows = [*((n, f"w{n} x{n} y{n} z{n} u{n} v{n}") for n in range(4000)), (7, "again a text"), (None, "no id"), (11, None)]
    asked = prepared.createDataFrame([(n,) for n in range(0, 4000, 40)], "doc_id long")
    sieve = ngram_join.Sieve.of(asked)
    got = Counter(r["doc_id"] for r in ngram_join.sets_of(documents(rows), sieve).collect())
    assert all(got[n] == 1 for n in range(0, 4000, 40)) and None not in got
    assert len(got) < 200
    assert not ngram_join.sets_of(documents(rows), ngram_join.Sieve.of(asked.limit(0))).count()


def test_join_of_odd_rows(odd, empty):
    got = ngram_join.link(odd).collect()
    assert len(got) == odd.count()
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["component_id"] == 1 and by_id[2]["component_id"] == 2 and by_id[3]["n_shingles"] == 0
    assert by_id[None]["component_id"] is None
    assert ngram_join.link(empty).count() == 0
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 8]


def test_longest_common_subsequence():
    chance = random.Random(2)
    for _ in range(200):
        a, b = ([chance.choice("abcd") for _ in range(chance.randint(0, 20))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.common_subsequence(a, b) == table[-1][-1]


def exact_leaks(docs, items):
    """Documents that hold all words of an item in one run."""
    found = set()
    spelled = {i: f" {' '.join(decontaminate.words_of(t))} " for i, t in items.items()}
    for d, text in docs.items():
        words = f" {' '.join(decontaminate.words_of(text or ''))} "
        found |= {(d, i) for i, item in spelled.items() if item in words}
    return found


def test_leaks_of_the_tables(prepared):
    docs = {r["doc_id"]: r["text"] for r in prepared.read.parquet(f"{LARGER}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in prepared.read.parquet(f"{LARGER}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op10_decontaminate"](prepared, LARGER).collect()}
    want = exact_leaks(docs, items)
    assert len(want) > 10 and want <= got
    for d, i in got - want:  # what is reworded still shares most of the item with one stretch of the text
        item, words = decontaminate.words_of(items[i]), decontaminate.words_of(docs[d])
        assert decontaminate.common_subsequence(words, item) >= decontaminate.LCS_WITH_ANSWER * len(item)


def test_paraphrases_are_found_and_clean_texts_left_alone(prepared, documents):
    chance = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    draw = lambda n: [chance.choice(vocabulary) for _ in range(n)]
    items = {i: draw(chance.choice([15, 30, 60])) for i in range(450)}
    rows, planted = [], {}
    for d in range(600):
        words = draw(200)
        if d % 3 == 0:
            item = chance.choice(list(items))
            passage = [w if chance.random() > 0.12 else chance.choice(vocabulary) for w in items[item]]
            at = chance.randint(0, 150)
            words[at:at] = passage
            planted[d] = item
        rows.append((d, " ".join(words)))
    bench = prepared.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(documents(rows), bench).collect()}
    hit = sum((d, i) in got for d, i in planted.items())
    assert hit >= 0.9 * len(planted)
    assert all(d in planted for d, _ in got)


def brute_leaks(docs, items):
    """All documents and items with a passage around which the checks confirm the item."""
    found, width, step = set(), decontaminate.WINDOW, decontaminate.STRIDE
    for d, words in docs.items():
        for i, item in items.items():
            for a in range(0, max(len(words) - width, 0) + step, step):
                around = words[max(a - len(item), 0) : min(a + width, len(words)) + len(item)]
                if decontaminate.confirmed(item, around) is not None:
                    found.add((d, i))
                    break
    return found


def test_no_leak_that_the_checks_confirm_is_left_unasked(prepared, documents):
    """Long and short items, 65% of the words kept, replacements from running text."""
    chance = random.Random(9)
    vocabulary, common = [f"w{i}" for i in range(2000)], [f"c{i}" for i in range(25)]
    draw = lambda n: [chance.choice(common if chance.random() < 0.45 else vocabulary) for _ in range(n)]
    items = {i: draw(chance.choice([6, 15, 30, 60, 150])) for i in range(40)}
    docs, planted = {}, set()
    for d in range(120):
        words, i = draw(chance.choice([20, 90, 300])), chance.randrange(40)
        if d % 3:
            item = items[i]
            kept = set(chance.sample(range(len(item)), round(0.65 * len(item))))
            kept |= set(range(len(item) - max(len(item) // 4, 1), len(item)))
            at = chance.randint(0, len(words))
            words[at:at] = [w if k in kept else draw(1)[0] for k, w in enumerate(item)]
            planted.add((d, i))
        docs[d] = words
    bench = prepared.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    found = decontaminate.find_leaks(documents([(d, " ".join(w)) for d, w in docs.items()]), bench).collect()
    want = brute_leaks(docs, items)
    assert len(planted & want) > 70 and {(r["doc_id"], r["item_id"]) for r in found} == want
    assert min(r["cosine"] for r in found) < 0.4 < max(r["cosine"] for r in found) <= 1.001


def test_candidates_come_from_truncated_axes_of_items_and_passages(prepared, documents, monkeypatch):
    """Fewer axes than items: what is cut off counts into the limit, so that the latent search leaves out no leak."""
    monkeypatch.setattr(decontaminate, "RANK", 12)
    chance = random.Random(5)
    vocabulary, common = [f"w{i}" for i in range(800)], [f"c{i}" for i in range(25)]
    draw = lambda n: [chance.choice(common if chance.random() < 0.45 else vocabulary) for _ in range(n)]
    items = {i: draw(chance.choice([6, 15, 30, 60])) for i in range(40)}
    texts = {d: draw(150) + items[d % 40][: len(items[d % 40]) * (3 + d % 2) // 4] + draw(60) for d in range(60)}
    docs = documents([(d, " ".join(w)) for d, w in texts.items()])
    idf, passages = decontaminate.inverse_frequencies(docs), decontaminate.fitted_passages(docs)
    assert passages.count() > 300 and all(len(r["text"].split()) <= decontaminate.WINDOW for r in passages.collect())
    bench = prepared.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    (lens,) = decontaminate.lenses(bench, idf, passages)
    (alone,) = decontaminate.lenses(bench, idf)
    assert lens.axes.shape[1] == 12 and not np.allclose(np.abs(lens.axes.T @ alone.axes), np.eye(12), atol=0.1)
    assert np.linalg.norm(lens.latent, axis=1).max() < 0.99
    searcher = decontaminate.Searcher(lens, idf)
    words, sizes = decontaminate._SPELLER.words([" ".join(w) for w in texts.values()])
    columns = searcher.columns_of(words, decontaminate.buckets_of(words))
    near = searcher.near(columns, sizes)
    want = brute_leaks(texts, items)
    assert len(want) > 50 and want <= {(d, lens.ids[i]) for d, _, i in near.T.tolist()}
    assert near.shape[1] < 0.5 * len(items) * sum(-(-(n - decontaminate.WINDOW) // decontaminate.STRIDE) + 1 for n in sizes)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()} == want


@pytest.mark.parametrize("cells", [decontaminate.CELLS, 0])
def test_axes_are_fitted_on_all_passages_of_all_documents(prepared, documents, monkeypatch, cells):
    """More documents, and more passages of one, than a sample would take; the products are those of brute force."""
    monkeypatch.setattr(decontaminate, "RANK", 4)
    monkeypatch.setattr(decontaminate, "CELLS", cells)  # 0: pairs are folded part by part
    monkeypatch.setattr(decontaminate, "FOLDED", 500)
    chance = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = {d: [chance.choice(vocabulary[d % 7 :: 7]) for _ in range(chance.choice([7, 40, 64]))] for d in range(700)}
    texts[700] = [chance.choice(vocabulary[k // 200 :: 12]) for k in range(2000)]
    texts[701] = []
    docs = documents([(d, " - ".join(w)) for d, w in texts.items()])
    bench = prepared.createDataFrame([(i, " ".join(vocabulary[i : i + 12])) for i in range(0, 48, 3)], "item_id long, text string")
    passages = []
    for words in texts.values():
        chunks = " - ".join(words).split()
        for a in range(0, max(len(chunks) - decontaminate.WINDOW, 0) + decontaminate.STRIDE if chunks else 0, decontaminate.STRIDE):
            passages.append([c for c in chunks[a : a + decontaminate.WINDOW] if c != "-"])
    spelled = decontaminate.fitted_passages(docs)
    assert sorted(r["text"] for r in spelled.collect()) == sorted(" ".join(p) for p in passages)
    idf = decontaminate.inverse_frequencies(docs)
    (lens,) = decontaminate.lenses(bench, idf, docs)
    weights = decontaminate._weights(lens.columns, idf)
    rows = np.zeros((len(passages), len(lens.columns)))
    for row, words in zip(rows, passages, strict=True):
        at, values = decontaminate._unit(words, lens.columns, weights)
        row[at] = values
    blocks = {r["c"]: r["v"] for r in decontaminate.passage_products(docs, lens.columns, idf).collect()}
    assert np.frombuffer(blocks.pop(decontaminate.NUMBER), np.int64).tolist() == [len(passages)]
    whole = np.concatenate([np.frombuffer(blocks[c], np.float32) for c in sorted(blocks)]).reshape(len(lens.columns), -1)
    assert np.allclose(whole, rows.T @ rows, atol=1e-3)
    (same,) = decontaminate.lenses(bench, idf, spelled)
    assert np.allclose(np.abs(same.axes.T @ lens.axes), np.eye(4), atol=1e-2)


def test_words_are_hashed_as_they_are_compared():
    texts = ["", " \n ", "One, two--three FOUR\u3000漢字 é\u0301", "ΟΔΟΣ Σας İx 𝔘x 𝟘 -- .a.", "x", "a\x1cb \x85 c\n", "ß ẞ ǅ ﬀ"]
    found, sizes = decontaminate._SPELLER.words(texts)
    chunks = [decontaminate.plain(chunk) for text in texts for chunk in text.split()]
    assert sizes.tolist() == [len(text.split()) for text in texts]
    assert found.tolist() == [int(decontaminate.hashes([word])[0]) if word else 0 for word in chunks]
    assert len(set(found.tolist())) == len(set(chunks))


def test_leaks_of_odd_rows(odd, empty, prepared):
    schema = "item_id long, text string, text_ string"
    rows = [(1, "one two three four five six", "x"), (2, None, "x"), (3, "", "x"), (4, "word", "x"), (5, "One, two three four FIVE six", "x")]
    bench = prepared.createDataFrame(rows, schema)
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(odd, bench).collect())
    assert got == [(4, 1), (4, 5)]
    kept = decontaminate.without_leaks(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2
    assert decontaminate.find_leaks(empty, bench).count() == 0
    assert decontaminate.find_leaks(odd, bench.limit(0)).count() == 0


def test_latent_axes_span_the_items(prepared):
    docs = prepared.read.parquet(f"{FOLDER}/documents.parquet")
    idf = decontaminate.inverse_frequencies(docs)
    lenses = list(decontaminate.lenses(prepared.read.parquet(f"{FOLDER}/benchmark.parquet"), idf))
    assert sum(len(lens.ids) for lens in lenses) == 40
    for lens in lenses:
        assert np.allclose(lens.axes.T @ lens.axes, np.eye(lens.axes.shape[1]), atol=1e-3)
        assert np.linalg.norm(lens.latent, axis=1) == pytest.approx(1, abs=1e-3)


def test_pipeline_stages_take_effect(prepared):
    docs = prepared.read.parquet(f"{LARGER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(prepared, docs, LARGER)
        rows = kept.collect()
        assert kept.columns == docs.columns
        ids = {r["doc_id"] for r in rows}
        if name == "language_id":
            found = language_id.predict(docs).collect()
            want = {r["doc_id"] for r in found if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LEAST_LANGUAGE_SCORE}
        elif name == "quality_rules":
            want = {r["doc_id"] for r in quality_rules.judge(docs).collect() if r["kept"]}
        elif name == "ngram_join":
            want = {c for _, c in brute_components({r["doc_id"]: r["text"] for r in docs.collect()}).values()}
        else:
            items = {r["item_id"]: r["text"] for r in prepared.read.parquet(f"{LARGER}/benchmark.parquet").collect()}
            leaking = {d for d, _ in exact_leaks({r["doc_id"]: r["text"] for r in docs.collect()}, items)}
            assert leaking and not leaking & ids
            want = ids
        assert ids == want
        docs = prepared.createDataFrame(rows, docs.schema)
    final = {r["doc_id"] for r in corpus_pipeline.run(prepared, LARGER).collect()}
    assert final == {r["doc_id"] for r in docs.collect()}


def test_pipeline_stages_on_odd_rows(odd, empty, prepared):
    for rows in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(prepared, rows, FOLDER)
            assert out.count() <= rows.count()
            if name != "sentencepiece":
                assert out.columns == rows.columns


def test_counts_help():
    assert Counter(ngram_join.shingle_set("a b c d e f A B C D E").tolist()).most_common(1)[0][1] == 1
    assert len(ngram_join.shingle_set("a b c d e f A B C D E")) == 6


def test_pipeline_stages_judge_rows_not_ids(prepared):
    """Null ids, one id with a good and a bad text, and a column that differs from ``doc_id`` by case alone."""
    good = "The walk along the river was longer than we thought and the evening came before the last bridge. " * 12
    rows = [(k, f"{good} number {k}", "en", "s", 1, "x") for k in range(40)]
    rows += [(None, good, "en", "s", 1, "x"), (7, "1 2 3", "en", "s", 1, "bad"), (None, "4 5 6", "en", "s", 1, "bad")]
    docs = prepared.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, DOC_ID string")
    first = dict(corpus_pipeline.STAGES)["language_id"](prepared, docs, FOLDER)
    kept = [tuple(r) for r in first.collect()]
    assert sorted(kept, key=repr) == sorted((r for r in rows if r[5] != "bad"), key=repr)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(prepared, docs, FOLDER)
        assert out.columns == docs.columns, name
        assert {tuple(r) for r in out.collect()} <= set(rows), name
