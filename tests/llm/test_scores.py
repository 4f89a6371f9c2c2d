"""Language model scores, quality rules, languages and quality scores against plain computations."""

import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from luxframe.llm import language_id, lm_score, quality_rules, queries, rule_classifier, statistics

FOLDER = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_scores(texts, order, backoff):
    """Stupid backoff with each document's own counts taken off, by dictionaries."""
    split = [[re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")] for t in texts]

    def grams(words):
        return Counter(tuple(words[i : i + k]) for k in range(1, order + 1) for i in range(len(words) - k + 1))

    own = [grams(words) for words in split]
    total = Counter()
    for counts in own:
        total.update(counts)
    size = sum(map(len, split))
    for words, mine in zip(split, own, strict=True):
        score, given_up = 0.0, 0
        for i in range(len(words)):
            longest = min(i + 1, order)
            for k in range(longest, 0, -1):
                gram = tuple(words[i - k + 1 : i + 1])
                held = total[gram] - mine[gram]
                if k == 1:
                    score += math.log(max(held, 0.5) / max(size - len(words), 1))
                    break
                context = total[gram[:-1]] - mine[gram[:-1]]
                if held > 0 and context > 0:
                    score += math.log(held / context)
                    break
                score += math.log(backoff)
                given_up += 1
        yield len(words), score, given_up


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_scores(prepared, order):
    docs = prepared.read.parquet(f"{FOLDER}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    found = {r["doc_id"]: r for r in lm_score.score(docs, order=order, block_chars=50_000).collect()}
    want = brute_scores([r["text"] for r in rows], order, lm_score.BACKOFF)
    for row, (n, score, given_up) in zip(rows, want, strict=True):
        got = found[row["doc_id"]]
        assert (got["n_tokens"], got["n_backoffs"]) == (n, given_up)
        assert got["log_score"] == pytest.approx(score, rel=1e-9, abs=1e-9)


def test_registered_scores_use_trigrams(prepared):
    rows = prepared.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()
    found = {r["doc_id"]: r for r in queries.QUERIES["op3_lm_score"](prepared, FOLDER).collect()}
    for row, (n, score, given_up) in zip(rows, brute_scores([r["text"] for r in rows], 3, lm_score.BACKOFF), strict=True):
        got = found[row["doc_id"]]
        assert (got["n_tokens"], got["n_backoffs"]) == (n, given_up)
        assert got["log_score"] == pytest.approx(score, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("top", [1, 200, 1 << 30, 1 << 64])
def test_sorted_hashes_and_numbers_travel_unchanged(top):
    chance = np.random.default_rng(4)
    for n in (1, 2, 50, 5000):
        hashes = np.unique(chance.integers(0, top, n, np.uint64, endpoint=False))
        assert np.array_equal(lm_score.summed(*lm_score.differences(hashes)), hashes)
        numbers = np.concatenate([hashes >> np.uint64(40), [0, 254, 255, 256]]).astype(np.uint64)
        assert np.array_equal(lm_score.unpacked(lm_score.packed(numbers)), numbers)


def test_texts_travel_compressed():
    texts = ["", None, "a", "\u00e9\u4e2d \x00 word\r\n" * 50, " ".join(f"word{i % 97}" for i in range(400))]
    columns = {"doc_id": pa.array(range(5), pa.int64()), "text": pa.array(texts), "block": pa.array([0] * 5, pa.int64())}
    sent = pa.Table.from_batches(lm_score.squeezed([pa.RecordBatch.from_pydict(columns)]))
    assert lm_score._texts(sent) == [text or "" for text in texts]
    assert sent.column("text")[1].as_py() is None and len(sent.column("text")[4].as_py()) < len(texts[4]) / 2


def test_backoff_scores_of_odd_rows(odd, empty):
    found = lm_score.score(odd).collect()
    assert len(found) == odd.count()
    assert {r["n_tokens"] for r in found if r["doc_id"] in (1, 2, 3)} == {0}
    assert all(r["mean_log_score"] is None for r in found if r["doc_id"] in (1, 2, 3))
    twins = [r for r in found if r["doc_id"] == 4]
    assert len(twins) == 2 and twins[0]["log_score"] == twins[1]["log_score"] and twins[0]["n_backoffs"] == 0
    assert lm_score.score(empty).count() == 0


def plain_counts(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    seen, again = set(), 0
    for line in lines:
        again += line in seen
        seen.add(line)
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": again,
        "n_repeat_words": len(covered),
    }


def test_quality_rules_against_plain_counts_and_a_plain_estimate(prepared):
    rows = {r["doc_id"]: r for r in prepared.read.parquet(f"{LARGER}/documents.parquet").collect()}
    found = quality_rules.judge(prepared.read.parquet(f"{LARGER}/documents.parquet")).collect()
    assert len(found) == len(rows)
    vectors, keys = {}, {}
    for got in found:
        want = plain_counts(rows[got["doc_id"]]["text"])
        assert {k: got[k] for k in want} == want
        assert got["base_failed"] == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])
        if not got["base_failed"]:
            n, text = want["n_words"], rows[got["doc_id"]]["text"]
            upper = len(re.findall("[A-Z]", text))
            vectors[got["doc_id"]] = [
                math.log(n),
                3 * math.log(want["word_chars"] / n),
                math.asinh(20 * want["n_symbols"] / n),
                math.asinh(30 * want["n_dup_lines"] / n),
                math.asinh(5 * want["n_repeat_words"] / n),
                math.asinh(10 * upper / want["word_chars"]),
            ]
            keys[got["doc_id"]] = (got["lang"], got["source"])
    table = {got["doc_id"]: got for got in found}
    groups = Counter(keys.values())
    languages = Counter(lang for lang, _ in keys.values())
    checked = 0
    for language in languages:
        members = [d for d in keys if keys[d][0] == language]
        judged = [d for d in members if groups[keys[d]] < quality_rules.LEAST]
        if len(members) < quality_rules.LEAST or not judged:
            continue
        distances = plain_distances(np.array([vectors[d] for d in members]))
        by_id = dict(zip(members, distances, strict=True))
        for d in judged:
            assert table[d]["distance"] == pytest.approx(by_id[d], rel=1e-6, abs=1e-9)
            assert table[d]["kept"] == (by_id[d] <= quality_rules.chi_square(quality_rules.CUT))
            checked += 1
    assert checked > 300


def plain_distances(x):
    """The same concentration steps with numpy on one group."""
    ridge = np.array([quality_rules.RIDGE[n] for n in quality_rules.NAMES])

    def squared(centre, cov):
        return np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)

    def bins(d):
        return np.floor(np.log2(np.maximum(d, 2.0**-20)) * quality_rules.GRID)

    def last(d, share):
        b = np.sort(bins(d))
        return b[int(math.ceil(share * len(b))) - 1]

    def estimate(rows, scale=1.0):
        return rows.mean(0), np.cov(rows.T, bias=True) * scale + np.diag(ridge**2)

    grid = np.round(x * quality_rules.GRID) / quality_rules.GRID
    low, middle, high = np.percentile(grid, [25, 50, 75], axis=0)
    centre, cov = middle, np.diag(((high - low) / 1.349) ** 2 + ridge**2)
    for _ in range(quality_rules.STEPS):
        d = squared(centre, cov)
        centre, cov = estimate(x[bins(d) <= last(d, quality_rules.SHARE)])
    d = squared(centre, cov)
    scale = max(1.0, 2 ** ((last(d, 0.5) + 0.5) / quality_rules.GRID) / quality_rules.chi_square(0.0))
    inside = 2 ** (bins(d) / quality_rules.GRID) <= scale * quality_rules.chi_square(1.96)
    return squared(*estimate(x[inside], scale))


def test_quality_rules_keep_clean_and_reject_marked_documents(prepared):
    found = quality_rules.judge(prepared.read.parquet(f"{LARGER}/documents.parquet"))
    labels = prepared.read.parquet(f"{LARGER}/labels.parquet")
    rows = found.join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    counts = {(r["quality"], r["kept"]): r["count"] for r in rows}
    assert counts.get((1, False), 0) == 0
    assert counts.get((0, True), 0) <= 0.2 * counts.get((0, False), 1)


def test_quality_rules_on_odd_rows(odd, empty):
    found = quality_rules.judge(odd).collect()
    assert len(found) == odd.count() and all(r["base_failed"] and not r["kept"] for r in found)
    assert quality_rules.judge(empty).count() == 0


def test_quality_rules_keep_a_table_too_small_for_an_estimate(documents):
    words = " ".join(f"w{i}" for i in range(80))
    found = quality_rules.judge(documents([(1, words, None, None), (1, words, None, None)])).collect()
    assert [r["kept"] for r in found] == [True, True]


def test_repeated_words_with_very_many_distinct_words():
    codes = np.array([0, 1, 2, 3, 0, 1, 2, 4])
    assert statistics.repeated_words(codes, 5) == statistics.repeated_words(codes, 3_000_000) == 6


def test_languages_of_held_out_documents(prepared):
    docs = prepared.read.parquet(f"{LARGER}/documents.parquet")
    found = language_id.predict(docs)
    held = found.where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert found.count() == docs.count() and len(held) > 100
    assert sum(r["lang_pred"] == r["lang"] for r in held) > 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in held)


def test_forward_backward_against_all_paths():
    random = np.random.default_rng(1)
    field = language_id.Field(["a", "b"], {}, np.zeros((1, 2)), random.normal(size=(2, 2)), random.normal(size=2), "x")
    scores = random.normal(size=(5, 2))
    codes = [np.array([0, 1, 2]), np.array([], np.int64), np.array([4]), np.array([3, 3, 1, 0])]
    marginals, owner, words, _ = language_id.forward_backward(codes, scores, field)
    for i, sequence in enumerate(codes):
        rows = np.flatnonzero(owner == i)
        assert words[rows].tolist() == sequence.tolist()
        want = np.zeros((len(sequence), 2))
        for path in np.ndindex(*[2] * len(sequence)):
            if not path:
                continue
            weight = field.start[path[0]] + sum(field.moves[a, b] for a, b in zip(path, path[1:], strict=False))
            weight += sum(scores[w, label] for w, label in zip(sequence, path, strict=True))
            for t, label in enumerate(path):
                want[t, label] += math.exp(weight)
        if len(sequence):
            assert marginals[rows] == pytest.approx(want / want.sum(1, keepdims=True))


def test_features_of_long_words_are_all_kept():
    word = "".join(chr(0x4E00 + i) for i in range(40))
    assert len(language_id.features(word, {})) == 4 + 4 + 41 + 40
    slots = language_id.Slots(["", word, "ab"], {})
    weights = np.random.default_rng(2).random((language_id.BUCKETS, 3))
    weights[0] = 0
    want = [weights[[0]].sum(0), weights[language_id.features(word, {})].sum(0), weights[language_id.features("ab", {})].sum(0)]
    assert np.allclose(slots.sums(weights), want)
    assert np.allclose(slots.sums(weights, np.array([2, 0])), [want[2], want[0]])


def test_training_reads_whole_texts_of_every_language(prepared, documents):
    """Very long texts give windows up to their end; more languages than any limit of old are all learned."""
    long = " ".join(["start"] * 30_000 + ["finish"] * 30_000)
    rows = [(i, f"word{chr(97 + i // 26)}{chr(97 + i % 26)} " * 40, f"l{i:03}", "s") for i in range(1, 261)]
    pieces = language_id.sampled_pieces(language_id.training_rows(documents([(2, long, "en", "s"), *rows])))
    found = {r["lang"]: r for r in pieces.collect()}
    assert len(found) > 200
    assert {w for window in found["en"]["windows"] for w in window} == {"start", "finish"}
    assert dict(zip(found["en"]["words"], found["en"]["counts"], strict=True)) == {"start": 30_000, "finish": 30_000}
    known = {(r["word"], r["lang"]) for r in language_id.lexicon_of(pieces).collect()}
    assert {("start", "en"), ("finish", "en")} <= known and len(known) == len(found) + 1


def test_switched_texts_are_labelled_word_by_word(prepared, documents):
    docs = prepared.read.parquet(f"{LARGER}/documents.parquet")
    field = language_id.learn(docs)
    sample = {r["lang"]: r["text"].split()[:40] for r in docs.where("n_chars > 600").orderBy("doc_id").collect()}
    mixed = " ".join(sample["en"] + sample["de"])
    row = language_id.label_words(documents([(1, mixed)]), field).first()
    assert row["words"] == mixed.split()
    assert Counter(row["languages"][:40])["en"] >= 30 and Counter(row["languages"][40:])["de"] >= 30


def test_languages_of_odd_rows(odd, empty, prepared):
    field = language_id.learn(prepared.read.parquet(f"{FOLDER}/documents.parquet"))
    found = language_id.identify(odd, field).collect()
    assert len(found) == odd.count()
    assert {(r["lang_pred"], r["score"]) for r in found if r["doc_id"] in (1, 2, 3)} == {("und", 0.0)}
    assert language_id.identify(empty, field).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(odd.drop("lang").selectExpr("*", "string(null) as lang")).collect()} == {"und"}


def test_quality_scores_of_held_out_documents(prepared):
    docs, labels = (prepared.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    found = rule_classifier.classify(docs, labels)
    held = found.where("held_out").join(labels, "doc_id").collect()
    assert found.count() == docs.count()
    assert sum(r["predicted"] == r["quality"] for r in held) > 0.9 * len(held)


def test_rules_compile_to_what_they_say(prepared):
    random = np.random.default_rng(2)
    x = random.random((400, len(rule_classifier.FEATURES)))
    y = ((x[:, 1] > 0.5) & (x[:, 3] <= 0.7)).astype(float)
    ensemble = rule_classifier.fit(x, y)
    logit = ensemble.intercept + sum(w * rule_classifier._met(tests, x) for tests, w in ensemble.rules)
    rows = prepared.createDataFrame([(*map(float, r), i) for i, r in enumerate(x)], [*rule_classifier.FEATURES, "i"])
    got = [r["s"] for r in rows.select("i", ensemble.score().alias("s")).orderBy("i").collect()]
    assert got == pytest.approx((1 / (1 + np.exp(-logit))).tolist())
    assert np.mean((np.array(got) > 0.5) == y) > 0.95
    assert len(ensemble.rules) < 60


def test_quality_scores_without_usable_labels(odd, empty, prepared):
    schema = "doc_id long, quality int, toxic int"
    none = prepared.createDataFrame([(1, None, 0), (None, 1, 0), (99, 1, 0)], schema)
    assert {r["score"] for r in rule_classifier.classify(odd, none).collect()} == {0.5}
    one = prepared.createDataFrame([(4, 1, 0), (4, 1, 0), (5, 1, 0)], schema)
    assert all(r["score"] > 0.9 for r in rule_classifier.classify(odd, one).collect())
    assert rule_classifier.classify(empty, one).count() == 0


def test_queries_cover_every_row(prepared):
    n = prepared.read.parquet(f"{FOLDER}/documents.parquet").count()
    for name in ("op3_lm_score", "op4_quality_rules", "op5_language_id", "op8_rule_classifier"):
        assert queries.QUERIES[name](prepared, FOLDER).count() == n


def test_features_of_many_words_are_kept_as_arrays():
    """What the driver holds while it learns follows the arrays, not lists of numbers; each word has its own features."""
    chance = random.Random(12)
    words = ["", *("".join(chance.choice("abcdefghijklmnop") for _ in range(chance.randint(1, 11))) for _ in range(20_000))]
    lexicon = {words[5]: "en"}
    tracemalloc.start()
    slots = language_id.Slots(words, lexicon)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * slots.flat.nbytes + 2_000_000
    for at in (0, 5, 4095, 4096, 4097, 20_000):
        assert slots.of(np.array([at])).tolist() == (language_id.features(words[at], lexicon) if words[at] else [0])
    assert len(language_id.Slots([], {}).flat) == 0
