"""Operators on documents against brute force, and on awkward rows: nulls, empty and long texts, repeats, clashing names."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from sparkweave.llm import decontaminate, language, minhash, packing, quality, quality_rules, suffix_array, suffix_dedup, token_counts, toxicity
from sparkweave.llm.common import string_hash, text_bytes, word_spans
from sparkweave.llm.subwords import words_of

WORDS = re.compile("[^\x20\x09-\x0d]+")
ASCII = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, bin_id string, f string"


def make_docs(seed=5, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeñé", k=rng.randint(1, 7))) for _ in range(300)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(5, 120)))) for i in range(n)]
    for i in range(n, n + 20):  # near copies, and copies of copies
        words = docs[rng.randrange(len(docs))][1].split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = "changed"
        docs.append((i, " ".join(words)))
    docs += [(100, None), (101, ""), (102, " \n\t"), (103, "one"), (104, "One"), (105, "two words"), (106, "ab" * 900), (107, "x" * 3000), (108, ("A line\n" * 40) + "#*|"), (109, docs[0][1]), (109, docs[0][1]), (None, docs[0][1]), (None, None)]
    docs.append((110, " ".join(rng.choices(vocabulary, k=30_000))))
    return [(i, t, None if i and i % 9 == 0 else "en", f"s{(i or 0) % 3}" if i != 7 else None, len(t or ""), "clash", "clash", "clash") for i, t in docs]


@pytest.fixture(scope="module")
def rows():
    return make_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, k):
    words = WORDS.findall((text or "").translate(ASCII))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t, k))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_are_those_of_brute_force(docs, rows, k, percent):
    expected = brute_components([r[:2] for r in rows], k, percent)
    found = minhash.near_duplicates(docs, minhash.Similarity(k, percent)).collect()
    texts = Counter((r[0], len(shingles(r[1], k))) for r in rows)
    assert Counter((r.doc_id, r.n_shingles) for r in found) == texts
    for r in found:
        assert r.component_id == expected.get(r.doc_id)
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert len(set(expected.values())) < len(expected) - 10


def test_near_duplicates_in_a_large_bucket(spark):
    rng = random.Random(1)
    shared = [f"w{i}" for i in range(200)]
    # documents that share most words, but whose ends are alike in groups only
    rows = []
    for i in range(150):
        tail = [f"t{i % 50}-{j}" for j in range(60)]
        rows.append((i, " ".join(shared + tail + [f"u{rng.random()}"])))
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), minhash.Similarity(3, 85)).collect()}
    assert found == brute_components(rows, 3, 85)


def test_signatures_estimate_without_bias():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    a, b = np.sort(values[:1000]), np.sort(values[300:])
    s = minhash.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    assert abs((s[0] == s[1]).mean() - 700 / 1500) < 0.12


def test_suffix_dedup_is_brute_force(docs, rows):
    width = 200
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    starts = Counter(t[i : i + width] for _, t in texts for i in range(len(t) - width + 1))
    expected = Counter()
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - width + 1):
            if starts[t[p : p + width]] > 1:
                gone[p : p + width] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        expected[i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    assert Counter(map(tuple, suffix_dedup.query(docs).collect())) == expected
    for limit in (1, 3000):  # the segments of every key, or of many, are split
        found, _ = suffix_dedup.find(docs, width, limit=limit)
        assert sum(b - a for r in found.collect() for a, b in suffix_dedup.spans_of(r.repeats, width)) == sum(k[2] * n for k, n in expected.items())


@pytest.mark.parametrize("limit", [suffix_dedup.SHARD_BYTES, 5000])
def test_a_common_passage_is_a_run_or_two_a_document(spark, limit):
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    passage = words(70)
    rows = [(i, f"{words(30)} {passage} {words(rng.randint(0, 30))}".strip()) for i in range(300)]
    found, _ = suffix_dedup.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), limit=limit)
    out = {r.doc_id: r for r in found.collect()}
    assert len(out) == 300
    for i, t in rows:
        a = t.index(passage)
        (x, y), = suffix_dedup.spans_of(out[i].repeats, 200)
        assert a - 8 <= x <= a and a + len(passage) <= y <= a + len(passage) + 8
        assert len(out[i].repeats) < 60  # segments of the passage, each in one run or two, and not its places


def test_deduplicated_leaves_columns_of_any_name_alone(spark):
    passage = "".join(random.Random(1).choices("abcdef ", k=260))
    rows = [(1, "x" + passage, "a", 1, 2.0), (2, "y" + passage, "b", 3, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, repeats string, f long, h double")
    out = suffix_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    assert {tuple(r) for r in out.collect()} == {(1, "x", "a", 1, 2.0), (2, "y", "b", 3, None), (None, None, None, None, None)}


def test_deduplicated_keeps_characters_whole(spark):
    passage = "é" * 150
    rows = [(1, "a" + passage + "b", 152), (2, "cc" + passage + "dd", 154), (3, None, None), (4, "clean", 5)]
    out = {r.doc_id: r for r in suffix_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    assert out[1].text == "ab" and out[1].n_chars == 2 and out[2].text == "ccdd" and out[3].text is None and out[4].text == "clean"


def test_suffix_arrays():
    rng = np.random.default_rng(2)
    for trial in range(400):
        n, k = int(rng.integers(1, 70)), int(rng.integers(1, 5))
        x = rng.integers(1, k + 1, n)
        x = np.r_[np.tile(x[: max(1, n // 5)], 4) if trial % 3 == 0 else x, 0].astype(np.uint16)
        sa = suffix_array.suffix_array(x)
        expected = sorted(range(len(x)), key=lambda i: x[i:].tolist())
        assert sa.tolist() == expected
        phi, lengths = suffix_array.permuted_lcp(x, sa)
        for a, b in zip(expected, expected[1:]):
            m = 0
            while max(a, b) + m < len(x) and x[a + m] == x[b + m]:
                m += 1
            assert phi[b] == a and lengths[b] == m


def test_names_that_recur_are_sorted_in_recursion(monkeypatch):
    calls, whole = [], suffix_array.suffix_array
    monkeypatch.setattr(suffix_array, "suffix_array", lambda *a: calls.append(len(a[0])) or whole(*a))
    rng = random.Random(3)
    text = " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=4000)).encode()
    x = np.r_[np.frombuffer(text, np.uint8), 0].astype(np.uint16)
    sa = suffix_array.suffix_array(x)
    assert len(calls) > 2 and all(b <= a // 2 + 1 for a, b in zip(calls, calls[1:]))
    assert sa.tolist() == sorted(range(len(x)), key=lambda i: bytes(x[i:].astype(np.uint8)))


def base_of(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered.update(range(i, i + 5))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_are_brute_force(spark, docs, rows):
    found = quality_rules.score(docs).collect()
    assert Counter((r.doc_id, *r[1:6]) for r in found) == Counter((r[0], *base_of(r[1])) for r in rows)
    for r in found:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and r.log_ratio >= r.n_grams * quality_rules.THRESHOLD)
    # the log-ratios by hand, from the same hashes
    from pyspark.sql import functions as F

    def buckets(text):
        w = WORDS.findall(text or "")
        return w, list(zip(w, w[1:]))

    pairs = {p for r in rows for p in buckets(r[1])[1]} | {(w, w) for r in rows for w in buckets(r[1])[0]}
    two = quality_rules.buckets(F.array(F.xxhash64("x"), F.xxhash64("y")))
    hashed = {(r.x, r.y): (r.one, r.two) for r in spark.createDataFrame(sorted(pairs), "x string, y string").select("x", "y", two[0].alias("one"), two[2].alias("two")).collect()}
    grams = [[hashed[w, w][0] for w in buckets(r[1])[0]] + [hashed[p][1] for p in buckets(r[1])[1]] for r in rows]
    trust = [len(w := WORDS.findall(r[1] or "")) >= 30 and not any(c in "#*$%&|<>" for c in r[1]) and sum(c not in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in r[1]) * 10 >= len(r[1]) * 8 and len(set(w)) * 10 >= len(w) * 4 for r in rows]
    every, target = Counter(b for g in grams for b in g), Counter(b for g, t in zip(grams, trust) if t for b in g)
    assert any(trust)
    n = quality_rules.BUCKETS
    sums = [[sum(v for k, v in c.items() if (k < n) == side) for side in (True, False)] for c in (target, every)]
    share = lambda c, total: math.log((c + 0.5) / (total + 0.5 * n))
    ratio = {b: round(1_000_000 * (share(target[b], sums[0][b >= n]) - share(every[b], sums[1][b >= n]))) for b in every}
    assert Counter((r.doc_id, r.log_ratio, r.n_grams) for r in found) == Counter((r[0], sum(ratio[b] for b in g), len(g)) for r, g in zip(rows, grams))


def brute_overlap(text, item):
    tokens = [re.findall("[0-9A-Za-z\x80-\U0010ffff]+", x.translate(ASCII)) for x in (text or "", item or "")]
    t, s = tokens
    if not s:
        return False
    width = min(decontaminate.WINDOW, len(s))
    allowed = width // 5 if len(s) >= decontaminate.MIN_TOKENS else 0
    return any(sum(t[a + k] == s[b + k] for k in range(width)) >= width - allowed for a in range(len(t) - width + 1) for b in range(len(s) - width + 1))


def test_decontamination_is_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([8, 9, 14, 20, 25, 40, 7, 5])] + [(8, "v3 v3 v4"), (3, None), (None, "v1 " * 20), (50, "")]
    rows = [(900, None), (901, ""), (902, "v1"), (902, "v1")]
    for d in range(150):
        words = rng.choices(vocabulary, k=rng.randint(0, 40))
        if d % 2:
            part = items[rng.randrange(8)][1].upper().split()
            for _ in range(rng.randint(0, len(part) // 4)):
                part[rng.randrange(len(part))] = "other"
            words += part + rng.choices(vocabulary, k=5)
        rows.append((d, (", " if d % 3 else "\n").join(words)))
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, items string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for limit in (1 << 20, 100):
        found = decontaminate.find(docs, benchmark, limit).collect()
        expected = Counter((i, tuple(sorted({b for b, s in items if b is not None and brute_overlap(t, s)}))) for i, t in rows)
        assert Counter((r.doc_id, tuple(r["items"])) for r in found) == expected
        kept = decontaminate.decontaminate(docs, benchmark, limit)
        assert kept.columns == docs.columns and {r["items"] for r in kept.collect()} == {"clash"} and kept.count() == sum(not r.contaminated for r in found)
    assert any(r.contaminated for r in found) and not all(r.contaminated for r in found)
    assert decontaminate.find(docs, benchmark.limit(0)).where("contaminated").isEmpty()


def test_masks_hit_every_overlap_that_counts():
    for n in range(decontaminate.MIN_TOKENS, decontaminate.WINDOW + 1):
        for bad in combinations(range(n), n // 5):
            assert any(all(m != "1" or o + k not in bad for k, m in enumerate(mask)) for mask in decontaminate.MASKS for o in range(n - len(mask) + 1))


def test_packing(docs, rows):
    found = packing.pack(docs, capacity=100, block=40).collect()
    pieces = {}
    for r in found:
        pieces.setdefault((r.doc_id, r.piece), []).append(r.n_words)
    words = Counter()
    for r in rows:
        n = len(WORDS.findall(r[1] or ""))
        for p, at in enumerate(range(0, max(n, 1), 100)):
            words[r[0], p, min(100, n - at)] += 1
    assert Counter((r.doc_id, r.piece, r.n_words) for r in found) == words
    source = {r[0]: r[3] for r in rows}
    bins = {}
    for r in found:
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
        else:
            assert r.n_words == 0
    for own in bins.values():
        own.sort(key=lambda r: r.bin_offset)
        assert own[0].bin_offset == 0 and all(a.bin_offset + a.n_words == b.bin_offset for a, b in zip(own, own[1:])) and own[-1].bin_offset + own[-1].n_words <= 100
        named = [source[r.doc_id] for r in own if source[r.doc_id] is not None]
        assert len(named) == len(set(named))


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(1, 30)
        items = sorted(((rng.randint(1, 20), rng.randint(-1, 3), rng.randint(-1, 6)) for _ in range(n)), reverse=True)
        bins, offsets = packing.best_fit(*zip(*items), 20)
        held = []
        for (size, s, c), b, at in zip(items, bins, offsets):
            fits = [(room, k) for k, (room, ss, cs) in enumerate(held) if room >= size and (s < 0 or s not in ss) and (c < 0 or c not in cs)]
            if fits:
                assert (held[b][0], b) == min(fits)
            else:
                assert b == len(held)
                held.append([20, set(), set()])
            assert at == 20 - held[b][0]
            held[b][0] -= size
            held[b][1].add(s)
            held[b][2].add(c)


def test_token_counts_are_best_segmentations(spark):
    vocabulary = {"▁": -3.0, "▁a": -2.0, "a": -4.0, "b": -4.0, "ab": -3.5, "ba": -3.0, "aba": -7.0, "▁ab": -6.5, "é": -5.0, "c": -4.0}
    low = min(vocabulary.values()) - 10

    def best(word):
        text = "▁" + word
        at = [(0.0, 0)] + [None] * len(text)
        for e in range(1, len(text) + 1):
            ways = [(at[s][0] + vocabulary[text[s:e]], -at[s][1] - 1) for s in range(e) if text[s:e] in vocabulary]
            if text[e - 1] not in vocabulary:
                n = len(text[e - 1].encode())
                ways.append((at[e - 1][0] + n * low, -at[e - 1][1] - n))
            score, pieces = max(ways)
            at[e] = (score, -pieces)
        return at[-1][1]

    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choices("abcézß", k=rng.randint(1, 9))) for _ in range(rng.randint(0, 20)))) for i in range(80)]
    rows += [(None, "ab a"), (200, None), (201, "\n a\tab  ")]
    for limit in (400_000, 10):
        trie = token_counts.ForwardTrie(vocabulary, limit)
        for _, t in rows:
            words = (t or "").encode().split()
            assert trie.of([words]) == [sum(best(w.decode()) for w in words)]
    trie = token_counts.ForwardTrie(vocabulary)
    trie.of([[b"abab", b"abac"]])
    assert len(trie.score) == 1 + len("▁aba") + 2  # what the words share is scored once
    trie.of([[b"aba", b"abab"]])
    assert len(trie.score) == 1 + len("▁aba") + 2
    assert token_counts.ForwardTrie({}).of([["é a".encode().split()[0]]]) == [len("▁é".encode())]
    found = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary).collect()
    assert Counter(map(tuple, found)) == Counter((i, len((t or "").split()), sum(map(best, (t or "").split()))) for i, t in rows)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(6)
    base = {"en": ["the", "and", "thing", "other", "wher", "shing"], "de": ["der", "und", "schlich", "keit", "einung", "über"]}
    bad = ["snarfle", "snarfling", "snarfs"]
    docs, labels = [], []
    for i in range(600):
        lang = "en" if i % 2 else "de"
        words = rng.choices(base[lang], k=rng.randint(20, 150))
        toxic, poor = int(i % 5 == 0), int(i % 3 == 0)
        if toxic:
            for _ in range(max(2, len(words) // 20)):
                words[rng.randrange(len(words))] = rng.choice(bad)
        if poor:
            words = [w + "###" for w in words]
        docs.append((i, " ".join(words), lang))
        if i % 10 != 9:
            labels.append((i, 1 - poor, toxic))
    docs += [(1000, None, None), (1001, "", "en"), (1002, "12 34 #", "en"), (1002, "12 34 #", "en"), (None, "the other", None)]
    labels += [(1001, 0, 0), (1001, 1, 1), (None, 1, 1), (5000, 1, 1), (3, None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "column", "folds", "out"), [(toxicity, "toxic", 3, 1), (quality, "quality", 4, 2)])
def test_classifiers_on_held_out_rows(labelled, module, column, folds, out):
    import zlib

    docs, labels = labelled
    found = module.query(docs, labels).collect()
    truth = {r.doc_id: r[column] for r in labels.collect() if r.doc_id is not None and r.doc_id < 1000 and r[column] is not None}
    assert len(found) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % folds == out) for r in found)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert module.query(docs.limit(0), labels.limit(0)).count() == 0
    assert module.query(docs, labels.limit(0)).count() == docs.count()


def test_words_never_seen_share_their_ngrams():
    texts = ["the snarfling thing and other " * 3, "the thing and other and " * 3] * 40
    model = toxicity.train(pa.array(texts), np.array([1, 0] * 40))
    scores = toxicity.score_texts(pa.array(["the snarflingly thing and other " * 3, "the thing and brother and " * 3]), *toxicity.folded(model))
    assert scores[0] > 0.7 > 0.5 > scores[1]


def test_languages(labelled):
    docs, _ = labelled
    found = {(r.doc_id, r.lang_pred, r.held_out): r.score for r in language.query(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert all(0 <= s <= 1 for s in found.values())
    for i, pred, _ in found:
        if i is not None and i >= 1000:
            assert pred == "und"
    held = [(i, p) for i, p, h in found if h and i < 1000]
    assert sum(truth[i] == p for i, p in held) / len(held) > 0.98
    assert language.query(docs.limit(0)).count() == 0


def test_code_switching_is_seen_word_by_word(labelled):
    docs, _ = labelled
    model = language.fit(docs)
    rows, marginal = language.label_words(*text_bytes(pa.array(["the and thing other wher the der und keit einung schlich und", ""])), model)
    assert [model.languages[x] for x in marginal.argmax(1)] == ["en"] * 6 + ["de"] * 6 and rows.tolist() == [0] * 12


def test_forward_backward_is_brute_force():
    from itertools import product

    rng = np.random.default_rng(0)
    unary, move, start = rng.normal(size=(1, 5, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    real = np.array([[True] * 4 + [False]])
    marginal, pairs, log_z = language.forward_backward(unary, real, move, start)
    weights = {y: math.exp(start[y[0]] + sum(unary[0, t, y[t]] for t in range(4)) + sum(move[y[t], y[t + 1]] for t in range(3))) for y in product(range(3), repeat=4)}
    z = sum(weights.values())
    assert abs(log_z[0] - math.log(z)) < 1e-9
    for t in range(4):
        for k in range(3):
            assert abs(marginal[0, t, k] - sum(w for y, w in weights.items() if y[t] == k) / z) < 1e-9
    for a, b in product(range(3), repeat=2):
        assert abs(pairs[a, b] - sum(w * sum(y[t] == a and y[t + 1] == b for t in range(3)) for y, w in weights.items()) / z) < 1e-9


def test_a_text_is_one_chain_however_long(monkeypatch):
    rng = np.random.default_rng(1)
    k, sizes = 3, [1, 0, 4, 5, 23, 8, 2]
    move, start = rng.normal(size=(k, k)), rng.normal(size=k)
    unary, row = rng.normal(size=(sum(sizes), k)) * 3, np.repeat(np.arange(len(sizes)), sizes)
    whole = np.zeros((len(sizes), max(sizes), k))
    real = np.arange(max(sizes))[None] < np.array(sizes)[:, None]
    whole[real] = unary
    wanted = language.forward_backward(whole, real, move, start)[0][real]
    for length in (1, 2, 4, 32):
        monkeypatch.setattr(language, "CHAIN", length)
        assert np.allclose(language.chain_marginals(unary, row, len(sizes), move, start), wanted)


def test_predictions_are_means_over_whole_texts(labelled):
    docs, _ = labelled
    model = language.fit(docs)
    long = "the and thing " * 40 + "der und keit " * 90
    texts = pa.array([long, "der", "12", "", "é"])
    names, score = language.predict_texts(texts, model)
    for text, name, s in zip(texts.to_pylist(), names, score, strict=True):
        words = [w for w in text.split() if any(c.isalpha() for c in w)]
        if not words:
            assert (name, s) == ("und", 0)
            continue
        one = words_of(*text_bytes(pa.array([text])), letters_only=True)
        unary = language.word_scores(one, model.emission)[one.word][None]
        mean = language.forward_backward(unary, np.ones((1, len(words)), bool), model.transition, model.start)[0][0].mean(0)
        assert name == model.languages[mean.argmax()] and abs(s - mean.max()) < 1e-6


def test_scores_of_the_public_vocabulary_are_log_probabilities():
    scores = token_counts.load_vocabulary()
    assert abs(sum(map(math.exp, scores.values())) - 1) < 1e-6


def test_empty_tables(empty, spark):
    assert minhash.near_duplicates(empty).count() == 0
    assert suffix_dedup.query(empty).count() == 0
    assert suffix_dedup.deduplicated(empty).columns == empty.columns
    assert quality_rules.score(empty).count() == 0
    assert packing.pack(empty).count() == 0
    assert token_counts.count_tokens(empty, {"a": -1.0}).count() == 0
    assert decontaminate.query(empty, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_words_are_cut_bytewise():
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab é\n\t\v x\f\rñ", k=rng.randint(0, 30))) for _ in range(200)]
    data, offsets = text_bytes(pa.array(texts))
    starts, ends, row = word_spans(data, offsets)
    found = [[] for _ in texts]
    for a, b, r in zip(starts, ends, row):
        found[r].append(bytes(data[a:b]).decode())
    assert found == [WORDS.findall(t) for t in texts]
    assert string_hash("ab") == string_hash(b"ab") != string_hash("ba")
