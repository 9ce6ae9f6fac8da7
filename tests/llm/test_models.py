"""Operators that learn or rake: toxicity, language model, mixing, decontamination."""

import math
import random
import warnings
import zlib
from collections import Counter
from pathlib import Path

import pytest

from quillmark.llm import decontaminate, lm, mixing, toxicity
from quillmark.llm.common import WordHashes, shingle_hashes

KIND = "doc_id long, text string"


def crc(i):
    return zlib.crc32(str(i).encode())


def labelled(n=700):
    rng = random.Random(5)
    plain, bad = [f"word{i}" for i in range(300)], ["nastyword", "vileterm", "hatefulish"]
    texts, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [rng.choice(plain) for _ in range(rng.choice([5, 40, 200]))]
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad).upper())
        texts.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return texts, labels


def test_toxicity_on_held_out_rows(spark):
    texts, labels = labelled()
    docs = spark.createDataFrame(texts + [(9001, None), (9002, ""), (None, "word1")], KIND).selectExpr("*", "7 score", "1 toxic")
    marks = spark.createDataFrame(labels + [(0, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, marks).collect()}
    truth = dict(labels)
    for i, r in got.items():
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert i is None or r["held_out"] == (crc(i) % 3 == 1)
    held = [i for i in truth if crc(i) % 3 == 1]
    right = sum(got[i]["predicted"] == truth[i] for i in held)
    assert right >= 0.97 * len(held)
    assert got[9001]["score"] == got[9002]["score"] < 0.7
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["predicted"]}


def test_scores_follow_the_model_by_hand(spark):
    """Each text's score from its n-grams one by one, with cells, ratios and weights in plain Python."""
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["kind", "vile", "Straße", "𝔘x", "a", "hello\tworld"]) for _ in range(rng.randrange(0, 12))) for _ in range(90)] + ["", None, "x" * 40_000]
    docs = [(i, t) for i, t in enumerate(texts)]
    labels = [(i, int("vile" in (t or ""))) for i, t in docs]
    steps = [int(x) for x in toxicity._STEP]

    def cells(text):
        body = " " + " ".join((text or "").lower().split()) + " "
        out = set()
        for n in toxicity.SIZES:
            for i in range(len(body) - n + 1):
                h = sum(ord(c) * k for c, k in zip(body[i : i + n], steps, strict=False)) % 2**32
                g = (h ^ h >> 15) * 0x85EBCA6B % 2**32
                out.add(((g ^ g >> 13) * 0xC2B2AE35 % 2**32) >> (32 - toxicity.BUCKET_BITS))
        return out

    df, marks = spark.createDataFrame(docs, KIND), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(df, marks)
    learnt = [(cells(t), y) for (i, t), (_, y) in zip(docs, labels, strict=True) if zlib.crc32(str(i).encode()) % 3 != 1]
    counts = [Counter(c for own, y in learnt if y == k for c in own) for k in (0, 1)]
    seen = counts[0].keys() | counts[1].keys()
    total = [sum(c.values()) for c in counts]
    ratio = {c: math.log((counts[1][c] + 1) / (total[1] + len(seen))) - math.log((counts[0][c] + 1) / (total[0] + len(seen))) for c in seen}
    sure = sorted(seen, key=lambda c: (-round(abs(ratio[c]) / math.sqrt(1 / (counts[1][c] + 1) + 1 / (counts[0][c] + 1)), 9), c))[: toxicity.FEATURES]
    assert {c: int(k) for c, k in enumerate(model.slot.tolist()) if k >= 0} == {c: k for k, c in enumerate(sure)}
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(df, marks).collect()}
    for i, text in docs:
        z = model.bias + sum(model.weight[model.slot[c]] for c in cells(text) if model.slot[c] >= 0)
        assert math.isclose(got[i], 1 / (1 + math.exp(-z)), rel_tol=1e-6), i


def test_repeated_ids_do_not_pass_the_bound(spark, monkeypatch):
    docs = [(i, f"text {i} {j}") for i in (0, 1, 2) for j in range(1_000)] + [(i, "vile vile" if i % 2 else "kind words") for i in range(10, 40)]
    labels = [(i, i % 2) for i in [0, 1, 2, *range(10, 40)]]
    fitted = []
    fit = toxicity._fit
    monkeypatch.setattr(toxicity, "_fit", lambda rows, *a: fitted.append(len(rows)) or fit(rows, *a))
    df, marks = spark.createDataFrame(docs, KIND), spark.createDataFrame(labels, "doc_id long, toxic int")
    toxicity.train(df, marks, rows=12)
    toxicity.train(df, marks)
    assert fitted[0] == 12 and fitted[1] == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i, _ in labels)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a")], KIND)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["predicted"] for r in toxicity.toxicity_scores(docs, none).collect()] == [0, 0]
    assert toxicity.toxicity_scores(docs.limit(0), none).count() == 0


def test_features_are_the_ngrams_of_each_text():
    found = {}
    for first, _, of, cell in toxicity.features(["Abc", "", "abc  ABC"], None):
        for t, c in zip(of.tolist(), cell.tolist(), strict=True):
            found.setdefault(first + t, set()).add(c)
    # " abc " has 3 + 2 + 1 n-grams of 3, 4 and 5 code points; " abc abc " contains them all
    assert len(found[0]) == 6 and 1 not in found and found[0] < found[2]


def test_language_model_contract(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(400):
        at, text = rng.randrange(60), []
        for _ in range(rng.choice([1, 20, 60])):
            at = (at * 7 + rng.choice([1, 1, 1, 2])) % 60
            text.append(words[at].upper() if at % 5 == 0 else words[at])
        rows.append((i, " ".join(text)))
    rows += [(1000, None), (1001, "neverseen w1")]
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "1 c", "'x' word", "2 row")
    got = {r["doc_id"]: r for r in lm.language_model_scores(df).collect()}
    tokens = {i: (t or "").encode().lower().split() + [lm.END] for i, t in rows}
    counts = Counter(w for i, t in tokens.items() if crc(i) % 7 != 2 for w in t)
    n, v = sum(counts.values()), len(counts)
    for i, t in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(i) % 7 == 2, len(t), sum(counts[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.8 * sum(r["base_score"] for r in held)


def test_language_model_is_normalised():
    import numpy as np

    contexts = np.array([(a, b) for a in range(6) for b in range(6)])
    pairs = np.random.default_rng(0).integers(0, 9, (36, 30))
    model = lm.train_nce(pairs, contexts, steps=60)
    assert model.combine.shape[0] == 2
    assert np.allclose(np.exp(model.log_probabilities(contexts)).sum(axis=1), 1, atol=1e-4)
    starts = np.array([0, 7, 19])
    runs = np.exp(lm.log_normalised(model.scores(contexts), starts))
    assert np.allclose(np.add.reduceat(runs, starts, axis=1), 1, atol=1e-4)


def spoken(n=300, seed=8):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        own = [f"{'xyz'[i % 3]}{k}{'abc'[i % 3]}" for k in range(40)]
        rows.append((i, " ".join(rng.choice([*own, "common", f"rare{rng.randrange(900)}{'qrs'[i % 3]}"]) for _ in range(rng.choice([0, 5, 60])))))
    return rows


def test_probabilities_of_all_next_words_add_up_to_one(spark):
    docs = spark.createDataFrame(spoken(), KIND)
    counts = lm.word_counts(docs)
    model, _, _, _ = lm.train(docs, counts)
    seen = {bytes(r["word"]): r["c"] for r in counts.collect()}
    rare = [w for w in seen if w != lm.END and w not in model.units.index]
    assert len(model.units.index) > 100 and len(rare) > 100
    # one unseen word for each class that endings have
    tails = {int(model.class_of[k]) for k in range(len(model.units.index), model.units.end)}
    for history in ([], [b"x1a"], [b"x1a", b"common"], [b"y3b", b"unheard"]):
        logs = [0.0] * (len(history) + 1)

        def probability(word, count):
            from_start = model.log10_tokens([*history, word], lm.np.array([*logs[:-1], math.log10(count + 1), 0.0]))
            return 10 ** from_start[len(history)]

        total = sum(probability(w, seen[w]) for w in [*model.units.index, *rare])
        total += 10 ** model.log10_tokens(history, lm.np.array(logs))[-1]
        c = model.class_of[[model.units.end] * 2 + model.units.numbers(history)]
        for kind in tails:
            total += 10 ** (float(model.next_class[(c[-2] * lm.CLASSES + c[-1]) * lm.CLASSES + kind]) - model.tail[kind])
        assert math.isclose(total, 1, abs_tol=1e-3), total


def test_scores_follow_the_model_word_by_word(spark):
    rows = spoken(120) + [(900, "x1a unheard common"), (901, None)]
    docs = spark.createDataFrame(rows, KIND)
    training = docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 7 != 2")
    counts = lm.word_counts(training)
    model, _, _, _ = lm.train(training, counts)
    seen = {bytes(r["word"]): r["c"] for r in counts.collect()}
    got = {r["doc_id"]: r["score"] for r in lm.language_model_scores(docs).collect()}
    size = Counter()
    for w, c in seen.items():
        if w != lm.END and w not in model.units.index:
            size[int(model.class_of[model.units.numbers([w])[0]])] += c + 1
    for i, text in rows:
        want, past = 0.0, [0, 0]
        for w in [*(text or "").encode().lower().split(), lm.END]:
            unit = model.units.end if w == lm.END else model.units.numbers([w])[0]
            kind = int(model.class_of[unit])
            want += float(model.next_class[(past[-2] * lm.CLASSES + past[-1]) * lm.CLASSES + kind])
            if w in model.units.index:
                want += float(model.next_word[past[-1], unit])
            elif w != lm.END:
                want += math.log10((seen.get(w, 0) + 1) / (size[kind] + 1))
            past.append(kind)
        assert math.isclose(got[i], want, rel_tol=1e-6), i


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="needs the test tables")
def test_held_out_texts_are_likelier_than_by_unigrams(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [r for r in lm.language_model_scores(docs).collect() if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in held)
    assert sum(r["score"] - r["base_score"] for r in held) > 0.25 * tokens
    assert sum(r["score"] > r["base_score"] for r in held) > 0.9 * len(held)


def test_language_model_of_nothing(spark):
    assert lm.language_model_scores(spark.createDataFrame([], KIND)).count() == 0
    rows = lm.language_model_scores(spark.createDataFrame([(None, "a b"), (1, ""), (1, "")], KIND)).collect()
    assert sorted(r["n_tokens"] for r in rows) == [1, 1, 3]


def test_raking_meets_the_targets():
    rng = random.Random(1)
    cells = {(s, d, t): float(rng.randrange(1, 1000)) for s in "abc" for d in "xy" for t in "pqr"}
    targets = [{"a": 0.5, "b": 0.3, "c": 0.2}, {"x": 0.6, "y": 0.4}, {"p": 0.2, "q": 0.3, "r": 0.5}]
    factors = mixing.rake(cells, targets)
    weighed = {k: n * factors[0][k[0]] * factors[1][k[1]] * factors[2][k[2]] for k, n in cells.items()}
    total = sum(weighed.values())
    for i, target in enumerate(targets):
        for c, share in target.items():
            assert math.isclose(sum(w for k, w in weighed.items() if k[i] == c) / total, share, rel_tol=1e-6)


MIX = "doc_id long, text string, lang string, source string, n_chars long"


def test_mix_samples_by_probability(spark):
    rng = random.Random(2)
    rows = [(i, "tok " * rng.choice([3, 200]), rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b"]), 0) for i in range(4000)] + [(9999, None, None, None, None)]
    df = spark.createDataFrame(rows, MIX).selectExpr("*", "'x' probability", "1 kept")
    targets = {"source": {"a": 0.5, "b": 0.5}}
    got = mixing.mixed(df, targets).collect()
    assert len(got) == len(rows)
    kept = {s: sum(r["n_tokens"] for r in got if r["kept"] and r["source"] == s) for s in "ab"}
    assert abs(kept["a"] / (kept["a"] + kept["b"]) - 0.5) < 0.05
    assert max(r["probability"] for r in got) == 1.0
    sample = mixing.sample_mix(df, targets)
    assert sample.columns == df.columns and {r["doc_id"] for r in sample.collect()} == {r["doc_id"] for r in got if r["kept"]}


def test_mix_edge_cases(spark):
    assert mixing.mixed(spark.createDataFrame([], MIX)).count() == 0
    assert [r["probability"] for r in mixing.mixed(spark.createDataFrame([(1, None, "en", "a", 0)] * 2, MIX)).collect()] == [1.0, 1.0]


def test_mix_with_clashing_columns_and_long_texts(spark):
    rows = [(1, "tok " * 20_000, "en", "a", 0), (2, None, None, None, None), (2, "", "en", "a", 0), (None, "tok", "en", "b", 1)]
    df = spark.createDataFrame(rows, MIX).selectExpr("*", "1 _mix", "2 weight", "3 n_tokens", "4 u", "5 _mix_cell")
    kept = mixing.sample_mix(df)
    want = sorted((r["doc_id"] or 0) for r in mixing.mixed(df).collect() if r["kept"])
    assert kept.columns == df.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == want
    assert mixing.sample_mix(df.limit(0)).count() == 0


def many_sources(n=1500):
    """One source with a third of the tokens and ``n`` equal small ones."""
    big = [(i, "tok " * n, "en", "big", 0) for i in range(2)]
    return big + [(10 + i, "tok " * 4, "en", f"s{i:05}", 0) for i in range(n)]


def test_sources_beyond_a_thousand_are_raked_one_by_one(spark):
    got = mixing.mixed(spark.createDataFrame(many_sources(), MIX).selectExpr("*", "'t' topic")).collect()
    assert len(got) == 1502
    assert {r["probability"] for r in got if r["source"] != "big"} == {1.0} and {r["kept"] for r in got if r["source"] != "big"} == {True}


def test_raking_in_spark_agrees_with_the_driver(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, "tok " * rng.choice([3, 20, 200]), rng.choice(["en", "fr", None]), rng.choice("aaabbc"), 0) for i in range(500)] + [(9999, None, "xx", "z", None)]
    df = spark.createDataFrame(rows, MIX)
    monkeypatch.setattr(mixing, "SWEEPS", 3)
    for targets in (None, {"source": {"a": 0.3, "b": 0.3}}):
        monkeypatch.setattr(mixing, "MAX_CELLS", 10_000)
        want = {r["doc_id"]: r for r in mixing.mixed(df, targets).collect()}
        monkeypatch.setattr(mixing, "MAX_CELLS", 1)
        got = {r["doc_id"]: r for r in mixing.mixed(df, targets).collect()}
        assert got.keys() == want.keys()
        assert all(math.isclose(got[i]["probability"], want[i]["probability"], abs_tol=2e-9) for i in want)


def test_categories_without_a_target_keep_a_share():
    cells = {("a", "x"): 50.0, ("b", "x"): 30.0, ("c", "y"): 10.0, ("d", "y"): 10.0}
    for target, want in (({"a": 0.3, "b": 0.3}, {"a": 0.3, "b": 0.3, "c": 0.2, "d": 0.2}), ({"a": 0.5, "b": 0.5}, {"a": 0.4, "b": 0.4, "c": 0.1, "d": 0.1}), ({"a": 0.6, "c": 0.0}, {"a": 0.6, "b": 0.3, "c": 0.0, "d": 0.1})):
        names = sorted(want)
        with warnings.catch_warnings(record=True) as said:
            warnings.simplefilter("always")
            shares = mixing._shares(names, mixing.np.array([cells[n, "x" if n in "ab" else "y"] for n in names]), target)
        assert all(math.isclose(s, want[n], abs_tol=1e-9) for n, s in zip(names, shares.tolist(), strict=True))
        assert bool(said) == (sum(target.values()) >= 1)


def item(rng, n):
    return [f"v{rng.randrange(2000)}" for _ in range(n)]


def brute_best(words, items):
    known = WordHashes()
    index = decontaminate.ItemIndex(list(items), [" ".join(i).encode() for i in items.values()])
    best = 0.0
    for k, own in enumerate(items.values()):
        length = min(len(own), len(words))
        for start in range(len(words) - length + 1):
            best = max(best, index.similarity(k, shingle_hashes([w.encode() for w in words[start : start + length]], known)))
    return best


def test_contamination_matches_brute_force(spark):
    rng = random.Random(4)
    items = {i: item(rng, rng.choice([12, 30, 50])) for i in range(25)}
    docs = {}
    for i in range(60):
        words = item(rng, rng.choice([8, 60, 300]))
        if i % 2:
            own = list(items[rng.randrange(25)])
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                own[rng.randrange(len(own))] = "edited"
            at = rng.randrange(len(words))
            words[at:at] = own
        docs[i] = words
    docs[100] = items[3][:-1]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()] + [(200, None), (201, " ")], KIND).selectExpr("*", "1 item_id", "2 similarity")
    bench = spark.createDataFrame([(i, " ".join(w).upper()) for i, w in items.items()] + [(None, "x"), (99, None)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.contamination(df, bench).collect()}
    for i, words in docs.items():
        best = brute_best(words, items)
        assert got[i]["contaminated"] == (best >= 0.75), (i, best)
        if got[i]["contaminated"]:
            assert math.isclose(got[i]["similarity"], best, abs_tol=1e-8)
    assert not got[200]["contaminated"] and not got[201]["contaminated"]
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["contaminated"]}


def test_contamination_edge_cases(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "A b  c"), (2, "a b c d e f g"), (2, "a b c d e f g"), (None, "x")], KIND)
    assert sorted((r["doc_id"] or 0, r["contaminated"]) for r in decontaminate.contamination(docs, bench).collect()) == [(0, False), (1, True), (2, True), (2, True)]
    assert decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_short_items_are_found_inside_documents(spark):
    bench = spark.createDataFrame([(1, "one two"), (2, "Solo"), (3, "p q r s"), (4, "one  TWO")], "item_id long, text string")
    texts = {1: "x one two y z w v", 2: "two one x y z w", 3: "one x two", 4: "a b solo", 5: "p q r", 6: "z p q r s z z z", 7: "solo one two"}
    got = {r["doc_id"]: (r["item_id"], r["n_items"]) for r in decontaminate.contamination(spark.createDataFrame(list(texts.items()), KIND), bench).collect()}
    assert got == {1: (1, 2), 2: (None, 0), 3: (None, 0), 4: (2, 1), 5: (None, 0), 6: (3, 1), 7: (1, 3)}
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(spark.createDataFrame(list(texts.items()), KIND), bench).collect()} == {2, 3, 5}


def jaccard_of_strings(item, window, holders, n):
    """Weighted Jaccard by word tuples and plain floats, apart from the operator's own code."""
    grams = lambda ws: Counter(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4)))
    a, b = grams(item), grams(window)
    weight = lambda s: math.log(1 + n / max(1, holders[s]))
    union = sum(weight(s) * max(a[s], b[s]) for s in a.keys() | b.keys())
    return sum(weight(s) * min(a[s], b[s]) for s in a.keys() & b.keys()) / union


def test_contamination_against_an_independent_similarity(spark):
    rng = random.Random(21)
    shared = item(rng, 20)
    items = {i: (shared if i < 4 else []) + item(rng, rng.choice([6, 14, 33])) for i in range(20)}
    holders = Counter(s for own in items.values() for s in {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))})
    docs = {}
    for i in range(80):
        own = list(items[rng.randrange(20)])
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            own[rng.randrange(len(own))] = f"edit{rng.randrange(9)}"
        around = item(rng, 40)
        docs[i] = around[:15] + own + around[15:]
    got = {r["doc_id"]: r["contaminated"] for r in decontaminate.contamination(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], KIND), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")).collect()}
    for i, words in docs.items():
        best = max(jaccard_of_strings(own, words[s : s + len(own)], holders, len(items)) for own in items.values() for s in range(len(words) - len(own) + 1))
        assert abs(best - 0.75) < 1e-9 or got[i] == (best > 0.75), (i, best)
    assert 0 < sum(got.values()) < 80


def test_multi_index_finds_all_within_the_radius():
    import numpy as np

    rng = np.random.default_rng(3)
    index = decontaminate.ItemIndex(list(range(40)), [" ".join(f"q{rng.integers(500)}" for _ in range(30)).encode() for _ in range(40)])
    for k in range(40):
        for distance in (0, 7, decontaminate.RADIUS):
            for f in range(decontaminate.PRINTS):
                probe = ~index.prints[k].reshape(1, -1)
                probe[0, f] = index.prints[k, f] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, distance, replace=False)))
                rows, items = index.near(probe)
                assert k in items.tolist() and set(rows.tolist()) == {0}
    rows, items = index.near(index.prints)
    apart = np.bitwise_count(index.prints[:, None, :] ^ index.prints[None, :, :]).min(axis=2)
    assert set(zip(rows.tolist(), items.tolist(), strict=True)) == {(int(a), int(b)) for a, b in zip(*np.nonzero(apart <= decontaminate.RADIUS), strict=True)}


def test_bits_differ_as_the_angle_says():
    """At similarity 0.75 a bit differs with probability 0.172, for uniform and rare shingles, edits at an end or spread."""
    import numpy as np

    rng = np.random.default_rng(4)
    for weights, sizes in ((np.ones(14), 12), (np.ones(70), 60), (np.array([6.0] * 6 + [1.0] * 34), 40)):
        far = []
        for _ in range(150):
            one, other = (rng.integers(0, 2**63, len(weights), dtype=np.uint64) for _ in range(2))
            scaled = np.rint(weights * decontaminate.UNIT)
            if len(weights) == 40:  # what differs holds a seventh of the weight
                mixed, changed = one.copy(), [0] + list(range(6, 10))
                mixed[changed] = other[changed]
            else:
                mixed = np.concatenate([one[:sizes], other[sizes:]])
            a, b = (decontaminate.fingerprints(x, scaled, len(x))[0] for x in (one, mixed))
            far += np.bitwise_count(a ^ b).tolist()
        assert abs(np.mean(far) / 64 - 0.1724) < 0.012, (sizes, np.mean(far) / 64)


def test_fingerprints_of_runs_with_and_without_repeats():
    import numpy as np

    rng = np.random.default_rng(5)
    for values in (rng.permutation(60), rng.integers(0, 9, 60)):
        shingles = decontaminate.mix64(values.astype(np.uint64))
        weights = np.full(60, decontaminate.UNIT) + values * 1000
        got = decontaminate.fingerprints(shingles, weights, 12)
        for i in (0, 17, 48):
            run = rng.permutation(np.arange(i, i + 12))
            assert (decontaminate.fingerprints(shingles[run], weights[run], 12)[0] == got[i]).all()


def test_candidates_come_from_the_fingerprints(spark, monkeypatch):
    rng = random.Random(4)
    own = item(rng, 40)
    index = decontaminate.ItemIndex([7], [" ".join(own).encode()])
    words = [w.encode() for w in item(rng, 20) + own + item(rng, 20)]
    assert index.best(words, WordHashes()) == (7, 1.0, 1)
    import numpy as np

    monkeypatch.setattr(index, "near", lambda prints: (np.empty(0, int), np.empty(0, int)))
    assert index.best(words, WordHashes()) == (None, 0.0, 0)


def test_truncated_and_reended_items_are_found():
    rng = random.Random(11)
    known = WordHashes()
    items = {i: item(rng, rng.choice([19, 40, 54])) for i in range(400)}
    index = decontaminate.ItemIndex(list(items), [" ".join(i).encode() for i in items.values()])
    reached = 0
    for i, own in items.items():
        cut = {19: 2, 40: 5, 54: 7}[len(own)]
        around = [f"z{rng.randrange(2000)}" for _ in range(60)]
        changed = own[cut:] if i % 3 == 0 else own[:-cut] if i % 3 == 1 else own[:-cut] + item(rng, cut)
        words = around[:30] + changed + around[30:]
        own_only = max(index.similarity(i, shingle_hashes([w.encode() for w in words[s : s + len(own)]], known)) for s in range(len(words) - len(own) + 1))
        got = index.best([w.encode() for w in words], known)
        assert (got[0] == i) == (own_only >= 0.75), (i, own_only, got)
        reached += own_only >= 0.75
    assert reached == 400


def test_verdicts_do_not_depend_on_the_block(spark, monkeypatch):
    rng = random.Random(6)
    template = item(rng, 45)
    items = [(i, " ".join([*template, *(f"own{i}x{j}" for j in range(5))])) for i in range(21)]
    docs = spark.createDataFrame([(1, " ".join([*template, *(f"else{j}" for j in range(5))])), (2, items[20][1]), (3, items[4][1])], KIND)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = []
    for size, chain in ((1000, 8), (20, 1), (6, 2)):
        monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", size)
        monkeypatch.setattr(decontaminate, "CHAIN", chain)
        found.append(sorted(map(tuple, decontaminate.contamination(docs, bench).collect())))
        assert {r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()} == {1}
    assert found[0] == found[1] == found[2] and [r[1] for r in found[0]] == [False, True, True]


def test_exactly_the_threshold_counts_for_any_benchmark_size():
    for words, sizes in ((11, (25, 800)), (18, (30, 120, 400))):
        for n in sizes:
            items = [[f"i{i}w{j}" for j in range(words)] for i in range(n)]
            index = decontaminate.ItemIndex(list(range(n)), [" ".join(i).encode() for i in items])
            changed = [w.encode() for w in items[3]]
            for j in {11: [10], 18: [0, 17]}[words]:
                changed[j] = b"other"
            got = index.best(changed, WordHashes())
            assert got == (3, 0.75, 1)
