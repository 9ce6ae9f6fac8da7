import math
import random
import re

from quillmark.llm import minhash


def sets_of(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    sets = [sets_of(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return sorted((d, len(sets[i]), least[top(i)], d == least[top(i)]) for i, (d, _) in enumerate(rows))


def got(spark, rows):
    return sorted(tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_matches_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for family in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 40, 120]))]
        for _ in range(rng.choice([1, 2, 9, 40])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) * 3 + 1, "  ".join(copy)))
    rows += [(5000, ""), (5001, None), (5002, " \t\n"), (5003, "A b"), (5004, "a B"), (5005, "a")]
    rng.shuffle(rows)
    assert got(spark, rows) == brute(rows)


def test_edge_cases(spark):
    assert got(spark, []) == []
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "x y z"), (2, "x y z")]
    assert got(spark, rows) == [(1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 1, 1, False)]
    df = spark.createDataFrame([(None, "p q r s t"), (7, "p q r s t u")], "doc_id long, text string").selectExpr("*", "1 node", "'x' digest", "2 label")
    rows = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()}
    assert rows == {None: (1, None, True), 7: (2, 7, True)}


def test_stated_probabilities_of_a_miss():
    def tail(n, p, ks):
        return sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)) for k in ks)

    stated = [float(x.rstrip(".")) for x in re.findall(r"probability\s+below\s+(\S+)", minhash.__doc__)]
    places = minhash.SKETCH_PLACES
    assert len(stated) == 2
    assert tail(minhash.COORDINATES, 0.75, range(minhash.MATCHES)) < stated[0]
    assert tail(places, 0.125, range(minhash._most_bits(75) + 1, places + 1)) < stated[1]


def test_pairs_stay_in_proportion_to_a_group_of_near_copies(spark, monkeypatch):
    words = [f"w{i}" for i in range(5000)]
    counts, write = [], minhash.materialize

    def counting(df, name):
        out = write(df, name)
        if name == "pairs":
            counts.append(out.count())
        return out

    monkeypatch.setattr(minhash, "materialize", counting)
    per_document = []
    for n in (300, 1200):
        rng, rows = random.Random(5), []
        base = [rng.choice(words) for _ in range(120)]
        for i in range(n):
            copy = list(base)
            for _ in range(2):
                copy[rng.randrange(120)] = rng.choice(words)
            rows.append((i, " ".join(copy)))
        counts.clear()
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        assert minhash.near_duplicates(df).filter("component_id <> 0").isEmpty()
        per_document.append(sum(counts) / n)
    assert per_document[1] <= per_document[0] * 1.1


def test_group_that_straddles_the_threshold(spark):
    rng, rows = random.Random(6), []
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(120)]
    for i in range(150):
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(120)] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    assert got(spark, rows) == brute(rows)
