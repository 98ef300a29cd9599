import random

import numpy as np
import pyarrow as pa
import pytest

from driftwell.llm import bagminhash as b


def bag(text):
    w = (text or "").split()
    k = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
    out = {}
    for x in k:
        out[x] = out.get(x, 0) + 1
    return out


def jaccard(x, y):
    keys = set(x) | set(y)
    return sum(min(x.get(k, 0), y.get(k, 0)) for k in keys) / max(1, sum(max(x.get(k, 0), y.get(k, 0)) for k in keys))


def brute(rows):
    """doc_id -> smallest id of its component, over all pairs."""
    bags = [(i, bag(t), " ".join((t or "").split())) for i, t in rows]
    root = {i: i for i, _, _ in bags}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(bags)):
        for c in range(a):
            (i, x, s), (j, y, t) = bags[a], bags[c]
            if s == t or (x and y and jaccard(x, y) >= 0.8):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i, _, _ in bags}


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=3):
    rng, rows = random.Random(seed), []
    shared = words(rng, 60)
    for k in range(40):
        base = words(rng, rng.randrange(1, 150))
        rows.append(base)
        for _ in range(rng.randrange(0, 6)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(50))
            rows.append(w)
    rows += [words(rng, 30) + shared + words(rng, 10) for _ in range(60)]  # a passage that many share
    rows += [shared + words(rng, 8) for _ in range(20)]  # and makes up most of others
    rows += [["again"] * n for n in (5, 20, 24, 25, 26, 60)]  # weights matter here
    text = [" ".join(w) for w in rows] + ["", "  \n", None, "one", "one ", "one two", "x " * 3000]
    ids = list(range(len(text)))
    rng.shuffle(ids)
    return list(zip(ids, text, strict=True))


@pytest.mark.parametrize("block", [1_500_000, 150])
def test_classes_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(b, "BLOCK", block)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", 1, True) for i, t in rows], "doc_id long, text string, bands string, class_id long, kept boolean")
    got = {r["doc_id"]: r for r in b.near_classes(docs).collect()}
    want = brute(rows)
    assert {i: r["class_id"] for i, r in got.items()} == want
    sizes = {c: sum(v == c for v in want.values()) for c in want.values()}
    assert all(r["class_size"] == sizes[r["class_id"]] and r["kept"] == (i == r["class_id"]) for i, r in got.items())


def test_chains_longer_than_a_star(spark):
    base = [f"t{i}" for i in range(200)]
    rows = []
    for k in range(8):  # each is similar to the next only
        w = list(base)
        for j in range(k):
            w[5 + 24 * j] = f"new{j}"
        rows.append((10 - k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in b.near_classes(docs).collect()} == brute(rows)


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "only null"), (7, None), (8, "")]
    got = b.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["class_id"] or -1, r["class_size"], r["kept"]) for r in got) == [(-1, -1, 1, True), (-1, 4, 3, False), (4, 4, 3, False), (4, 4, 3, True), (7, 7, 2, True), (8, 7, 2, False)]
    assert b.near_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    kept = b.drop_near_copies(spark.createDataFrame([(4, "a b c d e f", 1), (4, "a b c d e f", 1), (5, "a b c d e f", 2)], "doc_id long, text string, _c int"))
    assert [tuple(r) for r in kept.collect()] == [(4, "a b c d e f", 1)]


def test_rows_are_known_by_id_and_words(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, "first null"), (None, "second null"), (None, "third  null"), (None, "a b c d e f"), (3, "a b c d e f"), (5, "x y z"), (5, "p q r s t u v"), (5, "x  y z"), (6, "p q r s t u v"), (8, long), (8, long + " more"), (2, "zz " + long), (2, "other words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = b.near_classes(docs).collect()
    assert sorted((r["doc_id"] or -1, r["class_id"] or -1, r["class_size"], r["kept"]) for r in got) == [
        *[(-1, -1, 1, True)] * 3, (-1, 3, 2, False), (2, 2, 1, True), (2, 2, 3, True), (3, 3, 2, True),
        (5, 5, 2, False), (5, 5, 2, True), (5, 5, 2, True), (6, 5, 2, False), (8, 2, 3, False), (8, 2, 3, False),
    ]
    kept = sorted((r["doc_id"] or -1, " ".join(r["text"].split())) for r in b.drop_near_copies(docs).collect())
    assert kept == [(-1, "first null"), (-1, "second null"), (-1, "third null"), (2, "other words"), (2, "zz " + long), (3, "a b c d e f"), (5, "p q r s t u v"), (5, "x y z")]


def test_signatures_are_unbiased():
    m = 2000
    sets = [np.array([[1, 3], [2, 1], [3, 7], [4, 1]]), np.array([[1, 5], [2, 1], [3, 4], [9, 2]])]
    text = np.repeat([0, 1], 4)
    rows = np.vstack(sets)
    shingle = b._mix(rows[:, 0].astype(np.uint64) * b._A)
    sig = b.bag_minhash(text, shingle, rows[:, 1], 2, m)
    exact = (3 + 1 + 4) / (5 + 1 + 7 + 1 + 2)
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.04


def test_shingles_sort_and_count():
    v, at, d = b.shingles(pa.array(["a b c d e a b c d e a b c d e", "a b", " a  b ", None, "\t"]))
    assert at.tolist() == [0, 11, 12, 13, 13, 13] and v[11] == v[12] and d[1] == d[2] and d[3] == d[4]
    t, s, c = b._counted(v, at)
    assert sorted(c[t == 0].tolist()) == [2, 2, 2, 2, 3]
