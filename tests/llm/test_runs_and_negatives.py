"""Periodic runs and hard negatives against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from frameloom.llm import hard_negatives, periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w, least=6, exponent=4):
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if size >= max(least, exponent * q) and not any(all(w[i + k] == w[i + k + p] for k in range(size - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = j
    return sorted(out)


def repetitive(r, n):
    w, letters = [], "abcdefg"[: r.choice([1, 2, 2, 3, 5])]
    while len(w) < n:
        w += [r.choice(letters) for _ in range(r.randint(1, 9))] * r.choice([1, 1, 2, 3, 4, 5, 7])
    return w


@pytest.mark.parametrize("least, exponent", [(6, 4), (4, 3), (10, 5)])
def test_runs_equal_brute_force(least, exponent):
    r = random.Random(least)
    for _ in range(600):
        w = [x.encode() for x in repetitive(r, r.randint(0, 80))]
        assert periodic_runs.periodic_runs_of(w, least, exponent) == brute_runs(w, least, exponent)


def test_the_automaton_needs_no_narrowing():
    r = random.Random(9)
    for _ in range(200):
        w = repetitive(r, r.randint(6, 60))
        assert periodic_runs.runs_of([ord(x) for x in w], 6, 4) == brute_runs(w)


def test_long_periods_and_large_sets():
    one, many = [b"x"] * 30_000, [str(k).encode() for k in range(700)] * 9
    assert periodic_runs.periodic_runs_of(one) == [(0, 30_000, 1)]
    assert periodic_runs.periodic_runs_of([b"a", *many, b"b"]) == [(1, 6300, 700)]


def test_ends_keep_order_over_blocks():
    r, ends, plain = random.Random(2), periodic_runs.Ends(0), [0]
    for x in r.sample(range(1, 50_000), 9_000):
        ends.add(x)
        plain.append(x)
    plain.sort()
    assert list(ends) == plain and ends.size == len(plain)
    for k in range(1, len(plain) - 1, 37):
        assert ends.around(plain[k]) == (plain[k - 1], plain[k + 1])
    assert ends.around(plain[0])[0] is None and ends.around(plain[-1])[1] is None


def expected_runs(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute_runs(w)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return doc_id, len(runs), *best, milli, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def test_op11_equals_brute_force(spark, tmp_path):
    r = random.Random(3)
    texts = [" ".join(repetitive(r, r.randint(1, 70))) for _ in range(150)] + ["", None, " \t", "é\x0bé é\n é é é é", "a " * 9, "one two  three"]
    ids = [*range(len(texts) - 3), None, 7, 7]
    rows = [(i, t, "en", "s", 1) for i, t in zip(ids, texts, strict=True)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic_runs.op11(spark, str(tmp_path)).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, got), key=key) == sorted((expected_runs(i, t) for i, t in zip(ids, texts, strict=True)), key=key)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in ids) > 5


def test_runs_keep_other_columns_and_take_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b " * 5, 9, "x")], "doc_id long, text string, runs int, _own string")
    got = periodic_runs.periodic_runs(docs)
    assert got.columns == ["doc_id", "text", "_own", "n_words", "runs", "collapsed"]
    row = got.first()
    assert [tuple(x) for x in row.runs] == [(0, 10, 2)] and row.collapsed == "a b" and row._own == "x"
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="narrowed"):
        periodic_runs.periodic_runs(docs, least=3)


def brute_negatives(rows):
    out = []
    for a, la, ya in rows:
        if a % 100:
            continue
        dot = lambda y: sum(p * q for p, q in zip(ya, y))  # noqa: B023, B905, E731
        scored = sorted((-dot(y), b, lb == la) for b, lb, y in rows if b != a)
        for s, b, _ in [x for x in scored if x[2]][:5]:
            near = [(t, c) for t, c, same in scored if not same and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(a, b, k + 1, c, -s, -t) for k, (t, c) in enumerate(near[:5])]
    return sorted(out)


def vectors(n, size, spread, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, size))
    x = centres[r.integers(0, 12, n)] + spread * r.normal(size=(n, size))
    return [(int(i), int(label), [float(c) for c in v]) for i, label, v in zip(r.permutation(4 * n)[:n], r.integers(0, 10, n), x.round(3), strict=True)]


@pytest.mark.parametrize("size, spread", [(8, 0.3), (5, 2.0), (16, 0.0)])
def test_op12_equals_brute_force(spark, tmp_path, monkeypatch, size, spread):
    """Waves and blocks far smaller than what the tables hold; spread 0 gives many equal vectors, so ties."""
    monkeypatch.setattr(hard_negatives, "WAVE", 4)
    rows = vectors(900, size, spread, size)
    odd = [(100, None, [1.0] * size), (200, 1, None), (301, 1, [float("nan")] * size), (400, 2, [1.0, None]), (501, 1, [float("inf")] * size), (603, 1, []), (704, 3, [1e12] * size)]
    kept = {i: (i, label, v) for i, label, v in rows if i not in {o[0] for o in odd}}
    table = [*kept.values(), *odd, *list(kept.values())[:50]]
    spark.createDataFrame([(*x, "other") for x in table], "vec_id long, label int, embedding array<float>, score string").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    whole = [(i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, label, v in kept.values()]
    got = hard_negatives.op12(spark, str(tmp_path))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(whole)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 10


def test_bounds_hold_whatever_the_centres():
    r = np.random.default_rng(1)
    sample, y, a = r.integers(-9, 9, (40, 10)), r.integers(-4000, 4000, (500, 10)), r.integers(-300, 300, (30, 10))
    q = hard_negatives.Quantiser(sample.astype(float), 10)
    codes, rests = q.coded(y.astype(float))
    tables, norms = q.tables(a)
    lower, upper = hard_negatives.bounds(tables, norms, codes, rests)
    exact = a @ y.T
    assert (lower <= exact).all() and (exact <= upper).all()


def test_bounds_leave_few_candidates():
    """On clustered vectors the bounds are a fraction of the spread of scores."""
    r = np.random.default_rng(4)
    y = np.floor(256 * (r.normal(size=(20, 16))[r.integers(0, 20, 4000)] + 0.1 * r.normal(size=(4000, 16)))).astype(np.int64)
    q = hard_negatives.Quantiser(y[:2000].astype(float), 16)
    tables, norms = q.tables(y[:50])
    lower, upper = hard_negatives.bounds(tables, norms, *q.coded(y.astype(float)))
    reach = hard_negatives.kth_largest(lower, 5)
    assert (upper >= reach[:, None]).mean() < 0.1


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, label long, y array<long>")
    assert hard_negatives.hard_negatives(empty, empty).count() == 0
    one = spark.createDataFrame([(100, 1, [2, 3])], "vec_id long, label long, y array<long>")
    assert hard_negatives.hard_negatives(one, one).count() == 0
