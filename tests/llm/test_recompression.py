"""Passages of earlier documents, removed by recompression, against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from frameloom.llm import recompression
from frameloom.llm.token_store import mixed

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, window=50):
    """(doc_id, n_words, n_removed, kept_sha256) of rows (doc_id, text)."""
    order = lambda i: (1 << 63) - 1 if i is None else i
    texts, first = [(i, WORD.findall(t or "")) for i, t in rows], {}
    for i, w in texts:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, order(i)), order(i))
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < order(i):
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n, letters="abcdefgh"):
    """Documents that share passages of 30 to 200 words, some cut, some repeated, some periodic."""
    r = random.Random(seed)
    text = lambda k: [r.choice(letters) + r.choice(letters) for _ in range(k)]
    passages = [text(r.randint(30, 200)) for _ in range(6)] + [["xx"] * 120, ["aa", "bb"] * 70, ["p", "q", "r"] * 60]
    out = []
    for _ in range(n):
        w = text(r.randint(0, 40))
        for _ in range(r.randint(0, 4)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 2)
            w += p[a : a + r.randint(40, 200)] + text(r.choice([0, 0, 1, 30]))
        out.append(r.choice([" ", "  ", "\n"]).join(w))
    return out


def on_spark(spark, tmp_path, rows):
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, recompression.op13(spark, str(tmp_path)).collect()), key=str)


@pytest.mark.parametrize("many", [500, 3])
def test_op13_equals_brute_force(spark, tmp_path, monkeypatch, many):
    """With anchors of few phrases alone, and with ones of many."""
    monkeypatch.setattr(recompression, "HOT_ROWS", many)
    texts = corpus(1, 60) + ["", None, " \n", "é " * 60, "é " * 49, "é " * 50 + "end"]
    ids = random.Random(2).sample(range(500), len(texts) - 1) + [None]
    rows = list(zip(ids, texts, strict=True))
    want = brute(rows)
    assert on_spark(spark, tmp_path, rows) == want and sum(x[2] > 0 for x in want) > 20


def test_rows_of_one_document(spark, tmp_path):
    """Equal rows, several texts of one doc_id and of none, and one doc_id with a third of all rows."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(120)) for x in "abc")
    rows = [(3, a), (3, a), (3, f"new {a}"), (5, f"{a} {b}"), (5, b), (None, b), (None, c), (None, f"{c} {a}"), (9, c[:200])] + [(7, f"{b} {k % 5}") for k in range(300)]
    assert on_spark(spark, tmp_path, rows) == brute(rows)


def test_many_equal_rows_are_one_phrase_each(spark):
    text = " ".join(f"w{k}" for k in range(300))
    docs = spark.createDataFrame([(1, text)] + [(2, text)] * 2000, "doc_id long, text string").repartition(4)
    got = recompression.earlier_windows(docs).collect()
    assert len(got) == 1 and got[0].id == 2
    assert sorted(x.place for x in got[0].phrases) == sorted({x.place for x in got[0].phrases}) and len(got[0].phrases) < 251


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "k", 0), (2, None, 6, "l", 1)], "doc_id long, text string, n_words int, key string, id int")
    got = recompression.without_earlier_windows(docs)
    assert got.columns == ["doc_id", "text", "key", "id", "n_words", "n_removed", "kept", "kept_sha256"]
    assert sorted((r.doc_id, r.key, r.id, r.n_words, r.kept) for r in got.collect()) == [(1, "k", 0, 2, "a b"), (2, "l", 1, 0, "")]
    assert recompression.without_earlier_windows(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="bits"):
        recompression.without_earlier_windows(docs, 64)


def names(w):
    return mixed(np.array([hash(x) & 0xFFFFFFFF for x in w], np.uint64), 1)


def walled(w):
    return np.concatenate([[np.uint64(1)], names(w), [np.uint64(2)]]), np.array([True] + [False] * len(w) + [True])


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdefgh"])
def test_equal_windows_have_equal_anchors(letters):
    """Whatever stands around them, and wherever a part of a long text begins."""
    r, window, seen = random.Random(len(letters)), 20, {}
    for _ in range(60):
        w = [r.choice(letters) for _ in range(r.randint(20, 120))]
        w[r.randrange(len(w)) :] = w[: r.randint(0, len(w))]
        if len(w) < window:
            continue
        first, name, which = recompression.anchors(*walled(w), window, 4)
        assert first.tolist() == list(range(1, len(w) - window + 2))
        for i, n, at in zip(first.tolist(), name.tolist(), which.tolist(), strict=True):
            level, place = at % 5, at // 5 - i
            assert seen.setdefault(tuple(w[i - 1 : i - 1 + window]), (n, level, place)) == (n, level, place)


def test_symbols_of_a_substring_are_the_same_inside():
    r = random.Random(8)
    w = [r.choice("abcd") for _ in range(400)]
    whole, part = recompression.levels(*walled(w), 5), recompression.levels(*walled(w[150:250]), 5)
    for one, two in zip(whole, part, strict=True):
        inside = {(int(s) - 150, int(e) - 150, int(n)) for s, e, n, low, high in zip(one.start, one.end, one.name, one.low, one.high, strict=True) if low > 150 and high <= 251}
        assert inside <= {(int(s), int(e), int(n)) for s, e, n in zip(two.start, two.end, two.name, strict=True)} and inside
    assert max(whole[-1].end - whole[-1].start) > 4


def test_long_texts_are_cut_into_overlapping_parts(monkeypatch):
    """Each window is in one part, and its anchor is that of the whole text."""
    monkeypatch.setattr(recompression, "BLOCK", 64)
    r, window = random.Random(5), 20
    texts = [[r.choice("abc") for _ in range(n)] for n in (0, 19, 20, 64, 83, 84, 300, 5)]
    number = np.cumsum([0, *map(len, texts)])
    seen = []
    for parts in recompression._parts(number, window):
        for t, a, b in parts:
            assert number[t] <= a < b <= number[t + 1] and b - a <= 64 + window - 1
            own = texts[t][a - number[t] : b - number[t]]
            first, name, _ = recompression.anchors(*walled(own), window, 4)
            seen += [(t, int(a - number[t] + i - 1), int(n)) for i, n in zip(first, name, strict=True)]
    want = [(t, int(i - 1), int(n)) for t, w in enumerate(texts) if len(w) >= window for i, n in zip(*recompression.anchors(*walled(w), window, 4)[:2], strict=True)]
    assert sorted(seen) == sorted(want) and len(seen) == sum(max(0, len(w) - window + 1) for w in texts)


def test_words_of_joined_texts():
    texts = ["a bc", "d", "", " e  f ", "gh"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *map(len, texts)])
    start, end, number = recompression.word_spans(np.frombuffer(data, np.uint8), offsets)
    assert [data[a:b].decode() for a, b in zip(start, end, strict=True)] == ["a", "bc", "d", "e", "f", "gh"]
    assert number.tolist() == [0, 2, 3, 3, 5, 6]
