"""Operator 5 against a walk that takes one step at a time."""

import hashlib
import random
import string

import numpy as np
import pytest

from marlstone.llm import edit_prints as ep


def slow_print(text):
    """Writes the whole embeddings down, step by step, then samples them."""
    samples = []
    for jump in ep.JUMP:
        embedding = []
        for c in text:
            h = int(ep.mix(np.array([ord(c) + 1], np.uint64))[0])
            kind, digit = (h >> 58) % ep.CLASSES, "0123456789abcdef"[h & 15]
            moved = False
            while not moved:
                moved = jump[kind * ep.PERIOD + len(embedding) % ep.PERIOD] == 1
                embedding.append(digit)
        samples.append("".join(embedding[p] for p in ep.PLACES.tolist() if p < len(embedding)))
    return "-".join(samples) if text else ""


def texts_of(seed, n, longest):
    rng = random.Random(seed)
    return ["".join(rng.choice(string.ascii_lowercase + "  é\U0001f389") for _ in range(rng.randrange(longest))) for _ in range(n)]


def test_prints_equal_the_slow_walk():
    texts = ["", "a", "ab", *texts_of(1, 60, 700), *texts_of(2, 4, 9000)]
    got = ep.fingerprints(texts)
    assert [ep.written(g) for g in got] == [slow_print(t) for t in texts]
    assert [ep.written(ep.fingerprints([t])[0]) for t in texts] == [ep.written(g) for g in got], "the group doesn't matter"


def test_likeness_follows_edits():
    rng = random.Random(4)
    base = texts_of(3, 40, 4000)
    base = [t for t in base if len(t) > 500]
    near, banded = [], 0
    for t in base:
        other = list(t)
        other.insert(rng.randrange(len(other)), "q")
        del other[rng.randrange(len(other))]
        a, b = ep.fingerprints([t, "".join(other)])
        near.append(ep.likeness(a, b))
        banded += bool(set(ep.bands(a)) & set(ep.bands(b)))
    assert sorted(near)[len(near) // 4] > 0.8 and banded > 0.9 * len(base)
    prints = ep.fingerprints(base)
    assert max(ep.likeness(x, y) for i, x in enumerate(prints) for y in prints[:i]) < 0.4


def brute(rows):
    rows = sorted(rows, key=lambda r: (ep.FIRST if r[0] is None else r[0], ep.hash_bytes((r[1] or "").encode(), 0)))
    out = []
    for i, (d, t) in enumerate(rows):
        t, after = t or "", rows[i - 1][1] or ""
        k = len(t) // 3
        e = t[: len(t) - k] + after[:k]
        prints = [ep.parsed(slow_print(x)) for x in (t, e, after)]
        near = [round(ep.likeness(prints[0], p), 9) for p in prints[1:]]
        out.append((str(d), len(t), hashlib.sha256(e.encode()).hexdigest(), slow_print(t), slow_print(e), *near))
    return sorted(out)


@pytest.mark.parametrize("which", ["odd_docs", "clash_docs", "no_docs"])
def test_odd_rows(which, request):
    docs = request.getfixturevalue(which)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = sorted((str(r[0]), *r[1:5], round(r[5], 9), round(r[6], 9)) for r in ep.print_with_edits(docs).collect())
    assert got == brute(rows)


def test_ranges_and_groups(spark, monkeypatch):
    monkeypatch.setattr(ep, "GROUP_CHARS", 900)
    rows = list(enumerate(texts_of(9, 150, 300)))
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([*rows, *rows[:5]], "doc_id long, text string").repartition(6)
    got = sorted((str(r[0]), *r[1:5], round(r[5], 9), round(r[6], 9)) for r in ep.print_with_edits(docs).collect())
    assert got == brute([*rows, *rows[:5]])


def test_plain_prints(spark):
    rows = [(1, "some text"), (2, "some text"), (3, None)]
    got = {r["doc_id"]: r for r in ep.print_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["fingerprint"] == got[2]["fingerprint"] == slow_print("some text") and got[1]["bands"] == got[2]["bands"]
    assert got[3]["fingerprint"] == "" and got[3]["bands"] == []


def test_near_duplicates(spark):
    rng = random.Random(6)
    rows, group = [], {}
    for g in range(12):
        base = texts_of(100 + g, 1, 3000)[0] + "filled up " * 30
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            if rng.random() < 0.7:
                copy[rng.randrange(len(copy) * 2 // 3, len(copy))] = "Q"
            group[len(rows)] = g
            rows.append((len(rows), "".join(copy)))
    got = {r["doc_id"]: r["class_id"] for r in ep.near_duplicates(spark.createDataFrame([*rows, (None, "x"), (900, None), (901, "")], "doc_id long, text string")).collect()}
    want = {d: min(e for e in group if group[e] == g) for d, g in group.items()}
    assert {d: got[d] for d in want} == want and got[900] == got[901] == 900 and None not in got


def test_bands_cover_the_whole_print():
    """Each sample is in a band, whichever octave it is in: changing it changes one."""
    for text in ("a", "abc", *texts_of(12, 3, 1500)):
        (p,) = ep.fingerprints([text])
        for walk, a in enumerate(p):
            for k in range(len(a)):
                other = a.copy()
                other[k] = ord("0") if a[k] != ord("0") else ord("1")
                assert len(set(ep.bands(p)) ^ set(ep.bands((*p[:walk], other, *p[walk + 1 :])))) == 2


@pytest.mark.parametrize("block", [ep.BLOCK, 3])
def test_groups_with_a_long_head(spark, block):
    """Texts that share their first 600 characters, and near copies among them: the smallest id is like none of the rest."""
    rng = random.Random(21)
    letters = lambda n: "".join(rng.choice(string.ascii_lowercase + "  ") for _ in range(n))
    head, rows, group = letters(600), [], {}
    for g in range(8):
        rest = letters(380)
        for k in range(1 if g == 0 else 3):
            group[len(rows)] = g
            rows.append((len(rows), head + rest[:-1] + "QRS"[k]))
    prints = [ep.fingerprints([t])[0] for _, t in rows]
    assert len({ep.written(p) for p in prints[1:4]}) > 1
    want = {}
    for d, p in enumerate(prints):
        # Groups are not alike with each other; all in one are with its first.
        want[d] = min(e for e in group if group[e] == group[d])
        assert all((ep.likeness(p, q) >= 0.8) == (group[d] == group[e]) for e, q in enumerate(prints))
    got = {r["doc_id"]: r["class_id"] for r in ep.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block=block).collect()}
    assert got == want


def test_connect_equals_likeness():
    rng = random.Random(8)
    prints = []
    for base in texts_of(31, 12, 600):
        for _ in range(5):
            copy = list(base or "x")
            for _ in range(rng.randrange(8)):
                copy[rng.randrange(len(copy))] = "z"
            prints.append(ep.fingerprints(["".join(copy[: len(copy) - rng.randrange(len(copy) // 5 + 1)])])[0])
    for side in (None, np.array([rng.randrange(2) for _ in prints])):
        root = list(range(len(prints)))
        for i in range(len(prints)):
            for j in range(i):
                if (side is None or side[i] != side[j]) and ep.likeness(prints[i], prints[j]) >= 0.8:
                    root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
        assert ep.connect(prints, side, 0.8).tolist() == root


def test_a_row_for_each_row(spark):
    """Two texts under one id, of which each has a near copy of its own."""
    one, two = ("".join(t) for t in (["first "] * 3 + texts_of(17, 1, 3000), ["other "] * 3 + texts_of(18, 1, 3000)))
    rows = [(5, one), (5, two), (5, two), (7, one[:-1] + "Q"), (8, two[:-1] + "Q"), (9, "alone")]
    got = sorted(tuple(r) for r in ep.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted((d, len(t), 9 if d == 9 else 5) for d, t in rows)
