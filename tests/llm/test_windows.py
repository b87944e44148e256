"""Operator 7 against windows as tuples of words, over all documents."""

import hashlib
import random
import re
from collections import Counter

import pytest

from marlstone.llm import windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size):
    words = [WORD.findall(t or "") for _, t in rows]
    ids = [float("inf") if d is None else d for d, _ in rows]
    least = {}
    for d, w in zip(ids, words):
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            least[k] = min(d, least.get(k, d))
    out = Counter()
    for (name, _), d, w in zip(rows, ids, words):
        gone = set()
        for i in range(len(w) - size + 1):
            if least[tuple(w[i : i + size])] < d:
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[name, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def got(docs, size):
    out = Counter()
    for r in windows.dedup_windows(docs, size=size).select("doc_id", "n_words", "n_removed", "intervals", "kept").collect():
        out[r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()] += 1
        spans = [(x["start"], x["end"]) for x in r["intervals"]]
        assert sum(b - a for a, b in spans) == r["n_removed"]
        assert all(x[1] < y[0] for x, y in zip(spans, spans[1:])), "intervals are as long as can be"
    return out


@pytest.mark.parametrize("which", ["odd_docs", "clash_docs", "no_docs"])
@pytest.mark.parametrize("size", [1, 3, 50])
def test_odd_rows(which, size, request):
    docs = request.getfixturevalue(which)
    assert got(docs, size) == brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], size)


def test_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert got(docs, 50) == brute(rows, 50)


def test_planted_passages(spark):
    rng = random.Random(2)
    shared = [[f"s{rng.randrange(40)}" for _ in range(rng.randrange(8, 40))] for _ in range(12)]
    rows = []
    for d in range(300):
        w = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(shared)
        rows.append((d if rng.random() < 0.9 else d // 2, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for size in (2, 7, 12):
        assert got(docs, size) == brute(rows, size)


def test_more_halves_than_a_filter_holds(spark, monkeypatch):
    """The join in the filter's place gives the same."""
    monkeypatch.setattr(windows.bitfilter, "holds", lambda n: False)
    rng = random.Random(4)
    shared = [f"s{i}" for i in range(30)]
    rows = [(d, " ".join([f"w{rng.randrange(9)}" for _ in range(20)] + shared[d % 7 :])) for d in range(40)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 8) == brute(rows, 8)
