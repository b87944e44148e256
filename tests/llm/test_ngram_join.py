"""Operator 6 against all pairs of sets of shingles as tuples of words."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from marlstone.llm import ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, percent=90, k=3):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(range(len(rows)), key=lambda i: len(sets[i]))
    for a, i in enumerate(order):
        for j in order[a + 1 :]:
            if percent * len(sets[j]) > 100 * len(sets[i]):
                break
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def got(docs, **how):
    return Counter(tuple(r) for r in ngram_join.component_ids(docs, **how).select("doc_id", "n_shingles", "component_id").collect())


@pytest.mark.parametrize("which", ["odd_docs", "clash_docs", "no_docs"])
def test_odd_rows(which, request):
    docs = request.getfixturevalue(which)
    assert got(docs) == brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def near_copies(seed, groups, size):
    """Groups of copies with a few words changed, at likeness around the limit, and chains of them."""
    rng = random.Random(seed)
    texts = []
    for g in range(groups):
        n = rng.choice([3, 4, 9, 12, 20, 45, 90, 200, 400])
        base = [f"w{rng.randrange(500)}" for _ in range(n)]
        texts.append(" ".join(base))
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(1 + max(1, n // 25))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                base = copy
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else "  ".join(copy))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [2048, 20])
def test_planted_copies(spark, block):
    rows = near_copies(5, 30, 25)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(docs, block=block) == brute(rows)


def test_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got(docs) == brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_parts_never_lose_a_pair():
    """Two sets that link share a tile, for every size of small sets."""
    rng = np.random.default_rng(3)
    for n in [*range(1, 60), 200, 777]:
        for _ in range(20):
            pool = np.unique(rng.integers(0, 1 << 63, 2 * n + 8, dtype=np.uint64))
            a = np.sort(rng.permutation(pool)[:n])
            drop, add = rng.integers(0, n // 8 + 1), rng.integers(0, n // 8 + 1)
            b = np.sort(np.concatenate([rng.permutation(a)[drop:], rng.permutation(np.setdiff1d(pool, a))[:add]]))
            if len(b) and ngram_join.linked(ngram_join.overlap(a, b), len(a), len(b), 90) and len(np.setxor1d(a, b)):
                assert np.intersect1d(ngram_join.signatures(a, 90), ngram_join.signatures(b, 90)).size
                heavy = np.packbits(rng.random(1 << 15) < 0.3)
                assert np.intersect1d(ngram_join.signatures(a, 90, heavy), ngram_join.signatures(b, 90, heavy)).size
            if len(b) and ngram_join.linked(ngram_join.overlap(a, b), len(a), len(b), 80) and len(np.setxor1d(a, b)):
                assert np.intersect1d(ngram_join.signatures(a, 80), ngram_join.signatures(b, 80)).size


def test_keep_one(spark):
    rows = near_copies(8, 6, 6)
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    kept = {r["doc_id"] for r in ngram_join.keep_one(docs).collect()}
    assert kept == {c for _, _, c in brute(rows)}


def test_keep_one_goes_by_rows(spark):
    """Equal ids on different texts, repeated rows and null ids: one row of each component stays, and no namesake goes."""
    first, second, third, fourth = ("".join(f"{c}{i} " for i in range(60)) for c in "abcd")
    rows = [(1, first), (2, first + "x"), (2, second), (3, third), (3, third), (3, third + "x"), (None, third), (None, fourth), (None, fourth + "x"), (5, ""), (5, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, row_key string").repartition(4)
    left = ngram_join.keep_one(docs)
    assert left.columns == docs.columns
    kept = Counter((r["doc_id"], r["text"]) for r in left.collect())
    nulls = [t for d, t in kept if d is None and t]
    assert len(nulls) == 1 and nulls[0] in (fourth, fourth + "x")
    assert kept == Counter([(1, first), (2, second), (None, nulls[0]), (5, ""), (5, ""), (None, None), *[r for r in kept if r in ((3, third), (3, third + "x"))]])
    assert sum(n for (d, _), n in kept.items() if d == 3) == 1


def test_bitmaps_bound_from_above():
    """Whatever links, by exact sets, is allowed by the bitmaps, of equal and of different widths; a bitmap folds to half its width."""
    rng = np.random.default_rng(11)
    sets = []
    for n in (1, 2, 9, 120, 250, 260, 290, 520, 1100):
        base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for _ in range(6):
            keep = rng.permutation(base)[rng.integers(0, n // 9 + 1) :]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, rng.integers(0, n // 9 + 1), dtype=np.uint64)])))
    sets = [s for s in sets if len(s)]
    sizes, maps = np.array([len(s) for s in sets]), [ngram_join.bitmap(s) for s in sets]
    for side in (None, rng.integers(0, 2, len(sets))):
        label = ngram_join.may_link(sizes, maps, side, 80)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if (side is None or side[i] != side[j]) and ngram_join.linked(ngram_join.overlap(a, b), len(a), len(b), 80):
                    assert label[i] == label[j]
        assert len(np.unique(label)) >= (9 if side is None else 2)
    apart = [np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64)) for _ in range(30)]
    assert len(np.unique(ngram_join.may_link(np.array([len(s) for s in apart]), [ngram_join.bitmap(s) for s in apart], None, 80))) == 30
    grid = ngram_join.bitmap(apart[0])
    assert (np.bitwise_or.reduce(grid.reshape(2, -1), axis=0).sum() > 0) and len(grid) * 64 == ngram_join.width(len(apart[0]))


def test_one_large_set_among_small_ones_takes_bounded_memory():
    rng = np.random.default_rng(12)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (200_000, *[30] * 900)]
    assert ngram_join.bitmaps(sets).nbytes <= ngram_join.BITMAP_BYTES
    assert len(np.unique(ngram_join.connect(sets, None, 90))) == len(sets)


def near_groups(groups, copies):
    """Sets of any sizes in random order, and the group of each: those of a group link at 80 %, those of different ones have nothing in common."""
    rng = np.random.default_rng(13)
    made = []
    for g in range(groups):
        base = np.unique(rng.integers(0, 1 << 63, int(rng.integers(60, 900)), dtype=np.uint64))
        made += [(g, np.delete(base, i)) for i in range(copies)]
    made = [made[i] for i in rng.permutation(len(made))]
    return np.array([g for g, _ in made]), [s for _, s in made]


def test_a_label_is_the_place_of_a_member():
    group, sets = near_groups(12, 5)
    sizes, maps = np.array([len(s) for s in sets]), [ngram_join.bitmap(s) for s in sets]
    label = ngram_join.may_link(sizes, maps, None, 80)
    assert (group[label] == group).all() and (label[label] == label).all() and len(np.unique(label)) == 12


@pytest.mark.parametrize("block", [2, 2048])
def test_refining_joins_no_strangers(spark, block):
    group, sets = near_groups(12, 5)
    rows = [(i, len(s), bytearray(ngram_join.bitmap(s).tobytes())) for i, s in enumerate(sets)]
    maps = spark.createDataFrame(rows, "node long, n long, bits binary")
    candidates = spark.createDataFrame([(i, 0) for i in range(len(sets))], "node long, root long")
    found = {r["node"]: r["root"] for r in ngram_join.refined(candidates, maps, 80, block).collect()}
    assert len(found) == len(sets)
    assert Counter(Counter(found.values()).values()) == Counter({5: 12})
    assert all(group[node] == group[root] for node, root in found.items())
