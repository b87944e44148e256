"""What the operators share: words and their hashes, tables, filters, components, shared folders."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from marlstone.llm import bitfilter, common
from marlstone.llm.components import components, forest
from marlstone.llm.wordhash import Memo, Words, text_groups

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_words(kind):
    texts = ["", " ", None, "a", " ab  c\n", "é x\ty", "A.b, c.", "x" * 4000, "tail"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(texts, kind)], ["t"]).slice(1)
    texts = texts[1:]
    for limit in (1, 10, 10**6):
        at = 0
        for part, data, bounds in text_groups([batch], "t", limit):
            w = Words(data, bounds)
            raw = data.tobytes()
            for i in range(part.num_rows):
                own = slice(w.bounds[i], w.bounds[i + 1])
                got = [raw[a:b] for a, b in zip(w.start[own], w.end[own])]
                assert got == WORD.findall((texts[at] or "").encode())
                at += 1
        assert at == len(texts)


def hashes(text, **how):
    data = np.frombuffer(text.encode(), np.uint8)
    return Words(data, np.array([0, len(data)]), **how).hash.tolist()


def test_hashes_know_nothing_of_place():
    assert hashes("ab cd ab")[0] == hashes("zzz   ab")[1] == hashes("ab cd ab")[2]
    assert len(set(hashes("ab ba a b aa bb abab"))) == 7
    assert hashes("Ab É", lower=True) == hashes("aB É", lower=True) != hashes("aB é", lower=True)
    parts = hashes("end. é, x., 5. . ab.c")
    assert hashes("end. é, x., 5. . ab.c", marks=True) == [*hashes("end . é ,"), *hashes("x.,"), *hashes("5 . . ab.c")] and len(parts) == 6


def test_memo():
    rng = np.random.default_rng(1)
    memo, known = Memo(4), {}
    for _ in range(30):
        h = np.unique(rng.integers(1, 1 << 63, 200, dtype=np.uint64) * np.uint64(2))
        h = np.concatenate([h, np.array(list(known)[:50], np.uint64)])
        got = memo.find(h)
        assert got.tolist() == [known.get(x, -1) for x in h.tolist()]
        new = np.unique(h[got < 0])
        known.update(zip(new.tolist(), range(len(known), len(known) + len(new))))
        memo.add(new)


def roots(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def graphs():
    rng = random.Random(5)
    yield [(i, i + 1) for i in range(70)]
    yield [(0, i) for i in range(1, 60)] + [(100 + i, 100 + (i * 7 + 1) % 50) for i in range(50)]
    for _ in range(3):
        yield [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(55)]


def test_forest():
    for edges in graphs():
        a, b = forest(*np.array(edges, np.int64).T)
        want = {x: r for x, r in roots(edges).items() if x != r}
        assert dict(zip(a.tolist(), b.tolist())) == want


def test_components(spark):
    for edges in graphs():
        got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: r for x, r in roots([e for e in edges if e[0] != e[1]]).items()}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_filter_has_all_that_went_in(spark):
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    grid = bitfilter.build(spark.createDataFrame([(int(x),) for x in h.view(np.int64)], "h long"), "h", 1 << 17)
    assert len(grid) == 1 << 14 and bitfilter.may_have(grid, h).all()
    assert bitfilter.may_have(grid, rng.integers(0, 1 << 63, 3000, dtype=np.uint64)).mean() < 0.02


def test_names_and_folders(spark):
    assert common.fresh("a", ["A", "_a", "b"]) == "__a"
    assert common.checkpoint_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    df = spark.createDataFrame([(i, f"t{i}") for i in range(9)], "i int, t string")
    assert sorted(common.materialise(df, "x").collect()) == sorted(df.collect())
    assert [r["i"] for r in common.kept_where(df.withColumn("n", df.i * 2), "n > 12").collect()] == [7, 8]
