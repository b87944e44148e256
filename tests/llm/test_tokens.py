"""Operators 1, 9 and 10 against the tokenizers library itself."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from marlstone.llm import encoder, packing, rans, token_counts

SMALL = "/root/testdata/sf0.001"


def library_ids(path, texts, end=None):
    t = Tokenizer.from_file(path)
    return [e.ids + ([] if end is None else [end]) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("which", ["small", "odd_docs", "clash_docs", "no_docs"])
def test_files_read_back(which, request):
    docs = request.getfixturevalue(which)
    rows = rows_of(docs)
    ids = library_ids(encoder.default_path(), [t for _, t in rows], 2)
    rows = sorted(zip([(d is not None, d or 0) for d, _ in rows], [np.array(x, "<u2").tobytes() for x in ids], ids, [d for d, _ in rows]))
    want, start = [], 0
    for _, _, x, d in rows:
        want.append((d, start, len(x), crc(x)))
        start += len(x)
    got = [(r["doc_id"], r["start"], len(r["ids"]) // 4, zlib.crc32(r["ids"])) for r in rans.round_trip(docs).collect()]
    assert Counter(got) == Counter(want)


def test_damage_is_found():
    freq = rans.normalised(np.array([5, 0, 3, 1]))
    assert freq.sum() == 1 << rans.BITS and freq[1] == 0
    coder = rans.Coder(freq)
    ids = np.array([0, 2, 3, 0, 0, 2] * 9000, np.uint32)
    data = coder.encode([ids])[0]
    assert (coder.decode([data])[0][: len(ids)] == ids).all()
    with pytest.raises(ValueError):
        coder.decode([data[:-2000] + bytes([data[-2000] ^ 1]) + data[-1999:]])


@pytest.mark.parametrize("which", ["small", "odd_docs", "clash_docs", "no_docs"])
def test_pieces(which, request):
    docs = request.getfixturevalue(which)
    want = Counter()
    rows = rows_of(docs)
    for (d, _), ids in zip(rows, library_ids(encoder.default_path(), [t for _, t in rows], 1)):
        n, at = len(ids), 0
        for size in [2048] * (n // 2048) + [1 << b for b in range(10, -1, -1) if n % 2048 >> b & 1]:
            want[d, at, size, crc(ids[at : at + size]), n] += 1
            at += size
        assert at == n
    got = packing.digests(packing.pack(docs)).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    assert len({r["sequence_id"] for r in got}) == len(got) and all(r["offset"] == 0 for r in got)
    by_bucket = defaultdict(set)
    for r in got:
        by_bucket[r["sequence_id"] >> 56].add(r["length"])
    assert all(len(x) == 1 for x in by_bucket.values())


@pytest.mark.parametrize("which", ["small", "odd_docs", "clash_docs", "no_docs"])
def test_counts(which, request):
    docs = request.getfixturevalue(which)
    rows = rows_of(docs)
    want = Counter((d, len((t or "").encode()), len(x), len(x) > 1024) for (d, t), x in zip(rows, library_ids(token_counts.default_path(), [t for _, t in rows])))
    got = token_counts.count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    assert Counter(tuple(r) for r in got) == want


def test_counts_of_hard_strings():
    texts = ["a" * 5000, "aaab" * 99, "don't we'll I'M", "\t\tx\ty z", "a\n\nb \n c", "x\x1cy \x1d z\x85 q\x85\x85r", "​ a﻿b    c", "12345 6 78", "!?!? ...", "ΣΑΣ", "\r\n\r\n x", "a  b", "<|endoftext|> <|endoftext|>"]
    import pyarrow as pa

    from marlstone.llm.wordhash import text_groups

    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])
    counter = token_counts.TokenCounter(token_counts.default_path())
    got = np.concatenate([counter.count(d, b) for _, d, b in text_groups([batch], "t")])
    assert got.tolist() == [len(x) for x in library_ids(token_counts.default_path(), texts)]


def test_forgetting_changes_nothing():
    import pyarrow as pa

    from marlstone.llm.wordhash import text_groups

    texts = [" ".join(f"w{i * j % 991}" for j in range(40)) for i in range(60)]
    enc = encoder.WordEncoder(encoder.default_path(), remembered=50)
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])
    got = [i for _, d, b in text_groups([batch], "t", 500) for i in enc.encode(d, b, 7)[0].tolist()]
    assert got == [i for x in library_ids(encoder.default_path(), texts, 7) for i in x]
