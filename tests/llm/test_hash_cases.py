"""Words that a polynomial modulo a power of two takes for each other, and very long texts: operators 1, 6, 7, 9 and 10."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from marlstone.llm import encoder, ngram_join, packing, rans, token_counts, windows
from marlstone.llm.wordhash import PRIME, Lexicon, Rolling, Words, pieces, running, times
from tests.llm.test_ngram_join import brute as linked_brute
from tests.llm.test_tokens import crc, library_ids
from tests.llm.test_windows import brute as windows_brute


def twins(n=1024, a="a", b="b"):
    """The sequence of Thue and Morse over two letters, and the one with the letters exchanged."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


@pytest.fixture(scope="module")
def twin_rows():
    t, u = twins()
    forty_nine = " ".join(f"w{i}" for i in range(49))
    words, others = (" ".join(x) for x in twins(64, "q", "z"))
    texts = [t, u, f"x y {t}", f"x y {u}", f"{forty_nine} {t}", f"{forty_nine} {u}", words, others, f"{t} {u}", f"{u} {t}", t, None]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def twin_docs(spark, twin_rows):
    return spark.createDataFrame(twin_rows, "doc_id long, text string").coalesce(1)


def test_ids_of_twins(twin_docs, twin_rows):
    want = library_ids(encoder.default_path(), [t for _, t in twin_rows], 2)
    got = {r["doc_id"]: zlib.crc32(r["ids"]) for r in rans.round_trip(twin_docs).collect()}
    assert got == {d: crc(x) for (d, _), x in zip(twin_rows, want)}
    pieces_ = {}
    for r in sorted(packing.pack(twin_docs).collect(), key=lambda r: (r["doc_id"], r["start"])):
        pieces_[r["doc_id"]] = pieces_.get(r["doc_id"], b"") + r["ids"]
    assert {d: zlib.crc32(x) for d, x in pieces_.items()} == {d: crc(x[:-1] + [1]) for (d, _), x in zip(twin_rows, want)}


def test_counts_of_twins(twin_docs, twin_rows):
    want = library_ids(token_counts.default_path(), [t or "" for _, t in twin_rows])
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(twin_docs).collect()} == {d: len(x) for (d, _), x in zip(twin_rows, want)}


def test_links_of_twins(twin_docs, twin_rows):
    got = Counter(tuple(r) for r in ngram_join.component_ids(twin_docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == linked_brute(twin_rows)


def test_windows_of_twins(twin_docs, twin_rows):
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in windows.dedup_windows(twin_docs).collect())
    assert got == windows_brute(twin_rows, 50)


def test_a_lexicon_is_never_wrong():
    """All words get one of two hashes; numbers still tell them apart."""
    text = " ".join(f"w{i * 37 % 300}" + "long" * (i % 13) for i in range(900)).encode()
    w = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    w.hash = w.hash & np.uint64(1)
    lexicon, met = Lexicon(), []
    tag = np.arange(900) % 2
    numbers = lexicon.numbers(w, np.arange(900), tag, lambda new: met.extend(new.tolist()))
    words = [(x, k % 2) for k, x in enumerate(text.split())]
    assert [words[met[n]] for n in numbers.tolist()] == words and len(met) == len(set(words)) == lexicon.n


def test_arithmetic():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, PRIME, (2, 500), dtype=np.uint64)
    a[:2], b[1:3] = PRIME - 1, PRIME - 1
    assert times(a, b).tolist() == [int(x) * int(y) % PRIME for x, y in zip(a, b)]
    total = 0
    for x, s in zip(a.tolist(), running(a)[1:].tolist()):
        total = (total + x) % PRIME
        assert s == total
    h = a * np.uint64(7)
    h[300:400] = h[:100]
    got = Rolling(987654321, kept=64).hashes(h, 9)
    assert (got == Rolling(987654321).hashes(h, 9)).all() and (got[300:392] == got[:92]).all() and len(np.unique(got)) == len(got) - 92


def test_pieces_end_at_white_space():
    data = np.frombuffer(b"ab " * 1_700_000 + b"x" * 4_000_000 + b" tail", np.uint8)
    cuts = list(pieces(data))
    assert cuts[0][0] == 0 and cuts[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
    assert all(data[b - 1] == 32 for _, b in cuts[:-1]) and len(cuts) > 3
    assert len(Words(data, np.array([0, len(data)])).hash) == 1_700_002


def test_very_long_texts_of_token_operators():
    """Texts of several pieces, with odd white space in one: ids and counts as the library gives them."""
    plain = " ".join(f"word{i * i % 7919}, and.the{i % 11}\n" for i in range(250_000))
    odd = "x  y\t\tz 　 don't <|endoftext|> " * 120_000
    for text in (plain, odd):
        data = np.frombuffer(text.encode(), np.uint8)
        assert len(data) > 3_000_000
        bounds = np.array([0, len(data)])
        ids, n = encoder.WordEncoder(encoder.default_path()).encode(data, bounds, 2)
        assert ids.tolist() == library_ids(encoder.default_path(), [text], 2)[0] and n.tolist() == [len(ids)]
        assert token_counts.TokenCounter(token_counts.default_path()).count(data, bounds).tolist() == [len(library_ids(token_counts.default_path(), [text])[0])]
