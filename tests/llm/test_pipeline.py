"""The pipeline against its stages done by brute force, one after the other."""

import math
import zlib
from collections import Counter, defaultdict
from hashlib import md5

import numpy as np

import corpus_pipeline
from marlstone.llm import encoder, quality
from tests.llm.test_native import measures, runs_deleted, words_in
from tests.llm.test_ngram_join import brute
from tests.llm.test_tokens import library_ids

TABLES = "/root/testdata/sf0.01"


def good(text):
    n, chars, symbols, lines, dup, stops, again = measures(text)
    if n < 50 or 100 * again > 50 * n:
        return False
    values = {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_lines": lines, "n_dup_lines": dup, "n_stop_words": stops}
    return all(r.low * values[r.bottom] <= 1000 * values[r.top] and (r.high is None or 1000 * values[r.top] <= r.high * values[r.bottom]) for r in quality.THRESHOLDS)


def mixture(rows):
    """(doc, text, source) rows as often as systematic sampling takes them."""
    by = defaultdict(list)
    for d, t, s in rows:
        by[s].append((words_in(t), md5(str(d).encode()).hexdigest(), d, t))
    order = sorted(by, key=lambda s: (s is None, s or ""))
    total = {s: sum(x[0] for x in by[s]) for s in order}
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    # The level at which weights times it, held to three times a source, make the whole.
    held = set()
    while True:
        level = (sum(total.values()) - sum(3 * total[s] for s in held)) / sum(weight[s] for s in order if s not in held)
        more = {s for s in order if s not in held and 3 * total[s] <= weight[s] * level}
        if not more:
            break
        held |= more
    out = []
    for s in order:
        target = 3.0 * total[s] if s in held else weight[s] * (sum(total.values()) - sum(3 * total[x] for x in held)) / sum(weight[x] for x in order if x not in held)
        u = int(md5(("mix:" + ("~" if s is None else f"={s}")).encode()).hexdigest()[:8], 16) / 2**32
        for k, (_, _, d, t) in enumerate(sorted(by[s]), 1):
            out += [(d, t)] * (math.floor(k * target / total[s] + u) - math.floor((k - 1) * target / total[s] + u))
    return out


def test_whole_pipeline(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").collect()
    kept = [r for r in docs if good(r["text"])]
    source = {r["doc_id"]: r["source"] for r in docs}
    cut = [(d, t) for (d, n, gone, t), times in runs_deleted([(r["doc_id"], r["text"]) for r in kept], 3).items() for _ in range(times) if gone == 0 or gone < n]
    least = brute(cut, percent=80, k=5)
    stays = {d for d, n, c in least if n == 0 or d == c}
    rows = mixture([(d, t, source[d]) for d, t in cut if d in stays])
    want = Counter()
    for (d, _), ids in zip(rows, library_ids(encoder.default_path(), [t for _, t in rows], 1)):
        at = 0
        for size in [2048] * (len(ids) // 2048) + [1 << b for b in range(10, -1, -1) if len(ids) % 2048 >> b & 1]:
            want[d, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes()), len(ids)] += 1
            at += size
    got = corpus_pipeline.run(spark, TABLES).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], zlib.crc32(r["ids"]), r["doc_tokens"]) for r in got) == want
    assert len({r["sequence_id"] for r in got}) == len(got)


def test_stages_stand_odd_rows(spark, odd_docs, clash_docs, no_docs):
    for docs in (odd_docs, clash_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, TABLES)
            assert out.columns == docs.columns, name
            out.collect()


#: Long enough for the quality rules, of many different words.
GOOD = [" ".join(f"{w}{i * k % 37} of the" for i, w in enumerate("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split())) for k in (5, 7, 11)]


def stage_rows(spark, name, rows, columns="doc_id long, text string, lang string, source string, n_chars long, body string"):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame([(d, t, "en", s, None if t is None else len(t), "extra") for d, t, s in rows], columns)
    out = stage(spark, docs, TABLES)
    assert name == "pack" or out.columns == docs.columns
    return out.collect()


def test_quality_stage(spark):
    rows = [(1, GOOD[0], "a"), (1, GOOD[0], "a"), (None, GOOD[1], None), (2, None, "a"), (3, "", "a"), (4, " \n", "a"), (5, "few words", "a"), (6, "x " * 500, "a"), (7, "\n".join(GOOD) * 300, "b")]
    got = Counter((r["doc_id"], r["text"]) for r in stage_rows(spark, "quality_rules", rows))
    assert got == Counter([(1, GOOD[0]), (1, GOOD[0]), (None, GOOD[1])])
    assert stage_rows(spark, "quality_rules", []) == []


def test_line_stage(spark):
    run = "first line\nsecond line\nthird line"
    rows = [(3, f"{run}\nown of three", "a"), (1, f"own of one\n{run}", "a"), (None, f"{run}\nown of none", None), (2, run, "a"), (4, None, "a"), (5, "", "a"), (6, "own of six", "a"), (6, "own of six", "a")]
    got = Counter((r["doc_id"], r["text"], r["n_chars"]) for r in stage_rows(spark, "line_dedup", rows))
    assert got == Counter([(3, "own of three", 12), (1, f"own of one\n{run}", 44), (None, "own of none", 11), (4, None, None), (5, "", 0), (6, "own of six", 10), (6, "own of six", 10)])
    assert stage_rows(spark, "line_dedup", []) == []


def test_near_copy_stage(spark):
    rows = [(9, GOOD[0], "a"), (4, GOOD[0] + " more", "b"), (4, GOOD[1], "b"), (None, GOOD[1] + " x", None), (7, GOOD[2], "a"), (7, GOOD[2], "a"), (8, "", "a"), (8, "", "a"), (8, None, "a")]
    got = Counter((r["doc_id"], r["text"]) for r in stage_rows(spark, "ngram_join", rows))
    assert got == Counter([(4, GOOD[0] + " more"), (4, GOOD[1]), (7, GOOD[2]), (8, ""), (8, ""), (8, None)])
    assert stage_rows(spark, "ngram_join", []) == []


def test_mixing_stage(spark):
    rows = [(i, f"{'w ' * (i % 4 + 1)}{i}", "a" if i % 3 else None) for i in range(90)] + [(500, None, "zero"), (501, "", "zero"), (None, "w w w", "a"), (None, "w w w", "a")]
    got = Counter((r["doc_id"], r["text"]) for r in stage_rows(spark, "mix_sources", rows))
    words = lambda s: sum(n * words_in(t or "") for (d, t), n in got.items() if dict.fromkeys([(x, y) for x, y, z in rows if z == s]).get((d, t), 1) is None)
    sizes = {s: sum(words_in(t or "") for _, t, z in rows if z == s) for s in ("a", None, "zero")}
    total = sum(sizes.values())
    # By code point, null last: a weighs 1, zero 2 (held to nothing), null 3.
    assert abs(words("a") - total / 4) <= 5 and abs(words(None) - total * 3 / 4) <= 5 and words("zero") == 0
    assert all(n <= 6 for n in got.values()) and not [1 for d, _ in got if d in (500, 501)]
    assert stage_rows(spark, "mix_sources", []) == []


def test_pack_stage(spark):
    rows = [(1, GOOD[0], "a"), (1, GOOD[0], "a"), (None, None, "a"), (2, "", None)]
    got = stage_rows(spark, "pack", rows)
    ids = library_ids(encoder.default_path(), [t or "" for _, t, _ in rows], 1)
    assert sum(r["length"] for r in got) == sum(map(len, ids))
    assert Counter(r["doc_id"] for r in got if r["start"] == 0) == Counter([1, 1, None, 2])
    assert all(r["length"] & (r["length"] - 1) == 0 and len(r["ids"]) == 4 * r["length"] for r in got)
    assert stage_rows(spark, "pack", []) == []


def test_folders_can_be_cleaned(spark):
    import os

    from marlstone.llm import common

    got = stage_rows(spark, "ngram_join", [(1, GOOD[0], "a"), (2, GOOD[0], "a")])
    assert len(got) == 1 and common._made
    left = list(common._made)
    common.clean(spark)
    assert not common._made and not [p for p in left if os.path.exists(p.removeprefix("file:"))]
