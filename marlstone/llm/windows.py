"""Removal of passages that repeat across documents: Rabin-Karp hashes of every window of words, counted in Spark.

Every window of a fixed number of words has a rolling hash, modulo a prime. Spark counts the hashes: for each, the
smallest and the largest document that it starts in. A word goes if a window over it also starts in a document with a
smaller id. Windows are judged on the input, and overlapping ones merge into the longest intervals.

To count a window costs a shuffled row, and most occur once. So a first pass counts, for every window, the least hash
among the half windows inside it: equal windows have equal ones, and there are few different ones to a text. A window
whose least half window occurs in one document only cannot repeat, and is not counted. Which those are is told by a bit
filter of bounded size, sized by their number (false hits only cost time); where there are more of them than it can tell
apart, by a join. For that join neighbouring windows, which mostly share their least half window, travel as one row.

Of the windows of one chunk that are equal, the one in the smallest document goes on and the others are settled on the
spot, so a passage that a third of all documents share is one row for each chunk and window, and Spark combines those
before it shuffles them. The join that carries a window's count back to its places can be split by Spark where a key
is hot. Removed windows are gathered as bits, 64 places of a document to a row, not as rows of their own.

Defined results: null, empty and white texts have no words; a null id counts as larger than all others; rows with equal
ids don't remove each other's words; repeated rows get equal results; texts shorter than a window keep all words; a very
long text is worked through in stretches of windows; an empty table gives an empty one. Only the id and the text are
read, and extra columns are passed on unless their name is that of a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from marlstone.llm import bitfilter
from marlstone.llm.common import materialise, shipped, text_of
from marlstone.llm.wordhash import U64, Rolling, Words, text_groups

WINDOW = 50
CHUNK_WINDOWS = 500_000
#: The base of the rolling hash, below 2**61 - 1.
BASE = 0x0D9E3779B97F4A7B
LAST = np.iinfo(np.int64).max

Places = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def windows(data: np.ndarray, bounds: np.ndarray, size: int, rolling: Rolling) -> Iterator[Places]:
    """Every window of a group of texts, in stretches: the text it is in, its first word there, its hash and the least hash of its half windows."""
    w = Words(data, bounds)
    text = w.texts()
    for lo in range(0, max(len(w.hash) - size + 1, 0), CHUNK_WINDOWS):
        own = slice(lo, lo + CHUNK_WINDOWS + size - 1)
        whole, least = rolling.hashes(w.hash[own], size), rolling.hashes(w.hash[own], (size + 1) // 2)
        m = len(whole)
        # The least of size // 2 + 1 half windows, by minima over runs of doubling length.
        span, have = size - (size + 1) // 2 + 1, 1
        while have * 2 <= span:
            least, have = np.minimum(least[: len(least) - have], least[have:]), have * 2
        if have < span:
            least = np.minimum(least[:m], least[span - have : span - have + m])
        of = text[own]
        at = np.flatnonzero(of[:m] == of[size - 1 : size - 1 + m])
        yield of[at], (at + lo - w.bounds[of[at]]).astype(np.int32), whole[at], least[:m][at]


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in any column; the first does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def repeated_least(slim: DataFrame, size: int) -> DataFrame:
    """(h): least half windows that occur in more than one document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(BASE)
        for batch, data, bounds in text_groups(batches, "body"):
            names = np.asarray(batch.column(0), np.int64)
            for text, _, _, least in windows(data, bounds, size, rolling):
                new = changes(text, least)
                h, ids = least[new], names[text[new]]
                order = np.lexsort((ids, h))
                h, ids = h[order], ids[order]
                first = np.flatnonzero(changes(h))
                last = np.append(first[1:], len(h))[: len(first)] - 1
                yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(ids[first]), pa.array(ids[last])], ["h", "low", "high"])

    seen = slim.mapInArrow(shipped(run), "h long, low long, high long")
    return seen.groupBy("h").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low < high").select("h")


def later(hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Entries whose hash has an entry with a smaller id."""
    order = np.lexsort((ids, hashes))
    begins = changes(hashes[order])
    least = ids[order][np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))] if len(order) else ids
    out = np.empty(len(order), bool)
    out[order] = ids[order] > least
    return out


#: Runs of neighbouring windows with their hashes; or, settled, 64 places of a document with a bit for each window to go.
DEALT = "least long, id long, tk long, first int, hashes array<long>, bits long"


def dealt_windows(slim: DataFrame, size: int, grid) -> DataFrame:
    """All windows that may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(BASE)
        held: list[tuple] = []
        count = docs = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, count, docs
            ids, tks, doc, first, hashes, least = (np.concatenate(x) for x in zip(*held))
            held, count, docs = [], 0, 0
            gone = later(hashes, ids[doc])
            d, f = doc[gone], first[gone]
            at = np.flatnonzero(changes(d, f >> 6))
            if len(at):
                bits = np.bitwise_or.reduceat(U64(1) << (f & 63).astype(U64), at).view(np.int64)
                none = pa.nulls(len(at), pa.int64())
                yield pa.RecordBatch.from_arrays([none, pa.array(ids[d[at]]), pa.array(tks[d[at]]), pa.array(f[at] >> 6), pa.nulls(len(at), pa.list_(pa.int64())), pa.array(bits)], names)
            d, f, h, least = doc[~gone], first[~gone], hashes[~gone], least[~gone]
            at = np.flatnonzero(changes(d, f - np.arange(len(f)), least))
            if len(at):
                runs = pa.ListArray.from_arrays(pa.array(np.append(at, len(h)).astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(least[at].view(np.int64)), pa.array(ids[d[at]]), pa.array(tks[d[at]]), pa.array(f[at]), runs, pa.nulls(len(at), pa.int64())], names)

        names = [f.split()[0] for f in DEALT.split(", ")]
        for batch, data, bounds in text_groups(batches, "body"):
            ids, tks = (np.asarray(batch.column(i), np.int64) for i in (0, 1))
            for text, first, hashes, least in windows(data, bounds, size, rolling):
                may = bitfilter.may_have(grid.value, least) if grid else np.ones(len(least), bool)
                held.append((ids, tks, text[may] + docs, first[may], hashes[may], least[may]))
                count, docs = count + int(may.sum()), docs + len(ids)
                if count >= CHUNK_WINDOWS:
                    yield from flush()
        if held:
            yield from flush()

    return slim.mapInArrow(shipped(run, *([grid] if grid else [])), DEALT)


def removed_windows(slim: DataFrame, size: int) -> DataFrame:
    """(id, tk, block, bits): of each 64 places of a document, a bit for each window that also starts in a document with a smaller id."""
    least = materialise(repeated_least(slim, size), "halves", few_files=True)
    n = least.count()
    grid = slim.sparkSession.sparkContext.broadcast(bitfilter.build(least, "h", bitfilter.bits_for(n))) if bitfilter.holds(n) else None
    dealt = materialise(dealt_windows(slim, size, grid), "windows")
    runs = dealt.filter("hashes IS NOT NULL")
    if grid is None:
        runs = runs.join(least.withColumnRenamed("h", "least"), "least", "left_semi")
    each = runs.select("id", "tk", "first", F.posexplode("hashes").alias("on", "h"))
    counted = each.groupBy("h").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("h", "low")
    place = F.col("first") + F.col("on")
    gone = each.join(counted, "h").filter("low < id").select("id", "tk", F.shiftright(place, 6).alias("block"), F.expr("shiftleft(1L, (first + on) & 63)").alias("bits"))
    settled = dealt.filter("hashes IS NULL").select("id", "tk", F.col("first").alias("block"), "bits")
    return gone.union(settled).groupBy("id", "tk", "block").agg(F.bit_or("bits").alias("bits"))


def covered(blocks: np.ndarray, bits: np.ndarray, size: int, n: int) -> list[tuple[int, int]]:
    """The longest intervals of words under windows, of a text of n words."""
    grid = np.unpackbits(np.ascontiguousarray(bits, "<i8").view(np.uint8), bitorder="little").reshape(-1, 64)
    row, column = np.nonzero(grid)
    starts = np.sort(blocks[row].astype(np.int64) * 64 + column)
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > starts[:-1] + size]))
    return list(zip(starts[new].tolist(), np.minimum(starts[np.append(new[1:], len(starts)) - 1] + size, n).tolist()))


def dedup_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """docs without the text, with n_words, n_removed, intervals (start and end words, end exclusive) and kept, the words left joined by one blank."""
    results = ("n_words", "n_removed", "intervals", "kept")
    rest = [c for c in docs.columns if c != text and c.lower() not in results]
    body = text_of(text)
    key = [F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(body).alias("tk")]
    slim = docs.select(*key, body.alias("body"))
    removed = removed_windows(slim, size).groupBy("id", "tk").agg(F.collect_list("block").alias("blocks"), F.collect_list("bits").alias("bits"))
    row = docs.select(*key, body.alias("body"), F.struct(*rest).alias("row"))
    joined = row.join(removed, ["id", "tk"], "left").select("row", "body", "blocks", "bits")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            n_words, n_removed, intervals, kept = [], [], [], []
            for whole, blocks, bits in zip(batch.column(1), batch.column(2), batch.column(3)):
                words = whole.as_buffer().to_pybytes().split()
                n, out = len(words), []
                if blocks.is_valid:
                    out = covered(np.asarray(blocks.values), np.asarray(bits.values), size, n)
                    mask = np.ones(n, bool)
                    for a, b in out:
                        mask[a:b] = False
                    words = list(compress(words, mask.tolist()))
                n_words.append(n)
                n_removed.append(n - len(words))
                intervals.append([{"start": a, "end": b} for a, b in out])
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(intervals, span), pa.array(kept, pa.string())], ["row", *results])

    schema = joined.select("row").schema.add("n_words", "long").add("n_removed", "long")
    schema = schema.add("intervals", ArrayType(StructType().add("start", "integer").add("end", "integer"))).add("kept", "string")
    return joined.mapInArrow(shipped(apply), schema).select("row.*", *results)
