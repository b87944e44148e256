"""Token ids in a file format coded by a static range asymmetric numeral system.

One table of frequencies, counted over all documents, serves all blocks. A block holds whole documents in ascending
order; its ids are dealt in turn to interleaved lanes, each with a state of its own, and the lanes share one stream
of 32-bit words. Blocks don't depend on each other. Inside a block, every so many steps, the states and the place in
the stream are kept as a checkpoint with a checksum of the ids up to the next, so that segments decode in parallel
and a damaged one is found.

Files, under one folder, written by Spark so that a lost executor's task is simply run again:

* ``table``: id, freq (sum 2**20).
* ``blocks``: part, seq (order in the part), before (ids before it in the part), n_tokens, payload. Little-endian
  payload: 4 bytes ``RNS1``; uint32 lanes, steps, steps between checkpoints, checkpoints, documents, words; for each
  checkpoint a uint64 state for each lane, uint32 place in the stream and uint32 crc32 of the segment's ids as uint32;
  the stream. Then for each document an int64 id with one null byte, and an int64 length.

Defined results: a null text counts as empty and has the end id alone; null ids come first; equal ids stand in the
order of their ids' bytes; an empty table gives empty files and an empty result. Only the id and the text are read,
so extra columns, whatever their names, don't matter. A text of any length lies in one block.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import folder, shipped, text_of
from marlstone.llm.encoder import default_path, encoder
from marlstone.llm.wordhash import text_groups

MAGIC = b"RNS1"
BITS = 20
LANES = 64
EVERY = 256
BLOCK_TOKENS = 1 << 16
GROUP_TOKENS = 1 << 20
PART_TOKENS = 1 << 23
LOW = np.uint64(1 << 31)
END_ID = 2


# ---------------------------------------------------------------------------------------------------- the coder


def normalised(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies that sum to 2**bits, at least 1 for each id that occurs; whole-number arithmetic only."""
    seen = np.flatnonzero(counts)
    freq = np.zeros(len(counts), np.int64)
    if len(seen):
        total, room = int(counts.sum()), (1 << bits) - len(seen)
        if room < 0:
            raise ValueError(f"more than {1 << bits} different ids")
        freq[seen] = [1 + int(c) * room // total for c in counts[seen].tolist()]
        freq[int(np.argmax(counts))] += (1 << bits) - int(freq.sum())
    return freq


class Coder:
    def __init__(self, freq: np.ndarray, bits: int = BITS):
        self.bits, self.mask = np.uint64(bits), np.uint64((1 << bits) - 1)
        self.freq = freq.astype(np.uint64)
        self.low = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.limit = self.freq << np.uint64(63 - bits)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.common = int(np.argmax(freq)) if len(freq) else 0

    def encode(self, blocks: list[np.ndarray]) -> list[bytes]:
        """Each block's checkpoints and stream. All blocks advance together, the longest first."""
        steps = np.array([-(-len(b) // LANES) for b in blocks], np.int64)
        order = np.argsort(-steps, kind="stable")
        steps_down = steps[order]
        padded = [np.concatenate([blocks[i], np.full(int(steps[i]) * LANES - len(blocks[i]), self.common, np.uint32)]).astype(np.uint32) for i in order]
        flat = np.concatenate(padded) if padded else np.zeros(0, np.uint32)
        base = np.concatenate([[0], np.cumsum(steps_down * LANES)])
        top = int(steps_down[0]) if len(order) else 0
        state = np.full((len(order), LANES), LOW, np.uint64)
        word, sent = np.zeros(len(flat), np.uint32), np.zeros(len(flat), bool)
        lane = np.arange(LANES)
        marks: list[list[np.ndarray]] = [[] for _ in order]
        alive = np.searchsorted(-steps_down, -np.arange(1, top + 1), "right")
        for t in range(top - 1, -1, -1):
            k = int(alive[t])
            at = base[:k, None] + (t * LANES + lane)
            s = flat[at]
            x, f = state[:k], self.freq[s]
            out = x >= self.limit[s]
            sent[at] = out
            word[at] = x.astype(np.uint32)
            x = np.where(out, x >> np.uint64(32), x)
            q = x // f
            state[:k] = (q << self.bits) + (x - q * f) + self.low[s]
            if t % EVERY == 0:
                for b in range(k):
                    marks[b].append(state[b].copy())
        made: list[bytes] = [b""] * len(order)
        for j, i in enumerate(order.tolist()):
            lo, hi = int(base[j]), int(base[j + 1])
            flags = sent[lo:hi]
            seen = np.concatenate([[0], np.cumsum(flags)])
            stream = word[lo:hi][flags]
            n = -(-int(steps[i]) // EVERY)
            parts = [struct.pack("<4s5I", MAGIC, LANES, int(steps[i]), EVERY, n, len(stream))]
            for c, states in enumerate(reversed(marks[j])):
                a = c * EVERY * LANES
                parts += [states.astype("<u8").tobytes(), struct.pack("<2I", int(seen[a]), zlib.crc32(padded[j][a : a + EVERY * LANES].astype("<u4").tobytes()))]
            made[i] = b"".join([*parts, stream.astype("<u4").tobytes()])
        return made

    def decode(self, coded: list[bytes]) -> list[np.ndarray]:
        """The ids of each block, padding included. All segments of all blocks advance together."""
        heads, states, places, sums, steps, streams, lens = [], [], [], [], [], [], []
        behind = 0
        for data in coded:
            magic, lanes, n_steps, every, n, words = struct.unpack_from("<4s5I", data)
            if magic != MAGIC or lanes != LANES:
                raise ValueError("not a block of this format")
            at = 24
            for c in range(n):
                states.append(np.frombuffer(data, "<u8", lanes, at))
                place, crc = struct.unpack_from("<2I", data, at + 8 * lanes)
                places.append(behind + place)
                sums.append(crc)
                steps.append(min(every, n_steps - c * every))
                at += 8 * lanes + 8
            streams.append(np.frombuffer(data, "<u4", words, at))
            lens.append(at + 4 * words)
            heads.append(n)
            behind += words
        if not states:
            return [np.zeros(0, np.uint32) for _ in coded]
        order = np.argsort(-np.array(steps), kind="stable")
        steps_down = np.array(steps)[order]
        x, ptr = np.array(states, np.uint64)[order], np.array(places, np.int64)[order]
        stream = np.concatenate([*streams, np.zeros(LANES, np.uint32)]).astype(np.uint64)
        top = int(steps_down[0])
        out = np.zeros((len(order), top, LANES), np.uint32)
        alive = np.searchsorted(-steps_down, -np.arange(1, top + 1), "right")
        for t in range(top):
            k = int(alive[t])
            y = x[:k]
            slot = y & self.mask
            s = self.symbol[slot]
            out[:k, t] = s
            y = self.freq[s] * (y >> self.bits) + slot - self.low[s]
            need = y < LOW
            upto = np.cumsum(need, axis=1)
            words = stream[ptr[:k, None] + upto - 1]
            x[:k] = np.where(need, (y << np.uint64(32)) | words, y)
            ptr[:k] += upto[:, -1]
        back = np.argsort(order, kind="stable")
        result, at = [], 0
        for n in heads:
            own = []
            for c in range(at, at + n):
                ids = out[back[c], : steps[c]].reshape(-1)
                if zlib.crc32(ids.astype("<u4").tobytes()) != sums[c]:
                    raise ValueError("a segment doesn't match its checksum")
                own.append(ids)
            result.append(np.concatenate(own) if own else np.zeros(0, np.uint32))
            at += n
        return result


# ---------------------------------------------------------------------------------------------------- Spark side


def token_ids(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids): each whole text's ids and the end id, as little-endian uint16, or uint32 for vocabularies beyond 65,536."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        kind = "<u2" if max(enc.library.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        for batch, data, bounds in text_groups(batches, "body"):
            ids, n = enc.encode(data, bounds, end_id)
            raw = pa.py_buffer(ids.astype(kind).tobytes())
            edges = np.concatenate([[0], np.cumsum(n) * int(kind[-1])]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(edges), raw]).cast(pa.binary())], ["doc_id", "ids"])

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("body"))
    return slim.mapInArrow(shipped(run), "doc_id long, ids binary")


def width_of(path: str, end_id: int) -> int:
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    size = 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
    return 2 if max(size, end_id + 1) <= 1 << 16 else 4


def frequencies(ids: DataFrame, width: int, doc: str = "ids") -> DataFrame:
    """(id, n): how often each id occurs. Each task counts in an array and sends its ids once; Spark adds them up."""
    kind = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                own = np.bincount(np.frombuffer(blob.as_buffer(), kind))
                if len(own) > len(counts):
                    counts = np.concatenate([counts, np.zeros(len(own) - len(counts), np.int64)])
                counts[: len(own)] += own
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["id", "n"])

    return ids.select(doc).mapInArrow(shipped(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


BLOCKS = "part int, seq int, before long, n_tokens long, payload binary"


def write(docs: DataFrame, to: str, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = END_ID) -> None:
    """Encodes every document into the files of the format under the folder `to`."""
    spark, path = docs.sparkSession, path or default_path()
    width = width_of(path, end_id)
    held = f"{to}/ids"
    token_ids(docs, doc_id, text, path, end_id).write.option("compression", "zstd").parquet(held)
    ids = spark.read.schema("doc_id long, ids binary").parquet(held)
    # As many rows as the vocabulary has entries, however large the corpus.
    counts = frequencies(ids, width).collect()
    n = np.zeros(1 + max([r["id"] for r in counts], default=0), np.int64)
    for r in counts:
        n[r["id"]] = r["n"]
    freq = normalised(n)
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(freq.tolist()) if f], "id long, freq long").coalesce(1).write.parquet(f"{to}/table")
    parts = max(1, -(-int(n.sum()) // PART_TOKENS), spark.sparkContext.defaultParallelism if int(n.sum()) > PART_TOKENS else 1)
    kind = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = Coder(freq), TaskContext.get().partitionId()
        seq = before = 0
        waiting: list[tuple[list, list[np.ndarray], int]] = []
        names, arrays, n_own, total = [], [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seq, before, waiting, total
            coded = coder.encode([np.concatenate(x).astype(np.uint32) for _, x, _ in waiting])
            for (names, arrays, n_tokens), data in zip(waiting, coded):
                index = b"".join(struct.pack("<Bqq", d is None, d or 0, len(a)) for d, a in zip(names, arrays))
                payload = struct.pack("<II", len(names), len(data)) + data + index
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "before": [before], "n_tokens": [n_tokens], "payload": [payload]})
                seq, before = seq + 1, before + n_tokens
            waiting, total = [], 0

        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                names.append(name)
                arrays.append(np.frombuffer(blob.as_buffer(), kind).copy())
                n_own += len(arrays[-1])
                if n_own >= BLOCK_TOKENS:
                    waiting.append((names, arrays, n_own))
                    total += n_own
                    names, arrays, n_own = [], [], 0
                    if total >= GROUP_TOKENS:
                        yield from flush()
        if names:
            waiting.append((names, arrays, n_own))
        yield from flush()

    # Ranges go by id and content, so that rows with null or equal ids are spread as well.
    order = (F.col("doc_id").asc_nulls_first(), F.col("ids").asc())
    ordered = ids.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered.mapInArrow(shipped(run), BLOCKS).write.parquet(f"{to}/blocks")


def read(spark: SparkSession, where: str) -> DataFrame:
    """(doc_id, start, ids) of the files under the folder `where`: ids as little-endian uint32, start the ids of all documents before."""
    table = spark.read.schema("id long, freq long").parquet(f"{where}/table").collect()
    freq = np.zeros(1 + max([r["id"] for r in table], default=0), np.int64)
    for r in table:
        freq[r["id"]] = r["freq"]
    blocks = spark.read.schema(BLOCKS).parquet(f"{where}/blocks")
    # A row for each part, that is for PART_TOKENS ids, so the running sum and the broadcast stay small: 16 bytes for 16 MB.
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    placed = blocks.join(F.broadcast(parts), "part").select((F.col("ahead") + F.col("before")).alias("start"), "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        for batch in batches:
            for lo in range(0, batch.num_rows, 16):
                some = batch.slice(lo, 16)
                heads, index, coded = [], [], []
                for payload in some.column(1).to_pylist():
                    n, size = struct.unpack_from("<II", payload)
                    coded.append(payload[8 : 8 + size])
                    index.append([struct.unpack_from("<Bqq", payload, 8 + size + 17 * i) for i in range(n)])
                    heads.append(n)
                for start, docs, ids in zip(some.column(0).to_pylist(), index, coder.decode(coded)):
                    edges = np.concatenate([[0], np.cumsum([d[2] for d in docs])]).astype(np.int64)
                    raw = ids[: edges[-1]].astype("<u4").tobytes()
                    blob = pa.Array.from_buffers(pa.large_binary(), len(docs), [None, pa.py_buffer(edges * 4), pa.py_buffer(raw)]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([None if d[0] else d[1] for d in docs], pa.int64()), pa.array(start + edges[:-1]), blob], ["doc_id", "start", "ids"])

    return placed.mapInArrow(shipped(run), "doc_id long, start long, ids binary")


def round_trip(docs: DataFrame, **how) -> DataFrame:
    """Writes docs in the file format in the shared folder and reads the files back."""
    where = folder(docs.sparkSession, "rans")
    write(docs, where, **how)
    return read(docs.sparkSession, where)
