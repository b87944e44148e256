"""Packing by powers of two: each document is cut into pieces of binary length, and equal lengths form a bucket.

A document of n ids gives one piece of the full length for each time that fits, then one piece for each binary digit
of the rest, the longest first. Every piece is a sequence by itself: its length is a power of two, so nothing is
padded, and no sequence holds two documents. A bucket is all sequences of one length; the number of a sequence begins
with its bucket, so a bucket is one range of numbers.

The cut of a document depends on nothing but its own length: there is no shuffle and no group.

Defined results: a null or empty text has the end id alone and gives one piece of length 1; repeated rows and equal
ids each give their own pieces; an empty table gives none; only the id and the text are read, so extra columns don't
matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import shipped, text_of
from marlstone.llm.encoder import default_path, encoder
from marlstone.llm.wordhash import text_groups

FULL = 2048
END_ID = 1
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def cut(n: np.ndarray, full: int = FULL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For documents of n ids each: the document of every piece, its start in the document, its length."""
    digits = 1 << np.arange(full.bit_length() - 2, -1, -1)
    whole = n // full
    sizes = np.concatenate([np.full((len(n), 1), full), np.broadcast_to(digits, (len(n), len(digits)))], axis=1)
    times = np.concatenate([whole[:, None], ((n % full)[:, None] & digits) > 0], axis=1)
    doc = np.repeat(np.arange(len(n)), times.sum(axis=1))
    length = np.repeat(sizes.reshape(-1), times.reshape(-1))
    ends = np.cumsum(length)
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    return doc, ends - length - first[doc], length


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, path: str | None = None, full: int = FULL, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian uint32)."""
    if full < 1 or full & (full - 1):
        raise ValueError("the full length must be a power of two")
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, made = encoder(path), TaskContext.get().partitionId(), 0
        for batch, data, bounds in text_groups(batches, "body"):
            ids, n = enc.encode(data, bounds, end_id)
            doc, start, length = cut(n, full)
            # Bucket, task and place in the task: 6, 24 and 32 bits.
            number = (np.round(np.log2(length)).astype(np.int64) << 56) + (part << 32) + made + np.arange(len(doc))
            made += len(doc)
            edges = pa.py_buffer(np.concatenate([[0], np.cumsum(length) * 4]).astype(np.int64))
            blob = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, edges, pa.py_buffer(ids.astype("<u4").tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), *map(pa.array, (start, length, n[doc], number, np.zeros(len(doc), np.int64))), blob], [f.split()[0] for f in PIECES.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("body")).mapInArrow(shipped(run), PIECES)


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
