"""Document fingerprints by randomised edit embedding.

A walk shared by all documents reads a text from the left: at every step of the walk it writes down the character it
stands on, and a random bit, fixed for the step and the character, says whether it moves on. Two texts at a small edit
distance have walks that fall in step again soon after each edit, so their embeddings differ in few places: edit
distance has become Hamming distance. The fingerprint samples the embedding at fixed places, as many in every octave of
places, one hexadecimal digit of the character's hash each. Texts of all lengths share the places, and a longer text
only has more of them. Each sample stands for as many steps as it represents, so likeness, the weighted share of equal
samples, estimates the share of equal places. Bands are hashes of runs of neighbouring samples, over all of the embedding.

One walk falls in step again quickly in most cases, late in some. So there are several independent walks, each with
samples of its own; likeness is that of the walk that agrees best, and every walk has bands.

The walk jumps from character to character by a table of the step at which each next moves, and all documents of a
group take a jump together in one numpy operation; a few long texts go one by one, a character at a time in plain Python
(some 0.3 microseconds for a character and its three walks). Every character of every text is walked over.

Defined results: a null text counts as empty; the empty text has the empty fingerprint, whose likeness is 1 to itself
and 0 to others; a null id stands before all others; rows with equal ids stand in the order of a hash of their text;
a table with one row has that row as its own next; an empty table gives an empty one. A very long text is walked whole,
and its group has no other. Only the id and the text are read, so extra columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import materialise, shipped, text_of
from marlstone.llm.components import components
from marlstone.llm.wordhash import U64, mix

PERIOD = 1 << 12
CLASSES = 64
PER_OCTAVE = 32
WALKS = 3
OCTAVES = 40
BAND = 8
CELLS = 1_500_000
GROUP_CHARS = 8_000_000
BLOCK, FEW = 512, 40
FIRST = -(1 << 63)
_rng = np.random.Generator(np.random.PCG64(77))


def _jumps() -> np.ndarray:
    """For each walk, class of characters and step of the period: after how many steps the walk moves on."""
    moves = _rng.integers(0, 2, (WALKS * CLASSES, PERIOD), dtype=np.uint8).astype(bool)
    moves[:, -1] = True
    at = np.where(moves, np.arange(PERIOD), PERIOD)
    nearest = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1]
    return (nearest - np.arange(PERIOD) + 1).astype(np.int32).reshape(WALKS, -1)


def _places() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sampled steps in ascending order, the steps each stands for, and where in them each octave begins."""
    places, weights, octaves = [np.zeros(1, np.int64)], [np.ones(1)], [0, 1]
    for o in range(OCTAVES):
        n = min(1 << o, PER_OCTAVE)
        # One place in each of n equal stretches of the octave.
        stretch = (1 << o) // n
        places.append((1 << o) + np.arange(n, dtype=np.int64) * stretch + _rng.integers(0, stretch, n))
        weights.append(np.full(n, float(stretch)))
        octaves.append(octaves[-1] + n)
    return np.concatenate(places), np.concatenate(weights), np.array(octaves)


JUMP = _jumps()
PLACES, WEIGHTS, OCTAVE_AT = _places()
HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


Print = tuple[np.ndarray, ...]


def written(p: Print) -> str:
    """A fingerprint as text: the walks' samples, parted by a hyphen; empty for the empty text."""
    return "-".join(x.tobytes().decode() for x in p) if len(p[0]) else ""


def fingerprints(texts: list[str]) -> list[Print]:
    """For each text and walk its samples, as the bytes of hexadecimal digits."""
    out: list[Print] = [(HEX[:0],) * WALKS] * len(texts)
    order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: -len(texts[i]))
    lo = 0
    while lo < len(order):
        longest = len(texts[order[lo]])
        hi = lo + 1
        while hi < len(order) and (hi - lo + 1) * longest <= CELLS and len(texts[order[hi]]) * 10 >= longest * 3:
            hi += 1
        (_walk if hi - lo > FEW else _walk_each)([texts[i] for i in order[lo:hi]], order[lo:hi], out)
        lo = hi
    return out


def _classes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The class of each character, and its digit."""
    hashed = mix(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64) + U64(1))
    return ((hashed >> U64(58)) % U64(CLASSES)).astype(np.uint8), HEX[(hashed & U64(15)).astype(np.intp)]


@cache
def _rows() -> list[list[list[int]]]:
    """For each walk and class the jumps of the period."""
    return [jump.reshape(CLASSES, PERIOD).tolist() for jump in JUMP]


def _walk_each(texts: list[str], names: list[int], out: list[Print]) -> None:
    """Texts one by one, in pieces: for few texts a step in Python costs less than a numpy operation."""
    mask = PERIOD - 1
    for text, name in zip(texts, names):
        found: list[list[np.ndarray]] = [[] for _ in range(WALKS)]
        steps = [0] * WALKS
        for lo in range(0, len(text), CELLS):
            kind, digit = _classes(text[lo : lo + CELLS])
            for walk, rows in enumerate(_rows()):
                jumps = map(rows.__getitem__, kind.tobytes())
                left = np.fromiter(accumulate(jumps, lambda s, row: s + row[s & mask], initial=steps[walk]), np.int64, len(kind) + 1)
                own = PLACES[np.searchsorted(PLACES, left[0]) : np.searchsorted(PLACES, left[-1])]
                found[walk].append(digit[np.searchsorted(left[1:], own, "right")])
                steps[walk] = int(left[-1])
        out[name] = tuple(map(np.concatenate, found))


def _walk(texts: list[str], names: list[int], out: list[Print]) -> None:
    """Texts by length, the longest first: the walks of all take each jump together."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    hashed = mix(codes.astype(U64) + U64(1))
    offset = ((hashed >> U64(58)) % U64(CLASSES)).astype(np.int32) * np.int32(PERIOD)
    digit = HEX[(hashed & U64(15)).astype(np.intp)]
    n = np.array([len(t) for t in texts])
    ends = np.cumsum(n)
    slices = list(zip((ends - n).tolist(), ends.tolist()))
    grid = np.zeros((int(n[0]), len(texts)), np.int32)
    for d, (a, b) in enumerate(slices):
        grid[: b - a, d] = offset[a:b]
    alive = np.searchsorted(-n, -np.arange(1, int(n[0]) + 1), "right").tolist()
    mask = np.int32(PERIOD - 1)
    # All walks of all texts in one row; shorter texts leave at its end.
    tables = JUMP.reshape(-1)
    table = (np.arange(WALKS, dtype=np.int32) * np.int32(CLASSES * PERIOD))[:, None]
    left = np.empty((len(grid), WALKS, len(texts)), np.int32)
    step = np.zeros((WALKS, len(texts)), np.int32)
    k = len(texts)
    s, base = step, np.broadcast_to(table, (WALKS, k)).copy()
    for row, gone, now in zip(grid, left, alive):
        if now != k:
            s, base, k = s[:, :now].copy(), base[:, :now].copy(), now
        a = s & mask
        a += base
        a += row[:k]
        s += tables.take(a)
        # The step at which the walk leaves this character.
        gone[:, :k] = s
    found = []
    for walk in range(WALKS):
        lines = np.ascontiguousarray(left[:, walk].T)
        own = []
        for d, (a, b) in enumerate(slices):
            m = int(np.searchsorted(PLACES, lines[d, b - a - 1]))
            own.append(digit[a:b][np.searchsorted(lines[d, : b - a], PLACES[:m].astype(np.int32), "right")])
        found.append(own)
    for name, p in zip(names, zip(*found)):
        out[name] = p


def likeness(p: Print, q: Print) -> float:
    """The share of steps, by the samples that stand for them, at which two embeddings agree, of the best walk."""
    return max(_agreement(a, b) for a, b in zip(p, q))


def _agreement(a: np.ndarray, b: np.ndarray) -> float:
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    n, m = min(len(a), len(b)), max(len(a), len(b))
    same = a[:n] == b[:n]
    if n == m and same.all():
        return 1.0
    return float(WEIGHTS[:n][same].sum() / WEIGHTS[:m].sum())


def bands(p: Print) -> list[int]:
    """Hashes of all runs of BAND samples of each walk, from the first to the last, which may be shorter."""
    found = []
    for walk, a in enumerate(p):
        runs = np.zeros(-(-len(a) // BAND) * BAND, np.uint8)
        runs[: len(a)] = a
        runs = runs.view(U64)
        found += mix(runs + mix(np.arange(len(runs), dtype=U64) + U64((walk + 1) << 32))).view(np.int64).tolist()
    return found


def hash_bytes(data: bytes, salt: int) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, salt=salt.to_bytes(8, "little", signed=True)).digest(), "little", signed=True)


def edited(text: str, after: str) -> str:
    """The last third replaced by as much from the beginning of another text."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


# -------------------------------------------------------------------------------------------- Spark side


def print_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint, bands) for each row: one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _cuts(batch.column("body")):
                own = batch.slice(lo, hi - lo)
                texts = own.column("body").to_pylist()
                prints = fingerprints(texts)
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([written(p) for p in prints], pa.string()), pa.array([bands(p) for p in prints], pa.list_(pa.int64()))],
                    ["doc_id", "n_chars", "fingerprint", "bands"],
                )

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("body"))
    return slim.mapInArrow(shipped(run), "doc_id long, n_chars long, fingerprint string, bands array<long>")


def _cuts(column: pa.Array) -> Iterator[tuple[int, int]]:
    lo = total = 0
    for i, t in enumerate(column):
        n = len(t.as_buffer())
        if total and total + n > GROUP_CHARS:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(column):
        yield lo, len(column)


ENDS = np.dtype([("id", np.int64), ("tie", np.int64)])


def range_ends(keys: DataFrame, parts: int) -> np.ndarray:
    """The largest (id, tie) of each range of them; as many as there are ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = None
        for b in batches:
            own = _pairs(np.asarray(b.column(0), np.int64), np.asarray(b.column(1), np.int64))
            if len(own):
                top = own[np.lexsort((own["tie"], own["id"]))[-1:]]
                most = top if most is None or most[0].tolist() < top[0].tolist() else most
        if most is not None:
            yield pa.RecordBatch.from_arrays([pa.array(most["id"]), pa.array(most["tie"])], ["id", "tie"])

    found = sorted({(r["id"], r["tie"]) for r in keys.repartitionByRange(parts, "id", "tie").mapInArrow(shipped(run), "id long, tie long").collect()})
    return np.array(found, ENDS)


def _pairs(ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
    out = np.empty(len(ids), ENDS)
    out["id"], out["tie"] = ids, ties
    return out


def _range_of(ends: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The number of the range that each key is in."""
    order = np.lexsort((np.concatenate([keys["tie"], ends["tie"]]), np.concatenate([keys["id"], ends["id"]])))
    # Of equal ones, keys come first, as the sort is stable: a range's end belongs to it.
    is_end = order >= len(keys)
    part = np.empty(len(order), np.int64)
    part[order] = np.cumsum(is_end) - is_end
    return part[: len(keys)]


PRINTED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, shared_bands_edited int, shared_bands_next int"


def print_with_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The fingerprints of each document and of its edited text, and likenesses to that and to the next document.

    The next document is the one before in ascending order, and the last of all for the first. Texts go, compressed, to
    ranges of ids, and of a hash of the text where ids are null or equal; the last of a range goes to the next range as
    well, as the neighbour of its first. Only rows alike in id and text are never parted.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(FIRST)).alias("id"), F.col(doc_id).isNull().alias("unnamed"), text_of(text).alias("body"))

    def tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hash_bytes(t.as_buffer().to_pybytes(), 0) for t in batch.column(1)], pa.int64())], ["id", "tie"])

    ends = range_ends(slim.select("id", "body").mapInArrow(shipped(tied), "id long, tie long"), parts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for lo, hi in _cuts(batch.column("body")):
                own = batch.slice(lo, hi - lo)
                ids = np.asarray(own.column("id"), np.int64)
                raw = [t.as_buffer().to_pybytes() for t in own.column("body")]
                packed = pa.array([pack(t) for t in raw], pa.binary())
                tie = np.array([hash_bytes(t, 0) for t in raw], np.int64)
                keys = _pairs(ids, tie)
                part = _range_of(ends, keys)
                last = np.flatnonzero(keys == ends[part])
                take = pa.array(np.concatenate([np.arange(len(ids)), last]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([part, (part[last] + 1) % len(ends)]), pa.int32()), pa.array(np.arange(len(take)) >= len(ids)), pa.array(ids).take(take), own.column("unnamed").take(take), pa.array(tie).take(take), packed.take(take)],
                    ["part", "carried", "id", "unnamed", "tie", "packed"],
                )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        part, before, before_print = None, "", None
        rows: list[tuple] = []
        chars = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal rows, chars
            texts = [t for _, t, _, _ in rows]
            changed = [edited(t, after) for _, t, after, _ in rows]
            # A row whose neighbour isn't in this group brings that print, or its text to print.
            strangers = [after for i, (_, _, after, known) in enumerate(rows) if known is None]
            prints = fingerprints([*texts, *changed, *strangers])
            own, other, more = prints[: len(rows)], prints[len(rows) : 2 * len(rows)], iter(prints[2 * len(rows) :])
            lists = {f.split()[0]: [] for f in PRINTED.split(", ")}
            for i, (name, t, _, known) in enumerate(rows):
                after = next(more) if known is None else own[i - 1] if known is True else known
                mine = set(bands(own[i]))
                row = (name, len(t), hashlib.sha256(changed[i].encode("utf-8", "surrogatepass")).hexdigest(), written(own[i]), written(other[i]),
                       likeness(own[i], other[i]), likeness(own[i], after), len(mine.intersection(bands(other[i]))), len(mine.intersection(bands(after))))
                for x, v in zip(lists.values(), row):
                    x.append(v)
            rows, chars = [], 0
            kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32()}
            result = pa.RecordBatch.from_arrays([pa.array(lists[f.split()[0]], kinds[f.split()[1]]) for f in PRINTED.split(", ")], list(lists))
            yield result
            return own[-1]

        for batch in batches:
            for own, carried, name, unnamed, packed in zip(*(batch.column(c).to_pylist() for c in ("part", "carried", "id", "unnamed")), batch.column("packed")):
                text = unpack(packed.as_buffer()).decode("utf-8", "surrogatepass") if len(packed.as_buffer()) else ""
                if own != part:
                    if rows:
                        yield from flush()
                    part, before_print = own, None
                if carried:
                    before, before_print = text, None
                    continue
                known = True if rows else before_print
                rows.append((None if unnamed else name, text, before, known))
                before = text
                chars += len(text)
                if chars > GROUP_CHARS:
                    before_print = yield from flush()
        if rows:
            yield from flush()

    dealt = slim.mapInArrow(shipped(deal), "part int, carried boolean, id long, unnamed boolean, tie long, packed binary").repartitionById(parts, F.col("part"))
    return dealt.sortWithinPartitions("part", F.desc("carried"), "id", "tie").mapInArrow(shipped(walk), PRINTED)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.8, *, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_chars, class_id) for each row: class_id is the smallest id of its near copies, itself included.

    Distinct fingerprints that share a band are compared whole, each with each unless they are already connected, and
    linked by a likeness of at least `least`. A band of more than `block` fingerprints is dealt into blocks, and each pair
    of blocks goes to a task; bands with the same members count once. A band that very many unlike texts share costs work
    with the square of their number. Texts that are alike without a band in common are not met. Rows with equal
    fingerprints are one from the start. Rows with a null id are left out, as they could not be named.
    """
    rows = print_documents(docs, doc_id, text).filter("doc_id IS NOT NULL").withColumn("node", F.xxhash64("fingerprint"))
    rows = materialise(rows, "prints")
    prints = materialise(rows.select("node", "fingerprint", "bands").dropDuplicates(["node"]), "classes")
    banded = prints.select("node", F.explode(F.array_distinct("bands")).alias("band"))
    digests = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"m{i}") for i in (1, 2)]
    members = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), *digests).filter("n > 1")
    members = members.groupBy("n", "m1", "m2").agg(F.min("band").alias("band"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = banded.join(members.select("band", blocks.alias("blocks")), "band")
    dealt = dealt.withColumn("blk", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    sides = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("blk", k).alias("i"), F.greatest("blk", k).alias("j")))
    placed = dealt.select("node", "band", "blk", F.explode(sides).alias("t")).select("node", "band", "t.i", "t.j", "blk").join(prints.select("node", "fingerprint"), "node")
    placed = placed.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").select("band", "i", "j", "blk", "node", "fingerprint")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def settle() -> Iterator[pa.RecordBatch]:
            if len(held) < 2:
                return
            blk, names = np.array([h[0] for h in held]), np.array([h[1] for h in held], np.int64)
            label = connect([parsed(h[2]) for h in held], blk if key[1] != key[2] else None, least)
            other = names != names[label]
            if other.any():
                yield pa.RecordBatch.from_arrays([pa.array(names[other]), pa.array(names[label][other])], ["a", "b"])

        for batch in batches:
            for *own, blk, node, fingerprint in zip(*(c.to_pylist() for c in batch.columns)):
                if own != key:
                    yield from settle()
                    key, held = own, []
                held.append((blk, node, fingerprint))
        yield from settle()

    roots = components(placed.mapInArrow(shipped(verify), "a long, b long"))
    full = rows.select("doc_id", "n_chars", "node").join(roots, "node", "left").select("doc_id", "n_chars", F.coalesce("root", "node").alias("root"))
    smallest = full.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return full.join(smallest, "root").select("doc_id", "n_chars", "class_id")


def connect(prints: list[Print], side: np.ndarray | None, least: float) -> np.ndarray:
    """For each fingerprint the first one of its component. With side, only pairs across sides are looked at."""
    grids, sizes, totals = [], [], []
    for walk in zip(*prints):
        size = np.array([len(a) for a in walk])
        grid = np.zeros((len(walk), int(size.max())), np.uint8)
        for row, a in zip(grid, walk):
            row[: len(a)] = a
        grids.append(grid)
        sizes.append(size)
        totals.append(np.cumsum(WEIGHTS)[size - 1])
    label = np.arange(len(prints))
    for i in range(len(prints) - 1):
        j = np.arange(i + 1, len(prints))
        j = j[label[j] != label[i]]
        if side is not None:
            j = j[side[j] != side[i]]
        near = np.zeros(len(j), bool)
        for grid, size, total in zip(grids, sizes, totals):
            # Lengths too far apart can't be alike; beyond a text's end no sample is equal.
            may = np.flatnonzero(~near & (np.minimum(total[i], total[j]) >= least * np.maximum(total[i], total[j])))
            n = int(size[i])
            near[may] = (grid[j[may], :n] == grid[i, :n]) @ WEIGHTS[:n] / np.maximum(total[i], total[j[may]]) >= least
        joined = np.unique(np.append(label[j[near]], label[i]))
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]
    return label


def parsed(text: str) -> Print:
    """A fingerprint from its text."""
    return tuple(np.frombuffer(x.encode(), np.uint8) for x in text.split("-")) if text else (HEX[:0],) * WALKS
