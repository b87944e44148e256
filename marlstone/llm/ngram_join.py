"""N-gram Jaccard join: size-banded tiles, bitmap signatures, then exact intersection of sorted arrays.

A document is the sorted array of the 64-bit hashes of its distinct shingles. Documents with equal arrays are one
class. Classes are banded by size, so that a class links only within its band or with a neighbouring one. Inside a
band the hash range is cut into more parts than two linked sets can have differing shingles: of two linked sets some
parts are equal in both, whatever the data. A tile is (band, part, content of the part); sharing a tile makes
candidates, and none is lost. A set ignores a few of its parts that tell least, so that a passage which a third of all
documents share doesn't make them candidates. Tiles are met by hash, map-side combined: of the classes that share a tile in one chunk
only one goes on, with edges to the others, so the classes of a common tile never meet in one task.

Candidates form groups (components of the tile edges). Documents that share passages make long chains of candidates, so
groups are refined first by what costs little to send: every class has a hashed bitmap of about two bits to a shingle,
and the bits in which two bitmaps differ bound their overlap from above. Pairs whose bound allows a link make the new
groups; a true link is always among them. Then a group's arrays come to one task, and there the pairs that the bound
lets through are settled by exact intersection, unless they are already connected: what is asked for is connection, so
copies are not expanded into all pairs.

Larger groups are dealt into blocks by size. For bitmaps, pairs of blocks that sizes allow go to a task each. Arrays are
settled inside each block first, then inside other blocks dealt by hash, so that the parts of one large group of copies
find each other with every array sent twice, whatever the group's size. Only classes that are then outside their group's
largest component are compared, in blocks of their own, with all blocks of the group.

Hashes of shingles and of sets have 64 bits: two different ones are taken for the same with a chance of about 2**-64,
unless someone who knows the constants makes them so.

Defined results: null, empty and white texts have an empty set, link with nothing and are their own component; texts
with fewer words than a shingle have the whole sequence as their one shingle; rows with equal ids are rows of their own
that happen to be named alike; a null id is never the smallest, and a component of null ids alone has a null id. A very
long text is a set like others: its array is held whole, eight bytes for each distinct shingle. Only the id and the text
are read, so extra columns don't matter.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm import bitfilter
from marlstone.llm.common import fresh, materialise, shipped, text_of
from marlstone.llm.components import components, forest
from marlstone.llm.wordhash import U64, Words, mix, text_groups

WORDS, PERCENT = 3, 90
CHUNK_SIGNATURES = 400_000
BLOCK, SMALL = 2048, 1000
LEAST_BITS = 512
HEAVY_BITS, BITMAP_BYTES = 1 << 23, 1 << 23
HEAVY_SHARE, COUNTED = 0.0005, 500_000
_K = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53]


# -------------------------------------------------------------------------------------------- sets and signatures


def _runs(w: Words, words: int) -> np.ndarray:
    """The hash of the shingle that begins at each word, whether or not its text goes on that far."""
    run = np.zeros(max(len(w.hash) - words + 1, 0), U64)
    for j in range(words):
        run += w.hash[j : j + len(run)] * U64(_factor(j))
    return mix(run)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """For each text its distinct shingles, hashed, in ascending order. A-Z count as a-z."""
    w = Words(data, bounds, lower=True)
    h, run, out = w.hash, _runs(w, words), []
    for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist()):
        if b - a >= words:
            s = np.sort(run[a : b - words + 1])
        elif b > a:
            s = mix(sum((h[a + j : a + j + 1] * U64(_factor(j)) for j in range(b - a)), U64(b - a)))
        else:
            s = run[:0]
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s)
    return out


def _factor(j: int) -> int:
    return (_K[j % len(_K)] + 2 * (j // len(_K)) * 0x9E3779B97F4A7C15) % (1 << 64) | 1


def set_hash(s: np.ndarray) -> int:
    total = int(mix(s ^ U64(_K[3])).sum(dtype=U64)) + len(s) * _K[1]
    return int(mix(np.array([total % (1 << 64)], U64))[0])


@lru_cache
def band_edges(percent: int) -> tuple[int, ...]:
    """Least sizes of the bands. A set at least percent / 100 times as large as one in a band is in it or the one below."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, -(-edges[-1] * 100 // percent)))
    return tuple(edges)


@lru_cache(maxsize=None)
def band_parts(band: int, percent: int) -> tuple[int, int, int]:
    """Differing shingles that two linked sets can have if the larger is in the band; parts; parts that a set may ignore."""
    high = band_edges(percent)[band + 1] - 1
    # 100 i >= percent u with i = (a + b - d) / 2 and u = (a + b + d) / 2 gives d <= (a + b) (100 - percent) / (100 + percent).
    differing = 2 * high * (100 - percent) // (100 + percent)
    ignored = (differing + 1) // 6 if high >= 40 else 0
    return differing, differing + 1 + 2 * ignored, ignored


@lru_cache(maxsize=4096)
def _thresholds(parts: int) -> np.ndarray:
    return np.array([(i << 64) // parts for i in range(1, parts)], U64)


def signatures(s: np.ndarray, percent: int, heavy: np.ndarray | None = None) -> np.ndarray:
    """The tiles of a set: its parts' contents, for its own band and, as the smaller of two, for the next.

    Linked sets agree in 2 x ignored + 1 parts or more. So each may ignore some of its own, whichever it likes, and one
    is left that neither ignores. It ignores those that tell least: the ones with the fewest shingles that are not heavy,
    such as empty parts and parts that hold nothing but words of a passage that very many documents have.
    """
    out = []
    home = bisect_right(band_edges(percent), len(s)) - 1
    sums = np.zeros(len(s) + 1, U64)
    np.cumsum(mix(s ^ U64(_K[4])), out=sums[1:])
    light = np.arange(len(s) + 1) if heavy is None else np.concatenate([[0], np.cumsum(~bitfilter.may_have(heavy, s))])
    for band in (home, home + 1):
        differing, parts, ignored = band_parts(band, percent)
        if differing == 0:
            continue
        cuts = np.concatenate([[0], np.searchsorted(s, _thresholds(parts)), [len(s)]])
        tile = mix(sums[cuts[1:]] - sums[cuts[:-1]] + mix(np.arange(parts, dtype=U64) + U64(band << 32)))
        if ignored:
            telling = (light[cuts[1:]] - light[cuts[:-1]]) * (len(s) + 1) + np.diff(cuts)
            tile = tile[np.argsort(telling, kind="stable")[ignored:]]
        out.append(tile)
    return np.concatenate(out) if out else np.zeros(0, U64)


# -------------------------------------------------------------------------------------------- pairs within one task


def linked(i: int, a: int, b: int, percent: int) -> bool:
    return 100 * i >= percent * (a + b - i)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two ascending arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum()) if len(b) else 0


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 64-bit words for each set; each shingle sets one bit, about eight bits to a shingle of the largest set.

    All rows together have no more than BITMAP_BYTES (or eight bytes each): narrower ones bound less tightly, and right.
    """
    bits = max(6, min((8 * max(map(len, sets)) - 1).bit_length(), (8 * BITMAP_BYTES // len(sets)).bit_length() - 1))
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = (np.concatenate(sets) * U64(_K[5]) >> U64(64 - bits)).astype(np.int64)
    grid = np.zeros((len(sets), 1 << (bits - 3)), np.uint8)
    np.bitwise_or.at(grid, (rows, at >> 3), (1 << (at & 7)).astype(np.uint8))
    return grid.view(U64)


def width(size: int) -> int:
    """The bits in the bitmap of a class: a power of two, two bits to a shingle or more."""
    return max(LEAST_BITS, 1 << (2 * size - 1).bit_length())


def bitmap(s: np.ndarray) -> np.ndarray:
    """A bit for each shingle, by the low bits of a hash: one of half the width is the two halves laid over each other."""
    bits = width(len(s))
    grid = np.zeros(bits >> 3, np.uint8)
    at = ((s * U64(_K[5]) >> U64(20)) & U64(bits - 1)).astype(np.int64)
    np.bitwise_or.at(grid, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return grid.view(U64)


def may_link(sizes: np.ndarray, maps: list[np.ndarray], side: np.ndarray | None, percent: int) -> np.ndarray:
    """For each bitmap the place of one that stands for its component, of all pairs whose bitmaps allow a link.

    With side, only pairs across sides are looked at.
    """
    order = np.argsort(sizes, kind="stable")
    size = sizes[order]
    wide = np.array([len(maps[k]) for k in order])
    label = np.arange(len(size))
    have, first, grid = 0, 0, None
    for i in range(len(size) - 1):
        top = int(np.searchsorted(size, size[i] * 100 // percent, "right"))
        if top == i + 1:
            continue
        if wide[i] != have:
            # Rows of this width, and wider ones that their sizes allow, folded to it.
            have, first = int(wide[i]), i
            last = int(np.searchsorted(size, size[int(np.searchsorted(wide, have, "right")) - 1] * 100 // percent, "right"))
            grid = np.empty((last - i, have), U64)
            for row, k in zip(grid, order[i:last]):
                row[:] = np.bitwise_or.reduce(maps[k].reshape(-1, have), axis=0)
        j = np.arange(i + 1, top)
        j = j[label[j] != label[i]]
        if side is not None:
            j = j[side[order[j]] != side[order[i]]]
        if not len(j):
            continue
        differ = np.bitwise_count(grid[j - first] ^ grid[i - first]).sum(axis=1, dtype=np.int64)
        most = np.minimum((size[i] + size[j] - differ) // 2, size[i])
        joined = np.unique(np.append(label[j[100 * most >= percent * (size[i] + size[j] - most)]], label[i]))
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]
    # Labels are places in the order of sizes; callers know the places of what they gave.
    out = np.empty(len(size), np.int64)
    out[order] = order[label]
    return out


def connect(sets: list[np.ndarray], side: np.ndarray | None, percent: int, known: np.ndarray | None = None) -> np.ndarray:
    """Labels of the sets' components. With side (0 or 1 for each set), only pairs across sides are looked at; sets with
    equal `known` are connected already."""
    order = np.array(sorted(range(len(sets)), key=lambda k: len(sets[k])))
    sets = [sets[k] for k in order]
    size = np.array([len(s) for s in sets], np.int64)
    label = np.arange(len(sets)) if known is None else np.unique(known, return_inverse=True)[1][order]
    bits = bitmaps(sets)
    for i in range(len(sets) - 1):
        # Sizes ascend: partners of i end where i is too small for them.
        top = int(np.searchsorted(size, size[i] * 100 // percent, "right"))
        j = np.arange(i + 1, top)
        j = j[label[j] != label[i]]
        if side is not None:
            j = j[side[order[j]] != side[order[i]]]
        if len(j):
            # Differing bits are at most as many as differing shingles, so this bounds the overlap from above.
            differ = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
            most = (size[i] + size[j] - differ) // 2
            good = 100 * most >= percent * (size[i] + size[j] - most)
            j = j[good][np.argsort(differ[good], kind="stable")]
        while len(j):
            k, j = int(j[0]), j[1:]
            if linked(overlap(sets[i], sets[k]), int(size[i]), int(size[k]), percent):
                a, b = label[i], label[k]
                label[label == max(a, b)] = min(a, b)
                j = j[label[j] != label[i]]
    out = np.empty(len(sets), np.int64)
    out[order] = label
    return out


# -------------------------------------------------------------------------------------------- Spark side


def _signed(h) -> np.ndarray:
    return np.asarray(h, U64).view(np.int64)


def heavy_shingles(docs: DataFrame, text: str, words: int, share: float = HEAVY_SHARE) -> np.ndarray:
    """A bit filter of the shingles that at least about this share of all documents has.

    There are no more such shingles than a document has, divided by the share, however many documents there are. Each
    task counts all of its texts and sends the shingles that are frequent with it; Spark adds up. What is in the filter
    decides which parts a set prefers to ignore, never which sets link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many, docs_held, size = [np.zeros(0, U64)], [np.zeros(0, np.int64)], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, many, docs_held, size
            h, back = np.unique(np.concatenate(held), return_inverse=True)
            n = np.bincount(back, np.concatenate(many), len(h)).astype(np.int64)
            frequent = n >= max(3, docs_held * share / 2)
            held, many, docs_held, size = [np.zeros(0, U64)], [np.zeros(0, np.int64)], 0, 0
            return pa.RecordBatch.from_arrays([pa.array(h[frequent].view(np.int64)), pa.array(n[frequent])], ["h", "n"])

        for batch, data, bounds in text_groups(batches, "body"):
            h, n = np.unique(_runs(Words(data, bounds, lower=True), words), return_counts=True)
            held.append(h)
            many.append(n)
            docs_held += batch.num_rows
            size += len(h)
            if size >= COUNTED:
                yield flush()
        yield flush()

    slim = docs.select(text_of(text).alias("body"))
    counts = slim.mapInArrow(shipped(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return bitfilter.build(counts.filter(F.col("n") >= max(8, docs.count() * share)), "h", HEAVY_BITS)


PASS, MET = "kind string, r int, x binary, y binary, z binary", "kind string, x binary, y binary, z binary"


def tile_pass(docs: DataFrame, doc_id: str, text: str, words: int, percent: int, reducers: int) -> DataFrame:
    """Reads each text and gives, by kind: d (ids, sizes, classes of documents), b (classes, sizes and bitmaps, once for a
    chunk) and e (classes that share a tile, as stars).

    Of the classes of a chunk that share a tile one goes on, to the task that has the tile, with edges to the others; the
    tasks make stars of what meets with them and hand the rest on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: list[np.ndarray] = []
        nodes: list[int] = []
        shown: list[tuple[int, np.ndarray]] = []
        seen: set[int] = set()
        total, turn = 0, TaskContext.get().partitionId() * 7

        def row(kind, r, *blobs):
            return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([r], pa.int32()), *(pa.array([b.tobytes()], pa.binary()) for b in blobs)], ["kind", "r", "x", "y", "z"])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal tiles, nodes, shown, total
            if not total:
                return
            yield row("b", (turn + 1) % reducers, np.array(nodes, np.int64), np.array([n for n, _ in shown], np.int64), np.concatenate([m for _, m in shown]))
            shown = []
            tile, node = np.concatenate(tiles), np.repeat(np.array(nodes, np.int64), [len(t) for t in tiles])
            tiles, nodes, total = [], [], 0
            order = np.argsort(tile, kind="stable")
            tile, node = tile[order], node[order]
            first = np.concatenate([[True], tile[1:] != tile[:-1]])
            head = node[first][np.cumsum(first) - 1]
            a, b = forest(*np.unique(np.stack([node[~first], head[~first]]), axis=1))
            if len(a):
                yield row("e", turn % reducers, a, b, a[:0])
            keep = np.sort(order[first])
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            tile, node = tile[back[keep]], node[back[keep]]
            to = ((tile >> U64(40)) % U64(reducers)).astype(np.int64)
            by = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[by], np.arange(reducers + 1))
            for r in range(reducers):
                own = by[cuts[r] : cuts[r + 1]]
                if len(own):
                    start = np.concatenate([[True], node[own][1:] != node[own][:-1]])
                    runs = np.diff(np.append(np.flatnonzero(start), len(own))).astype(np.int32)
                    yield row("p", r, tile[own], node[own][start], runs)

        for batch, data, bounds in text_groups(batches, "body"):
            ids = batch.column(0)
            sets = shingle_sets(data, bounds, words)
            hashes = [set_hash(s) for s in sets]
            sizes = np.array([len(s) for s in sets], np.int64)
            known = np.asarray(ids.is_valid())
            # Null ids are told by the sign of the size.
            turn += 1
            yield row("d", turn % reducers, np.asarray(ids.fill_null(0), np.int64), np.where(known, sizes, -1 - sizes), _signed(hashes))
            for s, h in zip(sets, hashes):
                if len(s) and h not in seen:
                    seen.add(h)
                    own = signatures(s, percent, heavy.value)
                    if len(own):
                        tiles.append(own)
                        shown.append((len(s), bitmap(s)))
                        nodes.append(h - (1 << 64) if h >> 63 else h)
                        total += len(own)
            if total >= CHUNK_SIGNATURES:
                yield from flush()
                seen.clear()
        yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, nodes = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for batch in batches:
            posted = pa.compute.equal(batch.column("kind"), "p")
            yield batch.select(["kind", "x", "y", "z"]).filter(pa.compute.invert(posted))
            mine = batch.filter(posted)
            for x, y, z in zip(*(mine.column(c).to_pylist() for c in ("x", "y", "z"))):
                tiles.append(np.frombuffer(x, U64))
                nodes.append(np.repeat(np.frombuffer(y, np.int64), np.frombuffer(z, np.int32)))
        tile, node = np.concatenate(tiles), np.concatenate(nodes)
        tiles.clear(), nodes.clear()
        if not len(tile):
            return
        order = np.argsort(tile, kind="stable")
        tile, node = tile[order], node[order]
        first = np.concatenate([[True], tile[1:] != tile[:-1]])
        head = node[first][np.cumsum(first) - 1]
        a, b = node[~first], head[~first]
        a, b = forest(a[a != b], b[a != b])
        yield pa.RecordBatch.from_arrays([pa.array(["e"]), *(pa.array([v.tobytes()], pa.binary()) for v in (a, b, a[:0]))], ["kind", "x", "y", "z"])

    heavy = docs.sparkSession.sparkContext.broadcast(heavy_shingles(docs, text, words))
    slim = docs.select(F.col(doc_id).cast("long").alias("id"), text_of(text).alias("body"))
    dealt = slim.mapInArrow(shipped(run, heavy), PASS).repartitionById(reducers, F.col("r"))
    return materialise(dealt.mapInArrow(shipped(meet), MET), "tiles")


def _unpack(rows: DataFrame, schema: str, columns) -> DataFrame:
    """A row for each element of the arrays that columns(x, y, z) makes of the blobs."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blobs in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "z"))):
                yield pa.RecordBatch.from_arrays(columns(*(np.frombuffer(b, np.int64) if len(b) % 8 == 0 else b for b in blobs)), names)

    return rows.select("x", "y", "z").mapInArrow(shipped(run), schema)


def _bitmap_rows(nodes: np.ndarray, sizes: np.ndarray, blob: np.ndarray) -> list[pa.Array]:
    ends = np.concatenate([[0], np.cumsum([width(n) >> 3 for n in sizes.tolist()])]).astype(np.int32)
    return [pa.array(nodes), pa.array(sizes), pa.Array.from_buffers(pa.binary(), len(nodes), [None, pa.py_buffer(ends), pa.py_buffer(blob.tobytes())])]


def class_sets(docs: DataFrame, text: str, words: int, grid) -> DataFrame:
    """(node, s): the arrays of the classes that the filter lets through, once for each task at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, data, bounds in text_groups(batches, "body"):
            names, arrays = [], []
            sets = shingle_sets(data, bounds, words)
            hashes = [set_hash(s) for s in sets]
            for s, h, may in zip(sets, hashes, bitfilter.may_have(grid.value, np.array(hashes, U64)).tolist()):
                if len(s) and may and h not in seen:
                    seen.add(h)
                    names.append(h)
                    arrays.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(_signed(names)), pa.array(arrays, pa.binary())], ["node", "s"])

    return docs.select(text_of(text).alias("body")).mapInArrow(shipped(run, grid), "node long, s binary")


def verified(placed: DataFrame, percent: int) -> DataFrame:
    """From (root, i, j, side, label, node, s): (a, b, split) stars of linked classes for each task (root, i, j).

    side: only classes of side 0 and 1 are compared with each other; -1 for all with all. label: what a class is known to
    be connected to. split: whether the task was a part of its group.
    """
    columns = ["root", "i", "j", "side", "label", "node"]
    placed = placed.select(*columns, "s").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def settle() -> Iterator[pa.RecordBatch]:
            if len(held) < 2:
                return
            side, names = (np.array(x, np.int64) for x in zip(*held))
            known = np.array([v[0] for v in held.values()], np.int64)
            label = connect([v[1] for v in held.values()], side if side[0] >= 0 else None, percent, known)
            # The smallest class of each component is its star's middle.
            least = np.full(len(names), np.iinfo(np.int64).max)
            np.minimum.at(least, label, names)
            other = names != least[label]
            if other.any():
                yield pa.RecordBatch.from_arrays([pa.array(names[other]), pa.array(least[label][other]), pa.array([key[1] > 0] * int(other.sum()))], ["a", "b", "split"])

        for batch in batches:
            for *own, side, label, node, s in zip(*(batch.column(c).to_pylist() for c in columns), batch.column("s")):
                if own != key:
                    yield from settle()
                    key, held = own, {}
                if (side, node) not in held:
                    held[side, node] = (label, np.frombuffer(s.as_buffer(), U64).copy())
        yield from settle()

    return placed.mapInArrow(shipped(run), "a long, b long, split boolean")


def component_ids(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs."""
    spark = docs.sparkSession
    reducers = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = tile_pass(docs, doc_id, text, words, percent, reducers)

    named = _unpack(parts.filter("kind = 'd'"), "doc_id long, n long, node long", lambda x, y, z: [pa.array(x, mask=y < 0), pa.array(np.where(y < 0, -1 - y, y)), pa.array(z)])
    met = _unpack(parts.filter("kind = 'e'"), "a long, b long", lambda x, y, _: [pa.array(x), pa.array(y)])
    maps = _unpack(parts.filter("kind = 'b'"), "node long, n long, bits binary", _bitmap_rows)
    candidates = refined(components(met), maps, percent, block)
    roots = resolve(docs, text, named, materialise(candidates, "candidates", few_files=True), words, percent, block)

    full = named.filter("n > 0").join(roots, "node", "left").select("doc_id", "n", F.coalesce("root", "node").alias("root"))
    least = full.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    with_sets = full.join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return with_sets.union(named.filter("n = 0").select("doc_id", "n", "doc_id"))


def dealt_blocks(sizes: DataFrame, block: int, small: int) -> DataFrame:
    """From (node, root, n): (node, root, n, blk), every group in blocks by size.

    A block has up to `block` classes of at most `small` shingles, or as many shingles as that many of these.
    """
    # Blocks by size: from sums for each size, and by hash among equal sizes.
    weight = F.col("many") * F.greatest(F.lit(1.0), F.col("n") / small)
    counts = sizes.groupBy("root", "n").agg(F.count(F.lit(1)).alias("many")).withColumn("weight", weight)
    upward = Window.partitionBy("root").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("root", "n", "weight", F.coalesce(F.sum("weight").over(upward), F.lit(0.0)).alias("ahead"), F.sum("weight").over(Window.partitionBy("root")).alias("all"))
    share = F.pmod(F.xxhash64("node"), F.lit(1 << 20)) / float(1 << 20)
    # Block 0 is a whole group; the blocks of a larger one count from 1.
    number = F.when(F.col("all") <= block, 0).otherwise(1 + F.floor((F.col("ahead") + share * F.col("weight")) / block)).cast("int")
    dealt = materialise(sizes.join(counts, ["root", "n"]).select("node", "root", "n", number.alias("blk")), "blocks", few_files=True)
    return dealt


def with_tasks(dealt: DataFrame, percent: int) -> DataFrame:
    """dealt with a list of the pairs of blocks (i, j) that a block takes part in and that sizes allow."""
    blocks = dealt.groupBy("root", "blk").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    l, r = blocks.alias("l"), blocks.alias("r")
    allowed = (F.col("l.root") == F.col("r.root")) & (F.col("l.blk") <= F.col("r.blk")) & (100 * F.col("l.high") >= percent * F.col("r.low"))
    tasks = l.join(r, allowed).select(F.col("l.root").alias("root"), F.col("l.blk").alias("i"), F.col("r.blk").alias("j"))
    sides = tasks.select("root", F.col("i").alias("blk"), "i", "j").union(tasks.filter("i != j").select("root", F.col("j").alias("blk"), "i", "j"))
    # One task for all but the largest groups.
    sides = sides.groupBy("root", "blk").agg(F.collect_list(F.struct("i", "j")).alias("tasks"))
    return dealt.join(sides, ["root", "blk"])


def to_tasks(placed: DataFrame, column: str) -> DataFrame:
    """(root, i, j, blk, n, node, column) with all rows of a task (root, i, j) in one partition and in a row."""
    placed = placed.select("root", F.explode("tasks").alias("t"), "blk", "n", "node", column).select("root", "t.i", "t.j", "blk", "n", "node", column)
    return placed.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")


def refined(candidates: DataFrame, bitmaps_: DataFrame, percent: int, block: int) -> DataFrame:
    """(node, root): the groups that are left of candidates when only pairs whose bitmaps allow a link count. bitmaps_: (node, n, bits), repeated ones allowed."""
    sizes = candidates.join(bitmaps_.select("node", "n").distinct(), "node")
    # Bitmaps are about a thirtieth of arrays.
    placed = to_tasks(bitmaps_.select("node", "bits").join(with_tasks(dealt_blocks(sizes, 4 * block, 8 * SMALL), percent), "node"), "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def settle() -> Iterator[pa.RecordBatch]:
            if len(held) < 2:
                return
            names = np.array(list(held), np.int64)
            blk, size = (np.array([v[k] for v in held.values()]) for k in (0, 1))
            label = may_link(size, [v[2] for v in held.values()], blk if key[1] != key[2] else None, percent)
            other = label != np.arange(len(label))
            if other.any():
                yield pa.RecordBatch.from_arrays([pa.array(names[other]), pa.array(names[label][other])], ["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("root", "i", "j", "blk", "n", "node")]
            for *own, blk, n, node, bits in zip(*columns, batch.column("bits")):
                if own != key:
                    yield from settle()
                    key, held = own, {}
                if node not in held:
                    held[node] = (blk, n, np.frombuffer(bits.as_buffer(), U64).copy())
        yield from settle()

    return components(placed.mapInArrow(shipped(run), "a long, b long"))


def resolve(docs: DataFrame, text: str, named: DataFrame, candidates: DataFrame, words: int, percent: int, block: int) -> DataFrame:
    """(node, root) of the true components, for classes that have a link."""
    sizes = candidates.join(named.select("node", "n").distinct(), "node")
    dealt = dealt_blocks(sizes, block, SMALL)

    def arrays(nodes: DataFrame) -> DataFrame:
        """Rows of nodes with their arrays, once for each task that has the class and each row of nodes."""
        # False hits, of which there are more when the filter has reached its bound, only cost the shuffle of their arrays.
        names = nodes.select("node").distinct()
        grid = docs.sparkSession.sparkContext.broadcast(bitfilter.build(names, "node", bitfilter.bits_for(names.count())))
        return class_sets(docs, text, words, grid).join(nodes, "node")

    alone = [F.lit(-1).alias("side"), F.col("node").alias("label")]
    links = materialise(verified(arrays(dealt.select("node", "root", F.col("blk").alias("i"), F.col("blk").alias("j"), *alone)), percent), "links")
    settled = links.filter("NOT split")
    roots = settled.select(F.col("a").alias("node"), F.col("b").alias("root")).union(settled.select("b", "b").distinct())
    parted = dealt.filter("blk > 0")
    if parted.isEmpty():
        return roots

    # The same groups in other blocks, by hash: parts of one component find each other.
    blocks = parted.groupBy("root").agg(F.max("blk").alias("blocks"))
    other = (1 + F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks"))).cast("int")
    crossed = parted.join(blocks, "root").select("node", "root", other.alias("i"), other.alias("j"), *alone)
    links = materialise(links.filter("split").union(verified(arrays(crossed), percent)).select("a", "b"), "links")

    # What is outside its group's largest component, against all of the group.
    labels = components(links).withColumnRenamed("root", "label")
    known = materialise(parted.join(labels, "node", "left").select("node", "root", "n", "blk", F.coalesce("label", "node").alias("label")), "labels", few_files=True)
    largest = known.groupBy("root", "label").agg(F.count(F.lit(1)).alias("many")).groupBy("root").agg(F.max(F.struct("many", "label")).alias("top"))
    outside = known.join(largest, "root").filter(F.col("label") != F.col("top.label")).drop("top")
    if not outside.isEmpty():
        few = dealt_blocks(outside.select("node", "root", "n"), block, SMALL).withColumnRenamed("blk", "part").join(known.select("node", "label"), "node")
        bounds = [F.min("n").alias("low"), F.max("n").alias("high")]
        l, r = few.groupBy("root", "part").agg(*bounds).alias("l"), known.groupBy("root", "blk").agg(*bounds).alias("r")
        allowed = (F.col("l.root") == F.col("r.root")) & (100 * F.col("l.high") >= percent * F.col("r.low")) & (100 * F.col("r.high") >= percent * F.col("l.low"))
        tasks = materialise(l.join(r, allowed).select("l.root", "part", "blk"), "tasks", few_files=True)
        columns = ["node", "root", (F.col("part") + 1).alias("i"), F.col("blk").alias("j"), F.col("side"), "label"]
        from_few = few.join(tasks, ["root", "part"]).withColumn("side", F.lit(0)).select(*columns)
        from_all = known.join(tasks, ["root", "blk"]).withColumn("side", F.lit(1)).select(*columns)
        links = links.union(verified(arrays(from_few.union(from_all)), percent).select("a", "b"))
        labels = components(links).withColumnRenamed("root", "label")
    return roots.union(labels.select("node", F.col("label").alias("root")))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with one row of each component: the one with the smallest id, null being larger than all others.

    Rows with equal ids and different texts stand in the order of a hash of the text. Of rows alike in id and text one
    stays, by a hash of all columns. Rows without shingles stay.
    """
    key, place = fresh("row_key", docs.columns), fresh("row_place", docs.columns)
    named = F.col(doc_id).cast("long")
    tie = F.xxhash64(text_of(text))
    keyed = docs.withColumn(key, F.xxhash64(named, named.isNull(), tie))
    ids = component_ids(keyed, key, text, **how).filter("n_shingles > 0")
    ids = ids.groupBy(F.col("doc_id").alias("key")).agg(F.min("component_id").alias("component"), F.count(F.lit(1)).alias("n"))
    order = F.struct(named.isNull().alias("unnamed"), named.alias("id"), tie.alias("tie"))
    places = docs.select(F.xxhash64(named, named.isNull(), tie).alias("key"), order.alias("place")).distinct()
    placed = places.join(ids, "key")
    first = placed.groupBy("component").agg(F.min("place").alias("first"))
    # The rows that may go: those of keys that aren't their component's first, and all but one of a repeated first.
    judged = placed.join(first, "component").select("key", "n", (F.col("place") == F.col("first")).alias("stays"))
    judged = materialise(judged.filter("n > 1 OR NOT stays"), "judged", few_files=True)
    rest = keyed.join(judged.select(F.col("key").alias(key)), key, "left_anti").select(*docs.columns)
    repeated = judged.filter("stays").select(F.col("key").alias(key))
    if repeated.isEmpty():
        return rest
    among = Window.partitionBy(key).orderBy(F.xxhash64(*docs.columns))
    one = keyed.join(repeated, key, "left_semi").withColumn(place, F.row_number().over(among)).filter(F.col(place) == 1)
    return rest.union(one.select(*docs.columns))
