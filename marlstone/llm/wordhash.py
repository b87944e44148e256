"""Words of whole texts as 64-bit hashes, found in Arrow's own bytes without making a string of any word.

A word is a run of anything but the six ASCII white-space characters; these bytes never occur inside a longer UTF-8
character, so bytes suffice. A word's bytes are taken eight at a time, and each such piece goes through a mixing function
that is one to one; words of more than 32 bytes are hashed by xxhash. So different words of up to eight bytes and equal
length never share a hash, and others do with a chance of about 2**-64 for a pair, unless someone who knows the
constants makes them so. Where a word must be known exactly, a Lexicon compares bytes.

Rolling hashes are polynomials modulo the prime 2**61 - 1. (Modulo a power of two, sequences of Thue and Morse's kind
collide for every base.)

Work goes over pieces of limited length, cut at white space, so a very long text costs 24 bytes for each of its words
and little else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash

GROUP_BYTES = 1_500_000
U64 = np.uint64
SHORT = 32
_SEED, _STEP = U64(0x8CB92BA72F3D8DD7), U64(0x9E3779B97F4A7C15)
IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
IS_ALNUM = np.zeros(256, bool)
IS_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a hash over all of it, one to one (the finaliser of splitmix64)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


# ------------------------------------------------------------------------------ arithmetic modulo 2**61 - 1

PRIME = (1 << 61) - 1
_P, _HALF, _LOW = U64(PRIME), U64((1 << 32) - 1), U64((1 << 29) - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime."""
    x = (x & _P) + (x >> U64(61))
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, for a and b below it."""
    ah, al, bh, bl = a >> U64(32), a & _HALF, b >> U64(32), b & _HALF
    # 2**64 is 8; 2**32 times x is x's low 29 bits moved up by 32, and the rest of x.
    middle = ah * bl + al * bh
    high = _reduced(ah * bh << U64(3)) + ((middle & _LOW) << U64(32)) + (middle >> U64(29))
    low = al * bl
    return _reduced(_reduced(high) + (low & _P) + (low >> U64(61)))


def running(x: np.ndarray) -> np.ndarray:
    """0 and the running sums of x modulo the prime."""
    out = np.zeros(len(x) + 1, U64)
    np.cumsum(x >> U64(32), out=out[1:])
    low = np.cumsum(x & _HALF)
    out[1:] = _reduced(((out[1:] & _LOW) << U64(32)) + (out[1:] >> U64(29)) + _reduced(low))
    return out


class Rolling:
    """Rabin-Karp hashes of runs of hashes. Powers of the base are kept for up to `kept` places; sums start anew beyond."""

    def __init__(self, base: int, kept: int = 1 << 19):
        self.base, self.inverse, self.kept = base % PRIME, pow(base, -1, PRIME), kept
        self.up, self.down = np.ones(1, U64), np.ones(1, U64)

    def _grow(self, n: int) -> None:
        for name, base in (("up", self.base), ("down", self.inverse)):
            have = getattr(self, name)
            while len(have) < n:
                have = np.concatenate([have, times(have, np.full(len(have), pow(base, len(have), PRIME), U64))])
            setattr(self, name, have)

    def hashes(self, h: np.ndarray, size: int) -> np.ndarray:
        """For each place with `size` hashes from there on, their polynomial; spread over 64 bits."""
        n = len(h) - size + 1
        if n <= 0:
            return np.zeros(0, U64)
        out, step = np.empty(n, U64), max(self.kept - size, size)
        for lo in range(0, n, step):
            part = _reduced(h[lo : lo + step + size - 1])
            self._grow(len(part))
            sums, m = running(times(part, self.up[: len(part)])), len(part) - size + 1
            out[lo : lo + m] = times(_reduced(sums[size : size + m] + (_P - sums[:m])), self.down[:m])
        return mix(out + U64(size))


# ------------------------------------------------------------------------------ texts and words


def text_groups(batches: Iterable[pa.RecordBatch], text: str, limit: int = GROUP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches with texts of limited length together (or one text): slice, bytes, and where each text begins and the last ends."""
    for batch in batches:
        column = batch.column(text)
        column = pa.compute.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        if not len(column):
            continue
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(column):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
            hi = min(hi, len(column))
            yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            lo = hi


class Bytes:
    """Bytes that are read eight at a time from any place."""

    def __init__(self, data: np.ndarray):
        padded = np.zeros((len(data) // 8 + 2) * 8, np.uint8)
        padded[: len(data)] = data
        self.data, self.words = padded, padded.view("<u8")

    def eight(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The n bytes (1 to 8) from each place, as a number."""
        word, shift = at >> 3, (at & 7).astype(U64) << U64(3)
        got = self.words[word] >> shift
        got |= (self.words[word + 1] << U64(1)) << (U64(63) - shift)
        return got & (~U64(0) >> (U64(64) - (n.astype(U64) << U64(3))))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each word."""
    size = end - start
    h = (size.astype(U64) * _STEP) ^ _SEED
    held = Bytes(data)
    rest, at = np.flatnonzero(size <= SHORT), 0
    while len(rest):
        h[rest] = mix(h[rest] ^ held.eight(start[rest] + at, np.minimum(size[rest] - at, 8)))
        at += 8
        rest = rest[size[rest] > at]
    long_ = np.flatnonzero(size > SHORT)
    if len(long_):
        raw = memoryview(np.ascontiguousarray(data))
        h[long_] = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b], 20240229) for a, b in zip(start[long_].tolist(), end[long_].tolist())), U64, len(long_))
    return h


def pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about GROUP_BYTES that end behind white space, or with the bytes."""
    lo = 0
    while lo < len(data):
        hi = lo + GROUP_BYTES
        while hi < len(data):
            white = np.flatnonzero(~IS_WORD[data[hi - 1 : hi + GROUP_BYTES]])
            if len(white):
                hi += int(white[0])
                break
            hi += GROUP_BYTES
        hi = min(hi, len(data))
        yield lo, hi
        lo = hi


class Words:
    """The words of a group of texts: where they start and end in its bytes, how many each text has, and their hashes."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool = False, marks: bool = False):
        """lower: A-Z hash as a-z. marks: a full stop or comma behind a letter or digit is a word of its own."""
        cuts = bounds[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        self.data = LOWER[data] if lower else data
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64))]
        for lo, hi in pieces(data):
            own = data[lo:hi]
            start, end = _runs(own, cuts[np.searchsorted(cuts, lo, "right") : np.searchsorted(cuts, hi)] - lo)
            if marks and len(start):
                start, end = _part_marks(own, start, end)
            found.append((start + lo, end + lo, _hashes(self.data[lo:hi], start, end)))
        self.start, self.end, self.hash = (x[-1] if len(x) == 2 else np.concatenate(x) for x in zip(*found))
        self.bounds = np.searchsorted(self.start, bounds)
        self.counts = np.diff(self.bounds)

    def texts(self) -> np.ndarray:
        """The number of the text that each word is in."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def _runs(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of word bytes start and end, if a run also ends at each cut."""
    inside = IS_WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def _part_marks(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits: ASCII ones, and those of U+00C0 to U+00FF."""
    last = np.where(end - start >= 2, end - 1, 0)
    before, two_before = data[last - 1], data[last - 2]
    latin = (two_before == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7) & (last - start >= 2)
    apart = last[(last > 0) & ((data[last] == 46) | (data[last] == 44)) & (IS_ALNUM[before] | latin)]
    return np.insert(start, np.searchsorted(start, apart), apart), np.insert(end, np.searchsorted(end, apart), apart)


# ------------------------------------------------------------------------------ what has been met


class Memo:
    """An open-addressed table from hashes to numbers."""

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.key, self.slot_of = np.zeros(1 << bits, U64), np.zeros(1 << bits, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where it isn't known. Hash 0 counts as 1."""
        h = np.maximum(h, U64(1))
        at = (h >> U64(64 - self.bits)).astype(np.int64)
        got = self.key[at]
        out = np.where(got == h, self.slot_of[at], -1)
        open_ = np.flatnonzero((got != h) & (got != 0))
        mask = (1 << self.bits) - 1
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            got = self.key[at[open_]]
            hit = got == h[open_]
            out[open_[hit]] = self.slot_of[at[open_[hit]]]
            open_ = open_[~hit & (got != 0)]
        return out

    def add(self, h: np.ndarray, numbers: np.ndarray | None = None) -> None:
        """Learns distinct unknown hashes; without numbers, they are numbered in the order of learning."""
        h = np.maximum(h, U64(1))
        numbers = np.arange(self.n, self.n + len(h)) if numbers is None else numbers
        while (self.n + len(h)) * 2 > 1 << self.bits:
            old, of = self.key[self.key != 0], self.slot_of[self.key != 0]
            self.bits += 1
            self.key, self.slot_of = np.zeros(1 << self.bits, U64), np.zeros(1 << self.bits, np.int32)
            self._place(old, of)
        self._place(h, numbers.astype(np.int32))
        self.n += len(h)

    def _place(self, h: np.ndarray, numbers: np.ndarray) -> None:
        at = (h >> U64(64 - self.bits)).astype(np.int64)
        mask = (1 << self.bits) - 1
        while len(h):
            free = np.flatnonzero(self.key[at] == 0)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.key[at[won]], self.slot_of[at[won]] = h[won], numbers[won]
            left = np.ones(len(h), bool)
            left[won] = False
            h, numbers, at = h[left], numbers[left], (at[left] + 1) & mask


def grown(a: np.ndarray, n: int) -> np.ndarray:
    """a with room for n elements."""
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


class Lexicon:
    """Numbers 0, 1, 2, ... for distinct words, each with a tag. Hashes find them, bytes and tag confirm them: a number is
    never wrong, whatever hashes coincide."""

    def __init__(self):
        self.memo, self.n, self.used = Memo(), 0, 0
        self.kept, self.place, self.mark = np.zeros(1 << 16, np.uint8), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.twins: dict[tuple[bytes, int], int] = {}

    @property
    def size(self) -> int:
        """Bytes kept of words."""
        return self.used

    def numbers(self, w: Words, which: np.ndarray, tag: np.ndarray, learn: Callable[[np.ndarray], None]) -> np.ndarray:
        """The number of each of the words `which`. learn(places) is told, in the order of numbers, of words not met before.

        tag: a number from 0 to 255 for each of all words.
        """
        h = mix(w.hash[which] + tag[which].astype(U64))
        at = self.memo.find(h)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, first = np.unique(h[missing], return_index=True)
            first = which[missing[first]]
            self.memo.add(new, self._store(w, first, tag))
            learn(first)
            at[missing] = self.memo.find(h[missing])
        for i in np.flatnonzero(self._differs(w, which, tag, at)).tolist():
            place = which[i : i + 1]
            key = (w.data[w.start[place[0]] : w.end[place[0]]].tobytes(), int(tag[place[0]]))
            if key not in self.twins:
                self.twins[key] = int(self._store(w, place, tag)[0])
                learn(place)
            at[i] = self.twins[key]
        return at

    def _store(self, w: Words, places: np.ndarray, tag: np.ndarray) -> np.ndarray:
        size = w.end[places] - w.start[places]
        ends = self.used + np.cumsum(size)
        own = np.arange(self.n, self.n + len(places))
        self.n += len(places)
        # Room for eight bytes more, as they are read eight at a time.
        self.kept = grown(self.kept, (int(ends[-1]) // 8 + 2) * 8)
        self.kept = self.kept[: len(self.kept) // 8 * 8]
        self.place, self.mark = grown(self.place, self.n), grown(self.mark, self.n)
        self.place[own], self.mark[own] = ends - size, size << 8 | tag[places]
        for lo, hi, a, b in zip(w.start[places].tolist(), w.end[places].tolist(), (ends - size).tolist(), ends.tolist()):
            self.kept[a:b] = w.data[lo:hi]
        self.used = int(ends[-1])
        return own

    def _differs(self, w: Words, which: np.ndarray, tag: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which of the words aren't those that the numbers stand for."""
        start, size = w.start[which], w.end[which] - w.start[which]
        out = self.mark[at] != (size << 8 | tag[which])
        ours, theirs = Bytes.__new__(Bytes), Bytes(w.data)
        ours.words = self.kept.view("<u8")
        place, rest, step = self.place[at], np.flatnonzero(~out & (size <= SHORT)), 0
        while len(rest):
            n = np.minimum(size[rest] - step, 8)
            out[rest] = ours.eight(place[rest] + step, n) != theirs.eight(start[rest] + step, n)
            step += 8
            rest = rest[~out[rest] & (size[rest] > step)]
        for i in np.flatnonzero(~out & (size > SHORT)).tolist():
            out[i] = not np.array_equal(self.kept[place[i] : place[i] + size[i]], w.data[start[i] : start[i] + size[i]])
        return out
