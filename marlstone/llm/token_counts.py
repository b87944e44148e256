"""Token counts by rank-synchronous array merging.

Distinct pre-tokens of a batch are held as one ragged numpy array of symbols. In every round each sequence finds its
lowest-ranked pair, all sequences merge theirs at once, and the arrays are compacted; a sequence without a pair that
merges has its final length. No merge is done a string at a time.

Counts of distinct pieces are remembered per worker up to a limit, so a text costs a lookup for each piece. Pieces are
found by hash and confirmed by their bytes.

Defined results: a null or empty text has 0 bytes and 0 tokens; the special string inside a text is one token, as the
library takes it; repeated rows are counted row by row; texts of any length are counted whole; extra columns are
passed on, and one whose name clashes with a result column gives way to it.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import fresh, shipped, text_of
from marlstone.llm.encoder import byte_symbols
from marlstone.llm.wordhash import GROUP_BYTES, IS_WORD, Lexicon, Words, grown, text_groups

REMEMBERED, REMEMBERED_BYTES = 700_000, 32_000_000
AT_ONCE = 200_000
MERGE_SYMBOLS = 1_000_000
# White space beyond the six ASCII characters, and separators that some libraries take for it.
ODD_WHITE = (0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
NO_RANK = np.int64(1) << 40


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Merger:
    """Lengths of byte strings after all merges of a byte-level vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: list):
        self.first = np.array([vocab[s] for s in byte_symbols()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left << 32 | right
        # A pair that is listed twice has its later rank, as in a mapping that is filled in order.
        order = np.lexsort((-np.arange(len(keys)), keys))
        keep = np.concatenate([[True], keys[order][1:] != keys[order][:-1]]) if len(keys) else np.zeros(0, bool)
        self.keys, self.rank = keys[order][keep], order[keep].astype(np.int64)
        self.made = made

    def ranks(self, sym: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The rank of each symbol with its right neighbour; none at the last symbol of a sequence."""
        key = np.empty(len(sym), np.int64)
        key[:-1] = sym[:-1] << 32 | sym[1:]
        key[-1:] = -1
        key[last] = -1
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NO_RANK)

    def lengths(self, strings: list[bytes]) -> np.ndarray:
        out = np.zeros(len(strings), np.int64)
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        ends = np.cumsum(size)
        cuts = np.searchsorted(ends, np.arange(MERGE_SYMBOLS, (ends[-1] if len(ends) else 0) + MERGE_SYMBOLS, MERGE_SYMBOLS), "right")
        lo = 0
        for hi in [*cuts.tolist(), len(strings)]:
            hi = max(hi, min(lo + 1, len(strings)))
            if hi > lo:
                out[lo:hi] = self._merge(strings[lo:hi], size[lo:hi])
                lo = hi
        return out

    def _merge(self, strings: list[bytes], size: np.ndarray) -> np.ndarray:
        out = size.copy()
        who = np.flatnonzero(size > 1)
        sym = self.first[np.frombuffer(b"".join(strings[i] for i in who), np.uint8)]
        n = size[who]
        while len(who) and len(self.keys):
            ends = np.cumsum(n)
            rank = self.ranks(sym, ends - 1)
            lowest = np.minimum.reduceat(rank, ends - n)
            live = lowest < NO_RANK
            if not live.all():
                out[who[~live]] = n[~live]
                stay = np.repeat(live, n)
                sym, rank, who, n, lowest = sym[stay], rank[stay], who[live], n[live], lowest[live]
                if not len(who):
                    break
            at = np.flatnonzero(rank == np.repeat(lowest, n))
            # Of pairs that overlap (the same symbol several times) every other one merges, from the left.
            fresh_run = np.concatenate([[True], np.diff(at) > 1])
            run_start = at[fresh_run][np.cumsum(fresh_run) - 1]
            at = at[(at - run_start) % 2 == 0]
            sym[at] = self.made[rank[at]]
            gone = np.zeros(len(sym), bool)
            gone[at + 1] = True
            n = n - np.add.reduceat(gone, np.cumsum(n) - n, dtype=np.int64)
            sym = sym[~gone]
            done = n < 2
            if done.any():
                out[who[done]] = n[done]
                sym, who, n = sym[np.repeat(~done, n)], who[~done], n[~done]
        return out


class TokenCounter:
    """Counts of whole texts.

    Where white space stands alone everywhere in a text (the usual case), its pre-tokens can be told word by word: a
    blank belongs to the word behind it, any other white space, and a blank at the end, is a token of its own. Such
    texts are counted from hashed words. Others, and texts with a special string or with white space beyond ASCII,
    are split whole by the vocabulary's pattern.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import public_tokenizers
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        self.merger = Merger(spec["model"]["vocab"], spec["model"]["merges"])
        pattern = regex.compile(public_tokenizers.PATTERN)
        self.pre_tokens, self.each = pattern.findall, pattern.finditer
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        # Special strings, and white space beyond the six characters, as UTF-8 bytes.
        self.odd = [x.encode() for x in special] + [chr(c).encode() for c in ODD_WHITE]
        self.leads = np.zeros(256, bool)
        self.leads[[x[0] for x in self.odd]] = True
        self.remembered = remembered
        self.forget()

    def forget(self) -> None:
        self.lexicon = Lexicon()
        self.tokens = np.zeros(1 << 16, np.int64)
        self.exact: dict[str, int] = {}

    def lengths(self, strings: list[str]) -> np.ndarray:
        """Tokens of each string, split by the pattern."""
        pre: list[bytes] = []
        counts = np.zeros(len(strings) + 1, np.int64)
        for i, s in enumerate(strings):
            own = self.pre_tokens(s)
            pre += [x.encode("utf-8", "surrogatepass") for x in own]
            counts[i + 1] = len(own)
        sums = np.concatenate([[0], np.cumsum(self.merger.lengths(pre))])
        return np.diff(sums[np.cumsum(counts)])

    def whole(self, text: str) -> int:
        """One text, split whole, a limited number of pre-tokens at a time; distinct ones are merged together."""
        parts = self.special.split(text) if self.special else [text]
        total = len(parts) - 1
        for p in parts:
            found = self.each(p)
            while own := [m.group() for m in islice(found, AT_ONCE)] if len(p) > AT_ONCE else self.pre_tokens(p):
                new = list(set(own).difference(self.exact))
                if len(self.exact) + len(new) > self.remembered:
                    self.exact, new = {}, list(set(own))
                self.exact.update(zip(new, self.merger.lengths([x.encode("utf-8", "surrogatepass") for x in new]).tolist()))
                total += sum(n * self.exact[x] for x, n in Counter(own).items())
                if len(p) <= AT_ONCE:
                    break
        return total

    def count(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if len(bounds) == 2 and len(data) > 2 * GROUP_BYTES:
            cuts = [0, *_lone_whites(data), len(data)]
            if len(cuts) > 2:
                return sum(self.count(data[a:b], np.array([0, b - a])) for a, b in zip(cuts, cuts[1:]))
        if self.lexicon.n + len(self.exact) > self.remembered or self.lexicon.size > REMEMBERED_BYTES:
            self.forget()
        raw = data.tobytes()
        w = Words(data, bounds)
        white = ~IS_WORD[data]
        # Texts that need the whole pattern.
        twice = white[1:] & white[:-1]
        twice_at = np.flatnonzero(twice)
        first = np.searchsorted(bounds, twice_at, "right") - 1
        odd = np.zeros(len(w.counts), bool)
        odd[first[twice_at + 1 < bounds[first + 1]]] = True
        for i in np.flatnonzero(self.leads[data]).tolist():
            if any(raw.startswith(x, i) for x in self.odd):
                odd[np.searchsorted(bounds, i, "right") - 1] = True

        of = w.texts()
        spaced = np.zeros(len(w.start), bool)
        inner = w.start > bounds[of]
        spaced[inner] = data[w.start[inner] - 1] == 32
        use = ~odd[of]

        def learn(new: np.ndarray) -> None:
            strings = [(" " if s else "") + raw[a:b].decode("utf-8", "surrogatepass") for a, b, s in zip(w.start[new].tolist(), w.end[new].tolist(), spaced[new].tolist())]
            self.tokens = grown(self.tokens, self.lexicon.n)
            self.tokens[self.lexicon.n - len(new) : self.lexicon.n] = self.lengths(strings)

        at = self.lexicon.numbers(w, np.flatnonzero(use), spaced.astype(np.int64), learn)
        of_use = of[use]
        out = np.bincount(of_use, self.tokens[at], len(odd)).astype(np.int64)
        # White space that no word takes.
        blanks = np.concatenate([[0], np.cumsum(white)])
        out += np.diff(blanks[bounds]) - np.bincount(of, spaced, len(odd)).astype(np.int64)
        for i in np.flatnonzero(odd).tolist():
            out[i] = self.whole(raw[bounds[i] : bounds[i + 1]].decode("utf-8", "surrogatepass"))
        return out


def _lone_whites(data: np.ndarray) -> Iterator[int]:
    """Places, about GROUP_BYTES apart, of white space alone between ASCII words: no pre-token reaches over its beginning."""
    plain = IS_WORD & (np.arange(256) < 128)
    at, end = GROUP_BYTES, len(data) - 1
    while at < end:
        own = data[at - 1 : at + GROUP_BYTES + 1]
        lone = np.flatnonzero(plain[own[:-2]] & ~IS_WORD[own[1:-1]] & plain[own[2:]])
        if len(lone):
            yield at + int(lone[0])
            at += int(lone[0])
        at += GROUP_BYTES


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, text: str = "text", path: str | None = None, limit: int = 1024) -> DataFrame:
    """docs without the text, with n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    path = path or default_path()
    results = ("n_bytes", "n_tokens", "over_limit")
    kept = [c for c in docs.columns if c != text and c.lower() not in results]
    body = fresh("body", kept)
    slim = docs.select(*kept, text_of(text).alias(body))
    given = slim.drop(body).schema
    out = given.add("n_bytes", "long").add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path)
        for batch, data, bounds in text_groups(batches, body):
            kept_columns = [batch.column(i) for i, f in enumerate(batch.schema) if f.name != body]
            yield pa.RecordBatch.from_arrays([*kept_columns, pa.array(np.diff(bounds)), pa.array(tokens.count(data, bounds))], [*kept, "n_bytes", "n_tokens"])

    return slim.mapInArrow(shipped(run), out).withColumn("over_limit", F.col("n_tokens") > limit)
