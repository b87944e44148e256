"""Ids of whole texts by the tokenizers library, asked once for each distinct word.

The word vocabulary's normaliser and splitter never look across white space, and part a full stop or comma from a letter
or digit before it, so a text's ids are the ids of such words in a row. The vocabulary has lower case only, so words that
differ in the case of A-Z are one, unless a special string may be near. Words are found by hash and confirmed by their
bytes; the library encodes those not seen before, and the ids of all texts are then gathered by numpy. Memory is
bounded: words are remembered up to a limit of number and bytes and then forgotten all at once, and texts are taken in
groups of limited length, a very long one in pieces that end at white space.
"""

from __future__ import annotations

import os

import numpy as np

from marlstone.llm.wordhash import GROUP_BYTES, Lexicon, Words, grown, pieces

REMEMBERED, REMEMBERED_BYTES = 500_000, 32_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else the next free one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordEncoder:
    """For vocabularies of this kind: normal form C, white space dropped, lower case, byte-level pairs."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.remembered = Tokenizer.from_file(path), remembered
        self.shown = dict(enumerate(byte_symbols()))
        self.forget()

    def forget(self) -> None:
        self.lexicon = Lexicon()
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.ids, self.n_ids = np.zeros(1 << 18, np.uint32), 0

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words in a row, and how many each has.

        A word of letters below U+0100 is in normal form and is one pre-token, so the library's model can be asked at
        once, with its letters in lower case and its bytes as the vocabulary writes them. Others go all the way.
        """
        coded: list[list[int] | None] = []
        others: list[str] = []
        ask = self.library.model.tokenize
        for w in words:
            if w.isalpha() and (w.isascii() or max(w) < "\u0100"):
                w = w.lower()
                coded.append([t.id for t in ask(w if w.isascii() else w.encode().decode("latin-1").translate(self.shown))])
            else:
                coded.append(None)
                others.append(w)
        if others:
            e = self.library.encode(others, is_pretokenized=True, add_special_tokens=False)
            cuts = np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(others) + 1)).tolist()
            ids, rest = e.ids, iter(zip(cuts, cuts[1:]))
            coded = [c if c is not None else ids[slice(*next(rest))] for c in coded]
        length = np.fromiter(map(len, coded), np.int64, len(coded))
        return np.fromiter((i for c in coded for i in c), np.uint32, int(length.sum())), length

    def learn(self, words: list[str]) -> None:
        """Keeps the ids of words that the lexicon has just numbered."""
        ids, length = self.ids_of(words)
        m = self.lexicon.n
        self.start, self.length, self.ids = grown(self.start, m), grown(self.length, m), grown(self.ids, self.n_ids + len(ids) + 1)
        own = slice(m - len(words), m)
        self.start[own], self.length[own] = self.n_ids + np.cumsum(length) - length, length
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.n_ids += len(ids)

    def encode(self, data: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, end_id after each, and how many each text has, that one included."""
        if len(bounds) == 2 and len(data) > 2 * GROUP_BYTES:
            cuts = list(pieces(data))
            parts = [self.encode(data[lo:hi], np.array([0, hi - lo]), end_id)[0][: None if hi == len(data) else -1] for lo, hi in cuts] if len(cuts) > 1 else []
            if parts:
                ids = np.concatenate(parts)
                return ids, np.array([len(ids)])
        if self.lexicon.n > self.remembered or self.lexicon.size > REMEMBERED_BYTES:
            self.forget()
        raw = data.tobytes()
        special = b"<|" in raw
        w = Words(data, bounds, lower=not special, marks=not special)
        # A text with a special string is not split at marks: its words are not those of other texts.
        tag = np.full(len(w.hash), int(special), np.int64)
        learn = lambda new: self.learn([raw[a:b].decode("utf-8", "replace") for a, b in zip(w.start[new].tolist(), w.end[new].tolist())])
        at = self.lexicon.numbers(w, np.arange(len(w.hash)), tag, learn)
        # One more word behind each text: the end id, kept behind all ids.
        last = w.bounds[1:]
        length = np.insert(self.length[at].astype(np.int64), last, 1)
        start = np.insert(self.start[at], last, self.n_ids)
        self.ids = grown(self.ids, self.n_ids + 1)
        self.ids[self.n_ids] = end_id
        sums = np.concatenate([[0], np.cumsum(length)])
        ids = self.ids[np.repeat(start - sums[:-1], length) + np.arange(sums[-1])]
        edges = np.concatenate([[0], last + np.arange(1, len(last) + 1)])
        return ids, np.diff(sums[edges])


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary; later tasks of the worker find its words known."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
