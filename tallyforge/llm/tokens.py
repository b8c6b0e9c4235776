"""Token ids of whole texts at the speed of a table lookup.

A text is cut before each single blank or line end that stands between two characters that
are no white space, after such a line end, and between an ASCII letter and ASCII punctuation
other than an apostrophe. No token of the tokenizers used here spans such a place, so a text's ids
are those of its pieces in a row, and each distinct piece is encoded by the tokenizer once for
as long as a worker remembers it (about ``REMEMBERED`` pieces; the older half goes first). Texts with white space
outside ASCII (or the letter that stands for it), or with what may be a special token, aren't cut.

A piece of Latin letters only is one word to the tokenizer, so its model gets it straight; that
is done only if probes give the same ids as whole encoding does.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

from .words import chunks

REMEMBERED = 400_000
_WIDE_SPACE = re.compile("[\x00-\x08\x0e-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u2581\u3000\ufeff]|<\\|")
_WHITE = np.zeros(256, bool)
_WHITE[:33] = True
_CUT = np.zeros(256, bool)
_CUT[[0x20, 0x0A]] = True
_LETTER, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_PLAIN = re.compile("( ?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)").fullmatch
_PROBES = [" word", "Word", " ÜBER", " straße", "écoué", " Éa", " theandinghthe", "a", " Z", "Öa"]


def _byte_letters() -> dict[int, str]:
    """Byte-level tokenizers' letter for each byte: itself if it prints, else the next one from U+0100."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()


def _letters(word: str) -> str:
    if word.isascii():
        return _BYTE_LETTERS[32] + word[1:] if word[0] == " " else word
    return "".join([_BYTE_LETTERS[b] for b in word.encode()])
_OPEN: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """This process's encoder for a tokenizer file."""
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    return _OPEN[path]


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()
        whole = [self.tokenizer.encode(p, add_special_tokens=False).ids for p in _PROBES]
        self.plain = None
        for lower in (True, False):
            plain = lambda blank, word, lower=lower: _letters(word.lower() if lower else blank + word)
            if [[t.id for t in self.tokenizer.model.tokenize(plain(*_PLAIN(p).groups()[:2]))] for p in _PROBES] == whole:
                self.plain = plain
                break

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}
        self.tails: dict[str, list[int]] = {}
        self.ids, self.used, self.n = np.zeros(1 << 16, np.uint32), 0, 0
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _age(self) -> None:
        """Keeps what was used since the last time, and makes it the older half."""
        at = np.fromiter(self.known.values(), np.int64, len(self.known))
        length = self.length[at]
        total = np.cumsum(length)
        self.ids = self.ids[np.arange(total[-1] if len(at) else 0) + np.repeat(self.start[at] - (total - length), length)]
        self.start, self.length = total - length, length
        self.older, self.known = dict(zip(self.known, range(len(at)), strict=True)), {}
        self.used, self.n, self.tails = len(self.ids), len(at), {}

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _tail(self, text: str) -> list[int]:
        if text not in self.tails:
            self.tails[text] = self._whole(text)
        return self.tails[text]

    def _learn(self, pieces: list[bytes]) -> None:
        tokenize, plain, each = self.tokenizer.model.tokenize, self.plain, []
        for piece in pieces:
            text = piece.decode("utf-8", "replace")
            if plain and (m := _PLAIN(text)):
                blank, word, tail = m.groups()
                ids = [t.id for t in tokenize(plain(blank, word))]
                each.append(ids + self._tail(tail) if tail else ids)
            else:
                each.append(self._whole(text))
        self._store(pieces, each)

    def _store(self, pieces: list[bytes], each: list[list[int]]) -> None:
        counts = np.array([len(x) for x in each], np.int64)
        total = int(counts.sum())
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), total), np.uint32)])
        if self.n + len(pieces) > len(self.start):
            more = max(len(self.start), len(pieces))
            self.start, self.length = (np.concatenate([x, np.zeros(more, np.int64)]) for x in (self.start, self.length))
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(each), np.uint32, total)
        self.length[self.n : self.n + len(pieces)] = counts
        self.start[self.n : self.n + len(pieces)] = self.used + np.cumsum(counts) - counts
        self.known.update(zip(pieces, range(self.n, self.n + len(pieces)), strict=True))
        self.used, self.n = self.used + total, self.n + len(pieces)

    def _pieces(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces that begin at ``at`` (the last one is the end), and their counts."""
        n = len(at) - 1
        column = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        distinct = column.dictionary.to_pylist()
        if len(self.known) + len(distinct) > REMEMBERED // 2:
            self._age()
        known, older, new = self.known, self.older, []
        for p in distinct:
            if p not in known:
                if p in older:
                    known[p] = older[p]
                else:
                    new.append(p)
        if new:
            self._learn(new)
        which = np.fromiter((known[p] for p in distinct), np.int64, len(distinct))[column.indices.to_numpy()]
        length = self.length[which]
        total = np.cumsum(length)
        where = np.arange(total[-1] if n else 0) + np.repeat(self.start[which] - (total - length), length)
        return self.ids[where], length

    def encode(self, texts: list[str | None], size: int = 1 << 21):
        """For runs of texts: (first text, ids of all of them in a row, ids of each)."""
        for a, b, raw, offsets in chunks(texts, size):
            data = np.frombuffer(raw, np.uint8)
            cut = np.zeros(len(data) + 1, bool)
            solid = ~_WHITE[data]
            single = _CUT[data[1:-1]] & solid[:-2] & solid[2:]
            cut[1 : len(data) - 1] = single | (_STOP[data[1:-1]] & _LETTER[data[:-2]])
            cut[2 : len(data)] |= single & (data[1:-1] == 0x0A)
            # each text's own begin and end (the line end between texts is no part of any)
            for i in range(a, b):
                x, y = offsets[i - a], offsets[i - a + 1]
                if texts[i] and _WIDE_SPACE.search(texts[i]):
                    cut[x:y] = False
            cut[offsets] = True
            cut[offsets[1:] - 1] = True
            at = np.flatnonzero(cut)
            ids, length = self._pieces(data, at)
            # the pieces that are a line end between texts are left out
            skip = np.zeros(len(at) - 1, bool)
            skip[np.searchsorted(at, offsets[1:] - 1)] = True
            if length[skip].any():
                ids = ids[np.repeat(~skip, length)]
            total = np.concatenate([[0], np.cumsum(np.where(skip, 0, length))])
            yield a, ids, np.diff(total[np.searchsorted(at, offsets)])
