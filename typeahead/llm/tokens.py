"""Exact tokenisation of whole texts through a bounded cache of text units.

A text is cut where the tokenizers' own patterns always cut, so that the ids of
a text are the ids of its units in order. Only units not met lately go to the
tokenizer; the rest is array work. The cache is emptied when full, so memory
does not grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import regex

from .textvec import first_of, span_hash, spread, words

#: White space of the tokenizers' ``\s`` (fixed values).
SPACE = r"\t-\r \x85\xa0  -     　"
#: The published split pattern with that class written out.
PRETOKEN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)


def wide_space(data: np.ndarray) -> np.ndarray:
    """Places where white space beyond ASCII begins."""
    n = len(data)
    at = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    if not len(at):
        return at
    pad = np.concatenate([data, np.zeros(2, np.uint8)])
    a, b, c = pad[at], pad[at + 1], pad[at + 2]
    hit = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    hit |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
    return at[hit & (at < n)]


#: 1: ASCII letters, 2: other visible ASCII but digits and the apostrophe. Both patterns always cut between the two.
KIND = np.zeros(256, np.uint8)
KIND[33:127] = 2
KIND[48:58] = KIND[39] = 0
KIND[65:91] = KIND[97:123] = 1


def cut_marks(data: np.ndarray, s: np.ndarray, e: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut units where ASCII letters and punctuation meet, so that fewer different units remain."""
    if len(data) > 1:
        k = KIND[data]
        at = np.flatnonzero((k[1:] ^ k[:-1] == 3) & (k[1:] != 0) & (k[:-1] != 0)) + 1
        at = at[~np.isin(at, off)]
        at = at[np.searchsorted(s, at, "right") > np.searchsorted(e, at, "right")]
        s, e = np.sort(np.concatenate([s, at])), np.sort(np.concatenate([e, at]))
    return s, e, np.searchsorted(s, off)


def plain_units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units for tokenizers that drop white space: words, cut at punctuation."""
    s, e, _ = words(data, off)
    return cut_marks(data, s, e, off)


def spaced_units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units for the byte-level pattern: words with the one space before them, and the rest of the white space.

    Of a run of white space the pattern leaves the last character to what follows.
    Texts with white space beyond ASCII are cut by the pattern itself.
    """
    s, e, woff = words(data, off)
    lead = np.zeros(len(s), bool)
    if len(s):
        first = np.zeros(len(data) + 1, bool)
        first[off] = True
        lead = ~first[s] & (data[s - 1] == 32)
    s = s - lead
    gap_s = np.sort(np.concatenate([off[:-1], e]))
    ends = np.concatenate([off[1:], s])
    free = np.concatenate([np.zeros(len(off) - 1, bool), ~lead])  # the last character is a unit of its own
    order = np.argsort(ends, kind="stable")
    gap_e, free = ends[order], free[order]
    split = free & (gap_e - gap_s >= 2)
    head_e = gap_e - split
    keep = head_e > gap_s
    us = np.concatenate([s, gap_s[keep], gap_e[split] - 1])
    ue = np.concatenate([e, head_e[keep], gap_e[split]])
    order = np.argsort(us, kind="stable")
    us, ue = us[order], ue[order]
    odd = np.unique(np.searchsorted(off, wide_space(data), "right") - 1)
    if len(odd):
        keep = ~np.isin(np.searchsorted(off, us, "right") - 1, odd)
        more_s, more_e = [us[keep]], [ue[keep]]
        for d in odd.tolist():
            lens = [len(x.encode()) for x in PRETOKEN.findall(data[off[d] : off[d + 1]].tobytes().decode())]
            to = off[d] + np.cumsum(np.array(lens, np.int64))
            more_s.append(to - lens)
            more_e.append(to)
        us, ue = np.concatenate(more_s), np.concatenate(more_e)
        order = np.argsort(us, kind="stable")
        us, ue = us[order], ue[order]
    return cut_marks(data, us, ue, off)


#: Text units that a worker remembers, at most; those of one chunk come on top.
UNITS = 400_000


def _grown(x: np.ndarray, n: int) -> np.ndarray:
    while len(x) < n:
        x = np.concatenate([x, np.zeros_like(x)])
    return x


class _Runs:
    """Runs of items of one type, each found by its number."""

    def __init__(self, kind):
        self.flat = np.zeros(1 << 16, kind)
        self.ends = np.zeros(1 << 14, np.int64)
        self.n = 0

    def get(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All items of the runs in order, and their lengths."""
        lens = self.ends[which + 1] - self.ends[which]
        return self.flat[spread(self.ends[which], lens)], lens

    def add(self, items: np.ndarray, lens: np.ndarray) -> None:
        at, to = int(self.ends[self.n]), self.n + len(lens)
        self.flat, self.ends = _grown(self.flat, at + len(items)), _grown(self.ends, to + 1)
        self.flat[at : at + len(items)] = items
        self.ends[self.n + 1 : to + 1] = at + np.cumsum(lens)
        self.n = to


class CachedEncoder:
    """``encode_units``: list of unit strings -> (flat ids, ids per unit).

    Units met before are found in an open-addressing table by their hash and
    confirmed by their bytes, a whole chunk at a time.
    """

    def __init__(self, units: Callable, encode_units: Callable, limit: int = UNITS):
        self.units, self.encode_units, self.limit = units, encode_units, limit
        self._reset()

    def _reset(self) -> None:
        self.hash = np.zeros(1 << 14, np.uint64)
        self.uses = np.zeros(1 << 14, np.int32)
        self.ids, self.bytes = _Runs(np.uint32), _Runs(np.uint8)
        self.table = np.zeros(1 << 16, np.int32)  # number of a unit + 1

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each unit, or -1."""
        mask, out = len(self.table) - 1, np.full(len(hashes), -1, np.int64)
        left, at = np.arange(len(hashes)), (hashes & np.uint64(mask)).astype(np.int64)
        while len(left):
            found = self.table[at].astype(np.int64) - 1
            hit = (found >= 0) & (self.hash[found] == hashes[left])
            out[left[hit]] = found[hit]
            go = (found >= 0) & ~hit
            left, at = left[go], at[go] + 1 & mask
        return out

    def _place(self, begin: int) -> None:
        """Enter the units from ``begin`` on; all of them where the table has to grow."""
        if 2 * self.ids.n > len(self.table):
            self.table, begin = np.zeros(1 << (4 * self.ids.n).bit_length(), np.int32), 0
        mask, number = len(self.table) - 1, np.arange(begin, self.ids.n)
        at = (self.hash[number] & np.uint64(mask)).astype(np.int64)
        while len(number):
            free = self.table[at] == 0
            self.table[at[free]] = number[free] + 1
            go = self.table[at] != number + 1
            number, at = number[go], at[go] + 1 & mask

    def _evict(self) -> None:
        """Keep the half of the units that most chunks used, their counts halved."""
        keep = np.sort(np.argsort(-self.uses[: self.ids.n], kind="stable")[: self.limit // 2])
        hashes, uses, ids, raw = self.hash[keep], self.uses[keep] // 2, self.ids.get(keep), self.bytes.get(keep)
        self._reset()
        self._store(hashes, ids, raw)
        self.uses[: len(keep)] = uses

    def _store(self, hashes: np.ndarray, ids: tuple[np.ndarray, np.ndarray], raw: tuple[np.ndarray, np.ndarray]) -> None:
        n, to = self.ids.n, self.ids.n + len(hashes)
        self.hash, self.uses = _grown(self.hash, to), _grown(self.uses, to)
        self.hash[n:to], self.uses[n:to] = hashes, 0
        self.ids.add(*ids)
        self.bytes.add(*raw)
        self._place(n)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk and the first id of each document (n + 1 long)."""
        s, e, uoff = self.units(data, off)
        if not len(s):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        if self.ids.n > self.limit:
            self._evict()
        codes, names = pd.factorize(span_hash(data, s, e))
        first = first_of(codes, len(names))
        begin, lens = s[first], e[first] - s[first]
        slots = self._find(names)
        known = np.flatnonzero(slots >= 0)
        if not self._same(data, begin[known], lens[known], slots[known]):  # two units of one hash
            self._reset()
            slots[:] = -1
        new = np.flatnonzero(slots < 0)
        if len(new):
            raw, texts = data[spread(begin[new], lens[new])], data.tobytes()
            got = self.encode_units([texts[a:b].decode() for a, b in zip(begin[new].tolist(), (begin + lens)[new].tolist())])
            slots[new] = self.ids.n + np.arange(len(new))
            self._store(names[new], got, (raw, lens[new]))
        self.uses[slots] += 1
        ids, lens = self.ids.get(slots[codes])
        return ids, np.concatenate([[0], np.cumsum(lens)])[uoff]

    def _same(self, data: np.ndarray, begin: np.ndarray, lens: np.ndarray, slots: np.ndarray) -> bool:
        raw, held = self.bytes.get(slots)
        return np.array_equal(held, lens) and np.array_equal(raw, data[spread(begin, lens)])


def library_encoder(path: str, units: Callable) -> CachedEncoder:
    """An encoder over a ``tokenizers`` file; special strings in a text are ordinary text."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True

    def encode_units(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, lens = [], []
        for k in range(0, len(texts), 4096):
            part = texts[k : k + 4096]
            got = tok.encode(part, is_pretokenized=True, add_special_tokens=False)
            flat.append(np.array(got.ids, np.uint32))
            lens.append(np.bincount(np.array(got.word_ids, np.int64), minlength=len(part)))
        return np.concatenate(flat), np.concatenate(lens)

    return CachedEncoder(units, encode_units)


_made: dict[tuple, CachedEncoder] = {}


def encoder(path: str, spaced: bool) -> CachedEncoder:
    """One encoder per worker process and file."""
    key = (path, spaced)
    if key not in _made:
        _made[key] = library_encoder(path, spaced_units if spaced else plain_units)
    return _made[key]


def tokenizer_path(name: str) -> str:
    """Default place of a public vocabulary file; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)
