"""Hashed n-gram features of texts, worked out in numpy inside Arrow functions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import xxhash

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Characters taken at a time.
_AT_ONCE = 1 << 20


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def mixed(keys: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` well-mixed bits of 64-bit keys."""
    keys = keys * _MIX
    return ((keys ^ (keys >> np.uint64(29))) * _MIX >> np.uint64(64 - bits)).astype(np.int64)


def gram_keys(values: np.ndarray, order: int) -> np.ndarray:
    """A 64-bit key of every run of ``order`` values."""
    n = len(values) - order + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    key = values[:n] + np.uint64(order)
    for i in range(1, order):
        key = key * _MIX
        key ^= key >> np.uint64(31)
        key += values[i:i + n]
    return key


class WordKeys:
    """64-bit keys of words; those of words met before are remembered, up to a number of them."""

    def __init__(self, remembered: int = 500_000):
        self.known: dict[str, int] = {}
        self.remembered = remembered

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.remembered:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def count_grams(texts: Sequence[str], orders: Sequence[int], bits: int) -> np.ndarray:
    """Counts of hashed character n-grams, one row per text; long texts go through in overlapping parts."""
    out = np.zeros((len(texts), 1 << bits), np.float32)
    most = max(orders)

    def add(rows: list[int], parts: list[np.ndarray]) -> None:
        """Parts of several texts at once; a gram that would cross from one part to the next is left out by its row."""
        values = np.concatenate(parts)
        owner = np.repeat(np.arange(len(rows)), [len(p) for p in parts])
        found = np.zeros(len(rows) << bits, np.float32)
        for order in orders:
            n = len(values) - order + 1
            if n <= 0:
                continue
            inside = owner[:n] == owner[order - 1:]
            cell = (owner[:n] << bits) + mixed(gram_keys(values, order), bits)
            found += np.bincount(cell[inside], minlength=len(found)).astype(np.float32)
        for at, row in enumerate(rows):
            out[row] += found[at << bits:(at + 1) << bits]

    rows, parts, held = [], [], 0
    for row, text in enumerate(texts):
        for begin in range(0, len(text), _AT_ONCE):
            # a later part begins early enough for the grams that cross; those wholly in the overlap are taken off again
            part = codes(text[max(0, begin - most + 1):begin + _AT_ONCE])
            rows.append(row)
            parts.append(part)
            held += len(part)
            if begin:
                for order in orders:
                    extra = mixed(gram_keys(part[:most - 1], order), bits)
                    np.subtract.at(out[row], extra, 1)
            if held >= _AT_ONCE >> 3 or len(rows) >= 64:
                add(rows, parts)
                rows, parts, held = [], [], 0
    if rows:
        add(rows, parts)
    return out


def groups_of(items: Sequence, size: int) -> Iterator[Sequence]:
    for at in range(0, len(items), size):
        yield items[at:at + size]
