"""Byte n-gram statistics compiled to dense tables, so that scoring is a few numpy gathers per byte.

A context is the run of the last `order` symbols; bytes map to symbols by a 256-entry table. `index` maps every
possible context to the number of the longest stored suffix; `values[number, symbol]` holds one float per class.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np

#: Bytes scored at a time; bounds the temporary arrays of a worker to about 40 times this.
BLOCK = 1 << 20
#: Bytes counted at a time.
COUNTED = 1 << 22


class Tables:
    """Frozen scores: values[context number * size + symbol, class]."""

    def __init__(self, symbols: np.ndarray, size: int, order: int, index: np.ndarray, values: np.ndarray):
        self.symbols, self.size, self.order, self.index, self.values = symbols, size, order, index, values

    def _gather(self, raw: bytes) -> np.ndarray:
        s = self.symbols[np.frombuffer(raw, np.uint8)].astype(np.int32)
        n = len(s) - self.order
        key = s[:n].copy()
        for k in range(1, self.order):
            key *= self.size
            key += s[k : k + n]
        at = self.index[key]
        at *= self.size
        at += s[self.order :]
        return self.values[at]

    def score(self, texts: Sequence[bytes]) -> np.ndarray:
        """One row of sums per text; every text is read whole, from a context of spaces."""
        out = np.zeros((len(texts), self.values.shape[1]))
        pad, group, held = b" " * self.order, [], 0

        def flush() -> None:
            nonlocal group, held
            if group:
                got = self._gather(pad + pad.join(texts[i] for i in group))
                starts = np.cumsum([0] + [len(texts[i]) + self.order for i in group[:-1]])
                ends = starts + [len(texts[i]) for i in group]
                cuts = np.stack([starts, np.minimum(ends, len(got))], 1).ravel()
                if cuts[-1] == len(got):
                    cuts = cuts[:-1]
                out[group] = np.add.reduceat(got, cuts, axis=0, dtype=np.float64)[::2]
            group, held = [], 0

        for i, text in enumerate(texts):
            if len(text) > BLOCK:
                for at in range(0, len(text), BLOCK):
                    before = (pad + text[max(0, at - self.order) : at])[-self.order :]
                    out[i] += self._gather(before + text[at : at + BLOCK]).sum(axis=0, dtype=np.float64)
            elif text:
                group.append(i)
                held += len(text)
                if held > BLOCK:
                    flush()
        flush()
        return out


def grams(texts: Iterable[bytes], symbols: np.ndarray, size: int, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(keys, counts) of the runs of 1 .. order+1 symbols; the last symbol of a key is the predicted one.

    Texts are parted by runs of spaces. They are counted a block at a time, so that memory is bounded by the number of
    distinct runs and not by the length of the texts."""
    pad, found = b" " * order, [[] for _ in range(order + 1)]
    before, held, waiting = np.zeros(0, np.int64), 0, [pad]

    def count() -> None:
        nonlocal before, held, waiting
        s = np.concatenate([before, symbols[np.frombuffer(b"".join(waiting), np.uint8)].astype(np.int64)])
        key = np.zeros(len(s), np.int64)
        for k in range(order + 1):
            key = key[: max(0, len(s) - k)] * size + s[k:]
            found[k].append(np.unique(key[max(0, len(before) - k) :], return_counts=True))  # those that end in this block
            if len(found[k]) > 8:
                found[k] = [_added(found[k])]
        before, held, waiting = s[len(s) - min(order, len(s)) :], 0, []

    for text in texts:
        for at in range(0, len(text), COUNTED):
            waiting.append(text[at : at + COUNTED])
            held += len(waiting[-1])
            if held >= COUNTED:
                count()
        waiting.append(pad)
    count()
    return [_added(x) for x in found]


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)


def within(rows: Iterable[tuple[object, bytes]], budget: int) -> dict[object, list[bytes]]:
    """The texts of each class in order, without those that would take the class beyond `budget` bytes."""
    out, used = {}, {}
    for label, text in rows:
        if used.get(label, 0) + len(text) <= budget:
            used[label] = used.get(label, 0) + len(text)
            out.setdefault(label, []).append(text)
    return out


def suffix_index(contexts: list[np.ndarray], size: int, order: int) -> tuple[np.ndarray, list[int]]:
    """contexts[k]: sorted keys of the stored contexts of length k. Numbers run through all lengths in order."""
    starts, total = [], 0
    for keys in contexts:
        starts.append(total)
        total += len(keys)
    index = np.zeros(1, np.int32)
    for k in range(1, order + 1):
        index = np.tile(index, size)  # without the oldest symbol
        index[contexts[k]] = starts[k] + np.arange(len(contexts[k]), dtype=np.int32)
    return index, starts
