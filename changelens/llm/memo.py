"""Exact reuse of a tokenizer's results for words that repeat.

Words are places in a buffer of bytes.  Those of up to 16 bytes are known by their bytes as two 64-bit numbers and found by a sorted hash of the
two; the numbers themselves are compared too, so a collision of the hash costs a repeated encoding and never a wrong result.  Longer words are
encoded each time.  Only words not yet known become Python objects and reach the tokenizer.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Words kept at most by one Python worker.  When full, the memory starts afresh: results stay the same.
ENTRIES = 300_000
#: Bytes of text handled together.
TOGETHER = 2 << 20
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Memo:
    """`encode` maps a list of distinct words (bytes) to their ids one after another and the number of each, as arrays."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], dtype: str):
        self.encode, self.dtype = encode, np.dtype(dtype)
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros((3, 0), np.uint64)  # hash in ascending order, low, high
        self.begins = self.sizes = np.zeros(0, np.int64)
        self.flat = np.zeros(0, self.dtype)

    def ids(self, buffer: bytes, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and how many each word has."""
        if not len(starts):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        raw = np.frombuffer(buffer + bytes(24), np.uint8)
        eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        low = eight[starts] & _MASKS[np.minimum(lengths, 8)]
        high = eight[np.minimum(starts + 8, len(buffer))] & _MASKS[np.clip(lengths - 8, 0, 8)]
        # a word never holds a zero byte at its end unless the text does; the length tells such words apart
        mixed = (low * np.uint64(0x9E3779B97F4A7C15)) ^ ((high ^ (high >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (low >> np.uint64(29))
        mixed ^= lengths.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
        hashes, first, group = np.unique(mixed, return_index=True, return_inverse=True)
        same = (low == low[first][group]) & (high == high[first][group]) & (lengths == lengths[first][group]) & (lengths <= 16)
        alone = np.flatnonzero(~same)

        if self.keys.shape[1] + len(hashes) > ENTRIES:
            self._forget()
        low, high = low[first], high[first]
        at = np.searchsorted(self.keys[0], hashes)
        taken = np.zeros(len(hashes), bool)
        inside = at < self.keys.shape[1]
        taken[inside] = self.keys[0][at[inside]] == hashes[inside]
        hit = taken.copy()
        hit[taken] = (self.keys[1][at[taken]] == low[taken]) & (self.keys[2][at[taken]] == high[taken])
        new = np.flatnonzero(~hit)
        # words that stand alone repeat too: each distinct one is encoded once for this buffer
        texts = [buffer[a:b] for a, b in zip(starts[first[new]].tolist(), (starts + lengths)[first[new]].tolist(), strict=True)]
        others = [buffer[a:b] for a, b in zip(starts[alone].tolist(), (starts + lengths)[alone].tolist(), strict=True)]
        place = {w: len(new) + i for i, w in enumerate(dict.fromkeys(others))}
        got, counts = self.encode([*texts, *place]) if texts or place else (np.zeros(0, self.dtype), np.zeros(0, np.int64))

        # everything known, then everything just encoded
        flat = np.concatenate([self.flat, got.astype(self.dtype)])
        fresh = len(self.flat) + np.cumsum(counts) - counts
        begins, sizes = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64)
        begins[hit], sizes[hit] = self.begins[at[hit]], self.sizes[at[hit]]
        begins[new], sizes[new] = fresh[: len(new)], counts[: len(new)]
        begin, size = begins[group], sizes[group]
        if others:
            where = np.array([place[w] for w in others])
            begin[alone], size[alone] = fresh[where], counts[where]
        ends = np.cumsum(size)
        out = flat[np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)]

        keep = np.flatnonzero(~taken & (lengths[first] <= 16))
        if len(keep):
            keys = np.concatenate([self.keys, np.stack([hashes[keep], low[keep], high[keep]])], axis=1)
            order = np.argsort(keys[0], kind="stable")
            self.keys = keys[:, order]
            self.begins, self.sizes = np.append(self.begins, begins[keep])[order], np.append(self.sizes, sizes[keep])[order]
            self.flat = flat[: len(self.flat) + int(counts[: len(new)].sum())]
        return out, size


def runs(texts: list[bytes]) -> list[slice]:
    """Slices of `texts` of about TOGETHER bytes each, of one text at least."""
    out, first, size = [], 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > TOGETHER:
            out.append(slice(first, i))
            first, size = i, 0
        size += len(t)
    return [*out, slice(first, len(texts))] if texts else []
