"""Words of many texts at once, in numpy over the bytes of an Arrow column.

A word is a run of ASCII letters and digits and bytes above 127; texts are
lower-cased first.  Every word gets a 64-bit hash from running sums of
``byte * BASE^position`` modulo 2^64, so no Python object is made per word.
Hashes only find candidates or compare runs of words; callers that must be
certain compare the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
BATCH_BYTES = 1 << 18
STRETCH = 1 << 20           # bytes whose words are hashed at once

_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", dtype=np.uint8)] = True
_IS_WORD[128:] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE^0 .. BASE^n`` and their inverses modulo 2^64, grown as needed."""
    have = _POWERS.get("up")
    if have is None or len(have) <= n:
        size = max(1 << 16, 1 << n.bit_length())
        inverse = pow(BASE, -1, 1 << 64)
        for name, base in (("up", BASE), ("down", inverse)):
            steps = np.full(size + 1, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit mixer, so that all bits depend on all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of a batch of texts, text after text."""
    data: np.ndarray       # the lower-cased bytes of all texts
    start: np.ndarray      # byte where each word begins
    end: np.ndarray
    hash: np.ndarray       # uint64
    text: np.ndarray       # which text the word is of
    first: np.ndarray      # per text, the index of its first word; one more at the end

    def of(self, i: int) -> list[str]:
        a, b = int(self.first[i]), int(self.first[i + 1])
        return [self.data[s:e].tobytes().decode() for s, e in zip(self.start[a:b], self.end[a:b])]


def words_of(texts: pa.Array) -> Words:
    """Words of a string array; null texts have none."""
    lowered = pc.utf8_lower(pc.fill_null(texts, ""))
    if isinstance(lowered, pa.ChunkedArray):
        lowered = lowered.combine_chunks()
    n = len(lowered)
    wide = pa.types.is_large_string(lowered.type)
    offsets = np.frombuffer(lowered.buffers()[1], dtype=np.int64 if wide else np.int32)[lowered.offset:lowered.offset + n + 1].astype(np.int64) if n else np.zeros(1, dtype=np.int64)
    raw = lowered.buffers()[2] if n else None
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0]:offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, dtype=np.uint8)
    offsets = offsets - offsets[0]
    inside = _IS_WORD[data]
    before, behind = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], behind[:-1] = inside[:-1], inside[1:]
    filled = offsets[1:] > offsets[:-1]
    before[offsets[:-1][filled]] = False           # a text's first byte follows nothing
    behind[offsets[1:][filled] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~behind) + 1
    h = np.zeros(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):                          # a stretch of words at a time: the running sums are eight times its bytes
        j = max(i + 1, int(np.searchsorted(end, start[i] + STRETCH, side="right")))
        s, e = start[i:j] - start[i], end[i:j] - start[i]
        up, down = _powers(int(e[-1]))
        sums = np.zeros(int(e[-1]) + 1, dtype=np.uint64)
        np.cumsum((data[start[i]:end[j - 1]].astype(np.uint64) + np.uint64(1)) * up[:len(sums) - 1], out=sums[1:])
        h[i:j] = (sums[e] - sums[s]) * down[s]
        i = j
    h = mix(h + (end - start).astype(np.uint64))
    text = np.searchsorted(offsets, start, side="right") - 1
    return Words(data, start, end, h, text, np.searchsorted(text, np.arange(n + 1)))


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` words in a row (the caller drops runs that leave a text)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = out * np.uint64(BASE) + h[i:i + n]
    return mix(out)


def parts(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about ``size`` bytes of ``column``, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
