"""Words and word windows of whole Arrow batches in numpy, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Bytes of text handled at once inside a task; a longer text makes a block of its own.
BLOCK_BYTES = 2 << 20
#: Bytes, or hashes, that a step inside a block holds at once, so that a very long text needs a few times its own size.
SLICE = 2 << 20
_MASK = (1 << 64) - 1


def _random_u64(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, n, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


@dataclass
class Words:
    """Of a block of texts: start and end byte, text number and 64-bit hash of each word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    n_docs: int

    def hashes(self, seed: int) -> np.ndarray:
        """A polynomial over a random value for each byte, then mixed with the length; ``SLICE`` bytes of words at once."""
        table, base = _random_u64(seed, 256), int(_random_u64(seed + 1, 1)[0]) | 1
        length, out = self.end - self.start, np.zeros(len(self.start), np.uint64)
        if not len(out):
            return out
        power = powers(base, min(int(length.max()), SLICE))
        long = length > SLICE
        for i in np.flatnonzero(long):
            for lo in range(0, int(length[i]), SLICE):
                part = table[self.data[self.start[i] + lo : min(self.start[i] + lo + SLICE, self.end[i])]]
                out[i : i + 1] += (part * power[: len(part)]).sum(dtype=np.uint64, keepdims=True) * np.uint64(pow(base, lo, 1 << 64))
        short = np.flatnonzero(~long)
        total = np.cumsum(length[short])  # of the words that are left
        cuts = np.unique(np.searchsorted(total, np.arange(0, int(total[-1]), SLICE), side="right")) if len(total) else total
        for s, e in zip(cuts, np.append(cuts[1:], len(short))[: len(cuts)], strict=True):
            at = short[s:e]
            n = length[at]
            inside = np.concatenate([[0], np.cumsum(n)])
            place = np.arange(inside[-1], dtype=np.int64) - np.repeat(inside[:-1], n)
            out[at] = np.add.reduceat(table[self.data[np.repeat(self.start[at], n) + place]] * power[place], inside[:-1])
        for lo in range(0, len(out), SLICE):
            out[lo : lo + SLICE] = mix(out[lo : lo + SLICE] ^ (length[lo : lo + SLICE].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        return out


def words_in(texts: pa.Array) -> Words:
    """The words of a string array: runs of bytes other than space and 9 to 13. Null counts as empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if len(texts) == 0:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint8), z, z, z, 0)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    cut = offsets[:-1][(offsets[:-1] > 0) & (offsets[:-1] < len(data))]  # texts touch in the buffer, words don't
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, len(data), SLICE):
        hi = min(lo + SLICE, len(data))
        part = data[max(lo - 1, 0) : hi + 1]  # a byte more on either side, where there is one
        solid = ~((part == 32) | ((part >= 9) & (part <= 13)))
        here = solid[lo > 0 :][: hi - lo]
        first, last = here.copy(), here.copy()
        first[1:] &= ~here[:-1]
        last[:-1] &= ~here[1:]
        if lo > 0:
            first[0] &= ~solid[0]
        if hi < len(data):
            last[-1] &= ~solid[-1]
        begin, stop = (c[(c >= lo) & (c < hi)] - lo for c in (cut, cut - 1))
        first[begin], last[stop] = here[begin], here[stop]
        starts.append(np.flatnonzero(first) + lo)
        ends.append(np.flatnonzero(last) + lo + 1)
    start, end = np.concatenate(starts), np.concatenate(ends)
    return Words(data, start, end, np.searchsorted(offsets[1:], start, side="right"), len(texts))


def window_hashes(h: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Rabin-Karp: the polynomial hash of each window of ``width`` numbers, from one running sum.

    Window i is (Q[i + width] - Q[i]) / base**i modulo 2**64, Q the running sum of h[j] * base**j; an odd base can be
    divided by.
    """
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base, out = int(_random_u64(seed, 1)[0]) | 1, np.empty(n, np.uint64)
    up, down = powers(base, min(len(h), SLICE + width)), powers(pow(base, -1, 1 << 64), min(n, SLICE))
    for lo in range(0, n, SLICE):  # a window's hash doesn't hang on where its sum began
        part = h[lo : lo + SLICE + width - 1]
        q = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=q[1:])
        k = len(part) - width + 1
        out[lo : lo + k] = mix((q[width:] - q[:k]) * down[:k])
    return out


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds at most ``size`` bytes of ``column``, or one row."""
    for b in batches:
        col = b.column(b.schema.get_field_index(column))
        sizes = np.asarray(pa.compute.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        at, total = 0, 0
        for i, s in enumerate(sizes):
            if total and total + s > size:
                yield b.slice(at, i - at)
                at, total = i, 0
            total += int(s)
        if at < b.num_rows:
            yield b.slice(at)
