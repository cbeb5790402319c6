"""Periodic runs of words in whole texts, found by probing a harmonic grid.

A run is a maximal stretch of words with smallest period p, at least ``COPIES`` periods and ``MIN_WORDS`` words long. For
each period p the places jp are probed: a run of three periods holds two probes side by side, word jp equal to word
(j+1)p and that to word (j+2)p, so n/p probes find all runs of period p, and n log n probes those of all periods.
Probes that hold in a pair are survivors. A survivor is extended either way by comparing the text with itself p words on,
in chunks that grow, and grid points inside a stretch that is known are skipped: a pair of probes inside a found run of
period q can only be that run again (p is then a multiple of q, by the theorem of Fine and Wilf).

Probes are vectorised along the grid for small periods and across the periods for large ones, so a text of n words takes
about 2 sqrt(n) array operations. Words are compared by 64-bit hashes; what a run claims is then compared byte by byte.

Defined results: a null text has no words; a null doc_id counts as the text 'null' where an id is hashed; rows with an equal
doc_id get their own results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenvec.llm.textscan import SLICE, Words, blocks, words_in

MIN_WORDS, COPIES = 24, 3
#: The first chunk of an extension, in words; each further one is twice as long.
CHUNK = 32
#: Survivors of a block of periods that are kept at once.
KEPT = 1 << 20


@dataclass(frozen=True, order=True)
class Run:
    start: int
    period: int
    length: int


def _extend(h: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The longest stretch [a, b) around ``at`` in which every word equals that ``period`` words on."""
    n, b, step = len(h) - period, at + 1, CHUNK
    while b < n:
        stop = min(b + step, n)
        bad = h[b:stop] != h[b + period : stop + period]
        if bad.any():
            b += int(bad.argmax())
            break
        b, step = stop, 2 * step
    a, step = at, CHUNK
    while a > 0:
        begin = max(a - step, 0)
        bad = h[begin:a] != h[begin + period : a + period]
        if bad.any():
            a -= int(bad[::-1].argmax())
            break
        a, step = begin, 2 * step
    return a, b


class _Found:
    """The runs so far, to tell grid points that lie inside one of them."""

    def __init__(self):
        self.runs: list[Run] = []
        self.spans: set[tuple[int, int]] = set()
        self._start = self._reach = np.zeros(0, np.int64)

    def add(self, run: Run) -> None:
        self.runs.append(run)
        self.spans.add((run.start, run.start + run.length))
        self._start = None

    def covers(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Whether words first to last (inclusive) all lie in one run."""
        if self._start is None:
            at = sorted(self.spans)
            self._start = np.array([s for s, _ in at], np.int64)
            self._reach = np.maximum.accumulate(np.array([e for _, e in at], np.int64))
        if not len(self._start):
            return np.zeros(len(first), bool)
        k = np.searchsorted(self._start, first, side="right") - 1
        return (k >= 0) & (self._reach[np.maximum(k, 0)] > last)


def _survivors(h: np.ndarray, low: int, high: int, found: _Found) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(period, grid place) of pairs of probes that hold, for periods low to high - 1 in ascending order.

    The stretch around such a pair holds all words between its probes, so two more of them are tested at once.
    """
    n = len(h)

    def sieved(period: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        same = h[at + 1] == h[at + 1 + period]
        period, at = period[same], at[same]
        place = at + (period >> 1)
        same = h[place] == h[place + period]
        period, at = period[same], at[same]
        fresh = ~found.covers(at, at + 2 * period)
        return period[fresh], at[fresh]

    if low * low <= n:  # along the grid
        for p in range(low, high):
            probe = h[: n - p : p] == h[p::p]
            at = np.flatnonzero(probe[:-1] & probe[1:]) * p
            if len(at):
                yield sieved(np.full(len(at), p, np.int64), at)
        return
    periods, places, kept = [], [], 0
    for j in range((n - 1) // low - 1):  # across the periods: word jp of all p is a slice with step j
        top = min(high, -(-n // (j + 2)))  # (j + 2) p < n
        if top <= low:
            break
        a, b, c = (h[k * low : k * (top - 1) + 1 : k] if k else np.broadcast_to(h[0], top - low) for k in (j, j + 1, j + 2))
        p = np.flatnonzero((a == b) & (b == c)) + low
        if len(p):
            p, at = sieved(p, j * p)
            periods.append(p)
            places.append(at)
            kept += len(p)
        if kept > KEPT and high - low > 1:  # too many to hold: half as many periods at once
            middle = (low + high) // 2
            yield from _survivors(h, low, middle, found)
            yield from _survivors(h, middle, high, found)
            return
    if kept:
        p, at = np.concatenate(periods), np.concatenate(places)
        order = np.lexsort((at, p))
        yield p[order], at[order]


def find_runs(h: np.ndarray, min_words: int = MIN_WORDS, copies: int = COPIES) -> list[Run]:
    """All runs in a sequence of word numbers or hashes, by start, then period. ``copies`` is 3 or more."""
    if copies < 3:
        raise ValueError("a run shorter than three periods can lie between the grid's pairs of probes")
    n, found, low = len(h), _Found(), 1
    if n < min_words:
        return []
    top = n // copies + 1
    while low < top:
        high = min(2 * low, top)
        for period, place in _survivors(h, low, high, found):
            known = (0, 0)  # the period and end of the last stretch
            inside = found.covers(place, place + 2 * period)
            for p, at, skip in zip(period.tolist(), place.tolist(), inside.tolist(), strict=True):
                if skip or (p == known[0] and at < known[1]):
                    continue
                a, b = _extend(h, at, p)
                known = (p, b)
                length = b + p - a
                if length >= max(min_words, copies * p) and (a, a + length) not in found.spans:
                    found.add(Run(a, p, length))
        low = high
    return sorted(found.runs)


def beyond_first(runs: list[Run], n: int) -> np.ndarray:
    """Which of n words lie in a run, after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for r in runs:
        edge[r.start + r.period] += 1
        edge[r.start + r.length] -= 1
    return np.cumsum(edge[:n]) > 0


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """For an id in ten, the word to put at each place so that the text's end repeats; else nothing."""
    h = zlib.crc32(("null" if doc_id is None else str(doc_id)).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    source = np.arange(n, dtype=np.int64)
    source[a:] = a + (source[a:] - a) % p
    return source


class _Text:
    """One text of a block: its words in the order in which they count."""

    def __init__(self, words: Words, at: np.ndarray):
        self.data, self.start, self.end = words.data, words.start[at], words.end[at]

    def pieces(self, at: np.ndarray) -> Iterator[bytes]:
        """The words of these places, each and a space after it, in slices; a very long word makes a slice of its own."""
        if not len(at):
            return
        size = self.end[at] - self.start[at] + 1
        total = np.cumsum(size)
        long = np.flatnonzero(size > SLICE)
        cuts = np.unique(np.concatenate([np.searchsorted(total, np.arange(0, int(total[-1]), SLICE), side="right"), long, np.minimum(long + 1, len(at) - 1)]))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(at)), strict=True):
            if hi - lo == 1:
                yield self.data[self.start[at[lo]] : self.end[at[lo]]].tobytes() + b" "
                continue
            n = size[lo:hi]
            inside = np.concatenate([[0], np.cumsum(n)])
            place = np.repeat(self.start[at[lo:hi]] - inside[:-1], n) + np.arange(inside[-1])
            out = self.data[np.minimum(place, len(self.data) - 1)]
            out[inside[1:] - 1] = 32
            yield out.tobytes()

    def joined_sha256(self, at: np.ndarray) -> str:
        h, held = hashlib.sha256(), b""
        for piece in self.pieces(at):
            h.update(held)
            held = piece
        h.update(held[:-1])
        return h.hexdigest()

    def same(self, run: Run) -> bool:
        """Whether the words of a run really repeat, byte by byte."""
        a = np.arange(run.start, run.start + run.length - run.period)
        return all((self.end[s] - self.start[s] == self.end[s + run.period] - self.start[s + run.period]).all() and all(x == y for x, y in zip(self.pieces(s), self.pieces(s + run.period), strict=True)) for s in np.array_split(a, max(1, len(a) >> 16)))

    def numbers(self) -> np.ndarray:
        """Words numbered by their bytes, without hashes."""
        seen: dict[bytes, int] = {}
        return np.fromiter((seen.setdefault(self.data[s:e].tobytes(), len(seen)) for s, e in zip(self.start.tolist(), self.end.tolist(), strict=True)), np.int64, len(self.start))


_RUNS = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("n_dropped", pa.int64()), ("collapsed_sha256", pa.string())]
)
_RUNS_SQL = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, n_dropped long, collapsed_sha256 string"


def _detect(min_words: int, copies: int, plant: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks([batch]):
                words = words_in(b.column("text"))
                hashes = words.hashes(13)
                first = np.searchsorted(words.doc, np.arange(words.n_docs + 1))
                out = []
                for i, doc in enumerate(b.column("doc_id").to_pylist()):
                    lo, n = int(first[i]), int(first[i + 1] - first[i])
                    source = planted(doc, n) if plant else None
                    at = lo + (np.arange(n, dtype=np.int64) if source is None else source)
                    text = _Text(words, at)
                    runs = find_runs(hashes[at], min_words, copies)
                    if not all(text.same(r) for r in runs):
                        runs = find_runs(text.numbers(), min_words, copies)
                    dropped = beyond_first(runs, n)
                    out.append({"doc_id": doc, "n_words": n, "runs": [{"start": r.start, "length": r.length, "period": r.period} for r in runs], "n_dropped": int(dropped.sum()), "collapsed_sha256": text.joined_sha256(np.flatnonzero(~dropped))})
                yield pa.RecordBatch.from_pylist(out, _RUNS)

    return run


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, copies: int = COPIES, plant: bool = False) -> DataFrame:
    """For each of ``docs`` (doc_id, text): n_words, its ``runs`` by start, then period, how many words go when each run is
    cut to its first period, and the digest of the words that are left, joined by a space.

    ``plant`` overwrites the ends of a tenth of the texts with a repeated passage first (``planted``), to measure recall.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_detect(min_words, copies, plant), _RUNS_SQL)


def runs_table(docs: DataFrame) -> DataFrame:
    """A row a text with planted passages: n_runs, the run with most copies of its period, and digests of all runs and of
    the collapsed text."""
    found = periodic_runs(docs, plant=True)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    # a/b > c/d is decided by a*d > c*b; sorted by start, then period, so the first of equals stays
    more = "aggregate(runs, cast(null as struct<start:long,length:long,period:long>), (a, r) -> case when a is null or cast(r.length as decimal(19)) * a.period > cast(a.length as decimal(19)) * r.period then r else a end)"
    best = found.withColumn("most", F.expr(more))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "most.start", "most.length", "most.period", F.expr("most.length * 1000 div most.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), "collapsed_sha256", "n_words", "n_dropped",
    )
