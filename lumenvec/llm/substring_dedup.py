"""Substring deduplication: Rabin-Karp hashes of all windows of ``width`` words, counted in Spark.

1. Each task hashes all windows of a block of texts (``textscan``). Within the block a hash is sent once, with a mark
   if the block holds it twice or more, so a passage in a third of all texts sends one entry a block, not one a text.
2. Entries go to the bucket that a second, independent hash names. A bucket compares 64-bit hashes from all its blocks
   and answers each block with the places of windows that occur anywhere else. 64 bits plus the bucket's number tell
   windows apart: with one bucket for ``BUCKET_BYTES`` of text, N windows give about N * 5e5 / 2**64 false repeats
   (under one in 100 TB of text).
3. Answers return to their block; places become maximal intervals of words by text, and a join by (doc_id, text hash)
   brings them to the rows.

Entries travel as packed arrays (8 bytes a hash, about 2 a place). No step keeps more than a bucket or a block.

Defined results: null and empty texts have no words; texts shorter than a window keep all; repeated rows remove each
other's windows (all copies go: a window that starts anywhere else is removed wherever it stands); very long texts form
a block of their own; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenvec.llm.textscan import blocks, mix, window_hashes, words_in

WIDTH = 35
#: Text for which there is a bucket of hashes: about a million windows.
BUCKET_BYTES = 8 << 20
#: Buckets that a task has to read, where the session doesn't ask for more tasks: exchanges grow with the text.
TASK_BUCKETS = 4

_ENTRY = pa.schema([("bucket", pa.int64()), ("block", pa.string()), ("kind", pa.int8()), ("hashes", pa.binary()), ("places", pa.binary()), ("wide", pa.bool_()), ("docs", pa.list_(pa.int64())), ("text_hashes", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
_ENTRY_SQL = "bucket long, block string, kind byte, hashes binary, places binary, wide boolean, docs array<long>, text_hashes array<long>, ends array<long>"
#: kind: entries of windows seen once in the block, entries of windows it repeats, the block's directory, answers.
_ONCE, _AGAIN, _DIRECTORY, _ANSWER = 0, 1, 2, 3


def _pack(places: np.ndarray) -> tuple[bytes, bool]:
    steps = np.diff(places, prepend=0)
    wide = bool(len(steps)) and int(steps.max()) > 0xFFFF
    return steps.astype("<u4" if wide else "<u2").tobytes(), wide


def _unpack(data: bytes, wide: bool) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, "<u4" if wide else "<u2").astype(np.int64))


def _row(bucket: int, block: str, kind: int, hashes: bytes = b"", places: bytes = b"", wide: bool = False, docs=(), text_hashes=(), ends=()) -> dict:
    return {"bucket": bucket, "block": block, "kind": kind, "hashes": hashes, "places": places, "wide": wide, "docs": docs, "text_hashes": text_hashes, "ends": ends}


def _entries(width: int, n_buckets: int, salt: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            words = words_in(b.column("text"))
            h = words.hashes(35)
            places = np.flatnonzero(words.doc[: len(h) - width + 1] == words.doc[width - 1 :]) if len(h) >= width else np.zeros(0, np.int64)
            if not len(places):
                continue
            one, two = window_hashes(h, width, 351)[places], window_hashes(h, width, 352)[places]
            ths, docs = b.column("th"), b.column("doc_id")
            block = hashlib.sha1(salt.encode() + np.asarray(ths).tobytes() + np.asarray(docs.fill_null(-1)).tobytes()).hexdigest()[:24]
            _, first, inverse, count = np.unique(one, return_index=True, return_inverse=True, return_counts=True)
            again = count[inverse] > 1
            out = []
            # Texts' numbers and the windows that the block itself repeats stay with the block.
            ends = np.searchsorted(words.doc, np.arange(words.n_docs), side="right")
            kept, wide = _pack(places[again])
            out.append(_row(int(ths[0].as_py()) % n_buckets, block, _DIRECTORY, places=kept, wide=wide, docs=docs.to_pylist(), text_hashes=ths.to_pylist(), ends=ends.tolist()))
            first.sort()
            bucket = (mix(two[first]) % np.uint64(n_buckets)).astype(np.int64) * 2 + again[first]
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            for part in np.split(order, cuts):
                at = first[part]
                key = int(bucket[part[0]])
                packed, wide = _pack(places[at]) if not key % 2 else (b"", False)
                out.append(_row(key // 2, block, _AGAIN if key % 2 else _ONCE, one[at].astype("<u8").tobytes(), packed, wide))
            yield pa.RecordBatch.from_pylist(out, _ENTRY)

    return run


def _answers(table: pa.Table) -> pa.Table:
    """A bucket: which windows seen once in their block occur in another one; directories pass through."""
    rows = table.to_pylist()
    out = [r for r in rows if r["kind"] == _DIRECTORY]
    entries = [r for r in rows if r["kind"] != _DIRECTORY]
    if entries:
        parts = [np.frombuffer(r["hashes"], "<u8") for r in entries]
        everything = np.concatenate(parts)
        values, inverse, count = np.unique(everything, return_inverse=True, return_counts=True)
        sizes = [len(p) for p in parts]
        marked = np.zeros(len(values), bool)
        marked[inverse[np.repeat([r["kind"] == _AGAIN for r in entries], sizes)]] = True
        hit, at = (marked | (count > 1))[inverse], 0
        for r, n in zip(entries, sizes, strict=True):
            mine = hit[at : at + n]
            at += n
            if r["kind"] == _ONCE and mine.any():
                places, wide = _pack(_unpack(r["places"], r["wide"])[mine])
                out.append(_row(r["bucket"], r["block"], _ANSWER, places=places, wide=wide))
    return pa.Table.from_pylist(out, _ENTRY)


_FOUND = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("starts", pa.list_(pa.int32())), ("stops", pa.list_(pa.int32()))])


def _intervals(width: int):
    def run(table: pa.Table) -> pa.Table:
        """A block: its texts' repeated windows as maximal intervals of words."""
        rows = table.to_pylist()
        directory = next(r for r in rows if r["kind"] == _DIRECTORY)
        places = np.unique(np.concatenate([_unpack(r["places"], r["wide"]) for r in rows]))
        if not len(places):
            return _FOUND.empty_table()
        ends = np.asarray(directory["ends"], np.int64)
        doc = np.searchsorted(ends, places, side="right")
        fresh = np.ones(len(places), bool)
        fresh[1:] = (np.diff(places) > width) | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(fresh)
        stop = places[np.append(begin[1:] - 1, len(places) - 1)] + width
        begin_doc = doc[begin]
        base = np.concatenate([[0], ends])[begin_doc]
        out = []
        for d in np.unique(begin_doc):
            lo, hi = np.searchsorted(begin_doc, [d, d + 1])
            out.append({"doc_id": directory["docs"][d], "th": directory["text_hashes"][d], "starts": (places[begin[lo:hi]] - base[lo:hi]).tolist(), "stops": (stop[lo:hi] - base[lo:hi]).tolist()})
        return pa.Table.from_pylist(out, _FOUND)

    return run


def repeated_intervals(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, th, starts, stops): by text with repeated windows, the maximal word intervals that they cover."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(8, -(-total // BUCKET_BYTES))
    n_parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_buckets // TASK_BUCKETS))
    entries = rows.mapInArrow(_entries(width, n_buckets, uuid.uuid4().hex), _ENTRY_SQL).repartition(n_parts, "bucket")
    answers = entries.groupBy("bucket").applyInArrow(_answers, _ENTRY_SQL).filter(F.col("kind").isin(_DIRECTORY, _ANSWER))
    found = answers.repartition(n_parts, "block").groupBy("block").applyInArrow(_intervals(width), "doc_id long, th long, starts array<int>, stops array<int>")
    return found.dropDuplicates(["doc_id", "th"])


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in blocks(batches):
        words = words_in(b.column("text"))
        data = words.data.tobytes()
        first = np.searchsorted(words.doc, np.arange(words.n_docs + 1))
        out = []
        for i, (doc, starts, stops) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("starts").to_pylist(), b.column("stops").to_pylist(), strict=True)):
            lo, hi = int(first[i]), int(first[i + 1])
            kept = np.ones(hi - lo, bool)
            for s, e in zip(starts or (), stops or (), strict=True):
                kept[s:e] = False
            at = np.flatnonzero(kept) + lo
            text = b" ".join([data[s:e] for s, e in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)])
            out.append({"doc_id": doc, "n_words": hi - lo, "n_removed": hi - lo - len(at), "kept_sha256": hashlib.sha256(text).hexdigest()})
        yield pa.RecordBatch.from_pylist(out, _RESULT)


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of ``docs`` (doc_id, text)."""
    found = repeated_intervals(docs, width)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    joined = rows.alias("d").join(found.alias("f"), F.expr("d.th = f.th and d.doc_id <=> f.doc_id"), "left").select("d.doc_id", "d.text", "f.starts", "f.stops")
    return joined.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")
