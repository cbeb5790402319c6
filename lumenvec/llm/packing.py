"""Best-fit packing of token sequences, in bulk-synchronous rounds.

1. Texts become pieces: all token ids of a document plus the end id; only documents beyond the capacity are cut, into
   pieces of full capacity of which the first may be shorter.
2. Classes of lengths are packed from the longest down, each in rounds over two tables: the documents that wait and the
   gaps, a row an open sequence with its room. A gap takes part with as many slots as it surely has room for.
3. A round sorts documents and slots together by size over ranges; a hash spreads a size that a third of all rows share.
   A sweep upwards gives each slot the largest document before it that no slot took, so documents go to the smallest
   gaps that hold them; of documents that want one slot, the one with the higher rank gets it, the others go on to the
   next gap. Each range sweeps its own rows, and what stays free on either side is a number of documents and one of
   slots: from these two numbers a range, the sweep over the bounds numbers the free rows, which a join then brings together.
4. Gaps are updated from what they took, and the next round begins with the documents that found none. When no gap holds
   the shortest of them, new sequences are opened, as many as take all that wait of the class.
5. All rounds' tables together give a piece's offset: the lengths of those that came into its sequence before.

A round takes something from every gap it could use, or ends the class, so the number of rounds doesn't grow with the rows.

Defined results: null and empty texts give the end id alone; ties in length are ordered by a hash, equal rows by their
place; repeated rows are packed each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lumenvec.llm.common import written

CAPACITY, END_ID = 1024, 2
#: Sizes are packed class by class, from the largest: classes end at these fractions of the capacity.
CLASSES = (2, 3, 4, 8, 32)
#: Documents and slots of one range of a sweep: at most, and where more ranges would only cost tasks, about.
TASK_ROWS, FEW_ROWS = 1 << 19, 1 << 14
#: Characters that all regex engines class alike; texts with others go to the tokenizer itself.
PLAIN = re.compile("[\t\n\r\x20-\x7e¡-ɏ]*")


class Encoder:
    """Ids as the tokenizer gives them. Where its vocabulary is also at hand as ranks (``ranks_path``, ``pattern``),
    plain texts go to the faster library that reads those; special strings and all other characters stay with the
    tokenizer. Both give the same ids on such texts, as the tests check."""

    def __init__(self, model_path: str, ranks_path: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(model_path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("pack", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if self.fast is None or not PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


@lru_cache(maxsize=2)
def _encoder(*paths: str | None) -> Encoder:
    return Encoder(*paths)


_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _pieces(paths: tuple[str | None, ...], capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(*paths), np.array([end_id], "<u4")
        for b in batches:
            docs, piece, start, length, crc = [], [], [], [], []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = np.concatenate([encode(text.as_py() or ""), end])
                n = len(ids)
                first = n % capacity or capacity
                edges = [0, *range(first, n + 1, capacity)]
                for k, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    docs.append(doc)
                    piece.append(k)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(ids[s:e]))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((docs, piece, start, length, crc), _PIECE, strict=True)], schema=_PIECE)

    return run


def to_pieces(docs: DataFrame, paths: tuple[str | None, ...], capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_pieces(paths, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


def _matches(is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of matched documents and of their slots, for rows from small to large: a slot takes the last document before it that is still free."""
    step = np.where(is_gap, -1, 1)
    depth = np.cumsum(step)
    floor = np.concatenate([[0], np.minimum(np.minimum.accumulate(depth), 0)[:-1]])
    waiting = depth - step - floor  # free documents before the row
    level = np.where(is_gap, waiting, waiting + 1)
    at = np.flatnonzero(level > 0)
    order = at[np.argsort(level[at], kind="stable")]
    # At one level documents come and are taken in turn.
    pair = np.flatnonzero(~is_gap[order[:-1]] & is_gap[order[1:]] & (level[order[:-1]] == level[order[1:]]))
    return order[pair], order[pair + 1]


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of sizes: matched rows carry a document and its slot; other rows get ``nth``, their place among those of their kind."""
    found = [b for b in batches if b.num_rows]
    if not found:
        return
    table = pa.Table.from_batches(found).combine_chunks()
    is_gap = np.asarray(table["is_gap"].to_numpy(zero_copy_only=False), bool)
    docs, slots = _matches(is_gap)
    free = np.ones(len(is_gap), bool)
    free[docs] = free[slots] = False
    at = np.flatnonzero(free)
    nth = np.where(is_gap[at], np.cumsum(is_gap[at]), np.cumsum(~is_gap[at])) - 1
    pairs, rest = table.take(pa.array(docs)), table.take(pa.array(at))
    for name in ("seq", "slot"):
        pairs = pairs.set_column(pairs.schema.get_field_index(name), table.schema.field(name), table[name].take(pa.array(slots)))
    yield from pairs.append_column("nth", pa.nulls(len(docs), pa.int64())).to_batches()
    yield from rest.append_column("nth", pa.array(nth, pa.int64())).to_batches()


def across(parts: list[tuple[int, int, int]]) -> tuple[list[tuple], int]:
    """Carries the sweep over the bounds of ranges, from (range, its free slots, its free documents) in order.

    Returns rows (is_gap, part, lo, hi, base, sign): free rows ``nth`` from lo to before hi get the match number
    base + sign * nth, the same for a document and its slot. At most four rows a range.
    """
    stack: list[tuple[int, int, int]] = []
    rows, number = [], 0
    for part, slots, docs in parts:
        at = 0
        while at < slots and stack:
            below, lo, hi = stack.pop()
            n = min(hi - lo, slots - at)
            rows += [(False, below, hi - n, hi, number + hi - 1, -1), (True, part, at, at + n, number - at, 1)]
            if lo < hi - n:
                stack.append((below, lo, hi - n))
            at, number = at + n, number + n
        if docs:
            stack.append((part, 0, docs))
    return rows, number


def _round(waiting: DataFrame, slots: DataFrame, n_parts: int) -> tuple[DataFrame, DataFrame, int]:
    """One sweep of ``waiting`` (size, doc) over ``slots`` (size, seq, slot): what was taken, what still waits, and how many were taken."""
    doc_type = waiting.schema["doc"].dataType
    both = waiting.select("size", F.lit(False).alias("is_gap"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("long").alias("slot"), "doc")
    both = both.unionByName(slots.select("size", F.lit(True).alias("is_gap"), "seq", "slot", F.lit(None).cast(doc_type).alias("doc")))
    both = both.withColumn("salt", F.xxhash64("seq", "slot", F.monotonically_increasing_id()))
    ordered = both.repartitionByRange(n_parts, "size", "is_gap", "salt").sortWithinPartitions("size", "is_gap", "salt").drop("salt").withColumn("part", F.spark_partition_id())
    schema = StructType([*ordered.schema.fields, StructField("nth", LongType())])
    swept = written(ordered.mapInArrow(_sweep, schema), "swept")
    free = F.col("nth").isNotNull()
    count = lambda c: F.count(F.when(c, 1)).alias
    parts = swept.groupBy("part").agg(count(free & F.col("is_gap"))("slots"), count(free & ~F.col("is_gap"))("docs"), count(~free)("pairs")).orderBy("part").collect()  # one row a range
    rows, number = across([(r["part"], r["slots"], r["docs"]) for r in parts])
    bounds = waiting.sparkSession.createDataFrame(rows, "is_gap boolean, part int, lo long, hi long, base long, sign int").coalesce(1)
    numbered = swept.filter(free).alias("s").join(F.broadcast(bounds).alias("b"), F.expr("s.is_gap = b.is_gap and s.part = b.part and s.nth >= b.lo and s.nth < b.hi"), "left")
    numbered = numbered.select("s.*", F.expr("b.base + b.sign * s.nth").alias("match"))
    columns = ["size", "doc", "seq", "slot"]
    taken = swept.filter(~free).select(*columns)
    if number:
        mine = numbered.filter("not is_gap and match is not null").select("match", "size", "doc")
        taken = taken.unionByName(mine.join(numbered.filter("is_gap and match is not null").select("match", "seq", "slot"), "match").select(*columns))
    left = numbered.filter("not is_gap and match is null").select("size", "doc")
    return written(taken, "taken"), left, number + sum(r["pairs"] for r in parts)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a written table with a ``length`` of 1 to ``capacity``) with sequence_id and offset."""
    spark, columns = pieces.sparkSession, pieces.columns
    all_pieces = pieces.select(F.col("length").cast("long").alias("size"), F.struct(*columns).alias("doc"))
    edges = [capacity, *sorted({capacity // k for k in CLASSES} - {0, capacity}, reverse=True), 0]
    in_class = F.lit(0)
    for e in edges[1:-1]:
        in_class = in_class + (F.col("size") <= e).cast("int")
    counts = dict(all_pieces.groupBy(in_class.alias("c")).count().collect())  # one row a class
    gaps = spark.createDataFrame([], "seq long, room long")
    taken, opened = [], 0
    for c, (upper, lower) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        waiting, n = all_pieces.filter((F.col("size") <= upper) & (F.col("size") > lower)), counts.get(c, 0)
        while n:
            least, most = waiting.agg(F.min("size"), F.max("size")).first()
            usable = gaps.filter(F.col("room") >= least).count() if opened else 0
            if usable:
                each = F.least(F.col("room") / most, F.lit(-(-2 * n // usable)))
            else:
                usable, each = -(-n // (capacity // most)), F.lit(capacity // most)
                gaps = gaps.unionByName(spark.range(opened, opened + usable).select(F.col("id").alias("seq"), F.lit(capacity).cast("long").alias("room")))
                opened += usable
            slots = gaps.filter(F.col("room") >= least).select(F.col("room").alias("size"), "seq", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1), F.floor(each)).cast("long"))).alias("slot"))
            rows = n + 2 * usable
            n_parts = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // FEW_ROWS)), -(-rows // TASK_ROWS))
            now, waiting, got = _round(waiting, slots, n_parts)
            taken.append(now.withColumn("round", F.lit(len(taken))))
            n -= got
            used = now.groupBy("seq").agg(F.sum("size").alias("used"))
            gaps = written(gaps.join(used, "seq", "left").select("seq", (F.col("room") - F.coalesce("used", F.lit(0))).alias("room")).filter("room > 0"), "gaps")
    if not taken:
        return pieces.select("*", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset")).limit(0)
    # A sequence holds at most ``capacity`` pieces.
    before = Window.partitionBy("seq").orderBy("round", "slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = reduce(DataFrame.unionByName, taken).withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)))
    return placed.select("doc.*", F.col("seq").alias("sequence_id"), F.col("at").cast("long").alias("offset"))


def pack_documents(docs: DataFrame, paths: tuple[str | None, ...], capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of ``docs`` (doc_id, text).

    ``paths``: what ``Encoder`` takes.
    """
    return pack(written(to_pieces(docs, paths, capacity, end_id), "pieces"), capacity)
