"""Token counts of whole texts, huge ones by overlapping chunks that resynchronise.

A text of at most ``chunk_chars`` characters is encoded at once. A longer one becomes chunks that overlap by
``overlap`` characters; Spark deals the chunks out, so one huge text occupies many tasks. Two neighbours are joined
at a boundary that (a) both encodings show at the same character and (b) is stable: no vocabulary piece holds the two
characters around it side by side, so no merge can ever cross it and what stands on either side is encoded as in the
whole text. A seam without such a boundary sends its text round again with a doubled overlap (and a chunk of at least
four overlaps); once a chunk covers the whole text no seam is left, so the loop ends with exact counts for all texts.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows each get their own result; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenvec.llm.common import written

CHUNK_CHARS = 32_768
OVERLAP = 512
#: Texts encoded in one call of the library.
CALL = 64


@lru_cache(maxsize=4)
def _processor(model_path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path)


@lru_cache(maxsize=4)
def _joined_pairs(model_path: str) -> frozenset[str]:
    """All pairs of neighbouring characters inside any piece; a boundary between another pair is stable."""
    sp = _processor(model_path)
    pairs = set()
    for i in range(sp.get_piece_size()):
        if not sp.is_byte(i):
            p = sp.id_to_piece(i)
            pairs.update(p[k : k + 2] for k in range(len(p) - 1))
    return frozenset(pairs)


def stable(a: str, b: str, pairs: frozenset[str]) -> bool:
    """Whether no token can hold characters ``a`` and ``b`` side by side."""
    return (a + b).replace(" ", "▁") not in pairs


def _count_batches(model_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _processor(model_path)
        for b in batches:
            texts, counts = b.column("text").to_pylist(), []
            for i in range(0, len(texts), CALL):
                counts.extend(map(len, sp.encode(texts[i : i + CALL], num_threads=1)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def _chunk_rows(chunk: int, overlap: int):
    """Each text as rows (chunk_no, last_no, body); starts are ``chunk - overlap`` characters apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = chunk - overlap
        for b in batches:
            for doc, th, text in zip(b.column("doc_id"), b.column("th"), b.column("text"), strict=True):
                text = text.as_py()
                last = max(0, -(-(len(text) - chunk) // step))
                for k in range(last + 1):
                    body = text[k * step : k * step + chunk]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc.as_py()], pa.int64()), pa.array([th.as_py()], pa.int64()), pa.array([k], pa.int32()), pa.array([last], pa.int32()), pa.array([body], pa.string())],
                        ["doc_id", "th", "chunk_no", "last_no", "body"],
                    )

    return run


def _seams(sp, pairs: frozenset[str], body: str, overlap: int, first: bool, last: bool) -> tuple[int, list, list]:
    """Tokens of a chunk, and its stable boundaries in the left and right overlap as (character, tokens before it)."""
    pieces = sp.encode(body, return_type="proto").pieces
    left, right, lo, hi = [], [], overlap, len(body) - overlap
    if not (first and last):
        c, whole = 0, False  # a character in bytes ends with the piece that has a surface
        for i, p in enumerate(pieces):
            if whole and 0 < c < len(body) and (c <= lo and not first or c >= hi and not last) and stable(body[c - 1], body[c], pairs):
                if c <= lo and not first:
                    left.append((c, i))
                if c >= hi and not last:
                    right.append((c - hi, i))
            whole = p.surface != ""
            c += len(p.surface)
    return len(pieces), left, right


def _encode_chunks(model_path: str, overlap: int):
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("chunk_no", pa.int32()), ("last_no", pa.int32()), ("n", pa.int64()), ("left_at", pa.list_(pa.int32())), ("left_n", pa.list_(pa.int64())), ("right_at", pa.list_(pa.int32())), ("right_n", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, pairs = _processor(model_path), _joined_pairs(model_path)
        for b in batches:
            out = []
            for r in b.to_pylist():
                n, left, right = _seams(sp, pairs, r["body"], overlap, r["chunk_no"] == 0, r["chunk_no"] == r["last_no"])
                out.append({"doc_id": r["doc_id"], "th": r["th"], "chunk_no": r["chunk_no"], "last_no": r["last_no"], "n": n, "left_at": [c for c, _ in left], "left_n": [i for _, i in left], "right_at": [c for c, _ in right], "right_n": [i for _, i in right]})
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _resynchronised(long: DataFrame, model_path: str, chunk: int, overlap: int) -> DataFrame:
    """(doc_id, th, n_tokens) of long texts; n_tokens is null where a seam has no common stable boundary."""
    n = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = long.mapInArrow(_chunk_rows(chunk, overlap), "doc_id long, th long, chunk_no int, last_no int, body string")
    encoded = chunks.repartition(n, "doc_id", "th", "chunk_no").mapInArrow(
        _encode_chunks(model_path, overlap), "doc_id long, th long, chunk_no int, last_no int, n long, left_at array<int>, left_n array<long>, right_at array<int>, right_n array<long>"
    )
    w = Window.partitionBy("doc_id", "th").orderBy("chunk_no")
    met = encoded.dropDuplicates(["doc_id", "th", "chunk_no"]).withColumns({"p_at": F.lag("right_at").over(w), "p_n": F.lag("right_n").over(w)})
    met = met.withColumn("common", F.when(F.col("chunk_no") > 0, F.try_element_at(F.array_intersect("left_at", "p_at"), F.lit(1))))
    at = lambda where, what: F.element_at(what, F.array_position(where, F.col("common")).cast("int"))
    # What the earlier chunk counts before the boundary comes in, what this one counts before it and what the earlier counts in all goes out.
    seam = F.when(F.col("chunk_no") == 0, F.lit(0)).when(F.col("common").isNotNull(), at(F.col("p_at"), F.col("p_n")) - F.col("p_all") - at(F.col("left_at"), F.col("left_n")))
    met = met.withColumn("p_all", F.lag("n").over(w)).withColumn("seam", seam)
    return met.groupBy("doc_id", "th").agg(F.when(F.count("seam") == F.count(F.lit(1)), F.sum("n") + F.sum("seam")).alias("n_tokens"))


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    short = rows.filter(F.length("text") <= chunk_chars).mapInArrow(_count_batches(model_path), "doc_id long, n_bytes long, n_tokens long")
    long = rows.filter(F.length("text") > chunk_chars).withColumn("th", F.xxhash64("text"))
    found, todo, chunk = None, long.select("doc_id", "th", "text"), chunk_chars
    while True:
        got = written(_resynchronised(todo, model_path, chunk, overlap), "token_seams")
        done = got.filter(F.col("n_tokens").isNotNull())
        found = done if found is None else found.unionByName(done)
        failed = got.filter(F.col("n_tokens").isNull()).select("doc_id", "th")
        if failed.isEmpty():
            break
        overlap, chunk = 2 * overlap, max(chunk, 8 * overlap)
        todo = long.alias("l").join(failed.alias("f"), F.expr("l.doc_id <=> f.doc_id and l.th = f.th"), "left_semi").select("doc_id", "th", "text")
    counted = long.select("doc_id", "th", "n_bytes").alias("l").join(found.alias("f"), F.expr("l.doc_id <=> f.doc_id and l.th = f.th"), "left").select("l.doc_id", "l.n_bytes", "f.n_tokens")
    return short.unionByName(counted).withColumn("over_limit", F.col("n_tokens") > limit)
