"""Near-duplicate classes by BagMinHash: weighted-Jaccard signatures, bands, and exact verification.

A text is the bag of its shingles of ``SHINGLE`` words; two texts are linked if the weighted Jaccard similarity of
their bags (sum of minima over sum of maxima of the counts) is at least ``THRESHOLD``. Classes are the connected
components of the links.

Signature: every shingle owns a Poisson process on the half-line of weights times ``REGISTERS`` components, drawn from
its hash. The line is cut into the levels [0,1) [1,2) [2,4) [4,8) ...; a level's points come in the order of time, each
falls on a random component and on a random place of the level, and counts if that place is below the shingle's
weight. A register keeps the earliest time, so two registers agree with exactly the probability of the similarity. A
process stops as soon as its next time is later than all of its text's registers: after the registers are full most
shingles cost one point.

Candidates: texts that agree in one of ``BANDS`` bands of ``ROWS`` registers (a pair at 0.8 is missed in 5 of 100,000
cases). No bucket is capped and none is expanded into all pairs: every member is held against one leader of its bucket,
the text around which most others crowd, and links are merged into components. Buckets that then still hold several
components are joined into groups; parts of a group, of bounded size, are compared as matrices of shingles, and of each
member and other component only the best link leaves. All links are verified exactly, on whole texts.

Defined results: texts without a word are classes of their own; texts of under five words are one shingle; equal texts
(equal word sequences) are one class whatever their number; a null doc_id is a row like others and takes the class's
smallest non-null doc_id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenvec.llm.common import WORD, likely, spare_name, written
from lumenvec.llm.components import components
from lumenvec.llm.textscan import Words, blocks, mix, powers, window_hashes, words_in

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: What a part of a group holds at most when its members are compared with another part's, and columns of a product.
MEMBERS, PART_SHINGLES, COLUMNS = 512, 200_000, 4096
_BLOCK_DOCS, _PAIR_BYTES = 2000, 1 << 20
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _unit(h: np.ndarray) -> np.ndarray:
    """(0, 1] from the upper 53 bits."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def bags(words: Words, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, shingle hash and count, by text and hash. A text of fewer words than ``width`` has one shingle."""
    h = words.hashes(9)
    n = np.bincount(words.doc, minlength=words.n_docs)
    inside = np.flatnonzero(words.doc[: len(h) - width + 1] == words.doc[width - 1 :]) if len(h) >= width else np.zeros(0, np.int64)
    g, doc = window_hashes(h, width, 91)[inside], words.doc[inside]
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        first = np.searchsorted(words.doc, short)
        own = np.array([int(mix(np.array([_fold(h[f : f + n[d]], 93)], np.uint64))[0]) for d, f in zip(short, first, strict=True)], np.uint64)
        g, doc = np.concatenate([g, own]), np.concatenate([doc, short])
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    fresh = np.ones(len(g), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(fresh)
    return doc[at], g[at], np.diff(np.append(at, len(g)))


def _fold(h: np.ndarray, seed: int) -> np.uint64:
    """A polynomial over a whole sequence of hashes."""
    return (h * powers(int(mix(np.array([seed], np.uint64))[0]) | 1, len(h))).sum(dtype=np.uint64) + np.uint64(len(h))


def signatures(doc: np.ndarray, g: np.ndarray, count: np.ndarray, n_docs: int, m: int = REGISTERS) -> np.ndarray:
    """Registers (earliest times) of ``n_docs`` texts; infinite for a text without shingles."""
    reg = np.full(n_docs * m, np.inf)
    # One process for each level that starts below the count.
    levels = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1, 1)
    e = np.repeat(np.arange(len(g)), levels)
    level = np.arange(len(e)) - np.repeat(np.cumsum(levels) - levels, levels)
    start = np.where(level == 0, 0, 2.0 ** (level - 1))
    length = np.where(level < 2, 1.0, 2.0 ** (level - 1))
    state, where, weight = mix(g[e] ^ (level.astype(np.uint64) * _GOLD)), doc[e], count[e].astype(np.float64)
    time, rate = np.zeros(len(e)), m * length
    while len(e):
        steps = int(np.clip(400_000 // max(len(state), 1), 1, 64))
        h = mix(state[:, None] + _GOLD * np.arange(1, steps + 1, dtype=np.uint64)[None, :])
        at = time[:, None] + np.cumsum(-np.log(_unit(h)), axis=1) / rate[:, None]
        h2 = mix(h ^ _GOLD)
        component = (h2 % np.uint64(m)).astype(np.int64)
        place = start[:, None] + length[:, None] * _unit(mix(h2))
        hit = place <= weight[:, None]
        np.minimum.at(reg, (where[:, None] * m + component)[hit], at[hit])
        time, state = at[:, -1], state + np.uint64(int(_GOLD) * steps & (1 << 64) - 1)
        live = time < reg.reshape(n_docs, m).max(axis=1)[where]
        state, where, weight, time, rate, start, length, e = (x[live] for x in (state, where, weight, time, rate, start, length, e))
    return reg.reshape(n_docs, m)


def band_hashes(reg: np.ndarray) -> np.ndarray:
    """Hashes of the bands, the band's number included. Times are taken as 32-bit floats."""
    bits = reg.astype(np.float32).view(np.uint32).astype(np.uint64).reshape(len(reg), BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * _GOLD + np.zeros((len(reg), 1), np.uint64)
    for k in range(ROWS):
        h = mix(h ^ bits[:, :, k])
    return h.view(np.int64)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("node", pa.binary()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in blocks(batches):
        for lo in range(0, big.num_rows, _BLOCK_DOCS):
            b = big.slice(lo, _BLOCK_DOCS)
            words = words_in(b.column("text"))
            n = np.bincount(words.doc, minlength=words.n_docs)
            bands = band_hashes(signatures(*bags(words), words.n_docs))
            one, two = words.hashes(7), words.hashes(8)
            first = np.concatenate([[0], np.cumsum(n)])
            nodes = [int(_fold(one[s:e], 71)).to_bytes(8, "big") + int(_fold(two[s:e], 72)).to_bytes(8, "big") if e > s else None for s, e in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("th"), pa.array(nodes, pa.binary()), pa.array(np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)), pa.array([x if k else [] for x, k in zip(bands, n, strict=True)], pa.list_(pa.int64()))], schema=_SIGNED
            )


def similarities(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the bags of each pair of texts."""
    n, (da, ga, ca), (db, gb, cb) = len(a), bags(words_in(a)), bags(words_in(b))
    doc, g, count = np.concatenate([da, db]), np.concatenate([ga, gb]), np.concatenate([ca, cb])
    order = np.lexsort((g, doc))
    doc, g, count = doc[order], g[order], count[order]
    met = np.flatnonzero((doc[1:] == doc[:-1]) & (g[1:] == g[:-1]))  # a hash stands once on either side
    low = np.bincount(doc[met], np.minimum(count[met], count[met + 1]), n)
    return low / np.maximum(np.bincount(doc, count, n) - low, 1)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, text_a, text_b) with their similarity. Pairs are close in size, so blocks of text_a bound both."""
    for b in blocks(batches, "text_a", _PAIR_BYTES):
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(similarities(b.column("text_a"), b.column("text_b")), pa.float64())], ["a", "b", "sim"])


def _checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, sim) of pairs (a, b) of nodes."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a binary, b binary, sim double")


_BAGGED = pa.schema([("node", pa.binary()), ("bag", pa.binary())])


def _bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as packed sets: a shingle that occurs c times gives c different numbers, so that sets overlap as bags do."""
    for b in blocks(batches):
        doc, g, count = bags(words_in(b.column("text")))
        doc, g = np.repeat(doc, count), np.repeat(g, count)
        nth = np.arange(len(g)) - np.repeat(np.cumsum(count) - count, count)
        g = mix(g ^ (nth.astype(np.uint64) * _GOLD)).astype("<u8")
        at = np.searchsorted(doc, np.arange(b.num_rows + 1))
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([g[s:e].tobytes() for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary())], schema=_BAGGED)


_LINK = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _links_between(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """Two parts of a group (or one with itself): of each member and each other component, the most similar link."""
        i, j, part = table["i"][0].as_py(), table["j"][0].as_py(), np.asarray(table["part"])
        node = np.array([*table["node"].to_pylist(), None], object)[:-1]
        _, label = np.unique(np.array(table["label"].to_pylist()), return_inverse=True)
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        if not len(left) or not len(right) or len(np.unique(label)) == 1:
            return _LINK.empty_table()
        sets = [np.frombuffer(x, "<u8") for x in table["bag"].to_pylist()]
        size = np.array([len(x) for x in sets])
        values, column = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), size)
        often = np.bincount(column, minlength=len(values)) > 1
        keep = often[column]
        column, row = (np.cumsum(often) - 1)[column[keep]], row[keep]
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        common = np.zeros((len(left), len(right)), np.float32)
        for lo in range(0, int(often.sum()), COLUMNS):
            s, e = np.searchsorted(column, [lo, lo + COLUMNS])
            here = np.zeros((len(sets), COLUMNS), np.float32)
            here[row[s:e], column[s:e] - lo] = 1
            common += here[left] @ here[right].T
        sim = common / (size[left][:, None] + size[right][None, :] - common)
        p, q = np.nonzero((sim >= np.float32(threshold - 1e-6)) & (label[left][:, None] != label[right][None, :]))
        exact = common[p, q].astype(np.int64) >= threshold * (size[left[p]] + size[right[q]] - common[p, q].astype(np.int64))
        p, q = p[exact], q[exact]
        best = np.lexsort((-sim[p, q], label[right[q]], p))
        p, q = p[best], q[best]
        first = np.ones(len(p), bool)
        first[1:] = (p[1:] != p[:-1]) | (label[right[q[1:]]] != label[right[q[:-1]]])
        return pa.Table.from_arrays([pa.array(node[left[p[first]]].tolist(), pa.binary()), pa.array(node[right[q[first]]].tolist(), pa.binary())], schema=_LINK)

    return run


def _links(rows: DataFrame, signed: DataFrame, threshold: float) -> DataFrame | None:
    """All links needed for the classes: (a, b) between nodes, that is different texts."""
    # A node's text stands in the row with the smallest (doc_id, th) of its copies; its bands are those of any copy.
    nodes = signed.filter("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("at"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = written(nodes, "nodes")
    banded = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    several = written(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "buckets")
    member = written(likely(banded, several, "bucket").join(several, "bucket").select("bucket", "node", "n", "size"), "members")
    # The node with the fullest buckets leads: near copies of one text crowd around that text.
    crowd = written(member.groupBy("node").agg(F.sum("size").alias("crowd")).join(nodes.select("node", "n", "at"), "node"), "wanted")
    if crowd.isEmpty():
        return None
    place = crowd.select("node", "at.doc_id", "at.th")
    texts = likely(rows, place, "th").alias("r").join(place.alias("w"), F.expr("r.th = w.th and r.doc_id <=> w.doc_id")).select("w.node", "r.text").dropDuplicates(["node"])
    texts = written(texts, "node_texts")
    crowded = member.select("bucket", "node").join(crowd.select("node", "crowd", "n"), "node")
    lead = written(crowded.groupBy("bucket").agg(F.min(F.struct((-F.col("crowd")).alias("o"), F.col("node").alias("b"), F.col("n").alias("m"))).alias("lead")).select("bucket", "lead.b", "lead.m"), "leaders")
    close = F.expr(f"node <> b and least(n, m) >= {threshold} * greatest(n, m)")  # more can't be reached at these sizes
    pairs = member.join(lead, "bucket").filter(close).select(F.col("node").alias("a"), "b").distinct()
    tested = written(_checked(pairs, texts), "tested")
    links = tested.filter(F.col("sim") >= threshold).select("a", "b")
    label = written(crowd.select("node", "n").join(components(links), "node", "left").select("node", "n", F.coalesce("label", "node").alias("label")), "labels")
    # Buckets that still hold several components; those that share a member make one group.
    open_ = member.select("bucket", "node").join(label.select("node", "label"), "node").groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("node").alias("b")).filter("lo <> hi")
    edges = written(member.select("bucket", "node").join(written(open_.select("bucket", "b"), "open"), "bucket").select(F.col("node").alias("a"), "b"), "group_edges")
    if edges.isEmpty():
        return links
    group = written(components(edges).withColumnRenamed("label", "grp").join(label, "node").select("node", "n", "label", "grp"), "groups")
    parts = group.groupBy("grp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / MEMBERS), F.ceil(F.sum("n") / PART_SHINGLES)).cast("int").alias("parts"))
    mine = group.join(written(parts, "parts"), "grp").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    mine = mine.join(texts.mapInArrow(_bagged, "node binary, bag binary"), "node")
    each = mine.select("grp", "node", "label", "part", "bag", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("k"))
    each = each.select("grp", F.least("part", "k").alias("i"), F.greatest("part", "k").alias("j"), "node", "label", "part", "bag")
    crossing = each.groupBy("grp", "i", "j").applyInArrow(_links_between(threshold), "a binary, b binary")
    return links.unionByName(written(crossing.distinct(), "crossing"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, th (the text's hash), class_id (the class's smallest doc_id) and is_first, of every row of ``docs`` (doc_id, text).

    is_first marks the row with the smallest (doc_id, th) of its class, a null doc_id last, and its repetitions.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    signed = written(rows.mapInArrow(_sign, "doc_id long, th long, node binary, n long, bands array<long>"), "signed")
    links = _links(rows, signed, threshold)
    mine = signed.select("doc_id", "th", "node")
    if links is None:
        labelled = mine.withColumn("label", F.col("node"))
    else:
        labelled = mine.join(components(links), "node", "left").select("doc_id", "th", "node", F.coalesce("label", "node").alias("label"))
    labelled = written(labelled, "row_labels")
    least = labelled.filter("label is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")).alias("least"), F.count(F.lit(1)).alias("rows"))
    least = written(least.filter("rows > 1").select("label", F.col("least.doc_id").alias("least_id"), F.col("least.th").alias("least_th")), "classes")
    alone = F.col("least_th").isNull()
    return labelled.join(least, "label", "left").select(
        "doc_id", "th", F.when(alone, F.col("doc_id")).otherwise(F.col("least_id")).alias("class_id"), (alone | (F.col("doc_id").eqNullSafe(F.col("least_id")) & (F.col("th") == F.col("least_th")))).alias("is_first")
    )


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class of ``docs``, all columns as they are; rows without a word stay."""
    key, copies = spare_name(docs, "row_key"), near_duplicates(docs, threshold)
    named = lambda doc, th: F.concat_ws(":", F.coalesce(F.col(doc).cast("long").cast("string"), F.lit("null")), th.cast("string"))
    kept = copies.filter("is_first").select(named("doc_id", F.col("th")).alias(key)).distinct()
    worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    rows = docs.filter(worded).withColumn(key, named("doc_id", F.xxhash64("text")))
    return rows.join(kept, key, "left_semi").dropDuplicates([key]).drop(key).unionByName(docs.filter(~worded))
