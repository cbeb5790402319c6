"""Secret scans: known shapes, and random strings by their low number of characters a token.

Three shapes are found by pattern: assignments of a password, secret or key, access keys, and long hexadecimal strings.
The method adds what has no known shape: a run of key characters whose characters per token, under a byte-level
vocabulary, fall below ``RATIO``. Prose and names are made of pieces that the vocabulary holds, random strings fall
apart into pieces of one or two characters. A full stop ends a run, so each part of a dotted token is measured by itself.
Runs that a known digest or identifier explains are left out before: UUIDs, pure numbers, digests of the usual lengths
behind a digest's name, and words and numbers side by side without case changes inside. Paths are told from base64 by the
ratio of their parts; in a path, parts of at least ``MIN_RUN`` characters are measured again, each by itself.

Offsets are code points, ends exclusive. Defined results: null text counts as empty; an empty text has no spans, the
digest of nothing; very long texts are scanned whole; repeated rows get equal results; extra columns are ignored by
``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
#: The same as HEX, without the short runs that the length would drop: a run is maximal, so none is hidden.
LONG_HEX = re.compile("(?<![0-9a-f])[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: Characters per token below which a run of at least MIN_RUN characters is random.
RATIO, MIN_RUN = 2.0, 20
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
LETTERS = re.compile("[A-Za-z]+")
#: A word without a case change inside.
PLAIN = re.compile("[A-Z]?[a-z]+|[A-Z]+")
WORDS = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?:[_/=-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+))*")
UUID = re.compile("[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
DIGEST = re.compile("[0-9a-fA-F]+")
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
DIGEST_NAME = re.compile(r"(?:md5|sha-?(?:1|2|3|224|256|384|512)|digest|checksum|integrity|commit|blake2[bs]?)[\"']?\s*[-:=(]?\s*[\"']?$", re.I)
MASK = "<secret>"


@lru_cache(maxsize=2)
def _encoding(vocabulary: str, pattern: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the three known shapes."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out)


def _explained(text: str, start: int, end: int) -> bool:
    """Whether a run is a known digest or identifier, or too plain to be a secret."""
    run = text[start:end]
    if UUID.fullmatch(run) or WORDS.fullmatch(run):
        return True
    if not re.search("[0-9]", run) and all(PLAIN.fullmatch(x) for x in LETTERS.findall(run)) or not LETTERS.search(run):
        return True
    return bool(DIGEST.fullmatch(run)) and len(run) in DIGEST_LENGTHS and bool(DIGEST_NAME.search(text, max(0, start - 24), start))


def _random(parts: list[str], encoding) -> bool:
    return sum(map(len, parts)) < RATIO * sum(len(encoding.encode_ordinary(x)) for x in parts)


def _random_spans(text: str, start: int, end: int, encoding) -> list[tuple[int, int, int]]:
    """The run itself if it is random, or the random parts of a path."""
    if _explained(text, start, end):
        return []
    run = text[start:end]
    parts = run.split("/")
    path = len(parts) > 3 and not re.search("[+=]", run)
    if _random([x for x in parts if not UUID.fullmatch(x)] if path else [run], encoding):
        return [(start, 3, end)]
    out = []
    for x in parts if len(parts) > 1 else []:
        if len(x) >= MIN_RUN and not _explained(text, start, start + len(x)) and _random([x], encoding):
            out.append((start, 3, start + len(x)))
        start += len(x) + 1
    return out


def spans_of(text: str, encoding) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and spans of random runs that no base span touches."""
    base, more, k, reach = _base(text), [], 0, 0
    for m in RUN.finditer(text):  # runs and base spans in order of their starts, walked together
        while k < len(base) and base[k][0] < m.end():
            reach = max(reach, base[k][2])
            k += 1
        if reach <= m.start():
            more += _random_spans(text, m.start(), m.end(), encoding)
    return base, more


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_random", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def _scan(vocabulary: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(vocabulary, pattern)
        for b in batches:
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                base, more = spans_of(text or "", encoding)
                n = [sum(k == x for _, k, _ in base) for x in range(3)]
                out.append({"doc_id": doc, "n_assign": n[0], "n_access": n[1], "n_hex": n[2], "n_random": len(more), "base_sha256": hashlib.sha256(_joined(base).encode()).hexdigest(), "spans": _joined(sorted(base + more))})
            yield pa.RecordBatch.from_pylist(out, _RESULT)

    return run


def scan(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256 and spans of every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_scan(vocabulary, pattern), "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def redact_text(text: str | None, encoding) -> str | None:
    """The text with each union of overlapping spans replaced by MASK."""
    if not text:
        return text
    base, more = spans_of(text, encoding)
    out, at, merged = [], 0, []
    for s, _, e in sorted(base + more):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(e, merged[-1][1])
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[at:s], MASK]
        at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``docs`` with secrets in ``text`` masked; all other columns as they are."""
    schema = docs.schema
    field = schema["text"].name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(vocabulary, pattern)
        for b in batches:
            at = b.schema.get_field_index(field)
            kind = b.column(at).type
            clean = pa.array([redact_text(t, encoding) for t in b.column(at).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([clean if i == at else b.column(i) for i in range(b.num_columns)], schema=b.schema)

    return docs.mapInArrow(run, schema)
