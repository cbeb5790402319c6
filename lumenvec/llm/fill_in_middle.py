"""Fill-in-the-middle forms of whole texts, cut by an Aho-Corasick scan for sparse events.

One automaton passes over a text once and reports its events: the ASCII characters that change the class of a unit
(separators of words, ends of lines) and the sentinels. Between two events nothing happens, so a gap's units follow from
its ends alone: a gap of g characters has g units of kind ``chars``, and one or none of kind ``words`` or ``lines``. Ranks
of units are looked up by a binary search in the running counts and arithmetic inside the gap that is found.

A text is cut at two unit ranks drawn from a hash of its id. ``psm`` is P prefix S suffix M middle, ``spm`` is S suffix P
prefix M middle, and ``plain`` is the text as it is: for empty texts, texts that hold a sentinel, and a hashed share.
``restore`` scans an output with the same automaton and puts the parts back, so every form has an exact round trip.

Defined results: a null text counts as empty and is plain; a null doc_id draws as the text 'null'; rows with an equal
doc_id draw the same numbers, cut by each one's own length; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lumenvec.llm.textscan import blocks

SENTINELS = ("<P>", "<S>", "<M>")
#: Percent of texts that change their form, and of these, the percent with the suffix first.
RATE, SPM = 90, 20
#: By kind of unit, the ASCII characters at which its class changes; every character is a unit of its own in ``chars``.
CLASS_CHANGES = {"chars": "", "words": " \t\n\v\f\r", "lines": "\n"}


def checked(sentinels: Sequence[str]) -> tuple[str, str, str]:
    """Three sentinels that can't overlap one another, so that no other is read where an output's parts meet."""
    if len(sentinels) != 3 or len(set(sentinels)) != 3 or not all(sentinels):
        raise ValueError("three different sentinels that aren't empty")
    for a in sentinels:
        for b in sentinels:
            if (a != b and a in b) or any(b.startswith(a[k:]) for k in range(1, len(a))):
                raise ValueError(f"sentinels {a!r} and {b!r} can overlap")
    return tuple(sentinels)


@lru_cache(maxsize=8)
def automaton(sentinels: tuple[str, str, str], changes: str):
    """Events by kind: 0 a class change, 1 to 3 the sentinels."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for c in changes:
        a.add_word(c, 0)
    for k, s in enumerate(sentinels, 1):
        a.add_word(s, k)
    a.make_automaton()
    return a


class Events:
    """A text's events and the ranks of its units."""

    def __init__(self, text: str, sentinels: tuple[str, str, str], changes: str):
        code = np.fromiter((end << 2 | kind for end, kind in automaton(sentinels, changes).iter(text)), np.int64)
        self.size = len(text)
        self.changes = code[(code & 3) == 0] >> 2
        self.sentinels = [(int(c) >> 2, int(c) & 3) for c in code[(code & 3) > 0]]
        # gap k lies between change k - 1 and change k
        self.begin = np.concatenate([[0], self.changes + 1])
        self.stop = np.concatenate([self.changes, [self.size]])

    def _before(self, units: str) -> np.ndarray:
        """Running counts: units that begin before each gap, and the total."""
        gap = self.stop - self.begin
        if units == "chars":
            n = np.concatenate([gap[:-1] + 1, gap[-1:]])  # the change is a character as well
        elif units == "words":
            n = (gap > 0).astype(np.int64)
        else:
            n = np.ones(len(gap), np.int64)
            n[-1] = gap[-1] > 0
        return np.concatenate([[0], np.cumsum(n)])

    def count(self, units: str) -> int:
        return int(self._before(units)[-1])

    def begun(self, units: str, offsets: Sequence[int]) -> list[int]:
        """How many units begin before each offset."""
        before, at = self._before(units), np.asarray(offsets, np.int64)
        k = np.searchsorted(self.begin, at, side="right") - 1
        inside = at - self.begin[k]
        whole = before[k + 1] - before[k]
        return (before[k] + np.minimum(inside, whole if units != "chars" else inside)).tolist()

    def offsets(self, units: str, ranks: Sequence[int]) -> list[int]:
        """Where the units of these ranks begin; the end of the text for the rank after the last."""
        before, at = self._before(units), np.asarray(ranks, np.int64)
        k = np.minimum(np.searchsorted(before, at, side="right") - 1, len(self.begin) - 1)
        found = self.begin[k] + (at - before[k])
        return np.where(at >= before[-1], self.size, found).tolist()


def draws(doc_id: int | None, seed: str) -> list[int]:
    """Four numbers below 2**32 from the hash of seed and id."""
    h = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]


_FORMS = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("n_words", pa.int64()), ("prefix_words", pa.int64()), ("middle_words", pa.int64()), ("output", pa.large_string())]
)
_FORMS_SQL = "doc_id long, n long, form string, prefix_chars long, middle_chars long, n_words long, prefix_words long, middle_words long, output string"


def _transform(units: str, sentinels: tuple[str, str, str], seed: str, rate: int, spm: int):
    changes = "".join(dict.fromkeys(CLASS_CHANGES[units] + CLASS_CHANGES["words"]))
    p, s, m = sentinels

    def form(doc_id: int | None, text: str) -> tuple:
        e = Events(text, sentinels, changes) if units != "lines" else Events(text, sentinels, CLASS_CHANGES[units])
        words = e if units != "lines" else Events(text, sentinels, CLASS_CHANGES["words"])
        n, n_words = e.count(units), words.count("words")
        h1, h2, h3, h4 = draws(doc_id, seed)
        if not text or e.sentinels or h3 % 100 >= rate:
            return doc_id, n, "plain", None, None, n_words, None, None, text
        a, b = e.offsets(units, sorted((h1 % (n + 1), h2 % (n + 1))))
        w_a, w_b = words.begun("words", (a, b))
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if h4 % 100 < spm:
            return doc_id, n, "spm", a, b - a, n_words, w_a, w_b - w_a, f"{s}{suffix}{p}{prefix}{m}{middle}"
        return doc_id, n, "psm", a, b - a, n_words, w_a, w_b - w_a, f"{p}{prefix}{s}{suffix}{m}{middle}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks([batch]):
                rows = [form(d, t or "") for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FORMS, strict=True)], schema=_FORMS)

    return run


def fill_in_middle(docs: DataFrame, units: str = "chars", sentinels: Sequence[str] = SENTINELS, seed: str = "1", rate: int = RATE, spm: int = SPM) -> DataFrame:
    """A row for each of ``docs`` (doc_id, text): n units, the form, the sizes of prefix and middle (characters, and the
    words that begin there; null if plain), and the ``output`` text."""
    if units not in CLASS_CHANGES:
        raise ValueError(f"units are one of {sorted(CLASS_CHANGES)}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_transform(units, checked(sentinels), seed, rate, spm), _FORMS_SQL)


def restored_text(output: str, form: str, sentinels: tuple[str, str, str]) -> str:
    """The text behind an output: its parts lie between the three sentinels that the scan finds."""
    if form == "plain":
        return output
    order = (1, 2, 3) if form == "psm" else (2, 1, 3)
    found = Events(output, sentinels, "").sentinels
    if tuple(k for _, k in found) != order:
        raise ValueError(f"not an output of form {form}")
    ends = [end + 1 for end, _ in found]
    starts = [end + 1 - len(sentinels[k - 1]) for end, k in found]
    parts = {order[0]: output[ends[0] : starts[1]], order[1]: output[ends[1] : starts[2]], order[2]: output[ends[2] :]}
    return parts[1] + parts[3] + parts[2]


def restore(forms: DataFrame, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """``forms`` with the column ``restored``, made from ``output`` and ``form`` alone."""
    marks = checked(sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks([batch], "output"):
                texts = [restored_text(o, f, marks) for o, f in zip(b.column("output").to_pylist(), b.column("form").to_pylist(), strict=True)]
                yield b.append_column("restored", pa.array(texts, pa.large_string() if pa.types.is_large_string(b.column("output").type) else pa.string()))

    return forms.mapInArrow(run, StructType([*forms.schema.fields, StructField("restored", StringType())]))


def fim_table(docs: DataFrame) -> DataFrame:
    """The forms over code points, with digests of the outputs and of the texts restored from them in their place."""
    out = restore(fill_in_middle(docs))
    digests = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests, "n_words", "prefix_words", "middle_words")


#: DuckDB SQL for ``fim_table``.
FIM_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
h AS (SELECT doc_id, t, n, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b, ('0x' || h[17:24])::BIGINT % 100 AS r, ('0x' || h[25:32])::BIGINT % 100 AS s FROM d),
c AS (SELECT doc_id, t, n, least(a, b) AS a, greatest(a, b) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r >= 90 THEN 'plain' WHEN s < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
w AS (SELECT *, t[1:a] AS prefix, t[a + 1:b] AS middle, t[b + 1:] AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS n_words,
  CASE WHEN form <> 'plain' THEN len(regexp_extract_all(prefix, '[^\x20\x09-\x0D]+'))::BIGINT END AS prefix_words,
  CASE WHEN form <> 'plain' THEN (len(regexp_extract_all(prefix || middle, '[^\x20\x09-\x0D]+')) - len(regexp_extract_all(prefix, '[^\x20\x09-\x0D]+')))::BIGINT END AS middle_words
FROM w
"""
