"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a named rejection test over metrics of a text. ``plan_cascade`` times each rule by itself on a sample, with
the metrics that are computed for every row anyway (``quality_table`` returns five) already in place, and counts what it
rejects of the rows that earlier rules leave; ``apply_cascade`` then tests in that order of rejections per cost, in one
CASE expression: Spark evaluates a later branch only for the texts that all earlier ones let pass, so cheap rules that
reject much spare the dear ones. The order never changes the verdict, only the time it takes.

Defined results: null text has no words and fails ``few_words``; so does an empty one. Very long texts are handled
whole: repeated windows are found by sorting their hashes within the row, not by comparing pairs. Repeated rows get the
same verdict each. Extra columns are kept by ``apply_cascade``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenvec.llm.common import WORD, spare_name, written

#: Words in a window whose repetition counts.
WINDOW = 8
SAMPLE_ROWS, TIMED = 2000, 3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text, unchanged; none for a null text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """How many words lie in windows of ``width`` words that occur twice or more.

    Windows are compared by a 64-bit hash of word hashes. A text without equal hashes, the usual case, ends after one
    pass; else (hash, place) is sorted and each place with an equal neighbour covers what the place before left.
    """
    window_hashes = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (width - 1)), lambda i: F.xxhash64(F.slice(h, i, width)))
    covered = lambda s: let(
        F.array_sort(F.transform(F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])), lambda x: x["i"])),
        lambda at: F.aggregate(F.transform(at, lambda p, k: F.when(k == 0, F.lit(width)).otherwise(F.least(F.lit(width), p - F.get(at, k - 1)))), F.lit(0), lambda a, x: a + x),
    )
    count = let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: let(
            window_hashes(h),
            lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered)),
        ),
    )
    return F.when(F.size(words) < width + 1, F.lit(0)).otherwise(count).cast("long")


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return let(lines, lambda v: (F.size(v) - F.size(F.array_distinct(v))).cast("long"))


#: Metrics by name, each from a text and its words.
METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, words: F.size(words).cast("long"),
    "word_chars": lambda text, words: F.length(F.array_join(words, "")).cast("long"),
    "n_symbols": lambda text, words: F.coalesce(F.regexp_count(text, F.lit("[#*$%&|<>]")), F.lit(0)).cast("long"),
    "n_dup_lines": lambda text, words: F.coalesce(_dup_lines(text), F.lit(0)).cast("long"),
    "n_lines": lambda text, words: F.coalesce(F.size(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))), F.lit(0)).cast("long"),
    "n_repeat_words": lambda text, words: repeated_words(words),
    "n_shouted": lambda text, words: F.coalesce(F.regexp_count(text, F.lit(r"(?<!\S)\p{Lu}{2,}[^\s\p{L}]*(?!\S)")), F.lit(0)).cast("long"),
    "n_marks": lambda text, words: F.coalesce(F.regexp_count(text, F.lit("[!?]")), F.lit(0)).cast("long"),
}


@dataclass(frozen=True)
class Rule:
    """``rejects`` is given a function from a metric's name to its column."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


#: Production thresholds. The first two are the base verdict.
RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda m: m("n_words") < 20),
    Rule("repeated_windows", lambda m: m("n_repeat_words") * 100 > m("n_words") * 30),
    Rule("symbols", lambda m: m("n_symbols") * 20 > m("word_chars")),
    Rule("word_length", lambda m: (m("word_chars") < m("n_words") * 2) | (m("word_chars") > m("n_words") * 20)),
    Rule("repeated_lines", lambda m: m("n_dup_lines") * 100 > m("n_lines") * 30),
    Rule("shouting", lambda m: m("n_shouted") * 2 > m("n_words")),
    Rule("exclamation", lambda m: m("n_marks") * 3 > m("n_words")),
)


def _metric(df: DataFrame, text: str, words: str) -> Callable[[str], Column]:
    """A metric's column: the one that ``df`` has by that name, else its expression."""
    return lambda name: F.col(name) if name in df.columns else METRICS[name](F.col(text), F.col(words))


def with_words(df: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    name = spare_name(df, "words")
    return df.withColumn(name, words_of(F.col(text))), name


def with_metrics(df: DataFrame, names: Sequence[str], text: str = "text") -> tuple[DataFrame, str]:
    """``df`` with its words (under the name returned) and the metrics that a caller wants of every row anyway."""
    df, words = with_words(df, text)
    return df.select("*", *[METRICS[m](F.col(text), F.col(words)).alias(m) for m in names]), words


def plan_cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS, text: str = "text", given: Sequence[str] = ()) -> list[tuple[Rule, float, float]]:
    """``rules`` in the order to test them, each with seconds a row and the share it rejects of what the rules before it leave.

    Measured on a sample of about ``sample_rows``. Metrics in ``given`` stand in the sample's table as they will in that
    of ``apply_cascade``, so a rule that reads only these costs next to nothing. Cost: the median of ``TIMED`` runs after
    one that compiles the rule, less that of a run that tests nothing. The order is made greedily: of the rules left, the
    one with most rejections per cost among the rows that no chosen rule rejects.
    """
    total = docs.count()
    if not total:
        return [(r, 0.0, 0.0) for r in rules]
    sample, words = with_metrics(docs.select(text).sample(min(1.0, 1.2 * sample_rows / total), seed=8), given, text)
    sample = written(sample, "quality_sample")
    n = max(1, sample.count())
    metric = _metric(sample, text, words)
    tests = [F.coalesce(r.rejects(metric), F.lit(False)) for r in rules]

    def seconds(test: Column) -> float:
        runs = []
        for _ in range(TIMED + 1):
            began = time.perf_counter()
            sample.select(F.count_if(test), F.max(F.length(text)), F.max(F.size(words))).collect()
            runs.append(time.perf_counter() - began)
        return median(runs[1:])

    nothing = seconds(F.col(text).isNull())
    cost = [max((seconds(t) - nothing) / n, 1e-9) for t in tests]
    # How often each combination of rules rejects: few rows, as rules are few.
    masks = sample.groupBy(sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0)).alias("mask")).count().collect()
    left, found = set(range(len(rules))), []
    while left:
        open_ = [(r["mask"], r["count"]) for r in masks if not any(r["mask"] >> i & 1 for i in range(len(rules)) if i not in left)]
        share = {i: sum(c for m, c in open_ if m >> i & 1) / max(1, sum(c for _, c in open_)) for i in left}
        best = max(sorted(left), key=lambda i: (share[i] / cost[i], -cost[i]))
        found.append((rules[best], cost[best], share[best]))
        left.remove(best)
    return found


def apply_cascade(df: DataFrame, ordered: Sequence[Rule], text: str = "text", words: str | None = None, verdict: str = "rejected_by") -> DataFrame:
    """``df`` with the name of the first rule that rejects a row, null where none does. Metrics that ``df`` has as columns are taken from there."""
    own = words is None
    if own:
        df, words = with_words(df, text)
    metric, case = _metric(df, text, words), None
    for r in ordered:
        test = F.coalesce(r.rejects(metric), F.lit(False))
        case = F.when(test, F.lit(r.name)) if case is None else case.when(test, F.lit(r.name))
    out = df.withColumn(verdict, case if case is not None else F.lit(None).cast("string"))
    return out.drop(words) if own else out


def quality_table(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, the base metrics, base_failed and kept, of every row."""
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    ordered = [r for r, _, _ in plan_cascade(docs, rules, given=base)]
    df, words = with_metrics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), base)
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    out = apply_cascade(df, ordered, "text", words)
    return out.select("doc_id", *base, failed.alias("base_failed"), (~failed & F.col("rejected_by").isNull()).alias("kept"))


#: The same in DuckDB's SQL.
QUALITY_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT rid, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 8),
win2 AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, list_slice(w, i, i + 7)) AS c FROM win),
cover AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM win2, range(8) r(k) WHERE c > 1 GROUP BY rid),
m AS (
  SELECT d.rid, doc_id, text, w, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         len(list_filter(w, lambda x: regexp_full_match(x, '\p{Lu}{2,}[^\s\p{L}]*')))::BIGINT AS n_shouted,
         len(regexp_extract_all(text, '[!?]'))::BIGINT AS n_marks,
         coalesce(cover.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cover ON d.rid = cover.rid),
v AS (
  SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 20 > word_chars OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR n_dup_lines * 100 > len(lines) * 30 OR n_shouted * 2 > n_words OR n_marks * 3 > n_words) AS kept
FROM v
"""
