"""Annotation cells: labels separated by semicolons, each with scores or evidence behind a pipe, fields percent-encoded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenvec.functions.missing import normalize_missing, web_missing, ws_trim

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
EVIDENCE = r"^([A-Z]{2,5}|ECO:\d+)$"
#: Code points that a field encodes: percent first, so that nothing is encoded twice.
RESERVED = (0x25, 0x3B, 0x7C, *range(0x20), 0x7F)


def parse_number(c: Column) -> Column:
    """The number a cell spells out in full, decimal or with a base prefix (0x, 0o, 0b); null for any other cell."""
    t = ws_trim(c)
    base = lambda digits, prefix, radix: F.when(t.rlike(f"^0[{prefix}][{digits}]+$"), F.conv(F.substring(t, 3, 64), radix, 10).cast("double"))
    decimal = F.when(t.rlike(NUMBER), t.try_cast("double"))
    value = F.coalesce(base("0-9a-fA-F", "xX", 16), base("0-7", "oO", 8), base("01", "bB", 2), decimal)
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(None)).otherwise(value)


def split_labels(c: Column) -> Column:
    """Labels of a cell of the current format: plain split, trimmed, missing parts dropped; null if none is left."""
    parts = F.filter(F.transform(F.split(c, ";"), ws_trim), lambda x: ~web_missing(x))
    return F.when(F.size(parts) > 0, parts)


def split_top_level(c: Column) -> Column:
    """Parts of a cell of the first format: semicolons inside parentheses don't separate, unless one stays open.

    One pass over the characters keeps (depth, parts, part so far); a closing parenthesis without an open one counts
    as text.
    """
    zero = F.struct(F.lit(0).alias("d"), F.array().cast("array<string>").alias("parts"), F.lit("").alias("now"))

    def step(a: Column, x: Column) -> Column:
        depth = a["d"] + F.when(x == "(", 1).when((x == ")") & (a["d"] > 0), -1).otherwise(0)
        cut = (x == ";") & (a["d"] == 0)
        return F.struct(depth.alias("d"), F.when(cut, F.concat(a["parts"], F.array(a["now"]))).otherwise(a["parts"]).alias("parts"), F.when(cut, F.lit("")).otherwise(F.concat(a["now"], x)).alias("now"))

    return F.aggregate(F.split(c, ""), zero, step, lambda a: F.when(a["d"] != 0, F.split(c, ";")).otherwise(F.concat(a["parts"], F.array(a["now"]))))


def parse_label(part: Column, decode: bool = False) -> Column:
    """struct(label, scores, evidence) of one part, cut at its last pipe.

    The suffix is evidence if it looks like a code, scores if all its comma parts are finite numbers (an empty one
    counts as 0); with any other suffix, or none behind the pipe, the whole part is the label.
    """
    whole = ws_trim(part)
    head, tail = F.regexp_extract(whole, r"(?s)^(.*)\|([^|]+)$", 1), ws_trim(F.regexp_extract(whole, r"(?s)^(.*)\|([^|]+)$", 2))
    piped = whole.rlike(r"(?s)^.*\|[^|]+$")
    numbers = F.transform(F.split(tail, ","), lambda x: F.when(ws_trim(x) == "", F.lit(0.0)).otherwise(parse_number(x)))
    evidence = piped & tail.rlike(EVIDENCE)
    scored = piped & ~evidence & F.forall(numbers, lambda x: x.isNotNull())
    label = F.when(evidence | scored, ws_trim(head)).otherwise(whole)
    return F.struct((decode_field(label) if decode else label).alias("label"), F.when(scored, numbers).otherwise(F.array().cast("array<double>")).alias("scores"), F.when(evidence, tail).alias("evidence"))


def encode_field(c: Column) -> Column:
    return reduce(lambda s, code: F.replace(s, F.lit(chr(code)), F.lit(f"%{code:02X}")), RESERVED, c)


def decode_field(c: Column) -> Column:
    """Each %XX becomes code point XX, in one pass from left to right; a plus sign stays."""
    pieces = F.split(c, "%", -1)

    def tail(x: Column) -> Column:
        return F.when(x.rlike("(?s)^[0-9A-Fa-f]{2}.*"), F.concat(F.char(F.conv(F.substring(x, 1, 2), 16, 10).cast("int")), F.substring(x, 3, 1 << 30))).otherwise(F.concat(F.lit("%"), x))

    return F.array_join(F.transform(pieces, lambda x, i: F.when(i == 0, x).otherwise(tail(x))), "")


def migrate_cell(c: Column) -> Column:
    """A cell of the first format in the current one: what stands before and behind each part's first pipe is encoded."""

    def part(p: Column) -> Column:
        label = F.split_part(p, F.lit("|"), F.lit(1))
        return F.when(p.contains("|"), F.concat(encode_field(label), F.lit("|"), encode_field(F.substring(p, F.length(label) + 2, F.length(p))))).otherwise(encode_field(p))

    return F.array_join(F.transform(split_top_level(c), part), ";")


def display_value(c: Column, decode: bool = True) -> Column:
    """Each part cut at its first pipe, decoded if asked for, joined again."""
    cut = lambda x: F.split_part(x, F.lit("|"), F.lit(1))
    return F.array_join(F.transform(F.split(c, ";"), lambda x: decode_field(cut(x)) if decode else cut(x)), ";")


def strip_scores(c: Column) -> Column:
    return display_value(c, decode=False)


def primary_label(labels: Column) -> Column:
    return F.get(labels, F.lit(0))


__all__ = ["decode_field", "display_value", "encode_field", "migrate_cell", "normalize_missing", "parse_label", "parse_number", "primary_label", "split_labels", "split_top_level", "strip_scores"]
