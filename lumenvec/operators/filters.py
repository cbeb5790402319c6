"""The filter query: an ordered list of conditions and groups, compiled to one predicate.

Rows hold labels as ``array<string>`` (null elements are missing labels, a null or empty array is a missing row) and
numbers as plain columns, so comparisons on numbers still reach the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenvec.functions.missing import NA

ANY = "__ANY__"
OPERATORS = {"gt": (True, False), "gte": (True, False), "lt": (False, True), "lte": (False, True), "between": (True, True)}


@dataclass(frozen=True)
class Categorical:
    """Any label of the row is among ``values``, which may hold the sentinels NA and ANY. Without values it constrains nothing."""

    annotation: str
    values: tuple[str, ...] = ()
    op: str | None = None
    id: str = ""

    @property
    def ready(self) -> bool:
        return bool(self.values)


@dataclass(frozen=True)
class Numeric:
    """A comparison, united with the sentinels in ``presence``."""

    annotation: str
    operator: str = "gte"
    min: float | None = None
    max: float | None = None
    presence: tuple[str, ...] = ()
    op: str | None = None
    id: str = ""

    @property
    def bounded(self) -> bool:
        low, high = OPERATORS[self.operator]
        return (not low or self.min is not None) and (not high or self.max is not None)

    @property
    def ready(self) -> bool:
        return self.bounded or bool(self.presence)


@dataclass(frozen=True)
class Group:
    items: tuple[Item, ...] = ()
    op: str | None = None
    id: str = ""

    @property
    def ready(self) -> bool:
        return has_configured(self.items)


Item = Categorical | Numeric | Group


@dataclass(frozen=True)
class Columns:
    """Which columns are categorical (label arrays) and which numeric."""

    categorical: frozenset[str] = frozenset()
    numeric: frozenset[str] = frozenset()


def has_configured(items: Sequence[Item]) -> bool:
    return any(i.ready for i in items)


def _labels(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def _real(c: str) -> Column:
    """At least one label that is not missing."""
    return F.exists(_labels(c), lambda x: x.isNotNull() & (x != NA))


def _lacks(c: str) -> Column:
    """A missing label among the row's, or no label at all."""
    return (F.size(_labels(c)) == 0) | F.exists(_labels(c), lambda x: x.isNull() | (x == NA))


def _condition(item: Categorical | Numeric, columns: Columns) -> Column:
    if not item.ready:
        return F.lit(True)
    if isinstance(item, Categorical):
        if item.annotation not in columns.categorical:
            return F.lit(False)
        named = [v for v in item.values if v not in (NA, ANY)]
        tests = [F.arrays_overlap(F.filter(_labels(item.annotation), lambda x: x.isNotNull()), F.array(*map(F.lit, named)))] if named else []
        tests += [_lacks(item.annotation)] if NA in item.values else []
        tests += [_real(item.annotation)] if ANY in item.values else []
    else:
        if item.annotation not in columns.numeric:
            return F.lit(False)
        c, tests = F.col(item.annotation), []
        if item.bounded:
            low, high = F.lit(item.min), F.lit(item.max)
            compared = {"gt": c > low, "gte": c >= low, "lt": c < high, "lte": c <= high, "between": (c >= low) & (c <= high)}
            tests.append(compared[item.operator])
        tests += [c.isNull()] if NA in item.presence else []
        tests += [c.isNotNull()] if ANY in item.presence else []
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return F.coalesce(out, F.lit(False))


def _annotations(item: Item) -> set[str]:
    return set().union(*map(_annotations, item.items)) if isinstance(item, Group) and item.items else set() if isinstance(item, Group) else {item.annotation}


def compile_query(items: Sequence[Item], columns: Columns) -> Column:
    """The predicate: a fold from the left without precedence. NOT means: a value in at least one annotation of the item, and no match; it is always intersected."""
    total = None
    for item in items:
        test = compile_query(item.items, columns) if isinstance(item, Group) else _condition(item, columns)
        if item.op == "NOT":
            present = F.lit(False)
            for a in sorted(_annotations(item)):
                present = present | (F.col(a).isNotNull() if a in columns.numeric else _real(a) if a in columns.categorical else F.lit(False))
            test = present & ~test
        total = test if total is None else total | test if item.op == "OR" else total & test
    return F.lit(True) if total is None else total


def excluding(items: Sequence[Item], id: str) -> tuple[Item, ...]:
    """The query without a condition; groups that this empties vanish."""
    out: list[Item] = []
    for i in items:
        if isinstance(i, Group):
            left = tuple(c for c in i.items if c.id != id)
            out += [replace(i, items=left)] if left else []
        elif i.id != id:
            out.append(i)
    return tuple(out)


def apply_gate(df: DataFrame, items: Sequence[Item], columns: Columns) -> DataFrame | None:
    """The filtered rows, or None where the query clears the filter: nothing configured, nothing matched or everything matched."""
    if not has_configured(items):
        return None
    hit = compile_query(items, columns)
    n, total = df.agg(F.count_if(hit), F.count(F.lit(1))).first()
    return df.filter(hit) if 0 < n < total else None


def conditions_for(items: Sequence[Item], annotation: str) -> list[Numeric]:
    out: list[Numeric] = []
    for i in items:
        if isinstance(i, Group):
            out += conditions_for(i.items, annotation)
        elif isinstance(i, Numeric) and i.annotation == annotation:
            out.append(i)
    return out


def _without_leading_op(items: list[Item]) -> list[Item]:
    return [replace(items[0], op=None), *items[1:]] if items and items[0].op in ("AND", "OR") else items


def replace_conditions(items: Sequence[Item], annotation: str, new: Numeric | None) -> tuple[Item, ...]:
    """All numeric conditions of an annotation replaced by one, at the first one's place with its AND or OR (a NOT is dropped); emptied groups and a leading operator go."""
    placed = False

    def walk(level: Sequence[Item]) -> list[Item]:
        nonlocal placed
        out: list[Item] = []
        for i in level:
            if isinstance(i, Group):
                left = walk(i.items)
                out += [replace(i, items=tuple(left))] if left else []
            elif isinstance(i, Numeric) and i.annotation == annotation:
                if new is not None and not placed:
                    placed = True
                    out.append(replace(new, op=None if i.op == "NOT" else i.op))
            else:
                out.append(i)
        return _without_leading_op(out)

    out = walk(items)
    if new is not None and not placed:
        out.append(replace(new, op="AND" if out else None))
    return tuple(out)


def reliability_conditions(annotation: str, low: float, high: float, id: str = "reliability") -> list[Numeric]:
    """A reliability range over (0, 1) as a condition that keeps curated rows (no reliability) in; the whole range needs none."""
    if low <= 0 and high >= 1:
        return []
    if high >= 1:
        return [Numeric(annotation, "gte", min=low, presence=(NA,), id=id)]
    if low <= 0:
        return [Numeric(annotation, "lte", max=high, presence=(NA,), id=id)]
    return [Numeric(annotation, "between", low, high, (NA,), id=id)]


def reliability_range(conditions: Sequence[Numeric]) -> tuple[float, float]:
    """The range that conditions express; negated comparisons are read mirrored."""
    low, high = 0.0, 1.0
    for c in conditions:
        negated = c.op == "NOT"
        if c.operator in ("gt", "gte", "between") and c.min is not None:
            low, high = (low, min(high, c.min)) if negated and c.operator != "between" else (max(low, c.min), high)
        if c.operator in ("lt", "lte", "between") and c.max is not None:
            low, high = (max(low, c.max), high) if negated and c.operator != "between" else (low, min(high, c.max))
    return low, high


def value_counts(df: DataFrame, labels: str) -> DataFrame:
    """(value, n): rows by distinct label; a missing label, or none, counts under NA."""
    each = F.array_distinct(F.when(F.size(_labels(labels)) == 0, F.array(F.lit(NA))).otherwise(F.transform(_labels(labels), lambda x: F.coalesce(x, F.lit(NA)))))
    return df.select(F.explode(each).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def picker_counts(df: DataFrame, labels: str, scope: Column, op: str | None) -> DataFrame:
    """(value, n): how many rows choosing a value leaves, given the rows that the other conditions leave (``scope``).

    AND: rows in scope with the value. OR: scope, and rows outside with it. NOT: rows in scope with any value but not
    this one; for NA those rows with a real label that also carry a missing one are taken off.
    """
    each = F.array_distinct(F.when(F.size(_labels(labels)) == 0, F.array(F.lit(NA))).otherwise(F.transform(_labels(labels), lambda x: F.coalesce(x, F.lit(NA)))))
    rows = df.select(F.coalesce(scope, F.lit(False)).alias("s"), _real(labels).alias("real"), (_real(labels) & _lacks(labels)).alias("mixed"), each.alias("vs"))
    totals = rows.agg(F.count_if("s").alias("scope_n"), F.count_if(F.col("s") & F.col("real")).alias("any_n"), F.count_if(F.col("s") & F.col("mixed")).alias("mixed_n"))
    counts = rows.select("s", F.explode("vs").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("full"), F.count_if("s").alias("inside"))
    both = counts.crossJoin(F.broadcast(totals))  # totals is one row
    if op == "OR":
        n = F.col("scope_n") + F.col("full") - F.col("inside")
    elif op == "NOT":
        n = F.col("any_n") - F.when(F.col("value") == NA, F.col("mixed_n")).otherwise(F.col("inside"))
    else:
        n = F.col("inside")
    return both.select("value", n.alias("n"))


def numeric_matches(df: DataFrame, condition: Numeric, columns: Columns) -> Column:
    """The number of rows that a condition matches by itself; 0 if it isn't configured or its column is absent."""
    return F.count_if(_condition(condition, columns)) if condition.ready and condition.annotation in columns.numeric else F.lit(0).cast("long")
