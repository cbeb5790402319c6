"""Numeric binning: edges by three strategies, assignment, labels and colour positions.

One aggregate gives the summary and, for quantiles, the edges; they come to the driver (at most the number of bins),
and assignment is a CASE over literal edges, so rows are read once and never joined.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Context, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenvec.functions.missing import NA, finite_or_null
from lumenvec.operators import ranks

STRATEGIES = ("linear", "quantile", "logarithmic")
DEFAULT_STRATEGY, DEFAULT_BINS = "quantile", 10
#: Fixed value: the version that signatures name.
ALGORITHM = "numeric-gradient-v2"


@dataclass(frozen=True)
class Summary:
    rows: int
    count: int
    min: float | None
    max: float | None
    distinct: int
    all_integers: bool
    all_positive: bool


@dataclass(frozen=True)
class Settings:
    strategy: str = DEFAULT_STRATEGY
    bins: int = DEFAULT_BINS
    palette: str = "cividis"
    reverse: bool = False


def resolve_settings(persisted: dict | None = None, live: dict | None = None, bins: int = DEFAULT_BINS) -> Settings:
    """Saved settings before current ones before defaults; an unknown strategy resets all."""
    for source in (persisted, live):
        if source:
            if source.get("strategy") not in STRATEGIES:
                return Settings(bins=bins)
            return Settings(source["strategy"], int(source.get("bins", bins)))
    return Settings(bins=bins)


def summary_columns(c: Column) -> list[Column]:
    v = finite_or_null(c)
    return [
        F.count(F.lit(1)).alias("rows"), F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.countDistinct(v).alias("distinct"),
        F.coalesce(F.bool_and(v == F.floor(v)), F.lit(True)).alias("all_integers"), F.coalesce(F.bool_and(v > 0), F.lit(False)).alias("all_positive"),
    ]


def summarize(df: DataFrame, column: str) -> Summary:
    return Summary(*df.agg(*summary_columns(F.col(column).cast("double"))).first())


def effective_strategy(strategy: str, s: Summary, bins: int) -> str:
    """Logarithms need positive values, else quantiles; quantiles need more distinct values than bins, else lines."""
    if strategy == "logarithmic" and not s.all_positive:
        strategy = DEFAULT_STRATEGY
    return "linear" if strategy == "quantile" and s.distinct <= bins else strategy


def linear_edges(low: float, high: float, bins: int) -> list[float]:
    return [high if i == bins else low + (high - low) / bins * i for i in range(bins + 1)]


def log_edges(low: float, high: float, bins: int) -> list[float]:
    step = (math.log10(high) - math.log10(low)) / bins
    return [low, *[10 ** (math.log10(low) + step * i) for i in range(1, bins)], high]


def quantile_edges(df: DataFrame, column: str, bins: int) -> list[float]:
    """Exact quantiles with linear interpolation, from ranks of a range-sorted table of distinct values."""
    values = df.select(finite_or_null(F.col(column).cast("double")).alias("v"))
    return ranks.quantiles(values, "v", [i / bins for i in range(bins + 1)])


def distinct_edges(edges: Sequence[float]) -> list[float]:
    out: list[float] = []
    for e in edges:
        if not out or abs(e - out[-1]) > 2.220446049250313e-16 * max(1.0, abs(e), abs(out[-1])):
            out.append(e)
    return out


def edges_for(df: DataFrame, column: str, settings: Settings, s: Summary) -> tuple[list[float], str]:
    """Edges and the strategy that made them. One bin is kept for missing values where there are any."""
    bins = settings.bins - 1 if s.count < s.rows and settings.bins > 1 else settings.bins
    strategy = effective_strategy(settings.strategy, s, bins)
    if not s.count:
        return [], strategy
    n = max(1, min(bins, s.distinct))
    raw = linear_edges(s.min, s.max, n) if strategy == "linear" else log_edges(s.min, s.max, n) if strategy == "logarithmic" else quantile_edges(df, column, n)
    edges = distinct_edges(raw)
    return (edges if len(edges) >= 2 else [s.min, s.max]), strategy


def assign(c: Column, edges: Sequence[float]) -> Column:
    """Number of the half-open bin (the last one is closed and takes what lies outside); null for no finite number."""
    v, last = finite_or_null(c), len(edges) - 2
    case = None
    for i in range(last):
        test = (v >= F.lit(edges[i])) & (v < F.lit(edges[i + 1]))
        case = F.when(test, F.lit(i)) if case is None else case.when(test, F.lit(i))
    return F.when(v.isNotNull(), F.lit(last) if case is None else case.otherwise(F.lit(last)))


@dataclass(frozen=True)
class Bin:
    id: str
    label: str
    lower: float
    upper: float
    count: int
    position: float


def format_number(x: float, integer: bool, digits: int = 6) -> str:
    """Whole numbers plainly; others with thousands grouped and one to ``digits`` decimals, or six significant digits below 0.001."""
    if not math.isfinite(x):
        return "NaN" if math.isnan(x) else "Infinity" if x > 0 else "-Infinity"
    if integer:
        return str(math.trunc(x))
    if 0 < abs(x) < 0.001:
        return _shortest(float(f"{x:.6g}"))
    whole, _, part = f"{Decimal(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP, Context(prec=400)):,f}".partition(".")
    return f"{whole}.{part.rstrip('0') or '0'}"


def _shortest(x: float) -> str:
    """The shortest digits that give the number back, plain down to a millionth."""
    digits = repr(x)
    if "e" not in digits:
        return digits
    power = int(digits.partition("e")[2])
    return f"{Decimal(digits):f}" if power >= -7 + 1 else f"{digits.partition('e')[0]}e{power}"


def serialize_number(x: float) -> str:
    """Whole numbers plainly, others with 17 significant digits, so that different bounds never look alike."""
    if not math.isfinite(x):
        return format_number(x, False)
    if float(x).is_integer():
        return str(int(x))
    power = int(f"{x:.16e}".partition("e")[2])
    if -7 < power < 17:
        return f"{Decimal(x):.{16 - power}f}"
    return f"{f'{x:.16e}'.partition('e')[0]}e{'+' if power > 0 else ''}{power}"


def _range_label(a: float, b: float, f: Callable[[float], str]) -> str:
    return f(a) if a == b else f"{f(a)} - {f(b)}"


def observed_labels(ranges: Sequence[tuple[float, float]], integer: bool, bounds: Sequence[tuple[float, float]] = ()) -> list[str]:
    """Labels of observed ranges, with more digits until they differ; then the bins' exact bounds, at last with numbers."""
    for digits in (6, 8, 10, 12, 14, 16):
        out = [_range_label(a, b, lambda x: format_number(x, integer, digits)) for a, b in ranges]  # noqa: B023
        if len(set(out)) == len(out):
            return out
    out = [_range_label(a, b, serialize_number) for a, b in bounds or ranges]
    return out if len(set(out)) == len(out) else [f"{x} ({i + 1})" for i, x in enumerate(out)]


def bin_id(strategy: str, lower: float, upper: float) -> str:
    return f"num:{strategy}:{serialize_number(lower)}:{serialize_number(upper)}"


def _hash32(text: str) -> str:
    """Each character, by exclusive or, after 33 times what came before; 32 bits in hexadecimal."""
    h = 5381
    for unit in memoryview(text.encode("utf-16-le")).cast("H"):
        h = (h * 33 & 0xFFFFFFFF) ^ unit
    return f"{h:08x}"


def signature(settings: Settings, bins: Sequence[Bin]) -> str:
    """A hash of all that a binned column's colours hang on."""
    each = ["|".join([b.id, serialize_number(b.lower), serialize_number(b.upper), str(b.count), serialize_number(b.position)]) for b in bins]
    return _hash32("::".join([ALGORITHM, settings.strategy, str(settings.bins), settings.palette, "reversed" if settings.reverse else "forward", *each]))


def topology(strategy: str, bins: Sequence[Bin]) -> str:
    """A hash of the bins' bounds alone."""
    return _hash32("::".join([strategy, *["|".join([b.id, serialize_number(b.lower), serialize_number(b.upper)]) for b in bins]]))


def color_positions(strategy: str, bins: Sequence[tuple[float, float, int]], low: float, high: float) -> list[float]:
    """From 0 to 1: middle of the bin, geometric middle, or middle of its share of rows; the ends are 0 and 1."""
    if len(bins) <= 1:
        return [0.5] * len(bins)
    clamp = lambda x: min(1.0, max(0.0, x))
    if strategy == "quantile":
        total, at, out = sum(b[2] for b in bins), 0, []
        for b in bins:
            out.append(clamp((at + at + b[2]) / 2 / total))
            at += b[2]
    elif strategy == "logarithmic" and low > 0 and low != high:
        out = [clamp((math.log10(math.sqrt(a * b)) - math.log10(low)) / (math.log10(high) - math.log10(low))) for a, b, _ in bins]
    else:
        out = [0.5 if low == high else clamp(((a + b) / 2 - low) / (high - low)) for a, b, _ in bins]
    return [0.0, *out[1:-1], 1.0]


def materialize(df: DataFrame, column: str, settings: Settings = Settings()) -> tuple[DataFrame, list[Bin], str]:
    """``df`` with bin_idx, the bins that hold rows (renumbered), and the strategy used.

    Missing values get the number after the last bin; a column without values has no bins and only that number.
    """
    s = summarize(df, column)
    edges, strategy = edges_for(df, column, settings, s)
    if not edges:
        return df.withColumn("bin_idx", F.lit(0)), [], strategy
    raw = assign(F.col(column).cast("double"), edges)
    held = df.select(raw.alias("b"), F.col(column).cast("double").alias("v")).filter("b is not null").groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect()
    positions = color_positions(strategy, [(edges[r["b"]], edges[r["b"] + 1], r["n"]) for r in held], s.min, s.max)
    labels = observed_labels([(r["lo"], r["hi"]) for r in held], s.all_integers, [(edges[r["b"]], edges[r["b"] + 1]) for r in held])
    bins = [Bin(bin_id(strategy, edges[r["b"]], edges[r["b"] + 1]), label, edges[r["b"]], edges[r["b"] + 1], r["n"], p) for r, label, p in zip(held, labels, positions, strict=True)]
    number = F.lit(len(held))
    for i, r in enumerate(held):
        number = F.when(raw == r["b"], F.lit(i)).otherwise(number)
    return df.withColumn("bin_idx", number), bins, strategy


def materialize_selected(df: DataFrame, numeric: Sequence[str], selected: str | None, requested: Sequence[str] = (), settings: dict[str, Settings] | None = None) -> DataFrame:
    """Bins only the selected column and those asked for, each as COLUMN__bin; all others stay as they are."""
    for c in numeric:
        if c == selected or c in requested:
            df = materialize(df, c, (settings or {}).get(c, Settings()))[0].withColumnRenamed("bin_idx", f"{c}__bin")
    return df


def ordered_ids(bins: Sequence[Bin], mode: str = "size-asc", manual: Sequence[str] = (), has_missing: bool = False) -> list[str]:
    """Ids by lower bound; in manual mode known ids in the given order first; missing values last."""
    canonical = [b.id for b in sorted(bins, key=lambda b: b.lower)]
    first = [i for i in manual if i in canonical] if mode.startswith("manual") else []
    return [*first, *[i for i in canonical if i not in first], *([NA] if has_missing else [])]


def cumulative_positions(counts: DataFrame, order: str = "lower", n: str = "n") -> DataFrame:
    """``counts`` with ``position``: middle of the cumulative share, for bins that are themselves a table."""
    ends = counts.agg(F.sum(n).alias("_total"), F.count(F.lit(1)).alias("_bins"), F.min(order).alias("_first"), F.max(order).alias("_last"))  # one row
    at = ranks.before(counts, [F.col(order)], F.col(n), "_before").crossJoin(F.broadcast(ends))
    mid = (F.col("_before") + F.col(n) / 2) / F.col("_total")
    position = F.when(F.col("_bins") == 1, 0.5).when(F.col(order) == F.col("_first"), 0.0).when(F.col(order) == F.col("_last"), 1.0).otherwise(mid)
    return at.withColumn("position", position).drop("_before", "_total", "_bins", "_first", "_last")
