"""Saved settings of many bundles, checked member by member and brought to one shape, as Column expressions over VARIANT.

Two shapes are on disk: the current one, an object with ``legendSettings`` and ``exportOptions`` (by annotation) and a few optional
members, and an older one that is the legend settings alone. What is valid in the current shape is taken as such, else what is
valid as a whole in the older one; anything else that is an object keeps its valid members and loses the others one by one.

Defined results: null, text that is no JSON, and JSON that is no object have no settings (null); a member that is JSON null is there, and
so has the wrong type where another is asked for; unknown members are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
SORT_MODES = ("size-asc", "size-desc", "alpha-asc", "alpha-desc", "manual", "manual-reverse", "silhouette-desc", "silhouette-asc")
STRATEGIES = ("linear", "quantile", "logarithmic")
DEFAULT_PALETTE = "kellys"

_NUMBER = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*)$"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _kind(v: Column, path: str) -> Column:
    """The kind of what stands at a path; null where nothing does."""
    return F.schema_of_variant(_at(v, path))


def _is(v: Column, path: str, what: str, optional: bool = False) -> Column:
    kind = _kind(v, path)
    found = {"number": kind.rlike(_NUMBER), "text": kind == "STRING", "flag": kind == "BOOLEAN", "object": kind.startswith("OBJECT"), "list": kind.startswith("ARRAY")}[what]
    return F.coalesce(found, F.lit(optional))


def _members(v: Column, path: str) -> Column:
    """The members of an object by name; null for anything else."""
    return F.when(_is(v, path, "object"), F.try_variant_get(v, path, "map<string,variant>"))


def _all_texts(v: Column, path: str, optional: bool = False) -> Column:
    texts = F.forall(F.try_variant_get(v, path, "array<variant>"), lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False)))
    return F.when(_kind(v, path).isNull(), F.lit(optional)).otherwise(_is(v, path, "list") & F.coalesce(texts, F.lit(False)))


def _one_of(v: Column, path: str, values: tuple[str, ...]) -> Column:
    return _is(v, path, "text") & F.coalesce(F.try_variant_get(v, path, "string").isin(*values), F.lit(False))


def category_ok(v: Column) -> Column:
    return _is(v, "$.zOrder", "number") & _is(v, "$.color", "text") & _is(v, "$.shape", "text")


def binning_ok(v: Column, path: str = "$") -> Column:
    at = lambda name: f"{path}.{name}"
    return _is(v, path, "object") & _is(v, at("signature"), "text") & _is(v, at("topologySignature"), "text", True) & _is(v, at("reverseGradient"), "flag", True) & _all_texts(v, at("manualOrderIds"), True) & _one_of(v, at("strategy"), STRATEGIES)


def legend_core_ok(v: Column) -> Column:
    """Whether a legend's settings can be kept, if need be without those of its bins."""
    categories = F.coalesce(F.forall(F.map_values(_members(v, "$.categories")), category_ok), F.lit(False))
    plain = _is(v, "$.maxVisibleValues", "number") & _is(v, "$.includeShapes", "flag", True) & _is(v, "$.shapeSize", "number") & _one_of(v, "$.sortMode", SORT_MODES) & _is(v, "$.enableDuplicateStackUI", "flag")
    return _is(v, "$", "object") & plain & _all_texts(v, "$.hiddenValues") & categories


def legend_ok(v: Column) -> Column:
    return legend_core_ok(v) & (_kind(v, "$.numericSettings").isNull() | binning_ok(v, "$.numericSettings"))


def export_ok(v: Column) -> Column:
    numbers, flags = ("imageWidth", "imageHeight", "legendWidthPercent", "legendFontSizePx"), ("lockAspectRatio", "includeLegendSettings", "includeExportOptions")
    out = _is(v, "$", "object")
    for name in numbers:
        out = out & _is(v, f"$.{name}", "number")
    for name in flags:
        out = out & _is(v, f"$.{name}", "flag")
    return out


def _legend(v: Column) -> Column:
    """A legend's settings with the members that are known, as JSON; absent ones are left out."""
    keep = lambda path, *names: [_at(v, f"{path}.{n}").alias(n) for n in names]
    palette = F.when(_is(v, "$.selectedPaletteId", "text"), F.try_variant_get(v, "$.selectedPaletteId", "string")).otherwise(F.lit(DEFAULT_PALETTE))
    bins = F.when(binning_ok(v, "$.numericSettings"), F.struct(*keep("$.numericSettings", "strategy", "signature", "topologySignature", "reverseGradient", "manualOrderIds")))
    return F.to_json(F.struct(*keep("$", "maxVisibleValues", "shapeSize", "sortMode", "hiddenValues", "categories", "enableDuplicateStackUI"), palette.alias("selectedPaletteId"), bins.alias("numericSettings")))


def _threshold_ok(v: Column) -> Column:
    return _is(v, "$.eatConfidenceThreshold", "number") & F.coalesce(F.try_variant_get(v, "$.eatConfidenceThreshold", "double").between(0, 1), F.lit(False))


def normalized(text: Column) -> Column:
    """struct(shape, legend, export, publish, overlay, threshold): ``shape`` is current, legacy or repaired; ``legend`` and ``export`` map
    an annotation to its settings as JSON; ``publish`` is JSON."""
    return _let(F.try_parse_json(text), lambda v: _let(_shape(v), lambda shape: _normalized(v, shape)))


def _shape(v: Column) -> Column:
    every = lambda members, test: F.coalesce(F.forall(F.map_values(members), test), F.lit(False))
    absent = lambda path: _kind(v, path).isNull()
    current = (
        _is(v, "$", "object") & _is(v, "$.publishState", "object", True) & _is(v, "$.eatOverlayEnabled", "flag", True) & (absent("$.eatConfidenceThreshold") | _threshold_ok(v))
        & every(_members(v, "$.legendSettings"), legend_ok) & every(_members(v, "$.exportOptions"), export_ok)
    )
    return F.when(current, "current").when(every(_members(v, "$"), legend_ok), "legacy").when(_is(v, "$", "object"), "repaired")


def _normalized(v: Column, shape: Column) -> Column:
    none = F.create_map().cast("map<string,string>")
    legacy = shape == "legacy"
    legends = F.when(legacy, _members(v, "$")).otherwise(F.coalesce(_members(v, "$.legendSettings"), _members(v, "$")))
    legend = F.transform_values(F.map_filter(legends, lambda _, x: legend_core_ok(x)), lambda _, x: _legend(x))
    export = F.transform_values(F.map_filter(_members(v, "$.exportOptions"), lambda _, x: export_ok(x)), lambda _, x: F.to_json(x))
    own = lambda path, what, value: F.when(~legacy & _is(v, path, what), value)
    return F.when(
        shape.isNotNull(),
        F.struct(
            shape.alias("shape"), legend.alias("legend"), F.when(legacy, none).otherwise(F.coalesce(export, none)).alias("export"),
            own("$.publishState", "object", F.to_json(_at(v, "$.publishState"))).alias("publish"),
            own("$.eatOverlayEnabled", "flag", F.try_variant_get(v, "$.eatOverlayEnabled", "boolean")).alias("overlay"),
            F.when(~legacy & _threshold_ok(v), F.try_variant_get(v, "$.eatConfidenceThreshold", "double")).alias("threshold"),
        ),
    )
