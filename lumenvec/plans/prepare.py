"""Whole jobs in one call: from sets of vectors to a bundle, and styles put into a bundle's settings."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenvec.functions.cells import display_value
from lumenvec.operators import checks, joins, reduce, report, transfer
from lumenvec.sources import bundle
from lumenvec.sources.shared import Tables

#: The settings of an annotation that has none, and the colour of missing values.
DEFAULTS = {"maxVisibleValues": 10, "shapeSize": 30, "sortMode": "size-desc", "hiddenValues": [], "enableDuplicateStackUI": False, "selectedPaletteId": "kellys"}
MISSING, GREY = ("<NA>", "NaN", ""), "#C0C0C0"


def prepare(
    spark: SparkSession, sets: Mapping[str, DataFrame], output: str, methods: str = "pca2", annotations: DataFrame | None = None, precomputed: Mapping[str, DataFrame] | None = None, fill: Sequence[str] = (), stats: bool = False, stats_annotation: str = "auto",
    clusters: Sequence[str] = ("elbow",), cache: str | None = None, refetch: bool = False, bundled: bool = True, settings: Mapping | None = None, **params: float,
) -> str:
    """Projects, annotates and, with ``stats``, measures vector sets (id, embedding) by name, and writes what comes of it.

    Only ids that all sets have are kept. ``annotations`` is (id, columns); of ``fill`` columns, missing values are taken from the nearest
    row of the first set that has one. ``precomputed`` are similarities (i, j, sim) by name. Projections are kept in ``cache`` and made anew
    with ``refetch``. ``bundled``: one file ``output`` of bounded size; else plain Parquet folders below it, of any size. Returns ``output``.
    """
    if not sets and not precomputed:
        raise ValueError("at least one set of vectors is needed")
    if not stats and (stats_annotation != "auto" or tuple(clusters) != ("elbow",)):
        raise ValueError("stats_annotation and clusters have an effect with stats alone")
    specs = reduce.parse_methods(methods)
    common = dict(zip(sets, joins.intersect_sets(list(sets.values())), strict=True)) if sets else {}
    base = next(iter(common.values())) if common else next(iter(precomputed.values())).select(F.col("i").alias("id"))
    ids = base.select(F.col("id").cast("string").alias("id")).distinct()
    notes = ids if annotations is None else ids.join(annotations.withColumn("id", F.col("id").cast("string")).dropDuplicates(["id"]), "id", "left")
    if fill:
        if not common:
            raise ValueError("missing values are filled from vectors")
        vectors = base.select(F.col("id").cast("string").alias("id"), "embedding")
        notes = transfer.run_transfer(notes.join(vectors, "id"), list(fill)).drop("embedding")
    tables = Tables(spark)
    notes = tables.written(notes, "notes")  # every statistic reads it
    store = reduce.ProjectionStore(spark, cache, refetch) if cache else None
    placed = tables.written(reduce.reductions(common, specs, precomputed, store, **params), "placed")
    names = [(source, s) for source in common for s in specs] + [(source, reduce.MethodSpec("mds", 2)) for source in precomputed or {}]
    info = lambda s: json.dumps({"method": s.method, **params, **s.overrides}, sort_keys=True)
    meta = spark.createDataFrame([(reduce.projection_name(source, s, specs), s.dims, info(s), source) for source, s in names], "projection_name string, dimensions long, info_json string, source string")
    at = lambda k: F.get("coords", F.lit(k))
    data = placed.select("projection_name", F.col("id").alias("identifier"), at(0).cast("float").alias("x"), at(1).cast("float").alias("y"), at(2).alias("z"))
    table = None
    if stats:
        table, notes = _measured(spark, common, names, specs, placed, notes, stats_annotation, clusters, tables)
    notes = notes.withColumnRenamed("id", "identifier")
    if bundled:
        bundle.write_bundle(output, notes, meta, data, settings, table)
        tables.close()
        return output
    parts = {"annotations": notes, "metadata": meta, "projections": data} | ({"statistics": table} if table is not None else {})
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{output.rstrip('/')}/{name}")
    if settings is not None:
        spark.createDataFrame([(json.dumps(settings),)], "settings_json string").coalesce(1).write.mode("overwrite").parquet(f"{output.rstrip('/')}/settings")
    tables.close()
    return output


def _measured(spark: SparkSession, sets: Mapping[str, DataFrame], names: Sequence[tuple[str, reduce.MethodSpec]], specs: Sequence[reduce.MethodSpec], placed: DataFrame, notes: DataFrame, selection: str, clusters: Sequence[str], tables: Tables) -> tuple[DataFrame, DataFrame]:
    """The statistics table, and the annotations with a column for each clustering."""
    from lumenvec.operators.stats import labels_for

    number = lambda df: df.withColumn("id", F.xxhash64(F.col("id").cast("string")))
    long = labels_for(notes, selection, "id")
    columns = [r["annotation"] for r in long.select("annotation").distinct().orderBy("annotation").collect()]
    wide = tables.written(number(long.groupBy("id").pivot("annotation", columns).agg(F.first("label"))), "labels") if columns else None
    vectors = {name: tables.written(number(df).select("id", F.col("embedding").alias("v")), "vectors") for name, df in sets.items()}
    spaces = [(n := reduce.projection_name(source, s, specs), source if source in vectors else None, number(placed.filter(F.col("projection_name") == n)).select("id", F.col("coords").alias("xy"))) for source, s in names]
    found = report.compute(vectors, spaces, wide, columns, clusters=clusters)
    out = notes.withColumn("_n", F.xxhash64("id"))
    for name, labels in found.memberships.items():
        out = out.join(labels.select(F.col("id").alias("_n"), name), "_n", "left")
    return found.table(spark), out.drop("_n")


def style_template(annotations: DataFrame, id_col: str = "identifier") -> DataFrame:
    """(annotation, value, n, color): the values of each column by falling frequency, to be given colours; missing ones are grey already."""
    columns = sorted(c for c in annotations.columns if c != id_col and "__pred_" not in c)
    cells = annotations.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]).select(F.explode(F.array(*[F.struct(F.lit(c).alias("annotation"), F.col(c).alias("cell")) for c in columns])).alias("x")).select("x.*")
    each = cells.select("annotation", F.explode(F.split("cell", ";")).alias("hit")).select("annotation", display_value(F.col("hit")).alias("value"))
    named = each.withColumn("value", F.when(F.col("value") == "", F.lit("<NA>")).otherwise(F.col("value")))
    return named.groupBy("annotation", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("color", F.when(F.col("value").isin(*MISSING), GREY).otherwise(""))


def style_bundle(spark: SparkSession, path: str, to: str, styles: Mapping[str, Mapping]) -> dict:
    """A bundle with ``styles`` (by annotation: ``colors`` and ``shapes`` by value, and settings) in its settings part; the other parts are copied
    as they are. Values are found as ``checks.resolve_styles`` finds them; one that the data doesn't have is an error. Returns the settings."""
    notes = bundle.read_part(spark, path)
    stream = bundle.Stream(spark, path)
    old = json.loads(bundle.read_part(spark, path, "settings").first()["settings_json"]) if "settings" in bundle.locate(stream.read, stream.size) else {}
    legends = dict(old.get("legendSettings", old))
    for name, style in styles.items():
        if name not in notes.columns:
            raise ValueError(f"there is no annotation {name}; there are {sorted(notes.columns[1:])}")
        known = style_template(notes.select(notes.columns[0], name), notes.columns[0]).select("value")
        wanted = sorted({*style.get("colors", {}), *style.get("shapes", {})})
        found = {r["value"]: r["found"] for r in checks.resolve_styles(spark.createDataFrame([(w,) for w in wanted], "value string"), known).collect()}  # a row a styled value
        lost = [w for w in wanted if found[w] is None]
        if lost:
            raise ValueError(f"annotation {name} has no value {lost}")
        entry = {**DEFAULTS, **legends.get(name, {}), **{k: v for k, v in style.items() if k not in ("colors", "shapes")}}
        categories = dict(entry.get("categories", {}))
        for z, w in enumerate(wanted):
            held = categories.get(found[w], {"zOrder": len(categories) + z, "color": "", "shape": "circle"})
            categories[found[w]] = {"zOrder": held["zOrder"], "color": style.get("colors", {}).get(w, held["color"]), "shape": style.get("shapes", {}).get(w, held["shape"])}
        legends[name] = {**entry, "categories": categories}
    new = {**(old if "legendSettings" in old else {}), "legendSettings": legends, "exportOptions": old.get("exportOptions", {}) if "legendSettings" in old else {}}
    bundle.replace_in(spark, path, to, "settings", bundle.settings_table(new))
    return new

