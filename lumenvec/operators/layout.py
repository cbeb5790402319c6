"""Column types, coordinates and detail views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenvec.functions.cells import parse_number
from lumenvec.functions.missing import web_missing

ALWAYS = ("accession", "length")


def infer_types(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """int, float or string by content, all or nothing: one value that is no number makes text; so does having none."""
    aggs = []
    for i, c in enumerate(columns):
        cell = F.col(c).cast("string")
        here, x = ~web_missing(cell), parse_number(cell)
        aggs += [F.coalesce(F.bool_and(~here | x.isNotNull()), F.lit(True)).alias(f"ok{i}"), F.coalesce(F.bool_or(here), F.lit(False)).alias(f"any{i}"), F.coalesce(F.bool_or(here & (x != F.floor(x))), F.lit(False)).alias(f"frac{i}")]
    r = df.agg(*aggs).first()
    return {c: "string" if not r[f"ok{i}"] or not r[f"any{i}"] else "float" if r[f"frac{i}"] else "int" for i, c in enumerate(columns)}


def restore_types(df: DataFrame, inferred: dict[str, str]) -> dict[str, str]:
    """Inferred types with what the schema declares: a floating column stays float though its values are whole; an all-missing column with a declared number type becomes numeric."""
    out = dict(inferred)
    declared = {c: "int" if t in ("int", "bigint", "smallint", "tinyint") else "float" if t in ("float", "double") else None for c, t in df.dtypes}
    empty = [c for c in inferred if inferred[c] == "string" and declared.get(c)]
    present = df.agg(*[F.count(c).alias(c) for c in empty]).first() if empty else {}
    for c, kind in inferred.items():
        if declared.get(c) and (kind != "string" or not present[c]):
            out[c] = declared[c]
    return out


def coordinates(ids: DataFrame, projections: DataFrame, coords: DataFrame) -> DataFrame:
    """(id, projection_name, x, y, z, dimension) for every id in every projection; what is absent is 0, and a projection is 3-D if any z is there."""
    dims = projections.join(coords.groupBy("projection_name").agg(F.bool_or(F.col("z").isNotNull()).alias("deep")), "projection_name", "left")
    grid = ids.select("id").crossJoin(F.broadcast(dims.select("projection_name", F.coalesce("deep", F.lit(False)).alias("deep"))))  # projections are few by nature
    full = grid.join(coords, ["id", "projection_name"], "left")
    return full.select("id", "projection_name", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in "xyz"], F.when(F.col("deep"), 3).otherwise(2).alias("dimension"))


def projection_pairs(columns: Sequence[str]) -> dict[str, tuple[str, str]]:
    """Pairs of coordinate columns of a wide table: NAME_x with NAME_y, or NAME1 with NAME2."""
    have, out = {c.lower(): c for c in columns}, {}
    for c in columns:
        for a, b in (("_x", "_y"), ("1", "2")):
            stem = c[: -len(a)]
            if c.lower().endswith(a) and stem and (other := have.get((stem + b).lower())) and stem not in out:
                out[stem] = (c, other)
    return out


def wide_to_long(df: DataFrame, id_col: str) -> DataFrame:
    """A wide table's projections as (id, projection_name, x, y, z)."""
    pairs = projection_pairs([c for c in df.columns if c != id_col])
    if not pairs:
        raise ValueError("no pair of coordinate columns")
    each = [F.struct(F.lit(n).alias("projection_name"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.lit(None).cast("double").alias("z")) for n, (x, y) in pairs.items()]
    return df.select(F.col(id_col).cast("string").alias("id"), F.explode(F.array(*each)).alias("p")).select("id", "p.*")


def metadata_map(meta: DataFrame) -> DataFrame:
    """(projection_name, key, value): members of info_json but ``dimension``, under the row's own columns, which win."""
    own = [c for c in meta.columns if c not in ("projection_name", "info_json")]
    info = F.map_filter(F.coalesce(F.from_json("info_json", "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, v: (k != "dimension") & ~k.isin(*own))
    mine = F.create_map(*[x for c in own for x in (F.lit(c), F.col(c).cast("string"))]) if own else F.create_map().cast("map<string,string>")
    return meta.select("projection_name", F.explode(F.map_concat(info, mine)).alias("key", "value"))


def find_id_column(columns: Sequence[str], candidates: Sequence[str] = ("identifier", "protein_id", "id", "protein", "uniprot")) -> str | None:
    """The first column that contains the first candidate that any does, in either case."""
    return next((c for k in candidates for c in columns if k in c.lower()), None)


def expand_requested(requested: Sequence[str], groups: dict[str, Sequence[str]], known: Sequence[str], always: Sequence[str] = ALWAYS) -> list[str]:
    """Columns asked for, groups opened, the ones that always come first, each once; unknown names raise with what is close."""
    import difflib

    out = [c for c in always if c in known]
    for r in requested:
        for c in groups.get(r, (r,)):
            if c not in known:
                raise ValueError(f"unknown column {c}; did you mean {difflib.get_close_matches(c, known, 3)}?")
            if c not in out:
                out.append(c)
    return out


def detail(df: DataFrame, id_col: str, id_value: object, headers: dict[str, Sequence[str]], shown: Sequence[str]) -> DataFrame:
    """One row: headers from the first of their columns that has a value, and the shown columns, a predicted value behind where the own one is missing."""
    heads = [F.coalesce(*[F.when(~web_missing(F.col(c).cast("string")), F.col(c).cast("string")) for c in cs if c in df.columns], F.lit("")).alias(h) for h, cs in headers.items()]
    own = lambda c: F.when(~web_missing(F.col(c).cast("string")), F.col(c).cast("string"))
    blocks = [F.coalesce(own(c), F.col(f"{c}__pred_value") if f"{c}__pred_value" in df.columns else F.lit(None).cast("string")).alias(c) for c in shown]
    return df.filter(F.col(id_col) == F.lit(id_value)).select(F.col(id_col), *heads, *blocks)
