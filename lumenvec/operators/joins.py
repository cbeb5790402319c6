"""Joins and set operations over annotated rows. Which duplicate wins, and whether a null does, differs by operator on purpose."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows up to which a dimension is broadcast; beyond, Spark joins it as any other table.
BROADCAST_BYTES = 32 << 20


def checked_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its plan's own bound on its size is at most ``most`` bytes; no job runs to find that out.

    Without a bound (Spark then assumes the largest number) the join stays one that shuffles, which adaptive execution may still turn.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # a BigInt of Scala, or a number
    return F.broadcast(df) if size <= most else df


def dedup(df: DataFrame, key: str, position: str, last: bool = False) -> DataFrame:
    """One row for each key: the first by position, or the last."""
    pick = F.max_by if last else F.min_by
    return df.groupBy(key).agg(pick(F.struct(*[c for c in df.columns if c != key]), position).alias("_r")).select(key, "_r.*")


def attach_annotations(projections: DataFrame, annotations: DataFrame, key: str, position: str) -> DataFrame:
    """Projection rows with annotations by id as text; the last duplicate wins, annotation columns replace columns of the same name."""
    one = dedup(annotations.filter(F.col(key).isNotNull()).withColumn(key, F.col(key).cast("string")), key, position, last=True).drop(position)
    replaced = [c for c in one.columns if c != key and c in projections.columns]
    return projections.withColumn(key, F.col(key).cast("string")).drop(*replaced).join(one, key, "left")


def enrich(base: DataFrame, sources: Sequence[tuple[DataFrame, str, Sequence[str]]]) -> DataFrame:
    """Left joins in order: each (table, key column of base and table, columns); where a later source has a value it replaces an earlier one."""
    out = base
    for table, key, columns in sources:
        side = table.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k"), *[F.col(c).alias(f"_n_{c}") for c in columns]).dropDuplicates(["_k"])
        out = out.join(checked_broadcast(side), F.col(key).cast("string") == F.col("_k").cast("string"), "left")
        out = out.withColumns({c: F.coalesce(F.col(f"_n_{c}"), F.col(c)) if c in out.columns else F.col(f"_n_{c}") for c in columns}).drop("_k", *[f"_n_{c}" for c in columns])
    return out


def overlay_table(df: DataFrame, user: DataFrame, key: str, position: str) -> DataFrame:
    """A user's table over ``df``: the first duplicate counts, and its columns replace those of ``df`` even where they are null."""
    one = dedup(user, key, position).drop(position)
    return df.drop(*[c for c in one.columns if c != key]).join(one, key, "left")


def align_headers(headers: DataFrame, metadata: DataFrame, key: str, position: str) -> DataFrame:
    """Every header, with the first of its metadata rows."""
    return headers.select(key).join(dedup(metadata, key, position).drop(position), key, "left")


def refill_blanks(df: DataFrame, cached: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Null and empty cells of ``columns`` from a cache; others stay."""
    side = cached.select(F.col(key), *[F.col(c).alias(f"_c_{c}") for c in columns]).dropDuplicates([key])
    out = df.join(side, key, "left")
    return out.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_c_{c}"), F.col(c)) for c in columns}).drop(*[f"_c_{c}" for c in columns])


def intersect_sets(sets: Sequence[DataFrame], key: str = "id") -> list[DataFrame]:
    """Each set reduced to the ids that all have; an error if there are none."""
    common = sets[0].select(key)
    for s in sets[1:]:
        common = common.join(s.select(key), key, "left_semi")
    if common.isEmpty():
        raise ValueError("the sets have no id in common")
    return [s.join(common, key, "left_semi") for s in sets]


def best_source(candidates: DataFrame, wanted: DataFrame, key: str = "id", name: str = "set_name") -> str | None:
    """The one set that covers all wanted ids, or else overlaps most; None if that isn't a single one."""
    n = wanted.select(key).distinct().count()
    rows = candidates.join(wanted.select(key).distinct(), key, "left_semi").groupBy(name).agg(F.countDistinct(key).alias("k")).orderBy(F.desc("k"), name).limit(2).collect()
    if not rows:
        return None
    full = candidates.join(wanted.select(key).distinct(), key, "left_semi").groupBy(name).agg(F.countDistinct(key).alias("k")).filter(F.col("k") == n).limit(2).collect()
    if len(full) == 1:
        return full[0][name]
    return rows[0][name] if not full and (len(rows) == 1 or rows[0]["k"] > rows[1]["k"]) else None


def merge_columns(df: DataFrame, columns: DataFrame, key: str = "id") -> DataFrame:
    """``columns`` (id and one membership column or more) joined on; a column that meets no id is left out."""
    out = df
    for c in [c for c in columns.columns if c != key]:
        side = columns.select(key, c).filter(F.col(c).isNotNull())
        if not side.join(df.select(key), key, "left_semi").isEmpty():
            out = out.drop(c).join(side, key, "left")
    return out


def fold_quality(metadata: DataFrame, quality: DataFrame) -> DataFrame:
    """``metadata`` (projection_name, info_json) with quality (space_name, metric, value) as a member of its JSON."""
    q = quality.groupBy(F.col("space_name").alias("projection_name")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("q"))
    info = F.from_json(F.coalesce("info_json", F.lit("{}")), "map<string,string>")
    return metadata.join(q, "projection_name", "left").withColumn("info_json", F.when(F.col("q").isNull(), F.col("info_json")).otherwise(F.to_json(F.map_concat(F.map_filter(info, lambda k, v: k != "quality"), F.create_map(F.lit("quality"), F.to_json("q")))))).drop("q")


def uncovered(required: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Required ids that are not done yet."""
    return required.select(key).distinct().join(done.select(key), key, "left_anti")


def assert_complete(required: DataFrame, done: DataFrame, skipped: DataFrame, key: str = "id") -> None:
    """Raises unless every required id is done or skipped for a reason."""
    left = uncovered(uncovered(required, done, key), skipped, key)
    some = [r[0] for r in left.limit(5).collect()]
    if some:
        raise ValueError(f"{left.count()} ids are missing, such as {some}")


def resolve_names(df: DataFrame, id_col: str, cell: str, names: DataFrame, code: str = "code", name: str = "name", sep: str = ";") -> DataFrame:
    """Cells of codes (with evidence behind a pipe) as ``code (name)``, in order; a code without a name stays alone, empty parts go."""
    from lumenvec.functions.bio import with_evidence
    from lumenvec.functions.cells import encode_field
    from lumenvec.functions.missing import ws_trim

    part = ws_trim(F.col("part"))
    key, ev = F.regexp_replace(part, r"\|[^|]*$", ""), F.when(part.contains("|"), F.regexp_extract(part, r"\|([^|]*)$", 1)).otherwise("")
    parts = df.select(id_col, F.posexplode(F.split(cell, sep)).alias("pos", "part")).filter(part != "").select(id_col, "pos", key.alias("_key"), ev.alias("_ev"))
    named = parts.join(checked_broadcast(names.select(F.col(code).alias("_key"), F.col(name).alias("_name"))), "_key", "left")
    text = with_evidence(F.when(F.coalesce("_name", F.lit("")) == "", F.col("_key")).otherwise(F.concat("_key", F.lit(" ("), encode_field(F.col("_name")), F.lit(")"))), F.col("_ev"))
    return named.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", text.alias("t")))), lambda x: x["t"]), sep).alias(cell))


def union_sets(sets: Sequence[DataFrame], key: str = "id", vec: str = "embedding", atol: float = 1e-6, rtol: float = 1e-5) -> DataFrame:
    """Same-name sets as one: equal vectors (within atol + rtol times the later one) keep the first, others are an error, as are mixed lengths."""
    both = None
    for i, s in enumerate(sets):
        part = s.select(key, vec, F.lit(i).alias("_set"))
        both = part if both is None else both.unionByName(part)
    w = Window.partitionBy(key).orderBy("_set")
    first = F.first(vec).over(w)
    gap = F.exists(F.arrays_zip(F.col(vec).alias("x"), first.alias("y")), lambda p: F.abs(p["x"] - p["y"]) > atol + rtol * F.abs(p["x"]))
    marked = both.withColumns({"_gap": gap, "_r": F.row_number().over(w)})
    bad = marked.agg(F.count_if("_gap").alias("g"), F.countDistinct(F.size(vec)).alias("d")).first()
    if bad["d"] > 1:
        raise ValueError("vectors differ in length")
    if bad["g"]:
        raise ValueError(f"{bad['g']} ids have conflicting vectors")
    return marked.filter("_r = 1").select(key, vec)


def union_columns(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables under the union of their columns, first seen first; gaps are blank text."""
    out = None
    for t in tables:
        part = t.select(*[F.col(c).cast("string").alias(c) for c in t.columns])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.fillna("")


def missing_sources(cached: Sequence[str], required: Sequence[str], source_of: Mapping[str, str], needs: Mapping[str, Sequence[str]]) -> dict[str, bool]:
    """Which sources to ask: those of required columns that the cache lacks, and what these depend on."""
    todo = {source_of[c] for c in required if c not in cached and c in source_of}
    grown = True
    while grown:
        more = {n for s in todo for n in needs.get(s, ())} - todo
        todo |= more
        grown = bool(more)
    return {s: s in todo for s in sorted(set(source_of.values()))}


def domain_hits(hits: DataFrame) -> DataFrame:
    """(id, db, cell) from (id, db, accession, name, score, pos): accessions in order, each with its first name and all scores in order."""
    from lumenvec.functions.cells import encode_field

    by_pos = lambda c, test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("pos", F.col(c).alias("v"))))), lambda x: x["v"])
    named = F.coalesce(F.col("name"), F.lit("")) != ""
    each = hits.filter(F.coalesce("accession", F.lit("")) != "").groupBy("id", "db", "accession").agg(F.get(by_pos("name", named), F.lit(0)).alias("name"), by_pos("score", F.col("score").isNotNull()).alias("scores"))
    label = F.when(F.col("name").isNull(), F.col("accession")).otherwise(F.concat("accession", F.lit(" ("), encode_field(F.col("name")), F.lit(")")))
    text = F.when(F.size("scores") > 0, F.concat(label, F.lit("|"), F.array_join("scores", ","))).otherwise(label)
    return each.groupBy("id", "db").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("accession", text.alias("t")))), lambda x: x["t"]), ";").alias("cell"))


def count_ids(c: Column) -> Column:
    """A whole number from text, null for anything else."""
    return c.try_cast("long")
