"""Remote annotation sources, read from saved responses: batches of ids, pages, nested entries, lineages and name files.

Requests themselves are left to a fetch function: ``fetch_batches`` runs it on the executors, a batch of ids at a time,
over distinct keys only, and rows come back joined to every id that shares a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import parse_qs, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenvec.functions import bio
from lumenvec.functions.cells import encode_field

RANKS = ("root", "domain", "kingdom", "phylum", "class", "order", "family", "genus", "species")
BATCH = 100


def fetch_batches(keys: DataFrame, key: str, fetch: Callable[[list[str]], list[str]], batch: int = BATCH) -> DataFrame:
    """(key, body): ``fetch`` maps a list of keys to a list of response bodies (or nulls), called on the executors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids = f[key].tolist()
            for i in range(0, len(ids), batch):
                yield pd.DataFrame({"key": ids[i : i + batch], "body": fetch(ids[i : i + batch])})

    return keys.select(F.col(key).cast("string").alias(key)).filter(F.col(key).isNotNull()).distinct().mapInPandas(run, "key string, body string")


def fan_out(rows: DataFrame, key: str, answers: DataFrame) -> DataFrame:
    """``rows`` with the answer of their key; equal keys were asked for once."""
    return rows.join(answers.withColumnRenamed("key", key), key, "left")


def next_link(header: str | None) -> str | None:
    """The address that a Link header calls next."""
    for part in (header or "").split(","):
        address, _, rest = part.partition(";")
        if 'rel="next"' in rest:
            return address.strip().strip("<>")
    return None


def pages(first: str, get: Callable[[str], tuple[str, str | None]]) -> Iterator[str]:
    """Bodies of a paginated answer: ``get`` gives a body and its Link header."""
    url: str | None = first
    seen: set[str] = set()
    while url and url not in seen:
        seen.add(url)
        body, link = get(url)
        yield body
        url = next_link(link)


def page_cursor(url: str) -> str | None:
    return (parse_qs(urlparse(url).query).get("cursor") or [None])[0]


def _first(c: Column, path: str) -> Column:
    return F.get_json_object(c, path)


def _joined(c: Column, ddl: str, value: Callable[[Column], Column]) -> Column:
    """Values of a JSON list joined by semicolons, empty ones left out."""
    items = F.coalesce(F.from_json(c, ddl), F.array())
    return F.array_join(F.filter(F.transform(items, value), lambda x: F.coalesce(x, F.lit("")) != ""), ";")


def _with_best(text: Column, evidences: Column) -> Column:
    best = bio.best_evidence(F.transform(F.coalesce(evidences, F.array()), lambda e: e["evidenceCode"]))
    return F.when(F.coalesce(best, F.lit("")) == "", text).otherwise(F.concat(text, F.lit("|"), best))


_EV = "evidences array<struct<evidenceCode:string>>"


def protein_entry(json: Column) -> dict[str, Column]:
    """Fields of a protein entry's JSON as columns, by name."""
    xref_ddl = "array<struct<database:string,id:string,properties:array<struct<key:string,value:string>>>>"
    xrefs = F.coalesce(F.from_json(_first(json, "$.uniProtKBCrossReferences"), xref_ddl), F.array())
    of = lambda db: F.filter(xrefs, lambda x: x["database"] == db)
    ids = lambda db: F.array_join(F.transform(of(db), lambda x: x["id"]), ";")
    prop = lambda x, key: F.get(F.transform(F.filter(x["properties"], lambda p: p["key"] == key), lambda p: p["value"]), F.lit(0))
    go = lambda aspect: F.array_join(F.transform(F.filter(of("GO"), lambda x: F.startswith(prop(x, "GoTerm"), F.lit(f"{aspect}:"))), lambda x: encode_field(prop(x, "GoTerm"))), ";")
    comments = F.coalesce(F.from_json(_first(json, "$.comments"), f"array<struct<commentType:string,texts:array<struct<value:string,{_EV.replace(' ', ':', 1)}>>,subcellularLocations:array<struct<location:struct<value:string,{_EV.replace(' ', ':', 1)}>>>>>"), F.array())
    kind = lambda t: F.filter(comments, lambda x: x["commentType"] == t)
    places = F.flatten(F.transform(kind("SUBCELLULAR LOCATION"), lambda x: F.coalesce(x["subcellularLocations"], F.array())))
    family = F.get(F.flatten(F.transform(kind("SIMILARITY"), lambda x: F.coalesce(x["texts"], F.array()))), F.lit(0))
    features = F.coalesce(F.from_json(_first(json, "$.features"), "array<struct<type:string,description:string,location:struct<start:struct<value:bigint>,end:struct<value:bigint>>>>"), F.array())
    ec = f"array<struct<value:string,{_EV.replace(' ', ':', 1)}>>"
    names = F.coalesce(F.from_json(_first(json, "$.proteinDescription.alternativeNames"), f"array<struct<ecNumbers:{ec}>>"), F.array())
    numbers = F.concat(F.coalesce(F.from_json(_first(json, "$.proteinDescription.recommendedName.ecNumbers"), ec), F.array()), F.flatten(F.transform(names, lambda n: F.coalesce(n["ecNumbers"], F.array()))))
    joined = lambda items: F.array_join(F.filter(items, lambda x: F.coalesce(x, F.lit("")) != ""), ";")
    # Terms of an aspect with the short code of their evidence, which stands before a colon.
    source = lambda x: F.split_part(F.coalesce(prop(x, "GoEvidenceType"), F.lit("")), F.lit(":"), F.lit(1))
    term = lambda x: F.concat(encode_field(prop(x, "GoTerm")), F.when(source(x) != "", F.concat(F.lit("|"), source(x))).otherwise(""))
    terms = lambda aspect: joined(F.transform(F.filter(of("GO"), lambda x: F.startswith(prop(x, "GoTerm"), F.lit(f"{aspect}:"))), term))
    of_type = lambda t: F.filter(features, lambda x: x["type"] == t)
    start, end = (lambda x: x["location"]["start"]["value"].cast("string")), (lambda x: x["location"]["end"]["value"].cast("string"))
    span = lambda x: F.concat_ws("-", start(x), end(x))
    spans = lambda t: joined(F.transform(of_type(t), span))
    sites = lambda t: joined(F.transform(of_type(t), lambda x: F.concat(start(x), F.when(F.coalesce(x["description"], F.lit("")) != "", F.concat(F.lit(" ("), encode_field(x["description"]), F.lit(")"))).otherwise(""))))
    more = {
        "entry_name": _first(json, "$.uniProtkbId"), "gene_primary": _first(json, "$.genes[0].geneName.value"), "organism_name": _first(json, "$.organism.scientificName"), "xref_proteomes": ids("Proteomes"),
        "lineage": F.array_join(F.coalesce(F.from_json(_first(json, "$.organism.lineage"), "array<string>"), F.array()), ";"), "virus_hosts": _joined(_first(json, "$.organismHosts"), "array<struct<scientificName:string>>", lambda h: h["scientificName"]),
        "mass": _first(json, "$.sequence.molWeight"), "keyword_id": _joined(_first(json, "$.keywords"), "array<struct<id:string>>", lambda k: k["id"]),
        "go": joined(F.transform(of("GO"), term)), "go_bp": terms("P"), "go_mf": terms("F"), "go_cc": terms("C"), "go_id": ids("GO"),
        "date_created": _first(json, "$.entryAudit.firstPublicDate"), "date_modified": _first(json, "$.entryAudit.lastAnnotationUpdateDate"), "date_sequence_modified": _first(json, "$.entryAudit.lastSequenceUpdateDate"), "version": _first(json, "$.entryAudit.entryVersion"),
        "ft_non_adj": spans("Non-adjacent residues"), "ft_non_std": joined(F.transform(of_type("Non-standard residue"), start)), "ft_non_ter": start(F.get(of_type("Non-terminal residue"), F.lit(0))),
        "ft_disulfid": spans("Disulfide bond"), "ft_glycosylation": sites("Glycosylation"), "ft_lipidation": sites("Lipidation"), "ft_mod_res": sites("Modified residue"), "ft_signal": span(F.get(of_type("Signal"), F.lit(0))),
    }
    return more | {
        "entry": _first(json, "$.primaryAccession"), "uniprot_kb_id": _first(json, "$.uniProtkbId"), "reviewed": bio.reviewed(F.coalesce(_first(json, "$.entryType"), F.lit(""))),
        "protein_existence": F.coalesce(_first(json, "$.proteinExistence"), F.lit("")), "annotation_score": bio.annotation_score(F.coalesce(_first(json, "$.annotationScore"), F.lit(""))),
        "organism_id": _first(json, "$.organism.taxonId"), "organism": _first(json, "$.organism.scientificName"), "gene_name": _first(json, "$.genes[0].geneName.value"),
        "protein_name": F.coalesce(_first(json, "$.proteinDescription.recommendedName.fullName.value"), _first(json, "$.proteinDescription.submissionNames[0].fullName.value")),
        "length": _first(json, "$.sequence.length"), "sequence": _first(json, "$.sequence.value"), "uniparc_id": F.coalesce(_first(json, "$.extraAttributes.uniParcId"), F.lit("")),
        "keyword": _joined(_first(json, "$.keywords"), "array<struct<id:string,name:string>>", lambda k: F.concat(k["id"], F.lit(" ("), encode_field(k["name"]), F.lit(")"))),
        "ec": joined(F.transform(numbers, lambda e: _with_best(e["value"], e["evidences"]))),
        "cc_subcellular_location": F.array_join(F.transform(F.filter(places, lambda p: F.coalesce(p["location"]["value"], F.lit("")) != ""), lambda p: _with_best(encode_field(p["location"]["value"]), p["location"]["evidences"])), ";"),
        "protein_families": F.coalesce(_with_best(encode_field(bio.family_sentence(family["value"])), family["evidences"]), F.lit("")),
        "fragment": F.when(F.startswith(_first(json, "$.proteinDescription.flag"), F.lit("Fragment")), "fragment").otherwise(""),
        "xref_pdb": ids("PDB"), "xref_pfam": ids("Pfam"), "xref_ensembl": ids("Ensembl"), "go_f": go("F"), "go_p": go("P"), "go_c": go("C"),
        "n_features": F.size(features).cast("string"), "merged_into": _first(json, "$.inactiveReason.mergeDemergeTo[0]"),
    }


def parse_entries(df: DataFrame, id_col: str, body: str) -> DataFrame:
    """``protein_entry`` of each row; rows without a body, such as ids that are no accession, get blanks."""
    fields = protein_entry(F.col(body))
    return df.select(id_col, *[F.coalesce(c, F.lit("")).alias(n) for n, c in fields.items()])


def resolve_inactive(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """(asked, entry): the id itself, or else the entry it was merged into, or else the one whose secondary accessions name it.

    ``entries`` (entry, merged_into, secondary array, active).
    """
    active = entries.filter("active").select(F.col("entry").alias("found"))
    merged = entries.filter("not active").select(F.col("entry").alias("asked"), "merged_into")
    second = entries.filter("active").select(F.col("entry").alias("by_second"), F.explode("secondary").alias("asked")).groupBy("asked").agg(F.min("by_second").alias("by_second"))
    out = asked.join(active, asked["asked"] == active["found"], "left").join(merged, "asked", "left").join(second, "asked", "left")
    return out.select("asked", F.coalesce("found", "merged_into", "by_second").alias("entry"))


def lineages(df: DataFrame) -> DataFrame:
    """(taxon, one column a rank) from (taxon, lineage array<struct<rank, name>>); a missing domain takes the realm."""
    each = df.select("taxon", F.explode("lineage").alias("l")).select("taxon", F.lower("l.rank").alias("rank"), "l.name")
    wide = each.groupBy("taxon").pivot("rank", [*RANKS, "realm"]).agg(F.first("name"))
    return wide.withColumn("domain", F.coalesce("domain", "realm")).drop("realm").fillna("")


def read_names(spark, path: str, kind: str) -> DataFrame:
    """(code, name) from a name file: ``cath`` (code, example, :name), ``enzyme`` (ID and DE lines), ``classes`` (spaced numbers and a text), ``clans`` (tab-separated), ``interpro`` (XML)."""
    if kind == "interpro":
        x = spark.read.format("xml").option("rowTag", "interpro").load(path)
        return x.select(F.col("_id").alias("code"), F.col("_short_name").alias("name"))
    if kind == "clans":
        c = spark.read.option("sep", "\t").csv(path)
        return c.filter("_c1 is not null").select(F.col("_c0").alias("code"), F.concat("_c1", F.lit(" ("), F.coalesce("_c2", F.lit("")), F.lit(")")).alias("name"))
    if kind == "enzyme":
        r = spark.read.option("lineSep", "\n//").text(path)
        parts = F.concat_ws(" ", F.regexp_extract_all("value", F.lit(r"(?m)^DE   (.*)$"), F.lit(1)))
        return r.select(F.regexp_extract("value", r"(?m)^ID   (\S+)", 1).alias("code"), F.regexp_replace(parts, r"\.$", "").alias("name")).filter("code <> ''")
    lines = spark.read.text(path).filter(~F.startswith("value", F.lit("#")))
    if kind == "cath":
        return lines.select(F.regexp_extract("value", r"^(\S+)\s+\S+\s+:?(.*)$", 1).alias("code"), F.trim(F.regexp_extract("value", r"^(\S+)\s+\S+\s+:?(.*)$", 2)).alias("name")).filter("code <> '' and name <> ''")
    pattern = r"^([\d]+\. ?[\d-]+\. ?[\d-]+\.-?)\s+(.*?)\.?\s*$"
    return lines.select(F.regexp_replace(F.regexp_extract("value", pattern, 1), " ", "").alias("code"), F.regexp_extract("value", pattern, 2).alias("name")).filter("code <> ''")


def similarity_edges(alignments: DataFrame) -> DataFrame:
    """(i, j, sim) of (query, target, fident, pos) both ways; the last alignment of a pair counts, what is absent is 0."""
    both = alignments.select(F.col("query").alias("i"), F.col("target").alias("j"), "fident", "pos").unionByName(alignments.select(F.col("target").alias("i"), F.col("query").alias("j"), "fident", "pos"))
    return both.groupBy("i", "j").agg(F.max_by("fident", "pos").alias("sim"))


def embed(sequences: DataFrame, model: Callable[[list[str]], list[list[float]]], done: DataFrame | None = None, batch: int = 32) -> DataFrame:
    """(id, embedding) of (id, sequence): each distinct sequence once, those done left out, batches of like length; ``model`` runs on the executors."""
    todo = sequences if done is None else sequences.join(done.select("id"), "id", "left_anti")
    n = max(1, int(todo.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    distinct = todo.select("sequence").distinct().withColumn("n", F.length("sequence")).repartitionByRange(n, "n", "sequence").sortWithinPartitions("n")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            seqs = f["sequence"].tolist()
            for i in range(0, len(seqs), batch):
                yield pd.DataFrame({"sequence": seqs[i : i + batch], "embedding": model(seqs[i : i + batch])})

    return todo.join(distinct.mapInPandas(run, "sequence string, embedding array<float>"), "sequence").select("id", "embedding")
