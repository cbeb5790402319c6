"""Clean-up of protein annotation fields as Column expressions. Empty and null cells pass through unless stated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenvec.functions.cells import encode_field
from lumenvec.functions.missing import ws_trim

ACCESSION = r"^[OPQ][0-9][A-Z0-9]{3}[0-9]$|^[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2}$"
#: Evidence ontology codes to short ones, and short ones by trust.
ECO_SHORT = {
    "ECO:0000269": "EXP", "ECO:0000303": "TAS", "ECO:0000305": "IC", "ECO:0000250": "ISS", "ECO:0000255": "SAM", "ECO:0000256": "SAM",
    "ECO:0000259": "SAM", "ECO:0000312": "IMP", "ECO:0000313": "IEA", "ECO:0007669": "IEA", "ECO:0007744": "HDA", "ECO:0000244": "COMB",
}
EVIDENCE_ORDER = ("EXP", "HDA", "IDA", "TAS", "NAS", "IC", "ISS", "SAM", "COMB", "IMP", "IEA")


def parse_identifier(key: Column) -> Column:
    """``sp|P12345|X`` and ``tr|...`` to the accession; other piped keys to their second part."""
    return F.when(key.rlike(r"^(sp|tr)\|[^|]+\|"), F.regexp_extract(key, r"^(?:sp|tr)\|([^|]+)\|", 1)).when(key.contains("|"), F.split_part(key, F.lit("|"), F.lit(2))).otherwise(key)


def is_accession(c: Column) -> Column:
    return c.rlike(ACCESSION)


def annotation_score(c: Column) -> Column:
    """``5.0`` to ``5`` by truncation; what is no number stays."""
    return F.coalesce(c.try_cast("double").try_cast("long").cast("string"), c)


def _evidence(c: Column) -> tuple[Column, Column]:
    """Before and behind the last pipe; the latter empty without one."""
    piped = c.contains("|")
    return F.when(piped, F.regexp_extract(c, r"(?s)^(.*)\|([^|]*)$", 1)).otherwise(c), F.when(piped, F.regexp_extract(c, r"(?s)^(.*)\|([^|]*)$", 2)).otherwise("")


def with_evidence(text: Column, evidence: Column) -> Column:
    return F.when(evidence == "", text).otherwise(F.concat(text, F.lit("|"), evidence))


def first_family(c: Column) -> Column:
    """Up to the first comma (else semicolon), evidence kept."""
    main, evidence = _evidence(c)
    first = F.when(main.contains(","), ws_trim(F.split_part(main, F.lit(","), F.lit(1)))).when(main.contains(";"), ws_trim(F.split_part(main, F.lit(";"), F.lit(1)))).otherwise(main)
    return F.when(c == "", c).otherwise(with_evidence(first, evidence))


def has_structure(pdb: Column, accession: Column) -> Column:
    """``True`` or ``False``; empty where the accession is blank; such values stay as they are."""
    return F.when(ws_trim(accession) == "", "").when(pdb.isin("True", "False"), pdb).when(pdb.isNull() | (ws_trim(pdb) == ""), "False").otherwise("True")


def fragment(c: Column) -> Column:
    return F.when(F.lower(ws_trim(c)) == "fragment", "yes").otherwise(c)


def go_terms(c: Column) -> Column:
    """Each term without its one-letter aspect."""
    strip = lambda t: F.when((F.length(t) > 2) & (F.substring(t, 2, 1) == ":"), F.substring(t, 3, 1 << 30)).otherwise(t)
    return F.when(c == "", c).otherwise(F.array_join(F.transform(F.split(c, ";"), lambda t: strip(ws_trim(t))), ";"))


def cath(c: Column) -> Column:
    """Codes without their prefix, sorted."""
    parts = F.filter(F.split(c, ";"), lambda v: ws_trim(v) != "")
    return F.when(c == "", c).otherwise(F.array_join(F.array_sort(F.transform(parts, lambda v: ws_trim(F.replace(v, F.lit("G3DSA:"), F.lit(""))))), ";"))


def signal_peptide(c: Column) -> Column:
    return F.when(c.isin("True", "False"), c).when(c.contains("SIGNAL_PEPTIDE"), "True").otherwise("False")


def pfam_accessions(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(PF\d+)"), F.lit(1))


def ted_domain(label: Column, name: Column, plddt: Column) -> Column:
    """``label (name)|score`` with one decimal; ``-`` without a label, no name where there is none."""
    shown = F.when(label.isNull() | (label == ""), "-").otherwise(label)
    named = F.when((shown != "-") & (F.coalesce(name, F.lit("")) != ""), F.concat(shown, F.lit(" ("), encode_field(name), F.lit(")"))).otherwise(shown)
    return F.concat(named, F.lit("|"), F.format_string("%.1f", F.bround(F.coalesce(plddt, F.lit(0.0)), 1)))


def topology_signal(c: Column) -> Column:
    return F.when(c.contains("S"), "True").otherwise("False")


def topology_membrane(c: Column) -> Column:
    helix, beta = c.rlike("[Hh]"), c.rlike("[Bb]")
    return F.when(helix & beta, "alpha-helical;beta-barrel").when(helix, "alpha-helical").when(beta, "beta-barrel").otherwise("none")


def reviewed(entry_type: Column) -> Column:
    t = F.lower(entry_type)
    return F.when(t.contains("swiss-prot") | (t.contains("reviewed") & ~t.contains("unreviewed")), "Swiss-Prot").otherwise("TrEMBL")


def family_sentence(c: Column) -> Column:
    """Without its opening words, up to the first period."""
    return F.split_part(F.regexp_replace(c, "^Belongs to the ", ""), F.lit("."), F.lit(1))


def relabel_ted(c: Column) -> Column:
    return F.regexp_replace(c, r"(^|;)unclassified(?=\|)", "$1-")


def pretty_name(c: Column) -> Column:
    clean = ws_trim(F.regexp_replace(c, "[_-]+", " "))
    return F.when(clean == "", c).otherwise(F.concat(F.upper(F.substring(clean, 1, 1)), F.substring(clean, 2, 1 << 30)))


def hex_to_rgba(c: Column, alpha: float = 0.8) -> Column:
    part = lambda k: F.conv(F.substring(F.ltrim(c, F.lit("#")), k, 2), 16, 10)
    return F.concat(F.lit("rgba("), F.concat_ws(", ", part(1), part(3), part(5), F.lit(str(alpha))), F.lit(")"))


def sample_palette(t: Column, stops: Sequence[str]) -> Column:
    """The colour at ``t`` (0 to 1, else cut to that) of evenly spaced stops (#RGB or #RRGGBB), channel by channel in sRGB.

    A stop that is met exactly comes back as it is written, and #000000 without stops; null and NaN have no colour.
    """
    if len(stops) < 2:
        return F.when(t.isNotNull() & ~F.isnan(t), F.lit(stops[0] if stops else "#000000"))
    wide = ["".join(2 * c for c in s[1:]) if len(s) == 4 else s[1:] for s in stops]
    table = F.array(*[F.array(*[F.lit(int(s[k : k + 2], 16)) for k in (0, 2, 4)]) for s in wide])
    at = F.least(F.greatest(t.cast("double"), F.lit(0.0)), F.lit(1.0)) * (len(stops) - 1)
    low = F.least(F.floor(at), F.lit(len(stops) - 2)).cast("int")
    share = at - low
    mixed = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.floor(F.get(F.get(table, low), k) * (1 - share) + F.get(F.get(table, low + 1), k) * share + 0.5 + 1e-9).cast("int"))
    text = F.concat(F.lit("#"), F.array_join(F.transform(mixed, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    exact = F.get(F.array(*[F.lit(s) for s in stops]), at.cast("int"))
    return F.when(t.isNull() | F.isnan(t.cast("double")), F.lit(None)).when(at == F.floor(at), exact).otherwise(text)


def best_evidence(codes: Column) -> Column:
    """The most trusted of an array of codes, after shortening; the first where none is known, null for none."""
    short = F.transform(codes, lambda c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ECO_SHORT.items() for x in kv]), c), c))
    order = F.array(*[F.lit(x) for x in EVIDENCE_ORDER])
    best = F.array_min(F.filter(F.transform(short, lambda c: F.array_position(order, c)), lambda p: p > 0))
    return F.coalesce(F.try_element_at(order, best.cast("int")), F.get(short, F.lit(0)))
