"""Identifiers of European acts and of national implementing measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sector 3 identifiers (year, descriptor, number, publication sequence,
# corrigendum), identifiers of base and corrigendum, measures, and resource addresses.
SECTOR3 = r"^3([0-9]{4})([A-Z]{1,3})([0-9]{4,6})(\([0-9]{2}\))?(R\([0-9]{2}\))?$"
CORRIGENDUM = r"^(3[0-9]{4}[A-Z]{1,3}[0-9]{4,6}(?:\([0-9]{2}\))?)R\(([0-9]{2})\)$"
MEASURE = r"^7[0-9]{4}[A-Z][0-9]{4,6}FRA_([0-9]+)$"
STAR_MEASURE = r"^7\*FRA_([0-9]+)$"
RESOURCE = "/resource/celex/"
ANY_CELEX = r"(?i)\b[0-9][0-9]{4}[A-Z][0-9]{3,5}\b"
ANY_ELI = r"(?i)https?://data\.europa\.eu/eli/[^\s<>\"']+"
# Kinds of act by descriptor.
ACT_TYPES = {
    "A": "OPINION", "B": "BUDGET", "C": "DECLARATION", "D": "DECISION", "E": "CFSP", "F": "PJCC", "G": "RESOLUTION", "H": "RECOMMENDATION",
    "K": "ECSC_RECOMMENDATION", "L": "DIRECTIVE", "M": "CONCENTRATION", "O": "ECB_GUIDELINE", "Q": "INSTITUTIONAL", "R": "REGULATION",
    "S": "ECSC_DECISION", "X": "OTHER_OJ_L",
}


def decoded(text: Column) -> Column:
    """Percent-decoding that leaves '+' alone; what can't be decoded stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def _group(value: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(value, pattern, k), F.lit(""))


def act_type(descriptor: Column) -> Column:
    kinds = F.create_map(*(F.lit(x) for kv in ACT_TYPES.items() for x in kv))
    return F.when(descriptor.isNotNull(), F.coalesce(kinds[descriptor], F.lit("OTHER")))


def sector3(value: Column) -> Column:
    """Struct ``celex, year, descriptor, number, sequence, corrigendum, act_type``; null if it isn't of sector 3."""
    v = F.upper(decoded(value))
    descriptor = _group(v, SECTOR3, 2)
    parts = F.struct(
        v.alias("celex"), _group(v, SECTOR3, 1).cast("int").alias("year"), descriptor.alias("descriptor"), _group(v, SECTOR3, 3).alias("number"),
        _group(v, SECTOR3, 4).alias("sequence"), _group(v, SECTOR3, 5).alias("corrigendum"), act_type(descriptor).alias("act_type"),
    )
    return F.when(v.rlike(SECTOR3), parts)


def from_resource(uri: Column) -> Column:
    """Identifier in a resource address, decoded and in upper case; null elsewhere."""
    return F.when(F.contains(uri, F.lit(RESOURCE)), F.upper(decoded(F.substring_index(uri, RESOURCE, -1))))


def aliases(uris: Column, only_sector3: bool = True) -> Column:
    """Sorted distinct identifiers of a list of addresses."""
    found = F.filter(F.transform(F.coalesce(uris, F.array().cast("array<string>")), from_resource), lambda c: c.isNotNull())
    return F.array_sort(F.array_distinct(F.filter(found, lambda c: c.rlike(SECTOR3)) if only_sector3 else found))


def alias_status(ids: Column) -> Column:
    """What a set of sector 3 identifiers decides."""
    return F.when(F.size(ids) == 1, F.lit("RESOLVED")).when(F.size(ids) > 1, F.lit("MULTIPLE_CELEX")).otherwise(F.lit("NO_SECTOR3_CELEX"))


def corrigendum(celex: Column) -> Column:
    """Struct ``base_celex, number`` of a corrigendum, else null."""
    v = F.upper(celex)
    return F.when(v.rlike(CORRIGENDUM), F.struct(_group(v, CORRIGENDUM, 1).alias("base_celex"), _group(v, CORRIGENDUM, 2).alias("number")))


def member_role(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.endswith(".toc.fmx.xml"), "TOC").when(n.endswith(".doc.xml"), "DOC").when(n.endswith(".fmx.xml"), "FMX").otherwise("XML")


def measure(uri: Column) -> Column:
    """Struct ``nim_celex, shape, database_id`` of a measure's address."""
    v = F.upper(decoded(F.substring_index(F.coalesce(uri, F.lit("")), "/", -1)))
    shape = F.when(v.rlike(MEASURE), "STANDARD").when(v.rlike(STAR_MEASURE), "MULTI_ACT_STAR").otherwise("OTHER")
    number = F.coalesce(_group(v, MEASURE, 1), _group(v, STAR_MEASURE, 1)).cast("long")
    return F.struct(v.alias("nim_celex"), shape.alias("shape"), number.alias("database_id"))


def looks_like_celex(query: str) -> bool:
    """A search that starts with a digit and has no space asks for an act."""
    q = query.strip()
    return bool(q) and q[0].isdigit() and " " not in q
