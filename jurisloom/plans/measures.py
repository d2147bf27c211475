"""National implementing measures over a table of triples (``s, p, o, o_type, o_lang, o_datatype``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import celex as cx

# Predicates of the measures' ontology and the columns they fill.
CDM = "http://publications.europa.eu/ontology/cdm#"
SAME_AS = "http://www.w3.org/2002/07/owl#sameAs"
CELEX_URI = "http://publications.europa.eu/resource/celex/"
CELLAR_URI = "http://publications.europa.eu/resource/cellar/"
FIELDS = {
    "nim_celex": "resource_legal_id_celex", "title": "work_title", "act_type": "measure_national_implementing_type_act", "document_date": "work_date_document",
    "notification_date": "measure_national_implementing_date_notification", "official_journal_date": "measure_national_implementing_date_official_journal",
    "official_journal_name": "measure_national_implementing_name_official_journal", "official_journal_page": "measure_national_implementing_page_official_journal",
    "commission_reference": "measure_national_implementing_reference_commission", "member_state_reference": "measure_national_implementing_reference_member-state",
    "national_local_id": "resource_legal_id_local", "work_id_document": "work_id_document", "eli": "eli",
}
RELATIONS = ("measure_national_implementing_implements_resource_legal", "measure_national_implementing_implements_directive")


def directives(identity: DataFrame) -> DataFrame:
    """Distinct identifiers of resolved directives that aren't corrigenda."""
    keep = (F.col("status") == "RESOLVED") & (F.col("act_type") == "DIRECTIVE") & F.col("celex").isNotNull() & ~F.contains("celex", F.lit("R("))
    return identity.filter(keep).select(F.upper("celex").alias("celex")).distinct()


def edges(triples: DataFrame, wanted: DataFrame) -> DataFrame:
    """Relations in either direction between directives and French measures, once each."""
    same = triples.filter(F.col("p") == SAME_AS).select(F.col("s").alias("work"), F.col("o").alias("uri"))
    acts = same.join(wanted.select(F.concat(F.lit(CELEX_URI), "celex").alias("uri")), "uri").select(F.col("work").alias("directive"), cx.from_resource(F.col("uri")).alias("eu_celex"))
    measures = same.filter(F.col("uri").startswith(CELEX_URI + "7") & F.contains(F.upper("uri"), F.lit("FRA_"))).select(F.col("work").alias("nim"), "uri")
    links = triples.filter(F.col("p") != SAME_AS).select("s", "p", "o")
    there = links.join(measures, F.col("s") == F.col("nim")).join(acts, F.col("o") == F.col("directive")).withColumn("direction", F.lit("NIM_TO_DIRECTIVE"))
    back = links.join(measures, F.col("o") == F.col("nim")).join(acts, F.col("s") == F.col("directive")).withColumn("direction", F.lit("DIRECTIVE_TO_NIM"))
    m = cx.measure(F.col("uri"))
    both = there.unionByName(back).filter("nim != directive")
    return both.select("eu_celex", F.col("directive").alias("eu_work_uri"), F.col("nim").alias("nim_work_uri"), m["nim_celex"].alias("nim_celex"), F.col("p").alias("relation"), "direction", m["shape"].alias("shape"), m["database_id"].alias("database_id")).distinct()


ANSWER = "array<struct<eu_work_uri:string,nim_work_uri:string,uri:string,relation:string,direction:string>>"


def edges_of_answers(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relations, as :func:`edges` gives them, from looked-up answers (``key, status, answer, error``), and the keys that failed."""
    m = cx.measure(F.col("a.uri"))
    rows = answers.filter("status = 'FOUND'").select(F.upper("key").alias("eu_celex"), F.explode(F.from_json("answer", ANSWER)).alias("a"))
    found = rows.select("eu_celex", "a.eu_work_uri", "a.nim_work_uri", m["nim_celex"].alias("nim_celex"), "a.relation", "a.direction", m["shape"].alias("shape"), m["database_id"].alias("database_id"))
    return found.distinct(), answers.filter("status = 'ERROR'").select(F.col("key").alias("celex"), "error")


def logical_links(found: DataFrame) -> DataFrame:
    """One link for each act and measure with its sorted evidence."""
    evidence = F.array_sort(F.collect_set(F.struct("relation", "direction"))).alias("evidence")
    return found.groupBy("eu_celex", "eu_work_uri", "nim_work_uri", "nim_celex").agg(evidence)


def summary(asked: DataFrame, links: DataFrame) -> DataFrame:
    """One row: acts asked for, those with measures and without, links, and distinct measures; ``unique`` tells that no link is there twice."""
    n = asked.agg(F.count_distinct("celex").alias("asked"))
    found = links.agg(
        F.count_distinct("eu_celex").alias("covered"), F.count("*").alias("links"), F.count_distinct("nim_work_uri").alias("works"),
        (F.count("*") == F.count_distinct("eu_celex", "nim_work_uri", "nim_celex")).alias("unique"),
    )
    return n.join(found, F.lit(True)).withColumn("uncovered", F.col("asked") - F.col("covered"))


def work_uri(*candidates: Column, cellar_uuid: Column | None = None) -> Column:
    """The first candidate that is a web address, else the object's address."""
    tried = [F.when(c.rlike("^https?://"), c) for c in candidates]
    if cellar_uuid is not None:
        tried.append(F.concat(F.lit(CELLAR_URI), F.nullif(cellar_uuid, F.lit(""))))
    return F.coalesce(*tried)


def metadata(triples: DataFrame, works: DataFrame) -> DataFrame:
    """A row for each work: value, values and status of every field (null value unless unique)."""
    rows = triples.join(works.select(F.col("work").alias("s")).distinct(), "s", "right")
    rows = rows.select("s", "p", "o").distinct()
    out = []
    for name, predicate in FIELDS.items():
        values = F.array_sort(F.collect_set(F.when(F.col("p") == CDM + predicate, F.col("o"))))
        status = F.when(F.size(values) == 1, "UNIQUE").when(F.size(values) > 1, "MULTIPLE").otherwise("MISSING")
        out.append(F.struct(F.when(F.size(values) == 1, values[0]).alias("value"), values.alias("values"), status.alias("status")).alias(name))
    return rows.groupBy(F.col("s").alias("nim_work")).agg(*out)


def flat(fields: DataFrame) -> DataFrame:
    """Values only, and the names of the ambiguous fields."""
    ambiguous = F.array_compact(F.array(*(F.when(F.col(n)["status"] == "MULTIPLE", F.lit(n)) for n in FIELDS)))
    return fields.select("nim_work", *(F.col(n)["value"].alias(n) for n in FIELDS), ambiguous.alias("ambiguous_fields"))


def coverage(fields: DataFrame) -> DataFrame:
    """One row: works with a value, and with several, of each field."""
    return fields.agg(*(F.count_if(F.size(F.col(n)["values"]) > 0).alias(f"{n}_covered") for n in FIELDS), *(F.count_if(F.size(F.col(n)["values"]) > 1).alias(f"{n}_ambiguous") for n in FIELDS))
