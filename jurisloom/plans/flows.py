"""The builds end to end: what the command lines of the corpus tools do, as functions over paths."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.merge import FILLED, OLD, Snapshots
from ..sources.archives import read_xml
from ..sources.jsonl import write_jsonl
from ..sources.remote import look_up, pending
from . import european, measures, national

#: Versions that are embedded and saved at a time.
EMBEDDED_AT_ONCE = 200_000


def table(spark: SparkSession, root: str, name: str) -> Snapshots:
    """A table under a corpus root."""
    kinds = dict(schemas.TABLES) | {
        "corpus": schemas.CORPUS, "import_log": schemas.LOG, "embedding_model": schemas.MODELS, "version_embedding": schemas.EMBEDDINGS,
        "eu_act": schemas.ACT, "eu_provision": schemas.EU_PROVISION,
    }
    return Snapshots(spark, f"{root}/{name}", kinds[name])


def register_corpus(spark: SparkSession, root: str, code: str, name: str, archive: str, url: str | None = None) -> str:
    """The corpus' row, made or renewed; a known address stays if none is given.  Gives its id."""
    ident = str(uuid.uuid5(national.SPACE, f"corpus:{code}"))
    row = spark.createDataFrame([(ident, code, name, url, archive, datetime.now(timezone.utc), {})], schemas.CORPUS)
    table(spark, root, "corpus").upsert(row, ["id"], {"source_url": FILLED, "metadata": OLD})
    return ident


def build_national(
    spark: SparkSession, source: str, root: str, excluded: tuple[str, ...] = national.EXCLUDED_STATES, code: str = "LEGI", name: str = "LEGI", url: str | None = None
) -> dict[str, int]:
    """Import an archive and log the run with its counts; one that fails leaves its row without an end."""
    corpus = register_corpus(spark, root, code, name, source.rstrip("/").rpartition("/")[2], url)
    log, run, began = table(spark, root, "import_log"), str(uuid.uuid4()), datetime.now(timezone.utc)
    log.append(spark.createDataFrame([(run, corpus, source, began, None, None)], schemas.LOG))
    stats = national.import_articles(spark, source, root, excluded)
    log.upsert(spark.createDataFrame([(run, corpus, source, began, datetime.now(timezone.utc), {k: int(v) for k, v in stats.items()})], schemas.LOG), ["id"])
    return stats


def vectorise(
    spark: SparkSession, root: str, encoder_factory: Callable[[], Callable[[list[str]], list[list[float]]]], model: str, dimension: int, state: str = "VIGUEUR", normalise: bool = True,
    at_once: int = EMBEDDED_AT_ONCE,
) -> int:
    """Embed the versions in force that have no current embedding; gives their number.

    ``at_once`` versions are embedded and saved at a time, so a run that stops
    loses one such part at most and the next run goes on from there.
    """
    models = table(spark, root, "embedding_model")
    known = {r["name"]: r["dimension"] for r in models.read().collect()}
    if known.get(model, dimension) != dimension:
        raise ValueError(f"{model} has {known[model]} dimensions, not {dimension}")
    models.upsert(spark.createDataFrame([(model, model, dimension, normalise)], schemas.MODELS), ["id"])
    versions, units, texts = (table(spark, root, n).read() for n in ("version", "unite", "texte"))
    stored = table(spark, root, "version_embedding")
    waiting = Snapshots(spark, f"{root}/_embedded", schemas.EMBEDDINGS)
    done = _saved_parts(spark, waiting)
    if done is not None:
        stored.replace(national.refreshed(stored.read(), done))
        _drop_parts(spark, waiting)
    todo = national.stale(versions, stored.read(), model, state)
    total = todo.count()
    parts = max(1, -(-total // at_once))
    place = F.pmod(F.xxhash64("id"), F.lit(parts))
    for k in range(parts if total else 0):
        documents = national.documents_to_embed(todo.filter(place == k), units, texts)
        waiting.replace(national.embed(documents, encoder_factory, model, dimension, normalise))
    if total:
        stored.replace(national.refreshed(stored.read(), _saved_parts(spark, waiting)))
        _drop_parts(spark, waiting)
    return total


def _saved_parts(spark: SparkSession, waiting: Snapshots) -> DataFrame | None:
    """All whole parts of embeddings not yet in the table."""
    whole = [f"{waiting.root}/v-{n:012d}" for n, done in waiting.versions() if done]
    return spark.read.schema(schemas.EMBEDDINGS).parquet(*whole) if whole else None


def _drop_parts(spark: SparkSession, waiting: Snapshots) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(waiting.root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def build_european(spark: SparkSession, zip_path: str, root: str, remote: DataFrame | None = None, transport_factory: Callable | None = None, batch: int = 250) -> dict[str, DataFrame]:
    """Inventory, identities, provisions, normalisation and import of an archive.

    Remote answers (``cellar_uuid, status, same_as``) come as a table or from a
    transport, and are kept: objects answered before aren't asked again.  Each
    stage is written once; audits go to ``root/audit``.
    """
    content = read_xml(spark, zip_path)
    european.inventory(content).write.mode("overwrite").parquet(f"{root}/inventory")
    members = spark.read.parquet(f"{root}/inventory")
    offline = european.decide_identity(european.weigh_candidates(members), members)
    if remote is None:
        answers = Snapshots(spark, f"{root}/remote", "cellar_uuid string, status string, same_as array<string>")
        if transport_factory is not None:
            work = pending(members.select("cellar_uuid").distinct(), answers.read(), "cellar_uuid")
            found = look_up(work, "cellar_uuid", transport_factory, batch)
            status = F.when(F.col("status") == "ERROR", "SPARQL_ERROR")
            found = found.select(F.col("key").alias("cellar_uuid"), status.alias("status"), F.coalesce(F.from_json("answer", "array<string>"), F.array().cast("array<string>")).alias("same_as"))
            answers.upsert(found, ["cellar_uuid"])
        remote = answers.read()
    european.reconcile(offline, european.classify_aliases(remote)).write.mode("overwrite").parquet(f"{root}/identity")
    identity = spark.read.parquet(f"{root}/identity")
    for name, df in european.identity_audits(identity).items():
        write_jsonl(df, f"{root}/audit/{name}")
    european.provisions(identity, members, content.select(F.col("path").alias("member"), "content")).write.mode("overwrite").parquet(f"{root}/parsed")
    parsed = spark.read.parquet(f"{root}/parsed")
    write_jsonl(parsed.select("cellar_uuid", "celex", "member", F.explode("warnings").alias("w")).select("cellar_uuid", "celex", "member", "w.*"), f"{root}/audit/warnings")
    write_jsonl(parsed.filter("parse_error is not null").select("cellar_uuid", "celex", "member", "parse_error"), f"{root}/audit/errors")
    rows = parsed.select(F.explode("provisions").alias("p")).select("p.*")
    normal = european.normalise(identity, rows)
    write_jsonl(normal["missing_targets"], f"{root}/audit/missing_targets")
    ready = european.prepare_import(european.canonical_act(normal["documents"]), normal["provisions"])
    write_jsonl(ready["invalid"].select("provision_id", "problems"), f"{root}/audit/invalid")
    # A later archive renews its own acts and provisions and leaves the others.
    ready["provisions"].write.mode("overwrite").parquet(f"{root}/_ready")
    mine = spark.read.schema(ready["provisions"].schema).parquet(f"{root}/_ready")
    acts, provisions = table(spark, root, "eu_act"), table(spark, root, "eu_provision")
    acts.upsert(ready["acts"], ["celex"])
    provisions.upsert(mine, ["provision_id"])
    out = {"acts": acts.read(), "provisions": provisions.read()}
    stored = out["provisions"].join(mine.select("provision_id"), "provision_id", "left_semi").count()
    european.check_import(rows.count(), mine.count() + ready["invalid"].count(), stored + ready["invalid"].count())
    return out | {"identity": identity, "relations": normal["relations"]}


def discover_measures(spark: SparkSession, identity: DataFrame, root: str, transport_factory: Callable, batch: int = 50) -> dict[str, DataFrame]:
    """Ask an endpoint for the national measures of the resolved directives; keys that failed are written too.

    Answers are kept under ``root/cache``: a run that stopped goes on from there.
    """
    asked = measures.directives(identity)
    answers = look_up(asked, "celex", transport_factory, batch, cache_uri=f"{root}/cache")
    answers.write.mode("overwrite").parquet(f"{root}/answers")
    found, failed = measures.edges_of_answers(spark.read.parquet(f"{root}/answers"))
    out = {"edges": found, "links": measures.logical_links(found), "failed": failed}
    for name, df in out.items():
        write_jsonl(df, f"{root}/{name}")
    return out


def build_measures(spark: SparkSession, identity: DataFrame, triples: DataFrame, root: str) -> dict[str, DataFrame]:
    """Implementing measures of the resolved directives and their metadata, as JSONL."""
    found = measures.edges(triples, measures.directives(identity))
    links = measures.logical_links(found)
    fields = measures.metadata(triples, links.select(F.col("nim_work_uri").alias("work")))
    out = {"edges": found, "links": links, "metadata": fields, "bindings": measures.flat(fields)}
    for name, df in out.items():
        write_jsonl(df, f"{root}/{name}")
    return out
