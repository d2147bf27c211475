"""The national corpus: article XML to texts, units, versions and relations, and their embeddings."""

from __future__ import annotations

import hashlib
import html
import json
import re
import uuid
from collections.abc import Callable, Iterator
from datetime import date
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.ids import NAMESPACE
from ..functions.text import BLOCK_TAGS, BREAK_TAGS, embedding_document, path_titles
from ..operators.dedup import last_filled, last_wins
from ..operators.merge import FILLED, NEW, OLD, Snapshots, keep_if_empty, object_merge
from ..sources.archives import read_xml

EXCLUDED_STATES = ("ABROGE",)
SPACE = uuid.UUID(NAMESPACE)
#: Bytes of a file in which an article's root tag must start.
HEAD_BYTES = 2048
def _name(kind: str, source: str) -> str:
    return str(uuid.uuid5(SPACE, f"LEGI:{kind}:{source}"))


def _text(node: ElementTree.Element | None, path: str | None = None) -> str:
    node = node.find(path) if path and node is not None else node
    return (node.text or "").strip() if node is not None else ""


def parse_date(value: str | None) -> date | None:
    value = (value or "").strip()
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", value) or value.startswith("2999-"):
        return None
    try:
        return date.fromisoformat(value)
    except ValueError:
        return None


def visible(node: ElementTree.Element | None) -> str:
    """Text of mixed content, with line breaks where blocks begin and end."""
    if node is None:
        return ""
    pieces, stack = [], [("open", node)]
    while stack:
        what, x = stack.pop()
        if what == "say":
            pieces.append(x)
            continue
        kind = x.tag.rpartition("}")[2].lower() if x is not node else ""
        after = [("say", "\n")] if kind in BLOCK_TAGS else []
        if x is not node and x.tail:
            after.append(("say", x.tail))
        pieces.append(("\n" if kind in BREAK_TAGS else "") + (x.text or ""))
        stack += reversed([("open", c) for c in x] + after)
    flat = html.unescape("".join(pieces)).replace("\xa0", " ")
    flat = re.sub(r"\n[ \t]+", "\n", re.sub(r"[ \t]+", " ", flat))
    return re.sub(r"\n{3,}", "\n\n", flat).strip()


def _titles(context: ElementTree.Element) -> list[dict]:
    head = context.find("TITRE_TXT")
    found = []
    if head is not None:
        found.append((head, (head.get("c_titre_court") or _text(head)).strip(), head.get("id_txt") or context.get("cid"), 0))
    level, node = 1, context.find("TM")
    while node is not None:
        title = node.find("TITRE_TM")
        if title is not None:
            found.append((title, _text(title), title.get("id"), level))
        level, node = level + 1, node.find("TM")
    return [{"id": i, "titre": t, "debut": x.get("debut"), "fin": x.get("fin"), "niveau": n} for x, t, i, n in found if t]


def _filled(x: str | None) -> str | None:
    return (x or "").strip() or None


def _upper(x: str | None) -> str | None:
    return (_filled(x) or "").upper() or None


def _whole(x: str | None) -> int | None:
    return int(x.strip()) if x and re.fullmatch(r"[+-]?\d{1,9}", x.strip()) else None


def _plain(x: str | None) -> str:
    return (x or "").strip()


def _as_is(x: str | None) -> str | None:
    return x


# Where an article's file keeps things.
NODES = {"common": "META/META_COMMUN", "meta": "META/META_SPEC/META_ARTICLE", "context": "CONTEXTE/TEXTE", "head": "CONTEXTE/TEXTE/TITRE_TXT"}
BODY, NOTE, HISTORY, LINKS = "BLOC_TEXTUEL/CONTENU", "NOTA/CONTENU", "VERSIONS/VERSION/LIEN_ART", "LIENS/LIEN"
# Columns by table, each from an element below a node or an attribute (@) of it, and how it is read.
COLUMNS = {
    "texte": {
        "type": ("context", "@nature", _upper), "numero": ("context", "@num", _filled), "nor": ("context", "@nor", _filled), "autorite": ("context", "@autorite", _filled),
        "ministere": ("context", "@ministere", _filled), "date_signature": ("context", "@date_signature", parse_date), "date_publication": ("context", "@date_publi", parse_date),
    },
    "unite": {"numero": ("meta", "NUM", _filled), "ordre": ("meta", "INT_ORDRE", _whole)},
    "version": {"etat": ("meta", "ETAT", _upper), "date_debut": ("meta", "DATE_DEBUT", parse_date), "date_fin": ("meta", "DATE_FIN", parse_date)},
}
# What goes to a table's metadata, in the same way.
METADATA = {
    "texte": {"titre_id": ("head", "@id_txt", _as_is), "titre_debut": ("head", "@debut", _as_is), "titre_fin": ("head", "@fin", _as_is)},
    "unite": {
        "origine": ("common", "ORIGINE", _plain), "nature": ("common", "NATURE", _plain), "ancien_id": ("common", "ANCIEN_ID", _plain), "url": ("common", "URL", _plain), "type_article": ("meta", "TYPE", _plain),
    },
    "version": {"type_article": ("meta", "TYPE", _plain), "url": ("common", "URL", _plain)},
}
# Attributes of a link by column.
LINK_COLUMNS = {
    "cible_source_id": ("id", _filled), "cible_texte_source_id": ("cidtexte", _filled), "cible_numero": ("num", _filled), "cible_nature_texte": ("naturetexte", _filled),
    "cible_numero_texte": ("numtexte", _filled), "cible_nor_texte": ("nortexte", _filled), "date_signature_texte": ("datesignatexte", parse_date),
}


class _Article:
    """One article's file: its nodes, and rows read by the tables above."""

    def __init__(self, content: bytes) -> None:
        self.root = ElementTree.fromstring(content)
        self.nodes = {name: self.root.find(path) for name, path in NODES.items()}
        self.id = self.value("common", "ID", _plain)
        self.state = self.value("meta", "ETAT", _upper)
        self.body = visible(self.root.find(BODY))

    def value(self, node: str, what: str, read: Callable):
        at = self.nodes[node]
        if at is None:
            return read(None)
        return read(at.get(what[1:]) if what.startswith("@") else at.findtext(what))

    def row(self, table: str, **more: object) -> dict:
        meta = {k: self.value(*spec) for k, spec in METADATA[table].items()}
        return more | {k: self.value(*spec) for k, spec in COLUMNS[table].items()} | {"metadata": meta | more.get("metadata", {})}

    def problem(self, excluded: tuple[str, ...]) -> str | None:
        """Why the article is left out: the first of these that holds."""
        checks = {
            "OTHER_ROOT": self.root.tag.rpartition("}")[2].upper() != "ARTICLE",
            "NO_META": self.nodes["common"] is None or self.nodes["meta"] is None,
            "NO_ID": not self.id,
            "EXCLUDED_STATE": self.state in excluded,
            "EMPTY_CONTENT": not self.body,
            "NO_CONTEXT": self.nodes["context"] is None,
        }
        return next((why for why, holds in checks.items() if holds), None)

    def history(self) -> list[tuple[str, str]]:
        """Begin and id of the article's versions as far as they have one, in the file's order."""
        found = [(_plain(x.get("debut") or "9999-12-31"), _plain(x.get("id"))) for x in self.root.iterfind(HISTORY)]
        return [(begin, i) for begin, i in found if i]

    def relations(self, unit: str) -> Iterator[dict]:
        for position, link in enumerate(self.root.iterfind(LINKS)):
            row = {c: read(link.get(name)) for c, (name, read) in LINK_COLUMNS.items()}
            row |= {
                "version_source_id": self.id, "source_unite_id": unit, "type_relation": _upper(link.get("typelien")) or "INCONNU", "sens": (_filled(link.get("sens")) or "").lower() or None,
                "libelle": " ".join("".join(link.itertext()).split()) or None, "metadata": {},
            }
            identity = (self.id, str(position), *(row[c] for c in ("type_relation", "sens", "cible_source_id", "cible_texte_source_id", "libelle")))
            yield row | {"id": _name("relation", "|".join(x or "" for x in identity))}


def parse_article(content: bytes, archive: str, path: str, excluded: tuple[str, ...] = EXCLUDED_STATES) -> dict:
    """An article's text, unit, version and relations, or why it was left out."""
    try:
        a = _Article(content)
        why = a.problem(excluded)
    except ElementTree.ParseError:
        why = "UNPARSEABLE"
    if why:
        return {"reject_reason": why, "texte": None, "unite": None, "version": None, "relations": []}
    history = a.history()
    keys = {"texte": a.value("context", "@cid", _filled) or f"UNKNOWN:{a.id}", "unite": min(history)[1] if history else a.id, "version": a.id}
    ids = {table: _name(table, key) for table, key in keys.items()}
    title = a.value("head", "@c_titre_court", _as_is) or _text(a.nodes["head"])
    own = {
        "texte": {"titre": _filled(title)},
        "unite": {"texte_id": ids["texte"], "type": "ARTICLE", "chemin": _titles(a.nodes["context"]), "metadata": {"version_ids": json.dumps([i for _, i in history])}},
        "version": {
            "unite_id": ids["unite"], "contenu": a.body, "nota": visible(a.root.find(NOTE)) or None, "checksum_sha256": hashlib.sha256(a.body.encode()).hexdigest(),
            "source_archive": archive, "source_path": path,
        },
    }
    rows = {table: a.row(table, id=ids[table], source_id=keys[table], **own[table]) for table in own}
    return {"reject_reason": None, "relations": list(a.relations(ids["unite"]))} | rows


def parsed(files: DataFrame, excluded: tuple[str, ...] = EXCLUDED_STATES) -> DataFrame:
    """Files whose head has an article's root tag, parsed; ``reject_reason`` is null for those kept."""
    run = F.udf(lambda content, archive, path: parse_article(bytes(content), archive, path, excluded), schemas.ARTICLE, useArrow=True)
    head = F.upper(F.decode(F.expr(f"substring(content, 1, {HEAD_BYTES})"), "ISO-8859-1"))
    return files.filter(F.contains(head, F.lit("<ARTICLE"))).select("archive", "seq", "path", run("content", "archive", "path").alias("a")).select("archive", "seq", "path", "a.*")


def tables(articles: DataFrame) -> dict[str, DataFrame]:
    """Texts, units, versions and relations of parsed articles, one row for each id.

    Later articles count; texts and units keep what a later one lacks, whatever
    the size of a batch.
    """
    kept = articles.filter("reject_reason is null").withColumn("__at", F.struct("archive", "seq", "path"))
    rows = lambda c: kept.select(f"{c}.*", "__at")
    relations = kept.select(F.explode("relations").alias("r"), "__at").select("r.*", "__at")
    return {
        "texte": last_filled(rows("texte"), ["id"], "__at"),
        "unite": last_filled(rows("unite").withColumn("chemin", F.when(F.size("chemin") > 0, F.col("chemin"))), ["id"], "__at"),
        "version": last_wins(rows("version"), ["id"], "__at").drop("__at"),
        "relation": last_wins(relations, ["id"], "__at").drop("__at"),
    }


def counters(scanned: DataFrame, articles: DataFrame) -> DataFrame:
    """One row of import counts."""
    own = articles.agg(
        F.count("*").alias("articles_xml"), F.count_if(F.col("reject_reason").isNull()).alias("imported"),
        F.count_if(F.col("reject_reason").isNotNull()).alias("ignored"), F.coalesce(F.sum(F.when(F.col("reject_reason").isNull(), F.size("relations"))), F.lit(0)).alias("relations"),
    )
    return scanned.agg(F.count("*").alias("xml_scanned")).join(own, F.lit(True))


def merge_policy(table: str) -> tuple[dict, str]:
    """How a table's columns merge with an earlier import; metadata are merged key by key, the later value counts."""
    metadata = object_merge(F.col("o.metadata"), F.col("n.metadata"))
    return {
        "texte": ({"metadata": metadata}, FILLED),
        "unite": ({"type": NEW, "chemin": keep_if_empty("chemin"), "metadata": metadata}, FILLED),
        "version": ({"metadata": metadata}, NEW),
        "relation": ({"type_relation": NEW, "sens": NEW, "libelle": NEW, "metadata": metadata}, OLD),
    }[table]


def import_articles(spark: SparkSession, source: str, root: str, excluded: tuple[str, ...] = EXCLUDED_STATES) -> dict[str, int]:
    """Import an archive, folder or file into the snapshots under ``root``; gives the counts.

    Parsing happens once: its result is written before the tables are made.
    """
    files = read_xml(spark, source)
    path = f"{root}/_parsed"
    parsed(files, excluded).write.mode("overwrite").parquet(path)
    articles = spark.read.parquet(path)
    for name, df in tables(articles).items():
        policy, default = merge_policy(name)
        Snapshots(spark, f"{root}/{name}", schemas.TABLES[name]).upsert(df, ["id"], policy, default)
    return counters(files.select("path"), articles).head().asDict()


def stale(versions: DataFrame, embeddings: DataFrame, model: str, state: str = "VIGUEUR") -> DataFrame:
    """Versions in force without an embedding of the model, or with one of other content."""
    have = embeddings.filter(F.col("model") == model).select(F.col("version_id").alias("id"), "content_checksum")
    joined = versions.filter(F.col("etat") == state).join(have, "id", "left")
    return joined.filter(F.col("content_checksum").isNull() | (F.col("content_checksum") != F.col("checksum_sha256"))).drop("content_checksum")


def documents_to_embed(versions: DataFrame, units: DataFrame, texts: DataFrame) -> DataFrame:
    u = units.select(F.col("id").alias("unite_id"), "texte_id", "numero", "chemin")
    t = texts.select(F.col("id").alias("texte_id"), F.col("type").alias("type_texte"), "titre")
    joined = versions.join(u, "unite_id").join(t, "texte_id", "left")
    titles = path_titles(F.transform("chemin", lambda p: F.struct(p["titre"].alias("titre"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("libelle"))))
    return joined.select("id", "checksum_sha256", embedding_document(F.col("type_texte"), F.col("titre"), F.col("numero"), titles, F.col("contenu")).alias("document"))


def embed(documents: DataFrame, encoder_factory: Callable[[], Callable[[list[str]], list[list[float]]]], model: str, dimension: int, normalise: bool = True, batch: int = 64) -> DataFrame:
    """``version_id, model, content_checksum, embedding``; the factory makes each worker's encoder.

    A wrong number or size of vectors is an error.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder_factory()
        for frame in frames:
            for k in range(0, len(frame), batch):
                part = frame.iloc[k : k + batch]
                vectors = encode(part["document"].tolist())
                if len(vectors) != len(part) or any(len(v) != dimension for v in vectors):
                    raise ValueError("the encoder gave other vectors than it was asked for")
                if normalise:
                    vectors = [[x / n for x in v] if (n := sum(x * x for x in v) ** 0.5) else list(v) for v in vectors]
                yield pd.DataFrame({"version_id": part["id"].values, "model": model, "content_checksum": part["checksum_sha256"].values, "embedding": vectors})

    return documents.mapInPandas(run, "version_id string, model string, content_checksum string, embedding array<float>")


def refreshed(embeddings: DataFrame, new: DataFrame) -> DataFrame:
    """Embeddings with new ones in place of those of the same version and model."""
    return embeddings.join(new.select("version_id", "model"), ["version_id", "model"], "left_anti").unionByName(new)


class FallbackEncoder:
    """Encoders in order: the first that answers is kept; all must share model and dimension."""

    def __init__(self, encoders: list) -> None:
        if not encoders or len({(e.model, e.dimension) for e in encoders}) != 1:
            raise ValueError("encoders of one model and dimension are needed")
        self.encoders, self.at = encoders, 0
        self.model, self.dimension = encoders[0].model, encoders[0].dimension

    def __call__(self, texts: list[str]) -> list[list[float]]:
        problem: Exception | None = None
        for step in range(len(self.encoders)):
            k = (self.at + step) % len(self.encoders)
            try:
                found = self.encoders[k](texts)
            except ConnectionError as e:
                problem = e
                continue
            self.at = k
            return found
        raise ConnectionError("no encoder answers") from problem
