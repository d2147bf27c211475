"""Deterministic identifiers and checksums as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the namespace that all name-based identifiers live in.
NAMESPACE = "ad63b8fa-8a8f-4bd6-98d0-96055806ea75"


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """Name-based UUID (version 5) of a text: SHA-1 with version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.conv(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8)).cast("string"), 10, 16))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12),
    )


def entity_id(kind: str, source_id: Column) -> Column:
    """Identifier of a text, unit or version of the national corpus."""
    return uuid5(F.concat(F.lit(f"LEGI:{kind}:"), source_id))


def joined(*parts: Column) -> Column:
    """Parts with a bar between them, nulls as empty parts."""
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def relation_id(*parts: Column) -> Column:
    return uuid5(F.concat(F.lit("LEGI:relation:"), joined(*parts)))


def provision_id(celex: Column, member: Column, kind: Column, path: Column) -> Column:
    """First 24 hexadecimal digits of the SHA-256 of the four parts."""
    return F.substring(F.sha2(joined(celex, member, kind, path), 256), 1, 24)


def checksum(text: Column) -> Column:
    return F.sha2(text, 256)


def evidence_fingerprint(**fields: Column) -> Column:
    """SHA-256 of the fields as JSON in the order of their names, nulls kept."""
    ordered = F.struct(*(fields[k].alias(k) for k in sorted(fields)))
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256)


def index_name(model: Column, dimension: Column) -> Column:
    """Name of a model's vector index: its dimension and the first ten digits of the SHA-1 of its name."""
    return F.concat_ws("_", F.lit("version_embedding_hnsw"), dimension.cast("string"), F.substring(F.sha1(F.encode(model, "UTF-8")), 1, 10))
