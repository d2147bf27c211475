"""Postings of provisions: the stored side of full-text search.

A row for each lexeme and provision with its places.  Files hold ranges of
lexemes in order, so a search reads the row groups of its own terms and no text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fulltext
from ..functions.french import lexeme
from ..operators.merge import Snapshots

WORDS = re.compile(r"[^\W_]+")
POSTINGS = "lexeme string, provision_id string, places array<struct<pos:int,weight:double>>"


def postings(provisions: DataFrame, config: str = "french") -> DataFrame:
    """Postings of ``provision_id, label, text``: words of the label weigh A, those of the text B and stand behind it.

    Narrow: places are gathered within a provision, batch by batch.
    """
    lex = (lambda w: w) if config == "simple" else lexeme
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("weight", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, owners, counts, pos, weight = [], [], [], [], []
            for k, (label, text) in enumerate(zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                head = [lex(w) for w in WORDS.findall((label or "").lower())]
                # The text's positions go on from the label's last lexeme; stop words after it don't count.
                last = max((i for i, w in enumerate(head, 1) if w), default=0)
                at: dict[str, list[int]] = {}
                for i, w in enumerate(head, 1):
                    at.setdefault(w, []).append(-i)
                for i, w in enumerate(map(lex, WORDS.findall((text or "").lower())), last + 1):
                    at.setdefault(w, []).append(i)
                at.pop("", None)
                names += at
                owners += [k] * len(at)
                for places in at.values():
                    counts.append(len(places))
                    pos += places
            signed = np.array(pos, np.int32)
            weight = np.where(signed < 0, fulltext.WEIGHTS["A"], fulltext.WEIGHTS["B"])
            items = pa.StructArray.from_arrays([pa.array(np.abs(signed)), pa.array(weight)], fields=list(kind.value_type))
            offsets = np.append(0, np.cumsum(counts, dtype=np.int64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), batch.column("provision_id").take(pa.array(owners, pa.int64())), pa.ListArray.from_arrays(pa.array(offsets), items)],
                names=["lexeme", "provision_id", "places"],
            )

    return provisions.select(F.col("provision_id").cast("string").alias("provision_id"), F.col("label").cast("string").alias("label"), "text").mapInArrow(run, POSTINGS)


class SearchIndex:
    """Stored postings."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.table = Snapshots(spark, root, POSTINGS)

    def build(self, provisions: DataFrame, config: str = "french") -> None:
        self.table.replace(postings(provisions, config).repartitionByRange("lexeme", "provision_id").sortWithinPartitions("lexeme", "provision_id"))

    def refresh(self, changed: DataFrame, config: str = "french") -> None:
        """Postings of changed provisions in place of their old ones."""
        kept = self.table.read().join(changed.select("provision_id"), "provision_id", "left_anti")
        new = kept.unionByName(postings(changed, config))
        self.table.replace(new.select("lexeme", "provision_id", "places").repartitionByRange("lexeme", "provision_id").sortWithinPartitions("lexeme", "provision_id"))

    def read(self) -> DataFrame:
        return self.table.read()


def found(index: DataFrame, query: fulltext.Query) -> DataFrame:
    """``provision_id, score`` of all that match.  Reads the postings of the query's terms only."""
    wanted = index.filter(F.col("lexeme").isin([*query.terms, *query.unwanted]))
    hit = F.transform("places", lambda p: F.struct(p["pos"].alias("pos"), F.col("lexeme").alias("term"), p["weight"].alias("weight")))
    rows = wanted.groupBy("provision_id").agg(F.flatten(F.collect_list(hit)).alias("hits")).filter(fulltext.matches_places(query, F.col("hits")))
    mine = F.filter("hits", lambda h: h["term"].isin(list(query.terms)))
    return rows.select("provision_id", fulltext.rank_places(query, mine).alias("score"))
