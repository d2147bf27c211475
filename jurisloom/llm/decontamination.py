"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by the number of their shingles and documents by
theirs.  For each pair of classes a one-permutation MinHash of the document is
taken: its shingles fall into bins and each bin keeps its smallest hash.  The
number of bins follows from both sizes, so that an item of which the
threshold's share is contained shares a bin's minimum with the document except
with probability ``MISS``: short items in long documents get many bins.  Where
nearly every shingle would have to be kept, all are.  A shared minimum makes a
candidate, which is verified exactly: the item's shingles are looked up in the
document's whole set and compared as words.  Items of fewer words than a
shingle has are looked up among all runs of as many words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_arrow, slices
from .shingles import SHINGLE, U, runs, shingles_of, words, written_shingles

THRESHOLD = 0.8
MISS = 1e-6
#: Text of the items that are broadcast together; more items are searched in several passes.
BLOCK_BYTES = 32 << 20
FILTER_BITS = 22


def kept_share(item_shingles: int, threshold: float = THRESHOLD, miss: float = MISS) -> float:
    """Probability with which a shingle must be its bin's minimum, for items of at least this size."""
    return 1 - miss ** (1 / math.ceil(threshold * item_shingles))


def load_for(share: float) -> float:
    """Shingles a bin may get on average so that one is its minimum with probability ``share``.

    Solves ``(1 - exp(-x)) / x = share``; 0 says that all shingles have to be kept.
    """
    if share > 0.9:
        return 0.0
    low, high = 1e-6, 1e6
    for _ in range(80):
        x = (low + high) / 2
        if -math.expm1(-x) / x > share:
            low = x
        else:
            high = x
    return low


class Index:
    """Items by size class: their shingle hashes, and who has them."""

    def __init__(self, items: list[tuple[int, str]], threshold: float) -> None:
        self.items, self.threshold = items, threshold
        texts = pa.array([t for _, t in items], pa.string())
        doc, h, *_ = words(texts)
        n_words = np.bincount(doc, minlength=len(items))
        doc, h = shingles_of(doc, h)
        cuts = np.searchsorted(doc, np.arange(len(items) + 1))
        self.hashes = [np.unique(h[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.classes = []
        size = np.array([len(x) for x in self.hashes])
        for k in np.unique(np.log2(size[size > 0]).astype(int)):
            mine = np.flatnonzero((size > 0) & (np.log2(np.maximum(size, 1)).astype(int) == k))
            flat = np.concatenate([self.hashes[i] for i in mine])
            owner = np.repeat(mine, size[mine])
            order = np.argsort(flat, kind="stable")
            table = np.zeros(1 << FILTER_BITS, bool)
            table[flat & U((1 << FILTER_BITS) - 1)] = True
            self.classes.append((load_for(kept_share(2 ** int(k), threshold)), flat[order], owner[order], table))
        self.written = {}
        #: Items of fewer words than a shingle has, by number of words and hash.
        self.short: dict[int, dict[int, list[int]]] = {}
        for i in np.flatnonzero((n_words > 0) & (n_words < SHINGLE)).tolist():
            self.short.setdefault(int(n_words[i]), {}).setdefault(int(self.hashes[i][0]), []).append(i)

    def item(self, i: int) -> set[tuple[str, ...]]:
        if i not in self.written:
            self.written[i] = written_shingles(self.items[i][1])
        return self.written[i]

    def candidates(self, doc: np.ndarray, h: np.ndarray, n_docs: int) -> np.ndarray:
        """Sorted ``document * items + item`` numbers of pairs that share a minimum."""
        size = np.bincount(doc, minlength=n_docs)
        upper = 2.0 ** np.ceil(np.log2(np.maximum(size, 1)))
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        found = [np.empty(0, np.int64)]
        for load, flat, owner, table in self.classes:
            if load:
                bins = np.ceil(upper / load).astype(U)
                place = ((h >> U(32)) * bins[doc]) >> U(32)
                smallest = np.ones(len(h), bool)
                smallest[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])
            else:
                smallest = np.ones(len(h), bool)
            hit = np.flatnonzero(smallest & table[h & U((1 << FILTER_BITS) - 1)])
            low, high = np.searchsorted(flat, h[hit], "left"), np.searchsorted(flat, h[hit], "right")
            n = high - low
            hit, low, n = hit[n > 0], low[n > 0], n[n > 0]
            if len(hit):
                at = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                found.append(np.repeat(doc[hit], n) * len(self.items) + owner[at])
        return np.unique(np.concatenate(found))

    def inside(self, w_doc: np.ndarray, w_hash: np.ndarray, w_start: np.ndarray, w_end: np.ndarray, data: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Short items within documents of more words, like ``search``."""
        out, count = [], np.bincount(w_doc)
        for n, owners in self.short.items():
            h = runs(w_hash, n)
            doc = w_doc[: len(h)]
            at = np.flatnonzero((doc == w_doc[n - 1 :]) & (count[doc] > n) & np.isin(h, np.array(list(owners), U)))
            order = at[np.lexsort((h[at], doc[at]))]
            new = np.ones(len(order), bool)
            new[1:] = (doc[order[1:]] != doc[order[:-1]]) | (h[order[1:]] != h[order[:-1]])
            for p in order[new].tolist():
                said = tuple(data[w_start[x] : w_end[x]].tobytes().decode() for x in range(p, p + n))
                out += [(int(doc[p]), i, 1, 1) for i in owners[int(h[p])] if said in self.item(i)]
        return out

    def search(self, texts: pa.Array, short_inside: bool = False) -> list[tuple[int, int, int, int]]:
        """``document, item, contained shingles, item's shingles`` of verified pairs."""
        w_doc, w_hash, w_start, w_end, data = words(texts)
        doc, h = shingles_of(w_doc, w_hash)
        if not len(doc):
            return []
        out = self.inside(w_doc, w_hash, w_start, w_end, data) if short_inside and self.short else []
        cuts, first_word = np.searchsorted(doc, np.arange(len(texts) + 1)), np.searchsorted(w_doc, np.arange(len(texts) + 1))
        for pair in self.candidates(doc, h, len(texts)).tolist():
            d, i = divmod(pair, len(self.items))
            own = h[cuts[d] : cuts[d + 1]]
            place = np.flatnonzero(np.isin(own, self.hashes[i]))
            need = self.threshold * len(self.hashes[i]) - 1e-9
            if len(place) < need:
                continue
            _, once = np.unique(own[place], return_index=True)
            n_words = min(SHINGLE, int(first_word[d + 1] - first_word[d]))
            mine = self.item(i)
            same = 0
            for p in place[once]:
                w = first_word[d] + p
                said = tuple(data[w_start[x] : w_end[x]].tobytes().decode() for x in range(w, w + n_words))
                same += said in mine
            if same >= self.threshold * len(mine) - 1e-9:
                out.append((d, i, same, len(mine)))
        return out


def _blocks(items: DataFrame, item_col: str, text_col: str, threshold: float) -> Iterator[Index]:
    """Indexes over all items, each of about ``BLOCK_BYTES`` of text at most."""
    rows = items.select(F.col(item_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n = max(1, math.ceil(total / BLOCK_BYTES))
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        found = [(r["id"], r["text"]) for r in part.orderBy("id", "text").collect()]
        if found:
            yield Index(found, threshold)


HITS = "item_id long, doc_id long, contained long, item_shingles long"


def containment_hits(
    df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    threshold: float = THRESHOLD, short_inside: bool = False,
) -> DataFrame:
    """``item_id, doc_id, contained, item_shingles, containment`` of every pair at the threshold.

    An item of one to four words is found only in documents of just these
    words, with ``short_inside`` wherever they stand in a row.  Null and empty texts on either side match nothing; repeated rows
    give a row each.  Narrow over the documents; items are broadcast in blocks
    of bounded size, one pass over the documents for each.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for index in _blocks(items, item_col, item_text_col, threshold):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids = [i for i, _ in shared.value.items]
            for whole in batches:
                for batch in slices(whole, "text"):
                    hits = shared.value.search(batch.column("text"), short_inside)
                    doc_id = batch.column("doc_id").to_pylist() if hits else []
                    yield pa.RecordBatch.from_pydict(
                        {
                            "item_id": pa.array([ids[i] for _, i, _, _ in hits], pa.int64()), "doc_id": pa.array([doc_id[d] for d, *_ in hits], pa.int64()),
                            "contained": pa.array([c for *_, c, _ in hits], pa.int64()), "item_shingles": pa.array([n for *_, n in hits], pa.int64()),
                        }
                    )

        found = map_arrow(docs, run, HITS)
        out = found if out is None else out.union(found)
    if out is None:
        out = spark.createDataFrame([], HITS)
    return out.withColumn("containment", F.col("contained") / F.col("item_shingles"))


def decontaminate(df: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, short_inside: bool = False) -> DataFrame:
    """``df`` without the rows that contain an item (see ``containment_hits``).  Narrow.

    Other rows stay as they are, repeated ones too, with all columns whatever their
    names; null and empty texts contain nothing and stay; an empty table of either kind drops nothing.
    """
    spark = df.sparkSession
    for index in _blocks(items, item_col, item_text_col, threshold):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, text_col):
                    stays = np.ones(batch.num_rows, bool)
                    stays[[d for d, *_ in shared.value.search(batch.column(text_col), short_inside)]] = False
                    yield batch.filter(pa.array(stays))

        df = map_arrow(df, run, df.schema)
    return df


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in all documents."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return containment_hits(documents(spark, sf_dir, "doc_id", "text"), items, short_inside=True)
