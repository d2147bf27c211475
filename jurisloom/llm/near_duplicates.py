"""N-gram Jaccard join by MinHash banding, verified on full shingle sets.

1. One pass gives each document a key of its shingle set and the hashes of its
   signature's bands.  Documents of equal sets are one text from here on.
2. Texts meet on band hashes; each points to the smallest text of its bucket,
   so a bucket of any size gives as many links as it has texts, and connected
   components of these links hold all candidate pairs.
3. Texts of a component are verified together.  A large component is dealt
   into blocks and every pair of blocks is a group of its own; a pair of texts
   that share a band is compared in exactly one group, on the full sets, and
   only its effect (counts of links, a spanning forest) leaves the group.
4. Components of the verified links are the classes.

Documents' texts are read again only for candidates, found by a bitmap of
fixed size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_arrow, materialise, slices
from .components import connected_components
from .shingles import U, _odd, mix, sets, shingles

THRESHOLD = 0.8
RECALL = 0.9999
#: Hash functions of a signature at most.
HASHES = 80
#: Texts, and shingles, of a block in verification, about.
BLOCK_TEXTS, BLOCK_SHINGLES = 256, 1 << 20
#: Bits of a candidate bitmap at least (2 MB) and at most (32 MB), in rows of 32768; bits for each candidate up to that.
BITMAP_BITS, MOST_BITMAP_BITS = 1 << 24, 1 << 28
BITMAP_ROW, BITS_EACH = 32_768, 16


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """Bands and rows that find a pair at the threshold with at least the target recall.

    Of the choices within the number of hashes, the one with most rows: it lets
    the fewest pairs below the threshold through.
    """
    best = None
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= hashes:
            best = bands, rows
    if best is None:
        raise ValueError("no bands reach this recall with so few hashes")
    return best


def band_hashes(h: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes (texts x bands) of shingles grouped from ``starts``, no group empty."""
    out = np.empty((len(starts), bands), np.uint64)
    for band in range(bands):
        total = np.full(len(starts), _odd(10_000 + band))
        for row in range(rows):
            k = 100 + band * rows + row
            total += mix(np.minimum.reduceat(h * _odd(k) + _odd(5000 + k), starts)) * _odd(20_000 + row)
        out[:, band] = mix(total)
    return out


def signatures(df: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    """``id, text_hash, key, n, bands`` of every row; key is null where a text has no shingle."""
    source = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                n_docs = batch.num_rows
                doc, h = shingles(batch.column("text"))
                starts = np.flatnonzero(np.diff(doc, prepend=-1))
                cuts = np.append(starts, len(doc))
                keys: list[bytes | None] = [None] * n_docs
                counts = np.zeros(n_docs, np.int64)
                for d, a, b in zip(doc[starts].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    own = np.unique(h[a:b])
                    keys[d], counts[d] = set_key(own), len(own)
                per_doc = np.zeros((n_docs, bands), np.int64)
                if len(starts):
                    per_doc[doc[starts]] = band_hashes(h, starts, bands, rows).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n_docs + 1, dtype=np.int32) * bands), pa.array(per_doc.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("text_hash"), pa.array(keys, pa.binary()), pa.array(counts), lists],
                    names=["id", "text_hash", "key", "n", "bands"],
                )

    return map_arrow(source, run, "id long, text_hash long, key binary, n long, bands array<long>")


def set_key(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def bitmap_bits(n: int) -> int:
    """Bits of a bitmap for ``n`` candidates: a power of two between the bounds."""
    return max(BITMAP_BITS, min(MOST_BITMAP_BITS, 1 << max(1, n * BITS_EACH - 1).bit_length()))


def bitmap_of(ids: Column, df: DataFrame, bits: int = BITMAP_BITS) -> DataFrame:
    """A bitmap of hashed values as at most ``bits / BITMAP_ROW`` rows of 4 KB."""
    at = F.pmod(ids, F.lit(bits))
    return df.groupBy((at / BITMAP_ROW).cast("int").alias("bitmap_row")).agg(
        F.bitmap_construct_agg((at % BITMAP_ROW).cast("long")).alias("bitmap")
    )


def maybe_in(df: DataFrame, ids: Column, bitmap: DataFrame, bits: int = BITMAP_BITS) -> DataFrame:
    """``df`` with ``__maybe``: false where the hashed value surely isn't in the bitmap.

    The bitmap is broadcast: 2 to 32 MB whatever the input.  With more candidates than
    that serves, more rows are ``maybe`` and go through the join that follows.
    """
    at = F.pmod(ids, F.lit(bits))
    out = df.withColumn("__at", at).join(F.broadcast(bitmap), (F.col("__at") / BITMAP_ROW).cast("int") == F.col("bitmap_row"), "left")
    bit = F.col("__at") % BITMAP_ROW
    byte = F.conv(F.hex(F.expr("substring(bitmap, cast((__at % 32768) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    found = F.coalesce(F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return out.withColumn("__maybe", found).drop("__at", "bitmap_row", "bitmap")


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> list[int]:
    """Smallest member of each item's component."""
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(left.tolist(), right.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def intersections(own: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sorted sets.

    Few pairs one by one; many by products of the incidence matrix, a slice of
    shared shingles at a time.
    """
    if len(left) <= 4 * len(own):
        return np.array([len(np.intersect1d(own[a], own[b], assume_unique=True)) for a, b in zip(left, right, strict=True)], np.int64)
    flat = np.concatenate(own)
    doc = np.repeat(np.arange(len(own)), [len(x) for x in own])
    _, col, n = np.unique(flat, return_inverse=True, return_counts=True)
    shared = n[col] > 1
    doc, col = doc[shared], col[shared]
    if not len(col):
        return np.zeros(len(left), np.int64)
    _, col = np.unique(col, return_inverse=True)
    order = np.argsort(col, kind="stable")
    doc, col = doc[order], col[order]
    total = np.zeros((len(own), len(own)), np.float32)
    width = 4096
    for a in range(0, int(col[-1]) + 1, width):
        i, j = np.searchsorted(col, (a, a + width))
        m = np.zeros((len(own), width), np.float32)
        m[doc[i:j], col[i:j] - a] = 1
        total += m @ m.T
    return total[left, right].astype(np.int64)


def verify(
    key: list[bytes], texts: pa.Array, copies: np.ndarray, block: np.ndarray, two_blocks: bool, bands: int, rows: int, threshold: float
) -> tuple:
    """Links among the texts of one group (two blocks: only between them, even if one of them got no text).

    ``copies`` are numbers of documents.  Returns the indices kept (one for each
    key whose text has this key), links in documents and in texts, and roots.
    """
    own = sets(texts)
    first: dict[bytes, int] = {}
    for k, s in enumerate(own):
        if len(s) and set_key(s) == key[k]:
            first.setdefault(key[k], k)
    keep = sorted(first.values(), key=lambda k: key[k])
    own, copies, block = [own[k] for k in keep], copies[keep], block[keep]
    n = len(keep)
    if n < 2:
        return keep, np.zeros(n, np.int64), np.zeros(n, np.int64), list(range(n))
    starts = np.cumsum([0, *(len(s) for s in own)])[:-1]
    sig = band_hashes(np.concatenate(own), starts, bands, rows)
    near = np.zeros((n, n), bool)
    for b in range(bands):
        near |= sig[:, b, None] == sig[None, :, b]
    if two_blocks:
        near &= block[:, None] != block[None, :]
    left, right = np.nonzero(np.triu(near, 1))
    size = np.array([len(s) for s in own], np.int64)
    both = intersections(own, left, right)
    ok = both >= threshold * (size[left] + size[right] - both) - 1e-9
    left, right = left[ok], right[ok]
    links, text_links = np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.add.at(links, left, copies[right])
    np.add.at(links, right, copies[left])
    np.add.at(text_links, left, 1)
    np.add.at(text_links, right, 1)
    return keep, links, text_links, _roots(n, left, right)


def similarity_classes(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL
) -> DataFrame:
    """A row for each row of ``df``: ``id, text_hash, class_id, n_links, n_text_links``.

    ``class_id`` is the smallest id of the row's class (documents joined by links
    of similarity ``threshold`` or more; null ids count as largest), ``n_links`` the number of other documents it is linked to, copies
    included, ``n_text_links`` the number of other shingle sets.  Texts without
    a word (null, empty) are linked to nothing and a class of their own each.
    Repeated rows are copies of each other.  An empty table gives an empty table.
    Ids are whole numbers or cast to such; other columns are left out.
    """
    bands, rows = choose_bands(threshold, recall)
    docs = materialise(signatures(df, id_col, text_col, bands, rows), "signatures")
    texts = docs.filter("key is not null").groupBy("key", "n", "bands").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    texts = materialise(texts, "texts")

    met = texts.select("key", F.explode("bands").alias("h"))
    # Sides that are unique in the key are written before joins, so that the joins can split hot keys.
    lead = materialise(met.groupBy("h").agg(F.min("key").alias("lead"), F.count("*").alias("met")).filter("met > 1").drop("met"), "leads")
    parts = connected_components(met.join(lead, "h").filter("key != lead"), "key", "lead")
    members = materialise(parts.join(texts.select(F.col("key").alias("node"), "n", "first_id", "copies"), "node"), "members")
    size = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    size = materialise(size, "sizes")
    members = materialise(
        members.join(size, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "blocks"
    )

    bits = bitmap_bits(members.count())
    bitmap = materialise(bitmap_of(F.xxhash64("first_id"), members, bits), "bitmap")
    again = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    again = maybe_in(again, F.xxhash64("id"), bitmap, bits).filter("__maybe").drop("__maybe")
    found = members.join(again, F.col("first_id").eqNullSafe(F.col("id")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = found.select("root", "node", "copies", "block", "text", other.alias("other"))
    dealt = dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other")

    def check(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, low, high = (x.as_py() for x in group)
        t = table.combine_chunks()
        key = t["node"].to_pylist()
        keep, links, text_links, roots = verify(
            key, t["text"].combine_chunks() if isinstance(t["text"], pa.ChunkedArray) else t["text"],
            t["copies"].to_numpy(), t["block"].to_numpy(), low != high, bands, rows, threshold,
        )
        return pa.table(
            {"node": pa.array([key[k] for k in keep], pa.binary()), "links": links, "text_links": text_links, "near": pa.array([key[keep[r]] for r in roots], pa.binary())}
        )

    verified = dealt.groupBy("root", "low", "high").applyInArrow(check, "node binary, links long, text_links long, near binary")
    verified = materialise(verified, "verified")
    classes = connected_components(verified.filter("node != near"), "node", "near").withColumnRenamed("root", "class")
    linked = verified.groupBy("node").agg(F.sum("links").alias("links"), F.sum("text_links").alias("text_links"))
    labels = texts.select(F.col("key").alias("node"), "first_id", "copies").join(classes, "node", "left").join(linked, "node", "left")
    labels = labels.withColumn("class", F.coalesce("class", "node"))
    labels = materialise(labels, "labels")
    class_id = materialise(labels.groupBy("class").agg(F.min("first_id").alias("class_id")), "class-ids")
    labels = labels.join(class_id, "class").select(
        F.col("node").alias("key"), "class", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("text_links", F.lit(0)).alias("n_text_links")
    )
    out = docs.select("id", "text_hash", "key").join(materialise(labels, "class-labels"), "key", "left")
    return out.select(
        "id", "text_hash", "class", F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_text_links", F.lit(0)).cast("long").alias("n_text_links"),
    )


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with one row of each class: that of the smallest id (then of the text's hash).

    Rows without a word all stay, columns and their names too, an empty table stays
    empty; of repeated rows one stays.  Most rows never move: a bitmap tells which
    may have to go, and only those meet the list of rows to drop.
    """
    rows = materialise(similarity_classes(df, id_col, text_col, threshold), "classes")
    grouped = materialise(rows.filter("class is not null").groupBy("class", "id", "text_hash").agg(F.count("*").alias("times")), "class-rows")
    first = grouped.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")).alias("first"))
    marked = grouped.join(materialise(first, "class-first"), "class").withColumn("stays", F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.text_hash")))
    special = materialise(marked.filter("not stays or times > 1").select("id", "text_hash", "stays"), "dropped")
    bits = bitmap_bits(special.count())
    bitmap = materialise(bitmap_of(F.xxhash64("id", "text_hash"), special, bits), "dropped-bitmap")
    # A row goes as one value, so its columns may have any names.
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    keyed = df.select(row, F.col(f"`{id_col}`").cast("long").alias("own_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("own_hash"))
    keyed = maybe_in(keyed, F.xxhash64("own_id", "own_hash"), bitmap, bits)
    asked = keyed.filter("__maybe").join(special, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("text_hash")), "left")
    repeated = asked.filter("stays").dropDuplicates(["own_id", "own_hash"])
    kept = [part.select("row") for part in (keyed.filter("not __maybe"), asked.filter("stays is null"), repeated)]
    return kept[0].union(kept[1]).union(kept[2]).select("row.*")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near copies among all documents, and how many each is linked to."""
    return similarity_classes(documents(spark, sf_dir, "doc_id", "text")).select(F.col("id").alias("doc_id"), "class_id", "n_links", "n_text_links")
