"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

Terms are runs of five words (fewer words: all of them; no word: the text
itself), weighted by how often they occur.  For each of ``SAMPLES`` samples and
each term ``t`` of weight ``w``, hashes of ``t`` and the sample's number give
``r, c ~ Gamma(2, 1)`` and ``b ~ U(0, 1)``, and

    z = floor(ln w / r + b),   ln a = ln c - r (z - b + 1).

The sample is the ``(t, z)`` of the smallest ``a`` of all terms; two texts have
the same sample with a probability equal to their generalised Jaccard
similarity (sum of minima over sum of maxima).  Its 32-bit hash stands for it.

Only draws that can win are carried out.  With ``x, d, e`` exponential and

    c = x + d,   r = e + ln(c / x),   b = e / r,

``r``, ``c`` and ``b`` are independent and distributed as above (a sum of two
exponentials is Gamma(2, 1) and independent of their ratio, which is uniform),
and ``a = x`` where ``w = 1``.  So 16 bits of a hash, which bound ``x``, tell for
most draws that ``a`` is over ``REACH / W``, ``W`` being the weight of all terms.
The smallest ``a`` of a sample is exponential with rate ``W``, hence over this
limit with a probability of ``exp(-REACH)``, six in a million; then the draw of
the text's first term stands, so collision rates are within twelve in a million
of the similarity.  A text costs about ``SAMPLES * REACH`` draws,
however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, text_or_empty
from .ranges import bounds_of, bucket_of

SAMPLES = 128
SHINGLE = 5
#: Draws over this number divided by the weight of the text aren't carried out.
REACH = 12.0
#: Samples that one hash decides on, by this many bits each.
CHUNKS, CHUNK = 4, 1 << 16
#: Text of a bucket of neighbouring documents, about.
BUCKET_BYTES = 8 << 20


def terms(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with ``term`` (sorted hashes of the text's terms, repeats kept) and ``ends`` (where each one's repeats end; null: none repeats).

    Each step is a column of its own that the next uses more than once, so no
    step is computed twice.
    """
    words = F.array_remove(F.split(F.lower(F.col(text_col)), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")
    df = df.withColumn("word", words)
    # A text without a word is its own only word.
    df = df.withColumn("word", F.when(F.size("word") > 0, F.transform("word", lambda w: F.xxhash64(w))).otherwise(F.array(F.xxhash64(F.lit(0), F.col(text_col)))))
    run = lambda i: F.xxhash64(*(F.get("word", i + k) for k in range(SHINGLE)))
    few = F.array(F.xxhash64("word"))
    df = df.withColumn("term", F.when(F.size("word") < SHINGLE, few).otherwise(F.transform(F.sequence(F.lit(0), F.size("word") - SHINGLE), run)))
    df = df.withColumn("term", F.sort_array("term")).withColumn("n", F.size("term"))
    last = lambda i: (i == F.col("n")) | (F.get("term", i - 1) != F.get("term", i))
    return df.withColumn("ends", F.when(F.size(F.array_distinct("term")) < F.col("n"), F.filter(F.sequence(F.lit(1), F.col("n")), last)))


def candidates(df: DataFrame) -> DataFrame:
    """From rows of :func:`terms` a row for each draw that may win: ``sample`` and ``draw``.

    ``draw`` has 31 bits of ``ln a`` above the 32 bits that stand for the sample;
    other columns stay, and the first row of each text has ``first`` true and no
    sample.  No interpreted function: all is one generated loop.
    """
    keep = [c for c in df.columns if c not in ("text", "word", "term", "ends", "n")]
    df = df.withColumn("near", REACH / F.col("n"))
    df = df.withColumn("limit", F.least(F.floor((1 - F.exp(-F.col("near"))) * CHUNK) + 1, F.lit(CHUNK)).cast("int"))
    df = df.select(*keep, "term", "ends", "near", "limit", F.explode(F.sequence(F.lit(0), F.coalesce(F.size("ends"), F.col("n")) - 1)).alias("k"))
    df = df.select(
        *keep, "near",
        F.when(F.col("ends").isNull(), F.get("term", F.col("k"))).otherwise(F.get("term", F.get("ends", F.col("k")) - 1)).alias("t"),
        F.when(F.col("ends").isNull(), F.lit(1)).otherwise(F.get("ends", F.col("k")) - F.coalesce(F.get("ends", F.col("k") - 1), F.lit(0))).alias("w"),
        F.when(F.col("k") == 0, F.lit(CHUNK)).otherwise(F.col("limit")).alias("limit"),
    )
    last = SAMPLES // CHUNKS
    hashes = F.array(*(F.xxhash64("t", F.lit(j)) for j in range(last)), F.lit(0).cast("long"))
    df = df.select(*df.columns, F.posexplode(hashes).alias("j", "h"))
    chunk = lambda k: F.shiftrightunsigned("h", 16 * k).bitwiseAND(F.lit(CHUNK - 1)).cast("int")
    near = (F.col("w") > 1) | (chunk(0) < F.col("limit")) | (chunk(1) < F.col("limit")) | (chunk(2) < F.col("limit")) | (chunk(3) < F.col("limit"))
    df = df.filter(F.when(F.col("j") == last, F.col("limit") == CHUNK).otherwise(near))
    df = df.select(*keep, "near", "t", "w", "limit", "j", F.posexplode(F.array(*map(chunk, range(CHUNKS)))).alias("part", "c"))
    df = df.filter(F.when(F.col("j") == last, F.col("part") == 0).otherwise((F.col("w") > 1) | (F.col("c") < F.col("limit"))))
    df = df.withColumn("sample", F.when(F.col("j") < last, F.col("j") * CHUNKS + F.col("part")))
    df = df.withColumn("g", F.xxhash64("t", "sample", F.lit(1)))
    bits = lambda shift, n: (F.shiftrightunsigned("g", shift).bitwiseAND(F.lit((1 << n) - 1)) + F.lit(0.5)) * F.lit(1.0 / (1 << n))
    # a >= x * exp(-e) / w and x >= c / CHUNK
    df = df.filter((F.col("w") == 1) | (F.col("limit") == CHUNK) | (F.col("c") * bits(44, 20) < F.col("near") * F.col("w") * F.lit(float(CHUNK))))
    heavy = F.col("w") > 1
    df = df.withColumn("x", -F.log(1 - (F.col("c") + bits(0, 24)) * F.lit(1.0 / CHUNK)))
    df = df.withColumn("e", F.when(heavy, -F.log(bits(44, 20)))).withColumn("cc", F.when(heavy, F.col("x") - F.log(bits(24, 20))))
    df = df.withColumn("r", F.when(heavy, F.col("e") + F.log(F.col("cc") / F.col("x"))))
    df = df.withColumn("z", F.when(heavy, F.floor((F.log("w") + F.col("e")) / F.col("r"))).otherwise(F.lit(0).cast("long")))
    ln_a = F.when(heavy, F.log("cc") - F.col("r") * (F.col("z") + 1) + F.col("e")).otherwise(F.log("x"))
    rank = ((ln_a + F.lit(64.0)) * F.lit(float(1 << 24))).cast("long")
    same = F.xxhash64("t", "z").bitwiseAND(F.lit(0xFFFFFFFF))
    return df.select(*keep, F.col("sample").isNull().alias("first"), "sample", F.shiftleft(rank, 32).bitwiseOR(same).alias("draw"))


def signatures(rows: DataFrame, texts: list[str], bucket: str = "bucket", number: str = "n") -> DataFrame:
    """``bucket, number, row, sigs``: all columns of ``rows`` but its ``texts``, and the signatures of these, one after another.

    ``number`` is unique in its bucket and buckets are already dealt out, so
    nothing moves.  Draws are summed to the smallest of a sample as they come.
    """
    info = F.struct(*(F.col(f"`{c}`") for c in rows.columns if c not in texts))
    df = rows.select(F.col(bucket).alias("bucket"), F.col(number).alias("n_"), info.alias("info"), F.posexplode(F.array(*texts)).alias("which", "text"))
    df = candidates(terms(df, "text"))
    # What isn't needed to find the smallest draw comes along once a row.
    info = F.when(F.col("first") & (F.col("which") == 0), F.col("info"))
    place = F.col("which") * SAMPLES + F.coalesce("sample", F.lit(0))
    df = df.filter("not first or which = 0").groupBy("bucket", (F.col("n_") * F.lit(1 << 10).cast("long") + place).alias("ref"), info.alias("info")).agg(F.min("draw").alias("draw"))
    sample = F.shiftleft(F.col("ref").bitwiseAND(F.lit(1023)), 32).bitwiseOR(F.col("draw").bitwiseAND(F.lit(0xFFFFFFFF)))
    df = df.groupBy("bucket", F.shiftright("ref", 10).alias("n_")).agg(
        F.sort_array(F.collect_list(F.when(F.col("info").isNull(), sample))).alias("sigs"), F.first("info", True).alias("row")
    )
    return df.select("bucket", F.col("n_").alias("number"), "row", "sigs")


def signature(sigs: Column, which: int = 0) -> Column:
    """The samples of one text."""
    return F.slice(sigs, which * SAMPLES + 1, SAMPLES)


def written(sig: Column) -> Column:
    """Eight hex digits a sample, without its number above them."""
    return F.lower(F.array_join(F.transform(sig, lambda v: F.substring(F.hex(v.bitwiseOR(F.lit(1 << 44))), 5, 8)), ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples of two signatures."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y).bitwiseAND(F.lit(0xFFFFFFFF)) == 0), lambda x: x)) / float(SAMPLES)


def fingerprint(df: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of ``text_col``: 8 hex digits a sample.  One shuffle, by row.

    Null texts are empty ones; empty texts have a fingerprint of their own
    kind.  A column called ``out_col`` is replaced, all others stay whatever
    their names, repeated rows stay, an empty table stays empty.
    """
    spark = df.sparkSession
    names = [c for c in df.columns if c != out_col]
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), text_or_empty(F.col(f"`{text_col}`")).alias("text"), F.monotonically_increasing_id().alias("n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("n"), F.lit(16 * parts)).cast("int")).repartition("bucket")
    out = signatures(rows, ["text"])
    return out.select("row.row.*", written(F.col("sigs")).alias(out_col))


def with_edits(df: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``id, text`` rows with ``n`` (place in the bucket), ``edited`` and their bucket.

    Documents go to buckets of neighbouring ids in one shuffle.  The largest
    document of a bucket also visits the bucket above it as a guest, the largest
    of all visits the lowest one, so each row finds the next document (smaller
    id, equal ids by text; after the last the first) in its own bucket.
    """
    bounds, top = bounds_of(df, "id", bucket_bytes)
    b = bucket_of(F.col("id"), bounds)
    places = [F.array(F.struct(b.alias("bucket"), F.lit(False).alias("guest")))]
    up = F.array(F.struct((b + 1).alias("bucket"), F.lit(True).alias("guest")))
    none = F.array().cast("array<struct<bucket:int,guest:boolean>>")
    if bounds:
        places.append(F.when(F.array_contains(F.lit(bounds).cast("array<bigint>"), F.col("id")), up).otherwise(none))
    first = F.col("id").isNull() if top is None else F.col("id") == top
    places.append(F.when(first, F.array(F.struct(F.lit(0).alias("bucket"), F.lit(True).alias("guest")))).otherwise(none))
    rows = df.select("id", "text", F.inline(F.concat(*places))).repartitionByRange(len(bounds) + 1, "bucket")
    order = Window.partitionBy("bucket").orderBy("guest", F.col("id").desc_nulls_last(), "text")
    cut = F.floor(F.length("text") / 3).cast("int")
    follow = F.lead("text").over(order)
    return rows.withColumn("n", F.row_number().over(order)).withColumn("follow", follow).withColumn(
        "edited",
        F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.substring(F.coalesce("follow", F.lit("")), F.lit(1), cut)),
    ).drop("follow")


def fingerprint_with_neighbours(df: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Fingerprints of ``id, text`` rows, of their edited texts, and likenesses.

    One shuffle, into buckets; sums and the second window find their rows where
    they are.  Null texts are empty ones; null ids come last and equal ids stand
    in order of their texts, so repeated rows follow each other; a single row
    follows itself; columns other than ``id`` and ``text`` are left out; an empty
    table gives an empty table.
    """
    rows = with_edits(df.select("id", text_or_empty("text").alias("text")), bucket_bytes)
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    rows = signatures(rows, ["text", "edited"])
    follow = F.lead(signature(F.col("sigs"))).over(Window.partitionBy("bucket").orderBy("number"))
    rows = rows.select("row.*", signature(F.col("sigs")).alias("sig"), signature(F.col("sigs"), 1).alias("edited_sig"), follow.alias("next_sig"))
    return rows.filter("not guest").select(
        "id", "n_chars", "edited_sha256",
        written(F.col("sig")).alias("fingerprint"),
        written(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.coalesce("next_sig", "sig")).alias("near_next"),
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    docs = documents(spark, sf_dir, "doc_id", "text").withColumnRenamed("doc_id", "id")
    return fingerprint_with_neighbours(docs).withColumnRenamed("id", "doc_id")
