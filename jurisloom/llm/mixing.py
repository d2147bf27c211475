"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Within a source a document is due ``m = min(most, c * x)`` times, ``x`` being the
number of binary digits of its size (long documents are due more often than
short ones, in small steps) and ``c`` the level at which what all are due adds
up to the source's target.  The whole part of ``m`` is allocated with certainty;
the rest ``p`` is the document's own inclusion probability.  With ``u`` uniform (a
hash of the id and a seed) all documents of a source are ranked by

    q = (u / (1 - u)) / (p / (1 - p))

the random odds over the inclusion odds, and taken in that order up to a fixed
size, the words still due: a document is in when at least half of it fits.

No source is ever sorted as a whole.  Words are summed by source and by one of
``BINS`` intervals of ``q / (1 + q)``; running sums of these few numbers show the
one interval in which a source fills up, and only that interval's documents, one
in ``BINS`` or so, are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialise

BINS, COARSE = 65_536, 256
MAX_COPIES = 3
WEIGHTS = (1, 2, 3)
SEED = "mix-1"
#: Sources up to which their table is broadcast (under 200 bytes each); beyond, a shuffle join.
BROADCAST_SOURCES = 50_000


def words_in(text: Column) -> Column:
    """Number of runs of characters other than space, tab, LF, VT, FF and CR."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the id and the seed only (52 bits of an md5)."""
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(key, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(2**52)


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """``source, source_size`` with each source's ``target``.

    Sources take ``weights`` in turn, by code point, null last, and share all
    words by weight; none gets over ``most`` times its size, and what is cut
    off goes to the others by weight.  Filling them in order of capacity over
    weight, the common level is the largest of the levels at which each would
    be the first that isn't full.  The windows run over a row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights) + 1
    cap = F.col("source_size") * most
    ranked = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn).cast("long")).withColumn("cap", cap)
    fill = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(Window.partitionBy())
    full_before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    level = ranked.withColumn("level", (total - full_before).cast("double") / rest)
    top = F.max("level").over(Window.partitionBy())
    return level.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * top)).select(
        "source", "source_size", "target"
    )


def size_class(size: Column) -> Column:
    """Binary digits of a size: what a document is due is in proportion to it."""
    return F.length(F.bin(size))


def levels(classes: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    """``plan`` with each source's ``level`` (copies due for each unit of ``x``, up to ``most``) and the words ``due`` beyond whole copies.

    ``classes`` has ``source, x, words``: at most 64 rows a source.  Filling classes
    from the largest ``x`` down, the level is the largest of those at which each
    would be the first that isn't full.
    """
    down = Window.partitionBy("source").orderBy(F.col("x").desc())
    full = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("x") * F.col("words")).over(down.rowsBetween(0, Window.unboundedFollowing))
    rows = classes.withColumn("full", full).withColumn("rest", rest)
    rows = _with_sources(rows, plan)
    own = F.when(F.col("rest") > 0, (F.col("target") - most * F.col("full")) / F.col("rest"))
    rows = rows.withColumn("level", F.max(own).over(Window.partitionBy("source")))
    whole = F.floor(_times(F.col("level"), F.col("x"), most))
    return rows.groupBy("source", "source_size", "target", "level").agg(F.sum(whole * F.col("words")).alias("whole_words")).select(
        "source", "source_size", "target", "level", F.greatest(F.lit(0.0), F.col("target") - F.coalesce("whole_words", F.lit(0))).alias("due")
    )


def _times(level: Column, x: Column, most: int) -> Column:
    return F.least(F.lit(float(most)), F.coalesce(level, F.lit(0.0)) * x)


def _ranked(rows: DataFrame, most: int) -> DataFrame:
    """Rows with their source's ``level``: ``whole`` copies, inclusion probability ``p``, ``q`` (null: nothing beyond whole copies) and its ``bin``."""
    rows = rows.withColumn("times", _times(F.col("level"), size_class(F.col("size")), most))
    rows = rows.withColumn("whole", F.floor("times").cast("int")).withColumn("p", F.col("times") - F.floor("times"))
    rows = rows.withColumn("q", F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))))
    return rows.withColumn("bin", F.least(F.floor(F.col("q") / (1 + F.col("q")) * BINS), F.lit(BINS - 1)).cast("int"))


def decide(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """From ``source, id, size, u`` of every document, a row per source:

    ``source, source_size, target, level, due``, ``fill_bin`` (the interval in which it
    fills up; null: nothing is due) and ``last`` (rank of the last document in
    there, null: none).
    """
    classes = materialise(sizes.groupBy("source", size_class(F.col("size")).alias("x")).agg(F.sum("size").alias("words")), "mix-classes")
    plan = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    plan = materialise(levels(classes, materialise(plan, "mix-targets"), most), "mix-plan")
    ranked = _ranked(_with_sources(sizes, plan.select("source", "level", "due")), most).filter("p > 0")
    bins = materialise(ranked.groupBy("source", "bin").agg(F.sum("size").alias("words")), "mix-bins")
    # First the block of bins, then the bin in which a source fills up: windows of COARSE and BINS / COARSE rows.
    state = plan.select("source", F.lit(0).alias("start"), "due")
    block = (F.col("bin") / (BINS // COARSE)).cast("int")
    blocks = bins.groupBy("source", block.alias("place")).agg(F.sum("words").alias("words"))
    fills = materialise(_filling(blocks, state).withColumnRenamed("place", "block"), "mix-blocks")
    inner = _with_sources(bins.withColumn("at", block), fills.select("source", "block")).filter(F.col("at") == F.col("block"))
    inner = inner.select("source", F.col("bin").alias("place"), "words")
    fills = _filling(inner, fills.select("source", F.col("before").alias("start"), "due"))
    fills = materialise(fills.select("source", F.col("place").alias("fill_bin"), "before"), "mix-fills")
    close = _with_sources(ranked, fills).filter(F.col("bin") == F.col("fill_bin")).withColumn("rank", _rank())
    run = Window.partitionBy("source").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.col("before") + F.coalesce(F.sum("size").over(run), F.lit(0))
    last = (
        close.withColumn("fits", taken + F.col("size") / 2 <= F.col("due"))
        .groupBy("source")
        .agg(F.max(F.when(F.col("fits"), F.col("rank"))).alias("last"), F.first("fill_bin").alias("fill_bin"))
    )
    plan = plan.join(last, plan["source"].eqNullSafe(last["source"]), "left").drop(last["source"])
    return materialise(plan, "mix-decisions")


def _filling(sums: DataFrame, state: DataFrame) -> DataFrame:
    """Of each source the ``place`` whose ``words`` reach what is due, and the words ``before`` it.

    ``state`` has the words before all places (``start``) and ``due``.
    """
    run = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.withColumn("ahead", F.coalesce(F.sum("words").over(run), F.lit(0)))
    rows = _with_sources(ahead, state).withColumn("before", F.col("start") + F.col("ahead"))
    return rows.filter((F.col("before") <= F.col("due")) & (F.col("before") + F.col("words") > F.col("due"))).select("source", "place", "before", "due")


def _rank() -> Column:
    return F.struct("q", "id", "size")


def _with_sources(df: DataFrame, per_source: DataFrame) -> DataFrame:
    """Inner join on ``source``, null with null; broadcast only behind a count of the sources."""
    side = per_source.withColumnRenamed("source", "__source")
    if per_source.count() <= BROADCAST_SOURCES:
        side = F.broadcast(side)
    return df.join(side, df["source"].eqNullSafe(side["__source"])).drop("__source")


def apply_decisions(rows: DataFrame, decisions: DataFrame, most: int = MAX_COPIES) -> DataFrame:
    """``rows`` (with ``source, id, size, u``) with their source's columns, their own ``p`` and ``copies``.  Narrow."""
    out = _ranked(_with_sources(rows, decisions), most)
    chosen = (
        F.when(F.col("q").isNull() | F.col("fill_bin").isNull(), F.lit(0))
        .when(F.col("bin") < F.col("fill_bin"), F.lit(1))
        .when((F.col("bin") == F.col("fill_bin")) & F.col("last").isNotNull() & (_rank() <= F.col("last")), F.lit(1))
        .otherwise(F.lit(0))
    )
    return out.withColumn("copies", F.col("whole") + chosen)


def mix(
    df: DataFrame, size: Column | None = None, id_col: str = "doc_id", source_col: str = "source",
    text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES, seed: str = SEED,
) -> DataFrame:
    """``df`` with every row as often as the mix takes it (0 to ``most`` times).

    Columns of ``df`` come back as they were, whatever their names.  A null
    text has size 0, a null source is a source of its own, a null id ranks as
    the text "null".  Rows that tie in source, id and size share one decision.
    Rows of size 0 count as 0 words whatever happens to them.  An empty table
    gives an empty table.  A mix is the same on every run.
    """
    names = df.columns
    key = F.struct(*(F.col(f"`{c}`") for c in names)).alias("__row")
    measured = df.select(
        key, F.col(source_col).alias("source"), F.col(id_col).alias("id"),
        (size if size is not None else words_in(F.col(text_col))).alias("size"),
        uniform(F.col(id_col), seed).alias("u"),
    )
    sizes = materialise(measured.select("source", "id", "size", "u"), "mix-sizes")
    out = apply_decisions(measured, decide(sizes, weights, most), most).filter("copies > 0")
    # Generate repeats a row without a shuffle.
    return out.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__n")).select("__row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    docs = documents(spark, sf_dir, "doc_id", "text", "source")
    sizes = materialise(
        docs.select(
            "source", F.col("doc_id").alias("id"), words_in(F.col("text")).alias("size"),
            uniform(F.col("doc_id"), SEED).alias("u"),
        ),
        "mix-sizes",
    )
    return apply_decisions(sizes, decide(sizes)).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


OP8_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(2**52)} AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS cap, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
       / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap::DOUBLE, weight * max(level) OVER ()) AS target FROM l),
x AS (SELECT source, length(bin(size)) AS x, sum(size)::BIGINT AS words FROM d GROUP BY ALL),
f AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
        sum(x * words) OVER (PARTITION BY source ORDER BY x DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM x),
c AS (SELECT f.source, f.x, f.words, t.source_size, t.target,
        max(CASE WHEN rest > 0 THEN (target - 3 * full_) / rest END) OVER (PARTITION BY f.source) AS level
      FROM f JOIN t ON f.source IS NOT DISTINCT FROM t.source),
p AS (SELECT source, source_size, target, level,
        greatest(0.0, target - coalesce(sum(floor(least(3.0::DOUBLE, coalesce(level, 0.0::DOUBLE) * x)) * words), 0)) AS due
      FROM c GROUP BY source, source_size, target, level),
m AS (SELECT d.doc_id, d.source, d.size, d.u, p.source_size, p.target, p.due,
        least(3.0::DOUBLE, coalesce(p.level, 0.0::DOUBLE) * length(bin(d.size))) AS times
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
r AS (SELECT *, floor(times)::BIGINT AS whole, times - floor(times) AS p FROM m),
o AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM r),
k AS (SELECT *, coalesce(sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o)
SELECT doc_id, size, source_size, target,
       size * (whole + CASE WHEN p > 0 AND before + size / 2 <= due THEN 1 ELSE 0 END) AS taken
FROM k
"""
