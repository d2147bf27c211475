"""LM scores by prediction by partial matching, pretrained on a part of the corpus.

Training counts every byte with the ``ORDER`` bytes before it (beyond the start
of a text stands a start mark, after its last byte an end symbol); counts of
shorter contexts are sums of these.  A symbol is predicted in the longest
context seen.  A context with ``T`` symbols, ``D`` of them distinct, gives a seen
symbol ``c / (T + D)`` and escapes with ``D / (T + D)``; after an escape the
symbols of the longer context are excluded from the shorter one's ``c``, ``T`` and
``D``, and below the empty context all symbols never seen are alike.  As a
longer context's symbols are also symbols of every shorter one, what is
excluded depends only on the context last escaped from, so it is a number kept
with that context.

The trie is cut by the last two bytes of its contexts into shards of about
``SHARD_GRAMS`` (one pair's can't exceed 256 * 257**2 by construction); shorter
contexts are bounded too and part of every shard.  A scoring pass broadcasts
one shard and adds up the positions that belong to it, so a trie of any size is
used whole, by as many passes as it has shards.  Where there are several, rows are
written once with a number of their own, on which the passes are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_crc, map_arrow, materialise, slices

ORDER = 4
BITS = 9
SYMBOL = (1 << BITS) - 1
END, START = 256, 257
SYMBOLS = 257
SHARD_GRAMS = 6_000_000
#: Words whose counts are broadcast (about 10 MB); all others are joined.
FREQUENT = 100_000
#: Distinct words, and byte strings, that a training task holds before it passes them on.
HELD_WORDS, HELD_GRAMS = 150_000, 1_000_000
#: Rows of a batch that a training task passes on.
TOLD_ROWS = 50_000


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For every predicted symbol its context and itself as one number; and where texts start.

    Every text has at least its end symbol, so none is empty.
    """
    flat = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    raw = flat.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    length = np.diff(offsets)
    pad = ORDER + 1
    at = np.cumsum(np.append(0, length[:-1] + pad)) if len(length) else np.empty(0, np.int64)
    s = np.full(len(data) + pad * len(length), START, np.int64)
    doc = np.repeat(np.arange(len(length)), length)
    s[np.arange(len(data)) + doc * pad + ORDER] = data
    s[at + ORDER + length] = END
    gram = s.copy()
    for k in range(1, ORDER + 1):
        gram[k:] |= s[:-k] << (BITS * k)
    keep = np.ones(len(s), bool)
    for k in range(ORDER):
        keep[at + k] = False
    return gram[keep], at - np.arange(len(length)) * ORDER


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key = np.concatenate([k for k, _ in parts])
    n = np.concatenate([v for _, v in parts])
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    new = np.flatnonzero(np.diff(key, prepend=-1))
    return key[new], np.add.reduceat(n, new) if len(new) else n


def gather(df: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Counts of words (``word, c``; the end of a text is the empty word) and of byte strings (``gram, c``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        grams: list[tuple[np.ndarray, np.ndarray]] = []

        def told() -> Iterator[pa.RecordBatch]:
            pairs = iter(words.items())
            while part := list(islice(pairs, TOLD_ROWS)):
                n = len(part)
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.binary()), pa.nulls(n, pa.int64()), pa.array([c for _, c in part], pa.int64())], names=["word", "gram", "c"])
            words.clear()
            if grams:
                key, c = _merged(grams)
                for k in range(0, len(key), TOLD_ROWS):
                    some = slice(k, k + TOLD_ROWS)
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(key[some]), pa.binary()), pa.array(key[some]), pa.array(c[some])], names=["word", "gram", "c"])
            grams.clear()

        for whole in batches:
            for batch in slices(whole, text_col):
                texts = batch.column(text_col)
                for t in texts.to_pylist():
                    words.update((t or "").encode().lower().split())
                words[b""] += len(texts)
                key = np.sort(symbols(texts)[0])
                new = np.flatnonzero(np.diff(key, prepend=-1))
                grams.append((key[new], np.diff(np.append(new, len(key)))))
                if len(grams) > 8:
                    grams[:] = [_merged(grams)]
                if len(words) > HELD_WORDS or sum(len(k) for k, _ in grams) > HELD_GRAMS:
                    yield from told()
        yield from told()

    parts = materialise(map_arrow(df.select(text_col), run, "word binary, gram long, c long"), "lm-counts")
    total = lambda c: materialise(parts.filter(f"{c} is not null").groupBy(c).agg(F.sum("c").alias("c")), f"lm-{c}")
    return total("word"), total("gram")


class Level:
    """Contexts of one length: symbols with their counts, and what an escape leaves to the next shorter length."""

    def __init__(self, gram: np.ndarray, c: np.ndarray) -> None:
        self.gram, self.c = gram, c.astype(np.float64)
        ctx = gram >> BITS
        first = np.flatnonzero(np.diff(ctx, prepend=-1))
        self.ctx = ctx[first]
        self.total = np.add.reduceat(self.c, first) if len(first) else np.empty(0)
        self.distinct = np.diff(np.append(first, len(gram))).astype(np.float64)
        self.of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(gram))))
        self.first = first

    def link(self, shorter: Level, shift: int) -> None:
        """Denominator and number of distinct symbols in the shorter context once this one's are excluded."""
        same = np.searchsorted(shorter.gram, self.gram & ((1 << shift) - 1))
        taken = np.add.reduceat(shorter.c[same], self.first) if len(self.first) else np.empty(0)
        up = shorter.of[same[self.first]] if len(self.first) else np.empty(0, np.int64)
        self.left_distinct = shorter.distinct[up] - self.distinct
        self.left_total = shorter.total[up] - taken + self.left_distinct

    def find(self, table: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Place in a sorted table, -1 where it's missing."""
        if not len(table):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(table, key), len(table) - 1)
        return np.where(table[at] == key, at, -1)


class Trie:
    """A shard of the trie: contexts of every length, in sorted arrays."""

    def __init__(self, gram: np.ndarray, c: np.ndarray, low_gram: np.ndarray, low_c: np.ndarray) -> None:
        """``gram`` are the shard's longest strings, ``low_gram`` all strings of two symbols, both sorted."""
        self.levels = [None] * (ORDER + 1)
        self.levels[ORDER] = Level(gram, c)
        for k in range(ORDER - 1, 1, -1):
            gram, c = _merged([(gram & ((1 << BITS * (k + 1)) - 1), c)])
            self.levels[k] = Level(gram, c)
        self.levels[1] = Level(low_gram, low_c)
        gram, c = _merged([(low_gram & SYMBOL, low_c)])
        self.levels[0] = Level(gram, c)
        for k in range(ORDER, 0, -1):
            self.levels[k].link(self.levels[k - 1], BITS * k)
        self.unseen = max(1, SYMBOLS - len(gram))
        self.slots = None

    def _hash(self) -> None:
        """Open addressing over the longest strings: most symbols need one look."""
        top = self.levels[ORDER]
        bits = max(10, int(np.ceil(np.log2(max(1, len(top.gram)) * 2.5))))
        self.shift = np.uint64(64 - bits)
        self.key, self.value = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.float32)
        logs = (np.log(top.c) - np.log(top.total + top.distinct)[top.of]).astype(np.float32)
        left = np.arange(len(top.gram))
        at = self._slot(top.gram)
        while len(left):
            free = self.key[at] < 0
            self.key[at[free]] = top.gram[left[free]]
            lost = self.key[at] != top.gram[left]
            self.value[at[~lost]] = logs[left[~lost]]
            left, at = left[lost], (at[lost] + 1) & (len(self.key) - 1)
        self.slots = len(self.key)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def logs(self, gram: np.ndarray) -> np.ndarray:
        """Natural logarithms of the symbols' probabilities."""
        if self.slots is None:
            self._hash()
        at = self._slot(gram)
        found = self.key[at]
        out = np.where(found == gram, self.value[at], 0).astype(np.float64)
        open_ = np.flatnonzero((found != gram) & (found >= 0))
        missing = [np.flatnonzero(found < 0)]
        at = at[open_]
        while len(open_):
            at = (at + 1) & (self.slots - 1)
            found = self.key[at]
            hit = found == gram[open_]
            out[open_[hit]] = self.value[at[hit]]
            missing.append(open_[found < 0])
            more = ~hit & (found >= 0)
            open_, at = open_[more], at[more]
        rest = np.concatenate(missing)
        if len(rest):
            out[rest] = self._escaped(gram[rest])
        return out

    def _escaped(self, gram: np.ndarray) -> np.ndarray:
        out = np.zeros(len(gram))
        todo = np.arange(len(gram))
        den = dist = np.zeros(len(gram))  # of the current context after exclusion; 0: nothing excluded
        after = np.zeros(len(gram), bool)
        for k in range(ORDER, -1, -1):
            level = self.levels[k]
            key = gram[todo] & ((1 << BITS * (k + 1)) - 1)
            at = level.find(level.gram, key)
            own = level.find(level.ctx, key >> BITS)
            seen = own >= 0
            total = np.where(after, den, np.where(seen, level.total[own] + level.distinct[own], 1.0) if len(level.ctx) else 1.0)
            d = np.where(after, dist, np.where(seen, level.distinct[own], 0.0) if len(level.ctx) else 0.0)
            hit = at >= 0
            out[todo[hit]] += np.log(level.c[at[hit]] / total[hit])
            go = ~hit
            leave = go & seen & (d > 0)
            out[todo[leave]] += np.log(d[leave] / total[leave])
            todo, own, seen = todo[go], own[go], seen[go]
            if not len(todo):
                return out
            if k:
                none = np.zeros(len(todo))
                den = np.where(seen, level.left_total[own], 0.0) if len(level.ctx) else none
                dist = np.where(seen, level.left_distinct[own], 0.0) if len(level.ctx) else none
                after = seen
        out[todo] -= np.log(self.unseen)
        return out


def shards(grams: DataFrame) -> tuple[int, Iterator[tuple[Trie, np.ndarray | None]]]:
    """Number of shards, and the trie of each with the pairs of last bytes it answers for (None: all)."""
    pair = F.shiftright("gram", BITS).bitwiseAND(F.lit((1 << 2 * BITS) - 1))
    sizes = grams.groupBy(pair.alias("pair")).agg(F.count("*").alias("n")).toPandas().sort_values("pair")
    low = grams.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 2 * BITS) - 1)).alias("gram")).agg(F.sum("c").alias("c")).toPandas().sort_values("gram")
    low = low["gram"].to_numpy(np.int64), low["c"].to_numpy(np.int64)
    number, filled, shard_of = 0, 0, []
    for n in sizes["n"].tolist():
        if filled and filled + n > SHARD_GRAMS:
            number, filled = number + 1, 0
        filled += n
        shard_of.append(number)
    pairs = sizes["pair"].to_numpy(np.int64)

    def tries() -> Iterator[tuple[Trie, np.ndarray | None]]:
        for k in range(number + 1):
            part = grams
            mine = None
            if number:
                own = pairs[np.array(shard_of) == k]
                part = grams.filter(pair.between(int(own[0]), int(own[-1])))
                # Pairs never seen belong to the shard whose range they fall in; the first and last are open.
                mine = np.zeros(1 << 2 * BITS, bool)
                low_end = 0 if k == 0 else int(own[0])
                high_end = (1 << 2 * BITS) if k == number else int(pairs[np.array(shard_of) == k + 1][0])
                mine[low_end:high_end] = True
            table = part.toArrow()
            gram = table["gram"].to_numpy()
            order = np.argsort(gram)
            yield Trie(gram[order], table["c"].to_numpy()[order], *low), mine

    return number + 1, tries()


def score(df: DataFrame, learn: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "held_out") -> DataFrame:
    """``id_col, mark, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``df``.

    ``mark`` is a column of ``df`` that is passed through.  ``learn`` are the rows
    to learn from.  Null texts are empty ones: one end token, one end symbol.
    Repeated rows are scored (and learned) one by one; with nothing to learn
    all symbols are alike and ``base_score`` has N = V = 0.  Long texts are scored as
    a whole; an empty table gives an empty table; ids are whole numbers or cast to
    such, and columns other than these are left out.
    """
    spark = df.sparkSession
    word, gram = gather(learn, text_col)
    total, distinct = word.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).head()
    step = F.floor(F.log2("c") * 8)
    histogram = sorted(word.groupBy(step.alias("s")).count().collect(), reverse=True)
    least, n = None, 0
    for s, k in histogram:
        if n + k > FREQUENT:
            break
        least, n = s, n + k
    frequent = {} if least is None else {bytes(r[0]): r[1] for r in word.filter(step >= least).collect()}
    floor_ = np.log10(total + 0.5 * (distinct + 1))
    shared_words = spark.sparkContext.broadcast({w: float(np.log10(c + 0.5) - floor_) for w, c in frequent.items()})

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(mark).alias("mark"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    passes, tries = shards(gram)
    if passes > 1:
        # Each pass may read in other splits, so a row's place can't tell it apart.
        rows = materialise(rows, "lm-rows")
    n_rows = None
    first = True
    scored = None
    for trie, mine in tries:
        shared = spark.sparkContext.broadcast((trie, mine))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, base=first) -> Iterator[pa.RecordBatch]:
            (trie, mine), table = shared.value, shared_words.value
            for whole in batches:
                for batch in slices(whole, "text"):
                    n = batch.num_rows
                    key, starts = symbols(batch.column("text"))
                    if mine is None:
                        logs = trie.logs(key)
                    else:
                        at = np.flatnonzero(mine[(key >> BITS) & ((1 << 2 * BITS) - 1)])
                        logs = np.zeros(len(key))
                        logs[at] = trie.logs(key[at])
                    sums = np.add.reduceat(logs, starts) / np.log(10)
                    tokens, known, base_sum, rare, rare_n = [], [], [], [], []
                    for t in batch.column("text").to_pylist() if base else []:
                        split = (t or "").encode().lower().split()
                        split.append(b"")
                        values = [table.get(w) for w in split]
                        seen = [v for v in values if v is not None]
                        tokens.append(len(split))
                        known.append(len(seen))
                        base_sum.append(sum(seen))
                        few = Counter(w for w, v in zip(split, values, strict=True) if v is None) if len(seen) < len(split) else {}
                        rare.append(list(few))
                        rare_n.append(list(few.values()))
                    none = [0] * n
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("row"), batch.column("id"), batch.column("mark"), pa.array(sums),
                            pa.array(tokens if base else none, pa.int64()), pa.array(known if base else none, pa.int64()), pa.array(base_sum if base else none, pa.float64()),
                            pa.array(rare if base else [[]] * n, pa.list_(pa.binary())), pa.array(rare_n if base else [[]] * n, pa.list_(pa.int64())),
                        ],
                        names=["row", "id", "mark", "score", "n_tokens", "n_known", "base", "rare", "rare_n"],
                    )

        kind = rows.schema["mark"].dataType.simpleString()
        part = map_arrow(
            rows, run, f"row long, id long, mark {kind}, score double, n_tokens long, n_known long, base double, rare array<binary>, rare_n array<long>"
        )
        part = materialise(part, "lm-scored")
        if scored is None:
            scored = part
        else:
            n_rows = scored.count() if n_rows is None else n_rows
            more = part.select("row", F.col("score").alias("more"))
            scored = materialise(scored.join(more, "row").withColumn("score", F.col("score") + F.col("more")).drop("more"), "lm-scored")
            if not n_rows == part.count() == scored.count():
                raise RuntimeError(f"passes over {n_rows} rows scored {part.count()} and joined {scored.count()}")
        first = False

    rare = scored.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.rare_n").alias("n"))
    rare = rare.join(word, "word", "left").groupBy("row").agg(
        F.sum(F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + 0.5) - F.lit(float(floor_)))).alias("rare_base"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("rare_known"),
    )
    out = scored.drop("rare", "rare_n").join(rare, "row", "left")
    return out.select(
        F.col("id").alias(id_col), F.col("mark").alias(mark), "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        "score",
    )


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of four in five."""
    docs = documents(spark, sf_dir, "doc_id", "text").withColumn("held_out", id_crc("doc_id") % 5 == 1)
    return score(docs, docs.filter("not held_out"))
