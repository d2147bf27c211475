import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from jurisloom.llm import lm_scoring as lm

TEXTS = ["the cat sat on the mat. the cat ran", "The mat and the hat, the CAT", "", None, "é è ê\tthe\x0bcat\r\nend", "zzzz qqqq \x00\x01", "the", "aaaaaaaaaaaaaaaa aaaa", "unique wording entirely", "the cat sat"] * 3


def context(text, i):
    s = [lm.START] * lm.ORDER + list((text or "").encode())
    return tuple(s[i : i + lm.ORDER])


def naive_model(texts):
    counts = [defaultdict(Counter) for _ in range(lm.ORDER + 1)]
    for t in texts:
        data = [*(t or "").encode(), lm.END]
        for i, x in enumerate(data):
            ctx = context(t, i)
            for k in range(lm.ORDER + 1):
                counts[k][ctx[lm.ORDER - k :]][x] += 1
    return counts


def naive_p(counts, ctx, x):
    """Probability with explicit sets of excluded symbols."""
    out, excluded = 1.0, set()
    for k in range(lm.ORDER, -1, -1):
        seen = counts[k].get(ctx[lm.ORDER - k :])
        if not seen:
            continue
        rest = {s: c for s, c in seen.items() if s not in excluded}
        if rest:
            total = sum(rest.values()) + len(rest)
            if x in rest:
                return out * rest[x] / total
            out *= len(rest) / total
        excluded |= set(seen)
    return out / max(1, lm.SYMBOLS - len(excluded))


def base(texts, learn):
    words = lambda t: [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None]
    c = Counter(w for t in learn for w in words(t))
    n, v = sum(c.values()), len(c)
    for t in texts:
        yield len(words(t)), sum(c[w] > 0 for w in words(t)), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t))


@pytest.mark.parametrize("sizes", [(10**6, 10**5), (40, 3)])
def test_against_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(lm, "SHARD_GRAMS", sizes[0])
    monkeypatch.setattr(lm, "FREQUENT", sizes[1])
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, score string")
    df = df.withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)
    got = {r["doc_id"]: r for r in lm.score(df, df.filter("not held_out")).collect()}
    learn = [t for k, t in enumerate(TEXTS) if zlib.crc32(str(k).encode()) % 5 != 1]
    counts = naive_model(learn)
    for k, (t, b) in enumerate(zip(TEXTS, base(TEXTS, learn))):
        r = got[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == b[:3]
        assert abs(r["base_score"] - b[3]) < 1e-6
        want = sum(math.log10(naive_p(counts, context(t, i), x)) for i, x in enumerate([*(t or "").encode(), lm.END]))
        assert abs(r["score"] - want) < 1e-3 * max(1, abs(want)), (t, r["score"], want)


def test_passes_in_other_splits(spark, monkeypatch, tmp_path):
    """Passes that read the input in different splits add up scores of the same rows."""
    texts = [f"{t or ''} {k}" for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("held_out", F.lit(True))
    df.repartition(12).write.parquet(str(tmp_path / "docs"))
    df = spark.read.parquet(str(tmp_path / "docs"))
    whole = {r["doc_id"]: r["score"] for r in lm.score(df, df).collect()}
    write, sizes = lm.materialise, ["128m", "1k", "16k"]

    def other_splits(*args):
        out = write(*args)
        sizes.append(sizes.pop(0))
        for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.set(key, sizes[0])
        return out

    monkeypatch.setattr(lm, "SHARD_GRAMS", 40)
    monkeypatch.setattr(lm, "materialise", other_splits)
    try:
        got = [(r["doc_id"], r["score"]) for r in lm.score(df, df).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(k for k, _ in got) == sorted(whole)
    assert all(abs(x - whole[k]) < 1e-3 for k, x in got)


def test_probabilities_sum_to_one():
    key, _ = lm.symbols(pa.array(TEXTS))
    gram, c = lm._merged([(key, np.ones(len(key), np.int64))])
    low, low_c = lm._merged([(gram & ((1 << 18) - 1), c)])
    trie = lm.Trie(gram, c, low, low_c)
    for ctx in {int(g) >> lm.BITS for g in gram[::7]} | {(1 << 30) + 5, (200 << 9) + 116}:
        p = np.exp(trie.logs(np.array([(ctx << lm.BITS) | s for s in range(lm.SYMBOLS)])))
        assert abs(p.sum() - 1) < 1e-5


def test_held_out_texts_are_better_predicted_than_noise(spark):
    got = lm.op6_lm_scoring(spark, "/root/testdata/sf0.001").filter("held_out").join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "doc_id")
    bits = got.select((-F.sum("score") / F.log10(F.lit(2.0)) / F.sum(F.octet_length("text") + 1)).alias("b")).head()["b"]
    assert 0.5 < bits < 4


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, "w " * 60_000)], "doc_id long, text string").withColumn("held_out", F.lit(True))
    none = df.filter("doc_id > 5")
    got = lm.score(df, none).collect()
    assert len(got) == 4 and all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in got)
    assert abs(got[0]["score"]) > 0
    assert lm.score(none, df).count() == 0
