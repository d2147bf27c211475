import zlib

import numpy as np
import public_tokenizers

import corpus_pipeline as cp
from jurisloom.llm import mixing as mx
from jurisloom.llm.shingles import written_shingles
from jurisloom.llm.encoding import coder

from .test_decontamination import brute as leaks
from .test_near_duplicates import brute as classes

DIR = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    odd = spark.createDataFrame(
        [(9001, "123 456 !!", "en", "src0", 10), (9002, None, "en", "src0", 0), (9003, "qzxj kvwq " * 300, None, None, 3000), (9004, "", None, "src1", 0)], docs.schema
    )
    docs = docs.unionByName(odd)
    columns = docs.columns
    kept = cp.STAGES[0][1](spark, docs, DIR)
    assert kept.columns == columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert not ids & {9001, 9002, 9003, 9004}
    assert ids == {r["doc_id"] for r in docs.collect()} - {9001, 9002, 9003, 9004}

    single = cp.STAGES[1][1](spark, kept, DIR)
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(i for i, c, *_ in classes(rows) if i == c)
    assert single.columns == columns

    clean = cp.STAGES[2][1](spark, single, DIR)
    items = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(r["doc_id"], r["text"]) for r in single.collect()]
    bad = {d for _, d, *_ in leaks(rows, items)}
    assert bad
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(i for i, _ in rows if i not in bad)

    mixed = cp.STAGES[3][1](spark, clean, DIR)
    assert mixed.columns == columns
    taken: dict = {}
    for r in mixed.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + len(r["text"].split())
    totals = clean.groupBy("source").agg(mx.F.sum(mx.words_in(mx.F.col("text"))).alias("source_size"))
    largest = max(len(r["text"].split()) for r in clean.collect())
    for r in mx.targets(totals).collect():
        assert abs(taken.get(r["source"], 0) - r["target"]) <= largest

    out = cp.STAGES[4][1](spark, mixed, DIR).orderBy("start").collect()
    start, code = 0, coder(public_tokenizers.path("byte_bpe_50k.json"))
    for r, d in zip(out, sorted(mixed.collect(), key=lambda d: (d["doc_id"], d["text"])), strict=True):
        data = np.array([*code.encode_many([d["text"]])[0], 0], "<u4")
        assert tuple(r) == (d["doc_id"], start, len(data), zlib.crc32(data.tobytes()))
        start += len(data)


def test_run_and_rerun(spark):
    one = sorted(map(tuple, cp.run(spark, DIR).collect()))
    assert one == sorted(map(tuple, cp.run(spark, DIR).collect())) and one


def test_stage_names_and_empty_input(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, DIR)
        assert docs.count() == 0


def test_stages_over_odd_rows(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, columns that are called like the stages' own."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    names = ["row", "id", "bucket", "size", "copies", "q", "bin", "key", "bands", "class", "__maybe", "lang_pred", "score", "a.b"]
    rows = [(9001, None, None, None, None), (None, "words and more words of a text without an id", "en", "src0", 44), (9002, "", "en", None, 0), (9003, "the words of the land are long and the " * 9000, "en", "src1", 1)]
    rows += [(9004, "a text that is there twice, with its id and all that it has of columns", "en", "src0", 7)] * 2 + [(9005, "tie one of the same size", "en", "src9", 1), (9005, "tie two of the same size", "en", "src9", 1)]
    odd = docs.limit(60).unionByName(spark.createDataFrame(rows, docs.schema))
    odd = odd.select("*", *(mx.F.when(mx.F.col("doc_id") % 2 == 0, mx.F.lit(n)).alias(n) for n in names))
    now = odd
    for name, stage in cp.STAGES[:4]:
        now = stage(spark, now, DIR)
        assert now.columns == odd.columns, name
        got = now.collect()
        assert all(r[n] == (n if r["doc_id"] is not None and r["doc_id"] % 2 == 0 else None) for r in got for n in names), name
        ids = [r["doc_id"] for r in got]
        if name == "language_id":
            assert None in ids and 9003 in ids and 9001 not in ids and 9002 not in ids and ids.count(9004) == 2 and ids.count(9005) == 2
        if name in ("jaccard_join", "decontamination"):
            assert None in ids and 9003 in ids and ids.count(9004) == 1 and ids.count(9005) == 2
    out = cp.STAGES[4][1](spark, now, DIR)
    assert sorted(r["doc_id"] or -1 for r in out.collect()) == sorted(r["doc_id"] or -1 for r in got)
