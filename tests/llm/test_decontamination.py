import random

from jurisloom.llm import decontamination as dc
from jurisloom.llm.shingles import written_shingles


def brute(docs, items, threshold=0.8):
    sets = [(i, written_shingles(t)) for i, t in items]
    out = []
    for d, text in docs:
        own = written_shingles(text)
        for i, s in sets:
            if s and len(s & own) >= threshold * len(s) - 1e-9:
                out.append((i, d, len(s & own), len(s)))
    return sorted(out, key=str)


def hits(spark, docs, items):
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return sorted(((r["item_id"], r["doc_id"], r["contained"], r["item_shingles"]) for r in dc.containment_hits(d, i).collect()), key=str)


def case():
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 3, 4, 5, 6, 9, 14, 30, 31, 70, 150, 400] * 3)]
    items += [(100, None), (101, ""), (102, "??"), (0, items[0][1]), (103, items[9][1].upper())]
    docs = []
    for k in range(400):
        body = [word() for _ in range(rng.choice([0, 2, 20, 200, 3000]))]
        _, text = items[rng.randrange(36)]
        w = text.split()
        cut = rng.choice([0, 0, len(w) // 10, len(w) // 6, len(w) // 3])
        at = rng.randrange(len(body) + 1)
        body[at:at] = w[cut:]
        docs.append((k, " ".join(body)))
    docs += [(1000, None), (1001, ""), (1002, "!!"), (5, docs[5][1]), (None, items[7][1] + " tail"), (1003, items[1][1])]
    return docs, items


def test_against_brute_force(spark):
    docs, items = case()
    assert hits(spark, docs, items) == brute(docs, items)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, items = case()
    monkeypatch.setattr(dc, "BLOCK_BYTES", 900)
    assert hits(spark, docs[:100], items) == brute(docs[:100], items)


def test_query_on_the_tables(spark):
    d = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted(((r["item_id"], r["doc_id"], r["contained"], r["item_shingles"]) for r in dc.op4_decontamination(spark, d).collect()), key=str)
    assert got == brute(docs, items) and got


def test_decontaminate_keeps_the_rest(spark):
    docs, items = case()
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(docs)], "doc_id long, text string, item_id long")
    left = dc.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"))
    assert left.columns == df.columns
    bad = {str(d) for _, d, *_ in brute(docs, items)}
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(d) for d, _ in docs if str(d) not in bad)
    assert dc.decontaminate(df, spark.createDataFrame([], "item_id long, text string")).count() == len(docs)
    assert dc.containment_hits(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_short_items_inside_documents(spark, tmp_path):
    """Items of one to four words are found wherever their words stand in a row, by the query and the pipeline's stage."""
    import corpus_pipeline

    docs, items = case()
    text = [(i, [w for s in sorted(written_shingles(t)) for w in s]) for i, t in items]
    short = [(i, f" {' '.join(w)} ") for i, w in text if 0 < len(w) < 5]
    want = brute(docs, items)
    for d, t in docs:
        flat = f" {t or ''} "
        want += [(i, d, 1, 1) for i, x in short if x in flat and flat != x]
    assert len(want) > len(brute(docs, items))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = dc.op4_decontamination(spark, str(tmp_path)).collect()
    assert sorted(((r["item_id"], r["doc_id"], r["contained"], r["item_shingles"]) for r in got), key=str) == sorted(want, key=str)
    bad = {str(d) for _, d, *_ in want}
    left = corpus_pipeline.drop_benchmark_text(spark, df, str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in left) == sorted(str(d) for d, _ in docs if str(d) not in bad)
