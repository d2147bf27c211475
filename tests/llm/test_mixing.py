import duckdb
from pyspark.sql import functions as F

from jurisloom.llm import mixing as mx

ROWS = [(k, "w " * (k % 50), f"s{k % 7}" if k % 7 else None, k) for k in range(700)]
ROWS += [(9000, None, "s1", 0), (9001, "", "solo", 1), (None, "a b c", "s2", 2), (5, "w " * 5, "s5", 3), (5, "w " * 5, "s5", 3), (9002, "x y z", "s3", 1)]
ROWS += [(10_000 + k, "big " * 2000, "hot", k) for k in range(60)]


def frame(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string, copies int")


def test_matches_sql(spark, tmp_path):
    frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, mx.op8_mixing(spark, str(tmp_path)).collect()), key=str)
    c = duckdb.connect()
    c.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(c.sql(mx.OP8_SQL).fetchall(), key=str)
    assert got == want


def test_sources_come_near_their_targets(spark):
    mixed = mx.mix(frame(spark))
    assert mixed.columns == ["doc_id", "text", "source", "copies"]
    taken = {r[0]: r[1] for r in mixed.groupBy("source").agg(F.sum(mx.words_in(F.col("text")))).collect()}
    totals = frame(spark).groupBy("source").agg(F.sum(mx.words_in(F.col("text"))).alias("source_size"))
    for r in mx.targets(totals).collect():
        assert r["target"] <= 3 * r["source_size"] + 1e-6
        assert abs(taken.get(r["source"], 0) - r["target"]) <= 2000
    copies = mixed.filter("doc_id is not null and doc_id != 5").groupBy("doc_id").count().agg(F.max("count")).head()[0]
    assert copies <= 3
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mx.mix(frame(spark)).collect()))


def replicas(spark, sources=240):
    """The same 60 sizes in every source, under ids of its own: each source is one draw of the sample."""
    sizes = [2 + 7 * k if k < 40 else 400 + 90 * (k - 40) for k in range(60)]
    rows = [(f"s{s:04d}", s * 1000 + k, size) for s in range(sources) for k, size in enumerate(sizes)]
    df = spark.createDataFrame(rows, "source string, id long, size long").withColumn("u", mx.uniform(F.col("id"), "t"))
    return df.cache(), sizes


def test_inclusion_frequencies_follow_unequal_probabilities(spark):
    df, sizes = replicas(spark)
    got = mx.apply_decisions(df, mx.decide(df)).select("source", (F.col("id") % 1000).alias("k"), "size", "p", "whole", "copies", "target").collect()
    by_target = {}
    for r in got:
        by_target.setdefault((r["target"], r["k"]), []).append(r)
    spread, scores = set(), []
    for (_, k), rows in by_target.items():
        assert len(rows) == 80 and len({(r["p"], r["whole"]) for r in rows}) == 1
        p = rows[0]["p"]
        spread.add((rows[0]["target"], round(p, 3)))
        seen = sum(r["copies"] - r["whole"] for r in rows) / 80
        if p > 0:
            scores.append((seen - p) / (p * (1 - p) / 80) ** 0.5)
        else:
            assert seen == 0
    # Probabilities differ within a source, and frequencies stray from them as draws do.
    assert all(len([x for x in spread if x[0] == t]) > 4 for t in {x[0] for x in spread})
    assert max(map(abs, scores)) < 4.5 and abs(sum(scores)) / len(scores) < 0.35
    assert sum(x * x for x in scores) / len(scores) < 1.4
    # The size of a sample is fixed: every source comes within half a document of its target.
    words = {}
    for r in got:
        words[r["source"]] = words.get(r["source"], -r["target"]) + r["copies"] * r["size"]
    assert max(map(abs, words.values())) <= max(sizes) / 2


def test_the_odds_decide(spark, monkeypatch):
    """Ranked by the random number alone, the mix is another."""
    df, _ = replicas(spark, 12)
    run = lambda: sorted(map(tuple, mx.apply_decisions(df, mx.decide(df)).select("id", "copies").collect()))
    with_odds = run()
    assert with_odds == run()
    ranked = mx._ranked
    monkeypatch.setattr(mx, "_ranked", lambda rows, most: ranked(rows, most).withColumn("q", F.when(F.col("p") > 0, F.col("u"))).withColumn("bin", F.floor(F.col("u") * mx.BINS).cast("int")))
    assert with_odds != run()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mx.mix(df).count() == 0
