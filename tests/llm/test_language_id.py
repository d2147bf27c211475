import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from jurisloom.llm import language_id as li


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = li.op7_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert found.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).head()[0] > 0.95


def test_mixture_shares(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs, model, bits = li.train(li.learned_part(docs))
    text = {x: " ".join(r[0] for r in docs.filter(F.col("lang") == x).select("text").limit(30).collect())[:6000] for x in langs}
    a, b = langs[0], langs[1]
    share, noise = li.infer(pa.array([text[a], text[a][:3000] + text[b][:3000], text[a][:4500] + text[b][:1500]]), model, bits)
    assert share[0].argmax() == 0 and share[0, 0] > 0.9
    assert abs(share[1, 0] - 0.5) < 0.15 and abs(share[1, 1] - 0.5) < 0.15
    assert abs(share[2, 1] - 0.25) < 0.12
    assert (noise < 0.2).all()
    junk = "".join(np.random.default_rng(0).choice(list("qxzjkvwy"), 3000))
    assert li.infer(pa.array([junk]), model, bits)[1][0] > 0.5


def likeliest(text, model, bits):
    """Proportions of the best of all nested sets, each fitted by many steps in double precision."""
    _, cell, n = li.counts(pa.array([text]), bits)
    p = np.column_stack((model[cell], np.full(len(cell), 1 / (1 << bits)))).astype(float)
    langs = p.shape[1] - 1

    def fit(some):
        q, theta = p[:, [*some, langs]], np.full(len(some) + 1, 1 / (len(some) + 1))
        for _ in range(3000):
            theta = theta * (q / (q @ theta)[:, None] * n[:, None]).sum(0) / n.sum()
        return theta, n @ np.log(q @ theta)

    order = np.argsort(-fit(range(langs))[0][:-1], kind="stable")
    best = None
    for k in range(1, langs + 1):
        theta, value = fit(order[:k])
        value = value / li.SHARED - k * 0.5 * np.log(max(n.sum() / li.SHARED, 2))
        if best is None or value > best[0]:
            best = value, k, theta
    out = np.zeros(langs + 1)
    out[order[: best[1]]], out[-1] = best[2][:-1], best[2][-1]
    return out


def test_sets_of_any_size():
    """Texts in one to eight languages against a search of all nested sets."""
    rng, bits = np.random.default_rng(4), 14
    words = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 9))) for _ in range(80)] for _ in range(8)]
    # Neighbouring languages share words.
    words = [own + words[k - 1][:25] for k, own in enumerate(words)]
    model = np.array([np.bincount(li.trigrams(pa.array([" ".join(rng.choice(w, 4000))]), bits)[1], minlength=1 << bits) for w in words]) + li.SMOOTHING
    model = np.ascontiguousarray((model / model.sum(1, keepdims=True)).T.astype(np.float32))
    texts = [" ".join(x for k in range(m) for x in rng.choice(words[k], 20 + 15 * k)) for m in range(1, 9)]
    share, noise = li.infer(pa.array(texts), model, bits)
    want = np.array([likeliest(t, model, bits) for t in texts])
    assert (want[:, :-1] > 0).sum(1).max() > 4
    assert ((share > 0) == (want[:, :-1] > 0)).all()
    assert abs(share - want[:, :-1]).max() < 0.01 and abs(noise - want[:, -1]).max() < 0.01
    alone = np.concatenate([li.infer(pa.array([t]), model, bits)[0] for t in texts])
    assert abs(alone - share).max() < 1e-5


def test_text_in_four_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs, model, bits = li.train(li.learned_part(docs))
    text = " ".join(" ".join(r[0] for r in docs.filter(F.col("lang") == x).select("text").limit(30).collect())[:3000] for x in langs)
    share, noise = li.infer(pa.array([text]), model, bits)
    assert len(langs) == 4 and (abs(share[0] - 0.25) < 0.1).all() and noise[0] < 0.05


def test_edges(spark):
    rows = [(k, f"the cat sat on the mat number {k}", "en") for k in range(40)] + [(100 + k, f"die katze lag auf der matte {k}", "de") for k in range(40)]
    rows += [(200, None, "en"), (201, "", "en"), (202, "123 !!! 456", None), (203, "a", None), (None, "the cat", "en"), (204, "the " * 100_000, None), (5, rows[5][1], "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumn("lang", F.col("score"))
    langs, model, bits = li.train(df)
    assert langs == ["de", "en"]
    got = {r["doc_id"]: r for r in li.predict(df, langs, model, bits).collect()}
    assert [got[k]["lang_pred"] for k in (200, 201, 202)] == ["und"] * 3
    assert got[203]["lang_pred"] in langs and got[204]["lang_pred"] == "en" and got[100]["lang_pred"] == "de"
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    langs, model, bits = li.train(empty)
    assert langs == [] and li.predict(empty, langs, model, bits).count() == 0
    assert {r["lang_pred"] for r in li.predict(df, langs, model, bits).collect()} == {"und"}
