import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from jurisloom.llm import near_duplicates as nd
from jurisloom.llm.components import connected_components
from jurisloom.llm.shingles import sets, shingles, written_shingles


def brute(rows, threshold=0.8):
    """Class ids and links by comparing all pairs that share a shingle."""
    own = [frozenset(written_shingles(t)) for _, t in rows]
    by = defaultdict(list)
    for k, s in enumerate(own):
        for x in s:
            by[x].append(k)
    both = defaultdict(int)
    for members in by.values():
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                both[a, b] += 1
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links, texts = [0] * len(rows), [set() for _ in rows]
    for (a, b), n in both.items():
        if n >= threshold * (len(own[a]) + len(own[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            if own[a] != own[b]:
                texts[a].add(own[b])
                texts[b].add(own[a])
            up[find(a)] = find(b)
    small = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        ids = [x for x in (small.get(r), i) if x is not None]
        small[r] = min(ids) if ids else None
    return sorted(((i, small[find(k)], links[k], len(texts[k])) for k, (i, _) in enumerate(rows)), key=str)


def near_copies(n, words=120, seed=1):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    for _ in range(n):
        w = list(base)
        w[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        yield " ".join(w)


def classes(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "key").withColumnRenamed("doc_id", "class")
    got = nd.similarity_classes(df, "class", "key", **kw).collect()
    return sorted(((r["id"], r["class_id"], r["n_links"], r["n_text_links"]) for r in got), key=str)


def test_documents_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    rows += [(5000, None), (5001, ""), (5002, "!!!"), (5003, "two words"), (5004, "Two, words"), (5003, "two words"), (None, "no id here at all today"), (None, "no id here at all today"), (6000, "long " * 100_000)]
    assert classes(spark, rows) == brute(rows)


@pytest.mark.parametrize("size", [1, 7])
def test_large_components_in_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(nd, "BLOCK_TEXTS", 20 * size)
    rows = [(k * 3, t) for k, t in enumerate(near_copies(150))] + [(1000 + k, t) for k, t in enumerate(near_copies(40, 60, 2))]
    rows += [(2000 + k, rows[k % 3][1]) for k in range(30)]
    assert classes(spark, rows) == brute(rows)


def test_blocks_without_a_text(spark, monkeypatch):
    """Few long near copies are dealt into more blocks than get a text; a pair counts once all the same."""
    monkeypatch.setattr(nd, "BLOCK_SHINGLES", 150)
    rows = [(100 * c + k, t) for c in range(12) for k, t in enumerate(near_copies(2 + c % 4, 120, 10 + c))]
    assert classes(spark, rows) == brute(rows)


def test_recall_at_the_threshold():
    """Pairs of similarity just over 0.8 share a band as often as aimed at."""
    bands, rows = nd.choose_bands()
    assert 1 - (1 - 0.8**rows) ** bands >= nd.RECALL
    rng = np.random.default_rng(0)
    hit = 0
    for _ in range(300):
        h = rng.integers(0, 2**63, 1100).astype(np.uint64)
        a, b = h[:1000], h[110:]
        sig = nd.band_hashes(np.concatenate((a, b)), np.array([0, 1000]), bands, rows)
        hit += (sig[0] == sig[1]).any()
    assert hit == 300


def test_intersections_both_ways():
    rng = np.random.default_rng(3)
    own = [np.unique(rng.integers(0, 300, 120)).astype(np.uint64) for _ in range(40)]
    left, right = np.triu_indices(40, 1)
    want = [len(set(own[a]) & set(own[b])) for a, b in zip(left, right)]
    assert nd.intersections(own, left, right).tolist() == want
    assert nd.intersections(own, left[:20], right[:20]).tolist() == want[:20]


def test_one_of_each(spark):
    copies = list(near_copies(6, 200))
    rows = [(9, copies[0], "a"), (4, copies[1], "b"), (4, copies[1], "b"), (7, "alone " * 3, "c"), (8, None, "d"), (10, "", "e"), (4, "another text under the same id", "f"), (12, copies[2], "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string")
    got = nd.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame([rows[1], rows[3], rows[4], rows[5], rows[6]], df.schema).collect()))


def test_components(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 50)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(80)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    roots = nd._roots(400, np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    assert got == {x: roots[x] for e in edges if e[0] != e[1] for x in e}


def test_shingles_match_their_definition():
    texts = ["a b c d e f", None, "", "!!", "Word", "two words", "é É x y z w v", "x" * 1000 + " a b c d " + "y" * 100, "1 2 3 4", "a b c d e", "tail word"] * 2
    assert [len(s) for s in sets(pa.array(texts))] == [len(written_shingles(t)) for t in texts]
    doc, h = shingles(pa.array(texts))
    assert (np.diff(doc) >= 0).all() and len(set(h[doc == 0]) - set(h[doc == 11])) == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert nd.similarity_classes(df).count() == 0
    assert nd.one_of_each(df).count() == 0
