import hashlib
import math
import random
import re
from collections import Counter

import pytest
import xxhash

from jurisloom.llm import fingerprints as fp

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def weights(text):
    words = WORD.findall(text.lower()) or [text]
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def jaccard(a, b):
    a, b = weights(a), weights(b)
    return sum((a & b).values()) / sum((a | b).values())


def chain(rows):
    """Edited texts and next documents by plain sorting."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    for k, (i, text) in enumerate(order):
        text, follow = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 3
        yield i, text, text[: len(text) - cut] + follow[:cut], follow


def hashed(*values):
    """The engine's xxhash64 of columns: each one's hash seeds the next."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else (v[0].to_bytes(4, "little") if isinstance(v, tuple) else (v & M64).to_bytes(8, "little"))
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed


M64 = (1 << 64) - 1


def samples(text):
    """All draws of all terms, as the definition has them: ``r, c ~ Gamma(2, 1)``, ``b`` uniform."""
    words = [hashed(x) for x in WORD.findall(text.lower())] or [hashed((0,), text)]
    runs = [words] if len(words) < 5 else [words[i : i + 5] for i in range(len(words) - 4)]
    weight = Counter(hashed(*x) for x in runs)
    out = []
    for k in range(fp.SAMPLES):
        best = None
        for t, w in weight.items():
            chunk = hashed(t, (k // 4,)) >> 16 * (k % 4) & 0xFFFF
            g = hashed(t, (k,), (1,))
            u = lambda shift, n, g=g: ((g >> shift & (1 << n) - 1) + 0.5) / (1 << n)
            x, d, e = -math.log(1 - (chunk + u(0, 24)) / 65536), -math.log(u(24, 20)), -math.log(u(44, 20))
            c, r = x + d, e + math.log((x + d) / x)
            b = e / r
            z = math.floor(math.log(w) / r + b)
            best = min(best or (math.inf,), (math.log(c) - r * (z - b + 1), t, z))
        out.append(hashed(best[1], best[2]) & 0xFFFFFFFF)
    return out


def signature(r):
    return [int(r[8 * k : 8 * k + 8], 16) for k in range(fp.SAMPLES)]


TEXTS = [
    "", "!!! ###", "one", "Two Words", "four words are here", "word " * 3000, "a b c d e " * 40, "x y z w v " * 7 + "and now something else " * 3, "Élan vital, ça va? " * 3,
    " ".join(f"t{k}" for k in range(12)), " ".join(f"t{k}" for k in range(400)), "line one of the text\n" * 30 + " ".join(f"t{k}" for k in range(60)),
]


def test_every_sample_against_all_draws(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 3000").select("text")
    texts = TEXTS + [r[0] for r in docs.limit(25).collect()]
    got = fp.fingerprint(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {r["doc_id"]: signature(r["fingerprint"]) for r in got}
    for k, text in enumerate(texts):
        assert found[k] == samples(text), text[:40]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 20, 40])
def test_few_and_heavy_terms(spark, n):
    """Texts of n terms with weights of 1 to 60: the share of equal samples strays from the similarity as a mean of independent draws does."""
    rng = random.Random(n)
    pairs = []
    for _ in range(40):
        terms = [" ".join(f"{rng.randrange(10**9)}" for _ in range(5)) for _ in range(n + n // 2)]
        heavy = [rng.choice([1, 1, 2, 7, 60]) for _ in terms]
        # A weight is that of a term repeated; breaks of single words keep other runs apart.
        build = lambda some: " ".join(f"{terms[i]} " * m for i, m in some)
        a = [(i, heavy[i]) for i in range(n)]
        b = [(i, rng.choice([heavy[i], rng.choice([1, 2, 7, 60])])) for i in range(n // 2, n + n // 2)]
        pairs.append((build(a), build(b)))
    texts = [t for p in pairs for t in p]
    rows = fp.fingerprint(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    sig = {r["doc_id"]: signature(r["fingerprint"]) for r in rows}
    scores = []
    for k, (a, b) in enumerate(pairs):
        j = jaccard(a, b)
        same = sum(x == y for x, y in zip(sig[2 * k], sig[2 * k + 1], strict=True)) / fp.SAMPLES
        spread = max((j * (1 - j) / fp.SAMPLES) ** 0.5, 1e-9)
        if 0.02 < j < 0.98:
            scores.append((same - j) / spread)
        else:
            assert abs(same - j) < 0.08
    if scores:
        assert max(map(abs, scores)) < 5
        assert abs(sum(scores)) / len(scores) ** 0.5 < 4
    if len(scores) > 10:
        assert 0.3 < sum(x * x for x in scores) / len(scores) < 2


@pytest.mark.parametrize("bucket_bytes", [1 << 30, 40_000])
def test_against_brute_force(spark, bucket_bytes):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(r[0] * 7 % 211, r[1]) for r in docs]
    rows += [(1000, ""), (1001, None), (None, "no id at all"), (1002, "!!! ###"), (1003, "short text"), (1004, "word " * 3000), (1005, docs[5][1])]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {(r["id"], r["n_chars"], r["edited_sha256"]): r for r in fp.fingerprint_with_neighbours(df, bucket_bytes).collect()}
    want = list(chain(rows))
    assert len(got) == len(want) == len(rows)
    errors, by_text = [], {}
    for i, text, edited, follow in want:
        r = got[i, len(text), hashlib.sha256(edited.encode()).hexdigest()]
        errors += [r[c] - jaccard(text, other) for c, other in (("near_edited", edited), ("near_next", follow))]
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert (r["fingerprint"] == r["edited_fingerprint"]) <= (r["near_edited"] == 1.0)
    assert abs(sum(errors)) / len(errors) < 0.01
    assert max(map(abs, errors)) < 0.2


def test_collision_rate_is_the_generalised_jaccard(spark):
    a = " ".join(f"a{k}" for k in range(1500))
    for keep in (300, 900, 1350):
        b = " ".join([*(f"a{k}" for k in range(keep)), *(f"b{k}" for k in range(1500 - keep))])
        sigs = [r["fingerprint"] for r in fp.fingerprint(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).orderBy("doc_id").collect()]
        same = sum(sigs[0][8 * k : 8 * k + 8] == sigs[1][8 * k : 8 * k + 8] for k in range(fp.SAMPLES)) / fp.SAMPLES
        assert abs(same - jaccard(a, b)) < 0.13


def test_weights_count(spark):
    a, b = "x y z w v " * 40, "x y z w v " * 10
    sigs = [r[1] for r in fp.fingerprint(spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")).orderBy("doc_id").collect()]
    assert sigs[0] == sigs[2] and sigs[0] != sigs[1]


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert fp.fingerprint_with_neighbours(df).count() == 0
    assert fp.fingerprint(df).count() == 0


def test_clashing_names_and_repeated_rows(spark):
    names = ["n", "bucket", "row", "sigs", "word", "term", "info", "text", "k", "fingerprint"]
    rows = [(1, 2, "r", None, "w", 3.5, "i", "some words of a text", 4, "old")] * 3 + [(None,) * 10]
    df = spark.createDataFrame(rows, "n int, bucket int, row string, sigs string, word string, term double, info string, text string, k long, fingerprint string")
    got = fp.fingerprint(df).collect()
    assert len(got) == 4 and sorted(got[0].asDict()) == sorted(names)
    assert sorted(map(str, (tuple(r[c] for c in names[:-1]) for r in got))) == sorted(map(str, (r[:-1] for r in rows)))
    assert len({r["fingerprint"] for r in got if r["text"]}) == 1 and all(len(r["fingerprint"]) == 8 * fp.SAMPLES for r in got)
    assert fp.fingerprint(df, out_col="mine").columns == [*names, "mine"]
