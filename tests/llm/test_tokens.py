import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from jurisloom.llm import encoding as en
from jurisloom.llm import token_counts as tc
from jurisloom.llm import token_output as to

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "a", "a" * 900, " " * 500 + "x", "<|endoftext|>" * 60, "ab <|endoftext|>cd  \n" * 50, "é" * 700, "don't we'll " * 90, "\n \n" * 200, "日本語 " * 200, " lead", "trail ", "a\t b  c \n d", "<|endo" * 50]


def whole(text):
    return en.coder(PATH).encode_many([text])[0]


@pytest.mark.parametrize("text", ODD)
@pytest.mark.parametrize("sizes", [(60, 20, 15), (200, 40, 20)])
def test_chunks_join_to_the_whole_encoding(text, sizes):
    assert [i for run in en.encode_long(text, en.coder(PATH), *sizes) for i in run] == whole(text)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab '\n\té1!<|>endoftx  \x85\xa0\x1c\u2028²½ªß日🙂\u0301", max_size=400) | st.text(max_size=200))
def test_chunks_and_pieces_of_any_text(text):
    assert [i for run in en.encode_long(text, en.coder(PATH), 50, 10, 15) for i in run] == whole(text)
    assert en.text_encoder(PATH).encode(text).tolist() == whole(text)


def library(texts):
    return en.coder(PATH).encode_many(texts)


def test_every_character_below_the_limit_against_the_library():
    """Each one alone, doubled, between letters, numbers, marks, spaces and the ends of texts."""
    texts = []
    for c in map(chr, range(en.LATIN_END + 40)):
        texts += [c, c + c, f"a{c}b", f"a {c}b", f"1{c}2 {c}3", f"!{c}? {c}!", f"  {c} {c}{c} x", f"\n{c}\t{c}", f"'{c}'s{c}'ll", f"x{c} ", f"{c}  y"]
    got = en.text_encoder(PATH).encode_many(pa.array(texts))
    assert [x.tolist() for x in got] == library(texts)
    assert en.text_encoder(PATH).counts(pa.array(texts)).tolist() == [len(x) for x in got]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abstrvelmd1' \n\t.\x85\xa0\x1cé²ªß\u024f", max_size=30) | st.none(), max_size=12))
def test_many_texts_at_once(texts):
    got = en.text_encoder(PATH).encode_many(pa.array(texts, pa.string()))
    assert [x.tolist() for x in got] == library([t or "" for t in texts])


def test_generations_of_pre_tokens(monkeypatch):
    monkeypatch.setattr(en, "CACHED_PIECES", 7)
    encode = en.TextEncoder(en.coder(PATH))
    texts = [" ".join(f"w{k * m % 31}" for k in range(60)) for m in range(9)]
    for _ in range(2):
        assert [x.tolist() for x in encode.encode_many(pa.array(texts))] == library(texts)
    assert len(encode.words) <= 7


def test_tables_of_huge_and_of_other_scripts(spark):
    """Whole tables in which every text is over the chunk, or in another script, of the real sizes."""
    texts = ["Words and more words, 12 of them; don't stop. " * 900, "слова и ещё слова 日本語のテキスト " * 1500, "x" * 70_000, " \n" * 30_000, "naïve café " * 4000 + "終"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [len(x) for x in library(texts)]
    assert [r[0] for r in tc.count_tokens(df, PATH).orderBy("doc_id").select("n_tokens").collect()] == want
    got = sorted(to.token_output(df, PATH).collect())
    assert [r["n_tokens"] - 1 for r in got] == want
    assert [r["ids_crc32"] for r in got] == [zlib.crc32(np.array([*x, 0], "<u4").tobytes()) for x in library(texts)]


def test_shards_follow_ranges_of_ids(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    shards = to.write_shards(docs, PATH, shard_bytes=20_000).orderBy("shard").collect()
    assert len(shards) > 5
    start, before = 0, -1
    for s in shards:
        r = to.ShardReader(s["file"])
        assert s["start"] == start and (np.diff(r.doc_ids) >= 0).all() and r.doc_ids[0] > before
        start, before = start + s["n_ids"], r.doc_ids[-1]


@pytest.mark.parametrize("bits", [1, 7, 8, 15, 16, 17, 31, 32])
def test_pack_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001).astype(np.uint32)
    assert (to.unpack(to.pack(ids, bits), 1001, bits) == ids).all()
    assert len(to.pack(ids, bits)) == -(-1001 * bits // 8)


def test_queries_match_the_library(spark, tmp_path):
    rows = [(i * 3, t) for i, t in enumerate(ODD)] + [(3, None), (None, "no id"), (6, "tie"), (6, "tie")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", df_lit("clash"))
    got = tc.count_tokens(df, PATH).select("doc_id", "text", "n_tokens").collect()
    assert sorted((r[0] or -1, r[1] or "", r[2]) for r in got) == sorted((i or -1, t or "", len(whole(t or ""))) for i, t in rows)
    got = to.token_output(df, PATH).collect()
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, np.array([*whole(r[1] or ""), 0], "<u2").tobytes())):
        ids = np.array([*whole(t or ""), 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def df_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_small_blocks_and_random_access(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(to, "BLOCK_IDS", 8)
    with to.whole_file(f"file://{tmp_path}", "x.tok") as out:
        w = to.ShardWriter(out, 13)
        docs = [np.arange(n, dtype=np.uint32) * 7 % 8000 for n in (0, 3, 50, 1, 8, 8)]
        for k, d in enumerate(docs):
            w.add(k, d)
        w.close()
    r = to.ShardReader(f"file://{tmp_path}/x.tok")
    flat = np.concatenate(docs)
    for a in range(0, 70, 7):
        assert (r.ids(a, min(70, a + 13)) == flat[a : a + 13]).all()
    assert r.starts.tolist() == [0, 0, 3, 53, 54, 62, 70]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tc.count_tokens(df, PATH).count() == 0
    assert to.token_output(df, PATH).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_counts_of_other_tokenizers(spark, name):
    path = public_tokenizers.path(name)
    texts = [*ODD, "Plain words, and MORE words. " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tc.count_tokens(df, path, chunk=500).collect()}
    code = en.coder(path)
    assert got == {k: len(code.encode_many([t])[0]) if t else 0 for k, t in enumerate(texts)}
    assert en.coder(public_tokenizers.path("byte_bpe_50k.json")).resynchronises


def test_bits():
    assert [to.bits_for(n) for n in (1, 2, 3, 256, 257, 50257)] == [1, 1, 2, 8, 9, 16]
