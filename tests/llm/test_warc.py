import hashlib
import io

import duckdb
import pyarrow as pa

from jurisloom.llm import warc

LONG = "é<p>payload</p>" * 20


def frame(spark):
    rows = [(5, "http://a", LONG), (3, "http://b", LONG), (9, None, LONG), (1, "http://c\r\nX: y", "short"), (2, "http://d", "short"), (4, "u", None), (6, "u", ""), (7, "u", "x" * 5000), (8, "u", "x" * 5000), (10, "u", "y" * 100)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_query_matches_sql(spark, tmp_path):
    frame(spark).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, warc.op9_warc(spark, str(tmp_path)).collect()))
    c = duckdb.connect()
    c.sql(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == sorted(c.sql(warc.OP9_SQL).fetchall())


def test_chunks_rebuild_payloads(spark, tmp_path):
    rows = warc.classify(frame(spark).withColumnRenamed("page_id", "id"), "id").drop("html")
    files = warc.write_archives(warc.chunks(rows, 700), f"file://{tmp_path}")
    files.write.parquet(f"{tmp_path}/files")
    got = warc.read_archives(spark.read.parquet(f"{tmp_path}/files"), 999).orderBy("id", "chunk").collect()
    payloads: dict = {}
    for r in got:
        payloads[r["id"]] = payloads.get(r["id"], b"") + r["bytes"]
        assert r["running_digest"] == hashlib.sha256(payloads[r["id"]]).hexdigest()
        assert r["n_bytes"] <= 999
    assert payloads[7] == b"x" * 5000 and payloads[8] == b"" and payloads[3] == LONG.encode() and payloads[4] == b""
    assert max(r["chunk"] for r in got if r["id"] == 7) == 5
    assert {r["refers_to"] for r in got if r["record_type"] == "revisit"} == {3, 7}


def test_a_cut_archive_is_refused(spark, tmp_path):
    rows = warc.classify(frame(spark).withColumnRenamed("page_id", "id"), "id").drop("html").coalesce(1)
    file = warc.write_archives(warc.chunks(rows), f"file://{tmp_path}").collect()[0]["file"].removeprefix("file://")
    data = open(file, "rb").read()
    try:
        list(warc.records_of(pa.PythonFile(io.BytesIO(data[:-40]), mode="r")))
    except ValueError:
        return
    raise AssertionError("no error")


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "u", LONG, "x"), (1, "u", LONG, "x"), (None, "u", LONG, "x"), (2, "u", LONG, "x")], "id long, url string, html string, digest string")
    assert {r["digest"] for r in warc.classify(df, "id").collect()} == {"x"}
    got = sorted(((r["id"], r["record_type"], r["refers_to"]) for r in warc.classify(df, "id").collect()), key=str)
    assert got == [(1, "response", None), (1, "response", None), (2, "revisit", 1), (None, "revisit", 1)]
    assert warc.read_archives(warc.archive(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
