"""Every query against its SQL, on the smallest tables."""

import os
import re

import duckdb
import pytest

from jurisloom import queries as q

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, duck, name):
    df = q.queries()[name](spark, DIR)
    got = sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))
    sql = q.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = duck.sql(sql)
    assert sorted(rel.columns) == sorted(df.columns)
    order = [rel.columns.index(c) for c in sorted(rel.columns)]
    assert got == sorted(repr(tuple(r[k] for k in order)) for r in rel.fetchall())


def rows_of(spark, tmp_path, name, key=None, **tables):
    """Sorted rows of a query and of its SQL over small tables."""
    c = duckdb.connect()
    for t, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        c.sql(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    df = q.queries()[name](spark, str(tmp_path))
    rel = c.sql(q.oracle_sql()[name])
    assert rel.columns == df.columns
    return sorted(map(tuple, df.collect()), key=key), sorted(rel.fetchall(), key=key)


def test_clean_text_on_odd_markup(spark, tmp_path):
    """Entities cut by a tag, others than the named ones, line separators at the end, letters that fold to ASCII."""
    odd = [
        "a &amp<style>p{margin:0}</style>b", "&&&am<b>p;</b>x", "AT&T &eacute;t&#233; &#x2014; &notit; &copy", "&amp;lt;&amp;amp;&nbsp;&#39;", "&ampp &lt &gt;", "&amp;eacute; &quot;",
        "end \u2028", "end\n\u0085", "end \u2029\n", " x\r\n\u2028", "a<BLOC\u212aQUOTE>b</bloc\u212aquote >c", "a<P\n>b<d\u0131v>c", "<", "", None, "&nbsp", "<li/>&middot;<br x=1/>y",
    ]
    got, want = rows_of(spark, tmp_path, "clean_text", pages=("page_id long, html string", list(enumerate(odd))))
    assert got == want


def test_jaccard_pairs_on_odd_texts(spark, tmp_path):
    """Letters beyond the SQL's table, ids that are null or repeat, empty texts, copies, a long text beside short ones."""
    items = [(1, "\ufb01nance ﬃ publique naturelle"), (2, "État général dépenses \u0130stanbul \u212aelvin"), (None, "alpha beta gamma delta"), (4, ""), (5, None), (6, "alpha"), (6, "alpha epsilon")]
    docs = [(1, "finance publique naturelle"), (2, "etat general depenses istanbul kelvin"), (None, "alpha beta gamma"), (3, "alpha " + " ".join(f"w{k}x" for k in range(300))), (4, "alpha epsilon")]
    docs += [(4, "alpha epsilon"), (5, "nance"), (6, None), (7, "de la des"), (8, "alpha beta gamma delta " + " ".join(f"w{k}x" for k in range(20)))]
    got, want = rows_of(spark, tmp_path, "jaccard_pairs", key=repr, benchmark=("item_id long, text string", items), documents=("doc_id long, text string", docs))
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_core_never_imports_the_corpus_operators():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "jurisloom")
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) in ("llm", "__pycache__"):
            continue
        for f in files:
            if f.endswith(".py"):
                source = open(os.path.join(folder, f), encoding="utf-8").read()
                assert not re.search(r"^\s*(?:from|import)\s.*\bllm\b", source, re.M), f
