"""Sources and flows over small archives made here."""

import io
import json
import os
import uuid
import tarfile
import urllib.error
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from jurisloom.operators import merge, reports
from jurisloom.plans import european, measures, national, obligations, stats
from jurisloom.sources import archives, jsonl, remote
from jurisloom.streaming import query_log


def article(ident="LEGIARTI1", state="VIGUEUR", content="<p>Premier</p>second&#160;mot", versions="", links="", end="2999-01-01", text='cid="LEGITEXT1" nature="code"'):
    return f"""<ARTICLE><META><META_COMMUN><ID>{ident}</ID><ORIGINE>LEGI</ORIGINE></META_COMMUN><META_SPEC><META_ARTICLE><NUM>L1</NUM><ETAT>{state}</ETAT>
<DATE_DEBUT>2001-02-03</DATE_DEBUT><DATE_FIN>{end}</DATE_FIN><TYPE>AUTONOME</TYPE></META_ARTICLE></META_SPEC></META>
<CONTEXTE><TEXTE {text}><TITRE_TXT c_titre_court="Code" id_txt="T1">Code long</TITRE_TXT><TM><TITRE_TM id="A">Livre I</TITRE_TM><TM><TITRE_TM id="B">Titre II</TITRE_TM></TM></TM></TEXTE></CONTEXTE>
<VERSIONS>{versions}</VERSIONS><BLOC_TEXTUEL><CONTENU>{content}</CONTENU></BLOC_TEXTUEL><NOTA><CONTENU>note</CONTENU></NOTA><LIENS>{links}</LIENS></ARTICLE>""".encode()


CHAIN = "".join(f'<VERSION><LIEN_ART id="{i}" debut="{d}"/></VERSION>' for i, d in (("LEGIARTI9", "1999-01-01"), ("LEGIARTI1", "2001-02-03"), ("LEGIARTI0", "")))
CHAIN = CHAIN.replace(' debut=""', "")
LINK = '<LIEN typelien="cite" sens="SOURCE" id="X1" cidtexte="C1" datesignatexte="2000-01-01">Loi <b>n° 1</b></LIEN>'


def test_article_fields():
    a = national.parse_article(article(versions=CHAIN, links=LINK * 2), "arc", "p.xml")
    assert a["reject_reason"] is None
    assert a["version"]["contenu"] == "Premier\nsecond mot" and a["version"]["date_fin"] is None and str(a["version"]["date_debut"]) == "2001-02-03"
    assert a["unite"]["source_id"] == "LEGIARTI9" and [p["titre"] for p in a["unite"]["chemin"]] == ["Code", "Livre I", "Titre II"]
    assert [p["niveau"] for p in a["unite"]["chemin"]] == [0, 1, 2] and a["texte"]["type"] == "CODE"
    r = a["relations"]
    assert len(r) == 2 and r[0]["id"] != r[1]["id"] and r[0]["libelle"] == "Loi n° 1" and r[0]["type_relation"] == "CITE" and r[0]["sens"] == "source"


@pytest.mark.parametrize(
    "data,why",
    [
        (b"<ARTICLE>", "UNPARSEABLE"), (b"<TEXTE/>", "OTHER_ROOT"), (b"<ARTICLE/>", "NO_META"), (article(ident=""), "NO_ID"), (article(state="abroge"), "EXCLUDED_STATE"),
        (article(content=" "), "EMPTY_CONTENT"), (article().replace(b"CONTEXTE", b"AUTRE"), "NO_CONTEXT"), (article(state=""), None), (article(text=""), None),
    ],
)
def test_rejections(data, why):
    assert national.parse_article(data, "a", "p")["reject_reason"] == why


def tar_of(path, members):
    with tarfile.open(path, "w:gz") as t:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))


def test_import_from_tar_and_again(spark, tmp_path):
    tar_of(tmp_path / "a.tar.gz", {"x/1.xml": article(versions=CHAIN, links=LINK), "x/2.xml": article("LEGIARTI2", "ABROGE"), "x/readme.txt": b"no", "x/3.xml": b"<OTHER/>"})
    counts = national.import_articles(spark, str(tmp_path / "a.tar.gz"), str(tmp_path / "out"))
    assert counts == {"xml_scanned": 3, "articles_xml": 2, "imported": 1, "ignored": 1, "relations": 1}
    again = article(versions=CHAIN, links=LINK, content="nouveau", text='cid="LEGITEXT1"').replace(b"<TM>", b"<X>").replace(b"</TM>", b"</X>")
    tar_of(tmp_path / "b.tar.gz", {"x/1.xml": again, "x/4.xml": article("LEGIARTI4")})
    national.import_articles(spark, str(tmp_path / "b.tar.gz"), str(tmp_path / "out"))
    read = lambda n: merge.Snapshots(spark, f"{tmp_path}/out/{n}", national.schemas.TABLES[n]).read()
    v = {r["source_id"]: r["contenu"] for r in read("version").collect()}
    assert v == {"LEGIARTI1": "nouveau", "LEGIARTI4": "Premier\nsecond mot"}
    assert read("texte").head()["type"] == "CODE"
    assert read("unite").count() == 2


def test_sources_refuse_what_they_cannot_read(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a")
    with pytest.raises(ValueError):
        archives.read_xml(spark, str(tmp_path / "x.csv"))
    with pytest.raises(FileNotFoundError):
        archives.read_xml(spark, str(tmp_path / "none.xml"))
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.xml").write_bytes(article())
    assert archives.read_xml(spark, str(tmp_path / "d")).count() == 1
    assert archives.read_xml(spark, str(tmp_path / "d" / "a.xml")).count() == 1


ACT = b"<ACT><ENACTING.TERMS><DIVISION><TITLE><TI>Chapitre I</TI></TITLE><ARTICLE><TI.ART>Article 1</TI.ART><PARAG><NO.PARAG>1.</NO.PARAG><ALINEA>Avant<LIST><ITEM><NP><NO.P>a)</NO.P><P>A<LIST><ITEM><NP><NO.P>i)</NO.P><TXT>B</TXT></NP></ITEM></LIST></P></NP></ITEM></LIST></ALINEA></PARAG></ARTICLE></DIVISION></ENACTING.TERMS></ACT>"


def rows_of(xml):
    return european.parse_formex(xml, "32000L0060", "u", "u/act.xml")["provisions"]


def test_provision_trees():
    r = rows_of(ACT)
    assert [x["kind"] for x in r] == ["ARTICLE", "PARAGRAPH", "ALINEA", "LIST_ITEM", "LIST_ITEM"]
    assert [x["list_path"] for x in r[3:]] == [["a)"], ["a)", "i)"]] and r[0]["division_path"] == ["Chapitre I"]
    assert r[1]["parent_id"] == r[0]["provision_id"] and r[4]["parent_id"] == r[3]["provision_id"] and [x["ordinal"] for x in r] == [1, 2, 3, 4, 5]
    quoted = rows_of(b"<ACT><ENACTING.TERMS><ARTICLE><TI.ART>1</TI.ART><ALINEA><P>X<QUOT.S><ARTICLE><TI.ART>99</TI.ART></ARTICLE></QUOT.S>Y</P></ALINEA></ARTICLE></ENACTING.TERMS></ACT>")
    assert [x["kind"] for x in quoted] == ["ARTICLE", "ALINEA"] and quoted[1]["text"] == "X Y"
    annex = rows_of(b"<ANNEX><TITLE><TI>Annex I</TI></TITLE><CONTENTS><P>A</P><TBL><CORPUS>B</CORPUS></TBL><X/></CONTENTS></ANNEX>")
    assert [x["kind"] for x in annex] == ["ANNEX", "ANNEX_BLOCK", "ANNEX_BLOCK"] and annex[0]["heading"] == "Annex I"
    assert european.parse_formex(b"<ANNEX/>", "c", "u", "m")["warnings"][0]["code"] == "ANNEX_NO_CONTENTS"
    assert european.parse_formex(b"<ACT/>", "c", "u", "m")["warnings"][0]["code"] == "ACT_NO_ENACTING_TERMS"
    assert european.parse_formex(b"<ACT>", "c", "u", "m")["parse_error"]
    assert european.parse_formex(b"<TOC/>", "c", "u", "m")["provisions"] == []


def test_european_flow(spark, tmp_path):
    doc = b'<DOC CELEX="32000L0060" ELI="http://data.europa.eu/eli/dir/2000/60"><REF>32000L0060</REF></DOC>'
    fix = b'<DOC CELEX="32000L0061"/>'
    (tmp_path / "eu.zip").write_bytes(archives.zip_of({"u/a.doc.xml": doc, "u/act.fmx.xml": ACT, "u/bad.fmx.xml": b"<A>", "w/b.doc.xml": fix, "w/c.fmx.xml": ACT, "u/x.txt": b""}))
    content = archives.read_xml(spark, str(tmp_path / "eu.zip"))
    members = european.inventory(content)
    assert members.count() == 5
    o = {r["cellar_uuid"]: r for r in european.objects(members).collect()}
    assert o["u"]["xml_files"] == 3 and o["u"]["parse_errors"] == 1 and o["u"]["roots"] == {"<ERROR>": 0, "A": 1, "ACT": 1, "DOC": 1} or o["u"]["roots"]["ACT"] == 1
    offline = european.decide_identity(european.weigh_candidates(members), members)
    got = {r["cellar_uuid"]: (r["status"], r["celex"], r["act_type"]) for r in offline.collect()}
    assert got == {"u": ("RESOLVED", "32000L0060", "DIRECTIVE"), "w": ("RESOLVED", "32000L0061", "DIRECTIVE")}
    same = "http://publications.europa.eu/resource/celex/"
    answers = spark.createDataFrame([("u", None, [same + "32000L0060"]), ("w", "SPARQL_ERROR", [])], "cellar_uuid string, status string, same_as array<string>")
    remote_ = european.classify_aliases(answers)
    identity = european.reconcile(offline, remote_)
    got = {r["cellar_uuid"]: (r["status"], r["comparison"]) for r in identity.collect()}
    assert got == {"u": ("RESOLVED", "SPARQL_CONFIRMS_FMX"), "w": ("RESOLVED_FALLBACK", "SPARQL_ERROR_FMX_FALLBACK")}
    parsed = european.provisions(identity, members, content.select(F.col("path").alias("member"), "content"))
    rows = parsed.select(F.explode("provisions").alias("p")).select("p.*")
    assert {r["cellar_uuid"] for r in rows.collect()} == {"u"} and rows.count() == 5
    done = european.normalise(identity, rows)
    ready = european.prepare_import(done["documents"].select("celex", "cellar_uuid", F.lit("T").alias("title")), done["provisions"])
    assert ready["provisions"].count() == 5 and ready["invalid"].count() == 0
    european.check_import(5, 5, 5)
    with pytest.raises(ValueError):
        european.check_import(5, 4, 4)


def test_corrigenda_and_synthetic_parents(spark):
    identity = spark.createDataFrame([("a", "RESOLVED", "32014L0001"), ("b", "RESOLVED", "32014L0001R(01)"), ("c", "RESOLVED", "32015L0009R(02)")], "cellar_uuid string, status string, celex string")
    rows = spark.createDataFrame([("p1", "32014L0001R(01)", "ARTICLE", 1, ""), ("p2", "32015L0009R(02)", "ARTICLE", 2, "x"), ("", "32014L0001", "ARTICLE", 3, "x")], "provision_id string, celex string, kind string, ordinal int, text string")
    done = european.normalise(identity, rows)
    assert {(r["celex"], r["target_status"]) for r in done["relations"].collect()} == {("32014L0001R(01)", "PRESENT"), ("32015L0009R(02)", "ABSENT")}
    ready = european.prepare_import(done["documents"].select("celex", "cellar_uuid"), done["provisions"])
    assert {r["celex"] for r in ready["acts"].filter("synthetic").collect()} == {"32015L0009"}
    assert [r["problems"] for r in ready["invalid"].collect()] == [["MISSING_PROVISION_ID"]] and ready["provisions"].count() == 2


def test_measures_over_triples(spark):
    same, rel = measures.SAME_AS, measures.CDM + measures.RELATIONS[1]
    t = [("w1", same, measures.CELEX_URI + "32000L0060"), ("n1", same, measures.CELEX_URI + "72000L0060FRA_240395"), ("n2", same, measures.CELEX_URI + "7%2AFRA_17"), ("n3", same, measures.CELEX_URI + "72000L0060DEU_1"),
         ("n1", rel, "w1"), ("n1", rel, "w1"), ("w1", rel, "n2"), ("n3", rel, "w1"), ("n1", measures.CDM + "work_title", "T"), ("n1", measures.CDM + "resource_legal_id_local", "A"), ("n1", measures.CDM + "resource_legal_id_local", "B")]
    triples = spark.createDataFrame(t, "s string, p string, o string")
    identity = spark.createDataFrame([("RESOLVED", "DIRECTIVE", "32000L0060"), ("RESOLVED", "DIRECTIVE", "32000L0060R(01)"), ("RESOLVED", "REGULATION", "32000R0001")], "status string, act_type string, celex string")
    wanted = measures.directives(identity)
    assert [r[0] for r in wanted.collect()] == ["32000L0060"]
    found = measures.edges(triples, wanted)
    assert {(r["nim_celex"], r["direction"], r["shape"], r["database_id"]) for r in found.collect()} == {("72000L0060FRA_240395", "NIM_TO_DIRECTIVE", "STANDARD", 240395), ("7*FRA_17", "DIRECTIVE_TO_NIM", "MULTI_ACT_STAR", 17)}
    links = measures.logical_links(found)
    assert links.count() == 2 and all(len(r["evidence"]) == 1 for r in links.collect())
    meta = measures.metadata(triples, spark.createDataFrame([("n1",), ("n9",)], "work string"))
    got = {r["nim_work"]: r for r in meta.collect()}
    assert got["n1"]["title"]["value"] == "T" and got["n1"]["national_local_id"]["status"] == "MULTIPLE" and got["n1"]["national_local_id"]["value"] is None
    assert got["n9"]["title"]["status"] == "MISSING"
    flat = {r["nim_work"]: r["ambiguous_fields"] for r in measures.flat(meta).collect()}
    assert flat == {"n1": ["national_local_id"], "n9": []}
    assert measures.coverage(meta).head()["national_local_id_ambiguous"] == 1


def test_remote_lookups():
    asked = []

    def transport(keys):
        asked.append(list(keys))
        if "bad" in keys:
            raise OSError("no")
        return {k: k.upper() for k in keys if k != "gone"}

    waits = []
    got = {k: (s, a) for k, s, a, _ in remote.ask(["a", "bad", "gone", "d"], transport, retries=2, pause=waits.append)}
    assert got == {"a": ("FOUND", '"A"'), "bad": ("ERROR", None), "gone": ("MISSING", None), "d": ("FOUND", '"D"')}
    assert waits[0] == 1.0
    cache = {}
    list(remote.ask(["a"], transport, cache=cache))
    n = len(asked)
    list(remote.ask(["a"], transport, cache=cache))
    assert len(asked) == n


def factory():
    return lambda keys: {k: {"n": len(k)} for k in keys}


def test_lookup_on_workers(spark):
    df = spark.createDataFrame([("a",), ("bb",), ("a",), (None,)], "k string")
    assert sorted((r["key"], json.loads(r["answer"])["n"]) for r in remote.look_up(df, "k", factory, batch=1).collect()) == [("a", 1), ("bb", 2)]


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"k":"a","v":1}\n\n{"k":"b","v":2}\n{"k":"a","v":3}\n{"k":"c","v"\n')
    got = {r["k"]: r["v"] for r in jsonl.read_resumable(spark, str(tmp_path / "x.jsonl"), "k string, v long", "k").collect()}
    assert got == {"a": 3, "b": 2}
    with pytest.raises(Exception):
        jsonl.read_jsonl(spark, str(tmp_path / "x.jsonl"), "k string, v long").collect()


def test_merge_rules(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", [1]), (2, "b", [2])], "id int, name string, path array<int>")
    new = spark.createDataFrame([(1, None, []), (3, "c", [])], "id int, name string, path array<int>")
    got = {r["id"]: (r["name"], r["path"]) for r in merge.upsert(old, new, ["id"], {"name": merge.FILLED, "path": merge.keep_if_empty("path")}).collect()}
    assert got == {1: ("a", [1]), 2: ("b", [2]), 3: ("c", [])}
    s = merge.Snapshots(spark, f"{tmp_path}/t", "id int, name string, path array<int>")
    assert s.read().count() == 0
    s.upsert(old, ["id"])
    s.upsert(new, ["id"])
    assert {r["id"]: r["name"] for r in s.read().collect()} == {1: None, 2: "b", 3: "c"}
    m = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": None, "c": "3"})], "o map<string,string>, n map<string,string>")
    assert m.select(merge.object_merge(F.col("o"), F.col("n"))).head()[0] == {"a": "1", "b": None, "c": "3"}
    parents, children = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x"), (2, "y"), (9, "z"), (None, "n")], "k int, v string")
    assert [r["v"] for r in merge.orphans(children, parents, "k", "k").collect()] == ["z"]
    kept = merge.set_null(children, parents, "k", "k").collect()
    assert {(r["k"], r["v"]) for r in kept} == {(1, "x"), (2, "y"), (None, "z"), (None, "n")}
    p, c = merge.delete_cascade(parents, children, spark.createDataFrame([(1,)], "k int"), "k")
    assert p.count() == 1 and c.count() == 3


@pytest.mark.parametrize("step", ["while writing", "before the mark"])
def test_a_write_that_dies_leaves_the_old_table(spark, tmp_path, step):
    s = merge.Snapshots(spark, f"{tmp_path}/t", "id int, name string")
    s.upsert(spark.createDataFrame([(1, "a")], "id int, name string"), ["id"])
    if step == "while writing":
        broken = spark.range(3).select(F.col("id").cast("int"), F.assert_true(F.col("id") < 2, F.lit("dead")).cast("string").alias("name"))
        with pytest.raises(Exception):
            s.replace(broken)
    else:
        s.replace(spark.createDataFrame([(2, "half")], "id int, name string"))
        os.remove(f"{tmp_path}/t/v-{1:012d}/_SUCCESS")
    assert [tuple(r) for r in s.read().collect()] == [(1, "a")]
    s.upsert(spark.createDataFrame([(3, "c")], "id int, name string"), ["id"])
    assert sorted(tuple(r) for r in s.read().collect()) == [(1, "a"), (3, "c")]
    s.append(spark.createDataFrame([(4, "d")], "id int, name string"))
    s.purge(1)
    assert len(s.versions()) == 1 and s.read().count() == 3


def test_metadata_are_merged(spark):
    row = lambda **k: spark.createDataFrame([("1", k["title"], k["meta"])], "id string, titre string, metadata map<string,string>")
    policy, default = national.merge_policy("texte")
    got = merge.upsert(row(title="a", meta={"x": "1", "y": "2"}), row(title=None, meta={"y": "3", "z": None}), ["id"], policy, default).head()
    assert got["titre"] == "a" and got["metadata"] == {"x": "1", "y": "3", "z": None}


class Encoder:
    def __init__(self, model="m", dimension=2, fail=False):
        self.model, self.dimension, self.fail = model, dimension, fail

    def __call__(self, texts):
        if self.fail:
            raise ConnectionError
        return [[3.0, 4.0]] * len(texts)


def test_embeddings(spark):
    v = spark.createDataFrame([("1", "VIGUEUR", "c1"), ("2", "VIGUEUR", "c2"), ("3", "ABROGE", "c3"), ("4", "VIGUEUR", "c4")], "id string, etat string, checksum_sha256 string")
    e = spark.createDataFrame([("1", "m", "c1", [1.0]), ("2", "m", "old", [1.0]), ("4", "other", "c4", [1.0])], "version_id string, model string, content_checksum string, embedding array<float>")
    todo = national.stale(v, e, "m")
    assert sorted(r["id"] for r in todo.collect()) == ["2", "4"]
    new = national.embed(todo.select("id", "checksum_sha256", F.lit("x").alias("document")), Encoder, "m", 2)
    assert new.head()["embedding"] == pytest.approx([0.6, 0.8])
    assert national.refreshed(e, new).count() == 4
    with pytest.raises(Exception):
        national.embed(todo.select("id", "checksum_sha256", F.lit("x").alias("document")), Encoder, "m", 3).collect()
    f = national.FallbackEncoder([Encoder(fail=True), Encoder()])
    assert f(["a"]) == [[3.0, 4.0]] and f.at == 1
    with pytest.raises(ValueError):
        national.FallbackEncoder([Encoder(), Encoder(dimension=3)])
    with pytest.raises(ConnectionError):
        national.FallbackEncoder([Encoder(fail=True)])(["a"])


class Failing:
    """Makes encoders that give up after ``most`` texts, counting them in a folder."""

    def __init__(self, folder, most):
        self.folder, self.most = folder, most
        os.makedirs(folder, exist_ok=True)

    def __call__(self):
        def encode(texts):
            for _ in texts:
                if len(os.listdir(self.folder)) >= self.most:
                    raise ConnectionError
                open(f"{self.folder}/{uuid.uuid4().hex}", "w").close()
            return [[3.0, 4.0]] * len(texts)

        return encode


def payload(text, **change):
    from tests.test_functions import payload as base

    return base(**change) | {"source_excerpt": "doit publier", "span_start": 0, "span_end": 1}


def test_model_extraction_and_cascade():
    text = "Elle doit publier le rapport."
    good, bad = payload(text), payload(text) | {"source_excerpt": "inventé"}
    answer = lambda *items: "```json\n" + json.dumps({"obligations": list(items)}) + "\n```"
    kept, rejected = obligations.model_extract(text, lambda t: answer(good, bad))
    assert kept[0]["span_start"] == 5 and rejected == [(1, "citation absent")]
    with pytest.raises(ValueError):
        obligations.model_extract("x" * 12_001, lambda t: "")
    for wrong in ("[]", '{"obligations": 1}', '{"obligations": [], "x": 1}', json.dumps({"obligations": [good] * 101})):
        with pytest.raises(ValueError):
            obligations.model_extract(text, lambda t, w=wrong: w)
    one = obligations.Cascade({"local": lambda t: answer(good), "reference": lambda t: answer(good | {"deadline": " "}), "arbiter": None})
    assert one.process(text)["status"] == "COMPLETED" and one.process(text)["agreement"] == "EXACT_FIELDS"
    nonsense, nothing = (lambda t: "nonsense"), (lambda t: answer())

    def off(t):
        raise urllib.error.URLError("off")

    cases = [  # local, reference, arbiter: status, agreement
        (nothing, lambda t: answer(good), lambda t: answer(good), "COMPLETED", "GEMINI_SUPPORTS_DEEPSEEK"),
        (nothing, lambda t: answer(good), nothing, "NEEDS_REVIEW", "ARBITRATION_REQUIRED"),
        (nonsense, lambda t: answer(good), lambda t: answer(good), "COMPLETED", "GEMINI_SUPPORTS_DEEPSEEK"),
        (off, lambda t: answer(good), lambda t: answer(good), "COMPLETED", "GEMINI_SUPPORTS_DEEPSEEK"),
        (lambda t: answer(good), lambda t: answer(good, bad), lambda t: answer(good), "NEEDS_REVIEW", "ARBITRATION_REQUIRED"),
        (lambda t: answer(good), nonsense, lambda t: answer(good), "FAILED", None),
        (nothing, lambda t: answer(good), off, "FAILED", None),
    ]
    for local, reference, arbiter, status, agreement in cases:
        got = obligations.Cascade({"local": local, "reference": reference, "arbiter": arbiter}).process(text)
        assert (got["status"], got.get("agreement")) == (status, agreement)
        assert (got["chosen"] is not None) == (status == "COMPLETED")

    def broke(t):
        raise urllib.error.HTTPError("u", 402, "x", None, io.BytesIO(b""))

    stop = obligations.Cascade({"local": broke, "reference": broke, "arbiter": broke})
    assert list(stop.run([("1", text), ("2", text)])) == ["1"]
    error = lambda code, body: urllib.error.HTTPError("u", code, "x", None, io.BytesIO(body))
    assert not obligations.is_credit_error(error(429, b"rate limit")) and obligations.is_credit_error(error(429, b'{"error": {"code": "insufficient_quota"}}'))
    assert obligations.is_credit_error(error(402, b"")) and obligations.is_credit_error(error(403, b"Insufficient Balance")) and not obligations.is_credit_error(error(500, b"insufficient_quota")) and not obligations.is_credit_error(None)
    wrapped = RuntimeError("x")
    wrapped.__cause__ = error(429, b'{"error": {"status": "RESOURCE_EXHAUSTED"}}')
    assert obligations.is_credit_error(wrapped)
    assert obligations.claim(None) == "CLAIM" and obligations.claim("COMPLETED") == "SKIP" and obligations.claim("FAILED", 1) == "SKIP" and obligations.claim("FAILED", 1, True) == "CLAIM"
    with pytest.raises(RuntimeError):
        obligations.claim("RUNNING")


def test_outcomes_of_runs(spark):
    cases = {("llm", 2, 2, 0, 0): ("FAILED", "FAILED_VALIDATION"), ("hybrid", 2, 2, 0, 0): ("SUCCEEDED", "PARTIAL"), ("hybrid", 2, 2, 0, 3): ("SUCCEEDED", "PARTIAL"), ("llm", 2, 1, 1, 1): ("SUCCEEDED", "PARTIAL"),
             ("llm", 1, 0, 1, 1): ("SUCCEEDED", "SUCCESS"), ("llm", 0, 0, 0, 0): ("SUCCEEDED", "EMPTY"), ("deterministic", 0, 0, 0, 0): ("SUCCEEDED", "EMPTY"), ("deterministic", 0, 0, 0, 2): ("SUCCEEDED", "SUCCESS")}
    df = spark.createDataFrame(list(cases), "mode string, candidates int, rejected int, kept int, stored int")
    status, outcome = obligations.run_result(*(F.col(c) for c in df.columns))
    assert {tuple(r[:5]): (r[5], r[6]) for r in df.select("*", status.alias("s"), outcome.alias("o")).collect()} == cases


def test_comparisons():
    a = {"modality": "OBLIGATION", "action": " Publier ", "actor": None, "span_start": 0, "span_end": 5}
    assert obligations.compare([a], [a | {"action": "publier", "span_start": 7, "span_end": 12}])["agreement"] == "EXACT_FIELDS"
    assert obligations.compare([a], [a | {"threshold": "5 %"}])["agreement"] == "DISAGREEMENT"
    assert obligations.compare([a], [])["local_only"] == 1
    assert obligations.compare([a], [a], reference_valid=False) == {"agreement": "INVALID_COMPARISON", "local_count": 1, "reference_count": 1, "local_only": None, "reference_only": None}


def test_store_of_obligations(spark, tmp_path):
    from jurisloom.plans.obligation_store import ObligationStore

    store = ObligationStore(spark, str(tmp_path / "ob"))
    law = "Le maire doit publier le rapport annuel. Le maire doit publier le rapport annuel. Il ne peut pas fumer."
    fr = spark.createDataFrame([("f1", law), ("f2", "Rien.")], "source_id string, text string")
    nat = fr.select(F.col("source_id").alias("id"), "text")
    got = {r["source_id"]: r for r in store.extract(fr, "FR", nat).collect()}
    assert got["f1"]["outcome"] == "SUCCESS" and got["f1"]["stored"] == 3 and got["f2"]["outcome"] == "EMPTY"
    with pytest.raises(ValueError):
        store.extract(fr, "FR", nat.withColumn("text", F.lit("other")))
    eu_text = "L'autorité doit publier le rapport annuel."
    eu = spark.createDataFrame([("p1", "32000L0060", eu_text), ("p2", "32000L0060", "Elle doit agir vite.")], "id string, celex string, text string")
    sources = eu.select(F.col("id").alias("source_id"), "text")

    def model():
        item = payload("x") | {"source_excerpt": "doit publier", "action": "publier le rapport annuel", "conditions": ["si"], "exceptions": []}

        def chat(t):
            if "vite" in t:
                raise ConnectionError("off")
            return json.dumps({"obligations": [item, item | {"source_excerpt": "inventé"}]})

        return chat

    got = {r["source_id"]: r for r in store.extract(sources, "EU", eu.select("id", "text"), "llm", model, "local", "m").collect()}
    assert got["p1"]["outcome"] == "PARTIAL" and got["p1"]["status"] == "SUCCEEDED" and got["p1"]["rejected"] == 1 and got["p2"]["problem"].startswith("ConnectionError")
    assert store.table("run").read().count() == 3
    acts = spark.createDataFrame([("32000L0060",)], "celex string")
    scope = obligations.Scope("32000L0060", ["f1"], "table 1")
    pairs, skipped, cut = store.pair(scope, eu, nat, acts)
    # A partial run is paired; both sentences of the national side match, the prohibition doesn't.
    assert pairs.count() == 2 and skipped.count() == 0 and not cut
    stored = store.table("obligation_pair").read()
    assert stored.count() == 2 and {r["decision"] for r in stored.collect()} == {"REVIEW_REQUIRED"}
    features = stored.head()["features"]
    assert features["eu_conditions"] == ["si"] and features["same_modality"] and features["field_jaccard"]["object"] is None
    first = store.table("evidence_check").read().collect()
    assert {r["status"] for r in first} == {"VERIFIED"} and len(first) == 4
    reviewed = stored.withColumn("decision", F.lit("ACCEPTED"))
    store.table("obligation_pair").replace(reviewed)
    store.pair(scope, eu, nat, acts)
    assert {r["decision"] for r in store.table("obligation_pair").read().collect()} == {"ACCEPTED"}
    assert sorted(store.check_evidence(nat, eu).select("obligation_id", "checked_at").collect()) == sorted((r["obligation_id"], r["checked_at"]) for r in first)
    changed = store.check_evidence(nat.withColumn("text", F.concat("text", F.lit("!"))), eu).groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in changed} == {"VERIFIED": 1, "INVALID": 3}
    rows = store.audit(eu).collect()
    assert [r["obligation_id"] for r in rows] == sorted(r["obligation_id"] for r in rows)
    assert {(r["jurisdiction"], r["ok"], tuple(r["issues"])) for r in rows} == {("FR", False, ("FR_SOURCE_NOT_CONFIGURED",)), ("EU", True, ())}
    with pytest.raises(LookupError):
        store.pair(scope, eu, nat, acts.limit(0))


def test_states_of_the_cascade(spark, tmp_path):
    from jurisloom.plans.obligation_store import ObligationStore

    store = ObligationStore(spark, str(tmp_path / "ob"))
    text = "Elle doit publier le rapport."
    answer = json.dumps({"obligations": [payload(text)]})
    calls = []

    def flaky(t):
        calls.append(t)
        if len(calls) == 1:
            raise ConnectionError("off")
        return answer

    work = lambda **k: store.run_cascade(obligations.Cascade({"local": lambda t: answer, "reference": flaky, "arbiter": lambda t: answer}), "FR", [("1", text)], **k)
    assert work()["1"]["status"] == "FAILED" and work() == {}
    row = store.states().head()
    assert (row["status"], row["attempts"], row["completed_at"]) == ("FAILED", 1, None) and "off" in row["last_error"]
    assert work(retry_failed=True)["1"]["status"] == "COMPLETED" and work(retry_failed=True) == {}
    row = store.states().head()
    assert (row["attempts"], row["agreement"], row["last_error"]) == (2, "EXACT_FIELDS", None) and row["completed_at"] >= row["claimed_at"]
    store.table("extraction_cascade").replace(store.states().withColumn("status", F.lit("RUNNING")))
    with pytest.raises(RuntimeError):
        work()


def test_runs_evidence_and_pairs(spark):
    text = "Le maire doit publier le rapport annuel."
    fr = spark.createDataFrame([("f1", text), ("f2", "Rien.")], "source_id string, text string")
    found = obligations.extract(fr)
    assert found.count() == 1
    runs = spark.createDataFrame([("r1", "SUCCEEDED", datetime(2024, 1, 1)), ("r2", "SUCCEEDED", datetime(2024, 1, 2)), ("r3", "FAILED", datetime(2024, 1, 3))], "run_id string, status string, started_at timestamp")
    o = spark.createDataFrame([("o1", "r1", "FR", "f1", "PENDING"), ("o2", "r2", "FR", "f1", "PENDING"), ("o3", "r2", "FR", "f1", "REJECTED"), ("o4", "r3", "FR", "f1", "PENDING")], "obligation_id string, run_id string, jurisdiction string, source_id string, review_status string")
    assert [r["obligation_id"] for r in obligations.latest_obligations(o, runs, "FR").collect()] == ["o2"]
    mine = found.withColumn("obligation_id", F.lit("o2")).withColumn("jurisdiction", F.lit("FR")).withColumnRenamed("excerpt", "source_excerpt")
    nat = fr.select(F.col("source_id").alias("id"), "text")
    cited = obligations.with_source(mine, nat, nat.limit(0))
    checks = obligations.verify(cited)
    assert checks.head()["evidence_status"] == "VERIFIED"
    stored = checks.select("obligation_id", F.col("current_checksum").alias("source_checksum"), "obligation_fingerprint", "validator_version")
    assert obligations.to_verify(cited, stored).count() == 0 and obligations.to_verify(cited, stored, force=True).count() == 1
    changed = obligations.with_source(mine, nat.withColumn("text", F.concat("text", F.lit("!"))), nat.limit(0))
    assert obligations.to_verify(changed, stored).count() == 1
    side = lambda rows: spark.createDataFrame(rows, "id string, action string, object string, actor string, modality string, evidence_status string")
    eu = side([("e1", "publier rapport annuel", None, None, "OBLIGATION", "VERIFIED"), ("e2", "fumer", None, None, "PROHIBITION", "INVALID")])
    nat = side([("f1", "publier rapport", None, None, "OBLIGATION", "VERIFIED"), ("f2", "autre chose", None, None, "OBLIGATION", "VERIFIED")])
    pairs, skipped, cut = obligations.pair_scope(obligations.Scope("c", ["f1", "f2"], "ref"), eu, nat)
    assert [(r["eu_id"], r["fr_id"], r["score"]) for r in pairs.collect()] == [("e1", "f1", 0.6667)] and not cut
    assert [r["id"] for r in skipped.collect()] == ["e2"]
    assert obligations.pair_candidates(eu, nat, 0).count() == 4
    for bad in ({"version_ids": []}, {"reference": " "}, {"origin": "X"}, {"minimum": 2}):
        with pytest.raises(ValueError):
            obligations.Scope(**({"celex": "c", "version_ids": ["f1"], "reference": "r"} | bad))
    with pytest.raises(LookupError):
        obligations.Scope("c", ["f1", "zz"], "r").require(nat)


def test_stats_isolation_and_ttl(spark):
    now = [0.0]
    c = stats.Collector(10, lambda: now[0])
    calls = []
    good = lambda: calls.append(1) or spark.range(2)
    found = c.collect("k", {"good": good, "bad": lambda: spark.sql("select * from nowhere")})
    assert len(found["good"]["rows"]) == 2 and found["bad"]["error"]
    c.collect("k", {"good": good})
    assert len(calls) == 1
    now[0] = 11
    c.collect("k", {"good": good})
    assert len(calls) == 2
    acts = spark.createDataFrame([("c1", "DIRECTIVE"), ("c2", None)], "celex string, act_type string")
    prov = spark.createDataFrame([("c1", "ARTICLE", " "), ("c1", "ANNEX", "x")], "celex string, kind string, text string")
    got = stats.Collector().collect("eu", stats.european(acts, prov))
    assert got["totals"]["rows"] == [{"acts": 2, "provisions": 2, "empty_acts": 1, "empty_provisions": 1}]
    assert {"label": "INCONNU", "n": 1} in got["act_types"]["rows"]


def test_query_log_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"created_at":"2024-01-01T00:00:00Z","query":"eau","ip_address":"::1"}\n{"created_at":"2024-03-01T00:00:00Z","query":" ","ip_address":"::1"}\n')
    for _ in range(2):
        query_log.append_stream(spark, str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 1
    assert query_log.retained(log, "2024-01-31 00:00:00", 30).count() == 1 and query_log.retained(log, "2024-01-31 00:00:01", 30).count() == 0
    assert query_log.searches_by_hour(spark, str(tmp_path / "in")).isStreaming


def test_reports(spark):
    left = spark.createDataFrame([(1, "A "), (1, "b"), (2, "x")], "k int, x string")
    right = spark.createDataFrame([(1, "a"), (1, "B"), (2, "y")], "k int, x string")
    assert {r["k"]: r["agreement"] for r in reports.agreement(left, right, "k", "x").collect()} == {1: "EXACT", 2: "DISAGREEMENT"}
    assert reports.missing_ids(left, ["1", "7"], "k") == ["1", "7"] or reports.missing_ids(left.select(F.col("k").cast("string").alias("k")), ["1", "7"], "k") == ["7"]


def uuid_transport():
    base = "http://publications.europa.eu/resource/celex/"
    return lambda keys: {k: [base + "32000L0060"] for k in keys if k == "u"}


def test_builds_end_to_end(spark, tmp_path):
    from jurisloom.plans import flows

    tar_of(tmp_path / "a.tar.gz", {"x/1.xml": article(versions=CHAIN, links=LINK), "x/2.xml": article("LEGIARTI5")} | {f"y/{k}.xml": article(f"LEGIARTI7{k}") for k in range(4)})
    root = str(tmp_path / "fr")
    assert flows.build_national(spark, str(tmp_path / "a.tar.gz"), root)["imported"] == 6
    logged = flows.table(spark, root, "import_log").read().head()
    assert logged["stats"]["imported"] == 6 and logged["finished_at"] >= logged["started_at"]
    with pytest.raises(Exception):
        flows.build_national(spark, str(tmp_path / "none.tar.gz"), root, url="http://x")
    assert flows.table(spark, root, "import_log").read().filter("finished_at is null").count() == 1
    corpus = flows.table(spark, root, "corpus").read().collect()
    assert [(r["code"], r["source_archive"], r["source_url"]) for r in corpus] == [("LEGI", "none.tar.gz", "http://x")] and corpus[0]["id"] == logged["corpus_id"]
    # A part fails; those before it are saved and not embedded again.
    with pytest.raises(Exception):
        flows.vectorise(spark, root, Failing(f"{tmp_path}/embedded", 4), "m", 2, at_once=1)
    saved = flows._saved_parts(spark, merge.Snapshots(spark, f"{root}/_embedded", national.schemas.EMBEDDINGS)).count()
    assert 0 < saved < 6 and flows.vectorise(spark, root, Encoder, "m", 2, at_once=2) == 6 - saved
    assert flows.table(spark, root, "version_embedding").read().count() == 6
    assert flows.vectorise(spark, root, Encoder, "m", 2) == 0
    with pytest.raises(ValueError):
        flows.vectorise(spark, root, Encoder, "m", 3)
    doc = b'<DOC CELEX="32000L0060"/>'
    (tmp_path / "eu.zip").write_bytes(archives.zip_of({"u/a.doc.xml": doc, "u/act.fmx.xml": ACT, "w/act.fmx.xml": ACT}))
    out = flows.build_european(spark, str(tmp_path / "eu.zip"), str(tmp_path / "eu"), transport_factory=uuid_transport)
    assert out["provisions"].count() == 5 and [r["celex"] for r in out["acts"].collect()] == ["32000L0060"]
    same, rel = measures.SAME_AS, measures.CDM + measures.RELATIONS[1]
    triples = spark.createDataFrame([("w1", same, measures.CELEX_URI + "32000L0060"), ("n1", same, measures.CELEX_URI + "72000L0060FRA_1"), ("n1", rel, "w1")], "s string, p string, o string")
    got = flows.build_measures(spark, out["identity"], triples, str(tmp_path / "nim"))
    assert got["bindings"].head()["nim_work"] == "n1"
    # A second archive adds its act and leaves the first one's.
    (tmp_path / "eu2.zip").write_bytes(archives.zip_of({"w/a.doc.xml": b'<DOC CELEX="32001L0001"/>', "w/act.fmx.xml": ACT}))
    second = lambda: lambda keys: {k: ["http://publications.europa.eu/resource/celex/32001L0001"] for k in keys}
    both = flows.build_european(spark, str(tmp_path / "eu2.zip"), str(tmp_path / "eu"), transport_factory=second)
    assert sorted(r["celex"] for r in both["acts"].collect()) == ["32000L0060", "32001L0001"] and both["provisions"].count() == 10


CELEX_BASE = "http://publications.europa.eu/resource/celex/"


class FakeEndpoint:
    """Answers two acts, one with a measure, and counts its calls in a folder; a third act breaks every batch it is in."""

    def __init__(self, folder):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def __call__(self, request, timeout):
        from urllib.parse import parse_qs

        query = parse_qs(request.data.decode())["query"][0]
        open(f"{self.folder}/{uuid.uuid4().hex}", "w").close()
        if "32002L0002" in query:
            raise urllib.error.URLError("off")
        row = {"act": CELEX_BASE + "32000L0060", "work": "w1", "nim": "n1", "name": CELEX_BASE + "72000L0060FRA%5F240395", "relation": "r", "direction": "NIM_TO_DIRECTIVE"}
        rows = [{k: {"type": "uri", "value": v} for k, v in row.items()}] if "32000L0060" in query else []
        return io.BytesIO(json.dumps({"results": {"bindings": rows}}).encode())


def test_measures_from_an_endpoint(spark, tmp_path):
    from jurisloom.plans import flows
    from jurisloom.sources import sparql

    rows = [("32000L0060", "RESOLVED", "DIRECTIVE"), ("32001L0001", "RESOLVED", "DIRECTIVE"), ("32002L0002", "RESOLVED", "DIRECTIVE"), ("32003R0003", "RESOLVED", "REGULATION")]
    identity = spark.createDataFrame(rows, "celex string, status string, act_type string")
    calls = str(tmp_path / "calls")
    factory = lambda: sparql.Endpoint(opener=FakeEndpoint(calls), gap=0.0).measures
    from jurisloom.sources import remote as r

    short = lambda *a, **k: r.look_up(*a, **k, retries=1)
    flows_look_up, flows.look_up = flows.look_up, short
    try:
        out = flows.discover_measures(spark, identity.coalesce(1), str(tmp_path / "nim"), factory)
        links = out["links"].collect()
        assert [(x["eu_celex"], x["nim_celex"]) for x in links] == [("32000L0060", "72000L0060FRA_240395")]
        assert [x["celex"] for x in out["failed"].collect()] == ["32002L0002"] and os.path.exists(tmp_path / "nim" / "failed")
        before = len(os.listdir(calls))
        flows.discover_measures(spark, identity.coalesce(1), str(tmp_path / "nim"), factory)
        # Answered batches aren't asked again; those with the key that fails are.
        assert 0 < len(os.listdir(calls)) - before < before
    finally:
        flows.look_up = flows_look_up


def test_endpoint_waits_between_calls():
    from jurisloom.sources import sparql

    slept, now = [], [0.0]
    answer = json.dumps({"results": {"bindings": [{"work": {"value": sparql.CELLAR + "u1"}, "alias": {"value": "a"}}, {"work": {"value": "other"}, "alias": {"value": "b"}}]}}).encode()
    e = sparql.Endpoint(opener=lambda r, timeout: io.BytesIO(answer), gap=0.5, clock=lambda: now[0], sleep=slept.append)
    assert e.aliases(["u1", "u2"]) == {"u1": ["a"], "u2": []}
    now[0] = 0.2
    e.aliases(["u1"])
    assert slept == [pytest.approx(0.3)] and "VALUES ?work { <" + sparql.CELLAR + "u1> }" in sparql.aliases_of(["u1"])


def test_members_by_random_access(spark, tmp_path):
    (tmp_path / "m.zip").write_bytes(archives.zip_of({f"d/{k}.xml": f"<A>{k}</A>".encode() for k in range(30)}))
    wanted = spark.createDataFrame([("d/3.xml", 1), ("d/17.xml", 2), ("d/17.xml", 3), ("none", 4)], "member string, k int")
    got = {r["k"]: bytes(r["content"]) for r in archives.read_members(spark, str(tmp_path / "m.zip"), wanted).collect()}
    assert got == {1: b"<A>3</A>", 2: b"<A>17</A>", 3: b"<A>17</A>"}
