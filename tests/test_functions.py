import math
import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from jurisloom.functions import celex as cx
from jurisloom.functions import dates, french, fulltext, ids, text, vectors
from jurisloom.functions import obligations as ob
from jurisloom.plans import obligations, search, search_index


def one(spark, value, kind, fn):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).head()["y"]


def test_uuid5_is_pythons(spark):
    names = ["LEGI:version:1", "é", "", "x" * 300]
    got = spark.createDataFrame([(n,) for n in names], "x string").select("x", ids.uuid5(F.col("x")).alias("y")).collect()
    for r in got:
        assert r["y"] == str(uuid.uuid5(uuid.UUID(ids.NAMESPACE), r["x"]))


def test_fold_is_the_compatibility_decomposition():
    for a, b in zip(text.ACCENTED, text.PLAIN, strict=True):
        assert "".join(c for c in unicodedata.normalize("NFKD", a) if not unicodedata.combining(c)) == b


def test_spaces_and_paths(spark):
    assert one(spark, "  Droit \n du\ttravail  ", "string", text.collapse_spaces) == "Droit du travail"
    path = [{"titre": "Livre I", "libelle": None, "title": None}, {"titre": "Livre  I", "libelle": None, "title": None}, {"titre": "", "libelle": "Titre 2", "title": None}]
    got = one(spark, path, "array<struct<titre:string,libelle:string,title:string>>", text.path_titles)
    assert got == "Livre I > Titre 2"


def test_markup(spark):
    html = "<div>A&nbsp;b</div><p>c<br/>d &amp;amp; e</p>\n\n\n\n<li>f</li>"
    assert one(spark, html, "string", text.clean_markup) == "A b\n\nc\nd &amp; e\n\nf"


def test_masking(spark):
    assert one(spark, "postgresql://me:secret@db/x", "string", text.mask_dsn) == "postgresql://me:***@db/x"
    assert one(spark, "host=db password=secret user=me", "string", text.mask_dsn) == "host=db password=*** user=me"


def test_tokens(spark):
    assert sorted(one(spark, "Les États doivent garantir la Sécurité, sécurité 42 x7y", "string", text.tokens)) == ["etats", "garantir", "securite", "x7y"]


@pytest.mark.parametrize(
    "raw,want",
    [
        ("32000L0060", ("32000L0060", 2000, "L", "0060", None, None, "DIRECTIVE")),
        ("32025R1178R%2802%29", ("32025R1178R(02)", 2025, "R", "1178", None, "R(02)", "REGULATION")),
        ("32014D0717%2801%29", ("32014D0717(01)", 2014, "D", "0717", "(01)", None, "DECISION")),
        ("32011Q0712%2801%29", ("32011Q0712(01)", 2011, "Q", "0712", "(01)", None, "INSTITUTIONAL")),
        ("52010XG0729%2801%29", None), ("C2017%2F168%2F02", None), ("", None),
    ],
)
def test_celex(spark, raw, want):
    got = one(spark, raw, "string", cx.sector3)
    assert (tuple(got) if got else None) == want


def test_aliases_and_status(spark):
    b = "http://publications.europa.eu/resource/celex/"
    got = one(spark, [b + "32025D01689R%2801%29", "http://x/y", b + "32025D01689R%2801%29"], "array<string>", lambda x: F.struct(cx.aliases(x).alias("a"), cx.alias_status(cx.aliases(x)).alias("s")))
    assert got == (["32025D01689R(01)"], "RESOLVED")
    got = one(spark, [b + "52010XG0729%2801%29R%2801%29", b + "C2017%2F168%2F02"], "array<string>", lambda x: F.struct(cx.alias_status(cx.aliases(x)).alias("s"), cx.aliases(x, False).alias("a")))
    assert got["s"] == "NO_SECTOR3_CELEX" and len(got["a"]) == 2 and "C2017/168/02" in got["a"]
    assert tuple(one(spark, "32014L0001(01)R(02)", "string", cx.corrigendum)) == ("32014L0001(01)", "02")
    assert one(spark, "32014L0001", "string", cx.corrigendum) is None


def test_measures(spark):
    u = "http://publications.europa.eu/resource/celex/"
    assert tuple(one(spark, u + "72000L0060FRA_240395", "string", cx.measure)) == ("72000L0060FRA_240395", "STANDARD", 240395)
    assert tuple(one(spark, u + "7%2AFRA_17", "string", cx.measure)) == ("7*FRA_17", "MULTI_ACT_STAR", 17)
    assert one(spark, u + "x", "string", cx.measure)["shape"] == "OTHER"


def test_dates_and_vectors(spark):
    assert str(one(spark, " 2020-02-29 ", "string", dates.safe_date)) == "2020-02-29"
    assert one(spark, "2020-02-30", "string", dates.safe_date) is None
    assert one(spark, [3.0, 4.0], "array<float>", vectors.normalised) == [0.6, 0.8]
    assert one(spark, [0.0, 0.0], "array<float>", vectors.normalised) == [0.0, 0.0]
    assert one(spark, [1.0, 0.0], "array<float>", lambda x: vectors.cosine_similarity(x, vectors.literal([1.0, 1.0]))) == pytest.approx(1 / math.sqrt(2))
    assert one(spark, [0.0, 0.0], "array<float>", lambda x: vectors.cosine_similarity(x, vectors.literal([1.0, 1.0]))) is None


def test_query_syntax():
    q = fulltext.parse_query('droit "code du travail" or salaire -grève -"a b"')
    assert q.alternatives == ((("droit",), ("code", "du", "travail")), (("salaire",),))
    assert q.excluded == (("grève",), ("a", "b"))
    assert fulltext.parse_query("le droit", "french").terms == ("droit",)


def test_cover_density():
    d = lambda *p: [(k, w, 0.1) for k, w in p]
    rank = lambda places, query: fulltext.cover_density(places, fulltext.parse_query(query))
    assert rank(d((1, "a"), (5, "a"), (9, "a")), "a") == pytest.approx(0.3)
    assert rank(d((1, "a"), (2, "b")), "a b") == pytest.approx(0.1)
    assert rank(d((1, "a"), (4, "b")), "a b") == pytest.approx(0.1 / 3)
    assert rank(d((1, "a"), (4, "b"), (5, "a")), "a b") == pytest.approx(0.1 / 3 + 0.1)
    assert rank(d((1, "a"), (2, "a")), "a b") == 0
    assert rank([(1, "a", 1.0), (2, "b", 0.4)], "a b") == pytest.approx(2 / (1 + 2.5))
    # Alternatives: all spans of either count.
    assert rank(d((1, "a"), (5, "c"), (7, "a")), "a or c") == pytest.approx(0.3)
    assert rank(d((1, "a"), (2, "b"), (9, "c")), "a b or c") == pytest.approx(0.2)
    # A phrase is satisfied only at its distance.
    assert rank(d((1, "a"), (3, "b"), (4, "a"), (5, "b")), '"a b"') == pytest.approx(0.1)


# Words of the published vocabulary of the stemmer, with their stems.
STEMS = """continu continu continua continu continuait continu continuant continu continuation continu continue continu continué continu continuel continuel continuelle continuel
continuellement continuel continuelles continuel continuels continuel continuer continu continuera continu continuerait continu continueront continu continuez continu continuité continu
continuons continuon contorsions contors contour contour contournait contourn contournant contourn contourne contourn contours contour contractait contract contracté contract
contractée contract contracter contract contractés contract contractions contract contradictoirement contradictoir contradictoires contradictoir contraindre contraindr contraint contraint
contrainte contraint contraintes contraint contraire contrair contraires contrair contraria contrari main main mains main maintenaient mainten maintenait mainten maintenant mainten
maintenir mainten maintenue maintenu maintien maintien maintint maintint maire mair maires mair mairie mair maïs maï maison maison maisons maison maître maîtr maîtres maîtr
maîtresse maîtress maîtresses maîtress majesté majest majestueuse majestu majestueusement majestu majestueux majestu majeur majeur majeure majeur major major majordome majordom
majordomes majordom majorité major majorités major mal mal malade malad malades malad maladie malad maladies malad maladive malad""".split()


def test_stems():
    pairs = dict(zip(STEMS[::2], STEMS[1::2], strict=True))
    assert {w: french.stem(w) for w in pairs} == pairs
    assert french.lexeme("des") == "" and french.lexeme("objet") == "objet"


def test_french_search(spark, tmp_path):
    texts = ["La protection de la nature est un objet.", "protection et nature", "Protections de ces natures", "nature de la protection", None]
    rows = spark.createDataFrame([(str(k), "Titre", t) for k, t in enumerate(texts)], "provision_id string, label string, text string")
    index = search_index.SearchIndex(spark, str(tmp_path / "index"))
    index.build(rows)
    ids = lambda q: sorted(r[0] for r in search_index.found(index.read(), fulltext.parse_query(q, "french")).collect())
    assert ids('"protection de la nature"') == ["0", "2"] and ids("objet") == ["0"] and ids("protection nature") == ["0", "1", "2", "3"]
    assert ids("protection -objets") == ["1", "2", "3"] and ids("titre objets") == ["0"] and ids("de") == []
    index.refresh(spark.createDataFrame([("1", "Titre", "autre chose")], rows.schema))
    assert ids("protection") == ["0", "2", "3"] and ids("choses") == ["1"]
    words = rows.select("provision_id", fulltext.lexemes(F.col("text"), "french").alias("w"))
    hit = lambda q: sorted(r[0] for r in words.filter(fulltext.matches(F.col("w"), fulltext.parse_query(q, "french"))).collect())
    assert hit('"protection de la nature"') == ["0", "2"] and hit("objet") == ["0"]


def test_citations_of_any_length(spark):
    texts = ["abcdefghijklmnopqrstuvwxyz0123456789", "xyz abcabc", "", None, "0123456789" * 5]
    excerpts = ["mnopqrstuvwxyz0123456789", "abc", "a", "fghijkl", "0123456789012345678901234", "absent text that is long enough", "", None, "9"]
    t = spark.createDataFrame(list(enumerate(texts)), "t int, text string")
    e = spark.createDataFrame(list(enumerate(excerpts)), "e int, excerpt string")
    got = {(r["t"], r["e"]): r["anchor"]["method"] for r in obligations.cited_in(t, e, "t", "e").collect()}
    want = {(i, j): "AMBIGUOUS" if x.find(y, x.find(y) + 1) >= 0 else "EXACT" for i, x in enumerate(texts) for j, y in enumerate(excerpts) if x and y and y in x}
    assert got == want and len(got) > 6


def test_european_search_ranks_labels_higher(spark):
    rows = [("p1", "c1", "eau", "rien"), ("p2", "c1", "", "eau eau"), ("p3", "c2", "air", "vent"), ("p4", "c1", None, "eau")]
    provisions = spark.createDataFrame(rows, "provision_id string, celex string, label string, text string").withColumn("logical_path", F.lit(None).cast("string"))
    acts = spark.createDataFrame([("c1", "A"), ("c2", "B")], "celex string, title string")
    got = [(r["provision_id"], round(r["score"], 6)) for r in search.european(provisions, acts, "eau").collect()]
    assert got == [("p1", 1.0), ("p2", 0.8), ("p4", 0.4)]
    assert [r["provision_id"] for r in search.european(provisions, acts, "C1x").collect()] == []
    acts2 = spark.createDataFrame([("32000L0060", "A")], "celex string, title string")
    got = search.european(provisions.withColumn("celex", F.lit("32000L0060")), acts2, "32000l0060")
    assert got.count() == 4
    assert search.matching_source(provisions, "c1").head()["text"] == "rien\neau eau\neau"


def test_blend(spark):
    rows = spark.createDataFrame([("a", 0.8, 2.0), ("b", 0.9, 1.0)], "id string, vector_score double, lexical_score double")
    got = {r["id"]: round(r["score"], 6) for r in search.blend(rows, 0.25, 10).collect()}
    assert got == {"a": 0.85, "b": 0.8}
    assert search.blend(rows, 2.0, 1).head()["score"] == 1.0
    assert search.clamp_k("x") == 10 and search.clamp_k(500) == 50 and search.clamp_k(-1) == 1


SENTENCE = "Le maire doit publier le rapport. Rien ici.\nL'agent ne peut pas refuser: la demande! Il est interdit de fumer"


def test_cues(spark):
    cut = lambda text: sorted(obligations.extract(spark.createDataFrame([("s", text)], "source_id string, text string")).collect(), key=lambda c: c["span_start"])
    got = cut(SENTENCE)
    assert [(c["modality"], c["action"]) for c in got] == [("OBLIGATION", "publier le rapport."), ("PROHIBITION", "refuser: la demande!"), ("PROHIBITION", "fumer")]
    assert all(SENTENCE[c["span_start"] : c["span_end"]] == c["excerpt"] for c in got)
    assert cut("Le doit-on savoir. Il DOIT")[0]["action"] == "-on savoir."
    twice = "Le maire doit agir.  Le maire doit agir.\nÉté où le maire doit agir\u00a0. Rien."
    assert [(c["span_start"], twice[c["span_start"] : c["span_end"]]) for c in cut(twice)] == [(0, "Le maire doit agir."), (21, "Le maire doit agir."), (41, "Été où le maire doit agir\u00a0.")]
    assert cut("") == [] and cut("\n..!") == []


def test_tokens_are_decomposed(spark):
    rows = ["e\u0301le\u0301ment \ufb01nal", "élément final", "x² \u2460", None, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string")
    assert [r[0] for r in df.orderBy("k").select(text.tokens(F.col("t"))).collect()] == [["element", "final"], ["element", "final"], [], [], []]


def test_citations(spark):
    t = "L’employeur   doit payer. Fin. Fin."
    assert ob.anchor_citation(t, "payer")[0] == "EXACT"
    assert ob.anchor_citation(t, "Fin.")[0] == "AMBIGUOUS"
    method, a, b = ob.anchor_citation(t, "L'employeur doit payer")
    assert method == "TYPOGRAPHY" and t[a:b] == "L’employeur   doit payer"
    assert ob.anchor_citation(t, "absent")[0] == "ABSENT" and ob.anchor_citation(t, " ")[0] == "EMPTY"
    rows = spark.createDataFrame([(t, "payer"), (t, "L'employeur doit"), (t, "Fin.")], "t string, e string")
    assert [r[0]["method"] for r in rows.select(ob.citation_anchor("t", "e")).collect()] == ["EXACT", "TYPOGRAPHY", "AMBIGUOUS"]


def payload(**change):
    base = {k: None for k in ob.OPTIONAL_TEXTS} | {"conditions": [], "exceptions": [], "modality": "OBLIGATION", "action": "publier", "source_excerpt": "doit publier", "span_start": 5, "span_end": 17}
    return base | change


def test_contract(spark):
    source = "Elle doit publier"
    assert ob.payload_problem(payload(), source) is None
    bad = [payload(modality="X"), payload(action=" "), payload(actor=3), payload(conditions=[1]), payload(span_start=True), payload(span_start=None), payload(span_end=4), payload(span_start=4), payload() | {"more": 1}, {"action": "x"}, [], payload(source_excerpt="")]
    for p in bad:
        assert ob.payload_problem(p, source), p
    assert ob.payload_problem(payload(span_start=None, span_end=None), source) is None
    import json

    rows = spark.createDataFrame([(json.dumps(payload()), source), ("{", source)], "p string, s string")
    assert [r[0] for r in rows.select(ob.contract_problem("p", "s")).collect()] == [None, "not JSON"]


def test_evidence(spark):
    import hashlib

    t = "Été: doit 🙂 publier"
    sha = hashlib.sha256(t.encode()).hexdigest()
    rows = [(t, sha, "doit", 5, 9), (None, sha, "doit", 5, 9), (t, "x", "doit", 5, 9), (t, sha, " ", 5, 9), (t, sha, "doit", 9, 5), (t, sha, "doit", 0, 4), (t, sha, "publier", 12, 19), (t, sha, "doit", None, 9)]
    df = spark.createDataFrame(rows, "t string, c string, e string, a int, b int")
    issues = ob.evidence_issues(F.col("t"), F.col("c"), F.col("e"), F.col("a"), F.col("b"))
    got = df.select(ob.evidence_status(F.col("t"), issues).alias("s"), issues.alias("i")).collect()
    assert [r["s"] for r in got] == ["VERIFIED", "SOURCE_MISSING", "INVALID", "INVALID", "INVALID", "INVALID", "VERIFIED", "INVALID"]
    assert [r["i"] for r in got][2:6] == [["SOURCE_CHECKSUM_MISMATCH"], ["EMPTY_EXCERPT", "EXCERPT_MISMATCH"], ["INVALID_SPAN"], ["EXCERPT_MISMATCH"]]


def test_pair_scores(spark):
    rows = [("publier rapport annuel", None, None, "OBLIGATION", "publier rapport annuel", None, None, "OBLIGATION", 1.0), ("publier rapport", None, None, "OBLIGATION", "publier rapport", None, None, "PERMISSION", 0.75),
            (None, None, None, "X", None, None, None, "X", 0.0), ("publier rapport", "eau", "maire", "X", "publier texte", "eau", "prefet", "X", round((0.5 / 3 + 0.35) / 1.0, 4))]
    df = spark.createDataFrame(rows, "a1 string,o1 string,c1 string,m1 string,a2 string,o2 string,c2 string,m2 string,want double")
    side = lambda k: {"action": F.col(f"a{k}"), "object": F.col(f"o{k}"), "actor": F.col(f"c{k}"), "modality": F.col(f"m{k}")}
    for r in df.select("want", ob.pair_score(side(1), side(2)).alias("got")).collect():
        assert r["got"] == r["want"]


def test_entities(spark):
    rows = {"a &amp;copy; b": "a &copy; b", "&eacute;t&#233; &#x2014; &copy;": "été — ©", "x &lt;b&gt; &nbsp; y": "x <b> y", "AT&T &notanentity; &": "AT&T ¬anentity; &", "": ""}
    df = spark.createDataFrame(list(enumerate(rows)), "k int, t string")
    assert [r[0] for r in df.orderBy("k").select(text.clean_markup(F.col("t"))).collect()] == list(rows.values())


def test_paths_written_as_text(spark):
    rows = {'[{"titre": "A"}, {"title": "A"}, {"libelle": " B "}]': "A > B", "[{'titre': 'Livre I', 'x': None}, 'C', '{\"titre\": \"D\"}']": "Livre I > C > D", "plain": "plain", "": "", "{'titre': 'E'}": "E", "[": "[", "[1, '', None]": "1"}
    df = spark.createDataFrame([*enumerate(rows), (99, None)], "k int, t string")
    assert [r[0] for r in df.orderBy("k").select(text.written_path_titles("t")).collect()] == [*rows.values(), ""]
