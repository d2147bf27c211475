"""Search over versions, provisions and acts.

The costly lexical rank is computed after the vector limit, so it touches at
most ``k * multiplier`` rows; limits are ``TakeOrderedAndProject`` over a scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fulltext, vectors
from ..functions.celex import looks_like_celex
from . import search_index

MOST_RESULTS = 50


def clamp(value: object, low: float, high: float, default: float) -> float:
    """A parameter within its bounds; what isn't a number becomes the default."""
    try:
        x = float(value)
    except (TypeError, ValueError):
        return default
    return default if x != x else max(low, min(high, x))


def clamp_k(value: object, default: int = 10) -> int:
    return int(clamp(value, 1, MOST_RESULTS, default))


def vector_top(df: DataFrame, query: list[float], k: int, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` rows most similar to the query (ties by id), with ``vector_score``.

    Rows without a similarity sort last and are dropped after the limit, so that
    the similarity is computed once.
    """
    scored = df.withColumn("vector_score", vectors.cosine_similarity(F.col(vector_col), vectors.literal(query)))
    return scored.orderBy(F.desc("vector_score"), F.asc(id_col)).limit(k).filter("vector_score is not null")


def blend(df: DataFrame, weight: float, k: int, id_col: str = "id") -> DataFrame:
    """Top ``k`` by ``(1 - weight) * vector_score + weight * lexical_score / largest``.

    The frame is a candidate set of bounded size, so one window over it is fine.
    """
    w = clamp(weight, 0.0, 1.0, 0.25)
    top = F.max("lexical_score").over(Window.partitionBy())
    out = df.withColumn("lexical_score", F.when(top > 0, F.coalesce("lexical_score", F.lit(0.0)) / top).otherwise(F.lit(0.0)))
    out = out.withColumn("score", (1 - w) * F.col("vector_score") + w * F.col("lexical_score"))
    return out.orderBy(F.desc("score"), F.desc("vector_score"), F.asc(id_col)).limit(k)


def hybrid(
    versions: DataFrame, query_vector: list[float], query_text: str, k: int = 10, min_score: float = 0.0, lexical_weight: float = 0.25,
    multiplier: int = 8, use_text: bool = True, id_col: str = "id", text_cols: tuple[str, ...] = ("text",), texts: DataFrame | None = None, **equal: object,
) -> DataFrame:
    """Vector search reranked by text; ``min_score`` drops rows after the limit.

    ``versions`` has the embeddings joined in; ``equal`` are column filters (None:
    not applied).  The text never adds or removes candidates.  ``texts`` (by
    ``id_col``, a row for each version) are what only the candidates need: they are fetched
    for ``k * multiplier`` rows at most.
    """
    k = clamp_k(k)
    for column, value in equal.items():
        if value is not None:
            versions = versions.filter(F.col(column) == F.lit(value))
    if not use_text:
        out = vector_top(versions, query_vector, k, id_col).withColumn("lexical_score", F.lit(0.0)).withColumn("score", F.col("vector_score"))
        return out.filter(F.col("score") >= min_score)
    candidates = vector_top(versions, query_vector, max(k, k * max(1, multiplier)), id_col)
    if texts is not None:
        candidates = texts.join(F.broadcast(candidates), id_col)
    words = fulltext.lexemes(F.concat_ws(" ", *text_cols))
    parsed = fulltext.parse_query(" ".join(query_text.split()))
    if len(parsed.terms) == 1 and not parsed.excluded:
        lexical = fulltext.single_term_rank(words, parsed.terms[0])
    else:
        candidates = candidates.withColumn("__words", words)
        lexical = F.when(fulltext.matches(F.col("__words"), parsed), fulltext.rank(parsed, (F.col("__words"), "D"))).otherwise(F.lit(0.0))
    ranked = candidates.withColumn("lexical_score", lexical).drop("__words")
    return blend(ranked, lexical_weight, k, id_col).filter(F.col("score") >= min_score)


def related(versions: DataFrame, vector: list[float], own_id: object, n: int = 5, looked_at: int = 8, id_col: str = "id") -> DataFrame:
    """Neighbours of a version: the nearest ``looked_at`` without itself, then ``n`` of them."""
    return vector_top(versions, vector, looked_at, id_col).filter(F.col(id_col) != F.lit(own_id)).orderBy(F.desc("vector_score"), id_col).limit(n)


def acts_by_id(acts: DataFrame, celex: str) -> DataFrame:
    return acts.filter(F.upper("celex") == celex.strip().upper())


def european(provisions: DataFrame, acts: DataFrame, query: str, k: int = 20, index: DataFrame | None = None) -> DataFrame:
    """An act by its identifier, or provisions by full text (labels weigh A, texts B).

    Provisions match on label and text together; equal ranks go by id.  ``index``
    are stored postings; without them they are made of all texts.  Texts and
    acts are fetched for the ``k`` best only.
    """
    k = clamp_k(k, 20)
    if looks_like_celex(query):
        found = provisions.join(acts_by_id(acts, query), "celex").withColumn("score", F.lit(1.0))
        return found.orderBy(F.col("logical_path").asc_nulls_last(), "provision_id").limit(k)
    ranked = search_index.found(search_index.postings(provisions) if index is None else index, fulltext.parse_query(query, "french"))
    # Provisions without an act count for nothing, so they go before the limit; only identifiers take part in that.
    known = provisions.select("provision_id", "celex").join(acts.select("celex").distinct(), "celex", "left_semi").select("provision_id")
    best = ranked.join(known, "provision_id", "left_semi").orderBy(F.desc("score"), "provision_id").limit(k)
    return provisions.join(F.broadcast(best), "provision_id").join(acts, "celex").orderBy(F.desc("score"), "provision_id")


def act_view(acts: DataFrame, provisions: DataFrame, celex: str) -> tuple[DataFrame, DataFrame]:
    """An act and its provisions in order."""
    mine = acts_by_id(acts, celex)
    return mine, provisions.join(mine.select("celex"), "celex").orderBy(F.col("logical_path").asc_nulls_last(), "provision_id")


def matching_source(provisions: DataFrame, celex: str, provision_id: str | None = None) -> DataFrame:
    """One row with the text to match: a provision's, or the act's non-empty texts by line, 30,000 characters at most."""
    rows = provisions.filter(F.upper("celex") == celex.upper())
    if provision_id:
        rows = rows.filter(F.col("provision_id") == provision_id)
    rows = rows.filter(F.coalesce(F.trim("text"), F.lit("")) != "")
    parts = F.array_sort(F.collect_list(F.struct(F.col("provision_id"), F.col("text"))))
    return rows.agg(F.substring(F.array_join(F.transform(parts, lambda p: p["text"]), "\n"), 1, 30_000).alias("text"))


def article(versions: DataFrame, units: DataFrame, texts: DataFrame, source_id: str) -> DataFrame:
    """One version with its unit and, where it has one, its text; missing values as empty texts."""
    v = versions.filter(F.col("source_id") == source_id).select(F.col("source_id").alias("version_source_id"), "unite_id", "etat", "date_debut", "date_fin", "contenu", "nota")
    u = units.select(F.col("id").alias("unite_id"), "texte_id", "numero", "chemin")
    t = texts.select(F.col("id").alias("texte_id"), F.col("source_id").alias("texte_source_id"), "titre", F.col("type").alias("type_texte"))
    out = v.join(u, "unite_id").join(t, "texte_id", "left").limit(1)
    day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("")).alias(c)
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select("version_source_id", blank("texte_source_id"), blank("titre"), blank("type_texte"), blank("numero"), blank("etat"), day("date_debut"), day("date_fin"), blank("contenu"), blank("nota"), "chemin")


def text_listing(versions: DataFrame, units: DataFrame, texts: DataFrame, source_id: str, state: str = "VIGUEUR") -> DataFrame:
    """Articles of a text in force, in order; missing order and number last."""
    t = texts.filter(F.col("source_id") == source_id).select(F.col("id").alias("texte_id"), "titre")
    u = units.select(F.col("id").alias("unite_id"), "texte_id", "numero", "ordre", "chemin")
    v = versions.filter(F.col("etat") == state).select("unite_id", F.col("source_id").alias("version_source_id"), "contenu")
    out = t.join(u, "texte_id").join(v, "unite_id")
    return out.orderBy(F.col("ordre").asc_nulls_last(), F.col("numero").asc_nulls_last(), F.col("version_source_id").asc_nulls_last())


def topic_analysis(results: DataFrame, kind: str, title: str, content: str, top: int = 5) -> dict[str, DataFrame]:
    """Counts by type and text, mean length and first results of a search."""
    by = lambda c: results.groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c)
    return {
        "types": by(kind), "texts": by(title),
        "summary": results.agg(F.count("*").alias("n"), F.avg(F.length(content)).alias("mean_length")),
        "first": results.orderBy(F.desc("score")).limit(top),
    }


def query_words(query: str) -> str:
    return " ".join(query.split())


