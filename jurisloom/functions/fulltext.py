"""Full-text search: query syntax, matching and cover-density rank.

Lexemes are lower-case runs of letters and digits ('simple'), or the stems of
those that aren't stop words ('french').  Matching is an expression over the
array of a document's lexemes.  The rank of a match sums over the shortest
spans that satisfy the query, in a vectorised function over matching rows only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType

from .french import lexeme

# Weights of the labels D, C, B, A.
WEIGHTS = {"D": 0.1, "C": 0.2, "B": 0.4, "A": 1.0}
WORD = r"[\p{L}\p{N}]+"


@dataclass(frozen=True)
class Query:
    """Alternatives of phrases that all have to be there, and of phrases that mustn't."""

    alternatives: tuple[tuple[tuple[str, ...], ...], ...] = ()
    excluded: tuple[tuple[str, ...], ...] = field(default=())

    @property
    def terms(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(w for alt in self.alternatives for phrase in alt for w in phrase if w))

    @property
    def unwanted(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(w for phrase in self.excluded for w in phrase if w))

    def satisfied(self, places: dict[str, set[int]]) -> bool:
        """Whether these positions of lexemes satisfy an alternative (exclusions aside)."""
        return any(all(phrase_in(phrase, places) for phrase in alt) for alt in self.alternatives)


def phrase_in(phrase: tuple[str, ...], places: dict[str, set[int]]) -> bool:
    """Whether the words stand at their distances; an empty word is a gap that any word may fill."""
    steps = [(k, w) for k, w in enumerate(phrase) if w]
    return any(all(p + k in places.get(w, ()) for k, w in steps[1:]) for p in places.get(steps[0][1], ()))


def _words(text: str, config: str) -> tuple[str, ...]:
    """Lexemes of a phrase, empty ones for stop words between them."""
    found = re.findall(r"[^\W_]+", text.lower())
    words = found if config == "simple" else [lexeme(w) for w in found]
    while words and not words[-1]:
        words.pop()
    while words and not words[0]:
        words.pop(0)
    return tuple(words)


def parse_query(text: str, config: str = "simple") -> Query:
    """Web-search syntax: words are all required, quotes make a phrase, ``or`` separates alternatives, ``-`` excludes."""
    alternatives, excluded, current = [], [], []
    for minus, quoted, bare in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
        if not minus and bare.lower() == "or":
            alternatives.append(tuple(current))
            current = []
            continue
        words = _words(quoted or bare, config)
        if words:
            (excluded if minus else current).append(words)
    alternatives.append(tuple(current))
    return Query(tuple(a for a in alternatives if a), tuple(excluded))


def lexemes(text: Column, config: str = "simple") -> Column:
    """Lexemes in order, repeats kept; stop words leave a gap so that positions stay."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return found if config == "simple" else french_lexemes(found)


@F.pandas_udf(ArrayType(StringType()))
def french_lexemes(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: None if ws is None else [lexeme(w) for w in ws])


def _phrase(words: Column, phrase: tuple[str, ...]) -> Column:
    if len(phrase) == 1:
        return F.array_contains(words, phrase[0])
    bars = F.concat(F.lit("|"), F.array_join(words, "|"), F.lit("|"))
    if all(phrase):
        return F.contains(bars, F.lit("|" + "|".join(phrase) + "|"))
    return bars.rlike(r"\|" + r"\|".join(re.escape(w) if w else r"[^|]*" for w in phrase) + r"\|")


def matches(words: Column, query: Query) -> Column:
    """Whether a document's lexemes satisfy the query."""
    out = F.lit(False)
    for alternative in query.alternatives:
        every = F.lit(True)
        for phrase in alternative:
            every = every & _phrase(words, phrase)
        out = out | every
    for phrase in query.excluded:
        out = out & ~_phrase(words, phrase)
    return out


def cover_density(places: list[tuple[int, str, float]], query: Query) -> float:
    """Sum over minimal spans that satisfy the query of their mean weight over one plus the words between.

    ``places`` are ``(position, term, weight)`` of the query's terms, in order.  The mean is harmonic.
    """
    total, begin = 0.0, 0
    while begin < len(places):
        seen: dict[str, set[int]] = {}
        for end in range(begin, len(places)):
            seen.setdefault(places[end][1], set()).add(places[end][0])
            if query.satisfied(seen):
                break
        else:
            return total
        seen = {}
        for start in range(end, begin - 1, -1):
            seen.setdefault(places[start][1], set()).add(places[start][0])
            if query.satisfied(seen):
                break
        inside = places[start : end + 1]
        weight = len(inside) / sum(1 / w for _, _, w in inside)
        noise = places[end][0] - places[start][0] - (len(inside) - 1)
        total += weight / (1 + (noise if noise >= 0 else len(inside) / 2))
        begin = start + 1
    return total


def rank(query: Query, *parts: tuple[Column, str]) -> Column:
    """Rank of a document given as ``(lexemes, weight label)`` parts, one after another.

    Only places of the query's terms leave the engine.  Call it on matches.
    """
    terms = list(query.terms)
    offset, found = F.lit(0), []
    for words, label in parts:
        hits = F.filter(F.transform(words, lambda w, i, o=offset, x=label: F.struct((i + 1 + o).alias("pos"), w.alias("term"), F.lit(WEIGHTS[x]).alias("weight"))), lambda h: h["term"].isin(terms))
        found.append(hits)
        offset = offset + F.size(F.coalesce(words, F.array().cast("array<string>")))
    return rank_places(query, F.concat(*found))


def rank_places(query: Query, places: Column) -> Column:
    """Rank from ``array<struct<pos, term, weight>>``.  Vectorised."""

    @F.pandas_udf(DoubleType())
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: cover_density(sorted((h["pos"], h["term"], h["weight"]) for h in r), query)).astype("float64")

    return run(places)


def matches_places(query: Query, places: Column) -> Column:
    """Whether a document satisfies the query, from the places of its terms and of the unwanted ones.  Native for single words, else vectorised."""
    if all(len(p) == 1 for alt in (*query.alternatives, query.excluded) for p in alt):
        terms = F.transform(places, lambda h: h["term"])
        every = lambda alt: reduce(lambda x, y: x & y, (F.array_contains(terms, p[0]) for p in alt))
        out = reduce(lambda x, y: x | y, map(every, query.alternatives), F.lit(False))
        return reduce(lambda x, p: x & ~F.array_contains(terms, p[0]), query.excluded, out)

    @F.pandas_udf(BooleanType())
    def run(rows: pd.Series) -> pd.Series:
        def one(hits: list) -> bool:
            at: dict[str, set[int]] = {}
            for h in hits:
                at.setdefault(h["term"], set()).add(h["pos"])
            return query.satisfied(at) and not any(phrase_in(p, at) for p in query.excluded)

        return rows.map(one).astype(bool)

    return run(places)


def single_term_rank(words: Column, term: str, label: str = "D") -> Column:
    """The rank for one term: its weight for every occurrence.  Native."""
    return F.size(F.filter(words, lambda w: w == term)) * F.lit(WEIGHTS[label])
