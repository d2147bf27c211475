"""Text expressions: white space, markup, sentences, labels, tokens."""

from __future__ import annotations

import ast
import contextlib
import html
import json
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters that count as white space, spelled out so that every engine agrees.
SPACE = r"[\t\n\u000B\f\r\u001C-\u001F \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
# Latin letters with an accent, and the letters that a compatibility decomposition leaves of them.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿĀāĂăĄąĆćĈĉĊċČčĎďĒēĔĕĖėĘęĚěĜĝĞğĠġĢģĤĥĨĩĪīĬĭĮįİĴĵĶķĹĺĻļĽľŃńŅņŇňŌōŎŏŐőŔŕŖŗŘřŚśŜŝŞşŠšŢţŤťŨũŪūŬŭŮůŰűŲųŴŵŶŷŸŹźŻżŽž"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyyAaAaAaCcCcCcCcDdEeEeEeEeEeGgGgGgGgHhIiIiIiIiIJjKkLlLlLlNnNnNnOoOoOoRrRrRrSsSsSsSsTtTtUuUuUuUuUuUuWwYyYZzZzZz"
# Words that never count as tokens.
STOP_WORDS = "de du des le la les un une et ou a au aux en dans pour par sur est sont être etre que qui se son sa ses ce cette ces doit doivent peut peuvent faire objet".split()
# The entities that cleaning resolves by itself; all others go to the standard's whole list.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&middot;": "·", "&copy;": "©", "&amp;": "&"}
# Tags that stand for a line break before them, and those that also close with one.
BREAK_TAGS, BLOCK_TAGS = ("br", "p", "div", "li", "blockquote"), ("p", "div", "li", "blockquote")


def collapse_spaces(text: Column) -> Column:
    """Runs of white space as one space, none at either end."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def clean_markup(markup: Column, named_only: bool = False) -> Column:
    """Visible text of markup: block tags as line breaks, entities resolved, blanks collapsed, one empty line at most.

    ``named_only`` resolves those of ``ENTITIES`` with their semicolon and leaves all others as they stand.
    """
    # Any case as other engines fold it: the Kelvin sign is a k.
    tags = lambda names: "|".join(names).replace("k", "[k\u212a]")
    x = F.coalesce(markup, F.lit(""))
    x = F.regexp_replace(x, f"(?i)<(?:{tags(BREAK_TAGS)})(?:[ \\t\\r\\n][^>]*)?/?>", "\n")
    x = F.regexp_replace(x, f"(?i)</(?:{tags(BLOCK_TAGS)})[ \\t\\r\\n]*>", "\n")
    x = F.regexp_replace(x, "<[^>]*>", "")
    x = with_named(x) if named_only else resolved(x)
    x = F.replace(x, F.lit("\u00a0"), F.lit(" "))
    x = F.regexp_replace(x, "[ \\t]+", " ")
    x = F.regexp_replace(x, "\\n[ \\t]+", "\n")
    return F.regexp_replace(F.regexp_replace(x, "\\n{3,}", "\n\n"), "^[ \\t\\r\\n]+|[ \\t\\r\\n]+\\z", "")


@F.pandas_udf(StringType())
def _unescaped(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else html.unescape(t))


def with_named(text: Column) -> Column:
    """Text with the entities of ``ENTITIES`` resolved, once each, and no others."""
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), text)


def resolved(text: Column) -> Column:
    """Text with its entities resolved, once each; only texts with rarer ones go to a vectorised function."""
    common = "|".join(name[1:] for name in ENTITIES)
    rare = text.rlike(rf"&(?!{common})[#A-Za-z]")
    return F.coalesce(_unescaped(F.when(rare, text)), with_named(text))


def _said(value: object) -> object:
    """What a text says as JSON, as a Python literal, or else itself."""
    for read in (json.loads, ast.literal_eval):
        if isinstance(value, str):
            with contextlib.suppress(ValueError, SyntaxError, MemoryError, RecursionError):
                return read(value.strip())
    return value.strip() if isinstance(value, str) else value


def titles_of(value: str | None) -> str:
    """Titles of a path written as text, repeats in a row dropped, joined by ' > '; what is no list is one title."""
    said = _said(value or "")
    titles: list[str] = []
    for item in map(_said, said if isinstance(said, list) else [said]):
        if isinstance(item, dict):
            item = next((item[k] for k in ("titre", "title", "libelle") if item.get(k)), "")
        title = str(item).strip() if item else ""
        if title and titles[-1:] != [title]:
            titles.append(title)
    return " > ".join(titles)


@F.pandas_udf(StringType())
def written_path_titles(path: pd.Series) -> pd.Series:
    return path.map(titles_of)


def first_filled(*alternatives: Column) -> Column:
    """The first alternative that is neither null nor empty."""
    return F.coalesce(*(F.nullif(a, F.lit("")) for a in alternatives))


def sentences(text: Column) -> Column:
    """Runs without a sentence or line end, with the end mark that follows."""
    return F.regexp_extract_all(text, F.lit(r"[^.!?\n]+(?:[.!?]|$)"), F.lit(0))


@F.pandas_udf(StringType())
def _decomposed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def fold(text: Column, decomposed: bool = True) -> Column:
    """Lower case of the compatibility decomposition without its marks.

    Texts of ASCII and the accented letters above are translated; only others,
    say with ligatures or marks of their own, go to a vectorised function.  Unless
    ``decomposed``, these letters are all that is translated.
    """
    text = F.coalesce(text, F.lit(""))
    if not decomposed:
        return F.lower(F.translate(text, ACCENTED, PLAIN))
    known = text.rlike(rf"^[\x00-\x7F{ACCENTED}]*$")
    return F.lower(F.coalesce(_decomposed(F.when(~known, text)), F.translate(text, ACCENTED, PLAIN)))


def tokens(text: Column, stop_words: list[str] = STOP_WORDS, decomposed: bool = True) -> Column:
    """Distinct folded words of three characters or more that aren't stop words."""
    found = F.array_distinct(F.regexp_extract_all(fold(text, decomposed), F.lit("[a-z0-9]{3,}"), F.lit(0)))
    return F.array_except(found, F.lit(stop_words)) if stop_words else found


def excerpt(text: Column, length: int) -> Column:
    """At most ``length`` characters, with an ellipsis where more follow."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("…"))).otherwise(text)


def mask_dsn(dsn: Column) -> Column:
    """A connection string without its password."""
    x = F.regexp_replace(dsn, r"(://[^:/@\s]+):[^@/\s]*@", "$1:***@")
    return F.regexp_replace(x, r"(?i)(password\s*=\s*)('[^']*'|\S+)", "$1***")


def label_of(code: Column, labels: dict[str, str]) -> Column:
    """A code's label; without one, its words in title case."""
    known = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))[code] if labels else F.lit(None)
    return F.coalesce(known, F.initcap(F.lower(F.replace(code, F.lit("_"), F.lit(" ")))))


def path_titles(path: Column) -> Column:
    """Titles of a typed path, consecutive repeats dropped, joined by ' > '."""
    titles = F.filter(
        F.transform(path, lambda p: collapse_spaces(first_filled(p["titre"], p["title"], p["libelle"]))), lambda t: t.isNotNull() & (t != "")
    )
    kept = F.filter(titles, lambda t, i: (i == 0) | (t != F.element_at(titles, F.greatest(i, F.lit(1)))))
    return F.array_join(kept, " > ")


def embedding_document(kind: Column, title: Column, number: Column, path: Column, content: Column) -> Column:
    """What is embedded of a version: type, title, article number and path on lines of their own, an empty line, the content."""
    head = F.concat_ws("\n", F.nullif(kind, F.lit("")), F.nullif(title, F.lit("")), F.concat(F.lit("Article "), F.nullif(number, F.lit(""))), F.nullif(path, F.lit("")))
    return F.when(head == "", F.coalesce(content, F.lit(""))).otherwise(F.concat(head, F.lit("\n\n"), F.coalesce(content, F.lit(""))))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
