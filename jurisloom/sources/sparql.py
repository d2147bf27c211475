"""A SPARQL endpoint: questions about many keys at once, as transports for :mod:`jurisloom.sources.remote`."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote, urlencode
from urllib.request import Request, urlopen

# The public endpoint, addresses of its resources, and the predicate of equal things.
ENDPOINT = "https://publications.europa.eu/webapi/rdf/sparql"
CELLAR, CELEX = "http://publications.europa.eu/resource/cellar/", "http://publications.europa.eu/resource/celex/"
SAME_AS = "http://www.w3.org/2002/07/owl#sameAs"
COUNTRY = "FRA_"


def values(base: str, keys: list[str]) -> str:
    return " ".join(f"<{base}{k}>" for k in keys)


def aliases_of(works: list[str]) -> str:
    """All other names of objects."""
    return f"SELECT DISTINCT ?work ?alias WHERE {{ VALUES ?work {{ {values(CELLAR, works)} }} ?work <{SAME_AS}> ?alias }}"


def measures_of(acts: list[str]) -> str:
    """Relations, either way, between acts and national measures of one country."""
    either = " UNION ".join(f'{{ {a} ?relation {b} . BIND("{name}" AS ?direction) }}' for a, b, name in (("?nim", "?work", "NIM_TO_DIRECTIVE"), ("?work", "?nim", "DIRECTIVE_TO_NIM")))
    national = f'FILTER(STRSTARTS(STR(?name), "{CELEX}7") && CONTAINS(UCASE(STR(?name)), "{COUNTRY}") && ?nim != ?work)'
    return f"SELECT DISTINCT ?act ?work ?nim ?name ?relation ?direction WHERE {{ VALUES ?act {{ {values(CELEX, acts)} }} ?work <{SAME_AS}> ?act . {either} ?nim <{SAME_AS}> ?name . {national} }}"


@dataclass
class Endpoint:
    """Sends queries one after another, with at least ``gap`` seconds between them."""

    url: str = ENDPOINT
    seconds: float = 60.0
    gap: float = 0.5
    agent: str = "jurisloom/1"
    opener: Callable = urlopen
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    _last: float | None = field(default=None, repr=False)

    def rows(self, query: str) -> Iterator[dict[str, str]]:
        """Bindings as plain values; unbound variables are missing."""
        if self._last is not None and (left := self._last + self.gap - self.clock()) > 0:
            self.sleep(left)
        self._last = self.clock()
        headers = {"Accept": "application/sparql-results+json", "Content-Type": "application/x-www-form-urlencoded", "User-Agent": self.agent}
        with self.opener(Request(self.url, urlencode({"query": query}).encode(), headers), timeout=self.seconds) as answer:
            found = json.load(answer)["results"]["bindings"]
        return ({name: bound["value"] for name, bound in row.items()} for row in found)

    def aliases(self, works: list[str]) -> dict[str, list[str]]:
        """Names of each object; one that isn't known has none."""
        out: dict[str, list[str]] = {k: [] for k in works}
        for row in self.rows(aliases_of(works)):
            if row["work"].removeprefix(CELLAR) in out:
                out[row["work"].removeprefix(CELLAR)].append(row["alias"])
        return out

    def measures(self, acts: list[str]) -> dict[str, list[dict[str, str | None]]]:
        """Relations of each act to national measures."""
        out: dict[str, list[dict[str, str | None]]] = {k: [] for k in acts}
        for row in self.rows(measures_of(acts)):
            act = row["act"].rpartition("/")[2].upper()
            uri = unquote(row["name"]).strip()
            out.setdefault(act, []).append({"eu_work_uri": row.get("work"), "nim_work_uri": row.get("nim"), "uri": uri, "relation": row.get("relation"), "direction": row.get("direction")})
        return out
