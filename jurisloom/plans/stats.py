"""Corpus statistics with isolated failures and a time-limited cache."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.reports import children_of, top_groups, totals

TTL_SECONDS = 900.0


def national(texts: DataFrame, units: DataFrame, versions: DataFrame, models: DataFrame, embeddings: DataFrame, log: DataFrame) -> dict[str, Callable[[], DataFrame]]:
    articles = units.filter(F.col("type") == "ARTICLE").select(F.col("id").alias("unit_id"), "texte_id")
    return {
        "totals": lambda: totals(texts=texts, units=units, versions=versions, embeddings=embeddings).join(
            versions.agg(F.count_if(F.col("etat") == "VIGUEUR").alias("in_force")), F.lit(True)
        ),
        "types": lambda: top_groups(texts, F.col("type"), 20),
        "states": lambda: top_groups(versions, F.col("etat"), 20),
        "largest_texts": lambda: children_of(texts.select("id", "titre"), articles, F.col("id") == F.col("texte_id"), ["id", "titre"], "unit_id", 30),
        "models": lambda: children_of(models.select(F.col("id").alias("model"), "name"), embeddings.select("model_id", "version_id"), F.col("model") == F.col("model_id"), ["model", "name"], "version_id"),
        "last_import": lambda: log.orderBy(F.desc("started_at")).limit(1),
    }


def embedded(embeddings: DataFrame, versions: DataFrame, model: str, state: str = "VIGUEUR") -> DataFrame:
    """One row: how many versions of a state a model has embedded."""
    mine = embeddings.filter(F.col("model") == model).select(F.col("version_id").alias("id"))
    return mine.join(versions.filter(F.col("etat") == state).select("id"), "id").agg(F.count("*").alias("n"))


def european(acts: DataFrame, provisions: DataFrame) -> dict[str, Callable[[], DataFrame]]:
    return {
        "totals": lambda: totals(
            acts=acts, provisions=provisions, empty_acts=acts.join(provisions.select("celex"), "celex", "left_anti"),
            empty_provisions=provisions.filter(F.trim("text") == ""),
        ),
        "kinds": lambda: top_groups(provisions, F.col("kind")),
        "act_types": lambda: top_groups(acts, F.col("act_type")),
    }


class Collector:
    """Runs reports one by one; a failing one gives its error, the others their rows."""

    def __init__(self, ttl: float = TTL_SECONDS, clock: Callable[[], float] = time.monotonic) -> None:
        self.ttl, self.clock = ttl, clock
        self.kept: dict[str, tuple[float, dict]] = {}
        self.lock = threading.Lock()

    def collect(self, key: str, reports: dict[str, Callable[[], DataFrame]]) -> dict[str, dict]:
        with self.lock:
            at, found = self.kept.get(key, (0.0, None))
            if found is not None and self.clock() - at < self.ttl:
                return found
            found = {}
            for name, make in reports.items():
                try:
                    found[name] = {"rows": [r.asDict(True) for r in make().collect()], "error": None}
                except Exception as e:  # noqa: BLE001 - one report must not hide the others
                    found[name] = {"rows": [], "error": f"{type(e).__name__}: {e}"}
            self.kept[key] = (self.clock(), found)
            return found
