"""What is kept of obligations: runs, candidates, evidence checks, pairs and the cascade's states.

Tables are :class:`~jurisloom.operators.merge.Snapshots` under one root.  A batch
of runs writes its candidates first and its runs last, and candidates are
read through their run, so a batch that dies has left nothing anyone reads.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import obligations as ob
from ..functions.ids import uuid5
from ..operators.dedup import first_seen
from ..operators.merge import OLD, Snapshots
from . import obligations as plan

MODES = {"deterministic": "DETERMINISTIC", "llm": "LLM", "hybrid": "HYBRID"}
JURISDICTIONS = ("FR", "EU")
TABLES = {"run": schemas.RUN, "obligation": schemas.OBLIGATION, "evidence_check": schemas.CHECK, "obligation_pair": schemas.PAIR, "extraction_cascade": schemas.CASCADE}
MODEL_ITEMS = "source_id string, kept string, rejected array<string>, problem string"
#: Fields of a candidate as a model gives them.
ITEM = (
    "array<struct<actor:string,modality:string,action:string,object:string,conditions:array<string>,exceptions:array<string>,deadline:string,frequency:string,threshold:string,"
    "territorial_scope:string,temporal_scope:string,source_excerpt:string,span_start:int,span_end:int>>"
)
PAIR_KEY = ["eu_obligation_id", "fr_obligation_id", "algorithm_version", "scope_origin", "scope_reference"]
STATE_KEY = ["jurisdiction", "source_id", "source_checksum", "policy_version"]


def model_answers(sources: DataFrame, chat_factory: Callable[[], Callable[[str], str]]) -> DataFrame:
    """``source_id, kept, rejected, problem`` of a model's answers: candidates as JSON, reasons, and why there is no answer.

    The factory makes each worker's model.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chat = chat_factory()
        for frame in frames:
            rows = []
            for source, text in zip(frame["source_id"], frame["text"], strict=True):
                try:
                    kept, rejected = plan.model_extract(text, chat)
                    rows.append((source, json.dumps(kept), [f"{k}: {why}" for k, why in rejected], None))
                except Exception as e:  # noqa: BLE001 - one source's failure isn't the batch's
                    rows.append((source, None, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=["source_id", "kept", "rejected", "problem"])

    return sources.select("source_id", "text").mapInPandas(run, MODEL_ITEMS)


class ObligationStore:
    """The tables, and the steps that fill them."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str) -> Snapshots:
        return Snapshots(self.spark, f"{self.root}/{name}", TABLES[name])

    def obligations(self) -> DataFrame:
        """Candidates whose run is complete."""
        return self.table("obligation").read().join(self.table("run").read().select("run_id"), "run_id", "left_semi")

    def extract(
        self, sources: DataFrame, jurisdiction: str, canonical: DataFrame, mode: str = "deterministic", chat_factory: Callable[[], Callable[[str], str]] | None = None,
        provider: str | None = None, model: str | None = None,
    ) -> DataFrame:
        """A run for each source (``source_id, text``); gives the runs, and sources without an answer with their problem.

        Every source must stand in ``canonical`` (``id, text``) with this very text,
        or nothing is stored.  A hybrid run takes candidates by cue first; equal ones
        are stored once.
        """
        if jurisdiction not in JURISDICTIONS or mode not in MODES:
            raise ValueError("unknown jurisdiction or mode")
        if mode != "deterministic" and chat_factory is None:
            raise ValueError(f"mode {mode} needs a model")
        known = canonical.select(F.col("id").alias("source_id"), F.col("text").alias("stored"))
        odd = sources.join(known, "source_id", "left").filter(~F.col("stored").eqNullSafe(F.col("text")) | (F.coalesce(F.trim("text"), F.lit("")) == "")).count()
        if odd:
            raise ValueError(f"{odd} sources are empty, unknown or differ from the corpus")
        batch, began = uuid.uuid4().hex, datetime.now(timezone.utc)
        mine = lambda kind, *more: uuid5(F.concat_ws("|", F.lit(f"{kind}|{batch}|{jurisdiction}"), *(c.cast("string") for c in more)))
        found = []
        if mode != "llm":
            by_cue = plan.extract(sources).withColumnRenamed("excerpt", "source_excerpt").drop("cue")
            none = {c: F.lit(None).cast("string") for c in ob.OPTIONAL_TEXTS} | {c: F.array().cast("array<string>") for c in ob.TEXT_LISTS}
            found.append(by_cue.withColumns(none | {"extractor": F.lit("DETERMINISTIC"), "raw_output": F.lit(None).cast("string"), "rank": F.lit(0)}))
        if mode != "deterministic":
            # Nobody is asked twice: answers are written before anything is made of them.
            asked = Snapshots(self.spark, f"{self.root}/_answers/{batch}", MODEL_ITEMS)
            asked.replace(model_answers(sources, chat_factory))
            answers = asked.read()
            items = answers.filter("problem is null").join(sources, "source_id").select(
                "source_id", F.sha2("text", 256).alias("source_checksum"), F.col("kept").alias("raw_output"), F.posexplode(F.from_json("kept", ITEM)).alias("position", "i")
            )
            found.append(items.select("source_id", "source_checksum", "position", "raw_output", "i.*").withColumns({"extractor": F.lit("LLM"), "rank": F.lit(1)}))
        else:
            answers = sources.select("source_id", F.lit("[]").alias("kept"), F.array().cast("array<string>").alias("rejected"), F.lit(None).cast("string").alias("problem"))
        rows = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        rows = first_seen(rows, plan.IDENTITY, F.struct("rank", "position"))
        rows = rows.join(answers.filter("problem is null").select("source_id"), "source_id", "left_semi").withColumns({
            "run_id": mine("run", F.col("source_id")), "obligation_id": mine("obligation", F.col("source_id"), F.col("rank"), F.col("position")),
            "jurisdiction": F.lit(jurisdiction), "review_status": F.lit("UNREVIEWED"),
        })
        self.table("obligation").append(rows.select(*self.table("obligation").schema.names))
        stored = self.table("obligation").read().join(answers.select("source_id").distinct(), "source_id").filter(F.col("jurisdiction") == jurisdiction)
        stored = stored.groupBy("run_id").agg(F.count("*").alias("stored"))
        rejected, kept = F.size("rejected"), F.size(F.from_json("kept", ITEM))
        runs = answers.withColumn("run_id", mine("run", F.col("source_id"))).join(stored, "run_id", "left")
        runs = runs.withColumns({"rejections": F.col("rejected"), "candidates": (kept + rejected).cast("long"), "kept_n": kept, "rejected": rejected.cast("long")})
        status, outcome = plan.run_result(F.lit(mode), F.col("candidates"), F.col("rejected"), F.col("kept_n"), F.coalesce("stored", F.lit(0)))
        stamp = {
            "pipeline_version": F.lit(plan.PIPELINE_VERSION), "extractor_kind": F.lit(MODES[mode]), "provider": F.lit(provider).cast("string"), "model": F.lit(model).cast("string"),
            "prompt_version": F.lit(plan.PROMPT_VERSION if mode != "deterministic" else None).cast("string"), "jurisdiction": F.lit(jurisdiction), "status": status, "outcome": outcome,
            "started_at": F.lit(began), "finished_at": F.lit(datetime.now(timezone.utc)),
        }
        runs = runs.withColumns(stamp)
        self.table("run").append(runs.filter("problem is null").select(*self.table("run").schema.names))
        return runs.select("run_id", "source_id", "status", "outcome", "candidates", "rejected", "stored", "problem")

    def check_evidence(self, national: DataFrame, european: DataFrame, force: bool = False) -> DataFrame:
        """Verify the evidence of all candidates whose check isn't current; gives all checks."""
        checks = self.table("evidence_check")
        cited = plan.with_source(self.obligations(), national, european)
        fresh = plan.verify(plan.to_verify(cited, checks.read(), force))
        now = F.lit(datetime.now(timezone.utc))
        checks.upsert(fresh.select("obligation_id", F.col("evidence_status").alias("status"), F.col("current_checksum").alias("source_checksum"), "obligation_fingerprint", "validator_version", "issues", now.alias("checked_at")), ["obligation_id"])
        return checks.read()

    def pair(self, scope: plan.Scope, provisions: DataFrame, versions: DataFrame, acts: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
        """Store the best pairs of an explicit scope; gives them, the candidates skipped with their status, and whether the limit cut any off.

        ``provisions`` has ``id, celex, text``, ``versions`` ``id, text``.  Pairs met before keep
        their decision; score, features and time are renewed.
        """
        if acts.filter(F.col("celex") == scope.celex).isEmpty():
            raise LookupError(f"unknown act {scope.celex}")
        scope.require(versions)
        checks = self.check_evidence(versions, provisions).select("obligation_id", F.col("status").alias("evidence_status"))
        runs, rows = self.table("run").read(), self.obligations()
        own = provisions.filter(F.col("celex") == scope.celex).select(F.col("id").alias("source_id"))
        chosen = self.spark.createDataFrame([(x,) for x in scope.version_ids], "source_id string")
        side = lambda j, ids: plan.latest_obligations(rows.join(ids, "source_id", "left_semi"), runs, j).join(checks, "obligation_id").withColumnRenamed("obligation_id", "id")
        pairs, skipped, cut = plan.pair_scope(scope, side("EU", own), side("FR", chosen))
        features = F.struct("field_jaccard", "same_modality", "eu_conditions", "fr_conditions", "eu_exceptions", "fr_exceptions")
        new = pairs.select(
            F.col("eu_id").alias("eu_obligation_id"), F.col("fr_id").alias("fr_obligation_id"), F.lit(scope.celex).alias("eu_celex"), F.lit(scope.origin).alias("scope_origin"),
            F.lit(scope.reference).alias("scope_reference"), F.lit(plan.ALGORITHM_VERSION).alias("algorithm_version"), F.col("score").alias("similarity"), F.lit("REVIEW_REQUIRED").alias("decision"),
            features.alias("features"), F.lit(datetime.now(timezone.utc)).alias("updated_at"),
        )
        self.table("obligation_pair").upsert(new, PAIR_KEY, {"decision": OLD, "eu_celex": OLD})
        return pairs, skipped, cut

    def audit(self, provisions: DataFrame, run_id: str | None = None) -> DataFrame:
        return audit(self.table("obligation").read(), provisions, run_id)

    def states(self) -> DataFrame:
        return self.table("extraction_cascade").read()

    def run_cascade(self, cascade: plan.Cascade, jurisdiction: str, sources: Iterable[tuple[str, str]], policy: str = plan.POLICY_VERSION, retry_failed: bool = False) -> dict[str, dict]:
        """Work through sources (id, text) one by one, each claimed before and its state written after.

        A source left RUNNING by a worker that died is an error, not taken again in
        silence.  Stops when the credit is used up.
        """
        out: dict[str, dict] = {}
        for source, text in sources:
            if not text or len(text) > ob.MOST_CHARS:
                raise ValueError(f"source {source} has none or too many characters")
            key = self._key(jurisdiction, source, text, policy)
            before = self._state(key)
            if plan.claim(before["status"] if before else None, before["attempts"] if before else 0, retry_failed) == "SKIP":
                continue
            attempts = (before["attempts"] if before else 0) + 1
            self._write(key, "RUNNING", attempts)
            out[source] = state = cascade.process(text)
            self._write(key, state["status"], attempts, state)
            if state["status"] == "CREDIT_EXHAUSTED":
                break
        return out

    def _key(self, *parts: str) -> dict[str, str]:
        import hashlib

        jurisdiction, source, text, policy = parts
        return dict(zip(STATE_KEY, (jurisdiction, source, hashlib.sha256(text.encode()).hexdigest(), policy), strict=True))

    def _state(self, key: dict[str, str]) -> dict | None:
        same: Column = F.lit(True)
        for c, v in key.items():
            same = same & (F.col(c) == v)
        row = self.states().filter(same).head()
        return row.asDict() if row else None

    def _write(self, key: dict[str, str], status: str, attempts: int, state: dict | None = None) -> None:
        now, done = datetime.now(timezone.utc), status in ("COMPLETED", "NEEDS_REVIEW")
        row = key | {
            "status": status, "attempts": attempts, "agreement": (state or {}).get("agreement"), "details": json.dumps(state, ensure_ascii=False) if state else None,
            "last_error": (state or {}).get("error"), "claimed_at": now, "completed_at": now if done else None,
        }
        self.table("extraction_cascade").upsert(self.spark.createDataFrame([row], schemas.CASCADE), STATE_KEY, cascade_policy())


# What stored rows may say.
KINDS, STATUSES, REVIEWS = ("DETERMINISTIC", "LLM", "HYBRID", "HUMAN"), ("RUNNING", "SUCCEEDED", "FAILED"), ("UNREVIEWED", "ACCEPTED", "REJECTED", "NEEDS_REVIEW")


def row_rules(table: str) -> dict[str, Column]:
    """Conditions that stored rows keep, by name."""
    one_of = lambda c, allowed: F.col(c).isin(*allowed)
    said = lambda c: F.length(F.trim(c)) > 0
    start, end = F.col("span_start"), F.col("span_end")
    return {
        "run": {
            "KIND": one_of("extractor_kind", KINDS), "STATUS": one_of("status", STATUSES),
            "FINISHED_BEFORE_STARTED": F.col("finished_at").isNull() | (F.col("finished_at") >= F.col("started_at")),
        },
        "obligation": {
            "JURISDICTION": one_of("jurisdiction", JURISDICTIONS), "SOURCE": F.col("source_id").isNotNull(), "CHECKSUM": F.length("source_checksum") > 0, "EXCERPT": said("source_excerpt"),
            "MODALITY": one_of("modality", ob.MODALITIES), "ACTION": said("action"), "REVIEW": one_of("review_status", REVIEWS),
            "SPAN": (start.isNull() & end.isNull()) | ((start >= 0) & (end > start)),
        },
    }[table]


def quarantine(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all conditions, and the others with the names of those they break; a null where a value must be breaks one."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in row_rules(table).items())))
    rows = df.withColumn("problems", broken)
    return rows.filter(F.size("problems") == 0).drop("problems"), rows.filter(F.size("problems") > 0)


def cascade_policy() -> dict[str, Column]:
    """How a state is renewed: what a step doesn't know stays, a claim clears the error, only an end has a time."""
    claimed = F.col("n.status") == "RUNNING"
    kept = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
    return {"agreement": kept("agreement"), "details": kept("details"), "claimed_at": F.when(claimed, F.col("n.claimed_at")).otherwise(F.col("o.claimed_at"))}


def audit(obligations: DataFrame, provisions: DataFrame, run_id: str | None = None) -> DataFrame:
    """Citations and places of stored candidates against their European sources (``id, text``), in order of their ids.

    ``obligation_id, jurisdiction, source_id, issues, ok``; national sources aren't
    part of the audit and say so.
    """
    if run_id is not None:
        obligations = obligations.filter(F.col("run_id") == run_id)
    own = provisions.select(F.lit("EU").alias("jurisdiction"), F.col("id").alias("source_id"), F.col("text").alias("source_text"))
    rows = obligations.join(own, ["jurisdiction", "source_id"], "left")
    text, excerpt, start, end = (F.col(c) for c in ("source_text", "source_excerpt", "span_start", "span_end"))
    # An audit looks at places and texts alone: an empty excerpt is no issue of its own.
    issues = F.array_except(ob.evidence_issues(text, F.col("source_checksum"), excerpt, start, end), F.array(F.lit("EMPTY_EXCERPT")))
    issues = F.when(F.col("jurisdiction") == "FR", F.array(F.lit("FR_SOURCE_NOT_CONFIGURED"))).otherwise(issues)
    return rows.select("obligation_id", "jurisdiction", "source_id", issues.alias("issues")).withColumn("ok", F.size("issues") == 0).orderBy("obligation_id")
