"""Language proportions of a text by mixture inference.

Training counts byte trigrams (lower case, everything but letters turned into a
space, runs of spaces as one) by language, hashed into a fixed number of cells.
A text's trigrams are modelled as a mixture of the languages and of noise (all
cells alike): expectation-maximisation fits the proportions until the
log-likelihood settles.  The set of languages is selected by penalised
likelihood among the nested sets of the largest proportions, each refitted:
log-likelihood less half the logarithm of the number of independent trigrams
for every language.  Sets grow up to all languages; a text is done once a bound
on the likelihood of all languages tells that no larger set can win.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, extended, id_crc, map_arrow, slices

#: Cells of the whole model: languages times cells of a language never exceed it (64 MB).
MODEL_CELLS = 1 << 24
MOST_BITS = 16
#: Languages that the driver lists (there are some 8,000 in the world); more is an error, none is dropped.
MOST_LANGUAGES = 1 << 14
SMOOTHING = 0.5
#: A fit has settled when a step adds no more than this to a text's log-likelihood.
SETTLED = 1e-3
#: Neighbouring trigrams share characters: one in three counts as independent.
SHARED = 3.0
UNDETERMINED = "und"


def _letters(texts: pa.Array) -> pa.Array:
    clean = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}]+", " ")
    return clean


def trigrams(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Document number and cell of every trigram of cleaned texts."""
    clean = _letters(texts).cast(pa.large_string())
    offsets = np.frombuffer(clean.buffers()[1], np.int64)[clean.offset : clean.offset + len(clean) + 1]
    buffer = clean.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer else np.empty(0, np.uint8)
    lengths = np.diff(offsets)
    if len(data) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    wide = data.astype(np.uint32)
    code = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
    cell = (code * np.uint32(2654435761)) >> np.uint32(32 - bits)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    inside = doc[:-2] == doc[2:]
    return doc[:-2][inside], cell[inside].astype(np.int64)


def counts(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, cell and count, in order."""
    doc, cell = trigrams(texts, bits)
    key = np.sort((doc << bits) | cell) if len(doc) else np.empty(0, np.int64)
    new = np.flatnonzero(np.diff(key, prepend=-1))
    n = np.diff(np.append(new, len(key)))
    return key[new] >> bits, key[new] & ((1 << bits) - 1), n


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray, int]:
    """Languages (by code point), log-ready probabilities (cells x languages) and bits of a cell.

    Rows without a language or text teach nothing.  Counts are summed in the
    tasks, so a shuffle carries at most ``MODEL_CELLS`` rows from each; the
    table that reaches the driver has at most as many for any input.
    """
    labelled = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    labelled = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    langs = sorted(r[0] for r in labelled.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} different values: {lang_col} holds no languages")
    if not langs:
        return [], np.empty((0, 0), np.float32), 0
    bits = min(MOST_BITS, int(np.log2(MODEL_CELLS // len(langs))))
    number = {x: k for k, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for whole in batches:
            for batch in slices(whole, "text"):
                lang = np.array([number[x] for x in batch.column("lang").to_pylist()])
                doc, cell = trigrams(batch.column("text"), bits)
                both = (lang[doc] << bits) | cell
                for k in np.unique(lang):
                    mine = both[both >> bits == k] & ((1 << bits) - 1)
                    total[k] = total.get(k, 0) + np.bincount(mine, minlength=1 << bits)
        for k, v in total.items():
            cell = np.flatnonzero(v)
            yield pa.RecordBatch.from_pydict({"key": (int(k) << bits) | cell, "n": v[cell].astype(np.int64)})

    table = map_arrow(labelled, run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    model = np.zeros((len(langs), 1 << bits), np.float64)
    key = table["key"].to_numpy()
    model[key >> bits, key & ((1 << bits) - 1)] = table["n"].to_numpy()
    model = (model + SMOOTHING) / (model.sum(1, keepdims=True) + SMOOTHING * model.shape[1])
    return langs, np.ascontiguousarray(model.T.astype(np.float32)), bits


def _of(texts: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of some of the texts, each one's number among these, and where theirs start."""
    n = np.diff(np.append(starts, size))[texts]
    new = np.cumsum(n) - n
    doc = np.repeat(np.arange(len(texts)), n)
    return np.arange(len(doc)) + (starts[texts] - new)[doc], doc, new


def _fit(p: np.ndarray, n: np.ndarray, doc: np.ndarray, starts: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions by expectation-maximisation until each text's log-likelihood settles, and this.

    A text stops on its own, so its result doesn't depend on those beside it.
    As a likelihood is bounded and each step but the last adds ``SETTLED``, all stop.
    """
    theta, fit = theta.copy(), np.full(len(starts), -np.inf)
    total = np.add.reduceat(n, starts).astype(np.float32)[:, None]
    live, moving = np.arange(len(starts)), np.ones(len(starts), bool)
    while moving.any():
        if moving.sum() * 2 <= len(moving):
            at, doc, starts = _of(np.flatnonzero(moving), starts, len(p))
            p, n, total, live = p[at], n[at], total[moving], live[moving]
            moving = moving[moving]
        share = p * theta[live][doc]
        mixed = share.sum(1)
        now = np.add.reduceat(np.log(mixed) * n, starts, dtype=np.float64)
        moving &= now - fit[live] > SETTLED
        on = live[moving]
        fit[on] = now[moving]
        share *= (n / mixed)[:, None]
        theta[on] = (np.add.reduceat(share, starts, axis=0) / total)[moving]
    return theta, fit


def infer(texts: pa.Array, model: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (documents x languages) of the selected languages, and of noise.

    Documents without a trigram have zeros.
    """
    n_docs, n_langs = len(texts), model.shape[1]
    out, noise = np.zeros((n_docs, n_langs), np.float32), np.zeros(n_docs, np.float32)
    doc, cell, n = counts(texts, bits)
    if not len(doc) or not n_langs:
        return out, noise
    present, starts = np.unique(doc, return_index=True)
    d = np.repeat(np.arange(len(present)), np.diff(np.append(starts, len(doc))))
    n = n.astype(np.float32)
    flat = np.full((len(cell), 1), 1.0 / (1 << bits), np.float32)
    p = np.concatenate((model[cell], flat), 1)
    first = np.full((len(present), n_langs + 1), 1.0 / (n_langs + 1), np.float32)
    theta, most = _fit(p, n, d, starts, first)
    # No proportions reach a likelihood beyond this: it is concave, and its steepest slope bounds what is left to gain.
    slope = np.add.reduceat(p * (n / np.einsum("ij,ij->i", p, theta[d]))[:, None], starts, axis=0, dtype=np.float64).max(1)
    most += np.maximum(slope - np.add.reduceat(n, starts), 0)
    order = np.argsort(-theta[:, :-1], 1, kind="stable")
    penalty = 0.5 * np.log(np.maximum(np.add.reduceat(n, starts) / SHARED, 2.0))
    best = np.full(len(present), -np.inf)
    chosen = np.zeros_like(theta)
    left = np.arange(len(present))
    for k in range(1, n_langs + 1):
        # This set and all larger ones are at most as likely as all languages.
        left = left[most[left] / SHARED - k * penalty[left] > best[left]]
        if not len(left):
            break
        at, e, new = _of(left, starts, len(p))
        pick = order[left, :k]
        q = np.concatenate((p[at[:, None], pick[e]], flat[at]), 1)
        t = np.concatenate((theta[left[:, None], pick], theta[left, -1:]), 1) + np.float32(1e-4)
        t /= t.sum(1, keepdims=True)
        t, fit = _fit(q, n[at], e, new, t)
        fit = fit / SHARED - k * penalty[left]
        better = fit > best[left]
        on = left[better]
        best[on] = fit[better]
        chosen[on] = 0
        chosen[on[:, None], pick[better]] = t[better, :-1]
        chosen[on, -1] = t[better, -1]
    out[present], noise[present] = chosen[:, :-1], chosen[:, -1]
    return out, noise


def predict(df: DataFrame, langs: list[str], model: np.ndarray, bits: int, text_col: str = "text") -> DataFrame:
    """``df`` with ``lang_pred, score, lang_noise, lang_mix`` from the text alone.

    ``lang_mix`` lists the selected languages with their proportions, largest
    first.  ``und`` and 0 for a null text, one without a letter, or where no
    language was learned; a text too short for a trigram gets the first
    language with proportion 0.  Columns of these names are replaced.  Narrow.
    """
    keep = df.drop("lang_pred", "score", "lang_noise", "lang_mix")
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)  # at most MODEL_CELLS floats
    mix_type = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        size = max(1 << 16, (1 << 20) * 8 // max(8, len(langs)))
        for whole in batches:
            for batch in slices(whole, text_col, size):
                texts = batch.column(text_col)
                letter = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                share, noise = infer(texts, table, bits)
                top = share.argmax(1) if len(langs) else np.zeros(len(texts), int)
                known = letter & bool(langs)
                names = [langs[k] if ok else UNDETERMINED for k, ok in zip(top.tolist(), known.tolist(), strict=True)]
                score = np.where(known, share[np.arange(len(top)), top] if len(langs) else 0.0, 0.0)
                mixes = [
                    [{"lang": langs[k], "share": float(s[k])} for k in np.argsort(-s, kind="stable") if s[k] > 0] if ok else []
                    for s, ok in zip(share, known, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1).astype(np.float64)), pa.array(noise.astype(np.float64)), pa.array(mixes, mix_type)],
                    names=[*batch.schema.names, "lang_pred", "score", "lang_noise", "lang_mix"],
                )

    schema = extended(keep, lang_pred="string", score="double", lang_noise="double", lang_mix="array<struct<lang:string,share:double>>")
    return map_arrow(keep, run, schema)


def learned_part(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows to learn from: crc32 of the id isn't divisible by 5."""
    return df.filter(id_crc(id_col) % 5 != 0)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from four in five."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    langs, model, bits = train(learned_part(docs))
    found = predict(docs.select("doc_id", "text"), langs, model, bits)
    return found.select("doc_id", (id_crc("doc_id") % 5 == 0).alias("held_out"), "lang_pred", "score", "lang_noise")
