"""Word shingles of many texts at once, on the bytes of an Arrow column.

Words are runs of ASCII letters, ASCII digits and bytes of characters beyond
ASCII, in lower case.  A shingle is five words in a row; a text of one to four
words has one shingle of all its words, a text without a word has none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
U = np.uint64
_IS_WORD = np.zeros(256, bool)
_IS_WORD[128:] = True
for _a, _b in ((48, 57), (65, 90), (97, 122)):
    _IS_WORD[_a : _b + 1] = True
#: Longer words are hashed one by one.
LONG_WORD = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _odd(k: int) -> np.uint64:
    """A fixed odd multiplier."""
    return U(int.from_bytes(hashlib.blake2b(k.to_bytes(8, "little"), digest_size=8).digest(), "little") | 1)


_LANE = U(0x9E3779B97F4A7C15)
_PLACE = [_odd(k) for k in range(SHINGLE + 1)]


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """``document number, hash, start, end`` of every word, and the bytes that starts and ends count in.  Null texts have none."""
    clean = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    offsets = np.frombuffer(clean.buffers()[1], np.int64)[clean.offset : clean.offset + len(clean) + 1]
    raw = clean.buffers()[2]
    none = np.empty(0, np.int64)
    if raw is None or offsets[-1] == offsets[0]:
        return none, np.empty(0, U), none, none, b""
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = _IS_WORD[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = np.unique(offsets[:-1][np.diff(offsets) > 0])
    begin[edges] = inside[edges]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    finish[edges[1:] - 1] = inside[edges[1:] - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    # Eight bytes at a time, from any place of the buffer.
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    length = ends - starts
    h = np.full(len(starts), _LANE)
    left, at = np.minimum(length, LONG_WORD), starts
    which = None
    while True:
        bits = (np.minimum(left, 8) * 8).astype(U)
        lane = lanes[at] & (U(0xFFFFFFFFFFFFFFFF) >> (U(64) - bits))
        new = mix((h if which is None else h[which]) * _LANE ^ lane)
        if which is None:
            h = new
        else:
            h[which] = new
        more = left > 8
        if not more.any():
            break
        which = np.flatnonzero(more) if which is None else which[more]
        left, at = left[more] - 8, at[more] + 8
    for k in np.flatnonzero(length > LONG_WORD):
        word = data[starts[k] : ends[k]].tobytes()
        h[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return doc, mix(h ^ length.astype(U)), starts, ends, data


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Document number and 64-bit hash of every shingle, documents in order, repeats kept."""
    doc, h, *_ = words(texts)
    return shingles_of(doc, h)


def shingles_of(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(h)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, U)
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    count = np.diff(np.append(first, n))
    few = count < SHINGLE
    out_doc, out_hash = [], []
    if n >= SHINGLE:
        whole = doc[: n - SHINGLE + 1] == doc[SHINGLE - 1 :]
        total = np.zeros(n - SHINGLE + 1, U)
        for k in range(SHINGLE):
            total += h[k : n - SHINGLE + 1 + k] * _PLACE[k]
        out_doc.append(doc[: n - SHINGLE + 1][whole])
        out_hash.append(mix(total)[whole])
    if few.any():
        start, c = first[few], count[few]
        total = _PLACE[SHINGLE] * c.astype(U)
        for k in range(SHINGLE - 1):
            has = c > k
            total[has] += h[start[has] + k] * _PLACE[k]
        out_doc.append(doc[start])
        out_hash.append(mix(total))
    doc, h = np.concatenate(out_doc), np.concatenate(out_hash)
    if few.any():
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
    return doc, h


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every ``n`` words in a row, each as of a text of just these words; ``n`` is below ``SHINGLE``."""
    total = np.full(max(0, len(h) - n + 1), _PLACE[SHINGLE] * U(n))
    for k in range(n):
        total += h[k : len(total) + k] * _PLACE[k]
    return mix(total)


def sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    doc, h = shingles(texts)
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [np.unique(h[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def written_shingles(text: str | None) -> set[tuple[str, ...]]:
    """The shingles of one text as words, for verification on a few texts."""
    import re

    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", pc.utf8_lower(pa.scalar(text or "")).as_py())
    if not found:
        return set()
    return {tuple(found[i : i + SHINGLE]) for i in range(max(1, len(found) - SHINGLE + 1))}
