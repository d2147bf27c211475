"""Tokenizers in workers: whole texts, huge texts by overlapping chunks, and pre-tokens remembered.

A huge text is cut into chunks that overlap.  Every chunk is encoded with
offsets, and neighbours are joined at a *stable common boundary*: a character
position inside the overlap where both encodings start a new pre-token.

Why such a position is proven.  A regular-expression pre-tokenizer scans from
left to right without looking behind, and each pre-token is encoded on its own.
So what the scan yields from a pre-token start on depends only on the text from
there on.  If the left chunk's scan (right up to there, by induction) starts a
pre-token at ``p``, the whole text's scan does too; if the right chunk's scan
also starts one at ``p``, both agree on everything that follows, as far as the
right chunk reaches.  The left scan is trusted only up to ``margin`` characters
before its chunk's end, where the missing rest of the text could have changed a
match, a look-ahead or an added token.  Where the overlap has no such position
(one pre-token fills it), the overlap is doubled and the chunk encoded again.

Tokenizers for which this proof does not hold (a normalizer, another
pre-tokenizer, sentencepiece models) encode every text whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of a chunk, of the first overlap, and of a chunk's untrusted end
#: (longer than any added token by far).
CHUNK_CHARS = 32_768
OVERLAP_CHARS = 256
MARGIN_CHARS = 64


class Coder:
    """One tokenizer of a public vocabulary file, loaded once in each worker."""

    def __init__(self, path: str) -> None:
        self.path = path
        if path.endswith(".model"):
            import sentencepiece

            self._sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self.resynchronises = False
            self.added: list[str] = []
            self.vocab_size = self._sp.get_piece_size()
            return
        from tokenizers import Tokenizer

        self._sp = None
        self._tok = Tokenizer.from_file(path)
        self._tok.no_truncation()
        self._tok.no_padding()
        self.vocab_size = self._tok.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        self.added = [t["content"] for t in added]
        self.model = self._tok.model
        self.resynchronises = (
            spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
            and max((len(t["content"]) for t in added), default=0) < MARGIN_CHARS
        )

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        if self._sp is not None:
            return self._sp.encode(texts, num_threads=1)
        return [e.ids for e in self._tok.encode_batch_fast(texts, add_special_tokens=False)]

    def count_many(self, texts: list[str]) -> list[int]:
        if self._sp is not None:
            return [len(x) for x in self._sp.encode(texts, num_threads=1)]
        return [len(e) for e in self._tok.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids, the character each token starts at, and which tokens start a pre-token."""
        enc = self._tok.encode(text, add_special_tokens=False)
        starts = np.fromiter((o[0] for o in enc.offsets), np.int64, len(enc.ids))
        words = np.fromiter((-1 if w is None else w for w in enc.word_ids), np.int64, len(enc.ids))
        new = np.ones(len(words), bool)
        # An added token has no word number, so it and what follows it start anew.
        new[1:] = (words[1:] != words[:-1]) | (words[1:] < 0)
        return enc.ids, starts, new


@lru_cache(maxsize=4)
def coder(path: str) -> Coder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Coder(path)


def encode_long(
    text: str, code: Coder, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, margin: int = MARGIN_CHARS
) -> Iterator[list[int]]:
    """Ids of ``text``, in runs; equal to encoding it whole.

    Holds two chunks at a time.  ``overlap`` grows until neighbours align; in
    the worst case (one endless pre-token) the last chunk is the whole rest.
    """
    n = len(text)
    if n <= chunk or not code.resynchronises:
        yield code.encode_many([text])[0]
        return
    start, end = 0, chunk
    ids, at, new = code.pieces(text[:end])
    skip = 0  # tokens of the current chunk that its predecessor already gave
    while end < n:
        wide = overlap
        while True:
            right = max(start, end - wide)
            r_end = min(n, right + chunk + wide)
            if r_end <= end:
                r_end = min(n, end + chunk)
            if right == start:
                # No boundary in the whole chunk: take it again, twice as long.
                end = min(n, start + 2 * (end - start))
                ids, at, new = code.pieces(text[start:end])
                if end == n:
                    break
                wide = overlap
                continue
            r_ids, r_at, r_new = code.pieces(text[right:r_end])
            left_starts = at[new] + start
            left_starts = left_starts[(left_starts > right) & (left_starts <= end - margin)]
            right_starts = r_at[r_new] + right
            common = np.intersect1d(left_starts, right_starts, assume_unique=False)
            common = common[common >= start + (at[skip] if skip < len(at) else 0)]
            if len(common):
                p = int(common[-1])
                left_cut = int(np.flatnonzero((at + start == p) & new)[0])
                yield ids[skip:left_cut]
                skip = int(np.flatnonzero((r_at + right == p) & r_new)[0])
                start, end, ids, at, new = right, r_end, r_ids, r_at, r_new
                break
            wide *= 2
    yield ids[skip:]


# The letters, numbers and white space of Unicode below U+0250, and
# the contractions of the published byte-level pre-tokenizer.
LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
NUMBERS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
SPACES = r"\t\n\v\f\r \x85\xa0"
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
LATIN_END = 0x250

SPACE, WHITE, LETTER, NUMBER, OTHER = range(5)
#: Pre-tokens of a generation, two of which a worker remembers, and the bytes of the longest.
CACHED_PIECES, CACHED_BYTES = 120_000, 48
#: Text that is encoded at once, about.
SLICE_BYTES = 1 << 20
#: Texts over this many bytes go to the library in overlapping chunks.
LONG_TEXT = 4 << 20


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kind of every character below ``LATIN_END``."""
    table = np.full(LATIN_END, OTHER, np.uint8)
    for kind, chars in ((WHITE, SPACES), (LETTER, LETTERS), (NUMBER, NUMBERS)):
        found = re.compile(f"[{chars}]")
        table[[c for c in range(LATIN_END) if found.match(chr(c))]] = kind
    table[32] = SPACE
    return table


def beyond_latin(data: np.ndarray) -> np.ndarray:
    """Places of bytes that start a character from ``LATIN_END`` on."""
    high = np.flatnonzero(data >= 0xC9)
    following = data[np.minimum(high + 1, len(data) - 1)]
    return high[(data[high] > 0xC9) | (following >= 0x90)]


def pre_tokens(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in the UTF-8 of several texts, none empty, that begin at ``starts``; all characters are below ``LATIN_END``.

    The byte-level pattern takes letters, numbers, or other marks, each with a
    space before if there is one; of several white space characters all but
    the last, unless the text ends with them; and first of all contractions.
    """
    table = kinds()
    kind = table[np.where(data < 0x80, data, 0)]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        kind[lead] = kind[lead + 1] = table[((data[lead].astype(np.int64) & 0x1F) << 6) | (data[lead + 1] & 0x3F)]
    begin = np.empty(len(data), bool)
    begin[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begin[1:])
    white = kind <= WHITE
    # A run of white space is one thing, and a space belongs to what follows.
    begin[1:] &= ~((white[1:] & white[:-1]) | (~white[1:] & (kind[:-1] == SPACE)))
    begin[starts] = True
    # Its last character, if something follows in the text, starts anew.
    last = white.copy()
    last[:-1] &= ~white[1:]
    last[-1] = False
    last[starts[1:] - 1] = False
    # (of two bytes, where the character has two)
    last = np.flatnonzero(last)
    begin[last - ((data[last] & 0xC0) == 0x80)] = True
    quotes = np.flatnonzero(begin & (data == 0x27))
    if len(quotes):
        ends = np.append(starts[1:], len(data))
        end = ends[np.searchsorted(starts, quotes, "right") - 1]
        for c in CONTRACTIONS:
            fits = quotes + len(c) <= end
            for k, x in enumerate(c.encode()[1:], 1):
                fits &= data[np.minimum(quotes + k, len(data) - 1)] == x
            found = quotes[fits]
            begin[found + 1] = False
            after = found + len(c)
            begin[after[after < end[fits]]] = True
    return np.flatnonzero(begin)


class _Words(dict):
    """The model's ids of single pre-tokens: those of late, and before them as many that may come back."""

    def __init__(self, code: Coder) -> None:
        super().__init__()
        self.model = code.model
        self.chars = byte_chars()
        self.space = chr(self.chars[32])
        self.old: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        found = self.old.get(word)
        if found is None:
            text = word.decode("latin-1")
            text = text.replace(" ", self.space) if text.isascii() and text.isprintable() else text.translate(self.chars)
            found = array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
            if len(word) > CACHED_BYTES:
                return found
        if len(self) >= CACHED_PIECES:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found


def byte_chars() -> dict[int, int]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves, the other bytes in
    ascending order for the characters from U+0100 on.
    """
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in own)}


class TextEncoder:
    """Ids of whole texts, many at once, with a bounded memory of pre-tokens already encoded.

    With a byte-level tokenizer pre-tokens are encoded one by one, so texts
    below ``LATIN_END`` are cut into them all together and each different one
    goes to the library's model once.  Texts with other characters or an added
    token, those of other tokenizers, and very long ones go to the library
    whole or in overlapping chunks; both ways give the same ids.
    """

    def __init__(self, code: Coder) -> None:
        self.code = code
        self.words = _Words(code) if code.resynchronises else None

    def library(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if len(text) <= CHUNK_CHARS:
            return np.array(self.code.encode_many([text])[0], np.uint32)
        return np.concatenate([np.array(run, np.uint32) for run in encode_long(text, self.code)])

    def _plain(self, texts: pa.Array) -> np.ndarray:
        """Which of the texts (large strings without nulls) are cut here."""
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        plain = (size > 0) & (size <= LONG_TEXT)
        for token in self.code.added:
            plain &= ~pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        offsets, data = _buffers(texts)
        plain[np.searchsorted(offsets, beyond_latin(data), "right") - 1] = False
        return plain

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of plain texts: ids of the different pre-tokens side by side, how many each has, every pre-token's number among them, and where texts' pre-tokens start."""
        offsets, data = _buffers(texts)
        at = pre_tokens(data, offsets[:-1])
        cuts = np.append(at, len(data))
        words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
        place, raw = _buffers(words.dictionary)
        raw, place = raw.tobytes(), place.tolist()
        ids = [self.words[raw[a:b]] for a, b in zip(place[:-1], place[1:], strict=True)]
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        return np.frombuffer(b"".join(ids), np.uint32), n, words.indices.to_numpy(), np.searchsorted(at, offsets[:-1])

    def counts(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text has; nulls are empty texts."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        out = np.zeros(len(texts), np.int64)
        plain = self._plain(texts) if self.words is not None and len(texts) else np.zeros(len(texts), bool)
        if plain.any():
            _, n, word, first = self._pieces(texts.filter(pa.array(plain)))
            out[plain] = np.add.reduceat(n[word], first)
        for k in np.flatnonzero(~plain).tolist():
            out[k] = len(self.library(texts[k].as_py()))
        return out

    def encode_many(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; nulls are empty texts."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        plain = self._plain(texts) if self.words is not None and len(texts) else np.zeros(len(texts), bool)
        cut: list[np.ndarray] = []
        if plain.any():
            ids, n, word, first = self._pieces(texts.filter(pa.array(plain)))
            size = n[word]
            end = np.cumsum(size)
            place = np.repeat((np.cumsum(n) - n)[word] - (end - size), size)
            flat = ids[place + np.arange(len(place))]
            cut = np.split(flat, (end - size)[first[1:]])
        cuts = iter(cut)
        return [next(cuts) if p else self.library(texts[k].as_py()) for k, p in enumerate(plain.tolist())]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many(pa.array([text], pa.string()))[0]


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and bytes of large strings."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    return offsets - offsets[0], data


@lru_cache(maxsize=4)
def text_encoder(path: str) -> TextEncoder:
    return TextEncoder(coder(path))
