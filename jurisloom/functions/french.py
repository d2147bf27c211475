"""French words: the stop list and the published Snowball stemmer."""

from __future__ import annotations

import re
from functools import lru_cache

# The stop list of French full-text search.
STOP_LIST = frozenset(
    "au aux avec ce ces dans de des du elle en et eux il je la le leur lui ma mais me même mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous "
    "c d j l à m n s t y été étée étées étés étant suis es est sommes êtes sont serai seras sera serons serez seront serais serait serions seriez seraient étais était étions étiez étaient fus fut fûmes fûtes furent "
    "sois soit soyons soyez soient fusse fusses fût fussions fussiez fussent ayant eu eue eues eus ai as avons avez ont aurai auras aura aurons aurez auront aurais aurait aurions auriez auraient avais avait avions aviez "
    "avaient eut eûmes eûtes eurent aie aies ait ayons ayez aient eusse eusses eût eussions eussiez eussent".split()
)
# Vowels and suffixes of the published French stemmer, by what happens to them.
VOWELS = "aeiouyâàëéêèïîôûù"
GONE = "ance iqUe isme able iste eux ances iqUes ismes ables istes eux".split()
ATION = "atrice ateur ation atrices ateurs ations".split()
REPLACED = {"logie": "log", "logies": "log", "usion": "u", "ution": "u", "usions": "u", "utions": "u", "ence": "ent", "ences": "ent"}
EMENT, ITE, IF = ("ement", "ements"), ("ité", "ités"), ("if", "ive", "ifs", "ives")
EUSE, ISSEMENT, MENT = ("euse", "euses"), ("issement", "issements"), ("ment", "ments")
I_VERBS = "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it".split()
E_VERBS = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
A_VERBS = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()
STANDARD = sorted([*GONE, *ATION, *REPLACED, *EMENT, *ITE, *IF, "eaux", "aux", *EUSE, *ISSEMENT, "amment", "emment", *MENT], key=len, reverse=True)
VERBS = sorted(["ions", *E_VERBS, *A_VERBS], key=len, reverse=True)
I_VERBS.sort(key=len, reverse=True)
RESIDUAL = ("ière", "Ière", "ion", "ier", "Ier", "e", "ë")


def _ending(word: str, suffixes: list[str] | tuple[str, ...], start: int = 0) -> str | None:
    """The first (longest) suffix that the word ends with, not before ``start``."""
    return next((s for s in suffixes if word.endswith(s) and len(word) - len(s) >= start), None)


def _after(word: str, start: int) -> int:
    """End of the first consonant that follows a vowel."""
    found = re.compile(f"[{VOWELS}][^{VOWELS}]").search(word, start)
    return found.end() if found else len(word)


class _Stem:
    """One word on its way, and its regions."""

    def __init__(self, word: str) -> None:
        v = f"[{VOWELS}]"
        word = re.sub("qu", "qU", word)
        word = re.sub(f"(?<={v})([ui])(?={v})", lambda m: m[1].upper(), word)
        word = re.sub(f"(?<={v})y|y(?={v})", "Y", word)
        self.word = word
        if re.match(f"{v}{v}", word):
            self.rv = min(3, len(word))
        elif re.match("par|col|tap", word):
            self.rv = 3
        else:
            found = re.compile(v).search(word, 1)
            self.rv = found.end() if found else len(word)
        self.r1 = _after(word, 0)
        self.r2 = _after(word, self.r1)

    def has(self, suffix: str, start: int) -> bool:
        return self.word.endswith(suffix) and len(self.word) - len(suffix) >= start

    def cut(self, suffix: str, by: str = "") -> None:
        self.word = self.word[: len(self.word) - len(suffix)] + by

    def cut_in(self, suffix: str, start: int, otherwise: str | None = None) -> bool:
        """Cut a suffix in its region; else put ``otherwise`` for it.  Whether the word ended so."""
        if not self.word.endswith(suffix):
            return False
        if self.has(suffix, start):
            self.cut(suffix)
        elif otherwise is not None:
            self.cut(suffix, otherwise)
        return True

    def standard(self) -> bool:
        """Whether a standard suffix was taken for good (a new adverb's verb may still be cut)."""
        s = _ending(self.word, STANDARD)
        if s is None:
            return False
        in_r2, in_r1, in_rv = (self.has(s, r) for r in (self.r2, self.r1, self.rv))
        if s in GONE or s in ATION:
            if not in_r2:
                return False
            self.cut(s)
            if s in ATION:
                self.cut_in("ic", self.r2, "iqU")
        elif s in REPLACED:
            if not in_r2:
                return False
            self.cut(s, REPLACED[s])
        elif s in EMENT:
            if not in_rv:
                return False
            self.cut(s)
            if self.word.endswith("iv"):
                if self.has("iv", self.r2):
                    self.cut("iv")
                    self.cut_in("at", self.r2)
            elif self.word.endswith("eus"):
                if self.has("eus", self.r2):
                    self.cut("eus")
                elif self.has("eus", self.r1):
                    self.cut("eus", "eux")
            elif not any(self.cut_in(x, self.r2) for x in ("abl", "iqU")):
                for x in ("ièr", "Ièr"):
                    if self.has(x, self.rv):
                        self.cut(x, "i")
        elif s in ITE:
            if not in_r2:
                return False
            self.cut(s)
            self.cut_in("abil", self.r2, "abl") or self.cut_in("ic", self.r2, "iqU") or self.cut_in("iv", self.r2)
        elif s in IF:
            if not in_r2:
                return False
            self.cut(s)
            if self.has("at", self.r2):
                self.cut("at")
                self.cut_in("ic", self.r2, "iqU")
        elif s == "eaux":
            self.cut(s, "eau")
        elif s == "aux":
            if not in_r1:
                return False
            self.cut(s, "al")
        elif s in EUSE:
            if not (in_r2 or in_r1):
                return False
            self.cut(s, "" if in_r2 else "eux")
        elif s in ISSEMENT:
            if not in_r1 or self.word[-len(s) - 1 : -len(s)] in VOWELS:
                return False
            self.cut(s)
        elif s in ("amment", "emment"):
            if in_rv:
                self.cut(s, "ant" if s == "amment" else "ent")
            return False
        else:  # ment, ments
            before = len(self.word) - len(s) - 1
            if before >= self.rv and self.word[before] in VOWELS:
                self.cut(s)
            return False
        return True

    def verb(self) -> bool:
        s = _ending(self.word, I_VERBS, self.rv)
        if s is not None:
            before = len(self.word) - len(s) - 1
            if before >= self.rv and self.word[before] not in VOWELS:
                self.cut(s)
                return True
        s = _ending(self.word, VERBS, self.rv)
        if s is None or s == "ions" and not self.has(s, self.r2):
            return False
        self.cut(s)
        if s in A_VERBS and self.has("e", self.rv):
            self.cut("e")
        return True

    def residual(self) -> None:
        if self.word.endswith("s") and len(self.word) > 1 and self.word[-2] not in "aiouès":
            self.cut("s")
        s = _ending(self.word, RESIDUAL, self.rv)
        if s == "ion":
            before = len(self.word) - 4
            if self.has(s, self.r2) and before >= self.rv and self.word[before] in "st":
                self.cut(s)
        elif s in ("ier", "ière", "Ier", "Ière"):
            self.cut(s, "i")
        elif s == "e":
            self.cut(s)
        elif s == "ë" and self.has("guë", self.rv):
            self.cut(s)

    def done(self) -> str:
        before = self.word
        taken = self.standard()
        if taken or self.verb() or self.word != before:
            if self.word.endswith("Y"):
                self.cut("Y", "i")
            elif self.word.endswith("ç"):
                self.cut("ç", "c")
        else:
            self.residual()
        if self.word.endswith(("enn", "onn", "ett", "ell", "eill")):
            self.word = self.word[:-1]
        self.word = re.sub(f"[éè](?=[^{VOWELS}]+$)", "e", self.word)
        return self.word.lower()


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a word in lower case."""
    return _Stem(word).done()


@lru_cache(maxsize=200_000)
def lexeme(word: str) -> str:
    """The stem of a word, empty for a stop word."""
    return "" if word in STOP_LIST else stem(word)
