"""Text analysis for ranking: words, stop words, folding, and a Spanish stemmer."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Interrogatives that the Spanish stop list has only without an accent.
ACCENTED = ("qué", "cómo", "cuál", "cuáles", "quién", "quiénes", "dónde", "cuándo", "cuánto", "cuánta", "cuántos", "cuántas")


def plain_terms(text: str | Column) -> Column:
    """Words in small letters, split at what is neither letter nor digit; the analysis that SQL can repeat."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def fold(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


# Fixed values of the public Spanish stemming algorithm: suffixes by step, here without accents, as words are folded first.
PRONOUNS = ("selas", "selos", "sela", "selo", "las", "les", "los", "nos", "me", "se", "la", "le", "lo")
BEFORE_PRONOUN = ("iendo", "ando", "ar", "er", "ir")
STANDARD = {
    "delete": ("anza", "anzas", "ico", "ica", "icos", "icas", "ismo", "ismos", "able", "ables", "ible", "ibles", "ista", "istas", "oso", "osa", "osos", "osas", "amiento", "amientos", "imiento", "imientos"),
    "ic": ("adora", "ador", "acion", "adoras", "adores", "aciones", "ante", "antes", "ancia", "ancias"),
    "log": ("logia", "logias"),
    "u": ("ucion", "uciones"),
    "ente": ("encia", "encias"),
    "amente": ("amente",),
    "mente": ("mente",),
    "idad": ("idad", "idades"),
    "iva": ("iva", "ivo", "ivas", "ivos"),
}
Y_VERB = ("ya", "ye", "yan", "yen", "yeron", "yendo", "yo", "yo", "yas", "yes", "yais", "yamos")
E_VERB = ("en", "es", "eis", "emos")
VERB = (
    "arian arias aran aras ariais aria areis ariamos aremos ara are erian erias eran eras eriais eria ereis eriamos eremos era ere "
    "irian irias iran iras iriais iria ireis iriamos iremos ira ire aba ada ida ia ara iera ad ed id ase iese aste iste an aban ian aran ieran asen iesen aron ieron "
    "ado ido ando iendo io ar er ir as abas adas idas ias aras ieras ases ieses is ais abais iais arais ierais aseis ieseis asteis isteis "
    "ados idos amos abamos iamos imos aramos ieramos iesemos asemos"
).split()
RESIDUAL, RESIDUAL_E = ("os", "a", "o", "i"), ("e",)
_V = "aeiouáéíóúü"


def _regions(w: str) -> tuple[int, int, int]:
    """Where RV, R1 and R2 begin."""

    def after(start: int) -> int:
        for i in range(start, len(w) - 1):
            if w[i] in _V and w[i + 1] not in _V:
                return i + 2
        return len(w)

    r1 = after(0)
    r2 = after(r1)
    rv = len(w)
    if len(w) > 2:
        if w[1] not in _V:
            rv = next((i + 1 for i in range(2, len(w)) if w[i] in _V), len(w))
        elif w[0] in _V:
            rv = next((i + 1 for i in range(2, len(w)) if w[i] not in _V), len(w))
        else:
            rv = 3
    return rv, r1, r2


def _longest(w: str, suffixes: tuple[str, ...] | list[str], start: int) -> str | None:
    best = None
    for s in suffixes:
        if w.endswith(s) and len(w) - len(s) >= start and (best is None or len(s) > len(best)):
            best = s
    return best


@lru_cache(maxsize=100_000)
def stem_es(word: str) -> str:
    """The stem of a folded Spanish word."""
    w = word
    rv, r1, r2 = _regions(w)
    p = _longest(w, PRONOUNS, rv)
    if p:
        base = w[: -len(p)]
        b = _longest(base, BEFORE_PRONOUN, rv)
        if b or (base.endswith("uyendo") and len(base) - 5 >= rv):
            w = base
    before = w
    w = _standard(w, r1, r2)
    if w == before:
        s = _longest(w, Y_VERB, rv)
        if s and w[: -len(s)].endswith("u"):
            w = w[: -len(s)]
        else:
            s, e = _longest(w, VERB, rv), _longest(w, E_VERB, rv)
            if e and (not s or len(e) > len(s)):
                w = w[: -len(e)]
                if w.endswith("gu"):
                    w = w[:-1]
            elif s:
                w = w[: -len(s)]
    s = _longest(w, RESIDUAL, rv)
    if s:
        w = w[: -len(s)]
    elif w.endswith("e") and len(w) - 1 >= rv:
        w = w[:-1]
        if w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w


def _standard(w: str, r1: int, r2: int) -> str:
    kinds = {s: k for k, group in STANDARD.items() for s in group}
    s = _longest(w, list(kinds), 0)
    if not s:
        return w
    kind, base = kinds[s], w[: -len(s)]
    if len(base) < (r1 if kind == "amente" else r2):
        return w

    def drop(b: str, *ends: str) -> str:
        e = _longest(b, ends, r2)
        return b[: -len(e)] if e else b

    if kind == "ic":
        return drop(base, "ic")
    if kind in ("log", "u", "ente"):
        return base + kind
    if kind == "amente":
        cut = drop(base, "iv", "os", "ic", "ad")
        return drop(cut, "at") if cut != base and base.endswith("iv") else cut
    if kind == "mente":
        return drop(base, "ante", "able", "ible")
    if kind == "idad":
        return drop(base, "abil", "ic", "iv")
    if kind == "iva":
        return drop(base, "at")
    return base


@lru_cache(maxsize=1)
def stop_words() -> frozenset[str]:
    """Spark's Spanish and English lists, and the accented interrogatives. Read on the driver."""
    from pyspark.ml.feature import StopWordsRemover

    return frozenset([*StopWordsRemover.loadDefaultStopWords("spanish"), *StopWordsRemover.loadDefaultStopWords("english"), *ACCENTED])


_WORDS = re.compile(r"[^\W_]+")


def analyze(text: str | None, stops: frozenset[str]) -> list[str]:
    """Words in small letters without stop words, folded, stemmed; stop words go before accents do."""
    return [stem_es(fold(w)) for w in _WORDS.findall((text or "").lower()) if w not in stops]


def stemmed_terms(stops: frozenset[str]):
    """analyze as a vectorised function of a text column."""

    @F.pandas_udf("array<string>")
    def terms(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: analyze(t, stops))

    return terms
