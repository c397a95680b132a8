"""Functions that no built-in gives: sequence similarity, answers as JSON, quotes across typography and ellipses."""

from __future__ import annotations

import json
import re
import unicodedata
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F


def _column(kind: str):
    """Makes a function of series one of columns; the type is parsed when a plan is made, as workers have no session."""

    def wrap(f):
        def call(*columns):
            return F.pandas_udf(f, kind)(*columns)

        call.__doc__ = f.__doc__
        return call

    return wrap


# Limits of a match across ellipses.
SEGMENT, TOTAL, REACH = 4, 20, 400
_QUOTES = str.maketrans({**dict.fromkeys("“”„«»", '"'), **dict.fromkeys("‘’‚‹›", "'"), **dict.fromkeys("–—−", "-"), "…": "..."})
_MARKS = re.compile("[“”„«»‘’‚‹›–—−…]+")


#: From this length of the second text on, SequenceMatcher leaves frequent characters out.
JUNK = 200


def ratio(a: str, b: str) -> float:
    """SequenceMatcher's ratio. Where one text holds the other, that is the longest block and all that matches: no blocks are looked for."""
    if len(b) < JUNK and a + b and (a in b or b in a):
        return 2.0 * min(len(a), len(b)) / (len(a) + len(b))
    return SequenceMatcher(None, a, b).ratio()


@_column("double")
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio of matching characters of two texts, by longest matching blocks; null if either is."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@_column("string")
def without_accents(text: pd.Series) -> pd.Series:
    """Case-folded, single spaces, without combining marks after compatibility decomposition."""
    fold = lambda t: " ".join("".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).casefold().split())
    return pd.Series([None if t is None else fold(t) for t in text], dtype="object")


# An answer's fields and sources, and a fenced block that is a whole text.
ANSWER = "respuesta string, cifra double, unidad string, ticker string, ejercicio int, fuente string, cita string, chunk_id string"
ANSWER_FIELDS = tuple(field.split()[0] for field in ANSWER.split(", "))
SOURCES = ("xbrl", "texto", "ambas", "ninguna")
_FENCE = re.compile(r"```(?:json)?\s*(\{.*\})\s*```", re.IGNORECASE | re.DOTALL)


def answer(text: str | None) -> dict | None:
    """An answer's fields from a text that is a JSON object of the closed schema, whole or as one fenced block; else None.

    No other fields; respuesta (not blank) and fuente must be there. Texts are strings; cifra is a number and ejercicio a whole
    one, or a string or truth value that stands for one. There is no unit without a number.
    """
    fenced = _FENCE.fullmatch(text or "")
    try:
        found = json.loads(fenced[1] if fenced else text or "")
        if not isinstance(found, dict) or found.keys() - set(ANSWER_FIELDS):
            return None
        out = {f: found.get(f) for f in ANSWER_FIELDS}
        if any(not isinstance(v, str) and v is not None for f, v in out.items() if f not in ("cifra", "ejercicio")):
            return None
        out["cifra"] = None if out["cifra"] is None else float(out["cifra"])
        year = None if out["ejercicio"] is None else float(out["ejercicio"])
    except (ValueError, TypeError, RecursionError, OverflowError):
        return None
    if year is not None and (not year.is_integer() or abs(year) >= 2**31):
        return None
    out["ejercicio"] = None if year is None else int(year)
    if not (out["respuesta"] or "").strip() or out["fuente"] not in SOURCES or (out["unidad"] is not None and out["cifra"] is None):
        return None
    return out


@_column(ANSWER)
def parsed_answer(text: pd.Series) -> pd.DataFrame:
    """answer() as a struct; all of its fields are null where there is none."""
    return pd.DataFrame([answer(t) or dict.fromkeys(ANSWER_FIELDS) for t in text], columns=list(ANSWER_FIELDS)).astype({"cifra": "float64", "ejercicio": "Int32"})


def skeleton(text: str) -> str:
    """A text without white space, with plain marks, case-folded. Character by character, so that a part's is a part of the whole's."""
    plain = text if text.isascii() else _MARKS.sub(lambda m: m[0].translate(_QUOTES), text)
    return "".join(plain.casefold().split())


def place(text: str, n: int) -> int:
    """Where the character that gives a text's skeleton its n-th (from 0) stands; stretches are skeletonised, no list of places is made."""
    low, step = 0, n + 16
    while low + step < len(text) and (size := len(skeleton(text[low : low + step]))) <= n:
        low, n = low + step, n - size
    high = min(len(text), low + step)
    while high - low > 1:
        middle = (low + high) // 2
        size = len(skeleton(text[low:middle]))
        if size > n:
            high = middle
        else:
            low, n = middle, n - size
    return low


@lru_cache(maxsize=64)
def _parts(quote: str) -> tuple[str, ...]:
    """The skeletons of a quote's parts between ellipses; none if they are too short to be looked for."""
    parts = tuple(p for p in map(skeleton, re.split(r"…|\.{3,}|\[\s*\]", quote)) if p)
    return () if sum(map(len, parts)) < TOTAL or any(len(p) < SEGMENT for p in parts) else parts


def span(quote: str, text: str) -> str | None:
    """The slice of a text that a quote stands for, its parts between ellipses in order and near each other."""
    parts = _parts(quote)
    if not parts:
        return None
    bones = skeleton(text)
    start = bones.find(parts[0])
    while start >= 0:
        end = start + len(parts[0])
        for p in parts[1:]:
            nxt = bones.find(p, end, end + REACH + len(p))
            if nxt < 0:
                break
            end = nxt + len(p)
        else:
            return text[place(text, start) : place(text, end - 1) + 1]
        start = bones.find(parts[0], start + 1)
    return None


@_column("string")
def quote_span(quote: pd.Series, text: pd.Series) -> pd.Series:
    """The literal slice of a text for a quote, across typography and ellipses; null if there is none."""
    return pd.Series([None if q is None or t is None else span(q, t) for q, t in zip(quote, text, strict=True)], dtype="object")
