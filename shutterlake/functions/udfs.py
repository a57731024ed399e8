"""Functions that Spark SQL has no expression for, as vectorised UDFs."""

from __future__ import annotations

import json
import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = re.compile(r"[^\W_]+")
_VOWEL = "aeiou"


def _consonant(w: str, i: int) -> bool:
    return w[i] not in _VOWEL and not (w[i] == "y" and i > 0 and _consonant(w, i - 1))


def _measure(w: str) -> int:
    """How often a vowel is followed by a consonant."""
    shape = [_consonant(w, i) for i in range(len(w))]
    return sum(b and not a for a, b in zip(shape, shape[1:], strict=False))


def _has_vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _short(w: str) -> bool:
    return len(w) >= 3 and _consonant(w, len(w) - 1) and not _consonant(w, len(w) - 2) and _consonant(w, len(w) - 3) and w[-1] not in "wxy"


# The suffix rules of Porter's published algorithm.
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def porter_stem(w: str) -> str:
    """The stem of a lower-case word by Porter's algorithm."""
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        ending = next((e for e in ("ed", "ing") if w.endswith(e) and _has_vowel(w[: -len(e)])), None)
        if ending:
            w = w[: -len(ending)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        found = max((r for r in rules if w.endswith(r[0])), key=lambda r: len(r[0]), default=None)
        if found and _measure(w[: -len(found[0])]) > 0:
            w = w[: -len(found[0])] + found[1]
    ending = max((e for e in _STEP4 if w.endswith(e)), key=len, default=None)
    if ending:
        stem = w[: -len(ending)]
        if _measure(stem) > 1 and (ending != "ion" or stem.endswith(("s", "t"))):
            w = stem
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def fold(text: str) -> str:
    """Lower case without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def words_in(folded: str) -> list[str]:
    """The words of a folded text."""
    return _WORD.findall(folded)


@F.pandas_udf(T.ArrayType(T.StringType()))
def porter_tokens(text: pd.Series) -> pd.Series:
    """Distinct stems of a text: folded, split at what is neither letter nor digit."""
    known: dict[str, str] = {}

    def stem(w: str) -> str:
        if w not in known:
            known[w] = porter_stem(w)
        return known[w]

    return text.map(lambda t: None if t is None else sorted({stem(w) for w in words_in(fold(t))}))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X >= k) of a binomial: exact below 30 trials, else the normal with a continuity correction."""
    if k <= 0:
        return 1.0
    if n <= 0 or k > n or p <= 0:
        return 0.0
    if p >= 1:
        return 1.0
    if n < 30:
        return min(1.0, sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1)))
    return 0.5 * math.erfc((k - 0.5 - n * p) / math.sqrt(2 * n * p * (1 - p)))


@F.pandas_udf(T.DoubleType())
def binom_sf(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """:func:`binomial_tail` of columns."""
    return pd.Series([binomial_tail(int(a), int(b), float(c)) for a, b, c in zip(k, n, p, strict=True)])


#: Fixed value: characters of an answer that are read at most.
ANSWER_CHARS = 512_000


def repaired(text: str | None) -> str | None:
    """JSON text without a code fence and without trailing commas; an answer that is too long is null."""
    if text is None or len(text) > ANSWER_CHARS:
        return None
    body = text.strip()
    fence = re.search(r"```(?:json)?\s*(.*?)\s*```", body, re.S | re.I)
    body = fence[1].strip() if fence else body
    while (less := re.sub(r",(\s*[}\]])", r"\1", body)) != body:
        body = less
    return body


_REPLY = {"perspective_slug": str, "score": int, "rationale": str, "not_attempted": bool}


def strict_score(text: str | None) -> tuple:
    """(perspective_slug, score, rationale, not_attempted, error) of a model's answer.

    The answer must be an object with exactly these fields, of which only
    not_attempted may be left out, and a score from 1 to 10; else error says why.
    """
    body = repaired(text)
    if body is None:
        return None, None, None, None, "no answer, or too large"
    try:
        got = json.loads(body)
    except ValueError:
        return None, None, None, None, "no JSON"
    if not isinstance(got, dict):
        return None, None, None, None, "no object"
    got = {"not_attempted": False} | got
    wrong = [f"{k}: missing" for k in _REPLY if k not in got] + [f"{k}: unknown" for k in got if k not in _REPLY]
    score = got.get("score")
    if isinstance(score, float) and score.is_integer():
        got["score"] = int(score)
    wrong += [f"{k}: not a {t.__name__}" for k, t in _REPLY.items() if k in got and (not isinstance(got[k], t) or (t is int and isinstance(got[k], bool)))]
    if not wrong and not 1 <= got["score"] <= 10:
        wrong = ["score: not from 1 to 10"]
    if wrong:
        return None, None, None, None, "; ".join(wrong)
    return got["perspective_slug"], got["score"], got["rationale"], got["not_attempted"], None


@F.pandas_udf(T.StructType([T.StructField("perspective_slug", T.StringType()), T.StructField("score", T.IntegerType()), T.StructField("rationale", T.StringType()), T.StructField("not_attempted", T.BooleanType()), T.StructField("error", T.StringType())]))
def parse_score(text: pd.Series) -> pd.DataFrame:
    """:func:`strict_score` of a column."""
    rows = pd.DataFrame([strict_score(t) for t in text], columns=["perspective_slug", "score", "rationale", "not_attempted", "error"])
    return rows.astype({"score": "Int32", "not_attempted": "boolean"})


@F.pandas_udf(T.StringType())
def repair_json(text: pd.Series) -> pd.Series:
    """:func:`repaired` of a column."""
    return text.map(repaired)


def parsed_description(text: str | None) -> str | None:
    """The JSON object of a model's answer: whole, or its outermost braces, else the answer as a summary."""
    if text is None:
        return None
    body = repaired(text)
    inner = re.search(r"\{.*\}", body, re.S)
    for part in (body, inner[0] if inner else None):
        try:
            if part is not None and isinstance(got := json.loads(part), dict):
                return json.dumps(got, ensure_ascii=False)
        except ValueError:
            pass
    return json.dumps({"summary": text.strip()}, ensure_ascii=False)


@F.pandas_udf(T.StringType())
def parse_description(text: pd.Series) -> pd.Series:
    """:func:`parsed_description` of a column."""
    return text.map(parsed_description)


@F.pandas_udf(T.StringType())
def first_body_line(markdown: pd.Series) -> pd.Series:
    """The first line that is neither blank nor the leading heading."""

    def first(text: str | None) -> str | None:
        if text is None:
            return None
        heading = False
        for line in text.splitlines():
            if not line.strip():
                continue
            if line.lstrip().startswith("# ") and not heading:
                heading = True
                continue
            return line.strip()
        return ""

    return markdown.map(first)
