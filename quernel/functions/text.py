"""Full-text analysis as column expressions: tokens, English and Spanish stems, and the match of all query tokens."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The analyzers' stop words.
ENGLISH_STOPWORDS = ("the", "and", "or", "a", "an", "of", "to", "in", "on", "for", "with", "is", "it", "this", "that", "by", "from", "as", "at", "be", "are", "was", "were")
SPANISH_STOPWORDS = ("el", "la", "los", "las", "y", "de", "del", "que", "un", "una", "en", "por")

#: Fixed values: (ending, byte length that the token must exceed, letters cut, letters added); the first that applies counts.
ENGLISH_ENDINGS = (("ies", 4, 3, "y"), ("ing", 4, 3, ""), ("ed", 3, 2, ""), ("es", 4, 2, ""), ("s", 3, 1, ""))
SPANISH_ENDINGS = (("mente", 6, 5, ""), ("aciones", 8, 6, ""), ("es", 4, 2, ""), ("s", 4, 1, ""))

ANALYZERS = {"english": (ENGLISH_STOPWORDS, ENGLISH_ENDINGS), "spanish": (SPANISH_STOPWORDS, SPANISH_ENDINGS)}


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda t: t != "")


def stem(token: Column, endings) -> Column:
    out = None
    for ending, longer, cut, added in endings:
        hit = token.endswith(ending) & (F.octet_length(token) > longer)
        stemmed = F.concat(F.substring(token, F.lit(1), F.length(token) - cut), F.lit(added)) if added else F.substring(token, F.lit(1), F.length(token) - cut)
        out = F.when(hit, stemmed) if out is None else out.when(hit, stemmed)
    return out.otherwise(token)


def analyze(text: Column, language: str | None = None) -> Column:
    """The tokens of a text under a language's rules; an unknown language has none."""
    found = tokens(text)
    rules = ANALYZERS.get((language or "").lower())
    if rules is None:
        return found
    stop, endings = rules
    return F.transform(F.filter(found, lambda t: ~t.isin(*stop)), lambda t: stem(t, endings))


def analyze_literal(text: str, language: str | None = None) -> list[str]:
    """analyze() of a query's literal, once, in the driver."""
    found = [t for t in re.split(r"[\W_]+", text.lower()) if t]
    rules = ANALYZERS.get((language or "").lower())
    if rules is None:
        return found
    stop, endings = rules
    out = []
    for t in found:
        if t in stop:
            continue
        for ending, longer, cut, added in endings:
            if t.endswith(ending) and len(t.encode()) > longer:
                t = t[:-cut] + added
                break
        out.append(t)
    return out


def matches(text: Column, query: str, language: str | None = None) -> Column:
    """True where the text holds every token of the query; never for a query or text without tokens."""
    wanted = sorted(set(analyze_literal(query, language)))
    if not wanted:
        return F.lit(False)
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), analyze(text, language))) == 0
