"""Text primitives: one Arrow pass for what the JVM lacks, built-in expressions for the rest."""

from __future__ import annotations

import hashlib
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LAO_THAI_DIGITS = "໐໑໒໓໔໕໖໗໘໙๐๑๒๓๔๕๖๗๘๙"
INVISIBLE = "​‌‍⁠﻿"
URL = r"https?://\S+"
# The country's numbering plan: country code 856 after + or 00, or a trunk 0; then a mobile prefix with eight digits (20)
# or seven (30), or a landline area (21 to 88) with six; digits may be parted by a space, dot or hyphen.
_GAP = r"[ .\-]?"
_PREFIXES = {"20": 8, "30": 7, r"[2-8][1-8]": 6}
PHONE = rf"(?<!\d)(?:(?:\+|00){_GAP}856{_GAP}(?:\(0\))?{_GAP}|\(?0)(?:" + "|".join(rf"{p}\)?(?:{_GAP}\d){{{n}}}" for p, n in _PREFIXES.items()) + r")(?!\d)"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def nfc(texts: pd.Series) -> pd.Series:
    """NFC and full case folding; null stays null."""
    return pd.Series([None if t is None else unicodedata.normalize("NFC", t).casefold() for t in texts], dtype=object)


def _composed(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else unicodedata.normalize("NFC", t) for t in texts], dtype=object)


def composed(column: str | Column) -> Column:
    """NFC of a string column."""
    return F.pandas_udf(_composed, "string")(column)


def folded(column: str | Column) -> Column:
    """NFC and case folding of a string column."""
    return F.pandas_udf(nfc, "string")(column)


def ascii_digits(column: Column) -> Column:
    """Lao and Thai digits as ASCII, invisible signs as blanks; the length stays."""
    return F.translate(column, LAO_THAI_DIGITS + INVISIBLE, "01234567890123456789" + " " * len(INVISIBLE))


def bare(column: Column) -> Column:
    """Letters and digits only, without web addresses and phone numbers."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(column), URL, " "), PHONE, " "), r"[^\p{L}\p{N}]+", "")


def grams(column: Column, n: int = 3) -> Column:
    """Distinct character n-grams; a shorter text is its own gram, an empty one has none."""
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.length(column) - (n - 1), F.lit(1))), lambda i: F.substring(column, i, F.lit(n)))
    return F.when(F.length(column) > 0, F.array_distinct(many)).when(column.isNotNull(), F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays; 0 where either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def _gram_jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    cut = lru_cache(maxsize=1024)(lambda t: frozenset(t[i : i + 3] for i in range(max(1, len(t) - 2))) if t else frozenset())
    out = []
    for s, t in zip(a, b):
        g, h = cut(s or ""), cut(t or "")
        both = len(g & h)
        out.append(both / (len(g) + len(h) - both) if g and h else 0.0)
    return pd.Series(out, dtype=float)


def gram_jaccard(a: str | Column, b: str | Column) -> Column:
    """Share of common distinct character trigrams of two texts; 0 where either is empty or null."""
    return F.pandas_udf(_gram_jaccard, "double")(a, b)


def dice(a: Column, b: Column) -> Column:
    """Twice the common elements over all elements of two arrays."""
    return 2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def masked(column: Column) -> Column:
    """First four and last two signs kept; up to six signs wholly masked."""
    n = F.length(column)
    return F.when(n > 6, F.concat(F.substring(column, 1, 4), F.repeat(F.lit("X"), n - 6), F.substring(column, -2, 2))).otherwise(F.repeat(F.lit("X"), n))


@lru_cache(maxsize=200_000)
def _gram_bits(gram: str) -> np.ndarray:
    h = int.from_bytes(hashlib.sha256(gram.encode()).digest()[:8], "big")
    return np.array([1 if h >> i & 1 else -1 for i in range(64)], dtype=np.int32)


def _simhash(texts: pd.Series) -> pd.Series:
    """Votes of all texts of a batch at once: distinct trigrams are hashed once, then added up per text."""
    grams = [sorted({t[i : i + 3] for i in range(max(1, len(t) - 2))}) if t else [] for t in texts]
    place = {g: k for k, g in enumerate(dict.fromkeys(g for gs in grams for g in gs))}
    bits = np.array([_gram_bits(g) for g in place], dtype=np.int32).reshape(-1, 64)
    out = np.zeros(len(grams), dtype=np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for k, gs in enumerate(grams):
        if gs:
            out[k] = weights[bits[[place[g] for g in gs]].sum(axis=0) > 0].sum(dtype=np.uint64)
    return pd.Series(out.view(np.int64))


def simhash(column: Column) -> Column:
    """64-bit SimHash over the distinct character trigrams of a text as a signed bigint; 0 for null and empty.

    Trigrams are cut in the Arrow batch: character positions in the JVM's UTF-8 strings are counted from
    the start each time, which is quadratic for long texts.
    """
    return F.pandas_udf(_simhash, "long")(column)


def _utf16_slice(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    out = []
    for t, a, b in zip(texts, starts, ends):
        if t is None or a != a or b != b or a is None or b is None:
            out.append(None)
            continue
        s = unicodedata.normalize("NFC", t)
        a, b = max(0, int(a)), max(0, int(b))
        out.append(s[a:b] if s.isascii() or max(s) <= "\uffff" else s.encode("utf-16-le", "surrogatepass")[2 * a : 2 * b].decode("utf-16-le", "replace"))
    return pd.Series(out, dtype=object)


def utf16_slice(text: str | Column, start: str | Column, end: str | Column) -> Column:
    """The part of a text's NFC form between two offsets in UTF-16 units; a split sign gives a replacement sign; null where any is null."""
    return F.pandas_udf(_utf16_slice, "string")(text, start, end)


def truncated(column: Column, most: int) -> Column:
    """The longest beginning of a text of at most ``most`` UTF-8 bytes; no sign is split."""
    ends = [F.substring(F.encode(column, "UTF-8"), 1, max(0, most - k)).cast("string") for k in range(4)]
    whole = F.coalesce(*(F.when(F.is_valid_utf8(e), e) for e in ends))
    return F.when(F.octet_length(column) <= most, column).otherwise(whole)


def keyword_hits(folded_text: Column, terms: list[str]) -> Column:
    """Terms contained in a folded text, in list order."""
    return F.filter(F.array(*(F.lit(t) for t in terms)), lambda t: F.contains(folded_text, t))
