"""Text functions. Offsets are code points; spans are half open.

Patterns run in the JVM with the flags for Unicode classes and case, as Java's defaults are ASCII.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import urllib.parse
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Unicode has it, with the separators U+001C to U+001F.
_SPACE = r"[\s\x1c-\x1f\x85\xa0]"


def squeeze(text: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, f"(?U){_SPACE}+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)^{_SPACE}+|{_SPACE}+$", "")


def trimmed_span(text: Column, start: Column, end: Column) -> Column:
    """The span [start, end) of ``text`` without white space at its ends, as a struct."""
    part = F.substr(text, start + 1, end - start)
    lead = F.length(F.regexp_extract(part, f"(?U)^({_SPACE}*)", 1))
    tail = F.length(F.regexp_extract(part, f"(?U)({_SPACE}*)$", 1))
    blank = lead >= end - start
    return F.struct(F.when(blank, end).otherwise(start + lead).cast("int").alias("start"), F.when(blank, end).otherwise(end - tail).cast("int").alias("end"))


def context(text: Column, start: Column, end: Column, width: int = 32) -> Column:
    """Up to ``width`` characters before and after a span; null where there is none."""
    before = F.substr(text, F.greatest(start - width, F.lit(0)) + 1, F.least(start, F.lit(width)))
    after = F.substr(text, end + 1, F.lit(width))
    empty = lambda x: F.when(x != "", x)
    return F.struct(empty(before).alias("prefix"), empty(after).alias("suffix"))


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores, in order."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


#: Words that are no name by themselves, as they stand in addresses and salutations.
TITLES = frozenset(
    (
        "an a à herr herrn hrn hr frau fr frl fräulein dr prof doctor monsieur madame mme mlle m mr mrs ms sehr geehrter geehrte hochgeehrter "
        "wohlgeboren hochwohlgeboren baron graf gräfin hofrat hofrath"
    ).split()
)
ROMAN = r"^[ivxlcdm]+$"
#: What parts the words of a name.
NAME_SPLIT = r"[\s.,;:()]+"


def name_like(surface: Column) -> Column:
    """Some word of more than one character is neither a title nor a Roman numeral."""
    words = F.split(F.lower(surface), "(?U)" + NAME_SPLIT)
    return F.exists(words, lambda w: (F.length(w) > 1) & ~w.isin(*sorted(TITLES)) & ~w.rlike(ROMAN))


def slug_of(value: str) -> str:
    """ASCII letters and digits joined by hyphens, at most 48, and ten digits of the case-folded value's SHA-256."""
    plain = unicodedata.normalize("NFKD", value).encode("ascii", "ignore").decode()
    base = re.sub("[^a-z0-9]+", "-", plain.casefold()).strip("-")[:48].strip("-")
    return "-".join(x for x in (base, hashlib.sha256(value.casefold().encode()).hexdigest()[:10]) if x)


@F.pandas_udf(T.StringType())
def slug(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else slug_of(v))


@F.pandas_udf(T.StringType())
def casefold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else v.casefold())


def quoted_iri(value: Column) -> Column:
    """Percent-encoded, safe as one path segment."""
    return F.replace(F.replace(F.replace(F.url_encode(value), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def quote(value: str) -> str:
    return urllib.parse.quote(value, safe="")


def valid_iri(value: Column) -> Column:
    """Absolute, with a scheme and none of the characters that IRIs exclude."""
    return F.coalesce(value.rlike(r'^[A-Za-z][A-Za-z0-9+.\-]*:[^\x00-\x20<>"{}|\\^`]+$'), F.lit(False))


IRI = re.compile(r'[A-Za-z][A-Za-z0-9+.\-]*:[^\x00-\x20<>"{}|\\^`]+')


def is_iri(value: str) -> bool:
    return bool(IRI.fullmatch(value))


def safe_link(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^(?i)https?://[^\s]+$"), F.lit(False))


def certainty(value: Column) -> Column:
    """A score written without trailing zeros, of four digits at most."""
    return F.regexp_replace(F.format_string("%.4f", value), r"\.?0+$", "")


class OccurrenceFinder:
    """Every occurrence of terms in a text, at word boundaries, whatever the case."""

    def __init__(self, terms: dict[str, list[str]]):
        self._patterns = [(kind, re.compile(rf"(?<!\w){re.escape(term)}(?!\w)", re.IGNORECASE)) for kind, group in terms.items() for term in group]

    def find(self, text: str) -> Iterator[tuple[int, int, str]]:
        for kind, pattern in self._patterns:
            for match in pattern.finditer(text):
                yield match.start(), match.end(), kind
