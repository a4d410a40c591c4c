"""Text normalisation as Column expressions."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from freshet.functions.vocab import KEPT_LETTERS

# Word edges between ASCII letters, digits and underscore; the regex engine's own edge also looks
# at other letters.
WORD_START, WORD_END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
ASCII_ONLY = r"\A\p{ASCII}*\z"


@functools.cache
def _marks() -> re.Pattern[str]:
    """One character class of all combining marks, as ranges."""
    codes = [i for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i))[0] == "M"]
    starts = [c for c in codes if unicodedata.category(chr(c - 1))[0] != "M"]
    ends = [c for c in codes if c == sys.maxunicode or unicodedata.category(chr(c + 1))[0] != "M"]
    return re.compile("[" + "".join(f"{chr(lo)}-{chr(hi)}" for lo, hi in zip(starts, ends)) + "]+")


_KEPT = re.compile(f"[{''.join(KEPT_LETTERS)}]")


def strip_marks(text: str, form: str) -> str:
    return _marks().sub("", unicodedata.normalize(form, text))


def _fold(text: str) -> str:
    return _KEPT.sub(lambda found: KEPT_LETTERS[found.group()], strip_marks(text, "NFKD").lower())


@F.pandas_udf(StringType())
def _fold_wide(values: pd.Series) -> pd.Series:
    return values.map(_fold, na_action="ignore")


_WIDE = re.compile(r"[^\x00-\x7f]")
WIDE_KINDS = 64  # of a text with more kinds of non-ASCII characters all are taken at once


@functools.cache
def _bare(char: str) -> str:
    return strip_marks(char, "NFD")


def _unaccented(text: str) -> str:
    """`strip_marks(text, "NFD").lower()`, by kinds of characters: a decomposed text is that of its characters but for
    the order of their marks, which go."""
    wide = set(_WIDE.findall(text))
    if len(wide) > WIDE_KINDS:
        return strip_marks(text, "NFD").lower()
    for char in wide:
        if _bare(char) != char:
            text = text.replace(char, _bare(char))
    return text.lower()


@F.pandas_udf(StringType())
def _unaccent_wide(values: pd.Series) -> pd.Series:
    return values.map(_unaccented, na_action="ignore")


def _wide_only(text: Column, udf) -> Column:
    # Plain ASCII stays in the JVM; Python sees a null for it.
    ascii_only = text.rlike(ASCII_ONLY)
    return F.when(ascii_only, F.lower(text)).otherwise(udf(F.when(~ascii_only, text)))


def fold(text: Column) -> Column:
    """comparison key, lower-case without accents, ligatures spelled out."""
    return _wide_only(text, _fold_wide)


def unaccent(text: Column) -> Column:
    """Lower-case without accents but with ß, ø and the like kept (search tokens)."""
    return _wide_only(text, _unaccent_wide)


def tokens(text: Column) -> Column:
    """letter/digit runs of the unaccented text."""
    return runs(unaccent(text))


def runs(plain: Column) -> Column:
    """Letter/digit runs of a text that is unaccented already."""
    return F.regexp_extract_all(plain, F.lit(r"([\p{L}\p{N}]+)"), 1)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed once, however often `use` refers to it."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def sanitize(text: Column) -> Column:
    """filter value without bracketed parts, dash runs as a space."""
    bare = F.lower(F.regexp_replace(text, r"\([^)]*\)", " "))
    return squeeze(F.regexp_replace(bare, r"[-–—]+", " "))


def sanitize_literal(raw: str) -> str:
    """F2 for one request value."""
    bare = re.sub(r"\([^)]*\)", " ", raw).lower()
    return " ".join(re.sub("[-–—]+", " ", bare).split())


# Marks that a URI component leaves as they are but form encoding escapes.
_UNRESERVED = {"%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}


def to_slug(text: Column) -> Column:
    """percent-encoded name."""
    encoded = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for escape, mark in _UNRESERVED.items():
        encoded = F.replace(encoded, F.lit(escape), F.lit(mark))
    return encoded


def from_slug(slug: Column) -> Column:
    """a bare plus is a space; a malformed escape gives the empty name."""
    decoded = F.try_url_decode(slug)
    return F.when(decoded.isNull() | decoded.contains("�"), F.lit("")).otherwise(decoded)


def company_from_slug(slug: Column) -> Column:
    return sanitize(from_slug(slug))


def role_key(company: Column, title: Column) -> Column:
    """F4."""
    return F.concat_ws("|", fold(company), fold(title))


_XML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


def xml_escape(text: Column) -> Column:
    """F20."""
    for mark, entity in _XML:
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def escape_like(raw: str) -> str:
    """Make %, _ and the escape mark literal."""
    return "".join("\\" + c if c in "%_\\" else c for c in raw)
