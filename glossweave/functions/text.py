"""Text columns: lookup keys, language tags, scopes, concept addresses."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Strings made of these characters have NFKC+casefold = lower + (ß -> ss):
# ASCII without the separators U+001C..U+001F, and the Latin-1 letters.
_SIMPLE_TEXT = r"^[\x00-\x1b\x20-\x7eÀ-ÖØ-öø-ÿ]*$"
_LANGUAGE_TAG = r"^[a-z0-9]{2,8}(-[a-z0-9]{1,8})*$"
_REQUEST_TAG = r"^[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*$"


@F.pandas_udf(T.StringType())
def _compatibility_casefold(values: pd.Series) -> pd.Series:
    return values.map(
        lambda v: None if v is None else " ".join(unicodedata.normalize("NFKC", v).casefold().split())
    )


@F.pandas_udf(T.StringType())
def _compatibility_form(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def squeeze(col: Column) -> Column:
    """Collapse every whitespace run to one space and trim."""
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def strip(col: Column) -> Column:
    """Drop whitespace of any kind at both ends."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def is_simple(col: Column) -> Column:
    """Text whose lookup key needs no Unicode tables beyond lower-casing."""
    return col.rlike(_SIMPLE_TEXT)


def simple_key(col: Column) -> Column:
    """Lookup key of simple text, in the JVM."""
    return squeeze(F.replace(F.lower(col), F.lit("ß"), F.lit("ss")))


def full_key(col: Column) -> Column:
    """Lookup key of any text, by the Arrow function."""
    return _compatibility_casefold(col)


def lookup_key(col: Column) -> Column:
    """NFKC, casefold, collapsed whitespace.

    Spark has no NFKC or casefold, so text outside ASCII and Latin-1 letters takes the
    Arrow function; the other rows only pass NULLs through it.
    """
    simple = is_simple(col)
    return F.when(simple, simple_key(col)).otherwise(full_key(F.when(~simple, col)))


def compatibility_text(col: Column) -> Column:
    """NFKC with collapsed whitespace (case kept), for row digests."""
    simple = col.rlike(_SIMPLE_TEXT)
    return squeeze(F.when(simple, col).otherwise(_compatibility_form(F.when(~simple, col))))


def language_tag(col: Column, fallback: Column | str = "und") -> Column:
    """On-disk language tag, or the fallback when the value is no tag."""
    other = F.lit(fallback) if isinstance(fallback, str) else fallback
    filled = F.coalesce(F.when(col != "", col), other)
    tag = F.lower(F.replace(F.trim(filled), F.lit("_"), F.lit("-")))
    return F.when(tag.rlike(_LANGUAGE_TAG), tag).otherwise(other)


def request_language(col: Column) -> Column:
    """Request tag in stored form; NULL when it is not a valid tag."""
    raw = F.replace(F.trim(col), F.lit("_"), F.lit("-"))
    return F.when(raw.rlike(_REQUEST_TAG), F.lower(raw))


def sense_scope(sense_id: Column) -> Column:
    unsensed = sense_id.isNull() | (sense_id == "") | sense_id.contains(":unsensed:")
    return F.when(unsensed, "unsensed").otherwise("sense")


def space_count(col: Column) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit(" "), F.lit("")))


def concept_parts(uri: Column, strict: bool = True) -> tuple[Column, Column]:
    """(language, term) of a ``/c/<language>/<term>[/…]`` address; NULLs when malformed.

    Strict addresses are graph nodes: their tag is mapped to stored form and may not be
    ``und``. Otherwise the tag only has to be a lower-cased tag.
    """
    pieces = F.split(uri, "/")
    shaped = (F.size(pieces) >= 4) & (F.get(pieces, F.lit(1)) == "c")
    tag = F.get(pieces, F.lit(2))
    language = F.when(shaped, language_tag(tag) if strict else F.lower(tag))
    known = (language != "und") if strict else language.rlike(_LANGUAGE_TAG)
    raw = F.get(pieces, F.lit(3))
    # form decoding would turn '+' into a space, percent decoding must not
    decoded = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    term = F.trim(F.replace(decoded, F.lit("_"), F.lit(" ")))
    ok = known & (term != "")
    return F.when(ok, language), F.when(ok, term)


def letters_of(normalized: Column) -> Column:
    """ASCII a-z letters of a normalised term."""
    return F.regexp_replace(normalized, "[^a-z]", "")


def is_eligible(normalized: Column) -> Column:
    return normalized.rlike("^[a-z]+$")


def letter_signature(letters: Column) -> Column:
    return F.array_join(F.sort_array(F.split(letters, "")), "")


def is_palindrome(letters: Column) -> Column:
    return (F.length(letters) >= 2) & (letters == F.reverse(letters))


def lexical_affinity(a: Column, b: Column) -> Column:
    return a.startswith(b) | b.startswith(a)


def first_filled(*cols: Column) -> Column:
    """First value that is not blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols])


def filled(values: Column) -> Column:
    """Trimmed non-blank members of a string array."""
    return F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")


def joined_or_null(values: Column, separator: str) -> Column:
    return F.nullif(F.array_join(values, separator), F.lit(""))


def like_pattern(text: Column) -> Column:
    """``?`` and ``*`` to LIKE wildcards; literal ``%``, ``_`` and ``\\`` escaped."""
    escaped = F.regexp_replace(text, r"([%_\\])", r"\\$1")
    return F.translate(escaped, "?*", "_%")
