"""Content-based identifiers: equal content gives equal ids on every executor."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _text(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def hash60(*parts: Column | str) -> Column:
    """First 60 bits of SHA-256 over the tab-joined parts, as BIGINT."""
    joined = F.concat_ws("\t", *[_text(p).cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(joined, 256), 1, 15), 16, 10).cast("bigint")


#: Hexadecimal digits of a term's hash (15: 60 bits); fewer only to make hashes coincide in tests.
TERM_DIGITS = 15


def term_id(language: Column | str, normalized: Column | str, term: Column | str) -> Column:
    """Surrogate key of a term; no lookup join and no global numbering needed."""
    return F.shiftright(hash60(language, normalized, term), 4 * (15 - TERM_DIGITS))


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """``prefix:`` + 24 hex digits over the JSON of the parts (NULL kept distinct from '')."""
    named = F.struct(*[_text(p).alias(f"p{i}") for i, p in enumerate(parts)])
    body = F.to_json(named, {"ignoreNullFields": "false"})
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(body, 256), 1, 24))


def framed_row(*parts: Column | str) -> Column:
    """Row as one text from which its fields can be told: length and value, or - for NULL."""

    def framed(part: Column | str) -> Column:
        value = _text(part).cast("string")
        return F.coalesce(F.concat(F.char_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.concat(*[framed(p) for p in parts])


def summed_digest(row_text: Column) -> Column:
    """Order-independent digest of a row set: exact sum of per-row 60-bit hashes; NULL rows add nothing."""
    return F.sum(F.when(row_text.isNotNull(), hash60(row_text)).cast("decimal(28,0)")).cast("string")
