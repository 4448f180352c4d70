"""Secret scans: keyword prefilter, anchored expressions near hits, embedded checksums.

One Aho-Corasick automaton over all keywords runs through each case-folded text. Only where
a keyword ends is an expression tried, anchored at the keyword. Runs of hexadecimal digits
have no keyword of their own; with every hexadecimal digit mapped to one letter, their
keyword is that letter repeated, and a substring search is its automaton. Tokens that carry
a checksum (base-62 CRC-32, Luhn, mod 97) count only if it holds.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import arrow_map

ASSIGN, ACCESS, HEX = "assign", "access", "hex"
BASE_KINDS = (ASSIGN, ACCESS, HEX)
#: Kinds that the method adds, each with an embedded checksum.
ADDED_KINDS = ("github", "npm", "card", "iban")
KINDS = BASE_KINDS + ADDED_KINDS

# fixed values: what a span of each kind looks like, anchored where its keyword stands
_ASSIGN = re.compile(
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_NPM = re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_DIGITS = re.compile(r"[0-9]+")
_JOINED = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
_LETTER = re.compile(r"[A-Za-z]")
_COUNTRY = re.compile(r"[A-Z]{2}[0-9]{2}")
_CARD_LENGTHS = range(13, 20)
_REACH = 24  # characters outside tried numbers, between a keyword and a number of its own
# fixed values: characters of an IBAN by country
_IBAN_LENGTHS = {
    country: size
    for size, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
_IBAN_ANY = range(35, 11, -1)  # for a country that is not listed
_WORDS = {
    "password": ASSIGN, "passwd": ASSIGN, "secret": ASSIGN, "token": ASSIGN, "apikey": ASSIGN, "api_key": ASSIGN,
    "akia": ACCESS, "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm", "card": "card", "visa": "card", "iban": "iban",
}
_LEAST = {ASSIGN: 6, ACCESS: 20, HEX: 24}
_DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ONE_LETTER = bytes(ord("h") if chr(b) in "0123456789abcdef" else ord(".") for b in range(256))


@cache
def _automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for word, kind in _WORDS.items():
        automaton.add_word(word, (kind, len(word)))
    automaton.make_automaton()
    return automaton


def base62_crc_holds(token: str) -> bool:
    """The last six characters are the CRC-32 of those between them and the prefix, in base 62."""
    body, check = token[token.index("_") + 1 : -6], token[-6:]
    value, spelled = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        spelled = _DIGITS62[digit] + spelled
    return spelled == check


def luhn_holds(number: str) -> bool:
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def iban_holds(number: str) -> bool:
    plain = number.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


@cache
def _iban(size: int) -> re.Pattern:
    """Groups of four and a rest, ``size`` characters in all, each group after a blank or none."""
    groups, rest = divmod(size - 4, 4)
    tail = f" ?[A-Z0-9]{{{rest}}}" if rest else ""
    return re.compile(rf"[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}{tail}(?![A-Za-z0-9])")


def _line(text: str, at: int) -> int:
    end = text.find("\n", at)
    return len(text) if end < 0 else end


def _card_near(text: str, at: int, taken: int) -> tuple[int, int] | None:
    """The first card number after a keyword that ends at ``at``; of several lengths the longest valid one.

    Each group of digits is tried as the start, and the end of each group that one blank or
    hyphen joins to it as the end. Digits that go on from a letter, as those of an IBAN do, are
    tried only right after the keyword.
    """
    first, last, reach = True, _line(text, at), _REACH
    while group := _DIGITS.search(text, at, min(last, at + reach + 1)):
        start = group.start()
        reach -= start - at
        if not first and _LETTER.match(text, start - 1):
            at = _JOINED.match(text, start).end()
            continue
        first = False
        end = at = _DIGITS.match(text, start).end()
        if start < taken:
            continue
        size, valid = end - start, None
        while size <= _CARD_LENGTHS[-1]:
            if size in _CARD_LENGTHS and luhn_holds(text[start:end]):
                valid = start, end
            more = _DIGITS.match(text, end + 1) if text[end : end + 1] in (" ", "-") else None
            if not more:
                break
            size, end = size + more.end() - more.start(), more.end()
        if valid:
            return valid
    return None


def _iban_near(text: str, at: int, taken: int) -> tuple[int, int] | None:
    """The first IBAN after a keyword that ends at ``at``, of the length that its country has."""
    first, last, reach = at, _line(text, at), _REACH
    while head := _COUNTRY.search(text, at, min(last, at + reach + 4)):
        start = head.start()
        reach -= start - at
        at = start + 4
        if start < taken or (start > first and re.match("[A-Z0-9]", text[start - 1])):
            continue
        known = _IBAN_LENGTHS.get(head[0][:2])
        for size in [known] if known else _IBAN_ANY:
            found = _iban(size).match(text, start)
            if found and iban_holds(found[0]):
                return start, found.end()
            if found and known:
                at = found.end()
    return None


def _forward(raw: bytes, plain: bool) -> Callable[[int], int]:
    """Turns byte positions, asked in ascending order, into code points."""
    place = known = 0

    def points(byte: int) -> int:
        nonlocal place, known
        known += byte - place if plain else len(raw[place:byte].decode("utf-8", "surrogatepass"))
        place = byte
        return known

    return points


def find_secrets(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans by start, then kind as listed; code points, end exclusive."""
    raw = text.encode("utf-8", "surrogatepass")
    folded = raw.translate(_FOLD).decode("latin-1")
    spans: list[tuple[int, int, str]] = []
    taken = dict.fromkeys(KINDS, -1)
    points = _forward(raw, len(raw) == len(text))
    for byte, kind in sorted({(end - size + 1, kind) for end, (kind, size) in _automaton().iter(folded)}):
        start = points(byte)
        if start < taken[kind]:
            continue
        if kind in (ASSIGN, ACCESS):
            found = (_ASSIGN if kind == ASSIGN else _ACCESS).match(text, start)
            if found:  # a match that fails the length still takes its characters
                taken[kind] = found.end()
                if len(found[2] if kind == ASSIGN else found[0]) >= _LEAST[kind]:
                    spans.append((start, found.end(), kind))
        elif kind in ("github", "npm"):
            found = (_GITHUB if kind == "github" else _NPM).match(text, start)
            if found and base62_crc_holds(found[0]):
                taken[kind] = found.end()
                spans.append((start, found.end(), kind))
        else:
            found = (_card_near if kind == "card" else _iban_near)(text, start + 4, taken[kind])
            if found:
                taken[kind] = found[1]
                spans.append((*found, kind))
    run = b"h" * _LEAST[HEX]
    letters = raw.translate(_ONE_LETTER)
    points = _forward(raw, len(raw) == len(text))
    byte = letters.find(run)
    while byte >= 0:
        start = points(byte)
        found = _HEX.match(text, start)
        spans.append((start, found.end(), HEX))
        byte = letters.find(run, byte + found.end() - start)
    order = {kind: k for k, kind in enumerate(KINDS)}
    return sorted(set(spans), key=lambda s: (s[0], order[s[2]], s[1]))


def _spelled(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


_SCAN = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_assign", T.LongType(), False),
        T.StructField("n_access", T.LongType(), False),
        T.StructField("n_hex", T.LongType(), False),
        T.StructField("base_sha256", T.StringType(), False),
        T.StructField("spans", T.StringType(), False),
    ]
)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [find_secrets(text or "") for text in batch.column(1).to_pylist()]
        base = [[s for s in spans if s[2] in BASE_KINDS] for spans in found]
        counts = [pa.array([sum(s[2] == kind for s in spans) for spans in base], pa.int64()) for kind in BASE_KINDS]
        digests = [hashlib.sha256(_spelled(spans).encode()).hexdigest() for spans in base]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *counts, pa.array(digests, pa.string()), pa.array([_spelled(s) for s in found], pa.string())],
            names=_SCAN.names,
        )


def scan_documents(docs: DataFrame) -> DataFrame:
    """Spans of secrets of every row of ``docs(doc_id, text)``.

    Null text counts as empty and has no spans; each row is scanned by itself, so repeated
    rows and ties need no rule; other columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(arrow_map, _scanned, _SCAN)


def _masked(text: str, marker: str) -> str:
    parts, at = [], 0
    for start, end, _ in find_secrets(text):
        if end > at:
            parts += [text[at : max(start, at)], marker if start >= at else ""]
            at = end
    return "".join([*parts, text[at:]])


def mask_documents(docs: DataFrame, marker: str = "[secret]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``marker`` and ``n_chars``, if there, counted anew.

    No row is dropped; rows without secrets and null texts stay as they are. Spans that
    overlap are masked as one.
    """
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else _masked(t, marker) for t in batch.column(place).to_pylist()]
            columns = [*batch.columns]
            columns[place] = pa.array(texts, batch.column(place).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    masked = docs.transform(arrow_map, run, docs.schema)
    if "n_chars" not in docs.columns:
        return masked
    length = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text"))
    return masked.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
