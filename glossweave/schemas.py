"""Table schemas, code maps and bounds of the word-graph model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

# --- fixed values: must equal the source model's codes -----------------------
RELATION_CODES = {
    "synonym": 1,
    "antonym": 2,
    "hypernym": 3,
    "hyponym": 4,
    "meronym": 5,
    "holonym": 6,
    "derived_from": 7,
    "etymologically_related": 8,
    "used_for": 9,
    "capable_of": 10,
    "at_location": 11,
    "related": 12,
}
INVERSE_PAIRS = {"hypernym": "hyponym", "meronym": "holonym"}
DIRECTION_CODES = {"outbound": 1, "inbound": 2, "symmetric": 3}
MAX_BUDGET = 100
MAX_TEXT_LENGTH = 256
MAX_CONTEXT_LENGTH = 512
RELATION_SCAN_FLOOR = 256
RELATION_SCAN_CEILING = 512
SPOONERISM_ALTERNATIVES = 8
SPOONERISM_RESOLVED_TERMS = 8
PUN_SENSE_FETCH = 8
ANN_MIN_CANDIDATES = 256
ANN_CANDIDATE_MULTIPLIER = 10
ANN_MAX_CANDIDATES = 500
# --- end of fixed values -----------------------------------------------------

PUBLIC_RELATIONS = tuple(name for name in RELATION_CODES if name != "synonym")


def inverse_relation(code: Column) -> Column:
    """Code of the same fact read from its target."""
    result = code
    for left, right in INVERSE_PAIRS.items():
        a, b = RELATION_CODES[left], RELATION_CODES[right]
        result = F.when(code == a, b).when(code == b, a).otherwise(result)
    return result.cast("int")


def inverse_direction(code: Column) -> Column:
    out, inb = DIRECTION_CODES["outbound"], DIRECTION_CODES["inbound"]
    return F.when(code == out, inb).when(code == inb, out).otherwise(code).cast("int")


def name_of(mapping: dict[str, int], code: Column) -> Column:
    """Name of a code column, as a literal map lookup (no join)."""
    pairs = [F.lit(x) for name, value in mapping.items() for x in (value, name)]
    return F.element_at(F.create_map(*pairs), code)


_TYPES = {
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "STRING": T.StringType(),
    "ARRAY<FLOAT>": T.ArrayType(T.FloatType()),
}


def _schema(text: str) -> T.StructType:
    """StructType of a column list; needs no session, unlike a DDL string."""
    pairs = [column.split() for column in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


TABLES: dict[str, T.StructType] = {
    "provenance": _schema(
        "provenance_id INT, source STRING, source_license STRING, source_url STRING"
    ),
    "terms": _schema("term_id BIGINT, term STRING, normalized_term STRING, language STRING"),
    "entries": _schema(
        "entry_id STRING, term_id BIGINT, part_of_speech STRING, etymology STRING,"
        " provenance_id INT"
    ),
    "senses": _schema("sense_id STRING, entry_id STRING, gloss STRING"),
    "examples": _schema("sense_id STRING, example STRING, position BIGINT"),
    "pronunciations": _schema("entry_id STRING, ipa STRING, region STRING, position BIGINT"),
    "translations": _schema(
        "sense_id STRING, target_term_id BIGINT, part_of_speech STRING, provenance_id INT,"
        " position BIGINT"
    ),
    "synonyms": _schema(
        "sense_id STRING, target_term_id BIGINT, part_of_speech STRING, provenance_id INT,"
        " position BIGINT"
    ),
    "relations": _schema(
        "source_term_id BIGINT, source_sense_id STRING, relation_code INT,"
        " target_term_id BIGINT, target_sense_id STRING, direction_code INT, provenance_id INT"
    ),
    "spoken": _schema("term_id BIGINT, phonemes STRING, rhyme_key STRING"),
    "vectors": _schema(
        "semantic_id BIGINT, concept STRING, term_id BIGINT, embedding ARRAY<FLOAT>"
    ),
}

#: Column that examples, pronunciations, translations and synonyms may have: the language of the
#: headword that a row belongs to. Such rows are dealt to languages without meeting their senses.
OWNER_LANGUAGE = "owner_language"
#: Column that senses, examples and pronunciations may have: the provenance of their entry. Such
#: rows are counted by provenance without meeting their parents.
OWNER_PROVENANCE = "owner_provenance"
#: Column that translations may have: the language of the headword that a row points to. Such rows
#: are counted by language without meeting their targets.
TOLD_LANGUAGE = "told_language"


class Corpus:
    """The tables of one corpus, each a DataFrame or a function that makes one.

    A function runs when its table is first used, so a query pays for its own tables
    only. A table the corpus lacks reads as None.
    """

    #: ``example_lines``(position, example) may hold the texts of examples by position, so that
    #: a line is stored once however many senses it illustrates. ``postings`` and ``gram_counts``
    #: may hold the index of spelling patterns. ``synset_members``(synset_id, sense_id, term_id,
    #: provenance_id; a row per sense) and ``synset_places``(synset_id, term_id, place) may hold
    #: synonyms as memberships, so that a synset's terms are stored once however many senses it has.
    NAMES = (
        *TABLES, "term_counts", "example_lines", "postings", "gram_counts", "synset_members", "synset_places",
    )

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]) -> None:
        unknown = set(tables) - set(self.NAMES)
        if unknown:
            raise ValueError(f"unknown tables {sorted(unknown)}")
        self._tables = dict(tables)

    def __getattr__(self, name: str) -> DataFrame | None:
        if name not in Corpus.NAMES:
            raise AttributeError(name)
        table = self._tables.get(name)
        if callable(table) and not isinstance(table, DataFrame):
            table = self._tables[name] = table()
        return table

    def has(self, name: str) -> bool:
        return name in self._tables

    def extended(self, **tables: DataFrame | Callable[[], DataFrame]) -> Corpus:
        """The same corpus with some tables added or replaced."""
        return Corpus(**{**self._tables, **tables})

    def without(self, *names: str) -> Corpus:
        """The same corpus as if it lacked some tables, which are then not made."""
        return Corpus(**{k: v for k, v in self._tables.items() if k not in names})


def assert_schema(df: DataFrame, table: str) -> DataFrame:
    """Refuse a table whose columns or types differ from the declared schema."""
    expected = {f.name: f.dataType for f in TABLES[table]}
    actual = {f.name: f.dataType for f in df.schema}
    if {k: v.simpleString() for k, v in actual.items()} != {
        k: v.simpleString() for k, v in expected.items()
    }:
        raise ValueError(f"{table}: expected {expected}, found {actual}")
    return df.select(*expected)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project and cast to the declared schema."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[table]])
