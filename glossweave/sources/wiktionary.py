"""Dictionary entries as JSON lines to corpus tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.ids import stable_id
from ..functions.text import filled, first_filled, joined_or_null, language_tag, lookup_key, strip
from ..operators.ranking import first_per
from ..schemas import DIRECTION_CODES, RELATION_CODES, conform
from ..session import written
from .common import WIKTIONARY, Built, allowed, table_counts, intern
from .interning import resolve
from .text import positioned, read_lines

_KINDS = ("translations", "synonyms", "antonyms")


def _objects(column: str) -> Column:
    return F.filter(F.col(column), lambda item: item.isNotNull())


def _unsensed(entry_id: Column) -> Column:
    return F.replace(stable_id("wikt", entry_id), F.lit("wikt:"), F.lit("wikt:unsensed:"))


# ----------------------------------------------------------- values of any shape
def _is(value: Column, kind: str) -> Column:
    return F.schema_of_variant(value).startswith(kind)


def _list(value: Column, name: str) -> Column:
    """Members of a list; null where the field is missing or is no list."""
    return F.try_variant_get(value, f"$.{name}", "array<variant>")


def _objects_of(value: Column, name: str) -> Column:
    return F.filter(_list(value, name), lambda x: _is(x, "OBJECT"))


def _strings_of(value: Column, name: str) -> Column:
    texts = F.filter(_list(value, name), lambda x: _is(x, "STRING"))
    return F.transform(texts, lambda x: F.try_variant_get(x, "$", "string"))


def _string(value: Column, name: str) -> Column:
    """A field that is a string; null where it is of another shape."""
    field = F.try_variant_get(value, f"$.{name}", "variant")
    return F.when(_is(field, "STRING"), F.try_variant_get(value, f"$.{name}", "string"))


def _scalar(value: Column, name: str) -> Column:
    """A field as text, numbers too; null for lists and objects."""
    field = F.try_variant_get(value, f"$.{name}", "variant")
    return F.when(~_is(field, "OBJECT") & ~_is(field, "ARRAY"), F.try_variant_get(value, f"$.{name}", "string"))


def _native_id(value: Column) -> Column:
    """The source's own id, from the first of its fields that is filled; a list of ids is put in order."""

    def one(name: str) -> Column:
        members = F.transform(_list(value, name), lambda x: F.try_variant_get(x, "$", "string"))
        listed = F.when(F.size(members) > 0, F.to_json(F.sort_array(members)))
        return F.coalesce(listed, F.nullif(_scalar(value, name), F.lit("")))

    return F.coalesce(*[one(name) for name in ("id", "senseid", "sense_id")])


def _item(value: Column) -> Column:
    return F.struct(
        *[_string(value, n).alias(n) for n in ("word", "term", "alt", "sense")],
        *[_scalar(value, n).alias(n) for n in ("code", "lang_code", "pos")],
    )


def _items(value: Column) -> list[Column]:
    return [F.transform(_objects_of(value, kind), _item).alias(kind) for kind in _KINDS]


def _sense(value: Column) -> Column:
    example = lambda x: F.struct(_string(x, "text").alias("text"), _string(x, "example").alias("example"))
    return F.struct(
        _native_id(value).alias("id"), _strings_of(value, "glosses").alias("glosses"),
        _strings_of(value, "raw_glosses").alias("raw_glosses"),
        F.transform(_objects_of(value, "examples"), example).alias("examples"), *_items(value),
    )


def _entry(value: Column) -> Column:
    """The fields in use, each taken in the shapes that it may have; members of other shapes are passed over."""
    sound = lambda x: F.struct(_string(x, "ipa").alias("ipa"), _strings_of(x, "tags").alias("tags"))
    return F.struct(
        *[_scalar(value, n).alias(n) for n in ("word", "lang_code", "language_code", "pos", "etymology_number")],
        _string(value, "etymology_text").alias("etymology_text"), _strings_of(value, "etymology_texts").alias("etymology_texts"),
        F.transform(_objects_of(value, "sounds"), sound).alias("sounds"),
        F.transform(_objects_of(value, "senses"), _sense).alias("senses"), *_items(value),
    )


def parse_entries(lines: DataFrame) -> DataFrame:
    """``lines``(line, file, block, at) parsed, with a ``valid`` mark: the line is a JSON object.

    Blank lines are no lines. An object that repeats a key is not valid.
    """
    parsed = lines.filter(F.trim("line") != "").withColumn("v", F.try_parse_json("line"))
    valid = F.coalesce(_is(F.col("v"), "OBJECT"), F.lit(False))
    return parsed.select("file", "block", "at", valid.alias("valid"), _entry(F.col("v")).alias("e"))


def build_wiktionary(spark: SparkSession, paths: str | list[str], languages: list[str] | None = None) -> Built:
    """Entries, native and labelled senses, and the links of each sense, from files of JSON lines."""
    return load_wiktionary(read_lines(spark, paths), languages)


def load_wiktionary(given: DataFrame, languages: list[str] | None = None) -> Built:
    """The same from ``given``(line, file, block, at); lines count in the order of file, block and at."""
    lines = written(parse_entries(given), "lines")
    placed = positioned(lines.filter("valid").drop("valid"))
    word = strip(F.col("e.word"))
    named = placed.withColumn("word", F.coalesce(word, F.lit("")))
    language = language_tag(first_filled(F.col("e.lang_code"), F.col("e.language_code")))
    etymology = F.coalesce(
        first_filled(F.col("e.etymology_text")), joined_or_null(filled(F.col("e.etymology_texts")), "\n\n")
    )
    entries = (
        named.filter(F.col("word") != "")
        .withColumn("language", language)
        .filter(allowed(F.col("language"), languages))
        .withColumn("pos", first_filled(F.col("e.pos")))
        .withColumn("etymology", etymology)
        .withColumn(
            "entry_id",
            stable_id("wikt:entry", "language", "word", "pos", F.col("e.etymology_number"), "etymology", "source_position"),
        )
    )
    base = ["entry_id", "word", "language", "pos"]
    native = entries.select(*base, F.posexplode(_objects("e.senses")).alias("position", "s")).withColumn(
        "sense_id",
        stable_id(
            "wikt:sense", "entry_id", "s.id", F.to_json(filled(F.col("s.glosses"))), "position",
        ),
    )
    gloss = F.coalesce(joined_or_null(filled(F.col("s.glosses")), "; "), joined_or_null(filled(F.col("s.raw_glosses")), "; "))

    # entry-level items: equal labels make one sense of their own, unlabelled ones one unsensed sense
    loose = None
    for kind in _KINDS:
        rows = entries.select(
            *base, F.lit(kind).alias("kind"), F.posexplode(_objects(f"e.{kind}")).alias("ord", "item")
        )
        loose = rows if loose is None else loose.unionByName(rows)
    label = F.when(F.trim("item.sense") != "", F.col("item.sense"))
    loose = loose.withColumn("label", label).withColumn(
        "sense_id",
        F.when(F.col("label").isNull(), _unsensed(F.col("entry_id"))).otherwise(
            stable_id("wikt:labeled", "entry_id", "label")
        ),
    )
    labelled = loose.filter("label IS NOT NULL").select("sense_id", "entry_id", F.col("label").alias("gloss")).distinct()
    described = native.select("entry_id").distinct().unionByName(labelled.select("entry_id")).distinct()
    unlabelled = loose.filter("label IS NULL").select("entry_id").distinct()
    bare = entries.select("entry_id").join(described, "entry_id", "left_anti").join(unlabelled, "entry_id", "left_anti")
    unsensed = unlabelled.unionByName(bare).select(
        _unsensed(F.col("entry_id")).alias("sense_id"), "entry_id", F.lit(None).cast("string").alias("gloss")
    )
    native_senses = native.select("sense_id", "entry_id", gloss.alias("gloss"))
    senses = native_senses.unionByName(labelled).unionByName(unsensed)

    items = loose.select(*base, "kind", "sense_id", "ord", "item")
    for kind in _KINDS:
        items = items.unionByName(
            native.select(
                *base, F.lit(kind).alias("kind"), "sense_id", F.posexplode(_objects(f"s.{kind}")).alias("ord", "item")
            )
        )
    links = _resolved(items, languages)
    terms, ids = resolve(
        intern(
            entries.select("language", F.col("word").alias("term")),
            links.filter("kind <> 'translations' OR target_language <> 'und'").select(
                F.col("target_language").alias("language"), F.col("target_term").alias("term")
            ),
        )
    )
    links = links.withColumn("target_term_id", ids.of(F.col("target_language"), F.col("target_term"), F.col("target_norm")))
    translations = _kept(links.filter("kind = 'translations' AND target_language <> 'und'"))
    synonyms = _kept(
        links.filter("kind = 'synonyms'").filter(F.col("target_norm") != lookup_key(F.col("word")))
    )
    opposed = first_per(
        links.filter("kind = 'antonyms'"), ["sense_id", "target_language", "target_norm"], ["ord"]
    )
    antonyms = opposed.select(
        ids.of(F.col("language"), F.col("word")).alias("source_term_id"),
        F.col("sense_id").alias("source_sense_id"), F.lit(RELATION_CODES["antonym"]).alias("relation_code"),
        "target_term_id", F.lit(None).alias("target_sense_id"),
        F.lit(DIRECTION_CODES["symmetric"]).alias("direction_code"), F.lit(WIKTIONARY).alias("provenance_id"),
    )
    examples = (
        native.select("sense_id", F.posexplode(_objects("s.examples")).alias("position", "x"))
        .withColumn("example", first_filled(F.col("x.text"), F.col("x.example")))
        .filter(F.col("example").isNotNull())
    )
    sounds = (
        entries.select("entry_id", F.posexplode(_objects("e.sounds")).alias("ord", "x"))
        .select(
            "entry_id", "ord", first_filled(F.col("x.ipa")).alias("ipa"),
            F.coalesce(F.array_join(filled(F.col("x.tags")), ", "), F.lit("")).alias("region"),
        )
        .filter(F.col("ipa").isNotNull())
    )
    tables = {
        "terms": terms,
        "entries": conform(
            entries.select(
                "entry_id", ids.of(F.col("language"), F.col("word")).alias("term_id"),
                F.col("pos").alias("part_of_speech"), "etymology", F.lit(WIKTIONARY).alias("provenance_id"),
            ),
            "entries",
        ),
        "senses": conform(senses, "senses"),
        "examples": conform(examples, "examples"),
        "pronunciations": conform(
            _numbered(first_per(sounds, ["entry_id", "ipa", "region"], ["ord"]), "entry_id"), "pronunciations"
        ),
        "translations": conform(translations, "translations"),
        "synonyms": conform(synonyms, "synonyms"),
        "relations": conform(antonyms, "relations").dropDuplicates(),
    }
    nothing = named.filter(F.col("word") == "")
    counters = table_counts(
        unsensed_senses=unsensed, labeled_senses=labelled, missing_word=nothing,
        malformed_lines=(lines, F.count(F.when(~F.col("valid"), 1))),
        language_codes=(entries, F.countDistinct(F.when(F.col("language") != "und", F.col("language")))),
        **{k: v for k, v in tables.items() if k not in ("terms", "relations")},
        antonyms=tables["relations"],
    )
    return Built(tables, counters, ids)


def _resolved(items: DataFrame, languages: list[str] | None) -> DataFrame:
    """Target term and language of each list item; unnamed items drop out."""
    own = F.col("language")
    target_language = F.when(
        F.col("kind") == "translations", language_tag(first_filled(F.col("item.code"), F.col("item.lang_code")))
    ).otherwise(language_tag(F.col("item.lang_code"), own))
    named = items.select(
        "kind", "sense_id", "ord", "word", "language", "pos", F.col("item.pos").alias("item_pos"),
        first_filled(F.col("item.word"), F.col("item.term"), F.col("item.alt")).alias("target_term"),
        target_language.alias("target_language"),
    )
    return (
        named.filter(F.col("target_term").isNotNull() & allowed(F.col("target_language"), languages))
        .withColumn("target_norm", lookup_key(F.col("target_term")))
    )


def _kept(links: DataFrame) -> DataFrame:
    """First mention per (sense, language, normalised term); positions count kept ones only."""
    unique = first_per(links, ["sense_id", "target_language", "target_norm"], ["ord"])
    part_of_speech = F.when(
        F.col("kind") == "translations", first_filled(F.col("item_pos"), F.col("pos"))
    ).otherwise(F.col("pos"))
    return _numbered(unique, "sense_id").select(
        "sense_id", "target_term_id", part_of_speech.alias("part_of_speech"),
        F.lit(WIKTIONARY).alias("provenance_id"), "position",
    )


def _numbered(rows: DataFrame, parent: str) -> DataFrame:
    """0-based position within one entry's or sense's list (the list of one input line)."""
    return rows.withColumn(
        "position", (F.row_number().over(Window.partitionBy(parent).orderBy("ord")) - 1).cast("bigint")
    )
