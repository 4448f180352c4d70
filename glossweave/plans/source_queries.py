"""The loaders over source lines that Spark makes of the benchmark tables, with rejects of every kind."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..session import shared_folder
from ..sources.cmudict import load_cmudict
from ..sources.common import Built, refresh_source
from ..sources.conceptnet import load_conceptnet
from ..sources.ordered import changed_sources, ordered_digest
from ..sources.vectors import load_vectors
from ..sources.wiktionary import load_wiktionary
from ..sources.wordnet import load_wordnet
from . import driver_tables as tables
from .catalogue import query

_VECTOR_LANGUAGES = [f"l{n}" for n in range(9)]


def assertion_lines(spark, folder) -> DataFrame:
    """Who supplies what, as tab-separated assertions; some repeated, shortened or worthless."""
    pairs = tables.read(spark, folder, "lineitem").select("l_partkey", "l_suppkey").distinct()
    # repeated by the row, so that the line items are read and made distinct once
    pairs = pairs.withColumn("time", F.explode(F.expr("IF(l_partkey % 3 = 0, array(1, 2), array(1))"))).drop("time")
    part, supplier = tables.read(spark, folder, "part"), tables.read(spark, folder, "supplier")
    named = pairs.join(part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey").join(
        supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey"
    )
    return named.selectExpr(
        """CASE WHEN (l_partkey + l_suppkey) % 29 = 0 THEN concat('/a/', l_partkey, '\t/r/AtLocation') ELSE concat_ws('\t',
          concat('/a/', l_partkey, '/', l_suppkey),
          concat('/r/', CASE l_partkey % 7 WHEN 0 THEN 'IsA' WHEN 1 THEN 'PartOf' WHEN 2 THEN 'HasContext' WHEN 3 THEN 'SimilarTo' ELSE 'AtLocation' END),
          concat('/c/', CASE WHEN l_suppkey % 11 = 0 THEN 'und' ELSE 'en' END, '/', replace(p_name, ' ', '_'), '/n'),
          concat('/c/', CASE WHEN l_suppkey % 3 = 0 THEN 'fr' ELSE 'EN' END, '/', replace(s_name, '#', '%23')),
          CASE l_partkey % 5 WHEN 0 THEN '{"weight": 0}' WHEN 1 THEN 'not json' WHEN 2 THEN '{"weight": -1.5}' ELSE '{"weight": 2.0}' END
        ) END AS line"""
    )


def _assertions(spark, folder) -> Built:
    return load_conceptnet(assertion_lines(spark, folder))


@query
def loaded_assertions(spark, folder):
    """Relations of the assertions with the terms that their ids resolve to."""
    built = _assertions(spark, folder)
    terms = built.tables["terms"].select("term_id", "language", "term")
    ends = built.tables["relations"].join(
        terms.toDF("source_term_id", "source_language", "source_term"), "source_term_id"
    ).join(terms.toDF("target_term_id", "target_language", "target_term"), "target_term_id")
    return ends.select(
        "source_language", "source_term", "relation_code", "target_language", "target_term", "direction_code",
        "provenance_id",
    )


@query
def loaded_assertion_counts(spark, folder):
    return _assertions(spark, folder).counters


def spoken_lines(spark, folder) -> DataFrame:
    """The spoken words as dictionary lines: variants, remarks, small letters and words without sounds."""
    corpus = tables.word_corpus(spark, folder)
    words = tables.spoken(corpus.terms).join(corpus.terms.select("term_id", "term"), "term_id")
    return words.selectExpr(
        """CASE WHEN length(term) % 7 = 0 THEN concat(';;; ', term, ' ', phonemes) WHEN term LIKE 'q%' THEN term
          ELSE concat(term, CASE WHEN length(term) % 5 = 0 THEN '(2)' ELSE '' END, '  ',
            CASE WHEN length(term) % 3 = 0 THEN lower(phonemes) ELSE phonemes END) END AS line"""
    )


@query
def loaded_pronunciations(spark, folder):
    built = load_cmudict(spoken_lines(spark, folder))
    return built.tables["spoken"].join(built.tables["terms"], "term_id").select(
        "language", "term", "normalized_term", "phonemes", "rhyme_key"
    )


@query
def loaded_pronunciation_counts(spark, folder):
    return load_cmudict(spoken_lines(spark, folder)).counters


def vector_lines(spark, folder) -> DataFrame:
    """The embeddings as vector text with their places; some repeated, short or not finite."""
    rows = tables.read(spark, folder, "embeddings")
    header = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).selectExpr(
        "concat(n + n DIV 19 + 1, ' ', d) AS line", "-1L AS at"
    )
    body = rows.selectExpr(
        "vec_id", "concat('/c/l', label, '/v_', vec_id) AS concept",
        """CASE WHEN vec_id % 13 = 0 THEN transform(embedding, (x, i) -> IF(i = 0, CAST('NaN' AS FLOAT), x))
             WHEN vec_id % 17 = 0 THEN slice(embedding, 1, 3) ELSE embedding END AS v""",
    )
    lines = body.selectExpr("concat(concept, ' ', array_join(CAST(v AS ARRAY<STRING>), ' ')) AS line", "vec_id * 2 AS at")
    again = body.filter("vec_id % 19 = 0").selectExpr(
        "concat(concept, ' ', array_join(CAST(reverse(v) AS ARRAY<STRING>), ' ')) AS line", "vec_id * 2 + 1 AS at"
    )
    return header.union(lines).union(again).select("line", F.lit("vectors").alias("file"), F.lit(0).cast("long").alias("block"), "at")


@query
def loaded_vectors(spark, folder):
    """Unit vectors in file order: their dense ids, terms and first and last components."""
    built = load_vectors(vector_lines(spark, folder), _VECTOR_LANGUAGES)
    return built.tables["vectors"].join(built.tables["terms"], "term_id").select(
        "semantic_id", "concept", "language", "term",
        F.round(F.element_at("embedding", 1).cast("double"), 4).alias("first"),
        F.round(F.element_at("embedding", -1).cast("double"), 4).alias("last"),
    )


@query
def loaded_vector_counts(spark, folder):
    return load_vectors(vector_lines(spark, folder), _VECTOR_LANGUAGES).counters


def thesaurus_elements(spark, folder) -> DataFrame:
    """The parts as a thesaurus in XML, one element a row: a synset per type and size, an entry per part.

    Among them elements cut short, without an id, without a word, with senses without an id
    or a known synset, relations of unknown kinds and to nowhere.
    """
    parts = tables.read_spread(spark, folder, "part", "p_partkey", "p_name", "p_type", "p_size")
    names = parts.withColumn(
        "synset", F.concat(F.lit("syn-"), F.replace("p_type", F.lit(" "), F.lit("_")), F.lit("-"), F.col("p_size").cast("string"))
    )
    synsets = names.select("p_type", "p_size", "synset").distinct().selectExpr(
        """CASE WHEN p_size % 11 = 0 THEN concat('<Synset id="', synset, '"><Definition>cut short')
          ELSE concat('<Synset', IF(p_size % 13 = 0, '', concat(' id="', synset, '"')), ' partOfSpeech="n">',
            '<Definition> ', p_type, '  of size ', p_size, ' </Definition>',
            IF(p_size % 4 = 0, '<Definition>a second one</Definition><Definition> </Definition>', ''),
            IF(p_size % 3 = 0, concat('<Example>', lower(p_type), ' first</Example><Example/><Example>second</Example>'), ''),
            '<SynsetRelation relType="hypernym" target="syn-', replace(p_type, ' ', '_'), '-', p_size + 1, '"/>',
            '<SynsetRelation relType="unheard_of" target="', synset, '"/></Synset>') END AS element"""
    )
    entries = names.selectExpr(
        """CASE WHEN p_partkey % 29 = 0 THEN concat('<LexicalEntry id="e', p_partkey, '"><Lemma writtenForm="', p_name)
          ELSE concat('<LexicalEntry id="e', p_partkey, '">',
            IF(p_partkey % 31 = 0, '', concat('<Lemma writtenForm="', p_name, '"', IF(p_partkey % 2 = 0, ' partOfSpeech="n"', ''), '/>')),
            IF(p_partkey % 5 = 0, '<Pronunciation variety="GB"> saʊnd </Pronunciation><Pronunciation/>', ''),
            '<Sense', IF(p_partkey % 37 = 0, '', concat(' id="s', p_partkey, '"')),
            ' synset="', IF(p_partkey % 41 = 0, 'syn-none', synset), '">',
            IF(p_partkey % 7 = 0, concat('<Definition>own ', p_partkey, '</Definition>'), ''),
            '<SenseRelation relType="derivation" target="s', p_partkey + 1, '"/>',
            '<SenseRelation relType="Antonym" target="s', p_partkey - 2, '"/></Sense></LexicalEntry>') END AS element"""
    )
    return synsets.union(entries)


def _thesaurus(spark, folder) -> Built:
    return load_wordnet(thesaurus_elements(spark, folder))


@query
def loaded_synsets(spark, folder):
    """Senses of the thesaurus with their words, glosses and examples."""
    built = _thesaurus(spark, folder).tables
    examples = built["examples"].groupBy("sense_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "example"))), lambda x: x["example"]), "|").alias("examples")
    )
    entries = built["entries"].join(built["terms"].select("term_id", "term"), "term_id")
    return built["senses"].join(entries, "entry_id").join(examples, "sense_id", "left").select(
        "sense_id", "entry_id", "term", "part_of_speech", "gloss", F.coalesce("examples", F.lit("")).alias("examples")
    )


@query
def loaded_sense_relations(spark, folder):
    """Relations between all members of related synsets, and between related senses."""
    return _thesaurus(spark, folder).named_relations.select(
        "source_term", "source_sense_id", "relation_code", "target_term", "target_sense_id", "direction_code"
    )


@query
def loaded_wordnet_synonyms(spark, folder):
    built = _thesaurus(spark, folder).tables
    return built["synonyms"].select("sense_id", "target_term_id", "part_of_speech", "position")


@query
def loaded_wordnet_counts(spark, folder):
    return _thesaurus(spark, folder).counters


def dictionary_lines(spark, folder) -> DataFrame:
    """The parts as dictionary entries in JSON lines of three files, with fields of every shape.

    Among them lines cut short, blank ones, JSON that is no object, and objects without a word.
    """
    parts = tables.read_spread(spark, folder, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return parts.selectExpr(
        r"""CASE WHEN p_partkey % 29 = 0 THEN concat('{"word": "', p_name, '", "senses": [')
          WHEN p_partkey % 31 = 0 THEN '[1, 2]' WHEN p_partkey % 43 = 0 THEN '"only text"' WHEN p_partkey % 41 = 0 THEN '   '
          ELSE concat('{"word": "', IF(p_partkey % 37 = 0, '  ', concat(' ', p_name)), '"',
            CASE p_partkey % 9 WHEN 0 THEN ', "lang_code": "FR"' WHEN 1 THEN ', "language_code": "de"' WHEN 2 THEN ', "lang_code": ["en"]' ELSE ', "lang_code": "en"' END,
            IF(p_partkey % 2 = 0, ', "pos": "noun"', ''), IF(p_partkey % 3 = 0, concat(', "etymology_number": ', p_partkey % 5), ''),
            CASE p_partkey % 4 WHEN 0 THEN concat(', "etymology_text": " from ', p_type, '"')
              WHEN 1 THEN ', "etymology_text": 5, "etymology_texts": [" one ", 5, "", "two"]' ELSE '' END,
            IF(p_partkey % 5 = 0, ', "sounds": [{"ipa": "/p/", "tags": ["UK", 1, " old "]}, {"ipa": "/p/", "tags": ["UK", "old"]}, "none", {"ipa": 7}, {"ipa": " /q/ "}]', ''),
            IF(p_partkey % 6 = 0, ', "senses": "none"', concat(', "senses": [{"id": ', CASE p_partkey % 3 WHEN 0 THEN '["b", "a"]' WHEN 1 THEN '"s1"' ELSE '7' END,
              ', "glosses": [" g', p_partkey, ' ", 3], "examples": [{"text": " ex "}, "no", {"example": "ex2"}, {"text": 4}],',
              ' "synonyms": [{"word": "', p_brand, '"}, {"word": "', p_name, '"}, {"term": "', upper(p_brand), '", "pos": "x"}, {"alt": " "}, {"alt": "a', p_size, '"}],',
              ' "translations": [{"word": "mot ', p_size, '", "code": "fr"}, {"word": "lost"}, "x", {"word": "mot ', p_size, '", "lang_code": "fr"}]},',
              ' "no sense", {"raw_glosses": ["raw"], "glosses": "text"}]')),
            IF(p_partkey % 7 = 0, ', "translations": [{"word": "wort", "code": "de", "sense": "label"}, {"word": "wort", "code": "de"}, 12]', ''),
            IF(p_partkey % 8 = 0, concat(', "antonyms": [{"word": "not ', p_brand, '", "sense": "label"}, {"word": "not ', p_brand, '", "sense": " "}]'), ''),
            IF(p_partkey % 10 = 0, ', "synonyms": {"word": "one"}', ''), '}') END AS line""",
        "concat('part-', p_partkey % 3, '.jsonl') AS file", "0L AS block", "p_partkey AS at",
    )


def _dictionary(spark, folder) -> Built:
    return load_wiktionary(dictionary_lines(spark, folder))


@query
def loaded_dictionary_entries(spark, folder):
    """Entries with their ids, which hold the place of the line over all files, and how they sound."""
    built = _dictionary(spark, folder).tables
    sounds = built["pronunciations"].groupBy("entry_id").agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("position", "ipa", "region"))), lambda x: F.concat(x["ipa"], F.lit(" "), x["region"])
        ), "|").alias("sounds")
    )
    terms = built["terms"].select("term_id", "language", "term")
    return built["entries"].join(terms, "term_id").join(sounds, "entry_id", "left").select(
        "entry_id", "language", "term", "part_of_speech", "etymology", F.coalesce("sounds", F.lit("")).alias("sounds")
    )


@query
def loaded_dictionary_senses(spark, folder):
    """Native, labelled and unsensed senses with their examples."""
    built = _dictionary(spark, folder).tables
    examples = built["examples"].groupBy("sense_id").agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("position", "example"))),
            lambda x: F.concat(x["position"].cast("string"), F.lit(" "), x["example"]),
        ), "|").alias("examples")
    )
    return built["senses"].join(examples, "sense_id", "left").select(
        "sense_id", "entry_id", "gloss", F.coalesce("examples", F.lit("")).alias("examples")
    )


@query
def loaded_dictionary_links(spark, folder):
    """Synonyms, translations and antonyms of every sense with the terms they name."""
    built = _dictionary(spark, folder).tables
    terms = built["terms"].select(F.col("term_id").alias("target_term_id"), "language", "term")
    links = None
    for kind in ("synonyms", "translations"):
        rows = built[kind].select(F.lit(kind).alias("kind"), "sense_id", "target_term_id", "part_of_speech", "position")
        links = rows if links is None else links.unionByName(rows)
    none = {"part_of_speech": F.lit(None).cast("string"), "position": F.lit(None).cast("long")}
    opposed = built["relations"].select(
        F.lit("antonyms").alias("kind"), F.col("source_sense_id").alias("sense_id"), "target_term_id"
    ).withColumns(none)
    return links.unionByName(opposed).join(terms, "target_term_id").drop("target_term_id")


@query
def loaded_dictionary_counts(spark, folder):
    return _dictionary(spark, folder).counters


def _document_rows(spark, folder) -> DataFrame:
    """The documents as rows of files, one per source, in the order of their ids."""
    return tables.read(spark, folder, "documents").select(
        "lang", F.col("source").alias("file"), F.lit(0).alias("block"), F.col("doc_id").alias("at"), "text"
    )


@query
def ordered_digests(spark, folder):
    """Per language: a digest of the documents that depends on their order."""
    return ordered_digest(_document_rows(spark, folder), F.col("text"), F.col("lang"))


@query
def changed_orders(spark, folder):
    """Which languages' digests notice that French documents changed places within their files."""
    rows = _document_rows(spark, folder)
    swapped = rows.withColumn("at", F.when(F.col("lang") == "fr", F.col("at").bitwiseXOR(F.lit(64))).otherwise(F.col("at")))
    before, after = (ordered_digest(r, F.col("text"), F.col("lang")) for r in (rows, swapped))
    return changed_sources(before, after).select("source", "rows_before", "rows_after")


@query
def refreshed_source(spark, folder):
    """The relations as files by source, one source written twice more with other directions, read back."""
    path = f"{shared_folder(spark)}/refreshed-{uuid.uuid4().hex}"
    relations = tables.graph_corpus(spark, folder).relations
    refresh_source(relations, path)
    changed = relations.filter("provenance_id = 2").withColumn("direction_code", F.lit(3))
    for _ in range(2):
        refresh_source(changed, path)
    return spark.read.schema(relations.schema).parquet(path).groupBy("provenance_id", "relation_code", "direction_code").agg(
        F.count(F.lit(1)).alias("rows")
    )
