"""Named queries over the benchmark tables, one or more per operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.ids import framed_row
from ..functions.phonetics import onset, remainder
from ..functions.text import language_tag, lookup_key
from ..operators import graph, lookup, patterns, sets, vector_index, vectors, wordplay
from ..operators.ranking import nearest_rank
from ..operators.requests import validate
from ..schemas import RELATION_CODES, Corpus
from ..session import shared_folder, stored_table, written
from . import driver_tables as tables
from . import bucketed, drilldown, layout, quality

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# partition thresholds scaled to the benchmark's size
_ALONE_BYTES = 300_000
_BUNDLE_BYTES = 500_000
# the benchmark's embeddings point in all directions alike: their cells say little about them
_VISITED = 0.9


def query(function: Query) -> Query:
    """Register under the function's name; integers are returned as BIGINT."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _widened(function(spark, folder))

    REGISTRY[function.__name__] = run
    return function


def _widened(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.col(f.name).cast("bigint").alias(f.name)
            if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType))
            else F.col(f.name)
            for f in df.schema
        ]
    )


def _text(values: Column) -> Column:
    """Array as one string, so that results stay flat."""
    return F.array_join(values.cast("array<string>"), ",")


# ------------------------------------------------------------------ terms and keys
@query
def intern_terms(spark, folder):
    return tables.word_corpus(spark, folder).terms


@query
def language_tags(spark, folder):
    """Stored language tags of every label-like string in the tables."""
    raw = (
        tables.read(spark, folder, "documents").select(F.col("lang").alias("raw"))
        .union(tables.read(spark, folder, "documents").select(F.concat_ws("_", F.upper("lang"), "source")))
        .union(tables.read(spark, folder, "nation").select("n_name"))
        .union(tables.read(spark, folder, "region").select("r_name"))
        .union(tables.read(spark, folder, "orders").select("o_orderpriority"))
        .distinct()
    )
    return raw.select("raw", language_tag(F.col("raw")).alias("tag"))


@query
def wordplay_index(spark, folder):
    return wordplay.letter_index(tables.word_corpus(spark, folder).terms)


@query
def spoken_keys(spark, folder):
    corpus = tables.word_corpus(spark, folder)
    return wordplay.spoken_terms(corpus).select(
        "term", "phonemes", "rhyme_key", onset(F.col("phonemes")).alias("onset"),
        remainder(F.col("phonemes")).alias("remainder"),
    )


@query
def allowed_relations(spark, folder):
    """Relations whose both ends are in an allowed language."""
    corpus = tables.word_corpus(spark, folder)
    allowed = corpus.terms.filter(F.col("language").isin("en", "fr"))
    ends = corpus.relations.join(
        allowed.select(F.col("term_id").alias("source_term_id"), F.col("term").alias("source_term")), "source_term_id"
    ).join(
        allowed.select(F.col("term_id").alias("target_term_id"), F.col("term").alias("target_term")), "target_term_id"
    )
    return ends.select("source_term", "target_term", "relation_code", "direction_code", "provenance_id")


@query
def request_rejects(spark, folder):
    """Why rows of the documents, read as lookup requests, would be refused."""
    documents = tables.read(spark, folder, "documents")
    asked = documents.select(
        F.col("doc_id").alias("request_id"), F.col("text").alias("word"), F.col("lang").alias("language"),
        F.col("n_chars").cast("int").alias("limit"),
    )
    _, rejects = validate(asked, texts=["word"], languages=["language"], limits=["limit"])
    return rejects


# ------------------------------------------------------------------------ wordplay
@query
def anagram_groups(spark, folder):
    return wordplay.anagram_groups(tables.word_corpus(spark, folder).terms)


@query
def anagrams(spark, folder):
    corpus = tables.word_corpus(spark, folder)
    found = wordplay.anagrams(corpus, tables.english_words(corpus), tables.SPOKEN, already_distinct=True)
    return found.withColumn("provenance", _text(F.col("provenance")))


@query
def palindromes(spark, folder):
    corpus = tables.word_corpus(spark, folder)
    found = wordplay.palindromes(corpus, tables.english_words(corpus), tables.SPOKEN, already_distinct=True)
    return found.withColumn("provenance", _text(F.col("provenance")))


@query
def rhymes_exact(spark, folder):
    corpus = tables.word_corpus(spark, folder)
    return wordplay.rhymes(corpus, tables.english_words(corpus), already_distinct=True)


@query
def rhymes_near(spark, folder):
    corpus = tables.word_corpus(spark, folder)
    return wordplay.near_rhymes(corpus, tables.english_words(corpus), already_distinct=True)


@query
def sounds_like(spark, folder):
    corpus = tables.word_corpus(spark, folder)
    return wordplay.sounds_like(corpus, tables.english_words(corpus), already_distinct=True)


@query
def prefix_match(spark, folder):
    corpus = tables.word_corpus(spark, folder)
    words = tables.benchmark_words(spark, folder).select(F.col("word").alias("text"))
    return wordplay.prefixed(corpus, words.withColumn("request_id", F.col("text")), already_distinct=True)


@query
def spelled_like(spark, folder):
    """Three patterns out of each benchmark word: open middle, any first letter, inner run."""
    corpus = tables.word_corpus(spark, folder)
    word = F.col("word")
    patterns = F.array(
        F.concat(F.substring(word, 1, 2), F.lit("*"), F.right(word, F.lit(1))),
        F.concat(F.lit("?"), F.substring(word, 2, 256)),
        F.concat(F.lit("*"), F.substring(word, 2, 3), F.lit("*")),
    )
    asked = tables.benchmark_words(spark, folder).select(F.explode(patterns).alias("text")).distinct()
    return wordplay.spelled_like(corpus, asked.withColumn("request_id", F.col("text")), already_distinct=True)


@query
def search_modes(spark, folder):
    """Each benchmark word searched in all five modes, by one table of requests."""
    word = F.col("word")
    modes = F.array(
        *[F.struct(F.lit(m).alias("mode"), word.alias("text")) for m in wordplay.SEARCH_MODES if m != "spelled_like"],
        F.struct(F.lit("spelled_like").alias("mode"), F.concat(F.substring(word, 1, 2), F.lit("*")).alias("text")),
    )
    asked = tables.benchmark_words(spark, folder).select(F.inline(modes)).distinct()
    asked = asked.withColumn("request_id", F.concat_ws("/", "mode", "text"))
    return wordplay.search(tables.word_corpus(spark, folder), asked, already_distinct=True)


def _open_patterns(spark, folder) -> DataFrame:
    """Patterns whose letters many headwords share, and the widest of all."""
    word = F.col("word")
    few = tables.benchmark_words(spark, folder).select(
        F.explode(
            F.array(
                F.concat(F.substring(word, 1, 1), F.lit("*")), F.concat(F.lit("*"), F.right(word, F.lit(1))),
                F.concat(F.lit("*"), F.substring(word, 2, 1), F.lit("*")), F.regexp_replace(word, ".", "?"),
                F.concat(F.lit("?"), F.substring(word, 2, 1), F.lit("*")), F.lit("*"), F.lit("?*"), F.lit("*e*a*"),
                F.lit("a*"), F.lit("*e*"), F.lit("?????"),
            )
        ).alias("text")
    ).where("text <> ''").distinct()
    return few.withColumn("request_id", F.col("text"))


@query
def open_patterns(spark, folder):
    return wordplay.spelled_like(
        tables.word_corpus(spark, folder), _open_patterns(spark, folder), already_distinct=True
    )


@query
def pattern_candidates(spark, folder):
    """Per open pattern: is what it is compared with within the bound of a round?"""
    corpus = tables.word_corpus(spark, folder)
    asked = _open_patterns(spark, folder).withColumn("limit", F.lit(20))
    met = patterns.candidates_met(corpus.postings, corpus.gram_counts, asked)
    told = met.groupBy("request_id").agg(
        F.every(F.col("candidates") <= 2 * patterns.PAGE * F.pow(F.lit(2), F.col("round"))).alias("within")
    )
    return asked.join(told, "request_id", "left").select("request_id", F.coalesce("within", F.lit(True)).alias("bounded"))


@query
def spoonerisms(spark, folder):
    corpus = tables.word_corpus(spark, folder)
    found = wordplay.spoonerisms(corpus, tables.benchmark_pairs(spark, folder), already_distinct=True)
    return found.withColumn("swapped_left_terms", _text(F.col("swapped_left_terms"))).withColumn(
        "swapped_right_terms", _text(F.col("swapped_right_terms"))
    )


@query
def puns(spark, folder):
    corpus = tables.word_corpus(spark, folder)
    found = wordplay.puns(corpus, tables.english_words(corpus), tables.SPOKEN, already_distinct=True)
    arrays = ["query_sense_ids", "candidate_sense_ids", "provenance"]
    return found.withColumns({name: _text(F.col(name)) for name in arrays})


@query
def wordplay_partition(spark, folder):
    corpus = tables.word_corpus(spark, folder)
    parts = layout.wordplay_partition(corpus, "en")
    counts = None
    for name, part in parts.items():
        row = part.agg(F.count(F.lit(1)).alias("row_count")).withColumn("table_name", F.lit(name))
        counts = row if counts is None else counts.unionByName(row)
    return counts


# ------------------------------------------------------------------------- lookups
def _word_requests(corpus: Corpus) -> DataFrame:
    words = corpus.terms.select(F.col("normalized_term").alias("word"), "language").distinct()
    return words.withColumn("request_id", F.concat_ws(":", "language", "word"))


@query
def sense_lookup(spark, folder):
    """First senses of every word of every language."""
    corpus = tables.word_corpus(spark, folder)
    found = lookup.lookup(corpus, _word_requests(corpus), already_distinct=True, all_words=True)
    return found.drop("etymology")


_BUCKETED: dict[tuple[str, str], Corpus] = {}


@query
def lookup_bucketed(spark, folder):
    """The first senses of every word once more, out of bucketed tables."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _BUCKETED:
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        _BUCKETED[key] = bucketed.bucketed_corpus(tables.word_corpus(spark, folder, read_once=True), buckets)
    corpus = _BUCKETED[key]
    return lookup.lookup(corpus, _word_requests(corpus), already_distinct=True, all_words=True).drop("etymology")


@query
def lookup_by_part_of_speech(spark, folder):
    """Every word asked for its names (up to 100 senses) and for its first noun, whatever the case."""
    corpus = tables.word_corpus(spark, folder)
    kinds = F.array(
        F.struct(F.lit("NAME").alias("part_of_speech"), F.lit(100).alias("limit")),
        F.struct(F.lit("Noun").alias("part_of_speech"), F.lit(1).alias("limit")),
    )
    asked = _word_requests(corpus).select("*", F.inline(kinds)).withColumn("translations_limit", F.lit(0)).withColumn(
        "request_id", F.concat_ws(":", "request_id", "part_of_speech")
    )
    return lookup.lookup(corpus, asked, already_distinct=True, all_words=True).select("request_id", "rank", "sense_id", "gloss")


@query
def synonyms_of_sense(spark, folder):
    """Every sense of a part's name asked for its own synonyms only."""
    corpus = tables.part_corpus(spark, folder)
    senses = corpus.senses.join(corpus.entries.select("entry_id", "term_id"), "entry_id").join(
        corpus.terms.select("term_id", F.col("normalized_term").alias("word"), "language"), "term_id"
    )
    asked = senses.select("word", "language", "sense_id", F.col("sense_id").alias("request_id"))
    found = lookup.synonyms(corpus, asked, already_distinct=True)
    return found.select("request_id", "group_index", "position", "sense_id", "term")


def _detail_requests(spark, folder):
    return tables.benchmark_words(spark, folder).withColumn("request_id", F.col("word"))


@query
def lookup_details(spark, folder):
    corpus = tables.word_corpus(spark, folder)
    items, _ = lookup.lookup_details(corpus, _detail_requests(spark, folder), already_distinct=True)
    return items


@query
def lookup_truncated(spark, folder):
    corpus = tables.word_corpus(spark, folder)
    _, cuts = lookup.lookup_details(corpus, _detail_requests(spark, folder), already_distinct=True)
    return cuts


@query
def translation_coverage(spark, folder):
    return lookup.translation_coverage(tables.word_corpus(spark, folder))


@query
def lookup_nested(spark, folder):
    """Senses with their details as arrays, written as text."""
    found = lookup.lookup_nested(tables.word_corpus(spark, folder), _detail_requests(spark, folder))
    parts = {
        "examples": lambda s: s["example"],
        "pronunciations": lambda s: F.concat_ws("@", s["ipa"], s["region"]),
        "translations": lambda s: F.concat_ws("@", s["term"], s["language"]),
    }
    return found.select(
        "request_id", "rank", "sense_id",
        *[F.coalesce(F.array_join(F.transform(n, member), ";"), F.lit("")).alias(n) for n, member in parts.items()],
        F.coalesce(F.array_join("truncated_fields", ","), F.lit("")).alias("truncated_fields"),
    )


@query
def translation_coverage_by_bits(spark, folder):
    return sets.coverage_by_bits(tables.word_corpus(spark, folder))


@query
def translated_senses(spark, folder):
    """Distinct translated senses by language and target language, with totals, from merged sets of two parts."""
    corpus = tables.word_corpus(spark, folder)
    first = F.pmod(F.xxhash64("sense_id", "target_term_id"), F.lit(2)) == 0
    parts = [corpus.translations.filter(first), corpus.translations.filter(~first)]
    return sets.rollup_sizes(sets.translated_senses(corpus, parts), ["language", "target_language"], "senses")


@query
def translate(spark, folder):
    """Every word into every language of the documents."""
    corpus = tables.word_corpus(spark, folder)
    targets = corpus.terms.select(F.col("language").alias("target_language")).distinct()
    words = corpus.terms.select(F.col("normalized_term").alias("word"), F.col("language").alias("source_language")).distinct()
    # each word is paired with the languages it occurs in, its own excepted
    spoken_in = corpus.terms.select(F.col("normalized_term").alias("word"), F.col("language").alias("target_language")).distinct()
    asked = words.join(spoken_in, "word").join(targets, "target_language", "left_semi").filter(
        F.col("source_language") != F.col("target_language")
    )
    asked = asked.withColumn("request_id", F.concat_ws(":", "source_language", "word", "target_language"))
    return lookup.translate(corpus, asked, already_distinct=True)


@query
def synset_places(spark, folder):
    return graph.synset_places(tables.part_members(spark, folder))


@query
def synonym_counts(spark, folder):
    return graph.synonym_counts(tables.part_members(spark, folder))


@query
def synset_synonyms(spark, folder):
    return graph.synset_synonyms(tables.part_members(spark, folder))


@query
def synonyms_grouped(spark, folder):
    corpus = tables.part_corpus(spark, folder)
    words = corpus.terms.select(F.col("normalized_term").alias("word"))
    return lookup.synonyms(corpus, words.withColumn("request_id", F.col("word")), already_distinct=True)


@query
def synonyms_nested(spark, folder):
    """The grouped synonyms as one row per word, written as text."""
    corpus = tables.part_corpus(spark, folder)
    words = corpus.terms.select(F.col("normalized_term").alias("word"))
    found = lookup.synonyms_nested(corpus, words.withColumn("request_id", F.col("word")))
    terms = F.transform("groups", lambda g: F.concat_ws(
        "|", F.coalesce(g["sense_id"], F.lit("-")), F.array_join(F.transform(g["synonyms"], lambda s: s["term"]), ",")
    ))
    return found.select("request_id", F.size("groups").alias("group_count"), F.array_join(terms, ";").alias("groups"))


# --------------------------------------------------------------------------- graph
@query
def relations_nested(spark, folder):
    """The two-hop relations as one row per word and relation, their paths written as text."""
    corpus = tables.graph_corpus(spark, folder)
    found = graph.relations_nested(corpus, tables.graph_requests(corpus, ["hypernym", "hyponym"]))
    paths = F.transform("results", lambda r: F.concat_ws("|", r["relation_scope"], F.array_join(r["path"], ">")))
    return found.select("request_id", F.size("results").alias("result_count"), F.array_join(paths, ";").alias("paths"))


@query
def relations_direct(spark, folder):
    corpus = tables.graph_corpus(spark, folder)
    asked = tables.graph_requests(corpus, ["hypernym", "hyponym", "at_location"]).withColumn("max_depth", F.lit(1))
    found = graph.relations(corpus, asked, already_distinct=True)
    return found.drop("middle_term", "middle_sense_id", "distance", "relation_scope")


@query
def relations_into_language(spark, folder):
    """Every word that is not French asked for the French words it is related to."""
    corpus = tables.word_corpus(spark, folder)
    asked = _word_requests(corpus).filter("language <> 'fr'").withColumns(
        {"relation": F.lit("related"), "target_language": F.lit("fr"), "max_depth": F.lit(1)}
    )
    found = graph.relations(corpus, asked, already_distinct=True)
    return found.select("request_id", "rank", lookup_key(F.col("target_term")).alias("target_word"), "target_language")


@query
def relations_two_hop_into_language(spark, folder):
    """The two-hop relations once more with a target language, whose first hops are scanned apart."""
    corpus = tables.graph_corpus(spark, folder)
    asked = tables.graph_requests(corpus, ["hypernym", "hyponym"]).withColumn("target_language", F.lit("en"))
    return graph.relations(corpus, asked, already_distinct=True)


@query
def relations_two_hop(spark, folder):
    corpus = tables.graph_corpus(spark, folder)
    asked = tables.graph_requests(corpus, ["hypernym", "hyponym"])
    return graph.relations(corpus, asked, already_distinct=True)


@query
def multi_hop_expand(spark, folder):
    """One more hop from all related words; Spanish is not among the expandable languages."""
    rows, _ = _expansion(spark, folder)
    return rows.select(
        "request_id", "rank", "via_language", "via_word", "source_term", "target_term", "target_language",
        "target_sense_count", "target_variant_rank", "provenance_id",
    )


@query
def multi_hop_unexpanded(spark, folder):
    """Languages that were not entered, with the reason: Spanish is known but not in place."""
    catalogue = layout.language_catalogue(tables.word_corpus(spark, folder), _flags(spark, folder))
    selected = _flags(spark, folder).filter(F.col("language") != "es").select(
        "language", F.lit("lexical").alias("capability")
    )
    return layout.unexpanded_reasons(_expansion(spark, folder)[1], catalogue, selected)


def _expansion(spark, folder):
    corpus = tables.word_corpus(spark, folder)
    names = corpus.terms.select("term_id", "term", "normalized_term", "language")
    targets = corpus.relations.filter(F.col("relation_code") == RELATION_CODES["related"]).join(
        names.select(F.col("term_id").alias("source_term_id"), F.col("normalized_term").alias("request_id")), "source_term_id"
    ).join(
        names.select(F.col("term_id").alias("target_term_id"), F.col("normalized_term").alias("word"), "language"), "target_term_id"
    )
    frontier = targets.select("request_id", "language", "word").distinct().withColumn(
        "relation_code", F.lit(RELATION_CODES["related"])
    )
    limits = frontier.select("request_id").distinct().withColumn("limit", F.lit(20))
    expandable = corpus.terms.select("language").distinct().filter(F.col("language") != "es")
    return graph.expand_frontier(corpus, frontier, limits, expandable, reverse=True)


# ------------------------------------------------------------------------- vectors
def _vector_requests(corpus: Corpus) -> DataFrame:
    return corpus.terms.select(
        F.col("normalized_term").alias("word"), F.col("language").alias("source_language"),
        F.col("normalized_term").alias("request_id"),
    )


_NEIGHBOUR_COLUMNS = ["request_id", "rank", "semantic_id", "language", "similarity"]


@query
def knn_exact(spark, folder):
    corpus = tables.vector_corpus(spark, folder)
    found = vectors.neighbours(corpus, _vector_requests(corpus), already_distinct=True, decimals=4)
    return found.select(*_NEIGHBOUR_COLUMNS)


@query
def knn_by_language(spark, folder):
    corpus = tables.vector_corpus(spark, folder)
    asked = _vector_requests(corpus).withColumn("target_language", F.col("source_language")).withColumn(
        "min_similarity", F.lit(0.1)
    )
    found = vectors.neighbours(corpus, asked, already_distinct=True, decimals=4)
    return found.select(*_NEIGHBOUR_COLUMNS)


@query
def knn_approximate(spark, folder):
    corpus = tables.vector_corpus(spark, folder)
    found = vectors.approximate_neighbours(
        corpus, _vector_requests(corpus), _VISITED, already_distinct=True, decimals=4
    )
    return found.select(*_NEIGHBOUR_COLUMNS)


@query
def knn_indexed(spark, folder):
    """Approximate neighbours by product codes of the trained index."""
    asked = _vector_requests(tables.vector_corpus(spark, folder))
    found = vector_index.indexed_neighbours(tables.vector_index(spark, folder), asked, already_distinct=True, decimals=4)
    return found.select(*_NEIGHBOUR_COLUMNS)


@query
def knn_bounded(spark, folder):
    """Exact neighbours by byte codes with bounds of their error."""
    asked = _vector_requests(tables.vector_corpus(spark, folder))
    found = vector_index.bounded_neighbours(tables.vector_index(spark, folder), asked, already_distinct=True, decimals=4)
    return found.select(*_NEIGHBOUR_COLUMNS)


@query
def knn_bounded_by_language(spark, folder):
    asked = _vector_requests(tables.vector_corpus(spark, folder)).withColumn(
        "target_language", F.col("source_language")
    ).withColumn("min_similarity", F.lit(0.1))
    found = vector_index.bounded_neighbours(tables.vector_index(spark, folder), asked, already_distinct=True, decimals=4)
    return found.select(*_NEIGHBOUR_COLUMNS)


@query
def index_recall(spark, folder):
    """Whether the trained index meets the bar of recall with at most its share of full scores."""
    corpus = tables.vector_corpus(spark, folder)
    shuffled = Corpus(terms=corpus.terms, vectors=corpus.vectors.repartition("term_id"))
    report = vector_index.index_report(
        corpus, tables.vector_index(spark, folder), 10, 20, vector_index.build_index(shuffled)
    )
    # a language of fewer than 40 / 0.3 vectors is below the floor of twice the limit
    whole = (F.col("index_scope") == "language") | (F.col("scored_share") <= vector_index.RESCORED)
    return report.select(
        "index_scope", "seeds", "passed", whole.alias("within_share"), "deterministic", "strict_language_filtering"
    )


@query
def ann_recall(spark, folder):
    corpus = tables.vector_corpus(spark, folder)
    return vectors.recall_report(corpus, 10, 20, _VISITED)


@query
def recall_summary(spark, folder):
    """Whether the approximate search meets the recall bar, per scope."""
    corpus = tables.vector_corpus(spark, folder)
    return vectors.recall_summary(vectors.recall_report(corpus, 10, 20, _VISITED))


@query
def recall_seeds(spark, folder):
    return vectors.recall_seeds(tables.vector_corpus(spark, folder), 10).select("language", "stratum", "semantic_id")


@query
def identity_multiplicity(spark, folder):
    return vectors.identity_multiplicity(tables.vector_corpus(spark, folder))


@query
def vector_partition(spark, folder):
    corpus = tables.vector_corpus(spark, folder)
    declared = tables.read(spark, folder, "embeddings").groupBy(
        F.concat(F.lit("l"), F.col("label").cast("string")).alias("language")
    ).agg(F.count(F.lit(1)).alias("declared"))
    return vectors.vector_partition_check(corpus, declared)


@query
def vector_partition_rows(spark, folder):
    """Every language's vectors with their terms, as written by language and read back."""
    parts = vectors.vector_partition(tables.vector_corpus(spark, folder))
    place = f"{shared_folder(spark)}/vector-parts-{uuid.uuid4().hex}"
    vectors.write_vector_partitions(parts, place)
    return spark.read.schema(parts.schema).parquet(place).select(
        "language", "local_id", "semantic_id", "term", F.size("embedding").alias("dimensions"),
        F.get("embedding", F.lit(0)).cast("double").alias("first_component"),
    )


@query
def vector_integrity(spark, folder):
    return vectors.vector_integrity(tables.vector_corpus(spark, folder))


# -------------------------------------------------------------------------- layout
@query
def term_counts(spark, folder):
    return tables.word_corpus(spark, folder).term_counts


@query
def language_sizes(spark, folder):
    return layout.language_sizes(tables.word_corpus(spark, folder).terms)


@query
def relation_participation(spark, folder):
    return layout.relation_participation(tables.word_corpus(spark, folder))


def _flags(spark, folder) -> DataFrame:
    languages = tables.read(spark, folder, "documents").select(F.col("lang").alias("language")).distinct()
    english = F.col("language") == "en"
    return languages.select(
        "language", F.col("language").isin("en", "fr").alias("has_vectors"),
        english.alias("has_pronunciation"), english.alias("has_wordplay"),
    )


@query
def language_catalogue(spark, folder):
    return layout.language_catalogue(tables.word_corpus(spark, folder), _flags(spark, folder))


@query
def partition_assignment(spark, folder):
    """Words per (language, source), laid out as if each were a language."""
    sizes = tables.occurrences(spark, folder).groupBy(
        F.concat_ws("-", "language", "source").alias("language")
    ).agg(F.count(F.lit(1)).alias("terms"))
    return layout.assign_partitions(sizes, _ALONE_BYTES, _BUNDLE_BYTES)


def _planned(spark, folder, read_once=False):
    """Corpus of the documents and its plan, one stored row per language."""
    corpus = tables.word_corpus(spark, folder, read_once)

    def plan():
        return layout.assign_partitions(layout.language_sizes(corpus.terms), 3_000_000, 4_000_000)

    return corpus, stored_table(spark, folder, "pack_plan", plan)


def _partitioned(spark, folder, *kept, without=("examples", "pronunciations")):
    """Corpus, plan and tables of the documents cut by language; those that are read several times are kept."""
    corpus, plan = _planned(spark, folder)

    def keep(name: str, table: DataFrame) -> DataFrame:
        return stored_table(spark, folder, f"pack_{name}", lambda: table) if name in kept else table

    return corpus, plan, layout.repartition_by_language(corpus.without(*without), plan, keep)


@query
def partition_rows(spark, folder):
    return layout.partition_rows(_partitioned(spark, folder, "relations", without=())[2])


@query
def partition_files(spark, folder):
    """Rows per partition and table as written by partition and read back from the files."""
    place = f"{shared_folder(spark)}/packs-{uuid.uuid4().hex}"

    def written_out(name: str, table: DataFrame) -> DataFrame:
        layout.write_partitions({name: table}, place)
        return spark.read.schema(table.schema).parquet(f"{place}/{name}")

    return layout.partition_rows(layout.repartition_by_language(*_planned(spark, folder), written_out))


@query
def partition_stubs(spark, folder):
    return _partitioned(spark, folder)[2]["target_catalogue"].drop("term_id")


@query
def closure_report(spark, folder):
    """Whether partitions know all terms that their edges point at; how many senses these have is not asked."""
    corpus, plan = _planned(spark, folder, read_once=True)
    corpus = corpus.without("examples", "pronunciations").extended(
        term_counts=lambda: corpus.terms.limit(0).selectExpr("term_id", "0L AS entry_count", "0L AS sense_count")
    )
    held = {}

    def shared(referenced):
        held["referenced"] = written(referenced, "referenced")
        return held["referenced"]

    def keep(name, table):
        # read again by the report, which asks for no other columns
        asked = {"synonyms": layout.pointed, "target_catalogue": lambda stubs: stubs.select("pack_id", "term_id")}
        return written(asked[name](table), name) if name in asked else table

    parts = layout.repartition_by_language(corpus, plan, keep, shared)
    return layout.closure_report(parts, held["referenced"])


@query
def availability(spark, folder):
    """Each capability asked for each label-like string; two languages are in place."""
    corpus = tables.word_corpus(spark, folder)
    catalogue = layout.language_catalogue(corpus, _flags(spark, folder))
    languages = (
        tables.read(spark, folder, "documents").select(F.col("lang").alias("language"))
        .union(tables.read(spark, folder, "nation").select("n_name"))
        .union(tables.read(spark, folder, "region").select("r_name"))
        .distinct()
    )
    names = F.array(*[F.lit(n) for n in ("lexical", "semantic", "pronunciation", "wordplay")])
    asked = languages.withColumn("capability", F.explode(names)).withColumn(
        "request_id", F.concat_ws("|", "capability", "language")
    )
    selected = _flags(spark, folder).filter(F.col("language").isin("en", "de")).select(
        "language", F.explode(F.array(F.lit("lexical"), F.when(F.col("language") == "en", "wordplay"))).alias("capability")
    )
    return layout.availability(asked, catalogue, selected.filter(F.col("capability").isNotNull()))


# ------------------------------------------------------------------------- quality
@query
def sampled_words(spark, folder):
    return quality.sample_words(tables.word_corpus(spark, folder), 200, 20260816)


@query
def differential_check(spark, folder):
    corpus, plan, parts = _partitioned(spark, folder, "entries", "relations", "target_catalogue")
    return quality.differential_summary(quality.differential_check(corpus, parts, plan))


@query
def table_differences(spark, folder):
    """The line items against a copy with rows changed, dropped, added and repeated, found by digests of ranges."""
    left = tables.read(spark, folder, "lineitem")
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    right = left.where(~((key % 997 == 0) & (line == 1))).withColumn(
        "l_quantity", F.when((key % 991 == 0) & (line == 2), F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    )
    added = left.where((key % 983 == 0) & (line == 1)).withColumn("l_orderkey", -key)
    repeated = left.where((key % 977 == 0) & (line == 1))
    right = right.unionByName(added).unionByName(repeated)
    return drilldown.compare_tables(left, right, ["l_orderkey", "l_linenumber"], rows_enough=1000).differences


@query
def table_digest_levels(spark, folder):
    """Levels and digests that it takes to see that two tables, dealt out in other ways, are equal."""
    left = tables.read(spark, folder, "lineitem")
    found = drilldown.compare_tables(left, left.repartition("l_partkey"), ["l_orderkey", "l_linenumber"])
    told = [(n + 1, compared, differ) for n, (compared, differ) in enumerate(found.levels)]
    return spark.createDataFrame(told, "level long, compared long, differing long").where("compared > 0")


def damaged_events(spark, folder) -> DataFrame:
    """Events as a source with faults: some JSON cut short, some missing, some fields NULL."""
    event = F.col("event_id")
    props = F.when(event % 97 == 0, F.substring("props", 1, F.length("props") - 1)).when(event % 101 != 0, F.col("props"))
    return tables.read(spark, folder, "events").select(
        "event_id", F.when(event % 89 != 0, F.col("event_type")).alias("event_type"), props.alias("props")
    )


def _json(column: str) -> Column:
    return F.try_parse_json(column)


def _profiles(spark, folder, events: DataFrame) -> DataFrame:
    documents = tables.read(spark, folder, "documents")
    text = framed_row("doc_id", "lang", "n_chars", "source", "text")
    malformed = F.col("text").isNull() | (F.trim("text") == "")
    return quality.source_profile(documents, "documents", text, malformed).unionByName(
        quality.source_profile(events, "events", framed_row("event_id", "event_type", "props"), _json("props").isNull())
    )


@query
def source_profile(spark, folder):
    return _profiles(spark, folder, damaged_events(spark, folder))


@query
def verify_sources(spark, folder):
    """The damaged sources against a lock taken of the sound ones."""
    lock = _profiles(spark, folder, tables.read(spark, folder, "events"))
    return quality.verify_sources(_profiles(spark, folder, damaged_events(spark, folder)), lock)


@query
def stage_counts(spark, folder):
    return quality.stage_counts(tables.word_corpus(spark, folder, read_once=True))


@query
def floor_report(spark, folder):
    """Floors set from the number of documents, against the dictionary's row counts."""
    corpus = tables.word_corpus(spark, folder, read_once=True)
    counts = quality.stage_counts(corpus).join(corpus.provenance.select("provenance_id", "source"), "provenance_id")
    metrics = counts.select(F.col("source").alias("stage"), "metric", "observed")
    documents = tables.read(spark, folder, "documents").agg(F.count(F.lit(1)).alias("documents"))
    wanted = [
        ("documents", "entries", 10), ("documents", "senses", 40), ("documents-case", "synonyms", 1),
        ("documents-shared", "translations", 1000), ("shipments", "relations", 1),
    ]
    rows = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(m).alias("metric"), F.lit(n).alias("per")) for s, m, n in wanted])
    floors = documents.select("documents", F.inline(rows)).select(
        "stage", "metric", (F.col("documents") * F.col("per")).alias("minimum")
    )
    return quality.floor_report(metrics, floors)


@query
def latency_percentile(spark, folder):
    ranked = nearest_rank(tables.read(spark, folder, "events"), "event_type", "value", [0.5, 0.95, 0.99])
    return ranked.select("event_type", "quantile", "n", "value")


@query
def json_rows(spark, folder):
    """Rows, malformed rows and the sum of one field of the events' JSON column."""
    parsed = damaged_events(spark, folder).select("event_type", _json("props").alias("p"))
    return parsed.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("row_count"), F.count(F.when(F.col("p").isNull(), 1)).alias("malformed"),
        F.sum(F.try_variant_get("p", "$.k", "bigint")).alias("k_sum"),
    )
