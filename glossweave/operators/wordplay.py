"""Letter and sound wordplay over request tables.

Answers are prepared once per key (a rhyme key, a pronunciation, a letter signature):
the first ``limit + 1`` headwords of the key. A request then reads at most that many
rows per key, one of which may be itself. A key shared by a third of the dictionary
is cut before it is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.phonetics import deletions, in_inventory, onset, remainder
from ..functions.text import is_eligible, is_palindrome, letter_signature, letters_of
from ..schemas import (
    MAX_BUDGET,
    PUN_SENSE_FETCH,
    SPOONERISM_ALTERNATIVES,
    SPOONERISM_RESOLVED_TERMS,
    Corpus,
)
from ..session import reliable_cut
from . import patterns
from .ranking import count_before, first_per, top_k
from .requests import answer_shared, with_defaults

Q = "request_id"
_LIMIT = {"limit": ("int", 20)}
_ENGLISH = "en"


# ---------------------------------------------------------------- index tables
def letter_index(terms: DataFrame) -> DataFrame:
    """Letter keys of the English headwords."""
    letters = letters_of(F.col("normalized_term"))
    return (
        terms.filter(F.col("language") == _ENGLISH)
        .withColumn("letters", letters)
        .select(
            "term_id", "term", "normalized_term", "letters",
            letter_signature(F.col("letters")).alias("signature"),
            F.reverse("letters").alias("reversed_letters"),
            is_eligible(F.col("normalized_term")).alias("eligible"),
            (is_eligible(F.col("normalized_term")) & is_palindrome(F.col("letters"))).alias("palindrome"),
        )
    )


def spoken_terms(corpus: Corpus) -> DataFrame:
    """English pronunciations with the names of their terms."""
    english = corpus.terms.filter(F.col("language") == _ENGLISH)
    return english.select("term_id", "term", "normalized_term").join(corpus.spoken, "term_id")


def entry_provenance(corpus: Corpus) -> DataFrame:
    """Provenance ids of the entries of each English normalised term.

    The set is bounded by the provenance dimension, not by the number of entries.
    """
    english = corpus.terms.filter(F.col("language") == _ENGLISH).select("term_id", "normalized_term")
    return (
        english.join(corpus.entries.select("term_id", "provenance_id"), "term_id")
        .groupBy("normalized_term")
        .agg(F.sort_array(F.collect_set("provenance_id")).alias("provenance"))
    )


def _with_provenance(rows: DataFrame, corpus: Corpus, spoken_provenance: int) -> DataFrame:
    """Entry provenance of the result term, else the pronunciation source's."""
    return rows.join(entry_provenance(corpus), "normalized_term", "left").withColumn(
        "provenance", F.coalesce("provenance", F.array(F.lit(spoken_provenance)))
    )


# ------------------------------------------------------------- rhyme and sound
def _heads_by(spoken: DataFrame, key: str, keep: int = MAX_BUDGET + 1) -> DataFrame:
    """Per key: the first headwords in order, each with its least spelling and sound."""
    grouped = spoken.withColumn("key", F.col(key)).groupBy("key", "normalized_term").agg(
        F.min("term").alias("term"), F.min("phonemes").alias("phonemes")
    )
    return top_k(grouped, ["key"], ["normalized_term"], keep, rank="__head")


def _own_keys(questions: DataFrame, spoken: DataFrame, key: str) -> DataFrame:
    """Distinct keys of each requested word's pronunciations."""
    own = spoken.filter(F.col(key) != "").select(
        F.col("normalized_term").alias("text"), F.col(key).alias("key")
    )
    return questions.join(own, "text").select(Q, "text", "limit", "key").distinct()


def _finish(rows: DataFrame, mode: str) -> DataFrame:
    """Merge a request's keys: one row per headword, least spelling and sound, first ``limit``."""
    merged = (
        rows.filter(F.col("normalized_term") != F.col("text"))
        .groupBy(Q, "limit", "normalized_term")
        .agg(F.min("term").alias("term"), F.min("phonemes").alias("phonemes"))
    )
    ranked = top_k(merged, [Q], ["normalized_term"], MAX_BUDGET, F.col("limit"))
    return ranked.select(
        Q, "rank", "term", "normalized_term", F.lit(_ENGLISH).alias("language"),
        F.lit(mode).alias("mode"), "phonemes",
    )


def _shared_key_matches(corpus: Corpus, requests: DataFrame, key: str, mode: str, distinct: bool) -> DataFrame:
    requests = with_defaults(requests, _LIMIT)

    def answer(questions: DataFrame) -> DataFrame:
        spoken = spoken_terms(corpus)
        heads = _heads_by(spoken, key)
        joined = _own_keys(questions, spoken, key).join(heads, "key")
        return _finish(joined.filter(F.col("__head") <= F.col("limit") + 1), mode)

    return answer_shared(requests, ["text", "limit"], answer, distinct)


def rhymes(corpus: Corpus, requests: DataFrame, already_distinct: bool = False) -> DataFrame:
    """Exact rhymes: headwords sharing a rhyme key with the word."""
    return _shared_key_matches(corpus, requests, "rhyme_key", "exact", already_distinct)


def sounds_like(corpus: Corpus, requests: DataFrame, already_distinct: bool = False) -> DataFrame:
    """Headwords with an identical pronunciation."""
    return _shared_key_matches(corpus, requests, "phonemes", "sounds_like", already_distinct)


def near_keys(keys: DataFrame) -> DataFrame:
    """(key, near_key) for all stored keys one token apart.

    A deletion is an equi-join of a key's shortened form with the stored keys. A
    substitution pairs keys that agree but for the token at one spot: such a group has
    one key per token, so it is bounded by the sound inventory, and every pair in it is
    a result. No pair is formed that is not one edit apart.
    """
    distinct = keys.select("key").distinct()
    cut = distinct.select("key", F.inline(deletions(F.split("key", " "))))
    shorter = cut.filter(F.col("rest") != "").select("key", F.col("rest").alias("near_key"), "token")
    removed = shorter.join(distinct.withColumnRenamed("key", "near_key"), "near_key", "left_semi")
    by_removal = removed.select("key", "near_key")
    by_insertion = removed.filter(in_inventory(F.col("token"))).select(
        F.col("near_key").alias("key"), F.col("key").alias("near_key")
    )
    spots = cut.withColumn("length", F.size(F.split("key", " "))).select(
        "key", "spot", "rest", "length", "token"
    )
    other = spots.filter(in_inventory(F.col("token"))).select(
        F.col("key").alias("near_key"), "spot", "rest", "length", F.col("token").alias("near_token")
    )
    by_change = (
        spots.join(other, ["spot", "rest", "length"])
        .filter(F.col("token") != F.col("near_token"))
        .select("key", "near_key")
    )
    return by_removal.unionByName(by_insertion).unionByName(by_change).distinct()


def near_rhymes(corpus: Corpus, requests: DataFrame, already_distinct: bool = False) -> DataFrame:
    """Headwords whose rhyme key is one token away, none of the word's own keys included.

    Words with the same set of rhyme keys share one answer: neither the word itself nor
    any word with one of its keys can occur in it by way of a near key.
    """
    requests = with_defaults(requests, _LIMIT)

    def answer(questions: DataFrame) -> DataFrame:
        spoken = spoken_terms(corpus)
        own = _own_keys(questions, spoken, "rhyme_key")
        # a word has few pronunciations; the array is one word's keys
        sets = own.groupBy(Q, "text", "limit").agg(F.sort_array(F.collect_set("key")).alias("keys"))
        # the word itself may still appear through another pronunciation's key
        heads = _heads_by(spoken, "rhyme_key").withColumnRenamed("key", "near_key")
        groups = sets.select("keys", "limit").distinct()
        pairs = near_keys(spoken.filter(F.col("rhyme_key") != "").select(F.col("rhyme_key").alias("key")))
        reached = (
            groups.withColumn("key", F.explode("keys"))
            .join(pairs, "key")
            .filter(~F.array_contains(F.col("keys"), F.col("near_key")))
            .select("keys", "limit", "near_key")
            .distinct()
            .join(heads, "near_key")
            .filter(F.col("__head") <= F.col("limit") + 1)
            .groupBy("keys", "limit", "normalized_term")
            .agg(F.min("term").alias("term"), F.min("phonemes").alias("phonemes"))
        )
        listed = top_k(
            reached, ["keys", "limit"], ["normalized_term"], MAX_BUDGET + 1, F.col("limit") + 1, "__at"
        )
        return _finish(sets.join(listed, ["keys", "limit"]), "near")

    return answer_shared(requests, ["text", "limit"], answer, already_distinct)


# ------------------------------------------------------------ spelling patterns
def spelling_postings(corpus: Corpus) -> DataFrame:
    """The posting index of the spoken headwords (see ``patterns``)."""
    return patterns.postings(_spoken_headwords(corpus))


def spelled_like(corpus: Corpus, requests: DataFrame, already_distinct: bool = False) -> DataFrame:
    """Headwords matching ``?``/``*`` patterns, looked up by the rarest run of letters of each pattern.

    The corpus may hold the index (``postings``, ``gram_counts``); else it is made.
    """
    requests = with_defaults(requests, _LIMIT)

    def answer(questions: DataFrame) -> DataFrame:
        posted = corpus.postings if corpus.has("postings") else reliable_cut(spelling_postings(corpus))
        counts = corpus.gram_counts if corpus.has("gram_counts") else patterns.gram_counts(posted)
        found = patterns.matches(posted, counts, questions.select(Q, "text", "limit"))
        first = top_k(found, [Q], ["normalized_term"], MAX_BUDGET, F.col("limit"))
        named = first.drop("rank").join(_spoken_headwords(corpus), "normalized_term")
        return _list_matches(named, "spelled_like")

    return answer_shared(requests, ["text", "limit"], answer, already_distinct)


def _spoken_headwords(corpus: Corpus) -> DataFrame:
    return spoken_terms(corpus).groupBy("normalized_term").agg(
        F.min("term").alias("term"), F.min("phonemes").alias("phonemes")
    )


def _list_matches(matches: DataFrame, mode: str) -> DataFrame:
    ranked = top_k(matches, [Q], ["normalized_term"], MAX_BUDGET, F.col("limit"))
    return ranked.select(
        Q, "rank", "term", "normalized_term", F.lit(_ENGLISH).alias("language"),
        F.lit(mode).alias("mode"), "phonemes",
    )


def prefixed(corpus: Corpus, requests: DataFrame, already_distinct: bool = False) -> DataFrame:
    """Headwords starting with the text; an equi-join on prefixes of the lengths asked for.

    Each prefix keeps its first ``limit + 1`` headwords before requests read them.
    """
    requests = with_defaults(requests, _LIMIT)

    def answer(questions: DataFrame) -> DataFrame:
        sized = questions.withColumn("width", F.length("text"))
        lengths = sized.agg(F.collect_set("width").alias("w")).scalar()
        word = F.col("normalized_term")
        prefixes = F.transform(
            F.filter("__lengths", lambda w: w <= F.length(word)), lambda w: word.substr(F.lit(1), w)
        )
        sized_words = _spoken_headwords(corpus).withColumn("__lengths", lengths)
        filed = sized_words.withColumn("text", F.explode(prefixes)).drop("__lengths")
        asked = filed.join(questions.select("text").distinct(), "text", "left_semi")
        heads = top_k(asked, ["text"], ["normalized_term"], MAX_BUDGET + 1, rank="__head")
        matches = questions.join(heads, "text").filter(F.col("normalized_term") != F.col("text"))
        return _list_matches(matches, "prefix")

    return answer_shared(requests, ["text", "limit"], answer, already_distinct)


_MODES = {
    "rhyme": rhymes,
    "near_rhyme": near_rhymes,
    "sounds_like": sounds_like,
    "spelled_like": spelled_like,
    "prefix": prefixed,
}
SEARCH_MODES = tuple(_MODES)


def search(corpus: Corpus, requests: DataFrame, already_distinct: bool = False) -> DataFrame:
    """Sound and spelling matches for a request table with a ``mode`` per row."""
    answers = None
    for mode, operator in _MODES.items():
        asked = requests.filter(F.col("mode") == mode).drop("mode")
        found = operator(corpus, asked, already_distinct).withColumn("mode", F.lit(mode))
        answers = found if answers is None else answers.unionByName(found)
    return answers


# ------------------------------------------------------------ anagrams, palindromes
def _by_letters(index: DataFrame, *keys: str) -> DataFrame:
    """One row per letter string; the least spelling also names the normalised term."""
    return (
        index.groupBy(*keys, "letters")
        .agg(F.min(F.struct("term", "normalized_term")).alias("__least"))
        .select(*keys, "letters", "__least.*")
    )


def anagrams(
    corpus: Corpus, requests: DataFrame, spoken_provenance: int, already_distinct: bool = False
) -> DataFrame:
    """Headwords made of exactly the letters of the text."""
    requests = with_defaults(requests, _LIMIT)

    def answer(questions: DataFrame) -> DataFrame:
        index = letter_index(corpus.terms).filter("eligible")
        heads = top_k(
            _by_letters(index, "signature"), ["signature"], ["letters"], MAX_BUDGET + 1, rank="__head"
        )
        letters = letters_of(F.col("text"))
        asked = questions.withColumn("own_letters", letters).filter(F.col("own_letters") != "")
        matched = (
            asked.withColumn("signature", letter_signature(F.col("own_letters")))
            .join(heads, "signature")
            .filter((F.col("__head") <= F.col("limit") + 1) & (F.col("letters") != F.col("own_letters")))
        )
        ranked = top_k(matched, [Q], ["letters"], MAX_BUDGET, F.col("limit"))
        return _with_provenance(ranked, corpus, spoken_provenance).select(
            Q, "rank", "term", "normalized_term", "signature", "provenance"
        )

    return answer_shared(requests, ["text", "limit"], answer, already_distinct)


def anagram_groups(terms: DataFrame) -> DataFrame:
    """Every letter signature shared by two or more letter strings, per language.

    One row per member, not per pair.
    """
    letters = letters_of(F.col("normalized_term"))
    members = (
        terms.filter(is_eligible(F.col("normalized_term")))
        .select("language", letters.alias("letters"), "term")
        .groupBy("language", "letters")
        .agg(F.min("term").alias("term"))
        .withColumn("signature", letter_signature(F.col("letters")))
    )
    sizes = (
        members.groupBy("language", "signature")
        .agg(F.count(F.lit(1)).alias("members"))
        .filter(F.col("members") > 1)
    )
    return members.join(sizes, ["language", "signature"]).select(
        "language", "signature", "members", "letters", "term"
    )


def palindromes(
    corpus: Corpus, requests: DataFrame, spoken_provenance: int, already_distinct: bool = False
) -> DataFrame:
    """A page of stored palindromes that starts at the text's letters and wraps once.

    Palindromes and request keys are put in one total order. The number of palindromes
    before a row is a palindrome's slot, and for a request the slot its page starts at;
    the page is an equi-join on ``limit`` consecutive slots.
    """
    requests = with_defaults(requests, _LIMIT)

    def answer(questions: DataFrame) -> DataFrame:
        stored = _by_letters(letter_index(corpus.terms).filter("palindrome"))
        asked = questions.withColumn("own_letters", letters_of(F.col("text"))).filter(
            F.length("own_letters") >= 2
        )
        keys = asked.select(F.col("own_letters").alias("letters")).distinct()
        mixed = keys.withColumn("stored", F.lit(0)).unionByName(
            stored.withColumn("stored", F.lit(1)), allowMissingColumns=True
        )
        placed = count_before(mixed, ["letters", "stored"], "stored", "slot")
        slots = placed.filter("stored = 1").select("slot", "letters", "term", "normalized_term")
        starts = placed.filter("stored = 0").select(
            F.col("letters").alias("own_letters"), F.col("slot").alias("start")
        )
        total = slots.agg(F.count(F.lit(1))).scalar()
        # one extra place, because the text itself may be among the palindromes
        span = F.least(F.col("limit") + 1, total)
        page = (
            asked.join(starts, "own_letters")
            .filter(total > 0)
            .withColumn("step", F.explode(F.sequence(F.lit(0), F.greatest(span - 1, F.lit(0)).cast("int"))))
            .withColumn("slot", (F.col("start") + F.col("step")) % total)
            .join(slots, "slot")
            .filter(F.col("letters") != F.col("own_letters"))
        )
        ranked = top_k(page, [Q], ["step"], MAX_BUDGET, F.col("limit"))
        return _with_provenance(ranked, corpus, spoken_provenance).select(
            Q, "rank", "term", "normalized_term", F.col("letters").alias("palindrome_key"),
            is_palindrome(F.col("own_letters")).alias("input_is_palindrome"), "provenance",
        )

    return answer_shared(requests, ["text", "limit"], answer, already_distinct)


# ----------------------------------------------------------------- spoonerisms, puns
def spoonerisms(corpus: Corpus, requests: DataFrame, already_distinct: bool = False) -> DataFrame:
    """Swap the onsets of two words; requests(request_id, left, right, limit)."""
    requests = with_defaults(requests, _LIMIT)

    def answer(questions: DataFrame) -> DataFrame:
        spoken = spoken_terms(corpus)
        sounds = spoken.groupBy("normalized_term", "phonemes").agg(F.min("term").alias("term"))
        alternatives = top_k(
            sounds, ["normalized_term"], ["phonemes"], SPOONERISM_ALTERNATIVES, rank="at"
        ).select(
            "normalized_term", "term", "phonemes", "at", onset(F.col("phonemes")).alias("onset"),
            remainder(F.col("phonemes")).alias("remainder"),
        )

        def side(name: str) -> DataFrame:
            renamed = [F.col(c).alias(f"{name}_{c}") for c in ("term", "phonemes", "at", "onset", "remainder")]
            return alternatives.select(F.col("normalized_term").alias(name), *renamed)

        def swapped(first: str, rest: str) -> Column:
            return F.concat_ws(" ", F.nullif(F.col(first), F.lit("")), F.nullif(F.col(rest), F.lit("")))

        pairs = (
            questions.join(side("left"), "left")
            .join(side("right"), "right")
            .filter(F.col("left_onset") != F.col("right_onset"))
            .withColumn("swapped_left", swapped("right_onset", "left_remainder"))
            .withColumn("swapped_right", swapped("left_onset", "right_remainder"))
        )
        unique = first_per(pairs, [Q, "swapped_left", "swapped_right"], ["left_at", "right_at"])
        ranked = top_k(unique, [Q], ["left_at", "right_at"], MAX_BUDGET, F.col("limit"))
        resolved = top_k(
            sounds.select("phonemes", "normalized_term").distinct(),
            ["phonemes"], ["normalized_term"], SPOONERISM_RESOLVED_TERMS, rank="at",
        )
        names = resolved.groupBy("phonemes").agg(
            F.sort_array(F.collect_list("normalized_term")).alias("names")
        )
        both = ranked.join(
            names.select(F.col("phonemes").alias("swapped_left"), F.col("names").alias("swapped_left_terms")),
            "swapped_left", "left",
        ).join(
            names.select(F.col("phonemes").alias("swapped_right"), F.col("names").alias("swapped_right_terms")),
            "swapped_right", "left",
        )
        lexical = F.col("swapped_left_terms").isNotNull() & F.col("swapped_right_terms").isNotNull()
        empty = F.array().cast("array<string>")
        return both.select(
            Q, "rank", "left_term", "left_phonemes", "right_term", "right_phonemes",
            "swapped_left", "swapped_right",
            F.coalesce("swapped_left_terms", empty).alias("swapped_left_terms"),
            F.coalesce("swapped_right_terms", empty).alias("swapped_right_terms"),
            F.col("left_onset").alias("onset_left"), F.col("right_onset").alias("onset_right"),
            F.when(lexical, "lexical_term").otherwise("generated_candidate").alias("lexicality_scope"),
        )

    return answer_shared(requests, ["left", "right", "limit"], answer, already_distinct)


def _first_senses(corpus: Corpus) -> DataFrame:
    """First sense ids of each English normalised term."""
    english = corpus.terms.filter(F.col("language") == _ENGLISH).select("term_id", "normalized_term")
    rows = (
        english.join(corpus.entries.select("entry_id", "term_id"), "term_id")
        .join(corpus.senses.select("sense_id", "entry_id"), "entry_id")
        .select("normalized_term", "sense_id")
    )
    heads = top_k(rows, ["normalized_term"], ["sense_id"], PUN_SENSE_FETCH, rank="__at")
    return heads.groupBy("normalized_term").agg(
        F.sort_array(F.collect_list("sense_id")).alias("sense_ids")
    )


def puns(
    corpus: Corpus, requests: DataFrame, spoken_provenance: int, already_distinct: bool = False
) -> DataFrame:
    """Homophones of the text that carry senses of their own.

    requests(request_id, text, context, limit); context only sets the scope label.
    """
    requests = with_defaults(requests, {**_LIMIT, "context": ("string", None)})
    contextual = F.when(F.col("context").isNull(), "uncontextualized").otherwise("contextualized")
    requests = requests.withColumn("context_scope", contextual)

    def answer(questions: DataFrame) -> DataFrame:
        spoken = spoken_terms(corpus)
        fetch = 4 * MAX_BUDGET
        sounds = spoken.groupBy("phonemes", "normalized_term").agg(F.min("term").alias("term"))
        # one list per sound is enough for every request with that sound
        heads = top_k(sounds, ["phonemes"], ["normalized_term"], fetch + 1, rank="__head")
        own = questions.join(
            spoken.select(F.col("normalized_term").alias("text"), "phonemes").distinct(), "text"
        )
        found = own.join(heads, "phonemes").filter(
            (F.col("__head") <= 4 * F.col("limit") + 1) & (F.col("normalized_term") != F.col("text"))
        )
        scanned = top_k(
            found, [Q], ["normalized_term", "phonemes"], fetch, 4 * F.col("limit"), "__at"
        )
        senses = _first_senses(corpus)
        joined = scanned.join(
            senses.withColumnRenamed("sense_ids", "candidate_sense_ids"), "normalized_term"
        ).join(
            senses.select(F.col("normalized_term").alias("text"), F.col("sense_ids").alias("query_sense_ids")),
            "text", "left",
        )
        none = F.array().cast("array<string>")
        fresh = joined.withColumn("query_sense_ids", F.coalesce("query_sense_ids", none)).filter(
            ~F.arrays_overlap("candidate_sense_ids", "query_sense_ids")
        )
        ranked = top_k(fresh, [Q], ["__at"], MAX_BUDGET, F.col("limit"))
        sources = entry_provenance(corpus)
        cited = ranked.join(sources, "normalized_term", "left").join(
            sources.select(F.col("normalized_term").alias("text"), F.col("provenance").alias("text_provenance")),
            "text", "left",
        )
        no_ids = F.array().cast("array<int>")
        return cited.select(
            Q, "rank", "term", "phonemes", "query_sense_ids", "candidate_sense_ids", "context_scope",
            F.array_distinct(
                F.concat(
                    F.array(F.lit(spoken_provenance)),
                    F.sort_array(
                        F.array_union(
                            F.coalesce("text_provenance", no_ids), F.coalesce("provenance", no_ids)
                        )
                    ),
                )
            ).alias("provenance"),
        )

    return answer_shared(requests, ["text", "context_scope", "limit"], answer, already_distinct)
