"""Distinct counts that merge: exact sets as bitmaps, counted for any coarser grouping without the rows.

A set table holds, per group and range of 32,768 numbers, which numbers occur. Tables of
parts are united row by row and merged; totals are counted from the merged bitmaps, so a
distinct count over more groups needs no second pass over the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..schemas import Corpus
from .ranking import global_index

_WORD = 64


def language_bits(corpus: Corpus) -> DataFrame:
    """Each language's place in words of 64 bits: language, word, bit (one row per language tag)."""
    place = F.row_number().over(Window.orderBy("language")) - 1
    codes = corpus.terms.select("language").distinct().withColumn("at", place)
    return codes.select("language", F.floor(F.col("at") / _WORD).alias("word"), (F.col("at") % _WORD).alias("bit"))


def coverage_by_bits(corpus: Corpus) -> DataFrame:
    """Distinct target languages and rows of translations per sense, in one shuffle on the sense.

    A sense's languages are words of bits, united before and after the shuffle. There are as
    many words as 64 goes into the number of language tags.
    """
    bits = language_bits(corpus)
    words = bits.agg(F.max("word")).first()[0]
    names = [f"word{k}" for k in range(0 if words is None else words + 1)]
    targets = corpus.terms.select(F.col("term_id").alias("target_term_id"), "language")
    rows = corpus.translations.select("sense_id", "target_term_id").join(targets, "target_term_id").join(bits, "language")
    own = F.expr("shiftleft(1L, cast(bit AS INT))")
    united = rows.groupBy("sense_id").agg(
        F.count(F.lit(1)).alias("translation_count"),
        *[F.bit_or(F.when(F.col("word") == k, own).otherwise(F.lit(0).cast("bigint"))).alias(n) for k, n in enumerate(names)],
    )
    count = reduce(lambda a, n: a + F.bit_count(n), names, F.lit(0))
    return united.select("sense_id", count.cast("bigint").alias("language_count"), "translation_count")


def set_table(rows: DataFrame, groups: Sequence[str], number: str) -> DataFrame:
    """groups, range, members: which values of ``number`` (dense, from 0) each group holds.

    Null numbers are in no set. Numbers given in the order of the groups keep the ranges few.
    """
    at = F.col(number) + 1  # ranges count from 1
    return rows.filter(F.col(number).isNotNull()).groupBy(*groups, F.bitmap_bucket_number(at).alias("range")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("members")
    )


def merge_sets(sets: Sequence[DataFrame], groups: Sequence[str]) -> DataFrame:
    """The union of several set tables, for the same groups or coarser ones."""
    rows = reduce(DataFrame.unionByName, sets)
    return rows.groupBy(*groups, "range").agg(F.bitmap_or_agg("members").alias("members"))


def rollup_sizes(sets: DataFrame, groups: Sequence[str], name: str) -> DataFrame:
    """Sizes of the sets for all groups, and for each shorter run of them down to one total.

    ``level`` is the number of groups that a row is for; the others are null.
    """
    levels = [["range", *groups[:k]] for k in range(len(groups), -1, -1)]
    united = sets.groupingSets(levels, "range", *groups).agg(
        F.bitmap_or_agg("members").alias("members"), F.grouping_id().alias("gone")
    )
    level = F.lit(len(groups)) - F.bit_count("gone")
    return united.groupBy(level.alias("level"), *groups).agg(F.sum(F.bitmap_count("members")).alias(name))


def translated_senses(corpus: Corpus, translations: Sequence[DataFrame]) -> DataFrame:
    """Set table (language, target_language) of the senses that parts of the translations translate.

    Senses are numbered in the order of their language, once for all parts; a part adds its own
    sets, and only sets are merged.
    """
    tagged = corpus.senses.select("sense_id", "entry_id").join(
        corpus.entries.select("entry_id", "term_id"), "entry_id"
    ).join(corpus.terms.select("term_id", "language"), "term_id").select("language", "sense_id")
    numbers = global_index(tagged, ["language", "sense_id"], "number")
    targets = corpus.terms.select(F.col("term_id").alias("target_term_id"), F.col("language").alias("target_language"))
    groups = ["language", "target_language"]
    return merge_sets(
        [
            set_table(part.join(targets, "target_term_id").join(numbers, "sense_id"), groups, "number")
            for part in translations
        ],
        groups,
    )
