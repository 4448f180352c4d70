"""Wildcard patterns over a positional posting index.

Every headword, framed by a mark at each end, is filed under its runs of one to three
letters with the places where they start, under its length, and once under the empty run. A
pattern lists the runs that its literal letters pin down, takes the one that the fewest
headwords hold, and looks at the headwords filed under it only; a run whose distance from an
end is fixed by the pattern must stand at that place.

A run that many headwords hold is read in pages. Headwords are dealt to pages in their order,
so an answer's first rows are on the first pages: a pattern reads as many pages as it takes
to find its limit, as many headwords as a page holds in the first round and twice as many in
every next one. A page holds at most ``PAGE`` headwords, and how many of them hold the run is
counted, which bounds what one pattern meets in one round, however common its letters are and
however close together its headwords lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import like_pattern
from ..session import written
from .ranking import global_index

#: Headwords of a page, and the most that a run may have to be read at once.
PAGE = 4096
_START, _END = "\u0002", "\u0003"
_RUNS = (3, 2, 1)
Q = "request_id"


# ------------------------------------------------------------------- the index
def postings(headwords: DataFrame) -> DataFrame:
    """gram, page, normalized_term, places (from 1, the start mark counted), size (both marks counted).

    ``headwords``(normalized_term) are distinct. Pages follow the order of the headwords.
    """
    placed = global_index(headwords.select("normalized_term"), ["normalized_term"], "place")
    # a headword is short and gives many rows: by its bytes one task would get them all
    placed = placed.repartition(2 * headwords.sparkSession.sparkContext.defaultParallelism)
    framed = F.concat(F.lit(_START), "normalized_term", F.lit(_END))
    size = F.length(framed)

    def runs(width: int) -> Column:
        starts = F.sequence(F.lit(1), size - width + 1)
        at = lambda i: framed.substr(i, F.lit(width))
        return F.when(size >= width, F.transform(
            F.array_distinct(F.transform(starts, at)),
            lambda g: F.struct(g.alias("gram"), F.filter(starts, lambda i: at(i) == g).alias("places")),
        )).otherwise(F.array().cast("array<struct<gram: string, places: array<int>>>"))

    none = F.array(F.lit(0)).alias("places")
    others = F.array(
        F.struct(_length_key(F.length("normalized_term")).alias("gram"), none), F.struct(F.lit("").alias("gram"), none)
    )
    return placed.select(
        F.floor(F.col("place") / PAGE).cast("int").alias("page"), "normalized_term", size.alias("size"),
        F.inline(F.concat(others, *[runs(w) for w in _RUNS])),
    )


def gram_counts(posted: DataFrame) -> DataFrame:
    """gram and how many headwords hold it."""
    return posted.groupBy("gram").agg(F.count(F.lit(1)).alias("words"))


def _length_key(length: Column) -> Column:
    return F.concat(F.lit("="), length.cast("string"), F.lit(_START))


# ------------------------------------------------------------------- patterns
def rarest_runs(questions: DataFrame, counts: DataFrame) -> DataFrame:
    """``questions``(request_id, text, limit) with the run that each pattern is looked up by.

    Adds gram, words (how many headwords hold it), from_start and from_end (fixed places of
    the run, null where a ``*`` stands in between). Patterns with a run that no headword
    holds match nothing and are left out.
    """
    framed = F.concat(F.lit(_START), "text", F.lit(_END))
    size = F.length(framed)
    first_star = F.instr(framed, "*")
    last_star = F.when(first_star > 0, size + 1 - F.instr(F.reverse(framed), "*")).otherwise(0)

    def found(width: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(size - width + 1, F.lit(1)))
        runs = F.transform(
            starts,
            lambda i: F.struct(
                framed.substr(i, F.lit(width)).alias("gram"),
                F.when((first_star == 0) | (i < first_star), i).alias("from_start"),
                F.when((first_star == 0) | (i > last_star), size - i).alias("from_end"),
            ),
        )
        plain = lambda s: (F.length(s["gram"]) == width) & ~s["gram"].rlike(r"[?*]") & ~s["gram"].isin(_START, _END)
        return F.filter(runs, plain)

    none = F.lit(None).cast("int")
    whole = F.struct(
        F.when(first_star == 0, _length_key(F.length("text"))).otherwise("").alias("gram"),
        none.alias("from_start"), none.alias("from_end"),
    )
    listed = questions.withColumn("run", F.explode(F.concat(F.array(whole), *[found(w) for w in _RUNS])))
    counted = listed.select("*", F.col("run.gram").alias("gram")).join(counts, "gram", "left")
    best = F.struct(
        F.coalesce("words", F.lit(0)).alias("words"), (-F.length("gram")).alias("short"), F.col("run").alias("run")
    )
    chosen = counted.groupBy(Q, "text", "limit").agg(F.min(best).alias("best"))
    return chosen.select(
        Q, "text", "limit", "best.words", "best.run.gram", "best.run.from_start", "best.run.from_end"
    ).where("words > 0")


def _verified(candidates: DataFrame) -> DataFrame:
    """Candidates whose run stands where the pattern has it and that match the whole pattern."""
    start = F.col("from_start").isNull() | F.array_contains("places", F.col("from_start"))
    end = F.col("from_end").isNull() | F.array_contains("places", F.col("size") - F.col("from_end"))
    return candidates.where(
        start & end & F.expr("normalized_term LIKE pattern ESCAPE '\\\\'") & (F.col("normalized_term") != F.col("text"))
    ).select(Q, "limit", "normalized_term")


def _page_starts(posted: DataFrame, asked: DataFrame) -> DataFrame:
    """gram, page, start: how many headwords with the run lie on earlier pages, for the runs in ``asked``.

    A run's headwords may lie close together (all that start with one letter do), so what a
    round reads is told by these counts. The window holds one row per page of a run.
    """
    held = posted.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram", "page").agg(
        F.count(F.lit(1)).alias("n")
    )
    before = Window.partitionBy("gram").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return held.select("gram", "page", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))


def _rounds(posted: DataFrame, questions: DataFrame, counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Per round: what patterns met (request_id, normalized_term and what is checked), and the matches."""
    asked = written(rarest_runs(questions, counts).withColumn("pattern", like_pattern(F.col("text"))), "patterns")
    few = posted.join(asked.where(F.col("words") <= PAGE), "gram")
    met = [(few, _verified(few))]
    left = asked.where(F.col("words") > PAGE).withColumn("next", F.lit(0).cast("long"))
    left = left.withColumn("span", F.lit(PAGE).cast("long")).withColumn("matched", F.lit(0).cast("long"))
    starts = None
    while not left.isEmpty():  # rounds double what is read, so there are few
        if starts is None:
            starts = written(_page_starts(posted, left), "pages")
        due = left.join(starts, "gram").where((F.col("start") >= F.col("next")) & (F.col("start") < F.col("next") + F.col("span")))
        candidates = due.drop("start").join(posted, ["gram", "page"])
        matches = written(_verified(candidates), "matches")
        met.append((candidates, matches))
        more = matches.groupBy(Q).agg(F.count(F.lit(1)).alias("more"))
        left = left.join(more, Q, "left").select(
            *[c for c in left.columns if c not in ("matched", "next", "span")],
            (F.col("matched") + F.coalesce("more", F.lit(0))).alias("matched"),
            (F.col("next") + F.col("span")).alias("next"), (2 * F.col("span")).alias("span"),
        ).where((F.col("matched") < F.col("limit")) & (F.col("next") < F.col("words")))
        left = written(left, "patterns")
    return met


def matches(posted: DataFrame, counts: DataFrame, questions: DataFrame) -> DataFrame:
    """request_id, limit, normalized_term: matches of each pattern, the first ``limit`` at least.

    ``questions``(request_id, text, limit). A pattern does not match its own text.
    """
    found = [m for _, m in _rounds(posted, questions, counts)]
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def candidates_met(posted: DataFrame, counts: DataFrame, questions: DataFrame) -> DataFrame:
    """request_id, round, candidates: how many headwords each pattern is compared with, per round."""
    told = [
        met.groupBy(Q).agg(F.count(F.lit(1)).alias("candidates")).withColumn("round", F.lit(n))
        for n, (met, _) in enumerate(_rounds(posted, questions, counts))
    ]
    result = told[0]
    for more in told[1:]:
        result = result.unionByName(more)
    return result
