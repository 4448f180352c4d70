"""Nearest neighbours by cosine similarity, exact and approximate, and their checks.

Both searches are grids of bounded cells: a cell meets one block of query vectors with
one block of stored vectors, scores them with a matrix product and emits a top-k per
query. No block depends on how the data is distributed: blocks are cut by a hash of
the unique vector id, so neither a language, a cluster nor a repeated term can swell one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.ids import hash60
from ..schemas import (
    ANN_CANDIDATE_MULTIPLIER,
    ANN_MAX_CANDIDATES,
    ANN_MIN_CANDIDATES,
    MAX_BUDGET,
    Corpus,
)
from ..session import reliable_cut
from .ranking import first_per, global_index, quantile_picks, top_k
from .requests import answer_shared, with_defaults

Q = "request_id"
QUERY_BLOCK = 4096
STORED_BLOCK = 16384
_TILE = 128
#: Share of the cells that an approximate search visits unless told otherwise.
VISITED = 0.1
#: Mean recall that a scope must reach (fixed value).
RECALL_BAR = 0.9
_HITS = "question string, semantic_id long, identity long, similarity double"

NEIGHBOUR_DEFAULTS = {
    "source_language": ("string", "en"),
    "target_language": ("string", None),
    "limit": ("int", 20),
    "min_similarity": ("double", None),
}


# ----------------------------------------------------------------- vector columns
def norm(vector: Column) -> Column:
    return F.sqrt(
        F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )


def unit(vector: Column) -> Column:
    """Vector of length one (doubles)."""
    length = norm(vector)
    return F.transform(vector, lambda x: x.cast("double") / length)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def candidate_budget(limit: Column, size: Column) -> Column:
    """Stored vectors to re-rank exactly before a result of ``limit`` is cut."""
    wanted = F.greatest(F.lit(ANN_MIN_CANDIDATES), limit * ANN_CANDIDATE_MULTIPLIER, limit + 1)
    return F.least(size, F.least(wanted, F.lit(ANN_MAX_CANDIDATES)))


# ------------------------------------------------------------------- cell scoring
def _matrix(values: pd.Series) -> np.ndarray:
    matrix = np.stack([np.asarray(v, dtype=np.float64) for v in values])
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _score_cell(queries: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
    """Best ``keep`` identities per query within one bounded cell.

    Where queries name the ``visited`` centres, as bits, vectors of other centres are left out.
    """
    none = pd.DataFrame(columns=["question", "semantic_id", "identity", "similarity"])
    if queries.empty or stored.empty:
        return none
    stored = stored.sort_values(["identity", "semantic_id"], kind="stable")
    ids = stored["semantic_id"].to_numpy()
    identity = stored["identity"].to_numpy()
    starts = np.flatnonzero(np.r_[True, identity[1:] != identity[:-1]])
    ends = np.r_[starts[1:], len(identity)]
    columns = _matrix(stored["embedding"]).T
    centre = stored["centre"].to_numpy() if "visited" in queries else None
    parts = [none]
    for low in range(0, len(queries), _TILE):
        tile = queries.iloc[low : low + _TILE]
        scores = np.clip(_matrix(tile["embedding"]) @ columns, -1.0, 1.0)
        if centre is not None:
            visited = np.stack([np.unpackbits(np.frombuffer(v, np.uint8)) for v in tile["visited"]])
            scores[visited[:, centre] == 0] = -np.inf
        best = np.maximum.reduceat(scores, starts, axis=1)
        best[tile["identity"].to_numpy()[:, None] == identity[starts][None, :]] = -np.inf
        keep = np.minimum(tile["keep"].to_numpy(), len(starts))
        # every score equal to the last kept one stays in until ties are broken by id
        sorted_from = len(starts) - int(keep.max())
        tails = np.sort(np.partition(best, sorted_from, axis=1)[:, sorted_from:], axis=1)
        edge = tails[np.arange(len(tile)), tails.shape[1] - keep]
        row, group = np.nonzero((best >= edge[:, None]) & np.isfinite(best))
        column = starts[group]
        for at in np.flatnonzero(ends[group] - starts[group] > 1):
            span = scores[row[at], starts[group[at]] : ends[group[at]]]
            column[at] += int(np.argmax(span))
        similarity = best[row, group]
        order = np.lexsort((ids[column], -similarity, row))
        row, column, similarity = row[order], column[order], similarity[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        kept = place < keep[row]
        parts.append(
            pd.DataFrame(
                {
                    "question": tile["question"].to_numpy()[row[kept]],
                    "semantic_id": ids[column[kept]],
                    "identity": identity[column[kept]],
                    "similarity": similarity[kept],
                }
            )
        )
    return pd.concat([p for p in parts if len(p)] or [none], ignore_index=True)


def _score_grid(queries: DataFrame, stored: DataFrame) -> DataFrame:
    """Score cells that both sides carry a ``cell`` for."""
    stored = stored.select(*[F.col(c).alias(c) for c in stored.columns])
    return (
        queries.groupBy("cell")
        .cogroup(stored.groupBy("cell"))
        .applyInPandas(lambda q, s: _score_cell(q, s), schema=_HITS)
    )


def _slot(key: Column, count: Column) -> Column:
    return F.pmod(F.xxhash64(key), count)


def _numbers(count: Column) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), count - 1)


# ------------------------------------------------------------------------- inputs
def named_vectors(corpus: Corpus) -> DataFrame:
    """Vectors with their terms; zero or empty vectors cannot be scored and are left out."""
    terms = corpus.terms.select("term_id", "term", "normalized_term", "language")
    return (
        corpus.vectors.join(terms, "term_id")
        .filter(norm(F.col("embedding")) > 0)
        .withColumn("identity", F.xxhash64("language", "normalized_term"))
    )


def _questions(requests: DataFrame, vectors: DataFrame) -> DataFrame:
    """Each request with its seed: the lowest vector id of (word, language)."""
    seeds = first_per(
        vectors.select(
            F.col("normalized_term").alias("word"), F.col("language").alias("source_language"),
            "semantic_id", "identity", "embedding",
        ),
        ["word", "source_language"], ["semantic_id"],
    )
    return requests.join(seeds.drop("semantic_id"), ["word", "source_language"])


def _finish(hits: DataFrame, asked: DataFrame, vectors: DataFrame, decimals: int) -> DataFrame:
    """Best row per identity over all cells, then similarity descending, id ascending."""
    order = [F.desc("similarity"), "semantic_id"]
    unique = first_per(hits, ["question", "identity"], order)
    limits = asked.select(
        Q, F.col(Q).cast("string").alias("question"), "limit", "min_similarity"
    )
    ranked = top_k(
        unique.join(limits, "question"), [Q], order, MAX_BUDGET, F.col("limit")
    ).filter(F.col("min_similarity").isNull() | (F.col("similarity") >= F.col("min_similarity")))
    names = vectors.select("semantic_id", "concept", "term", "normalized_term", "language")
    return ranked.join(names, "semantic_id").select(
        Q, "rank", "semantic_id", "concept", "term", "normalized_term", "language",
        F.round("similarity", decimals).alias("similarity"), F.lit("unsensed").alias("sense_scope"),
    )


# ------------------------------------------------------------------------- exact
def neighbours(
    corpus: Corpus, requests: DataFrame, already_distinct: bool = False, decimals: int = 6
) -> DataFrame:
    """Exact nearest neighbours.

    Stored blocks are cut per language, so a request for one language meets that
    language's blocks only; one for all languages meets every block.
    """
    requests = with_defaults(requests, NEIGHBOUR_DEFAULTS)
    params = ["word", *NEIGHBOUR_DEFAULTS]

    def answer(questions: DataFrame) -> DataFrame:
        vectors = named_vectors(corpus)
        asked = _questions(questions, vectors)
        sizes = vectors.groupBy("language").agg(
            F.ceil(F.count(F.lit(1)) / STORED_BLOCK).alias("blocks")
        )
        scopes = asked.withColumn("scope", F.coalesce("target_language", F.lit("*")))
        query_sizes = scopes.groupBy("scope").agg(
            F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("query_blocks")
        )
        # the grid itself: block numbers only, one row per cell
        grid = (
            sizes.withColumn("block", F.explode(_numbers(F.col("blocks"))))
            .withColumn("scope", F.explode(F.array(F.col("language"), F.lit("*"))))
            .join(query_sizes, "scope")
            .withColumn(
                "query_block", F.explode(_numbers(F.col("query_blocks")))
            )
            .select(
                "scope", "query_block", "language", "block",
                F.concat_ws("/", "scope", "query_block", "language", "block").alias("cell"),
            )
        )
        query_side = (
            scopes.join(query_sizes, "scope")
            .withColumn("query_block", _slot(F.col(Q), F.col("query_blocks")))
            .join(grid.select("scope", "query_block", "cell"), ["scope", "query_block"])
            .select(
                "cell", F.col(Q).cast("string").alias("question"), "identity", "embedding",
                F.col("limit").alias("keep"),
            )
        )
        stored_side = (
            vectors.join(sizes, "language")
            .withColumn("block", _slot(F.col("semantic_id"), F.col("blocks")))
            .join(grid.select("language", "block", "cell"), ["language", "block"])
            .select("cell", "semantic_id", "identity", "embedding")
        )
        return _finish(_score_grid(query_side, stored_side), asked, vectors, decimals)

    return answer_shared(requests, params, answer, already_distinct)


# ------------------------------------------------------------------- approximate
def pick_centroids(vectors: DataFrame, count: int, seed: int) -> np.ndarray:
    """``count`` stored vectors in the order of a hash of their id: the centres of the cells."""
    rows = (
        vectors.select("semantic_id", "embedding")
        .orderBy(hash60(F.lit(seed), F.col("semantic_id")), "semantic_id")
        .limit(count)
        .collect()
    )
    matrix = np.array([r["embedding"] for r in rows], dtype=np.float64)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def nearest_cells(df: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add ``centre``, the nearest one."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)

    @F.pandas_udf(T.IntegerType())
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = shared.value
        for batch in batches:
            found = np.argmax(_matrix(batch) @ table.T, axis=1) if len(batch) else []
            yield pd.Series(found, dtype="int32")

    return df.withColumn("centre", nearest("embedding"))


def visited_cells(df: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """Add ``visited``: the ``probes`` nearest centres of each row as one bit per centre."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)

    @F.pandas_udf(T.BinaryType())
    def visited(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = shared.value
        wanted = min(probes, len(table))
        for batch in batches:
            if len(batch) == 0:
                yield pd.Series([], dtype=object)
                continue
            scores = _matrix(batch) @ table.T
            order = np.argsort(-scores, axis=1, kind="stable")[:, :wanted]
            bits = np.zeros(scores.shape, np.uint8)
            np.put_along_axis(bits, order, 1, axis=1)
            yield pd.Series([row.tobytes() for row in np.packbits(bits, axis=1)])

    return df.withColumn("visited", visited("embedding"))


def approximate_neighbours(
    corpus: Corpus,
    requests: DataFrame,
    visited: float = VISITED,
    seed: int = 17,
    already_distinct: bool = False,
    decimals: int = 6,
) -> DataFrame:
    """Neighbours among the vectors of the cells nearest to the query, re-ranked exactly.

    There are as many cells as the square root of the number of vectors, so centres stay few
    and cells small; a query visits the share ``visited`` of the cells. How many vectors it
    looks at thus follows the corpus; the candidate budget only bounds how many of them are
    re-ranked. Vectors are filed in blocks of a language and neighbouring cells; a cell that
    holds much of the corpus is dealt over several blocks. A query is sent once to each block of
    its scope with its visited cells as bits, and brings back its limit at most: what is shuffled
    follows blocks, not cells. What share is needed depends on how far the vectors
    cluster: ``recall_summary`` says whether a share meets the bar.
    """
    requests = with_defaults(requests, NEIGHBOUR_DEFAULTS)
    params = ["word", *NEIGHBOUR_DEFAULTS]

    def answer(questions: DataFrame) -> DataFrame:
        vectors = named_vectors(corpus)
        cells = max(1, math.ceil(math.sqrt(vectors.count())))
        probes = max(1, math.ceil(visited * cells))
        centroids = pick_centroids(vectors, cells, seed)
        # every vector meets the centres once
        stored = reliable_cut(nearest_cells(vectors, centroids))
        # one row per (language, cell), at most as many as there are cells in the window
        held = stored.groupBy("language", "centre").agg(F.count(F.lit(1)).alias("rows"))
        before = Window.partitionBy("language").orderBy("centre").rowsBetween(Window.unboundedPreceding, -1)
        start = F.coalesce(F.sum("rows").over(before), F.lit(0))
        spans = held.select(
            "language", "centre", "rows", F.floor(start / STORED_BLOCK).alias("first"),
            F.floor((start + F.col("rows") - 1) / STORED_BLOCK).alias("last"),
        )
        scope = F.explode(F.array("language", F.lit("*"))).alias("scope")
        totals = held.select(scope, "rows").groupBy("scope").agg(F.sum("rows").alias("size"))
        blocks = spans.groupBy("language").agg(F.max("last").alias("blocks")).select(
            "language", F.explode(_numbers(F.col("blocks") + 1)).alias("block")
        )

        asked = _questions(questions, vectors)
        budgeted = (
            asked.select(
                F.col(Q).cast("string").alias("question"), "identity", "embedding", "limit",
                F.coalesce("target_language", F.lit("*")).alias("scope"),
            )
            .join(totals, "scope")
            .withColumn("keep", candidate_budget(F.col("limit"), F.col("size")))
        )
        # who meets whom: (scope, slice of its queries) x (language, block)
        loads = budgeted.groupBy("scope").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("slices"))
        visits = (
            blocks.select("language", "block", scope)
            .join(loads, "scope")
            .withColumn("slice", F.explode(_numbers(F.col("slices"))))
            .withColumn("cell", F.concat_ws("/", "scope", "slice", "language", "block"))
        )
        query_side = (
            visited_cells(budgeted, centroids, probes).join(loads, "scope")
            .withColumn("slice", _slot(F.col("question"), F.col("slices")))
            .join(visits.select("scope", "slice", "cell"), ["scope", "slice"])
            .select(
                "cell", "question", "identity", "embedding", "visited",
                F.greatest(F.lit(1), F.least("limit", "keep")).cast("int").alias("keep"),
            )
        )
        stored_side = (
            stored.join(spans.drop("rows"), ["language", "centre"])
            .withColumn("block", F.col("first") + _slot(F.col("semantic_id"), F.col("last") - F.col("first") + 1))
            .join(visits.select("language", "block", "cell"), ["language", "block"])
            .select("cell", "semantic_id", "identity", "embedding", "centre")
        )
        hits = _score_grid(query_side, stored_side)
        pooled = top_k(
            hits.join(budgeted.select("question", "keep"), "question"),
            ["question"], [F.desc("similarity"), "semantic_id"],
            ANN_MAX_CANDIDATES, F.col("keep"), "__candidate",
        )
        return _finish(pooled.drop("keep", "__candidate"), asked, vectors, decimals)

    return answer_shared(requests, params, answer, already_distinct)


# ------------------------------------------------------------------------- checks
def recall_seeds(corpus: Corpus, per_language: int) -> DataFrame:
    """Evenly spread seeds per language among terms with exactly one vector."""
    vectors = named_vectors(corpus).filter(F.col("normalized_term") != "")
    alone = (
        vectors.groupBy("language", "normalized_term")
        .agg(F.min("semantic_id").alias("semantic_id"), F.count(F.lit(1)).alias("n"))
        .filter("n = 1")
    )
    return quantile_picks(alone.select("language", "normalized_term", "semantic_id"), "language",
                          "semantic_id", per_language)


def identity_multiplicity(corpus: Corpus) -> DataFrame:
    """Most vectors any (language, term) has, per language."""
    per_term = named_vectors(corpus).groupBy("language", "normalized_term").count()
    return per_term.groupBy("language").agg(F.max("count").alias("max_multiplicity"))


def recall_report(
    corpus: Corpus, per_language: int, k: int, visited: float = VISITED, check_repeat: bool = True
) -> DataFrame:
    """Recall of the approximate search against the exact one, per seed and scope.

    Columns: index_scope (global, language), language, seed_id, recall_at_k,
    deterministic (a second run on reshuffled input agrees), strict_language_filtering.
    """
    seeds = recall_seeds(corpus, per_language)
    base = seeds.select(
        F.col("semantic_id").alias("seed_id"), F.col("normalized_term").alias("word"),
        F.col("language").alias("source_language"),
    )
    requests = (
        base.withColumn("index_scope", F.explode(F.array(F.lit("global"), F.lit("language"))))
        .withColumn("target_language", F.when(F.col("index_scope") == "language", F.col("source_language")))
        .withColumn("limit", F.lit(k))
        .withColumn(Q, F.concat_ws("/", "index_scope", "seed_id"))
    )
    truth = neighbours(corpus, requests, already_distinct=True)
    found = approximate_neighbours(corpus, requests, visited, already_distinct=True)
    match = ["request_id", "language", "normalized_term"]
    sizes = truth.groupBy(Q).agg(F.count(F.lit(1)).alias("truth"))
    overlap = (
        found.select(*match).join(truth.select(*match), match, "left_semi").groupBy(Q)
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    stray = (
        found.join(requests.select(Q, "target_language"), Q)
        .groupBy(Q)
        .agg(F.sum((F.col("language") != F.col("target_language")).cast("int")).alias("foreign"))
    )
    report = (
        requests.join(sizes, Q, "left").join(overlap, Q, "left").join(stray, Q, "left")
        .withColumn(
            "recall_at_k",
            F.coalesce("shared", F.lit(0)) / F.least(F.lit(k), F.coalesce("truth", F.lit(k))),
        )
        .withColumn("strict_language_filtering", F.coalesce("foreign", F.lit(0)) == 0)
    )
    if check_repeat:
        shuffled = Corpus(terms=corpus.terms, vectors=corpus.vectors.repartition("term_id"))
        again = approximate_neighbours(shuffled, requests, visited, already_distinct=True)
        same = ["request_id", "rank", "semantic_id"]
        changed = (
            found.select(*same).withColumn("run", F.lit(1))
            .unionByName(again.select(*same).withColumn("run", F.lit(2)))
            .groupBy(*same).agg(F.count(F.lit(1)).alias("runs")).filter("runs <> 2")
            .select(Q).distinct().withColumn("__changed", F.lit(True))
        )
        report = report.join(changed, Q, "left").withColumn("deterministic", F.col("__changed").isNull())
    else:
        report = report.withColumn("deterministic", F.lit(None).cast("boolean"))
    return report.select(
        "index_scope", F.col("source_language").alias("language"), "seed_id", "recall_at_k",
        "deterministic", "strict_language_filtering",
    )


def recall_summary(report: DataFrame) -> DataFrame:
    """Per scope: mean recall and whether it meets the bar with repeatable, strictly filtered results."""
    return report.groupBy("index_scope").agg(
        F.round(F.avg("recall_at_k"), 6).alias("mean_recall"), F.count(F.lit(1)).alias("seeds"),
        F.min("deterministic").alias("deterministic"),
        F.min("strict_language_filtering").alias("strict_language_filtering"),
    ).withColumn(
        "passed",
        (F.col("mean_recall") >= RECALL_BAR) & F.col("deterministic") & F.col("strict_language_filtering"),
    )


def vector_partition_check(corpus: Corpus, declared: DataFrame) -> DataFrame:
    """Stored against declared(language, declared) vector counts."""
    stored = (
        corpus.vectors.join(corpus.terms.select("term_id", "language"), "term_id")
        .groupBy("language").agg(F.count(F.lit(1)).alias("stored"))
    )
    joined = declared.join(stored, "language", "full_outer")
    none = F.lit(0).cast("bigint")
    return joined.select(
        "language", F.coalesce("declared", none).alias("declared"), F.coalesce("stored", none).alias("stored"),
    ).withColumn("matches", F.col("declared") == F.col("stored"))


def vector_partition(corpus: Corpus, languages: list[str] | None = None) -> DataFrame:
    """The vectors of some or all languages with their terms, numbered from 0 within each language.

    Numbers follow the term. One total order is sorted for all languages and each takes off
    what lies before it, so a language that holds most vectors is not one task.
    """
    terms = corpus.terms.select("term_id", "term", "normalized_term", "language")
    if languages is not None:
        terms = terms.filter(F.col("language").isin(languages))
    rows = global_index(corpus.vectors.join(terms, "term_id"), ["language", "term", "semantic_id"], "__at")
    first = rows.groupBy("language").agg(F.min("__at").alias("__first"))
    return rows.join(first, "language").select(
        "language", (F.col("__at") - F.col("__first")).alias("local_id"), "semantic_id", "term_id",
        "term", "normalized_term", "embedding",
    )


def write_vector_partitions(parts: DataFrame, folder: str, rows_per_file: int = 4_000_000) -> None:
    """``vector_partition`` rows as one Parquet folder per language, files bounded by rows."""
    file = F.floor(F.col("local_id") / rows_per_file)
    parts.repartition("language", file).write.mode("overwrite").partitionBy("language").parquet(folder)


def vector_integrity(corpus: Corpus) -> DataFrame:
    """One row: are ids dense from 0, does each resolve to a term, do languages add up."""
    dense = corpus.vectors.agg(
        F.count(F.lit(1)).alias("vectors"),
        F.countDistinct("semantic_id").alias("distinct_ids"),
        F.min("semantic_id").alias("min_id"),
        F.max("semantic_id").alias("max_id"),
        F.sum(F.when(F.size("embedding") == 0, 1).otherwise(0)).alias("empty_vectors"),
        F.countDistinct(F.size("embedding")).alias("dimension_count"),
    )
    orphans = corpus.vectors.join(corpus.terms, "term_id", "left_anti").agg(F.count(F.lit(1)))
    by_language = (
        corpus.vectors.join(corpus.terms.select("term_id", "language"), "term_id")
        .groupBy("language").count()
    )
    sums = {
        "unresolved": orphans.scalar(),
        "language_sum": by_language.agg(F.sum("count")).scalar(),
        "languages": by_language.agg(F.count(F.lit(1))).scalar(),
    }
    return dense.withColumns(sums).withColumn(
        "intact",
        (F.col("vectors") > 0)
        & (F.col("distinct_ids") == F.col("vectors"))
        & (F.col("min_id") == 0)
        & (F.col("max_id") == F.col("vectors") - 1)
        & (F.col("empty_vectors") == 0)
        & (F.col("dimension_count") == 1)
        & (F.col("unresolved") == 0)
        & (F.col("language_sum") == F.col("vectors")),
    )
