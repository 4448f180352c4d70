"""Typed relations: oriented direct edges, two-hop paths, frontier expansion."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import space_count
from ..schemas import (
    DIRECTION_CODES,
    MAX_BUDGET,
    RELATION_CODES,
    RELATION_SCAN_CEILING,
    RELATION_SCAN_FLOOR,
    Corpus,
    inverse_direction,
    inverse_relation,
    name_of,
)
from ..session import reliable_cut
from .ranking import diversify, first_per, round_robin, top_k
from .requests import answer_shared, with_defaults

Q = "request_id"

RELATION_DEFAULTS = {
    "language": ("string", "en"),
    "target_language": ("string", None),
    "sense_id": ("string", None),
    "limit": ("int", 20),
    "max_depth": ("int", 2),
    "transitive_limit": ("int", 5),
}
_HIERARCHY = [RELATION_CODES["hypernym"], RELATION_CODES["hyponym"]]
_FRONTIER_SCAN = 256
_FRONTIER_CEILING = 64
_BRANCH_CEILING = 32
_PREFETCH_CEILING = 128

_SHAPE = [
    "target_spaces", "target_length", "target_language", "target_normalized", "target_term",
]


def edge_order() -> list[str | Column]:
    """Order of rows merged from several sources; the source's name breaks late ties."""
    return [
        "target_variant_rank",
        F.desc("target_sense_count"),
        F.desc("target_entry_count"),
        *_SHAPE,
        F.asc_nulls_first("source_sense_id"),
        F.asc_nulls_first("target_sense_id"),
        "direction_code",
        "source",
        "source_term",
    ]


def scan_order() -> list[str | Column]:
    """Order inside one orientation, as the stored rows are read."""
    return [
        "target_variant_rank",
        F.desc("target_sense_count"),
        F.desc("target_entry_count"),
        *_SHAPE,
        F.asc_nulls_first("target_sense_id"),
        "provenance_id",
        "stored_direction",
        F.asc_nulls_first("source_sense_id"),
        "source_term",
    ]


def scan_limit(limit: Column) -> Column:
    return F.least(
        F.lit(RELATION_SCAN_CEILING), F.greatest(F.lit(RELATION_SCAN_FLOOR), limit * 8)
    )


def term_catalogue(corpus: Corpus) -> DataFrame:
    """Names of all terms with their entry and sense counts over the whole corpus."""
    counts = corpus.term_counts
    named = corpus.terms.join(counts, "term_id", "left")
    return named.select(
        F.col("term_id").alias("target_term_id"),
        F.col("term").alias("target_term"),
        F.col("normalized_term").alias("target_normalized"),
        F.col("language").alias("target_language"),
        F.coalesce("entry_count", F.lit(0)).alias("target_entry_count"),
        F.coalesce("sense_count", F.lit(0)).alias("target_sense_count"),
    )


def oriented(relations: DataFrame, shard: Sequence[str] = ()) -> DataFrame:
    """Each stored edge seen from both of its ends, in one scan of the table."""
    forward = F.struct(
        F.col("source_term_id").alias("anchor_term_id"),
        F.col("source_sense_id").alias("source_sense_id"),
        F.col("target_term_id").alias("target_term_id"),
        F.col("target_sense_id").alias("target_sense_id"),
        F.col("relation_code").cast("int").alias("relation_code"),
        F.col("direction_code").cast("int").alias("direction_code"),
        F.lit(1).alias("orientation"),
    )
    backward = F.struct(
        F.col("target_term_id").alias("anchor_term_id"),
        F.col("target_sense_id").alias("source_sense_id"),
        F.col("source_term_id").alias("target_term_id"),
        F.col("source_sense_id").alias("target_sense_id"),
        inverse_relation(F.col("relation_code")).alias("relation_code"),
        inverse_direction(F.col("direction_code")).alias("direction_code"),
        F.lit(2).alias("orientation"),
    )
    return relations.select(
        F.inline(F.array(forward, backward)),
        F.col("direction_code").cast("int").alias("stored_direction"),
        "provenance_id",
        *shard,
    )


def anchored_edges(
    corpus: Corpus,
    scans: DataFrame,
    keys: Sequence[str],
    catalogue: DataFrame | None = None,
    shard: Sequence[str] = (),
    resolve: Callable[[DataFrame], DataFrame] | None = None,
    ceiling: int | None = RELATION_SCAN_CEILING,
) -> DataFrame:
    """Edges of each scan's word, with target names, counts and variant ranks.

    ``scans``: keys + word, language, relation_code, target_language_filter,
    sense_filter. With a ``ceiling`` only variants that can still enter a scan of as many
    rows survive; that holds where the variant rank is the first sort key of every later
    cut, and callers that cut in another order pass None. ``shard`` columns confine
    every join to one partition; ``resolve`` then names the targets instead of the
    corpus-wide catalogue.
    """
    anchors = scans.join(
        corpus.terms.select(
            F.col("term_id").alias("anchor_term_id"), F.col("term").alias("source_term"),
            F.col("normalized_term").alias("word"), "language", *shard,
        ),
        ["word", "language", *shard],
    )
    stored = oriented(corpus.relations, shard)
    edges = anchors.join(stored, ["anchor_term_id", "relation_code", *shard]).filter(
        F.col("sense_filter").isNull() | (F.col("source_sense_id") == F.col("sense_filter"))
    )
    if resolve is None:
        known = term_catalogue(corpus) if catalogue is None else catalogue
        resolve = lambda rows: rows.join(known, "target_term_id")
    named = resolve(edges).filter(
        F.col("target_language_filter").isNull()
        | (F.col("target_language") == F.col("target_language_filter"))
    )
    both_unsensed = F.col("source_sense_id").isNull() & F.col("target_sense_id").isNull()
    ranked = top_k(
        named,
        [*keys, "orientation", "target_term_id"],
        [
            both_unsensed,
            F.asc_nulls_first("source_sense_id"),
            F.asc_nulls_first("target_sense_id"),
            "provenance_id",
            "stored_direction",
            "source_term",
        ],
        ceiling,
        rank="target_variant_rank",
    )
    return ranked.withColumn("target_spaces", space_count(F.col("target_normalized"))).withColumn(
        "target_length", F.length("target_normalized")
    )


def _merge_orientations(
    corpus: Corpus, bounded: DataFrame, keys: Sequence[str], limit: Column, ceiling: int
) -> DataFrame:
    """Turns over (provenance, orientation) so that no dense source crowds out another."""
    sources = corpus.provenance.select("provenance_id", "source")
    return round_robin(
        bounded.join(sources, "provenance_id"),
        keys, ["provenance_id", "orientation"], edge_order(), limit, ceiling, "edge_rank",
    )


def ranked_edges(
    corpus: Corpus, scans: DataFrame, keys: Sequence[str], catalogue: DataFrame | None = None
) -> DataFrame:
    """Merged edges of both orientations with ``edge_rank`` <= scan (<= 512)."""
    edges = anchored_edges(corpus, scans, keys, catalogue)
    bounded = top_k(
        edges, [*keys, "orientation"], scan_order(), RELATION_SCAN_CEILING, F.col("scan"), "__scan_rank"
    ).drop("__scan_rank")
    return _merge_orientations(corpus, bounded, keys, F.col("scan"), RELATION_SCAN_CEILING)


_IDENTITY = ["target_normalized", "target_language", "source_sense_id", "target_sense_id"]
_TARGET = ["target_normalized", "target_language"]


def relations(
    corpus: Corpus,
    requests: DataFrame,
    already_distinct: bool = False,
    catalogue: DataFrame | None = None,
) -> DataFrame:
    """Direct edges and, for hypernym/hyponym, sense-continuous two-edge paths.

    One row per result: request_id, rank, both ends, relation, direction, scope
    (direct/transitive), distance and the middle term of a two-edge path.
    """
    requests = with_defaults(requests, RELATION_DEFAULTS)
    params = ["word", "relation", *RELATION_DEFAULTS]
    return answer_shared(
        requests, params, lambda q: _relations(corpus, q, catalogue), already_distinct
    )


def relations_nested(corpus: Corpus, requests: DataFrame) -> DataFrame:
    """One row per request with its results in order; a result has its path of two or three terms."""
    path = F.filter(F.array("source_term", "middle_term", "target_term"), lambda t: t.isNotNull()).alias("path")
    senses = F.struct("source_sense_id", "middle_sense_id", "target_sense_id").alias("senses")
    result = F.struct(
        "rank", "relation", "relation_scope", "direction", "distance", path, senses, "target_language", "provenance_id"
    )
    return relations(corpus, requests).groupBy(Q).agg(
        F.transform(F.sort_array(F.collect_list(result)), lambda r: r.dropFields("rank")).alias("results")
    )


def _relations(corpus: Corpus, questions: DataFrame, catalogue: DataFrame | None) -> DataFrame:
    code = F.element_at(
        F.create_map(*[F.lit(x) for kv in RELATION_CODES.items() for x in kv]), F.col("relation")
    )
    asked = questions.select(
        Q, "word", "language", code.alias("relation_code"),
        F.col("target_language").alias("target_language_filter"),
        F.col("sense_id").alias("sense_filter"),
        "limit", scan_limit(F.col("limit")).alias("scan"),
        F.when(
            (F.col("max_depth") == 2) & code.isin(_HIERARCHY), F.col("transitive_limit")
        ).otherwise(0).alias("path_limit"),
    )
    # A target-language filter must not restrict the first hop, so such requests scan
    # a second, unfiltered time; all others read their frontier off the direct scan.
    kinds = F.when(
        (F.col("path_limit") > 0) & F.col("target_language_filter").isNotNull(),
        F.array(F.lit("direct"), F.lit("frontier")),
    ).otherwise(F.array(F.lit("direct")))
    scans = asked.withColumn("kind", F.explode(kinds))
    scans = scans.withColumn("final_language", F.col("target_language_filter")).withColumn(
        "scan", F.when(F.col("kind") == "frontier", _FRONTIER_SCAN).otherwise(F.col("scan"))
    ).withColumn(
        "target_language_filter", F.when(F.col("kind") == "direct", F.col("target_language_filter"))
    )
    # read for the direct rows and for the frontier; at most 512 rows per request
    ranked = reliable_cut(ranked_edges(corpus, scans, [Q, "kind"], catalogue))
    direct = diversify(
        ranked.filter(F.col("kind") == "direct"), [Q], _IDENTITY, _TARGET, ["edge_rank"], "__order"
    )
    first_hops = ranked.filter(
        (F.col("path_limit") > 0)
        & (F.col("edge_rank") <= _FRONTIER_SCAN)
        & ((F.col("kind") == "frontier") | F.col("final_language").isNull())
    )
    columns = [
        Q, "limit", "__order", "source_term", F.col("language").alias("source_language"),
        "source_sense_id", "relation_code", "target_term", "target_language", "target_sense_id",
        "direction_code", "provenance_id",
    ]
    none = F.lit(None).cast("string")
    rows = direct.select(
        *columns, F.lit(1).alias("distance"), none.alias("middle_term"), none.alias("middle_sense_id")
    )
    paths = _fresh_paths(_two_hop(corpus, first_hops, catalogue), direct)
    rows = rows.unionByName(
        paths.select(*columns, F.lit(2).alias("distance"), "middle_term", "middle_sense_id")
    )
    # bounded per request: at most 512 direct rows and 100 paths
    paths_found = F.count(F.when(F.col("distance") == 2, 1)).over(Window.partitionBy(Q))
    kept = rows.withColumn("__paths", paths_found).filter(
        (F.col("distance") == 2) | (F.col("__order") <= F.col("limit") - F.col("__paths"))
    )
    rank = F.row_number().over(Window.partitionBy(Q).orderBy("distance", "__order"))
    return kept.select(
        Q, rank.alias("rank"), "source_term", "source_language", "source_sense_id",
        name_of(RELATION_CODES, F.col("relation_code")).alias("relation"),
        "target_term", "target_language", "target_sense_id",
        name_of(DIRECTION_CODES, F.col("direction_code")).alias("direction"),
        F.when(F.col("distance") == 1, "direct").otherwise("transitive").alias("relation_scope"),
        "distance", "middle_term", "middle_sense_id", "provenance_id",
    )


def _fresh_paths(paths: DataFrame, direct: DataFrame) -> DataFrame:
    """Paths to what no direct row reaches, in diverse order, within their budget."""
    fresh = paths.join(
        direct.select(Q, *[F.col(c).alias(f"d_{c}") for c in _IDENTITY]).withColumnRenamed(Q, "d_q"),
        (F.col(Q) == F.col("d_q"))
        & (F.col("target_normalized") == F.col("d_target_normalized"))
        & (F.col("target_language") == F.col("d_target_language"))
        & F.col("source_sense_id").eqNullSafe(F.col("d_source_sense_id"))
        & F.col("target_sense_id").eqNullSafe(F.col("d_target_sense_id")),
        "left_anti",
    )
    spread = diversify(fresh, [Q], _IDENTITY, _TARGET, ["path_rank"], "__order")
    return spread.filter(F.col("__order") <= F.col("path_limit"))


def _preferred(direction: Column, relation_code: Column) -> Column:
    """0 when the edge points the way the relation is asked for."""
    wanted = F.when(relation_code == RELATION_CODES["hypernym"], DIRECTION_CODES["outbound"]).otherwise(
        DIRECTION_CODES["inbound"]
    )
    return F.when(direction == wanted, 0).otherwise(1)


def _frontier(first_hops: DataFrame) -> DataFrame:
    """Bounded first hops, spread over sources, orientations and source senses."""
    away = _preferred(F.col("direction_code"), F.col("relation_code"))
    spread = diversify(
        first_hops.withColumn("__away", away), [Q], _IDENTITY, _TARGET, ["__away", *edge_order()], "__order"
    )
    # targets reached both with and without a source sense are read first
    sensed = F.col("source_sense_id").isNotNull().cast("int")
    per_target = Window.partitionBy(Q, *_TARGET)
    scoped = spread.withColumn(
        "__single_scope", F.min(sensed).over(per_target) == F.max(sensed).over(per_target)
    ).withColumn("__sense_bucket", F.coalesce("source_sense_id", F.lit("")))
    within = [
        F.col("target_sense_id").isNull(),
        F.desc("target_sense_count"),
        F.desc("target_entry_count"),
        "target_variant_rank",
        *_SHAPE,
        F.asc_nulls_first("target_sense_id"),
        "__order",
    ]
    bucket = ["provenance_id", "orientation", "__sense_bucket"]
    budget = F.when(F.col("path_limit") <= 5, 16).otherwise(
        F.least(F.lit(_FRONTIER_CEILING), F.col("path_limit") * 4)
    )
    turned = top_k(scoped, [Q, *bucket, "__single_scope"], within, _FRONTIER_CEILING, rank="__turn")
    return top_k(
        turned, [Q], ["__single_scope", "__turn", *bucket], _FRONTIER_CEILING, budget, "__won"
    ).drop("__turn", "__won", "__order", "__single_scope", "__sense_bucket", "__away")


def _second_hops(corpus: Corpus, sources: DataFrame, keys: list[str], catalogue: DataFrame | None) -> DataFrame:
    """Bounded edges of each distinct source word (computed once, whoever asks)."""
    # the prefetch has an order of its own, so no variant may be cut before it
    edges = anchored_edges(corpus, sources, keys, catalogue, ceiling=None)
    both_unsensed = F.col("source_sense_id").isNull() & F.col("target_sense_id").isNull()
    prefetch = top_k(
        edges,
        [*keys, "orientation"],
        [
            both_unsensed,
            F.col("target_sense_id").isNull(),
            *_SHAPE,
            F.asc_nulls_first("source_sense_id"),
            F.asc_nulls_first("target_sense_id"),
            "provenance_id",
            "stored_direction",
            "source_term",
        ],
        _PREFETCH_CEILING,
        F.least(F.lit(_PREFETCH_CEILING), F.greatest(F.lit(32), F.col("branch") * 4)),
        "__prefetch",
    ).drop("__prefetch")
    return _merge_orientations(corpus, prefetch, keys, F.col("branch"), _BRANCH_CEILING)


def _two_hop(corpus: Corpus, first_hops: DataFrame, catalogue: DataFrame | None) -> DataFrame:
    """Two homogeneous edges: same source and direction, and one unbroken sense (or none)."""
    frontier = _frontier(first_hops).withColumn(
        "branch", F.greatest(F.lit(16), F.least(F.lit(_BRANCH_CEILING), F.col("path_limit") * 2))
    )
    keys = ["mid_word", "mid_language", "relation_code", "final_language", "branch"]
    firsts = reliable_cut(frontier).select(
        Q, "word", "language", "limit", "path_limit", "relation_code", "final_language", "branch",
        F.col("target_normalized").alias("mid_word"), F.col("target_language").alias("mid_language"),
        F.col("target_term").alias("middle_term"), F.col("target_term_id").alias("mid_term_id"),
        F.col("target_sense_id").alias("middle_sense_id"),
        F.col("source_term").alias("first_term"), F.col("source_sense_id").alias("first_sense_id"),
        F.col("provenance_id").alias("first_provenance"), F.col("direction_code").alias("first_direction"),
    )
    sources = (
        firsts.select(*keys).distinct()
        .withColumn("word", F.col("mid_word"))
        .withColumn("language", F.col("mid_language"))
        .withColumn("target_language_filter", F.col("final_language"))
        .withColumn("sense_filter", F.lit(None).cast("string"))
    )
    seconds = _second_hops(corpus, sources, keys, catalogue).select(
        F.col("mid_word").alias("s_word"), F.col("mid_language").alias("s_language"),
        F.col("relation_code").alias("s_code"), F.col("final_language").alias("s_final"),
        F.col("branch").alias("s_branch"), F.col("anchor_term_id"),
        F.col("source_sense_id").alias("second_sense_id"), "target_term", "target_normalized",
        "target_language", "target_sense_id", "target_sense_count", "target_entry_count",
        "direction_code", "provenance_id", "source",
    )
    continuous = F.when(
        F.coalesce("first_sense_id", "middle_sense_id", "second_sense_id", "target_sense_id").isNull(),
        F.col("mid_term_id") == F.col("anchor_term_id"),
    ).otherwise(
        F.col("first_sense_id").isNotNull()
        & F.col("target_sense_id").isNotNull()
        & F.coalesce(F.col("middle_sense_id") == F.col("second_sense_id"), F.lit(False))
    )
    pairs = (
        firsts.join(
            seconds,
            (F.col("mid_word") == F.col("s_word"))
            & (F.col("mid_language") == F.col("s_language"))
            & (F.col("relation_code") == F.col("s_code"))
            & F.col("final_language").eqNullSafe(F.col("s_final"))
            & (F.col("branch") == F.col("s_branch"))
            & (F.col("first_provenance") == F.col("provenance_id"))
            & (F.col("first_direction") == F.col("direction_code")),
        )
        .filter(continuous)
        .filter(
            ~(
                (F.col("target_normalized") == F.col("word"))
                & (F.col("target_language") == F.col("language"))
            )
        )
    )
    # at most 64 first hops x 32 branches per request from here on
    sensed = F.col("first_sense_id").isNotNull()
    same_words = Window.partitionBy(
        Q, "mid_word", "mid_language", "target_normalized", "target_language"
    )
    backed = F.max(sensed.cast("int")).over(same_words) == 1
    scoped = pairs.withColumn(
        "scope_priority", F.when(sensed, 1).when(backed, 0).otherwise(2)
    )
    order = [
        "scope_priority",
        F.desc("target_sense_count"),
        F.desc("target_entry_count"),
        "target_language",
        "target_normalized",
        "target_term",
        F.asc_nulls_first("target_sense_id"),
        _preferred(F.col("direction_code"), F.col("relation_code")),
        "direction_code",
        "source",
        F.asc_nulls_first("first_sense_id"),
        "mid_word",
        F.asc_nulls_first("middle_sense_id"),
        F.asc_nulls_first("second_sense_id"),
        "mid_language",
        "first_term",
        "middle_term",
    ]
    ranked = scoped.withColumn("path_rank", F.row_number().over(Window.partitionBy(Q).orderBy(*order)))
    return ranked.withColumn("source_term", F.col("first_term")).withColumn(
        "source_sense_id", F.col("first_sense_id")
    )


def expand_frontier(
    corpus: Corpus,
    frontier: DataFrame,
    limits: DataFrame,
    expandable: DataFrame,
    reverse: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """One more hop from every frontier word whose language has a partition.

    ``frontier``(request_id, language, word, relation_code), ``limits``(request_id,
    limit), ``expandable``(language). Returns (rows, unexpanded(request_id, language)):
    languages without data are listed, never dropped silently; ``layout.unexpanded_reasons``
    says why.
    """
    nodes = frontier.select(Q, "language", "word", "relation_code").distinct()
    missing = (
        nodes.join(expandable.select("language"), "language", "left_anti").select(Q, "language").distinct()
    )
    ready = nodes.join(expandable.select("language"), "language", "left_semi").join(limits, Q)
    # one scan per distinct word, however many requests pass through it
    keys = ["language", "word", "relation_code"]
    orientation = 2 if reverse else 1
    stored = F.col("relation_code") if not reverse else inverse_relation(F.col("relation_code"))
    scans = (
        ready.select(*keys).distinct()
        .withColumn("asked_code", F.col("relation_code"))
        .withColumn("relation_code", stored)
        .withColumn("target_language_filter", F.lit(None).cast("string"))
        .withColumn("sense_filter", F.lit(None).cast("string"))
    )
    edges = anchored_edges(corpus, scans, ["language", "word", "asked_code"]).filter(
        F.col("orientation") == orientation
    )
    heads = top_k(
        edges, ["language", "word", "asked_code"], scan_order(), RELATION_SCAN_CEILING, rank="__head"
    ).select(
        F.col("language").alias("via_language"), F.col("word").alias("via_word"),
        F.col("asked_code").alias("relation_code"), "__head", "source_term", "source_sense_id",
        "target_term", "target_normalized", "target_language", "target_sense_id",
        "target_variant_rank", "target_sense_count", "target_entry_count", "target_spaces",
        "target_length", "stored_direction", "provenance_id",
    )
    reached = ready.withColumnRenamed("language", "via_language").withColumnRenamed("word", "via_word")
    joined = reached.join(heads, ["via_language", "via_word", "relation_code"]).filter(
        F.col("__head") <= F.col("limit")
    )
    merged = top_k(
        joined, [Q], [*scan_order(), "via_language", "via_word"], RELATION_SCAN_CEILING, F.col("limit"), "rank"
    )
    return merged.drop("__head", "limit"), missing


def synset_places(members: DataFrame) -> DataFrame:
    """Memberships whole: every distinct term of every synset with its 1-based place by term id."""
    distinct = members.select("synset_id", "term_id").distinct()
    return top_k(distinct, ["synset_id"], ["term_id"], None, rank="place")


def synonym_counts(members: DataFrame) -> DataFrame:
    """(sense_id, synonyms): the other distinct terms of each sense's synset, counted without pairing."""
    sizes = members.select("synset_id", "term_id").distinct().groupBy("synset_id").agg(
        F.count(F.lit(1)).alias("__terms")
    )
    return members.join(sizes, "synset_id").groupBy("sense_id").agg(
        F.sum(F.col("__terms") - 1).alias("synonyms")
    )


def synset_synonyms(members: DataFrame) -> DataFrame:
    """All synonyms of every sense: the other distinct terms of its synset, with 0-based positions.

    ``members``(synset_id, sense_id, term_id, part_of_speech). A synset of n terms gives each
    of its senses n - 1 rows; that is the stored table itself, and nothing bounds it. How many
    an answer reads is the matter of ``lookup.synonyms``. A target's position is its place in
    the synset, less one if the sense's own term precedes it.
    """
    places = synset_places(members)
    own = members.join(places, ["synset_id", "term_id"]).withColumnRenamed("place", "own_place")
    targets = places.select("synset_id", F.col("term_id").alias("target_term_id"), "place")
    after_own = (F.col("place") > F.col("own_place")).cast("int")
    return (
        own.join(targets, "synset_id")
        .filter(F.col("target_term_id") != F.col("term_id"))
        .withColumn("position", (F.col("place") - 1 - after_own).cast("bigint"))
        .select("sense_id", "target_term_id", "part_of_speech", "position")
    )
