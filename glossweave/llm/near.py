"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

1. Each text becomes its set of hashed word n-grams, a MinHash signature cut into bands, and
   a digest of the set. Texts with equal sets are one class, seen through one row from here.
2. Classes are shuffled on their band hashes. Within a bucket, short sketches of the
   signatures tie members to earlier ones that may be alike, as a forest: a bucket of n
   members emits n - 1 ties at most, never its pairs.
3. Tied classes form coarse groups. A group's texts are shipped to it once, in blocks; each
   pair of blocks counts all shared n-grams of its members as one matrix product and gives
   back link counts and a forest of the links, again a row per member and no pairs.
4. The forests of all blocks give the connected classes.

Every link of the result is exact. The bands are chosen so that a pair at the threshold
shares a bucket with the wanted probability.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import arrow_map, land, mixed, range_hashes, row_slices, shingle_hashes, text_bytes

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
#: Most hash functions of a signature; band and row counts follow from it and from the recall.
HASHES = 160
SKETCH = 64
#: Members of a bucket that one task compares with each other; larger buckets are salted.
BUCKET = 500
#: Members and n-grams of one block of a coarse group.
BLOCK_MEMBERS = 512
BLOCK_GRAMS = 500_000
_COLUMNS = 8_192
#: Slots of the filter in front of the join that fetches texts; bounds what it broadcasts.
SLOTS = 1 << 20


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows per band): the most rows, hence fewest chance meetings, that reach the recall."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        meet = threshold**rows
        bands = 1 if meet >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-meet))
        if bands * rows > hashes:
            break
        best = (bands, rows)
    return best


def gram_sets(column: pa.Array, words: int = WORDS) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Blocks of rows: first row, and per row the sorted distinct hashes of its word n-grams.

    Words are what white space (blank, tab, line and page breaks) separates, lower-cased. A
    text with fewer words than ``words`` has all of them as its one n-gram, an empty or null
    one has none.
    """
    raw, offsets = text_bytes(pc.utf8_lower(column))
    for first, last in row_slices(offsets):
        own, bounds = raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        inside = np.concatenate(([False], (own != 32) & ((own < 9) | (own > 13)), [False]))
        edge = inside[1:] != inside[:-1]
        edge[bounds] |= inside[1:][bounds] & inside[:-1][bounds]
        starts = np.flatnonzero(edge & inside[1:])
        ends = np.flatnonzero(edge & inside[:-1])
        hashes = range_hashes(own, starts, ends)
        split = np.searchsorted(starts, bounds)
        grams = shingle_hashes(hashes, words)
        sets = []
        for a, b in zip(split[:-1].tolist(), split[1:].tolist(), strict=True):
            if b - a >= words:
                sets.append(np.unique(grams[a : b - words + 1]))
            else:
                sets.append(mixed(shingle_hashes(hashes[a:b], b - a)) if b > a else np.empty(0, np.uint64))
        yield first, sets


def _multipliers(count: int) -> np.ndarray:
    return mixed(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signature(grams: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for first in range(0, len(grams), 512):
        np.minimum(least, (multipliers[:, None] * grams[None, first : first + 512]).min(axis=1), out=least)
    return least


_PRINTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("row", T.LongType(), False),
        T.StructField("text_hash", T.LongType(), False),
        T.StructField("grams", T.LongType(), False),
        T.StructField("set_key", T.BinaryType(), False),
        T.StructField("bands", T.ArrayType(T.LongType(), False), False),
        T.StructField("sketch", T.BinaryType(), False),
    ]
)


def _printed(bands: int, rows: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = _multipliers(max(bands * rows, SKETCH))
        for batch in batches:
            for first, sets in gram_sets(batch.column(3), words):
                part = batch.slice(first, len(sets))
                keys, marks, sketches = [], [], []
                for row, grams in zip(part.column(1).to_pylist(), sets, strict=True):
                    if not len(grams):  # nothing to share: a class of its own
                        keys.append(b"row" + row.to_bytes(8, "little"))
                        marks.append([])
                        sketches.append(bytes(SKETCH))
                        continue
                    keys.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
                    least = mixed(signature(grams, multipliers))
                    number = band = np.arange(bands, dtype=np.uint64)
                    for k in range(rows):
                        band = mixed(band * np.uint64(31) + least[k : bands * rows : rows] + number)
                    marks.append(band.astype(np.int64))
                    sketches.append((least[:SKETCH] >> np.uint64(56)).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), part.column(2), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(keys, pa.binary()), pa.array(marks, pa.list_(pa.int64())), pa.array(sketches, pa.binary()),
                    ],
                    names=_PRINTS.names,
                )

    return run


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _alike(sketches: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Estimated similarity of one sketch with many."""
    return ((sketches == one).mean(axis=1) - 1 / 256) * (256 / 255)


def _tie(least: float, lead: float):
    """Forest of ties within each (key, salt), whose rows come one after the other.

    A member joins earlier leaders that look ``least`` alike, and becomes a leader itself if
    none looks ``lead`` alike. If two members are within the threshold of each other, each
    is a leader or close to one, and the other is tied to that one too (triangle inequality
    of the Jaccard distance). Open state is one bucket's leaders.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, members, leaders, sketches, parent = None, [], [], np.empty((0, SKETCH), np.uint8), []

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        for batch in batches:
            out: list[tuple[int, int, int, bool]] = []
            columns = [batch.column(k).to_pylist() for k in range(4)]
            for key, salt, row, sketch in zip(*columns, strict=True):
                if (key, salt) != current:
                    current, members, leaders, parent = (key, salt), [], [], []
                    sketches = np.empty((64, SKETCH), np.uint8)
                own = np.frombuffer(sketch, np.uint8)
                close = _alike(sketches[: len(leaders)], own) if leaders else np.empty(0)
                at = len(members)
                members.append(row)
                parent.append(at)
                tied = False
                for k in np.flatnonzero(close >= least):
                    a, b = root(leaders[k]), root(at)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                        out.append((key, members[leaders[k]], row, False))
                        tied = True
                if not len(close) or close.max() < lead:
                    if len(leaders) == len(sketches):
                        sketches = np.concatenate((sketches, np.empty_like(sketches)))
                    sketches[len(leaders)] = own
                    leaders.append(at)
                    out.append((key, row, row, True))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[k] for o in out], pa.bool_() if k == 3 else pa.int64()) for k in range(4)],
                    names=["key", "a", "b", "leads"],
                )

    return run


_TIES = "key long, a long, b long, leads boolean"


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``: root is the least node of its component.

    Every node points to its least neighbour; pointers are followed to their roots by
    doubling, edges are rewritten to roots, and what is left is done again. Each turn at
    least halves the nodes that are left, so the number of turns is logarithmic. All tables
    are narrow, distributed and written down between turns.
    """
    edges = land(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        point = land(both.groupBy("node").agg(F.least("node", F.min("other")).alias("root")), "pointers")
        while True:
            up = point.select(F.col("node").alias("root"), F.col("root").alias("upper"))
            doubled = land(point.join(up, "root").select("node", F.col("upper").alias("root"), F.col("root").alias("was")), "pointers")
            point = doubled.select("node", "root")
            if doubled.where("root <> was").isEmpty():
                break
        if found is None:
            found = point
        else:
            nxt = point.select(F.col("node").alias("root"), F.col("root").alias("upper"))
            found = land(
                found.join(nxt, "root", "left").select("node", F.coalesce("upper", "root").alias("root")), "roots"
            )
        left = point.toDF("a", "ra")
        right = point.toDF("b", "rb")
        edges = land(
            edges.join(left, "a").join(right, "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            "edges",
        )
    return found if found is not None else edges.toDF("node", "root")


def block_similar(
    left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float
) -> Iterator[tuple[int, int, np.ndarray]]:
    """Boolean matrix of the pairs whose n-gram sets have Jaccard at or over the threshold.

    Counts of shared n-grams are exact: small integers in a float product, added up over
    slices of the n-grams that at least two members hold.
    """
    sets = left + (right or [])
    grams, member = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, gram, held = np.unique(grams, return_inverse=True, return_counts=True)
    shared = held[gram] > 1
    gram, member = gram[shared], member[shared]
    order = np.argsort(gram, kind="stable")
    gram, member = gram[order], member[order]
    fresh = np.concatenate(([True], gram[1:] != gram[:-1])) if len(gram) else np.empty(0, bool)
    column = np.cumsum(fresh) - 1
    count = np.zeros((len(left), len(right or left)), np.float64)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, [first, first + _COLUMNS])
        matrix = np.zeros((len(sets), _COLUMNS), np.float32)
        matrix[member[a:b], column[a:b] - first] = 1
        one = matrix[: len(left)]
        count += one @ (matrix[len(left) :] if right else one).T
    sizes = np.array([len(s) for s in sets], np.float64)
    total = sizes[: len(left), None] + (sizes[len(left) :] if right else sizes)[None, :] - count
    # similarities are fractions of small integers: the slack only absorbs rounding of the product
    return count >= threshold * total - 1e-9


_LINKS = "row long, partners long, linked long, parent long"


def _verify(threshold: float, words: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.select(["row", "side", "copies", "set_key", "text"]).combine_chunks()
        first_of = {}
        for k, row in enumerate(rows.column("row").to_pylist()):  # a repeated row joins itself more than once
            first_of.setdefault(row, k)
        rows = rows.take(pa.array(sorted(first_of.values())))
        sets = [s for _, part in gram_sets(rows.column("text").combine_chunks(), words) for s in part]
        ids = rows.column("row").to_numpy()
        side = rows.column("side").to_numpy()
        copies = rows.column("copies").to_numpy()
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        parent = np.arange(len(ids))
        partners, linked = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        within, similar = key[1].as_py() == key[2].as_py(), None
        if one.size and two.size:
            similar = block_similar([sets[k] for k in one], [sets[k] for k in two], threshold)
            a, b = one, two
        elif within:
            similar = block_similar([sets[k] for k in one], None, threshold)
            np.fill_diagonal(similar, False)
            a = b = one
        if similar is not None:
            partners[a] += similar.sum(axis=1)
            linked[a] += similar @ copies[b]
            if two.size:
                partners[b] += similar.sum(axis=0)
                linked[b] += similar.T @ copies[a]
            # least reachable member of each, by spreading minima over the matrix
            while True:
                before = parent.copy()
                for src, dst, m in ((a, b, similar), (b, a, similar.T)):
                    reach = np.where(m, parent[dst][None, :], len(ids)).min(axis=1, initial=len(ids))
                    parent[src] = np.minimum(parent[src], reach)
                if (parent == before).all():
                    break
        return pa.table({"row": ids, "partners": partners, "linked": linked, "parent": ids[parent]})

    return run


@dataclass
class NearJoin:
    """Result of the join: rows with their classes, and the class of each set."""

    prints: DataFrame  # doc_id, row, text_hash, set_key of every row
    classes: DataFrame  # set_key, rep, rep_id, copies
    links: DataFrame  # rep, root (class by links), partners, linked


def near_join(
    docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL, hashes: int = HASHES
) -> NearJoin:
    """Join ``docs(doc_id, text)`` with itself on Jaccard of word n-grams at or over the threshold.

    Null and empty texts have no n-grams and no links. A null doc_id orders after all others;
    repeated rows are copies of one another. Other columns are ignored.
    """
    bands, rows = choose_bands(threshold, recall, hashes)
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
        _text_hash().alias("text_hash"), F.col("text").cast("string").alias("text"),
    )
    prints = land(source.transform(arrow_map, _printed(bands, rows, words), _PRINTS), "prints")
    first = F.struct(F.col("doc_id").isNull().alias("gone"), "doc_id", "row", "text_hash", "grams", "bands", "sketch")
    classes = land(
        prints.groupBy("set_key").agg(F.min(first).alias("r"), F.count(F.lit(1)).alias("copies")).select(
            "set_key", F.col("r.row").alias("rep"), F.col("r.doc_id").alias("rep_id"), "copies",
            F.col("r.text_hash").alias("text_hash"), F.col("r.grams").alias("grams"),
            F.col("r.bands").alias("bands"), F.col("r.sketch").alias("sketch"),
        ),
        "classes",
    )
    # buckets with company, salted where they are large
    met = classes.select("rep", F.explode("bands").alias("key"))
    many = met.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = met.join(many, "key").select(
        "key", "rep", "n", F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / BUCKET)).alias("salt")
    )
    met = land(met.join(classes.select("rep", "sketch"), "rep"), "buckets")

    def tied(bucketed: DataFrame, least: float, lead: float) -> DataFrame:
        dealt = bucketed.select("key", "salt", "rep", "sketch").repartition("key", "salt")
        return land(dealt.sortWithinPartitions("key", "salt", "rep").transform(arrow_map, _tie(least, lead), _TIES), "ties")

    # a pair at the threshold d apart: a leader within (1 - d) / 2 of one is within 1.5 (1 - d) of the other
    apart = 1 - threshold
    first_ties = tied(met, 1 - 2.5 * apart, 1 - 1.25 * apart)
    salted = met.where(F.col("n") > BUCKET).join(
        first_ties.where("leads").select("key", F.col("a").alias("rep")), ["key", "rep"], "left_semi"
    )
    across = tied(salted.withColumn("salt", F.lit(0).cast("long")), max(0.05, 1 - 3.75 * apart), 1 - 1.25 * apart)
    coarse = components(first_ties.union(across).where("NOT leads").select("a", "b"))

    # each coarse group in blocks, each pair of blocks once
    member = coarse.withColumnRenamed("node", "rep").join(
        classes.select("rep", "rep_id", "set_key", "copies", "text_hash", "grams"), "rep"
    )
    sizes = member.groupBy("root").agg(
        F.greatest(
            F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS), F.ceil(F.sum("grams") / BLOCK_GRAMS)
        ).cast("int").alias("blocks")
    )
    member = land(
        member.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("rep", "root"), F.col("blocks")).cast("int")),
        "members",
    )
    asked = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id "), _text_hash().alias("hash "),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    wanted = member.withColumn("id ", F.coalesce("rep_id", F.lit(-1))).withColumnRenamed("text_hash", "hash ")
    # most texts are in no group: those whose slot no member has are not shuffled at all;
    # there are at most SLOTS of them to broadcast, and the join that follows is exact
    slot = F.pmod(F.xxhash64("id ", "hash "), F.lit(SLOTS)).alias("slot ")
    slots = wanted.select(slot).distinct()
    asked = asked.withColumn("slot ", slot).join(F.broadcast(slots), "slot ", "left_semi").drop("slot ")
    # rows that repeat id and hash hold the same text: one of them is enough
    asked = asked.groupBy("id ", "hash ").agg(F.first("text").alias("text"))
    texts = wanted.join(asked.hint("merge"), ["id ", "hash "])
    paired = texts.select(
        "root", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), F.col("rep").alias("row"),
        "copies", "set_key", "text",
    ).select(
        "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        (F.col("block") > F.col("other")).cast("int").alias("side"), "row", "copies", "set_key", "text",
    )
    verified = land(paired.groupBy("root", "i", "j").applyInArrow(_verify(threshold, words), _LINKS), "links")
    roots = components(verified.select(F.col("parent").alias("a"), F.col("row").alias("b")))
    counts = verified.groupBy("row").agg(F.sum("partners").alias("partners"), F.sum("linked").alias("linked"))
    links = land(
        counts.withColumnRenamed("row", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
            "rep", F.coalesce("root", "rep").alias("root"), "partners", "linked"
        ),
        "classes",
    )
    return NearJoin(
        prints.select("doc_id", "row", "text_hash", "set_key"),
        classes.select("set_key", "rep", "rep_id", "copies"), links,
    )


def near_classes(joined: NearJoin) -> DataFrame:
    """One row per document: doc_id, class_id, rep_id, n_links, n_partners, kept.

    ``class_id`` is the least doc_id among all documents connected by links, ``rep_id`` the
    least among those with the same n-gram set. ``n_links`` counts the other documents at or
    over the threshold, copies included, ``n_partners`` the different sets among them.
    ``kept`` marks one row of each class, the one with the class's least doc_id.
    """
    own = joined.classes.join(joined.links, "rep", "left").select(
        "set_key", "rep", "rep_id", F.coalesce("root", "rep").alias("root"),
        (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
        F.coalesce("partners", F.lit(0)).alias("n_partners"),
    )
    least = own.groupBy("root").agg(
        F.min(F.struct(F.col("rep_id").isNull().alias("gone"), "rep_id", "rep")).alias("first")
    )
    own = land(own.join(least, "root").drop("root"), "own")
    return joined.prints.join(own, "set_key").select(
        "doc_id", F.col("first.rep_id").alias("class_id"), "rep_id", "n_links", "n_partners",
        (F.col("row") == F.col("first.rep")).alias("kept"), "text_hash",
    )


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each class of linked documents; columns stay as they are.

    Documents without links stay, those without a text among them. Of a class the document
    with the least doc_id stays, null last; of rows that repeat id and text one.
    """
    keep = near_classes(near_join(docs, threshold)).where("kept").select(
        F.col("doc_id").alias("id "), F.col("text_hash").alias("hash ")
    )
    marked = docs.withColumn("own ", _text_hash())
    stays = marked.join(keep, F.col("doc_id").eqNullSafe(F.col("id ")) & (F.col("own ") == F.col("hash ")))
    return stays.dropDuplicates(["doc_id", "own "]).select(*[docs[f"`{c}`"] for c in docs.columns])
