"""Exact top-k inner products by a three-phase uniform threshold.

The dimensions are dealt to a few parts, so a score is the sum of one partial score per part
and every (part, candidate chunk) holds a local score list.
1. Each list gives its best entries; the entries named by any list are scored in full. The
   k-th best of these is a safe cutoff: k candidates reach it.
2. The cutoff goes out with the query blocks. A candidate that reaches it must have, in some
   part, at least the cutoff divided by the number of parts; lists give all such entries.
3. Sums of what was given bound every candidate; those whose bound reaches the cutoff and
   that lack a part are resolved by the lists of that part. The rest cannot be among the k best.

Equal vectors are one class, of which only the rows with the smallest ids can matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import land

SCALE = 1024
TOP = 10
PARTS = 2
CHUNK = 16_384
QUERY_BLOCK = 512
_NOTHING = -(1 << 62)


def whole_numbers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v (floor of scale times each component) of the vectors that take part.

    Vectors that are null or hold a null, NaN or infinite component are left out, and so are
    rows without a vec_id. Rows that repeat stay rows of their own. An empty vector takes part;
    its inner products are 0.
    """
    component = lambda x: x.cast("double")
    sound = F.forall("embedding", lambda x: F.coalesce(F.abs(component(x)) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(component(x)))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(component(x) * F.lit(float(scale))).cast("long")).alias("v"),
    )


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    column = column if isinstance(column, pa.Array) else column.chunk(0)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _partial_scores(left: pa.Table, right: pa.Table) -> np.ndarray:
    """Query by candidate matrix of partial scores, exact in integers."""
    candidates, queries = _matrix(left.column("x")), _matrix(right.column("x"))
    most = float(np.abs(candidates).max(initial=0)) * float(np.abs(queries).max(initial=0)) * candidates.shape[1]
    if most < 2.0**53:  # the products and sums are whole numbers that doubles hold exactly
        return (queries.astype(np.float64) @ candidates.T.astype(np.float64)).astype(np.int64)
    return queries @ candidates.T


_BEST = "qid long, id long"
_ENOUGH = "qid long, id long, partial long"
_GIVEN = "qid long, id long, part int, partial long"


def _local_best(top: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, qids = left.column("id").to_numpy(), right.column("qid").to_numpy()
        if not len(ids) or not len(qids):
            return pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64())})
        scores = _partial_scores(left, right)
        k = min(top, len(ids))
        best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        return pa.table({"qid": np.repeat(qids, k), "id": ids[best.ravel()]})

    return run


def _sufficient(parts: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, qids = left.column("id").to_numpy(), right.column("qid").to_numpy()
        if not len(ids) or not len(qids):
            return pa.table({k: pa.array([], pa.int64()) for k in ("qid", "id", "part", "partial")}).cast(
                pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("part", pa.int32()), ("partial", pa.int64())])
            )
        scores = _partial_scores(left, right)
        cutoff = right.column("cutoff").to_numpy()
        query, candidate = np.nonzero(scores >= -(-cutoff // parts)[:, None])
        part = np.full(len(query), left.column("part")[0].as_py(), np.int32)
        return pa.table({"qid": qids[query], "id": ids[candidate], "part": part, "partial": scores[query, candidate]})

    return run


def _missing(left: pa.Table, right: pa.Table) -> pa.Table:
    """Partial scores of the candidates that each query still wants of this list."""
    if not left.num_rows or not right.num_rows:
        return pa.table({k: pa.array([], pa.int64()) for k in ("qid", "id", "partial")})
    ids, wanted = left.column("id").to_numpy(), right.column("wanted").combine_chunks()
    wanted = wanted if isinstance(wanted, pa.Array) else wanted.chunk(0)
    order = np.argsort(ids)
    flat = wanted.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(wanted)), np.diff(wanted.offsets.to_numpy()))
    place = order[np.searchsorted(ids, flat, sorter=order)]
    candidates, queries = _matrix(left.column("x")), _matrix(right.column("x"))
    partial = np.empty(len(flat), np.int64)
    for low in range(0, len(flat), CHUNK):
        part = slice(low, low + CHUNK)
        partial[part] = np.einsum("ij,ij->i", candidates[place[part]], queries[row[part]])
    return pa.table({"qid": right.column("qid").to_numpy()[row], "id": flat, "partial": partial})


def _full_score() -> Column:
    return F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0).cast("long"), lambda a, b: a + b)


def exact_top_k(vectors: DataFrame, queries: DataFrame, top: int = TOP, parts: int = PARTS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` best inner products of each query.

    ``vectors(vec_id, v)`` and ``queries(query_id, v)`` hold whole-number vectors as made by
    ``whole_numbers``; shorter vectors count as padded with zeros. Ties go to the smaller
    vec_id; a query meets every row but one that has its own id and vector, which is its own
    row, so a row that repeats it is met. Queries that repeat are each answered. With fewer
    candidates all are returned. Scores are exact as long as they fit 64 bits.
    """
    reach = top + 1  # one may be the query itself
    width = vectors.agg(F.max(F.size("v"))).first()[0] or 1
    padded = lambda: F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v")))
    rows = land(vectors.withColumn("v", padded()), "vectors")
    # the least ids of each class; a window with a rank limit keeps no more on the way
    order = Window.partitionBy("v").orderBy("vec_id")
    first = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= reach)
    classes = land(
        # the least vec_id does not name a class: rows of one id may hold different vectors
        first.groupBy("v").agg(F.min("vec_id").alias("least"), F.array_sort(F.collect_list("vec_id")).alias("members"))
        .withColumn("id", F.monotonically_increasing_id()),
        "vector_classes",
    )
    asked = queries.withColumn("v", padded()).join(classes.select("v", F.col("id").alias("qid")), "v")
    asked = land(asked.select("query_id", "qid", "v"), "asked")
    distinct = land(asked.select("qid", F.col("v").alias("w")).dropDuplicates(["qid"]), "queries")
    chunks, blocks = -(-classes.count() // CHUNK) or 1, -(-distinct.count() // QUERY_BLOCK) or 1
    step = -(-width // parts)

    def sliced(frame: DataFrame, vector: str) -> DataFrame:
        """A row per part, with that part's components."""
        part = F.explode(F.sequence(F.lit(0), F.lit(-(-width // step) - 1))).alias("part")
        return frame.withColumn("part", part).withColumn("x", F.slice(vector, F.col("part") * step + 1, step)).drop(vector)

    def spread(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    count = -(-width // step)
    keys = ["part", "chunk", "block"]
    held = sliced(classes.select("id", "v"), "v").withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int"))
    held = held.withColumn("block", spread(blocks))

    def put(frame: DataFrame) -> DataFrame:
        dealt = sliced(frame, "w").withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
        return dealt.withColumn("chunk", spread(chunks))

    # 1: the best of every list, scored in full
    best = held.groupBy(*keys).cogroup(put(distinct).groupBy(*keys)).applyInArrow(_local_best(reach), _BEST).distinct()
    known = land(
        best.join(classes.select("id", "v"), "id").join(distinct, "qid").select("qid", "id", _full_score().alias("score")),
        "known",
    )
    nth = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score")))
    cutoffs = known.withColumn("nth", nth).where(F.col("nth") == reach).select("qid", F.col("score").alias("cutoff"))
    queried = land(
        distinct.join(cutoffs, "qid", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(_NOTHING))), "cutoffs"
    )
    # 2: sufficient entries
    given = held.groupBy(*keys).cogroup(put(queried).groupBy(*keys)).applyInArrow(_sufficient(count), _GIVEN)
    sums = given.groupBy("qid", "id").agg(
        F.sum("partial").alias("sum"), F.count(F.lit(1)).alias("seen"), F.collect_set("part").alias("from")
    )
    # 3: a part that was not given holds less than its share of the cutoff
    share = F.ceil(F.col("cutoff") / F.lit(count)) - 1
    # written, since known sums and missing parts are both read from it
    hopeful = land(
        sums.join(queried.select("qid", "cutoff"), "qid")
        .where(F.col("sum") + (F.lit(count) - F.col("seen")) * share >= F.col("cutoff"))
        .select("qid", "id", "sum", "from"),
        "hopeful",
    )
    # the lists themselves tell the missing parts: a query brings along which candidates it wants
    every = F.sequence(F.lit(0), F.lit(count - 1))
    lacking = hopeful.select("qid", "id", F.explode(F.array_except(every, "from")).alias("part"))
    chunk = F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("chunk")
    wanted = lacking.groupBy("qid", "part", chunk).agg(F.collect_list("id").alias("wanted"))
    dealt = sliced(queried.select("qid", "w"), "w").withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
    asking = dealt.join(wanted, ["qid", "part"])
    resolved = held.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(_missing, _ENOUGH)
    scored = hopeful.select("qid", "id", "sum").union(resolved).groupBy("qid", "id").agg(F.sum("sum").alias("score"))
    scored = scored.join(classes.select("id", "least"), "id")
    leading = Window.partitionBy("qid").orderBy(F.desc("score"), "least")
    leaders = scored.withColumn("nth", F.row_number().over(leading)).where(F.col("nth") <= reach)
    members = leaders.join(classes.select("id", "members"), "id").select(
        "qid", "id", "score", F.explode("members").alias("vec_id")
    )
    within = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    answers = members.withColumn("nth", F.row_number().over(within)).where(F.col("nth") <= reach).groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score", "id"))).alias("found")
    )
    own = F.array_position(
        F.transform("found", lambda x: (x["vec_id"] == F.col("query_id")) & (x["id"] == F.col("qid"))), F.lit(True)
    ).cast("int")
    others = F.when(own == 0, F.slice("found", 1, top)).otherwise(
        F.slice(F.concat(F.slice("found", F.lit(1), F.greatest(own - 1, F.lit(0))), F.slice("found", own + 1, F.lit(reach))), 1, top)
    )
    met = asked.select("query_id", "qid").join(answers, "qid").select("query_id", F.posexplode(others).alias("place", "hit"))
    return met.select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"),
        F.col("hit.score").alias("score"),
    )
