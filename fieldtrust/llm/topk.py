"""Exact top-k inner products by no-random-access aggregation over sorted lists.

A block of vectors is kept as one list per component, sorted by value. For a query, a component's list is
read from its large end where the query's component is positive and from its small end where it is
negative. After each round, what has been read bounds every score from both sides: components
not yet seen of a vector lie between the list's other end and the last value read. Vectors whose
upper bound is below the k-th lower bound cannot qualify any more; reading stops when no more than a few
times k are left (or the lists end), and the scores of those are resolved from the rest of their components.

All queries of a block read the same depth per round, so a round is two matrix products. Bounds hold
integers that double precision represents exactly, which is checked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldtrust.llm.common import materialised, table

K = 20
SCALE = 64
#: Vectors and queries in a block.
BLOCK, QUERIES_AT_ONCE = 4096, 512
#: Parts of the lists read by the end of each round, and vectors per wanted one at which a query stops reading.
DEPTHS, FEW = (0.5, 0.75, 0.9, 1.0), 10


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and items = floor(scale * component) of ``vectors``; null vectors, and such with null or non-finite components, go."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(F.forall("embedding", lambda x: F.coalesce(finite(x), F.lit(False))))
    return rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("items"))


class SortedLists:
    """The components of a block as sorted lists, read a depth at a time."""

    def __init__(self, items: np.ndarray):
        self.items = items
        self.order = np.argsort(items, axis=0, kind="stable")
        self.ascending = np.take_along_axis(items, self.order, axis=0)
        self.rank = np.empty_like(self.order)
        np.put_along_axis(self.rank, self.order, np.arange(len(items))[:, None], axis=0)

    def bounds(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each vector's components: (lowest, highest) they can be when ``depth`` of each list is read from the top, and from the bottom."""
        n, rank = len(self.items), self.rank
        from_top, from_bottom = rank >= n - depth, rank < depth
        last_top, last_bottom = self.ascending[n - depth], self.ascending[depth - 1]
        return (
            np.where(from_top, self.items, self.ascending[0]), np.where(from_top, self.items, last_top),
            np.where(from_bottom, self.items, last_bottom), np.where(from_bottom, self.items, self.ascending[-1]),
        )


def search(
    lists: SortedLists, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int = K, rows: np.ndarray | None = None
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query, ids and scores of the best k of the block; equal scores by smaller id.

    ``rows`` are the block's row numbers (its ids, if not given), of which a query's ``own`` is left out.
    """
    n, exact = len(ids), lists.items
    rows = ids if rows is None else rows
    positive, negative = np.maximum(queries, 0), np.minimum(queries, 0)
    alive = own[:, None] != rows[None, :]
    reading = np.arange(len(queries))
    for part in DEPTHS:
        depth = max(1, min(n, int(np.ceil(n * part))))
        if depth == n or not len(reading):
            break
        low_top, high_top, low_bottom, high_bottom = lists.bounds(depth)
        # A negative factor turns the order round: what is highest from the bottom is lowest for the score.
        lower = positive[reading] @ low_top.T + negative[reading] @ high_bottom.T
        upper = positive[reading] @ high_top.T + negative[reading] @ low_bottom.T
        candidates = alive[reading]
        lower[~candidates] = -np.inf
        wanted = min(k, n)
        least = np.partition(lower, n - wanted, axis=1)[:, n - wanted]
        candidates &= upper >= least[:, None]
        alive[reading] = candidates
        reading = reading[candidates.sum(1) > FEW * k]
    # What is left to be read of the lists settles the scores of the candidates.
    resolved = np.full((len(queries), n), -np.inf)
    if len(reading):
        resolved[reading] = queries[reading] @ exact.T
    for q in np.setdiff1d(np.arange(len(queries)), reading):
        left = np.flatnonzero(alive[q])
        resolved[q, left] = exact[left] @ queries[q]
    resolved[~alive] = -np.inf
    out = []
    for q in range(len(queries)):
        left = np.flatnonzero(alive[q])
        scores = resolved[q, left]
        best = np.lexsort((ids[left], -scores))[:k]
        out.append((ids[left][best], scores[best]))
    return out


def _search(k: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(_: tuple, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        kinds = dict.fromkeys(("query", "query_id", "vec_id", "score"), pa.int64())
        empty = pa.table({n: pa.array([], t) for n, t in kinds.items()})
        if not vectors.num_rows or not queries.num_rows:
            return empty

        def block(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            items = rows.column(5).combine_chunks()
            return rows.column(3).to_numpy(), rows.column(4).to_numpy(), items.flatten().to_numpy().reshape(rows.num_rows, -1).astype("f8")

        (rows, ids, items), (own, asked, factors) = block(vectors), block(queries)
        if items.shape[1] == 0:
            items, factors = np.zeros((len(ids), 1)), np.zeros((len(asked), 1))
        if np.abs(items).max() * np.abs(factors).max() * items.shape[1] >= 2**53:
            raise ValueError("components are too large for exact scores")
        lists, found = SortedLists(items), []
        for at in range(0, len(asked), QUERIES_AT_ONCE):
            part = slice(at, at + QUERIES_AT_ONCE)
            for row, query, (near, scores) in zip(own[part], asked[part], search(lists, ids, factors[part], own[part], k, rows)):
                found.append((np.full(len(near), row), np.full(len(near), query), near, scores.astype("i8")))
        if not found:
            return empty
        return pa.table({n: pa.array(np.concatenate(c), t) for (n, t), c in zip(kinds.items(), zip(*found))})

    return run


def top_k(vectors: DataFrame, queries: Callable[[Column], Column], k: int = K, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the k best other rows of ``vectors`` (vec_id, items) for each row ``queries`` picks by id.

    Vectors are dealt evenly over blocks by their row numbers, queries over groups; each pair of a block
    and a query group is one task's work, and k rows per query leave it. Only vectors of the same length
    as the query are compared. Repeated rows, also of one id, are rows of their own: each is a query where its id is
    picked, and a candidate of all queries but itself.
    """
    rows = materialised(vectors.select("vec_id", "items", F.size("items").alias("_width"), F.monotonically_increasing_id().alias("row")), "vectors")
    counts = rows.groupBy("_width").agg(F.count("*").alias("_n"), F.count_if(queries(F.col("vec_id"))).alias("_q"))
    blocks = F.ceil(F.col("_n") / block).cast("int")
    groups = F.greatest(F.ceil(F.col("_q") / block).cast("int"), F.lit(1))
    # A row per vector length.
    sized = counts.select("_width", blocks.alias("_blocks"), groups.alias("_groups"))
    dealt = rows.join(F.broadcast(sized), "_width")
    number = lambda seed, n: F.pmod(F.xxhash64("row", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    stored = dealt.withColumn("_block", number(1, "_blocks")).withColumn("_group", every("_groups"))
    asked = dealt.where(queries(F.col("vec_id"))).withColumn("_group", number(2, "_groups")).withColumn("_block", every("_blocks"))
    place, columns = ["_width", "_block", "_group"], ["_width", "_block", "_group", "row", "vec_id", "items"]
    # The two sides come from one table, so the queries' columns get names of their own.
    asked = asked.select(*[F.col(c).alias(f"{c}_asked") for c in columns])
    found = stored.select(*columns).groupBy(*place).cogroup(asked.groupBy(*[f"{c}_asked" for c in place])).applyInArrow(
        _search(k), "query long, query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return top_k(vectors, lambda vec_id: vec_id % 20 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_top_k": op2_top_k}

ORACLES = {
    "op2_top_k": """
WITH vectors AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS items FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.r, q.vec_id AS query_id, v.vec_id, list_inner_product(q.items, v.items)::BIGINT AS score
    FROM vectors q JOIN vectors v ON q.r <> v.r AND len(q.items) = len(v.items)
    WHERE q.vec_id % 20 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
}
