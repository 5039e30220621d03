"""Hard negatives of anchors, found with bounds along a spanning tree of the anchors.

Score is the integer inner product. Two anchors that lie close have similar scores with every row: for a parent p, its
child c and a row x, |c·x - p·x| is at most |c - p| |x|. The anchors of a group, with the origin as root (which scores
0 with everything), are joined by a minimum spanning tree. Going down the tree, a row's bounds at the parent, widened by
edge length times the row's norm, bound its score at the child; only rows whose bounds overlap what the child looks
for are scored. Rows not scored hand their bounds on, rows that are scored start the next edge exactly.

Positives are looked for above the k-th best lower bound, negatives inside the positives' score windows. Both run over
pairs of a block of rows and a group of anchors, and only the best few rows per anchor leave a pair.

Bounds are floating-point, scores integers that double precision holds exactly (which is checked), so a slack of one
half makes up for rounding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldtrust.llm.common import materialised, table

SCALE = 256
#: Positives of an anchor and negatives of a positive.
POSITIVES, NEGATIVES = 5, 5
#: A negative's score in percent of the positive's, at least and at most.
WINDOW = (80, 100)
#: Rows in a block, anchors in a group.
BLOCK, GROUP = 8192, 1024
SLACK = 0.5


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and items = floor(scale * component). Rows with a null id, label or vector or with null or non-finite components go."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    whole = F.forall("embedding", lambda x: F.coalesce(finite(x), F.lit(False)))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(whole)
    return rows.select("vec_id", F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("items"))


class AnchorTree:
    """A minimum spanning tree of anchors and the origin, walked from the origin.

    ``steps`` are (anchor, its parent or -1 for the origin, edge length, whether it is the parent's last child, whether
    it has children). Children come in the order of their subtrees' sizes, so that the bounds of no more than
    log2(anchors) parents are kept at a time.
    """

    def __init__(self, anchors: np.ndarray):
        n = len(anchors)
        square = np.einsum("ij,ij->i", anchors, anchors)
        parent, length = np.full(n, -1), np.sqrt(square)
        open_, children = np.ones(n, bool), [[] for _ in range(n + 1)]
        order = []
        for _ in range(n):
            near = int(np.argmin(np.where(open_, length, np.inf)))
            open_[near] = False
            order.append(near)
            children[parent[near]].append(near)
            # Sums of integers, so exact below the root.
            edge = np.sqrt(square + square[near] - 2 * (anchors @ anchors[near]))
            closer = open_ & (edge < length)
            parent[closer], length[closer] = near, edge[closer]
        size = np.ones(n + 1, "i8")
        for anchor in reversed(order):
            size[parent[anchor]] += size[anchor]
        self.steps: list[tuple[int, int, float, bool, bool]] = []
        waiting = [(-1, False)]
        while waiting:
            node, last = waiting.pop()
            below = sorted(children[node], key=lambda c: size[c], reverse=True)
            # The smallest subtree is on top of the stack; the largest is last, when its parent can go.
            waiting.extend((c, i == 0) for i, c in enumerate(below))
            if node >= 0:
                self.steps.append((node, int(parent[node]), float(length[node]), last, bool(below)))


def walk(anchors: np.ndarray, rows: np.ndarray, wanted: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each anchor: its number, the rows that ``wanted(anchor, lower, upper)`` picks (a mask) and their exact scores."""
    norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    bounds = {-1: (np.zeros(len(rows)), np.zeros(len(rows)))}
    for anchor, parent, edge, last, inner in AnchorTree(anchors).steps:
        lower, upper = bounds[parent]
        if last:
            del bounds[parent]
        reach = edge * norms
        lower, upper = lower - reach, upper + reach
        at = np.flatnonzero(wanted(anchor, lower, upper))
        scores = rows[at] @ anchors[anchor]
        lower[at] = upper[at] = scores
        if inner:
            bounds[anchor] = lower, upper
        yield anchor, at, scores


def nearest(anchors: np.ndarray, own: np.ndarray, rows: np.ndarray, keys: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each anchor, the k rows of highest score (ties by id) besides the anchor's own row, and their scores."""

    def wanted(anchor: int, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        others = keys != own[anchor]
        floor = np.where(others, lower, -np.inf)
        least = np.partition(floor, len(floor) - k)[len(floor) - k] if len(floor) > k else -np.inf
        return others & (upper + SLACK >= least - SLACK)

    for anchor, at, scores in walk(anchors, rows, wanted):
        best = np.lexsort((ids[at], -scores))[:k]
        yield anchor, at[best], scores[best]


def between(
    anchors: np.ndarray, labels: np.ndarray, positives: list[np.ndarray], rows: np.ndarray, row_labels: np.ndarray, ids: np.ndarray, k: int, window: tuple[int, int]
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each anchor and each of its positive scores, the k best rows of other labels in its window, and their scores."""
    low, high = window
    # Integers s with low * p <= 100 * s <= high * p.
    spans = [(-((-low * p.astype("i8")) // 100), high * p.astype("i8") // 100) for p in positives]

    def wanted(anchor: int, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        overlap = np.zeros(len(rows), bool)
        for first, last in zip(*spans[anchor]):
            if first <= last:
                overlap |= (upper + SLACK >= first) & (lower - SLACK <= last)
        return overlap & (row_labels != labels[anchor])

    for anchor, at, scores in walk(anchors, rows, wanted):
        order = np.lexsort((ids[at], -scores))
        at, scores = at[order], scores[order]
        for number, (first, last) in enumerate(zip(*spans[anchor])):
            if first > last:
                continue
            begin, end = np.searchsorted(-scores, -last, side="left"), np.searchsorted(-scores, -first, side="right")
            chosen = slice(begin, min(end, begin + k))
            if begin < end:
                yield anchor, number, at[chosen], scores[chosen]


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, -1).astype("f8") if len(flat) else np.zeros((rows, 1))


def _checked(rows: np.ndarray, anchors: np.ndarray) -> None:
    if len(rows) and len(anchors) and np.abs(rows).max() * np.abs(anchors).max() * rows.shape[1] >= 2**53:
        raise ValueError("components are too large for exact scores")


def _table(kinds: dict[str, pa.DataType], found: list[tuple]) -> pa.Table:
    if not found:
        return pa.table({n: pa.array([], t) for n, t in kinds.items()})
    return pa.table({n: pa.array(np.concatenate(c), t) for (n, t), c in zip(kinds.items(), zip(*found))})


def _positives(k: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    kinds = dict.fromkeys(("anchor", "positive_id", "positive_score"), pa.int64())

    def run(_: tuple, block: pa.Table, group: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if block.num_rows and group.num_rows:
            rows, anchors = _matrix(block.column("items"), block.num_rows), _matrix(group.column("items_asked"), group.num_rows)
            _checked(rows, anchors)
            keys, ids, labels = (block.column(c).to_numpy() for c in ("row", "vec_id", "label"))
            own, own_labels = (group.column(c).to_numpy() for c in ("row_asked", "label_asked"))
            for label in np.unique(own_labels):
                here, asked = np.flatnonzero(labels == label), np.flatnonzero(own_labels == label)
                if not len(here):
                    continue
                for anchor, at, scores in nearest(anchors[asked], own[asked], rows[here], keys[here], ids[here], k):
                    found.append((np.full(len(at), own[asked[anchor]]), ids[here[at]], scores.astype("i8")))
        return _table(kinds, found)

    return run


def _negatives(k: int, window: tuple[int, int]) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    kinds = dict.fromkeys(("anchor", "place", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"), pa.int64())

    def run(_: tuple, block: pa.Table, group: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if block.num_rows and group.num_rows:
            rows, anchors = _matrix(block.column("items"), block.num_rows), _matrix(group.column("items_asked"), group.num_rows)
            _checked(rows, anchors)
            own, anchor_ids, own_labels = (group.column(c).to_numpy() for c in ("row_asked", "vec_id_asked", "label_asked"))
            ids, labels = block.column("vec_id").to_numpy(), block.column("label").to_numpy()
            named = [np.array(p, "i8") for p in group.column("positive_ids").to_pylist()]
            scored = [np.array(p, "i8") for p in group.column("positive_scores").to_pylist()]
            for anchor, number, at, scores in between(anchors, own_labels, scored, rows, labels, ids, k, window):
                same = (own[anchor], number, anchor_ids[anchor], named[anchor][number], scored[anchor][number])
                found.append((*[np.full(len(at), s) for s in same], ids[at], scores.astype("i8")))
        return _table(kinds, found)

    return run


def mine(
    vectors: DataFrame, anchors: Callable[[Column], Column], positives: int = POSITIVES, negatives: int = NEGATIVES,
    window: tuple[int, int] = WINDOW, block: int = BLOCK, group: int = GROUP,
) -> DataFrame:
    """Hard negatives of the rows of ``vectors`` (vec_id, label, items; nothing null) whose id ``anchors`` picks.

    An anchor's positives are its best other rows of the same label; a positive's negatives the best rows of other
    labels that score from window[0] to window[1] percent of it. Higher scores come first, ties by smaller id. Fewer,
    or none, are returned where there are fewer. Repeated rows are rows of their own, also as anchors, which then
    appear as often. Only vectors of one length are compared; empty ones score 0. Other columns are ignored.

    Rows are dealt evenly over blocks and anchors over groups by row, whatever their labels; each pair of a block
    and a group is one task's work.
    """
    rows = materialised(vectors.select("vec_id", "label", "items", F.monotonically_increasing_id().alias("row")), "vectors")
    is_anchor = F.coalesce(anchors(F.col("vec_id")), F.lit(False))
    n, asked = rows.agg(F.count("*"), F.count_if(is_anchor)).first()
    blocks, groups = max(1, -(-n // block)), max(1, -(-asked // group))
    number = lambda seed, count: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    place = ["_width", "_block", "_group"]
    stored = rows.withColumns({"_width": F.size("items"), "_block": number(1, blocks)}).withColumn("_group", every(groups))
    dealt = lambda some: some.withColumns({"_width": F.size("items"), "_group": number(2, groups)}).withColumn("_block", every(blocks))
    # The two sides come from one table, so the anchors' columns get names of their own.
    renamed = lambda some: some.select(*[F.col(c).alias(c if c.startswith("positive") else f"{c}_asked") for c in some.columns])

    def over_pairs(some: DataFrame, run: Callable[[tuple, pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        return stored.groupBy(*place).cogroup(renamed(dealt(some)).groupBy(*[f"{c}_asked" for c in place])).applyInArrow(run, schema)

    near = over_pairs(rows.where(is_anchor), _positives(positives), "anchor long, positive_id long, positive_score long")
    best = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= positives)
    listed = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("_rank", "positive_id", "positive_score"))).alias("_all"))
    kept = listed.select("anchor", F.col("_all.positive_id").alias("positive_ids"), F.col("_all.positive_score").alias("positive_scores"))
    asking = materialised(rows.where(is_anchor).join(kept, F.col("row") == F.col("anchor")).drop("anchor"), "anchors")
    schema = "anchor long, place long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = over_pairs(asking, _negatives(negatives, window), schema)
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), lambda vec_id: vec_id % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op13_hard_negatives": op13_hard_negatives}

ORACLES = {
    "op13_hard_negatives": """
WITH vectors AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS items
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS MATERIALIZED (
    SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same, list_inner_product(a.items, b.items)::BIGINT AS score
    FROM vectors a JOIN vectors b ON a.r <> b.r AND len(a.items) = len(b.items)
    WHERE a.vec_id % 100 = 0
), positives AS MATERIALIZED (
    SELECT anchor, anchor_id, vec_id AS positive_id, score AS positive_score,
           row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place
    FROM scored WHERE same QUALIFY place <= 5
), ranked AS (
    SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.vec_id)::INT AS rank
    FROM positives p JOIN scored s ON p.anchor = s.anchor AND NOT s.same
    WHERE 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""
}
