"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every document gets the key ``-ln(u) / w``: u from its id's md5, w its quality weight. Read in the
order of their keys, the documents of a source are a weighted sample without replacement, so a cut
by prefix sum draws any budget. A source's target is first spent on complete epochs, then on the
documents before the cut.

No source is sorted as a whole. Keys fall into cells, monotone in the key; the totals of the cells
find the one that holds the cut, and only the documents of that cell are ranked. What leaves is one
row per source, so a source with a third of all rows costs no more than its share.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldtrust.llm.common import materialised, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
#: Cells per source: a cell's documents are ranked in one task.
CELLS = 65_536
#: Weight of a document in the draw, by its quality label.
QUALITY = {1: 2.0, 0: 0.5}


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with the number of words in each text; null texts have none."""
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long"))


def labelled_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with _weight, by the quality label; documents without one weigh 1."""
    quality = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_q"))
    weight = F.lit(1.0)
    for label, value in QUALITY.items():
        weight = F.when(F.col("_q") == label, value).otherwise(weight)
    return docs.join(quality, docs["doc_id"] == quality["_id"], "left").withColumn("_weight", weight).drop("_id", "_q")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, _weight) with the key of the draw and its cell."""
    digits = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    rows = docs.withColumn("_key", -F.log(u) / F.col("_weight"))
    return rows.withColumn("_cell", F.floor((1 - F.exp(-F.col("_key"))) * CELLS)).drop("_weight")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, limit: float = MAX_EPOCHS) -> DataFrame:
    """``sizes`` (source, source_size; a row per source) with target and complete epochs.

    Weights repeat along the sources by code point, null last. All words are shared out by weight; a
    target stops at ``limit`` times the source's size and the excess goes to the rest by weight,
    until none is above. That end state has one level L with target = min(limit * size, L * weight).
    In the order of limit * size / weight, the level that the words left give to the sources behind
    rises as long as sources are full and falls from then on: L is its maximum.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy("_fill", F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    everything = Window.partitionBy()
    rows = (
        sizes.withColumn("_weight", F.element_at(cycle, ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int")))
        .withColumn("_most", F.col("source_size") * float(limit))
        .withColumn("_fill", F.col("_most") / F.col("_weight"))
        .withColumn("_total", F.sum("source_size").over(everything).cast("double"))
    )
    before, behind = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("_total") - F.coalesce(F.sum("_most").over(before), F.lit(0.0))
    rows = rows.withColumn("_level", left / F.sum("_weight").over(behind))
    level = F.max("_level").over(everything)
    target = F.when(F.col("_fill") <= level, F.col("_most")).otherwise(level * F.col("_weight"))
    epochs = F.when(F.col("source_size") > 0, F.floor(target / F.col("source_size"))).otherwise(1)
    return rows.select("source", "source_size", target.alias("target"), epochs.cast("long").alias("_epochs"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """Rows of ``docs`` (doc_id, source, size, _weight, any others) with source_size, target, copies and taken.

    copies = times the mix repeats the document, taken = copies * size. Within a source, complete epochs
    come first; of the rest, documents in the order of their keys as long as each brings the total nearer
    to the target. Writes the keyed rows once to the shared folder: what follows reads its columns by need.
    Rows that repeat a doc_id and a size share one key and are taken together. Null ids and sources are
    ordinary values; a source without words is kept once; an empty table gives an empty one.
    """
    rows = materialised(keyed(docs), "keyed")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    share = targets(sizes, weights).withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
    share = materialised(share, "shares")

    cells = rows.groupBy("source", "_cell").agg(F.sum("size").alias("_words"))
    running = Window.partitionBy("source").orderBy("_cell")
    cells = cells.withColumn("_after", F.sum("_words").over(running))
    cut = (
        cells.alias("c").join(share.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")))
        .where((F.col("_after") >= F.col("_rest")) & (F.col("_rest") > 0))
        .groupBy(F.col("c.source").alias("source"))
        .agg(F.min(F.struct("_cell", (F.col("_after") - F.col("_words")).alias("before"))).alias("_cut"), F.first("_rest").alias("_rest"))
    )
    order = ["_key", F.col("doc_id").asc_nulls_first(), "size"]
    place = Window.partitionBy("r.source").orderBy(*order)
    last = (
        rows.alias("r").join(cut.alias("k"), F.col("r.source").eqNullSafe(F.col("k.source")) & (F.col("r._cell") == F.col("k._cut._cell")))
        .withColumn("_before", F.col("_cut.before") + F.sum("size").over(place) - F.col("size"))
        .where(2 * F.col("_before") + F.col("size") <= 2 * F.col("_rest"))
        .groupBy(F.col("r.source").alias("source"))
        .agg(F.max(F.struct("_key", "doc_id", "size")).alias("_last"))
    )
    plan = (
        share.alias("s").join(cut.drop("_rest").alias("k"), F.col("s.source").eqNullSafe(F.col("k.source")), "left")
        .join(last.alias("l"), F.col("s.source").eqNullSafe(F.col("l.source")), "left")
        .select("s.*", F.col("_cut._cell").alias("_cut"), "_last")
    )
    # A row per source. Read back from a table its size is known, and while it is small no text is shuffled for it.
    plan = materialised(plan, "plan")
    chosen = F.coalesce(
        (F.col("_cell") < F.col("_cut")) | ((F.col("_cell") == F.col("_cut")) & (F.struct("_key", "doc_id", "size") <= F.col("_last"))),
        F.lit(False),
    )
    joined = rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
    copies = F.col("_epochs") + chosen.cast("long")
    out = joined.select("r.*", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
    return out.drop("_key", "_cell")


def mixture(docs: DataFrame, labels: DataFrame | None = None, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """The mix of ``docs`` (doc_id, source, text, any others) itself: every row as often as it is taken.

    Documents weigh by their quality label, without ``labels`` all the same. The mix is made on rows without
    texts, and one join brings its copies to the texts. Columns stay as they are, also those named like a
    result of ``mix``.
    """
    thin = sized(docs.select("doc_id", "source", "text")).drop("text")
    thin = thin.withColumn("_weight", F.lit(1.0)) if labels is None else labelled_quality(thin, labels)
    # Rows that agree in these three are taken alike.
    place = ["doc_id", "source", "size"]
    mixed = mix(thin, weights).where("copies > 0").groupBy(*place).agg(F.first("copies").alias("copies"))
    mixed = materialised(mixed, "copies")
    given = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = sized(docs.select("doc_id", "source", "text", given)).drop("text")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"m.{c}")) for c in place]
    taken = rows.alias("d").join(mixed.alias("m"), same)
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sized(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")
    mixed = mix(labelled_quality(docs, table(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_mix_sources": op9_mix_sources}

ORACLES = {
    "op9_mix_sources": r"""
WITH sized AS (
    SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           -ln((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
             / CASE q.quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS key
    FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) q USING (doc_id)
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
    SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS weight,
           source_size * 3.0::DOUBLE AS most
    FROM sources
), levels AS (
    SELECT *, most / weight AS fill,
           ((SELECT sum(source_size) FROM sources)::DOUBLE
             - coalesce(sum(most) OVER (ORDER BY most / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
             / sum(weight) OVER (ORDER BY most / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM weighed
), shares AS (
    SELECT source, source_size,
           CASE WHEN fill <= l.level THEN most ELSE l.level * weight END AS target
    FROM levels, (SELECT max(level) AS level FROM levels) l
), placed AS (
    SELECT z.doc_id, z.size, s.source_size, s.target,
           CASE WHEN s.source_size > 0 THEN floor(s.target / s.source_size)::BIGINT ELSE 1 END AS epochs,
           sum(z.size) OVER (PARTITION BY z.source ORDER BY z.key, z.doc_id NULLS FIRST, z.size ROWS UNBOUNDED PRECEDING) - z.size AS before
    FROM sized z JOIN shares s ON z.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, size, source_size, target,
       ((epochs + CASE WHEN 2 * before + size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM placed
"""
}
