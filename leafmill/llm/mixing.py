"""Mixing sources to target weights, in DataFrame functions alone.

Every document gets a hash-random key.  Keys are uniform, so cutting the key
space into equal slices range-partitions each source; a prefix sum inside every
(source, slice) plus the prefix sum of slice totals gives each document its place
in the source's random order without any source meeting in one task.  Each source
is taken whole for as many epochs as fit into its budget, and the rest of the
budget is cut exactly, inside a document where it falls there.

Defined results: null or empty text has size 0 and nothing of it is taken; a null
source is a source of its own that sorts last; repeated rows are documents of
their own and ties of the key are ordered by doc_id, text hash; an empty table
gives an empty result; further columns are ignored by `mix_plan` and kept by
`mix_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import SPACE_RUN, materialize, table

#: Weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)
#: Share of all sizes that the mix takes; most epochs of one source.
TOTAL_SHARE, MOST_EPOCHS = 1.5, 2
#: The key space has 2**12 slices. A slice of one source holds 1/4096 of its rows.
SLICE_BITS = 12
#: The row key by which mix_rows finds a document again.
ROW = "_mix_row"


def n_words(text: Column) -> Column:
    """Number of runs of non-space characters: trim, then count the gaps."""
    bare = F.regexp_replace(text, SPACE_RUN, " ")
    bare = F.trim(bare)
    gaps = F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit("")))
    return F.when(text.isNull() | (bare == ""), F.lit(0)).otherwise(gaps + 1).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) -> with target: weighted shares of share * all sizes, capped
    at most * source_size, the excess shared again by weight.

    Filling up by weight has a closed form: with sources by cap / weight, a source is
    at its cap as long as cap / weight is at most what is left by the sources before
    it over the weights from it on. One row per source, so windows over all rows are small."""
    order = W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    s = s.withColumn("total", F.sum("source_size").over(W.partitionBy()) * F.lit(share))
    fill = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("weights", F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing)))
    s = s.withColumn("open", F.col("cap") * F.col("weights") > F.col("left") * F.col("weight"))
    # the first source below its cap fixes the level; all after it are below theirs too
    level = F.first(F.when(F.col("open"), F.struct("left", "weights")), True).over(fill.rowsBetween(W.unboundedPreceding, 0))
    s = s.withColumn("level", level)
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.col("weight") * F.col("level.left") / F.col("level.weights"))
    return s.select("source", "source_size", F.least(target, F.col("cap")).alias("target"))


def sized_documents(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and what orders documents at random: key, tie."""
    tie = F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    row = [c for c in docs.columns if c == ROW]
    return docs.select(F.col("doc_id"), F.col("source"), n_words(F.col("text")).alias("size"), tie.alias("_tie"), *row)


def mix_plan(docs: DataFrame, seed: int = 17) -> DataFrame:
    """Every document with its size, source_size, target, epochs and taken words."""
    sized = materialize(sized_documents(docs), "mix-sizes")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("_tie")).cast("binary"))
    # 60 random bits; the upper 12 are the slice, an equal range of keys
    sized = sized.withColumn("_key", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))
    sized = sized.withColumn("_slice", F.shiftright("_key", 60 - SLICE_BITS).cast("int"))
    cells = sized.groupBy("source", "_slice").agg(F.sum("size").alias("_cell"))
    sizes = cells.groupBy("source").agg(F.sum("_cell").alias("source_size"))
    targets = source_targets(sizes)
    by_source = W.partitionBy("source").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("_above", F.coalesce(F.sum("_cell").over(by_source), F.lit(0)))
    cells = cells.alias("c").join(targets.alias("t"), F.expr("c.source <=> t.source")).select(F.col("c.source").alias("_s"), F.col("c._slice").alias("_k"), "_above", "source_size", "target")
    row = [c for c in sized.columns if c == ROW]
    inside = W.partitionBy("source", "_slice").orderBy("_key", "doc_id", "_tie", *row).rowsBetween(W.unboundedPreceding, -1)
    placed = sized.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(cells, F.expr("source <=> _s AND _slice = _k")).withColumn("_before", F.col("_above") + F.col("_in"))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - F.col("epochs") * F.col("source_size")
    placed = placed.withColumn("epochs", epochs)
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before"))).cast("long")
    placed = placed.withColumn("taken", F.col("epochs") * F.col("size") + part)
    return placed


def mix_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    return mix_plan(docs, seed).select("doc_id", "size", "source_size", "target", "taken", "epochs")


def mix_rows(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The rows of docs that the mix takes, with size, epochs (whole passes over the text)
    and taken: the last pass ends after taken - epochs * size words of it. Columns of docs
    with these names give way."""
    # repeated rows are told apart by a key that is written down
    rows = materialize(docs.drop("size", "epochs", "taken", ROW).withColumn(ROW, F.monotonically_increasing_id()), "mix-rows")
    plan = mix_plan(rows, seed).filter("taken > 0").select(F.col(ROW).alias("_planned"), "size", "epochs", "taken")
    return rows.join(plan, F.col(ROW) == F.col("_planned")).drop(ROW, "_planned")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))


_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS tie
  FROM documents),
keyed AS (SELECT *, CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || tie), 1, 15) AS BIGINT) AS k FROM sized),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
    source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total
  FROM sizes),
filled AS (
  SELECT *, total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM weighted),
level AS (SELECT rest AS l, weights AS w, cap / weight AS r FROM filled WHERE cap * weights > rest * weight ORDER BY cap / weight, source IS NULL, source LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN l IS NULL OR cap / weight < r THEN cap ELSE least(weight * l / w, cap) END AS target
  FROM filled LEFT JOIN level ON true),
placed AS (
  SELECT k.doc_id, k.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY k, doc_id, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS BIGINT) AS epochs,
  CAST(CASE WHEN source_size > 0 THEN (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) ELSE 0 END AS BIGINT) AS taken
FROM placed
"""

QUERIES = {"op8_mixing": op8_mixing}
ORACLE = {"op8_mixing": _SQL}
