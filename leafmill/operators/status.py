"""Roll-ups of rule results, findings and page classes, and ordered set operations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def conformance(results: DataFrame, key: str) -> DataFrame:
    """Counts by status and the verdict: any fail -> non_conformant, else any inconclusive ->
    indeterminate, else conformant. results: key, status."""
    g = results.groupBy(key).agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("pass", "fail", "inconclusive", "not_applicable")))
    return g.withColumn("verdict", F.when(F.col("fail") > 0, "non_conformant").when(F.col("inconclusive") > 0, "indeterminate").otherwise("conformant"))


def page_source(chars: Column, text_coverage: Column, image_coverage: Column) -> Column:
    """digital, scanned, mixed or empty, by what a page holds."""
    return F.when((chars == 0) & (image_coverage < 0.05), "empty").when((chars < 20) & (image_coverage >= 0.5), "scanned").when((image_coverage >= 0.5) & (text_coverage > 0), "mixed").otherwise("digital")


def document_source(pages: DataFrame) -> DataFrame:
    """all digital / all scanned / mixed, empty pages aside. pages: doc_id, source."""
    g = pages.filter("source <> 'empty'").groupBy("doc_id").agg(F.bool_and(F.col("source") == "digital").alias("d"), F.bool_and(F.col("source") == "scanned").alias("s"), F.count("*").alias("pages"))
    return g.select("doc_id", "pages", F.when(F.col("d"), "digital").when(F.col("s"), "scanned").otherwise("mixed").alias("source"))


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row per key, and a new number in the order of the keys. Only the kept rows are
    numbered."""
    d = df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
    return d


def reorder(pages: DataFrame, order: DataFrame) -> DataFrame:
    """Pages by a list of page numbers that may repeat or leave out some.
    pages: doc_id, page, ...; order: doc_id, pages (array) -> position, page."""
    o = order.select("doc_id", F.posexplode("pages").alias("position", "page"))
    return o.join(pages, ["doc_id", "page"])


def merge_documents(parts: list[DataFrame]) -> DataFrame:
    """Pages of several inputs, numbered by input and page."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("input", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return out.withColumn("position", F.row_number().over(W.partitionBy("doc_id").orderBy("input", "page")) - 1)


def capped_set(df: DataFrame, key: str, item: str, size: Column, order: str, most_items: int, most_bytes: int) -> DataFrame:
    """Insertions into a set with bounds, in order: an item that is in the set already changes
    nothing, one that would break a bound is refused and takes nothing, so that a smaller one
    may still get in. What gets in depends on what got in before, so a key's rows are streamed
    in order; the set, of most_items at most, is all that is held."""
    src = df.select(key, item, order, size.cast("long").alias("_size")).repartition(key).sortWithinPartitions(key, order)
    kinds = [src.schema[c].dataType.simpleString() for c in (key, item, order)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, have, held = object(), set(), 0
        for batch in batches:
            keep = []
            for k, i, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if k != mine:
                    mine, have, held = k, set(), 0
                fits = i not in have and len(have) < most_items and held + n <= most_bytes
                if fits:
                    have.add(i)
                    held += n
                keep.append(fits)
            yield batch.select([0, 1, 2]).filter(pa.array(keep, pa.bool_()))

    return src.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in zip((key, item, order), kinds, strict=True)))


def precision_recall(matched: Column, predicted: Column, expected: Column) -> dict[str, Column]:
    """With nothing predicted and nothing expected all are 1."""
    both = (predicted == 0) & (expected == 0)
    p = F.when(both, 1.0).when(predicted == 0, 0.0).otherwise(matched / predicted)
    r = F.when(both, 1.0).when(expected == 0, 0.0).otherwise(matched / expected)
    return {"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)}
