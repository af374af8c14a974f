"""Page layout over block tables (doc_id, page, idx, text, x0, y0, x1, y1, font_size, kind):
statistics, running headers, section paths, reading order. One shuffle on doc_id feeds
each operator; all aggregates combine before it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import half_points
from ..functions.text import is_section_heading, page_number, running_key


def font_statistics(blocks: DataFrame) -> DataFrame:
    """Per document: the body size (half-point bucket with most characters, the smaller one at a
    tie), the number of heading tiers (sizes of 1.15 times the body's or more, six at most) and
    the upper median width. Buckets and medians come from counted values, so that a document
    costs as many rows as it has sizes and widths."""
    b = blocks.withColumn("bucket", half_points(F.col("font_size"))).withColumn("width", F.col("x1") - F.col("x0"))
    sizes = b.groupBy("doc_id", "bucket").agg(F.sum(F.greatest(F.col("n"), F.lit(1))).alias("chars"))
    body = sizes.groupBy("doc_id").agg(F.max_by("bucket", F.struct("chars", -F.col("bucket"))).alias("body"), F.collect_list("bucket").alias("all"))
    body = body.select("doc_id", "body", F.least(F.size(F.filter("all", lambda x: x >= 1.15 * F.col("body"))), F.lit(6)).alias("tiers"))
    return body.join(upper_median(b, "doc_id", "width").withColumnRenamed("median", "median_width"), "doc_id")


def upper_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """sorted[n div 2] per key, from counts of distinct values."""
    c = df.groupBy(key, value).agg(F.count("*").alias("_c"))
    order = W.partitionBy(key).orderBy(value)
    c = c.withColumn("_to", F.sum("_c").over(order)).withColumn("_n", F.sum("_c").over(W.partitionBy(key)))
    return c.filter("_to > _n div 2 AND _to - _c <= _n div 2").select(key, F.col(value).alias("median"))


def nearest_rank(df: DataFrame, key: str, value: str, q: float) -> DataFrame:
    """The value at index ceil((n - 1) * q) of the sorted values per key."""
    c = df.groupBy(key, value).agg(F.count("*").alias("_c"))
    order = W.partitionBy(key).orderBy(value)
    c = c.withColumn("_to", F.sum("_c").over(order)).withColumn("_n", F.sum("_c").over(W.partitionBy(key)))
    c = c.withColumn("_at", F.ceil((F.col("_n") - 1) * F.lit(q)))
    return c.filter("_to > _at AND _to - _c <= _at").select(key, F.col(value).alias("value"))


def margin_bands(blocks: DataFrame, share: float = 0.12) -> DataFrame:
    """Blocks in the top or bottom margin of their page with band and x_bucket (tenths of the page's
    width). blocks: doc_id, page, box, page_width, page_height, ..."""
    height = F.col("page_height")
    band = F.when(F.col("y1") >= height * (1 - share), "top").when(F.col("y0") <= height * share, "bottom")
    sized = blocks.filter((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")) & (height > 0))
    return sized.withColumn("band", band).filter("band IS NOT NULL").withColumn("x_bucket", F.floor(F.col("x0") / (F.greatest(F.col("page_width"), F.lit(1.0)) * 0.1)).cast("int"))


def running_headers(blocks: DataFrame) -> DataFrame:
    """Texts that come back in the same margin and place on max(2, half) of a document's pages
    or more: doc_id, band, x_bucket, running, pages, confidence. Blocks as in margin_bands."""
    b = margin_bands(blocks).withColumn("running", running_key(F.col("text"))).filter("running <> ''")
    pages = blocks.groupBy("doc_id").agg(F.max("page").alias("n_pages"))
    # distinct pages first: the count then has one row a page
    seen = b.select("doc_id", "band", "x_bucket", "running", "page").distinct()
    g = seen.groupBy("doc_id", "band", "x_bucket", "running").agg(F.count("*").alias("pages"))
    g = g.join(pages, "doc_id").filter(F.col("pages") >= F.greatest(F.lit(2), F.ceil(F.col("n_pages") / 2)))
    return g.select("doc_id", "band", "x_bucket", "running", "pages", F.round(F.least(F.lit(0.98), 0.5 + 0.4 * F.col("pages") / F.col("n_pages")), 6).alias("confidence"))


def page_numbers(blocks: DataFrame) -> DataFrame:
    """Page numbers in the margins, where a place has two of them or more: doc_id, idx, number and
    confidence, high if half of the neighbours there count up by one from page to page."""
    b = margin_bands(blocks).withColumn("number", page_number(F.col("text"))).filter("number IS NOT NULL")
    place = W.partitionBy("doc_id", "band", "x_bucket")
    order = place.orderBy("page", "idx")
    b = b.withColumn("_next", ((F.col("number") - F.lag("number").over(order) == 1) & (F.col("page") > F.lag("page").over(order))).cast("int"))
    b = b.withColumn("_pairs", F.count("*").over(place) - 1).withColumn("_up", F.sum("_next").over(place))
    return b.filter("_pairs > 0").select("doc_id", "idx", "number", F.when(F.col("_up") * 2 >= F.col("_pairs"), 0.95).otherwise(0.6).alias("confidence"))


# Fixed shares of a block's characters from which on it counts as bold or italic.
BOLD_SHARE, ITALIC_SHARE = 0.60, 0.50


def emphasis(chunks: DataFrame) -> DataFrame:
    """doc_id, idx (of the block), bold and italic by the characters in such fonts. chunks: doc_id, idx, text, bold, italic
    (of the font); blank ones don't count."""
    n = F.length("text")
    c = chunks.filter("trim(text) <> ''")
    g = c.groupBy("doc_id", "idx").agg(F.sum(n).alias("n"), F.sum(F.when(F.col("bold"), n).otherwise(0)).alias("b"), F.sum(F.when(F.col("italic"), n).otherwise(0)).alias("i"))
    return g.select("doc_id", "idx", (F.col("b") >= BOLD_SHARE * F.col("n")).alias("bold"), (F.col("i") >= ITALIC_SHARE * F.col("n")).alias("italic"))


def heading_score(b: DataFrame) -> Column:
    """How much a block looks like a heading. b: size_ratio, bold, italic, line_count, word_count, text (its first line),
    fill, closed (ends a sentence), gap_above, line_height."""
    c = F.col
    on = lambda test, weight: F.when(test, weight).otherwise(0.0)
    size = F.when(c("size_ratio") >= 1.15, 0.45).when(c("size_ratio") >= 1.05, 0.15).otherwise(0.0)
    score = (
        size + on(c("line_count") <= 2, 0.10) + on(c("word_count") <= 12, 0.10) + on(c("fill") <= 0.6, 0.10) + on(c("bold"), 0.15) + on(c("italic") & ~c("bold"), 0.03)
        + on(c("gap_above") >= 1.5 * c("line_height"), 0.08) + on(is_section_heading(c("text")), 0.20) - on(c("closed") & (c("word_count") > 12), 0.25) - on(c("line_count") >= 4, 0.30)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def paragraph_score(b: DataFrame) -> Column:
    """How much a block looks like running prose; columns as in heading_score."""
    c = F.col
    on = lambda test, weight: F.when(test, weight).otherwise(0.0)
    score = (
        F.lit(0.55) + on(c("line_count") >= 2, 0.10) + on(c("closed"), 0.10) + on(c("fill") >= 0.6, 0.10) + on(c("size_ratio").between(0.95, 1.10), 0.10)
        - on(c("bold") & (c("word_count") <= 12), 0.20) - on((c("word_count") <= 2) & (c("line_count") == 1) & ~c("closed"), 0.25)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def classified(blocks: DataFrame) -> DataFrame:
    """blocks with class and score: the likelier of heading and paragraph, heading at a tie, text
    where neither reaches one half."""
    b = blocks.withColumn("_heading", F.round(heading_score(blocks), 9)).withColumn("_paragraph", F.round(paragraph_score(blocks), 9))
    score = F.greatest("_heading", "_paragraph")
    kind = F.when(score < 0.5, "text").when(F.col("_paragraph") > F.col("_heading"), "paragraph").otherwise("heading")
    return b.withColumn("class", kind).withColumn("score", score).drop("_heading", "_paragraph")


def page_order(blocks: DataFrame) -> DataFrame:
    """Reading index per document by page and falling top, and the gap above in the page."""
    in_page = W.partitionBy("doc_id", "page").orderBy(F.desc("y1"), "x0", "idx")
    in_doc = W.partitionBy("doc_id").orderBy("page", F.desc("y1"), "x0", "idx")
    return blocks.select("doc_id", "idx", (F.row_number().over(in_doc) - 1).alias("reading"), (F.lag("y0").over(in_page) - F.col("y1")).alias("gap_above"))


def consecutive_runs(df: DataFrame, key: str, by: str, order: str) -> DataFrame:
    """Runs of equal neighbours: key, run, by, first, last, size. The same value later opens
    a new run."""
    w = W.partitionBy(key).orderBy(order)
    new = F.coalesce((F.col(by) != F.lag(by).over(w)).cast("int"), F.lit(0))
    runs = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w))
    return runs.groupBy(key, "run", by).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("size"))


def section_paths(blocks: DataFrame, levels: int = 3) -> DataFrame:
    """The stack of open headings at each block: a heading of a level closes those of its own
    and deeper levels. blocks: doc_id, idx, text, level (null: no heading)."""
    w = W.partitionBy("doc_id").orderBy("idx")
    d = blocks
    for k in range(1, levels + 1):
        d = d.withColumn(f"_i{k}", F.last(F.when(F.col("level") == k, F.col("idx")), True).over(w))
        d = d.withColumn(f"_t{k}", F.last(F.when(F.col("level") == k, F.col("text")), True).over(w))
    parts = []
    for k in range(1, levels + 1):
        above = [F.col(f"_i{j}") for j in range(1, k)]
        newest = F.greatest(F.lit(-1), *[F.coalesce(a, F.lit(-1)) for a in above]) if above else F.lit(-1)
        parts.append(F.when(F.col(f"_i{k}") > newest, F.col(f"_t{k}")))
    return d.select("doc_id", "idx", F.array_compact(F.array(*parts)).alias("path"))


def interval_union(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Length covered by intervals per key, overlaps once, and the widest gap between them."""
    w = W.partitionBy(key).orderBy(start, end)
    d = df.withColumn("_before", F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1)))
    fresh = F.greatest(F.lit(0.0), F.col(end) - F.greatest(F.col(start), F.coalesce(F.col("_before"), F.col(start))))
    gap = F.greatest(F.lit(0.0), F.col(start) - F.col("_before"))
    return d.groupBy(key).agg(F.sum(fresh).alias("covered"), F.coalesce(F.max(gap), F.lit(0.0)).alias("widest_gap"))


def overlap_suffix(pieces: DataFrame, budget: int) -> DataFrame:
    """For each group (key) the last whole pieces that fit into a token budget; the very last is
    taken in any case. pieces: key, group, idx, tokens -> with taken."""
    back = W.partitionBy("key", "group").orderBy(F.desc("idx"))
    d = pieces.withColumn("_sum", F.sum("tokens").over(back)).withColumn("_nth", F.row_number().over(back))
    return d.select("key", "group", "idx", "tokens", ((F.col("_sum") <= budget) | (F.col("_nth") == 1)).alias("taken"))


def _agreeing(b: np.ndarray) -> int:
    """Pairs i < j with b[i] < b[j], by merging sorted halves of growing width."""
    n, total, width = len(b), 0, 1
    order = b.astype(np.int64)
    while width < n:
        block = np.arange(n) // (2 * width)
        left = (np.arange(n) // width) % 2 == 0
        sorted_ = np.lexsort((order, block))
        # of each right element: the left ones of its block that sort before it
        before = np.cumsum(left[sorted_])
        start = np.append(0, np.flatnonzero(np.diff(block[sorted_])) + 1)
        base = np.repeat(np.append(0, before)[start], np.diff(np.append(start, n)))
        total += int(np.sum((before - base)[~left[sorted_]]))
        order, width = order[sorted_], 2 * width
    return total


def pairwise_order(ranks: DataFrame) -> DataFrame:
    """Share of concordant pairs per key of two orders over common ids; fewer than two ids
    agree. ranks: key, a, b (ranks without ties). Pairs are counted by merging, in n log^2 n steps of
    one document's blocks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = len(pdf)
        b = pdf.sort_values("a").b.rank(method="first").to_numpy()
        return pd.DataFrame({"key": [pdf.key.iloc[0]], "order_score": [_agreeing(b) / (n * (n - 1) / 2) if n > 1 else 1.0]})

    return ranks.select("key", "a", "b").groupBy("key").applyInPandas(run, "key long, order_score double")
