"""Regions, rows and paragraphs of a page, the verdict on a document's text layer, thresholds of
histograms, and search. Kernels that depend on order work inside one page."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.values import let

MOST_DEPTH = 40


def _widest(lo: np.ndarray, hi: np.ndarray, least: float) -> tuple[float, float] | None:
    """(width, middle) of the widest uncovered band between intervals, the first of equal ones."""
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    gaps = lo[1:] - reach[:-1]
    if not len(gaps) or gaps.max() <= 0 or gaps.max() < least:
        return None
    k = int(np.argmax(gaps))
    return float(gaps[k]), float((reach[k] + lo[k + 1]) / 2)


def cut_regions(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, column_gap: float, block_gap: float, rtl: bool = False) -> list[np.ndarray]:
    """Boxes in regions in reading order: a region is cut at its widest empty band that is wide enough, between
    columns rather than between blocks if both are as wide."""
    done: list[np.ndarray] = []
    todo = [(np.arange(len(x0)), 0)]
    while todo:
        rows, depth = todo.pop()
        cut = None
        if len(rows) > 1 and depth < MOST_DEPTH:
            v, h = _widest(x0[rows], x1[rows], column_gap), _widest(y0[rows], y1[rows], block_gap)
            if v is not None and (h is None or v[0] >= h[0]):
                low = (x0[rows] + x1[rows]) / 2 < v[1]
                cut = (rows[low], rows[~low]) if not rtl else (rows[~low], rows[low])
            elif h is not None:
                low = (y0[rows] + y1[rows]) / 2 < h[1]
                cut = (rows[~low], rows[low])
        if cut is None:
            if len(rows):
                done.append(rows)
        else:
            todo += [(cut[1], depth + 1), (cut[0], depth + 1)]
    return done


def regions(blocks: DataFrame, column_gap: float, block_gap: float) -> DataFrame:
    """doc_id, page, idx, region (number in reading order) of every block. blocks: doc_id, page, idx, box."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        region = np.zeros(len(pdf), np.int32)
        for k, rows in enumerate(cut_regions(*(pdf[c].to_numpy() for c in ("x0", "y0", "x1", "y1")), column_gap, block_gap)):
            region[rows] = k
        return pd.DataFrame({"doc_id": pdf.doc_id, "page": pdf.page, "idx": pdf.idx, "region": region})

    return blocks.select("doc_id", "page", "idx", "x0", "y0", "x1", "y1").groupBy("doc_id", "page").applyInPandas(run, "doc_id long, page int, idx int, region int")


def mean_rows(items: DataFrame, tolerance: float) -> DataFrame:
    """Items by falling centre join the last row if they are within the tolerance of the mean of its centres so far:
    doc_id, page, idx, row. items: doc_id, page, idx, y0, y1."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(c=(pdf.y0 + pdf.y1) / 2).sort_values(["c", "idx"], ascending=[False, True])
        row, total, n, out = -1, 0.0, 0, []
        for c in pdf.c.tolist():
            if n and abs(total / n - c) <= tolerance:
                total, n = total + c, n + 1
            else:
                row, total, n = row + 1, c, 1
            out.append(row)
        return pd.DataFrame({"doc_id": pdf.doc_id, "page": pdf.page, "idx": pdf.idx, "row": out})

    return items.select("doc_id", "page", "idx", "y0", "y1").groupBy("doc_id", "page").applyInPandas(run, "doc_id long, page int, idx int, row int")


def paragraphs(lines: DataFrame, factor: float = 1.5) -> DataFrame:
    """Lines of a region from top to bottom, and the paragraph each is in: a new one begins where the pitch is more
    than `factor` times the upper median of the region's pitches. lines: doc_id, page, region, idx, y0, y1."""
    keys = ["doc_id", "page", "region"]
    order = W.partitionBy(*keys).orderBy(F.desc("_c"), "idx")
    b = lines.select(*keys, "idx", ((F.col("y0") + F.col("y1")) / 2).alias("_c"), (F.col("y1") - F.col("y0")).alias("_h")).withColumn("_p", F.abs(F.lag("_c").over(order) - F.col("_c")))
    # the median from counted pitches
    counted = b.filter("_p > 0").groupBy(*keys, "_p").agg(F.count("*").alias("_n"))
    rising = W.partitionBy(*keys).orderBy("_p")
    counted = counted.withColumn("_to", F.sum("_n").over(rising)).withColumn("_all", F.sum("_n").over(W.partitionBy(*keys)))
    typical = counted.filter("_to > _all div 2 AND _to - _n <= _all div 2").select(*keys, F.col("_p").alias("_typical"))
    b = b.join(typical, keys, "left").withColumn("_new", F.coalesce((F.col("_p") > factor * F.coalesce("_typical", "_h")).cast("int"), F.lit(0)))
    return b.select(*keys, "idx", F.sum("_new").over(order).alias("paragraph"))


def text_layer(pages: DataFrame, sample: int | None = None) -> DataFrame:
    """Whether documents have a text layer, by the pages (the first `sample` ones) that have characters: doc_id, has_text,
    confidence, scanned, advice. pages: doc_id, page (from 1), chars."""
    p = pages if sample is None else pages.filter(F.col("page") <= sample)
    g = p.groupBy("doc_id").agg(F.count_if(F.coalesce("chars", F.lit(0)) > 0).alias("w"), F.count_if(F.coalesce("chars", F.lit(0)) == 0).alias("o"))
    w, o = F.col("w"), F.col("o")
    has = (w > 0) & (w > o)
    sure = F.when((w == 0) | (o == 0), 0.95).when(w > o, 0.7).otherwise(0.5)
    advice = F.when(has & (o == 0), "extract_text").when(has, "mixed").otherwise("use_ocr")
    return g.select("doc_id", has.alias("has_text"), sure.alias("confidence"), (w == 0).alias("scanned"), advice.alias("advice"))


def otsu_threshold(histogram: Column) -> Column:
    """The first level of a histogram (array of counts) that parts it with the most variance between both sides; 127 if
    it is empty."""
    long = lambda c: c.cast("long")
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s"), F.lit(-1.0).alias("best"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("t"))

    def told(p: Column) -> Column:
        def step(a: Column, c: Column) -> Column:
            def moved(b: Column) -> Column:
                fore = p["n"] - b["n"]
                d = b["s"] / F.nullif(b["n"], F.lit(0)) - (p["s"] - b["s"]) / F.nullif(fore, F.lit(0))
                between = F.when((b["n"] > 0) & (fore > 0), b["n"].cast("double") * fore.cast("double") * d * d)
                better = F.coalesce(between > a["best"], F.lit(False))
                return F.struct(b["n"].alias("n"), b["s"].alias("s"), F.when(better, between).otherwise(a["best"]).alias("best"), F.when(better, a["t"]).otherwise(a["at"]).alias("at"), (a["t"] + 1).alias("t"))

            return let(F.struct((a["n"] + long(c)).alias("n"), (a["s"] + a["t"] * long(c)).alias("s")), moved)

        return F.when(p["n"] == 0, F.lit(127).cast("long")).otherwise(F.aggregate(histogram, zero, step)["at"])

    sums = F.struct(F.aggregate(histogram, F.lit(0).cast("long"), lambda a, c: a + long(c)).alias("n"), F.aggregate(F.transform(histogram, lambda c, i: long(c) * i), F.lit(0).cast("long"), lambda a, c: a + c).alias("s"))
    return let(sums, told)


def matches(text: Column, query: str, form: Callable[[Column], Column] = X.search_key) -> Column:
    """Offsets of a query in the normal form of a text, from the left and without overlap; none for an empty query."""

    def told(q: Column) -> Column:
        parts = F.split(form(F.coalesce(text, F.lit(""))), F.concat(F.lit("\\Q"), q, F.lit("\\E")), -1)
        sizes = lambda p: F.slice(F.transform(p, F.length), F.lit(1), F.size(p) - 1)
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda a, n: F.struct((a["at"] + n + F.length(q)).alias("at"), F.concat(a["out"], F.array(a["at"] + n)).alias("out"))
        return F.when(F.length(q) > 0, F.aggregate(sizes(parts), zero, step)["out"]).otherwise(F.array().cast("array<int>"))

    return let(form(F.lit(query)), told)


def search(pages: DataFrame, query: str, most: int = 10_000) -> DataFrame:
    """doc_id, page, offset of the first `most` matches of each document, by page and offset. pages: doc_id, page, text."""
    found = pages.select("doc_id", "page", F.explode(matches(F.col("text"), query)).alias("offset"))
    nth = F.row_number().over(W.partitionBy("doc_id").orderBy("page", "offset"))
    return found.withColumn("_n", nth).filter(F.col("_n") <= most).drop("_n")


def token_matches(tokens: Column, query: Column) -> Column:
    """Indices at which a list of tokens goes on as the query's tokens; none for an empty query."""
    n, m = F.size(tokens), F.size(query)
    starts = F.when((m > 0) & (n >= m), F.sequence(F.lit(0), F.greatest(n - m, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.filter(starts, lambda i: F.slice(tokens, i + 1, m) == query)


def token_chunks(tokens: Column, size: int) -> Column:
    """Runs of `size` tokens, the last one shorter: array of struct(chunk, tokens)."""
    n, size = F.size(tokens), max(size, 1)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i, k: F.struct(k.alias("chunk"), F.slice(tokens, i + 1, F.lit(size)).alias("tokens")))
