"""Spatial and ranked joins. Every join has an equality on the page, so that its candidates
are the boxes of one page; what is left of the condition is a range test on them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.text import is_caption


def first_overlapping(blocks: DataFrame, links: DataFrame) -> DataFrame:
    """blocks with the first link (by link_id) on the page whose box overlaps, or null.
    blocks: doc_id, page, idx, box; links: doc_id, page, link_id, uri, box."""
    b, k = blocks.alias("b"), links.alias("k")
    same = (F.col("b.doc_id") == F.col("k.doc_id")) & (F.col("b.page") == F.col("k.page"))
    hit = b.join(k, same & G.overlaps(G.box("b."), G.box("k.")))
    best = hit.groupBy(F.col("b.doc_id").alias("doc_id"), F.col("b.idx").alias("idx")).agg(F.min_by(F.col("k.uri"), F.col("k.link_id")).alias("uri"))
    return blocks.select("doc_id", "idx").join(best, ["doc_id", "idx"], "left")


def best_iou(proposals: DataFrame, tables: DataFrame, least: float = 0.2) -> DataFrame:
    """Each proposal's table of largest IoU on its page, the smallest id at a tie.
    Both: doc_id, page, id, box."""
    p, t = proposals.alias("p"), tables.alias("t")
    same = (F.col("p.doc_id") == F.col("t.doc_id")) & (F.col("p.page") == F.col("t.page"))
    scored = p.join(t, same).select(F.col("p.doc_id").alias("doc_id"), F.col("p.id").alias("proposal"), F.col("t.id").alias("match"), G.iou(G.box("p."), G.box("t.")).alias("iou")).filter(F.col("iou") >= least)
    best = scored.groupBy("doc_id", "proposal").agg(F.max_by(F.struct("match", "iou"), F.struct(F.col("iou"), -F.col("match"))).alias("m"))
    return best.select("doc_id", "proposal", F.col("m.match").alias("match"), F.round("m.iou", 6).alias("iou"))


def without_cover(regions: DataFrame, tables: DataFrame, iou: float = 0.5, inside: float = 0.8) -> DataFrame:
    """Regions that no table of their page covers (IoU or containment)."""
    r, t = regions.alias("r"), tables.alias("t")
    same = (F.col("r.doc_id") == F.col("t.doc_id")) & (F.col("r.page") == F.col("t.page"))
    covered = (G.iou(G.box("r."), G.box("t.")) >= iou) | (G.containment(G.box("r."), G.box("t.")) >= inside)
    return r.join(t, same & covered, "left_anti")


def nearest(left: DataFrame, right: DataFrame) -> DataFrame:
    """For each left box the right box on its page at the smallest gap, then the smallest id.
    Both: doc_id, page, id, box."""
    a, b = left.alias("a"), right.alias("b")
    same = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page")) & (F.col("a.id") != F.col("b.id"))
    gaps = a.join(b, same).select(F.col("a.doc_id").alias("doc_id"), F.col("a.id").alias("id"), F.col("b.id").alias("other"), G.gap(G.box("a."), G.box("b.")).alias("gap"))
    best = gaps.groupBy("doc_id", "id").agg(F.min(F.struct("gap", "other")).alias("m"))
    return best.select("doc_id", "id", F.col("m.other").alias("nearest"), F.round("m.gap", 6).alias("gap"))


def points_in_cells(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Points (doc_id, page, id, x, y) with the cells (doc_id, page, cell, box) they lie in."""
    p, c = points.alias("p"), cells.alias("c")
    same = (F.col("p.doc_id") == F.col("c.doc_id")) & (F.col("p.page") == F.col("c.page"))
    inside = F.col("p.x").between(F.col("c.x0"), F.col("c.x1")) & F.col("p.y").between(F.col("c.y0"), F.col("c.y1"))
    return p.join(c, same & inside).select(F.col("p.doc_id").alias("doc_id"), F.col("p.id").alias("id"), F.col("c.cell").alias("cell"))


def grid_difference(ref: DataFrame, hyp: DataFrame, key: str) -> DataFrame:
    """Cells of two grids (key, row, col, text) over the union of their places: matching,
    missing, extra and changed cells, and F1 (both empty: 1)."""
    a, b = ref.withColumnRenamed("text", "_a"), hyp.withColumnRenamed("text", "_b")
    j = a.join(b, [key, "row", "col"], "full_outer")
    g = j.groupBy(key).agg(
        F.count_if(F.col("_a") == F.col("_b")).alias("equal"), F.count_if(F.col("_b").isNull()).alias("missing"),
        F.count_if(F.col("_a").isNull()).alias("extra"), F.count_if(F.col("_a") != F.col("_b")).alias("changed"),
    )
    total = 2 * F.col("equal") + 2 * F.col("changed") + F.col("missing") + F.col("extra")
    return g.withColumn("f1", F.round(F.when(total == 0, 1.0).otherwise(2 * F.col("equal") / total), 6))


def suppress(proposals: DataFrame, most: float = 0.7) -> DataFrame:
    """Greedy suppression in order of page, falling confidence and id: a proposal that overlaps
    an accepted one by IoU >= most is dropped. Acceptance depends on earlier acceptances, so a
    page is worked through in order; a page's proposals are few."""
    schema = "doc_id long, page int, id long, accepted boolean"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["confidence", "id"], ascending=[False, True])
        kept: list[tuple] = []
        out = []
        for r in pdf.itertuples(index=False):
            mine = (r.x0, r.y0, r.x1, r.y1)
            ok = all(_iou(mine, k) < most for k in kept)
            if ok:
                kept.append(mine)
            out.append((r.doc_id, r.page, r.id, ok))
        return pd.DataFrame(out, columns=["doc_id", "page", "id", "accepted"])

    return proposals.groupBy("doc_id", "page").applyInPandas(run, schema)


def _iou(a: tuple, b: tuple) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0.0, w) * max(0.0, h)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if union > 0 else 0.0


# A caption is at most so many line heights below or above.
BELOW, ABOVE = 1.6, 1.2


def claim_captions(figures: DataFrame, texts: DataFrame, line_height: float) -> DataFrame:
    """Captions for figures and tables of a page: among texts of three lines at most that are not much
    wider and have half the width in common, just below (2 - gap / limit) or just above (1 - gap / limit),
    one more for a caption word; figures choose in order of id, the first of equal texts wins, and a text
    is claimed once."""
    f = figures.select("doc_id", "page", F.lit(True).alias("figure"), "id", "x0", "y0", "x1", "y1", F.lit(False).alias("opens"))
    short = F.size(F.split(F.rtrim("text"), "\n")) <= 3
    t = texts.filter(short).select("doc_id", "page", F.lit(False).alias("figure"), "id", "x0", "y0", "x1", "y1", is_caption(F.col("text")).alias("opens"))
    sized = f.unionAll(t).filter("x1 > x0 AND y1 > y0")
    below_most, above_most = BELOW * line_height, ABOVE * line_height

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        free = list(pdf[~pdf.figure].sort_values("id").itertuples(index=False))
        out = []
        for g in pdf[pdf.figure].sort_values("id").itertuples(index=False):
            best, score = None, None
            for c in free:
                if c.x1 - c.x0 > 1.1 * max(g.x1 - g.x0, 1.0) or min(c.x1, g.x1) - max(c.x0, g.x0) < 0.5 * min(c.x1 - c.x0, g.x1 - g.x0):
                    continue
                below, above = g.y0 - c.y1, c.y0 - g.y1
                s = 2 - below / below_most if 0 <= below <= below_most else 1 - above / above_most if 0 <= above <= above_most else None
                if s is not None and (score is None or s + c.opens > score):
                    best, score = c, s + c.opens
            if best is not None:
                free.remove(best)
                out.append((g.doc_id, g.page, g.id, best.id, round(float(score), 6)))
        return pd.DataFrame(out, columns=["doc_id", "page", "figure", "caption", "score"])

    return sized.groupBy("doc_id", "page").applyInPandas(run, "doc_id long, page int, figure long, caption long, score double")
