"""Queries over blocks: statistics, order, sections, spatial joins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..operators import joins as J
from ..operators import layout as L
from ..sources.tables import BLOCKS_SQL, line_blocks, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = "WITH " + BLOCKS_SQL + sql
        return f

    return add


def _blocks(spark, sf_dir):
    return line_blocks(table(spark, sf_dir, "documents"))


@query(""", s AS (SELECT doc_id, round(font_size / 0.5) * 0.5 AS bucket, sum(greatest(n, 1)) AS chars FROM b GROUP BY ALL),
body AS (SELECT doc_id, bucket AS body FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, bucket) = 1),
m AS (SELECT doc_id, list_sort(list(x1 - x0))[count(*) // 2 + 1] AS median_width FROM b GROUP BY doc_id)
SELECT body.doc_id, body, CAST(least(6, (SELECT count(*) FROM s WHERE s.doc_id = body.doc_id AND s.bucket >= 1.15 * body)) AS INT) AS tiers, median_width FROM body JOIN m USING (doc_id)""")
def font_statistics(spark, sf_dir):
    return L.font_statistics(_blocks(spark, sf_dir))


def _paged(spark, sf_dir):
    """Blocks of pages of 612 by 792 points; every fourth document repeats a line at the foot of its
    pages, every third numbers them."""
    b = _blocks(spark, sf_dir)
    last = F.col("idx") % 20 == 19
    number = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Page "), "page", F.lit(" of 9"))).otherwise(F.lit("vii"))
    text = F.when(last & (F.col("doc_id") % 4 == 1), F.concat(F.lit("Report  no "), "page")).when(last & (F.col("doc_id") % 3 == 0), number).otherwise(F.col("text"))
    return b.withColumn("text", text).withColumn("page_width", F.lit(612.0)).withColumn("page_height", F.lit(792.0))


_PAGED = r""", pg AS (SELECT * REPLACE (CASE WHEN idx % 20 = 19 AND doc_id % 4 = 1 THEN 'Report  no ' || page WHEN idx % 20 = 19 AND doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'Page ' || page || ' of 9' ELSE 'vii' END ELSE text END AS text) FROM b),
m AS (SELECT *, CASE WHEN y1 >= 792 * 0.88 THEN 'top' WHEN y0 <= 792 * 0.12 THEN 'bottom' END AS band, CAST(floor(x0 / 61.2) AS INT) AS x_bucket FROM pg WHERE x1 > x0 AND y1 > y0)"""


@query(_PAGED + r""", p AS (SELECT doc_id, max(page) AS n_pages FROM pg GROUP BY doc_id),
t AS (SELECT *, trim(regexp_replace(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '', 'g'), '\s+', ' ', 'g')) AS running FROM m WHERE band IS NOT NULL),
rh AS (SELECT doc_id, band, x_bucket, running, count(DISTINCT page) AS pages FROM t WHERE running <> '' GROUP BY ALL)
SELECT doc_id, band, x_bucket, running, pages, round(least(0.98, 0.5 + 0.4 * pages / n_pages), 6) AS confidence FROM rh JOIN p USING (doc_id) WHERE pages >= greatest(2, ceil(n_pages / 2.0))""")
def running_headers(spark, sf_dir):
    return L.running_headers(_paged(spark, sf_dir))


@query(_PAGED + r""", v AS (SELECT *, CASE WHEN text = 'vii' THEN 7 WHEN starts_with(text, 'Page ') THEN CAST(regexp_extract(text, '^Page ([0-9]+) of 9$', 1) AS BIGINT) WHEN regexp_matches(text, '^[0-9]{1,12}$') THEN CAST(text AS BIGINT) END AS number FROM m WHERE band IS NOT NULL),
w AS (SELECT *, number - lag(number) OVER o = 1 AND page > lag(page) OVER o AS up, count(*) OVER (PARTITION BY doc_id, band, x_bucket) - 1 AS pairs FROM v WHERE number IS NOT NULL WINDOW o AS (PARTITION BY doc_id, band, x_bucket ORDER BY page, idx)),
z AS (SELECT *, count(*) FILTER (up) OVER (PARTITION BY doc_id, band, x_bucket) AS ups FROM w)
SELECT doc_id, idx, number, CASE WHEN ups * 2 >= pairs THEN 0.95 ELSE 0.6 END::DOUBLE AS confidence FROM z WHERE pairs > 0""")
def page_numbers(spark, sf_dir):
    return L.page_numbers(_paged(spark, sf_dir))


@query(r""", f AS (SELECT doc_id, idx, text, font_size / 9.75 AS size_ratio, idx % 5 = 0 AS bold, idx % 3 = 0 AS italic, 1 + idx % 5 AS line_count, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS word_count,
  least(1.0, (x1 - x0) / 400) AS fill, regexp_matches(text, '[.!?:]\s*$') AS closed, 24.0 AS gap_above, 12.0 + idx % 8 AS line_height FROM b),
s AS (SELECT *, greatest(0, least(1, CASE WHEN size_ratio >= 1.15 THEN 0.45 WHEN size_ratio >= 1.05 THEN 0.15 ELSE 0 END + CASE WHEN line_count <= 2 THEN 0.1 ELSE 0 END + CASE WHEN word_count <= 12 THEN 0.1 ELSE 0 END + CASE WHEN fill <= 0.6 THEN 0.1 ELSE 0 END
    + CASE WHEN bold THEN 0.15 WHEN italic THEN 0.03 ELSE 0 END + CASE WHEN gap_above >= 1.5 * line_height THEN 0.08 ELSE 0 END + CASE WHEN regexp_matches(text, '^\s*((?i:chapter|section|appendix) \s*[0-9A-Za-z]|[0-9][0-9.]{0,11}\s)') THEN 0.2 ELSE 0 END
    - CASE WHEN closed AND word_count > 12 THEN 0.25 ELSE 0 END - CASE WHEN line_count >= 4 THEN 0.3 ELSE 0 END)) AS h,
  greatest(0, least(1, 0.55 + CASE WHEN line_count >= 2 THEN 0.1 ELSE 0 END + CASE WHEN closed THEN 0.1 ELSE 0 END + CASE WHEN fill >= 0.6 THEN 0.1 ELSE 0 END + CASE WHEN size_ratio BETWEEN 0.95 AND 1.1 THEN 0.1 ELSE 0 END
    - CASE WHEN bold AND word_count <= 12 THEN 0.2 ELSE 0 END - CASE WHEN word_count <= 2 AND line_count = 1 AND NOT closed THEN 0.25 ELSE 0 END)) AS p FROM f)
SELECT doc_id, idx, CASE WHEN greatest(round(h, 9), round(p, 9)) < 0.5 THEN 'text' WHEN round(p, 9) > round(h, 9) THEN 'paragraph' ELSE 'heading' END AS class, round(greatest(h, p)::DOUBLE, 6) AS score FROM s""")
def block_classes(spark, sf_dir):
    c = F.col
    f = _blocks(spark, sf_dir).select(
        "doc_id", "idx", "text", (c("font_size") / 9.75).alias("size_ratio"), (c("idx") % 5 == 0).alias("bold"), (c("idx") % 3 == 0).alias("italic"), (1 + c("idx") % 5).alias("line_count"),
        F.size(F.filter(F.split("text", "(?U)\\s+"), lambda w: w != "")).alias("word_count"), F.least(F.lit(1.0), (c("x1") - c("x0")) / 400).alias("fill"), X.ends_sentence(c("text")).alias("closed"), F.lit(24.0).alias("gap_above"), (12.0 + c("idx") % 8).alias("line_height"),
    )
    return L.classified(f).select("doc_id", "idx", "class", F.round("score", 6).alias("score"))


@query(""" SELECT doc_id, idx, row_number() OVER (PARTITION BY doc_id ORDER BY page, y1 DESC, x0, idx) - 1 AS reading,
  lag(y0) OVER (PARTITION BY doc_id, page ORDER BY y1 DESC, x0, idx) - y1 AS gap_above FROM b""")
def page_order(spark, sf_dir):
    return L.page_order(_blocks(spark, sf_dir))


@query(""", f AS (SELECT *, CASE WHEN kind <> lag(kind) OVER (PARTITION BY doc_id ORDER BY idx) THEN 1 ELSE 0 END AS new FROM b),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY idx) AS run FROM f)
SELECT doc_id, CAST(run AS BIGINT) AS run, kind, min(idx) AS first, max(idx) AS last, count(*) AS size FROM r GROUP BY doc_id, run, kind""")
def consecutive_runs(spark, sf_dir):
    return L.consecutive_runs(_blocks(spark, sf_dir), "doc_id", "kind", "idx")


_LEVEL = "CASE WHEN kind = 'heading' THEN CASE WHEN n <= 10 THEN 1 WHEN n <= 20 THEN 2 ELSE 3 END END"


@query(f""", h AS (SELECT doc_id, idx, text, {_LEVEL} AS level FROM b),
w AS (SELECT *, last_value(CASE WHEN level = 1 THEN idx END IGNORE NULLS) OVER o AS i1, last_value(CASE WHEN level = 2 THEN idx END IGNORE NULLS) OVER o AS i2, last_value(CASE WHEN level = 3 THEN idx END IGNORE NULLS) OVER o AS i3,
  last_value(CASE WHEN level = 1 THEN text END IGNORE NULLS) OVER o AS t1, last_value(CASE WHEN level = 2 THEN text END IGNORE NULLS) OVER o AS t2, last_value(CASE WHEN level = 3 THEN text END IGNORE NULLS) OVER o AS t3
  FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING))
SELECT doc_id, idx, array_to_string(list_filter([CASE WHEN i1 > -1 THEN '# ' || t1 END, CASE WHEN i2 > coalesce(i1, -1) THEN '## ' || t2 END, CASE WHEN i3 > greatest(coalesce(i1, -1), coalesce(i2, -1)) THEN '### ' || t3 END], lambda x: x IS NOT NULL), ' > ') AS section FROM w""")
def section_paths(spark, sf_dir):
    b = _blocks(spark, sf_dir).withColumn("level", F.expr(_LEVEL))
    p = L.section_paths(b)
    return p.select("doc_id", "idx", F.array_join(F.transform("path", lambda t: F.concat(F.when(F.length(t) <= 10, "# ").when(F.length(t) <= 20, "## ").otherwise("### "), t)), " > ").alias("section"))


@query(""", i AS (SELECT doc_id, x0 AS s, x1 AS e, idx FROM b WHERE x1 > x0),
f AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM i)
SELECT doc_id, sum(greatest(0, e - greatest(s, coalesce(pe, s)))) AS covered, coalesce(max(greatest(0, s - pe)), 0.0) AS widest_gap FROM f GROUP BY doc_id""")
def interval_union(spark, sf_dir):
    b = _blocks(spark, sf_dir).filter("x1 > x0").select("doc_id", F.col("x0").alias("s"), F.col("x1").alias("e"))
    return L.interval_union(b, "doc_id", "s", "e")


@query(""", t AS (SELECT doc_id AS key, page AS "group", idx, greatest(1, (n + 3) // 4) AS tokens FROM b),
s AS (SELECT *, sum(tokens) OVER w AS total, row_number() OVER w AS nth FROM t WINDOW w AS (PARTITION BY key, "group" ORDER BY idx DESC ROWS UNBOUNDED PRECEDING))
SELECT key, "group", idx, tokens, total <= 64 OR nth = 1 AS taken FROM s""")
def overlap_suffix(spark, sf_dir):
    t = _blocks(spark, sf_dir).select(F.col("doc_id").alias("key"), F.col("page").alias("group"), "idx", F.expr("greatest(1, (n + 3) div 4)").alias("tokens"))
    return L.overlap_suffix(t, 64)


@query(""", r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS x, row_number() OVER (PARTITION BY doc_id ORDER BY font_size, idx) AS y FROM b),
p AS (SELECT a.doc_id, avg(CASE WHEN a.y < c.y THEN 1.0 ELSE 0.0 END) AS s FROM r a JOIN r c ON a.doc_id = c.doc_id AND a.x < c.x GROUP BY a.doc_id)
SELECT d.doc_id AS key, round(coalesce(s, 1.0), 6) AS order_score FROM (SELECT DISTINCT doc_id FROM r) d LEFT JOIN p USING (doc_id)""")
def pairwise_order(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    a, s = W.partitionBy("doc_id").orderBy("idx"), W.partitionBy("doc_id").orderBy("font_size", "idx")
    r = b.select(F.col("doc_id").alias("key"), F.row_number().over(a).alias("a"), F.row_number().over(s).alias("b"))
    return L.pairwise_order(r).withColumn("order_score", F.round("order_score", 6))


@query(""" SELECT lang, list_sort(list(n_chars))[count(*) // 2 + 1] AS median, list_sort(list(n_chars))[CAST(ceil((count(*) - 1) * 0.95) AS INT) + 1] AS p95 FROM documents GROUP BY lang""")
def length_ranks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return L.upper_median(d, "lang", "n_chars").join(L.nearest_rank(d, "lang", "n_chars", 0.95).withColumnRenamed("value", "p95"), "lang")


def _tables(b):
    return b.filter("kind = 'table'").select("doc_id", "page", F.col("idx").alias("id"), "x0", "y0", "x1", "y1")


_T = ", t AS (SELECT doc_id, page, idx AS id, x0, y0, x1, y1 FROM b WHERE kind = 'table'), q AS (SELECT doc_id, page, idx AS id, confidence, x0 - 6 AS x0, y0 - 14 AS y0, x1 + 6 AS x1, y1 + 14 AS y1 FROM b WHERE n > 0)"
_IOU = "(greatest(0, least(q.x1, t.x1) - greatest(q.x0, t.x0)) * greatest(0, least(q.y1, t.y1) - greatest(q.y0, t.y0)))"


def _proposals(b):
    return b.filter("n > 0").select("doc_id", "page", F.col("idx").alias("id"), "confidence", (F.col("x0") - 6).alias("x0"), (F.col("y0") - 14).alias("y0"), (F.col("x1") + 6).alias("x1"), (F.col("y1") + 14).alias("y1"))


@query(_T + f""", s AS (SELECT q.doc_id, q.id AS proposal, t.id AS match, {_IOU} / ((q.x1 - q.x0) * (q.y1 - q.y0) + (t.x1 - t.x0) * (t.y1 - t.y0) - {_IOU}) AS iou FROM q JOIN t USING (doc_id, page))
SELECT doc_id, proposal, match, round(iou, 6) AS iou FROM s WHERE iou >= 0.2 QUALIFY row_number() OVER (PARTITION BY doc_id, proposal ORDER BY iou DESC, match) = 1""")
def proposal_matches(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    return J.best_iou(_proposals(b), _tables(b))


@query(_T + f""" SELECT q.doc_id, q.id FROM q WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = q.doc_id AND t.page = q.page AND ({_IOU} / ((q.x1 - q.x0) * (q.y1 - q.y0) + (t.x1 - t.x0) * (t.y1 - t.y0) - {_IOU}) >= 0.5 OR {_IOU} / ((q.x1 - q.x0) * (q.y1 - q.y0)) >= 0.8))""")
def uncovered_regions(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    return J.without_cover(_proposals(b), _tables(b)).select("doc_id", "id")


@query(""", k AS (SELECT doc_id, page, idx AS link_id, 'u' || idx AS uri, x0, y0 - 30 AS y0, x1, y1 FROM b WHERE kind = 'heading')
SELECT b.doc_id, b.idx, (SELECT min_by(k.uri, k.link_id) FROM k WHERE k.doc_id = b.doc_id AND k.page = b.page AND k.x0 < b.x1 AND b.x0 < k.x1 AND k.y0 < b.y1 AND b.y0 < k.y1) AS uri FROM b""")
def link_join(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    k = b.filter("kind = 'heading'").select("doc_id", "page", F.col("idx").alias("link_id"), F.concat(F.lit("u"), F.col("idx")).alias("uri"), "x0", (F.col("y0") - 30).alias("y0"), "x1", "y1")
    return J.first_overlapping(b, k)


@query(""", n2 AS (SELECT doc_id, page, idx AS id, x0, y0, x1, y1 FROM b WHERE kind = 'heading'),
g2 AS (SELECT a.doc_id, a.id, c.id AS other, sqrt(power(greatest(0, c.x0 - a.x1, a.x0 - c.x1), 2) + power(greatest(0, c.y0 - a.y1, a.y0 - c.y1), 2)) AS gap FROM n2 a JOIN n2 c ON a.doc_id = c.doc_id AND a.page = c.page AND a.id <> c.id)
SELECT doc_id, id, other AS nearest, round(gap, 6) AS gap FROM g2 QUALIFY row_number() OVER (PARTITION BY doc_id, id ORDER BY gap, other) = 1""")
def nearest_heading(spark, sf_dir):
    b = _blocks(spark, sf_dir).filter("kind = 'heading'").select("doc_id", "page", F.col("idx").alias("id"), "x0", "y0", "x1", "y1")
    return J.nearest(b, b)


@query(""", p AS (SELECT doc_id, page, idx AS id, (x0 + x1) / 2 AS x, y0 AS y FROM b), c AS (SELECT doc_id, page, idx AS cell, x0, y0 - 24 AS y0, x1, y1 FROM b WHERE kind = 'table')
SELECT p.doc_id, p.id, c.cell FROM p JOIN c ON p.doc_id = c.doc_id AND p.page = c.page AND p.x BETWEEN c.x0 AND c.x1 AND p.y BETWEEN c.y0 AND c.y1""")
def points_in_cells(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    points = b.select("doc_id", "page", F.col("idx").alias("id"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), F.col("y0").alias("y"))
    cells = b.filter("kind = 'table'").select("doc_id", "page", F.col("idx").alias("cell"), "x0", (F.col("y0") - 24).alias("y0"), "x1", "y1")
    return J.points_in_cells(points, cells)


@query(""", c AS (SELECT doc_id, idx, string_split(text, ' | ') AS cs FROM b WHERE kind = 'table'),
x AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS row, cs FROM c),
u AS (SELECT doc_id, row, unnest(cs) AS text, unnest(range(0, len(cs))) AS col FROM x),
r AS (SELECT doc_id, row // 2 AS row, col, text FROM u WHERE row % 2 = 0), h AS (SELECT doc_id, row // 2 AS row, col, text FROM u WHERE row % 2 = 1),
j AS (SELECT coalesce(r.doc_id, h.doc_id) AS doc_id, r.text AS a, h.text AS z FROM r FULL JOIN h ON r.doc_id = h.doc_id AND r.row = h.row AND r.col = h.col),
s AS (SELECT doc_id, count(*) FILTER (a = z) AS equal, count(*) FILTER (z IS NULL) AS missing, count(*) FILTER (a IS NULL) AS extra, count(*) FILTER (a <> z) AS changed FROM j GROUP BY doc_id)
SELECT *, round(CASE WHEN 2 * equal + 2 * changed + missing + extra = 0 THEN 1.0 ELSE 2 * equal / (2 * equal + 2 * changed + missing + extra) END, 6) AS f1 FROM s""")
def grid_difference(spark, sf_dir):
    """Even against odd rows of the pipe tables in each document."""
    t = _blocks(spark, sf_dir).filter("kind = 'table'").withColumn("row", F.row_number().over(W.partitionBy("doc_id").orderBy("idx")) - 1)
    u = t.select("doc_id", "row", F.posexplode(F.split("text", " \\| ")).alias("col", "text"))
    half = lambda k: u.filter(F.col("row") % 2 == k).select("doc_id", F.expr("row div 2").alias("row"), "col", "text")
    return J.grid_difference(half(0), half(1), "doc_id")


@query(""" SELECT doc_id, idx, ((x0 + x1) / 2 BETWEEN 72 AND 300 AND (y0 + y1) / 2 BETWEEN 400 AND 760) OR
  CASE WHEN (x1 - x0) * (y1 - y0) > 0 THEN greatest(0, least(x1, 300) - greatest(x0, 72)) * greatest(0, least(y1, 760) - greatest(y0, 400)) / ((x1 - x0) * (y1 - y0)) ELSE 0 END >= 0.5 AS kept FROM b""")
def region_filter(spark, sf_dir):
    region = G.Box(*(F.lit(float(v)) for v in (72, 400, 300, 760)))
    return _blocks(spark, sf_dir).select("doc_id", "idx", G.in_region(G.box(), region).alias("kept"))


@query(""", d AS (SELECT *, CAST(90 * (idx % 4) AS INT) AS turn FROM b)
SELECT doc_id, idx, CASE turn WHEN 90 THEN y0 WHEN 180 THEN 612 - x1 WHEN 270 THEN 792 - y1 ELSE x0 END AS x0, CASE turn WHEN 90 THEN 612 - x1 WHEN 180 THEN 792 - y1 WHEN 270 THEN x0 ELSE y0 END AS y0,
  CASE turn WHEN 90 THEN y1 WHEN 180 THEN 612 - x0 WHEN 270 THEN 792 - y0 ELSE x1 END AS x1, CASE turn WHEN 90 THEN 612 - x0 WHEN 180 THEN 792 - y0 WHEN 270 THEN x1 ELSE y1 END AS y1 FROM d""")
def rotated_boxes(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    r = G.rotate(G.box(), 90 * (F.col("idx") % 4), F.lit(612.0), F.lit(792.0))
    return b.select("doc_id", "idx", *(c.alias(n) for c, n in zip(r, ("x0", "y0", "x1", "y1"), strict=True)))


@query()
def proposal_suppression(spark, sf_dir):
    """Greedy; compared with brute force in the tests."""
    p = _proposals(_blocks(spark, sf_dir))
    shifted = p.withColumn("id", F.col("id") + 1_000_000).withColumn("confidence", F.col("confidence") - 0.5).withColumn("x0", F.col("x0") + 6.0 * (F.col("id") % 9))
    return J.suppress(p.unionByName(shifted), 0.70)


@query()
def caption_claims(spark, sf_dir):
    """Greedy; compared with brute force in the tests."""
    b = _blocks(spark, sf_dir)
    texts = b.filter("kind = 'heading'").select("doc_id", "page", F.col("idx").alias("id"), "x0", (F.col("y0") + 20).alias("y0"), "x1", (F.col("y1") + 20).alias("y1"), "text")
    return J.claim_captions(_tables(b), texts, 12.0)
