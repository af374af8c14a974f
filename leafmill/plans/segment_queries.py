"""Queries over regions, rows, paragraphs, text layers, histograms and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import segments as S
from ..sources.tables import BLOCKS_SQL, line_blocks, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = "WITH " + BLOCKS_SQL + sql
        return f

    return add


def _scattered(spark, sf_dir):
    """Blocks in two columns, with a wide space after every fifth line."""
    b = line_blocks(table(spark, sf_dir, "documents"))
    left = F.col("idx") % 2 == 0
    b = b.withColumn("x0", F.when(left, 50.0).otherwise(350.0)).withColumn("x1", F.col("x0") + 200.0)
    return b.withColumn("y1", 760.0 - 30.0 * (F.col("idx") % 20) - 40.0 * F.floor((F.col("idx") % 20) / 5)).withColumn("y0", F.col("y1") - 12.0)


@query()
def page_regions(spark, sf_dir):
    """Recursive cuts; compared with brute force in the tests."""
    return S.regions(_scattered(spark, sf_dir), 60.0, 40.0)


@query()
def mean_rows(spark, sf_dir):
    """Rows by running means; compared with brute force in the tests."""
    return S.mean_rows(_scattered(spark, sf_dir), 16.0)


@query(""", ln AS (SELECT doc_id, page, idx % 2 AS region, idx, 760.0::DOUBLE - 30 * (idx % 20) - 40 * ((idx % 20) // 5) - 6 AS c FROM b),
p AS (SELECT *, abs(lag(c) OVER (PARTITION BY doc_id, page, region ORDER BY c DESC, idx) - c) AS p FROM ln),
m AS (SELECT doc_id, page, region, list_sort(list(p))[count(*) // 2 + 1] AS typical FROM p WHERE p > 0 GROUP BY ALL)
SELECT doc_id, page, CAST(region AS INT) AS region, idx, CAST(sum(CASE WHEN p > 1.5 * coalesce(typical, 12) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, region ORDER BY c DESC, idx) AS BIGINT) AS paragraph FROM p LEFT JOIN m USING (doc_id, page, region)""")
def paragraphs(spark, sf_dir):
    return S.paragraphs(_scattered(spark, sf_dir).withColumn("region", (F.col("idx") % 2).cast("int")))


_LAYER = """SELECT doc_id, w > o AS has_text, CASE WHEN w = 0 OR o = 0 THEN 0.95 WHEN w > o THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence, w = 0 AS scanned, CASE WHEN w > o AND o = 0 THEN 'extract_text' WHEN w > o THEN 'mixed' ELSE 'use_ocr' END AS advice FROM pl"""


@query(f""", pc AS (SELECT doc_id, page, sum(n) AS n FROM b GROUP BY ALL), p AS (SELECT doc_id, page, CASE WHEN doc_id % 3 = 0 AND page % 2 = 1 OR doc_id % 5 = 0 THEN 0 ELSE n END AS chars FROM pc), pl AS (SELECT doc_id, count(*) FILTER (chars > 0) AS w, count(*) FILTER (chars = 0) AS o FROM p WHERE page <= 3 GROUP BY doc_id) {_LAYER}""")
def text_layers(spark, sf_dir):
    """The verdict on three pages at most."""
    p = line_blocks(table(spark, sf_dir, "documents")).groupBy("doc_id", "page").agg(F.sum("n").alias("n"))
    bare = (F.col("doc_id") % 3 == 0) & (F.col("page") % 2 == 1) | (F.col("doc_id") % 5 == 0)
    return S.text_layer(p.select("doc_id", "page", F.when(bare, 0).otherwise(F.col("n")).alias("chars")), 3)


@query(""", h AS (SELECT doc_id, least(n, 255) AS v FROM b), c AS (SELECT doc_id, v, count(*) AS n FROM h GROUP BY ALL),
t AS (SELECT doc_id, v, sum(n) OVER o AS wb, sum(v * n) OVER o AS sb, sum(n) OVER (PARTITION BY doc_id) AS n, sum(v * n) OVER (PARTITION BY doc_id) AS s FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY v)),
x AS (SELECT doc_id, v, wb::DOUBLE * (n - wb)::DOUBLE * power(sb::DOUBLE / wb - (s - sb)::DOUBLE / (n - wb), 2) AS between FROM t WHERE wb < n)
SELECT d.doc_id, CAST(coalesce(first(v ORDER BY between DESC, v), 0) AS BIGINT) AS threshold FROM (SELECT DISTINCT doc_id FROM b) d LEFT JOIN x USING (doc_id) GROUP BY d.doc_id""")
def length_thresholds(spark, sf_dir):
    """The length that parts the short lines of each document from the long ones; 256 counts a document."""
    c = line_blocks(table(spark, sf_dir, "documents")).groupBy("doc_id", F.least("n", F.lit(255)).alias("v")).agg(F.count("*").alias("c"))
    m = c.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("v", "c"))).alias("m"))
    levels = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.coalesce(F.col("m")[i], F.lit(0)))
    return m.select("doc_id", S.otsu_threshold(levels).alias("threshold"))


_TERMS = ("an", "the", "e-", "aa", "Lorem ", "zzz")


@query(""", w AS (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY idx) AS t FROM b GROUP BY ALL), k AS (SELECT doc_id, page, lower(trim(regexp_replace(replace(t, '-' || chr(10), ''), '\\s+', ' ', 'g'))) AS t FROM w),
q AS (SELECT doc_id, page, t, unnest(['an', 'the', 'e-', 'aa', 'lorem', 'zzz']) AS term FROM k)
SELECT doc_id, page, term, (length(t) - length(replace(t, term, ''))) // length(term) AS hits FROM q WHERE contains(t, term)""")
def page_searches(spark, sf_dir):
    """How often each of some terms is found on each page."""
    b = line_blocks(table(spark, sf_dir, "documents"))
    pages = b.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "\n").alias("text"))
    found = pages.select("doc_id", "page", F.explode(F.array(*(F.struct(F.lit(t.strip().lower()).alias("term"), F.size(S.matches(F.col("text"), t)).cast("long").alias("hits")) for t in _TERMS))).alias("f"))
    return found.select("doc_id", "page", "f.term", "f.hits").filter("hits > 0")


@query(""", t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents), p AS (SELECT doc_id, len(w) AS n, unnest(w) AS x, unnest(range(0, len(w))) AS i FROM t),
c AS (SELECT doc_id, CAST(i // 50 AS INT) AS chunk, count(*) AS tokens, md5(string_agg(x, ' ' ORDER BY i)) AS digest FROM p GROUP BY doc_id, i // 50)
SELECT * FROM c""")
def token_chunks(spark, sf_dir):
    """Chunks of fifty tokens."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)).alias("w"))
    c = t.select("doc_id", F.explode(S.token_chunks(F.col("w"), 50)).alias("c"))
    return c.select("doc_id", "c.chunk", F.size("c.tokens").cast("long").alias("tokens"), F.md5(F.array_join("c.tokens", " ")).alias("digest"))


@query(""", t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents), p AS (SELECT doc_id, unnest(w) AS x, unnest(range(0, len(w))) AS i FROM t),
n AS (SELECT doc_id, i, x, lead(x) OVER (PARTITION BY doc_id ORDER BY i) AS y FROM p)
SELECT doc_id, i AS at FROM n WHERE x = 'the' AND y IN (SELECT y FROM n WHERE x = 'the' AND y IS NOT NULL GROUP BY y ORDER BY count(*) DESC, y LIMIT 1)""")
def token_matches(spark, sf_dir):
    """Where the commonest pair of words that begins with 'the' stands."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)).alias("w"))
    pairs = t.select(F.explode(F.arrays_zip(F.col("w").alias("x"), F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))).alias("y"))).alias("p")).filter("p.x = 'the' AND p.y IS NOT NULL")
    first = pairs.groupBy("p.y").count().orderBy(F.desc("count"), "y").first()
    query_ = F.array(F.lit("the"), F.lit(first[0] if first else "the"))
    return t.select("doc_id", F.explode(S.token_matches(F.col("w"), query_)).alias("at")).select("doc_id", F.col("at").cast("long").alias("at"))


@query(r""" SELECT doc_id, '[' || string_agg('{"id":' || idx || ',"page":' || page || ',"kind":"' || kind || '","digest":"' || md5(text) || '","bbox":[' || CAST(x0 AS VARCHAR) || ',' || CAST(y1 AS VARCHAR) || ']}', ',' ORDER BY idx) || ']' AS blocks FROM b GROUP BY doc_id""")
def block_json(spark, sf_dir):
    """The blocks of each document as JSON, in order; a document is one row here, whose lines never leave its task."""
    b = line_blocks(table(spark, sf_dir, "documents")).select("doc_id", F.struct(F.col("idx").alias("id"), "page", "kind", F.md5("text").alias("digest"), F.array("x0", "y1").alias("bbox")).alias("b"))
    return b.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list("b"))).alias("blocks"))
