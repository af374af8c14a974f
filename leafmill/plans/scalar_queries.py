"""Queries of scalars and kernels over whole tables: markers, hyphens, ligatures, Roman numerals, dates,
phones, distances, hashes, lines, clusters, reading order and dictionary matches."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import hashes as H
from ..functions import text as X
from ..functions import values as V
from ..operators import layout as L
from ..operators import ordering as O
from ..sources.tables import BLOCKS_SQL, line_blocks, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(r"""WITH t AS (SELECT doc_id, replace(text, 'e ', 'e- ') AS t FROM documents)
SELECT doc_id, md5(regexp_replace(regexp_replace(t, '(\p{L})-\s+(\p{Ll})', '\1\2', 'g'), '(\p{L})-\s+(\p{Ll})', '\1\2', 'g')) AS joined FROM t""")
def joined_hyphens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.join_hyphenated(F.replace("text", F.lit("e "), F.lit("e- ")))).alias("joined"))


@query("SELECT doc_id, md5(text) AS expanded FROM documents")
def expanded_ligatures(spark, sf_dir):
    """Texts whose letter pairs were turned into ligatures come back as they were."""
    t = F.replace(F.replace(F.replace("text", F.lit("ffi"), F.lit("ﬃ")), F.lit("fi"), F.lit("ﬁ")), F.lit("fl"), F.lit("ﬂ"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.expand_ligatures(t)).alias("expanded"))


@query(f"""WITH {BLOCKS_SQL} SELECT doc_id, idx, '# a > ## b > ### ' || text AS context, trim(text) AS plain FROM b WHERE kind = 'heading' AND NOT starts_with(trim(text), '#')""")
def heading_contexts(spark, sf_dir):
    b = line_blocks(table(spark, sf_dir, "documents")).filter("kind = 'heading' AND NOT startswith(trim(text), '#')")
    return b.select("doc_id", "idx", X.heading_context(F.array(F.lit("a"), F.lit("b"), F.col("text"))).alias("context"), X.strip_heading_marks(F.concat(F.lit("### "), "text")).alias("plain"))


_ROMAN = (("iv", 4), ("IX", 9), ("xlii", 42), ("MCMXCIV", 1994), ("mmxxiv", 2024), ("iiii", 4), ("hello", None), ("dcxc", 690), ("", None))


@query("WITH r(k, v) AS (VALUES " + ", ".join(f"({i}, {'NULL' if n is None else n})" for i, (_, n) in enumerate(_ROMAN)) + f") SELECT p_partkey, CAST(v AS INT) AS value FROM part JOIN r ON p_partkey % {len(_ROMAN)} = k")
def roman_values(spark, sf_dir):
    t = F.element_at(F.array(*(F.lit(x) for x, _ in _ROMAN)), (F.col("p_partkey") % len(_ROMAN) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", X.roman_value(t).alias("value"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 10:30:05 +02:00' WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 23:59:59' ELSE 'D:' || o_orderkey END AS written FROM orders")
def pdf_dates(spark, sf_dir):
    day, k = F.date_format("o_orderdate", "yyyyMMdd"), F.col("o_orderkey") % 3
    raw = F.when(k == 0, F.concat(F.lit("D:"), day, F.lit("103005+02'00'"))).when(k == 1, F.concat(F.lit("D:"), day, F.lit("235959"))).otherwise(F.concat(F.lit("D:"), F.col("o_orderkey").cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", V.pdf_date(raw).alias("written"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '+49' || lpad(CAST(c_custkey AS VARCHAR), 8, '7') WHEN 1 THEN '555' || lpad(CAST(c_custkey AS VARCHAR), 7, '1') END AS phone, c_custkey % 4 < 2 AS is_phone FROM customer""")
def phone_numbers(spark, sf_dir):
    n, k = F.col("c_custkey").cast("string"), F.col("c_custkey") % 4
    raw = (
        F.when(k == 0, F.concat(F.lit(" +49 "), F.lpad(n, 8, "7"))).when(k == 1, F.concat(F.lit("(555) "), F.lpad(n, 7, "1")))
        .when(k == 2, F.concat(F.lit("+12 ab "), F.lpad(n, 8, "7"))).otherwise(F.concat(F.lit("+"), F.lpad(n, 5, "9")))
    )
    return table(spark, sf_dir, "customer").select("c_custkey", V.phone_digits(raw).alias("phone"), V.is_phone(raw).alias("is_phone"))


@query(f"""WITH {BLOCKS_SQL}, p AS (SELECT *, lag(x0) OVER w AS a0, lag(x1) OVER w AS a1 FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY idx))
SELECT doc_id, idx, round(CASE WHEN least(x1 - x0, a1 - a0) > 0 THEN greatest(0, least(x1, a1) - greatest(x0, a0)) / least(x1 - x0, a1 - a0) ELSE 0 END, 6) AS shared FROM p WHERE a0 IS NOT NULL""")
def shared_widths(spark, sf_dir):
    """How much of its width each block shares with the one before."""
    w = W.partitionBy("doc_id").orderBy("idx")
    b = line_blocks(table(spark, sf_dir, "documents"))
    b = b.select("doc_id", "idx", "x0", "y0", "x1", "y1", *(F.lag(c).over(w).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1"))).filter("a_x0 IS NOT NULL")
    return b.select("doc_id", "idx", F.round(G.horizontal_overlap(G.box(), G.box("a_")), 6).alias("shared"))


@query("""WITH n AS (SELECT p_partkey, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(p_name, ''), lambda c: ord(c)::HUGEINT)), lambda h, c: (xor(h, c) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS h FROM part)
SELECT p_partkey, lpad(lower(to_hex(CAST(h AS UBIGINT))), 16, '0') AS fnv FROM n""")
def name_hashes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", H.fnv1a_hex()(F.col("p_name")).alias("fnv"))


def _boxes(spark, sf_dir):
    """Lines in two columns, cut in halves that stand a little apart."""
    b = line_blocks(table(spark, sf_dir, "documents")).filter("n > 0")
    return b.withColumn("x0", F.col("x0") + 250.0 * (F.col("idx") % 2)).withColumn("x1", F.col("x0") + 200.0).withColumn("y0", F.col("y0") + 30.0 * (F.col("idx") % 2) + (F.col("idx") % 5)).withColumn("y1", F.col("y0") + 12.0)


@query()
def anchored_lines(spark, sf_dir):
    """Lines of a page; compared with brute force in the tests."""
    return O.anchored_lines(_boxes(spark, sf_dir))


@query()
def reading_orders(spark, sf_dir):
    """Precedence order of a page's blocks; compared with brute force in the tests."""
    return O.reading_order(_boxes(spark, sf_dir))


@query()
def column_clusters(spark, sf_dir):
    """Representatives of the left edges of each page, and the bounds between them; a page has few edges.
    Compared with brute force in the tests."""
    edges = _boxes(spark, sf_dir).groupBy("doc_id", "page").agg(F.collect_set("x0").alias("xs"), F.min("x0").alias("least"), F.max("x1").alias("most"))
    c = edges.select("doc_id", "page", "least", "most", O.clustered(F.col("xs"), 15.0).alias("columns"))
    return c.select("doc_id", "page", "columns", O.column_bounds(F.col("columns"), F.col("least"), F.col("most")).alias("bounds"))


@query()
def dictionary_terms(spark, sf_dir):
    """Longest matches of a dictionary in all texts; compared with brute force in the tests."""
    terms = [r[0] for r in table(spark, sf_dir, "nation").select(F.lower("n_name")).union(spark.createDataFrame([(x,) for x in ("the", "there", "an", "and", "die", "dies", "que")], "t string")).collect()]
    return O.dictionary_matches(table(spark, sf_dir, "documents"), "doc_id", "text", sorted(terms))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS canonical FROM documents")
def exact_dedup_members(spark, sf_dir):
    return H.dedup_members(table(spark, sf_dir, "documents"), "doc_id", F.coalesce("text", F.lit("")))


@query()
def line_word_errors(spark, sf_dir):
    """Word error rate and accuracy of each line against the one before; compared with brute force in the tests."""
    p = line_blocks(table(spark, sf_dir, "documents")).withColumn("before", F.lag("text").over(W.partitionBy("doc_id").orderBy("idx"))).filter("before IS NOT NULL")
    rate = X.word_error_rate(F.col("before"), F.col("text"))
    return p.select("doc_id", "idx", rate.alias("wer")).select("doc_id", "idx", F.round("wer", 6).alias("wer"), F.round(X.accuracy(F.col("wer")), 6).alias("accuracy"))


@query(f"""WITH {BLOCKS_SQL}, a AS (SELECT doc_id, idx, regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') AS text FROM b), p AS (SELECT doc_id, idx, text, lag(text) OVER (PARTITION BY doc_id ORDER BY idx) AS before FROM a)
SELECT doc_id, idx, round(CASE WHEN length(before) = 0 THEN CASE WHEN length(text) = 0 THEN 1.0 ELSE 0.0 END ELSE greatest(0, 1 - levenshtein(before, text) / length(before)) END, 6) AS accuracy FROM p WHERE before IS NOT NULL""")
def line_accuracies(spark, sf_dir):
    b = line_blocks(table(spark, sf_dir, "documents")).withColumn("text", F.regexp_replace("text", "[^\\x00-\\x7F]", "?"))
    p = b.withColumn("before", F.lag("text").over(W.partitionBy("doc_id").orderBy("idx"))).filter("before IS NOT NULL")
    return p.select("doc_id", "idx", F.round(X.accuracy(X.char_error_rate(F.col("before"), F.col("text"))), 6).alias("accuracy"))


_VOTES = ", ".join(f"sum(CASE WHEN ((v >> {i}) & 1) = 1 THEN 1 ELSE -1 END) AS b{i}" for i in range(64))
_PRINT = " | ".join(f"(CASE WHEN coalesce(b{i}, 0) >= 0 THEN 1::UBIGINT << {i} ELSE 0::UBIGINT END)" for i in range(64))


@query(f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\p{{L}}\\p{{N}}]+')) AS w FROM documents),
v AS (SELECT doc_id, CAST('0x' || substr(sha256(w), 1, 16) AS UBIGINT) AS v FROM t), s AS (SELECT doc_id, {_VOTES} FROM v GROUP BY doc_id),
f AS (SELECT d.doc_id, {_PRINT} AS fp FROM documents d LEFT JOIN s USING (doc_id)),
n AS (SELECT doc_id, xor(fp, lag(fp) OVER (PARTITION BY doc_id // 100 ORDER BY doc_id)) AS x FROM f)
SELECT doc_id, CAST(bit_count(x::UBIGINT::BIT) AS INT) AS distance FROM n WHERE x IS NOT NULL""")
def fingerprint_distances(spark, sf_dir):
    """Differing bits of neighbours among each hundred documents."""
    fp = H.fingerprints(table(spark, sf_dir, "documents"), "doc_id", "text")
    before = F.lag("fp").over(W.partitionBy(F.expr("doc_id div 100")).orderBy("doc_id"))
    return fp.withColumn("b", before).filter("b IS NOT NULL").select("doc_id", H.distance(F.col("fp"), F.col("b")).cast("int").alias("distance"))


_NOTES = (("see here¹ and²", "1", None), ("12) text", None, "12"), ("* star", "*", "*"), ("  † dagger", "†", "†"), ("12th text", None, None), ("7", None, "7"), ("plain", None, None), ("3] x⁹", "9", "3"), ("", None, None))


@query("WITH t(k, mark, label) AS (VALUES " + ", ".join(f"({i}, {'NULL' if m is None else repr(m)}, {'NULL' if b is None else repr(b)})" for i, (_, m, b) in enumerate(_NOTES)) + f") SELECT p_partkey, mark, label FROM part JOIN t ON p_partkey % {len(_NOTES)} = k")
def footnotes(spark, sf_dir):
    t = F.element_at(F.array(*(F.lit(x) for x, _, _ in _NOTES)), (F.col("p_partkey") % len(_NOTES) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", X.footnote_mark(t).alias("mark"), X.footnote_label(t).alias("label"))


_TAGS = (("H", "x", "heading", 1), ("H3", "x", "heading", 3), ("H9", "x", "heading", 6), ("H0", "", "heading", 1), ("Hx", "x", "paragraph", None), ("Title", "", "title", None), ("P", "", "paragraph", None), ("L", "", "list", None), ("TR", "x", None, None), ("Span", "x", "paragraph", None), ("Span", " ", None, None), ("Figure", "", "figure", None))


@query("WITH t(k, kind, level) AS (VALUES " + ", ".join(f"({i}, {'NULL' if a is None else repr(a)}, {'NULL' if b is None else b})" for i, (_, _, a, b) in enumerate(_TAGS)) + f") SELECT p_partkey, kind, CAST(level AS INT) AS level FROM part JOIN t ON p_partkey % {len(_TAGS)} = k")
def tagged_blocks(spark, sf_dir):
    pick = lambda j: F.element_at(F.array(*(F.lit(x[j]) for x in _TAGS)), (F.col("p_partkey") % len(_TAGS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", X.tag_block(pick(0), pick(1)).alias("b")).select("p_partkey", "b.kind", "b.level")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '***' || m || '***' WHEN 1 THEN '**' || m || '**' WHEN 2 THEN '*' || m || '*' ELSE '[' || m || '](u%20' || p_partkey || '%29)' END AS markdown FROM (SELECT *, 'a\\*' || replace(p_name, '_', '\\_') AS m FROM part)""")
def span_markdown(spark, sf_dir):
    k = F.col("p_partkey") % 4
    link = F.when(k == 3, F.concat(F.lit("u "), F.col("p_partkey").cast("string"), F.lit(")")))
    return table(spark, sf_dir, "part").select("p_partkey", X.span_markdown(F.concat(F.lit("a*"), "p_name"), k < 2, (k == 0) | (k == 2), link).alias("markdown"))


@query(f"""WITH {BLOCKS_SQL}, c AS (SELECT doc_id, idx // 4 AS idx, n, text, idx % 3 = 0 AS bold, idx % 2 = 0 AS italic FROM b WHERE trim(text) <> '')
SELECT doc_id, CAST(idx AS BIGINT) AS idx, sum(CASE WHEN bold THEN n ELSE 0 END) >= 0.6 * sum(n) AS bold, sum(CASE WHEN italic THEN n ELSE 0 END) >= 0.5 * sum(n) AS italic FROM c GROUP BY doc_id, idx""")
def block_emphasis(spark, sf_dir):
    """Four lines a block, every third of them bold and every second italic."""
    b = line_blocks(table(spark, sf_dir, "documents"))
    return L.emphasis(b.select("doc_id", F.expr("idx div 4").alias("idx"), "text", (F.col("idx") % 3 == 0).alias("bold"), (F.col("idx") % 2 == 0).alias("italic")))
