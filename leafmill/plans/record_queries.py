"""Queries over records: typed values, roll-ups, sets, key joins, sessions, chunks, pages."""

from __future__ import annotations

import functools

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..functions.hashes import content_chunks
from ..operators import chunking, status
from ..sources.tables import BLOCKS_SQL, line_blocks, table
from ..streaming import windows

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


@query()
def chunk_documents(spark, sf_dir):
    """Greedy packing; compared with invariants and brute force in the tests."""
    return chunking.chunk_documents(table(spark, sf_dir, "documents"), chunking.Options(target=256, overlap=32))


@query()
def content_defined_chunks(spark, sf_dir):
    """Chunk lengths add up to the input; tested so."""
    return content_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


# raw values in many shapes, made of orders; what they mean is in the SQL alone
_SHAPES = (
    "01/02/24", "Monday, Jan 5, 2024", "32-01-15", "15/01/2024", "13/13/2024", "1234567 89", "555.1234567", "₽ 5", "C$5", "KRW 900", "US$ 1,234.50", "1.234,50",
    "3.14159", "(030) 123-4567", "555-123-4567", "a@b@c.de", "a@.de", "-$5.00", "42,00 €", "5th of March 2021", "2024-02-30", "", "12 %", "eur 5",
)
_MEANT = """(0, 'number', NULL, 10224, NULL, NULL), (1, 'date', '2024-01-05', NULL, NULL, NULL), (2, 'date', '2032-01-15', NULL, NULL, NULL), (3, 'date', '2024-01-15', NULL, NULL, NULL), (4, 'number', NULL, 13132024, NULL, NULL),
  (5, 'number', NULL, 123456789, NULL, NULL), (6, 'number', NULL, 555.1234567, NULL, NULL), (7, 'number', NULL, 5, NULL, NULL), (8, 'amount', NULL, 5, 'CAD', NULL), (9, 'amount', NULL, 900, 'KRW', NULL), (10, 'amount', NULL, 1234.5, 'USD', NULL),
  (11, 'amount', NULL, 1234.5, NULL, NULL), (12, 'number', NULL, 3.14159, NULL, NULL), (13, 'phone', NULL, NULL, NULL, '0301234567'), (14, 'phone', NULL, NULL, NULL, '5551234567'), (15, 'email', NULL, NULL, NULL, 'a@b@c.de'), (16, 'text', NULL, NULL, NULL, 'a@.de'),
  (17, 'amount', NULL, -5, 'USD', NULL), (18, 'amount', NULL, 42, 'EUR', NULL), (19, 'date', '2021-03-05', NULL, NULL, NULL), (20, 'phone', NULL, NULL, NULL, '20240230'), (21, 'text', NULL, NULL, NULL, ''), (22, 'percent', NULL, 12, NULL, NULL), (23, 'amount', NULL, 5, 'EUR', NULL)"""


@query(f"""WITH m(k, kind, iso, number, currency, value) AS (VALUES {_MEANT}),
o AS (SELECT *, o_orderkey % 32 AS s FROM orders),
t AS (SELECT o_orderkey, CASE s WHEN 0 THEN 'date' WHEN 1 THEN 'date' WHEN 2 THEN 'amount' WHEN 3 THEN 'amount' WHEN 4 THEN 'percent' WHEN 5 THEN 'email' WHEN 6 THEN 'phone' WHEN 7 THEN 'text' ELSE kind END AS kind,
  CASE WHEN s < 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE iso END AS iso, CASE s WHEN 2 THEN o_orderkey + 0.5 WHEN 3 THEN -(o_custkey + 0.25) WHEN 4 THEN o_custkey ELSE number END::DOUBLE AS number,
  CASE s WHEN 2 THEN 'USD' WHEN 3 THEN 'EUR' ELSE currency END AS currency,
  CASE s WHEN 5 THEN 'user' || o_custkey || '@example.com' WHEN 6 THEN '+4930' || lpad(CAST(o_custkey AS VARCHAR), 7, '5') WHEN 7 THEN 'order ' || o_orderkey ELSE value END AS value FROM o LEFT JOIN m ON s = k + 8)
SELECT *, CASE kind WHEN 'date' THEN iso WHEN 'amount' THEN printf('%.2f', number) || coalesce(' ' || currency, '') WHEN 'percent' THEN CAST(CAST(number AS BIGINT) AS VARCHAR) || '%'
  WHEN 'number' THEN CASE WHEN number = floor(number) THEN CAST(CAST(number AS BIGINT) AS VARCHAR) ELSE CAST(number AS VARCHAR) END ELSE value END AS rendered FROM t""")
def typed_values(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    shapes = [F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "MM/dd/yyyy"), F.concat(F.lit("$"), k, F.lit(".50")), F.concat(F.lit("("), c, F.lit(".25 EUR)")), F.concat(c, F.lit("%")), F.concat(F.lit("user"), c, F.lit("@example.com")), F.concat(F.lit("+49 30 "), F.lpad(c, 7, "5")), F.concat(F.lit("order "), k)]
    raw = F.element_at(F.array(*map(F.lit, _SHAPES)), (F.greatest(F.lit(8), F.col("o_orderkey") % 32) - 7).cast("int"))
    for i, s in enumerate(shapes):
        raw = F.when(F.col("o_orderkey") % 32 == i, s).otherwise(raw)
    v = o.select("o_orderkey", V.typed(raw).alias("v"))
    return v.select("o_orderkey", "v.kind", "v.iso", "v.number", "v.currency", F.col("v.text").alias("value"), V.rendered(F.col("v")).alias("rendered"))


@query("""WITH r AS (SELECT l_orderkey, CASE WHEN l_discount > 0.08 THEN 'fail' WHEN l_tax > 0.07 THEN 'inconclusive' WHEN l_returnflag = 'N' THEN 'not_applicable' ELSE 'pass' END AS status FROM lineitem),
g AS (SELECT l_orderkey, count(*) FILTER (status = 'pass') AS pass, count(*) FILTER (status = 'fail') AS fail, count(*) FILTER (status = 'inconclusive') AS inconclusive, count(*) FILTER (status = 'not_applicable') AS not_applicable FROM r GROUP BY l_orderkey)
SELECT *, CASE WHEN fail > 0 THEN 'non_conformant' WHEN inconclusive > 0 THEN 'indeterminate' ELSE 'conformant' END AS verdict FROM g""")
def conformance(spark, sf_dir):
    s = F.when(F.col("l_discount") > 0.08, "fail").when(F.col("l_tax") > 0.07, "inconclusive").when(F.col("l_returnflag") == "N", "not_applicable").otherwise("pass")
    return status.conformance(table(spark, sf_dir, "lineitem").select("l_orderkey", s.alias("status")), "l_orderkey")


@query(f"""WITH {BLOCKS_SQL}, p AS (SELECT doc_id, page, sum(n) AS chars, sum((x1 - x0) * (y1 - y0)) / (612 * 792.0::DOUBLE) AS cover, ((doc_id * 13 + page * 7) % 100) / 100.0::DOUBLE AS image FROM b GROUP BY ALL),
s AS (SELECT doc_id, CASE WHEN chars = 0 AND image < 0.05 THEN 'empty' WHEN chars < 20 AND image >= 0.5 THEN 'scanned' WHEN image >= 0.5 AND cover > 0 THEN 'mixed' ELSE 'digital' END AS source FROM p)
SELECT doc_id, count(*) AS pages, CASE WHEN bool_and(source = 'digital') THEN 'digital' WHEN bool_and(source = 'scanned') THEN 'scanned' ELSE 'mixed' END AS source FROM s WHERE source <> 'empty' GROUP BY doc_id""")
def document_source(spark, sf_dir):
    b = line_blocks(table(spark, sf_dir, "documents"))
    p = b.groupBy("doc_id", "page").agg(F.sum("n").alias("chars"), (F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))) / (612 * 792.0)).alias("cover"))
    p = p.withColumn("image", ((F.col("doc_id") * 13 + F.col("page") * 7) % 100) / 100.0)
    return status.document_source(p.select("doc_id", status.page_source(F.col("chars"), F.col("cover"), F.col("image")).alias("source")))


@query("""SELECT p_brand AS term, min(p_type) AS language, count(*) AS entries, arg_min(p_partkey, (-p_size, p_partkey)) AS kept FROM part GROUP BY p_brand""")
def dictionary_merge(spark, sf_dir):
    """Entries of a term: the one of highest priority, then first."""
    p = table(spark, sf_dir, "part")
    first = status.first_per_key(p.select("p_brand", "p_partkey", "p_size"), ["p_brand"], [F.desc("p_size"), "p_partkey"])
    g = p.groupBy("p_brand").agg(F.min("p_type").alias("language"), F.count("*").alias("entries"))
    return g.join(first, "p_brand").select(F.col("p_brand").alias("term"), "language", "entries", F.col("p_partkey").alias("kept"))


@query("""WITH RECURSIVE e AS (SELECT o_custkey, o_orderpriority, o_orderkey, o_orderkey % 50 AS size, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
r AS (SELECT *, size <= 90 AS taken, CASE WHEN size <= 90 THEN [o_orderpriority] ELSE [] END AS have, CASE WHEN size <= 90 THEN size ELSE 0 END AS held FROM e WHERE n = 1
  UNION ALL SELECT o_custkey, o_orderpriority, o_orderkey, size, n, fits, CASE WHEN fits THEN list_append(have, o_orderpriority) ELSE have END, CASE WHEN fits THEN held + size ELSE held END
  FROM (SELECT e.*, r.have, r.held, NOT list_contains(r.have, e.o_orderpriority) AND len(r.have) < 4 AND r.held + e.size <= 90 AS fits FROM r JOIN e ON e.o_custkey = r.o_custkey AND e.n = r.n + 1))
SELECT o_custkey, o_orderpriority, o_orderkey FROM r WHERE taken""")
def capped_set(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey")
    return status.capped_set(o, "o_custkey", "o_orderpriority", F.col("o_orderkey") % 50, "o_orderkey", 4, 90)


@query("""WITH p AS (SELECT conv_id AS doc_id, CAST(turn AS INT) AS page, length(text) AS n FROM conversations),
o AS (SELECT DISTINCT doc_id, [2, 0, 0, 3] AS pages FROM p), e AS (SELECT doc_id, unnest(pages) AS page, CAST(unnest(range(0, 4)) AS INT) AS position FROM o)
SELECT e.doc_id, e.page, position, n FROM e JOIN p ON e.doc_id = p.doc_id AND e.page = p.page""")
def page_reorder(spark, sf_dir):
    p = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page"), F.length("text").alias("n"))
    order = p.select("doc_id").distinct().withColumn("pages", F.array(*map(F.lit, (2, 0, 0, 3))))
    return status.reorder(p, order)


@query("""WITH u AS (SELECT conv_id AS doc_id, turn AS page, role, 0 AS input FROM conversations WHERE role <> 'assistant' UNION ALL SELECT conv_id, turn, role, 1 FROM conversations WHERE role = 'assistant')
SELECT doc_id, page, role, input, row_number() OVER (PARTITION BY doc_id ORDER BY input, page) - 1 AS position FROM u""")
def page_merge(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "role")
    return status.merge_documents([c.filter("role <> 'assistant'"), c.filter("role = 'assistant'")])


@query("""SELECT o_custkey, count(*) AS predicted, count(*) FILTER (o_orderstatus = 'F') AS expected, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 200000) AS matched,
  round(count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 200000) / count(*), 6) AS precision,
  round(CASE WHEN count(*) FILTER (o_orderstatus = 'F') = 0 THEN 0.0 ELSE count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 200000) / count(*) FILTER (o_orderstatus = 'F') END, 6) AS recall FROM orders GROUP BY o_custkey""")
def precision_recall(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    f = F.col("o_orderstatus") == "F"
    g = o.groupBy("o_custkey").agg(F.count("*").alias("predicted"), F.count_if(f).alias("expected"), F.count_if(f & (F.col("o_totalprice") > 200000)).alias("matched"))
    s = status.precision_recall(F.col("matched"), F.col("predicted"), F.col("expected"))
    return g.select("*", F.round(s["precision"], 6).alias("precision"), F.round(s["recall"], 6).alias("recall"))


@query("""SELECT c.c_custkey, c.c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT' AND o.o_orderstatus = 'P')""")
def unmapped_keys(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_name")


@query("""SELECT DISTINCT l.l_suppkey FROM lineitem l WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'P')""")
def changed_dependencies(spark, sf_dir):
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    return l.join(o, l.l_orderkey == o.o_orderkey, "left_semi").select("l_suppkey").distinct()


# Phrases that tell an invoice or a receipt; of each inner list one is enough.
INVOICE_CUES = (("invoice",), ("invoice number", "invoice no", "invoice #"), ("bill to",), ("amount due", "total due"), ("subtotal",))
RECEIPT_CUES = (("receipt",), ("merchant", "store"), ("change due", "tender", "card ****", "thank you"))
RECEIPT_ALL = ("subtotal", "tax", "total")
#: Phrases that are put before the texts of the query.
_LEADS = ("", "Invoice No 7", "invoice and Bill To", "RECEIPT", "Subtotal, tax, total. Thank you", "Receipt of invoice number 3", "bill to: amount due", "store, tender", "subtotal", "merchant", "invoice receipt subtotal tax total thank you store")


def document_kind(text, has_form):
    """invoice, receipt, form or generic, with the scores of the first two."""
    t = F.lower(text)
    any_of = lambda cues: functools.reduce(lambda a, b: a | b, (t.contains(c) for c in cues))
    invoice = sum((any_of(c).cast("int") for c in INVOICE_CUES), F.lit(0))
    receipt = sum((any_of(c).cast("int") for c in RECEIPT_CUES), functools.reduce(lambda a, b: a & b, (t.contains(c) for c in RECEIPT_ALL)).cast("int"))
    named, paid = t.contains("invoice"), t.contains("receipt")
    kind = F.when(named & (invoice >= receipt), "invoice").when(paid | ((receipt >= 2) & ~named), "receipt").when(invoice >= 2, "invoice").when(has_form, "form").otherwise("generic")
    return invoice.alias("invoice"), receipt.alias("receipt"), kind.alias("doc_type")


@query(f"""WITH k AS (SELECT doc_id, lower({list(_LEADS)}[CAST(doc_id % {len(_LEADS)} AS INT) + 1] || ' ' || coalesce(text, '')) AS t, doc_id % 7 = 0 AS f FROM documents),
s AS (SELECT *, CAST(contains(t, 'invoice')::INT + (contains(t, 'invoice number') OR contains(t, 'invoice no') OR contains(t, 'invoice #'))::INT + contains(t, 'bill to')::INT + (contains(t, 'amount due') OR contains(t, 'total due'))::INT + contains(t, 'subtotal')::INT AS INT) AS invoice,
  CAST(contains(t, 'receipt')::INT + (contains(t, 'merchant') OR contains(t, 'store'))::INT + (contains(t, 'subtotal') AND contains(t, 'tax') AND contains(t, 'total'))::INT
    + (contains(t, 'change due') OR contains(t, 'tender') OR contains(t, 'card ****') OR contains(t, 'thank you'))::INT AS INT) AS receipt FROM k)
SELECT doc_id, invoice, receipt, CASE WHEN contains(t, 'invoice') AND invoice >= receipt THEN 'invoice' WHEN contains(t, 'receipt') THEN 'receipt' WHEN receipt >= 2 AND NOT contains(t, 'invoice') THEN 'receipt'
  WHEN invoice >= 2 THEN 'invoice' WHEN f THEN 'form' ELSE 'generic' END AS doc_type FROM s""")
def document_type(spark, sf_dir):
    lead = F.element_at(F.array(*map(F.lit, _LEADS)), (F.col("doc_id") % len(_LEADS) + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(lead, F.lit(" "), F.coalesce("text", F.lit(""))).alias("t"))
    return d.select("doc_id", *document_kind(F.col("t"), F.col("doc_id") % 7 == 0))


_MASKS = (("emails", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"), ("numbers", "[0-9]{7,15}"))


@query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}')) AS {n}" for n, p in _MASKS) + f", md5(regexp_replace(regexp_replace(text, '{_MASKS[0][1]}', '[EMAIL]', 'g'), '{_MASKS[1][1]}', '[NUMBER]', 'g')) AS masked FROM documents")
def redaction(spark, sf_dir):
    """Masked texts, and how much was masked."""
    t = F.col("text")
    counts = [F.regexp_count(t, F.lit(p)).cast("long").alias(n) for n, p in _MASKS]
    masked = F.regexp_replace(F.regexp_replace(t, _MASKS[0][1], "[EMAIL]"), _MASKS[1][1], "[NUMBER]")
    return table(spark, sf_dir, "documents").select("doc_id", *counts, F.md5(masked).alias("masked"))


@query("""WITH terms AS (SELECT lower(n_name) AS term FROM nation UNION SELECT unnest(['the', 'que', 'der', 'von', 'and'])), w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS word FROM documents)
SELECT doc_id, word AS term, count(*) AS hits FROM w JOIN terms ON word = term GROUP BY doc_id, word""")
def residual_terms(spark, sf_dir):
    """Which words of a list are left in which document: one pass over words, joined by word."""
    n = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("term"))
    terms = n.union(spark.createDataFrame([(x,) for x in ("the", "que", "der", "von", "and")], "term string")).distinct()
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([\\p{L}\\p{N}]+)"), F.lit(1))).alias("word"))
    # the list is short: words that are not on it go before the shuffle
    return w.join(terms, F.col("word") == F.col("term")).groupBy("doc_id", "term").agg(F.count("*").alias("hits"))


@query("""SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)', 1)) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, regexp_extract(url, '^https?://([^/]+)', 1) AS host,
  len(regexp_extract_all(html, '<p>')) AS paragraphs, len(regexp_extract_all(html, '<a [^>]*href=')) AS links FROM pages""")
def page_metadata(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.trim(F.regexp_extract(h, "<title>([^<]*)", 1)).alias("title"), F.regexp_extract(h, '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"),
        F.regexp_count(h, F.lit("<p>")).cast("long").alias("paragraphs"), F.regexp_count(h, F.lit("<a [^>]*href=")).cast("long").alias("links"),
    )


@query("""WITH f AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM f)
SELECT user_id, min(ts) AS started, max(ts) AS last_seen, count(*) AS events, round(sum(value), 4) AS value FROM s GROUP BY user_id, sid""")
def idle_sessions(spark, sf_dir):
    return windows.idle_sessions(table(spark, sf_dir, "events"), "30 minutes").withColumn("value", F.round("value", 4))


@query("""WITH RECURSIVE e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, ts, n, ts AS anchor, 1 AS used FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.ts, e.n, CASE WHEN e.ts >= r.anchor + INTERVAL 1 HOUR THEN e.ts ELSE r.anchor END, CASE WHEN e.ts >= r.anchor + INTERVAL 1 HOUR THEN 1 ELSE r.used + 1 END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, anchor, count(*) AS requests, count(*) FILTER (used > 3) AS refused FROM r GROUP BY user_id, anchor""")
def rate_windows(spark, sf_dir):
    return windows.rate_windows(table(spark, sf_dir, "events"), 3600, 3)


@query("SELECT p_partkey, upper(substr(p_type, 1, 3)) AS code, 'files/' || p_name || '.pdf' AS path FROM part")
def attachment_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    raw = F.concat(F.lit("C:\\x\\files/"), "p_name", F.lit(".pdf"))
    return p.select("p_partkey", F.upper(F.substring("p_type", 1, 3)).alias("code"), F.concat(F.lit("files/"), X.safe_filename(raw)).alias("path"))


@query("""SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS place, c_mktsegment FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 5""")
def top_candidates(spark, sf_dir):
    w = W.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.row_number().over(w).alias("place"), "c_mktsegment").filter("place <= 5")
