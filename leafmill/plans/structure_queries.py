"""Queries over forms, pages, trees and job stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import Box
from ..operators import fields as D
from ..operators import graphs as R
from ..operators import pages as P
from ..sources.tables import line_blocks, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# a form's fragments: (idx, text, x0, y0, x1, confidence); {k} and {p} are the order's key and price
_FORM = (
    (0, "Invoice Number:", 72, 700, 170, 1.0), (1, "O-{k}", 200, 701, 260, 0.9), (2, "Date", 72, 660, 100, 1.0), (3, "{d}", 74, 640, 140, 0.8), (4, "Total Due:", 300, 640, 360, 1.0), (5, "${p}", 380, 640, 430, 0.5),
    (6, "a long line of prose that is not a label:", 72, 560, 400, 1.0), (7, "Ship to", 300, 600, 350, 1.0), (8, "Hamburg", 230, 600, 290, 1.0), (9, "nothing near", 500, 100, 560, 1.0), (10, "Tax:", 300, 500, 330, 1.0), (11, "none", 340, 500, 370, 1.0),
)


def _forms(spark, sf_dir):
    """Fragments of an invoice for each order; every third has no price, so that another text is nearest."""
    o = table(spark, sf_dir, "orders")
    rows = F.array(*(F.struct(F.lit(i).alias("idx"), F.lit(t).alias("text"), F.lit(float(a)).alias("x0"), F.lit(float(b)).alias("y0"), F.lit(float(c)).alias("x1"), F.lit(b + 10.0).alias("y1"), F.lit(f).alias("confidence")) for i, t, a, b, c, f in _FORM))
    f = o.select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.col("o_custkey").cast("string").alias("p"), F.explode(rows).alias("f")).select("doc_id", "page", "d", "p", "f.*")
    f = f.filter("NOT (doc_id % 3 = 0 AND idx = 5)")
    text = F.replace(F.replace(F.replace("text", F.lit("{k}"), F.col("doc_id").cast("string")), F.lit("{d}"), F.col("d")), F.lit("{p}"), F.concat("p", F.lit(".00")))
    return f.withColumn("text", text).drop("d", "p")


_FIELDS = """f AS (SELECT o_orderkey AS doc_id, 0 AS idx, 'Invoice Number' AS key, 'O-' || o_orderkey AS raw, 'right' AS place, 'text' AS kind, NULL::DOUBLE AS number, 0.9 * 0.9 * 0.9 AS confidence FROM orders
  UNION ALL SELECT o_orderkey, 2, 'Date', strftime(o_orderdate, '%Y-%m-%d'), 'below', 'date', NULL, 0.8 * 0.75 * 0.8 FROM orders
  UNION ALL SELECT o_orderkey, 4, 'Total Due', '$' || o_custkey || '.00', 'right', 'amount', o_custkey, 0.9 * 0.5 FROM orders WHERE o_orderkey % 3 <> 0
  UNION ALL SELECT o_orderkey, 7, 'Ship to', 'Hamburg', 'left', 'text', NULL, 0.8 * 0.9 * 0.9 FROM orders
  UNION ALL SELECT o_orderkey, 10, 'Tax', 'none', 'right', 'text', NULL, 0.9 * 0.6 FROM orders)"""


@query(f"""WITH {_FIELDS} SELECT doc_id, CAST(idx AS BIGINT) AS idx, key, raw, place, kind, number, round(confidence::DOUBLE, 6) AS confidence FROM f""")
def form_fields(spark, sf_dir):
    """Labels with the values that stand right of, left of or below them."""
    s = D.spatial_fields(_forms(spark, sf_dir))
    return s.select("doc_id", "idx", "key", "raw", "place", F.col("typed.kind").alias("kind"), F.col("typed.number").alias("number"), F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {_FIELDS} SELECT doc_id, CAST(idx AS BIGINT) AS idx, raw, CASE idx WHEN 0 THEN 'invoice_number' WHEN 2 THEN 'invoice_date' WHEN 4 THEN 'total' WHEN 10 THEN 'tax' END AS canonical FROM f""")
def profile_fields(spark, sf_dir):
    """The same fields under the canonical names of invoices; others are left over."""
    return D.apply_profile(D.spatial_fields(_forms(spark, sf_dir))).select("doc_id", "idx", "raw", "canonical")


_LABELS = (("Total:", True, "amount"), ("total", True, "amount"), ("Invoice #", True, "any"), ("one two three four five six seven:", False, "any"), ("Due", True, "date"), ("E-Mail:", True, "any"), ("email", True, "email"), ("Fax no:", True, "phone"), ("Qty", True, "number"), ("quantity of tax:", True, "amount"), (":", False, "any"), ("", False, "any"), ("prose", False, "any"))


@query("WITH l(k, label, hint) AS (VALUES " + ", ".join(f"({i}, {str(a).lower()}, '{h}')" for i, (_, a, h) in enumerate(_LABELS)) + f") SELECT p_partkey, label, hint FROM part JOIN l ON p_partkey % {len(_LABELS)} = k")
def label_tests(spark, sf_dir):
    t = F.element_at(F.array(*(F.lit(x) for x, _, _ in _LABELS)), (F.col("p_partkey") % len(_LABELS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", D.is_label(t).alias("label"), D.hint(D.strip_label(t)).alias("hint"))


@query("""WITH g AS (SELECT o_custkey AS doc_id, lower(o_orderpriority) AS k, CAST(o_orderkey AS VARCHAR) AS v FROM orders), p AS (SELECT doc_id, k, CASE CAST(v AS BIGINT) % 4 WHEN 0 THEN v WHEN 1 THEN 'no. ' || v WHEN 2 THEN 'x' ELSE substr(v, 1, 2) END AS v FROM g WHERE CAST(v AS BIGINT) % 5 > 0),
h AS (SELECT doc_id, count(*) FILTER (EXISTS (SELECT 1 FROM p WHERE p.doc_id = g.doc_id AND p.k = g.k AND (contains(p.v, g.v) OR contains(g.v, p.v)))) AS matched, count(*) AS expected FROM g GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS predicted FROM p GROUP BY doc_id) SELECT doc_id, matched, coalesce(predicted, 0) AS predicted, expected FROM h LEFT JOIN n USING (doc_id)""")
def field_scores(spark, sf_dir):
    g = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("key"), F.col("o_orderkey").cast("string").alias("value"), "o_orderkey")
    k = F.col("o_orderkey") % 4
    value = F.when(k == 0, F.col("value")).when(k == 1, F.concat(F.lit("No.  "), "value")).when(k == 2, "x").otherwise(F.substring("value", 1, 2))
    p = g.filter("o_orderkey % 5 > 0").select("doc_id", F.concat(F.lit(" "), F.upper("key")).alias("key"), value.alias("value"))
    return D.field_scores(g.drop("o_orderkey"), p)


@query("""SELECT o_custkey AS doc_id, round(avg(CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 7 = 0 THEN 0.0 ELSE 1.0 END), 6) AS accuracy FROM orders GROUP BY o_custkey""")
def type_accuracy(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("idx"), F.col("o_orderpriority").alias("kind"))
    b = a.filter("idx % 7 > 0").withColumn("kind", F.when(F.col("idx") % 3 == 0, "other").otherwise(F.lower("kind")))
    return D.type_accuracy(a, b).withColumn("accuracy", F.round("accuracy", 6))


_RANGES = (
    ("all", "1,2,3,4,5,6,7,8,9,10", None), ("", "1,2,3,4,5,6,7,8,9,10", None), ("2-5", "2,3,4,5", None), ("7, 1,3 ,1-3", "1,2,3,7", None), ("0", None, "page numbers are 1-indexed; 0 is invalid"), ("5-2", None, "range 5-2 is backwards"),
    ("9-11", None, "page 11 exceeds document length (10)"), ("12", None, "page 12 exceeds document length (10)"), ("x", None, "invalid page number ''x''"), ("1-b", None, "invalid page number ''b''"), (",", None, "no valid page numbers found in range string"), ("3,0-1,x", None, "page numbers are 1-indexed; 0 is invalid"), ("-4", None, "invalid page number ''''"),
)
_QUOTED = lambda x: "NULL" if x is None else f"'{x}'"


@query("WITH r(k, pages, error) AS (VALUES " + ", ".join(f"({i}, {_QUOTED(p)}, {_QUOTED(e)})" for i, (_, p, e) in enumerate(_RANGES)) + f") SELECT c_custkey, pages, error FROM customer JOIN r ON c_custkey % {len(_RANGES)} = k")
def page_ranges(spark, sf_dir):
    t = F.element_at(F.array(*(F.lit(x) for x, _, _ in _RANGES)), (F.col("c_custkey") % len(_RANGES) + 1).cast("int"))
    r = table(spark, sf_dir, "customer").select("c_custkey", P.page_range(t, F.lit(10).cast("long")).alias("r"))
    return r.select("c_custkey", F.when(F.col("r.error").isNull(), F.array_join(F.transform("r.pages", lambda n: n.cast("string")), ",")).alias("pages"), F.col("r.error").alias("error"))


@query("""WITH p AS (SELECT conv_id AS doc_id, turn AS page, CAST(90 * (turn % 4) AS INT) AS rotation FROM conversations) SELECT doc_id, page, CASE WHEN page % 2 = 1 THEN (rotation + 270) % 360 ELSE rotation END AS rotation FROM p""")
def page_rotation(spark, sf_dir):
    p = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), (90 * (F.col("turn") % 4)).cast("int").alias("rotation"))
    return P.rotated(p, p.filter("page % 2 = 1"), -90)


@query("""WITH u AS (SELECT conv_id AS doc_id, turn AS page, 'base' AS source, CASE WHEN turn < 2 THEN 0 ELSE 2 END AS part FROM conversations UNION ALL SELECT conv_id, turn + 100, 'other', 1 FROM conversations WHERE turn % 2 = 0)
SELECT doc_id, page, source, row_number() OVER (PARTITION BY doc_id ORDER BY part, page) AS position FROM u""")
def page_insertion(spark, sf_dir):
    p = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"))
    return P.inserted(p, p.filter("page % 2 = 0").withColumn("page", F.col("page") + 100), 2)


@query("""WITH p AS (SELECT conv_id AS doc_id, turn AS page, 400.0::DOUBLE + 100 * (turn % 3) AS w, 800.0::DOUBLE AS h, row_number() OVER o - 1 AS i, first(400.0::DOUBLE + 100 * (turn % 3)) OVER o AS fw FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT *, i % 6 AS k, fw / 2 AS cw, 800.0 / 3 AS ch, least(fw / 2 / w, 800.0 / 3 / h) AS s FROM p)
SELECT doc_id, page, i // 6 AS sheet, round((k % 2) * cw + (cw - w * s) / 2, 4) AS x, round(800 - (k // 2 + 1) * ch + (ch - h * s) / 2, 4) AS y, round(w * s, 4) AS width, round(h * s, 4) AS height FROM s""")
def page_sheets(spark, sf_dir):
    p = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), (400.0 + 100 * (F.col("turn") % 3)).alias("width"), F.lit(800.0).alias("height"))
    s = P.sheets(p, 2, 3)
    return s.select("doc_id", "page", "sheet", *(F.round(c, 4).alias(c) for c in ("x", "y", "width", "height")))


@query("""WITH b AS (SELECT p_partkey, p_partkey % 700 - 50.0::DOUBLE AS x0, p_size * 10.0::DOUBLE AS y0, p_partkey % 700 + 50.0::DOUBLE AS x1, p_size * 10 + 300.0::DOUBLE AS y1 FROM part)
SELECT p_partkey, CASE WHEN x0 < 612 AND y0 < 400 THEN greatest(x0, 0) END AS x0, CASE WHEN x0 < 612 AND y0 < 400 THEN least(y1, 400) END AS y1, CASE WHEN p_partkey % 13 <= 12 THEN CASE WHEN p_partkey % 13 <= 2 THEN 0 WHEN p_partkey % 13 <= 5 THEN 1 WHEN p_partkey % 13 <= 10 THEN 2 END END AS band,
  p_partkey % 3 = 0 AS subset FROM b""")
def clamped_regions(spark, sf_dir):
    """Regions on their page, the band of a number, and names of embedded subsets."""
    c = F.col
    region = Box(c("p_partkey") % 700 - 50.0, c("p_size") * 10.0, c("p_partkey") % 700 + 50.0, c("p_size") * 10 + 300.0)
    page = Box(*(F.lit(float(v)) for v in (0, 0, 612, 400)))
    name = F.when(c("p_partkey") % 3 == 0, "ABCDEF+Serif").when(c("p_partkey") % 3 == 1, "ABCDE+Serif").otherwise("AbCDEF+Serif")
    bounds = F.array(*(F.lit(float(v)) for v in (0, 2, 5, 10)))
    p = table(spark, sf_dir, "part").select("p_partkey", P.clamped(region, page).alias("r"), P.band_index(bounds, (c("p_partkey") % 13).cast("double")).cast("int").alias("band"), P.is_subset_font(name).alias("subset"))
    return p.select("p_partkey", "r.x0", "r.y1", "band", "subset")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, (o_custkey * 7 + o_orderkey) % (SELECT max(c_custkey) FROM customer) AS b FROM orders WHERE o_orderpriority = '1-URGENT'),
r AS (SELECT DISTINCT c_custkey AS node FROM customer WHERE c_custkey % 50 = 0 UNION SELECT e.b FROM r JOIN e ON r.node = e.a) SELECT DISTINCT node FROM r""")
def reachable_objects(spark, sf_dir):
    """Everything that some objects lead to over their references."""
    c = table(spark, sf_dir, "customer")
    most = c.agg(F.max("c_custkey")).first()[0]
    e = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("a"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % most).alias("b"))
    return R.reachable(e, c.filter("c_custkey % 50 = 0").select(F.col("c_custkey").alias("node"))).select("node")


@query("""WITH RECURSIVE n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 100 >= 4 THEN c_custkey - c_custkey % 100 + (c_custkey % 100) // 4 END AS parent, c_custkey % 4 AS place FROM customer),
r AS (SELECT id, id AS root, 0 AS depth, [place] AS path FROM n WHERE parent IS NULL UNION ALL SELECT n.id, r.root, r.depth + 1, list_append(r.path, n.place) FROM r JOIN n ON n.parent = r.id)
SELECT id, root, depth, row_number() OVER (PARTITION BY root ORDER BY path) - 1 AS position FROM r""")
def flattened_trees(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey") % 100
    n = c.select(F.col("c_custkey").alias("id"), F.when(k >= 4, F.col("c_custkey") - k + F.floor(k / 4)).alias("parent"), (F.col("c_custkey") % 4).alias("place"))
    return R.flattened(n).select("id", "root", "depth", "position")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey % 97 AS doc_id, o_orderkey % 6 AS a, (o_orderkey // 6) % 6 AS b FROM orders),
p AS (SELECT doc_id, [a] AS path, b FROM e WHERE b >= a UNION ALL SELECT p.doc_id, list_append(p.path, p.b), e.b FROM p JOIN e ON e.doc_id = p.doc_id AND e.a = p.b WHERE p.b <> p.path[1] AND NOT list_contains(p.path, p.b) AND e.b >= p.path[1])
SELECT DISTINCT doc_id, array_to_string(path, ',') AS cycle FROM p WHERE b = path[1]""")
def field_cycles(spark, sf_dir):
    """Cycles among the fields that compute each other, each from its least field on."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 97).alias("doc_id"), (F.col("o_orderkey") % 6).alias("a"), (F.expr("o_orderkey div 6") % 6).alias("b"))
    return R.cycles(o).select("doc_id", F.array_join("cycle", ",").alias("cycle"))


@query()
def repeated_chunks(spark, sf_dir):
    """Chunks that stand under another one; compared with brute force in the tests."""
    b = line_blocks(table(spark, sf_dir, "documents")).select("doc_id", "page", "idx", "text", F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("font_size").alias("size"), (F.col("idx") % 7 == 0).alias("invisible"))
    moved = b.withColumn("idx", F.col("idx") + 1_000_000).withColumn("x", F.col("x") + 0.25 * (F.col("idx") % 7))
    return P.without_repeats(b.unionByName(moved))


@query()
def job_states(spark, sf_dir):
    """Bounded job stores; compared with brute force in the tests."""
    c = F.col
    kind = F.element_at(F.array(*map(F.lit, ("create", "create", "run", "complete", "fail", "reap"))), (c("event_id") % 6 + 1).cast("int"))
    e = table(spark, sf_dir, "events").select(c("user_id").alias("key"), F.unix_seconds(c("ts").cast("timestamp")).alias("ts"), c("event_id").alias("id"), F.when(c("event_id") % 6 < 2, c("event_id")).otherwise(F.expr("event_id div 12")).alias("job"), kind.alias("kind"))
    return P.job_states(e, 3, 3600)


@query()
def bounded_sessions(spark, sf_dir):
    """Three sessions an owner at most; compared with brute force in the tests."""
    c = F.col
    e = table(spark, sf_dir, "events").select((c("user_id") % 20).alias("owner"), F.unix_seconds(c("ts").cast("timestamp")).alias("ts"), c("event_id").alias("id"), c("user_id").alias("session"))
    return P.bounded_sessions(e, 3, 3600)


@query(f"""WITH {_FIELDS} SELECT doc_id, '[' || string_agg('{{"key":"' || key || '","raw":"' || raw || '","type":"' || kind || '"}}', ',' ORDER BY idx) || ']' AS fields FROM f GROUP BY doc_id""")
def field_json(spark, sf_dir):
    """The fields of each form as JSON, in order; a form has few."""
    f = D.spatial_fields(_forms(spark, sf_dir)).select("doc_id", F.struct("idx", "key", "raw", F.col("typed.kind").alias("type")).alias("f"))
    ordered = F.transform(F.array_sort(F.collect_list("f")), lambda x: F.struct(x["key"].alias("key"), x["raw"].alias("raw"), x["type"].alias("type")))
    return f.groupBy("doc_id").agg(F.to_json(ordered).alias("fields"))


_LINES = (
    ("Account: AC-1 x Period: 2026-01 to 2026-02 and on", "account=AC-1;period=2026-01 to 2026-02"), ("Total Due: USD 5.00 thanks", "total due=USD 5.00"), ("Invoice Date: 2024-01-05 - Due Date: 2024-02-05 | PO #: 77", "invoice date=2024-01-05;due date=2024-02-05;po #=77"),
    ("Payment terms: 30 days", ""), ("Total : $9", "Total=$9"), ("Note: nothing", ""), ("subtotal:", ""), ("Reference: ref-9 more", "reference=ref-9"), ("Reference: nine more", "reference=nine more"), ("my total: 7 8", "total=7"), ("mytotal: 7 8", ""), ("Name: Bob Page 7 of 9", "name=Bob"), ("", ""),
)


@query("WITH t(k, pairs) AS (VALUES " + ", ".join(f"({i}, '{p}')" for i, (_, p) in enumerate(_LINES)) + f") SELECT p_partkey, pairs FROM part JOIN t ON p_partkey % {len(_LINES)} = k")
def inline_fields(spark, sf_dir):
    """Labels and values inside of one line."""
    t = F.element_at(F.array(*(F.lit(x) for x, _ in _LINES)), (F.col("p_partkey") % len(_LINES) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(D.inline_pairs(t), lambda p: F.concat(p["label"], F.lit("="), p["value"])), ";").alias("pairs"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Name=' || p_name END AS in_row, CASE p_partkey % 4 WHEN 0 THEN 'Date=2024-01-05;Total=$' || p_partkey WHEN 3 THEN 'Date=2024-01-05;Total=x;Class=y' ELSE '' END AS below FROM part""")
def cell_fields(spark, sf_dir):
    """Labels and values in cells of tables: side by side, and below each other."""
    k, s = F.col("p_partkey") % 4, F.col("p_partkey").cast("string")
    lit = lambda *x: F.array(*(F.lit(y) if isinstance(y, str) else y for y in x))
    row = F.when(k == 0, lit("", "Name:", "", F.col("p_name"))).when(k == 1, lit("Name:", "Total:")).when(k == 2, lit("no label", "x")).otherwise(lit("Name:", "a", "b"))
    heads = F.when(k == 0, lit("Date", "", "Total:")).when(k == 1, lit("Date", "other")).when(k == 2, lit("Date", "Total")).otherwise(lit("Date", "Total", "Class"))
    under = F.when(k == 0, lit("2024-01-05 |", "x", F.concat(F.lit("$"), s))).when(k == 1, lit("a", "b")).when(k == 2, lit("a")).otherwise(lit("2024-01-05", "x", "y"))
    shown = lambda p: F.concat(p["label"], F.lit("="), p["value"])
    return table(spark, sf_dir, "part").select("p_partkey", shown(D.row_pair(row)).alias("in_row"), F.array_join(F.transform(D.below_pairs(heads, under), shown), ";").alias("below"))
