"""Order-dependent and graph operators against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.functions import values as V
from leafmill.operators import fields, graphs, grids, layout, ordering, pages, segments, status


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_word_error_rates(spark):
    r = random.Random(1)
    some = lambda: " ".join(r.choice("a b c dd é 漢 😀".split()) for _ in range(r.randint(0, 9)))
    pairs = [(some(), some()) for _ in range(60)] + [("", ""), ("a", ""), ("", "a"), ("  x\t y ", "x y"), (" ".join(f"w{i}" for i in range(3000)), " ".join(f"w{i}" for i in range(1, 3001)))]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = {x.i: x.e for x in df.select("i", X.word_error_rate(F.col("a"), F.col("b")).alias("e")).collect()}
    for i, (a, b) in enumerate(pairs[:-1]):
        a, b = a.split(), b.split()
        assert got[i] == pytest.approx(levenshtein(a, b) / len(a) if a else float(bool(b)))
    assert got[len(pairs) - 1] == pytest.approx(2 / 3000)


def test_pairwise_order(spark):
    r = random.Random(2)
    rows, want = [], {}
    for key, n in enumerate((0, 1, 2, 3, 17, 64, 100)):
        b = list(range(n))
        r.shuffle(b)
        rows += [(key, i, x) for i, x in enumerate(b)]
        if n:
            want[key] = sum(b[i] < b[j] for i in range(n) for j in range(i + 1, n)) / (n * (n - 1) / 2) if n > 1 else 1.0
    got = {x.key: x.order_score for x in layout.pairwise_order(spark.createDataFrame(rows, "key long, a long, b long")).collect()}
    assert got == pytest.approx(want)


def test_capped_sets(spark):
    r = random.Random(3)
    rows = [(r.randrange(5), r.randrange(12), i, r.randrange(40)) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, item long, at long, size long")
    got = {(x.k, x.item, x["at"]) for x in status.capped_set(df, "k", "item", F.col("size"), "at", 4, 70).collect()}
    want, sets = set(), {}
    for k, item, at, size in sorted(rows, key=lambda x: x[2]):
        have = sets.setdefault(k, {})
        if item not in have and len(have) < 4 and sum(have.values()) + size <= 70:
            have[item] = size
            want.add((k, item, at))
    assert got == want


def test_job_states(spark):
    r = random.Random(4)
    kinds = ("create", "create", "run", "complete", "fail", "reap")
    rows = [(r.randrange(4), r.randrange(100), i, r.randrange(15), r.choice(kinds)) for i in range(400)]
    got = {x.id: (x.done, x.jobs) for x in pages.job_states(spark.createDataFrame(rows, "key long, ts long, id long, job long, kind string"), 3, 20).collect()}
    stores = {}
    for key, ts, i, job, kind in sorted(rows, key=lambda x: (x[1], x[2])):
        s = stores.setdefault(key, {})
        if kind == "create":
            done = len(s) < 3
            if done:
                s[job] = None
        elif kind == "reap":
            gone = [j for j, end in s.items() if end is not None and ts - end >= 20]
            done = bool(gone)
            for j in gone:
                del s[j]
        else:
            done = job in s
            if done and kind != "run":
                s[job] = ts
        assert got[i] == (done, len(s))


def test_repeated_chunks(spark):
    r = random.Random(5)
    rows = [(1, r.randint(1, 2), i, r.choice("ab"), r.random() * 4, r.random() * 4, 9 + r.random(), r.random() < 0.2) for i in range(200)]
    got = {x.idx for x in pages.without_repeats(spark.createDataFrame(rows, "doc_id long, page int, idx int, text string, x double, y double, size double, invisible boolean")).collect()}
    kept = []
    for c in rows:
        if not any(c[1] == k[1] and c[3] == k[3] and c[7] == k[7] and abs(c[4] - k[4]) <= 0.75 and abs(c[5] - k[5]) <= 0.75 and abs(c[6] - k[6]) <= 0.5 for k in kept):
            kept.append(c)
    assert got == {k[2] for k in kept}


def test_repeated_chunks_over_batches(spark):
    """Groups that go on in the next batch, nulls, and groups of one row; no call of pandas for each group."""
    r = random.Random(6)
    place = lambda: r.choice([None, r.random() * 3, float(r.randrange(4))])
    rows = [(r.choice([None, 1, 2]), r.randint(1, 2), i, r.choice(["a", "b", None, f"once {i}"]), place(), r.random() * 3, 9 + r.random(), r.choice([True, False, None])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, page int, idx int, text string, x double, y double, size double, invisible boolean")
    kept = {}
    for d, p, i, t, x, y, s, v in rows:
        mine = kept.setdefault((d, p, t, v), {})
        if x is None or not any(k[0] is not None and abs(x - k[0]) <= 0.75 and abs(y - k[1]) <= 0.75 and abs(s - k[2]) <= 0.5 for k in mine.values()):
            mine[i] = x, y, s
    want = sorted(i for m in kept.values() for i in m)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in ("1", "7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            assert sorted(x.idx for x in pages.without_repeats(df).collect()) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(want) < 600
    plan = pages.without_repeats(df)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan


def test_graphs(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 6), (None, 1), (4, 4)], "a long, b long")
    assert {(r.node, r.depth) for r in graphs.reachable(e, spark.createDataFrame([(1,)], "node long")).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    c = graphs.cycles(e.withColumn("doc_id", F.lit(1).cast("long"))).collect()
    assert sorted(tuple(r.cycle) for r in c) == [(1, 2, 3), (4,)]
    n = spark.createDataFrame([(1, None, 0), (2, 1, 1), (3, 1, 0), (4, 3, 0), (5, 6, 0), (6, 5, 0)], "id long, parent long, place int")
    assert sorted((r.position, r.id, r.depth) for r in graphs.flattened(n).collect()) == [(0, 1, 0), (1, 3, 1), (2, 4, 2), (3, 2, 1)]
    assert graphs.reachable(e.limit(0), spark.createDataFrame([], "node long")).count() == 0


@pytest.mark.parametrize(
    ("raw", "hint", "kind", "shown"),
    [("1500", "amount", "amount", "1500.00"), ("1500", None, "number", "1500"), ("x", "amount", "text", "x"), ("2024-01-15", "phone", "phone", "20240115"), ("5 %", "number", "number", "5"), ("5551234567", "phone", "phone", "5551234567"), (None, "date", "text", ""), ("(1,000)", None, "number", "-1")],
)
def test_hints(spark, raw, hint, kind, shown):
    v = spark.createDataFrame([(raw,)], "t string").select(V.typed(F.col("t"), hint).alias("v"))
    got = v.select("v.kind", V.rendered(F.col("v")).alias("shown")).first()
    assert (got.kind, got.shown) == (kind, shown)


def test_odd_grids(spark):
    rows = [([],), ([[]],), ([["", ""], ["a"]],), (None,), ([["a", "b"], ["c"]],)]
    g = F.col("g")
    tests = [f(g) for f in (grids.has_shape, grids.is_prose, grids.is_regular, grids.grid_range, grids.item_range, grids.trimmed, grids.kept_columns, grids.merge_unit_price, grids.split_quantity_price, grids.line_items, grids.is_row_header, grids.to_csv, grids.to_markdown)]
    got = spark.createDataFrame(rows, "g array<array<string>>").select(*(t.alias(f"t{i}") for i, t in enumerate(tests))).collect()
    assert len(got) == 5 and got[4].t11 == "a,b\nc,\n" and got[4].t12 == "| a | b |\n| --- | --- |\n| c |  |\n" and got[0].t12 == "```csv\n```\n"


def test_profiles_drop_repeated_fields(spark):
    rows = [(1, 0, "Total Due", "$5"), (1, 1, "Amount due", "$5"), (1, 2, "total", "$7"), (1, 3, "Invoice No.", "A"), (1, 4, "invoise number", "B"), (1, 5, "Colour", "red")]
    df = spark.createDataFrame(rows, "doc_id long, idx long, key string, raw string")
    got = {r.idx: r.canonical for r in fields.apply_profile(df).collect()}
    # 'total' is the best name of the total, and 'invoise number' is nearest to the best name of a number
    assert got[2] == "total" and got[4] == "invoice_number" and got[5] is None
    assert fields.apply_profile(df.limit(0)).count() == 0


def test_large_dictionaries_are_joined(spark):
    r = random.Random(7)
    terms = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(25)})
    texts = ["".join(r.choice("abcd ") for _ in range(r.randint(0, 60))) for _ in range(30)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    small = sorted(map(tuple, ordering.dictionary_matches(df, "k", "t", terms).collect()))
    large = sorted(map(tuple, ordering.dictionary_matches(df, "k", "t", terms, most_bytes=10).collect()))
    assert small == large and small


def test_regions_and_rows(spark):
    r = random.Random(8)
    boxes = [(1, r.randint(1, 3), i, *(lambda x, y: (x, y, x + r.uniform(5, 60), y + r.uniform(5, 15)))(r.uniform(0, 400), r.uniform(0, 600))) for i in range(90)]
    df = spark.createDataFrame(boxes, "doc_id long, page int, idx int, x0 double, y0 double, x1 double, y1 double")

    def cut(rows, depth=0):
        best = None
        for axis, least in ((0, 12.0), (1, 9.0)):
            spans = sorted((b[3 + axis], b[5 + axis]) for b in rows)
            reach, gap = spans[0][1], None
            for lo, hi in spans[1:]:
                if lo - reach >= least and (gap is None or lo - reach > gap[0]):
                    gap = (lo - reach, (lo + reach) / 2, axis)
                reach = max(reach, hi)
            if gap and (best is None or gap[0] > best[0]):
                best = gap
        if best is None or len(rows) == 1 or depth >= 40:
            return [rows]
        _, at, axis = best
        low = [b for b in rows if (b[3 + axis] + b[5 + axis]) / 2 < at]
        high = [b for b in rows if b not in low]
        first, second = (low, high) if axis == 0 else (high, low)
        return cut(first, depth + 1) + cut(second, depth + 1)

    want = {b[2]: k for page in (1, 2, 3) for k, rows in enumerate(cut([b for b in boxes if b[1] == page])) for b in rows}
    assert {x.idx: x.region for x in segments.regions(df, 12.0, 9.0).collect()} == want
    rows = {x.idx: (x.page, x.row) for x in segments.mean_rows(df, 8.0).collect()}
    for page in (1, 2, 3):
        now, k = [], -1
        for b in sorted((b for b in boxes if b[1] == page), key=lambda b: -(b[4] + b[6])):
            c = (b[4] + b[6]) / 2
            if not now or abs(sum(now) / len(now) - c) > 8.0:
                now, k = [], k + 1
            now.append(c)
            assert rows[b[2]] == (page, k)


def test_search_of_odd_texts(spark):
    rows = [(1, 1, "aaaa"), (1, 2, None), (1, 3, "co-\nop  Co op ﬁne \\E."), (1, 4, "")]
    df = spark.createDataFrame(rows, "doc_id long, page int, text string")
    found = lambda q, n=10: [(x.page, x.offset) for x in segments.search(df, q, n).orderBy("page", "offset").collect()]
    assert found("aa") == [(1, 0), (1, 2)] and found("aa", 1) == [(1, 0)]
    assert found("CO op") == [(3, 5)] and found("coop") == [(3, 0)] and found("fi") == [(3, 11)] and found("") == [] and found(".") == [(3, 18)]


def test_bounded_sessions(spark):
    r = random.Random(9)
    rows = [(r.randrange(3), r.randrange(200), i, r.randrange(8)) for i in range(300)]
    got = {x.id: (x.opened, x.refused, x.active) for x in pages.bounded_sessions(spark.createDataFrame(rows, "owner long, ts long, id long, session long"), 2, 10).collect()}
    stores = {}
    for owner, ts, i, session in sorted(rows, key=lambda x: (x[1], x[2])):
        s = stores.setdefault(owner, {})
        new = session not in s
        if new and len(s) == 2:
            for k in [k for k, t in s.items() if ts - t > 10]:
                del s[k]
        full = new and len(s) == 2
        if not full:
            s[session] = ts
        assert got[i] == (new and not full, full, len(s))


def test_fields_are_never_sent_out(spark):
    """Values come with their labels, and no join broadcasts all fragments or fields, whose sizes Spark takes for small."""
    rows = [(1, 1, 0, "Total Due:", 72.0, 700.0, 170.0, 710.0, 1.0), (1, 1, 1, "$5.00", 200.0, 701.0, 260.0, 711.0, 0.5), (1, 2, 0, "Date", 72.0, 660.0, 100.0, 670.0, 1.0), (1, 2, 1, " 2024-01-05", 74.0, 640.0, 140.0, 650.0, 1.0), (None, 1, 0, "Tax:", 72.0, 700.0, 170.0, 710.0, 1.0), (None, 1, 1, None, 200.0, 701.0, 260.0, 711.0, None)]
    f = fields.spatial_fields(spark.createDataFrame(rows, "doc_id long, page int, idx long, text string, x0 double, y0 double, x1 double, y1 double, confidence double"))
    # numbers of fragments that start again on each page, and a document without an id
    assert {(r.doc_id, r.page, r.key, r.raw, r.place) for r in f.collect()} == {(1, 1, "Total Due", "$5.00", "right"), (1, 2, "Date", "2024-01-05", "below"), (None, 1, "Tax", None, "right")}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan(f)
    assert "BroadcastHashJoin" not in plan(fields.apply_profile(f))
