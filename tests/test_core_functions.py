import hashlib
from datetime import datetime, timedelta

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.functions import values as V
from leafmill.functions.hashes import content_chunks, fnv1a
from leafmill.operators import chunking, joins
from leafmill.streaming import windows


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "iso"),
    [
        ("2024-01-15", "2024-01-15"), ("2024/01/15", "2024-01-15"), ("01/15/2024", "2024-01-15"), ("15/01/2024", "2024-01-15"), ("15.01.2024", "2024-01-15"), ("Jan 15, 2024", "2024-01-15"),
        ("15 January 2024", "2024-01-15"), ("January 5, 2024", "2024-01-05"), ("hello", None), ("13/13/2024", None), (None, None), ("", None),
    ],
)
def test_dates(spark, raw, iso):
    assert one(spark, raw, V.date_iso) == iso


@pytest.mark.parametrize(
    ("raw", "value", "currency"),
    [("$42.00", 42.0, "USD"), ("$1,234.50", 1234.5, "USD"), ("€1.234,50", 1234.5, "EUR"), ("USD 99.99", 99.99, "USD"), ("1500", 1500.0, None), ("-$5.00", -5.0, "USD"), ("($5.00)", -5.0, "USD"), ("x", None, None)],
)
def test_amounts(spark, raw, value, currency):
    assert one(spark, raw, V.amount) == value
    assert one(spark, raw, V.amount_currency) == currency


def test_text_scalars(spark):
    assert one(spark, "mcmxciv", X.roman_value) == 1994
    assert one(spark, "hello", X.roman_value) is None
    assert one(spark, "a\\b/..", X.safe_filename) == "attachment.bin"
    assert one(spark, "exam- ple", X.join_hyphenated) == "example"
    assert one(spark, "ﬁne", X.expand_ligatures) == "fine"
    assert one(spark, "漢字 ab", X.estimate_tokens) == 3
    assert one(spark, None, X.estimate_tokens) == 0
    assert one(spark, "D:20240115103000+02'00'", V.pdf_date) == "2024-01-15 10:30:00 +02:00"
    assert spark.range(1).select(X.heading_context(F.array(F.lit("A"), F.lit("B"))).alias("x")).first().x == "# A > ## B"
    assert spark.range(1).select(X.char_error_rate(F.lit("abc"), F.lit("abX")).alias("x")).first().x == pytest.approx(1 / 3)


def test_fnv1a():
    assert fnv1a(b"") == 0xCBF29CE484222325
    assert fnv1a(b"a") == 0xAF63DC4C8601EC8C


def test_content_chunks_cover_the_input(spark):
    data = "alpha beta gamma " * 128
    rows = sorted(content_chunks(spark.createDataFrame([(1, data), (2, ""), (3, None)], "k long, t string"), "k", "t").collect(), key=lambda r: r.offset)
    assert {r.k for r in rows} == {1}
    assert rows[0].offset == 0
    assert sum(r.length for r in rows) == len(data)
    assert all(r.sha256 == hashlib.sha256(data[r.offset : r.offset + r.length].encode()).hexdigest() for r in rows)


@given(st.lists(st.text(alphabet="ab .!|,\nXy", max_size=60), max_size=12), st.integers(4, 30), st.integers(0, 6))
def test_chunks_hold_all_lines(lines, target, overlap):
    text = "\n".join(lines)
    got = chunking.chunks(text, chunking.Options(target=target, overlap=overlap))
    assert all(c["tokens"] == sum(chunking.tokens(p) for p in c["text"].split("\n")) or "\n" in text for c in got)
    assert all(c["oversized"] == (c["tokens"] > target) for c in got)
    words = set(text.split())
    assert {w for c in got for w in c["text"].split()} == words
    lasts = [c["last_line"] for c in got]
    assert lasts == sorted(lasts)


def test_tokens_agree_with_the_native_form(spark):
    for t in ("", "hello world", "a-b, c.", "漢字 kana ひら", "naïve 123 x\ty"):
        assert chunking.tokens(t) == one(spark, t, X.estimate_tokens)


def test_suppression_is_greedy(spark):
    rows = [(1, 1, 1, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 1, 2, 0.8, 1.0, 0.0, 11.0, 10.0), (1, 1, 3, 0.7, 2.0, 0.0, 12.0, 10.0), (1, 2, 4, 0.1, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, page int, id long, confidence double, x0 double, y0 double, x1 double, y1 double")
    got = {r.id: r.accepted for r in joins.suppress(df, 0.7).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True}


def test_captions_are_claimed_once(spark):
    figures = spark.createDataFrame([(1, 1, 1, 0.0, 100.0, 100.0, 200.0), (1, 1, 2, 0.0, 100.0, 100.0, 190.0)], "doc_id long, page int, id long, x0 double, y0 double, x1 double, y1 double")
    texts = spark.createDataFrame([(1, 1, 7, 0.0, 80.0, 90.0, 90.0, "Figure 1 x")], "doc_id long, page int, id long, x0 double, y0 double, x1 double, y1 double, text string")
    got = joins.claim_captions(figures, texts, 12.5).collect()
    assert [(r.figure, r.caption, r.score) for r in got] == [(1, 7, 2.5)]


def test_rate_limit_stream_equals_the_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    events = [(u, start + timedelta(seconds=s)) for u, ss in ((1, (0, 10, 59, 60, 61, 200)), (2, (5, 6, 7, 8))) for s in ss]
    schema = "user_id long, ts timestamp"
    spark.createDataFrame(events, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 hour")
    q = windows.rate_limit_stream(stream, 60, 2).writeStream.format("memory").queryName("rates").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.user_id, r.anchor): (r.n, r.x) for r in spark.sql("SELECT user_id, anchor, sum(requests) n, sum(refused) x FROM rates GROUP BY ALL").collect()}
    want = {(r.user_id, r.anchor): (r.requests, r.refused) for r in windows.rate_windows(spark.createDataFrame(events, schema), 60, 2).collect()}
    assert got == want
