from pyspark.sql import functions as F

from leafmill.operators import ordering as O


def test_anchored_lines_compare_with_the_first_chunk(spark):
    rows = [(1, 1, 0, 0.0, 90.0, 100.0), (1, 1, 1, 50.0, 85.0, 95.0), (1, 1, 2, 90.0, 80.0, 90.0), (1, 2, 3, 0.0, 0.0, 10.0)]
    df = spark.createDataFrame(rows, "doc_id long, page int, idx int, x0 double, y0 double, y1 double")
    assert {r.idx: r.line for r in O.anchored_lines(df).collect()} == {0: 0, 1: 0, 2: 1, 3: 0}


def test_clusters_move_half_way(spark):
    df = spark.createDataFrame([([10.0, 1.0, 2.0, 3.4, 11.0],), ([],)], "v array<double>")
    got = [r.c for r in df.select(O.clustered(F.col("v"), 2.0).alias("c")).collect()]
    assert got == [[2.45, 10.5], []]
    one = df.limit(1).select(O.column_bounds(O.clustered(F.col("v"), 2.0), F.lit(0.0), F.lit(20.0)).alias("b")).first().b
    assert one == [0.0, 6.475, 20.0]


def test_precedence_order():
    assert O.precedence_order([(2,), (1,), (0,)], [(0, 2)]) == [1, 0, 2]
    assert O.precedence_order([(2,), (1,), (0,)], [(0, 1), (1, 0)]) == [2, 1, 0]


def test_reading_order_goes_down_columns(spark):
    boxes = [(0, 0.0, 90.0, 40.0, 100.0), (1, 60.0, 90.0, 100.0, 100.0), (2, 0.0, 70.0, 40.0, 80.0), (3, 0.0, 40.0, 100.0, 50.0)]
    df = spark.createDataFrame([(1, 1, *b) for b in boxes], "doc_id long, page int, idx int, x0 double, y0 double, x1 double, y1 double")
    got = {r.idx: r.reading for r in O.reading_order(df).collect()}
    assert sorted(got, key=got.get) == [0, 1, 2, 3]


def test_dictionary_takes_the_longest_match(spark):
    df = spark.createDataFrame([(1, "xabcd ab"), (2, None)], "k long, t string")
    got = [(r.k, r.offset, r.term) for r in O.dictionary_matches(df, "k", "t", ["ab", "abc", "d"]).collect()]
    assert got == [(1, 1, "abc"), (1, 4, "d"), (1, 6, "ab")]
