"""Quality rules: a threshold table compiled into one projection.

All measures are Catalyst expressions over the whole text; nothing is exploded,
shuffled or handed to Python.  Windows of eight words are compared by their
64-bit hashes after one sort per document that has repeats at all, so a very long
text costs n log n.

Defined results: null and empty text have no words and fail the base rule; rows are
judged one by one, so ties, repeated rows and further columns do not matter; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import SPACE_RUN, table

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Frequent words of the four languages, lower case.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on not he this are or his from at which "
    "le la les de des du et un une en que qui dans pour par sur au est pas avec "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als "
    "el los las y del se no una por con para su al lo como"
).split()

#: name, measure, least, most (per hundred, compared in whole numbers); None: no bound.
#: A document is kept if every measure lies inside its bounds.
RULES = (
    ("words", "n_words", 20, None),
    ("mean_word_length", "100 * word_chars div n_words", 200, 2000),
    ("symbols_per_100_words", "100 * n_symbols div n_words", None, 20),
    ("stop_words_per_100_words", "100 * n_stop_words div n_words", 2, None),
    ("duplicate_lines_per_100_lines", "100 * n_dup_lines div greatest(n_lines, 1)", None, 50),
    ("echoed_words_per_100_words", "100 * n_echo_words div n_words", None, 30),
)


def measures(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop_words and
    n_repeat_words; helper columns carry a prefix and are dropped."""
    blank = " \t\n\x0b\f\r"
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("_qr_text", F.trim(F.regexp_replace(text, SPACE_RUN, " ")))
    d = d.withColumn("_qr_words", F.when(F.col("_qr_text") == "", F.array().cast("array<string>")).otherwise(F.split("_qr_text", " ")))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(blank)) != "")
    d = d.withColumn("_qr_lines", lines)
    n = F.size("_qr_words")
    hashes = F.when(n >= WINDOW, F.expr(f"transform(sequence(1, size(_qr_words) - {WINDOW - 1}), i -> xxhash64(slice(_qr_words, i, {WINDOW})))"))
    d = d.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.replace(F.col("_qr_text"), F.lit(" "), F.lit(""))).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_lines": F.size("_qr_lines").cast("long"),
            "n_dup_lines": (F.size("_qr_lines") - F.size(F.array_distinct("_qr_lines"))).cast("long"),
            "n_stop_words": F.size(F.filter("_qr_words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
            "n_echo_words": F.expr("size(filter(_qr_words, (w, i) -> w <=> get(_qr_words, i + 1)))").cast("long"),
            "_qr_hashes": F.coalesce(hashes, F.array().cast("array<bigint>")),
        }
    )
    repeats = F.size(F.array_distinct("_qr_hashes")) < F.size("_qr_hashes")
    d = d.withColumn("_qr_order", F.when(repeats, F.expr("array_sort(transform(_qr_hashes, (h, i) -> struct(h, i)))")))
    at = "sort_array(transform(filter(_qr_order, (x, j) -> x.h <=> get(_qr_order, j - 1).h OR x.h <=> get(_qr_order, j + 1).h), x -> x.i))"
    d = d.withColumn("_qr_at", F.when(F.col("_qr_order").isNotNull(), F.expr(at)))
    covered = f"aggregate(transform(_qr_at, (p, j) -> least({WINDOW}, coalesce(get(_qr_at, j + 1) - p, {WINDOW}))), 0, (a, x) -> a + x)"
    d = d.withColumn("n_repeat_words", F.when(F.col("_qr_at").isNull(), F.lit(0)).otherwise(F.expr(covered)).cast("long"))
    # a row number keeps Catalyst from pushing filters below the projections, where each use of
    # a measure would compute it again
    d = d.withColumn("n_words", F.when(F.monotonically_increasing_id() >= 0, F.col("n_words")))
    return d.drop("_qr_text", "_qr_words", "_qr_lines", "_qr_hashes", "_qr_order", "_qr_at")


def base_failed() -> Column:
    return F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")


def verdict(rules=RULES) -> Column:
    """The threshold table as one boolean expression."""
    parts = []
    for _, measure, least, most in rules:
        m = f"CASE WHEN n_words > 0 THEN {measure} ELSE 0 END"
        if least is not None:
            parts.append(f"({m}) >= {least}")
        if most is not None:
            parts.append(f"({m}) <= {most}")
    return F.expr(" AND ".join(parts))


def broken_rules(rules=RULES) -> Column:
    """Names of the rules that a document breaks."""
    out = []
    for name, measure, least, most in rules:
        out.append(F.when(~verdict([(name, measure, least, most)]), F.lit(name)))
    return F.array_compact(F.array(*out))


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """docs with its measures, base_failed, broken_rules and kept."""
    d = measures(docs).withColumn("base_failed", base_failed())
    return d.withColumn("broken_rules", broken_rules(rules)).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_good(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of docs that no rule rejects, with their own columns only."""
    plain = docs.columns
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in plain]).alias("_qr_row"), F.col("text"))
    return judge(wide, rules).filter("kept").select("_qr_row.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def sql(columns: str, source: str = "documents") -> str:
    """DuckDB SQL of the same measures and verdict; `columns` picks from m.*."""
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    bounds = []
    for _, measure, least, most in RULES:
        m = f"(CASE WHEN n_words > 0 THEN {measure.replace(' div ', ' // ')} ELSE 0 END)"
        bounds += [f"{m} >= {least}"] * (least is not None) + [f"{m} <= {most}"] * (most is not None)
    return rf"""
WITH d AS (SELECT *, row_number() OVER () AS rid FROM {source}),
w AS (
  SELECT rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i+7], ' ') AS s FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, range(0, 8) t(k) GROUP BY rid),
m AS (
  SELECT d.*, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(len(list_filter(ws, lambda x: lower(x) IN ({stops}))) AS BIGINT) AS n_stop_words,
    CAST(len(list_filter(ws, lambda x, i: x = ws[i + 1])) AS BIGINT) AS n_echo_words, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w USING (rid) LEFT JOIN cov USING (rid)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {' AND '.join(bounds)} AS good FROM m)
SELECT {columns} FROM v"""


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLE = {"op7_quality_rules": sql("doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND good AS kept")}
