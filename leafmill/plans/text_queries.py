"""Queries over whole texts: token estimates, normal forms, sentences, fingerprints."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import hashes, text as X
from ..sources.tables import BLOCKS_SQL, line_blocks, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


_TOKENS = r"(coalesce(list_sum(list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+'), lambda x: greatest(1, (length(x) + 2) // 4))), 0) + length(regexp_replace(coalesce(text, ''), '[\s\p{L}\p{N}]', '', 'g')))"


@query(f"SELECT doc_id, CAST({_TOKENS} AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))


@query(f"SELECT lang, count(*) AS docs, CAST(sum({_TOKENS}) AS BIGINT) AS tokens, CAST(max({_TOKENS}) AS BIGINT) AS most FROM documents GROUP BY lang")
def lang_token_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", X.estimate_tokens(F.col("text")).alias("t"))
    return d.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("t").alias("tokens"), F.max("t").alias("most"))


@query("SELECT min(doc_id) AS canonical, count(*) AS copies FROM documents GROUP BY sha256(text)")
def exact_dedup_groups(spark, sf_dir):
    return hashes.dedup_groups(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


@query("""SELECT count(*) AS inputs, count(DISTINCT sha256(text)) AS unique_texts, count(*) - count(DISTINCT sha256(text)) AS duplicates,
  CAST(sum(strlen(text)) AS BIGINT) AS total_bytes FROM documents""")
def exact_dedup_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("h"), F.octet_length("text").cast("long").alias("b"))
    # per text first, so that no distinct count has to move whole digests twice
    g = d.groupBy("h").agg(F.count("*").alias("c"), F.sum("b").alias("b"))
    return g.agg(F.sum("c").alias("inputs"), F.count("*").alias("unique_texts"), F.sum(F.col("c") - 1).alias("duplicates"), F.sum("b").alias("total_bytes"))


_SENT = r"list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])(\s)', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: s <> '')"


@query(f"SELECT doc_id, CAST(len({_SENT}) AS INT) AS n_sentences, CAST(coalesce(list_max(list_transform({_SENT}, lambda s: length(s))), 0) AS INT) AS longest, md5(array_to_string({_SENT}, chr(10))) AS digest FROM documents")
def sentence_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", X.sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").alias("n_sentences"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).alias("longest"), F.md5(F.array_join("s", "\n")).alias("digest"))


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(rf"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace({_LOW}, '[0-9]', '', 'g'), '\s+', ' ', 'g'))) AS running,
  md5(lower(trim(regexp_replace(replace(text, '-' || chr(10), ''), '\s+', ' ', 'g')))) AS search,
  md5(trim(regexp_replace({_LOW}, '[^a-z0-9]+', ' ', 'g'))) AS alnum,
  md5(trim(regexp_replace(regexp_replace(lower(text), '[0-9]', '#', 'g'), '[^\p{{L}}\p{{N}}#]+', ' ', 'g'))) AS shape FROM documents""")
def normal_forms(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", *(F.md5(f(t)).alias(n) for n, f in (("running", X.running_key), ("search", X.search_key), ("alnum", X.alnum_key), ("shape", X.digit_shape))))


@query(rf"""SELECT doc_id, md5(replace(regexp_replace(text, '([\\`*_\[\]<>|])', '\\\1', 'g'), chr(10), ' ')) AS markdown,
  md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS html,
  md5(CASE WHEN regexp_matches(text, '[",\n\r]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END) AS csv FROM documents""")
def escaped_forms(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.escape_markdown(t)).alias("markdown"), F.md5(X.escape_html(t)).alias("html"), F.md5(X.csv_quote(t)).alias("csv"))


@query("""SELECT doc_id,
  CASE WHEN length(regexp_replace(text, '[^\\p{L}]', '', 'g')) = 0 THEN 0.0 ELSE length(regexp_replace(text, '[^\\x{0590}-\\x{08FF}\\x{FB1D}-\\x{FDFF}\\x{FE70}-\\x{FEFF}]', '', 'g')) / length(regexp_replace(text, '[^\\p{L}]', '', 'g')) END AS rtl,
  CASE WHEN regexp_matches(text, '[\\x{3040}-\\x{30FF}]') THEN 'ja' WHEN regexp_matches(text, '[\\x{AC00}-\\x{D7AF}]') THEN 'ko' WHEN regexp_matches(text, '[\\x{4E00}-\\x{9FFF}]') THEN 'zh'
    WHEN regexp_matches(text, '[\\x{0400}-\\x{04FF}]') THEN 'ru' WHEN regexp_matches(text, '[\\x{0590}-\\x{05FF}]') THEN 'he' WHEN regexp_matches(text, '[\\x{0600}-\\x{06FF}]') THEN 'ar' ELSE 'latin' END AS script FROM documents""")
def script_profile(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.rtl_share(F.col("text")).alias("rtl"), X.script(F.col("text")).alias("script"))


_BITS = ", ".join(f"sum(CASE WHEN ((v >> {i}) & 1) = 1 THEN 1 ELSE -1 END) AS b{i}" for i in range(64))
_FOLD = " | ".join(f"(CASE WHEN coalesce(b{i}, 0) >= 0 THEN 1::UBIGINT << {i} ELSE 0::UBIGINT END)" for i in range(64))


@query(f"""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_extract_all({_LOW}, '[\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS w FROM documents),
v AS (SELECT doc_id, CAST('0x' || substr(sha256(w), 1, 16) AS UBIGINT) AS v FROM t), s AS (SELECT doc_id, {_BITS} FROM v GROUP BY doc_id)
SELECT d.doc_id, lpad(lower(to_hex({_FOLD})), 16, '0') AS fingerprint FROM documents d LEFT JOIN s USING (doc_id)""")
def document_fingerprint(spark, sf_dir):
    return hashes.fingerprints(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"))


# what lines open with; which roles these give them is in the SQL alone
_OPENINGS = (
    "• ", "– ", "· ", "● ", "  ∙\t", "-", "(a) ", "(iv) ", "[abc] ", "[12] ", "iv. ", "IV) ", "iV. ", "1234. ", "CHAPTER 2 ", "Part II ", "appendix a ", "1.2.3 ", "7. ", "Fig. 3 ", "eq. x ", "algorithm 1 ", "Figures 2 ", "TABLE a ", "Table: 1 ", "chart.b ", "",
)
_ROLES = "(0, 'b'), (1, 'b'), (2, 'b'), (4, 'b'), (6, 'e'), (7, 'e'), (9, 'e'), (10, 'e'), (11, 'e'), (13, 's'), (14, 's'), (16, 's'), (17, 's'), (18, 'es'), (19, 'c'), (20, 'c'), (23, 'c'), (25, 'c')"


@query(f"""WITH {BLOCKS_SQL}, r(k, roles) AS (VALUES {_ROLES}), x AS (SELECT b.*, coalesce(roles, '') AS roles FROM b LEFT JOIN r ON (doc_id + idx) % {len(_OPENINGS)} = k)
SELECT doc_id, count(*) AS blocks, count(*) FILTER (contains(roles, 'b')) AS bullets, count(*) FILTER (contains(roles, 'e')) AS enumerated, count(*) FILTER (contains(roles, 's')) AS headings,
  count(*) FILTER (regexp_matches('word ' || text, '[.!?:]\\s*$')) AS closed, count(*) FILTER (contains(roles, 'c')) AS captions, count(*) FILTER (contains(roles, 'b') OR contains(roles, 'e')) AS bare FROM x GROUP BY doc_id""")
def line_roles(spark, sf_dir):
    opening = F.element_at(F.array(*map(F.lit, _OPENINGS)), ((F.col("doc_id") + F.col("idx")) % len(_OPENINGS) + 1).cast("int"))
    b = line_blocks(table(spark, sf_dir, "documents")).select("doc_id", F.concat(F.lit("word "), "text").alias("rest"), F.concat(opening, F.lit("word "), "text").alias("text"))
    t = F.col("text")
    tests = (("bullets", X.is_bullet), ("enumerated", X.is_enumerated), ("headings", X.is_section_heading), ("closed", X.ends_sentence), ("captions", X.is_caption))
    listed = X.is_bullet(t) | X.is_enumerated(t)
    return b.groupBy("doc_id").agg(F.count("*").alias("blocks"), *(F.count_if(f(t)).alias(n) for n, f in tests), F.count_if(listed & (X.strip_marker(t) == F.col("rest"))).alias("bare"))


@query(f"""WITH {BLOCKS_SQL}, a AS (SELECT doc_id, idx, regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') AS text FROM b), p AS (SELECT doc_id, idx, text, lag(text) OVER (PARTITION BY doc_id ORDER BY idx) AS before FROM a)
SELECT doc_id, idx, CASE WHEN length(before) = 0 THEN CASE WHEN length(text) = 0 THEN 0.0 ELSE 1.0 END ELSE round(levenshtein(before, text) / length(before), 6) END AS cer FROM p WHERE before IS NOT NULL""")
def line_error_rates(spark, sf_dir):
    """Character error rate of each line, in ASCII, against the one before."""
    b = line_blocks(table(spark, sf_dir, "documents")).withColumn("text", F.regexp_replace("text", "[^\\x00-\\x7F]", "?"))
    p = b.withColumn("before", F.lag("text").over(W.partitionBy("doc_id").orderBy("idx")))
    return p.filter("before IS NOT NULL").select("doc_id", "idx", F.round(X.char_error_rate(F.col("before"), F.col("text")), 6).alias("cer"))
