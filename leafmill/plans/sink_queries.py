"""Queries that write documents and form data as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import serialize as S
from ..sources.tables import BLOCKS_SQL, line_blocks, table

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


_MD = r"replace(regexp_replace({0}, '([\\`*_\[\]<>|])', '\\\1', 'g'), chr(10), ' ')"
_HTML = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
_LEVEL = "(CASE WHEN n <= 10 THEN 1 WHEN n <= 20 THEN 2 ELSE 3 END)"


def _documents(form: str, sep: str) -> str:
    return f"WITH {BLOCKS_SQL}, p AS (SELECT doc_id, idx, {form} AS piece FROM b WHERE kind <> 'footer' AND n > 0) SELECT doc_id, md5(string_agg(piece, {sep} ORDER BY idx)) AS digest, CAST(length(string_agg(piece, {sep} ORDER BY idx)) AS INT) AS chars FROM p GROUP BY doc_id"


def _digest(df):
    return df.select("doc_id", F.md5("out").alias("digest"), F.length("out").alias("chars"))


@query(_documents(f"CASE kind WHEN 'heading' THEN repeat('#', {_LEVEL} + 1) || ' ' || {_MD.format('text')} WHEN 'table' THEN '| ' || array_to_string(list_transform(string_split(text, ' | '), lambda c: {_MD.format('trim(c)')}), ' | ') || ' |' ELSE {_MD.format('text')} END", "chr(10) || chr(10)"))
def markdown_documents(spark, sf_dir):
    return _digest(S.documents_as(line_blocks(table(spark, sf_dir, "documents")), S.block_markdown(), "\n\n"))


@query(_documents(f"CASE kind WHEN 'heading' THEN '<h' || ({_LEVEL} + 1) || '>' || {_HTML.format('text')} || '</h' || ({_LEVEL} + 1) || '>' WHEN 'table' THEN '<tr>' || array_to_string(list_transform(string_split(text, ' | '), lambda c: '<td>' || {_HTML.format('trim(c)')} || '</td>'), '') || '</tr>' ELSE '<p>' || {_HTML.format('text')} || '</p>' END", "chr(10)"))
def html_documents(spark, sf_dir):
    return _digest(S.documents_as(line_blocks(table(spark, sf_dir, "documents")), S.block_html(), "\n"))


@query(f"""WITH {BLOCKS_SQL} SELECT doc_id, idx, array_to_string(list_transform(string_split(text, ' | '), lambda c: CASE WHEN regexp_matches(trim(c), '[",\\n\\r]') THEN '"' || replace(trim(c), '"', '""') || '"' ELSE trim(c) END), ',') AS csv FROM b WHERE kind = 'table'""")
def table_csv(spark, sf_dir):
    return line_blocks(table(spark, sf_dir, "documents")).filter("kind = 'table'").select("doc_id", "idx", S.row_csv().alias("csv"))


_FORM = "SELECT c_custkey, 'name (1)' AS name, c_name || ' <&> (x) \\ \"q\"' AS value FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer"


def _round_trip(spark, sf_dir, write, read):
    """Fields of customers written in a form format and read back."""
    value = F.concat("c_name", F.lit(' <&> (x) \\ "q"'))
    fields = F.array(F.struct(F.lit("name (1)").alias("name"), value.alias("value")), F.struct(F.lit("segment").alias("name"), F.col("c_mktsegment").alias("value")))
    c = table(spark, sf_dir, "customer").select("c_custkey", write(fields).alias("data"))
    return c.select("c_custkey", F.explode(read(F.col("data"))).alias("f")).select("c_custkey", "f.name", "f.value")


@query(_FORM)
def form_json(spark, sf_dir):
    return _round_trip(spark, sf_dir, S.to_json_form, S.from_json_form)


@query(_FORM)
def form_xfdf(spark, sf_dir):
    return _round_trip(spark, sf_dir, S.to_xfdf, S.from_xfdf)


@query(_FORM)
def form_fdf(spark, sf_dir):
    return _round_trip(spark, sf_dir, S.to_fdf, S.from_fdf)
