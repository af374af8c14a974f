"""Blocks to Markdown, HTML and CSV, and form data in and out of JSON, FDF and XFDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_quote, escape_html, escape_markdown

FURNITURE = ("header", "footer", "page_number")


def heading_level(n: Column) -> Column:
    return F.when(n <= 10, 1).when(n <= 20, 2).otherwise(3)


def cells(text: Column) -> Column:
    return F.split(text, " \\| ")


def block_markdown() -> Column:
    """One block: headings have a mark more than their level, table lines are rows."""
    text = escape_markdown(F.col("text"))
    row = F.concat(F.lit("| "), F.array_join(F.transform(cells(F.col("text")), lambda c: escape_markdown(F.trim(c))), " | "), F.lit(" |"))
    return F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), heading_level(F.col("n")) + 1), F.lit(" "), text)).when(F.col("kind") == "table", row).otherwise(text)


def block_html() -> Column:
    text = escape_html(F.col("text"))
    level = (heading_level(F.col("n")) + 1).cast("string")
    row = F.concat(F.lit("<tr>"), F.array_join(F.transform(cells(F.col("text")), lambda c: F.concat(F.lit("<td>"), escape_html(F.trim(c)), F.lit("</td>"))), ""), F.lit("</tr>"))
    return F.when(F.col("kind") == "heading", F.concat(F.lit("<h"), level, F.lit(">"), text, F.lit("</h"), level, F.lit(">"))).when(F.col("kind") == "table", row).otherwise(F.concat(F.lit("<p>"), text, F.lit("</p>")))


def documents_as(blocks: DataFrame, form: Column, separator: str) -> DataFrame:
    """(doc_id, out): all blocks but furniture and blank ones in reading order. A document's
    blocks are bounded by its text."""
    b = blocks.filter(~F.col("kind").isin(*FURNITURE) & (F.col("n") > 0)).select("doc_id", "idx", form.alias("piece"))
    g = b.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "piece"))).alias("all"))
    return g.select("doc_id", F.array_join(F.transform("all", lambda x: x["piece"]), separator).alias("out"))


def row_csv() -> Column:
    return F.array_join(F.transform(cells(F.col("text")), lambda c: csv_quote(F.trim(c))), ",")


def to_json_form(fields: Column) -> Column:
    """fields: array of (name, value) structs."""
    return F.to_json(F.struct(fields.alias("fields")))


def from_json_form(data: Column) -> Column:
    return F.from_json(data, "fields array<struct<name string, value string>>")["fields"]


def to_xfdf(fields: Column) -> Column:
    each = F.transform(fields, lambda f: F.concat(F.lit('<field name="'), escape_html(f["name"]), F.lit('"><value>'), escape_html(f["value"]), F.lit("</value></field>")))
    return F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><xfdf><fields>'), F.array_join(each, ""), F.lit("</fields></xfdf>"))


def from_xfdf(data: Column) -> Column:
    """Names and values by XPath; a text with a document type or entities of its own has none."""
    names, values = F.xpath(data, F.lit("/xfdf/fields/field/@name")), F.xpath(data, F.lit("/xfdf/fields/field/value/text()"))
    zipped = F.zip_with(names, values, lambda n, v: F.struct(n.alias("name"), v.alias("value")))
    return F.when(~F.upper(data).rlike("<!DOCTYPE|<!ENTITY"), zipped)


def to_fdf(fields: Column) -> Column:
    quote = lambda c: F.regexp_replace(c, "([()\\\\])", "\\\\$1")
    each = F.transform(fields, lambda f: F.concat(F.lit("<< /T ("), quote(f["name"]), F.lit(") /V ("), quote(f["value"]), F.lit(") >>")))
    return F.concat(F.lit("%FDF-1.2\n1 0 obj << /FDF << /Fields ["), F.array_join(each, " "), F.lit("] >> >> endobj\ntrailer << /Root 1 0 R >>\n%%EOF"))


def from_fdf(data: Column) -> Column:
    string = "\\(((?:[^()\\\\]|\\\\.)*)\\)"
    plain = lambda c: F.regexp_replace(c, "\\\\(.)", "$1")
    names, values = (F.regexp_extract_all(data, F.lit(f"/T {string} /V {string}"), F.lit(k)) for k in (1, 2))
    return F.zip_with(names, values, lambda n, v: F.struct(plain(n).alias("name"), plain(v).alias("value")))
