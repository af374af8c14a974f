"""Tables of the engine: Parquet tables by name, and text documents as laid-out blocks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES_PER_PAGE = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet to the folder that spark.checkpoint.dir names, and read again: lineage ends
    there, and a lost executor costs a re-read. Local Spark alone may go without such a setting."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='leafmill-checkpoints-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    path = f"{at}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def line_blocks(docs: DataFrame) -> DataFrame:
    """One block for each line of a text, on pages of 20 lines with a plain typewriter layout:
    doc_id, idx, page, text, n, x0, y0, x1, y1, font_size, confidence, kind."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("idx", "text"))
    b = lines.withColumn("n", F.length("text")).withColumn("page", (F.floor(F.col("idx") / LINES_PER_PAGE) + 1).cast("int"))
    b = b.withColumn("x0", 72.0 + 12.0 * ((F.col("doc_id") + F.col("idx")) % 4))
    b = b.withColumn("x1", F.col("x0") + F.least(F.col("n"), F.lit(80)) * 5.0)
    b = b.withColumn("y1", 760.0 - 36.0 * (F.col("idx") % LINES_PER_PAGE)).withColumn("y0", F.col("y1") - 12.0)
    b = b.withColumn("font_size", 9.0 + 0.25 * ((F.col("doc_id") * 7 + F.col("idx") * 3) % 9))
    b = b.withColumn("confidence", ((F.col("doc_id") * 31 + F.col("idx") * 17) % 100) / 100.0)
    kind = F.when(F.col("n") == 0, "text").when(F.col("text").startswith("Licensed"), "footer").when(F.col("text").contains(" | "), "table").when((F.col("n") <= 30) & ~F.col("text").contains(","), "heading").otherwise("paragraph")
    return b.withColumn("kind", kind)


#: The same blocks in DuckDB, for oracles: WITH + BLOCKS_SQL + SELECT ... FROM b.
BLOCKS_SQL = """
l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, CAST(unnest(range(0, len(ls))) AS INT) AS idx, unnest(ls) AS text FROM l),
g AS (SELECT *, length(text) AS n, CAST(idx // 20 + 1 AS INT) AS page, 72.0::DOUBLE + 12.0::DOUBLE * ((doc_id + idx) % 4) AS x0, 760.0::DOUBLE - 36.0::DOUBLE * (idx % 20) AS y1 FROM e),
b AS (SELECT *, x0 + least(n, 80) * 5.0::DOUBLE AS x1, y1 - 12.0::DOUBLE AS y0, 9.0::DOUBLE + 0.25::DOUBLE * ((doc_id * 7 + idx * 3) % 9) AS font_size,
  ((doc_id * 31 + idx * 17) % 100) / 100.0::DOUBLE AS confidence,
  CASE WHEN n = 0 THEN 'text' WHEN starts_with(text, 'Licensed') THEN 'footer' WHEN contains(text, ' | ') THEN 'table' WHEN n <= 30 AND NOT contains(text, ',') THEN 'heading' ELSE 'paragraph' END AS kind FROM g)
"""
