"""Reachability, trees and cycles over edge tables. Each step is a join of the newest nodes alone, and
its result is written, so that neither plans nor lineage grow with the depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import written


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, depth) of all nodes that the seeds lead to, themselves at depth 0. edges: a, b; seeds: node."""
    e = written(edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL").distinct(), "edges")
    new = written(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "reached")
    all_, depth = new, 0
    while not new.isEmpty():
        depth += 1
        found = new.join(e, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        new = written(found.join(all_.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "reached")
        all_ = all_.unionAll(new)
    return all_


def flattened(nodes: DataFrame) -> DataFrame:
    """Nodes of trees in depth-first order: id, root, depth, path (places from the root) and position under
    the root. nodes: id, parent (null: a root), place among its siblings. Nodes of a cycle have no root and are
    left out. The order is that of paths; a root's nodes are sorted in its own partition."""
    n = written(nodes.select("id", "parent", F.col("place").cast("long").alias("place")), "nodes")
    new = written(n.filter("parent IS NULL").select("id", F.col("id").alias("root"), F.lit(0).alias("depth"), F.array("place").alias("path")), "tree")
    all_, depth = new, 0
    while not new.isEmpty():
        depth += 1
        above = new.select(F.col("id").alias("_up"), "root", F.col("path").alias("_path"))
        new = written(n.join(above, F.col("parent") == F.col("_up")).select("id", "root", F.lit(depth).alias("depth"), F.concat("_path", F.array("place")).alias("path")), "tree")
        all_ = all_.unionAll(new)
    return all_.withColumn("position", F.row_number().over(W.partitionBy("root").orderBy("path")) - 1)


def cycles(edges: DataFrame, most_length: int = 128) -> DataFrame:
    """Simple cycles inside of each document, each once, from its least node on: doc_id, cycle (array). edges: doc_id, a, b.
    Paths grow from their least node, so that none is found twice."""
    e = written(edges.select("doc_id", "a", "b").distinct(), "edges")
    new = written(e.filter("b >= a").select("doc_id", F.array("a").alias("path"), "b"), "paths")
    found = new.filter(F.col("b") == F.col("path")[0]).select("doc_id", F.col("path").alias("cycle"))
    for _ in range(most_length - 1):
        open_ = new.filter(F.col("b") != F.col("path")[0]).select("doc_id", F.concat("path", F.array("b")).alias("path"), F.col("b").alias("at"))
        step = open_.join(e.withColumnRenamed("b", "to"), (F.col("at") == F.col("a")) & (open_.doc_id == e.doc_id)).select(open_.doc_id, "path", F.col("to").alias("b"))
        # back to the start, or on to a larger node that is not on the path
        new = written(step.filter((F.col("b") == F.col("path")[0]) | ((F.col("b") > F.col("path")[0]) & ~F.array_contains("path", F.col("b")))), "paths")
        if new.isEmpty():
            break
        found = found.unionAll(new.filter(F.col("b") == F.col("path")[0]).select("doc_id", F.col("path").alias("cycle")))
    return found
