"""SimHash near-dedup with deletion-variant signatures.

A fingerprint has 64 bits; fingerprints link at three differing bits or fewer. Cut into
two segments of 32 bits, one of them differs in at most one bit. So every distinct
fingerprint is indexed under its 64 one-wildcard segment variants (a segment and one
of its bits left out); fingerprints that link meet under one of them by an equality join,
and the pair is kept if the whole fingerprints differ in at most three bits. Equal
fingerprints are one node, so thousands of copies cost one row. Variants that very many
fingerprints share are cut again: of the four bytes of the other segment one must be
equal, and it joins the key; if far more share one, three of six parts must be, of 16 bits.

Components come from alternating large-star and small-star steps, each an aggregation
with map-side combine and a join, written to the shared folder; the number of steps
grows with the logarithm of a component's size.

Defined results: null and empty text have fingerprint zero, linked like any other;
repeated rows share a fingerprint and a component; a null doc_id gets its component but
names none (null where all ids are null); an empty table gives an empty result; further
columns are ignored by `near_duplicates` and kept by `drop_near_duplicates`, which keeps one
row of each component: the smallest doc_id, nulls last, and of its texts the least MD5.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import LOWER, bitmap, discard, in_bitmap, materialize, pieces, read_schema, table, text_buffer, word_spans

SHINGLE, SEED, MOST_DIFFERENT = 3, 42, 3
#: A variant shared by more fingerprints than this is cut again, by four or six parts of the other segment.
HEAVY, HEAVIER = 256, 65_536
#: Shingles whose bits, and bytes of text whose words, are held at once: a fingerprinting worker needs little
#: beside its batch, since two of them share an executor with a heap that other stages have filled.
SLICE, PIECE = 16_384, 250_000


def simhash(col: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprints of a string column as unsigned 64-bit numbers."""
    buf, at = text_buffer(col)
    out = np.zeros(len(at) - 1, np.uint64)
    digest = xxhash.xxh64_intdigest
    for i, j, part, off in pieces(buf, at, PIECE):
        part = LOWER[part]
        starts, ends, first = word_spans(part, off)
        if not len(starts):
            continue
        # the words with one space after each
        lengths = ends - starts + 1
        to = np.append(0, np.cumsum(lengths))
        joined = np.full(int(to[-1]), 0x20, np.uint8)
        inside = np.arange(len(joined)) - np.repeat(to[:-1], lengths) + np.repeat(starts, lengths)
        last = to[1:] - 1
        inside[last] = 0
        joined[:] = part[inside]
        joined[last] = 0x20
        whole = joined.tobytes()
        words = np.diff(first)
        shingles = np.where(words > 0, np.maximum(words - shingle + 1, 1), 0)
        row = np.repeat(np.arange(j - i), shingles)
        begin = np.arange(len(row)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + np.repeat(first[:-1], shingles)
        end = np.minimum(begin + shingle, first[1:][row])
        ones = np.zeros((j - i, 64), np.int64)
        for k in range(0, len(row), SLICE):
            here = slice(k, k + SLICE)
            spans = zip(to[begin[here]].tolist(), (to[end[here]] - 1).tolist(), strict=True)
            hashes = np.fromiter((digest(whole[s:e], SEED) for s, e in spans), np.uint64, len(row[here]))
            bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            of, at_first = np.unique(row[here], return_index=True)
            ones[of] += np.add.reduceat(bits, at_first, axis=0, dtype=np.int64)
        has = np.flatnonzero(shingles)
        ones = ones[has]
        major = 2 * ones > shingles[has][:, None]
        out[i + has] = np.packbits(major, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        yield pa.record_batch([batch.column(0), pa.array(simhash(batch.column(1)).view(np.int64)), *batch.columns[2:]], [names[0], "fp", *names[2:]])


def variants(fp: DataFrame) -> DataFrame:
    """(fp) -> (fp, key): the segment, the bit left out and the other 31 bits in one number."""
    which = fp.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v"))
    return which.select("fp", F.expr("(CAST(v AS BIGINT) << 32) | ((CASE WHEN v < 32 THEN fp ELSE shiftrightunsigned(fp, 32) END) & 4294967295L & ~(1L << (v % 32)))").alias("key"))


def _pairs(rows: DataFrame, on: list[str]) -> DataFrame:
    """Linked pairs of rows with equal `on`. Spark takes the size of exploded rows for that of their source, so
    that it would gather and send out tables of 64 times the size: the hint keeps it from that."""
    a, b = rows.alias("a"), rows.alias("b").hint("merge")
    near = F.expr(f"a.fp < b.fp AND bit_count(a.fp ^ b.fp) <= {MOST_DIFFERENT}")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on]
    both = same[0]
    for x in same[1:]:
        both = both & x
    return a.join(b, both & near).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def links(fp: DataFrame, heavy: int = HEAVY, heavier: int = HEAVIER) -> DataFrame:
    """All pairs (a, b) of distinct fingerprints that link."""
    rows = variants(fp)
    crowded = materialize(rows.groupBy("key").count().filter(F.col("count") > heavy), "crowded")
    if crowded.isEmpty():
        return _pairs(rows, ["key"]).distinct()
    found = _pairs(rows.join(crowded.select("key"), "key", "left_anti"), ["key"])
    # the other segment: the low half's key (v < 32) goes with the high half
    other = F.expr("(CASE WHEN (key >> 32) < 32 THEN shiftrightunsigned(fp, 32) ELSE fp & 4294967295L END)")
    for cut, keys in ((f"count <= {heavier}", _part_masks(4)), (f"count > {heavier}", _part_masks(6))):
        some = rows.join(crowded.filter(cut).select("key"), "key", "left_semi").select("fp", "key", other.alias("o"), F.posexplode(F.array(*map(F.lit, keys))).alias("k", "mask"))
        found = found.unionAll(_pairs(some.select("fp", "key", F.expr("(CAST(k AS BIGINT) << 32) | (o & mask)").alias("part")), ["key", "part"]))
    return found.distinct()


def _part_masks(parts: int) -> list[int]:
    """Of so many parts of a segment, all but three are equal if three bits differ at most: the
    masks of all such choices."""
    edges = [32 * i // parts for i in range(parts + 1)]
    mask = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(mask[i] for i in chosen) for chosen in itertools.combinations(range(parts), parts - MOST_DIFFERENT)]


def _check(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, root): the least node of each one's component, for all nodes
    that have links."""
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    before = None
    while before != (now := _check(edges)):
        before = now
        # large star: every larger neighbour links to the least one
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: the node and its smaller neighbours link to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(least, F.col("a") == F.col("u")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, edges = edges, materialize(small.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "star")
        discard(old)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _rooted(prints: DataFrame, rep: Column) -> DataFrame:
    """Every distinct fp with the least rep of its rows and the root of its component."""
    nodes = materialize(prints.groupBy("fp").agg(F.min(rep).alias("rep")), "nodes")
    found = components(links(nodes.select("fp")))
    # root links to itself too, so that a component's ids can be summed up
    member = found.unionAll(found.select(F.col("root").alias("node"), "root").distinct())
    return nodes.join(member, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) for every row."""
    long = T.LongType()
    prints = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprint, read_schema(("doc_id", long), ("fp", long)))
    prints = materialize(prints, "fingerprints")
    rooted = _rooted(prints, F.col("doc_id"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_print = rooted.join(smallest, "root").select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(by_print, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of docs for each component, by id (nulls last) and text. Rows that stay are not
    shuffled, but for those that a bitmap takes for dropped ones."""
    long = T.LongType()
    own, tie = F.col("doc_id").cast("long"), F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    prints = docs.select(own.alias("doc_id"), "text", tie.alias("tie")).mapInArrow(_fingerprint, read_schema(("doc_id", long), ("fp", long), ("tie", T.StringType())))
    prints = materialize(prints, "fingerprints")
    rooted = _rooted(prints, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie"))
    stay = rooted.groupBy("root").agg(F.min("rep").alias("rep")).select(F.col("rep.doc_id").alias("stay_id"), F.col("rep.tie").alias("stay_tie"), F.lit(True).alias("stays"))
    # (id, text) pairs to drop, and pairs to keep that come in several rows, one of which stays
    pairs = prints.groupBy("doc_id", "tie").agg(F.count("*").alias("n"))
    told = pairs.join(stay, pairs.doc_id.eqNullSafe(F.col("stay_id")) & (F.col("tie") == F.col("stay_tie")), "left")
    gone = materialize(told.filter("stays IS NULL OR n > 1").select(F.col("doc_id").alias("gone_id"), F.col("tie").alias("gone_tie"), F.col("stays").isNull().alias("gone")), "gone")
    discard(prints)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(gone.select(F.xxhash64("gone_id", "gone_tie").alias("h"))))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), own.alias("id"), tie.alias("tie"))
    rows = rows.withColumn("told", in_bitmap(shared)(F.xxhash64("id", "tie")))
    some = rows.filter("told").join(gone.filter("gone"), F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("tie") == F.col("gone_tie")), "left_anti")
    some = some.dropDuplicates(["id", "tie"]).select("row")
    return rows.filter("NOT told").select("row").unionAll(some).select("row.*")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash": op2_simhash}
