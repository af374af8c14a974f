"""Order-dependent kernels of one page or document: lines from chunks, one-dimensional
clusters, precedence orders, dictionary segmentation. Each group is one page's or one
document's blocks; pages are dealt out by (doc_id, page)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def anchored_lines(chunks: DataFrame, share: float = 0.6) -> DataFrame:
    """Chunks by falling y-centre, then x, join the last line if their centre is within `share` of
    the line height of that line's first chunk. chunks: doc_id, page, idx, box -> line."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(c=(pdf.y0 + pdf.y1) / 2).sort_values(["c", "x0", "idx"], ascending=[False, True, True])
        lines, first, height, line = [], None, 0.0, -1
        for r in pdf.itertuples(index=False):
            if first is None or abs(first - r.c) > share * height:
                first, height, line = r.c, r.y1 - r.y0, line + 1
            lines.append(line)
        return pd.DataFrame({"doc_id": pdf.doc_id, "page": pdf.page, "idx": pdf.idx, "line": lines})

    return chunks.select("doc_id", "page", "idx", "x0", "y0", "y1").groupBy("doc_id", "page").applyInPandas(run, "doc_id long, page int, idx int, line int")


def clustered(values: Column, tolerance: float) -> Column:
    """Representatives of sorted values: a value within the tolerance of the last one moves it
    half-way, another one opens a cluster."""
    start = F.array().cast("array<double>")

    def step(acc: Column, v: Column) -> Column:
        last = F.element_at(acc, -1)
        near = (F.size(acc) > 0) & (v - F.when(F.size(acc) > 0, last).otherwise(v) <= tolerance)
        moved = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array((F.when(F.size(acc) > 0, last).otherwise(v) + v) / 2))
        return F.when(near, moved).otherwise(F.concat(acc, F.array(v)))

    return F.aggregate(F.array_sort(values), start, step)


def column_bounds(representatives: Column, least: Column, most: Column) -> Column:
    """Bounds between clusters: the least value, midpoints of neighbours, the largest value."""
    n = F.size(representatives)
    left = F.slice(representatives, F.lit(1), F.greatest(n - 1, F.lit(0)))
    right = F.slice(representatives, F.lit(2), F.greatest(n - 1, F.lit(0)))
    return F.concat(F.array(least), F.zip_with(left, right, lambda a, b: (a + b) / 2), F.array(most))


def precedence_order(keys: list[tuple], edges: list[tuple[int, int]]) -> list[int]:
    """Topological order that takes the least key first; what a cycle holds back follows in the
    order of keys."""
    after: dict[int, list[int]] = {i: [] for i in range(len(keys))}
    waits = [0] * len(keys)
    for a, b in edges:
        after[a].append(b)
        waits[b] += 1
    heap = [(keys[i], i) for i in range(len(keys)) if not waits[i]]
    heapq.heapify(heap)
    out = []
    while heap:
        _, i = heapq.heappop(heap)
        out.append(i)
        for j in after[i]:
            waits[j] -= 1
            if not waits[j]:
                heapq.heappush(heap, (keys[j], j))
    done = set(out)
    return out + sorted((i for i in range(len(keys)) if i not in done), key=lambda i: keys[i])


def reading_order(blocks: DataFrame) -> DataFrame:
    """Reading index of a page's blocks: a block precedes one below it that shares its columns,
    and one to the right of it at the same height; ties fall to the higher, then the first."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf.sort_values("idx").itertuples(index=False))
        edges = []
        for i, a in enumerate(rows):
            for j, b in enumerate(rows):
                if i == j:
                    continue
                across = min(a.x1, b.x1) - max(a.x0, b.x0) > 0
                level = min(a.y1, b.y1) - max(a.y0, b.y0) > 0
                if (across and not level and a.y0 >= b.y1) or (level and not across and a.x1 <= b.x0):
                    edges.append((i, j))
        order = precedence_order([(-r.y1, r.x0, r.idx) for r in rows], edges)
        place = {rows[i].idx: k for k, i in enumerate(order)}
        return pd.DataFrame([(r.doc_id, r.page, r.idx, place[r.idx]) for r in rows], columns=["doc_id", "page", "idx", "reading"])

    return blocks.select("doc_id", "page", "idx", "x0", "y0", "x1", "y1").groupBy("doc_id", "page").applyInPandas(run, "doc_id long, page int, idx int, reading int")


def segment(text: str, terms: dict[str, int], longest: int) -> list[tuple[int, str]]:
    """Longest match from the left, (offset, term); other characters are skipped one by one."""
    out, i = [], 0
    while i < len(text):
        for n in range(min(longest, len(text) - i), 0, -1):
            if text[i : i + n] in terms:
                out.append((i, text[i : i + n]))
                i += n
                break
        else:
            i += 1
    return out


def dictionary_matches(df: DataFrame, key: str, text: str, terms: list[str], most_bytes: int = 16_000_000) -> DataFrame:
    """(key, offset, term) of all dictionary terms, the longest from the left. A dictionary of most_bytes at most goes to
    every task; a larger one is joined with the substrings of its terms' lengths, and the matches of a text are then
    streamed in order."""
    src = df.select(key, text)
    schema = f"{key} {src.schema[key].dataType.simpleString()}, offset long, term string"
    if sum(len(t.encode()) for t in terms) > most_bytes:
        return _joined_matches(src, key, text, terms, schema)
    known, longest = {t: i for i, t in enumerate(terms)}, max(map(len, terms), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *m) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in segment(t or "", known, longest)]
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (batch.column(0).type, pa.int64(), pa.string()), strict=True)], [key, "offset", "term"])

    return src.mapInArrow(run, schema)


def _joined_matches(src: DataFrame, key: str, text: str, terms: list[str], schema: str) -> DataFrame:
    known = src.sparkSession.createDataFrame([(t, len(t)) for t in terms if t], "term string, size int")
    sizes = F.array(*map(F.lit, sorted({len(t) for t in terms if t})))
    rows = src.select(F.monotonically_increasing_id().alias("_row"), F.col(key), F.col(text).alias("_text")).filter("length(_text) > 0")
    at = rows.select("_row", key, "_text", F.explode(F.sequence(F.lit(0), F.length("_text") - 1)).alias("_at")).select("_row", key, "_text", "_at", F.explode(sizes).alias("_size"))
    parts = at.filter("_at + _size <= length(_text)").select("_row", key, F.col("_at").cast("long").alias("offset"), F.expr("substring(_text, _at + 1, _size)").alias("_part"))
    hits = parts.join(known, F.col("_part") == F.col("term")).select("_row", key, "offset", "term", "size")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, end = None, 0
        for batch in batches:
            keep = []
            for r, o, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if r != row:
                    row, end = r, 0
                keep.append(o >= end)
                if keep[-1]:
                    end = o + n
            yield batch.select([1, 2, 3]).filter(pa.array(keep, pa.bool_()))

    return hits.repartition("_row").sortWithinPartitions("_row", "offset", F.desc("size")).mapInArrow(first, schema)
