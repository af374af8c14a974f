"""Pages of documents: ranges of numbers, rotation, crop boxes, insertion, sheets; and repeated text
chunks of a page."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import Box
from ..functions.values import let, strip


def page_range(spec: Column, total: Column) -> Column:
    """struct(pages, error) of 'all', '2-5', '1,3,7' and the like: sorted distinct numbers from 1 on, or what is
    wrong with the first part that is."""
    number = lambda t: F.when(t.rlike("^[+]?[0-9]+$"), t.try_cast("long"))
    zero, invalid = F.lit("page numbers are 1-indexed; 0 is invalid"), lambda t: F.concat(F.lit("invalid page number '"), t, F.lit("'"))
    beyond = lambda n: F.concat(F.lit("page "), n.cast("string"), F.lit(" exceeds document length ("), total.cast("string"), F.lit(")"))

    def part(p: Column) -> Column:
        dash = F.instr(p, "-")
        first, last = F.when(dash > 0, F.substring(p, F.lit(1), dash - 1)).otherwise(p), F.when(dash > 0, F.substring(p, dash + 1, F.length(p))).otherwise(p)

        def told(n: Column) -> Column:
            a, b = n["a"], n["b"]
            error = (
                F.when(a.isNull(), invalid(first)).when(b.isNull(), invalid(last)).when((a == 0) | (b == 0), zero)
                .when(a > b, F.concat(F.lit("range "), a.cast("string"), F.lit("-"), b.cast("string"), F.lit(" is backwards"))).when(b > total, beyond(b))
            )
            return F.struct(F.when(error.isNull(), F.sequence(a, b)).alias("pages"), error.alias("error"))

        return let(F.struct(number(strip(first)).alias("a"), number(strip(last)).alias("b")), told)

    def whole(parts: Column) -> Column:
        errors = F.filter(F.transform(parts, lambda x: x["error"]), lambda e: e.isNotNull())
        error = F.coalesce(F.get(errors, F.lit(0)), F.when(F.size(parts) == 0, "no valid page numbers found in range string"))
        return F.struct(F.when(error.isNull(), F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda x: x["pages"]))))).alias("pages"), error.alias("error"))

    every = F.struct(F.when(total > 0, F.sequence(F.lit(1).cast("long"), F.greatest(total, F.lit(1)).cast("long"))).otherwise(F.array().cast("array<bigint>")).alias("pages"), F.lit(None).cast("string").alias("error"))
    parts = F.transform(F.filter(F.transform(F.split(strip(spec), ","), strip), lambda p: p != ""), part)
    return F.when(spec.isNull() | spec.isin("all", ""), every).otherwise(let(parts, whole))


def clamped(region: Box, page: Box) -> Column:
    """The part of a region on its page (box struct), null if there is none."""
    x0, y0, x1, y1 = F.greatest(region.x0, page.x0), F.greatest(region.y0, page.y0), F.least(region.x1, page.x1), F.least(region.y1, page.y1)
    return F.when((x0 < x1) & (y0 < y1), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def is_subset_font(name: Column) -> Column:
    """Six capitals and a plus sign before the name."""
    return name.rlike("^[A-Z]{6}\\+")


def rotated(pages: DataFrame, chosen: DataFrame, degrees: int, relative: bool = True) -> DataFrame:
    """pages (doc_id, page, rotation, ...) with the rotation of chosen ones (doc_id, page) changed: a quarter
    turn or several, 0 for any other angle."""
    c = chosen.select("doc_id", "page").distinct().withColumn("_on", F.lit(True))
    angle = F.pmod((F.pmod(F.col("rotation"), F.lit(360)) if relative else F.lit(0)) + F.lit(degrees), F.lit(360))
    angle = F.when(angle % 90 == 0, angle).otherwise(0)
    return pages.join(c, ["doc_id", "page"], "left").withColumn("rotation", F.when(F.col("_on"), angle).otherwise(F.col("rotation"))).drop("_on")


def inserted(base: DataFrame, other: DataFrame, at: int) -> DataFrame:
    """base's pages with other's before position `at` (from 1): doc_id, page, source, position. Both: doc_id, page."""
    a = base.select("doc_id", "page", F.lit("base").alias("source"), F.when(F.col("page") < at, 0).otherwise(2).alias("_part"))
    b = other.select("doc_id", "page", F.lit("other").alias("source"), F.lit(1).alias("_part"))
    return a.unionAll(b).withColumn("position", F.row_number().over(W.partitionBy("doc_id").orderBy("_part", "page"))).drop("_part")


def sheets(pages: DataFrame, columns: int, rows: int) -> DataFrame:
    """Where pages stand, several a sheet of the first page's size: doc_id, page, sheet, x, y, width, height. pages:
    doc_id, page, width, height; at most 64 a sheet."""
    if not 1 <= columns * rows <= 64:
        raise ValueError("rows * columns has to be from 1 to 64")
    order = W.partitionBy("doc_id").orderBy("page")
    first = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    p = pages.withColumn("_i", F.row_number().over(order) - 1).withColumn("_w", F.first("width").over(first)).withColumn("_h", F.first("height").over(first))
    w, h = F.greatest("width", F.lit(1.0)), F.greatest("height", F.lit(1.0))
    p = p.withColumn("_k", F.col("_i") % (columns * rows)).withColumn("_cw", F.col("_w") / columns).withColumn("_ch", F.col("_h") / rows)
    p = p.withColumn("_s", F.least(F.col("_cw") / w, F.col("_ch") / h))
    x = (F.col("_k") % columns) * F.col("_cw") + (F.col("_cw") - w * F.col("_s")) / 2
    y = F.col("_h") - (F.floor(F.col("_k") / columns) + 1) * F.col("_ch") + (F.col("_ch") - h * F.col("_s")) / 2
    return p.select("doc_id", "page", F.floor(F.col("_i") / (columns * rows)).alias("sheet"), x.alias("x"), y.alias("y"), (w * F.col("_s")).alias("width"), (h * F.col("_s")).alias("height"))


def band_index(bounds: Column, value: Column) -> Column:
    """The first interval of rising bounds that holds a value, ends included; null outside."""
    low = F.slice(bounds, F.lit(1), F.greatest(F.size(bounds) - 1, F.lit(0)))
    hits = F.filter(F.transform(low, lambda lo, i: F.when((value >= lo) & (value <= F.get(bounds, i + 1)), i)), lambda i: i.isNotNull())
    return F.get(hits, F.lit(0))


# How far chunks may stand apart that are one.
APART_X, APART_Y, APART_SIZE = 0.75, 0.75, 0.5


def _same(col: pa.Array) -> np.ndarray:
    """For each row but the first, whether it equals the one before; nulls are equal."""
    a, b = col.slice(0, len(col) - 1), col.slice(1)
    return pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)


def without_repeats(chunks: DataFrame) -> DataFrame:
    """Chunks without those that an earlier kept one of the same text and visibility stands under. What is kept depends
    on what was kept before: chunks of one text of a page are streamed in order. The first one of a group is kept, and
    what stands under it goes for all groups of a batch at once; what is left, and a group that goes on in the next batch,
    is held against kept ones in neighbouring squares. Chunks without a place are kept. chunks: doc_id, page, idx, text, x, y,
    size, invisible."""

    def fresh(kept: dict[tuple, list[tuple]], x: float, y: float, size: float) -> bool:
        """Whether no kept one is near; if so, it is kept."""
        if not (np.isfinite(x) and np.isfinite(y)):
            return True
        gx, gy = int(x // APART_X), int(y // APART_Y)
        near = (k for dx in (-1, 0, 1) for dy in (-1, 0, 1) for k in kept.get((gx + dx, gy + dy), ()))
        if any(abs(k[0] - x) <= APART_X and abs(k[1] - y) <= APART_Y and abs(k[2] - size) <= APART_SIZE for k in near):
            return False
        kept.setdefault((gx, gy), []).append((x, y, size))
        return True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, kept = None, {}  # the last row's group, and what is kept of it
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(k) for k in range(4)]
            x, y, size = (batch.column(k).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for k in (5, 6, 7))
            n = batch.num_rows
            start = np.ones(n, bool)
            start[1:] = ~np.logical_and.reduce([_same(k) for k in keys])
            firsts = np.flatnonzero(start)
            ends = np.append(firsts[1:], n)
            stays = np.zeros(n, bool)

            def stream(rows: Iterable[int], kept: dict, x=x, y=y, size=size, stays=stays) -> None:
                for i in rows:
                    stays[i] = fresh(kept, x[i], y[i], size[i])

            if before != tuple(k[0].as_py() for k in keys):
                kept = {}
            stream(range(ends[0]), kept)
            if len(firsts) > 1:
                lo, hi = int(ends[0]), int(firsts[-1])
                of = firsts[np.cumsum(start[lo:hi]) + np.searchsorted(firsts, lo) - 1]  # each row's first one
                here = np.arange(lo, hi)
                with np.errstate(invalid="ignore"):
                    under = (np.abs(x[here] - x[of]) <= APART_X) & (np.abs(y[here] - y[of]) <= APART_Y) & (np.abs(size[here] - size[of]) <= APART_SIZE)
                stays[lo:hi] = here == of
                left = here[~under & (here != of)]
                cuts = np.flatnonzero(np.append(True, of[left - lo][1:] != of[left - lo][:-1])) if len(left) else []
                for rows in np.split(left, cuts[1:]) if len(left) else ():
                    first = int(of[rows[0] - lo])
                    kept = {}
                    fresh(kept, x[first], y[first], size[first])
                    stream(rows.tolist(), kept)
                kept = {}
                stream(range(hi, n), kept)
            before = tuple(k[n - 1].as_py() for k in keys)
            yield pa.record_batch([batch.column(k).filter(pa.array(stays)) for k in (0, 1, 4)], ["doc_id", "page", "idx"])

    src = chunks.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("int").alias("page"), "text", "invisible", F.col("idx").cast("int").alias("idx"), "x", "y", "size")
    tasks = int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return src.repartition(tasks, "doc_id", "page").sortWithinPartitions(*src.columns).mapInArrow(run, "doc_id long, page int, idx int")


def job_states(events: DataFrame, most_jobs: int, retention: int) -> DataFrame:
    """A bounded store of jobs per key, its events streamed in order of ts and id: creation is refused when the store is full,
    run, complete and fail change a job that is there, reap drops jobs that ended `retention` or longer ago. Each event with
    done (whether it changed something) and jobs (how many there are behind it). events: key, ts (long), id, job, kind. What is
    held are a key's jobs, most_jobs at most."""
    src = events.select("key", "ts", "id", "job", "kind").repartition("key").sortWithinPartitions("key", "ts", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, jobs = object(), {}
        for batch in batches:
            done, many = [], []
            for key, ts, _, job, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != mine:
                    mine, jobs = key, {}
                changed = False
                if kind == "create":
                    if len(jobs) < most_jobs:
                        changed, jobs[job] = True, None
                elif kind == "reap":
                    left = {j: end for j, end in jobs.items() if end is None or ts - end < retention}
                    changed, jobs = len(left) < len(jobs), left
                elif job in jobs:
                    changed, jobs[job] = True, None if kind == "run" and jobs[job] is None else ts if kind != "run" else jobs[job]
                done.append(changed)
                many.append(len(jobs))
            yield pa.record_batch([*batch.columns, pa.array(done, pa.bool_()), pa.array(many, pa.int64())], ["key", "ts", "id", "job", "kind", "done", "jobs"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema) + ", done boolean, jobs long"
    return src.mapInArrow(run, schema)


def bounded_sessions(events: DataFrame, most: int, idle: int) -> DataFrame:
    """Sessions per owner, their events streamed in order of ts and id: an event of an open session touches it, one of a
    new session opens it; where the owner is at the bound, sessions that were idle for longer than `idle` end first, and
    if there are still as many the session is refused. events: owner, ts (long), id, session -> with opened, refused and active.
    An owner's open sessions, `most` at most, are what is held."""
    src = events.select("owner", "ts", "id", "session").repartition("owner").sortWithinPartitions("owner", "ts", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, active = object(), {}
        for batch in batches:
            opened, refused, many = [], [], []
            for owner, ts, _, session in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if owner != mine:
                    mine, active = owner, {}
                new = session not in active
                if new and len(active) >= most:
                    active = {s: t for s, t in active.items() if ts - t <= idle}
                full = new and len(active) >= most
                if not full:
                    active[session] = ts
                opened.append(new and not full)
                refused.append(full)
                many.append(len(active))
            yield pa.record_batch([*batch.columns, pa.array(opened, pa.bool_()), pa.array(refused, pa.bool_()), pa.array(many, pa.int64())], ["owner", "ts", "id", "session", "opened", "refused", "active"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema) + ", opened boolean, refused boolean, active long"
    return src.mapInArrow(run, schema)
