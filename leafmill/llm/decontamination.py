"""Benchmark decontamination: a prefix-filtered set join.

Each benchmark item is cut into windows of 13 words (an item of fewer words is one
window). A document contains a window only if it contains all of its shingles, so the
prefix that has to match is one shingle, and the rarest one makes the fewest
candidates: shingles are ordered by how often they occur in all documents. The join runs
from document shingles to the windows' prefix shingles; where they meet, the shingle's
position in the window gives the only place at which the window can stand (positional
bound), which has to lie inside the document (length bound), and the words there are
compared one by one.

The benchmark is the stated query set. Its size is checked: up to BLOCK_BYTES of its
text are indexed and sent to the executors at once; a larger benchmark is dealt into
blocks of that size, which documents pass one after another.

Defined results: null text has no words, is not contaminated and hits no item; an item
without words has no windows; repeated items with one item_id count once, a null item_id
counts as an empty one; rows are judged one by one, so repeated documents do not matter; an
empty table gives an empty result, an empty benchmark contaminates nothing; further
columns of documents are kept by `annotate` beside one struct column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import LOWER, byte_set, discard, gram_hashes, materialize, pieces, read_schema, table, text_buffer, word_hashes, word_spans

WINDOW, SHINGLE = 13, 3
BLOCK_BYTES = 4_000_000
#: Contaminated: some word is hit, and a twentieth of all at least.
SHARE = 20
#: Bytes of words after lower-casing: digits, a-z and all of the rest of Unicode.
LETTERS = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


class Windows:
    """Distinct windows of one block of benchmark items as rows of word numbers: about 100 bytes a
    window, whatever its text."""

    def __init__(self, items: list[tuple[str, str]]):
        self.items = [i for i, _ in items]
        numbers: dict[bytes, int] = {}
        parts: dict[int, list[np.ndarray]] = {}  # window length -> rows of word numbers
        owner: dict[int, list[np.ndarray]] = {}
        for k, (_, text) in enumerate(items):
            data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
            starts, ends, _ = word_spans(data, np.array([0, len(data)]), LETTERS)
            raw = data.tobytes()
            words = np.array([numbers.setdefault(raw[s:e], len(numbers)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.int32)
            size = min(WINDOW, len(words))
            if size:
                rows = np.lib.stride_tricks.sliding_window_view(words, size)
                parts.setdefault(size, []).append(rows)
                owner.setdefault(size, []).append(np.full(len(rows), k, np.int32))
        self.vocabulary = list(numbers)
        ends = np.cumsum([len(w) for w in self.vocabulary], dtype=np.int64)
        starts = ends - [len(w) for w in self.vocabulary]
        data = np.frombuffer(b"".join(self.vocabulary), np.uint8)
        self.word_hash = np.zeros(len(numbers), np.uint64)
        for i in range(0, len(numbers), 100_000):
            j = min(i + 100_000, len(numbers))
            self.word_hash[i:j] = word_hashes(data[starts[i] : ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i])
        self.words: dict[int, np.ndarray] = {}
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of each window, its first place in a list of items
        for size, rows in parts.items():
            distinct, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
            pair = np.unique(np.stack([which.ravel(), np.concatenate(owner[size])]), axis=1)
            self.words[size] = np.ascontiguousarray(distinct, np.int32)
            self.of[size] = (np.searchsorted(pair[0], np.arange(len(distinct) + 1)), pair[1].astype(np.int32))

    def items_of(self, size: int, window: int) -> list[str]:
        first, items = self.of[size]
        return [self.items[k] for k in items[first[window] : first[window + 1]].tolist()]

    def shingles(self, size: int) -> tuple[int, np.ndarray]:
        """Length of the shingles of windows of a size, and their hashes by position."""
        k, rows = min(SHINGLE, size), self.words[size]
        out = np.empty((len(rows), size - k + 1), np.uint64)
        for i in range(0, len(rows), 50_000):
            part = self.word_hash[rows[i : i + 50_000]]
            flat = gram_hashes(part.ravel(), k)
            out[i : i + 50_000] = flat[(np.arange(len(part))[:, None] * size) + np.arange(size - k + 1)]
        return k, out

    def all_shingles(self) -> dict[int, np.ndarray]:
        """Sorted distinct hashes by shingle length."""
        out: dict[int, np.ndarray] = {}
        for size in self.words:
            k, h = self.shingles(size)
            out[k] = np.union1d(out.get(k, np.zeros(0, np.uint64)), h.ravel())
        return out


def _bits(hashes: np.ndarray) -> np.ndarray:
    """A small table that lets through what may be among the hashes."""
    size = max(1 << 16, 1 << (8 * len(hashes)).bit_length())
    out = np.zeros(size, bool)
    out[hashes & np.uint64(size - 1)] = True
    return out


def _documents(col: pa.Array) -> Iterator[tuple]:
    buf, at = text_buffer(col)
    for i, j, part, off in pieces(buf, at):
        part = LOWER[part]
        starts, ends, first = word_spans(part, off, LETTERS)
        yield i, j, part, starts, ends, first, word_hashes(part, starts, ends)


def _rarity(shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How often each shingle of the benchmark occurs in these documents."""
        known = shared.value
        bits = {k: _bits(h) for k, h in known.items()}
        totals = {k: np.zeros(len(h), np.int64) for k, h in known.items()}
        for batch in batches:
            for *_, first, words in _documents(batch.column(0)):
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                for k, h in known.items():
                    g = gram_hashes(words, k)
                    m = np.flatnonzero(bits[k][g & np.uint64(len(bits[k]) - 1)])
                    m = m[row[m] == row[m + k - 1]]
                    place = np.minimum(np.searchsorted(h, g[m]), len(h) - 1)
                    place = place[h[place] == g[m]]
                    totals[k] += np.bincount(place, minlength=len(h))
        for k, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array(np.full(len(at), k)), pa.array(at), pa.array(n[at])], ["k", "at", "n"])

    return count


class Index:
    """The prefix shingle of every window -> windows and the shingle's place in them."""

    def __init__(self, windows: Windows, known: dict[int, np.ndarray], counts: dict[int, np.ndarray]):
        self.windows, self.by_length = windows, {}
        entries: dict[int, list] = {}
        for size in windows.words:
            k, h = windows.shingles(size)
            frequency = counts[k][np.searchsorted(known[k], h)]
            rarest = np.argmin(frequency, axis=1)
            rows = np.arange(len(h))
            entries.setdefault(k, []).append((h[rows, rarest], rarest.astype(np.int8), np.full(len(h), size, np.int8), rows.astype(np.int32)))
        for k, parts in entries.items():
            h, offset, size, row = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            h = h[order]
            distinct, first, many = np.unique(h, return_index=True, return_counts=True)
            self.by_length[k] = (_bits(distinct), distinct, first, many, offset[order], size[order], row[order])

    def occurrences(self, part, starts, ends, first, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, size, window) of every occurrence in a piece of documents."""
        out = [(np.zeros(0, np.int64),) * 3]
        row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for k, (bits, distinct, at, many, offset, size, window) in self.by_length.items():
            g = gram_hashes(words, k)
            m = np.flatnonzero(bits[g & np.uint64(len(bits) - 1)])
            place = np.minimum(np.searchsorted(distinct, g[m]), len(distinct) - 1)
            same = distinct[place] == g[m]
            m, place = m[same], place[same]
            # a shingle can be the prefix of several windows
            n = many[place]
            entry = np.repeat(at[place] - np.cumsum(n) + n, n) + np.arange(n.sum())
            begin = np.repeat(m, n) - offset[entry]
            length, window_of = size[entry].astype(np.int64), window[entry].astype(np.int64)
            inside = (begin >= 0) & (begin + length <= len(words))
            begin, length, window_of = begin[inside], length[inside], window_of[inside]
            inside = row_of[begin] == row_of[begin + length - 1]
            begin, length, window_of = begin[inside], length[inside], window_of[inside]
            for s in np.unique(length):
                mine = length == s
                b, w = begin[mine], window_of[mine]
                equal = np.ones(len(b), bool)
                for j in range(s):
                    equal &= words[b + j] == self.windows.word_hash[self.windows.words[s][w, j]]
                b, w = b[equal], w[equal]
                out.append((b, np.full(len(b), s), w))
        b, s, w = (np.concatenate(x) for x in zip(*out, strict=True))
        if len(b):  # word by word: each pair of a document's word and a window's word once
            place = np.concatenate([np.arange(x, x + z) for x, z in zip(b.tolist(), s.tolist(), strict=True)])
            number = np.concatenate([self.windows.words[z][y] for z, y in zip(s.tolist(), w.tolist(), strict=True)])
            pairs, which = np.unique(np.stack([place, number]), axis=1, return_inverse=True)
            raw, known = part.tobytes(), self.windows.vocabulary
            same = np.array([raw[starts[x] : ends[x]] == known[y] for x, y in pairs.T.tolist()], bool)[which.ravel()]
            keep = np.logical_and.reduceat(same, np.append(0, np.cumsum(s))[:-1])
            b, s, w = b[keep], s[keep], w[keep]
        return b, s, w


_ROW = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])


def _matcher(shared, chained: bool):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the words of each row, [start, end) of those hit, flat, and item ids."""
        index: Index = shared.value
        for batch in batches:
            n_words = np.zeros(batch.num_rows, np.int64)
            before = batch.column("_found").to_pylist() if chained else [None] * batch.num_rows
            spans: list[list[int]] = [list(x["spans"]) if x else [] for x in before]
            items: list[set] = [set(x["items"]) if x else set() for x in before]
            for i, j, part, starts, ends, first, words in _documents(batch.column("text")):
                n_words[i:j] = np.diff(first)
                b, s, w = index.occurrences(part, starts, ends, first, words)
                if not len(b):
                    continue
                row = np.searchsorted(first, b, "right") - 1
                for r, x, z, y in zip(row.tolist(), b.tolist(), s.tolist(), w.tolist(), strict=True):
                    lo = x - int(first[r])
                    spans[i + r] += [lo, lo + z]
                    items[i + r].update(index.windows.items_of(z, y))
            merged = [_union(x) for x in spans]
            found = pa.StructArray.from_arrays([pa.array(n_words), pa.array(merged, pa.list_(pa.int64())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], ["n_words", "spans", "items"])
            cols = batch.columns[: -1 if chained else None]
            yield pa.record_batch([*cols, found], [*batch.schema.names[: len(cols)], "_found"])

    return match


def _union(flat: list[int]) -> list[int]:
    """Sorted disjoint intervals of flat [start, end, ...]."""
    out: list[int] = []
    for lo, hi in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if out and lo <= out[-1]:
            out[-1] = max(out[-1], hi)
        else:
            out += [lo, hi]
    return out


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = batch.column(1).to_pylist()
        n = [x["n_words"] for x in found]
        hit = [sum(x["spans"][1::2]) - sum(x["spans"][::2]) for x in found]
        yield pa.record_batch(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x["items"]) for x in found], pa.int64()), pa.array([hashlib.sha256(",".join(x["items"]).encode()).hexdigest() for x in found]), pa.array([h > 0 and SHARE * h >= w for h, w in zip(hit, n, strict=True)])],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def annotate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (with a column text) and a struct column _found: n_words, spans (flat start, end
    of disjoint runs of hit words) and the sorted ids of items with occurring windows."""
    spark = docs.sparkSession
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item_id")), F.lit(0))).first()[0]
    blocks, before = max(1, -(-size // block_bytes)), None
    for block in range(blocks):
        # about block_bytes of text, as checked above
        part = bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else bench
        windows = Windows([(r.item_id, r.text) for r in part.collect()])
        known = windows.all_shingles()
        counts = {k: np.zeros(len(h), np.int64) for k, h in known.items()}
        if known:
            told = docs.select("text").mapInArrow(_rarity(spark.sparkContext.broadcast(known)), "k long, at long, n long")
            got = told.groupBy("k", "at").agg(F.sum("n").alias("n")).toArrow()  # one row a shingle of the block at most
            for k, at, n in zip(*(got.column(c).to_pylist() for c in ("k", "at", "n")), strict=True):
                counts[k][at] = n
        shared = spark.sparkContext.broadcast(Index(windows, known, counts))
        schema = T.StructType([*[f for f in docs.schema.fields if f.name != "_found"], T.StructField("_found", _ROW)])
        docs = docs.mapInArrow(_matcher(shared, block > 0), schema)
        if block + 1 < blocks:
            docs = materialize(docs, "decontamination")
            if before is not None:
                discard(before)
            before = docs
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = annotate(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "_found")
    long = T.LongType()
    return found.mapInArrow(_digest, read_schema(("doc_id", found.schema["doc_id"].dataType), ("n_words", long), ("n_hit", long), ("n_items", long), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType())))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated."""
    wide = docs.select(F.col("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    hit = F.expr("aggregate(transform(_found.spans, (x, i) -> IF(i % 2 = 1, x, -x)), 0L, (a, x) -> a + x)")
    found = annotate(wide, benchmark).withColumn("_hit", hit)
    return found.filter(~((F.col("_hit") > 0) & (F.col("_hit") * SHARE >= F.col("_found.n_words")))).select("_row.*")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def sql(columns: str, source: str = "documents") -> str:
    """DuckDB SQL of the hits; `columns` picks from the source's columns, n_words, n_hit,
    n_items, items_sha256 and contaminated."""
    return f"""
WITH dd AS (SELECT *, row_number() OVER () AS rid FROM {source}),
dw AS (SELECT rid, {_WORDS} AS ws FROM dd),
bw AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS ws FROM benchmark),
bwin AS (
  SELECT DISTINCT item, n, array_to_string(ws[i + 1:i + n], ' ') AS s
  FROM (SELECT item, ws, least(13, len(ws)) AS n, unnest(range(0, len(ws) - least(13, len(ws)) + 1)) AS i FROM bw WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bwin),
dwin AS (
  SELECT rid, n, i, array_to_string(ws[i + 1:i + n], ' ') AS s
  FROM (SELECT rid, ws, n, unnest(range(0, len(ws) - n + 1)) AS i FROM dw, sizes WHERE len(ws) >= n)),
occ AS (SELECT d.rid, d.n, d.i, b.item FROM dwin d JOIN bwin b ON d.s = b.s AND d.n = b.n),
hits AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM occ) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM occ) GROUP BY rid),
v AS (
  SELECT dd.*, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
  FROM dd JOIN dw USING (rid) LEFT JOIN hits USING (rid) LEFT JOIN its USING (rid))
SELECT {columns} FROM v"""


QUERIES = {"op9_decontamination": op9_decontamination}
ORACLE = {"op9_decontamination": sql("doc_id, n_words, n_hit, n_items, items_sha256, contaminated")}
