"""Quality classifier: a byte-level convolutional network in numpy.

The input of a position is its byte and whether the four bytes that end there have just
been seen (a plane that shows repetition). Learned filters of four positions run over
the whole text; their rectified outputs are averaged over chunks of 256 positions
that overlap by three quarters, a hidden layer reads each chunk, its units are max-pooled
and mean-pooled over all chunks of the document, and one logistic unit combines them.

The network is trained here on a bounded sample of labelled rows (TRAIN_ROWS rows and
TRAIN_BYTES bytes at most, no text of more than TEXT_BYTES) in the order of their hashed ids, with fixed
seeds, so reruns agree; sizes are summed up before any text is fetched.
Its parameters take less than 200 kB.

Defined results: null and empty text have no chunk and get the score of the final bias; rows
are scored one by one, so repeated rows get equal scores; labels that are null are not used, and
without any label every score is 0.5; an empty table gives an empty result; further columns
are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import pieces, read_schema, table, text_buffer

FILTERS, WIDTH, HIDDEN = 16, 4, 16
#: Positions of a segment; segments of a chunk, which begins at every segment.
SEGMENT, SEGMENTS = 64, 4
#: Distances at which four bytes count as seen before.
LAGS = range(2, 33)
SYMBOLS, PAD = 513, 512
FOLDS, THRESHOLD = 5, 0.3
#: Bounds of the training sample: rows, bytes of one text, bytes of all.
TRAIN_ROWS, TEXT_BYTES, TRAIN_BYTES = 3000, 1_500_000, 12_000_000
#: Bytes that are scored together; a longer text is convolved by pieces of so many positions.
PIECE_BYTES = 500_000


def symbols(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Input symbols of rows, each padded behind by WIDTH - 1, and where rows begin."""
    n = np.diff(at)
    begin = np.append(0, np.cumsum(n + WIDTH - 1))
    row = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(buf)) - at[:-1][row]
    code = buf.astype(np.uint32)
    four = np.zeros(len(buf), np.uint32)
    four[3:] = code[3:] | code[2:-1] << 8 | code[1:-2] << 16 | code[:-3] << 24
    seen = np.zeros(len(buf), bool)
    for lag in LAGS:
        seen[lag:] |= (four[lag:] == four[:-lag]) & (within[lag:] >= lag + 3)
    out = np.full(begin[-1], PAD, np.uint16)
    out[within + begin[:-1][row]] = buf + np.uint16(256) * seen
    return out, begin


class Layout:
    """Positions, segments and chunks of rows of n positions each."""

    def __init__(self, n: np.ndarray, begin: np.ndarray, positions: bool = True):
        segments = -(-n // SEGMENT)
        chunks = np.where(segments > 0, np.maximum(segments - SEGMENTS + 1, 1), 0)
        self.first_segment = np.append(0, np.cumsum(segments))
        row = np.repeat(np.arange(len(n)), segments)
        within = np.arange(len(row)) - self.first_segment[:-1][row]
        self.start = begin[:-1][row] + within * SEGMENT
        self.length = np.minimum(SEGMENT, n[row] - within * SEGMENT)
        if positions:
            self.position = np.repeat(self.start - np.append(0, np.cumsum(self.length))[:-1], self.length) + np.arange(self.length.sum())
            self.position_first = np.append(0, np.cumsum(self.length))
        self.first_chunk = np.append(0, np.cumsum(chunks))
        self.chunk_row = np.repeat(np.arange(len(n)), chunks)
        inside = np.arange(len(self.chunk_row)) - self.first_chunk[:-1][self.chunk_row]
        self.lo = self.first_segment[:-1][self.chunk_row] + inside
        self.hi = np.minimum(self.lo + SEGMENTS, self.first_segment[1:][self.chunk_row])
        sizes = np.append(0, np.cumsum(self.length))
        self.chunk_size = (sizes[self.hi] - sizes[self.lo]).astype(np.float32)[:, None]
        self.filled = np.flatnonzero(chunks > 0)


class Network:
    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        f32 = np.float32
        self.p = {
            "conv": (r.normal(0, 0.3, (WIDTH, SYMBOLS, FILTERS))).astype(f32),
            "conv_bias": np.zeros(FILTERS, f32),
            "hidden": r.normal(0, 0.5, (FILTERS, HIDDEN)).astype(f32),
            "hidden_bias": np.zeros(HIDDEN, f32),
            "max": r.normal(0, 0.3, HIDDEN).astype(f32),
            "mean": r.normal(0, 0.3, HIDDEN).astype(f32),
            "bias": np.zeros(1, f32),
        }

    def features(self, s: np.ndarray, lay: Layout, keep: bool = False):
        """Chunk means of the rectified filters."""
        conv = self.p["conv"]
        out = conv[0][s[lay.position]]
        for j in range(1, WIDTH):
            out += conv[j][s[lay.position + j]]
        out += self.p["conv_bias"]
        np.maximum(out, 0, out=out)
        per_segment = np.add.reduceat(out, lay.position_first[:-1], axis=0) if len(out) else np.zeros((0, FILTERS), np.float32)
        total = np.vstack([np.zeros((1, FILTERS)), np.cumsum(per_segment, axis=0, dtype=np.float64)])
        mean = ((total[lay.hi] - total[lay.lo]) / lay.chunk_size).astype(np.float32)
        return mean, out if keep else None

    def long_features(self, buf: np.ndarray, lay: Layout, piece: int) -> np.ndarray:
        """The chunk means of one long text, convolved piece by piece: what is held of the
        whole text is one sum for each segment."""
        n, margin = len(buf), LAGS[-1] + WIDTH
        sums = []
        for lo in range(0, n, piece):
            hi, ahead = min(lo + piece, n), max(0, lo - margin)
            s, _ = symbols(buf[ahead : hi + WIDTH - 1], np.array([0, min(hi + WIDTH - 1, n) - ahead]))
            part = s[lo - ahead :]
            out = self.p["conv"][0][part[: hi - lo]]
            for j in range(1, WIDTH):
                out += self.p["conv"][j][part[j : j + hi - lo]]
            out += self.p["conv_bias"]
            np.maximum(out, 0, out=out)
            sums.append(np.add.reduceat(out, np.arange(0, hi - lo, SEGMENT), axis=0))
        total = np.vstack([np.zeros((1, FILTERS)), np.cumsum(np.concatenate(sums), axis=0, dtype=np.float64)])
        return ((total[lay.hi] - total[lay.lo]) / lay.chunk_size).astype(np.float32)

    def pool(self, mean: np.ndarray, lay: Layout, n: int):
        h = np.tanh(mean * np.float32(8) @ self.p["hidden"] + self.p["hidden_bias"])
        top, avg = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        if len(h):
            begins = lay.first_chunk[:-1][lay.filled]
            top[lay.filled] = np.maximum.reduceat(h, begins, axis=0)
            avg[lay.filled] = np.add.reduceat(h, begins, axis=0) / np.diff(lay.first_chunk)[lay.filled][:, None]
        return h, top, avg

    def logits(self, top: np.ndarray, avg: np.ndarray) -> np.ndarray:
        return top @ self.p["max"] + avg @ self.p["mean"] + self.p["bias"]

    def score(self, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Probability of label 1 of every row."""
        if len(at) == 2 and len(buf) > PIECE_BYTES:
            lay = Layout(np.diff(at), at, positions=False)
            mean = self.long_features(buf, lay, PIECE_BYTES // SEGMENT * SEGMENT)
        else:
            s, begin = symbols(buf, at)
            lay = Layout(np.diff(at), begin)
            mean, _ = self.features(s, lay)
        _, top, avg = self.pool(mean, lay, len(at) - 1)
        return 1 / (1 + np.exp(-np.clip(self.logits(top, avg).astype(np.float64), -60, 60)))

    def gradients(self, s: np.ndarray, lay: Layout, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss of some rows."""
        n, p = len(y), self.p
        mean, act = self.features(s, lay, keep=True)
        h, top, avg = self.pool(mean, lay, n)
        d = ((1 / (1 + np.exp(-self.logits(top, avg))) - y) / n).astype(np.float32)
        g = {"max": top.T @ d, "mean": avg.T @ d, "bias": d.sum(keepdims=True)}
        many = np.diff(lay.first_chunk)[lay.chunk_row][:, None]
        d_h = d[lay.chunk_row][:, None] * p["mean"] / many
        # to the first chunk that has a unit's maximum
        is_top = h == top[lay.chunk_row]
        for u in range(HIDDEN):
            c = np.flatnonzero(is_top[:, u])
            rows, first = np.unique(lay.chunk_row[c], return_index=True)
            d_h[c[first], u] += d[rows] * p["max"][u]
        d_z = d_h * (1 - h * h)
        g["hidden"], g["hidden_bias"] = (mean * 8).T @ d_z, d_z.sum(axis=0)
        d_mean = (d_z @ p["hidden"].T) * 8 / lay.chunk_size
        step = np.zeros((len(lay.length) + 1, FILTERS))
        np.add.at(step, lay.lo, d_mean)
        np.add.at(step, lay.hi, -d_mean)
        d_segment = np.cumsum(step[:-1], axis=0)
        d_act = np.repeat(d_segment, lay.length, axis=0) * (act > 0)
        g["conv_bias"] = d_act.sum(axis=0)
        g["conv"] = np.zeros((WIDTH, SYMBOLS, FILTERS))
        for j in range(WIDTH):
            at = s[lay.position + j]
            for f in range(FILTERS):
                g["conv"][j, :, f] = np.bincount(at, d_act[:, f], SYMBOLS)
        return g

    def train(self, texts: list[bytes], y: np.ndarray, epochs: int = 4, batch: int = 32, rate: float = 0.01, seed: int = 2) -> None:
        """Adam on batches in a fixed random order."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v, dtype=np.float64) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in m.items()}
        t = 0
        steps = epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for i in range(0, len(order), batch):
                rows = order[i : i + batch]
                at = np.append(0, np.cumsum([len(texts[k]) for k in rows]))
                buf = np.frombuffer(b"".join(texts[k] for k in rows), np.uint8)
                s, begin = symbols(buf, at)
                g = self.gradients(s, Layout(np.diff(at), begin), y[rows])
                t += 1
                lr = rate * (1 - (t - 1) / steps)
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, text_bytes: int = TEXT_BYTES, most_bytes: int = TRAIN_BYTES) -> list[tuple[bytes, int]]:
    """At most `rows` labelled texts that are not held out, in the order of hashed ids, while they fit
    into most_bytes."""
    own = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0
    order = [F.xxhash64("doc_id"), "doc_id", "quality"]
    some = labels.filter("quality IN (0, 1)").select("doc_id", "quality").filter(own).orderBy(*order).limit(rows).select(F.col("doc_id").alias("_id"), "quality")
    # sizes first: `rows` numbers reach the driver, and then most_bytes of text at most
    sized = docs.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    sized = sized.join(F.broadcast(some), F.col("doc_id") == F.col("_id")).filter(F.col("size") <= text_bytes).select("doc_id", "quality", "h", "size")
    chosen, left = {}, most_bytes
    for r in sized.orderBy(*order, "h").limit(rows).collect():
        if (r.doc_id, r.h) in chosen:
            chosen[r.doc_id, r.h].append(r.quality)
        elif r.size <= left:
            left -= r.size
            chosen[r.doc_id, r.h] = [r.quality]
    if not chosen:
        return []
    keys = docs.sparkSession.createDataFrame(list(chosen), T.StructType([T.StructField("_id", docs.schema["doc_id"].dataType), T.StructField("_h", T.LongType())]))
    found = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(F.broadcast(keys), (F.col("doc_id") == F.col("_id")) & (F.col("h") == F.col("_h")))
    found = found.dropDuplicates(["doc_id", "h"]).select("doc_id", "h", "text").collect()
    got = [(zlib.crc32(str(r.doc_id).encode()), r.doc_id, q, r.text or "") for r in found for q in chosen[r.doc_id, r.h]]
    return [(text.encode(), q) for _, _, q, text in sorted(got)]


def train_network(sample: list[tuple[bytes, int]]) -> Network:
    net = Network()
    if sample:
        net.train([t for t, _ in sample], np.array([q for _, q in sample], np.float32))
    return net


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""
    docs = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(train_network(training_sample(docs, labels)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            buf, at = text_buffer(batch.column(1))
            score = np.full(batch.num_rows, 0.5)
            for i, j, part, off in pieces(buf, at, PIECE_BYTES):
                score[i:j] = net.score(part, off)
            held = [zlib.crc32(("" if x is None else str(x)).encode()) % FOLDS == 0 for x in batch.column(0).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(held, pa.bool_()), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.mapInArrow(run, read_schema(("doc_id", docs.schema["doc_id"].dataType), ("held_out", T.BooleanType()), ("score", T.DoubleType()), ("predicted", T.IntegerType())))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op4_quality_classifier": op4_quality_classifier}
