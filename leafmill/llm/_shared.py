"""Helpers shared by the training-data operators: vectorised word finding over
UTF-8 buffers, and tables that cut lineage in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text is handled in pieces of about so many bytes, whole documents at a time.
CHUNK_BYTES = 2_000_000
#: Java pattern of one run of ASCII white space, as the contracts define it.
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only if it is unset and Spark is
    local as well."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='leafmill-checkpoints-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: a lost executor
    costs a re-read and never the whole lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize that no plan still reads."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Lookup table: True for bytes in any of the closed ranges."""
    lut = np.zeros(256, bool)
    for lo, hi in ranges:
        lut[lo : hi + 1] = True
    return lut


#: Bytes of a word: all but space and 09-0D.
WORD = ~byte_set((0x20, 0x20), (0x09, 0x0D))
#: Identity but for A-Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets; nulls have no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    at = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    if data is None or not len(at):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(buf: np.ndarray, at: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut rows into pieces of about `size` bytes, one row at least:
    (first row, end row, bytes, offsets of the piece)."""
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        j = min(j, n)
        yield i, j, buf[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def word_spans(buf: np.ndarray, at: np.ndarray, lut: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, which never cross rows, and the first word of each
    row (one entry more than rows)."""
    inside = lut[buf]
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    first = np.zeros(len(buf) + 1, bool)
    first[at] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def words_array(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words as an Arrow string array."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    keep = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(buf[keep]))])


_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier modulo 2**64, and of its inverse."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        out = []
        for base in (_STEP[which], pow(_STEP[which], -1, 2**64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if n > 8 * CHUNK_BYTES:
            return out[0], out[1]
        _POWERS[which] = have = (out[0], out[1])
    return have


def mixed(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit polynomial hash of each word's bytes."""
    up, down = _powers(which, len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of every k consecutive words; neighbours in the array may belong to
    different rows, which the caller masks."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    step = np.uint64(_STEP[which])
    for j in range(k):
        out *= step
        out += words[j : j + n]
    return mixed(out)


#: Most bits of a bitmap: 128 MB. A full one lets more through, and is never wrong.
MOST_BITS = 30


def bitmap(hashes: DataFrame) -> np.ndarray:
    """A bit for each hash (a column h), in 8 kB pages built by the executors; 2**30 bits at most."""
    n = hashes.count()
    bits = min(MOST_BITS, max(16, (16 * max(n, 1) - 1).bit_length()))
    page = F.shiftright("h", 16).bitwiseAND(F.lit(2 ** (bits - 16) - 1))

    def build(t: pa.Table) -> pa.Table:
        out = np.zeros(8192, np.uint8)
        low = t.column("low").to_numpy()
        np.bitwise_or.at(out, low >> 3, (1 << (low & 7)).astype(np.uint8))
        return pa.table({"page": t.column("page").slice(0, 1), "bits": pa.array([out.tobytes()], pa.binary())})

    paged = hashes.select(page.cast("long").alias("page"), F.col("h").bitwiseAND(F.lit(0xFFFF)).cast("long").alias("low")).distinct()
    got = paged.groupBy("page").applyInArrow(build, read_schema(("page", T.LongType()), ("bits", T.BinaryType()))).toArrow()
    out = np.zeros((2 ** (bits - 16), 8192), np.uint8)
    for p, b in zip(got.column("page").to_pylist(), got.column("bits").to_pylist(), strict=True):
        out[p] = np.frombuffer(b, np.uint8)
    return out.reshape(-1)


def may_contain(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """False for hashes that surely are not in the bitmap."""
    low = hashes & np.uint64(len(bits) * 8 - 1)
    return (bits[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


def in_bitmap(shared):
    """may_contain as a function of a long column, by a bitmap that was sent out. Only the hashes
    go through Python, whatever else a row has."""

    @F.arrow_udf("boolean")
    def sent(h: pa.Array) -> pa.Array:
        return pa.array(may_contain(shared.value, h.to_numpy(zero_copy_only=False).view(np.uint64)))

    return sent


def read_schema(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in cols])
