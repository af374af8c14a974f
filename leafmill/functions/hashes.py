"""Digests, content-defined chunks and similarity fingerprints."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
# Fixed values of the 64-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def dedup_groups(df: DataFrame, key: str, content: Column) -> DataFrame:
    """canonical (least key) and copies of each distinct content; who belongs to it is told by
    dedup_members, so that no content needs a list of all its copies."""
    return df.select(F.col(key).alias("_k"), F.sha2(content, 256).alias("_h")).groupBy("_h").agg(F.min("_k").alias("canonical"), F.count("*").alias("copies")).drop("_h")


def dedup_members(df: DataFrame, key: str, content: Column) -> DataFrame:
    """Every key with the least key of equal content. Only digests are shuffled; a content that
    very many rows have is one row of the smaller side, so that a skewed join can be split."""
    d = df.select(F.col(key), F.sha2(content, 256).alias("_h"))
    least = d.groupBy("_h").agg(F.min(key).alias("canonical")).withColumnRenamed("_h", "_g")
    return d.join(least, F.col("_h").eqNullSafe(F.col("_g"))).select(key, "canonical")


def fingerprints(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, fp) with a 64-bit fingerprint: each lower-cased word votes with the first eight
    bytes of its SHA-256, and a tie sets the bit. A text is one row and nothing is shuffled;
    a word is hashed once for all texts of a batch that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        hashes: list[int] = []
        for batch in batches:
            fp = np.zeros(batch.num_rows, np.uint64)
            for i, t in enumerate(batch.column(1)):
                words = _WORD.findall((t.as_py() or "").translate(_LOWER))
                counted = Counter(words)
                which = []
                for w in counted:
                    k = known.get(w)
                    if k is None:
                        k = known[w] = len(hashes)
                        hashes.append(int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "big"))
                    which.append(k)
                v = np.array([hashes[k] for k in which], ">u8")
                n = np.fromiter(counted.values(), np.int64, len(counted))
                ones = np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1).T.astype(np.int64) @ n
                fp[i] = np.packbits(2 * ones >= n.sum()).view(">u8")[0]
            if len(known) > 500_000:
                known, hashes = {}, []
            yield pa.record_batch([batch.column(0), pa.array(fp.view(np.int64))], [key, "fp"])

    src = df.select(key, text)
    return src.mapInArrow(run, f"{key} {src.schema[key].dataType.simpleString()}, fp long")


def distance(a: Column, b: Column) -> Column:
    """Differing bits of two fingerprints."""
    return F.bit_count(a.bitwiseXOR(b))


def fnv1a(data: bytes) -> int:
    h = FNV_OFFSET
    for byte in data:
        h = ((h ^ byte) * FNV_PRIME) & (2**64 - 1)
    return h


def fnv1a_hex():
    """The 64-bit FNV-1a hash of a string column's UTF-8, in hex."""

    @F.arrow_udf("string")
    def told(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else f"{fnv1a(t.encode()):016x}" for t in text.to_pylist()], pa.string())

    return told


def content_chunks(df: DataFrame, key: str, content: str, least: int = 128, average: int = 256, most: int = 512) -> DataFrame:
    """Content-defined chunks of a text or binary column: key, offset, length, sha256. A cut
    falls behind a byte whose 32-byte rolling sum of random weights has its low bits clear, between
    `least` and `most` bytes; so an insertion moves only the cuts around it."""
    weights = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64)
    mask = np.uint64((1 << (average.bit_length() - 1)) - 1)

    def cut(data: bytes) -> list[int]:
        if not data:
            return []
        total = np.cumsum(weights[np.frombuffer(data, np.uint8)])
        rolled = total.copy()
        rolled[32:] -= total[:-32]
        good = np.flatnonzero(((rolled >> np.uint64(20)) & mask) == 0) + 1
        ends, at = [], 0
        while at < len(data):
            k = np.searchsorted(good, at + least)
            end = int(good[k]) if k < len(good) and good[k] <= at + most else at + most
            ends.append(at := min(end, len(data)))
        return ends

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = batch.column(0).to_pylist(), []
            for k, value in zip(keys, batch.column(1).to_pylist(), strict=True):
                data = value.encode() if isinstance(value, str) else value or b""
                at = 0
                for end in cut(data):
                    rows.append((k, at, end - at, hashlib.sha256(data[at:end]).hexdigest()))
                    at = end
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (batch.column(0).type, pa.int64(), pa.int64(), pa.string()), strict=True)], [key, "offset", "length", "sha256"])

    src = df.select(key, content)
    return src.mapInArrow(run, f"{key} {src.schema[key].dataType.simpleString()}, offset long, length long, sha256 string")
