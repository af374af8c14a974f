"""Token counts by rank-synchronous array merging.

The vocabulary is a byte-pair encoding with byte fallback. No piece holds a space mark
after another character, so merges never cross from a word to the space behind it: a
text falls into pre-tokens (one space mark and a word) and runs of further space marks.
The distinct pre-tokens of a batch are held as ragged arrays of symbols; in every round
each sequence's pair of lowest rank is merged, in all sequences at once, until no pair
has a rank; the symbols that survive are counted (a character without a piece counts its
UTF-8 bytes). Counts of words are kept in a bounded cache.

Defined results: null and empty text have no tokens; rows are counted one by one, so
repeated rows do not matter; a very long text is one row of a batch and costs n log n at
most per distinct word; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ._shared import byte_set, pieces, read_schema, table, text_buffer, word_spans, words_array

MODEL, LIMIT = "piece_bpe_32k.model", 4096
SPACE = "▁"
NOT_SPACE = ~byte_set((0x20, 0x20))
#: Words whose counts a worker remembers.
CACHE = 400_000
_NONE = np.int64(2**62)


class Merges:
    """The merge table of a model as sorted arrays."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        score = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        if any(SPACE in p.strip(SPACE) or p.endswith(SPACE) and p.strip(SPACE) for p in score):
            raise ValueError("a piece goes on behind a space: pre-tokens don't hold for this model")
        self.runs = {len(p): s for p, s in score.items() if not p.strip(SPACE)}
        words = {p: s for p, s in score.items() if p.strip(SPACE)}
        if any(p.startswith(SPACE * 2) for p in words):
            raise ValueError("a piece has two spaces and a word: pre-tokens don't hold for this model")
        if any(max(self.runs.values()) >= s for s in words.values() if s is not None) and len(self.runs) > 1:
            raise ValueError("runs of spaces would merge before words")
        chars = sorted({c for p in words for c in p} | {SPACE})
        symbol = {c: i for i, c in enumerate(chars)}
        for p in words:
            symbol.setdefault(p, len(symbol))
        self.n = n = len(symbol)
        rank = {p: r for r, p in enumerate(sorted(words, key=lambda p: -words[p]))}
        pairs = {}
        for p in words:
            for k in range(1, len(p)):
                l, r = symbol.get(p[:k]), symbol.get(p[k:])
                if l is not None and r is not None:
                    pairs[l * n + r] = (rank[p], symbol[p])
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        # symbols that could at once be merged further, before their own pair's other places
        own = np.full(n, -1, np.int64)
        for p, r in rank.items():
            own[symbol[p]] = r
        self.eager = np.zeros(n, bool)
        for side in (self.keys // n, self.keys % n):
            self.eager[side[own[side] > self.rank]] = True
        self.of_char = np.full(0x110000, -1, np.int64)
        self.of_char[[ord(c) for c in chars]] = np.arange(len(chars))
        # a character that only occurs inside pieces is no piece itself
        self.no_piece = np.zeros(n, bool)
        self.no_piece[[symbol[c] for c in chars if c not in score]] = True
        self.space = symbol[SPACE]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = np.where((left >= 0) & (right >= 0), left * self.n + right, -1)
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = self.keys[place] == key
        return np.where(known, self.rank[place], _NONE), self.made[place]

    def run(self, k: int) -> int:
        """Tokens of a run of k spaces: equal scores merge from the left."""
        if k <= 256:
            return _run(tuple(sorted(self.runs.items())), k)
        longest = max(self.runs)
        whole = (k - 128) // longest
        return whole + _run(tuple(sorted(self.runs.items())), k - whole * longest)

    def count(self, words: list[str]) -> list[tuple[int, bool]]:
        """For each word behind a space mark: tokens, and whether the mark stays alone."""
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        first = np.append(0, np.cumsum(lengths))
        code = np.frombuffer((SPACE + SPACE.join(words)).encode("utf-32-le"), np.uint32)
        sym, of = self.of_char[code], np.repeat(np.arange(len(words)), lengths)
        size = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
        size[first[:-1]] = 1
        weight = np.where((sym < 0) | self.no_piece[np.maximum(sym, 0)], size, 1)
        total, alone = np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        while len(sym):
            rank, made = self.ranks(sym[:-1], sym[1:])
            rank[of[:-1] != of[1:]] = _NONE
            rank = np.append(rank, _NONE)
            begins = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            least = np.minimum.reduceat(rank, begins)
            span = np.diff(np.append(begins, len(sym)))
            done = np.repeat(least == _NONE, span)
            if done.any():
                total += np.bincount(of[done], weight[done], len(words)).astype(np.int64)
                ended = begins[least == _NONE]
                alone[of[ended]] = sym[ended] == self.space
            merge = (rank == np.repeat(least, span)) & ~done
            at = np.flatnonzero(merge)
            # of places that overlap every other one is merged, from the left
            head = np.append(True, at[1:] != at[:-1] + 1)[: len(at)]
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            at = at[nth % 2 == 0]
            leftmost = np.append(True, of[at][1:] != of[at][:-1])[: len(at)]
            at = at[leftmost | ~self.eager[made[at]]]
            sym[at], weight[at] = made[at], 1
            keep = ~done
            keep[at + 1] = False
            sym, of, weight = sym[keep], of[keep], weight[keep]
        return list(zip(total.tolist(), alone.tolist(), strict=True))


@functools.lru_cache(maxsize=4096)
def _run(scores: tuple, k: int) -> int:
    score = dict(scores)
    size, after = [1] * k, list(range(1, k + 1))
    before, heap = list(range(-1, k - 1)), []

    def offer(i: int) -> None:
        j = after[i]
        if j < k and size[i] + size[j] in score:
            heapq.heappush(heap, (-score[size[i] + size[j]], i, size[i], size[j]))

    for i in range(k - 1):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if size[i] else k
        if j >= k or size[i] != a or size[j] != b:
            continue
        size[i], size[j], after[i] = a + b, 0, after[j]
        if after[i] < k:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return sum(s > 0 for s in size)


@functools.lru_cache(maxsize=2)
def _merges(path: str) -> tuple[Merges, dict]:
    return Merges(path), {}


def count_tokens(col: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and tokens of every text of a string column."""
    merges, cache = _merges(path)
    n_bytes = np.diff(text_buffer(col)[1])
    if pc.any(pc.match_substring(col, SPACE)).as_py():  # the mark itself is a space
        col = pc.replace_substring(col, SPACE, " ")
    buf, offsets = text_buffer(col)
    tokens = np.zeros(len(col), np.int64)
    for i, j, part, off in pieces(buf, offsets):
        starts, ends, first = word_spans(part, off, NOT_SPACE)
        words = np.diff(first)
        row = np.repeat(np.arange(j - i), words)
        # spaces before each word; a text begins with one more
        prior = np.append(0, ends[:-1])[: len(starts)]
        opening = np.zeros(len(starts), bool)
        opening[first[:-1][words > 0]] = True
        prior = np.where(opening, off[:-1][row] - 1, prior)
        gap = starts - prior
        last = np.where(words > 0, ends[np.maximum(first[1:] - 1, 0)] if len(ends) else 0, off[:-1] - 1)
        tail = np.where(off[1:] > off[:-1], off[1:] - last, 0)
        if len(starts):
            coded = words_array(part, starts, ends).dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            if len(cache) > CACHE:
                cache.clear()
            new = [w for w in distinct if w not in cache]
            if new:
                cache.update(zip(new, merges.count(new), strict=True))
            found = np.array([cache[w] for w in distinct], np.int64)[coded.indices.to_numpy()]
            extra = gap - 1 + found[:, 1]
            each = found[:, 0] - found[:, 1] + _runs(merges, extra)
            tokens[i:j] += np.bincount(row, each, j - i).astype(np.int64)
        tokens[i:j] += _runs(merges, tail)
    return n_bytes, tokens


def _runs(merges: Merges, k: np.ndarray) -> np.ndarray:
    values, inverse = np.unique(k, return_inverse=True)
    return np.array([merges.run(v) if v else 0 for v in values.tolist()], np.int64)[inverse]


def count_documents(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, tokens = count_tokens(batch.column(1), path)
            yield pa.record_batch([batch.column(0), pa.array(n_bytes), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(count, read_schema(("doc_id", docs.schema["doc_id"].dataType), ("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))


QUERIES = {"op5_token_counts": op5_token_counts}
