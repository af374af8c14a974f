"""Substring dedup with repeated-phrase automata.

1. Every document is scanned for minimizers: of the nine 5-word grams of each 13-word
   window the one with the least hash. Equal windows have equal minimizers, so a
   window can only recur if its minimizer does. Minimizers seen in two documents are
   found by one aggregation with map-side combine and kept as a bitmap whose size is
   chosen by their number and never above 2**30 bits; a full bitmap only lets more
   windows through to the next step.
2. Runs of windows whose minimizer is in the bitmap leave their documents as segments. Segments
   are dealt to shards of about equal size by their least minimizer, so that copies of a
   passage meet as far as the size allows, and each shard's distinct windows are confirmed by
   96 bits of hashes: a window recurs if it starts in two documents, and its owner is
   the smallest of them.
3. A shard's confirmed windows are handed over as places of words there. Consecutive ones are a
   passage, of which blocks of seven words are compiled into Aho-Corasick automata over word
   numbers: one block in each window at least, the rarest of its blocks, so that a common phrase does not
   stand for many passages. The segments of all documents are streamed through them, and each block that is
   found is extended word by word to the confirmed windows around it, which locates every occurrence.
   An occurrence in a document with a larger id than the owner's is removed. Words outside of segments
   cannot be part of one.

No step collects a group: a passage that a third of all documents share costs each
shard one pattern.

Defined results: null text has no words, and its text stays null; fewer than 13 words are
never removed; rows with equal doc_id count as one document when windows are judged
(none of them removes from another) and each gets its own result; a null doc_id owns
nothing and loses nothing; an empty table gives an empty result; further columns are
kept by `dedup_substrings`, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import bitmap, discard, gram_hashes, in_bitmap, materialize, may_contain, mixed, pieces, read_schema, table, text_buffer, word_hashes, word_spans, words_array

WINDOW, GRAM, BLOCK = 13, 5, 7
#: Bytes of text in a shard; phrases in one automaton; found phrases looked at together.
SHARD_BYTES, PATTERNS, HITS = 4_000_000, 50_000, 50_000
#: A block of words stands for confirmed windows if it comes in fewer places of them than this.
MOST_PLACES = 32


def _minimizers(words: np.ndarray, row_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all grams; windows that lie in one row; the gram that stands for each."""
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = gram_hashes(words, GRAM)
    least, at = grams[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, WINDOW - GRAM + 1):
        here = grams[j : j + n]
        less = here < least
        least[less] = here[less]
        at[less] = j
    windows = np.flatnonzero(row_of[:n] == row_of[WINDOW - 1 : WINDOW - 1 + n])
    return grams, windows, windows + at[windows]


def _scanned(col: pa.Array) -> Iterator[tuple]:
    """For each piece of a text column: rows, bytes, word spans, word hashes, row of each word."""
    buf, at = text_buffer(col)
    for i, j, part, off in pieces(buf, at):
        starts, ends, first = word_spans(part, off)
        row_of = np.repeat(np.arange(j - i), np.diff(first))
        yield i, j, part, starts, ends, first, word_hashes(part, starts, ends), row_of


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _emit_minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for i, j, *_, words, row_of in _scanned(batch.column(1)):
            grams, _, at = _minimizers(words, row_of)
            at = np.unique(at)
            h, doc = grams[at], ids[i:j][row_of[at]]
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            cut = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
            last = np.append(cut[1:], len(h))[: len(cut)] - 1
            yield pa.record_batch([_signed(h[cut]), pa.array(doc[cut]), pa.array(doc[last])], ["h", "least", "most"])


def recurring(docs: DataFrame) -> DataFrame:
    """Hashes of minimizers that occur in two documents or more."""
    long = T.LongType()
    seen = docs.mapInArrow(_emit_minimizers, read_schema(("h", long), ("least", long), ("most", long)))
    return seen.groupBy("h").agg(F.min("least").alias("least"), F.max("most").alias("most")).filter("least < most").select("h")


def _segmenter(shared):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, text, h) -> runs of windows that may recur: doc_id, h, the run's first word,
        its text and a key that its copies share (the least minimizer)."""
        bits = shared.value
        for batch in batches:
            ids, h = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for i, _, part, starts, ends, first, words, row_of in _scanned(batch.column(1)):
                grams, windows, at = _minimizers(words, row_of)
                again = np.flatnonzero(may_contain(bits, grams[at]))
                if not len(again):
                    continue
                w, m = windows[again], grams[at[again]]
                begin = np.flatnonzero(np.append(True, (w[1:] != w[:-1] + 1) | (row_of[w[1:]] != row_of[w[:-1]])))
                lo, hi = w[begin], w[np.append(begin[1:], len(w)) - 1] + WINDOW
                row, raw = row_of[lo], part.tobytes()
                texts = [raw[a:b].decode() for a, b in zip(starts[lo].tolist(), ends[hi - 1].tolist(), strict=True)]
                key = mixed(np.minimum.reduceat(m, begin))
                yield pa.record_batch([pa.array(ids[i + row]), pa.array(h[i + row]), pa.array(lo - first[row]), pa.array(texts, pa.string()), _signed(key)], ["doc_id", "h", "at", "text", "key"])

    return cut


def _ordered(t: pa.Table) -> pa.Table:
    """A shard's segments in one order, whatever order they arrive in: a word's number in it is
    its place."""
    return t.sort_by([("doc_id", "ascending"), ("h", "ascending"), ("at", "ascending")]).combine_chunks()


def _windows(t: pa.Table) -> pa.Table:
    """The distinct windows of a shard's segments: place of the first, its doc_id (the least), and
    whether another document of the shard has it."""
    t = _ordered(t)
    ids, base = t.column("doc_id").to_numpy(), 0
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i, _, part, starts, ends, first, words, row_of in _scanned(t.column("text").combine_chunks()):
        n = len(words) - WINDOW + 1
        if n > 0:
            own = np.flatnonzero(row_of[:n] == row_of[WINDOW - 1 :])
            a, b = _window_hashes(part, starts, ends, words)
            found.append((a[own], b[own], ids[i + row_of[own]], base + own))
        base += len(words)
    a, b, doc, place = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((b, a))  # stable: equal windows stay in the order of doc_id and place
    a, b = a[order], b[order]
    cut = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)])
    last = np.append(cut[1:], len(a))[: len(cut)] - 1
    many = doc[order[cut]] < doc[order[last]]
    text_order = np.argsort(place[order[cut]])
    cut, many = cut[text_order], many[text_order]
    shard = np.full(len(cut), t.column("shard")[0].as_py(), np.int64)
    first = order[cut]
    return pa.table({"shard": pa.array(shard), "place": pa.array(place[first].astype(np.int32)), "a": _signed(a[cut]), "b": pa.array(b[cut].view(np.int32)), "least": pa.array(doc[first]), "many": pa.array(many)})


def _window_hashes(part, starts, ends, words) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of every window: 64 by one hash of its words, 32 by another."""
    second = gram_hashes(word_hashes(part, starts, ends, 1), WINDOW, 1)
    return gram_hashes(words, WINDOW), (second >> np.uint64(32)).astype(np.uint32)


def _encoded(numbers: np.ndarray) -> str:
    """Two characters for each word, of two alphabets: no phrase can be found between words, and
    no state of an automaton has more branches than the root of the vocabulary."""
    base = int(np.sqrt(numbers.max(initial=0) + 1)) + 1
    out = np.empty(2 * len(numbers), np.uint32)
    out[::2], out[1::2] = numbers // base + 1, numbers % base + base + 2
    return out.tobytes().decode("utf-32-le", "surrogatepass")


def _phrases(numbers: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What stands for the windows at some places: blocks of seven words, one in each window at
    least and the rarest of its blocks, so that a common phrase stands for few; and the
    windows whose rarest block is common all the same, which stand for themselves."""
    block = gram_hashes(numbers.astype(np.uint64), BLOCK)
    inside = WINDOW - BLOCK + 1
    used = np.zeros(len(block), bool)
    for o in range(inside):
        used[place + o] = True
    used = np.flatnonzero(used)
    _, which, many = np.unique(block[used], return_inverse=True, return_counts=True)
    cost = np.zeros(len(block), np.int32)
    cost[used] = many[which] * 2 + (used % inside != 0)  # of equals, the one on the grid
    best, at = cost[place], place.copy()
    for o in range(1, inside):
        here = cost[place + o]
        less = here < best
        best[less], at[less] = here[less], place[less] + o
    common = best >= 2 * MOST_PLACES
    return np.unique(at[~common]), place[common]


def matched_windows(numbers: np.ndarray, first: np.ndarray, ids: np.ndarray, place: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Stream rows of words (as numbers) through automata of the phrases of confirmed windows,
    given by their places and owners. True where a window starts that is equal to one of them
    and whose row's id is larger than its owner."""
    n = len(numbers)
    matched = np.zeros(n, bool)
    if not len(place):
        return matched
    row_of = np.repeat(np.arange(len(ids)), np.diff(first))
    owner_at = np.full(n + WINDOW, np.iinfo(np.int64).max)  # of words where no confirmed window begins
    owner_at[place] = owner
    text = _encoded(numbers)
    blocks, whole = _phrases(numbers, place)
    at, size = np.concatenate([blocks, whole]), np.repeat([BLOCK, WINDOW], [len(blocks), len(whole)])
    known: dict[str, int] = {}
    which = np.array([known.setdefault(text[2 * p : 2 * (p + z)], len(known)) for p, z in zip(at.tolist(), size.tolist(), strict=True)], np.int64)
    order = np.argsort(which, kind="stable")
    places, many = at[order], np.bincount(which, minlength=len(known))
    begin, size = np.append(0, np.cumsum(many)), size[order]
    phrases, cuts = list(known), (2 * first).tolist()
    for k in range(0, len(phrases), PATTERNS):
        automaton = ahocorasick.Automaton()
        for x, phrase in enumerate(phrases[k : k + PATTERNS], k):
            automaton.add_word(phrase, x)
        automaton.make_automaton()
        hits: list[tuple[int, int]] = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi - lo >= 2 * WINDOW:
                hits += [((lo + e) // 2, x) for e, x in automaton.iter(text[lo:hi])]
            if len(hits) >= HITS or hi == cuts[-1]:
                if hits:
                    end, x = np.array(hits, np.int64).T
                    _extend(matched, numbers, row_of, ids, owner_at, end, x, begin, places, size)
                hits = []
    return matched


def _extend(matched, numbers, row_of, ids, owner_at, end, which, begin, places, size) -> None:
    """From the last words of found phrases to the confirmed windows around them, word by word."""
    n, many = len(numbers), begin[which + 1] - begin[which]
    entry = np.repeat(begin[which] - np.append(0, np.cumsum(many))[:-1], many) + np.arange(many.sum())
    q, z = places[entry], size[entry]
    t = np.repeat(end, many) - z + 1
    room = WINDOW - BLOCK
    left, right = np.zeros(len(t), np.int64), np.where(z == WINDOW, room, 0)
    open_ = z == BLOCK
    go = open_.copy()
    for k in range(1, room + 1):
        go = go & (t >= k) & (q >= k)
        go &= numbers[t - k * go] == numbers[q - k * go]
        left += go
    go = open_
    for k in range(BLOCK, WINDOW):
        go = go & (t + k < n) & (q + k < n)
        go &= numbers[t + k * go] == numbers[q + k * go]
        right += go
    for s in range(-room, 1):
        m = np.flatnonzero((left >= -s) & (right >= s + room))
        w = t[m] + s
        fits = (row_of[w] == row_of[w + WINDOW - 1]) & (owner_at[q[m] + s] < ids[row_of[w]])
        matched[w[fits]] = True


def _locate(segments: pa.Table, phrases: pa.Table) -> pa.Table:
    """The segments of a shard and its confirmed windows -> runs of words to remove."""
    segments = _ordered(segments)
    ids = segments.column("doc_id").to_numpy()
    buf, at = text_buffer(segments.column("text").combine_chunks())
    starts, ends, first = word_spans(buf, at)
    numbers = words_array(buf, starts, ends).dictionary_encode().indices.to_numpy()
    place = phrases.column("place").to_numpy().astype(np.int64)
    total = np.cumsum(matched_windows(numbers, first, ids, place, phrases.column("owner").to_numpy()))
    total[WINDOW:] -= total[:-WINDOW].copy()
    on = np.flatnonzero(total)
    row_of = np.repeat(np.arange(len(ids)), np.diff(first))
    new = np.append(True, (on[1:] != on[:-1] + 1) | (row_of[on[1:]] != row_of[on[:-1]]))[: len(on)]
    begin = np.flatnonzero(new)
    lo, hi = on[begin], on[np.append(begin[1:], len(on))[: len(begin)] - 1] + 1
    row = row_of[lo]
    base = segments.column("at").to_numpy()[row] - first[row]
    return pa.table({"doc_id": pa.array(ids[row]), "h": pa.array(segments.column("h").to_numpy()[row]), "lo": pa.array(lo + base), "hi": pa.array(hi + base)})


def removed_spans(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, h: a hash of the text) -> (doc_id, h, spans) of documents that lose
    words; spans is a list of (lo, hi) word numbers that may overlap. Written, not lazy."""
    context, long = rows.sparkSession.sparkContext, T.LongType()
    known = rows.select("doc_id", "text", "h").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    hashes = materialize(recurring(known.select("doc_id", "text")), "recurring")
    schema = read_schema(("doc_id", long), ("h", long), ("at", long), ("text", T.StringType()), ("key", long))
    some = materialize(known.mapInArrow(_segmenter(context.broadcast(bitmap(hashes))), schema), "segments")
    size = some.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # equal slices of the keys; a slice that copies make too large is dealt out again
    bits = max(1, (size // SHARD_BYTES).bit_length())
    sliced = some.withColumn("slice", F.shiftrightunsigned("key", 64 - bits))
    large = sliced.groupBy("slice").agg(F.sum(F.octet_length("text")).alias("size")).filter(F.col("size") > 2 * SHARD_BYTES)
    parts = large.select(F.col("slice").alias("_slice"), F.ceil(F.col("size") / SHARD_BYTES).alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("doc_id", "at"), F.col("parts")), F.lit(0))
    dealt = sliced.join(parts, F.col("slice") == F.col("_slice"), "left").withColumn("shard", (part * 2**bits + F.col("slice")).cast("long")).select("doc_id", "h", "at", "text", "shard")
    windows = read_schema(("shard", long), ("place", T.IntegerType()), ("a", long), ("b", T.IntegerType()), ("least", long), ("many", T.BooleanType()))
    seen = dealt.groupBy("shard").applyInArrow(_windows, windows)
    # a window that every shard has is summed up before it is shuffled, and the join can be split
    owned = seen.groupBy("a", "b").agg(F.min("least").alias("owner"), F.max("least").alias("last"), F.bool_or("many").alias("many")).filter("many OR owner < last").select("a", "b", "owner")
    phrases = seen.select("shard", "place", "a", "b").join(owned, ["a", "b"]).select("shard", "place", "owner")
    found = dealt.groupBy("shard").cogroup(phrases.groupBy("shard")).applyInArrow(_locate, read_schema(("doc_id", long), ("h", long), ("lo", long), ("hi", long)))
    # repeated rows have equal spans
    spans = materialize(found.distinct().groupBy("doc_id", "h").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
    discard(hashes, some)
    return spans


def _kept(text: str, spans: list[dict]) -> tuple[str, int]:
    words = text.encode().split()
    cut = np.zeros(len(words) + 1, np.int64)
    for s in spans:
        cut[s["lo"]] += 1
        cut[s["hi"]] -= 1
    gone = np.cumsum(cut[:-1]) > 0
    return b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode(), int(gone.sum())


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("h", F.xxhash64("text"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hashed(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    spans = removed_spans(rows)
    # a bitmap of the documents that lose words: others need not send their texts to the join
    shared = spark.sparkContext.broadcast(bitmap(spans.select(F.xxhash64("doc_id", "h").alias("h"))))
    long, string = T.LongType(), T.StringType()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            send = may_contain(bits, batch.column(3).to_numpy().view(np.uint64))
            texts, n, sha = [], [], []
            for t, s in zip(batch.column(1), send.tolist(), strict=True):
                t = t.as_py() or ""
                words = t.encode().split()
                n.append(len(words))
                texts.append(t if s else None)
                sha.append(None if s else hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(texts, string_), pa.array(n, pa.int64()), pa.array(sha, string_)], ["doc_id", "h", "text", "n_words", "sha"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, sha = [], []
            for t, s, found in zip(batch.column("text"), batch.column("sha").to_pylist(), batch.column("spans"), strict=True):
                gone = 0
                if s is None:
                    kept, gone = _kept(t.as_py(), found.as_py() or [])
                    s = hashlib.sha256(kept.encode()).hexdigest()
                removed.append(gone)
                sha.append(s)
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_words"), pa.array(removed, pa.int64()), pa.array(sha, string_)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    string_ = pa.string()
    told = rows.select("doc_id", "text", "h", F.xxhash64("doc_id", "h").alias("k")).mapInArrow(digest, read_schema(("doc_id", long), ("h", long), ("text", string), ("n_words", long), ("sha", string)))
    both = told.join(spans, ["doc_id", "h"], "left").select("doc_id", "n_words", "text", "sha", "spans")
    return both.mapInArrow(finish, read_schema(("doc_id", long), ("n_words", long), ("n_removed", long), ("kept_sha256", string)))


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """docs with repeated passages removed: a text that loses words becomes its kept words
    joined by one space (n_chars, if there is such a column, follows); others stay as they are."""
    others = [c for c in docs.columns if c != "text"]
    rows = _hashed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("other")))
    spans = removed_spans(rows)
    key = F.xxhash64("doc_id", "h")
    # only rows that may lose words are sent to the join
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(spans.select(key.alias("h"))))
    marked = rows.withColumn("sent", in_bitmap(shared)(key))
    whole = marked.filter("NOT sent").select("other", "text", F.lit(False).alias("cut"))
    both = marked.filter("sent").drop("sent").join(spans, ["doc_id", "h"], "left").select("other", "text", "spans")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() if not s.is_valid else _kept(t.as_py(), s.as_py())[0] for t, s in zip(batch.column("text"), batch.column("spans"), strict=True)]
            yield pa.record_batch([batch.column("other"), pa.array(texts, pa.string()), batch.column("spans").is_valid()], ["other", "text", "cut"])

    done = whole.unionAll(both.mapInArrow(finish, T.StructType([both.schema["other"], both.schema["text"], T.StructField("cut", T.BooleanType())])))
    cols = []
    for c in docs.columns:
        own = F.col("text") if c == "text" else F.col(f"other.`{c}`")
        if c == "n_chars":
            own = F.when(F.col("cut"), F.length("text")).otherwise(own).cast(docs.schema["n_chars"].dataType)
        cols.append(own.alias(c))
    return done.select(*cols)


QUERIES = {"op3_substring_dedup": op3_substring_dedup}
