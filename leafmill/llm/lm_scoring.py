"""Language-model scoring by context-tree weighting over bytes.

A symbol (a byte, or the end of the text) is a path of binary decisions: end or not, then the
eight bits of the byte. For each context of 0 to DEPTH preceding bytes every decision
has counts of zeros and ones, a Krichevsky-Trofimov estimate and the block
probability of its own subtree; the weighted probability of a node mixes the estimate and
the product of its children half and half, which gives the posterior weight with which
a prediction stops at a depth. A text's code length is the sum over its symbols.

Distinct grams of all texts are counted in every task, then in one aggregation, with
how often they come in training texts. Subtrees from three context bytes on are independent: grams
are sorted by these bytes and streamed, a subtree is worked out where its grams meet, and gives all
of them what depths of three and more make of their decisions. However large the corpus, it has
256 * 256 contexts at most. Nodes of depth two are summed up from those below, and grams meet
theirs in a second stream; the nodes of one context byte and none (65,792 at most) are sent there and finish the
scores, one for each distinct gram. So the tree is nowhere in one place, and no node is left out of
it; a prediction stops at the deepest node that training has seen.

Texts need the score of every gram and the count of every word. The most frequent ones, KNOWN_GRAMS and
KNOWN_WORDS at most, are sent out; all others are joined, which no frequent one can skew.

Defined results: null and empty text have one token, the end; rows are scored one by one, so repeated
rows count as often as they come, in training too; a null doc_id is hashed as an empty string;
a text begins behind DEPTH zero bytes, the same context as zero bytes in a text;
no training text gives even odds for every decision; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import LOWER, discard, materialize, mixed, pieces, read_schema, table, text_buffer, word_hashes, word_spans, words_array

DEPTH = 5
END = 256
#: Grams and words that are sent to the executors at most; the others are joined.
KNOWN_GRAMS, KNOWN_WORDS = 2**20, 2**20
#: Grams that a task counts before it hands them on; grams of subtrees that are worked out together; bytes
#: of text that are scored together. They bound a worker's memory and change no result.
HELD_GRAMS, SLICE_GRAMS, PIECE_BYTES = 1_200_000, 60_000, 400_000
#: Parts of a two-byte context whose grams are finished in different tasks.
SALTS = 4
FOLDS = 10
_LN10 = np.log(10.0)


def is_held_out(ids: list, folds: int) -> np.ndarray:
    return np.array([zlib.crc32(("" if i is None else str(i)).encode()) % folds == 0 for i in ids], bool)


def grams(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context << 9 | symbol) of all symbols, ends too, and the first of each row."""
    n = np.diff(at)
    first = np.append(0, np.cumsum(n + 1))
    # each row behind DEPTH zero bytes
    begin = np.append(0, np.cumsum(n + DEPTH))
    row = np.repeat(np.arange(len(n)), n)
    padded = np.zeros(begin[-1] + 1, np.uint64)
    padded[np.arange(len(buf)) - at[:-1][row] + begin[:-1][row] + DEPTH] = buf
    row = np.repeat(np.arange(len(n)), n + 1)
    place = np.arange(first[-1]) - first[:-1][row] + begin[:-1][row] + DEPTH
    out = np.zeros(len(place), np.uint64)
    for k in range(DEPTH, 0, -1):
        out = (out << np.uint64(8)) | padded[place - k]
    symbol = padded[place]
    symbol[first[1:] - 1] = END
    return (out << np.uint64(9)) | symbol, first


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma(x) for x > 0: Stirling's series after seven steps of the recurrence."""
    low, y = np.ones_like(x), x.copy()
    for _ in range(7):
        low *= np.where(y < 7, y, 1.0)
        y = np.where(y < 7, y + 1, y)
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - r * (1 / 360 - r / 1260)) / y - np.log(low)


def _block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov block probability."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1) - 1.1447298858494002


def decisions(gram: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The nine binary decisions of each symbol: (which grams take it, node, bit)."""
    symbol = gram & np.uint64(511)
    end = symbol == END
    yield np.arange(len(gram)), np.zeros(len(gram), np.uint64), end.astype(np.int64)
    some = np.flatnonzero(~end)
    s = symbol[some]
    for k in range(8):
        yield some, (np.uint64(1) << np.uint64(k)) | (s >> np.uint64(8 - k)), ((s >> np.uint64(7 - k)) & np.uint64(1)).astype(np.int64)


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    key, inverse = np.unique(key, return_inverse=True)
    return key, [np.bincount(inverse, v, len(key)) for v in values]


def leaves(gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of full depth: (context << 9 | decision) with their zeros and ones."""
    keys, zeros, ones = [], [], []
    for which, node, bit in decisions(gram):
        keys.append((gram[which] & ~np.uint64(511)) | node)
        zeros.append(np.where(bit == 0, n[which], 0))
        ones.append(np.where(bit == 1, n[which], 0))
    key, (n0, n1) = _summed(np.concatenate(keys), np.concatenate(zeros), np.concatenate(ones))
    return key, n0, n1


def weigh(key, n0, n1, below, depth: int, to: int) -> Iterator[tuple]:
    """From nodes of a depth up to depth `to`: (depth, key, n0, n1, ln weighted probability, weight
    of stopping here). below: ln of the children's product, None at full depth."""
    while True:
        own = _block(n0, n1)
        if below is None:
            weighted, stop = own, np.ones(len(own))
        else:
            weighted = np.logaddexp(own, below) + np.log(0.5)
            stop = np.exp(np.minimum(0.0, own + np.log(0.5) - weighted))
        yield depth, key, n0, n1, weighted, stop
        if depth == to:
            return
        depth -= 1
        keep = np.uint64((2 ** (8 * depth) - 1) << 9 | 511)
        key, (n0, n1, below) = _summed(key & keep, n0, n1, weighted)


def mix(odds: np.ndarray, gram: np.ndarray, depth: int, key: np.ndarray, n0: np.ndarray, n1: np.ndarray, stop: np.ndarray) -> None:
    """Mix the nodes of a depth into the probabilities of each gram's decisions, as they
    come out; not a number where no deeper node is known."""
    if not len(key):
        return
    keep = np.uint64((2 ** (8 * depth) - 1) << 9)
    for k, (which, node, bit) in enumerate(decisions(gram)):
        want = (gram[which] & keep) | node
        at = np.minimum(np.searchsorted(key, want), len(key) - 1)
        known = np.flatnonzero(key[at] == want)
        at, which = at[known], which[known]
        own = (np.where(bit[known] == 1, n1[at], n0[at]) + 0.5) / (n0[at] + n1[at] + 1)
        deeper = odds[which, k]
        odds[which, k] = np.where(np.isnan(deeper), own, stop[at] * own + (1 - stop[at]) * deeper)


#: A gram, how often it comes and what depths of three and more make of its decisions; or a node of depth three.
_PART = (("gram", T.LongType()), ("m", T.LongType()), ("odds", T.BinaryType()), ("key", T.LongType()), ("n0", T.DoubleType()), ("n1", T.DoubleType()), ("weighted", T.DoubleType()))
_NODE = (("key", T.LongType()), ("n0", T.DoubleType()), ("n1", T.DoubleType()), ("weighted", T.DoubleType()), ("stop", T.DoubleType()))
_WIDTH = 9 * 4


def _unsigned(col: pa.Array) -> np.ndarray:
    return col.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _subtree(gram: np.ndarray, n: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
    """Grams of whole three-byte contexts -> the same with their odds, and the nodes of depth three."""
    odds = np.full((len(gram), 9), np.nan)
    key, n0, n1, weighted = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), np.zeros(0)
    train = np.flatnonzero(n)
    if len(train):
        for depth, key, n0, n1, weighted, stop in weigh(*leaves(gram[train], n[train].astype(float)), None, DEPTH, 3):
            mix(odds, gram, depth, key, n0, n1, stop)
    packed = pa.Array.from_buffers(pa.binary(), len(gram), [None, pa.py_buffer(np.arange(0, _WIDTH * len(gram) + 1, _WIDTH, dtype=np.int32)), pa.py_buffer(odds.astype(np.float32).tobytes())])
    long, double = pa.int64(), pa.float64()
    columns = [
        (pa.array(gram.view(np.int64)), pa.nulls(len(key), long)), (pa.array(m), pa.nulls(len(key), long)), (packed, pa.nulls(len(key), pa.binary())),
        (pa.nulls(len(gram), long), pa.array(key.view(np.int64))), *((pa.nulls(len(gram), double), pa.array(x)) for x in (n0, n1, weighted)),
    ]
    return pa.record_batch([pa.concat_arrays(x) for x in columns], [name for name, _ in _PART])


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(near, gram, n, m) sorted by near, the three nearest context bytes; see _subtree."""
    held: list[tuple] = []
    size, most = 0, SLICE_GRAMS
    for batch in batches:
        held.append((batch.column(0).to_numpy(), _unsigned(batch.column(1)), batch.column(2).to_numpy(), batch.column(3).to_numpy()))
        size += batch.num_rows
        if size >= most:
            near, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
            whole = int(np.searchsorted(near, near[-1]))  # the last context may go on
            if whole:
                yield _subtree(*(x[:whole] for x in rest))
            held = [(near[whole:], *(x[whole:] for x in rest))]
            size = len(near) - whole
            most = max(SLICE_GRAMS, 2 * size)
    if size:
        yield _subtree(*(np.concatenate(x) for x in list(zip(*held, strict=True))[1:]))


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of depth two with the sums of those below -> with their own weights."""
    for batch in batches:
        if batch.num_rows:
            _, _, _, _, weighted, stop = next(weigh(_unsigned(batch.column(0)), *(batch.column(k).to_numpy() for k in (1, 2, 3)), 2, 2))
            yield pa.record_batch([*batch.columns[:3], pa.array(weighted), pa.array(stop)], [name for name, _ in _NODE])


def _valuer(top):
    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """ln of the mixed probability of each gram's symbol behind its context. Rows are sorted by
        the two nearest bytes, nodes of depth two before the grams."""
        nodes = (np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), np.zeros(0))
        for batch in batches:
            if not batch.num_rows:
                continue
            new = batch.filter(batch.column("key").is_valid())
            if new.num_rows:
                nodes = tuple(np.concatenate(x) for x in zip(nodes, (_unsigned(new.column("key")), *(new.column(c).to_numpy() for c in ("n0", "n1", "stop"))), strict=True))
                nodes = tuple(x[np.unique(nodes[0], return_index=True)[1]] for x in nodes)
            found = batch.filter(batch.column("gram").is_valid())
            if found.num_rows:
                gram, packed = _unsigned(found.column("gram")), found.column("odds")
                at = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset :]
                odds = np.frombuffer(packed.buffers()[2], np.float32, 9 * len(gram), int(at[0])).astype(float).reshape(-1, 9)
                mix(odds, gram, 2, *nodes)
                for level in top.value:
                    mix(odds, gram, *level)
                total = np.zeros(len(gram))
                for k, (which, _, _) in enumerate(decisions(gram)):
                    p = odds[which, k]
                    total[which] += np.log(np.where(np.isnan(p), 0.5, p))
                yield pa.record_batch([found.column("gram"), found.column("m"), pa.array(total)], ["gram", "m", "value"])
            # the last context may go on
            keep = (nodes[0] >> np.uint64(9)) == np.uint64(batch.column("part")[batch.num_rows - 1].as_py() // SALTS)
            nodes = tuple(x[keep] for x in nodes)

    return value


class Known:
    """Values of the most frequent grams: a slot for each hash finds most, a search all."""

    def __init__(self, gram: np.ndarray, m: np.ndarray, value: np.ndarray):
        order = np.argsort(gram)
        self.gram, self.value = gram[order], value[order]
        self.bits = np.uint64(64 - max(1, int(2 * len(gram) + 1).bit_length()))
        self.owner = np.zeros(2 ** (64 - int(self.bits)), np.int32)
        # of grams that share a slot the most frequent has it
        rising = np.argsort(m[order], kind="stable")
        self.owner[(mixed(self.gram[rising]) >> self.bits).astype(np.int64)] = rising

    def find(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value or zero, known) of each gram."""
        if not len(self.gram):
            return np.zeros(len(gram)), np.zeros(len(gram), bool)
        at = self.owner[mixed(gram) >> self.bits].astype(np.int64)
        known = self.gram[at] == gram
        other = np.flatnonzero(~known)
        at[other] = np.minimum(np.searchsorted(self.gram, gram[other]), len(self.gram) - 1)
        known[other] = self.gram[at[other]] == gram[other]
        return np.where(known, self.value[at], 0.0), known


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct grams: how often they come in training texts, and in all."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def summed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        gram, counts = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return gram, *(c.astype(np.int64) for c in counts)

    def told(gram: np.ndarray, n: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array((gram >> np.uint64(9) & np.uint64(0xFFFFFF)).astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(n), pa.array(m)], ["near", "gram", "n", "m"])

    for batch in batches:
        train = ~is_held_out(batch.column(0).to_pylist(), FOLDS)
        for rows, counts in ((train, 1), (~train, 0)):
            buf, at = text_buffer(batch.column(1).filter(pa.array(rows)))
            for _, _, part, off in pieces(buf, at, PIECE_BYTES):
                gram, m = np.unique(grams(LOWER[part], off)[0], return_counts=True)
                held.append((gram, counts * m, m))
                size += len(gram)
                if size > HELD_GRAMS:
                    held = [summed()]
                    size = len(held[0][0])
                    if size > HELD_GRAMS // 2:
                        yield told(*held[0])
                        held, size = [], 0
    if held:
        yield told(*summed())


def gram_scores(docs: DataFrame) -> DataFrame:
    """gram, m (how often it comes) and value (ln of its probability) for every distinct gram
    of the texts (doc_id, text), by the context tree of all training texts."""
    long, double = T.LongType(), T.DoubleType()
    counted = docs.mapInArrow(_count_grams, read_schema(("near", T.IntegerType()), ("gram", long), ("n", long), ("m", long)))
    counted = counted.repartition("near").groupBy("near", "gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).sortWithinPartitions("near")
    parts = materialize(counted.mapInArrow(_subtrees, read_schema(*_PART)), "context-grams")

    def above(nodes: DataFrame, context: int) -> DataFrame:
        up = F.col("key").bitwiseAND(F.lit(context << 9 | 511)).alias("key")
        return nodes.groupBy(up).agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "weighted")))

    two = materialize(above(parts.filter("key IS NOT NULL"), 0xFFFF).mapInArrow(_weighed, read_schema(*_NODE)), "context-nodes")
    # one context byte: 256 contexts of 256 decisions at most
    got = above(two, 0xFF).orderBy("key").toArrow()
    key, n0, n1, below = (got.column(c).to_numpy() for c in ("key", "n0", "n1", "weighted"))
    top = [(d, k, a, b, stop) for d, k, a, b, _, stop in weigh(key.astype(np.int64).view(np.uint64), n0, n1, below, 1, 0)] if len(key) else []
    value = _valuer(docs.sparkSession.sparkContext.broadcast(top))
    # grams and, in every part of their context, the nodes of depth two
    near = lambda c: F.shiftright(c, 9).bitwiseAND(F.lit(0xFFFF)) * SALTS
    part = near("gram") + F.shiftright("gram", 25).bitwiseAND(F.lit(SALTS - 1))
    found = parts.filter("gram IS NOT NULL").select(part.alias("part"), "gram", "m", "odds", *(F.lit(None).cast(t).alias(c) for c, t in (("key", long), ("n0", double), ("n1", double), ("stop", double))))
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    nodes = two.select("key", "n0", "n1", "stop", salt).select((near("key") + F.col("salt")).alias("part"), *(F.lit(None).cast(t).alias(c) for c, t in (("gram", long), ("m", long), ("odds", T.BinaryType()))), "key", "n0", "n1", "stop")
    both = found.unionAll(nodes).repartition("part").sortWithinPartitions("part", F.col("gram").isNotNull())
    scores = materialize(both.mapInArrow(value, read_schema(("gram", long), ("m", long), ("value", double))), "gram-scores")
    discard(parts, two)
    return scores


def frequent(df: DataFrame, count: str, most: int) -> tuple[DataFrame | None, DataFrame]:
    """Rows of the highest counts, `most` at most (None if no bucket of counts fits), and all others."""
    left, least = most, None
    bucket = F.floor(F.log2(count) * 8).cast("int")
    for r in sorted(df.groupBy(bucket.alias("v")).count().collect(), key=lambda r: -r["v"]):
        left -= r["count"]
        if left < 0:
            break
        least = r["v"]
    return (None, df) if least is None else (df.filter(bucket >= least), df.filter(bucket < least))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each piece of training text with their numbers, and the ends as null."""
    for batch in batches:
        train = ~is_held_out(batch.column(0).to_pylist(), FOLDS)
        buf, at = text_buffer(batch.column(1).filter(pa.array(train)))
        for i, j, part, off in pieces(buf, at):
            part = LOWER[part]
            starts, ends, _ = word_spans(part, off)
            coded = words_array(part, starts, ends).dictionary_encode()
            n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
            words = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([None], pa.string())])
            yield pa.record_batch([words, pa.array(np.append(n, j - i).astype(np.int64))], ["word", "c"])


def _scorer(model, known):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the frequent grams give to the scores of rows and the frequent words to their base;
        the other words and grams."""
        frequent_grams = model.value
        hashes, value, end_value, end_known = known.value
        for batch in batches:
            n = batch.num_rows
            total, base, rest = np.zeros(n), np.zeros(n), [[]] * n
            tokens, seen, rare, n_rare = np.zeros(n, np.int64), np.zeros(n, np.int64), [np.zeros(0, np.uint64)], np.zeros(n, np.int64)
            buf, at = text_buffer(batch.column(1))
            for i, j, part, off in pieces(buf, at, PIECE_BYTES):
                part = LOWER[part]
                gram, first = grams(part, off)
                given, hit = frequent_grams.find(gram)
                total[i:j] = np.add.reduceat(given, first[:-1])
                rare.append(gram[~hit])
                n_rare[i:j] = np.add.reduceat((~hit).astype(np.int64), first[:-1])
                starts, ends, first = word_spans(part, off)
                tokens[i:j] = np.diff(first) + 1
                base[i:j], seen[i:j] = end_value, end_known
                if not len(starts):
                    continue
                h = word_hashes(part, starts, ends)
                place = np.minimum(np.searchsorted(hashes, h), max(len(hashes) - 1, 0))
                hit = hashes[place] == h if len(hashes) else np.zeros(len(h), bool)
                row = np.repeat(np.arange(j - i), np.diff(first))
                base[i:j] += np.bincount(row[hit], value[place[hit]], j - i) if hit.any() else 0
                seen[i:j] += np.bincount(row[hit], minlength=j - i)
                miss = np.flatnonzero(~hit)
                words = words_array(part, starts[miss], ends[miss]).to_pylist()
                cut = np.append(0, np.cumsum(np.bincount(row[miss], minlength=j - i))).tolist()
                for k in range(j - i):
                    rest[i + k] = words[cut[k] : cut[k + 1]]
            held = is_held_out(batch.column(0).to_pylist(), FOLDS)
            others = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_rare)).astype(np.int32)), pa.array(np.concatenate(rare).view(np.int64)))
            yield pa.record_batch(
                [batch.column(0), pa.array(held), pa.array(tokens), pa.array(seen), pa.array(base), pa.array(total), pa.array(rest, pa.list_(pa.string())), others],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rest", "rare"],
            )

    return score


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    context = docs.sparkSession.sparkContext
    docs = docs.select("doc_id", "text")
    values = gram_scores(docs)
    common, rare_grams = frequent(values, "m", KNOWN_GRAMS)
    gram, m, value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if common is not None:
        got = common.toArrow()
        gram, m, value = (got.column(c).to_numpy() for c in ("gram", "m", "value"))
    model = context.broadcast(Known(gram.astype(np.int64).view(np.uint64), m, value))
    counts = docs.mapInArrow(_count_words, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))
    counts = materialize(counts, "words")
    all_tokens, distinct, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("c"))), F.lit(0))).first()
    if not ends:
        distinct = max(0, distinct - 1)
    denominator = all_tokens + 0.1 * (distinct + 1)
    words = counts.filter("word IS NOT NULL")
    hashes, value = np.zeros(0, np.uint64), np.zeros(0)
    common, rare = frequent(words, "c", KNOWN_WORDS)
    if common is not None:
        got = common.toArrow()
        buf, at = text_buffer(got.column("word"))
        hashes = np.concatenate([word_hashes(part, off[:-1], off[1:]) for _, _, part, off in pieces(buf, at)])
        order = np.argsort(hashes)
        hashes, value = hashes[order], np.log10((got.column("c").to_numpy()[order] + 0.1) / denominator)
    end_value = float(np.log10((ends + 0.1) / denominator))
    known = context.broadcast((hashes, value, end_value, int(ends > 0)))
    long, double = T.LongType(), T.DoubleType()
    schema = read_schema(("doc_id", docs.schema["doc_id"].dataType), ("held_out", T.BooleanType()), ("n_tokens", long), ("n_known", long), ("base_score", double), ("score", double), ("rest", T.ArrayType(T.StringType())), ("rare", T.ArrayType(long)))
    scored = materialize(docs.mapInArrow(_scorer(model, known), schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    others = scored.select("row", F.explode("rest").alias("w")).join(rare.select("word", "c"), F.col("w") == F.col("word"), "left")
    logs = F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(denominator))
    others = others.select("row", logs.alias("b"), F.col("c").isNotNull().cast("long").alias("k"), F.lit(0.0).alias("s"))
    # every gram has a value
    grams_left = scored.select("row", F.explode("rare").alias("g")).join(rare_grams.select("gram", "value"), F.col("g") == F.col("gram"))
    others = others.unionAll(grams_left.select("row", F.lit(0.0).alias("b"), F.lit(0).cast("long").alias("k"), F.col("value").alias("s")))
    others = others.groupBy("row").agg(*(F.sum(c).alias(c) for c in "bks")).withColumnRenamed("row", "r")
    out = scored.drop("rest", "rare").join(others, F.col("row") == F.col("r"), "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(all_tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("b", F.lit(0.0))).alias("base_score"), ((F.col("score") + F.coalesce("s", F.lit(0.0))) / F.lit(float(_LN10))).alias("score"),
    )


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op6_lm_scoring": op6_lm_scoring}
