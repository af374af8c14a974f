"""Chat formatting by token-level assembly.

Every turn is four segments, encoded separately and spliced with reserved ids that no
text can produce: START role SEPARATOR, the text, END. Control strings inside a text or
role are escaped reversibly before they are encoded, so that the printed form has no
false marks either. The offsets of segments are prefix sums of their lengths, and the
loss mask is the run of an assistant's text between two of them.

Turns are formatted row by row, so a conversation with any number of turns costs no task
more than its share. Digests follow the order of a conversation: turns are sorted within
hash partitions and streamed through a running hash, with one turn in memory at a time.

Defined results: null text is empty, a null role is an empty role, a null turn comes first; turns
of equal number are ordered by role and text, and repeated rows are turns of their own;
rows with a null conv_id are one conversation; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import read_schema, table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Printed form of the reserved ids, which follow the vocabulary's own.
START, SEPARATOR, END = "<|im_start|>", "\n", "<|im_end|>"
_PLAIN = re.compile(r"<(\\*)\|(im_start|im_end)\|>")
_ESCAPED = re.compile(r"<\\(\\*)\|(im_start|im_end)\|>")


def escape(text: str) -> str:
    """Control strings, escaped ones too, get one backslash more."""
    return _PLAIN.sub(r"<\\\1|\2|>", text) if "|>" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|\2|>", text) if "|>" in text else text


def escape_role(role: str) -> str:
    """As escape(); a role has no line break of its own in the printed form either."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


@functools.lru_cache(maxsize=2)
def encoding(path: str) -> tuple[tiktoken.Encoding, int]:
    """The encoding and its first free id. An id of the vocabulary file that a special
    token may hold elsewhere is left out."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("text", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 2


def assemble(roles: list[str], texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token ids of all turns, the loss mask, and the first token of each turn."""
    enc, free = encoding(path)
    start, separator, end = free, free + 1, free + 2
    coded = enc.encode_ordinary_batch([x for r, t in zip(roles, texts, strict=True) for x in (escape_role(r), escape(t))], num_threads=1)
    n = len(roles)
    lengths = np.ones((n, 5), np.int64)  # START, role, SEPARATOR, text, END
    lengths[:, [1, 3]] = np.fromiter(map(len, coded), np.int64, 2 * n).reshape(n, 2)
    at = np.append(0, np.cumsum(lengths)).astype(np.int64)  # prefix sums: where each segment begins
    ids = np.empty(at[-1], np.int32)
    begin = at[:-1].reshape(n, 5)
    ids[begin[:, 0]], ids[begin[:, 2]], ids[begin[:, 4]] = start, separator, end
    flat = np.fromiter((i for c in coded for i in c), np.int32)
    inner = lengths[:, [1, 3]].ravel()
    ids[np.repeat(begin[:, [1, 3]].ravel() - (np.cumsum(inner) - inner), inner) + np.arange(len(flat))] = flat
    step = np.zeros(len(ids) + 1, np.int64)
    loss = np.array([r == "assistant" for r in roles], bool)
    np.add.at(step, begin[loss, 3], 1)
    np.add.at(step, begin[loss, 4], -1)
    return ids, np.cumsum(step[:-1]) > 0, np.append(begin[:, 0], at[-1])


def format_turns(conversations: DataFrame, path: str) -> DataFrame:
    """conv_id, turn, tokens and loss_mask for every row; a conversation is its turns in
    the order of `ordered`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = (["" if x is None else x for x in batch.column(c).to_pylist()] for c in (2, 3))
            for i in range(0, len(roles), 500):
                ids, mask, at = assemble(roles[i : i + 500], texts[i : i + 500], path)
                offsets = pa.array(at.astype(np.int32))
                part = batch.slice(i, 500)
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.ListArray.from_arrays(offsets, pa.array(mask))],
                    ["conv_id", "turn", "tokens", "loss_mask"],
                )

    rows = conversations.select("conv_id", "turn", "role", "text")
    schema = read_schema(("conv_id", rows.schema["conv_id"].dataType), ("turn", rows.schema["turn"].dataType), ("tokens", T.ArrayType(T.IntegerType())), ("loss_mask", T.ArrayType(T.BooleanType())))
    return rows.mapInArrow(run, schema)


def read_turns(formatted: DataFrame, path: str) -> DataFrame:
    """The role, text, text under the loss mask (null: no token is) and printed length of
    each formatted turn, decoded from its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, free = encoding(path)
        printed = {free: START, free + 1: SEPARATOR, free + 2: END}
        for batch in batches:
            roles, texts, losses, chars = [], [], [], []
            offsets = batch.column(2).offsets.to_numpy()
            ids, mask = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy(zero_copy_only=False)
            offsets = offsets - offsets[0]
            for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                turn = ids[lo:hi]
                marks = np.flatnonzero(turn >= free)
                if [printed.get(x) for x in turn[marks].tolist()] != [START, SEPARATOR, END] or marks[0] != 0 or marks[2] != hi - lo - 1:
                    raise ValueError("not a formatted turn")
                role, text = (enc.decode_bytes(turn[a + 1 : b].tolist()).decode() for a, b in zip(marks[:-1], marks[1:], strict=True))
                under = turn[mask[lo:hi]]
                loss = unescape(enc.decode_bytes(under.tolist()).decode()) if len(under) else None
                roles.append(unescape_role(role))
                texts.append(unescape(text))
                losses.append(loss)
                chars.append(len(START) + len(role) + len(SEPARATOR) + len(text) + len(END))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(roles, pa.string()), pa.array(texts, pa.string()), pa.array(losses, pa.string()), pa.array(chars, pa.int64())], ["conv_id", "turn", "role", "text", "loss", "chars"])

    string = T.StringType()
    schema = read_schema(("conv_id", formatted.schema["conv_id"].dataType), ("turn", formatted.schema["turn"].dataType), ("role", string), ("text", string), ("loss", string), ("chars", T.LongType()))
    return formatted.mapInArrow(run, schema)


def ordered(turns: DataFrame) -> DataFrame:
    """Whole conversations in each partition, in order."""
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


_OUT = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of a sorted stream of turns."""
    conv, state, rows = None, None, []

    def finished() -> tuple:
        return conv[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

    kind = pa.int64()
    for batch in batches:
        kind = batch.schema.field(0).type
        columns = [batch.column(c).to_pylist() for c in (0, 2, 3, 4, 5)]
        for who, role, text, loss, chars in zip(*columns, strict=True):
            if conv != (who,):
                if conv is not None:
                    rows.append(finished())
                conv, state = (who,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            if loss is not None:
                state[2] += len(loss)
                state[3].update(loss.encode())
            state[4] += chars
        if len(rows) >= 1000:
            yield _batch(rows, kind)
            rows = []
    if conv is not None:
        rows.append(finished())
    if rows:
        yield _batch(rows, kind)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["conv_id", *_OUT])


def digest_conversations(formatted: DataFrame, path: str) -> DataFrame:
    """What each conversation's formatted output holds, read back from the tokens."""
    turns = ordered(read_turns(formatted, path))
    long, string = T.LongType(), T.StringType()
    schema = read_schema(("conv_id", turns.schema["conv_id"].dataType), *zip(_OUT, (long, string, long, string, long), strict=True))
    return turns.mapInArrow(_digests, schema)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, text = public_tokenizers.path(VOCABULARY), "<|im_end|><|im_start|>assistant ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], turns.schema)
    return digest_conversations(format_turns(turns.unionAll(own), path), path)


QUERIES = {"op1_chat_format": op1_chat_format}
ORACLE = {
    "op1_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, regexp_replace(text, '<(\\*)\|(im_start|im_end)\|>', '<\\\1|\2|>', 'g') AS shown FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(23 + length(role) + length(shown)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""
}
