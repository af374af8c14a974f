"""Structure-aware chunks for retrieval.

Packing to a token budget depends on what was packed before, so a document's blocks are worked
through in order. A document is one row here: its blocks are cut from its text inside the
task that reads it, and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

_CJK = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff]")
_RUN = re.compile(r"[^\W_]+")
_SPACE = re.compile(r"\s")


@dataclass(frozen=True)
class Options:
    """target and overlap in tokens; whether headings and tables start chunks of their own."""

    target: int = 512
    overlap: int = 64
    split_on_headings: bool = True
    isolate_tables: bool = True


def tokens(text: str) -> int:
    """As functions.text.estimate_tokens, for text in Python."""
    cjk = len(_CJK.findall(text))
    rest = _CJK.sub(" ", text) if cjk else text
    runs = _RUN.findall(rest)
    other = len(rest) - sum(map(len, runs)) - len(_SPACE.findall(rest))
    return cjk + sum(max(1, (len(r) + 2) // 4) for r in runs) + other


def block_kind(line: str) -> tuple[str, int]:
    """Kind of a line and the level of a heading."""
    if line.startswith("Licensed"):
        return "footer", 0
    if " | " in line:
        return "table", 0
    if len(line) <= 30 and "," not in line and line:
        return "heading", 1 if len(line) <= 10 else 2 if len(line) <= 20 else 3
    return "paragraph", 0


def _sentences(text: str) -> list[str]:
    return [s for s in (" ".join(x.split()) for x in re.split(r"(?<=[.!?])(?=\s)", text)) if s]


def pack_sentences(text: str, target: int) -> list[str]:
    """Sentences put together as long as they fit."""
    out: list[str] = []
    size = 0
    for s in _sentences(text):
        n = tokens(s)
        if out and size + n <= target:
            out[-1] += " " + s
            size += n
        else:
            out.append(s)
            size = n
    return out


def chunks(text: str, options: Options) -> list[dict]:
    """Chunks of one document: text, tokens, section, kinds, first and last line, oversized.

    Furniture (footers) is left out. A heading closes the chunk and the overlap; a table is
    alone; a paragraph above the target is split into sentences; after a full chunk the last
    whole pieces that fit into the overlap open the next one."""
    out: list[dict] = []
    path: dict[int, str] = {}
    held: list[tuple[str, int, str, int]] = []  # text, tokens, kind, line
    carried = 0  # pieces of held that the last chunk has too

    def flush(carry: bool) -> None:
        nonlocal held, carried
        if len(held) > carried:
            size = sum(p[1] for p in held)
            out.append(
                {
                    "text": "\n".join(p[0] for p in held), "tokens": size, "section": " > ".join(f"{'#' * min(k, 6)} {path[k]}" for k in sorted(path)),
                    "kinds": sorted({p[2] for p in held}), "first_line": held[0][3], "last_line": held[-1][3], "oversized": size > options.target,
                }
            )
        keep: list[tuple[str, int, str, int]] = []
        if carry and options.overlap:
            left = options.overlap
            for p in reversed(held):
                if p[2] == "table" or (keep and p[1] > left) or (not keep and p[1] > options.target):
                    break
                keep.insert(0, p)
                left -= p[1]
            if len(keep) == len(held):
                keep = keep[1:]
        held, carried = keep, len(keep)

    for i, line in enumerate(text.split("\n")):
        kind, level = block_kind(line)
        if not line.strip() or kind == "footer":
            continue
        if kind == "heading":
            if options.split_on_headings:
                flush(False)
                held, carried = [], 0
            path = {k: v for k, v in path.items() if k < level}
            path[level] = line.strip()
        n = tokens(line)
        if kind == "table" and options.isolate_tables:
            flush(False)
            held, carried = [(line, n, kind, i)], 0
            flush(False)
            continue
        for piece in pack_sentences(line, options.target) if n > options.target else [line]:
            m = tokens(piece)
            if len(held) > carried and sum(p[1] for p in held) + m > options.target:
                flush(True)
            held.append((piece, m, kind, i))
    flush(False)
    return out


SCHEMA = "doc_id long, chunk int, text string, tokens long, section string, kinds array<string>, first_line int, last_line int, oversized boolean"


def chunk_documents(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """All chunks of all documents (doc_id, text); a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                rows = [(d, k, c) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for k, c in enumerate(chunks(t or "", options))]
                yield pa.record_batch(
                    [
                        pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2]["text"] for r in rows], pa.string()), pa.array([r[2]["tokens"] for r in rows], pa.int64()),
                        pa.array([r[2]["section"] for r in rows], pa.string()), pa.array([r[2]["kinds"] for r in rows], pa.list_(pa.string())), pa.array([r[2]["first_line"] for r in rows], pa.int32()),
                        pa.array([r[2]["last_line"] for r in rows], pa.int32()), pa.array([r[2]["oversized"] for r in rows], pa.bool_()),
                    ],
                    ["doc_id", "chunk", "text", "tokens", "section", "kinds", "first_line", "last_line", "oversized"],
                )

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, SCHEMA)
