"""Documents into chunks for reading: paragraphs are packed up to a size; long ones are cut at white space.

Runs as an Arrow batch function; a document's chunks come out as rows with their order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: The least size of a chunk, and how a paragraph that names its source begins.
LEAST = 200
SOURCE_MARKER = "<!-- source"


class Truncated(Exception):
    """A reader's reply did not fit; the chunk is halved."""


def cut_paragraph(text: str, size: int) -> Iterator[str]:
    """The paragraph if it fits; else its words, joined by single spaces in pieces of at most `size` characters. A
    word over the size is cut by characters."""
    if len(text) <= size:
        yield text
        return
    line = ""
    for word in text.split():
        if len(word) > size:
            if line:
                yield line
            *full, line = (word[i : i + size] for i in range(0, len(word), size))
            yield from full
        elif line and len(line) + 1 + len(word) > size:
            yield line
            line = word
        else:
            line = f"{line} {word}" if line else word
    if line:
        yield line


def chunk(document: str, size: int, marker: str = SOURCE_MARKER) -> list[str]:
    """Chunks of about `size` bytes. A source marker always begins a chunk."""
    size = max(size, LEAST)
    out: list[list[str]] = []
    used = 0
    for paragraph in filter(None, map(str.strip, document.split("\n\n"))):
        fresh = paragraph.startswith(marker)
        for piece in cut_paragraph(paragraph, size):
            length = len(piece.encode())
            if not out or fresh or used + 2 + length > size:
                out.append([piece])
                used = length
            else:
                out[-1].append(piece)
                used += 2 + length
            fresh = False
    return ["\n\n".join(p) for p in out]


def chunk_documents(docs: DataFrame, size: int = 2000, id_column: str = "doc_id") -> DataFrame:
    """doc_id, ord and chunk of each text; a null or empty text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                ids, ords, texts = [], [], []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for n, c in enumerate(chunk(text or "", size)):
                        ids.append(i)
                        ords.append(n)
                        texts.append(c)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ords, pa.int32()), pa.array(texts, pa.string())], names=["doc_id", "ord", "chunk"])

    return docs.selectExpr(f"cast({id_column} as bigint) as doc_id", "text").mapInArrow(run, "doc_id long, ord int, chunk string")


def read_chunk(text: str, read: Callable[[str], list]) -> list:
    """read(text), and for a chunk whose reply is truncated the results of its halves in order; one that cannot be
    halved raises."""
    try:
        return read(text)
    except Truncated:
        halves = chunk(text, len(text) // 2)
        if len(halves) < 2:
            raise
        return [x for h in halves for x in read_chunk(h, read)]
