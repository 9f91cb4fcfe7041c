"""Pieces shared by the text operators: whole-row batching, byte views, words and hashes.

Everything works on Arrow buffers with numpy, so no Python object is made for a text or a word.
A null text counts as an empty one wherever bytes or words are taken.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, cut_counted, discard, shared_dir

#: Bytes of text that one numpy step handles at once; a longer text makes a step of its own.
STEP_BYTES = 2_000_000

WS = np.zeros(256, bool)
WS[[9, 10, 11, 12, 13, 32]] = True

_RNG = np.random.default_rng(20240607)
BYTE_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def table_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/sparkweave/{what}-{uuid.uuid4().hex}"


def mapped(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow over row slices of at most STEP_BYTES of text where the first column is named text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = fn(part)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str = "text", most: int | None = None) -> Iterator[pa.RecordBatch]:
    most = most or STEP_BYTES
    n = batch.num_rows
    if not n:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(lengths, dtype=np.int64)
    at = 0
    while at < n:
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def views(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of the texts end to end, and where each text begins (one more than texts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    arr = texts.cast(pa.large_binary())
    if arr.null_count:
        arr = pc.fill_null(arr, b"")
    off = np.frombuffer(arr.buffers()[1], np.int64, len(arr) + 1, arr.offset * 8)
    if off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    data = np.frombuffer(arr.buffers()[2], np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def word_spans(data: np.ndarray, off: np.ndarray, stops: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words are runs of bytes other than 0x20 and 0x09-0x0D: their bytes without white space, where each
    word begins in them (one more than words), and each text's first word (one more than texts). With stops, a
    word also ends between an ASCII letter and a full stop or comma."""
    n = len(data)
    if not n:
        return data, np.zeros(1, np.int64), np.zeros(len(off), np.int64)
    space = WS[data]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    begins = off[:-1]
    before[begins[begins < n]] = True
    keep = ~space
    if stops:
        low = data | np.uint8(32)
        before[1:] |= ((data[1:] == 46) | (data[1:] == 44)) & (low[:-1] >= 97) & (low[:-1] <= 122)
    start = np.flatnonzero(keep & before)
    kept = data[keep]
    cum = np.cumsum(keep, dtype=np.int64)
    spans = np.empty(len(start) + 1, np.int64)
    spans[:-1] = cum[start] - 1
    spans[-1] = len(kept)
    return kept, spans, np.searchsorted(start, off)


class Words:
    """The words of a slice of texts as codes into its distinct words."""

    def __init__(self, texts: pa.Array, lower: bool = False, stops: bool = False):
        data, off = views(texts)
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        self.chars = data, off
        kept, spans, self.first = word_spans(data, off, stops)
        arr = pa.Array.from_buffers(pa.large_binary(), len(spans) - 1, [None, pa.py_buffer(spans), pa.py_buffer(np.ascontiguousarray(kept))])
        coded = arr.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        self.distinct = coded.dictionary
        self.n = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each distinct word."""
        return hash_strings(*views(self.distinct))

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n)), self.n)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, base: np.uint64 = MULTIPLIER) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    if n > 1:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


def hash_strings(data: np.ndarray, off: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte string data[off[i]:off[i+1]]; equal strings have equal hashes anywhere."""
    lengths = np.diff(off)
    out = np.zeros(len(lengths), np.uint64)
    some = np.flatnonzero(lengths)
    if len(some):
        place = np.arange(len(data)) - np.repeat(off[:-1], lengths)
        terms = BYTE_TABLE[data] * powers(int(lengths.max()), MULTIPLIER + np.uint64(2 * seed))[place]
        out[some] = np.add.reduceat(terms, off[:-1][some])
    return mix(out + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed))


def sequence_key(values: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of each text's sequence of 64-bit values."""
    n = np.diff(first)
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        place = np.arange(len(values)) - np.repeat(first[:-1], n)
        terms = mix(values + np.uint64(seed)) * powers(int(n.max()), MULTIPLIER + np.uint64(2 * seed))[place]
        out[some] = np.add.reduceat(terms, first[:-1][some])
    return mix(out + n.astype(np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def held_out(residue: int):
    """Column: crc32 of doc_id as text, modulo 5, is residue. A null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == residue


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def list_array(values: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values))


def with_row_ids(docs: DataFrame, name: str = "rid", every: bool = False) -> DataFrame:
    """doc_id, text (or every column) and a row's place in the order of doc_id. That is doc_id itself where it is a
    key; else rows are numbered by (doc_id with nulls last, text), so that repeated rows stay apart."""
    docs = docs if every else docs.select("doc_id", "text")
    odd = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1)
    if odd.isEmpty():
        return docs.withColumn(name, F.col("doc_id"))
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first())
    return cut(ordered.withColumn(name, F.monotonically_increasing_id()), "rows")


#: Column that numbers rows beside the caller's own columns.
ROW = "__row_id"


def filtered(docs: DataFrame, keep) -> DataFrame:
    """Rows of docs, with all their columns, whose flag in keep(batch of docs) is set; in slices by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(keep(part), pa.bool_()))

    return over_all(docs, lambda rows: rows.mapInArrow(run, rows.schema))


def over_all(docs: DataFrame, change, *own: str) -> DataFrame:
    """change(rows) of docs with all columns but text, doc_id and `own` renamed, so that no name can disturb; change
    returns the same columns, which then get their names back."""
    names = docs.columns
    rows = docs.toDF(*(c if c in ("text", "doc_id", *own) else f"other_{i}" for i, c in enumerate(names)))
    return change(rows).toDF(*names)


def wrap(x: int) -> np.uint64:
    return np.uint64(x & 0xFFFFFFFFFFFFFFFF)


def codepoints(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 strings data[off[i]:off[i+1]], and where each string begins in them."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points, begins[off]


_G = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]


def char_grams(points: np.ndarray, off: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram from each code point; 1 << bits where it would leave its string."""
    g = points * _G[0]
    h = g
    for j in range(1, n):
        h = h[:-1] * _G[1] + g[j:]
    out = np.full(len(points), 1 << bits, np.int32)
    h = h ^ (h >> np.uint32(15))
    out[: len(h)] = (h * _G[2] + np.uint32(n) * np.uint32(40503)) * _G[3] >> np.uint32(32 - bits)
    for j in range(1, n):
        ends = off[1:] - j
        out[ends[ends >= off[:-1]]] = 1 << bits
    return out


def summed(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of each string's values, in double precision."""
    out = np.zeros(len(off) - 1)
    some = np.flatnonzero(np.diff(off))
    if len(some):
        out[some] = np.add.reduceat(values, off[:-1][some], dtype=np.float64)
    return out
