"""Token-ID output: texts encoded by a tokenizers file, written as patched frame-of-reference shards, read back.

Rows are range-partitioned by their place in the order of doc_id and sorted there, so shards in the order of
their first row hold the ids of all documents in ascending doc_id order. A shard is a row of a table that Spark
writes (committed as a whole, so a lost executor leaves no half file, and any file system that Spark knows will
do): first row, doc_ids, lengths, and a payload in this format (little endian):

    "PFR1", block size u32, ids u64, blocks u32, then blocks + 1 starts u64 (from the first block's byte),
    then each block: minimum u32, width u8, exceptions u16, packed (id - minimum) of `width` bits each,
    exceptions' places u16 and their whole (id - minimum) u32.

A block's width is that of its PERCENTILE-th value; larger ones are exceptions and packed as 0.

The tokenizer drops white space and never joins across it, so a text's ids are those of its words, and each
distinct word of a batch is encoded once (tests compare with whole texts).

Edge cases: null and empty texts have the end id alone. Repeated doc_ids stay apart, ordered by text; null
doc_ids come last. A table without rows gives no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, record, slices, table_path, views, with_row_ids

BLOCK = 1024
PERCENTILE = 95
END_ID = 1
SLICE_BYTES = 4_000_000
#: Words whose ids a worker remembers.
CACHED_WORDS = 300_000


def pack(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """ids (unsigned 32-bit) as a payload."""
    ids = np.asarray(ids, np.uint32)
    n = len(ids)
    blocks = -(-n // block)
    head = b"PFR1" + struct.pack("<IQI", block, n, blocks)
    if not n:
        return head + struct.pack("<Q", 0)
    full = np.empty((blocks, block), np.uint32)
    full.ravel()[:n] = ids
    full.ravel()[n:] = ids[-1]
    low = full.min(axis=1)
    delta = full - low[:, None]
    at = min(block - 1, int(np.ceil(block * percentile / 100)) - 1)
    top = np.partition(delta, at, axis=1)[:, at].astype(np.int64)
    width = np.where(top > 0, np.floor(np.log2(np.maximum(top, 1))).astype(np.int64) + 1, 0)
    above = delta.astype(np.int64) >> width[:, None] != 0
    patched = above.sum(axis=1)
    size = 7 + (block * width + 7) // 8 + patched * 6
    starts = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(starts[-1], np.uint8)
    heads = np.zeros((blocks, 7), np.uint8)
    heads[:, :4] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
    heads[:, 4] = width
    heads[:, 5:] = patched.astype("<u2").view(np.uint8).reshape(-1, 2)
    out[starts[:-1, None] + np.arange(7)] = heads
    body = np.where(above, 0, delta)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        for part in np.array_split(rows, max(1, len(rows) // 256)):
            bits = (body[part][:, :, None] >> np.arange(w, dtype=np.uint32)).astype(np.uint8) & 1
            packed = np.packbits(bits.reshape(len(part), -1), axis=1, bitorder="little")
            out[starts[part][:, None] + 7 + np.arange(packed.shape[1])] = packed
    row, col = np.nonzero(above)
    if len(row):
        first = np.concatenate([[0], np.cumsum(patched)])[:-1]
        rank = np.arange(len(row)) - first[row]
        base = starts[row] + 7 + (block * width[row] + 7) // 8
        out[(base + 2 * rank)[:, None] + np.arange(2)] = col.astype("<u2").view(np.uint8).reshape(-1, 2)
        out[(base + 2 * patched[row] + 4 * rank)[:, None] + np.arange(4)] = delta[row, col].astype("<u4").view(np.uint8).reshape(-1, 4)
    return head + starts.astype("<u8").tobytes() + out.tobytes()


def unpack(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """ids of blocks first..last of a payload (all by default); the index finds them."""
    if payload[:4] != b"PFR1":
        raise ValueError("not a token file")
    block, n, blocks = struct.unpack_from("<IQI", payload, 4)
    starts = np.frombuffer(payload, "<u8", blocks + 1, 20).astype(np.int64)
    data = np.frombuffer(payload, np.uint8, offset=20 + 8 * (blocks + 1))
    last = blocks if last is None else min(last, blocks)
    if first >= last:
        return np.zeros(0, np.uint32)
    begin = starts[first:last]
    heads = data[begin[:, None] + np.arange(7)]
    low = np.ascontiguousarray(heads[:, :4]).view("<u4")[:, 0]
    width = heads[:, 4].astype(np.int64)
    patched = np.ascontiguousarray(heads[:, 5:]).view("<u2")[:, 0].astype(np.int64)
    out = np.zeros((last - first, block), np.uint32)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        for part in np.array_split(rows, max(1, len(rows) // 256)):
            raw = data[begin[part][:, None] + 7 + np.arange((block * w + 7) // 8)]
            bits = np.unpackbits(raw, axis=1, count=block * int(w), bitorder="little").reshape(len(part), block, w)
            value = np.zeros((len(part), block), np.uint32)
            for b in range(w):
                value |= bits[:, :, b].astype(np.uint32) << np.uint32(b)
            out[part] = value
    row = np.repeat(np.arange(last - first), patched)
    if len(row):
        rank = np.arange(len(row)) - np.concatenate([[0], np.cumsum(patched)])[:-1][row]
        base = begin[row] + 7 + (block * width[row] + 7) // 8
        col = np.ascontiguousarray(data[(base + 2 * rank)[:, None] + np.arange(2)]).view("<u2")[:, 0]
        value = np.ascontiguousarray(data[(base + 2 * patched[row] + 4 * rank)[:, None] + np.arange(4)]).view("<u4")[:, 0]
        out[row, col] = value
    out += low[:, None]
    return out.ravel()[: n - first * block]


class WordEncoder:
    """Ids of texts by a tokenizers file that never joins across white space.

    Distinct words are looked up in the words that this worker has met before; the others are encoded in one text.
    Words of letters alone are one token sequence each and end in a piece with the file's word-end suffix, which
    parts them again; all others stand between special tokens. If the file lower-cases and parts letters from what
    follows, words differ less and there are fewer.
    """

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        data = json.loads(tokenizer_json)
        added = data.get("added_tokens") or []
        self.added = [t["content"] for t in added]
        self.mark = next(((t["content"], t["id"]) for t in added if t["special"] and not t["normalized"]), None)
        self.lower = self._alike("aZbY", "azby") and self._alike("QUEUE", "queue")
        self.stops = all(self._alike(a + b, a, b) for a in ("ab", "queue", "Don't") for b in (".", ",", ".,x", ",1"))
        suffix = data["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.known = pa.array([], pa.large_string())
        self.flat, self.off = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _alike(self, whole: str, *parts: str) -> bool:
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        return ids(whole) == [i for p in parts for i in ids(p)]

    def words(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A table of ids end to end, each entry's first id, and each word's entry."""
        at = pc.fill_null(pc.index_in(distinct, self.known), -1).to_numpy() if len(self.known) else np.full(len(distinct), -1)
        new = np.flatnonzero(at < 0)
        fresh = distinct.take(pa.array(new))
        flat, off = self._encode(fresh)
        entry = at.astype(np.int64)
        entry[new] = len(self.known) + np.arange(len(new))
        flat, off = np.concatenate([self.flat, flat]), np.concatenate([self.off, self.off[-1] + off[1:]])
        if len(self.known) < CACHED_WORDS:
            n = min(len(self.known) + len(new), CACHED_WORDS)
            self.known = pa.concat_arrays([self.known, fresh.slice(0, n - len(self.known))])
            self.flat, self.off = flat[: off[n]].copy(), off[: n + 1].copy()
        return flat, off, entry

    def _encode(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word end to end, and each word's first (one more than words)."""
        plain = pc.match_substring_regex(distinct, r"^\p{L}+$").to_numpy(zero_copy_only=False) if self.ends.any() else np.zeros(len(distinct), bool)
        parts = []
        for which, encode in ((np.flatnonzero(plain), self._letters), (np.flatnonzero(~plain), self._any)):
            words = distinct.take(pa.array(which)).to_pylist()
            for i in range(0, len(words), 50_000):
                parts.append((which[i : i + 50_000], *encode(words[i : i + 50_000])))
        size = np.zeros(len(distinct), np.int64)
        for which, _, each in parts:
            size[which] = each
        off = np.concatenate([[0], np.cumsum(size)])
        out = np.empty(off[-1], np.uint32)
        for which, ids, each in parts:
            begin = np.cumsum(each) - each
            out[np.repeat(off[which] - begin, each) + np.arange(len(ids))] = ids
        return out, off

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words) or cuts[-1] != len(ids):  # a letter that becomes two characters parts its word
            return self._any(words)
        return ids, np.diff(cuts, prepend=0)

    def _any(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        odd = [i for i, w in enumerate(words) if any(a in w for a in self.added)] if self.added else []
        if self.mark is None or odd:
            each = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(each), np.uint32), np.array([len(x) for x in each], np.int64)
        ids = np.array(self.tokenizer.encode_batch_fast([self.mark[0].join(words)], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.concatenate([[-1], np.flatnonzero(ids == self.mark[1]), [len(ids)]])
        return ids[ids != self.mark[1]], np.diff(cuts) - 1

    def texts(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, each with end_id last, and each text's first (one more than texts)."""
        raw = views(texts)[0].tobytes()
        odd = any(a[:2].encode() in raw for a in self.added)  # then words stay as they are
        words = Words(texts, self.lower and not odd, self.stops and not odd)
        flat, off, entry = self.words(words.distinct.cast(pa.large_string()))
        codes = entry[words.codes] if len(words.codes) else entry[:0]
        got = pa.LargeListArray.from_arrays(pa.array(off), pa.array(flat)).take(pa.array(codes))
        ends = np.frombuffer(got.buffers()[1], np.int64, len(got) + 1)
        values = got.values.to_numpy()[ends[0] : ends[-1]]
        if end_id is None:
            return values, ends[words.first] - ends[0]
        first = ends[words.first] - ends[0] + np.arange(len(words.first))
        ids = np.empty(first[-1], np.uint32)
        room = np.ones(len(ids), bool)
        room[first[1:] - 1] = False
        ids[room] = values
        ids[~room] = end_id
        return ids, first


@functools.cache
def worker_encoder(tokenizer_json: str) -> WordEncoder:
    """One encoder for all tasks of a worker process."""
    return WordEncoder(tokenizer_json)


#: Shards whose starts (16 bytes each) are broadcast to their payloads; beyond it both are shuffled.
BROADCAST_SHARDS = 1_000_000
SHARDS = "first_rid long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID, partitions: int | None = None) -> None:
    """Encode all texts of docs and write their ids as shards under path."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = with_row_ids(docs).repartitionByRange(partitions, "rid").sortWithinPartitions("rid").select("text", "doc_id", "rid")
    schema = pa.schema([("first_rid", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])

    def run(batches):
        encoder = worker_encoder(shared.value)
        for batch in batches:
            for part in slices(batch, most=SLICE_BYTES):
                ids, first = encoder.texts(part.column("text"), end_id)
                yield record(schema, part.column("rid").slice(0, 1), [len(ids)], [part.column("doc_id").to_pylist()], [np.diff(first)], [pack(ids)])

    rows.mapInArrow(run, SHARDS).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the shards under path: doc_id, start, n_tokens, ids (array<long>)."""
    return _documents(spark, path, "ids array<long>", lambda ids, a, b: ids[a:b].tolist(), pa.list_(pa.int64()))


def _documents(spark: SparkSession, path: str, column: str, make, kind: pa.DataType) -> DataFrame:
    shards = spark.read.schema(SHARDS).parquet(path)
    # one row a shard, without the payload: the prefix sum over them is small at any size of the corpus
    before = Window.orderBy("first_rid").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("first_rid", "n_ids").withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).select("first_rid", "start")
    few = shards.limit(BROADCAST_SHARDS + 1).count() <= BROADCAST_SHARDS
    rows = shards.join(F.broadcast(starts) if few else starts.hint("merge"), "first_rid").select("start", "doc_ids", "lengths", "payload")
    name = column.split()[0]
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), (name, kind)])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids = unpack(batch.column("payload")[i].as_py())
                lengths = batch.column("lengths")[i].values.to_numpy()
                ends = np.cumsum(lengths)
                begins = ends - lengths
                values = [make(ids, a, b) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield record(schema, batch.column("doc_ids")[i].values, begins + batch.column("start")[i].as_py(), lengths, values)

    return rows.mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")


def token_file_digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, from the files written for docs."""
    spark = docs.sparkSession
    path = table_path(spark, "tokens")
    write_token_files(docs, tokenizer_path, path)
    return _documents(spark, path, "ids_crc32 long", lambda ids, a, b: zlib.crc32(ids[a:b].astype("<u4").tobytes()), pa.int64())
