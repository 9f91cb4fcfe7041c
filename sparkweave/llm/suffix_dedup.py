"""Suffix-array dedup: remove every byte covered by a string of `length` bytes that also starts earlier.

"Earlier" is a smaller doc_id, or the same document and an earlier start; matches never cross documents and
are judged on the input. The result is exact (equal to brute force), for any text.

How: two equal strings of `length` bytes hold the same K-byte gram at the same place, the leftmost smallest of
their gram hashes (anchors.py). So only suffixes around such anchors can matter, about one in 38 positions, and
of those only the ones whose gram hash occurs twice in the corpus.

1. Count gram hashes (partial aggregation) and keep those that occur twice.
2. Join them with the anchors: both sides are plain exchanges, so AQE splits a hot gram.
3. Per document, cut out the bytes around its repeated anchors. Sampled splitters range-partition them by the
   anchor's K leading bytes; since equal strings share all of these, no group of equal strings is separated.
4. A partition is sorted by those K bytes, then by all bytes (Spark's external sort, which spills), and read in
   pieces that end where the K bytes change: the last rows of a piece are held back and compared with the next
   one's. Neighbours with equal bytes are copies as a whole. The suffixes of the others are ordered by multikey
   quicksort, eight bytes at a time: a run of equal suffixes is split by its next bytes until `length` bytes are
   equal; all but the earliest suffix of such a run are marked.
5. Anchors whose gram occurs over `hot_group` times leave the buckets: their strings are grouped by a 128-bit
   digest with partial aggregation and joined back, which no single task has to hold.

Edge cases: null and empty texts, and texts under `length` bytes, lose nothing. Rows that repeat a doc_id are
documents of their own, ordered by text. A table without rows gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import K, anchor_runs, gram_hashes
from .common import ROW, cut, discard, list_array, mapped, over_all, record, signed, views, with_row_ids

LENGTH = 100
HOT_GROUP = 50_000
#: Anchors of a bucket, about 150 bytes each, and the most buckets (their splitters go to every task).
BUCKET_ANCHORS = 25_000
MOST_BUCKETS = 50_000
#: Sampled leading bytes for each splitter.
SAMPLES = 16
#: Rows of a sorted partition that are looked at together, more only where one gram has more.
PIECE_ROWS = 20_000
FOUND = "__found"
_HOT = 1
_PLACE, _N, _AT = 1, 16, 31


def _anchor_hashes(length: int):
    schema = pa.schema([("h", pa.int64())])

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, off = views(batch.column("text"))
        return record(schema, signed(anchor_runs(data, off, length)[4]))

    return fn


def _anchors(length: int):
    """Rows (text, rid) to anchors: the gram's hash, rid, and one number for the first window, the number of windows
    and the anchor's place in the first one."""
    schema = pa.schema([("h", pa.int64()), ("rid", pa.int64()), ("run", pa.int64())])

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, off = views(batch.column("text"))
        owner, place, start, n, h = anchor_runs(data, off, length)
        rid = batch.column("rid").to_numpy(zero_copy_only=False)
        return record(schema, signed(h), rid[owner], (start - off[owner] << _AT) | (n << _N) | (place - start << _PLACE))

    return fn


def _runs(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Lists of run numbers to owner, first window, number of windows, anchor's place, hot or not."""
    lo = column.offsets.to_numpy()
    run = column.values.slice(lo[0], lo[-1] - lo[0]).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(column)), np.diff(lo))
    low = (1 << 15) - 1
    return owner, run >> _AT, run >> _N & low, run >> _PLACE & low, run & _HOT == 1


def _words(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as a number whose order is that of the bytes."""
    view = np.lib.stride_tricks.as_strided(data, shape=(len(data) - 7, 8), strides=(1, 1))
    return np.ascontiguousarray(view[at]).view(">u8")[:, 0].astype(np.uint64)


def _strings(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(size)])
    idx = np.arange(ends[-1]) + np.repeat(begin - ends[:-1], size)
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data[idx])])


def _leads(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The K bytes from each place, as byte strings that numpy can order."""
    lead = np.stack([_words(data, at + i) for i in range(0, K, 8)], axis=1).astype(">u8")
    return np.ascontiguousarray(lead).view(f"V{K}")[:, 0]


def _bucket_of(lead: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """Number of splitters at or below each lead; words are compared one after the other."""
    if not len(splitters):
        return np.zeros(len(lead), np.int32)
    both = np.concatenate([splitters, lead]).view(">u8").reshape(-1, K // 8).astype(np.uint64)
    side = np.concatenate([np.zeros(len(splitters), np.int8), np.ones(len(lead), np.int8)])
    order = np.lexsort((side, *both.T[::-1]))
    below = np.cumsum(side[order] == 0)
    out = np.empty(len(order), np.int32)
    out[order] = below
    return out[len(splitters) :]


def _snippets(length: int, splitters: np.ndarray):
    """Rows (text, rid, runs) to rows around each repeated anchor that is not hot: bucket, rid, at, n, place, bytes."""
    schema = pa.schema([("bucket", pa.int32()), ("rid", pa.int64()), ("at", pa.int32()), ("n", pa.int16()), ("place", pa.int16()), ("bytes", pa.binary())])

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, off = views(batch.column("text"))
        owner, at, n, place, hot = _runs(batch.column("runs"))
        cold = np.flatnonzero(~hot)
        owner, at, n, place = owner[cold], at[cold], n[cold], place[cold]
        begin = off[owner] + at
        rid = batch.column("rid").to_numpy(zero_copy_only=False)[owner]
        bucket = _bucket_of(_leads(data, begin + place), splitters) if len(cold) else np.zeros(0, np.int32)
        return record(schema, bucket, rid, at.astype(np.int32), n.astype(np.int16), place.astype(np.int16), _strings(data, begin, n + length - 1))

    return fn


def _hot_windows(length: int):
    """Rows (text, rid, runs) to a digest for each window of a hot anchor."""
    schema = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("rid", pa.int64()), ("at", pa.int32())])

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, off = views(batch.column("text"))
        owner, at, n, _, hot = _runs(batch.column("runs"))
        warm = np.flatnonzero(hot)
        size = n[warm]
        ends = np.concatenate([[0], np.cumsum(size)])
        step = np.arange(ends[-1]) - np.repeat(ends[:-1], size)
        idx = np.repeat(off[owner[warm]] + at[warm], size) + step
        rid = batch.column("rid").to_numpy(zero_copy_only=False)[owner[warm]]
        w1, w2 = gram_hashes(data, length)[idx], gram_hashes(data, length, 3)[idx]
        return record(schema, signed(w1), signed(w2), np.repeat(rid, size), (np.repeat(at[warm], size) + step).astype(np.int32))

    return fn


def _steps(length: int) -> list[int]:
    return [*range(0, length - 8, 8), length - 8]


def multikey_runs(data: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the suffixes data[at:], eight bytes as one key: runs that are equal so far (at first those
    of one group; groups are contiguous) are split by their next key, runs of one leave. Returns the suffixes that are
    equal to another in their first `length` bytes, run after run, each in the order given, and where a run begins."""
    order = np.arange(len(at))
    new = np.ones(len(at), bool)
    new[1:] = group[1:] != group[:-1]
    for step in _steps(length):
        alone = new & np.append(new[1:], True)
        order, new = order[~alone], new[~alone]
        if not len(order):
            break
        key = _words(data, at[order] + step)
        differ = np.zeros(len(order), bool)
        differ[1:] = (key[1:] != key[:-1]) & ~new[1:]
        if differ.any():
            run = np.cumsum(new) - 1
            split = np.zeros(run[-1] + 1, bool)
            split[run[differ]] = True
            part = np.flatnonzero(split[run])
            by = part[np.lexsort((key[part], run[part]))]
            order[part], key[part] = order[by], key[by]
            new[1:] |= key[1:] != key[:-1]
    alone = new & np.append(new[1:], True) if len(order) else new
    return order[~alone], new[~alone]


def copies_of_previous(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which strings data[off[i]:off[i+1]], of 8 bytes at least, are equal to the one before."""
    size = np.diff(off)
    same = np.zeros(len(size), bool)
    left = np.flatnonzero(size[1:] == size[:-1]) + 1
    step = 0
    while len(left):
        here = np.minimum(step, size[left] - 8)
        left = left[_words(data, off[left] + here) == _words(data, off[left - 1] + here)]
        done = size[left] <= step + 8
        same[left[done]] = True
        left = left[~done]
        step += 8
    return same


def repeated_windows(rid: np.ndarray, at: np.ndarray, n: np.ndarray, place: np.ndarray, data: np.ndarray, off: np.ndarray, length: int) -> np.ndarray:
    """Of strings data[off[i]:off[i+1]] from (rid, at), each with n windows around an anchor at `place`, ordered by the
    anchor's K bytes, then all bytes, then (rid, at): which windows are equal to one at an earlier place. Flags in the
    order of the strings' windows."""
    n = n.astype(np.int64)
    first = np.concatenate([[0], np.cumsum(n)])
    flags = np.zeros(first[-1], bool)
    lead = np.stack([_words(data, off[:-1] + place + i) for i in range(0, K, 8)], axis=1)
    gram = np.concatenate([[0], np.cumsum((lead[1:] != lead[:-1]).any(axis=1))])
    copy = copies_of_previous(data, off)
    flags[np.repeat(copy, n)] = True
    own = np.flatnonzero(~copy)
    many = np.bincount(gram[own], minlength=gram[-1] + 1) > 1
    own = own[many[gram[own]]]
    own = own[np.lexsort((at[own], rid[own], gram[own]))]
    if not len(own):
        return flags
    ends = np.concatenate([[0], np.cumsum(n[own])])
    step = np.arange(ends[-1]) - np.repeat(ends[:-1], n[own])
    window = np.repeat(first[own], n[own]) + step
    start = np.repeat(off[own], n[own]) + step
    # equal windows hold the gram at the same place
    group = np.repeat(gram[own], n[own]) * (length + 1) + np.repeat(place[own], n[own]) - step
    order = np.argsort(group, kind="stable")
    equal, new = multikey_runs(data, start[order], group[order], length)
    flags[window[order[equal[~new]]]] = True
    return flags


OUT = pa.schema([("rid", pa.int64()), ("at", pa.int32()), ("mask", pa.binary())])


def _masks(flags: np.ndarray, n: np.ndarray) -> pa.Array:
    first = np.concatenate([[0], np.cumsum(n.astype(np.int64))])
    size = (n.astype(np.int64) + 7) // 8
    ends = np.concatenate([[0], np.cumsum(size)])
    bits = np.zeros(ends[-1] * 8, bool)
    bits[np.arange(first[-1]) + np.repeat(ends[:-1] * 8 - first[:-1], n.astype(np.int64))] = flags
    packed = np.packbits(bits, bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(packed)])


def _piece(table: pa.Table, length: int) -> pa.RecordBatch:
    data, off = views(table.column("bytes"))
    rid, at, n, place = (table.column(c).to_numpy() for c in ("rid", "at", "n", "place"))
    flags = repeated_windows(rid, at, n, place.astype(np.int64), data, off, length)
    first = np.concatenate([[0], np.cumsum(n.astype(np.int64))])[:-1]
    some = np.flatnonzero(np.add.reduceat(flags, first, dtype=np.int64) > 0)
    return record(OUT, rid[some], at[some], _masks(flags, n).take(pa.array(some)))


def _sorted_rows(length: int, piece_rows: int):
    """A sorted partition in pieces that end where the lead changes; the rest is carried over the boundary."""

    def run(batches):
        held, rows, enough = [], 0, piece_rows
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < enough:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            lead = table.column("lead").chunk(0)
            last = pc.index(lead, lead[-1]).as_py()
            held = table.slice(last).to_batches()
            rows -= last
            enough = max(piece_rows, 2 * rows)
            if last:
                yield _piece(table.slice(0, last), length)
        if rows:
            yield _piece(pa.Table.from_batches(held).combine_chunks(), length)

    return run


def covered(size: int, base: np.ndarray, masks: pa.Array, length: int) -> np.ndarray:
    """Bytes (of `size`) that flagged windows cover: mask k has a bit for each window from base[k]."""
    data, off = views(masks)
    bits = np.flatnonzero(np.unpackbits(data, bitorder="little"))
    owner = np.searchsorted(off, bits >> 3, "right") - 1
    p = base[owner] + bits - 8 * off[owner]
    edge = np.bincount(p, minlength=size + 1).astype(np.int32)
    edge -= np.bincount(p + length, minlength=size + 1).astype(np.int32)
    return np.cumsum(edge[:-1]) > 0


REMOVED = "doc_id long, rid long, n_bytes long, n_removed long, n_spans long, span_starts array<int>, span_ends array<int>, kept binary"


def _apply(length: int):
    schema = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("span_starts", pa.list_(pa.int32())), ("span_ends", pa.list_(pa.int32())), ("kept", pa.binary())])

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, off = views(batch.column("text"))
        found = batch.column("found")
        lo = found.offsets.to_numpy()
        items = found.values.slice(lo[0], lo[-1] - lo[0])
        owner = np.repeat(np.arange(batch.num_rows), np.diff(lo))
        at = items.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
        gone = covered(len(data), off[owner] + at, items.field(1), length) if len(at) else np.zeros(len(data), bool)
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        begin = np.flatnonzero(gone & (edge[:-1] | ~np.concatenate([[False], gone[:-1]])))
        end = np.flatnonzero(gone & (edge[1:] | ~np.concatenate([gone[1:], [False]]))) + 1
        total = np.concatenate([[0], np.cumsum(gone)])
        first = np.searchsorted(begin, off)
        doc = np.searchsorted(off, begin, "right") - 1
        kept = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((off - total[off]).astype(np.int32)), pa.py_buffer(data[~gone])])
        spans = [list_array((x - off[doc]).astype(np.int32), first) for x in (begin, end)]
        return record(schema, batch.column("doc_id"), batch.column("rid"), np.diff(off), np.diff(total[off]), np.diff(first), *spans, kept)

    return fn


def suffix_dedup(docs: DataFrame, length: int = LENGTH, hot_group: int = HOT_GROUP, bucket_anchors: int = BUCKET_ANCHORS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row for each row of docs: doc_id, rid, n_bytes, n_removed, n_spans, span_starts and span_ends (byte
    offsets of the removed runs) and kept (the remaining bytes)."""
    docs = with_row_ids(docs)
    found = _found(docs.select("text", "rid"), length, hot_group, bucket_anchors, piece_rows)
    rows = docs.join(found, "rid", "left").select("text", "doc_id", "rid", "found")
    return mapped(rows, _apply(length), REMOVED)


def suffix_dedup_texts(docs: DataFrame, length: int = LENGTH, hot_group: int = HOT_GROUP, bucket_anchors: int = BUCKET_ANCHORS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """docs with all their columns and rows, each text without its removed characters (those of which every byte is
    removed, so texts stay valid UTF-8). n_chars, where docs has it, follows a text that has changed."""
    return over_all(docs, lambda rows: _shortened(rows, length, hot_group, bucket_anchors, piece_rows), "n_chars")


def _shortened(docs: DataFrame, length: int, hot_group: int, bucket_anchors: int, piece_rows: int) -> DataFrame:
    rows = with_row_ids(docs, ROW, every=True)
    found = _found(rows.select("text", F.col(ROW).alias("rid")), length, hot_group, bucket_anchors, piece_rows)
    found = found.select(F.col("rid").alias(ROW), F.col("found").alias(FOUND))
    rows = rows.join(found, ROW, "left").select(*docs.columns, FOUND)
    schema, names = docs.schema, docs.columns

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        marks = batch.column(FOUND)
        out = batch.select(names)
        if marks.null_count == len(marks):
            return out
        data, off = views(batch.column("text"))
        lo = marks.offsets.to_numpy()
        items = marks.values.slice(lo[0], lo[-1] - lo[0])
        owner = np.repeat(np.arange(batch.num_rows), np.diff(lo))
        gone = covered(len(data), off[owner] + items.field(0).to_numpy(zero_copy_only=False).astype(np.int64), items.field(1), length)
        heads = np.flatnonzero((data & 0xC0) != 0x80)
        size = np.diff(np.append(heads, len(data)))
        kept = np.repeat(~np.logical_and.reduceat(gone, heads), size) if len(heads) else ~gone
        ends = np.concatenate([[0], np.cumsum(kept)])[off]
        texts = pa.Array.from_buffers(pa.large_string(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(data[kept])])
        changed = pa.array(np.diff(ends) != np.diff(off))
        columns = {"text": pc.if_else(changed, texts.cast(pa.string()), batch.column("text"))}
        if "n_chars" in names:
            n = out.column("n_chars")
            columns["n_chars"] = pc.if_else(changed, pc.utf8_length(columns["text"]).cast(n.type), n)
        return pa.RecordBatch.from_arrays([columns.get(c, out.column(i)) for i, c in enumerate(names)], names=names)

    return mapped(rows, fn, schema)


def _found(texts: DataFrame, length: int, hot_group: int, bucket_anchors: int, piece_rows: int) -> DataFrame:
    """Of rows (text, rid): rid and found, the places of its windows that are equal to earlier ones."""
    if not K + 8 <= length < 1 << 15:
        raise ValueError(f"length must be from {K + 8} to {(1 << 15) - 1} bytes")
    spark = texts.sparkSession
    hashes = mapped(texts.select("text"), _anchor_hashes(length), "h long")
    twice = cut(hashes.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "grams")
    anchors = mapped(texts, _anchors(length), "h long, rid long, run long")
    repeated = anchors.join(twice.hint("merge"), "h").select("rid", F.col("run").bitwiseOR((F.col("c") > hot_group).cast("long")).alias("run"))
    runs = cut(repeated.groupBy("rid").agg(F.sort_array(F.collect_list("run")).alias("runs")), "anchors")
    discard(twice)
    is_hot = F.exists("runs", lambda x: x.bitwiseAND(F.lit(_HOT)) == _HOT)
    total, hot = runs.agg(F.sum(F.size("runs")), F.max(is_hot)).first()
    warm = []
    if hot:  # by itself, so that its shuffles are gone when the buckets are written
        some = texts.join(runs.filter(is_hot), "rid").select("text", "rid", "runs")
        windows = cut(mapped(some, _hot_windows(length), "w1 long, w2 long, rid long, at int"), "windows")
        warm = [_hot(windows)]
        discard(windows)
    splitters = _splitters(texts, runs, total or 0, bucket_anchors)
    both = texts.join(runs, "rid").select("text", "rid", "runs")
    cold = mapped(both, _snippets(length, splitters), "bucket int, rid long, at int, n short, place short, bytes binary")
    lead = F.expr(f"substring(bytes, place + 1, {K})")
    ordered = cold.repartition("bucket").select("rid", "at", "n", "place", "bytes", lead.alias("lead")).sortWithinPartitions("lead", "bytes", "rid", "at")
    flagged = ordered.mapInArrow(_sorted_rows(length, piece_rows), "rid long, at int, mask binary")
    for more in warm:
        flagged = flagged.unionByName(more)
    found = cut(flagged.groupBy("rid").agg(F.collect_list(F.struct("at", "mask")).alias("found")), "found")
    discard(runs, *warm)
    return found


def _hot(windows: DataFrame) -> DataFrame:
    """Windows (w1, w2, rid, at) that are equal to an earlier one, as a written table of masks of one window."""
    first = windows.groupBy("w1", "w2").agg(F.min(F.struct("rid", "at")).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    first = cut(first.drop("c"), "first")  # a plain table on this side lets AQE split a window that many rows share
    later = windows.join(first.hint("merge"), ["w1", "w2"]).filter(F.struct("rid", "at") > F.col("first"))
    out = cut(later.select("rid", "at", F.lit(bytes([1])).alias("mask")), "later")
    discard(first)
    return out


def _splitters(texts: DataFrame, runs: DataFrame, total: int, bucket_anchors: int) -> np.ndarray:
    """Leading bytes that cut the repeated anchors into about equal parts, from a sample with SAMPLES for each part."""
    buckets = min(MOST_BUCKETS, -(-total // bucket_anchors))
    if buckets <= 1:
        return np.zeros(0, f"V{K}")
    share = max(1, total // (SAMPLES * buckets))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, off = views(batch.column("text"))
        owner, at, _, place, hot = _runs(batch.column("runs"))
        begin = (off[owner] + at + place)[~hot]
        return pa.RecordBatch.from_arrays([_strings(data, begin, np.full(len(begin), K))], names=["lead"])

    chosen = F.pmod(F.xxhash64("rid", F.lit("splitters")), F.lit(share)) == 0
    sample = texts.filter(chosen).join(runs.filter(chosen), "rid").select("text", "runs")
    leads = sorted(bytes(r[0]) for r in mapped(sample, fn, "lead binary").limit(2 * SAMPLES * buckets).collect())
    if not leads:
        return np.zeros(0, f"V{K}")
    picked = sorted({leads[i] for i in np.linspace(0, len(leads), buckets + 1)[1:-1].astype(np.int64)})
    return np.frombuffer(b"".join(picked), f"V{K}")


def suffix_dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document."""
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[tuple[int, str | None]], length: int = LENGTH) -> list[tuple[int, int, int, int, str]]:
    """The definition itself, for small inputs in tests."""
    seen, out = set(), []
    for doc_id, text in sorted(texts, key=lambda x: x[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            window = data[p : p + length]
            if window in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
