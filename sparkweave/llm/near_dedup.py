"""MinHash near-dedup: documents whose multisets of five-word shingles have a weighted Jaccard of 0.8 or more.

Signatures are BagMinHash: a shingle's weight (its count) is cut into dyadic levels (0,1], (1,2], (2,4], ...;
each level has its own Poisson process over time, seeded by shingle and level, whose points carry a signature
place and a height. A point counts if its height is under the weight, and a place keeps its earliest point.
Points are drawn in order of time for all documents of a batch at once, and a shingle stops as soon as its next
point comes after the latest place kept by its document, so most shingles draw one or two points in all.
Two signatures agree in a place with probability equal to the weighted Jaccard.

1. Texts with the same words (128-bit key) collapse to their smallest row.
2. Signatures are cut into 25 bands of 5 places: a pair at 0.8 shares a band with probability 0.99995.
3. Each row is compared with the smallest row it shares a band with: their multiset overlap is computed from texts.
4. Groups that are still in several classes: while they are large for their rows, each row outside the largest class
   meets a few members of it (others in each round). Then, in blocks of BLOCK_ROWS, all rows outside a group's largest
   class meet all rows of the group; a block counts overlaps as products of indicator matrices and returns only
   which classes its links join. So no pair that shares a band loses its link, and no pairs are sent anywhere.
5. Classes are the connected components of the links.

Edge cases: texts without a word (null, empty, white space) are alone in their class. A text of under five
words has one shingle, all its words. Repeated doc_ids are rows of their own. Ties: the smallest row stands for
its class. A table without rows gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..storage import cut_counted
from .common import ROW, Words, cut, list_array, mapped, mix, over_all, record, sequence_key, signed, with_row_ids, wrap

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
#: Candidate ids under this number (8 bytes each) are broadcast to the texts; beyond it they are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Members of the largest class that the other rows of a group meet in a round, and rounds at most; pairs across
#: classes for each row from which on rounds are worth their jobs.
LEADERS, ROUNDS = 8, 4
CROSS_PER_ROW = 500
#: Rows of a block; shingles of the small groups that are compared in one task.
BLOCK_ROWS = 500
TASK_SHINGLES = 1_000_000
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(words: Words, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's windows of `size` words, sorted in each text, and each text's first."""
    h = words.hashes()[words.codes]
    total = len(h)
    acc = np.zeros(max(total - size + 1, 0), np.uint64)
    for j in range(size):
        acc += mix(h[j : total - size + 1 + j] + wrap(int(_C[j % 5]) * (j + 1)))
    n = np.where(words.n >= size, words.n - size + 1, (words.n > 0).astype(np.int64))
    off = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(off[-1], np.uint64)
    full = np.flatnonzero(words.n >= size)
    if len(full):
        idx = np.arange(int(n[full].sum())) + np.repeat(words.first[:-1][full] - np.concatenate([[0], np.cumsum(n[full])[:-1]]), n[full])
        to = np.arange(len(idx)) + np.repeat(off[:-1][full] - np.concatenate([[0], np.cumsum(n[full])[:-1]]), n[full])
        out[to] = mix(acc[idx])
    few = np.flatnonzero((words.n > 0) & (words.n < size))
    if len(few):
        out[off[:-1][few]] = sequence_key(h, words.first, 5)[few]
    for i in range(len(n)):
        out[off[i] : off[i + 1]].sort()
    return out, off


def counted(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each sorted text: text, value, count."""
    n = len(values)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    new = np.ones(n, bool)
    new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    return doc[start], values[start], np.diff(np.append(start, n))


def bag_min_hash(doc: np.ndarray, value: np.ndarray, count: np.ndarray, docs: int, places: int = BANDS * ROWS) -> np.ndarray:
    """Signatures (docs x places) of weighted sets given as rows (doc, value, count). A text without rows has 0s."""
    best = np.full(docs * places, np.inf)
    kept = np.zeros(docs * places, np.uint64)
    owner, seed, low, width, weight = [], [], [], [], []
    level, lower, size = 0, 0, 1
    rows = np.arange(len(value))
    while len(rows):
        owner.append(doc[rows])
        seed.append(mix(value[rows] + wrap(int(_C[0]) * (level + 1))))
        low.append(np.full(len(rows), lower, np.float64))
        width.append(np.full(len(rows), size, np.float64))
        weight.append(count[rows])
        lower, level = lower + size, level + 1
        size = lower
        rows = rows[count[rows] > lower]
    if not owner:
        return kept.reshape(docs, places)
    owner, seed, low, width, weight = map(np.concatenate, (owner, seed, low, width, weight))
    time = np.zeros(len(seed))
    step = 0
    while len(seed):
        step += 1
        point = mix(seed + wrap(int(_C[1]) * step))
        time = time - np.log((point >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / (width * places)
        draw = mix(point ^ _C[2])
        place = (draw >> np.uint64(33)).astype(np.int64) % places
        height = low + width * ((draw & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32)
        counts = height < weight
        at, when, who = (owner * places + place)[counts], time[counts], draw[counts]
        np.minimum.at(best, at, when)
        won = best[at] == when
        kept[at[won]] = who[won]
        latest = best.reshape(docs, places).max(axis=1)
        go = time < latest[owner]
        owner, seed, low, width, weight, time = (x[go] for x in (owner, seed, low, width, weight, time))
    return kept.reshape(docs, places)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    acc = np.zeros((len(signature), bands), np.uint64)
    for r in range(rows):
        acc = mix(acc * _C[3] + signature.reshape(-1, bands, rows)[:, :, r])
    return mix(acc + np.arange(1, bands + 1, dtype=np.uint64) * _C[4])


def _signatures():
    schema = pa.schema([("rid", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column("text"))
        values, off = shingles(words)
        n = np.diff(off)
        keys = band_keys(bag_min_hash(*counted(values, off), len(n)))
        h = words.hashes()[words.codes]
        ends = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))])
        bands = list_array(signed(keys[n > 0].ravel()), ends)
        return record(schema, batch.column("rid"), signed(sequence_key(h, words.first, 1)), signed(sequence_key(h, words.first, 2)), n, bands)

    return fn


def overlaps(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Weighted Jaccard of the shingle multisets of each pair of texts."""
    (va, oa), (vb, ob) = shingles(Words(a)), shingles(Words(b))
    out = np.zeros(len(oa) - 1)
    for i in range(len(out)):
        x, y = va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]
        ux, cx = np.unique(x, return_counts=True)
        uy, cy = np.unique(y, return_counts=True)
        _, ix, iy = np.intersect1d(ux, uy, assume_unique=True, return_indices=True)
        same = int(np.minimum(cx[ix], cy[iy]).sum())
        total = len(x) + len(y) - same
        out[i] = same / total if total else 0.0
    return out


def _verify(similarity: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = pa.array(overlaps(batch.column("text"), batch.column("other")) >= similarity)
        return record(schema, batch.column("a").filter(good), batch.column("b").filter(good))

    return fn


def _linked(pairs: DataFrame, texts: DataFrame, similarity: float, rows: int) -> tuple[DataFrame, int]:
    """Those of the pairs (a, b), of which there are `rows`, whose texts are similar enough; and how many."""
    ids, n = cut_counted(pairs.select(F.col("a").alias("rid")).union(pairs.select(F.col("b").alias("rid"))).distinct(), "candidates", 2 * rows)
    texts = texts.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids.hint("merge"), "rid", "left_semi")
    texts = cut(texts, "texts")
    one, two = texts.select(F.col("rid").alias("a"), "text"), texts.select(F.col("rid").alias("b"), F.col("text").alias("other"))
    both = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("text", "other", "a", "b")
    return cut_counted(mapped(both, _verify(similarity), "a long, b long"), "verified")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of docs: doc_id, rid, class_rid (the smallest row of its class), n_shingles."""
    docs = with_row_ids(docs)
    found = _classes(docs.select("text", "rid"), similarity)
    return docs.select("doc_id", "rid").join(found.hint("merge"), "rid")


def _classes(texts: DataFrame, similarity: float) -> DataFrame:
    """rid, class_rid, n_shingles of rows (text, rid)."""
    spark = texts.sparkSession
    signed_rows = cut(mapped(texts, _signatures(), "rid long, k1 long, k2 long, n long, bands array<long>"), "signatures")
    full = signed_rows.filter("n > 0")
    same = cut(full.groupBy("k1", "k2", "n").agg(F.min("rid").alias("rep")), "exact")
    members = signed_rows.select("rid", "k1", "k2", "n").join(same.hint("merge"), ["k1", "k2", "n"], "left").select("rid", F.coalesce("rep", "rid").alias("rep"), "n")
    reps = full.join(same.select(F.col("rep").alias("rid")).hint("merge"), "rid", "left_semi")
    rows = reps.select("rid", "n", F.explode("bands").alias("band"))
    shared, n_bands = cut_counted(rows.groupBy("band").agg(F.min("rid").alias("leader"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c"), "bands")
    grouped, n_rows = cut_counted(rows.join(shared.hint("merge"), "band").select("band", "leader", "rid", "n"), "groups")
    # one leader a row: the smallest of its groups
    stars = grouped.filter("leader <> rid").groupBy("rid").agg(F.min("leader").alias("a")).select("a", F.col("rid").alias("b"))
    stars, n_pairs = cut_counted(stars, "pairs", n_rows)
    links, _ = _linked(stars, texts, similarity, n_pairs)
    found = connected_components(links)
    classes = grouped.select("rid").distinct().join(found.select(F.col("id").alias("rid"), "component").hint("merge"), "rid", "left")
    classes = cut(classes.select("rid", F.coalesce("component", "rid").alias("class")), "classes", n_rows)
    for turn in range(ROUNDS + 1):
        placed = cut(grouped.select("band", "rid", "n").join(classes.hint("merge"), "rid"), "placed", n_rows)
        sizes = placed.groupBy("band", "class").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n")).groupBy("band")
        sizes = sizes.agg(F.max(F.struct("c", "class")).alias("big"), F.sum("c").alias("rows"), F.sum(F.col("c") * F.col("c")).alias("squares"), F.sum("n").alias("n")).filter("rows > big.c")
        cross_of = ((F.col("rows") * F.col("rows") - F.col("squares")) / 2).alias("cross")
        seen = Observation()
        sizes = sizes.select("band", "rows", F.col("big.c").alias("big_rows"), F.col("big.class").alias("big"), cross_of, F.col("n").alias("shingles"))
        sizes = cut(sizes.observe(seen, F.sum("rows").alias("rows"), F.sum("cross").alias("cross"), F.sum("shingles").alias("shingles")), "split", n_bands)
        rows, cross = seen.get["rows"], seen.get["cross"]
        if not rows:
            break
        last = turn == ROUNDS or cross <= CROSS_PER_ROW * rows
        open_rows = cut(placed.join(sizes.drop("cross", "shingles").hint("merge"), "band"), "open", n_rows)
        if last:
            joined = _compare_blocks(open_rows, texts, similarity, rows, seen.get["shingles"])
        else:
            joined = _meet_leaders(open_rows, texts, similarity, turn, rows)
        moved = connected_components(joined).select(F.col("id").alias("class"), "component")
        classes = cut(classes.join(moved.hint("merge"), "class", "left").select("rid", F.coalesce("component", "class").alias("class")), "classes", n_rows)
        if last:
            break
    found = members.join(classes.withColumnRenamed("rid", "rep").hint("merge"), "rep", "left")
    return found.select("rid", F.coalesce("class", "rep").alias("class_rid"), F.col("n").alias("n_shingles"))


def _meet_leaders(open_rows: DataFrame, texts: DataFrame, similarity: float, turn: int, n: int) -> DataFrame:
    """Classes (a, b) joined when each row outside the largest class of its group, in one of its groups, meets some
    members of that class."""
    x = open_rows.filter("class <> big").groupBy("rid").agg(F.min_by(F.struct("band", "n", "class"), F.xxhash64("band", F.lit(turn))).alias("r"))
    x = x.select("r.band", *(F.col(c).alias(f"{c}_x") for c in ("rid",)), F.col("r.n").alias("n_x"), F.col("r.class").alias("class_x"))
    y = open_rows.filter((F.col("class") == F.col("big")) & (F.pmod(F.xxhash64("rid", F.lit(turn)), F.col("big_rows")) < LEADERS))
    y = y.select("band", *(F.col(c).alias(f"{c}_y") for c in ("rid", "n", "class")))
    pairs = x.join(y.hint("merge"), "band").filter(F.expr(f"least(n_x, n_y) >= {similarity}D * greatest(n_x, n_y)"))
    pairs, n = cut_counted(pairs.select(F.least("rid_x", "rid_y").alias("a"), F.greatest("rid_x", "rid_y").alias("b")).distinct(), "pairs", LEADERS * n)
    links, _ = _linked(pairs, texts, similarity, n)
    own = open_rows.select("rid", "class").distinct()
    for end in ("a", "b"):
        links = links.join(own.select(F.col("rid").alias(end), F.col("class").alias(f"class_{end}")).hint("merge"), end)
    return links.select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))


def _multisets():
    """Each text's shingles as a set: the k-th copy of a shingle is an element of its own."""
    schema = pa.schema([("rid", pa.int64()), ("items", pa.list_(pa.int64()))])

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, off = shingles(Words(batch.column("text")))
        _, _, count = counted(values, off)
        begin = np.cumsum(count) - count
        copy = (np.arange(len(values)) - np.repeat(begin, count)).astype(np.uint64)
        items = np.where(copy > 0, mix(values + copy * _C[1]), values)
        return record(schema, batch.column("rid"), list_array(signed(items), off))

    return fn


def overlap_counts(items: np.ndarray, off: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many elements each set of `left` shares with each of `right`; sets are items[off[i]:off[i+1]]."""
    size = np.diff(off)
    owner = np.repeat(np.arange(len(size)), size)
    _, column, often = np.unique(items, return_inverse=True, return_counts=True)
    some = often[column] > 1  # an element of one set is shared with none
    names, column = np.unique(column[some], return_inverse=True)
    owner = owner[some]
    total = np.zeros((len(left), len(right)), np.float32)
    place_l, place_r = np.full(len(size), -1), np.full(len(size), -1)
    place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
    width = max(1, 20_000_000 // max(len(left) + len(right), 1))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, len(names), width):
        lo, hi = np.searchsorted(column, [at, at + width])
        o, c = owner[lo:hi], column[lo:hi] - at
        sides = []
        for place, n in ((place_l, len(left)), (place_r, len(right))):
            m = np.zeros((n, min(width, len(names) - at)), np.float32)
            own = place[o] >= 0
            m[place[o[own]], c[own]] = 1
            sides.append(m)
        total += sides[0] @ sides[1].T
    return total


def _joined_classes(similarity: float):
    """Blocks of rows (band, rid, class, side, items) to the classes (a, b) that links between them join."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def block(classes: np.ndarray, side: np.ndarray, items: np.ndarray, off: np.ndarray) -> set[tuple[int, int]]:
        left = np.flatnonzero(side != 2)
        right = left if (side == 0).all() else np.flatnonzero(side == 2)
        same = overlap_counts(items, off, left, right).astype(np.float64)
        size = np.diff(off)
        union = size[left][:, None] + size[right][None, :] - same
        i, j = np.nonzero((same / np.maximum(union, 1) >= similarity) & (classes[left][:, None] != classes[right][None, :]))
        a, b = classes[left[i]], classes[right[j]]
        return set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True))

    def fn(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        order = pa.array(np.argsort(table.column("band").to_numpy(), kind="stable"))
        table = table.take(order).combine_chunks()
        band, classes, side = (table.column(c).to_numpy() for c in ("band", "class", "side"))
        lists = table.column("items").chunk(0)
        off = lists.offsets.to_numpy().astype(np.int64)
        items = lists.values.to_numpy()
        start = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]]))
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        found = []
        for a, b in zip(start, np.append(start[1:], len(band)), strict=True):
            for x, y in sorted(block(classes[a:b], side[a:b], items[off[a] : off[b]], off[a : b + 1] - off[a])):
                p, q = find(x), find(y)
                if p != q:  # a forest of the block's links is enough
                    parent[max(p, q)] = min(p, q)
                    found.append((x, y))
        return pa.Table.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], schema=schema)

    return fn


def _compare_blocks(open_rows: DataFrame, texts: DataFrame, similarity: float, n: int, n_shingles: int) -> DataFrame:
    """Classes (a, b) that links join, between the rows outside each group's largest class and all its rows. Small
    groups are dealt by a hash of their band, large ones as pairs of blocks, so no group is gathered in one task."""
    tasks = max(1, -(-n_shingles // TASK_SHINGLES))
    blocks = lambda c: F.ceil(F.greatest(c, F.lit(1)) / BLOCK_ROWS).cast("int")
    others, largest = blocks(F.col("rows") - F.col("big_rows")), blocks(F.col("big_rows"))
    is_big = F.col("class") == F.col("big")
    own = F.pmod(F.xxhash64("rid"), F.when(is_big, largest).otherwise(others)).cast("int")
    seat = lambda group, kind, i, j, side: F.struct(group.alias("group"), F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    zero, band = F.lit(0), F.col("band")
    upto = lambda c: F.sequence(zero, c - 1)
    small = F.array(seat(F.pmod(F.xxhash64("band"), F.lit(tasks)), "small", zero, zero, zero))
    of_other = F.concat(
        F.transform(upto(others), lambda k: seat(band, "others", F.least(k, own), F.greatest(k, own), F.when(k == own, 0).when(own < k, 1).otherwise(2))),
        F.transform(upto(largest), lambda k: seat(band, "largest", own, k, F.lit(1))),
    )
    of_big = F.transform(upto(others), lambda k: seat(band, "largest", k, own, F.lit(2)))
    seats = F.when(F.col("rows") <= BLOCK_ROWS, small).when(is_big, of_big).otherwise(of_other)
    seated = open_rows.select("band", "rid", "class", F.explode(seats).alias("s")).select("band", "rid", "class", "s.*")
    ids, k = cut_counted(open_rows.select("rid").distinct(), "candidates", n)
    sets = texts.join(F.broadcast(ids) if k <= BROADCAST_IDS else ids.hint("merge"), "rid", "left_semi")
    sets = cut(mapped(sets.select("text", "rid"), _multisets(), "rid long, items array<long>"), "sets")
    rows = seated.join(sets.hint("merge"), "rid")
    joined = rows.groupBy("group", "kind", "i", "j").applyInArrow(_joined_classes(similarity), "a long, b long")
    return cut(joined, "joined")


def near_classes(rows: DataFrame, row: str = ROW, similarity: float = SIMILARITY) -> DataFrame:
    """id, class of rows (text and the column `row`, a distinct number each): the smallest number of its class."""
    return _classes(rows.select("text", F.col(row).alias("rid")), similarity).select(F.col("rid").alias("id"), F.col("class_rid").alias("class"))


def near_dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without the rows that are not the smallest of their class; all columns stay."""
    return over_all(docs, lambda rows: _smallest(rows, similarity))


def _smallest(docs: DataFrame, similarity: float) -> DataFrame:
    rows = with_row_ids(docs, ROW, every=True)
    classes = _classes(rows.select("text", F.col(ROW).alias("rid")), similarity)
    keep = classes.filter("rid = class_rid").select(F.col("rid").alias(ROW))
    return rows.join(keep.hint("merge"), ROW, "left_semi").select(*docs.columns)
