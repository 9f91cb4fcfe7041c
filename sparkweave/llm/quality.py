"""Quality rules: base counts of a text, and a logistic regression over hashed word and character n-grams.

A text's features are the means over its words of one bucket for the word and of buckets for the character
trigrams of the word with its ends marked, and the mean over its pairs of neighbouring words of a bucket for the pair,
so that the order of words counts. The regression is trained on a bounded, documented sample of labelled
rows (SAMPLE_PER_CLASS of either label, smallest hash of doc_id first), its probability is calibrated on the part
of the sample that it was not trained on with the labels' true shares, and texts are kept at a fixed THRESHOLD.
The model is linear, so a distinct word of an Arrow batch has one weight and a text's score is the mean of its
words' weights and of its pairs' weights.

Edge cases: null and empty texts have zeros and fail the base rule. Labels that are null, of unknown documents or
in conflict are not learned from (of texts that share a labelled doc_id, the first in order is); with one class or none in the sample only the base rule decides. Repeated
rows give a row each. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, Words, char_grams, codepoints, filtered, hash_strings, list_array, mapped, mix, record, views

BITS = 15
SAMPLE_PER_CLASS = 2_000
THRESHOLD = 0.5
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def counts(texts: pa.Array, words: Words | None = None) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    words = words or Words(texts)
    data, off = words.chars
    begins = np.concatenate([[0], np.cumsum(((data & 0xC0) != 0x80) & ~WS[data])])
    marks = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    n = len(off) - 1
    lines, repeats = np.zeros(n, np.int64), np.zeros(n, np.int64)
    raw = data.tobytes()
    codes = words.codes.astype(np.int64)
    wide = len(words.distinct) >= 1 << 21
    for i in range(n):
        text = raw[off[i] : off[i + 1]]
        if b"\n" in text:
            rows = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
            lines[i] = len(rows) - len(set(rows))
        c = codes[words.first[i] : words.first[i + 1]]
        if len(c) > 3:
            if wide:
                c = np.unique(c, return_inverse=True)[1].astype(np.int64)
                pair = np.unique(c[:-2] * (len(c) + 1) + c[1:-1], return_inverse=True)[1].astype(np.int64)
                key = pair * (len(c) + 1) + c[2:]
            else:
                key = (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
            order = key.argsort(kind="stable")
            ranked = key[order]
            same = ranked[1:] == ranked[:-1]
            if same.any():
                often = np.zeros(len(key) + 2, bool)
                at = np.concatenate([order[1:][same], order[:-1][same]])
                often[at] = often[at + 1] = often[at + 2] = True
                repeats[i] = often.sum()
    return {"n_words": words.n, "word_chars": np.diff(begins[off]), "n_symbols": np.diff(marks[off]), "n_dup_lines": lines, "n_repeat_words": repeats}


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def word_features(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each distinct word: its bucket; then its trigrams' buckets end to end and their first places."""
    data, off = views(distinct)
    word = (hash_strings(data, off, 9) >> np.uint64(64 - BITS)).astype(np.int64)
    points, begin = codepoints(data, off)
    marked = np.full(len(points) + 2 * len(distinct), 36, np.uint32)  # $ at either end
    where = np.arange(len(points)) + 2 * np.repeat(np.arange(len(distinct)), np.diff(begin)) + 1
    marked[where] = points
    ends = begin + 2 * np.arange(len(begin))
    grams = char_grams(marked, ends, 3, BITS)
    inside = grams < 1 << BITS
    first = np.concatenate([[0], np.cumsum(inside)])[ends]
    return word, grams[inside].astype(np.int64), first


def pair_features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each pair of neighbouring words, text after text, and each text's first pair."""
    h = words.hashes()[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    first = np.concatenate([[0], np.cumsum(np.maximum(words.n - 1, 0))])
    inside = np.ones(max(len(h) - 1, 0), bool)
    inside[words.first[1:-1][(words.first[1:-1] > 0) & (words.first[1:-1] < len(h))] - 1] = False
    pair = mix(h[:-1] * _PAIR + h[1:])[inside]
    return (pair >> np.uint64(64 - BITS)).astype(np.int64), first


class QualityModel:
    """Weights of 3 * 2**BITS buckets (words, trigrams, pairs), bias, and the calibration's slope and offset."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float = 1.0, offset: float = 0.0):
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset

    def probability(self, words: Words) -> np.ndarray:
        """Calibrated probability that each text is good; 0 for a text without words."""
        if not len(words.codes):
            return np.zeros(len(words.n))
        word, grams, first = word_features(words.distinct)
        value = self.weights[word] + np.add.reduceat(self.weights[(1 << BITS) + grams], first[:-1]) / np.diff(first)
        total = np.concatenate([[0.0], np.cumsum(value[words.codes])])[words.first]
        pair, start = pair_features(words)
        pairs = np.concatenate([[0.0], np.cumsum(self.weights[(2 << BITS) + pair])])[start]
        z = np.diff(total) / np.maximum(words.n, 1) + np.diff(pairs) / np.maximum(words.n - 1, 1) + self.bias
        return np.where(words.n > 0, 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -50, 50))), 0.0)


def _sparse():
    schema = pa.schema([("good", pa.int32()), ("bucket", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))])

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column("text"))
        word, grams, first = word_features(words.distinct)
        each = np.diff(first)
        pair, start = pair_features(words)
        buckets, values, sizes = [], [], []
        for i in range(batch.num_rows):
            code, times = np.unique(words.codes[words.first[i] : words.first[i + 1]], return_counts=True)
            idx = np.repeat(first[code] - np.concatenate([[0], np.cumsum(each[code])[:-1]]), each[code]) + np.arange(each[code].sum()) if len(code) else np.zeros(0, np.int64)
            pairs = pair[start[i] : start[i + 1]]
            at = np.concatenate([word[code], (1 << BITS) + grams[idx], (2 << BITS) + pairs])
            w = np.concatenate([times, np.repeat(times / np.maximum(each[code], 1), each[code])]) / max(words.n[i], 1)
            w = np.concatenate([w, np.full(len(pairs), 1 / max(len(pairs), 1))])
            u, inv = np.unique(at, return_inverse=True)
            buckets.append(u.astype(np.int32))
            values.append(np.bincount(inv, weights=w, minlength=len(u)).astype(np.float32))
            sizes.append(len(u))
        off = np.concatenate([[0], np.cumsum(sizes)])
        return record(schema, batch.column("good"), list_array(np.concatenate(buckets), off), list_array(np.concatenate(values), off))

    return fn


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> QualityModel | None:
    """Train on at most per_class labelled documents of either class."""
    votes = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("good"), F.max("quality").alias("most")).filter("good = most")
    shares = {r["good"]: r["count"] for r in votes.groupBy("good").count().collect()}
    if len(shares) < 2:
        return None
    by_class = [votes.filter(F.col("good") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    ids = by_class[0].union(by_class[1]).select("doc_id", "good")
    rows = mapped(docs.select("text", "doc_id").join(F.broadcast(ids), "doc_id").select("text", F.col("good").cast("int").alias("good"), "doc_id").groupBy("doc_id", "good").agg(F.min("text").alias("text")).select("text", "good"), _sparse(), "good int, bucket array<int>, value array<float>").toArrow().combine_chunks()
    good = rows.column("good").to_numpy()
    if len(np.unique(good)) < 2:
        return None
    bucket, value = rows.column("bucket").chunk(0), rows.column("value").chunk(0)
    off = bucket.offsets.to_numpy().astype(np.int64)
    at, x = bucket.values.to_numpy(), value.values.to_numpy().astype(np.float64)
    off, at, x = off - off[0], at[off[0] : off[-1]], x[off[0] : off[-1]]
    return train(good, off, at, x, {0: shares[0], 1: shares[1]})


def train(good: np.ndarray, off: np.ndarray, at: np.ndarray, x: np.ndarray, shares: dict[int, int], rounds: int = 150, penalty: float = 1e-6) -> QualityModel:
    row = np.repeat(np.arange(len(good)), np.diff(off))
    held = np.zeros(len(good), bool)
    for k in (0, 1):  # every fourth row of a class calibrates
        held[np.flatnonzero(good == k)[::4]] = True
    weight = np.where(good == 1, 0.5 / max(1, ((good == 1) & ~held).sum()), 0.5 / max(1, ((good == 0) & ~held).sum())) * ~held
    w, bias, square, bias_square = np.zeros(3 << BITS), 0.0, np.full(3 << BITS, 1e-12), 1e-12
    for _ in range(rounds):
        z = np.bincount(row, weights=x * w[at], minlength=len(good)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - good) * weight
        gradient = np.bincount(at, weights=error[row] * x, minlength=len(w)) + penalty * w
        square += gradient**2
        w -= 0.5 * gradient / np.sqrt(square)
        step = error.sum()
        bias_square += step**2
        bias -= 0.5 * step / np.sqrt(bias_square)
    z = np.bincount(row, weights=x * w[at], minlength=len(good)) + bias
    total = shares[0] + shares[1]
    z, y = z[held], good[held]
    real = np.where(y == 1, shares[1] / total / max(1, (y == 1).sum()), shares[0] / total / max(1, (y == 0).sum()))
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton steps with a weak pull to slope 1
        p = 1 / (1 + np.exp(-np.clip(slope * z + offset, -50, 50)))
        e, v = (p - y) * real, p * (1 - p) * real + 1e-12
        g = np.array([(e * z).sum() + 1e-3 * (slope - 1), e.sum()])
        h = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-9]])
        move = np.linalg.solve(h, g)
        slope, offset = slope - np.clip(move[0], -1, 1), offset - np.clip(move[1], -1, 1)
    return QualityModel(w, bias, max(slope, 1e-3), offset)


RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score(docs: DataFrame, model: QualityModel | None, *keep: str, threshold: float = THRESHOLD) -> DataFrame:
    """Columns `keep` of docs with the base counts, base_failed, p_good and kept."""
    from pyspark.sql.types import BooleanType, DoubleType, LongType, StructType

    rows = docs.select("text", *keep)
    out = StructType([rows.schema[c] for c in keep])
    for c in RESULT:
        out = out.add(c, LongType())
    out = out.add("base_failed", BooleanType()).add("p_good", DoubleType()).add("kept", BooleanType())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        words = Words(batch.column("text"))
        found = counts(batch.column("text"), words)
        failed = base_failed(found["n_words"], found["n_repeat_words"])
        p = model.probability(words) if model else np.ones(batch.num_rows)
        columns = [batch.column(c) for c in keep] + [pa.array(found[c].astype(np.int64)) for c in RESULT]
        columns += [pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))]
        return pa.RecordBatch.from_arrays(columns, names=out.names)

    return mapped(rows, fn, out)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and p_good of every document."""
    model = fit(docs, labels)
    return score(docs, model, "doc_id").select("doc_id", *RESULT, "base_failed", "kept", "p_good")


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that quality_rules keeps."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def keep(batch: pa.RecordBatch) -> np.ndarray:
        words = Words(batch.column("text"))
        found = counts(batch.column("text"), words)
        good = ~base_failed(found["n_words"], found["n_repeat_words"])
        return good & (shared.value.probability(words) >= threshold) if shared.value else good

    return filtered(docs, keep)
