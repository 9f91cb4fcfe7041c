"""LM scoring: a hashed maximum-entropy model over n-gram and skip features, with class-factored softmax.

Words (lower-cased in A-Z) and one end a text are tokens. A token has a class (16) and a place in the class (16). The
most frequent tokens have a place of their own in the first OWN classes. The other classes are clusters of words that occur
in like company; a word's place in its cluster is taken from its hash. The model of a token in its context is

    P(class | context) * P(place | class, context) * P(token | class and place)

The first two are softmaxes of a token's unigram share plus the weights of hashed features of the context: none, the
word before, a skip to the second word before, and the classes of the three words before. (The pair of the two words before
added 0.3 % in training and cost 0.1 % on held-out texts.) The last is the token's share (count + 0.5) of the mass of its class and place, which holds 0.5 for all unknown tokens, so the
model sums to 1.

1. Count all training tokens (distinct words of a batch first, then partial aggregation).
2. Count, over all training documents, how often each of the LISTED most frequent words has one of the COMPANY most
   frequent ones next to it or one further (a bounded table). Weighted k-means of these rows gives the clusters; a word that
   is not listed, known or not, goes to the cluster whose listed words have its letter trigrams (naive Bayes).
3. Train by distributed gradient updates: in each round the training documents of one residue of a hash (all rounds
   together cover each document once) are dealt by hash to tasks of about TASK_TOKENS tokens, whatever the cluster's
   size; each task descends from the shared weights over its own rows (AdaGrad, mini-batches), and weights are averaged
   by tokens, a few at a time, so that no task gathers all of them.
4. Score all texts in numpy batches. Counts of the HEAD most frequent words are broadcast (a bounded table); rarer
   words of a batch are joined with the table of counts by their text, so every count is exact.

Edge cases: null and empty texts have one token, the end. Without training documents N and V are 0, all tokens are
unknown and base_score is 0 a token. Null doc_ids hash as an empty text. Repeated rows count as often as they occur
and give a row each. A table without rows gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, cut, hash_strings, held_out, list_array, mapped, mix, record, slices, summed, views, with_row_ids
from .quality import BITS as GRAM_BITS
from .quality import word_features

CLASSES = PLACES = 16
#: Classes of which each place is one token; the rest are clusters.
OWN = 8
LISTED, COMPANY = 4_096, 64
BITS = 15
ROUNDS = 2
#: Most frequent words whose counts are broadcast (about 20 bytes each).
HEAD = 200_000
MINI_BATCH = 16_384
RATE = 0.15
#: Tokens of a training task, and tasks whose weights one task averages.
TASK_TOKENS = 2_000_000
FAN_IN = 32
SLICE_BYTES = 4_000_000
_END = np.uint64(0x2545F4914F6CDD1D)
_SALT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_BLOCKS = 64
_ONES = np.ones(16, np.float32)


class Leaves:
    """Class and place of tokens, as class * PLACES + place: listed words by hash, others by their letters."""

    def __init__(self, hashes: np.ndarray | None = None, clusters: np.ndarray | None = None, grams: np.ndarray | None = None, first: np.ndarray | None = None):
        """hashes: the end and the listed words, most frequent first; clusters: of each of them; grams: trigram buckets of
        the listed words, end to end, and the first of each."""
        hashes = np.array([_END]) if hashes is None else hashes
        clusters = np.zeros(len(hashes), np.int64) if clusters is None else clusters
        leaf = (OWN + clusters) * PLACES + self._place(hashes)
        # frequent words of one cluster lie together, so that a class tells much about its words
        top = np.arange(min(len(hashes), OWN * PLACES))
        leaf[top[np.argsort(clusters[top], kind="stable")]] = top
        order = np.argsort(hashes)
        self.hashes, self.leaf = hashes[order], leaf[order]
        self.logs = np.zeros((CLASSES - OWN, (1 << GRAM_BITS) + 1), np.float32)
        if grams is not None:
            counts = np.bincount(np.repeat(clusters[1:], np.diff(first)) * (1 << GRAM_BITS) + grams, minlength=(CLASSES - OWN) << GRAM_BITS).reshape(CLASSES - OWN, -1)
            self.logs[:, :-1] = np.log((counts + 0.1) / (counts.sum(axis=1, keepdims=True) + 0.1 * (1 << GRAM_BITS)))
            words = np.bincount(clusters[1:], minlength=CLASSES - OWN)
            self.prior = np.log((words + 0.5) / (words + 0.5).sum())
        else:
            self.prior = np.zeros(CLASSES - OWN)

    @staticmethod
    def _place(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(60)).astype(np.int64)

    def of(self, hashes: np.ndarray, words: pa.Array) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        out = np.where(self.hashes[at] == hashes, self.leaf[at], -1)
        rest = np.flatnonzero(out < 0)
        if len(rest):
            _, grams, first = word_features(words.take(pa.array(rest)))
            total = np.stack([summed(log[grams], first) for log in self.logs]) + self.prior[:, None]
            out[rest] = (OWN + total.argmax(axis=0)) * PLACES + self._place(hashes[rest])
        return out

    def end(self) -> int:
        return int(self.leaf[np.searchsorted(self.hashes, _END)])


def clustered(company: np.ndarray, weight: np.ndarray, k: int, rounds: int = 40) -> np.ndarray:
    """Weighted k-means of the square roots of rows' shares; the first centres are far apart. Ties to the first."""
    x = np.sqrt((company + 0.5) / (company + 0.5).sum(axis=1, keepdims=True))
    centres = x[[int(weight.argmax())]]
    while len(centres) < min(k, len(x)):
        far = ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)
        centres = np.concatenate([centres, x[[int((far * weight).argmax())]]])
    for _ in range(rounds):
        best = (x @ centres.T * 2 - (centres**2).sum(axis=1)).argmax(axis=1)
        for c in range(len(centres)):
            own = best == c
            if own.any():
                centres[c] = np.average(x[own], axis=0, weights=weight[own])
    return best


def _leaves(training: DataFrame, top: pa.Table) -> Leaves:
    """The leaves of the words of a training table; top: its most frequent words (word, c), in order."""
    top = top.slice(0, LISTED)
    names = top.column("word").combine_chunks().cast(pa.large_binary())
    if not len(names):
        return Leaves()
    hashes = hash_strings(*views(names))
    order = np.argsort(hashes)
    shared = training.sparkSession.sparkContext.broadcast((hashes[order], order))

    def run(batches):
        known, rank = shared.value
        total = np.zeros(LISTED * COMPANY, np.int64)
        for batch in batches:
            for part in slices(batch, most=SLICE_BYTES):
                words = Words(part.column("text"), lower=True)
                if not len(words.codes):
                    continue
                h = words.hashes()
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                own = np.where(known[at] == h, rank[at], -1)[words.codes]
                text = words.doc()
                for step in (1, 2):
                    a, b, same = own[:-step], own[step:], text[:-step] == text[step:]
                    for one, other in ((a, b), (b, a)):
                        good = same & (one >= 0) & (other >= 0) & (other < COMPANY)
                        total += np.bincount(one[good] * COMPANY + other[good], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "c"])

    cells = training.select("text").mapInArrow(run, "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c")).toArrow()
    shared.unpersist()
    company = np.zeros(LISTED * COMPANY)
    company[cells.column("cell").to_numpy()] = cells.column("c").to_numpy()
    clusters = clustered(company.reshape(LISTED, COMPANY)[: len(names)], top.column("c").to_numpy().astype(np.float64), CLASSES - OWN)
    _, grams, first = word_features(names)
    return Leaves(np.concatenate([[_END], hashes]), np.concatenate([[0], clusters]), grams, first)


class Tokens:
    """The tokens of a slice: three empty places, the words' hashes and the end of each text, end to end."""

    def __init__(self, texts: pa.Array, leaves: Leaves):
        words = self.words = Words(texts, lower=True)
        size = words.n + 4
        first = np.concatenate([[0], np.cumsum(size)])
        self.hash = np.zeros(first[-1], np.uint64)
        h = words.hashes() if len(words.codes) else np.zeros(0, np.uint64)
        self.distinct_leaf = leaves.of(h, words.distinct)
        leaf = np.full(first[-1], leaves.end())
        to = np.arange(len(words.codes)) + np.repeat(4 * np.arange(len(words.n)) + 3, words.n)
        if len(to):
            self.hash[to] = h[words.codes]
            leaf[to] = self.distinct_leaf[words.codes]
        self.hash[first[1:] - 1] = _END
        target = np.ones(first[-1], bool)
        target[(first[:-1, None] + np.arange(3)).ravel()] = False
        self.at = np.flatnonzero(target)
        self.leaf = leaf[self.at]
        self.cls = np.where(self.hash == 0, CLASSES, leaf // PLACES).astype(np.uint64)
        self.first = np.concatenate([[0], np.cumsum(words.n + 1)])

    def features(self, at: np.ndarray) -> np.ndarray:
        """64-bit hashes of the four features of each place."""
        seventeen = np.uint64(CLASSES + 1)
        out = np.empty((4, len(at)), np.uint64)
        out[0] = _SALT[0]
        out[1] = mix(self.hash[at - 1] + _SALT[1])
        out[2] = mix(self.hash[at - 2] + _SALT[2])
        out[3] = mix((self.cls[at - 1] * seventeen + self.cls[at - 2]) * seventeen + self.cls[at - 3] + _SALT[4])
        return out


class MaxEnt:
    """Shared log shares and weights: classes by feature, places by feature and class."""

    def __init__(self, mass: np.ndarray, weights: np.ndarray | None = None, square: np.ndarray | None = None):
        self.mass = mass
        grid = mass.reshape(CLASSES, PLACES)
        self.class_log = np.log(grid.sum(axis=1) / grid.sum()).astype(np.float32)
        self.place_log = np.log(grid / grid.sum(axis=1, keepdims=True)).astype(np.float32)
        self.weights = np.zeros((2, 1 << BITS, 16), np.float32) if weights is None else weights
        self.square = np.full((2, 1 << BITS, 16), 1e-6, np.float32) if square is None else square

    def forward(self, features: np.ndarray, leaf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, log probabilities and target of the class and of the place."""
        cls, place = leaf // PLACES, leaf % PLACES
        out = []
        for level, (base, target) in enumerate(((self.class_log, cls), (self.place_log[cls], place))):
            keys = features if level == 0 else features ^ mix((cls + 1).astype(np.uint64) * _SALT[3])
            rows = (mix(keys) >> np.uint64(64 - BITS)).astype(np.int16)
            z = self.weights[level].take(rows[1], axis=0)
            for r in rows[2:]:
                z += self.weights[level].take(r, axis=0)
            z += self.weights[level].take(rows[0], axis=0) + base if level else self.weights[level][rows[0, 0]] + base
            np.minimum(z, 60, out=z)
            z -= np.log(np.exp(z) @ _ONES)[:, None]
            out.append((rows, z, target))
        return out

    def score(self, tokens: Tokens) -> np.ndarray:
        """log10 of P(class and place | context), summed over each text."""
        leaf = tokens.leaf
        value = np.empty(len(leaf), np.float32)
        for a in range(0, len(leaf), MINI_BATCH):
            at = tokens.at[a : a + MINI_BATCH]
            parts = self.forward(tokens.features(at), leaf[a : a + MINI_BATCH])
            value[a : a + MINI_BATCH] = sum(z[np.arange(len(at)), t] for _, z, t in parts)
        return summed(value, tokens.first) / math.log(10)

    def learn(self, tokens: Tokens) -> None:
        """One pass of AdaGrad mini-batches."""
        leaf = tokens.leaf
        for a in range(0, len(leaf), MINI_BATCH):
            at = tokens.at[a : a + MINI_BATCH]
            for level, (rows, z, target) in enumerate(self.forward(tokens.features(at), leaf[a : a + MINI_BATCH])):
                g = np.exp(z)
                g[np.arange(len(at)), target] -= 1
                # gradients of equal rows are added: 16-bit keys sort by radix. The first feature has few rows (one, or
                # one a class), whose sums are a product with indicators.
                keys = rows[1:].ravel()
                order = keys.argsort(kind="stable")
                ranked = keys[order]
                first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
                sums = np.add.reduceat(np.ascontiguousarray(g.T).take(order % len(at), axis=1), first, axis=1).T
                few, which = np.unique(rows[0], return_inverse=True)
                heads = np.eye(len(few), dtype=np.float32).take(which, axis=0).T @ g
                touched, where = np.unique(np.concatenate([ranked[first], few]), return_inverse=True)
                gradient = np.zeros((len(touched), 16), np.float32)
                gradient[where[: len(first)]] = sums
                gradient[where[len(first) :]] += heads
                square = self.square[level].take(touched, axis=0) + gradient**2
                self.square[level][touched] = square
                self.weights[level][touched] -= RATE * gradient / np.sqrt(square)


def _vocabulary(training: DataFrame) -> DataFrame:
    """(word, c) of all training words."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, most=SLICE_BYTES):
                words = Words(part.column("text"), lower=True)
                if len(words.codes):
                    yield record(schema, words.distinct.cast(pa.binary()), np.bincount(words.codes, minlength=len(words.distinct)))

    rows = training.select("text").mapInArrow(run, "word binary, c long")
    return cut(rows.groupBy("word").agg(F.sum("c").alias("c")), "vocabulary")


def _masses(vocabulary: DataFrame, leaves: Leaves) -> tuple[np.ndarray, int, int]:
    """c + 0.5 of the words of each leaf, and how many words and distinct words there are."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(leaves)

    def run(batches):
        for batch in batches:
            words = batch.column("word").cast(pa.large_binary())
            leaf = shared.value.of(hash_strings(*views(words)), words)
            c = np.bincount(leaf, weights=batch.column("c").to_numpy(), minlength=CLASSES * PLACES).astype(np.int64)
            types = np.bincount(leaf, minlength=CLASSES * PLACES)
            some = np.flatnonzero(types)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(c[some]), pa.array(types[some])], names=["leaf", "c", "types"])

    found = vocabulary.select("word", "c").mapInArrow(run, "leaf long, c long, types long").groupBy("leaf").agg(F.sum("c").alias("c"), F.sum("types").alias("types")).collect()  # a row a leaf
    mass = np.full(CLASSES * PLACES, 0.5)
    for r in found:
        mass[r["leaf"]] += r["c"] + 0.5 * r["types"]
    return mass, sum(r["c"] for r in found), sum(r["types"] for r in found)


def _train(training: DataFrame, model: MaxEnt, leaves: Leaves, tokens: int, rounds: int = ROUNDS) -> MaxEnt:
    """training: text, rid. Rounds of local descent and averaging. The tasks of a round follow its tokens, and their
    weights are averaged FAN_IN at a time, so neither small nor large inputs gather much in one place."""
    spark = training.sparkSession
    size = 2 * (1 << BITS) * 16 // _BLOCKS
    tasks = max(1, -(-tokens // (rounds * TASK_TOKENS)))

    def average(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tokens")
        tokens = pdf["tokens"].to_numpy(np.float64)
        out = [sum(np.frombuffer(b, np.float32).astype(np.float64) * t for b, t in zip(pdf[c], tokens, strict=True)) / tokens.sum() for c in ("weights", "square")]
        return pd.DataFrame({"block": [key[0]], "task": [key[1]], "tokens": [int(tokens.sum())], "weights": [out[0].astype(np.float32).tobytes()], "square": [out[1].astype(np.float32).tobytes()]})

    kind = "block int, task int, tokens long, weights binary, square binary"
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((model.mass, model.weights, model.square, leaves))

        def run(batches, shared=shared):
            mass, weights, square, leaves = shared.value
            own, task, seen = None, None, 0

            def learned() -> pa.RecordBatch:
                w, q = own.weights.ravel(), own.square.ravel()
                cuts = [slice(b * size, b * size + size) for b in range(_BLOCKS)]
                return pa.RecordBatch.from_pydict({"block": pa.array(range(_BLOCKS), pa.int32()), "task": pa.array([task] * _BLOCKS, pa.int32()), "tokens": pa.array([seen] * _BLOCKS, pa.int64()), "weights": [w[c].tobytes() for c in cuts], "square": [q[c].tobytes() for c in cuts]})

            for batch in batches:
                deal = batch.column("deal").to_numpy()
                edges = np.concatenate([[0], np.flatnonzero(deal[1:] != deal[:-1]) + 1, [len(deal)]])
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    if a == b:
                        continue
                    if deal[a] != task:
                        if seen:
                            yield learned()
                        own, task, seen = MaxEnt(mass, weights.copy(), square.copy()), int(deal[a]), 0
                    for part in slices(batch.slice(a, b - a)):
                        tokens = Tokens(part.column("text"), leaves)
                        own.learn(tokens)
                        seen += len(tokens.at)
            if seen:
                yield learned()

        # a deal is trained by itself in the order of its rows, whichever partition it lies in
        deal = F.pmod(F.xxhash64("rid", F.lit("deal")), F.lit(tasks)).cast("int")
        part = training.filter(F.pmod(F.xxhash64("rid"), F.lit(rounds)) == k).withColumn("deal", deal)
        dealt = part.repartition(tasks, "deal").sortWithinPartitions("deal", "rid").select("text", "deal")
        merged, groups = dealt.mapInArrow(run, kind), tasks
        while groups > 1:
            groups = -(-groups // FAN_IN)
            merged = merged.withColumn("task", F.col("task") % groups).groupBy("block", "task").applyInPandas(average, kind)
        rows = merged.select("block", "weights", "square").collect()
        shared.unpersist()
        if rows:
            rows.sort()
            weights, square = (np.concatenate([np.frombuffer(r[i], np.float32) for r in rows]).reshape(2, 1 << BITS, 16) for i in (1, 2))
            model = MaxEnt(model.mass, weights, square)
    return model


def _score(head: pa.Table, model: MaxEnt, leaves: Leaves, docs: DataFrame, total: int, known: int, ends: int) -> DataFrame:
    """Per slice: a row for each text (rid, n, what head words and the end give) and a row for each rarer distinct
    word (word, leaf, rids, times)."""
    shared = docs.sparkSession.sparkContext.broadcast((head.column("word").combine_chunks(), head.column("c").to_numpy(), model, leaves))
    schema = pa.schema([("rid", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("masses", pa.float64()), ("context", pa.float64()), ("word", pa.binary()), ("rids", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])
    log_mass = np.log10(model.mass)
    end_log = math.log10(ends + 0.5)
    end_leaf = leaves.end()

    def run(batches):
        names, counts, model, leaves = shared.value
        for batch in batches:
            for part in slices(batch, most=SLICE_BYTES // 2):
                tokens = Tokens(part.column("text"), leaves)
                words, n = tokens.words, part.num_rows
                at = pc.fill_null(pc.index_in(words.distinct.cast(pa.binary()), names), -1).to_numpy() if len(words.distinct) else np.zeros(0, np.int32)
                logs = np.where(at >= 0, np.log10(counts[np.maximum(at, 0)] + 0.5) if len(counts) else 0.0, 0.0)
                code, first = words.codes, words.first
                masses = log_mass[tokens.distinct_leaf]
                seen = at >= 0
                rid = part.column("rid").to_numpy()
                none = pa.nulls(n, pa.binary()), pa.nulls(n, schema.field("rids").type), pa.nulls(n, schema.field("times").type)
                yield record(schema, rid, words.n + 1, summed(seen[code], first).astype(np.int64) + (ends > 0), summed(logs[code], first) + end_log, summed(masses[code], first) + log_mass[end_leaf], model.score(tokens), *none)
                rare = np.flatnonzero(~seen[code])
                if len(rare):
                    pair, times = np.unique(code[rare].astype(np.int64) * n + words.doc()[rare], return_counts=True)
                    which, doc = pair // n, pair % n
                    new = np.concatenate([[True], which[1:] != which[:-1]])
                    start = np.append(np.flatnonzero(new), len(pair))
                    k = int(new.sum())
                    zero = [pa.nulls(k, schema.field(i).type) for i in range(6)]
                    yield record(schema, *zero, words.distinct.take(pa.array(which[new])).cast(pa.binary()), list_array(rid[doc], start), list_array(times.astype(np.int32), start))

    return docs.select("text", "rid").mapInArrow(run, "rid long, n_tokens long, n_known long, logs double, masses double, context double, word binary, rids array<long>, times array<int>")


def lm_scores(docs: DataFrame, training: DataFrame | None = None, head: int = HEAD) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row of docs (and rid). training holds the
    columns of docs; by default it is docs without what held_out(1) names."""
    spark = docs.sparkSession
    rows = with_row_ids(docs).withColumn("held_out", held_out(1))
    training = rows.filter(~F.col("held_out")) if training is None else with_row_ids(training)
    vocabulary = _vocabulary(training)
    top = vocabulary.select("word", "c").orderBy(F.desc("c"), "word").limit(head).toArrow()
    leaves = _leaves(training, top)
    mass, total, types = _masses(vocabulary, leaves)
    ends = training.count()
    if ends:
        mass[leaves.end()] += ends + 0.5
    total, types = total + ends, types + (ends > 0)
    base = math.log10(total + 0.5 * (types + 1))
    model = _train(training.select("text", "rid"), MaxEnt(mass), leaves, total) if ends else MaxEnt(mass)
    scored = cut(_score(top, model, leaves, rows, total, types, ends), "scores")
    rare = scored.filter("word is not null").select("word", F.arrays_zip("rids", "times").alias("in"))
    rare = rare.join(vocabulary.select("word", "c").hint("merge"), "word", "left").select(F.coalesce("c", F.lit(0)).alias("c"), F.explode("in").alias("in"))
    rare = rare.groupBy(F.col("in.rids").alias("rid")).agg(F.sum(F.when(F.col("c") > 0, F.col("in.times")).otherwise(0)).alias("known"), F.sum(F.col("in.times") * F.log10(F.col("c") + 0.5)).alias("logs_rare"))
    each = scored.filter("word is null").join(rare.hint("merge"), "rid", "left")
    logs = F.col("logs") + F.coalesce("logs_rare", F.lit(0.0))
    each = each.select(
        "rid",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        (logs - F.col("masses") + F.col("context")).alias("score"),
    )
    return rows.select("doc_id", "rid", "held_out").join(each.hint("merge"), "rid")


def lm_scoring(docs: DataFrame) -> DataFrame:
    return lm_scores(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
