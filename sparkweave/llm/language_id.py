"""Language ID: multinomial naive Bayes over hashed character n-grams (1 to 3, lower-cased).

Training counts n-grams per language over every training document on the executors; a table of languages x
buckets (bounded: MAX_LANGS x 2**BITS) goes to the driver and back as the log-probability matrix. Scoring
gathers rows of that matrix for whole texts in numpy and adds the languages' shares of the training documents as priors.
`score` is the posterior of the chosen language, flattened by a temperature.

The posterior only ranks the learned languages, so a text must also fit the chosen one: its fit is the mean log
probability of its n-grams plus an allowance for chance in short texts (SLACK standard errors). Nothing is learned from
the rows that held_out(0) names. Of the others, a model without the ones that held_out(4) names is tried on these:
those whose label is the chosen language give each language its least fit, their LEAST_SHARE quantile, or DEVIATIONS
standard deviations under their mean if that is lower, and the temperature is the one that makes their labels most
likely. A language with under LEAST_ROWS such rows has no least fit. The model that predicts counts all of them.

Edge cases: a text that is null, has no letter or does not fit is `und` with score 0, as is every text if nothing was learned.
Ties go to the first language in alphabetical order. Null doc_ids hash as an empty text. Repeated rows count as
often as they occur. lang, source and doc_id are not inputs of a prediction. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import char_grams, codepoints, filtered, held_out, mapped, record, slices, summed, views

BITS = 15
ORDERS = (1, 2, 3)
MAX_LANGS = 512
UND = "und"
#: Posterior under which language_filter takes a text for no learned language.
LEAST_SCORE = 0.5
LEAST_SHARE, DEVIATIONS, LEAST_ROWS, SLACK = 0.001, 5.0, 20, 3.0
#: Bins a unit of fit in which rows are counted, and the temperatures that are tried.
FIT_BINS = 100
HEATS = tuple(2.0**i for i in range(9))


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return codepoints(*views(pc.utf8_lower(texts)))


def has_letter(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)


class LanguageModel:
    """Log probabilities by language and bucket, the languages' log priors, the standard deviation of the former in each
    language, its least fit, and the temperature of the posterior."""

    def __init__(self, langs: list[str], counts: np.ndarray, docs: np.ndarray, least: np.ndarray | None = None, heat: float = 1.0):
        size = counts.shape[1]
        self.langs = langs
        self.logs = np.zeros((len(langs), size + 1), np.float32)
        self.logs[:, :size] = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * size))
        self.priors = np.log((docs + 0.5) / (docs.sum() + 0.5 * len(langs)))
        share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        level = (share * self.logs[:, :size]).sum(axis=1)
        self.spread = np.sqrt(np.maximum((share * self.logs[:, :size] ** 2).sum(axis=1) - level**2, 0))
        self.least = np.full(len(langs), -np.inf) if least is None else least
        self.heat = heat

    def totals(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each text in each language, with its prior, and the texts' code points."""
        points, off = _points(texts)
        totals = np.repeat(self.priors[:, None], len(off) - 1, axis=1)
        for n in ORDERS:
            buckets = char_grams(points, off, n, BITS)
            for k in range(len(self.langs)):
                totals[k] += summed(self.logs[k][buckets], off)
        return totals, np.diff(off)

    def evidence(self, totals: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each text's language, and the text's fit to it."""
        best = totals.argmax(axis=0)
        grams = sum(np.maximum(size - n + 1, 0) for n in ORDERS)
        fit = (totals.max(axis=0) - self.priors[best]) / np.maximum(grams, 1) + SLACK * self.spread[best] / np.sqrt(np.maximum(size, 1))
        return best, fit

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of each text's language, its posterior, and whether the text has a letter and fits."""
        totals, size = self.totals(texts)
        best, fit = self.evidence(totals, size)
        return best, 1 / np.exp((totals - totals.max(axis=0)) / self.heat).sum(axis=0), has_letter(texts) & (fit >= self.least[best])


def fit(training: DataFrame) -> tuple[LanguageModel, np.ndarray] | None:
    """Learn from all rows (text, lang, later) with a lang: the model of the rows that are not later, and the counts of
    all: n-grams by bucket, then what is no n-gram, then texts."""
    training = training.filter("lang is not null").select("text", "lang", "later")
    langs = sorted(r[0] for r in training.select("lang").distinct().limit(MAX_LANGS + 1).collect())
    if not langs:
        return None
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    names, size = pa.array(langs), 1 << BITS

    def count(batches):
        # a row of cells for each language and half: the buckets, one for no n-gram, one for the number of texts
        total = np.zeros(2 * len(langs) * (size + 2), np.int64)
        for batch in batches:
            for part in slices(batch):
                points, off = _points(part.column("text"))
                later = part.column("later").to_numpy(zero_copy_only=False).astype(np.int64)
                which = (pc.index_in(part.column("lang"), names).to_numpy() + len(langs) * later) * (size + 2)
                base = np.repeat(which, np.diff(off))
                for n in ORDERS:
                    total += np.bincount(base + char_grams(points, off, n, BITS), minlength=len(total))
                total += np.bincount(which + size + 1, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "c"])

    cells = training.mapInArrow(count, "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c")).toArrow()
    counts = np.zeros(2 * len(langs) * (size + 2))
    counts[cells.column("cell").to_numpy()] = cells.column("c").to_numpy()
    early, late = counts.reshape(2, len(langs), size + 2)
    return LanguageModel(langs, early[:, :size], early[:, size + 1]), early + late


def calibrated(tried: LanguageModel, counts: np.ndarray, later: DataFrame) -> LanguageModel:
    """The model of counts (buckets, no n-gram, texts by language) with the least fits and the temperature that the rows
    (text, lang) give to a model that has not seen them."""
    shared = later.sparkSession.sparkContext.broadcast(tried)

    def count(batches):
        model, heats = shared.value, np.zeros(len(HEATS))
        names = pa.array(model.langs)
        for batch in batches:
            for part in slices(batch):
                totals, size = model.totals(part.column("text"))
                best, fit = model.evidence(totals, size)
                true = pc.fill_null(pc.index_in(part.column("lang"), names), -1).to_numpy(zero_copy_only=False)
                letters = has_letter(part.column("text"))
                known = np.flatnonzero((true >= 0) & letters)
                for i, heat in enumerate(HEATS):
                    z = (totals[:, known] - totals[:, known].max(axis=0)) / heat
                    heats[i] += (np.log(np.exp(z).sum(axis=0)) - z[true[known], np.arange(len(known))]).sum()
                own = (true == best) & letters
                cells, c = np.unique(np.stack([best[own], np.floor(fit[own] * FIT_BINS).astype(np.int64)]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells[0]), pa.array(cells[1]), pa.array(c.astype(np.float64))], names=["k", "bin", "c"])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(HEATS), -1)), pa.array(np.arange(len(HEATS))), pa.array(heats)], names=["k", "bin", "c"])

    cells = later.filter("lang is not null").select("text", "lang").mapInArrow(count, "k long, bin long, c double").groupBy("k", "bin").agg(F.sum("c").alias("c")).orderBy("k", "bin").toArrow()
    which, bins, c = (cells.column(i).to_numpy() for i in ("k", "bin", "c"))
    least = np.full(len(tried.langs), -np.inf)
    for k in np.unique(which[which >= 0]):
        at, times = bins[which == k] / FIT_BINS, c[which == k]
        if times.sum() >= LEAST_ROWS:
            mean = np.average(at, weights=times)
            low = at[np.searchsorted(np.cumsum(times), LEAST_SHARE * times.sum(), "right")]
            least[k] = min(low, mean - DEVIATIONS * np.sqrt(np.average((at - mean) ** 2, weights=times)))
    loss = c[which == -1]
    return LanguageModel(tried.langs, counts[:, : 1 << BITS], counts[:, -1], least, HEATS[int(loss.argmin())] if len(loss) else 1.0)


def learned(docs: DataFrame) -> LanguageModel | None:
    """Learned from the rows that held_out(0) does not name, and calibrated on a part of them."""
    rows = docs.filter(~held_out(0)).withColumn("later", held_out(4))
    found = fit(rows)
    return found and calibrated(*found, rows.filter("later"))


def predict(docs: DataFrame, model: LanguageModel | None, *keep: str) -> DataFrame:
    """Columns `keep` of docs with lang_pred and score."""
    rows = docs.select("text", *keep)
    if model is None:
        return rows.select(*keep, F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"))
    from pyspark.sql.types import DoubleType, StringType, StructType

    out = StructType([rows.schema[c] for c in keep]).add("lang_pred", StringType()).add("score", DoubleType())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        best, score, known = model.score(batch.column("text"))
        names = pa.array(np.array(model.langs, object)[best], pa.string())
        columns = [batch.column(c) for c in keep]
        columns += [pc.if_else(pa.array(known), names, UND), pa.array(np.where(known, score, 0.0))]
        return pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score"])

    return mapped(rows, fn, out)


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the documents that are not held out."""
    model = learned(docs)
    return predict(docs.select("doc_id", "text", held_out(0).alias("held_out")), model, "doc_id", "held_out")


def language_filter(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs, with all their columns, whose language is known: not `und` (so they fit it), posterior of `least` or more.
    If nothing was learned, texts with a letter stay."""
    shared = docs.sparkSession.sparkContext.broadcast(learned(docs))

    def keep(batch: pa.RecordBatch) -> np.ndarray:
        if not shared.value:
            return has_letter(batch.column("text"))
        _, score, known = shared.value.score(batch.column("text"))
        return known & (score >= least)

    return filtered(docs, keep)
