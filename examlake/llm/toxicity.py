"""Toxicity by a convolutional text classifier.

Words are hashed to embeddings; filters of several widths run over the text, the strongest response of each is pooled and a
logistic layer scores the pooled values. Training is numpy on a bounded sample of labelled rows; scoring runs in Spark's tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examlake.llm.anchors import list_parts
from examlake.llm.common import fresh, full_text, text_key

if TYPE_CHECKING:  # the driver's tables; tasks do without
    import pandas as pd

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BITS, PREFIX = 17, 4  # of an embedding's number; characters of a word's beginning
DIM, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
# Bounds of the training sample: rows, and words of a row.
MOST_ROWS, MOST_WORDS = 6_000, 4_000
THRESHOLD = 0.3
LEAST_TEXTS = 3  # training texts a word must stand in to get an embedding
UPDATES, FOLDS, FOLD_UPDATES = 900, 3, 600
SEED = 29
STEP_TOKENS = 1 << 17  # tokens scored at once


def word_codes(text: Column) -> Column:
    """Three embedding numbers per word, packed in a long: two of the word, one of its first characters."""
    words = F.array_remove(F.split(F.lower(text), SEPARATORS), "")
    low, part = (1 << 2 * BITS) - 1, (1 << BITS) - 1
    return F.transform(
        words,
        lambda w: F.xxhash64(w).bitwiseAND(F.lit(low)).bitwiseOR(
            F.shiftleft(F.xxhash64(F.substring(w, 1, PREFIX), F.lit(1)).bitwiseAND(F.lit(part)), 2 * BITS)
        ),
    )


def held_out(doc_id: Column | str = "doc_id") -> Column:
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    words: np.ndarray  # embeddings of words and of beginnings; the last row of each is zero
    starts: np.ndarray
    filters: list[np.ndarray]  # (width, DIM, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] | None = None

    def embed(self, codes: np.ndarray) -> np.ndarray:
        a, b, c = split_codes(codes)
        return self.words[a] + self.words[b] + self.starts[c]

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.out[:-1] + self.out[-1]

    def pooled(self, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Strongest responses of texts laid end to end; a long text is worked on in overlapping parts."""
        widest = max(WIDTHS)
        result = np.zeros((len(offsets) - 1, FILTERS * len(WIDTHS)), np.float32)
        jobs = []
        for i in range(len(offsets) - 1):
            for begin in range(int(offsets[i]), max(int(offsets[i + 1]), int(offsets[i]) + 1), STEP_TOKENS):
                jobs.append((i, begin, min(begin + STEP_TOKENS + widest - 1, int(offsets[i + 1]))))
        k = 0
        while k < len(jobs):
            size, first = 0, k
            while k < len(jobs) and (k == first or size + jobs[k][2] - jobs[k][1] <= STEP_TOKENS):
                size += jobs[k][2] - jobs[k][1]
                k += 1
            group = jobs[first:k]
            lengths = np.array([e - b for _, b, e in group])
            x = np.zeros((int(lengths.sum()) + widest * (len(group) + 1), DIM), np.float32)
            begins = np.cumsum(lengths + widest) - lengths - widest
            place = np.repeat(begins - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
            if len(place):
                x[place] = self.embed(np.concatenate([codes[b:e] for _, b, e in group]))
            for w, (f, bias) in enumerate(zip(self.filters, self.bias)):
                y = x[: len(x) - widest] @ f[0] if len(f) == 1 else sum(x[o : len(x) - widest + o] @ f[o] for o in range(len(f)))
                y = np.maximum(y + bias, 0)
                for beyond in range(1, widest):  # these windows would reach into the next text
                    y[begins + lengths + beyond] = 0
                for (i, _, end), at, n in zip(group, begins, lengths):
                    if end < offsets[i + 1]:  # a part's last words are whole windows in the next part only
                        y[at + n - len(f) + 1 : at + n + widest] = 0
                top = np.maximum.reduceat(y, begins, axis=0)
                for (i, _, _), row in zip(group, top):
                    cell = slice(w * FILTERS, (w + 1) * FILTERS)
                    result[i, cell] = np.maximum(result[i, cell], row)
        return result

    def score(self, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return sigmoid(a * self.logit(self.pooled(codes, offsets)) + b)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def split_codes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = codes.view(np.uint64)
    part = np.uint64((1 << BITS) - 1)
    return tuple((codes >> np.uint64(s) & part).astype(np.int64) for s in (0, BITS, 2 * BITS))


def sample(docs: DataFrame, labels: DataFrame) -> pd.DataFrame:
    """At most MOST_ROWS training rows with a label, in a seeded order: ``toxic, lang, codes``.

    Held-out rows, null labels and texts of more than MOST_WORDS words are left out. Only their ids are broadcast. An id with
    several labels is toxic if one says so.
    """
    known = labels.filter("toxic is not null and doc_id is not null").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(SEED))
    chosen = known.orderBy(order, "doc_id").limit(MOST_ROWS).select(F.col("doc_id").alias(i := fresh("id")), F.col("toxic").alias(y := fresh("toxic")))
    rows = docs.join(F.broadcast(chosen), docs["doc_id"] == F.col(i)).select(
        F.col(i).alias("doc_id"), F.col(y).alias("toxic"), docs["lang"], text_key(docs["text"]).alias("key"), word_codes(full_text(docs["text"])).alias("codes")
    )
    # Of several texts of one id that with the least key, then language, wherever they stand.
    one = rows.filter(F.size("codes") <= MOST_WORDS).groupBy("doc_id").agg(F.min(F.struct("key", "lang", "toxic", "codes")).alias("r"))
    # By Arrow, so that the driver holds arrays of numbers instead of Python lists.
    table = one.select("doc_id", "r.toxic", "r.lang", "r.codes").toArrow()
    return table.to_pandas().sort_values("doc_id")


def fit_rows(rows: pd.DataFrame, updates: int = UPDATES, docs_per_step: int = 32, rate: float = 0.05, fit: np.ndarray | None = None) -> Model:
    """Fit by Adagrad on the rows ``fit`` (all by default); the scale of scores is left open."""
    rng = np.random.default_rng(SEED)
    n = 1 << BITS
    model = Model(
        rng.normal(0, 0.1, (n, DIM)).astype(np.float32),
        rng.normal(0, 0.1, (n, DIM)).astype(np.float32),
        [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.full(FILTERS, 0.05, np.float32) for _ in WIDTHS],
        np.concatenate([rng.normal(0, 0.3, FILTERS * len(WIDTHS)), [-1.0]]).astype(np.float32),
        thresholds={},
    )
    if rows.empty or rows["toxic"].nunique() < 2:
        model.scale, share = (0.0, 0.0), float(rows["toxic"].mean()) if len(rows) else 0.0
        model.scale = (0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
        return model
    codes = [np.asarray(c, np.int64) for c in rows["codes"]]
    y = rows["toxic"].to_numpy(np.float32)
    if fit is None:
        fit = np.arange(len(rows))
    known = common_numbers([codes[i] for i in fit])
    # A word met in few texts tells one from another, not toxic from clean: it stays neutral, as an unknown one is.
    model.words[~known[0]] = 0
    model.starts[~known[1]] = 0
    weights = [model.words, model.starts, *model.filters, *model.bias, model.out]
    squares = [np.full(w.shape, 1e-2, np.float32) for w in weights]

    def update(k: int, at, gradient) -> None:
        squares[k][at] += gradient**2
        weights[k][at] -= rate * gradient / np.sqrt(squares[k][at])

    # Batches of texts of like length; toxic ones are drawn as often as others.
    by_length = fit[np.argsort([len(codes[i]) for i in fit], kind="stable")]
    toxic, clean = by_length[y[by_length] == 1], by_length[y[by_length] == 0]
    half = docs_per_step // 2
    for _ in range(updates):
        q = rng.random()
        chosen = []
        for kind in (toxic, clean):
            middle = int(q * len(kind))
            low = max(0, min(middle - half, len(kind) - 2 * half))
            chosen.append(rng.choice(kind[low : low + 2 * half], min(half, len(kind)), replace=False))
        batch = np.concatenate(chosen)
        length = max(max((len(codes[i]) for i in batch), default=1), max(WIDTHS)) + max(WIDTHS)
        ids = np.zeros((len(batch), length), np.int64)
        real = np.zeros((len(batch), length), bool)
        for r, i in enumerate(batch):
            ids[r, : len(codes[i])], real[r, : len(codes[i])] = codes[i], True
        a, b, c = split_codes(ids.ravel())
        x = ((model.words[a] + model.words[b] + model.starts[c]) * real.ravel()[:, None]).reshape(len(batch), length, DIM)
        pooled, places = [], []
        for f, bias in zip(model.filters, model.bias):
            span = length - len(f) + 1
            z = sum(x[:, o : o + span] @ f[o] for o in range(len(f))) + bias
            at = z.argmax(axis=1)
            pooled.append(np.take_along_axis(z, at[:, None], axis=1)[:, 0])
            places.append(at)
        raw = np.concatenate(pooled, axis=1)
        top = np.maximum(raw, 0)
        error = (sigmoid(model.logit(top)) - y[batch]) / len(batch)
        back = error[:, None] * model.out[:-1] * (raw > 0)
        update(len(weights) - 1, slice(None), np.concatenate([top.T @ error, [error.sum()]]) + 1e-4 * model.out)
        grid = np.arange(len(batch))[:, None]
        touched, slopes = [], []
        for w, (f, at) in enumerate(zip(model.filters, places)):
            g = back[:, w * FILTERS : (w + 1) * FILTERS]
            slope = np.zeros_like(f)
            for o in range(len(f)):
                here = x[grid, at + o]  # (texts, filters, DIM)
                slope[o] = np.einsum("bfd,bf->df", here, g)
                touched.append(((grid * length + at + o).ravel()))
                slopes.append((g[:, :, None] * f[o].T[None]).reshape(-1, DIM))
            update(2 + w, slice(None), slope)
            update(2 + len(WIDTHS) + w, slice(None), g.sum(axis=0))
        flat, slope = np.concatenate(touched), np.concatenate(slopes)
        inside = real.ravel()[flat] & (np.abs(slope).sum(axis=1) > 0)
        flat, slope = flat[inside], slope[inside]
        for k, number in ((0, np.concatenate([a[flat], b[flat]])), (1, c[flat])):
            slope_of = np.concatenate([slope, slope]) if k == 0 else slope
            learnt = known[k][number]
            number, slope_of = number[learnt], slope_of[learnt]
            unique, inverse = np.unique(number, return_inverse=True)
            total = np.zeros((len(unique), DIM), np.float32)
            np.add.at(total, inverse, slope_of)
            update(k, unique, total)
    return model


def common_numbers(codes: list[np.ndarray], least: int = LEAST_TEXTS) -> tuple[np.ndarray, np.ndarray]:
    """Which embedding numbers, of words and of beginnings, stand in at least ``least`` of the texts."""
    found = np.zeros((2, 1 << BITS), np.int32)
    for c in codes:
        a, b, start = split_codes(np.unique(c))
        found[0][np.unique(np.concatenate([a, b]))] += 1
        found[1][np.unique(start)] += 1
    return found[0] >= least, found[1] >= least


def logits(model: Model, codes: list[np.ndarray]) -> np.ndarray:
    offsets = np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int64)
    return model.logit(model.pooled(np.concatenate(codes) if codes else np.zeros(0, np.int64), offsets))


def train(rows: pd.DataFrame) -> Model:
    """A model of all rows, whose scale and thresholds come from rows that were not trained on.

    Each of FOLDS parts is scored by a model of the other parts, so that every labelled row serves to calibrate, however few there are.
    """
    model = fit_rows(rows)
    if rows.empty or rows["toxic"].nunique() < 2:
        return model
    codes = [np.asarray(c, np.int64) for c in rows["codes"]]
    y, fold = rows["toxic"].to_numpy(np.float32), np.empty(len(rows), np.int64)
    rng = np.random.default_rng(SEED + 1)
    for kind in (0, 1):  # each part has its share of toxic rows
        at = np.flatnonzero(y == kind)
        fold[at] = rng.permutation(len(at)) % FOLDS
    outside = np.zeros(len(rows))
    for k in range(FOLDS):
        rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(own) and 0 < y[rest].sum() < len(rest):
            outside[own] = logits(fit_rows(rows, fit=rest, updates=FOLD_UPDATES), [codes[i] for i in own])
    _calibrate(model, outside, y, rows["lang"].fillna("").to_numpy())
    return model


def _calibrate(model: Model, logit: np.ndarray, y: np.ndarray, lang: np.ndarray) -> None:
    """Scale scores to probabilities on rows not trained on, and choose each language's threshold there.

    A language's threshold is the one with the best F1 among its rows, drawn towards the common THRESHOLD by as much as 20 toxic rows weigh.
    """
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(500):
        p = sigmoid(a * logit + b)
        a, b = max(0.05, a - 0.05 * float(((p - target) * logit).mean() + 1e-4 * (a - 1))), b - 0.2 * float((p - target).mean())
    model.scale = (float(a), float(b))
    p = sigmoid(a * logit + b)
    for name in np.unique(lang):
        own, toxic = p[lang == name], y[lang == name] == 1
        cuts = np.linspace(0.1, 0.9, 33)
        f1 = [2 * (toxic & (own >= c)).sum() / max(1, (own >= c).sum() + toxic.sum()) for c in cuts]
        best = float(np.mean(cuts[np.array(f1) >= max(f1) - 1e-9])) if toxic.any() else THRESHOLD
        trust = toxic.sum() / (toxic.sum() + 20)
        model.thresholds[str(name)] = float(trust * best + (1 - trust) * THRESHOLD)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    return train(sample(docs, labels))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: ``doc_id, text_key, lang, score`` from the text alone. Null and empty texts get the score of no words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = list_parts(batch.column(3))
            score = shared.value.score(values.view(np.int64), offsets).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(score)], ["doc_id", "text_key", "lang", "score"])

    rows = docs.select("doc_id", text_key().alias("text_key"), "lang", word_codes(full_text()).alias("codes"))
    return rows.mapInArrow(run, "doc_id bigint, text_key bigint, lang string, score double")


def lang_threshold(model: Model) -> Column:
    """The threshold of a row's language; THRESHOLD for one not met in training, or null."""
    limit = F.lit(THRESHOLD)
    for name, value in (model.thresholds or {}).items():
        limit = F.when(F.coalesce("lang", F.lit("")) == name, F.lit(value)).otherwise(limit)
    return limit


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``scores`` with ``held_out``, ``predicted`` (score of THRESHOLD or more), and ``rejected`` by ``lang_threshold``.

    Repeated rows are scored each; null and empty texts get the score of no words; a very long text is worked on in parts; an
    empty table gives no rows; of other columns none is read.
    """
    model = fit(docs, labels)
    rows = scores(docs, model).withColumn("lang_threshold", lang_threshold(model))
    return rows.withColumns(
        {
            "held_out": held_out(),
            "predicted": (F.col("score") >= THRESHOLD).cast("int"),
            "rejected": F.col("score") >= F.col("lang_threshold"),
        }
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rejected ones, in one pass over the rows; all columns stay.

    Only the numbers of the words go to Python and only scores come back: the rows stay in the JVM.
    """
    model = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(codes: pa.Array) -> pa.Array:
        values, offsets = list_parts(codes)
        return pa.array(shared.value.score(values.view(np.int64), offsets).astype(np.float64))

    return docs.filter(score(word_codes(full_text())) < lang_threshold(model))
