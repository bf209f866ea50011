"""Toxicity: a character n-gram linear classifier with naive Bayes scaled features.

Every feature is the presence of a hashed character n-gram, scaled by its naive Bayes
log-count ratio between toxic and other texts; a logistic regression on the scaled features
gives the score.  Only n-grams whose ratio is far from chance are features, so ordinary text
adds nothing however long it is, and a text's score does not drift with its length.

Training takes at most ``Settings.most_labelled`` labelled rows (by hash order, so reruns
agree); only their ids and sparse features reach the driver.  Scoring is one pass over the
whole texts without a shuffle.

Defined results: a null or empty text has no feature and gets the intercept's score; a text
shorter than an n-gram likewise.  Repeated rows are scored once each.  Labels of one id
combine by maximum; null labels are left out.  Without labelled texts of both kinds the
score is the smoothed share of toxic labels for every text.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.llm.arrays import SPACE, Texts, mix, range_hashes, slices
from quillgate.llm.shared import carried, documents_of, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])
_CHUNK = 1 << 12
_SLICE = 1 << 18  #: bytes of text whose n-grams are held at a time
_BUFFER = 1 << 20  #: n-grams that are counted at a time
_ROWS = 512  #: rows of a batch whose texts are copied at a time


@dataclass(frozen=True)
class Settings:
    orders: tuple[int, ...] = (3, 4, 5, 6)
    bits: int = 20  #: n-grams are hashed into 2**bits features
    most_labelled: int = 20_000  #: bound of the labelled sample the classifier is fitted on
    smoothing: float = 1.0
    least_texts: int = 5  #: a feature occurs in so many labelled texts
    least_z: float = 4.0  #: and its log-count ratio is so many standard errors from zero
    least_ratio: float = 1.5  #: and at least so large
    penalty: float = 1e-4
    steps: int = 400
    threshold: float = 0.3


@dataclass(frozen=True)
class Model:
    """``values`` of the used ``features``: the fitted weight times the log-count ratio."""

    features: np.ndarray
    values: np.ndarray
    intercept: float
    settings: Settings

    @property
    def weights(self) -> np.ndarray:
        """The value of every feature; zero if unused."""
        return _dense(self.features, self.values, self.settings)

    @property
    def base_score(self) -> float:
        """The score of a text without features."""
        return float(1 / (1 + np.exp(-np.clip(self.intercept, -30, 30))))


def _slices(column: pa.Array) -> Iterator[tuple[int, int, Texts]]:
    """``slices`` of a few rows after another, so that a whole batch is never copied."""
    for lo in range(0, len(column), _ROWS):
        for at, to, texts in slices(column.slice(lo, _ROWS), _SLICE):
            yield lo + at, lo + to, texts


def _grams(texts: Texts, settings: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(byte start, feature) of every n-gram, one order at a time.  White space is one class."""
    low = texts.lowered()
    low.data[SPACE[low.data]] = 0x20
    chars = low.char_starts()
    prefix = low.byte_prefix()
    edges = np.append(chars, len(low.data))
    row_end = np.searchsorted(chars, low.offsets[1:])  # per row, index of the char after it
    end_of = np.repeat(row_end, np.diff(np.concatenate(([0], row_end))))
    for n in settings.orders:
        first = np.flatnonzero(np.arange(len(chars)) + n <= end_of)
        h = range_hashes(prefix, edges[first], edges[first + n])
        yield edges[first], (mix(h, n) & np.uint64((1 << settings.bits) - 1)).astype(np.int64)


def _present(texts: Texts, settings: Settings, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs; only ``used`` features if given."""
    keys = []
    for start, feature in _grams(texts, settings):
        if used is not None:
            hit = used[feature]
            start, feature = start[hit], feature[hit]
        row = np.searchsorted(texts.offsets, start, side="right") - 1
        keys.append((row << settings.bits) | feature)
    both = np.unique(np.concatenate(keys)) if keys else np.zeros(0, dtype=np.int64)
    return both >> settings.bits, both & ((1 << settings.bits) - 1)


def _counter(settings: Settings):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << settings.bits), dtype=np.int32)
        rows = np.zeros(2, dtype=np.int64)
        waiting: tuple[list, list] = ([], [])

        def add(label: int, least: int) -> None:
            if sum(map(len, waiting[label])) >= least:
                counts[label] += np.bincount(np.concatenate(waiting[label]), minlength=1 << settings.bits).astype(np.int32)
                waiting[label].clear()

        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            rows += np.bincount(toxic, minlength=2)
            for at, to, texts in _slices(batch.column("text")):
                row, feature = _present(texts, settings)
                for label in (0, 1):
                    waiting[label].append(feature[toxic[at:to][row] == label])
                    add(label, _BUFFER)
        for label in (0, 1):
            add(label, 1)
        if not rows.any():
            return
        parts = [k for k in range(0, 1 << settings.bits, _CHUNK) if counts[:, k : k + _CHUNK].any()]
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([-1, *parts], pa.int32()),
            "counts": pa.array([rows.astype("<i8").tobytes(), *(counts[:, k : k + _CHUNK].astype("<i4").tobytes() for k in parts)], pa.binary()),
        })

    return count


def _total(pdf):
    kind = "<i8" if pdf["part"].iloc[0] == -1 else "<i4"
    total = sum(np.frombuffer(x, dtype=kind).astype("<i8") for x in pdf["counts"])
    return pdf[["part"]].head(1).assign(counts=[total.tobytes()])


def _dense(features: np.ndarray, values: np.ndarray | bool, settings: Settings) -> np.ndarray:
    """A table over all features, made in the worker: closures carry the used ones only."""
    out = np.zeros(1 << settings.bits, dtype=np.asarray(values).dtype)
    out[features] = values
    return out


def _picker(ids: np.ndarray, settings: Settings):
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = _dense(ids, True, settings)
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            for at, to, texts in _slices(batch.column("text")):
                row, feature = _present(texts, settings, used)
                place = np.searchsorted(ids, feature)
                yield pa.RecordBatch.from_pydict({
                    "toxic": pa.array([toxic[at:to].astype(np.int8).tobytes()], pa.binary()), "sizes": pa.array([np.bincount(row, minlength=to - at).astype("<i4").tobytes()], pa.binary()),
                    "places": pa.array([place.astype("<i4").tobytes()], pa.binary()),
                })

    return pick


def _fit(rows: np.ndarray, columns: np.ndarray, scale: np.ndarray, y: np.ndarray, settings: Settings) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps over sparse features; the intercept is the last weight."""
    n, k = len(y), len(scale) + 1
    spread = np.append(scale, 1.0)

    def times(w: np.ndarray) -> np.ndarray:
        return np.bincount(rows, (spread * w)[columns], minlength=n) + w[-1]

    def back(g: np.ndarray) -> np.ndarray:
        out = np.bincount(columns, g[rows], minlength=k) * spread
        out[-1] = g.sum()
        return out

    v = np.ones(k) / np.sqrt(k)
    for _ in range(20):  # the largest curvature bounds the step
        v = back(times(v))
        curve = float(np.linalg.norm(v))
        v /= curve
    shrink = np.full(k, settings.penalty)
    shrink[-1] = 0
    pace = 1 / (0.26 * curve + n * settings.penalty)
    w = look = np.append(np.zeros(k - 1), np.log((y.sum() + 1) / (n - y.sum() + 1)))
    for step in range(settings.steps):
        p = 1 / (1 + np.exp(-np.clip(times(look), -30, 30)))
        new = look - pace * (back(p - y) + n * shrink * look)
        look, w = new + step / (step + 3) * (new - w), new
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on ``labels`` (doc_id, toxic) and the texts of ``docs`` (doc_id, text).

    The sample is taken among labels whose documents are there.
    """
    known = (
        labels.select(F.col("doc_id").cast("bigint"), F.col("toxic").cast("int"))
        .where("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .join(documents_of(docs).select("doc_id"), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.most_labelled)
    )
    # At most ``most_labelled`` pairs of numbers: the bound of this broadcast.
    texts = documents_of(docs).join(F.broadcast(known), "doc_id").select("toxic", "text")
    size = 1 << settings.bits
    sums = (
        texts.mapInArrow(_counter(settings), "part int, counts binary")
        .groupBy("part").applyInPandas(_total, "part int, counts binary").collect()
    )
    counts, n = np.zeros((2, size)), np.zeros(2)
    for part, blob in sums:
        got = np.frombuffer(blob, dtype="<i8").astype(float)
        if part == -1:
            n = got
        else:
            counts[:, part : part + _CHUNK] = got.reshape(2, -1)
    prior = (n[1] + 1) / (n.sum() + 2)
    flat = Model(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32), float(np.log(prior / (1 - prior))), settings)
    if not n.all():
        return flat
    share = (counts + settings.smoothing) / (n[:, None] + 2 * settings.smoothing)
    ratio = np.log(share[1] / share[0])
    error = np.sqrt((1 - share[1]) / (counts[1] + settings.smoothing) + (1 - share[0]) / (counts[0] + settings.smoothing))
    used = (counts.sum(axis=0) >= settings.least_texts) & (np.abs(ratio) >= np.maximum(settings.least_z * error, settings.least_ratio))
    if not used.any():
        return flat
    ids = np.flatnonzero(used)
    scale = ratio[ids]
    del counts, share, ratio, error, used
    # Numbers of features reach the driver packed, 4 bytes for each one that a sampled text holds.
    blobs = texts.mapInArrow(_picker(ids, settings), "toxic binary, sizes binary, places binary").collect()
    y, sizes, places = (np.concatenate([np.frombuffer(r[k], dtype=kind) for r in blobs]) for k, kind in enumerate(("i1", "<i4", "<i4")))
    del blobs
    w, b = _fit(np.repeat(np.arange(len(y), dtype=np.int32), sizes), places, scale, y.astype(float), settings)
    return Model(ids, (w * scale).astype(np.float32), float(b), settings)


def score_of(model: Model):
    """A column function from a text to its score; only the text goes to Python."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = model.weights
        used = weights != 0
        for texts_of in batches:
            scores = np.full(len(texts_of), model.intercept)
            for at, to, texts in _slices(texts_of):
                row, feature = _present(texts, model.settings, used)
                scores[at:to] += np.bincount(row, weights[feature], minlength=to - at)
            yield pa.array(1 / (1 + np.exp(-np.clip(scores, -30, 30))))

    return score


def scored(docs: DataFrame, model: Model, carry: str = "doc_id") -> DataFrame:
    """``doc_id`` and ``score``, one row for each row of ``docs``; with ``carry="whole"``, all its
    columns as a struct in place of ``doc_id``."""
    rows = carried(docs).select("whole") if carry == "whole" else documents_of(docs)
    text = F.col("whole").getField("text").cast("string") if carry == "whole" else F.col("text")
    return rows.select(carry, score_of(model)(text).alias("score"))


def held_out():
    """Rows whose labels are never learned from."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def train_on_open_rows(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    return train(docs, labels.where(~held_out()), settings)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, settings = table(spark, sf_dir, "documents"), Settings()
    model = train_on_open_rows(docs, table(spark, sf_dir, "labels"), settings)
    return scored(docs, model).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= settings.threshold).cast("int").alias("predicted"),
    )
