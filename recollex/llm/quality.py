"""Quality classifier: a generalised additive model with pairwise interactions.

Each document becomes a vector of surface features; cyclic boosting fits one small tree at a time to each
feature in turn and adds it to that feature's lookup table over bins; then the pairs of features with most
left to explain get tables of two dimensions in the same way.  A document is scored by adding up table cells.

Training takes at most ``per_class`` labelled rows of each class (their features come to the driver, never
their texts); scoring reads whole texts in one pass without a shuffle.

Cases: a null text is scored as the empty one, a very long one whole, its features being counts and shares; labelled rows of
equal md5 order by doc_id, and a doc_id with several labels counts with the highest; equal texts have equal scores; with no labelled rows every score
is 0.5, with one class only it is that class's smoothed share; an empty table gives no rows; other columns are
kept by ``score_documents``, but for those that it adds, which replace columns of the same name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollex.llm._labels import fold, labelled_sample
from recollex.session import small_batches, table

FEATURES = (
    "log_bytes", "log_words", "upper", "lower", "symbols", "exclamations", "bars", "digits", "stops", "newlines", "non_ascii",
    "distinct_words", "repeats_next", "top_word", "word_length", "short_words", "distinct_lines", "line_length", "period",
)
BINS = 32
PER_CLASS = 8000


def _class_of_bytes() -> np.ndarray:
    kinds = np.zeros((256, 9), dtype=np.float64)
    groups = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "#$%&*@^~\\<>={}[]+_/", "!", "|", "0123456789", ".,;:?", "\n"]
    for k, group in enumerate(groups):
        for c in group:
            kinds[ord(c), k] = 1
    kinds[128:, 8] = 1
    return kinds


_KINDS = _class_of_bytes()


def features(text: str) -> np.ndarray:
    """The FEATURES of one whole text; all zero for the empty text."""
    raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    if not len(raw):
        return np.zeros(len(FEATURES))
    shares = np.bincount(raw, minlength=256) @ _KINDS / len(raw)
    words, lines = text.split(), text.split("\n")
    n, counts = len(words), Counter(words)
    letters = max(shares[0] + shares[1], 1e-9)
    return np.array([
        np.log1p(len(raw)), np.log1p(n), shares[0] / letters, shares[1], shares[2], shares[3], shares[4], shares[5], shares[6], shares[7], shares[8],
        len(counts) / max(n, 1), sum(map(str.__eq__, words, words[1:])) / max(n, 1), max(counts.values(), default=0) / max(n, 1),
        len(text) / max(n, 1), sum(len(w) < 4 for w in words) / max(n, 1), len(set(lines)) / len(lines), np.log1p(len(text) / len(lines)),
        _period(words),
    ])


def _period(words: list[str]) -> float:
    """Share of word triples that occurred before in the text."""
    n = len(words) - 2
    return 1 - len(set(zip(words, words[1:], words[2:], strict=False))) / n if n > 0 else 0.0


@dataclass
class Gam:
    edges: list[np.ndarray]
    bias: float
    mains: np.ndarray  # features x BINS
    pairs: list[tuple[int, int, np.ndarray]]  # feature, feature, BINS x BINS

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = self.bias + self.mains[np.arange(b.shape[1])[None, :], b].sum(axis=1)
        for i, j, cells in self.pairs:
            z = z + cells[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _newton(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Values by bin of a tree with at most ``leaves`` leaves over one binned feature."""
    cuts = [0, len(g)]
    while len(cuts) <= leaves:
        best, at = 1e-12, None
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi - lo < 2:
                continue
            gl, hl = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
            gain = _gain(gl, hl) + _gain(g[lo:hi].sum() - gl, h[lo:hi].sum() - hl) - _gain(g[lo:hi].sum(), h[lo:hi].sum())
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, at = gain[k], lo + k + 1
        if at is None:
            break
        cuts = sorted([*cuts, at])
    out = np.zeros(len(g))
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        out[lo:hi] = _newton(g[lo:hi].sum(), h[lo:hi].sum())
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and cell values of the best cut into four quadrants."""
    quarters = []
    for a in (g, h):
        c = a.cumsum(0).cumsum(1)
        top, left, all_ = c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        q = c[:-1, :-1]
        quarters.append((q, top - q, left - q, all_ - top - left + q))
    gain = sum(_gain(x, y) for x, y in zip(*quarters, strict=True))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty_like(g)
    v = [_newton(x[i, j], y[i, j]) for x, y in zip(*quarters, strict=True)]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, pairs: int = 8, pair_rounds: int = 60) -> Gam:
    """Classes weigh the same; empty or one-sided input gives a constant model."""
    f = len(FEATURES)
    flat = Gam([np.array([])] * f, 0.0, np.zeros((f, BINS)), [])
    if len(y) == 0:
        return flat
    if y.min() == y.max():
        flat.bias = float(np.log((y.sum() + 1) / ((1 - y).sum() + 1)))
        return flat
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]))[: BINS - 1] for j in range(f)]
    model = Gam(edges, 0.0, np.zeros((f, BINS)), [])
    b = model.bins(x)
    w = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    z = np.zeros(len(y))

    def left(cells: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return np.bincount(cells, w * (y - p), size), np.bincount(cells, w * p * (1 - p), size)

    for _ in range(rounds):
        for j in range(f):
            step = rate * _shallow_tree(*left(b[:, j], BINS))
            model.mains[j] += step
            z += step[b[:, j]]
    ranked = []
    for i in range(f):
        for j in range(i + 1, f):
            g, h = left(b[:, i] * BINS + b[:, j], BINS * BINS)
            ranked.append((_pair_tree(g.reshape(BINS, BINS), h.reshape(BINS, BINS))[0], i, j))
    chosen = [(i, j, np.zeros((BINS, BINS))) for _, i, j in sorted(ranked, reverse=True)[:pairs]]
    for _ in range(pair_rounds):
        for i, j, cells in chosen:
            g, h = left(b[:, i] * BINS + b[:, j], BINS * BINS)
            step = rate * _pair_tree(g.reshape(BINS, BINS), h.reshape(BINS, BINS))[1]
            cells += step
            z += step[b[:, i], b[:, j]]
    model.pairs = chosen
    return model


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replaces the text by an array of its features."""
    kept = [f for f in docs.schema if f.name not in (text, "features")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(v.as_py() or "") for v in batch.column(text)]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [pa.array(rows, pa.list_(pa.float64()))], names=[*(f.name for f in kept), "features"])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField("features", T.ArrayType(T.DoubleType()))]))


def train(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "quality", per_class: int = PER_CLASS) -> Gam:
    sample = labelled_sample(labels, label, keep, per_class)  # at most 2 * per_class rows of two numbers: broadcast
    rows = with_features(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")).orderBy("doc_id").select("label", "features").toArrow()
    x = np.array(rows["features"].to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit(x, rows["label"].to_numpy().astype(np.float64))


def score_documents(docs: DataFrame, model: Gam, text: str = "text", drop_text: bool = False) -> DataFrame:
    """Adds score and predicted.  The model travels with the task: a few hundred kB whatever the input."""
    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    kept = [f for f in docs.schema if f.name not in ("score", "predicted") and not (drop_text and f.name == text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(v.as_py() or "") for v in batch.column(text)]).reshape(-1, len(FEATURES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], names=[f.name for f in (*kept, *added)])

    return docs.mapInArrow(run, T.StructType([*kept, *added]))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    scored = score_documents(docs, model, drop_text=True)
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: Gam, least: float = 0.5, text: str = "text") -> DataFrame:
    """The documents that score ``least`` or more, columns as they are."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(v.as_py() or "") for v in batch.column(text)]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= least))

    return docs.mapInArrow(run, schema)
