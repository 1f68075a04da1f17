"""Toxicity by compression distance.

Two zstandard dictionaries are made from labelled documents.  Both begin with the same stretch of ordinary text, which
zstandard's trainer picks; the toxic one ends in a lexicon instead of trained text: fragments of words (with the space
before them) that documents labelled toxic have far oftener than others, so that a window that compresses shorter
with it than with the ordinary one does so for these fragments.  Trained on toxic text it would hold the ordinary words
around the toxic ones (the README gives figures).  A document is cut into windows of whole
words; each is compressed with both; the differences in bytes, summed up by window thresholds, are calibrated
to a score by logistic regression on the training documents.

Training takes at most ``per_class`` labelled documents of each class to the driver (whole texts, none of more than
LONGEST characters, so that their bytes are bounded too); scoring reads whole texts, however long, in one pass without a
shuffle.

Cases: labelled rows of equal md5 order by doc_id, and a doc_id with several labels counts with the highest; a null text is
scored as the empty one, which has no window and gets the score of a document in which
nothing was found; equal texts have equal scores; with no labelled rows every score is 0.5, with one class only
it is that class's smoothed share; an empty table gives no rows; other columns are kept by ``score_documents``,
but for those that it adds, which replace columns of the same name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollex.llm._labels import fold, labelled_sample
from recollex.session import small_batches, table

PER_CLASS = 2500
LONGEST = 20_000
WINDOW_WORDS = 12
DICTIONARY_BYTES = 4096
THRESHOLDS = (1, 2, 4)
LEAST_RATE = 6
#: zstandard finds no match that begins in the last bytes of a dictionary: filled, so that the most telling fragment is found.
UNINDEXED = b"\0" * 8


def windows(text: str) -> list[bytes]:
    """The whole text, lower-cased, in windows of WINDOW_WORDS words; a space leads each word."""
    words = text.lower().split()
    return [(" " + " ".join(words[i : i + WINDOW_WORDS]) + " ").encode() for i in range(0, len(words), WINDOW_WORDS)]


def fragments(text: str) -> set[str]:
    """Beginnings of words of three letters and more, and words whole, as a window shows them."""
    out: set[str] = set()
    for w in set(text.lower().split()):
        w = w.strip(".,;:!?|\"'()")
        out.update(" " + w[:k] for k in range(3, min(len(w), 9) + 1))
        if len(w) == 3:  # four bytes are seldom worth a match
            out.add(" " + w + " ")
    return out


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: np.ndarray = field(default_factory=lambda: np.zeros(4 + len(THRESHOLDS)))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(3 + len(THRESHOLDS)))
    scale: np.ndarray = field(default_factory=lambda: np.ones(3 + len(THRESHOLDS)))


class Scorer:
    """The compressors of a model, for one worker process."""

    def __init__(self, model: Model):
        self.model = model
        self.pair = [self._compressor(d) for d in (model.ordinary, model.toxic)] if model.toxic else None

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        params = zstandard.ZstdCompressionParameters.from_level(
            3, strategy=zstandard.STRATEGY_BTLAZY2, min_match=3, window_log=16, hash_log=15, chain_log=15, search_log=8, write_checksum=False, write_content_size=False, write_dict_id=False
        )
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=d, compression_params=params)

    def differences(self, text: str) -> np.ndarray:
        """By window: bytes that the toxic dictionary saves over the ordinary one."""
        if self.pair is None:
            return np.zeros(0)
        a, b = self.pair
        return np.array([len(a.compress(w)) - len(b.compress(w)) for w in windows(text)], dtype=np.float64)

    def evidence(self, text: str) -> np.ndarray:
        d = self.differences(text)
        if not len(d):
            return np.zeros(3 + len(THRESHOLDS))
        over = [np.sqrt((d >= t).sum()) for t in THRESHOLDS]
        return np.array([min(d.max(), 12), np.clip(d, 0, None).mean(), np.log1p(len(d)), *over])

    def score(self, evidence: np.ndarray) -> np.ndarray:
        x = (evidence - self.model.mean) / self.model.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.model.weights[1:] + self.model.weights[0], -35, 35)))


def train_dictionaries(texts: list[str], toxic: np.ndarray) -> tuple[bytes, bytes]:
    """(ordinary, toxic) contents: the same ordinary text, then the toxic fragments, in the ordinary one zeros.

    A fragment is telling if its likelihood ratio stands out among as many fragments as were counted, and if
    toxic documents have it at LEAST_RATE times the ordinary rate.  Of telling fragments that begin one another
    the longest stays that nearly all documents of the shorter have.
    """
    sides = [[t for t, y in zip(texts, toxic, strict=True) if y == c] for c in (0, 1)]
    common = _trained([w for t in sides[0] for w in windows(t)])
    clean, tox = (Counter(f for t in side for f in fragments(t)) for side in sides)
    n1, n0, telling = len(sides[1]), len(sides[0]), {}
    least = np.log(len(tox) + 1) + 3
    for f, n in tox.items():
        c, pooled = clean[f], (n + clean[f]) / (n1 + n0)
        ratio = n * np.log(n / n1 / pooled) + (c * np.log(c / n0 / pooled) if c else 0.0)
        if ratio >= least and n / n1 >= LEAST_RATE * (c + 0.5) / n0:
            telling[f] = ratio
    kept, longest = [], Counter()  # of each beginning: how many toxic documents have the commonest telling fragment that goes on from it
    for g in telling:
        for k in range(2, len(g)):
            longest[g[:k]] = max(longest[g[:k]], tox[g])
    for f in telling:
        longer = longest[f] >= 0.9 * tox[f]
        shorter = any(f[:k] in telling and tox[f] < 0.9 * tox[f[:k]] for k in range(4, len(f)))
        if not longer and not shorter:
            kept.append((telling[f], f))
    lead = "\0".join(f for _, f in sorted(kept)).encode()[-DICTIONARY_BYTES:] + UNINDEXED
    return common + b"\0" * (len(lead) + 1), common + b"\0" + lead


def _trained(samples: list[bytes]) -> bytes:
    """Content that zstandard's trainer picks from ordinary windows (its entropy tables are left off)."""
    try:
        d = zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=3)
        raw = d.as_bytes()
        return raw[-(DICTIONARY_BYTES * 3 // 4) :]
    except zstandard.ZstdError:  # too few samples to train on
        return b"".join(samples)[-DICTIONARY_BYTES:]


def without_copies(texts: list[str]) -> list[int]:
    """Places of the texts that share none of four minhashes of word triples with an earlier one.

    A text that is copied over and over would else make all its words telling.
    """
    seen: set[tuple[int, int]] = set()
    kept = []
    for i, t in enumerate(texts):
        w = t.lower().split()
        shingles = [" ".join(w[k : k + 3]).encode() for k in range(max(1, len(w) - 2))]
        least = {(seed, min(xxhash.xxh3_64_intdigest(x, seed) for x in shingles)) for seed in range(4)}
        if not least & seen:
            kept.append(i)
        seen |= least
    return kept


def fit(texts: list[str], y: np.ndarray, rounds: int = 60) -> Model:
    """Fit to distinct texts; empty or one-sided input gives a constant model."""
    places = [np.flatnonzero(y == c)[k] for c in (0, 1) for k in without_copies([texts[i] for i in np.flatnonzero(y == c)])]
    texts, y = [texts[i] for i in places], y[places] if len(y) else y
    if len(y) == 0 or y.min() == y.max():
        m = Model()
        if len(y):
            m.weights[0] = np.log((y.sum() + 1) / ((1 - y).sum() + 1))
        return m
    m = Model(*train_dictionaries(texts, y))
    s = Scorer(m)
    x = np.array([s.evidence(t) for t in texts])
    m.mean, m.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = np.hstack([np.ones((len(y), 1)), (x - m.mean) / m.scale])
    w, beta = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())), np.zeros(x.shape[1])
    for _ in range(rounds):  # Newton steps on the ridge-penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + np.eye(x.shape[1]) * 0.5
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - 0.5 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    m.weights = beta
    return m


def train(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    sample = labelled_sample(labels, label, keep, per_class)  # at most 2 * per_class rows of two numbers: broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").filter(F.length(F.coalesce("text", F.lit(""))) <= LONGEST).orderBy("doc_id", "text").select("label", F.coalesce("text", F.lit("")).alias("text")).toArrow()
    return fit(rows["text"].to_pylist(), rows["label"].to_numpy().astype(np.float64))


def score_documents(docs: DataFrame, model: Model, text: str = "text", drop_text: bool = False) -> DataFrame:
    """Adds score, predicted and n_windows.  The model travels with the task: tens of kB whatever the input."""
    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_toxic_windows", T.IntegerType())]
    kept = [f for f in docs.schema if f.name not in {x.name for x in added} and not (drop_text and f.name == text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            x = np.array([scorer.evidence(v.as_py() or "") for v in batch.column(text)]).reshape(-1, 3 + len(THRESHOLDS))
            s = scorer.score(x)
            new = [pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32()), pa.array(np.round(x[:, 3] ** 2).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + new, names=[f.name for f in (*kept, *added)])

    return docs.mapInArrow(run, T.StructType([*kept, *added]))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    scored = score_documents(docs, model, drop_text=True)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", "n_toxic_windows")
