"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every distinct shingle hash below ``2**64 / scale``, however long the document.  So sketches of
parts merge to the sketch of the whole by union, and the share of the smaller sketch found in the larger
estimates containment even between a page and a book.

Words are runs of other than ASCII white space, A-Z lower-cased; shingles have SHINGLE words, a text of fewer has
one of all its words.

The likeness of short texts is coarse: a text of n shingles keeps n / SCALE of them on average, none with a chance of
(1 - 1 / SCALE) ** n, and with m kept the estimate errs by about sqrt(p (1 - p) / m).  Below some twenty shingles compare texts.

Cases: a null text is the empty one; a text with nothing below the threshold has an empty sketch, and two of
those are alike (1) if their texts have the same shingles, else not (0), as is one of those and any other;
equal texts have equal fingerprints; very long texts have long fingerprints, one hash in ``scale`` shingles;
null doc_ids are ordered after all others, repeated ones by a hash of the text; a table of one row is its own
next; an empty table gives no rows; of other columns ``fingerprint_documents`` keeps all but those that it adds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollex.llm._ordered import map_with_next
from recollex.llm._shingles import shingle_hashes
from recollex.session import small_batches, table

SHINGLE, SCALE = 5, 2


class Sketch:
    """The retained hashes of one text, with the number and the exclusive or of all its shingle hashes."""

    def __init__(self, kept: np.ndarray, count: int, digest: int, scale: int = SCALE):
        self.kept, self.count, self.digest, self.scale = kept, count, digest, scale

    @classmethod
    def of(cls, text: str, size: int = SHINGLE, scale: int = SCALE) -> Sketch:
        hashes = shingle_hashes(text.encode("utf-8").lower().split(), size)
        digest = int(np.bitwise_xor.reduce(hashes)) if len(hashes) else 0
        return cls(hashes[: np.searchsorted(hashes, np.uint64((1 << 64) // scale))], len(hashes), digest, scale)

    def __str__(self) -> str:
        return f"s{self.scale}:{self.count:x}:{self.digest:016x}:{self.kept.astype('>u8').tobytes().hex()}"

    @classmethod
    def parse(cls, s: str) -> Sketch:
        scale, count, digest, kept = s.split(":")
        return cls(np.frombuffer(bytes.fromhex(kept), dtype=">u8").astype(np.uint64), int(count, 16), int(digest, 16), int(scale[1:]))

    def common(self, other: Sketch) -> int:
        return len(np.intersect1d(self.kept, other.kept, assume_unique=True))

    def containment(self, other: Sketch) -> float:
        """Estimated share of the smaller text's shingles that the larger has."""
        if not len(self.kept) or not len(other.kept):
            return float((self.count, self.digest) == (other.count, other.digest))
        return self.common(other) / min(len(self.kept), len(other.kept))

    def jaccard(self, other: Sketch) -> float:
        if not len(self.kept) or not len(other.kept):
            return float((self.count, self.digest) == (other.count, other.digest))
        both = self.common(other)
        return both / (len(self.kept) + len(other.kept) - both)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The retained hashes of a text in two parts, but for shingles across the cut."""
    return np.union1d(a, b)


def fingerprint_documents(docs: DataFrame, text: str = "text", size: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Adds fingerprint.  One pass, no shuffle."""
    kept = [f for f in docs.schema if f.name != "fingerprint"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [str(Sketch.of(v.as_py() or "", size, scale)) for v in batch.column(text)]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [pa.array(made, pa.string())], names=[*(f.name for f in kept), "fingerprint"])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField("fingerprint", T.StringType())]))


EDITED = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    + [T.StructField(n, T.DoubleType()) for n in ("near_edited", "near_next", "jaccard_edited", "jaccard_next")]
)


def _edited(row: dict, following: dict) -> dict:
    text, after = row["text"] or "", following["text"] or ""
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    own, other = row.get("_sketch") or Sketch.of(text), Sketch.of(edited)
    following["_sketch"] = Sketch.of(after)
    return {
        "doc_id": row["doc_id"], "n_chars": len(text), "edited_sha256": hashlib.sha256(edited.encode("utf-8")).hexdigest(), "fingerprint": str(own), "edited_fingerprint": str(other),
        "near_edited": own.containment(other), "near_next": own.containment(following["_sketch"]), "jaccard_edited": own.jaccard(other), "jaccard_next": own.jaccard(following["_sketch"]),
    }


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.xxhash64("text").alias("_tie"))
    return map_with_next(docs, "doc_id", "_tie", _edited, EDITED)
