"""Quality scores by a regularised quadratic discriminant on transformed document statistics.

Each class has a mean and a covariance that is shrunk towards the diagonal of the pooled one. A text's
score is the difference of the two log-densities, each a Mahalanobis distance by a Cholesky factor that is
computed once and kept, and of the log class shares. Class sums are added up by Spark over all labelled
training rows; the driver gets a few hundred sums.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seaglint.llm.common import map_texts, materialise
from seaglint.llm.line_crf import BLANKS, CAPITALS, DIGITS, FOLLOWERS, LETTERS, MARKS, SYMBOLS, less, repeated_words

STATISTICS = (
    "words", "word length", "symbols", "marks", "capitals", "digits", "stops", "commas", "exclamations",
    "seen lines", "repeated words", "distinct words", "top word", "marked words", "line words", "longest word", "foreign",
)
#: Shares of the pooled diagonal in a class covariance, and of the class's own mean variance.
SHRINK, RIDGE = 0.15, 0.02
#: Log-density differences are divided by this and cut at the limit, as densities of counts are too sure.
SOFTEN, LIMIT = 3.0, 30.0
THRESHOLD = 0.3
HELD_OUT, FOLDS = 0, 5


def share(part: float, whole: float) -> float:
    """A transformed share: its root, so that small shares differ as much as large ones."""
    return sqrt(part / whole) if whole else 0.0


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of a whole text; all zero without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    chars = len(text.translate(None, BLANKS + FOLLOWERS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    count = Counter(words)
    return [
        log(1 + n) / 4,
        log(chars / n),
        share(less(text, SYMBOLS), chars),
        share(less(text, MARKS), chars),
        share(less(text, CAPITALS), less(text, LETTERS)),
        share(less(text, DIGITS), chars),
        share(less(text, b".?"), n),
        share(less(text, b","), n),
        share(less(text, b"!"), n),
        share(len(lines) - len(set(lines)), len(lines)),
        share(repeated_words(words), n),
        share(n - len(count), n),
        share(max(count.values()) - 1, n),
        share(sum(c for w, c in count.items() if w.translate(None, MARKS) != w), n),
        log(1 + n / len(lines)) / 4,
        log(1 + max(map(len, count))) / 4,
        share(len(text) - len(text.translate(None, FOLLOWERS)), chars),
    ]


class Discriminant:
    """Means, inverse Cholesky factors and constants of the classes 0 and 1, from their sums."""

    def __init__(self, sums: dict[int, np.ndarray]):
        k = len(STATISTICS)
        n = np.array([sums[c][0] if c in sums else 0.0 for c in (0, 1)])
        #: Of label 1 among labelled rows; even without any.
        self.prior = (n[1] + 1) / (n.sum() + 2)
        self.parts = None
        if (n < 2).any():
            return
        mean = [sums[c][1 : k + 1] / n[c] for c in (0, 1)]
        cov = [sums[c][k + 1 :].reshape(k, k) / n[c] - np.outer(m, m) for c, m in zip((0, 1), mean)]
        pooled = np.diag((n[0] * np.diag(cov[0]) + n[1] * np.diag(cov[1])) / n.sum())
        self.parts = []
        for c in (0, 1):
            shrunk = (1 - SHRINK) * cov[c] + SHRINK * pooled + RIDGE * (np.trace(pooled) / k) * np.eye(k)
            factor = np.linalg.cholesky(shrunk)
            self.parts.append((mean[c], np.linalg.inv(factor), log(n[c]) - np.log(np.diag(factor)).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1 for rows of statistics; the share of label 1 where a class has no two rows."""
        if self.parts is None:
            return np.full(len(x), self.prior)
        dense = [const - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1) for mean, inverse, const in self.parts]
        return 1 / (1 + np.exp(-np.clip((dense[1] - dense[0]) / SOFTEN, -LIMIT, LIMIT)))


def class_sums(described: DataFrame) -> dict[int, np.ndarray]:
    """For each ``label``: the rows, the sums and the sums of products of ``x``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            x = np.array(b.column("x").to_pylist(), float).reshape(-1, len(STATISTICS))
            label = b.column("label").to_numpy()
            for c in (0, 1):
                own = x[label == c]
                if len(own):
                    total[c] = total.get(c, 0) + np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        for c, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(sums), pa.int32()), pa.array(range(len(sums)), pa.int32()), pa.array(sums)], names=["label", "place", "value"])

    rows = described.select("label", "x").mapInArrow(add, "label int, place int, value double").groupBy("label", "place").agg(F.sum("value").alias("value")).collect()
    out = {r["label"]: np.zeros(1 + len(STATISTICS) + len(STATISTICS) ** 2) for r in rows}
    for r in rows:
        out[r["label"]][r["place"]] = r["value"]
    return out


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text, modulo 5, is 0; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: id, held_out, score (0 to 1, higher: label 1 likelier) and predicted.

    Learns from labelled documents that are not held out. Null labels count for nothing; of several labels
    of an id the smallest holds. Null and empty texts have zero statistics and are scored like any other.
    Nothing but the text goes into a score.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def describe(runs: Iterator[list[bytes]]) -> Iterator[dict[str, list]]:
        for found in runs:
            yield {"x": [statistics(t) for t in found]}

    described = materialise(map_texts(texts, describe, "x array<double>", "text").select("id", held_out(F.col("id")).alias("held_out"), "x"))
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)").groupBy("id").agg(F.min("label").alias("label"))
    model = Discriminant(class_sums(described.where("not held_out").join(marks, "id")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("x").to_pylist(), float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), pa.array(model.score(x))], names=["id", "held_out", "score"])

    kind = described.schema["id"].dataType.simpleString()
    scored = described.mapInArrow(score, f"id {kind}, held_out boolean, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
