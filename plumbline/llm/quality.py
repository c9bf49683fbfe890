"""Quality classifier: Bradley-Terry ranking of documents by pairwise logistic loss.

A document's strength is a linear function of features of its text. Each training pair takes a document labelled 1 and
one labelled 0; the model says that the first is preferred with probability sigmoid(w . (x1 - x0)), and w minimises the
logistic loss on these feature differences (with an L2 term), by Newton steps. The cut is a quantile of the training
strengths: the one that best separates the two labels. Scores are a logistic curve through that cut, so that the
threshold 0.3 falls exactly on it.

The fit uses a bounded sample of labelled rows (`sample`, by hash of the id) and `pairs` pairs drawn from it; both are
parameters. Scoring covers every row. Null texts count as empty ones and get the score of an empty text; extra columns
are ignored; repeated rows get a row each. Where no usable pair of labels exists all weights are 0, so every
score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import BASES, buffers, range_hash, slices, table_of, whole_texts, word_ranges

#: Classes of bytes whose shares are features.
CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "blank": b" \t",
    "line": b"\n\r\x0b\x0c",
    "stop": b".!?",
    "comma": b",;:",
    "quote": b"\"'()[]{}<>",
    "symbol": b"|/\\@#$%^&*_=+~`-",
}
N_FEATURES = len(CLASSES) + 14


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of text features for each document of a batch."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    per = 1 / np.maximum(size, 1)
    kind = np.zeros(256, np.int64)
    for k, members in enumerate(CLASSES.values()):
        kind[list(members)] = k + 1
    kind[128:] = len(CLASSES) + 1
    doc = np.repeat(np.arange(n), size)
    width = len(CLASSES) + 2
    shares = np.bincount(doc * width + kind[data], minlength=n * width).reshape(n, width)[:, 1:] * per[:, None]
    starts, ends, by = word_ranges(data, offsets)
    words = np.diff(by)
    per_word = 1 / np.maximum(words, 1)
    length = (ends - starts).astype(float)
    hashes = range_hash(table_of(0)[data], starts, ends, BASES[0])
    sums = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x)])[by])
    mean = sums(length) * per_word
    spread = np.sqrt(np.maximum(sums(length**2) * per_word - mean**2, 0))
    repeats = np.zeros(len(hashes), bool)
    repeats[1:] = hashes[1:] == hashes[:-1]
    repeats[by[:-1][words > 0]] = False  # a document's first word repeats none, whatever stands before it
    distinct, top, lines, distinct_lines, longest = (np.zeros(n) for _ in range(5))
    breaks = np.flatnonzero(data == 10)
    for i in range(n):
        a, b = by[i], by[i + 1]
        if b > a:
            counts = np.unique(hashes[a:b], return_counts=True)[1]
            distinct[i], top[i], longest[i] = len(counts) / (b - a), counts.max() / (b - a), length[a:b].max()
        cut = breaks[np.searchsorted(breaks, offsets[i]) : np.searchsorted(breaks, offsets[i + 1])]
        if len(cut):
            text = data[offsets[i] : offsets[i + 1]].tobytes().split(b"\n")
            lines[i], distinct_lines[i] = len(text), len(set(text)) / len(text)
        else:
            lines[i] = distinct_lines[i] = 1
    first = data[np.minimum(starts, max(len(data) - 1, 0))] if len(starts) else np.zeros(0, np.uint8)
    more = [
        np.log1p(size), np.log1p(words), mean, spread, np.log1p(longest), distinct, top, np.log1p(lines), distinct_lines,
        sums(repeats) * per_word, sums(length <= 2) * per_word, sums((first >= 65) & (first <= 90)) * per_word,
        np.log1p(words / np.maximum(lines, 1)),
    ]
    out = np.column_stack([shares, *more])
    return np.nan_to_num(out)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        """Standardised features and their squares: a strength may be highest in the middle of a range."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([z, np.minimum(z * z, 16)])

    def score(self, x: np.ndarray, threshold: float) -> np.ndarray:
        """Between 0 and 1; `threshold` on the cut."""
        if not self.weights.any():
            return np.full(len(x), 0.5)
        z = self.slope * (self.expand(x) @ self.weights - self.cut) + np.log(threshold / (1 - threshold))
        score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        return score


def fit(x: np.ndarray, y: np.ndarray, pairs: int, l2: float, seed: int) -> Model:
    """Bradley-Terry weights, quantile cut and slope from feature rows x with labels y."""
    model = Model(x.mean(0) if len(x) else np.zeros(x.shape[1]), np.maximum(x.std(0), 1e-9) if len(x) else np.ones(x.shape[1]), np.zeros(2 * x.shape[1]), 0.0, 1.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return model
    z = model.expand(x)
    rng = np.random.default_rng(seed)
    difference = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(difference @ w, -500, 500)))  # of the pair being the other way round
        gradient = -(difference.T @ p) / pairs + l2 * w
        hessian = (difference * (p * (1 - p))[:, None]).T @ difference / pairs + l2 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w
    strength = z @ w
    # The quantile of strengths that splits the labels best (balanced error).
    order = np.argsort(strength, kind="stable")
    s, labels = strength[order], y[order]
    below_bad, below_good = np.cumsum(labels == 0) / len(bad), np.cumsum(labels == 1) / len(good)
    at = int(np.argmax(below_bad - below_good))
    upper = s[at + 1] if at + 1 < len(s) else s[at] + 1
    model.cut = float((s[at] + upper) / 2)
    spread = np.median(strength[good]) - np.median(strength[bad])
    model.slope = float(6 / max(spread, 1e-9)) if spread > 0 else 1.0
    return model


def train(docs: DataFrame, labels: DataFrame, usable, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 12_000, pairs: int = 60_000, l2: float = 1e-3, seed: int = 7) -> Model:
    """The model from the labelled rows that `usable` (a condition on the id) admits.

    At most `sample` ids, first by hash, are taken; their number, not the corpus, bounds what is broadcast and gathered.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    chosen = known.filter(usable(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = whole_texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", F.xxhash64("text").alias("h"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.concatenate([np.zeros((0, N_FEATURES)), *(features(*buffers(part.column(3))) for part in slices(batch, 3, 1 << 18))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "h", "x"])

    # Of rows that repeat an id one counts, by the hash of its text.
    rows = texts.mapInArrow(run, "doc_id long, y int, h long, x array<double>").groupBy("doc_id").agg(F.min_by(F.struct("y", "x"), "h").alias("r")).select("r.y", "r.x").toArrow()
    y = rows.column("y").to_numpy()
    x = np.array(rows.column("x").to_pylist(), float).reshape(len(y), N_FEATURES)
    order = np.lexsort([*x.T[::-1], y])  # the fit does not depend on the order of partitions
    return fit(x[order], y[order], pairs, l2, seed)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(doc_id, score) for every row, or with keep all columns of docs and score; a map without a shuffle."""
    if keep:
        names, schema = docs.columns, docs.schema
        frame, at = docs, docs.columns.index(text_col)
        score_name = "score"
        while score_name in names:
            score_name += "_"
        ddl = T.StructType([*schema.fields, T.StructField(score_name, T.DoubleType())])
    else:
        frame, at, ddl, score_name = whole_texts(docs, id_col, text_col).select("doc_id", "text"), 1, "doc_id long, score double", "score"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = pa.array(np.concatenate([np.zeros(0), *(model.score(features(*buffers(part.column(at).fill_null(""))), threshold) for part in slices(batch, at, 1 << 18))]))
            columns = batch.columns if keep else [batch.column(0)]
            yield pa.RecordBatch.from_arrays([*columns, s], names=[*(batch.schema.names if keep else ["doc_id"]), score_name])

    return frame.mapInArrow(run, ddl)


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels, lambda i: ~held_out(i))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
