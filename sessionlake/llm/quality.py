"""Quality grades by ordinal cumulative-link regression on hashed text.

P(grade >= k) = sigmoid(w.x - t_k) with one weight vector w for all grades and
thresholds t_1 < t_2 < ... .  x holds frequencies: byte trigrams hashed into
DIMS places, single bytes, and the share of words that equal the word before
them.  They are linear, so a text of any length is scored by summing weights
along its bytes.  Weights and thresholds are fitted by maximum likelihood with
an L2 penalty on a bounded sample of rated documents.

Results per document: expected grade (sum of the tail probabilities over k) and
the tail probability of one grade, by which documents are selected.

Defined results: null and empty texts have x = 0 and are scored by the
thresholds alone; ratings that are null, or whose document is missing, are not
used; of several ratings of a document the largest counts; grades are the
distinct ratings found, in order; with fewer than two grades every document gets
that one grade (0 if there is none) and tail probability 1.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, discard, fold, fresh, store, text_buffers

DIMS = 1 << 14
WIDTH = DIMS + 256 + 1
#: Rated documents that are sampled for the fit, by hash of doc_id.
MOST_RATED = 6_000
#: Feature values that the sample may have together; the first documents by that hash are taken until there are so many.
MOST_VALUES = 12_000_000
STEPS, RATE = 150, 0.15
#: Bytes that are scored at a time.
BLOCK = 1 << 20
#: L2 penalty of each trigram's weight (bytes and repetition have none), and what keeps rare trigrams from being scaled up.
PENALTY, FLOOR = 3e-3, 1e-2


def trigram_places(data: np.ndarray) -> np.ndarray:
    x = data.astype(np.uint32)
    code = x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)
    code = code * np.uint32(0x9E3779B1)
    return (code ^ (code >> np.uint32(15))) >> np.uint32(32 - DIMS.bit_length() + 1)


def repetition(text: str | None) -> float:
    words = (text or "").split()
    return sum(map(operator.eq, words, islice(words, 1, None))) / (len(words) - 1) if len(words) > 1 else 0.0


def sparse_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of x that aren't zero."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    tri = np.bincount(trigram_places(data), minlength=DIMS) / max(1, len(data) - 2) if len(data) > 2 else np.zeros(DIMS)
    x = np.concatenate([tri, np.bincount(data, minlength=256) / len(data), [repetition(text)]])
    at = np.nonzero(x)[0]
    return at.astype(np.int32), x[at].astype(np.float32)


@dataclass
class Model:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, z: np.ndarray) -> np.ndarray:
        """(n, grades - 1): P(grade >= k) for the second grade and up."""
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds[None, :], -60, 60)))

    def linear(self, data: np.ndarray, offsets: np.ndarray, repeats: np.ndarray) -> np.ndarray:
        """w.x of each document of a buffer."""
        n = np.diff(offsets)
        ones = np.concatenate([[0.0], np.cumsum(self.weights[DIMS : DIMS + 256][data])])
        z = (ones[offsets[1:]] - ones[offsets[:-1]]) / np.maximum(n, 1)
        if len(data) > 2:
            tri = np.concatenate([[0.0], np.cumsum(self.weights[:DIMS][trigram_places(data)])])
            start = np.minimum(offsets[:-1], len(tri) - 1)
            stop = np.clip(offsets[1:] - 2, start, len(tri) - 1)
            z += np.where(n > 2, (tri[stop] - tri[start]) / np.maximum(n - 2, 1), 0)
        return z + self.weights[-1] * repeats


    def linear_long(self, data: np.ndarray, repeats: float, block: int) -> float:
        """w.x of one long document, `block` bytes at a time."""
        ones = tri = 0.0
        for a in range(0, len(data), block):
            ones += self.weights[DIMS : DIMS + 256][data[a : a + block]].sum()
            if len(part := data[a : a + block + 2]) > 2:
                tri += self.weights[:DIMS][trigram_places(part)].sum()
        return ones / max(1, len(data)) + tri / max(1, len(data) - 2) + self.weights[-1] * repeats


def fit(places: np.ndarray, values: np.ndarray, ends: np.ndarray, ratings: np.ndarray) -> Model:
    """Adam on the penalised likelihood, over all sampled documents in each step; features are scaled by their root mean square."""
    grades, y = np.unique(ratings, return_inverse=True)
    k = len(grades)
    if k < 2:
        return Model([int(g) for g in grades] or [0], np.zeros(WIDTH), np.zeros(0))
    n = len(y)
    doc = np.repeat(np.arange(n), np.diff(np.concatenate([[0], ends])))
    scale = 1 / (np.sqrt(np.bincount(places, values.astype(float) ** 2, WIDTH) / n) + FLOOR)
    v = values * scale[places]
    share = np.asarray([(y >= j).mean() for j in range(1, k)])
    # thresholds as a first one and positive gaps
    start = -np.log(share / (1 - share))
    theta = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    p = np.concatenate([np.zeros(WIDTH), theta])
    m, s = np.zeros_like(p), np.zeros_like(p)
    penalty = np.concatenate([np.full(DIMS, PENALTY), np.zeros(WIDTH - DIMS)])
    for step in range(1, STEPS + 1):
        w, theta = p[:WIDTH], p[WIDTH:]
        t = np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])]))
        z = np.bincount(doc, v * w[places], n)
        tail = 1 / (1 + np.exp(-np.clip(z[:, None] - t[None, :], -60, 60)))
        full = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], 1)
        slope = full * (1 - full)
        upper, lower = np.take_along_axis(full, y[:, None], 1)[:, 0], np.take_along_axis(full, y[:, None] + 1, 1)[:, 0]
        prob = np.maximum(upper - lower, 1e-12)
        d_up, d_low = np.take_along_axis(slope, y[:, None], 1)[:, 0] / prob, np.take_along_axis(slope, y[:, None] + 1, 1)[:, 0] / prob
        g_z = -(d_up - d_low) / n
        g_t = np.bincount(np.concatenate([y, y + 1]), np.concatenate([d_up, -d_low]), k + 1)[1:k] / n
        g_theta = np.concatenate([[g_t.sum()], np.exp(theta[1:]) * np.cumsum(g_t[::-1])[::-1][1:]])
        g = np.concatenate([np.bincount(places, v * g_z[doc], WIDTH) + penalty * w, g_theta])
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        p = p - RATE / (1 + step / 50) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    theta = p[WIDTH:]
    return Model([int(g) for g in grades], p[:WIDTH] * scale, np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])])))


def train(docs: DataFrame, ratings: DataFrame, rating_col: str = "quality", most: int = MOST_RATED, most_values: int = MOST_VALUES) -> Model:
    """Fit on at most `most` rated documents and most_values feature values (8 bytes each on the driver), which the executors make."""
    clean = ratings.filter(F.col("doc_id").isNotNull() & F.col(rating_col).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(rating_col).cast("int")).alias("rating"))
    sample = clean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [sparse_features(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rating"), pa.array([g[0].tobytes() for g in got], pa.binary()), pa.array([g[1].tobytes() for g in got], pa.binary())], names=["doc_id", "rating", "places", "values"])

    made = store(rows.select("doc_id", "rating", "text").mapInArrow(features, "doc_id long, rating int, places binary, values binary").withColumn("size", F.length("values") / 4), "rated-features")
    # at most `most` ids (more only if rows repeat an id), so one task may add up their sizes
    ids = made.groupBy("doc_id").agg(F.sum("size").alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    fits = ids.withColumn("sum", F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("sum") <= most_values)
    got = made.join(F.broadcast(fits.select("doc_id")), "doc_id").select("doc_id", "rating", "places", "values").toArrow()
    discard(docs.sparkSession, made._scratch_path)
    places = [np.frombuffer(x.as_py(), np.int32) for x in got["places"]]
    values = [np.frombuffer(x.as_py(), np.float32) for x in got["values"]]
    # a fixed order, so that sums come out alike whichever task was first
    order = np.lexsort(([len(x) for x in places], np.asarray(got["doc_id"])))
    cat = lambda xs, kind: np.concatenate([xs[i] for i in order]) if len(order) else np.zeros(0, kind)
    return fit(cat(places, np.int32), cat(values, np.float32), np.cumsum([len(places[i]) for i in order]).astype(int), np.asarray(got["rating"])[order])


def with_grades(docs: DataFrame, model: Model, grade: int | None = None, prefix: str = "") -> DataFrame:
    """All columns of docs, and expected_grade and tail_probability (of `grade` or better; None: the second grade), each named after prefix."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    text_at, names = docs.columns.index("text"), docs.columns
    k = model.grades.index(grade) - 1 if grade in model.grades[1:] else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        steps = np.diff(np.asarray(m.grades, float))
        for batch in batches:
            text = batch.column(text_at)
            data, offsets = text_buffers(text)
            expected, tail = np.full(batch.num_rows, float(m.grades[0])), np.ones(batch.num_rows)
            for i, j in blocks(offsets, BLOCK) if len(steps) else ():
                repeats = np.asarray([repetition(t) for t in text.slice(i, j - i).to_pylist()])
                part = data[offsets[i] : offsets[j]]
                z = np.asarray([m.linear_long(part, repeats[0], BLOCK)]) if len(part) > 4 * BLOCK else m.linear(part, offsets[i : j + 1] - offsets[i], repeats)
                tails = m.tails(z)
                expected[i:j] += tails @ steps
                tail[i:j] = tails[:, k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(expected), pa.array(tail)], names=[*names, f"{prefix}expected_grade", f"{prefix}tail_probability"])

    schema = T.StructType([*docs.schema.fields, T.StructField(f"{prefix}expected_grade", T.DoubleType()), T.StructField(f"{prefix}tail_probability", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def report(docs: DataFrame, ratings: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_probability, selected of every document; ratings of fold 0 (crc32 of the id as text, modulo 5) are held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = with_grades(rows, train(docs, ratings.filter(fold(F.col("doc_id")) != 0)))
    return got.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= least).alias("selected"))


def select(docs: DataFrame, ratings: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows of docs, columns unchanged, whose tail probability is at least `least`."""
    prefix = "_"
    while any(fresh(docs.columns, f"{prefix}{n}") != f"{prefix}{n}" for n in ("expected_grade", "tail_probability")):
        prefix += "_"
    got = with_grades(docs.withColumn("text", F.col("text").cast("string")), train(docs, ratings), prefix=prefix)
    return got.filter(F.col(f"{prefix}tail_probability") >= least).drop(f"{prefix}expected_grade", f"{prefix}tail_probability")
