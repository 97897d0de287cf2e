"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine.

Terms are words cut to their first STEM letters, which needs no word list or
language and puts inflected forms together.  Examples are a bounded sample of
labelled documents, as many of each label as there are up to half of
`most_examples`; copies of a text count once.  Their terms, all of them, are
the vocabulary.  Document frequencies, and so IDF, are
counted over all documents.  A weight is (1 + ln count) * idf, scaled to length 1.

Search: examples are put in order of the leader they resemble most and cut into
blocks.  The inverted index keeps the postings of common terms block by block,
each with its largest weight.  A query adds up the postings of its rare terms,
then bounds every block by what these gave and the maxima of the common ones,
scores the blocks of the largest bounds, and goes on while a block's bound
reaches the k-th similarity found; the result is exactly the k nearest.

Score: neighbours vote with the distance by which they are nearer than the
next one, the (k+1)-th (Dudani's rule), examples of the less sampled label for
more.  A monotone calibration (fitted on each example's votes from the others,
weighed to the labels' own rate) maps the share of toxic votes to a
probability.  The nearest examples are the evidence.

Defined results: null and empty texts, and texts without a word, have no
neighbours and get the rate of such texts among the examples; texts whose words
no example has get the rate of all labels; a null doc_id is scored like any
other, and so is every one of repeated rows; labels that are null, or whose
document is missing, are not used; of several labels of one document the
largest counts; without any usable label every score is the prior 0; an empty
table gives no rows.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, fold, store

#: Letters that are kept of a word; whole words of inflected or compounding languages are too rare to meet in a bounded sample.
STEM = 4
WORD = re.compile(rf"([^\W\d_]{{1,{STEM}}})[^\W\d_]*")
#: Labelled documents that are sampled for the fit, by hash of doc_id, half of them for either label; more labels change nothing.
MOST_EXAMPLES = 5_120
#: Entries (a term of an example) that the index may have; very long examples end the sample earlier.
MOST_ENTRIES = 2_500_000
#: Neighbours: this share of the examples, or this many.
NEIGHBOUR_SHARE, LEAST_NEIGHBOURS = 1 / 16, 25
#: Examples in a block of the index, and leaders that put them in order.
BLOCK, LEADERS = 512, 32
#: Terms that this share of the examples have are kept as rows of a whole block's weights.
COMMON = 1 / 16


def words_of(text: str | None) -> list[str]:
    """The first letters of each word."""
    return WORD.findall((text or "").lower())


def sample_labels(labels: DataFrame, label_col: str, most: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, label of the labelled documents with the least hashes, most / 2 of a label; and the numbers of all labelled documents."""
    clean = labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col(label_col).cast("int") > 0).cast("int")).alias("label"))
    totals = {r["label"]: r["n"] for r in clean.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    part = lambda label: clean.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2)
    return part(0).unionByName(part(1)), totals


def term_counts(examples: DataFrame) -> DataFrame:
    """doc_id, label, copy (a hash of the text), terms, counts of examples (doc_id, label, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [Counter(words_of(t.as_py())) for t in b.column("text")]
            terms = pa.array([sorted(c) for c in own], pa.list_(pa.string()))
            counts = pa.array([[c[t] for t in sorted(c)] for c in own], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), b.column("copy"), terms, counts], names=["doc_id", "label", "copy", "terms", "counts"])

    return examples.select("doc_id", "label", F.xxhash64("text").alias("copy"), "text").mapInArrow(run, "doc_id long, label int, copy long, terms array<string>, counts array<int>")


class Lookup:
    """Texts to (term numbers, counts) over a vocabulary; other words only count as words."""

    def __init__(self, terms: list[str]):
        self.place = {t: i for i, t in enumerate(terms)}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray, bool]:
        found = words_of(text)
        terms, counts = np.unique(np.fromiter(map(self.place.get, found, itertools.repeat(-1)), np.int64, len(found)), return_counts=True)
        known = int(np.searchsorted(terms, 0))
        return terms[known:], counts[known:], bool(found)


def document_frequencies(docs: DataFrame, lookup, size: int) -> tuple[np.ndarray, int]:
    """In how many of docs each term of the vocabulary is, and how many docs there are; at most `size` rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(size + 1, np.int64), 0
        for b in batches:
            for text in b.column("text"):
                seen[lookup.value(text.as_py())[0]] += 1
                n += 1
        seen[size] = n
        at = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["term", "n"])

    got = docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(size + 1, np.int64)
    df[got.column("term").to_numpy()] = got.column("n").to_numpy()
    return df[:size], int(df[size])


class Index:
    """Block-max inverted index over the unit vectors of examples.

    owner, term, count: the entries, sorted by owner; label and doc_id: of each
    owner.  Postings lie by (term, example).  Terms that `common` of the
    examples or more have are kept block by block as rows of all the block's
    weights (in single precision), with each row's largest weight.
    """

    def __init__(self, owner: np.ndarray, term: np.ndarray, count: np.ndarray, idf: np.ndarray, label: np.ndarray, doc_id: np.ndarray, block: int = BLOCK, leaders: int = LEADERS, common: float = COMMON):
        self.idf, self.n, self.block = idf, len(label), block
        weight = (1 + np.log(count)) * idf[term]
        weight /= np.sqrt(np.bincount(owner, weight * weight, self.n))[owner]
        place = self._order(owner, term, weight, leaders)
        # the examples' own vectors, to judge them by the others
        self.place, self.start, self.terms, self.counts = place, np.searchsorted(owner, np.arange(self.n + 1)), term.astype(np.int32), count.astype(np.int32)
        self.label, self.doc_id = np.empty(self.n, np.int64), np.empty(self.n, np.int64)
        self.label[place], self.doc_id[place] = label, doc_id
        owner = place[owner]
        self.blocks = -(-self.n // block)
        held = np.bincount(term, minlength=len(idf))
        often = np.nonzero(held >= max(2, common * self.n))[0]
        self.row = np.full(len(idf), -1)
        self.row[often] = np.arange(len(often))
        row = self.row[term]
        # (block, term, example in the block): what a query reads of a block lies together
        self.dense = np.zeros((self.blocks, len(often), block), np.float32)
        mine = row >= 0
        self.dense[owner[mine] // block, row[mine], owner[mine] % block] = weight[mine]
        self.most = self.dense.max(2).T.copy() if len(often) else np.zeros((0, self.blocks), np.float32)
        by = np.lexsort((owner[~mine], term[~mine]))
        term, self.owner, self.weight = term[~mine][by], owner[~mine][by].astype(np.int64), weight[~mine][by]
        self.term_start = np.searchsorted(term, np.arange(len(idf) + 1))

    def _order(self, owner: np.ndarray, term: np.ndarray, weight: np.ndarray, leaders: int) -> np.ndarray:
        """Places at which examples that are nearest to the same leader stand together."""
        heads = np.unique(np.linspace(0, self.n - 1, min(leaders, self.n)).astype(int))
        best, which = np.full(self.n, -1.0), np.zeros(self.n, int)
        for k, head in enumerate(heads):
            own = np.zeros(len(self.idf))
            mine = slice(*np.searchsorted(owner, [head, head + 1]))
            own[term[mine]] = weight[mine]
            cos = np.bincount(owner, weight * own[term], self.n)
            which[cos > best] = k
            best = np.maximum(best, cos)
        place = np.empty(self.n, np.int64)
        place[np.argsort(which, kind="stable")] = np.arange(self.n)
        return place

    def nearest(self, terms: np.ndarray, counts: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, examples) of the k nearest with a cosine above 0, nearest first (ties: the first examples); without: an example to leave out."""
        if not len(terms):
            return np.zeros(0), np.zeros(0, int)
        w = (1 + np.log(counts)) * self.idf[terms]
        w /= np.sqrt((w * w).sum())
        rows = self.row[terms]
        rare, rows, at = rows < 0, rows[rows >= 0], w[rows >= 0]
        start, size = self.term_start[terms[rare]], self.term_start[terms[rare] + 1] - self.term_start[terms[rare]]
        entries = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        score = np.bincount(self.owner[entries], self.weight[entries] * np.repeat(w[rare], size), self.blocks * self.block).astype(float).reshape(self.blocks, self.block)
        # the most that an example of a block can have: what rare terms gave it, and the largest weights of the others; a hair more for rounding
        at = at.astype(np.float32)
        bound = (score.max(1) + at @ self.most[rows]) * (1 + 1e-5)
        left, first, done, least = np.argsort(-bound, kind="stable"), max(1, -(-2 * k // self.block)), np.zeros(self.blocks, bool), 0.0
        while len(left):
            for b in left[:first].tolist():
                score[b] += at @ self.dense[b][rows]
            done[left[:first]] = True
            if without >= 0:
                score[divmod(without, self.block)] = 0
            seen = score[done].ravel()
            least = np.partition(seen, -k)[-k] if len(seen) > k else 0.0
            left = left[first:]
            left, first = left[(bound[left] >= least) & (bound[left] > 0)], max(1, first // 2)
        score[~done] = 0
        score = score.ravel()
        top = np.nonzero(score >= max(least, 1e-300))[0]
        top = top[np.lexsort((top, -score[top]))][:k]
        return score[top], top

    def votes(self, found: tuple[np.ndarray, np.ndarray], k: int, worth: np.ndarray) -> float:
        """Share of toxic votes among the k nearest of found (k + 1 of them, if there are as many); worth: of an example of either label."""
        cos, at = found
        floor = cos[k] if len(cos) > k else 0.0
        weight = np.maximum(cos[:k] - floor, 1e-12) * worth[self.label[at[:k]]]
        return float(weight[self.label[at[:k]] == 1].sum() / weight.sum())


def calibration(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic map from vote share to probability (pool adjacent violators) of weighted examples; half an example of each label smooths a pool."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []  # weight of label 1, weight, weighted votes, examples
    for v, y, w in zip(votes[order].tolist(), labels[order].tolist(), weights[order].tolist()):
        pools.append([y * w, w, v * w, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    x = np.asarray([p[2] / p[1] for p in pools])
    y = np.asarray([(p[0] + 0.5 * p[1] / p[3]) / (p[1] + p[1] / p[3]) for p in pools])
    return x, np.maximum.accumulate(y)


def collect_examples(examples: DataFrame, most: int, most_entries: int) -> pa.Table:
    """doc_id, label, terms, counts of the examples, one for each text; no more than `most`, and no more entries than most_entries."""
    counted = store(term_counts(examples), "toxicity-terms")
    one = counted.withColumn("size", F.size("terms")).groupBy("copy").agg(F.max("label").alias("label"), F.min("doc_id").alias("doc_id"), F.min("size").alias("size")).orderBy(F.xxhash64("doc_id"), "copy").limit(most)
    # at most most_examples rows, so one task may add up their sizes; labels take turns, so that both are there
    turn = one.withColumn("turn", F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "copy")))
    fits = turn.withColumn("sum", F.sum("size").over(Window.orderBy("turn", "label").rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("sum") <= most_entries)
    # of rows with one doc_id and several texts each text is there under its own hash
    texts = counted.groupBy("copy").agg(F.first("terms").alias("terms"), F.first("counts").alias("counts"))
    got = fits.join(texts, "copy").select("doc_id", "label", "copy", "terms", "counts").toArrow().sort_by([("doc_id", "ascending"), ("copy", "ascending")]).combine_chunks()
    discard(examples.sparkSession, counted._scratch_path)
    return got


def score(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", most_examples: int = MOST_EXAMPLES, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """doc_id, score, predicted, neighbours (doc_id, cosine) of every document; only rows of `labels` are learned from."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample, totals = sample_labels(labels, label_col, most_examples)
    # at most most_examples rows of 12 bytes
    examples = store(rows.join(F.broadcast(sample), "doc_id"), "toxicity-examples")
    got = collect_examples(examples, most_examples, most_entries)
    discard(spark, examples._scratch_path)
    rate = totals.get(1, 0) / max(1, sum(totals.values()))
    label = got.column("label").to_numpy().astype(np.int64)
    sizes = pc.list_value_length(got.column("terms")).to_numpy().astype(np.int64)
    # an example stands for so many of its label
    worth = np.asarray([(1 - rate) / max(1, (label == 0).sum()), rate / max(1, (label == 1).sum())])
    bare = worth[label[sizes == 0]]
    plain = float((bare[label[sizes == 0] == 1].sum() + rate * worth.max()) / (bare.sum() + worth.max())) if len(label) else 0.0
    got, label = got.filter(pa.array(sizes > 0)), label[sizes > 0]
    if not len(label):
        return rows.select("doc_id", F.lit(plain).alias("score"), F.lit(int(plain >= 0.5)).alias("predicted"), F.expr("cast(array() as array<struct<doc_id:bigint,cosine:double>>)").alias("neighbours"))

    entries = pc.list_flatten(got.column("terms")).combine_chunks().dictionary_encode()
    words, numbers = entries.dictionary.to_pylist(), entries.indices.to_numpy()
    lookup = spark.sparkContext.broadcast(Lookup(words))  # most_entries terms at most
    df, n = document_frequencies(rows, lookup, len(words))
    idf = np.log((1 + n) / (1 + df)) + 1
    owner = np.repeat(np.arange(len(label)), sizes[sizes > 0])
    made = Index(owner, numbers, pc.list_flatten(got.column("counts")).to_numpy(), idf, label, got.column("doc_id").to_numpy())
    index = spark.sparkContext.broadcast(made)  # 24 bytes an entry, and rows of 4 / COMMON bytes an entry at most
    k = min(max(LEAST_NEIGHBOURS, int(NEIGHBOUR_SHARE * made.n)), max(1, made.n - 2))
    even = 1 / np.maximum(1, np.bincount(label, minlength=2))
    votes, truth = example_votes(spark, index, k, even)
    x, y = calibration(votes, truth, worth[truth])

    neighbour = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("cosine", T.DoubleType())]))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("neighbours", neighbour)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, near = [], []
            for text in b.column("text"):
                terms, counts, any_words = lookup.value(text.as_py())
                found = index.value.nearest(terms, counts, k + 1)
                scores.append(float(np.interp(index.value.votes(found, k, even), x, y)) if len(found[0]) else rate if any_words else plain)
                near.append([{"doc_id": d, "cosine": c} for d, c in zip(index.value.doc_id[found[1][:5]].tolist(), found[0][:5].round(6).tolist())])
            s = np.clip(np.asarray(scores, float), 0, 1)
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(near, kind)], names=["doc_id", "score", "predicted", "neighbours"])

    return rows.mapInArrow(run, schema)


def example_votes(spark, index, k: int, even: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(votes, labels) of the examples, each judged by the others; made in tasks, most_examples rows come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, votes, labels = index.value, [], []
            for e in b.column("id").to_pylist():
                mine = slice(own.start[e], own.start[e + 1])
                found = own.nearest(own.terms[mine], own.counts[mine], k + 1, own.place[e])
                votes.append(own.votes(found, k, even) if len(found[0]) else -1.0)
                labels.append(own.label[own.place[e]])
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), pa.array(labels, pa.int32())], names=["vote", "label"])

    got = spark.range(0, index.value.n).mapInArrow(run, "vote double, label int").toArrow()
    vote, label = got.column("vote").to_numpy(), got.column("label").to_numpy().astype(np.int64)
    return vote[vote >= 0], label[vote >= 0]


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, neighbours; labels of fold 0 are held out."""
    got = score(docs, labels.filter(fold(F.col("doc_id")) != 0))
    return got.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted", "neighbours")
