"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Texts are lower-cased; words are runs of ASCII letters and digits and of all
characters beyond ASCII.  An item's n-grams are looked up in every document, and
each of them is a seed, however many documents hold it: of an item that is
everywhere, an edited copy may have kept only n-grams that are everywhere too.
Around each seed hit the item is aligned with the document's words (match +2,
mismatch -1, gap -1); the score over its largest possible value (0 to 1)
decides.  Edited and partial copies score by what is left of the item.  Where
the words that item and surroundings have in common could not reach the
threshold even if all of them matched, the alignment is spared.

Items are sent to the tasks in slices of bounded size; documents stay where
they are read, so nothing of the corpus is shuffled.

Defined results: null, empty and word-less texts and items never match; an item
of fewer words than a seed is its own seed; repeated rows are judged each time;
items with equal ids are separate items, equal rows are one; empty tables give
no matches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BYTE_VALUES, blocks, mix, powers, text_buffers

SEED_WORDS = 3
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5
#: Words of items in one slice (8 bytes each, and as much again for each seed).
MOST_ITEM_WORDS = 2_000_000
BLOCK = 1 << 19

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, document of every word) of a buffer of lower-cased documents."""
    n = len(data)
    inside = _WORD_BYTE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[1:-1][offsets[1:-1] < n]
    begins[edges] |= inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    start, stop = np.nonzero(begins)[0], np.nonzero(ends)[0] + 1
    power, back = powers(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUES[data] * power[:n])])
    return mix((sums[stop] - sums[start]) * back[start]), np.searchsorted(offsets, start, "right") - 1


def long_word_hashes(data: np.ndarray, block: int) -> np.ndarray:
    """Word hashes of one long document, made for about `block` bytes at a time; cuts fall between words."""
    out, a = [], 0
    while a < len(data):
        b = min(len(data), a + block)
        while b < len(data):
            gaps = np.nonzero(~_WORD_BYTE[data[b : b + block]])[0]
            b = min(len(data), b + (int(gaps[0]) if len(gaps) else block))
            if len(gaps):
                break
        out.append(word_hashes(data[a:b], np.asarray([0, b - a]))[0])
        a = b
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    h = np.full(max(0, len(words) - n + 1), np.uint64(n))
    for i in range(n):
        h = mix(h ^ words[i : len(words) - n + 1 + i])
    return h


def hashed_texts(arr: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, word hashes, row of each word) in blocks of a text column."""
    data, offsets = text_buffers(pc.utf8_lower(arr.cast(pa.string()) if not pa.types.is_large_string(arr.type) else arr))
    for i, j in blocks(offsets, BLOCK):
        if offsets[j] - offsets[i] > 4 * BLOCK:  # one long document
            words = long_word_hashes(data[offsets[i] : offsets[j]], BLOCK)
            yield i, j, words, np.full(len(words), i)
            continue
        words, row = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        yield i, j, words, row + i


@dataclass
class Items:
    """Items of one slice: their words, and their n-grams by hash."""

    ids: list
    words: list[np.ndarray]
    bags: list[tuple[np.ndarray, np.ndarray]]  # of each item: its distinct words, sorted, and how often it has them
    sizes: list[int]  # lengths of n-grams in use
    grams: np.ndarray  # sorted hashes of distinct n-grams
    seen_in: list[list[tuple[int, int]]]  # of each n-gram: (item, place)
    sieve: np.ndarray | None = None

    @staticmethod
    def of(rows: list[tuple]) -> Items:
        ids, words, found = [], [], {}
        for item_id, text in rows:
            arr = pa.array([text or ""], pa.string())
            own = next((w for *_, w, _ in hashed_texts(arr)), np.zeros(0, np.uint64))
            if not len(own):
                continue
            n = min(SEED_WORDS, len(own))
            for place, g in enumerate(gram_hashes(own, n).tolist()):
                found.setdefault(g, []).append((len(ids), place))
            ids.append(item_id)
            words.append(own)
        grams = np.asarray(sorted(found), np.uint64)
        return Items(ids, words, [np.unique(w, return_counts=True) for w in words], sorted({min(SEED_WORDS, len(w)) for w in words}), grams, [found[g] for g in grams.tolist()])._sieved()

    def _sieved(self) -> Items:
        self.sieve = np.zeros(1 << max(16, (8 * max(1, len(self.grams))).bit_length()), bool)
        self.sieve[(self.grams & np.uint64(len(self.sieve) - 1)).astype(np.int64)] = True
        return self

    def common(self, item: int, text: np.ndarray) -> int:
        """How many words item and text have in common, repeats included: the most that an alignment can match."""
        own, n = self.bags[item]
        at = np.minimum(np.searchsorted(own, text), len(own) - 1)
        return int(np.minimum(np.bincount(at[own[at] == text], minlength=len(own)), n).sum())

    def hits(self, words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the word, n-gram) wherever an n-gram of the items begins, within one document."""
        where, which = [], []
        for n in self.sizes:
            h = gram_hashes(words, n)
            if not len(h) or not len(self.grams):
                continue
            at = np.nonzero(self.sieve[(h & np.uint64(len(self.sieve) - 1)).astype(np.int64)])[0]
            at = at[row[at] == row[at + n - 1]]
            g = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
            ok = self.grams[g] == h[at]
            where.append(at[ok])
            which.append(g[ok])
        return (np.concatenate(where), np.concatenate(which)) if where else (np.zeros(0, int), np.zeros(0, int))


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman over words: (score, first word, word after the last) of the best local alignment in text."""
    m, n = len(item), len(text)
    slope = GAP * np.arange(n + 1)
    above, origin = np.zeros(n + 1, int), np.arange(n + 1)
    best = (0, 0, 0)
    for i in range(m):
        diagonal = above[:-1] + np.where(text == item[i], MATCH, MISMATCH)
        up = above[1:] + GAP
        here = np.concatenate([[0], np.maximum(np.maximum(diagonal, up), 0)])
        start = np.concatenate([[0], np.where(diagonal >= up, origin[:-1], origin[1:])])
        start = np.where(here == 0, np.arange(n + 1), start)
        # gaps along the text: the best of all cells to the left, less a gap for each step
        level = here - slope
        top = np.maximum.accumulate(level)
        came = np.maximum.accumulate(np.where(level == top, np.arange(n + 1), 0))
        along = top + slope
        start = np.where(along > here, start[came], start)
        above, origin = np.maximum(here, along), start
        j = int(np.argmax(above))
        if above[j] > best[0]:
            best = (int(above[j]), int(origin[j]), j)
    return best


def matches_of(items: Items, words: np.ndarray, row: np.ndarray, threshold: float) -> list[tuple[int, int, float, int, int]]:
    """(row, item, score, first word, words) of each item found in a document of the block; places count from the document's first word."""
    place, gram = items.hits(words, row)
    spots: dict[tuple[int, int], list[int]] = {}
    for p, g in zip(place.tolist(), gram.tolist()):
        for item, at in items.seen_in[g]:
            spots.setdefault((int(row[p]), item), []).append(p - at)
    out = []
    for (r, item), begins in spots.items():
        own = items.words[item]
        m, first, end = len(own), int(np.searchsorted(row, r, "left")), int(np.searchsorted(row, r, "right"))
        best, done = (0, 0, 0), -1
        pad = m // 2 + 2
        windows: list[list[int]] = []
        for b in sorted(set(begins)):
            a, z = max(first, b - pad), min(end, b + m + pad)
            if windows and a <= windows[-1][1]:
                windows[-1][1] = max(windows[-1][1], z)
            else:
                windows.append([a, z])
        for a, z in windows:
            if best[0] == MATCH * m:
                break
            most = MATCH * items.common(item, words[a:z])
            if most <= best[0] or most / (MATCH * m) < threshold:
                continue
            score, s, e = align(own, words[a:z])
            if score > best[0]:
                best = (score, a + s - first, a + e - first)
        share = best[0] / (MATCH * m)
        if share >= threshold:
            out.append((r, item, share, best[1], best[2] - best[1]))
    return out


def _slices(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """Items (id, text), some MOST_ITEM_WORDS at a time."""
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    words = rows.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"\s+")))).first()[0] or 0
    n = max(1, math.ceil(words / MOST_ITEM_WORDS))
    for i in range(n):
        yield [(r["item_id"], r["text"]) for r in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).orderBy("item_id", "text").collect()]


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, first_word, n_words of every item found in a document."""
    spark = docs.sparkSession
    item_type = benchmark.schema["item_id"].dataType
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", item_type), T.StructField("score", T.DoubleType()), T.StructField("first_word", T.IntegerType()), T.StructField("n_words", T.IntegerType())])
    out = spark.createDataFrame([], schema)
    arrow_item = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(item_type.simpleString(), pa.int64())
    for rows in _slices(benchmark):
        if not rows:
            continue
        known = spark.sparkContext.broadcast(Items.of(rows))

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            items = known.value
            for b in batches:
                ids, found = b.column(0).to_pylist(), []
                for _, _, words, row in hashed_texts(b.column(1)):
                    found += matches_of(items, words, row, threshold)
                cols = [[ids[f[0]] for f in found], [items.ids[f[1]] for f in found], [f[2] for f in found], [f[3] for f in found], [f[4] for f in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), arrow_item, pa.float64(), pa.int32(), pa.int32()))], names=schema.names)

        out = out.unionByName(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs, columns unchanged, in which no item is found."""
    spark, text_at = docs.sparkSession, docs.columns.index("text")
    for rows in _slices(benchmark):
        if not rows:
            continue
        known = spark.sparkContext.broadcast(Items.of(rows))

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for b in batches:
                kept = np.ones(b.num_rows, bool)
                for _, _, words, row in hashed_texts(b.column(text_at)):
                    kept[[f[0] for f in matches_of(known.value, words, row, threshold)]] = False
                yield b.filter(pa.array(kept))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
