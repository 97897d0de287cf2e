"""Best-fit packing of tokenised documents into sequences of a fixed length.

A document's ids end with an end id; only documents longer than a sequence are
cut, into full pieces after a first one that may be shorter.  Best-fit decreasing depends
on the pieces only through how many there are of each length, so the decisions
are made on that histogram (at most `capacity` rows, whatever the corpus size):
lengths go from long to short, a segment tree over remaining capacities finds
the tightest open bin that still takes a piece, and bins in the same state are
kept as runs.  The outcome is exactly that of the one-piece-at-a-time algorithm,
as a list of runs "the k-th to m-th piece of length L go to these sequences".
Each piece then finds its place from its length and its rank among the pieces of
that length; ranks are counted in (length, bucket) groups and joined up by a
running sum over buckets, so a length that a third of all pieces have is
ranked by many tasks.

Defined results: null text is an empty document (one piece, the end id alone);
repeated rows are packed once per row; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, store

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bucket int"


@functools.cache
def encoder(path: str):
    """texts -> lists of ids, as tokenizers gives them for the byte-level BPE file at `path`.

    The file's merges run through tiktoken, which makes the same ids in a
    quarter of the time; a text that holds the string of an added token goes
    through tokenizers itself, whose rules for these strings count.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    slow = Tokenizer.from_file(path)
    #: The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on.
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in shown}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    added = [x["content"] for x in spec.get("added_tokens", [])]
    ranks = {bytes(byte_of[c] for c in tok): i for tok, i in spec["model"]["vocab"].items() if tok not in added}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if any(a in text for a in added):
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, buckets: int = 64) -> DataFrame:
    """One row per piece of every document: PIECES."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(ids, texts):
                all_ids = np.asarray([*encode(text.as_py() or ""), end_id], "<u4")
                cuts = [0, *range((len(all_ids) - 1) % capacity + 1, len(all_ids) + 1, capacity)]
                for k, (at, end) in enumerate(zip(cuts, cuts[1:])):
                    part = all_ids[at:end]
                    for col, v in zip(rows, (doc, k, at, len(part), zlib.crc32(part.tobytes()))):
                        col.append(v)
            crc = np.asarray(rows[4], np.int64)
            doc_arr = pa.array(rows[0], pa.int64())
            where = (np.asarray(doc_arr.fill_null(0)) * 0x5851F42D + np.asarray(rows[1], np.int64) * 7919) % 2**31 % buckets
            yield pa.RecordBatch.from_arrays(
                [doc_arr, pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64()), pa.array(crc), pa.array(where, pa.int32())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "bucket"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


class CapacityTree:
    """Segment tree over remaining capacities 0..size: which of them have open bins, and the least one that is at least x."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.leaves
        while i:
            self.open[i] += n
            i >>= 1

    def tightest(self, need: int) -> int | None:
        i = need + self.leaves
        if self.open[i]:
            return need
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over counts by length.

    Returns runs (length, first rank, pieces, first sequence, pieces per
    sequence, offset of the first piece in each) and the number of sequences.
    """
    tree = CapacityTree(capacity)
    open_bins: dict[int, list[tuple[int, int]]] = {}  # remaining -> runs (first sequence, how many)
    runs, made = [], 0

    def push(remaining: int, first: int, n: int) -> None:
        if remaining and n:
            open_bins.setdefault(remaining, []).append((first, n))
            tree.add(remaining, 1)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            r = tree.tightest(length)
            if r is None:
                r, first, n = capacity, made, -(-left // (capacity // length))
                made += n
            else:
                first, n = open_bins[r].pop()
                tree.add(r, -1)
            fit = r // length
            full = min(n, left // fit)  # bins that take `fit` pieces, one after the other
            if full:
                runs.append((length, rank, full * fit, first, fit, capacity - r))
                rank, left = rank + full * fit, left - full * fit
                push(r - fit * length, first, full)
            if full < n and left:  # fewer pieces than fit in one more bin
                runs.append((length, rank, left, first + full, fit, capacity - r))
                push(r - left * length, first + full, 1)
                push(r, first + full + 1, n - full - 1)
                left = 0
            elif full < n:
                push(r, first + full, n - full)
    return np.asarray(runs, np.int64).reshape(-1, 6), made


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    buckets = max(64, partitions(spark))
    cut = store(pieces(docs, tokenizer, capacity, end_id, buckets), "packing-pieces")
    counts = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    runs, _ = plan(histogram, capacity)
    lengths = runs[:, 0] if len(runs) else np.zeros(0, np.int64)
    by_length = {int(n): runs[lengths == n] for n in np.unique(lengths)}

    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = cut.withColumn("own", own).join(before, ["length", "bucket"]).withColumn("rank", F.col("own") + F.col("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = {n: batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at, mine = np.nonzero(length == n)[0], by_length[int(n)]
                run = mine[np.searchsorted(mine[:, 1], rank[at], "right") - 1]
                k = rank[at] - run[:, 1]
                seq[at], off[at] = run[:, 3] + k // run[:, 4], run[:, 5] + k % run[:, 4] * n
            yield pa.RecordBatch.from_arrays([*got.values(), pa.array(seq), pa.array(off)], names=[*got, "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
