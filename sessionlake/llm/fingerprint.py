"""Canonical exact digests of documents.

Canonical form: Unicode NFKC, case folding, runs of white space made one space,
none at the ends.  Fingerprint: XXH3-128 of its UTF-8 bytes.  Equal texts, and
texts that differ only in what the canonical form drops, have equal
fingerprints; the likeness of two fingerprints is 1 if they are equal (their
canonical bytes are then compared as well) and 0 otherwise, as an exact digest
has no degrees in between.

Defined results: null text is empty; equal ids are ordered by text; the one row
of a single-row table is its own next document; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, store

#: Stands for a null doc_id where ids are put in order: below every other.
_LEAST = -(2**63)
#: A list of up to so many documents in shared buckets (24 bytes each) is broadcast to pick their texts; a longer one is shuffled.
MOST_BROADCAST_DOCS = 500_000


def canonical(text: str) -> bytes:
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split()).encode("utf-8", "surrogatepass")


def digest(form: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(form)


def likeness(a: bytes, b: bytes) -> float:
    return 1.0 if digest(a) == digest(b) and a == b else 0.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, form (the canonical text) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms = [canonical(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([digest(f) for f in forms], pa.string()), pa.array(forms, pa.binary())], names=["doc_id", "fingerprint", "form"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string, form binary")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, group_id: the smallest doc_id among the documents with the same canonical bytes.

    Buckets are made by the wide hash.  Inside a bucket bytes are compared by
    grouping on them as well, which pre-aggregates in each task; only one row
    for each distinct form and task is shuffled, so a hot group stays small.
    """
    forms = store(fingerprints(docs, id_col, text_col).select("doc_id", "fingerprint", "form", F.sha2("form", 256).alias("bytes_id")), "canonical-forms")
    # classes of equal bytes within each bucket; sha-256 of the bytes tells apart the classes of a bucket when rows look theirs up
    classes = store(forms.groupBy("fingerprint", "form").agg(F.min("doc_id").alias("group_id"), F.first("bytes_id").alias("bytes_id")).select("fingerprint", "bytes_id", "group_id"), "classes")
    return forms.select("doc_id", "fingerprint", "bytes_id").join(classes, ["fingerprint", "bytes_id"]).select("doc_id", "fingerprint", "group_id")


def with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document, of its edited text, and how they and the next document's compare.

    The next document is the one after it by descending doc_id.  One shuffle of
    the texts, into ranges of doc_id; a copy of each range's first document
    goes to the range before it, so every task has all the neighbours it needs.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = max(2, partitions(spark))
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("key"))
    # n - 1 range bounds from the whole id column, whatever its size
    cuts = sorted(set(ids.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 10_000).alias("q")).first()["q"] or []))
    lower = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    # range 0 has the largest ids
    # how many bounds are below the key, by binary search
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))]) if cuts else F.array().cast("array<int>")
    below = F.reduce(steps, F.lit(0), lambda at, s: F.when((at + s <= len(cuts)) & (F.get(lower, at + s - 1) < F.col("key")), at + s).otherwise(at))
    part = (F.lit(len(cuts)) - below).cast("int")
    heads = {r["part"]: r["head"] for r in ids.select(part.alias("part"), "key").groupBy("part").agg(F.max("key").alias("head")).collect()}  # a row for each range
    order = sorted(heads)
    #: key of a range's first document -> the range before it (for the first of all: the last)
    before = {heads[p]: order[i - 1] for i, p in enumerate(order)}
    if not order:
        where = F.array(part)
    else:
        extra = F.create_map(*[x for k, p in before.items() for x in (F.lit(k).cast("long"), F.lit(p + n))])[F.col("key")]
        where = F.array_compact(F.array(part, extra))
    # the copy of a head comes as range + n: it sorts last there and only serves as the next document
    dealt = rows.select(F.explode(where).alias("to"), "key", "doc_id", "text").select(F.pmod("to", F.lit(n)).cast("int").alias("to"), (F.col("to") >= n).alias("copy"), "key", "doc_id", "text")
    dealt = dealt.repartitionById(n, F.col("to")).sortWithinPartitions("copy", F.desc("key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of():
            for b in batches:
                yield from zip(b.column("copy").to_pylist(), b.column("doc_id").to_pylist(), b.column("text"))

        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        out: list[tuple] = []
        prev = None
        for copy, doc, text in rows_of():
            text = text.as_py()
            form = canonical(text)
            if prev is not None:
                out.append(_compare(prev, text, form))
                if len(out) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out = []
            # equal ids may copy several rows; the first in order is the neighbour
            prev = None if copy else (doc, text, form)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def grouped(docs: DataFrame) -> DataFrame:
    """with_edits, and group_id: the smallest doc_id of the documents with the same canonical bytes.

    Fingerprints make the buckets.  Only texts of buckets with several documents
    are read again, and their bytes compared by grouping on them.
    """
    got = store(with_edits(docs), "fingerprints")
    ids = got.select(F.coalesce("doc_id", F.lit(_LEAST)).alias("key"), "fingerprint")
    # written down, so that both sides of the join are dealt out for it alone and a hot fingerprint's partition can be split
    shared = store(ids.groupBy("fingerprint").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("fingerprint"), "shared-fingerprints")
    met = store(ids.join(shared, "fingerprint").distinct(), "shared-buckets")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    at = met.select(F.col("key").alias("doc_id")).distinct()
    texts = keyed.join(F.broadcast(at) if met.count() <= MOST_BROADCAST_DOCS else at, "doc_id", "left_semi")
    groups = store(exact_groups(texts).groupBy(F.col("doc_id").alias("key"), "fingerprint").agg(F.min("group_id").alias("group_id")), "groups")
    out = got.withColumn("key", F.coalesce("doc_id", F.lit(_LEAST))).join(groups, ["key", "fingerprint"], "left")
    return out.withColumn("group_id", F.nullif(F.coalesce("group_id", "key"), F.lit(_LEAST))).drop("key")


def _compare(doc: tuple, next_text: str, next_form: bytes) -> tuple:
    doc_id, text, form = doc
    cut = len(text) // 3
    edited = text[: len(text) - cut] + next_text[:cut]
    edited_form = canonical(edited)
    return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), digest(form), digest(edited_form), likeness(form, edited_form), likeness(form, next_form)
