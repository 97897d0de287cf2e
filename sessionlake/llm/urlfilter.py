"""URL filter: a blocked Bloom filter over listed canonical URLs, then an exact hash join.

A canonical URL is host (A-Z lower-cased) followed by path, without scheme,
query and fragment.  A listed entry covers its host and all subdomains, and all
paths that start with its own; an entry without a path covers the whole host.
A page's possible entries are its host's suffixes at label ends (up to the most
labels that a listed host has), each with the page's path cut at every length
that listed paths have.  Their hashes go
through the blocked Bloom filter (one 512-bit block for each key); what passes
is joined with the list on the full string, which removes false positives, and
the longest entry that is left decides.

Defined results: null urls, and urls without `://`, have empty host and path,
meet no entry and get the default verdict; a page row that is repeated is judged
each time; an empty list gives every page the default verdict.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, store

BLOCK_WORDS = 8  # 64-bit words in a block
PROBES = 8
BITS_A_KEY = 16
#: A list of up to so many entries is broadcast for the exact join (some 100 bytes an entry); a longer one is shuffled.
MOST_BROADCAST_ENTRIES = 100_000


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: positions of its probes' words within the block, and their bits."""
    x = h.view(np.uint64)[:, None] * (np.uint64(2) * np.arange(1, PROBES + 1, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))[None, :]
    x ^= x >> np.uint64(31)
    at = (x >> np.uint64(55)).astype(np.int64)  # 9 bits: a place among 512
    return at >> 6, np.uint64(1) << (at & 63).astype(np.uint64)


class BlockedBloom:
    """Bits as an array of 64-bit words; each key touches one block of 512 bits."""

    def __init__(self, blocks: int):
        self.words = np.zeros(blocks * BLOCK_WORDS, np.uint64)
        self.blocks = blocks

    def block(self, h: np.ndarray) -> np.ndarray:
        return (h.view(np.uint64) >> np.uint64(20)).astype(np.int64) % self.blocks

    def add(self, h: np.ndarray) -> None:
        word, bit = _bits(h)
        np.bitwise_or.at(self.words, (self.block(h)[:, None] * BLOCK_WORDS + word).ravel(), bit.ravel())

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        word, bit = _bits(h)
        return ((self.words[self.block(h)[:, None] * BLOCK_WORDS + word] & bit) == bit).all(1) if len(h) else np.zeros(0, bool)


def build_bloom(listed: DataFrame, n: int) -> BlockedBloom:
    """Filter of xxhash64 keys; each task sends the blocks that it has set, which are then or-ed."""
    blocks = max(1, -(-n * BITS_A_KEY // 512))
    out = BlockedBloom(blocks)

    def fill(batches):
        own = BlockedBloom(blocks)
        for b in batches:
            own.add(np.asarray(b.column(0)))
        at = np.nonzero(own.words)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own.words[at].view(np.int64))], names=["at", "word"])

    words = listed.select(F.xxhash64("entry").alias("h")).mapInArrow(fill, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    out.words[np.asarray(words["at"])] = np.asarray(words["word"]).view(np.uint64)
    return out


def judge(pages: DataFrame, listed: DataFrame, default: str = "allow", filter_mb: float = 64) -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    listed: entry (canonical URL), host, path, verdict, shown (what `rule` says;
    null where the entry is no rule of its own).  The Bloom filter is broadcast;
    a list that needs more than filter_mb is cut by hash into parts of that
    size, and the pages are led past one part's filter after the other.
    """
    spark: SparkSession = pages.sparkSession
    # written down, so that the exact join deals it out for itself and a hot entry's partition can be split
    first = F.min_by(F.struct("host", "path", "verdict", "shown"), F.struct(F.col("shown").isNull(), "verdict")).alias("x")  # a rule comes before a blocked URL
    listed = store(listed.groupBy("entry").agg(first).select("entry", "x.*"), "url-list")
    about = listed.agg(F.count("*").alias("n"), F.collect_set(F.length("path")).alias("lengths"), F.max(F.size(F.split("host", r"\."))).alias("labels")).first()  # as many lengths as listed paths have
    rows = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    if not about["n"]:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    lengths = F.array(*[F.lit(x) for x in sorted(about["lengths"])])
    labels = F.split("host", r"\.")
    # suffixes longer than any listed host can't be listed
    first = F.greatest(F.lit(1), F.size(labels) - about["labels"] + 1)
    suffixes = F.transform(F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cuts = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    keys = F.flatten(F.transform("suffixes", lambda s: F.transform("cuts", lambda p: F.concat(s, p))))
    probes = rows.withColumns({"suffixes": suffixes, "cuts": cuts}).withColumn("keys", F.array_distinct(keys))
    hashed = probes.select("page_id", "url", "keys", F.transform("keys", lambda k: F.xxhash64(k)).alias("hashes"))
    parts = math.ceil(about["n"] / max(1, int(filter_mb * 8e6 / BITS_A_KEY)))
    found = None
    for part in range(parts):
        own = listed.filter(F.pmod(F.xxhash64("entry"), F.lit(parts)) == part)
        bloom = spark.sparkContext.broadcast(build_bloom(own, own.count()))

        def possible(batches: Iterator[pa.RecordBatch], bloom=bloom, part=part) -> Iterator[pa.RecordBatch]:
            """A row for each of the part's keys that its filter lets pass."""
            for b in batches:
                keys, hashes = b.column("keys"), b.column("hashes")
                flat = np.asarray(hashes.flatten())
                passed = np.nonzero((flat % parts == part) & bloom.value.may_hold(flat))[0]
                row = np.searchsorted(np.asarray(hashes.offsets) - hashes.offsets[0].as_py(), passed, "right") - 1
                yield pa.RecordBatch.from_arrays([b.column("page_id").take(pa.array(row)), b.column("url").take(pa.array(row)), keys.flatten().take(pa.array(passed))], names=["page_id", "url", "entry"])

        passed = hashed.mapInArrow(possible, f"page_id {dict(rows.dtypes)['page_id']}, url string, entry string")
        found = passed if found is None else found.unionByName(passed)
    exact = listed.select("entry", "verdict", "shown")
    hits = found.join(F.broadcast(exact) if about["n"] <= MOST_BROADCAST_ENTRIES else exact, "entry")
    best = hits.groupBy("page_id", "url").agg(F.max_by(F.struct("verdict", "shown"), F.struct(F.col("shown").isNotNull(), F.length("entry"))).alias("best"))
    keyed = best.select(F.col("page_id").alias("_p"), F.col("url").alias("_u"), "best")
    return rows.join(keyed, rows["page_id"].eqNullSafe(keyed["_p"]) & rows["url"].eqNullSafe(keyed["_u"]), "left").select(
        "page_id", "host", "path", F.col("best.shown").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict")
    )


def blocked(urls: DataFrame) -> DataFrame:
    """Entries of a table whose first column lists blocked canonical URLs (host, or host/path); empty lines count for nothing."""
    url = F.trim(F.col(urls.columns[0]))
    host = ascii_lower(F.substring_index(url, "/", 1))
    path = F.substr(url, F.length(F.substring_index(url, "/", 1)) + 1)
    return urls.select(F.concat(host, path).alias("entry"), host.alias("host"), path.alias("path"), F.lit("block").alias("verdict"), F.lit(None).cast("string").alias("shown")).filter(F.col("entry") != "")


def entries(spark: SparkSession, rules: list[tuple[str, str, str]], blocked: list[str]) -> DataFrame:
    """The list of rules (verdict, host, path) and of blocked canonical URLs; a rule comes before a blocked URL."""
    rows = [(h + p, h, p, v, h + p) for v, h, p in rules]
    rows += [(u, u.partition("/")[0], u[len(u.partition("/")[0]) :], "block", None) for u in blocked if u not in {r[0] for r in rows}]
    return spark.createDataFrame(rows, "entry string, host string, path string, verdict string, shown string")
