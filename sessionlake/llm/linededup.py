"""Line deduplication over levelled, sorted runs of line hashes, in DataFrame operations only.

A run is a Parquet folder of rows (h1, h2, n_docs, top): a line's 128-bit hash,
the number of documents that hold it and the largest doc_id among them, hash
partitioned and sorted by hash.  Each batch of documents merge-anti-joins the
runs: hashes that no run has become a run at level 0, so a hash is in one run
only; `fanout` runs of a level are merged into one of the next.  Hashes that a
run has already are put down beside the runs, with the batch's counts; only
these, and those with enough documents in one batch, can be repeated lines, so
the totals are made for them alone.

Two ways to use the runs:
- `LineRuns.admit(lines)`: lines of a new batch that no run knows;
- `dedup(docs)`: all batches are added first; a line whose key is repeated then
  goes from every document but the one with the largest doc_id.

A key is the line without ASCII white space at its ends and with A-Z in lower
case.  Lines end at \\n.

Defined results: null or empty text is one empty line; rows with the same
doc_id count as one document; a null doc_id comes below all others; a line that
a document repeats is dropped or kept as a whole; an empty table gives no rows;
further columns come back as they were, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, ascii_lower, discard, filesystem, scratch, store

_LEAST = -(2**63)
#: Repeated keys that are broadcast (40 bytes each): the hottest, at most so many; the others have few documents each and are joined by a shuffle.
MOST_BROADCAST_KEYS = 200_000
RUN = "h1 long, h2 long, n_docs long, top long"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def key_hashes(key: Column) -> list[Column]:
    """A 128-bit hash in two halves; the second starts from another state."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, text_hash, pos, h1, h2 of each line whose key has min_chars code points or more."""
    lines = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("doc_id"),
        F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
        F.posexplode(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1)).alias("pos", "line"),
    )
    keyed = lines.filter(F.char_length("line") >= min_chars).withColumn("key", line_key(F.col("line"))).filter(F.char_length("key") >= min_chars)
    return keyed.select("doc_id", "text_hash", "pos", *key_hashes(F.col("key")))


@dataclass
class LineRuns:
    """The runs below one folder; levels[i] lists the runs of level i, again the tables of hashes that later batches had again."""

    spark: SparkSession
    path: str
    fanout: int = 4
    levels: list[list[str]] = field(default_factory=list)
    again: list[str] = field(default_factory=list)
    made: int = 0

    def add(self, lines: DataFrame) -> None:
        """Add a batch (doc_id, h1, h2; documents that no earlier batch had): its new hashes as a run, then compact full levels."""
        counted = lines.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("top"))
        if not any(self.levels):
            self._put(0, counted)
            return
        # one merge join: its misses, the anti-join, are the new run, and its hits go beside the runs
        batch = f"{self.path}/batch-{self.made}"
        self.made += 1
        known = self.runs().select("h1", "h2", F.lit(True).alias("known"))
        told = counted.join(known, ["h1", "h2"], "left").withColumn("known", F.col("known").isNotNull())
        told.sortWithinPartitions("known", "h1", "h2").write.partitionBy("known").parquet(batch)
        fs, at = filesystem(self.spark, batch)
        parts = {s.getPath().getName() for s in fs.listStatus(at)}
        if "known=true" in parts:
            self.again.append(f"{batch}/known=true")
        if "known=false" in parts:
            self.levels[0].append(f"{batch}/known=false")
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            # a hash is in one of the runs only, so merging them is putting them in order
            merged = self.spark.read.schema(RUN).parquet(*old)
            self._put(level + 1, merged.repartition("h1", "h2"))
            self.levels[level] = []
            for run in old:
                discard(self.spark, run)
            level += 1

    def _put(self, level: int, rows: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        run = f"{self.path}/level-{level}/run-{self.made}"
        self.made += 1
        rows.select("h1", "h2", "n_docs", "top").sortWithinPartitions("h1", "h2").write.parquet(run)
        self.levels[level].append(run)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(*paths) if paths else self.spark.createDataFrame([], RUN)

    def runs(self) -> DataFrame:
        """All hashes, each once, as its first batch had it."""
        return self._read([run for level in self.levels for run in level])

    def repeated(self, min_docs: int) -> DataFrame:
        """h1, h2, n_docs, top over all batches of the hashes that min_docs documents hold (min_docs above 1)."""
        later = self._read(self.again).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("top").alias("top"))
        later = store(later, "later-lines").withColumnsRenamed({"n_docs": "more", "top": "later"})
        total = self.runs().join(later, ["h1", "h2"], "left").select("h1", "h2", (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("top", "later").alias("top"))
        return total.filter(F.col("n_docs") >= min_docs)

    def admit(self, lines: DataFrame) -> DataFrame:
        """Rows of `lines` (with h1, h2) whose hash no run has; then their batch's hashes become a run."""
        fresh = store(lines.join(self.runs().select("h1", "h2"), ["h1", "h2"], "left_anti"), "fresh-lines")
        self.add(fresh)
        return fresh


def repeated_positions(docs: DataFrame, min_chars: int, min_docs: int, batches: int, most_broadcast: int = MOST_BROADCAST_KEYS) -> DataFrame:
    """doc_id, text_hash, gone: the places of the lines that each document loses."""
    spark = docs.sparkSession
    path = scratch(spark, "line-keys")
    lines_of(docs, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("doc_id long, text_hash long, pos int, h1 long, h2 long, batch int").parquet(path)
    runs = LineRuns(spark, scratch(spark, "line-runs"))
    for b in range(batches):
        runs.add(lines.filter(F.col("batch") == b))
    repeated = store(runs.repeated(min_docs), "repeated-lines")
    total = repeated.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n")).first()["n"]
    # keys that so many documents hold are most_broadcast at most, as all keys together have `total` of them
    hot = max(min_docs, -(-total // max(1, most_broadcast)))
    some = repeated.filter(F.col("n_docs") >= hot).select("h1", "h2", "top")
    if hot == min_docs:
        lost = lines.join(F.broadcast(some), ["h1", "h2"]).filter(F.col("doc_id") < F.col("top"))
    else:
        told = lines.join(F.broadcast(some), ["h1", "h2"], "left")
        rest = repeated.filter(F.col("n_docs") < hot).select("h1", "h2", F.col("top").alias("other"))
        # hot lines stay out of the shuffle
        cold = told.filter(F.col("top").isNull()).join(rest, ["h1", "h2"]).filter(F.col("doc_id") < F.col("other"))
        lost = told.filter(F.col("doc_id") < F.col("top")).select("doc_id", "text_hash", "pos").unionByName(cold.select("doc_id", "text_hash", "pos"))
    return store(lost.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("gone")), "lost-lines")


def _left(docs: DataFrame, **options) -> DataFrame:
    """row (all columns of docs), text (what is left of it), n_lines, n_dropped."""
    gone = repeated_positions(docs, **options)
    # as one column the rows keep clear of the names used here
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    text = F.coalesce(F.col("text"), F.lit(""))
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    # as a lambda's argument the split text is made once for each document
    left = F.transform(F.array(F.split(text, "\n", -1)), lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone"), lambda i: F.get(lines, i)), "\n"))
    joined = rows.join(gone, ["doc_id", "text_hash"], "left")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(left[0])
    return joined.select("row", kept.alias("text"), n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 5, **options) -> DataFrame:
    """Rows and columns of docs, with the text that is left."""
    out = _left(docs, min_chars=min_chars, min_docs=min_docs, batches=batches, **options)
    return out.select(F.col("row").withField("text", F.col("text")).alias("row")).select("row.*")


def report(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 5, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    out = _left(docs.select("doc_id", "text"), min_chars=min_chars, min_docs=min_docs, batches=batches, **options)
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
