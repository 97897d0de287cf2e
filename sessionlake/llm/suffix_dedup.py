"""Removal of repeated byte strings with suffix arrays.

A window is a string of `length` bytes within one document.  A byte goes if a
window that covers it also starts anywhere else.

1. Routing.  Each window belongs to its minimizer: the least hash among its
   k-byte strings (the rightmost of equals).  Equal windows have equal
   minimizers at the same place, so the windows of one minimizer hash can be
   judged by themselves.  Successive windows with the same minimizer make one
   span; a span has a 128-bit digest of its bytes.
2. Spans whose minimizer hash is found once hold no repeat.  Spans with equal
   bytes are repeats as a whole.  Where a minimizer hash has spans with several
   digests, one span of each digest goes to a shard.
3. Each shard gets a suffix array by Larsson-Sadakane refinement and common
   prefixes by Kasai's bound, both in numpy; neighbours with a common prefix of
   `length` bytes or more are repeats.
4. A minimizer with more spans than MOST_IN_SHARD is dealt out over several
   shards.  Each of them sends the classes of its windows (runs of its suffix
   array) in sorted order; the merge finds by binary search in the other
   shards' runs which classes several shards have.
5. Each document puts its repeated windows together and loses their bytes.

Defined results: null and empty texts have no bytes; a text shorter than
`length` loses nothing; repeated rows are copies of each other, so their
windows are all repeats; rows are told apart by doc_id and a hash of the text;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUES, discard, mix, partitions, powers, store, text_buffers

K = 64  # bytes of a minimizer
#: Bytes that are hashed at a time: few enough for a core's cache.
BLOCK = 1 << 16
#: Spans with different bytes that a minimizer may have in one shard; further ones go to further shards.
MOST_IN_SHARD = 2048
#: Bytes of spans for which one suffix array is made: its tables stay in a core's cache.
SHARD_BYTES = 1 << 18
_LEAST = -(2**63)

SPANS = "h long, doc_id long, text_hash long, start long, end long, stop long, n int, d1 long, d2 long"


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w successive values."""
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if w > span else x


def spans_of(buf: np.ndarray, bounds: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer hash, document, first window, last window) of each span in a buffer of documents; places are those in the buffer."""
    n = len(buf)
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    power, back = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUES[buf] * power[:n], out=sums[1:])
    grams = mix((sums[k:] - sums[:-k]) * back[: n - k + 1])
    place = np.uint64(0xFFFFFFFF) - np.arange(len(grams), dtype=np.uint64)
    least = sliding_min((grams & np.uint64(0xFFFFFFFF00000000)) | place, length - k + 1)
    at = (np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)
    starts = np.arange(len(at))
    doc = np.searchsorted(bounds, starts, "right") - 1
    inside = starts + length <= bounds[doc + 1]
    new = inside.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~inside[:-1] | (doc[1:] != doc[:-1])
    first = np.nonzero(new)[0]
    # a span ends before the next one begins, or where windows stop fitting into the document
    stop = np.nonzero(inside & ~np.concatenate([inside[1:] & ~new[1:], [False]]))[0]
    return grams[at[first]].view(np.int64), doc[first], first, stop


_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0][0]) < n:
        _POWERS[:] = [powers(max(n, 2 * BLOCK))]
    return _POWERS[0]


def _pieces(offsets: np.ndarray, length: int, block: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (document, from, to) of about `block` bytes; a long document comes in pieces that overlap by length - 1."""
    now, size = [], 0
    for i in range(len(offsets) - 1):
        n = int(offsets[i + 1] - offsets[i])
        for a in range(0, max(n - length + 1, 0), block):
            b = min(n, a + block + length - 1)
            if size + b - a > 2 * block and now:
                yield now
                now, size = [], 0
            now.append((i, a, b))
            size += b - a
    if now:
        yield now


def spans(docs: DataFrame, length: int, block: int = BLOCK) -> DataFrame:
    """SPANS of every document: windows start .. end, with the digest of the bytes from start to end + length.

    Periodic text makes the same span again and again; successive spans with
    equal bytes are one row, n of them, whose windows go on to stop.
    """
    k = min(K, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            ids, text_hash = np.asarray(batch.column("doc_id")), np.asarray(batch.column("text_hash"))
            for parts in _pieces(offsets, length, block):
                buf = np.concatenate([data[offsets[i] + a : offsets[i] + b] for i, a, b in parts])
                bounds = np.concatenate([[0], np.cumsum([b - a for _, a, b in parts])])
                h, part, first, last = spans_of(buf, bounds, length, k)
                view, digest = memoryview(buf), xxhash.xxh3_128_digest
                both = np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(first.tolist(), (last + length).tolist())]), np.int64).reshape(-1, 2)
                doc = np.asarray([i for i, _, _ in parts])[part]
                shift = np.asarray([a for _, a, _ in parts])[part] - bounds[part]
                if not len(h):
                    continue
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (both[1:] != both[:-1]).any(1) | (part[1:] != part[:-1])])
                at = np.nonzero(new)[0]
                n = np.diff(np.concatenate([at, [len(h)]]))
                cols = [h[at], ids[doc[at]], text_hash[doc[at]], (first + shift)[at], (last + shift)[at], (last + shift)[at + n - 1], n.astype(np.int32), both[at, 0], both[at, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=["h", "doc_id", "text_hash", "start", "end", "stop", "n", "d1", "d2"])

    return docs.mapInArrow(run, SPANS)


def _words(text: np.ndarray) -> tuple[np.ndarray, int, int]:
    """The symbols from each place on, as many as 63 bits hold, as an integer that sorts as they do, and a zero for the
    place behind the last; how many symbols that are; bits of a symbol.  Symbols are numbered from 1, what follows the text is 0."""
    number = np.cumsum(np.bincount(text) > 0)
    bits = int(number[-1]).bit_length()
    n, many = len(text), 63 // bits
    t = np.zeros(n + 2 * many, np.int64)
    t[:n] = number[text]
    word, have = t, 1
    while have < many:  # doubled as far as that goes, then what is missing
        more = min(have, many - have)
        word = (word[:-have] << bits * more) | (word[have:] >> bits * (have - more))
        have += more
    return word[: n + 1], many, bits


def suffix_array(text: np.ndarray, left: np.ndarray | None = None, words: tuple[np.ndarray, int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of `text` (integers from 0 to 256) and the rank of each place, by Larsson-Sadakane: groups of
    suffixes that agree on h symbols are split by the ranks h places on, h doubles, and sorted groups are left alone.

    left: for members set apart by a least symbol, how far on the next of these
    is.  They then count as different symbols, in order of place, so that no
    suffix is compared beyond its member.
    """
    n = len(text)
    key, h, bits = words or _words(text)
    key = key[:n]
    if left is not None:
        ended = left < h
        key = key & (-1 << bits * np.arange(h)[::-1])[np.minimum(left, h - 1)]
    order = np.argsort(key, kind="stable")
    key = key[order]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    new = np.concatenate([[True], key[1:] != key[:-1]])
    if left is not None:
        new |= ended[order]
    rank[order] = ends = _group_ends(new)
    bits = (n + 1).bit_length()
    at = np.nonzero(~(new & np.append(new[1:], True)))[0]
    places, ends = order[at], ends[at]
    # a group is a stretch of the array, so sorting by its end, then by the rank h places on, leaves it where it is
    while len(at):
        key = (ends << bits) | (rank.take(places + h, mode="clip") + 1)
        if 3 * bits <= 63:  # the place goes along in the same integer
            key = np.sort((key << bits) | places)
            places, key = key & ((1 << bits) - 1), key >> bits
        else:
            by = np.argsort(key, kind="stable")
            places, key = places[by], key[by]
        order[at] = places
        new = np.concatenate([[True], key[1:] != key[:-1]])
        ends = at[_group_ends(new)]
        rank[places] = ends
        more = np.nonzero(~(new & np.append(new[1:], True)))[0]
        at, places, ends = at[more], places[more], ends[more]
        h *= 2
    return order, rank[:n]


def _group_ends(new: np.ndarray) -> np.ndarray:
    """Place of the last member of each element's group, from marks of the first members."""
    first = np.nonzero(new)[0]
    size = np.diff(np.concatenate([first, [len(new)]]))
    return np.repeat(first + size - 1, size)


def common_prefixes(text: np.ndarray, order: np.ndarray, rank: np.ndarray, most: int | np.ndarray, words: tuple[np.ndarray, int, int] | None = None) -> np.ndarray:
    """For each place of the suffix array: symbols shared with the suffix before it, `most` at most (a number for all, or for each place of the text).

    Kasai: the suffix at i + 1 shares at least one symbol less with its
    predecessor than the suffix at i.  Places are taken at strides 256, 128, ..
    1; each starts from the bound that the place before it (already known)
    gives, and all places of a stride are extended together, a word at a time.
    """
    n = len(text)
    word, many, bits = words or _words(text)
    most = np.broadcast_to(most, n)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = n  # shares nothing: the word there is 0, others are not
    known = np.zeros(n, np.int64)
    stride = 256
    done_any = False
    while stride:
        at = np.arange(0, n, stride) if not done_any else np.arange(stride, n, 2 * stride)
        lcp = np.zeros(len(at), np.int64)
        if done_any:
            lcp = np.maximum(known[at - stride] - stride, 0)
        cap = most[at]
        live = np.nonzero(lcp < cap)[0]
        i = at[live] + lcp[live]
        j = before[at[live]] + lcp[live]
        while len(live):
            unlike = word.take(i, mode="clip") ^ word.take(j, mode="clip")
            same = np.nonzero(unlike == 0)[0]
            # without the bit after the highest one, no rounding reaches the next power of two
            top = np.frexp((unlike & ~(unlike >> 1)).astype(np.float64))[1] - 1
            shared = many - 1 - top // bits
            shared[same] = many
            lcp[live] += shared
            same = same[lcp[live[same]] < cap[live[same]]]
            live, i, j = live[same], i[same] + many, j[same] + many
        known[at] = np.minimum(lcp, cap)
        done_any = True
        stride //= 2
    return known[order]


def window_classes(members: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes of equal windows over the members' bytes: (class, member, start) of every window, classes in suffix order, and the class sizes."""
    sizes = np.asarray([len(m) for m in members])
    # members are set apart by a symbol below all bytes
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    text = np.zeros(int((sizes + 1).sum()), np.int16)
    left = np.repeat(starts + sizes, sizes + 1) - np.arange(len(text))
    text[left > 0] = np.frombuffer(b"".join(members), np.uint8).astype(np.int16) + 1
    words = _words(text)
    order, rank = suffix_array(text, left, words)
    # prefixes are wanted of windows alone, and no window shares `length` symbols with what is none
    fits = left >= length
    shared = common_prefixes(text, order, rank, np.where(fits, length, 0), words)
    mine = fits[order]
    at = order[mine]
    cls = np.cumsum(shared[mine] < length)
    cls -= cls[:1]
    owner = np.searchsorted(starts, at, "right") - 1
    return cls, owner, at - starts[owner], np.bincount(cls)


def _runs(member: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member, first, last) of runs of successive starts."""
    by = np.lexsort((start, member))
    member, start = member[by], start[by]
    new = np.concatenate([[True], (member[1:] != member[:-1]) | (start[1:] != start[:-1] + 1)]) if len(member) else np.zeros(0, bool)
    first = np.nonzero(new)[0]
    last = np.concatenate([first[1:], [len(member)]]) - 1 if len(first) else first
    return member[first], start[first], start[last]


JUDGED = "hot boolean, doc_id long, text_hash long, first long, last long, bucket int, run binary"
#: One window of a run: its digest in two halves, then where it stands.
WINDOW = np.dtype([("w1", "<u8"), ("w2", "<u8"), ("doc_id", "<i8"), ("text_hash", "<i8"), ("start", "<i8")])


def judge_shards(rows: DataFrame, length: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Suffix arrays over rows (h, shard, n_shards, doc_id, text_hash, start, bytes), which come sorted by (h, shard).

    Gives JUDGED: repeated windows as runs of starts (hot false), and of
    minimizers with several shards the classes of windows, as sorted runs of
    WINDOW records, one for each bucket of digests (hot true).
    """
    buckets = partitions(rows.sparkSession)
    names = ["hot", "doc_id", "text_hash", "first", "last", "bucket", "run"]
    types = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(group: list[tuple]) -> pa.RecordBatch:
            members = [g[6] for g in group]
            cls, member, start, size = window_classes(members, length)
            ids, hashes, base = (np.asarray([g[i] for g in group], np.int64) for i in (3, 4, 5))
            again = size[cls] > 1
            m, first, last = _runs(member[again], start[again])
            out = [[False] * len(m), ids[m].tolist(), hashes[m].tolist(), (first + base[m]).tolist(), (last + base[m]).tolist(), [None] * len(m), [None] * len(m)]
            # a window stands for each class: other shards of its minimizer may hold the class too
            heads = np.concatenate([[True], cls[1:] != cls[:-1]]) if len(cls) else np.zeros(0, bool)
            sent = np.nonzero(heads & (np.asarray([g[2] for g in group])[member] > 1))[0]
            if len(sent):
                digests = b"".join(xxhash.xxh3_128_digest(members[i][s : s + length]) for i, s in zip(member[sent].tolist(), start[sent].tolist()))
                windows = np.zeros(len(sent), WINDOW)
                windows["w1"], windows["w2"] = np.frombuffer(digests, "<u8").reshape(-1, 2).T
                windows["doc_id"], windows["text_hash"], windows["start"] = ids[member[sent]], hashes[member[sent]], start[sent] + base[member[sent]]
                windows = windows[np.lexsort((windows["w2"], windows["w1"]))]
                bucket = (windows["w1"] % np.uint64(buckets)).astype(np.int64)
                for b in np.unique(bucket).tolist():
                    for col, v in zip(out, (True, None, None, None, None, b, windows[bucket == b].tobytes())):
                        col.append(v)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

        group, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("h", "shard", "n_shards", "doc_id", "text_hash", "start", "bytes"))):
                # shards are cut only between minimizers (or their parts), so equal windows stay together
                if size > shard_bytes and row[:2] != group[-1][:2]:
                    yield done(group)
                    group, size = [], 0
                group.append(row)
                size += len(row[6])
        if group:
            yield done(group)

    return rows.mapInArrow(run, JUDGED)


def merge_shards(runs: DataFrame) -> DataFrame:
    """doc_id, text_hash, first, last of windows whose class several shards have.

    runs: the hot rows of JUDGED.  A bucket's runs, one from each shard that
    has any, meet in one task; each run is looked up in their union by binary
    search, and what is there more often than in the run itself is a repeat.
    """
    dealt = runs.select("bucket", "run").repartition(partitions(runs.sparkSession), "bucket").sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(blobs: list[bytes]) -> pa.RecordBatch:
            each = [np.frombuffer(b, WINDOW) for b in blobs]
            union = np.concatenate(each)
            union = union[np.lexsort((union["w2"], union["w1"]))]
            places = np.cumsum(np.concatenate([[False], (union["w1"][1:] != union["w1"][:-1]) | (union["w2"][1:] != union["w2"][:-1])]))
            found = []
            for r in each:
                left = np.searchsorted(union["w1"], r["w1"], "left")
                # windows with equal first halves are next to each other; the second half decides within them
                while len(far := np.nonzero(union["w2"][left] != r["w2"])[0]):
                    left[far] += 1
                n = np.searchsorted(places, places[left], "right") - np.searchsorted(places, places[left], "left")
                found.append(r[n > 1])
            got = np.concatenate(found)
            docs = np.unique(got[["doc_id", "text_hash"]], return_inverse=True)
            which, first, last = _runs(docs[1].reshape(-1), got["start"]) if len(got) else (np.zeros(0, int),) * 3
            cols = (docs[0]["doc_id"][which], docs[0]["text_hash"][which], first, last)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).astype(np.int64)) for c in cols], names=["doc_id", "text_hash", "first", "last"])

        now, blobs = None, []
        for batch in batches:
            for b, blob in zip(batch.column("bucket").to_pylist(), batch.column("run").to_pylist()):
                if b != now and blobs:
                    yield done(blobs)
                    blobs = []
                now = b
                blobs.append(blob)
        if blobs:
            yield done(blobs)

    return dealt.mapInArrow(run, "doc_id long, text_hash long, first long, last long")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))


def repeated_windows(docs: DataFrame, length: int = 400, most_in_shard: int = MOST_IN_SHARD, shard_bytes: int = SHARD_BYTES, block: int = BLOCK) -> DataFrame:
    """doc_id, text_hash, first, last: runs of starts of windows that are found elsewhere too; docs as _keyed gives them."""
    spark = docs.sparkSession
    found = store(spans(docs, length, block), "spans")
    # written down, so that both sides of the join are dealt out for it alone and a hot minimizer's partition can be split
    twice = store(found.groupBy("h").agg(F.sum("n").alias("spans")).filter(F.col("spans") > 1).select("h"), "shared-minimizers")
    all_spans = store(found.join(twice, "h", "left_semi"), "shared-spans")
    discard(spark, found._scratch_path)
    where = F.struct("doc_id", "text_hash", "start", "end")
    classes = store(all_spans.groupBy("h", "d1", "d2").agg(F.sum("n").alias("n"), F.min(where).alias("at")).select("h", "d1", "d2", "n", "at.*"), "span-classes")
    by_h = store(classes.groupBy("h").agg(F.count("*").alias("kinds")).filter(F.col("kinds") > 1), "mixed-minimizers")
    # equal spans: every window is a repeat
    copied = classes.filter(F.col("n") > 1).select("h", "d1", "d2")
    whole = all_spans.join(copied, ["h", "d1", "d2"], "left_semi").select("doc_id", "text_hash", F.col("start").alias("first"), F.col("stop").alias("last"))
    # minimizers with several kinds of span: one span of each kind to a suffix array
    mixed = classes.join(by_h, "h").withColumn("n_shards", F.ceil(F.col("kinds") / most_in_shard).cast("int"))
    wanted = mixed.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("h", "start", "end", "n_shards", F.pmod("d2", F.col("n_shards")).cast("int").alias("shard"))).alias("wanted"))
    cut = docs.join(wanted, ["doc_id", "text_hash"]).select("doc_id", "text_hash", F.encode("text", "utf-8").alias("bytes"), F.explode("wanted").alias("w"))
    rows = cut.select("w.h", "w.shard", "w.n_shards", "doc_id", "text_hash", "w.start", F.substring("bytes", (F.col("w.start") + 1).cast("int"), (F.col("w.end") - F.col("w.start") + length).cast("int")).alias("bytes"))
    rows = rows.repartition(partitions(spark), "h", "shard").sortWithinPartitions("h", "shard")
    judged = store(judge_shards(rows, length, shard_bytes), "shard-windows")
    out = whole.unionByName(judged.filter("not hot").select("doc_id", "text_hash", "first", "last"))
    return out.unionByName(merge_shards(judged.filter("hot")))


def remove_repeats(docs: DataFrame, length: int = 400, **sizes: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes), text of every row of docs (doc_id, text).

    text: the remaining bytes as a string; a character that is cut becomes U+FFFD.
    """
    keyed = _keyed(docs)
    runs = repeated_windows(keyed, length, **sizes).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("runs"))
    joined = keyed.join(runs, ["doc_id", "text_hash"], "left").select("doc_id", "text", F.col("runs.first").alias("first"), F.col("runs.last").alias("last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for text, first, last in zip(*(batch.column(n) for n in ("text", "first", "last"))):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                kept, removed, n = data, 0, 0
                if first.is_valid:
                    a, b = np.asarray(first.values), np.asarray(last.values) + length
                    far = np.maximum.accumulate(b)
                    new = np.concatenate([[True], a[1:] > far[:-1]])
                    begin = a[new]
                    end = far[np.concatenate([np.nonzero(new)[0][1:] - 1, [len(a) - 1]])]
                    n, removed = len(begin), int((end - begin).sum())
                    kept = b"".join(data[x:y] for x, y in zip([0, *end.tolist()], [*begin.tolist(), len(data)]))
                for col, v in zip(out, (len(data), removed, n, hashlib.sha256(kept).hexdigest(), kept, kept.decode("utf-8", "replace"))):
                    col.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string())))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "text"],
            )

    got = joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, text string")
    return got.withColumn("doc_id", F.nullif("doc_id", F.lit(_LEAST)))
