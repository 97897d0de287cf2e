"""SimHash near-duplicates with pivot distance tables.

A document's words (A-Z lower-cased, split at ASCII white space) give shingles
of `words` words, repeats included; a fingerprint bit is 1 if it is set in over
half of the shingles' hashes.  With `planes` above 1 a fingerprint has 64 bits
for each plane, the further planes from a mix of the same hash.

Documents with the same fingerprint are one node.  Nodes meet in buckets:
- `block_keys`, for a small radius r on 64 bits: the bits are cut into B blocks
  and every choice of B - r blocks is a key; two fingerprints at distance r or
  less agree on one of the choices, so no link is missed;
- `sampled_keys`, for a similarity threshold on long fingerprints: keys of b
  bits drawn from the fingerprint, as many as give a pair at the threshold a
  common bucket with the stated probability; b follows the number of nodes.
In a bucket each node has a row in a table of its distances to reference
fingerprints (pivots).  A pair whose rows differ by more than the radius in any
coordinate is discarded, which the triangle inequality allows: the first two
pivots order the nodes, so that partners are looked up within the radius and
other pairs are not formed, and the other pivots discard what is left but for
few; the Hamming distance of these is verified.  Links leave a task as a
spanning forest.
Buckets above MOST_IN_TASK nodes are dealt out as blocks of a grid, so that no
pair is left out and no task gets a whole hot bucket.

Where documents are linked by the similarity of their sets of shingles
(keep_one), a node is one set, and fingerprints, of sets then, only save work.
Searches whose candidate rows are more than a few times the prefixes of the sets
take several passes, over a share of the keys each, so that what is shuffled at a
time stays in proportion to the documents.
First the forests of shortest fingerprint links are checked on the sets, which
joins most of what belongs together.  Then all pairs of nodes that are not
joined yet are searched without loss (prefix_pairs) and checked as well: two
sets of similarity t share one of the first n - ceil(t n) + 1 shingles of each,
in any order that is the same for all; rare shingles come first.

Defined results: null, empty and blank texts have fingerprint zero and are
linked like any other; texts with fewer words than a shingle are one shingle;
repeated rows and equal ids are reported row by row, a null doc_id counts as
the least id; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, discard, made, mix, no_shuffle_left, partitions, release, store
from .components import components

SEED = 42
_LEAST = -(2**63)
_TO_LOWER = bytes.maketrans(ASCII_UPPER.encode(), ASCII_LOWER.encode())
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
#: Reference fingerprints of the pivot table, for each plane; any values far from each other do.
N_PIVOTS = 16
#: Nodes of a bucket that one task compares; a larger bucket is dealt out in a grid of such blocks.
MOST_IN_TASK = 4096
#: A table of up to so many hot buckets (16 bytes each) is broadcast; a longer one is shuffled.
MOST_BROADCAST_BUCKETS = 200_000
#: The same for the nodes that near pairs name (24 bytes each).
MOST_BROADCAST_NODES = 500_000
#: Documents that tell which shingles are frequent, and most of such shingles that are told apart; only the work depends on them.
FREQUENCY_SAMPLE, MOST_FREQUENT = 32_768, 100_000
#: Bytes that a search of keep_one shuffles at a time: so many times those of all prefixes, and at least so many; what is more takes several passes.
PASS_SHARE, PASS_BYTES = 2, 1 << 26
#: Bytes of a shuffled row besides its columns, where nothing can be compressed.
_ROW_BYTES = 12
_STEP = 1024


def shingle_hashes(text: str | None, words: int) -> list[int]:
    parts = (text or "").encode("utf-8", "surrogatepass").translate(_TO_LOWER).split()
    if not parts:
        return []
    joined = b" ".join(parts)
    if len(parts) < words:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    at = [0, *itertools.accumulate(len(p) + 1 for p in parts)]
    h = xxhash.xxh64_intdigest
    return [h(joined[a : b - 1], SEED) for a, b in zip(at, at[words:])]


def fingerprints_of(texts: list[str | None], words: int, planes: int) -> np.ndarray:
    """(n, planes) unsigned fingerprints."""
    return _fingerprints([shingle_hashes(t, words) for t in texts], planes)


def _fingerprints(hashes: list, planes: int) -> np.ndarray:
    n = np.asarray([len(h) for h in hashes])
    doc = np.repeat(np.arange(len(hashes)), n)
    h = np.fromiter(itertools.chain.from_iterable(hashes), np.uint64, int(n.sum()))
    out = np.zeros((len(hashes), planes), np.uint64)
    for p in range(planes):
        lanes = (h if p == 0 else mix(h + np.uint64(p * 0x9E3779B97F4A7C15 % 2**64))).view(np.uint8).reshape(-1, 8)
        ones = np.stack([np.bincount(doc * 256 + lanes[:, k], minlength=256 * len(hashes)).reshape(-1, 256) @ _BITS for k in range(8)], 1)
        out[:, p] = np.packbits((ones * 2 > n[:, None, None]).reshape(len(hashes), 64), axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def planes_schema(planes: int) -> str:
    return ", ".join(f"f{p} long" for p in range(planes))


def _megabytes(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of about a megabyte of text."""
    start = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0))) // 1_000_000
    return ((i, j) for i, j in itertools.pairwise([0, *(np.nonzero(np.diff(start))[0] + 1), len(texts)]) if i < j)


def fingerprints(docs: DataFrame, words: int, planes: int = 1) -> DataFrame:
    """doc_id, text_hash, f0.. of every document (64 bits each, as signed longs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for i, j in _megabytes(texts):
                got = fingerprints_of(texts.slice(i, j - i).to_pylist(), words, planes).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("doc_id", "text_hash")), *(pa.array(got[:, p]) for p in range(planes))], names=["doc_id", "text_hash", *(f"f{p}" for p in range(planes))])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(run, f"doc_id long, text_hash long, {planes_schema(planes)}")


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(np.asarray(shingle_hashes(text, words), np.uint64))


def frequent_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, count of each) that several documents of a sample have."""
    share = max(1, math.ceil(docs.count() / FREQUENCY_SAMPLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = np.concatenate([shingle_set(t.as_py(), words) for t in batch.column("text")])
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], names=["shingle"])

    sample = docs.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(share)) == 0).select(F.col("text").cast("string").alias("text"))
    with no_shuffle_left(docs.sparkSession):
        top = sample.mapInArrow(run, "shingle long").groupBy("shingle").count().filter("count > 2").orderBy(F.desc("count"), "shingle").limit(MOST_FREQUENT).collect()  # MOST_FREQUENT rows at most
    grams, counts = np.asarray([r[0] for r in top], np.int64).view(np.uint64), np.asarray([r[1] for r in top], np.int64)
    order = np.argsort(grams)
    return grams[order], counts[order]


def prefix(own: np.ndarray, similarity: float, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set, the rare ones before the frequent: any set with the similarity has one of them among its own first ones."""
    if len(grams):
        at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        own = own[np.argsort(np.where(grams[at] == own, counts[at], 0), kind="stable")]
    return own[: len(own) - math.ceil(similarity * len(own) - 1e-9) + 1]


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """(n, 4): whether an even or odd number of a set's shingles falls on each of 256 bits; two sets differ in as many shingles as bits, or more."""
    doc = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    on = (np.concatenate(sets) & np.uint64(255)).astype(np.int64)
    odd = np.bincount(doc * 256 + on, minlength=256 * len(sets)).reshape(-1, 256) & 1
    return np.packbits(odd.astype(bool), axis=1, bitorder="little").view(np.uint64)


PARITY = ["p0", "p1", "p2", "p3"]


def set_fingerprints(docs: DataFrame, words: int, planes: int, similarity: float) -> DataFrame:
    """doc_id, text_hash, f0.. (of the set of shingles), node (hash of the set), size, prefix, p0.. (parities) of every document."""
    known = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for i, j in _megabytes(texts):
                sets = [shingle_set(t, words) for t in texts.slice(i, j - i).to_pylist()]
                got, odd = _fingerprints(sets, planes).view(np.int64), parities(sets).view(np.int64)
                node = np.asarray([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
                first = pa.array([prefix(x, similarity, *known.value).tobytes() for x in sets], pa.binary())
                cols = {c: batch.column(c).slice(i, j - i) for c in ("doc_id", "text_hash")} | {f"f{p}": pa.array(got[:, p]) for p in range(planes)}
                cols |= {"node": pa.array(node), "size": pa.array([len(x) for x in sets], pa.int64()), "prefix": first} | {c: pa.array(odd[:, k]) for k, c in enumerate(PARITY)}
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(
        run, f"doc_id long, text_hash long, {planes_schema(planes)}, node long, size long, prefix binary, {', '.join(f'{c} long' for c in PARITY)}"
    )


def block_keys(n: int, radius: int):
    """Keys for fingerprints of 64 bits at most `radius` apart: blocks are the fewer, the fewer nodes there are, so that buckets stay small."""
    for blocks in range(radius + 1, 2 * radius + 4):
        kept = blocks - radius
        bounds = [round(64 * i / blocks) for i in range(blocks + 1)]
        if kept * (64 // blocks) >= math.log2(max(2, n)) or blocks == 2 * radius + 3:
            break
    masks = [sum(((1 << bounds[b + 1]) - 1) ^ ((1 << bounds[b]) - 1) for b in choice) for choice in itertools.combinations(range(blocks), kept)]
    mask = np.asarray(masks, np.uint64)

    def keys(fp: np.ndarray) -> np.ndarray:
        return mix((fp[:, :1] & mask[None, :]) ^ mix(mask)[None, :])

    return keys


def sampled_keys(n: int, planes: int, agree: float, found: float = 0.97):
    """Keys for long fingerprints whose bits agree with probability `agree` at the threshold."""
    width = max(12, math.ceil(math.log2(max(2, n))))
    count = math.ceil(math.log(1 - found) / math.log(1 - agree**width))
    rng = np.random.default_rng(11)
    mask = np.zeros((count, planes), np.uint64)
    for t in range(count):
        for bit in rng.choice(64 * planes, width, replace=False):
            mask[t, bit // 64] |= np.uint64(1) << np.uint64(bit % 64)

    def keys(fp: np.ndarray) -> np.ndarray:
        out = mix(np.arange(count, dtype=np.uint64) + np.uint64(1))[None, :].repeat(len(fp), 0)
        for p in range(planes):
            out = mix(out ^ (fp[:, p : p + 1] & mask[None, :, p]))
        return out

    return keys


def pivot_table(fp: np.ndarray) -> np.ndarray:
    """(n, N_PIVOTS) distances to the reference fingerprints."""
    refs = mix(np.arange(1, N_PIVOTS * fp.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(N_PIVOTS, -1)
    return np.stack([np.bitwise_count(fp ^ r).sum(1, dtype=np.int16) for r in refs], 1)


def _verified(fp: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j) those that no pivot discards and whose Hamming distance is at most radius."""
    for c in range(table.shape[1]):
        near = np.abs(table[i, c] - table[j, c]) <= radius
        i, j = i[near], j[near]
    near = np.bitwise_count(fp[i] ^ fp[j]).sum(1, dtype=np.int16) <= radius
    return i[near], j[near]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that it reaches over the links (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _pairs_within(sizes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of each run, by distance within the run, for runs up to _STEP long."""
    for d in range(1, int(sizes.max(initial=1))):
        long = sizes > d
        n, s = sizes[long] - d, starts[long]
        first = np.repeat(s - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        yield first, first + d


def pivot_windows(groups: np.ndarray, table: np.ndarray, radius: int, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the same (sorted) group whose distances to the first two pivots differ by radius or less, about `most` at a time.

    Rows lie in order of (group, first distance, second distance), so the
    partners of a row are found by binary search, in one window for each first
    distance; pairs outside of the windows are never formed.
    """
    width = int(table.max(initial=0)) + 2 * radius + 2
    group = np.cumsum(np.concatenate([[0], groups[1:] != groups[:-1]])) if len(groups) else np.zeros(0, int)
    first = group * width + table[:, 0]
    place = first * width + table[:, 1] + radius
    order = np.argsort(place, kind="stable")
    first, second, place = first[order], table[order, 1].astype(np.int64), place[order]
    for d in range(radius + 1):
        start = np.searchsorted(place, (first + d) * width + second, "left") if d else np.arange(1, len(place) + 1)
        n = np.maximum(np.searchsorted(place, (first + d) * width + second + 2 * radius, "right") - start, 0)
        total = np.cumsum(n)
        x = 0
        while x < len(n) and total[-1] > (total[x - 1] if x else 0):
            y = max(x + 1, int(np.searchsorted(total, (total[x - 1] if x else 0) + most, "right")))
            i = np.repeat(np.arange(x, y), n[x:y])
            j = np.repeat(start[x:y] - total[x:y] + n[x:y], n[x:y]) + np.arange(total[x] - n[x], total[y - 1])
            yield order[i], order[j]
            x = y


def compare(groups: np.ndarray, fp: np.ndarray, side: np.ndarray, radius: int) -> np.ndarray:
    """Least reachable row of each row, linking rows of the same (sorted) group within the radius.

    side: 0 where all pairs of a group are compared; rows of side 1 and 2 are
    compared across only (two blocks of a grid).
    """
    table, label = pivot_table(fp), np.arange(len(groups))
    for i, j in pivot_windows(groups, table, radius):
        ok = (side[i] == 0) | (side[i] != side[j])
        i, j = _verified(fp, table, i[ok], j[ok], radius)
        label = forest(len(groups), label[i], label[j])[label]  # links between the trees so far
    return label


def _spanning(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) at distance d make a minimum spanning forest of n rows (Kruskal)."""
    parent = list(range(n))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for k in np.lexsort((j, i, d)).tolist():
        x, y = top(int(i[k])), top(int(j[k]))
        if x != y:
            parent[y] = x
            kept.append(k)
    return np.asarray(kept, int)


def near_pairs(groups: np.ndarray, fp: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of the same (sorted) group within the radius: a minimum spanning forest of each group.

    Rows that are linked at some distance are also joined by the forest's links
    up to that distance, and the number of links grows with the rows, not the
    pairs.  A test of something else than the distance may fail a link of the
    forest and pass one that was left out: such pairs are for prefix_pairs.
    """
    n = len(groups)
    starts = np.concatenate([[0], np.nonzero(np.diff(groups))[0] + 1])
    sizes = np.diff(np.concatenate([starts, [n]]))
    table = pivot_table(fp)
    a, b = [np.zeros(0, int)], [np.zeros(0, int)]
    small = sizes <= 64
    for i, j in _pairs_within(sizes[small], starts[small]):
        ok = (side[i] == 0) | (side[i] != side[j])
        i, j = _verified(fp, table, i[ok], j[ok], radius)
        a.append(i)
        b.append(j)
    a, b = np.concatenate(a), np.concatenate(b)
    kept = _spanning(n, a, b, np.bitwise_count(fp[a] ^ fp[b]).sum(1, dtype=np.int16))
    a, b = [a[kept]], [b[kept]]
    for s, m in zip(starts[~small], sizes[~small]):
        own, label = np.arange(s, s + m), np.arange(m)
        while True:  # each tree's shortest link to another tree, until there is none (Boruvka)
            near = [_nearest_elsewhere(fp[own], table[own], side[own], label, x, radius) for x in range(0, m, 256)]
            i, j, d = (np.concatenate(c) for c in zip(*near))
            if not len(i):
                break
            order = np.lexsort((j, i, d))
            i, j, d = i[order], j[order], d[order]
            _, first = np.unique(label[i], return_index=True)
            i, j, d = i[first], j[first], d[first]
            kept = _spanning(m, label[i], label[j], d)
            a.append(own[i[kept]])
            b.append(own[j[kept]])
            label = forest(m, label[i], label[j])[label]
    return np.concatenate(a), np.concatenate(b)


def _nearest_elsewhere(fp: np.ndarray, table: np.ndarray, side: np.ndarray, label: np.ndarray, x: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of 256 rows from x on those with a row of another tree within the radius: (row, the nearest such row, distance)."""
    mine = np.arange(x, min(x + 256, len(fp)))
    least, at = np.full(len(mine), radius + 1, np.int16), np.zeros(len(mine), int)
    for y in range(0, len(fp), _STEP):
        theirs = slice(y, y + _STEP)
        out = label[mine][:, None] == label[theirs][None, :]
        out |= (side[mine][:, None] == side[theirs][None, :]) & (side[mine] != 0)[:, None]
        out |= np.abs(table[mine, 0][:, None] - table[theirs, 0][None, :]) > radius  # discarded by the first pivot
        far = np.bitwise_count(fp[mine][:, None, :] ^ fp[theirs][None, :, :]).sum(2, dtype=np.int16)
        far[out] = radius + 1
        k = far.argmin(1)
        d = far[np.arange(len(mine)), k]
        at, least = np.where(d < least, y + k, at), np.minimum(d, least)
    near = least <= radius
    return mine[near], at[near], least[near]


def passes(weight: int, most: int | None) -> int:
    """Passes in which `weight` bytes are shuffled so that each has about `most` (None: no limit)."""
    return max(1, math.ceil(weight / most)) if most else 1


def in_passes(name: str, found: Iterator[DataFrame]) -> DataFrame:
    """What all passes find, each once; a pass is written down, and its shuffle files are gone, before the next one."""
    parts = [store(x, name) for x in found]
    return parts[0] if len(parts) == 1 else store(functools.reduce(DataFrame.unionByName, parts).distinct(), name)


def links(nodes: DataFrame, planes: int, keys, radius: int, pairs: bool = False, hot: DataFrame | None = None, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """u, v: links between the nodes (node, f0..) within the radius that share a key.

    A spanning forest of them from each task, which joins exactly what they
    join; or with `pairs` a minimum spanning forest (see near_pairs), u below v.
    hot: hot_buckets of the nodes, if they are known.  part: (i, n), the i-th
    of n passes, which have a share of the keys each.
    """
    names = [f"f{p}" for p in range(planes)]
    spread = _spread_links(names, keys, part)
    placed = _in_buckets(nodes.select("node", *names), spread, {n: "long" for n in ("node", *names)}, hot)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_buckets(batches):
            node = np.asarray(rows["node"])
            fp = np.stack([np.asarray(rows[n]).view(np.uint64) for n in names], 1)
            if pairs:
                i, j = near_pairs(np.asarray(rows["bucket"]), fp, np.asarray(rows["side"]), radius)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], names=["u", "v"])
                continue
            label = compare(np.asarray(rows["bucket"]), fp, np.asarray(rows["side"]), radius)
            linked = label != np.arange(len(label))
            yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[label[linked]])], names=["u", "v"])

    return placed.mapInArrow(join, "u long, v long").distinct()


def _spread_links(names: list[str], keys, part: tuple[int, int]):
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                rows = batch.slice(at, 2000)
                fp = np.stack([np.asarray(rows.column(n)).view(np.uint64) for n in names], 1)
                k = np.ascontiguousarray(keys(fp)[:, part[0] :: part[1]])
                again = pa.array(np.repeat(np.arange(len(fp)), k.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64).ravel()), *(rows.column(n).take(again) for n in ("node", *names))], names=["key", "node", *names])

    return spread


def _schema(columns: dict[str, str]) -> str:
    return "key long, " + ", ".join(f"{c} {t}" for c, t in columns.items())


def hot_buckets(nodes: DataFrame, spread, columns: dict[str, str]) -> DataFrame:
    """hot, g: the keys of more than MOST_IN_TASK nodes, and the sides of their grids."""
    # which buckets are hot is judged by every 16th node; a bucket judged wrongly only makes its task longer or shorter
    seen = nodes.filter(F.pmod(F.xxhash64("node"), F.lit(16)) == 0).mapInArrow(spread, _schema(columns))
    return store(seen.groupBy("key").count().filter(F.col("count") * 16 > MOST_IN_TASK).select(F.col("key").alias("hot"), F.ceil(F.col("count") * 16 / MOST_IN_TASK).alias("g")), "hot-buckets")


def _in_buckets(nodes: DataFrame, spread, columns: dict[str, str], hot: DataFrame | None = None) -> DataFrame:
    """bucket, side and the columns: the rows (key, columns) that spread makes of nodes, in order of buckets; hot keys are dealt out in a grid."""
    keyed = nodes.mapInArrow(spread, _schema(columns))
    hot = hot_buckets(nodes, spread, columns) if hot is None else hot
    dealt = keyed.join(F.broadcast(hot) if hot.count() <= MOST_BROADCAST_BUCKETS else hot, F.col("key") == F.col("hot"), "left")
    own = F.pmod(F.xxhash64("node"), F.col("g")).cast("int")
    cells = F.when(F.col("g").isNull(), F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("side")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("g").cast("int") - 1), lambda j: F.struct(F.least(own, j).alias("x"), F.greatest(own, j).alias("y"), F.when(j == own, 0).when(own < j, 1).otherwise(2).alias("side")))
    )
    placed = dealt.withColumn("cell", F.explode(cells)).select(F.xxhash64("key", "cell.x", "cell.y").alias("bucket"), F.col("cell.side").alias("side"), *columns)
    # a bucket of one node has no pairs; its row is dropped after the shuffle, in the task
    return placed.repartition(partitions(nodes.sparkSession), "bucket").sortWithinPartitions("bucket", "node")


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of complete buckets, without those that are alone in theirs."""

    def met(rows: pa.Table) -> pa.Table:
        bucket = np.asarray(rows["bucket"])
        same = np.concatenate([[False], bucket[1:] == bucket[:-1]])
        return rows.filter(pa.array(same | np.concatenate([same[1:], [False]])))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        rows = pa.Table.from_batches(held)
        bucket = np.asarray(rows["bucket"])
        last = int(np.nonzero(bucket == bucket[-1])[0][0]) if len(bucket) else 0
        if last:
            yield met(rows.slice(0, last))
            held = rows.slice(last).to_batches()
    if held:
        rows = pa.Table.from_batches(held)
        if rows.num_rows:
            yield met(rows)


def _all_pairs(groups: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of the same (sorted) group that are to be compared (see compare), a bounded number at a time."""
    starts = np.concatenate([[0], np.nonzero(np.diff(groups))[0] + 1])
    sizes = np.diff(np.concatenate([starts, [len(groups)]]))
    small = sizes <= 64
    for i, j in _pairs_within(sizes[small], starts[small]):
        ok = (side[i] == 0) | (side[i] != side[j])
        yield i[ok], j[ok]
    for s, m in zip(starts[~small], sizes[~small]):
        for x, y in itertools.combinations_with_replacement(range(s, s + m, _STEP), 2):
            left, right = np.arange(x, min(x + _STEP, s + m)), np.arange(y, min(y + _STEP, s + m))
            i, j = np.repeat(left, len(right)), np.tile(right, len(left))
            ok = (i < j) & ((side[i] == 0) | (side[i] != side[j]))
            yield i[ok], j[ok]


_PREFIX_ROW = {c: "long" for c in ("node", "label", "size", "place", *PARITY)}


def _spread_prefixes(part: tuple[int, int] = (0, 1)):
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                keys = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("prefix")]
                n = np.asarray([len(k) for k in keys])
                key, node, place = np.concatenate(keys), np.repeat(np.arange(len(n)), n), np.concatenate([np.arange(k) for k in n])
                mine = key % np.uint64(part[1]) == part[0]
                again = pa.array(node[mine])
                cols = {"key": pa.array(key[mine].view(np.int64)), "place": pa.array(place[mine].astype(np.int64))} | {c: rows.column(c).take(again) for c in _PREFIX_ROW if c != "place"}
                yield pa.RecordBatch.from_arrays([cols[c] for c in ("key", *_PREFIX_ROW)], names=["key", *_PREFIX_ROW])

    return spread


def prefix_pairs(nodes: DataFrame, similarity: float, hot: DataFrame | None = None, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """u, v: pairs of nodes (node, label, size, prefix, p0..) of different labels; no pair with the similarity is missing.

    Pairs that share a shingle of their prefixes are left out only if their
    sizes, the places of that shingle or the parities rule the similarity out.
    hot, part: as in links; all passes together miss no pair.
    """
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_buckets(batches):
            node, label, size, place, side = (np.asarray(rows[c]) for c in ("node", "label", "size", "place", "side"))
            odd = np.stack([np.asarray(rows[c]).view(np.uint64) for c in PARITY], 1)
            for i, j in _all_pairs(np.asarray(rows["bucket"]), side):
                ok = label[i] != label[j]
                i, j = i[ok], j[ok]
                most = np.minimum(size[i] - place[i], size[j] - place[j])  # in common, if this shingle is the first that is
                both = size[i] + size[j]
                ok = (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-6) & (most * (1 + similarity) >= similarity * both - 1e-6)
                i, j, both = i[ok], j[ok], both[ok]
                ok = np.bitwise_count(odd[i] ^ odd[j]).sum(1, dtype=np.int64) * (1 + similarity) <= (1 - similarity) * both + 1e-6
                if ok.any():
                    a, b = node[i[ok]], node[j[ok]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["u", "v"])

    return _in_buckets(nodes.select("node", "label", "size", "prefix", *PARITY), _spread_prefixes(part), _PREFIX_ROW, hot).mapInArrow(join, "u long, v long").distinct()


def similar_links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, similarity: float, most: int | None = None) -> DataFrame:
    """Of the pairs (u, v) those whose documents' sets of shingles have a Jaccard similarity of `similarity` or more.

    nodes: node, size, rep (doc_id and text_hash of a document with the set).
    most: bytes of sets that a pass over pairs has, each set counted with every pair that it is in.
    """
    met = pairs.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("times"))
    reps = store(nodes.join(met, "node").select("node", "size", "times", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash")), "met-nodes")
    n = passes(reps.agg(F.coalesce(F.sum(F.col("size") * F.col("times")) * 8, F.lit(0))).first()[0], most)
    few = reps.count() <= MOST_BROADCAST_NODES

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), words).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("rep_id"), F.xxhash64(F.col("text").cast("string")).alias("rep_hash"), F.col("text").cast("string").alias("text"))
    wanted = reps.select("node", "rep_id", "rep_hash")
    texts = keyed.join(F.broadcast(wanted) if few else wanted, ["rep_id", "rep_hash"]).select("node", "text")
    sets = store(texts.mapInArrow(shingles, "node long, shingles binary").dropDuplicates(["node"]), "shingle-sets")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column("a"), batch.column("b")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(near, pa.bool_()))

    def checked(p: int) -> DataFrame:
        some = pairs.filter(F.pmod(F.xxhash64("u"), F.lit(n)) == p) if n > 1 else pairs
        left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
        right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
        if n > 1:  # the sets that the pass needs
            left = left.filter(F.pmod(F.xxhash64("u"), F.lit(n)) == p)
            right = right.join(some.select("v").distinct(), "v", "left_semi")
        return some.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(judge, "u long, v long")

    return in_passes("similar-links", map(checked, range(n)))


def near_duplicates(docs: DataFrame, words: int, radius: int, planes: int = 1, agree: float | None = None, similarity: float | None = None) -> DataFrame:
    """doc_id, text_hash, f0.., component_id and head (the hash of the component's first text) of every document.

    radius: most differing bits of a link.  agree: None for the exact search on
    64 bits; else the share of bits in which a pair at the threshold agrees.
    similarity: if given, links also need this Jaccard similarity of shingles.
    """
    names = [f"f{p}" for p in range(planes)]
    rep = F.min(F.struct(F.coalesce("doc_id", F.lit(_LEAST)).alias("doc_id"), "text_hash")).alias("rep")
    if similarity is None:
        of = store(fingerprints(docs, words, planes).withColumn("node", F.col("f0") if planes == 1 else F.xxhash64(*names)), "fingerprints")
        more = []
    else:
        of = store(set_fingerprints(docs, words, planes, similarity), "fingerprints")
        more = [F.first(c).alias(c) for c in ("size", "prefix", *PARITY)]
    nodes = store(of.groupBy("node", *names).agg(rep, *more), "fingerprint-nodes")
    if similarity is not None:  # prefixes are kept once, with the nodes
        wide, of = of, store(of.select("doc_id", "text_hash", *names, "node"), "fingerprints")
        discard(docs.sparkSession, wide._scratch_path)
    n = nodes.count()
    keys = block_keys(n, radius) if agree is None else sampled_keys(n, planes, agree)
    if similarity is None:
        found = links(nodes, planes, keys, radius)
    else:
        since = made()
        prefixes = nodes.agg(F.coalesce(F.sum(F.octet_length("prefix")), F.lit(0))).first()[0]
        most = max(PASS_BYTES, PASS_SHARE * prefixes)
        per_key = n * (8 * (2 + planes) + _ROW_BYTES)
        n_keys = keys(np.zeros((1, planes), np.uint64)).shape[1]
        parts = passes(n_keys * per_key, most)
        columns = {c: "long" for c in ("node", *names)}
        hot = hot_buckets(nodes.select("node", *names), _spread_links(names, keys, (0, 1)), columns)
        near = in_passes("near-pairs", (links(nodes, planes, keys, radius, True, hot, (p, parts)) for p in range(parts)))
        joined = store(components(similar_links(docs, nodes, near, words, similarity, most)), "joined-nodes")
        release(docs.sparkSession, since, keep=(joined._scratch_path,))  # what the search itself had put down
        since = made()
        labelled = nodes.join(joined, "node", "left").withColumn("label", F.coalesce("root", "node"))
        parts = passes(prefixes // 8 * (8 * (1 + len(_PREFIX_ROW)) + _ROW_BYTES), most)
        if parts > 1:  # else the join is made again in each pass
            labelled = store(labelled.select("node", "label", "size", "prefix", *PARITY), "labelled-nodes")
        hot = hot_buckets(labelled.select("node", "label", "size", "prefix", *PARITY), _spread_prefixes(), _PREFIX_ROW)
        near = in_passes("prefix-pairs", (prefix_pairs(labelled, similarity, hot, (p, parts)) for p in range(parts)))
        if parts > 1:
            discard(docs.sparkSession, labelled._scratch_path)
        rest = similar_links(docs, nodes, near, words, similarity, most)
        release(docs.sparkSession, since, keep=(rest._scratch_path,))
        found = joined.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(rest)
    rooted = nodes.join(components(found), "node")
    # written down, so that a giant component, or a text with very many copies, can be split where it is joined
    heads = store(rooted.groupBy("root").agg(F.min("rep").alias("first")), "component-heads")
    joined = rooted.join(heads, "root").select("node", "first")
    named = store(nodes.join(joined, "node", "left").select("node", *names, F.coalesce("first", "rep").alias("first")), "named-nodes")
    return of.join(named, ["node", *names]).select("doc_id", "text_hash", *names, F.nullif("first.doc_id", F.lit(_LEAST)).alias("component_id"), F.col("first.text_hash").alias("head"))


def report(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    got = near_duplicates(docs, words, radius)
    return got.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def bits_at(similarity: float) -> float:
    """Share of bits in which two documents with this Jaccard similarity of shingles differ: the angle between their shingle vectors over pi."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, planes: int = 4) -> DataFrame:
    """Rows of docs without near copies: of each component the first document (least doc_id) stays; rows that repeat it stay with it.

    Documents are linked if their sets of shingles have the similarity or more.
    The radius of the fingerprints, which only save work, is two standard errors
    beyond where a pair at the threshold lies on average.
    """
    share, bits = bits_at(similarity), 64 * planes
    radius = round(share * bits + 2 * math.sqrt(share * (1 - share) * bits))
    got = near_duplicates(docs, words, radius, planes, 1 - share, similarity)
    heads = store(got.filter(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("head"))).select(F.coalesce("doc_id", F.lit(_LEAST)).alias("at"), F.col("head").alias("hash")).distinct(), "kept-documents")
    # as one column the rows keep clear of the names used here
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("at"), F.xxhash64(F.col("text").cast("string")).alias("hash"))
    return rows.join(heads, ["at", "hash"], "left_semi").select("row.*")
