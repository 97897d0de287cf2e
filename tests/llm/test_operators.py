"""Each corpus operator against brute force or a round trip, on small and awkward tables."""

import collections
import hashlib
import itertools
import random
import time
import unicodedata
import zlib
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sessionlake.llm import common, components, decontam, fingerprint, linededup, packing, quality, sharding, simhash, suffix_dedup, toxicity, urlfilter
from sessionlake.llm import queries as Q

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["ab", "cde", "fgh i", "jklm", "né", "zz", "Qu.", "the", "of"]


def docs_of(spark, rows, parts=3):
    """documents with a further column of an awkward name."""
    full = [(i, t, "en", "s", None if t is None else len(t), "x") for i, t in rows]
    return spark.createDataFrame(full, DOC + ", key string").repartition(parts)


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "x"), (904, "a" * 3000), (905, "ab" * 1500), (906, "é\n\né\n"), (None, "no id at all, but a text of some length")]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(0, 80))) for i in range(60)]
    base = prose(rng, 60)
    rows += [(100 + i, prose(rng, 4) + base[rng.randint(0, 60) : rng.randint(120, 300)] + prose(rng, 4)) for i in range(20)]
    return [*rows, (130, rows[3][1]), (131, rows[3][1]), *ODD]


# 1


def removed_by_force(rows, length):
    seen = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"most_in_shard": 3, "shard_bytes": 200, "block": 64}])
@pytest.mark.parametrize("length", [12, 90])
def test_suffix_dedup(spark, corpus, length, sizes):
    got = suffix_dedup.remove_repeats(docs_of(spark, corpus), length, **sizes).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=str) == removed_by_force(corpus, length)


def test_suffix_dedup_of_repeated_rows_and_nothing(spark):
    rows = [(1, "q" * 5 + "unlike" * 3), (1, "q" * 5 + "unlike" * 3), (2, "short")]
    got = suffix_dedup.remove_repeats(docs_of(spark, rows), 10).select("doc_id", "n_removed").collect()
    assert sorted(map(tuple, got)) == [(1, 23), (1, 23), (2, 0)]
    assert suffix_dedup.remove_repeats(docs_of(spark, []), 10).count() == 0


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    for n in (1, 2, 50, 300):
        text = np.asarray([rng.randint(1, 3) for _ in range(n)], np.int16)
        order, rank = suffix_dedup.suffix_array(text)
        plain = sorted(range(n), key=lambda i: text[i:].tolist())
        assert order.tolist() == plain and [plain[r] for r in rank] == list(range(n))
        lcp = suffix_dedup.common_prefixes(text, order, rank, 40)
        force = [0] + [next((k for k in range(41) if a + k >= n or b + k >= n or text[a + k] != text[b + k]), 40) for a, b in itertools.pairwise(plain)]
        assert lcp.tolist() == [min(40, x) for x in force]


def test_window_classes_compare_no_bytes_beyond_a_member(monkeypatch):
    rng = random.Random(2)
    copies = [bytes(rng.choice(b"abcd") for _ in range(120))] * 60
    near = [copies[0][:50] + bytes([rng.choice(b"abc")]) + copies[0][51:] for _ in range(9)]
    everything = bytes(rng.randrange(256) for _ in range(600))
    sorted_ = []
    for name in ("sort", "argsort"):
        monkeypatch.setattr(np, name, lambda a, *args, f=getattr(np, name), **kw: sorted_.append(len(a)) or f(a, *args, **kw))
    for members in (copies, near, [b"ab" * 90, b"b" + b"ab" * 80, b"a" * 150, b"a" * 140], [everything, everything[100:] + b"\0" * 90]):
        sorted_.clear()
        cls, member, start, size = suffix_dedup.window_classes(members, 30)
        got = collections.defaultdict(set)
        for c, m, i in zip(cls.tolist(), member.tolist(), start.tolist()):
            got[c].add((m, i))
        want = collections.defaultdict(set)
        for m, b in enumerate(members):
            for i in range(len(b) - 29):
                want[b[i : i + 30]].add((m, i))
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and [len(got[c]) for c in range(len(size))] == size.tolist()
        # doubling ends with the longest member, however many equal ones stand in a row
        assert sum(sorted_) <= 6 * sum(len(b) + 1 for b in members)


# 2


@pytest.mark.parametrize("common", [0, 0.2, 2])
def test_toxicity_search_is_exact(common):
    rng = random.Random(2)
    texts = [[rng.choice(range(30)) for _ in range(rng.randint(1, 9))] for _ in range(400)]
    owner, term, count = map(np.asarray, zip(*((i, t, n) for i, x in enumerate(texts) for t, n in sorted(collections.Counter(x).items()))))
    idf = np.asarray([1 + (i % 7) / 3 for i in range(30)])
    index = toxicity.Index(owner, term, count, idf, np.zeros(400, int), np.arange(400), block=8, leaders=5, common=common)

    def dense(x):
        v = np.zeros(30)
        for t, n in collections.Counter(x).items():
            v[t] = (1 + np.log(n)) * idf[t]
        return v / np.linalg.norm(v)

    every = np.asarray([dense(texts[d]) for d in index.doc_id])
    for k in (1, 9, 60, 399, 400, 500):
        for _ in range(15):
            x = [rng.choice(range(30)) for _ in range(rng.randint(1, 9))]
            terms, counts = np.unique(x, return_counts=True)
            cos, at = index.nearest(terms, counts, k)
            force = every @ dense(x)
            want = np.sort(force[force > 1e-12])[::-1][:k]
            assert np.allclose(cos, want) and np.allclose(force[at], cos) and len(set(at.tolist())) == len(at)
    assert len(index.nearest(np.zeros(0, int), np.zeros(0, int), 5)[0]) == 0


def scores_by_force(rows, labels, label_rate):
    """The whole score in plain loops: rows (id, text), labels {id: label}, one text per id and no two texts equal."""
    bags = {d: collections.Counter(toxicity.words_of(t)) for d, t in rows}
    df = collections.Counter(w for b in bags.values() for w in b)
    known = sorted(d for d in labels if bags[d])
    vocab = {w for d in known for w in bags[d]}
    idf = {w: np.log((1 + len(rows)) / (1 + df[w])) + 1 for w in vocab}

    def unit(bag):
        v = {w: (1 + np.log(n)) * idf[w] for w, n in bag.items() if w in vocab}
        size = sum(x * x for x in v.values()) ** 0.5
        return {w: x / size for w, x in v.items()}

    examples = {d: unit(bags[d]) for d in known}
    sizes = collections.Counter(labels[d] for d in known)
    k = min(max(25, len(known) // 16), len(known) - 2)

    def share(v, without=None):
        cos = sorted(((sum(x * e.get(w, 0) for w, x in v.items()), d) for d, e in examples.items() if d != without), reverse=True)
        cos = [c for c in cos if c[0] > 1e-12][: k + 1]
        floor = cos[k][0] if len(cos) > k else 0
        votes = [(max(c - floor, 1e-12) / sizes[labels[d]], labels[d]) for c, d in cos[:k]]
        return sum(w for w, y in votes if y) / sum(w for w, _ in votes) if votes else None

    pools = []
    rates = {1: label_rate / sizes[1], 0: (1 - label_rate) / sizes[0]}
    for v, y in sorted((share(examples[d], d), labels[d]) for d in known):
        pools.append([(v, y)])
        rate = lambda p: sum(rates[y] * y for _, y in p) / sum(rates[y] for _, y in p)
        while len(pools) > 1 and rate(pools[-2]) >= rate(pools[-1]):
            pools[-2:] = [pools[-2] + pools[-1]]
    total = [sum(rates[y] for _, y in p) for p in pools]
    xs = [sum(rates[y] * v for v, y in p) / t for p, t in zip(pools, total)]
    ys = np.maximum.accumulate([(sum(rates[y] * y for _, y in p) + t / len(p) / 2) / (t + t / len(p)) for p, t in zip(pools, total)])
    return {d: label_rate if (s := share(unit(b))) is None else float(np.interp(s, xs, ys)) for d, b in bags.items() if b}


def test_toxicity_by_force(spark):
    rng = random.Random(41)
    many = [f"{a}{b}" for a in "abcdefgh" for b in "mnopqrst"]
    labels = {i: int(rng.random() < 0.25) for i in range(160)}
    rows = [(i, prose(rng, rng.randint(5, 40), many) + (" foul" * rng.randint(1, 2) if labels.get(i) else "")) for i in range(200)]
    rows += [(300, "unheard of"), (301, "zzz"), (302, None), (303, " 12 ")]
    table = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs_of(spark, rows), table).collect()}
    want = scores_by_force(rows, labels, sum(labels.values()) / len(labels))
    assert set(want) == set(got) - {302, 303} and got[302] == got[303]
    assert all(abs(got[d] - want[d]) < 1e-6 for d in want), [(d, got[d], want[d]) for d in want if abs(got[d] - want[d]) > 1e-6][:5]
    assert got[300] == got[301] == sum(labels.values()) / len(labels) and len({got[i] for i in range(200)}) > 20


def test_toxicity_of_repeated_rows_and_null_ids(spark):
    rows, labels = toxic_corpus(300)
    twice = [*rows, rows[0], rows[0], (None, "vile vile ab"), (None, "ab the of"), (7, "another text under one id, vile")]
    got = toxicity.report(docs_of(spark, twice), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(twice) and len({r["score"] for r in got if r["doc_id"] == 0}) == 1
    assert sorted(r["predicted"] for r in got if r["doc_id"] is None) == [0, 1]
    bounded = toxicity.score(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), most_examples=60, most_entries=400).collect()
    assert len(bounded) == 300 and len({r["score"] for r in bounded}) > 3


def toxic_corpus(n=800):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.2
        rows.append((i, prose(rng, 30) + (f" {rng.choice(['vile', 'nasty', 'foul'])} " * rng.randint(1, 3) if bad else "") + prose(rng, 30)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_corpus()
    table = spark.createDataFrame([*labels, (None, 1), (5, None), (99999, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.report(docs_of(spark, [*rows, *ODD[:-1]]), table).collect()}
    assert len(got) == len(rows) + len(ODD) - 1 and all(0 <= r["score"] <= 1 for r in got.values())
    held = [(got[i]["predicted"], y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in labels)
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert got[900]["predicted"] == 0 and got[900]["score"] == got[901]["score"]
    assert any(r["neighbours"] for r in got.values())


def test_toxicity_terms_put_inflected_forms_together(spark):
    assert toxicity.words_of("Foulness foul2fouls \u00dcbel\u00e4, x_y") == ["foul", "foul", "foul", "\u00fcbel", "x", "y"]
    rng = random.Random(19)
    letters = "abcdefghijklmnopqrstuvwxyz"
    end = lambda: "".join(rng.choices(letters, k=6))
    # no two documents share a whole bad word
    rows, labels = [], []
    for i in range(400):
        bad = rng.random() < 0.3
        rows.append((i, prose(rng, 30) + "".join(f" vile{end()}" for _ in range(3 * bad))))
        labels.append((i, int(bad)))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.report(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).filter("held_out").collect()}
    assert sum(got[i] == y for i, y in labels if i in got) / len(got) > 0.95


def test_toxicity_ignores_held_out_labels(spark):
    rows, labels = toxic_corpus(300)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.report(docs_of(spark, rows), spark.createDataFrame(x, "doc_id long, toxic int")).collect()} for x in (labels, flipped))
    assert a == b


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.report(docs_of(spark, ODD), none).collect()} == {0.0}
    assert toxicity.report(docs_of(spark, []), none).count() == 0


# 3


def graded(n, rng):
    rows, labels = [], []
    for i in range(n):
        grade = rng.randint(0, 2)
        rows.append((i, prose(rng, 40) + [" $$ ## $$ ## $$ ## %%", " $$", ""][grade] * 4))
        labels.append((i, grade))
    return rows, labels


def test_quality_with_three_grades(spark):
    rng = random.Random(4)
    rows, labels = graded(600, rng)
    model = quality.train(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert model.grades == [0, 1, 2] and model.thresholds[0] < model.thresholds[1]
    fresh, truth = graded(200, random.Random(5))
    got = {r["doc_id"]: r for r in quality.with_grades(docs_of(spark, [*fresh, *ODD]), model).collect()}
    assert sum(round(got[i]["expected_grade"]) == y for i, y in truth) > 180
    assert all(0 <= r["tail_probability"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in got.values()) and len(got) == 200 + len(ODD)


def test_quality_buffer_and_single_texts_agree():
    rng = random.Random(6)
    texts = ["", "a", "ab", prose(rng, 50), "x y x y y", "é" * 20, prose(rng, 9)]
    model = quality.Model([0, 1], np.random.default_rng(0).normal(size=quality.WIDTH), np.zeros(1))
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    z = model.linear(data, offsets, np.asarray([quality.repetition(t) for t in texts]))
    force = [float((model.weights[at] * v).sum()) for at, v in map(quality.sparse_features, texts)]
    assert np.allclose(z, force, atol=1e-4)
    for block in (7, 50, 10_000):
        assert np.allclose(model.linear_long(data, 0.25, block), model.linear(data, np.asarray([0, len(data)]), np.asarray([0.25])))


def test_quality_select_keeps_columns(spark):
    rng = random.Random(7)
    rows, labels = graded(200, rng)
    ratings = spark.createDataFrame([(i, min(y, 1)) for i, y in labels] + [(None, 1), (3, None)], "doc_id long, quality int")
    docs = docs_of(spark, [*rows, *ODD])
    out = quality.select(docs, ratings)
    assert out.columns == docs.columns and 0 < out.count() < docs.count()
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.select(docs, none).count() == docs.count()
    assert quality.report(docs_of(spark, []), none).count() == 0


# 4


def fingerprint_by_force(text, k):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked_by_force(fps, radius):
    ids = list(range(len(fps)))
    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius and ids[i] != ids[j]:
            a, b = sorted((ids[i], ids[j]))
            ids = [a if x == b else x for x in ids]
    return ids


def test_simhash(spark, corpus):
    rows = [r for r in corpus if r[0] is not None]
    rng = random.Random(8)
    base = prose(rng, 200).split()
    for i in range(40):
        words = list(base)
        words[rng.randrange(len(words))] = "edit"
        rows.append((200 + i, " ".join(words)))
    got = {r["doc_id"]: r for r in simhash.report(docs_of(spark, rows)).collect()}
    fps = [fingerprint_by_force(t, 4) for _, t in rows]
    assert [got[d]["fingerprint"] for d, _ in rows] == [f"{f:016x}" for f in fps]
    root = linked_by_force(fps, 4)
    least = {r: min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in root}
    assert [got[d]["component_id"] for d, _ in rows] == [least[r] for r in root]
    assert got[900]["component_id"] == got[901]["component_id"] == got[902]["component_id"] == 900 or got[900]["component_id"] < 900


def test_simhash_buckets_in_a_grid(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MOST_IN_TASK", 8)
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fp = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for c in centre]))
    nodes = spark.createDataFrame([(int(x), int(x)) for x in fp.view(np.int64)], "node long, f0 long").repartition(3)
    got = components.components(simhash.links(nodes, 1, simhash.block_keys(len(fp), 4), 4)).collect()
    root = linked_by_force([int(x) for x in fp], 4)
    force = collections.defaultdict(set)
    for x, r in zip(fp.view(np.int64).tolist(), root):
        force[r].add(x)
    mine = collections.defaultdict(set)
    for r in got:
        mine[r["root"]].add(r["node"])
    assert sorted(map(sorted, mine.values())) == sorted(sorted(s) for s in force.values() if len(s) > 1)


def test_pivot_windows_hold_every_near_pair_once():
    rng = np.random.default_rng(19)
    for n, groups, most in ((0, 1, 9), (1, 1, 9), (300, 3, 50), (300, 120, 1 << 21), (700, 1, 1000)):
        group = np.sort(rng.integers(0, groups, n))
        fp = rng.integers(0, 2**63, 8, dtype=np.uint64)[rng.integers(0, 8, n)]
        for _ in range(3):
            fp = fp ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
        table = simhash.pivot_table(fp[:, None])
        got = [p for i, j in simhash.pivot_windows(group, table, 4, most) for p in zip(i.tolist(), j.tolist())]
        d = np.bitwise_count(fp[:, None] ^ fp[None, :])
        near = {(a, b) for a, b in zip(*np.nonzero((d <= 4) & (group[:, None] == group[None, :]))) if a < b}
        pairs = {tuple(sorted(p)) for p in got}
        assert len(pairs) == len(got) and near <= pairs and all(a != b and group[a] == group[b] for a, b in pairs)
        close = np.abs(table[:, None, :2] - table[None, :, :2]).max(2) <= 4 if n else np.zeros((0, 0))
        assert all(close[a, b] for a, b in pairs)


def test_near_pairs_keep_every_level_joined():
    rng = np.random.default_rng(9)
    for sizes in ([5, 1, 40, 2], [300], [3, 120]):
        groups = np.repeat(np.arange(len(sizes)), sizes)
        centre = rng.integers(0, 2**63, 12, dtype=np.uint64)
        fp = centre[rng.integers(0, 12, len(groups))]
        for _ in range(5):
            fp = fp ^ (np.uint64(1) << rng.integers(0, 64, len(groups)).astype(np.uint64))
        for side in (np.zeros(len(groups), int), rng.integers(1, 3, len(groups))):
            a, b = simhash.near_pairs(groups, fp[:, None], side, 12)
            d = np.bitwise_count(fp[:, None] ^ fp[None, :]).astype(int)
            allowed = (groups[:, None] == groups[None, :]) & ((side[:, None] == 0) | (side[:, None] != side[None, :])) & ~np.eye(len(groups), dtype=bool)
            assert allowed[a, b].all() and (d[a, b] <= 12).all() and len(a) < len(groups)
            for level in (2, 6, 9, 12):
                want = simhash.forest(len(groups), *np.nonzero(allowed & (d <= level)))
                got = simhash.forest(len(groups), a[d[a, b] <= level], b[d[a, b] <= level])
                assert (want == got).all()


def test_simhash_keys_miss_no_near_pair():
    rng = np.random.default_rng(5)
    for n in (10, 300_000, 10**8):
        keys = simhash.block_keys(n, 4)
        a = rng.integers(0, 2**63, 200, dtype=np.uint64)
        b = a.copy()
        for _ in range(4):
            b ^= np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)
        assert (keys(a[:, None]) == keys(b[:, None])).any(1).all()


def test_keep_one_of_near_copies(spark):
    rng = random.Random(12)
    many = [f"w{i}" for i in range(3000)]
    rows = [(i, prose(rng, 300, many)) for i in range(40)]
    for i in range(10):
        words = rows[i][1].split()
        words[150] = "changed"  # five of about 300 shingles
        rows.append((100 + i, " ".join(words)))
    rows += [(200, rows[20][1]), (201, None), (202, "")]
    kept = {r["doc_id"] for r in simhash.keep_one(docs_of(spark, rows)).collect()}
    assert kept == {*range(40), 201}
    assert simhash.keep_one(docs_of(spark, [])).count() == 0


def kept_by_force(rows, similarity=0.8):
    sets = [set(simhash.shingle_hashes(t, 5)) for _, t in rows]
    root = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if root[i] != root[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    return {rows[r][0] for r in root}


def edited_variants(rng, groups, variants, edits):
    many = [f"w{i}" for i in range(9000)]
    rows = []
    for g in range(groups):
        base = [rng.choice(many) for _ in range(204)]
        for _ in range(variants):
            words = list(base)
            for at in rng.sample(range(len(words)), rng.randint(*edits)):
                words[at] = f"e{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(words)))
    return rows


def test_keep_one_joins_what_no_forest_of_distances_joins(spark):
    rows = edited_variants(random.Random(5), 12, 40, (3, 7))
    assert {r["doc_id"] for r in simhash.keep_one(docs_of(spark, rows)).collect()} == kept_by_force(rows)


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    root = {x: x for e in links for x in e}
    for _ in range(len(root)):
        for u, v in links:
            root[u] = root[v] = min(root[u], root[v])
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in links)}


# 5


def test_url_filter(spark):
    urls = [
        (1, "http://Blog.X.EXAMPLE.org/es/a?q#f", "blog.x.example.org", "/es/a", "example.org/es/", "block"),
        (2, "https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        (3, "https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        (4, "http://a.com/fr/", "a.com", "/fr/", "com/fr/", "allow"),
        (5, "http://a.com/de/x", "a.com", "/de/x", "com/de/", "block"),
        (6, "http://m.spam-farm.example.net/x", "m.spam-farm.example.net", "/x", None, "block"),
        (7, "http://www.spam-farm.example.org/en/2", "www.spam-farm.example.org", "/en/2", "org/", "allow"),
        (8, "http://org", "org", "", None, "allow"),
        (9, "no scheme.org/", "", "", None, "allow"),
        (10, None, "", "", None, "allow"),
        (11, "x://a.org?u=http://b.com/de/", "a.org", "", None, "allow"),
        (11, "x://a.org?u=http://b.com/de/", "a.org", "", None, "allow"),
        (None, "ftp://u@h:80/p\nq", "u@h:80", "/p\nq", None, "allow"),
    ]
    pages = spark.createDataFrame([(p, u, "<html>", "e") for p, u, *_ in urls], "page_id long, url string, html string, entry string")
    want = sorted((tuple(x for i, x in enumerate(u) if i != 1) for u in urls), key=str)
    for most in (64, 1.6e-5):  # one filter, and three of eight entries each
        got = urlfilter.judge(pages, urlfilter.entries(spark, Q.URL_RULES, Q.BLOCKED_URLS), filter_mb=most).select("page_id", "host", "path", "rule", "verdict").collect()
        assert sorted(map(tuple, got), key=str) == want
    assert urlfilter.judge(pages.limit(0), urlfilter.entries(spark, Q.URL_RULES, [])).count() == 0
    assert {r["verdict"] for r in urlfilter.judge(pages, urlfilter.entries(spark, [], []), default="block").collect()} == {"block"}


def test_url_filter_with_a_long_list(spark):
    """Thousands of listed URLs, with paths and in several parts, one of them met by half of all pages."""
    rng = random.Random(29)
    listed = sorted({f"h{rng.randrange(900)}.example.net" + rng.choice(["", "/a", f"/p{rng.randrange(50)}/"]) for _ in range(4000)} | {"hot.example.net"})
    pages = [(i, f"http://{rng.choice(['', 'www.'])}{rng.choice(['hot', f'h{rng.randrange(1200)}'])}.example.net{rng.choice(['', '/', '/a/b', f'/p{rng.randrange(60)}/x'])}") for i in range(1500)]

    def blocked(url):
        host, _, path = url.removeprefix("http://").partition("/")
        labels, path = host.split("."), "/" + path if _ else ""
        known = set(listed)
        return any(".".join(labels[k:]) + path[:n] in known for k in range(len(labels)) for n in range(len(path) + 1))

    table = spark.createDataFrame(pages, "page_id long, url string")
    for mb, entries in ((64, urlfilter.entries(spark, [], listed)), (2e-3, urlfilter.blocked(spark.createDataFrame([(f" {u} ",) for u in [*listed, ""]], "url string")))):
        got = {r["page_id"]: r["verdict"] for r in urlfilter.judge(table, entries, filter_mb=mb).collect()}
        assert got == {i: "block" if blocked(u) else "allow" for i, u in pages}


def test_blocked_bloom():
    rng = np.random.default_rng(1)
    own, other = (rng.integers(-(2**63), 2**63, n) for n in (5000, 50_000))
    bloom = urlfilter.BlockedBloom(5000 * urlfilter.BITS_A_KEY // 512)
    bloom.add(own)
    assert bloom.may_hold(own).all() and bloom.may_hold(other).mean() < 0.02


# 6


def test_shard_store(spark, tmp_path):
    docs = docs_of(spark, [(i, "t" * (i % 40)) for i in range(300)] + ODD)
    store = sharding.ShardStore(spark, str(tmp_path / "s"), docs.schema, target_bytes=20_000, fanout=3)
    assert store.read().count() == 0
    for i in range(3):
        store.append(docs.filter(f"pmod(coalesce(doc_id, 0), 3) = {i}"))
    store.append(docs.limit(0))
    version, runs = store.manifest()
    assert version == 3 and len(runs) == 3
    assert store.compact() == 4 and len(store.manifest()[1]) == 1
    same = lambda df: sorted(map(str, df.select(*docs.columns).collect()))
    assert same(store.read()) == same(docs) == same(store.read(3)) and store.read(1).count() < 308
    with pytest.raises(sharding.VersionTaken):
        store.commit(3, [])
    assert store.vacuum() == 3 and store.versions() == [4] and same(store.read()) == same(docs)
    docs.limit(3).write.parquet(f"{store.path}/runs/left-behind")  # by a job that failed before its commit
    assert store.vacuum() == 0 and store.vacuum(orphans_after=0) == 1 and same(store.read()) == same(docs)


def test_shard_store_when_another_writer_is_first(spark, tmp_path, monkeypatch):
    docs = docs_of(spark, [(i, "t" * i) for i in range(30)])
    mine, other = (sharding.ShardStore(spark, str(tmp_path / "s"), docs.schema, fanout=2) for _ in range(2))
    commit = sharding.ShardStore.commit
    won = []

    def late(self, version, runs):
        if self is mine and not won:
            won.append(other.append(docs.filter("doc_id >= 20")))
        return commit(self, version, runs)

    monkeypatch.setattr(sharding.ShardStore, "commit", late)
    assert mine.append(docs.filter("doc_id < 20")) == 2 and mine.read().count() == 30
    monkeypatch.setattr(sharding.ShardStore, "commit", lambda self, version, runs: commit(self, version - 1, runs))
    with pytest.raises(sharding.VersionTaken):
        mine.compact()
    monkeypatch.undo()
    assert mine.compact() == 3 and mine.read().count() == 30


CLASHING = ["row", "at", "hash", "head", "arrival", "_expected_grade", "__shard", "n_chars", "k", "label"]


def test_clashing_columns_come_back(spark):
    rng = random.Random(23)
    rows = [(i, prose(rng, 30), *range(len(CLASHING))) for i in range(12)] + [(12, None, *range(len(CLASHING))), (None, "", *range(len(CLASHING)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in CLASHING))
    ratings = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, "words that nothing has")], "item_id long, text string")
    same = lambda df: sorted(map(str, df.collect()))
    assert quality.select(docs, ratings, least=0.0).columns == docs.columns and same(quality.select(docs, ratings, least=0.0)) == same(docs)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and set(same(kept)) <= set(same(docs)) and kept.count() == 13
    assert same(decontam.clean(docs, items)) == same(docs) and same(linededup.dedup(docs)) == same(docs)
    assert sharding.report(docs).count() == 14


def test_sharding_round_trip(spark, corpus):
    got = sharding.report(docs_of(spark, corpus), arrivals=4).collect()
    assert sorted((r["doc_id"], r["stored_chars"]) for r in got if r["doc_id"] is not None) == sorted((d, len(t or "")) for d, t in corpus if d is not None) and len(got) == len(corpus)
    assert sharding.report(docs_of(spark, [])).count() == 0


# 7


def lines_by_force(rows, min_chars=20, min_docs=3):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = collections.defaultdict(set)
    least = -1
    for d, t in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(least if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and (least if d is None else d) < max(holders[key(x)]))]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup(spark, corpus):
    common = ["A line that many documents hold.", "\t a LINE that many documents hold. \x0c", "short", "Ünïcode line of twenty!!", "only two have this line here"]
    rng = random.Random(2)
    rows = [(d, t if rng.random() < 0.5 else "\n".join([t or "", *rng.choices(common[:4], k=3), ""])) for d, t in corpus]
    rows += [(300, common[4]), (301, common[4]), (302, common[0] + "\n" + common[1]), (302, common[0])]
    for options in ({}, {"most_broadcast": 3}, {"most_broadcast": 0, "batches": 1}):
        got = linededup.report(docs_of(spark, rows), **options).collect()
        assert sorted(map(tuple, got), key=str) == lines_by_force(rows)
    assert linededup.report(docs_of(spark, [])).count() == 0


def test_line_runs(spark, tmp_path):
    runs = linededup.LineRuns(spark, str(tmp_path / "runs"), fanout=2)
    batches = [spark.createDataFrame([(10 * b + i, i % 4 + b, 7) for i in range(6)], "doc_id long, h1 long, h2 long") for b in range(5)]
    seen = set()
    for batch in batches:
        fresh = {r["h1"] for r in runs.admit(batch).collect()}
        assert fresh == {r["h1"] for r in batch.collect()} - seen
        seen |= fresh
    assert [len(level) for level in runs.levels] == [1, 0, 1] and sorted(r["h1"] for r in runs.runs().collect()) == sorted(seen)


def test_line_runs_keep_counts(spark, tmp_path):
    rng = random.Random(17)
    runs = linededup.LineRuns(spark, str(tmp_path / "runs"), fanout=2)
    rows = [(d, rng.choice([1, 1, 1, rng.randrange(40)]), 7) for d in range(200) for _ in range(2)]  # hash 1 is in nearly all documents
    for b in range(5):
        runs.add(spark.createDataFrame([r for r in rows if r[0] % 5 == b], "doc_id long, h1 long, h2 long"))
    held = collections.defaultdict(set)
    for d, h, _ in rows:
        held[h].add(d)
    got = {r["h1"]: (r["n_docs"], r["top"]) for r in runs.repeated(3).collect()}
    assert got == {h: (len(x), max(x)) for h, x in held.items() if len(x) >= 3}
    assert sorted(r["h1"] for r in runs.runs().collect()) == sorted(held)  # each hash in one run only


def test_line_dedup_with_clashing_columns(spark):
    line = "a line that is long enough to be told apart"
    rows = [(i, f"{line}\nown {i}", 1, 2, 3, 4, 5, "x", 6) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, row int, gone int, h1 int, text_hash int, `a.b` string, __n_lines int")
    out = linededup.dedup(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [(i, f"own {i}" if i < 3 else rows[3][1], *rows[i][2:]) for i in range(4)]


# 8


def test_decontamination(spark):
    rng = random.Random(11)
    many = [f"w{i}" for i in range(5000)]
    items = [(i, prose(rng, 40, many)) for i in range(12)] + [(50, None), (51, "..."), (52, "two words"), (3, prose(rng, 30, many))]
    rows = [(i, prose(rng, 300, many)) for i in range(30)]
    whole = items[0][1]
    edited = items[1][1].split()
    for k in range(0, 40, 6):
        edited[k] = "changed"
    rows += [(100, f"{rows[0][1]} {whole.upper()}. {rows[1][1]}"), (101, f"x {' '.join(edited)} y"), (102, " ".join(items[2][1].split()[:26])), (103, " ".join(items[2][1].split()[:8])), (104, "on two, words"), *ODD]
    rows += [(200 + i, whole) for i in range(40)]
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.matches(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(100, 0), (101, 1), (102, 2), (104, 52), *((200 + i, 0) for i in range(40))}
    assert got[100, 0]["score"] == 1 and got[100, 0]["n_words"] == 40 and got[100, 0]["first_word"] == 300 and 0.6 < got[101, 1]["score"] < 1
    docs = docs_of(spark, rows)
    kept = decontam.clean(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in got}
    assert decontam.matches(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert decontam.matches(docs_of(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_decontamination_of_edited_copies_of_hot_items(spark):
    rng = random.Random(31)
    many = [f"w{i}" for i in range(5000)]
    items = [(every, prose(rng, 48, many)) for every in (5, 6, 8)]
    rows = []
    for every, item in items:
        words = item.split()
        words[every - 1 :: every] = ["changed"] * len(words[every - 1 :: every])
        rows += [(1000 * every + i, f"{prose(rng, 30, many)} {text} {prose(rng, 30, many)}") for i, text in enumerate([item] * 60 + [" ".join(words)])]
    rows += [(i, prose(rng, 100, many)) for i in range(20)]
    docs, table = docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.matches(docs, table).collect()}
    assert set(got) == {(1000 * every + i, every) for every, _ in items for i in range(61)}
    assert all(0.5 < got[1000 * every + 60, every] < 1 for every, _ in items)
    assert {r["doc_id"] for r in decontam.clean(docs, table).collect()} == set(range(20))


def test_common_words_bound_the_alignment():
    rng = np.random.default_rng(4)
    for _ in range(200):
        item, text = rng.integers(0, 6, rng.integers(1, 12)).astype(np.uint64), rng.integers(0, 9, rng.integers(1, 20)).astype(np.uint64)
        items = decontam.Items([0], [item], [np.unique(item, return_counts=True)], [1], np.zeros(0, np.uint64), [])
        assert decontam.align(item, text)[0] <= decontam.MATCH * items.common(0, text)


def test_long_documents_are_hashed_in_pieces():
    rng = random.Random(6)
    for text in (prose(rng, 300), "x" * 500, "", " . ", "ab " * 90 + "y" * 60):
        data = np.frombuffer(text.encode(), np.uint8)
        whole = decontam.word_hashes(data, np.asarray([0, len(data)]))[0] if len(data) else np.zeros(0, np.uint64)
        for block in (1, 16, 1000):
            assert decontam.long_word_hashes(data, block).tolist() == whole.tolist()


def test_alignment_by_force():
    rng = np.random.default_rng(2)
    for _ in range(40):
        a, b = rng.integers(0, 4, rng.integers(1, 9)).astype(np.uint64), rng.integers(0, 4, rng.integers(1, 14)).astype(np.uint64)
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        score, s, e = decontam.align(a, b)
        assert score == h.max() and (score == 0 or (0 <= s < e <= len(b) and b[s] in a))


# 9


def test_fingerprints(spark, corpus):
    rows = [(d, t) for d, t in corpus if d is not None] + [(700, "Straße  ﬁn"), (701, "STRASSE fin ")]
    got = {r["doc_id"]: r for r in fingerprint.with_edits(docs_of(spark, rows)).collect()}
    form = lambda t: " ".join(unicodedata.normalize("NFKC", t or "").casefold().split())
    order = sorted(rows, reverse=True)
    for (d, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == float(form(edited) == form(t)) and r["near_next"] == float(form(after) == form(t))
        assert r["fingerprint"] == xxhash.xxh3_128_hexdigest(form(t).encode()) and r["edited_fingerprint"] == xxhash.xxh3_128_hexdigest(form(edited).encode())
    assert got[700]["fingerprint"] == got[701]["fingerprint"] and got[701]["near_next"] == 1
    assert len(got) == len(rows)


def test_fingerprints_of_few_rows(spark):
    one = fingerprint.with_edits(docs_of(spark, [(5, "abc def")])).collect()
    assert [(r["doc_id"], r["near_next"]) for r in one] == [(5, 1.0)]
    twice = fingerprint.with_edits(docs_of(spark, [(5, "b"), (5, "a"), (None, "c"), (5, "b")])).collect()
    assert len(twice) == 4 and sorted(r["near_next"] for r in twice) == [0, 0, 0, 1]
    assert fingerprint.with_edits(docs_of(spark, [])).count() == 0


def test_grouped_fingerprints(spark, corpus):
    rows = [*corpus, (700, "Straße  ﬁn"), (701, "STRASSE fin "), (701, "other"), (3, "other"), (None, "OTHER"), (2**62, "far"), (-(2**40), "away")]
    got = fingerprint.grouped(docs_of(spark, rows)).collect()
    forms = collections.defaultdict(list)
    for d, t in rows:
        forms[fingerprint.digest(fingerprint.canonical(t or ""))].append(-(2**63) if d is None else d)
    least = {f: None if min(ds) == -(2**63) else min(ds) for f, ds in forms.items()}
    assert len(got) == len(rows) and all(r["group_id"] == least[r["fingerprint"]] for r in got)
    assert fingerprint.grouped(docs_of(spark, [])).count() == 0


def test_exact_groups(spark, corpus):
    rows = [r for r in corpus if r[0] is not None]
    got = {r["doc_id"]: r["group_id"] for r in fingerprint.exact_groups(docs_of(spark, rows)).collect()}
    forms = {d: fingerprint.canonical(t or "") for d, t in rows}
    assert got == {d: min(e for e, f in forms.items() if f == forms[d]) for d in forms}


# 10


def bins_by_force(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] >= n]
        if fits:
            best = min(fits, key=lambda b: b[0])
        else:
            bins.append(best := [capacity])
        best[0] -= n
    return sorted(b[0] for b in bins)


def test_packing_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for capacity, n in ((10, 40), (64, 300), (100, 1000), (7, 1)):
        lengths = [rng.randint(1, capacity) for _ in range(n)]
        runs, made = packing.plan(collections.Counter(lengths), capacity)
        used = collections.Counter()
        for length, _, k, first, fit, _ in runs.tolist():
            for i in range(k):
                used[first + i // fit] += length
        assert sorted(capacity - u for u in used.values()) == bins_by_force(lengths, capacity) and made == len(used)


def pieces_by_contract(ids, capacity=1024):
    """(piece, start, length, crc32): only longer documents are cut, into full pieces; the first one may be shorter."""
    parts = []
    while len(ids) > capacity:
        ids, last = ids[:-capacity], ids[-capacity:]
        parts.insert(0, last)
    parts.insert(0, ids)
    starts = [0, *itertools.accumulate(map(len, parts))]
    return [(k, starts[k], len(p), zlib.crc32(np.asarray(p, "<u4").tobytes())) for k, p in enumerate(parts)]


def test_pieces_by_contract():
    assert [p[:3] for p in pieces_by_contract(list(range(2500)))] == [(0, 0, 452), (1, 452, 1024), (2, 1476, 1024)]
    assert [p[:3] for p in pieces_by_contract(list(range(2048)))] == [(0, 0, 1024), (1, 1024, 1024)] and len(pieces_by_contract([2])) == 1


def test_packing(spark, corpus):
    path = Q.tokenizer_path()
    rows = [*corpus, (800, prose(random.Random(1), 4000)), (801, "say <|endoftext|> twice"), (801, "say <|endoftext|> twice")]
    got = packing.pack(docs_of(spark, rows), path).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    want = []
    for d, t in rows:
        want += [(d, *p) for p in pieces_by_contract([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(sequences) == len(bins_by_force([w[3] for w in want], 1024))
    assert packing.pack(docs_of(spark, []), path).count() == 0


def test_encoder_agrees_with_tokenizers():
    from tokenizers import Tokenizer

    path = Q.tokenizer_path()
    tokenizer, encode = Tokenizer.from_file(path), packing.encoder(path)
    rng = random.Random(4)
    pools = ["abc DEF'll's  ", "été ß ñ œ", "\n\t\r \u00a0\u2003\u3000", "0123½²٣", "日本語 한국어 עברית", "😀👩‍👩‍👧é\u0301\u200d", "<|endoftext|>", "\x00\x1f\x7f\x85", "ǅʰⅣ"]
    for _ in range(400):
        text = "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 40)))
        assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_quality_fit_is_the_likelihoods_maximum():
    """Against a plain penalised likelihood: no step away from the fit makes it better."""
    rng = np.random.default_rng(3)
    n, words = 240, 12
    y = rng.integers(0, 3, n)
    places = [np.unique(np.concatenate([rng.integers(0, words, 3), np.full(1, 20 + int(g))])).astype(np.int32) for g in y]
    values = [np.full(len(p), 0.5, np.float32) for p in places]
    model = quality.fit(np.concatenate(places), np.concatenate(values), np.cumsum([len(p) for p in places]), y)

    def loss(weights, thresholds):
        z = np.asarray([float((weights[p] * v).sum()) for p, v in zip(places, values)])
        tail = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(-(z[:, None] - thresholds[None, :]))), np.zeros((n, 1))], 1)
        return -np.log(np.maximum(tail[np.arange(n), y] - tail[np.arange(n), y + 1], 1e-12)).mean()

    own = loss(model.weights, model.thresholds)
    base = loss(np.zeros(quality.WIDTH), np.asarray([-np.log(2), np.log(2)]))
    assert own < 0.5 * base
    for _ in range(40):  # a penalty pulls to zero, so steps may gain a little, but no more
        step = np.zeros(quality.WIDTH)
        step[:words] = rng.normal(size=words)
        assert loss(model.weights + 0.05 * step, model.thresholds) > own - 0.01
    assert loss(model.weights, model.thresholds + 1) > own and loss(model.weights, model.thresholds - 1) > own


def test_decontamination_against_full_alignment(spark):
    """Every pair of document and item aligned by force: those at the threshold, and no others, are found."""
    rng = random.Random(37)
    many = [f"w{i}" for i in range(60)]  # few words, so that common n-grams are shared by chance
    items = [(i, prose(rng, rng.randint(4, 30), many)) for i in range(25)]
    rows = []
    for i in range(120):
        words = prose(rng, 60, many).split()
        if i % 2:
            part = items[i % 25][1].split()
            for k in rng.sample(range(len(part)), int(len(part) * rng.choice([0.0, 0.1, 0.2, 0.3]))):
                part[k] = rng.choice(many)
            if rng.random() < 0.5:
                part = part[: max(3, int(len(part) * rng.uniform(0.5, 1)))]
            words[20:20] = part
        rows.append((i, " ".join(words)))
    code = {w: k for k, w in enumerate(many)}
    ids = lambda t: np.asarray([code[w] for w in t.split()], np.uint64)
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.matches(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    grams = lambda t: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)}
    want, unseeded = {}, 0
    for (d, t), (i, item) in itertools.product(rows, items):
        share = decontam.align(ids(item), ids(t))[0] / (decontam.MATCH * len(item.split()))
        if share >= decontam.THRESHOLD:
            if grams(t) & grams(item):
                want[d, i] = share
            else:
                unseeded += 1
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 40
    # what an n-gram seed cannot see: alignments in which no three words in a row are left
    assert unseeded <= 0.05 * len(want), unseeded


@pytest.fixture(scope="module")
def long_rows():
    rng = random.Random(43)
    vocabulary = [f"{rng.choice('abcdefgh')}{rng.randrange(10**5)}" for _ in range(30_000)]
    lines = [prose(rng, 12, vocabulary) for _ in range(17_000)]
    whole = "\n".join(lines)
    assert len(whole) > 1_200_000
    return [(1, whole), (2, "\n".join([*lines[:8000], "one line that is not there", *lines[8000:]])), (3, prose(rng, 30, vocabulary)), (4, None)]


def test_texts_of_a_megabyte(spark, long_rows, tmp_path):
    docs = docs_of(spark, long_rows)
    n = [len((t or "").encode()) for _, t in long_rows]
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert [got[i]["n_bytes"] for i in (1, 2, 3, 4)] == n and got[1]["n_removed"] == n[0] and got[2]["n_removed"] >= n[1] - 30 and got[3]["n_removed"] == 0
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")).collect())
    assert quality.report(docs, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")).count() == 4
    fps = {r["doc_id"]: r for r in simhash.report(docs).collect()}
    assert fps[1]["component_id"] == fps[2]["component_id"] == 1 and fps[3]["component_id"] == 3
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == {1, 3, 4}
    assert {r["doc_id"]: r["n_dropped"] for r in linededup.report(docs, min_docs=2).collect()} == {1: 17_000, 2: 0, 3: 0, 4: 0}
    items = spark.createDataFrame([(7, " ".join(long_rows[0][1].split()[100_000:100_040]))], "item_id long, text string")
    assert {r["doc_id"] for r in decontam.matches(docs, items).collect()} == {1, 2}
    assert {r["doc_id"]: r["n_chars"] for r in fingerprint.grouped(docs).collect()} == {i: len(t or "") for i, t in long_rows}
    packed = packing.pack(docs, Q.tokenizer_path()).collect()
    assert sum(r["length"] for r in packed if r["doc_id"] == 4) == 1 and all(r["length"] == 1024 for r in packed if r["piece"])
    pages = spark.createDataFrame([(1, "http://a.com/de/" + long_rows[0][1][:1_100_000])], "page_id long, url string")
    assert urlfilter.judge(pages, urlfilter.entries(spark, Q.URL_RULES, [])).first()["verdict"] == "block"


@pytest.mark.parametrize("similarity", [0.80, 0.82, 0.85])
def test_near_duplicates_at_the_threshold(spark, similarity):
    """Isolated pairs right above the threshold: none is lost, and none right below it is linked."""
    rng = random.Random(int(similarity * 1000))
    many = [f"w{i}" for i in range(20_000)]
    rows, pairs = [], 0
    for g in range(60):
        words = [rng.choice(many) for _ in range(rng.randint(60, 300))]
        base = set(simhash.shingle_hashes(" ".join(words), 5))
        copy, last = list(words), list(words)
        for at in rng.sample(range(len(words)), len(words)):
            copy[at] = f"e{rng.randrange(10**9)}"
            other = set(simhash.shingle_hashes(" ".join(copy), 5))
            if len(base & other) < similarity * len(base | other):
                break
            last = list(copy)
        rows += [(3 * g, " ".join(words)), (3 * g + 1, " ".join(last))]
        pairs += last != words
    assert {r["doc_id"] for r in simhash.keep_one(docs_of(spark, rows), similarity=similarity).collect()} == kept_by_force(rows, similarity) and pairs > 50


def shuffle_bytes(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return sum(p.stat().st_size for d in manager.localDirs() for p in Path(str(d)).rglob("shuffle_*.data"))


def test_stored_tables_leave_no_shuffle_files(spark):
    rows = spark.range(200_000).select(F.col("id"), F.xxhash64("id").alias("h"))
    before, set_before = shuffle_bytes(spark), spark.conf.get(common.SHUFFLE_CLEANUP, None)
    got = common.store(rows.repartition(4, "h").groupBy("h").agg(F.max("id").alias("top")), "grouped")
    for _ in range(50):  # files are deleted beside the program
        if shuffle_bytes(spark) <= before:
            break
        time.sleep(0.2)
    assert shuffle_bytes(spark) <= before
    assert got.count() == 200_000 and spark.conf.get(common.SHUFFLE_CLEANUP, None) == set_before


def test_near_duplicates_in_passes(spark, monkeypatch):
    """Rows that are dealt out at a time stay below the bound, and passes together find what one search finds."""
    monkeypatch.setattr(simhash, "PASS_BYTES", 1 << 17, raising=False)
    monkeypatch.setattr(simhash, "PASS_SHARE", 0, raising=False)
    rows = edited_variants(random.Random(6), 8, 20, (3, 7)) + edited_variants(random.Random(7), 60, 2, (6, 12))
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    dealt, plain = [], simhash._in_buckets

    def counted(*args):
        placed = plain(*args)
        dealt.append(placed.count() * len(placed.columns) * 8)
        return placed

    monkeypatch.setattr(simhash, "_in_buckets", counted)
    assert {r["doc_id"] for r in simhash.keep_one(docs_of(spark, rows)).collect()} == kept_by_force(rows)
    assert max(dealt) < 1.5 * (1 << 17) and sum(dealt) > 5 * (1 << 17)
