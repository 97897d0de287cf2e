"""The pipeline against a plain version of each stage, and registration of all its queries."""

import itertools
import os
import random

import pytest

import corpus_pipeline
from sessionlake.llm import queries as Q
from tests.llm.test_operators import DOC, bins_by_force, lines_by_force, pieces_by_contract, prose

SF = "/root/testdata/sf0.001"
MANY = [f"w{i}" for i in range(4000)]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(21)
    boiler = "This line of boilerplate is in many documents."
    rows, labels = [], []
    for i in range(150):
        good = rng.random() < 0.8
        text = "\n".join(prose(rng, 60, MANY) for _ in range(4)) if good else " ".join(f"{w}$$$ {w}***" for w in rng.choices(MANY, k=120))
        if good and i % 4 == 0:
            text += "\n" + boiler
        rows.append((i, text))
        labels.append((i, int(good), 0))
    for i in range(10):  # near and exact copies
        words = rows[i][1].split(" ")
        if i % 2:
            words[100] = "edited"
        rows.append((200 + i, " ".join(words)))
    items = [(i, prose(rng, 40, MANY)) for i in range(5)]
    rows += [(300 + i, prose(rng, 50, MANY) + " " + items[i][1] + " " + prose(rng, 50, MANY)) for i in range(4)]
    rows += [(400, prose(rng, 2500, MANY)), (401, "w1 w2")]
    path = tmp_path_factory.mktemp("sf")
    full = [(d, t, "en", "s", None if t is None else len(t)) for d, t in rows]
    spark.createDataFrame(full, DOC).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def test_stages_one_by_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "packing"]
    before = texts(docs)

    docs = stages["quality"](spark, docs, sf_dir)
    kept = texts(docs)
    assert docs.columns == columns and set(kept) == {d for d, t in before.items() if "$$$" not in t}

    docs = stages["line_dedup"](spark, docs, sf_dir)
    lines = texts(docs)
    assert docs.columns == columns and set(lines) == set(kept)
    import hashlib

    want = {d: sha for d, _, _, sha in lines_by_force(list(kept.items()))}
    assert {d: hashlib.sha256(t.encode()).hexdigest() for d, t in lines.items()} == want and any(lines[d] != kept[d] for d in kept)
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())

    docs = stages["near_duplicates"](spark, docs, sf_dir)
    one = texts(docs)
    root = {d: d for d in lines}
    sets = {d: shingles(t) for d, t in lines.items()}
    for a, b in itertools.combinations(sorted(lines), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((root[a], root[b]))
            root = {d: x if r == y else r for d, r in root.items()}
    assert docs.columns == columns and set(one) == set(root.values()) and len(one) < len(lines)

    docs = stages["decontamination"](spark, docs, sf_dir)
    clean = texts(docs)
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert docs.columns == columns and set(clean) == {d for d, t in one.items() if not any(i in t for i in items)} and len(clean) < len(one)

    check_packing(stages["packing"](spark, docs, sf_dir).collect(), clean)


def check_packing(rows, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(Q.tokenizer_path())
    want = []
    for d, t in docs.items():
        want += [(d, *p) for p in pieces_by_contract([*tokenizer.encode(t, add_special_tokens=False).ids, 2])]
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    assert len({r["sequence_id"] for r in rows}) == len(bins_by_force([w[3] for w in want], 1024))


def test_run_is_its_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    check_packing(corpus_pipeline.run(spark, sf_dir).collect(), texts(docs))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_all_queries_are_registered_and_run(spark):
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11)) and "pipeline" in entry.queries()
    n_docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_suffix_dedup", "op2_toxicity", "op3_quality", "op4_simhash", "op7_line_dedup", "op9_fingerprints"):
        assert entry.queries()[name](spark, SF).count() == n_docs


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_corpus_query_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(Q.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, Q.queries()[name](spark, SF).select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)
