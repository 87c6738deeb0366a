import os
import random
from fractions import Fraction

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from stratakv.llm import packing, queries
from tests.llm.conftest import EDGES, documents
from tests.llm.test_corpus_operators import brute_components, check_packing

DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are absent")
needs_vocabulary = pytest.mark.skipif(not os.path.exists("/opt/tokenizers/word_bpe_49k.json"), reason="the vocabulary is absent")


@needs_vocabulary
def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: f"w{rng.randint(0, 2000)}"
    item = " ".join(word() for _ in range(30))
    rows, toxic = [], set()
    for i in range(400):
        body = [word() for _ in range(rng.randint(30, 90))]
        if i % 7 == 0:
            body[3:3] = ["idiot", rng.choice(["scum", "trash"])]
            toxic.add(i)
        elif i % 11 == 0:
            body[5:5] = item.split()
        elif i % 13 == 0:
            body[5:5] = ["password", "=", '"hunter2hunter2"']
        elif i % 17 == 0 and rows and i - 1 not in toxic:
            body = (rows[-1][1] or "x").split()
        rows.append((i, " ".join(body)))
    rows += [(9000 + i, t) for i, (_, t) in enumerate(EDGES)]
    path = str(tmp_path / "sf")
    documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")

    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        seen.append(docs)
    one = {r.doc_id: r.text for r in seen[0].collect()}
    assert set(one) == {i for i, _ in rows} - toxic
    two = [(i, t) for i, t in rows if i in one]
    kept = {c if n else i for i, n, c in brute_components(two, 5, Fraction(4, 5))}
    assert {r.doc_id for r in seen[1].collect()} == kept
    three = {r.doc_id: r.text for r in seen[2].collect()}
    assert set(three) == {i for i in kept if item not in (one[i] or "")}
    four = {r.doc_id: r.text for r in seen[3].collect()}
    assert set(four) == set(three)
    assert all(("hunter2" not in (t or "")) and (("<SECRET>" in (t or "")) == ("hunter2" in (three[i] or ""))) for i, t in four.items())
    last = seen[4].collect()
    assert {r.doc_id for r in last} == set(four)
    check_packing(last, packing.CAPACITY)
    assert sorted((r.doc_id, r.ids_crc32, r.length) for r in corpus_pipeline.run(spark, path).collect()) == sorted((r.doc_id, r.ids_crc32, r.length) for r in last)


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DIR)
    want = c.sql(queries.ORACLE_SQL[name])
    names = sorted(df.columns)
    assert sorted(want.columns) == names
    places = [want.columns.index(n) for n in names]
    assert sorted(repr(tuple(r[n] for n in names)) for r in df.collect()) == sorted(repr(tuple(r[p] for p in places)) for r in want.fetchall())


def test_all_are_registered():
    got = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in got} and "pipeline" in got
