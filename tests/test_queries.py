"""Every registered query of the engine against its SQL on the small tables."""

import decimal
import glob
import os

import duckdb
import pytest

from sievelake.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.ORACLES[name])
    expected = rows([c[0] for c in want.description], want.fetchall())
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == expected


def test_searches_reach_every_row(spark, tmp_path):
    near = {0: [1.0, 0.0], 50: [1.0, 0.0], 100: [0.0, 1.0]}
    rows = [(i, near.get(i, [-1.0, -0.001 * i]), i % 3) for i in range(120)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.query_id: r.ref_id for r in catalogue.QUERIES["topk_retrieval"](spark, str(tmp_path)).where("rank = 1").collect()}
    assert got[0] == 50 and got[50] == 0


def test_minhash_finds_partial_copies(spark, tmp_path):
    fresh = lambda name, n: [f"{name}x{i}" for i in range(n)]
    shared = [fresh(f"s{i}", 60) for i in range(60)]
    both = [(i, " ".join(shared[i] + fresh(f"q{i}", 60)), " ".join(shared[i] + fresh(f"r{i}", 60))) for i in range(60)]
    spark.createDataFrame([b[:2] for b in both], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(b[0], b[2]) for b in both], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.query_id, r.ref_id) for r in catalogue.QUERIES["lsh_candidates"](spark, str(tmp_path)).collect()}
    assert sum((i, i) in got for i in range(60)) >= 50
