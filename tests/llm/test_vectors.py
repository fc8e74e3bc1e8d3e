"""Vector searches against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import ann as A
from quillspark.llm import exact_topk as E
from quillspark.llm.vectors import valid_vectors

SCHEMA = "vec_id long, embedding array<float>, block int"


def table(spark, n=400, width=8, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) * rng.uniform(0.2, 2, size=(n, 1))
    x[100:160] = x[100]  # many equal vectors
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(n)]
    rows += [(1000, None, 0), (1001, [], 0), (1002, [1.0, None], 0), (1003, [float("nan")], 0), (1004, [float("inf")], 0), (1005, [0.0] * width, 0), (None, [1.0], 0), (40, rows[40][1], 0)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(rows, queries, k, score):
    out = {}
    for q, v in queries.items():
        found = sorted(((-score(v, w), i) for i, w in rows.items() if i != q))[:k]
        out[q] = [(i, -s) for s, i in found]
    return out


def pad(x, n=8):
    return list(x) + [0.0] * (n - len(x))


@pytest.mark.parametrize("block_rows, query_rows", [(16384, 8192), (37, 11)])
def test_exact_top_k(spark, block_rows, query_rows):
    df = table(spark)
    rows = {r.vec_id: [math.floor(256 * v) for v in pad(r.embedding)] for r in df.filter("vec_id < 1000 or vec_id in (1001, 1005)").collect()}
    queries = {i: v for i, v in rows.items() if i % 50 == 0}
    got = {}
    for r in E.top_k(E.integer_vectors(df), F.col("vec_id") % 50 == 0, block_rows=block_rows, query_rows=query_rows).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute(rows, queries, 5, lambda a, b: sum(x * y for x, y in zip(a, b)))


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0], 0), (50, [2.0], 0)], SCHEMA)
    assert [tuple(r) for r in E.top_k(E.integer_vectors(df), F.col("vec_id") % 50 == 0).orderBy("query_id").collect()] == [(0, 1, 50, 131072), (50, 1, 0, 131072)]
    assert [tuple(r) for r in A.nearest(valid_vectors(df), F.col("vec_id") % 50 == 0).orderBy("query_id").collect()] == [(0, 1, 50, 2.0), (50, 1, 0, 2.0)]
    for empty in (df.filter("false"), spark.createDataFrame([(0, None, 0)], SCHEMA)):
        assert E.top_k(E.integer_vectors(empty), F.col("vec_id") % 50 == 0).count() == 0
        assert A.nearest(valid_vectors(empty), F.col("vec_id") % 50 == 0).count() == 0


def test_large_components_are_exact():
    big = float(1 << 40)
    assert E.products(np.array([[big, 1.0]]), np.array([[3.0, 1.0]]))[0, 0] == 3 * (1 << 40) + 1
    a = float((1 << 30) + 1)
    assert E.products(np.array([[a, 1.0]]), np.array([[a, 1.0]]))[0, 0] == ((1 << 30) + 1) ** 2 + 1


@pytest.mark.parametrize("shard_rows, query_rows", [(16384, 8192), (90, 7)])
def test_nearest_at_factor_one_is_exact(spark, shard_rows, query_rows):
    df = table(spark)
    rows = {r.vec_id: [float(np.float32(v)) for v in r.embedding] for r in df.filter("vec_id < 1000").collect()}

    def score(a, b):
        s = 0.0
        for x, y in zip(a, b):
            s += x * y
        return s

    expected = brute(rows, {i: v for i, v in rows.items() if i % 20 == 0}, 20, score)
    got = {}
    for r in A.nearest(valid_vectors(df), F.col("vec_id") % 20 == 0, factor=1.0, shard_rows=shard_rows, query_rows=query_rows).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == expected


def test_recall_at_the_default_factor():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(6000)
    tally = {}
    found = A.search_shard(ids[:100], x[:100], ids, x, 1.0, 20, A.FACTOR, tally=tally)
    score = x[:100] @ x.T
    score[np.arange(100), np.arange(100)] = -9
    best = np.argsort(-score, axis=1)[:, :20]
    own = found.groupby("query_id")["vec_id"].agg(set)
    assert np.mean([len(own[i] & set(best[i])) / 20 for i in range(100)]) >= 0.9
    assert tally["pairs"] == 600_000 and tally["compared"] < 0.97 * tally["pairs"]


def test_recall_of_the_query_over_several_shards(spark):
    """op6 as registered and in shards of 400 rows, on a whole table of embeddings."""
    folder = "/root/testdata/sf0.1"
    df = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    fine = {r.vec_id: np.array(r.embedding, dtype=float) for r in df if r.embedding is not None and np.isfinite(np.array(r.embedding, dtype=float)).all()}
    ids = np.array(sorted(fine))
    x = np.stack([fine[i] for i in ids])
    queries = [i for i in ids if i % 20 == 0]
    for got in (A.op6_ann(spark, folder), A.nearest(valid_vectors(spark.read.parquet(f"{folder}/embeddings.parquet")), F.col("vec_id") % 20 == 0, shard_rows=400, query_rows=60)):
        rows = {}
        for r in got.collect():
            assert abs(r.score - float(fine[r.query_id] @ fine[r.vec_id])) < 1e-9
            rows.setdefault(r.query_id, []).append((r.rank, r.vec_id))
        assert set(rows) == set(queries) and all(sorted(n for n, _ in v) == list(range(1, 21)) for v in rows.values())
        hits = 0
        for q in queries:
            score = x @ fine[q]
            score[ids == q] = -np.inf
            hits += len({v for _, v in rows[q]} & set(ids[np.argsort(-score, kind="stable")[:20]]))
        assert hits >= 0.9 * 20 * len(queries)


def test_partial_sums_leave_few_pairs():
    rng = np.random.default_rng(7)
    x = np.floor(256 * rng.normal(size=(4000, 64)) * np.linspace(1.5, 0.2, 64))
    rotation, ids, tally = np.linalg.eigh(x.T @ x)[1][:, ::-1], np.arange(4000), {}
    found = E.search_block(ids[:80], x[:80], ids, x, 5, rotation, np.full(80, -np.inf), step=500, tally=tally)
    score = (x[:80] @ x.T).astype(np.int64)
    score[np.arange(80), np.arange(80)] = -(1 << 62)
    for i, own in found.groupby("query_id"):
        assert set(zip(own["score"], own["vec_id"])) == {(score[i, j], j) for j in sorted(range(4000), key=lambda j: (-score[i, j], j))[:5]}
    assert tally["pairs"] == 320_000 and tally["scored"] < 0.3 * tally["pairs"]


@pytest.mark.parametrize("lengths", ["outlier of 4", "outlier of 10", "clusters and an outlier", "lognormal"])
def test_recall_where_lengths_differ(lengths):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 64))
    if lengths == "clusters and an outlier":
        x = x[rng.integers(50, size=6000)] + 0.5 * x
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if lengths == "lognormal":
        x *= rng.lognormal(0, 2, size=(6000, 1))
    else:
        x[3000] *= 10 if lengths == "outlier of 10" else 4
    ids = np.arange(6000)
    found = A.search_shard(ids[:100], x[:100], ids, x, float(np.linalg.norm(x, axis=1).max()), 20, A.FACTOR)
    score = x[:100] @ x.T
    score[np.arange(100), np.arange(100)] = -np.inf
    best = np.argsort(-score, axis=1)[:, :20]
    own = found.groupby("query_id")["vec_id"].agg(set)
    assert np.mean([len(own[i] & set(best[i])) / 20 for i in range(100)]) >= 0.9


def test_ids_beyond_doubles(spark):
    big = 1 << 60
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), *[(big + i, [1.0, 0.5], 0) for i in range(3)], (big + 1, [1.0, 0.5], 0), (big + 1, [0.5, 0.5], 0)], SCHEMA)
    want = [(1, big), (2, big + 1), (3, big + 2), (4, big + 1)]
    assert [(r["rank"], r.vec_id) for r in E.top_k(E.integer_vectors(df), F.col("vec_id") == 0).orderBy("rank").collect()] == want
    assert [(r["rank"], r.vec_id) for r in A.nearest(valid_vectors(df), F.col("vec_id") == 0).orderBy("rank").collect()] == want
