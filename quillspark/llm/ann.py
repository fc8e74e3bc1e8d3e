"""Approximate nearest neighbours by inner product: vantage-point trees per shard.

Rows are dealt into shards by hash, and those of a shard into bands of nearly equal length, longest first.
In a band every vector gets one more coordinate, sqrt(M^2 - |x|^2) with M the band's largest length, and
a query is stretched to length M and gets 0 there: the nearest by Euclidean distance is then the one of
largest inner product, so the triangle inequality holds, and no length outside the band bears on it. Each
band gets a vantage-point tree whose leaves hold some hundred vectors. For every query the path to a leaf
gives a lower bound of its distance; a leaf is skipped where ``factor`` times the bound exceeds the
distance of the query's k-th best so far, and a band where M times the query's length is below that k-th
best. Factor 1 skips only what can't matter, so its result is exact; larger factors skip more.

All rows are in a tree. A stated set of queries meets all shards in blocks; a shard hands on k rows a
query, scored anew on the original vectors by adding products in component order.

Defined cases: vectors null, zero or with null or non-finite components, and rows without an id, take no
part; shorter vectors count as padded with zeros; rows that repeat id and vector count once; where
queries share an id, the least vector in array order asks; a query is never its own candidate, by id;
ties go to the smaller id; no rows give an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import durable, table
from quillspark.llm.vectors import Best, distinct, grid, matrix, ranked, valid_vectors

FACTOR = 6.0
BAND = 1.1
LEAF = 128


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added in component order: the same for equal vectors wherever they lie."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


class VantageTree:
    """Median splits by distance to a vantage point; leaves are index arrays into the given points."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaves, self.nodes = points, [], []
        self.rng = np.random.default_rng(11)
        self.root = self._grow(np.arange(len(points)), leaf)

    def _distance(self, own: np.ndarray, vantage: int) -> np.ndarray:
        return np.sqrt(np.maximum(((self.points[own] - self.points[vantage]) ** 2).sum(axis=1), 0))

    def _grow(self, own: np.ndarray, leaf: int):
        if len(own) > leaf:
            start = own[self.rng.integers(len(own))]
            vantage = own[int(self._distance(own, start).argmax())]
            d = self._distance(own, vantage)
            near = d <= np.median(d)
            if not near.all():
                at = len(self.nodes)
                self.nodes.append(None)
                sides = [(d[side].min(), d[side].max(), self._grow(own[side], leaf)) for side in (near, ~near)]
                self.nodes[at] = (vantage, sides)
                return ("node", at)
        self.leaves.append(own)
        return ("leaf", len(self.leaves) - 1)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Lower bounds of the distances from queries (rows) to leaves (columns)."""
        out = np.zeros((len(queries), len(self.leaves)))
        square = (queries**2).sum(axis=1)

        def down(node, bound):
            kind, at = node
            if kind == "leaf":
                out[:, at] = bound
                return
            vantage, sides = self.nodes[at]
            v = self.points[vantage]
            d = np.sqrt(np.maximum(square + v @ v - 2 * queries @ v, 0))
            for low, high, child in sides:
                down(child, np.maximum(bound, np.maximum(low - d, d - high)))

        down(self.root, np.zeros(len(queries)))
        return out


def bands(length: np.ndarray, ratio: float = BAND) -> list[np.ndarray]:
    """Row numbers by length, longest first: a band's longest row is less than ratio times as long as its shortest, or as long."""
    order = np.argsort(-length, kind="stable")
    out, at = [], 0
    while at < len(order):
        end = max(at + 1, int(np.searchsorted(-length[order], -length[order[at]] / ratio)))
        out.append(order[at:end])
        at = end
    return out


def search_shard(q_ids, q, c_ids, c, top: float, k: int, factor: float, leaf: int = LEAF, first: int = 4, tally: dict | None = None) -> pd.DataFrame:
    """query_id, vec_id, score: each query's k nearest found in the shard. top: the largest length of all rows.

    tally, if given, is told the number of pairs, and of those that were compared.
    """
    c_ids, c = distinct(c_ids, c)
    length, q_length = np.sqrt((c**2).sum(axis=1)), np.sqrt((q**2).sum(axis=1))
    slack = 1e-9 * (q_length * top + 1)
    best, looked = Best(len(q), k, float), 0

    def look(own: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        score = q[own] @ c[members].T
        score[q_ids[own, None] == c_ids[None, members]] = -np.inf
        kth = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(own), -np.inf)
        i, j = np.nonzero((score >= (np.maximum(kth, best.least[own]) - slack[own])[:, None]) & np.isfinite(score))
        return own[i], dots(q[own[i]], c[members[j]]), c_ids[members[j]]

    for band in bands(length):
        m = length[band[0]]
        own = np.flatnonzero(q_length * m >= best.least - slack)  # for others no row of this length can do
        if not len(own):
            continue
        stretch = m / q_length[own]  # queries as long as the longest row: all lie on one sphere
        tree = VantageTree(np.column_stack([c[band], np.sqrt(np.maximum(m**2 - length[band] ** 2, 0))]), leaf)
        bound = tree.bounds(np.column_stack([q[own] * stretch[:, None], np.zeros(len(own))]))
        seat = bound.argsort(axis=1, kind="stable").argsort(axis=1)  # each query goes to its nearest leaves first, some at a time
        low, high = 0, first
        while low < len(tree.leaves):
            reach = np.sqrt(np.maximum(2 * m * m - 2 * stretch * (best.least[own] - slack[own]), 0))  # infinite until k are found
            due = (seat >= low) & (seat < high) & (factor * bound <= (reach + 1e-7 * m)[:, None])
            found = [look(own[due[:, n]], band[tree.leaves[n]]) for n in np.flatnonzero(due.any(axis=0))]
            looked += int(due.sum(axis=0) @ np.array([len(x) for x in tree.leaves]))
            if found:
                best.add(*(np.concatenate(x) for x in zip(*found)))
            low, high = high, high + max(first, (high - low) * 3 // 2)
    if tally is not None:
        tally["pairs"], tally["compared"] = tally.get("pairs", 0) + len(q) * len(c), tally.get("compared", 0) + looked
    return pd.DataFrame({"query_id": q_ids[best.query], "vec_id": best.id, "score": best.score})


def nearest(vectors: DataFrame, is_query, *, k: int = 20, factor: float = FACTOR, shard_rows: int = 16384, query_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score. vectors: vec_id, v (doubles); is_query: a column on vec_id."""
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = durable(vectors.withColumn("length", length).filter("length > 0"))
    n, width, top, asked = rows.agg(F.count("*"), F.max(F.size("v")), F.max("length"), F.count(F.when(is_query, 1))).first()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards = max(1, -(-n // shard_rows))
    placed = rows.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"))
    queries = rows.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    sent = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    left, right = grid(sent, placed, block="shard", n_queries=asked, per_group=query_rows)

    def search(key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        return search_shard(q["vec_id"].to_numpy(), matrix(q["v"], width), c["vec_id"].to_numpy(), matrix(c["v"], width), top, k, factor)

    found = left.groupBy("shard", "turn").cogroup(right.groupBy("shard", "turn")).applyInPandas(search, "query_id long, vec_id long, score double")
    return ranked(found, k)


def op6_ann(spark, sf_dir) -> DataFrame:
    return nearest(valid_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0)
