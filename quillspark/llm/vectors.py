"""What the vector searches share: valid rows, block grids, merging of top lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def valid_vectors(rows: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v (doubles) of the rows with an id and a vector whose components are all finite numbers."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col(vec_id).isNotNull() & v.isNotNull() & fine).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))


def matrix(column: pd.Series, width: int) -> np.ndarray:
    """Rows of a column of arrays, padded with zeros to width."""
    out = np.zeros((len(column), width))
    for i, x in enumerate(column):
        out[i, : len(x)] = x
    return out


def distinct(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both without repeats of id and row; ids are compared as 64-bit integers."""
    again = pd.Series(ids).duplicated(keep=False).to_numpy()
    if not again.any():
        return ids, rows
    keep = ~again
    keep[again] = ~pd.DataFrame(rows[again]).assign(id=ids[again]).duplicated().to_numpy()
    return ids[keep], rows[keep]


def grid(queries: DataFrame, rows: DataFrame, *, block: str, n_queries: int, per_group: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the keys (block, turn): every block of rows meets every hash group of at most about per_group queries.

    queries has the column block already, one row for each block it is to meet.
    """
    groups = max(1, -(-n_queries // per_group))
    turns = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    return queries.withColumn("turn", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")), rows.withColumn("turn", turns)


class Best:
    """The k best (score, id) of each query, ties to the smaller id; candidates come in blocks."""

    def __init__(self, n: int, k: int, kind=np.int64):
        self.k, self.query, self.score, self.id = k, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=kind), np.zeros(0, dtype=np.int64)
        self.least = np.full(n, -np.inf)  # a score below it can't enter

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(query):
            return
        q, s, i = np.concatenate([self.query, query]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.r_[True, q[1:] != q[:-1]]
        rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
        keep = rank < self.k
        self.query, self.score, self.id = q[keep], s[keep], i[keep]
        last = rank == self.k - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], s[last])


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows of each query."""
    at = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(at)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
