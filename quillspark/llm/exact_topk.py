"""Exact top-k by integer inner product over norm-sorted blocks.

Components become floor(256 x). Rows are cut into blocks by descending length. The block of the longest
vectors gives each query a first threshold, and a query only goes to blocks whose largest length can
still reach it (Cauchy-Schwarz). In a block, rows are processed by descending length; vectors are
rotated by the singular vectors of the whole table (from its Gram matrix, summed by grouped
aggregation), more and more leading coordinates give a partial sum and the rest is bounded by the product of
the residual lengths; a pair that can't reach the query's k-th best so far goes on no further. What the
bounds leave is scored exactly in integers.

A stated set of queries meets all rows, in blocks; each block hands on k rows a query. The driver holds
one block, the Gram matrix, and one number a block of rows.

Defined cases: vectors null or with null or non-finite components, and rows without an id, take no part;
shorter vectors count as padded with zeros; rows that repeat id and vector count once; where queries
share an id, the least vector in array order asks; a query is never its own candidate, by id; ties go
to the smaller id; no rows give an empty result; other columns are ignored. Scores must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import durable, small, table
from quillspark.llm.vectors import Best, distinct, grid, matrix, ranked, valid_vectors

#: Shares of the coordinates after which the bound is tried again.
HEADS = (0.25, 0.5, 0.75, 0.875)


def integer_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    return valid_vectors(rows).select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer a @ b.T of whole numbers held as doubles."""
    if not a.size or not b.size or np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return (whole(a) @ whole(b).T).astype(np.int64)


def pair_products(a: np.ndarray, b: np.ndarray, at_once: int = 1 << 16) -> np.ndarray:
    """Exact integer inner products of the rows of a with those of b, pair by pair."""
    if not a.size or np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53:
        return np.concatenate([np.einsum("ij,ij->i", a[i : i + at_once], b[i : i + at_once]).astype(np.int64) for i in range(0, max(1, len(a)), at_once)])
    return np.array([sum(int(x) * int(y) for x, y in zip(u, v)) for u, v in zip(a, b)], dtype=np.int64)


def search_block(q_ids, q, c_ids, c, k: int, rotation: np.ndarray, least: np.ndarray, step: int = 1024, tally: dict | None = None) -> pd.DataFrame:
    """query_id, vec_id, score: each query's k best of the block; below ``least`` nothing need be found.

    tally, if given, is told the number of pairs, and of those that were scored in full.
    """
    c_ids, c = distinct(c_ids, c)
    length = np.sqrt((c**2).sum(axis=1))
    order = np.lexsort((c_ids, -length))
    c_ids, c, length = c_ids[order], c[order], length[order]
    qr, cr, q_length = q @ rotation, c @ rotation, np.sqrt((q**2).sum(axis=1))
    heads = sorted({max(1, int(c.shape[1] * share)) for share in HEADS}) if c.shape[1] else []
    rest = lambda x, n: np.sqrt(np.maximum(n[:, None] ** 2 - np.cumsum(x**2, axis=1)[:, [h - 1 for h in heads]], 0))
    q_rest, c_rest = rest(qr, q_length), rest(cr, length)
    best = Best(len(q), k)
    best.least = least.copy()
    for at in range(0, len(c), step):
        cols = np.arange(at, min(at + step, len(c)))
        slack = 1e-9 * q_length * length[at] + 1e-6
        rows = np.flatnonzero(q_length * length[at] + slack >= best.least)  # rows are by descending length: the others are done
        if not len(rows):
            break
        open_, partial, done = q_ids[rows, None] != c_ids[None, cols], np.zeros((len(rows), len(cols))), 0
        for n, head in enumerate(heads):  # partial sums over more and more coordinates, on the pairs still open
            partial += qr[rows, done:head] @ cr[cols, done:head].T
            open_ &= partial + q_rest[rows, n, None] * c_rest[None, cols, n] >= (best.least - slack)[rows, None]
            r, l, done = open_.any(axis=1), open_.any(axis=0), head
            if not (r.all() and l.all()):
                rows, cols, open_, partial = rows[r], cols[l], open_[np.ix_(r, l)], partial[np.ix_(r, l)]
        if tally is not None:
            tally["scored"] = tally.get("scored", 0) + int(open_.sum())
        if not len(rows):
            continue
        if open_.mean() < 0.2:
            i, j = np.nonzero(open_)
            score = pair_products(q[rows[i]], c[cols[j]])
            good = score >= best.least[rows[i]]
            best.add(rows[i][good], score[good], c_ids[cols[j]][good])
            continue
        score = products(q[rows], c[cols])
        worth = np.where(open_, score.astype(float), -np.inf)
        kth = np.partition(worth, -k, axis=1)[:, -k] if worth.shape[1] >= k else np.full(len(rows), -np.inf)
        i, j = np.nonzero(open_ & (worth >= np.maximum(kth, best.least[rows])[:, None]))
        best.add(rows[i], score[i, j], c_ids[cols[j]])
    if tally is not None:
        tally["pairs"] = tally.get("pairs", 0) + len(q) * len(c)
    return pd.DataFrame({"query_id": q_ids[best.query], "vec_id": best.id, "score": best.score})


def top_k(vectors: DataFrame, is_query, *, k: int = 5, block_rows: int = 16384, query_rows: int = 4096, most_bands: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score. vectors: vec_id, v (whole numbers); is_query: a column on vec_id."""
    spark = vectors.sparkSession
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = durable(vectors.withColumn("length", F.sqrt(squares)))
    n, width, asked = rows.agg(F.count("*"), F.max(F.size("v")), F.count(F.when(is_query, 1))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for pdf in batches:
            x = matrix(pdf["v"], width)
            total += x.T @ x
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": total.ravel()})

    rotation = np.zeros((width, width))
    for r in rows.select("v").mapInPandas(gram, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        rotation[r.i, r.j] = r.s
    rotation = np.linalg.eigh(rotation)[1][:, ::-1] if width else rotation

    # bands by descending length, of a block each or more; bands of more rows, and equal lengths, are dealt out by hash
    cuts = min(most_bands, max(1, -(-n // block_rows)))
    bounds = np.array(sorted(set(rows.agg(F.percentile_approx("length", [i / cuts for i in range(1, cuts)], 10000)).first()[0] or [])) if cuts > 1 else [])
    band_of = F.pandas_udf(lambda length: pd.Series(len(bounds) - np.searchsorted(bounds, length.to_numpy(), side="left")), "int")
    banded = durable(rows.withColumn("band", band_of("length")))
    sizes = {r.band: (r.n, r.top) for r in banded.groupBy("band").agg(F.count("*").alias("n"), F.max("length").alias("top")).collect()}
    tops, number = [], {}
    for b in sorted(sizes):
        number[b] = (len(tops), max(1, round(sizes[b][0] / block_rows)))
        tops += [sizes[b][1]] * number[b][1]
    of = small(spark, [(b, *number[b]) for b in number], "band int, base int, chunks int")
    placed = durable(banded.join(of, "band").select("vec_id", "v", "length", (F.col("base") + F.pmod(F.xxhash64("vec_id", "v"), F.col("chunks"))).cast("int").alias("block")))
    queries = placed.filter(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "length")).alias("q")).select("vec_id", "q.v", "q.length")
    longest = placed.filter("block = 0").select("vec_id", "v").toPandas()  # one block: about block_rows rows
    shared = spark.sparkContext.broadcast((longest["vec_id"].to_numpy(), matrix(longest["v"], width), np.array(tops)))

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        l_ids, l_rows, tops = shared.value
        for whole in filter(len, batches):
            for pdf in np.array_split(np.arange(len(whole)), len(whole) // query_rows + 1):
                pdf = whole.iloc[pdf]
                q, ids, size = matrix(pdf["v"], width), pdf["vec_id"].to_numpy(), pdf["length"].to_numpy()
                found = search_block(ids, q, l_ids, l_rows, k, rotation, np.full(len(q), -np.inf))
                kth = found.groupby("query_id")["score"].agg(["min", "size"])
                least = kth["min"].where(kth["size"] == k).reindex(ids).to_numpy(dtype=float)
                least = np.where(np.isnan(least), -np.inf, least)
                last = (size[:, None] * tops[None, :] * (1 + 1e-9) + 1e-6 >= least[:, None]).sum(axis=1) - 1  # lengths fall from block to block
                yield pdf.assign(least=least, last=last)

    started = durable(queries.mapInPandas(first, "vec_id long, v array<bigint>, length double, least double, last int"))
    sent = started.filter("last >= 0").select("vec_id", "v", "least", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("block"))
    left, right = grid(sent, placed.select("vec_id", "v", "block"), block="block", n_queries=asked, per_group=query_rows)

    def search(key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        return search_block(q["vec_id"].to_numpy(), matrix(q["v"], width), c["vec_id"].to_numpy(), matrix(c["v"], width), k, rotation, q["least"].to_numpy())

    found = left.groupBy("block", "turn").cogroup(right.groupBy("block", "turn")).applyInPandas(search, "query_id long, vec_id long, score long")
    return ranked(found, k)


def op3_exact_topk(spark, sf_dir) -> DataFrame:
    return top_k(integer_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


OP3_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
) WHERE rank <= 5
"""
