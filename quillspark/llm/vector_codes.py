"""Product codes of vectors: codebooks by Lloyd's rounds over cover trees.

Components become floor(4096 x), vectors are cut into ``parts`` equal parts, and each part position has a codebook of
``entries`` entries. Rows are cut into blocks where they lie. In a block each part position gets a cover tree once: a
node holds the points within its radius, its children cover it with half that radius, and its points lie together,
so that their sum is a difference of two cumulative sums. In every round a node whose nearest entry is nearer, by the
triangle inequality, than any other to all its points gives its sum and number to that entry at once; only
ambiguous nodes go on to their children, and the points of ambiguous leaves are compared exactly, in integers. What
leaves a block is one sum for each entry and component, whatever its rows.

The blocks with their trees are a table; a round reads it once, and the driver holds the codebooks alone
(entries times the width of a vector). All sums are of integers, so the order in which they are added doesn't matter.

Defined cases: vectors null or with null or non-finite components are dropped; shorter vectors count as padded with
zeros, as does a width that ``parts`` doesn't divide; rows that repeat an id or all columns are rows of their own, but an
id gives one first entry, its least vector in array order; rows without an id are coded, but are no first entries; with fewer
ids than entries the codebooks are as much smaller; equal distances go to the lower index; null labels are one label;
no rows give an empty result; other columns, whatever their names, are ignored. Components whose squared distances
could pass 64 bits are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import counted, durable, expand, squeeze, table

SCALE, PARTS, ENTRIES, ROUNDS, BLOCK_ROWS, LEAF = 4096, 8, 16, 6, 8192, 48
_NODE = ("<u4", "<u4", "<u4", "<u4", "<u4", "<f8")


class CoverTree:
    """points: in tree order; begin, end (of a node's points), centre (a point), child, children (the nodes below), radius."""

    def __init__(self, points: np.ndarray, nodes: list[np.ndarray]):
        self.points = points
        self.begin, self.end, self.centre, self.child, self.children, self.radius = (x if x.dtype.kind == "f" else x.astype(np.int64) for x in nodes)
        self.sums = np.zeros((len(points) + 1, points.shape[1]), dtype=np.int64)
        np.cumsum(points, axis=0, out=self.sums[1:])

    @classmethod
    def grow(cls, points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, CoverTree]:
        """(order, tree): the tree's point k is the given point order[k]."""
        order = np.zeros(len(points), dtype=np.int64)
        queue, nodes, at = [(np.arange(len(points)), 0)], [], 0
        while at < len(queue):
            own, begin = queue[at]
            at += 1
            d = np.sqrt(((points[own] - points[own[0]]) ** 2).sum(axis=1).astype(float))
            radius = float(d.max())
            node = [begin, begin + len(own), own[0], 0, 0, radius]
            nodes.append(node)
            if len(own) <= leaf or radius == 0:
                order[begin : begin + len(own)] = own
                continue
            node[3] = len(queue)
            while len(own):  # its first point covers what it can, then the first of the others does
                if not node[4]:
                    near = d <= radius / 2
                else:
                    near = ((points[own] - points[own[0]]) ** 2).sum(axis=1) <= radius * radius / 4
                queue.append((own[near], begin))
                begin += int(near.sum())
                own = own[~near]
                node[4] += 1
        place = np.empty(len(points), dtype=np.int64)
        place[order] = np.arange(len(points))
        columns = [np.array(x) for x in zip(*nodes)]
        columns[2] = place[columns[2]]
        return order, cls(points[order], columns)

    def settle(self, entries: np.ndarray, tally: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(begins, ends, entry of runs of points that go to one entry as a whole; points that are left). tally, if given, is told the points and those left."""
        front, begins, ends, to, left = np.zeros(1, dtype=np.int64), [], [], [], []
        while len(front):
            square = ((self.points[self.centre[front]][:, None] - entries[None]) ** 2).sum(axis=2)
            nearest, rows = square.argmin(axis=1), np.arange(len(front))
            d = np.sqrt(square.astype(float))
            best = d[rows, nearest]
            d[rows, nearest] = np.inf
            sure = (self.radius[front] == 0) | ((best + 2 * self.radius[front]) * (1 + 1e-9) < d.min(axis=1))
            begins.append(self.begin[front[sure]])
            ends.append(self.end[front[sure]])
            to.append(nearest[sure])
            open_ = front[~sure]
            last = self.children[open_] == 0
            left.append(_ranges(self.begin[open_[last]], self.end[open_[last]]))
            inner = open_[~last]
            front = _ranges(self.child[inner], self.child[inner] + self.children[inner])
        left = np.concatenate(left)
        if tally is not None:
            tally["points"], tally["compared"] = tally.get("points", 0) + len(self.points), tally.get("compared", 0) + len(left)
        return np.concatenate(begins), np.concatenate(ends), np.concatenate(to), left

    def totals(self, entries: np.ndarray, tally: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(sum, number) of the points nearest to each entry."""
        begins, ends, to, left = self.settle(entries, tally)
        sums, counts = np.zeros_like(entries), np.zeros(len(entries), dtype=np.int64)
        np.add.at(sums, to, self.sums[ends] - self.sums[begins])
        np.add.at(counts, to, ends - begins)
        own = self._compared(left, entries)
        np.add.at(sums, own, self.points[left])
        return sums, counts + np.bincount(own, minlength=len(entries))

    def codes(self, entries: np.ndarray) -> np.ndarray:
        """The nearest entry of each point."""
        begins, ends, to, left = self.settle(entries)
        out = np.zeros(len(self.points), dtype=np.int64)
        out[_ranges(begins, ends)] = np.repeat(to, ends - begins)
        out[left] = self._compared(left, entries)
        return out

    def _compared(self, points: np.ndarray, entries: np.ndarray) -> np.ndarray:
        return ((self.points[points][:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)


def _ranges(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    sizes = ends - begins
    return np.repeat(begins - np.r_[0, np.cumsum(sizes)[:-1]][: len(sizes)], sizes) + np.arange(sizes.sum())


def integer_rows(rows: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """vec_id, label, v (whole numbers) of the rows whose vector is made of finite numbers."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(v.isNotNull() & fine).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.transform(v, lambda x: F.floor(x * scale)).alias("v"))


def _planted(width: int, parts: int, block_rows: int):
    """Rows (vec_id, label, v) to blocks: vec_id, label, orders, points, nodes (a tree for each part)."""

    def block(ids: list, labels: list, vectors: list) -> dict:
        x = np.zeros((len(vectors), width), dtype=np.int64)
        for i, v in enumerate(vectors):
            x[i, : len(v)] = v
        out = {"vec_id": ids, "label": labels, "orders": [], "points": [], "n_nodes": [], "nodes": []}
        for part in np.split(x, parts, axis=1):
            order, tree = CoverTree.grow(np.ascontiguousarray(part))
            nodes = [tree.begin, tree.end, tree.centre, tree.child, tree.children, tree.radius]
            out["orders"].append(squeeze(order.astype(np.uint32)))
            out["points"].append(squeeze(tree.points.reshape(-1)))
            out["n_nodes"].append(len(tree.begin))
            out["nodes"].append(squeeze(*(a.astype(kind) for a, kind in zip(nodes, _NODE))))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, labels, vectors = [], [], []
        for pdf in batches:
            ids += [None if pd.isna(i) else int(i) for i in pdf["vec_id"]]
            labels += [None if pd.isna(x) else x for x in pdf["label"]]
            vectors += list(pdf["v"])
            while len(ids) >= block_rows:
                yield pd.DataFrame([block(ids[:block_rows], labels[:block_rows], vectors[:block_rows])])
                ids, labels, vectors = ids[block_rows:], labels[block_rows:], vectors[block_rows:]
        if ids:
            yield pd.DataFrame([block(ids, labels, vectors)])

    return run


def _trees(row, size: int) -> Iterator[CoverTree]:
    for points, n, nodes in zip(row.points, row.n_nodes, row.nodes):
        yield CoverTree(expand(points, row.n_rows * size, "<i8")[0].reshape(row.n_rows, size), expand(nodes, n, *_NODE))


def compress(rows: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error of every row; the codebooks: part, entry, component). rows: vec_id, label, v (whole numbers)."""
    spark, kind = rows.sparkSession, rows.schema["label"].dataType.simpleString()
    n, width, largest = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if not n:
        return spark.createDataFrame([], f"vec_id long, label {kind}, code string, error long"), np.zeros((parts, 0, 0), dtype=np.int64)
    size = -(-width // parts)
    if size * parts * 4 * (largest or 0) ** 2 >= 1 << 63:
        raise ValueError(f"squared distances of components up to {largest} pass 64 bits")
    first = [r[0] for r in rows.filter("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    books = np.zeros((len(first), parts * size), dtype=np.int64)
    for r in rows.filter(F.col("vec_id").isin(first)).groupBy("vec_id").agg(F.min("v").alias("v")).collect():
        books[first.index(r.vec_id), : len(r.v)] = r.v
    if not first:  # no row has an id
        books = np.zeros((1, parts * size), dtype=np.int64)
    books = np.stack(np.split(books, parts, axis=1))
    planted = rows.mapInPandas(_planted(parts * size, parts, block_rows), f"vec_id array<long>, label array<{kind}>, orders array<binary>, points array<binary>, n_nodes array<int>, nodes array<binary>")
    blocks = durable(planted.withColumn("n_rows", F.size("vec_id")))

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)

        def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, number = np.zeros_like(shared.value), np.zeros(shared.value.shape[:2], dtype=np.int64)  # noqa: B023
            for pdf in batches:
                for row in pdf.itertuples():
                    for k, tree in enumerate(_trees(row, size)):
                        sums, counts = tree.totals(shared.value[k])  # noqa: B023
                        total[k] += sums
                        number[k] += counts
            part, entry = np.nonzero(number)
            yield pd.DataFrame({"part": part, "entry": entry, "n": number[part, entry], "sums": pd.Series(list(total[part, entry]), dtype=object)})

        told = blocks.select("n_rows", "points", "n_nodes", "nodes").mapInPandas(gather, "part int, entry int, n long, sums array<long>")
        summed = told.select("part", "entry", "n", F.posexplode("sums").alias("at", "s")).groupBy("part", "entry", "at").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        books = books.copy()
        for r in summed.collect():  # a row for each component of the codebooks
            books[r.part, r.entry, r.at] = r.s // r.n
    shared = spark.sparkContext.broadcast(books)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                codes, error = np.zeros((row.n_rows, parts), dtype=np.uint8), np.zeros(row.n_rows, dtype=np.int64)
                for k, (tree, order) in enumerate(zip(_trees(row, size), row.orders)):
                    order, own = expand(order, row.n_rows, "<u4")[0], tree.codes(shared.value[k])
                    codes[order, k] = own
                    error[order] += ((tree.points - shared.value[k][own]) ** 2).sum(axis=1)
                label = row.label if isinstance(row.label, list) else list(row.label)
                yield pd.DataFrame({"vec_id": pd.array(_nullable(row.vec_id), dtype="Int64"), "label": pd.Series(_nullable(label), dtype=object), "code": [bytes(c).hex() for c in codes], "error": error})

    return blocks.select("vec_id", "label", "n_rows", "orders", "points", "n_nodes", "nodes").mapInPandas(finish, f"vec_id long, label {kind}, code string, error long"), books


def _nullable(values) -> list:
    return [None if pd.isna(x) else x for x in values]


def vector_codes(vectors: DataFrame, *, label: str = "label", **how) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (over equal labels), codebooks_sha256."""
    found, books = compress(integer_rows(vectors, label=label), **how)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = durable(found)
    by_label = counted(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), 100_000)
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_vector_codes(spark, sf_dir) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    floored = "(s - ((s % n) + n) % n) // n"
    assign = "SELECT p.id, p.part, p.v, min(CAST(p.q - 2 * list_inner_product(p.v, c.v) + list_inner_product(c.v, c.v) AS BIGINT) * 16 + c.entry) AS best FROM p JOIN c{k} c USING (part) GROUP BY p.id, p.part, p.v"
    text = """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, vec_id, label, [floor(4096 * x::DOUBLE) for x in embedding] AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), p AS MATERIALIZED (
  SELECT id, part, v, list_inner_product(v, v) AS q FROM (SELECT id, part, w[part * (len(w) // 8) + 1:(part + 1) * (len(w) // 8)] AS v FROM kept, (SELECT unnest(range(8)) AS part))
), c0 AS MATERIALIZED (SELECT part, id AS entry, v FROM p WHERE id < 16)"""
    for k in range(ROUNDS):
        text += f""", a{k} AS MATERIALIZED ({assign.format(k=k)}), s{k} AS (
  SELECT part, best % 16 AS entry, pos, sum(x::BIGINT)::HUGEINT AS s, count(*) AS n FROM (SELECT part, best, unnest(v) AS x, unnest(range(len(v))) AS pos FROM a{k}) GROUP BY ALL
), c{k + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(u.v, c.v) AS v FROM c{k} c LEFT JOIN (SELECT part, entry, list(({floored})::DOUBLE ORDER BY pos) AS v FROM s{k} GROUP BY ALL) u ON u.part = c.part AND u.entry = c.entry
)"""
    return text + f""", f AS ({assign.format(k=ROUNDS)}),
coded AS (SELECT id, string_agg(printf('%02x', best % 16), '' ORDER BY part) AS code, sum(best // 16)::BIGINT AS error FROM f GROUP BY id),
book AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS pos FROM c{ROUNDS}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (id), book
"""


OP13_SQL = _sql()
