"""SimHash near-duplicates, linked exactly through vantage-point trees.

A fingerprint has 64 bits; a bit is set where over half of the hashes of the text's 4-word shingles
have it (ASCII lower case, XXH64 with seed 42). Fingerprints at ``radius`` differing bits or fewer
are linked, and links are followed to whole components.

1. Equal fingerprints become one vertex. 2. A vantage-point tree over a bounded sample of them is
built on the driver and cuts Hamming space into shards; each fingerprint has one home shard, and
visits those later shards whose border lies within the radius, by the triangle inequality. 3. In a
shard a local tree of the same kind prunes what needn't be compared; the pairs left are compared
exactly. A shard hands on a spanning forest of its links, never all pairs. Shards with many homes or
visitors are cut into a grid of hash groups, so a task's rows are bounded whatever the data. 4. The
components of all forests together are found by contraction.

Ids are whole numbers. Defined cases: null or blank text has fingerprint zero, linked like any other; a text of fewer than
four words is one shingle; very long texts are hashed whole, some thousand shingles at a time; repeated rows come out once each, with the same component; rows with a null
doc_id make no links, but get the component of their fingerprint where another row has it; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import durable, pieces, table
from quillspark.llm.components import components

SHINGLE, SEED, RADIUS = 4, 42, 4


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64 bits."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined, length = b" ".join(words), np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(length + 1) - 1
    starts, digest = ends - length, xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(joined, SEED)
    n, votes = len(words) - shingle + 1, np.zeros(64, dtype=np.int64)
    for k in range(0, n, 65536):  # a long text's bits aren't held all at once
        upto = min(n, k + 65536)
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[k:upto].tolist(), ends[k + shingle - 1 : upto + shingle - 1].tolist())]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            prints = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, fp long")


class Shards:
    """A vantage-point tree over a sample, whose leaves are the shards."""

    def __init__(self, sample: np.ndarray, depth: int, radius: int):
        self.radius, self.leaves = radius, 0
        self.root = self._grow(sample, depth, np.random.default_rng(5))

    def _grow(self, own: np.ndarray, depth: int, rng):
        if depth > 0 and len(own) >= 8:
            tries = rng.choice(own, size=min(16, len(own)), replace=False)
            far = [np.bitwise_count(own ^ v) for v in tries]
            best = max(range(len(tries)), key=lambda i: far[i].std())
            middle = int(np.median(far[best]))
            near = far[best] <= middle
            if 0 < near.sum() < len(own):
                return tries[best], middle, self._grow(own[near], depth - 1, rng), self._grow(own[~near], depth - 1, rng)
        self.leaves += 1
        return self.leaves - 1

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions in fps, shards, and whether the shard is the home: each fingerprint's home, and the later shards its ball reaches."""
        home, found = np.zeros(len(fps), dtype=np.int64), []

        def down(node, at, inside):
            if isinstance(node, int):
                home[at[inside]] = node
                found.append((at, np.full(len(at), node), inside))
                return
            vantage, middle, near, far = node
            d = np.bitwise_count(fps[at] ^ vantage).astype(np.int64)
            for child, reach, own in ((near, d - self.radius <= middle, d <= middle), (far, d + self.radius > middle, d > middle)):
                if reach.any():
                    down(child, at[reach], (inside & own)[reach])

        down(self.root, np.arange(len(fps)), np.ones(len(fps), dtype=bool))
        at, shard, inside = (np.concatenate(x) for x in zip(*found))
        keep = inside | (shard > home[at])
        return at[keep], shard[keep], inside[keep]


class Forest:
    """Union-find over 0..n-1, united by arrays of pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def link_shard(fps: np.ndarray, build: np.ndarray, probe: np.ndarray, radius: int, leaf: int = 256) -> np.ndarray:
    """Roots: for each position the smallest position it is linked to through pairs of (build, probe) positions within radius."""
    forest = Forest(len(fps))

    def compare(b, p):
        step = max(1, (1 << 20) // max(1, len(b)))
        for k in range(0, len(p), step):
            i, j = np.nonzero(np.bitwise_count(fps[p[k : k + step]][:, None] ^ fps[b][None, :]) <= radius)
            forest.unite(p[k + i], b[j])

    stack = [(build, probe, 0)]
    while stack:
        b, p, depth = stack.pop()
        if not len(b) or not len(p):
            continue
        if len(b) > leaf and depth < 24:
            vantage = fps[b[(7919 * (depth + 1)) % len(b)]]
            db, dp = (np.bitwise_count(fps[x] ^ vantage).astype(np.int64) for x in (b, p))
            middle = int(np.median(db))
            near, in_near, in_far = db <= middle, dp - radius <= middle, dp + radius > middle
            if not near.all() and in_near.sum() * near.sum() + in_far.sum() * (~near).sum() < 0.95 * len(b) * len(p):
                stack += [(b[near], p[in_near], depth + 1), (b[~near], p[in_far], depth + 1)]
                continue
        compare(b, p)
    return forest.root


def links(vertices: DataFrame, *, radius: int = RADIUS, shard_rows: int = 32768, most_build: int = 65536, most_probe: int = 262144, sample: int = 4096, most_depth: int = 10) -> DataFrame:
    """Edges (a, b) that connect all ids of vertices (fp, id) whose fingerprints differ in radius bits or fewer."""
    n = vertices.count()
    depth = min(most_depth, max(0, int(np.ceil(np.log2(max(1, n / shard_rows))))))
    rows = vertices.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).collect() if depth else []
    shards = Shards(np.array([r.fp for r in rows], dtype=np.int64).view(np.uint64), depth, radius)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filter(len, batches):
            _, shard, inside = shards.route(pdf["fp"].to_numpy().view(np.uint64))
            yield pd.DataFrame({"shard": shard, "home": inside.astype(np.int64)}).groupby("shard")["home"].agg(["sum", "size"]).reset_index().set_axis(["shard", "homes", "rows"], axis=1)

    sizes = vertices.select("fp").mapInPandas(count, "shard long, homes long, rows long").groupBy("shard").agg(F.sum("homes").alias("homes"), F.sum("rows").alias("rows")).collect()
    grid = np.ones((shards.leaves, 2), dtype=np.int64)  # groups of builds and of probes in each shard
    for r in sizes:
        grid[r.shard] = max(1, -(-r.homes // most_build)), max(1, -(-r.rows // most_probe))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filter(len, batches):
            fps, ids = pdf["fp"].to_numpy(), pdf["id"].to_numpy()
            at, shard, inside = shards.route(fps.view(np.uint64))
            mixed = fps[at].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            b, p = ((mixed % grid[shard, k].astype(np.uint64)).astype(np.int64) for k in (0, 1))
            out = []
            for role in (1, 2):  # 1: what is searched (homes only), 2: what searches
                own = np.flatnonzero(inside) if role == 1 else np.arange(len(at))
                times = grid[shard[own], 1 if role == 1 else 0]
                again = np.repeat(own, times)
                turn = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
                mine, other = (b, turn) if role == 1 else (turn, p)
                out.append(pd.DataFrame({"shard": shard[again], "b": mine[again] if role == 1 else mine, "p": other if role == 1 else other[again], "role": role, "fp": fps[at[again]], "id": ids[at[again]]}))
            yield pd.concat(out).groupby(["shard", "b", "p", "fp", "id"], as_index=False, sort=False)["role"].sum()

    def join(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        role, ids = pdf["role"].to_numpy(), pdf["id"].to_numpy()
        root = link_shard(pdf["fp"].to_numpy().view(np.uint64), np.flatnonzero(role & 1), np.flatnonzero(role & 2), radius)
        moved = root != np.arange(len(root))
        return pd.DataFrame({"a": ids[moved], "b": ids[root[moved]]})

    dealt = vertices.mapInPandas(deal, "shard long, b long, p long, fp long, id long, role long")
    return dealt.groupBy("shard", "b", "p").applyInPandas(join, "a long, b long")


def near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id, one row per row of docs."""
    prints = durable(fingerprints(docs, text=text, doc_id=doc_id, shingle=shingle), texts=True)
    vertices = durable(prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")))
    found = components(links(vertices, radius=radius))
    placed = vertices.join(found, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return prints.join(placed, "fp", "left").select("doc_id", "fp", "component_id")


def op2_simhash(spark, sf_dir) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
