"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Every source's target is a number of words. Blocks of ``block_words`` words, or of a quarter of the smallest
positive target where that is less (one word at least), are allocated to the
sources by highest quotients target / (2 seats + 1); a source's quota is then allocated in the same
way to its shards (groups of about ``shard_docs`` documents by a hash of id and text), giving each an integer number of
blocks. Inside a shard the documents lie in a seeded order on one line of words, cut into equal
blocks; the shard takes every block as often as its quota holds the whole line, and once more the
first blocks up to the quota. So at most one document of a shard is taken in part.

Only one row per source and per shard reaches the driver: sources are assumed to be a bounded
vocabulary (names of collections), shards are at most ``max_shards`` a source.

Defined cases: null text has size 0; a null source is a source of its own, ordered last; a source
without words has target 0; documents without words take 0; repeated rows count and take each for
themselves; a very long text is one document, and takes at most three times its size; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import WORD, durable, fresh, small, table, word_count

#: Base weights, repeated over the ordered sources.
WEIGHTS = (1, 2, 3)


def capped_targets(sizes: Sequence[float], weights: Sequence[float], total: float, most: float = 3.0) -> list[float]:
    """Share total by weight, none above most times its size; the excess is shared again by weight among the rest."""
    targets, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    rest = float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if rest * weights[i] / w > most * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = rest * weights[i] / w
            break
        for i in over:
            targets[i] = most * sizes[i]
        rest -= sum(targets[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def sainte_lague(weights: Sequence[float], seats: int, caps: Sequence[int] | None = None) -> list[int]:
    """Integer seats by highest quotients w / (2 s + 1), ties to the earlier entry; no entry above its cap.

    The bulk is found through the equivalent divisor form, round(w / divisor), by bisection; the last
    seats go by quotient. Fewer seats are given where all caps are reached.
    """
    w = np.asarray(weights, dtype=float)
    most = np.asarray(caps if caps is not None else np.full(len(w), seats), dtype=float)
    if not len(w) or seats <= 0 or w.max() <= 0:
        return [0] * len(w)
    seats = int(min(seats, most[w > 0].sum()))

    def given(divisor: float) -> np.ndarray:
        return np.minimum(np.floor(w / divisor + 0.5), most)

    low, high = w[w > 0].min() / (2.0 * seats + 2), 2.0 * w.sum() + 1  # too many seats, none
    for _ in range(200):
        mid = math.sqrt(low * high)
        low, high = (low, mid) if given(mid).sum() <= seats else (mid, high)
    got = given(high).astype(np.int64)
    queue = [(-w[i] / (2 * got[i] + 1), i) for i in range(len(w)) if w[i] > 0 and got[i] < most[i]]
    heapq.heapify(queue)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(queue)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(queue, (-w[i] / (2 * got[i] + 1), i))
    return [int(x) for x in got]


def _source_key(column: str):
    return F.when(F.col(column).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(column).cast("string")))


def plan(docs: DataFrame, *, text: str = "text", source: str = "source", doc_id: str = "doc_id", block_words: int = 128, shard_docs: int = 2000, max_shards: int = 16384, seed: int = 17, weights: Sequence[float] = WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """(documents, shards). documents: doc_id, skey, shard, place (the seeded order), size, source_size, target, taken.
    shards: skey, shards, shard, passes (whole takes), edge (documents at a smaller place are taken once more)."""
    spark = docs.sparkSession
    base = durable(
        docs.select(
            F.col(doc_id).alias("doc_id"), _source_key(source).alias("skey"), word_count(F.col(text)).alias("size"),
            F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)).alias("place"),
        )
    )
    sums = sorted(((r.skey, r.n, r.words) for r in base.groupBy("skey").agg(F.count("*").alias("n"), F.sum("size").alias("words")).collect()), key=lambda r: (r[0][0] == "n", r[0]))
    total = sum(r[2] for r in sums)
    targets = capped_targets([r[2] for r in sums], [weights[i % len(weights)] for i in range(len(sums))], total)
    least = min((t for t in targets if t > 0), default=0)
    block_words = max(1, min(block_words, int(least / 4)))  # the smallest source has some blocks of its own
    quotas = sainte_lague(targets, round(total / block_words), [math.ceil(3 * r[2] / block_words) for r in sums])
    per_source = {key: (target, quota, words, min(max_shards, max(1, -(-n // shard_docs)))) for (key, n, words), target, quota in zip(sums, targets, quotas)}
    by_key = small(spark, [(k, v[3], v[2], float(v[0])) for k, v in per_source.items()], "skey string, shards int, source_size long, target double")
    sharded = base.join(by_key, "skey").withColumn("shard", F.pmod("place", F.col("shards")).cast("int"))
    by_source: dict[str, list[tuple[int, int]]] = {}
    for r in sharded.groupBy("skey", "shard").agg(F.sum("size").alias("words")).collect():
        by_source.setdefault(r.skey, []).append((r.shard, r.words))
    rows = []
    for key, own in by_source.items():
        own.sort()
        got = sainte_lague([w for _, w in own], per_source[key][1], [math.ceil(3 * w / block_words) for _, w in own])
        for (shard, words), q in zip(own, got):
            taken = min(q * block_words, 3 * words)
            rows.append((key, per_source[key][3], shard, taken // words if words else 0, taken % words if words else 0))
    quota = small(spark, rows, "skey string, shards int, shard int, passes long, rest long")
    line = Window.partitionBy("skey", "shard").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        sharded.join(quota.drop("shards"), ["skey", "shard"])
        .withColumn("start", F.coalesce(F.sum("size").over(line), F.lit(0)))
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start"))))
        .withColumn("taken", F.col("passes") * F.col("size") + F.col("part"))
    )
    edges = placed.groupBy("skey", "shard").agg(F.min(F.when((F.col("size") > 0) & (F.col("part") * 2 < F.col("size")), F.col("place"))).alias("edge"))
    shards = quota.join(edges, ["skey", "shard"], "left").select("skey", "shards", "shard", "passes", F.coalesce("edge", F.lit((1 << 63) - 1)).alias("edge"))
    return placed.select("doc_id", "skey", "shard", "place", "size", "source_size", "target", "taken"), shards


def apply_mix(docs: DataFrame, shards: DataFrame, *, source: str = "source", doc_id: str = "doc_id", text: str = "text", seed: int = 17) -> DataFrame:
    """The documents that the mix takes, each row as often as it is taken; the one document that a shard takes
    in part is rounded to whole copies. Rows don't move: a document finds its number of copies from its place."""
    names = docs.columns
    spark = docs.sparkSession
    rows = shards.collect()  # one row a shard, as in plan(); made a table of known size
    skey, place, shard, n, passes, edge, copy = fresh(docs, "skey", "place", "shard", "shards", "passes", "edge", "copy")
    info = small(spark, [(r.skey, r.shard, r.passes, r.edge) for r in rows], f"{skey} string, {shard} int, {passes} long, {edge} long")
    counts = small(spark, sorted({(r.skey, r.shards) for r in rows}), f"{skey} string, {n} int")
    worded = docs.filter(F.col(text).rlike(WORD))
    tagged = worded.withColumn(skey, _source_key(source)).withColumn(place, F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)))
    keyed = tagged.join(counts, skey).withColumn(shard, F.pmod(place, F.col(n)).cast("int"))
    again = F.col(passes) + (F.col(place) < F.col(edge)).cast("int")
    taken = keyed.join(info, [skey, shard])
    return taken.withColumn(copy, F.explode(F.when(again > 0, F.sequence(F.lit(1), again.cast("int"))))).select(*[F.col(f"`{c}`") for c in names])


def op10_mixing(spark, sf_dir) -> DataFrame:
    documents, _ = plan(table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")
