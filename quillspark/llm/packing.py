"""Packing into optimal length buckets.

A global histogram of document lengths (words) goes to the driver in a bounded form: lengths up to
``exact`` have their own entry, longer ones share entries of 1/64 relative width. Dynamic programming
over it chooses at most ``buckets`` upper lengths so that padding every document up to its bucket's
length costs fewest words. Inside a bucket, batches of as many documents as fit ``budget`` padded
words are formed over hash groups of some dozen batches, so no bucket is gathered in one task;
each group leaves at most one batch short. A document longer than the budget is a batch of its own.

Defined cases: null text has length 0; documents of length 0 form the bucket of length 0 or join the
shortest one, whichever the programme finds; texts longer than the budget are batches of their own; repeated rows are packed each for itself; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import durable, table, word_count


def best_bounds(lengths: list[int], counts: list[int], sums: list[int], buckets: int) -> list[int]:
    """Upper lengths, ascending, of at most ``buckets`` buckets with the least padding.

    lengths: the largest length of each histogram entry, ascending; counts and sums: its documents and their words.
    """
    top = np.asarray(lengths, dtype=float)
    n, total = np.concatenate([[0], np.cumsum(counts, dtype=float)]), np.concatenate([[0], np.cumsum(sums, dtype=float)])
    m = len(top)
    if not m:
        return []
    # cost[j]: least padding of the first j entries; one more bucket each round
    cost, came = np.full(m + 1, np.inf), []
    cost[0] = 0.0
    for _ in range(min(buckets, m)):
        new, back = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int)
        new[0] = 0.0
        for j in range(1, m + 1):
            options = cost[:j] + top[j - 1] * (n[j] - n[:j]) - (total[j] - total[:j])
            back[j] = int(options.argmin())
            new[j] = options[back[j]]
        cost = new
        came.append(back)
    bounds, j = [], m
    for back in reversed(came):
        if j == 0:
            break
        bounds.append(int(top[j - 1]))
        j = back[j]
    return bounds[::-1]


def pack(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", buckets: int = 16, budget: int = 16384, exact: int = 1024, group_batches: int = 64, group_docs: int = 1 << 18) -> DataFrame:
    """doc_id, length, bucket (from 0), bucket_length, batch_id, slot (from 0 in its batch), padding."""
    base = durable(docs.select(F.col(doc_id).alias("doc_id"), word_count(F.col(text)).alias("length"), F.pmod(F.monotonically_increasing_id(), F.lit(1009)).alias("tag")))  # the tag parts rows that repeat an id
    step = F.greatest(F.lit(1), F.pow(F.lit(2), F.floor(F.log2(F.greatest(F.col("length"), F.lit(1)))) - 6)).cast("long")
    entry = F.when(F.col("length") <= exact, F.col("length")).otherwise(F.floor(F.col("length") / step) * step)
    rows = sorted(base.groupBy(entry.alias("entry")).agg(F.max("length").alias("top"), F.count("*").alias("n"), F.sum("length").alias("words")).collect(), key=lambda r: r.top)
    bounds = best_bounds([r.top for r in rows], [r.n for r in rows], [r.words for r in rows], buckets) or [0]
    sizes = [max(1, budget // max(b, 1)) for b in bounds]
    inside = [sum(r.n for r in rows if (bounds[k - 1] if k else -1) < r.top <= b) for k, b in enumerate(bounds)]
    groups = [max(1, round(n / min(group_batches * s, max(s, group_docs)))) for n, s in zip(inside, sizes)]

    def of(values: list[int]):
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("bucket") + 1)

    number = F.lit(0)
    for b in bounds[:-1]:
        number = number + (F.col("length") > b).cast("int")
    placed = base.withColumn("bucket", number).withColumn("bucket_length", of(bounds).cast("long")).withColumn("_size", of(sizes)).withColumn("_hash", F.xxhash64("doc_id", "length", "tag")).withColumn("_group", F.pmod("_hash", of(groups)).cast("int"))
    at = F.row_number().over(Window.partitionBy("bucket", "_group").orderBy("_hash", "doc_id", "length")) - 1
    return placed.withColumn("_at", at).select(
        "doc_id", "length", "bucket", "bucket_length",
        F.concat_ws("-", "bucket", "_group", F.floor(F.col("_at") / F.col("_size")).cast("string")).alias("batch_id"),
        F.pmod("_at", F.col("_size")).alias("slot"), (F.col("bucket_length") - F.col("length")).alias("padding"),
    )


def op5_packing(spark, sf_dir) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
