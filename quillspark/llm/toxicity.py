"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct words (ASCII lower case, punctuation stripped at the ends), pairs of
neighbours and pairs with one word between, hashed to 2^bits coordinates. Each coordinate has its own
learning rate; L1 regularisation keeps most weights at exactly zero, so what is broadcast is a short list,
of 2^bits entries at the very most.

The classifier is fitted on a bounded sample of labelled rows: about ``sample`` of them, chosen by a hash
of doc_id, dealt into shards of about ``shard_rows`` that learn on their own and are averaged. Every row is scored.

Defined cases: null and empty texts have no features and get the score of the bias; a null label teaches
nothing; where labels repeat an id the larger counts; rows that repeat an id are scored each for itself, and
teach once a text (a sample of them where they are more than twice ``sample``); very long texts count as a whole;
a null id counts as the empty text for the fold; without labelled rows every score is 0.5; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import durable, id_crc, pieces, sampled, small_batches, table
from quillspark.llm.tokens import coded_words, slices

BITS, SAMPLE, SHARD_ROWS, THRESHOLD = 20, 16_000, 4_000, 0.3
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 4.0, 0.0, 3
_EDGES = string.punctuation.encode()


def features(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(rows, coordinates) of every occurrence of a feature."""
    codes, vocabulary, counts = coded_words(texts)
    word = np.array([xxhash.xxh64_intdigest(w.strip(_EDGES)) for w in vocabulary], dtype=np.uint64)[codes] if len(codes) else np.zeros(0, dtype=np.uint64)
    row = np.repeat(np.arange(len(counts)), counts)
    rows, found = [row], [word * np.uint64(0x9E3779B97F4A7C15)]
    for gap, mixer in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
        pair = (word[:-gap] * np.uint64(3) + (word[gap:] ^ np.uint64(mixer))) * np.uint64(mixer)
        same = row[:-gap] == row[gap:]
        rows.append(row[:-gap][same])
        found.append(pair[same])
    return np.concatenate(rows), (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64)


def fit(examples: Iterator[tuple[np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """(weights, bias). examples: (distinct coordinates, label)."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0
    examples = list(examples)
    weight = lambda z, n: np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    bias = lambda: -zb / ((BETA + nb**0.5) / ALPHA)
    for _ in range(epochs):
        for at, label in examples:
            own, b = weight(z[at], n[at]), bias()
            g = 1 / (1 + np.exp(-np.clip(own.sum() + b, -35, 35))) - label
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * own
            n[at] += g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / ALPHA * b
            nb += g * g
    return weight(z, n), bias()


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, shard_rows: int = SHARD_ROWS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """(coordinates, weights, bias). docs: doc_id, text; labels: doc_id, toxic, of the rows to learn from."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = known.count()
    shards = max(1, round(min(total, sample) / shard_rows))
    chosen = durable(known.filter(sampled(total, sample, 3, "doc_id")))  # about ``sample`` rows of two numbers
    held = docs.select("doc_id").join(F.broadcast(chosen), "doc_id").count()  # more where ids repeat: those are thinned by text
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter(sampled(held, 2 * sample, 4, "doc_id", "text")).dropDuplicates()
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text"], kind="stable").sample(frac=1.0, random_state=9)
        examples = []
        texts, toxic = pdf["text"].tolist(), pdf["toxic"].to_numpy()
        for a, b in slices(texts):
            row, at = features(texts[a:b], bits)
            keys = np.unique(row << bits | at)
            cut = np.searchsorted(keys, np.arange(b - a + 1) << bits)
            examples += [((keys[cut[i] : cut[i + 1]] & (1 << bits) - 1).astype(np.int32), int(toxic[a + i])) for i in range(b - a)]
        w, bias = fit(examples, bits)
        at = np.flatnonzero(w)
        return pd.DataFrame({"at": np.r_[-1, at], "w": np.r_[bias, w[at]]})

    learned = rows.groupBy("shard").applyInPandas(learn, "at long, w double")
    with small_batches(docs.sparkSession):
        got = learned.groupBy("at").agg(F.sum("w").alias("w"), F.count("*").alias("n")).toPandas()  # at most 2^bits rows
    bias, taught = got.loc[got["at"] == -1, ["w", "n"]].sum()  # n: the shards that learned
    taught = max(1, taught)
    bias /= taught
    got = got[got["at"] >= 0]
    return got["at"].to_numpy(np.int64), got["w"].to_numpy() / taught, float(bias)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], *, bits: int = BITS) -> DataFrame:
    """doc_id, score."""
    at, w, bias = model
    shared = docs.sparkSession.sparkContext.broadcast((at, w.astype(np.float64), bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = shared.value
        weights = np.zeros(1 << bits)
        weights[at] = w
        for batch in pieces(batches, "text"):
            row, found = features(batch.column(1).to_pylist(), bits)
            hit = weights[found] != 0
            keys = np.unique(row[hit] << bits | found[hit])  # each feature once a text
            out = bias + np.bincount(keys >> bits, weights=weights[keys & (1 << bits) - 1], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))], names=["doc_id", "score"])

    own = docs.select("doc_id", "text")
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, score double")


def op1_toxicity(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(id_crc("doc_id", 4) != 2)
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (id_crc("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
