"""Language ID by Bayesian evidence fusion.

Four pieces of evidence are multiplied for each language:

* the text: hashed letter trigrams under a model of each language, fitted on a bounded sample of labelled
  texts; beyond ``most_grams`` trigrams the whole text's log likelihood is scaled down, as they don't err alone;
* the language that the markup (or a metadata field) declares;
* the suffix of the address;
* a prior of the host, smoothed to its domain and that to all rows.

What a declaration, a suffix or a host says is learned from the rows themselves by grouped aggregation: how
often it goes with each text's own likeliest language. A row's own count is left out of what it is told. These tables are joined back as tables,
since they grow with the hosts; rows travel without their texts.

A text without a trigram of letters, or whose likeliest language has less than ``least`` probability, is rejected.

Defined cases: null texts and addresses are empty; a null declaration, suffix or host is a value of its own that
tells nothing special; repeated rows count each for itself; equal languages fall to the first by name; very long texts
count as a whole, some thousand trigrams at a time; without labelled texts nothing is identified; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import durable, pieces, sampled, small_batches, table

BUCKETS, SAMPLE, MOST_GRAMS, LEAST, PSEUDO = 1 << 15, 4000, 150, 0.5, 5.0
#: ASCII bytes that aren't letters, as spaces; letters in lower case; other bytes as they are.
_FOLD = bytes(b if b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_MARKUP = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;")


def grams(text: str | None) -> np.ndarray:
    """Buckets of the byte trigrams of the words' letters."""
    words = (text or "").encode().translate(_FOLD).split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    a = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8).astype(np.uint32)
    return ((a[:-2] << 16 | a[1:-1] << 8 | a[2:]) * np.uint32(2654435761) >> np.uint32(17)).astype(np.int64)


def fit(labelled: DataFrame, *, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities of the buckets: one row a bucket). labelled: text, lang. About ``sample`` rows are used;
    the driver receives at most one number a bucket and language."""
    known = labelled.filter("lang is not null and text is not null")
    share = sampled(known.count(), sample, 4, "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                total[lang] = total.get(lang, 0) + np.bincount(grams(text), minlength=BUCKETS)
        for lang, t in total.items():
            at = np.flatnonzero(t)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": t[at]})

    counted = known.filter(share).select("lang", "text").mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    with small_batches(labelled.sparkSession):
        rows = counted.toPandas()
    languages = sorted(rows["lang"].unique())
    counts = np.full((BUCKETS, len(languages)), 0.5)
    for k, lang in enumerate(languages):
        own = rows[rows["lang"] == lang]
        counts[own["bucket"], k] += own["n"]
    return languages, np.log(counts / counts.sum(axis=0)) if languages else counts


def text_evidence(rows: DataFrame, model: tuple[list[str], np.ndarray], *, markup: bool) -> DataFrame:
    """rows without ``text``, with ``told``: log likelihoods by language (null: no trigrams)."""
    languages, logs = model
    shared = rows.sparkSession.sparkContext.broadcast(logs)
    kept = [f for f in rows.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            out = []
            for x in batch.column("text").to_pylist():
                g = grams(_MARKUP.sub(" ", x) if markup and x else x)
                own = np.zeros(len(languages))
                for at in range(0, len(g), 1 << 16):
                    own += shared.value[g[at : at + (1 << 16)]].sum(axis=0)
                out.append((own * min(1.0, MOST_GRAMS / len(g))).tolist() if len(g) and languages else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(out, pa.list_(pa.float64()))], names=[*(f.name for f in kept), "told"])

    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("told", T.ArrayType(T.DoubleType()))]))


def _table(rows: DataFrame, key: str, n: int) -> DataFrame:
    """key, one array of counts of rows by their text's likeliest language."""
    sums = [F.sum((F.col("likeliest") == k).cast("double")).alias(f"n{k}") for k in range(n)]
    return rows.groupBy(key).agg(*sums).select(key, F.array(*[f"n{k}" for k in range(n)]).alias(f"{key}_n"))


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], *, markup: bool = False, least: float = LEAST) -> DataFrame:
    """rows (id..., text, declared, suffix, domain, host) without text, with language, probability, text_language, accepted."""
    languages, _ = model
    n = len(languages)
    keys = ["declared", "suffix", "domain", "host"]
    filled = rows.withColumns({k: F.coalesce(F.col(k), F.lit("")) for k in keys})
    told = text_evidence(filled, model, markup=markup)
    if not n:
        return told.select("*", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("probability"), F.lit(None).cast("string").alias("text_language"), F.lit(False).alias("accepted")).drop("told", *keys)
    base = durable(told.withColumn("likeliest", F.when(F.col("told").isNotNull(), F.array_position("told", F.array_max("told")) - 1).cast("int")), texts=True)
    names, k = F.array(*map(F.lit, languages)), [F.lit(i) for i in range(n)]
    total = [float(x) for x in base.agg(*[F.coalesce(F.sum((F.col("likeliest") == i).cast("double")), F.lit(0.0)) for i in range(n)]).first()]
    out = base
    for key in keys:
        out = out.join(durable(_table(base, key, n)), key)  # a table: small ones are broadcast, in joins with large ones a frequent host is split
    own = [(F.coalesce(F.col("likeliest"), F.lit(-1)) == i).cast("double") for i in k]
    other = lambda key, i: F.col(f"{key}_n")[i] - own[i]
    both = lambda key: sum((other(key, i) for i in range(n)), F.lit(0.0))
    score: list[Column] = []
    for i in range(n):
        everywhere = (total[i] + 1) / (sum(total) + n)
        domain = (other("domain", i) + PSEUDO * everywhere) / (both("domain") + PSEUDO)
        host = (other("host", i) + PSEUDO * domain) / (both("host") + PSEUDO)
        seen = [(other(key, i) + PSEUDO * everywhere) / ((both(key) + PSEUDO) * everywhere) for key in ("declared", "suffix")]
        score.append(F.col("told")[i] + F.log(host) + sum((F.log(F.greatest(x, F.lit(1e-3))) for x in seen), F.lit(0.0)))
    scored = out.withColumn("score", F.array(*score))
    best = F.array_max("score")
    scored = scored.withColumn("at", F.array_position("score", best)).withColumn("probability", F.coalesce(1.0 / F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - best)), F.lit(0.0)))
    fine = F.col("told").isNotNull() & (F.col("probability") >= least)
    return scored.select(
        *[c for c in rows.columns if c not in ("text", *keys)],
        F.when(fine, F.element_at(names, F.col("at").cast("int"))).alias("language"), "probability",
        F.when(F.col("likeliest").isNotNull(), F.element_at(names, F.col("likeliest") + 1)).alias("text_language"), fine.alias("accepted"),
    )


def page_rows(pages: DataFrame) -> DataFrame:
    """page_id, text (markup), declared, suffix, domain, host."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"""(?i)<html[^>]*\blang\s*=\s*["']?([A-Za-z]+)""", 1))
    labels = F.split(F.col("host"), r"\.")
    return pages.select("page_id", F.col("html").alias("text"), declared.alias("declared"), host.alias("host")).select(
        "page_id", "text", "declared", F.element_at(labels, -1).alias("suffix"), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").alias("domain"), "host"
    )


def document_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, and as evidence what documents have: the declared lang, and the source in the host's place."""
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text", F.lower("lang").alias("declared"), F.lit("").alias("suffix"), F.lit("").alias("domain"), F.col("source").cast("string").alias("host"))


def op7_language_id(spark, sf_dir) -> DataFrame:
    """page_id, language, probability, text_language, accepted of every page; texts are learned from documents."""
    model = fit(table(spark, sf_dir, "documents").select("text", "lang"))
    return identify(page_rows(table(spark, sf_dir, "pages")), model, markup=True)
