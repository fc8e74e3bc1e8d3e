"""A corpus pipeline: language ID, near-duplicates, repeated lines and passages, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
What a stage does with nulls, repeated rows, ties, very long texts and empty tables is in its docstring; other
columns pass through all of them, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import language_id, mixing, packing, simhash, substring_dedup
from quillspark.llm.common import durable, fresh, table, without
from quillspark.sources.stored import new_path, remove, scratch


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without evidence of a language go: no letters (null and empty texts too), or no language of half the probability.

    Rows that repeat an id and text are kept or rejected alike; equal languages fall to the first by name; a
    very long text counts as a whole, with its likelihood scaled down; without labelled texts all go.
    """
    found = language_id.identify(language_id.document_rows(docs), language_id.fit(docs.select("text", "lang")))
    [key] = fresh(docs, "row_key")
    rejected = found.filter(~F.col("accepted")).select(F.col("row_key").alias(key))
    return without(docs.withColumn(key, F.xxhash64("doc_id", "text")), rejected, key).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints the document of the smallest id stays, once.

    Rows of one id with different texts are documents of their own, at one id in the order of a hash of the text; rows
    that repeat both count once; rows without an id stay; texts without words, null or not, are copies of each
    other; very long texts count as a whole.
    """
    [key] = fresh(docs, "row_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    own = keyed.filter("doc_id is not null").select("doc_id", "text", F.col(key).alias("row_key"))
    found = durable(simhash.near_duplicates(own, doc_id="row_key")).withColumnRenamed("doc_id", "row_key")
    members = found.groupBy("row_key", "component_id").agg(F.count("*").alias("n"))
    named = durable(members.join(own.select("row_key", "doc_id").distinct(), "row_key"))
    stays = durable(named.groupBy("component_id").agg(F.min(F.struct("doc_id", "row_key")).alias("stays")))  # a table, so that a large component's rows are split in the join
    named = durable(named.join(stays, "component_id").withColumn("first", F.col("row_key") == F.col("stays.row_key")))
    kept = without(keyed, named.filter("not first").select(F.col("row_key").alias(key)), key)
    again = durable(named.filter("first and n > 1").select(F.col("row_key").alias(key)))
    if again.isEmpty():
        return kept.select(*docs.columns)
    once = keyed.join(again, key, "left_semi").dropDuplicates([key])
    return without(kept, again, key).select(*docs.columns).unionByName(once.select(*docs.columns))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines and passages of 50 words or more that occurred before, in the order of doc_id, go from the texts; n_chars follows.

    Nulls, repeated rows, ties and very long texts: as in substring_dedup.
    """
    [spans] = fresh(docs, "spans")
    out = substring_dedup.dedup(docs, spans=spans)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them. Null sources are one source; texts without words, null or not, go;
    repeated rows take each for itself; a very long text is taken as a whole or not."""
    _, shards = mixing.plan(docs)
    return mixing.apply_mix(docs, shards)


def pack_lengths(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row in a batch of its length bucket; null texts have length 0, a text longer than the budget is a batch of its own."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_languages),
    ("simhash", drop_near_duplicates),
    ("substring_dedup", drop_repeated_lines),
    ("mixing", mix_sources),
    ("packing", pack_lengths),
]

#: Fingerprints, models and apportionment aren't SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's result is a table; what it kept on the way, and the table before, are deleted."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
