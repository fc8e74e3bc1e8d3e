"""Substring dedup by hashing lines, and passages inside them.

Texts are compared as words: ASCII letters in lower case, ASCII white space only as a border. Units are
every line of at least ``min_words`` words and, as passages also repeat from the middle of one line to the
middle of another, runs of 38 words that are chosen by their content: of every passage_words - 37
consecutive runs the one whose words' numbers (32 bits of md5 each) have the least sum modulo 2^32, the
first of equals. Two equal passages of passage_words words or more therefore share a unit. A 128-bit
digest stands for a unit. Over all documents the earliest occurrence of a digest, ranked by (doc_id,
word), is kept; the words of every other one are removed, unless it overlaps the earliest in its own text.
At either end of a repeated passage up to passage_words - 38 words can stay. Removed spans are given as
code points of the original text; blanks between what stays are kept once, and lines without words left go.

Digests are counted first, by their first half and combined on the map side, and only units that occur
more than once go on; the earliest of each is one row, joined back to its occurrences, so a line that a
third of all documents share is never gathered. Texts don't move where what is removed is small enough to
be broadcast, which is measured.

Defined cases: null text stays null; empty text stays empty; documents with a null doc_id keep their
text; rows that repeat a doc_id and text count as one document and lose the same spans, rows of one doc_id
with different texts are documents of their own, in the order of a hash of the text; very long texts are
units like any others, one text at a time in memory; an empty table gives an empty result; other columns of
the input pass through untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import WORD, durable, fresh, pieces, table
from quillspark.llm.tokens import encode, split_words

MIN_WORDS, PASSAGE_WORDS, RUN_WORDS = 16, 50, 38
#: Bytes of text that a task cuts into units at a time (one text may be longer).
SLICE = 1 << 18
#: Bytes of removed spans that are broadcast at most.
MOST_BYTES = 32 << 20
_RANGES = T.ArrayType(T.StructType([T.StructField("word", T.IntegerType()), T.StructField("n", T.IntegerType())]))
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def chosen_runs(numbers: np.ndarray, owner: np.ndarray, passage_words: int) -> np.ndarray:
    """First words of the runs chosen, ascending. numbers: 32 bits for each word, as uint64; owner: each word's text, ascending."""
    within = passage_words - RUN_WORDS + 1
    if len(numbers) < passage_words:
        return np.zeros(0, dtype=np.int64)
    total = np.r_[np.uint64(0), np.cumsum(numbers)]
    sums = (total[RUN_WORDS:] - total[:-RUN_WORDS]) & np.uint64(0xFFFFFFFF)
    begins = np.flatnonzero(owner[passage_words - 1 :] == owner[: len(owner) - passage_words + 1])  # passages inside one text
    windows = np.lib.stride_tricks.sliding_window_view(sums, within)
    return np.unique(np.concatenate([windows[part].argmin(axis=1) + part for part in np.array_split(begins, len(begins) // 65536 + 1)]))


def _units(min_words: int, passage_words: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", at_once=SLICE):
            joined, begins, ends, owner = split_words(batch.column("text").to_pylist())
            codes, vocabulary = encode(joined, begins, ends)
            numbers = np.frombuffer(b"".join([hashlib.md5(w, usedforsecurity=False).digest()[:4] for w in vocabulary]), dtype=">u4").astype(np.uint64)[codes]
            line = np.searchsorted(np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 10), begins)
            first = np.flatnonzero(np.diff(line, prepend=-1))
            size = np.diff(np.r_[first, len(line)])
            runs = chosen_runs(numbers, owner, passage_words)
            at = np.r_[first[size >= min_words], runs]
            n = np.r_[size[size >= min_words], np.full(len(runs), RUN_WORDS)]
            plain = b" ".join(map(vocabulary.__getitem__, codes.tolist()))
            stop = np.cumsum(ends - begins + 1) - 1
            start = stop - (ends - begins)
            digests = b"".join([xxhash.xxh3_128_digest(plain[a:b]) for a, b in zip(start[at].tolist(), stop[at + n - 1].tolist())])
            halves = np.frombuffer(digests, dtype="<i8").reshape(-1, 2)
            head = np.searchsorted(owner, owner[at])  # the first word of the unit's text
            own = pa.array(owner[at])
            columns = [batch.column("doc_id").take(own), batch.column("key").take(own), pa.array((at - head).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "word", "n", "d1", "d2"])

    return cut


@F.pandas_udf(_RANGES)
def _islands(ranges: pd.Series) -> pd.Series:
    """Ranges of words (word, n) that touch or overlap, as one."""

    def one(rows):
        own = np.array(sorted((r["word"], r["word"] + r["n"]) for r in rows))
        reached = np.maximum.accumulate(own[:, 1])
        first = np.r_[True, own[1:, 0] > reached[:-1]]
        ends = reached[np.r_[np.flatnonzero(first)[1:] - 1, len(own) - 1]]
        return [{"word": int(a), "n": int(b - a)} for a, b in zip(own[first, 0], ends)]

    return pd.Series([one(x) for x in ranges])


def cut_words(text: str, islands: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """(what stays, spans removed): text without the ranges (first word, number of words)."""
    words = [m.span() for m in re.finditer(WORD, text)]
    kept, at, spans = [], 0, []
    for word, n in islands:
        start, end = words[word][0], words[word + n - 1][1]
        spans.append((start, end))
        before = start
        while before and text[before - 1] in " \t":
            before -= 1
        while end < len(text) and text[end] in " \t":
            end += 1
        begins, finishes = not before or text[before - 1] == "\n", end == len(text) or text[end] == "\n"
        if begins and finishes:  # whole lines go with a line break, the one before where none follows
            if end < len(text):
                end += 1
            elif before:
                before -= 1
        kept.append(text[at : before if begins or finishes else start])
        at = end
    return "".join(kept) + text[at:], spans


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("spans", _SPANS)]))
def _cut(text: pd.Series, islands: pd.Series) -> pd.DataFrame:
    """What stays of each text, and the spans removed; nulls (nothing is removed) stay null."""
    out = [(None, None) if t is None else cut_words(t, [(x["word"], x["n"]) for x in own]) for t, own in zip(text, islands)]
    return pd.DataFrame({"text": [t for t, _ in out], "spans": [s and [{"start": a, "end": b} for a, b in s] for _, s in out]}, dtype=object)


def repeated_words(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """doc_id, key (hash of the text), islands: array of (word, n), ascending and apart; only documents that lose something."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("key"), F.col(text).alias("text")).filter("doc_id is not null and text is not null")
    units = durable(own.mapInArrow(_units(min_words, passage_words), f"doc_id {own.schema['doc_id'].dataType.simpleString()}, key long, word int, n int, d1 long, d2 long"), texts=True)
    # digests grow with the corpus: their joins are shuffles at every size; as both sides are tables, a frequent digest's rows are split at run time
    often = durable(units.groupBy("d1").agg(F.count("*").alias("times")).filter("times > 1").select("d1"))
    held = durable(units.join(often.hint("merge"), "d1", "left_semi"))
    first = durable(held.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "key", "word")).alias("first"), F.count("*").alias("times")).filter("times > 1").select("d1", "d2", "first"))
    other = (F.col("doc_id") != F.col("first.doc_id")) | (F.col("key") != F.col("first.key"))
    gone = held.join(first.hint("merge"), ["d1", "d2"]).filter(other | (F.col("word") >= F.col("first.word") + F.col("n")))
    return gone.groupBy("doc_id", "key").agg(F.collect_set(F.struct("word", "n")).alias("ranges")).select("doc_id", "key", _islands("ranges").alias("islands"))


def dedup(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS, passage_words: int = PASSAGE_WORDS, spans: str | None = None) -> DataFrame:
    """docs with the text's repeated lines and passages removed; with ``spans``, a column of that name has the spans removed (start, end; null: none)."""
    key, d, k, own, cut = fresh(docs, "key", "d", "k", "islands", "cut")
    lost = durable(repeated_words(docs, text=text, doc_id=doc_id, min_words=min_words, passage_words=passage_words).select(F.col("doc_id").alias(d), F.col("key").alias(k), F.col("islands").alias(own)))
    size = lost.agg(F.sum(F.size(own) * 16 + 64)).first()[0] or 0
    joined = docs.withColumn(key, F.xxhash64(text)).join(F.broadcast(lost) if size <= MOST_BYTES else lost, (F.col(doc_id) == F.col(d)) & (F.col(key) == F.col(k)), "left")
    done = joined.withColumn(cut, _cut(F.when(F.col(own).isNotNull(), F.col(text)), F.col(own)))
    shown = [F.when(F.col(own).isNotNull(), F.col(cut)["text"]).otherwise(F.col(text)).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return durable(done.select(*shown, *([F.col(cut)["spans"].alias(spans)] if spans else [])), texts=True)  # whoever reads it needn't send texts to Python tasks in small batches


def op4_substring_dedup(spark, sf_dir) -> DataFrame:
    """doc_id, text (what stays), n_removed, chars_removed, removed ("start-end ..." of the original text)."""
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), spans="spans")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>"))
    return out.select(
        "doc_id", "text", F.size(spans).cast("long").alias("n_removed"),
        F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("chars_removed"),
        F.array_join(F.transform(spans, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), " ").alias("removed"),
    )


#: doc_id is taken to be unique, as it is in the tables.
OP4_SQL = rf"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS line, unnest(l) AS body FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
), parts AS (
  SELECT doc_id, line, generate_subscripts(p, 1) AS i, unnest(p) AS part FROM (SELECT doc_id, line, string_split_regex(body, '[\x20\x09-\x0D]') AS p FROM lines)
), placed AS (
  SELECT *, sum(length(part) + 1) OVER (PARTITION BY doc_id ORDER BY line, i ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS stop FROM parts
), words AS (
  SELECT doc_id, line, stop - length(part) AS start, stop, translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w,
         row_number() OVER (PARTITION BY doc_id ORDER BY line, i) - 1 AS word, count(*) OVER (PARTITION BY doc_id) AS m
  FROM placed WHERE part <> ''
), sums AS (
  SELECT doc_id, word, m, sum(('0x' || md5(w)[1:8])::UBIGINT) OVER run % 4294967296 AS s, string_agg(w, ' ') OVER run AS unit
  FROM words WINDOW run AS (PARTITION BY doc_id ORDER BY word ROWS BETWEEN CURRENT ROW AND {RUN_WORDS - 1} FOLLOWING)
), least AS (
  SELECT DISTINCT doc_id, best % 10000000 AS word FROM (
    SELECT doc_id, word, m, min(s::HUGEINT * 10000000 + word) OVER (PARTITION BY doc_id ORDER BY word ROWS BETWEEN CURRENT ROW AND {PASSAGE_WORDS - RUN_WORDS} FOLLOWING) AS best
    FROM sums WHERE word <= m - {RUN_WORDS}
  ) WHERE word <= m - {PASSAGE_WORDS}
), units AS (
  SELECT doc_id, min(word) AS word, count(*) AS n, string_agg(w, ' ' ORDER BY word) AS unit FROM words GROUP BY doc_id, line HAVING count(*) >= {MIN_WORDS}
  UNION ALL SELECT doc_id, word, {RUN_WORDS}, unit FROM least JOIN sums USING (doc_id, word)
), ranked AS (
  SELECT *, first_value(doc_id) OVER o AS first_doc, first_value(word) OVER o AS first_word FROM units WINDOW o AS (PARTITION BY unit ORDER BY doc_id, word)
), gone AS (
  SELECT *, max(word + n) OVER (PARTITION BY doc_id ORDER BY word, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached
  FROM ranked WHERE doc_id <> first_doc OR word >= first_word + n
), islands AS (
  SELECT doc_id, island, min(word) AS a, max(word + n) - 1 AS b FROM (
    SELECT *, sum(CASE WHEN reached IS NULL OR word > reached THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY word, n ROWS UNBOUNDED PRECEDING) AS island FROM gone
  ) GROUP BY doc_id, island
), spans AS (
  SELECT i.doc_id, text, x.start, y.stop, x.start - length(regexp_extract(substr(text, 1, x.start), '[ \t]*$')) AS before, y.stop + length(regexp_extract(substr(text, y.stop + 1), '^[ \t]*')) AS after
  FROM islands i JOIN words x ON x.doc_id = i.doc_id AND x.word = a JOIN words y ON y.doc_id = i.doc_id AND y.word = b JOIN documents d ON d.doc_id = i.doc_id
), edges AS (
  SELECT *, before = 0 OR substr(text, before, 1) = chr(10) AS begins, after = length(text) OR substr(text, after + 1, 1) = chr(10) AS finishes FROM spans
), cuts AS (
  SELECT doc_id, text, start, stop, CASE WHEN NOT begins AND NOT finishes THEN start WHEN begins AND finishes AND after = length(text) AND before > 0 THEN before - 1 ELSE before END AS s,
         CASE WHEN begins AND finishes AND after < length(text) THEN after + 1 ELSE after END AS e
  FROM edges
), kept AS (
  SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY start), 0) AS began FROM cuts
), done AS (
  SELECT doc_id, string_agg(substr(text, began + 1, s - began), '' ORDER BY start) || substr(any_value(text), max(e) + 1) AS text,
         count(*) AS n, sum(stop - start)::BIGINT AS chars, string_agg(start || '-' || stop, ' ' ORDER BY start) AS removed
  FROM kept GROUP BY doc_id
)
SELECT documents.doc_id, coalesce(done.text, documents.text) AS text, coalesce(n, 0) AS n_removed, coalesce(chars, 0) AS chars_removed, coalesce(removed, '') AS removed
FROM documents LEFT JOIN done USING (doc_id)
"""
