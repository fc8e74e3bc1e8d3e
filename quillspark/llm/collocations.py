"""Phrase collocations by Rabin-Karp fingerprints.

Texts are cut into blocks of some MB, kept as word codes, a number of each piece's end, and a vocabulary of (lang,
word). In a block one prefix polynomial over the words' 64-bit hashes gives the fingerprint of every n-gram by a
subtraction and a product, in numpy. A shuffle adds up fingerprints, each with a pointer to a block where
it occurs. It runs level by level, from words to phrases of five: of a level only phrases both of whose parts are frequent are
sent, as no phrase is more frequent than a part of it; so nearly all phrases that occur a few times
are never sent. Only fingerprints that reach the minimum are followed to their blocks, where the phrase is read at the first place.

A fingerprint is not taken for its phrase. Up to ``most`` (2^20, counted first) frequent ones are broadcast, and every block compares
its own occurrences of them with the phrase, and tells those that differ, whose counts are taken off and added up under their own words.
Beyond that, frequent fingerprints are broadcast as bits, which leave out phrases that can't be frequent and may let others pass; the phrases that
pass are added up once more by their words.

Defined cases: null text is empty; null lang is ``und``; rows that repeat an id or text count each for itself; a very
long text is a block of its own and never cut; ties are ordered by count and phrase; tables without a frequent phrase
give an empty result; other columns, whatever their names, are ignored. Products have up to 38 digits and a score 64 bits; more is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import durable, expand, pieces, squeeze, table
from quillspark.llm.tokens import encode

BLOCK_CHARS, LEAST, LONGEST, TOP, MOST = 8 << 20, 100, 5, 2000, 1 << 20
#: Bits of a set of fingerprints that is broadcast at most: 64 MB.
MOST_BITS = 1 << 29
#: Phrases that a block writes out at a time.
PHRASES_AT_ONCE = 1 << 17
#: Base of the polynomial: odd, so that it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
#: Each byte lower-cased; what ends a piece as a line feed.
_BYTES = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256)).lower()
_BLOCK = "block long, langs array<string>, totals array<long>, n_words long, words binary, word_lang array<int>, n_codes long, codes binary, ends binary"


def _cut(block_chars: int) -> Callable:
    """Rows (lang, text) to blocks, one row each."""

    def block(number: int, langs: list[str], texts: list[str]) -> pa.RecordBatch:
        data = [t.encode() + b"\n" for t in texts]
        joined = b"".join(data).translate(_BYTES)
        raw = np.frombuffer(joined, dtype=np.uint8)
        breaks = np.flatnonzero(raw == 10)
        edge = np.flatnonzero(np.diff(np.r_[True, (raw == 32) | (raw == 9) | (raw == 10)]))
        begins, ends = edge[::2], edge[1::2]
        codes, vocabulary = encode(joined, begins, ends)
        names = sorted(set(langs))
        seat = {x: i for i, x in enumerate(names)}
        lang = np.array([seat[x] for x in langs], dtype=np.int64)[np.searchsorted(np.cumsum([len(d) for d in data]), begins, side="right")]
        keys, codes = np.unique(lang * len(vocabulary) + codes, return_inverse=True)  # a word of two languages is two
        word_lang, word = np.divmod(keys, max(1, len(vocabulary)))
        last = np.diff(np.searchsorted(breaks, begins), append=-1) != 0  # the piece ends behind the word
        row = [number, names, np.bincount(lang, minlength=len(names)).tolist(), len(word), b"\n".join(vocabulary[w] for w in word), word_lang.tolist(), len(codes), squeeze(codes.astype(np.uint32)), squeeze(np.packbits(last))]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _TYPES)], names=_NAMES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for b in pieces(batches, "text"):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.append((lang, text))
                size += len(text) + 16
                if size >= block_chars:
                    yield block(number, *zip(*held))
                    number, held, size = number + 1, [], 0
        if held:
            yield block(number, *zip(*held))

    return cut


_NAMES = [x.split(" ")[0] for x in _BLOCK.split(", ")]
_TYPES = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.binary(), pa.binary()]


class Block:
    """The words of a block, and the fingerprints of its phrases. bits: of a fingerprint (fewer than 64 make collisions, for tests)."""

    def __init__(self, row, bits: int = 64):
        self.number, self.langs, self.bits, n = int(row.block), list(row.langs), bits, int(row.n_codes)
        self.words = row.words.split(b"\n") if row.n_words else []
        self.word_lang = np.asarray(row.word_lang, dtype=np.int64)
        self.codes = expand(row.codes, n, "<u4")[0].astype(np.int64)
        last = np.flatnonzero(np.unpackbits(expand(row.ends, -(-n // 8), "u1")[0], count=n))
        self.left = last[np.searchsorted(last, np.arange(n))] - np.arange(n) + 1  # words from here to the end of the piece
        seeds = [xxhash.xxh64_intdigest(x) for x in self.langs]
        self.hashes = np.array([xxhash.xxh64_intdigest(w, seeds[i]) for w, i in zip(self.words, self.word_lang)], dtype=np.uint64)
        power = np.cumprod(np.r_[np.uint64(1), np.full(n, BASE, dtype=np.uint64)])
        self.inverse = np.cumprod(np.r_[np.uint64(1), np.full(n, pow(BASE, -1, 1 << 64), dtype=np.uint64)])
        self.prefix = np.r_[np.uint64(0), np.cumsum(self.hashes[self.codes] * power[:-1])]

    def fingerprints(self, at: np.ndarray, n: int) -> np.ndarray:
        """Of the phrases of n words that begin at the given words."""
        x = (self.prefix[at + n] - self.prefix[at]) * self.inverse[at] + np.uint64(n)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(29))) >> np.uint64(64 - self.bits)).view(np.int64)

    def candidates(self, known: list[np.ndarray | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(n, places) of the phrases of one word, and of each level after one that is known, both of whose parts of n - 1 words may be frequent."""
        n, every = 1, np.arange(len(self.codes))
        yield n, every
        run = np.zeros(0, dtype=bool)
        for n, prints in enumerate(known, 2):
            if n == 2:
                run = _among(self.word_prints(), prints)[self.codes]
            else:
                run = np.zeros(len(every), dtype=bool)
                run[at] = _among(self.fingerprints(at, n - 1), prints)  # noqa: F821
            at = np.flatnonzero(run & np.r_[run[1:], False][: len(every)] & (self.left >= n))
            yield n, at

    def word_prints(self) -> np.ndarray:
        """The fingerprint of each word of the vocabulary, as of a phrase of one."""
        first = np.zeros(len(self.words), dtype=np.int64)
        first[self.codes[::-1]] = np.arange(len(self.codes))[::-1]
        return self.fingerprints(first, 1)

    def phrase(self, at: int, n: int) -> str:
        return b" ".join(self.words[c] for c in self.codes[at : at + n]).decode()

    def distinct(self, places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(a place of each of the different phrases of n words at the places, how many places each has). Phrases are equal whose codes are equal at every place."""
        places = places[np.lexsort([self.codes[places + k] for k in range(n)])]
        new = np.ones(len(places), dtype=bool)
        new[1:] = False
        for k in range(n):
            new[1:] |= self.codes[places[1:] + k] != self.codes[places[:-1] + k]
        starts = np.flatnonzero(new)
        return places[starts], np.diff(np.r_[starts, len(places)])

    def phrases(self, places: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
        """(languages, phrases) of n words at the places."""
        words = pa.array(self.words, pa.binary()).cast(pa.string())
        joined = pc.binary_join_element_wise(*[words.take(pa.array(self.codes[places + k])) for k in range(n)], " ")
        return pa.array(self.langs, pa.string()).take(pa.array(self.word_lang[self.codes[places]])), joined

    def lang(self, at: int) -> str:
        return self.langs[self.word_lang[self.codes[at]]]


def _among(x: np.ndarray, among: np.ndarray | None) -> np.ndarray:
    """Which of x are among sorted numbers, or may be among a set of bits; without either all may."""
    if among is None:
        return np.ones(len(x), dtype=bool)
    if not len(among):
        return np.zeros(len(x), dtype=bool)
    if among.dtype == np.uint8:
        place = x & np.int64(8 * len(among) - 1)
        return (among[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x


def _values(shared: list) -> list[np.ndarray | None]:
    return [s.value if s else None for s in shared]


def _counted(bits: int, shared: list):
    """Blocks to their distinct fingerprints of the next level: fp, n (occurrences), size, block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                block = Block(row, bits)
                *_, (size, places) = block.candidates(_values(shared))
                if size == 1:  # the codes tell what is equal
                    fp = block.word_prints()
                    n = np.bincount(block.codes, minlength=len(fp))
                else:
                    fp, n = np.unique(block.fingerprints(places, size), return_counts=True)
                yield pd.DataFrame({"fp": fp, "n": n, "size": np.int32(size), "block": block.number})

    return run


def _told(bits: int, shared: list):
    """Blocks to their phrases of all levels that may be frequent: size, lang, phrase, n (occurrences)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                block, known = Block(row, bits), _values(shared)
                for size, places in block.candidates(known[:-1]):
                    places, n = block.distinct(places[_among(block.fingerprints(places, size), known[size - 1])], size)
                    for a in range(0, len(places), PHRASES_AT_ONCE):
                        langs, phrases = block.phrases(places[a : a + PHRASES_AT_ONCE], size)
                        yield pd.DataFrame({"size": np.int32(size), "lang": langs.to_pandas(), "phrase": phrases.to_pandas(), "n": n[a : a + PHRASES_AT_ONCE]})

    return run


def _columns(df: DataFrame, *names: str) -> list[pa.Array]:
    """Columns of a table of at most ``most`` rows."""
    return [pa.concat_arrays(x.chunks) if x.num_chunks else pa.array([], x.type) for x in df.select(*names).toArrow().columns]


def _read(bits: int, shared: list, pointers):
    """Blocks to the phrases whose pointers they are: fp, size, lang, phrase. pointers: (block, size, fp) broadcast by block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                of, sizes, fps = pointers.value
                a, b = np.searchsorted(of, [row.block, row.block + 1])
                sizes, fps = sizes[a:b], fps[a:b]
                if not len(fps):
                    continue
                block = Block(row, bits)
                for size, places in block.candidates(_values(shared)[:-1]):
                    fp = block.fingerprints(places, size)
                    hit = _among(fp, np.sort(fps[sizes == size]))
                    fp, first = np.unique(fp[hit], return_index=True)
                    langs, phrases = block.phrases(places[hit][first], size)
                    yield pd.DataFrame({"fp": fp, "size": np.int32(size), "lang": langs.to_pandas(), "phrase": phrases.to_pandas()})

    return run


def _differing(bits: int, shared: list, phrases):
    """Blocks to their phrases of a frequent fingerprint that aren't the phrase it was read as: fp, size, lang, phrase, n."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                block, out = Block(row, bits), []
                fps, sizes, langs, texts = phrases.value
                for size, places in block.candidates(_values(shared)[:-1]):
                    mine = fps[sizes == size] if len(fps) else fps
                    seats = np.flatnonzero(sizes == size)
                    fp = block.fingerprints(places, size)
                    hit = _among(fp, mine)
                    places = places[hit]
                    if not len(places):
                        continue
                    places, counts = block.distinct(places, size)
                    fp = block.fingerprints(places, size)
                    seat = seats[np.searchsorted(mine, fp)]
                    for p, n, f, lang, text in zip(places, counts, fp, langs.take(pa.array(seat)).to_pylist(), texts.take(pa.array(seat)).to_pylist()):
                        own_text = block.phrase(p, size)
                        if own_text != text or block.lang(p) != lang:
                            out.append((int(f), size, block.lang(p), own_text, int(n)))
                yield pd.DataFrame(out, columns=["fp", "size", "lang", "phrase", "n"]).astype({"fp": "int64", "size": "int32", "n": "int64"})

    return run


def _may_be(found: DataFrame, n: int, most: int):
    """Broadcast of a level's fingerprints, sorted; of more than ``most`` as bits, of which at least 15 in 16 are unset as long as there are 2^25 fingerprints at most, and None beyond 2^28:
    what is only used to leave out phrases may hold too many."""
    spark = found.sparkSession
    if n <= most:
        return spark.sparkContext.broadcast(np.sort(_columns(found, "fp")[0].to_numpy()))
    if n > MOST_BITS // 2:
        return None
    size = min(MOST_BITS, max(1 << 15, 1 << (32 * n - 1).bit_length()))
    place = 1 + F.pmod("fp", F.lit(size))
    rows = found.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    held = np.zeros(size // 8, dtype=np.uint8)
    for bucket, part in zip(*(x.to_pylist() for x in _columns(rows, "bucket", "bits"))):
        held[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(part, dtype=np.uint8)
    return spark.sparkContext.broadcast(held)


def frequent_phrases(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, block_chars: int = BLOCK_CHARS, most: int = MOST, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f of all phrases of up to five words that occur ``least`` times in their language; lang, n of its words)."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    blocks = durable(rows.mapInArrow(_cut(block_chars), _BLOCK), texts=True)
    totals = blocks.select(F.explode(F.arrays_zip("langs", "totals")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.totals").alias("n"))
    shared, levels = [], []
    for _ in range(LONGEST):
        asked = blocks.mapInPandas(_counted(bits, shared), "fp long, n long, size int, block long")
        found = durable(asked.groupBy("size", "fp").agg(F.sum("n").alias("n"), F.min("block").alias("block")).filter(F.col("n") >= least))
        levels.append(found)
        shared = [*shared, _may_be(found, found.count(), most)]
    counts = reduce(DataFrame.unionByName, levels)
    if counts.count() > most:  # phrases are told, and added up, by their words
        both = blocks.mapInPandas(_told(bits, shared), "size int, lang string, phrase string, n long")
    else:
        own = [x.to_numpy().astype(np.int64) for x in _columns(counts, "block", "size", "fp")]
        order = np.argsort(own[0], kind="stable")
        phrases = durable(blocks.mapInPandas(_read(bits, shared, spark.sparkContext.broadcast(tuple(x[order] for x in own))), "fp long, size int, lang string, phrase string"))
        own = _columns(phrases, "fp", "size", "lang", "phrase")
        order = pa.array(np.argsort(own[0].to_numpy(), kind="stable"))
        texts = spark.sparkContext.broadcast((own[0].take(order).to_numpy(), own[1].take(order).to_numpy().astype(np.int64), own[2].take(order), own[3].take(order)))
        others = durable(blocks.mapInPandas(_differing(bits, shared, texts), "fp long, size int, lang string, phrase string, n long"))
        less = others.groupBy("size", "fp").agg(F.sum("n").alias("less"))
        right = phrases.join(counts.select("size", "fp", "n"), ["size", "fp"]).join(less, ["size", "fp"], "left")
        both = right.select("lang", "phrase", "size", (F.col("n") - F.coalesce("less", F.lit(0))).alias("n")).unionByName(others.select("lang", "phrase", "size", "n"))
    return durable(both.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)), durable(totals)


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, **how) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases by their lowest-scoring cut.

    Phrases that lie in a longer one of as many occurrences are left out.
    """
    counts, totals = frequent_phrases(docs, text=text, lang=lang, least=least, **how)
    words = F.split("phrase", " ")
    longer = counts.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), words.alias("words"))
    ks = F.sequence(F.lit(1), F.col("size") - 1)
    part = lambda a, n: F.array_join(F.slice("words", a, n), " ")
    cuts = longer.select("lang", "phrase", "a", "size", F.explode(ks).alias("k"), "words").select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    of = lambda key, value: counts.select("lang", F.col("phrase").alias(key), F.col("f").alias(value))
    valued = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    scored = valued.withColumn("score", F.expr("cast(1000 * cast(a AS decimal(19,0)) AS decimal(22,0)) * cast(n AS decimal(16,0)) div (cast(l AS decimal(19,0)) * cast(r AS decimal(19,0)))"))
    best = scored.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "k")).alias("x")).select("lang", "phrase", "x.*")
    begins, sizes = F.explode(F.sequence(F.lit(1), F.col("size") - 1)), F.explode(F.sequence(F.lit(2), F.least(F.col("size") - 1, F.col("size") - F.col("i") + 1)))
    inner = longer.filter("size > 2").select("lang", "a", "size", "words", begins.alias("i")).select("lang", "a", "words", "i", sizes.alias("m")).select("lang", part(F.col("i"), F.col("m")).alias("phrase"), "a")
    held = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    kept = durable(best.join(held, ["lang", "phrase"], "left").filter(F.col("longest").isNull() | (F.col("longest") < F.col("a"))).drop("longest"))
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    salts = min(512, 1 + kept.count() // 100_000)  # a language's phrases are ordered in parts first
    some = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
n AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
grams AS (
  SELECT lang, unnest(list_transform(range(1, len(words) - size + 2), lambda i: array_to_string(words[i:i + size - 1], ' '))) AS phrase, size
  FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS size) WHERE len(words) >= size
),
f AS (SELECT lang, phrase, size, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS words FROM f WHERE size > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, n.n, 1000 * c.a::HUGEINT * n.n // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.words[1:k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.words[k + 1:], ' ') JOIN n ON n.lang = c.lang
),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.size > len(string_split(b.phrase, ' ')) AND c.a >= b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
) WHERE rank <= 2000
"""
