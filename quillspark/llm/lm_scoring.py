"""Language-model scoring by deleted interpolation of word bigrams.

P(w | h) = a f(w | h) + b f(w) + c / (V + 1), with maximum-likelihood estimates f and weights (a, b, c) for
each bucket of the context's frequency (powers of two). The weights are learned by expectation-maximisation on
counts of held-out documents: one tenth of all (crc32 of the id mod 10 is 1) is deleted from the training counts
for that; the scores then use all training documents, those whose crc32 mod 10 isn't 0.

No table of n-grams is ever in one place. Texts are cut into blocks of some MB, as word codes (the deleted
documents in blocks of their own). A block asks for its distinct words and bigrams, as 64-bit hashes with its own
counts; the asking blocks of one hash range meet in a task, which adds up the counts and answers each block in
the order in which it asked, so that answers need no keys. The answers come back to the block, which then has the
corpus counts of everything in it. A frequent word is asked for once a block, however often it occurs.

Only block and shard totals and a histogram of bounded size, on which the weights are learned, reach the driver.

Ids are whole numbers. Defined cases: null text is empty and is the end token alone; a null id counts as the empty text for the fold;
rows that repeat an id are scored, and teach, each for itself; a very long text is a block of its own; without training documents every token has
probability 1 / (V + 1) with V = 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import durable, expand, id_crc, pieces, squeeze, table
from quillspark.llm.tokens import coded_words

BLOCK_CHARS, SHARD_KEYS, BUCKETS, STEP, ROUNDS = 5 << 20, 1_000_000, 24, 4, 200
#: Tasks of an exchange at most; beyond it a task takes several hash ranges or blocks, one after the other.
MOST_TASKS = 20_000
END_HASH, START_HASH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def _blocks(block_chars: int):
    """Rows (doc_id, fold, text) to blocks; one row a block."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, number = TaskContext.get(), 0

        def block(rows):
            nonlocal number
            ids, folds, texts = zip(*rows)
            codes, vocabulary, counts = coded_words(texts)
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in vocabulary], dtype=np.uint64)
            order = np.argsort(hashes)
            place = np.empty(len(order), dtype=np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            number += 2
            taught = sum(int(c) + 1 for c, f in zip(counts, folds) if f != 0)
            gaps = np.diff(hashes[order], prepend=np.uint64(0))
            return [(context.partitionId() << 32) + number + (folds[0] == 1), list(ids), list(folds), counts.tolist(), len(order), squeeze(gaps), len(codes), squeeze(place[codes]), taught, folds[0] == 1]

        def batch(row):
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _TYPES)], names=_NAMES)

        held: dict[bool, list] = {False: [], True: []}
        size = {False: 0, True: 0}
        for b in pieces(batches, "text"):
            for doc, fold, text in zip(*(c.to_pylist() for c in b.columns)):
                deleted = fold == 1
                held[deleted].append((doc, fold, text))
                size[deleted] += len(text or "") + 16
                if size[deleted] >= block_chars:
                    yield batch(block(held[deleted]))
                    held[deleted], size[deleted] = [], 0
        for rows in held.values():
            if rows:
                yield batch(block(rows))

    return cut


_NAMES = ["block", "ids", "folds", "counts", "n_words", "words", "n_codes", "codes", "taught", "deleted"]
_TYPES = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.bool_()]
_BLOCK = "block long, ids array<long>, folds array<int>, counts array<long>, n_words long, words binary, n_codes long, codes binary, taught long, deleted boolean"


class Block:
    """A block's token stream: contexts and tokens as codes, with its distinct words and bigrams."""

    def __init__(self, row):
        gaps = expand(row.words, row.n_words, "<u8")[0]
        codes = expand(row.codes, row.n_codes, "<u4")[0].astype(np.int64)
        v, counts = int(row.n_words), np.asarray(row.counts, dtype=np.int64)
        self.ids, self.folds, self.lengths = row.ids, np.asarray(row.folds), counts + 1
        hashes = np.r_[np.cumsum(gaps), END_HASH, START_HASH].astype(np.uint64)  # code v: end, v + 1: start
        ends = np.cumsum(counts)
        self.token = np.insert(codes, ends, v)
        self.context = np.insert(codes, ends - counts, v + 1)
        self.doc = np.repeat(np.arange(len(counts), dtype=np.int32), self.lengths)
        pairs, self.pair = np.unique(self.context * (v + 2) + self.token, return_inverse=True)
        self.pair = self.pair.astype(np.int32)
        self.pair_context, self.pair_token = np.divmod(pairs, v + 2)
        with np.errstate(over="ignore"):
            keys = (hashes[self.pair_context] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (hashes[self.pair_token] * np.uint64(0x165667B19E3779F9) + np.uint64(0x27D4EB2F165667C5))
            keys = (keys ^ keys >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            keys ^= keys >> np.uint64(32)
        self.v, self.keys = v, {0: hashes[: v + 1], 1: keys}
        self.order = {k: np.argsort(x, kind="stable") for k, x in self.keys.items()}

    def own_counts(self, kind: int, rows: np.ndarray) -> np.ndarray:
        """Occurrences, in the documents of ``rows`` (a mask), of each word (0) or bigram (1)."""
        use = rows[self.doc]
        return np.bincount((self.pair if kind else self.token)[use], minlength=len(self.keys[kind])).astype(np.uint64)

    def answers(self, kind: int, replies: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Corpus counts of each word or bigram: (training without the deleted, deleted)."""
        own = replies[replies["kind"] == kind].sort_values("shard")
        fit, dev = (np.concatenate(x) if len(own) else np.zeros(0, np.uint64) for x in (zip(*(expand(r.payload, r.n, "<u8", "<u8") for r in own.itertuples())) if len(own) else ((), ())))
        out = []
        for x in (fit, dev):
            y = np.zeros(len(x), dtype=np.int64)
            y[self.order[kind]] = x
            out.append(y)
        return out[0], out[1]


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)  # ascending with the key


def _requests(shards: int):
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                block, out = Block(row), []
                for kind in (0, 1):
                    order = block.order[kind]
                    keys = block.keys[kind][order]
                    fit = block.own_counts(kind, (block.folds != 0) & (block.folds != 1))[order]
                    dev = block.own_counts(kind, block.folds == 1)[order]
                    shard = _shard(keys, shards)
                    cuts = np.r_[0, np.flatnonzero(np.diff(shard)) + 1, len(shard)]
                    for a, b in zip(cuts[:-1], cuts[1:]):
                        if b > a:
                            out.append((kind, int(shard[a]), row.block, int(b - a), squeeze(np.diff(keys[a:b], prepend=np.uint64(0)), fit[a:b], dev[a:b])))
                yield pd.DataFrame(out, columns=["kind", "shard", "block", "n", "payload"])

    return ask


def _total(pdf: pd.DataFrame) -> pd.DataFrame:
    """Adds up one hash range's counts, and answers each block in its own order."""
    parts = [expand(r.payload, r.n, "<u8", "<u8", "<u8") for r in pdf.itertuples()]
    keys = np.concatenate([np.cumsum(p[0]) for p in parts])
    distinct, at = np.unique(keys, return_inverse=True)
    fit, dev = np.zeros((2, len(distinct)), dtype=np.uint64)  # counts of a corpus: a common word passes 2^32
    for total, k in ((fit, 1), (dev, 2)):
        np.add.at(total, at, np.concatenate([p[k] for p in parts]))
    cuts = np.cumsum([0, *pdf["n"]])
    known = [int(((fit + dev) > 0).sum()), int((fit > 0).sum())]
    payloads = [squeeze(fit[at[a:b]], dev[at[a:b]]) for a, b in zip(cuts[:-1], cuts[1:])]
    first = np.arange(len(pdf)) == 0  # a shard's totals are told once
    return pd.DataFrame({"kind": pdf["kind"], "shard": pdf["shard"], "block": pdf["block"], "n": pdf["n"], "payload": payloads, "known": np.where(first, known[0], 0), "known_fit": np.where(first, known[1], 0)})


def bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(count + 1.0)), BUCKETS - 1).astype(np.int64)


def ratios(block: Block, words: np.ndarray, pairs: np.ndarray, total: float, v: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each bigram of the block: its context's bucket, f(w | h) (V + 1) and f(w) (V + 1)."""
    count = np.r_[words, words[-1]]  # the start is as frequent as the end
    context = count[block.pair_context]
    return bucket(context), pairs / np.maximum(context, 1) * (v + 1), words[block.pair_token] / max(total, 1) * (v + 1)


def learn(hist: pd.DataFrame) -> np.ndarray:
    """Weights (a, b, c) of each bucket by expectation-maximisation. hist: bucket, n, bigram and unigram (mean ratios)."""
    out = np.tile([0.4, 0.5, 0.1], (BUCKETS, 1))
    out[0] = 0, 0.8, 0.2
    for k, own in hist.groupby("bucket"):
        r = np.column_stack([own["bigram"], own["unigram"], np.ones(len(own))])
        n, w = own["n"].to_numpy(float), np.array([0.4, 0.4, 0.2])
        for _ in range(ROUNDS):
            share = r * w
            share /= share.sum(axis=1, keepdims=True)
            w = np.maximum((share * n[:, None]).sum(axis=0) / n.sum(), 1e-6)
            w /= w.sum()
        out[int(k)] = w
    return out


def score(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", block_chars: int = BLOCK_CHARS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), id_crc(doc_id, 10).cast("int").alias("fold"), F.col(text).alias("text"))
    blocks = durable(rows.mapInArrow(_blocks(block_chars), _BLOCK), texts=True)
    n_blocks, tokens, taught, deleted = blocks.agg(F.count("*"), F.sum(F.col("n_codes") + F.size("ids")), F.sum("taught"), F.sum(F.when(F.col("deleted"), F.col("taught")))).first()
    n, n_fit = float(taught or 0), float((taught or 0) - (deleted or 0))
    shards = max(1, -(-(tokens or 0) // shard_keys))
    asked = blocks.mapInPandas(_requests(shards), "kind int, shard int, block long, n long, payload binary").repartition(min(2 * shards, MOST_TASKS), "kind", "shard")  # a hash range or two a task
    replies = durable(asked.groupBy("kind", "shard").applyInPandas(_total, "kind int, shard int, block long, n long, payload binary, known long, known_fit long"))
    v, v_fit = (float(x or 0) for x in replies.filter("kind = 0").agg(F.sum("known"), F.sum("known_fit")).first())

    together = lambda df: df.repartition(min(max(1, n_blocks // 2), MOST_TASKS), "block").groupBy("block")  # noqa: E731  a block or few a task

    def gather(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in mine.itertuples():
            block = Block(row)
            words, pairs = block.answers(0, theirs)[0], block.answers(1, theirs)[0]
            at, r2, r1 = ratios(block, words, pairs, n_fit, v_fit)
            seen = block.own_counts(1, block.folds == 1).astype(np.int64)
            use = seen > 0
            bins = [np.where(r > 0, np.round(np.log2(np.maximum(r, 1e-12)) * STEP), -999).astype(np.int64)[use] for r in (r2, r1)]
            out.append(pd.DataFrame({"bucket": at[use], "b2": bins[0], "b1": bins[1], "n": seen[use], "s2": r2[use] * seen[use], "s1": r1[use] * seen[use]}).groupby(["bucket", "b2", "b1"], as_index=False).sum())
        return pd.concat(out) if out else pd.DataFrame({"bucket": [], "b2": [], "b1": [], "n": [], "s2": [], "s1": []})

    odd = F.col("block") % 2 == 1  # blocks of deleted documents
    told = together(blocks.filter(odd)).cogroup(together(replies.filter(odd))).applyInPandas(gather, "bucket long, b2 long, b1 long, n long, s2 double, s1 double")
    hist = told.groupBy("bucket", "b2", "b1").agg(F.sum("n").alias("n"), F.sum("s2").alias("s2"), F.sum("s1").alias("s1")).toPandas()  # a bounded number of bins
    weights = learn(hist.assign(bigram=hist["s2"] / hist["n"], unigram=hist["s1"] / hist["n"]))

    def finish(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in mine.itertuples():
            block = Block(row)
            words, pairs = (sum(block.answers(k, theirs)) for k in (0, 1))
            at, r2, r1 = ratios(block, words, pairs, n, v)
            log = np.log10((weights[at] * np.column_stack([r2, r1, np.ones(len(r1))])).sum(axis=1) / (v + 1))
            base = np.log10((words + 0.1) / (n + 0.1 * (v + 1)))
            add = lambda x: np.bincount(block.doc, weights=x, minlength=len(block.ids))  # noqa: E731, B023
            out.append(pd.DataFrame({
                "doc_id": pd.array(block.ids, dtype="Int64"), "held_out": block.folds == 0, "n_tokens": block.lengths, "n_known": add(words[block.token] > 0).astype(np.int64),
                "train_tokens": int(n), "base_score": add(base[block.token]), "score": add(log[block.pair]),
            }))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")})

    return together(blocks).cogroup(together(replies)).applyInPandas(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_lm_scoring(spark, sf_dir) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
