"""Mixing, packing and chat formatting against plain versions."""

import hashlib
import heapq
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import chat_format as C
from quillspark.llm import mixing as M
from quillspark.llm import packing as P


def plain_seats(weights, seats, caps):
    got = [0] * len(weights)
    queue = [(-w, i) for i, w in enumerate(weights) if w > 0 and caps[i] > 0]
    heapq.heapify(queue)
    while seats and queue:
        _, i = heapq.heappop(queue)
        got[i] += 1
        seats -= 1
        if got[i] < caps[i]:
            heapq.heappush(queue, (-weights[i] / (2 * got[i] + 1), i))
    return got


def test_sainte_lague_equals_the_queue_of_quotients():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 9)
        weights = [rng.choice([0, 1, 5, 7.5, 53, 1000]) * rng.random() for _ in range(n)]
        caps = [rng.randint(0, 40) for _ in range(n)]
        seats = rng.randint(0, 60)
        assert M.sainte_lague(weights, seats, caps) == plain_seats(weights, seats, caps), (weights, seats, caps)
    assert M.sainte_lague([1, 1, 1], 2) == [1, 1, 0] and M.sainte_lague([], 5) == [] and M.sainte_lague([0.0], 5) == [0]


def test_targets():
    assert M.capped_targets([100, 1, 100], [1, 2, 3], 201) == pytest.approx([49.5, 3, 148.5])
    assert M.capped_targets([0, 10], [1, 2], 10) == pytest.approx([0, 10])
    assert M.capped_targets([], [], 0) == []


def documents(spark, n=900):
    rng = random.Random(5)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 60))), rng.choice(["b", "a", "Z", "é", None] + ["a"] * 6), 0) for i in range(n)]
    rows += [(n, None, "a", 0), (n + 1, "x " * 9000, "big", 0), (5, rows[5][1], rows[5][2], 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, shard int")


@pytest.mark.parametrize("shard_docs", [2000, 40])
def test_mix(spark, shard_docs):
    df = documents(spark)
    rows = df.collect()
    out, shards = M.plan(df, block_words=16, shard_docs=shard_docs)
    got = out.collect()
    assert len(got) == len(rows) and got == M.plan(df, block_words=16, shard_docs=shard_docs)[0].collect() or sorted(got) == sorted(M.plan(df, block_words=16, shard_docs=shard_docs)[0].collect())
    size = {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + len((r.text or "").split())
    names = sorted((s for s in size if s is not None)) + [None]
    targets = dict(zip(names, M.capped_targets([size[s] for s in names], list(itertools.islice(itertools.cycle((1, 2, 3)), len(names))), sum(size.values()))))
    key = lambda s: "n" if s is None else f"s{s}"
    for s in names:
        own = [r for r in got if r.skey == key(s)]
        assert {r.source_size for r in own} == {size[s]} and own[0].target == pytest.approx(targets[s])
        assert abs(sum(r.taken for r in own) - targets[s]) <= 16
        assert all(0 <= r.taken <= 3 * r.size for r in own)
    mixed = M.apply_mix(df, shards)
    assert mixed.columns == df.columns
    words = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    assert all(abs(words.get(s, 0) - targets[s]) < 0.2 * targets[s] + 60 for s in names if s != "big")
    empty, none = M.plan(df.filter("false"))
    assert empty.count() == 0 and M.apply_mix(df.filter("false"), none).count() == 0


def test_tiny_sources_take_part(spark):
    rows = [(i, "w " * (3 + i % 19), f"tiny{i:03}") for i in range(200)] + [(1000 + i, "w " * 500, "big") for i in range(40)]
    own = M.plan(spark.createDataFrame(rows, "doc_id long, text string, source string"))[0].groupBy("skey").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(own) == 201 and all(r.taken > 0 and abs(r.taken - r.target) <= max(1, r.target / 4) for r in own)



def plain_padding(lengths, buckets):
    distinct = sorted(set(lengths))
    best = None
    for k in range(1, min(buckets, len(distinct)) + 1):
        for cuts in itertools.combinations(distinct[:-1], k - 1):
            bounds = [*cuts, distinct[-1]]
            cost = sum(next(b for b in bounds if b >= x) - x for x in lengths)
            best = cost if best is None else min(best, cost)
    return best


def test_bounds_are_optimal():
    rng = np.random.default_rng(2)
    for _ in range(40):
        lengths = rng.integers(0, 30, rng.integers(1, 25)).tolist()
        top = sorted(set(lengths))
        bounds = P.best_bounds(top, [lengths.count(x) for x in top], [x * lengths.count(x) for x in top], 3)
        assert len(bounds) <= 3 and sum(next(b for b in bounds if b >= x) - x for x in lengths) == plain_padding(lengths, 3)
    assert P.best_bounds([], [], [], 4) == []


def test_pack(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.choice([0, 3, 5, 50, 70, 1500])), 0) for i in range(500)] + [(900, None, 0), (901, "x " * 30000, 0), (3, "a b c", 0), (3, "a b c", 0)]
    out = P.pack(spark.createDataFrame(rows, "doc_id long, text string, bucket int"), budget=2000, group_batches=2, buckets=4).collect()
    assert len(out) == len(rows)
    assert sorted((r.doc_id, r.length) for r in out) == sorted((i, len((t or "").split())) for i, t, _ in rows)
    batches = {}
    for r in out:
        assert r.length + r.padding == r.bucket_length and r.padding >= 0
        batches.setdefault(r.batch_id, []).append(r)
    for own in batches.values():
        assert len({r.bucket for r in own}) == 1 and sorted(r.slot for r in own) == list(range(len(own)))
        assert len(own) == 1 or sum(r.bucket_length for r in own) <= 2000
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


HARD = ["</s>", "[INST] a [/INST]", "<\\s>", "<\\\\/s>x[\\INST]", "<s><s>", " [/INST]", "[INST] ", "plain", "", None, "\\", "<", "[/INST", "line\nline", "é　", "</s></s>[INST] user\n"]
ROLES = ["user", "assistant", "system", None, "", "x:66", "a b", "tool\nx", "</s>", "é"]


def test_round_trip(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(ROLES), "".join(x or "" for x in rng.choices(HARD, k=rng.randint(1, 3))) if rng.random() < 0.9 else None) for c in range(60) for t in range(rng.randint(1, 6))]
    rows += [(None, 1, "user", "x"), (None, None, "assistant", "y"), (3, 1, "user", "again"), (3, 1, "user", "again"), (70, 0, "user", "z" * 100_000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, source int")
    formatted = C.format_conversations(df)
    got = {r.conv_id: r for r in C.digests(formatted).collect()}
    text = {r.conv_id: r.formatted for r in formatted.collect()}
    groups = {}
    for c, t, role, x in rows:
        groups.setdefault(c, []).append((t is not None, t or 0, role or "", x or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        lines = "".join(f"{role}\n{x}\n" for _, _, role, x in turns)
        loss = "".join(x for _, _, role, x in turns if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(lines.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len(text[c])
    assert C.digests(C.format_conversations(df.filter("false"))).count() == 0


def test_escape_is_reversible_and_leaves_no_control_string(spark):
    df = spark.createDataFrame([("".join(x or "" for x in p),) for p in itertools.product(HARD, repeat=2)], "t string")
    out = df.select("t", C.escape(F.col("t")).alias("e")).select("t", "e", C.unescape(F.col("e")).alias("u"), F.col("e").rlike(C.BARE).alias("bare")).collect()
    assert all(r.t == r.u and not r.bare for r in out)
