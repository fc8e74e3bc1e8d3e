"""Operators against plain versions of themselves, and every opN_ query on small whole tables."""

import math
import random
from collections import Counter, defaultdict
from types import SimpleNamespace
from zlib import crc32

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import language_id as L
from quillspark.llm import lm_scoring as M
from quillspark.llm import mixing as X
from quillspark.llm import packing as P
from quillspark.llm import queries
from quillspark.llm import toxicity as T
from quillspark.llm.common import fresh, pieces, sampled
from quillspark.sources.stored import shared_folder

M64 = (1 << 64) - 1


def test_samples_are_never_empty(spark):
    rows = spark.range(200_000)
    assert 800 < rows.filter(sampled(200_000, 1000, 3, "id")).count() < 1200
    assert rows.filter(sampled(200_000, 200_000, 3, "id")).count() == 200_000
    huge = -(-4000 * (1 << 62) // 10**14)  # a share of 4,000 in a hundred thousand billion rows
    assert huge > 0 and str(huge) in str(sampled(10**14, 4000, 3, "id"))


def test_a_cluster_without_a_shared_folder_is_refused():
    def session(master):
        context = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: {}, master=master, setCheckpointDir=lambda folder: None)
        return SimpleNamespace(sparkContext=context)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session("spark://host:7077"))
    assert shared_folder(session("local[4]")) is None


def test_batches_are_cut_by_bytes():
    import pyarrow as pa

    texts = ["x" * 50, None, "y" * 5000, "", "z" * 90] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(15)), pa.array(texts)], names=["n", "text"])
    cut = list(pieces(iter([batch]), "text", at_once=1000))
    assert len(cut) > 3 and [n for b in cut for n in b.column("n").to_pylist()] == list(range(15))
    assert [t for b in cut for t in b.column("text").to_pylist()] == texts and list(pieces(iter([batch.slice(0, 0)]), "text")) == []


def test_counts_beyond_32_bits_add_up():
    keys, many = np.array([3, 9], dtype=np.uint64), np.array([(1 << 32) - 1, 5], dtype=np.uint64)
    payload = M.squeeze(np.diff(keys, prepend=np.uint64(0)), many, many)
    pdf = pd.DataFrame({"kind": [0, 0], "shard": [0, 0], "block": [2, 4], "n": [2, 2], "payload": [payload, payload]})
    fit, dev = M.expand(M._total(pdf)["payload"][0], 2, "<u8", "<u8")
    assert fit.tolist() == dev.tolist() == [2 * ((1 << 32) - 1), 10]


# --- toxicity -------------------------------------------------------------------------------------


def plain_features(text, bits=20):
    import xxhash

    words = [xxhash.xxh64_intdigest(w.strip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")) for w in (text or "").encode().lower().split()]
    found = {w * 0x9E3779B97F4A7C15 & M64 for w in words}
    for gap, mixer in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
        found |= {(a * 3 + (b ^ mixer)) * mixer & M64 for a, b in zip(words, words[gap:])}
    return {f >> 64 - bits for f in found}


def plain_ftrl(examples, epochs=3):
    """FTRL-proximal step by step, one coordinate at a time; the bias isn't regularised."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        one = 0.0 if i == "bias" else T.L1
        return 0.0 if abs(z[i]) <= one and i != "bias" else -(z[i] - math.copysign(one, z[i])) / ((T.BETA + math.sqrt(n[i])) / T.ALPHA + (0 if i == "bias" else T.L2))

    for _ in range(epochs):
        for features, label in examples:
            own = {i: weight(i) for i in [*features, "bias"]}
            g = 1 / (1 + math.exp(-sum(own.values()))) - label
            for i, w in own.items():
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / T.ALPHA * w
                n[i] += g * g
    return {i: weight(i) for i in z if i != "bias" and weight(i)}, weight("bias")


def test_toxicity_equals_plain_ftrl(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(12)) + (" Vile, foul!" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(90)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "x " * 50_000 + "vile foul")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    at, w, bias = T.train(docs, labels)
    order = pd.DataFrame(rows, columns=["doc_id", "text", "toxic"]).sort_values(["doc_id", "text"], kind="stable").sample(frac=1.0, random_state=9)
    weights, b = plain_ftrl([(plain_features(t), y) for t, y in zip(order["text"], order["toxic"])])
    assert set(at.tolist()) == set(weights) and all(abs(weights[i] - x) < 1e-9 for i, x in zip(at.tolist(), w)) and abs(b - bias) < 1e-9
    for r in T.score(docs, (at, w, bias)).collect():
        text = docs.filter(F.col("doc_id") == r.doc_id).first().text
        assert abs(r.score - 1 / (1 + math.exp(-b - sum(weights.get(i, 0.0) for i in plain_features(text))))) < 1e-9


def test_repeated_ids_teach_a_bounded_number_of_rows(spark):
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("word"), F.col("id").cast("string")).alias("text"))
    model = T.train(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"), sample=50)
    assert np.isfinite(model[2])


# --- language -------------------------------------------------------------------------------------


def plain_grams(text):
    letters = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in (text or "").encode()).lower().split()
    data = b" " + b" ".join(letters) + b" " if letters else b""
    return [((a << 16 | b << 8 | c) * 2654435761 & 0xFFFFFFFF) >> 17 for a, b, c in zip(data, data[1:], data[2:])]


def plain_fusion(rows, languages, logs):
    """id -> (language, probability) by the stated products."""
    n, told = len(languages), {}
    for r in rows:
        g = plain_grams(r["text"])
        told[r["id"]] = [sum(logs[x][k] for x in g) * min(1, 150 / len(g)) for k in range(n)] if g else None
    best = {i: max(range(n), key=lambda k: t[k]) for i, t in told.items() if t}
    seen = {key: Counter((r[key], best[r["id"]]) for r in rows if r["id"] in best) for key in ("declared", "suffix", "domain", "host")}
    total = Counter(best.values())
    out = {}
    for r in rows:
        i = r["id"]
        if i not in best:
            out[i] = (None, 0.0)
            continue
        other = lambda key, k: seen[key][(r[key], k)] - (best[i] == k)  # noqa: E731, B023
        both = lambda key: sum(other(key, k) for k in range(n))  # noqa: E731, B023
        score = []
        for k in range(n):
            everywhere = (total[k] + 1) / (sum(total.values()) + n)
            domain = (other("domain", k) + 5 * everywhere) / (both("domain") + 5)
            host = (other("host", k) + 5 * domain) / (both("host") + 5)
            ratio = [max((other(key, k) + 5 * everywhere) / ((both(key) + 5) * everywhere), 1e-3) for key in ("declared", "suffix")]
            score.append(told[i][k] + math.log(host) + sum(map(math.log, ratio)))
        top = max(range(n), key=lambda k: score[k])
        p = 1 / sum(math.exp(s - score[top]) for s in score)
        out[i] = (languages[top] if p >= 0.5 else None, p)
    return out


def test_language_equals_plain_fusion(spark):
    rng = random.Random(5)
    words = {"en": "the and that with this", "de": "und der nicht eine über", "fr": "les des une être avec"}
    texts = [(i, " ".join(rng.choice(words[(lang := rng.choice(list(words)))].split()) for _ in range(rng.randint(2, 12))), lang) for i in range(80)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    languages, logs = L.fit(docs.select("text", "lang"))
    texts.append((500, "die und " * 60_000, "de"))
    pages = [{"id": i, "text": t if i % 9 else None, "declared": rng.choice(["en", "de", "fr", ""]), "suffix": lang, "domain": f"d{i % 4}.{lang}", "host": f"h{i % 8}.d{i % 4}.{lang}"} for i, t, lang in texts]
    rows = spark.createDataFrame([tuple(p.values()) for p in pages], "page_id long, text string, declared string, suffix string, domain string, host string")
    got = {r.page_id: r for r in L.identify(rows, (languages, logs)).collect()}
    expected = plain_fusion(pages, languages, logs)
    assert set(got) == set(expected)
    for i, (language, p) in expected.items():
        assert got[i].language == language and abs(got[i].probability - p) < 1e-9, i
    assert {i for i, r in got.items() if not r.accepted} == {i for i, (language, _) in expected.items() if language is None}


# --- language model -------------------------------------------------------------------------------


def plain_model(rows):
    """probability(context, word), and rows' scores: deleted interpolation of bigrams with the weights of each bucket."""
    docs = [(i, ["<s>", *(t or "").lower().split(), "</s>"], crc32(("" if i is None else str(i)).encode()) % 10) for i, t in rows]

    def counted(folds):
        words, pairs = Counter(), Counter()
        for _, w, fold in docs:
            if fold in folds:
                words.update(w[1:])
                pairs.update(zip(w, w[1:]))
        words["<s>"] = words["</s>"]
        return words, pairs, sum(words.values()) - words["<s>"], len(words) - ("<s>" in words)

    def ratios(model, h, w):
        words, pairs, n, v = model
        return pairs[(h, w)] / max(words[h], 1) * (v + 1), words[w] / max(n, 1) * (v + 1)

    bucket = lambda c: min(math.ceil(math.log2(c + 1)), M.BUCKETS - 1)
    fit, bins = counted(range(2, 10)), defaultdict(lambda: [0, 0.0, 0.0])
    for pair, times in counted([1])[1].items():
        r2, r1 = ratios(fit, *pair)
        at = (bucket(fit[0][pair[0]]), *(round(math.log2(r) * M.STEP) if r > 0 else -999 for r in (r2, r1)))
        bins[at] = [a + b for a, b in zip(bins[at], (times, r2 * times, r1 * times))]
    hist = pd.DataFrame([(k[0], n, a / n, b / n) for k, (n, a, b) in bins.items()], columns=["bucket", "n", "bigram", "unigram"])
    weights, model = M.learn(hist), counted(range(1, 10))

    def probability(h, w):
        a, b, c = weights[bucket(model[0][h])]
        r2, r1 = ratios(model, h, w)
        return (a * r2 + b * r1 + c) / (model[3] + 1)

    return probability, model, [(i, sum(math.log10(probability(h, w)) for h, w in zip(ws, ws[1:]))) for i, ws, _ in docs]


def test_lm_equals_plain_interpolation_and_adds_up_to_one(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(f"v{min(rng.randrange(30), rng.randrange(30))}" for _ in range(rng.randint(0, 25)))) for i in range(300)] + [(None, "v1 v2"), (900, None), (901, "never seen v1 v1"), (902, "v1 v2 " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    probability, model, expected = plain_model(rows)
    key = lambda r: (r[0] is not None, r[0] or 0)
    for options in ({"block_chars": 900, "shard_keys": 100}, {}):
        got = sorted(((r.doc_id, r.score) for r in M.score(df, **options).collect()), key=key)
        assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-6 for a, b in zip(got, sorted(expected, key=key))) and len(got) == len(rows)
    vocabulary = [w for w in model[0] if w != "<s>"]
    for context in ("<s>", "v0", "v29"):
        assert abs(sum(probability(context, w) for w in vocabulary) + probability(context, "unseen") - 1) < 1e-9


# --- mixing and packing ---------------------------------------------------------------------------


def test_blocks_are_the_first_of_the_seeded_line(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 50), rng.choice(["a", "b", "b", None])) for i in range(700)] + [(9000, None, "a"), (9001, "w " * 3000, "b")]
    out = X.plan(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_words=16, shard_docs=60)[0].collect()
    by_source, shards = defaultdict(list), defaultdict(list)
    for r in out:
        by_source[r.skey].append(r)
        shards[(r.skey, r.shard)].append(r)
    keys = sorted(by_source, key=lambda k: (k == "n", k))
    sizes, targets = [sum(r.size for r in by_source[k]) for k in keys], [by_source[k][0].target for k in keys]

    def seats(weights, n, caps):
        got = [0] * len(weights)
        for _ in range(n):
            free = [i for i, w in enumerate(weights) if w > 0 and got[i] < caps[i]]
            if free:
                got[max(free, key=lambda i: (weights[i] / (2 * got[i] + 1), -i))] += 1
        return got

    quotas = X.sainte_lague(targets, round(sum(sizes) / 16), [math.ceil(3 * s / 16) for s in sizes])  # quotients of targets 1 : 2 : 3 tie but for rounding
    for key, quota in zip(keys, quotas):
        own = sorted(s for k, s in shards if k == key)
        words = [sum(r.size for r in shards[(key, s)]) for s in own]
        for s, w, q in zip(own, words, seats(words, quota, [math.ceil(3 * w / 16) for w in words])):
            left = min(q * 16, 3 * w)
            passes, rest = (left // w, left % w) if w else (0, 0)
            for r in sorted(shards[(key, s)], key=lambda r: (r.place, r.doc_id, r.size)):
                part = min(r.size, rest)
                assert r.taken == passes * r.size + part, r
                rest -= part


def test_binned_lengths_cost_little(spark):
    """Lengths over 1,024 words are binned at 1/64 for the programme: its padding is close to that without bins."""
    rng = np.random.default_rng(3)
    lengths = np.minimum(rng.lognormal(6.5, 1.1, 3000).astype(int) + 1, 30_000)
    df = spark.createDataFrame([(i, "w " * int(n)) for i, n in enumerate(lengths)], "doc_id long, text string")
    binned, full = (P.pack(df, exact=exact).agg(F.sum("padding")).first()[0] for exact in (1024, 1 << 30))
    assert full <= binned <= 1.02 * full


def test_short_documents_fill_batches(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    sizes = [r["count"] for r in P.pack(df).groupBy("batch_id").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) == 8192 and len(sizes) == 3


# --- queries --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(12)
    words = {"en": "the and that with this from have which", "de": "und der nicht eine schon wird auch"}
    line = lambda lang, n: " ".join(rng.choice(words[lang].split()) + rng.choice(["", "s", "t"]) for _ in range(n))
    docs = []
    for i in range(200):
        lang = rng.choice(list(words))
        docs.append((i, f"{line(lang, 40)}\n{line(lang, 30)}" + (" vile foul rotten" if i % 4 == 0 else ""), lang, f"src{i % 3}"))
    docs += [(300, docs[0][1], "en", "src0"), (301, None, None, None), (302, "", "en", "src1"), (303, "one", "en", "src1")]
    frames = {
        "documents": ([(*r, len(r[1] or ""), "x") for r in docs], "doc_id long, text string, lang string, source string, n_chars long, spans string"),
        "labels": ([(i, 1, int(i % 4 == 0)) for i in range(0, 200, 2)] + [(301, None, None)], "doc_id long, quality int, toxic int"),
        "embeddings": ([(i, [rng.gauss(0, 1) for _ in range(8)], 0) for i in range(120)] + [(500, None, 0)], "vec_id long, embedding array<float>, label int"),
        "pages": ([(i, f"https://h{i % 3}.example.{lang}/x", f'<html lang="{lang}"><p>{line(lang, 20)}</p>') for i, lang in enumerate(["en", "de"] * 20)] + [(90, None, None)], "page_id long, url string, html string"),
        "conversations": ([(c, t, role, f"text {c} {t} </s>") for c in range(9) for t, role in enumerate(["user", "assistant"])] + [(9, 0, None, None)], "conv_id long, turn long, role string, text string"),
    }
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return path, docs


CRC = lambda i: crc32(("" if i is None else str(i)).encode())
COLUMNS = {
    "op1_toxicity": {"doc_id", "held_out", "score", "predicted"}, "op2_simhash": {"doc_id", "fingerprint", "component_id"}, "op3_exact_topk": {"query_id", "rank", "vec_id", "score"},
    "op4_substring_dedup": {"doc_id", "text", "n_removed"}, "op5_packing": {"doc_id", "length", "bucket", "batch_id", "slot", "padding"}, "op6_ann": {"query_id", "rank", "vec_id", "score"},
    "op7_language_id": {"page_id", "language", "probability"}, "op8_chat_format": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
    "op9_lm_scoring": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}, "op10_mixing": {"doc_id", "size", "source_size", "target", "taken"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, folder, name):
    path, docs = folder
    got = queries.queries()[name](spark, path)
    assert COLUMNS[name] <= set(got.columns)
    rows = got.collect()
    if "doc_id" in got.columns:
        assert sorted(r.doc_id for r in rows) == sorted(d[0] for d in docs)
    if name == "op1_toxicity":
        assert all(r.held_out == (CRC(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
        own = [r for r in rows if r.held_out and r.doc_id < 200]
        assert sum(r.predicted == (r.doc_id % 4 == 0) for r in own) >= 0.95 * len(own)
    elif name == "op2_simhash":
        assert {r.component_id for r in rows if r.doc_id == 300} == {0} and all(len(r.fingerprint) == 16 and r.component_id <= r.doc_id for r in rows)
        assert {(r.fingerprint, r.component_id) for r in rows if r.doc_id in (301, 302)} == {("0" * 16, 301)}
    elif name in ("op3_exact_topk", "op6_ann"):
        assert {r.query_id for r in rows} == set(range(0, 120, 50 if name == "op3_exact_topk" else 20))
        assert Counter(r.query_id for r in rows).most_common()[-1][1] == (5 if name == "op3_exact_topk" else 20)
    elif name == "op7_language_id":
        assert len(rows) == 41 and sum(r.language == ["en", "de"][r.page_id % 2] for r in rows if r.page_id < 40) >= 38
    elif name == "op8_chat_format":
        assert {r.conv_id for r in rows} == {-7, *range(10)}
    elif name == "op9_lm_scoring":
        assert all(r.held_out == (CRC(r.doc_id) % 10 == 0) and r.n_known <= r.n_tokens and r.score < 0 for r in rows) and len({r.train_tokens for r in rows}) == 1
    elif name == "op10_mixing":
        assert all(0 <= r.taken <= 3 * r.size for r in rows) and sorted(rows) == sorted(queries.queries()[name](spark, path).collect())


def test_pipeline_query(spark, folder):
    path, docs = folder
    out = corpus_pipeline.run(spark, path)
    kept = {r.doc_id for r in out.collect()}
    assert {"doc_id", "length", "batch_id"} <= set(out.columns) and 300 not in kept and not kept & {301, 302} and len(kept) > 100


def test_stages_pass_columns_of_any_name(spark, folder):
    names = ["row_key", "skey", "shard", "place", "copies", "copy", "key", "islands", "cut", "fp", "id", "told", "likeliest", "score", "length", "bucket", "tag", "_row_key"]
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    wide = docs.select("*", *[F.lit(n).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got, plain = stage(spark, wide, folder[0]), stage(spark, docs, folder[0])
        assert got.columns == wide.columns, name
        assert sorted(got.select(*docs.columns).collect(), key=str) == sorted(plain.collect(), key=str), name
        assert all(r[n] == n for r in got.limit(5).collect() for n in names), name
    assert fresh(docs, "text", "new") == ["_text", "new"]
