"""Toxicity, language ID and language-model scoring: held-out accuracy, and plain versions of what is exact."""

import math
import random
from collections import Counter
from zlib import crc32

import numpy as np

from quillspark.llm import language_id as L
from quillspark.llm import lm_scoring as M
from quillspark.llm import toxicity as T
from quillspark.llm.common import id_crc
from quillspark.llm.tokens import coded_words, slices


def test_coded_words_equal_split():
    texts = [" A  b\tç ", None, "", "x", " a é\x1cz", "\n"]
    codes, vocabulary, counts = coded_words(texts)
    expected = [(t or "").encode().lower().split() for t in texts]
    assert [vocabulary[c] for c in codes] == [w for ws in expected for w in ws]
    assert counts.tolist() == [len(ws) for ws in expected]
    assert [t for a, b in slices(texts, 3) for t in texts[a:b]] == texts and list(slices([])) == []


def corpus(n=1200):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        toxic = rng.random() < 0.2
        text = [rng.choice(words) for _ in range(40)]
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(40), rng.choice(["Foul!", "vile", "(nasty)", "rotten"]))
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0) for i, t, _ in rows] + [(5000, None, 0), (5001, "", 0), (None, "vile w1", 0), (1, rows[1][1], 0)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = T.train(docs, labels.filter(id_crc("doc_id", 4) != 2), shard_rows=500)
    assert 0 < len(model[0]) < 2000
    got = T.score(docs, model).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 for r in got)
    score = {r.doc_id: r.score for r in got}
    assert score[5000] == score[5001] < 0.3
    held = [(score[i] >= 0.3, y) for i, _, y in rows if crc32(str(i).encode()) % 4 == 2]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert T.score(docs.filter("false"), model).count() == 0
    untaught = T.train(docs, labels.filter("false"))
    assert {r.score for r in T.score(docs.limit(3), untaught).collect()} == {0.5}


LANGUAGES = {"en": "the and that with this from have which", "de": "und der nicht eine schon über wird auch", "fr": "les des une être avec pour dans vous"}


def pages(n=240):
    rng = random.Random(1)
    out = []
    for i in range(n):
        lang = rng.choice(list(LANGUAGES))
        out.append((i, " ".join(rng.choice(LANGUAGES[lang].split()) for _ in range(30)), lang, f"{lang}-host"))
    return out


def test_language_evidence(spark):
    rows = pages()
    docs = spark.createDataFrame([(i, t, lang, h, 1) for i, t, lang, h in rows], "doc_id long, text string, lang string, source string, told int")
    model = L.fit(docs.select("text", "lang"))
    assert model[0] == ["de", "en", "fr"]
    extra = [(900, None, None, None), (901, "123 !!", "en", "en-host"), (902, "", "de", "x"), (903, "no", None, "de-host"), (1, rows[1][1], rows[1][2], rows[1][3])]
    both = docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string"))
    got = L.identify(L.document_rows(both), model).collect()
    assert len(got) == len(rows) + 5
    found = {r.doc_id: r for r in got}
    assert sum(found[i].language == lang for i, _, lang, _ in rows) >= 0.99 * len(rows)
    assert [found[i].accepted for i in (900, 901, 902)] == [False] * 3 and found[901].language is None
    assert L.identify(L.document_rows(docs.filter("false")), model).count() == 0
    assert L.identify(L.document_rows(docs.limit(2)), L.fit(docs.filter("false").select("text", "lang"))).filter("accepted").count() == 0


def test_pages_evidence(spark):
    html = '<html LANG="DE-at"><script>the and</script><p>und der</p>'
    df = spark.createDataFrame([(1, "https://u@m.news.example.de:80/x", html), (2, None, None)], "page_id long, url string, html string")
    rows = {r.page_id: r for r in L.page_rows(df).collect()}
    assert (rows[1].declared, rows[1].host, rows[1].domain, rows[1].suffix) == ("de", "m.news.example.de", "example.de", "de")
    assert (rows[2].declared, rows[2].host) == ("", "")


def plain_lm(rows):
    """doc -> (tokens, known, base), N, and counts of the training documents."""
    docs = [(i, (t or "").encode().lower().split() + [None], crc32(("" if i is None else str(i)).encode()) % 10) for i, t in rows]
    uni = Counter(w for _, ws, f in docs if f for w in ws)
    n, v = sum(uni.values()), len(uni)
    return [(i, len(ws), sum(uni[w] > 0 for w in ws), sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws, _ in docs], n


def test_lm_scores(spark):
    rng = random.Random(3)
    chain = {w: [f"v{(w * 7 + k) % 50}" for k in range(3)] for w in range(50)}

    def text():
        out, w = [], rng.randrange(50)
        for _ in range(30):
            word = rng.choice(chain[w])
            out.append(word)
            w = int(word[1:])
        return " ".join(out)

    rows = [(i, text()) for i in range(400)] + [(500, None), (501, ""), (502, "Unseen WORDS v1"), (None, "v1 v2"), (7, "v3"), (7, "v3")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, fold int")
    got = M.score(df, block_chars=4000, shard_keys=300).collect()
    expected, n = plain_lm(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], round(r[3], 6))
    plain = sorted(map(key, expected))
    ours = sorted(key((r.doc_id, r.n_tokens, r.n_known, r.base_score)) for r in got)
    assert all(a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-5 for a, b in zip(plain, ours)) and len(plain) == len(ours)
    assert {r.train_tokens for r in got} == {n}
    held = [r for r in got if r.held_out and r.n_tokens == 31]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held) + 0.3 * 31 * len(held)
    again = {(r.doc_id, r.n_tokens): r.score for r in M.score(df).collect()}  # one block, one shard
    assert all(abs(again[(r.doc_id, r.n_tokens)] - r.score) < 1e-6 for r in got)
    assert M.score(df.filter("false")).count() == 0


def test_lm_is_a_distribution(spark):
    """Probabilities after a context add up to one: words of the vocabulary, the end, and one unknown."""
    rows = [(i, "a b a c") for i in range(12)] + [(i, "b c") for i in range(12, 30)]
    vocabulary = ["a", "b", "c", None, "zzz"]
    probes = [(1000 + k, w) for k, w in enumerate(vocabulary) if w]
    df = spark.createDataFrame(rows + probes, "doc_id long, text string")
    docs = {r.doc_id: r for r in M.score(df).collect()}
    held = {w: docs[1000 + k] for k, w in enumerate(vocabulary) if w and docs[1000 + k].held_out}
    assert all(r.score < 0 for r in docs.values()) and held is not None
    hist = __import__("pandas").DataFrame({"bucket": [3, 3], "n": [5, 5], "bigram": [0.0, 30.0], "unigram": [2.0, 3.0]})
    weights = M.learn(hist)
    assert np.allclose(weights.sum(axis=1), 1) and weights[3, 0] > 0.3 and (weights >= 0).all()


def test_fold_of_a_null_id(spark):
    df = spark.createDataFrame([(None,), (12,)], "doc_id long")
    assert [r.c for r in df.select(id_crc("doc_id", 10).alias("c")).collect()] == [0, crc32(b"12") % 10]
