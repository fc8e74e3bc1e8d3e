"""Collocations, URL filter and vector codes against brute force."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash

from quillspark.llm import collocations as C
from quillspark.llm import url_filter as U
from quillspark.llm import vector_codes as V

# --- collocations ---------------------------------------------------------------------------------


def texts(seed=5, n=80):
    rng = np.random.default_rng(seed)
    word = lambda: rng.choice(["a", "b", "C", "dé", "e", "ff", "Gg"], p=[0.3, 0.2, 0.15, 0.15, 0.1, 0.05, 0.05])
    rows = [(i, " ".join(word() + str(rng.choice(["", "", "", ",", ".\n", "\t"])) for _ in range(int(rng.integers(0, 60)))), [None, "en", "de", "und"][i % 4]) for i in range(n)]
    rows += [(900, None, "en"), (901, "", None), (902, "...\n\x0b;;", "en"), (903, "new york new york new york " * 40, "en"), (903, "new york new york new york " * 40, "en"), (None, "new\x0cyork", "en"), (904, "only", "xx")]
    return rows


def brute_phrases(rows, least, top):
    f, n = {}, Counter()
    for _, text, lang in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for size in range(1, 6):
                for i in range(len(words) - size + 1):
                    f.setdefault(lang or "und", Counter())[tuple(words[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        phrases = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in phrases.items():
            inside = any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in phrases.items())
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("how", [{}, {"block_chars": 300}, {"bits": 5, "block_chars": 700}, {"most": 0, "block_chars": 700}, {"most": 0, "bits": 6, "block_chars": 300}, {"most": 20, "block_chars": 500}])
def test_collocations(spark, how):
    rows = texts()
    docs = spark.createDataFrame([(i, t, x, "clash") for i, t, x in rows], "doc_id long, text string, lang string, phrase string").repartition(3)
    got = sorted(tuple(r) for r in C.collocations(docs, least=9, top=40, **how).collect())
    assert got == brute_phrases(rows, 9, 40)
    assert len(got) > 60


def test_longer_phrases_need_frequent_parts(spark):
    docs = spark.createDataFrame([("en", "a b c d x b c x c d x a b")], "lang string, text string")
    block = C.Block(docs.mapInArrow(C._cut(1 << 20), C._BLOCK).toPandas().iloc[0])
    sent = {n: [block.phrase(p, n) for p in places] for n, places in block.candidates([None, None])}
    assert len(sent[3]) == 11
    prints = lambda n, *phrases: np.sort([block.fingerprints(np.array([p]), n)[0] for p in range(14 - n) if block.phrase(p, n) in phrases])
    known = [prints(1, "a", "b", "c", "d"), prints(2, "a b", "b c", "c d"), prints(3, "a b c")]
    sent = {n: [block.phrase(p, n) for p in places] for n, places in block.candidates(known)}
    assert sent[3] == ["a b c", "b c d"] and sent[4] == []  # all pairs of "a b c d" are frequent, but not "b c d"


def test_beyond_the_broadcast_phrases_are_told_by_their_words(spark, monkeypatch):
    docs = spark.createDataFrame([("en", "a b a. c b a"), ("de", "a b")], "lang string, text string").coalesce(1)
    rows = docs.mapInArrow(C._cut(1 << 20), C._BLOCK).toPandas()
    hashed = C.xxhash.xxh64_intdigest
    monkeypatch.setattr(C.xxhash, "xxh64_intdigest", lambda x, seed=0: 7 if isinstance(x, bytes) else hashed(x, seed))  # words of one hash: no fingerprint tells their phrases apart
    monkeypatch.setattr(C, "PHRASES_AT_ONCE", 2)
    told = pd.concat(C._told(64, [None] * 5)(iter([rows])))
    got = sorted(zip(told["lang"], told["phrase"], told["n"]))
    assert got == [("de", "a", 1), ("de", "a b", 1), ("de", "b", 1), ("en", "a", 3), ("en", "a b", 1), ("en", "a b a", 1), ("en", "b", 2), ("en", "b a", 2), ("en", "c", 1), ("en", "c b", 1), ("en", "c b a", 1)]


def test_no_phrases(spark):
    docs = spark.createDataFrame([(1, "a b c", "en")], "doc_id long, text string, lang string")
    assert C.collocations(docs).count() == 0
    assert C.collocations(docs.filter("false")).count() == 0


def test_products_beyond_64_bits(spark):
    assert spark.sql("SELECT cast(1000 * cast(3000000000000L AS decimal(19,0)) AS decimal(22,0)) * cast(9000000000000L AS decimal(16,0)) div (cast(3000000000000L AS decimal(19,0)) * cast(7L AS decimal(19,0)))").first()[0] == 1000 * 9000000000000 // 7


# --- URL filter -----------------------------------------------------------------------------------

URLS = [
    (1, "http://A.Example.NET/en/x?y#z"), (2, "https://example.net/EN/"), (3, "http://foo.net/"), (4, "http://foo.net?x"), (5, "http://notexample.net/en/"), (6, "http://x.example.com/de/1"), (7, "http://x.org/fr/"),
    (8, "http://x.org/fr"), (9, None), (10, "no scheme/net/"), (11, "a?b=http://u.net/c#://d"), (12, "://"), (13, "http://"), (14, "http://casino-bonus.example.org/en/1"), (15, "http://ÄB.org/fr/ä"), (16, "http://net/"),
    (17, "http://x.org/fr/" + "a" * 20000), (1, "http://A.Example.NET/en/x?y#z"), (None, "http://foo.net/\n"), (18, "http://example.net./en/"), (19, ""),
]


def split_url(url):
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def plain_features(host, path, bits):
    if not host and not path:
        return set()
    out = set()
    for kind, text in (("h", f"^{re.sub('[0-9]+', '0', host)}$"), ("p", re.sub("[0-9]+", "0", path) + "$")):
        for n in U.GRAMS:
            for i in range(len(text) - n + 1):
                seed = xxhash.xxh64_intdigest(kind.encode(), 42)
                h = xxhash.xxh64_intdigest(text[i : i + n].encode(), seed)
                out.add(h % (1 << bits))
    return out


def test_addresses_rules_and_scores(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in URLS], "page_id long, url string, host string")
    labelled = U.labelled_urls(spark)
    weights, bias = U.fit(labelled, bits=12, steps=4)
    # the same steps in plain Python
    rows = [(sorted(plain_features(*split_url(r.url), 12)), r.label) for r in labelled.collect()]
    w, s, b, bs = [0.0] * (1 << 12), [0.0] * (1 << 12), 0.0, 0.0
    for _ in range(4):
        g, gb = Counter(), 0.0
        for at, label in rows:
            off = 1 / (1 + math.exp(-(sum(w[i] for i in at) / len(at) ** 0.5 + b))) - label
            gb += off / len(rows)
            for i in at:
                g[i] += off / len(at) ** 0.5 / len(rows)
        bs += gb * gb
        b -= U.RATE * gb / math.sqrt(bs + 1e-12)
        for i, x in g.items():
            x += U.L2 * w[i] / len(rows)
            s[i] += x * x
            w[i] -= U.RATE * x / math.sqrt(s[i] + 1e-12)
    assert abs(b - bias) < 1e-4 and max(abs(x - y) for x, y in zip(w, weights)) < 1e-4
    U.fit.__kwdefaults__["steps"], steps = 4, U.fit.__kwdefaults__["steps"]
    try:
        got = U.judge(pages, labelled, bits=12).collect()
    finally:
        U.fit.__kwdefaults__["steps"] = steps
    want = []
    for i, url in URLS:
        host, path = split_url(url)
        fits = [(len(h) + len(p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        at = plain_features(host, path, 12)
        score = 1 / (1 + math.exp(-(sum(weights[i] for i in at) / max(1, len(at)) ** 0.5 + bias)))
        rule, verdict = (max(fits)[1], max(fits)[2]) if fits else (None, "block" if score > 0.5 else "allow")
        want.append((i, host, path, rule, verdict, score))
    assert Counter(tuple(r)[:5] for r in got) == Counter(t[:5] for t in want)
    for r in got:
        assert abs(r.score - next(t[5] for t in want if t[:4] == tuple(r)[:4])) < 1e-5


HELD_OUT = [(u, "block") for u in (
    "http://mega-casino.example/jackpot", "http://online-poker-bonus.example/", "http://cheap-viagra.example/order", "http://xxx-cams.example/live", "http://crack-keygen.example/download",
    "http://banner.adserver.example/click", "http://free-money.example/win-now", "http://pills-cheap.example/no-prescription", "http://porn-tube.example/videos", "http://replica-rolex.example/sale",
)] + [(u, "allow") for u in (
    "http://www.library-books.example/history", "http://docs.software.example/manual/guide", "http://news.example/world/report", "http://wiki.example/articles/biology", "http://museum-of-science.example/exhibitions",
    "http://school-courses.example/grammar", "http://recipes-kitchen.example/bread", "http://journal-of-physics.example/papers", "http://concerts.example/programme", "http://parliament.example/statistics",
)]


def test_held_out_addresses(spark):
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(HELD_OUT)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in U.judge(pages, U.labelled_urls(spark), rules=()).collect()}
    assert sum(got[i] == v for i, (_, v) in enumerate(HELD_OUT)) >= 18


def test_empty_tables_and_too_many_rules(spark):
    labelled, pages = U.labelled_urls(spark), spark.createDataFrame([(1, "http://x.example/")], "page_id long, url string")
    assert U.judge(pages.filter("false"), labelled).count() == 0
    odd = spark.createDataFrame([("http://x.example/", None), (None, 1)], "url string, label int")
    assert [tuple(r) for r in U.judge(pages, odd).select("verdict", "score").collect()] == [("allow", 0.5)]
    with pytest.raises(ValueError):
        U.judge(pages, labelled, rules=[("block", f"h{i}", "/") for i in range(1001)])


def test_url_filter_is_native(spark):
    plan = U.judge(spark.createDataFrame([(1, "http://x.example/")], "page_id long, url string"), U.labelled_urls(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


# --- vector codes ---------------------------------------------------------------------------------


def vectors(n=300, width=16, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)).astype(np.float32)
    x[50:120] = x[50]  # many equal vectors
    x[:16, :2] = x[0, :2]  # equal first entries
    rows = [(int(i * 7 % 1000), [float(v) for v in x[i]], [None, 1, 2, 2][i % 4]) for i in range(n)]
    return rows + [(5000, None, 1), (5001, [1.0, None] * 8, 1), (5002, [float("nan")] * width, 2), (5003, [float("inf")] * width, 2), (None, rows[3][1], 1), (rows[9][0], rows[9][1], rows[9][2]), (rows[9][0], [0.5] * width, 2), (5004, [0.25], None)]


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(len(v) for _, v, _ in kept)
    size = -(-width // parts)
    x = [[math.floor(4096 * c) for c in v] + [0] * (parts * size - len(v)) for _, v, _ in kept]
    first = {}
    for (i, _, _), v in zip(kept, x):
        if i is not None:
            first[i] = min(first.get(i, v), v)
    start = [first[i] for i in sorted(first)[:entries]]
    books = [[v[p * size : (p + 1) * size] for v in start] for p in range(parts)]

    def assign():
        return [[min(range(len(start)), key=lambda e: (sum((a - b) ** 2 for a, b in zip(v[p * size : (p + 1) * size], books[p][e])), e)) for p in range(parts)] for v in x]

    for _ in range(rounds):
        own = assign()
        for p in range(parts):
            for e in range(len(start)):
                mine = [v[p * size : (p + 1) * size] for v, c in zip(x, own) if c[p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    own = assign()
    error = [sum(sum((a - b) ** 2 for a, b in zip(v[p * size : (p + 1) * size], books[p][c[p]])) for p in range(parts)) for v, c in zip(x, own)]
    by = Counter()
    for (_, _, label), e in zip(kept, error):
        by[label] += e
    digest = hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{c:02x}" for c in cs), e, by[label], digest) for (i, _, label), cs, e in zip(kept, own, error)), key=str)


@pytest.mark.parametrize("block_rows", [8192, 90])
def test_vector_codes(spark, block_rows):
    rows = vectors()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, code string").repartition(3)
    assert sorted((tuple(r) for r in V.vector_codes(df, block_rows=block_rows).collect()), key=str) == plain_codes(rows)


def test_few_vectors_odd_widths_and_labels(spark):
    rows = [(3, [0.1, -0.2, 0.3], "b"), (1, [0.4], None), (2, [], "a"), (2, [], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    assert sorted((tuple(r) for r in V.vector_codes(df).collect()), key=str) == plain_codes(rows)
    alone = spark.createDataFrame([(1, [], None)], "vec_id long, embedding array<double>, label string")
    assert tuple(V.vector_codes(alone).first()) == (1, "00" * 8, 0, 0, hashlib.sha256(b"").hexdigest())
    assert V.vector_codes(df.filter("false")).count() == 0
    with pytest.raises(ValueError):
        V.vector_codes(spark.createDataFrame([(1, [1e9], None)], "vec_id long, embedding array<double>, label string"))


def test_trees_settle_subtrees(spark):
    rng = np.random.default_rng(1)
    points = (rng.integers(0, 8, size=(3000, 1)) * 1000 + rng.integers(0, 20, size=(3000, 4))).astype(np.int64)  # eight clusters
    order, tree = V.CoverTree.grow(points)
    assert sorted(order) == list(range(3000)) and (tree.points == points[order]).all()
    entries, tally = points[:16].copy(), {}
    nearest = ((points[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
    sums, counts = tree.totals(entries, tally)
    assert (counts == np.bincount(nearest, minlength=16)).all() and all((sums[e] == points[nearest == e].sum(axis=0)).all() for e in range(16))
    far = (np.arange(8)[:, None] * 1000 + np.full((8, 4), 10)).astype(np.int64)
    tree.totals(far, tally := {})
    assert tally["compared"] == 0  # clear clusters go as subtrees
