"""SimHash, components and line dedup against plain versions."""

import hashlib
import random

import numpy as np
import xxhash

from quillspark.llm import simhash as S
from quillspark.llm import substring_dedup as D
from quillspark.llm.components import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_fingerprint():
    for text in (None, "", " \t\n", "one", "One TWO  three", "a b c d e f g Éa éA", "w " * 70_000, "x y z " * 40):
        assert S.fingerprint(text) == plain_fingerprint(text)


def test_shard_links_equal_brute_force():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    noise = [np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in rng.integers(1, 6, 2000)]
    fps = np.unique(np.r_[base, base[rng.integers(0, 300, 2000)] ^ np.array(noise, dtype=np.uint64)])
    near = [(int(i), int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= 4) + i + 1]
    expected = plain_components(near)
    every = np.arange(len(fps))
    root = S.link_shard(fps, every, every, 4, leaf=32)
    assert all(root[i] == expected.get(i, i) for i in every)
    shards = S.Shards(fps[::3], 4, 4)
    at, shard, home = shards.route(fps)
    assert home.sum() == len(fps) and shards.leaves > 4
    seen = {}
    for i, s, h in zip(at, shard, home):
        seen.setdefault(int(i), {})[int(s)] = bool(h)
    own = {i: next(s for s, h in v.items() if h) for i, v in seen.items()}
    assert all(own[a] == own[b] or own[max((a, b), key=own.get)] in seen[min((a, b), key=own.get)] for a, b in near)


def test_near_duplicates(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(60)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, texts[i].upper()) for i in range(5)] + [(200, ""), (201, None), (202, "  "), (203, "short text"), (203, "short text"), (None, texts[3])]
    rows += [(300 + i, texts[0] + " tail" * i) for i in range(4)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, fp int, id int")
    out = S.near_duplicates(df).collect()
    assert len(out) == len(rows)
    fps = {}
    for i, t in rows:
        if i is not None:
            fps.setdefault(plain_fingerprint(t), []).append(i)
    heads = {f: min(ids) for f, ids in fps.items()}
    near = [(heads[a], heads[b]) for a in heads for b in heads if a < b and (a ^ b).bit_count() <= 4]
    expected = plain_components(near)
    for r in out:
        f = r.fp % (1 << 64)
        assert r.component_id == expected.get(heads[f], heads[f])
    assert S.near_duplicates(df.filter("false")).count() == 0


def test_small_shards_and_grids_find_the_same(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-(1 << 62), 1 << 62, 40)
    fps = np.unique(np.r_[base, *[base ^ (1 << int(b)) for b in rng.integers(0, 62, 20)]])
    df = spark.createDataFrame([(int(f), i) for i, f in enumerate(fps)], "fp long, id long")
    u = fps.view(np.uint64)
    near = [(int(i), int(j)) for i in range(len(u)) for j in np.flatnonzero(np.bitwise_count(u[i] ^ u[i + 1 :]) <= 4) + i + 1]
    expected = plain_components(near)
    found = {r.id: r.component for r in components(S.links(df, shard_rows=64, most_build=20, most_probe=30)).collect()}
    assert {i: c for i, c in found.items() if i != c} == {i: c for i, c in expected.items() if i != c}


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(60, 50), (50, 60), (70, 70), (81, 80), (82, 80), (82, 81)]
    found = {r.id: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 50: 50, 60: 50, 80: 80, 81: 80, 82: 80}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


LONG = " ".join(f"w{i}" for i in range(20))


def spans_of(docs, **options):
    out = {}
    for r in D.dedup(docs, spans="gone", **options).collect():
        out.setdefault(r.doc_id, []).append((r.text, [tuple(x) for x in r["gone"] or []]))
    return out


def test_lines(spark):
    rows = [(2, f"a\n{LONG}\nb"), (1, f"{LONG.upper()}\nx\n  {LONG}"), (3, "a\nb"), (4, None), (5, ""), (None, LONG), (6, LONG), (7, f"é\n{LONG}"), (7, f"é\n{LONG}")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, start int")
    n = len(LONG)
    assert spans_of(df) == {
        2: [("a\nb", [(2, 2 + n)])], 1: [(f"{LONG.upper()}\nx", [(n + 5, 2 * n + 5)])], 3: [("a\nb", [])], 4: [(None, [])], 5: [("", [])], None: [(LONG, [])],
        6: [("", [(0, n)])], 7: [("é", [(2, 2 + n)])] * 2,
    }
    assert D.dedup(df.filter("false")).count() == 0


def test_columns_of_any_name_pass_through(spark):
    names = ["key", "d", "k", "islands", "cut", "_key", "n", "word", "first", "d1"]
    df = spark.createDataFrame([(1, LONG, *range(10)), (2, LONG, *range(10))], "doc_id long, text string, " + ", ".join(f"{c} int" for c in names))
    out = sorted(D.dedup(df).collect())
    assert [tuple(r) for r in out] == [(1, LONG, *range(10)), (2, "", *range(10))] and out[0].__fields__ == df.columns


def plain_units(words, lines):
    """(first word, words, text) of a text's units, step by step."""
    found, at = [], 0
    for line in lines:
        if len(line) >= 16:
            found.append((at, len(line), b" ".join(line)))
        at += len(line)
    numbers = [int(hashlib.md5(w).hexdigest()[:8], 16) for w in words]
    sums = [sum(numbers[i : i + 38]) % 2**32 for i in range(len(words) - 37)]
    for i in sorted({min(range(p, p + 13), key=lambda x: (sums[x], x)) for p in range(len(words) - 49)}):
        found.append((i, 38, b" ".join(words[i : i + 38])))
    return found


def plain_dedup(rows):
    """Words that each (doc_id, text) keeps."""
    units = []
    for doc, text in sorted({r for r in rows if r[0] is not None and r[1] is not None}):
        data = text.encode().lower()
        units += [(u, doc, text, at, n) for at, n, u in plain_units(data.split(), [x.split() for x in data.split(b"\n")])]
    first, gone = {}, {}
    for u, doc, text, at, n in sorted(units, key=lambda x: (x[1], x[3])):
        _, d, t, a = first.setdefault(u, (u, doc, text, at))
        if (d, t) != (doc, text) or at >= a + n:
            gone.setdefault((doc, text), set()).update(range(at, at + n))
    return {(doc, text): [w for i, w in enumerate(text.split()) if i not in gone.get((doc, text), ())] for doc, text in rows if text is not None and doc is not None}


def test_equals_brute_force(spark):
    rng = random.Random(11)
    words = lambda n: " ".join(f"{rng.choice('bdfgk')}{rng.randrange(900)}" for _ in range(n))
    shared = [words(rng.randint(30, 120)) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.4 else words(rng.randint(1, 60)) for _ in range(rng.randint(1, 6))]
        rows.append((i, "".join(p + rng.choice(["\n", " ", "  ", "\n\n", " \t\r\n"]) for p in parts)))
    rows += [(70, "la " * 400), (71, "la " * 90 + "x"), (72, rows[3][1]), (73, " ".join(shared) * 20), (None, shared[0])]
    expected = plain_dedup(rows)
    got = spans_of(spark.createDataFrame(rows, "doc_id long, text string"))
    for (doc, text), kept in expected.items():
        [(out, spans)] = got[doc]
        assert out.split() == kept, doc
        assert len("".join(text[a:b] for a, b in spans).split()) <= len(text.split()) - len(kept) + len(spans)
        inside = "".join(text[a:b] + " " for a, b in spans).split()
        assert len(inside) == len(text.split()) - len(kept)
    assert sum(len(k) for k in expected.values()) < 0.9 * sum(len(t.split()) for _, t in expected)


def test_passages(spark):
    rng = random.Random(3)
    words = lambda n: " ".join(f"{rng.choice('bdfgk')}{rng.randrange(5000)}" for _ in range(n))
    shared, wrapped, short = words(55), words(60), words(37)
    a, b, c = words(30), words(30), words(30)
    broken = "\n".join(" ".join(wrapped.split()[i : i + 10]) for i in range(0, 60, 10))
    one = f"{a} {shared} {b}"
    rows = [(1, one), (2, f"{c} {shared.upper()} {words(30)}\nend"), (3, f"top\n{broken}\nx"), (4, f"y {wrapped} z"), (5, f"{words(9)} {short}"), (6, f"{words(9)} {short} q"), (7, "la " * 300), (8, "la " * 300 + "x"), (9, None), (10, ""), (10, words(70)), (None, shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in D.dedup(df).collect():
        got.setdefault(r.doc_id, []).append(r.text)
    whole = [rows[i][1] for i in (0, 2, 4, 5, 8)]
    assert [got[i][0] for i in (1, 3, 5, 6, 9)] == whole and got[None] == [shared] and set(got[10]) == {"", rows[10][1]}
    seen = set()
    for i in sorted(i for i in got if i is not None):
        for t in got[i]:
            w = (t or "").lower().split()
            own = {tuple(w[n : n + 50]) for n in range(len(w) - 49)}
            assert not own & seen, i
            seen |= own
    assert got[2][0].startswith(c) and got[2][0].endswith("\nend") and len(got[2][0].split()) <= 61 + 2 * 12
    assert got[4][0].startswith("y ") and got[4][0].endswith(" z") and 38 <= len(got[7][0].split()) <= 50


def test_cut():
    w = " ".join(f"w{i}" for i in range(38))
    cut = lambda t, *islands: D.cut_words(t, list(islands))[0]
    assert cut(f"a {w} b", (1, 38)) == "a b" and cut(f"a\n{w}\nb", (1, 38)) == "a\nb" and cut(f"a\n{w}", (1, 38)) == "a" and cut(w, (0, 38)) == ""
    assert cut(f"a\n{w} x\nb", (1, 38)) == "a\nx\nb" and cut(f"a {w}\nb", (1, 38)) == "a\nb" and cut(f"  {w} a {w}", (0, 38), (39, 38)) == "a" and cut("a b\n\nc", (0, 2)) == "\nc"
    assert D.cut_words("é  x y", [(1, 1)]) == ("é  y", [(3, 4)])
