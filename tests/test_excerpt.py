import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import excerpt as E


def step_by_step(locations, scores, length):
    """The rule as it is stated, one step at a time."""
    if not locations:
        return 0
    n = max(locations) + 1
    if n <= length:
        return 0
    words = [0.0] * n
    for at, s in zip(locations, scores):
        words[at] += s
    now = best = sum(words[:length])
    starts = [0]
    for i in range(n):
        now += (words[i + length] if i + length < n else 0) - words[i]
        if now > best:
            best, starts = now, [i]
        elif now == best and starts[-1] == i - 1:
            starts.append(i)
    return starts[len(starts) // 2]


def test_densest_start_equals_the_stated_fold():
    rng = random.Random(3)
    for _ in range(500):
        k, length = rng.randint(0, 12), rng.randint(1, 9)
        at = sorted(rng.choices(range(40), k=k))
        scores = [float(rng.randint(1, 3)) for _ in at]
        assert E.densest_start(at, scores, length) == step_by_step(at, scores, length), (at, scores, length)


def excerpt(spark, words, *args):
    cols = [F.lit(x) if not isinstance(x, list) else F.array(*map(F.lit, x)).cast("array<int>") for x in args]
    return spark.createDataFrame([(words,)], "w array<string>").select(E.build_excerpt(F.col("w"), *cols).alias("x")).first().x


@pytest.mark.parametrize(
    "args, expected",
    [
        ((2, 3, [3, 3, 99]), "c <mark>d</mark> e"),
        ((5, 3, []), "d e f"),
        ((0, 30, []), "a b c d e f"),
        ((0, 4, [], 2, 5), "c d e"),
        ((4, 2, [], 1, 4), "c d"),
    ],
)
def test_build_excerpt(spark, args, expected):
    assert excerpt(spark, list("abcdef"), *args) == expected


def test_headings_and_sub_results(spark):
    anchors = spark.createDataFrame([(1, 0, "h2", "a", "A", 2), (1, 1, "h2", "b", "B", 4), (1, 2, "h2", "c", "C", 4), (1, 3, "h3", "", "D", 6)], "doc_id long, ordinal int, element string, id string, text string, location int")
    words = spark.createDataFrame([(1, 1, x, 1.0) for x in (0, 2, 4, 5, 7)], "query_id long, doc_id long, location int, balanced_score double")
    placed = E.assign_heading(words, E.section_ends(anchors))
    assert {r.location: r.anchor and r.anchor.text for r in placed.collect()} == {0: None, 2: "A", 4: "C", 5: "C", 7: "D"}
    docs = spark.createDataFrame([(1, "p.html", "Page", "w0 w1 w2 w3 w4 w5 w6 w7 w8")], "doc_id long, url string, title string, content string")
    subs = {r.title: r for r in E.sub_results(words, anchors, docs, 3).collect()}
    assert subs["Page"].excerpt == "<mark>w0</mark> w1" and subs["Page"].url == "p.html"
    assert subs["A"].excerpt == "<mark>w2</mark> w3" and subs["A"].url == "/p.html#a"
    assert subs["C"].excerpt == "<mark>w4</mark> <mark>w5</mark>"
    assert subs["D"].excerpt == "w6 <mark>w7</mark> w8" and subs["D"].url == "p.html"
    best = E.best_sub_results(E.sub_results(words, anchors, docs, 3).filter("title <> 'D'"), docs.select("doc_id", "url"), 1)
    assert [r.title for r in best.collect()] == ["C"]


def test_ranges(spark):
    rows = spark.createDataFrame([(1, 0, 3), (1, 1, 1), (1, 2, 5), (1, 9, 0), (1, 20, 2)], "doc_id long, start int, length int")
    assert {(r.start, r.length) for r in E.clean_ranges(rows).collect()} == {(0, 3), (2, 5), (20, 2)}
    df = spark.createDataFrame([("ab  ef", [(1, 1), (2, 2), (5, 9)])], "t string, r array<struct<start:int,length:int>>")
    assert df.select(E.highlight_ranges(F.col("t"), F.col("r")).alias("x")).first().x == "a<mark>b</mark>  e<mark>f</mark>"


@pytest.mark.parametrize(
    "text, keywords, options, expected",
    [
        ("Café cafe", ["cafe"], {}, "<mark>Café</mark> <mark>cafe</mark>"),
        ("Café", ["cafe"], {"diacritics": False}, "Café"),
        ("aab ab", ["ab", "aab"], {}, "<mark>aab</mark> <mark>ab</mark>"),
        ("a.b axb", ["a.b"], {}, "<mark>a.b</mark> axb"),
        ("cats cat", ["cat"], {"accuracy": "exactly"}, "cats <mark>cat</mark>"),
        ("xcats cat", ["cat"], {"accuracy": "complementary"}, "<mark>xcats</mark> <mark>cat</mark>"),
        ("cat,dog", ["dog"], {"accuracy": "exactly", "limiters": ","}, "cat,<mark>dog</mark>"),
        ("Cat cat", ["cat"], {"case_sensitive": True}, "Cat <mark>cat</mark>"),
        ("ct cat cart", ["c?t"], {"wildcards": "enabled"}, "<mark>ct</mark> <mark>cat</mark> cart"),
        ("c-a-t", ["cat"], {"ignore_punctuation": "-"}, "<mark>c-a-t</mark>"),
        ("ca­t", ["cat"], {"ignore_joiners": True}, "<mark>ca­t</mark>"),
        ("one 1", ["one"], {"synonyms": {"one": "1"}}, "<mark>one</mark> <mark>1</mark>"),
        ("a  b", ["a b"], {}, "<mark>a  b</mark>"),
        ("x y", ["x y"], {"separate_words": True}, "<mark>x</mark> <mark>y</mark>"),
        ("x", [" "], {}, "x"),
    ],
)
def test_highlight(spark, text, keywords, options, expected):
    df = spark.createDataFrame([(text,)], "t string")
    marked = E.highlight(F.col("t"), keywords, E.MatchOptions(**options))
    row = df.select(marked.alias("m"), E.remove_highlights(marked).alias("back")).first()
    assert (row.m, row.back) == (expected, text)


def test_match_counts_and_mass(spark):
    df = spark.createDataFrame([("cat cat",), ("dog",), (None,)], "text string")
    assert {r.keyword: (r.matches, r.documents) for r in E.match_counts(df, ["cat", "cow"]).collect()} == {"cat": (2, 1), "cow": (0, 0)}
    rows = spark.createDataFrame([(1, 1, 5, 1.0), (1, 1, 5, 2.0)], "query_id long, doc_id long, location int, balanced_score double")
    assert E.location_mass(rows).first().mass == 3.0


def test_excerpts_are_no_longer_than_asked(spark):
    rows = spark.createDataFrame([(i, " ".join("w" for _ in range(i))) for i in range(0, 40, 3)], "i int, t string").select("i", X.words(F.col("t")).alias("w"))
    out = rows.select("i", F.size(F.split(E.build_excerpt(F.col("w"), F.lit(7), F.lit(12), F.array(F.lit(8))), " ")).alias("n")).collect()
    assert all(r.n <= 12 for r in out)


def test_every_synonym_of_a_keyword():
    options = E.MatchOptions(diacritics=False, synonyms={"a1": "b1", "a2": "b2", "b2": "c2"})
    spaced = lambda k, o: re.sub(r"\[\\s[^\]]*\]\+", "_", E.keyword_pattern(k, o))  # noqa: E731  the class of white space as _
    pattern = re.compile(spaced("a1 a2 A1", options).replace("(?iu)", "(?i)").replace("_", " "))
    assert all(pattern.fullmatch(f"{x} {y} {z}") for x in ("a1", "b1") for y in ("a2", "b2") for z in ("a1", "B1"))
    assert not pattern.fullmatch("a1 c2 a1")  # c2 means b2, not a2
    assert spaced("b2x", options) == "(?iu)(?:a2|b2|c2)x"
    longest = E.MatchOptions(diacritics=False, synonyms={"new": "old", "new york": "nyc"})
    assert spaced("new york new", longest) == r"(?iu)(?:new_york|nyc)_(?:new|old)"
