import pytest
from pyspark.sql import functions as F

from quillspark.operators import index as I
from quillspark.operators import search as S
from quillspark.sources import corpus as C

DOCS = [(1, "en", "The cat sat. The cat!"), (2, "en", "cat the sat"), (3, "de", "the dog"), (4, "en", "")]


@pytest.fixture(scope="module")
def built(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, lang string, content string")
    return docs, I.build_index(docs)


def ask(spark, *terms):
    return spark.createDataFrame(list(enumerate(terms)), "query_id long, term string")


def test_all_terms_phrases_and_empty_queries(spark, built):
    docs, index = built
    out = S.search(ask(spark, "CAT the", '"the cat"', "?!", "zebra", "the"), index)
    hits = {(r.query_id, r.doc_id) for r in out["hits"].collect()}
    assert hits == {(0, 1), (0, 2), (1, 1), (4, 1), (4, 2), (4, 3)}
    assert {r.query_id: r.unfiltered for r in out["counts"].collect()} == {0: 2, 1: 1, 2: 0, 3: 0, 4: 3}


def test_postings_come_in_runs_by_language_and_term(spark):
    docs = spark.createDataFrame([(i, ("en", "de", None)[i % 3], "zeta Alpha 中 zeta. é alpha") for i in range(30)], "doc_id long, lang string, content string").coalesce(1)
    rows = [(r.lang, r.term.encode(), r.doc_id) for r in I.build_postings(docs).collect()]
    assert rows == sorted(rows) and len(rows) == 120
    assert {tuple(r.locations) for r in I.build_postings(docs).filter("term = 'zeta'").collect()} == {(0, 3)}


def test_repeated_words_in_phrases(spark, built):
    docs = spark.createDataFrame([(1, "en", "a a b"), (2, "en", "a b")], "doc_id long, lang string, content string")
    matches = S.match_terms(S.prepare_queries(ask(spark, '"a a"')), I.build_postings(docs))
    assert [(r.doc_id, r.n_phrases) for r in S.match_phrase(matches).collect()] == [(1, 1)]


def test_scores_of_plans_and_of_a_stored_index_agree(spark, built, tmp_path):
    from quillspark.sources.corpus import write_index

    docs, index = built
    queries = S.drop_empty_queries(S.prepare_queries(ask(spark, "cat the", '"cat the"', "the")))
    scores = lambda df: {(r.query_id, r.doc_id): round(r.score, 9) for r in df.collect()}
    postings = I.build_postings(docs)
    plain = scores(S.score(S.match_terms(queries, postings.drop("length")), I.term_stats(postings), I.document_lengths(postings)))
    assert set(plain) == {(0, 1), (0, 2), (1, 2), (2, 1), (2, 2), (2, 3)}
    assert scores(S.score(S.match_index(queries, index))) == scores(S.score(S.match_index(queries, write_index(index, str(tmp_path))))) == plain


def test_weights_of_words(spark):
    docs = spark.createDataFrame([(1, "en", "a b a", [2.0]), (2, "en", "a", None)], "doc_id long, lang string, content string, weights array<double>")
    postings = I.build_postings(docs)
    assert {(r.term, r.doc_id): (r.locations, r.weights) for r in postings.collect()} == {("a", 1): ([0, 2], [2.0, 1.0]), ("b", 1): ([1], [1.0]), ("a", 2): ([0], [1.0])}
    matches = S.match_terms(S.prepare_queries(ask(spark, "a")), postings)
    assert {(r.doc_id, r.location, r.weight, r.balanced_score) for r in S.hit_locations(matches).collect()} == {(1, 0, 2.0, 1.0), (1, 2, 1.0, 0.5), (2, 0, 1.0, 1.0)}
    plain = S.match_terms(S.prepare_queries(ask(spark, "a")), I.build_postings(docs.drop("weights")))
    assert {r.weight for r in S.hit_locations(plain).collect()} == {1.0}


def test_facets(spark, built):
    docs, index = built
    membership = I.with_merge_filter(I.facet_membership(docs.withColumn("filters", F.create_map(F.lit("lang"), F.array("lang"), F.lit("len"), F.array(F.length("content").cast("string"))))), docs, {"site": ["a", "b"]})
    queries = ask(spark, "the", None).withColumn("filters", F.create_map(F.lit("lang"), F.array(F.lit("en"), F.lit("fr")), F.lit("site"), F.array(F.lit("a"))))
    out = S.search(queries, I.Index(index.postings, index.stats, membership, docs))
    assert {(r.query_id, r.doc_id) for r in out["hits"].collect()} == {(0, 1), (0, 2), (1, 1), (1, 2), (1, 4)}
    assert {r.query_id: (r.unfiltered, r.filtered) for r in out["counts"].collect()} == {0: (3, 2), 1: (3, 3)}
    vocabulary = spark.createDataFrame([("lang", "en"), ("lang", "de"), ("lang", "fr")], "filter string, value string")
    every = S.facet_counts(out["unfiltered"], membership, vocabulary, queries).filter("query_id = 0")
    kept = S.facet_counts(out["hits"], membership, vocabulary, queries).filter("query_id = 0")
    a, b = ({r.value: r.n for r in x.collect()} for x in (every, kept))
    assert a == {"en": 2, "de": 1, "fr": 0} and b == {"en": 2, "de": 0, "fr": 0}
    assert all(b[v] <= a[v] for v in a)
    assert {r.value for r in S.visible_facets(kept).collect()} == {"en"}
    chosen = spark.createDataFrame([("lang", "fr")], "filter string, value string")
    assert {r.value for r in S.visible_facets(kept, chosen).collect()} == {"en", "fr"}
    assert S.visible_facets(kept, show_empty=True).count() == 3
    ordered = S.order_facet_values(every.drop("query_id"), ["fr"]).orderBy("position").collect()
    assert [(r.value, r.n) for r in ordered] == [("All", 3), ("fr", 0), ("de", 1), ("en", 2)]
    doubled = {r.value: r.n for r in S.merge_facets(every, every).collect()}
    assert doubled == {v: 2 * n for v, n in a.items()}


def test_null_term_without_selection_returns_everything(spark, built):
    docs = built[0]
    queries = ask(spark, None).withColumn("filters", F.create_map().cast("map<string,array<string>>"))
    member = spark.createDataFrame([], "doc_id long, filter string, value string")
    assert S.browse(queries, docs, member).count() == 4
    many = spark.range(2500).select(F.col("id").alias("query_id"), F.lit(None).cast("string").alias("term"), F.create_map().cast("map<string,array<string>>").alias("filters"))
    assert S.browse(many, docs, member).count() == S.browse(many, docs, member).distinct().count() == 10_000
    assert S.browse(many.filter("false"), docs, member).count() == 0


def test_queries_that_select_the_same_meet_the_documents_once(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.create_map(F.lit("lang"), F.array(F.when(F.col("id") % 2 == 0, "en").otherwise("de")), F.lit("tag"), F.array((F.col("id") % 5).cast("string"), F.lit("all"))).alias("filters"))
    picks = [{"lang": ["en"], "tag": ["1", "2", "all"]}, {"tag": ["2", "1"]}, {"lang": ["de", "en"]}, {"lang": ["fr"]}]
    queries = spark.createDataFrame([(i, None, picks[i % 4]) for i in range(3000)], "query_id long, term string, filters map<string,array<string>>")
    rows = S.browse(queries, docs, I.facet_membership(docs))
    of = lambda i: {0: set(range(0, 40, 2)), 1: {d for d in range(40) if d % 5 in (1, 2)}, 2: set(range(40)), 3: set()}[i % 4]
    found = rows.groupBy("query_id").agg(F.sort_array(F.collect_list("doc_id")).alias("docs")).collect()
    assert {r.query_id: r.docs for r in found} == {i: sorted(of(i)) for i in range(3000) if of(i)}
    shuffled = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [query_id" not in shuffled.split("Generate explode(ids")[0] and "Aggregate [one" in shuffled


def test_filters_alone_build_no_index(spark, tmp_path, monkeypatch):
    from quillspark.plans import search_queries as Q

    monkeypatch.setattr(Q, "index_of", lambda *a: pytest.fail("an index was asked for"))
    assert Q.f02_filter_only(spark, "/root/testdata/sf0.001").count() > 0


def test_order_pages_and_merging(spark):
    hits = spark.createDataFrame([(1, d, s) for d, s in ((1, 1.0), (2, 3.0), (3, 3.0), (4, 2.0))], "query_id long, doc_id long, score double")
    ranked = S.rank(hits)
    assert [r.doc_id for r in S.page_of_results(ranked, 2, 1).orderBy("rank").collect()] == [2, 3]
    assert S.page_of_results(ranked, 2, 2).count() == 4
    docs = spark.createDataFrame([(1, {"k": "b"}), (2, {"k": "a"}), (3, {}), (4, {"k": "c"})], "doc_id long, meta map<string,string>")
    assert [r.doc_id for r in S.sort_by_meta(hits, docs, {"k": "asc", "z": "desc"}).orderBy("rank").collect()] == [2, 1, 4, 3]
    with pytest.warns(UserWarning, match="'up'"):
        assert [r.doc_id for r in S.sort_by_meta(hits, docs, {"k": "up"}).orderBy("rank").collect()] == [2, 1, 4, 3]
    merged = S.merge_indexes([(hits, 1.0), (hits, 2.0)])
    assert merged.count() == 8 and merged.filter("rank = 1").first().index_ordinal == 1
    assert S.merge_indexes([(hits, 1.0), (hits, 1.0)], ["/site/b", "/site"]).count() == 4


def test_choose_language(spark):
    registry = spark.createDataFrame([("en", 3), ("pt-br", 9), ("de", 5)], "lang string, page_count int")
    requests = spark.createDataFrame([(1, "PT-BR"), (2, "de-AT"), (3, "xx"), (4, None)], "id int, lang string")
    assert {r.id: r.chosen for r in S.choose_language(requests, registry).collect()} == {1: "pt-br", 2: "de", 3: "pt-br", 4: "pt-br"}
    with pytest.raises(Exception, match="no language"):
        S.choose_language(requests, registry.filter("false")).collect()


TEXTS = {1: "red green blue", 2: "red green blue grey", 3: "red green grey blue", 4: "red green", 5: "grey blue green red"}
ASKED = {1: "red green blue grey", 2: "Red, green blue!", 3: "red green white"}
WORDS = {i: t.split() for i, t in TEXTS.items()}
TERMS = {q: t.lower().replace(",", "").replace("!", "").split() for q, t in ASKED.items()}
EVERY = {(q, d) for q, a in TERMS.items() for d, w in WORDS.items() if set(a) <= set(w)}


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    from quillspark.plans import page_queries, search_queries  # noqa: F401  they enter themselves
    from quillspark.plans.registry import QUERIES

    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en" if i < 5 else "de", f"src{i % 2}", len(t)) for i, t in TEXTS.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(ASKED.items()), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return lambda name: QUERIES[name](spark, folder).collect()


@pytest.mark.parametrize("name", ["search_top_pages", "j03_attach_documents", "t02_sort_by_meta", "f01_filter_hits", "u01_merge_indexes"])
def test_hits_of_whole_texts(run, name):
    assert {(r.query_id, r.doc_id) for r in run(f"{name}_whole")} == EVERY


@pytest.mark.parametrize("name", ["a04_facet_counts", "f05_visible_facets", "t04_order_facet_values"])
def test_facets_of_whole_texts(run, name):
    counts = {(r.query_id, r.value): r.n for r in run(f"{name}_whole") if r["filter"] == "lang" and r.value in ("en", "de")}
    assert counts == {(q, v): sum(p == q and (d < 5) == (v == "en") for p, d in EVERY) for q in ASKED for v in ("en", "de")}


def test_terms_phrases_counts_and_marks_of_whole_texts(run):
    assert {(r.query_id, r.doc_id) for r in run("j02_match_phrase_whole")} == {(q, d) for q, a in TERMS.items() for d, w in WORDS.items() if any(w[i : i + len(a)] == a for i in range(len(w)))}
    assert {(r.query_id, r.doc_id): r.terms for r in run("j01_match_terms_whole")} == {(q, d): n for q, a in TERMS.items() for d, w in WORDS.items() if (n := len(set(a) & set(w)))}
    assert {r.query_id: r.unfiltered for r in run("a05_result_counts_whole")} == {q: sum(p == q for p, _ in EVERY) for q in ASKED}
    assert {r.doc_id: r.marked for r in run("p16_highlight_url_whole")}[2] == "/src0?hl=red&hl=green&hl=blue&hl=grey#x"


PREFIX_DOCS = [(1, "en", "car park"), (2, "en", "carpet park"), (3, "de", "cart cart carpets"), (4, "en", "scar"), (5, None, "cär c"), (6, "en", "park")]


@pytest.mark.parametrize("kept", [False, True])
def test_prefixes_and_similarity(spark, tmp_path, kept):
    docs = spark.createDataFrame(PREFIX_DOCS, "doc_id long, lang string, content string")
    index = I.build_index(docs)
    if kept:
        index = C.write_index(index, str(tmp_path / "index"), buckets=3)

    def hits(rows, schema="query_id long, term string", **how):
        out = {}
        for r in S.search(spark.createDataFrame(rows, schema), index, **how)["hits"].collect():
            out.setdefault(r.query_id, {})[r.doc_id] = r.score
        return out

    asked = [(1, "car"), (2, "car park"), (3, "park car"), (4, '"car"'), (5, "c"), (6, "carpetsx"), (7, "pa car")]
    found = hits(asked, prefixes="last")
    assert {q: set(d) for q, d in found.items()} == {1: {1, 2, 3}, 2: {1}, 3: {1, 2}, 4: {1}, 5: {1, 2, 3, 5}}
    assert set(hits(asked, prefixes="all")[7]) == {1, 2}
    assert hits(asked)[1].keys() == {1}
    exact = hits([(1, "car")])[1][1]
    assert abs(found[1][1] - exact) < 1e-9  # asked whole: similarity has no say
    flat, steep = (hits([(3, "park car")], prefixes="last", ranking=S.Ranking(term_similarity=w))[3] for w in (0.0, 3.0))
    assert abs(flat[1] - flat[2]) < 1e-9 and steep[1] > steep[2] and abs(flat[1] - steep[1]) < 1e-9  # it changes the ranking
    only = hits([(1, "car", "de")], "query_id long, term string, lang string", prefixes="last")
    assert set(only[1]) == {3}
    with pytest.raises(ValueError):
        hits(asked, prefixes="some")


def test_only_the_buckets_of_prefixes_are_read(spark, tmp_path):
    docs = spark.createDataFrame([(i, "en", f"{chr(97 + i % 26)}word{i} common") for i in range(260)], "doc_id long, lang string, content string")
    index = C.write_index(I.build_index(docs), str(tmp_path / "index"), buckets=8)
    queries = S.prepare_queries(spark.createDataFrame([(1, "awo")], "query_id long, term string"))
    rows = S.expand_prefixes(S.query_terms(queries), index, "last")
    assert rows.count() == 10
    assert "dynamicpruning" in rows._jdf.queryExecution().executedPlan().toString().lower()


def test_locale_order_of_facet_values(spark):
    facets = spark.createDataFrame([("k", v, 1) for v in ("z", "É", "e", "Zeta", "a", "ä", "last")], "filter string, value string, n long")
    shown = lambda **how: [r.value for r in S.order_facet_values(facets, ["last"], **how).orderBy("position").collect()]
    assert shown() == ["All", "last", "Zeta", "a", "e", "z", "É", "ä"]
    assert shown(collation="UNICODE") == ["All", "last", "a", "ä", "e", "É", "z", "Zeta"]
    assert shown(collation="sv")[-1] == "ä"


RARE_DOCS = [(i, ("en", "de")[i % 2], "common " + ("often " if i % 3 == 0 else "") + (f"rare{i} " if i % 40 == 0 else "") + "often common") for i in range(400)]
RARE_ASKED = [(1, "common often rare40"), (2, "common often"), (3, "common none"), (4, '"often rare120 often"'), (5, "common"), (6, "rare40 rare80"), (7, '"common often common"'), (8, "common rare")]


@pytest.mark.parametrize("prefixes", [None, "last"])
@pytest.mark.parametrize("most_rows,most_bits", [(10**6, 0), (0, 1 << 20), (0, 0)])
def test_rarest_term_first_finds_the_same(spark, monkeypatch, prefixes, most_rows, most_bits):
    index = I.build_index(spark.createDataFrame(RARE_DOCS, "doc_id long, lang string, content string"))
    queries = S.drop_empty_queries(S.prepare_queries(spark.createDataFrame(RARE_ASKED, "query_id long, term string")))
    among = S.among
    assert sorted(S.score(S.match_index(queries, index, prefixes, complete=True)).select("query_id", "doc_id").collect()) == sorted(S.score(S.match_index(queries, index, prefixes)).select("query_id", "doc_id").collect())
    monkeypatch.setattr(S, "FEW_POSTINGS", 0)
    monkeypatch.setattr(S, "among", lambda rows, pairs: among(rows, pairs, most_rows, most_bits))
    every, few = (S.match_index(queries, index, prefixes, complete=c) for c in (False, True))
    rows = lambda m: {(r.query_id, r.doc_id): round(r.score, 9) for r in S.score(m).collect()}
    assert rows(few) == rows(every) and rows(few)[1, 40] > 0 and (4, 120) in rows(few) and (3, 0) not in rows(few)
    assert sorted(S.match_phrase(few).collect()) == sorted(r for r in S.match_phrase(every).collect())
    n = {c: m.groupBy("query_id").count().collect() for c, m in ((False, every), (True, few))}
    n = {c: {r[0]: r[1] for r in m} for c, m in n.items()}
    assert n[False][1] == 801 and n[False][3] == 400 and 3 not in n[True]
    if most_rows:
        assert n[True][1] == 3 and n[True][2] == n[False][2] == 800  # one document has the rarest term of query 1
    elif most_bits:
        assert n[True][1] < n[False][1] / 2


def test_among_keeps_every_pair(spark):
    rows = spark.range(20_000).select((F.col("id") % 7).alias("query_id"), F.col("id").alias("doc_id"), F.lit("x").alias("kept"))
    pairs = rows.filter("doc_id % 10 = 3").select("query_id", "doc_id")
    wanted = set(range(3, 20_000, 10))
    for most_rows, most_bits, most in ((10**6, 0, 2000), (0, 1 << 20, 6000), (0, 0, 20_000), (0, 8 * 2000, 6000)):
        got = S.among(rows, pairs, most_rows, most_bits)
        assert got.columns == rows.columns and wanted <= {r.doc_id for r in got.collect()} and got.count() <= most
    assert S.among(rows, pairs.filter("false")).count() == 0


def test_stored_facets_are_read_by_name_and_value(spark, tmp_path):
    from quillspark.sources import corpus as C

    rows = [(i, "en", "the word", {"7": [str(i % 3)], "kind": [f"k{i % 2}", "all"], "page size": ["a/b"] if i == 5 else []}) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, content string, filters map<string, array<string>>")
    index = I.build_index(docs)
    held = C.write_index(index, str(tmp_path / "index"), buckets=2)
    row = lambda df: sorted(map(tuple, df.select("doc_id", "filter", "value").collect()))
    assert row(held.membership) == row(index.membership) and dict(held.membership.dtypes)["filter"] == "string"
    assert {(r.filter, r.value, r.n) for r in held.facets.collect()} == {(r.filter, r.value, r.n) for r in S.all_facets(index.membership).collect()}
    queries = spark.createDataFrame([(1, "the", {"7": ["1", "nowhere"], "kind": ["k0"]}), (2, "word", {"page size": ["a/b"]}), (3, "the", {}), (4, None, {"kind": ["k1"]})], "query_id long, term string, filters map<string, array<string>>")
    pairs = lambda out: {(r.query_id, r.doc_id) for r in out["hits"].collect()}
    want = {(1, i) for i in range(40) if i % 3 == 1 and i % 2 == 0} | {(2, 5)} | {(3, i) for i in range(40)} | {(4, i) for i in range(1, 40, 2)}
    assert pairs(S.search(queries, held)) == pairs(S.search(queries, index)) == want
    few = S.selected_membership(held.membership, S.selections(queries.filter("query_id = 1")))
    plan = few._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "page size" not in line)
    assert "PartitionFilters: [filter" in scan and "kind" in scan.split("PartitionFilters")[1] and "PushedFilters: [In(value" in scan
    assert {r.filter for r in few.collect()} == {"7", "kind"} and few.count() == sum(i % 3 == 1 for i in range(40)) + 20
    hits = S.search(queries, held)["unfiltered"]
    counts = S.facet_counts(hits, held.membership, held.facets, queries, ["kind"])
    assert {(r.query_id, r.value): r.n for r in counts.collect() if r.query_id < 3} == {(q, v): n for q in (1, 2) for v, n in (("k0", 20), ("k1", 20), ("all", 40))}
    assert "filter" in counts._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1]


def test_more_selected_values_than_are_listed(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_LISTED", 1)
    membership = spark.createDataFrame([(1, "f", "a"), (2, "f", "b"), (3, "g", "a"), (4, None, "a")], "doc_id long, filter string, value string")
    selection = spark.createDataFrame([(1, "f", "a"), (1, "f", "c")], "query_id long, filter string, value string")
    assert [r.doc_id for r in S.selected_membership(membership, selection).collect()] == [1]
    assert S.selected_membership(membership, selection.filter("false")).count() == 0


def test_index_without_facets_of_any_document(spark, tmp_path):
    from quillspark.sources import corpus as C

    docs = spark.createDataFrame([(1, "en", "a", {})], "doc_id long, lang string, content string, filters map<string, array<string>>")
    held = C.write_index(I.build_index(docs), str(tmp_path / "index"), buckets=2)
    assert held.membership.count() == held.facets.count() == 0
    assert S.search(ask(spark, "a"), held)["hits"].count() == 1


def test_postings_are_grouped_in_their_documents(spark):
    rows = [(1, "en", "b a. B, c", [2.0, 0.5]), (2, "en", "... a !! a", None), (3, None, "?!", [1.0]), (4, "DE", None, None), (5, "en", "", []), (6, "de", "x\u200b\u200bY z", [3.0, 4.0, None])]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, content string, weights array<double>").coalesce(1)
    postings = I.build_postings(docs)
    got = sorted((r.lang, r.term, r.doc_id, r.length, r.tf, r.locations, r.weights, r.opens) for r in postings.collect())
    assert got == [
        ("de", "x", 6, 2, 1, [0], [3.0], True), ("de", "y z", 6, 2, 1, [2], [1.0], False), ("en", "a", 1, 4, 1, [1], [0.5], False), ("en", "a", 2, 2, 2, [1, 3], [1.0, 1.0], True),
        ("en", "b", 1, 4, 2, [0, 2], [2.0, 1.0], True), ("en", "c", 1, 4, 1, [3], [1.0], False),
    ]
    assert "Exchange" not in postings._jdf.queryExecution().executedPlan().toString()  # nothing is shuffled
    stats = lambda df: sorted(map(tuple, df.select("lang", "term", "df", "n_docs", "mean_length").collect()))
    assert stats(I.term_stats(postings)) == stats(I.term_stats(postings, I.corpus_stats(docs)))
