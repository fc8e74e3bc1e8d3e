from pyspark.sql import functions as F

from quillspark.operators import site as W

MANIFEST = [("a", 0, "x.html"), ("a", 1, "y z.html"), ("a", 2, "w.html"), ("b", 0, "q.html")]


def man(spark):
    return spark.createDataFrame(MANIFEST, "collection string, ordinal int, page string")


def test_states(spark):
    files = spark.createDataFrame([("a", "x.html"), ("a", "index(1).html")], "collection string, page string")
    assert {(r.page, r.state) for r in W.manifest_vs_files(man(spark), files).collect()} == {("x.html", "present"), ("y z.html", "missing"), ("w.html", "missing"), ("q.html", "missing"), ("index(1).html", "unlisted")}
    sitemap = spark.createDataFrame([("a", "https://h/a/y%20z.html"), ("a", "https://h/a/p+1.html")], "collection string, loc string")
    assert {(r.page, r.state) for r in W.manifest_vs_sitemap(man(spark), sitemap).filter("collection = 'a'").collect()} == {("y z.html", "both"), ("p+1.html", "sitemap_only"), ("x.html", "manifest_only"), ("w.html", "manifest_only")}
    index = spark.createDataFrame([("a",), ("c",)], "collection string")
    assert {(r.collection, r.state) for r in W.index_vs_collections(index, man(spark)).collect()} == {("a", "both"), ("c", "index_only"), ("b", "manifest_only")}


def test_links(spark):
    links = spark.createDataFrame([("a", "x.html", h) for h in ("w.html#f", "../b/q.html", "no.html", "#s", "https://e/x", "x.html")], "src_collection string, src_page string, href string")
    resolved = W.resolve_links(links, man(spark))
    assert {(r.href, r.state) for r in resolved.collect()} == {("w.html#f", "own"), ("../b/q.html", "other"), ("no.html", "dead"), ("#s", "fragment"), ("https://e/x", "external"), ("x.html", "own")}
    degrees = {(r.collection, r.page): (r.out_links, r.in_links, r.orphan) for r in W.link_degrees(resolved, man(spark)).collect()}
    assert degrees[("a", "x.html")] == (6, 1, False) and degrees[("b", "q.html")] == (0, 1, False) and degrees[("a", "y z.html")] == (0, 0, True)


def test_sections_with_one_start_page_are_both_found(spark):
    sections = spark.createDataFrame([(3, 1, 1, 55), (3, 1, 2, 65), (3, 1, 3, 65), (3, 1, 4, 70)], "book int, unit int, item int, start_page int")
    lookups = spark.createDataFrame([(1, 3, 54), (2, 3, 64), (3, 3, 69), (4, 3, 900), (5, 9, 60)], "lookup_id long, book int, printed_page int")
    found = {(r.lookup_id, r.item) for r in W.locate_printed_page(lookups, sections).collect()}
    assert found == {(2, 1), (3, 2), (3, 3), (4, 4)}
    twice = W.locate_printed_page(lookups.unionByName(lookups), sections)
    assert twice.count() == 8


def test_contents_and_editions(spark):
    toc = spark.createDataFrame([("a", 0, "../a/0201030045.html#x", 45), ("a", 1, "0201030046.html", 45), ("a", 2, None, 3)], "collection string, ordinal int, href string, printed_page int")
    listed = spark.createDataFrame([("a", "0201030045.html")], "collection string, page string")
    assert {(r.ordinal, r.listed, r.agrees) for r in W.toc_vs_pages(toc, listed).collect()} == {(0, True, True), (1, False, False), (2, False, None)}
    old = spark.createDataFrame([("1.htm", "<p>a b</p><nav>n</nav>"), ("2.htm", "x")], "page string, html string")
    new = spark.createDataFrame([("1.html", "a<br>b"), ("3.html", "x")], "page string, html string")
    assert {(r.stem, r.in_old, r.in_new, r.same_text) for r in W.match_editions(old, new).collect()} == {("1", True, True, True), ("2", True, False, False), ("3", False, True, False)}


def test_counts(spark):
    pages = spark.createDataFrame([("p1", "l1\nl2\nl1"), ("p2", "l1\nl3"), ("p3", "l1\nl3")], "path string, html string")
    assert {(r.line, r.n_docs) for r in W.boilerplate_lines(pages, 2, key="path").collect()} == {("l1", 3), ("l3", 2)}
    assert [(r.n, r.keeper) for r in W.duplicate_pages(pages).collect()] == [(2, "p2")]
    sitemap = spark.createDataFrame([("a", "2025-05-17")], "collection string, lastmod string")
    assert {(r.collection, r.pages, r.lastmod) for r in W.collection_sizes(man(spark), sitemap).collect()} == {("a", 3, "2025-05-17"), ("b", 1, None)}


def test_neighbours_and_draws(spark):
    near = {r.page: (r.prev, r.next) for r in W.neighbours(man(spark)).collect()}
    assert near == {"x.html": (None, "y z.html"), "y z.html": ("x.html", "w.html"), "w.html": ("y z.html", None), "q.html": (None, None)}
    assert {r.page: (r.prev, r.next) for r in W.neighbours(man(spark), chunk=2).collect()} == near
    footers = spark.createDataFrame([("a", "x.html", None, "y z.html"), ("a", "w.html", None, None)], "collection string, page string, declared_prev string, declared_next string")
    assert {(r.page, r.agrees) for r in W.audit_navigation(man(spark), footers).collect()} == {("x.html", True), ("w.html", False)}
    wide = spark.range(20).select(F.lit("c").alias("collection"), F.col("id").cast("int").alias("ordinal"), F.col("id").cast("string").alias("page"))
    drawn = [W.random_page(wide, seed).first().ordinal for seed in range(40)]
    assert len(set(drawn)) > 10 and drawn[0] == W.random_page(wide, 0).first().ordinal
    assert W.page_at(wide, 0.999).first().ordinal == 19 and W.page_at(wide, 0.0).first().ordinal == 0
    assert W.random_site_page(man(spark), 1).count() == 1


def test_set_operations(spark):
    a, b = man(spark).select("collection", "page"), man(spark).select("collection", "page").filter("page <> 'x.html'")
    assert W.union_site(a, b).count() == 7
    assert [r.page for r in W.site_difference(a, b).collect()] == ["x.html"] and W.site_common(a, b).count() == 3


SCRIPT = "<script>\n  var n = 1;\n\n  scroll(n);\n</script>"


def test_boilerplate_blocks(spark):
    pages = [("p1", f"own 1\n{SCRIPT}\nown 2"), ("p2", f"{SCRIPT}\nfoot"), ("p3", f"own 3\n{SCRIPT}\nown 4\nfoot\n{SCRIPT}"), ("p4", "foot\nown 5\nfoot"), ("p5", "foot"), ("p6", "  "), ("p7", None), ("p8", SCRIPT)]
    pages = spark.createDataFrame(pages, "path string, html string")
    script = "<script>\nvar n = 1;\nscroll(n);\n</script>"
    got = lambda n: {(r.block, r.n_lines, r.n_docs) for r in W.boilerplate_blocks(pages, n, key="path").collect()}
    assert got(2) == {(script, 4, 3), ("foot", 1, 2)}  # alone in p1, p3 and p8; with foot behind or before it in p2 and p3, which are runs of one page
    assert (f"{script}\nfoot", 5, 1) in got(1) and got(9) == set()
    assert W.boilerplate_blocks(pages.filter("false"), 1, key="path").count() == 0


NAVIGATION = '<div><hr/><p><a href="index.html">目次に戻る</a></p>{}</div>'


def test_footers_of_pages(spark):
    links = [
        ("a", "x.html", NAVIGATION.format('<p><a href="y%20z.html">次のページに進む</a></p>')),
        ("a", "y z.html", '<a href="no.html">前の章</a> text ' + NAVIGATION.format('<p><a href="x.html#top">前のページに戻る</a></p><p><a href="../a/w.html">Next page</a></p>')),
        ("a", "w.html", NAVIGATION.format('<p><a href="../b/q.html">prev</a></p>')),
        ("b", "q.html", NAVIGATION.format("")),
        ("b", "plain.html", '<a href="x.html">x</a>'),
        ("b", "none.html", None),
    ]
    pages = spark.createDataFrame(links, "collection string, page string, html string")
    read = W.footers(pages)
    assert {(r.page, r.declared_prev, r.declared_next) for r in read.collect()} == {("x.html", None, "y z.html"), ("y z.html", "x.html", "w.html"), ("w.html", "b/q.html", None), ("q.html", None, None)}
    assert {(r.page, r.agrees) for r in W.audit_navigation(man(spark), read).collect()} == {("x.html", True), ("y z.html", True), ("w.html", False), ("q.html", True)}


def test_blocks_read_the_pages_three_times(spark, tmp_path):
    spark.createDataFrame([(i, "a\n b\nc") for i in range(4)], "page_id long, html string").write.parquet(str(tmp_path / "p"))
    blocks = W.boilerplate_blocks(spark.read.parquet(str(tmp_path / "p")), 3)
    assert [(r.block, r.n_docs) for r in blocks.collect()] == [("a\nb\nc", 4)]
    assert blocks._jdf.queryExecution().optimizedPlan().toString().count("Relation [page_id") == 1  # the others made the tables it meets
