import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import index as I
from quillspark.operators import pages as P
from quillspark.sources import corpus as C
from quillspark.sources.named import write_named


def test_read_tree(spark, tmp_path):
    book = tmp_path / "book a"
    book.mkdir()
    (book / "1.html").write_text("<title>x</title>")
    (book / "2.htm").write_text("y")
    (book / "pages.json").write_text('["b.html",\n "a.html"]')
    (book / "sitemap.xml").write_text('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://h/a%20b.html</loc><lastmod>2025-05-17</lastmod></url></urlset>')
    (tmp_path / "robots.txt").write_text("# c\nUser-agent: *\nSitemap: https://h/sitemap.xml\n")
    (tmp_path / "entry.json").write_text('{"version":"1","languages":{"ja":{"hash":"h","wasm":"w","page_count":7}}}')
    pages = {(r.collection, r.page): r.html for r in C.read_html(spark, str(tmp_path)).collect()}
    assert pages == {("book a", "1.html"): "<title>x</title>", ("book a", "2.htm"): "y"}
    assert sorted((r.ordinal, r.page) for r in C.read_manifests(spark, str(tmp_path)).collect()) == [(0, "b.html"), (1, "a.html")]
    row = C.read_sitemaps(spark, str(tmp_path)).first()
    assert (row.loc, str(row.lastmod)) == ("https://h/a%20b.html", "2025-05-17")
    assert {(r.directive, r.value) for r in C.read_robots(spark, str(tmp_path / "robots.txt")).collect()} == {("user-agent", "*"), ("sitemap", "https://h/sitemap.xml")}
    row = C.read_registry(spark, str(tmp_path / "entry.json")).first()
    assert (row.lang, row.page_count, row.hash) == ("ja", 7, "h")


def test_written_manifests_and_sitemaps_read_back(spark, tmp_path):
    manifest = spark.createDataFrame([("a", 0, "z.html"), ("a", 1, 'b"\n.html'), ("b", 0, "q.html")], "collection string, ordinal int, page string")
    (tmp_path / "m" / "a").mkdir(parents=True)
    (tmp_path / "m" / "a" / "z.html").write_text("page")
    (tmp_path / "m" / "a" / "pages.json").write_text("old")
    C.write_manifests(manifest, str(tmp_path / "m"))
    assert sorted(str(f.relative_to(tmp_path / "m")) for f in (tmp_path / "m").rglob("*") if f.is_file() and f.suffix != ".crc") == ["a/pages.json", "a/z.html", "b/pages.json"]
    assert json.loads((tmp_path / "m" / "a" / "pages.json").read_text()) == ["z.html", 'b"\n.html']
    assert sorted((r.collection, r.ordinal, r.page) for r in C.read_manifests(spark, str(tmp_path / "m")).collect()) == [("a", 0, "z.html"), ("a", 1, 'b"\n.html'), ("b", 0, "q.html")]
    sitemap = spark.range(60).select(F.when(F.col("id") < 50, "a b").otherwise("c").alias("collection"), F.concat(F.lit("https://h/?x=1&y="), "id").alias("loc"), F.to_date(F.lit("2025-05-17")).alias("lastmod"))
    C.write_sitemaps(sitemap, str(tmp_path / "s"), "https://h/x/", most=20, dealt=15)
    listed = {r.loc.removeprefix("https://h/x/") for r in C.read_sitemap_index(spark, str(tmp_path / "s" / "sitemap_index.xml")).collect()}
    assert {"a%20b/sitemap.xml", "a%20b/sitemap-2.xml", "c/sitemap.xml"} <= listed and len(listed) in (4, 5)
    assert all((tmp_path / "s" / loc.replace("%20", " ")).is_file() for loc in listed)
    read = C.read_sitemaps(spark, str(tmp_path / "s")).collect()
    assert sorted(map(tuple, read)) == sorted(map(tuple, sitemap.collect()))
    docs = spark.createDataFrame([(1, "JA"), (2, "ja"), (3, None)], "doc_id long, lang string")
    C.write_registry(docs, str(tmp_path / "r.json"))
    assert (tmp_path / "r.json").is_file()
    assert {r.lang: r.page_count for r in C.read_registry(spark, str(tmp_path / "r.json")).collect()} == {"ja": 2, "unknown": 1}


def test_named_files(spark, tmp_path):
    root = tmp_path / "n"
    found = lambda: {str(f.relative_to(root)): f.read_text() for f in root.rglob("*") if f.is_file()}
    rows = spark.createDataFrame([("x/y.txt", 1, "é"), ("x/y.txt", 0, None), ("x/y.txt", 2, "c"), ("z", 0, "")], "path string, ordinal int, value string").repartition(4)
    write_named(rows, str(root), "<", ",", ">", overwrite=False)
    assert found() == {"x/y.txt": "<,é,c>", "z": "<>"}
    more = spark.createDataFrame([("new", 0, "n"), ("z", 0, "2")], "path string, ordinal int, value string")
    with pytest.raises(Exception, match="there already"):
        write_named(more, str(root), overwrite=False)
    assert found() == {"x/y.txt": "<,é,c>", "z": "<>"}  # nothing of the refused job
    for bad in (None, "", "/abs", "../up", "a//b", "a/"):
        with pytest.raises(Exception, match="name of a file"):
            write_named(more.union(spark.createDataFrame([(bad, 0, "v")], more.schema)), str(root))
    failing = more.withColumn("value", F.when(F.col("path") == "z", F.raise_error(F.lit("broken"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="broken"):
        write_named(failing, str(root))
    assert found() == {"x/y.txt": "<,é,c>", "z": "<>"}
    write_named(more, str(root))
    assert found() == {"x/y.txt": "<,é,c>", "z": "2", "new": "n"}
    write_named(more.filter("false"), str(root))
    assert len(found()) == 3 and sorted(f.name for f in root.iterdir()) == ["new", "x", "z"]


def test_index_round_trip_reads_only_wanted_terms(spark, tmp_path):
    docs = spark.createDataFrame([(1, "en", "a b, a"), (2, "en", "b c")], "doc_id long, lang string, content string")
    index = I.build_index(docs)
    C.write_index(I.Index(index.postings, index.stats, docs.select("doc_id", F.lit("lang").alias("filter"), F.col("lang").alias("value")), docs), str(tmp_path))
    read = C.read_index(spark, str(tmp_path), ["a"])
    assert [(r.term, r.doc_id, r.tf, r.locations, r.length) for r in read.postings.collect()] == [("a", 1, 2, [0, 2], 3)]
    assert [(r.term, r.df, r.n_docs, r.mean_length) for r in read.stats.collect()] == [("a", 1, 2, 2.5)]
    assert read.membership.count() == 2 and read.documents.count() == 2
    assert C.read_index(spark, str(tmp_path)).postings.count() == index.postings.count() == 4
    assert C.read_index(spark, str(tmp_path), []).postings.count() == 0


def test_derived_manifest_numbers_pages_within_collections(spark):
    ids = [5, 1, 2500, 999, 1000, 7]
    pages = spark.createDataFrame([(i, f"http://{'ab'[i % 2]}/x", "") for i in ids], "page_id long, url string, html string")
    got = sorted((r.collection, r.ordinal, r.page) for r in C.derived_manifest(pages).collect())
    assert got == [(c, n, f"{i:010}.html") for c, own in (("a", [1000, 2500]), ("b", [1, 5, 7, 999])) for n, i in enumerate(own)]


def test_stray_percent_signs_stay(spark, tmp_path):
    (tmp_path / "100% a").mkdir()
    (tmp_path / "100% a" / "x.html").write_text("y")
    assert [(r.collection, r.page) for r in C.read_html(spark, str(tmp_path)).collect()] == [("100% a", "x.html")]


LINKS = """<!-- <a href="gone">g</a> --><a href='b.html'>B</a><A class=x HREF=c.html>C &amp; &#68;</A><a data-href="no">n</a>
<a title="t" href="d?x=1&amp;y=&#x32;">D <b>d</b></a>"""


def test_links_of_any_quoting(spark):
    pages = spark.createDataFrame([(1, "u", LINKS)], "page_id long, url string, html string")
    found = [(r.url, r.ordinal, r.href, r.anchor_text) for r in P.page_links(pages, keep=["url"]).collect()]
    assert found == [("u", 0, "b.html", "B"), ("u", 1, "c.html", "C & D"), ("u", 2, "d?x=1&y=2", "D d")]
    listed = pages.select("page_id", F.lit("<ul><li><a href='a'>A</a></li><li>none</li><li><a href=b>B&lt;</a></li></ul>").alias("html"))
    assert [(r.ordinal, r.title, r.href) for r in P.site_index(listed).collect()] == [(0, "A", "a"), (1, "B<", "b")]


def test_page_rows(spark):
    pages = spark.createDataFrame([(1, '<p>a</p>P.55 x<br>　<a href="b.html">B <b>c</b></a>…12<h2 id="q">Head &amp; x</h2>w1 w2<h3></h3>')], "page_id long, html string")
    assert [(r.ordinal, r.text) for r in P.paragraphs(pages).collect()][0] == (0, "a")
    link = P.page_links(pages).first()
    assert (link.href, link.anchor_text, link.kind) == ("b.html", "B c", "relative")
    assert [(r.printed_page, r.position) for r in P.page_marks(spark.createDataFrame([(1, "xP.55 yP64 P")], "k long, t string"), "k", "t").collect()] == [(55, 1), (64, 7)]
    anchors = [(r.element, r.id, r.text, r.location) for r in P.page_anchors(pages).collect()]
    assert anchors == [("h2", "q", "Head & x", 5), ("h3", "", "", 9)]  # a heading is no break between words
    toc = [(r.level, r.title, r.href, r.printed_page) for r in P.toc_rows(spark.createDataFrame([("c", 'A…3<br>　<a href="x.html">B</a> P12<br>C')], "collection string, html string")).collect()]
    assert toc == [(0, "A", None, 3), (1, "B", "x.html", 12), (0, "C", None, None)]
    cited = P.citations(spark.createDataFrame([(1, "x（五二―三〇四）y（一二―二五八、一九六二・一〇・三）(19-22、88.5.4)（注）")], "k long, t string"), "k", "t").collect()
    assert [(r.volume, r.src_page, str(r.date)) for r in cited] == [(52, 304, "None"), (12, 258, "1962-10-03"), (19, 22, "1988-05-04")]


def test_headings_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    from quillspark.plans import page_queries  # noqa: F401  they enter themselves
    from quillspark.plans.registry import ORACLES, QUERIES

    markup = [(1, "<p>a</p><h1>x = &quot;1&quot; &amp; <b>y</b></h1>z"), (2, "<h2> &nbsp; </h2>"), (3, "<h1>&amp;lt;</h1>"), (4, "none")]
    spark.createDataFrame([(i, "u", x) for i, x in markup], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
        for name in ("p36_page_anchors", "f04_heading_anchors"):
            assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == sorted(c.execute(ORACLES[name]).fetchall())


def test_stored_tables_and_scratch(spark):
    from quillspark.sources.stored import new_path, scratch, shared_folder, stored

    df = spark.createDataFrame([(1, "a", [1.5]), (2, None, None)], "n long, `a b` string, v array<double>")
    kept = new_path(spark)
    with scratch(spark):
        inside = stored(df)
        assert inside.schema == df.schema and sorted(inside.collect()) == sorted(df.collect())
        file = inside.inputFiles()[0]
        inside.write.parquet(kept)
    assert shared_folder(spark).removeprefix("file:") in file
    gone = spark.sparkContext._jvm.java.io.File(file.removeprefix("file://"))
    assert not gone.exists() and spark.read.parquet(kept).count() == 2
    assert stored(df.filter("false")).count() == 0


def test_small_tables_are_dealt_out(spark, tmp_path):
    from quillspark.sources.stored import read_table

    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "small"))
    spark.range(100).repartition(6).write.parquet(str(tmp_path / "parts"))
    assert read_table(spark, str(tmp_path / "small")).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in read_table(spark, str(tmp_path / "small")).collect()) == list(range(100))
    assert read_table(spark, str(tmp_path / "parts")).count() == 100


def test_frequent_terms_are_split_by_their_size(spark, tmp_path):
    docs = spark.range(20_000).repartition(16).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.concat_ws(" ", F.lit("common"), F.concat(F.lit("w"), F.col("id") % 50)).alias("content"))
    key, kept = "spark.sql.adaptive.advisoryPartitionSizeInBytes", {}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a bucket is split between the tasks that made it, of which a small table has only one
    for size in ("4k", "64m"):
        spark.conf.set(key, size)
        try:
            index = C.write_index(I.build_index(docs), str(tmp_path / size), buckets=2)
        finally:
            spark.conf.unset(key)
        hot = index.postings.filter("term = 'common'").groupBy(F.input_file_name().alias("file")).count().collect()
        kept[size] = sorted(r["count"] for r in hot)
        assert sum(kept[size]) == 20_000 and index.postings.count() == 40_000
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(kept["64m"]) == 1 and len(kept["4k"]) > 2 and kept["4k"][-1] < 15_000


def test_pages_are_written_as_files_of_their_names(spark, tmp_path):
    rows = [("a.example", "1.html", "x\n"), ("a.example", "2.html", ""), ("b.example", "1.html", "é\n\ny"), ("", "3.html", "z")]
    C.write_html(spark.createDataFrame(rows, "collection string, page string, html string"), f"file://{tmp_path}/tree")
    assert (tmp_path / "tree/collection=a.example/1.html").read_text() == "x\n\n" and not list((tmp_path / "tree").rglob("*.crc"))
    assert sorted((r.collection, r.page, r.html) for r in C.read_html(spark, f"{tmp_path}/tree").collect()) == sorted((c, p, h + "\n") for c, p, h in rows)
