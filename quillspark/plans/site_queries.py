"""Queries of the site, excerpt and log operators. Manifests, sitemaps and links are derived from pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import excerpt as E
from quillspark.operators import pages as P
from quillspark.operators import site as W
from quillspark.plans import sql
from quillspark.plans.registry import query, table
from quillspark.sources import corpus as C
from quillspark.sources.stored import new_path
from quillspark.streaming import debounce as R

#: man: collection, ordinal, page, page_id.
MAN = f"man AS (SELECT {sql.HOST} AS collection, row_number() OVER (PARTITION BY {sql.HOST} ORDER BY page_id) - 1 AS ordinal, {sql.PAGE} AS page, page_id FROM pages)"


def manifest(spark, d):
    return C.derived_manifest(table(spark, d, "pages"))


def _id():
    return F.substring("page", 1, 10).cast("long")


@query(f"SELECT {sql.HOST} AS collection, md5(html) AS digest, length(html) AS chars FROM pages")
def s01_read_html(spark, d):
    """The pages as a tree of files, a page a file, read back. A file ends in a line feed, which isn't the page's, as Spark passes over empty files."""
    path = new_path(spark, "tree")
    C.write_html(C.page_table(table(spark, d, "pages")), path)
    html = F.regexp_replace("html", r"\n\z", "")
    return C.read_html(spark, path).select("collection", F.md5(html).alias("digest"), F.length(html).alias("chars"))


@query(f"WITH {MAN} SELECT collection, ordinal::INTEGER AS ordinal, page FROM man")
def s02_read_manifests(spark, d):
    """Manifests written and read back."""
    path = new_path(spark, "manifests")
    C.write_manifests(manifest(spark, d), path)
    return C.read_manifests(spark, path)


@query(f"WITH {MAN} SELECT collection, 'https://' || collection || '/' || page AS loc, '2025-01-01' AS lastmod FROM man")
def s03_read_sitemaps(spark, d):
    """Sitemaps written and read back."""
    path = new_path(spark, "sitemaps")
    C.write_sitemaps(C.derived_sitemap(table(spark, d, "pages")), path, "https://site.example")
    return C.read_sitemaps(spark, path).withColumn("lastmod", F.col("lastmod").cast("string"))


@query(f"WITH {MAN}, c AS (SELECT collection, count(*) AS n FROM man GROUP BY ALL) SELECT 'sitemap' AS directive, 'https://' || collection || '/sitemap.xml' AS value FROM c UNION ALL SELECT 'crawl-delay', n::VARCHAR FROM c")
def s04_read_robots(spark, d):
    """A robots file of every collection, with comments and blank lines."""
    path = new_path(spark, "robots")
    sizes = manifest(spark, d).groupBy("collection").agg(F.count("*").alias("n"))
    lines = F.array(F.concat(F.lit("# of "), "collection"), F.concat(F.lit("Sitemap: https://"), "collection", F.lit("/sitemap.xml")), F.lit(""), F.concat(F.lit(" Crawl-Delay :"), F.col("n").cast("string"), F.lit(" # pages")))
    sizes.select(F.explode(lines).alias("value")).write.text(path)
    return C.read_robots(spark, path)


@query("SELECT '1' AS version, coalesce(lower(lang), 'unknown') AS lang, count(DISTINCT doc_id)::INTEGER AS page_count FROM documents GROUP BY ALL")
def s05_read_registry(spark, d):
    """The registry written and read back."""
    path = f"{new_path(spark, 'registry')}/registry.json"
    C.write_registry(table(spark, d, "documents"), path)
    return C.read_registry(spark, path).select("version", "lang", "page_count")


@query(f"SELECT DISTINCT {sql.HOST} AS collection, TRUE AS xml FROM pages")
def s08_sitemap_index(spark, d):
    """The index of the sitemaps, by the collection in each address."""
    path = new_path(spark, "sitemaps")
    C.write_sitemaps(C.derived_sitemap(table(spark, d, "pages")), path, "https://site.example/")
    loc = C.read_sitemap_index(spark, f"{path}/sitemap_index.xml")
    return loc.select(F.regexp_extract("loc", "^https://site[.]example/([^/]*)/sitemap[^/]*$", 1).alias("collection"), F.col("loc").endswith(".xml").alias("xml")).distinct()


@query(f"WITH {MAN} SELECT collection, to_json(list(page ORDER BY ordinal))::VARCHAR AS value FROM man GROUP BY collection")
def s07_manifest_json(spark, d):
    """The text of each collection's pages.json."""
    path = new_path(spark, "manifests")
    C.write_manifests(manifest(spark, d), path)
    return C.read_html(spark, path, "pages.json").select("collection", F.col("html").alias("value"))


@query(f"WITH {MAN} SELECT collection, 'https://' || collection || '/' || page AS loc, '2025-01-01' AS lastmod FROM man")
def s08_sitemap(spark, d):
    return C.derived_sitemap(table(spark, d, "pages")).withColumn("lastmod", F.col("lastmod").cast("string"))


@query("""SELECT '{"version":"1","languages":{' || string_agg('"' || lang || '":{"page_count":' || n || '}', ',' ORDER BY lang) || '}}' AS value
FROM (SELECT lower(lang) AS lang, count(DISTINCT doc_id) AS n FROM documents GROUP BY ALL)""")
def s09_registry_json(spark, d):
    return C.registry_json(table(spark, d, "documents"))


@query(f"WITH {MAN} SELECT collection, CASE WHEN page_id % 7 = 1 THEN 'x' || page ELSE page END AS page, CASE WHEN page_id % 7 = 0 THEN 'missing' WHEN page_id % 7 = 1 THEN 'unlisted' ELSE 'present' END AS state FROM man UNION ALL SELECT collection, page, 'missing' FROM man WHERE page_id % 7 = 1")
def j05_manifest_vs_files(spark, d):
    listed = manifest(spark, d)
    files = listed.filter(_id() % 7 != 0).withColumn("page", F.when(_id() % 7 == 1, F.concat(F.lit("x"), "page")).otherwise(F.col("page")))
    return W.manifest_vs_files(listed, files)


@query(f"WITH {MAN} SELECT collection, page, CASE WHEN page_id % 5 = 0 THEN 'manifest_only' WHEN page_id % 5 = 1 THEN 'sitemap_only' ELSE 'both' END AS state FROM man")
def j06_manifest_vs_sitemap(spark, d):
    listed, sitemap = manifest(spark, d), C.derived_sitemap(table(spark, d, "pages"))
    return W.manifest_vs_sitemap(listed.filter(_id() % 5 != 1), sitemap.filter(F.regexp_extract("loc", r"(\d{10})\.html$", 1).cast("long") % 5 != 0))


def _links(spark, d):
    """Each page links to the page before it, to one that isn't there every 11th time, and out."""
    rows = C.page_table(table(spark, d, "pages"))
    before = F.concat(F.lpad((F.col("page_id") - 1).cast("string"), 10, "0"), F.when(F.col("page_id") % 11 == 0, "x.html#top").otherwise(".html#top"))
    hrefs = F.array(before, F.lit("https://elsewhere.example/a"), F.lit("#here"))
    return rows.select(F.col("collection").alias("src_collection"), F.col("page").alias("src_page"), F.posexplode(hrefs).alias("ordinal", "href"))


_LINKS = f"""{MAN}, links AS (SELECT man.*, lpad((page_id - 1)::VARCHAR, 10, '0') || CASE WHEN page_id % 11 = 0 THEN 'x' ELSE '' END || '.html' AS dst FROM man),
resolved AS (SELECT l.collection, l.page, l.dst, m.page IS NOT NULL AS hit FROM links l LEFT JOIN man m ON m.collection = l.collection AND m.page = l.dst)"""


@query(f"""WITH {_LINKS} SELECT collection AS src_collection, page AS src_page, dst AS dst_page, CASE WHEN hit THEN 'own' ELSE 'dead' END AS state FROM resolved
UNION ALL SELECT collection, page, NULL, unnest(['external', 'fragment']) FROM man""")
def j07_resolve_links(spark, d):
    return W.resolve_links(_links(spark, d), manifest(spark, d)).select("src_collection", "src_page", "dst_page", "state")


@query(rf"""WITH links AS (SELECT page_id, url, generate_subscripts(h, 1)::INTEGER - 1 AS ordinal, unnest(h) AS href FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"[^>]*>(.*?)</a>', 1) AS h FROM pages))
SELECT page_id, ordinal, href, CASE WHEN NOT regexp_matches(href, '^(?:[A-Za-z][A-Za-z0-9+.-]*:|//|#)') THEN regexp_extract(regexp_replace(href, '[?#].*$', ''), '[^/]*$', 0) END AS dst_page,
CASE WHEN regexp_matches(href, '^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)') THEN 'external' WHEN starts_with(href, '#') THEN 'fragment' ELSE 'dead' END AS state FROM links""")
def j07_links_of_pages(spark, d):
    """The pages' own links against the derived manifest: names of files made of ids, which none of them is."""
    pages = C.page_table(table(spark, d, "pages"))
    links = P.page_links(pages, keep=["collection", "page"]).select("page_id", "ordinal", "href", F.col("collection").alias("src_collection"), F.col("page").alias("src_page"))
    return W.resolve_links(links, manifest(spark, d)).select("page_id", "ordinal", "href", "dst_page", "state")


@query(f"""WITH {_LINKS}, d AS (SELECT collection, dst AS page, count(*) AS n FROM resolved GROUP BY ALL)
SELECT man.collection, man.page, 3 AS out_links, coalesce(n, 0) AS in_links, n IS NULL AS orphan FROM man LEFT JOIN d USING (collection, page)""")
def a09_link_degrees(spark, d):
    return W.link_degrees(W.resolve_links(_links(spark, d), manifest(spark, d)), manifest(spark, d))


@query(f"WITH {MAN} SELECT collection, ordinal, page, page_id % 13 <> 0 AS listed, page_id % 3 <> 0 AS agrees FROM man")
def j08_toc_vs_pages(spark, d):
    listed = manifest(spark, d)
    printed = (_id() % 10000 + F.when(_id() % 3 == 0, 1).otherwise(0)).cast("int")
    toc = listed.select("collection", "ordinal", F.concat(F.lit("../"), "collection", F.lit("/"), "page", F.lit("#p")).alias("href"), printed.alias("printed_page"))
    return W.toc_vs_pages(toc, listed.filter(_id() % 13 != 0)).select("collection", "ordinal", "page", "listed", "agrees")


_TOC = r"""('<p>' || source || '…' || doc_id || '<br>&nbsp;<a href="' || lang || '.html">' || lang || '</a></p>')"""


@query("SELECT doc_id, 0 AS ordinal, 0 AS level, source AS title, NULL AS href, doc_id::INTEGER AS printed_page FROM documents UNION ALL SELECT doc_id, 1, 1, lang, lang || '.html', NULL FROM documents")
def p26_toc_rows(spark, d):
    return P.toc_rows(table(spark, d, "documents").select("doc_id", F.expr(_TOC).alias("html")), key="doc_id")


@query("""WITH s AS (SELECT DISTINCT c_nationkey AS book, c_custkey AS unit, c_custkey % 3 AS item, c_custkey // 2 AS start_page FROM customer),
n AS (SELECT book, start_page, lead(start_page) OVER (PARTITION BY book ORDER BY start_page) AS stop FROM (SELECT DISTINCT book, start_page FROM s))
SELECT s_suppkey AS lookup_id, unit, item, s.start_page FROM supplier JOIN n ON n.book = s_nationkey AND s_suppkey * 7 >= n.start_page AND (stop IS NULL OR s_suppkey * 7 < stop) JOIN s ON s.book = n.book AND s.start_page = n.start_page""")
def j09_locate_printed_page(spark, d):
    customer = table(spark, d, "customer")
    sections = customer.select(F.col("c_nationkey").alias("book"), F.col("c_custkey").alias("unit"), (F.col("c_custkey") % 3).alias("item"), F.floor(F.col("c_custkey") / 2).alias("start_page"))
    lookups = table(spark, d, "supplier").select(F.col("s_suppkey").alias("lookup_id"), F.col("s_nationkey").alias("book"), (F.col("s_suppkey") * 7).alias("printed_page"))
    return W.locate_printed_page(lookups, sections).select("lookup_id", "unit", "item", "start_page")


@query(f"SELECT {sql.PAGE.replace(chr(39) + '.html' + chr(39), chr(39) + chr(39))} AS stem, page_id % 4 <> 0 AS in_old, page_id % 4 <> 1 AS in_new, page_id % 4 = 2 AS same_text FROM pages")
def j10_match_editions(spark, d):
    pages = C.page_table(table(spark, d, "pages"))
    old = pages.filter("page_id % 4 <> 0").select(F.regexp_replace("page", "html$", "htm").alias("page"), F.concat(F.lit("<script>x</script>\n"), "html").alias("html"))
    new = pages.filter("page_id % 4 <> 1").select("page", F.when(F.col("page_id") % 4 == 3, F.concat("html", F.lit("more"))).otherwise(F.col("html")).alias("html"))
    return W.match_editions(old, new)


@query(f"WITH {MAN}, c AS (SELECT collection, min(page_id) AS m FROM man GROUP BY ALL) SELECT collection, CASE WHEN m % 3 = 0 THEN 'manifest_only' ELSE 'both' END AS state FROM c UNION ALL SELECT collection || '.old', 'index_only' FROM c WHERE m % 3 = 1")
def j11_index_vs_collections(spark, d):
    least = manifest(spark, d).groupBy("collection").agg(F.min(_id()).alias("m"))
    index = least.filter("m % 3 <> 0").select("collection").union(least.filter("m % 3 = 1").select(F.concat("collection", F.lit(".old"))))
    return W.index_vs_collections(index, manifest(spark, d))


@query(f"SELECT line, count(*) AS n_docs FROM (SELECT DISTINCT doc_id, {sql.trim('unnest(string_split(text, chr(10)))')} AS line FROM documents) WHERE line <> '' GROUP BY line HAVING count(*) >= 5")
def a06_boilerplate_lines(spark, d):
    return W.boilerplate_lines(table(spark, d, "documents"), 5, key="doc_id", html="text")


@query(f"""WITH l AS (SELECT doc_id, generate_subscripts(w, 1) AS place, unnest(w) AS line FROM (
  SELECT doc_id, [x FOR x IN [{sql.trim("y")} FOR y IN string_split(text, chr(10))] IF x <> ''] AS w FROM documents)),
f AS (SELECT line FROM l GROUP BY line HAVING count(DISTINCT doc_id) >= 3),
r AS (SELECT doc_id, place, line, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS run FROM l JOIN f USING (line)),
b AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY place) AS block, count(*) AS n_lines FROM r GROUP BY doc_id, run)
SELECT block, n_lines, count(DISTINCT doc_id) AS n_docs FROM b GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3""")
def a06_boilerplate_blocks(spark, d):
    return W.boilerplate_blocks(table(spark, d, "documents"), 3, key="doc_id", html="text")


@query("SELECT sha256(text) AS digest, count(*) AS n, min(source || '/' || doc_id) AS keeper FROM documents GROUP BY text HAVING count(*) > 1")
def a07_duplicate_pages(spark, d):
    docs = table(spark, d, "documents").select("text", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"))
    return W.duplicate_pages(docs, html="text")


@query(f"WITH {MAN} SELECT collection, count(*) AS pages, max(CASE WHEN page_id % 2 = 0 THEN '2025-01-01' END) AS lastmod FROM man GROUP BY collection")
def a08_collection_sizes(spark, d):
    sitemap = C.derived_sitemap(table(spark, d, "pages")).filter(F.regexp_extract("loc", r"(\d)\.html$", 1).cast("int") % 2 == 0)
    return W.collection_sizes(manifest(spark, d), sitemap).withColumn("lastmod", F.col("lastmod").cast("string"))


@query("SELECT user_id AS query_id, event_id % 10 AS doc_id, (value::BIGINT) % 50 AS location, sum(event_id % 5)::BIGINT AS mass FROM events GROUP BY ALL")
def a12_location_mass(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("query_id"), (F.col("event_id") % 10).alias("doc_id"), (F.rint("value").cast("long") % 50).alias("location"), (F.col("event_id") % 5).alias("balanced_score"))
    return E.location_mass(rows)


_NEAR = f"{MAN}, near AS (SELECT *, lag(page) OVER (PARTITION BY collection ORDER BY ordinal) AS prev, lead(page) OVER (PARTITION BY collection ORDER BY ordinal) AS next FROM man)"


@query(f"WITH {_NEAR} SELECT collection, page, prev, next FROM near")
def w01_neighbours(spark, d):
    return W.neighbours(manifest(spark, d)).select("collection", "page", "prev", "next")


@query(f"WITH {_NEAR} SELECT collection, page, coalesce(prev = lpad((page_id - 1)::VARCHAR, 10, '0') || '.html', FALSE) AND coalesce(next = lpad((page_id + 1)::VARCHAR, 10, '0') || '.html', FALSE) AS agrees FROM near")
def w02_audit_navigation(spark, d):
    listed = manifest(spark, d)
    name = lambda k: F.concat(F.lpad((_id() + k).cast("string"), 10, "0"), F.lit(".html"))
    footers = listed.select("collection", "page", name(-1).alias("declared_prev"), name(1).alias("declared_next"))
    return W.audit_navigation(listed, footers).select("collection", "page", "agrees")


@query(f"""WITH {_NEAR} SELECT collection, page, prev, next, CASE WHEN page_id % 7 <> 0 THEN prev END AS declared_prev, CASE WHEN page_id % 5 = 0 THEN page ELSE next END AS declared_next,
(page_id % 7 <> 0 OR prev IS NULL) AND page_id % 5 <> 0 AS agrees FROM near""")
def w02_footers(spark, d):
    """Pages with a navigation of their own at the end, of which some leave out or mistake a neighbour, read and held against the manifest."""
    near = W.neighbours(manifest(spark, d)).withColumn("page_id", _id())
    link = lambda href, said: F.coalesce(F.concat(F.lit('<p><a href="'), href, F.lit(f'">{said}</a></p>')), F.lit(""))
    before, after = F.when(F.col("page_id") % 7 != 0, F.concat(F.lit("./"), "prev")), F.when(F.col("page_id") % 5 == 0, F.col("page")).otherwise(F.col("next"))
    footer = F.concat(F.lit("<hr/>"), link(F.lit("index.html"), "目次に戻る"), link(before, "前のページに戻る"), link(F.concat(after, F.lit("#top")), "次のページに進む"))
    pages = C.page_table(table(spark, d, "pages")).join(near.select("page_id", "prev", "next"), "page_id")
    return W.audit_navigation(manifest(spark, d), W.footers(pages.select("collection", "page", F.concat("html", footer).alias("html"))))


@query(f"WITH {MAN}, n AS (SELECT collection, count(*) AS n FROM man GROUP BY ALL) SELECT collection, ordinal, page FROM man JOIN n USING (collection) WHERE ordinal = floor(0.37 * n)")
def w03_page_at(spark, d):
    return W.page_at(manifest(spark, d), 0.37)


@query(f"WITH {MAN} SELECT collection, arg_min(ordinal, lot)::INTEGER AS ordinal, arg_min(page, lot) AS page FROM (SELECT *, md5('7/' || collection || '/' || ordinal) AS lot FROM man) GROUP BY collection")
def w03_random_page(spark, d):
    return W.random_page(manifest(spark, d), 7)


@query(f"WITH {MAN} SELECT collection, page FROM man ORDER BY md5('7/' || collection || '/' || ordinal), collection, ordinal LIMIT 1")
def w04_random_site_page(spark, d):
    return W.random_site_page(manifest(spark, d), 7)


#: first: the sum of the first 30 words; s: that of words i + 1 to i + 30; begin: the first best start; run: the other starts that follow it one by one.
_W05 = rf"""WITH w AS (SELECT doc_id, string_split_regex(lower(text), '{sql.WS}+') AS w FROM documents),
hit AS (SELECT * FROM (SELECT doc_id, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS x FROM w) WHERE x IN ('the', 'of', 'de', 'der', 'la', 'que')),
place AS (SELECT doc_id, unnest(range(n)) AS i FROM (SELECT doc_id, max(i) + 1 AS n FROM hit GROUP BY ALL) WHERE n > 30),
mass AS (SELECT place.doc_id, place.i, count(x) AS m FROM place LEFT JOIN hit ON hit.doc_id = place.doc_id AND hit.i = place.i GROUP BY ALL),
sums AS (SELECT doc_id, i, coalesce(sum(m) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING), 0) AS s, sum(CASE WHEN i < 30 THEN m ELSE 0 END) OVER (PARTITION BY doc_id) AS first FROM mass),
best AS (SELECT *, max(greatest(s, first)) OVER (PARTITION BY doc_id) AS best FROM sums),
began AS (SELECT *, CASE WHEN best = first THEN 0 ELSE min(i) FILTER (WHERE s = best) OVER (PARTITION BY doc_id) END AS begin FROM best),
run AS (SELECT doc_id, begin, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM began WHERE s = best AND i > begin),
size AS (SELECT doc_id, any_value(begin) AS begin, 1 + count(i) AS n FROM (SELECT DISTINCT began.doc_id, began.begin, run.i FROM began LEFT JOIN run ON run.doc_id = began.doc_id AND run.k = run.begin) GROUP BY doc_id)
SELECT documents.doc_id, coalesce(begin + n // 2, 0)::INTEGER AS start FROM documents LEFT JOIN size ON size.doc_id = documents.doc_id"""


@query(_W05)
def w05_excerpt_start(spark, d):
    """Where each document's excerpt starts, hits being its commonest words."""
    docs = table(spark, d, "documents").select("doc_id", X.words(F.lower("text")).alias("w"))
    hits = F.filter(F.transform("w", lambda w, i: F.when(w.isin("the", "of", "de", "der", "la", "que"), i)), lambda i: i.isNotNull())
    scored = docs.select("doc_id", hits.alias("at")).withColumn("s", F.transform("at", lambda i: F.lit(1.0)))
    return scored.select("doc_id", E.excerpt_start("at", "s", F.lit(30)).alias("start"))


@query(f"""SELECT doc_id, {sql.trim("array_to_string([CASE WHEN (i - 1) % 7 = 0 THEN '<mark>' || w[i] || '</mark>' ELSE w[i] END FOR i IN range(greatest(least(20, len(w) - 30), 0) + 1, least(greatest(least(20, len(w) - 30), 0) + 30, len(w)) + 1)], ' ')")} AS excerpt
FROM (SELECT doc_id, string_split_regex(text, '{sql.WS}+') AS w FROM documents)""")
def x01_build_excerpt(spark, d):
    rows = table(spark, d, "documents").select("doc_id", X.words(F.col("text")).alias("w"))
    rows = rows.select("doc_id", "w", F.transform(F.sequence(F.lit(0), F.floor(F.size("w") / 7).cast("int")), lambda i: i * 7).alias("at"))
    return rows.select("doc_id", E.build_excerpt(F.col("w"), F.lit(20), F.lit(30), F.col("at")).alias("excerpt"))


@query("""SELECT * FROM (SELECT user_id AS doc_id, start, length FROM (SELECT *, coalesce(max(start + length) OVER (PARTITION BY user_id ORDER BY start, length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
FROM (SELECT DISTINCT user_id, (event_id % 97)::INTEGER AS start, (event_id % 13)::INTEGER - 2 AS length FROM events) WHERE length > 0) WHERE start + length > b)""")
def w07_clean_ranges(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 97).cast("int").alias("start"), ((F.col("event_id") % 13).cast("int") - 2).alias("length")).distinct()
    return E.clean_ranges(rows)


@query("SELECT page_id, ordinal, location, lead(location) OVER (PARTITION BY page_id ORDER BY location, ordinal) AS stop FROM (SELECT event_id AS ordinal, user_id AS page_id, (event_id % 89) AS location FROM events)")
def w06_section_ends(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("page_id"), F.col("event_id").alias("ordinal"), (F.col("event_id") % 89).alias("location"))
    return E.section_ends(rows, ("page_id",)).withColumnRenamed("end", "stop")


@query("""WITH w AS (SELECT user_id AS query_id, event_id, event_id % 89 AS location FROM events WHERE event_id % 10 <> 1),
a AS (SELECT user_id AS query_id, event_id AS ordinal, event_id % 89 AS location FROM events WHERE event_id % 10 = 1)
SELECT w.query_id, w.location, max(a.location * 100000000 + a.ordinal) % 100000000 AS heading, count(DISTINCT event_id) AS n FROM w LEFT JOIN a ON a.query_id = w.query_id AND a.location <= w.location GROUP BY ALL""")
def j04_assign_heading(spark, d):
    events = table(spark, d, "events")
    words = events.filter("event_id % 10 <> 1").select(F.col("user_id").alias("query_id"), F.col("user_id").alias("doc_id"), (F.col("event_id") % 89).alias("location"), F.lit(1.0).alias("balanced_score"))
    anchors = events.filter("event_id % 10 = 1").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("ordinal"), F.lit("h2").alias("element"), F.lit("").alias("id"), F.lit("t").alias("text"), (F.col("event_id") % 89).alias("location"))
    placed = E.assign_heading(words, E.section_ends(anchors))
    return placed.groupBy("query_id", "location", F.col("anchor.ordinal").alias("heading")).agg(F.count("*").alias("n"))


#: o: a section's heading by number, -1 before the first; the fold is that of w05, over 12 words.
_X02 = rf"""WITH base AS (SELECT doc_id, lang, '/' || source AS url, string_split_regex(text, '{sql.WS}+') AS w FROM documents),
lines AS (SELECT doc_id, generate_subscripts(l, 1) AS line, unnest(l) AS body FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
placed AS (SELECT doc_id, line, regexp_extract(body, '^(\S+)', 1) AS h, coalesce(sum(len([x FOR x IN string_split_regex(body, '{sql.WS}+') IF x <> ''])) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS location FROM lines),
heads AS (SELECT doc_id, h, location, row_number() OVER d - 1 AS ordinal, lead(location) OVER d AS stop FROM placed WHERE h <> '' WINDOW d AS (PARTITION BY doc_id ORDER BY line)),
firsts AS (SELECT doc_id, min(location) AS first FROM heads GROUP BY ALL),
hits AS (SELECT * FROM (SELECT doc_id, generate_subscripts(w, 1) - 1 AS location, unnest(w) AS x FROM base) WHERE lower(x) IN ('the', 'of', 'de', 'der', 'la', 'que')),
assigned AS (SELECT hits.doc_id, hits.location, h, ordinal, coalesce(heads.location, 0) AS begin, stop FROM hits ASOF LEFT JOIN heads ON heads.doc_id = hits.doc_id AND hits.location >= heads.location),
sections AS (SELECT doc_id, coalesce(ordinal, -1) AS o, h, ordinal, begin, CASE WHEN ordinal IS NULL THEN first ELSE stop END AS stop, list(location) AS locs, max(location) AS last
  FROM assigned LEFT JOIN firsts USING (doc_id) GROUP BY ALL),
sized AS (SELECT sections.*, last - begin + 1 AS n, lang, url, w, coalesce(stop, len(w)) AS endcap, least(coalesce(stop, len(w)) - begin, 12) AS size FROM sections JOIN base USING (doc_id)),
place AS (SELECT doc_id, o, begin, locs, unnest(range(n)) AS i FROM sized WHERE n > size),
mass AS (SELECT doc_id, o, i, CASE WHEN list_contains(locs, begin + i) THEN 1 ELSE 0 END AS m FROM place),
sums AS (SELECT doc_id, o, i, coalesce(sum(m) OVER (PARTITION BY doc_id, o ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING), 0) AS s, sum(CASE WHEN i < 12 THEN m ELSE 0 END) OVER (PARTITION BY doc_id, o) AS first FROM mass),
best AS (SELECT *, max(greatest(s, first)) OVER (PARTITION BY doc_id, o) AS best FROM sums),
began AS (SELECT *, CASE WHEN best = first THEN 0 ELSE min(i) FILTER (WHERE s = best) OVER (PARTITION BY doc_id, o) END AS start FROM best),
run AS (SELECT doc_id, o, i, i - row_number() OVER (PARTITION BY doc_id, o ORDER BY i) AS k FROM began WHERE s = best AND i > start),
fold AS (SELECT doc_id, o, (any_value(start) + (1 + count(i)) // 2)::BIGINT AS start FROM (SELECT DISTINCT began.doc_id, began.o, began.start, run.i FROM began LEFT JOIN run ON run.doc_id = began.doc_id AND run.o = began.o AND run.k = began.start) GROUP BY ALL),
begun AS (SELECT sized.*, coalesce(start, 0) + begin AS start FROM sized LEFT JOIN fold USING (doc_id, o)),
shown AS (SELECT *, greatest(CASE WHEN start + size > endcap THEN endcap - size ELSE start END, begin) AS at_word FROM begun),
subs AS (SELECT doc_id, ordinal, o, coalesce(h, lang) AS title, url AS page, CASE WHEN regexp_extract(h, '^[^"'']*') <> '' THEN url || '#' || regexp_extract(h, '^[^"'']*') ELSE url END AS url, len(locs)::INTEGER AS n,
  {sql.trim("array_to_string([CASE WHEN list_contains(locs, i - 1) THEN '<mark>' || w[i] || '</mark>' ELSE w[i] END FOR i IN range(at_word + 1, least(at_word + size, len(w)) + 1)], ' ')")} AS excerpt FROM shown),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS k FROM subs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, k) AS r FROM numbered WHERE NOT (k = 1 AND url = page)),
kept AS (SELECT *, bool_or(r <= 3) OVER (PARTITION BY doc_id, url) AS keep FROM ranked)
SELECT 1::BIGINT AS query_id, doc_id, ordinal::INTEGER AS ordinal, title, url, n, excerpt, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INTEGER AS position FROM kept WHERE keep"""


@query(_X02)
def x02_sub_results(spark, d):
    """The three best sections of every document, each of its lines being a heading; hits are its commonest words."""
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"), F.concat(F.lit("/"), "source").alias("url"), F.col("lang").alias("title"))
    anchors = P.page_anchors(docs.select("doc_id", F.regexp_replace("content", r"(?m)^(\S+)", '<h2 id="$1">$1</h2>').alias("html")), key="doc_id")
    words = P.tokens(docs, "doc_id", "content").filter(F.lower("word").isin("the", "of", "de", "der", "la", "que"))
    placed = words.select(F.lit(1).cast("long").alias("query_id"), "doc_id", "location", F.lit(1.0).alias("balanced_score"))
    return E.best_sub_results(E.sub_results(placed, anchors, docs), docs.select("doc_id", "url")).select("query_id", "doc_id", "ordinal", "title", "url", F.size("locations").alias("n"), "excerpt", "position")


KEYWORDS = ["the", "then", "le", "under", "zu"]
#: Their patterns, written out for the SQL: letters match each other without regard to diacritics.
_D, _E, _L, _N, _R, _T = "[dđď]", "[eèéẻẽẹêềếểễệëěēę]", "[lł]", "[nñňń]", "[rř]", "[tťțţ]"
_U, _Z = "[uùúủũụưừứửữựûüůū]", "[zžżź]"
_PATTERNS = {"the": f"{_T}h{_E}", "then": f"{_T}h{_E}{_N}", "le": f"{_L}{_E}", "under": f"{_U}{_N}{_D}{_E}{_R}", "zu": f"{_Z}{_U}"}


@query(rf"SELECT doc_id, md5(regexp_replace(text, '(?i)({_PATTERNS['under']}|{_PATTERNS['then']}|{_PATTERNS['the']}|{_PATTERNS['le']}|{_PATTERNS['zu']})', '<mark>\1</mark>', 'g')) AS digest, TRUE AS back FROM documents")
def x03_highlight(spark, d):
    """Removing the marks gives the text again."""
    marked = E.highlight(F.col("text"), KEYWORDS)
    return table(spark, d, "documents").select("doc_id", F.md5(marked).alias("digest"), (E.remove_highlights(marked) == F.col("text")).alias("back"))


@query(" UNION ALL ".join(f"SELECT '{k}' AS keyword, sum(len(regexp_extract_all(text, '(?i){x}')))::BIGINT AS matches, count(*) FILTER (WHERE regexp_matches(text, '(?i){x}')) AS documents FROM documents" for k, x in _PATTERNS.items()))
def x05_match_counts(spark, d):
    return E.match_counts(table(spark, d, "documents"), KEYWORDS)


_SYNONYMS = {"the": "is", "of": "and", "in": "to"}
_SYN_SQL = {"the of the": f"(?:the|is){sql.WS}+(?:of|and){sql.WS}+(?:the|is)", "in of": f"(?:in|to){sql.WS}+(?:of|and)", "of": "(?:of|and)", "le": "le"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS keyword, coalesce(sum(len(regexp_extract_all(text, '(?i){x}'))), 0)::BIGINT AS matches, count(*) FILTER (WHERE regexp_matches(text, '(?i){x}')) AS documents FROM documents" for k, x in _SYN_SQL.items()))
def x04_synonyms(spark, d):
    """Keywords with several words that have synonyms, one of them twice."""
    return E.match_counts(table(spark, d, "documents"), list(_SYN_SQL), E.MatchOptions(diacritics=False, synonyms=_SYNONYMS))


def _marked(x: str) -> str:
    return f"CASE WHEN {sql.trim(x)} = '' THEN {x} ELSE '<mark>' || {x} || '</mark>' END"


@query(f"SELECT doc_id, substr(text, 1, 3) || {_marked('substr(text, 4, 5)')} || substr(text, 9, 4) || {_marked('substr(text, 13, 4)')} || substr(text, 17) AS t FROM documents")
def x06_highlight_ranges(spark, d):
    two = F.array(F.struct(F.lit(3).alias("start"), F.lit(5).alias("length")), F.struct(F.lit(12).alias("start"), F.lit(4).alias("length")))
    return table(spark, d, "documents").select("doc_id", E.highlight_ranges(F.col("text"), two).alias("t"))


@query(f"WITH {MAN} SELECT collection, page, 'manifest' AS part FROM man UNION ALL SELECT collection, page, 'sitemap' FROM man")
def u03_union_site(spark, d):
    listed = manifest(spark, d).select("collection", "page")
    sitemap = C.derived_sitemap(table(spark, d, "pages")).select("collection", X.loc_to_page(F.col("loc")).alias("page"))
    return W.union_site(listed.withColumn("part", F.lit("manifest")), sitemap.withColumn("part", F.lit("sitemap")))


@query(f"WITH {MAN} SELECT collection, page, CASE WHEN page_id % 6 = 0 THEN 'less' ELSE 'common' END AS part FROM man")
def u04_site_difference(spark, d):
    listed = manifest(spark, d).select("collection", "page")
    other = listed.filter(_id() % 6 != 0)
    return W.site_difference(listed, other).withColumn("part", F.lit("less")).unionByName(W.site_common(listed, other).withColumn("part", F.lit("common")))


@query("""SELECT user_id, event_id, event_type AS term FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
WHERE nxt IS NULL OR epoch_us(nxt) - epoch_us(ts) > 300000""")
def r01_debounce(spark, d):
    return R.debounce(table(spark, d, "events").withColumnRenamed("event_type", "term")).select("user_id", "event_id", "term")


@query("""SELECT user_id, event_id AS request_id FROM (SELECT *, ts + to_seconds((event_id % 100) * 60) AS done, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
WHERE nxt IS NULL OR nxt > done""")
def r02_latest_wins(spark, d):
    requests = table(spark, d, "events").select("user_id", F.col("event_id").alias("request_id"), F.col("ts").alias("issued_at"), F.expr("ts + make_interval(0, 0, 0, 0, 0, (event_id % 100) * 1, 0)").alias("completed_at"))
    return R.latest_wins(requests).select("user_id", "request_id")


def _as_stream(spark, rows, closing, parts: int = 1):
    """rows as a stream of micro-batches, one for each part (dealt by a hash, so out of order), and after them closing rows, late enough to move the watermark past all."""
    path = new_path(spark, "stream")
    for part in range(parts):
        rows.filter(F.pmod(F.xxhash64(*rows.columns), F.lit(parts)) == part).coalesce(1).write.parquet(f"{path}/part={part}")
    closing.coalesce(1).write.parquet(f"{path}/part={parts}")
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True)
    return (stream.option("maxFilesPerTrigger", 1) if parts > 1 else stream).parquet(path)


def _run(spark, stream):
    """What a stream emits until its input is read up, as a table."""
    out = new_path(spark, "emitted")
    stream.writeStream.format("parquet").option("checkpointLocation", new_path(spark, "checkpoint")).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


_QUIET = "WHERE nxt IS NULL OR epoch_us(nxt) - epoch_us(ts) > 300000"


@query(f"SELECT user_id, event_id, event_type AS term FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) {_QUIET}")
def r01_debounce_stream(spark, d):
    """R1 over a stream of the events; a row of no user, a day after the last, closes all sessions."""
    events = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").alias("term"))
    closing = events.agg(F.lit(-1).cast("long").alias("user_id"), (F.max("ts") + F.make_dt_interval(F.lit(1))).alias("ts"), F.lit(-1).cast("long").alias("event_id"), F.lit("").alias("term"))
    return _run(spark, R.debounce_stream(_as_stream(spark, events, closing))).filter("user_id >= 0").select("user_id", "event_id", "term")


@query("""SELECT user_id, event_id AS request_id FROM (SELECT *, ts + to_seconds((event_id % 100) * 60) AS done, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
WHERE nxt IS NULL OR nxt > done""")
def r02_latest_wins_stream(spark, d):
    """R2 over a stream of the requests, out of order in three micro-batches; a request of no user, behind the lateness, lets the others' last go."""
    events = table(spark, d, "events").select("user_id", F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("issued_at"))
    requests = events.withColumn("completed_at", F.col("issued_at") + F.make_dt_interval(mins=(F.col("request_id") % 100).cast("int")))
    late = F.max("issued_at") + F.make_dt_interval(F.lit(50))
    closing = requests.agg(F.lit(-1).cast("long").alias("user_id"), F.lit(-1).cast("long").alias("request_id"), late.alias("issued_at"), late.alias("completed_at"))
    return _run(spark, R.latest_wins_stream(_as_stream(spark, requests, closing, parts=3), lateness="40 days")).filter("user_id >= 0").select("user_id", "request_id")
