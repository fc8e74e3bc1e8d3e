"""A site held against itself: files, manifests, sitemaps, links, contents, navigation, duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators.pages import page_links
from quillspark.operators.search import counted
from quillspark.sources.stored import stored

KEY = ["collection", "page"]


def _state(a: str, b: str, both: str, left: str, right: str):
    return F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), both).when(F.col(a).isNotNull(), left).otherwise(right)


def _compare(left: DataFrame, right: DataFrame, names: tuple[str, str, str]) -> DataFrame:
    a = left.select(*KEY, F.lit(1).alias("_a")).distinct()
    b = right.select(*KEY, F.lit(1).alias("_b")).distinct()
    return a.join(b, KEY, "full_outer").select(*KEY, _state("_a", "_b", *names).alias("state"))


def manifest_vs_files(manifest: DataFrame, pages: DataFrame) -> DataFrame:
    """collection, page, state: present, missing (listed, no file) or unlisted (file, not listed)."""
    return _compare(manifest, pages, ("present", "missing", "unlisted"))


def manifest_vs_sitemap(manifest: DataFrame, sitemap: DataFrame) -> DataFrame:
    """collection, page, state: both, manifest_only or sitemap_only; locations are decoded to file names."""
    return _compare(manifest, sitemap.select("collection", X.loc_to_page(F.col("loc")).alias("page")), ("both", "manifest_only", "sitemap_only"))


def resolve_links(links: DataFrame, manifest: DataFrame) -> DataFrame:
    """links (src_collection, src_page, href) with dst_collection, dst_page, fragment and state: own, other (another collection), dead, external or fragment."""
    path = F.regexp_replace("href", "[?#].*$", "")
    resolved = X.resolve_url(F.concat(F.lit("/"), "src_collection", F.lit("/"), "src_page"), path)
    kind = X.link_kind(F.col("href"))
    relative = kind == "relative"
    rows = links.withColumn("dst_collection", F.when(relative, F.regexp_extract(resolved, r"([^/]+)/[^/]*$", 1))).withColumn("dst_page", F.when(relative, F.regexp_extract(resolved, r"[^/]*$", 0))).withColumn("fragment", F.regexp_extract("href", "#(.*)$", 1))
    known = manifest.select(F.col("collection").alias("dst_collection"), F.col("page").alias("dst_page"), F.lit(1).alias("_hit")).distinct()
    state = F.when(kind == "absolute", "external").when(kind == "fragment", "fragment").when(F.col("_hit").isNull(), "dead").when(F.col("dst_collection") == F.col("src_collection"), "own").otherwise("other")
    return rows.join(known, ["dst_collection", "dst_page"], "left").withColumn("state", state).select(*links.columns, "dst_collection", "dst_page", "fragment", "state")


def toc_vs_pages(toc: DataFrame, manifest: DataFrame) -> DataFrame:
    """toc (collection, ordinal, href, printed_page) with listed (the page is in the manifest) and agrees (its code's page is the printed one)."""
    page = F.regexp_extract("href", r"([^/#?]*)(?:[#?].*)?$", 1)
    rows = toc.withColumn("page", F.when(F.col("href").isNotNull(), page))
    known = manifest.select("collection", "page", F.lit(True).alias("_hit")).distinct()
    joined = rows.join(known, KEY, "left")
    return joined.select(*toc.columns, "page", F.coalesce("_hit", F.lit(False)).alias("listed"), (X.page_code(F.col("page"))["start_page"] == F.col("printed_page")).alias("agrees"))


def locate_printed_page(lookups: DataFrame, sections: DataFrame) -> DataFrame:
    """lookups (lookup_id, book, printed_page) with the sections (book, unit, item, start_page) that hold the page.

    A section ends where the next larger start page of its book begins; sections with one start page all hold it.
    As of each page asked for, once however often it is asked, the last start page is found by a union and a window, then joined on equality.
    """
    starts = sections.select("book", F.col("start_page").alias("at"), F.lit(0).alias("kind")).distinct()
    asked = lookups.select("book", F.col("printed_page").alias("at"), F.lit(1).alias("kind")).distinct()
    order = Window.partitionBy("book").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = starts.unionByName(asked).withColumn("start_page", F.last(F.when(F.col("kind") == 0, F.col("at")), ignorenulls=True).over(order)).filter("kind = 1")
    placed = lookups.join(found.select("book", F.col("at").alias("printed_page"), "start_page"), ["book", "printed_page"])
    return placed.join(sections, ["book", "start_page"]).select("lookup_id", "book", "printed_page", "unit", "item", "start_page")


def match_editions(old: DataFrame, new: DataFrame) -> DataFrame:
    """stem, in_old, in_new, same_text of two editions (page, html), matched by the stem of the file name."""

    def side(df: DataFrame, name: str) -> DataFrame:
        text = F.regexp_replace(X.body_text(X.strip_boilerplate(F.col("html"))), rf"{X.WS}+", "")
        return df.select(F.regexp_replace("page", r"\.[^.]*$", "").alias("stem"), F.sha2(text, 256).alias(name))

    both = side(old, "a").join(side(new, "b"), "stem", "full_outer")
    return both.select("stem", F.col("a").isNotNull().alias("in_old"), F.col("b").isNotNull().alias("in_new"), F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("same_text"))


def index_vs_collections(site_index: DataFrame, manifest: DataFrame) -> DataFrame:
    """collection, state: both, index_only or manifest_only. site_index: collection."""
    a, b = site_index.select("collection", F.lit(1).alias("_a")).distinct(), manifest.select("collection", F.lit(1).alias("_b")).distinct()
    return a.join(b, "collection", "full_outer").select("collection", _state("_a", "_b", "both", "index_only", "manifest_only").alias("state"))


def _lines(html: str):
    return F.filter(F.transform(F.split(html, "\n"), X.trim_ws), lambda x: x != "")


def _frequent(pages: DataFrame, lines, min_docs: int) -> DataFrame:
    """digest: the hashes of lines that at least min_docs rows have, kept as a table, as it is counted and met more than once."""
    once = pages.select(F.explode(F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))).alias("digest"))
    return counted(stored(once.groupBy("digest").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("digest")))


def boilerplate_lines(pages: DataFrame, min_docs: int, key: str = "page_id", html: str = "html") -> DataFrame:
    """line, n_docs: trimmed lines of the markup that at least min_docs pages have. A page counts a line once. Lines are counted by a
    hash first, so that only those of frequent hashes travel as text."""
    lines = F.array_distinct(_lines(html))
    rows = pages.select(key, F.explode(lines).alias("line")).withColumn("digest", F.xxhash64("line")).join(_frequent(pages, lines, min_docs), "digest", "left_semi")
    return rows.groupBy("line").agg(F.count_distinct(key).alias("n_docs")).filter(F.col("n_docs") >= min_docs)


def boilerplate_blocks(pages: DataFrame, min_docs: int, key: str = "page_id", html: str = "html") -> DataFrame:
    """block, n_lines, n_docs: runs of neighbouring lines that at least min_docs pages have as a whole, with their lines joined by line feeds. key is unique.

    A run is as long as its page has lines that min_docs pages have, one after the other; lines are trimmed, blank ones don't count, and a page
    counts a run once. Lines are counted by a hash first, so that only those of frequent hashes travel as text.
    """
    lines = _lines(html)
    digests = _frequent(pages, lines, min_docs)
    placed = pages.select(key, F.posexplode(lines).alias("at", "line")).withColumn("digest", F.xxhash64("line")).join(digests, "digest", "left_semi")
    texts = pages.select(F.explode(F.array_distinct(lines)).alias("line")).withColumn("digest", F.xxhash64("line")).join(digests, "digest", "left_semi")
    frequent = texts.groupBy("line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("line")
    held = placed.join(counted(stored(frequent)), "line", "left_semi").select(key, "at", "line")
    run = F.col("at") - F.row_number().over(Window.partitionBy(key).orderBy("at"))  # a page's rows: all steps up to the count of runs share this shuffle
    runs = held.withColumn("run", run).groupBy(key, "run").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("rows"))
    blocks = runs.select(key, F.size("rows").cast("long").alias("n_lines"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("block")).withColumn("digest", F.sha2("block", 256))
    blocks = blocks.groupBy(key, "digest").agg(F.first("block").alias("block"), F.first("n_lines").alias("n_lines"))
    return blocks.groupBy("digest").agg(F.first("block").alias("block"), F.first("n_lines").alias("n_lines"), F.count("*").alias("n_docs")).filter(F.col("n_docs") >= min_docs).drop("digest")


def duplicate_pages(pages: DataFrame, path: str = "path", html: str = "html") -> DataFrame:
    """digest, n, keeper (the least path) of pages that occur more than once."""
    return pages.groupBy(F.sha2(html, 256).alias("digest")).agg(F.count("*").alias("n"), F.min(path).alias("keeper")).filter("n > 1")


def collection_sizes(manifest: DataFrame, sitemap: DataFrame) -> DataFrame:
    """collection, pages, lastmod (the latest; null without a sitemap)."""
    pages = manifest.groupBy("collection").agg(F.count("*").alias("pages"))
    return pages.join(sitemap.groupBy("collection").agg(F.max("lastmod").alias("lastmod")), "collection", "left")


def link_degrees(links: DataFrame, manifest: DataFrame) -> DataFrame:
    """collection, page, out_links, in_links, orphan (no page links to it). links: resolved, src_ and dst_ columns."""
    out = links.groupBy(F.col("src_collection").alias("collection"), F.col("src_page").alias("page")).agg(F.count("*").alias("out_links"))
    into = links.filter("dst_page is not null").groupBy(F.col("dst_collection").alias("collection"), F.col("dst_page").alias("page")).agg(F.count("*").alias("in_links"))
    rows = manifest.select(*KEY).distinct().join(out, KEY, "left").join(into, KEY, "left")
    return rows.select(*KEY, F.coalesce("out_links", F.lit(0)).alias("out_links"), F.coalesce("in_links", F.lit(0)).alias("in_links"), F.col("in_links").isNull().alias("orphan"))


def citation_counts(citations: DataFrame, by_page: bool = False) -> DataFrame:
    """volume (and src_page), n."""
    return citations.groupBy("volume", *(["src_page"] if by_page else [])).agg(F.count("*").alias("n"))


def neighbours(manifest: DataFrame, chunk: int = 10_000) -> DataFrame:
    """manifest with prev and next page of the collection, null at its ends.

    A collection is ordered in chunks of ordinals, so that a large one isn't one task; chunks' first and last pages meet in a second, small step.
    """
    rows = manifest.withColumn("_chunk", F.floor(F.col("ordinal") / chunk))
    order = Window.partitionBy("collection", "_chunk").orderBy("ordinal")
    edges = rows.groupBy("collection", "_chunk").agg(F.min(F.struct("ordinal", "page"))["page"].alias("_head"), F.max(F.struct("ordinal", "page"))["page"].alias("_tail"))
    chunks = Window.partitionBy("collection").orderBy("_chunk")
    around = edges.select("collection", "_chunk", F.lag("_tail").over(chunks).alias("_before"), F.lead("_head").over(chunks).alias("_after"))
    near = rows.withColumn("prev", F.lag("page").over(order)).withColumn("next", F.lead("page").over(order)).join(around, ["collection", "_chunk"])
    return near.select(*manifest.columns, F.coalesce("prev", "_before").alias("prev"), F.coalesce("next", "_after").alias("next"))


#: What links to the neighbours and to the contents say, by which footers are read.
PREVIOUS, NEXT, CONTENTS = r"(?i)前の|\bprev", r"(?i)次の|\bnext\b", r"(?i)目次|\bindex\b|\bcontents\b"


def footers(pages: DataFrame, previous: str = PREVIOUS, following: str = NEXT, contents: str = CONTENTS) -> DataFrame:
    """collection, page, declared_prev, declared_next: the neighbours that a page's own links name, as audit_navigation reads them. pages: collection, page, html.

    A link's role is told by what it says; of a role's links the last one counts, as navigation ends a page. Addresses are resolved from the page, so
    one in another collection is no neighbour's name (it has the collection before it). A page that names only its contents has null for both;
    one without any such link has no row.
    """
    role = F.when(F.col("anchor_text").rlike(previous), "prev").when(F.col("anchor_text").rlike(following), "next").when(F.col("anchor_text").rlike(contents), "contents")
    links = page_links(pages.withColumn("_of", F.struct(*KEY)), key="_of").select("_of.*", "ordinal", "href", role.alias("role")).filter("role is not null")
    whole = X.resolve_url(F.concat(F.lit("/"), "collection", F.lit("/"), "page"), F.regexp_replace("href", "[?#].*$", ""))
    own = F.concat(F.lit("/"), "collection", F.lit("/"))
    name = X.decoded_path(F.when(whole.startswith(own), F.substr(whole, F.length(own) + 1)).otherwise(F.substr(whole, F.lit(2))))
    last = lambda kind: F.max(F.when(F.col("role") == kind, F.struct("ordinal", "name")))["name"]
    return links.withColumn("name", name).groupBy(*KEY).agg(last("prev").alias("declared_prev"), last("next").alias("declared_next"))


def audit_navigation(manifest: DataFrame, footers: DataFrame) -> DataFrame:
    """collection, page, prev, next, declared_prev, declared_next, agrees. footers: collection, page, declared_prev, declared_next."""
    joined = neighbours(manifest).join(footers, KEY)
    agrees = F.col("prev").eqNullSafe(F.col("declared_prev")) & F.col("next").eqNullSafe(F.col("declared_next"))
    return joined.select(*KEY, "prev", "next", "declared_prev", "declared_next", agrees.alias("agrees"))


def _draw(seed: int):
    """A page's lot in a draw: md5 of seed, collection and ordinal."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), "collection", F.col("ordinal").cast("string")))


def random_page(manifest: DataFrame, seed: int) -> DataFrame:
    """One page of each collection, uniform over seeds."""
    drawn = F.struct(_draw(seed).alias("h"), "ordinal", "page")
    return manifest.groupBy("collection").agg(F.min(drawn).alias("d")).select("collection", "d.ordinal", "d.page")


def page_at(manifest: DataFrame, u: float) -> DataFrame:
    """The page floor(u n) of each collection of n pages, for a u in [0, 1)."""
    sizes = manifest.groupBy("collection").agg(F.count("*").alias("n"))
    return manifest.join(sizes, "collection").filter(F.col("ordinal") == F.floor(F.lit(u) * F.col("n"))).select("collection", "ordinal", "page")


def random_site_page(manifest: DataFrame, seed: int) -> DataFrame:
    """One page of all, uniform over seeds."""
    return manifest.orderBy(_draw(seed), "collection", "ordinal").limit(1).select(*KEY)


def union_site(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def site_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that b hasn't, with repeats."""
    return a.exceptAll(b.select(*a.columns))


def site_common(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b.select(*a.columns))
