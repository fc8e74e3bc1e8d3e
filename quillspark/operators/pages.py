"""Rows taken out of pages: paragraphs, links, marks, citations, contents, words, headings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X

#: A link; its address is in one of the first three groups, its markup in the fourth.
LINK = r"""(?is)<a\b[^>]*?\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))[^>]*>(.*?)</a>"""
LINK_OPEN = LINK[: LINK.index("[^>]*>(")]
VOLUME = rf"[{X.KANJI}0-9]+"
#: Volume, page and perhaps a date, in brackets of full or half width.
CITATION = rf"[（(]({VOLUME})[―-]({VOLUME})(?:、([^（()）]*))?[)）]"


def paragraphs(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, ordinal, text of the non-blank lines of the visible text."""
    lines = F.transform(F.split(X.body_text(F.col(html)), "\n"), X.trim_ws)
    kept = F.filter(lines, lambda x: x != "")
    return pages.select(key, F.posexplode(kept).alias("ordinal", "text"))


def _href(parts) -> Column:
    """The address in the first three groups of LINK, of which two are empty."""
    return X.decode_entities(F.concat(*parts))


def page_links(pages: DataFrame, key: str = "page_id", html: str = "html", keep: Sequence[str] = ()) -> DataFrame:
    """key, the columns of keep, ordinal, href, anchor_text (without tags), kind. Links in comments don't count; entities are decoded."""
    shown = F.regexp_replace(F.col(html), r"(?s)<!--.*?-->", "")
    groups = [F.regexp_extract_all(shown, F.lit(LINK), F.lit(k)).alias(f"g{k}") for k in range(1, 5)]
    rows = pages.select(key, *keep, F.posexplode(F.arrays_zip(*groups)).alias("ordinal", "x")).withColumn("href", _href([F.col(f"x.g{k}") for k in (1, 2, 3)]))
    return rows.select(key, *keep, "ordinal", "href", X.trim_ws(X.decode_entities(X.strip_tags(F.col("x.g4")))).alias("anchor_text"), X.link_kind(F.col("href")).alias("kind"))


def page_marks(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, ordinal, printed_page, position: marks such as P.55 or P64, with their offset in the text (from 0). Texts stay where they are; their pieces' sizes are shuffled."""
    pieces = F.transform(F.split(F.col(text), r"(?=P\.?\s?[0-9])"), lambda p: F.struct(F.length(p).alias("size"), F.regexp_extract(p, r"^P\.?\s?([0-9]+)", 1).alias("number")))
    sized = rows.select(key, F.posexplode(pieces).alias("piece", "p")).select(key, "piece", "p.*")
    before = F.coalesce(F.sum("size").over(Window.partitionBy(key).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = sized.select(key, "piece", "number", before.alias("position")).filter("number <> ''")
    return found.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("piece")) - 1).alias("ordinal"), F.col("number").try_cast("int").alias("printed_page"), "position")


def citations(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, ordinal, volume, src_page, date, raw."""
    found = rows.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(CITATION), F.lit(0))).alias("ordinal", "raw"))
    part = lambda k: F.regexp_extract("raw", CITATION, k)
    return found.select(key, "ordinal", X.kanji_int(part(1)).alias("volume"), X.kanji_int(part(2)).alias("src_page"), X.citation_date(part(3)).alias("date"), "raw")


def toc_rows(pages: DataFrame, key: str = "collection", html: str = "html") -> DataFrame:
    """key, ordinal, level (indentation in characters), title, href (null without a link), printed_page (null without one)."""
    lines = F.filter(F.split(F.regexp_replace(F.col(html), r"(?i)<br\b[^>]*>|</?(?:p|li|div|ul|ol)\b[^>]*>", "\n"), "\n"), lambda x: X.trim_ws(X.strip_tags(x)) != "")
    rows = pages.select(key, F.posexplode(lines).alias("ordinal", "line"))
    shown = X.decode_entities(X.strip_tags(F.col("line")))
    page = F.regexp_extract(shown, rf"P?\.?([0-9]+){X.WS}*$", 1)
    return rows.select(
        key, "ordinal", F.length(F.regexp_extract(shown, rf"^{X.WS}*", 0)).alias("level"),
        X.trim_ws(F.regexp_replace(shown, rf"[…・.\s]*P?\.?[0-9]+{X.WS}*$", "")).alias("title"),
        F.nullif(_href([F.regexp_extract("line", LINK_OPEN, k) for k in (1, 2, 3)]), F.lit("")).alias("href"), page.try_cast("int").alias("printed_page"),
    )


def site_index(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, ordinal, title, href of the links in list items."""
    items = F.regexp_extract_all(F.regexp_replace(F.col(html), r"(?s)<!--.*?-->", ""), F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), F.lit(1))
    rows = pages.select(key, F.posexplode(F.filter(items, lambda x: x.rlike(LINK))).alias("ordinal", "item"))
    part = lambda k: F.regexp_extract("item", LINK, k)
    return rows.select(key, "ordinal", X.trim_ws(X.decode_entities(X.strip_tags(part(4)))).alias("title"), _href([part(1), part(2), part(3)]).alias("href"))


def tokens(rows: DataFrame, key: str, content: str) -> DataFrame:
    """key, location (from 0), word."""
    return rows.select(key, F.posexplode(X.words(F.col(content))).alias("location", "word"))


def heading_text(markup: Column) -> Column:
    return X.trim_ws(X.decode_entities(X.strip_tags(markup)))


def page_anchors(pages: DataFrame, key: str = "page_id", html: str = "html", text: Callable[[Column], Column] = heading_text) -> DataFrame:
    """key, ordinal, element, id, text, location (words before the heading in the visible text) of the headings. Of the texts, only headings are shuffled.

    text: what is shown of a heading's markup; as a rule without tags, entities decoded.
    """
    head = r"(?is)^<(h[1-6])\b([^>]*)>(.*?)</\1\s*>"

    bound = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  what is used twice is worked out once

    def piece(p: Column) -> Column:
        return F.struct(
            bound(X.body_text(p), lambda t: F.size(F.filter(X.words(t), lambda w: w != ""))).alias("size"), p.rlike(r"(?i)^<h[1-6]\b").alias("heading"), F.lower(F.regexp_extract(p, head, 1)).alias("element"),
            F.regexp_extract(F.regexp_extract(p, head, 2), r"""(?i)\bid\s*=\s*["']([^"']*)""", 1).alias("id"), text(F.regexp_extract(p, head, 3)).alias("text"),
        )

    cut = F.split(F.regexp_replace(F.col(html), X.HIDDEN, ""), r"(?i)(?=<h[1-6]\b)")
    pieces = pages.select(key, F.posexplode(F.transform(cut, piece)).alias("piece", "p")).select(key, "piece", "p.*")
    line = Window.partitionBy(key).orderBy("piece")
    placed = pieces.withColumn("location", F.coalesce(F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")).filter("heading")
    return placed.select(key, (F.row_number().over(line) - 1).alias("ordinal"), "element", "id", "text", "location")


def content_pages(pages: DataFrame, page: str = "page") -> DataFrame:
    """pages without index, random-picker and site-verification files."""
    return pages.filter(~F.col(page).rlike(r"(?i)^(?:index|random)[^/]*\.html?$|^google[0-9a-f]+\.html$"))


def map_terms(queries: DataFrame, rewrite: Callable[[Column], Column], term: str = "term") -> DataFrame:
    """A caller's rewriting of the search terms, before they are searched."""
    return queries.withColumn(term, rewrite(F.col(term)))


def map_results(results: DataFrame, rewrite: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A caller's rewriting of the results."""
    return results.transform(rewrite)


def result_card(docs: DataFrame) -> DataFrame:
    """doc_id, title, link (meta url, else url), image, extra (the other meta entries). docs: doc_id, url, meta."""
    shown = ("title", "image", "image_alt", "url")
    return docs.select(
        "doc_id", F.col("meta")["title"].alias("title"), F.coalesce(F.col("meta")["url"], "url").alias("link"), F.col("meta")["image"].alias("image"),
        F.map_filter("meta", lambda k, v: ~k.isin(*shown)).alias("extra"),
    )
