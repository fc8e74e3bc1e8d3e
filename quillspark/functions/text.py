"""Column functions over page markup, addresses, codes and search terms. All are built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ZWSP = "\u200b"
#: White space as browsers' scripts see it: Java's \s lacks the no-break, ideographic and other Unicode spaces.
WS = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: The same class for Java alone, which asks first whether a character is none of the letters and signs between, and so passes over most of a text at one test.
BLANK = rf"[[^!-\x{{9F}}\x{{A1}}-\x{{167F}}\x{{3001}}-\x{{FEFE}}]&&{WS}]"
#: Punctuation that is deleted from a search term (fixed values).
TERM_PUNCTUATION = r"""[.`~!@#$%^&*(){}\[\]\\|:;'",<>/?-]"""
PUNCTUATION = ".`~!@#$%^&*(){}[]\\|:;'\",<>/?-"
#: Elements whose text isn't shown.
HIDDEN = r"(?is)<(script|style|noscript|title)\b[^>]*>.*?</\1\s*>"
KANJI = "〇一二三四五六七八九"
#: Named entities that are decoded, & last so that nothing is decoded twice (fixed values).
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&hellip;", "…"), ("&mdash;", "—"), ("&ndash;", "–"), ("&amp;", "&"))


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", "")


# --- markup ---------------------------------------------------------------------------------------


def page_title(html: Column) -> Column:
    """Text of the first title element; null without one."""
    return F.nullif(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit(""))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<!--.*?-->|<[^>]*>", "")


def page_h1(html: Column) -> Column:
    """Text of the first h1 heading without tags; null without one."""
    return F.nullif(strip_tags(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)), F.lit(""))


def title_differs(html: Column) -> Column:
    return ~page_title(html).eqNullSafe(page_h1(html))


def page_lang(html: Column) -> Column:
    """Declared language in lower case, or "unknown"."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(html, r"""(?is)<html\b[^>]*\blang\s*=\s*["']?([A-Za-z0-9-]+)""", 1)), F.lit("")), F.lit("unknown"))


def page_meta(html: Column) -> Column:
    """Map of charset, og_image and generator; absent keys are left out."""
    found = {
        "charset": F.lower(F.regexp_extract(html, r"""(?is)<meta\b[^>]*\bcharset\s*=\s*["']?([A-Za-z0-9_-]+)""", 1)),
        "og_image": F.regexp_extract(html, r"""(?is)<meta\b[^>]*\bproperty\s*=\s*["']og:image["'][^>]*\bcontent\s*=\s*["']([^"']*)""", 1),
        "generator": F.regexp_extract(html, r"""(?is)<meta\b[^>]*\bname\s*=\s*["']generator["'][^>]*\bcontent\s*=\s*["']([^"']*)""", 1),
    }
    pairs = [x for k, v in found.items() for x in (F.lit(k), v)]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull() & (v != ""))


def _numeric_entity(text: Column, entity: Column) -> Column:
    """text with one numeric entity decoded, where it is a character and not &."""
    digits = F.regexp_replace(F.regexp_extract(entity, "&#[xX]?([0-9A-Fa-f]+);", 1), "^0+(?=.)", "")
    code = F.when(F.length(digits) <= 7, F.when(entity.rlike("&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits)).cast("long")
    letter = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when((code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)) & (code != 38), F.replace(text, entity, letter)).otherwise(text)


def decode_entities(text: Column) -> Column:
    """Named entities of the list and numeric ones decoded; & last, so that nothing is decoded twice. A number that is no character stays as it is."""
    return F.transform(F.array(text), lambda t: F.when(F.contains(t, F.lit("&")), _decoded(t)).otherwise(t))[0]  # bound once, as the text is an expression itself


def _decoded(text: Column) -> Column:
    found = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit("&#(?:[0-9]+|[xX][0-9A-Fa-f]+);"), F.lit(0)))
    numeric = lambda t: F.when(F.contains(t, F.lit("&#")), F.aggregate(found(t), t, _numeric_entity)).otherwise(t)
    text = F.transform(F.array(text), numeric)[0]
    for name, value in (*ENTITIES[:-1], ("&#38;", "&"), ("&#x26;", "&"), ENTITIES[-1]):
        text = F.replace(text, F.lit(name), F.lit(value))
    return text


def body_text(html: Column) -> Column:
    """Visible text: hidden elements and comments dropped, line and paragraph breaks as line feeds, tags stripped, entities decoded."""
    shown = F.regexp_replace(F.regexp_replace(html, HIDDEN, ""), r"(?s)<!--.*?-->", "")
    return decode_entities(strip_tags(F.regexp_replace(shown, r"(?i)<br\b[^>]*>|</?p\b[^>]*>", "\n")))


def strip_boilerplate(html: Column) -> Column:
    """Markup without navigation, footer, scripts and blocks (div) of advertisements or counters, with all that is nested in them.

    A fold over the tags of these elements counts how deep an element of the block's own name is nested. In a script nothing but its end
    counts. A block that isn't closed goes to the end of the page; an end tag without a block stays.
    """
    tag = r"</?(?:nav|footer|script|div)(?![A-Za-z0-9-])[^>]*>"
    split = lambda group: F.regexp_extract_all(html, F.lit(rf"(?is)(.*?)({tag}|\z)"), F.lit(group))
    block = r"""(?is)^<(?:(?:nav|footer|script)\b|div\b[^>]*\b(?:class|id)\s*=\s*["'](?:ad|ads|counter|nav|footer)["'])"""

    def step(state: Column, x: Column) -> Column:
        name, opens = F.lower(F.regexp_extract(x["tag"], r"^</?([A-Za-z]+)", 1)), ~x["tag"].startswith("</")
        own = (name == state["name"]) & ((name != "script") | ~opens)
        begins = (state["depth"] == 0) & x["tag"].rlike(block)
        depth = F.when(begins, 1).when((state["depth"] > 0) & own, state["depth"] + F.when(opens, 1).otherwise(-1)).otherwise(state["depth"])
        shown = F.when(state["depth"] == 0, F.when(begins, x["before"]).otherwise(F.concat(x["before"], x["tag"]))).otherwise(F.lit(""))
        return F.struct(depth.alias("depth"), F.when(begins, name).otherwise(state["name"]).alias("name"), F.concat(state["kept"], F.array(shown)).alias("kept"))

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("name"), F.array().cast("array<string>").alias("kept"))
    return F.aggregate(F.arrays_zip(split(1).alias("before"), split(2).alias("tag")), start, step, lambda s: F.array_join(s["kept"], ""))


# --- addresses ------------------------------------------------------------------------------------


def link_kind(href: Column) -> Column:
    """absolute, fragment or relative."""
    return F.when(href.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)"), "absolute").when(href.startswith("#"), "fragment").otherwise("relative")


def dir_of(path: Column) -> Column:
    """The path up to its last slash."""
    return F.regexp_replace(path, r"/[^/]*$", "/")


def without_dots(path: Column) -> Column:
    """A path with "." and ".." segments resolved, by a fold that pushes segments and pops them; above the root ".." is dropped."""
    parts, rooted = F.split(path, "/"), path.startswith("/")
    root = F.when(rooted, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    floor = F.when(rooted, 1).otherwise(0)
    up = lambda a: F.when(F.size(a) > floor, F.slice(a, 1, F.size(a) - 1)).otherwise(a)
    step = lambda a, x: F.when(x == "..", up(a)).when(x == ".", a).otherwise(F.concat(a, F.array(x)))
    folded = F.aggregate(F.when(rooted, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts), root, step)
    ended = F.when(path.rlike(r"(?:^|/)\.\.?$"), F.concat(folded, F.array(F.lit("")))).otherwise(folded)  # a folder
    return F.when(path.rlike(r"(?:^|/)\.\.?(?:/|$)"), F.array_join(ended, "/")).otherwise(path)


def resolve_url(base: Column, href: Column) -> Column:
    """href against the page base, as browsers do: absolute kept (with the base's scheme where it has none), fragments and queries put to the
    page, "." and ".." resolved at any depth, empty segments kept. A base may be a path alone."""
    scheme, page = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)?", 0), F.regexp_replace(base, "#.*$", "")
    site = F.regexp_extract(base, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?", 0)
    bare = F.regexp_replace(page, r"\?.*$", "")
    base_path = F.substring(bare, F.length(site) + 1, F.length(bare))
    path, rest = F.regexp_extract(href, "^[^?#]*", 0), F.regexp_extract(href, r"[?#].*$", 0)
    folder = F.when(F.contains(base_path, F.lit("/")), dir_of(base_path)).otherwise(F.when(site.contains("//"), "/").otherwise(""))
    joined = F.concat(site, without_dots(F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))), rest)
    return (
        F.when(href.startswith("//"), F.concat(scheme, href)).when(link_kind(href) == "absolute", href).when(href.startswith("#"), F.concat(page, href))
        .when(href == "", page).when(href.startswith("?"), F.concat(bare, href)).otherwise(joined)
    )


def full_url(raw: Column, base: Column) -> Column:
    """raw if absolute; else base/raw with runs of slashes made one, and the scheme's two restored."""
    joined = F.regexp_replace(F.concat(base, F.lit("/"), raw), r"/+", "/")
    return F.when(raw.rlike(r"^(?:https?:)?//"), raw).otherwise(F.regexp_replace(joined, r"^(https?:)/", "$1//"))


def decoded(text: Column) -> Column:
    """Percent signs and plus signs decoded; a text with a stray % stays as it is."""
    return F.coalesce(F.try_url_decode(text), text)


def decoded_path(path: Column) -> Column:
    """The same for a path, in which a plus sign is one."""
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def loc_to_page(loc: Column) -> Column:
    """The file name of a location, decoded; a literal + stays."""
    return decoded_path(F.regexp_extract(loc, r"[^/]*$", 0))


def page_to_loc(page: Column, base: Column) -> Column:
    return F.concat(base, F.replace(F.url_encode(page), F.lit("+"), F.lit("%20")))


def with_param(url: Column, key: str, value: Column | str) -> Column:
    """url with one more query parameter, before any fragment."""
    bare, fragment = F.regexp_replace(url, "#.*$", ""), F.regexp_extract(url, "#.*$", 0)
    value = F.lit(value) if isinstance(value, str) else value
    return F.concat(bare, F.when(F.contains(bare, F.lit("?")), "&").otherwise("?"), F.lit(f"{key}="), F.url_encode(value), fragment)


def query_params(url: Column, key: str) -> Column:
    """All values of a query parameter, decoded, in order; a value with a stray % stays as it is."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return F.transform(F.regexp_extract_all(query, F.lit(rf"(?:^|&){re.escape(key)}=([^&]*)"), F.lit(1)), decoded)


def query_param(url: Column, key: str) -> Column:
    """The first value of a query parameter; null without one."""
    return F.get(query_params(url, key), F.lit(0))


def highlight_url(url: Column, term: Column, param: str | None) -> Column:
    """url with one parameter for each word of term; unchanged when param is None."""
    if param is None:
        return url
    words = F.filter(F.split(term, rf"{WS}+"), lambda w: w != "")
    query = F.array_join(F.transform(words, lambda w: F.concat(F.lit(f"{param}="), F.url_encode(w))), "&")
    bare, fragment = F.regexp_replace(url, "#.*$", ""), F.regexp_extract(url, "#.*$", 0)
    return F.when(F.size(words) > 0, F.concat(bare, F.when(F.contains(bare, F.lit("?")), "&").otherwise("?"), query, fragment)).otherwise(url)


def anchor_url(url: Column, anchor: Column) -> Column:
    """url with its fragment set; a relative url gets a leading slash."""
    bare = F.regexp_replace(url, "#.*$", "")
    return F.concat(F.when(bare.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//|^/"), bare).otherwise(F.concat(F.lit("/"), bare)), F.lit("#"), anchor)


# --- codes, dates, citations ----------------------------------------------------------------------


def page_code(page: Column) -> Column:
    """struct(book, unit, item, start_page) of a ten-digit stem; null for other names."""
    parts = [F.regexp_extract(page, r"^(\d{2})(\d{2})(\d{2})(\d{4})(?:\.|$)", k).cast("int") for k in range(1, 5)]
    return F.when(page.rlike(r"^\d{10}(?:\.|$)"), F.struct(*[p.alias(n) for p, n in zip(parts, ("book", "unit", "item", "start_page"))]))


def section_code(page: Column) -> Column:
    """Numbers of names such as 4-4-2.html or Part050701.html (two digits each); null for other names."""
    dashed = F.when(page.rlike(r"^\d+(?:-\d+)+(?:\.|$)"), F.regexp_extract_all(F.regexp_replace(page, r"\..*$", ""), F.lit(r"\d+"), F.lit(0)))
    paired = F.when(page.rlike(r"^[A-Za-z]+(?:\d{2})+(?:\.|$)"), F.regexp_extract_all(F.regexp_replace(page, r"\..*$", ""), F.lit(r"\d{2}"), F.lit(0)))
    return F.transform(F.coalesce(dashed, paired), lambda x: x.cast("int"))


def stem_date(page: Column) -> Column:
    """The date of a YYMMDD stem, in the century 20xx; a suffix letter or range end is ignored; null for others."""
    digits = F.regexp_extract(page, r"^(\d{6})(?:[a-z]|-\d+)?(?:\.|$)", 1)
    return F.when(digits != "", F.try_to_timestamp(F.concat(F.lit("20"), digits), F.lit("yyyyMMdd"))).cast("date")


def title_parts(title: Column) -> Column:
    """struct(collection, section): a title "collection_section/site"."""
    bare = F.regexp_replace(title, r"/[^/]*$", "")
    return F.struct(F.element_at(F.split(bare, "_", 2), 1).alias("collection"), F.get(F.split(bare, "_", 2), F.lit(1)).alias("section"))


def kanji_int(s: Column) -> Column:
    """Positional kanji (or ASCII) digits as an integer."""
    return F.translate(s, KANJI, "0123456789").try_cast("int")


def citation_date(s: Column) -> Column:
    """Date of "year・month・day" in kanji digits or "yy.m.d"; years of two digits are 19xx."""
    parts = F.split(F.translate(s, KANJI + "・", "0123456789."), r"\.")
    year = F.get(parts, F.lit(0)).try_cast("int")
    year = F.when(year < 100, year + 1900).otherwise(year)
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(F.get(parts, F.lit(1)), 2, "0"), F.lpad(F.get(parts, F.lit(2)), 2, "0"))
    return F.when(F.size(parts) == 3, F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).cast("date")


# --- words and search terms -----------------------------------------------------------------------


def words(content: Column) -> Column:
    """Array of words by position: split at U+200B where the content has it, else at white space."""
    return F.when(F.contains(content, F.lit(ZWSP)), F.split(content, ZWSP)).otherwise(F.split(content, rf"{BLANK}+"))


def clean_content(content: Column) -> Column:
    return F.replace(content, F.lit(ZWSP), F.lit(""))


def escape_content(content: Column) -> Column:
    return F.replace(F.replace(content, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def normalize_term(term: Column) -> Column:
    """Lower case, trimmed, without punctuation, runs of two or more spaces as one."""
    bare = F.regexp_replace(trim_ws(F.lower(term)), TERM_PUNCTUATION, "")
    return trim_ws(F.regexp_replace(bare, rf"{BLANK}{{2,}}", " "))


def index_words(content: Column) -> Column:
    """words(content), each under normalize_term; without regular expressions where words can't hold white space."""
    spaced = F.transform(F.split(content, ZWSP), normalize_term)
    plain = F.transform(F.split(F.lower(content), rf"{BLANK}+"), lambda w: F.translate(w, PUNCTUATION, ""))
    return F.when(F.contains(content, F.lit(ZWSP)), spaced).otherwise(plain)


#: Letters of scripts that are written without spaces between words, and of Korean.
CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\x{30FC}"


#: A text of common letters of those alone, which are one code point and have no case, with spaces and line feeds.
LETTERS = r"\A[\x{4E00}-\x{9FA5}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{30FC}\x{AC00}-\x{D7A3} \n]*\z"


def segmented(content: Column) -> Column:
    """content with U+200B between its units: every CJK letter, and every other run between white space and those.

    The result is text whose words are given, as the rest of the library reads it: a unit's place is its location. U+200B that
    was there is dropped, as it is put by a segmenter that queries don't know.
    """
    space, content = WS[1:-1], clean_content(content)
    for before, after in ((f"[{CJK}]", f"[^{space}]"), (f"[^{space}{CJK}{ZWSP}]", f"[{CJK}]"), (f"[{space}]+", f"[^{space}]")):  # groups, as a lookbehind misses letters beyond 16 bits
        content = F.regexp_replace(content, f"({before})(?={after})", f"$1{ZWSP}")
    return content


def unit_grams(content: Column) -> Column:
    """Array of struct(unit, gram) by location: the normalised unit, and with the next one where both are letters of one CJK run (else null)."""
    raw = F.split(segmented(content), ZWSP)
    one, begins = rf"^[{CJK}]$", rf"^[{CJK}]"
    following = F.concat(F.slice(raw, 2, F.greatest(F.size(raw) - 1, F.lit(0))), F.array(F.lit("")))
    return F.transform(F.arrays_zip(raw.alias("u"), following.alias("v")), lambda x: F.struct(normalize_term(x["u"]).alias("unit"), F.when(x["u"].rlike(one) & x["v"].rlike(begins), F.concat(F.lower(x["u"]), F.lower(F.substring(x["v"], 1, 1)))).alias("gram")))


def gram_terms(term: Column) -> Column:
    """Array of struct(offset, term) that together say a normalised term: the pairs of its CJK runs (a letter alone where the run is one), and its other units."""
    grams = unit_grams(term)
    before = F.concat(F.array(F.lit(None).cast("string")), F.transform(grams, lambda g: g["gram"]))
    rows = F.transform(grams, lambda g, i: F.struct(i.alias("offset"), F.when(g["gram"].isNotNull(), g["gram"]).when(F.get(before, i).isNull(), g["unit"]).alias("term")))
    return F.filter(rows, lambda r: F.coalesce(r["term"], F.lit("")) != "")


def is_exact(term: Column) -> Column:
    """Whether the term as typed is quoted."""
    return term.rlike(rf'(?s)^{WS}*".+"{WS}*$')


def facet_selection(selected: Column) -> Column:
    """["key:value", ...] as a map key -> [values], keys in order of appearance."""
    pairs = F.transform(F.filter(selected, lambda x: F.contains(x, F.lit(":"))), lambda x: F.split(x, ":", 2))
    keys = F.array_distinct(F.transform(pairs, lambda p: p[0]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.transform(F.filter(pairs, lambda p: p[0] == k), lambda p: p[1]).alias("value"))))


def facet_flatten(filters: Column) -> Column:
    """map key -> [values] as ["key:value", ...]."""
    return F.flatten(F.transform(F.map_entries(filters), lambda e: F.transform(e["value"], lambda v: F.concat(e["key"], F.lit(":"), v))))


def heading_anchors(anchors: Column) -> Column:
    """Anchors of headings with a text: element h1 to h9, text not blank."""
    return F.filter(anchors, lambda a: a["element"].rlike(r"(?i)h\d") & a["text"].rlike(rf"(?!{WS})."))


def ordered_keywords(keywords: Column, split_words: bool = False) -> Column:
    """Distinct keywords without blanks, longest first, else in their order."""
    if split_words:
        keywords = F.flatten(F.transform(keywords, lambda k: F.split(k, " ")))
    kept = F.array_distinct(F.filter(keywords, lambda k: trim_ws(k) != ""))
    keyed = F.transform(kept, lambda k, i: F.struct((-F.length(k)).alias("n"), i.alias("i"), k.alias("k")))
    return F.transform(F.array_sort(keyed), lambda x: x["k"])


def head_bucket(term: Column, buckets: int) -> Column:
    """The bucket of the dictionary that a term, and every prefix of it, is stored in: by its first character."""
    return F.pmod(F.xxhash64(F.substring(term, 1, 1)), F.lit(buckets)).cast("int")


def term_bucket(term: Column, buckets: int) -> Column:
    """The bucket that a term's postings are stored in."""
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")
