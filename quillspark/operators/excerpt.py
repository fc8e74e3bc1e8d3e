"""What is shown of a hit: excerpts, results by heading, highlights."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import text as X


def densest_start(locations: Sequence[int], scores: Sequence[float], length: int) -> int:
    """Where the excerpt of ``length`` words begins: the middle of the first run of best windows.

    Scores of one location add up. The sum that step i compares covers words i + 1 to i + length, yet i is
    what it notes; the first window of all is noted as 0. Sums are carried along from step to step.
    """
    if locations is None or not len(locations):
        return 0
    n = int(max(locations)) + 1
    if n <= length:
        return 0
    words = np.zeros(n + length)
    np.add.at(words, np.asarray(locations, dtype=np.int64), np.asarray(scores, dtype=float))
    first = float(np.cumsum(words[:length])[-1]) if length else 0.0
    sums = np.cumsum(np.r_[first, words[length : length + n] - words[:n]])[1:]
    best = max(first, float(sums.max()))
    equal = sums == best
    begin, begun = (0, 1) if best == first else (int(equal.argmax()), int(equal.argmax()) + 1)
    run = equal[begun:]
    size = 1 + (int(run.argmin()) if not run.all() else len(run))
    return begin + size // 2


@F.pandas_udf(T.IntegerType())
def excerpt_start(locations: pd.Series, scores: pd.Series, length: pd.Series) -> pd.Series:
    return pd.Series([densest_start(a, b, int(n)) for a, b, n in zip(locations, scores, length)], dtype="int32")


def location_mass(hit_locations: DataFrame) -> DataFrame:
    """query_id, doc_id, location, mass: balanced scores of equal locations added up."""
    return hit_locations.groupBy("query_id", "doc_id", "location").agg(F.sum("balanced_score").alias("mass"))


def build_excerpt(words: Column, start: Column, length: Column, locations: Column, not_before: Column | None = None, not_from: Column | None = None, joiner: Column | str = " ") -> Column:
    """The words from start on, hits marked, inside [not_before, not_from). Locations beyond the words are dropped."""
    end = F.coalesce(not_from, F.size(words)) if not_from is not None else F.size(words)
    begin = F.coalesce(not_before, F.lit(0)) if not_before is not None else F.lit(0)
    size = F.greatest(F.least(length, end - begin), F.lit(0))
    at = F.greatest(F.when(start + size > end, end - size).otherwise(start), begin)
    shown = F.slice(words, at + 1, size)
    marked = F.transform(shown, lambda w, i: F.when(F.array_contains(locations, (i + at).cast("int")), F.concat(F.lit("<mark>"), w, F.lit("</mark>"))).otherwise(w))
    joiner = F.lit(joiner) if isinstance(joiner, str) else joiner
    return X.trim_ws(F.aggregate(marked, F.struct(F.lit("").alias("s"), F.lit(True).alias("first")), lambda a, w: F.struct(F.when(a["first"], w).otherwise(F.concat(a["s"], joiner, w)).alias("s"), F.lit(False).alias("first")), lambda a: a["s"]))


def joiner_of(content: Column) -> Column:
    return F.when(F.contains(content, F.lit(X.ZWSP)), "").otherwise(" ")


# --- results by heading ---------------------------------------------------------------------------


def section_ends(anchors: DataFrame, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """anchors (location, ordinal) with end: the next anchor's location, null for the last."""
    return anchors.withColumn("end", F.lead("location").over(Window.partitionBy(*key).orderBy("location", "ordinal")))


def assign_heading(word_locations: DataFrame, anchors: DataFrame) -> DataFrame:
    """word_locations (query_id, doc_id, location, balanced_score) with anchor: the last heading at or before it, null before the first.

    An anchor precedes a word of its own location; of anchors at one location the last counts. anchors: doc_id,
    ordinal, element, id, text, location, end.
    """
    a = F.struct("ordinal", "element", "id", "text", "location", "end")
    wanted = word_locations.select("query_id", "doc_id").distinct().join(anchors, "doc_id")
    marks = wanted.select("query_id", "doc_id", "location", F.lit(0).alias("kind"), "ordinal", F.lit(None).cast("double").alias("balanced_score"), a.alias("mark"))
    words = word_locations.select("query_id", "doc_id", "location", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("ordinal"), F.col("balanced_score").cast("double"))
    both = marks.unionByName(words, allowMissingColumns=True)
    order = Window.partitionBy("query_id", "doc_id").orderBy("location", "kind", "ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("anchor", F.last("mark", ignorenulls=True).over(order)).filter("kind = 1").select("query_id", "doc_id", "location", "balanced_score", "anchor")


def sub_results(word_locations: DataFrame, anchors: DataFrame, docs: DataFrame, length: int = 12) -> DataFrame:
    """query_id, doc_id, ordinal (null: the page's head), title, url, locations, excerpt: one row a section with hits.

    docs: doc_id, url, title, content. Excerpts stay inside their section, whose end is the next heading.
    """
    placed = assign_heading(word_locations, section_ends(anchors))
    firsts = anchors.groupBy("doc_id").agg(F.min("location").alias("first"))
    keyed = placed.join(firsts, "doc_id", "left")
    begin = F.coalesce(F.col("anchor.location"), F.lit(0))
    end = F.when(F.col("anchor").isNull(), F.col("first")).otherwise(F.col("anchor.end"))
    rows = keyed.select("query_id", "doc_id", "anchor", begin.alias("begin"), end.alias("end"), "location", "balanced_score")
    grouped = rows.groupBy("query_id", "doc_id", "anchor", "begin", "end").agg(F.array_sort(F.collect_list(F.struct("location", "balanced_score"))).alias("hits"))
    split = docs.select("doc_id", "url", "title", X.words(F.col("content")).alias("words"), joiner_of(F.col("content")).alias("joiner"))  # once a document
    full = grouped.join(split, "doc_id")
    size = F.least(F.coalesce(F.col("end"), F.size("words")) - F.col("begin"), F.lit(length))
    relative = F.transform("hits", lambda h: h["location"] - F.col("begin"))
    start = excerpt_start(relative, F.col("hits.balanced_score"), size) + F.col("begin")
    full = full.withColumn("size", size).withColumn("start", start)
    excerpt = build_excerpt(F.col("words"), F.col("start"), F.col("size"), F.col("hits.location"), F.col("begin"), F.col("end"), F.col("joiner"))
    url = F.when(F.col("anchor.id") != "", X.anchor_url(F.col("url"), F.col("anchor.id"))).otherwise(F.col("url"))
    return full.select("query_id", "doc_id", F.col("anchor.ordinal").alias("ordinal"), F.coalesce("anchor.text", "title").alias("title"), url.alias("url"), F.col("hits.location").alias("locations"), excerpt.alias("excerpt"))


def best_sub_results(subs: DataFrame, pages: DataFrame, k: int = 3) -> DataFrame:
    """The k sub-results with most locations, in the order of the document; if the first is the page itself, it is the head's and left out.

    Sub-results that share a chosen one's url stay too. pages: doc_id, url.
    """
    own = Window.partitionBy("query_id", "doc_id")
    rows = subs.withColumn("_n", F.row_number().over(own.orderBy(F.col("ordinal").asc_nulls_first()))).join(pages.select("doc_id", F.col("url").alias("_page")), "doc_id")
    rest = rows.filter(~((F.col("_n") == 1) & (F.col("url") == F.col("_page"))))
    chosen = rest.withColumn("_r", F.row_number().over(own.orderBy(F.size("locations").desc(), "_n")))
    kept = chosen.withColumn("_keep", F.max(F.col("_r") <= k).over(Window.partitionBy("query_id", "doc_id", "url")))
    return kept.filter("_keep").withColumn("position", F.row_number().over(own.orderBy("_n")) - 1).drop("_n", "_r", "_keep", "_page")


def clean_ranges(ranges: DataFrame) -> DataFrame:
    """doc_id, start, length: by start, ranges that aren't empty and end beyond the ends of all before."""
    end = F.col("start") + F.col("length")
    before = F.max(end).over(Window.partitionBy("doc_id").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1))
    return ranges.filter("length > 0").withColumn("_before", F.coalesce(before, F.lit(0))).filter(end > F.col("_before")).drop("_before")


# --- highlighting ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class MatchOptions:
    """How keywords match: see keyword_pattern."""

    accuracy: str = "partially"  # partially, complementary (whole runs of characters), exactly (between limiters)
    limiters: str = ""  # characters that end a word, besides white space
    case_sensitive: bool = False
    diacritics: bool = True
    synonyms: Mapping[str, str] = field(default_factory=dict)
    ignore_joiners: bool = False
    ignore_punctuation: str = ""
    wildcards: str = "disabled"  # enabled: ? one character, * any but blanks; withSpaces: blanks too
    separate_words: bool = False


#: Letters that match each other without regard to diacritics (fixed values).
DIACRITICS = ("aàáảãạăằắẳẵặâầấẩẫậäåāą", "cçćč", "dđď", "eèéẻẽẹêềếểễệëěēę", "iìíỉĩịîïī", "lł", "nñňń", "oòóỏõọôồốổỗộơởỡớờợöøō", "rř", "sšśșş", "tťțţ", "uùúủũụưừứửữựûüůū", "yýỳỷỹỵÿ", "zžżź")


def keyword_pattern(keyword: str, options: MatchOptions = MatchOptions()) -> str:  # noqa: B008
    """A keyword as a regular expression for rlike, regexp_count and regexp_replace, without a group."""
    hidden = "[\\u00ad\\u200b\\u200c\\u200d]" if options.ignore_joiners else ""
    between = f"[{re.escape(options.ignore_punctuation)}{hidden[1:-1]}]*" if options.ignore_punctuation or hidden else ""

    def letter(ch: str) -> str:
        if ch in "?*" and options.wildcards != "disabled":
            kind = r"[\s\S]" if options.wildcards == "withSpaces" else r"\S"
            return kind + ("?" if ch == "?" else "*?" if options.wildcards == "withSpaces" else "*")
        if ch.isspace():
            return rf"{X.WS}+"
        group = next((g for g in DIACRITICS if ch.lower() in g), None) if options.diacritics else None
        if group:
            both = group if options.case_sensitive and ch.islower() else group.upper() if options.case_sensitive else group + group.upper()
            return f"[{''.join(dict.fromkeys(both))}]"
        return re.sub(r"([^\w])", r"\\\1", ch)

    def plain(text: str) -> str:
        parts = [letter(c) for c in re.sub(r"\s+", " ", text)]
        return between.join(parts)

    meant: dict[str, list[str]] = {}  # each word that has synonyms, with them and itself
    fold = (lambda w: w) if options.case_sensitive else str.lower
    for pair in options.synonyms.items():
        for word in pair:
            meant.setdefault(fold(word), []).extend(pair)
    listed = "|".join(re.escape(w) for w in sorted(meant, key=lambda w: (-len(w), w)) if w)
    parts = re.split(f"({listed})", keyword, flags=0 if options.case_sensitive else re.IGNORECASE) if listed else [keyword]
    either = lambda word: "(?:" + "|".join(dict.fromkeys(map(plain, meant[fold(word)]))) + ")"
    pattern = between.join(either(x) if i % 2 else plain(x) for i, x in enumerate(parts) if x)
    ends = rf"{X.WS[:-1]}{re.escape(options.limiters)}]" if options.limiters else X.WS
    if options.accuracy == "complementary":
        inside = "[^" + ends[1:]
        pattern = f"{inside}*{pattern}{inside}*"
    elif options.accuracy == "exactly":
        pattern = f"(?<=^|{ends}){pattern}(?={ends}|$)"
    return ("" if options.case_sensitive else "(?iu)") + pattern


def _alternatives(keywords: Sequence[str], options: MatchOptions) -> str:
    listed = [w for k in keywords for w in (k.split() if options.separate_words else [k])]
    kept = sorted(dict.fromkeys(k.strip() for k in listed if k.strip()), key=len, reverse=True)
    bare = [keyword_pattern(k, options).removeprefix("(?iu)") for k in kept]
    return ("" if options.case_sensitive else "(?iu)") + "(" + "|".join(bare) + ")" if bare else ""


def highlight(text: Column, keywords: Sequence[str], options: MatchOptions = MatchOptions()) -> Column:  # noqa: B008
    """Every match of a keyword marked, longest keywords first, in one pass."""
    pattern = _alternatives(keywords, options)
    return F.regexp_replace(text, pattern, "<mark>$1</mark>") if pattern else text


def match_counts(docs: DataFrame, keywords: Sequence[str], options: MatchOptions = MatchOptions(), text: str = "text") -> DataFrame:  # noqa: B008
    """keyword, matches, documents over all docs; keywords without a match have zeros."""
    if not keywords:
        return docs.sparkSession.createDataFrame([], "keyword string, matches long, documents long")
    counts = F.array(*[F.struct(F.lit(k).alias("keyword"), F.coalesce(F.regexp_count(text, F.lit(keyword_pattern(k, options))), F.lit(0)).alias("n")) for k in dict.fromkeys(keywords)])
    rows = docs.select(F.explode(counts).alias("x"))
    return rows.groupBy("x.keyword").agg(F.sum("x.n").alias("matches"), F.sum((F.col("x.n") > 0).cast("long")).alias("documents"))


def highlight_ranges(text: Column, ranges: Column) -> Column:
    """text with ranges (ascending, apart; struct start, length) marked, cut at the end of the text; blank ones aren't."""
    size = F.length(text)
    piece = lambda a, b: F.substring(text, a + 1, F.greatest(b - a, F.lit(0)))

    def mark(state, r):
        end = F.least(r["start"] + r["length"], size)
        inside = piece(r["start"], end)
        shown = F.when(X.trim_ws(inside) != "", F.concat(F.lit("<mark>"), inside, F.lit("</mark>"))).otherwise(inside)
        return F.struct(F.concat(state["s"], piece(state["at"], r["start"]), shown).alias("s"), F.greatest(end, state["at"]).alias("at"))

    return F.aggregate(ranges, F.struct(F.lit("").alias("s"), F.lit(0).alias("at")), mark, lambda st: F.concat(st["s"], piece(st["at"], size)))


def remove_highlights(text: Column) -> Column:
    return F.regexp_replace(text, r"</?mark\b[^>]*>", "")
