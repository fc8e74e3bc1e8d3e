"""Batch search: matching, scoring, facets, ordering, pages, merged indexes.

The matching rule is: every term of a query must be in the document; a quoted query must be in it as a phrase. The
score is BM25, whose parameters the ranking weights are.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators.index import Index
from quillspark.sources.stored import stored

#: Rows of a small side that are broadcast at most, and of values by key that meet in one row; both are counted.
MOST_ROWS = 100_000
#: Postings of a batch of queries that are read at once, as candidates of the rarest terms cost more than they save; this changes no hit.
FEW_POSTINGS = 1 << 22
#: Bits of a set of pairs that is broadcast at most: 32 MB.
MOST_BITS = 1 << 28
#: Names of facets, and values of them, that are written into the scan of a membership at most.
MOST_LISTED = 1000
#: Queries without term and selection that meet the documents at a time.
OPEN_AT_ONCE = 1000


def counted(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """df for the small side of a join: a broadcast if it has no more than ``most`` rows, which are counted."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


@dataclass(frozen=True)
class Ranking:
    """term_saturation: k1; page_length: b; term_frequency: share of the frequency factor; term_similarity: how much a term counts less that
    an asked prefix is only a part of. The share of its characters that were asked is taken to this power: 0 counts all alike, and a term that is asked whole has 1."""

    term_saturation: float = 1.2
    page_length: float = 0.75
    term_frequency: float = 1.0
    term_similarity: float = 1.0


def prepare_queries(queries: DataFrame, term: str = "term", cjk: bool = False) -> DataFrame:
    """queries with term_norm, exact and terms (the distinct words in order; with repeats where exact).

    With cjk, for an index built so, also placed: (part, offset, term). A word's pairs of CJK letters, and its other units, have to stand
    in the document one after the other; each word is a part of its own, an exact query is one part.
    """
    split = F.filter(F.split("term_norm", rf"{X.WS}+"), lambda w: w != "")
    rows = queries.withColumn("exact", F.coalesce(X.is_exact(F.col(term)), F.lit(False))).withColumn("term_norm", X.normalize_term(F.col(term)))
    rows = rows.withColumn("terms", F.when(F.col("exact"), split).otherwise(F.array_distinct(split)))
    if not cjk:
        return rows
    parts = F.when(F.col("exact"), F.array("term_norm")).otherwise(F.col("terms"))
    placed = lambda t, i: F.transform(X.gram_terms(t), lambda g: F.struct(i.alias("part"), g["offset"].alias("offset"), g["term"].alias("term")))
    return rows.withColumn("placed", F.flatten(F.transform(parts, placed)))


def drop_empty_queries(queries: DataFrame) -> DataFrame:
    """Prepared queries without those whose term is given, but empty once normalised; they have no results."""
    return queries.filter(F.col("term_norm").isNull() | (F.col("term_norm") != ""))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, n_terms, exact, ordinal, term (and lang, where queries have it; part and offset, where they are placed)."""
    if "placed" in queries.columns:
        names = ["query_id", *(["lang"] if "lang" in queries.columns else []), "exact", F.size("placed").alias("n_terms")]
        return queries.filter("term_norm <> ''").select(*names, F.posexplode("placed").alias("ordinal", "p")).select("*", "p.part", "p.offset", "p.term").drop("p")
    names = ["query_id", *(["lang"] if "lang" in queries.columns else []), "exact", F.size("terms").alias("n_terms")]
    return queries.filter("term_norm <> ''").select(*names, F.posexplode("terms").alias("ordinal", "term"))


def match_terms(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """query_id, doc_id, lang, ordinal, term, tf, locations, n_terms, exact (and length, weights, where postings have them): the postings of each query's terms.

    An equi-join on the term (and the language, where queries have one). The side of query terms is broadcast if it is
    small, which is counted, else skewed terms are split at run time.
    """
    terms = counted(query_terms(queries))
    shown = [c for c in ("length", "weights") if c in postings.columns] + [c for c in ("part", "offset") if c in terms.columns]
    return postings.join(terms, [c for c in ("lang", "term") if c in terms.columns]).select("query_id", "doc_id", "lang", "ordinal", "term", "tf", "locations", "n_terms", "exact", *shown)


def expand_prefixes(terms: DataFrame, index: Index, prefixes: str) -> DataFrame:
    """terms with the index's terms that begin with them, and similarity (the asked share of their characters). prefixes: ``last`` (each query's last
    term, as it is being typed) or ``all``; terms of exact queries stay as they are. Of a stored dictionary only the buckets of the prefixes are read, where
    a file is sorted by term."""
    if prefixes not in ("last", "all"):
        raise ValueError(f"prefixes are last or all: {prefixes!r}")
    open_ = ~F.col("exact") & (F.lit(True) if prefixes == "all" else F.col("ordinal") == F.col("n_terms") - 1)
    whole = terms.filter(~open_).withColumn("similarity", F.lit(1.0))
    dictionary = index.stats if index.dictionary is None else index.dictionary
    keys = [c for c in ("lang",) if c in terms.columns]
    asked = terms.filter(open_).withColumnRenamed("term", "asked")
    if index.dictionary is not None:
        keys, asked = [*keys, "head_bucket"], asked.withColumn("head_bucket", X.head_bucket(F.col("asked"), index.buckets))
    else:
        keys, asked, dictionary = [*keys, "head"], asked.withColumn("head", F.substring("asked", 1, 1)), dictionary.withColumn("head", F.substring("term", 1, 1))
    found = dictionary.select(*keys, "term").join(counted(asked), keys).filter(F.col("term").startswith(F.col("asked")))
    similar = (F.length("asked") / F.length("term")).alias("similarity")
    return whole.unionByName(found.select(*[F.col(c) for c in terms.columns], similar).distinct())


def match_index(queries: DataFrame, index: Index, prefixes: str | None = None, complete: bool = False) -> DataFrame:
    """The same over an index, with the terms' statistics (df, n_docs, mean_length), which meet the query terms first, as both are few.

    Of stored postings and statistics only the languages and buckets of the queries' terms are read, and postings don't move.
    With prefixes also the terms that expand_prefixes finds, with their similarity.

    complete: for what needs all terms of a query (score, match_phrase). Queries with a term that no document has give no rows. Of the others the
    postings of the rarest term are read first and kept as a table; of the other terms' postings only those in its documents are returned, or few more (see among).
    Where the statistics count no more than FEW_POSTINGS in all, all of them are returned.
    """
    terms = query_terms(queries)
    if prefixes:
        terms = expand_prefixes(terms, index, prefixes)
    if index.buckets:
        terms = terms.withColumn("term_bucket", X.term_bucket(F.col("term"), index.buckets))
    terms = counted(terms)
    keys = [c for c in ("lang", "term_bucket", "term") if c in terms.columns]
    wanted = index.stats.join(terms, keys)
    shown = [c for c in ("length", "weights") if c in index.postings.columns] + [c for c in ("part", "offset", "similarity") if c in terms.columns]

    def postings_of(wanted: DataFrame) -> DataFrame:
        found = index.postings.join(counted(wanted), [c for c in ("lang", "term_bucket", "term") if c in wanted.columns])
        return found.select("query_id", "doc_id", "lang", "ordinal", "term", "tf", "locations", "n_terms", "exact", "df", "n_docs", "mean_length", *shown)

    if not complete:
        return postings_of(wanted)
    wanted = stored(wanted)
    first = rarest_terms(wanted)
    held = wanted.join(counted(first.select("query_id")), "query_id", "left_semi")
    if (held.agg(F.sum("df")).first()[0] or 0) <= FEW_POSTINGS:
        return postings_of(held)
    rarest = stored(postings_of(wanted.join(counted(first), ["query_id", "ordinal"], "left_semi")))
    others = wanted.join(counted(first.filter("n_terms > 1").select("query_id", F.col("ordinal").alias("first"))), "query_id").filter("ordinal <> first").drop("first")
    return rarest.unionByName(among(postings_of(others), rarest.select("query_id", "doc_id").distinct()))


def rarest_terms(wanted: DataFrame) -> DataFrame:
    """query_id, ordinal, n_terms: the term of each query that the fewest documents have (over all languages, and all terms it stands for; ties to
    the first); queries with a term that none has are left out. wanted: query_id, ordinal, n_terms, df."""
    by_term = wanted.groupBy("query_id", "ordinal").agg(F.sum("df").alias("df"), F.max("n_terms").alias("n_terms"))
    by_query = by_term.groupBy("query_id").agg(F.min(F.struct("df", "ordinal"))["ordinal"].alias("ordinal"), F.max("n_terms").alias("n_terms"), F.count("*").alias("n"))
    return by_query.filter("n = n_terms").drop("n")


def among(rows: DataFrame, pairs: DataFrame, most_rows: int = MOST_ROWS, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows whose (query_id, doc_id) is among pairs, which are distinct, without moving rows.

    Up to most_rows pairs are broadcast themselves. Up to most_bits / 8 are broadcast as bits at their hashes, eight bits a pair: about one other row in
    eight then stays too, so what follows has to check. Beyond that all rows stay.
    """
    pairs = stored(pairs)
    n = pairs.count()
    if n <= most_rows:
        return rows.join(F.broadcast(pairs), ["query_id", "doc_id"], "left_semi")
    if n > most_bits // 8:
        return rows
    place = 1 + F.pmod(F.xxhash64("query_id", "doc_id"), F.lit(8 * n))
    bits = pairs.groupBy(F.bitmap_bucket_number(place).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits"))
    at = F.bitmap_bit_position(place).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(bits), "_bucket")
    return met.filter(F.getbit(byte, at % 8) == 1).select(*rows.columns)


def hit_locations(matches: DataFrame) -> DataFrame:
    """query_id, doc_id, location, weight, balanced_score of every place of a hit: what excerpts are chosen by.

    The balanced score is ours: the word's weight over the number of the term's places in the document, so that each term of a query counts alike.
    """
    weights = "weights" if "weights" in matches.columns else F.transform("locations", lambda _: F.lit(1.0)).alias("weights")
    rows = matches.select("query_id", "doc_id", "locations", weights).select("query_id", "doc_id", F.size("locations").alias("n"), F.explode(F.arrays_zip("locations", "weights")).alias("x"))
    return rows.select("query_id", "doc_id", F.col("x.locations").alias("location"), F.col("x.weights").alias("weight"), (F.col("x.weights") / F.col("n")).alias("balanced_score"))


def match_phrase(matches: DataFrame) -> DataFrame:
    """query_id, doc_id, n_phrases: documents that have an exact query's terms at consecutive locations."""
    at = F.col("offset" if "offset" in matches.columns else "ordinal")
    placed = matches.filter("exact").select("query_id", "doc_id", "ordinal", at.alias("at"), "n_terms", F.explode("locations").alias("location"))
    runs = placed.groupBy("query_id", "doc_id", (F.col("location") - F.col("at")).alias("start")).agg(F.size(F.collect_set("ordinal")).alias("n"), F.max("n_terms").alias("of"))
    return runs.filter("n = of").groupBy("query_id", "doc_id").agg(F.count("*").alias("n_phrases"))


def score(matches: DataFrame, stats: DataFrame | None = None, lengths: DataFrame | None = None, ranking: Ranking = Ranking()) -> DataFrame:  # noqa: B008
    """query_id, doc_id, score, of documents with all terms (and the phrase of an exact query), in one pass over the matches.

    stats: term_stats, and lengths: doc_id, length; each is needed only where the matches don't have it already. Matches without locations are of queries none of
    which is exact. Only exact queries' locations are gathered, those of one document.
    """
    k, b = ranking.term_saturation, ranking.page_length
    rows = matches if "df" in matches.columns else matches.join(stats, ["lang", "term"])
    if "length" not in matches.columns:
        rows = rows.join(lengths, "doc_id")
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (k + 1) / (F.col("tf") + k * (1 - b + b * F.col("length") / F.col("mean_length")))
    gain = (F.pow("similarity", F.lit(float(ranking.term_similarity))) if "similarity" in rows.columns else F.lit(1.0)) * idf * (ranking.term_frequency * tf + (1 - ranking.term_frequency))
    if "locations" not in rows.columns:  # no phrase is asked for: numbers alone are added up
        gained = rows.select("query_id", "doc_id", "ordinal", "n_terms", gain.alias("gain"))
        if "similarity" in rows.columns:
            gained = gained.groupBy("query_id", "doc_id", "ordinal").agg(F.max("gain").alias("gain"), F.max("n_terms").alias("n_terms"))
        summed = gained.groupBy("query_id", "doc_id").agg(F.sum("gain").alias("score"), F.count("*").alias("n") if "similarity" in rows.columns else F.count_distinct("ordinal").alias("n"), F.max("n_terms").alias("of"))
        return summed.filter("n = of").select("query_id", "doc_id", "score")
    placed = "part" in rows.columns
    starts = F.transform("locations", lambda x: x - F.col("offset")) if placed else F.when(F.col("exact"), F.transform("locations", lambda x: x - F.col("ordinal")))
    at = F.when(starts.isNotNull(), F.struct((F.col("part") if placed else F.lit(0)).alias("part"), starts.alias("starts")))
    gained = rows.select("query_id", "doc_id", "ordinal", "n_terms", gain.alias("gain"), at.alias("at"))
    total = F.sum("gain")
    if "similarity" in rows.columns:  # of the terms that one asked term stands for, a document's best counts
        gains = F.collect_list(F.struct("ordinal", "gain"))
        best = lambda g, o: F.array_max(F.transform(F.filter(g, lambda x: x["ordinal"] == o), lambda x: x["gain"]))
        total = F.transform(F.array(gains), lambda g: F.aggregate(F.array_distinct(F.transform(g, lambda x: x["ordinal"])), F.lit(0.0), lambda a, o: a + best(g, o)))[0]
    summed = gained.groupBy("query_id", "doc_id").agg(total.alias("score"), F.size(F.collect_set("ordinal")).alias("n"), F.max("n_terms").alias("of"), F.collect_list("at").alias("held"))  # one shuffle; what is gathered is one document's
    own = lambda part: F.transform(F.filter("held", lambda h: h["part"] == part), lambda h: h["starts"])
    common = lambda s: F.aggregate(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), F.get(s, F.lit(0)), F.array_intersect)  # noqa: E731  where the whole part starts
    stands = F.forall(F.array_distinct(F.transform("held", lambda h: h["part"])), lambda part: F.size(common(own(part))) > 0)
    return summed.filter((F.col("n") == F.col("of")) & stands).select("query_id", "doc_id", "score")


def selections(queries: DataFrame) -> DataFrame:
    """query_id, filter, value of the queries' facet selections (filters: map key -> [values])."""
    keyed = queries.select("query_id", F.explode("filters").alias("filter", "values"))
    return keyed.select("query_id", "filter", F.explode("values").alias("value")).distinct()


def selected_membership(membership: DataFrame, selection: DataFrame) -> DataFrame:
    """The rows of membership whose facet has a value that some query selects.

    Up to MOST_LISTED names and values, which are counted, are written into the scan: of a stored membership only the named facets' files and, as these
    are sorted, the row groups of the values are read. Whatever their number, the join with them decides.
    """
    for name in ("filter", "value"):
        listed = [r[0] for r in selection.select(name).distinct().limit(MOST_LISTED + 1).collect()]
        if len(listed) <= MOST_LISTED:
            membership = membership.filter(F.col(name).isin(listed))
    return membership.join(counted(selection.select("filter", "value").distinct()), ["filter", "value"], "left_semi")


def filter_hits(hits: DataFrame, membership: DataFrame, selection: DataFrame) -> DataFrame:
    """Hits whose document has, for each selected facet, one of its selected values. Hits of queries without a selection stay."""
    wanted = selection.groupBy("query_id").agg(F.count_distinct("filter").alias("wanted"))
    met = hits.select("query_id", "doc_id").distinct().join(selected_membership(membership, selection), "doc_id").join(selection, ["query_id", "filter", "value"], "left_semi")
    met = met.groupBy("query_id", "doc_id").agg(F.count_distinct("filter").alias("met"))
    joined = hits.join(wanted, "query_id", "left").join(met, ["query_id", "doc_id"], "left")
    return joined.filter(F.col("wanted").isNull() | (F.col("met") == F.col("wanted"))).select(*hits.columns)


def browse(queries: DataFrame, documents: DataFrame, membership: DataFrame) -> DataFrame:
    """query_id, doc_id, score 0 of the queries with a null term: all documents that pass their filters.

    The documents of a selection are found through membership, once for all queries that select the same, and then meet those queries, which are put into
    rows of a thousand: what is shuffled grows with the documents and the different selections, not with the queries. Only queries without a selection
    return all documents: these are put into rows of a thousand too, and each of those rows, which are as few, meets every document.
    """
    empty = queries.filter("term is null")
    asked = selections(empty).groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct("filter", "value"))).alias("picked"))
    n = asked.limit(MOST_ROWS + 1).count()
    ones = asked.groupBy("picked").agg(F.min("query_id").alias("one"))  # the first of the queries that select the same
    alike = asked.join(ones, "picked").groupBy("one", F.pmod(F.xxhash64("query_id"), F.lit(1 + n // OPEN_AT_ONCE)).alias("bundle")).agg(F.collect_list("query_id").alias("ids"))
    wanted = F.size(F.array_distinct(F.transform("picked", lambda s: s["filter"])))
    picked = ones.select("one", wanted.alias("wanted"), F.explode("picked").alias("s")).select("one", "wanted", "s.*")
    met = selected_membership(membership, picked).join(counted(picked), ["filter", "value"]).groupBy("one", "wanted", "doc_id").agg(F.count_distinct("filter").alias("met")).filter("met = wanted")
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of its own, as the few rows here become many
    met = met.repartition(parts, "doc_id").join(F.broadcast(alike) if n <= MOST_ROWS else alike, "one").select(F.explode("ids").alias("query_id"), "doc_id")
    open_ = empty.select("query_id").distinct().join(asked, "query_id", "left_anti")
    bundles = max(1, -(-open_.count() // OPEN_AT_ONCE))
    bundled = open_.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(bundles)).cast("int").alias("bundle")).agg(F.collect_list("query_id").alias("ids"))
    everything = documents.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))).alias("bundle")).join(counted(bundled, MOST_ROWS // OPEN_AT_ONCE), "bundle").select(F.explode("ids").alias("query_id"), "doc_id")
    return met.select("query_id", "doc_id", F.lit(0.0).alias("score")).unionByName(everything.select("query_id", "doc_id", F.lit(0.0).alias("score")))


def facet_counts(hits: DataFrame, membership: DataFrame, vocabulary: DataFrame, queries: DataFrame, filters: Sequence[str] | None = None) -> DataFrame:
    """query_id, filter, value, n: documents among the hits, for every known value, 0 included. vocabulary: filter, value. filters: the facets
    that are shown, without which all are; of a stored membership only theirs are read.

    The result has a row for each query and value; values are dealt to the queries in rows of about a thousand.
    """
    if filters is not None:
        membership, vocabulary = (x.filter(F.col("filter").isin(list(filters))) for x in (membership, vocabulary))
    counts = hits.select("query_id", "doc_id").distinct().join(membership, "doc_id").groupBy("query_id", "filter", "value").agg(F.count("*").alias("n"))
    bundles = max(1, -(-vocabulary.count() // OPEN_AT_ONCE))
    known = vocabulary.groupBy(F.pmod(F.xxhash64("filter", "value"), F.lit(bundles)).cast("int").alias("bundle")).agg(F.collect_set(F.struct("filter", "value")).alias("known"))
    asked = queries.select("query_id").distinct().select("query_id", F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))).alias("bundle")).join(counted(known, MOST_ROWS // OPEN_AT_ONCE), "bundle")
    frame = asked.select("query_id", F.explode("known").alias("k")).select("query_id", "k.filter", "k.value")
    return frame.join(counts, ["query_id", "filter", "value"], "left").select("query_id", "filter", "value", F.coalesce("n", F.lit(0)).alias("n"))


def all_facets(membership: DataFrame) -> DataFrame:
    """filter, value, n over all documents."""
    return membership.groupBy("filter", "value").agg(F.count_distinct("doc_id").alias("n"))


def visible_facets(facets: DataFrame, selected: DataFrame | None = None, show_empty: bool = False) -> DataFrame:
    """Facet values that are shown: with documents, selected, or all where empty ones are shown."""
    if show_empty:
        return facets
    shown = facets.filter("n > 0")
    if selected is None:
        return shown
    keys = [c for c in ("query_id", "filter", "value") if c in selected.columns]
    return shown.unionByName(facets.filter("n = 0").join(selected.select(*keys).distinct(), keys, "left_semi"))


def result_counts(hits: DataFrame, filtered: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, unfiltered, filtered: numbers of hits before and after the facet filter, 0 for queries without any."""
    rows = hits.select("query_id", F.lit(1).alias("a"), F.lit(0).alias("b")).union(filtered.select("query_id", F.lit(0), F.lit(1)))
    counts = rows.groupBy("query_id").agg(F.sum("a").alias("unfiltered"), F.sum("b").alias("filtered"))
    return queries.select("query_id").distinct().join(counts, "query_id", "left").select("query_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("unfiltered", "filtered")])


def _numbered(hits: DataFrame, order: list) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def rank(hits: DataFrame) -> DataFrame:
    """hits with rank (from 1) by descending score, ties by index_ordinal (if there is one) and doc_id."""
    return _numbered(hits, [F.col("score").desc(), *(["index_ordinal"] if "index_ordinal" in hits.columns else []), "doc_id"])


def sort_by_meta(hits: DataFrame, docs: DataFrame, sort: dict[str, str]) -> DataFrame:
    """hits with rank by the first key of sort, a meta entry of docs; its direction is asc or desc; another is warned about and taken as asc."""
    key, direction = next(iter(sort.items()))
    if direction not in ("asc", "desc"):
        warnings.warn(f"sort direction is neither asc nor desc, taken as asc: {direction!r}", stacklevel=2)
    value = F.col("sort_value").desc_nulls_last() if direction == "desc" else F.col("sort_value").asc_nulls_last()
    return _numbered(hits.join(docs.select("doc_id", F.col("meta")[key].alias("sort_value")), "doc_id"), [value, "doc_id"])


def page_of_results(hits: DataFrame, page_size: int = 5, pages: int = 1) -> DataFrame:
    """The first ``pages`` pages of ranked hits."""
    return hits.filter(F.col("rank") <= page_size * pages)


def attach_documents(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits of the shown pages with their documents' columns; hits should be cut to those pages before."""
    return docs.join(hits, "doc_id")


def order_facet_values(facets: DataFrame, ordering: Sequence[str] = (), collation: str | None = None) -> DataFrame:
    """facets with position: "All" (the total) first, then values in the given order, then the others by value.

    collation: a Spark collation by which values are ordered as a locale does (UNICODE, or a language's, as in de or sv); without it they
    are ordered by bytes. Values that a collation holds equal are ordered by bytes.
    """
    listed = F.array(*map(F.lit, ordering)) if ordering else F.array().cast("array<string>")
    keys = [c for c in ("query_id", "filter") if c in facets.columns]
    total = facets.groupBy(*keys).agg(F.sum("n").alias("n")).withColumn("value", F.lit("All")).withColumn("place", F.lit(-1))
    at = F.array_position(listed, F.col("value")).cast("int")
    rows = facets.select(*keys, "value", "n").withColumn("place", F.when(at == 0, 1 << 30).otherwise(at))
    both = rows.unionByName(total.select(*keys, "value", "n", "place"))
    return both.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("place", *([F.collate("value", collation)] if collation else []), "value")) - 1).drop("place")


def merge_indexes(indexes: Sequence[tuple[DataFrame, float]], paths: Sequence[str] | None = None) -> DataFrame:
    """Hits of several indexes as one, ranked anew: scores times the index's weight, with index_ordinal.

    paths: an index other than the first is left out if its path is a prefix of the first's.
    """
    kept = [(i, h, w) for i, (h, w) in enumerate(indexes) if i == 0 or not paths or not paths[0].startswith(paths[i])]
    rows = [h.select("query_id", "doc_id", (F.col("score") * w).alias("score")).withColumn("index_ordinal", F.lit(i)) for i, h, w in kept]
    return rank(reduce(DataFrame.unionByName, rows))


def merge_facets(*facets: DataFrame) -> DataFrame:
    """Facet counts of several indexes, added up."""
    both = reduce(DataFrame.unionByName, facets)
    return both.groupBy(*[c for c in both.columns if c != "n"]).agg(F.sum("n").alias("n"))


def choose_language(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """requests (lang) with chosen: the exact language, else its base subtag, else the registry's largest; error without any.

    registry: lang, page_count.
    """
    exact = registry.select(F.lower("lang").alias("x_lang"))
    base = registry.select(F.lower("lang").alias("b_lang"))
    exact, base = counted(exact), counted(base)
    largest = registry.agg(F.max(F.struct("page_count", F.col("lang").alias("lang")))["lang"].alias("largest")).withColumn("one", F.lit(1))  # one row
    asked = requests.withColumn("_l", F.lower(F.coalesce("lang", F.lit("")))).withColumn("_b", F.split_part("_l", F.lit("-"), F.lit(1)))
    found = asked.join(exact, F.col("_l") == F.col("x_lang"), "left").join(base, F.col("_b") == F.col("b_lang"), "left").withColumn("one", F.lit(1)).join(F.broadcast(largest), "one")
    return found.select(*requests.columns, F.coalesce("x_lang", "b_lang", "largest", F.raise_error(F.lit("the registry has no language"))).alias("chosen"))


def search(queries: DataFrame, index: Index, *, ranking: Ranking = Ranking(), prefixes: str | None = None) -> dict[str, DataFrame]:  # noqa: B008
    """hits (filtered, ranked), unfiltered and counts of a batch of queries (query_id, term, perhaps lang and filters). prefixes: see expand_prefixes.

    Hits, a row for each query and document found, are kept as a table, as filters, counts and order all read them.
    """
    ready = prepare_queries(queries, cjk=index.cjk)
    hits = score(match_index(drop_empty_queries(ready), index, prefixes, complete=True), ranking=ranking)
    if "filters" in queries.columns and index.membership is not None and index.documents is not None:
        hits = hits.unionByName(browse(queries, index.documents, index.membership))
    hits = filtered = stored(hits)
    if "filters" in queries.columns and index.membership is not None:
        filtered = filter_hits(hits, index.membership, selections(queries))
    return {"hits": rank(filtered), "unfiltered": hits, "counts": result_counts(hits, filtered, queries)}
