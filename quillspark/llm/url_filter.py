"""URL filters: rules by host and path, and logistic regression on hashed character n-grams where no rule fits.

Functions only: no Python runs on the executors. An address is cut into host and path by expressions; its features are
the distinct n-grams of both, with marks at their ends, hashed to 2^bits coordinates. The classifier learns from a
small labelled table by full-batch gradient steps with a rate of its own for each coordinate: a step is one
grouped sum over the table's features, and the driver holds the weights (2^bits numbers at most). Scoring reads the
weights as a constant array in the row, so a table of any size is judged in one pass without a shuffle.

Rules are a short list (at most ``MOST_RULES``, else an error), each tried on every address: a rule (host, path) fits the
host and all its subdomains where the path starts with the rule's. The longest host and path together win; of equally
long ones the longer host, then the first by code point, then ``allow``.

Defined cases: an address that is null or has no ``://`` has empty host and path, and no features: its verdict is by the bias;
very long addresses count as a whole, in time that grows with their length; rows that repeat an id or address are judged
each for itself; null labels and repeated rows of the labelled table are left out, and where an address has both labels it
counts for both; without labelled addresses every score is 0.5, so every verdict is ``allow``; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import durable, table

BITS, GRAMS, STEPS, RATE, L2, MOST_RULES = 14, (3, 4, 5), 12, 0.5, 0.01, 1000
#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Addresses that an editor marked: what is to be blocked, and what is to be allowed.
BLOCKED = """
http://casino-royale.example/bonus/free-spins http://www.best-casino.example/slots/play-now http://poker-online.example/win/jackpot http://bet365win.example/sports-betting/odds
http://lucky-slots.example/casino/bonus http://cheap-pills.example/buy/viagra-online http://pharmacy-discount.example/pills/order-now http://rx-meds.example/cheap/no-prescription
http://adult-dating.example/xxx/cams http://hot-singles.example/adult/chat-now http://xxx-videos.example/free-porn/watch http://live-cams.example/porn/18plus
http://free-download-crack.example/keygen/full-version http://warez-zone.example/crack/serial http://torrent-hub.example/download/cracked-software http://keygen4all.example/serial/crack.exe
http://click-ads.example/tracker/pixel.gif http://ads.banner-net.example/adserver/click?id=1 http://track.ad-clicks.example/redirect/offer http://popunder-ads.example/banner/popup.js
http://get-rich-quick.example/make-money-fast http://crypto-doubler.example/invest/free-bitcoin http://work-from-home.example/earn/money-now http://payday-loans.example/cheap-credit/apply-now
http://replica-watches.example/cheap/rolex-sale http://cheap-handbags.example/replica/outlet-sale http://seo-links.example/buy-backlinks/cheap http://buy-followers.example/cheap/likes-now
https://www.casino-club.example.com/en/51876 http://m.cheap-pharma.example.org/de/20441.html https://blog.free-poker.example.net/fr/91730/ http://spam-links.example.com/es/3320
https://adult-videos.example.org/en/70021 http://www.ads-server.example.net/en/18833 https://bets-online.example.com/de/6617/ http://link-farm.example.org/fr/44908.html
https://www.win-casino.example.org/en/8214 http://adult-chat.example.com/es/60417.html https://m.casino-bonus.example.com/en/3925/ http://ads-click.example.org/fr/71160
https://blog.adult-cams.example.net/de/15208 http://www.spam-mail.example.com/en/40092 https://tracker-ads.example.net/es/2871.html http://sex-shop.example.org/en/97713/
https://win-money.example.com/de/33150 http://blog.content-farm.example.org/en/6028 https://www.sports-bets.example.net/fr/18846.html http://cheap-meds.example.com/es/75930
http://login-verify-account.example/secure/update-password http://free-gift-card.example/claim/prize-winner http://you-won.example/claim/free-iphone http://spam-offers.example/win/free-prize
""".split()
ALLOWED = """
http://www.university.example/research/papers/2019.html http://library.example/catalogue/books/history http://docs.project.example/guide/introduction http://wiki.community.example/articles/geography
http://news.daily.example/world/2021/03/report.html http://blog.gardener.example/posts/growing-tomatoes http://museum.example/exhibitions/ancient-egypt http://city-council.example/services/waste-collection
http://school.example/courses/mathematics/algebra http://journal.example/articles/volume-12/biology http://health.example/advice/sleep-and-exercise http://recipes.example/kitchen/vegetable-soup
http://forum.cyclists.example/topics/route-planning http://weather.example/forecast/tomorrow http://maps.example/regions/alps/walks http://radio.example/programmes/classical-music
http://archive.example/documents/letters/1848 http://encyclopedia.example/wiki/photosynthesis http://software.example/manual/installation http://observatory.example/publications/star-catalogue
http://parliament.example/debates/transcripts/2020 http://court.example/judgments/2018/case-41 http://statistics.example/tables/population http://dictionary.example/words/etymology
http://theatre.example/season/programme http://orchestra.example/concerts/spring http://farm.example/about/our-animals http://bakery.example/products/bread
http://science.example/physics/lecture-notes http://philosophy.example/essays/ethics http://language.example/grammar/verbs http://travel.example/guides/railways
https://www.lindholm.example.com/en/48213 https://blog.marten.example.org/fr/7702.html http://m.sorrel.example.net/de/90155/ https://tanning.example.com/es/31876
https://news.herrington.example.org/en/5521 http://station.example.net/en/160034.html https://www.rother.example.com/de/8841/ http://blog.shand.example.org/es/20913
https://m.weston.example.com/fr/77120 http://thornton.example.org/de/4410.html https://notion.example.net/fr/115902/ https://www.ableton.example.com/en/66230
http://blog.whitley.example.com/es/9307 https://m.orchard.example.org/en/28164/ http://redstone.example.net/es/50777.html https://www.anderson.example.org/de/13298
http://www.hartley.example.com/en/2041 https://thistle.example.net/en/88310/ http://m.norland.example.org/en/19477.html https://blog.sterne.example.com/de/5590 http://ronten.example.net/es/61288/
https://intendale.example.org/fr/40763.html http://hather.example.com/en/9915 https://www.ourense.example.net/fr/27301 http://blog.edison.example.org/en/84422/ https://erinton.example.com/fr/3096.html
http://www.thatcher.example.net/de/71540 https://m.lyndon.example.com/es/16639/ http://reanes.example.org/en/50218.html https://onslow.example.net/en/38874 http://blog.whitton.example.com/en/62005/
""".split()


def host(url: Column) -> Column:
    """What is between the first :// and the next /, ? or #, A-Z lower-cased; empty without."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    """What follows the host up to ? or #; empty without."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def features(host: Column, path: Column, bits: int = BITS) -> Column:
    """The distinct coordinates of the n-grams of host and path, numbers as 0; none where both are empty."""
    plain = lambda c: F.regexp_replace(c, "[0-9]+", "0")  # noqa: E731  numbers name pages, not kinds of them
    marked = [("h", F.concat(F.lit("^"), plain(host), F.lit("$"))), ("p", F.concat(plain(path), F.lit("$")))]
    coordinate = lambda kind: lambda gram: F.pmod(F.xxhash64(F.lit(kind), gram), F.lit(1 << bits)).cast("int")
    grams = [F.transform(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)), coordinate(kind)) for kind, text in marked for n in GRAMS]
    return F.when((host != "") | (path != ""), F.array_distinct(F.flatten(F.array(*grams)))).otherwise(F.array().cast("array<int>"))


def margin(at: Column, weights: Column, bias: Column | float) -> Column:
    """The bias and the weights at the coordinates, over the root of their number."""
    total = F.aggregate(at, F.lit(0.0), lambda a, i: a + F.get(weights, i))
    return total / F.sqrt(F.greatest(F.size(at), F.lit(1))) + bias


def labelled_urls(spark: SparkSession) -> DataFrame:
    """url, label: the editor's table; 1 is to be blocked."""
    return spark.createDataFrame([(u, 1) for u in BLOCKED] + [(u, 0) for u in ALLOWED], "url string, label int")


def constant(weights: Sequence[float]) -> Column:
    """The weights as one constant array (it is folded before the query runs)."""
    return F.split(F.lit(",".join(f"{w:.6g}" for w in weights)), ",").cast("array<double>")


def fit(labelled: DataFrame, *, bits: int = BITS, steps: int = STEPS, rate: float = RATE, l2: float = L2) -> tuple[list[float], float]:
    """(weights, bias) of labelled addresses (url, label 0 or 1)."""
    known = labelled.select("url", F.col("label").cast("int").alias("label")).filter("url is not null and label in (0, 1)").distinct()
    rows = durable(known.select("label", features(host(F.col("url")), path(F.col("url")), bits).alias("at")).coalesce(1))  # a small table: one task a step
    n = max(1, rows.count())
    weights, squares, bias, bias_square = [0.0] * (1 << bits), [0.0] * (1 << bits), 0.0, 0.0
    for _ in range(steps):
        off = F.lit(1.0) / (1 + F.exp(-margin(F.col("at"), constant(weights), bias))) - F.col("label")
        share = rows.select(off.alias("off"), F.explode(F.concat(F.array(F.lit(-1)), "at")).alias("i"), F.sqrt(F.greatest(F.size("at"), F.lit(1))).alias("root"))
        part = F.round(F.col("off") * (1 << 40) / F.when(F.col("i") < 0, 1.0).otherwise(F.col("root"))).cast("long")  # whole numbers: sums don't depend on their order
        for r in share.groupBy("i").agg(F.sum(part).alias("g")).collect():  # at most 2^bits + 1 rows
            g = r.g / (1 << 40) / n
            if r.i < 0:
                bias_square += g * g
                bias -= rate * g / math.sqrt(bias_square + 1e-12)
            else:
                g += l2 * weights[r.i] / n
                squares[r.i] += g * g
                weights[r.i] -= rate * g / math.sqrt(squares[r.i] + 1e-12)
    return [float(f"{w:.6g}") for w in weights], round(bias, 6)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(.., verdict, rule) of the winning rule; null without."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    if not rules:
        return F.lit(None).cast("struct<verdict:string,rule:string>")
    ordered = sorted(set(rules), key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r[1] + r[2], r[0] == "allow"), reverse=True)
    fits = lambda h, p: (F.lit(True) if not h else (host == h) | host.endswith(f".{h}")) & path.startswith(p)
    found = [F.when(fits(h, p), F.struct(F.lit(v).alias("verdict"), F.lit(h + p).alias("rule"))) for v, h, p in ordered]
    return F.coalesce(*found)


def judge(pages: DataFrame, labelled: DataFrame, *, rules: Sequence[tuple[str, str, str]] = RULES, page_id: str = "page_id", url: str = "url", threshold: float = 0.5, bits: int = BITS) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the classifier's, 0 to 1; above the threshold is blocked where no rule fits)."""
    weights, bias = fit(labelled, bits=bits)
    rows = pages.select(F.col(page_id).alias("page_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    score = 1 / (1 + F.exp(-margin(features(F.col("host"), F.col("path"), bits), constant(weights), bias)))
    judged = rows.select("*", fitting_rule(F.col("host"), F.col("path"), rules).alias("fit"), score.alias("score"))
    verdict = F.coalesce("fit.verdict", F.when(F.col("score") > threshold, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "score")


def op12_url_filter(spark, sf_dir) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), labelled_urls(spark))
