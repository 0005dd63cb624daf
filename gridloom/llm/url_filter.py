"""URL filters: allow and block rules first, then logistic regression on hashed character n-grams of host and path.

DataFrame functions only. A URL's features are the buckets of its n-grams (host and path apart), each once, scaled to unit
length. The regression is trained from a small labelled table in its dual form, with a weight for each labelled URL: gradient
steps over the matrix of common buckets run inside one expression. The weights then fold into one number per
bucket, which the scan of the pages reads from a constant array: no shuffle and no join over the pages.

Host: after the first :// up to /, ?, # or the end, A-Z lower-cased. Path: then up to ?, # or the end. Null URLs and those without
:// have both empty; no rule fits them (a rule has a host) and the method judges them by its constant alone. Repeated rows are
judged each for itself. Of several rules that fit the longest wins (by host and path together; ties: the first by code point).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import checkpointed

BUCKETS = 4096
#: The square of the constant feature. It is small, so that what labelled URLs of both kinds have in common isn't balanced by a large constant that other hosts would meet alone.
CONSTANT = 0.02
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The small labelled table.
BLOCKED = """
http://big-win-casino.example/slots/jackpot
https://casino-royal-bets.example/bonus/free-spins
http://free-poker-cash.example/poker/bonus
https://bet365win.example/betting/odds
http://sexy-cams-live.example/xxx/girls
https://adult-videos-xxx.example/porn/watch
http://hot-singles.example/dating/adult/chat
http://cheap-pills-online.example/viagra/order
https://pharmacy-no-rx.example/buy/pills
http://replica-watches-sale.example/buy/rolex-replica
https://free-warez-crack.example/keygen/download
http://torrents-cracked.example/download/crack.exe
http://malware-update.example/flash/setup.exe
https://your-account-verify.example/login/confirm-password
http://secure-bank-login.example/verify/account
https://paypa1-security.example/signin/verify
http://win-free-phone.example/prize/claim
https://crypto-double-profit.example/invest/double
http://get-rich-fast.example/money/profit
https://payday-loan-instant.example/loans/apply-now
http://click-tracker-ads.example/popunder/ads.js
https://adserver-banner.example/ads/banner
http://seo-backlinks-cheap.example/buy/backlinks
https://spam-links-farm.example/links/page-links
http://xxx-tube.example/porn/free
https://slots-bonus.example/casino/slots
http://betting-tips-win.example/bets/tips
https://escort-girls.example/adult/escort
http://download-crack-serial.example/serial/keygen
https://free-gift-card.example/claim/gift-card
http://hacked-accounts.example/dump/passwords
https://diet-pills-miracle.example/order/pills
http://casino-lucky.example.com/en/5121
https://www.poker-bets.example.net/fr/811.html
http://m.online-casino.example.org/de/77
https://sports-bets-free.example.com/es/1290
http://blog.pills-shop.example.net/en/4410?page=2
https://cheap-viagra.example.org/fr/29
http://www.adult-chat.example.com/de/6003
https://xxx-adult.example.net/es/310.html
http://tracker-ads.example.com/en/984
https://ads-popunder.example.org/de/15#top
http://spam-mail.example.net/fr/702
https://link-farm-spam.example.com/en/3317
http://win-prizes.example.org/es/9021
https://free-crack.example.net/de/458
http://fake-login.example.com/fr/60
https://malware-farm.example.org/en/233
""".split()

#: The small labelled table.
ALLOWED = """
https://www.example.org/en/article/1234
https://blog.example.com/en/posts/2020/spring-garden
http://news.example.net/de/politik/artikel-17
https://example.com/fr/actualites/culture
https://example.org/es/noticias/ciencia
http://docs.python.example/library/functions.html
https://wiki.example/wiki/History_of_science
https://university.example/physics/lecture-notes
https://library.example/catalogue/books/1881
https://museum.example/collection/painting/33
http://weather.example/forecast/city
https://recipes.example/bread/sourdough
https://travel.example/guides/mountains
https://health.example/topics/nutrition
https://gov.example/law/section/12
https://court.example/opinions/1999
https://journal.example/volume/7/issue/2
https://forum.example/topic/55/answer
https://code.example/project/readme
http://school.example/maths/algebra.html
https://m.example.org/fr/2411.html
http://m.example.com/en/3667
https://www.thenews.example/world/2021/story
https://the-times.example/opinion/columns
https://science.example/biology/cells
https://music.example/theory/chords
https://sports.example/football/results
https://blog.code.example/posts/9?page=2
http://archive.example/de/1201
https://gardening.example/plants/roses
https://history.example/europe/middle-ages
https://maps.example/places/bridge
http://morning.example.com/en/5140
https://www.letters.example.net/fr/818.html
http://m.harbour.example.org/de/79
https://windows-and-doors.example.com/es/1201
http://blog.orchard.example.net/en/4431?page=2
https://stationery.example.org/fr/31
http://www.theatre.example.com/de/6105
https://carpentry.example.net/es/318.html
http://tradition.example.com/en/990
https://fathers.example.org/de/19#top
http://nation.example.net/fr/713
https://m.thinking.example.com/en/3302
http://winter.example.org/es/9033
https://freedom.example.net/de/461
http://logic.example.com/fr/64
https://farmers.example.org/en/239
""".split()


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class UrlModel:
    weights: tuple[float, ...]
    bias: float


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _grams(text: Column, n: int, mark: str) -> Column:
    framed = F.concat(F.lit("^"), text, F.lit("$"))
    return F.when(
        F.length(text) >= n - 1,
        F.transform(F.sequence(F.lit(1), F.length(framed) - (n - 1)), lambda i: F.concat(F.lit(mark), F.substr(framed, i, F.lit(n)))),
    ).otherwise(F.array().cast("array<string>"))


def buckets(host: Column, path: Column) -> Column:
    """Distinct buckets of the n-grams: three and four characters of the host, three of the path."""
    grams = F.concat(_grams(host, 3, "h"), _grams(host, 4, "h"), _grams(path, 3, "p"))
    return F.array_distinct(F.transform(grams, lambda g: F.pmod(F.xxhash64(g), F.lit(BUCKETS)).cast("int")))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The built-in labelled table: url, label (1: block)."""
    return spark.createDataFrame([(u, 1) for u in BLOCKED] + [(u, 0) for u in ALLOWED], "url string, label int")


def fit(labelled: DataFrame, most: int = 256, steps: int = 300, rate: float = 2.0, ridge: float = 1e-3) -> UrlModel:
    """Fits on the labelled URLs (url, label), the `most` first by hash. Null URLs and labels are left out."""
    rows = (
        labelled.where(F.col("url").isNotNull() & F.col("label").isNotNull())
        .select("url", F.col("label").cast("double").alias("y"))
        .distinct()
        .orderBy(F.xxhash64("url"), "url", "y")
        .limit(most)
        .select("url", "y", buckets(host_of(F.col("url")), path_of(F.col("url"))).alias("b"))
    )
    whole = rows.groupBy().agg(F.sort_array(F.collect_list(F.struct("url", "y", "b"))).alias("r")).where(F.size("r") > 0)
    scaled = lambda a: F.sqrt(F.greatest(F.size(a["b"]), F.lit(1)).cast("double"))
    # written down, lest the matrix be computed anew in every step
    common = checkpointed(whole.select(
        "r",
        F.transform("r", lambda a: F.transform(F.col("r"), lambda c: F.size(F.array_intersect(a["b"], c["b"])) / (scaled(a) * scaled(c)) + CONSTANT)).alias("k"),
    ))
    step = f"""
        aggregate(sequence(1, {steps}), transform(r, x -> 0D), (a, t) -> transform(k, (row, i) ->
            a[i] - {rate}D / size(r) * (1D / (1D + exp(-aggregate(zip_with(row, a, (p, q) -> p * q), 0D, (s, v) -> s + v))) - r[i].y + {ridge}D * a[i])))
    """
    duals = common.select("r", F.expr(step).alias("a")).select(F.explode(F.arrays_zip("r", "a")).alias("z")).select("z.r.b", "z.a")
    by_bucket = duals.select(F.explode(F.concat("b", F.array(F.lit(-1)))).alias("bucket"), F.when(F.size("b") > 0, F.col("a") / F.sqrt(F.size("b").cast("double"))).otherwise(0.0).alias("v"), "a")
    found = {r["bucket"]: (r["w"], r["bias"]) for r in by_bucket.groupBy("bucket").agg(F.sum("v").alias("w"), (F.sum("a") * CONSTANT).alias("bias")).collect()}
    return UrlModel(tuple(found.get(k, (0.0,))[0] for k in range(BUCKETS)), found.get(-1, (0.0, 0.0))[1])


def probability(model: UrlModel, host: Column, path: Column) -> Column:
    """The probability of label 1."""
    weights = F.split(F.lit(",".join(map(repr, model.weights))), ",").cast("array<double>")
    own = buckets(host, path)
    total = F.aggregate(own, F.lit(0.0), lambda s, b: s + F.element_at(weights, b + 1))
    z = F.lit(model.bias) + total / F.sqrt(F.greatest(F.size(own), F.lit(1)).cast("double"))
    return 1.0 / (1.0 + F.exp(-z))


def judge(pages: DataFrame, rules: list[UrlRule], model: UrlModel, keep: list[str], url: str = "url", threshold: float = 0.5) -> DataFrame:
    """Appends host, path, rule, score and verdict. One row in, one row out, without a shuffle."""
    fits = lambda r: ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("score") > threshold, "block").otherwise("allow")
    for r in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        rule, verdict = F.when(fits(r), r.text).otherwise(rule), F.when(fits(r), r.verdict).otherwise(verdict)
    kept = [k for k in keep if k not in ("host", "path", "rule", "score", "verdict")]
    parsed = pages.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    scored = parsed.withColumn("score", probability(model, F.col("host"), F.col("path")))
    return scored.select(*kept, "host", "path", rule.alias("rule"), verdict.alias("verdict"), "score")
