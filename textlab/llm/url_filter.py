"""URL filter: path rules by host suffix, else a logistic regression on hashed character n-grams.

Host and path are cut out with built-in string functions. A rule (host + path
prefix) fits its host and all subdomains; the longest fitting rule decides, so
rules are looked up by equality on the url's own host suffixes and path prefixes.
What no rule fits is judged by MLlib's logistic regression on the hashed counts of
3- to 5-character n-grams of ``host/path``, trained from a small labelled table of
urls (``labelled_urls``, or a caller's own with columns url and bad). Only JVM
expressions run on the rows.

Defined results: a null url or one without ``://`` has an empty host and path, fits
no rule and has no n-grams, so the model's intercept judges it; an empty table
gives an empty result; repeated rows are judged each; rules of equal length go by
the longer host; further columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

# The rules of the registered query, as (verdict, rule).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

NGRAMS = (3, 4, 5)
BUCKETS = 1 << 18  # the table has some 30,000 different n-grams: few share a bucket
BAD_SHARE = 0.15   # of the urls to be judged; a name that says nothing is allowed
BLOCK_FROM = 0.5

# The labelled table: every word with every filler is the name of a labelled host;
# what says nothing of the class (prefixes, endings, paths, order) is dealt alike.
# The words come in families, so that a test can hold whole families out.
BAD_FAMILIES = {
    "gambling": "casino poker bets betting roulette jackpot slots blackjack baccarat bingo lottery lotto gamble gambling wager bookie sportsbook "
                "craps keno payout dealer spins".split(),
    "medicine": "pills viagra cialis levitra pharmacy pharma meds drugstore steroid steroids xanax valium tramadol ambien phentermine slimming "
                "weightloss dietpill keto enlargement erection prescription".split(),
    "adult": "adult xxx porn porno sexy sexcam nude nudes naked escort escorts hookup milf fetish webcam webcams erotic hentai camgirl strip "
             "onlyfans hardcore swinger".split(),
    "malware": "malware phishing trojan virus keylogger ransom botnet exploit spyware crack cracked keygen warez serials torrent torrents "
               "hacked hacks cheats unlocker bypass rootkit".split(),
    "money": "loans payday lender cashadvance credit debt refinance mortgage forex crypto bitcoin trading investment profits millionaire "
             "getrich income pyramid ponzi doubling earnings moneyfast".split(),
    "marketing": "spam ads track tracker tracking click clicks clickbait popup banner adserver affiliate promo promos traffic leads seo backlinks "
                 "bulkmail mailer autosurf doorway".split(),
    "fakes": "prize prizes winner giveaway gifts giftcard coupon coupons replica replicas counterfeit knockoff fakeid diploma rolex outlet "
             "wholesale discount discounts cheap freebies bonus".split(),
}
GOOD_FAMILIES = {
    "nature": "garden river mountain forest ocean island desert meadow valley lake shore stone winter summer autumn spring weather rain snow "
              "storm flower tree birds wolf horse rabbit insects coral earth north south wheat orchard".split(),
    "learning": "school library university college teacher student lesson history science physics chemistry biology geography mathematics "
                "grammar language dictionary encyclopedia archive museum research thesis lecture reading writing author letters essay journal".split(),
    "arts": "music theatre painting sculpture poetry novel cinema film photograph dance orchestra piano guitar violin concert festival gallery "
            "ceramics drawing design architecture folklore legend story stories chapter".split(),
    "life": "recipes kitchen bread cheese coffee tea vegetables soup dinner bakery family children parents wedding birthday house home furniture "
            "knitting sewing pottery camping hiking cycling swimming running football tennis chess sailing fishing".split(),
    "places": "city village harbour bridge street market station railway airport hotel castle church temple country nation travel journey "
              "guide map atlas europe africa america asia london paris berlin tokyo madrid".split(),
    "work": "company office business industry factory engineer doctor nurse hospital health clinic law court justice government parliament "
            "council election news newspaper magazine radio weather report agency institute foundation society association".split(),
    "technology": "python linux software hardware computer network database server program code developer internet browser telescope satellite "
                  "robot battery energy electric machine engine vehicle bicycle camera science".split(),
    "common": "other then there these those thing things hat white and red blue green black great small large little right left under over "
              "between another together through whether however thread sting first second third hundred thousand morning evening question answer "
              "reason number letter winter sister brother mother father nearer higher teacher leather ending handed standing".split(),
}
BAD_WORDS = tuple(w for words in BAD_FAMILIES.values() for w in words)
GOOD_WORDS = tuple(w for words in GOOD_FAMILIES.values() for w in words)
FILLERS = ("online", "best", "my", "24", "land", "world", "shop", "live", "the", "")
PREFIXES = ("", "www.", "blog.", "m.")
ENDINGS = (".example.com", ".example.org", ".example.net")
PATHS = ("/en/41646", "/de/3633.html", "/article/2020/spring", "/es/22254/", "/fr/11385?page=2", "/about", "/posts/how-to-plant-trees")


def labelled_urls(spark: SparkSession, good=GOOD_WORDS, bad=BAD_WORDS) -> DataFrame:
    """The built-in labelled table (or one of other words): url, bad (0 or 1)."""
    words = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(b).alias("bad")) for b, ws in ((0, good), (1, bad)) for w in ws])
    dealt = lambda options, turn: F.get(F.array(*map(F.lit, options)), turn % len(options))
    w, f = F.col("w"), F.col("f")
    name = F.when((w + f) % 2 == 0, F.concat_ws("-", F.nullif("filler", F.lit("")), "word")).otherwise(
        F.concat_ws("-", "word", F.nullif("filler", F.lit(""))))
    return (spark.range(1).select(F.posexplode(words).alias("w", "of")).select("w", "of.*", F.posexplode(F.array(*map(F.lit, FILLERS))).alias("f", "filler"))
            .select(F.concat(F.lit("https://"), dealt(PREFIXES, w + f), name, dealt(ENDINGS, w + 2 * f), dealt(PATHS, w + 3 * f)).alias("url"), "bad")
            .coalesce(1))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_host_and_path(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Columns host and path: after the first ``://`` up to / ? # or the end; then up to ? or #."""
    at = F.instr("_url", "://")
    rest = F.when(at > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    return (df.withColumn("_url", F.coalesce(F.col(url_col).cast("string"), F.lit(""))).withColumn("_rest", rest)
            .withColumn("_authority", F.regexp_extract("_rest", r"\A[^/?#]*", 0))
            .withColumn("host", lower_ascii(F.col("_authority")))
            .withColumn("path", F.regexp_extract(F.expr("substring(_rest, length(_authority) + 1)"), r"\A[^?#]*", 0))
            .drop("_url", "_rest", "_authority"))


def longest_rule(rules, host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null where none fits.

    One condition per rule, longest rule first: the rule list is a short parameter."""
    rule = verdict = None
    for word, text in sorted(rules, key=lambda r: (-len(r[1]), -len(r[1].partition("/")[0]), r[1])):
        rule_host, slash, rule_path = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rule_path)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, word) if verdict is None else verdict.when(fits, word)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def ngrams(text: Column, sizes=NGRAMS) -> Column:
    """All character n-grams of the given sizes, with repeats; empty for an empty text."""
    def of(n: int) -> Column:
        last = F.length(text) - (n - 1)
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))) \
            .otherwise(F.array().cast("array<string>"))
    return F.concat(*[of(n) for n in sizes])


def with_features(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    grams = df.withColumn("_grams", let(F.concat("host", "path"), lambda t: ngrams(t)))
    return HashingTF(numFeatures=buckets, inputCol="_grams", outputCol="_features").transform(grams).drop("_grams")


def train(labelled: DataFrame, buckets: int = BUCKETS, bad_share: float | None = BAD_SHARE) -> LogisticRegressionModel:
    """Fits on a small labelled table; the whole table is used. Good rows are weighted so that ``bad_share`` of the
    weight is bad, as in the urls to be judged (None: as the table has it)."""
    rows = with_features(with_host_and_path(labelled.select("url", F.col("bad").cast("double").alias("label"))), buckets)
    n = rows.agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("n")).first()
    good = 1.0 if bad_share is None or not n["bad"] or n["bad"] == n["n"] else (1 - bad_share) / bad_share * n["bad"] / (n["n"] - n["bad"])
    rows = rows.withColumn("_weight", F.when(F.col("label") == 1, 1.0).otherwise(good))
    return LogisticRegression(featuresCol="_features", labelCol="label", weightCol="_weight", regParam=0.0003, maxIter=100, standardization=False).fit(rows)


def url_verdicts(df: DataFrame, labelled: DataFrame | None = None, rules=RULES, id_col: str = "page_id", url_col: str = "url",
                 block_from: float = BLOCK_FROM) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, bad_score."""
    model = train(labelled if labelled is not None else labelled_urls(df.sparkSession))
    model.setFeaturesCol("_features").setProbabilityCol("_p").setRawPredictionCol("_raw").setPredictionCol("_class")
    rows = with_features(with_host_and_path(df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))))
    scored = model.transform(rows).withColumn("bad_score", F.round(vector_to_array("_p")[1], 6))
    rule, verdict = longest_rule(rules, F.col("host"), F.col("path"))
    judged = F.when(F.col("bad_score") >= block_from, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, judged).alias("verdict"), "bad_score")
