"""URL filter: host and path rules, and for all other urls a logistic regression on hashed
character n-grams of host and path, trained from a small labelled URL table.

Everything runs on built-in functions and Spark's ML library in the JVM.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, and the
method's verdict on no features; repeated rows are judged alike; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import ascii_lower

#: Hash buckets of n-grams, their lengths, and the strength of the L2 penalty.
BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
PENALTY = 0.0003
#: What stands before an n-gram of the host, and of the path.
MARKS = {"host": "h:", "path": "p:"}

#: The rules of the registered query, (host and path, verdict).
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)

#: The small labelled table is made by rule from these lists.  Words of hosts to be blocked, and what is
#: put before and behind words of both kinds.
BLOCKED = (
    "casino slots poker jackpot roulette betting bet lottery pills viagra cialis meds replica porn xxx sexcam adult-cams hot-singles escorts payday-loans "
    "quick-loans cracked-software warez keygen adserver adclick doubleclick ads banner-ads popunder click-tracker pixel-tracker spam-mail link-farm "
    "content-farm free-spins win-money big-prizes adult spam bets sports-betting"
).split()
BEFORE = ("", "online-", "cheap-", "best", "my-", "lucky")
BEHIND = ("", "-shop", "-club", "365", "-win", "24", "-hub", "online")
#: Words of ordinary hosts, also such as hold letters of blocked ones.
ALLOWED = (
    "wikipedia university library museum weather gardening theatre history science newspaper cooking orchestra railway hospital mountain "
    "translation education national-archive tables stationery harbour cathedral council radio linguistics geography farmhouse adventure essex "
    "sussex alphabet betterhomes tibet address adverse loading upload window winter spinach spring shopfitters workshop clubhouse freedom "
    "crackers bannerman poetry documents analytics classics assessments canal slotcars clickers track-and-field pillow-makers medicine "
    "pharmacology statistics tracker-dogs letters chess football recipes travel photos developers kernel support journal physics biology"
).split()
#: Syllables of made-up names, which are ordinary hosts, too.
SYLLABLES = "ba lo ri ken dor mis tal ven osh ut gra pel in sta mor ek the an ter on wol fin".split()
FRONTS = ("", "www.", "m.", "blog.", "news.", "shop.", "app.")
ENDINGS = (".com", ".org", ".net", ".de", ".co.uk", ".info", ".fr", ".io", ".biz", ".es", ".edu", ".eu", ".shop", ".xyz", ".gov", ".nl")
#: Paths that are to be blocked on any host, and ordinary ones.
BLOCKED_PATHS = (
    "/casino/bonus /free-spins/win-money /buy-pills /buy/viagra-online /order-cheap-meds /xxx/videos /porn/hd /hot-singles/near-you /payday-loans/apply "
    "/warez/crack/keygen /replica-watches /slots/jackpot /poker/bet-now /ads/click /adserver/banner.js /track/pixel.gif /popunder/show /link-farm/spam "
    "/win/claim-your-prize /lottery-winner /adult-cams/live /cialis-discount"
).split()
ALLOWED_PATHS = (
    "/ /index.html /about /contact /news/weather-report /2021/05/12/council-meeting /wiki/Railway_station /articles/history-of-music /blog/recipes "
    "/docs/guide/install /products/garden-tools /search/results /images/photo.jpg /events/calendar /library/books/123 /sports/results /en/ "
    "/fr/accueil /de/seite/7 /es/noticias /space/park /spare-parts /winter/windows /address-book /buyers/guide /adverse/events /slot/12 /tracks/4 /a/b/c.html /p/48151 /users/login /papers/17.pdf /timetable"
).split()


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The default labelled table (url, label; 1: block), about three thousand rows: blocked hosts with any path,
    blocked paths on ordinary hosts, and ordinary paths on ordinary hosts, so that hosts and paths both
    tell something.  Endings and subdomains go round alike under both labels."""
    names = [a + b for i, a in enumerate(SYLLABLES) for b in SYLLABLES[i % 3 :: 2]]
    names += [a + SYLLABLES[(i * 7 + 3) % len(SYLLABLES)] for i, a in enumerate(names)]
    ordinary = [*ALLOWED, *names]

    def decorated(words: Sequence[str]) -> list[str]:
        return [x + w + y for i, w in enumerate(words) for j, x in enumerate(BEFORE) for y in (BEHIND[(i + j) % len(BEHIND)], BEHIND[(i + 3 * j + 1) % len(BEHIND)])]

    rows: dict[str, float] = {}

    def add(hosts: Sequence[str], paths: Sequence[str], times: int, label: float) -> None:
        for i, h in enumerate(hosts):
            for t in range(times):
                k = i * times + t
                rows[f"https://{FRONTS[k % len(FRONTS)]}{h}{ENDINGS[(k * 5 + i) % len(ENDINGS)]}{paths[(k * 3 + i) % len(paths)]}"] = label

    add(decorated(BLOCKED), ALLOWED_PATHS, 1, 1.0)
    add(BLOCKED, BLOCKED_PATHS, 3, 1.0)
    add(ordinary, BLOCKED_PATHS, 1, 1.0)
    add(ALLOWED, ALLOWED_PATHS, 4, 0.0)
    add(decorated(ALLOWED), ALLOWED_PATHS, 1, 0.0)
    add(names, ALLOWED_PATHS, 2, 0.0)
    return spark.createDataFrame(list(rows.items()), "url string, label double")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://`` up to ``/``, ``?``, ``#`` or the end; path up to ``?``, ``#`` or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    return ascii_lower(host), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls.

    A rule is ``host`` followed by a path that begins with ``/``; it fits its host and all
    subdomains if the url's path starts with the rule's.  The rules are a short list given by the
    caller, so they become one conditional expression, longest first.
    """
    name = verdict = F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):
        at = rule.index("/") if "/" in rule else len(rule)
        h, p = ascii_lower(F.lit(rule[:at])), rule[at:]
        fits = ((host == h) | F.endswith(host, F.concat(F.lit("."), h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def features(urls: DataFrame) -> DataFrame:
    """The urls with ``host``, ``path`` and ``features``: hashed n-grams of the characters of the framed
    host and path, those of either with its mark in front (an empty part has none)."""
    host, path = host_path(F.col("url"))
    out = urls.withColumns({"host": host, "path": path})
    for part in ("host", "path"):
        framed = F.split(F.concat(F.lit("^"), F.col(part), F.lit("$")), "")
        out = out.withColumn(f"{part}_chars", F.when(F.length(part) > 0, framed).otherwise(F.array().cast("array<string>")))
        for n in GRAMS:
            out = NGram(n=n, inputCol=f"{part}_chars", outputCol=f"{part}_{n}").transform(out)
    def marked(part: str, n: int) -> Column:
        return F.transform(f"{part}_{n}", lambda g: F.concat(F.lit(MARKS[part]), g))

    every = F.concat(*[marked(part, n) for part in MARKS for n in GRAMS])
    return hashing().transform(out.withColumn("grams", every))


def hashing() -> HashingTF:
    return HashingTF(numFeatures=BUCKETS, inputCol="grams", outputCol="features", binary=True)


def fit(labelled: DataFrame) -> LogisticRegressionModel:
    """The model of a labelled table (url, label); the table is small by contract and is read as one partition."""
    return LogisticRegression(regParam=PENALTY, maxIter=200, standardization=False).fit(features(labelled).select("features", "label").coalesce(1).sortWithinPartitions("label"))


def judge(pages: DataFrame, model: LogisticRegressionModel, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, p_block) of a table with page_id and url."""
    scored = model.setPredictionCol("").setRawPredictionCol("").setProbabilityCol("probability").transform(features(pages))
    p = vector_to_array("probability")[1]
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, F.when(p >= 0.5, "block").otherwise("allow")).alias("verdict"), p.alias("p_block"))
