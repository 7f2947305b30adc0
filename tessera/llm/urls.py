"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path. Native: DataFrame operations only.

Training: the small labelled URL table (at most ``MAX_LABELLED`` rows, else an error) gives counts by hashed n-gram. Full-batch (accelerated) gradient descent
from zero keeps the weights in the span of the examples, so it runs on one number per example: margins are K·a with K the examples' products
(a join on the n-gram) less their means, and each step is a ← (1 - rate·decay)·u + rate·(label - sigmoid(K·u))/n, u being a carried on by the last step's change. The
weights are then Xᵀa, at most ``BUCKETS`` numbers: the one thing that goes to the driver, and it doesn't grow with the pages. They return as a constant in the scan's
expression; pages are not shuffled.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule, and is judged by the method, to which it has no n-grams: the intercept
alone, allow with the built-in table; a null page_id may occur; repeated rows are rows of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import let

BUCKETS, WIDTHS, STEPS, BIAS, DECAY, MAX_LABELLED = 4096, (3, 4, 5), 24, 0.05, 3e-4, 2000
#: host, path prefix, verdict
RULES: tuple[tuple[str, str, str], ...] = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)

#: Names of the built-in labelled table: words of the trades that such lists hold, in many spellings, and plain names that share their letters.
_BAD = (
    "royal-casino", "casino-bonus", "luckycasino", "casino777", "online-casino", "casinoclub", "grand-casino-online", "kasino-spins", "mega-slots",
    "slots-jackpot", "freeslots", "slotmachine-fun", "jackpot-wins", "bigwin-spins", "win-cash-now", "instant-win", "poker-room", "texas-poker",
    "pokerstarz", "roulette-live", "blackjack-vip", "bingo-cash", "betting-tips", "bet-now", "sportsbets", "best-bets-online", "livebets", "betking",
    "superbet", "bets-bonus", "bookmaker-odds", "freebet-offers", "free-spins", "free-gifts-today", "free-iphone-win", "freemoney",
    "free-crypto-coins", "freecoins", "free-followers", "adserver", "ads-network", "adsclick", "click-ads", "popup-ads", "bannerads", "ad-tracker",
    "trackpixel", "pixel-track", "track-clicks", "user-tracking-ads", "clicktracker", "trackers-hub", "banner-exchange", "adclicks-pay", "paidads",
    "spamhost", "mail-spam", "spam-links", "bulk-spam-mailer", "spammer-tools", "linkspam", "link-farm", "seo-linkfarm", "backlink-farm",
    "contentfarm", "article-farm-seo", "clickfarm", "buy-backlinks", "seo-spam-blast", "cheap-meds", "buy-pills-online", "pills-rx", "pillstore",
    "diet-pills", "pharma-discount", "cheap-viagra", "cialis-store", "rx-pharmacy-cheap", "cheapdrugs", "cheap-replica-watches", "cheap-rolex",
    "cheap-tramadol", "discount-meds", "weightloss-pills", "cheap-loans-now", "payday-loans", "quick-loan-cash", "debt-cash-fast", "adult-videos",
    "adultchat", "adult-dating", "hot-adults", "xxx-movies", "xxxtube", "sexcams", "sex-chat-live", "porn-hub-free", "pornvideos", "nude-pics",
    "escort-girls", "webcam-girls-xxx", "hookup-now", "milf-dating", "earn-money-fast", "get-rich-quick", "miracle-cure", "hot-deals-win", "winprize",
    "prize-winner", "lottery-claims", "cryptodoubler", "fake-id-shop", "hacked-accounts", "warez-download", "crackz-keygen", "torrent-cracks",
    "replica-bags", "phish-login-secure", "account-verify-login",
)
_GOOD = (
    "daily-herald", "morning-news", "cityjournal", "openlibrary-notes", "national-museum", "art-gallery", "gardening-club", "green-gardens",
    "travel-guide", "mountain-trails", "hiking-maps", "ocean-research", "marine-biology", "physics-notes", "mathworld", "algebra-lessons",
    "history-archive", "ancient-history", "world-atlas", "geography-now", "weather-report", "climate-data", "science-weekly", "space-agency",
    "astronomy-club", "music-school", "piano-lessons", "orchestra-hall", "jazz-records", "film-review", "theatre-tickets", "poetry-corner",
    "book-club", "novel-readers", "language-lab", "french-grammar", "spanish-course", "german-words", "dictionary", "encyclopedia", "university",
    "college-courses", "school-district", "kindergarten", "teachers-lounge", "student-union", "research-papers", "open-data", "statistics-office",
    "city-council", "parliament", "ministry-of-health", "hospital", "family-doctor", "dentist", "nursing-care", "pharmacology-journal",
    "chemistry-lab", "biology-today", "genetics", "medicine-review", "nutrition-facts", "healthy-recipes", "bread-baking", "cookbook",
    "kitchen-stories", "coffee-roasters", "tea-house", "winery-tours", "farmers-market", "farmland-trust", "organic-farming", "wildlife-park",
    "birdwatch", "bird-tracks", "animal-shelter", "dog-training", "cat-care", "horse-riding", "football-league", "tennis-club", "cycling-team",
    "running-shoes", "swimming-pool", "chess-club", "boardgames", "puzzles", "knitting-patterns", "sewing-room", "woodworking", "home-repair",
    "architecture", "interior-design", "furniture-store", "bicycle-shop", "bookshop", "toy-shop", "flower-shop", "train-tables", "railway-museum",
    "airport-info", "harbor-cruise", "bus-routes", "car-repair", "electric-cars", "energy-saver", "solar-panels", "wind-power", "water-works",
    "recycling-center", "software-docs", "python-tutorial", "linux-forum", "database-design", "compiler-notes", "web-standards", "open-source",
    "security-research", "privacy-rights", "law-review", "legal-aid", "adulthood-studies", "adult-education", "adult-literacy", "better-homes",
    "alphabet-book", "elizabeth-tudor", "winter-sports", "window-cleaning", "darwin-project", "windmill", "twins-club", "freedom-press",
    "freeman-hall", "carefree-travel", "free-library", "cheapside-history", "pilgrim-road", "pillow-store", "caterpillar", "adsorption-lab",
    "shadows-theatre", "roads-and-bridges", "heads-up-school", "racetrack", "soundtrack", "tracking-wolves", "betty-crafts", "diabetes-care",
    "alphabets", "tibet-culture", "sextant-navigation", "essex-county", "middlesex", "spamwatch-research", "link-layer", "linked-lists",
    "clicker-training", "casing-works", "cash-register-museum", "slotcar-racing", "bank", "insurance", "charity", "church", "community-center",
    "town-hall", "newsletter", "magazine", "radio", "television", "podcast", "photography", "painting", "sculpture", "ceramics", "calligraphy",
    "archive", "gazette", "observer", "tribune", "chronicle", "bulletin", "forum", "wiki", "blog-of-anna", "johns-notes", "maria-cooks",
    "the-thinker", "the-other-side", "another-story", "nation-builders", "station-master", "relations", "education-trust", "motion-pictures",
    "thermal-springs", "theories", "heritage", "threads", "brother-sister", "weather-vane", "northern-lights", "southern-cross", "eastern-philosophy",
    "western-union-history", "interest-rates", "literature", "entropy", "estuary", "hand-crafts", "sandstone", "island-life", "england-walks",
    "ireland-tours", "iceland", "holland-flowers", "orchards", "shore-lines", "anthology", "ethics", "methodist", "mathematics", "pathology",
    "author-index", "whale-watch", "wheat-fields", "white-papers",
)
_TOP, _SUB = ("com", "net", "org", "info"), ("", "www.", "blog.", "m.", "shop.", "news.")
_PATH = ("/", "/en/{}.html", "/fr/{}", "/de/{}", "/es/{}/", "/news/{}", "/item/{}", "/about", "/{}/index.html", "/a/b/{}")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The built-in labelled table (url, blocked): a url for each name, the same subdomains, top domains and paths for both classes."""
    rows = []
    for blocked, names in ((1, _BAD), (0, _GOOD)):
        for i, name in enumerate(names):
            url = f"http{'s' * (i % 2)}://{_SUB[i % 6]}{name}{('', '.example')[i // 6 % 2]}.{_TOP[i // 2 % 4]}" + _PATH[i // 3 % 10].format(37 * i + 5)
            rows.append(f"('{url}', {blocked})")
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(url, blocked)")


def host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(h: Column, p: Column) -> Column:
    """The longest rule that fits, as (name, verdict); null if none. More of the host counts first, then more of the path."""
    fits = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule_host, prefix, verdict in sorted(RULES, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fit = ((h == rule_host) | h.endswith("." + rule_host)) & p.startswith(prefix)
        fits = F.when(fit, F.struct(F.lit(rule_host + prefix).alias("name"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def ngrams(h: Column, p: Column) -> Column:
    """Hashed character n-grams: of the host between bounds, and of the path (digits made alike) apart from them."""

    def of(text: Column, tag: str) -> list[Column]:
        def width(n: int) -> Column:
            places = F.sequence(F.lit(1), F.length(text) - (n - 1))
            return F.when(F.length(text) >= n, F.transform(places, lambda i: F.concat(F.lit(tag), F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))

        return [width(n) for n in WIDTHS]

    grams = F.concat(*of(F.concat(F.lit("^"), h, F.lit("$")), "h"), *of(F.regexp_replace(p, "[0-9]+", "0"), "p"))
    return F.transform(grams, lambda g: F.pmod(F.xxhash64(g), F.lit(BUCKETS)).cast("int"))


def train(labelled: DataFrame) -> tuple[list[float], float]:
    """Weights by bucket, and the intercept. ``labelled``: url, blocked (0 or 1). One query, whose result has at most ``BUCKETS`` + 1 rows."""
    rows = labelled.where("url IS NOT NULL AND blocked IS NOT NULL").select("url", F.col("blocked").cast("double").alias("y"))
    n = rows.limit(MAX_LABELLED + 1).count()
    if not 0 < n <= MAX_LABELLED:
        raise ValueError(f"the labelled table must have 1 to {MAX_LABELLED} rows")
    rows = rows.coalesce(1).select(F.row_number().over(Window.orderBy("url", "y")).alias("i"), "y", ngrams(host(F.col("url")), path(F.col("url"))).alias("g"))
    grams = rows.select("i", F.explode("g").alias("b")).groupBy("i", "b").count()
    norm = grams.groupBy("i").agg(F.sqrt(F.sum(F.col("count") * F.col("count"))).alias("norm"))
    grams = grams.join(norm, "i").select("i", "b", (F.col("count") / F.col("norm")).alias("v")).union(rows.select("i", F.lit(-2), F.lit(1e-9)))  # so that each has some
    other = grams.select(F.col("i").alias("j"), "b", F.col("v").alias("u")).repartition("b")
    pairs = grams.repartition("b").join(other, "b").groupBy("i", "j").agg(F.sum(F.col("v") * F.col("u")).alias("k"))
    line = pairs.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "k"))).alias("k"))
    one = rows.select("i", "y").join(line, "i").select("i", "y", F.transform("k", lambda x: x["k"]).alias("k")).groupBy().agg(F.array_sort(F.collect_list(F.struct("i", "y", "k"))).alias("r"))
    alpha = one.select(_descend(F.col("r"), n).alias("x"))
    intercept = alpha.select(F.lit(-1).alias("b"), F.col("x.intercept").alias("w"))
    alpha = alpha.select(F.posexplode("x.a").alias("at", "a")).select((F.col("at") + 1).alias("i"), "a")
    found = {r["b"]: r["w"] for r in grams.join(alpha, "i").groupBy("b").agg(F.sum(F.col("v") * F.col("a")).alias("w")).union(intercept).collect()}
    return [found.get(b, 0.0) for b in range(BUCKETS)], found[-1]


def _descend(r: Column, n: int) -> Column:
    """From all examples (i, y, k: the products with all) the number a of each, without their mean, and the intercept.

    Products are centred: what all examples share would only slow the descent. The intercept is one more n-gram, of weight ``BIAS``. No eigenvalue of the products is
    larger than the largest sum of a row, which bounds the step."""
    add = lambda s, x: s + x
    total = lambda a: F.aggregate(a, F.lit(0.0), add)
    dot = lambda a, b: total(F.zip_with(a, b, lambda x, y: x * y))

    def centred(mean: Column) -> Column:
        return let(total(mean) / n + BIAS, lambda all_: F.zip_with(r, mean, lambda x, p: F.struct(x["y"].alias("y"), F.zip_with(x["k"], mean, lambda v, q: v - p - q + all_).alias("k"))))

    def descent(rows: Column) -> Column:
        return let(4 * n / F.array_max(F.transform(rows, lambda x: F.aggregate(x["k"], F.lit(0.0), lambda s, v: s + F.abs(v)))), lambda rate: turns(rows, rate))

    def turns(rows: Column, rate: Column) -> Column:
        # u is where the slope is taken, a the examples' numbers, b those of the step before; odd turns find a, even ones u
        slope = lambda u: F.zip_with(u, rows, lambda x, e: x * (1 - rate * DECAY) + (e["y"] - 1 / (1 + F.exp(-dot(e["k"], u)))) * rate / n)
        ahead = lambda s, t: F.zip_with(s["a"], s["b"], lambda x, z: x + (x - z) * (t / 2) / (t / 2 + 3))
        step = lambda s, t: F.struct(
            F.when(t % 2 == 0, ahead(s, t)).otherwise(s["u"]).alias("u"), F.when(t % 2 == 1, slope(s["u"])).otherwise(s["a"]).alias("a"), F.when(t % 2 == 1, s["a"]).otherwise(s["b"]).alias("b")
        )
        zero = F.array_repeat(F.lit(0.0), n)
        return F.aggregate(F.sequence(F.lit(1), F.lit(2 * STEPS - 1)), F.struct(zero.alias("u"), zero.alias("a"), zero.alias("b")), step)["a"]

    def result(a: Column) -> Column:
        own = F.transform(a, lambda x: x - total(a) / n)
        return let(own, lambda w: F.struct(w.alias("a"), (total(a) * BIAS - total(F.transform(r, lambda x: dot(x["k"], w))) / n).alias("intercept")))

    return let(F.transform(r, lambda x: total(x["k"]) / n), lambda mean: let(centred(mean), lambda rows: let(descent(rows), result)))


def score(h: Column, p: Column, weights: list[float], intercept: float) -> Column:
    """Probability that a url is to be blocked."""
    w = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    counts = ngrams(h, p)
    # the norm that training used is of counts by bucket; sorting puts equal buckets together
    runs = F.aggregate(
        F.array_sort(counts),
        F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("sq"), F.lit(0.0).alias("dot")),
        lambda acc, b: F.struct(
            b.alias("last"),
            F.when(acc["last"] == b, acc["run"] + 1).otherwise(F.lit(1).cast("long")).alias("run"),
            (acc["sq"] + F.when(acc["last"] == b, 2 * acc["run"] + 1).otherwise(F.lit(1).cast("long"))).alias("sq"),
            (acc["dot"] + F.element_at(w, b + 1)).alias("dot"),
        ),
    )
    return 1 / (1 + F.exp(-(F.when(runs["sq"] > 0, runs["dot"] / F.sqrt(runs["sq"])).otherwise(0.0) + intercept)))


def url_filter(pages: DataFrame, labelled: DataFrame | None = None, *, page_id: str = "page_id", url: str = "url", threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score (null where a rule decides)."""
    weights, intercept = train(labelled if labelled is not None else labelled_urls(pages.sparkSession))
    h, p = F.col("host"), F.col("path")
    return (
        pages.select(F.col(page_id).alias("page_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
        .withColumn("fit", rule(h, p))
        .withColumn("score", F.when(F.col("fit").isNull(), score(h, p, weights, intercept)))
        .select("page_id", "host", "path", F.col("fit")["name"].alias("rule"), F.coalesce(F.col("fit")["verdict"], F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
    )


def url_rules(pages: DataFrame, *, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, and the rule that decides with its verdict (null if none does): what ``url_filter`` knows without its model."""
    parts = pages.select(F.col(page_id).alias("page_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path")).withColumn("fit", rule(F.col("host"), F.col("path")))
    return parts.select("page_id", "host", "path", F.col("fit")["name"].alias("rule"), F.col("fit")["verdict"].alias("verdict"))


def _rules_sql() -> str:
    fits = "\n".join(f"    WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p} {v}'" for h, p, v in sorted(RULES, key=lambda r: (-len(r[0]) - len(r[1]), r)))
    return rf"""WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages), r AS (SELECT *, CASE
{fits} END AS fit FROM p)
  SELECT page_id, host, path, split_part(fit, ' ', 1) AS rule, split_part(fit, ' ', 2) AS verdict FROM r"""


#: Of ``url_rules``.
SQL = _rules_sql()
