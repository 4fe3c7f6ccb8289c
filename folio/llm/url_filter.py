"""URL filter: rules first, then logistic regression on hashed character n-grams.

The model is trained from a small labelled table of URLs (``TRAINING``; another one can
be given) with Spark's own logistic regression, on one small partition. Features are
the character n-grams of host and path, hashed; training and scoring are JVM expressions.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_case

#: (host, path, verdict). A rule fits its host and all subdomains if the url's path starts with its path.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Rules are kept as a literal up to this number; more are joined by host.
MAX_LITERAL = 500
#: At most so many labelled urls train the model (the smallest hashes of the urls).
MAX_TRAINING = 20_000
N_FEATURES = 1 << 14
#: The score from which a url is blocked: above one half, as hosts without any known word lie near it.
THRESHOLD = 0.7
SIZES = (3, 4)

#: Words of hosts by topic: what is to be blocked, and what isn't.
BLOCKED = {
    "gambling": "casino poker slots roulette betting jackpot blackjack bingo lottery wager odds bookmaker",
    "pharmacy": "viagra cialis pills pharmacy meds tramadol xanax steroids rxonline slimming",
    "adult": "porn xxx sexcam nude escort erotic hentai milf adultvideo singles",
    "malware": "malware cracked keygen warez torrents serialz hacktool trojan pirated nulled",
    "advertising": "ads adserver banner popunder clickads affiliate pixel tracker adnetwork adclick",
    "scams": "payday loans giveaway prizes doubler forex quickcash replica miracle getrich",
    "spam": "spam seo backlinks linkfarm clickfarm traffic bulkmail mailer followers likes",
}
ALLOWED = {
    "news": "news times herald gazette journal press chronicle daily tribune courier",
    "learning": "university school college library academy campus courses lectures students codecamp",
    "state": "council parliament ministry court police customs embassy cityhall statistics elections",
    "health": "hospital clinic dentist nursing health medicine doctors therapy surgery midwives",
    "science": "physics biology chemistry astronomy geology mathematics research institute observatory laboratory",
    "software": "software developer docs linux database wiki forum compiler opensource hosting",
    "culture": "museum theatre opera gallery orchestra cinema books poetry archive film",
    "sport": "football tennis cycling running hockey rowing sailing chess skiing athletics",
    "travel": "travel hotel railway airport island camping hiking tours maps ferry",
    "home": "garden recipes kitchen bakery furniture knitting family pets birds farmhouse",
    "trade": "bookshop market bank insurance logistics engineering printing tools repair bicycles",
    "people": "anderson whitfield moreau schneider garcia windsor thornton adelaide freedom betterton",
}
#: What hosts of all topics have beside the word, and the rest of a url; each goes with both labels alike, so it tells nothing.
_BESIDE = ["", "my", "the", "best-", "online-", "new", "top", "-club", "-shop", "24", "-world", "-online", "free", "-net", "city", "-info"]
_ENDS = ["com", "net", "org", "info", "biz", "de", "fr", "es", "io", "co.uk"]
_PATHS = ["", "/", "/index.html", "/en/12", "/fr/825", "/de/4/", "/es/640.html", "/page/3", "/about", "/blog/2019/05/hello", "/shop/item/7?id=1"]


def labelled_urls(topics: dict[str, str], label: int) -> list[tuple[str, int]]:
    """Four urls for each word: alone, with something before or behind it, with the next word of its topic, and as a subdomain."""
    out = []
    for words in topics.values():
        every = words.split()
        for k, w in enumerate(every):
            n = len(out) // 4
            beside = _BESIDE[n % len(_BESIDE)]
            joined = w + beside if beside.startswith(("-", "2")) else beside + w
            hosts = [f"http://{w}", f"https://www.{joined}", f"http://{w}{'-' if n % 2 else ''}{every[(k + 1) % len(every)]}", f"https://{w}.example"]
            out += [(f"{h}.{_ENDS[(n + i) % len(_ENDS)]}{_PATHS[(n + 3 * i) % len(_PATHS)]}", label) for i, h in enumerate(hosts)]
    return out


#: The labelled table, built by that rule; another one can be given.
TRAINING = labelled_urls(BLOCKED, 1) + labelled_urls(ALLOWED, 0)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path. Null or no ``://``: both empty."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return fold_case(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _grams(host: Column, path: Column) -> Column:
    """Character n-grams of ``^host$`` (marked h) and of the path with its digits as 0 (marked p)."""

    def of(text: Column, mark: str) -> list[Column]:
        n = F.length(text)
        return [F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.concat(F.lit(mark), text.substr(i, F.lit(k))))).otherwise(F.array().cast("array<string>")) for k in SIZES]

    marked = F.concat(F.lit("^"), host, F.lit("$"))
    return F.concat(*of(marked, "h"), *of(F.lower(F.regexp_replace(path, r"\d", "0")), "p"))


def _features(df: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=N_FEATURES, inputCol="__grams", outputCol="__features", binary=True).transform(df.withColumn("__grams", _grams(F.col("host"), F.col("path"))))


def train(labelled: DataFrame) -> LogisticRegressionModel | None:
    """Fit on (url, label 0 or 1). Rows with a null url or label are left out; of more than MAX_TRAINING urls a fixed hash
    sample is taken. Without rows of both labels there is no model."""
    host, path = parts(F.col("url"))
    rows = labelled.where("url is not null and label is not null").orderBy(F.xxhash64("url"), "url").limit(MAX_TRAINING)
    rows = rows.select(host.alias("host"), path.alias("path"), F.col("label").cast("double").alias("__label")).coalesce(1)
    count = dict(rows.groupBy("__label").count().collect())  # two rows
    if len(count) < 2:
        return None
    # Both kinds weigh the same, however many of each there are.
    weight = F.lit(0.5) / F.when(F.col("__label") == 1, F.lit(count[1.0])).otherwise(F.lit(count[0.0])) * sum(count.values())
    rows = rows.withColumn("__weight", weight)
    return LogisticRegression(featuresCol="__features", labelCol="__label", weightCol="__weight", regParam=0.01, maxIter=50).fit(_features(rows))


def default_training(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"('{u}', {label})" for u, label in TRAINING)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(url, label)")


def _suffixes(host: Column) -> Column:
    """The host and the hosts above it: a.b.c, b.c, c."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))


def _by_literal(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    # Longest first; of equally long ones the first by text.
    for host, path, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        found = F.coalesce(found, F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))))
    return df.withColumn("__rule", found)


def _by_join(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """For many rules: an equi-join of the host's suffixes with the rules' hosts, once per distinct (host, path)."""
    spark = df.sparkSession
    table = spark.createDataFrame(rules, "r_host string, r_path string, r_verdict string")
    urls = df.select("host", "path").distinct()
    met = urls.withColumn("r_host", F.explode(_suffixes(F.col("host")))).join(table, "r_host").where(F.col("path").startswith(F.col("r_path")))
    rule = F.struct((-F.length(F.concat("r_host", "r_path"))).alias("n"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))
    best = met.groupBy("host", "path").agg(F.min(rule).alias("b")).select("host", "path", F.struct("b.rule", "b.verdict").alias("__rule"))
    return df.join(best, ["host", "path"], "left")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Judge every url of ``pages`` (page_id, url).

    Returns page_id, host, path, rule (null if none fits), verdict (allow or block: the
    longest fitting rule's, else the model's), score (the model's probability of block),
    one row per input row. A null url, or one without ``://``, has an empty host and path
    and is judged like any other. Without labelled urls of both kinds there is no model: the score is null and urls without a rule are allowed. An empty table gives no rows.
    """
    model = train(default_training(pages.sparkSession) if labelled is None else labelled)
    host, path = parts(F.col("url"))
    df = pages.select("page_id", host.alias("host"), path.alias("path"))
    df = _by_literal(df, rules) if len(rules) <= MAX_LITERAL else _by_join(df, rules)
    if model is None:
        scored = df.withColumn("score", F.lit(None).cast("double"))
    else:
        scored = model.transform(_features(df)).withColumn("score", vector_to_array("probability")[1])
    by_model = F.when(F.col("score") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", F.col("__rule.rule").alias("rule"), F.coalesce("__rule.verdict", by_model).alias("verdict"), "score")
