"""URL filtering: a list of host and path rules first, association rules mined from labels for the rest.

Tokens of a URL are its host labels, path segments and query keys. Spark's FP-growth mines the token combinations that
are frequent among labelled URLs; a combination becomes a rule if a URL with it is bad with at least MIN_CONFIDENCE, in
at least MIN_SUPPORT of the labelled URLs, and more often than bad URLs are in general (MIN_LIFT; half way from 1 to the most
that can be reached, 1 / share of bad URLs, where that is less), and if no part of it already is a rule at least as sure. Rules are matched by an inverted index: each is filed under its rarest token, a URL
looks its tokens up, and what is found is checked for the other tokens.

The verdict depends on the URL alone, so it is worked out once for each distinct URL and joined back; a URL that makes
up a third of the rows is one row of that work.

Defined cases: null, or no "://": empty host and path, no token, so no rule and verdict allow. Without labelled URLs, or
without bad ones, no rule is mined. Rows that repeat get the same verdict; an empty table gives an empty table. Extra
columns pass through; input columns named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fresh, table

#: (verdict, host and path)
LIST = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
MIN_SUPPORT = 0.001
MIN_COUNT = 20
MIN_CONFIDENCE = 0.5
MIN_LIFT = 1.5
BAD = "!bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens: h:label, p:segment, q:key."""
    query = F.regexp_extract(_after(url), r"^[^?#]*\?([^#]*)", 1)
    parts = [
        F.transform(F.split(host_of(url), r"\."), lambda x: F.when(x != "", F.concat(F.lit("h:"), x))),
        F.transform(F.split(path_of(url), "/"), lambda x: F.when(x != "", F.concat(F.lit("p:"), x))),
        F.transform(F.split(F.coalesce(query, F.lit("")), "&"), lambda x: F.when(x != "", F.concat(F.lit("q:"), F.regexp_extract(x, "^([^=]*)", 1)))),
    ]
    return F.filter(F.array_distinct(F.concat(*parts)), lambda x: x.isNotNull())


def listed(host: Column, path: Column, rules=LIST) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, min_count: int = MIN_COUNT) -> DataFrame:
    """labelled (url, bad boolean) -> rules (tokens array<string>, confidence, support, head: the rarest token)."""
    from pyspark.ml.fpm import FPGrowth

    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "tokens array<string>, confidence double, support double, head string")
    baskets = checkpoint(labelled.where("url IS NOT NULL AND bad IS NOT NULL").select("bad", tokens_of(F.col("url")).alias("tokens")).where("size(tokens) > 0"))
    total, bad = baskets.agg(F.count(F.lit(1)), F.sum(F.col("bad").cast("long"))).first()
    if not total or not bad:
        return empty
    support = max(min_support, min_count / total)
    if support > 1:
        return empty
    # Tokens that are not frequent are in no frequent combination; they go first.
    counts = baskets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support * total)
    items = F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items")
    least_lift = min(min_lift, (1 + total / bad) / 2)
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(baskets.select(items))
    rules = model.associationRules.where((F.col("consequent") == F.array(F.lit(BAD))) & (F.col("lift") >= least_lift - 1e-9))
    rules = checkpoint(rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support"))
    # A rule goes if another's tokens are a part of its own and that one is as sure. Found by the rules' parts, not by pairs.
    one = rules.select("tokens", "confidence", F.explode("tokens").alias("token"))
    smaller = rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("sure"), F.element_at("tokens", 1).alias("token"))
    beaten = one.join(smaller, "token").where((F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0) & (F.col("sure") >= F.col("confidence"))).select("tokens").distinct()
    rules = rules.join(beaten, "tokens", "left_anti")
    heads = rules.select("tokens", F.explode("tokens").alias("token")).join(counts, "token").groupBy("tokens").agg(F.min(F.struct("n", "token"))["token"].alias("head"))
    return rules.join(heads, "tokens").select("tokens", "confidence", "support", "head")


def judge(pages: DataFrame, labelled: DataFrame, rules=LIST, **options) -> DataFrame:
    """pages (with url) with host, path, rule, verdict, confidence (of the surest mined rule that fits, else null)."""
    names = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "confidence")]
    key, sure, listed_verdict = fresh([*names, "host", "path", "rule", "verdict", "confidence"], "key", "sure", "listed_verdict")
    mined = mine(labelled, **options).withColumnRenamed("tokens", "needs")
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    pages = pages.select(*[F.col(f"`{c}`") for c in names], host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    pages = pages.withColumn("rule", rule).withColumn(listed_verdict, verdict)
    open_urls = pages.where(F.col("rule").isNull() & F.col("url").isNotNull()).select("url").distinct().withColumn("own", tokens_of(F.col("url")))
    looked_up = open_urls.select("url", "own", F.explode("own").alias("head")).join(mined, "head").where(F.size(F.array_except("needs", "own")) == 0)
    hits = looked_up.groupBy("url").agg(F.max("confidence").alias(sure)).select(F.col("url").alias(key), sure)
    found = pages.join(hits, F.col("url") == F.col(key), "left")
    confidence = F.when(F.col("rule").isNull(), F.col(sure))
    return found.select(*[F.col(f"`{c}`") for c in names], "host", "path", "rule", F.coalesce(F.col(listed_verdict), F.when(confidence.isNotNull(), "block").otherwise("allow")).alias("verdict"), confidence.alias("confidence"))


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad): a page's label is that of the document whose number its path ends with; bad: of low quality or toxic."""
    number = F.expr("try_cast(nullif(regexp_extract(url, '://[^/?#]*/(?:[^?#]*/)?([0-9]+)(?:[.][a-z]+)?/?(?:[?#].*)?$', 1), '') AS bigint)")
    own = pages.select("url", number.alias("doc_id")).where("doc_id IS NOT NULL")
    seen = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    return own.join(seen, "doc_id").select("url", "bad")


def op4_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, labelled_urls(pages, table(spark, sf_dir, "labels"))).drop("url")
