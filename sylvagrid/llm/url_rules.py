"""Association-rule filtering of URLs.

URLs are cut into tokens (scheme, host labels, path words, file ending, query keys; numbers
become one token). FP-growth over the labelled URLs mines token combinations that go with
``block`` or ``allow``; rules below the support, confidence or lift limits are dropped. Support is
relative and at least ``MIN_COUNT`` labelled URLs; the limit of lift is each verdict's own, since
little can lift what most labels say already, and a rule must stand out from chance as well. Tokens that the very same labelled URLs have are mined
as one class; a URL has the class if it has any of them. FP-growth lists all combinations, so it
mines labelled URLs of up to ``URL_TOKENS`` frequent classes. Combinations that a longer one has are
mined level by level, counted over all labelled URLs, and only those grow that may still gain: see
``long_rules``. Nothing is cut, and every URL is decided as by the list of all rules.
Rules are posted in an inverted index under their rarest class; a URL that has it is verified
against the whole combination, and the rule of highest confidence decides. Without a matching
rule a URL is allowed. Given host rules come before mined ones.

DataFrame operations and Spark ML only. A null url, or one without ``://``, has an empty host and
path. Repeated URLs are decided once and carried back. Without labels nothing is mined.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# Fixed values: (host, path, verdict) of the given rules.
HOST_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
              ("net", "/es/", "block"), ("net", "/fr/", "block"))
MIN_SUPPORT = 0.001
MIN_CONFIDENCE = 0.4
MIN_COUNT = 5  # labelled URLs behind a rule, at least
MIN_LIFT = {"block": (1.5, 3.0), "allow": (1.1, 3.0)}  # lift, and standard errors of a rule's share above its label's share
URL_TOKENS = 12  # frequent classes up to which FP-growth mines a labelled URL
INDEX_ROWS = 20_000  # rules or combinations up to which they are broadcast
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def given_rule(host: Column, path: Column, rules=HOST_RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest given rule that fits; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # later, longer ones win
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL."""
    def named(kind: str, words: Column) -> Column:
        words = F.filter(words, lambda w: w != "")
        return F.transform(words, lambda w: F.concat(F.lit(kind), F.when(w.rlike(r"\A[0-9]+\z"), F.lit("#")).otherwise(F.lower(w))))

    path = path_of(url)
    query = F.regexp_extract(_rest(url), r"\?([^#]*)", 1)
    return F.array_distinct(F.concat(
        named("scheme:", F.array(F.regexp_extract(url, r"\A([A-Za-z][A-Za-z0-9+.-]*)://", 1))),
        named("host:", F.split(host_of(url), r"\.")),
        named("path:", F.split(F.regexp_replace(path, r"\.[A-Za-z0-9]+\z", ""), r"[/._-]")),
        named("ending:", F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]+)\z", 1))),
        named("key:", F.transform(F.split(query, "&"), lambda q: F.regexp_extract(q, r"\A[^=]*", 0)))))


def token_classes(urls: DataFrame) -> DataFrame:
    """(token, item, freq): tokens that the same rows of ``urls`` (url) have share an item, the first of them.

    The rows of a token are told by their number and two sums of hashes, 128 bits together.
    """
    each = urls.select(F.xxhash64("url").alias("h"), F.hash("url").alias("g"), F.explode(tokens_of(F.col("url"))).alias("token"))
    rows = each.groupBy("token").agg(F.count(F.lit(1)).alias("freq"), F.sum(F.col("h").cast("decimal(38,0)")).alias("_h"),
                                     F.sum(F.xxhash64("h", "g").cast("decimal(38,0)")).alias("_g"))
    first = rows.groupBy("freq", "_h", "_g").agg(F.min("token").alias("item"))
    return rows.join(first, ["freq", "_h", "_g"]).select("token", "item", "freq")


def _small(df: DataFrame) -> DataFrame:
    """``df`` (written) with a hint where it is short."""
    return df.hint("broadcast") if df.count() <= INDEX_ROWS else df


def _enough(verdict: Column, confidence: Column, lift: Column, support: Column, n: int, limits: Mapping[str, tuple[float, float]]) -> Column:
    """Whether a rule keeps the limits of its verdict; grows with confidence and with support."""
    usual, behind = confidence / lift, support * n / confidence
    errors = (confidence - usual) * F.sqrt(behind)
    enough = F.lit(False)
    for v, (least, least_errors) in limits.items():
        enough = enough | ((verdict == v) & (lift >= least) & (errors >= least_errors * F.sqrt(usual * (1 - usual))))
    return enough


def long_rules(baskets: DataFrame, n: int, count: int, min_confidence: float, limits: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Rules (mined, closed, verdict, confidence, support) of combinations that a long basket has, by levels.

    ``baskets`` holds (items, label, times, long), ``n`` labelled URLs together. An item that excludes
    no URL of another label from a combination only costs support: the combination without it, and
    any larger one without it, is at least as confident and as frequent. So a combination grows only
    if each of its items excludes such a URL, some are left to exclude, and its own URLs would be
    enough for a rule of confidence 1. Of the rules those more confident than all their parts are
    returned; the others never decide. ``closed`` are all items that the URLs of ``mined`` share.
    """
    spark = baskets.sparkSession
    said = {r["label"]: r["n"] for r in baskets.where(F.col("label").isin(list(limits))).groupBy("label").agg(F.sum("times").alias("n")).collect()}
    shares = spark.createDataFrame([(v, c / n) for v, c in said.items()], "verdict string, share double").hint("broadcast")
    sets = spark.createDataFrame([(v, [], n - c, 0.0, True) for v, c in said.items()], "verdict string, mined array<string>, misses long, best double, open boolean")
    places = baskets.select("*", F.explode(F.array(*map(F.lit, said)).cast("array<string>")).alias("verdict"), F.array().cast("array<string>").alias("mined"))
    hit, levels = F.col("label") == F.col("verdict"), []
    support = F.col("hits") / n
    while True:
        after = F.coalesce(F.array_max("mined"), F.lit(""))
        places = places.select("items", "label", "times", "long", "verdict", "mined", F.explode(F.filter("items", lambda i: i > after)).alias("item"))
        places = places.withColumn("mined", F.array_append("mined", F.col("item"))).drop("item")
        counted = places.groupBy("verdict", "mined").agg(
            F.sum(F.when(hit, F.col("times")).otherwise(0)).alias("hits"), F.sum(F.when(hit, 0).otherwise(F.col("times"))).alias("misses"), F.max("long").alias("long"))
        hopeful = _enough(F.col("verdict"), F.lit(1.0), F.lit(1.0) / F.col("share"), support, n, limits)
        counted = counted.where(F.col("long") & (F.col("hits") >= count)).join(shares, "verdict").where(hopeful).drop("long", "share")
        less = counted.withColumn("part", F.explode(F.transform("mined", lambda i: F.array_remove("mined", i))))
        known = sets.where("open").select("verdict", F.col("mined").alias("part"), F.col("misses").alias("around"), "best")
        joined = less.join(known, ["verdict", "part"]).groupBy("verdict", "mined", "hits", "misses").agg(
            F.count(F.lit(1)).alias("parts"), F.min("around").alias("around"), F.max("best").alias("best"))
        joined = joined.where(F.col("parts") == F.size("mined")).withColumn("confidence", F.col("hits") / (F.col("hits") + F.col("misses")))
        sets = written(joined.select("verdict", "mined", "hits", "misses", "confidence", F.greatest("best", "confidence").alias("best"),
                                     (F.col("confidence") > F.col("best")).alias("rises"),
                                     ((F.col("misses") > 0) & (F.col("misses") < F.col("around"))).alias("open")).where("open or rises"))
        if sets.isEmpty():
            break
        places = written(places.join(_small(sets.select("verdict", "mined", "open")), ["verdict", "mined"]))
        levels.append((sets, places))
        places = places.where("open").drop("open")
    rules = spark.createDataFrame([], "mined array<string>, closed array<string>, verdict string, confidence double, support double")
    for sets, places in levels:
        sure = sets.where(F.col("rises") & (F.col("confidence") >= min_confidence)).join(shares, "verdict").where(
            _enough(F.col("verdict"), F.col("confidence"), F.col("confidence") / F.col("share"), support, n, limits))
        sure = written(sure.select("mined", "verdict", "hits", "misses", "confidence", support.alias("support")))
        each = places.drop("open").join(_small(sure), ["verdict", "mined"]).withColumn("item", F.explode("items"))
        each = each.groupBy(*sure.columns, "item").agg(F.sum("times").alias("times")).where(F.col("times") == F.col("hits") + F.col("misses"))
        rules = rules.unionByName(each.groupBy(*sure.columns).agg(F.collect_list("item").alias("closed")).drop("hits", "misses"))
    return rules


def mine_rules(urls: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
               min_lift: float | Mapping[str, tuple[float, float]] = MIN_LIFT, min_count: int = MIN_COUNT, url_tokens: int = URL_TOKENS) -> DataFrame:
    """Rules (``tokens``, ``parts``, ``keys``, ``verdict``, ``confidence``, ``support``) mined from (url, label).

    A URL matches if it has a token of each of ``parts``; its tokens among ``tokens`` tell the size of
    the largest such combination. ``keys`` is the part rarest in the labelled URLs. The rules are
    written once. One number as ``min_lift`` limits the lift of all verdicts, and nothing else.
    ``url_tokens`` moves URLs between the two ways of mining; no verdict depends on it.
    """
    rows = written(urls.where("url is not null and label is not null").select("url", "label").withColumn("row", F.monotonically_increasing_id()))
    n = max(1, rows.count())
    count = max(1, math.ceil(min(1.0, max(min_support, min_count / n)) * n - 1e-9))
    limits = min_lift if isinstance(min_lift, Mapping) else {v: (min_lift, 0.0) for v in MIN_LIFT}
    classes = written(token_classes(rows))
    found = rows.select("row", F.explode(tokens_of(F.col("url"))).alias("token")).join(classes.where(F.col("freq") >= count), "token").groupBy("row").agg(
        F.array_sort(F.collect_set("item")).alias("found"))  # one URL's classes
    items = rows.join(found, "row", "left").select("row", "label", F.coalesce("found", F.array().cast("array<string>")).alias("items"))
    items = written(items.withColumn("long", F.size("items") > url_tokens))
    # Long URLs count as URLs of their label here; their combinations come from long_rules.
    mined = F.when(F.col("long"), F.array().cast("array<string>")).otherwise(F.col("items"))
    listed = items.select(F.array_append(mined, F.concat(F.lit("label:"), "label")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=(count - 0.5) / n, minConfidence=min_confidence).fit(listed)
    rules = model.associationRules.where(F.element_at("consequent", 1).startswith("label:"))
    verdict = F.regexp_extract(F.element_at("consequent", 1), r"\Alabel:(.*)", 1)
    rules = rules.where(_enough(verdict, F.col("confidence"), F.col("lift"), F.col("support"), n, limits))
    mined = F.array_sort("antecedent")
    rules = rules.select(mined.alias("mined"), mined.alias("closed"), verdict.alias("verdict"), "confidence", "support")
    longs = items.where("long").select("items").distinct()
    if not longs.isEmpty():
        posted = longs.select(F.col("items").alias("_long"), F.explode("items").alias("_first"))
        within = (F.element_at("mined", 1) == F.col("_first")) & (F.size(F.array_intersect("mined", "_long")) == F.size("mined"))
        rules = rules.join(posted, within, "left_anti")
        shared = longs.select(F.explode("items").alias("item")).distinct()
        baskets = items.where(F.size("items") > 0).select("row", "label", "long", F.explode("items").alias("item")).join(shared, "item")
        baskets = baskets.groupBy("row", "label", "long").agg(F.array_sort(F.collect_list("item")).alias("items"))
        baskets = baskets.groupBy("items", "label", "long").agg(F.count(F.lit(1)).alias("times"))
        rules = rules.unionByName(long_rules(written(baskets), n, count, min_confidence, limits))
    rules = written(rules)
    words = classes.groupBy("item", "freq").agg(F.array_sort(F.collect_set("token")).alias("words"))
    own = F.array_contains("mined", F.col("item"))
    whole = rules.select("mined", "closed").distinct().withColumn("item", F.explode("closed")).join(words, "item").groupBy("mined", "closed").agg(
        F.array_sort(F.flatten(F.collect_list("words"))).alias("tokens"), F.array_sort(F.collect_list(F.when(own, F.col("words")))).alias("parts"),
        F.min_by("words", F.struct(~own, "freq", "item")).alias("keys"))
    return written(rules.join(whole, ["mined", "closed"]).drop("mined", "closed"))


def decide(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, verdict) of the distinct ``urls`` that a rule matches."""
    index = written(rules.withColumn("key", F.explode("keys")).drop("keys"))
    tokens = urls.where("url is not null").select("url").distinct().withColumn("_tokens", tokens_of(F.col("url")))
    posted = tokens.select("url", "_tokens", F.explode("_tokens").alias("key")).join(_small(index), "key")
    whole = posted.where(F.forall("parts", lambda part: F.arrays_overlap(part, F.col("_tokens"))))
    order = F.struct("confidence", "support", F.size(F.array_intersect("tokens", "_tokens")), "verdict")
    return whole.groupBy("url").agg(F.max_by("verdict", order).alias("_mined"))


def filter_urls(pages: DataFrame, labelled: DataFrame, host_rules=HOST_RULES, **limits) -> DataFrame:
    """``pages`` with host, path, rule and verdict; ``labelled`` holds (url, label)."""
    url = F.coalesce(F.col("url"), F.lit(""))
    out = pages.withColumns({"host": host_of(url), "path": path_of(url)})
    name, verdict = given_rule(F.col("host"), F.col("path"), host_rules)
    out = out.withColumns({"rule": name, "_given": verdict})
    mined = decide(out.where("_given is null"), mine_rules(labelled, **limits))
    return out.join(mined, "url", "left").withColumn(
        "verdict", F.coalesce("_given", "_mined", F.lit("allow"))).drop("_given", "_mined")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """URLs whose path names a labelled document by number: ``block`` for low quality or toxic ones."""
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:[./]|\z)", 1)
    numbered = pages.where("url is not null").select("url", number.alias("_n")).where("_n != ''")
    numbered = numbered.select("url", F.col("_n").cast("long").alias("doc_id"))
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    known = labels.where("quality is not null and toxic is not null").groupBy("doc_id").agg(F.max(bad.cast("int")).alias("_bad"))
    return numbered.join(known, "doc_id").select("url", F.when(F.col("_bad") == 1, "block").otherwise("allow").alias("label"))
