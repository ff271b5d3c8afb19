"""URL filters by association rules: a list of rules judges first, mined token combinations the rest.

FP-growth mines combinations of URL tokens together with the verdict of labelled urls.  A rule
"combination -> verdict" is kept if support and confidence reach their bars and no part of the
combination says the same with as much confidence.  Rules are posted in an inverted index under
their rarest token; a url meets a rule if it holds that token and then all others.

Everything is DataFrame functions and Spark's own FP-growth; no Python runs on the workers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithlink.operators.scale import broadcast_up_to, staged

ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A token no rule is posted under; each row carries it once, so that rows without tokens stay and can be counted.
_ROW = ""


@dataclass(frozen=True)
class Listed:
    """A rule of a list: a host with its subdomains, the start of a path, and the verdict."""
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Mining:
    """support: least share of the labelled urls that hold a combination and its verdict.
    confidence: least share with that verdict among the labelled urls that hold the combination.
    otherwise: the verdict of urls that no rule meets.
    broadcast_rules: more rules, or tokens in them, are joined by shuffle, with the same result."""
    support: float = 0.01
    confidence: float = 0.8
    otherwise: str = ALLOW
    broadcast_rules: int = 100_000


def _rest(url: Column) -> Column:
    """What follows the first ://, or nothing."""
    at = F.instr(url, "://")
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a url: labels of its host, segments of its path, names in its query; null has none."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1))

    def kind(name: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(name), p))

    return F.array_distinct(F.concat(
        kind("host:", F.split(host_of(url), r"\.")), kind("path:", F.split(path_of(url), "/")), kind("query:", names)))


def listed_rule(host: Column, path: Column, rules: Sequence[Listed]) -> Column:
    """(length, name, verdict) of the longest rule that fits, or null; of equally long ones the last by name."""
    fitting = [F.when(((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)),
                      F.struct(F.lit(len(r.name)).alias("length"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict")))
               for r in rules]
    if not fitting:
        return F.lit(None).cast("struct<length:int,name:string,verdict:string>")
    return F.greatest(*fitting) if len(fitting) > 1 else fitting[0]


def mine(labelled: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """Rules from `labelled` (url, verdict): combination, verdict, confidence, support, posted.

    All rows are mined.  Rows whose verdict is null or neither allow nor block, or whose url is null, take
    no part.  A rule is left out if a proper part of its combination gives the same verdict with at least its
    confidence: that part meets every url the rule meets and goes before it.  `posted` is the token of the
    combination that the fewest labelled urls hold, the first by name of equals.
    """
    known = (labelled.where(F.col("verdict").isin(ALLOW, BLOCK) & F.col("url").isNotNull())
             .select(F.concat(tokens_of(F.col("url")), F.array(F.concat(F.lit("verdict:"), "verdict"))).alias("items")))
    known = staged(known, "url-labels")
    if known.isEmpty():
        return known.where("false").select(
            F.col("items").alias("combination"), F.lit("").alias("verdict"), F.lit(0.0).alias("confidence"),
            F.lit(0.0).alias("support"), F.lit("").alias("posted"))
    model = FPGrowth(itemsCol="items", minSupport=mining.support, minConfidence=mining.confidence).fit(known)
    verdict = F.element_at("consequent", 1)
    rules = staged(
        model.associationRules.where(F.startswith(verdict, F.lit("verdict:"))
                                     & ~F.exists("antecedent", lambda t: F.startswith(t, F.lit("verdict:"))))
        .select(F.sort_array("antecedent").alias("combination"), F.substring_index(verdict, ":", -1).alias("verdict"),
                "confidence", "support"), "url-rules")
    counts = staged(model.freqItemsets.where(F.size("items") == 1)
                     .select(F.element_at("items", 1).alias("token"), "freq"), "url-tokens")
    rarest = (rules.select("combination", F.explode(F.array_distinct("combination")).alias("token")).distinct()
              .join(counts, "token").groupBy("combination").agg(F.min(F.struct("freq", "token")).alias("_r")))
    posted = rules.join(rarest, "combination").withColumn("posted", F.col("_r.token")).drop("_r")
    # the index against itself: rules that hold the token another rule is posted under, and all of that rule
    part = posted.select(F.col("posted").alias("token"), F.col("combination").alias("_part"),
                         F.col("verdict").alias("_verdict"), F.col("confidence").alias("_confidence"))
    said_before = (posted.withColumn("token", F.explode("combination")).join(part, "token")
                   .where((F.col("verdict") == F.col("_verdict")) & (F.col("_confidence") >= F.col("confidence"))
                          & (F.size("_part") < F.size("combination"))
                          & (F.size(F.array_except("_part", "combination")) == 0))
                   .select("combination", "verdict").distinct())
    return staged(posted.join(said_before, ["combination", "verdict"], "left_anti")
                   .select("combination", "verdict", "confidence", "support", "posted"), "url-rules")


def match(urls: DataFrame, rules: DataFrame, key: str, mining: Mining = Mining()) -> DataFrame:
    """Per distinct (key, url): copies (its rows) and best, the rule with the highest confidence, then support,
    then the shorter combination, then block, then the last by name; null if no rule is met.

    One shuffle, of what each url shares with the tokens of the rules; the second grouping keeps its partitioning.
    """
    vocabulary = (rules.select(F.explode("combination").alias("token")).distinct()
                  .unionByName(urls.sparkSession.range(1).select(F.lit(_ROW).alias("token"))))
    tokens = F.coalesce(tokens_of(F.col("url")), F.array().cast("array<string>"))
    held = (urls.select(key, "url", F.explode(F.concat(F.array(F.lit(_ROW)), tokens)).alias("token"))
            .join(broadcast_up_to(vocabulary, mining.broadcast_rules), "token")
            .groupBy(key, "url")
            .agg(F.count_if(F.col("token") == _ROW).alias("copies"), F.collect_set("token").alias("held")))
    index = rules.select(F.col("posted").alias("token"), "combination",
                         F.struct("confidence", "support", (-F.size("combination")).alias("shortness"), (F.col("verdict") == BLOCK).alias("blocks"),
                                  F.array_join("combination", " ").alias("combination")).alias("rule"))
    met = F.size(F.array_except("combination", "held")) == 0
    return (held.withColumn("token", F.explode("held"))
            .join(broadcast_up_to(index, mining.broadcast_rules), "token", "left")
            .groupBy(key, "url")
            .agg(F.max("copies").alias("copies"), F.max(F.when(met, F.col("rule"))).alias("best")))


def judge(pages: DataFrame, listed: Sequence[Listed], labelled: DataFrame | None = None, mining: Mining = Mining(),
          key: str = "page_id") -> DataFrame:
    """One row per row of `pages`: key, host, path, rule, verdict, combination, confidence.

    The longest fitting rule of the list gives the verdict; a url that none fits gets that of the best mined
    rule it meets (`combination`, `confidence`), and mining.otherwise if it meets none.  `labelled` has urls with
    their verdicts; without it, the urls that the list judges are the labels.  Null urls and urls without "://"
    have an empty host and path, no tokens, and mining.otherwise.  Repeated rows and null keys are kept, the
    tokens of a url of any length count, other columns are not looked at, and an empty table gives no rows.
    """
    urls = pages.select(F.col(key), F.col("url").cast("string").alias("url"))
    rule = listed_rule(host_of(F.col("url")), path_of(F.col("url")), listed)
    if labelled is None:
        labelled = urls.withColumn("rule", rule).where(F.col("rule").isNotNull()).select("url", F.col("rule.verdict").alias("verdict"))
    rules = mine(labelled, mining)
    mined = F.when(F.col("rule").isNull(), F.col("best"))
    by_method = F.when(mined.isNull(), F.lit(mining.otherwise)).otherwise(F.when(mined["blocks"], F.lit(BLOCK)).otherwise(F.lit(ALLOW)))
    return (match(urls, rules, key, mining)
            .withColumn("rule", rule)
            .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select(key, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                    F.col("rule.name").alias("rule"), F.coalesce(F.col("rule.verdict"), by_method).alias("verdict"),
                    mined["combination"].alias("combination"), mined["confidence"].alias("confidence")))
