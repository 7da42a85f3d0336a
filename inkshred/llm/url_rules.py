"""Operator 2: URL filtering by mined association rules, on DataFrame functions alone.

Labelled pages become baskets of URL tokens plus their label; Spark's FP-growth
mines the frequent combinations.  Rules "tokens => bad" stay if their
confidence, support and lift suffice and no shorter rule says the same, and
are matched through an inverted index: token -> rules, a rule fires where all
its tokens met.  Given host and path rules come first, the longest wins.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, table, written

#: (action, rule): a host with all its subdomains and the beginning of the path.
GIVEN = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "label:bad"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def given_rule(host: Column, path: Column, rules: tuple = GIVEN) -> Column:
    """struct(length, rule, action) of the longest given rule that fits, else null."""
    each = F.array(*(F.struct(F.lit(len(r)).alias("length"), F.lit(r).alias("rule"), F.lit(a).alias("action"), F.lit(r.split("/", 1)[0]).alias("host"), F.lit("/" + r.split("/", 1)[1]).alias("path")) for a, r in rules))
    fits = F.filter(each, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    return F.array_max(fits)


def tokens(url: Column) -> Column:
    """Distinct URL tokens: scheme, host labels, path words, file ending, query pairs and fragment; numbers are left out."""
    host, path = host_and_path(url)
    tail = F.coalesce(F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1), F.lit(""))
    fragment = F.coalesce(F.regexp_extract(url, r"#(.*)$", 1), F.lit(""))
    named = lambda kind, parts: F.transform(F.filter(parts, lambda x: (x != "") & ~x.rlike(r"^[0-9]+$")), lambda x: F.concat(F.lit(kind + ":"), x))
    every = F.concat(
        named("scheme", F.array(F.coalesce(F.regexp_extract(url, r"^([A-Za-z]+)://", 1), F.lit("")))),
        named("host", F.split(host, r"[.:]")),
        named("word", F.split(path, r"[/._-]")),
        named("query", F.split(tail, "&")),
        named("fragment", F.array(fragment)),
    )
    return F.array_distinct(every)


def _classes(baskets: DataFrame) -> DataFrame:
    """(item, rep, n): every token with the first by name of those that occur on the same pages, and how many pages those are; told apart by two hashes of the pages."""
    each = baskets.select("basket", F.explode("items").alias("item")).select("item", *(F.xxhash64(F.lit(i), "basket").alias(f"h{i}") for i in (1, 2)))
    pages = each.groupBy("item").agg(F.count("*").alias("n"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
    reps = pages.groupBy("n", "h1", "h2").agg(F.min("item").alias("rep"))
    return pages.join(reps, ["n", "h1", "h2"]).select("item", "rep", "n")


def mine(labelled: DataFrame, support: float = 0.002, confidence: float = 0.6, lift: float = 1.5, longest: int = 4, least: int = 5) -> DataFrame:
    """(rule_id, antecedent, alternatives, confidence, support) of the pruned rules towards "bad".

    labelled: url and bad (boolean; null teaches nothing).  A combination is
    frequent on ``support`` of the pages, and on ``least`` of them.  Tokens that occur on
    the very same pages are one to the miner, as all combinations of m such
    tokens would be equally frequent, 2^m of them: the antecedent names the
    first of each, ``alternatives`` (one array for each) all of them, and any one of them
    will do.  Combinations of more than ``longest`` are not rules.  Empty
    without a labelled page.
    """
    spark = labelled.sparkSession
    known = labelled.filter("bad is not null and url is not null")
    baskets = written(known.select(F.monotonically_increasing_id().alias("basket"), tokens(F.col("url")).alias("items"), "bad"), "baskets")
    n = baskets.count()
    if not n:
        return spark.createDataFrame([], "rule_id long, antecedent array<string>, alternatives array<array<string>>, confidence double, support double")
    classes = written(_classes(baskets), "tokens")
    often = classes.filter((F.col("n") >= least) & (F.col("n") >= support * n)).select("item", "rep")
    merged = baskets.select("basket", "bad", F.explode("items").alias("item")).join(bounded(often, often.count()), "item").groupBy("basket", "bad").agg(F.array_sort(F.collect_set("rep")).alias("items"))
    rest = baskets.join(merged.select("basket"), "basket", "left_anti").select("basket", "bad", F.array().cast("array<string>").alias("items"))
    every = merged.unionByName(rest).select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=max(support, least / n), minConfidence=confidence).fit(every)
    rules = model.associationRules.filter((F.get("consequent", F.lit(0)) == BAD) & (F.col("lift") >= lift) & (F.size("antecedent") <= longest))
    rules = written(rules.select(F.xxhash64(F.array_sort("antecedent")).alias("rule_id"), F.array_sort("antecedent").alias("antecedent"), "confidence", "support"), "rules")
    # a rule with a proper part that is as sure adds nothing
    part = rules.select(F.col("rule_id").alias("part_id"), F.size("antecedent").alias("k"), F.col("confidence").alias("c"), F.explode("antecedent").alias("item"))
    whole = rules.select("rule_id", "confidence", F.size("antecedent").alias("n"), F.explode("antecedent").alias("item"))
    inside = whole.join(part, "item").filter("k < n and c >= confidence").groupBy("rule_id", "part_id", "k").count().filter("count = k")
    kept = rules.join(inside.select("rule_id").distinct(), "rule_id", "left_anti")
    same = classes.groupBy("rep").agg(F.array_sort(F.collect_list("item")).alias("same"))
    told = kept.select("rule_id", F.explode("antecedent").alias("rep")).join(same, "rep").groupBy("rule_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rep", "same"))), lambda x: x["same"]).alias("alternatives"))
    return kept.join(told, "rule_id").select("rule_id", "antecedent", "alternatives", "confidence", "support")


def fired(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, n_rules): distinct urls that meet at least one rule (a token of each of its alternatives), through the inverted index."""
    index = rules.select("rule_id", F.size("antecedent").alias("n"), F.posexplode("alternatives").alias("place", "same"))
    index = written(index.select("rule_id", "n", "place", F.explode("same").alias("item")), "index")
    met = urls.select("url").filter("url is not null").distinct().select("url", F.explode(tokens(F.col("url"))).alias("item"))
    met = met.join(bounded(index), "item").select("url", "rule_id", "n", "place").distinct().groupBy("url", "rule_id", "n").count().filter("count = n")
    return met.groupBy("url").agg(F.count("*").alias("n_rules"))


def judge(pages: DataFrame, labelled: DataFrame, given: tuple = GIVEN, **options) -> DataFrame:
    """Every page with host, path, rule, verdict (allow or block) and n_rules.

    A null url or one without ``://`` has empty host and path, no rule and is
    allowed.  Verdicts depend on the url alone, so repeated pages agree;
    columns of these names are replaced.
    """
    hits = fired(pages, mine(labelled, **options)).withColumnRenamed("url", "_url")
    pages = pages.drop("host", "path", "rule", "verdict", "n_rules")
    host, path = host_and_path(F.col("url"))
    p = pages.withColumn("host", host).withColumn("path", path).withColumn("_given", given_rule(F.col("host"), F.col("path"), given))
    p = p.join(hits, F.col("url") == F.col("_url"), "left")
    n = F.coalesce("n_rules", F.lit(0))
    verdict = F.coalesce(F.col("_given.action"), F.when(n > 0, "block").otherwise("allow"))
    return p.select(*pages.columns, "host", "path", F.col("_given.rule").alias("rule"), verdict.alias("verdict"), n.alias("n_rules"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the document its path is numbered by; it is bad where that is labelled of low quality or toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").filter("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    number = F.expr("try_cast(regexp_extract(url, '/([0-9]{1,18})[^0-9/]*/?([?#].*)?$', 1) as bigint)")
    labelled = pages.select("url", number.alias("doc_id")).join(labels, "doc_id").select("url", "bad")
    return judge(pages, labelled).select("page_id", "host", "path", "rule", "verdict", "n_rules")
