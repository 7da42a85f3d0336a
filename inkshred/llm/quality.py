"""Operator 9: document quality by hierarchical empirical Bayes.

A logistic classifier of text measurements gives each document's own evidence.
Sites, the web hosts and paths of the pages that show a document, are a
hierarchy, global > host > path: every level's rate of good
documents is a Beta-Binomial posterior around the level above, with a prior
strength estimated from the spread of the groups (method of moments), so sparse
sites shrink towards their parents.  Rates are grouped sums (combined before
the shuffle); a document's own share is taken out of its site's before both
are added as log odds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .rules import MEASURES, measure
from .url_rules import host_and_path

#: Classifier inputs over the measurements of ``rules``.
INPUTS = {
    "length": "ln(n_words + 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "capitals": "n_upper / greatest(n_upper + n_lower, 1)",
    "line_words": "ln(n_words / greatest(n_lines, 1) + 1)",
}
#: What an unlabelled document's classifier probability counts beside a label.
SOFT = 0.25


def fit(labelled: DataFrame, ridge: float = 1.0) -> dict[str, float] | None:
    """Ridge logistic regression on the measured, labelled sample; None without both classes."""
    rows = labelled.select("good", *(F.expr(e).cast("double").alias(c) for c, e in INPUTS.items())).toPandas()
    if rows.good.nunique() < 2:
        return None
    x = rows[list(INPUTS)].to_numpy(float)
    mean, std = x.mean(0), np.maximum(x.std(0), 1e-6)
    x = np.concatenate([np.ones((len(x), 1)), (x - mean) / std], axis=1)
    y, w = rows.good.to_numpy(float), np.zeros(x.shape[1])
    shrink = np.r_[1e-6, np.full(len(INPUTS), ridge)]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), x.T @ (p - y) + shrink * w)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    out = dict(zip(INPUTS, (w[1:] / std).tolist(), strict=True))
    return {"": float(w[0] - (w[1:] / std) @ mean), **out}


def evidence(weights: dict[str, float] | None) -> Column:
    """The classifier's log odds as a JVM expression over the measurements, within +-6."""
    if weights is None:
        return F.lit(0.0)
    total = F.lit(weights[""])
    for c, e in INPUTS.items():
        total = total + F.lit(weights[c]) * F.expr(e).cast("double")
    return F.greatest(F.lit(-6.0), F.least(F.lit(6.0), total))


def _strength(groups: DataFrame, parent: Column) -> float:
    """Prior strength: mean(1-mean) over the between-group variance, less 1; within 1 to 10000."""
    got = groups.filter("n > 0").agg(F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - parent, 2)).alias("ss"), F.sum(parent * (1 - parent)).alias("noise"), F.sum("n").alias("n"), F.sum(F.col("n") * parent * (1 - parent)).alias("pq")).first()
    if not got.n:
        return 1.0
    between = max((got.ss - got.noise) / got.n, 1e-12)
    return float(min(1e4, max(1.0, got.pq / got.n / between - 1)))


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.ln(q / (1 - q))


def assess(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = 20000, sites: DataFrame | None = None) -> DataFrame:
    """doc_id, host, path, p_document, host_rate, path_rate, score and keep (score >= 0.5) of every row.

    labels: (doc_id, quality 0 or 1); several for a document count by their
    mean, nulls teach nothing.  The classifier is fitted on the whole texts of
    about ``sample`` labelled documents; rates use all documents.

    A row's site is in its columns ``host`` and ``path``, or, with ``sites``
    (doc_id, host, path), in any number of rows there.  A document counts once
    for each of its hosts and paths; its rates, and the log odds it gets from
    them, are the means over its sites, and the first site by code point is
    shown.  A document without a site has the global rate and no host.  Null hosts
    or paths are groups of their own; null and empty texts are judged by
    their measurements (all 0) and site.  Without labels all scores are 0.5.
    Rows that repeat an id are judged alike but counted each; an empty table
    gives an empty one.
    """
    own = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("label"))
    key = lambda c: F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(c).cast("string")))
    site = lambda df: df.select("doc_id", key(host).alias("_h"), key(path).alias("_p"), *(c for c in df.columns if c == "text"))
    m = measure(site(docs) if sites is None else docs.select("doc_id", "text"))
    m = written(m.join(own, "doc_id", "left"), "measured")
    n = m.filter("label is not null").count()
    drawn = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 30)) < min(1.0, sample / max(n, 1)) * (1 << 30)
    weights = fit(m.filter("label is not null").filter(drawn).withColumn("good", (F.col("label") >= 0.5).cast("int")))
    z = m.withColumn("z", evidence(weights)).drop(*MEASURES)
    z = z.withColumn("p_document", 1 / (1 + F.exp(-F.col("z")))).withColumn("n1", F.when(F.col("label").isNotNull(), 1.0).otherwise(F.lit(SOFT))).withColumn("s1", F.col("n1") * F.coalesce("label", "p_document"))
    at = host_at = z
    if sites is not None:
        z = written(z, "judged")
        links = written(site(sites.withColumnsRenamed({"host": host, "path": path})).filter("doc_id is not null").distinct(), "sites")
        at, host_at = (z.select("doc_id", "n1", "s1").join(x, "doc_id") for x in (links, links.select("doc_id", "_h").distinct()))
    paths = written(at.groupBy("_h", "_p").agg(F.sum("n1").alias("n"), F.sum("s1").alias("s")), "paths")
    total = z.agg(F.sum("n1").alias("n"), F.sum("s1").alias("s")).first()
    base = (total.s + 0.5) / (total.n + 1) if total.n else 0.5
    hosts = written(host_at.groupBy("_h").agg(F.sum("n1").alias("n"), F.sum("s1").alias("s")), "hosts")
    k_host = _strength(hosts, F.lit(base))
    hosts = hosts.select("_h", F.col("n").alias("hn"), F.col("s").alias("hs"))
    rates = paths.join(hosts, "_h")
    k_path = _strength(rates, (F.col("hs") + k_host * base) / (F.col("hn") + k_host))
    r = at.join(rates, ["_h", "_p"])
    r = r.withColumn("host_rate", (F.greatest(F.col("hs") - F.col("s1"), F.lit(0.0)) + k_host * base) / (F.greatest(F.col("hn") - F.col("n1"), F.lit(0.0)) + k_host))
    r = r.withColumn("path_rate", (F.greatest(F.col("s") - F.col("s1"), F.lit(0.0)) + k_path * F.col("host_rate")) / (F.greatest(F.col("n") - F.col("n1"), F.lit(0.0)) + k_path))
    r = r.withColumn("odds", _logit(F.col("path_rate")))
    if sites is not None:  # one row per document again: rows of equal id and share are judged alike
        r = r.groupBy("doc_id", "s1").agg(F.min(F.struct("_h", "_p")).alias("site"), *(F.avg(c).alias(c) for c in ("host_rate", "path_rate", "odds")))
        r = z.join(r, ["doc_id", "s1"], "left").select("doc_id", "z", "p_document", F.coalesce("site._h", F.lit("-")).alias("_h"), F.coalesce("site._p", F.lit("-")).alias("_p"), *(F.coalesce(c, x).alias(c) for c, x in (("host_rate", F.lit(base)), ("path_rate", F.lit(base)), ("odds", _logit(F.lit(base))))))
    score = 1 / (1 + F.exp(-(F.col("z") + F.col("odds") - _logit(F.lit(base)))))
    name = lambda c: F.when(F.col(c) == "-", F.lit(None)).otherwise(F.substring(c, 2, 1 << 30))
    return r.select("doc_id", name("_h").alias("host"), name("_p").alias("path"), "p_document", "host_rate", "path_rate", score.alias("score")).withColumn("keep", F.col("score") >= 0.5)


def page_sites(pages: DataFrame) -> DataFrame:
    """(doc_id, host, path) of the pages that show a document, the one their path is numbered by, as in operator 2.

    path is the folder the page is in: the numbered end names one document
    only, so whole paths would be groups of one.
    """
    number = F.expr("try_cast(regexp_extract(url, '/([0-9]{1,18})[^0-9/]*/?([?#].*)?$', 1) as bigint)")
    host, path = host_and_path(F.col("url"))
    return pages.select(number.alias("doc_id"), host.alias("host"), F.regexp_replace(path, r"[^/]*/?$", "").alias("path")).filter("doc_id is not null")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of ``documents`` are the hosts and paths of the ``pages`` that show them."""
    sites = page_sites(table(spark, sf_dir, "pages").select("url"))
    return assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality"), sites=sites)
