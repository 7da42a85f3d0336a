"""Operator 5: secret scanning by patterns and a battery of randomness tests.

Patterns give the base spans.  The method looks at every other long token: its
encoding (hex, base32, base64) is inferred from its characters, and under the
hypothesis "drawn uniformly from that alphabet" it gets p values of a
chi-squared test of uniformity, a Wald-Wolfowitz runs test about the middle of
the alphabet and a lag-1 serial correlation, combined by Bonferroni.  Words,
paths and identifiers have tiny p values.  Benjamini-Hochberg within each
stratum of encoding and length class chooses, from histograms of p, which
tokens are dismissed as structured, so that at most ``fdr`` of the dismissed
are random in expectation.

What is reported is controlled too.  A model of the corpus' own text, counts of
neighbouring characters in all of its shorter words, gives every token a second
p value, under the hypothesis "made as words are" (its likelihood against mean
and spread of the words').  Benjamini-Hochberg in the same strata chooses the
tokens that are not, so that at most ``fdr`` of them are text in expectation.
``random`` spans are the tokens that pass both: not shown to be structured, and
shown not to be text.

Everything is DataFrame expressions: offsets come from splitting a text at
the matches and summing lengths.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import carried, table, text_key, written

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are maximal, so asking for the length in the pattern drops the same matches as filtering after it.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
ALPHABET = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Characters of the text model: others, a to z whatever their case, digits.
SYMBOLS = 28
#: Neighbouring characters a corpus must have for the text test to be applied.
LEAST_PAIRS = 10000

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def spans(text: Column, pattern: str, kind: int, keep: Column | None = None) -> Column:
    """array<struct<start, kind, end>> of the leftmost non-overlapping matches, in code points.

    ``keep``: an array of booleans beside the matches; those with false are dropped.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.transform(found, F.length).alias("own"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(s: Column, x: Column) -> Column:
        a = s["at"] + x["gap"]
        return F.struct((a + F.coalesce(x["own"], F.lit(0))).alias("at"), F.when(x["own"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(a.alias("start"), F.lit(kind).alias("kind"), (a + x["own"]).alias("end"))))).alias("out"))

    out = F.aggregate(lengths, start, step, lambda s: s["out"])
    if keep is not None:
        out = F.filter(out, lambda x, i: F.get(keep, i))
    return F.when(text.rlike(pattern), out).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    long_value = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 12)
    return F.array_sort(F.concat(spans(text, ASSIGN, 0, long_value), spans(text, ACCESS, 1), spans(text, HEX, 2)))


def normal_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal (Abramowitz and Stegun 26.2.17, |error| < 1e-7; the tail kept positive)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-a * a / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def randomness(tokens: DataFrame, column: str = "token") -> DataFrame:
    """Add encoding, p_chi2, p_runs, p_serial and p (their Bonferroni combination) to tokens."""
    core = F.translate(F.regexp_replace(column, "=+$", ""), "-_=", "+/")
    t = tokens.withColumn("_core", core)
    hexed = F.col("_core").rlike("^([0-9a-f]+|[0-9A-F]+)$")
    t = t.withColumn("encoding", F.when(hexed, "hex").when(F.col("_core").rlike("^[A-Z2-7]+$"), "base32").otherwise("base64"))
    t = t.withColumn("_core", F.when(hexed, F.lower("_core")).otherwise(F.col("_core")))
    alphabet = F.when(F.col("encoding") == "hex", F.lit(ALPHABET["hex"])).when(F.col("encoding") == "base32", F.lit(ALPHABET["base32"])).otherwise(F.lit(ALPHABET["base64"]))
    t = t.withColumn("_a", F.length(alphabet).cast("double"))
    t = t.withColumn("_x", F.transform(F.filter(F.split("_core", ""), lambda c: c != ""), lambda c: (F.instr(alphabet, c) - 1).cast("double")))
    t = t.withColumn("_n", F.size("_x").cast("double"))
    add = lambda s, x: s + x
    zero = F.lit(0.0)
    # chi-squared against the uniform law, through Wilson and Hilferty's cube root
    squares = F.aggregate(F.array_distinct("_x"), zero, lambda s, d: s + F.pow(F.size(F.filter("_x", lambda x: x == d)).cast("double"), F.lit(2.0)))
    t = t.withColumn("_chi2", squares * F.col("_a") / F.col("_n") - F.col("_n"))
    dof = F.col("_a") - 1
    v = 2 / (9 * dof)
    t = t.withColumn("p_chi2", normal_tail((F.cbrt(F.greatest(F.col("_chi2"), zero) / dof) - (1 - v)) / F.sqrt(v)))
    # runs above and below the alphabet's middle
    t = t.withColumn("_up", F.transform("_x", lambda x: x >= F.col("_a") / 2))
    pairs = F.arrays_zip(F.slice("_up", 1, F.size("_up") - 1).alias("l"), F.slice("_up", 2, F.size("_up") - 1).alias("r"))
    t = t.withColumn("_runs", F.size(F.filter(pairs, lambda q: q["l"] != q["r"])).cast("double") + 1)
    t = t.withColumn("_n1", F.size(F.filter("_up", lambda x: x)).cast("double")).withColumn("_n0", F.col("_n") - F.col("_n1"))
    m = 2 * F.col("_n1") * F.col("_n0") / F.col("_n") + 1
    t = t.withColumn("_mean", m).withColumn("_var", (F.col("_mean") - 1) * (F.col("_mean") - 2) / (F.col("_n") - 1))
    one_sided = F.pow(F.lit(2.0), 1 - F.col("_n"))  # all on one side
    t = t.withColumn("p_runs", F.when(F.col("_var") > 0, 2 * normal_tail(F.abs(F.col("_runs") - F.col("_mean")) / F.sqrt(F.greatest(F.col("_var"), F.lit(1e-9))))).otherwise(one_sided))
    # serial correlation
    t = t.withColumn("_m", F.aggregate("_x", zero, add) / F.col("_n"))
    t = t.withColumn("_d", F.transform("_x", lambda x: x - F.col("_m")))
    steps = F.arrays_zip(F.slice("_d", 1, F.size("_d") - 1).alias("l"), F.slice("_d", 2, F.size("_d") - 1).alias("r"))
    t = t.withColumn("_cov", F.aggregate(steps, zero, lambda s, q: s + q["l"] * q["r"])).withColumn("_ss", F.aggregate("_d", zero, lambda s, x: s + x * x))
    t = t.withColumn("p_serial", F.when(F.col("_ss") > 0, 2 * normal_tail(F.abs(F.col("_cov") / F.greatest(F.col("_ss"), F.lit(1e-9))) * F.sqrt("_n"))).otherwise(one_sided))
    p = F.greatest(F.least(F.lit(1.0), 3 * F.least("p_chi2", "p_runs", "p_serial")), F.lit(1e-300))
    return t.withColumn("p", p).drop(*(c for c in t.columns if c.startswith("_")))


def _pairs(word: Column) -> Column:
    """The neighbouring characters of a word as numbers below SYMBOLS squared."""
    symbols = F.transform(F.filter(F.split(F.lower(word), ""), lambda c: c != ""), lambda c: F.when(c.rlike("[0-9]"), SYMBOLS - 1).otherwise(F.instr(F.lit(LETTERS), c)))
    return F.transform(F.array(symbols), lambda x: F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: a * SYMBOLS + b))[0]


def _likelihood(pairs: Column, weights: list[float]) -> Column:
    table = F.array(*map(F.lit, weights))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + F.get(table, x))


def text_model(docs: DataFrame) -> tuple[list[float], float, float] | None:
    """(log p of each character after another, their mean and spread per pair) over the words of all texts.

    Words are the runs of token characters that are too short for a token,
    counted once per word and weighted by their count; the driver gets a number
    for each pair of symbols.  None where the corpus has under LEAST_PAIRS.
    """
    words = docs.filter("text is not null").select(F.explode(F.split("text", "[^A-Za-z0-9+/_=-]+")).alias("word")).filter(F.length("word").between(2, 19))
    words = written(words.groupBy("word").agg(F.count("*").alias("n")), "words")
    counts = {r.pair: r.n for r in words.select("n", F.explode(_pairs(F.col("word"))).alias("pair")).groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    if sum(counts.values()) < LEAST_PAIRS:
        return None
    before = [sum(counts.get(a * SYMBOLS + b, 0) for b in range(SYMBOLS)) for a in range(SYMBOLS)]
    weights = [math.log((counts.get(a * SYMBOLS + b, 0) + 0.5) / (before[a] + 0.5 * SYMBOLS)) for a in range(SYMBOLS) for b in range(SYMBOLS)]
    mean = sum(counts.get(i, 0) * w for i, w in enumerate(weights)) / sum(counts.values())
    k = F.length("word") - 1
    off = _likelihood(_pairs(F.col("word")), weights) - k * mean
    spread = words.agg((F.sum(F.col("n") * F.pow(off, 2)) / F.sum(F.col("n") * k)).alias("v")).first().v
    return weights, mean, math.sqrt(max(spread, 1e-6))


def texture(tokens: DataFrame, model: tuple[list[float], float, float], column: str = "token") -> DataFrame:
    """Add p_text: how likely a word made as the corpus' words are would be as unlikely as the token."""
    weights, mean, spread = model
    k = F.length(column) - 1
    z = (_likelihood(_pairs(F.col(column)), weights) - k * mean) / (spread * F.sqrt(k.cast("double")))
    return tokens.withColumn("p_text", F.greatest(F.least(F.lit(1.0), normal_tail(-z)), F.lit(1e-300)))


def rejected_from(tokens: DataFrame, fdr: float, level: str = "level") -> DataFrame:
    """(encoding, length_class, start): per stratum the -log p level from which Benjamini-Hochberg rejects.

    p is counted in 400 levels of -10 ln p (each taken at its largest p, so the
    rate is kept); a stratum's window has 400 rows whatever the corpus.
    """
    counts = tokens.groupBy("encoding", "length_class", F.col(level).alias("level")).agg(F.count("*").alias("n"))
    of = Window.partitionBy("encoding", "length_class")
    rank = F.sum("n").over(of.orderBy(F.desc("level")))
    passed = counts.select("encoding", "length_class", "level", (F.exp(-F.col("level") / 10.0) <= fdr * rank / F.sum("n").over(of)).alias("ok"))
    return passed.filter("ok").groupBy("encoding", "length_class").agg(F.min("level").alias("start"))


def _level(p: str) -> Column:
    return F.least(F.floor(-10 * F.ln(p)), F.lit(400)).cast("int")


def random_spans(docs: DataFrame, fdr: float = 0.01) -> DataFrame:
    """(k1, k2, found): per text the spans of tokens outside its base spans that are not shown to be structured and shown not to be text.

    In a corpus too small for a text model only the first is asked.
    """
    texts = docs.filter(F.col("text").rlike(TOKEN)).select(*text_key(F.col("text")), "text")
    t = texts.select("k1", "k2", "text", base_spans(F.col("text")).alias("base"), F.explode(spans(F.col("text"), TOKEN, 3)).alias("s"))
    t = t.filter(~F.exists("base", lambda b: (b["start"] < F.col("s.end")) & (F.col("s.start") < b["end"])))
    t = t.select("k1", "k2", "s", F.expr("substring(text, s.start + 1, s.end - s.start)").alias("token"))
    t = t.groupBy("k1", "k2", "s").agg(F.first("token").alias("token"))  # a copied text counts once
    model = text_model(docs)
    t = texture(t, model) if model else t.withColumn("p_text", F.lit(None).cast("double"))
    t = randomness(t).withColumn("length_class", F.floor(F.log2(F.length("token"))).cast("int")).withColumn("level", _level("p")).withColumn("text_level", _level("p_text"))
    t = written(t.drop("token"), "tokens")
    of = ["encoding", "length_class"]
    kept = t.join(rejected_from(t, fdr).withColumnRenamed("start", "dismissed"), of, "left").filter("dismissed is null or level < dismissed")
    if model:
        kept = kept.join(rejected_from(t, fdr, "text_level").withColumnRenamed("start", "told"), of).filter("text_level >= told")
    return kept.groupBy("k1", "k2").agg(F.collect_list("s").alias("found"))


def scan(docs: DataFrame, fdr: float = 0.01) -> DataFrame:
    """Every row with ``base`` and ``found``: arrays of (start, kind, end), by start, then kind.

    Offsets are code points, end exclusive, kind an index into KINDS.  A null
    text has none.  Both are functions of the text, so copies agree; columns
    of these names are replaced, ``text`` itself is dropped.
    """
    docs = docs.drop("base", "found")
    names = docs.columns
    text = F.coalesce("text", F.lit(""))
    base = carried(docs, "text").select(*(f"in_{i}" for i, c in enumerate(names) if c != "text"), *text_key(F.col("text")), base_spans(text).alias("base"))
    both = base.join(random_spans(docs.select("text"), fdr), ["k1", "k2"], "left")
    found = F.array_sort(F.coalesce("found", F.array().cast(_SPAN)))
    return both.select(*(F.col(f"in_{i}").alias(c) for i, c in enumerate(names) if c != "text"), "base", found.alias("found"))


def _listed(column: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base spans, counted and digested, and all its spans; a null text counts as empty."""
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    every = F.array_sort(F.concat("base", "found"))
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(every).alias("spans"))
