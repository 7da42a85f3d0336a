"""Operator 3: quality rules as a bitmask ledger.

Each rule is evaluated once per document: the ledger holds the measurements
and one long whose bit i says that rule i failed.  A policy is a mask of
rules; applying one, comparing versions and ablating rules are bitwise
operations on the ledger and never read a text again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel
from .common import mapped, table

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower")

#: Rule i fails where the expression over MEASURES holds; the ledger's bit i.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("many_words", "n_words > 1000000"),
    ("short_words", "10 * word_chars < 25 * n_words"),
    ("long_words", "10 * word_chars > 150 * n_words"),
    ("symbols", "100 * n_symbols > 30 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("capitals", "100 * n_upper > 60 * (n_upper + n_lower)"),
)


def mask(*names: str) -> int:
    at = {name: i for i, (name, _) in enumerate(RULES)}
    return sum(1 << at[n] for n in names)


#: Versioned policies: a document is kept where no rule of the mask failed.
POLICIES = {
    "base": mask("few_words", "repeated_words"),
    "v1": mask("few_words", "repeated_words", "symbols", "capitals"),
    "v2": mask(*(name for name, _ in RULES)),
}

_CLASS = np.zeros(256, np.uint8)  # 1 symbol, 2 upper, 4 lower, 8 a code point's first byte in a word
_CLASS[list(b"#*$%&|<>")] = 1
_CLASS[65:91] = 2
_CLASS[97:123] = 4
_CLASS |= 8
_CLASS[0x80:0xC0] = 0
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_BLANK = " \t\n\x0b\x0c\r"


def _repeated(g: np.ndarray) -> int:
    """Words covered by 3-word windows (hashes in text order) that occur twice or more."""
    _, inverse, n = np.unique(g, return_inverse=True, return_counts=True)
    at = np.flatnonzero(n[inverse] > 1)
    return len(np.unique(np.concatenate([at, at + 1, at + 2])))


def _measured(batch: pa.RecordBatch) -> list[np.ndarray]:
    data, offsets = kernel.buffers(batch.column("text"))
    _, _, h, at = kernel.words(data, offsets, lower=False)
    n_words = np.diff(at)
    repeat = np.array([_repeated(g) if n > 2 else 0 for g, n in zip(kernel.grams(h, at, 3), n_words, strict=True)], np.int64)
    counts = np.zeros((4, len(n_words)), np.int64)
    lines = np.zeros((2, len(n_words)), np.int64)
    raw = data.tobytes()
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        seen = _CLASS[data[a:b]]
        counts[:, i] = [np.count_nonzero(seen & x) for x in (8, 1, 2, 4)]
        own = [x for x in raw[a:b].decode("utf-8", "surrogateescape").split("\n") if x.strip(_BLANK)]
        lines[:, i] = len(own), len(own) - len(set(own))
    return [n_words, counts[0], counts[1], lines[1], repeat, lines[0], counts[2], counts[3]]


def measure(docs: DataFrame) -> DataFrame:
    """Replace ``text`` by MEASURES, all other columns unchanged; one pass, no shuffle.

    A null text counts as empty: all measurements 0.  Rows are judged one by
    one, so repeated rows and ids get equal results.  A column named like a
    measurement is replaced.
    """
    docs = docs.drop(*MEASURES)
    keep = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(x, pa.int64()) for x in _measured(batch))], [*keep, *MEASURES])

    return mapped(docs, run, T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(m, T.LongType()) for m in MEASURES)]))


def ledger(docs: DataFrame) -> DataFrame:
    """The measured documents with ``failures``: bit i is set where rule i fails."""
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(0).cast("long") for i, (_, rule) in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs).withColumn("failures", total)


def apply_policy(rows: DataFrame, policy: str, column: str = "kept") -> DataFrame:
    """Add whether the policy keeps each ledger row."""
    return rows.withColumn(column, F.col("failures").bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0)


def ablations(rows: DataFrame) -> DataFrame:
    """Per policy and rule: documents it fails, those failed by it alone, and kept without it.

    The ledger is first counted by its failure mask (at most 2^rules rows
    leave each task), so the cost does not follow rules x policies x rows.
    """
    masks = rows.groupBy("failures").agg(F.count("*").alias("n"))
    spark = rows.sparkSession
    grid = spark.createDataFrame([(p, m, name, 1 << i) for p, m in POLICIES.items() for i, (name, _) in enumerate(RULES) if m >> i & 1], "policy string, mask long, rule string, bit long")
    both = masks.join(F.broadcast(grid))  # a constant grid against at most 2^rules masks
    hit = F.col("failures").bitwiseAND(F.col("mask"))
    without = F.col("failures").bitwiseAND(F.col("mask").bitwiseXOR(F.col("bit")))
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).alias
    return both.groupBy("policy", "rule").agg(count(hit.bitwiseAND(F.col("bit")) != 0)("failed"), count(hit == F.col("bit"))("failed_alone"), count(hit == 0)("kept"), count(without == 0)("kept_without"))


def op3_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all documents, per policy and rule: what it fails, fails alone, what the policy keeps, and keeps without the rule."""
    return ablations(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ledger row: measurements, failure bits and verdicts; a null text counts as empty."""
    rows = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = apply_policy(rows, "v2").withColumn("base_failed", F.col("failures").bitwiseAND(F.lit(POLICIES["base"]).cast("long")) != 0)
    return rows.select("doc_id", *MEASURES[:5], "base_failed", "kept", "failures", *MEASURES[5:])


SQL3 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM (
        SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM l))),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY doc_id),
m AS (SELECT l.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
        len(regexp_extract_all(t, '[A-Z]'))::BIGINT AS n_upper, len(regexp_extract_all(t, '[a-z]'))::BIGINT AS n_lower
      FROM l LEFT JOIN r ON l.doc_id = r.doc_id),
f AS (SELECT *, (@BITS)::BIGINT AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 AS base_failed, failures = 0 AS kept,
       failures, n_lines, n_upper, n_lower FROM f
""".replace("@BITS", " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, (_, rule) in enumerate(RULES)))

SQL3_ABLATIONS = f"""
WITH l AS ({SQL3}), p(policy, mask) AS (VALUES {", ".join(f"('{p}', {m})" for p, m in POLICIES.items())}), r(rule, bit) AS (VALUES {", ".join(f"('{name}', {1 << i})" for i, (name, _) in enumerate(RULES))})
SELECT policy, rule, count(*) FILTER (WHERE failures & mask & bit <> 0) AS failed, count(*) FILTER (WHERE failures & mask = bit) AS failed_alone,
count(*) FILTER (WHERE failures & mask = 0) AS kept, count(*) FILTER (WHERE failures & (mask - bit) = 0) AS kept_without FROM l, p, r WHERE mask & bit <> 0 GROUP BY policy, rule
"""
