"""Operator 1: language identification by prediction by partial matching (PPM).

Per language a tree of byte contexts (0 to ``depth`` bytes) with escape
probabilities of method C is frozen after training.  A text's code length in a
language is the sum over its bytes of -log2 p(byte | longest known context),
escaping to shorter contexts down to a uniform alphabet; the shortest code
names the language.

Training counts (context, byte) windows on a bounded sample of labelled texts
(``sample_bytes``; whole texts, drawn by a hash) as a grouped sum, and turns
them into code lengths on the executors.  The model holds what was seen as
sorted pairs of (context, byte) and language, no dense table of all.  Scoring
is one pass over the documents without a shuffle: the distinct windows of a
piece of a batch are looked up together in numpy, once per context length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel
from .common import bounded, carried, crc_of, mapped, named, table, written

#: Floats of one matrix [position, language] while scoring.
CELLS = 1 << 23


@dataclass
class Sparse:
    """Values of (key, language) pairs that training saw: those of keys[i] are at start[i] .. start[i + 1]."""

    keys: np.ndarray
    start: np.ndarray
    lang: np.ndarray
    bits: np.ndarray

    def of(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``asked``, language, bits) of every pair whose key is asked for."""
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        row = np.flatnonzero(self.keys[at] == asked)
        first = self.start[at[row]]
        n = self.start[at[row] + 1] - first
        pair = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        return np.repeat(row, n), self.lang[pair], self.bits[pair]


@dataclass
class Model:
    """Frozen statistics of all languages.

    levels[k]: code lengths of the escapes from contexts of k bytes, and of the
    symbols seen after them (key: context and symbol).
    """

    langs: list[str]
    levels: list[tuple[Sparse, Sparse]]

    @property
    def depth(self) -> int:
        return len(self.levels) - 1

    def code_lengths(self, windows: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each window in each language, [window, lang]."""
        out = np.full((len(windows), len(self.langs)), np.log2(256.0), np.float32)  # the uniform alphabet
        for k, (escapes, symbols) in enumerate(self.levels):
            key = windows & windows.dtype.type((1 << (8 * (k + 1))) - 1)
            row, lang, bits = escapes.of(key >> windows.dtype.type(8))
            out[row, lang] += bits
            row, lang, bits = symbols.of(key)
            out[row, lang] = bits
        return out


def _keys(data: np.ndarray, offsets: np.ndarray, a: int, b: int, depth: int) -> np.ndarray:
    """For positions a..b the byte there (lowest 8 bits) and the ``depth`` ones before; 0 before the text's start."""
    at = np.arange(a, b)
    since = at - offsets[np.searchsorted(offsets, at, "right") - 1]
    key = data[a:b].astype(np.int64)
    for k in range(1, depth + 1):
        key |= np.where(since >= k, data[np.maximum(at - k, 0)], 0).astype(np.int64) << (8 * k)
    return key


def _counts(docs: DataFrame, depth: int) -> DataFrame:
    """(lang, window, n): how often each byte follows each context of ``depth`` bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in pc.unique(batch.column("lang")).to_pylist():
                own = batch.filter(pc.equal(batch.column("lang"), lang))
                data, offsets = kernel.buffers(pc.utf8_lower(own.column("text")))
                for a in range(0, len(data), 1 << 20):
                    b = min(len(data), a + (1 << 20))
                    key, n = np.unique(_keys(data, offsets, a, b, depth), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key), pa.array(n.astype(np.int64))], ["lang", "window", "n"])

    return mapped(docs.select("lang", "text"), count, "lang string, window long, n long").groupBy("lang", "window").agg(F.sum("n").alias("n"))


def _code_lengths(counts: DataFrame, depth: int) -> DataFrame:
    """(k, key, lang, bits, escape) in order: code length of a symbol after its context of k bytes, and that of the escape from there."""
    kinds = F.array(*(F.struct(F.lit(k).alias("k"), F.col("window").bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1)).alias("key")) for k in range(depth + 1)))
    each = counts.select("lang", F.explode(kinds).alias("x"), "n").groupBy("lang", "x.k", "x.key").agg(F.sum("n").alias("n"))
    context = Window.partitionBy("lang", "k", F.shiftright("key", 8))  # at most 256 rows
    total, distinct = F.sum("n").over(context), F.count("*").over(context)
    bits = -F.log2(F.col("n") / (total + distinct))
    escape = -F.log2(distinct / (total + distinct))
    return each.select("k", "key", "lang", bits.cast("float").alias("bits"), escape.cast("float").alias("escape")).orderBy("k", "key", "lang")


def _pack(key: np.ndarray, lang: np.ndarray, bits: np.ndarray, depth: int) -> Sparse:
    """Sorted pairs with their keys once each."""
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return Sparse(key[first].astype(_key_type(depth)), np.append(first, len(key)), lang, bits)


def _key_type(depth: int) -> type:
    return np.uint32 if depth <= 3 else np.int64


def train(docs: DataFrame, held_out: Column, depth: int = 3, sample_bytes: int = 1 << 24) -> Model | None:
    """Fit on a sample of about ``sample_bytes`` of the labelled texts with ``held_out`` false; None without any.

    Every language has an equal share of the bytes; whole texts are drawn by
    a hash of id and text, all of them where the share suffices.  A language
    is learned where a text of it is drawn.  Everything that the sample holds
    is kept, by (context, symbol) and language, so the model has at most
    depth + 1 such pairs for each byte of the sample.  ``depth``: 6 at most.
    """
    able = docs.filter(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    per = written(able.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size")), "languages")
    n = per.count()
    if not n:
        return None
    rates = bounded(per.filter("size > 0").select("lang", (F.lit(sample_bytes / n) / F.col("size")).alias("rate")), n)
    drawn = able.join(rates, "lang").filter(F.pmod(F.xxhash64(F.lit("ppm"), "doc_id", "text"), F.lit(1 << 30)) < F.col("rate") * (1 << 30))
    rows = _code_lengths(_counts(drawn, depth), depth).toArrow()
    if not rows.num_rows:
        return None
    names = rows.column("lang").combine_chunks().dictionary_encode()
    langs = sorted(names.dictionary.to_pylist())
    rank = {x: i for i, x in enumerate(langs)}
    lang = np.array([rank[x] for x in names.dictionary.to_pylist()], np.int32)[names.indices.to_numpy()]
    k, key, bits, escape = (rows.column(c).to_numpy() for c in ("k", "key", "bits", "escape"))
    levels = []
    for a, b in pairwise(np.searchsorted(k, np.arange(depth + 2))):
        context = (key[a:b] >> 8) * len(langs) + lang[a:b]
        known, first = np.unique(context, return_index=True)
        levels.append((_pack(known // len(langs), lang[a:b][first], escape[a:b][first], depth), _pack(key[a:b], lang[a:b], bits[a:b], depth)))
    return Model(langs, levels)


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each text in each language, [text, lang]; every distinct window of a piece is looked up once."""
    out = np.zeros((len(offsets) - 1, len(model.langs)))
    step = max(1 << 12, min(1 << 18, CELLS // len(model.langs)))
    for a in range(0, len(data), step):
        b = min(len(data), a + step)
        window, place = np.unique(_keys(data, offsets, a, b, model.depth).astype(_key_type(model.depth)), return_inverse=True)
        cost = model.code_lengths(window)[place]
        cuts = np.unique(np.concatenate([[a], offsets[(offsets > a) & (offsets < b)]]))
        owner = np.searchsorted(offsets, cuts, "right") - 1
        np.add.at(out, owner, np.add.reduceat(cost, cuts - a, axis=0, dtype=np.float64))
    return out


def identify(docs: DataFrame, model: Model | None, column: str = "text") -> DataFrame:
    """Add lang_pred, score and bits_per_byte to every row, from its whole text alone.

    ``und`` with score 0 where the text is null or has no letter (or nothing
    was learned).  score: posterior of the named language among the learned
    ones, all equally likely before.  Equal code lengths go to the language
    first by name.  ``column`` names the text; added columns replace those of
    the same name.
    """
    frozen = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score", "bits_per_byte")
    keep = docs.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = frozen.value
        for batch in batches:
            text = batch.column(column).cast(pa.string()).fill_null("")
            letters = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
            data, offsets = kernel.buffers(pc.utf8_lower(text))
            if m is None:
                pred, post, rate = [None] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows)
                letters = np.zeros(batch.num_rows, bool)
            else:
                bits = code_lengths(m, data, offsets)
                best = bits.argmin(1)
                low = bits.min(1, keepdims=True)
                post = 1.0 / np.exp2(np.maximum(low - bits, -1000.0)).sum(1)
                pred = [m.langs[i] for i in best]
                rate = low[:, 0] / np.maximum(np.diff(offsets), 1)
            added = [
                pa.array([p if y else "und" for p, y in zip(pred, letters, strict=True)], pa.string()),
                pa.array(np.where(letters, post, 0.0)),
                pa.array(np.where(letters, rate, 0.0)),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *added], [*keep, "lang_pred", "score", "bits_per_byte"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])
    return mapped(docs, score, schema)


def held_out(doc_id: Column) -> Column:
    return F.pmod(crc_of(doc_id), F.lit(3)) == 1


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those not held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, held_out(F.col("doc_id")))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def language_stage(docs: DataFrame, min_score: float = 0.3) -> DataFrame:
    """The rows whose language is told (not ``und``, score at least min_score), columns unchanged.

    Null texts and texts without letters go; rows without an id or language
    are judged like others, and repeated rows alike.  Columns may have any
    names; an empty table, or one without labels, keeps nothing.
    """
    model = train(docs, held_out(F.col("doc_id")))
    judged = identify(carried(docs), model, f"in_{docs.columns.index('text')}")
    return named(judged.filter((F.col("lang_pred") != "und") & (F.col("score") >= min_score)), docs.columns)
