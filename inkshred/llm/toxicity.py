"""Operator 6: toxicity by Levenshtein automata over a lexicon trie.

The lexicon is learned: words whose presence marks labelled toxic documents,
and stems (word beginnings) that do, alone or repeated.  Its trie is intersected with Levenshtein automata (one edit from 4 letters on,
two from 8) into deterministic tables, one for each WORDS_EACH words and one of
all stems, and the distinct words of a batch run through each in lockstep, most
of them dying after a few letters.  Each hit is read in
its context: a window of words around it tells quotation (marks around it, a
verb of saying before it) from abuse.  A logistic model over hit counts by
distance and context, fitted on the labelled sample, gives the score.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel
from .common import crc_of, mapped, table, text_key, written

CODES = 0x110000
#: Words compiled into one table: its states grow faster than its words, so many words are many tables.
WORDS_EACH = 60
SEPARATORS = " \t\n\x0b\x0c\r.,!?;:()[]{}<>|/\\\"'«»“”„…*_~`&%#+=–—"
OPENING, CLOSING, EITHER = "«“„", "»”", "\""
#: Verbs of saying before a quotation, in the languages of the corpus.
SAYING = ("said", "says", "wrote", "called", "quoted", "sagte", "schrieb", "nannte", "dit", "écrit", "appelé", "dijo", "escribió", "llamó")
WINDOW = 8
FEATURES = ("exact", "one_edit", "two_edits", "stem", "weak_stem", "quoted", "words")
QUOTED = FEATURES.index("quoted")
_SEP = np.zeros(CODES, bool)
_SEP[[ord(c) for c in SEPARATORS]] = True


@dataclass
class Automaton:
    """The intersection as a table: step[state, letter class] -> state (0 dead, 1 start).

    accept[state]: what a word that ends here is, an index into FEATURES (the
    edits of a word, a stem, a weak stem) or 9; begun[state]: the same for
    words that go on, which only stems accept.
    """

    letters: list[int]
    step: np.ndarray
    accept: np.ndarray
    begun: np.ndarray

    @cached_property
    def letter(self) -> np.ndarray:
        """The class of every code point (0: no letter of the lexicon); built where it is used, not sent."""
        out = np.zeros(CODES, np.int16)
        out[self.letters] = np.arange(1, len(self.letters) + 1)
        return out


def allowed(word: str) -> int:
    return 0 if len(word) < 4 else 1 if len(word) < 8 else 2


def compile_lexicon(words: list[str], stems: list[str] = (), weak: list[str] = ()) -> Automaton:
    """Determinise (trie node, edits) sets; edits are insertion, deletion and substitution, stems take none."""
    nodes: list[dict[str, int]] = [{}]
    budget = [0]
    word_end: dict[int, int] = {}
    stem_end: dict[int, int] = {}
    for term, edits, kind in [*((w, allowed(w), None) for w in words), *((w, 0, 3) for w in stems), *((w, 0, 4) for w in weak)]:
        at = 0
        budget[0] = max(budget[0], edits)
        for c in term:
            if c not in nodes[at]:
                nodes[at][c] = len(nodes)
                nodes.append({})
                budget.append(0)
            at = nodes[at][c]
            budget[at] = max(budget[at], edits)
        if kind is None:
            word_end[at] = edits
        else:
            stem_end[at] = min(kind, stem_end.get(at, 9))
    letters = sorted({c for w in (*words, *stems, *weak) for c in w})

    def closed(state: dict[int, int]) -> tuple:
        todo = list(state.items())
        while todo:
            node, e = todo.pop()
            if node < 0 or state.get(node, 9) < e:
                continue
            for child in nodes[node].values():  # a letter of the word is missing
                if e + 1 <= budget[child] and e + 1 < state.get(child, 9):
                    state[child] = e + 1
                    todo.append((child, e + 1))
        return tuple(sorted(state.items()))

    start = closed({0: 0})
    index = {(): 0, start: 1}
    order = [(), start]
    rows = []
    while len(rows) < len(order):
        state = order[len(rows)]
        row = []
        for c in (None, *letters):
            after: dict[int, int] = {}
            for node, e in state:
                if node < 0:  # a stem has been read: whatever follows
                    after[node] = e
                    continue
                if e + 1 <= budget[node]:  # an extra letter
                    after[node] = min(after.get(node, 9), e + 1)
                for own, child in nodes[node].items():
                    cost = e + (own != c)
                    if cost <= budget[child]:
                        after[child] = min(after.get(child, 9), cost)
                        if cost == 0 and child in stem_end:
                            after[-stem_end[child]] = 0
            key = closed(after)
            if key not in index:
                index[key] = len(order)
                order.append(key)
            row.append(index[key])
        rows.append(row)
    begun = [min((-node for node, _ in s if node < 0), default=9) for s in order]
    accept = [min((e for node, e in s if e <= word_end.get(node, -1)), default=b) for s, b in zip(order, begun, strict=True)]
    return Automaton([ord(c) for c in letters], np.array(rows, np.int64), np.array(accept, np.int64), np.array(begun, np.int64))


def compile_parts(words: list[str], stems: list[str], weak: list[str]) -> list[Automaton]:
    """The lexicon as tables of bounded size; what a word is in the whole is the least of what it is in each."""
    words = sorted(words)
    return [compile_lexicon([], sorted(stems), sorted(weak)), *(compile_lexicon(words[i : i + WORDS_EACH]) for i in range(0, len(words), WORDS_EACH))]


def _distinct(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct word (by a 64-bit hash), and for each word its number among them."""
    up, down = kernel._powers(len(codes) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes + 1).astype(np.uint64) * up[:-1], dtype=np.uint64)])
    h = kernel.mix((total[ends] - total[starts]) * down[starts] ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    return first, number


def _hits(a: Automaton, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """What each word is: an index into FEATURES, 9 for nothing."""
    out = np.full(len(starts), 9, np.int64)
    stays = (a.step == np.arange(len(a.step))[:, None]).all(1)  # nothing changes any more
    live = np.arange(len(starts))
    state = np.ones(len(live), np.int64)
    left = ends - starts
    at = starts
    while len(live):
        done = left == 0
        out[live[done]] = a.accept[state[done]]
        stop = ~done & stays[state]
        out[live[stop]] = a.begun[state[stop]]
        more = ~done & ~stop
        live, state, left, at = live[more], state[more], left[more], at[more]
        state = a.step[state, a.letter[codes[at]]]
        left, at = left - 1, at + 1
    return out


def _features(automata: list[Automaton], texts: pa.Array) -> np.ndarray:
    """[text, FEATURES]: hits by kind outside quotation, hits inside, words."""
    rows = pc.utf8_lower(texts.fill_null("")).to_pylist()
    out = np.zeros((len(rows), len(FEATURES)))
    first = 0
    while first < len(rows):
        last, size = first, 0
        while last < len(rows) and (last == first or size + len(rows[last]) < 1 << 19):
            size += len(rows[last]) + 1
            last += 1
        raw = np.frombuffer("\n".join(rows[first:last]).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = raw.astype(np.int64)
        solid = ~_SEP[codes]
        edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        one, number = _distinct(codes, starts, ends)
        hits = np.minimum.reduce([_hits(a, codes, starts[one], ends[one]) for a in automata])[number]
        cuts = np.cumsum([0, *(len(r) + 1 for r in rows[first:last])])
        out[first:last, -1] = np.diff(np.searchsorted(starts, cuts))
        for w in np.flatnonzero(hits < 9):
            i = int(np.searchsorted(cuts, starts[w], "right")) - 1
            text, lo = rows[first + i], int(cuts[i])
            left = max(lo, int(starts[max(0, w - WINDOW)])) - lo
            right = min(int(cuts[i + 1]) - 1, int(ends[min(len(ends) - 1, w + WINDOW)])) - lo
            quoted = in_quotation(text[left : int(starts[w]) - lo], text[int(ends[w]) - lo : right])
            out[first + i, QUOTED if quoted else hits[w]] += 1
        first = last
    return out


def in_quotation(before: str, after: str) -> bool:
    """Whether a hit between these context windows is quoted: marks open before and close after, or a verb of saying and a mark before it."""
    opened = before.count(EITHER) % 2 == 1 or any(before.rfind(c) > max(map(before.rfind, CLOSING)) for c in OPENING)
    closes = EITHER in after or any(c in after for c in CLOSING)
    said = any(w.strip(SEPARATORS) in SAYING for w in before.split()[-4:])
    return opened and (closes or said)


@dataclass
class Model:
    automata: list[Automaton]
    weights: np.ndarray
    words: list[str]
    stems: list[str]
    weak: list[str]


def _saturated(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(x), 1)), np.log1p(x)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Ridge logistic regression by Newton steps on the bounded sample (the intercept is not shrunk)."""
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + shrink * w
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), grad)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


def twins(own: dict[str, set[int]]) -> set[str]:
    """The words that share their documents with another (Jaccard 3/4 or more).

    Such words share a document among the leading quarter of each, documents
    of few words first (prefix filter).  A word is compared until it and all
    that stand by it are known to have a twin, so a large family of copies
    needs no comparison of all its pairs.
    """
    load = Counter(x for docs in own.values() for x in docs)
    known, unknown, out = defaultdict(list), defaultdict(set), set()

    def alike(v: str, w: str) -> bool:
        both = len(own[v] & own[w])
        return 4 * both >= 3 * (len(own[v]) + len(own[w]) - both)

    leading = lambda w: sorted(own[w], key=lambda x: (load[x], x))[: len(own[w]) // 4 + 1]
    for w in sorted(own, key=lambda w: (len(own[w]), w)):
        lead = leading(w)
        near = {v for v in set().union(*(unknown[x] for x in lead)) if alike(v, w)}
        tried: set[str] = set()
        if near or any(v not in tried and (tried.add(v) or alike(v, w)) for x in lead for v in known[x]):
            near.add(w)
        out |= near
        for v in near:
            for x in leading(v):
                unknown[x].discard(v)
                known[x].append(v)
        if w not in near:
            for x in lead:
                unknown[x].add(w)
    return out


def _cover(left: dict[tuple[str, str], set[int]], covered: set[int], least: int = 3) -> list[tuple[str, str]]:
    """(kind, term), greedily: the one that marks the most unmarked documents, while it marks ``least``.

    What a term adds only falls, so its last count is a bound, and only the
    first of the heap is counted again.
    """
    order = lambda k, new: (-new, k[0] != "stem", len(k[1]), [-ord(c) for c in k[1]], k)
    heap = [order(k, len(d)) for k, d in left.items()]
    heapq.heapify(heap)
    out = []
    while heap:
        top = heapq.heappop(heap)
        new = left[top[-1]] - covered
        if len(new) < least:
            continue
        if len(new) < -top[0]:
            heapq.heappush(heap, order(top[-1], len(new)))
            continue
        out.append(top[-1])
        covered = covered | new
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = 8000) -> Model | None:
    """Fit on the whole texts of at most about ``sample`` labelled documents (drawn by a hash of the id).

    A document with several labels counts as toxic if any says so; null labels
    and ids teach nothing.  Terms are counted over distinct texts; one whose
    copies are labelled differently is toxic if half of them are.  A term is a
    word, a stem of 4 to 7 letters, or a stem used three times (weak) of whose
    texts at least 90 % are toxic, in more of them than chance would give any
    term; every such word is kept, however many there are.  Only words that
    share their texts with another (Jaccard 3/4 or more) are the vocabulary of
    a family of near copies and stay out; stems are added one by one while
    they mark three texts that nothing marks yet.  None without both kinds of
    document.
    """
    spark = docs.sparkSession
    own = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = own.count()
    drawn = own.filter(F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1 << 30)) < min(1.0, sample / max(n, 1)) * (1 << 30))
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").filter("text is not null")  # bounded by ``sample``
    if len(texts.select("toxic").distinct().head(2)) < 2:
        return None
    k1, k2 = text_key(F.col("text"))
    each = written(texts.groupBy(k1, k2).agg(F.first("text").alias("text"), (2 * F.avg("toxic") >= 1).cast("int").alias("toxic")).drop("k2"), "texts")
    size = {r.toxic: r.n for r in each.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    apart = "[" + "".join("\\" + c if not c.isspace() else f"\\x{ord(c):02x}" for c in SEPARATORS) + "]+"
    words = F.filter(F.split(F.lower("text"), apart), lambda w: F.length(w).between(3, 40))
    used = each.select("k1", "toxic", F.explode(words).alias("word")).groupBy("k1", "toxic", "word").count()
    used = written(used, "words")
    stem = [F.when(F.length("word") > k, F.struct(F.lit(True).alias("stem"), F.substring("word", 1, k).alias("term"))) for k in range(4, 8)]
    each = used.select("k1", "toxic", "count", F.explode(F.array_compact(F.array(F.struct(F.lit(False).alias("stem"), F.col("word").alias("term")), *stem))).alias("x"))
    per = each.groupBy("x.stem", "x.term", "k1", "toxic").agg(F.sum("count").alias("times"))
    per = per.select("k1", "toxic", "term", F.explode(F.when(F.col("stem"), F.when(F.col("times") > 2, F.array(F.lit("stem"), F.lit("weak"))).otherwise(F.array(F.lit("stem")))).otherwise(F.array(F.lit("word")))).alias("kind"))
    per = written(per, "terms")
    # so many toxic texts that no term would have them by chance
    vocabulary = used.agg(F.approx_count_distinct("word")).first()[0]
    toxic, total = size.get(1, 0), sum(size.values())
    least = max(3, math.ceil(math.log(20 * max(vocabulary, 1)) / math.log(total / toxic))) if 0 < toxic < total else 3
    pure = per.groupBy("kind", "term").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).filter(f"t >= {least} and 10 * t >= 9 * n")
    rows = per.filter("toxic = 1").join(pure.select("kind", "term"), ["kind", "term"]).groupBy("kind", "term").agg(F.collect_set("k1").alias("texts")).toArrow()  # keys of the bounded sample
    lists = rows["texts"].combine_chunks()
    number = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)[1].tolist()
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).tolist()
    marks = {k: set(number[a:b]) for k, a, b in zip(zip(rows["kind"].to_pylist(), rows["term"].to_pylist(), strict=True), [0, *ends], ends, strict=False)}
    own_words = {w: d for (kind, w), d in marks.items() if kind == "word"}
    found: dict[str, list[str]] = {"word": sorted(own_words.keys() - twins(own_words)), "stem": [], "weak": []}
    covered = set().union(*(own_words[w] for w in found["word"]))
    for kind, term in _cover({k: d for k, d in marks.items() if k[0] != "word"}, covered):
        found[kind].append(term)
    automata = compile_parts(found["word"], found["stem"], found["weak"])
    sent = spark.sparkContext.broadcast(automata)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _features(sent.value, b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("toxic"), *(pa.array(x[:, i]) for i in range(len(FEATURES)))], ["toxic", *FEATURES])

    got = mapped(texts.select("toxic", "text"), run, "toxic int, " + ", ".join(f"{f} double" for f in FEATURES)).groupBy("toxic", *FEATURES).count().toPandas()
    x = np.repeat(got[list(FEATURES)].to_numpy(float), got["count"].to_numpy(), axis=0)
    y = np.repeat(got["toxic"].to_numpy(float), got["count"].to_numpy())
    return Model(automata, _logistic(_saturated(x), y), *map(sorted, (found["word"], found["stem"], found["weak"])))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """Add score, hits and quoted to every row from its text alone; one pass, no shuffle.

    Null and empty texts score as texts without a hit (without a model: 0).
    Columns of these names are replaced, others kept.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score", "hits", "quoted")
    keep = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            x = np.zeros((b.num_rows, len(FEATURES))) if m is None else _features(m.automata, b.column("text"))
            p = np.zeros(b.num_rows) if m is None else 1 / (1 + np.exp(-np.clip(_saturated(x) @ m.weights, -30, 30)))
            added = [pa.array(p), pa.array(x[:, :QUOTED].sum(1).astype(np.int64)), pa.array(x[:, QUOTED].astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *added], [*keep, "score", "hits", "quoted"])

    return mapped(docs, run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("hits", T.LongType()), T.StructField("quoted", T.LongType())]))


def held_out(doc_id: Column) -> Column:
    return F.pmod(crc_of(doc_id), F.lit(5)) == 0


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, learned from the labels not held out; a null text scores as an empty one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    out = score(docs, train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits", "quoted")
