"""Each operator on small tables with the hard cases, held against plain Python."""

import collections
import hashlib
import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from oracle import check
from pyspark.sql import functions as F

from inkshred.llm import centroids, common, decontaminate, fim, kernel, langid, mixing, ngram_join, quality, queries, rules, secrets, shards, token_counts, toxicity, url_rules
from inkshred.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, extra string"
WORDS = [f"w{i}" for i in range(400)]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def hard_docs(seed=1):
    """Nulls in every column, empty and wordless texts, repeated rows, ties, copies and near copies, one long text."""
    r = random.Random(seed)
    base = [" ".join(r.choice(WORDS) for _ in range(r.choice([1, 3, 5, 30, 80]))) for _ in range(40)]
    rows = [(i, t, r.choice(["a", "b", None]), r.choice(["s1", "s2", "s3", None]), "x") for i, t in enumerate(base)]
    for i in range(60):
        w = base[r.randrange(40)].split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        rows.append((100 + i, " ".join(w).replace(" ", "\n", 1) if i % 2 else " ".join(w).upper(), "a", "s1", None))
    rows += [(300, None, "a", "s1", "x"), (301, "", None, None, None), (302, " \n\t", "b", "s2", "x"), (None, base[3], "a", "s1", "x"), (None, "nobody else says this at all", None, None, None), (None, None, None, None, None)]
    rows += [rows[4], rows[4], (305, " ".join(r.choice(WORDS) for _ in range(30000)), "b", "s3", "x")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(hard_docs(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    check(spark, queries.QUERIES[name], queries.SQL[name], DATA)


def test_word_kernel(monkeypatch):
    monkeypatch.setattr(kernel, "BLOCK", 50)
    r = random.Random(1)
    for t in range(200):
        texts = [None if (t + i) % 7 == 0 else "".join(r.choice("ab cé\n\tXy ") for _ in range(r.choice([0, 1, 5, 40, 300]))) for i in range(r.randint(0, 8))]
        data, offsets = kernel.buffers(pa.array(texts, pa.string()))
        s, e, h, at = kernel.words(data, offsets)
        assert [[bytes(data[a:b]).decode() for a, b in zip(s[x:y], e[x:y], strict=True)] for x, y in zip(at[:-1], at[1:], strict=True)] == [words(x) for x in texts]
        named = collections.defaultdict(set)
        for w, k in zip([re.sub("[A-Z]", lambda m: m[0].lower(), w) for x in texts for w in words(x)], h, strict=True):
            named[w].add(int(k))
        assert all(len(v) == 1 for v in named.values()) and len({x for v in named.values() for x in v}) == len(named)


def test_shared_folder_is_never_guessed_on_a_cluster():
    class Cluster:
        conf = {}
        master = "spark://host:7077"

    Cluster.sparkContext = Cluster
    with pytest.raises(ValueError):
        common.shared_dir(Cluster)
    Cluster.conf = {"spark.checkpoint.dir": "hdfs://x/"}
    assert common.shared_dir(Cluster) == "hdfs://x"


def test_without_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 30)
    rows, some = spark.range(200), spark.range(0, 200, 2)
    for passes in (4, 1):
        assert sorted(x.id for x in common.without(rows, some, ["id"], passes).collect()) == list(range(1, 200, 2))


# 1 -- language identification


def ppm_bits(counts, text, depth):
    """Code length by the definition: method C escapes from the longest context seen in this language."""
    total = 0.0
    for i, s in enumerate(text):
        before = (bytes(depth) + text)[i : i + depth]
        p = 1.0
        for k in range(depth, -1, -1):
            c = counts[k].get(before[depth - k :], {})
            if not c:
                continue
            n, d = sum(c.values()), len(c)
            if s in c:
                p *= c[s] / (n + d)
                break
            p *= d / (n + d)
        else:
            p *= 1 / 256
        total -= math.log2(p)
    return total


def test_ppm_code_lengths_are_exact(spark):
    texts = {"a": ["abab cab", "bacab"], "b": ["xyxy zé", "yxz a"]}
    rows = [(i, t, lang) for lang, ts in texts.items() for i, t in enumerate(ts)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(False))
    asked = ["abac", "zéyx", "q", "xyab zz"]
    data, offsets = kernel.buffers(pa.array(asked))
    got = langid.code_lengths(model, data, offsets)
    for j, lang in enumerate(model.langs):
        counts = [collections.defaultdict(collections.Counter) for _ in range(4)]
        for t in texts[lang]:
            b = t.encode()
            for i, s in enumerate(b):
                before = (bytes(3) + b)[i : i + 3]
                for k in range(4):
                    counts[k][before[3 - k :]][s] += 1
        assert np.allclose(got[:, j], [ppm_bits(counts, t.encode(), 3) for t in asked], atol=1e-3)


def test_languages_are_told(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = langid.op1(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert len(out) > 40 and (out.lang == out.lang_pred).mean() > 0.95 and out.score.between(0, 1).all()


def test_many_languages_are_all_learned(spark):
    """300 languages, each with words of its own: a small model, and every text is told."""
    r = random.Random(5)
    own = {f"l{j:03}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for j in range(300)}
    rows = [(i, " ".join(r.choice(own[lang]) for _ in range(60)), lang) for i, lang in enumerate(sorted(own) * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, F.col("doc_id") >= 600)
    assert model.langs == sorted(own)
    assert sum(x.nbytes for level in model.levels for part in level for x in (part.keys, part.start, part.lang, part.bits)) < 4 << 20
    out = langid.identify(df.filter("doc_id >= 600"), model).collect()
    assert len(out) == 300 and all(x.lang == x.lang_pred for x in out)


def test_language_sample_is_bounded_by_bytes(spark):
    """Shares are equal, so the large language does not crowd out the small one; all that was drawn is kept."""
    r = random.Random(6)
    text = lambda letters: "".join(r.choice(letters) for _ in range(100))
    rows = [(i, text("abcdefgh"), "big") for i in range(2000)] + [(2000 + i, text("stuvwxyz"), "small") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, F.lit(False), sample_bytes=20000)
    pairs = [np.bincount(part.lang, minlength=2).tolist() for _, part in model.levels]
    assert model.langs == ["big", "small"] and pairs[0] == [8, 8] and pairs[1][1] > 64
    drawn = 10000  # expected of "big"; at most one new pair a byte and level
    assert pairs[3][0] < 1.5 * drawn and pairs[3][0] > 2000


def test_language_edges(docs, empty, spark):
    model = langid.train(docs, langid.held_out(F.col("doc_id")))
    out = langid.identify(docs.withColumn("score", F.lit("old")), model)
    assert out.columns == [*docs.columns, "lang_pred", "score", "bits_per_byte"] and out.count() == docs.count()
    assert {r.lang_pred for r in out.filter("text is null or trim(text) = '' or text = ' \n\t'").collect()} == {"und"}
    assert langid.train(empty, F.lit(False)) is None
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.language_stage(docs).columns == docs.columns and langid.language_stage(empty).count() == 0


# 2 -- url rules


def test_urls_and_given_rules(spark):
    urls = [None, "", "no scheme/", "http://A.Net", "http://a.net/x?q", "https://EXAMPLE.net/en/1#a", "https://x.example.net/EN/", "http://example.com/de/", "http://badexample.com/de/", "ftp://w.org/fr/a/b?c#d", "http://a?b/c", "http://a://b.net/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1))
    out = {r.page_id: r for r in url_rules.judge(pages, pages.select("url", F.lit(None).cast("boolean").alias("bad"))).collect()}
    assert [(out[i].host, out[i].path) for i in range(len(urls))] == [("", ""), ("", ""), ("", ""), ("a.net", ""), ("a.net", "/x"), ("example.net", "/en/1"), ("x.example.net", "/EN/"), ("example.com", "/de/"), ("badexample.com", "/de/"), ("w.org", "/fr/a/b"), ("a", ""), ("a:", "//b.net/")]
    assert [out[i].rule for i in range(len(urls))] == [None, None, None, None, "net/", "example.net/en/", "net/", "example.com/de/", None, "org/fr/", None, None]
    assert [out[i].verdict for i in (0, 4, 5, 6, 9)] == ["allow", "block", "allow", "block", "allow"]


def test_mined_url_rules_against_brute_force(spark):
    r = random.Random(5)
    rows = [(f"http://{r.choice(['pills', 'news', 'blog'])}.shop.io/{r.choice(['win', 'read', 'buy'])}/{i}.html", None) for i in range(300)]
    rows = [(u, ("pills" in u and "buy" in u) or r.random() < 0.05) for u, _ in rows]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    mined = url_rules.mine(labelled, support=0.02, confidence=0.6, lift=1.5).collect()
    sets = [set(x.toks) for x in labelled.select(url_rules.tokens(F.col("url")).alias("toks")).collect()]
    for rule in mined:
        held = [bad for s, (_, bad) in zip(sets, rows, strict=True) if set(rule.antecedent) <= s]
        assert sum(held) / len(held) == pytest.approx(rule.confidence) and sum(held) / len(rows) >= 0.02
    assert {"host:pills", "word:buy"} in [set(x.antecedent) for x in mined]
    asked = labelled.select("url").withColumn("page_id", F.lit(None).cast("long"))
    fired = {x.url: x.n_rules for x in url_rules.fired(asked, url_rules.mine(labelled, support=0.02)).collect()}
    assert fired == {u: n for (u, _), s in zip(rows, sets, strict=True) if (n := sum(set(x.antecedent) <= s for x in mined))}


def test_tokens_of_the_same_pages_are_one(spark):
    query = "&".join(f"k{i}=v" for i in range(40))
    rows = [(f"http://a.io/x{i}?{query}", True) for i in range(6)] + [(f"http://b.io/y{i}", False) for i in range(30)] + [("http://a.io/z?rare=1", True)]
    rules = url_rules.mine(spark.createDataFrame(rows, "url string, bad boolean"))
    got = rules.collect()
    assert sorted(len(a) for x in got for a in x.alternatives) == [1, 40] and all(len(x.antecedent) == 1 for x in got)
    asked = spark.createDataFrame([("http://c.io/?k7=v", 0), ("http://c.io/?rare=1", 1), ("http://a.io/", 2)], "url string, page_id int")
    assert {x.url: x.n_rules for x in url_rules.fired(asked, rules).collect()} == {"http://c.io/?k7=v": 1, "http://a.io/": 1}


def test_url_rules_of_nothing(spark):
    none = spark.createDataFrame([], "url string, bad boolean, page_id long")
    assert url_rules.judge(none.drop("bad"), none).count() == 0


# 3 -- quality rules


def test_rule_measurements(docs, empty):
    for r in rules.ledger(docs).collect():
        assert r.extra in ("x", None)
    got = sorted(((r.doc_id, *(r[m] for m in rules.MEASURES)) for r in rules.ledger(docs.withColumn("n_words", F.lit("old"))).collect()), key=repr)

    def plain(d, t):
        t = t or ""
        w, lines = words(t), [x for x in t.split("\n") if words(x)]
        n = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        seen = {i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)}
        return (d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(seen), len(lines), len(re.findall("[A-Z]", t)), len(re.findall("[a-z]", t)))

    assert got == sorted((plain(r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert rules.ledger(empty).count() == 0


def test_ablations_against_sql(spark):
    assert rules.op3_ablations(spark, DATA).count() == sum(bin(m).count("1") for m in rules.POLICIES.values())


def test_policies_and_ablations(docs):
    rows = rules.ledger(docs).cache()
    failed = [r.failures for r in rows.collect()]
    for r in rules.ablations(rows).collect():
        m, bit = rules.POLICIES[r.policy], rules.mask(r.rule)
        assert (r.failed, r.failed_alone, r.kept, r.kept_without) == (sum(bool(f & bit) for f in failed), sum(f & m == bit for f in failed), sum(f & m == 0 for f in failed), sum(f & m & ~bit == 0 for f in failed))
    assert rules.apply_policy(rows, "base").filter("kept").count() == sum(f & rules.POLICIES["base"] == 0 for f in failed)


# 4 -- shards


def test_shards_are_a_permutation(docs, empty, tmp_path):
    for bucket in (2000, 1 << 30):
        out = shards.shard(docs.withColumn("slot", F.lit(9)), shards=7, bucket_bytes=bucket).collect()
        by = collections.defaultdict(list)
        for r in out:
            by[r["shard"]].append(r["slot"])
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
        sizes = [len(by[i]) for i in range(7)]
        assert max(sizes) - min(sizes) <= 1
        assert collections.Counter((r.doc_id, r.text, r.extra) for r in out) == collections.Counter((r.doc_id, r.text, r.extra) for r in docs.collect())
    a = shards.shard(docs.repartition(5), bucket_bytes=2000).filter("doc_id is not null").select("doc_id", "shard", "slot").distinct()
    b = shards.shard(docs.coalesce(1), bucket_bytes=2000).filter("doc_id is not null").select("doc_id", "shard", "slot").distinct()
    assert a.exceptAll(b).count() == 0
    assert shards.shard(empty).count() == 0
    shards.write_shards(shards.shard(docs, shards=3), str(tmp_path / "s"))
    assert docs.sparkSession.read.parquet(str(tmp_path / "s")).count() == docs.count()


def test_equal_rows_scatter_and_the_order_is_replayed(spark, monkeypatch):
    monkeypatch.setattr(shards, "RUN", 64)
    rows = [(i % 40, f"text {i % 40}") for i in range(400)] + [(99, "hot")] * 3000
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = shards.shard(df, shards=6, bucket_bytes=4000)
    got = out.collect()
    assert collections.Counter((x.doc_id, x.text) for x in got) == collections.Counter(rows)
    by = collections.defaultdict(list)
    for x in got:
        by[x.shard].append(x.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    hot = collections.Counter(x.shard for x in got if x.doc_id == 99)
    assert min(hot.values()) > 3000 / 6 / 1.3
    few = collections.defaultdict(set)
    for x in got:
        few[x.doc_id].add(x.shard)
    assert sum(len(v) for k, v in few.items() if k != 99) / 40 > 4  # of 6 shards, 10 copies each
    again = shards.shard(df.repartition(7), shards=6, bucket_bytes=4000)
    assert collections.Counter(map(tuple, again.collect())) == collections.Counter(map(tuple, got))
    # Fisher-Yates replayed
    swaps = spark.range(1, 50).select(F.col("id").cast("int").alias("i"), F.pmod(F.xxhash64(F.lit(17), F.lit(3), F.col("id").cast("int")), F.col("id").cast("int") + 1).alias("j")).collect()
    want = list(range(50))
    for i, j in sorted(((s.i, s.j) for s in swaps), reverse=True):
        want[i], want[j] = want[j], want[i]
    order = spark.range(1).select(shards.permutation(F.lit(50), 17, F.lit(3)).alias("o")).first().o
    assert order == want


def test_bucket_starts(spark, monkeypatch):
    monkeypatch.setattr(shards, "GROUP", 7)
    r = random.Random(1)
    n = {b: r.randint(1, 9) for b in range(100) if r.random() < 0.8}
    got = {x.bucket: x.start for x in shards.starts(spark.createDataFrame(list(n.items()), "bucket int, n long")).collect()}
    assert got == {b: sum(v for c, v in n.items() if c < b) for b in n}


def test_shuffle_is_uniform(spark):
    n = 4000
    out = shards.shard(spark.range(n).selectExpr("id as doc_id", "cast(null as string) as text"), bucket_bytes=800, shards=4).toPandas()
    place = out.sort_values("doc_id").eval("shard * 1000 + slot").to_numpy()
    assert abs(np.corrcoef(np.arange(n), place)[0, 1]) < 0.06
    assert abs(np.corrcoef(place[:-1], place[1:])[0, 1]) < 0.06


# 5 -- secrets


def plain_spans(t):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[1]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if m.end() - m.start() >= 16]
    return sorted(found)


def test_secret_spans(spark, docs, empty):
    r = random.Random(2)
    pieces = ["password=", "PassWord : '", "secret=token:", "api_key\" = ", "apikey=", "AKIA", "AKIAAKIA", "é", "ß ", " ", "\n", "x=", "0123456789abcdef0", "deadbeef", "ABCDEFGH12345678", "a.b-c_d/e+f=gh"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 12))) for _ in range(150)] + [None, "", "token=" + "a" * 12, "token=" + "a" * 11]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("base", F.lit(0)).withColumn("k1", F.lit(0))
    for row in secrets.scan(df).collect():
        assert [tuple(s) for s in row.base] == plain_spans(texts[row.doc_id] or ""), texts[row.doc_id]
    assert secrets.scan(docs).count() == docs.count() and secrets.scan(empty).count() == 0
    assert hashlib.sha256(b"").hexdigest() in {x.base_sha256 for x in secrets.op5(spark, DATA).select("base_sha256").distinct().collect()}


def test_randomness_tells_keys_from_words(spark):
    r = random.Random(9)
    keys = ["".join(r.choice(secrets.ALPHABET["base64"]) for _ in range(40)) for _ in range(60)]
    prose = ["".join(r.choice(["tion", "the", "er", "and", "in", "re"]) for _ in range(12)) for _ in range(200)] + ["/usr/local/share/applications/menu", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    df = spark.createDataFrame([(f"see {x} here",) for x in keys + prose], "text string").withColumn("doc_id", F.monotonically_increasing_id())
    got = secrets.scan(df.select("text")).select(F.size("found").alias("n")).withColumn("i", F.monotonically_increasing_id())
    n = [x.n for x in secrets.scan(df).orderBy("doc_id").select(F.size("found").alias("n")).collect()]
    assert got.count() == len(keys + prose) and sum(n[: len(keys)]) >= 57 and sum(n[len(keys) :]) <= 2


def test_reported_tokens_are_controlled(spark):
    r = random.Random(21)
    parts = ["tion", "ther", "ing", "con", "ment", "ver", "al", "ret", "sou", "lan", "per", "est", "ma", "ni"]
    vocabulary = ["".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(500)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(60)) for _ in range(150)]
    camel = []
    while len(camel) < 150:
        name = r.choice(vocabulary) + "".join(r.choice(vocabulary).capitalize() for _ in range(3))
        if 20 <= len(name) < 64:
            camel.append(name)
    keys = ["".join(r.choice(secrets.ALPHABET["base64"]) for _ in range(40)) for _ in range(60)]
    df = spark.createDataFrame([(i, f"{texts[i % 150]} {x} end") for i, x in enumerate(camel + keys)], "doc_id long, text string")
    n = [x.n for x in secrets.scan(df).orderBy("doc_id").select(F.size("found").alias("n")).collect()]
    assert sum(n[:150]) <= 2 and sum(n[150:]) >= 56
    # the text model and p values by the definition
    weights, mean, spread = model = secrets.text_model(df)
    symbol = lambda c: 27 if c in "0123456789" else secrets.LETTERS.find(c) + 1
    pairs = lambda w: [symbol(a) * 28 + symbol(b) for a, b in zip(w.lower(), w.lower()[1:], strict=False)]
    used = collections.Counter(w for x in df.collect() for w in re.findall("[A-Za-z0-9+/_=-]+", x.text) if 2 <= len(w) <= 19)
    counts = collections.Counter()
    for w, k in used.items():
        for q in pairs(w):
            counts[q] += k
    before = collections.Counter()
    for q, k in counts.items():
        before[q // 28] += k
    want = [math.log((counts[q] + 0.5) / (before[q // 28] + 14)) for q in range(784)]
    assert weights == pytest.approx(want) and mean == pytest.approx(sum(k * want[q] for q, k in counts.items()) / sum(counts.values()))
    off = {w: sum(want[q] for q in pairs(w)) - (len(w) - 1) * mean for w in used}
    assert spread**2 == pytest.approx(sum(k * off[w] ** 2 for w, k in used.items()) / sum(k * (len(w) - 1) for w, k in used.items()))
    some = spark.createDataFrame([(x,) for x in camel[:20] + keys[:5]], "token string")
    for x in secrets.texture(some, model).collect():
        z = (sum(want[q] for q in pairs(x.token)) - (len(x.token) - 1) * mean) / (spread * math.sqrt(len(x.token) - 1))
        assert x.p_text == pytest.approx(max(0.5 * math.erfc(-z / math.sqrt(2)), 1e-300), rel=1e-2, abs=1e-6)


def test_battery_p_values_and_rejection_replayed(spark):
    r = random.Random(22)
    tokens = ["".join(r.choice(secrets.ALPHABET[k]) for _ in range(n)) for k in secrets.ALPHABET for n in (20, 33, 64)] + ["a" * 25, "abcdefghijklmnopqrstuvwxyz", "Zz" * 15]
    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    for x in secrets.randomness(spark.createDataFrame([(t,) for t in tokens], "token string")).collect():
        kind = "hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", x.token) else "base32" if re.fullmatch("[A-Z2-7]+", x.token) else "base64"
        assert x.encoding == kind
        a, v = len(secrets.ALPHABET[kind]), [secrets.ALPHABET[kind].index(c) for c in (x.token.lower() if kind == "hex" else x.token)]
        n = len(v)
        chi2 = sum(k * k for k in collections.Counter(v).values()) * a / n - n
        q = 2 / (9 * (a - 1))
        p1 = tail(((max(chi2, 0) / (a - 1)) ** (1 / 3) - (1 - q)) / math.sqrt(q))
        up = [y >= a / 2 for y in v]
        n1, runs = sum(up), 1 + sum(l != m for l, m in zip(up, up[1:], strict=False))  # noqa: E741
        m = 2 * n1 * (n - n1) / n + 1
        var = (m - 1) * (m - 2) / (n - 1)
        p2 = 2 * tail(abs(runs - m) / math.sqrt(var)) if var > 0 else 2.0 ** (1 - n)
        mean = sum(v) / n
        ss, cov = sum((y - mean) ** 2 for y in v), sum((y - mean) * (z - mean) for y, z in zip(v, v[1:], strict=False))
        p3 = 2 * tail(abs(cov / ss) * math.sqrt(n)) if ss > 0 else 2.0 ** (1 - n)
        assert (x.p_chi2, x.p_runs, x.p_serial) == pytest.approx((p1, p2, p3), abs=1e-6)
        assert x.p == pytest.approx(max(min(1, 3 * min(x.p_chi2, x.p_runs, x.p_serial)), 1e-300))
    rows = [(r.choice(["hex", "base64"]), r.randint(4, 6), min(400, int(r.expovariate(1 / r.choice([10, 80]))))) for _ in range(3000)]
    got = {(x.encoding, x.length_class): x.start for x in secrets.rejected_from(spark.createDataFrame(rows, "encoding string, length_class int, level int"), 0.05).collect()}
    for key in {x[:2] for x in rows}:
        p = sorted(math.exp(-x[2] / 10) for x in rows if x[:2] == key)
        passed = [q for i, q in enumerate(p, 1) if q <= 0.05 * sum(y <= q for y in p) / len(p)]
        assert got.get(key) == (round(-10 * math.log(max(passed))) if passed else None)


def test_normal_tail(spark):
    z = [-3.0, -1.0, 0.0, 0.5, 1.96, 4.0, 8.0]
    got = [x.p for x in spark.createDataFrame([(x,) for x in z], "z double").select(secrets.normal_tail(F.col("z")).alias("p")).collect()]
    assert got == pytest.approx([0.5 * math.erfc(x / math.sqrt(2)) for x in z], abs=1e-6)


# 6 -- toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_automaton_against_edit_distance():
    lexicon, stems = ["moron", "loser", "disgusting", "worthless", "abc", "clown"], ["lowei"]
    a = toxicity.compile_lexicon(lexicon, stems)
    r = random.Random(3)
    asked = ["lowei", "loweisch", "lowe", "xlowei"]
    for _ in range(2000):
        w = list(r.choice(lexicon))
        for _ in range(r.randint(0, 3)):
            k, p = r.randint(0, 2), r.randrange(len(w) + 1)
            if k == 0:
                w.insert(p, r.choice("abclorx$é"))
            elif p < len(w):
                w[p : p + 1] = [] if k == 1 else [r.choice("abclorx0")]
        if w:
            asked.append("".join(w))
    codes = np.frombuffer("\n".join(asked).encode("utf-32-le"), np.uint32).astype(int)
    starts = np.cumsum([0, *(len(w) + 1 for w in asked)])[:-1]
    got = toxicity._hits(a, codes, starts, starts + np.array([len(w) for w in asked]))
    for w, g in zip(asked, got, strict=True):
        best = min((d for x in lexicon if (d := distance(w, x)) <= toxicity.allowed(x)), default=9)
        assert g == min(best, 3 if w.startswith("lowei") else 9), w


def test_quotation_is_not_abuse():
    assert toxicity.in_quotation('he said "you are a ', ' and left" then')
    assert toxicity.in_quotation("elle dit « le ", " » hier")
    assert not toxicity.in_quotation("you are a ", " and that is it")
    assert not toxicity.in_quotation('"quoted" you ', " there")


def test_toxic_documents_are_found(spark, docs, empty):
    r = random.Random(4)
    bad = ["scoundrel", "blockhead", "nitwit"]
    rows, labels = [], []
    for i in range(400):
        w = [r.choice(WORDS) for _ in range(30)]
        if toxic := i % 5 == 0:
            term = r.choice(bad)
            at = r.randrange(1, len(term))
            w[r.randrange(30)] = term if i % 20 else term[:at] + r.choice("0123456789") + term[at + 1 :]
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(df, lab)
    assert model.words == sorted(bad)
    out = toxicity.score(docs.withColumn("hits", F.lit("old")), model)
    assert out.columns[-3:] == ["score", "hits", "quoted"] and out.count() == docs.count() and out.filter("score >= 0.5").count() == 0
    got = {x.doc_id: x.score for x in toxicity.score(df, model).collect()}
    assert all((got[i] >= 0.5) == bool(t) for i, t in labels)
    assert toxicity.train(empty, lab) is None and toxicity.score(empty, None).count() == 0
    assert {x.score for x in toxicity.score(docs, None).collect()} == {0.0}


def test_letters_beyond_the_common_scripts():
    a = toxicity.compile_lexicon(["바보들아", "𝕓𝕒𝕕𝕠𝕟𝕖"])
    text = "바보들아 바보들이 가나다라 𝕓𝕒𝕕𝕠𝕟𝕖 𝕓𝕒𝕕𝕒𝕟𝕖"
    f = toxicity._features([a], pa.array([text]))
    assert f[0].tolist() == [2, 2, 0, 0, 0, 0, 5]


def test_no_family_of_copies_takes_the_lexicon(spark):
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    terms = sorted({"".join(r.choice(letters) for _ in range(6)) for _ in range(70)})
    own = ["own" + "".join(r.choice(letters) for _ in range(6)) for _ in range(320)]
    toxic = [[terms[(j + m) % len(terms)] for m in (0, 5, 23)] for j in range(210)]
    texts = [(" ".join([*(r.choice(WORDS) for _ in range(20)), *t]), 1) for t in toxic]
    texts += [(" ".join(r.choice(WORDS) for _ in range(20)), 0) for _ in range(1500)]
    for _ in range(40):  # near copies, and exact ones of the last
        w = list(own)
        w[r.randrange(len(w))] = r.choice(WORDS)
        texts.append((" ".join(w), 1))
    texts += [texts[-1]] * 20
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    model = toxicity.train(df, spark.createDataFrame([(i, x) for i, (_, x) in enumerate(texts)], "doc_id long, toxic int"))
    used = collections.Counter(t for three in toxic for t in set(three))
    assert len(terms) > 60 and min(used[t] for t in terms) >= 6
    assert model.words == terms


def test_twins_against_all_pairs():
    r = random.Random(6)
    for _ in range(200):
        base = [set(r.sample(range(30), r.randint(1, 12))) for _ in range(8)]
        own = {f"w{i}": {x for x in r.choice(base) if r.random() < 0.9} | set(r.sample(range(40), r.randint(0, 1))) for i in range(30)}
        own = {w: d for w, d in own.items() if d}
        want = {w for w, d in own.items() for v, e in own.items() if v != w and 4 * len(d & e) >= 3 * len(d | e)}
        assert toxicity.twins(own) == want


# 7 -- mixing


def test_mix_targets_and_copies(docs, empty):
    got = mixing.mix(docs).collect()
    size = collections.Counter()
    for r in docs.collect():
        size[r.source] += len(words(r.text))
    names = sorted((s for s in size if s is not None)) + [None]
    weight, total, capped = {s: i % 3 + 1 for i, s in enumerate(names)}, sum(size.values()), set()
    while True:
        rest, w = total - sum(3 * size[s] for s in capped), sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and rest * weight[s] / w > 3 * size[s]}
        if not over:
            break
        capped |= over
    want = {s: 3 * size[s] if s in capped else rest * weight[s] / w for s in names}
    taken = collections.Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 3
        taken[r.source] += r["size"] * r.copies
    largest = collections.Counter()
    for r in got:
        largest[r.source] = max(largest[r.source], r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in names)
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda rows: sorted(((r.doc_id, r.uniform, r.copies) for r in rows), key=repr)
    assert key(got) == key(again)
    assert mixing.mix(empty).count() == 0
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)


# 8 -- n-gram Jaccard join


def test_pareto_sample_replayed(spark):
    r = random.Random(17)
    rows = [(i, "w " * int(r.paretovariate(0.9) * 5), r.choice("abcdefg")) for i in range(2500)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    drawn = 0
    for source in "abcdefg":
        own = [x for x in got if x.source == source]
        whole = int(own[0].target // own[0].source_size)
        part = own[0].target - whole * own[0].source_size
        # p = min(1, size / t) with the expected words that are missing
        lo, hi = 0.0, 1e12
        for _ in range(200):
            t = (lo + hi) / 2
            lo, hi = (t, hi) if sum(min(1, x.size / t) * x.size for x in own) > part else (lo, t)
        assert all(x.probability == pytest.approx(min(1, x.size / t), rel=0.03) for x in own)
        certain = [x for x in own if x.probability >= 1]
        assert all(x.copies == whole + 1 for x in certain)
        free = [x for x in own if 0 < x.probability < 1]
        assert all(x.rank == pytest.approx(math.log2(x.uniform / (1 - x.uniform) / (x.probability / (1 - x.probability))), abs=1e-9) for x in free)
        classes, odd = collections.defaultdict(list), []
        for x in free:
            classes[math.floor(math.log2(x.size) * mixing.SIZE_CLASSES)].append(x)
        for c, some in classes.items():
            some.sort(key=lambda x: x.rank)
            n = sum(x.copies > whole for x in some)
            assert all((x.copies > whole) == (i < n) for i, x in enumerate(some))  # those with the smallest ratios
            off = n - sum(x.probability for x in some)
            odd += [(c, off)] if abs(off) >= 1 else []
        assert len(odd) <= 2 and all(abs(off) < 2 for _, off in odd)  # one swap
        taken = [x for x in free if x.copies > whole]
        assert abs(len(taken) - sum(x.probability for x in free)) < 1  # the number is fixed
        by_order = sorted(free, key=lambda x: x.uniform)
        drawn += {x.doc_id for x in by_order[: len(taken)]} != {x.doc_id for x in taken}
        words_taken = sum(x.size * x.copies for x in own)
        assert abs(words_taken - own[0].target) <= max(x.size for x in free) / 2 + part / 20
    assert drawn == 7  # the order is not that of the uniform numbers


def test_inclusion_frequencies(spark):
    r = random.Random(5)
    rows = [(i, "w " * r.choice([3, 10, 11, 30, 100, 400]), r.choice("ab")) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    runs = [mixing.mix(docs, seed).filter("rank is not null").select("doc_id", "source", "size", "probability", "copies", "target", "source_size") for seed in range(6)]
    every = runs[0]
    for x in runs[1:]:
        every = every.union(x)
    hits = collections.defaultdict(list)
    for x in every.collect():
        hits[x.source, x["size"]].append((x.probability, x.copies - int(x.target // x.source_size)))
    assert len(hits) >= 8
    for got in hits.values():  # equal sizes: the mean over documents and seeds against p, a fixed number of each size varying less than independent draws
        p = got[0][0]
        assert abs(sum(y for _, y in got) / len(got) - p) < 4 * math.sqrt(p * (1 - p) / len(got)) + 0.01


def test_repeated_rows_are_drawn_one_by_one(spark):
    same = spark.range(100000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    other = spark.range(1000).select((F.col("id") + 100).alias("doc_id"), F.lit("d e").alias("text"), F.lit("t").alias("source"))
    docs = same.union(other)
    got = mixing.mix(docs).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("target").alias("target"), F.count("*").alias("n")).collect()
    assert {x.source: x.n for x in got} == {"s": 100000, "t": 1000}
    assert all(abs(x.taken - x.target) <= 3 for x in got)
    assert mixing.mixed(docs).filter("source = 's'").count() == sum(x.taken for x in got if x.source == "s") // 3


def test_whole_rates_need_no_order(spark):
    one = spark.createDataFrame([(i, "w " * (i % 7), "s") for i in range(200)], "doc_id long, text string, source string")
    _, cuts = mixing._plan(mixing._rows(common.carried(one, "text", "source"), 11).select("size", "skey", "uniform"), 11)
    assert cuts.count() == 0  # nothing is drawn
    assert {x.copies for x in mixing.mix(one).collect()} == {1}
    nothing = one.union(spark.createDataFrame([(i, None, "t") for i in range(300, 320)], one.schema))
    assert {x.copies for x in mixing.mix(nothing).collect() if x.source == "t"} == {1}


def plain_groups(rows, k=5):
    sets = {}
    for d, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
        sets.setdefault(d, set()).add(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: root(d) for d in ids}, sets


@pytest.mark.parametrize("options", [{}, {"long_list": 2, "heavy_level": 1, "salts": 3}])
def test_jaccard_groups_against_all_pairs(docs, options):
    want, sets = plain_groups([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None])
    for r in ngram_join.jaccard_components(docs, **options).collect():
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id] and r.n_shingles in {len(x) for x in sets[r.doc_id]}
    null = [r for r in ngram_join.jaccard_components(docs, **options).collect() if r.doc_id is None]
    assert sorted((r.component_id is not None, r.n_shingles) for r in null)[0][0] is False and any(r.component_id is not None for r in null)


def test_jaccard_of_a_family_of_near_copies(spark):
    r = random.Random(8)
    base = [r.choice(WORDS) for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(120)] = f"n{r.random()}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, _ = plain_groups(rows)
    assert {x.doc_id: x.component_id for x in ngram_join.jaccard_components(df, long_list=20).collect()} == want
    assert len(set(want.values())) > 1


def test_join_leaves_no_shuffle_files_and_no_large_tables(spark, docs, tmp_path, monkeypatch):
    """Disk holds one step's shuffle at a time, whenever the driver collects garbage; only narrow tables stay."""
    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(re.findall("shuffle_[0-9]+", held.getAllFiles().mkString(" ")))
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    docs.count()  # its cache has a shuffle of its own
    before = files()
    common.written(docs.repartition(7, "doc_id"), "dealt")
    for _ in range(100):  # removal is asked for at the end of the write, and done a little later
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
    out = ngram_join.jaccard_components(docs)
    assert {x.name.rsplit("-", 1)[0] for x in tmp_path.iterdir()} == {"dealt", "slim", "labels"}
    assert out.count() == docs.count()
    assert spark.conf.get(common._RELEASE, "false") == "false"


def test_postings_and_pairs_go_slice_by_slice(spark, docs, monkeypatch):
    """No shuffle holds the postings of all shingles, or the sets of all pairs, at once; the copies are taken out once."""
    for name, value in (("POSTINGS", 400), ("SLICES", 3), ("PAIRS", 2), ("BROADCAST_ROWS", 1)):
        monkeypatch.setattr(ngram_join, name, value)
    made, before = [], ngram_join.written

    def written(df, name, keep=False):
        out = before(df, name, keep)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(ngram_join, "written", written)
    want, _ = plain_groups([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None])
    for r in ngram_join.jaccard_components(docs, long_list=2).collect():
        assert r.doc_id is None or r.component_id == want[r.doc_id]
    postings = [n for name, n in made if name == "shared"]
    assert len(postings) == 3 + 2 and max(postings[:3]) < postings[3] <= sum(postings[:3])
    assert [name for name, _ in made].count("reps") == 1
    assert [name for name, _ in made].count("verified") > 1


@pytest.mark.parametrize("options", [{}, {"long_list": 2, "heavy_level": 1, "salts": 3, "block": 50}])
def test_link_counts_against_all_pairs(spark, docs, empty, options):
    r = random.Random(9)
    base = [r.choice(WORDS) for _ in range(100)]
    family = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(100)] = f"n{r.random()}"
        family.append((1000 + i, " ".join(w)))
    rows = [(x.doc_id, x.text) for x in docs.collect()] + family + family[:9] * 2 + [(1000, family[1][1]), (None, family[2][1]), (2000, " "), (2001, None)]
    sets = []
    for _, text in rows:
        w = words((text or "").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    linked = [sum(j != i and 100 * len(a & b) >= 75 * len(a | b) for j, b in enumerate(sets)) if a else 0 for i, a in enumerate(sets)]
    out = ngram_join.link_counts(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    assert collections.Counter((x.doc_id, x.n_links) for x in out) == collections.Counter((i, n) for (i, _), n in zip(rows, linked, strict=True))
    assert ngram_join.link_counts(empty).count() == 0


def test_sketch_is_summed_in_levels(spark, docs, monkeypatch):
    whole = ngram_join.rarity(docs.select("text"))
    monkeypatch.setattr(ngram_join, "FAN", 2)
    assert (ngram_join.rarity(docs.select("text").repartition(5)) == whole).all() and whole.max() > 0


def test_one_of_each(docs, empty):
    want, _ = plain_groups([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None])
    out = ngram_join.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == sorted(set(want.values()))
    assert ngram_join.one_of_each(empty).count() == 0


def test_one_of_each_keeps_unlinked_texts_of_one_id(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(1, a), (1, b), (1, b), (2, c), (3, c), (4, b), (5, d), (5, d), (None, d), (6, a), (6, c), (None, None), (None, None), (7, " "), (7, None)]
    out = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = collections.Counter((x.doc_id, x.text) for x in out)
    assert sum(n for (_, t), n in got.items() if t == a) == 1  # of ids 1 and 6, which name other texts too
    assert {k: n for k, n in got.items() if k[1] != a} == {(4, b): 1, (2, c): 1, (5, d): 1, (None, None): 2, (7, " "): 1, (7, None): 1}


def test_components(spark):
    r = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 200)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)] + [(5, 5), (None, 3)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}


# 9 -- quality


def test_quality_shrinks_sparse_sites(spark, docs, empty):
    r = random.Random(7)
    rows, labels = [], []
    for i in range(600):
        junk = r.random() < 0.3
        rows.append((i, " ".join((x.upper() + "!!" if junk else x) for x in (r.choice(WORDS) for _ in range(40))), "en", "bad" if i % 3 == 0 else "few" if i == 1 else "good"))
        labels.append((i, 0 if junk or i % 3 == 0 and r.random() < 0.5 else 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    out = quality.assess(df, lab).toPandas()
    rate = out.groupby("host").host_rate.mean()
    assert rate["bad"] < rate["good"] - 0.2 and rate["bad"] < rate["few"] < rate["good"] + 0.01  # one document says little: near the global rate
    joined = out.merge(lab.toPandas(), on="doc_id")
    assert (joined.keep == joined.quality.astype(bool)).mean() > 0.8
    assert quality.assess(docs, lab.filter("quality is null")).filter("score = 0.5").count() == docs.count()
    assert quality.assess(docs, lab).count() == docs.count() and quality.assess(empty, lab).count() == 0


def test_quality_knows_the_pages_of_a_document(spark, docs, empty):
    r = random.Random(9)
    text = [" ".join(r.choice(WORDS) for _ in range(40)) for _ in range(300)]
    urls = [f"https://{'bad' if i % 3 == 0 else 'Good'}.example.org/{'x' if i % 2 else 'y'}/{i}{'.html?a=1' if i % 5 else '/'}" for i in range(280)]
    urls += ["http://good.example.org/x/0", "http://good.example.org/x/0#again", "http://nobody.example.org/9999", "http://bad.example.org/about", None]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    df = spark.createDataFrame([*enumerate(text), (None, text[0])], "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 3 > 0 or i % 4 == 0)) for i in range(290)], "doc_id long, quality int")
    out = {x.doc_id: x for x in quality.assess(df, lab, sites=quality.page_sites(pages)).collect()}
    assert len(out) == 301
    base = out[299].host_rate
    for i in (*range(280, 300), None):
        assert (out[i].host, out[i].path, out[i].host_rate, out[i].path_rate) == (None, None, base, base) and out[i].score == pytest.approx(out[i].p_document)
    for i in range(280):
        assert out[i].host == ("bad" if i % 3 == 0 else "good") + ".example.org" and out[i].path == ("/x/" if i % 2 else "/y/")
        if i:
            assert (out[i].host_rate < base and out[i].score < out[i].p_document) == (i % 3 == 0)
    assert out[3].host_rate < out[0].host_rate < out[1].host_rate  # shown by both hosts
    assert quality.assess(docs, lab, sites=quality.page_sites(pages)).count() == docs.count()
    assert quality.assess(docs, lab, sites=quality.page_sites(pages.limit(0))).filter("host is null and path is null").count() == docs.count()
    assert quality.assess(empty, lab, sites=quality.page_sites(pages)).count() == 0


def test_quality_posteriors_replayed(spark):
    """Every number but the measurements recomputed in plain Python: the classifier's optimum, rates, strengths, posteriors and scores."""
    r = random.Random(21)
    text = [" ".join((w.upper() + "#" if r.random() < q else w) for w in (r.choice(WORDS) for _ in range(r.randint(5, 60)))) for q in (r.random() for _ in range(200))]
    links = [(i, f"h{r.randint(0, 5)}" if r.random() < 0.9 else None, f"p{r.randint(0, 3)}") for i in range(180) for _ in range(r.randint(0, 3))]
    labels = {i: int(text[i].count("#") * 3 < len(text[i].split())) for i in range(0, 200, 2)}
    docs = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    lab = spark.createDataFrame([*labels.items(), (3, None)], "doc_id long, quality int")
    sites = spark.createDataFrame(links, "doc_id long, host string, path string")
    got = {x.doc_id: x for x in quality.assess(docs, lab, sites=sites).collect()}

    measured = rules.measure(docs).selectExpr("doc_id", *(f"cast({e} as double) as {c}" for c, e in quality.INPUTS.items())).toPandas().sort_values("doc_id")
    x = measured[list(quality.INPUTS)].to_numpy(float)
    own = sorted(labels)
    std = np.maximum(x[own].std(0), 1e-6)
    sample = rules.measure(docs).join(lab.filter("quality is not null"), "doc_id").withColumn("good", F.col("quality"))
    w = quality.fit(sample)
    slope = np.array([w[c] for c in quality.INPUTS])
    p = 1 / (1 + np.exp(-(x @ slope + w[""])))
    y = np.array([labels[i] for i in own])
    pull = ((x[own] - x[own].mean(0)) / std).T @ (p[own] - y) + slope * std  # the gradient of the penalised likelihood vanishes
    assert np.abs(pull).max() < 1e-4 and abs((p[own] - y).sum()) < 1e-4
    z = np.clip(x @ slope + w[""], -6, 6)
    p = 1 / (1 + np.exp(-z))

    n = {i: 1.0 if i in labels else quality.SOFT for i in range(200)}
    s = {i: n[i] * labels.get(i, p[i]) for i in range(200)}
    base = (sum(s.values()) + 0.5) / (sum(n.values()) + 1)
    of = {i: sorted({(h, q) for d, h, q in links if d == i}, key=lambda t: ("-" if t[0] is None else "+" + t[0], t[1])) for i in range(200)}
    hosts, paths = collections.defaultdict(lambda: [0.0, 0.0]), collections.defaultdict(lambda: [0.0, 0.0])
    for i in range(200):
        for groups, keys in ((hosts, {h for h, _ in of[i]}), (paths, set(of[i]))):
            for k in keys:
                groups[k][0] += n[i]
                groups[k][1] += s[i]

    def strength(rows):  # (n, s, rate of the level above)
        total = sum(a for a, _, _ in rows)
        between = max((sum(a * (b / a - m) ** 2 for a, b, m in rows) - sum(m * (1 - m) for _, _, m in rows)) / total, 1e-12)
        return min(1e4, max(1.0, sum(a * m * (1 - m) for a, _, m in rows) / total / between - 1))

    k_host = strength([(a, b, base) for a, b in hosts.values()])
    k_path = strength([(a, b, (hosts[h][1] + k_host * base) / (hosts[h][0] + k_host)) for (h, _), (a, b) in paths.items()])
    logit = lambda q: math.log(q / (1 - q))
    for i in range(200):
        rates = []
        for h, q in of[i]:
            host = (max(hosts[h][1] - s[i], 0) + k_host * base) / (max(hosts[h][0] - n[i], 0) + k_host)
            path = (max(paths[h, q][1] - s[i], 0) + k_path * host) / (max(paths[h, q][0] - n[i], 0) + k_path)
            rates.append((host, path, logit(path)))
        host, path, odds = np.mean(rates, 0) if rates else (base, base, logit(base))
        score = 1 / (1 + math.exp(-(z[i] + odds - logit(base))))
        assert (got[i].host, got[i].path) == (of[i][0] if of[i] else (None, None))
        assert [got[i].p_document, got[i].host_rate, got[i].path_rate, got[i].score] == pytest.approx([p[i], host, path, score], abs=1e-6)


def test_quality_query_reads_urls(spark):
    shown = collections.defaultdict(set)
    for x in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        host, rest = x.url.split("://", 1)[1].split("/", 1)
        folder, number = re.match(r"(.*/)([0-9]+)", "/" + rest).groups()
        shown[int(number)].add((host.lower(), folder))
    got = quality.op9(spark, DATA).collect()
    assert len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert all((x.host, x.path) == min(shown.get(x.doc_id, [(None, None)])) for x in got)


# 10 -- decontamination


def test_decontamination_against_containment(spark, docs, empty):
    r = random.Random(12)
    items = [(i, " ".join(r.choice(WORDS) for _ in range(r.choice([3, 5, 8, 20, 40, 59])))) for i in range(60)] + [(60, None), (61, ""), (62, "A B C D E F G")]
    items.append(items[5])
    rows = []
    for i in range(80):
        w = [r.choice(WORDS) for _ in range(r.choice([10, 100, 3000]))]
        p = (items[i % 63][1] or "").split()
        for _ in range(r.randint(0, 3)):
            if p:
                p[r.randrange(len(p))] = "zz"
        at = r.randrange(len(w))
        rows.append((i if i % 9 else None, " ".join(w[:at] + (p if i % 2 else [x.upper() for x in p]) + w[at:])))
    rows += [(900, rows[3][1]), (901, None), (902, "a b c d e f g")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")

    def grams(t, k=5):
        w = [x.lower() for x in words(t)]
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    held = {i: (grams(t, k), k) for i, t in items if (k := min(5, len(words(t))))}
    bad = {t for _, t in rows for g, k in held.values() if t and 100 * len(g & grams(t, k)) >= 75 * len(g)}
    left = decontaminate.clean(df, bench)
    assert left.columns == df.columns and sorted(str(x.text) for x in left.collect()) == sorted(str(t) for _, t in rows if t not in bad)
    assert 20 < len(bad) < 80 and any(len(words(items[i % 63][1])) == 3 and rows[i][1] in bad for i in range(80))
    want = {(t, i, len(g & grams(t, k)), len(g)) for _, t in rows for i, (g, k) in held.items() if t and 100 * len(g & grams(t, k)) >= 75 * len(g)}
    found = decontaminate.contaminated(df, bench).join(df.select(*common.text_key(F.col("text")), "text").distinct(), ["k1", "k2"]).collect()
    assert {(x.text, x.item_id, x.n_shared, x.n_item) for x in found} == want and len(found) == len(want)
    assert decontaminate.clean(empty, bench).count() == 0 and decontaminate.clean(docs, bench.limit(0)).count() == docs.count()


# 11 -- fill-in-middle


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", text, None, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)) if h4 % 100 < 80 else (n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m))


def test_fill_in_middle(spark, docs, empty):
    r = random.Random(3)
    rows = [(x.doc_id, x.text) for x in docs.collect()]
    rows += [(1000 + i, "".join(r.choice(["a", "é", "𝒳y", " ", "\n", "\t ", "<P", "<S>", "\u3000", ">"]) for _ in range(r.randint(0, 40)))) for i in range(300)]
    rows += [rows[-1], rows[-1], (5000, "w " * 50000), (5001, "x" * 100000), (5003, " " * 70)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("meta.lang", F.lit(2)).repartition(5)
    out = fim.transform(table).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda x: repr(x)
    assert sorted([(x.doc_id, x.n, x.form, x.output, x.prefix_chars, x.middle_chars) for x in out], key=key) == sorted([(d, *plain_fim(d, t)) for d, t in rows], key=key)
    assert {(x.doc_id, x.back) for x in out} == {(d, t or "") for d, t in rows}
    assert {x.form for x in out} == {"plain", "spm", "psm"}
    assert fim.transform(empty).count() == 0


# 12 -- centroid clustering


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, tuple(math.floor(64 * x) for x in v)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cents = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for i in range(rounds + 1):
        near = [min(range(len(cents)), key=lambda c: (far(v, cents[c]), c)) for _, v in kept]
        if i < rounds:
            groups = collections.defaultdict(list)
            for c, (_, v) in zip(near, kept, strict=True):
                groups[c].append(v)
            cents = [tuple(sum(x) // len(groups[c]) for x in zip(*groups[c], strict=True)) if groups[c] else cents[c] for c in range(len(cents))]
    return [(i, c, far(v, cents[c])) for c, (i, v) in zip(near, kept, strict=True)], cents


@pytest.mark.parametrize("kind", ["spread", "grid", "few", "same"])
def test_clusters_against_brute_force(spark, kind):
    r = random.Random(9)
    wide = {"spread": lambda: [r.gauss(0, 1) for _ in range(64)], "grid": lambda: [r.choice([0.0, 0.5]) if j < 4 else 0.0 for j in range(64)], "few": lambda: [r.random() for _ in range(64)], "same": lambda: [0.25] * 64}[kind]
    rows = [(i, wide()) for i in range({"spread": 300, "grid": 200, "few": 5, "same": 40}[kind])]
    rows += [rows[0], rows[0], (None, wide()), (900, None), (901, []), (902, [1.0] * 63), (903, [None] + [1.0] * 63), (904, [float("nan")] + [1.0] * 63), (905, [float("inf")] + [1.0] * 63)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("x")).repartition(4)
    got, at = centroids.clusters(table)
    want, cents = plain_clusters(rows)
    assert sorted([(x.vec_id, x.cluster, x.distance) for x in got.collect()], key=repr) == sorted(want, key=repr)
    assert at.tolist() == [list(c) for c in cents]


def test_clusters_of_nothing_and_too_much(spark):
    nothing = spark.createDataFrame([], "vec_id long, embedding array<float>")
    got, at = centroids.clusters(nothing)
    assert got.count() == 0 and at.shape == (0, 64)
    with pytest.raises(Exception, match="exceeds"):
        centroids.clusters(spark.createDataFrame([(1, [1e300] * 64)], "vec_id long, embedding array<double>"))


def test_balls_spare_comparisons_and_keep_ties():
    r = np.random.default_rng(4)
    at = np.concatenate([r.integers(-9, 9, (14, 3)), np.array([[100, 0, 0], [100, 0, 0]])])
    v = np.concatenate([r.integers(-9, 9, (500, 3)), r.integers(90, 110, (500, 3))])
    old = centroids.assign(v, centroids.Centroids.of(at))
    for step in range(4):
        after = at + r.integers(-3, 4, at.shape) * (step < 3)
        after[15] = after[14]
        cents = centroids.Centroids.of(after, at)
        cluster, square, upper, lower = centroids.assign(v, cents, *(x.copy() for x in (old[0], old[2], old[3])))
        every = ((v[:, None, :] - after[None]) ** 2).sum(2)
        assert (cluster == every.argmin(1)).all()
        assert (upper**2 >= every.min(1) * (1 - 1e-12)).all()
        every[np.arange(len(v)), cluster] = np.iinfo(np.int64).max
        assert (lower <= np.sqrt(every.min(1)) * (1 + 1e-12)).all()
        assert step < 3 or (square < 0).any()  # some were not measured at all
        old, at = (cluster, square, upper, lower), after


# 13 -- token counts


@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path), token_counts.compile_file(path)


_PIECES = ["a", "b", "s", "t", "re", "ll", "'", "  ", " ", "\n", "\t", "é", "\u3000", "\u00a0", "\u2028", "1", "23", "³", "!", "-", "日本", "𝒳", "ve", "m", "<|endoftext|>", "<|endof", "text|>", "Ünï", "the", " and", "x" * 40, " " * 30, "\r\n", "'ll", "'re", "'s", "'d", "\u0301", "'v", "'r1", "\x00"]


def test_token_counts_equal_the_library(tokenizer):
    _, library, compiled = tokenizer
    r = random.Random(1)
    texts = ["".join(r.choice(_PIECES) for _ in range(r.choice([0, 1, 2, 3, 5, 10, 40, 300]))) for _ in range(3000)]
    texts += [None, "", "x" * 20000, "ab" * 3000, " " * 5000 + "x", "\n" * 300, "".join(r.choice("0123456789abcdefXYZ+/=") for _ in range(20000)), "長" * 700 + "い" * 900]
    size, got = token_counts.count_texts(pa.array(texts, pa.string()), compiled)
    want = [len(x.ids) for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert got.tolist() == want and size.tolist() == [len((t or "").encode()) for t in texts]


def test_every_character_is_split_as_the_library_does(tokenizer):
    _, library, compiled = tokenizer
    texts = ["".join(f"a{chr(c)}1 {chr(c)}!{chr(c)}{chr(c)}'s{chr(c)}" for c in range(a, a + 512) if not 0xD800 <= c < 0xE000) for a in range(0, 0x32000, 512)]
    _, got = token_counts.count_texts(pa.array(texts), compiled)
    assert got.tolist() == [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


def test_full_tables_and_short_blocks_change_no_count(tokenizer, monkeypatch):
    path, library, compiled = tokenizer
    r = random.Random(2)
    texts = ["".join(r.choice(_PIECES) for _ in range(200)) + "".join(r.choice("abcdefghij ") for _ in range(500)) for _ in range(60)]
    want = [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(token_counts, "BLOCK", 300)
    monkeypatch.setattr(token_counts, "CHUNK", 20)
    small = token_counts.Compiled(compiled.classes, compiled.step, compiled.flag, compiled.parts, compiled.special, token_counts.Merger(compiled.parts, 64))
    assert token_counts.count_texts(pa.array(texts), small)[1].tolist() == want


def test_chunk_maps_compose():
    step, _ = token_counts.splitter()
    r = np.random.default_rng(1)
    cls = r.integers(0, 11, (37, 50)).astype(np.uint8)
    cls[:, 10:20] = token_counts.SPACE  # whole chunks that leave the state open
    state, want = token_counts.START, []
    for chunk in cls.T:
        want.append(state)
        for c in chunk:
            state = step[int(state) << 4 | int(c)]
    assert token_counts.entered(cls, step).tolist() == want


def test_token_counts_over_rows(spark, docs, empty, tokenizer):
    path, library, _ = tokenizer
    x = docs.withColumn("n_tokens", F.lit("old")).withColumn("meta.lang", F.lit(1))
    got = token_counts.token_counts(x, path)
    assert got.columns == [c for c in x.columns if c != "n_tokens"] + ["n_bytes", "n_tokens"]
    rows = got.collect()
    assert len(rows) == docs.count() and all(y.n_tokens == len(library.encode(y.text or "", add_special_tokens=False).ids) and y.n_bytes == len((y.text or "").encode()) for y in rows)
    assert token_counts.token_counts(empty, path).count() == 0


def test_other_tokenizers_are_refused():
    P = pytest.importorskip("public_tokenizers")
    with pytest.raises(ValueError):
        token_counts.compile_file(P.path("word_bpe_49k.json"))
