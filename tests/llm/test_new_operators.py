"""Spelling variants, periodic runs and exact duplicates against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stallkeeper.llm import exact, periodic, queries, spelling
from stallkeeper.llm.fuse import FuseFilter
from stallkeeper.staging import new_folder

from ..conftest import DATA


def words_of(text):
    """Words between ASCII white space."""
    return [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text).split(" ") if w]


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


# spelling


def letters(text):
    run, out = "", []
    for c in text + " ":
        if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
            run += c.lower() if c.isascii() else c
        elif run:
            out.append(run)
            run = ""
    return out


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def forms(counts, times=5):
    """word -> (form, root, n, n_near, form_n) by comparing all words of neighbouring lengths that agree in either half."""
    under = defaultdict(set)
    for w in counts:
        for i in range(len(w) + 1):  # words one edit apart have a deletion in common, or one is a deletion of the other
            under[w[:i] + w[i + 1 :] if i < len(w) else w].add(w)
    near = {w: {v for i in range(len(w) + 1) for v in under[w[:i] + w[i + 1 :] if i < len(w) else w] if one_edit(w, v)} for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= times * counts[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts}


def word_counts(texts):
    counts = Counter()
    for k, text in texts:
        for w in letters(text or ""):
            h = zlib.crc32(f"{k}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return counts


def test_spelling_query(spark, texts):
    counts = {w: n for w, n in word_counts(texts.items()).items() if n >= 5 and len(w) >= 6}
    rows = queries.op11_spelling(spark, DATA).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == forms(counts) and len(rows) == len(counts)
    assert any(r.form for r in rows) and rows[0].__fields__ == ["word", "form", "root", "n", "n_near", "form_n"]


@pytest.mark.parametrize("per_shard", [8, 4096])
def test_near_words_of_few_letters(spark, per_shard):
    """Words over two letters have many near words, long common halves and doubled letters; small shards split hot halves."""
    rng = random.Random(3)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(6, 10))) for _ in range(600)} | {"a" * k for k in range(6, 30)} | {"prefix" + "".join(rng.choice("xy") for _ in range(5)) for _ in range(40)}
    counts = {w: rng.choice([5, 6, 30, 200, 5000]) for w in words}
    df = spark.createDataFrame(sorted(counts.items()), "word string, n long")
    got = {(r.word, r.near, r.near_n) for r in spelling.near_words(df, per_shard, 100).collect()}
    assert got == {(a, b, counts[b]) for a in words for b in words if abs(len(a) - len(b)) < 2 and one_edit(a, b)}
    rows = spelling.spelling_forms(df).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == forms(counts)


def test_spelling_chain(spark):
    """Roots lie as many forms away as a count can be multiplied by five."""
    base = "abcdefghijklmnopqrstuvwxyz"
    names = ["q" * k + base for k in range(26)]
    df = spark.createDataFrame([(w, 5 ** (k + 1)) for k, w in enumerate(names)], "word string, n long")
    assert {r.root for r in spelling.spelling_forms(df).collect()} == {names[-1]}
    assert spelling.spelling_forms(df.limit(0)).collect() == []


def test_word_counts_of_odd_texts(spark, odd_docs, no_docs):
    rows = [("" if r.doc_id is None else r.doc_id, r.text) for r in odd_docs.collect()]
    want = {w: n for w, n in word_counts(rows).items() if len(w) >= 6}
    assert {r.word: r.n for r in spelling.word_counts(odd_docs, most=50).collect()} == want
    assert spelling.word_counts(no_docs).collect() == []


# periodic runs


def plain_runs(words):
    """(start, length, period) of all runs, period by period."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        at = 0
        while at + q < n:
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end + q - at >= max(12, 2 * q):
                found.setdefault((at, end + q), q)
            at = max(end, at) + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


def periodic_words(rng, n):
    """Words in which pieces come again: of few different words, repeated stretches with and without a remainder, nested."""
    out = []
    while len(out) < n:
        kind = rng.randrange(4)
        if kind == 0:
            out += [rng.randrange(rng.choice([2, 3, 50])) for _ in range(rng.randrange(1, 20))]
        elif kind == 1:
            piece = [rng.randrange(4) for _ in range(rng.randrange(1, 15))]
            out += (piece * 30)[: rng.randrange(1, 80)]
        elif out:
            q = rng.randrange(1, len(out) + 1)
            out += (out[-q:] * 3)[: rng.randrange(1, 2 * q + 2)]
    return out[:n]


def test_catchers_against_brute_force():
    rng = random.Random(5)
    for trial in range(300):
        words = periodic_words(rng, rng.randrange(0, 260))
        c, at = periodic.Catchers(), 0
        while at < len(words):  # appended in parts of any size
            step = rng.choice([1, 1, 2, 7, 40, 1000])
            c.append(np.array(words[at : at + step], np.int64))
            at += step
            if trial % 10 == 0:
                assert c.runs() == plain_runs(words[:at])
        assert c.runs() == plain_runs(words), words


def test_periodic_runs(spark, odd_docs, no_docs):
    rng = random.Random(6)
    texts = [r.text or "" for r in odd_docs.collect()] + [" ".join(map(str, periodic_words(rng, n))) for n in (11, 12, 13, 500, 3000)] + ["a b c d e f g " * 400, "x\x0by\x0cz\n" * 9, "é\xa0b " * 12]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in periodic.periodic_runs(docs, together=4000).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        words = words_of(text)
        want = plain_runs(words)
        assert [tuple(r) for r in got[k].runs] == want and got[k].collapsed == collapsed(words, want) and got[k].n_words == len(words)
    rows = periodic.periodic_runs(odd_docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd_docs.collect())
    assert periodic.periodic_runs(no_docs).collect() == []


def test_long_text_in_parts(monkeypatch):
    rng = random.Random(8)
    words = periodic_words(rng, 3000)
    monkeypatch.setattr(periodic, "CHUNK", 256)
    monkeypatch.setattr(periodic, "SLICE", 100)
    raw = " ".join(map(str, words)).encode()
    for runs, _ in periodic.runs_of_texts([b"", raw, raw + b" end"]):
        assert not runs or runs[:3] == plain_runs(words)[:3]
    assert periodic.runs_of_texts([raw])[0][0] == plain_runs(words)


def test_runs_query(spark, texts):
    rows = {r.doc_id: r for r in queries.op12_runs(spark, DATA).collect()}
    assert set(rows) == set(texts)
    for k, text in texts.items():
        words = words_of(text)
        n, h = len(words), zlib.crc32(str(k).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = plain_runs(words) if n < 1500 else periodic.runs_of_texts([" ".join(words).encode()])[0][0]
        s, m, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        r = rows[k]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), s, m, q) and r.exponent_milli == (1000 * m // q if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert sum(r.n_runs > 0 for r in rows.values()) > 10


# exact duplicates


def test_fuse_filter():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 1000, 30_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        f = FuseFilter.build(keys)
        assert f.has(keys).all()
        other = rng.integers(1 << 63, (1 << 64) - 1, 20_000, np.uint64)
        assert n < 3 or f.has(other).mean() < 0.01
    assert len(f.prints) < 1.3 * 30_000


def groups_of(rows):
    """(doc_id, keep_id, size) of (doc_id, text) rows, and how many rows stay."""
    under = defaultdict(list)
    for k, t in rows:
        under["".join(c for c in t or "" if c not in " \t\n\v\f\r")].append((-len(t or ""), k is None, k or 0, k))
    return Counter((x[3], min(v)[3], len(v)) for v in under.values() for x in v), len(under)


WEAK = {"whole": F.xxhash64, "eight digests": lambda c: F.shiftleft(F.pmod(F.xxhash64(c), F.lit(8)), 61), "one digest": lambda c: F.lit(5).cast("long") + 0 * F.length(c)}


@pytest.mark.parametrize("digest", WEAK)
def test_dedup_store(spark, odd_docs, no_docs, digest):
    """Three arrivals with texts in common, an empty one, and digests that different texts share: bytes decide."""
    rng = random.Random(2)
    texts = ["a b", "ab", "a\tb\n", " ab  ", "", None, "\x0b", "=", "=ab", "x" * 5000, "x " * 5000, "é", "é", "\xa0"] + [f"t{i}" for i in range(40)]
    rows = [(i, rng.choice(texts)) for i in range(400)] + [(7, "ab"), (7, "ab"), (None, "a b"), (None, "zz")]
    rng.shuffle(rows)
    store = exact.DedupStore(spark, new_folder(spark, "dedup"), shard_keys=4, digest=WEAK[digest])
    parts = [rows[:150], [], rows[150:200], rows[200:]]
    for part in parts:
        store.add(spark.createDataFrame(part, "doc_id long, text string").repartition(3) if part else no_docs)
    got = store.report().collect()
    want, kept = groups_of(rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == kept and all(r.doc_id == r.keep_id for r in got if r.kept)
    first = {}  # the arrival that had each text first
    for k, part in enumerate(parts, 1):
        for _, t in part:
            first.setdefault(hashlib.sha256("".join(c for c in t or "" if c not in " \t\n\v\f\r").encode()).digest(), k)
    assert {(bytes(r.sha), r.home) for r in got} == set(first.items())


def test_dedup_hot_text_and_retry(spark, odd_docs):
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one  text").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"), F.lit(1).alias("snapshot"), F.lit("x").alias("digest"))
    store = exact.DedupStore(spark, new_folder(spark, "dedup"))
    store.add(hot)
    spark.range(5).write.parquet(f"{store.path}/rows/snapshot=2")  # what a writer left that died
    assert store.snapshots() == 1
    store.add(odd_docs)
    got = store.report().collect()
    want, kept = groups_of([(r.doc_id, r.text) for r in hot.collect()] + [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want and sum(r.kept for r in got) == kept


def test_dedup_query(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = c.execute(queries.OP13_SQL).fetchall()
    rows = queries.op13_exact_dedup(spark, DATA).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, rows)) == sorted(want)


# shards of different columns, caches


def test_store_keeps_every_column(spark):
    from stallkeeper.llm.compaction import ShardStore

    store = ShardStore(spark, new_folder(spark, "shards"), target=1 << 20)
    part = lambda rows, columns: spark.createDataFrame(rows, columns).repartition(2)
    for k in range(3):
        store.append(part([(k, f"t{k}"), (k + 10, None)], "doc_id long, text string"))
    store.append(part([(3, "t3", "en"), (4, "t4", None)], "doc_id long, text string, lang string"))  # a column more
    store.append(part([("fr", 5)], "lang string, doc_id long"))  # one less, in another order
    want = sorted([(k, f"t{k}", None) for k in range(3)] + [(k + 10, None, None) for k in range(3)] + [(3, "t3", "en"), (4, "t4", None), (5, None, "fr")], key=str)
    read = lambda: sorted(map(tuple, store.rows().select("row.*").collect()), key=str)
    assert store.rows().select("row.*").columns == ["doc_id", "text", "lang"] and read() == want
    with pytest.raises(ValueError, match="doc_id"):
        store.append(part([("x", "t")], "doc_id string, text string"))  # another type
    with pytest.raises(ValueError, match="Text"):
        store.append(part([(9, "t")], "doc_id long, Text string"))
    before = store.version()
    store.compact()
    assert store.version() > before and read() == want
    store.vacuum()
    assert read() == want
    kept = len(store.fs.listStatus(store.Path(f"{store.path}/data")))
    spark.range(3).write.parquet(f"{store.path}/data/run=a99-dead/shard=0")  # a writer died here
    assert len(store.fs.listStatus(store.Path(f"{store.path}/data"))) == kept + 1
    store.vacuum()
    assert len(store.fs.listStatus(store.Path(f"{store.path}/data"))) == kept + 1  # all younger than a week
    store.vacuum(0)
    assert read() == want and not store.fs.exists(store.Path(f"{store.path}/data/run=a99-dead"))
    assert ShardStore(spark, store.path, 1 << 20).columns() == store.columns()


def test_cache_of_texts_without_spaces():
    from stallkeeper.llm import subword

    rng = random.Random(4)
    model = subword.train(["good text", "bad text"], [1, 0], [0, 1], buckets=256, dim=2, least_steps=20)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(80)) for _ in range(20_000)]
    first = model.posteriors(texts[:100])
    for at in range(0, len(texts), 2000):
        model.posteriors(texts[at : at + 2000])
    assert all(not ids for ids, *_ in model.known.values())  # nothing is kept of them
    assert np.array_equal(model.posteriors(texts[:100]), first)
    model.posteriors([" ".join(f"w{i}" for i in range(at, at + 1000)) for at in range(0, 300_000, 1000)])
    (ids, rows, _), = model.known.values()
    assert len(ids) == len(rows) <= model.words and sum(map(len, ids)) <= model.words * subword.PART
    counted = model.read(np_array(["x y", "z"]), lambda parts: np.array([40_000_001] * len(parts)))[1]
    assert counted.tolist() == [80_000_002, 40_000_001]


def np_array(texts):
    import pyarrow as pa

    return pa.array(texts, pa.string())
