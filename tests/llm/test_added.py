"""URL filter, whitening and periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifold.llm import periodic_runs, queries, url_filter, whitening
from motifold.llm.work import documents
from tests.llm.fixtures import no_documents, odd_documents, odd_rows

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- periodic runs -----------------------------------------------------------------------------


def brute_runs(words, repeats=4, least=6):
    """By definition: every stretch that keeps a period and cannot be extended, if no smaller period is kept in it."""
    n, found = len(words), []
    for q in range(1, n // repeats + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            start = i - q
            while i < n and words[i] == words[i - q]:
                i += 1
            length = i - start
            own = words[start:i]
            smaller = any(all(own[k] == own[k - p] for k in range(p, length)) for p in range(1, q))
            if length >= max(least, repeats * q) and not smaller:
                found.append((start, length, q))
    return sorted(found)


def brute_collapsed(words, runs):
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return [w for k, w in enumerate(words) if k not in gone]


def periodic_words(rng):
    letters = "abcdefgh"[: rng.randint(1, 8)]
    out = []
    for _ in range(rng.randint(0, 5)):
        out += rng.choices(letters, k=rng.randint(0, 12))
        unit = rng.choices(letters, k=rng.randint(1, 17))
        out += (unit * 9)[: rng.randint(0, len(unit) * 9)]
    return [x.encode() for x in out]


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_their_definition(seed):
    rng = random.Random(seed)
    seen = 0
    for _ in range(120):
        words = periodic_words(rng)
        runs = periodic_runs.runs_of(words)
        assert runs == brute_runs(words), words
        assert periodic_runs.kept_words(words, runs) == brute_collapsed(words, runs)
        seen += len(runs)
    assert seen > 60


@pytest.mark.parametrize("depth", [4, 9])
def test_runs_of_self_similar_words(depth):
    fibonacci, thue, powers = [b"a", b"b"], [b"a"], [b"a"]
    for _ in range(depth):
        fibonacci = [*fibonacci, *(w for x in fibonacci for w in ([b"a", b"b"] if x == b"a" else [b"a"]))]
        thue = thue + [b"b" if x == b"a" else b"a" for x in thue]
        powers = powers * 3 + [b"c"] if len(powers) < 200 else powers
    for words in (fibonacci[:600], thue, powers, [b"x"] * 333, [b"x", b"y"] * 150 + [b"x"] * 40):
        assert periodic_runs.runs_of(words) == brute_runs(words)


def test_chain_steps_of_one_word_repeated_are_few():
    """A text of one word, and one of a long unit with a common word: n log n steps, not n squared."""
    assert periodic_runs.runs_of([b"x"] * 200_000) == [(0, 200_000, 1)]
    rng = random.Random(5)
    unit = [rng.choice([b"the", b"the", b"w%d" % rng.randint(0, 500)]) for _ in range(5000)]
    assert (0, 50_000, 5000) in periodic_runs.runs_of(unit * 10)


def planted(doc_id, words):
    if doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected_row(doc_id, text):
    words = planted(doc_id, [w.encode() for w in WORD.findall(text or "")])
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(brute_collapsed(words, runs))
    milli = None if not runs else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_runs_query_equals_brute_force(spark, tmp_path):
    """Short given documents, odd rows and others; ids run on so that some are planted."""
    given = [r.text for r in documents(spark, SMALL).collect() if len(r.text) < 9000]
    odd = [r[1] for r in odd_rows() if r[1] is None or len(r[1]) < 9000]
    texts = given + odd + ["a b c d e f " * 5, "one " * 6, "one " * 5, "x y x y x y x y", "p q r p q r p q r p q"] * 8
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "w " * 9), (3, texts[3]), (3, texts[3])]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 10
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path)).select(COLUMNS).collect()
    want = Counter(expected_row(*row) for row in rows)
    assert Counter(tuple(r) for r in got) == want
    assert sum(n for row, n in want.items() if row[1]) > 20


def test_collapsed_documents(spark):
    docs = odd_documents(spark)
    out = periodic_runs.collapsed(docs)
    assert out.schema.names == docs.schema.names
    want = Counter()
    for r in odd_rows():
        words = [w.encode() for w in WORD.findall(r[1] or "")]
        runs = periodic_runs.runs_of(words)
        text = b" ".join(brute_collapsed(words, runs)).decode() if runs else r[1]
        want[r[0], text, len(text) if runs else r[4], r[5], r[6]] += 1
    assert Counter((r.doc_id, r.text, r.n_chars, r["keys"], r._mix) for r in out.collect()) == want
    assert periodic_runs.collapsed(no_documents(spark)).count() == 0
    assert periodic_runs.find(no_documents(spark)).count() == 0


# --- URL filter --------------------------------------------------------------------------------

URLS = [
    None, "", "://", "no scheme porn", "http://a.b.net", "http://a.b.net/", "http://NET/x?y#z", "http://xnet/", "ftp://Example.NET/en/1?sex&SEX=casino",
    "http://www.example.net/EN/1", "http://www.example.net/en", "https://m.example.com/de/?q", "https://example.com/dex/", "https://notexample.com/de/1",
    "http://q.org/fr/porn", "http://q.org/fr", "http://q.org/en/porn/porn-porn", "http://q.org/pornography", "http://q.org/casino777/casino", "http://q.org/casino777/poker",
    "http://q.org/éporn", "http://q.org/porné/xporn.XXX", "http://q.org/sexsex/sex_cams", "a://b://example.net/en/", "http://user@example.net:80/en/", "http://e.org#/fr/", "http://e.org?/fr/",
    "http://q.org/" + "sex-" * 3000 + "bet", "http://q.org/keygen", "http://q.org/keygens/keygenx", "http://q.org/line\nporn", "http://😀.org/bet/😀sex sexy",
]


def brute_url(url):
    text = url or ""
    host = path = ""
    if "://" in text:
        rest = text.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group(0)
        path = re.match(r"[^?#]*", rest[len(host) :]).group(0)
        host = "".join(c.lower() if c in url_filter._UPPER else c for c in host)
    best = None
    for r in url_filter.RULES:
        fits = (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
        if fits and (best is None or len(r.name) > len(best.name)):
            best = r
    low = "".join(c.lower() if c in url_filter._UPPER else c for c in text)
    hits = Counter()
    for term in (*url_filter.STRICT, *url_filter.SOFT):
        n = len(re.findall(rf"(?<![a-z\x80-\U0010ffff]){term}(?![a-z\x80-\U0010ffff])", low))
        if n:
            hits[term] = n
    strict = sum(n for t, n in hits.items() if t in url_filter.STRICT)
    soft = sum(n for t, n in hits.items() if t in url_filter.SOFT)
    bad = strict > 0 or len(hits) >= 2
    return host, path, best and best.name, best.verdict if best else ("block" if bad else "allow"), strict, soft, tuple(hits)


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u, "v", "h") for i, u in enumerate(URLS)] + [(None, URLS[5], None, None), (4, URLS[4], "v", "h"), (4, URLS[4], "v", "h")]
    return spark.createDataFrame(rows, "page_id long, url string, verdict string, host string").repartition(3)


def test_urls_equal_brute_force(spark, pages):
    for table in (pages, spark.read.parquet(f"{SMALL}/pages.parquet")):
        got = url_filter.judge(table).collect()
        want = Counter((r.page_id, *brute_url(r.url)) for r in table.collect())
        assert Counter((*tuple(r)[:-1], tuple(r.terms)) for r in got) == want
    assert {brute_url(u)[3] for u in URLS} == {"allow", "block"}


def test_allowed_pages(pages):
    got = url_filter.allowed(pages)
    assert got.schema == pages.schema
    assert Counter(got.collect()) == Counter(r for r in pages.collect() if brute_url(r.url)[3] == "allow")
    assert url_filter.allowed(pages.limit(0)).count() == 0 and url_filter.judge(pages.limit(0)).count() == 0


def test_vocabulary_counts_overlapping_terms():
    """Terms inside others and common suffixes, against plain search with the boundary test."""
    rng = random.Random(2)
    terms = ("a", "ab", "abc", "bc", "c-a", "a-b", "b")
    vocabulary = url_filter.Vocabulary(terms[:2], terms[2:])
    for _ in range(2000):
        text = "".join(rng.choices("abc-A1", k=rng.randint(0, 14)))
        low = text.lower()
        want = Counter()
        for t in terms:
            for i in range(len(low)):
                left, right = low[:i][-1:], low[i + len(t) :][:1]
                if low.startswith(t, i) and not left.isalpha() and not right.isalpha():
                    want[t] += 1
        assert Counter(vocabulary.names[t] for t in vocabulary.hits(text.encode())) == want
    with pytest.raises(ValueError):
        url_filter.Vocabulary(("a",), ("a",))


# --- whitening ---------------------------------------------------------------------------------


def exact_integers(rows):
    return [[int(np.floor(float(c) * 64)) for c in row] for row in rows]


@pytest.mark.parametrize("spread", [1, 10**3, 10**15])
@pytest.mark.parametrize("rows", [1, 63, 64, 200])
def test_bit_sliced_sums_are_exact(rows, spread):
    rng = np.random.default_rng(rows)
    y = rng.integers(-spread, spread + 1, (rows, 7))
    y[:, 2] = -5
    if spread > 10**9:
        y = y.astype(object)
        y[0, 3] = -(1 << 63) - 10**6
        y[-1, 4] = (1 << 63) - 1 - 10**6
    sums, products = whitening.scatter(y)
    exact = y.astype(object)
    assert sums.tolist() == exact.sum(axis=0).tolist()
    assert np.triu(products).tolist() == np.triu(exact.T @ exact).tolist()


def check_whitened(spark, rows, length):
    """``rows``: (id, vector); all conditions of the contract on the rows returned."""
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n long").repartition(3)
    good = [(i, v) for i, v, _ in rows if v and len(v) == length and all(c is not None and np.isfinite(c) for c in v)]
    y = exact_integers([v for _, v in good])
    n, sums = len(y), [sum(c) for c in zip(*y, strict=True)]
    scatter = np.array([[sum(r[i] * r[j] for r in y) * n - sums[i] * sums[j] for j in range(length)] for i in range(length)], object)
    covariance = (scatter / (n * n)).astype(float)
    values = np.linalg.eigvalsh(covariance)[::-1]
    got = whitening.whiten(table, whitening.fit(table)).collect()
    count = min(32, int((values > values[0] * length * 2.0**-50).sum()))
    assert len(got) == n * count
    per_row = defaultdict(dict)
    want = Counter()
    for (i, _), r in zip(good, y, strict=True):
        want[i, sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True))] += count
    assert Counter((r.vec_id, int(r.deviation)) for r in got) == want
    for r in got:
        assert r.n == n and r.identity_error <= 1e-4
        assert abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-6
        per_row[r.vec_id, r.component].setdefault("w", []).append(r.whitened)
    if len({i for i, _ in good}) == n:
        white = np.array([[per_row[i, k]["w"][0] for k in range(1, count + 1)] for i, _ in good])
        measured = white.T @ white / n - np.outer(white.mean(0), white.mean(0))
        assert np.abs(measured - np.eye(count)).max() < 1e-4
        centred = np.array(y, float) - np.array([s / n for s in sums])
        lines = centred.T @ white / n  # covariance with the rows: eigenvector times sqrt(e)
        for k in range(count):
            assert abs(np.linalg.norm(lines[:, k]) / np.sqrt(values[k]) - 1) < 1e-6
            assert np.allclose(covariance @ lines[:, k], values[k] * lines[:, k], atol=1e-6 * values[0] ** 1.5)


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.standard_normal(9) * [1, 2, 3, 4, 5, 6, 7, 8, 0.05]).tolist(), 0) for i in range(150)]
    bad = [None, [], [None] * 9, [1.0] * 8, [float("nan"), *[1.0] * 8], [float("inf")] * 9, [1.0] * 8 + [None]]
    rows += [(1000 + i, v, 1) for i, v in enumerate(bad)]
    check_whitened(spark, rows, 9)
    check_whitened(spark, rows + [(None, rows[0][1], 0), rows[1], rows[1]], 9)


def test_whitening_in_blocks_with_one_long_vector(spark, monkeypatch):
    rng = np.random.default_rng(9)
    monkeypatch.setattr(whitening, "BLOCK_ENTRIES", 640)
    rows = [(i, rng.standard_normal(6).tolist(), 0) for i in range(400)]
    check_whitened(spark, rows, 6)
    check_whitened(spark, [*rows, (400, [1e5, -3e4, 5.0, 2e4, 0.0, 7.0], 0)], 6)


def test_whitening_of_dependent_dimensions_and_of_nothing(spark):
    rng = np.random.default_rng(10)
    base = rng.integers(-9, 9, (60, 3)).astype(float)
    rows = [(i, [a, b, c, a + b, 2.5], 0) for i, (a, b, c) in enumerate(base.tolist())]
    check_whitened(spark, rows, 5)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n long")
    assert whitening.whiten(table.limit(1), whitening.fit(table.limit(1))).count() == 0
    assert whitening.whiten(table.limit(0), whitening.fit(table.limit(0))).count() == 0
    huge = spark.createDataFrame([(1, [1e300, 2.0], 0), (2, [-1e300, 1.0], 0), (3, [0.0, 4.0], 0)], table.schema)
    got = whitening.whiten(huge, whitening.fit(huge)).collect()
    assert {(r.vec_id, r.n) for r in got} == {(1, 3), (2, 3), (3, 3)} and {r.component for r in got} == {1}


def test_whitening_query_on_given_vectors(spark):
    """The given table: exact deviations, unit covariance."""
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    y = np.array(exact_integers([r.embedding for r in table]))
    got = queries.op12_whitening(spark, SMALL).orderBy("vec_id", "component").collect()
    n = len(y)
    assert len(got) == n * 32 and {r.n for r in got} == {n}
    away = ((n * y - y.sum(axis=0)) ** 2).sum(axis=1)
    assert [r.deviation for r in got[::32]] == away.tolist()
    white = np.array([r.whitened for r in got]).reshape(n, 32)
    assert np.abs(white.T @ white / n - np.eye(32)).max() < 1e-9
    values = np.linalg.eigvalsh(np.cov(y.T, bias=True))[::-1]
    assert np.allclose([r.explained for r in got[:32]], values[:32] / values.sum(), rtol=1e-9)
