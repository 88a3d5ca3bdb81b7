"""New and stored triples meet in the ranges of the writer."""

import random

import pytest
from pyspark.sql import functions as F

import motifold as mf
from motifold.sources import store


def test_cut_strings_keep_their_order(spark):
    words = ["", "a", "ab", "abc", "abc0", "abca", "abcz", "abd", "b", "é", "abcé", "abc\U0001f600", "abb￿", "zz"]
    for common in ("", "abc", "é"):
        df = spark.createDataFrame([(w, common) for w in words], "s string, `#sp` string").withColumn("k", store._cut("s", "#sp"))
        found = df.select("s", "k", store._uncut("`k`", "#sp").alias("back")).collect()
        assert all(r["s"] == r["back"] for r in found)
        assert [r["s"] for r in sorted(found, key=lambda r: bytes(r["k"]))] == sorted(words, key=lambda w: w.encode())


@pytest.mark.parametrize("small", [store.SMALL_ROWS, 0])
def test_random_batches_add_up(spark, tmp_path, monkeypatch, small):
    """Repeats, known triples, subjects with a second object and terms that do not begin as the others do."""
    monkeypatch.setattr(store, "SMALL_ROWS", small)
    monkeypatch.setattr(store, "COMMON_ROWS", 4)
    rng = random.Random(7)
    path, held = str(tmp_path / "grown"), set()
    for batch in range(3):
        given = [(f"<urn:n:{rng.randrange(40)}>", f"p{rng.randrange(3)}", f"<urn:o:{rng.randrange(4)}>") for _ in range(60)]
        given += [(f"<urn:n:{i}>", "one", f'"{i}"') for i in range(20 * batch, 20 * batch + 25)]
        given += [("odd", "one", "é" * (batch // 2)), ("<urn:n:3>", "late", "x"), ("<urn:n:3>", "late", "y" if batch == 2 else "x")]
        added = mf.append_store(spark.createDataFrame(given, "s string, p string, o string"), path)
        assert added == len(set(given) - held)
        held |= set(given)
        assert sorted(map(tuple, mf.open_store(spark, path).all().select("s", "p", "o").collect())) == sorted(held)
        subjects = {p: [s for s, q, _ in held if q == p] for p in {q for _, q, _ in held}}
        found = {r["p"]: (r["n"], r["functional"]) for r in mf.store_catalog(spark, path).collect()}
        assert found == {p: (len(s), len(s) == len(set(s))) for p, s in subjects.items()}
    mf.compact_store(spark, path, first=2)
    assert sorted(map(tuple, mf.open_store(spark, path).all().select("s", "p", "o").collect())) == sorted(held)


def test_an_append_moves_short_rows_once(spark, tmp_path):
    """A row of the writer's shuffle has neither predicate nor the beginning of its terms."""
    path = str(tmp_path / "g")
    rows = spark.range(2000).select(F.format_string("<urn:long:beginning:%07d>", "id").alias("s"), F.lit("<urn:p>").alias("p"), F.lit("o").alias("o"))
    mf.append_store(rows.where("id < 1000"), path)
    common = store._common_parts(rows, ["<urn:p>"])
    assert common[0][2].startswith("<urn:long:beginning:000") and common[0][1] == "0"
    assert mf.append_store(rows, path) == 1000
