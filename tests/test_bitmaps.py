"""Bitmaps of predicates and characteristic sets against the joins that they replace."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import motifold as mf
from motifold.plans.bgp import _join_order, prepare
from tests.tiny import iri, pattern, triples


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def tiny(spark):
    return mf.dedup_triples(spark.createDataFrame(triples(), "s string, p string, o string")).cache()


@pytest.fixture(scope="module")
def spread(spark):
    """Subjects over several buckets: every subject has ``all``; ``b`` and ``c`` by chance, some ids next to bucket ends."""
    rng = random.Random(6)
    ids = sorted({0, 7, 8, 32767, 32768, 65535, 65536, *(rng.randrange(200_000) for _ in range(300))})
    dictionary = spark.createDataFrame([(i, f"n{i}") for i in ids], "id bigint, uri string")
    given = [(f"n{i}", "all", "x") for i in ids]
    given += [(f"n{i}", "b", f'"{rng.randrange(3)}"') for i in ids if rng.random() < 0.6]
    given += [(f"n{i}", "c", f"n{rng.choice(ids)}") for i in ids for _ in range(rng.randrange(3))]
    return mf.dedup_triples(spark.createDataFrame(given, "s string, p string, o string")).cache(), dictionary


STARS = [
    [("all", "?")],
    [("all", "?x"), ("b", "?y")],
    [("b", '"1"')],
    [("b", '"1"'), ("c", "?z")],
    [("b", '"1"'), ("b", '"2"')],
    [("b", '"9"'), ("all", "?")],
    [("zz", "?"), ("all", "?")],
]


def test_bitmap_stars_equal_joins(spark, spread, tmp_path):
    t, ids = spread
    assert mf.listable_predicates(t, 3) == ["b"]
    whole = mf.predicate_bitmaps(t, ids, ["b"])
    # The same in two batches of triples, added to one table.
    first = t.where(F.crc32("o") % 2 == 0)
    for part in (first, t.join(first, ["s", "p", "o"], "left_anti")):
        mf.write_bitmaps(mf.predicate_bitmaps(part, ids, ["b"]), str(tmp_path / "bits"))
    for bitmaps in (whole, mf.open_bitmaps(spark, str(tmp_path / "bits"))):
        for star in STARS:
            want = rows(mf.match_star(t, star).join(ids, F.col("s") == F.col("uri")).select("id"))
            assert rows(mf.bitmap_ids(mf.star_bitmap(bitmaps, star))) == want
            assert mf.count_star_bitmaps(bitmaps, star).first()["n"] == len(want)
    with pytest.raises(ValueError):
        mf.star_bitmap(whole, [("c", "n7")])
    with pytest.raises(ValueError):
        mf.star_bitmap(whole, [])


def test_rows_filtered_by_bitmap(spark, spread):
    t, ids = spread
    star = mf.star_bitmap(mf.predicate_bitmaps(t, ids, ["b"]), STARS[3])
    edges = mf.encode_edges(t.where("p = 'c'"), ids)
    want = rows(edges.join(mf.bitmap_ids(star).withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst"))
    assert rows(mf.filter_by_bitmap(edges, "src", star).select("src", "dst")) == want and want


def test_counts_from_bitmaps_need_no_join(spark, spread, capsys, tmp_path):
    t, ids = spread
    mf.write_bitmaps(mf.predicate_bitmaps(t, ids, ["b"]), str(tmp_path / "bits"))
    mf.count_star_bitmaps(mf.open_bitmaps(spark, str(tmp_path / "bits")), STARS[3]).explain("formatted")
    plan = capsys.readouterr().out
    assert "Join" not in plan and "PartitionFilters" in plan


def brute_sets(given):
    per = defaultdict(Counter)
    for s, p, _ in set(given):
        per[s][p] += 1
    out = defaultdict(list)
    for counts in per.values():
        out[tuple(sorted(counts))].append(counts)
    return {key: (len(x), [sum(c[p] for c in x) for p in key]) for key, x in out.items()}


def test_characteristic_sets(spark, tiny, spread):
    for t in (tiny, spread[0]):
        sets = mf.characteristic_sets(t).cache()
        given = [tuple(r) for r in t.select("s", "p", "o").collect()]
        assert {tuple(r.predicates): (r.n_subjects, list(r.n_triples)) for r in sets.collect()} == brute_sets(given)
        names, rng = sorted({p for _, p, _ in given}), random.Random(3)
        for _ in range(5):
            some = rng.sample(names, 2)
            want = mf.count_star(t, [(p, "?") for p in some]).first()["n"]
            assert mf.count_star_sets(sets, some).first()["n"] == want
            one = mf.match_bgp(t, [("?s", some[0], "?o"), ("?s", some[1], "?q")], bind_data=True).select("s", "o").distinct()
            assert mf.star_rows(sets, some[:1], some[1:]).first()["n"] == one.count()
    assert mf.characteristic_sets(tiny.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mf.count_star_sets(sets, [])


def test_sets_put_the_smaller_star_first(spark, tmp_path):
    """``big`` has most triples, but few of its subjects have the rare attribute: then it starts the join."""
    given = [(f"n{i}", "big", f"m{i % 50}") for i in range(1000)] + [(f"m{i % 50}", "mid", f"k{i}") for i in range(300)]
    given += [(f"n{i}", "rare", f'"{i}"') for i in range(3)]
    path = str(tmp_path / "store")
    mf.write_store(spark.createDataFrame(given, "s string, p string, o string"), path)
    patterns = [("?x", "big", "?m"), ("?m", "mid", "?k"), ("?x", "rare", "?r")]

    def first():
        source, query = prepare(mf.open_store(spark, path), patterns, False, False)
        ordered = _join_order(query, source.relations())
        return [(r.variables, r.rows) for r in ordered]

    assert first() == [(("m", "k"), 300), (("x", "m"), 1000)]
    want = rows(mf.match_bgp(mf.open_store(spark, path), patterns))
    mf.write_sets(spark, path)
    assert first() == [(("x", "m"), 3), (("m", "k"), 300)]
    assert rows(mf.match_bgp(mf.open_store(spark, path), patterns)) == want and want
    mf.append_store(spark.createDataFrame([("n7", "rare", '"7"')], "s string, p string, o string"), path)
    assert mf.stored_sets(spark, path) is None and first()[0] == (("m", "k"), 300)
    mf.write_sets(spark, path)
    assert first()[0] == (("x", "m"), 4)


def test_bitmaps_of_the_tiny_graph(spark, tiny):
    ids = mf.assign_dense_ids(mf.graph_nodes(tiny))
    bitmaps = mf.predicate_bitmaps(tiny, ids, [mf.RDF_TYPE, iri("name")])
    star = [pattern("?x", "name", "?n")[1:], pattern("?x", "memberOf", "?d")[1:]]
    assert mf.count_star_bitmaps(bitmaps, star).first()["n"] == 2
    typed = [pattern("?x", "type", "GraduateStudent")[1:], *star]
    found = ids.join(mf.bitmap_ids(mf.star_bitmap(bitmaps, typed)), "id")
    assert [r["uri"] for r in found.collect()] == [iri("s1")]
