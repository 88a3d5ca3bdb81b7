"""Steps whose cost must not grow faster than the input."""

from pyspark.sql import functions as F

import motifold as mf
from motifold.plans.bgp import Query, _join_order
from motifold.session import stage
from motifold.sources import store, tables
from motifold.sources.tables import Rule, TableTriples, Term
from motifold.sources.triples import Relation


def test_the_join_starts_where_no_hub_multiplies_its_rows(spark):
    """Small functional relations that meet at a common object would give all pairs of the object's subjects."""
    none = spark.range(0)
    trade = Relation(none, ("c", "s"), rows=4000)
    homes = [Relation(none, (v, "n"), determined_by=v, rows=100) for v in ("c", "s")]
    for given in ([*homes, trade], [homes[0], trade, homes[1]], [trade, *homes]):
        assert _join_order(Query(), given)[0] is trade
    path = [Relation(none, ("o", "c"), "o", rows=900), Relation(none, ("c", "n"), "c", rows=90)]
    assert [r.rows for r in _join_order(Query(), path[::-1])] == [900, 90]
    only = Relation(none, ("s", "n"), "s", constant=True, rows=100)
    assert _join_order(Query(), [trade, homes[0], only])[0] is only


def test_repeats_meet_in_their_range(spark, tmp_path):
    bag = spark.createDataFrame([(f"s{i % 50}", "<p>", f"o{i % 7}") for i in range(1000)], "s string, p string, o string")
    path = str(tmp_path / "bag")
    store.write_store(bag, path, distinct=True, rows=1000)
    assert mf.open_store(spark, path).all().count() == 350
    assert [tuple(r) for r in mf.store_catalog(spark, path).collect()] == [("<p>", "object", 350, False)]


def test_a_large_append_meets_the_store_once(spark, tmp_path, monkeypatch):
    """The joins for large inputs add and flag what those for small inputs do."""
    found = []
    for most in (store.SMALL_ROWS, 0):
        monkeypatch.setattr(store, "SMALL_ROWS", most)
        path = str(tmp_path / f"grown-{most}")
        for batch in ([("a", "p", "x"), ("b", "p", "x"), ("a", "q", "x"), ("a", "q", "y"), ("a", "r", "x")],
                      [("a", "p", "x"), ("b", "p", "y"), ("a", "q", "x"), ("a", "q", "z"), ("b", "r", "y"), ("c", "t", "x")]):
            mf.append_store(spark.createDataFrame(batch, "s string, p string, o string"), path)
        found.append((sorted(mf.open_store(spark, path).all().collect()), sorted(mf.store_catalog(spark, path).collect())))
    assert found[0] == found[1]
    assert {r["p"]: (r["n"], r["functional"]) for r in found[0][1]} == {
        "p": (3, False), "q": (3, False), "r": (2, True), "t": (1, True)}


def test_the_catalog_of_a_batch_shuffles_only_ends(spark, tmp_path):
    """Two triples of a subject count wherever they lie: in one Arrow batch, at the ends of two, in two files."""
    several = {"odd": [i // 2 for i in range(40)], "even": [(i + 1) // 2 for i in range(40)], "last": [*range(39), 38]}
    given = [(f"s{n:03}", p, f"o{i}") for p, found in several.items() for i, n in enumerate(found)]
    given += [(f"s{i:03}", "one", f'"{i}"') for i in range(40)] + [("s000", "rare", "o")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        for number, rows in enumerate((None, 40 * store.RANGE_ROWS)):
            path = str(tmp_path / f"s{number}")
            mf.write_store(spark.createDataFrame(given, "s string, p string, o string"), path, rows=rows)
            found = {r["p"]: (r["kind"], r["n"], r["functional"]) for r in mf.store_catalog(spark, path).collect()}
            assert found == {**{p: ("object", 40, False) for p in several}, "one": ("data", 40, True), "rare": ("object", 1, True)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    flagged = store._batch_rows(spark, path, 0).select("p", "s", F.lit(False).alias("is_data"))
    assert store._subject_ends(flagged.coalesce(1)).count() < len(given) / 2


def test_bitmaps_meet_ids_in_ranges(spark, capsys):
    """Neither a join by subject nor bitmaps of scattered ids; a subject of many objects is one row where it meets its id."""
    given = [("n0001", "many", f'"{i}"') for i in range(3000)] + [(f"n{i:04}", "flag", f'"{i % 2}"') for i in range(0, 2000, 2)]
    t = spark.createDataFrame(given, "s string, p string, o string")
    bits = mf.predicate_bitmaps(t, stage(mf.assign_dense_ids(mf.graph_nodes(t)), "ids"), ["flag"])
    bits.explain()
    plan = capsys.readouterr().out
    assert "Join" not in plan and "rangepartitioning(s" in plan
    counts = bits.select("p", "o", F.bitmap_count("bits").alias("n")).collect()
    assert sorted(map(tuple, counts), key=str) == sorted(
        [("many", None, 1), ("flag", None, 1000), ("flag", '"0"', 1000)], key=str)
    missing = mf.predicate_bitmaps(t, spark.createDataFrame([(5, "n0002")], "id bigint, uri string"), ["flag"])
    assert {(r["p"], r["o"], bytes(r["bits"])[0]) for r in missing.collect()} == {("flag", None, 32), ("flag", '"0"', 32)}


def test_a_bag_of_triples_is_not_shuffled(spark, capsys):
    rows = spark.createDataFrame([(i % 3, i % 2) for i in range(6000)], "a int, b int").coalesce(1)
    source = TableTriples(spark, [Rule("t", Term("<a", "a", ">"), "<p>", Term("<b", "b", ">"))], {"t": lambda: rows})
    bag = source.bag()
    bag.explain()
    assert "Exchange hash" not in capsys.readouterr().out
    assert sorted(bag.distinct().collect()) == sorted(source.all().collect())
    assert bag.count() <= 6 * 6000 // 1000


def test_edges_of_tables_merge_in_one_sort(spark, capsys, monkeypatch):
    """Repeated edges merge without an aggregation's tables; the view meets the targets first."""
    monkeypatch.setattr(tables, "BROADCAST_BYTES", -1)
    rows = spark.createDataFrame([(i % 30, i % 7) for i in range(2000)], "a int, b int")
    source = TableTriples(spark, [Rule("t", Term("<a", "a", ">"), "<p>", Term("<b", "b", ">"))], {"t": lambda: rows})
    ids = stage(mf.assign_dense_ids(mf.graph_nodes(source)), "ids")
    edges = mf.encode_edges(source, ids)
    edges.explain()
    assert "HashAggregate" not in capsys.readouterr().out
    view = mf.triplet_view(ids.withColumn("n_props", F.lit(0)), edges)
    view.explain()
    plan = capsys.readouterr().out
    assert plan.index("Join [src#") < plan.index("Join [dst#")
    assert sorted(view.select("src_uri", "dst_uri").collect()) == sorted(source.all().select("s", "o").collect())
    assert view.count() == 210
