"""Bucketed tables: the same rows as plain joins, no shuffle of a node table, hot nodes in pieces."""

import random

import pytest
from pyspark.sql import functions as F

import motifold as mf
from motifold.sources.located import write_bucketed


def rows(df):
    return sorted(map(tuple, df.collect()))


def plan(df) -> str:
    """The plan before adaptive execution changes it."""
    return df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def graph(spark):
    """Triples in which <h> has half of all edges at either end, and many attributes."""
    rng = random.Random(5)
    uris = [f"<n{i}>" for i in range(60)]
    given = {(rng.choice(uris), f"<p{rng.randrange(3)}>", rng.choice(uris)) for _ in range(300)}
    given |= {("<h>", f"<p{i % 3}>", u) for i, u in enumerate(uris)} | {(u, f"<p{i % 2}>", "<h>") for i, u in enumerate(uris)}
    given |= {("<h>", "<label>", f'"{i}"') for i in range(90)} | {(u, "<label>", f'"{u}"') for u in uris[:20]}
    return spark.createDataFrame(sorted(given), "s string, p string, o string").cache()


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture()
def ids(spark, graph, tmp_path):
    path = str(tmp_path / "ids")
    mf.write_ids(mf.assign_dense_ids(mf.graph_nodes(graph), 10), path)
    return mf.open_bucketed(spark, path)


@pytest.fixture()
def located(spark, graph, ids, tmp_path):
    path = str(tmp_path / "graph")
    edges = mf.encode_edges(graph, ids).cache()
    props = mf.coded_props(graph, ids).cache()
    mf.write_located(mf.vertex_counts(graph, ids), edges, props, path, split_rows=16)
    return mf.open_located(spark, path), edges, path


@pytest.mark.parametrize("split_rows", [1, 20, 10_000])
def test_encoding_equals_plain_joins(graph, ids, no_broadcast, split_rows):
    assert rows(mf.encode_located(graph, ids, split_rows=split_rows)) == rows(mf.encode_edges(graph, ids))
    repeated = graph.unionByName(graph)
    assert rows(mf.encode_located(repeated, ids, split_rows=split_rows)) == rows(mf.encode_edges(graph, ids))
    assert mf.encode_located(repeated, ids, False, split_rows).count() == 2 * mf.encode_edges(graph, ids).count()


def test_encoding_leaves_out_nodes_without_an_id(spark, graph, ids, no_broadcast):
    more = graph.unionByName(spark.createDataFrame([("<new>", "<p0>", "<h>"), ("<h>", "<p0>", "<new>")], graph.schema))
    for split_rows in (1, 10_000):
        assert rows(mf.encode_located(more, ids, split_rows=split_rows)) == rows(mf.encode_edges(graph, ids))
    assert mf.encode_located(graph.limit(0), ids).count() == 0


def test_encoding_shuffles_triples_only(graph, ids, no_broadcast):
    made = plan(mf.encode_located(graph, ids, distinct=False)).split("\n")
    shuffles = [line for line in made if "Exchange hashpartitioning" in line]
    # One for either end; the dictionary is read in its buckets.
    assert len(shuffles) == 2 and all("#key" in line for line in shuffles)


def test_views_equal_plain_joins(spark, graph, ids, located, no_broadcast):
    tables, edges, _ = located
    heads = mf.vertex_counts(graph, ids)
    want = mf.triplet_view(heads, edges)
    assert rows(mf.located_view(tables)) == rows(want)
    names = ["src", "src_uri", "src_n_props", "pred", "dst"]
    assert rows(mf.located_sources(tables).select(names)) == rows(want.select(names))
    names = ["dst", "dst_uri", "dst_n_props", "pred", "src"]
    assert rows(mf.located_targets(tables).select(names)) == rows(want.select(names))
    assert rows(mf.located_props(tables)) == rows(mf.attach_props(graph, heads))


def test_views_shuffle_no_node_table(located, no_broadcast):
    tables = located[0]
    for view in (mf.located_sources, mf.located_targets, mf.located_props):
        assert "Exchange" not in plan(view(tables))
    # Of the four tables of the whole view only the half-made view, besides the pieces of hot nodes for their broadcast.
    moved = [line for line in plan(mf.located_view(tables)).split("\n") if "Exchange hashpartitioning(dst" in line]
    assert len(moved) == 1


def test_a_hot_node_has_pieces_of_bounded_size(located):
    tables = located[0]
    most = tables.out.groupBy("src", "piece").count().agg(F.max("count")).first()[0]
    assert most < 40
    hot = tables.nodes.where("uri = '<h>'").select("piece").collect()
    assert sorted(r.piece for r in hot) == list(range(6))  # 90 attributes of 16 a piece
    assert tables.nodes.where("piece = 0").count() == tables.nodes.select("id").distinct().count()
    for table, key in ((tables.out, "src"), (tables.into, "dst"), (tables.props, "id")):
        assert table.join(tables.nodes, (table[key] == tables.nodes["id"]) & (table["piece"] == tables.nodes["piece"]), "left_anti").count() == 0


def test_another_session_opens_the_tables(spark, located):
    tables, edges, path = located
    other = spark.newSession()
    for name in [r.tableName for r in other.sql("SHOW TABLES").collect() if r.tableName.startswith("located_")]:
        other.sql(f"DROP TABLE {name}")
    again = mf.open_located(other, path)
    assert rows(again.out.select("src", "dst", "pred")) == rows(edges)
    other.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert "Exchange" not in plan(mf.located_sources(again))


def test_an_unfinished_write_is_made_again(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(i, "x") for i in range(30)], "k bigint, v string")
    write_bucketed(first, path, ["k"], 4)
    (tmp_path / "t" / "layout" / "_SUCCESS").unlink()
    for file in (tmp_path / "t" / "layout").iterdir():
        file.unlink()
    (tmp_path / "t" / "layout").rmdir()
    with pytest.raises(Exception):
        mf.open_bucketed(spark, path)
    write_bucketed(first.where("k < 7"), path, ["k"], 4)
    assert rows(mf.open_bucketed(spark, path)) == [(i, "x") for i in range(7)]


def test_empty_tables(spark, tmp_path):
    heads = spark.createDataFrame([], "id bigint, uri string, n_props bigint")
    edges = spark.createDataFrame([], "src bigint, dst bigint, pred string")
    props = spark.createDataFrame([], "id bigint, prop string, obj string")
    mf.write_located(heads, edges, props, str(tmp_path / "none"))
    tables = mf.open_located(spark, str(tmp_path / "none"))
    assert mf.located_view(tables).count() == 0 and mf.located_props(tables).count() == 0
