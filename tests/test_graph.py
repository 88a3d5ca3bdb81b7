"""Ids, property bags, vertices, edges."""

import pytest
from pyspark.sql import functions as F

import motifold as mf
from motifold.session import stage, work_dir
from tests.tiny import local, triples

SCHEMA = "s string, p string, o string"


@pytest.fixture(scope="module")
def graph(spark):
    return spark.createDataFrame(sorted(set(triples())), SCHEMA).cache()


def test_dense_ids_follow_uri_order(spark):
    names = [f"<n{(i * 7919) % 5000:05d}>" for i in range(5000)]
    nodes = spark.createDataFrame([(n,) for n in names], "node string").repartition(7)
    ids = mf.assign_dense_ids(nodes, 100)
    expected = {n: i + 100 for i, n in enumerate(sorted(names))}
    assert {r["uri"]: r["id"] for r in ids.collect()} == expected
    assert mf.next_id(ids).first()["next_id"] == 5100
    again = {r["uri"]: r["id"] for r in mf.assign_dense_ids(nodes, 100).collect()}
    assert again == expected


def test_ids_of_nothing(spark):
    nodes = spark.createDataFrame([], "node string")
    ids = mf.assign_dense_ids(nodes, 9)
    assert ids.count() == 0
    assert mf.next_id(ids, 9).first()["next_id"] == 9


def test_hash_ids(spark, graph):
    ids = mf.assign_ids(mf.graph_nodes(graph))
    assert mf.id_collisions(ids).count() == 0
    doubled = ids.unionByName(ids.limit(1))
    assert mf.id_collisions(doubled).first()["n"] == 2
    joined = sorted(map(tuple, mf.encode_edges(graph, ids).collect()))
    assert joined == sorted(map(tuple, mf.encode_edges_hashed(graph).collect()))


def test_node_sets(graph):
    expected = {t for s, _, o in triples() for t in (s, o)}
    assert {r["node"] for r in mf.node_set(graph).collect()} == expected
    edges = [(s, p, o) for s, p, o in triples() if not o.startswith('"') and p != mf.RDF_TYPE]
    expected = {s for s, _, _ in triples()} | {o for _, _, o in edges}
    assert {r["node"] for r in mf.graph_nodes(graph).collect()} == expected


def test_bags_are_dealt_and_whole(spark):
    hot = [("<hub>", "<v>", f'"{i}"') for i in range(1000)]
    rest = [(f"<n{i}>", "<v>", f'"{i % 3}"') for i in range(50)]
    t = spark.createDataFrame(hot + rest + hot[:10], SCHEMA)
    bags = mf.property_bag(t, parts=16).collect()
    hub = [r for r in bags if r["s"] == "<hub>"]
    assert len(hub) == 16 and max(len(r["props"]) for r in hub) < 200
    assert sorted(x["obj"] for r in hub for x in r["props"]) == sorted(o for _, _, o in hot)
    assert {(r["s"], len(r["props"])) for r in bags if r["s"] != "<hub>"} == {(s, 1) for s, _, _ in rest}
    assert len(mf.property_bag(t, parts=1).collect()) == 51
    vertices = mf.build_vertices(t, mf.assign_ids(mf.graph_nodes(t)), parts=16)
    heads = {r["uri"]: r["n_props"] for r in mf.vertex_heads(vertices).collect()}
    assert heads["<hub>"] == 1000 and heads["<n3>"] == 1


def test_vertices(graph):
    vertices = mf.build_vertices(graph, mf.assign_dense_ids(mf.graph_nodes(graph)))
    heads = dict(local(mf.vertex_heads(vertices), "uri", "n_props"))
    # type, name, label, two mail addresses; the label that is a node is an edge
    assert heads["s1"] == 4 and heads["s2"] == 3 and heads["u1"] == 1
    vertices = mf.build_vertices(graph, mf.assign_dense_ids(mf.graph_nodes(graph)), parts=1)
    counted = dict(local(mf.vertex_counts(graph, vertices.select("id", "uri")), "uri", "n_props"))
    assert counted == heads
    s1 = [r for r in vertices.collect() if r["uri"].endswith("#s1>")]
    assert [x["obj"] for x in s1[0]["props"] if x["prop"].endswith("#name>")] == ['"Ann"']
    has_name = mf.bag_has(vertices["props"], s1[0]["props"][0]["prop"])
    assert vertices.where(has_name).count() >= 1
    exact = mf.bag_has(vertices["props"], mf.RDF_TYPE, s1[0]["props"][-1]["obj"])
    assert local(vertices.where(exact), "uri") == [("s1",)]


def test_merge_keeps_the_largest_copy(spark):
    schema = "id bigint, uri string, part bigint, props array<struct<prop:string,obj:string>>"
    pair = ("<p>", '"x"')
    a = spark.createDataFrame([(1, "<a>", 0, []), (2, "<b>", 0, [pair])], schema)
    b = spark.createDataFrame([(1, "<a>", 0, [pair, pair])], schema)
    merged = {r["uri"]: len(r["props"]) for r in mf.merge_vertices([a, b]).collect()}
    assert merged == {"<a>": 2, "<b>": 1}


def test_merge_keeps_one_copy_whole(spark):
    large = [("<hub>", "<v>", f'"{i}"') for i in range(100)]
    small = large[:60]
    nodes = spark.createDataFrame([("<hub>",)], "node string")
    ids = mf.assign_ids(nodes)
    for parts in (1, 4, 64):
        copies = [mf.build_vertices(spark.createDataFrame(t, SCHEMA), ids, parts) for t in (small, large)]
        merged = mf.merge_vertices(copies).collect()
        pairs = [x["obj"] for r in merged for x in r["props"]]
        assert len(pairs) == 100 and len(set(pairs)) == 100


def test_attributes_are_read_once(spark, tmp_path, capsys):
    path = str(tmp_path / "t")
    spark.createDataFrame([("<a>", "<v>", '"1"')], SCHEMA).write.parquet(path)
    mf.property_bag(spark.read.parquet(path)).explain()
    assert capsys.readouterr().out.count("FileScan") == 1


def test_ids_with_one_hash_are_refused(spark):
    nodes = spark.createDataFrame([("<a>",), ("<b>",)], "node string")
    with pytest.raises(ValueError):
        mf.assign_ids(nodes, lambda c: F.lit(1).cast("bigint"))


def test_triplets_and_edges(graph):
    ids = mf.assign_dense_ids(mf.graph_nodes(graph))
    edges = mf.encode_edges(graph, ids)
    heads = mf.vertex_heads(mf.build_vertices(graph, ids))
    view = mf.triplet_view(heads, edges)
    assert view.count() == edges.count() == 16
    found = set(local(view, "src_uri", "pred", "dst_uri", "src_n_props", "dst_n_props"))
    assert ("p1", "headOf", "d1", 2, 1) in found
    assert mf.attach_props(graph, ids).count() == mf.data_triples(graph).count()
    assert mf.attach_props(graph, ids, split_rows=2).count() == mf.data_triples(graph).count()
    objects = {o for _, _, o in triples()} & {r["uri"] for r in ids.collect()}
    assert {r["uri"] for r in mf.object_nodes(graph, ids).collect()} == objects


def test_stage_uses_the_configured_folder(spark, shared_folder):
    assert work_dir(spark) == str(shared_folder)
    assert stage(spark.range(5), "numbers").count() == 5
    assert len([p for p in shared_folder.iterdir() if p.name.startswith("numbers-")]) == 1
