"""Edges of tables meet the ids by key column: the same rows, and no term is moved."""

import re

import pytest
from pyspark.sql import functions as F

import motifold as mf
from motifold.session import stage
from motifold.sources import tables as source_tables
from motifold.sources.tables import Rule, TableTriples, Term


def rows(df):
    return sorted(map(tuple, df.collect()))


def shuffles(df) -> list[str]:
    """Shuffles of the plan before adaptive execution changes it."""
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x]


@pytest.fixture(scope="module")
def tables(spark):
    """Lines with repeats, nulls, a hub, text keys that look like numbers, and a constant object."""
    lines = [(i % 40, f"0{i % 7}" if i % 2 else str(i % 7), i % 3) for i in range(300)] * 2
    lines += [(None, "1", 1), (5, None, 2), (-3, "x>y", None), (7, "", 0)] + [(1, str(i), 0) for i in range(90)]
    frames = {
        "line": spark.createDataFrame(lines, "a bigint, b string, c int").cache(),
        "own": spark.createDataFrame([(i, 7 if i % 4 else None) for i in range(40)], "a bigint, c smallint").cache(),
    }
    a, b, c = Term("<a:", "a", ">"), Term("<b:", "b", ">"), Term("<c:", "c", ">")
    rules = [
        Rule("line", a, "<ab>", b), Rule("line", a, "<ac>", c), Rule("line", c, "<cb>", b), Rule("line", a, "<aa>", a),
        Rule("own", a, "<ac>", c, key=True), Rule("own", a, "<in>", Term("<it>"), key=True), Rule("line", a, "<text>", Term('"', "b", '"')),
    ]
    return TableTriples(spark, rules, {k: (lambda df=df: df) for k, df in frames.items()})


@pytest.fixture(params=[0, 1 << 25])
def joins(request, spark, monkeypatch):
    """All joins shuffled, or all broadcast."""
    monkeypatch.setattr(source_tables, "BROADCAST_BYTES", request.param)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_edges_by_key_equal_edges_by_term(spark, tables, joins, tmp_path):
    ids = stage(mf.assign_dense_ids(mf.graph_nodes(tables), 10), "ids")
    # '<a:007>' is not the node of key 7, '<a:x>' of none; a node without an id loses its edges only.
    other = spark.createDataFrame([(-1, "<a:007>"), (-2, "<a:x>"), (-3, "<a:>"), (-4, "<a>")], ids.schema)
    ids = stage(ids.where("uri <> '<a:3>'").unionByName(other), "ids")
    want = rows(mf.encode_edges(tables.all(), ids))
    assert len(want) > 300 and rows(mf.encode_edges(tables, ids, distinct=False)) == want
    path = str(tmp_path / "ids")
    mf.write_ids(ids, path)
    assert rows(mf.encode_located(tables, mf.open_bucketed(spark, path), distinct=False)) == want
    part = tables.restricted(["<cb>", "<none>"])
    assert rows(part.coded_edges(ids)) == [x for x in want if x[2] == "<cb>"]
    assert tables.restricted(["<text>"]).coded_edges(ids).count() == 0


def test_no_term_of_an_edge_is_moved(spark, tables, monkeypatch):
    monkeypatch.setattr(source_tables, "BROADCAST_BYTES", 0)
    ids = stage(mf.assign_dense_ids(mf.graph_nodes(tables)), "ids")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        part = tables.restricted(["<ab>"])
        found = shuffles(mf.encode_edges(part, ids, distinct=False))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The rows and the ids of either end; repeats need no shuffle of their own.
    assert len(found) == 4 and all("#" in x and "(s#" not in x and "(o#" not in x for x in found)


def test_the_second_join_of_located_triples_carries_no_term_of_the_first(spark, tmp_path):
    graph = spark.createDataFrame([(f"<s{i}>", "<p>", f"<o{i % 9}>") for i in range(50)], "s string, p string, o string")
    path = str(tmp_path / "ids")
    mf.write_ids(mf.assign_dense_ids(mf.graph_nodes(graph)), path)
    coded = mf.encode_located(graph, mf.open_bucketed(spark, path), distinct=False, split_rows=3)
    assert rows(coded) == rows(mf.encode_edges(graph, mf.open_bucketed(spark, path)))
    plan = coded._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"xxhash64\(p#\d+, src#", plan) and coded.where(F.col("src").isNull()).isEmpty()


def test_one_side_of_tables_is_read_by_key(spark, tables):
    plain = tables.all().cache()
    assert rows(mf.subject_nodes(tables)) == rows(plain.select("s").distinct()) == rows(mf.subject_nodes(plain))
    vertices = stage(mf.assign_ids(mf.node_set(plain)), "ids")
    want = rows(vertices.join(plain.select(F.col("o").alias("uri")), "uri", "left_semi").select("id", "uri"))
    found = mf.object_nodes(tables, vertices)
    assert rows(found.select("id", "uri")) == want == rows(mf.object_nodes(plain, vertices).select("id", "uri"))
    edges = plain.where("p <> '<text>'")
    assert rows(mf.FrameTriples(plain).ends("object", "o").distinct()) == rows(edges.select("o").distinct())
    # A column's pairs with other columns are not made first.
    assert not any("s#" in x and "o#" in x for x in shuffles(found))


def test_filtered_tables_stay_tables(spark, tables):
    kept = mf.filter_edges(tables, ["<cb>", "<in>"], keep_source=True)
    assert isinstance(kept, TableTriples)
    assert rows(kept.all()) == rows(mf.filter_edges(tables, ["<cb>", "<in>"])) != []
    assert mf.filter_edges(tables, [], keep_source=True).all().isEmpty()
    plain = tables.all()
    assert rows(mf.filter_edges(plain, ["<cb>"], keep_source=True)) == rows(plain.where("p = '<cb>'"))


def test_work_tables_are_written_compressed(spark, tmp_path):
    """The files of stages and bucketed tables, which are written once and read a few times."""
    df = spark.range(500).select("id", F.concat(F.lit("<urn:ex:n:"), "id", F.lit(">")).alias("uri"))
    staged = stage(df, "some")
    mf.write_ids(df, str(tmp_path / "ids"))
    files = [*staged.inputFiles(), *mf.open_bucketed(spark, str(tmp_path / "ids")).inputFiles()]
    assert files and all(".zstd." in f for f in files)
    assert rows(staged) == rows(df) == rows(mf.open_bucketed(spark, str(tmp_path / "ids")))
