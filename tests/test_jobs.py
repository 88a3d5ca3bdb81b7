"""The three jobs end to end on the tiny graph."""

import pytest

import motifold as mf
from motifold.__main__ import main
from motifold.plans.jobs import answer, load_graph, open_triples
from tests.tiny import PREFIX, iri, local, pattern, triples


@pytest.fixture()
def file(tmp_path):
    path = tmp_path / "graph.nt"
    path.write_text("".join(f"{s} {p} {o} .\n" for s, p, o in triples()))
    return str(path)


def test_load(spark, file, tmp_path):
    target = str(tmp_path / "g")
    nodes = mf.graph_nodes(mf.read_triples(spark, file)).count()
    assert load_graph(spark, file, target, start=10, text=True) == 10 + nodes
    stored = mf.open_store(spark, f"{target}/store")
    assert stored.all().count() == 30
    edges = mf.read_edge_table(spark, f"{target}/edges")
    assert edges.count() == 16
    assert mf.read_edges(spark, f"{target}/edges-text").count() == 16
    assert mf.read_vertices(spark, f"{target}/vertices-text").select("id").distinct().count() == nodes
    plan = answer(stored, [pattern("?x", "advisor", "?y")], str(tmp_path / "rows"))
    assert plan == 2
    assert local(spark.read.parquet(str(tmp_path / "rows"))) == [("s1", "p1"), ("s2", "p2")]


def test_command_line(spark, file, tmp_path, capsys):
    inferred = str(tmp_path / "inferred")
    main(["infer", file, inferred, "--prefix", PREFIX])
    assert mf.read_triples(spark, inferred).count() == 44
    question = ["--pattern", "?x", "a", iri("Student"), "--pattern", "?x", iri("takesCourse"), "?y"]
    main(["query", inferred, *question])
    main(["query", file, "--prefix", PREFIX, *question])
    main(["load", file, str(tmp_path / "g")])
    main(["query", str(tmp_path / "g"), "--stored", *question])
    out = capsys.readouterr().out.split("\n")
    assert [line for line in out if line.startswith("RESULT")] == ["RESULT 3", "RESULT 3", "RESULT 0"]


def test_stored_scan_reads_only_its_predicates(spark, file, capsys):
    source = open_triples(spark, file, PREFIX)
    assert source.all().count() == 43
    mf.match_bgp(source, [pattern("?x", "worksFor", "d1")]).explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters" in plan and "EqualTo(o," in plan
