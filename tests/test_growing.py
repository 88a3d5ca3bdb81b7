"""Ids that continue, stores that take more triples, graphs loaded from several files."""

import pytest
from pyspark.sql import functions as F

import motifold as mf
from motifold.plans.jobs import load_graph, open_graph
from motifold.sources import store
from tests.tiny import iri, local, pattern, term, triples


def rows(df):
    return sorted(map(tuple, df.collect()))


def frame(spark, given):
    return spark.createDataFrame(given, "s string, p string, o string")


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_ids_continue(spark, tmp_path):
    path = str(tmp_path / "ids")
    assert mf.next_free_id(spark, path, 5) == 5 and mf.open_ids(spark, path).count() == 0
    assert rows(mf.append_ids(nodes(spark, "b", "a", "b"), path, 5)) == [(5, "a"), (6, "b")]
    assert rows(mf.append_ids(nodes(spark, "c", "b", "0"), path, 5)) == [(6, "b"), (7, "0"), (8, "c")]
    assert rows(mf.append_ids(nodes(spark, "c", "b"), path)) == [(6, "b"), (8, "c")]
    assert rows(mf.append_ids(nodes(spark).limit(0), path)) == []
    assert rows(mf.open_ids(spark, path)) == [(5, "a"), (6, "b"), (7, "0"), (8, "c")]
    assert mf.next_free_id(spark, path) == 9


def test_ids_written_without_a_head_do_not_count(spark, tmp_path):
    path = str(tmp_path / "ids")
    mf.append_ids(nodes(spark, "a"), path)
    lost = spark.createDataFrame([(1, "x")], "id bigint, uri string")
    lost.write.parquet(f"{path}/ids/batch=1")
    assert rows(mf.open_ids(spark, path)) == [(0, "a")]
    assert rows(mf.append_ids(nodes(spark, "b"), path)) == [(1, "b")]
    assert rows(mf.open_ids(spark, path)) == [(0, "a"), (1, "b")]


def test_extend_ids_leaves_old_ids_alone(spark):
    old = spark.createDataFrame([(7, "b"), (3, "z")], "id bigint, uri string")
    assert rows(mf.extend_ids(old, nodes(spark, "z", "a", "c", "a"))) == [(8, "a"), (9, "c")]
    assert rows(mf.extend_ids(old.limit(0), nodes(spark, "z"), 4)) == [(4, "z")]
    assert rows(mf.extend_ids(old, nodes(spark).limit(0))) == []


@pytest.fixture()
def grown(spark, tmp_path):
    """The tiny graph in three overlapping parts, and whole."""
    given = triples()
    path, whole = str(tmp_path / "grown"), str(tmp_path / "whole")
    added = [mf.append_store(frame(spark, part), path) for part in (given[:12] * 2, given[8:20], given[15:] + given[:3])]
    mf.write_store(mf.dedup_triples(frame(spark, given)), whole)
    return path, whole, added


QUERIES = (
    [pattern("?x", "takesCourse", "?y"), pattern("?x", "advisor", "?p"), pattern("?p", "teacherOf", "?y")],
    [pattern("?x", "name", "?n"), pattern("?x", "memberOf", "d1")],
)


def test_appends_answer_as_one_write(spark, grown):
    path, whole, added = grown
    a, b = mf.open_store(spark, path), mf.open_store(spark, whole)
    assert rows(a.all().select("s", "p", "o")) == rows(b.all().select("s", "p", "o"))
    assert sum(added) == b.all().count() and all(added)
    assert rows(mf.store_catalog(spark, path)) == rows(mf.store_catalog(spark, whole))
    for patterns in QUERIES:
        assert rows(mf.match_bgp(a, patterns)) == rows(mf.match_bgp(b, patterns))
    assert mf.append_store(frame(spark, triples()), path) == 0
    assert mf.store_batches(spark, path) == [1, 2, 3]


def test_compaction_changes_no_answer(spark, grown):
    path, whole, _ = grown
    before = mf.open_store(spark, path)
    mf.compact_store(spark, path, first=2)
    assert mf.store_batches(spark, path) == [1, 4]
    mf.append_store(frame(spark, [pattern("s9", "advisor", "p1")]), path)
    mf.compact_store(spark, path)
    assert mf.store_batches(spark, path) == [6]
    after = mf.open_store(spark, path)
    one = [tuple(pattern("s9", "advisor", "p1"))]
    assert rows(after.all().select("s", "p", "o")) == sorted(rows(before.all().select("s", "p", "o")) + one)
    want = dict((r.p, (r.kind, r.n, r.functional)) for r in mf.store_catalog(spark, whole).collect())
    kind, n, functional = want[iri("advisor")]
    want[iri("advisor")] = (kind, n + 1, functional)
    assert {r.p: (r.kind, r.n, r.functional) for r in mf.store_catalog(spark, path).collect()} == want
    mf.compact_store(spark, path)
    assert mf.store_batches(spark, path) == [6]


def test_a_second_object_ends_a_functional_predicate(spark, tmp_path):
    path = str(tmp_path / "store")
    mf.write_store(frame(spark, [("a", "p", "x"), ("a", "q", "x"), ("b", "r", "x")]), path)
    assert mf.append_store(frame(spark, [("a", "p", "y"), ("b", "q", "x"), ("b", "r", '"1"'), ("b", "r", "x")]), path) == 3
    assert rows(mf.store_catalog(spark, path)) == [("p", "object", 2, False), ("q", "object", 2, True), ("r", "data", 2, False)]
    assert mf.append_store(frame(spark, [("a", "p", "x"), ("a", "p", "z"), ("c", "q", "1"), ("c", "q", "2")]), path) == 3
    assert rows(mf.store_catalog(spark, path)) == [("p", "object", 3, False), ("q", "object", 4, False), ("r", "data", 2, False)]


def test_an_append_is_seen_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "store")
    mf.write_store(frame(spark, [("a", "p", "x")]), path)
    lost = store.begin_append(frame(spark, [("a", "p", "y"), ("c", "z", "d")]), path)
    assert lost.number == 1 and mf.open_store(spark, path).all().count() == 1
    again = store.begin_append(frame(spark, [("e", "p", "x")]), path)
    assert again.number == 1 and store.commit_append(spark, again) == 1
    assert rows(mf.open_store(spark, path).all().select("s", "p", "o")) == [("a", "p", "x"), ("e", "p", "x")]
    assert mf.append_store(frame(spark, []), path) == 0


def test_append_reads_only_touched_predicates(spark, tmp_path, capsys):
    path = str(tmp_path / "store")
    mf.write_store(frame(spark, [("a", p, "x") for p in "pqr"]), path)
    mf.append_store(frame(spark, [("b", "q", "x")]), path)
    mf.open_store(spark, path).scan("q").explain("formatted")
    plan = capsys.readouterr().out
    filters = next(line for line in plan.split("\n") if "PartitionFilters" in line)
    assert "batch" in filters and "p#" in filters
    batch = store.begin_append(frame(spark, [("c", "q", "x"), ("a", "q", "x")]), path)
    assert rows(batch.triples) == [("c", "q", "x")]


def write_lines(path, given):
    path.write_text("".join(f"{s} {p} {o} .\n" for s, p, o in given))
    return str(path)


def graph_rows(spark, target):
    """Attributes and edges with uris for ids, and the ids."""
    _, vertices, edges = open_graph(spark, target)
    uris = dict(vertices.select("id", "uri").collect())
    assert len(set(uris.values())) == len(uris)
    bags = vertices.select("uri", F.explode("props").alias("x")).select("uri", "x.prop", "x.obj")
    named = [(uris[r.src], r.pred, uris[r.dst]) for r in edges.collect()]
    return rows(bags), sorted(named), uris


def test_graph_from_several_files_equals_one(spark, tmp_path):
    given = triples()
    files = [write_lines(tmp_path / f"{i}.nt", part) for i, part in enumerate((given[:14], given[10:24], given[20:]))]
    target, whole = str(tmp_path / "g"), str(tmp_path / "w")
    free = [load_graph(spark, file, target, start=3, append=True) for file in files]
    early = graph_rows(spark, target)[2]
    assert load_graph(spark, files[1], target, append=True) == free[-1]
    assert graph_rows(spark, target)[2] == early
    end = load_graph(spark, write_lines(tmp_path / "w.nt", given), whole, start=3)
    grown, single = graph_rows(spark, target), graph_rows(spark, whole)
    assert grown[:2] == single[:2] and free[-1] == end
    assert sorted(grown[2]) == sorted(single[2]) and set(grown[2].values()) == set(single[2].values())
    first = graph_rows_of_first(spark, files[0], tmp_path)
    assert {i: grown[2][i] for i in first} == first


def graph_rows_of_first(spark, file, tmp_path):
    load_graph(spark, file, str(tmp_path / "one"), start=3)
    return graph_rows(spark, str(tmp_path / "one"))[2]


def test_a_load_that_failed_is_made_again(spark, tmp_path, monkeypatch):
    given = triples()
    target = str(tmp_path / "g")
    load_graph(spark, write_lines(tmp_path / "a.nt", given[:14]), target, append=True)
    before = graph_rows(spark, target)
    second = write_lines(tmp_path / "b.nt", given[14:])

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr("motifold.plans.jobs.commit_append", fail)
        with pytest.raises(OSError):
            load_graph(spark, second, target, append=True)
    assert graph_rows(spark, target) == before
    load_graph(spark, second, target, append=True)
    load_graph(spark, write_lines(tmp_path / "w.nt", given), str(tmp_path / "w"))
    assert graph_rows(spark, target)[:2] == graph_rows(spark, str(tmp_path / "w"))[:2]
    plan = mf.match_bgp(open_graph(spark, target)[0], [pattern("?x", "advisor", "?y")])
    assert local(plan) == [("s1", "p1"), ("s2", "p2")] and term("?x") == "?x"
