"""Known answers on the tiny graph, and the semantics that need care."""

import pytest

import motifold as mf
from motifold.operators.infer import UNIVERSITY_CLASSES
from tests.tiny import PREFIX, iri, local, pattern, triples


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(triples(), "s string, p string, o string").cache()


@pytest.fixture(scope="module")
def graph(spark, raw):
    classes, predicates = mf.lubm_rules(spark, PREFIX)
    return mf.infer(raw, classes, predicates, distinct=True).cache()


def ask(graph, text, *columns, **options):
    patterns = [pattern(*part.split(" ", 2)) for part in text.split(" . ")]
    return local(mf.match_bgp(graph, patterns, **options), *columns)


def test_counts(spark, raw, graph):
    classes, predicates = mf.lubm_rules(spark, PREFIX)
    assert raw.count() == 31
    assert mf.dedup_triples(raw).count() == 30
    bag = mf.infer(raw, classes, predicates)
    assert (bag.count(), graph.count()) == (44, 43)
    assert (classes.count(), predicates.count()) == (40, 1)
    assert mf.object_triples(graph).count() == 17


def test_rule_table_covers_every_class(spark):
    classes, _ = mf.lubm_rules(spark, PREFIX)
    assert classes.select("cls").distinct().count() == len(UNIVERSITY_CLASSES) == 19
    got = local(classes.where(f"cls = '{iri('GraduateStudent')}'"))
    assert got == [("GraduateStudent", "Student")]


def test_catalog(graph):
    kinds = dict(local(mf.predicate_catalog(graph), "p", "kind"))
    data = {p for p, k in kinds.items() if k == "data"}
    assert data == {mf.RDF_TYPE, "name", "emailAddress", "label"}
    edges = "advisor headOf likes memberOf subOrganizationOf takesCourse teacherOf "
    assert set(kinds) - data == set((edges + "undergraduateDegreeFrom worksFor").split())


ANSWERS = [
    ("?x type GraduateStudent . ?x takesCourse c1", ("x",), [("s1",)]),
    (
        "?x type GraduateStudent . ?y type University . ?z type Department . "
        "?x memberOf ?z . ?z subOrganizationOf ?y . ?x undergraduateDegreeFrom ?y",
        ("x", "y", "z"),
        [("s1", "u1", "d1")],
    ),
    ("?x type Professor . ?x worksFor d1", ("x",), [("p1",), ("p2",)]),
    ("?x worksFor d1 . ?x name ?n", ("x",), [("p1",)]),
    ("?x type Student", ("x",), [("s1",), ("s2",)]),
    ("?x takesCourse ?y . p1 teacherOf ?y", ("x", "y"), [("s1", "c1"), ("s2", "c1")]),
    (
        "?x advisor ?y . ?y teacherOf ?z . ?x takesCourse ?z",
        ("x", "y", "z"),
        [("s1", "p1", "c1")],
    ),
    ("?x likes ?x", ("x",), [("p1",)]),
    ("?x advisor ?y . ?x likes ?y", ("x", "y"), [("s1", "p1")]),
    (
        "?x takesCourse ?c . ?x emailAddress ?e",
        ("x", "c"),
        [("s1", "c1"), ("s1", "c2")],
    ),
    (
        "?x advisor ?p . ?p headOf ?d . ?d subOrganizationOf ?u",
        ("x", "p", "d", "u"),
        [("s1", "p1", "d1", "u1")],
    ),
    (
        "?d subOrganizationOf ?u . ?x advisor ?p . ?p headOf ?d",
        ("x", "p", "d", "u"),
        [("s1", "p1", "d1", "u1")],
    ),
    (
        "?x advisor ?p . ?p worksFor ?d . ?d subOrganizationOf ?u",
        ("x", "p", "d", "u"),
        [("s1", "p1", "d1", "u1"), ("s2", "p2", "d1", "u1")],
    ),
]


@pytest.mark.parametrize("text, columns, expected", ANSWERS)
@pytest.mark.parametrize("probe", [0, 1 << 20])
def test_answers(graph, text, columns, expected, probe):
    assert ask(graph, text, *columns, probe_bytes=probe) == expected
    patterns = [pattern(*part.split(" ", 2)) for part in text.split(" . ")]
    assert mf.count_bgp(graph, patterns).first()["n"] == len(expected)


def test_answers_from_store(spark, graph, tmp_path):
    mf.write_store(graph, str(tmp_path / "store"))
    stored = mf.open_store(spark, str(tmp_path / "store"))
    for text, columns, expected in ANSWERS:
        assert ask(stored, text, *columns) == expected
    known = stored.catalog([iri("advisor"), iri("takesCourse"), iri("label")])
    assert known[iri("advisor")].functional and not known[iri("takesCourse")].functional
    assert known[iri("label")].is_data


# --- data patterns are existence tests ----------------------------------------


def test_bound_attributes(graph):
    text = "?x takesCourse ?c . ?x emailAddress ?e"
    assert len(ask(graph, text, bind_data=True)) == 4


def test_shared_attribute_variable_is_not_joined(graph):
    text = "?x advisor ?y . ?x name ?n . ?y name ?n"
    assert ask(graph, text, "x", "y") == [("s1", "p1")]
    assert ask(graph, text, "x", "y", "n", bind_data=True) == []


def test_mixed_predicate_is_data_and_its_nodes_match(graph):
    assert ask(graph, "?x label c1", "x") == [("s1",)]
    assert ask(graph, "?x label ?y", "x") == [("s1",), ("s2",)]


def test_short_type(graph):
    for short in ("a", "rdf:type"):
        found = mf.match_bgp(graph, [("?x", short, iri("Department"))])
        assert local(found) == [("d1",)]


def test_variable_predicate(graph):
    with pytest.raises(ValueError, match="predicate"):
        mf.match_bgp(graph, [("?x", "?p", "?y")])


def test_unknown_predicate_gives_nothing(graph):
    assert ask(graph, "?x unknown ?y", "x", "y") == []
    assert ask(graph, "?x unknown ?y . ?x advisor ?z", "x", "y", "z") == []


def test_unconnected(graph):
    text = "?x headOf ?d . ?y subOrganizationOf ?u"
    with pytest.raises(ValueError, match="not connected"):
        ask(graph, text)
    assert ask(graph, text, "x", "y", allow_cross=True) == [("p1", "d1")]
    with pytest.raises(ValueError, match="not connected"):
        ask(graph, "?x type Student . ?y type Course")


def test_linked_by_a_constant(graph):
    text = "?x memberOf d1 . ?y worksFor d1"
    expected = [("s1", "p1"), ("s1", "p2"), ("s2", "p1"), ("s2", "p2")]
    assert ask(graph, text, "x", "y") == expected
    patterns = [pattern(*part.split(" ", 2)) for part in text.split(" . ")]
    assert mf.count_bgp(graph, patterns).first()["n"] == 4
    per = local(mf.solutions_per_root(graph, patterns, "x"))
    assert per == [("s1", 2), ("s2", 2)]


def test_literal_objects_do_not_link(graph):
    with pytest.raises(ValueError, match="not connected"):
        ask(graph, '?x name "Ann" . ?y name "Ann"', bind_data=True)


def test_constant_subject_tests(graph):
    assert ask(graph, "?x advisor p1 . p1 type Professor", "x") == [("s1",)]
    assert ask(graph, "?x advisor p1 . p1 type Course", "x") == []
    assert ask(graph, "?x advisor p1 . p1 teacherOf c1", "x") == [("s1",)]
    assert ask(graph, "?x advisor p1 . p1 teacherOf c2", "x") == []


def test_only_guards(graph):
    for text, n in (('s1 name "Ann"', 1), ('s1 name "Bob"', 0), ("p1 teacherOf c1", 1)):
        patterns = [pattern(*text.split(" ", 2))]
        found = mf.match_bgp(graph, patterns)
        assert found.columns == []
        assert mf.count_solutions(found).first()["n"] == n
        assert mf.count_bgp(graph, patterns).first()["n"] == n


def test_data_only_uses_all_constraints(graph):
    assert ask(graph, "?x type Student . ?x label ?l", "x") == [("s1",), ("s2",)]
    assert ask(graph, "?x type GraduateStudent . ?x label ?l", "x") == [("s1",)]
    star = [(mf.RDF_TYPE, iri("Student")), (iri("emailAddress"), "?e")]
    assert mf.count_star(graph, star).first()["n"] == 1
    assert local(mf.match_star(graph, star, "x")) == [("s1",)]


def test_parallel_edges_are_a_conjunction(graph):
    assert ask(graph, "?p headOf ?d . ?p worksFor ?d", "p", "d") == [("p1", "d1")]


def test_long_path_in_any_order(spark):
    edges = [(f"<n{i}>", "<next>", f"<n{i + 1}>") for i in range(6)]
    t = spark.createDataFrame(edges, "s string, p string, o string")
    path = [(f"?a{i}", "<next>", f"?a{i + 1}") for i in range(6)]
    for patterns in (path, path[::-1], path[1::2] + path[::2]):
        row = mf.match_bgp(t, patterns).first().asDict()
        assert row == {f"a{i}": f"<n{i}>" for i in range(7)}
        assert mf.count_bgp(t, patterns).first()["n"] == 1


def test_variables_that_differ_in_case(spark, graph):
    patterns = [pattern("?x", "advisor", "?X")]
    with pytest.raises(ValueError, match="case"):
        mf.match_bgp(graph, patterns)
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        assert local(mf.match_bgp(graph, patterns), "x", "X") == [("s1", "p1"), ("s2", "p2")]
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_bad_patterns(graph):
    for bad in (("?x y", "<p>", "?y"), ("", "<p>", "?y"), ("?x", "<p>", None)):
        with pytest.raises(ValueError):
            mf.match_bgp(graph, [bad])
    with pytest.raises(ValueError):
        mf.match_bgp(graph, [])


def test_projection_and_root_counts(graph):
    patterns = [pattern("?x", "takesCourse", "?c"), pattern("?x", "memberOf", "?d")]
    solutions = mf.match_bgp(graph, patterns)
    assert local(mf.project_solutions(solutions, ["d"])) == [("d1",)]
    assert local(mf.project_bgp(graph, patterns, ["d"])) == [("d1",)]
    assert local(mf.project_bgp(graph, patterns, ["d", "c"])) == [("d1", "c1"), ("d1", "c2")]
    assert local(mf.solutions_per_root(graph, patterns, "x")) == [("s1", 2), ("s2", 1)]
    assert local(mf.solutions_per_root(graph, patterns, "d")) == [("d1", 3)]
    assert mf.count_solutions(solutions).first()["n"] == 3
    with pytest.raises(ValueError):
        mf.solutions_per_root(graph, patterns, "nope")
    with pytest.raises(ValueError):
        mf.project_bgp(graph, patterns, ["nope"])


def test_root_named_like_the_count(graph):
    patterns = [pattern("?x", "memberOf", "?n")]
    with pytest.raises(ValueError):
        mf.solutions_per_root(graph, patterns, "n")
    assert local(mf.solutions_per_root(graph, patterns, "n", count="k")) == [("d1", 2)]


def test_stats(graph):
    patterns = [
        pattern("?x", "type", "GraduateStudent"),
        pattern("?x", "memberOf", "?d"),
        pattern("?d", "subOrganizationOf", "?u"),
    ]
    stats = dict(local(mf.match_stats(graph, patterns, "x")))
    nodes = mf.node_set(graph).count()
    assert stats == {"nodes": nodes, "complete_roots": 2, "checked_roots": 1, "solutions": 1}
