"""The mapping of the order-entry tables and every registered query against SQL."""

import os

import pytest

import __spark_entry__ as entry
import motifold as mf
from motifold.plans.order_entry import BOUND, PATTERNS
from motifold.sources.tables import (
    CLASS_RULES,
    PREDICATE_RULES,
    Rule,
    TableTriples,
    Term,
    cls,
    node,
    pred,
    triples_from_tables,
)
from tests.oracle import compare, connect

DIRECTORY = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SMALL = DIRECTORY.endswith("sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(DIRECTORY)


@pytest.fixture(scope="module")
def source(spark):
    return triples_from_tables(spark, DIRECTORY)


@pytest.fixture(scope="module")
def inferred(source):
    return source.with_inference(CLASS_RULES, PREDICATE_RULES)


#: The training-data operators have tests of their own.
OWN = sorted(set(entry.queries()) - set(entry._llm_queries()[0]))


def test_every_query_has_sql():
    assert set(OWN) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", OWN)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, DIRECTORY)
    _, difference = compare(df, con, entry.oracle_sql()[name])
    assert difference == ""


def test_entry(spark):
    assert entry.entry(spark).count() == 59


@pytest.mark.skipif(not SMALL, reason="known counts of the smallest scale")
def test_known_counts(source, inferred):
    assert source.all().count() == 22_994
    assert source.all("object").count() == 15_927
    assert source.all("data").count() == 7_067
    assert inferred.all().count() == 25_164
    assert mf.node_set(source).count() == 2_130
    assert mf.graph_nodes(source).count() == 1_890


@pytest.mark.parametrize("table, key", [
    ("customer", "c_custkey"),
    ("supplier", "s_suppkey"),
    ("nation", "n_nationkey"),
    ("region", "r_regionkey"),
    ("part", "p_partkey"),
    ("orders", "o_orderkey"),
])
def test_declared_keys_are_unique(spark, table, key):
    rows = spark.read.parquet(f"{DIRECTORY}/{table}.parquet")
    assert rows.count() == rows.select(key).distinct().count()


@pytest.fixture(scope="module")
def frame(inferred):
    return mf.dedup_triples(inferred.all()).cache()


@pytest.mark.parametrize("name", sorted(PATTERNS))
def test_tables_and_triples_agree(inferred, frame, name):
    bound = name in BOUND
    over_tables = mf.match_bgp(inferred, PATTERNS[name], bound)
    over_triples = mf.match_bgp(frame, PATTERNS[name], bound)
    columns = sorted(over_tables.columns)
    assert columns == sorted(over_triples.columns)
    assert sorted(over_tables.select(columns).collect()) == sorted(
        over_triples.select(columns).collect()
    )


def test_other_shapes_agree(inferred, frame):
    queries = [
        # a variable bound by two kinds of subject
        [("?x", pred("locatedIn"), "?n"), ("?n", pred("partOf"), node("region", 1))],
        # two attributes and two edges of one row
        [
            ("?o", pred("placedBy"), "?c"),
            ("?o", mf.RDF_TYPE, node("ostatus", "F")),
            ("?o", pred("priority"), '"1-URGENT"'),
            ("?c", pred("name"), "?any"),
        ],
        # no template fits
        [("?x", pred("residesIn"), "<urn:ex:region:1>")],
        [("?x", pred("residesIn"), "<urn:ex:nation:007>")],
        [("?x", pred("residesIn"), "<urn:ex:nation:99999999999>")],
        # patterns that cannot meet
        [("?x", pred("residesIn"), "?y"), ("?y", pred("supplies"), "?z")],
        [("?x", pred("residesIn"), "?x")],
    ]
    for patterns in queries:
        a, b = mf.match_bgp(inferred, patterns), mf.match_bgp(frame, patterns)
        columns = sorted(a.columns)
        assert columns == sorted(b.columns)
        assert sorted(a.select(columns).collect()) == sorted(b.select(columns).collect())
        n = len(b.collect())
        assert mf.count_bgp(inferred, patterns).first()["n"] == n
    bound = [("?c", mf.RDF_TYPE, "?t"), ("?c", pred("residesIn"), node("nation", 2))]
    a, b = (mf.match_bgp(t, bound, bind_data=True) for t in (inferred, frame))
    assert sorted(a.select("c", "t").collect()) == sorted(b.select("c", "t").collect())


def test_row_attributes_need_no_join(spark, inferred, capsys):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        mf.match_bgp(inferred, PATTERNS["bgp_type_const"]).explain("formatted")
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    text = capsys.readouterr().out
    assert "Join" not in text and "Exchange" not in text
    assert "EqualTo(c_nationkey,2)" in text and "EqualTo(c_mktsegment,FURNITURE)" in text


def test_overlapping_rules_stay_a_set(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    rule = Rule("t", Term("<x:", "k", ">"), "<p>", Term("<y:", "v", ">"), key=True)
    source = TableTriples(spark, [rule, rule], {"t": lambda: rows})
    assert source.all().count() == 2
    assert mf.match_bgp(source, [("?s", "<p>", "?o")]).count() == 2
    assert mf.match_bgp(source, [("?s", "<p>", "<y:a>")]).count() == 1


def test_missing_values_give_no_triple(spark):
    rows = spark.createDataFrame([(1, None), (None, "b"), (3, "it's \\ odd")], "k int, v string")
    rule = Rule("t", Term("<x:", "k", ">"), "<p>", Term("<y:", "v", ">"))
    source = TableTriples(spark, [rule], {"t": lambda: rows})
    expected = [("<x:3>", "<p>", "<y:it's \\ odd>")]
    assert [tuple(r) for r in source.all().collect()] == expected
    assert mf.match_bgp(source, [("?s", "<p>", expected[0][2])]).first()["s"] == "<x:3>"
    keyed = TableTriples(
        spark,
        [Rule("t", Term("<x:", "k", ">"), "<p>", Term("<y:", "v", ">"), key=True)],
        {"t": lambda: rows},
    )
    assert [tuple(r) for r in keyed.all().collect()] == expected


def test_inference_keeps_classes_apart(inferred):
    found = inferred.scan(mf.RDF_TYPE, o=cls("Agent"))
    assert found.count() == found.distinct().count()
    assert inferred.catalog([pred("locatedIn")])[pred("locatedIn")].functional
    assert inferred.catalog(["<unknown>"]) == {}
