"""Joins, unions and semi joins of binding tables, with hot keys."""

import pytest

from pyspark.sql import functions as F

import motifold as mf


@pytest.fixture(scope="module")
def tables(spark):
    # A third of the left rows share one key.
    left = [("hub", f"a{i}") for i in range(60)] + [(f"k{i % 40}", f"b{i}") for i in range(120)]
    right = [("hub", f"x{i}") for i in range(9)] + [(f"k{i}", f"y{i}") for i in range(30)]
    return (
        spark.createDataFrame(left, "k string, a string"),
        spark.createDataFrame(right, "k string, b string"),
    )


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_salted_join_equals_plain_join(tables):
    left, right = tables
    plain = rows(mf.natural_join(left, right), "k", "a", "b")
    assert len(plain) == 60 * 9 + 90
    for size in (1, 7, 1000):
        assert rows(mf.natural_join(left, right, split_rows=size), "k", "a", "b") == plain
    assert rows(mf.salted_join(right, left, ["k"]), "k", "a", "b") == plain


def test_salted_semi_join(tables):
    left, right = tables
    keys = right.select("k").distinct()
    plain = rows(mf.semi_join(left, right), "k", "a")
    assert rows(mf.semi_join(left, keys, split_rows=8), "k", "a") == plain
    assert len(plain) == 60 + 90
    with pytest.raises(ValueError):
        mf.salted_join(left, right, ["k"], how="left")


def test_hot_keys_are_spread(spark):
    left = spark.createDataFrame([("hub", str(i)) for i in range(500)], "k string, a string")
    right = spark.createDataFrame([("hub", "x")], "k string, b string")
    joined = mf.salted_join(left, right, ["k"], split_rows=100)
    assert joined.count() == 500
    assert joined.columns == ["k", "a", "b"]


def test_a_key_is_split_by_its_own_rows(spark):
    """A key with a small share of all rows is split as well, and one hot on both sides on both."""
    many = spark.range(20_000).selectExpr("concat('k', id) AS k", "cast(id AS string) AS a")
    hub = spark.range(15).selectExpr("'hub' AS k", "cast(id AS string) AS a")
    right = spark.range(30).selectExpr("'hub' AS k", "cast(id AS string) AS b")
    joined = mf.salted_join(many.union(hub), right, ["k"], split_rows=5)
    assert joined.distinct().count() == joined.count() == 15 * 30
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = mf.salted_join(many.union(hub), right, ["k"], split_rows=5)
        tasks = spread.groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks > 3


def test_a_product_repeats_only_the_small_side(spark):
    from motifold.operators import joins

    one = spark.createDataFrame([("x",)], "a string")
    other = spark.range(50_000).selectExpr("cast(id AS string) AS b")
    assert joins.pair_join(one, other).count() == 50_000


def test_pairs(tables, capsys):
    left, right = (t.select(c) for t, c in zip(tables, "ab", strict=True))
    with pytest.raises(ValueError):
        mf.natural_join(left, right)
    pairs = mf.natural_join(left, right, allow_cross=True)
    assert pairs.distinct().count() == pairs.count() == 180 * 39
    pairs.explain()
    plan = capsys.readouterr().out
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    with pytest.raises(ValueError):
        mf.semi_join(left, right)


def test_union_aligns_by_name(spark):
    a = spark.createDataFrame([("1", "2")], "x string, y string")
    b = spark.createDataFrame([("4", "3")], "y string, x string")
    assert rows(mf.union_bindings(a, b), "x", "y") == [("1", "2"), ("3", "4")]
    with pytest.raises(ValueError):
        mf.union_bindings(a, a.select("x"))


def test_merge_groups_by_columns(spark):
    def table(data, columns):
        return spark.createDataFrame(data, columns)

    a = table([("1", "2"), ("5", "6")], "x string, y string")
    b = table([("2", "1"), ("8", "7")], "y string, x string")
    c = table([("2", "z"), ("8", "w")], "y string, u string")
    merged = mf.merge_bindings([a, c, b])
    assert rows(merged, "x", "y", "u") == [("1", "2", "z"), ("7", "8", "w")]
    with pytest.raises(ValueError):
        mf.merge_bindings([a, table([("1",)], "q string")])


def test_expand_both_ways(spark):
    t = spark.createDataFrame(
        [("<a>", "<p>", "<b>"), ("<b>", "<q>", "<c>")], "s string, p string, o string"
    )
    first = mf.pattern_scan(t, ("?x", "<p>", "?y"))
    assert rows(mf.expand_edge(first, t, ("?y", "<q>", "?z")), "x", "y", "z") == [
        ("<a>", "<b>", "<c>")
    ]
    second = mf.pattern_scan(t, ("?y", "<q>", "?z"))
    assert rows(mf.expand_edge(second, t, ("?x", "<p>", "?y")), "x", "y", "z") == [
        ("<a>", "<b>", "<c>")
    ]
    assert mf.filter_edges(t, []).count() == 0
    assert mf.filter_edges(t, ["<q>", "<q>"]).count() == 1
    assert mf.pattern_scan(t, ("<a>", "<p>", "?y")).columns == ["y"]
