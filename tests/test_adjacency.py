"""Neighbour arrays against joins of edges."""

import random

import pytest
from pyspark.sql import functions as F

import motifold as mf


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def edges(spark):
    """Random edges of two predicates; nodes 0 and 1 have hundreds of targets, many of them common."""
    rng = random.Random(3)
    given = {(rng.randrange(40), rng.randrange(60), p) for p in "pq" for _ in range(300)}
    given |= {(hub, t, p) for hub, p in ((0, "p"), (1, "q")) for t in rng.sample(range(1000), 600)}
    return spark.createDataFrame(sorted(given), "src long, dst long, pred string").cache()


@pytest.mark.parametrize("chunk", [5, 100, 4096])
def test_expansion_and_closing_equal_joins(spark, edges, tmp_path, chunk):
    mf.write_adjacency(mf.adjacency(edges, chunk), str(tmp_path / "a"))
    stored = mf.open_adjacency(spark, str(tmp_path / "a"))
    back = stored.select("src", F.explode("near").alias("dst"), "pred")
    assert rows(back) == rows(edges)
    assert all(list(r.near) == sorted(r.near) for r in stored.collect())
    starts = spark.createDataFrame([(i, "x") for i in range(45)], "a long, other string")
    own = edges.where("pred = 'p'").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    assert rows(mf.expand_adjacency(starts, stored, "p", "a", "b")) == rows(starts.join(own, "a").select("a", "other", "b"))
    pairs = spark.createDataFrame([(i, j) for i in range(12) for j in range(12)], "a long, b long")
    left = edges.where("pred = 'p'").select(F.col("src").alias("a"), F.col("dst").alias("z"))
    right = edges.where("pred = 'q'").select(F.col("src").alias("b"), F.col("dst").alias("z"))
    want = rows(pairs.join(left, "a").join(right, ["b", "z"]).select("a", "b", "z"))
    got = rows(mf.close_edges(pairs, stored, ("a", "p"), ("b", "q"), "z"))
    assert got == want and len([r for r in got if r[:2] == (0, 1)]) > 200


def test_a_hub_has_many_chunks_of_bounded_length(edges):
    made = mf.adjacency(edges, 50).where("src = 0 AND pred = 'p'").select("chunks", "chunk", F.size("near").alias("n")).collect()
    assert {r.chunks for r in made} == {16} and len(made) == 16 and max(r.n for r in made) <= 100
    assert mf.adjacency(edges.limit(0)).count() == 0
