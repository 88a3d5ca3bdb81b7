"""Rows go to the cells of a grid sorted and packed."""

import random

import pytest

from motifold.operators import grid as module
from motifold.operators.grid import Grid, _packed, grid_join


def test_rows_of_a_part_go_to_its_cells_as_one_block(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(900_000), rng.randrange(1_200_000)) for _ in range(40_000)]
    df = spark.createDataFrame(rows, "a bigint, b bigint").coalesce(1)
    sent = [len(r["block"]) for r in _packed(df, Grid({"a": 2, "b": 2, "c": 8})).select("block").collect()]
    assert len(sent) == 4 and sum(sent) < 5 * len(rows)


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_blocks_of_several_packs_and_types_join(spark, monkeypatch, kind):
    monkeypatch.setattr(module, "PACK_ROWS", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    rng = random.Random(2)
    given = [{(rng.randrange(-9, 9), rng.randrange(-9, 9)) for _ in range(90)} for _ in range(3)]
    names = ["ab", "bc", "ca"]
    try:
        frames = [
            spark.createDataFrame(sorted(g), f"{n[0]} bigint, {n[1]} bigint").selectExpr(*(f"cast({c} as {kind}) as {c}" for c in n))
            for g, n in zip(given, names, strict=True)
        ]
        found = sorted(tuple(map(int, r)) for r in grid_join(frames, grid=Grid({"a": 2, "b": 3, "c": 2})).select(*"abc").collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == sorted((a, b, c) for a, b in given[0] for b2, c in given[1] if b == b2 and (c, a) in given[2])
