"""The grid of a cycle: rows sent and rows counted."""

from motifold.operators.grid import Grid, fullest_cells, grid_join
from motifold.plans.rounds import _folded
from motifold.sources.triples import Relation


def test_lookups_of_a_long_cycle_are_joined_before_the_grid(spark):
    """Customer, supplier, part, order: an order has one customer, so the grid needs no axis for it alone."""
    def frame(rows, *names):
        return spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))

    bought = Relation(frame([(1, 5), (2, 5), (2, 6)], "c", "s"), ("c", "s"))
    supplied = Relation(frame([(5, 8), (6, 8), (6, 9)], "s", "p"), ("s", "p"))
    held = Relation(frame([(20, 8), (20, 9), (21, 9), (22, 8)], "o", "p"), ("o", "p"))
    placed = Relation(frame([(20, 1), (21, 2)], "o", "c"), ("o", "c"), determined_by="o")
    left = _folded([bought, supplied, held, placed])
    assert sorted(r.variables for r in left) == [("c", "s"), ("o", "p", "c"), ("s", "p")]
    assert sorted(map(tuple, left[-1].df.collect())) == [(20, 8, 1), (20, 9, 1), (21, 9, 2)]
    found = grid_join([r.df for r in left], cell_rows=2).select("c", "s", "p", "o").collect()
    assert sorted(map(tuple, found)) == [(1, 5, 8, 20), (2, 6, 9, 21)]
    assert len(_folded([bought, held, placed])) == 3


def test_cells_are_counted_without_copies(spark):
    df = spark.range(1000).selectExpr("id % 40 AS a", "id AS b")
    grid = Grid({"a": 4, "b": 2, "c": 1 << 20})
    (full,) = fullest_cells([df], grid)
    assert 1000 / 8 <= full <= 1000
