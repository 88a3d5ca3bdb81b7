"""Attribute constraints: existence tests that never multiply rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import RDF_TYPE, is_variable
from ..sources.triples import as_source, union_all
from .joins import semi_join

Constraint = tuple[str, str]


def has_property(triples, p: str) -> DataFrame:
    """Subjects ``s`` with any value of ``p``."""
    return as_source(triples).scan(p).select("s").distinct()


def has_property_value(triples, p: str, o: str) -> DataFrame:
    """Subjects ``s`` with exactly the pair ``(p, o)``; unique since triples are a set."""
    return as_source(triples).scan(p, o=o).select("s")


def star_members(
    triples,
    constraints: Sequence[Constraint],
    within: DataFrame | None = None,
    variable: str | None = None,
) -> DataFrame:
    """Subjects ``s`` that satisfy every ``(p, o)`` constraint.

    Two or more constraints take one aggregation by subject with one flag per
    constraint; flags merge before the shuffle, so a subject with very many
    values is a single row per task.  ``within`` is a small broadcast table of
    candidate subjects; with it only their rows are aggregated at all.  A source
    prepared for a query gives the subjects in the form of ``variable``.
    """
    source = as_source(triples)
    wanted = list(dict.fromkeys(constraints))
    if not wanted:
        raise ValueError("a star filter needs at least one constraint")
    rows = []
    for k, (p, o) in enumerate(wanted):
        found = source.subjects(p, None if is_variable(o) else o, variable)
        if within is not None:
            found = found.join(within, "s", "left_semi")
        if len(wanted) == 1:
            return found.distinct() if is_variable(o) else found
        rows.append(found.select("s", *(F.lit(k == i).alias(f"#{i}") for i in range(len(wanted)))))
    flags = [F.bool_or(f"#{i}").alias(f"#{i}") for i in range(len(wanted))]
    passed = reduce(lambda a, b: a & b, (F.col(f"#{i}") for i in range(len(wanted))))
    return union_all(rows).groupBy("s").agg(*flags).where(passed).select("s")


def star_filter(
    df: DataFrame,
    subject: str,
    triples,
    constraints: Sequence[Constraint],
    within: DataFrame | None = None,
    split_rows: int = 0,
) -> DataFrame:
    """Rows of ``df`` whose ``subject`` column satisfies every constraint.

    ``split_rows`` splits subjects that hold a large share of the rows of ``df``.
    """
    members = star_members(triples, constraints, within).withColumnRenamed("s", subject)
    return semi_join(df, members, split_rows)


def match_star(triples, constraints: Sequence[Constraint], variable: str = "s") -> DataFrame:
    """Solutions of a pattern without edges: the vertices passing a star filter."""
    return star_members(triples, constraints).withColumnRenamed("s", variable)


def count_star(triples, constraints: Sequence[Constraint]) -> DataFrame:
    """Number of vertices passing a star filter, as column ``n``."""
    return star_members(triples, constraints).agg(F.count("*").alias("n"))


def is_grouped(constraints: Sequence[Constraint]) -> bool:
    """Whether ``star_members`` ends in an aggregation by subject.

    Spark joins such a side without a shuffle of its own, and then adaptive
    execution cannot split a hot key of the other side.
    """
    wanted = set(constraints)
    return len(wanted) > 1 or any(is_variable(o) for _, o in wanted)


def is_selective(constraint: Constraint) -> bool:
    """A constraint on a literal value; class memberships are usually broad."""
    p, o = constraint
    return p != RDF_TYPE and not is_variable(o)
