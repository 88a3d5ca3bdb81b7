"""Joins of binding tables.

A binding table has one string column per variable.  Plain joins are left to
Spark: adaptive execution picks the strategy and splits skewed partitions of a
sort-merge join.  ``salted_join`` splits hot keys in the plan itself, for joins
that adaptive execution cannot split (a side that comes straight out of an
aggregation by the join key).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import check_pattern
from ..sources.triples import as_source, pattern_rows, union_all

#: Rows of one key that one task should get; a key with more is split.
SPLIT_ROWS = 1_000_000

#: Rows of either side in one cell of a product.
CELL_ROWS = 20_000


def quoted(name: str):
    return F.col(f"`{name}`")


def shared_columns(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in b.columns]


def pattern_scan(triples, pattern) -> DataFrame:
    """All matches of one pattern, one column per variable."""
    return pattern_rows(as_source(triples), check_pattern(pattern))


def natural_join(
    a: DataFrame, b: DataFrame, allow_cross: bool = False, split_rows: int = 0
) -> DataFrame:
    """Equi-join on all shared columns; without one, all pairs if ``allow_cross``."""
    shared = shared_columns(a, b)
    if not shared:
        if not allow_cross:
            raise ValueError(f"no shared variable between {a.columns} and {b.columns}")
        return pair_join(a, b)
    return salted_join(a, b, shared, split_rows) if split_rows else a.join(b, shared)


def semi_join(a: DataFrame, b: DataFrame, split_rows: int = 0) -> DataFrame:
    """Rows of ``a`` with a partner in ``b`` on the shared columns; never multiplies rows.

    With ``split_rows``, ``b`` must not repeat a key.
    """
    shared = shared_columns(a, b)
    if not shared:
        raise ValueError(f"no shared variable between {a.columns} and {b.columns}")
    keys = b.select(*map(quoted, shared))
    if split_rows:
        return salted_join(a, keys, shared, split_rows, "left_semi")
    return a.join(keys, shared, "left_semi")


def expand_edge(bindings: DataFrame, triples, pattern, split_rows: int = 0) -> DataFrame:
    """Extend bindings by one edge, in either direction."""
    return natural_join(bindings, pattern_scan(triples, pattern), split_rows=split_rows)


def salted_join(
    a: DataFrame, b: DataFrame, on: Sequence[str], split_rows: int = SPLIT_ROWS, how: str = "inner"
) -> DataFrame:
    """Equi-join that splits a key by its own number of rows, on both sides.

    A key with n rows in ``a`` and m in ``b`` is cut into ceil(n / split_rows) pieces of ``a`` and
    ceil(m / split_rows) of ``b``; each piece of one side meets each of the other in a task of its own.  The keys that
    are cut number (rows of both sides) / split_rows at most.
    """
    if how not in ("inner", "left_semi"):
        raise ValueError("how must be 'inner' or 'left_semi'")

    def pieces(df: DataFrame, name: str) -> DataFrame:
        rows = df.groupBy(*map(quoted, on)).agg(F.count("*").alias("#rows"))
        cut = F.ceil(quoted("#rows") / F.lit(split_rows)).cast("int")
        return rows.where(quoted("#rows") > split_rows).select(*map(quoted, on), cut.alias(name))

    # A side of a semi join that does not repeat a key needs no cutting.
    if how == "inner":
        hot = pieces(a, "#a").join(pieces(b, "#b"), list(on), "full")
    else:
        hot = pieces(a, "#a").withColumn("#b", F.lit(None).cast("int"))
    one = F.lit(1)
    hot = hot.select(*map(quoted, on), F.coalesce("#a", one).alias("#a"), F.coalesce("#b", one).alias("#b"))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        columns = list(map(quoted, df.columns))
        own_cut, other_cut = (F.coalesce(quoted(c), one) for c in (own, other))
        piece = F.pmod(F.xxhash64(*columns), own_cut).cast("int")
        return df.join(hot, list(on), "left").select(
            *columns,
            piece.alias(own + "piece"),
            F.explode(F.sequence(F.lit(0), other_cut - 1)).alias(other + "piece"),
        )

    keys = [*on, "#apiece", "#bpiece"]
    return dealt(a, "#a", "#b").join(dealt(b, "#b", "#a"), keys, how).drop("#apiece", "#bpiece")


def pair_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """All pairs of two binding tables whose answer is a product by definition.

    The sides are counted and cut into pieces of about ``CELL_ROWS``; each pair of pieces is a cell, and the two
    meet in an equi-join on the cell.  A side is repeated once per piece of the other: a small side
    leaves the large one unrepeated.
    """
    cuts = [max(1, -(-df.count() // CELL_ROWS)) for df in (a, b)]

    def dealt(df: DataFrame, own: int, other: int, names: tuple[str, str]) -> DataFrame:
        piece = F.pmod(F.xxhash64(*map(quoted, df.columns)), F.lit(cuts[own])).cast("int")
        return df.select(
            *map(quoted, df.columns),
            piece.alias(names[0]),
            F.explode(F.sequence(F.lit(0), F.lit(cuts[other] - 1))).alias(names[1]),
        )

    left = dealt(a, 0, 1, ("#apiece", "#bpiece"))
    right = dealt(b, 1, 0, ("#bpiece", "#apiece"))
    return left.join(right, ["#apiece", "#bpiece"]).drop("#apiece", "#bpiece")


def union_bindings(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two binding tables with the same column set, aligned by name."""
    if set(a.columns) != set(b.columns):
        raise ValueError(f"different variables: {a.columns} and {b.columns}")
    return a.unionByName(b)


def merge_bindings(parts: Sequence[DataFrame], split_rows: int = 0) -> DataFrame:
    """Combine partial results: equal column sets are united, the rest joined.

    Each union is reduced to a set before it is joined, so the result is a set.
    """
    groups: dict[frozenset[str], list[DataFrame]] = {}
    for part in parts:
        groups.setdefault(frozenset(part.columns), []).append(part)
    tables = [union_all(g).distinct() if len(g) > 1 else g[0] for g in groups.values()]
    merged = tables.pop(0)
    while tables:
        linked = next((t for t in tables if shared_columns(merged, t)), None)
        if linked is None:
            raise ValueError("partial results without a shared variable")
        tables.remove(linked)
        merged = natural_join(merged, linked, split_rows=split_rows)
    return merged


def project_solutions(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Solution columns in the given order; a set again if a variable is dropped."""
    kept = df.select(*map(quoted, variables))
    return kept.distinct() if set(df.columns) - set(variables) else kept

