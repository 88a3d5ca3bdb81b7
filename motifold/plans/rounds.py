"""Two more ways to answer a pattern query: in one round on a grid, and after a full semi-join reduction."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame

from ..operators.grid import CELL_ROWS, grid_join
from ..operators.joins import natural_join, pair_join, quoted
from ..session import stage
from ..sources.triples import Relation, as_source
from .bgp import _groups, _guarded, _one_row, _tested_relations, prepare


def _relation_groups(relations: Sequence[Relation]) -> list[list[Relation]]:
    """Relations that hang together by variables."""
    groups = _groups([r.variables for r in relations])
    return [[r for r in relations if names & set(r.variables)] for names in groups]


def _answer(source, query, tables: Sequence[DataFrame]) -> DataFrame:
    df = reduce(pair_join, tables) if tables else _one_row(source.spark)
    df = source.decode(df.select(*map(quoted, query.variables)), query.variables)
    return _guarded(df, source.base, query.guards)


def _folded(relations: Sequence[Relation]) -> list[Relation]:
    """Relations of a longer cycle with lookups done first: each saves the grid an axis.

    A relation with one row per value of a variable, which only one other relation holds besides, adds no rows to that one
    when they are joined.  Three relations are left for the grid.
    """
    left = list(relations)

    def lookup() -> tuple[Relation, Relation] | None:
        for r in left:
            users = [q for q in left if q is not r and r.determined_by in q.variables]
            if r.determined_by is not None and len(users) == 1:
                return users[0], r
        return None

    while len(left) > 3 and (found := lookup()):
        wide, r = found
        shared = [v for v in r.variables if v in wide.variables]
        variables = tuple(dict.fromkeys((*wide.variables, *r.variables)))
        # What determined all of the wide relation still does.
        df = wide.df.join(r.df, shared).select(*map(quoted, variables))
        left = [q for q in left if q is not wide and q is not r]
        left.append(Relation(df, variables, determined_by=wide.determined_by))
    return left


def match_bgp_grid(
    triples, patterns: Iterable, bind_data: bool = False, allow_cross: bool = False, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """The solutions of ``match_bgp`` by one shuffle of all relations to a grid of cells.

    Meant for cyclic patterns: two of their relations may have far more pairs than the cycle has solutions, and no pair is made here
    that the other relations do not confirm.  Of more than three relations, lookups are joined first (see ``_folded``).  The relations, with the tests of their variables applied, are written once; their
    sizes and the fullest cells are read from there.
    """
    source, query = prepare(as_source(triples), patterns, bind_data, allow_cross)
    relations = _tested_relations(source, query, False, 0)
    tables = []
    for part in map(_folded, _relation_groups(relations)):
        staged = [stage(r.df, "relation") for r in part] if len(part) > 1 else [part[0].df]
        tables.append(grid_join(staged, cell_rows=cell_rows))
    return _answer(source, query, tables)


@dataclass(frozen=True)
class Edge:
    """``child`` hangs below ``parent`` in a join tree, by the variables they share."""

    child: int
    parent: int
    shared: tuple[str, ...]


def join_tree(variables: Sequence[Sequence[str]], root: int = 0) -> list[Edge]:
    """A join tree of connected relations below ``root``, children before their parents.

    A relation whose variables shared with the rest all lie in one other relation is an ear and hangs there; ears are
    taken off until one relation is left.  ``ValueError`` if that fails: the pattern is cyclic.
    """
    left = list(range(len(variables)))
    links: list[tuple[int, int]] = []
    while len(left) > 1:
        for i in left:
            others = [j for j in left if j != i]
            shared = {v for v in variables[i] if any(v in variables[j] for j in others)}
            home = next((j for j in others if shared and shared <= set(variables[j])), None)
            if home is not None:
                links.append((i, home))
                left.remove(i)
                break
        else:
            raise ValueError("the pattern is cyclic: use match_bgp or match_bgp_grid")
    edges: list[Edge] = []
    seen, queue = {root}, [root]
    for parent in queue:
        for a, b in links:
            child = b if a == parent else a
            if parent in (a, b) and child not in seen:
                seen.add(child)
                queue.append(child)
                shared = tuple(v for v in variables[child] if v in variables[parent])
                edges.append(Edge(child, parent, shared))
    return edges[::-1]


def reduced_relations(relations: Sequence[Relation]) -> tuple[list[Relation], list[Edge]]:
    """Relations of an acyclic connected pattern, with only the rows that some solution uses, and their join tree.

    Keys travel up the tree and down again.  A relation's keys towards a neighbour are its distinct shared values after the keys
    of its other neighbours have filtered it; they are written, narrow, so every later step reads a small table of known size, which
    Spark broadcasts where it may.  The relations themselves are filtered where they are scanned.  The largest
    known relation is the root: it is filtered by everything below before its own keys are taken.
    """
    size = [r.rows or 0 for r in relations]
    edges = join_tree([r.variables for r in relations], size.index(max(size)))
    keys: dict[tuple[int, int], DataFrame] = {}  # (from, to)

    def filtered(i: int, but: int | None = None) -> DataFrame:
        df = relations[i].df
        for (giver, taker), own in keys.items():
            if taker == i and giver != but:
                df = df.join(own, own.columns, "left_semi")
        return df

    for e in edges:
        own = filtered(e.child).select(*map(quoted, e.shared)).distinct()
        keys[e.child, e.parent] = stage(own, "keys")
    for e in reversed(edges):
        own = filtered(e.parent, but=e.child).select(*map(quoted, e.shared)).distinct()
        keys[e.parent, e.child] = stage(own, "keys")
    return [replace(r, df=filtered(i)) for i, r in enumerate(relations)], edges


def match_bgp_reduced(
    triples, patterns: Iterable, bind_data: bool = False, allow_cross: bool = False
) -> DataFrame:
    """The solutions of an acyclic ``match_bgp``, joined only from rows that reach a solution.

    No intermediate result then has more rows than the answer.  Worth its key tables where patterns without a
    constant are wide and the answer is small.
    """
    source, query = prepare(as_source(triples), patterns, bind_data, allow_cross)
    relations = _tested_relations(source, query, False, 0)
    tables = []
    for part in _relation_groups(relations):
        rows, edges = reduced_relations(part)
        df = rows[edges[-1].parent].df if edges else rows[0].df
        for e in reversed(edges):  # parents first
            df = natural_join(df, rows[e.child].df)
        tables.append(df)
    return _answer(source, query, tables)
