"""Pattern queries: solutions, projections, counts and diagnostic counts.

A query is a list of ``(s, p, o)`` tuples over a set of triples.  Patterns on
attributes (literal-valued predicates and rdf:type) are existence tests on
their subject; patterns on edges are joined.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import (
    RDF_TYPE,
    check_pattern,
    is_literal,
    is_variable,
    pattern_variables,
    variable_name,
)
from ..operators.filters import is_grouped, is_selective, star_members
from ..operators.joins import SPLIT_ROWS, natural_join, pair_join, quoted, salted_join, semi_join
from ..operators.triples import node_set
from ..session import BROADCAST_BYTES, text_bytes
from ..sources.triples import Predicate, Relation, as_source, union_all


@dataclass
class Query:
    """Checked arguments of a pattern query."""

    edges: list[tuple] = field(default_factory=list)  # patterns with a variable, joined
    stars: dict[str, list] = field(default_factory=dict)  # variable -> [(p, o), ...]
    guards: list[tuple] = field(default_factory=list)  # patterns without a subject variable
    catalog: dict[str, Predicate] = field(default_factory=dict)

    @property
    def variables(self) -> list[str]:
        found = [v for e in self.edges for v in pattern_variables(e)]
        return list(dict.fromkeys([*found, *self.stars]))


def prepare(source, patterns: Iterable, bind_data: bool, allow_cross: bool):
    """Split patterns into edges, attribute constraints and existence guards.

    Returns the source prepared for the query, and the query.
    """
    wanted = list(dict.fromkeys(check_pattern(p) for p in patterns))
    if not wanted:
        raise ValueError("a query needs at least one pattern")
    query = Query(catalog=source.catalog({p for _, p, _ in wanted if p != RDF_TYPE}))
    for s, p, o in wanted:
        known = query.catalog.get(p, Predicate())
        is_data = p == RDF_TYPE or is_literal(o) or known.is_data
        if is_data and not bind_data:
            if is_variable(s):
                query.stars.setdefault(variable_name(s), []).append((p, o))
            else:
                query.guards.append((s, p, o))
        elif is_variable(s) or is_variable(o):
            query.edges.append((s, p, o))
        else:
            query.guards.append((s, p, o))
    _check_names(source.spark, query.variables)
    if not allow_cross:
        _check_connected(query)
    return source.for_query(query), query


def _check_names(spark: SparkSession, variables: Sequence[str]) -> None:
    if spark.conf.get("spark.sql.caseSensitive") == "true":
        return
    if len({v.lower() for v in variables}) < len(variables):
        raise ValueError("variables differ only in case: set spark.sql.caseSensitive=true")


def _groups(links: Iterable[Sequence[str]]) -> list[set[str]]:
    """Connected groups of names."""
    groups: list[set[str]] = []
    for names in links:
        merged = set(names)
        apart = []
        for g in groups:
            if g & merged:
                merged |= g
            else:
                apart.append(g)
        groups = [*apart, merged]
    return groups


def _check_connected(query: Query) -> None:
    """Edges must hang together by variables or constant nodes."""
    ends = [(s, o) for s, _, o in (*query.edges, *query.guards)]
    links = [[t for t in pair if not is_literal(t)] for pair in ends]
    links += [[f"?{v}"] for v in query.stars]
    groups = [g for g in _groups(links) if any(is_variable(t) for t in g)]
    if len(groups) > 1:
        raise ValueError(f"patterns are not connected: {[sorted(g) for g in groups]}")


def _open_tests(query: Query, done, variable: str) -> list:
    """Constraints of a variable that no relation has applied yet."""
    return [c for c in query.stars.get(variable, ()) if (variable, c) not in done]


def _selective(query: Query, r: Relation) -> bool:
    return any(is_selective(c) for v in r.variables for c in query.stars.get(v, ()))


def _join_order(query: Query, relations: Sequence[Relation]) -> list[Relation]:
    """Relations of one component: constants first, then always a connected one.

    A relation with more bound variables goes first (it only filters), then one
    that gives each binding a single partner, then, where the catalog counts, the smaller one, then the given order.
    """
    def following(best: Relation) -> list[Relation]:
        """All relations in their order after the start ``best``."""
        left, ordered, bound = list(relations), [], set()
        while True:
            left.remove(best)
            ordered.append(best)
            bound |= set(best.variables)
            if not left:
                return ordered
            best = min(
                (r for r in left if bound & set(r.variables)),
                key=lambda r: (
                    len(set(r.variables) - bound),
                    not r.constant,
                    r.determined_by not in bound,
                    r.rows or 0,
                ),
            )

    def fans(ordered: Sequence[Relation]) -> int:
        """Steps that may give a binding many partners: a functional relation met at its hub multiplies both sides."""
        bound: set[str] = set()
        n = 0
        for r in ordered:
            n += bool(bound) and not set(r.variables) <= bound and r.determined_by not in bound
            bound |= set(r.variables)
        return n

    # A many-to-many relation starts where the others then only widen its rows: no step has more rows than it.  Of
    # starts with as few fans the smallest counted one, without counts one that is not functional.
    orders = [following(r) for r in relations]
    return min(
        orders,
        key=lambda order: (
            not order[0].constant,
            not _selective(query, order[0]),
            fans(order),
            order[0].rows or 0,
            order[0].determined_by is not None,
        ),
    )


def _apply_tests(source, df: DataFrame, v: str, constraints, small: bool, split_rows: int) -> DataFrame:
    """Rows of ``df`` whose variable ``v`` satisfies the constraints.

    The values of a small ``df`` go to the attribute rows first; hot values of a
    large one are split where the attribute side is grouped by subject.
    """
    within = None
    if small:
        keys = df.select(quoted(v).alias("s"))
        within = F.broadcast(keys if len(df.columns) == 1 else keys.distinct())
    members = star_members(source, constraints, within, v).withColumnRenamed("s", v)
    return semi_join(df, members, split_rows if not small and is_grouped(constraints) else 0)


class _Component:
    """Binding table of relations connected by variables."""

    def __init__(self, source, query: Query, probe_bytes: int, split_rows: int):
        self.source = source
        self.query = query
        self.probe_bytes = probe_bytes
        self.split_rows = split_rows
        self.done: set = set()

    def _test(self, df: DataFrame, unique: str | None = None, small: bool = False) -> DataFrame:
        """Apply the open constraints of every variable of ``df``.

        ``unique`` is a variable whose values do not repeat in ``df``.
        """
        for v in df.columns:
            constraints = _open_tests(self.query, self.done, v)
            if not constraints:
                continue
            split_rows = 0 if v == unique else self.split_rows
            df = _apply_tests(self.source, df, v, constraints, small, split_rows)
            self.done |= {(v, c) for c in constraints}
        return df

    def _is_small(self, df: DataFrame) -> bool:
        return self.probe_bytes > 0 and text_bytes(df) <= self.probe_bytes

    def bindings(self, relations: Sequence[Relation]) -> DataFrame:
        for r in relations:
            self.done |= r.tested
        first, *rest = _join_order(self.query, relations)
        bound = first.df
        tests = any(_open_tests(self.query, self.done, v) for v in first.variables)
        small = first.constant and bool(rest or tests) and self._is_small(bound)
        bound = self._test(bound, first.determined_by, small)
        if rest and not small and _selective(self.query, first):
            small = self._is_small(bound)
        for r in rest:
            if small:
                # The measured start goes to the rows of the next relation, not the reverse.
                shared = [v for v in bound.columns if v in r.variables]
                bound = self._test(r.df.join(F.broadcast(bound), shared))
                small = False
            else:
                # An edge that closes a cycle may come grouped by the join key.
                closing = r.grouped and set(r.variables) <= set(bound.columns)
                scan = self._test(r.df, r.determined_by)
                bound = natural_join(bound, scan, split_rows=self.split_rows if closing else 0)
        return bound


def _guarded(df: DataFrame, source, guards: Sequence[tuple]) -> DataFrame:
    """Keep ``df`` only if every guard pattern has a match."""
    for s, p, o in guards:
        found = source.scan(p, None if is_variable(s) else s, None if is_variable(o) else o)
        df = df.where(found.exists())
    return df


def _one_row(spark: SparkSession) -> DataFrame:
    """A single solution without variables."""
    return spark.range(1).select()


def match_bgp(
    triples,
    patterns: Iterable,
    bind_data: bool = False,
    allow_cross: bool = False,
    split_rows: int = SPLIT_ROWS,
    probe_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Solutions of a pattern query, one string column per edge variable.

    ``bind_data`` treats attribute patterns like edges: they bind their object.
    Parts linked by a constant node only give all pairs of their solutions;
    unlinked parts need ``allow_cross``.  The scan with a constant that starts a
    join is measured first and broadcast up to ``probe_bytes``; 0 turns this
    off.  Hot keys are split by adaptive execution, and into pieces of ``split_rows`` in
    joins where that cannot act (one side grouped by the join key).
    """
    source, query = prepare(as_source(triples), patterns, bind_data, allow_cross)
    relations = source.relations()
    tables = []
    for names in _groups([*(r.variables for r in relations), *([v] for v in query.stars)]):
        part = [r for r in relations if names & set(r.variables)]
        if part:
            tables.append(_Component(source, query, probe_bytes, split_rows).bindings(part))
        else:
            (v,) = names
            members = star_members(source, query.stars[v], variable=v)
            tables.append(members.withColumnRenamed("s", v))
    df = reduce(pair_join, tables) if tables else _one_row(source.spark)
    df = source.decode(df.select(*map(quoted, query.variables)), query.variables)
    return _guarded(df, source.base, query.guards)


# --- answers that need no full binding table --------------------------------


_N = "#n"


def _counted(df: DataFrame) -> DataFrame:
    return df.withColumn(_N, F.lit(1).cast("bigint"))


def _tested_relations(source, query: Query, counting: bool, probe_bytes: int) -> list[Relation]:
    """Every relation, with the open constraints of a variable on its first one.

    Relations with a constant are measured; those up to ``probe_bytes`` are broadcast, 0 measures none.
    """
    relations = source.relations()
    done = {t for r in relations for t in r.tested}
    found = []
    for r in relations:
        df = r.df
        tests = any(_open_tests(query, done, v) for v in r.variables)
        joined = any(q is not r and set(q.variables) & set(r.variables) for q in relations)
        small = r.constant and (tests or joined) and 0 < probe_bytes >= text_bytes(df)
        for v in r.variables:
            constraints = _open_tests(query, done, v)
            if constraints:
                unique = v == r.determined_by
                df = _apply_tests(source, df, v, constraints, small, 0 if unique else SPLIT_ROWS)
                done |= {(v, c) for c in constraints}
        found.append(replace(r, df=df, small=small))
    for v, constraints in query.stars.items():
        if not any(v in r.variables for r in relations):
            members = star_members(source, constraints, variable=v)
            found.append(Relation(members.withColumnRenamed("s", v), (v,)))
    if counting:
        found = [replace(r, df=_counted(r.df)) for r in found]
    return [replace(r, df=F.broadcast(r.df)) if r.small else r for r in found]


def _shrink(r: Relation, wanted: set[str], counting: bool) -> Relation:
    """Drop variables nobody needs, by summing counts or by distinct."""
    kept = tuple(v for v in r.variables if v in wanted)
    if len(kept) == len(r.variables):
        return r
    keys = list(map(quoted, kept))
    if counting:
        df = r.df.groupBy(*keys).agg(F.coalesce(F.sum(quoted(_N)), F.lit(0)).alias(_N))
    else:
        df = r.df.select(*keys).distinct() if kept else r.df
    unique = kept[0] if len(kept) == 1 else None
    return Relation(df, kept, determined_by=unique, grouped=True, small=r.small)


def _combine(a: Relation, b: Relation, counting: bool) -> Relation:
    """Natural join of two relations; counts multiply.

    If ``b`` is grouped by just the join key, hot keys of ``a`` are salted.
    """
    shared = [v for v in a.variables if v in b.variables]
    grouped = b.grouped and not b.small and len(shared) == len(b.variables)
    hot = grouped and not a.small and a.determined_by not in shared
    split_rows = SPLIT_ROWS if hot else 0
    variables = tuple(dict.fromkeys((*a.variables, *b.variables)))
    if counting:
        other = b.df.withColumnRenamed(_N, "#m")
        joined = salted_join(a.df, other, shared) if hot else a.df.join(other, shared)
        df = joined.select(*map(quoted, variables), (quoted(_N) * quoted("#m")).alias(_N))
    elif len(variables) == len(a.variables):
        df = semi_join(a.df, b.df, split_rows)
    else:
        df = natural_join(a.df, b.df).select(*map(quoted, variables))
    return Relation(df, variables)


def _eliminate(relations: list[Relation], keep: set[str], counting: bool):
    """Join relations one by one and drop every variable as soon as it is private.

    Returns the remaining relations over ``keep`` (pairwise without a shared
    variable) and the relations left without any variable.
    """
    rels = list(relations)
    factors: list[Relation] = []
    while True:
        for i, r in enumerate(rels):
            others = {v for j, q in enumerate(rels) if j != i for v in q.variables}
            rels[i] = _shrink(r, others | keep, counting)
        factors += [r for r in rels if not r.variables]
        rels = [r for r in rels if r.variables]
        pairs = [
            (i, j)
            for i, a in enumerate(rels)
            for j, b in enumerate(rels)
            if i != j and set(a.variables) & set(b.variables)
        ]
        if not pairs:
            return rels, factors

        def cost(pair):
            a, b = rels[pair[0]], rels[pair[1]]
            return (
                len(set(b.variables) - set(a.variables)),
                b.determined_by not in a.variables,
                pair,
            )

        i, j = min(pairs, key=cost)
        merged = _combine(rels[i], rels[j], counting)
        rels = [merged, *(r for k, r in enumerate(rels) if k not in (i, j))]


def project_bgp(
    triples,
    patterns: Iterable,
    variables: Sequence[str],
    bind_data: bool = False,
    allow_cross: bool = False,
    probe_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Distinct values of ``variables`` over all solutions.

    Same rows as ``project_solutions(match_bgp(...))``, but a variable that is
    not asked for is removed before the next join.
    """
    source, query = prepare(as_source(triples), patterns, bind_data, allow_cross)
    unknown = set(variables) - set(query.variables)
    if unknown:
        raise ValueError(f"unknown variables: {sorted(unknown)}")
    rels, factors = _eliminate(_tested_relations(source, query, False, probe_bytes), set(variables), False)
    df = reduce(pair_join, (r.df for r in rels)) if rels else _one_row(source.spark)
    for f in factors:
        df = df.where(f.df.exists())
    df = source.decode(df.select(*map(quoted, variables)), variables)
    return _guarded(df, source.base, query.guards)


def _root_counts(source, query: Query, root: str, probe_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(root, #n)`` with the root in the form it has in the prepared source."""
    if root not in query.variables:
        raise ValueError(f"unknown variable {root!r}")
    rels, factors = _eliminate(_tested_relations(source, query, True, probe_bytes), {root}, True)
    df = rels[0].df
    for f in factors:
        df = df.withColumn(_N, quoted(_N) * f.df.select(quoted(_N)).scalar())
    df = df.select(quoted(root), quoted(_N)).where(quoted(_N) > 0)
    return _guarded(df, source.base, query.guards)


def solutions_per_root(
    triples,
    patterns: Iterable,
    root: str,
    bind_data: bool = False,
    allow_cross: bool = False,
    count: str = "n",
    probe_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(root, n)``: number of solutions per value of the root variable.

    ``count`` renames the second column, for a root that is itself called ``n``.
    Counts multiply along the joins, so the solutions of a hub are never listed.
    """
    source, query = prepare(as_source(triples), patterns, bind_data, allow_cross)
    if count.lower() == root.lower():
        raise ValueError("choose another name for the count column")
    counts = source.decode(_root_counts(source, query, root, probe_bytes), [root])
    return counts.withColumnRenamed(_N, count)


def count_bgp(
    triples,
    patterns: Iterable,
    bind_data: bool = False,
    allow_cross: bool = False,
    probe_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Number of solutions as column ``n``, without listing them where a tree allows it."""
    source, query = prepare(as_source(triples), patterns, bind_data, allow_cross)
    rels, factors = _eliminate(_tested_relations(source, query, True, probe_bytes), set(), True)
    df = source.spark.range(1).select(F.lit(1).cast("bigint").alias("n"))
    for f in (*factors, *rels):
        df = df.select((F.col("n") * f.df.select(quoted(_N)).scalar()).alias("n"))
    if not query.guards:
        return df
    met = _guarded(source.spark.range(1).select(), source.base, query.guards)
    return df.select(F.when(met.exists(), F.col("n")).otherwise(F.lit(0)).alias("n"))


def count_solutions(df: DataFrame) -> DataFrame:
    """Number of distinct rows of a binding table, as column ``n``."""
    if not df.columns:
        return df.limit(1).agg(F.count("*").alias("n"))
    return df.distinct().agg(F.count("*").alias("n"))


def match_stats(triples, patterns: Iterable, root: str) -> DataFrame:
    """``(stage, n)``: all nodes, roots with complete bindings, roots that pass
    their own constraints, and solutions.

    The bindings are joined once, before the constraints of the root.
    """
    source, query = prepare(as_source(triples), patterns, False, False)
    if not query.edges:
        raise ValueError("match_stats needs an edge pattern")
    own = query.stars.pop(root, [])
    open_source = source.base.for_query(query)
    roots = _root_counts(open_source, query, root)
    passed = F.lit(True)
    if own:
        members = star_members(source.base, own).withColumnRenamed("s", root)
        roots = open_source.decode(roots, [root]).join(members.withColumn("#own", F.lit(True)), root, "left")
        passed = quoted("#own").isNotNull()
    counts = roots.agg(
        F.count("*").alias("complete_roots"),
        F.count_if(passed).alias("checked_roots"),
        F.coalesce(F.sum(F.when(passed, quoted(_N))), F.lit(0)).alias("solutions"),
    ).select(
        F.explode(
            F.map_from_arrays(
                F.array(*map(F.lit, ("complete_roots", "checked_roots", "solutions"))),
                F.array("complete_roots", "checked_roots", "solutions"),
            )
        ).alias("stage", "n")
    )
    nodes = node_set(source.base).agg(F.count("*").alias("n"))
    return union_all([nodes.select(F.lit("nodes").alias("stage"), "n"), counts])
