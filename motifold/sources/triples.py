"""One access path to triples, whatever they are stored in.

``scan`` gives the triples of one predicate, restricted to constant ends, and
``catalog`` tells which predicates are attributes.  The pattern matcher needs
nothing else, so the same query runs over a DataFrame of triples, over a stored
graph, or over relational tables.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import is_variable, match_term, triple_kind, variable_name

TRIPLE_SCHEMA = "s string, p string, o string"


@dataclass(frozen=True)
class Predicate:
    """What is known of a predicate: attribute or edge, one object per subject or not, and its triples, if counted."""

    is_data: bool = False
    functional: bool = False
    n: int | None = None


@dataclass(frozen=True)
class Relation:
    """Binding table of one or more edge patterns, ready to be joined."""

    df: DataFrame
    variables: tuple[str, ...]
    determined_by: str | None = None  # variable with at most one row per value
    constant: bool = False  # restricted by a constant end
    tested: frozenset = frozenset()  # (variable, constraint) pairs already applied
    grouped: bool = False  # comes out of an aggregation by all its variables
    small: bool = False  # measured, may be broadcast
    rows: int | None = None  # of the predicate, if the catalog counts them


def no_triples(spark: SparkSession) -> DataFrame:
    """An empty triple table; Spark drops it from the plan."""
    return spark.sql("SELECT '' AS s, '' AS p, '' AS o WHERE false")


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def frame(triples, kind: str | None = None) -> DataFrame:
    """Triples of a DataFrame or source as a DataFrame, restricted to one kind."""
    return as_source(triples).all(kind)


class FrameTriples:
    """Triples held in a DataFrame ``(s, p, o)`` that is already a set."""

    def __init__(self, df: DataFrame, catalog: DataFrame | None = None, sets: DataFrame | None = None):
        """``sets``, the characteristic sets of the triples, makes the sizes of relations exact."""
        self.spark = df.sparkSession
        self.df = df
        self._catalog = catalog
        self.sets = sets

    def scan(self, p: str, s: str | None = None, o: str | None = None) -> DataFrame:
        test = F.col("p") == p
        for column, term in (("s", s), ("o", o)):
            if term is not None:
                test = test & match_term(F.col(column), term)
        return self.df.where(test).select("s", "p", "o")

    def subjects(self, p: str, o: str | None, variable: str | None = None) -> DataFrame:
        """Column ``s``: subjects with predicate ``p`` and, if given, object ``o``."""
        return self.scan(p, o=o).select("s")

    def for_query(self, query) -> FrameQuery:
        return FrameQuery(self, query)

    def scan_any(self, predicates: Iterable[str]) -> DataFrame:
        """Triples of several predicates in one pass."""
        return self.df.where(F.col("p").isin(list(predicates))).select("s", "p", "o")

    def all(self, kind: str | None = None) -> DataFrame:
        """All triples, or only the ``data`` or ``object`` ones."""
        df = self.df.select("s", "p", "o")
        if kind is None:
            return df
        if kind == "data" and self._catalog is not None:
            # The other predicates have none: their partitions are not read.  One row per predicate.
            df = df.where(F.col("p").isin([r["p"] for r in self._catalog.where("kind = 'data'").select("p").collect()]))
        is_object = triple_kind(F.col("p"), F.col("o")) == "object"
        return df.where(is_object if kind == "object" else ~is_object)

    def ends(self, kind: str | None = None, sides: str = "so") -> DataFrame:
        """Column ``node``: subjects and objects in one pass over the triples.

        ``kind='object'`` leaves out the objects of attributes, ``sides`` the subjects or the objects.
        """
        both = F.array(*sides)
        if kind == "object" and "o" in sides:
            is_object = triple_kind(F.col("p"), F.col("o")) == "object"
            both = F.when(is_object, both).otherwise(F.array(*sides.replace("o", "")).cast("array<string>"))
        return self.df.select(F.explode(both).alias("node"))

    def catalog(self, predicates: Iterable[str]) -> dict[str, Predicate]:
        """Catalog rows of the given predicates: at most one row each."""
        wanted = list(predicates)
        if not wanted:
            return {}
        if self._catalog is not None:
            rows = self._catalog.where(F.col("p").isin(wanted)).collect()
            return {r["p"]: Predicate(r["kind"] == "data", bool(r["functional"]), r["n"]) for r in rows}
        rows = (
            self.df.where(F.col("p").isin(wanted))
            .groupBy("p")
            .agg(F.bool_or(triple_kind(F.col("p"), F.col("o")) != "object").alias("is_data"))
            .collect()
        )
        return {r["p"]: Predicate(r["is_data"]) for r in rows}


class FrameQuery:
    """A pattern query over a triple table: one scan per edge pattern."""

    def __init__(self, base: FrameTriples, query):
        self.base = base
        self.spark = base.spark
        self.query = query
        self.subjects = base.subjects
        self._required = self._subject_predicates() if base.sets is not None else {}

    def _subject_predicates(self) -> dict[str, set[str]]:
        """The predicates that the query asks of each subject variable."""
        found: dict[str, set[str]] = {}
        for s, p, _ in self.query.edges:
            if is_variable(s):
                found.setdefault(variable_name(s), set()).add(p)
        for v, constraints in self.query.stars.items():
            found.setdefault(v, set()).update(p for p, _ in constraints)
        return found

    def _rows(self, s: str, p: str, known: Predicate) -> int | None:
        """Triples of ``p`` by the catalog; with characteristic sets only those whose subject has all that the query asks."""
        others = self._required.get(variable_name(s), set()) - {p} if is_variable(s) else set()
        if not others:
            return known.n
        sets = self.base.sets
        held = [F.array_contains("predicates", q) for q in (p, *sorted(others))]
        n = F.element_at("n_triples", F.array_position("predicates", F.lit(p)).cast("int"))
        kept = sets.where(reduce(lambda a, b: a & b, held))
        return kept.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n")).first()["n"]

    def relations(self) -> list[Relation]:
        return [self._relation(e) for e in self.query.edges]

    def _relation(self, pattern) -> Relation:
        s, p, o = pattern
        df = pattern_rows(self.base, pattern)
        known = self.query.catalog.get(p, Predicate())
        return Relation(
            df=df,
            variables=tuple(df.columns),
            determined_by=variable_name(s) if known.functional and is_variable(s) else None,
            constant=not (is_variable(s) and is_variable(o)),
            rows=self._rows(s, p, known),
        )

    def decode(self, df: DataFrame, variables) -> DataFrame:
        return df


def pattern_rows(source, pattern) -> DataFrame:
    """All matches of one pattern, one column per variable."""
    s, p, o = pattern
    rows = source.scan(p, None if is_variable(s) else s, None if is_variable(o) else o)
    if is_variable(s) and s == o:
        rows = rows.where(F.col("s") == F.col("o"))
        return rows.select(F.col("s").alias(variable_name(s)))
    ends = [(F.col(c), t) for c, t in (("s", s), ("o", o)) if is_variable(t)]
    return rows.select(*(c.alias(variable_name(t)) for c, t in ends))


def as_source(triples):
    """Accept a DataFrame or anything with ``scan`` and ``catalog``."""
    return FrameTriples(triples) if isinstance(triples, DataFrame) else triples
