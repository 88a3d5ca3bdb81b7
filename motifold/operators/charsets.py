"""Characteristic sets: which predicates occur together on a subject, and how often.

The table has one row per distinct set of predicates, with the number of subjects that have exactly this set and the number of
triples of each predicate.  It is small (sets follow the schema, not the data), answers star counts by existence exactly, and gives the
expected size of a star whose values are bound.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.triples import frame


def characteristic_sets(triples) -> DataFrame:
    """``(predicates, n_subjects, n_triples)``: the sorted set, its subjects and, in the same order, triples per predicate.

    Triples are counted per (subject, predicate) first, so a subject with very many objects is one row per predicate.
    """
    counted = frame(triples).groupBy("s", "p").agg(F.count("*").alias("n"))
    per_subject = counted.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("p", "n"))).alias("pairs"))
    keyed = per_subject.select(F.transform("pairs", lambda x: x["p"]).alias("predicates"), F.explode("pairs").alias("x"))
    totals = keyed.groupBy("predicates", F.col("x.p").alias("p")).agg(
        F.count("*").alias("n_subjects"), F.sum("x.n").alias("n")
    )
    sets = totals.groupBy("predicates", "n_subjects").agg(F.sort_array(F.collect_list(F.struct("p", "n"))).alias("pairs"))
    return sets.select("predicates", "n_subjects", F.transform("pairs", lambda x: x["n"]).alias("n_triples"))


def _holds(predicates: Iterable[str]) -> Column:
    wanted = list(dict.fromkeys(predicates))
    if not wanted:
        raise ValueError("a star needs at least one predicate")
    return reduce(lambda a, b: a & b, (F.array_contains("predicates", p) for p in wanted))


def count_star_sets(sets: DataFrame, predicates: Iterable[str]) -> DataFrame:
    """Number of subjects with all of the predicates, as column ``n``: exact, from the table alone."""
    return sets.where(_holds(predicates)).agg(F.coalesce(F.sum("n_subjects"), F.lit(0)).alias("n"))


def _triples_of(p: str) -> Column:
    at = F.array_position("predicates", F.lit(p)).cast("int")
    return F.element_at("n_triples", at)


def star_rows(sets: DataFrame, bound: Sequence[str], tested: Iterable[str] = ()) -> DataFrame:
    """Expected solutions of a star, as column ``n``: ``bound`` predicates give a row per object, ``tested`` ones only exist.

    Exact where a set's subjects have the same number of objects of all bound predicates but one.
    """
    expected = F.col("n_subjects").cast("double")
    for p in bound:
        expected = expected * _triples_of(p) / F.col("n_subjects")
    kept = sets.where(_holds([*bound, *tested]))
    return kept.agg(F.coalesce(F.sum(expected), F.lit(0.0)).alias("n"))

