"""Classification, catalog, edge filter and set operations on triples."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import triple_kind
from ..sources.tables import TableTriples
from ..sources.triples import as_source, frame, no_triples


def classify_triples(triples) -> DataFrame:
    """Triples with ``kind``: literal, type or object."""
    return frame(triples).withColumn("kind", triple_kind(F.col("p"), F.col("o")))


def data_triples(triples) -> DataFrame:
    """Attributes: literal and type triples."""
    return frame(triples, "data")


def object_triples(triples) -> DataFrame:
    """Graph edges: triples that are neither literal nor type."""
    return frame(triples, "object")


def predicate_catalog(triples) -> DataFrame:
    """``(p, kind, n)``: a predicate is data if any of its uses is literal or type."""
    is_data = triple_kind(F.col("p"), F.col("o")) != "object"
    return frame(triples).groupBy("p").agg(
        F.when(F.bool_or(is_data), "data").otherwise("object").alias("kind"),
        F.count("*").alias("n"),
    )


def filter_edges(triples, predicates: Iterable[str], keep_source: bool = False):
    """Triples whose predicate is in the list; none for an empty list.

    ``keep_source`` gives tables as triples back as such, restricted, for steps that work on their key columns.
    """
    source = as_source(triples)
    wanted = list(dict.fromkeys(predicates))
    if keep_source and isinstance(source, TableTriples):
        return source.restricted(wanted)
    if not wanted:
        return no_triples(source.spark)
    return source.scan_any(wanted)


def dedup_triples(t: DataFrame) -> DataFrame:
    """Triples as a set.  Duplicates merge before the shuffle, also of a hot triple."""
    return t.dropDuplicates(["s", "p", "o"])


def node_set(triples) -> DataFrame:
    """Distinct subjects and objects, literals and classes included.

    Repeats merge before the shuffle, so a hub is one row per task.
    """
    return as_source(triples).ends().distinct()


def graph_nodes(triples) -> DataFrame:
    """Distinct subjects and objects for the vertex table.

    Every subject is a node; an object is one only if its triple is an edge.
    """
    return as_source(triples).ends("object").distinct()


def subject_nodes(triples) -> DataFrame:
    """Distinct subjects of all triples."""
    return as_source(triples).ends(sides="s").distinct()
