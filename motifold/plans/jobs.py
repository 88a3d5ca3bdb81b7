"""The three jobs over triple files: load a graph, add inferred triples, answer a query."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import build_vertices, encode_edges
from ..operators.infer import infer, lubm_rules
from ..operators.triples import dedup_triples, graph_nodes
from ..session import new_path
from ..sources.dictionary import append_ids, next_free_id
from ..sources.store import (
    begin_append,
    commit_append,
    open_store,
    read_edge_table,
    read_vertex_table,
    store_batches,
    write_edge_table,
    write_store,
    write_vertex_table,
)
from ..sources.text import read_triples, write_edges, write_triples, write_vertices
from ..sources.triples import FrameTriples
from .bgp import count_bgp, match_bgp


def load_graph(
    spark: SparkSession,
    source: str,
    target: str,
    start: int = 0,
    text: bool = False,
    rejects: Observation | None = None,
    append: bool = False,
) -> int:
    """Triple text to a stored graph: triples, catalog, ids, vertices, edges.

    With ``append`` the graph may exist: only triples that it does not have are added, known nodes keep their ids, and a
    batch of vertices and edges is written for what is new.  The batch counts once its catalog is written, which is
    last, so a load that failed is made again with the same result.

    Returns the first free id.  ``text`` also writes the line forms of this load's vertices and edges.
    ``rejects`` counts the lines left out.
    """
    store = f"{target}/store"
    new = read_triples(spark, source, rejects=rejects)
    if append:
        batch = begin_append(new, store)
        number, graph = batch.number, FrameTriples(batch.triples)
    else:
        batch, number = None, 0
        write_store(dedup_triples(new), store)
        graph = open_store(spark, store)
    nodes = graph_nodes(graph)
    ids = append_ids(nodes, f"{target}/ids", start)
    vertices = build_vertices(graph, ids)
    if append and store_batches(spark, store):
        # A vertex is all its rows: a node of an earlier batch needs another only for new attributes.
        there = read_vertex_table(spark, f"{target}/vertices", store_batches(spark, store)).select("id")
        bare = vertices.where(F.size("props") == 0)
        vertices = vertices.where(F.size("props") > 0).unionByName(bare.join(there, "id", "left_anti"))
    write_vertex_table(vertices, f"{target}/vertices/batch={number}", "overwrite")
    write_edge_table(encode_edges(graph, ids, distinct=False), f"{target}/edges/batch={number}", "overwrite")
    if text:
        suffix = f"-{number}" if append else ""
        write_vertices(read_vertex_table(spark, f"{target}/vertices/batch={number}"), f"{target}/vertices-text{suffix}")
        write_edges(read_edge_table(spark, f"{target}/edges/batch={number}"), f"{target}/edges-text{suffix}")
    if batch is not None:
        commit_append(spark, batch)
    return next_free_id(spark, f"{target}/ids", start)


def open_graph(spark: SparkSession, target: str) -> tuple[FrameTriples, DataFrame, DataFrame]:
    """Triples, vertices and edges of a loaded graph; only batches whose load was completed."""
    batches = store_batches(spark, f"{target}/store")
    return (
        open_store(spark, f"{target}/store"),
        read_vertex_table(spark, f"{target}/vertices", batches),
        read_edge_table(spark, f"{target}/edges", batches),
    )


def infer_file(
    spark: SparkSession, source: str, target: str, prefix: str, rejects: Observation | None = None
) -> None:
    """Triple text to triple text with the inferred triples of the university rules, as a bag."""
    classes, predicates = lubm_rules(spark, prefix)
    write_triples(infer(read_triples(spark, source, rejects=rejects), classes, predicates), target)


def open_triples(
    spark: SparkSession, source: str, prefix: str | None = None, rejects: Observation | None = None
) -> FrameTriples:
    """Triple text as a stored set, with university inference under ``prefix`` if given.

    The text is parsed once; a query then reads only its predicates.
    """
    t = read_triples(spark, source, rejects=rejects)
    if prefix is None:
        t = dedup_triples(t)
    else:
        t = infer(t, *lubm_rules(spark, prefix), distinct=True)
    path = new_path(spark, "store")
    write_store(t, path)
    return open_store(spark, path)


def answer(triples, patterns: Iterable, rows: str | None = None, bind_data: bool = False) -> int:
    """Number of solutions; the solutions themselves go to ``rows`` as a table if given."""
    wanted = list(patterns)
    if rows is not None:
        match_bgp(triples, wanted, bind_data).write.parquet(rows)
    return count_bgp(triples, wanted, bind_data).first()["n"]
