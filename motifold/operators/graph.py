"""Vertex and edge tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import TableTriples
from ..sources.triples import as_source, union_all
from .joins import natural_join
from .keys import assign_ids
from .triples import data_triples, graph_nodes, object_triples

#: Parts over which every subject's attributes are dealt.
PARTS = 4

EMPTY_BAG = "array<struct<prop:string,obj:string>>"


def property_bag(triples, parts: int = PARTS) -> DataFrame:
    """``(s, part, props)``: the set of (prop, obj) pairs of every subject, sorted.

    Every subject's pairs are dealt over ``parts`` rows by a hash of the pair, whatever
    their number, so a hot subject is spread over that many tasks; give more parts where a
    subject's attributes do not fit in so few rows.  Parts without pairs have no row.
    """
    dealt = data_triples(triples).select(
        "s",
        F.pmod(F.xxhash64("p", "o"), F.lit(parts)).alias("part"),
        F.struct(F.col("p").alias("prop"), F.col("o").alias("obj")).alias("pair"),
    )
    return dealt.groupBy("s", "part").agg(F.sort_array(F.collect_set("pair")).alias("props"))


def attach_props(triples, vertices: DataFrame, split_rows: int = 0) -> DataFrame:
    """``(id, uri, prop, obj)``: attribute triples joined with their vertex.

    ``split_rows`` splits hot subjects where ``vertices`` is no stored table but
    comes out of an aggregation by node.
    """
    data = data_triples(triples).select(
        F.col("s").alias("uri"), F.col("p").alias("prop"), F.col("o").alias("obj")
    )
    joined = natural_join(data, vertices.select("id", "uri"), split_rows=split_rows)
    return joined.select("id", "uri", "prop", "obj")


def object_nodes(triples, vertices: DataFrame) -> DataFrame:
    """``(id, uri)`` of vertices that occur as an object of any triple."""
    objects = as_source(triples).ends(sides="o").distinct().withColumnRenamed("node", "uri")
    return vertices.select("id", "uri").join(objects, "uri", "left_semi")


def build_vertices(triples, ids: DataFrame, parts: int = PARTS) -> DataFrame:
    """``(id, uri, part, props)``: every node of ``ids`` with its attributes, if any.

    Nodes with attributes come from an inner join, in which adaptive execution can split a hot
    subject's parts; the others are added with an empty part 0.
    """
    bags = property_bag(triples, parts).withColumnRenamed("s", "uri")
    full = ids.join(bags, "uri").select("id", "uri", "part", "props")
    bare = ids.join(bags.select("uri"), "uri", "left_anti").select(
        "id", "uri", F.lit(0).cast("bigint").alias("part"), F.array().cast(EMPTY_BAG).alias("props")
    )
    return full.unionByName(bare)


def merge_vertices(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of vertex tables; of several copies of a vertex, the one with most properties is kept whole.

    A vertex's copy is all its rows in one of the tables; the earlier table wins a tie.
    """
    copies = union_all(
        [t.select("id", "uri", "part", "props", F.lit(i).alias("#copy")) for i, t in enumerate(parts)]
    )
    sizes = copies.groupBy("id", "uri", "#copy").agg(F.sum(F.size("props")).alias("#n"))
    best = sizes.groupBy("id", "uri").agg(
        F.max_by("#copy", F.struct("#n", -F.col("#copy"))).alias("#copy")
    )
    return copies.join(best, ["id", "uri", "#copy"]).select("id", "uri", "part", "props")


def vertex_counts(triples, ids: DataFrame) -> DataFrame:
    """``(id, uri, n_props)`` of every node, counted on narrow rows; no attribute array is built.

    ``triples`` must be a set, as everywhere.
    """
    counts = data_triples(triples).groupBy(F.col("s").alias("uri")).agg(F.count("*").alias("n_props"))
    return ids.join(counts, "uri", "left").select(
        "id", "uri", F.coalesce("n_props", F.lit(0).cast("bigint")).alias("n_props")
    )


def vertex_heads(vertices: DataFrame) -> DataFrame:
    """``(id, uri, n_props)``: one narrow row per vertex."""
    return vertices.groupBy("id", "uri").agg(F.sum(F.size("props")).alias("n_props"))


def encode_edges(triples, ids: DataFrame, distinct: bool = True) -> DataFrame:
    """Object triples as ``(src, dst, pred)`` over node ids.

    Both sides of each join are plain shuffles, so adaptive execution can split
    a hub.  ``distinct=False`` saves a shuffle where the triples are a set.  Tables as triples are
    a set and meet the ids by their key columns.
    """
    if isinstance(triples, TableTriples):
        return triples.coded_edges(ids)
    edges = object_triples(triples).select("s", "p", "o")
    if distinct:
        edges = edges.distinct()
    source = ids.select(F.col("uri").alias("s"), F.col("id").alias("src"))
    target = ids.select(F.col("uri").alias("o"), F.col("id").alias("dst"))
    return edges.join(source, "s").join(target, "o").select("src", "dst", F.col("p").alias("pred"))


def encode_edges_hashed(triples, distinct: bool = True) -> DataFrame:
    """``encode_edges`` for hash ids, computed in place without any join.

    The ids are checked first: two nodes with one hash raise ``ValueError``.
    """
    assign_ids(graph_nodes(triples))
    edges = object_triples(triples).select(
        F.xxhash64("s").alias("src"), F.xxhash64("o").alias("dst"), F.col("p").alias("pred")
    )
    return edges.distinct() if distinct else edges


def triplet_view(heads: DataFrame, edges: DataFrame) -> DataFrame:
    """Every edge with uri and property count of both ends."""

    def end(key: str, side: str) -> DataFrame:
        return heads.select(
            F.col("id").alias(key),
            F.col("uri").alias(f"{side}_uri"),
            F.col("n_props").alias(f"{side}_n_props"),
        )

    return edges.join(end("dst", "dst"), "dst").join(end("src", "src"), "src").select(
        "src", "src_uri", "src_n_props", "pred", "dst", "dst_uri", "dst_n_props"
    )
