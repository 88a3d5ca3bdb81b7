"""A graph in bucketed tables, so that joins by node shuffle no node table.

``write_ids`` keeps a dictionary (id, uri) in buckets by uri, for encoding triples again and again; ``write_located`` keeps nodes,
edges by source, edges by target and attributes in buckets by node.  A join by node then reads bucket by bucket.

Bucketed joins cannot be split while they run, so hot nodes are split when they are written: a node with more than ``split_rows`` rows in a
relation has several pieces, its rows are dealt over them and its node row is repeated once per piece.  Buckets are made of
(node, piece).  In encoding, where triples come unprepared, hot nodes are counted and their ids broadcast: (rows of
triples) / ``split_rows`` nodes per end at most.

A table is a folder that any session can open: the layout, one row, is written last and says how it is cut.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.triples import data_triples, graph_nodes, object_triples
from ..session import stage
from .tables import TableTriples

#: Rows of a bucket, and rows of one node's piece.
BUCKET_ROWS = 4_000_000
SPLIT_ROWS = 1_000_000

_LAYOUT = "keys array<string>, buckets int, columns string"


def bucket_count(spark: SparkSession, rows: int) -> int:
    """Buckets for so many rows; not fewer than the session's shuffles have, or Spark would rather shuffle."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))


def _table_name(path: str) -> str:
    return "located_" + hashlib.sha256(path.encode()).hexdigest()[:32]


def _quoted(names) -> str:
    return ", ".join(f"`{n}`" for n in names)


def write_bucketed(df: DataFrame, path: str, keys: list[str], buckets: int) -> None:
    """``df`` as one sorted file per bucket of ``keys``; a folder without a layout may be written again."""
    spark = df.sparkSession
    name = _table_name(path)
    # The name stands for this folder alone: an entry of an unfinished write is forgotten, its files are overwritten.
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    dealt = df.repartition(buckets, *(F.col(k) for k in keys))
    writer = dealt.write.mode("overwrite").format("parquet").option("path", f"{path}/rows").option("compression", "zstd")
    writer.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    # The schema without "not null", which Parquet does not keep.
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    layout = spark.range(1).select(
        F.array(*map(F.lit, keys)).alias("keys"), F.lit(buckets).alias("buckets"), F.lit(columns).alias("columns")
    )
    layout.write.mode("errorifexists").parquet(f"{path}/layout")


def open_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The table in ``path``, with its buckets known to the planner, in whichever session it was written."""
    layout = spark.read.schema(_LAYOUT).parquet(f"{path}/layout").first()
    name, keys = _table_name(path), _quoted(layout["keys"])
    location = f"{path}/rows".replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({layout['columns']}) USING parquet LOCATION '{location}' "
        f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {layout['buckets']} BUCKETS"
    )
    return spark.table(name)


def write_ids(ids: DataFrame, path: str, buckets: int | None = None) -> None:
    """``(id, uri)`` in buckets by uri."""
    spark = ids.sparkSession
    write_bucketed(ids.select("id", "uri"), path, ["uri"], buckets or bucket_count(spark, ids.count()))


def _hot_ends(edges: DataFrame, split_rows: int) -> DataFrame:
    """``(end, node)`` of nodes with more than ``split_rows`` edges at that end ('s' or 'o'), counted in one pass."""
    ends = edges.select(
        F.explode(F.array(*(F.struct(F.lit(c).alias("end"), F.col(c).alias("node")) for c in ("s", "o")))).alias("x")
    )
    counts = ends.groupBy("x.end", "x.node").agg(F.count("*").alias("#n"))
    return counts.where(F.col("#n") > split_rows).select("end", "node")


def encode_located(triples, ids: DataFrame, distinct: bool = True, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Object triples as ``(src, dst, pred)`` over the ids of ``open_bucketed``, whose rows are not shuffled.

    Triples of a hot node take its id from a broadcast and go to the join under a key of their own, which spreads
    them.  Triples with an end that has no id are left out, as in ``encode_edges``.

    Edges of tables as triples meet the ids by their key columns.  A dictionary of more nodes than the tables can have is
    first cut to their nodes, one row each and so without hot ones; one of other size is met as it is.
    """
    if isinstance(triples, TableTriples):
        # Two ends a triple.
        if ids.count() > 2 * triples.most_rows():
            nodes = graph_nodes(triples).withColumnRenamed("node", "uri")
            ids = stage(nodes.join(ids, "uri").select("id", "uri"), "known-ids")
        return triples.coded_edges(ids)
    edges = object_triples(triples).select("s", "p", "o")
    if distinct:
        edges = edges.distinct()
    ends = stage(_hot_ends(edges, split_rows), "hot-nodes")
    hot = stage(ends.join(ids, F.col("node") == F.col("uri")).select("end", "node", "id"), "hot-ids")
    for end, name in (("s", "src"), ("o", "dst")):
        known = hot.where(F.col("end") == end).select(F.col("node").alias(end), F.col("id").alias("#hot"))
        edges = edges.join(F.broadcast(known), end, "left")
        # No node begins with '#'.  Of the first join only the id is carried to the second.
        own = F.concat(F.lit("#"), F.xxhash64("p", "s" if name == "src" else "src", "o"))
        key = F.when(F.col("#hot").isNotNull(), own).otherwise(F.col(end))
        found = ids.select(F.col("uri").alias("#key"), F.col("id").alias("#id"))
        edges = edges.withColumn("#key", key).join(found, "#key", "left")
        edges = edges.withColumn(name, F.coalesce("#hot", "#id")).where(F.col(name).isNotNull()).drop("#hot", "#key", "#id")
    return edges.select("src", "dst", F.col("p").alias("pred"))


@dataclass(frozen=True)
class Located:
    """Tables of one graph in buckets of (node, piece); ``piece`` numbers the parts of a hot node."""

    nodes: DataFrame  # id, piece, uri, n_props
    out: DataFrame  # src, piece, dst, pred
    into: DataFrame  # dst, piece, src, pred
    props: DataFrame  # id, piece, prop, obj


_KEYS = {"nodes": "id", "out": "src", "into": "dst", "props": "id"}


def write_located(
    heads: DataFrame,
    edges: DataFrame,
    props: DataFrame,
    path: str,
    buckets: int | None = None,
    split_rows: int = SPLIT_ROWS,
) -> None:
    """Nodes ``(id, uri, n_props)``, edges ``(src, dst, pred)`` and attributes ``(id, prop, obj)`` in buckets by node.

    The inputs are read several times: give tables, not queries.  Edges that lie sorted by source take less to
    move by source.
    """
    spark = edges.sparkSession
    if buckets is None:
        buckets = bucket_count(spark, max(heads.count(), edges.count(), props.count()))
    relations = {
        "out": (edges.select("src", "dst", "pred"), F.xxhash64("dst", "pred")),
        "into": (edges.select("dst", "src", "pred"), F.xxhash64("src", "pred")),
        "props": (props.select("id", "prop", "obj"), F.xxhash64("prop", "obj")),
    }
    cut_tables = {}
    for name, (rows, _) in relations.items():
        counts = rows.groupBy(F.col(_KEYS[name]).alias("#node")).agg(F.count("*").alias("#n"))
        cut = F.ceil(F.col("#n") / F.lit(split_rows)).cast("int").alias("#pieces")
        # Hot nodes only: rows / split_rows at most.
        cut_tables[name] = stage(counts.where(F.col("#n") > split_rows).select("#node", cut), "hot-nodes")
    for name, (rows, dealt_by) in relations.items():
        key = _KEYS[name]
        met = rows.join(F.broadcast(cut_tables[name]), F.col(key) == F.col("#node"), "left")
        piece = F.pmod(dealt_by, F.coalesce("#pieces", F.lit(1))).cast("int").alias("piece")
        write_bucketed(met.select(key, piece, *rows.drop(key).columns), f"{path}/{name}", [key, "piece"], buckets)
    cuts = cut_tables["out"].unionByName(cut_tables["into"]).unionByName(cut_tables["props"])
    most = cuts.groupBy("#node").agg(F.max("#pieces").alias("#pieces"))
    met = heads.join(F.broadcast(most), F.col("id") == F.col("#node"), "left")
    pieces = F.sequence(F.lit(0), F.coalesce("#pieces", F.lit(1)) - 1)
    nodes = met.select("id", F.explode(pieces).alias("piece"), "uri", "n_props")
    write_bucketed(nodes, f"{path}/nodes", ["id", "piece"], buckets)


def open_located(spark: SparkSession, path: str) -> Located:
    return Located(*(open_bucketed(spark, f"{path}/{name}") for name in ("nodes", "out", "into", "props")))


def _end(graph: Located, key: str, side: str) -> DataFrame:
    return graph.nodes.select(
        F.col("id").alias(key), "piece", F.col("uri").alias(f"{side}_uri"), F.col("n_props").alias(f"{side}_n_props")
    )


def located_sources(graph: Located) -> DataFrame:
    """Every edge with the uri and property count of its source, without a shuffle."""
    return graph.out.join(_end(graph, "src", "src"), ["src", "piece"]).drop("piece")


def located_targets(graph: Located) -> DataFrame:
    """Every edge with the uri and property count of its target, without a shuffle."""
    return graph.into.join(_end(graph, "dst", "dst"), ["dst", "piece"]).drop("piece")


def located_props(graph: Located) -> DataFrame:
    """``(id, uri, prop, obj)`` of every attribute, without a shuffle."""
    return graph.props.join(graph.nodes.drop("n_props"), ["id", "piece"]).select("id", "uri", "prop", "obj")


def located_view(graph: Located) -> DataFrame:
    """``triplet_view`` of a located graph: of four tables joined, only the half-made view moves, once.

    It goes to the buckets of its targets; a hot target's edges are dealt over the pieces that the node has.
    """
    # The node table is asked how many pieces a target has: only nodes with several, and those are few.
    cut = graph.nodes.where("piece > 0").groupBy(F.col("id").alias("#node")).agg((F.max("piece") + 1).alias("#pieces"))
    half = located_sources(graph)
    half = half.join(F.broadcast(cut), F.col("dst") == F.col("#node"), "left")
    piece = F.pmod(F.xxhash64("src", "pred"), F.coalesce("#pieces", F.lit(1))).cast("int")
    placed = half.withColumn("piece", piece).drop("#node", "#pieces")
    return placed.join(_end(graph, "dst", "dst"), ["dst", "piece"]).select(
        "src", "src_uri", "src_n_props", "pred", "dst", "dst_uri", "dst_n_props"
    )


def coded_props(triples, ids: DataFrame) -> DataFrame:
    """``(id, prop, obj)`` of attribute triples over the ids of ``open_bucketed``, for ``write_located``."""
    data = data_triples(triples).select(F.col("s").alias("uri"), F.col("p").alias("prop"), F.col("o").alias("obj"))
    return data.join(ids, "uri").select("id", "prop", "obj")
