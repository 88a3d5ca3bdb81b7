"""Sorted neighbour arrays of bounded length, and patterns answered from them.

A row holds one chunk of the targets that a node has by one predicate.  A node with many targets has several chunks, a power of two dealt by a
hash of the target, so that any two nodes' chunks are either compatible, and then hold the same targets, or disjoint: closing edges
compare compatible chunks only, and a hub is spread over its chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Targets that a chunk should hold.
CHUNK = 4096

_SCHEMA = "src bigint, chunks bigint, chunk bigint, near array<bigint>, pred string"


def adjacency(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(pred, src, chunks, chunk, near)`` of a set of edges ``(src, dst, pred)``; ``near`` is sorted."""
    many = edges.groupBy("pred", "src").agg(F.count("*").alias("#n")).where(F.col("#n") > chunk)
    cuts = F.pow(F.lit(2), F.ceil(F.log2(F.col("#n") / chunk))).cast("bigint").alias("chunks")
    dealt = edges.join(many.select("pred", "src", cuts), ["pred", "src"], "left").select(
        "pred", "src", "dst", F.coalesce("chunks", F.lit(1).cast("bigint")).alias("chunks")
    )
    place = F.pmod(F.xxhash64("dst"), F.col("chunks")).alias("chunk")
    return dealt.groupBy("pred", "src", "chunks", place).agg(F.array_sort(F.collect_list("dst")).alias("near"))


def write_adjacency(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Partitioned by predicate, ranges of (pred, src), so that a hub's chunks go to many files."""
    dealt = rows.repartitionByRange("pred", "src", "chunk").sortWithinPartitions("pred", "src", "chunk")
    dealt.select("src", "chunks", "chunk", "near", "pred").write.mode(mode).partitionBy("pred").parquet(path)


def open_adjacency(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SCHEMA).parquet(path)


def expand_adjacency(bindings: DataFrame, rows: DataFrame, pred: str, start: str, end: str) -> DataFrame:
    """``bindings`` extended by ``end``, the targets of ``start``: one row per chunk meets the bindings, not one per edge."""
    own = rows.where(F.col("pred") == pred).select(F.col("src").alias(start), F.col("near").alias("#near"))
    columns = [F.col(f"`{c}`") for c in bindings.columns]
    return bindings.join(own, start).select(*columns, F.explode("#near").alias(end))


def close_edges(
    bindings: DataFrame, rows: DataFrame, first: tuple[str, str], second: tuple[str, str], end: str
) -> DataFrame:
    """``bindings`` extended by ``end``, the common targets of two bound nodes; each is given as (variable, predicate).

    Chunks meet by node and are intersected if compatible; of nodes with k and m chunks, max(k, m) pairs are.
    """

    def side(pair: tuple[str, str], mark: str) -> DataFrame:
        names = {"src": pair[0], "chunks": f"#k{mark}", "chunk": f"#c{mark}", "near": f"#n{mark}"}
        own = rows.where(F.col("pred") == pair[1])
        return own.select(*(F.col(a).alias(b) for a, b in names.items()))

    met = bindings.join(side(first, "1"), first[0]).join(side(second, "2"), second[0])
    least = F.least("#k1", "#k2")
    same = met.where(F.pmod(F.col("#c1"), least) == F.pmod(F.col("#c2"), least))
    common = F.array_intersect("#n1", "#n2")
    return same.select(*(F.col(f"`{c}`") for c in bindings.columns), F.explode(common).alias(end))
