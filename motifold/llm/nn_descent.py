"""Approximate nearest neighbours: a neighbour graph by NN-descent, queries by greedy graph search.

Graph.  Nodes are the distinct vectors; copies of a vector share a node, which keeps the smallest of their ids.  ``ORDERS`` sorted orders, each
by the sides of random planes through the mean, cut the nodes into short blocks of nodes on the same side of many planes, whose members
are each other's first neighbours (``ORDERS * BLOCK`` scored pairs per node at most, as products of matrices).  A round then joins locally: the
list of a node holds its neighbours and a bounded sample of the nodes that have it as theirs; all pairs of a list with a new member are scored
once, and both ends take the best.  A node so meets the neighbours of its neighbours and nothing else: a round scores at most
``(NEIGHBOURS + REVERSE)^2`` pairs per node, however many nodes there are.  Rounds end when few neighbours change.  A node that many others
point to receives from the sampled ones only, so no list and no group grows with the table.

Search.  Every query has its own list of the best nodes seen.  A round takes the neighbours, in both directions, of the nodes in the list that were not
expanded yet, scores them and keeps the best, until nothing in the list is left to expand.  It starts from the query's own node, as every
query's vector is one.  The best nodes are then scored in double precision on the original vectors, and copies are listed by id.

Vectors travel as 16-bit unit vectors with their length in double precision, so a long vector costs the others no precision.
All rows are indexed.  Tests measure recall against brute force and count the scored pairs.

Defined cases: vectors that are null, of another length than most, zero, or with null or non-finite components take no part, nor
do rows without an id; copies are separate results, ties go to the smaller id; a query does not find its own id; with fewer
candidates all are returned; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motifold.llm.work import stage

NEIGHBOURS = 32
#: Nodes sampled of those that have a node as their neighbour.
REVERSE = 32
#: Best others that a member of a list is offered by that list.
OFFERED = 8
BLOCK = 2048
#: Orders of the nodes for their first neighbours, and the planes of an order; a last projection orders what no plane parts.
ORDERS = 12
PLANES = 30
RANGES = 256
#: Rounds end when so small a part of the neighbours got better.
CHANGED = 0.005
BEAM = 96
#: Rows of a block scored at a time.
PART = 512
#: Nodes, or queries, that one group of a step holds.
GROUP = 512

_GRAPH = "node long, near array<long>, close array<double>, fresh array<boolean>, changed long, scored long"


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(id, vec) of the rows that take part; vec as doubles."""
    vec = F.col(column).cast("array<double>")
    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), vec.alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~F.coalesce(bad, F.lit(True)) & F.exists("vec", lambda x: x != 0))
    length = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (length["n"] if length else 0))


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), kind).reshape(len(data), -1) if data else np.zeros((0, 1), kind)


def _unit_vectors(full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and lengths; a length beyond the greatest double is that."""
    largest = np.abs(full).max(axis=1, keepdims=True)
    unit = full / largest
    length = np.linalg.norm(unit, axis=1, keepdims=True)
    with np.errstate(over="ignore"):
        norm = np.minimum(length * largest, np.finfo(np.float64).max)[:, 0]
    return unit / length, norm


def _mean_unit(rows: DataFrame) -> np.ndarray:
    """The mean of the unit vectors: one row per dimension comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(0), 0
        for batch in batches:
            if len(batch):
                full = np.asarray(batch.column(0).flatten(), np.float64).reshape(len(batch), -1)
                total = _unit_vectors(full)[0].sum(axis=0) + (total if n else 0.0)
                n += len(batch)
        where = pa.array(np.arange(len(total)))
        yield pa.RecordBatch.from_arrays([where, pa.array(total), pa.array(np.full(len(total), n))], ["i", "total", "n"])

    sums = rows.select("vec").mapInArrow(run, "i long, total double, n long").groupBy("i")
    found = sums.agg((F.sum("total") / F.sum("n")).alias("m")).orderBy("i").collect()
    return np.array([r["m"] for r in found])


def node_table(rows: DataFrame, copies: int) -> DataFrame:
    """(node, vec, half, norm, o0, o1, ..., members): node is the least id with this vector, members the least ``copies``;
    half is the unit vector in 16 bits, norm its length, o0 and on are its places in the random orders."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0), np.int64)
            values = batch.column(1)
            flat = np.asarray(values.flatten(), np.float64).reshape(len(ids), -1) + 0.0  # -0 becomes 0
            found: dict[bytes, list[int]] = {}
            for own, row in zip(ids.tolist(), flat, strict=True):
                found.setdefault(row.tobytes(), []).append(own)
            lists = [sorted(set(x))[:copies] for x in found.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()), pa.array(lists, pa.list_(pa.int64()))], ["vec", "members"]
            )

    def ready(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            full = _matrix(batch.column("vec"), "<f8")
            unit, norm = _unit_vectors(full)
            rng = np.random.default_rng(11)
            places = []
            for _ in orders:
                side = (unit - mean) @ rng.standard_normal((full.shape[1], PLANES + 1)) / full.shape[1] ** 0.5
                code = (side[:, :PLANES] > 0) @ (2.0 ** np.arange(PLANES - 1, -1, -1))
                places.append(code + (np.tanh(side[:, PLANES]) + 1) / 2)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node"),
                    batch.column("vec"),
                    pa.array([x.tobytes() for x in unit.astype(np.float16)], pa.binary()),
                    pa.array(norm),
                    *map(pa.array, places),
                    batch.column("members"),
                ],
                ["node", "vec", "half", "norm", *orders, "members"],
            )

    orders = [f"o{i}" for i in range(ORDERS)]
    mean = _mean_unit(rows)
    gathered = rows.mapInArrow(gather, "vec binary, members array<long>")
    merged = gathered.groupBy("vec").agg(
        F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("members")))), 1, copies).alias("members")
    )
    named = merged.select(F.col("members")[0].alias("node"), "vec", "members")
    return named.mapInArrow(
        ready,
        "node long, vec binary, half binary, norm double, " + "".join(f"{o} double, " for o in orders) + "members array<long>",
    )


def blocks_along(nodes: DataFrame, total: int, order: str) -> DataFrame:
    """``nodes`` with their ``block`` of about ``BLOCK`` nodes along a projection.

    Approximate quantiles cut the projection, and each range again until ranges are blocks; a step cuts a range in
    ``RANGES`` at most, so no sketch and no row of bounds grows with the nodes.
    """
    parts = max(1, math.ceil(total / BLOCK))
    ranges = min(RANGES, parts)
    cuts = [i / ranges for i in range(1, ranges)]
    bounds = nodes.approxQuantile(order, cuts, 0.1 / ranges) if cuts and total else []
    above = lambda limits: F.size(F.filter(limits, lambda b: b <= F.col(order))).cast("long")
    block = above(F.array(*map(F.lit, bounds))) if bounds else F.lit(0).cast("long")
    placed = nodes.select("node", "half", "norm", order, block.alias("block"))
    parts = math.ceil(parts / ranges)
    while parts > 1:
        placed = stage(placed, "ranges")
        ranges = min(RANGES, parts)
        cuts = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
        limits = placed.groupBy("block").agg(F.percentile_approx(order, cuts, 10 * ranges).alias("limits"))
        block = F.col("block") * ranges + above("limits")
        placed = placed.join(limits, "block").select("node", "half", "norm", order, block.alias("block"))
        parts = math.ceil(parts / ranges)
    return placed.select("node", "half", "norm", "block")


def _units(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return _matrix(column, "<f2").astype(np.float32)


def _list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Lists of the given lengths from values laid end to end."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _kept(
    owner: np.ndarray, ids: np.ndarray, close: np.ndarray, flag: np.ndarray, keep: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per owner the ``keep`` nearest different ids, nearest first; of equal ids the first given counts."""
    order = np.lexsort((np.arange(len(ids)), ids, owner))
    owner, ids, close, flag = owner[order], ids[order], close[order], flag[order]
    first = np.ones(len(ids), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1])
    owner, ids, close, flag = owner[first], ids[first], close[first], flag[first]
    order = np.lexsort((ids, -close, owner))
    owner, ids, close, flag = owner[order], ids[order], close[order], flag[order]
    start = np.searchsorted(owner, owner, "left")
    top = np.arange(len(owner)) - start < keep
    return owner[top], ids[top], close[top], flag[top]


def _first(table: pa.Table) -> pa.Table:
    ids = np.asarray(table["node"], np.int64)
    unit, norm = _units(table["half"]), np.asarray(table["norm"], np.float64)
    near, close = [], []
    for a in range(0, len(ids), PART):
        score = (unit[a : a + PART] @ unit.T) * norm
        score[np.arange(len(score)), np.arange(a, a + len(score))] = -np.inf
        kept = min(NEIGHBOURS, len(ids) - 1)
        top = np.argpartition(-score, kept - 1, axis=1)[:, :kept] if kept else np.zeros((len(score), 0), np.int64)
        near.append(ids[top])
        close.append(np.take_along_axis(score, top, 1))
    counts = np.full(len(ids), min(NEIGHBOURS, len(ids) - 1))
    size = int(counts.sum())
    return pa.table(
        {
            "node": table["node"],
            "near": _list_array(np.concatenate(near).reshape(-1), counts, pa.int64()),
            "close": _list_array(np.concatenate(close).reshape(-1), counts, pa.float64()),
            "fresh": _list_array(np.ones(size, bool), counts, pa.bool_()),
            "changed": pa.array(np.zeros(len(ids), np.int64)),
            "scored": pa.array(np.full(len(ids), len(ids) - 1)),
        }
    )


def _first_graph(nodes: DataFrame, total: int, order: str) -> DataFrame:
    """Neighbours within the blocks along an order."""
    return blocks_along(nodes, total, order).groupBy("block").applyInArrow(_first, _GRAPH)


_OFFER = "to long, ids array<long>, score array<double>, pairs long"


def _joined(table: pa.Table) -> pa.Table:
    """The local joins of a group of lists: for every member that receives, its best new partners in the list."""
    lists, member = np.asarray(table["node"], np.int64), np.asarray(table["other"], np.int64)
    fresh, takes = np.asarray(table["fresh"]).astype(bool), np.asarray(table["takes"]).astype(bool)
    unit, norm = _units(table["half"]), np.asarray(table["norm"], np.float64)
    # A member that is there twice counts once: new or receiving if one of the two rows is.
    order = np.lexsort((member, lists))
    lists, member, fresh, takes, unit, norm = (x[order] for x in (lists, member, fresh, takes, unit, norm))
    head = np.ones(len(lists), bool)
    head[1:] = (lists[1:] != lists[:-1]) | (member[1:] != member[:-1])
    begin = np.flatnonzero(head)
    fresh, takes = np.logical_or.reduceat(fresh, begin), np.logical_or.reduceat(takes, begin)
    lists, member, unit, norm = lists[head], member[head], unit[head], norm[head]
    _, start, size = np.unique(lists, return_index=True, return_counts=True)
    to, ids, score, counts, pairs = [], [], [], [], []
    width = int(size.max())
    step = max(1, (1 << 22) // (width * max(width, unit.shape[1])))
    for a in range(0, len(start), step):
        # Lists side by side, the short ones filled up with a member that never counts.
        at = start[a : a + step, None] + np.arange(width)
        real = np.arange(width) < size[a : a + step, None]
        at = np.where(real, at, 0)
        block = unit[at]
        close = np.matmul(block, block.transpose(0, 2, 1)) * norm[at][:, None, :]
        able = (fresh[at][:, :, None] | fresh[at][:, None, :]) & real[:, None, :] & (real & takes[at])[:, :, None]
        able &= ~np.eye(width, dtype=bool)
        close = np.where(able, close, -np.inf)
        wide = min(OFFERED, width)
        top = np.argpartition(-close, wide - 1, axis=2)[:, :, :wide]
        best = np.take_along_axis(close, top, 2)
        good = np.isfinite(best)
        rows = good.any(axis=2)
        to.append(member[at][rows])
        who = np.take_along_axis(np.broadcast_to(member[at][:, None, :], close.shape), top, 2)
        ids.append(who[rows][good[rows]])
        score.append(best[rows][good[rows]])
        counts.append(good[rows].sum(axis=1))
        pairs.append(able.sum(axis=2)[rows])
    counts = np.concatenate(counts)
    return pa.table(
        {
            "to": pa.array(np.concatenate(to)),
            "ids": _list_array(np.concatenate(ids), counts, pa.int64()),
            "score": _list_array(np.concatenate(score).astype(np.float64), counts, pa.float64()),
            "pairs": pa.array(np.concatenate(pairs).astype(np.int64)),
        }
    )


def _lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = table[name].combine_chunks()
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False), np.asarray(column.value_lengths(), np.int64)


def _improve(own: pa.Table, offered: pa.Table) -> pa.Table:
    """A group of nodes with the best of their neighbours and of what the lists offered."""
    node = np.asarray(own["node"], np.int64)
    order = np.argsort(node)
    near, size = _lists(own, "near")
    close, _ = _lists(own, "close")
    place = np.repeat(np.arange(len(node)), size)
    scored = np.asarray(own["scored"], np.int64).copy()
    to = order[np.searchsorted(node[order], np.asarray(offered["to"], np.int64))] if len(offered) else np.zeros(0, np.int64)
    ids, counts = _lists(offered, "ids")
    score, _ = _lists(offered, "score")
    np.add.at(scored, to, np.asarray(offered["pairs"], np.int64))
    owner, who, value, new = _kept(
        np.concatenate([place, np.repeat(to, counts)]),
        np.concatenate([near, ids]).astype(np.int64),
        np.concatenate([close, score]).astype(np.float64),
        np.concatenate([np.zeros(len(near), bool), np.ones(len(ids), bool)]),
        NEIGHBOURS,
    )
    counts = np.bincount(owner, minlength=len(node))
    return pa.table(
        {
            "node": own["node"],
            "near": _list_array(who, counts, pa.int64()),
            "close": _list_array(value, counts, pa.float64()),
            "fresh": _list_array(new, counts, pa.bool_()),
            "changed": pa.array(np.bincount(owner, new, len(node)).astype(np.int64)),
            "scored": pa.array(scored),
        }
    )


def _group(column: str, total: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(max(1, math.ceil(total / GROUP))))


def _sampled(edges: DataFrame) -> DataFrame:
    """At most ``REVERSE`` of the edges to one node.  Spark limits a node's rows in every task before they travel."""
    rank = F.row_number().over(Window.partitionBy("other").orderBy(F.xxhash64("node", "other"), "node"))
    return edges.withColumn("rank", rank).where(F.col("rank") <= REVERSE).drop("rank")


def neighbour_graph(nodes: DataFrame) -> DataFrame:
    """(node, near, close, fresh, changed, scored), written to the shared work folder."""
    halves = nodes.select(F.col("node").alias("other"), "half", "norm")
    total = nodes.count()
    graphs = [stage(_first_graph(nodes, total, f"o{i}"), "graph") for i in range(ORDERS)]
    group = _group("node", total).alias("group")
    other = reduce(DataFrame.union, graphs[1:]).select(
        F.col("node").alias("to"), F.col("near").alias("ids"), F.col("close").alias("score"), F.col("scored").alias("pairs")
    )
    to_group = _group("to", total).alias("group")
    merged = graphs[0].select("*", group).groupBy("group").cogroup(other.select("*", to_group).groupBy("group"))
    graph = stage(merged.applyInArrow(_improve, _GRAPH), "graph")
    graph = graph.withColumn("fresh", F.transform("near", lambda _: F.lit(True)))
    while True:
        edges = graph.select("node", F.explode(F.arrays_zip("near", "fresh")).alias("x")).select(
            "node", F.col("x.near").alias("other"), F.col("x.fresh").alias("fresh")
        )
        sample = stage(_sampled(edges), "sample")
        # A node's list: its neighbours, which receive if they sampled it, and its own sample, which does.
        asked = edges.join(sample.select("node", "other", F.lit(True).alias("s")), ["node", "other"], "left").select(
            "node", "other", "fresh", F.coalesce("s", F.lit(False)).alias("takes")
        )
        back = sample.select(F.col("other").alias("node"), F.col("node").alias("other"), "fresh", F.lit(True).alias("takes"))
        members = asked.unionByName(back).join(halves, "other").select("*", group)
        offered = members.groupBy("group").applyInArrow(_joined, _OFFER)
        own = graph.select("*", group).groupBy("group")
        graph = stage(own.cogroup(offered.select("*", to_group).groupBy("group")).applyInArrow(_improve, _GRAPH), "graph")
        if (graph.agg(F.sum("changed").alias("c")).first()["c"] or 0) <= CHANGED * total * NEIGHBOURS:
            return graph


_STATE = "query long, half binary, best array<long>, close array<double>, open array<boolean>"


def _widen(own: pa.Table, offered: pa.Table) -> pa.Table:
    """Puts the offered nodes in the lists of their queries; ``open`` are those new in a list, to be expanded."""
    query = np.asarray(own["query"], np.int64)
    order = np.argsort(query)
    held, size = _lists(own, "best")
    close, _ = _lists(own, "close")
    asked = np.asarray(offered["to"], np.int64)
    to = order[np.searchsorted(query[order], asked)] if len(asked) else np.zeros(0, np.int64)
    given = np.asarray(offered["other"], np.int64)
    score = np.zeros(len(to))
    mine = _units(own["half"])
    if len(to):
        theirs = _units(offered["given"])
        score = np.einsum("ij,ij->i", mine[to], theirs).astype(np.float64) * np.asarray(offered["norm"], np.float64)
    owner, who, value, new = _kept(
        np.concatenate([np.repeat(np.arange(len(query)), size), to]),
        np.concatenate([held, given]).astype(np.int64),
        np.concatenate([close, score]).astype(np.float64),
        np.concatenate([np.zeros(len(held), bool), np.ones(len(given), bool)]),
        BEAM,
    )
    counts = np.bincount(owner, minlength=len(query))
    return pa.table(
        {
            "query": own["query"],
            "half": own["half"],
            "best": _list_array(who, counts, pa.int64()),
            "close": _list_array(value, counts, pa.float64()),
            "open": _list_array(new, counts, pa.bool_()),
        }
    )


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame) -> DataFrame:
    """(query, node) of ``queries`` (query, own, half), own being the node with the query's vector: the nodes found for each."""
    halves = nodes.select(F.col("node").alias("other"), "half", "norm")
    total = queries.count()
    group = _group("query", total).alias("group")
    edges = graph.select("node", F.explode("near").alias("other"))
    back = _sampled(edges).select(F.col("other").alias("node"), F.col("node").alias("other"))
    links = stage(edges.union(back).distinct().select(F.col("node").alias("from"), "other"), "links")
    none = [F.array().cast(f"array<{kind}>").alias(name) for name, kind in (("best", "long"), ("close", "double"), ("open", "boolean"))]
    state = queries.select("query", "half", *none)
    found = queries.select("query", F.col("own").alias("other"))
    while True:
        offered = found.join(halves, "other").select(
            F.col("query").alias("to"), "other", F.col("half").alias("given"), "norm"
        ).withColumn("into", _group("to", total))
        own = state.select("*", group).groupBy("group")
        state = stage(own.cogroup(offered.groupBy("into")).applyInArrow(_widen, _STATE), "search")
        at = F.explode(F.filter(F.arrays_zip("best", "open"), lambda x: x["open"])).alias("x")
        edge = state.select("query", at).select("query", F.col("x.best").alias("from"))
        if edge.isEmpty():
            return state.select("query", F.explode("best").alias("node"))
        found = edge.join(links, "from").select("query", "other").distinct()


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = _matrix(batch.column("wanted"), "<f8"), _matrix(batch.column("vec"), "<f8")
        yield pa.RecordBatch.from_arrays(
            [batch.column("query"), batch.column("members"), pa.array(np.einsum("ij,ij->i", a, b))],
            ["query", "members", "score"],
        )


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", column: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows where ``is_query`` holds, the ``k`` nearest others found."""
    rows = usable(vectors, key, column)
    nodes = stage(node_table(rows, k + 1), "nodes")
    graph = neighbour_graph(nodes)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.asarray(batch.column(1).flatten(), np.float64).reshape(len(batch), -1) + 0.0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x.tobytes() for x in flat], pa.binary())], ["query", "wanted"]
            )

    asked = rows.where(is_query).mapInArrow(raw, "query long, wanted binary").dropDuplicates(["query"])
    asked = stage(asked, "queries")
    # A query's vector is a node's; that node's 16-bit form serves the search.
    own = asked.join(nodes.select("node", "vec", "half"), F.col("wanted") == F.col("vec"))
    found = search(stage(own.select("query", F.col("node").alias("own"), "half"), "queries"), nodes, graph)
    scored = (
        found.join(nodes.select("node", "vec", "members"), "node")
        .join(asked, "query")
        .select("query", "wanted", "vec", "members")
        .mapInArrow(_exact, "query long, members array<long>, score double")
        .select("query", F.explode("members").alias("vec_id"), "score")
        .where("query <> vec_id")
    )
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return (
        scored.select(F.col("query").alias("query_id"), rank.cast("int").alias("rank"), "vec_id", "score")
        .where(F.col("rank") <= k)
    )
