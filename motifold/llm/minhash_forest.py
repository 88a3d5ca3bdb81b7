"""Near-duplicates with an LSH forest of MinHash signatures, links confirmed on the full shingle sets.

* Equal shingle sets are one class; its least id, together with the set's digest, stands for it from here on.
* ``TREES`` orders of the signature's positions are the trees.  A region of a tree is the set of classes with a common
  prefix of its order.  Its depth adapts: ``DEPTHS[0]`` positions where that leaves few classes, more where a region is
  crowded.  A pair with similarity s shares d positions of one tree with probability s^d; at 0.85 and depths 3,
  4 and 5 all ``TREES`` trees miss it with probability 3e-7, 7e-6 and 8e-5.
* In a region all members are compared by signature, and each member of a component of likely pairs comes out with the
  component's least member, never all pairs.  The components of the likely pairs of all trees are the groups that links can lie in.
* Each member of a group sends its full set there once, and links are confirmed exactly; they come out in the same
  form.  Their components give each document the least id it can reach.
* A region or group of more than ``BLOCK`` members is cut in blocks and its block pairs go to different tasks, so no
  task gets more than two blocks and nothing is dropped.

Defined cases: a text that is null, empty or white space has no shingles and is linked with nothing; with fewer than five
words, the words are one shingle; equal texts share a component; long texts are taken whole; rows of one id with different
texts are taken each by its own text, and both are kept if it is the least id of both components; rows with a null id
belong to the component of their equals, if any, and have none otherwise; an empty table gives no rows; other columns of the
input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifold.llm import shingles
from motifold.llm.components import components
from motifold.llm.tokens import U, chunks, scrambled
from motifold.llm.work import WORD, bounded, stage

PERCENT = 85
VALUES = 64
TREES = 16
DEPTHS = (3, 4, 5)
#: Most members of a region at all depths but the last.
CROWDED = (64, 4096)
BLOCK = 512
#: Signatures of sets with the similarity looked for agree in so many of 64 positions but for one in 10^8.
LEAST_EQUAL = 36


def _orders() -> np.ndarray:
    """The first positions of each tree's order: four of its own, then some of the others'."""
    own = np.arange(VALUES).reshape(TREES, -1)
    further = np.roll(own, TREES // 2, axis=0)
    return np.column_stack([own, further])[:, : DEPTHS[-1]]


def _same() -> Column:
    return F.unhex(F.md5("text")).alias("same")


def prints(docs: DataFrame, key: str) -> DataFrame:
    """(id, same, n_shingles, digest, sig); same is the text's MD5; no digest for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = shingles.permutations(VALUES)
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column(1)):
                sets = shingles.shingle_sets(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, end - first),
                        batch.column(2).slice(first, end - first),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([shingles.digest(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([shingles.signature(s, a, b).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["id", "same", "n_shingles", "digest", "sig"],
                )

    kind = docs.schema[key].dataType.simpleString()
    narrow = docs.select(key, "text", _same())
    return narrow.mapInArrow(run, f"id {kind}, same binary, n_shingles long, digest binary, sig binary")


def _prefixes(classes: DataFrame) -> DataFrame:
    """(rep, key_3, key_4, key_5) for each class and tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = _orders()
        for batch in batches:
            sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, VALUES)
            n = len(sigs)
            picked = sigs[:, orders].astype(U)  # class, tree, depth
            key = np.broadcast_to(scrambled(np.arange(1, TREES + 1, dtype=U)), (n, TREES))
            keys = []
            for depth in range(DEPTHS[-1]):
                key = scrambled(key * U(0x9E3779B97F4A7C15) + picked[:, :, depth])
                if depth + 1 in DEPTHS:
                    keys.append(pa.array(key.reshape(-1).view(np.int64)))
            rep = batch.column(0).take(pa.array(np.repeat(np.arange(n), TREES)))
            yield pa.RecordBatch.from_arrays([rep, *keys], ["rep", *[f"key_{d}" for d in DEPTHS]])

    kind = classes.schema["rep"].dataType.simpleString()
    return classes.select("rep", "sig").mapInArrow(run, f"rep {kind}, " + ", ".join(f"key_{d} long" for d in DEPTHS))


def _counted(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` of regions with two or more members, with the number of them as ``members``."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("members")).where("members > 1")
    return rows.join(sizes, key)


def regions(classes: DataFrame) -> DataFrame:
    """(region, members, rep): the regions with two or more classes."""
    found, rows = [], _prefixes(classes)
    for i, depth in enumerate(DEPTHS):
        rows = stage(_counted(rows, f"key_{depth}"), "regions")
        crowded = F.col("members") > CROWDED[i] if i < len(CROWDED) else F.lit(False)
        found.append(rows.where(~crowded).select(F.col(f"key_{depth}").alias("region"), "members", "rep"))
        rows = rows.where(crowded).drop("members")
    out = found[0]
    for other in found[1:]:
        out = out.union(other)
    return out


def tiles(found: DataFrame) -> DataFrame:
    """(tile, rep) of ``(region, members, rep)``: what is compared together, two blocks of a region at most."""
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep", "region"), blocks).cast("int")
    with_tiles = found.select("region", "rep", blocks.alias("n"), own.alias("own")).select(
        "region", "rep", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")
    )
    return with_tiles.select(
        F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other")).alias("tile"), "rep"
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of each tile of a partition sorted by tile; a tile's rows are held, no more."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        tile = np.asarray(batch.column(0))
        cuts = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1).tolist(), len(tile)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if last is not None and tile[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = tile[a]
    if held:
        yield pa.Table.from_batches(held)


def _likely(sigs: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each row the later rows whose signatures and sizes allow a link."""
    for i in range(len(sigs) - 1):
        ok = (sigs[i + 1 :] == sigs[i]).sum(axis=1) >= LEAST_EQUAL
        low, high = np.minimum(sizes[i], sizes[i + 1 :]), np.maximum(sizes[i], sizes[i + 1 :])
        yield i, np.flatnonzero(ok & (100 * low >= PERCENT * high)) + i + 1


def _root(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def stars(likely: Iterator[tuple[int, np.ndarray]], ids: list, confirmed=None) -> list[tuple]:
    """The components of the likely pairs, or of those that ``confirmed`` holds for, as links of each member with the least
    id among them: tiles with the same members give the same links."""
    parent = list(range(len(ids)))
    for i, others in likely:
        for j in others.tolist():
            x, y = _root(parent, i), _root(parent, j)
            if x != y and (confirmed is None or confirmed(i, j)):
                parent[max(x, y)] = min(x, y)
    least: dict = {}
    roots = [_root(parent, i) for i in range(len(ids))]
    for root, own in zip(roots, ids, strict=True):
        least[root] = min(least.get(root, own), own)
    return [(least[root], own) for root, own in zip(roots, ids, strict=True) if own != least[root]]


def _stars_of(confirm: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches):
            if len(table) < 2:
                continue
            sigs = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint32).reshape(-1, VALUES)
            sizes = np.asarray(table["n"], np.int64)
            confirmed = Confirmed([unpacked(s) for s in table["shingles"].to_pylist()]) if confirm else None
            reps = [(r["id"], r["digest"]) for r in table["rep"].to_pylist()]
            found = stars(_likely(sigs, sizes), reps, confirmed)
            if found:
                kind = table.schema.field("rep").type
                yield pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x in zip(*found, strict=True)], ["a", "b"])

    return run


class Confirmed:
    """Exact similarity of two of ``sets``; the common words of one set with all others are counted at once."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = [len(s) for s in sets]
        ids, column = np.unique(np.concatenate(sets), return_inverse=True)
        self.columns = np.split(column, np.cumsum(self.sizes)[:-1])
        order = np.argsort(column, kind="stable")
        self.rows = np.repeat(np.arange(len(sets)), self.sizes)[order]  # the sets of each word
        self.bounds = np.searchsorted(column[order], np.arange(len(ids) + 1))
        self.row, self.common, self.asked = -1, None, 0

    def __call__(self, i: int, j: int) -> bool:
        if self.row != i:
            self.row, self.common, self.asked = i, None, 0
        self.asked += 1
        if self.common is None and self.asked > 3:
            mine = self.columns[i]
            starts, lengths = self.bounds[mine], self.bounds[mine + 1] - self.bounds[mine]
            at = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
            self.common = np.bincount(self.rows[at], minlength=len(self.sizes))
        if self.common is not None:
            n = int(self.common[j])
        else:
            n = len(np.intersect1d(self.columns[i], self.columns[j], assume_unique=True))
        return 100 * n >= PERCENT * (self.sizes[i] + self.sizes[j] - n)


def packed(shingles_: np.ndarray) -> bytes:
    """A sorted set as differences, byte plane by byte plane: an eighth less to shuffle."""
    return np.ascontiguousarray(np.diff(shingles_, prepend=U(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U).reshape(-1), dtype=U)


def _sets(docs: DataFrame, key: str) -> DataFrame:
    """(rep, shingles): rep is the row's id and the digest of its set."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column(1)):
                sets = shingles.shingle_sets(data, offsets)
                digests = pa.array([shingles.digest(s) if len(s) else None for s in sets], pa.binary())
                rep = pa.StructArray.from_arrays([batch.column(0).slice(first, end - first), digests], ["id", "digest"])
                yield pa.RecordBatch.from_arrays([rep, pa.array([packed(s) for s in sets], pa.binary())], ["rep", "shingles"])

    return docs.select(key, "text").mapInArrow(run, f"rep struct<id:{kind},digest:binary>, shingles binary")


def _marked(docs: DataFrame, key: str) -> DataFrame:
    """The rows of ``prints`` with ``rep`` and ``component``, the rep of the component; both null for a set without an id."""
    printed = stage(prints(bounded(docs), key), "prints")
    classes = stage(
        printed.where("digest IS NOT NULL AND id IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("id").alias("id"), F.any_value("n_shingles").alias("n"), F.any_value("sig").alias("sig"))
        # By id first, so that the least of a component has its least id.
        .select(F.struct("id", "digest").alias("rep"), "n", "sig"),
        "classes",
    )
    kind = classes.schema["rep"].dataType.simpleString()
    likely = stage(
        tiles(regions(classes))
        .join(classes, "rep")
        .select("tile", "rep", "n", "sig")
        .repartition("tile")
        .sortWithinPartitions("tile")
        .mapInArrow(_stars_of(confirm=False), f"a {kind}, b {kind}"),
        "likely",
    )
    grouped = components(likely).select(F.col("component").alias("region"), F.col("node").alias("rep"))
    sizes = grouped.groupBy("region").agg(F.count("*").alias("members"))
    groups = stage(grouped.join(sizes, "region"), "groups")
    wanted = groups.select(F.col("rep.id").alias(key))
    sets = _sets(docs.select(key, "text").join(wanted, key, "left_semi"), key)
    links = stage(
        tiles(groups)
        .join(sets.where("rep.digest IS NOT NULL").dropDuplicates(["rep"]), "rep")
        .join(classes, "rep")
        .select("tile", "rep", "n", "sig", "shingles")
        .repartition("tile")
        .sortWithinPartitions("tile")
        .mapInArrow(_stars_of(confirm=True), f"a {kind}, b {kind}"),
        "links",
    )
    reached = components(links)
    of_class = classes.join(reached, F.col("rep") == F.col("node"), "left").select(
        "rep.digest", "rep", F.coalesce("component", "rep").alias("component")
    )
    return printed.join(of_class, "digest", "left")


def near_duplicates(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id, kept): kept are those whose id is the least of their component."""
    component = F.coalesce("component.id", "id")
    return _marked(docs, key).select(
        F.col("id").alias(key),
        "n_shingles",
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def deduplicated(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row of ``docs`` for each component, and all rows without shingles.

    It is a row with the least id; of several, one of the least digest, then of the least MD5 of the text, then the least row
    by its columns in order (a column that holds a map counts as its JSON text).  Equal sets of rows that all have null ids
    leave one row in the same way.  Columns may have any names and types.
    """
    own = F.col("component").isNull() | ((F.col("component") == F.col("rep")) & (F.col("id") == F.col("rep.id")))
    chosen = _marked(docs, key).where("digest IS NOT NULL").where(own).groupBy("digest").agg(
        F.min("id").alias("id"), F.min("same").alias("same")
    )
    name = "_row"
    while name in [c.lower() for c in docs.columns]:
        name += "_"
    columns = [F.col(f"`{c}`") for c in docs.columns]
    order = [
        F.to_json(F.struct(c)) if "map<" in field.dataType.simpleString() else c
        for c, field in zip(columns, docs.schema.fields, strict=True)
    ]
    # Null ids are equal inside a struct.
    row = F.struct(F.col(key).alias("id"), _same()).alias(name)
    worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    wanted = chosen.select(F.struct("id", "same").alias(name))
    met = docs.where(worded).select(row, *columns).join(wanted, name, "left_semi")
    first = met.groupBy(name).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_first"))
    return first.select("_first.*").union(docs.where(~worded))
