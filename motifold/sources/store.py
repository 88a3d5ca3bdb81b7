"""A graph stored as Parquet: triples by batch and predicate, the catalog, vertices and edges.

A store is a sequence of batches of new triples, ``triples/batch=N/p=...``, each with a catalog, ``catalog/batch=N``,
of one row per predicate.  The catalog of a batch is written last, as one file, and a batch without a catalog is not read:
an append is seen whole or not at all, and one that failed is simply made again.  Catalogs merge: triples add up,
since batches do not overlap; a predicate is data if any batch says so and functional if all do.  A
compacted batch names the first batch that it stands for.  One writer at a time; readers need no lock.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.terms import triple_kind
from ..operators.charsets import characteristic_sets
from ..session import BROADCAST_BYTES, stage, text_bytes
from .triples import FrameTriples

#: Rows that one range of a batch should hold.
RANGE_ROWS = 2_000_000
#: Rows looked at for what the terms of a predicate have in common.
COMMON_ROWS = 50_000
#: Most rows of an input whose size is measured, and which is broadcast to the stored triples if it is small.
SMALL_ROWS = 200_000

_SETS = "predicates array<string>, n_subjects bigint, n_triples array<bigint>"
_CATALOG = "p string, kind string, n bigint, functional boolean, since int"


def write_store(t: DataFrame, path: str, distinct: bool = False, rows: int | None = None) -> None:
    """Write a set of triples as the first batch of a new store, with its catalog.

    Rows are range-partitioned by (p, s, o): a predicate or subject that holds a
    large share of the rows is cut into many ranges, a rare predicate gets few
    files, and row groups carry narrow subject ranges.  Objects get a Parquet
    bloom filter for lookups from the other end.  ``distinct`` takes a bag: repeats meet in their range,
    so that no shuffle of its own is needed.  ``rows``, about how many there are, bounds the rows of a range.
    """
    _write_batch(t.select("s", "p", "o"), path, 0, "errorifexists", distinct, rows)
    _write_catalog(_batch_catalog(t.sparkSession, path, 0, ()), path, 0, 0)


def _write_batch(t: DataFrame, path: str, number: int, mode: str, distinct: bool = False, rows: int | None = None) -> None:
    ranges = -(-(rows or 0) // RANGE_ROWS)
    # Left alone, ranges are merged by their packed bytes, and sorted rows pack well.
    more = ranges > t.sparkSession.sparkContext.defaultParallelism
    dealt = t.repartitionByRange(*([ranges] if more else []), "p", "s", "o")
    if distinct:
        # The window sorts a range as the writer needs it; repeats follow each other, no table of its rows is kept.
        same = Window.partitionBy("p", "s", "o").orderBy("p", "s", "o")
        dealt = dealt.withColumn("#k", F.row_number().over(same)).where(F.col("#k") == 1).drop("#k")
    else:
        dealt = dealt.sortWithinPartitions("p", "s", "o")
    (
        dealt.write.mode(mode)
        .option("parquet.bloom.filter.enabled#o", "true")
        .partitionBy("p")
        .parquet(f"{path}/triples/batch={number}")
    )


def _common_parts(t: DataFrame, predicates: Sequence[str]) -> list[tuple[str, str, str, str]]:
    """Of each predicate its number, as text in order, and what its subjects and objects mostly begin with, by a sample."""
    part = min(1.0, COMMON_ROWS / max(1, t.count()))
    ends = t.sample(part, seed=1).groupBy("p").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("s", "o") for f in (F.min, F.max)))
    found = {r["p"]: r for r in ends.collect()}  # one row per predicate
    width = len(str(len(predicates)))

    def common(p: str, c: str) -> str:
        return commonprefix([found[p][f"min_{c}"], found[p][f"max_{c}"]]) if p in found else ""

    return [(p, f"{i:0{width}}", common(p, "s"), common(p, "o")) for i, p in enumerate(sorted(predicates))]


#: What stands for the common beginning of a string, and before a string that sorts below or above all that begin so.
_CUT, _BELOW, _ABOVE = "1", "0", "2"


def _cut(column: str, common: str) -> Column:
    """The bytes of a string without a common beginning; the order stays, whatever the string begins with."""
    text, rest = F.col(column), F.expr(f"substring(cast(`{column}` as binary), octet_length(`{common}`) + 1)")
    marked = lambda mark, value: F.concat(F.lit(mark).cast("binary"), value)
    whole = F.when(text < F.col(common), marked(_BELOW, text.cast("binary"))).otherwise(marked(_ABOVE, text.cast("binary")))
    return F.when(text.startswith(F.col(common)), marked(_CUT, rest)).otherwise(whole)


def _uncut(cut: str, common: str) -> Column:
    rest = F.expr(f"substring({cut}, 2)")
    is_cut = F.expr(f"substring({cut}, 1, 1)") == F.lit(_CUT).cast("binary")
    return F.when(is_cut, F.concat(F.col(common).cast("binary"), rest)).otherwise(rest).cast("string")


def _write_new(
    t: DataFrame, path: str, number: int, stored: DataFrame | None, single: Sequence[str], rows: int | None
) -> tuple[str, ...]:
    """Write the triples of ``t``, a table that is read several times, that ``stored`` does not have; repeats meet in their range.

    Only ``stored`` of predicates of ``t`` is needed; of those in ``single`` it has one triple per subject.  Gives those
    of them of which a subject now has two.  What most subjects and objects of a predicate begin with stays behind when rows
    move, and the predicate moves as a number, so that rows are short and differ early where they are sorted.
    """
    spark = t.sparkSession
    predicates = [r["p"] for r in t.select("p").distinct().collect()]  # one row per predicate
    if not predicates:
        t.select("s", "o", "p").limit(0).write.mode("overwrite").partitionBy("p").parquet(f"{path}/triples/batch={number}")
        return ()
    common = _common_parts(t, predicates)
    listed = [
        F.struct(*(F.lit(x).alias(n) for x, n in zip((*row, row[0] in single), ("p", "#r", "#sp", "#op", "#is_single"), strict=True)))
        for row in common
    ]
    parts = spark.range(1).select(F.inline(F.array(*listed)))
    ranges = -(-(rows or 0) // RANGE_ROWS)
    # Left alone, ranges are merged by their packed bytes, and sorted rows pack well.
    more = ranges > spark.sparkContext.defaultParallelism
    is_single = F.col("#is_single")

    def moved(df: DataFrame, is_new: bool) -> DataFrame:
        """Predicate and subject; the object, apart if the subject has at most one stored."""
        o = _cut("o", "#op")
        return df.join(F.broadcast(parts), "p").select(
            F.concat(F.col("#r").cast("binary"), _cut("s", "#sp")).alias("#k"),
            (F.when(is_single, F.lit("").cast("binary")).otherwise(o) if single else o).alias("#o"),
            (F.when(is_single, o) if single else F.lit(None).cast("binary")).alias("#one"),
            F.lit(is_new).alias("#new"),
        )

    both = moved(t, True) if stored is None else moved(t, True).unionByName(moved(stored, False))
    dealt = both.repartitionByRange(*([ranges] if more else []), "#k", "#o")
    # Equal triples, or those of a subject with at most one stored, the stored one first; no table of them is kept.
    same = Window.partitionBy("#k", "#o").orderBy("#new", "#one")
    digits = len(common[0][1])
    met = Observation()
    if not single:
        kept = dealt.withColumn("#before", F.lag("#new").over(same)).where(F.col("#new") & F.col("#before").isNull())
    else:
        so_far = same.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = dealt.select(
            "*",
            F.lag("#new").over(same).alias("#before"),
            F.lag("#one").over(same).alias("#one_before"),
            F.min("#new").over(so_far).alias("#all_new"),
            F.first("#one").over(so_far).alias("#first"),
        )
        known = ~F.col("#all_new") & F.col("#one").eqNullSafe(F.col("#first"))
        again = F.col("#one").eqNullSafe(F.col("#one_before"))
        kept = found.where(F.col("#new") & (F.col("#before").isNull() | ~(known | again)))
        second = F.when(~F.col("#all_new"), F.expr(f"cast(substring(`#k`, 1, {digits}) as string)"))
        kept = kept.observe(met, F.collect_set(second).alias("numbers"))  # one per predicate
    kept = kept.withColumn("#r", F.expr(f"cast(substring(`#k`, 1, {digits}) as string)")).join(F.broadcast(parts), "#r").select(
        _uncut(f"substring(`#k`, {digits + 1})", "#sp").alias("s"),
        _uncut("coalesce(`#one`, `#o`)", "#op").alias("o"),
        "p",
    )
    (
        kept.sortWithinPartitions("p", "s", "o")  # they lie so already, but the writer has to know it
        .write.mode("overwrite")
        .option("parquet.bloom.filter.enabled#o", "true")
        .partitionBy("p")
        .parquet(f"{path}/triples/batch={number}")
    )
    return tuple(common[int(r)][0] for r in sorted(met.get["numbers"])) if single else ()


def _batch_rows(spark: SparkSession, path: str, number: int) -> DataFrame:
    return spark.read.schema("s string, o string, p string").parquet(f"{path}/triples/batch={number}")


_ENDS = "p string, s string, n long, repeated boolean, is_data boolean"


def _subject_ends(rows: DataFrame) -> DataFrame:
    """First and last subject of every predicate in each Arrow batch of sorted rows; the first has what is known of the rows."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p, s = batch.column("p"), batch.column("s")
            is_data = batch.column("is_data").to_numpy(zero_copy_only=False)

            def same(column: pa.Array) -> np.ndarray:
                return pc.fill_null(pc.equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False)

            same_p = same(p)
            again = same_p & same(s)
            cuts = [0, *(np.flatnonzero(~same_p) + 1).tolist(), batch.num_rows]
            rows = []
            for start, stop in zip(cuts, cuts[1:], strict=False):
                name, first, last = p[start].as_py(), s[start].as_py(), s[stop - 1].as_py()
                rows.append((name, first, stop - start, bool(again[start : stop - 1].any()), bool(is_data[start:stop].any())))
                if last != first:
                    rows.append((name, last, 0, False, False))
            names = ("p", "s", "n", "repeated", "is_data")
            kinds = (pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.bool_())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=list(names))

    return rows.mapInArrow(ends, _ENDS)


def _batch_catalog(spark: SparkSession, path: str, number: int, broken: Iterable[str]) -> DataFrame:
    """One row per predicate of a batch; ``broken`` ones are functional in it, but not together with earlier batches.

    The rows of a file are sorted by (p, s, o) and ranges do not overlap, so two triples of a subject follow each other or lie
    at the ends of two Arrow batches: only these ends are shuffled, and no task keeps its subjects.
    """
    is_data = triple_kind(F.col("p"), F.col("o")) != "object"
    ends = _subject_ends(_batch_rows(spark, path, number).select("p", "s", is_data.alias("is_data")))
    per_end = ends.groupBy("p", "s").agg(
        F.count("*").alias("met"),
        F.sum("n").alias("n"),
        F.bool_or("repeated").alias("repeated"),
        F.bool_or("is_data").alias("is_data"),
    )
    return per_end.groupBy("p").agg(
        F.when(F.bool_or("is_data"), "data").otherwise("object").alias("kind"),
        F.sum("n").alias("n"),
        ((F.max("met") == 1) & ~F.bool_or("repeated") & ~F.col("p").isin(list(broken))).alias("functional"),
    )


def _write_catalog(catalog: DataFrame, path: str, number: int, since: int) -> None:
    """The mark of a complete batch: one small file, so that it appears at once."""
    one = catalog.select("p", "kind", "n", "functional", F.lit(since).alias("since")).coalesce(1)
    one.write.mode("overwrite").parquet(f"{path}/catalog/batch={number}")


def _all_catalogs(spark: SparkSession, path: str) -> DataFrame:
    schema = f"{_CATALOG}, batch int"
    try:
        return spark.read.schema(schema).parquet(f"{path}/catalog")
    except AnalysisException:  # a store without a complete batch
        return spark.createDataFrame([], schema)


def _catalogs(spark: SparkSession, path: str) -> DataFrame:
    """Catalog rows of the complete batches that no compacted batch stands for."""
    rows = _all_catalogs(spark, path)
    heads = rows.select("batch", "since").distinct().collect()  # one row per batch
    covered = {b["batch"] for b in heads for c in heads if c["since"] <= b["batch"] < c["batch"]}
    return rows.where(~F.col("batch").isin(sorted(covered)))


def store_batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that make up the store now, oldest first."""
    return sorted(r["batch"] for r in _catalogs(spark, path).select("batch").distinct().collect())


def _next_batch(spark: SparkSession, path: str) -> int:
    return (_all_catalogs(spark, path).agg(F.max("batch").alias("b")).first()["b"] or 0) + 1


def store_catalog(spark: SparkSession, path: str) -> DataFrame:
    """``(p, kind, n, functional)``: the merged catalogs, one row per predicate."""
    return _catalogs(spark, path).groupBy("p").agg(
        F.when(F.bool_or(F.col("kind") == "data"), "data").otherwise("object").alias("kind"),
        F.sum("n").alias("n"),
        F.bool_and("functional").alias("functional"),
    )


def _stored_triples(spark: SparkSession, path: str, batches: list[int]) -> DataFrame:
    rows = spark.read.schema("s string, o string, batch int, p string").parquet(f"{path}/triples")
    return rows.where(F.col("batch").isin(batches)).select("s", "o", "p")


def open_store(spark: SparkSession, path: str) -> FrameTriples:
    """The stored triples as a pattern source with its catalog; batches and predicates are partitions of the scan.

    Characteristic sets are used if they were written for the batches that the store has now.
    """
    batches = store_batches(spark, path)
    sets = stored_sets(spark, path, batches)
    return FrameTriples(_stored_triples(spark, path, batches), store_catalog(spark, path), sets)


def write_sets(spark: SparkSession, path: str) -> None:
    """Write the characteristic sets of a store.  An append changes the sets of known subjects: write them again after it."""
    batches = store_batches(spark, path)
    name = "-".join(map(str, batches))
    characteristic_sets(_stored_triples(spark, path, batches)).coalesce(1).write.mode("overwrite").parquet(f"{path}/sets/{name}")


def stored_sets(spark: SparkSession, path: str, batches: list[int] | None = None) -> DataFrame | None:
    """The characteristic sets of the store as it is now, or None if none were written for its batches."""
    name = "-".join(map(str, store_batches(spark, path) if batches is None else batches))
    try:
        return spark.read.schema(_SETS).parquet(f"{path}/sets/{name}")
    except AnalysisException:
        return None


def write_bitmaps(bitmaps: DataFrame, path: str, mode: str = "append") -> None:
    """Add bitmaps to a table partitioned by predicate; those of one bucket from several batches are OR-ed by its readers.

    Rows are range-partitioned by (p, o, bucket), so a predicate of all nodes is cut into many files.
    """
    rows = bitmaps.select("o", "bucket", "bits", "p").repartitionByRange("p", "o", "bucket")
    rows.sortWithinPartitions("p", "o", "bucket").write.mode(mode).partitionBy("p").parquet(path)


def open_bitmaps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("o string, bucket bigint, bits binary, p string").parquet(path)


@dataclass(frozen=True)
class Batch:
    """Triples written, but not part of the store until ``commit_append``."""

    path: str
    number: int
    triples: DataFrame
    broken: tuple[str, ...]


def begin_append(t: DataFrame, path: str, distinct: bool = True, rows: int | None = None) -> Batch:
    """Write what ``t`` adds to a store; ``t`` may hold known triples.

    ``distinct=False`` says that ``t`` repeats none; ``rows`` is about how many it has.  Repeats meet where stored triples do.

    Only partitions of predicates that occur in ``t`` are read.  New and stored triples meet in the ranges of the writer, so
    each moves once; of a small input only stored triples of its subjects do, found by a semi join from the stored side.
    A predicate that was functional meets by subject: its one stored triple per subject tells both whether a triple is
    known and whether the subject now has two.
    """
    spark = t.sparkSession
    t = t.select("s", "p", "o")
    batches = store_batches(spark, path)
    number = _next_batch(spark, path)
    if not batches:  # nothing to meet
        _write_batch(t, path, number, "overwrite", distinct, rows)
        return Batch(path, number, _batch_rows(spark, path, number).select("s", "p", "o"), ())
    new = stage(t, "append")
    touched = [r["p"] for r in new.select("p").distinct().collect()]  # one row per predicate
    known = store_catalog(spark, path).where(F.col("p").isin(touched)).select("p", "functional", "n").collect()
    single = [r["p"] for r in known if r["functional"]]
    stored = None
    if known:
        stored = _stored_triples(spark, path, batches).where(F.col("p").isin([r["p"] for r in known]))
        if new.count() <= SMALL_ROWS and text_bytes(new) <= BROADCAST_BYTES:
            stored = stage(stored.join(F.broadcast(new.select("s", "p")), ["s", "p"], "left_semi"), "held")
        elif rows is not None:
            rows += sum(r["n"] for r in known)
    broken = _write_new(new, path, number, stored, single, rows)
    return Batch(path, number, _batch_rows(spark, path, number).select("s", "p", "o"), broken)


def commit_append(spark: SparkSession, batch: Batch) -> int:
    """Make a batch part of its store; gives the number of its triples."""
    _write_catalog(_batch_catalog(spark, batch.path, batch.number, batch.broken), batch.path, batch.number, batch.number)
    own = spark.read.schema(_CATALOG).parquet(f"{batch.path}/catalog/batch={batch.number}")
    return own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def append_store(t: DataFrame, path: str, distinct: bool = True, rows: int | None = None) -> int:
    """Add triples to a store and give the number of those that were not yet there."""
    return commit_append(t.sparkSession, begin_append(t, path, distinct, rows))


def compact_store(spark: SparkSession, path: str, first: int = 0) -> None:
    """Write the batches from ``first`` on as one; a ``first`` above 0 leaves a large old batch as it is.

    The catalog of the new batch is the merged one of the old, so nothing is counted again.  Files of the old batches stay, for
    readers that opened the store before.
    """
    batches = [b for b in store_batches(spark, path) if b >= first]
    if len(batches) < 2:
        return
    number = _next_batch(spark, path)
    rows = _stored_triples(spark, path, batches)
    _write_batch(rows.select("s", "p", "o"), path, number, "overwrite")
    own = _catalogs(spark, path).where(F.col("batch").isin(batches))
    merged = own.groupBy("p").agg(
        F.when(F.bool_or(F.col("kind") == "data"), "data").otherwise("object").alias("kind"),
        F.sum("n").alias("n"),
        F.bool_and("functional").alias("functional"),
    )
    _write_catalog(merged, path, number, min(batches))


def write_vertex_table(v: DataFrame, path: str, mode: str = "errorifexists") -> None:
    v.write.mode(mode).parquet(path)


def write_edge_table(e: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Edges partitioned by predicate, hot predicates spread over many files."""
    (
        e.select("src", "dst", "pred")
        .repartitionByRange("pred", "src", "dst")
        .write.mode(mode)
        .partitionBy("pred")
        .parquet(path)
    )


def read_vertex_table(spark: SparkSession, path: str, batches: list[int] | None = None) -> DataFrame:
    """Vertices; of a table written in batches, all or those of ``batches``."""
    rows = spark.read.parquet(path)
    return (rows if batches is None else rows.where(F.col("batch").isin(batches))).drop("batch")


def read_edge_table(spark: SparkSession, path: str, batches: list[int] | None = None) -> DataFrame:
    """Edges; of a table written in batches, all or those of ``batches``."""
    batch = "" if batches is None else "batch int, "
    rows = spark.read.schema(f"src bigint, dst bigint, {batch}pred string").parquet(path)
    return (rows if batches is None else rows.where(F.col("batch").isin(batches))).select("src", "dst", "pred")
