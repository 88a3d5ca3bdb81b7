"""Attribute tests as operations on bitmaps of node ids.

Node ``id`` is bit ``id % 32768`` of bucket ``id // 32768``.  A bitmap stands for the subjects that have a predicate at all (``o``
is null) or, for predicates with few different objects, a predicate with one object.  A star filter is an AND of bitmaps bucket by bucket, its count a
count of bits: rows meet by bucket, 32768 subjects at a time, and never by subject.  Bitmaps of several batches of triples
are OR-ed first, so new batches are simply added.

Dense ids (``assign_dense_ids``, ``append_ids``) keep the buckets full.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.terms import is_variable
from ..sources.triples import as_source, union_all
from .filters import Constraint

#: Bits of a bucket, fixed by the bitmap functions.
BITS = 1 << 15
#: Most rows, triples and ids together, that one range of subjects should hold where bitmaps are built.
RANGE_ROWS = 1_000_000


def _bucket(identifier: Column) -> Column:
    return F.bitmap_bucket_number(identifier + 1) - 1  # the functions count from 1


def _bit(identifier: Column) -> Column:
    return F.bitmap_bit_position(identifier + 1)


def predicate_bitmaps(triples, ids: DataFrame, listed: Iterable[str] = (), predicates: Iterable[str] | None = None) -> DataFrame:
    """``(p, o, bucket, bits)``: a bitmap per predicate with null ``o``, and one per object of the ``listed`` predicates.

    ``predicates`` restricts the table to some; ``ids`` is a dictionary of at least all their subjects.  This is the only step
    where rows meet by subject.  Triples and ids are range-partitioned by subject together: ids follow the order of the uris, so a
    range fills whole buckets, and the number of bitmaps that move does not grow with that of the ranges.  A range holds
    ``RANGE_ROWS``; a subject is one row per predicate or listed object in it, whatever its triples.
    """
    source = as_source(triples)
    named = list(listed)
    rows = source.all() if predicates is None else source.scan_any(list(predicates))
    is_named = F.col("p").isin(named) if named else F.lit(False)
    wanted = [r["p"] for r in rows.select("p").distinct().collect()] if predicates is None else list(predicates)  # one row per predicate
    single = [p for p, known in source.catalog(wanted).items() if known.functional]
    tested = rows.select("s", "p", F.when(is_named, F.col("o")).alias("o"))
    alone = is_named | F.col("p").isin(single) if single else is_named
    tested = tested.where(alone).unionByName(tested.where(~alone).distinct())
    nothing = F.lit(None)
    both = union_all([
        tested.withColumn("id", nothing.cast("bigint")),
        ids.select(F.col("uri").alias("s"), nothing.cast("string").alias("p"), nothing.cast("string").alias("o"), F.col("id").cast("bigint")),
    ])
    spark = both.sparkSession
    ranges = max(-(-both.count() // RANGE_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = F.max("id").over(Window.partitionBy("s"))
    coded = both.repartitionByRange(ranges, "s").withColumn("#id", own).where("p IS NOT NULL AND `#id` IS NOT NULL")
    bits = coded.groupBy("p", "o", _bucket(F.col("#id")).alias("bucket")).agg(F.bitmap_construct_agg(_bit(F.col("#id"))).alias("bits"))
    any_object = bits.groupBy("p", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    parts = [any_object.select("p", F.lit(None).cast("string").alias("o"), "bucket", "bits")]
    if named:
        parts.append(bits.where(F.col("o").isNotNull()))
    return union_all(parts)


def listable_predicates(triples, most_objects: int = 1000) -> list[str]:
    """Data predicates with few different objects: worth a bitmap for each.  One row per predicate comes to the driver."""
    pairs = as_source(triples).all("data").select("p", "o").distinct()
    few = pairs.groupBy("p").agg(F.count("*").alias("n")).where(F.col("n") <= most_objects)
    return sorted(r["p"] for r in few.select("p").collect())


def star_bitmap(bitmaps: DataFrame, constraints: Sequence[Constraint]) -> DataFrame:
    """``(bucket, bits)``: the ids that satisfy every ``(p, o)`` constraint; buckets without any may be missing.

    ``ValueError`` for a constant object of a predicate whose objects have no bitmaps.
    """
    wanted = list(dict.fromkeys((p, None if is_variable(o) else o) for p, o in constraints))
    if not wanted:
        raise ValueError("a star filter needs at least one constraint")
    fixed = sorted({p for p, o in wanted if o is not None})
    if fixed:
        own = bitmaps.where(F.col("p").isin(fixed) & F.col("o").isNotNull())
        missing = set(fixed) - {r["p"] for r in own.select("p").distinct().collect()}
        known = {r["p"] for r in bitmaps.where(F.col("p").isin(sorted(missing))).select("p").distinct().collect()} if missing else set()
        if known:
            raise ValueError(f"no bitmaps by object for {sorted(known)}")
    parts = []
    for number, (p, o) in enumerate(wanted):
        test = F.col("o").isNull() if o is None else F.col("o") == o
        parts.append(bitmaps.where((F.col("p") == p) & test).select(F.lit(number).alias("k"), "bucket", "bits"))
    merged = union_all(parts).groupBy("k", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    every = merged.groupBy("bucket").agg(F.count("*").alias("n"), F.bitmap_and_agg("bits").alias("bits"))
    return every.where(F.col("n") == len(wanted)).select("bucket", "bits")


def count_star_bitmaps(bitmaps: DataFrame, constraints: Sequence[Constraint]) -> DataFrame:
    """``count_star`` from bitmaps alone, as column ``n``."""
    star = star_bitmap(bitmaps, constraints)
    return star.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))


def bitmap_ids(star: DataFrame) -> DataFrame:
    """Column ``id``: the set bits of ``(bucket, bits)``.  Empty bytes are dropped before bits are looked at."""
    text = F.hex("bits")
    cut = star.select("bucket", F.posexplode(F.regexp_extract_all(text, F.lit("(..)"), F.lit(1))).alias("byte", "hex"))
    held = cut.where("hex <> '00'").select("bucket", "byte", F.conv("hex", 16, 10).cast("int").alias("value"))
    bits = held.select("bucket", "byte", "value", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
    set_ = bits.where(F.expr("shiftright(value, bit) & 1") == 1)
    return set_.select((F.col("bucket") * BITS + F.col("byte") * 8 + F.col("bit")).alias("id"))


def filter_by_bitmap(df: DataFrame, column: str, star: DataFrame) -> DataFrame:
    """Rows of ``df`` whose id ``column`` is a bit of ``star``: a join by bucket, which Spark may broadcast, and a test of one byte."""
    key = F.col(f"`{column}`")
    coded = df.withColumn("#bucket", _bucket(key)).withColumn("#bit", _bit(key))
    met = coded.join(star.select(F.col("bucket").alias("#bucket"), F.col("bits").alias("#bits")), "#bucket")
    byte = F.expr("cast(conv(hex(substring(`#bits`, cast(`#bit` div 8 as int) + 1, 1)), 16, 10) as int)")
    hit = met.withColumn("#byte", byte).where(F.expr("(shiftright(`#byte`, cast(`#bit` % 8 as int)) & 1) = 1"))
    return hit.select(*(F.col(f"`{c}`") for c in df.columns))
