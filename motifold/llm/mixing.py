"""Mixing sources to target weights with DataFrame operations only.

Every row gets a hash-random key (the digest of its id); within each source the rows are put in ranges of
that key, word counts are summed per range, ranges get their starting sums, and rows their exact sum
before them.  A source is then cut where its budget ends; a budget above the source's size takes
whole epochs first.  Ranges hold a bounded share of a source's rows whatever the source, so a hot source is
spread over all of its ranges; no step needs a source's rows together.

The targets are the fixed point of sharing by weight with a ceiling of ``most_epochs`` times a
source's size: sources are filled in the order of ceiling to weight, which is one pass over one row per source.

Defined cases: a null or empty text has size 0 and takes 0 words; a null source is a source of its own, the last;
rows with equal ids are ordered by size and, alike in all, are interchangeable; an empty table gives no rows.
The input's other columns are carried along and may have any name but those that start with ``_mix_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motifold.llm.work import WORD

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
#: Hex digits of the key that name a range: 4096 ranges a source.
RANGE_DIGITS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(
    sizes: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most_epochs: int = MOST_EPOCHS,
) -> DataFrame:
    """From ``(_mix_source, _mix_total)``, one row per source, its target and whole-word budget."""
    in_order = Window.orderBy(F.col("_mix_source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(in_order) - 1) % len(weights)) + 1)
    weighed = sizes.select("*", weight.alias("_w"), (F.lit(most_epochs) * F.col("_mix_total")).alias("_cap"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_mix_source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        F.lit(share) * F.sum("_mix_total").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    ) / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    filled = weighed.select("*", level.alias("_level")).select(
        "*", (F.col("_cap") / F.col("_w") <= F.col("_level")).alias("_full")
    )
    first_open = F.min(F.when(~F.col("_full"), F.struct(F.col("_cap") / F.col("_w"), F.col("_level").alias("level"))))
    shared = first_open.over(everything)["level"] * F.col("_w")
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(shared)
    return filled.select("_mix_source", "_mix_total", target.alias("_mix_target")).select(
        "*", F.floor(F.col("_mix_target") + 0.5).cast("bigint").alias("_mix_budget")
    )


def mix(
    docs: DataFrame,
    size: Column | None = None,
    source: str = "source",
    key: str = "doc_id",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most_epochs: int = MOST_EPOCHS,
) -> DataFrame:
    """``docs`` with ``_mix_size``, ``_mix_total``, ``_mix_target`` and ``_mix_taken``."""
    size = words(F.col("text")) if size is None else size
    keyed = docs.select(
        "*",
        F.col(source).alias("_mix_source"),
        size.alias("_mix_size"),
        F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("_mix_key"),
    ).withColumn("_mix_range", F.substring("_mix_key", 1, RANGE_DIGITS))
    ranges = keyed.groupBy("_mix_source", "_mix_range").agg(F.sum("_mix_size").alias("_mix_sum"))
    earlier = (
        Window.partitionBy("_mix_source").orderBy("_mix_range").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = ranges.select("*", F.coalesce(F.sum("_mix_sum").over(earlier), F.lit(0)).alias("_mix_start"))
    totals = ranges.groupBy("_mix_source").agg(F.sum("_mix_sum").alias("_mix_total"))
    goals = targets(totals, weights, share, most_epochs)
    starts = starts.alias("a").join(
        goals.alias("b"), F.col("a._mix_source").eqNullSafe(F.col("b._mix_source"))
    ).select("a._mix_source", "a._mix_range", "_mix_start", "_mix_total", "_mix_target", "_mix_budget")
    in_range = (
        Window.partitionBy("_mix_source", "_mix_range")
        .orderBy("_mix_key", F.col(key), "_mix_size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = keyed.select("*", F.coalesce(F.sum("_mix_size").over(in_range), F.lit(0)).alias("_mix_within"))
    same = F.col("d._mix_source").eqNullSafe(F.col("s._mix_source")) & (
        F.col("d._mix_range") == F.col("s._mix_range")
    )
    joined = placed.alias("d").join(starts.alias("s"), same)
    epochs = F.when(
        F.col("_mix_total") > 0, F.floor(F.col("_mix_budget") / F.col("_mix_total")).cast("bigint")
    ).otherwise(F.lit(0).cast("bigint"))
    rest = F.col("_mix_budget") - epochs * F.col("_mix_total")
    part = F.least(
        F.col("_mix_size"),
        F.greatest(F.lit(0).cast("bigint"), rest - F.col("_mix_start") - F.col("_mix_within")),
    )
    own = [F.col(f"d.`{c}`") for c in docs.columns]
    return joined.select(
        *own,
        "_mix_size",
        "_mix_total",
        "_mix_target",
        (epochs * F.col("_mix_size") + part).alias("_mix_taken"),
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: rows repeated as often as taken whole, and cut where the budget ends within one.

    A row whose ``_mix_taken`` is k sizes and r words more comes k times whole and, if r > 0, once with
    its first r words (and the white space before and between them).  Rows without words take nothing and go.
    """
    whole = F.floor(F.col("_mix_taken") / F.col("_mix_size")).cast("int")
    rest = (F.col("_mix_taken") % F.col("_mix_size")).cast("int")
    taken = mix(docs).where("_mix_taken > 0").select("*", whole.alias("_mix_whole"), rest.alias("_mix_rest"))
    copies = F.concat(
        F.array_repeat(F.lit(0), F.col("_mix_whole")),
        F.when(F.col("_mix_rest") > 0, F.array(F.col("_mix_rest"))).otherwise(F.array().cast("array<int>")),
    )
    out = taken.select("*", F.explode(copies).alias("_mix_cut"))
    words_kept = F.slice(F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), 1, F.col("_mix_cut"))
    text = F.when(F.col("_mix_cut") == 0, F.col("text")).otherwise(F.array_join(words_kept, ""))
    values = {"text": text} | ({"n_chars": F.char_length(text).cast("bigint")} if "n_chars" in docs.columns else {})
    return out.select(*[values.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
