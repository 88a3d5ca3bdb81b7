"""Language identification with bit-sliced Bloom filters of n-grams.

Learning counts the byte n-grams of each language's texts with Spark and keeps for a language those whose share
there is near the largest share anywhere.  Every language has a Bloom filter of its n-grams; the filters are
stored sliced: row r of the table is the bit mask of the languages whose filter has bit r.  The languages that contain
an n-gram are then the AND of a few rows.  A prediction counts, per language, the n-grams of the text that it contains,
takes away the false positives its fill lets expect, and takes the language with most.

The table has ``ROWS`` rows whatever the input, a proven bound for its broadcast.  Counting groups by
(language, n-gram) after summing within each task, so that a hot language adds one row per task and n-gram.

Defined cases: a text that is null or without a letter is ``und`` with score 0, and so is every text if nothing could be
learned; ties go to the language with more training texts, then to the smaller name; equal texts get equal predictions; texts
are read whole; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifold.llm.tokens import U, chunks, counted, per_text, scrambled
from motifold.llm.work import bounded

GRAM = 4
ROWS = 1 << 20
HASHES = 3
#: An n-gram belongs to a language if its share there is this part of its largest share at least.
NEAR_LARGEST = 0.2
#: An n-gram of a language needs one occurrence for each begun ``COUNTED`` n-grams of its texts, ``LEAST_COUNT`` at most.
COUNTED = 100_000
LEAST_COUNT = 3
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """``masks[row, word]``: bits of the languages, 64 to a word; ``languages`` in order of preference."""

    languages: tuple[str, ...]
    masks: np.ndarray

    @property
    def false_positives(self) -> np.ndarray:
        fill = [
            np.count_nonzero(self.masks[:, i >> 6] >> U(i & 63) & U(1)) / len(self.masks)
            for i in range(len(self.languages))
        ]
        return np.array(fill) ** HASHES


def _letters_only(text: Column) -> Column:
    """Lower case, all that is no letter a blank, blanks around."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[\x00-`{-\x7f]+", " "), F.lit(" "))


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams as numbers and, per text, how many lie before it."""
    n = max(len(data) - GRAM + 1, 0)
    gram = np.zeros(n, np.uint32)
    for i in range(GRAM):
        gram = gram << np.uint32(8) | data[i : i + n]
    whole = np.ones(n, bool)
    for back in range(1, GRAM):  # those that would cross into the next text
        at = offsets[1:] - back
        whole[at[(at >= 0) & (at < n)]] = False
    kept = np.flatnonzero(whole)
    return gram[kept], np.searchsorted(kept, offsets)


def _rows_of(grams: np.ndarray, rows: int) -> list[np.ndarray]:
    mixed = scrambled(grams.astype(U))
    low, high = mixed & U(0xFFFFFFFF), mixed >> U(32) | U(1)
    return [((low + U(i) * high) & U(rows - 1)).astype(np.int64) for i in range(HASHES)]


def gram_counts(texts: DataFrame) -> DataFrame:
    """(lang, gram, n) of ``(lang, text)``, summed over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(0).dictionary_encode()
            names, code = codes.dictionary, codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            for first, end, data, offsets in chunks(batch.column(1)):
                grams, before = _grams(data, offsets)
                keys = np.repeat(code[first:end], np.diff(before)) << 32 | grams.astype(np.int64)
                keys, n = counted(keys)
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(keys >> 32)), pa.array(keys & 0xFFFFFFFF), pa.array(n)],
                    ["lang", "gram", "n"],
                )

    cleaned = bounded(texts).select("lang", _letters_only(F.col("text")).alias("text"))
    return cleaned.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(texts: DataFrame, rows: int = ROWS) -> Model:
    """From all rows of ``texts`` with a text and a language."""
    known = texts.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).collect()
    languages = tuple(r["lang"] for r in sorted(sizes, key=lambda r: (-r["n"], r["lang"])))
    masks = np.zeros((rows, max(1, -(-len(languages) // 64))), U)
    if languages:
        number = F.create_map(*[x for i, name in enumerate(languages) for x in (F.lit(name), F.lit(i))])
        counts = gram_counts(known)
        totals = counts.groupBy("lang").agg(F.sum("n").alias("all"))
        shares = counts.join(totals, "lang").select("lang", "gram", "n", "all", (F.col("n") / F.col("all")).alias("share"))
        largest = shares.groupBy("gram").agg(F.max("share").alias("largest"))
        least = F.least(F.lit(LEAST_COUNT), F.ceil(F.col("all") / COUNTED))
        own = shares.join(largest, "gram").where(
            (F.col("share") >= NEAR_LARGEST * F.col("largest")) & (F.col("n") >= least)
        )

        def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lang = np.asarray(batch.column(0), np.int64)
                at = np.concatenate(_rows_of(np.asarray(batch.column(1), np.int64), rows))
                lang = np.tile(lang, HASHES)
                bit = (U(1) << (lang & 63).astype(U)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, lang >> 6, bit)], ["at", "word", "bits"])

        sliced = (
            own.select(number[F.col("lang")].cast("long").alias("lang"), "gram")
            .mapInArrow(bits, "at long, word long, bits long")
            .groupBy("at", "word")
            .agg(F.bit_or("bits").alias("bits"))
        )
        # At most one row for each row and word of the table.
        found = sliced.toArrow()
        masks[np.asarray(found["at"]), np.asarray(found["word"])] = np.asarray(found["bits"]).view(U)
    return Model(languages, masks)


def predict(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score); the score is the share of the winner in the corrected counts."""
    languages, wrong = model.languages, model.false_positives
    table = docs.sparkSession.sparkContext.broadcast(model.masks)

    def counted(grams: np.ndarray, before: np.ndarray) -> np.ndarray:
        masks = table.value
        at = _rows_of(grams, len(masks))
        out = np.empty((len(languages), len(before) - 1))
        for word in range(masks.shape[1]):
            rows = masks[:, word]
            found = rows[at[0]]
            for other in at[1:]:
                found &= rows[other]
            for bit in range(min(64, len(languages) - 64 * word)):
                out[64 * word + bit] = per_text((found >> U(bit) & U(1)).view(np.int64), before)
        n = np.diff(before)
        return np.maximum(0.0, (out - n * wrong[:, None]) / (1 - wrong[:, None]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*languages, UNKNOWN], object)
        for batch in batches:
            letters = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
            best = np.full(len(batch), len(languages))
            score = np.zeros(len(batch))
            if languages:
                for first, end, data, offsets in chunks(batch.column(1)):
                    likely = counted(*_grams(data, offsets))
                    best[first:end] = likely.argmax(axis=0)
                    total = likely.sum(axis=0)
                    score[first:end] = np.where(total > 0, likely.max(axis=0) / np.maximum(total, 1e-9), 1 / len(languages))
                best[~letters], score[~letters] = len(languages), 0.0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1))],
                [key, "lang_pred", "score"],
            )

    cleaned = bounded(docs).select(
        key,
        _letters_only(F.coalesce(F.col("text"), F.lit(""))).alias("text"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    )
    kind = docs.schema[key].dataType.simpleString()
    return cleaned.mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")
