"""LM scoring: context-tree weighting of bytes, learned and applied with Spark.

Learning.  Each task counts the distinct contexts with their next byte, and the distinct words, of a few megabytes of
text at a time; the sorted keys and counts travel as packed arrays to shards by the two most recent bytes (words: by
hash), which merge them.  What is gathered grows with the distinct contexts and words of the corpus; texts
never travel for it, and a hot context is one key per task's batch.

Scoring.  Documents are dealt into batches by the hash of their id and text.  A batch asks the shards for the code lengths of its
distinct contexts, the shards answer from the merged counts (``context_tree``), and the batch sums them per
document.  The shuffle of the texts is used twice, for asking and for summing.  A shard that is asked much has copies, each for
some of the batches, but no more than its questions pay for: a copy of k counts stands for at least ``TURN`` and 4 k
occurrences, so that all copies together are at most the model and a quarter of the text's bytes in number.

A-Z are lower-cased before anything is counted or scored, in contexts as in words.

Depths 0 and 1 of the trees (at most 65,536 nodes) are summed over the shards and broadcast.

Defined cases: a null or empty text is the end alone; nothing learned means one bit for each bit; words
are equal if their 64-bit hashes are; rows with equal ids are scored one by one; long texts are read whole; an empty table gives
no rows; other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifold.llm.context_tree import Subtrees, Top, padded
from motifold.llm.tokens import U, chunks, counted, distinct, inverse, per_text, scrambled, word_hashes
from motifold.llm.work import bounded, stage, text_size

DEPTH = 6
#: Bytes of text asked for at a time, and keys held while counting.
BATCH = 6 << 20
HELD = 2_000_000
#: Bytes of text per shard of the model, bytes of text in one part of its first merge, and occurrences that one copy of
#: a shard answers.
SHARD = 4 << 20
ROUND = 1 << 30
TURN = 32_000_000
MOST_SHARDS = 4096

_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[ord("A") : ord("Z") + 1] += ord("a") - ord("A")


def _planes(values: np.ndarray) -> bytes:
    """The number of bytes that the largest value needs, then the values byte plane by byte plane."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + np.ascontiguousarray(planes.T).tobytes()


def _values(data) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    planes = raw[1:].reshape(raw[0], -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, : raw[0]] = planes.T
    return wide.view("<u8").reshape(-1)


def packed(keys: np.ndarray) -> bytes:
    """Sorted numbers as differences, without the bytes that none of them uses."""
    return _planes(np.diff(keys, prepend=U(0)))


def unpacked(data) -> np.ndarray:
    return np.cumsum(_values(data), dtype=U)


def packed_counts(counts: np.ndarray) -> bytes:
    return _planes(counts)


def unpacked_counts(data) -> np.ndarray:
    return _values(data).view("<i8")


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of all parts with the sums of their counts."""
    if len(parts) == 1:
        return parts[0]
    keys = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")  # merges runs
    keys, counts = keys[order], counts[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _by_shard(keys: np.ndarray, shards: int, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """An order of sorted keys by shard, sorted within, and the bounds of the shards in it."""
    mixed = keys if words else scrambled(keys >> U(8 * (DEPTH - 1)))
    shard = (mixed % U(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk: first and last row, keys of contexts, their bounds, hashes of words, their bounds."""
    for first, end, data, offsets in chunks(column):
        data = _FOLDED[data]
        keys, before, _ = padded(data, offsets, DEPTH)
        hashes, words_before = word_hashes(data, offsets, fold=False)
        yield first, end, keys, before, hashes, words_before


def _model(train: DataFrame, shards: int, rounds: int) -> DataFrame:
    """(shard, keys, counts): shards 0 to n - 1 hold contexts, n to 2 n - 1 words."""

    def rows(grams: list, words: list) -> pa.RecordBatch:
        out = []
        for kind, parts in enumerate((grams, words)):
            keys, counts = merged(parts)
            order, bounds = _by_shard(keys, shards, bool(kind))
            for s in range(shards):
                at = order[bounds[s] : bounds[s + 1]]
                if len(at):
                    out.append((kind * shards + s, packed(keys[at]), packed_counts(counts[at])))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.int32()), *(pa.array([r[i] for r in out], pa.binary()) for i in (1, 2))],
            ["shard", "keys", "counts"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: list = []
        words: list = []
        held = 0
        for batch in batches:
            for _, _, keys, _, hashes, _ in _texts(batch.column(0)):
                grams.append(counted(keys))
                words.append(counted(hashes))
                held += len(grams[-1][0]) + len(words[-1][0])
                if held >= HELD:
                    grams, words = [merged(grams)], [merged(words)]
                    held = len(grams[0][0]) + len(words[0][0])
                    if held >= HELD // 2:
                        yield rows(grams, words)
                        grams, words, held = [], [], 0
        if grams:
            yield rows(grams, words)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        last, size = None, 0

        def row() -> pa.RecordBatch:
            keys, counts = merged(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([last], pa.int32()), pa.array([packed(keys)]), pa.array([packed_counts(counts)])],
                ["shard", "keys", "counts"],
            )

        for batch in batches:
            for i, shard in enumerate(batch.column(0).to_pylist()):
                keys, counts = (batch.column(c)[i].as_buffer() for c in (1, 2))
                if last is not None and shard != last:
                    yield row()
                    held, size = [], 0
                last = shard
                held.append((unpacked(keys), unpacked_counts(counts)))
                size += len(held[-1][0])
                if size > HELD and len(held) > 1:
                    held = [merged(held)]
                    size = len(held[0][0])
        if held:
            yield row()

    schema = "shard int, keys binary, counts binary"
    parts = train.select("text").mapInArrow(count, schema)
    # Two levels: what one task merges stays bounded while the number of batches grows.
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("keys"), F.lit(rounds)).cast("int"))
    once = salted.repartition("shard", "salt").sortWithinPartitions("shard", "salt").select("shard", "keys", "counts")
    return once.mapInArrow(merge, schema).repartition("shard").sortWithinPartitions("shard").mapInArrow(merge, schema)


def _top(model: DataFrame, shards: int) -> Top:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = Subtrees(unpacked(keys), unpacked_counts(counts), DEPTH).top()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[0].astype(np.int64)), *(pa.array(x.astype(float)) for x in found[1:])],
                    ["at", "zeros", "ones", "below"],
                )

    sums = (
        model.where(F.col("shard") < shards)
        .select("keys", "counts")
        .mapInArrow(run, "at long, zeros double, ones double, below double")
        .groupBy("at")
        .agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below")))
        .toArrow()  # at most 65,536 rows
    )
    return Top(*(np.asarray(sums[c]) for c in ("at", "zeros", "ones", "below")))


def _sizes(model: DataFrame) -> list[tuple[int, int, int]]:
    """(shard, occurrences, distinct keys) of each shard; at most 2 ``MOST_SHARDS`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [unpacked_counts(x) for x in batch.column(1).to_pylist()]
            sums = (pa.array([int(f(c)) for c in counts], pa.int64()) for f in (np.sum, len))
            yield pa.RecordBatch.from_arrays([batch.column(0), *sums], ["shard", "n", "v"])

    rows = model.select("shard", "counts").mapInArrow(run, "shard int, n long, v long").collect()
    return [(r["shard"], r["n"], r["v"]) for r in rows]


def copies_of(sizes: list[tuple[int, int, int]], share: float) -> list[tuple[int, int]]:
    """(shard, copies) of the shards that have several; questions are ``share`` times what was learned from."""
    wanted = ((s, math.ceil(n * share / max(TURN, 4 * v))) for s, n, v in sizes)
    return [(s, c) for s, c in wanted if c > 1]


def _distinct(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct context keys and word hashes of a batch."""
    grams, words = [], []
    for _, _, keys, _, hashes, _ in _texts(column):
        grams.append(distinct(keys))
        words.append(distinct(hashes))
    join = lambda parts: distinct(np.concatenate(parts)) if parts else np.zeros(0, U)
    return join(grams), join(words)


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of ``wanted`` in a table sorted by key; sorted questions are far kinder to caches."""
    found, at = inverse(wanted)
    return values[np.searchsorted(keys, found)][at]


def _asker(shards: int) -> Callable[[pa.Table], pa.Table]:
    def ask(table: pa.Table) -> pa.Table:
        batch = table["batch"][0].as_py()
        out = []
        for kind, keys in enumerate(_distinct(table["text"].combine_chunks())):
            order, bounds = _by_shard(keys, shards, bool(kind))
            for s in range(shards):
                at = order[bounds[s] : bounds[s + 1]]
                if len(at):
                    out.append((kind * shards + s, packed(keys[at])))
        return pa.table(
            {
                "batch": pa.array([batch] * len(out), pa.int64()),
                "shard": pa.array([r[0] for r in out], pa.int32()),
                "keys": pa.array([r[1] for r in out], pa.binary()),
            }
        )

    return ask


def _answerer(shards: int, top) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        shard = (asked if len(asked) else known)["shard"][0].as_py()
        wanted = [unpacked(k) for k in asked["keys"].to_pylist()]
        if len(known):
            keys, counts = unpacked(known["keys"][0].as_py()), unpacked_counts(known["counts"][0].as_py())
        else:
            keys, counts = np.zeros(0, U), np.zeros(0, np.int64)
        every, held = merged([(keys, counts), *[(w, np.zeros(len(w), np.int64)) for w in wanted]])
        if shard < shards:
            values = Subtrees(every, held, DEPTH).log2(top.value) if len(every) else np.zeros(0)
        else:
            values = held
        kind = "<f4" if shard < shards else "<i8"
        found = [values[np.searchsorted(every, w)].astype(kind).tobytes() for w in wanted]
        return pa.table(
            {"batch": asked["batch"], "shard": asked["shard"], "answers": pa.array(found, pa.binary())}
        )

    return answer


def _scorer(shards: int, key: str, tokens: int, known_words: int, texts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        column = docs["text"].combine_chunks()
        by_shard = dict(zip(answers["shard"].to_pylist(), answers["answers"].to_pylist(), strict=True))
        tables = []
        for kind, keys in enumerate(_distinct(column)):
            order, bounds = _by_shard(keys, shards, bool(kind))
            values = np.empty(len(keys), np.float64 if kind == 0 else np.int64)
            for s in range(shards):
                at = order[bounds[s] : bounds[s + 1]]
                if len(at):
                    values[at] = np.frombuffer(by_shard[kind * shards + s], "<f4" if kind == 0 else "<i8")
            tables.append((keys, values))
        n = len(column)
        bits, n_bytes = np.zeros(n), np.zeros(n, np.int64)
        n_words, known, base = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
        unit = math.log10(tokens + known_words + 1)
        for first, end, keys, before, hashes, words_before in _texts(column):
            bits[first:end] = per_text(_looked_up(*tables[0], keys), before)
            n_bytes[first:end] = np.diff(before) - 1
            seen = _looked_up(*tables[1], hashes)
            n_words[first:end] = np.diff(words_before)
            known[first:end] = per_text((seen > 0).astype(np.int64), words_before)
            base[first:end] = per_text(np.log10(seen + 1.0) - unit, words_before)
        return pa.table(
            {
                key: docs[key],
                "n_tokens": pa.array(n_words + 1),
                "n_known": pa.array(known + (texts > 0)),
                "train_tokens": pa.array(np.full(n, tokens, np.int64)),
                "base_score": pa.array(base + math.log10(texts + 1.0) - unit),
                "score": pa.array(bits * math.log10(2)),
                "bits_per_byte": pa.array(-bits / (n_bytes + 1)),
            }
        )

    return score


def score(docs: DataFrame, train: Column, key: str = "doc_id") -> DataFrame:
    """Scores of all ``docs`` under the model of those where ``train`` holds.

    (key, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte); scores are log10 probabilities.
    """
    _, size = text_size(bounded(docs))
    shards = min(MOST_SHARDS, max(12, math.ceil(size / SHARD)))
    rounds = max(1, math.ceil(size / ROUND))
    n_batches = max(1, math.ceil(size / BATCH))
    learned = docs.where(train)
    texts, learned_size = text_size(learned)
    model = stage(_model(learned, shards, rounds), "contexts")
    sizes = _sizes(model)
    words, known_words = (sum(x[i] for x in sizes if x[0] >= shards) for i in (1, 2))
    spark = docs.sparkSession
    top = spark.sparkContext.broadcast(_top(model, shards))
    kind = docs.schema[key].dataType.simpleString()
    dealt = docs.select(
        F.pmod(F.xxhash64(key, "text"), F.lit(n_batches)).alias("batch"),
        key,
        F.coalesce("text", F.lit("")).alias("text"),
    )
    asked = dealt.groupBy("batch").applyInArrow(_asker(shards), "batch long, shard int, keys binary")
    several = copies_of(sizes, (size + 1) / (learned_size + 1))
    copied = F.broadcast(spark.createDataFrame(several, "shard int, copies int"))
    copies = F.coalesce("copies", F.lit(1))
    asked = asked.join(copied, "shard", "left").select(
        "batch", "shard", F.pmod("batch", copies).cast("int").alias("salt"), "keys"
    )
    known = model.join(copied, "shard", "left").select(
        "shard", F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt"), "keys", "counts"
    )
    answers = (
        asked.groupBy("shard", "salt")
        .cogroup(known.groupBy("shard", "salt"))
        .applyInArrow(_answerer(shards, top), "batch long, shard int, answers binary")
    )
    scored = _scorer(shards, key, words + texts, known_words + (texts > 0), texts)
    return (
        dealt.groupBy("batch")
        .cogroup(answers.groupBy("batch"))
        .applyInArrow(
            scored,
            f"`{key}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
            "bits_per_byte double",
        )
    )
