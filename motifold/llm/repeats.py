"""Repeated passages: every byte covered by a string of ``LENGTH`` bytes that starts at two or more places.

Prefix-free parsing.  A rolling hash of ``GRAM`` bytes triggers at one place in ``EVERY``; the bytes from one trigger to the
next are a phrase.  A trigger depends on its own bytes alone, so equal strings have the same triggers at the same
places.  A string's place in corpus order is then decided in three steps, each a sort of names (64-bit hashes) in shards:

1. Dictionary.  The ``ANCHOR`` bytes at a trigger are named.  An anchor that occurs once decides that none of the
   strings that begin in the phrase before it is repeated, which settles nearly all of a corpus.
2. Parse.  All that the strings beginning in one phrase can see, from the phrase's start to ``LENGTH`` bytes behind
   its end, is a segment.  Equal segments decide that all their strings are repeated: a passage with many copies is
   settled phrase by phrase.
3. Borders.  Where an anchor has different segments, one of each is taken apart into its strings (suffixes of a phrase followed
   by a part of the parse), whose names are sorted; equal neighbours are repeats.  Strings without a trigger
   in reach go this way always.

Documents are dealt into batches by the hash of their id.  A batch sends sorted distinct names only, so a passage in a
third of all rows is one name per batch, and gets one byte per name back.  The texts are shuffled once and
that shuffle is read by every step.

The order is by name and not by letters: only whether two prefixes of ``LENGTH`` bytes are equal matters here, and an order by letters
would bring a hot prefix to one task.  Strings are equal if their 64-bit names are.

Defined cases: a null or empty text has 0 bytes, nothing removed and the digest of no bytes; a text shorter than ``LENGTH`` loses
nothing; a text may repeat itself, overlapping or not; rows with equal ids are separate documents; an empty table
gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifold.llm.lm_score import BATCH, MOST_SHARDS, SHARD, packed, unpacked
from motifold.llm.tokens import Hasher, U, chunks, counted, distinct, per_text, scrambled
from motifold.llm.work import bounded, text_size

LENGTH = 400
GRAM = 16
EVERY = 64
ANCHOR = 128
REACH = LENGTH - ANCHOR

_ASKED = "batch long, shard long, names binary, more binary"
_ANSWERED = "batch long, shard long, answers binary"


class Parsed:
    """The triggers of a run of texts and the strings that begin in the phrase before each: few numbers per text.

    Strings ``low`` to ``high`` (starts, both included) belong to a trigger; ``far`` are the starts of those without one.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        hasher = Hasher(data)
        self.n = n = len(data)
        places = np.arange(max(n - GRAM + 1, 0))
        at = places[hasher.spans(places, places + GRAM) % U(EVERY) == 0]
        text = np.searchsorted(offsets, at, "right") - 1
        inside = at + GRAM <= offsets[text + 1]
        at, text = at[inside], text[inside]
        begin, end = offsets[text], offsets[text + 1]
        before = np.full(len(at), -1)
        before[1:] = at[:-1]
        low = np.maximum(np.maximum(before + 1, at - REACH), begin)
        high = np.minimum(at, end - LENGTH)
        held = high >= low
        at, self.low, self.high, end = at[held], low[held], high[held], end[held]
        self.anchor = hasher.spans(at, at + ANCHOR)
        segment = hasher.spans(self.low, np.minimum(at + LENGTH, end))
        self.segment = scrambled(segment + (at - self.low).astype(U) * U(0xA24BAED4963EE407))
        long_enough = np.diff(offsets) >= LENGTH
        starts = self._spread(offsets[:-1][long_enough], offsets[1:][long_enough] - LENGTH, n)
        self.far = np.flatnonzero(starts & ~self._spread(self.low, self.high, n))

    @staticmethod
    def _spread(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
        """Marks all places of disjoint ranges, both ends included."""
        edges = np.zeros(n + 1, np.int8)
        np.add.at(edges, low, 1)
        np.add.at(edges, high + 1, -1)
        return np.cumsum(edges[:-1], dtype=np.int8) > 0

    def starts(self, chosen: np.ndarray) -> np.ndarray:
        """Starts of the strings of the chosen triggers."""
        return np.flatnonzero(self._spread(self.low[chosen], self.high[chosen], self.n))


def names_of(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return Hasher(data).spans(starts, starts + LENGTH) if len(starts) else np.zeros(0, U)


def _found(names: np.ndarray, codes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Codes of ``wanted``; all of them are among the sorted ``names``."""
    return codes[np.searchsorted(names, wanted)] if len(wanted) else codes[:0]


def _by_shard(names: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    shard = (names % U(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _rows(batch: int, names: np.ndarray, shards: int, more: np.ndarray | None, kept: bytes | None) -> pa.Table:
    """Questions about sorted names, by shard, and ``kept``, which comes back as it is."""
    order, bounds = _by_shard(names, shards)
    out = []
    for s in range(shards):
        at = order[bounds[s] : bounds[s + 1]]
        if len(at):
            out.append((s, packed(names[at]), more[at].tobytes() if more is not None else b""))
    if kept is not None:
        out.append((-1 - batch, kept, b""))
    return pa.table(
        {
            "batch": pa.array([batch] * len(out), pa.int64()),
            "shard": pa.array([r[0] for r in out], pa.int64()),
            "names": pa.array([r[1] for r in out], pa.binary()),
            "more": pa.array([r[2] for r in out], pa.binary()),
        }
    )


def _codes(names: np.ndarray, shards: int, answers: pa.Table) -> tuple[np.ndarray, bytes]:
    """A byte for each of the sorted names that were asked about, and what was kept."""
    by_shard = dict(zip(answers["shard"].to_pylist(), answers["answers"].to_pylist(), strict=True))
    order, bounds = _by_shard(names, shards)
    codes = np.zeros(len(names), np.uint8)
    for s in range(shards):
        at = order[bounds[s] : bounds[s + 1]]
        if len(at):
            codes[at] = np.frombuffer(by_shard[s], np.uint8)
    return codes, next((v for s, v in by_shard.items() if s < 0), b"")


class _Batch:
    """What a batch knows at each step; recomputed from its texts, whose order does not matter."""

    def __init__(self, table: pa.Table, shards: int) -> None:
        column = table["text"].combine_chunks()
        self.parts = [(data, offsets, Parsed(data, offsets)) for _, _, data, offsets in chunks(column)]
        none = [np.zeros(0, U)]
        anchor = np.concatenate([*none, *(p.anchor for _, _, p in self.parts)])
        segment = np.concatenate([*none, *(p.segment for _, _, p in self.parts)])
        order = np.lexsort((segment, anchor))
        anchor, segment = anchor[order], segment[order]
        new = np.ones(len(anchor), bool)
        new[1:] = anchor[1:] != anchor[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(anchor)) - 1 if len(first) else first
        # Of each anchor the least and the greatest segment: all that tells whether there are two.
        self.anchors = anchor[first]
        self.least, self.greatest = segment[first], segment[last]
        self.segments, self.segment_counts = counted(segment)

    def border_segments(self, anchor_codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct segments whose anchor has others too, and how often each is here."""
        out = [np.zeros(0, U)]
        for _, _, p in self.parts:
            out.append(p.segment[_found(self.anchors, anchor_codes, p.anchor) == 2])
        return counted(np.concatenate(out))

    def loose(self, p: Parsed, anchor_codes, borders, border_codes) -> np.ndarray:
        """Starts of the strings that are named one by one: far ones and those of one of each border segment."""
        at_border = _found(self.anchors, anchor_codes, p.anchor) == 2
        chosen = np.zeros(len(p.anchor), bool)
        chosen[at_border] = _found(borders, border_codes, p.segment[at_border]) & 2 > 0
        starts = p.starts(chosen)
        return distinct(np.concatenate([starts, p.far]))


def _ask_anchors(shards: int) -> Callable[[pa.Table], pa.Table]:
    def ask(table: pa.Table) -> pa.Table:
        b = _Batch(table, shards)
        return _rows(table["batch"][0].as_py(), b.anchors, shards, np.column_stack([b.least, b.greatest]), None)

    return ask


def _answer_anchors(table: pa.Table) -> pa.Table:
    """2 for an anchor with different segments, 1 for one in several batches, else 0."""
    names = [unpacked(x) for x in table["names"].to_pylist()]
    pairs = np.concatenate([np.frombuffer(x, U).reshape(-1, 2) for x in table["more"].to_pylist()])
    every = np.concatenate(names)
    order = np.argsort(every, kind="stable")
    ranked, pairs = every[order], pairs[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(ranked)))
    differ = np.minimum.reduceat(pairs[:, 0], first) != np.maximum.reduceat(pairs[:, 1], first)
    codes = np.empty(len(ranked), np.uint8)
    codes[order] = np.repeat(np.where(differ, 2, np.minimum(counts - 1, 1)).astype(np.uint8), counts)
    return _answers(table, names, codes)


def _answers(table: pa.Table, names: list[np.ndarray], codes: np.ndarray) -> pa.Table:
    parts = np.split(codes, np.cumsum([len(x) for x in names])[:-1])
    return pa.table(
        {
            "batch": table["batch"],
            "shard": table["shard"],
            "answers": pa.array([x.tobytes() for x in parts], pa.binary()),
        }
    )


def _answer_met(table: pa.Table) -> pa.Table:
    """1 for a name that several batches have, plus 2 in the batch that stands for it; kept rows come back."""
    if table["shard"][0].as_py() < 0:
        return table.select(["batch", "shard", "names"]).rename_columns(["batch", "shard", "answers"])
    names = [unpacked(x) for x in table["names"].to_pylist()]
    every = np.concatenate(names)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    counts = np.diff(np.append(np.flatnonzero(new), len(ranked)))
    codes = np.empty(len(ranked), np.uint8)
    codes[order] = np.repeat((counts > 1).astype(np.uint8), counts) | new.astype(np.uint8) << 1
    return _answers(table, names, codes)


def _ask_segments(shards: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def ask(table: pa.Table, answers: pa.Table) -> pa.Table:
        b = _Batch(table, shards)
        codes, _ = _codes(b.anchors, shards, answers)
        names, _ = b.border_segments(codes)
        return _rows(table["batch"][0].as_py(), names, shards, None, codes.tobytes())

    return ask


def _ask_strings(shards: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def ask(table: pa.Table, answers: pa.Table) -> pa.Table:
        b = _Batch(table, shards)
        kept = next((v for s, v in zip(answers["shard"].to_pylist(), answers["answers"].to_pylist(), strict=True) if s < 0))
        anchor_codes = np.frombuffer(kept, np.uint8)
        borders, _ = b.border_segments(anchor_codes)
        border_codes, _ = _codes(borders, shards, answers)
        out = [np.zeros(0, U)]
        for data, _, p in b.parts:
            out.append(distinct(names_of(data, b.loose(p, anchor_codes, borders, border_codes))))
        names = distinct(np.concatenate(out))
        return _rows(table["batch"][0].as_py(), names, shards, None, kept + border_codes.tobytes())

    return ask


def covered(starts: np.ndarray, n: int) -> np.ndarray:
    """Bytes of strings of ``LENGTH`` that begin at the given places."""
    edges = np.zeros(n + 1, np.int64)
    edges[starts] += 1
    edges[starts + LENGTH] -= 1
    return np.cumsum(edges[:-1]) > 0


def _finish(shards: int, key: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        b = _Batch(table, shards)
        kept = next((v for s, v in zip(answers["shard"].to_pylist(), answers["answers"].to_pylist(), strict=True) if s < 0))
        both = np.frombuffer(kept, np.uint8)
        anchor_codes, border_codes = both[: len(b.anchors)], both[len(b.anchors) :]
        borders, _ = b.border_segments(anchor_codes)
        loose = [b.loose(p, anchor_codes, borders, border_codes) for _, _, p in b.parts]
        named = [names_of(data, starts) for (data, _, _), starts in zip(b.parts, loose, strict=True)]
        strings, counts = counted(np.concatenate([np.zeros(0, U), *named]))
        string_codes, _ = _codes(strings, shards, answers)
        again = (string_codes & 1).astype(bool) | (counts > 1)
        here = b.segment_counts > 1
        n_bytes, n_removed, n_spans, digests = [], [], [], []
        for (data, offsets, p), starts, names in zip(b.parts, loose, named, strict=True):
            codes = _found(b.anchors, anchor_codes, p.anchor)
            whole = (codes == 1) | _found(b.segments, here, p.segment)
            at_border = codes == 2
            whole[at_border] |= (_found(borders, border_codes, p.segment[at_border]) & 1).astype(bool)
            starts = distinct(np.concatenate([p.starts(whole), starts[_found(strings, again, names)]]))
            gone = covered(starts, len(data))
            first = gone.copy()
            edge = np.zeros(len(data) + 1, bool)
            edge[offsets] = True
            first[1:] &= ~gone[:-1] | edge[1:-1]
            removed = per_text(gone.astype(np.int64), offsets)
            n_bytes.append(np.diff(offsets))
            n_removed.append(removed)
            n_spans.append(per_text(first.astype(np.int64), offsets))
            for i in range(len(offsets) - 1):
                own = data[offsets[i] : offsets[i + 1]]
                if removed[i]:
                    own = own[~gone[offsets[i] : offsets[i + 1]]]
                digests.append(hashlib.sha256(own.tobytes()).hexdigest())
        join = lambda parts: pa.array(np.concatenate(parts).astype(np.int64))
        return pa.table(
            {
                key: table[key],
                "n_bytes": join(n_bytes),
                "n_removed": join(n_removed),
                "n_spans": join(n_spans),
                "kept_sha256": pa.array(digests, pa.string()),
            }
        )

    return finish


def repeats(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256): one row per document."""
    _, size = text_size(bounded(docs))
    shards = min(MOST_SHARDS, max(12, math.ceil(size / SHARD)))
    n_batches = max(1, math.ceil(size / BATCH))
    kind = docs.schema[key].dataType.simpleString()
    dealt = docs.select(
        F.pmod(F.xxhash64(key), F.lit(n_batches)).alias("batch"), key, F.coalesce("text", F.lit("")).alias("text")
    )

    def answered(asked: DataFrame, answer: Callable[[pa.Table], pa.Table]):
        return asked.groupBy("shard").applyInArrow(answer, _ANSWERED).groupBy("batch")

    batches = dealt.groupBy("batch")
    anchors = answered(batches.applyInArrow(_ask_anchors(shards), _ASKED), _answer_anchors)
    segments = answered(batches.cogroup(anchors).applyInArrow(_ask_segments(shards), _ASKED), _answer_met)
    strings = answered(batches.cogroup(segments).applyInArrow(_ask_strings(shards), _ASKED), _answer_met)
    return batches.cogroup(strings).applyInArrow(
        _finish(shards, key),
        f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string",
    )
