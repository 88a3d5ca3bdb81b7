"""Runs of words that repeat with a period, by an online sparse diagonal scheme.

Word ``i`` and its earlier occurrence ``i - q`` are a match on the diagonal of lag ``q``; a run of period ``q`` is a
stretch of matches on that diagonal.  One pass over the words keeps the active lags with the place where their stretch
began.  Every word lengthens the lags on which it matches; the others end there, and a stretch of sufficient length is
emitted at once.  A word's earlier occurrences, taken from a chain of equal words, open further lags.

The diagonals stay sparse because a run has at least ``REPEATS`` periods, so ``REPEATS - 1`` lags of matches: with
``h`` the greatest power of two up to ``q``, its stretch holds two multiples of ``h`` next to each other.  So word ``i`` looks only at earlier
occurrences nearer than twice its greatest divisor that is a power of two, and opens a lag only if the ``h`` words
before it match as well.  This loses no run and costs n log n chain steps at most.  A multiple of an active lag whose
run covers both words has the same ends as that run, so it is not the smallest period and is not opened.

The work is a map over rows: no shuffle, no state between rows.  Words are compared as bytes, not by hashes.  A text is
held whole by one task, nothing more.

Defined cases: a null or empty text, or one of white space, has no words and no runs, and collapses to the empty text; texts of any
length are read whole; equal rows get equal results; rows without a key keep their null; an empty table gives no rows; only the key
and ``text`` are read, so other columns may have any names (``collapsed`` returns them as they are).
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from motifold.llm.work import bounded

#: A run has at least so many periods, and at least so many words.
REPEATS = 4
LEAST_WORDS = 6

_RUN = "struct<start:bigint,length:bigint,period:bigint>"
_ARROW_RUN = pa.struct([pa.field(name, pa.int64()) for name in ("start", "length", "period")])


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text; ``bytes.split`` parts at exactly the six ASCII white-space characters."""
    return text.split() if text else []


def _numbers(words: list[bytes]) -> list[int]:
    known: dict[bytes, int] = {}
    return [known.setdefault(word, len(known)) for word in words]


def _same(x: list[int], a: int, b: int, length: int) -> bool:
    """Whether ``length`` words from ``a`` equal those from ``b``, in growing pieces."""
    done, piece = 0, 16
    while done < length:
        size = min(piece, length - done)
        if x[a + done : a + done + size] != x[b + done : b + done + size]:
            return False
        done += size
        piece *= 2
    return True


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs, by start and then by period."""
    n = len(words)
    if n < LEAST_WORDS:
        return []
    x = _numbers(words)
    longest = n // REPEATS
    last: dict[int, int] = {}
    before = [-1] * n  # the chain of equal words
    active: dict[int, int] = {}  # lag -> first word of its run
    found: dict[tuple[int, int], int] = {}

    def end(lag: int, at: int) -> None:
        start = active.pop(lag)
        length = at - start
        if length >= LEAST_WORDS and length >= REPEATS * lag:
            found[start, length] = min(lag, found.get((start, length), lag))

    for i, word in enumerate(x):
        if active:
            for lag in [q for q in active if x[i - q] != word]:
                end(lag, i)
        j = before[i] = last.get(word, -1)
        last[word] = i
        reach = min(2 * (i & -i), longest + 1)
        while j >= 0 and i - j < reach:
            lag = i - j
            h = 1 << (lag.bit_length() - 1)
            if lag not in active and j >= h and x[i - h] == x[j - h]:
                known = any(lag % q == 0 and start <= j for q, start in active.items())
                if not known and _same(x, i - h, j - h, h):
                    start = j - h
                    while start > 0 and x[start - 1] == x[start - 1 + lag]:
                        start -= 1
                    active[lag] = start
            j = before[j]
    for lag in list(active):
        end(lag, n)
    return sorted((start, length, lag) for (start, length), lag in found.items())


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; ties go to the smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """``words`` without those that a run holds after its first period."""
    if not runs:
        return words
    gone = bytearray(len(words))
    for start, length, period in runs:
        gone[start + period : start + length] = b"\1" * (length - period)
    return [word for word, out in zip(words, gone, strict=True) if not out]


def _structs(runs) -> list[dict]:
    return [dict(zip(("start", "length", "period"), run, strict=True)) for run in runs]


def find(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_words, runs, strongest, collapsed): one row per document.

    ``runs`` are by start, then period; ``strongest`` is one of them, or null; ``collapsed`` holds the words that stay,
    joined by one space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, runs, best, texts = [], [], [], []
            for text in batch.column(1).cast(pa.large_binary()).to_pylist():
                words = words_of(text)
                found = runs_of(words)
                top = strongest(found)
                sizes.append(len(words))
                runs.append(_structs(found))
                best.append(_structs([top])[0] if top else None)
                texts.append(b" ".join(kept_words(words, found)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(runs, pa.list_(_ARROW_RUN)),
                    pa.array(best, _ARROW_RUN),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                ],
                [key, "n_words", "runs", "strongest", "collapsed"],
            )

    tail = T._parse_datatype_string(f"n_words bigint, runs array<{_RUN}>, strongest {_RUN}, collapsed string")
    return bounded(docs).select(key, "text").mapInArrow(run, T.StructType([docs.schema[key], *tail.fields]))


def collapsed(docs: DataFrame) -> DataFrame:
    """``docs`` with every text that holds a run replaced by its kept words; ``n_chars``, if there, follows the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            changed = {}
            for row, text in enumerate(batch.column("text").cast(pa.large_binary()).to_pylist()):
                words = words_of(text)
                found = runs_of(words)
                if found:
                    changed[row] = b" ".join(kept_words(words, found)).decode()
            if changed:
                texts = [changed.get(i, x) for i, x in enumerate(batch.column("text").to_pylist())]
                kind = batch.schema.field("text").type
                batch = batch.set_column(names.index("text"), "text", pa.array(texts, kind))
                if "n_chars" in names:
                    old = batch.column("n_chars").to_pylist()
                    new = [len(changed[i]) if i in changed else n for i, n in enumerate(old)]
                    kind = batch.schema.field("n_chars").type
                    batch = batch.set_column(names.index("n_chars"), "n_chars", pa.array(new, kind))
            yield batch

    return bounded(docs).mapInArrow(run, docs.schema)
