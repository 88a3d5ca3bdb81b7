"""Packing along a space-filling curve.

Every document is tokenised once; its token ids are hashed to a random vector of few dimensions, whose place on a Hilbert
curve is the document's key.  Documents are range-sorted by that key (then by id, so that copies, which
share a key, still split over ranges) and each range is packed as it comes: neighbours on the curve, so documents of
like content, lie together.  Documents are cut at the end of a sequence.  What is left at the end of a range is cut to
sequences of powers of two, so nothing is padded.

Tokenised documents are written to the shared work folder once: sampling the ranges must not tokenise again, and lost
executors read them again.  A task holds one Arrow batch and one unfinished sequence.

Defined cases: a null text is empty and has the separator alone; a long text is tokenised whole and cut into as many pieces as
it needs; rows with equal ids are packed as separate documents; an empty table gives no rows; other
columns of the input are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from motifold.llm.work import bounded, stage

CAPACITY = 1024
SEPARATOR = 0
DIMENSIONS = 3
BITS = 10
#: The same vocabulary twice: as the tokenizers library reads it, and as ranks for the faster library.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Sequences of a range are numbered from range * RANGE.
RANGE = 1 << 36


@lru_cache(maxsize=2)
def _fast(ranks: str) -> tiktoken.Encoding:
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "pack", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
    )


@lru_cache(maxsize=2)
def _exact(tokenizer: str) -> Tokenizer:
    return Tokenizer.from_file(tokenizer)


@lru_cache(maxsize=2)
def _added(tokenizer: str) -> tuple[str, ...]:
    """Tokens beside the ranks, which only the tokenizers library finds in a text."""
    return tuple(t.content for t in _exact(tokenizer).get_added_tokens_decoder().values())


@lru_cache(maxsize=2)
def _width(tokenizer: str) -> str:
    """16 bits for the ids on their way, where the vocabulary fits."""
    return "<u2" if _exact(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"


def token_ids(text: str | None, tokenizer: str = TOKENIZER, ranks: str = RANKS) -> list[int]:
    """Ids of a whole text, as the tokenizers library gives them.

    The faster library gives the same where no added token is in the text; what it gives up on goes to the other, too.
    """
    if not text:
        return []
    if not any(t in text for t in _added(tokenizer)):
        try:
            return _fast(ranks).encode_ordinary(text)
        except (ValueError, OverflowError, RuntimeError):
            pass
    return _exact(tokenizer).encode(text, add_special_tokens=False).ids


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the Hilbert curve of integer points, one column each, of ``bits`` bits a dimension."""
    x = points.astype(np.int64)
    top = 1 << bits - 1
    q = top
    while q > 1:
        for i in range(len(x)):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & q - 1)
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for row in x:
            index = index << 1 | row >> bit & 1
    return index


@lru_cache(maxsize=2)
def _directions(size: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((size, DIMENSIONS))


def place(ids: np.ndarray) -> np.ndarray:
    """The direction of the sum of the ids' random vectors, as integers of ``BITS`` bits."""
    vector = _directions(1 << 16)[ids & 0xFFFF].sum(axis=0)
    length = np.linalg.norm(vector)
    unit = vector / length if length > 0 else vector
    return np.minimum(((unit + 1) / 2 * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def tokenized(docs: DataFrame, key: str, tokenizer: str, ranks: str) -> DataFrame:
    """(key, curve, ids): ids end with the separator, as unsigned little-endian numbers of ``_width`` bits."""
    kind_of_id = _width(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Few texts at a time: their ids are many objects while they are lists.
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                ids = [
                    np.array([*token_ids(text, tokenizer, ranks), SEPARATOR], kind_of_id)
                    for text in part.column(1).to_pylist()
                ]
                curve = hilbert(np.array([place(x) for x in ids]).T)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(curve), pa.array([x.tobytes() for x in ids], pa.binary())],
                    [key, "curve", "ids"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, curve long, ids binary")


def _cut(pieces: list[tuple], capacity: int) -> list[tuple]:
    """The pieces of one unfinished sequence, cut where sequences of powers of two end."""
    total = sum(p[2] for p in pieces)
    sizes = [1 << b for b in range(capacity.bit_length(), -1, -1) if total >> b & 1]
    out, number, room = [], 0, sizes[0] if sizes else 0
    for row, start, length in pieces:
        while length:
            if not room:
                number += 1
                room = sizes[number]
            take = min(length, room)
            out.append((row, start, take, number, sizes[number] - room))
            start, length, room = start + take, length - take, room - take
    return out


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    capacity: int = CAPACITY,
    tokenizer: str = TOKENIZER,
    ranks: str = RANKS,
) -> DataFrame:
    """(key, start, length, doc_tokens, sequence_id, offset, ids): one row per piece of a document.

    ``ids`` holds the piece's token ids as unsigned little-endian numbers of 32 bits.
    """
    kind_of_id, width = _width(tokenizer), int(_width(tokenizer)[-1])
    ready = stage(tokenized(bounded(docs), key, tokenizer, ranks), "tokens")
    along = ready.repartitionByRange("curve", key).sortWithinPartitions("curve", key)
    names = [key, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, filled = TaskContext.get().partitionId() * RANGE, 0
        waiting: list[tuple] = []  # (document, start, length) of the unfinished sequence

        def wide(ids: bytes) -> bytes:
            return np.frombuffer(ids, kind_of_id).astype("<u4").tobytes()

        def rows(found: list[tuple]) -> pa.RecordBatch:
            kind = pa.array([f[0][0] for f in found], batch_type)
            number = lambda values: pa.array(list(values), pa.int64())
            return pa.RecordBatch.from_arrays(
                [
                    kind,
                    number(f[1] for f in found),
                    number(f[2] for f in found),
                    number(len(f[0][1]) // width for f in found),
                    number(f[3] for f in found),
                    number(f[4] for f in found),
                    pa.array([wide(f[0][1][width * f[1] : width * (f[1] + f[2])]) for f in found], pa.binary()),
                ],
                names,
            )

        batch_type = None
        for batch in batches:
            batch_type = batch.column(0).type
            found = []
            for document in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                start, left = 0, len(document[1]) // width
                while left:
                    take = min(left, capacity - filled)
                    waiting.append((document, start, take))
                    start, left, filled = start + take, left - take, filled + take
                    if filled == capacity:
                        offset = 0
                        for w in waiting:
                            found.append((*w, sequence, offset))
                            offset += w[2]
                        sequence, filled, waiting = sequence + 1, 0, []
                        if len(found) >= 4096:
                            yield rows(found)
                            found = []
            if found:
                yield rows(found)
        if waiting:
            yield rows([(d, s, n, sequence + q, o) for d, s, n, q, o in _cut(waiting, capacity)])

    kind = docs.schema[key].dataType.simpleString()
    return along.mapInArrow(
        run,
        f"`{key}` {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary",
    )
