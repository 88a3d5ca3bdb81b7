"""URL filter: a weighted vocabulary counted by one Aho-Corasick pass, after host and path rules.

The vocabulary holds strict and soft terms.  All are compiled into one automaton whose transition array a single pass over the
URL's bytes follows; a term's hit counts if no letter stands next to it on either side (digits, signs and the ends are
boundaries; every byte from 0x80 on counts as a letter).  A URL is rejected by one hit of a strict term or by ``SOFT_LIMIT`` different soft terms;
the same soft term again does not count.  A rule that fits the URL decides before the vocabulary.

Host, path and rules are built-in expressions over the column; the vocabulary pass is a map over rows.  Nothing is shuffled, and
what tasks hold is one batch and the automaton, whose size is that of the vocabulary (a parameter).  Rules become one ``CASE``
expression: the list is meant for some hundreds of them.

Defined cases: a null URL, or one without ``://``, has an empty host and path and so fits no rule; its text, if any, is still held
against the vocabulary (null and empty: allow); A-Z equals a-z in hosts and terms, not in paths; user names and ports are
part of the host as written; URLs of any length are read whole; equal rows get equal results; an empty table gives no rows;
``judge`` reads only the key and the URL, ``allowed`` returns the input's columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motifold.llm.work import bounded


@dataclass(frozen=True)
class Rule:
    """Fits URLs of ``host`` and its subdomains whose path begins with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)

#: One of these rejects.  Lower case, no letters of other scripts.
STRICT = (
    "porn", "porno", "pornhub", "xvideos", "xnxx", "xhamster", "redtube", "youporn", "xxx", "hentai", "milf", "blowjob",
    "bukkake", "gangbang", "camgirl", "camgirls", "nsfw", "upskirt", "warez", "keygen", "keygens",
)
#: Harmless alone; ``SOFT_LIMIT`` different ones reject.
SOFT = (
    "adult", "sex", "sexy", "nude", "nudes", "naked", "erotic", "escort", "escorts", "fetish", "webcam", "cams", "dating", "hookup",
    "casino", "poker", "slots", "roulette", "jackpot", "betting", "bet", "gambling", "bonus", "viagra", "cialis", "pharmacy", "pills",
    "torrent", "torrents", "crack", "cracked", "serial", "nulled", "payday", "loans", "replica", "free", "cheap",
)
SOFT_LIMIT = 2

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Vocabulary:
    """An Aho-Corasick automaton over bytes: term number ``t`` is strict if ``t < len(strict)``."""

    def __init__(self, strict: tuple[str, ...], soft: tuple[str, ...]) -> None:
        self.names = (*strict, *soft)
        self.n_strict = len(strict)
        if len(set(self.names)) != len(self.names) or not all(self.names):
            raise ValueError("terms must be different and not empty")
        terms = [name.encode() for name in self.names]
        self.lengths = [len(term) for term in terms]
        children: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        for number, term in enumerate(terms):
            state = 0
            for byte in term:
                if byte not in children[state]:
                    children[state][byte] = len(children)
                    children.append({})
                    ends.append([])
                state = children[state][byte]
            ends[state].append(number)
        # Breadth first: a state's missing transitions and its shorter terms are those of its longest proper suffix.
        table = np.zeros((len(children), 256), np.int64)
        suffix = [0] * len(children)
        queue = [0]
        for state in queue:
            if state:
                table[state] = table[suffix[state]]
                ends[state] = ends[state] + ends[suffix[state]]
            for byte, child in children[state].items():
                suffix[child] = int(table[state, byte]) if state else 0
                table[state, byte] = child
                queue.append(child)
        for letter in range(ord("A"), ord("Z") + 1):
            table[:, letter] = table[:, letter + 32]
        self.flat = (table << 8).reshape(-1).tolist()
        self.ends = {state << 8: tuple(found) for state, found in enumerate(ends) if found}
        self.inside = [b >= 0x80 or chr(b).isalpha() for b in range(256)]

    def hits(self, data: bytes) -> list[int]:
        """The term of every hit, by its end; overlapping hits count each."""
        flat, ends, inside, state, found = self.flat, self.ends, self.inside, 0, []
        for i, byte in enumerate(data):
            state = flat[state + byte]
            if state in ends and not (i + 1 < len(data) and inside[data[i + 1]]):
                for term in ends[state]:
                    start = i + 1 - self.lengths[term]
                    if start == 0 or not inside[data[start - 1]]:
                        found.append(term)
        return found

    def counts(self, data: bytes) -> tuple[int, int, list[str]]:
        """Hits of strict terms, hits of soft terms, and the different terms, strict first, in the vocabulary's order."""
        found = self.hits(data)
        strict = sum(t < self.n_strict for t in found)
        return strict, len(found) - strict, [self.names[t] for t in sorted(set(found))]

    def rejects(self, data: bytes, soft_limit: int) -> bool:
        found = set(self.hits(data))
        return any(t < self.n_strict for t in found) or len(found) >= soft_limit


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...], value: str = "name") -> Column:
    """The longest rule that fits (ties: the longer host); null if none does."""
    found = [F.lit(None).cast("string")]
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host))):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found.append(F.when(fits, F.lit(getattr(rule, value))))
    return F.coalesce(*reversed(found))


def _blobs(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def judge(
    pages: DataFrame,
    key: str = "page_id",
    url: str = "url",
    rules: tuple[Rule, ...] = RULES,
    strict: tuple[str, ...] = STRICT,
    soft: tuple[str, ...] = SOFT,
    soft_limit: int = SOFT_LIMIT,
) -> DataFrame:
    """(key, host, path, rule, verdict, strict_hits, soft_hits, terms): one row per page."""
    tail = "host string, path string, rule string, verdict string, strict_hits bigint, soft_hits bigint, terms array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(strict, soft)
        for batch in batches:
            counted = [vocabulary.counts(data) for data in _blobs(batch.column(1))]
            verdicts = []
            for ruled, (n_strict, _, terms) in zip(batch.column(5).to_pylist(), counted, strict=True):
                rejected = n_strict > 0 or len(terms) >= soft_limit
                verdicts.append(ruled or ("block" if rejected else "allow"))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in (0, 2, 3, 4)],
                    pa.array(verdicts, pa.string()),
                    pa.array([c[0] for c in counted], pa.int64()),
                    pa.array([c[1] for c in counted], pa.int64()),
                    pa.array([c[2] for c in counted], pa.list_(pa.string())),
                ],
                schema.names,
            )

    schema = T.StructType([pages.schema[key], *T._parse_datatype_string(tail).fields])
    host, path = host_and_path(F.col("u"))
    parted = pages.select(F.col(key).alias("k"), F.col(url).alias("u")).select(
        "k", "u", host.alias("h"), path.alias("p")
    )
    ruled = parted.select(
        "k", "u", "h", "p",
        fitting_rule(F.col("h"), F.col("p"), rules).alias("r"),
        fitting_rule(F.col("h"), F.col("p"), rules, "verdict").alias("v"),
    )
    return bounded(ruled).mapInArrow(run, schema)


def allowed(
    pages: DataFrame,
    url: str = "url",
    rules: tuple[Rule, ...] = RULES,
    strict: tuple[str, ...] = STRICT,
    soft: tuple[str, ...] = SOFT,
    soft_limit: int = SOFT_LIMIT,
) -> DataFrame:
    """The rows of ``pages`` that rules and vocabulary allow, all columns as they are."""
    names = pages.columns
    at = names.index(url)
    ruled = "verdict"
    while ruled in names:
        ruled += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(strict, soft)
        for batch in batches:
            fits = batch.column(len(names)).to_pylist()
            keep = [
                rule == "allow" or (rule is None and not vocabulary.rejects(data, soft_limit))
                for rule, data in zip(fits, _blobs(batch.column(at)), strict=True)
            ]
            yield batch.select(range(len(names))).filter(pa.array(keep, pa.bool_()))

    host, path = host_and_path(F.col(f"`{url}`"))
    marked = pages.withColumn(ruled, fitting_rule(host, path, rules, "verdict"))
    return bounded(marked).mapInArrow(run, pages.schema)
