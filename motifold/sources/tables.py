"""Relational tables seen as triples.

Each rule maps rows of a table to triples of one predicate.  A term is a
template around one column, so a constant node of a pattern turns into an
equality on a key column and reaches the Parquet scan, and duplicates are
removed on the narrow key columns, before any string is built.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, replace
from functools import cache
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.terms import RDF_TYPE, escape_sql, is_literal, unescaped
from ..session import BROADCAST_BYTES
from .triples import Predicate, no_triples, union_all

_INT_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
INT_TYPES = tuple(_INT_BITS)


def sql_text(value: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Term:
    """``prefix + column + suffix``, or the constant ``prefix`` without a column."""

    prefix: str
    column: str | None = None
    suffix: str = ""

    def sql(self) -> str:
        """The term as a SQL expression over its table."""
        if self.column is None:
            return sql_text(self.prefix)
        value = escape_sql(self.column) if is_literal(self.prefix) else f"`{self.column}`"
        return f"concat({sql_text(self.prefix)}, {value}, {sql_text(self.suffix)})"

    def key_text(self, term: str) -> str | None:
        """The column text that builds ``term``, or None if this template cannot."""
        if self.column is None:
            return "" if term == self.prefix else None
        if len(term) < len(self.prefix) + len(self.suffix):
            return None
        if not (term.startswith(self.prefix) and term.endswith(self.suffix)):
            return None
        inner = term[len(self.prefix) : len(term) - len(self.suffix)]
        return unescaped(inner) if is_literal(self.prefix) else inner

    def test(self, column: str) -> str:
        """SQL test of the terms in ``column`` that this template can build."""
        if self.column is None:
            return f"`{column}` = {sql_text(self.prefix)}"
        ends = f"startswith(`{column}`, {sql_text(self.prefix)}) AND endswith(`{column}`, {sql_text(self.suffix)})"
        return f"{ends} AND length(`{column}`) >= {len(self.prefix) + len(self.suffix)}"

    def key_sql(self, column: str) -> str:
        """The column text that builds a term that passes ``test``; node templates only, a literal's text may be escaped."""
        size = f"length(`{column}`) - {len(self.prefix) + len(self.suffix)}"
        return f"substring(`{column}`, {len(self.prefix) + 1}, {size})"

    def may_equal(self, other: Term) -> bool:
        """Whether both templates can build one and the same term."""
        if self.column is None:
            return other.key_text(self.prefix) is not None
        if other.column is None:
            return self.key_text(other.prefix) is not None
        heads = sorted((self.prefix, other.prefix), key=len)
        tails = sorted((self.suffix, other.suffix), key=len)
        return heads[1].startswith(heads[0]) and tails[1].endswith(tails[0])


def _key_test(column: str, text: str, kind: T.DataType) -> str | None:
    """SQL test for the column values whose printed form is exactly ``text``, or None if there are none.

    Whole numbers and strings compare in their own type and reach the scan; other types compare as they print.
    """
    if isinstance(kind, T.StringType):
        return f"`{column}` = {sql_text(text)}"
    bits = _INT_BITS.get(type(kind))
    if bits is None:
        return f"CAST(`{column}` AS STRING) = {sql_text(text)}"
    if not re.fullmatch(r"0|-?[1-9][0-9]*", text):
        return None
    return f"`{column}` = {text}" if -(2 ** (bits - 1)) <= int(text) < 2 ** (bits - 1) else None


@dataclass(frozen=True)
class Rule:
    """Triples of one predicate from one table.

    ``key`` declares the subject column a unique key of the table: the rows are
    then a set already and every subject has one object.  ``only`` keeps rows
    that pass all of its tests: the column prints as one of the given texts.
    """

    table: str
    subject: Term
    predicate: str
    object: Term
    key: bool = False
    only: tuple[tuple[str, tuple], ...] = ()

    @property
    def is_data(self) -> bool:
        return self.predicate == RDF_TYPE or is_literal(self.object.prefix)

    def may_overlap(self, other: Rule) -> bool:
        return (
            self.predicate == other.predicate
            and self.subject.may_equal(other.subject)
            and self.object.may_equal(other.object)
        )


def any_overlap(rules: Iterable[Rule]) -> bool:
    """Whether two of the rules can build one and the same triple."""
    return any(a.may_overlap(b) for a, b in combinations(rules, 2))


def _merged_in_batches(df: DataFrame) -> DataFrame:
    """Rows of which each is once in its Arrow batch."""
    names = df.columns

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from pa.Table.from_batches([batch]).group_by(names, use_threads=False).aggregate([]).to_batches()

    return df.mapInArrow(merged, df.schema)


class TableTriples:
    """A set of triples defined by rules over tables.

    ``homes`` names, for a column of a join view, the table all its values come
    from: the values of ``("view", "column")`` are among those of that table.
    """

    def __init__(
        self,
        spark: SparkSession,
        rules: Iterable[Rule],
        tables: Mapping[str, Callable[[], DataFrame]],
        homes: Mapping[tuple[str, str], str] | None = None,
    ):
        self.spark = spark
        self.rules = list(rules)
        self._tables = tables
        self._homes = dict(homes or {})

    def with_inference(
        self,
        class_rules: Iterable[tuple[str, str]] = (),
        predicate_rules: Iterable[tuple[str, str]] = (),
    ) -> TableTriples:
        """Add rules for the inferred triples (one pass, as ``infer``).

        A rule pair restricts or renames a mapping rule, so inferred triples are
        scans of the same tables and need no join with the rule pairs.
        """
        supers: dict[str, list[str]] = {}
        for cls, sup in dict.fromkeys(class_rules):
            supers.setdefault(sup, []).append(cls)
        more = []
        for rule in self.rules:
            if rule.predicate == RDF_TYPE:
                for sup, classes in supers.items():
                    found = [t for c in classes if (t := rule.object.key_text(c)) is not None]
                    if not found:
                        continue
                    test = ((rule.object.column, tuple(found)),) if rule.object.column else ()
                    more.append(replace(rule, object=Term(sup), only=(*rule.only, *test)))
            for p, sup in dict.fromkeys(predicate_rules):
                if rule.predicate == p:
                    more.append(replace(rule, predicate=sup))
        return TableTriples(self.spark, [*self.rules, *more], self._tables, self._homes)

    def scan(self, p: str, s: str | None = None, o: str | None = None) -> DataFrame:
        return self._union([r for r in self.rules if r.predicate == p], s, o)

    def scan_any(self, predicates: Iterable[str]) -> DataFrame:
        """Triples of several predicates."""
        wanted = set(predicates)
        return self._union([r for r in self.rules if r.predicate in wanted])

    def all(self, kind: str | None = None) -> DataFrame:
        """All triples, or only the ``data`` or ``object`` ones.

        Rules on the unique key of a table share one scan of it.
        """
        rules = [r for r in self.rules if kind is None or r.is_data == (kind == "data")]
        if not rules:
            return no_triples(self.spark)
        df = self._frames(rules)
        return df.distinct() if any_overlap(rules) else df

    def _frames(self, rules: list[Rule], merge: Callable[[DataFrame], DataFrame] = DataFrame.distinct) -> DataFrame:
        shared: dict[str, list[Rule]] = {}
        for r in rules:
            if r.key and not r.only:
                shared.setdefault(r.table, []).append(r)
        alone = [r for r in rules if not (r.key and not r.only)]
        frames = [self._rows_of_table(group) for group in shared.values()]
        frames += [self._rows(r, None, None, merge) for r in alone]
        return union_all(frames)

    def bag(self) -> DataFrame:
        """All triples with few repeats, for a step that merges them itself: nothing is shuffled here.

        Repeated keys merge in each Arrow batch, so a triple of many rows is one row per batch.
        """
        return self._frames(self.rules, _merged_in_batches)

    def ends(self, kind: str | None = None, sides: str = "so") -> DataFrame:
        """Column ``node``: subjects and objects with few repeats.

        ``kind='object'`` leaves out the objects of attributes, ``sides`` the subjects or the objects.  Every key column
        is read once, where one of its rules gives a triple (both ends there, all tests passed), and
        reduced before any string is built.
        """
        found: dict[tuple, list[Rule]] = {}
        for r in self.rules:
            if "s" in sides:
                found.setdefault((r.table, r.subject), []).append(r)
            if "o" in sides and (kind is None or not r.is_data):
                found.setdefault((r.table, r.object), []).append(r)
        frames = []
        for (table, term), rules in found.items():
            # Left out if all its values are those of another entry.
            if (self._homes.get((table, term.column)), term) in found:
                continue
            unique = any(r.key and r.subject == term for r in rules)
            df = self.rows(table)
            whole = [" AND ".join(self._tests(df, r)) or "true" for r in rules]
            df = df.where(" OR ".join(f"({x})" for x in dict.fromkeys(whole)))
            if term.column is None:
                df = df.limit(1)
            elif unique:
                df = df.select(term.column)
            else:
                df = df.select(term.column).distinct()
            frames.append(df.selectExpr(f"{term.sql()} AS node"))
        return union_all(frames)

    def restricted(self, predicates: Iterable[str]) -> TableTriples:
        """The triples of some predicates as a source of their own."""
        wanted = set(predicates)
        return TableTriples(self.spark, [r for r in self.rules if r.predicate in wanted], self._tables, self._homes)

    def coded_edges(self, ids: DataFrame) -> DataFrame:
        """Object triples as ``(src, dst, pred)`` over ``ids`` ``(id, uri)``, a table that is read several times.

        Rows meet the ids by their key columns, so no term of a triple is built or moved.  Ids of a template that measure
        little are broadcast; the other joins are plain shuffles of both sides, in which adaptive execution can split a
        hub.  Repeated rows merge where the last join has brought them together.
        """
        rules = [r for r in self.rules if not r.is_data]
        if not rules:
            none = no_triples(self.spark)
            return none.select(F.lit(0).cast("bigint").alias("src"), F.lit(0).cast("bigint").alias("dst"), F.col("p").alias("pred"))
        templates = list(dict.fromkeys(t for r in rules for t in (r.subject, r.object)))
        # One row: the size of the ids of every template.
        size = F.octet_length("uri") + F.octet_length(F.col("id").cast("string")) + 16
        sums = [F.sum(F.when(F.expr(t.test("uri")), size)).alias(str(i)) for i, t in enumerate(templates)]
        found = ids.agg(*sums).first()
        small = {t for i, t in enumerate(templates) if (found[i] or 0) <= BROADCAST_BYTES}
        df = union_all(self._coded(r, ids, small) for r in rules)
        return df.distinct() if any_overlap(rules) else df

    def _coded(self, rule: Rule, ids: DataFrame, small: set[Term]) -> DataFrame:
        df = self.restrict(self.rows(rule.table), rule)
        ends = [(rule.subject, "src"), (rule.object, "dst")]
        columns = list(dict.fromkeys(t.column for t, _ in ends if t.column is not None))
        df = df.select(*(F.col(f"`{c}`").alias(f"#{c}") for c in columns))
        last = []
        for term, name in sorted(ends, key=lambda e: e[0] not in small):  # narrow joins first
            own = ids.where(term.test("uri"))
            if term.column is None:
                df = df.crossJoin(F.broadcast(own.select(F.col("id").alias(name))))
                continue
            key = f"#{term.column}"
            own = own.select(F.col("id").alias(name), F.expr(term.key_sql("uri")).alias("#text"))
            kind = df.schema[key].dataType
            if isinstance(kind, INT_TYPES):
                # Keys are compared as they print: '007' is no key 7.
                value = F.expr(f"try_cast(`#text` AS {kind.simpleString()})")
                own = own.select(name, "#text", value.alias("#key")).where(F.col("#key").cast("string") == F.col("#text"))
            else:
                own = own.select(name, F.col("#text").alias("#key"))
                df = df.withColumn(key, F.col(f"`{key}`").cast("string"))
            own = own.select(name, "#key")
            if term in small:
                own = F.broadcast(own)
            else:
                last = [key]
            df = df.join(own, F.col(f"`{key}`") == F.col("#key")).drop("#key")
        if not rule.key and last:
            # One sort of the rows that the join has brought together, where an aggregation would keep two tables of them.
            same = Window.partitionBy(*(f"`{c}`" for c in last), "src", "dst").orderBy("src", "dst")
            df = df.select("src", "dst", *(f"`{c}`" for c in last))
            df = df.withColumn("#k", F.row_number().over(same)).where(F.col("#k") == 1)
        elif not rule.key:
            df = df.select("src", "dst").distinct()
        return df.select("src", "dst", F.lit(rule.predicate).alias("pred"))

    def subjects(self, p: str, o: str | None, variable: str | None = None) -> DataFrame:
        """Column ``s``: subjects with predicate ``p`` and, if given, object ``o``."""
        return self.scan(p, o=o).select("s")

    def for_query(self, query):
        """This source prepared for one pattern query."""
        from .keyed import KeyedTriples

        return KeyedTriples(self, query)

    def catalog(self, predicates: Iterable[str]) -> dict[str, Predicate]:
        """Known from the rules alone, no table is read."""
        found = {}
        for p in predicates:
            rules = [r for r in self.rules if r.predicate == p]
            if rules:
                apart = not any(
                    a.subject.may_equal(b.subject) for a, b in combinations(rules, 2)
                )
                found[p] = Predicate(
                    is_data=any(r.is_data for r in rules),
                    functional=apart and all(r.key for r in rules),
                )
        return found

    def _union(self, rules: list[Rule], s: str | None = None, o: str | None = None) -> DataFrame:
        frames = [(r, f) for r in rules if (f := self._rows(r, s, o)) is not None]
        if not frames:
            return no_triples(self.spark)
        df = union_all(f for _, f in frames)
        return df.distinct() if any_overlap(r for r, _ in frames) else df

    def rows(self, table: str) -> DataFrame:
        return self._tables[table]()

    def most_rows(self) -> int:
        """Triples at most, one per rule and row; a join view is taken to be as long as the longest home of its columns."""
        views: dict[str, set[str]] = {}
        for (view, _), home in self._homes.items():
            views.setdefault(view, set()).add(home)
        sizes = {}
        for name in {r.table for r in self.rules}:
            sizes[name] = max(self.rows(t).count() for t in views.get(name, {name}))
        return sum(sizes[r.table] for r in self.rules)

    def column_type(self, table: str, column: str) -> T.DataType:
        return self.rows(table).schema[column].dataType

    def restrict(
        self, df: DataFrame, rule: Rule, s: str | None = None, o: str | None = None
    ) -> DataFrame | None:
        """Rows of the rule's table that give a triple with the given constant ends.

        None if the templates cannot build a constant at all.
        """
        tests = self._tests(df, rule)
        for term, constant in ((rule.subject, s), (rule.object, o)):
            text = None if constant is None else term.key_text(constant)
            if constant is not None and text is None:
                return None
            if term.column is not None and text is not None:
                test = _key_test(term.column, text, df.schema[term.column].dataType)
                if test is None:
                    return None
                tests.append(test)
        return df.where(" AND ".join(dict.fromkeys(tests))) if tests else df

    @staticmethod
    def _tests(df: DataFrame, rule: Rule) -> list[str]:
        """SQL tests of the rows that give a triple: both ends there, and the rule's own tests."""
        tests = [f"`{t.column}` IS NOT NULL" for t in (rule.subject, rule.object) if t.column is not None]
        for column, texts in rule.only:
            kind = df.schema[column].dataType
            found = [v for t in texts if (v := _key_test(column, t, kind)) is not None]
            tests.append(f"({' OR '.join(found)})" if found else "false")
        return list(dict.fromkeys(tests))

    def _rows(
        self, rule: Rule, s: str | None, o: str | None, merge: Callable[[DataFrame], DataFrame] = DataFrame.distinct
    ) -> DataFrame | None:
        """Triples of one rule with constant ends pushed to key columns."""
        df = self.restrict(self.rows(rule.table), rule, s, o)
        if df is None:
            return None
        columns = [t.column for t in (rule.subject, rule.object) if t.column is not None]
        df = df.select(*dict.fromkeys(columns))
        if not rule.key:
            df = merge(df)
        return df.selectExpr(
            f"{rule.subject.sql()} AS s",
            f"{sql_text(rule.predicate)} AS p",
            f"{rule.object.sql()} AS o",
        )

    def _rows_of_table(self, rules: list[Rule]) -> DataFrame:
        """Triples of several rules of one table in one pass over its rows."""
        triples = ", ".join(
            f"struct({r.subject.sql()} AS s, {sql_text(r.predicate)} AS p, {r.object.sql()} AS o)"
            for r in rules
        )
        rows = self.rows(rules[0].table).selectExpr(f"inline(array({triples}))")
        return rows.where("s IS NOT NULL AND o IS NOT NULL")


# --- the order-entry tables -------------------------------------------------

# Names of the example mapping.
NODE = "<urn:ex:{kind}:"
PREDICATE = "<urn:ex:p:{name}>"
CLASS = "<urn:ex:class:{name}>"


def node(kind: str, key) -> str:
    return f"<urn:ex:{kind}:{key}>"


def pred(name: str) -> str:
    return PREDICATE.format(name=name)


def cls(name: str) -> str:
    return CLASS.format(name=name)


def _node(kind: str, column: str) -> Term:
    return Term(NODE.format(kind=kind), column, ">")


def _literal(column: str) -> Term:
    return Term('"', column, '"')


_CUSTOMER = _node("customer", "c_custkey")
_SUPPLIER = _node("supplier", "s_suppkey")
_NATION = _node("nation", "n_nationkey")
_REGION = _node("region", "r_regionkey")
_PART = _node("part", "p_partkey")
_ORDER = _node("order", "o_orderkey")
_LINE_ORDER = _node("order", "l_orderkey")
_LINE_PART = _node("part", "l_partkey")
_LINE_SUPPLIER = _node("supplier", "l_suppkey")

ORDER_ENTRY_RULES = (
    Rule("customer", _CUSTOMER, RDF_TYPE, _node("seg", "c_mktsegment"), key=True),
    Rule("customer", _CUSTOMER, pred("residesIn"), _node("nation", "c_nationkey"), key=True),
    Rule("customer", _CUSTOMER, pred("name"), _literal("c_name"), key=True),
    Rule("supplier", _SUPPLIER, RDF_TYPE, Term(cls("Supplier")), key=True),
    Rule("supplier", _SUPPLIER, pred("basedIn"), _node("nation", "s_nationkey"), key=True),
    Rule("supplier", _SUPPLIER, pred("name"), _literal("s_name"), key=True),
    Rule("nation", _NATION, RDF_TYPE, Term(cls("Nation")), key=True),
    Rule("nation", _NATION, pred("partOf"), _node("region", "n_regionkey"), key=True),
    Rule("nation", _NATION, pred("name"), _literal("n_name"), key=True),
    Rule("region", _REGION, RDF_TYPE, Term(cls("Region")), key=True),
    Rule("region", _REGION, pred("name"), _literal("r_name"), key=True),
    Rule("part", _PART, RDF_TYPE, _node("ptype", "p_type"), key=True),
    Rule("part", _PART, pred("brand"), _literal("p_brand"), key=True),
    Rule("orders", _ORDER, RDF_TYPE, _node("ostatus", "o_orderstatus"), key=True),
    Rule("orders", _ORDER, pred("placedBy"), _node("customer", "o_custkey"), key=True),
    Rule("orders", _ORDER, pred("priority"), _literal("o_orderpriority"), key=True),
    Rule("lineitem", _LINE_ORDER, pred("contains"), _LINE_PART),
    Rule("lineitem", _LINE_ORDER, pred("hasSupplier"), _LINE_SUPPLIER),
    Rule("lineitem", _LINE_ORDER, pred("returnflag"), _literal("l_returnflag")),
    Rule("lineitem", _LINE_SUPPLIER, pred("supplies"), _LINE_PART),
    Rule("purchase", _node("customer", "o_custkey"), pred("boughtFrom"), _LINE_SUPPLIER),
)

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
PART_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
ORDER_STATUSES = ("F", "O", "P")

CLASS_RULES = (
    *((node("seg", v), cls("Customer")) for v in SEGMENTS),
    *((node("seg", v), cls("Agent")) for v in SEGMENTS),
    (cls("Supplier"), cls("Agent")),
    *((node("ptype", v), cls("Part")) for v in PART_TYPES),
    *((node("ostatus", v), cls("Order")) for v in ORDER_STATUSES),
)
PREDICATE_RULES = (
    (pred("residesIn"), pred("locatedIn")),
    (pred("basedIn"), pred("locatedIn")),
)


def triples_from_tables(
    spark: SparkSession, directory: str, only: Mapping[str, str] | None = None
) -> TableTriples:
    """The order-entry tables of ``directory`` as a set of triples.

    ``only`` gives, for a table, the SQL test of the rows that it contributes.  Lines meet all orders, also
    those left out.
    """
    tests = dict(only or {})

    def table(name: str) -> Callable[[], DataFrame]:
        def rows() -> DataFrame:
            df = spark.read.parquet(f"{directory}/{name}.parquet")
            return df.where(tests[name]) if name in tests else df

        return cache(rows)

    names = ("customer", "supplier", "nation", "region", "part", "orders", "lineitem")
    tables = {name: table(name) for name in names}

    def purchase() -> DataFrame:
        lines = tables["lineitem"]().select("l_orderkey", "l_suppkey")
        whole = spark.read.parquet(f"{directory}/orders.parquet") if "orders" in tests else tables["orders"]()
        orders = whole.select("o_orderkey", "o_custkey")
        return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])

    return TableTriples(
        spark,
        ORDER_ENTRY_RULES,
        {**tables, "purchase": purchase},
        homes={("purchase", "l_suppkey"): "lineitem"} | ({} if tests else {("purchase", "o_custkey"): "orders"}),
    )
