"""A pattern query over tables, evaluated on key columns.

Where all rules that can bind a variable build its term from one template, the
variable carries the bare key through all joins and the term is built once, in
the answer.  Rules that cannot meet the other patterns of the query are left
out, and attributes or edges from the table row that a scan already reads become
filters or columns of that scan instead of joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.terms import is_variable, variable_name
from .tables import INT_TYPES, Rule, TableTriples, Term, any_overlap
from .triples import Relation, no_triples, union_all


@dataclass
class _Use:
    """One pattern and the rules that can answer it."""

    pattern: tuple[str, str, str]
    rules: list[Rule]
    binds_object: bool

    @property
    def ends(self) -> list[tuple[str, str]]:
        """(variable, position) of the bound ends."""
        s, _, o = self.pattern
        found = [(variable_name(s), "subject")] if is_variable(s) else []
        if self.binds_object and is_variable(o):
            found.append((variable_name(o), "object"))
        return found


class KeyedTriples:
    def __init__(self, base: TableTriples, query):
        self.base = base
        self.spark = base.spark
        self.query = query
        self.edges = [self._use(e, True) for e in query.edges]
        self.tests = {
            v: {c: self._use((f"?{v}", *c), False) for c in constraints}
            for v, constraints in query.stars.items()
        }
        uses = [*self.edges, *(u for found in self.tests.values() for u in found.values())]
        self._drop_unreachable(uses)
        self.terms = self._common_terms(uses)

    # --- preparation ---------------------------------------------------------

    def _use(self, pattern, binds_object: bool) -> _Use:
        s, p, o = pattern
        rules = [
            r
            for r in self.base.rules
            if r.predicate == p
            and (is_variable(s) or r.subject.key_text(s) is not None)
            and (is_variable(o) or r.object.key_text(o) is not None)
        ]
        return _Use(pattern, rules, binds_object)

    @staticmethod
    def _drop_unreachable(uses: list[_Use]) -> None:
        """Keep a rule only if every other pattern on its variables can build an equal term."""
        places: dict[str, list[tuple[_Use, str]]] = {}
        for use in uses:
            for v, end in use.ends:
                places.setdefault(v, []).append((use, end))

        def reachable(use: _Use, rule: Rule) -> bool:
            return all(
                any(getattr(rule, end).may_equal(getattr(r, end2)) for r in other.rules)
                for v, end in use.ends
                for other, end2 in places[v]
                if other is not use
            )

        changed = True
        while changed:
            changed = False
            for use in uses:
                kept = [r for r in use.rules if reachable(use, r)]
                changed |= len(kept) < len(use.rules)
                use.rules = kept

    def _common_terms(self, uses: list[_Use]) -> dict[str, Term]:
        """Template of every variable that has just one, over comparable columns."""
        found: dict[str, set] = {}
        for use in uses:
            for v, end in use.ends:
                for r in use.rules:
                    term = getattr(r, end)
                    found.setdefault(v, set()).add(
                        (term.prefix, term.suffix, self._column_kind(r.table, term))
                    )
        return {
            v: Term(prefix, v, suffix)
            for v, kinds in found.items()
            if len(kinds) == 1
            for prefix, suffix, kind in kinds
            if kind in ("integer", "text")
        }

    def _column_kind(self, table: str, term: Term) -> str:
        if term.column is None:
            return "constant"
        kind = self.base.column_type(table, term.column)
        if isinstance(kind, INT_TYPES):
            return "integer"
        return "text" if isinstance(kind, T.StringType) else "other"

    # --- scans ---------------------------------------------------------------

    def _end_sql(self, rule: Rule, end: str, variable: str) -> str:
        term = getattr(rule, end)
        if variable not in self.terms:
            return term.sql()
        if self._column_kind(rule.table, term) == "integer":
            return f"CAST(`{term.column}` AS BIGINT)"
        return f"`{term.column}`"

    @staticmethod
    def _row_test(rule: Rule, use: _Use) -> Rule | None:
        """The rule of ``use`` that reads the very row ``rule`` reads, if no other can match."""
        near = [q for q in use.rules if q.subject.may_equal(rule.subject)]
        if len(near) != 1 or not rule.key or not near[0].key:
            return None
        same = near[0].table == rule.table and near[0].subject == rule.subject
        return near[0] if same else None

    def _branch(self, rule: Rule, pairs: list[tuple[_Use, Rule]], wanted: list) -> DataFrame | None:
        """Rows of one table that satisfy all (use, rule) pairs; ``wanted`` = (variable, sql)."""
        df = self.base.rows(rule.table)
        for use, r in pairs:
            s, _, o = use.pattern
            df = self.base.restrict(
                df, r, None if is_variable(s) else s, None if is_variable(o) else o
            )
            if df is None:
                return None
        seen: dict[str, str] = {}
        for variable, sql in wanted:
            if seen.setdefault(variable, sql) != sql:
                df = df.where(f"{seen[variable]} = {sql}")
        if not rule.key:
            columns = [t.column for t in (rule.subject, rule.object) if t.column]
            df = df.select(*dict.fromkeys(columns)).distinct()
        return df.selectExpr(*(f"{sql} AS `{v}`" for v, sql in seen.items()))

    def _empty(self, variables) -> DataFrame:
        none = no_triples(self.spark)
        kinds = {v: "s" for v in variables}
        return none.selectExpr(*(f"{c} AS `{v}`" for v, c in kinds.items()))

    def relations(self) -> list[Relation]:
        groups: list[list[_Use]] = []
        for use in self.edges:
            home = next((g for g in groups if self._same_row(g[0], use)), None)
            if home is None:
                groups.append([use])
            else:
                home.append(use)
        return [self._relation(g) for g in groups]

    def _same_row(self, first: _Use, use: _Use) -> bool:
        """Both patterns read one row of one table, by the same subject variable."""
        if not is_variable(first.pattern[0]) or first.pattern[0] != use.pattern[0]:
            return False
        return (
            len(first.rules) == 1
            and len(use.rules) == 1
            and self._row_test(first.rules[0], use) is not None
        )

    def _relation(self, group: list[_Use]) -> Relation:
        first = group[0]
        s = first.pattern[0]
        subject = variable_name(s) if is_variable(s) else None
        variables = tuple(dict.fromkeys(v for use in group for v, _ in use.ends))
        # Attribute tests that every branch finds on the row it reads.
        absorbed = {
            c: use
            for c, use in self.tests.get(subject, {}).items()
            if first.rules and all(self._row_test(r, use) for r in first.rules)
        }
        frames, used = [], []
        for rule in first.rules:
            pairs = [(first, rule)]
            pairs += [(use, use.rules[0]) for use in group[1:]]
            pairs += [(use, self._row_test(rule, use)) for use in absorbed.values()]
            wanted = [
                (v, self._end_sql(r, end, v))
                for use, r in pairs[: len(group)]
                for v, end in use.ends
            ]
            df = self._branch(rule, pairs, wanted)
            if df is not None:
                frames.append(df)
                used.append(rule)
        df = union_all(frames) if frames else self._empty(variables)
        if any_overlap(used):
            df = df.distinct()
        known = self.base.catalog([first.pattern[1]])
        functional = len(used) == 1 and used[0].key or any(k.functional for k in known.values())
        constant = any(not is_variable(t) for use in group for t in use.pattern[::2])
        return Relation(
            df=df.select(*(f"`{v}`" for v in variables)),
            variables=variables,
            determined_by=subject if functional else None,
            constant=constant,
            tested=frozenset((subject, c) for c in absorbed),
            grouped=not all(r.key for r in used) or any_overlap(used),
        )

    def subjects(self, p: str, o: str | None, variable: str | None = None) -> DataFrame:
        """Subjects ``s`` of a constraint on ``variable``, in the form the variable has."""
        if variable is None:
            return self.base.subjects(p, o)
        use = next(
            u for (q, term), u in self.tests[variable].items()
            if q == p and (None if is_variable(term) else term) == o
        )
        frames, used = [], []
        for rule in use.rules:
            wanted = [("s", self._end_sql(rule, "subject", variable))]
            df = self._branch(rule, [(use, rule)], wanted)
            if df is not None:
                frames.append(df)
                used.append(rule)
        df = union_all(frames) if frames else self._empty(["s"])
        return df.distinct() if any_overlap(used) else df

    def decode(self, df: DataFrame, variables) -> DataFrame:
        """Build the terms of the variables that carry keys; other columns stay."""
        keyed = [v for v in variables if v in self.terms]
        if not keyed:
            return df
        return df.selectExpr(
            *(f"{self.terms[c].sql()} AS `{c}`" if c in keyed else f"`{c}`" for c in df.columns)
        )
