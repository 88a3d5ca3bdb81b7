"""Terms and triple patterns.

A term is a plain string: ``<iri>`` or ``_:b`` for a node, ``"..."`` for a
literal, ``?name`` for a variable of a pattern.  Literals stay opaque; they are
only ever compared for equality.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"

_TYPE_SHORT = ("a", "rdf:type")
_VARIABLE = re.compile(r"\?\w+")


def is_variable(term: str) -> bool:
    return term.startswith("?")


def is_literal(term: str) -> bool:
    return term.startswith('"')


def variable_name(term: str) -> str:
    """Column name of a variable: the term without its question mark."""
    return term[1:]


def triple_kind(p: Column, o: Column) -> Column:
    """``literal``, ``type`` or ``object`` for each triple."""
    return (
        F.when(o.startswith('"'), F.lit("literal"))
        .when(p == RDF_TYPE, F.lit("type"))
        .otherwise(F.lit("object"))
    )


def match_term(column: Column, term: str) -> Column:
    """True where ``column`` can be bound to ``term``; a variable accepts all."""
    return F.lit(True) if is_variable(term) else column == F.lit(term)


def bag_has(props: Column, p: str, o: str = "?any") -> Column:
    """Test on a property array: has ``p`` with object ``o`` (a variable = any)."""
    if is_variable(o):
        return F.exists(props, lambda x: x["prop"] == p)
    return F.exists(props, lambda x: (x["prop"] == p) & (x["obj"] == o))


def check_pattern(pattern) -> tuple[str, str, str]:
    """Validate one ``(s, p, o)`` tuple and expand the short forms of rdf:type."""
    s, p, o = pattern
    for term in (s, p, o):
        if not isinstance(term, str) or not term:
            raise ValueError(f"pattern {pattern!r}: terms must be non-empty strings")
    if is_variable(p):
        raise ValueError(f"pattern {pattern!r}: the predicate must be a constant")
    for term in (s, o):
        if is_variable(term) and not _VARIABLE.fullmatch(term):
            raise ValueError(f"pattern {pattern!r}: bad variable name {term!r}")
    return s, RDF_TYPE if p in _TYPE_SHORT else p, o


def pattern_variables(pattern) -> list[str]:
    """Variable column names of a pattern, subject first, without repeats."""
    s, _, o = pattern
    return list(dict.fromkeys(variable_name(t) for t in (s, o) if is_variable(t)))


def escape_sql(column: str) -> str:
    """SQL of a column's text with what a literal must not hold bare written as an escape."""
    steps = ((r"'\\'", r"'\\\\'"), ("'\"'", "'\\\\\"'"), (r"'\n'", r"'\\n'"), (r"'\r'", r"'\\r'"))
    out = f"CAST(`{column}` AS STRING)"
    for raw, escaped in steps:
        out = f"replace({out}, {raw}, {escaped})"
    return out


_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r"}


def unescaped(text: str) -> str | None:
    """The value of a literal's inner text, or None if this is not how ``escape_sql`` writes it."""
    out, i = [], 0
    back = {v: k for k, v in _ESCAPES.items()}
    while i < len(text):
        if text[i] in _ESCAPES:
            pair = text[i : i + 2]
            if pair not in back:
                return None
            out.append(back[pair])
            i += 2
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def literal(column: str) -> Column:
    """A literal term of a column's text; the inverse is ``literal_value``."""
    return F.expr(f"concat('\"', {escape_sql(column)}, '\"')")


def literal_value(term: Column) -> Column:
    """The text of a literal term: quotes and suffix off, escapes undone."""
    inner = F.regexp_extract(term, r'(?s)^"(.*)"[^"]*$', 1)
    # Text between escaped backslashes holds no other backslash than those of escapes.
    parts = F.split(inner, r"\\\\")
    plain = F.transform(
        parts,
        lambda x: F.replace(
            F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")), F.lit('\\"'), F.lit('"')
        ),
    )
    return F.array_join(plain, "\\")
