"""Pattern queries as one text: ``?x p ?y . ?y q "a value" .``"""

from __future__ import annotations

import re

_TERM = re.compile(r'"(?:[^"\\]|\\.)*"(?:\^\^(?:<[^>\s]*>|\S+)|@[A-Za-z0-9\-]+)?|<[^>\s]*>|[^\s"]\S*')


def parse_query(text: str) -> list[tuple[str, str, str]]:
    """The patterns of a query text; literals with blanks and dots stay whole.

    A dot between blanks parts two patterns; one after the last is allowed.
    """
    patterns: list[list[str]] = [[]]
    at = 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        found = _TERM.match(text, at)
        if found is None:
            raise ValueError(f"a literal is not closed: {text[at:]!r}")
        at = found.end()
        if at < len(text) and not text[at].isspace():
            raise ValueError(f"no blank after {found[0]!r}")
        if found[0] == ".":
            patterns.append([])
        else:
            patterns[-1].append(found[0])
    if len(patterns) > 1 and not patterns[-1]:
        patterns.pop()
    for terms in patterns:
        if len(terms) != 3:
            raise ValueError(f"a pattern needs three terms: {' '.join(terms)!r}")
    return [tuple(terms) for terms in patterns]
