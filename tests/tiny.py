"""A small university graph with its known answers."""

from motifold import RDF_TYPE

PREFIX = "http://u.example#"

LINES = """\
s1 type GraduateStudent
s1 takesCourse c1
s1 takesCourse c2
s1 takesCourse c1
s1 advisor p1
s1 likes p1
s1 memberOf d1
s1 undergraduateDegreeFrom u1
s1 name "Ann"
s1 emailAddress "ann@x"
s1 emailAddress "ann2@x"
s2 type UndergraduateStudent
s2 takesCourse c1
s2 advisor p2
s2 memberOf d1
s2 name "Bob Lee"
s2 label "x"
s1 label c1
p1 type FullProfessor
p1 teacherOf c1
p1 headOf d1
p1 likes p1
p1 name "Cy"
p2 type AssistantProfessor
p2 teacherOf c2
p2 worksFor d1
d1 type Department
d1 subOrganizationOf u1
u1 type University
c1 type Course
c2 type GraduateCourse
"""


def iri(name: str) -> str:
    return f"<{PREFIX}{name}>"


def term(name: str) -> str:
    if name.startswith(("?", '"')):
        return name
    return RDF_TYPE if name == "type" else iri(name)


def pattern(s: str, p: str, o: str) -> tuple[str, str, str]:
    return term(s), term(p), term(o)


def triples() -> list[tuple[str, str, str]]:
    return [pattern(*line.split(" ", 2)) for line in LINES.splitlines()]


def _short(value):
    if isinstance(value, str) and value.startswith(f"<{PREFIX}"):
        return value[len(PREFIX) + 1 : -1]
    return value


def local(df, *columns) -> list[tuple]:
    """Rows of a result as sorted local names."""
    rows = df.select(*columns).collect() if columns else df.collect()
    return sorted(tuple(map(_short, r)) for r in rows)
