"""The ten pattern queries of the public university benchmark (LUBM)."""

from __future__ import annotations

from ..functions.terms import RDF_TYPE

# The individuals the queries ask for, and below the patterns of the ten queries.
UNIVERSITY = "<http://www.University1000.edu>"
DEPARTMENT = "<http://www.Department0.University1000.edu>"
COURSE = "<http://www.Department0.University1000.edu/GraduateCourse0>"
ASSISTANT = "<http://www.Department0.University1000.edu/AssistantProfessor0>"
ASSOCIATE = "<http://www.Department0.University1000.edu/AssociateProfessor0>"


def university_queries(prefix: str) -> dict[str, list[tuple[str, str, str]]]:
    """Patterns by query name, for terms under the ontology ``prefix``."""

    def has(s: str, p: str, o: str) -> tuple[str, str, str]:
        return s, f"<{prefix}{p}>", o

    def isa(s: str, name: str) -> tuple[str, str, str]:
        return s, RDF_TYPE, f"<{prefix}{name}>"

    return {
        "lubm1": [isa("?X", "GraduateStudent"), has("?X", "takesCourse", COURSE)],
        "lubm2": [
            isa("?X", "GraduateStudent"),
            isa("?Y", "University"),
            isa("?Z", "Department"),
            has("?X", "memberOf", "?Z"),
            has("?Z", "subOrganizationOf", "?Y"),
            has("?X", "undergraduateDegreeFrom", "?Y"),
        ],
        "lubm3": [isa("?X", "Publication"), has("?X", "publicationAuthor", ASSISTANT)],
        "lubm4": [
            isa("?X", "Professor"),
            has("?X", "worksFor", DEPARTMENT),
            has("?X", "name", "?Y1"),
            has("?X", "emailAddress", "?Y2"),
            has("?X", "telephone", "?Y3"),
        ],
        "lubm5": [isa("?X", "Person"), has("?X", "memberOf", DEPARTMENT)],
        "lubm6": [isa("?X", "Student")],
        "lubm7": [
            isa("?X", "Student"),
            isa("?Y", "Course"),
            has("?X", "takesCourse", "?Y"),
            has(ASSOCIATE, "teacherOf", "?Y"),
        ],
        "lubm8": [
            isa("?X", "Student"),
            isa("?Y", "Department"),
            has("?X", "memberOf", "?Y"),
            has("?Y", "subOrganizationOf", UNIVERSITY),
            has("?X", "emailAddress", "?Z"),
        ],
        "lubm9": [
            isa("?X", "Student"),
            isa("?Y", "Faculty"),
            isa("?Z", "Course"),
            has("?X", "advisor", "?Y"),
            has("?Y", "teacherOf", "?Z"),
            has("?X", "takesCourse", "?Z"),
        ],
        "lubm10": [isa("?X", "Student"), has("?X", "takesCourse", COURSE)],
    }
