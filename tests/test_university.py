"""The ten benchmark queries on a generated department, against plain enumeration."""

import random

import pytest

import motifold as mf
from motifold.plans.university import (
    ASSISTANT,
    ASSOCIATE,
    COURSE,
    DEPARTMENT,
    UNIVERSITY,
    university_queries,
)
from tests.test_random import enumerate_solutions

PREFIX = "http://lubm.example#"
QUERIES = university_queries(PREFIX)


def department(seed=3):
    rng = random.Random(seed)
    base = DEPARTMENT[1:-1]

    def own(name, i):
        return f"<{base}/{name}{i}>"

    def p(name):
        return f"<{PREFIX}{name}>"

    found = [
        (UNIVERSITY, mf.RDF_TYPE, p("University")),
        (DEPARTMENT, mf.RDF_TYPE, p("Department")),
        (DEPARTMENT, p("subOrganizationOf"), UNIVERSITY),
    ]
    courses = [COURSE, own("Course", 0), own("Course", 1)]
    found.append((COURSE, mf.RDF_TYPE, p("GraduateCourse")))
    found += [(c, mf.RDF_TYPE, p("Course")) for c in courses[1:]]
    professors = {ASSISTANT: "AssistantProfessor", ASSOCIATE: "AssociateProfessor"}
    for i, (who, kind) in enumerate(professors.items()):
        found += [
            (who, mf.RDF_TYPE, p(kind)),
            (who, p("headOf" if i else "worksFor"), DEPARTMENT),
            (who, p("teacherOf"), courses[1 + i]),
            (who, p("name"), f'"Professor {i}"'),
            (who, p("emailAddress"), f'"p{i}@x"'),
            (who, p("telephone"), '"1"'),
        ]
    for i in range(2):
        found += [
            (own("Publication", i), mf.RDF_TYPE, p("JournalArticle")),
            (own("Publication", i), p("publicationAuthor"), ASSISTANT),
        ]
    for i in range(6):
        who = own("Student", i)
        kind = "GraduateStudent" if i % 2 else "UndergraduateStudent"
        found += [
            (who, mf.RDF_TYPE, p(kind)),
            (who, p("memberOf"), DEPARTMENT),
            (who, p("advisor"), rng.choice(list(professors))),
            *((who, p("takesCourse"), c) for c in rng.sample(courses, 2)),
        ]
        if i % 3:
            found.append((who, p("emailAddress"), f'"s{i}@x"'))
        if i % 2:
            found.append((who, p("undergraduateDegreeFrom"), UNIVERSITY))
    return found


@pytest.fixture(scope="module")
def graph(spark):
    t = spark.createDataFrame(department(), "s string, p string, o string")
    return mf.infer(t, *mf.lubm_rules(spark, PREFIX), distinct=True).cache()


@pytest.mark.parametrize("name", QUERIES)
def test_counts(graph, name):
    triples = [tuple(r) for r in graph.collect()]
    names, expected = enumerate_solutions(triples, QUERIES[name], False)
    assert expected
    found = mf.match_bgp(graph, QUERIES[name])
    assert {tuple(r[n] for n in names) for r in found.collect()} == expected
    assert mf.count_bgp(graph, QUERIES[name]).first()["n"] == len(expected)
