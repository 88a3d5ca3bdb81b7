"""Closing rule tables, against listed closures and brute force."""

import random

import motifold as mf
from motifold.operators import infer as inference
from motifold.sources.tables import CLASS_RULES, PREDICATE_RULES, cls, node, pred

SMALL = "/root/testdata/sf0.001"


def pairs(df):
    return sorted(map(tuple, df.collect()))


def brute(rules):
    known = {(a, b) for a, b in rules if a != b}
    while True:
        more = {(a, d) for a, b in known for c, d in rules if b == c and a != d} - known
        if not more:
            return sorted(known)
        known |= more


def test_closure_equals_brute_force(spark):
    rng = random.Random(9)
    chain = [(f"c{i}", f"c{i + 1}") for i in range(9)]
    circle = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "x")]
    mixed = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(18)]
    for rules in (chain, circle, mixed):
        closed = mf.close_rules(mf.class_rule_table(spark, rules))
        assert closed.columns == ["cls", "super"] and pairs(closed) == brute(rules)
    assert mf.close_rules(mf.predicate_rule_table(spark, [("p", "p")])).count() == 0


def test_direct_rules_give_what_the_listed_closure_gives(spark):
    """The listed rules name Agent for every segment; here it follows from Customer."""
    direct = [r for r in CLASS_RULES if r[1] != cls("Agent")] + [(cls("Customer"), cls("Agent")), (cls("Supplier"), cls("Agent"))]
    assert (node("seg", "FURNITURE"), cls("Agent")) not in direct
    t = mf.triples_from_tables(spark, SMALL)
    predicates = mf.predicate_rule_table(spark, PREDICATE_RULES)
    closed = mf.close_rules(mf.class_rule_table(spark, direct))
    got = mf.infer(t, closed, mf.close_rules(predicates), distinct=True)
    want = mf.infer(t, mf.class_rule_table(spark, CLASS_RULES), predicates, distinct=True)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_many_rule_heads_join_instead_of_a_list(spark, monkeypatch):
    t = mf.triples_from_tables(spark, SMALL)
    rules = mf.predicate_rule_table(spark, PREDICATE_RULES)
    want = pairs(mf.infer_predicates(t, rules))
    monkeypatch.setattr(inference, "LISTED_HEADS", 1)
    assert pairs(mf.infer_predicates(t, rules)) == want
    assert {p for _, p, _ in want} == {pred("locatedIn")}
