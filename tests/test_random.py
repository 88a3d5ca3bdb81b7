"""Pattern queries on random graphs against plain enumeration."""

import itertools
import random

import pytest

import motifold as mf
from motifold.functions.terms import is_literal, is_variable

EDGES = ["<p>", "<q>", "<r>"]
ATTRIBUTES = ["<name>", mf.RDF_TYPE]


def random_graph(rng):
    nodes = [f"<n{i}>" for i in range(rng.randint(3, 6))]
    triples = set()
    for _ in range(rng.randint(6, 22)):
        # One node gets a large share of the edges.
        o = nodes[0] if rng.random() < 0.4 else rng.choice(nodes)
        triples.add((rng.choice(nodes), rng.choice(EDGES), o))
    for _ in range(rng.randint(2, 8)):
        triples.add((rng.choice(nodes), "<name>", f'"{rng.choice("ab")}"'))
        triples.add((rng.choice(nodes), mf.RDF_TYPE, f"<C{rng.randint(0, 1)}>"))
    return nodes, sorted(triples)


def random_query(rng, nodes):
    variables = [f"?v{i}" for i in range(rng.randint(2, 4))]

    def end():
        return rng.choice(variables) if rng.random() < 0.85 else rng.choice(nodes)

    patterns = [(end(), rng.choice(EDGES), end()) for _ in range(rng.randint(1, 4))]
    for _ in range(rng.randint(0, 3)):
        p = rng.choice(ATTRIBUTES)
        values = ['"a"', '"b"'] if p == "<name>" else ["<C0>", "<C1>"]
        patterns.append((end(), p, rng.choice(["?free", *values])))
    rng.shuffle(patterns)
    return patterns


def enumerate_solutions(triples, patterns, bind_data):
    data = {p for _, p, o in triples if is_literal(o)} | {mf.RDF_TYPE}
    edges = [x for x in patterns if bind_data or not (x[1] in data or is_literal(x[2]))]
    tests = [x for x in patterns if x not in edges]
    names = {t for s, _, o in edges for t in (s, o) if is_variable(t)}
    names |= {s for s, _, _ in tests if is_variable(s)}
    names = sorted(names)
    facts = set(triples)
    terms = sorted({t for s, _, o in triples for t in (s, o)})
    found = set()
    for values in itertools.product(terms, repeat=len(names)):
        env = dict(zip(names, values, strict=True))
        if all((env.get(s, s), p, env.get(o, o)) in facts for s, p, o in edges) and all(
            any(
                f[0] == env.get(s, s) and f[1] == p and (is_variable(o) or f[2] == o)
                for f in facts
            )
            for s, p, o in tests
        ):
            found.add(values)
    return [n[1:] for n in names], found


@pytest.mark.parametrize("seed", range(12))
def test_against_enumeration(spark, seed):
    rng = random.Random(seed)
    nodes, triples = random_graph(rng)
    t = spark.createDataFrame(triples, "s string, p string, o string")
    patterns = random_query(rng, nodes)
    bind_data = seed % 4 == 0
    names, expected = enumerate_solutions(triples, patterns, bind_data)
    df = mf.match_bgp(
        t,
        patterns,
        bind_data=bind_data,
        allow_cross=True,
        probe_bytes=0 if seed % 2 else 1 << 20,
        split_rows=2 if seed % 3 else 0,
    )
    assert sorted(df.columns) == names
    rows = [tuple(r[n] for n in names) for r in df.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == expected
    count = mf.count_bgp(t, patterns, bind_data=bind_data, allow_cross=True)
    assert count.first()["n"] == len(expected)
    if names:
        root = rng.choice(names)
        k = names.index(root)
        per_root = {}
        for row in expected:
            per_root[row[k]] = per_root.get(row[k], 0) + 1
        counts = mf.solutions_per_root(t, patterns, root, bind_data, allow_cross=True)
        assert {r[root]: r["n"] for r in counts.collect()} == per_root
        kept = rng.sample(names, rng.randint(1, len(names)))
        projected = mf.project_bgp(t, patterns, kept, bind_data, allow_cross=True)
        got = [tuple(r) for r in projected.collect()]
        assert len(got) == len(set(got))
        assert set(got) == {tuple(row[names.index(v)] for v in kept) for row in expected}
