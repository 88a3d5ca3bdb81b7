"""Registered queries against their SQL, mixing, nearest neighbours and the whole pipeline."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from motifold.llm import components, mixing, nn_descent, packing, queries, quality_rules
from motifold.llm.work import documents, stage
from tests.llm.fixtures import no_documents, odd_documents, odd_rows
from tests.llm.test_added import URLS
from tests.llm.test_texts import WORD, brute_components, brute_secrets
from tests.oracle import compare

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd_dir(spark, shared_folder):
    path = os.path.join(str(shared_folder), "odd")
    odd_documents(spark).where("doc_id IS NOT NULL AND doc_id <> 100").coalesce(1).write.parquet(f"{path}/documents.parquet")
    urls = list(enumerate(URLS))
    spark.createDataFrame(urls, "page_id long, url string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    return path


def connection(path):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        file = f"{path}/{table}.parquet"
        files = file if os.path.isfile(file) else f"{file}/*.parquet"
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{files}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
@pytest.mark.parametrize("where", ["small", "odd"])
def test_query_equals_its_sql(spark, odd_dir, name, where):
    path = SMALL if where == "small" else odd_dir
    n, different = compare(queries.QUERIES[name](spark, path), connection(path), queries.SQL[name])
    assert n > 0 and different == ""


def test_every_operator_is_registered():
    assert {name.split("_")[0] for name in queries.QUERIES} == {"pipeline", *(f"op{n}" for n in range(1, 14))}


# --- mixing ------------------------------------------------------------------------------------


def brute_targets(sizes: dict, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed: dict = {}
    while True:
        rest = share * sum(sizes.values()) - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        out = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if out[s] >= most * sizes[s]]
        if not over:
            return fixed | out
        fixed |= {s: float(most * sizes[s]) for s in over}


def check_mix(rows, names=("doc_id", "source", "_mix_size", "_mix_total", "_mix_target", "_mix_taken")):
    sizes: Counter = Counter()
    for r in rows:
        sizes[r[names[1]]] += r[names[2]]
    want = brute_targets(dict(sizes))
    taken: Counter = Counter()
    for r in rows:
        assert r[names[3]] == sizes[r[names[1]]]
        assert abs(r[names[4]] - want[r[names[1]]]) < 1e-6 * max(1, want[r[names[1]]])
        assert 0 <= r[names[5]] <= 2 * r[names[2]]
        taken[r[names[1]]] += r[names[5]]
    for source, target in want.items():
        assert abs(taken[source] - target) <= 0.5001


def test_mix_of_odd_rows(spark):
    rows = mixing.mix(odd_documents(spark)).collect()
    assert len(rows) == len(odd_rows())
    check_mix(rows)
    again = mixing.mix(odd_documents(spark).repartition(7)).collect()
    assert Counter((r.doc_id, r._mix_taken) for r in rows) == Counter((r.doc_id, r._mix_taken) for r in again)
    assert mixing.mix(no_documents(spark)).count() == 0


def test_mixed_texts_have_the_words_taken(spark):
    docs = documents(spark, SMALL)
    taken = {r.doc_id: (r._mix_size, r._mix_taken, r.text) for r in mixing.mix(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.schema.names == docs.schema.names
    words: Counter = Counter()
    for r in out.collect():
        found = WORD.findall(r.text)
        words[r.doc_id] += len(found)
        assert taken[r.doc_id][2].startswith(r.text) and r.n_chars == len(r.text)
    assert words == Counter({k: t for k, (_, t, _) in taken.items() if t})


def test_plan_of_mixing_is_native(spark, capsys):
    queries.op9_mixing(spark, SMALL).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- components, nearest neighbours ------------------------------------------------------------


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in components.components(df).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
    assert components.components(df.limit(0)).count() == 0


def clustered(n, dim=24):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, dim))
    return centres[rng.integers(0, 12, n)] + 0.3 * rng.standard_normal((n, dim))


def brute_nearest(rows, queries_, k):
    out = {}
    for q in queries_:
        mine = np.array(rows[q])
        score = sorted(((-float(np.dot(mine, v)), i) for i, v in rows.items() if i != q))
        out[q] = score[:k]
    return out


def test_nearest_with_copies_and_useless_vectors(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "BLOCK", 128)
    monkeypatch.setattr(nn_descent, "GROUP", 16)
    values = clustered(900)
    values[300:420] = values[300]  # more copies than are asked for
    rows = {i: v.tolist() for i, v in enumerate(values)}
    useless = [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] * 24), (2060, [1.0, 2.0]), (2080, [1.0] * 23 + [None])]
    data = [(i, v, "x") for i, v in rows.items()] + [(i, v, "y") for i, v in useless] + [(None, [1.0] * 24, "z")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, id string").repartition(5)
    got: dict = {}
    for r in nn_descent.nearest(df, F.col("id") % 20 == 0, k=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    asked = [i for i in rows if i % 20 == 0]
    assert sorted(got) == asked
    want = brute_nearest(rows, asked, 10)
    hits = 0
    for q in asked:
        found = sorted(got[q])
        assert [f[0] for f in found] == list(range(1, 11))
        assert all((a[2], -a[1]) >= (b[2], -b[1]) for a, b in zip(found, found[1:], strict=False))
        hits += len({f[1] for f in found} & {i for _, i in want[q]})
        assert all(abs(f[2] - np.dot(rows[q], rows[f[1]])) < 1e-9 for f in found)
    assert hits >= 0.95 * 10 * len(asked)


def test_recall_on_the_given_vectors(spark):
    path = "/root/testdata/sf0.01"
    found: dict = {}
    for r in queries.op5_nn_descent(spark, path).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    table = spark.read.parquet(f"{path}/embeddings.parquet").collect()
    rows = {r.vec_id: r.embedding for r in table}
    want = brute_nearest(rows, [i for i in rows if i % 20 == 0], 20)
    assert set(found) == set(want)
    assert np.mean([len(found[q] & {i for _, i in want[q]}) / 20 for q in want]) >= 0.9


def recall_in_blocks(spark, values, k=20):
    """Of ``nearest`` for every twentieth row of ``values``, against all products."""
    data = [(i, v) for i, v in enumerate(values.tolist())]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    found: dict = {}
    for r in nn_descent.nearest(df, F.col("vec_id") % 20 == 0, k=k).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, len(values), 20):
        score = values @ values[q]
        score[q] = -np.inf
        hits += len(found[q] & set(np.argpartition(-score, k)[:k].tolist()))
    return hits / k / len(range(0, len(values), 20))


@pytest.mark.parametrize("spread", [0.02, 0.15])
def test_recall_in_many_separate_groups(spark, spread):
    """More groups than pivots can meet, each larger than a node's list: no edge leads from one to another."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((1000, 32))
    values = np.repeat(centres / np.linalg.norm(centres, axis=1)[:, None], 24, axis=0)
    values = values + spread / 32**0.5 * rng.standard_normal(values.shape)
    values = values[rng.permutation(len(values))]
    values /= np.linalg.norm(values, axis=1)[:, None]
    assert recall_in_blocks(spark, values) >= 0.95


@pytest.mark.parametrize("length", [1e9])
def test_a_long_vector_costs_the_others_nothing(spark, length):
    values = clustered(2000)
    values[7] *= length
    assert recall_in_blocks(spark, values) >= 0.95


def test_scored_pairs_do_not_grow_with_the_table(spark, monkeypatch):
    """Per node no more than the blocks and the lists of all rounds; the same for a table four times as large."""
    monkeypatch.setattr(nn_descent, "BLOCK", 128)
    per_node = []
    for n in (800, 3200):
        values = np.random.default_rng(5).standard_normal((n, 16))
        table = spark.createDataFrame([(i, v) for i, v in enumerate(values.tolist())], "vec_id long, embedding array<double>")
        nodes = stage(nn_descent.node_table(nn_descent.usable(table, "vec_id", "embedding"), 21), "nodes")
        counts = nn_descent.neighbour_graph(nodes).agg(F.avg("scored").alias("m"), F.max(F.size("near")).alias("k")).first()
        assert counts["k"] == nn_descent.NEIGHBOURS
        per_node.append(counts["m"])
    assert per_node[1] < 1.5 * per_node[0]


def test_blocks_are_ranges_above_the_switch(spark, monkeypatch):
    """More blocks than one step cuts: blocks stay ranges of the projection, and neighbours are found."""
    monkeypatch.setattr(nn_descent, "BLOCK", 128)
    monkeypatch.setattr(nn_descent, "RANGES", 4)
    values = clustered(3000)
    data = [(i, float(v[0]), b"", 1.0) for i, v in enumerate(values)]
    nodes = spark.createDataFrame(data, "node long, one double, half binary, norm double")
    blocks = nn_descent.blocks_along(nodes, len(data), "one").join(nodes.select("node", "one"), "node")
    ends = sorted((r.a, r.b, r.n) for r in blocks.groupBy("block").agg(F.min("one").alias("a"), F.max("one").alias("b"), F.count("*").alias("n")).collect())
    assert sum(n for _, _, n in ends) == len(data) and max(n for _, _, n in ends) <= 2 * 128
    assert all(x[1] < y[0] for x, y in zip(ends, ends[1:], strict=False))
    assert recall_in_blocks(spark, values) >= 0.95


def test_few_or_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in nn_descent.nearest(few, F.col("id") % 20 == 0).collect())
    assert got == [(0, 1, 20), (0, 2, 3), (20, 1, 0), (20, 2, 3)]
    assert nn_descent.nearest(few.limit(0), F.col("id") % 20 == 0).count() == 0


# --- pipeline ----------------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark, odd_dir):
    docs = documents(spark, odd_dir)
    kept = [r for r in quality_rules.accepted(docs).collect()]
    assert all(len(WORD.findall(r.text)) >= 20 for r in kept)
    rows = {r.doc_id: r for r in kept}
    least = {k: c for k, _, c in brute_components([(r.doc_id, r.text) for r in kept])}
    rows = {k: r for k, r in rows.items() if least[k] == k}

    def cleaned(text):
        for _, a, b in reversed(brute_secrets(text)):
            text = text[:a] + "[x]" + text[b:]
        return text

    sizes: Counter = Counter()
    for r in rows.values():
        sizes[r.source] += len(WORD.findall(cleaned(r.text)))
    targets = brute_targets(dict(sizes))
    out = corpus_pipeline.run(spark, odd_dir).collect()
    docs_out = docs
    for name, function in corpus_pipeline.STAGES[:4]:
        docs_out = stage(function(spark, docs_out, odd_dir), name)
        assert docs_out.schema.names == docs.schema.names
    mixed = docs_out.collect()
    assert {r.doc_id for r in mixed} <= set(rows)
    taken: Counter = Counter()
    for r in mixed:
        taken[r.source] += len(WORD.findall(r.text))
    assert all(abs(taken[s] - t) <= 0.5001 for s, t in targets.items())
    exact = packing._exact(packing.TOKENIZER)
    want = Counter()
    for r in mixed:
        want[r.doc_id] += len(exact.encode(r.text, add_special_tokens=False).ids) + 1
    got: Counter = Counter()
    for p in out:
        got[p.doc_id] += p.length
        assert len(p.ids) == 4 * p.length
    assert got == want


def test_pipeline_of_nothing(spark):
    docs = no_documents(spark)
    for _, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, SMALL), "nothing")
    assert docs.count() == 0
