"""Text and table forms of triples, vertices and edges."""

import pytest

import motifold as mf
from motifold.operators.graph import EMPTY_BAG
from tests.tiny import triples

TEXT = r"""
<s> <p> <o> .
<s> <p> <o>.
  <s>	<q>   "two words" .
<s> <q> "a \"quoted\" word"@en .
<s> <q> "5"^^<http://t#int> .
<s> <q> "dot."^^<t>.
<s> <q> "" .
_:b1 <p> _:b2 .
<s> <p> <o> <graph> .
# a comment line
<s> <p>
<s> <p> .
alone
"""


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture()
def path(tmp_path):
    file = tmp_path / "in.nt"
    file.write_text(TEXT)
    return str(file)


def test_read_whole_literals(spark, path):
    assert rows(mf.read_triples(spark, path)) == sorted(
        [
            ("<s>", "<p>", "<o>"),
            ("<s>", "<p>", "<o>"),
            ("<s>", "<p>", "<o>"),
            ("<s>", "<q>", '"two words"'),
            ("<s>", "<q>", r'"a \"quoted\" word"@en'),
            ("<s>", "<q>", '"5"^^<http://t#int>'),
            ("<s>", "<q>", '"dot."^^<t>'),
            ("<s>", "<q>", '""'),
            ("_:b1", "<p>", "_:b2"),
        ]
    )
    assert mf.rejected_lines(spark, path).first()["n"] == 4


def test_read_tokens(spark, path):
    got = rows(mf.read_triples(spark, path, literal_mode="token"))
    assert ("<s>", "<q>", '"two') in got
    assert len(got) == 9
    with pytest.raises(ValueError):
        mf.read_triples(spark, path, literal_mode="other")


def test_very_long_literal(spark, tmp_path):
    literal = '"' + r"word \" " * 50_000 + '"'
    (tmp_path / "long.nt").write_text(f"<s> <p> {literal} .\n")
    assert rows(mf.read_triples(spark, str(tmp_path / "long.nt"))) == [("<s>", "<p>", literal)]


def test_triple_round_trip(spark, tmp_path):
    t = spark.createDataFrame(triples(), "s string, p string, o string")
    mf.write_triples(t, str(tmp_path / "t"))
    assert rows(mf.read_triples(spark, str(tmp_path / "t"))) == sorted(triples())


def test_vertex_and_edge_round_trip(spark, tmp_path):
    t = mf.dedup_triples(spark.createDataFrame(triples(), "s string, p string, o string"))
    ids = mf.assign_dense_ids(mf.graph_nodes(t), 5)
    vertices = mf.build_vertices(t, ids)
    mf.write_vertices(vertices, str(tmp_path / "v"))
    expected = [(r["id"], r["uri"], r["props"]) for r in vertices.collect()]
    back = mf.read_vertices(spark, str(tmp_path / "v"))
    assert rows(back) == sorted(expected)
    assert back.schema["props"].dataType.simpleString() == EMPTY_BAG
    line = sorted(r["value"] for r in spark.read.text(str(tmp_path / "v")).collect())[-1]
    assert line.split(" ")[0].isdigit() and "##PropObj##" in line
    edges = mf.encode_edges(t, ids)
    mf.write_edges(edges, str(tmp_path / "e"))
    assert rows(mf.read_edges(spark, str(tmp_path / "e"))) == rows(edges)
    mf.write_edge_table(edges, str(tmp_path / "et"))
    assert rows(mf.read_edge_table(spark, str(tmp_path / "et"))) == rows(edges)
    mf.write_vertex_table(vertices, str(tmp_path / "vt"))
    assert rows(mf.read_vertex_table(spark, str(tmp_path / "vt"))) == rows(vertices)
