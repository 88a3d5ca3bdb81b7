"""Edges of tables meet a dictionary of their own size as it is, a larger one by their nodes alone."""

import motifold as mf
from motifold.session import stage
from motifold.sources import located
from motifold.sources.tables import Rule, TableTriples, Term


def test_nodes_are_looked_up_only_in_a_larger_dictionary(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 9, i % 4) for i in range(40)], "a int, b int")
    source = TableTriples(spark, [Rule("t", Term("<a", "a", ">"), "<p>", Term("<b", "b", ">"))], {"t": lambda: rows})
    own = stage(mf.assign_dense_ids(mf.graph_nodes(source)), "ids")
    more = stage(own.unionByName(spark.range(1000, 1100).selectExpr("id", "concat('<c', id, '>') AS uri")), "ids")
    few = stage(own.where("uri <> '<a1>'"), "ids")
    asked, known = [], located.graph_nodes
    monkeypatch.setattr(located, "graph_nodes", lambda t: asked.append(t) or known(t))
    whole = sorted(map(tuple, mf.encode_edges(source, own).collect()))
    assert sorted(map(tuple, mf.encode_located(source, own).collect())) == whole and len(whole) == 36 and not asked
    lost = own.where("uri = '<a1>'").first()["id"]
    assert sorted(map(tuple, mf.encode_located(source, few).collect())) == [r for r in whole if r[0] != lost] and not asked
    assert sorted(map(tuple, mf.encode_located(source, more).collect())) == whole and len(asked) == 1
