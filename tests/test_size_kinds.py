"""Attributes of a store are read from the predicates that its catalog knows as data."""

from collections import Counter

import motifold as mf


def test_attributes_are_read_from_their_partitions(spark, tmp_path, capsys):
    given = [("a", "name", '"x"'), ("a", "name", "b"), ("a", "knows", "b"), ("b", "knows", "a"), ("b", mf.RDF_TYPE, "C")]
    path = str(tmp_path / "g")
    mf.write_store(spark.createDataFrame(given, "s string, p string, o string"), path)
    store = mf.open_store(spark, path)
    found = store.all("data")
    assert Counter(map(tuple, found.select("s", "p", "o").collect())) == Counter([given[0], given[4]])
    assert Counter(map(tuple, store.all("object").select("s", "p", "o").collect())) == Counter(given[1:4])
    found.explain("formatted")
    plan = capsys.readouterr().out
    (line,) = [x for x in plan.splitlines() if "PartitionFilters" in x]
    assert "name" in line and "knows" not in line
    assert mf.listable_predicates(store) == sorted(["name", mf.RDF_TYPE])
