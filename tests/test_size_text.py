"""Text written in small, bounded files."""

import motifold as mf
from motifold.sources import text


def test_lines_are_compressed_in_bounded_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text, "FILE_LINES", 300)
    triples = spark.range(1000).coalesce(1).selectExpr("concat('<urn:ex:node:', id, '>') AS s", "'<p>' AS p", "'\"a b\"' AS o")
    path, edges = tmp_path / "t", tmp_path / "e"
    mf.write_triples(triples, str(path))
    mf.write_edges(spark.range(1000).coalesce(1).selectExpr("id AS src", "id + 1 AS dst", "'<p>' AS pred"), str(edges))
    for folder in (path, edges):
        files = list(folder.glob("part-*"))
        assert len(files) == 4 and all(f.name.endswith(".gz") for f in files)
        assert sum(f.stat().st_size for f in files) < 20_000
    assert sorted(mf.read_triples(spark, str(path)).collect()) == sorted(triples.collect())
    assert sorted(r["dst"] - r["src"] for r in mf.read_edges(spark, str(edges)).collect()) == [1] * 1000
