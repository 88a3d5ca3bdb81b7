"""Lines of triples are cut without patterns where they are plain, to the same terms."""

import random

from pyspark.sql import functions as F

import motifold as mf
from motifold.sources import text


def test_plain_lines_are_cut_as_the_pattern_cuts_them(spark, tmp_path):
    rng = random.Random(5)
    pieces = ["<a>", "<b c>", "<", ">", "a", '"x"', '"x y"', '"x\\" y"', '"', '"x"@en', '"x"@', '"x"^^<t>', '"x"^^t', '"x"y', "\\", ".", "#", " ", "  ",
              "\t", "\f", "\x0b", " . ", " <p> ", "é", '"é "', "_:b", " "]
    lines = sorted({"".join(rng.choice(pieces) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 7))) for _ in range(3000)})
    path = tmp_path / "lines.nt"
    path.write_text("\n".join(lines), encoding="utf-8")
    for mode, pattern in (("whole", text._OBJECT), ("token", r"^(\S+)")):
        part = F.split(F.trim("value", F.lit(" \t\r")), r"\s+", 3)
        o = F.when(F.size(part) == 3, F.regexp_extract(F.get(part, F.lit(2)), pattern, 1))
        want = spark.read.text(str(path)).select(part[0].alias("s"), F.get(part, F.lit(1)).alias("p"), o.alias("o"))
        want = want.where(o.isNotNull() & ~F.col("s").startswith("#") & ~F.col("o").isin("", "."))
        got = mf.read_triples(spark, str(path), mode)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 500


def test_a_line_is_cut_once(spark, tmp_path, capsys):
    mf.write_triples(spark.createDataFrame([("<a>", "<p>", '"x y"'), ("<a>", "<q>", '"a"b"c"')], "s string, p string, o string"), str(tmp_path / "t"))
    read = mf.read_triples(spark, str(tmp_path / "t"))
    read.explain()
    plan = capsys.readouterr().out
    assert plan.count("split(") == 1
    assert sorted(r["o"] for r in read.collect()) == ['"a\\"b\\"c"', '"x y"']
