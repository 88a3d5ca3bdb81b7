"""Cases outside the example tables: nulls, chained inference, printed keys, lossless text, query texts."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Observation

import motifold as mf
from motifold.plans.jobs import infer_file, load_graph
from motifold.plans.university import university_queries
from motifold.sources.tables import CLASS_RULES, cls, node


def rows(df):
    return sorted(map(tuple, df.collect()))


def mapped(spark, df, *rules):
    return mf.TableTriples(spark, rules, {"t": lambda: df})


def test_nodes_need_both_ends(spark):
    df = spark.createDataFrame([(1, None), (None, "b"), (2, "c")], "x int, y string")
    rule = mf.Rule("t", mf.Term("<x:", "x", ">"), "<p>", mf.Term("<y:", "y", ">"))
    t = mapped(spark, df, rule)
    assert rows(t.all()) == [("<x:2>", "<p>", "<y:c>")]
    assert rows(mf.node_set(t)) == [("<x:2>",), ("<y:c>",)]
    assert rows(mf.graph_nodes(t)) == [("<x:2>",), ("<y:c>",)]


def test_chained_inference_keeps_restrictions(spark):
    t = mf.triples_from_tables(spark, "/root/testdata/sf0.001")
    first, second = [(node("seg", "FURNITURE"), cls("X"))], [(cls("X"), cls("Y"))]
    chained = t.with_inference(first).with_inference(second)
    inferred = mf.infer(t, mf.class_rule_table(spark, first))
    inferred = mf.infer(inferred, mf.class_rule_table(spark, second))
    for name in ("X", "Y"):
        want = rows(inferred.where((F.col("p") == mf.RDF_TYPE) & (F.col("o") == cls(name))))
        assert rows(chained.scan(mf.RDF_TYPE, o=cls(name))) == want and want
    assert mf.infer_types(t, mf.class_rule_table(spark, CLASS_RULES)).count() == 2010


@pytest.mark.parametrize("kind", ["double", "decimal(8,2)", "date", "boolean", "int"])
def test_constants_match_the_printed_key(spark, kind):
    values = {"double": "1.0", "decimal(8,2)": "1.50", "date": "2020-02-03", "boolean": "true", "int": "7"}
    df = spark.createDataFrame([("a", values[kind])], "x string, y string").select(
        "x", F.col("y").cast(kind).alias("y")
    )
    t = mapped(spark, df, mf.Rule("t", mf.Term("<x:", "x", ">"), "<p>", mf.Term("<y:", "y", ">")))
    term = t.all().first()["o"]
    other = {"double": "<y:1>", "decimal(8,2)": "<y:1.5>", "date": "<y:2020-2-3>", "boolean": "<y:1>", "int": "<y:07>"}
    for source in (t, t.all()):
        assert mf.pattern_scan(source, ("?s", "<p>", term)).count() == 1
        assert mf.pattern_scan(source, ("?s", "<p>", other[kind])).count() == 0


RAW = ['a"b', "two\nlines", "back\\slash", "\\n", 'end\\', "##PropObj##", 'p ##PropObj##q "x', "", " ", "5\" pipe\r\n"]


def test_text_loses_nothing(spark, tmp_path):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(RAW)], "k int, name string")
    rule = mf.Rule("t", mf.Term("<n:", "k", ">"), "<name>", mf.Term('"', "name", '"'))
    t = mapped(spark, df, rule)
    made = t.all()
    assert rows(made.select(F.substring_index("s", ":", -1).alias("s"), mf.literal_value(F.col("o")))) == sorted(
        (f"{i}>", x) for i, x in enumerate(RAW)
    )
    mf.write_triples(made, str(tmp_path / "t"))
    assert rows(mf.read_triples(spark, str(tmp_path / "t"))) == rows(made)
    assert mf.rejected_lines(spark, str(tmp_path / "t")).first()["n"] == 0
    vertices = mf.build_vertices(made, mf.assign_dense_ids(mf.graph_nodes(made)))
    mf.write_vertices(vertices, str(tmp_path / "v"))
    back = mf.read_vertices(spark, str(tmp_path / "v")).select("uri", F.explode("props.obj").alias("o"))
    assert rows(back) == rows(made.select("s", "o"))
    for i, x in enumerate(RAW):  # a constant finds its row over the table as over the triples
        term = made.where(F.col("s") == f"<n:{i}>").first()["o"]
        assert rows(mf.pattern_scan(t, ("?s", "<name>", term))) == [(f"<n:{i}>",)]


def test_bare_quotes_and_line_ends_are_escaped(spark, tmp_path):
    bare = [("<s>", "<p>", '"a\nb"'), ("<s>", "<p>", '"5" pipe"'), ("<s>", "<p>", '"x"@en'), ("<s>", "<p>", '"e\\"')]
    mf.write_triples(spark.createDataFrame(bare, "s string, p string, o string"), str(tmp_path / "t"))
    got = mf.read_triples(spark, str(tmp_path / "t"))
    values = rows(got.select(mf.literal_value(F.col("o"))))
    assert values == [('5" pipe',), ("a\nb",), ("e\\",), ("x",)]


def test_open_literals_are_rejected_and_counted(spark, tmp_path):
    file = tmp_path / "in.nt"
    file.write_text('<s> <q> "two words .\n<s> <q> "fine" .\n<s> <p> <o> .\n<s> <p>\n')
    assert rows(mf.read_triples(spark, str(file))) == [("<s>", "<p>", "<o>"), ("<s>", "<q>", '"fine"')]
    assert mf.rejected_lines(spark, str(file)).first()["n"] == 2
    for job in ("load", "infer"):
        rejects = Observation(job)
        if job == "load":
            load_graph(spark, str(file), str(tmp_path / "g"), rejects=rejects)
        else:
            infer_file(spark, str(file), str(tmp_path / "i"), "http://u#", rejects=rejects)
        assert rejects.get["n"] == 2


def test_inference_is_one_pass(spark, tmp_path, capsys):
    path = str(tmp_path / "t")
    spark.createDataFrame([("<a>", mf.RDF_TYPE, "<C>"), ("<a>", "<p>", "<b>")], "s string, p string, o string").write.parquet(path)
    classes = mf.class_rule_table(spark, [("<C>", "<D>"), ("<C>", "<E>")])
    predicates = mf.predicate_rule_table(spark, [("<p>", "<q>")])
    out = mf.infer(spark.read.parquet(path), classes, predicates)
    want = [("<a>", "<p>", "<b>"), ("<a>", "<q>", "<b>")] + [("<a>", mf.RDF_TYPE, c) for c in ("<C>", "<D>", "<E>")]
    out.explain()
    assert rows(out) == sorted(want)
    assert capsys.readouterr().out.count("FileScan parquet") == 1


def test_query_texts():
    assert mf.parse_query('?x a <C> . ?x <p> "a . b c"@en .') == [("?x", "a", "<C>"), ("?x", "<p>", '"a . b c"@en')]
    assert mf.parse_query(r'?x <p> "a \" . b"') == [("?x", "<p>", r'"a \" . b"')]
    for bad in ("?x <p>", '?x <p> "open', "?x <p> ?y ?z", "?x <p> ?y . . ?y <q> ?z"):
        with pytest.raises(ValueError):
            mf.parse_query(bad)


def test_university_queries_as_text():
    for patterns in university_queries("http://u.example#").values():
        assert mf.parse_query(" . ".join(" ".join(p) for p in patterns)) == [tuple(p) for p in patterns]
