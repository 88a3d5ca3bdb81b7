"""

Queries read the order-entry tables of a scale directory.  The SQL of the
pattern queries is written against the relational tables; only operators whose
input is the triple set itself start from the ``m`` table below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import motifold as mf
from motifold.plans.order_entry import BOUND, PATTERNS
from motifold.session import new_path, stage
from motifold.sources.tables import (
    CLASS_RULES,
    ORDER_STATUSES,
    PART_TYPES,
    PREDICATE_RULES,
    SEGMENTS,
    TableTriples,
    cls,
    node,
    pred,
    triples_from_tables,
)

FLAGSHIP_DIR = "/root/testdata/sf0.001"
DENSE_START = 1000


def _inferred(spark: SparkSession, directory: str) -> TableTriples:
    return triples_from_tables(spark, directory).with_inference(CLASS_RULES, PREDICATE_RULES)


def _pattern_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, directory: str) -> DataFrame:
        return mf.match_bgp(_inferred(spark, directory), PATTERNS[name], name in BOUND)

    return run


def _count_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, directory: str) -> DataFrame:
        return mf.count_bgp(_inferred(spark, directory), PATTERNS[name], name in BOUND)

    return run


def entry(spark: SparkSession) -> DataFrame:
    return _pattern_query("bgp_triangle")(spark, FLAGSHIP_DIR)


# --- operator queries over the mapped triples, before inference ---------------


def map_triples(spark, directory):
    return triples_from_tables(spark, directory).all()


def classify(spark, directory):
    t = mf.classify_triples(triples_from_tables(spark, directory))
    return t.groupBy("kind").agg(F.count("*").alias("n"))


def predicate_catalog(spark, directory):
    return mf.predicate_catalog(triples_from_tables(spark, directory))


def pattern_scan(spark, directory):
    return mf.pattern_scan(triples_from_tables(spark, directory), ("?o", pred("placedBy"), "?c"))


def filter_edges(spark, directory):
    return mf.filter_edges(
        triples_from_tables(spark, directory), [pred("partOf"), pred("residesIn")]
    )


def const_term(spark, directory):
    t = triples_from_tables(spark, directory)
    return mf.pattern_scan(t, ("?c", pred("residesIn"), node("nation", 2)))


def has_property(spark, directory):
    found = mf.has_property(triples_from_tables(spark, directory), pred("returnflag"))
    return found.withColumnRenamed("s", "o")


def has_property_value(spark, directory):
    t = triples_from_tables(spark, directory)
    return mf.has_property_value(t, pred("returnflag"), '"R"').withColumnRenamed("s", "o")


def star_filter(spark, directory):
    t = triples_from_tables(spark, directory)
    orders = mf.pattern_scan(t, ("?o", pred("placedBy"), "?c"))
    constraints = [
        (pred("returnflag"), '"R"'),
        (pred("returnflag"), '"A"'),
        (pred("priority"), "?any"),
    ]
    return mf.star_filter(orders, "o", t, constraints).select("o")


def project_solutions(spark, directory):
    t = triples_from_tables(spark, directory)
    solutions = mf.match_bgp(
        t, [("?o", pred("placedBy"), "?c"), ("?c", pred("residesIn"), "?n")]
    )
    return mf.project_solutions(solutions, ["n"])


def project_bgp(spark, directory):
    t = triples_from_tables(spark, directory)
    patterns = [("?o", pred("placedBy"), "?c"), ("?c", pred("residesIn"), "?n")]
    return mf.project_bgp(t, patterns, ["n"])


def _orders_and_parts(spark, directory):
    t = triples_from_tables(spark, directory)
    return (
        mf.pattern_scan(t, ("?o", pred("placedBy"), "?c")),
        mf.pattern_scan(t, ("?o", pred("contains"), "?p")),
    )


def natural_join(spark, directory):
    return mf.natural_join(*_orders_and_parts(spark, directory))


def salted_join(spark, directory):
    """The same join with every order of more than two rows cut on both sides."""
    return mf.natural_join(*_orders_and_parts(spark, directory), split_rows=2)


def expand_edge(spark, directory):
    t = triples_from_tables(spark, directory)
    orders = mf.pattern_scan(t, ("?o", pred("placedBy"), "?c"))
    return mf.expand_edge(orders, t, ("?c", pred("residesIn"), "?n"))


def expand_edge_backward(spark, directory):
    t = triples_from_tables(spark, directory)
    nations = mf.pattern_scan(t, ("?n", pred("partOf"), "?r"))
    return mf.expand_edge(nations, t, ("?c", pred("residesIn"), "?n"))


def attach_props(spark, directory):
    t = triples_from_tables(spark, directory)
    vertices = mf.assign_ids(mf.node_set(t))
    return mf.attach_props(t, vertices, split_rows=100_000).select(F.col("uri").alias("s"), "prop", "obj")


def object_nodes(spark, directory):
    t = triples_from_tables(spark, directory)
    vertices = mf.assign_ids(mf.node_set(t))
    return mf.object_nodes(t, vertices).select(F.col("uri").alias("o"))


def _dense(t, start: int = 0) -> DataFrame:
    return mf.assign_dense_ids(mf.graph_nodes(t), start)


def encode_edges(spark, directory):
    t = triples_from_tables(spark, directory)
    return mf.encode_edges(t, _dense(t), distinct=False)


def triplet_view(spark, directory):
    t = triples_from_tables(spark, directory)
    ids = _dense(t)
    heads = mf.vertex_counts(t, ids)
    view = mf.triplet_view(heads, mf.encode_edges(t, ids, distinct=False))
    return view.select("src_uri", "pred", "dst_uri", "src_n_props", "dst_n_props")


def semi_join(spark, directory):
    t = triples_from_tables(spark, directory)
    residents = mf.pattern_scan(t, ("?c", pred("residesIn"), "?n"))
    named = mf.has_property_value(t, pred("name"), '"NATION_1"')
    return mf.semi_join(residents, named.withColumnRenamed("s", "n"))


def property_bag(spark, directory):
    """The pairs of all bags; how they are dealt over parts is no part of the answer."""
    bags = mf.property_bag(triples_from_tables(spark, directory))
    return bags.select("s", F.explode("props").alias("x")).select("s", "x.prop", "x.obj")


def vertices(spark, directory):
    t = triples_from_tables(spark, directory)
    return mf.vertex_heads(mf.build_vertices(t, _dense(t)))


def vertex_union(spark, directory):
    """Vertices seen as objects (no attributes) united with those seen as subjects."""
    t = triples_from_tables(spark, directory)
    ids = mf.assign_ids(mf.node_set(t))
    subjects = stage(ids.join(mf.subject_nodes(t).withColumnRenamed("node", "uri"), "uri", "left_semi"), "subjects")
    as_subject = mf.build_vertices(t, subjects)
    as_object = mf.object_nodes(t, ids).select(
        "id", "uri", F.lit(0).alias("part"), F.array().cast(as_subject.schema["props"].dataType).alias("props")
    )
    merged = mf.merge_vertices([as_object, as_subject])
    return mf.vertex_heads(merged).select("uri", "n_props")


def count_solutions(spark, directory):
    return mf.count_solutions(_pattern_query("bgp_triangle")(spark, directory))


def count_star(spark, directory):
    constraints = [(p, o) for _, p, o in PATTERNS["bgp_data_only"]]
    return mf.count_star(_inferred(spark, directory), constraints)


def solutions_per_root(spark, directory):
    return mf.solutions_per_root(_inferred(spark, directory), PATTERNS["bgp_triangle"], "c")


def match_stats(spark, directory):
    return mf.match_stats(_inferred(spark, directory), PATTERNS["bgp_triangle"], "c")


def merge_bindings(spark, directory):
    t = _inferred(spark, directory)
    return mf.merge_bindings(
        [
            mf.pattern_scan(t, ("?c", pred("boughtFrom"), "?s")),
            mf.pattern_scan(t, ("?c", pred("residesIn"), "?n")),
            mf.pattern_scan(t, ("?c", pred("locatedIn"), "?n")),
        ]
    ).select("c", "s", "n")


def union_bindings(spark, directory):
    t = triples_from_tables(spark, directory)
    resident = mf.pattern_scan(t, ("?x", pred("residesIn"), "?n"))
    based = mf.pattern_scan(t, ("?x", pred("basedIn"), "?n")).select("n", "x")
    return mf.union_bindings(resident, based)


def dedup(spark, directory):
    lines = spark.read.parquet(f"{directory}/lineitem.parquet")
    bag = lines.select(
        F.concat(F.lit("<urn:ex:order:"), "l_orderkey", F.lit(">")).alias("s"),
        F.lit(pred("contains")).alias("p"),
        F.concat(F.lit("<urn:ex:part:"), "l_partkey", F.lit(">")).alias("o"),
    )
    return mf.dedup_triples(bag)


def node_set(spark, directory):
    return mf.node_set(triples_from_tables(spark, directory))


def graph_nodes(spark, directory):
    return mf.graph_nodes(triples_from_tables(spark, directory))


def hash_ids(spark, directory):
    """Hash ids checked: nodes, different ids, ids shared by two nodes."""
    ids = mf.assign_ids(mf.graph_nodes(triples_from_tables(spark, directory)))
    per_id = ids.groupBy("id").agg(F.count("*").alias("k"))
    return per_id.agg(
        F.sum("k").alias("n_nodes"),
        F.count("*").alias("n_ids"),
        F.count_if(F.col("k") > 1).alias("n_collisions"),
    )


def dense_ids(spark, directory):
    return _dense(triples_from_tables(spark, directory), DENSE_START)


def next_id(spark, directory):
    return mf.next_id(dense_ids(spark, directory), DENSE_START)


def infer_types(spark, directory):
    t = triples_from_tables(spark, directory)
    return mf.infer_types(t, mf.class_rule_table(spark, CLASS_RULES))


def infer_predicates(spark, directory):
    t = triples_from_tables(spark, directory)
    return mf.infer_predicates(t, mf.predicate_rule_table(spark, PREDICATE_RULES))


def infer(spark, directory):
    t = triples_from_tables(spark, directory)
    bag = mf.infer(
        t,
        mf.class_rule_table(spark, CLASS_RULES),
        mf.predicate_rule_table(spark, PREDICATE_RULES),
    )
    return bag.groupBy("p").agg(F.count("*").alias("n"))


def mapped_inference(spark, directory):
    """Inference compiled into the mapping rules: same triples as ``infer`` as a set."""
    return _inferred(spark, directory).all()


# --- sources and sinks -------------------------------------------------------


def triple_text(spark, directory):
    """Triples written as text lines and read back."""
    path = new_path(spark, "triple-text")
    mf.write_triples(triples_from_tables(spark, directory).all(), path)
    return mf.read_triples(spark, path)


def vertex_text(spark, directory):
    """Vertex lines written and read back, one row per attribute pair."""
    t = triples_from_tables(spark, directory)
    path = new_path(spark, "vertex-text")
    mf.write_vertices(mf.build_vertices(t, _dense(t)), path)
    lines = mf.read_vertices(spark, path)
    return lines.select("id", "uri", F.explode_outer("props").alias("x")).select(
        "id", "uri", "x.prop", "x.obj"
    )


def edge_text(spark, directory):
    """Edge lines written and read back."""
    path = new_path(spark, "edge-text")
    mf.write_edges(encode_edges(spark, directory), path)
    return mf.read_edges(spark, path)


def edge_table(spark, directory):
    """Edges written as a table by predicate; two predicates read back."""
    path = new_path(spark, "edge-table")
    mf.write_edge_table(encode_edges(spark, directory), path)
    edges = mf.read_edge_table(spark, path)
    return edges.where(F.col("pred").isin(pred("partOf"), pred("residesIn")))


#: Deliveries of orders and of lines by date: each begins before the one before it ends.
_DELIVERIES = (("1900-01-01", "1998-01-01"), ("1997-01-01", "2000-01-01"), ("1999-01-01", "2999-01-01"))


def _delivery(spark, directory, number) -> TableTriples:
    """All tables, but only the orders and lines of one delivery; the last takes those without a date."""
    first, end = _DELIVERIES[number]
    last = number == len(_DELIVERIES) - 1

    def dated(column: str) -> str:
        return f"{column} >= '{first}' AND {column} < '{end}'" + (f" OR {column} IS NULL" if last else "")

    return triples_from_tables(spark, directory, {"orders": dated("o_orderdate"), "lineitem": dated("l_shipdate")})


def continued_ids(spark, directory):
    """Ids of three deliveries, one after the other; a node keeps the id of the first that has it."""
    path = new_path(spark, "ids")
    for number in range(len(_DELIVERIES)):
        mf.append_ids(mf.graph_nodes(_delivery(spark, directory, number)), path, DENSE_START)
    return mf.open_ids(spark, path)


def extended_ids(spark, directory):
    """The nodes that all tables add to those of the customers and suppliers, numbered on after them."""
    t = triples_from_tables(spark, directory)
    partners = mf.filter_edges(t, [pred("residesIn"), pred("basedIn")])
    existing = stage(mf.assign_dense_ids(mf.graph_nodes(partners)), "partners")
    return mf.extend_ids(existing, mf.graph_nodes(t))


_stores: dict[tuple[str, ...], str] = {}


def _appended(spark, directory, compacted: bool = False):
    """The inferred graph again, delivered in three overlapping parts, each added to the store."""
    known = (spark.sparkContext.applicationId, directory, "appended")
    if known not in _stores:
        path = new_path(spark, "grown")
        for number in range(len(_DELIVERIES)):
            inferred = _delivery(spark, directory, number).with_inference(CLASS_RULES, PREDICATE_RULES)
            mf.append_store(inferred.bag(), path, rows=inferred.most_rows())
        _stores[known] = path
    if compacted:
        mf.compact_store(spark, _stores[known], first=2)
    return _stores[known]


def appended_catalog(spark, directory):
    return mf.store_catalog(spark, _appended(spark, directory))


def appended_triangle(spark, directory):
    return mf.match_bgp(mf.open_store(spark, _appended(spark, directory)), PATTERNS["bgp_triangle"])


def appended_snowflake(spark, directory):
    return mf.match_bgp(mf.open_store(spark, _appended(spark, directory)), PATTERNS["bgp_snowflake"])


def compacted_path3(spark, directory):
    """The two later batches made one."""
    return mf.match_bgp(mf.open_store(spark, _appended(spark, directory, True)), PATTERNS["bgp_path3"])


def _stored(spark, directory):
    """The inferred graph of ``directory``, written once per application and opened from its store."""
    known = (spark.sparkContext.applicationId, directory)
    if known not in _stores:
        full = mf.infer(
            triples_from_tables(spark, directory).bag(),
            mf.class_rule_table(spark, CLASS_RULES),
            mf.predicate_rule_table(spark, PREDICATE_RULES),
        )
        path = new_path(spark, "store")
        mf.write_store(full, path, distinct=True, rows=_inferred(spark, directory).most_rows())
        _stores[known] = path
    return mf.open_store(spark, _stores[known])


def _stored_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """A pattern over stored triples, with the catalog instead of a mapping."""

    def run(spark: SparkSession, directory: str) -> DataFrame:
        return mf.match_bgp(_stored(spark, directory), PATTERNS[name], name in BOUND)

    return run


#: Patterns that are also registered over stored triples.
_STORED = (
    "triangle",
    "star_bind",
    "data_literal",
    "path3",
    "const_hub",
    "snowflake",
    "parallel_edges",
    "inferred_const",
)


def mapped_chain(spark, directory):
    """Inference twice, in the mapping: segment to kind, kind to role; only two segments have a kind."""
    t = triples_from_tables(spark, directory)
    first = [(node("seg", "FURNITURE"), cls("Home")), (node("seg", "HOUSEHOLD"), cls("Home"))]
    second = [(cls("Home"), cls("Target"))]
    return t.with_inference(first).with_inference(second).scan(mf.RDF_TYPE, o=cls("Target"))


#: Rules as a modeller writes them, one step each; the last two go round in a circle.
_DIRECT_CLASSES = (
    *((node("seg", v), cls("Customer")) for v in SEGMENTS),
    *((node("ostatus", v), cls("Order")) for v in ORDER_STATUSES),
    (cls("Customer"), cls("Partner")),
    (cls("Supplier"), cls("Partner")),
    (cls("Partner"), cls("Agent")),
    (cls("Agent"), cls("Thing")),
    (cls("Order"), cls("Record")),
    (cls("Record"), cls("Thing")),
    (cls("Thing"), cls("Entity")),
    (cls("Entity"), cls("Thing")),
)
_DIRECT_PREDICATES = (
    (pred("residesIn"), pred("locatedIn")),
    (pred("basedIn"), pred("locatedIn")),
    (pred("locatedIn"), pred("relatedTo")),
    (pred("partOf"), pred("relatedTo")),
)


def infer_closed(spark, directory):
    """What follows from direct rules by any chain of them: the rules are closed first, the data read once."""
    classes = mf.close_rules(mf.class_rule_table(spark, _DIRECT_CLASSES))
    predicates = mf.close_rules(mf.predicate_rule_table(spark, _DIRECT_PREDICATES))
    all_ = mf.infer(triples_from_tables(spark, directory), classes, predicates)
    return all_.groupBy("p", F.when(F.col("p") == mf.RDF_TYPE, F.col("o")).alias("class")).agg(F.count("*").alias("n"))


_bitmap_tables: dict[tuple[str, str], tuple[str, str]] = {}


def _bitmaps(spark, directory) -> tuple[DataFrame, DataFrame]:
    """Bitmaps of the attributes of the stored graph, and the node ids; written once per application."""
    known = (spark.sparkContext.applicationId, directory)
    if known not in _bitmap_tables:
        t = _stored(spark, directory)
        ids, bits = new_path(spark, "ids"), new_path(spark, "bitmaps")
        own = mf.append_ids(mf.graph_nodes(t), ids)
        listed = mf.listable_predicates(t)
        data = [r["p"] for r in mf.predicate_catalog(t).where("kind = 'data'").select("p").collect()]
        mf.write_bitmaps(mf.predicate_bitmaps(t, own, listed, data), bits)
        _bitmap_tables[known] = ids, bits
    ids, bits = _bitmap_tables[known]
    return mf.open_bitmaps(spark, bits), mf.open_ids(spark, ids)


_STAR = [(pred("returnflag"), '"R"'), (pred("returnflag"), '"A"'), (pred("priority"), "?any")]


def bitmap_count_star(spark, directory):
    constraints = [(p, o) for _, p, o in PATTERNS["bgp_data_only"]]
    return mf.count_star_bitmaps(_bitmaps(spark, directory)[0], constraints)


def bitmap_star_filter(spark, directory):
    """The orders of ``star_filter``: ids from bitmaps, names from the dictionary."""
    bitmaps, ids = _bitmaps(spark, directory)
    found = mf.bitmap_ids(mf.star_bitmap(bitmaps, _STAR))
    return ids.join(found, "id", "left_semi").select(F.col("uri").alias("o"))


def characteristic_sets(spark, directory):
    sets = mf.characteristic_sets(triples_from_tables(spark, directory))
    return sets.select(
        F.array_join("predicates", " ").alias("predicates"), "n_subjects", F.array_join("n_triples", " ").alias("n_triples")
    )


def sets_count_star(spark, directory):
    """Orders with a priority and lines, from the table of sets alone."""
    sets = stage(mf.characteristic_sets(triples_from_tables(spark, directory)), "sets")
    return mf.count_star_sets(sets, [pred("priority"), pred("returnflag"), pred("contains")])


def _adjacency(spark, directory) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges of three predicates, their neighbour arrays in short chunks, and the node ids."""
    t = _inferred(spark, directory)
    edges = mf.filter_edges(t, [pred("boughtFrom"), pred("locatedIn"), pred("contains")], keep_source=True)
    ids = mf.append_ids(mf.graph_nodes(edges), new_path(spark, "ids"))
    coded = stage(mf.encode_edges(edges, ids, distinct=False), "edges")
    path = new_path(spark, "adjacency")
    mf.write_adjacency(mf.adjacency(coded, chunk=64), path)
    return coded, mf.open_adjacency(spark, path), ids


def _named(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids of all columns as uris."""
    for c in df.columns:
        df = df.join(ids.select(F.col("id").alias(c), F.col("uri").alias("#uri")), c).withColumn(c, F.col("#uri")).drop("#uri")
    return df


def adjacency_triangle(spark, directory):
    """Customers and suppliers that trade and have a place in common, by intersecting their places."""
    edges, rows, ids = _adjacency(spark, directory)
    trade = edges.where(F.col("pred") == pred("boughtFrom")).select(F.col("src").alias("c"), F.col("dst").alias("s"))
    found = mf.close_edges(trade, rows, ("c", pred("locatedIn")), ("s", pred("locatedIn")), "n")
    return _named(found, ids).select("c", "s", "n")


#: Customers and suppliers that trade, parts they supply, orders of these parts by the same customers.
_FOUR_CYCLE = [
    ("?c", pred("boughtFrom"), "?s"),
    ("?s", pred("supplies"), "?p"),
    ("?o", pred("contains"), "?p"),
    ("?o", pred("placedBy"), "?c"),
]


def _located_ids(spark, t) -> DataFrame:
    path = new_path(spark, "located-ids")
    mf.write_ids(_dense(t), path)
    return mf.open_bucketed(spark, path)


def _located(spark, directory) -> mf.Located:
    """Nodes, edges from both ends and attributes in buckets by node, written once per application and opened."""
    known = (spark.sparkContext.applicationId, directory, "located")
    if known not in _stores:
        t = triples_from_tables(spark, directory)
        ids = _located_ids(spark, t)
        heads = stage(mf.vertex_counts(t, ids), "heads")
        edges = stage(mf.encode_located(t, ids, distinct=False).sortWithinPartitions("src", "dst"), "edges")
        props = stage(mf.coded_props(t, ids), "props")
        path = new_path(spark, "located")
        mf.write_located(heads, edges, props, path)
        _stores[known] = path
    return mf.open_located(spark, _stores[known])


def located_edges(spark, directory):
    """Edges encoded with a dictionary in buckets by uri."""
    t = triples_from_tables(spark, directory)
    return mf.encode_located(t, _located_ids(spark, t), distinct=False)


def located_view(spark, directory):
    view = mf.located_view(_located(spark, directory))
    return view.select("src_uri", "pred", "dst_uri", "src_n_props", "dst_n_props")


def located_props(spark, directory):
    return mf.located_props(_located(spark, directory)).select(F.col("uri").alias("s"), "prop", "obj")


def grid_triangle(spark, directory):
    return mf.match_bgp_grid(_inferred(spark, directory), PATTERNS["bgp_triangle"])


def grid_four_cycle(spark, directory):
    return mf.match_bgp_grid(triples_from_tables(spark, directory), _FOUR_CYCLE)


def reduced_path3(spark, directory):
    return mf.match_bgp_reduced(_inferred(spark, directory), PATTERNS["bgp_path3"])


def reduced_snowflake(spark, directory):
    return mf.match_bgp_reduced(_inferred(spark, directory), PATTERNS["bgp_snowflake"])


_OPERATORS = (
    map_triples,
    classify,
    predicate_catalog,
    pattern_scan,
    filter_edges,
    const_term,
    has_property,
    has_property_value,
    star_filter,
    project_solutions,
    project_bgp,
    natural_join,
    salted_join,
    expand_edge,
    expand_edge_backward,
    attach_props,
    object_nodes,
    encode_edges,
    triplet_view,
    semi_join,
    property_bag,
    vertices,
    vertex_union,
    count_solutions,
    count_star,
    solutions_per_root,
    match_stats,
    merge_bindings,
    union_bindings,
    dedup,
    node_set,
    graph_nodes,
    hash_ids,
    dense_ids,
    next_id,
    infer_types,
    infer_predicates,
    infer,
    mapped_inference,
    triple_text,
    vertex_text,
    edge_text,
    edge_table,
    mapped_chain,
    continued_ids,
    extended_ids,
    appended_catalog,
    appended_triangle,
    appended_snowflake,
    compacted_path3,
    grid_triangle,
    grid_four_cycle,
    reduced_path3,
    reduced_snowflake,
    bitmap_count_star,
    bitmap_star_filter,
    characteristic_sets,
    sets_count_star,
    infer_closed,
    adjacency_triangle,
    located_edges,
    located_view,
    located_props,
)
_COUNTED = ("bgp_path3", "bgp_const_hub", "bgp_triangle", "bgp_snowflake", "bgp_shared_const")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {f.__name__: f for f in _OPERATORS}
    found |= {name: _pattern_query(name) for name in PATTERNS}
    # All pairs by definition: the registered form counts them per customer.
    found["bgp_shared_const"] = lambda spark, directory: mf.solutions_per_root(
        _inferred(spark, directory), PATTERNS["bgp_shared_const"], "c"
    )
    found |= {f"stored_{name}": _stored_query(f"bgp_{name}") for name in _STORED}
    found |= {f"count_{name}": _count_query(name) for name in _COUNTED}
    return found | _llm_queries()[0]


def _llm_queries() -> tuple[dict, dict]:
    """Queries and SQL of the training-data operators; none where that subpackage is absent."""
    try:
        from motifold.llm import queries as llm
    except ImportError:
        return {}, {}
    return dict(llm.QUERIES), dict(llm.SQL)


# --- SQL ----------------------------------------------------------------------

_TYPE = f"'{mf.RDF_TYPE}'"


def _p(name: str) -> str:
    return f"'{pred(name)}'"


def _c(name: str) -> str:
    return f"'{cls(name)}'"


def _n(kind: str, column: str) -> str:
    return f"('<urn:ex:{kind}:' || {column} || '>')"


def _l(column: str) -> str:
    return f"""('"' || {column} || '"')"""


def _map_cte() -> str:
    rows = [
        ("customer", _n("customer", "c_custkey"), _TYPE, _n("seg", "c_mktsegment")),
        ("customer", _n("customer", "c_custkey"), _p("residesIn"), _n("nation", "c_nationkey")),
        ("customer", _n("customer", "c_custkey"), _p("name"), _l("c_name")),
        ("supplier", _n("supplier", "s_suppkey"), _TYPE, _c("Supplier")),
        ("supplier", _n("supplier", "s_suppkey"), _p("basedIn"), _n("nation", "s_nationkey")),
        ("supplier", _n("supplier", "s_suppkey"), _p("name"), _l("s_name")),
        ("nation", _n("nation", "n_nationkey"), _TYPE, _c("Nation")),
        ("nation", _n("nation", "n_nationkey"), _p("partOf"), _n("region", "n_regionkey")),
        ("nation", _n("nation", "n_nationkey"), _p("name"), _l("n_name")),
        ("region", _n("region", "r_regionkey"), _TYPE, _c("Region")),
        ("region", _n("region", "r_regionkey"), _p("name"), _l("r_name")),
        ("part", _n("part", "p_partkey"), _TYPE, _n("ptype", "p_type")),
        ("part", _n("part", "p_partkey"), _p("brand"), _l("p_brand")),
        ("orders", _n("order", "o_orderkey"), _TYPE, _n("ostatus", "o_orderstatus")),
        ("orders", _n("order", "o_orderkey"), _p("placedBy"), _n("customer", "o_custkey")),
        ("orders", _n("order", "o_orderkey"), _p("priority"), _l("o_orderpriority")),
        ("lineitem", _n("order", "l_orderkey"), _p("contains"), _n("part", "l_partkey")),
        ("lineitem", _n("order", "l_orderkey"), _p("hasSupplier"), _n("supplier", "l_suppkey")),
        ("lineitem", _n("order", "l_orderkey"), _p("returnflag"), _l("l_returnflag")),
        ("lineitem", _n("supplier", "l_suppkey"), _p("supplies"), _n("part", "l_partkey")),
        (
            "lineitem JOIN orders ON l_orderkey = o_orderkey",
            _n("customer", "o_custkey"),
            _p("boughtFrom"),
            _n("supplier", "l_suppkey"),
        ),
    ]
    union = "\n UNION ".join(f"SELECT {s} AS s, {p} AS p, {o} AS o FROM {t}" for t, s, p, o in rows)
    data = f"(o LIKE '\"%' OR p = {_TYPE})"
    return f"""WITH m AS ({union}),
 k AS (SELECT *, CASE WHEN o LIKE '"%' THEN 'literal' WHEN p = {_TYPE} THEN 'type' ELSE 'object' END AS kind FROM m),
 g AS (SELECT s AS node FROM m UNION SELECT o FROM m WHERE NOT {data}),
 i AS (SELECT row_number() OVER (ORDER BY node) - 1 AS id, node AS uri FROM g),
 b AS (SELECT s, count(*) AS n_props FROM m WHERE {data} GROUP BY s),
 v AS (SELECT id, uri, CAST(coalesce(n_props, 0) AS BIGINT) AS n_props FROM i LEFT JOIN b ON uri = s),
 e AS (SELECT a.id AS src, z.id AS dst, p AS pred FROM k JOIN i a ON a.uri = s JOIN i z ON z.uri = o WHERE kind = 'object')
"""


def _continued_sql() -> str:
    """A node's delivery is the first with an order or line that has it; the other tables are in all of them."""
    always = [
        ("customer", _n("customer", "c_custkey")),
        ("customer", _n("nation", "c_nationkey")),
        ("supplier", _n("supplier", "s_suppkey")),
        ("supplier", _n("nation", "s_nationkey")),
        ("nation", _n("nation", "n_nationkey")),
        ("nation", _n("region", "n_regionkey")),
        ("region", _n("region", "r_regionkey")),
        ("part", _n("part", "p_partkey")),
    ]
    dated = [
        ("orders", _n("order", "o_orderkey"), "o_orderdate"),
        ("orders", _n("customer", "o_custkey"), "o_orderdate"),
        ("lineitem", _n("order", "l_orderkey"), "l_shipdate"),
        ("lineitem", _n("part", "l_partkey"), "l_shipdate"),
        ("lineitem", _n("supplier", "l_suppkey"), "l_shipdate"),
        ("lineitem JOIN orders ON l_orderkey = o_orderkey", _n("customer", "o_custkey"), "l_shipdate"),
    ]
    parts = [f"SELECT {node_} AS node, 0 AS d FROM {table}" for table, node_ in always]
    ends = " ".join(f"WHEN {{0}} < TIMESTAMP '{end}' THEN {k}" for k, (_, end) in enumerate(_DELIVERIES))
    parts += [f"SELECT {node_}, CASE {ends.format(date)} ELSE 2 END FROM {table}" for table, node_, date in dated]
    firsts = f"SELECT node, min(d) AS d FROM ({' UNION ALL '.join(parts)}) WHERE node IS NOT NULL GROUP BY node"
    return f"SELECT row_number() OVER (ORDER BY d, node) - 1 + {DENSE_START} AS id, node AS uri FROM ({firsts})"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in rows)


def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_CUST = _n("customer", "c_custkey")
_SUPP = _n("supplier", "s_suppkey")
_ORD = _n("order", "o_orderkey")
_NAT = _n("nation", "n_nationkey")
_C_NAT = _n("nation", "c_nationkey")
_S_NAT = _n("nation", "s_nationkey")
_CUSTOMER_TYPED = f"c_mktsegment IN ({_in(SEGMENTS)})"
_TRIANGLE_FROM = f"""FROM (SELECT DISTINCT o_custkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
 JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
 WHERE c_nationkey = s_nationkey"""
_TRIANGLE = f"SELECT {_CUST} AS c, {_SUPP} AS s, {_C_NAT} AS n {_TRIANGLE_FROM} AND {_CUSTOMER_TYPED}"


_ORDER_PARTS = f"""SELECT DISTINCT {_ORD} AS o, {_n('customer', 'o_custkey')} AS c, {_n('part', 'l_partkey')} AS p
 FROM orders JOIN lineitem ON l_orderkey = o_orderkey"""


_FOUR_CYCLE_SQL = f"""WITH l AS (
  SELECT DISTINCT l_orderkey AS o, o_custkey AS c, l_partkey AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 b AS (SELECT DISTINCT o_custkey AS c, l_suppkey AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 t AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem)
SELECT {_n('customer', 'l.c')} AS c, {_n('supplier', 'b.s')} AS s, {_n('part', 'l.p')} AS p, {_n('order', 'l.o')} AS o
FROM l JOIN b ON b.c = l.c JOIN t ON t.s = b.s AND t.p = l.p"""


def _relational_sql() -> dict[str, str]:
    star_cols = f"{_l('o_orderpriority')} AS y1, {_l('l_returnflag')} AS y2"
    star_from = (
        "FROM orders JOIN lineitem ON l_orderkey = o_orderkey "
        f"WHERE o_custkey = 0 AND o_orderstatus IN ({_in(ORDER_STATUSES)})"
    )
    agents = (
        f"SELECT {_CUST} AS a, c_nationkey AS n FROM customer WHERE {_CUSTOMER_TYPED} "
        f"UNION ALL SELECT {_SUPP}, s_nationkey FROM supplier"
    )
    return {
        "bgp_type_const": f"SELECT {_CUST} AS c FROM customer WHERE c_mktsegment = 'FURNITURE' AND c_nationkey = 2",
        "bgp_inferred_const": f"SELECT a FROM ({agents}) WHERE n = 6",
        "bgp_star_exists": f"SELECT DISTINCT {_ORD} AS o {star_from}",
        "bgp_star_bind": f"SELECT DISTINCT {_ORD} AS o, {star_cols} {star_from}",
        "bgp_data_only": f"SELECT a FROM ({agents})",
        "bgp_data_literal": f"SELECT DISTINCT {_ORD} AS x FROM orders JOIN lineitem ON l_orderkey = o_orderkey "
        "WHERE o_orderpriority = '1-URGENT' AND l_returnflag = 'R'",
        "bgp_path2_const": f"SELECT {_CUST} AS c, {_NAT} AS n FROM customer JOIN nation ON n_nationkey = c_nationkey "
        f"WHERE n_regionkey = 1 AND {_CUSTOMER_TYPED}",
        "bgp_path3": f"SELECT {_ORD} AS o, {_CUST} AS c, {_NAT} AS n, {_n('region', 'r_regionkey')} AS r "
        "FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey "
        "JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'",
        "bgp_const_hub": f"SELECT DISTINCT {_ORD} AS o, {_n('part', 'l_partkey')} AS p "
        "FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' "
        "AND l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 0)",
        "bgp_triangle": _TRIANGLE,
        "bgp_snowflake": f"SELECT DISTINCT {_ORD} AS o, {_CUST} AS c, {_n('part', 'p_partkey')} AS p, {_NAT} AS n "
        "FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey "
        "JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey "
        "WHERE n_regionkey = 0 AND p_brand = 'Brand#13' AND o_orderpriority = '1-URGENT'",
        "bgp_parallel_edges": f"SELECT {_SUPP} AS s, {_S_NAT} AS n FROM supplier",
        "bgp_shared_const": f"SELECT {_CUST} AS c, (SELECT count(*) FROM supplier WHERE s_nationkey = 6) AS n "
        "FROM customer WHERE c_nationkey = 6 AND EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = 6)",
        "pattern_scan": f"SELECT {_ORD} AS o, {_n('customer', 'o_custkey')} AS c FROM orders",
        "filter_edges": f"SELECT {_NAT} AS s, {_p('partOf')} AS p, {_n('region', 'n_regionkey')} AS o FROM nation "
        f"UNION ALL SELECT {_CUST}, {_p('residesIn')}, {_C_NAT} FROM customer",
        "const_term": f"SELECT {_CUST} AS c FROM customer WHERE c_nationkey = 2",
        "has_property": f"SELECT DISTINCT {_n('order', 'l_orderkey')} AS o FROM lineitem",
        "has_property_value": f"SELECT DISTINCT {_n('order', 'l_orderkey')} AS o FROM lineitem WHERE l_returnflag = 'R'",
        "star_filter": f"SELECT {_ORD} AS o FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem "
        "WHERE l_returnflag IN ('R', 'A') GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 2)",
        "project_solutions": f"SELECT DISTINCT {_C_NAT} AS n FROM orders JOIN customer ON c_custkey = o_custkey",
        "project_bgp": f"SELECT DISTINCT {_C_NAT} AS n FROM orders JOIN customer ON c_custkey = o_custkey",
        "natural_join": _ORDER_PARTS,
        "salted_join": _ORDER_PARTS,
        "expand_edge": f"SELECT {_ORD} AS o, {_CUST} AS c, {_C_NAT} AS n FROM orders "
        "JOIN customer ON c_custkey = o_custkey",
        "expand_edge_backward": f"SELECT {_CUST} AS c, {_NAT} AS n, {_n('region', 'n_regionkey')} AS r FROM nation "
        "JOIN customer ON c_nationkey = n_nationkey",
        "semi_join": f"SELECT {_CUST} AS c, {_NAT} AS n FROM customer JOIN nation ON n_nationkey = c_nationkey "
        "WHERE n_name = 'NATION_1'",
        "count_solutions": f"SELECT count(*) AS n FROM (SELECT DISTINCT * FROM ({_TRIANGLE}))",
        "count_star": f"SELECT count(*) AS n FROM ({agents})",
        "solutions_per_root": f"SELECT c, count(*) AS n FROM ({_TRIANGLE}) GROUP BY c",
        "merge_bindings": f"SELECT DISTINCT {_CUST} AS c, {_n('supplier', 'l_suppkey')} AS s, {_C_NAT} AS n "
        "FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey",
        "union_bindings": f"SELECT {_CUST} AS x, {_C_NAT} AS n FROM customer "
        f"UNION ALL SELECT {_SUPP}, {_S_NAT} FROM supplier",
        "dedup": f"SELECT DISTINCT {_n('order', 'l_orderkey')} AS s, {_p('contains')} AS p, "
        f"{_n('part', 'l_partkey')} AS o FROM lineitem",
        "infer_types": " UNION ALL ".join(
            [
                f"SELECT {_CUST} AS s, {_TYPE} AS p, {_c('Customer')} AS o FROM customer WHERE {_CUSTOMER_TYPED}",
                f"SELECT {_CUST}, {_TYPE}, {_c('Agent')} FROM customer WHERE {_CUSTOMER_TYPED}",
                f"SELECT {_SUPP}, {_TYPE}, {_c('Agent')} FROM supplier",
                f"SELECT {_n('part', 'p_partkey')}, {_TYPE}, {_c('Part')} FROM part WHERE p_type IN ({_in(PART_TYPES)})",
                f"SELECT {_ORD}, {_TYPE}, {_c('Order')} FROM orders WHERE o_orderstatus IN ({_in(ORDER_STATUSES)})",
            ]
        ),
        "mapped_chain": f"SELECT {_CUST} AS s, {_TYPE} AS p, {_c('Target')} AS o FROM customer "
        "WHERE c_mktsegment IN ('FURNITURE', 'HOUSEHOLD')",
        "infer_predicates": f"SELECT {_CUST} AS s, {_p('locatedIn')} AS p, {_C_NAT} AS o FROM customer "
        f"UNION ALL SELECT {_SUPP}, {_p('locatedIn')}, {_S_NAT} FROM supplier",
    }


def _triple_set_sql() -> dict[str, str]:
    rules = (
        f", cr AS (SELECT * FROM (VALUES {_values(CLASS_RULES)}) AS cr(cls, sup))"
        f", pr AS (SELECT * FROM (VALUES {_values(PREDICATE_RULES)}) AS pr(pp, sup))"
        f", f AS (SELECT s, p, o FROM m UNION ALL SELECT s, p, sup FROM m JOIN cr ON o = cls WHERE p = {_TYPE}"
        " UNION ALL SELECT s, sup, o FROM m JOIN pr ON p = pp)"
    )
    body = {
        "map_triples": "SELECT s, p, o FROM m",
        "classify": "SELECT kind, count(*) AS n FROM k GROUP BY kind",
        "predicate_catalog": "SELECT p, CASE WHEN bool_or(kind <> 'object') THEN 'data' ELSE 'object' END AS kind, "
        "count(*) AS n FROM k GROUP BY p",
        "attach_props": "SELECT s, p AS prop, o AS obj FROM k WHERE kind <> 'object'",
        "object_nodes": "SELECT DISTINCT o FROM m",
        "encode_edges": "SELECT src, dst, pred FROM e",
        "triplet_view": "SELECT a.uri AS src_uri, pred, z.uri AS dst_uri, a.n_props AS src_n_props, "
        "z.n_props AS dst_n_props FROM e JOIN v a ON a.id = src JOIN v z ON z.id = dst",
        "property_bag": "SELECT s, p AS prop, o AS obj FROM k WHERE kind <> 'object'",
        "vertices": "SELECT id, uri, n_props FROM v",
        "vertex_union": "SELECT node AS uri, CAST(coalesce(n_props, 0) AS BIGINT) AS n_props "
        "FROM (SELECT s AS node FROM m UNION SELECT o FROM m) LEFT JOIN b ON node = s",
        "node_set": "SELECT s AS node FROM m UNION SELECT o FROM m",
        "graph_nodes": "SELECT node FROM g",
        "hash_ids": "SELECT count(*) AS n_nodes, count(*) AS n_ids, CAST(0 AS BIGINT) AS n_collisions FROM g",
        "dense_ids": f"SELECT id + {DENSE_START} AS id, uri FROM i",
        "next_id": f"SELECT count(*) + {DENSE_START} AS next_id FROM g",
        "triple_text": "SELECT s, p, o FROM m",
        "vertex_text": "SELECT id, uri, p AS prop, o AS obj FROM i LEFT JOIN "
        "(SELECT * FROM k WHERE kind <> 'object') ON uri = s",
        "edge_text": "SELECT src, dst, pred FROM e",
        "edge_table": f"SELECT src, dst, pred FROM e WHERE pred IN ({_p('partOf')}, {_p('residesIn')})",
    }
    inferred = {
        "infer": "SELECT p, count(*) AS n FROM f GROUP BY p",
        "mapped_inference": "SELECT DISTINCT s, p, o FROM f",
        "match_stats": "SELECT 'nodes' AS stage, count(*) AS n FROM (SELECT s FROM f UNION SELECT o FROM f) "
        f"UNION ALL SELECT 'complete_roots', count(DISTINCT c_custkey) {_TRIANGLE_FROM} "
        f"UNION ALL SELECT 'checked_roots', count(DISTINCT c_custkey) {_TRIANGLE_FROM} AND {_CUSTOMER_TYPED} "
        f"UNION ALL SELECT 'solutions', count(*) {_TRIANGLE_FROM} AND {_CUSTOMER_TYPED}",
    }
    cte = _map_cte()
    closed = (
        "WITH RECURSIVE dc AS (SELECT * FROM (VALUES " + _values(_DIRECT_CLASSES) + ") AS dc(a, b)), "
        "dp AS (SELECT * FROM (VALUES " + _values(_DIRECT_PREDICATES) + ") AS dp(a, b)), "
        "cc AS (SELECT a, b FROM dc UNION SELECT cc.a, dc.b FROM cc JOIN dc ON cc.b = dc.a), "
        "cp AS (SELECT a, b FROM dp UNION SELECT cp.a, dp.b FROM cp JOIN dp ON cp.b = dp.a), "
    )
    closed_body = (
        f"SELECT p, CASE WHEN p = {_TYPE} THEN o END AS class, count(*) AS n FROM (SELECT s, p, o FROM m UNION ALL "
        f"SELECT s, p, b FROM m JOIN cc ON o = a WHERE p = {_TYPE} AND a <> b UNION ALL "
        "SELECT s, b, o FROM m JOIN cp ON p = a WHERE a <> b) GROUP BY ALL"
    )
    inferred["appended_catalog"] = (
        "SELECT p, CASE WHEN bool_or(o LIKE '\"%' OR p = " + _TYPE + ") THEN 'data' ELSE 'object' END AS kind, "
        "CAST(sum(n) AS BIGINT) AS n, max(n) = 1 AS functional FROM (SELECT p, s, max(o) AS o, count(*) AS n "
        "FROM (SELECT DISTINCT s, p, o FROM f) GROUP BY p, s) GROUP BY p"
    )
    body["extended_ids"] = (
        "SELECT row_number() OVER (ORDER BY node) - 1 + (SELECT count(*) FROM q) AS id, node AS uri "
        "FROM (SELECT node FROM g EXCEPT SELECT node FROM q)"
    )
    body["characteristic_sets"] = (
        "SELECT ps AS predicates, count(*) AS n_subjects, array_to_string(list_transform(range(1, len(any_value(ns)) + 1), "
        "lambda i: CAST(list_sum(list_transform(list(ns), lambda x: x[i])) AS BIGINT)), ' ') AS n_triples FROM "
        "(SELECT s, string_agg(p, ' ' ORDER BY p) AS ps, list(n ORDER BY p) AS ns FROM "
        "(SELECT s, p, count(*) AS n FROM m GROUP BY s, p) GROUP BY s) GROUP BY ps"
    )
    homes = f"p IN ({_p('residesIn')}, {_p('basedIn')})"
    partners = f", q AS (SELECT s AS node FROM m WHERE {homes} UNION SELECT o FROM m WHERE {homes}) "
    body["extended_ids"] = partners + body["extended_ids"]
    found = {k: cte + q for k, q in body.items()} | {k: cte + rules + q for k, q in inferred.items()}
    return found | {"infer_closed": closed + cte.removeprefix("WITH ") + closed_body}


def oracle_sql() -> dict[str, str]:
    found = _relational_sql() | _triple_set_sql()
    found |= {f"count_{name}": f"SELECT count(*) AS n FROM ({found[name]})" for name in _COUNTED}
    pairs = f"SELECT sum(n) AS n FROM ({found['bgp_shared_const']})"
    found["count_bgp_shared_const"] = f"SELECT CAST(coalesce(n, 0) AS BIGINT) AS n FROM ({pairs})"
    found |= {f"stored_{name}": found[f"bgp_{name}"] for name in _STORED}
    found |= {
        "appended_triangle": found["bgp_triangle"],
        "appended_snowflake": found["bgp_snowflake"],
        "compacted_path3": found["bgp_path3"],
        "continued_ids": _continued_sql(),
        "adjacency_triangle": f"SELECT {_CUST} AS c, {_SUPP} AS s, {_C_NAT} AS n {_TRIANGLE_FROM}",
        "bitmap_count_star": found["count_star"],
        "bitmap_star_filter": found["star_filter"],
        "sets_count_star": "SELECT count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) "
        "AND o_orderpriority IS NOT NULL",
        "located_edges": found["encode_edges"],
        "located_view": found["triplet_view"],
        "located_props": found["attach_props"],
        "grid_triangle": found["bgp_triangle"],
        "grid_four_cycle": _FOUR_CYCLE_SQL,
        "reduced_path3": found["bgp_path3"],
        "reduced_snowflake": found["bgp_snowflake"],
    }
    return found | _llm_queries()[1]
