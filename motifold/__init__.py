"""Graph-pattern analytics over triples with Spark DataFrames."""

from types import ModuleType as _ModuleType

from .functions.terms import (
    RDF_TYPE,
    bag_has,
    is_literal,
    is_variable,
    literal,
    literal_value,
    match_term,
    triple_kind,
)
from .operators.adjacency import adjacency, close_edges, expand_adjacency, open_adjacency, write_adjacency
from .operators.bitmaps import (
    bitmap_ids,
    count_star_bitmaps,
    filter_by_bitmap,
    listable_predicates,
    predicate_bitmaps,
    star_bitmap,
)
from .operators.charsets import characteristic_sets, count_star_sets, star_rows
from .operators.filters import (
    count_star,
    has_property,
    has_property_value,
    match_star,
    star_filter,
    star_members,
)
from .operators.graph import (
    attach_props,
    build_vertices,
    encode_edges,
    encode_edges_hashed,
    merge_vertices,
    object_nodes,
    property_bag,
    triplet_view,
    vertex_counts,
    vertex_heads,
)
from .operators.grid import Grid, choose_grid, grid_join
from .operators.infer import (
    class_rule_table,
    close_rules,
    infer,
    infer_predicates,
    infer_types,
    lubm_rules,
    predicate_rule_table,
)
from .operators.joins import (
    expand_edge,
    merge_bindings,
    natural_join,
    pair_join,
    pattern_scan,
    project_solutions,
    salted_join,
    semi_join,
    union_bindings,
)
from .operators.keys import assign_dense_ids, assign_ids, extend_ids, id_collisions, known_ids, next_id
from .operators.triples import (
    classify_triples,
    data_triples,
    dedup_triples,
    filter_edges,
    graph_nodes,
    node_set,
    object_triples,
    predicate_catalog,
    subject_nodes,
)
from .plans.bgp import (
    count_bgp,
    count_solutions,
    match_bgp,
    match_stats,
    project_bgp,
    solutions_per_root,
)
from .plans.query_text import parse_query
from .plans.rounds import join_tree, match_bgp_grid, match_bgp_reduced, reduced_relations
from .sources.dictionary import append_ids, next_free_id, open_ids
from .sources.located import (
    Located,
    coded_props,
    encode_located,
    located_props,
    located_sources,
    located_targets,
    located_view,
    open_bucketed,
    open_located,
    write_bucketed,
    write_ids,
    write_located,
)
from .sources.store import (
    append_store,
    compact_store,
    open_bitmaps,
    open_store,
    read_edge_table,
    read_vertex_table,
    store_batches,
    store_catalog,
    stored_sets,
    write_bitmaps,
    write_edge_table,
    write_sets,
    write_store,
    write_vertex_table,
)
from .sources.tables import Rule, TableTriples, Term, triples_from_tables
from .sources.text import (
    read_edges,
    read_triples,
    read_vertices,
    rejected_lines,
    write_edges,
    write_triples,
    write_vertices,
)
from .sources.triples import FrameTriples, Predicate

__all__ = [
    name
    for name, value in list(globals().items())
    if not name.startswith("_") and not isinstance(value, _ModuleType)
]
