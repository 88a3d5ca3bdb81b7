"""Pattern queries over the order-entry tables."""

from __future__ import annotations

from ..functions.terms import RDF_TYPE as TYPE
from ..sources.tables import cls, node, pred

_CUSTOMER = ("?c", TYPE, cls("Customer"))
_SUPPLIER = ("?s", TYPE, cls("Supplier"))
_ORDER = ("?o", TYPE, cls("Order"))
_STAR = [
    _ORDER,
    ("?o", pred("placedBy"), node("customer", 0)),
    ("?o", pred("priority"), "?y1"),
    ("?o", pred("returnflag"), "?y2"),
]

PATTERNS: dict[str, list[tuple[str, str, str]]] = {
    "bgp_type_const": [
        ("?c", TYPE, node("seg", "FURNITURE")),
        ("?c", pred("residesIn"), node("nation", 2)),
    ],
    "bgp_inferred_const": [
        ("?a", TYPE, cls("Agent")),
        ("?a", pred("locatedIn"), node("nation", 6)),
    ],
    "bgp_star_exists": _STAR,
    "bgp_star_bind": _STAR,
    "bgp_data_only": [("?a", TYPE, cls("Agent"))],
    "bgp_data_literal": [
        ("?x", pred("priority"), '"1-URGENT"'),
        ("?x", pred("returnflag"), '"R"'),
    ],
    "bgp_path2_const": [
        _CUSTOMER,
        ("?n", TYPE, cls("Nation")),
        ("?c", pred("residesIn"), "?n"),
        ("?n", pred("partOf"), node("region", 1)),
    ],
    "bgp_path3": [
        ("?o", pred("placedBy"), "?c"),
        ("?c", pred("residesIn"), "?n"),
        ("?n", pred("partOf"), "?r"),
        ("?r", pred("name"), '"ASIA"'),
    ],
    "bgp_const_hub": [
        (node("supplier", 0), pred("supplies"), "?p"),
        ("?o", pred("contains"), "?p"),
        ("?o", TYPE, node("ostatus", "F")),
    ],
    "bgp_triangle": [
        _CUSTOMER,
        _SUPPLIER,
        ("?c", pred("boughtFrom"), "?s"),
        ("?c", pred("locatedIn"), "?n"),
        ("?s", pred("locatedIn"), "?n"),
    ],
    "bgp_snowflake": [
        ("?o", pred("placedBy"), "?c"),
        ("?o", pred("contains"), "?p"),
        ("?c", pred("residesIn"), "?n"),
        ("?p", pred("brand"), '"Brand#13"'),
        ("?n", pred("partOf"), node("region", 0)),
        ("?o", pred("priority"), '"1-URGENT"'),
    ],
    "bgp_parallel_edges": [
        ("?s", pred("basedIn"), "?n"),
        ("?s", pred("locatedIn"), "?n"),
    ],
    "bgp_shared_const": [
        ("?c", pred("residesIn"), node("nation", 6)),
        ("?s", pred("basedIn"), node("nation", 6)),
    ],
}

#: Queries whose attribute patterns bind their object.
BOUND = frozenset({"bgp_star_bind"})
