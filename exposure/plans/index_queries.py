"""The searches of ``fleet_queries`` through a stored index; their SQL is that of the search over the tables."""

from __future__ import annotations

from exposure.operators import index, search
from exposure.plans import fleet_queries  # noqa: F401 (registers the SQL)
from exposure.plans.projection import Projection
from exposure.plans.registry import ORACLES, query
from exposure.plans.stream_queries import run_folder

_built: dict[tuple[str, str], str] = {}


def built(p: Projection) -> index.SearchIndex:
    """The index of all tables; made once a session and data set."""
    key = (p.spark.sparkContext.applicationId, p.dir)
    if key not in _built:
        path = run_folder(p, "search-index")
        index.build(p.inventory, path)
        _built[key] = path
    return index.load(p.spark, _built[key])


SEARCHES = {
    "port_text": ("fl09_search_port_text", [("port", "43")]),
    "port_range": ("fl09_search_port_range", [("port", "80-443")]),
    "service": ("fl09_search_service", [("svc", "HTTP*")]),
    "product": ("fl10_search_product", [("product", "prod1")]),
    "host_fields": ("fl11_search_host_fields", [("os", "Linux"), ("ip", "10.1*"), ("host", "1"), ("mac", "CC:0")]),
    "tag_owner": ("fl12_search_tag_owner", [("tag", "c"), ("owner", "S*c")]),
    "cve": ("fl13_search_cve", [("cve", "cve-2004-*")]),
    "admin": ("fl14_search_admin", [("admin", "container")]),
    "risk": ("fl15_search_risk", [("risk", "20"), ("risk", "<40"), ("risk", ">22")]),
    "text": ("fl16_search_text", [("text", "22 SSH prod0")]),
    "conjunction": ("fl17_search_conjunction", [("os", "windows"), ("port", "1-1024"), ("product", "prod")]),
}


def _register(name: str, like: str, terms: list[tuple[str, str]]) -> None:
    def run(p: Projection):
        return index.search(p.inventory, built(p), terms)

    run.__name__ = f"{like[:4]}_indexed_{name}"
    query()(run)
    ORACLES[run.__name__] = ORACLES[like]


for _name, (_like, _terms) in SEARCHES.items():
    _register(_name, _like, _terms)


@query()
def fl18_indexed_visible_counts(p):
    shown = index.search_and_filter(p.inventory, built(p), [("os", "linux")], "cleartext")
    return search.visible_of(p.inventory, shown)


@query()
def fl19_indexed_quick_search(p):
    return index.quick_search(p.inventory, built(p), "23")


ORACLES["fl18_indexed_visible_counts"] = ORACLES["fl18_visible_counts"]
ORACLES["fl19_indexed_quick_search"] = ORACLES["fl19_quick_search"]
