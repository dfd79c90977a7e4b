"""The engine's verbs over one graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import BOTH, INCOMING, OUTGOING, Graph
from ..operators import analytics, indexes, search, structure, traversal
from . import expressions as X
from .query import Context, Lookup, Query



class GraphEngine:
    """Lookups, traversals and searches; each verb gives a DataFrame of nodes (or says what else)."""

    def __init__(self, graph: Graph, tables: dict[str, DataFrame] | None = None):
        self.graph, self.context = graph, Context(graph, tables)

    @staticmethod
    def _depth(depth: int | None) -> int | None:
        if depth is not None and depth < 1:
            raise ValueError("depth must be 1 or more, or None for any")
        return depth

    def execute(self, query: Query) -> DataFrame:
        return query.compile(self.context)

    def _lookup(self, kind: str, value: str, method: str | None = None) -> DataFrame:
        return self.execute(Lookup(X.Reference(kind, value, method)))

    def lookup_node(self, node_id) -> DataFrame:
        return self.graph.nodes.where(F.col("id") == node_id)

    def lookup_nodes(self, ids: list) -> DataFrame:
        return self.graph.nodes.where(F.col("id").isin(*ids))

    def lookup_file(self, path: str) -> DataFrame:
        return self._lookup("file", path)

    def lookup_folder(self, path: str) -> DataFrame:
        return self._lookup("folder", path)

    def lookup_class(self, name: str) -> DataFrame:
        return self._lookup("class", name)

    def lookup_function(self, name: str) -> DataFrame:
        return self._lookup("function", name)

    def lookup_method(self, name: str) -> DataFrame:
        return self._lookup("method", name)

    def lookup_interface(self, name: str) -> DataFrame:
        return self._lookup("interface", name)

    def lookup_service(self, name: str) -> DataFrame:
        return self._lookup("service", name)

    def lookup_api(self, name: str) -> DataFrame:
        return self._lookup("api", name)

    def lookup_route(self, path: str, method: str = "GET") -> DataFrame:
        return self._lookup("route", path, method)

    def lookup_symbol(self, name: str) -> DataFrame:
        return self._lookup("symbol", name)

    def _step(self, node_id, direction: str, types: list[str]) -> DataFrame:
        steps = self.graph.directed(direction, types).where(F.col("at") == node_id)
        return self.graph.nodes.join(steps.select(F.col("to").alias("id")), "id", "left_semi")

    def find_callers(self, node_id) -> DataFrame:
        return self._step(node_id, INCOMING, ["CALLS"])

    def find_callees(self, node_id) -> DataFrame:
        return self._step(node_id, OUTGOING, ["CALLS"])

    def find_dependencies(self, node_id, depth: int | None = None) -> DataFrame:
        return traversal.descendants(self.graph, node_id, self._depth(depth))

    def find_dependents(self, node_id, depth: int | None = None) -> DataFrame:
        return traversal.ancestors(self.graph, node_id, self._depth(depth))

    def find_imports(self, node_id) -> DataFrame:
        return self._step(node_id, OUTGOING, ["IMPORTS"])

    def find_exports(self, node_id) -> DataFrame:
        return self._step(node_id, OUTGOING, ["DEFINES"])

    def find_neighbors(self, node_id, depth: int = 1) -> DataFrame:
        return traversal.neighborhood(self.graph, node_id, self._depth(depth))

    find_related_nodes = find_neighbors

    def find_reachable_nodes(self, node_id, targets: list | DataFrame | None = None, depth: int | None = None) -> DataFrame:
        if targets is None:
            return traversal.descendants(self.graph, node_id, self._depth(depth))
        return traversal.reachable(self.graph, node_id, targets, OUTGOING, self._depth(depth))

    def is_reachable(self, a, b, depth: int | None = None) -> bool:
        return a == b or not self.find_reachable_nodes(a, [b], depth).isEmpty()

    def find_paths(self, a, b, depth: int = 12) -> DataFrame:
        return traversal.simple_paths(self.graph, a, [b], self._depth(depth))

    def find_shortest_path(self, a, b) -> list:
        return traversal.shortest_path(self.graph, a, b)

    def find_cycles(self, max_length: int = 6) -> DataFrame:
        return structure.simple_cycles(self.graph.edges, max_length)

    def find_connected_components(self) -> DataFrame:
        return structure.weak_components(self.graph)

    def find_usages(self, node_id, indirect: bool = False, depth: int | None = None) -> DataFrame:
        """(node, depth) of what uses a node: directly, or ``indirect`` up to ``depth`` steps (None: however far)."""
        return traversal.ancestors(self.graph, node_id, self._depth(depth) if indirect else 1, list(indexes.REFERENCES))

    def find_hierarchy(self, node_id, side: str = "BOTH") -> DataFrame:
        """(node, depth) over inheritance and implementation: SUBTYPES, SUPERTYPES or BOTH."""
        kinds = ["INHERITS", "IMPLEMENTS"]
        up, down = traversal.descendants(self.graph, node_id, None, kinds), traversal.ancestors(self.graph, node_id, None, kinds)
        return up if side == "SUPERTYPES" else down if side == "SUBTYPES" else up.union(down)

    def find_impact(self, node_id, depth: int = 5) -> DataFrame:
        return traversal.ancestors(self.graph, node_id, self._depth(depth))

    def query_repository(self) -> DataFrame:
        return self.graph.statistics()

    def search_repository(self, text: str, limit: int = 25) -> DataFrame:
        return search.graded(self.graph.nodes, text, limit)

    def search_symbols(self, text: str, limit: int = 25) -> DataFrame:
        return search.by_name(self.graph.nodes, text, limit)

    def search_by_name(self, pattern: str) -> DataFrame:
        return self.graph.nodes.where(F.col("name").ilike(f"%{pattern}%"))

    def search_by_type(self, node_type: str) -> DataFrame:
        return self.graph.nodes.where(F.col("node_type") == node_type)

    def search_by_metadata(self, key: str, value: str) -> DataFrame:
        return self.graph.nodes.where(F.col("attributes")[key] == value)

    def search_by_annotation(self, name: str) -> DataFrame:
        return self.graph.nodes.where(F.exists("decorators", lambda d: F.regexp_replace(d, "^@+", "") == name.lstrip("@")))

    def contains_node(self, node_id) -> bool:
        return not self.lookup_node(node_id).isEmpty()

    def contains_edge(self, a, b) -> bool:
        return not self.graph.edges.where((F.col("src") == a) & (F.col("dst") == b)).isEmpty()

    def scores(self) -> DataFrame:
        return analytics.scored(self.graph)

    def page(self, df: DataFrame, number: int, size: int, *order: str) -> tuple[DataFrame, int, bool]:
        """A page of an ordered table, the total and whether more follow."""
        total = df.count()
        return df.orderBy(*order).offset((number - 1) * size).limit(size), total, number * size < total
